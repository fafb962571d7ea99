"""WARC archives in Zstandard: writing and reading.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then has one frame per
record, so that any record can be decoded alone. The writer fits the dictionary on the first payloads of each archive
(at most ``SAMPLES``); a page whose payload of at least ``REVISIT`` bytes equals that of a page with a smaller id
becomes a revisit record without payload, which keeps the digest and the HTTP header with the full length. Duplicates are
found on (id, digest) alone; pages don't move for it.

The reader takes archives from any store that Spark reads, loads the dictionary from the leading frame, decodes frame by
frame, and checks the version line, the header fields that each type needs, that the block has Content-Length bytes and
is followed by two line ends, and the payload digest. What is wrong raises ValueError with the archive and offset.

Archives have about ``ARCHIVE`` compressed bytes, so a worker holds no more than one archive and one record.
Each attempt of a task writes files of its own and returns their names; only what the attempts that counted returned is read
back, so tasks that run again, or twice, leave no record too many. Workers open archives through Arrow's file systems.

Defined cases: null html is an empty payload, null url an empty one; a null id is written as such; rows with equal ids and payloads are all
responses if theirs is the smallest id; an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, map_arrow, scratch_path, slices, store, table, text_of, written

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT, ARCHIVE, SAMPLES, DICTIONARY = 100, 8 << 20, 200, 32 << 10
DATE = "2024-01-01T00:00:00Z"


def _record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = [VERSION.decode(), f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _page_record(page: dict) -> bytes:
    payload = page["html"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": f"<urn:page:{page['id']}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": page["url"].replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{page['digest']}",
        "Content-Type": "application/http;msgtype=response",
    }
    if page["refers_to"] is None:
        return _record("response", fields, http + payload)
    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{page['refers_to']}>"}
    return _record("revisit", fields, http)


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b"".join(samples)[-DICTIONARY:]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row to archives in the folder ``path``; returns (file, records), to be run once."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text_of(html_col).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    narrow = rows.where(F.octet_length("html") >= REVISIT).select("id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = written(firsts.withColumnRenamed("n", "rows"), "warc-firsts")
    revisits = hot_join(narrow, firsts, ["digest"], narrow.count(), "inner").where("id > refers_to or id is null and refers_to is not null").select("id", "digest", "refers_to").distinct()
    revisits = written(revisits, "warc-revisits").alias("v")
    rows = rows.alias("r").join(revisits, F.col("r.id").eqNullSafe(F.col("v.id")) & (F.col("r.digest") == F.col("v.digest")), "left")
    rows = rows.select("r.id", "r.url", "r.html", "r.digest", "v.refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        out, count, number, size, writer = None, 0, 0, 0, None
        files, folder = store(path)
        files.create_dir(folder)
        done = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, count))
                out = None

        for batch in slices(batches, "html"):
            records = [_page_record(p) for p in batch.to_pylist()]
            for k, record in enumerate(records):
                if out is None:
                    name = f"part-{context.partitionId():05d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
                    number, count = number + 1, 0
                    words = _dictionary(records[k : k + SAMPLES])
                    writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True, write_content_size=True)
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                    info = writer.compress(_record("warcinfo", {"WARC-Record-ID": f"<urn:archive:{name}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    size = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words + info)
                size += out.write(writer.compress(record))
                count += 1
                if size >= ARCHIVE:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "records": [n for _, n in done]})

    return map_arrow(rows, write, "file string, records bigint")


def frames(data: memoryview, where: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame of an archive, after its leading dictionary."""
    import zstandard

    pos, words = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError(f"{where}: the dictionary frame is cut off")
        raw = bytes(data[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        words, pos = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=words)
    while pos < len(data):
        magic = struct.unpack_from("<I", data, pos)[0] if pos + 8 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            pos += 8 + struct.unpack_from("<I", data, pos + 4)[0]
            continue
        frame, begin, parts = reader.decompressobj(), pos, []
        try:
            while not frame.eof:
                piece = data[pos : pos + (16 << 10)]
                if not len(piece):
                    raise ValueError(f"{where} at {begin}: the frame is cut off")
                parts.append(frame.decompress(piece))
                pos += len(piece) - len(frame.unused_data if frame.eof else b"")
        except zstandard.ZstdError as error:
            raise ValueError(f"{where} at {begin}: {error}") from error
        yield begin, b"".join(parts)


def parse_record(record: bytes, where: str) -> dict:
    """The header fields (lower-case names) and block of a record, validated."""
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not split or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError(f"{where}: no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{where}: a header line without a colon")
        fields[name.strip().decode().lower()] = value.strip().decode()
    needed = ["warc-type", "warc-record-id", "warc-date", "content-length", *(["warc-refers-to", "warc-profile"] if fields.get("warc-type") == "revisit" else [])]
    if missing := [n for n in needed if n not in fields]:
        raise ValueError(f"{where}: without {missing[0]}")
    if not fields["content-length"].isdigit():
        raise ValueError(f"{where}: Content-Length is no number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{where}: the block has not Content-Length bytes")
    return {"fields": fields, "block": rest[:length]}


def _http(block: bytes, where: str) -> tuple[int, bytes]:
    """Content-Length and body of an HTTP response."""
    head, split, body = block.partition(b"\r\n\r\n")
    if not split or not head.startswith(b"HTTP/"):
        raise ValueError(f"{where}: no HTTP header")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return len(body), body


def read_archives(spark: SparkSession, path: str, payloads: bool = True, listed: DataFrame | None = None) -> DataFrame:
    """The response and revisit records of all archives in ``path``, or of those only whose names ``listed`` has (column file).

    Columns: file, offset, record_type, record_id, url, payload_bytes, payload_digest, refers_to, and payload
    (the body; null for revisits) if asked for.
    """
    schema = "file string, offset bigint, record_type string, record_id string, url string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def records(file: str, content: pa.Buffer) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for offset, record in frames(memoryview(content), file):
            where = f"{file} at {offset}"
            parsed = parse_record(record, where)
            fields, kind = parsed["fields"], parsed["fields"]["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            length, body = _http(parsed["block"], where)
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            if kind == "response":
                if length != len(body):
                    raise ValueError(f"{where}: the payload has not Content-Length bytes")
                if digest != hashlib.sha256(body).hexdigest():
                    raise ValueError(f"{where}: the payload has another digest")
            rows.append((file, offset, kind, fields["warc-record-id"], fields.get("warc-target-uri"), length, digest, fields.get("warc-refers-to"), body if kind == "response" else None))
            size += len(body) * payloads
            if size > 4 << 20 or len(rows) >= 5_000:
                yield _rows(rows, names)
                rows, size = [], 0
        if rows:
            yield _rows(rows, names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from records(file.as_py(), content.as_buffer())

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_file(f"{folder}/{name}") as f:
                    content = f.read_buffer()
                yield from records(f"{path}/{name}", content)

    if listed is not None:
        return map_arrow(listed.select("file").repartition("file"), fetch, schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return map_arrow(files, read, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.string())) for k, n in enumerate(names)], names)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch_path(spark, "warc")
    listed = written(write_archives(table(spark, sf_dir, "pages"), path), "warc-files")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return read_archives(spark, path, payloads=False, listed=listed).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to")
    )


OP3_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM f
"""
