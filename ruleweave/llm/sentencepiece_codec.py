"""SentencePiece encoding of merge-type (BPE) models by backtracking, and decoding.

A text is cut before every run of spaces that follows another character; no piece of the model may span such a place
(checked when the model is read), so the segments encode independently. A segment is encoded left to right: the
longest Aho-Corasick match is tried first, and kept if it is compatible with the token before it, that is if undoing
the merges of both in reverse order never meets a merge across the border that would have come first. If no
match fits, the position is marked in a bitfield of failed positions and the last token is taken back; no position
fails twice, so the work is linear. There is one sequence in which all neighbours are compatible, and it is the one
that merging by score, leftmost first, gives. Characters without a piece become byte tokens.

Workers keep the ids of segments in a bounded cache, and gather the ids of all texts of a batch at once. Hashes find a
segment in the cache and its bytes confirm it, so segments that share a hash are told apart.

Defined cases: null text is empty and encodes to the begin and end ids alone; repeated rows each count; segments
of any length are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather, hash_spans, map_arrow, slices, table, text_of, utf8_bytes
from .hash_cache import Growing, SpanStore

MARK = "▁"
CACHE, PAIRS = 1_500_000, 400_000
OUTPUTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


class MergeModel:
    """The pieces of a BPE model with byte fallback, and the backtracking encoder."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        plain = spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or not plain:
            raise ValueError("only BPE models with byte fallback and without normalisation are read")
        kind = pb.ModelProto.SentencePiece
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        pieces = {p.piece: (k, p.score) for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for k, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = k
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode() if p.type == kind.NORMAL else b"")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on after a space")
        longer = sorted((p for p in pieces if len(p) > 1), key=lambda p: -pieces[p][1])
        self.rank = {p: k for k, p in enumerate(longer)}
        self.id_of = {p: k for p, (k, _) in pieces.items()}
        self.parts: dict[str, tuple[str, str]] = {}
        self.trie = ahocorasick.Automaton()
        for p in pieces:
            if len(p) == 1 or self._last_merge(p):
                self.trie.add_word(p, p)
        self.trie.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}

    def _last_merge(self, piece: str) -> bool:
        """Note the parts that merge into a piece; False if merging ends in something else."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 30:
                return False
            k = ranks.index(best)
            if len(parts) == 2:
                self.parts[piece] = parts[0], parts[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging left + right gives these two tokens again."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self._compatible(left, right)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _compatible(self, left: str, right: str) -> bool:
        rank, parts = self.rank, self.parts
        before = 1 << 30  # merges across the border of a lower rank than this come first
        while True:
            if rank.get(left + right, 1 << 30) < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token's last merge is the later one
                left, before = parts[left][1], a
            else:  # on equal ranks the leftmost merge comes first
                right, before = parts[right][0], b + 1

    def encode(self, segment: str) -> list[int]:
        n = len(segment)
        at: list[list[str] | None] = [None] * n
        for end, piece in self.trie.iter(segment):
            begin = end + 1 - len(piece)
            if at[begin] is None:
                at[begin] = [piece]
            else:
                at[begin].append(piece)
        fails = 0
        # tokens so far, with the matches of their positions that are still to try
        tokens: list[str] = []
        left: list[int] = []
        pos, choice = 0, -1
        while pos < n:
            found = at[pos]
            if found is None:
                found = at[pos] = [segment[pos]]
            if choice < 0:
                choice = len(found)
            last = tokens[-1] if tokens else None
            while choice:
                choice -= 1
                piece = found[choice]
                end = pos + len(piece)
                if not fails >> end & 1 and (last is None or self.compatible(last, piece)):
                    tokens.append(piece)
                    left.append(choice)
                    pos, choice = end, -1
                    break
            else:
                if not tokens:
                    raise AssertionError("no encoding")
                fails |= 1 << pos
                pos -= len(tokens.pop())
                choice = left.pop()
        ids: list[int] = []
        id_of = self.id_of
        for piece in tokens:
            k = id_of.get(piece)
            if k is None:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(k)
        return ids


class Codec:
    """A model with its cache of segments, one a worker."""

    of: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        self.model = MergeModel(path)
        self.surface = np.frombuffer(b"".join(self.model.surface), np.uint8)
        self.length = np.array([len(x) for x in self.model.surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.cache = SpanStore(CACHE)
        self.ids, self.ids_at = Growing(np.int32), Growing(np.int64)

    @classmethod
    def get(cls, path: str) -> Codec:
        if path not in cls.of:
            cls.of[path] = cls(path)
        return cls.of[path]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without begin and end ids, and the len + 1 offsets of the rows."""
        column = column.cast(pa.large_string()) if column.type == pa.large_string() else column
        column = pa.compute.replace_substring(column.fill_null(""), MARK, " ")
        full = pa.compute.greater(pa.compute.binary_length(column), 0)
        column = pa.compute.if_else(full, pa.compute.binary_join_element_wise(pa.scalar(" "), column, pa.scalar("")), column)
        data, offsets = utf8_bytes(column)
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(data))
        hashes = hash_spans(data, begin, end)
        used, fresh, base = self.cache.numbers(data, begin, end, hashes)
        if not base:
            self.ids, self.ids_at = Growing(np.int32), Growing(np.int64)
            self.ids_at.append(np.zeros(1, np.int64))
        if len(fresh):
            raw, encode = data.tobytes(), self.model.encode
            found = [encode(raw[b:e].decode().replace(" ", MARK)) for b, e in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids_at.append(self.ids_at.all[-1] + np.cumsum(sizes))
            self.ids.append(np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum())))
        at = self.ids_at.all
        sizes = at[used + 1] - at[used]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids.all[gather(at[used], sizes)]
        return ids, upto[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts, and the len + 1 offsets of the rows. The first space of a row goes."""
        sizes = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        data = self.surface[gather(self.start[ids], sizes)]
        at = upto[offsets]
        lead = at[:-1][at[:-1] < at[1:]]
        lead = lead[data[lead] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        return data[keep], at - np.searchsorted(lead, at)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of ``keep``, then ``outputs``, any of OUTPUTS.

    ids have the begin and end ids; decoded is the text that these ids decode to, *_sha256 are lower-case hex
    digests of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    """
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{k}") for k, c in enumerate(keep)], text_of(text_col).alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(path)
        for batch in slices(batches, "text"):
            ids, at = codec.encode(batch.column("text"))
            n = batch.num_rows
            size = at[1:] - at[:-1]
            whole = np.empty(len(ids) + 2 * n, "<u4")
            begins = at[:-1] + 2 * np.arange(n)
            inner = np.ones(len(whole), bool)
            inner[begins] = inner[begins + size + 1] = False
            whole[inner], whole[begins], whole[begins + size + 1] = ids, codec.model.bos, codec.model.eos
            bounds = np.append(begins, len(whole))
            out: dict[str, pa.Array] = {}
            if "n_tokens" in outputs:
                out["n_tokens"] = pa.array(size + 2)
            if "ids" in outputs:
                out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(whole.astype(np.int32)))
            if "ids_sha256" in outputs:
                out["ids_sha256"] = pa.array([hashlib.sha256(whole[a:b].data).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
            if {"decoded", "decoded_sha256"} & set(outputs):
                data, bounds = codec.decode(whole.astype(np.int64), bounds)
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                if "decoded" in outputs:
                    out["decoded"] = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in spans])
                if "decoded_sha256" in outputs:
                    out["decoded_sha256"] = pa.array([hashlib.sha256(data[a:b].data).hexdigest() for a, b in spans])
            kept = [batch.column(k) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*kept, *[out[c] for c in outputs]], [*[k.split(" ")[0] for k in kinds], *outputs])

    found = map_arrow(rows, run, ", ".join([*kinds, *[f"{c} {OUTPUTS[c]}" for c in outputs]]))
    return found.select(F.col("id").alias(id_col), *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], *outputs)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of all documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
