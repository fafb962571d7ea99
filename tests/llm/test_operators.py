"""Each operator on awkward rows, and against brute force or the library."""

import math
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import exact_dedup, language_id, mixing, near_dedup, ngram_lm, quality, registry, sentencepiece_codec, substring_dedup, token_counts, warc
from ruleweave.llm.components import components
from ruleweave.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, key string, band int, h int, norm string, rep int"
LONG = "x" * 150_000
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[:120])


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "clash", 7, "k", 1, 2, "n", 3)


AWKWARD = [
    row(1, None),
    row(2, ""),
    row(3, " \t\n\x0b "),
    row(4, LONG),
    row(5, PASSAGE),
    row(5, PASSAGE),
    row(6, PASSAGE.replace(" ", "\n")),
    row(7, PASSAGE + " tail", None, None),
    row(8, "A b", "de", "b"),
    row(9, "a B", "de", "b"),
    row(10, "É\u0000 ▁ 😀 <s> <|endoftext|> |$*", "fr", ""),
    row(11, "the " * 3000),
    row(12, "\u0001 \u0001\u0003 a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def texts_of(sf=SF):
    return {k: v for k, v in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    shown = lambda rows: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert shown(want.fetchall()) == shown([tuple(r[n] for n in names) for r in got.collect()])


def test_exact_dedup_awkward(awkward, nothing):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(awkward).collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (5, 5, 3, True), (6, 5, 3, False), (3, 3, 1, True), (12, 12, 1, True)} <= got
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 5, 7, 8, 9, 10, 11, 12]


def test_chunks_determine_the_text(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab \u0001\u0002\u0003"), 200)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact_dedup.chunks(F.col("t"), 2).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]).replace("\u0001\u0003", "").replace("\u0001\u0002", "\u0001") == r["t"]


def test_chunk_conflicts_fall_back_to_the_text(spark, monkeypatch):
    """With hashes that always collide, documents still group by their text."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(F.concat(*c)).cast("long"))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(1, 1), (2, 2), (3, 1)]


def test_quality_awkward(awkward, nothing):
    got = {r["doc_id"]: r for r in quality.judged(awkward).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0 and not got[1]["kept"]
    assert got[11]["n_repeat_words"] == 3000 and got[11]["base_failed"]
    assert got[4]["word_chars"] == 150_000
    assert quality.judged(nothing).count() == 0
    assert quality.filtered(awkward).columns == awkward.columns


def test_quality_keeps_clean_and_rejects_symbols(spark):
    rng = np.random.default_rng(3)
    clean = [(i, " ".join(rng.choice(WORDS, 80)), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in rng.choice(WORDS, 80)), "en", f"s{i % 3}") for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(30))


def test_mixing_awkward(awkward, nothing):
    plan = [r.asDict() for r in mixing.mix_plan(awkward).collect()]
    assert len(plan) == len(AWKWARD)
    assert all(0 <= r["copies"] <= 2 for r in plan)
    again = [r.asDict() for r in mixing.mix_plan(awkward).collect()]
    assert sorted(map(str, plan)) == sorted(map(str, again))
    assert mixing.mix_plan(nothing).count() == 0
    assert mixing.mixed(awkward).columns == awkward.columns


def test_mixing_hits_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "abc"[min(2, int(rng.integers(0, 6)))]) for i in range(3000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, own in plan.groupby("source"):
        assert abs((own["copies"] * own["size"]).sum() - own["target"].iloc[0]) <= 60
        assert own["target"].iloc[0] <= 2 * own["source_size"].iloc[0] + 1e-6


def test_mixing_hits_targets_without_ids(spark):
    """Rows of no id or one id, alike or not: taken to the nearest row."""
    alike = [(None, "w " * 16, "a")] * 100
    unlike = [(7, "w " * int(n), "b") for n in np.random.default_rng(3).integers(1, 30, 500)]
    rows = [*alike, *unlike, *[(None, None, "c")] * 5, *[(k, "x y", "d") for k in range(40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = mixing.mix_plan(df).toPandas()
    assert len(plan) == len(rows)
    for source, own in plan.groupby("source"):
        most = max(len(words(t)) for _, t, x in rows if x == source)
        assert abs((own["copies"] * own["size"]).sum() - own["target"].iloc[0]) <= most, source
        assert own["copies"].max() <= 2
    counts = lambda p: sorted(Counter(zip(p["source"], p["size"], p["copies"], strict=True)).items())
    assert counts(plan) == counts(mixing.mix_plan(df.repartition(3)).toPandas())
    assert mixing.mixed(df).count() == plan["copies"].sum()


def _page_rows(spark):
    html = "<p>" + "é" * 200 + "</p>"
    return spark.createDataFrame([(3, "http://a", html), (1, "http://b\r\n", html), (2, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", ""), (7, "u", "x" * 300_000)], "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    pages = _page_rows(spark)
    done = warc.write_archives(pages, f"file://{tmp_path}").collect()
    assert sum(r["records"] for r in done) == 7
    got = {r["record_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got["<urn:page:1>"]["record_type"] == "response" and got["<urn:page:3>"]["refers_to"] == "<urn:page:1>"
    assert got["<urn:page:3>"]["payload_bytes"] == got["<urn:page:1>"]["payload_bytes"] == 407
    assert got["<urn:page:4>"]["record_type"] == got["<urn:page:5>"]["record_type"] == "response"
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for k in (1, 2, 4, 5, 6, 7):
        assert bytes(got[f"<urn:page:{k}>"]["payload"]) == want[k]


def test_warc_reads_what_counted_attempts_wrote(spark, tmp_path):
    """Archives of attempts that don't count are left alone; ids may be null or repeat."""
    html = "<p>" + "y" * 200
    pages = spark.createDataFrame([(2, "u", html), (2, "v", html), (None, "w", html), (None, "w", "short"), (9, "u", html)], "page_id long, url string, html string")
    done = spark.createDataFrame(warc.write_archives(pages, f"file://{tmp_path}").collect())
    (tmp_path / "part-00000-0000-99999.warc.zst").write_bytes(b"left behind")
    got = sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read_archives(spark, f"file://{tmp_path}", listed=done).collect())
    assert got == sorted([("<urn:page:2>", "response", "None")] * 2 + [("<urn:page:None>", "revisit", "<urn:page:2>"), ("<urn:page:None>", "response", "None"), ("<urn:page:9>", "revisit", "<urn:page:2>")])


def test_warc_frames_and_errors(tmp_path):
    import struct

    import zstandard

    record = warc._page_record({"id": 1, "url": "u", "html": "abc", "digest": "0", "refers_to": None})
    words = b"WARC/1.1 WARC-Type: response Content-Length: " * 20
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress(record)
    for stored in (words, zstandard.compress(words)):
        archive = struct.pack("<II", warc.DICTIONARY_MAGIC, len(stored)) + stored + frame + struct.pack("<II", 0x184D2A50, 3) + b"abc" + frame
        assert [r for _, r in warc.frames(memoryview(archive), "x")] == [record, record]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(memoryview(archive[:-4]), "x"))
    assert warc.parse_record(record, "x")["fields"]["warc-type"] == "response"
    for bad in (record[:-1], record.replace(b"Content-Length: 7", b"Content-Length: 9"), b"HTTP/1.1 200", record.replace(b"WARC-Date", b"WARC-Dote"), record.replace(b"\r\nContent-Length: " + str(len(record)).encode(), b"")[:-5]):
        if bad != record:
            with pytest.raises(ValueError):
                warc.parse_record(bad, "x")


def test_warc_empty(spark, tmp_path):
    path = tmp_path / "none"
    path.mkdir()
    assert warc.write_archives(_page_rows(spark).where("false"), f"file://{path}").count() == 0
    assert warc.read_archives(spark, f"file://{path}").count() == 0


def _fuzz(n=400):
    rng = np.random.default_rng(5)
    letters = list("aabbb eeth  ▁ \n\té漢梦\0😀ẞ<s></s>_.,!0123<unk>ing|endoftext'sİ")
    return ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(n)] + ["a" * 3000, " " * 700, "", " ", "▁", "ab" * 2000, "<|endoftext|>x <|startoftext|>", "the" * 900]


def test_sentencepiece_is_the_library(spark, awkward, nothing):
    import hashlib

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = _fuzz() + list(texts_of().values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_codec.encoded(df, path, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect():
        ids = [1, *library.encode(texts[r["doc_id"]]), 2]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sentencepiece_codec.encoded(awkward, path).count() == len(AWKWARD)
    assert sentencepiece_codec.encoded(nothing, path).count() == 0


def test_sentencepiece_cache_restarts(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_codec, "CACHE", 50)
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    codec.cache.most = 50
    for k in range(0, 300, 30):
        texts = _fuzz(300)[k : k + 30]
        ids, at = codec.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts)


def _thue_morse(n, a, b):
    """Words on which sums of powers modulo powers of two can't tell a word from its complement."""
    word = [0]
    while len(word) < n:
        word += [1 - x for x in word]
    return "".join(b if x else a for x in word), "".join(a if x else b for x in word)


def test_words_that_hash_alike_are_told_apart(monkeypatch):
    import sentencepiece
    from tokenizers import Tokenizer

    from ruleweave.llm import common

    texts = [w for n in range(10, 14) for pair in ("ab", "eq", "x1") for w in _thue_morse(1 << n, *pair)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, words_ = sentencepiece.SentencePieceProcessor(model_file=path), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def check():
        ids, at = sentencepiece_codec.Codec(path).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts)
        counter = token_counts._Counter(public_tokenizers.path("word_bpe_49k.json"))
        data, begin, end, _, hashes = token_counts._words(pa.array(texts))
        assert counter.missing(data, begin, end, hashes).tolist() == [len(words_.encode(t).ids) for t in texts]
        return hashes

    assert len(set(check().tolist())) == len(texts)
    # and even if all hashes are one
    for module in (sentencepiece_codec, token_counts):
        monkeypatch.setattr(module, "hash_spans", lambda data, begin, end: np.zeros(len(begin), np.uint64))
    check()
    data = np.frombuffer(b"abab" * 10, np.uint8)
    at = np.arange(0, 40, 4)
    assert len(set(common.hash_spans(data, at, at + 4).tolist())) == 1 and len(set(common.hash_spans(data, at, at + 3).tolist())) == 1


def test_tokenizers_across_white_space_are_refused():
    with pytest.raises(ValueError, match="white space"):
        token_counts._Counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_are_the_library(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = _fuzz() + list(texts_of().values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most in (token_counts.FREQUENT, 10):
        for r in token_counts.token_counts(df, path, most=most).collect():
            n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)
    assert token_counts.token_counts(awkward, path).count() == len(AWKWARD)
    assert token_counts.token_counts(nothing, path).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.99
    assert got["score"].between(0, 1).all() and got["accepted"].mean() > 0.9


def test_language_awkward(spark, awkward, nothing):
    models = language_id.fit(awkward)
    got = {r["doc_id"]: r for r in language_id.identify(awkward, models).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und"
    assert all(r["lang_pred"] in ("en", "de", "fr", "und") for r in got.values())
    assert language_id.identify(nothing, models).count() == 0
    none = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.identify(awkward, none).collect()} == {"und"}


def test_kneser_ney_is_normalised():
    model = language_id.KneserNey(["aaab", "aaba", "abab", "babb", "aaaa"], np.array([3, 2, 2, 1, 1]), 3)
    letters = [ord("a"), ord("b")]
    for context in ([97, 97, 97], [98, 97, 98], [99, 99, 99], [97, 98, 97]):
        total = 0.0
        for c in [*letters, 0x10FFFF]:
            points = [np.array([c]), *[np.array([x]) for x in reversed(context)]]
            hashes = [language_id._hashes(points[:k]) for k in range(1, 5)]
            contexts = [language_id._hashes(points[1:k]) for k in range(2, 5)]
            total += math.exp(model.score(hashes, contexts)[0])
        assert abs(total - 1) < 1e-5


def test_kneser_ney_is_brute_force():
    """Probabilities of all orders from their definition, whole and with the longest n-grams cut."""
    rng = np.random.default_rng(11)
    grams = Counter("".join(rng.choice(list("abcd"), 4, p=[0.5, 0.25, 0.15, 0.1])) for _ in range(150))
    levels = [dict(grams)]
    for _ in range(3):
        levels.append(dict(Counter(g[1:] for g in levels[-1])))

    def discount(level):
        one, two = (sum(n == k for n in level.values()) for k in (1, 2))
        return min(0.9, max(0.1, one / (one + 2 * two))) if one else 0.5

    def p(text, kept=None):
        """Of the last letter after those before it."""
        level = levels[4 - len(text)] if text else None
        if not text:
            return 1 / 5
        d, context = discount(level), {g: n for g, n in level.items() if g[:-1] == text[:-1]}
        total, below = sum(context.values()), p(text[1:])
        if not context:
            return below
        full = max(level.get(text, 0) - d, 0) / total + d * len(context) / total * below
        if kept is None or len(text) < 4:
            return full
        there = [g for g in context if g in kept]
        rest = (1 - sum(p(g) for g in there)) / (1 - sum(p(g[1:]) for g in there))
        return full if text in kept else rest * below

    names = sorted(grams)
    counts = np.array([grams[g] for g in names])
    kept = {names[k] for k in np.argsort(-counts, kind="stable")[:20]}
    for most, keep in ((10**6, None), (20, kept)):
        model = language_id.KneserNey(names, counts, 5, most)
        for text in ["".join(t) for t in __import__("itertools").product("abcdx", repeat=4)]:
            points = [np.array([ord(c)]) for c in reversed(text)]
            got = math.exp(model.score([language_id._hashes(points[:k]) for k in range(1, 5)], [language_id._hashes(points[1:k]) for k in range(2, 5)])[0])
            assert math.isclose(got, p(text, keep), rel_tol=1e-4), text


def test_language_ties_and_repeats(spark):
    """Equal texts get equal answers, in every place; two languages of the same texts tie, and the first name wins."""
    rows = [(k, "der die das und", "de") for k in range(4)] + [(10 + k, "der die das und", "at") for k in range(4)] + [(20, "the cat and", "en")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.fit(df)
    got = language_id.identify(df.repartition(5), models).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got if r["doc_id"] < 20} == {"at"} and {r["lang_pred"] for r in got if r["doc_id"] == 20} == {"en"}
    assert len({r["score"] for r in got if r["doc_id"] < 20}) == 1


def test_near_dedup_awkward(awkward, nothing):
    got = {r["doc_id"]: r for r in near_dedup.near_groups(awkward, k=2).collect()}
    assert got[6]["component_id"] == got[5]["component_id"] == got[7]["component_id"] == 5
    assert got[9]["component_id"] == 8 and not got[9]["kept"]
    assert got[1]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[2]["component_id"] == 2
    assert near_dedup.near_groups(nothing, k=2).count() == 0
    assert near_dedup.deduplicated(awkward).columns == awkward.columns


def _brute_components(texts, k):
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    pairs = Counter((a, b) for s in by.values() for a in s for b in s if a < b)
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_dedup_chain_of_edits(spark):
    """A long chain of near copies, each linked with its neighbours only, and copies of each."""
    rng = np.random.default_rng(9)
    texts, now = {}, list(rng.choice(WORDS, 200))
    order = rng.permutation(120)
    for k in range(120):
        now = list(now)
        for j in rng.integers(0, 200, 6):
            now[j] = f"n{rng.integers(0, 10**9)}"
        texts[int(order[k])] = " ".join(now)
    texts |= {1000 + i: texts[i] for i in range(0, 120, 7)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, k=k).collect()}
        assert got == _brute_components(texts, k)


def test_near_dedup_loses_no_link(spark):
    """Pairs just over and under the threshold, families of unlike members, and more copies of one text than others."""
    rng = np.random.default_rng(21)
    texts = {}
    for f in range(40):
        base = [f"f{f}w{j}" for j in rng.integers(0, 10**6, 150)]
        for m in range(6):
            own = list(base)
            for j in rng.choice(150, int(rng.integers(5, 22)), replace=False):
                own[j] = f"e{rng.integers(0, 10**9)}"
            texts[f * 100 + m] = " ".join(own)
    texts |= {5000 + k: texts[0] for k in range(300)}
    texts |= {6000 + k: f"a b c {k % 3}" for k in range(9)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(df, k=2).collect()}
    assert got == _brute_components(texts, 2)


def test_near_dedup_deals_a_family_of_unlike_copies_once(spark, monkeypatch):
    """Many documents that share band values and don't link: each goes to one block a side, not to one for every 256 others."""
    rng = np.random.default_rng(33)
    base = [f"b{j}" for j in range(40)]
    texts = {i: " ".join(base + [f"u{x}" for x in rng.integers(0, 10**9, 20)]) for i in range(4000)} | {5000: " ".join(base + [f"v{j}" for j in range(20)]), 5001: " ".join(base + [f"v{j}" for j in range(19)])}
    dealt, plain = [], near_dedup.map_arrow

    def counted(df, function, schema):
        if "more" in schema:
            dealt.append((df.count(), df.select("band", "id").distinct().count()))
        return plain(df, function, schema)

    monkeypatch.setattr(near_dedup, "map_arrow", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=2).collect()}
    assert {i for i, c in got.items() if i != c} == {5001} and got[5001] == 5000
    assert dealt and all(rows <= 2 * own for rows, own in dealt)


def test_near_dedup_goes_on_only_with_components_that_had_more(spark, monkeypatch):
    """Pairs a little too unlike make further rounds; documents that may link with nothing are dealt in the first one only."""
    rng = np.random.default_rng(34)
    base, texts = [f"b{j}" for j in range(150)], {}
    for i in range(20):
        for k in range(8):  # 133 of 167 shingles in common with those of k = 0
            own = base[: 149 - 16 * k] + [f"e{k}x{j}" for j in range(16)] + base[165 - 16 * k : 149] if k else base[:149]
            texts[20 * k + i] = " ".join([*own, f"last{i}"])
    other = [f"c{j}" for j in range(40)]
    texts |= {1000 + i: " ".join(other + [f"u{x}" for x in rng.integers(0, 10**9, 20)]) for i in range(200)}
    dealt, plain = [], near_dedup.map_arrow

    def seen(df, function, schema):
        if "more" in schema:
            dealt.append({r["id"] for r in df.select("id").distinct().collect()})
        return plain(df, function, schema)

    monkeypatch.setattr(near_dedup, "map_arrow", seen)
    monkeypatch.setattr(near_dedup, "TRIES", 1)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=2).collect()}
    assert got == _brute_components(texts, 2)
    assert len(dealt) > 1 and max(dealt[0]) >= 1000 and all(max(ids) < 1000 for ids in dealt[1:])


@pytest.mark.parametrize("few", [0, 10**5])
def test_components_by_either_way(spark, monkeypatch, few):
    rng = np.random.default_rng(few % 7)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(-200, 200, 230), rng.integers(-200, 200, 230), strict=True)] + [(7, 7), (None, 3)]
    calls = []
    module = sys.modules["ruleweave.llm.components"]
    solve = module._joined
    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "_joined", lambda t: calls.append(1) or solve(t))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for a, b in edges if a is not None and a != b for x in (a, b)}
    for _ in least:
        for a, b in edges:
            if a is not None and a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least and bool(calls) == bool(few)


def test_parity_bits_never_rule_a_link_out():
    rng = np.random.default_rng(5)
    for n in (1, 3, 9, 40, 500, 3000):
        for share in (0.5, 0.78, 0.8, 0.82, 1.0):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 2**63, int(n * (1 - share)) + int(rng.integers(0, 3))).astype(np.uint64)])
            if not len(b):
                continue
            x, y = near_dedup.parities(a), near_dedup.parities(b)
            w = min(len(x), len(y))
            differ = int(np.bitwise_count(near_dedup.folded(x, w) ^ near_dedup.folded(y, w)).sum())
            true = len(np.setxor1d(a, b))
            assert differ <= true and differ >= 0.7 * true - 1
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(np.unique(a)) + len(np.unique(b)) - common):
                assert near_dedup.may_link(np.array([differ]), np.array([len(a) + len(b)]))[0]


def test_setsketch_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 900).astype(np.uint64)
    both = np.concatenate([a[:800], b[:100]])
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(np.concatenate([a, b]))).all()
    x, y = near_dedup.registers(a), near_dedup.registers(both)
    got = near_dedup.likely_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([900.0]), np.array([900.0]))[0]
    assert abs(got - 0.8) < 0.15


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 400, 260), rng.integers(0, 400, 260), strict=True)] + [(i, i + 1) for i in range(500, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(spark, awkward, nothing):
    rng = np.random.default_rng(8)
    passage = list(rng.choice(WORDS, 70))
    texts = {i: " ".join([*rng.choice([f"u{j}" for j in range(10**5)], 100), *passage, *rng.choice([f"v{j}" for j in range(10**5)], 100)]) for i in range(10)}
    edited = list(passage)
    edited[20], edited[45] = "zz", "yy"
    texts[20] = " ".join(["q1", *edited, "q2"])
    texts[30] = " ".join(rng.choice([f"c{j}" for j in range(10**5)], 300))
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    hit = {r["doc_id"] for r in got} | {r["partner"] for r in got}
    assert hit == set(range(10)) | {20}
    for r in got:
        if r["doc_id"] < 10:
            assert (r["first_word"], r["end_word"]) == (100, 170)
    awk = substring_dedup.repeated_passages(awkward).collect()
    assert {(r["doc_id"], r["partner"]) for r in awk} >= {(6, 5), (7, 5)}
    assert substring_dedup.repeated_passages(nothing).count() == 0


def test_repeated_passages_brute_force(spark):
    texts = {i: words(lower(t)) for i, t in texts_of("/root/testdata/sf0.01").items()}
    grams = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            grams[tuple(w[j : j + 50])].add(i)
    got = substring_dedup.op7_substring_dedup(spark, "/root/testdata/sf0.01").collect()
    hit = {r["doc_id"] for r in got} | {r["partner_id"] for r in got}
    assert {i for s in grams.values() if len(s) > 1 for i in s} <= hit
    for r in got:  # what is reported is alike
        a, b = texts[r["doc_id"]][r["first_word"] : r["end_word"]], texts[r["partner_id"]][r["partner_first_word"] : r["partner_end_word"]]
        assert len(set(a) & set(b)) >= 0.6 * len(set(a))


def test_repeated_passages_despite_holders_of_parts(spark):
    """B and C share a passage whose seeds all have earlier holders, of too few words each."""
    p = [f"p{j}" for j in range(80)]
    around = lambda n, w: [f"{n}a{j}" for j in range(30)] + w + [f"{n}z{j}" for j in range(30)]
    texts = {1: around("k", p[:46]), 2: around("l", p[38:]), 3: around("m", p), 4: around("n", p), 5: around("o", p[:50]), 6: p[29:79]}
    df = spark.createDataFrame([(i, " ".join(texts[i])) for i in [*texts, 4]], "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in substring_dedup.repeated_passages(df).select("doc_id", "partner", "first_word", "end_word", "partner_first_word", "partner_end_word", "equal_words").collect()}
    assert {(4, 3, 30, 110, 30, 110, 80), (5, 3, 30, 80, 30, 80, 50), (6, 3, 0, 50, 59, 109, 50)} <= got


def test_repeated_passages_next_to_each_other(spark):
    """Two edited passages with other words between them, which are too unlike as one."""
    p, q = [f"p{j}" for j in range(60)], [f"q{j}" for j in range(60)]
    one = [f"a{j}" for j in range(30)] + p + [f"b{j}" for j in range(38)] + q + [f"c{j}" for j in range(30)]
    two = [f"d{j}" for j in range(30)] + p + [f"e{j}" for j in range(38)] + q + [f"f{j}" for j in range(30)]
    for j in (50, 70, 148, 168):
        two[j] = "zz"
    got = substring_dedup.repeated_passages(spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["partner"], r["first_word"], r["end_word"]) for r in got.collect()) == [(2, 1, 30, 90), (2, 1, 128, 188)]


@pytest.mark.parametrize("rate,least", [(0.03, 0.98), (0.05, 0.95), (0.08, 0.9)])
def test_repeated_passages_with_edits(spark, rate, least):
    """Of 60 passages of 60 to 120 words with edited words, nearly all are found, whole."""
    rng = np.random.default_rng(int(rate * 100))
    texts = {}
    for k in range(60):
        n = int(rng.integers(60, 121))
        own = [f"p{k}w{j}" for j in range(n)]
        other = list(own)
        for j in sorted(rng.choice(n, max(1, int(rate * n)), replace=False).tolist(), reverse=True):
            kind = int(rng.integers(0, 3))
            if kind == 0:
                other[j] = f"z{rng.integers(0, 10**9)}"
            elif kind == 1:
                del other[j]
            else:
                other.insert(j, f"z{rng.integers(0, 10**9)}")
        around = lambda: [f"r{x}" for x in rng.integers(0, 10**9, 80)]
        texts[k], texts[1000 + k] = " ".join(around() + own + around()), " ".join(around() + other + around())
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["partner"] + 1000 for r in found)
    assert len({r["doc_id"] for r in found if r["end_word"] - r["first_word"] >= 50}) >= least * 60


def test_repeated_passages_twice_in_a_text_and_in_quotes(spark):
    """A passage at two places of a text, exact and edited; quotes of parts by others before; ties; a long text."""
    p = [f"p{j}" for j in range(80)]
    filler = lambda n, m: [f"{n}x{j}" for j in range(m)]
    edited = list(p)
    edited[15], edited[40], edited[66] = "y1", "y2", "y3"
    texts = {k: filler(f"q{k}", 20) + p[a : a + 40] + filler(f"r{k}", 20) for k, a in enumerate((0, 20, 40))}
    texts[10] = filler("a", 30) + p + filler("b", 30)
    texts[11] = filler("c", 30) + p + filler("d", 40) + p + filler("e", 10)
    texts[12] = filler("f", 20) + p + filler("g", 20)
    texts[13] = filler("h", 20000) + p
    q = [f"q{j}" for j in range(80)]
    texts[20], texts[21] = filler("i", 30) + q + filler("j", 30), filler("k", 30) + [w.replace("p", "q") for w in edited] + filler("l", 60) + [w.replace("p", "q") for w in edited] + filler("m", 30)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["partner"], r["first_word"], r["end_word"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert {(11, 10, 30, 110), (11, 10, 150, 230), (12, 10, 20, 100), (13, 10, 20000, 20080), (21, 20, 30, 110), (21, 20, 170, 250)} <= got
    assert not {d for d, *_ in got} & {0, 1, 2, 10, 20}


@pytest.mark.parametrize("partitions", [1, 3, 7, 40])
def test_elections_across_partitions(spark, partitions):
    """Each occurrence meets the first of its hash, however few hashes there are for the partitions."""
    rng = np.random.default_rng(partitions)
    rows = [(int(h), int(i), int(p)) for h, i, p in zip(rng.choice([1, 2, 2, 2, 2, 2, 2, 3, *range(10, 60)], 900), rng.integers(0, 300, 900), range(900), strict=True)]
    rows += [(5, 77, p) for p in range(400)] + [(6, 78, p) for p in range(3)]
    by_hash = defaultdict(list)
    for h, i, p in rows:
        by_hash[h].append((i, p))
    want = [(h, min(own)[0], i, min(own)[1], p) for h, own in by_hash.items() if len({i for i, _ in own}) > 1 for i, p in own]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = substring_dedup.elected(spark.createDataFrame(rows, "h long, id long, pos int").repartition(5), "bigint", "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, got)) == sorted(want)


def test_chains_prefer_collinear_matches():
    a, b = [0, 10, 20, 500, 30], [5, 15, 25, 30, 35]
    assert substring_dedup.chains(a, b)[0] == [0, 1, 2, 4]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 100), (1000, 10**6), (5000, 6000), (3000, 2**45), (100, 3)):
        v = np.sort(rng.integers(0, u, n))
        e = EliasFano(EliasFano.pack(v, u))
        assert (e.access(np.arange(n)) == v).all()
        v = np.unique(v)
        e = EliasFano(EliasFano.pack(v, u))
        q = np.concatenate([v, rng.integers(0, u, 500)])
        place = {x: i for i, x in enumerate(v.tolist())}
        found = e.find(q, np.zeros(len(q), np.int64), np.full(len(q), len(v)))
        assert found.tolist() == [place.get(x, -1) for x in q.tolist()]


def test_codebooks_keep_values_within_a_cell():
    rng = np.random.default_rng(2)
    for values in (np.concatenate([np.full(10**5, 0.25), 10 ** rng.uniform(-9, 0, 1000)]), np.full(50, 0.3), 10 ** rng.uniform(-3, 0, 10)):
        codes, book = ngram_lm._coded(values)
        assert np.abs(np.log10(book[codes]) - np.log10(values)).max() <= np.ptp(np.log10(values)) / ngram_lm.BOOK + 1e-12


@pytest.mark.parametrize("shard_tokens", [10**9, 20_000, 3_000])
def test_ngram_model_is_brute_force(spark, shard_tokens):
    tokens = {k: words(lower(t)) for k, t in texts_of().items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    one, two, three = Counter(), Counter(), Counter()
    for k, w in tokens.items():
        if not held[k]:
            s = ["<e>", *w, "<e>"]
            one.update(s[1:])
            two.update(zip(s, s[1:], strict=False))
            three.update(zip(s, s[1:], s[2:], strict=False))
    total, kinds = sum(one.values()), len(one)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = ngram_lm.learn(docs.where("crc32(cast(doc_id as string)) % 5 <> 1"), shard_tokens=shard_tokens)
    assert (model.total, model.words) == (total, kinds)
    after, after2 = Counter(a for a, _ in two), Counter((a, b) for a, b, _ in three)

    def discount(c):
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.95, max(0.05, n1 / (n1 + 2 * n2)))

    d2, d3 = discount(two), discount(three)
    p1 = lambda c: (one[c] + 0.5) / (total + 0.5 * (kinds + 1))
    p2 = lambda b, c: p1(c) if not one[b] else max(two[b, c] - d2, 0) / one[b] + d2 * after[b] / one[b] * p1(c)
    p3 = lambda a, b, c: p2(b, c) if not two[a, b] else max(three[a, b, c] - d3, 0) / two[a, b] + d3 * after2[a, b] / two[a, b] * p2(b, c)
    gain = 0.0
    for r in ngram_lm.scored(docs, model).collect():
        s = ["<e>", *tokens[r["doc_id"]], "<e>"]
        base = sum(math.log10(p1(t)) for t in s[1:])
        assert r["n_tokens"] == len(s) - 1 and r["n_known"] == sum(one[t] > 0 for t in s[1:])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        want = math.log10(p2("<e>", s[1])) + sum(math.log10(p3(*s[i - 2 : i + 1])) for i in range(2, len(s)))
        assert abs(r["score"] - want) < 0.002 * len(s)
        gain += (r["score"] - base) * held[r["doc_id"]]
    assert gain > 0


def test_ngram_model_awkward(awkward, nothing):
    model = ngram_lm.learn(awkward)
    got = {r["doc_id"]: r for r in ngram_lm.scored(awkward, model).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == got[3]["n_tokens"] == 1
    assert got[11]["n_tokens"] == 3001
    assert ngram_lm.scored(nothing, model).count() == 0
    empty = ngram_lm.learn(nothing)
    assert empty.total == 0 and all(math.isfinite(r["score"]) for r in ngram_lm.scored(awkward, empty).collect())


def test_pages_extra_columns(spark, tmp_path):
    pages = pd.DataFrame({"page_id": [1], "url": ["u"], "html": ["h"], "digest": ["clash"], "id": [5], "refers_to": [9]})
    done = warc.write_archives(spark.createDataFrame(pages), f"file://{tmp_path}").collect()
    assert done[0]["records"] == 1


def test_repeated_passages_with_edits_despite_holders_of_parts(spark):
    """Later documents share an edited passage whose seeds all have earlier holders, without the passage; no run of 50 words is whole."""
    p = [f"p{j}" for j in range(90)]
    around = lambda n, w: [f"{n}a{j}" for j in range(30)] + w + [f"{n}z{j}" for j in range(30)]
    edited = lambda n, at: [f"{n}e{j}" if j in at else w for j, w in enumerate(p)]
    texts = {k: around(f"k{k}", p[b : b + 24]) for k, b in enumerate(range(0, 80, 10))}
    texts |= {20: around("m", p), 21: around("n", edited("n", (22, 44, 66))), 22: around("o", edited("o", (15, 35, 55, 75)))}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["partner"]) for r in substring_dedup.repeated_passages(df).collect() if r["end_word"] - r["first_word"] >= 80}
    assert {(21, 20), (22, 20)} <= got
    assert {d for d, _ in got} == {21, 22}


def test_words_around_that_can_be_a_passage():
    """The filter keeps whatever 50 words around a seed align to 40 equal ones, and drops a common line between other words."""
    rng = np.random.default_rng(3)
    side, k = substring_dedup.LEAST - substring_dedup.K, substring_dedup.K
    for _ in range(50):
        x = rng.integers(2, 65_535, 2 * side + k).astype(np.uint16)
        y = rng.integers(2, 65_535, 2 * side + k).astype(np.uint16)
        begin = int(rng.integers(0, side + 1))  # 50 words from here hold the seed
        y[begin : begin + 50] = x[begin : begin + 50]
        edits = rng.choice([j for j in range(begin, begin + 50) if not side <= j < side + k], 10, replace=False)
        y[edits] = 1
        assert substring_dedup.alike_around(x[None], y[None])[0]
        y[begin + 30 : begin + 50] = 1
        y[begin : max(begin, begin + 12)] = 1
        assert not substring_dedup.alike_around(x[None], y[None])[0]


def test_words_in_common_bound_alignments():
    """A product of the filter's matrices counts what two rows have in common, as often as both have it, and never less."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 30, (40, 94)).astype(np.uint32)
    codes[:20, 10:] = 7
    counts, has = substring_dedup.counted(codes)
    got, exact = counts @ has.T, 0
    for a in range(40):
        for b in range(40):
            both = (Counter(codes[a][codes[a] > 0].tolist()) & Counter(codes[b][codes[b] > 0].tolist())).total()
            assert both <= got[a, b]
            exact += got[a, b] <= both + 12
    assert exact > 1_400


def open_seed(around, before, ask=True):
    """A block of occurrences of one seed, each in a document of its own."""
    n = len(around)
    columns = {"h": [1] * n, "mine": [0] * n, "theirs": [0] * n, "side": [0] * n, "id": list(range(n)), "pos": [100] * n, "class": list(range(n)), "now": list(range(n))}
    columns |= {"around": [x.tobytes() for x in around], "before": before, "ask": [ask] * n if isinstance(ask, bool) else ask}
    return pa.RecordBatch.from_pydict(columns)


def test_open_seeds_stop_at_enough_partners_and_go_on_for_the_rest(monkeypatch):
    """Places alike in many documents are aligned up to the number that counts, and only those that had more are asked for again."""
    aligned, real = [], substring_dedup.alike_around
    monkeypatch.setattr(substring_dedup, "alike_around", lambda one, two: aligned.append(len(one)) or real(one, two))
    around = np.tile(np.random.default_rng(5).integers(2, 65_535, 94).astype(np.uint16), (300, 1))
    block = open_seed(around, [0] * 300)
    first = pa.Table.from_batches(substring_dedup._alike(4)(iter([block]))).to_pylist()
    assert sum(aligned) <= 40 * 300  # of 44,850 pairs
    assert {(r["a"], r["b"]) for r in first} == {(a, b) for b in range(300) for a in range(min(4, b))}
    assert {r["b"] for r in first if r["more"]} == set(range(5, 300)) and all(r["later"] for r in first)
    again = pa.Table.from_batches(substring_dedup._alike(400)(iter([open_seed(around, [0] * 300, [k == 299 for k in range(300)])]))).to_pylist()
    assert {(r["a"], r["b"]) for r in again} == {(a, 299) for a in range(299)} and not any(r["more"] for r in again)
    # those that go on from an equal seed before meet only others
    aligned.clear()
    got = pa.Table.from_batches(substring_dedup._alike(400)(iter([open_seed(around, [5] * 200 + [6] * 99 + [0])]))).to_pylist()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in range(200) for b in range(200, 299)} | {(a, 299) for a in range(299)}


def test_repeated_passages_join_in_rounds(spark, monkeypatch):
    """With few partners a round, documents that share a passage whose first holder has other words around its seeds are still joined."""
    rng = np.random.default_rng(6)
    run = ["the"] * 46
    texts = {i: [f"a{x}" for x in rng.integers(0, 10**9, 20)] + run[: 26 + i] + [f"b{x}" for x in rng.integers(0, 10**9, 20)] for i in range(14)}
    p = [f"p{j}" for j in range(12)]
    for i in range(14, 26):
        own = run + p
        own[int(rng.integers(8, 40))] = f"z{i}"
        texts[i] = [f"c{x}" for x in rng.integers(0, 10**9, 20)] + own + [f"d{x}" for x in rng.integers(0, 10**9, 20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)

    def joined():
        up = {i: i for i in texts}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in substring_dedup.repeated_passages(df).collect():
            up[root(r["doc_id"])] = root(r["partner"])
        return [{j for j in texts if root(j) == root(i)} for i in range(14, 26)]

    whole = joined()
    monkeypatch.setattr(substring_dedup, "TRIES", 1)
    assert joined() == whole and all(x >= set(range(14, 26)) for x in whole)
