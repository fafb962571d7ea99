"""The pipeline against a brute-force version of its stages."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from ruleweave.llm import exact_dedup, mixing, quality

from .test_operators import AWKWARD, SCHEMA, _brute_components

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline_is_brute_force(spark):
    import sentencepiece

    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
    keep = lambda ids: con.execute(f"DELETE FROM documents WHERE doc_id NOT IN ({', '.join(map(str, ids)) or 'NULL'})")
    keep([r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.OP2_SQL}) WHERE kept").fetchall()])
    keep([r[0] for r in con.execute(f"SELECT doc_id FROM ({exact_dedup.OP4_SQL}) WHERE kept").fetchall()])
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    keep([k for k, c in _brute_components(texts, 5).items() if k == c])
    copies = dict(con.execute(f"SELECT doc_id, copies FROM ({mixing.OP8_SQL})").fetchall())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for k, n in copies.items():
        ids = [1, *library.encode(texts[k]), 2]
        want += [(k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * n
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and got


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (AWKWARD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            docs = spark.createDataFrame(docs.collect(), SCHEMA)
        pipeline.STAGES[-1][1](spark, docs, SF).collect()
