"""Registered queries and the pipeline over the small tables."""

from __future__ import annotations

import hashlib
import pathlib
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from followgraph.llm import bpe, decontaminate, pii, quality, queries, secrets
from followgraph.llm.scratch import stored
from test_minhash import brute
from test_scans import base_pii, base_secrets

duckdb = pytest.importorskip("duckdb")
P = pytest.importorskip("public_tokenizers")

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_all_are_registered():
    names = contract.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(cursor.fetchall())


def test_scan_queries_match_patterns(spark, texts):
    for name, module, base in (("op2_secrets", secrets, base_secrets), ("op6_pii", pii, base_pii)):
        got = queries.queries()[name](spark, FOLDER).collect()
        assert sorted(r.doc_id for r in got) == sorted(texts)
        for r in got:
            want = base(texts[r.doc_id])
            assert [r[f"n_{k}"] for k in module.BASE] == [sum(s[0] == k for s in want) for k in module.BASE]
            text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            mine = [x for x in r.spans.split(",") if x.split(":")[0] in module.BASE]
            assert ",".join(mine) == text


def test_token_queries_match_libraries(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("tokenizers")
    ranks = bpe.Vocabulary.read(P.path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op4_bpe(spark, FOLDER).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    model = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start = 0
    for r in queries.op8_token_file(spark, FOLDER).orderBy("doc_id").collect():
        ids = [*model.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        n = len(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, n, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_pipeline_stage_by_stage(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_dedup", "decontaminate", "secrets", "bpe"]
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, FOLDER))
        got[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe" or docs.columns == columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    all_docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = quality.scored(all_docs, quality.train(all_docs, labels)).collect()
    assert set(got["quality"]) == {r.doc_id for r in scored if r.predicted}
    component = brute([(i, texts[i]) for i in got["quality"]])
    assert set(got["near_dedup"]) == {i for i, c in component.items() if i == c}
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = all_docs.where(all_docs.doc_id.isin(sorted(got["near_dedup"])))
    bad = {r.doc_id for r in decontaminate.contamination(kept, items).collect()}
    assert bad and set(got["decontaminate"]) == set(got["near_dedup"]) - bad
    assert set(got["secrets"]) == set(got["bpe"]) == set(got["decontaminate"])
    for i, r in got["secrets"].items():
        assert base_secrets(r.text) == [] and r.n_chars == len(r.text)
        assert secrets.PLACEHOLDER in r.text or r.text == texts[i]
        assert got["bpe"][i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {i: r.ids_sha256 for i, r in got["bpe"].items()}


HARD = [
    (1, "A b c d e f g " * 40, "en", "s", 560), (1, "A b c d e f g " * 40, "en", "s", 560), (None, "x", None, None, None),
    (2, None, None, "s", None), (3, "", "de", None, 0), (4, "w" * 300_000, "en", "s", 1), (None, None, None, None, None),
]


@pytest.mark.parametrize("rows", [HARD, []], ids=["hard", "empty"])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, bucket string"
    docs = spark.createDataFrame([(*r, 7, "b") for r in rows], schema)
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, folder))
        assert name == "bpe" or docs.columns == before
    # Of the two equal rows one is left; all others are kept.
    assert docs.count() == max(0, len(rows) - 1)
