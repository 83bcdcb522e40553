"""The queries' columns, and the pipeline against its stages' decisions made plainly, one document at a time."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from logloom.llm import langid, quality
from logloom.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_": "doc_id size text_crc32 law shard slot grown_shard", "op2_": "page_id payload_bytes payload_digest record_type refers_to", "op3_": "doc_id keep_id group_size kept text_sha256",
    "op4_": "doc_id n_shingles component_id kept", "op5_": "doc_id piece start length ids_crc32 sequence_id offset", "op6_": "doc_id held_out score predicted", "op7_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_": "doc_id held_out lang_pred score", "op9_": "doc_id held_out score predicted", "op10_": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


def test_names():
    found = __spark_entry__.queries()
    assert {*QUERIES, "pipeline"} <= found.keys() and len(QUERIES) == 10 and ORACLE.keys() <= QUERIES.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "exact_dedup", "near_dedup", "packing"]


@pytest.mark.parametrize("prefix", COLUMNS)
def test_columns(spark, small, prefix):
    name = next(n for n in QUERIES if n.startswith(prefix))
    out = QUERIES[name](spark, small)
    assert out.columns[: len(COLUMNS[prefix].split())] == COLUMNS[prefix].split() or {*COLUMNS[prefix].split()} <= {*out.columns}
    source = spark.read.parquet(f"{small}/{'pages' if prefix == 'op2_' else 'documents'}.parquet")
    assert out.count() >= source.count()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    models = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = {i: t for i, t in docs.items() if not models.predict([t or ""])[0][2]}
    stage = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    judge = quality.train(stage, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {i: t for i, t in kept.items() if np.round(judge.score([(t or "").encode()])[0], 6) >= 0.3}
    last = {}
    for i, t in kept.items():
        last[t or ""] = max(i, last.get(t or "", i))
    kept = {i: t for t, i in last.items()}
    sets = {}
    for i, t in kept.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(kept)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in kept.items():
        x = np.array([*word.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(x), 2048):
            want[i, k // 2048, zlib.crc32(x[k : k + 2048].tobytes())] += 1
    rows = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == want


def test_stages_on_edges(spark, edges, nothing, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edges, small)
        assert name == "packing" or {*out.columns} == {*edges.columns}
        n = out.count()
        # the first two stages keep or drop by the text alone, language ID without letters none; the next two have exact tests below
        every = edges.count()
        assert {"language_id": 0 < n < every, "quality": 0 < n <= every, "exact_dedup": n == 9, "near_dedup": n == 10, "packing": n >= every}[name], (name, n)
        assert stage(spark, nothing, small).count() == 0
        if name in ("language_id", "quality"):
            texts = [r["text"] for r in out.collect()]
            assert all(texts.count(t) in (0, n) for t, n in Counter(r["text"] for r in edges.collect()).items())
            assert name == "quality" or all(any(c.isalpha() for c in t or "") for t in texts)


def test_rows_that_stay(spark, edges, small):
    stages = dict(corpus_pipeline.STAGES)
    stay = lambda name, docs: Counter((r["doc_id"], r["text"]) for r in stages[name](spark, docs, small).collect())
    every = {(r["doc_id"], r["text"]) for r in edges.collect()}
    # the empty text of 2 equals the null one of 1; the row without an id stays; of 6's repeated rows one does
    assert stay("exact_dedup", edges) == Counter((i, t) for i, t in every if i not in (1, 5, 7))
    assert stay("near_dedup", edges) == Counter((i, t) for i, t in every if i not in (6, 8))
    # one id on several texts, and no id on several texts: each row has its own decision
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (1, b), (None, b), (None, c), (2, d + " end"), (1, d), (None, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stay("exact_dedup", docs) == Counter([(2, a), (1, b), (None, c), (2, d + " end"), (1, d)])
    assert stay("near_dedup", docs) == Counter([(1, a), (1, b), (None, c), (1, d)])
    # rows repeated with and without an id
    rows = [(5, a)] * 3 + [(None, b)] * 3 + [(None, c), (7, c)] + [(None, None)] * 2 + [(None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((i, t or "") for i, t in stay("exact_dedup", docs).elements()) == Counter([(5, a), (None, b), (7, c), (None, "")])
    assert Counter((i, t or "") for i, t in stay("near_dedup", docs).elements()) == Counter([(5, a), (None, b), (7, c), (None, "")])
    assert None in {r["doc_id"] for r in stages["packing"](spark, docs, small).collect()}


@pytest.mark.parametrize("name", ["language_id", "quality", "near_dedup", "packing"])
def test_stages_pass_small_batches(spark, small, name):
    """Batches that pass to Python are bounded in bytes by each stage that has any; a smaller bound stays."""
    from logloom.llm import common

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    try:
        stage(spark, docs, small)
        assert int(spark.conf.get(key).rstrip("b")) == common.BATCH_BYTES
        spark.conf.set(key, "1000")
        stage(spark, docs, small)
        assert int(spark.conf.get(key).rstrip("b")) == 1000
    finally:
        spark.conf.unset(key)
