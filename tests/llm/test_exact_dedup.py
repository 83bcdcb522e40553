import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import exact_dedup as dedup
from logloom.llm.exact_dedup import DigestIndex, exact_dedup


def _expected(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return Counter((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).digest()) for i, t in rows)


def _got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in df.collect())


@pytest.mark.parametrize(("keep", "pick"), [("largest", max), ("smallest", min)])
def test_edges(spark, edges, nothing, keep, pick):
    assert _got(exact_dedup(edges, keep=keep)) == _expected([(r["doc_id"], r["text"]) for r in edges.collect()], pick)
    assert exact_dedup(nothing, keep=keep).count() == 0


def test_real(spark, documents):
    assert _got(exact_dedup(documents)) == _expected([(r["doc_id"], r["text"]) for r in documents.collect()], max)


def test_colliding_digests_are_told_apart_by_bytes(spark, documents):
    weak = lambda t: F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 1)
    strip = lambda c: Counter({k[:4]: n for k, n in c.items()})
    want = _expected([(r["doc_id"], r["text"]) for r in documents.collect()], max)
    assert strip(_got(exact_dedup(documents, digest=weak))) == strip(want)


def test_wrong_keep(documents):
    with pytest.raises(ValueError):
        exact_dedup(documents, keep="first")


def test_runs_levels_and_lookups(spark):
    def batch(ids):
        return spark.createDataFrame([(hashlib.sha256(str(i % 50).encode()).digest(), i) for i in ids], "digest binary, doc_id long")

    index = DigestIndex(spark, fanout=3)
    all_ids = []
    for k in range(7):
        ids = range(k * 20, k * 20 + 20)
        all_ids += ids
        index.flush(batch(ids).coalesce(1))
        assert [len(x) for x in index.levels] == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2], [1, 2]][k]
        want = defaultdict(list)
        for i in all_ids:
            want[hashlib.sha256(str(i % 50).encode()).digest()].append(i)
        # some digests that were never flushed, and all that were
        asked = spark.createDataFrame([(d,) for d in want] + [(hashlib.sha256(b"no%d" % i).digest(),) for i in range(30)], "digest binary")
        got = {bytes(r["digest"]): (r["smallest"], r["largest"], r["n"]) for r in index.lookup(asked).collect()}
        assert got == {d: (min(x), max(x), len(x)) for d, x in want.items()}
    index.compact(whole=True)
    assert [len(x) for x in index.levels][-1] == 1 and index.entries().count() == 50
    assert DigestIndex(spark).lookup(batch([1])).count() == 0


def test_one_flush_of_several_runs(spark):
    index = DigestIndex(spark, fanout=5)
    rows = spark.range(0, 400, numPartitions=8).select(F.unhex(F.sha2((F.col("id") % 100).cast("string").cast("binary"), 256)).alias("digest"), F.col("id").alias("doc_id"))
    assert index.flush(rows, runs=4).count() == 400 and len(index.levels[0]) == 4
    assert index.lookup(rows.select("digest").distinct()).where("n = 4 and largest - smallest = 300").count() == 100


def test_without_a_filter(spark, documents, monkeypatch):
    monkeypatch.setattr(dedup, "MOST_KEYS", 0)
    assert _got(exact_dedup(documents)) == _expected([(r["doc_id"], r["text"]) for r in documents.collect()], max)
