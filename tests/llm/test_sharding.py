import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from logloom.llm import sharding
from logloom.llm.sharding import assign_shards, feistel, permuted, write_shards


def _hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed=h)
    return h - 2**64 if h >= 2**63 else h


def _step(x, side, keys):
    left, right = x // side, x % side
    for k in keys:
        left, right = right, (left + _hash(k, right) % side) % side
    return left * side + right


def test_feistel_against_python(spark):
    keys = [7 * 1_000_003 + i for i in range(4)]
    got = [r[0] for r in spark.range(400).select(feistel(F.col("id"), 20, keys).alias("p")).collect()]
    assert got == [_step(x, 20, keys) for x in range(400)]


def test_permutation_of_every_size(spark):
    for n in (1, 2, 3, 5, 10, 17, 101, 1000):
        side = max(1, math.isqrt(n - 1) + 1)
        keys = [3 * 1_000_003 + i for i in range(4)]
        want = []
        for x in range(n):
            x = _step(x, side, keys)
            while x >= n:
                x = _step(x, side, keys)
            want.append(x)
        got = [r[0] for r in permuted(spark.range(n), "id", n, 3, "p").orderBy("id").select("p").collect()]
        assert got == want and sorted(got) == list(range(n))


def _check(rows, docs, shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and max(counts.values(), default=0) - min([counts.get(s, 0) for s in range(shards)]) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)


def test_edges(spark, edges, nothing):
    _check(assign_shards(edges, 4).collect(), [(r["doc_id"], r["text"]) for r in edges.collect()], 4)
    assert assign_shards(nothing, 4).count() == 0


def test_reproducible_whatever_the_layout(spark, documents):
    pick = lambda d: sorted(map(tuple, assign_shards(d).collect()))
    a = pick(documents)
    assert a == pick(documents.repartition(7).orderBy(F.rand())) and a != sorted(map(tuple, assign_shards(documents, seed=8).collect()))
    _check(assign_shards(documents).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()], 40)


def test_written_shards(spark, edges, tmp_path):
    out = write_shards(edges, f"file://{tmp_path}/s", 3)
    assert out.count() == edges.count() and set(out.columns) == {*edges.columns}
    want = Counter((r["doc_id"], r["shard"], r["slot"]) for r in assign_shards(edges, 3).collect())
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out.collect()) == want


def test_very_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 7)
    docs = spark.createDataFrame([(None, "same")] * 40 + [(1, "a")] * 15 + [(i, "x") for i in range(30)], "doc_id long, text string")
    rows = assign_shards(docs, 6).collect()
    assert sorted(r["position"] for r in rows) == list(range(85)) and sum(r["doc_id"] is None for r in rows) == 40
