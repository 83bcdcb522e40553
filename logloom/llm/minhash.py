"""Near-duplicate groups by min-max hashing: banded signatures, links confirmed on whole shingle sets, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, filter_bits, lean, membership_filter, mix64, probe, staged, tidy, word_hashes

#: Words of a shingle, and the least similarity in per cent.
WORDS, PERCENT = 5, 75
#: Bands of so many rows: a pair of similarity 0.75 shares no band with probability (1 - 0.75**6)**64 = 4e-6; one of 0.16 shares some with 0.001.
BANDS, ROWS = 64, 6
#: Shingles that are permuted at once.
BLOCK = 4096
#: While buckets with several components hold more than so many pairs a row, up to so many turns link each bucket's members to another pivot first.
PAIRS_A_ROW, TURNS = 12, 2
#: Bits of the bitmap of a set that bounds what two sets share.
BITS = 1024


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit shingle hashes; a text of fewer words is one shingle, one without words none."""
    h, first = word_hashes(texts)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for i in range(words):
        s = mix64(s * np.uint64(0x9FB21C651E98DF25) + h[i : i + n] + np.uint64(i + 1))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(s[a : b - words + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = mix64(short * np.uint64(0xA0761D6478BD642F) + h[i : i + 1])
            yield short
        else:
            yield s[:0]


class MinMax:
    """Signatures: the least and the greatest value of a set under each of bands * rows / 2 permutations (32-bit multiply-add)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        if bands * rows % 2:
            raise ValueError("bands * rows must be even")
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows // 2, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows // 2, np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minima, then the maxima, 32 bits each, of a set that isn't empty."""
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for i in range(0, len(h), BLOCK):
            x = np.multiply.outer(self.a, h[i : i + BLOCK])
            x += self.b[:, None]
            lo, hi = x.min(axis=1), x.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.concatenate((low, high))

    def bands_of(self, signatures: np.ndarray) -> np.ndarray:
        """64-bit keys, a row of ``bands`` for each signature. A band takes minima and maxima of different permutations."""
        half = signatures.shape[1] // 2
        spread = np.concatenate((signatures[:, :half], np.roll(signatures[:, half:], 1, axis=1)), axis=1).reshape(-1, self.rows, self.bands).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (len(spread), self.bands)).copy()
        for t in range(self.rows):
            key = mix64(key * np.uint64(0x9FB21C651E98DF25) + spread[:, t, :])
        return key


def signatures(docs: DataFrame, id_col: str, text_col: str, hasher: MinMax, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, node, bands, then the columns of carry as _c0 and so on): node is a 128-bit digest of the set, null for an empty one."""
    carried = [f"_c{i}" for i in range(len(carry))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                sets = list(shingle_sets(part.column(1).to_pylist()))
                full = [x for x in sets if len(x)]
                keys = hasher.bands_of(np.stack([hasher.signature(x) for x in full])).view(np.int64) if full else np.zeros((0, hasher.bands), np.int64)
                has = np.fromiter((len(x) > 0 for x in sets), bool, len(sets))
                ends = np.concatenate(([0], np.cumsum(has * hasher.bands))).astype(np.int32)
                node = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())), *part.columns[2:]], names=["doc_id", "n_shingles", "node", "bands", *carried])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean(sign), "doc_id long, n_shingles long, node binary, bands array<long>" + "".join(f", {n} {kinds[n]}" for n in carried))


def sets_of(rows: DataFrame) -> DataFrame:
    """rows: (_text binary). (node, shingles, bits) of the rows' sets that aren't empty; bits marks the shingles modulo BITS."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", 1 << 20):
                sets = [x for x in shingle_sets(part.column(0).to_pylist()) if len(x)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array([bitmap(x) for x in sets], pa.list_(pa.int64()))], names=["node", "shingles", "bits"])

    return rows.select("_text").mapInArrow(lean(build), "node binary, shingles array<long>, bits array<long>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit integers, then how many more shingles than marked bits there are."""
    marks = np.zeros(BITS, np.uint8)
    marks[(shingles % np.uint64(BITS)).astype(np.int64)] = 1
    return np.append(np.packbits(marks, bitorder="little").view(np.int64), len(shingles) - int(marks.sum()))


def possible(n: str, bits: str, m: str, other: str, percent: int = PERCENT) -> Column:
    """Whether sets of n and m shingles with these bitmaps can be similar enough.

    A bit that the other set lacks stands for a shingle at least that it lacks, so two sets share at most the common bits and the
    shingles beyond the bits of either: no link is lost. (One short expression: it is compiled into the join.)
    """
    both = reduce(add, [F.bit_count(F.col(bits)[i].bitwiseAND(F.col(other)[i])) for i in range(BITS // 64)])
    need = F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent)) - F.least(F.col(bits)[BITS // 64], F.col(other)[BITS // 64])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (both >= need)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb")), "b")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    return pairs.withColumn("_n", shared).where(100 * F.col("_n") >= percent * (F.size("_sa") + F.size("_sb") - F.col("_n"))).select("a", "b")


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the least node of its component."""
    roles = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the least node of the component; by alternating large and small stars.

    Each round is written to the shared folder. Minima are taken before a shuffle, and joins on a hub can be split, so that no
    node's neighbours have to meet in one task.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        e = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        del both, least, large, small
        tidy(edges.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, seed: int = 11, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept), then the row's own columns of ``carry``.

    1. Signatures; rows with equal sets form a class, and only classes go on. 2. In every band bucket each class is paired with the
    bucket's least class, and the pairs are confirmed on whole sets: links in a group of similar texts grow with the group, not
    with its square. 3. While large buckets hold several components, their members are paired with another pivot, drawn anew each
    turn, which joins what belongs together. 4. Then every pair of classes that share a bucket but not a component, and that the
    sets' sizes and bitmaps allow to be similar enough, is confirmed too, so no link between components that share a bucket is
    lost; within a bucket the bitmaps of each class outside the bucket's largest component are compared with all others', but only
    what they allow leaves the join. 5. Components.

    Sets are computed again for classes that share a bucket, found through a filter of bounded size. Texts without words (null,
    empty, white space) have n_shingles 0 and are linked with nothing. Null ids: such rows are linked like others; component_id
    is null if nothing with an id is reachable. Repeated rows share a component and, with its least id, all count as kept. An
    empty table gives no rows; more columns are ignored.
    """
    signed = staged(signatures(docs, id_col, text_col, MinMax(bands, rows, seed), carry), "signatures")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    banded = classes.select("node", "rep", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    members = staged(banded.join(buckets.select("band", "leader"), "band"), "members")

    key = F.xxhash64("doc_id")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct().select(key.alias("_k"))
    log2_bits = filter_bits(wanted.count())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).withColumn("_k", key)
    sets = staged(sets_of(probe(texts, "_k", membership_filter(wanted, "_k", log2_bits), log2_bits)), "sets")

    bits = sets.select("node", "bits").dropDuplicates(["node"])
    members = members.select("band", "node", "n", "leader")
    led = members.where("node <> leader").select("node", "leader", "n").distinct()
    leaders = members.where("node = leader").select("leader", F.col("n").alias("m")).distinct()
    stars = led.join(leaders, "leader").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    links = staged(confirmed(stars.select(F.col("leader").alias("a"), F.col("node").alias("b")), sets, percent), "links")
    roots = connected_components(links)
    tidy(docs.sparkSession)

    for turn in range(TURNS + 1):
        placed = members.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
        several = placed.groupBy("band").agg(F.min("root").alias("_a"), F.max("root").alias("_z"), F.count(F.lit(1)).alias("_k")).where("_a <> _z").select("band", "_k")
        placed = staged(placed.join(several, "band").join(bits, "node"), "placed")
        rows_left, pairs_left = placed.agg(F.count(F.lit(1)), F.sum("_k")).first()
        if turn == TURNS or not rows_left or pairs_left <= PAIRS_A_ROW * rows_left:
            break
        pivot = placed.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "root", "bits")).alias("p")).select("band", *[F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "n", "root", "bits")])
        pairs = placed.join(pivot, "band").where((F.col("root") != F.col("root_b")) & possible("n", "bits", "n_b", "bits_b", percent))
        more = staged(confirmed(pairs.select(F.col("node_b").alias("a"), F.col("node").alias("b")).distinct(), sets, percent), "links")
        del pivot, pairs, several
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    major = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("_c")).groupBy("band").agg(F.max(F.struct("_c", "root")).alias("_m")).select("band", F.col("_m.root").alias("major"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work, not bytes, is what there is to spread here
    placed = placed.join(major, "band").withColumn("minor", F.col("root") != F.col("major")).repartition(parts, "band")
    other = placed.select("band", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "bits", "minor")])
    crossing = placed.where("minor").join(other, "band").where((~F.col("minor_b") | (F.col("node") < F.col("node_b"))) & (F.col("root") != F.col("root_b")) & possible("n", "bits", "n_b", "bits_b", percent))
    crossing = crossing.select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    more = staged(confirmed(crossing.select("a", "b").distinct(), sets, percent), "links")
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    rooted = classes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    out = signed.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *[f"_c{i}" for i in range(len(carry))])
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
