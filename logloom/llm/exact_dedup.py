"""Exact dedup by a log-structured merge index over text digests (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import MOST_LOG2_BITS, filter_bits, maybe, membership_filter, probe, scratch, staged

SHA256: Callable[[Column], Column] = lambda t: F.unhex(F.sha2(t.cast("binary"), 256))
ENTRY = "digest binary, smallest long, largest long, n long"
#: Runs of a level that are merged into one of the next, and so many runs a table is flushed as.
FANOUT = 4
#: More keys than this have no filter: with so few bits for each it would let nearly every row through.
MOST_KEYS = 1 << (MOST_LOG2_BITS - 1)


class Filter:
    """Which digests may be among some: a filter sized by their number, or, where there are too many, the digests themselves."""

    def __init__(self, digests: DataFrame, n: int):
        self.n, self.bits, self.digests = n, filter_bits(n), digests
        self.slices = None if n > MOST_KEYS else staged(membership_filter(digests.select(F.xxhash64("digest").alias("_k")), "_k", self.bits), "filter")

    def among(self, rows: DataFrame) -> DataFrame:
        """The rows whose digest may be among them."""
        if self.slices is None:
            return rows.join(self.digests.select("digest").distinct(), "digest", "left_semi")
        return probe(rows.withColumn("_k", F.xxhash64("digest")), "_k", self.slices, self.bits).drop("_k")

    def mark(self, rows: DataFrame, into: str) -> DataFrame:
        """rows with a boolean column: whether the digest may be among them."""
        if self.slices is None:
            return rows.withColumn(into, F.lit(True))
        return maybe(rows.withColumn("_k", F.xxhash64("digest")), "_k", self.slices, self.bits, into).drop("_k")


class DigestIndex:
    """Sorted runs of (digest, smallest, largest, n) in the shared folder, by level; each a Parquet table sorted by digest in its files.

    ``flush`` writes memtables (batches of rows, sorted by digest in their tasks) as runs of level 0. A level with ``fanout`` runs
    is merged into one run of the next: per digest the smallest and the largest id and the count. ``lookup`` asks each run's
    filter, made when it is first asked, and reads the runs only for digests that it lets through. Runs are immutable, so a lost
    executor repeats only its task; merged ones stay on disk for those who still read them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "digest-index"), fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0
        self.filters: dict[str, Filter] = {}

    def _next(self, level: int) -> str:
        self.made += 1
        return f"{self.path}/level={level}/flush={self.made}"

    def flush(self, rows: DataFrame, runs: int = 1, merge: bool = True) -> DataFrame:
        """rows: (digest, doc_id). Adds them as up to ``runs`` runs, each from some of the input's tasks, in one pass; returns the rows as written: (digest, smallest, largest, n) of each."""
        at = self._next(0)
        entry = rows.select("digest", F.col("doc_id").cast("long").alias("smallest"), F.col("doc_id").cast("long").alias("largest"), F.lit(1).cast("long").alias("n"))
        entry.withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs))).sortWithinPartitions("run", "digest").write.partitionBy("run").parquet(at)
        written = self.spark.read.schema(f"{ENTRY}, run int").parquet(at)
        self.levels[0] += [f"{at}/run={r[0]}" for r in written.select("run").distinct().orderBy("run").collect()]
        if merge:
            self.compact()
        return written.drop("run")

    def entries(self, runs: list[str] | None = None) -> DataFrame:
        """All entries of the runs (all live ones); a digest can be in several runs, and in a run of level 0 several times."""
        runs = [r for level in self.levels for r in level] if runs is None else runs
        return self.spark.read.schema(ENTRY).parquet(*runs) if runs else self.spark.createDataFrame([], ENTRY)

    @staticmethod
    def merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))

    def _merge(self, runs: list[str], level: int) -> str:
        at = self._next(level)
        self.merged(self.entries(runs)).sortWithinPartitions("digest").write.parquet(at)
        for r in runs:
            self.filters.pop(r, None)
        return at

    def compact(self, whole: bool = False) -> None:
        """Merges every level that is full into the next; ``whole``: all runs into one."""
        level = 0
        while level < len(self.levels):
            runs = self.levels[level]
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._merge(runs, level + 1))
                self.levels[level] = []
            level += 1
        live = [r for runs in self.levels for r in runs]
        if whole and (len(live) > 1 or self.levels[0]):
            top = len(self.levels)
            self.levels = [*([] for _ in self.levels), [self._merge(live, top)]]

    def filter_of(self, run: str) -> Filter:
        if run not in self.filters:
            found = self.entries([run])
            self.filters[run] = Filter(found, found.count())
        return self.filters[run]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """(digest, smallest, largest, n), over all live runs, of those of the digests (a column digest, different ones) that the index holds."""
        found = [self.filter_of(r).among(digests.select("digest")).join(self.entries([r]), "digest") for level in self.levels for r in level]
        return self.merged(reduce(DataFrame.unionByName, found)) if found else self.entries()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest: Callable[[Column], Column] = SHA256) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, digest). Groups are byte-identical texts.

    Texts are read twice and never shuffled but for hits: first for digests, which go to a DigestIndex as several runs that are
    merged; then, through a filter sized by the number of repeated digests, for the rows whose digest is one of them. Those are
    verified byte for byte: per digest the least and the greatest text must be equal (partial minima and maxima are taken before
    the shuffle, so a hot group moves one text a task). Should a digest hold different texts, its rows are grouped by whole text
    instead. Rows that the filter lets through meet the index's entries; all others are groups of one.

    A null text counts as empty. ``keep`` is largest or smallest: that id stays. Null ids are never kept unless the whole group
    has none (keep_id null). Rows repeated with the kept id all count as kept. Very long texts are digested and compared whole. An
    empty table gives no rows; more columns are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("digest", digest(F.col("_text")))
    index = DigestIndex(spark)
    each = index.flush(rows.select("digest", "doc_id"), FANOUT, merge=False).select("digest", F.col("smallest").alias("doc_id"))
    index.compact(whole=True)
    repeated = index.entries().where("n > 1")
    hits = Filter(repeated, repeated.count())

    checked = hits.among(rows).groupBy("digest").agg(F.min("_text").alias("_a"), F.max("_text").alias("_z"))
    differing = staged(checked.where("_a <> _z").select("digest"), "differing")

    each = hits.mark(each, "_hit")
    alone = F.col("n").isNull()
    met = each.where("_hit").join(repeated, "digest", "left").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col(keep)).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), "digest")
    out = each.where(~F.col("_hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest").unionByName(met)
    if not differing.isEmpty():
        apart = rows.join(differing, "digest", "left_semi")
        pick = F.max if keep == "largest" else F.min
        groups = apart.groupBy("digest", "_text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = apart.join(groups, ["digest", "_text"]).select("doc_id", "keep_id", "group_size", "digest")
        out = out.join(differing, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "digest").unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
