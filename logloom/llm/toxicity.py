"""Toxicity by nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, distance-weighted votes, calibrated scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, give_back, lean
from logloom.llm.sampling import fold, labelled

#: Labelled rows of each class that are learned from (about), neighbours, and examples of an index block.
PER_CLASS, NEIGHBOURS, BLOCK = 2500, 9, 64
#: Words of fewer learned texts are no terms: no two texts could share them.
LEAST_TEXTS = 2
#: Texts that stand beside those learned, spread as the classes are, when a term's relevance to a class is estimated.
PRIOR_TEXTS = 2.0
#: Blocks of greatest bound that are scored before others are skipped, texts that are scored at once, and decimals of a cosine that count.
FIRST, QUERIES, DECIMALS = 4, 16, 6
#: Terms that the index keeps as rows of a matrix at most, and the part of the examples that they are in at least.
COMMON, FREQUENT = 256, 1 / 16
#: Terms and examples that are given as evidence.
EVIDENCE = 5

_TOKEN = re.compile(r"[^\W\d_]+")
Vector = tuple[np.ndarray, np.ndarray]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after the other, and the ranges' sizes."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class BlockMaxIndex:
    """An inverted index of unit vectors (terms in order, weights). A cell is a term's postings in a block of examples, with their greatest weight.

    The postings of terms in many examples, the COMMON most frequent of those in a FREQUENT part of all, are kept as rows of a
    matrix instead, whose products are taken for all examples at once.
    """

    def __init__(self, vectors: list[Vector], terms: int, block: int = BLOCK):
        self.n, self.blocks, self.block = len(vectors), -(-len(vectors) // block), block
        empty = [np.zeros(0, np.int64)]
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]) if vectors else empty[0]
        term, weight = np.concatenate([t for t, _ in vectors] or empty), np.concatenate([w for _, w in vectors] or empty).astype(np.float32)
        count = np.bincount(term, minlength=terms)
        common = np.argsort(-count, kind="stable")[:COMMON]
        common = common[count[common] >= max(2, FREQUENT * self.n)]
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        dense = self.row[term] >= 0
        self.matrix[self.row[term[dense]], example[dense]] = weight[dense]
        term, example, weight = term[~dense], example[~dense], weight[~dense]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        cell = term * max(1, self.blocks) + self.example // block
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_start = np.append(start, len(cell))
        self.cell_block = (cell[start] % max(1, self.blocks)).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.weight, start) if len(start) else self.weight
        self.term_start = np.searchsorted(term[start], np.arange(terms + 1))

    def cosines(self, queries: list[Vector], k: int, first: int = FIRST) -> np.ndarray:
        """A row for each of up to QUERIES unit queries and a column per example: the cosines, exact for all that are among the k greatest (and too small for some that aren't).

        A block is skipped only if its bound, the greatest product with the matrix plus the sum of the query's other weights times
        the cells' greatest, is below the k-th greatest cosine in the blocks of the greatest bounds.
        """
        if not self.n:
            return np.zeros((len(queries), 0))
        owner = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        # always of the same shape, so that a cosine has the same bits wherever its query is
        common, row = np.zeros((QUERIES, len(self.matrix)), np.float32), self.row[term]
        common[owner[row >= 0], row[row >= 0]] = weight[row >= 0]
        out = (common @ self.matrix)[: len(queries)].astype(np.float64)
        most = np.maximum.reduceat(out, np.arange(0, self.n, self.block), axis=1)
        owner, term, weight = owner[row < 0], term[row < 0], weight[row < 0]
        cell, size = _ranges(self.term_start[term], self.term_start[term + 1])
        owner, weight = np.repeat(owner, size), np.repeat(weight, size)
        place = owner * self.blocks + self.cell_block[cell]
        bound = most + np.bincount(place, weight * self.cell_most[cell], most.size).reshape(most.shape)

        def score(blocks: np.ndarray) -> None:
            use = blocks.ravel()[place]
            posting, size = _ranges(self.cell_start[cell[use]], self.cell_start[cell[use] + 1])
            at = np.repeat(owner[use] * self.n, size) + self.example[posting]
            out[:] += np.bincount(at, np.repeat(weight[use], size) * self.weight[posting], out.size).reshape(out.shape)

        if self.blocks <= first or self.n <= k:
            score(np.ones(bound.shape, bool))
            return out
        best = bound >= np.partition(bound, self.blocks - first, axis=1)[:, [self.blocks - first]]
        score(best)
        worst = np.partition(np.where(np.repeat(best, self.block, axis=1)[:, : self.n], out, -1.0), self.n - k, axis=1)[:, [self.n - k]]
        score(~best & (bound >= worst - 1e-6))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the steps (least x, weighted mean y) of the nearest non-decreasing function."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # least x, sum, weight
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b * w
            pools[-1][2] += w
        else:
            pools.append([a, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class ToxicityModel:
    """Vocabulary, term weights, index of all the examples and calibration; its size is bounded by the sample's.

    A term weighs (1 + log count) * idf * rf: rf is its relevance frequency (Lan et al., 2009), log2(2 + its share of the texts of
    label 1 / its share of those of label 0). Every word of two or more learned texts is a term.
    """

    def __init__(self, examples: list[tuple[int, int, list[str]]], rows: dict[int, int] | None = None, k: int = NEIGHBOURS, block: int = BLOCK):
        """examples: (id, label, tokens); rows: how many labelled rows each class has, of which the examples are a sample."""
        examples = sorted({tuple(e[2]): e for e in sorted(examples, reverse=True)}.values())  # of equal texts one
        self.k, y = k, np.array([e[1] for e in examples], float)
        size = np.array([(y == 0).sum(), (y == 1).sum()], float)
        frequency: tuple[Counter, Counter] = (Counter(), Counter())
        for _, label, words in examples:
            frequency[label].update(set(words))
        self.terms = sorted(t for t in frequency[0].keys() | frequency[1].keys() if frequency[0][t] + frequency[1][t] >= LEAST_TEXTS)
        self.number = {t: i for i, t in enumerate(self.terms)}
        count = np.array([[f[t] for t in self.terms] for f in frequency], float).reshape(2, -1)
        n = max(1, len(examples))
        share = (count + PRIOR_TEXTS * size[:, None] / n) / np.maximum(size[:, None], 1)
        self.weights = np.log((1 + n) / count.sum(axis=0)) * (np.log2(2 + share[1] / share[0]) if size.all() else 1.0)
        #: What a labelled row of a class stands for, so that scores are shares of all labelled rows, not of the sample.
        each = np.array([(rows or {}).get(c, size[c]) / size[c] if size[c] else 0.0 for c in (0, 1)])
        vectors = [self.vector(e[2]) for e in examples]
        weight = each[y.astype(int)]
        bare = np.array([not len(t) for t, _ in vectors], bool)
        prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
        self.without = float((weight * y)[bare].sum() / weight[bare].sum()) if bare.any() else prior
        # examples with the same heaviest term are near each other, which makes blocks' bounds tighter
        lead = np.array([t[w.argmax()] if len(t) else -1 for t, w in vectors], np.int64)
        order = np.lexsort((np.arange(len(y)), lead, y))
        order = order[~bare[order]]
        self.ids, self.y = np.array([e[0] for e in examples], np.int64)[order], y[order]
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(self.terms), block)
        raw = np.concatenate([self.votes(vectors[i : i + QUERIES], leave_out=i)[0] for i in range(0, len(vectors), QUERIES)]) if vectors else np.zeros(0)
        self.steps = isotonic(raw, self.y, weight[order]) if len(raw) else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "number"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, number={t: i for i, t in enumerate(state["terms"])})

    def vector(self, words: list[str]) -> Vector:
        """The unit vector of a text's terms, in their order."""
        number, count = self.number.get, Counter(words)
        at = np.fromiter((number(w, -1) for w in count), np.int64, len(count))
        order = np.argsort(at)[np.count_nonzero(at < 0) :]
        at = at[order]
        weight = (1 + np.log(np.fromiter(count.values(), np.int64, len(count))[order])) * self.weights[at]
        norm = np.sqrt((weight * weight).sum())
        return (at, weight / norm) if norm > 0 else (at[:0], weight[:0])

    def votes(self, vectors: list[Vector], leave_out: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each vector the vote of its nearest examples, weighted by 1 / (0.05 + distance), and the nearest ones' places.

        The nearest are those of at least the k-th greatest cosine, and more than 0. ``leave_out``: the vectors are the examples
        from that place on, which don't vote for themselves.
        """
        k = min(self.k + (leave_out is not None), self.index.n)
        cosines = np.round(self.index.cosines(vectors, k), DECIMALS)
        if leave_out is not None:
            cosines[np.arange(len(vectors)), leave_out + np.arange(len(vectors))] = 0
            k = min(self.k, self.index.n)
        kth = np.partition(cosines, self.index.n - k, axis=1)[:, self.index.n - k]
        out, places = np.full(len(vectors), self.without), []
        for i, (row, least) in enumerate(zip(cosines, kth, strict=True)):
            near = np.flatnonzero((row >= least) & (row > 0))
            near = near[np.argsort(-row[near], kind="stable")]
            places.append(near)
            if len(near):
                weight = 1 / (0.05 + np.maximum(0, 1 - row[near]))
                out[i] = (weight * self.y[near]).sum() / weight.sum()
        return out, places

    def scores(self, texts: list[str]) -> list[tuple[float, list[int], list[str]]]:
        """For each text the calibrated score, and as evidence the nearest examples' ids and the text's heaviest terms. A text without a term scores as such examples do."""
        vectors = [self.vector(tokens(t)) for t in texts]
        out: list[tuple[float, list[int], list[str]]] = [(self.without, [], [])] * len(texts)
        full = [i for i, (t, _) in enumerate(vectors) if len(t)] if self.steps is not None else []
        for a in range(0, len(full), QUERIES):
            some = full[a : a + QUERIES]
            votes, places = self.votes([vectors[i] for i in some])
            x, y = self.steps
            for i, vote, near in zip(some, votes, places, strict=True):
                at, weight = vectors[i]
                heaviest = at[np.argsort(-weight, kind="stable")[:EVIDENCE]]
                score = float(y[max(0, int(np.searchsorted(x, vote, side="right")) - 1)]) if len(near) else self.without
                out[i] = score, self.ids[near[:EVIDENCE]].tolist(), [self.terms[j] for j in heaviest]
        return out


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learns from about ``per_class`` rows a label outside the held-out fold, which come to the driver, at most sampling.MOST_BYTES of text."""
    sample, rows = labelled(docs, labels, "toxic", folds, held, per_class, id_col, text_col)
    model = ToxicityModel([(r["_id"], r["_label"], tokens(r["_text"])) for r in sample.where("_label in (0, 1)").toLocalIterator()], rows)
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, score, predicted, examples, terms). The score depends on the text alone.

    The score is the share of label 1 that labelled rows with such a vote have. Null and empty texts, and others without a term,
    score as labelled texts without a term do, or, if there is none, as the share of label 1 (0 if nothing was learned). Examples
    of equal cosine with the last neighbour all vote. Repeated rows score alike; very long texts are scored whole; an empty table
    gives no rows; more columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                found = shared.value.scores(part.column(1).to_pylist())
                score = np.clip(np.round([f[0] for f in found], 6), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "examples", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(lean(run), "doc_id long, score double, predicted int, examples array<long>, terms array<string>")


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, examples, terms) for every row of docs, learned from labels outside the held-out fold."""
    scored = score_toxicity(docs, train(docs, labels, folds, held), threshold)
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted", "examples", "terms")
