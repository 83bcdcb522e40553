"""Quality by nearest-neighbour voting: latent-semantic vectors of labelled texts, exact cosine products in blocks, votes weighted by similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, give_back, lean, word_hashes
from logloom.llm.sampling import fold, labelled

#: Labelled rows of each class that are learned from (about), dimensions, neighbours, and the power of a similarity that is its weight.
PER_CLASS, DIMENSIONS, NEIGHBOURS, POWER = 1000, 64, 15, 8
#: A text that is unlike all labelled ones is not of high quality: label 0 has as many votes more as there are neighbours, each of this similarity.
STRANGE = 0.5
#: Short texts have few trigrams to share: similarities of a text of n bytes are multiplied by sqrt(1 + SHORT / n), up to the part that is not latent.
SHORT = 50
#: Texts that are scored at once; fewer are filled up, so that each product has the same shape and a score the same bits wherever its text is.
ROWS = 256
#: Bits of the hash of a trigram of letters.
HASH_BITS = 12
_SHAPES, _REPEATS = 16**3, 3
FEATURES = _SHAPES + _REPEATS + (1 << HASH_BITS)

_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate((b" ", b"\t\n\v\f\r", bytes([*range(97, 123), *range(128, 256)]), bytes(range(65, 91)), b"0123456789", b".", b",", b"!", b"?", b"|", b"$", b"*", b"%", b"&", b"#")):
    _CLASS[list(_chars)] = _k
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def features(texts: list[bytes]) -> np.ndarray:
    """A row per text: square roots of the shares of the trigrams of character classes, of three kinds of repeated words, and of the trigrams of characters in lower case (hashed)."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    h, first = word_hashes(texts)
    for row, text, a, b in zip(out, texts, first[:-1], first[1:], strict=True):
        raw = np.frombuffer(text, np.uint8)
        if len(raw) >= 3:
            c = _CLASS[raw].astype(np.int32)
            row[:_SHAPES] = np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=_SHAPES) / (len(c) - 2)
            c = _LOWER[raw]
            c = (((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
            row[_SHAPES + _REPEATS :] = np.bincount(c, minlength=1 << HASH_BITS) / len(c)
        if b > a:
            w = h[a:b]
            row[_SHAPES : _SHAPES + _REPEATS] = np.array([(w[1:] == w[:-1]).sum(), (w[2:] == w[:-2]).sum(), len(w) - len(np.unique(w))]) / len(w)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Neighbours:
    """The model: a projection from weighted features, and the labelled vectors in it. Its size is bounded by the sample's."""

    def __init__(self, texts: list[bytes], y: np.ndarray, dimensions: int = DIMENSIONS, k: int = NEIGHBOURS, power: float = POWER):
        n = len(texts)
        self.y, self.k, self.power = y.astype(np.float64), min(k, n), power
        x = np.zeros((n, FEATURES), np.float32)
        for i in range(0, n, ROWS):
            x[i : i + ROWS] = features(texts[i : i + ROWS])
        #: Square roots of smoothed inverse document frequencies; what no labelled text has weighs as what one has.
        self.weight = np.sqrt(np.log((1 + n) / (1 + np.maximum(np.count_nonzero(x, axis=0), min(1, n)))) + 0.1).astype(np.float32)
        x *= self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # the latent dimensions: the right singular vectors of the labelled texts, by the eigenvectors of their products
        values, vectors = np.linalg.eigh(x @ x.T) if n else (np.zeros(0, np.float32), np.zeros((0, 0), np.float32))
        kept = np.flatnonzero(values > 1e-3)[-dimensions:]
        axes = x.T @ (vectors[:, kept] / np.sqrt(values[kept]))
        self.vectors = _unit(x @ axes)
        self.projection = self.weight[:, None] * axes

    def similarities(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cosines in the latent space, times the share of the text's weighted length that lies in it (by ``size``, its bytes, more for short texts)."""
        latent = x @ self.projection
        whole = np.sqrt((x * x) @ (self.weight * self.weight))
        share = np.linalg.norm(latent, axis=1) / np.maximum(whole, 1e-12)
        share = np.minimum(1, share * np.sqrt(1 + SHORT / np.maximum(size, 1)))
        return np.round((_unit(latent) @ self.vectors.T) * share[:, None].astype(np.float32), 5)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The weighted share of label 1 among the k nearest and the votes for what is strange; 0 for a text without features, 0.5 if nothing was learned.

        Labelled texts as near as the k-th nearest all vote.
        """
        if not len(self.y):
            return np.full(len(texts), 0.5)
        out = []
        for i in range(0, len(texts), ROWS):
            some = [*texts[i : i + ROWS], *[b""] * max(0, i + ROWS - len(texts))]
            near = self.similarities(features(some), np.fromiter(map(len, some), np.float64, ROWS))
            kth = np.partition(near, len(self.y) - self.k, axis=1)[:, [len(self.y) - self.k]]
            votes = np.where(near >= kth, np.maximum(near, 0), 0).astype(np.float64) ** self.power
            out.append((votes @ self.y) / (votes.sum(axis=1) + self.k * STRANGE**self.power))
        return np.concatenate(out or [np.zeros(0)])[: len(texts)]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Neighbours:
    """Learns from about ``per_class`` rows a label outside the held-out fold, which come to the driver, at most sampling.MOST_BYTES of text."""
    sample, _ = labelled(docs, labels, "quality", folds, held, per_class, id_col, text_col)
    rows = sorted((r["_label"], r["_text"].encode()) for r in sample.where("_label in (0, 1)").toLocalIterator())
    model = Neighbours([t for _, t in rows], np.array([y for y, _ in rows], np.float64))
    give_back()
    return model


def score_quality(docs: DataFrame, model: Neighbours, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, score, predicted), then, if any are named, the columns of ``carry`` in a struct row. The score depends on the text alone.

    Null and empty texts score 0; texts of fewer than three bytes by their repeated words only; very long ones as wholes. Ties
    among neighbours all vote. Repeated rows score alike; an empty table gives no rows; columns not named are ignored, clashing
    names included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                texts = [t.encode() if t else b"" for t in part.column(0).to_pylist()]
                score = np.clip(np.round(shared.value.score(texts), 6), 0, 1)
                kept = [part.column(i) for i in (*range(1, part.num_columns), *([0] if text_col in carry else []))]
                yield pa.RecordBatch.from_arrays([kept[0], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), *kept[1:]], names=["doc_id", "score", "predicted", *(f"_c{i}" for i in places)])

    # the text passes to Python and back once, though it may be a carried column too
    places = [*(i for i, c in enumerate(carry) if c != text_col), *(i for i, c in enumerate(carry) if c == text_col)]
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(carry[i]).alias(f"_c{i}") for i in places if carry[i] != text_col])
    kinds = dict(rows.dtypes) | {f"_c{i}": "string" for i, c in enumerate(carry) if c == text_col}
    out = rows.mapInArrow(lean(run), f"doc_id {kinds['doc_id']}, score double, predicted int" + "".join(f", _c{i} {kinds[f'_c{i}']}" for i in places))
    return out.select("doc_id", "score", "predicted", *([F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]).alias("row")] if carry else []))


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, learned from labels outside the held-out fold."""
    scored = score_quality(docs, train(docs, labels, folds, held), threshold)
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", "predicted")
