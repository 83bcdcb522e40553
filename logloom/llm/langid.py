"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, give_back, lean, mix64
from logloom.llm.sampling import by_class, fold, within_bytes

#: Labelled rows that are learned from (about), shared evenly by the languages; length of the n-grams; discount.
ROWS, ORDER, DISCOUNT = 3000, 4, 0.75
#: n-grams whose probabilities a worker keeps.
KEPT = 1 << 19
#: Rejection is calibrated on labelled texts by models that learned the other parts: of so many parts each is left out once.
PARTS = 4
#: A text is none of the languages if its cross-entropy exceeds its language's median by more than this quantile of what calibration texts
#: exceed it by, and by the margin (nats). Excesses are compared in units that grow with sqrt(1 + SHORT / letters), as short texts vary more.
QUANTILE, MARGIN, SHORT = 0.99, 0.2, 200
#: Learned texts that are counted at once, and bytes of texts that are scored at once, as their n-grams take many times their size.
PART, SCORED = 50, 1 << 18
#: Steepness of the score in nats a character.
STEEPNESS = 12.0

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower case, every run without letters and marks one space, each text between spaces; each text's first index; its letters."""
    if not _LETTER:
        # marks belong to the words that they stand in, but make none
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
        _LETTER.append(_LETTER[0] | np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)), bool, 0x110000))
    cp = np.frombuffer("\0".join([*(t.lower().replace("\0", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, part, end = _LETTER[0][cp], _LETTER[1][cp], cp == 0
    before = np.concatenate(([True], end[:-1]))
    keep = part | end | before | np.concatenate(([False], part[:-1]))
    text = np.cumsum(np.concatenate(([0], end[:-1])))[keep]
    cp, letter = np.where(part, cp, 32)[keep], letter[keep].astype(np.int64)
    first = np.searchsorted(text, np.arange(len(texts)))
    return cp.astype(np.uint64), first, np.add.reduceat(letter, first) if len(texts) else first


def grams(cp: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """For each symbol the hash of the n symbols that end there; beyond a text's beginning there are spaces."""
    own = np.zeros(len(cp), np.int64)
    own[first] = first
    place = np.arange(len(cp)) - np.maximum.accumulate(own)
    h = np.full(len(cp), n, np.uint64)
    for back in range(n - 1, -1, -1):
        past = np.full(len(cp), 32, np.uint64)
        past[back:] = cp[: len(cp) - back]
        h = (h + np.where(place >= back, past, np.uint64(32))) * _MULTIPLIER
    return mix64(h)


def hashed(rows: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, a row of symbols each."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for column in rows.T:
        h = (h + column) * _MULTIPLIER
    return mix64(h)


def _merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and the sums of their counts."""
    if not rows.shape[1]:
        return rows[:1], counts[:1]
    _, at, inverse = np.unique(hashed(rows), return_index=True, return_inverse=True)
    return rows[at], np.bincount(inverse, counts, len(at)).astype(np.int64)


def _counted(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of that length in the texts, spaces before each text's beginning, and how often they occur."""
    cp, first, _ = symbols(texts)
    own = np.zeros(len(cp), np.int64)
    own[first] = first
    place = np.arange(len(cp)) - np.maximum.accumulate(own)
    rows = np.full((len(cp), order), 32, np.uint64)
    for back in range(order):
        inside = place >= back
        rows[inside, order - 1 - back] = cp[np.flatnonzero(inside) - back]
    return _merged(rows, np.ones(len(cp), np.int64))


class KneserNey:
    """One language's model. By length k: sorted hashes of k-grams with their discounted shares, and of contexts with their weights for shorter ones."""

    def __init__(self, texts: list[str], order: int = ORDER, discount: float = DISCOUNT):
        self.order = order
        parts = [_counted(texts[i : i + PART], order) for i in range(0, len(texts), PART)]
        grams, counts = _merged(np.concatenate([g for g, _ in parts]) if parts else np.zeros((0, order), np.uint64), np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64))
        self.shares: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order, 0, -1):
            # the longest grams are counted as they occur, shorter ones by the different symbols before them
            context = hashed(grams[:, :-1]) if k > 1 else np.zeros(len(grams), np.uint64)
            ctx, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(inverse, counts, len(ctx)), np.bincount(inverse, minlength=len(ctx))
            gram = hashed(grams)
            place = np.argsort(gram)
            self.shares.insert(0, (gram[place], (np.maximum(counts - discount, 0) / total[inverse])[place]))
            self.weights.insert(0, (ctx, discount * kinds / total))
            grams, counts = _merged(grams[:, 1:], np.ones(len(grams), np.int64))
        self.symbols = max(1, len(self.shares[0][0])) + 1

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, other: float) -> np.ndarray:
        hashes, values = table
        if not len(hashes):
            return np.full(len(keys), other)
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where(hashes[at] == keys, values[at], other)

    def log_probability(self, gram: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """Of symbols given the ones before: gram[k - 1] and context[k - 1] are hashes of the k-grams and of their contexts."""
        p = np.full(len(gram[0]), 1.0 / self.symbols)
        for k in range(self.order):
            p = self._look(self.shares[k], gram[k], 0.0) + self._look(self.weights[k], context[k], 1.0) * p
        return np.log(p)


class LanguageModels:
    """The models, for each language a bound on the cross-entropy beyond which a text is none of the languages, and the lookups of a worker so far."""

    def __init__(self, sample: dict[str, list[str]], order: int = ORDER, calibrated: bool = True):
        self.order, self.languages = order, sorted(sample)
        self.models = [KneserNey(sample[x], order) for x in self.languages]
        self.centre, self.width = np.zeros(len(self.models)), np.full(len(self.models), np.inf)
        self._reset()
        if calibrated:
            self._calibrate(sample)

    def _calibrate(self, sample: dict[str, list[str]]) -> None:
        """Bounds from the cross-entropies that texts have by models that did not learn them; a language without such texts has none."""
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {x: [] for x in self.languages}
        # texts that begin alike are in one part, so that copies with few changes are not learned
        part = {x: [zlib.crc32(t[:40].encode("utf-8", "surrogatepass")) % PARTS for t in sample[x]] for x in self.languages}
        for k in range(PARTS):
            rest = {x: [t for t, p in zip(sample[x], part[x], strict=True) if p != k] for x in self.languages}
            models = LanguageModels({x: t for x, t in rest.items() if t}, self.order, calibrated=False)
            for x in self.languages if models.models else []:
                left = [t for t, p in zip(sample[x], part[x], strict=True) if p == k]
                for i in range(0, len(left), PART):
                    entropy, letters = models.cross_entropy(left[i : i + PART])
                    found[x].append((entropy.min(axis=1)[letters > 0], letters[letters > 0]))
        for j, x in enumerate(self.languages):
            if sum(len(e) for e, _ in found[x]):
                entropy, letters = (np.concatenate(c) for c in zip(*found[x], strict=True))
                self.centre[j] = np.median(entropy)
                self.width[j] = max(0.0, np.quantile((entropy - self.centre[j]) / np.sqrt(1 + SHORT / letters), QUANTILE))

    def bound(self, language: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The greatest cross-entropies that are not rejected, of texts with so many letters whose nearest languages have these places."""
        return self.centre[language] + (self.width[language] + MARGIN) * np.sqrt(1 + SHORT / np.maximum(letters, 1))

    def _reset(self) -> None:
        self.known, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(self.models)))

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol, a row per text and a column per language; and the texts' letters."""
        cp, first, letters = symbols(texts)
        code, distinct = pd.factorize(grams(cp, first, self.order))
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            if len(self.known) > KEPT:
                self._reset()
                new[:] = True
            where = np.empty(len(distinct), np.int64)
            where[code[::-1]] = np.arange(len(cp))[::-1]
            where = where[new]
            # the symbols before each place, from the last one
            start = first[np.searchsorted(first, where, side="right") - 1]
            past = np.stack([np.where(where - b >= start, cp[np.maximum(where - b, 0)], np.uint64(32)) for b in range(self.order)])
            of = [hashed(past[k::-1].T) for k in range(self.order)]
            context = [np.zeros(len(where), np.uint64), *[hashed(past[k:0:-1].T) for k in range(1, self.order)]]
            logs = np.stack([m.log_probability(of, context) for m in self.models], axis=1)
            known = np.concatenate((self.known, distinct[new]))
            order = np.argsort(known)
            self.known, self.logs = known[order], np.concatenate((self.logs, logs))[order]
            at = np.searchsorted(self.known, distinct)
        rows = self.logs[at]
        length = np.diff(np.concatenate((first, [len(cp)])))
        total = np.stack([np.add.reduceat(rows[:, j][code], first) for j in range(len(self.models))], axis=1)
        return -total / length[:, None], letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, cross-entropy) of each text; und, 0, rejected for texts without letters."""
        if not texts:
            return []
        if not self.models:
            return [("und", 0.0, True, 0.0)] * len(texts)
        entropy, letters = self.cross_entropy(texts)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(texts)), best]
        share = 1 / np.exp(-STEEPNESS * (entropy - least[:, None])).sum(axis=1)
        out = []
        for b, e, s, n, most in zip(best, least, share, letters, self.bound(best, letters), strict=True):
            rejected = e > most
            out.append((self.languages[b], float(s) * (0.5 if rejected else 1.0), bool(rejected), float(e)) if n else ("und", 0.0, True, 0.0))
        return out


def train(docs: DataFrame, folds: int = 4, held: int = 2, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Learns from about ``rows`` rows with a language outside the held-out fold, an equal number of each language at most; of equal texts one counts."""
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull())
    known = known.where(fold("_id", folds) != held)
    sample: dict[str, set[str]] = {}
    known, counts = by_class(known, "_lang", rows, "_id", "_text", together=True)
    for r in within_bytes(known.select("_lang", "_text"), "_lang", "_text", len(counts)).select("_lang", "_text").toLocalIterator():
        sample.setdefault(r[0], set()).add(r[1])
    models = LanguageModels({k: sorted(v) for k, v in sample.items()})
    models._reset()
    give_back()
    return models


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, lang_pred, score, rejected, cross_entropy), then, if any are named, the columns of ``carry`` in a struct row.

    The language is the one of least cross-entropy a character over the whole text. und, score 0 and rejected: texts that are
    null, empty or without letters, or any text if nothing was learned. Rejected with a language: a cross-entropy above the bound
    that was calibrated for that language on labelled texts that its models had not learned, wider for shorter texts; none is so
    rejected where no such text is left. Ties go to the first language by name; repeated rows are alike; an empty table gives no rows; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", SCORED):
                found = shared.value.predict([t or "" for t in part.column(0).to_pylist()])
                kept = [part.column(i) for i in (*range(1, part.num_columns), *([0] if text_col in carry else []))]
                columns = [kept[0], *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)), *kept[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected", "cross_entropy", *(f"_c{i}" for i in places)])

    # the text passes to Python and back once, though it may be a carried column too
    places = [*(i for i, c in enumerate(carry) if c != text_col), *(i for i, c in enumerate(carry) if c == text_col)]
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(carry[i]).alias(f"_c{i}") for i in places if carry[i] != text_col])
    kinds = dict(rows.dtypes) | {f"_c{i}": "string" for i, c in enumerate(carry) if c == text_col}
    out = rows.mapInArrow(lean(run), f"doc_id {kinds['doc_id']}, lang_pred string, score double, rejected boolean, cross_entropy double" + "".join(f", _c{i} {kinds[f'_c{i}']}" for i in places))
    return out.select("doc_id", "lang_pred", "score", "rejected", "cross_entropy", *([F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]).alias("row")] if carry else []))


def classify_language(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, cross_entropy) for every row of docs, learned from rows outside the held-out fold."""
    found = identify(docs, train(docs, folds, held))
    return found.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
