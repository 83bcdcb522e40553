import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logloom.llm import langid, quality, sampling, toxicity


def _held(i, folds, fold):
    return zlib.crc32(b"" if i is None else str(i).encode()) % folds == fold


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = {r["doc_id"]: r for r in quality.classify_quality(docs, labels).collect()}
    t = {r["doc_id"]: r for r in toxicity.classify_toxicity(docs, labels).collect()}
    return q, t, labels.collect(), docs.count()


def test_held_out_quality(scored):
    found, _, labels, n = scored
    held = [(found[r["doc_id"]], r["quality"]) for r in labels if r["quality"] is not None and _held(r["doc_id"], 5, 0)]
    assert len(found) == n and all(f["held_out"] for f, _ in held)
    assert np.mean([f["predicted"] == y for f, y in held]) > 0.98
    assert all(0 <= f["score"] <= 1 and f["predicted"] == (f["score"] >= 0.3) for f in found.values())


def test_held_out_toxicity(scored):
    _, found, labels, n = scored
    held = [(found[r["doc_id"]], r["toxic"]) for r in labels if r["toxic"] is not None and _held(r["doc_id"], 5, 0)]
    recall = np.mean([f["predicted"] for f, y in held if y])
    false = np.mean([f["predicted"] for f, y in held if not y])
    assert len(found) == n and recall >= 0.9 and false < 0.01
    assert all(f["terms"] and f["examples"] for f in found.values() if f["predicted"])


def test_held_out_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = langid.classify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 10000 and all(r["held_out"] == _held(r["doc_id"], 4, 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99 and np.mean([r["rejected"] for r in rows]) < 0.002


def test_edges(spark, edges, nothing, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    ids = Counter(r["doc_id"] for r in edges.collect())
    for out in (quality.classify_quality(edges, labels), toxicity.classify_toxicity(edges, labels), langid.classify_language(edges)):
        rows = out.collect()
        assert Counter(r["doc_id"] for r in rows) == ids and all(0 <= r["score"] <= 1 for r in rows)
    und = {r["doc_id"]: r["lang_pred"] for r in langid.classify_language(edges).collect()}
    assert und[1] == und[2] == und[3] == und[10] == "und" and und[5] == "en"
    assert {r["doc_id"]: r["score"] for r in quality.score_quality(edges, quality.train(documents, labels)).collect()}[1] == 0
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        assert f(nothing, labels).count() == 0 and f(documents, labels.limit(0)).count() == documents.count()
    assert langid.classify_language(nothing).count() == 0
    carried = langid.identify(edges, langid.train(documents), carry=tuple(edges.columns)).select("row.*")
    assert carried.columns == edges.columns and Counter(map(tuple, carried.collect())) == Counter(map(tuple, edges.collect()))


def test_scores_depend_on_the_text_alone(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    other = documents.selectExpr("doc_id + 100000 as doc_id", "text", "'xx' as lang", "'other' as source")
    for train, score in ((quality.train, quality.score_quality), (toxicity.train, toxicity.score_toxicity)):
        model = train(documents, labels)
        a = {r["doc_id"]: r["score"] for r in score(documents, model).collect()}
        b = {r["doc_id"] - 100000: r["score"] for r in score(other.repartition(3), model).collect()}
        assert a == b


def _kneser_ney(texts, order, discount):
    """Interpolated Kneser-Ney by its definition, over dictionaries."""
    grams = [defaultdict(int) for _ in range(order + 1)]
    for t in texts:
        cp, _, _ = langid.symbols([t])
        s = [32] * order + cp.tolist()
        for i in range(order, len(s)):
            grams[order][tuple(s[i - order + 1 : i + 1])] += 1
        for k in range(1, order):
            for i in range(order, len(s)):
                grams[k].setdefault(tuple(s[i - k + 1 : i + 1]), set()).add(s[i - k])
    counts = [None] + [{g: len(v) for g, v in grams[k].items()} for k in range(1, order)] + [dict(grams[order])]
    symbols = len(counts[1]) + 1

    def p(context, x):
        out = 1 / symbols
        for k in range(1, order + 1):
            c = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
            own = {g: n for g, n in counts[k].items() if g[:-1] == c}
            if own:
                total = sum(own.values())
                out = max(own.get((*c, x), 0) - discount, 0) / total + discount * len(own) / total * out
        return out

    return p


def test_kneser_ney_against_its_definition():
    texts = ["the cat sat on the mat", "that hat", "a cat"]
    model = langid.LanguageModels({"en": texts}, order=3)
    p = _kneser_ney(texts, 3, langid.DISCOUNT)
    for t in ("the hat sat", "zebra", "cat"):
        cp, _, _ = langid.symbols([t])
        s = [32] * 3 + cp.tolist()
        want = -sum(math.log(p(s[:i], s[i])) for i in range(3, len(s))) / (len(s) - 3)
        assert model.cross_entropy([t])[0][0, 0] == pytest.approx(want, rel=1e-9)


def _sparse(rng, n, terms):
    out = []
    for _ in range(n):
        at = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        w = rng.random(len(at)) + 0.1
        out.append((at, w / np.linalg.norm(w)))
    return out


def test_index_is_exact(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = _sparse(rng, 300, 20)
    dense = np.zeros((300, 20))
    for row, (at, w) in zip(dense, vectors, strict=True):
        row[at] = w
    exact = dense @ dense.T
    kth = np.sort(exact, axis=1)[:, [-9]]
    for common in (0, 3, 20):
        monkeypatch.setattr(toxicity, "COMMON", common)
        index = toxicity.BlockMaxIndex(vectors, 20, block=16)
        found = np.concatenate([index.cosines(vectors[i : i + 16], 9) for i in range(0, 300, 16)])
        assert len(index.matrix) == common and np.allclose(found[exact >= kth], exact[exact >= kth], atol=1e-6) and (found <= exact + 1e-6).all()
        assert common == 20 or (found < exact - 1e-3).any()  # blocks were skipped
    assert toxicity.BlockMaxIndex([], 20).cosines(vectors[:2], 9).shape == (2, 0)


def _neighbour_votes(examples, rows, texts):
    """The whole operator by its definition, over dictionaries and all pairs."""
    examples = sorted({tuple(e[2]): e for e in sorted(examples, reverse=True)}.values())
    y = [e[1] for e in examples]
    n1, n = sum(y), len(y)
    in_class = [Counter(w for e in examples if e[1] == c for w in set(e[2])) for c in (0, 1)]
    weight = {}
    for t in in_class[0].keys() | in_class[1].keys():
        a, b = in_class[1][t], in_class[0][t]
        if a + b >= 2:
            rf = math.log2(2 + ((a + 2 * n1 / n) / n1) / ((b + 2 * (n - n1) / n) / (n - n1)))
            weight[t] = math.log((1 + n) / (a + b)) * rf

    def vector(words):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in Counter(words).items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(e[2]) for e in examples]

    def vote(v, skip=None):
        cosines = [0.0 if i == skip else round(sum(x * u.get(t, 0.0) for t, x in v.items()), 6) for i, u in enumerate(vectors)]
        least = sorted((c for i, c in enumerate(cosines) if vectors[i]), reverse=True)[toxicity.NEIGHBOURS - 1]
        near = [(1 / (0.05 + 1 - c), y[i]) for i, c in enumerate(cosines) if c >= least and c > 0 and vectors[i]]
        return sum(w * x for w, x in near) / sum(w for w, _ in near) if near else None

    stands = [rows[c] / (n1 if c else n - n1) for c in (0, 1)]
    bare = [i for i, v in enumerate(vectors) if not v] or range(n)
    without = sum(stands[y[i]] * y[i] for i in bare) / sum(stands[y[i]] for i in bare)
    full = [i for i, v in enumerate(vectors) if v]
    raw = np.array([without if (r := vote(vectors[i], i)) is None else r for i in full])
    steps = toxicity.isotonic(raw, np.array([float(y[i]) for i in full]), np.array([stands[y[i]] for i in full]))
    for words in texts:
        v = vector(words)
        r = vote(v) if v else None
        yield without if r is None else steps[1][max(0, np.searchsorted(steps[0], r + 1e-6, side="right") - 1)]


def test_toxicity_against_its_definition(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = documents.unionByName(documents.selectExpr("doc_id + 1000000 as doc_id", "case doc_id % 3 when 0 then '' when 1 then concat(text, ' qqqq') end as text", "lang", "source", "n_chars"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    mark = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and not _held(r["doc_id"], 5, 0)}
    examples = [(i, c, toxicity.tokens(texts[i])) for i, c in mark.items() if i in texts]
    want = dict(zip(texts, _neighbour_votes(examples, Counter(mark.values()), [toxicity.tokens(t) for t in texts.values()]), strict=True))
    found = toxicity.classify_toxicity(docs, labels).collect()
    assert np.mean([abs(r["score"] - want[r["doc_id"]]) < 1e-5 for r in found]) > 0.99
    known = {w for w, c in Counter(w for _, _, e in {tuple(e): (0, 0, e) for _, _, e in examples}.values() for w in set(e)).items() if c >= 2}
    assert all(bool(r["examples"]) == bool(known & {*toxicity.tokens(texts[r["doc_id"]])}) for r in found)


def _shares(text):
    """The features of a text by their definition, as a dictionary of shares."""
    raw, out = text.encode(), Counter()
    kind = lambda b: "letter" if 97 <= b <= 122 or b > 127 else "capital" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "white" if 9 <= b <= 13 else chr(b) if chr(b) in " .,!?|$*%&#" else "other"
    for i in range(len(raw) - 2):
        out["class", *map(kind, raw[i : i + 3])] += 1 / (len(raw) - 2)
        x, y, z = raw[i : i + 3].lower()
        out["hash", ((((x << 16) | (y << 8) | z) * 0x9E3779B1) & 0xFFFFFFFF) >> 20] += 1 / (len(raw) - 2)
    words = raw.lower().split()
    if words:
        out["repeat", 1] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        out["repeat", 2] = sum(a == b for a, b in zip(words, words[2:], strict=False)) / len(words)
        out["repeat", 3] = (len(words) - len(set(words))) / len(words)
    return {k: math.sqrt(v) for k, v in out.items() if v}


def test_quality_against_its_definition(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    mark = [(r["quality"], texts[r["doc_id"]]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts and not _held(r["doc_id"], 5, 0)]
    sets, n = [_shares(t) for _, t in mark], len(mark)
    seen = Counter(k for s in sets for k in s)
    weight = lambda k: math.sqrt(math.log((1 + n) / (1 + max(1, seen[k]))) + 0.1)
    names = {k: i for i, k in enumerate(seen)}
    matrix = np.zeros((n, len(names)))
    for row, s in zip(matrix, sets, strict=True):
        for k, v in s.items():
            row[names[k]] = v * weight(k)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    _, values, axes = np.linalg.svd(np.stack([unit(r) for r in matrix]), full_matrices=False)
    axes = axes[: quality.DIMENSIONS][values[: quality.DIMENSIONS] > 1e-3]
    learned = [unit(axes @ r) for r in matrix]
    close = 0
    for r in quality.classify_quality(documents, labels).collect():
        text = texts[r["doc_id"]]
        s = _shares(text)
        row = np.zeros(len(names))
        for k, v in s.items():
            if k in names:
                row[names[k]] = v * weight(k)
        whole = math.sqrt(sum((v * weight(k)) ** 2 for k, v in s.items()))
        inside = min(1, np.linalg.norm(axes @ row) / max(whole, 1e-12) * math.sqrt(1 + quality.SHORT / max(1, len(text.encode()))))
        near = sorted(((round(float(unit(axes @ row) @ v) * inside, 5), q) for v, (q, _) in zip(learned, mark, strict=True)), reverse=True)
        votes = [(max(c, 0) ** quality.POWER, q) for c, q in near if c >= near[quality.NEIGHBOURS - 1][0]]
        want = sum(v * q for v, q in votes) / (sum(v for v, _ in votes) + quality.NEIGHBOURS * quality.STRANGE**quality.POWER)
        close += abs(want - r["score"]) < 2e-3
    assert close >= 0.98 * len(texts)


def test_scrambled_letters_are_of_low_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    good = [r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) > 200").limit(200).collect()]
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    scrambled = ["".join(str(rng.choice(letters)) if c.isalpha() else c for c in t).encode() for t in good]
    assert model.score([t.encode() for t in good]).min() >= 0.3 and model.score(scrambled).mean() < 0.15


def test_calibration_is_of_all_labelled_rows():
    """Of a sample with as many texts of each class, scores are shares of the rows that it stands for."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    examples = [(i, int(i < 300), rng.choice(words, 8).tolist()) for i in range(600)]  # the words say nothing
    scores = [s for s, _, _ in toxicity.ToxicityModel(examples, {0: 2700, 1: 300}).scores([" ".join(rng.choice(words, 8)) for _ in range(200)])]
    assert 0.03 < np.mean(scores) < 0.25


def test_samples_are_bounded(spark):
    docs = spark.range(6000).selectExpr("id % 10 as doc_id", "concat('text number ', id, repeat(' x', 100)) as text")
    labels = spark.range(40).selectExpr("id % 10 as doc_id", "cast(id % 10 < 5 as int) as toxic")
    rows, counts = sampling.labelled(docs, labels, "toxic", 5, 7, per_class=100)
    assert counts == {0: 5, 1: 5} and 200 < rows.count() < 600
    rows, _ = sampling.labelled(docs, labels, "toxic", 5, 7, per_class=100, most_bytes=20_000)
    used = {r[0]: r[1] for r in rows.groupBy("_label").agg({"_text": "count"}).collect()}
    assert used.keys() == {0, 1} and all(40 <= n <= 46 for n in used.values())


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert x.tolist() == [1, 2, 4] and y.tolist() == [0, 0.5, 1]


def test_gibberish_is_rejected(documents):
    models = langid.train(documents)
    rng = np.random.default_rng(0)
    text = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 6)) for _ in range(50))
    assert models.predict([text])[0][2] and not models.predict([documents.first()["text"]])[0][2]


def test_null_labels_and_languages(spark, documents, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (0, None, None), (10**9, 0, 1)], labels.schema.simpleString().removeprefix("struct<").removesuffix(">")))
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        assert sorted(map(str, f(documents, odd).collect())) == sorted(map(str, f(documents, labels.where("doc_id <> 0")).collect())) or f(documents, odd).count() == documents.count()
    mixed = documents.selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then null else lang end as lang")
    found = langid.classify_language(mixed).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    none = langid.classify_language(documents.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and all(r["rejected"] for r in none)


@pytest.mark.parametrize("out", ["de", "en", "es", "fr"])
def test_an_unlearned_language_is_rejected(spark, out):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = langid.train(docs.where(docs.lang != out))
    rows = [r for r in docs.select("doc_id", "lang", "text").collect() if _held(r["doc_id"], 4, 2)]
    found = [(r["lang"] == out, p[2]) for r, p in zip(rows, models.predict([r["text"] or "" for r in rows]), strict=True)]
    assert np.mean([x for foreign, x in found if foreign]) > 0.95
    assert np.mean([x for foreign, x in found if not foreign]) < 0.005
    # without letters that it has learned, a text of few letters is rejected too
    assert models.predict(["漢字仮名交文章記述言語文字列表"])[0][2]


def test_marks_do_not_break_words():
    cp, first, letters = langid.symbols(["हिन्दी है", "e\u0301t\u0301e", "\u0301\u0302", "a1b"])
    words = ["".join(map(chr, x)) for x in np.split(cp, first[1:])]
    assert [w.split() for w in words] == [["हिन्दी", "है"], ["e\u0301t\u0301e"], ["\u0301\u0302"], ["a", "b"]] and letters.tolist() == [4, 3, 0, 2]
    assert langid.LanguageModels({"hi": ["हिन्दी है"]}).predict(["\u0301\u0302"])[0][0] == "und"
