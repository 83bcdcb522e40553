import random
from collections import Counter

import numpy as np

from logloom.llm.common import word_hashes
from logloom.llm.minhash import BITS, MinMax, bitmap, connected_components, near_duplicates, shingle_sets


def _sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def _expected(rows):
    sets, root = _sets(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out[i, len(sets[k]), c, i == c] += 1
    return out


def _got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_edges(spark, edges, nothing):
    assert _got(near_duplicates(edges)) == _expected([(r["doc_id"], r["text"]) for r in edges.collect()])
    assert near_duplicates(nothing).count() == 0


def test_real(spark, documents):
    assert _got(near_duplicates(documents)) == _expected([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_groups_of_edited_copies_and_shared_passages(spark):
    """A large group whose members are linked in chains, outsiders below the threshold, and texts with a passage in common."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base, passage, rows = [word() for _ in range(150)], [word() for _ in range(60)], []
    for i in range(260):
        t = list(base)
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    for i in range(260, 400):
        rows.append((i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])))
    rng.shuffle(rows)
    assert _got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == _expected(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    name = lambda x: x.to_bytes(4, "big")
    got = {bytes(r[0]): bytes(r[1]) for r in connected_components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    loose = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {name(a): name(r) for a, r in root.items() if a not in loose}


def test_words_and_bounds():
    h, first = word_hashes([b"", b" a  b\x0bc ", b"A b"])
    assert list(first) == [0, 0, 3, 5] and h[0] == h[3] and len(set(h.tolist())) == 3
    assert [len(x) for x in shingle_sets([b"a b c d e f", b"a", b"", b"a a a a a a a"])] == [2, 1, 0, 1]
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 400, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        bx, by = bitmap(x), bitmap(y)
        both = sum(int(a & b).bit_count() for a, b in zip(bx[:-1].view(np.uint64).tolist(), by[:-1].view(np.uint64).tolist(), strict=True))
        assert len(np.intersect1d(x, y)) <= both + min(bx[-1], by[-1]) and len(bx) == BITS // 64 + 1


def test_signatures_estimate_similarity():
    rng, m, agree = np.random.default_rng(1), MinMax(), []
    for _ in range(60):
        u = rng.integers(0, 1 << 63, 500).astype(np.uint64)
        a, b = m.signature(np.unique(u[:400])), m.signature(np.unique(u[100:]))
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.6) < 0.02


def test_word_hashes_do_not_follow_patterns():
    """Thue-Morse words and their complements have equal polynomial hashes modulo powers of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        h, _ = word_hashes([f"{word} {other}".encode()])
        assert h[0] != h[1]


def test_word_hashes_depend_on_the_word_alone():
    words = [b"a" * n for n in (1, 7, 8, 9, 16, 63, 64, 65, 200)] + [b"a" * 8 + b"\0", b"b", b"ab", "é漢字".encode() * 5]
    h, first = word_hashes([b" ".join(words), b"", b"\t\n ", b"x " + words[6].upper()])
    assert len(set(h[: len(words)].tolist())) == len(words) and first.tolist() == [0, len(words), len(words), len(words), len(words) + 2]
    for w, x in zip(words, h.tolist(), strict=False):
        assert word_hashes([b"  " + w])[0].tolist() == [x] == word_hashes([b"q " + w + b"\r"])[0][1:].tolist()
    assert h[-1] == h[6]
