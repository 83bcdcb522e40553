import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import bpe, packing
from logloom.llm.tokens import LED_LETTERS, LOWER_LETTERS, WordEncoder, cut_before_spaces, cut_spaces, plain_of

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
DEFINITION = bpe.tokenizer_json(RANKS, P.PATTERN)
TABLE = bpe.byte_table(DEFINITION)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BYTES = WordEncoder(Tokenizer.from_str(DEFINITION), plain_of(DEFINITION), cut_before_spaces, LED_LETTERS)
WORD_JSON = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
WORD = Tokenizer.from_str(WORD_JSON)
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORDS = WordEncoder(WORD, plain_of(WORD_JSON), partial(cut_spaces, special=SPECIAL), LOWER_LETTERS, kept=50)

_TEXT = st.text(st.sampled_from(list("abcDÉñß .,!?'s\n\t \x1c\u0085\0é漢🙂ſİΣ́019-_<|>")), max_size=60) | st.text(max_size=40)


@settings(max_examples=400, deadline=None)
@given(_TEXT)
def test_byte_level_is_tiktoken(text):
    ids = np.frombuffer(BYTES.encode([text])[0], "<u4")
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert bpe.decode(ids, TABLE) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.lists(_TEXT, max_size=4))
def test_word_level_is_the_tokenizer(texts):
    want = [e.ids for e in WORD.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.encode(texts)] == want


#: What texts of mixed white space are made of: words, signs and letters beyond ASCII, and white space of every kind, tabs and blank lines most of all.
_PARTS = ["id", "name", "a", "don't", "x1", "Été", "é", "漢字", "e\u0301", "\u0301", "!", "...", "'s", "'", "(b)", "—", "-", "_", "🙂", "\0", "<|endoftext|>", "<|EndOfText|>", "<|", "ſ", "İ"]
_GAPS = ["\t", "\t", "\n\n", "\r\n", "\r", "\u00a0", "\u0085", "\u2003", "\u3000", "\u2028", "\x1c", "\x1f", "\v", "  ", " \n", "\n ", "", ""]


def _mixed(seed: int, n: int):
    rng = random.Random(seed)
    for _ in range(n):
        odd = rng.choice((0.02, 0.2, 0.7))
        gap = lambda: rng.choice(_GAPS) if rng.random() < odd else rng.choice("  \n")  # noqa: E731, B023
        yield "".join(x for _ in range(rng.randint(1, 60)) for x in (rng.choice(_PARTS), gap()))


def test_mixed_white_space():
    texts = ["id\tname\tvalue\n\n", *_mixed(3, 50_000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in BYTES.encode(some)] == TIKTOKEN.encode_ordinary_batch(some, num_threads=4)
        assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.encode(some)] == [e.ids for e in WORD.encode_batch(some, add_special_tokens=False)]


def test_special_strings_in_words():
    for text in ("a <|endoftext|> b", "a<|endoftext|>!", "<|EndOfText|> x", "<|endoftext|>", "Ñ<|startoftext|>漢 <|endoftext|", "<|STARTOFTEXT|><|startoftext|>"):
        assert np.frombuffer(WORDS.encode([text])[0], "<u4").tolist() == WORD.encode(text, add_special_tokens=False).ids


def test_special_strings_are_text():
    assert np.frombuffer(BYTES.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == TIKTOKEN.encode_ordinary("a <|endoftext|> b")


def test_spans_of_split_characters():
    text = "ab 🙂é"
    ids = np.array(TIKTOKEN.encode_ordinary(text))
    starts, first, last = bpe.spans(ids, np.array([len(t) for t in TABLE]), text.encode())
    raw = text.encode()
    ends = [*starts[1:], len(raw)]
    for i, s, e, a, b in zip(ids, starts, ends, first, last, strict=True):
        assert TABLE[i] == raw[s:e] and raw[s:e] in text[a:b].encode()


def test_encode_decode_edges(spark, edges, nothing):
    got = bpe.encode_decode(edges, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=("ids", "byte_starts", "char_starts", "char_ends", "decoded"))
    want = Counter()
    for r in edges.collect():
        t = r["text"] or ""
        ids = TIKTOKEN.encode_ordinary(t)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids), t.encode()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
    assert bpe.encode_decode(nothing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def _pieces(rows):
    out = Counter()
    for i, t in rows:
        ids = np.array([*WORD.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            out[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    return out


def _valid(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("which", ["edges", "documents", "nothing"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    rows = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == _pieces([(r["doc_id"], r["text"]) for r in docs.collect()])
    n = _valid(rows)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) * 1.25 + 1


def _best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms.remove(fit)
            rooms.append(fit - x)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    plan = packing.plan(Counter(lengths), 30)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in plan:
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            used[s].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == Counter(lengths) and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 30
    assert len(used) == _best_fit(lengths, 30)


def test_a_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "case when id % 3 = 0 then 700L else 1 + id % 2048 end as length", "0L as ids_crc32")
    rows = packing.place(pieces).collect()
    assert len(rows) == 5000 and len({r["doc_id"] for r in rows}) == 5000
    _valid(rows)


def test_sequences_hold_the_ids(spark, documents):
    packed = packing.pack(documents, P.path("word_bpe_49k.json"), keep_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) <= 2048 and r["ids"].count(0) <= len(r["doc_ids"])
    total = packed.selectExpr("sum(length)").first()[0]
    assert sum(len(r["ids"]) for r in packing.sequences(packed).select("ids").collect()) == total


def test_ranks_file():
    token, rank = next(iter(RANKS.items()))
    assert base64.b64decode(open(P.path("byte_bpe_50k.tiktoken"), "rb").readline().split()[0]) == token and rank == RANKS[token]
