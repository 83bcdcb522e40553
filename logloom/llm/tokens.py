"""Encoding with the tokenizers library, each distinct word once: texts are cut where no token can cross, and words are kept in a bounded table."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Words that a worker keeps; beyond it the table starts anew.
KEPT = 400_000
#: Longer words are encoded but not kept.
KEPT_LENGTH = 64


class WordEncoder:
    """Bytes of little-endian unsigned 32-bit ids for texts.

    ``cut`` splits a text into words whose encodings, one after the other, are the text's. Words that match ``is_plain``, letters
    only, go to ``plain``, the same model without the steps that change nothing for them, many at once between separators; all
    others go to ``full``.
    """

    def __init__(self, full, plain, cut: Callable[[str], list[str]], is_plain: re.Pattern, kept: int = KEPT):
        self.full, self.plain, self.cut, self.is_plain, self.kept = full, plain, cut, is_plain.fullmatch, kept
        (self.separator,) = plain.encode("\0", add_special_tokens=False).ids
        self.table: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            for w, e in zip(some, self.full.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = e.ids
                self.table[w] = struct.pack(f"<{len(ids)}I", *ids)

    def _encode_plain(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            (found,) = self.plain.encode_batch_fast(["\0".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            packed, start = ids.tobytes(), 0
            for w, end in zip(some, [*(4 * np.flatnonzero(ids == self.separator)).tolist(), len(packed)], strict=True):
                self.table[w] = packed[start:end]
                start = end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        table = self.table
        if len(table) > self.kept:
            table.clear()
            table[""] = b""
        words = [w for ws in cut for w in ws]
        found = list(map(table.get, words))  # each word is looked up once; what is missing is filled in
        places, at = [], -1
        try:
            while True:
                at = found.index(None, at + 1)
                places.append(at)
        except ValueError:
            pass
        new = {words[at] for at in places}
        odd = [w for w in new if not self.is_plain(w)]
        self._encode(odd)
        new.difference_update(odd)
        self._encode_plain(list(new))
        for at in places:
            found[at] = table[words[at]]
        out, at = [], 0
        for ws in cut:
            out.append(b"".join(found[at : at + len(ws)]))
            at += len(ws)
        for w in [w for w in (*odd, *new) if len(w) > KEPT_LENGTH]:
            del table[w]
        return out


def quiet() -> None:
    """One thread a worker: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def plain_of(definition: str):
    """The tokenizer of the definition without normalizer and added tokens, its splitting pattern replaced by the separator U+0000."""
    from tokenizers import Tokenizer

    d = json.loads(definition)
    split = {"type": "Split", "pattern": {"String": "\0"}, "behavior": "Isolated", "invert": False}
    return Tokenizer.from_str(json.dumps(d | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, d["pre_tokenizer"]["pretokenizers"][-1]]}}))


# Letters of Latin-1: each is its own normal form, and lower case takes each by itself. (The pattern begins with what is rare,
# so that it is looked for quickly.) Signs between a letter and white space are a match by themselves.
_STOP = re.compile("[!-/:-@[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ][!-/:-@[-`{-~])[!-/:-@[-`{-~]*(?=[ \n]|\\Z)")
#: Unicode's white space, as the pattern's \s has it. (Python's has U+001C to U+001F too.)
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
LOWER_LETTERS = re.compile("[a-zß-öø-ÿ]+")
LED_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def cut_spaces(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """For a tokenizer that lower-cases and drops white space: words between spaces and line feeds, and signs after a letter by themselves.

    A text with one of the ``special`` strings, in whatever case, stays whole, as the tokenizer looks for them first.
    """
    lower = text.lower()
    if special and any(s in lower for s in special):
        return [text]
    try:
        text.encode("latin-1")
        text = lower
    except UnicodeEncodeError:
        pass
    return _STOP.sub(r" \g<0>", text).replace("\n", " ").split(" ")


def cut_before_spaces(text: str) -> list[str]:
    """For a byte-level pattern: pieces begin at white space after another character, as no match holds such a pair or looks across it.

    Where all white space is single spaces and line feeds inside the text (then cutting at these gives what cutting at all white
    space does), a line feed is a match by itself, and so are signs between a letter and white space.
    """
    if "\0" in text or text.replace("\n", " ").split(" ") != text.split():
        return _SAFE.split(text)
    return _STOP.sub("\0\\g<0>", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
