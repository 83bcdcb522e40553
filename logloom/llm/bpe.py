"""Byte-level BPE: encoding by the tokenizers library over Arrow batches from a tiktoken rank file, byte offsets, and decoding by the reversed byte table."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import chunks, lean
from logloom.llm.tokens import LED_LETTERS, WordEncoder, cut_before_spaces, plain_of, quiet


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers definition that merges by rank: every split of a token into two tokens is a merge, in the order of the ranks.

    A match that is a token itself is taken whole, as tiktoken does. (Other special handling: none.)
    """
    chars = byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [[name[t[:i]], name[t[i:]]] for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": None, "model": model})


def byte_table(definition: str) -> list[bytes]:
    """The bytes of each id, by reversing the byte-to-character mapping over the vocabulary."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = json.loads(definition)["model"]["vocab"]
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of the ids. A character split between tokens is whole again once their bytes are joined."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def spans(ids: np.ndarray, table_lengths: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: its first byte, its first character and the character after its last. Tokens that share a split character all cover it."""
    ends = np.cumsum(table_lengths[ids])
    starts = ends - table_lengths[ids]
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    return starts, char[starts] if len(starts) else starts, char[ends - 1] + 1 if len(ends) else ends


_WORKER: dict[str, tuple] = {}


def _worker(key: str, definition: str) -> tuple[WordEncoder, list[bytes], np.ndarray]:
    if key not in _WORKER:
        from tokenizers import Tokenizer

        quiet()
        table = byte_table(definition)
        _WORKER.clear()
        _WORKER[key] = WordEncoder(Tokenizer.from_str(definition), plain_of(definition), cut_before_spaces, LED_LETTERS), table, np.fromiter(map(len, table), np.int64, len(table))
    return _WORKER[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, ids_sha256, decoded_sha256, then of ``keep`` any of ids, byte_starts, char_starts, char_ends, decoded).

    ids are those that tiktoken gives without special tokens. The vocabulary (of the size of the file) is broadcast.
    A null text counts as empty (no tokens); very long ones are encoded whole; repeated rows and tied ids give repeated rows; an
    empty table none; more columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    definition = tokenizer_json(read_ranks(ranks_path), pattern)
    key = hashlib.sha256(definition.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(definition)
    kinds = {"ids": "array<long>", "byte_starts": "array<long>", "char_starts": "array<long>", "char_ends": "array<long>", "decoded": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, lengths = _worker(key, shared.value)
        for batch in batches:
            for part in chunks(batch, "_text"):
                texts = part.column(1).to_pylist()
                out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", *keep)}
                for text, packed in zip(texts, encoder.encode(texts), strict=True):
                    ids = np.frombuffer(packed, "<u4")
                    back = decode(ids, table)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                    more = {"ids": ids.astype(np.int64), "decoded": back}
                    if {"byte_starts", "char_starts", "char_ends"} & {*keep}:
                        more |= zip(("byte_starts", "char_starts", "char_ends"), spans(ids, lengths, back), strict=True)
                    for k in keep:
                        out[k].append(more[k])
                types = {"n_tokens": pa.int64(), "decoded": pa.binary()} | {k: pa.list_(pa.int64()) for k in kinds if k != "decoded"}
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, types.get(k, pa.string())) for k, v in out.items()]], names=["doc_id", *out])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {kinds[k]}" for k in keep))
