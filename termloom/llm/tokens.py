"""Encoding of a corpus with a public tokenizer, and its exact reversal.

``encode`` runs the tokenizers library over Arrow batches. Special tokens are never produced: their
strings in a text are ordinary text. Defined cases: null and empty texts give an empty list; a text
of any length is encoded whole; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TERMLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE, folder: str | None = None) -> str:
    """Where a vocabulary file lies; the folder is a parameter, the files are never copied."""
    return f"{folder or TOKENIZERS}/{name}"


@lru_cache(maxsize=4)
def load(path: str):  # noqa: ANN201
    """The tokenizer of a file, once for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: Characters handed to the tokenizer at once: bounds memory whatever the length of the texts.
CHUNK = 2_000_000


def _encoded(path: str, texts: list[str]):  # noqa: ANN202
    t, part, size = load(path), [], 0
    for s in texts:
        if part and size + len(s) > CHUNK:
            yield from t.encode_batch(part, add_special_tokens=False)
            part, size = [], 0
        part.append(s)
        size += len(s)
    if part:
        yield from t.encode_batch(part, add_special_tokens=False)


def ids(text: Column, path: str) -> Column:
    """Token ids of a text column as array<int>."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array) -> pa.Array:
        flat, ends = [], [0]
        for e in _encoded(path, [s or "" for s in a.to_pylist()]):
            flat += e.ids
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return run(text)


def count(text: Column, path: str) -> Column:
    """The number of tokens of a text column; only the number leaves the Python worker."""

    @F.arrow_udf("bigint")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([len(e.ids) for e in _encoded(path, [s or "" for s in a.to_pylist()])], pa.int64())

    return run(text)


def spans(text: Column, path: str) -> Column:
    """array<struct<id, start, end>>: each token with the characters it covers.

    A character whose bytes are split over several tokens is covered by each of them.
    """

    @F.pandas_udf("array<struct<id:int,start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"id": i, "start": b, "end": e} for i, (b, e) in zip(x.ids, x.offsets, strict=True)] for x in _encoded(path, [t or "" for t in s])])

    return run(text)


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    table, vocab = byte_table(), json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    return {i: bytes(table[c] for c in t) for t, i in vocab.items() if all(c in table for c in t)}


def decode(ids_: Column, path: str) -> Column:
    """The text of token ids. Bytes of all tokens are joined before they are read as UTF-8, so a
    character split over tokens comes out whole; bytes that form none become U+FFFD. Null is null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        t = token_bytes(path)
        return pd.Series([None if x is None else b"".join(t.get(int(i), b"") for i in x).decode("utf-8", "replace") for x in s], dtype=object)

    return run(ids_)


def encode(df: DataFrame, text: str, path: str, to: str = "ids") -> DataFrame:
    """``df`` with the token ids of column ``text``."""
    return df.withColumn(to, ids(F.col(text), path))
