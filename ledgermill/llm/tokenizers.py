"""Encoding with a byte-level BPE vocabulary of the installed public tokenizer files."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: Where the public tokenizer files lie; a parameter of every function here.
DEFAULT_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the byte_bpe rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text longer than this many characters is cut at safe places before encoding.
LONG_TEXT = 20_000
#: Before a space or line feed between letters or digits: no piece of the pattern spans that place.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n][\p{L}\p{N}])")

_encoders: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Place of a rank file; the same path must exist on every worker."""
    return os.path.join(folder or DEFAULT_DIR, f"{name}.tiktoken")


def encoder(path: str):
    """The encoding of a local rank file, made once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def segments(text: str, size: int = LONG_TEXT) -> list[str]:
    """text in parts of about `size` characters whose encodings, put together, are text's own encoding.

    A part ends only at a safe place; where none follows, the part grows, so a text without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def encode_text(text: str | None, path: str) -> list[int]:
    if not text:
        return []
    enc = encoder(path)
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    return [i for part in segments(text) for i in enc.encode_ordinary(part)]


def encode(text: Column, path: str | None = None) -> Column:
    """Token ids (ARRAY<INT>) of a string column. Empty and null text give an empty list; special tokens are plain text."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([encode_text(t, path) for t in s], dtype=object)

    return run(text)


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens (BIGINT) of a string column; 0 for empty and null text."""
    path = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([len(encode_text(t, path)) for t in s], dtype="int64")

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Bytes (BINARY) of lists of token ids; raw bytes, as a list may end inside a character. Null gives null."""
    path = path or vocabulary_path()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else encoder(path).decode_bytes(list(map(int, x))) for x in s], dtype=object)

    return run(ids)


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) of every row; other columns, whatever their names, are left out. Repeated rows stay repeated."""
    return df.select(F.col(id_col), encode(F.col(text_col), path).alias("ids"))
