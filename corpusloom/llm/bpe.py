"""Byte-level BPE as a monoid, reduced over a binary tree.

A node is the token ids of one stretch of text.  A stretch longer than ``leaf`` characters
is halved; neighbours are joined by re-encoding a window over their boundary.  The window
grows until both its ends are *safe cuts*: places where the pre-tokenising pattern starts a
new match whatever stands on the other side, namely from a letter to anything but a letter,
from a digit to anything but a digit, and from anything but white space to white space.  No
alternative of the pattern crosses such a place, and none looks past it except to end a
greedy run there, so tokens outside the window are the same in the whole text.  Characters
count as letters, digits or white space here only where every version of Unicode agrees,
since the library that encodes has tables of its own; others make no cut.  Where a
side has no safe cut (one unbroken run), the window is that whole side.  Decoding is the
same tree with byte concatenation as its operation.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 2048
FIRST_WINDOW = 64


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The leaf encoder for a file of ranks; one per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Letters of every version of Unicode (Latin, Cyrillic, kana, ideographs, Hangul), ASCII and wide marks that
#: are no letters, and what some version calls white space or once did.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ff\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
NO_LETTERS = "\\x00-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
SPACES = "\x00-\x20\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
SAFE_CUT = re.compile(rf"(?<=[{LETTERS}])(?=[{NO_LETTERS}])|(?<=[0-9])(?=[\x00-/:-~])|(?<=[^{SPACES}])(?=[ \t\n\r])")


class Tree:
    """Encodes and decodes by halves with one leaf encoder."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        self.enc, self.leaf = encoding(path, pattern), max(1, leaf)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self._encode(text, 0, len(text)), dtype="<u4")

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._last_cut(text, lo, mid), self._first_cut(text, mid, hi)
        of = self.enc.encode_ordinary
        stale_left, stale_right = len(of(text[start:mid])), len(of(text[mid:end]))
        return left[: len(left) - stale_left] + of(text[start:end]) + right[stale_right:]

    def _last_cut(self, text: str, lo: int, mid: int) -> int:
        """The last safe cut of text[lo:mid], else lo."""
        reach = FIRST_WINDOW
        while True:
            start = max(lo, mid - reach)
            cuts = [m.start() for m in SAFE_CUT.finditer(text, max(lo, start - 1), mid) if start < m.start() < mid]
            if cuts:
                return cuts[-1]
            if start == lo:
                return lo
            reach *= 4

    def _first_cut(self, text: str, mid: int, hi: int) -> int:
        """The first safe cut of text[mid:hi], else hi."""
        reach = FIRST_WINDOW
        while True:
            end = min(hi, mid + reach)
            for m in SAFE_CUT.finditer(text, mid, end):
                if mid < m.start() < end:
                    return m.start()
            if end == hi:
                return hi
            reach *= 4

    def decode(self, ids: np.ndarray) -> bytes:
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids: np.ndarray, lo: int, hi: int) -> bytes:
        if hi - lo <= self.leaf:
            return self.enc.decode_bytes(ids[lo:hi].tolist())
        mid = (lo + hi) // 2
        return self._decode(ids, lo, mid) + self._decode(ids, mid, hi)


def default_ranks() -> tuple[str, str]:
    """The many-language ranks and their pattern, from the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, *, text_col: str = "text", path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``docs`` with a column ``token_ids`` (array<long>): the ids of the whole text, [] for null or empty.

    A column of that name gives way; other columns and repeated rows stay as they are.
    """

    @F.pandas_udf("array<long>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = Tree(path, pattern, leaf)
        for batch in texts:
            yield pd.Series([tree.encode(t or "").astype("int64") for t in batch], dtype=object)

    return docs.withColumn("token_ids", ids(F.col(text_col)))


def decode_ids(tokens: DataFrame, *, ids_col: str = "token_ids", path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``tokens`` with a column ``decoded`` (binary), which gives way if it is there: the bytes of the ids; empty for null or no ids."""

    @F.pandas_udf("binary")
    def decoded(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = Tree(path, pattern, leaf)
        for batch in arrays:
            yield pd.Series([b"" if a is None else tree.decode(np.asarray(a)) for a in batch], dtype=object)

    return tokens.withColumn("decoded", decoded(F.col(ids_col)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digest(docs: DataFrame, *, path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Per row of ``docs``: id, number of tokens and hashes of the ids and of the bytes that they decode to.

    Ids and bytes are hashed in the worker that made them, so neither is sent anywhere.  A
    null text is an empty one.  Repeated rows have a row each, and an empty table has none;
    a very long text takes the memory of its own tokens.  Columns other than ``doc_id`` and
    ``text`` are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(path, pattern, leaf)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = tree.encode(text or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, DIGEST)
