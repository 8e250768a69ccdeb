"""Hash functions: dataset buckets and the 64-bit text SimHash."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.core import let

GRAM = 4
WEIGHT_CAP = 50
_WORDS = re.compile(r"[\w\u4e00-\u9fcc]+")


def split_bucket(salt: str, identifier: Column) -> Column:
    """test, val or train by the first byte of SHA-256 of ``salt:id``: below 26, below 52, the rest."""
    byte = F.conv(F.substr(F.sha2(F.concat(F.lit(salt + ":"), identifier.cast("string")), 256), F.lit(1), F.lit(2)), 16, 10).cast("int")
    return F.when(byte < 26, F.lit("test")).when(byte < 52, F.lit("val")).otherwise(F.lit("train"))


def simhash_grams(text: Column) -> Column:
    """Character 4-grams of the joined lower-cased word characters; the whole if shorter, none if empty."""
    joined = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1), "")
    # By an array of characters, since finding a place in a string walks it from its start.
    gram = lambda cs, i: F.concat(*(F.get(cs, i + k) for k in range(GRAM)))
    slide = lambda cs: F.transform(F.sequence(F.lit(0), F.size(cs) - GRAM), lambda i: gram(cs, i))
    return let(joined, lambda j: F.when(j == "", F.array().cast("array<string>")).when(F.length(j) < GRAM, F.array(j)).otherwise(let(F.filter(F.split(j, "", -1), lambda c: c != ""), lambda cs: slide(cs))))


def _gram_hash(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode()).digest()[-8:], "big")


def simhash_of(text: str | None) -> int:
    """The signed 64-bit SimHash; 0 for texts without word characters."""
    return int(simhashes([text])[0])


def simhashes(texts, most_chars: int = 1 << 20) -> np.ndarray:
    """The signed SimHash of each text.  Stretches of texts with some ``most_chars`` characters together are hashed at once."""
    joined = ["".join(_WORDS.findall((t or "").lower())) for t in texts]
    out, lo, held = [], 0, 0
    for hi, text in enumerate(joined, 1):
        held += len(text)
        if held >= most_chars or hi == len(joined):
            out.append(_stretch(joined[lo:hi]))
            lo, held = hi, 0
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _stretch(joined: list[str]) -> np.ndarray:
    """Grams are told apart as four 16-bit numbers of characters, so each is hashed once, whatever the number of texts that have it."""
    points = np.frombuffer("".join(joined).encode("utf-32-le"), "<u4")
    used = np.zeros(0x110000, bool)
    used[points] = True
    alphabet = np.flatnonzero(used)
    if len(alphabet) > 1 << 16:
        half = len(joined) // 2
        return np.concatenate([_stretch(joined[:half]), _stretch(joined[half:])]) if half else np.array([_plain(joined[0])], np.int64)
    number = np.zeros(0x110000, np.uint64)
    number[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    coded = number[points]
    size = max(0, len(coded) - GRAM + 1)
    keys = np.zeros(size, np.uint64)
    for k in range(GRAM):
        keys = (keys << np.uint64(16)) | coded[k : k + size]
    grams, counts, starts, at = [], [], [0], 0
    for text in joined:
        own, n = np.unique(keys[at : at + len(text) - GRAM + 1], return_counts=True) if len(text) >= GRAM else (keys[:0], np.zeros(0, np.int64))
        grams.append(own)
        counts.append(n)
        starts.append(starts[-1] + len(own))
        at += len(text)
    every, place = np.unique(np.concatenate(grams), return_inverse=True) if grams else (keys, np.zeros(0, np.int64))
    chars = [chr(c) for c in alphabet]
    hashes = np.fromiter((_gram_hash(chars[k >> 48] + chars[k >> 32 & 0xFFFF] + chars[k >> 16 & 0xFFFF] + chars[k & 0xFFFF]) for k in every.tolist()), np.uint64, len(every))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(len(joined), np.int64)
    for i, text in enumerate(joined):
        if len(text) >= GRAM:
            weights = np.minimum(counts[i], WEIGHT_CAP)
            sums = weights.astype(np.float64) @ bits[place[starts[i] : starts[i + 1]]]
            out[i] = np.packbits((2 * sums > weights.sum()).astype(np.uint8), bitorder="little").view("<i8")[0]
        elif text:
            out[i] = np.uint64(_gram_hash(text)).astype(np.int64)
    return out


def _plain(joined: str) -> int:
    """For one text with more than 65,536 different characters."""
    counts = Counter(joined[i : i + GRAM] for i in range(len(joined) - GRAM + 1))
    sums, total = np.zeros(64, np.int64), 0
    for gram, n in counts.items():
        weight = min(n, WEIGHT_CAP)
        sums += weight * np.unpackbits(np.array([_gram_hash(gram)], "<u8").view(np.uint8), bitorder="little").astype(np.int64)
        total += weight
    return int(np.packbits((2 * sums > total).astype(np.uint8), bitorder="little").view("<i8")[0])


def simhash64(text: Column) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(simhashes(texts))

    return hashed(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_near(a: Column, b: Column, threshold: int = 3) -> Column:
    return hamming(a, b) <= threshold
