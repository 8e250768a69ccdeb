"""Media columns: texts as motion-JPEG AVI files, read back through the RIFF index, cut into shots.

A payload is dealt into frames of 24 x 24 grey samples.  Each is a lossless JPEG (a scan of
process 14: differences from the sample to the left, Huffman-coded), an intra frame that
needs no other.  The frames of many documents are coded and decoded in step: sample by sample
of a frame, for all frames at once, so the work per sample is numpy's, and a document's
length does not matter.

Reading starts from the file's bytes alone: the RIFF chunks, the index of the frames, each
frame's own header with its size and its Huffman table.  A shot ends where the histograms of
neighbouring frames differ by more than what the differences before it make likely.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE, RATE = 24, 25
UNIT = SIDE * SIDE
#: Bytes of payload that are coded at once.
STRETCH = 4 << 20
#: Code lengths and symbols of the usual table for differences.
TABLE = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
#: 8-bit samples differ by 255 at most, which is category 8: 6 bits of code and 8 more.
WIDEST = 14
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """``{category: (code, length)}`` of a Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, length)
            code += 1
        code, at = code << 1, at + n
    return out


@functools.lru_cache
def coder() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference, from -255 to 255."""
    known, bits, sizes = codes(*TABLE), np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = known[category]
        bits[d + 255] = code << category | (d if d >= 0 else d + (1 << category) - 1)
        sizes[d + 255] = length + category
    return bits, sizes


@functools.lru_cache
def decoder(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 14 bits that may come next: the difference, shifted by 5, and how many of the bits it takes; 0 bits where no code is."""
    out = np.zeros(1 << WIDEST, np.int32)
    for category, (code, length) in codes(counts, symbols).items():
        size = length + category
        if category <= 8 and size <= WIDEST:
            for extra in range(1 << category):
                d = extra if category == 0 or extra >> (category - 1) else extra - (1 << category) + 1
                lo = (code << category | extra) << (WIDEST - size)
                out[lo : lo + (1 << (WIDEST - size))] = d * 32 + size
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Start of image, frame (lossless, 8 bits, one component), table, scan (predictor 1).
HEADER = b"\xff\xd8" + segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + segment(0xC4, b"\0" + TABLE[0] + TABLE[1]) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
END = b"\xff\xd9"


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 576 samples."""
    pixels = frames.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = pixels.copy()
    d[:, 0, 0] -= 128
    d[:, 1:, 0] -= pixels[:, :-1, 0]
    d[:, :, 1:] -= pixels[:, :, :-1]
    bits, sizes = coder()
    d = d.reshape(len(pixels), UNIT) + 255
    size = sizes[d]
    ends = np.cumsum(size, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at = ends - size + 8 * first[:, None]
    # A code has 14 bits at most, so it touches three bytes; bits of different codes never overlap.
    value = (bits[d].astype(np.int64) << (24 - size - (at & 7))).ravel()
    at = (at >> 3).ravel()
    total = int(n_bytes.sum())
    packed = sum(np.bincount(at + k, weights=value >> (16 - 8 * k) & 0xFF, minlength=total + 2) for k in range(3))[:total].astype(np.uint8)
    packed[first + n_bytes - 1] |= ((1 << (8 * n_bytes - ends[:, -1])) - 1).astype(np.uint8)
    # A byte 255 is followed by a zero, so that it is no marker.
    full = packed == 255
    stuffed = np.repeat(packed, 1 + full)
    stuffed[np.flatnonzero(full) + np.cumsum(full)[full]] = 0
    more = np.concatenate(([0], np.cumsum(full)))
    edges = np.append(first, total)
    edges = (edges + more[edges]).tolist()
    raw = stuffed.tobytes()
    return [HEADER + raw[lo:hi] + END for lo, hi in zip(edges, edges[1:], strict=False)]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(jpegs: list[bytes]) -> bytes:
    """An AVI file of grey 24 x 24 frames, 25 a second, with its index."""
    largest, n = max(map(len, jpegs)), len(jpegs)
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", UNIT, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    sizes = np.array([len(j) for j in jpegs], np.int64)
    step = 8 + sizes + (sizes & 1)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, 4 + np.cumsum(step) - step, sizes
    body = b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", j) for j in jpegs)) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """``(name, start, end)`` of the chunks between two places."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def frame_places(data: bytes) -> tuple[np.ndarray, float]:
    """``(start, end)`` of each frame, from the file's index, and how many frames a second has; what is no AVI file raises."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, rate = None, None, float(RATE)
    for name, lo, hi in chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"idx1":
            index = np.frombuffer(data[lo:hi], "<u4").reshape(-1, 4)
        elif name == b"LIST" and data[lo : lo + 4] == b"movi":
            movi = lo
        elif name == b"LIST" and data[lo : lo + 4] == b"hdrl":
            rate = next((1e6 / struct.unpack_from("<I", data, at)[0] for own, at, _ in chunks(data, lo + 4, hi) if own == b"avih"), rate)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    index = index[index[:, 0] == int.from_bytes(b"00dc", "little")].astype(np.int64)
    start = movi + index[:, 2] + 8
    return np.column_stack((start, start + index[:, 3])), rate


@functools.lru_cache(maxsize=256)
def read_header(header: bytes) -> tuple[int, int, bytes, bytes]:
    """``(height, width, code lengths, symbols)`` of a frame's segments up to its scan; other kinds than ours raise."""
    at, size, table = 2, None, None
    while at < len(header):
        marker, length = struct.unpack_from(">xBH", header, at)
        body = header[at + 4 : at + 2 + length]
        if marker == 0xC3:
            bits, height, width, components = struct.unpack_from(">BHHB", body)
            size = (height, width) if (bits, components) == (8, 1) else None
        elif marker == 0xC4:
            table = (body[1:17], body[17 : 17 + sum(body[1:17])])
        elif marker == 0xDA and body[-3] != 1:
            raise ValueError("only the predictor to the left is read")
        at += 2 + length
    if size is None or table is None:
        raise ValueError("no lossless frame of one 8-bit component")
    return *size, *table


def scan_start(jpeg: memoryview) -> int:
    """Where a frame's coded samples begin."""
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + (jpeg[at + 2] << 8 | jpeg[at + 3])
    return at + 2 + (jpeg[at + 2] << 8 | jpeg[at + 3])


def decode_frames(jpegs: list[memoryview]) -> list[bytes]:
    """The samples of each frame; frames with one header are decoded in step."""
    starts = [scan_start(j) for j in jpegs]
    groups: dict[bytes, list[int]] = {}
    for k, (jpeg, start) in enumerate(zip(jpegs, starts, strict=True)):
        groups.setdefault(bytes(jpeg[:start]), []).append(k)
    out: list[bytes] = [b""] * len(jpegs)
    for header, members in groups.items():
        height, width, counts, symbols = read_header(header)
        samples = decode_scans([jpegs[k][starts[k] : -2] for k in members], height, width, decoder(counts, symbols))
        for k, own in zip(members, samples, strict=True):
            out[k] = own.tobytes()
    return out


def decode_scans(scans: list[memoryview], height: int, width: int, known: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b"".join(scans), np.uint8)
    sizes = np.array([len(s) for s in scans])
    kept = np.ones(len(raw), bool)
    kept[1:] = (raw[1:] != 0) | (raw[:-1] != 255)
    first = np.cumsum(sizes) - sizes
    at = 8 * (np.concatenate(([0], np.cumsum(kept)))[first])
    plain = np.concatenate((raw[kept], np.zeros(3, np.uint8))).astype(np.uint32)
    # The 24 bits from each byte on hold the 14 that may be needed, wherever they begin in it.
    ahead = plain[:-2] << 16 | plain[1:-1] << 8 | plain[2:]
    d = np.empty((height * width, len(scans)), np.int32)
    for k in range(height * width):
        found = known[ahead[np.minimum(at >> 3, len(ahead) - 1)] >> (10 - (at & 7)).astype(np.uint32) & ((1 << WIDEST) - 1)]
        d[k] = found >> 5
        at += found & 31
    pixels = np.ascontiguousarray(d.T).reshape(-1, height, width)
    pixels[:, 0, 0] += 128
    pixels[:, :, 0] = np.cumsum(pixels[:, :, 0], axis=1)
    return np.cumsum(pixels, axis=2).astype(np.uint8)


def to_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, which is a positive multiple of 576 bytes long."""
    counts, jpegs = [len(p) // UNIT for p in payloads], []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    for lo in range(0, len(samples), STRETCH // UNIT):
        jpegs += encode_frames(samples[lo : lo + STRETCH // UNIT])
    out, at = [], 0
    for n in counts:
        out.append(avi(jpegs[at : at + n]))
        at += n
    return out


def from_media(files: list[bytes]) -> list[tuple[bytes, float, list[int]]]:
    """``(samples, frames a second, first frame of each shot)`` of each AVI file."""
    placed = [frame_places(f) for f in files]
    views = [memoryview(f)[lo:hi] for f, (places, _) in zip(files, placed, strict=True) for lo, hi in places.tolist()]
    frames: list[bytes] = []
    for lo in range(0, len(views), STRETCH // UNIT):
        frames += decode_frames(views[lo : lo + STRETCH // UNIT])
    out, at = [], 0
    for places, rate in placed:
        own = frames[at : at + len(places)]
        out.append((b"".join(own), rate, shots(own)))
        at += len(places)
    return out


def shots(frames: list[bytes], *, bins: int = 16, window: int = 8, factor: float = 2.0, least: float = 0.1) -> list[int]:
    """The first frame of each shot.

    A frame begins a shot if its histogram of ``bins`` grey levels differs from the one
    before by more than ``least`` of all samples and by more than ``factor`` times the mean
    of the last ``window`` differences; the first difference has nothing to be held against.
    """
    if len(frames) < 3:
        return [0] if frames else []
    levels = np.stack([np.bincount(np.frombuffer(f, np.uint8) * np.uint16(bins) >> 8, minlength=bins) / max(1, len(f)) for f in frames])
    moved = np.abs(np.diff(levels, axis=0)).sum(axis=1) / 2
    sums = np.concatenate(([0.0], np.cumsum(moved)))
    at = np.arange(1, len(moved))
    lo = np.maximum(0, at - window)
    usual = (sums[at] - sums[lo]) / (at - lo)
    cut = (moved[1:] > least) & (moved[1:] > factor * usual)
    return [0, *(np.flatnonzero(cut) + 2).tolist()]


def padded(text: bytes) -> bytes:
    """``text`` followed by bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (UNIT * max(1, -(-len(text) // UNIT)) - len(text))


def stretches(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to some 4 MB."""
    lo, held, hi = 0, 0, 0
    for hi, size in enumerate(sizes, 1):
        held += size
        if held >= STRETCH:
            yield lo, hi
            lo, held = hi, 0
    if lo < hi:
        yield lo, hi


def with_media(docs: DataFrame, *, text_col: str = "text", out: str = "media") -> DataFrame:
    """``docs`` with a binary column of AVI files, which gives way if it is there; null texts are empty ones."""

    @F.pandas_udf("binary")
    def stored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            payloads, files = [padded(t or b"") for t in batch], []
            for lo, hi in stretches(map(len, payloads)):
                files += to_media(payloads[lo:hi])
            yield pd.Series(files, dtype=object)

    return docs.withColumn(out, stored(F.col(text_col).cast("string").cast("binary")))


def clips(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``(doc_id, clip, first_frame, frames, start_s, end_s)``: a row for each shot of each AVI file, from 0; null files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lo, hi in stretches(map(len, batch["media"])):
                own = batch.iloc[lo:hi]
                for key, (samples, rate, first) in zip(own["doc_id"], from_media(own["media"].tolist()), strict=True):
                    ends = [*first[1:], len(samples) // UNIT]
                    rows += [(key, k, a, b - a, a / rate, b / rate) for k, (a, b) in enumerate(zip(first, ends, strict=True))]
            yield pd.DataFrame(rows, columns=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    kind = files.schema[id_col].dataType.simpleString()
    chosen = files.where(F.col(media_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    return chosen.mapInPandas(run, f"doc_id {kind}, clip int, first_frame long, frames long, start_s double, end_s double")


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; ``feature`` is the number of frames and the first frame of each shot.

    Files are made, read back and hashed in one worker, in stretches of some 4 MB of
    payload, so they are sent nowhere.  A null text is an empty one, of one frame.  Null and
    repeated ids have their rows like any others, and an empty table has none; a very long
    text takes the memory of its own file (which the format limits to 4 GB).  Columns other
    than ``doc_id`` and ``text`` are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or b"" for t in batch["text"]]
            rows = []
            for lo, hi in stretches(map(len, texts)):
                files = to_media([padded(t) for t in texts[lo:hi]])
                for text, file, (samples, _, first) in zip(texts[lo:hi], files, from_media(files), strict=True):
                    feature = f"{len(samples) // UNIT} frames; shots at " + ", ".join(map(str, first))
                    rows.append((len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInPandas(run, DIGEST)
