import hashlib
import heapq
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversations, media, registry, whitening

# Whitening


VECTORS = "vec_id long, embedding array<float>, label string, x string"


def by_hand(vectors, k=16):
    """n, and for each vector its deviation, and V as a matrix of floats, from Python integers."""
    xs = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, dim = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(dim)]
    z = {x: [n * a - b for a, b in zip(x, s, strict=True)] for x in fit}
    cov = np.array([[sum(v[i] * v[j] for v in z.values()) / n**3 for j in range(dim)] for i in range(dim)])
    return n, xs, z, cov


def test_whitening_against_whole_numbers(spark):
    rng = np.random.default_rng(3)
    made = (rng.standard_normal((300, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32)
    made[250:] = made[:50]
    rows = [(k, v.tolist(), None, "y") for k, v in enumerate(made)]
    odd = [(900, None, None, None), (901, [1.0] * 19 + [None], None, None), (902, [float("nan")] * 20, None, None), (903, [float("inf")] * 20, None, None), (904, [1.0, 2.0], None, None), (905, [], None, None), (None, made[0].tolist(), None, None), (0, made[0].tolist(), None, None)]
    got = whitening.whiten_digest(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).toPandas()
    n, xs, z, cov = by_hand(made)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert n == 250 and set(got["n"]) == {n} and len(got) == (300 + 2) * 16 and got["vec_id"].isna().sum() == 16
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    one = got[got["vec_id"] == 7].sort_values("component")
    assert np.allclose(one["explained"], values[:16] / np.trace(cov), rtol=1e-12)
    first = got[got["vec_id"] < 300].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    assert first.groupby("vec_id")["deviation"].first().tolist() == [sum(a * a for a in z[x]) for x in xs]
    white = first["whitened"].to_numpy().reshape(300, 16)
    want = np.array([[a / n for a in z[x]] for x in xs]) @ vectors[:, :16] / np.sqrt(values[:16])
    sign = np.sign((white * want).sum(axis=0))
    assert np.allclose(white * sign, want, atol=1e-9)


def test_slices_multiply_exactly():
    rng = np.random.default_rng(5)
    for bound in (10, 1 << 20, (1 << 20) + 1, 1 << 41, (1 << 61) - 1):
        z = rng.integers(-bound, bound, (5000, 3), endpoint=True)
        whole = z.astype(object)
        assert (whitening.gram(z, bound) == whole.T @ whole).all()
        assert (whitening.gram(whole, bound) == whole.T @ whole).all()
    for value in (0, 1, -1, 1 << 32, -(1 << 32), (1 << 90) + 17, -(1 << 90) - 17):
        assert sum(d << (32 * p) for p, d in whitening.digits(value)) == value


def test_whitening_of_few_and_of_large_vectors(spark):
    one = whitening.whiten_digest(spark.createDataFrame([(1, [1.0, 2.0], None, None), (2, [1.0, 2.0], None, None)], VECTORS)).collect()
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(v, c, 1, 0, None, None, 0.0) for v in (1, 2) for c in (1, 2)}
    assert whitening.whiten_digest(spark.createDataFrame([(1, None, None, None)], VECTORS)).collect() == []
    large = [(k, [float(np.float32(v)) for v in (k * 1e13, (k * k % 7) * 1e12, 3.0)], None, None) for k in range(9)] + [(77, [1e30, 0.0, 0.0], None, None)]
    got = whitening.whiten_digest(spark.createDataFrame(large, VECTORS)).toPandas()
    n, xs, z, cov = by_hand([v for _, v, _, _ in large[:9]])
    assert sorted(set(got["vec_id"])) == list(range(9)) and set(got["component"]) == {1, 2, 3}
    far = [sum(a * a for a in z[x]) for x in xs]
    assert [None if np.isnan(d) else int(d) for d in got.groupby("vec_id")["deviation"].first()] == [d if d < 1 << 63 else None for d in far]
    values = np.linalg.eigvalsh(cov)[::-1]
    assert np.allclose(got[got["vec_id"] == 0]["explained"], values / np.trace(cov), atol=1e-12) and got[got["component"] == 3]["whitened"].isna().all()


# Media


def test_media_gives_back_every_byte():
    rng = np.random.default_rng(7)
    texts = [b"", b"a", b"x" * 575, b"y" * 576, b"z" * 577, bytes(rng.integers(0, 256, 20_000, dtype=np.uint8)), bytes([0, 255] * 3000), b"\xff" * 1152, bytes(range(256)) * 9]
    payloads = [media.padded(t) for t in texts]
    assert [len(p) for p in payloads[:5]] == [576, 576, 576, 576, 1152]
    files = media.to_media(payloads)
    assert [s for s, _, _ in media.from_media(files)] == payloads and files == media.to_media(payloads)


def test_jpeg_scan_read_bit_by_bit():
    """Another reading of a frame: one code at a time, by the table that the frame itself holds."""
    rng = np.random.default_rng(9)
    samples = rng.integers(0, 256, (3, 576), dtype=np.uint8)
    samples[1] = 65
    for jpeg, want in zip(media.encode_frames(samples), samples, strict=True):
        at, table = 2, {}
        while True:
            marker, size = struct.unpack_from(">xBH", jpeg, at)
            if marker == 0xC4:
                code, lengths, symbols = 0, jpeg[at + 5 : at + 21], iter(jpeg[at + 21 : at + 2 + size])
                for length, n in enumerate(lengths, 1):
                    for _ in range(n):
                        table[f"{code:0{length}b}"] = next(symbols)
                        code += 1
                    code <<= 1
            at += 2 + size
            if marker == 0xDA:
                break
        assert jpeg[-2:] == b"\xff\xd9"
        bits, place, grid = "".join(f"{b:08b}" for b in jpeg[at:-2].replace(b"\xff\0", b"\xff")), 0, np.zeros((24, 24), int)
        for r in range(24):
            for c in range(24):
                end = place + 1
                while bits[place:end] not in table:
                    end += 1
                n = table[bits[place:end]]
                extra = bits[end : end + n]
                d = 0 if n == 0 else int(extra, 2) if extra[0] == "1" else int(extra, 2) - (1 << n) + 1
                place = end + n
                grid[r, c] = d + (grid[r, c - 1] if c else grid[r - 1, 0] if r else 128)
        assert grid.ravel().tolist() == want.tolist() and set(bits[place:]) <= {"1"} and len(bits) - place < 8


def test_frames_are_found_by_the_index():
    [file] = media.to_media([b"a" * 576 + b"b" * 576 + b"c" * 576])
    assert struct.unpack_from("<I", file, 4)[0] == len(file) - 8
    at = file.index(b"idx1") + 8
    entries = [file[at + 16 * k : at + 16 * k + 16] for k in range(3)]
    turned = file[:at] + b"".join(reversed(entries)) + file[at + 48 :]
    assert media.from_media([turned])[0][0] == b"c" * 576 + b"b" * 576 + b"a" * 576
    for broken in (b"", b"RIFF\0\0\0\0WAVE", file[:12], file.replace(b"idx1", b"idx2")):
        with pytest.raises((ValueError, struct.error)):
            media.from_media([broken])


def test_shots_end_where_histograms_jump():
    rng = np.random.default_rng(11)
    scene = lambda lo, n: [rng.integers(lo, lo + 60, 576, dtype=np.uint8).tobytes() for _ in range(n)]
    assert media.shots(scene(0, 10) + scene(120, 6) + scene(60, 7)) == [0, 10, 16]
    assert media.shots(scene(0, 12)) == [0] and media.shots([]) == [] and media.shots([b"a" * 576]) == [0]


def test_media_of_odd_rows(spark):
    texts = ["", None, "é" * 400, "same", "same", "long " * 60_000]
    docs = spark.createDataFrame([(k if k else None, t, "m", 1) for k, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    got = sorted(media.media_digest(docs).collect(), key=lambda r: r["doc_id"] or 0)
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    assert got[3][1:] == got[4][1:] and got[0][1:] == got[1][1:]
    files = media.with_media(docs)
    assert {r["doc_id"]: len(r["media"]) for r in files.collect()} == {r["doc_id"]: r["media_bytes"] for r in got}
    clips = media.clips(files).where("doc_id = 5").orderBy("clip").collect()
    assert clips[0]["start_s"] == 0 and sum(c["frames"] for c in clips) == got[5]["payload_bytes"] // 576 and [c["first_frame"] for c in clips] == [int(x) for x in got[5]["feature"].split("at ")[1].split(", ")]
    assert clips[-1]["end_s"] == pytest.approx(got[5]["payload_bytes"] / 576 / 25)
    assert media.media_digest(docs.limit(0)).collect() == [] and media.clips(files.limit(0)).collect() == []


# Conversations


TURN = "conv_id long, turn long, role string, text string, audit string"
GO = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows, must_go, cut):
    """The cheapest edits, ASCII-least, and what they leave, one edit at a time by a heap."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        for initial in GO[state]:
            if initial in NAMES:
                heapq.heappush(heap, (cost + 5, audit + "I", i, initial, (*kept, NAMES[initial] + ":")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
            for initial in GO[state] if not must_go[i] else ():
                if role[:1] == initial:
                    heapq.heappush(heap, (cost + 5 * cut[i], audit + "K", i + 1, initial, (*kept, f"{role}:{text}")))
                if initial in NAMES:
                    heapq.heappush(heap, (cost + 1 + 5 * cut[i], audit + "R", i + 1, initial, (*kept, f"{NAMES[initial]}:{text}")))
    raise AssertionError


def repaired_by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        bare = [t.strip(" \t\n\x0b\x0c\r") for _, _, t in own]
        blank = [b == "" for b in bare]
        again = [not blank[i] and own[i][1:] in [o[1:] for o in own[:i]] for i in range(len(own))]
        cut = [not blank[i] and not again[i] and bare[i][-1] not in ".!?" for i in range(len(own))]
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, kept = cheapest([o[1:] for o in own], [b or a for b, a in zip(blank, again, strict=True)], cut)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(blank), sum(again), sum(cut), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def random_turns(seed, convs=40, most=14):
    rng = random.Random(seed)
    texts = ["Hello.", "What?", "no end", "", " \t", None, "Yes!", "same. ", "x "]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ua"]), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randint(0, 5)}."))
    return rows


@pytest.mark.parametrize("bits", [8, 2])
def test_repair_against_one_edit_at_a_time(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "STRETCH_BITS", bits)
    rows = random_turns(bits)
    # Some 3000 turns of one conversation: ten times over 256 of them, or over 4 * 4 * 4 * 4.
    rows += [(1000, k, ("user", "assistant", "assistant")[k % 3], f"Turn {k % 700}.") for k in range(300 if bits == 2 else 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], TURN)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_digest(df).collect()}
    want = repaired_by_hand(rows)
    assert {k for k in want if got.get(k) != want[k]} == set() and got.keys() == want.keys()
    turns = conversations.repaired(conversations.damaged(df)).collect()
    whole = {}
    for t in sorted(turns, key=lambda t: t["place"]):
        whole.setdefault(t["conv_id"], []).append(f"{t['role']}:{t['text']}")
    assert {k: hashlib.sha256("\n".join(whole.get(k, [])).encode()).hexdigest() for k in want} == {k: w[-1] for k, w in want.items()}
    assert conversations.repair_digest(df.limit(0)).collect() == [] and conversations.repaired(conversations.damaged(df.limit(0))).collect() == []


def test_repair_sql_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    rows = random_turns(5, convs=60)
    db = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    db.register("conversations", frame)
    want = {r[0]: r[1:] for r in db.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({registry.REPAIR_SQL})").fetchall()}
    df = spark.createDataFrame([(*r, "x") for r in rows], TURN)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_digest(df).collect()}
    assert got == want


def test_common_rows_are_counted_before_they_meet(spark):
    same = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"), F.lit("").alias("audit"))
    [row] = conversations.repair_digest(same).collect()
    assert (row["conv_id"], row["duplicate"], row["blank"], row["cost"]) == (None, 2999, 0, 6000) and row["audit"] == "D" * 3000
    assert conversations.digests(conversations.damaged(same)).count() == 1
