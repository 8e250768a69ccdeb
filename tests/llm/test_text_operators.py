import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash

from corpusloom.llm import bpe, decontaminate, line_dedup, simhash_dedup, toxicity

DOCS = "doc_id long, text string, word string, keep_words string, fp string"


def brute_lines(rows, least=20, holders=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < holders or max(held[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def awkward_rows():
    common, other = "The Same long Line of all", "é" * 19 + "Ü"
    return [
        (1, f"{common}\nshort\n{other}"), (2, f"  {common.upper()}\t\nown line that nobody shares"), (3, f"{common}\n\n{common}\n{other}\n"),
        (4, None), (5, ""), (6, "\n\n"), (7, other), (7, other), (8, "x" * 300_000), (9, common), (None, common), (10, "short\n" * 70 + f"{common}\n" * 3 + "end"), (11, f"{common}\n" * 130),
    ]


def test_line_dedup_is_brute_force(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(*r, "w", "k", "f") for r in rows], DOCS)
    got = sorted(map(tuple, line_dedup.line_digest(df).collect()), key=str)
    assert got == brute_lines(rows)


def test_line_dedup_keeps_columns_and_bounds_slices(spark):
    rows = [(i, "A line that every document of them holds\nown") for i in range(200)]
    df = spark.createDataFrame([(*r, "w", "k", "f") for r in rows], DOCS)
    out = line_dedup.dedup_lines(df, slices=4)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"] and out.first()["keep_words"] == "k"
    assert {r["doc_id"]: r["n_dropped"] for r in out.collect()} == {i: int(i != 199) for i in range(200)}


def test_rebuilding_is_linear_in_lost_lines(spark):
    import time

    def seconds(n):
        shared = "\n".join(f"Line number {k} that all of the four documents hold" for k in range(n))
        df = spark.createDataFrame([(i, shared) for i in range(4)], "doc_id long, text string")
        began = time.time()
        assert sorted((r["n_lines"], r["n_dropped"]) for r in line_dedup.line_digest(df).collect()) == [(n, 0)] + [(n, n)] * 3
        return time.time() - began

    seconds(100)
    # Splitting again for each lost line took some 25 s for the larger.
    assert seconds(16_000) < 4 * seconds(4000) + 4


def test_ranges_cover_the_partitions_in_order(spark):
    from pyspark.sql import functions as F

    values = [-(1 << 63), -(1 << 62), -1, 0, 1 << 61, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    of = lambda piece: [r[0] for r in df.select(line_dedup.hash_range(F.col("v"), F.lit(piece), 8, 4)).collect()]
    assert of(0) == [0, 2, 3, 4, 5, 7] and of(1) == [2, 4, 5, 6, 7, 1]


def test_lines_dropped_in_place(spark):
    line = "A line that every document of them holds"
    df = spark.createDataFrame([(i, f"{line}\nx", 0, 7.0, "keep", "also") for i in range(3)], "doc_id long, text string, n_chars int, _kept double, _lost string, _row string")
    out = line_dedup.with_lines_dropped(df, length_col="n_chars")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(0, "x", 1, 7.0, "keep", "also"), (1, "x", 1, 7.0, "keep", "also"), (2, f"{line}\nx", 0, 7.0, "keep", "also")]


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_keep_bitmap_marks_lost_lines(spark):
    line = "A line that every document of them holds"
    df = spark.createDataFrame([(1, "a\n" * 64 + line), (2, line), (3, line)], "doc_id long, text string")
    marks = {r["_id"]: [(w["word"], w["bits"]) for w in r["keep_words"]] for r in line_dedup.keep_bitmaps(df).collect()}
    assert marks == {1: [(1, ~1)], 2: [(0, ~1)]}


@pytest.fixture(scope="module")
def ranks():
    return bpe.default_ranks()


def test_tree_encodes_as_the_library_whatever_the_leaf(ranks):
    enc, rnd = bpe.encoding(*ranks), random.Random(3)
    pieces = ["'s", "'re", "'", " ", "  ", "\n", "\t", "abc", "Zebra", "12", "345", "é", "中文字", "🎉", "́", "_", "--", "…", " \n ", "don't", "<|endoftext|>"]
    for k in range(1500):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40)))
        tree = bpe.Tree(*ranks, leaf=rnd.choice([1, 2, 3, 7, 30]))
        ids = tree.encode(text)
        assert ids.tolist() == enc.encode_ordinary(text), repr(text)
        assert tree.decode(ids) == text.encode()


def test_tree_agrees_on_all_code_points(ranks):
    enc, rnd = bpe.encoding(*ranks), random.Random(4)
    for leaf in (1, 2):
        tree = bpe.Tree(*ranks, leaf=leaf)
        # All code points that have or may get a class of their own; beyond are unassigned and private ones.
        for low in range(0x80, 0x40000, 128):
            text = "".join(f"a{chr(c)}'re {chr(c)}\n" for c in range(low, low + 128) if not 0xD800 <= c < 0xE000)
            assert tree.encode(text).tolist() == enc.encode_ordinary(text), hex(low)
    text = ("\u0558" + "'re") * 2000
    assert bpe.Tree(*ranks).encode(text).tolist() == enc.encode_ordinary(text)
    for _ in range(1000):
        text = "".join(chr(rnd.choice((rnd.randrange(0x20, 0x7F), rnd.randrange(0x80, 0x3000), rnd.randrange(0xE000, 0x110000), 32, 10, 39))) for _ in range(rnd.randint(0, 60)))
        assert bpe.Tree(*ranks, leaf=rnd.choice([1, 2, 5])).encode(text).tolist() == enc.encode_ordinary(text), repr(text)


def test_tree_on_unbroken_runs(ranks):
    enc = bpe.encoding(*ranks)
    for text in ("a" * 20_000, "中" * 5000, " " * 9000, "=" * 9000, "1" * 5000 + " " * 5000 + "x"):
        assert bpe.Tree(*ranks, leaf=64).encode(text).tolist() == enc.encode_ordinary(text)


def test_token_digest_with_nulls_and_repeats(spark, ranks):
    path, pattern = ranks
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (None, None), (3, ""), (4, "\n" * 5000)]
    df = spark.createDataFrame([(*r, "w", "k", "f") for r in rows], DOCS)
    got = bpe.token_digest(df, path=path, pattern=pattern).collect()
    enc = bpe.encoding(path, pattern)
    want = sorted((i is None, i or 0, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == want
    assert bpe.token_digest(spark.createDataFrame([], DOCS), path=path, pattern=pattern).collect() == []


def test_encode_and_decode_columns(spark, ranks):
    path, pattern = ranks
    df = spark.createDataFrame([(1, "Round trip, été 2024."), (2, None)], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_texts(df, path=path, pattern=pattern), path=path, pattern=pattern)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.collect()} == {1: "Round trip, été 2024.", 2: ""}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints, parent = [slow_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    return sorted(((i, f"{prints[a]:016x}", min(least[find(a)], default=None)) for a, (i, _) in enumerate(rows)), key=str)


def near_copies(seed, groups=6, copies=12, words=400):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(words)] = f"x{rnd.randint(0, 5000)}"
            rows.append((len(rows) + 10, " ".join(own)))
    return rows


def test_simhash_components_are_brute_force(spark):
    rows = [*near_copies(1), (1, None), (2, ""), (3, " \n\t"), (4, "One word"), (5, "one  WORD"), (5, "one word"), (None, "alone and without an id"), (6, "q " * 100_000)]
    df = spark.createDataFrame([(*r, "w", "k", "f") for r in rows], DOCS)
    assert sorted(map(tuple, simhash_dedup.near_digest(df).collect()), key=str) == brute_components(rows)
    assert simhash_dedup.near_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_blocks_hold_any_three_positions_once():
    from itertools import combinations

    blocks = [set(b) for b in simhash_dedup.BLOCKS]
    assert all(sum(set(c) <= b for b in blocks) == 1 for c in combinations(range(8), 3))
    assert all(set(range(8)) - b in blocks for b in blocks)


def test_links_follow_chains(spark):
    fps = [0]
    for k in range(40):
        fps.append(fps[-1] ^ (0b111 << (3 * (k % 20))) ^ (1 << 63 if k == 20 else 0))
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {tuple(r) for r in simhash_dedup.links(df).collect()} == want


def test_dense_lists_lose_no_link(spark):
    rnd = random.Random(8)
    fps = {rnd.getrandbits(16) | rnd.choice((0, 1 << 63, 5 << 40)) for _ in range(300)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    for dense in (4096, 20):
        assert sorted(tuple(r) for r in simhash_dedup.links(df, dense=dense).collect()) == want


def test_components_of_long_chains_and_large_groups(spark):
    rnd = random.Random(9)
    names = rnd.sample(range(10_000), 400)
    chain = list(zip(names[:150], names[1:150], strict=False))
    star = [(names[200], n) for n in names[201:400]]
    nodes = spark.createDataFrame([(n, n) for n in names], "node long, label long")
    for broadcast_rows in (500_000, 0):
        got = {r["node"]: r["label"] for r in simhash_dedup.components(spark.createDataFrame(chain + star, "a long, b long"), nodes, broadcast_rows=broadcast_rows).collect()}
        assert all(got[n] == min(names[:150]) for n in names[:150]) and all(got[n] == min(names[200:]) for n in names[200:]) and all(got[n] == n for n in names[150:200])


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty red green blue black white grey pink brown gold lime teal navy"


def test_decontamination(spark):
    changed = ITEM.replace("pink", "PURPLE")
    filler = " ".join(f"filler{k}" for k in range(300))
    rows = [(1, f"{filler} {ITEM.upper()}. {filler}"), (2, f"Some words {changed}"), (3, filler), (4, " ".join(ITEM.split()[:20])), (5, None), (6, ""), (7, "tiny item"), (7, "tiny item"), (8, f"{ITEM} {ITEM}"), (None, ITEM), (9, " ".join(reversed(ITEM.split())))]
    items = [(1, ITEM), (2, "Tiny, item!"), (3, None), (4, ""), (5, "nothing of this text occurs anywhere else at all")]
    df = spark.createDataFrame([(*r, "w", "k", "f") for r in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leak_digest(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 2), (8, 1), (None, 1)}
    assert got[1, 1] == got[8, 1] == 1.0 and 0.8 <= got[2, 1] < 1
    assert decontaminate.leak_digest(spark.createDataFrame([], DOCS), bench).collect() == []
    assert decontaminate.leak_digest(df, bench.limit(0)).collect() == []


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, ITEM), (2, "else")], "doc_id long, text string")
    assert [(r["doc_id"], r["similarity"]) for r in decontaminate.leak_digest(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()] == [(1, 1.0)]


def brute_leaks(docs, items, size=5, least=0.8):
    """Best window over all starts, the earliest of equals."""

    def shingles(words):
        return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] or [tuple(words)]

    out = {}
    for d, text in docs:
        for i, item in items:
            words, own = text.split(), item.split()
            for start in range(max(1, len(words) - len(own) + 1)):
                a, b = Counter(shingles(words[start : start + len(own)])), Counter(shingles(own))
                m = sum((a & b).values())
                s = m / (a.total() + b.total() - m)
                if s >= least and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, start)
    return {k: (round(s, 6), start) for k, (s, start) in out.items()}


def test_decontamination_looks_at_all_starts(spark):
    rnd = random.Random(11)
    item = [f"word{k}" for k in range(60)]
    loop = ["one", "two", "three", "four", "five", "six", "seven"] * 5
    edited = ["first", *item[1:38], "new", "words", *item[38:59], "last"]
    around = lambda words: " ".join([*(f"a{k}" for k in range(30)), *words, *(f"b{k}" for k in range(30))])
    docs = [(0, around(edited)), (1, around(loop + loop)), (2, " ".join(item[2:58])), (3, around([*item[:59], "last"]))]
    for d in range(4, 60):
        words = list(item if d % 2 else loop)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.choice((0, len(words) - 1, rnd.randrange(len(words))))
            words[at : at + rnd.randint(0, 1)] = [f"x{rnd.random()}".replace(".", "")] * rnd.randint(0, 2)
        docs.append((d, around(words)))
    items = [(1, " ".join(item)), (2, " ".join(loop))]
    got = decontaminate.leak_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert (0, 1) in {(r["doc_id"], r["item_id"]) for r in got}
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["window_start"]) for r in got} == brute_leaks(docs, items)


def test_decontamination_of_long_documents_and_hot_shingles(spark):
    hot = "this very common run of words stands everywhere"
    item = f"{hot} " + " ".join(f"own{k}" for k in range(30))
    docs = [(k, f"{hot} and then document {k} goes its own way {hot}") for k in range(40)] + [(50, f"{hot} " * 20_000 + item), (51, item), (51, item)]
    items = [(k, f"{hot} " + " ".join(f"item{k}x{n}" for n in range(30))) for k in range(20)] + [(30, item)]
    got = decontaminate.leak_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(50, 30, 1.0, 160_000, 38), (51, 30, 1.0, 0, 38)} and len(got) == 2


def test_decontamination_finds_short_items_in_long_documents(spark):
    docs = [(1, "a b c d e f g two words h two words"), (2, "two"), (3, "two words"), (4, "words two and one alone"), (5, None)]
    items = [(1, "Two words"), (2, "alone"), (3, "c d e f"), (4, "two other words")]
    got = decontaminate.leak_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 1.0, 7, 2), (3, 1, 1.0, 0, 2), (4, 2, 1.0, 4, 1), (1, 3, 1.0, 2, 4)}


def toxic_corpus(n=240):
    rnd = random.Random(5)
    clean = ["river", "window", "table", "garden", "music", "letter", "summer", "winter", "paper", "market", "street", "number"]
    rude = ["worthless", "pathetic", "disgusting", "idiotic"]
    rows = []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(10, 200))]
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_learns_and_shares_misspellings(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "w", "k", "f") for i, t, _ in rows] + [(900, None, "", "", ""), (901, "", "", "", ""), (902, "the wortthless garden pathettic", "", "", "")], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    right = [got[i]["predicted"] == y for i, _, y in rows if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.9
    assert got[902]["predicted"] == 1 and 0 <= got[900]["score"] == got[901]["score"] <= 1
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)


def test_most_toxic_documents_are_found_with_few_labels():
    import zlib

    import pandas as pd

    read = lambda name: pd.read_parquet(f"/root/testdata/sf0.1/{name}.parquet")
    rows = read("documents")[["doc_id", "text"]].merge(read("labels")[["doc_id", "toxic"]], on="doc_id").dropna()
    held = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    settings = toxicity.Settings()
    own = rows[~held & (rows["text"].str.len() <= settings.longest_sampled)]
    model = toxicity.train(own["text"].tolist(), own["toxic"].astype(int).tolist(), settings)
    said, true = model.scores(rows[held]["text"]) >= 0.5, rows[held]["toxic"].to_numpy() == 1
    assert said[true].mean() >= 0.75 and said[~true].mean() <= 0.01


def test_toxicity_of_odd_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "w", "k", "f") for i, t, _ in rows] + [(7, "another text of this id", "", "", ""), (8, rows[8][1], "", "", ""), (950, "garden " * 200_000 + "worthless idiotic pathetic", "", "", "")], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert len(got) == len(rows) + 3 and len({r["score"] for r in got if r["doc_id"] == 8}) == 1
    assert [r["predicted"] for r in got if r["doc_id"] == 950] == [1]
    assert toxicity.toxicity_digest(docs.limit(0), labels).collect() == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "any text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert 0 <= toxicity.toxicity_digest(docs, labels).first()["score"] <= 1


def test_held_out_labels_are_not_read(spark):
    rows = toxic_corpus(90)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, 1, 1 - y if flip and __import__("zlib").crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    scores = lambda flip: {r["doc_id"]: r["score"] for r in toxicity.toxicity_digest(docs, label(flip)).collect()}
    assert scores(False) == scores(True)


def test_library_encoder_is_used_without_special_tokens(ranks):
    assert isinstance(bpe.encoding(*ranks), tiktoken.Encoding)
