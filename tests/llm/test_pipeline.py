import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from test_text_operators import brute_components, brute_lines

import corpus_pipeline
from corpusloom.llm import bpe, registry, toxicity


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, data)
        assert out.columns == docs.columns
        rows = out.collect()
        seen[name] = {r["doc_id"]: r["text"] for r in rows}
        kept = spark.createDataFrame(rows, docs.schema)
    assert set(seen["decontaminate"]) <= set(seen["near_dedup"]) <= set(seen["line_dedup"]) == set(seen["toxicity"])
    last = corpus_pipeline.STAGES[-1][1](spark, kept, data).collect()
    assert {r["doc_id"] for r in last} == set(seen["decontaminate"])


def test_near_dedup_keeps_one_of_each_group(spark, data):
    same = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(3, same, "en"), (1, same, "en"), (1, same, "en"), (2, "other words", None), (None, same, None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_dedup(spark, docs, data)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_rows_are_told_apart_by_text_too(spark, data):
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(50))
    leak = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    rows = [(1, words("a")), (None, words("a")), (None, words("b")), (None, words("c")), (None, words("c")), (2, words("d")), (2, words("e")), (2, words("e")), (3, None), (None, None)]
    docs = lambda xs: spark.createDataFrame([(*r, "en") for r in xs], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_dedup(spark, docs(rows), data)
    order = lambda xs: sorted(xs, key=str)
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == order([(1, words("a")), (None, words("b")), (None, words("c")), (2, words("d")), (2, words("e")), (3, None)])
    rows = [(None, leak), (None, words("a")), (5, f"{words('b')} {leak}"), (5, words("c")), (6, None), (None, None)]
    out = corpus_pipeline.decontaminate(spark, docs(rows), data)
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == order([(None, words("a")), (5, words("c")), (6, None), (None, None)])


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def holds(text, items, size=5, least=0.8):
    """Whether any window of an item's length is similar enough to it; items have five words or more."""
    words = words_of(text)
    grams = [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    for own, shingles in items:
        at = [k for k, g in enumerate(grams) if g in own]
        wide = min(shingles, len(grams))
        for start in {s for k in at for s in range(max(0, k - wide + 1), min(k, len(grams) - wide) + 1)}:
            window = Counter(grams[start : start + wide])
            shared = (window & own).total()
            if shared >= least * (window.total() + own.total() - shared):
                return True
    return False


def test_the_pipeline_is_its_stages_by_brute_force(spark, data):
    """Every stage after the classifier against plain Python, each on what the stage before kept; the classifier against its own model."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [r for r in rows if model.scores([r[1]])[0] < 0.5]
    after = [rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    lost = lambda i, line: len(key(line)) >= 20 and len(held[key(line)]) >= 3 and max(held[key(line)]) != i
    rows = [(i, t if t is None else "\n".join(x for x in t.split("\n") if not lost(i, x))) for i, t in rows]
    digests = {r[0]: r[3] for r in brute_lines(after[0])}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == digests[i] for i, t in rows)
    after.append(rows)
    least = {i for i, _, c in brute_components(rows) if i == c}
    rows = [r for r in rows if r[0] in least]
    after.append(rows)
    items = []
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        words = words_of(r["text"])
        assert len(words) >= 5
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        items.append((grams, grams.total()))
    rows = [r for r in rows if not holds(r[1], items)]
    after.append(rows)
    assert len(after[0]) > len(after[2]) > len(after[3]) > 0
    given = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], after, strict=True):
        out = stage(spark, given, data).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(want, key=str)
        given = spark.createDataFrame(out, docs.schema)
    enc = bpe.encoding(*bpe.default_ranks())
    want = [(i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(want)


CLASHING = "doc_id long, text string, score double, _score double, row string, id long, sig long, _kept string, _hot string, leak string, label int, fp string"


def clashing_rows(data, spark):
    leak = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(40))
    line = "A line that three of these documents have in common"
    texts = [(1, words("a")), (1, words("a")), (2, words("a")), (3, None), (4, ""), (None, words("b")), (5, f"{words('c')} {leak}"), (6, f"{line}\n{words('d')}"), (7, f"{line}\n{words('e')}"), (8, f"{line}\n{words('f')}"), (9, "long " * 50_000), (9, "long " * 50_000)]
    return [(i, t, 7.0, 8.0, "row", 9, 10, "kept", "hot", "leak", k, "fp") for k, (i, t) in enumerate(texts)]


def test_stages_keep_odd_rows_and_columns_of_any_name(spark, data):
    rows = clashing_rows(data, spark)
    docs = spark.createDataFrame(rows, CLASHING)
    order = lambda xs: sorted(map(tuple, xs), key=str)
    stages = dict(corpus_pipeline.STAGES)
    out = stages["toxicity"](spark, docs, data)
    assert out.columns == docs.columns and order(out.collect()) == order(rows)
    out = stages["line_dedup"](spark, docs, data)
    line = rows[7][1].split("\n")[0]
    want = [(r[0], r[1].removeprefix(line + "\n") if r[0] in (6, 7) else r[1], *r[2:]) for r in rows]
    assert out.columns == docs.columns and order(out.collect()) == order(want)
    out = stages["near_dedup"](spark, docs, data)
    kept = out.collect()
    assert out.columns == docs.columns and order((r["doc_id"], r["text"]) for r in kept) == order({(r[0], r[1]) for r in rows if r[0] not in (2, 4)})
    assert order(stages["near_dedup"](spark, docs.repartition(3), data).collect()) == order(kept)
    out = stages["decontaminate"](spark, docs, data)
    assert out.columns == docs.columns and order(out.collect()) == order(r for r in rows if r[0] != 5)
    assert stages["tokens"](spark, docs, data).count() == len(rows)


def test_stages_of_an_empty_table(spark, data):
    docs = spark.createDataFrame([], CLASHING)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).collect() == []


def test_every_operator_is_registered():
    numbers = {int(name[2:].split("_")[0]) for name in registry.QUERIES}
    assert numbers == set(range(1, 14))
