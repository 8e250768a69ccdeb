import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dataset, dedupe, labelling, quality, reports, scoring, summaries
from corpusloom.operators.articles import extracted, ingest
from corpusloom.sources import feeds, storage
from corpusloom.streaming import incremental

NOW = dt.datetime(2024, 1, 10)


def brute_near(rows, days=2):
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    return {(a[0], b[0]) for a, b in itertools.combinations(order, 2) if b[2] - a[2] <= dt.timedelta(days) and ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 3}


def hashes(seed, n=120):
    rnd, rows = random.Random(seed), []
    bases = [rnd.getrandbits(64) for _ in range(6)] + [0]
    for i in range(n):
        h = rnd.choice(bases)
        for _ in range(rnd.randint(0, 4)):
            h ^= 1 << rnd.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h, NOW + dt.timedelta(hours=rnd.randint(0, 200))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_and_greedy_keep(spark, seed):
    rows = hashes(seed)
    df = spark.createDataFrame(rows, "id long, simhash long, fetched_at timestamp")
    pairs = dedupe.near_pairs(df)
    assert {(r["earlier"], r["later"]) for r in pairs.collect()} == brute_near(rows)
    near, kept = brute_near(rows), set()
    for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if not any((j, i) in near for j in kept):
            kept.add(i)
    for most in (5_000_000, 10, 0):
        assert {r["id"] for r in dedupe.keep_first(df, most=most).where("kept").collect()} == kept


def test_near_hashes_agree_in_four_bytes(spark):
    assert len(dedupe.BYTE_SETS) == 14 and all(any(not set(three) & set(s) for s in dedupe.BYTE_SETS) for three in itertools.combinations(range(8), 3))
    rnd = random.Random(9)
    rows = []
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long").withColumn("n", F.monotonically_increasing_id())
    one, two = (df.select("n", dedupe.keys_of(F.col(c))) for c in "ab")
    assert one.join(two, ["n", "band", "key"]).select("n").distinct().count() == 300 and one.select("key").where("key >= 0").count() == 300 * 14


def test_many_copies_make_no_pairs(spark):
    df = spark.range(20_000).select("id", F.lit(7).cast("long").alias("simhash"), (F.lit(NOW) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("fetched_at"))
    df = df.unionByName(spark.createDataFrame([(30_000, None, NOW), (30_001, 7, None)], "id long, simhash long, fetched_at timestamp"))
    # A copy is kept as soon as the last kept one is more than two days back.
    assert {r["id"] for r in dedupe.keep_first(df).where("kept").collect()} == {30_000, 30_001, *range(0, 20_000, 2881)}
    assert dedupe.keep_first(df.limit(0)).collect() == []


def test_first_seen_and_caps(spark):
    df = spark.createDataFrame([("f", 3, "a"), ("f", 1, "b"), ("f", 2, "a"), ("g", 1, "c")], "feed string, pos int, u string")
    assert {r["pos"] for r in dedupe.first_seen(df.where("feed = 'f'"), "u", F.col("pos")).collect()} == {1, 2}
    assert dedupe.cap_items(df, 2, by=["feed"], order="pos").count() == 3 and dedupe.cap_items(df, 0, by=["feed"], order="pos").count() == 4


SOURCE = "Đội tuyển thắng 2 0 hôm qua, các năm 2019 và 2024. Nguyễn Văn A ghi bàn, ông Simeone vui."
LIMITS = quality.Thresholds(3, 30, 1, 5)


def checked(spark, summary, source=SOURCE, refusal=None):
    df = spark.createDataFrame([(summary, source, refusal)], "summary string, source_text string, refusal_reason string")
    return quality.quality(df, limits=LIMITS).first()["qc"]


@pytest.mark.parametrize(
    ("summary", "passed"),
    [("Đội thắng 2-0 hôm qua.", True), ("Các năm 2019-2024 rất vui.", True), ("Tỷ số là 5-5 hôm qua.", False), ("Có 9.999 người đến xem.", False), ("Nguyễn Văn  A ghi bàn hôm nay.", True), ("HLV Simeone vui hôm nay.", True), ("HLV Khac vui hôm nay lắm.", False), ("Trần Bình Khôi ghi bàn thắng.", False)],
)
def test_quality_support(spark, summary, passed):
    assert checked(spark, summary)["passed"] == passed


def test_quality_limits_and_nulls(spark):
    assert [r.split(":")[0] for r in checked(spark, None, None, "no facts")["reasons"]] == ["llm_refusal", "too_short", "too_few_sentences"]
    assert checked(spark, "một " * 31)["reasons"][0] == "too_long:31>30"


def test_partial_ratio_is_exhaustive():
    def slow(a, b):
        if len(a) > len(b):
            a, b = b, a
        best = 0.0
        for w in {b[max(0, s) : s + len(a)] for s in range(1 - len(a), len(b))}:
            table = [[0] * (len(w) + 1) for _ in range(len(a) + 1)]
            for i, j in itertools.product(range(len(a)), range(len(w))):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == w[j] else max(table[i][j + 1], table[i + 1][j])
            best = max(best, 200 * table[-1][-1] / (len(a) + len(w)))
        return best

    rnd = random.Random(4)
    for _ in range(150):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, n))) for n in (6, 15))
        assert quality.partial_ratio(a, b) == pytest.approx(slow(a, b))


def test_the_whole_check_agrees_with_sql(spark, tmp_path):
    import duckdb

    from corpusloom.plans import catalog, lifecycle  # noqa: F401  the second adds its queries

    source = "Nguyen Van Anh met Tran Quoc Bao in 2019 near the \"old\" market, and 1.500 people came. " * 2
    replies = ["Nguyen Van Anhh met Tran Quoc Baoo near the market and many people came to see them.", "Pham Xyz Quoz Jqk met Tren Qoc Beo; 77 people, 2019.", "Short.", "One. Two. Three. Four. Five. Six. Seven words and more follow here.", "Zqx Wvv Kkj Pqq and Hjj Ffw Xxz Qqk came in 1.500 and 9.999.", "word " * 70, ""]
    rows = [r for k, reply in enumerate(replies) for r in ((k, 0, "user", source[: 60 + 40 * k]), (k, 1, "assistant", reply))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["qc"] for r in catalog.QUERIES["qc_battery_fuzzy"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name, columns in (("documents", "0 AS doc_id, '' AS text, 'src1' AS source, '' AS lang"), ("events", "0 AS event_id, TIMESTAMP '2024-01-01' AS ts"), ("labels", "0 AS doc_id, 0 AS quality")):
        db.execute(f"CREATE VIEW {name} AS SELECT {columns}")
    want = {(c, t): qc for c, t, qc in db.execute(f"SELECT conv_id, turn, qc FROM ({lifecycle.QC_SQL})").fetchall()}
    assert got == want and len(got) == len(replies)
    assert json.loads(got[0, 0])["missing_entities"] == [] and len(json.loads(got[4, 0])["missing_entities"]) == 2


def test_seeds_miss_no_window():
    rnd = random.Random(6)
    words = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    hits, looked, every = 0, 0, 0
    for _ in range(3000):
        letters = rnd.choice(("ab", "abcd ", "abcdefghijklmnop "))
        long, short = words(rnd.randint(0, 60), letters), words(rnd.randint(0, 14), letters)
        if long and rnd.random() < 0.6:
            at = rnd.randrange(len(long))
            short = list(long[at : at + rnd.randint(1, 20)])
            for _ in range(rnd.randint(0, 3)):
                place = rnd.randrange(len(short) + 1)
                short[place : place + rnd.randint(0, 1)] = words(rnd.randint(0, 1), letters)
            short = "".join(short)
        ratio = rnd.choice((0.6, 0.75, 0.85, 0.9, 1.0, 0.3))
        assert quality.reaches(short, long, ratio) == (quality.partial_ratio(short, long) >= 100 * ratio), (short, long, ratio)
        hits += quality.reaches(short, long, ratio)
        if ratio == 0.85 and len(letters) > 10 and 0 < len(short) <= len(long):
            looked, every = looked + len(quality.window_starts(short, long, ratio)), every + len(long) + len(short) - 1
    assert 500 < hits < 2500 and looked < every


def test_work_follows_the_seeds():
    text = "The river runs by the market, and the long road goes home past it. " * 300
    assert quality.window_starts("Quetzal Xylophone", text, 0.85) == []
    one = text[:9000] + " Quetzal Xylofone " + text[9000:]
    assert len(quality.window_starts("Quetzal Xylophone", one, 0.85)) < 60 and quality.reaches("Quetzal Xylophone", one, 0.85)


def test_label_batch(spark):
    good = json.dumps({"summary": "Đội tuyển thắng hôm qua.", "key_entities": [], "confidence": 0.9})
    df = spark.createDataFrame([(1, "good", SOURCE), (2, "bad", SOURCE), (3, "boom", SOURCE), (4, "garbage", SOURCE)], "id int, prompt string, source_text string")

    def call(prompt):
        if prompt == "boom":
            raise RuntimeError("429 always")
        return {"good": good, "bad": json.dumps({"summary": "x", "confidence": 0.1}), "garbage": "{"}[prompt]

    out = storage.cut_lineage(labelling.label(df, call, limits=LIMITS))
    assert {r["id"]: r["outcome"] for r in out.collect()} == {1: "passed", 2: "failed", 3: "error", 4: "error"}
    assert labelling.label_counts(out).first().asDict() == {"requested": 4, "labelled": 2, "qc_passed": 1, "qc_failed": 1, "llm_errors": 2, "qc_pass_rate": 0.5}


def test_reply_with_raw_newline(spark):
    df = spark.createDataFrame([('{"summary": "a\nb", "confidence": 0.5}',)], "raw string")
    assert df.select(labelling.parse_reply(F.col("raw")).alias("p")).first()["p"]["summary"] == "a\nb"


def test_second_pass_has_nothing_to_label(spark):
    arts = spark.createDataFrame([(1, 1, "cleaned", "t", NOW), (2, 1, "cleaned", None, NOW), (3, 1, "new", "t", NOW), (4, 2, "summarized", "t", None)], "id int, source_fk int, status string, content_text string, published_at timestamp")
    labels = spark.createDataFrame([(1, "llm", "v1", True)], "article_fk int, source string, prompt_version string, qc_passed boolean")
    assert [r["id"] for r in labelling.unlabelled(arts, labels.limit(0), prompt_version="v1").collect()] == [1, 4]
    assert [r["id"] for r in labelling.unlabelled(arts, labels, prompt_version="v1").collect()] == [4]
    assert labelling.unlabelled(arts, labels, prompt_version="v2").count() == 2


def test_dataset_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", f"u{i}", "t", None, None, "c", "y", "v1", "train" if i else "val") for i in range(3)], "article_id long, source string, url string, title string, category string, published_at string, content_text string, summary string, prompt_version string, split string")
    with pytest.raises(FileNotFoundError):
        storage.read_split(spark, str(tmp_path), "train")
    (tmp_path / "train.jsonl").write_text('{"article_id": "7", "title": null}\n\n{"url": "u"}\n', encoding="utf-8")
    got = storage.read_split(spark, str(tmp_path), "train").orderBy("article_id").collect()
    assert [(r["article_id"], r["title"], r["category"]) for r in got] == [(0, "", None), (7, "", None)]
    storage.write_dataset(rows, f"{tmp_path}/out")
    assert storage.read_split(spark, f"{tmp_path}/out", "train").count() == 2
    assert '"category":null' in next((tmp_path / "out/split=train").glob("*.json")).read_text()


def test_manifest_of_bitmaps(spark):
    ids = [-70_000, -32_768, -1, 0, 1, 2, 32_768, 32_769, 98_304, 98_305, 10**12]
    rows = spark.createDataFrame([(i, ("train", "val", "test")[k % 3]) for k, i in enumerate(ids)] + [(2, "test"), (None, "val"), (1, "val"), (1, "val")], "article_id long, split string")
    made = storage.cut_lineage(dataset.manifest(rows, "v1"))
    want = {(s, i) for i, s in rows.collect() if i is not None}
    got = [(r["split"], r["article_id"]) for r in dataset.manifest_ids(made).collect()]
    assert set(got) == want and len(got) == len(want) and {r["name"] for r in made.collect()} == {"v1"}
    assert {r["split"]: r["n"] for r in dataset.manifest_counts(made).collect()} == {s: sum(x == s for x, _ in want) for s in ("train", "val", "test")}
    asked = spark.createDataFrame([(i,) for i in (*ids, 3, 99, -2, None)], "article_id long")
    found = {r["article_id"]: r["split"] for r in dataset.split_of(asked, made).collect()}
    assert {i for i, s in found.items() if s is None} == {3, 99, -2, None} and all((s, i) in want for i, s in found.items() if s)
    assert dataset.manifest_ids(dataset.manifest(rows.limit(0), "v1")).collect() == []


def test_tokenized_and_training_rows(spark):
    df = spark.createDataFrame([("a b c", "x"), ("", "y"), ("d", "")], "content_text string, summary string")
    rows = dataset.training_rows(df, text="missing")
    assert rows.count() == 1
    got = dataset.tokenized(rows, lambda: lambda t, n: [len(w) for w in t.split()][:n], most_text=2).first()
    assert got.asDict() == {"input_ids": [1, 1], "attention_mask": [1, 1], "labels": [1]}
    assert spark.createDataFrame([([-100, 5],)], "ids array<int>").select(dataset.pad_negative(F.col("ids"), 0).alias("x")).first()["x"] == [0, 5]


TEXT = "The cat sat on the mat. A dog ran in the park. The cat and the dog met. Birds sang all day long. The end came late."


@pytest.mark.parametrize("graph", ["lexrank", "textrank"])
def test_summaries(graph):
    o = summaries.Options(graph=graph, max_sentences=2, max_words=15)
    out = summaries.summarize(TEXT, o)
    assert 0 < len(out.split()) <= 15 and summaries.summarize("", o) == summaries.summarize(None, o) == ""
    assert summaries.summarize("one two three four five", summaries.Options(graph, max_words=4)) == "one two three four"


def test_summaries_by_a_segmenter_of_ones_own():
    o = summaries.Options(max_sentences=1, sentences=lambda t: t.split("|"), words=lambda s: s.split("_"))
    assert summaries.summarize("a_b_c | a_b_d | x_y", o) in ("a_b_c", "a_b_d")


def test_tables_of_a_database(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for place in (f"jdbc:derby:{tmp_path}/db;create=true", str(tmp_path / "tables")):
        storage.save(rows, place, "things", mode="overwrite")
        storage.save(rows.where("id = 2"), place, "things")
        got = storage.load(spark, place, "things").collect()
        assert sorted((r[0], r[1]) for r in got) == [(1, "a"), (2, "b"), (2, "b")]


def test_graphs_and_rank():
    tokens = [s.lower().split() for s in TEXT.split(". ")]
    for graph in (summaries.overlap_graph(tokens), summaries.cosine_graph(tokens, 0.0)):
        assert np.allclose(graph, graph.T) and not np.diag(graph).any()
    assert np.allclose(summaries.cosine_graph([[], []], 0.1), np.eye(2))
    assert np.allclose(summaries.rank(4, lambda s: s.sum() - s), 0.25) and summaries.rank(0, lambda s: s).size == 0
    assert np.allclose(summaries.rank(3, lambda s: 0 * s), 0.05)


def long_text(n, words=3000, seed=2):
    rnd = random.Random(seed)
    pick = lambda: f"w{int(words * rnd.random() ** 3)}"
    return [[pick() for _ in range(rnd.choice((0, 1, 5, 8, 12, 20)))] for _ in range(n)]


def ranked(graph, damping=0.85):
    """By solving the equations instead of iterating."""
    n, degree = len(graph), graph.sum(axis=1)
    move = graph / np.where(degree > 0, degree, 1)
    return np.linalg.solve(np.eye(n) - damping * move, np.full(n, (1 - damping) / n))


@pytest.mark.parametrize("graph", ["lexrank", "textrank"])
def test_ranks_without_a_matrix_are_those_of_the_matrix(graph):
    for n, threshold in ((2, 0.1), (5, 0.0), (700, 0.1), (700, 0.0), (1300, 0.3)):
        tokens, o = long_text(n, 300), summaries.Options(graph=graph, threshold=threshold)
        matrix = summaries.cosine_graph(tokens, threshold) if graph == "lexrank" else summaries.overlap_graph(tokens)
        sparse = summaries.spread_of(tokens, o, dense=0)
        scores = np.random.default_rng(1).random(n)
        if any(tokens):
            assert np.allclose(sparse(scores), matrix @ scores)
            assert np.allclose(summaries.rank(n, sparse), ranked(matrix), atol=1e-6)
    assert np.allclose(summaries.spread_of([[], []], summaries.Options(graph=graph), dense=0)(np.ones(2)), 0)


def test_a_text_of_fifty_thousand_sentences_ends():
    text = ". ".join(" ".join(s) or "x" for s in long_text(50_000)) + "."
    made = summaries.summarize(text, summaries.Options(graph="textrank"))
    assert 0 < len(made.split()) <= 70
    assert 0 < len(summaries.summarize(text[:600_000], summaries.Options(threshold=0.3)).split()) <= 70


def test_edges_are_the_graphs(spark):
    df = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    sents = storage.cut_lineage(summaries.sentence_tokens(df))
    tokens = [r["tokens"] for r in sents.orderBy("pos").collect()]
    for edges, graph in ((summaries.overlap_edges(sents), summaries.overlap_graph(tokens)), (summaries.cosine_edges(sents, 0.1), summaries.cosine_graph(tokens, 0.1))):
        got = np.zeros_like(graph)
        for r in edges.collect():
            got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["weight"]
        assert np.allclose(got, graph)


def test_generated_skips_blanks(spark):
    df = spark.createDataFrame([(str(i),) for i in range(10)] + [("",), (None,), (" ",)], "text string").coalesce(1)

    def model():
        def run(batch):
            assert 0 < len(batch) <= 4 and all(t.strip() for t in batch)
            return [f"s{t}" for t in batch]

        return run

    assert [r["summary"] for r in summaries.generated(df, model, batch=4).collect()] == [f"s{i}" for i in range(10)] + [""] * 3


def test_rouge(spark):
    rows = [(1, "the cat sat", "the cat sat"), (2, "aa bb", "cc dd"), (3, "the cat", "the cat sat down"), (4, None, "x"), (5, "hôm nay", "h m nay")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    one = {r["id"]: r["rouge1"] for r in scoring.rouge_n(df, 1).collect()}
    assert one == {1: 1.0, 2: 0.0, 3: pytest.approx(2 / 3), 4: 0.0, 5: 1.0}
    assert {r["id"]: r["rougeL"] for r in scoring.rouge_l(df).collect()} == {1: 1.0, 2: 0.0, 3: pytest.approx(2 / 3), 4: 0.0, 5: 1.0}
    assert {r["id"]: r["rouge2"] for r in scoring.rouge_n(df, 2).collect()}[3] == pytest.approx(0.5)
    assert scoring.corpus_scores(df.limit(0)).first().asDict() == {"rouge1": 0.0, "rouge2": 0.0, "rougeL": 0.0, "n": 0}
    assert scoring.corpus_scores(df, scorer=lambda p, r: [0.5] * len(p)).first()["scorer_f1"] == 0.5
    with pytest.raises(Exception, match="differ in their keys"):
        scoring.paired(df.select("id", "prediction"), df.where("id > 1").select("id", "reference")).collect()


def test_scores_of_token_ids(spark):
    words = ["<pad>", "the", "cat", "sat", "down", "there"]
    rows = [(1, [1, 2, 3, -100], [1, 2, 3]), (2, [1, 2, -100, -100], [1, 2, 3, 4]), (3, None, [1, -100])]
    df = spark.createDataFrame(rows, "id int, predictions array<int>, labels array<int>")

    def decoder():
        def decode(batch):
            assert all(i >= 0 for row in batch for i in row)
            return [" ".join(words[i] for i in row if i) for row in batch]

        return decode

    got = scoring.token_scores(df, decoder, pad=0).first().asDict()
    assert got == {"rouge1": pytest.approx((1 + 2 / 3) / 3), "rouge2": pytest.approx((1 + 0.5) / 3), "rougeL": pytest.approx((1 + 2 / 3) / 3), "n": 3}
    assert scoring.token_scores(df.limit(0), decoder, pad=0).first()["n"] == 0


def test_reports(spark):
    rows = [("a", o) for o in ("inserted", "skipped_seen", "fetch_failed")] + [("b", "skipped_dupe"), ("c", "extract_failed")]
    runs = {r["source_id"]: r for r in reports.run_row(reports.crawl_counters(spark.createDataFrame(rows, "source_id string, outcome string"))).collect()}
    assert (runs["a"]["status"], runs["a"]["n_new"], runs["a"]["n_errors"], runs["b"]["status"]) == ("success", 1, 1, "partial")
    assert "inserted=1" in runs["a"]["notes"]
    failed = spark.createDataFrame([(0,) * 7], ", ".join(f"{c} int" for c in ("discovered", *reports.OUTCOMES)))
    row = reports.run_row(failed, F.array(F.lit("x"), F.lit("y"))).first()
    assert row["status"] == "failed" and row["notes"].endswith("errors=x; y")


FEED = """<rss><channel><item><title> A </title><link>https://a.vn/kinh-te/1</link><pubDate>Tue, 02 Jan 2024 12:00:00 +0700</pubDate></item><item><title>no link</title></item><item><title> </title><link>x</link></item></channel></rss>"""


def test_feeds(spark):
    df = spark.createDataFrame([("s", "f", FEED), ("s", "g", "<broken"), ("s", "h", None)], "source_id string, feed string, xml string")
    got = feeds.candidates(feeds.parse_feeds(df)).collect()
    assert [(r["title"], r["url"], r["category"], r["published_at"]) for r in got] == [("A", "https://a.vn/kinh-te/1", "kinh_te", dt.datetime(2024, 1, 2, 5))]


def test_broken_feeds_are_read_loosely(spark):
    broken = "<rss><channel><item><title><![CDATA[ A & <b>B</b> ]]></title><link>https://a.vn/kinh-te/1?a=1&b=2</link><category>x</category><pubDate>Tue, 02 Jan 2024 12:00:00 +0700</pubDate></item><item><title>C &amp; D</title><link href='https://a.vn/2'/></channel>"
    df = spark.createDataFrame([("s", "f", broken), ("s", "g", "no feed at all <")], "source_id string, feed string, xml string")
    got = feeds.candidates(feeds.parse_feeds(df)).orderBy("item_pos").collect()
    assert [(r["title"], r["url"], r["category"]) for r in got] == [("A & <b>B</b>", "https://a.vn/kinh-te/1?a=1&b=2", "x"), ("C & D", "https://a.vn/2", None)]
    assert got[0]["published_at"] == dt.datetime(2024, 1, 2, 5)


def test_polite_calls_keep_their_distance():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def get(url, headers):
        calls.append((url, now[0], headers["User-Agent"]))
        return (503, "") if len(calls) == 2 else (200, "x")

    call = feeds.Polite(get, interval=1.0, jitter=0.0, wait=4.0, headers={"User-Agent": "loom"}, clock=lambda: now[0], sleep=sleep)
    assert [call(u, h)[0] for u, h in (("a1", "a"), ("a2", "a"), ("b1", "b"), ("a3", "a"))] == [200] * 4
    assert [(u, t) for u, t, _ in calls] == [("a1", 0.0), ("a2", 1.0), ("a2", 5.0), ("b1", 5.0), ("a3", 6.0)] and slept == [1.0, 4.0, 1.0]


def test_robots_are_kept_for_their_time(spark):
    df = spark.createDataFrame([("https://a.vn/1",), ("https://b.vn/1",), ("https://c.vn/1",)], "url string")
    known = spark.createDataFrame([("a.vn", "old", 200, NOW - dt.timedelta(hours=2)), ("b.vn", "kept", 200, NOW - dt.timedelta(minutes=5)), ("z.vn", "x", 200, NOW)], feeds.ROBOTS)

    def get(url):
        if "c.vn" in url:
            raise OSError("down")
        return 200, f"text of {url}"

    got = {r["host"]: (r["body"], r["status"]) for r in feeds.refresh_robots(df, known, get, now=F.lit(NOW)).collect()}
    assert got == {"a.vn": ("text of https://a.vn/robots.txt", 200), "b.vn": ("kept", 200), "c.vn": (None, 0)}


def test_a_looser_reading_takes_over(spark):
    aside = f"<html><title>T</title><body><article><p>Too short.</p></article><aside>{BODY}</aside></body></html>"
    assert "river" in spark.createDataFrame([(aside,)], "html string").transform(extracted).first()["article"]["text"]


def test_robots_and_fetch(spark):
    df = spark.createDataFrame([("https://a.vn/private/1",), ("https://a.vn/1",), ("https://b.vn/private/1",), ("nohost",)], "url string")
    rules = spark.createDataFrame([("a.vn", "User-agent: *\nDisallow: /private/", 200), ("b.vn", "User-agent: *\nDisallow: /", 404)], "host string, body string, status int")
    assert {r["url"]: r["allowed"] for r in feeds.robots_allow(df, rules).collect()} == {"https://a.vn/private/1": False, "https://a.vn/1": True, "https://b.vn/private/1": True, "nohost": False}

    def get(url):
        if "b.vn" in url:
            raise OSError("down")
        return (500 if "private" in url else 200), "body"

    got = {r["url"]: (r["status"], r["error"]) for r in feeds.fetch(df.where("url <> 'nohost'"), get).collect()}
    assert got["https://a.vn/1"] == (200, None) and got["https://a.vn/private/1"] == (500, "status 500") and got["https://b.vn/private/1"][1] == "OSError: down"


def test_catalogue(spark, tmp_path):
    path = tmp_path / "sources.yaml"
    path.write_text("defaults: {max_items_per_feed: 3}\nsources:\n- {source_id: a, domain: a.vn, rss: [u]}\n- {source_id: b, enabled: false}\n", encoding="utf-8")
    df = feeds.catalogue(spark, str(path))
    assert [r["source_id"] for r in feeds.enabled_sources(df, []).collect()] == ["a"] and df.first()["max_items"] == 3


BODY = "".join(f"<p>Sentence number {k} tells of the river, the market and the long road home.</p>" for k in range(8))


def candidates(spark, rows):
    return spark.createDataFrame([(i, "s", u, f"T{i}", None, None, NOW + dt.timedelta(minutes=i), ok, html) for i, u, ok, html in rows], "id long, source_id string, url string, title string, category string, published_at timestamp, fetched_at timestamp, allowed boolean, html string")


CRAWL = [
    (1, "https://a.vn/x/1", True, f"<article>{BODY}</article>"), (2, "https://a.vn/x/2?utm_source=q", True, f"<article>{BODY}</article>"), (3, "https://a.vn/x/1#top", True, "dup url"),
    (4, "https://a.vn/private", False, "x"), (5, "https://a.vn/x/5", True, None), (6, "https://a.vn/x/6", True, "<p>short</p>"), (7, "https://a.vn/old", True, "x"),
]


def stored(spark):
    from corpusloom.functions.urls import url_hash

    return spark.createDataFrame([("https://a.vn/old/",)], "u string").select(F.lit(1).cast("long").alias("id"), url_hash(F.col("u")).alias("url_hash"), F.lit(None).cast("long").alias("simhash"), F.lit(NOW).alias("fetched_at"))


def test_ingest_outcomes(spark):
    got = ingest(candidates(spark, CRAWL), stored(spark)).collect()
    assert {r["id"]: r["outcome"] for r in got} == {1: "inserted", 2: "skipped_dupe", 4: "skipped_robots", 5: "fetch_failed", 6: "extract_failed", 7: "skipped_seen"}
    first = next(r for r in got if r["id"] == 1)
    assert first["title"] == "T1" and first["category"] == "x" and first["word_count"] > 50


def test_a_copy_fetched_before_a_stored_one_is_dropped(spark):
    article = f"<article>{BODY}</article>"
    first = storage.cut_lineage(ingest(candidates(spark, [(60, "https://a.vn/x/60", True, article)]), stored(spark)).where("outcome = 'inserted'"))
    kept = stored(spark).unionByName(first.select("id", "url_hash", "simhash", "fetched_at"))
    for as_of in (None, F.lit(NOW)):
        got = ingest(candidates(spark, [(2, "https://a.vn/x/2", True, article), (3, "https://a.vn/x/3", True, article.replace("river", "harbour").replace("market", "tower"))]), kept, as_of=as_of).collect()
        assert {r["id"]: r["outcome"] for r in got} == {2: "skipped_dupe", 3: "inserted"}


def test_near_stored_is_brute_force(spark):
    rows, held = hashes(3), [(1000 + i, *r) for i, *r in hashes(3)[::3]] + [(2000 + i, h, t) for i, h, t in hashes(5)]
    df, known = (spark.createDataFrame(x, "id long, simhash long, fetched_at timestamp") for x in (rows, held))
    want = {i for i, h, t in rows if any(((h ^ g) & (1 << 64) - 1).bit_count() <= 3 and u >= t - dt.timedelta(days=2) for _, g, u in held)}
    assert want and {r["id"] for r in dedupe.near_stored(df, known).collect()} == want


def test_the_sweep_takes_as_many_steps_for_400_days_as_for_40(spark, monkeypatch):
    def rows(days):
        at = F.lit(NOW) + F.make_dt_interval(hours=(F.col("id") * 3).cast("int"))
        # Three hashes in a chain, each two bits from the next, and one alone.
        return spark.range(8 * days).select("id", F.element_at(F.array(*(F.lit(h).cast("long") for h in (0, 3, 15, 1 << 40))), (F.col("id") % 4 + 1).cast("int")).alias("simhash"), at.alias("fetched_at"))

    count, cut = {}, storage.cut_lineage
    for days in (40, 400):
        got, count[days] = cut(rows(days)), []
        monkeypatch.setattr(storage, "cut_lineage", lambda df, seen=count[days]: [cut(df), seen.append(1)][0])
        have = [(r["id"], r["simhash"], r["fetched_at"]) for r in got.collect()]
        kept, want = {}, set()
        for i, h, t in sorted(have, key=lambda r: (r[2], r[0])):
            if not any((g ^ h).bit_count() <= 3 and t - u <= dt.timedelta(2) for g, u in kept.items()):
                kept[h] = t
                want.add(i)
        assert {r["id"] for r in dedupe.keep_first(got).where("kept").collect()} == want
    assert 0 < len(count[40]) == len(count[400])


def test_components_of_long_chains(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (100, 102)]
    df = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long")
    assert {r["a"]: r["comp"] for r in dedupe.components(df).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert dedupe.components(df.limit(0)).collect() == []


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    names = random.Random(3).sample(range(1000), 500)
    pairs = list(itertools.pairwise(names))
    df, rounds, cut = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a long, b long"), [], storage.cut_lineage
    monkeypatch.setattr(storage, "cut_lineage", lambda df: [cut(df), rounds.append(1)][0])
    assert {r["a"]: r["comp"] for r in dedupe.components(df).collect()} == dict.fromkeys(names, min(names))
    # A label that told only its neighbours would go along the chain in some 150.
    assert len(rounds) <= 12


def test_two_batches_are_one(spark, tmp_path):
    rows = CRAWL + [(9, "https://a.vn/x/9", True, f"<article>{BODY.replace('river', 'harbour').replace('market', 'tower')}</article>")]
    src = tmp_path / "in"
    for k, part in enumerate((rows[:4], rows[4:])):
        candidates(spark, part).coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema(candidates(spark, CRAWL).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    seen = []
    incremental.ingest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", on_batch=lambda df, n: seen.append(n)).awaitTermination()
    whole = {r["url_hash"] for r in ingest(candidates(spark, rows), incremental.stored_so_far(spark, f"{tmp_path}/none")).where("outcome = 'inserted'").collect()}
    assert {r["url_hash"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == whole and len(seen) == 2


def test_extraction_gate(spark):
    df = spark.createDataFrame([(f"<title>T</title><nav>menu</nav><article>{BODY}</article><footer>f</footer>",), ("<p>few words</p>",), (None,), ("",)], "html string")
    got = [r["article"] for r in extracted(df).collect()]
    assert got[0]["title"] == "T" and "menu" not in got[0]["text"] and got[1:] == [None] * 3


def made_page(rnd):
    """(page, its story's paragraphs): no article element, no name that says anything."""
    word = lambda: "".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()} {word()} {word()}</a></li>" for _ in range(n)) + "</ul>"
    story = [" ".join(sentence(rnd.randint(8, 16)) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(4, 9))]
    inside = "".join(f"<p>{p}</p>" + (f"<div>{links(3)}</div>" if rnd.random() < 0.3 else "") for p in story)
    if rnd.random() < 0.5:
        half = len(story) // 2
        inside = "<div>" + "".join(f"<p>{p}" for p in story[:half]) + "</div><div>" + "".join(f"<p>{p}" for p in story[half:]) + "</div>"
    around = [f"<div><h1>{word()}</h1>{inside}</div>", f"<div>{links(rnd.randint(5, 60))}</div>", f"<div>{word()} {word()} {links(4)}</div>", f"<div><a href='/'>{sentence(9)}</a><a href='/x'>{sentence(30)}</a></div>", f"<div><span>{word()}</span></div>", f"<div class='comments'><p>{sentence(40)}</p></div>"]
    rnd.shuffle(around)
    body = "".join(around)
    for _ in range(rnd.randint(0, 3)):
        body = f"<div>{body}</div>"
    return f"<html><head><title>T</title><script>var x = '<p>no</p>'</script></head><body>{body}</body></html>", story


def test_a_story_is_found_by_the_density_of_its_links():
    from corpusloom.operators.articles import read_article

    rnd = random.Random(3)
    for _ in range(150):
        page, story = made_page(rnd)
        lines = read_article(page)[3].split("\n")
        heading = [x for x in lines if x not in story]
        assert [x for x in lines if x in story] == story and len(heading) <= 1 and all(" " not in h for h in heading), page
    within = f"<div>{'<p>' + 'Outside words stand here, more of them than in the article itself. ' * 9}</div><article><p>Inside.</p></article>"
    assert read_article(within)[3] == "Inside." and read_article("")is None and read_article("<ul><li><a>x</a></ul>")[3] == ""
    assert read_article("<div>a<br>b</div> c")[3] == "a\nb\nc" and read_article("<p>x</div></p></section><p>y")[3] == "x\ny"


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, storage.upsert(old, new, "k").collect())) == [(1, "a", 1), (2, "B", 2), (3, "c", None)]
    fresh, skipped = storage.insert_new(old, new, ["k"])
    assert [r["k"] for r in fresh.collect()] == [3] and [r["k"] for r in skipped.collect()] == [2]


def test_retention(spark):
    df = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(31)), (3, NOW)], "id int, fetched_at timestamp")
    assert [r["id"] for r in incremental.retained(df, F.lit(NOW), taken_down=spark.createDataFrame([(3,)], "id int")).collect()] == [1]


def test_takedown_cascades(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {"sources": one([(1,), (2,)], "id int"), "articles": one([(10, 1), (11, 2)], "id int, source_fk int"), "labels": one([(10,), (11,)], "article_fk int"), "crawl_runs": one([(1,), (2,)], "source_fk int")}
    left = storage.without_sources(tables, one([(1,)], "id int"))
    assert {k: [r[0] for r in v.collect()] for k, v in left.items()} == {"sources": [2], "articles": [11], "labels": [11], "crawl_runs": [2]}


def test_metrics_are_appended(spark, tmp_path):
    for k in range(2):
        storage.metrics_row(spark, f"{tmp_path}/m", f"run{k}", {"lr": 0.1}, {"rouge1": 0.5})
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2
