import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.functions.hashing import hamming, is_near, simhash64, simhash_grams, simhash_of, split_bucket


def values(spark, rows, made, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["v"] for r in df.select("i", made(F.col("x")).alias("v")).orderBy("i").collect()]


def test_canonical_url(spark):
    cases = {
        "HTTPS://VnExpress.NET/foo": "https://vnexpress.net/foo", "https://a.vn/x?utm_source=f&id=1&fbclid=z&q=2": "https://a.vn/x?id=1&q=2", "https://a.vn/?b=2&a=1": "https://a.vn/?a=1&b=2",
        "http://a.vn:80/x//y/": "http://a.vn/x/y", "https://a.vn:443": "https://a.vn/", "http://a.vn:443/": "http://a.vn:443/", "https://a.vn/x#frag": "https://a.vn/x", "https://a.vn/?refresh=1&from_date=2&k=": "https://a.vn/",
        "  https://a.vn/p?x=a+b&y=%7E* ": "https://a.vn/p?x=a+b&y=~%2A", "//a.vn/p": "https://a.vn/p", "": "",
    }
    got = values(spark, [*cases, None], U.canonical_url)
    assert got == [*cases.values(), None]
    assert values(spark, got, U.canonical_url) == got


def test_url_hash_and_host(spark):
    a, b, c = values(spark, ["https://A.vn/x", "https://a.vn/x/", "https://a.vn/y"], U.url_hash)
    assert a == b != c and len(a) == 32
    assert values(spark, ["http://A.b:8080/x?y"], U.url_host) == ["a.b:8080"]


def test_categories(spark):
    assert values(spark, ["https://a.vn/Kinh-Te/x", "https://a.vn/kinh-te", "https://a.vn/", "a.vn/x/y", "https://a.vn//xa-hoi/1"], U.url_category) == ["kinh_te", None, None, None, "xa_hoi"]
    assert values(spark, ["Thời sự", "kinh-doanh", "unknown", None, "", "xa_hoi"], U.canonical_category) == ["thoi_su", "kinh_doanh", None, None, None, None]


def test_normalized_and_words(spark):
    nfd = unicodedata.normalize("NFD", "Việt Nam")
    rows = ["a   b\n\n\nc", "", None, nfd, "x\n\nXEM THÊM: y\nz", "x\nĐỌC THÊM y", "a b", "Chia sẻ với bạn\nok"]
    assert values(spark, rows, T.normalized) == ["a b c", "", "", "Việt Nam", "x z", "x", "a b", "ok"]
    assert values(spark, ["một hai ba bốn năm", "", None, " a b "], T.word_count) == [5, 0, 0, 2]


def test_sentences_and_tokens(spark):
    assert values(spark, ["Câu một. Câu hai? Câu ba!", "", None, "3.5 is one. "], T.sentences) == [["Câu một.", "Câu hai?", "Câu ba!"], [], [], ["3.5 is one."]]
    assert values(spark, ["Tôi đi học"], T.lower_tokens) == [["tôi", "đi", "học"]]
    assert values(spark, ["a b c d", " a b ", None], lambda c: T.truncate_words(c, 3)) == ["a b c", "a b", ""]


def test_truncate_chars_and_prompt(spark):
    long = "word " * 200
    cut = values(spark, [long, "short", None], lambda c: T.truncate_chars(c, 500))
    assert cut[0].endswith("word […]") and len(cut[0]) <= 504 and cut[1:] == ["short", ""]
    made = lambda c: T.render_prompt('{title}|{category}|{source}|{content_text} {{"k": 1}}', title=c, category=F.lit(None).cast("string"), source=F.lit("s"), content=c)
    assert values(spark, ["x", None], made) == ['x||s|x {"k": 1}', '||s| {"k": 1}']


def test_numbers_and_entities(spark):
    assert values(spark, ["(20.000) and 3,5% USD100, 1 - x 1"], T.numeric_tokens) == [["20.000", "3,5", "USD100", "1", "1"]]
    assert values(spark, ["Ông Nguyễn Văn A và HLV Park Hang Seo, iPhone Pro. Ông Nguyễn Văn A"], T.entities) == [["Ông Nguyễn Văn A", "HLV Park Hang Seo", "Phone Pro"]]


def test_dates(spark):
    rows = ["2024-01-02T12:00:00+07:00", "2024-01-02T05:00:00Z", "2024-01-02T05:00:00", "Tue, 02 Jan 2024 12:00:00 +0700", "not a date", None, ""]
    want = dt.datetime(2024, 1, 2, 5)
    assert values(spark, rows, lambda c: T.to_utc(c).cast("string")) == [str(want)] * 4 + [None] * 3
    assert values(spark, ["2024-01-02T05:00:00Z"], lambda c: T.iso_time(T.to_utc(c))) == ["2024-01-02T05:00:00+00:00"]


def test_simhash(spark):
    rows = ["Hello, World!", "hello world", "", None, "abc", "x" * 20_000, "The quick brown fox jumps over the lazy dog " * 3]
    got = values(spark, rows, simhash64)
    assert got == [simhash_of(t) for t in rows] and got[0] == got[1] and got[2] == got[3] == 0
    assert all(-(1 << 63) <= h < 1 << 63 for h in got)
    assert values(spark, ["Ab c-d!", "a", ""], simhash_grams) == [["abcd"], ["a"], []]
    pair = spark.createDataFrame([(-1, 0), (7, 0), (15, 0)], "a long, b long").select(hamming(F.col("a"), F.col("b")).alias("d"), is_near(F.col("a"), F.col("b")).alias("n")).collect()
    assert [tuple(r) for r in pair] == [(64, False), (3, True), (4, False)]


def test_split_bucket(spark):
    import hashlib

    first = [hashlib.sha256(f"vn-news-v1:{i}".encode()).digest()[0] for i in range(200)]
    assert values(spark, list(range(200)), lambda c: split_bucket("vn-news-v1", c), "int") == ["test" if b < 26 else "val" if b < 52 else "train" for b in first]


def test_constraints(spark):
    rows = [("u", "h" * 32, "new", 1), ("u", "h", "new", 1), (None, "h" * 32, "new", 1), ("u", "h" * 32, "odd", 1), ("u", "h" * 32, None, -1)]
    got = schemas.violations(spark.createDataFrame(rows, "url string, url_hash string, status string, word_count int")).collect()
    assert [r["violation"] is None for r in got] == [True, False, False, False, False]


@pytest.mark.parametrize("ddl", [schemas.SOURCES, schemas.ARTICLES, schemas.SUMMARIES, schemas.LABELS, schemas.DATASET_VERSIONS, schemas.CRAWL_RUNS, schemas.MODEL_RUNS, schemas.EXAMPLE])
def test_schemas_parse(spark, ddl):
    assert spark.createDataFrame([], ddl).count() == 0


def test_simhashes_are_brute_force():
    import random
    from collections import Counter

    from corpusloom.functions import hashing

    def slow(text):
        joined = "".join(hashing._WORDS.findall((text or "").lower()))
        counts = Counter(joined[i : i + 4] for i in range(max(1, len(joined) - 3))) if joined else {}
        total, out = sum(min(c, 50) for c in counts.values()), 0
        for bit in range(64):
            out |= (2 * sum(min(c, 50) for g, c in counts.items() if hashing._gram_hash(g) >> bit & 1) > total) << bit
        return out - (1 << 64) if out >> 63 else out

    rnd = random.Random(1)
    texts = [None, "", "ab", "abcd", " x ", "é🎉漢字 zażółć", "ab" * 500] + ["".join(rnd.choice("abc déè漢🎉 ") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    assert hashing.simhashes(texts, most_chars=500).tolist() == [slow(t) for t in texts]
    assert hashing.simhashes([]).size == 0
    wide = "".join(chr(c) for c in range(0x4E00, 0x9FA6)) + "".join(chr(c) for c in range(0xAC00, 0xD7A4)) + "".join(chr(c) for c in range(0x20000, 0x2A000))
    assert hashing.simhash_of(wide) == hashing._plain(wide)
