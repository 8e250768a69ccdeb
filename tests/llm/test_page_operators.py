import base64
import hashlib

import numpy as np
import pytest

from corpusloom.llm import ann, html_extract, sharding, url_filter, warc

PAGE = "page_id long, url string, html string, text string, host string, bundle string"


def page(n, title, *paragraphs, extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy {n}</div>{extra}<article><h1>{title}</h1>{body}</article><section class="comments"><p>First!</p></section><footer>&copy; us</footer></body></html>'


def extract(spark, rows):
    df = spark.createDataFrame([(*r, "x", "h", "b") for r in rows], PAGE)
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


def test_extracts_articles(spark):
    rows = [(k, f"http://a.example/{k}", page(k, f"Title {k}", f"One &amp; two {k}", "three\n  four<br>five")) for k in range(5)]
    got = extract(spark, rows)
    assert got == {k: f"Title {k}\nOne & two {k}\nthree four five" for k in range(5)}


def test_no_name_is_needed_where_a_template_is_found(spark):
    import re

    def bare(source):
        """The page with nothing but ``div`` for elements of meaning and no name that says anything."""
        plain = re.sub(r"<(/?)(article|nav|footer|section)\b", r"<\1div", source)
        return re.sub(r'class="(\w+)"', lambda m: f'class="q{sum(m[1].encode())}"', plain)

    rows = [(k, f"http://a.example/{k}", page(k, f"Title {k}", *(f"Paragraph {n} of story {k}, which is a long one" for n in range(1 + k % 4)), extra="<div>Welcome to our paper, dear reader</div>" if k % 2 else "")) for k in range(12)]
    texts = {k: f"Title {k}\n" + "\n".join(f"Paragraph {n} of story {k}, which is a long one" for n in range(1 + k % 4)) for k in range(12)}
    assert extract(spark, rows) == texts
    neutral = [(k, u, bare(h)) for k, u, h in rows]
    assert not re.search("article|nav|footer|comment|\\bad\\b", "".join(h for _, _, h in neutral).replace("Paragraph", ""))
    df = spark.createDataFrame([(*r, "x", "h", "b") for r in neutral], PAGE)
    got = html_extract.extract(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == texts and all(r["by_template"] for r in got)


def brute_templates(rows, support=3, share=0.02):
    """What ``deduce`` finds from occurrence vectors written out in full, for each group of pages."""
    groups = {}
    for key, host, source in rows:
        read = html_extract.Page(source or "")
        if not read.tags:
            continue
        found = {}
        for place, (path, chars) in enumerate(read.tags):
            own = found.setdefault(("tag", path, html_extract.hash64(path)), [0, place, 0])
            own[0] += 1
            own[2] += chars
        for place, (path, _, text, rejected) in enumerate(read.runs):
            if not rejected and not text.isspace():
                own = found.setdefault(("text", path, html_extract.run_token(path, text)), [0, place, 0])
                own[0] += 1
                own[2] += len(text) - text.count(" ")
        for group in (read.layout(), html_extract.WHOLE):
            groups.setdefault((host, group), {})[key] = found
    out = {}
    for (host, group), pages in groups.items():
        if len(pages) < max(support, share * len(groups[host, html_extract.WHOLE])):
            continue
        vectors, names = {}, {}
        for key, found in pages.items():
            for token, (count, place, chars) in found.items():
                vectors.setdefault(token, []).append((key, count, place, chars))
        tokens = []
        for (kind, path, token), seen in vectors.items():
            if 2 * len(seen) >= len(pages):
                vector = names.setdefault(frozenset((k, c) for k, c, _, _ in seen), len(names))
                counts = [c for _, c, _, _ in seen]
                tokens.append(html_extract.Token(kind, path, token, len(seen), vector, min(counts), max(counts), min(p for _, _, p, _ in seen), sum(n for *_, n in seen), sum(counts)))
        if tokens:
            out[host, group] = html_extract.deduce(tokens)
    return out


def test_templates_are_those_of_full_occurrence_vectors(spark, data):
    from pyspark.sql import functions as F

    given = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    rows = [(i, f"h{i % 4}", h) for i, _, h in given]
    rows += [(1000 + k, "made", page(k, f"Title {k}", *(f"Paragraph {n} of {k}" for n in range(k % 4)), extra="<div class='box'>Subscribe to us</div>" if k % 3 else "")) for k in range(20)] + [(2000, "made", None), (2001, "one", "<p>alone</p>")]
    df = spark.createDataFrame([(h, i, s or "") for i, h, s in rows], "host string, page long, html string")
    got = {(r["host"], group): (main, sure, nested) for r in html_extract.templates(df).collect() for group, main, sure, nested in __import__("json").loads(r["template"])}
    want = brute_templates(rows)
    assert got == want and any(main for main, _, _ in got.values()) and df.select(F.count("page")).first()[0] == len(rows)


def test_templates_joined_by_host_are_the_same(spark):
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k % 4}'}.example/", page(k, f"Title {k}", f"One and two {k}")) for k in range(40)]
    df = spark.createDataFrame([(*r, "x", "h", "b") for r in rows], PAGE)
    every = lambda **kw: sorted(map(tuple, html_extract.extract(df, **kw).collect()))
    assert every() == every(broadcast_bytes=0)


def test_extraction_of_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://b/", "plain text only"), (4, "http://b/", "<article><p>a<b>b<p>c</article"), (5, "http://b/", "<script>var x='<p>no</p>'</script><p>yes</p>"), (6, "http://c/", page(6, "T", "x" * 200_000)), (6, "http://c/", page(6, "T", "y"))]
    df = spark.createDataFrame([(*r, "x", "h", "b") for r in rows], PAGE)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    assert [g[:2] for g in got[:5]] == [(1, ""), (2, ""), (3, "plain text only"), (4, "ab\nc"), (5, "yes")]
    assert {g[1] for g in got[5:]} == {"T\ny", "T\n" + "x" * 200_000} and all(len(t) == n for _, t, n in got)
    assert html_extract.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "inside",
    ["<svg width='1'/>", "<math/>", "<svg><g><path d='M0'/><svg><path/></svg><text>no</text></g></svg>", "<svg><title/><text>no</text></svg>", "<object data='x'>", "<noscript>", "<template><p>no</p></template>", "<object><object>no</object>no</object>", "<svg>no<p></svg>"],
)
def test_embedded_elements_cut_nothing(inside):
    source = f"<html><body><article><p>before</p>{inside}<p>after</p></article><article><p>end</p></article></body></html>"
    p = html_extract.Page(source)
    assert p.blocks(p.own_main(), frozenset()) == ["before", "after", "end"]


def test_template_finds_the_main_slot_without_names(spark):
    shell = lambda k: f"<html><body><div class='q1'><p>Same words on every page of this host</p></div><div class='q2'><p>{'Own story number ' + str(k) + ' goes on and on. ' * 8}</p><p>Its end {k}</p></div></body></html>"
    got = extract(spark, [(k, "http://t.example/", shell(k)) for k in range(6)])
    assert all(t.startswith(f"Own story number {k}") and t.endswith(f"Its end {k}") and "Same words" not in t for k, t in got.items())


def test_odd_pages_leave_their_hosts_template_alone(spark):
    shell = lambda k: f"<html><body><div class='q1'><p>Same words on every page of this host</p></div><div class='q2'><p>{'Own story number ' + str(k) + ' goes on and on. ' * 8}</p><p>Its end {k}</p></div></body></html>"
    story = lambda k: f"<html><body><div class='q1'><p>Outside of the article</p></div><article><h1>Title {k}</h1><p>{f'story {k} ' * 9}</article></body></html>"
    index = "<html><body><div class='list'><p>All our stories in one long list</p></div></body></html>"
    rows = [(k, "http://t.example/", shell(k)) for k in range(6)] + [(6, "http://t.example/", None), (7, "http://t.example/", ""), (8, "http://t.example/", "no tags")]
    rows += [(10 + k, "http://s.example/", story(k)) for k in range(6)] + [(16, "http://s.example/", index)]
    # Two layouts on one host, neither of them on all pages.
    rows += [(20 + k, "http://u.example/", shell(k)) for k in range(4)] + [(30 + k, "http://u.example/", story(k)) for k in range(6)]
    got = extract(spark, rows)
    assert all(got[k + n].startswith(f"Own story number {n}") and got[k + n].endswith(f"Its end {n}") and "Same words" not in got[k + n] for k, m in ((0, 6), (20, 4)) for n in range(m))
    assert all(got[k + n] == f"Title {n}\n{f'story {n} ' * 9}".strip() for k in (10, 30) for n in range(6))
    assert (got[6], got[7], got[8], got[16]) == ("", "", "no tags", "All our stories in one long list")


def test_copies_on_a_host_are_not_taken_for_its_template(spark):
    rows = [(k, "http://c.example/", page(k, "Copied", "The same article everywhere")) for k in range(6)]
    assert set(extract(spark, rows).values()) == {"Copied\nThe same article everywhere"}


def test_text_of_nested_classes_is_the_templates(spark):
    notice = "All rights are with the owner of this host. " * 12
    box = "<div class='q7'><b>Try one of our other wonderful papers</b></div>"
    twice = "<p>Read this page aloud, please</p>"
    source = lambda k: f"<html><body><article><h1>Title {k}</h1>{twice}<p>{f'story {k} ' * 200}</p>{box if k % 5 < 3 else ''}{twice}<p>{notice}</p></article></body></html>"
    got = extract(spark, [(k, "http://n.example/", source(k)) for k in range(10)])
    assert got == {k: f"Title {k}\n{f'story {k} ' * 200}".strip() for k in range(10)}


def test_near_copies_on_a_host_keep_their_text(spark):
    same = "".join(f"<p>Paragraph {n} of an article that many have copied</p>" for n in range(9))
    source = lambda k: f"<html><body><article><h1>Title {k}</h1>{same if k < 6 else f'<p>own words {k}</p><p>more of {k}</p>'}</article></body></html>"
    got = extract(spark, [(k, "http://m.example/", source(k)) for k in range(10)])
    assert all(got[k].count("Paragraph") == 9 for k in range(6)) and got[7] == "Title 7\nown words 7\nmore of 7"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/", None), (4, "", ""), (5, "http://e/\nx", "été\r\n\r\nWARC/1.1"), (None, "http://n/", "same"), (6, "http://f/", "z" * 700_000)]
    df = spark.createDataFrame([(*r, "x", "h", "b") for r in rows], PAGE)
    folder = f"file://{tmp_path}/archive"
    index = warc.write_archive(df, folder, frame_bytes=1000)
    got = {r["page_id"]: r for r in warc.read_archive(index, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i]["payload_bytes"] == len(body) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    headers, block = warc.fetch_record(index, folder, 5)
    assert block.decode() == rows[4][2] and headers["WARC-Type"] == "response"
    (tmp_path / "archive/bundles/left-over.warc.zst").write_bytes(b"x")
    assert warc.sweep(index, folder) == 1 and warc.read_archive(index, folder).count() == len(rows)


def test_archives_are_read_back_in_many_tasks(spark, tmp_path):
    rows = [(k, "http://a/\r\nb", f"page {k} " * 200) for k in range(300)]
    index = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/many", frame_bytes=2000)
    out = warc.read_archive(index, f"file://{tmp_path}/many", frames_a_task=20)
    assert out.rdd.getNumPartitions() >= 10
    assert {(r["page_id"], r["url"], r["html"]) for r in out.collect()} == set(rows)


def test_a_hot_payload_meets_in_no_task(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusloom.llm.shared import look_up

    rows = spark.range(6000).select("id", F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")).withColumn("k", F.when(F.col("id") != 5999, F.col("k")))
    facts = rows.where("k IS NOT NULL").groupBy("k").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = look_up(rows, facts, ["k"], "n", least=50).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(out) == 6000 and all(r["kept"] == (3999 if r["k"] == "hot" else None if r["k"] is None else r["id"]) for r in out)
    sizes = [sum(r["part"] == p for r in out) for p in {r["part"] for r in out}]
    assert max(sizes) < 2 * 6000 / len(sizes)


def test_warc_of_nothing_and_small_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(df.limit(0), f"{tmp_path}/none"), f"{tmp_path}/none").count() == 0
    index = warc.write_archive(df, f"{tmp_path}/small", smallest=3)
    assert {r["record_type"] for r in warc.read_archive(index, f"{tmp_path}/small").collect()} == {"response"}


def test_frames_are_independent(tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path), 50)
    places = [writer.add(warc.build_record(k, None, b"payload %d" % k, None)) for k in range(4)]
    writer.close()
    with open(writer.name, "rb") as stream:
        table = warc.read_seek_table(stream)
        assert [p[1] for p in places] == [0, 1, 2, 3] and len(table) == 4
        at, packed, _ = table[2]
        stream.seek(at)
        assert warc.parse_record(zstandard.ZstdDecompressor().decompress(stream.read(packed)))[1] == b"payload 2"
    # Any Zstandard reader takes the whole file: the seek table is a skippable frame.
    with open(writer.name, "rb") as stream:
        whole = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 4


URLS = [
    (1, "http://x.example.net/de/1", "example.net/", "block", "net/"), (2, "https://EXAMPLE.net/en/2", None, "allow", "example.net/en/"), (3, "http://a.b.example.com/de/", None, "block", "example.com/de/"),
    (4, "http://news.org/fr/1?x=1", None, "allow", "org/fr/"), (5, "http://news.org/de/", None, "allow", None), (6, "http://badexample.com/de/x", None, "allow", None), (7, None, None, "allow", None), (8, "no scheme", None, "allow", None),
    (9, "http://internet", None, "allow", None), (10, "http://x.net", None, "allow", None), (11, "", None, "allow", None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u, *_ in URLS], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.verdict_digest(df, labels).collect()}
    assert got == {i: (v, r) for i, _, _, v, r in URLS}


def test_host_and_path(spark):
    df = spark.createDataFrame([(1, "HTTP://Ex.COM?x=a://b/"), (2, "a://b/c/d#e?f"), (3, "://h/p"), (4, "x")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"]) for r in url_filter.verdict_digest(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {1: ("ex.com", ""), 2: ("b", "/c/d"), 3: ("h", "/p"), 4: ("", "")}


def test_mined_rules_block_what_labels_show(spark):
    urls = [(i, f"http://{'cheap-pills' if i % 4 == 0 else 'fine-garden'}.shop{i % 7}.com/en/{i}") for i in range(400)]
    df = spark.createDataFrame([(*u, "x") for u in urls] + [(None, None, "x")], "page_id long, url string, items string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.verdict_digest(df, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400)) and got[None] == "allow"
    marked = labels.selectExpr("doc_id AS id", "quality = 0 AS bad")
    rules = url_filter.mine_rules(df.selectExpr("page_id AS id", "url"), marked).collect()
    assert rules and all(r["confidence"] == 1.0 and len(r["items"]) == 1 for r in rules)


def brute_rules(rows, floor, longest=3, least=0.5, lift=2.0):
    from itertools import combinations

    held, base = {}, sum(b for _, b in rows) / len(rows)
    for items, bad in rows:
        for n in range(1, longest + 1):
            for c in combinations(sorted(items), n):
                held.setdefault(c, [0, 0])
                held[c][0] += bad
                held[c][1] += 1
    sure = {c: b / n for c, (b, n) in held.items() if b >= floor and b / n >= max(least, min(lift * base, base + (1 - base) / 2))}
    return {c: (s, held[c][0]) for c, s in sure.items() if not any(sure.get(part, -1) >= s for k in range(1, len(c)) for part in combinations(c, k))}


def test_mined_rules_are_an_exhaustive_count(spark):
    import random

    rnd = random.Random(12)
    rows = []
    for i in range(300):
        items = {f"t{rnd.randint(0, 11)}" for _ in range(rnd.randint(1, 7))}
        rows.append((i, sorted(items), ({"t1", "t2"} <= items or "t3" in items and rnd.random() < 0.7 or rnd.random() < 0.05)))
    urls = spark.createDataFrame([(i, "http://h/" + "/".join(x)) for i, x, _ in rows], "id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "id long, bad boolean")
    want = brute_rules([({"h:h", *(f"d:{t}" for t in x)}, b) for _, x, b in rows], 8)
    assert any(len(c) > 1 for c in want)
    for most_tokens in (16, 0):
        got = {tuple(r["items"]): (r["confidence"], r["bad"]) for r in url_filter.mine_rules(urls, labels, most_tokens=most_tokens).collect()}
        assert got == want


def test_urls_with_many_common_tokens_end(spark):
    # FP-growth alone would list 2 ** 32 sets.
    many = "&".join(f"k{j}=1" for j in range(30))
    df = spark.createDataFrame([(i, f"http://bad{'' if i % 2 else '-x'}.com/?{many}" if i < 20 else f"http://h{i}.com/{i}") for i in range(100)] + [(3, "http://other.com/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 20 else 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = url_filter.verdict_digest(df, labels).collect()
    assert len(got) == 101 and {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(20))
    assert url_filter.verdict_digest(df.limit(0), labels).collect() == []


def test_rules_are_mined_where_most_urls_are_bad(spark):
    df = spark.createDataFrame([(i, f"http://{'fine-garden' if i % 4 == 0 else 'cheap-pills'}.shop{i % 7}.com/en/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.verdict_digest(df, labels).collect()}
    assert got == {i: "allow" if i % 4 == 0 else "block" for i in range(400)}


def test_shards_by_bytes(spark):
    rows = [(i, "t" * (i * 37 % 900)) for i in range(3000)] + [(5000 + i, "one hot text " * 20) for i in range(2000)] + [(9000, None), (9001, ""), (None, "x"), (9002, "a" * 3000), (9003, "dup"), (9003, "dup")]
    df = spark.createDataFrame([(*r, "k", "s") for r in rows], "doc_id long, text string, key string, size string")
    got = sharding.shard_digest(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(16))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 16
    import zlib

    texts = {i: (t or "").encode() for i, t in rows}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in got)
    again = {(r["doc_id"], r["shard"]) for r in sharding.shard_digest(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["shard"]) for r in got}
    assert sharding.shard_digest(df.limit(0)).collect() == []


def test_one_repeated_row_is_cut_into_many_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(6000).select(F.when(F.col("id") < 4000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 4000, F.lit("the same row")).otherwise(F.col("id").cast("string")).alias("text"))
    out = sharding.shard_by_bytes(df, ranges=64)
    got = out.collect()
    sizes = {k: sum(r["size"] for r in got if r["shard"] == k) for k in range(16)}
    assert max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 16
    assert len({(r["shard"], r["slot"]) for r in got}) == 6000
    assert len({r["shard"] for r in got if r["id"] == 7}) >= 10


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16)], 0) for i in range(2000)]
    hot = rows[100][1]
    rows += [(3000 + i, hot, 0) for i in range(500)]
    return rows


def brute_neighbours(rows, k=10):
    ids, table = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i, v, _ in rows:
        if i % 100 == 0:
            far = np.sqrt(((table - np.array(v)) ** 2).sum(axis=1))
            out[i] = [j for _, j in sorted(zip(far.tolist(), ids.tolist(), strict=True)) if j != i][:k]
    return out


def test_neighbours_reach_recall(spark, vectors):
    bad = [(7000, None, 0), (7001, [0.0] * 16, 0), (7002, [float("nan")] * 16, 0), (7003, [1.0] * 15 + [None], 0), (7100, [float("inf")] * 16, 0), (7200, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>, list int")
    got = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert len(got[r["query_id"]]) == r["rank"]
    exact = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in vectors]
    want = brute_neighbours(exact)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert got[100] == list(range(3000, 3010)) and got[3000][0] == 100


def test_abandoning_in_several_column_blocks_loses_little():
    rng = np.random.default_rng(4)
    table, queries = rng.standard_normal((5000, 64)), rng.standard_normal((40, 64))
    visit = rng.random((40, 5000)) < 0.8
    turn = ann.rotation(64)
    far = np.where(visit, np.sqrt(((queries[:, None, :] - table) ** 2).sum(axis=2)), np.inf)
    want = {(i, j) for i in range(40) for j in np.argsort(far[i])[:11]}
    at, of, exact = ann.survivors(queries, table, turn, visit, 11, None)
    assert want <= set(zip(at.tolist(), of.tolist(), strict=True)) and np.allclose(exact, far[at, of])
    at, of, _ = ann.survivors(queries, table, turn, visit, 11, 2.5)
    got = set(zip(at.tolist(), of.tolist(), strict=True))
    assert len(want & got) >= 0.98 * len(want) and len(got) < 0.2 * visit.sum() and all(visit[i, j] for i, j in got)


def test_lists_are_packed_into_cells():
    sizes, centers = np.array([10, 0, 25, 9, 3]), np.array([[0.0], [1.0], [2.0], [3.0], [4.0]])
    first, parts = ann.cells_of(sizes, centers, 10)
    assert parts.tolist() == [1, 1, 3, 1, 1]
    used = {}
    for j in range(5):
        for c in range(parts[j]):
            used.setdefault(int(first[j]) + c, []).append(j)
    assert all(len(js) == 1 or 2 not in js for js in used.values())
    query, cell, lists = ann.visits_of(np.array([[2, 0], [3, 4]]), first, parts)
    assert {(q, c, tuple(x)) for q, c, x in zip(query.tolist(), cell.tolist(), map(list, lists), strict=True)} == {
        *((0, int(first[2]) + c, (2,)) for c in range(3)), (0, int(first[0]), (0,)), *({(1, int(first[3]), (3, 4))} if first[3] == first[4] else {(1, int(first[3]), (3,)), (1, int(first[4]), (4,))}),
    }


def test_exact_search_in_small_cells_and_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(24)], 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    out = ann.search(df, every=20, lists=30, probes=30, doubt=None, rows_a_cell=40, queries_a_part=30).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ids, table = np.arange(1500), np.array([r[1] for r in rows])
    for i in range(0, 1500, 20):
        far = np.sqrt(((table - table[i]) ** 2).sum(axis=1))
        assert got[i] == [j for _, j in sorted(zip(far.tolist(), ids.tolist(), strict=True)) if j != i][:10]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0)).collect() == []
