import json
import shutil

import pytest

from corpusloom.__main__ import main
from corpusloom.sources import feeds
from corpusloom.sources.config import load_prompt, load_training, model_parts, settings
from corpusloom.sources.storage import write_dataset
from corpusloom.sources.versions import Table


def test_evaluate(spark, tmp_path, capsys):
    assert main(["evaluate", "--dataset-root", str(tmp_path)], spark) == 2
    text = "The river rose. The market closed early. People walked home along the road. Nobody knew why."
    rows = spark.createDataFrame([(i, "s", f"u{i}", "t", None, None, text, text, "v1", s) for i, s in enumerate(("train", "val", "test", "test"))], "article_id long, source string, url string, title string, category string, published_at string, content_text string, summary string, prompt_version string, split string")
    write_dataset(rows, f"{tmp_path}/v1")
    assert main(["evaluate", "--dataset-root", str(tmp_path), "--baseline", "textrank"], spark) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["n"] == 2 and out["rouge1"] == 1.0


def test_query(spark, tmp_path, data):
    assert main(["query", "no_such", data, str(tmp_path)], spark) == 2
    assert main(["query", "url_host", data, f"{tmp_path}/q"], spark) == 0 and spark.read.parquet(f"{tmp_path}/q").count() == 50


def test_ingest_twice(spark, tmp_path):
    body = "".join(f"<p>Sentence number {k} tells of the river, the market and the long road home.</p>" for k in range(8))
    rows = spark.sql(f"SELECT 1L AS id, 's' AS source_id, 'https://a.vn/x/1' AS url, 'T' AS title, CAST(NULL AS STRING) AS category, CAST(NULL AS TIMESTAMP) AS published_at, TIMESTAMP '2024-01-01' AS fetched_at, true AS allowed, '{body}' AS html")
    rows.write.parquet(f"{tmp_path}/in")
    run = ["ingest", f"{tmp_path}/in", "--store", f"{tmp_path}/store"]
    assert main(run, spark) == 0 and main(run, spark) == 1
    assert spark.read.parquet(f"{tmp_path}/store").count() == 1


def test_retired_articles_are_in_no_file(spark, tmp_path, capsys):
    import datetime as dt

    from corpusloom.streaming import incremental

    store = f"{tmp_path}/store"
    for batch, days in ((1, (1, 2, 20)), (2, (3, 20, 21))):
        rows = [(10 * batch + d, f"h{batch}{d}", d, dt.datetime(2024, 1, d), "inserted") for d in days]
        incremental.store(spark.createDataFrame(rows, "id long, url_hash string, simhash long, fetched_at timestamp, outcome string"), store, batch)
    spark.createDataFrame([(41,), (999,)], "id int").write.parquet(f"{tmp_path}/down")
    args = ["retire", "--store", store, "--days", "10", "--today", "2024-01-22"]
    on_disk = lambda: {r["id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(store).collect()}
    assert on_disk() == {11, 12, 30, 23, 40, 41}
    assert main([*args, "--taken-down", f"{tmp_path}/down"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"days_deleted": 3, "articles": 2}
    assert on_disk() == {30, 40} and {r["batch"] for r in incremental.stored_so_far(spark, store).collect()} == {1, 2}
    known = incremental.stored_urls(spark, store).known(spark.createDataFrame([("h11",), ("h221",), ("x",)], "u string"))
    assert {r["key"] for r in known.collect()} == {"h11", "h221"}
    # Of a folder without hashes beside it they are made from its rows.
    shutil.rmtree(f"{store}_urls")
    asked = spark.createDataFrame([("h120",), ("h220",), ("h11",)], "u string")
    assert {r["key"] for r in incremental.stored_urls(spark, store).known(asked, before=1).collect()} == {"h120", "h220"}
    assert main(["retire", "--store", store, "--days", "0", "--today", "2024-02-22"], spark) == 1 and main(["retire", "--store", f"{tmp_path}/none"], spark) == 1


def test_configuration(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("version: 1.2.0\nqc: {max_words: 80, entity_fuzzy_min_ratio: 0.9}\ngeneration_config: {temperature: 0.5}\n")
    prompt = load_prompt(str(path))
    assert (prompt.version, prompt.limits.max_words, prompt.limits.min_words, prompt.limits.fuzzy_ratio, prompt.temperature) == ("1.2.0", 80, 40, 0.9, 0.5)
    path.write_text("generation_config: {temperature: 9}\n")
    with pytest.raises(ValueError, match="temperature"):
        load_prompt(str(path))
    path.write_text("run_name: r\ndataset: {text_column: body, odd: 1}\ntraining: {seed: 7}\n")
    assert (load_training(str(path)).text_column, load_training(str(path)).seed, load_training(str(path)).target_column) == ("body", 7, "summary")
    assert settings({"CORPUSLOOM_WAREHOUSE": "w"}).warehouse == "w"
    (tmp_path / ".env").write_text("# a comment\nexport CORPUSLOOM_WAREHOUSE='from file'\n\nODD\n")
    assert settings(file=f"{tmp_path}/.env").warehouse == "from file" and settings(file=f"{tmp_path}/none").warehouse == "warehouse"


def test_model_folders(tmp_path):
    assert model_parts("some/name") == {"base": "some/name", "adapter": None, "tokenizer": "some/name"}
    own = str(tmp_path)
    (tmp_path / "adapter_config.json").write_text('{"base_model_name_or_path": "big/base"}')
    assert model_parts(own) == {"base": "big/base", "adapter": own, "tokenizer": "big/base"}
    (tmp_path / "tokenizer.json").write_text("{}")
    assert model_parts(own)["tokenizer"] == own
    (tmp_path / "adapter_config.json").write_text("{}")
    with pytest.raises(ValueError, match="base_model"):
        model_parts(own)


def answer(prompt):
    """A model for the test: refuses one article, fails for another."""
    if "Title 3" in prompt:
        raise ValueError("no answer")
    return json.dumps({"summary": "The river runs by the market. The road goes home.", "key_entities": [], "confidence": 0.9, "refusal_reason": "none" if "Title 2" in prompt else None})


def test_labels_are_appended(spark, tmp_path, capsys):
    text = "The river runs by the market. The road goes home."
    spark.createDataFrame([(k, 1, "cleaned", f"Title {k}", "c", text, None) for k in range(1, 5)], "id long, source_fk long, status string, title string, category string, content_text string, published_at timestamp").write.parquet(f"{tmp_path}/articles")
    spark.createDataFrame([(1, "s", "S")], "id long, source_id string, name string").write.parquet(f"{tmp_path}/sources")
    spark.createDataFrame([(4, "llm", "v9", "old", True, None)], "article_fk long, source string, prompt_version string, summary_text string, qc_passed boolean, note string").write.parquet(f"{tmp_path}/labels")
    (tmp_path / "p.yaml").write_text("version: v9\nuser_template: '{title} ({category}, {source}): {content_text}'\nqc: {min_words: 3, max_words: 30, min_sentences: 1, max_sentences: 4}\n")
    args = ["label", "--prompt", f"{tmp_path}/p.yaml", "--model", "tests.test_command_line:answer", "--tables", str(tmp_path), "--wait", "0"]
    assert main(args, spark) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (report["requested"], report["qc_passed"], report["qc_failed"], report["llm_errors"]) == (3, 1, 1, 1)
    assert {(r["article_fk"], r["qc_passed"]) for r in spark.read.parquet(f"{tmp_path}/labels").collect()} == {(4, True), (1, True), (2, False)}
    status = lambda: {r["id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/articles").collect()}
    assert status() == {1: "summarized", 2: "cleaned", 3: "cleaned", 4: "cleaned"} and spark.read.parquet(f"{tmp_path}/articles").where("content_text IS NULL").count() == 0
    assert main([*args, "--concurrency", "3"], spark) == 1
    assert spark.read.parquet(f"{tmp_path}/labels").count() == 3 and status()[1] == "summarized"


def test_export_names_a_version_once(spark, tmp_path, data):
    from corpusloom.plans import domain

    for name, rows in (("labels", domain.labels(spark, data)), ("articles", domain.articles(spark, data)), ("sources", domain.sources(spark, data))):
        rows.write.parquet(f"{tmp_path}/{name}")
    args = ["export", "first", "--prompt-version", "v1", "--tables", str(tmp_path), "--dataset-root", f"{tmp_path}/sets"]
    assert main(args, spark) == 0 and main(args, spark) == 2
    kept = spark.read.parquet(f"{tmp_path}/sets/first_manifest")
    assert kept.selectExpr("sum(bitmap_count(ids))").first()[0] == spark.read.json(f"{tmp_path}/sets/first").select("article_id").distinct().count() > 0


def web(url):
    """A small web for the test: a feed, robots rules, and pages."""
    words = " ".join(f"word{k}" for k in range(60))
    if url.endswith("/feed"):
        items = "".join(f"<item><title>Story {k}</title><link>https://a.vn/{'private' if k == 2 else 'news'}/{k}</link></item>" for k in range(6))
        return 200, f"<rss><channel>{items}</channel></rss>"
    if url.endswith("/robots.txt"):
        return 200, "User-agent: *\nDisallow: /private/"
    assert "/private/" not in url
    return {"0": (200, f"<article><p>{words}</p></article>"), "1": (404, ""), "3": (200, "<p>short</p>")}.get(url[-1], (200, f"<article><p>{words.replace('word', 'term')} {words}</p></article>"))


def test_crawl(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("defaults: {max_items_per_feed: 5}\nsources:\n- {source_id: a, domain: a.vn, rss: ['https://a.vn/feed']}\n- {source_id: b, enabled: false, rss: ['https://b.vn/feed']}\n")
    args = ["crawl", "--config", f"{tmp_path}/s.yaml", "--fetch", "tests.test_command_line:web", "--store", f"{tmp_path}/store", "--delay", "0", "--wait", "0"]
    assert main(args, spark) == 0 and main(args, spark) == 1
    assert {r["title"] for r in spark.read.parquet(f"{tmp_path}/store").collect()} == {"Story 0", "Story 4"}
    runs = {r["batch"]: r for r in spark.read.parquet(f"{tmp_path}/store_runs").collect()}
    assert (runs[1]["n_new"], runs[1]["n_skipped"], runs[1]["n_errors"], runs[1]["status"]) == (2, 1, 2, "success")
    assert (runs[2]["n_new"], runs[2]["n_skipped"], runs[2]["n_errors"], runs[2]["status"]) == (0, 3, 2, "partial")
    known = Table(spark, f"{tmp_path}/store_sources", "source_id", feeds.CATALOGUE, buckets=1)
    assert {(r["source_id"], r["enabled"]) for r in known.read().collect()} == {("a", True), ("b", False)} and known.snapshot().version == 2
    assert main(["crawl", "--config", f"{tmp_path}/none.yaml", "--fetch", "tests.test_command_line:web"], spark) == 2


def a_model():
    return lambda texts: [t.split(".")[0] for t in texts]


def a_scorer(predictions, references):
    return [float(p in r) for p, r in zip(predictions, references, strict=True)]


def test_evaluate_a_model(spark, tmp_path, capsys):
    text = "The river rose. The market closed early."
    rows = spark.createDataFrame([(i, "s", f"u{i}", "t", None, None, text, text, "v1", s) for i, s in enumerate(("train", "val", "test"))], "article_id long, source string, url string, title string, category string, published_at string, content_text string, summary string, prompt_version string, split string")
    write_dataset(rows, f"{tmp_path}/v1")
    for missing in ("no_such_module:f", "tests.test_command_line:no_such", "nothing"):
        assert main(["evaluate", "--dataset-root", str(tmp_path), "--model", missing], spark) == 2
    assert main(["evaluate", "--dataset-root", str(tmp_path), "--model", "tests.test_command_line:a_model", "--scorer", "tests.test_command_line:a_scorer", "--metrics", f"{tmp_path}/m"], spark) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["scorer_f1"] == 1.0 and 0 < out["rouge1"] < 1
    assert spark.read.parquet(f"{tmp_path}/m").first()["metrics"]["scorer_f1"] == "1.0"
