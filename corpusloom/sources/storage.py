"""Reading and writing tables; nothing here infers a schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import EXAMPLE

SPLITS = ("train", "val", "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, place: str, name: str, **options) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables, or of a database if ``place`` is a JDBC URL.

    For a database, ``options`` are the reader's; with ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` it is read in parallel.
    """
    if place.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=place, dbtable=name, **options).load()
    return spark.read.parquet(f"{place}/{name}")


def save(rows: DataFrame, place: str, name: str, *, mode: str = "append", **options) -> None:
    """Write ``rows`` to where ``load`` finds them."""
    if place.startswith("jdbc:"):
        rows.write.format("jdbc").options(url=place, dbtable=name, **options).mode(mode).save()
    else:
        rows.write.mode(mode).parquet(f"{place}/{name}")


def update(spark: SparkSession, rows: DataFrame, place: str, name: str, key: str) -> None:
    """Set the columns of ``rows`` in the rows of a stored table that have their key.

    A database is updated in place, a row of ``rows`` at a time from the driver, so give it
    a batch's worth.  Of a folder, the files that hold one of the keys are written anew and
    then deleted; who must never see a half-done change keeps the table as ``versions.Table``.
    """
    if place.startswith("jdbc:"):
        columns = [c for c in rows.columns if c != key]
        connection = spark._jvm.java.sql.DriverManager.getConnection(place)
        try:
            connection.setAutoCommit(False)
            quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(place).quoteIdentifier
            change = connection.prepareStatement(f"UPDATE {name} SET {', '.join(f'{quoted(c)} = ?' for c in columns)} WHERE {quoted(key)} = ?")
            for row in rows.toLocalIterator():
                for k, c in enumerate((*columns, key), 1):
                    change.setObject(k, row[c])
                change.executeUpdate()
            connection.commit()
        finally:
            connection.close()
        return
    folder = f"{place}/{name}"
    stored = spark.read.parquet(folder)
    rows = cut_lineage(rows.join(stored.select(key), key, "left_semi"))
    _rewritten(spark, folder, _holding(stored, rows, key), lambda old: upsert(old, rows, key))


def remove(spark: SparkSession, folder: str, keys: DataFrame, key: str, *, partitioned: tuple[str, ...] = ()) -> int:
    """Take the rows with a key of ``keys`` out of a folder of Parquet files, off the disk; how many files were written anew."""
    stored = spark.read.parquet(folder)
    keys = cut_lineage(keys.select(F.col(key).cast(stored.schema[key].dataType)).distinct())
    held = _holding(stored, keys, key)
    _rewritten(spark, folder, held, lambda old: old.join(keys, key, "left_anti"), partitioned)
    return len(held)


def _holding(stored: DataFrame, keys: DataFrame, key: str) -> list[str]:
    """The files of ``stored`` that hold one of the keys."""
    return [r[0] for r in stored.select(key, F.col("_metadata.file_path").alias("_file")).join(keys.select(key), key, "left_semi").select("_file").distinct().collect()]


def _rewritten(spark: SparkSession, folder: str, held: list[str], change: Callable[[DataFrame], DataFrame], partitioned: tuple[str, ...] = ()) -> None:
    """Write the rows of some files anew as ``change`` makes them, then delete the files."""
    if not held:
        return
    schema = spark.read.parquet(folder).schema
    changed = change(spark.read.schema(schema).option("basePath", folder).parquet(*held))
    changed.write.mode("append").partitionBy(*partitioned).parquet(folder) if partitioned else changed.write.mode("append").parquet(folder)
    for path in held:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a folder and all in it, by its address."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path)) if "%" in path else spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all of the cluster sees: the session's own setting.

    Without one, a temporary folder serves a session that runs on this machine alone; on a
    cluster each machine would write to a disk of its own, so there it raises.
    """
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None) or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if not found:
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/corpusloom-work-{uuid.uuid4().hex}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split of a JSONL dataset.

    Blank lines go, a missing file raises ``FileNotFoundError``; null texts become '', a
    missing id 0, an id that is no number raises; category and published_at stay null.
    """
    path = next((p for p in (f"{folder}/{split}.jsonl", f"{folder}/split={split}") if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"{folder}/{split}.jsonl")
    raw = spark.read.schema(EXAMPLE.replace("article_id bigint", "article_id string")).json(path)
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "url", "title")]
    rest = [F.coalesce(c, F.lit("")).alias(c) for c in ("content_text", "summary", "prompt_version")]
    return raw.select(F.coalesce(F.col("article_id").cast("bigint"), F.lit(0)).alias("article_id"), *texts, "category", "published_at", *rest)


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """All three splits with a column ``split``."""
    parts = [read_split(spark, folder, s).withColumn("split", F.lit(s)) for s in SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_dataset(rows: DataFrame, folder: str) -> None:
    """Rows with a column ``split`` as JSON lines under ``split=…``, nulls written out; files hold ranges of ids, in order."""
    rows.repartitionByRange("split", "article_id").sortWithinPartitions("split", "article_id").write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(folder)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` by ``key``: a new row's values win, columns that it lacks keep theirs."""
    o, n = old.alias("o"), new.alias("n")
    columns = [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new.columns and c != key else F.coalesce(f"n.{key}", f"o.{key}").alias(c) if c == key else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows skipped): a row whose value of any key is stored already is skipped."""
    fresh = rows
    for key in keys:
        fresh = fresh.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    skipped = rows.join(fresh.select(keys[0]), keys[0], "left_anti")
    return fresh.select(rows.columns), skipped


def without_sources(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the sources in ``gone`` (column ``id``) and all that hangs on them: runs, articles, their summaries and labels."""
    ids = gone.select("id").distinct()
    articles = tables["articles"].join(ids.withColumnRenamed("id", "source_fk"), "source_fk", "left_semi").select("id")
    out = without_articles(tables, articles)
    out["articles"] = out["articles"].select(tables["articles"].columns)
    out["sources"] = tables["sources"].join(ids, "id", "left_anti")
    if "crawl_runs" in tables:
        out["crawl_runs"] = tables["crawl_runs"].join(ids.withColumnRenamed("id", "source_fk"), "source_fk", "left_anti")
    return out


def without_articles(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the articles in ``gone`` (column ``id``), their summaries and labels."""
    ids = gone.select("id").distinct()
    out = dict(tables, articles=tables["articles"].join(ids, "id", "left_anti"))
    for name in ("summaries", "labels"):
        if name in tables:
            out[name] = tables[name].join(ids.withColumnRenamed("id", "article_fk"), "article_fk", "left_anti")
    return out


def metrics_row(spark: SparkSession, folder: str, run: str, params: dict, metrics: dict) -> None:
    """Append one run's parameters and metrics, as text, to a Parquet table."""
    row = [(run, {k: str(v) for k, v in params.items()}, {k: str(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "run string, params map<string,string>, metrics map<string,string>").write.mode("append").parquet(folder)
