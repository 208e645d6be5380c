"""Sources and sinks over the driver's tables: what a writer wrote, a reader reads back, with the SQL of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orpheon.operators.metrics import confusion
from orpheon.plans.registry import Registry, scratch, table
from orpheon.plans.retrieval_queries import _grid, _grid_sql
from orpheon.sources import readers, sinks

Q = Registry()


@Q.query("split_manifest", "SELECT doc_id, 'clips/' || lang || '/' || doc_id || '.wav' AS audio_path, doc_id % 5 AS fold, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_manifest(spark, sf_dir):
    path, n = scratch(spark, "manifest"), F.col("doc_id")
    name = F.concat(F.lit("clips\\"), "lang", F.lit("\\"), n.cast("string"), F.lit(".wav"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("audio_path"), (n % 5).cast("int").alias("fold"), F.when(n % 10 < 8, "train").otherwise("test").alias("split"))
    sinks.split_jsonl(rows, path)
    return readers.manifest(spark, path, extra="doc_id long, fold int, split string").select("doc_id", "audio_path", F.col("fold").cast("long").alias("fold"), "split")


@Q.query("numeric_csv", "SELECT event_id::DOUBLE AS time, value AS f0 FROM events")
def numeric_csv(spark, sf_dir):
    path = scratch(spark, "numbers")
    table(spark, sf_dir, "events").select(F.col("event_id").cast("double"), "value").write.csv(path)
    return readers.numeric_csv(spark, path)


@Q.query("appended_csv", "SELECT o_orderkey, o_totalprice FROM orders")
def appended_csv(spark, sf_dir):
    """Truncated by the first write, then appended to."""
    path, orders = scratch(spark, "rows"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sinks.csv_rows(orders, path)
    sinks.csv_rows(orders.where("o_orderkey % 2 = 0"), path)
    sinks.csv_rows(orders.where("o_orderkey % 2 = 1"), path, append=True)
    return spark.read.schema("o_orderkey long, o_totalprice double").option("header", "true").csv(path)


@Q.query("condition_grid_csv", _grid_sql("true") + " SELECT query_cond AS query_program, target_cond AS target_program, round(map, 6) AS map, n_queries FROM grid")
def condition_grid_csv(spark, sf_dir):
    path = scratch(spark, "grid")
    sinks.grid_csv(_grid(spark, sf_dir, False), path)
    return readers.condition_grid(spark, path).withColumns({"query_program": F.col("query_program").cast("long"), "target_program": F.col("target_program").cast("long")})


@Q.query("segment_text", "WITH e AS (SELECT event_id AS start, lead(event_id) OVER (ORDER BY event_id) AS stop, event_type FROM events) SELECT start::DOUBLE AS start, stop::DOUBLE AS stop, CASE event_type WHEN 'click' THEN 'verse' ELSE 'bridge' END AS label FROM e WHERE stop IS NOT NULL AND event_type IN ('click', 'view')")
def segment_text(spark, sf_dir):
    """One annotation file; a file is one window, as an annotation has one piece's lines."""
    path = scratch(spark, "segments")
    table(spark, sf_dir, "events").select(F.concat_ws(" ", F.col("event_id").cast("string"), F.initcap("event_type"))).coalesce(1).write.text(path)
    return readers.segment_text(spark, path, {"click": "verse", "view": "bridge"}).select("start", "stop", "label")


@Q.query("url_table", "SELECT page_id::VARCHAR AS id, lpad(page_id::VARCHAR, 11, '0') AS video_id FROM pages WHERE page_id % 4 > 0")
def url_table(spark, sf_dir):
    path, digits = scratch(spark, "urls"), F.lpad(F.col("page_id").cast("string"), 11, "0")
    url = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), digits)).otherwise(F.concat(F.lit("https://www.youtube.com/watch?x=1&v="), digits, F.lit("&t=3")))
    sinks.csv_rows(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), url.alias("url")), path)
    return readers.url_table(spark, path)


@Q.query("embedding_cache", "SELECT vec_id::VARCHAR AS clip_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6) AS fingerprint FROM embeddings WHERE vec_id % 3 = 0")
def embedding_cache(spark, sf_dir):
    path = scratch(spark, "cache")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("clip_id"), F.col("embedding").cast("array<double>").alias("vec"))
    sinks.embeddings(v, path, "enc", "task", "c0")
    found = readers.cached_embeddings(spark, path, v.where("cast(clip_id as long) % 3 = 0"))
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("clip_id", F.round(weighted, 6).alias("fingerprint"))


@Q.query("cache_report", "SELECT CASE vec_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS encoder, 'task' AS task, 'c0' AS config_hash, count(*) AS clips FROM embeddings GROUP BY 1")
def cache_report(spark, sf_dir):
    path = scratch(spark, "cache")
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("clip_id"), F.col("embedding").alias("vec"))
    for encoder, rest in (("a", 0), ("b", 1)):
        sinks.embeddings(v.where(F.col("vec_id") % 2 == rest).drop("vec_id"), path, encoder, "task", "c0")
    return sinks.cache_report(spark, path).select("encoder", "task", "config_hash", "clips")


@Q.query("prediction_dump", "SELECT l_returnflag AS label, CASE WHEN l_quantity > 25 THEN 'R' ELSE l_linestatus END AS pred, count(*) AS n FROM lineitem GROUP BY ALL")
def prediction_dump(spark, sf_dir):
    path = scratch(spark, "predictions")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") > 25, "R").otherwise(F.col("l_linestatus")).alias("pred"))
    sinks.prediction_dump(rows, "label", "pred", path)
    return confusion(spark.read.parquet(f"{path}/rows"), "label", "pred")
