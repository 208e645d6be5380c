"""Dataset preparation, audio arrays, probes and sweeps over the driver's tables, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from orpheon.functions import audio as A
from orpheon.functions import music as M
from orpheon.functions import plugins as U
from orpheon.functions.vectors import argmax
from orpheon.operators import hmm as H
from orpheon.operators import metrics as X
from orpheon.operators import prepare as P
from orpheon.operators import probes as B
from orpheon.plans.registry import Registry, table
from orpheon.plans.retrieval_queries import _fingerprint, rounded

Q = Registry()


@Q.query("window_records")
def window_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    rows = e.select(F.col("user_id").alias("piece"), (F.col("event_id") % 1000 - 2).cast("double").alias("start_sec"), (F.col("event_id") % 1000 + F.col("value") % 3).cast("double").alias("end_sec"), F.col("event_type").alias("letter"), F.lit(1200.0).alias("piece_end"))
    return P.window_records(rows, "piece")


@Q.query("duration_filter", "SELECT doc_id FROM documents WHERE n_chars / 100.0 >= 2 AND n_chars / 100.0 <= 20 AND length(text) - length(replace(text, ' ', '')) <= n_chars // 6")
def duration_filter(spark, sf_dir):
    labels = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return P.duration_filter(table(spark, sf_dir, "documents"), "n_chars", 100, labels, 2.0, 20.0, 6).select("doc_id")


@Q.query("encoder_family", "SELECT p_partkey, CASE WHEN contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'ring') THEN 'ring' WHEN contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'red') THEN 'red' ELSE p_name END AS family FROM part")
def encoder_family(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.encoder_family(F.col("p_name"), ("ring", "red")).alias("family"))


@Q.query("console_metrics", "SELECT event_id, 'test/' || event_type AS metric, round(value, 2) AS value FROM events WHERE event_id % 2 = 0")
def console_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("│ test/"), "event_type", F.lit(" │ "), F.format_string("%.2f", F.round("value", 2)), F.lit(" │"))).otherwise("epoch 3 done")
    metric, value = P.console_metrics(F.col("line"))
    return e.select("event_id", line.alias("line")).select("event_id", metric.alias("metric"), value.alias("value")).where("metric is not null")


@Q.query("run_checkpoint_match", "SELECT p_partkey FROM part WHERE p_size % 13 = 3 AND contains(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]', '', 'g'), 'brand1') AND contains(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]', '', 'g'), 'economy')")
def run_checkpoint_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("layer-"), (F.col("p_size") % 13).cast("string"), F.lit("-test"))
    return p.where(P.run_matches(name, F.concat_ws(" / ", "p_brand", "p_type"), F.lit("layer-3-test"), F.lit("BRAND_1"), F.lit("Economy"))).select("p_partkey")


@Q.query("remaining_runs", "WITH g AS (SELECT e.encoder, t.task, l.layer, 0 AS fold FROM (SELECT unnest(['a', 'b']) AS encoder) e, (SELECT unnest(['x', 'y']) AS task) t, (SELECT unnest(range(13)) AS layer) l), d AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS encoder, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'y' END AS task, p_size % 13 AS layer FROM part WHERE p_partkey % 41 = 0) SELECT g.encoder, g.task, g.layer FROM g ANTI JOIN d ON g.encoder = d.encoder AND g.task = d.task AND g.layer = d.layer")
def remaining_runs(spark, sf_dir):
    k = F.col("p_partkey")
    done = table(spark, sf_dir, "part").where("p_partkey % 41 = 0").select(F.when(k % 2 == 0, "a").otherwise("b").alias("encoder"), F.when(k % 3 == 0, "x").otherwise("y").alias("task"), (F.col("p_size") % 13).alias("layer"), F.lit(0).alias("fold"), F.lit("test/map").alias("metric"))
    return P.remaining(P.parameter_grid(spark, ["a", "b"], ["x", "y"], list(range(13))), done).select("encoder", "task", F.col("layer").cast("long").alias("layer"))


@Q.query("oracle_values", "SELECT 'nations' AS metric, count(*)::DOUBLE AS got, 25.0::DOUBLE AS expected, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'regions', count(DISTINCT n_regionkey)::DOUBLE, 5.0::DOUBLE, count(DISTINCT n_regionkey) = 5 FROM nation")
def oracle_values(spark, sf_dir):
    """Values that hold at every scale."""
    found = table(spark, sf_dir, "nation").agg(F.count("*").alias("nations"), F.count_distinct("n_regionkey").alias("regions"))
    return P.check_values(found, {"nations": 25.0, "regions": 5.0}, 0.0)


@Q.query("valid_or_longest", "WITH d AS (SELECT doc_id, source, n_chars, n_chars BETWEEN 200 AND 400 AND lang = 'de' AS ok FROM documents), b AS (SELECT source, bool_or(coalesce(ok, false)) AS has, arg_max(doc_id, (n_chars, -doc_id)) AS best FROM d GROUP BY source) SELECT doc_id, n_chars FROM d JOIN b USING (source) WHERE coalesce(ok, false) OR NOT has AND doc_id = best")
def valid_or_longest(spark, sf_dir):
    valid = F.col("n_chars").between(200, 400) & (F.col("lang") == "de")
    return P.keep_valid_or_longest(table(spark, sf_dir, "documents"), ["source"], valid, "n_chars", "doc_id").select("doc_id", "n_chars")


@Q.query("best_by_lift", "SELECT p_type AS window, arg_max(p_size, (round(p_retailprice - p_size, 6), -p_size)) AS layer, round(max(p_retailprice - p_size), 6) AS lift FROM part GROUP BY p_type")
def best_by_lift(spark, sf_dir):
    from orpheon.operators.experiments import best_by

    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("window"), F.col("p_size").alias("layer"), F.round(F.col("p_retailprice") - F.col("p_size"), 6).alias("lift"))
    return best_by(p, ["window"], "lift")


@Q.query("bar_tallies", "SELECT CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS staff, l_linenumber AS bar, sum((l_returnflag = 'R')::INT)::BIGINT AS motif, count(*) AS total FROM lineitem GROUP BY GROUPING SETS ((l_linenumber), (l_linenumber, l_linestatus))")
def bar_tallies(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("motif", (F.col("l_returnflag") == "R").cast("int"))
    staff, bar = F.col("l_linestatus"), F.col("l_linenumber")
    sets = l.groupingSets([[bar], [bar, staff]], bar, staff)
    return sets.agg(F.sum("motif").alias("motif"), F.count("*").alias("total"), F.grouping("l_linestatus").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(staff).alias("staff"), bar.alias("bar"), "motif", "total")


@Q.query("channel_mix", "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: i * (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2)), 8) AS fingerprint FROM embeddings")
def channel_mix(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    wave = F.array(F.slice(v, 1, 32), F.slice(v, 33, 32))
    return _fingerprint(table(spark, sf_dir, "embeddings").select("vec_id", A.channels(wave, 1, "mix")[0].alias("embedding")))


@Q.query("fixed_crop", "SELECT vec_id, round(list_sum(list_transform(embedding[11:30], lambda x, i: x::DOUBLE * i)), 8) AS fingerprint FROM embeddings")
def fixed_crop(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return _fingerprint(table(spark, sf_dir, "embeddings").select("vec_id", A.crop(v, 20, F.lit(10)).alias("embedding")))


@Q.query("random_crop_with_noise")
def random_crop_with_noise(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    start = A.random_start(F.col("vec_id"), F.size("embedding"), 20)
    return table(spark, sf_dir, "embeddings").select("vec_id", A.noisy(A.crop(v, 20, start), 20.0).alias("x"))


@Q.query("mel_spectrogram")
def mel_spectrogram(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.mel_spectrogram(F.col("embedding").cast("array<double>"), 100.0, 8, 16, 8).alias("mel"))


@Q.query("fixed_linear_head", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i % 3 - 1))) + 0.25, 7) AS a, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i % 5))), 7) AS b FROM embeddings")
def fixed_linear_head(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    size = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    weights = [[float(i % 3 - 1) for i in range(1, size + 1)], [float(i % 5) for i in range(1, size + 1)]]
    out = B.fixed_linear(F.col("embedding").cast("array<double>"), weights, [0.25, 0.0])
    return v.select("vec_id", out.alias("o")).select("vec_id", F.round(F.col("o")[0], 7).alias("a"), F.round(F.col("o")[1], 7).alias("b"))


@Q.query("linear_probe")
def linear_probe(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    found = B.linear_probe(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "embedding", "label")
    return found.agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))


@Q.query("regression_probe")
def regression_probe(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("y", F.col("embedding")[0].cast("double") * 2 + F.col("embedding")[1])
    found = B.regression_probe(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "embedding", "y")
    return found.agg(F.count("*").alias("n"), X.r2(found, "prediction", "y").alias("r2"))


@Q.query("per_layer_probes")
def per_layer_probes(spark, sf_dir):
    from orpheon.plans.retrieval_queries import _layers

    rows = _layers(spark, sf_dir)
    return B.per_layer_heads(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "layer", "v", "label", [0, 1, 2, 3])


@Q.query("beat_evaluation")
def beat_evaluation(spark, sf_dir):
    """Decode beats from activations and score them against every eighth frame."""
    from orpheon.plans.sequence_queries import FPS, _activations, _series

    found = _series(_activations(spark, sf_dir)).select("key", H.beats_of(F.col("x"), FPS, min_bpm=60, max_bpm=200).alias("est"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k * 0.8).alias("ref"))
    return rounded(X.event_f_measure(found, "est", "ref", 0.07))


class _Mean(U.Metric):
    def start(self):
        return {"n": 0, "s": 0.0}

    def update(self, state, batch: pd.DataFrame):
        return {"n": state["n"] + len(batch), "s": state["s"] + float(batch["value"].sum())}

    def compute(self, state):
        return state["s"] / state["n"] if state["n"] else 0.0


@Q.query("user_metric", "SELECT round(avg(value), 6) AS mean FROM events")
def user_metric(spark, sf_dir):
    mean = U.measure(table(spark, sf_dir, "events").select("value"), _Mean())
    return spark.createDataFrame([(round(mean, 6),)], "mean double")


@Q.query("user_encoder", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings")
def user_encoder(spark, sf_dir):
    def make():
        return lambda batch: pd.DataFrame({"vec_id": batch["vec_id"], "out": [list(v) for v in batch["embedding"]]})

    encoded = U.encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), make, "vec_id long, out array<float>")
    return encoded.select("vec_id", argmax(F.col("out")).cast("long").alias("best"))


@Q.query("key_vote", "WITH v AS (SELECT user_id, event_id % 24 AS k, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(k, (n, -k)) AS key FROM v GROUP BY user_id")
def key_vote(spark, sf_dir):
    votes = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 24).alias("k")).agg(F.count("*").alias("n"))
    return votes.groupBy("user_id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("key"))


@Q.query("pitch_classes", "SELECT p_partkey, ['C', 'C#', 'Db', 'E', 'Fb', 'B#', 'Cb', 'G##'][p_partkey % 8 + 1] AS name, [0, 1, 1, 4, 4, 0, 11, 9][p_partkey % 8 + 1] AS pc FROM part")
def pitch_classes(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("C", "C#", "Db", "E", "Fb", "B#", "Cb", "G##")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 8).cast("int")).alias("name"))
    return p.select("p_partkey", "name", M.pitch_class(F.col("name")).cast("int").alias("pc"))
