"""Metrics and experiment summaries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orpheon.functions.music import key_score
from orpheon.functions.vectors import argmax, softmax
from orpheon.operators import experiments as X
from orpheon.operators import metrics as M
from orpheon.plans.registry import Registry, table
from orpheon.plans.retrieval_queries import rounded

Q = Registry()

# Clips: two vectors are one file, ten of their elements are logits, the label is the first clip's.
CLIPS = """c AS (SELECT vec_id // 2 AS f, vec_id, label, list_transform(embedding[1:10], lambda x: 8 * x::DOUBLE) AS v FROM embeddings),
s AS (SELECT f, vec_id, label, list_transform(v, lambda x: exp(x - list_max(v))) AS e, v FROM c), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)"""


def _pooled(what: str) -> str:
    return f"m AS (SELECT f, list(a ORDER BY i) AS m FROM (SELECT f, i, avg(x) AS a FROM (SELECT f, unnest({what}) AS x, generate_subscripts({what}, 1) AS i FROM p) GROUP BY f, i) GROUP BY f), l AS (SELECT f, arg_min(label, vec_id) AS label FROM c GROUP BY f)"


def _clips(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 8)
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("f"), "vec_id", "label", v.alias("v"))


@Q.query("file_accuracy_mean_probability", f"WITH {CLIPS}, {_pooled('p')} SELECT count(*) AS n, round(avg((list_position(m, list_max(m)) - 1 = label)::INT), 9) AS accuracy FROM m JOIN l USING (f)")
def mean_probability(spark, sf_dir):
    return rounded(M.accuracy(M.file_scores(_clips(spark, sf_dir), "f", "v", "label", "vec_id", True), "scores", "label"))


@Q.query("file_accuracy_mean_logit", f"WITH {CLIPS}, {_pooled('v')} SELECT count(*) AS n, round(avg((list_position(m, list_max(m)) - 1 = label)::INT), 9) AS accuracy FROM m JOIN l USING (f)")
def mean_logit(spark, sf_dir):
    return rounded(M.accuracy(M.file_scores(_clips(spark, sf_dir), "f", "v", "label", "vec_id"), "scores", "label"))


@Q.query("inference_dump", f"WITH {CLIPS}, {_pooled('v')}, q AS (SELECT f, m, list_transform(m, lambda x: exp(x - list_max(m))) AS e FROM m) SELECT f AS file_id, list_position(m, list_max(m)) - 1 AS pred, round(list_max(e) / list_sum(e), 9) AS confidence FROM q")
def inference_dump(spark, sf_dir):
    files = M.file_scores(_clips(spark, sf_dir), "f", "v", "label", "vec_id")
    return files.select(F.col("f").alias("file_id"), argmax(F.col("scores")).cast("long").alias("pred"), F.round(F.array_max(softmax(F.col("scores"))), 9).alias("confidence"))


@Q.query("tagging_auroc_ap", """WITH c AS (SELECT vec_id // 2 AS f, vec_id, label, embedding[1:4] AS v FROM embeddings), m AS (SELECT f, i - 1 AS tag, avg(x) AS a FROM (SELECT f, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM c) GROUP BY f, i),
t AS (SELECT f, tag, round(1 / (1 + exp(-a)), 9) AS s, (f * 7 + tag) % 3 = 0 AS y FROM m),
g AS (SELECT tag, s, sum(y::INT) AS p, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS kk FROM g WINDOW w AS (PARTITION BY tag ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT tag, round(sum((n - p) * (tp - p / 2)) / (sum(p) * sum(n - p)), 9) AS auroc, round(sum(p * tp / kk) / sum(p), 9) AS ap FROM k GROUP BY tag""")
def tagging(spark, sf_dir):
    clips = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("f"), F.slice("embedding", 1, 4).alias("v"))
    scores = M.tag_scores(clips, "f", "v").withColumn("score", F.round("score", 9))
    return rounded(M.rank_metrics(scores.withColumn("y", (F.col("f") * 7 + F.col("tag")) % 3 == 0), "tag", "score", "y")).withColumn("tag", F.col("tag").cast("long"))


PRED = "CASE WHEN event_id % 4 = 0 THEN 'click' WHEN event_id % 9 = 0 THEN 'other' ELSE event_type END"


def _predictions(spark, sf_dir):
    pred = F.when(F.col("event_id") % 4 == 0, "click").when(F.col("event_id") % 9 == 0, "other").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), pred.alias("pred"))


@Q.query("confusion_matrix", f"SELECT event_type AS label, {PRED} AS pred, count(*) AS n FROM events GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_predictions(spark, sf_dir), "label", "pred")


PER_CLASS = f"""e AS (SELECT event_type AS l, {PRED} AS p FROM events), k AS (SELECT l AS c FROM e UNION SELECT p FROM e), r AS (SELECT c, (SELECT count(*) FROM e WHERE l = c AND p = c) AS tp, (SELECT count(*) FROM e WHERE l = c) AS s, (SELECT count(*) FROM e WHERE p = c) AS q FROM k),
f AS (SELECT c AS class, CASE WHEN q > 0 THEN tp / q ELSE 0.0 END AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS recall, s AS support FROM r), z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM f)"""


@Q.query("per_class_metrics", f"WITH {PER_CLASS} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, support, round(f1, 9) AS f1 FROM z")
def per_class_metrics(spark, sf_dir):
    return rounded(M.per_class(_predictions(spark, sf_dir), "label", "pred"))


@Q.query("macro_f1", f"WITH {PER_CLASS} SELECT round(avg(f1), 9) AS macro_f1, count(*) AS n_classes FROM z")
def macro_f1(spark, sf_dir):
    return rounded(M.macro_f1(M.per_class(_predictions(spark, sf_dir), "label", "pred")))


@Q.query("well_posed_subset", f"SELECT count(*) AS n, round(avg((event_type = {PRED})::INT), 9) AS accuracy FROM events WHERE event_type IN ('click', 'view')")
def well_posed_subset(spark, sf_dir):
    return _predictions(spark, sf_dir).where("label in ('click', 'view')").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("int")), 9).alias("accuracy"))


@Q.query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("ok", (F.col("label") == F.col("pred")).cast("int"))
    return M.bootstrap_interval(p, "ok", 100)


REG = "r AS (SELECT o.o_orderkey, o.o_totalprice AS y, coalesce(sum(l.l_extendedprice), 0.0) AS p FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL)"


@Q.query("r_squared", f"WITH {REG} SELECT round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 9) AS r2, count(*) AS n FROM r")
def r_squared(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("p"))
    r = table(spark, sf_dir, "orders").join(sums, "o_orderkey", "left").select(F.col("o_totalprice").alias("y"), F.coalesce("p", F.lit(0.0)).alias("p"))
    return rounded(r.agg(M.r2(r, "p", "y").alias("r2"), F.count("*").alias("n")))


@Q.query("key_weighted_score", "WITH k AS (SELECT event_id % 24 AS r, (event_id * 7 + user_id) % 24 AS e FROM events) SELECT round(avg(CASE WHEN e = r THEN 1.0 WHEN (e < 12) = (r < 12) AND (e % 12 - r % 12 + 12) % 12 = 7 THEN 0.5 WHEN (e < 12) <> (r < 12) AND r < 12 AND (e % 12 - r % 12 + 12) % 12 = 9 THEN 0.3 WHEN (e < 12) <> (r < 12) AND r >= 12 AND (e % 12 - r % 12 + 12) % 12 = 3 THEN 0.3 WHEN (e < 12) <> (r < 12) AND e % 12 = r % 12 THEN 0.2 ELSE 0.0 END)::DOUBLE, 9) AS score FROM k")
def key_weighted_score(spark, sf_dir):
    r, e = F.col("event_id") % 24, (F.col("event_id") * 7 + F.col("user_id")) % 24
    return table(spark, sf_dir, "events").agg(F.round(F.avg(key_score(e, r)), 9).alias("score"))


FRAMES = "f AS (SELECT vec_id, i, (vec_id + i * i) % 30 AS p, CASE WHEN (vec_id + i) % 7 = 0 THEN -1 ELSE (vec_id + i * i + CASE WHEN i % 5 = 0 THEN 12 WHEN i % 3 = 0 THEN 1 ELSE 0 END) % 42 END AS t FROM embeddings, (SELECT unnest(range(40)) AS i))"


def _frames(spark, sf_dir):
    v = F.col("vec_id").cast("int")
    idx = F.sequence(F.lit(0), F.lit(39))
    pred = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: (v + i * i) % 30)
    target = F.transform(idx, lambda i: F.when((v + i) % 7 == 0, -1).otherwise((v + i * i + F.when(i % 5 == 0, 12).when(i % 3 == 0, 1).otherwise(0)) % 42))
    return table(spark, sf_dir, "embeddings").select("vec_id", pred.alias("pred"), target.alias("target"))


@Q.query("frame_pitch_accuracy", f"WITH {FRAMES} SELECT sum((p = t)::INT)::BIGINT AS correct, count(*) AS valid, round(sum((p = t)::INT) / count(*), 9) AS accuracy FROM f WHERE t <> -1")
def frame_pitch_accuracy(spark, sf_dir):
    return rounded(M.frame_accuracy(_frames(spark, sf_dir), "pred", "target"))


@Q.query("frame_chroma_accuracy", f"WITH {FRAMES} SELECT sum((p % 12 = t % 12)::INT)::BIGINT AS correct, count(*) AS valid, round(sum((p % 12 = t % 12)::INT) / count(*), 9) AS accuracy FROM f WHERE t <> -1")
def frame_chroma_accuracy(spark, sf_dir):
    return rounded(M.frame_accuracy(_frames(spark, sf_dir), "pred", "target", modulo=12))


@Q.query("masked_cross_entropy", "WITH l AS (SELECT vec_id, vec_id % 11 - 1 AS t, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT count(*) AS n, round(avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[(t + 1)::INT]), 9) AS loss FROM l WHERE t >= 0")
def masked_cross_entropy(spark, sf_dir):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    loss = M.masked_cross_entropy(v, (F.col("vec_id") % 11 - 1).cast("int"))
    return table(spark, sf_dir, "embeddings").agg(F.count(loss).alias("n"), F.round(F.avg(loss), 9).alias("loss"))


@Q.query("tempo_metrics", "WITH t AS (SELECT 60 + event_id % 120 AS ref, (60 + event_id % 120) * list_extract([1.0, 2.0, 0.5, 1.03, 1.1], (event_id % 5 + 1)::INT)::DOUBLE + value / 50 AS pred FROM events) SELECT round(avg((abs(pred - ref) <= 0.04 * ref)::INT), 9) AS acc1, round(avg((abs(pred - ref) <= 0.04 * ref OR abs(pred - 2 * ref) <= 0.08 * ref OR abs(pred - ref / 2) <= 0.02 * ref OR abs(pred - 3 * ref) <= 0.12 * ref OR abs(pred - ref / 3) <= 0.04 * ref / 3)::INT), 9) AS acc2, round(avg(abs(pred - ref)), 9) AS mae FROM t")
def tempo_metrics(spark, sf_dir):
    ref = (60 + F.col("event_id") % 120).cast("double")
    factor = F.element_at(F.array(*(F.lit(x) for x in (1.0, 2.0, 0.5, 1.03, 1.1))), (F.col("event_id") % 5 + 1).cast("int"))
    return rounded(M.tempo_accuracy(table(spark, sf_dir, "events").select(ref.alias("ref"), (ref * factor + F.col("value") / 50).alias("pred")), "pred", "ref"))


def _event_lists(spark, sf_dir):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("double")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", hours.alias("t"))
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("t"))))
    return e.groupBy("user_id").agg(pick("click").alias("est"), pick("view").alias("ref"))


def _matches_sql(tol: float, name: str) -> str:
    """CTE text: user_id and n, the most one-to-one pairs of l.est and l.ref within tol, by walking both in order."""
    near = f"abs(a[i] - b[j]) <= {tol}::DOUBLE"
    return f"""{name}(user_id, i, j, n, a, b) AS (SELECT user_id, 1, 1, 0, est, ref FROM l UNION ALL SELECT user_id, CASE WHEN {near} OR a[i] < b[j] THEN i + 1 ELSE i END, CASE WHEN {near} OR a[i] >= b[j] THEN j + 1 ELSE j END, n + ({near})::INT, a, b FROM {name} WHERE i <= len(a) AND j <= len(b))"""


EVENT_LISTS = "l AS (SELECT user_id, coalesce(list(epoch_us(ts) / 3.6e9::DOUBLE ORDER BY ts) FILTER (WHERE event_type = 'click'), []) AS est, coalesce(list(epoch_us(ts) / 3.6e9::DOUBLE ORDER BY ts) FILTER (WHERE event_type = 'view'), []) AS ref FROM events GROUP BY user_id)"


@Q.query("event_f_measure", f"WITH RECURSIVE {EVENT_LISTS}, {_matches_sql(3.0, 'r')}, m AS (SELECT user_id, max(n) AS n FROM r GROUP BY user_id), s AS (SELECT sum(m.n)::BIGINT AS matched, sum(len(est))::BIGINT AS n_est, sum(len(ref))::BIGINT AS n_ref FROM l JOIN m USING (user_id)) SELECT *, CASE WHEN n_est + n_ref = 0 THEN 1.0 ELSE 2 * matched / (n_est + n_ref) END::DOUBLE AS f1 FROM s")
def event_f_measure(spark, sf_dir):
    return M.event_f_measure(_event_lists(spark, sf_dir), "est", "ref", 3.0)


def _boundary_sql() -> str:
    cols = []
    for k, m in enumerate(("x", "y")):
        both, p, r = "len(ref) = 0 AND len(est) = 0", f"{m}.n / len(est)", f"{m}.n / len(ref)"
        p = f"CASE WHEN {both} THEN 1.0 WHEN len(est) = 0 THEN 0.0 ELSE {p} END"
        r = f"CASE WHEN {both} THEN 1.0 WHEN len(ref) = 0 THEN 0.0 ELSE {r} END"
        cols.append(f"round({p}, 9)::DOUBLE AS p_{k}, round({r}, 9)::DOUBLE AS r_{k}, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END, 9)::DOUBLE AS f_{k}")
    gap = "CASE WHEN len(ref) > 0 AND len(est) > 0 THEN list_median(list_transform(ref, lambda t: list_min(list_transform(est, lambda e: abs(e - t))))) END"
    return f"WITH RECURSIVE {EVENT_LISTS}, {_matches_sql(2.0, 'r')}, {_matches_sql(12.0, 'q')}, x AS (SELECT user_id, max(n) AS n FROM r GROUP BY user_id), y AS (SELECT user_id, max(n) AS n FROM q GROUP BY user_id) SELECT l.user_id, {', '.join(cols)}, round({gap}, 9) AS median_gap FROM l JOIN x USING (user_id) JOIN y USING (user_id)"


@Q.query("boundary_metrics", _boundary_sql())
def boundary_metrics(spark, sf_dir):
    return rounded(M.boundary_metrics(_event_lists(spark, sf_dir), "user_id", "ref", "est", (2.0, 12.0)))


@Q.query("seam_recall", "WITH e AS (SELECT user_id, epoch_us(ts) / 3.6e9::DOUBLE AS t, event_type FROM events), s AS (SELECT user_id, max(t) AS seam FROM e WHERE event_type = 'error' GROUP BY user_id) SELECT s.user_id, max((abs(e.t - seam) <= 2)::INT) = 1 AS hit FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = 'click' GROUP BY s.user_id")
def seam_recall(spark, sf_dir):
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).cast("double")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", hours)).alias("seam"), F.collect_list(F.when(F.col("event_type") == "click", hours)).alias("est"))
    return e.where("seam is not null and size(est) > 0").select("user_id", M.seam_recall(F.col("seam"), F.col("est"), 2.0).alias("hit"))


@Q.query("pairwise_frame_f", "WITH c AS (SELECT user_id, event_type AS r, event_id % 3 AS e, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, sum(n * (n - 1) / 2) AS b FROM c GROUP BY 1), r AS (SELECT user_id, sum(n * (n - 1) / 2) AS r FROM (SELECT user_id, r, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1), e AS (SELECT user_id, sum(n * (n - 1) / 2) AS e FROM (SELECT user_id, e, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1) SELECT user_id, round(CASE WHEN r + e > 0 THEN 2 * b / (r + e) ELSE 1.0 END, 9) AS f FROM b JOIN r USING (user_id) JOIN e USING (user_id)")
def pairwise_frame_f(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 3).alias("e"))
    return rounded(M.pairwise_f(e, ["user_id"], "event_type", "e"))


#: What is left of a text is a part of it in order, so the edits are the words left out.
@Q.query("word_error_rate", "WITH w AS (SELECT len(string_split_regex(lower(text), '\\s+')) AS n FROM benchmark) SELECT sum((n + 3) // 7)::BIGINT AS edits, sum(n)::BIGINT AS tokens, round(sum((n + 3) // 7) / sum(n), 9) AS rate FROM w")
def word_error_rate(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), r"\s+").alias("ref"))
    return rounded(M.error_rate(b.withColumn("hyp", F.filter("ref", lambda w, i: i % 7 != 3)), "ref", "hyp"))


@Q.query("character_edits", "SELECT item_id, levenshtein(text, replace(text, 'th', 'z')) AS edits, length(text) AS chars FROM benchmark")
def character_edits(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.levenshtein("text", F.replace("text", F.lit("th"), F.lit("z"))).cast("long").alias("edits"), F.length("text").cast("long").alias("chars"))


@Q.query("threshold_sweep", "WITH g AS (SELECT round(value, 1) AS s, sum((event_type = 'click')::INT) AS p, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS kk, sum(p) OVER () AS a FROM g) SELECT s AS threshold, round(tp / kk, 9) AS precision, round(tp / a, 9) AS recall, round(2 * tp / (kk + a), 9) AS f1 FROM k")
def threshold_sweep(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.round("value", 1).alias("s"), (F.col("event_type") == "click").alias("y"))
    return rounded(M.threshold_sweep(e, "s", "y"))


# Runs: a part is a run of an encoder (brand) and task (type) at a layer (size; every ninth is the mean of all).
RUNS = "r AS (SELECT p_brand AS encoder, p_type AS task, CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_size % 13 END AS layer, p_retailprice / 2000 + (p_partkey % 17) / 100 AS value, p_partkey % 5 AS fold, p_partkey FROM part)"
LAYERS = RUNS + ", v AS (SELECT encoder, task, layer, max(value) AS value FROM r GROUP BY ALL)"
BEST = LAYERS + ", b AS (SELECT coalesce(s.encoder, m.encoder) AS encoder, coalesce(s.task, m.task) AS task, s.best_layer, s.best_value, m.meanall FROM (SELECT encoder, task, arg_max(layer, (value, -layer)) AS best_layer, max(value) AS best_value FROM v WHERE layer >= 0 GROUP BY ALL) s FULL JOIN (SELECT encoder, task, max(value) AS meanall FROM v WHERE layer = -1 GROUP BY ALL) m ON s.encoder = m.encoder AND s.task = m.task)"


def _runs(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("encoder"), F.col("p_type").alias("task"), F.when(k % 9 == 0, -1).otherwise(F.col("p_size") % 13).alias("layer"), (F.col("p_retailprice") / 2000 + (k % 17) / 100).alias("value"), (k % 5).alias("fold"), "p_partkey")


def _layers(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("summary", F.create_map(F.lit("test/map"), F.when(F.col("p_partkey") % 2 == 0, F.col("value")), F.lit("test/acc"), F.col("value")))
    return X.best_runs(runs, ["encoder", "task", "layer"], ["test/map", "test/acc"], "summary")


def _best(spark, sf_dir):
    return X.best_layer(_layers(spark, sf_dir), ["encoder", "task"])


@Q.query("best_per_layer", f"WITH {LAYERS} SELECT encoder, task, layer, round(value, 9) AS value FROM v")
def best_per_layer(spark, sf_dir):
    return rounded(_layers(spark, sf_dir))


@Q.query("best_layer_vs_mean_all", f"WITH {BEST} SELECT encoder, task, best_layer, round(best_value, 9) AS best_value, round(meanall, 9) AS meanall, CASE WHEN best_value IS NULL THEN 'meanall' WHEN meanall IS NULL OR best_value >= meanall THEN 'layer' ELSE 'meanall' END AS winner FROM b")
def best_layer(spark, sf_dir):
    return rounded(_best(spark, sf_dir))


@Q.query("cross_encoder_pivot", f"""WITH {BEST} SELECT task, round(max(CASE WHEN encoder = 'Brand#1' THEN best_value END), 9) AS "Brand#1", round(max(CASE WHEN encoder = 'Brand#2' THEN best_value END), 9) AS "Brand#2" FROM b GROUP BY task""")
def cross_encoder_pivot(spark, sf_dir):
    return rounded(X.cross_table(_best(spark, sf_dir), "task", "encoder", "best_value", ["Brand#1", "Brand#2"]))


@Q.query("layer_profile", f"WITH {LAYERS} SELECT encoder, task, round(min(value), 9) AS least, round(quantile_cont(value, 0.5), 9) AS median, round(max(value), 9) AS most, round(stddev_pop(value), 9) AS std, count(*) AS n, array_to_string(list_slice(list(layer ORDER BY value DESC, layer), 1, 3), ',') AS top, round(max(value) - min(value), 9) AS gain FROM v WHERE layer >= 0 GROUP BY encoder, task HAVING count(*) >= 2")
def layer_profile(spark, sf_dir):
    p = X.layer_profile(_layers(spark, sf_dir), ["encoder", "task"])
    return rounded(p.withColumn("top", F.array_join(F.col("top").cast("array<string>"), ",")))


@Q.query("mean_all_gap", f"WITH {BEST}, g AS (SELECT *, (best_value - meanall) / meanall AS gap FROM b WHERE meanall IS NOT NULL AND best_value IS NOT NULL) SELECT encoder, task, round(gap, 9) AS gap, CASE WHEN gap < 0.02 THEN 'tie' WHEN gap < 0.10 THEN 'small' ELSE 'large' END AS verdict FROM g")
def mean_all_gap(spark, sf_dir):
    return rounded(X.gap_verdict(_best(spark, sf_dir)).select("encoder", "task", "gap", "verdict"))


@Q.query("layer_consistency", f'WITH {BEST} SELECT encoder, quantile_cont(best_layer, 0.5)::DOUBLE AS median, max(best_layer) - min(best_layer) AS "range", count(*) AS n FROM b WHERE best_layer IS NOT NULL GROUP BY encoder')
def layer_consistency(spark, sf_dir):
    return X.consistency(_best(spark, sf_dir), "encoder")


@Q.query("fold_summary", f"WITH {RUNS}, f AS (SELECT encoder, task, fold, max(value) AS value FROM r GROUP BY ALL) SELECT encoder, task, round(avg(value), 9) AS mean, round(coalesce(stddev_samp(value), 0), 9) AS std, count(*) AS n FROM f GROUP BY encoder, task")
def fold_summary(spark, sf_dir):
    folds = _runs(spark, sf_dir).groupBy("encoder", "task", "fold").agg(F.max("value").alias("value"))
    return rounded(X.fold_summary(folds, ["encoder", "task"]))


@Q.query("top_k_layers", f"WITH {LAYERS} SELECT encoder, task, layer, rk FROM (SELECT *, row_number() OVER (PARTITION BY encoder, task ORDER BY value DESC, layer) AS rk FROM v) WHERE rk <= 3")
def top_k_layers(spark, sf_dir):
    return X.top_k(_layers(spark, sf_dir), ["encoder", "task"], "value", "layer", 3).select("encoder", "task", "layer", F.col("rk").cast("long").alias("rk"))


@Q.query("running_best", "SELECT user_id, event_id, max(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def running_best(spark, sf_dir):
    return X.running_best(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "best")


@Q.query("arm_delta", f"WITH {LAYERS}, a AS (SELECT task, layer, max(value) AS a FROM v WHERE encoder = 'Brand#1' GROUP BY ALL), b AS (SELECT task, layer, max(value) AS b FROM v WHERE encoder = 'Brand#2' GROUP BY ALL) SELECT coalesce(a.task, b.task) AS task, coalesce(a.layer, b.layer) AS layer, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS delta FROM a FULL JOIN b ON a.task = b.task AND a.layer = b.layer")
def arm_delta(spark, sf_dir):
    v = _layers(spark, sf_dir)
    arm = lambda name: v.where(F.col("encoder") == name).groupBy("task", "layer").agg(F.max("value").alias("value"))
    return rounded(X.arm_delta(arm("Brand#1"), arm("Brand#2"), ["task", "layer"], "value"))


@Q.query("concurrency", "SELECT p_partkey, greatest(least(floor(64 / (1 + p_size % 9)), floor(24 / (1 + p_size % 5)), 13), 1)::BIGINT AS n FROM part")
def concurrency(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", X.concurrency(F.lit(64), F.lit(24), 1 + size % 9, 1 + size % 5, F.lit(13)).cast("long").alias("n"))


@Q.query("planned_changes", "WITH c AS (SELECT p_partkey AS id, p_brand AS tag FROM part), d AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_brand END AS tag FROM part) SELECT d.* FROM d JOIN c USING (id) WHERE d.tag <> c.tag")
def planned_changes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    current = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tag"))
    desired = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, "new").otherwise(F.col("p_brand")).alias("tag"))
    return X.planned_changes(current, desired, "id")


@Q.query("exponential_moving_average", "WITH l AS (SELECT user_id, list({'s': value, 'n': 0} ORDER BY event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda a, x: {'s': a.s - (1 - least(0.99::DOUBLE, (2 + a.n) / (11 + a.n)::DOUBLE)) * (a.s - x.s), 'n': a.n + 1}, {'s': v[1].s, 'n': 0}).s, 9) AS ema FROM l")
def exponential_moving_average(spark, sf_dir):
    """shadow -= (1 - min(decay, (1 + n) / (10 + n))) * (shadow - value), over a user's events in order."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    start = F.struct(F.get("v", F.lit(0)).alias("s"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct((a["s"] - (1 - F.least(F.lit(0.99), (2 + a["n"]) / (11 + a["n"]))) * (a["s"] - x)).alias("s"), (a["n"] + 1).alias("n"))
    return e.select("user_id", F.round(F.aggregate("v", start, step)["s"], 9).alias("ema"))


@Q.query("blank_share", "SELECT min(l) AS least, max(l) AS most, round(count(*) FILTER (WHERE l = 3) / count(*), 9) AS ratio FROM (SELECT l_linenumber AS l FROM lineitem)")
def blank_share(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("x"))
    return rounded(M.blank_share(tokens, "x", 3))


@Q.query("clip_frame_metrics", "WITH f AS (SELECT user_id, event_type = 'click' AS p, value > 50 AS t FROM events), c AS (SELECT user_id, avg((p = t)::INT) AS a, sum((p AND t)::INT) AS h, sum(p::INT) AS s, sum(t::INT) AS n FROM f GROUP BY user_id) SELECT round(avg(a), 9) AS accuracy, round(avg(CASE WHEN s > 0 THEN h / s ELSE 0 END), 9) AS precision, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 9) AS recall, round(avg(CASE WHEN s + n > 0 THEN 2 * h / (s + n) ELSE 0 END), 9) AS f1, count(*) AS n_clips FROM c")
def clip_frame_metrics(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "click").alias("p"), (F.col("value") > 50).alias("t"))
    return rounded(M.mean_over_clips(frames, ["user_id"], "p", "t"))
