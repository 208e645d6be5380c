"""Retrieval and geometry queries over the embeddings table, with their SQL.

Facets: work = label, condition = vec_id % 4, variation = (vec_id div 4) % 3, family = vec_id % 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from orpheon.functions.vectors import l2_normalize, mean_vectors, norm, pad_or_truncate, softmax
from orpheon.operators import geometry as G
from orpheon.operators import retrieval as R
from orpheon.plans.registry import Registry, table

Q = Registry()

ITEMS_SQL = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label AS work, vec_id % 4 AS cond, (vec_id // 4) % 3 AS var, vec_id % 5 AS fam FROM embeddings),
u AS (SELECT id, work, cond, var, fam, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"""
PAIRS_SQL = ITEMS_SQL + """,
p AS (SELECT q.id AS q, g.id AS g, q.cond AS qc, g.cond AS gc, q.var AS qv, g.var AS gv, q.fam AS qf, g.fam AS gf, q.work = g.work AS rel, round(list_dot_product(q.v, g.v), 12) AS s FROM u q JOIN u g ON q.id <> g.id)"""


def _metrics_sql(pairs: str, ks=(1, 5, 10)) -> str:
    per = ", ".join(f"sum(CASE WHEN rel AND rk <= {k} THEN 1 ELSE 0 END) / any_value(n_rel) AS recall_{k}, max(CASE WHEN rel AND rk <= {k} THEN 1.0 ELSE 0.0 END) AS hit_{k}, sum(CASE WHEN rel AND rk <= {k} THEN hits / rk ELSE 0 END) / any_value(n_rel) AS ap_{k}" for k in ks)
    agg = ", ".join(f"round(avg(recall_{k}), 9) AS recall_{k}, round(avg(hit_{k}), 9) AS hit_{k}, round(avg(ap_{k}), 9) AS map_{k}" for k in ks)
    return f"""WITH {PAIRS_SQL}, r AS ({pairs}),
h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rk) AS hits, sum(rel::INT) OVER (PARTITION BY q) AS n_rel FROM r),
a AS (SELECT q, sum(CASE WHEN rel THEN hits / rk ELSE 0 END) / any_value(n_rel) AS ap, min(CASE WHEN rel THEN rk END) AS fr, sum(CASE WHEN rel AND rk <= n_rel THEN 1 ELSE 0 END) / any_value(n_rel) AS rp, {per} FROM h WHERE n_rel > 0 GROUP BY q)
SELECT round(avg(ap), 9) AS map, round(avg(1 / fr), 9) AS mrr, quantile_cont(fr, 0.5)::DOUBLE AS median_rank, round(avg(rp), 9) AS r_precision, count(*) AS n_queries, {agg} FROM a"""


RANK = "SELECT q, g, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rk FROM p"


def rounded(df, digits=9):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _items(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return R.items(v, i, F.col("embedding"), F.col("label"), None, i % 4, F.floor(i / 4) % 3)


@Q.query("retrieval_map_mrr", _metrics_sql(RANK))
def retrieval_map_mrr(spark, sf_dir):
    return rounded(R.metrics(R.relevant_ranks(_items(spark, sf_dir))))


@Q.query("retrieval_per_query", f"WITH {PAIRS_SQL}, r AS ({RANK}), h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rk) AS hits, sum(rel::INT) OVER (PARTITION BY q) AS n_rel FROM r) SELECT q, round(sum(CASE WHEN rel THEN hits / rk ELSE 0 END) / any_value(n_rel), 9) AS ap, min(CASE WHEN rel THEN rk END) AS first_rank FROM h WHERE n_rel > 0 GROUP BY q")
def retrieval_per_query(spark, sf_dir):
    return rounded(R.per_query(R.relevant_ranks(_items(spark, sf_dir)), ()).select("q", "ap", "first_rank"))


@Q.query("retrieval_masked_family", _metrics_sql("SELECT q, g, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rk FROM p WHERE qf = gf"))
def retrieval_masked_family(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    items = R.items(v, F.col("vec_id"), F.col("embedding"), F.col("label"), F.col("vec_id") % 5)
    return rounded(R.metrics(R.relevant_ranks(items)))


@Q.query("retrieval_query_subset", _metrics_sql("SELECT q, g, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rk FROM p WHERE qc <= 1", (3,)))
def retrieval_query_subset(spark, sf_dir):
    return rounded(R.metrics(R.relevant_ranks(_items(spark, sf_dir), queries=F.col("cond") <= 1), (3,)))


@Q.query("retrieval_variation_control", _metrics_sql("SELECT q, g, rel, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rk FROM p WHERE NOT (rel AND qv = gv)"))
def retrieval_variation_control(spark, sf_dir):
    return rounded(R.metrics(R.relevant_ranks(_items(spark, sf_dir), twins=True)))


def _grid_sql(where: str) -> str:
    return f"""WITH {PAIRS_SQL}, r AS (SELECT q, g, qc, gc, rel, row_number() OVER (PARTITION BY q, gc ORDER BY s DESC, g) AS rk FROM p WHERE {where}),
h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q, gc ORDER BY rk) AS hits FROM r),
a AS (SELECT q, qc, gc, sum(CASE WHEN rel THEN hits / rk ELSE 0 END) / sum(rel::INT) AS ap FROM h GROUP BY q, qc, gc HAVING sum(rel::INT) > 0),
c AS (SELECT DISTINCT cond FROM u), x AS (SELECT a.cond AS query_cond, b.cond AS target_cond FROM c a, c b),
grid AS (SELECT x.query_cond, x.target_cond, coalesce(avg(ap), 0.0) AS map, count(ap) AS n_queries FROM x LEFT JOIN a ON qc = query_cond AND gc = target_cond GROUP BY 1, 2)"""


def _grid(spark, sf_dir, twins):
    items = _items(spark, sf_dir)
    return R.condition_grid(R.relevant_ranks(items, twins=twins, within_condition=True), items)


@Q.query("condition_grid", _grid_sql("true") + " SELECT query_cond, target_cond, round(map, 9) AS map, n_queries FROM grid")
def condition_grid(spark, sf_dir):
    return rounded(_grid(spark, sf_dir, False))


@Q.query("condition_grid_varctl", _grid_sql("NOT (rel AND qv = gv)") + " SELECT query_cond, target_cond, round(map, 9) AS map, n_queries FROM grid")
def condition_grid_varctl(spark, sf_dir):
    return rounded(_grid(spark, sf_dir, True))


SUMMARY = " SELECT round(avg(CASE WHEN query_cond = target_cond THEN map END), 9) AS mean_diag, round(avg(CASE WHEN query_cond <> target_cond THEN map END), 9) AS mean_off, round(avg(CASE WHEN query_cond = target_cond THEN map END) - avg(CASE WHEN query_cond <> target_cond THEN map END), 9) AS gap FROM grid WHERE n_queries > 0"


@Q.query("condition_grid_summary", _grid_sql("true") + SUMMARY)
def condition_grid_summary(spark, sf_dir):
    return rounded(R.grid_summary(_grid(spark, sf_dir, False)))


POOLS = PAIRS_SQL + ", z AS (SELECT qc, gc, CASE WHEN rel AND qv = gv THEN 'twin' WHEN rel THEN 'rel' ELSE 'distractor' END AS pool, least(floor((greatest(-1, least(1, s)) + 1) / 2 * 50), 49)::INT AS bin, s FROM p)"


@Q.query("score_histogram", f"WITH {POOLS} SELECT qc, gc, pool, bin, count(*) AS n FROM z GROUP BY ALL")
def score_histogram(spark, sf_dir):
    return R.score_histogram(_items(spark, sf_dir)).select("qc", "gc", "pool", "bin", "n")


@Q.query("score_pool_moments", f"WITH {POOLS} SELECT qc, gc, pool, count(*) AS n, round(avg(s), 9) AS mean, round(sqrt(greatest(avg(s * s) - avg(s) * avg(s), 0)), 7) AS std FROM z GROUP BY ALL")
def score_pool_moments(spark, sf_dir):
    return R.pool_moments(R.score_histogram(_items(spark, sf_dir))).withColumns({"mean": F.round("mean", 9), "std": F.round("std", 7)})


@Q.query("score_histogram_auc", f"WITH {POOLS}, b AS (SELECT bin, sum((pool = 'rel')::INT) AS a, sum((pool = 'distractor')::INT) AS b FROM z GROUP BY bin), c AS (SELECT *, coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT round(sum(a * (before + b / 2)) / (sum(a) * sum(b)), 9) AS auc FROM c")
def score_histogram_auc(spark, sf_dir):
    return rounded(R.histogram_auc(R.score_histogram(_items(spark, sf_dir)), "rel", "distractor"))


MEANS = "sum(CASE WHEN {0} THEN s END) / sum(CASE WHEN {0} THEN 1 END)"


@Q.query("score_pool_means", f"WITH {POOLS} SELECT round({MEANS.format("qc = gc AND pool <> 'distractor'")}, 9) AS within, round({MEANS.format("qc <> gc AND pool = 'twin'")}, 9) AS twin, round({MEANS.format("qc <> gc AND pool = 'rel'")}, 9) AS honest, round({MEANS.format("qc <> gc AND pool = 'distractor'")}, 9) AS distractor FROM z")
def score_pool_means(spark, sf_dir):
    return rounded(R.pool_means(R.pool_moments(R.score_histogram(_items(spark, sf_dir)))))


def _multilabel(spark, sf_dir):
    i = F.col("vec_id")
    letter = lambda k: F.concat(F.lit("L"), k.cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        i.alias("id"),
        F.col("embedding").alias("vec"),
        (i % 7).alias("grp"),
        F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(letter(i % 3), letter(F.col("label") % 4)))).alias("letters"),
        F.array(F.concat(F.lit("o"), F.floor(i / 14).cast("string"))).alias("occ_ids"),
    )


MULTI = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, vec_id % 7 AS grp, CASE WHEN vec_id % 11 = 0 THEN [] ELSE list_distinct(['L' || (vec_id % 3), 'L' || (label % 4)]) END AS letters, ['o' || (vec_id // 14)] AS occ FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e),
r AS (SELECT q.id AS q, list_has_any(q.letters, g.letters) AS rel, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, g.v) / (q.n * g.n), 12) DESC, g.id) AS rk FROM u q JOIN u g ON q.grp = g.grp AND q.id <> g.id AND NOT list_has_any(q.occ, g.occ) WHERE len(q.letters) > 0),
h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY q ORDER BY rk) AS hits FROM r),
a AS (SELECT q, sum(CASE WHEN rel THEN hits / rk ELSE 0 END) / sum(rel::INT) AS ap FROM h GROUP BY q HAVING sum(rel::INT) > 0)
SELECT round(avg(ap), 9) AS map, count(*) AS n_queries FROM a"""


@Q.query("within_group_multilabel_map", MULTI)
def within_group_multilabel_map(spark, sf_dir):
    return rounded(R.multilabel_map(_multilabel(spark, sf_dir)))


@Q.query("within_group_permutation_null")
def within_group_permutation_null(spark, sf_dir):
    return R.permutation_null(_multilabel(spark, sf_dir), 10)


@Q.query("partition_equality", "SELECT count(DISTINCT label) = count(DISTINCT (label, vec_id % 5)) AND count(DISTINCT vec_id % 5) = count(DISTINCT (label, vec_id % 5)) AS same FROM embeddings")
def partition_equality(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5).alias("fam"))
    counts = v.agg(F.count_distinct("label").alias("a"), F.count_distinct("fam").alias("b"), F.count_distinct("label", "fam").alias("ab"))
    return counts.select(((F.col("a") == F.col("ab")) & (F.col("b") == F.col("ab"))).alias("same"))


CENTERED = """e AS (SELECT vec_id AS id, label AS work, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY i)),
d AS (SELECT id, work, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS v FROM e, m),
u AS (SELECT id, work, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM d)"""


def _vec_sql(ctes: str, name: str) -> str:
    return f"WITH {ctes} SELECT id AS vec_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 8) AS fingerprint FROM {name}"


def _fingerprint(df, id_col="vec_id", vec="embedding", digits=8):
    weighted = F.transform(F.col(vec), lambda x, i: x * (i + 1))
    return df.select(F.col(id_col).alias("vec_id"), F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), digits).alias("fingerprint"))


@Q.query("l2_normalize", _vec_sql(ITEMS_SQL, "u"))
def l2(spark, sf_dir):
    return _fingerprint(table(spark, sf_dir, "embeddings").withColumn("embedding", l2_normalize(F.col("embedding").cast("array<double>"))))


@Q.query("center_global", _vec_sql(CENTERED, "u"))
def center_global(spark, sf_dir):
    return _fingerprint(G.center(table(spark, sf_dir, "embeddings"), "embedding"))


@Q.query("center_per_group", """WITH e AS (SELECT vec_id AS id, label AS work, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT work, list(a ORDER BY i) AS m FROM (SELECT work, i, avg(x) AS a FROM (SELECT work, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY work, i) GROUP BY work),
d AS (SELECT id, list_transform(list_zip(v, m), lambda p: p[1] - p[2]) AS v FROM e JOIN m USING (work)),
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM d)
SELECT id AS vec_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 8) AS fingerprint FROM u""")
def center_per_group(spark, sf_dir):
    return _fingerprint(G.center(table(spark, sf_dir, "embeddings"), "embedding", "label"))


@Q.query("retrieval_centered", _metrics_sql(RANK).replace(ITEMS_SQL, CENTERED).replace("q.cond AS qc, g.cond AS gc, q.var AS qv, g.var AS gv, q.fam AS qf, g.fam AS gf, ", ""))
def retrieval_centered(spark, sf_dir):
    v = G.center(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(R.metrics(R.relevant_ranks(R.items(v, F.col("vec_id"), F.col("embedding"), F.col("label")))))


@Q.query("retrieval_whitened")
def retrieval_whitened(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.count_distinct("label"), F.count("*")).first()
    v = G.whiten(v, "embedding", *G.auto_whiten_params(n[0], n[1], 64))
    return rounded(R.metrics(R.relevant_ranks(R.items(v, F.col("vec_id"), F.col("embedding"), F.col("label")))))


@Q.query("three_geometries")
def three_geometries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    out = None
    for spec in ("raw", "centered", "abtt-2", "whiten-a1-erel0.01"):
        t = G.treatment(v, "embedding", spec)
        m = rounded(R.metrics(R.relevant_ranks(R.items(t, F.col("vec_id"), F.col("embedding"), F.col("label"))))).withColumn("geometry", F.lit(spec))
        out = m if out is None else out.union(m)
    return out


@Q.query("anisotropy", f"WITH {ITEMS_SQL}, s AS (SELECT i, sum(x) AS t, avg(x) AS a, count(*) AS n FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY i) SELECT any_value(n) AS n, round(sqrt(sum(a * a)), 9) AS mean_norm, round((sum(t * t) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 9) AS mean_cosine FROM s")
def anisotropy(spark, sf_dir):
    return rounded(G.anisotropy(table(spark, sf_dir, "embeddings"), "embedding"))


@Q.query("spectrum")
def spectrum(spark, sf_dir):
    s = G.spectrum(table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(s["top1"], s["effective_rank"])], "top1 double, effective_rank double")


FILES = """e AS (SELECT vec_id // 2 AS f, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT f, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
m AS (SELECT f, list(a ORDER BY i) AS v FROM (SELECT f, i, avg(x) AS a FROM (SELECT f, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n) GROUP BY f, i) GROUP BY f),
u AS (SELECT f, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m)"""


@Q.query("file_embeddings", f"WITH {FILES} SELECT f AS file_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 8) AS fingerprint, (SELECT arg_min(label, vec_id) FROM e WHERE e.f = u.f) AS label FROM u")
def file_embeddings(spark, sf_dir):
    clips = table(spark, sf_dir, "embeddings").withColumn("file_id", F.floor(F.col("vec_id") / 2))
    files = G.file_embeddings(clips, "file_id", "embedding", "vec_id", ("label",))
    return _fingerprint(files, "file_id", "vec").withColumnRenamed("vec_id", "file_id").join(files.select("file_id", "label"), "file_id")


LAYERS = "l AS (SELECT vec_id, k AS layer, list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: x::DOUBLE) AS v FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k))"


def _layers(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("layer"), F.slice(F.col("embedding").cast("array<double>"), (k * 16 + 1).cast("int"), 16).alias("v")))).alias("l")).select("vec_id", "label", "l.layer", "l.v")


def _mix_sql(agg: str, where: str = "true", weight: str = "1") -> str:
    return f"WITH {LAYERS}, x AS (SELECT vec_id, i, {agg}(x * {weight}) AS a FROM (SELECT vec_id, layer, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l WHERE {where}) GROUP BY vec_id, i), m AS (SELECT vec_id AS id, list(a ORDER BY i) AS v FROM x GROUP BY vec_id) SELECT id AS vec_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 8) AS fingerprint FROM m"


@Q.query("layers_mean", _mix_sql("avg", "layer BETWEEN 1 AND 3"))
def layers_mean(spark, sf_dir):
    return _fingerprint(G.mix_layers(G.select_layers(_layers(spark, sf_dir), "layer", ["1..3"]), ["vec_id"], "layer", "v"), vec="vec")


@Q.query("layers_sum", _mix_sql("sum"))
def layers_sum(spark, sf_dir):
    return _fingerprint(G.mix_layers(_layers(spark, sf_dir), ["vec_id"], "layer", "v", "sum"), vec="vec")


@Q.query("layers_softmax_sum", _mix_sql("sum", weight="(exp(layer * 0.5 - 1.5) / (exp(-1.5) + exp(-1.0) + exp(-0.5) + 1.0))"))
def layers_softmax_sum(spark, sf_dir):
    return _fingerprint(G.mix_layers(_layers(spark, sf_dir), ["vec_id"], "layer", "v", "softmax", [0.0, 0.5, 1.0, 1.5]), vec="vec")


@Q.query("layers_concat", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 8) AS fingerprint FROM embeddings")
def layers_concat(spark, sf_dir):
    return _fingerprint(G.mix_layers(_layers(spark, sf_dir), ["vec_id"], "layer", "v", "concat"), vec="vec")


@Q.query("time_mean_max_pool", f"WITH {LAYERS}, x AS (SELECT vec_id, i, avg(x) AS a, max(x) AS m FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l) GROUP BY vec_id, i) SELECT vec_id, round(sum(a * i), 8) AS mean_print, round(sum(m * i), 8) AS max_print, round(sum((0.25 * m + 0.75 * a) * i), 8) AS mixed_print FROM x GROUP BY vec_id")
def time_mean_max_pool(spark, sf_dir):
    each = _layers(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "x")).groupBy("vec_id", "i").agg(F.avg("x").alias("a"), F.max("x").alias("m"))
    i = F.col("i") + 1
    return each.groupBy("vec_id").agg(F.round(F.sum(F.col("a") * i), 8).alias("mean_print"), F.round(F.sum(F.col("m") * i), 8).alias("max_print"), F.round(F.sum((0.25 * F.col("m") + 0.75 * F.col("a")) * i), 8).alias("mixed_print"))


@Q.query("attention_pool", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, list_transform(v, lambda x: exp(2 * x)) AS w FROM e)
SELECT vec_id, round(list_dot_product(v, w) / list_sum(w), 9) AS pooled, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 9) AS lse FROM s""")
def attention_pool(spark, sf_dir):
    from orpheon.functions.vectors import dot, log_sum_exp, scale

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, softmax(scale(v, 2.0))), 9).alias("pooled"), F.round(log_sum_exp(v), 9).alias("lse"))


@Q.query("adaptive_pool", "SELECT vec_id, round(list_sum(list_transform([0, 1, 2, 3, 4, 5, 6], lambda k: (k + 1) * list_avg(list_transform(embedding[(k * 64) // 7 + 1 : ceil((k + 1) * 64 / 7)::INT], lambda x: x::DOUBLE)))), 8) AS fingerprint FROM embeddings")
def adaptive_pool(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return _fingerprint(table(spark, sf_dir, "embeddings").select("vec_id", G.adaptive_pool(v, F.size("embedding"), 7).alias("embedding")))


@Q.query("time_interpolation", "WITH i AS (SELECT vec_id, k, greatest(0, (k + 0.5) * 64 / 10 - 0.5)::DOUBLE AS x, embedding AS v FROM embeddings, (SELECT unnest(range(10)) AS k)) SELECT vec_id, round(sum((k + 1) * (v[floor(x)::INT + 1]::DOUBLE + (v[least(floor(x)::INT + 1, 63) + 1]::DOUBLE - v[floor(x)::INT + 1]::DOUBLE) * (x - floor(x)))), 8) AS fingerprint FROM i GROUP BY vec_id")
def time_interpolation(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return _fingerprint(table(spark, sf_dir, "embeddings").select("vec_id", G.interpolate(v, F.size("embedding"), 10).alias("embedding")))


@Q.query("channel_standardise", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, list_avg(v) AS m, list_stddev_samp(v) AS d FROM e) SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: i * (x - m) / (d + 1e-5))), 6) AS fingerprint FROM s")
def channel_standardise(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size("embedding")).alias("m"))
    rows = rows.withColumn("d", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("m")) * (x - F.col("m"))) / (F.size("v") - 1)))
    return _fingerprint(rows.select("vec_id", F.transform("v", lambda x: (x - F.col("m")) / (F.col("d") + 1e-5)).alias("embedding")), digits=6)


@Q.query("pad_or_truncate", "SELECT vec_id, 50 + (vec_id % 30) AS size, round(list_sum(list_transform(embedding[1 : least(64, 50 + vec_id % 30)], lambda x, i: x::DOUBLE * i)), 8) AS fingerprint FROM embeddings")
def pad_truncate(spark, sf_dir):
    size = (F.lit(50) + F.col("vec_id") % 30).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pad_or_truncate(F.col("embedding").cast("array<double>"), size).alias("v"))
    return _fingerprint(rows, vec="v").join(rows.select("vec_id", F.size("v").cast("long").alias("size")), "vec_id")


@Q.query("peak_normalise", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: i * x / list_max(list_transform(v, lambda y: abs(y))))), 8) AS fingerprint FROM e")
def peak_normalise(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    top = F.array_max(F.transform(v, F.abs))
    return _fingerprint(table(spark, sf_dir, "embeddings").select("vec_id", F.when(top > 0, F.transform(v, lambda x: x / top)).otherwise(v).alias("embedding")))


@Q.query("six_moments", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT vec_id, v, list_transform(range(1, 64), lambda i: v[i + 1] - v[i]) AS d1 FROM e), f AS (SELECT *, list_transform(range(1, 63), lambda i: d1[i + 1] - d1[i]) AS d2 FROM d)
SELECT vec_id, round(list_avg(v), 9) AS m0, round(list_stddev_pop(v), 9) AS s0, round(list_avg(d1), 9) AS m1, round(list_stddev_pop(d1), 9) AS s1, round(list_avg(d2), 9) AS m2, round(list_stddev_pop(d2), 9) AS s2 FROM f""")
def six_moments(spark, sf_dir):
    def moments(name):
        total = F.aggregate(name, F.lit(0.0), lambda s, x: s + x) / F.size(name)
        return total, F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + (x - total) * (x - total)) / F.size(name))

    def diff(c):
        return F.zip_with(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, F.size(c) - 1), lambda a, b: a - b)

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("d0"))
    rows = rows.withColumn("d1", diff(F.col("d0"))).withColumn("d2", diff(F.col("d1")))
    cols = []
    for k in range(3):
        m, s = moments(f"d{k}")
        cols += [F.round(m, 9).alias(f"m{k}"), F.round(s, 9).alias(f"s{k}")]
    return rows.select("vec_id", *cols)


@Q.query("nearest_centroid", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
c AS (SELECT label AS c, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE vec_id % 2 = 0) GROUP BY label, i) GROUP BY label),
d AS (SELECT vec_id, label, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) ** 2)) AS d FROM e, c WHERE vec_id % 2 = 1),
b AS (SELECT vec_id, label, arg_min(c, round(d, 12)) AS p FROM d GROUP BY vec_id, label) SELECT count(*) AS n, round(avg((p = label)::INT), 9) AS accuracy FROM b""")
def nearest_centroid(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    centroids = mean_vectors(v.where("vec_id % 2 = 0").select("label", "v"), ["label"], "v", "m").withColumnRenamed("label", "c")
    d = F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    # One centroid a class: classes are few, so the small side is joined with every row.
    near = v.where("vec_id % 2 = 1").crossJoin(F.broadcast(centroids)).groupBy("vec_id", "label").agg(F.min_by("c", F.struct(F.round(d, 12), "c")).alias("p"))
    return near.agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") == F.col("label")).cast("int")), 9).alias("accuracy"))


@Q.query("vector_norms", "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS mean_norm FROM embeddings GROUP BY label")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm(F.col("embedding").cast("array<double>"))), 9).alias("mean_norm"))
