"""Alignment, windows, audits, splits and set operations over the driver's tables, with their SQL.

A user of `events` is a recording; time is the seconds since its first event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orpheon.operators import align as A
from orpheon.operators import tables as T
from orpheon.plans.registry import Registry, table

Q = Registry()
EV = "ev AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t FROM events)"
NAMES = ["click", "error", "purchase", "view"]


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / F.lit(1e6)).drop("us")


def flat_array(c, digits=6):
    """Arrays as text, so that both engines' values compare alike."""
    return F.array_join(F.transform(c, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ",")


@Q.query("tumbling_clips", "WITH c AS (SELECT o_orderkey, o_totalprice::BIGINT AS total FROM orders), n AS (SELECT *, total // 30000 + CASE WHEN (total % 30000) / 30000 >= 0.5 THEN 1 ELSE 0 END AS n FROM c) SELECT o_orderkey, unnest(range(n)) AS slice FROM n WHERE n > 0")
def tumbling_clips(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.bround("o_totalprice").cast("long").alias("total"))
    n = A.tumbling_clips(F.col("total"), F.lit(30000), 0.5)
    return A.explode_clips(o, n).select("o_orderkey", F.col("slice").cast("long").alias("slice"))


@Q.query("tumbling_clips_at_least_one", "SELECT o_orderkey, greatest(o_totalprice::BIGINT // 100000, 1) AS n FROM orders")
def tumbling_at_least_one(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.bround("o_totalprice").cast("long").alias("total"))
    return o.select("o_orderkey", A.tumbling_clips(F.col("total"), F.lit(100000), 1.0, True).alias("n"))


@Q.query("sliding_chunks", "WITH c AS (SELECT p_partkey, p_partkey % 50 AS n FROM part), s AS (SELECT p_partkey, n, unnest(range(0, greatest(n - 10, -1) + 1, 5)) AS start FROM c) SELECT p_partkey, start FROM s UNION ALL SELECT p_partkey, CASE WHEN n >= 10 THEN (n - 10) // 5 * 5 + 5 ELSE 0 END FROM c WHERE n > 0 AND (n < 10 OR (n - 10) % 5 <> 0)")
def sliding_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("int").alias("n"))
    return p.select("p_partkey", F.explode(A.sliding_chunks(F.col("n"), 10, 0.5)).alias("start")).withColumn("start", F.col("start").cast("long"))


@Q.query("bar_windows", 'WITH c AS (SELECT p_partkey, p_size AS n FROM part) SELECT p_partkey, s AS "first", s + 7 AS "last" FROM (SELECT p_partkey, unnest(range(1, n - 7 + 1, 3)) AS s FROM c WHERE n > 8) UNION ALL SELECT p_partkey, 1, n FROM c WHERE n <= 8')
def bar_windows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(A.bar_windows(F.col("p_size"), 8, 3)).alias("w")).select("p_partkey", F.col("w.first").cast("long").alias("first"), F.col("w.last").cast("long").alias("last"))


@Q.query("events_in_clips", f"WITH {EV} SELECT event_id, floor(t / 86400)::BIGINT AS clip, round_even((t - floor(t / 86400) * 86400) * 0.01::DOUBLE, 0)::INT AS frame FROM ev")
def events_in_clips(spark, sf_dir):
    return A.events_in_clips(events(spark, sf_dir), "t", 86400.0, 0.01).select("event_id", F.col("clip").cast("long").alias("clip"), "frame")


@Q.query("as_of_carry_forward", "SELECT l_orderkey, l_linenumber, l_shipdate, (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = l.l_suppkey AND o.o_orderdate <= l.l_shipdate ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1) AS last_order FROM lineitem l")
def as_of_carry_forward(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("k"), F.col("l_shipdate").alias("t"), "l_orderkey", "l_linenumber")
    marks = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("k"), F.col("o_orderdate").alias("t")).agg(F.max("o_orderkey").alias("last_order"))
    return A.as_of(points, marks, "k", "t", "last_order").select("l_orderkey", "l_linenumber", F.col("t").alias("l_shipdate"), "last_order")


@Q.query("as_of_strict", f"WITH {EV} SELECT event_id, (SELECT e.event_id FROM ev e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.t < p.t ORDER BY e.t DESC, e.event_id DESC LIMIT 1) AS last_error FROM ev p WHERE event_type = 'purchase'")
def as_of_strict(spark, sf_dir):
    e = events(spark, sf_dir)
    marks = e.where("event_type = 'error'").groupBy("user_id", "t").agg(F.max("event_id").alias("last_error"))
    return A.as_of(e.where("event_type = 'purchase'").select("user_id", "t", "event_id"), marks, "user_id", "t", "last_error", strict=True).select("event_id", "last_error")


CHORD = "CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 24 WHEN 'purchase' THEN 17 ELSE 9 END"


@Q.query("chord_frames", f"""WITH {EV}, c AS (SELECT user_id, t AS start, {CHORD} AS chord, lag({CHORD}) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before, event_id FROM ev),
f AS (SELECT user_id, clip, frame, clip * 200000.0::DOUBLE AS clip_start, clip * 200000.0::DOUBLE + frame * 5000.0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM c), (SELECT unnest(range(5)) AS clip), (SELECT unnest(range(40)) AS frame)),
j AS (SELECT f.*, c.start, c.chord, c.before FROM f ASOF LEFT JOIN c ON f.user_id = c.user_id AND f.t >= c.start)
SELECT user_id, clip, frame, (CASE WHEN chord = 24 AND start > clip_start THEN coalesce(before, 24) ELSE coalesce(chord, 24) END)::INT AS chord FROM j""")
def chord_frames(spark, sf_dir):
    e = events(spark, sf_dir)
    chord = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "error", 24).when(F.col("event_type") == "purchase", 17).otherwise(9)
    chords = e.select("user_id", F.col("t").alias("start"), chord.alias("chord"))
    grid = F.explode(F.expr("flatten(transform(sequence(0, 4), c -> transform(sequence(0, 39), f -> struct(c as clip, f as frame))))")).alias("g")
    frames = e.select("user_id").distinct().select("user_id", grid).select("user_id", "g.clip", "g.frame", (F.col("g.clip") * 200000.0).alias("clip_start"), (F.col("g.clip") * 200000.0 + F.col("g.frame") * 5000.0).alias("t"))
    found = A.chord_frames(frames, chords, "user_id")
    return found.select("user_id", F.col("clip").cast("long").alias("clip"), F.col("frame").cast("long").alias("frame"), "chord")


@Q.query("paint_notes", f"""WITH {EV}, n AS (SELECT user_id, event_id AS no, t / 3600 AS a, t / 3600 + value / 10 AS b, 40 + event_id % 40 AS pitch FROM ev),
x AS (SELECT user_id, no, pitch, unnest(range(greatest(floor(a * 0.5)::BIGINT, 0), least(ceil(b * 0.5)::BIGINT, 300))) AS frame FROM n)
SELECT user_id, frame, arg_max(pitch, no) AS pitch FROM x GROUP BY ALL""")
def paint_notes(spark, sf_dir):
    notes = events(spark, sf_dir).select("user_id", (F.col("t") / 3600).alias("onset"), (F.col("t") / 3600 + F.col("value") / 10).alias("offset"), (40 + F.col("event_id") % 40).alias("pitch"), F.col("event_id").alias("no"))
    return A.paint_notes(notes, ["user_id"], 300, 0.5).select("user_id", F.col("frame").cast("long").alias("frame"), "pitch")


@Q.query("nearest_sample", "SELECT vec_id, k, coalesce(embedding[round_even((vec_id % 3 + (k + 0.5::DOUBLE) / 2) * 10, 0)::INT + 1]::DOUBLE, -1) AS label FROM embeddings, (SELECT unnest(range(12)) AS k)")
def nearest_sample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    return e.select("vec_id", F.col("k").cast("long").alias("k"), A.sampled_label(F.col("v"), F.col("k"), F.col("vec_id") % 3, 10.0, 2.0).alias("label"))


INTERVALS = "a AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, epoch(l_shipdate)::DOUBLE AS s, epoch(l_shipdate)::DOUBLE + 86400 * l_quantity AS e FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, epoch(l_shipdate)::DOUBLE AS s, epoch(l_shipdate)::DOUBLE + 86400 * l_quantity AS e FROM lineitem WHERE l_returnflag = 'A')"


@Q.query("interval_overlap", f"WITH {INTERVALS} SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.k = b.k AND a.s < b.e AND a.e > b.s")
def interval_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    start = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).cast("double")

    def side(flag):
        return l.where(f"l_returnflag = '{flag}'").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), start.alias("start"), (start + 86400 * F.col("l_quantity")).alias("end"))

    return A.interval_overlap_join(side("R"), side("A"), "k", 86400.0 * 30).select("a_id", "b_id")


@Q.query("window_bar_membership", "WITH b AS (SELECT l_orderkey AS piece, l_linenumber AS bar, l_returnflag AS letter FROM lineitem), w AS (SELECT piece, unnest(range(1, 7)) AS f FROM (SELECT DISTINCT piece FROM b)) SELECT w.piece, f AS first_bar, string_agg(DISTINCT letter, ',' ORDER BY letter) AS letters FROM w JOIN b ON b.piece = w.piece AND b.bar BETWEEN f AND f + 1 GROUP BY ALL")
def window_bar_membership(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("piece"), F.col("l_linenumber").alias("bar"), F.col("l_returnflag").alias("letter"))
    each = b.withColumn("first_bar", F.explode(F.array(F.col("bar") - 1, F.col("bar")))).where("first_bar between 1 and 6")
    return each.groupBy("piece", F.col("first_bar").cast("long").alias("first_bar")).agg(F.array_join(F.sort_array(F.collect_set("letter")), ",").alias("letters"))


@Q.query("note_windows", "WITH n AS (SELECT event_id, greatest(value - 20, 0) AS o, CASE WHEN value - 20 < 0 THEN value % 7 + value - 20 ELSE value % 7 END AS d FROM events), c AS (SELECT event_id, round(greatest(o, 2) - 2, 9) AS a, round(least(o + d, 30) - 2, 9) AS b FROM n WHERE d > 0) SELECT * FROM c WHERE b > a")
def note_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    on, length = A.clamp_onsets(F.col("value") - 20, F.col("value") % 7)
    e = e.select("event_id", on.alias("o"), length.alias("d")).where("d > 0")
    a, b = A.clip_to_window(F.col("o"), F.col("o") + F.col("d"), F.lit(2.0), F.lit(30.0))
    return e.select("event_id", F.round(a, 9).alias("a"), F.round(b, 9).alias("b")).where("b > a")


@Q.query("segment_pairing", f"WITH {EV} SELECT event_id, event_type AS label, t AS start, lead(t) OVER w AS stop FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id) QUALIFY lead(t) OVER w > t AND event_type <> 'error'")
def segment_pairing(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = events(spark, sf_dir).withColumn("stop", F.lead("t").over(w))
    return e.where("stop > t and event_type <> 'error'").select("event_id", F.col("event_type").alias("label"), F.col("t").alias("start"), "stop")


@Q.query("occurrence_counter", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_counter(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


@Q.query("running_turns", "SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, max(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS longest FROM conversations")
def running_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "user").cast("int")).over(w).alias("asked"), F.max(F.length("text")).over(w).cast("long").alias("longest"))


@Q.query("bar_of_patch", "SELECT conv_id, turn, CASE WHEN n = 0 THEN 0 ELSE n END AS bar FROM (SELECT conv_id, turn, sum((length(text) % 2 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)")
def bar_of_patch(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.length("text") % 2 == 0).cast("int")).over(w).alias("bar"))


@Q.query("change_points", "WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM f GROUP BY user_id, event_type, g")
def change_points(spark, sf_dir):
    return A.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("user_id", "event_type", "first", "last", "n")


@Q.query("max_filter_widening", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0.25)::INT) AS v FROM embeddings), f AS (SELECT vec_id, i, v FROM e, (SELECT unnest(range(1, 65)) AS i)) SELECT vec_id, round(sum(i * coalesce(list_max(list_transform(range(greatest(i - 3, 1), least(i + 3, 64) + 1), lambda j: CASE WHEN v[j] > 0 THEN pow(0.5, abs(i - j)) ELSE 0 END)), 0)), 6) AS fingerprint FROM f GROUP BY vec_id")
def max_filter_widening(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.when(x > 0.25, 1).otherwise(0))
    wide = table(spark, sf_dir, "embeddings").select("vec_id", A.widen(v, 3).alias("w"))
    return wide.select("vec_id", F.round(F.aggregate(F.transform("w", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("fingerprint"))


@Q.query("gaussian_heat_map", "SELECT vec_id, round(sum((i + 1) * least(1, exp(-0.5 * pow((i - vec_id % 50) / 2.0, 2)) + exp(-0.5 * pow((i - (vec_id * 7) % 50) / 2.0, 2)))), 6) AS fingerprint FROM embeddings, (SELECT unnest(range(50)) AS i) GROUP BY vec_id")
def gaussian_heat_map(spark, sf_dir):
    frames = F.array(F.col("vec_id") % 50, (F.col("vec_id") * 7) % 50)
    maps = table(spark, sf_dir, "embeddings").select("vec_id", A.heat_map(frames, 50, 2.0).alias("h"))
    return maps.select("vec_id", F.round(F.aggregate(F.transform("h", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("fingerprint"))


@Q.query("main_segment", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_filter(range(1, 65), lambda i: embedding[i] >= 0.2::FLOAT) AS pos FROM embeddings) SELECT vec_id, CASE WHEN len(pos) = 0 THEN 0 ELSE list_max(pos) - list_min(pos) + 1 END AS size FROM e")
def main_segment(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(A.main_segment(v, F.lit(0.2).cast("float"))).cast("long").alias("size"))


@Q.query("peak_picking")
def peak_picking(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.peaks(F.col("embedding").cast("array<double>"), 0.1, 4).alias("peaks"))


@Q.query("peak_candidates", "SELECT vec_id, count(*) AS n FROM (SELECT vec_id, i, embedding[i] AS x, coalesce(CASE WHEN i > 1 THEN embedding[i - 1] END, '-inf'::FLOAT) AS l, coalesce(embedding[i + 1], '-inf'::FLOAT) AS r FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) WHERE x >= 0.1::FLOAT AND x >= l AND x >= r AND (x > l OR x > r) GROUP BY vec_id")
def peak_candidates(spark, sf_dir):
    peaks = A.peaks(F.col("embedding").cast("array<float>"), F.lit(0.1).cast("float"), 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(peaks).cast("long").alias("n")).where("n > 0")


@Q.query("manifest_audit", "SELECT CASE WHEN NOT coalesce(url LIKE 'http%', false) THEN 'scheme' WHEN NOT coalesce(contains(url, '.example.'), false) THEN 'host' WHEN NOT coalesce(length(html) > 200, false) THEN 'short' WHEN NOT coalesce(page_id % 10 <> 3, false) THEN 'excluded' ELSE 'ok' END AS reason, count(*) AS n FROM pages GROUP BY 1")
def manifest_audit(spark, sf_dir):
    rules = [("scheme", F.col("url").startswith("http")), ("host", F.col("url").contains(".example.")), ("short", F.length("html") > 200), ("excluded", F.col("page_id") % 10 != 3)]
    return T.audit(table(spark, sf_dir, "pages"), rules)


@Q.query("drift_audit", "SELECT CASE WHEN abs(d) <= 0.05 THEN 'ok' WHEN abs(d) <= 1 THEN 'minor' ELSE 'large' END AS kind, count(*) AS n, round(max(abs(d)), 9) AS worst FROM (SELECT value - 10 AS d FROM events) GROUP BY 1")
def drift_audit(spark, sf_dir):
    d = F.col("value") - 10
    return table(spark, sf_dir, "events").groupBy(T.drift_class(d).alias("kind")).agg(F.count("*").alias("n"), F.round(F.max(F.abs(d)), 9).alias("worst"))


@Q.query("worst_n", "SELECT event_id, round(value - 10, 9) AS drift FROM events ORDER BY abs(value - 10) DESC, event_id LIMIT 10")
def worst_n(spark, sf_dir):
    d = F.col("value") - 10
    return T.worst(table(spark, sf_dir, "events"), d, 10, "event_id").select("event_id", F.round(d, 9).alias("drift"))


@Q.query("uniform_grid", "WITH g AS (SELECT p_brand AS k, p_size::DOUBLE AS t FROM part), s AS (SELECT k, t, abs(t - lag(t) OVER (PARTITION BY k ORDER BY t) - 1.0) AS d FROM g) SELECT k, abs(min(t)) <= 0.5 AS starts_at_zero, max(d)::DOUBLE AS worst, abs(min(t)) <= 0.5 AND coalesce(max(d), 0) <= 0.25 AS ok FROM s GROUP BY k")
def uniform_grid(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_size").cast("double").alias("t"))
    return T.uniform_grid(g, "k", "t", 1.0)


@Q.query("dedup_within_group", "WITH d AS (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rk FROM documents), k AS (SELECT * FROM d WHERE rk = 1) SELECT doc_id, source FROM k QUALIFY count(*) OVER (PARTITION BY source) >= 2")
def dedup_within_group(spark, sf_dir):
    return T.dedup_within_group(table(spark, sf_dir, "documents"), "source", "text", "doc_id").select("doc_id", "source")


@Q.query("semi_anti", "SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS cached, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def semi_anti(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    cached = d.join(l, "doc_id", "left_semi").agg(F.count("*").alias("cached"))
    missing = d.join(l, "doc_id", "left_anti").agg(F.count("*").alias("missing"))
    return cached.crossJoin(missing)  # one row each


@Q.query("key_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def key_set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    out = [("union", o.union(c).distinct()), ("intersect", o.intersect(c)), ("except", c.exceptAll(o.distinct().join(c, "k", "left_semi")).distinct())]
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, d in out]
    return parts[0].union(parts[1]).union(parts[2])


@Q.query("split_override", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'test' ELSE CASE WHEN d.doc_id % 10 < 8 THEN 'train' ELSE 'val' END END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1")
def split_override(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("val").alias("own"))
    over = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("test").alias("split"))
    return T.split_override(d, over, "doc_id", "own").select("doc_id", "split")


@Q.query("hash_split", "SELECT doc_id, CASE WHEN b < 800 THEN 'train' WHEN b < 900 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000 AS b FROM documents)")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.hash_split(F.col("doc_id")).alias("split"))


@Q.query("stratified_sample", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 20")
def stratified_sample(spark, sf_dir):
    return T.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", 20).select("doc_id", "lang")


@Q.query("head_n", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def head_n(spark, sf_dir):
    return T.head(table(spark, sf_dir, "documents"), "doc_id", 25).select("doc_id", "n_chars")


@Q.query("latest_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_wins(spark, sf_dir):
    return T.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@Q.query("group_disjoint_folds")
def group_disjoint_folds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sizes = {r.source: r["count"] for r in d.where("source is not null").groupBy("source").count().collect()}  # one row a group
    split_of = T.group_folds(sizes)[0]
    return T.assign(d.select("doc_id", "source"), "source", split_of)


@Q.query("label_inventory", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS nulls FROM documents GROUP BY lang")
def label_inventory(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"))


@Q.query("build_summary", "WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT count(*) AS groups, sum(n)::BIGINT AS rows, count(*) FILTER (WHERE n = 1) AS singletons, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean FROM g")
def build_summary(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("n") == 1).alias("singletons"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"))


@Q.query("two_index_intersect", "SELECT 'both' AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels) JOIN (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 > 0) USING (doc_id) UNION ALL SELECT 'left', count(*) FROM (SELECT DISTINCT doc_id FROM labels) l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 3 > 0 AND d.doc_id = l.doc_id) UNION ALL SELECT 'right', count(*) FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 > 0) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)")
def two_index_intersect(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return a.join(b, "doc_id", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@Q.query("score_bridge", "WITH a AS (SELECT user_id, event_id, event_id % 12 AS pitch, value AS t FROM events), b AS (SELECT user_id, event_id AS point, event_id % 12 AS pitch, value + 2.5 AS t FROM events), s AS (SELECT user_id, round(b.t - a.t, 4) AS d, count(*) AS n FROM a JOIN b USING (user_id, pitch) GROUP BY ALL), m AS (SELECT user_id, arg_min(d, (-n, d)) AS d FROM s GROUP BY user_id) SELECT a.user_id, a.event_id, b.point FROM a JOIN m USING (user_id) JOIN b ON a.user_id = b.user_id AND a.pitch = b.pitch AND round(a.t + d, 3) = round(b.t, 3)")
def score_bridge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pitch = (F.col("event_id") % 12).alias("pitch")
    score = e.select("user_id", F.col("event_id").alias("id"), pitch, F.col("value").alias("t"))
    points = e.select("user_id", F.col("event_id").alias("point"), pitch, (F.col("value") + 2.5).alias("t"))
    return A.score_bridge(score, points, "user_id").withColumnRenamed("id", "event_id")


@Q.query("as_of_tolerance", f"WITH {EV} SELECT event_id, (SELECT e.event_id FROM ev e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.t - 7200 < p.t ORDER BY e.t DESC, e.event_id DESC LIMIT 1) AS last_error FROM ev p WHERE event_type = 'purchase'")
def as_of_tolerance(spark, sf_dir):
    e = events(spark, sf_dir)
    marks = e.where("event_type = 'error'").groupBy("user_id", "t").agg(F.max("event_id").alias("last_error"))
    return A.as_of(e.where("event_type = 'purchase'").select("user_id", "t", "event_id"), marks, "user_id", "t", "last_error", strict=True, tolerance=7200).select("event_id", "last_error")
