"""Projections: paths, ids, text and music expressions over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orpheon.functions import music as M
from orpheon.functions import text as X
from orpheon.functions.vectors import argmax, margin
from orpheon.plans.registry import Registry, table

Q = Registry()
STEM = r"regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


@Q.query("path_normalise", "SELECT page_id, translate(replace(url, '/', '\\'), '\\', '/') AS path FROM pages")
def path_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.posix_path(F.translate("url", "/", "\\")).alias("path"))


@Q.query("path_rewrite", "WITH p AS (SELECT page_id, CASE WHEN instr(url, 'example') > 0 THEN substr(url, 1, instr(url, 'example') - 1) || 'data/audio' || substr(url, instr(url, 'example') + 7) ELSE url END AS u FROM pages) SELECT page_id, CASE WHEN ends_with(u, '.html') THEN substr(u, 1, length(u) - 5) || '.wav' ELSE u END AS path FROM p")
def path_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.rewrite_path(F.col("url"), "example", "data/audio", ".html", ".wav").alias("path"))


@Q.query("clip_id", f"SELECT page_id, {STEM} || '__' || substr(sha1(url), 1, 8) || '__c' || (page_id % 5) AS clip_id FROM pages")
def clip_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clip_id(F.col("url"), F.col("page_id") % 5).alias("clip_id"))


@Q.query("config_hash", "SELECT p_partkey, substr(sha256(concat_ws('|', p_brand, (16000 + p_size)::VARCHAR, printf('%.6f', p_retailprice / 100), p_type, CASE WHEN p_partkey % 2 = 0 THEN 'pool' ELSE 'frame' END)), 1, 8) AS hash FROM part")
def config_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.config_hash(F.col("p_brand"), 16000 + F.col("p_size"), F.col("p_retailprice") / 100, F.col("p_type"), F.col("p_partkey") % 2 == 0).alias("hash"))


@Q.query("stable_group_id", "SELECT p_partkey, ('0x' || substr(sha1(p_brand || '|' || p_type), 1, 8))::BIGINT AS work_id, ('0x' || substr(sha1(p_brand), 1, 8))::BIGINT AS family_id, ('0x' || substr(md5(p_name), 1, 8))::BIGINT AS md5_id, ('0x' || substr(md5(p_name), 1, 8))::BIGINT % 7 AS soundfont FROM part")
def stable_group_id(spark, sf_dir):
    group = F.concat_ws("|", "p_brand", "p_type")
    m = X.stable_id(F.col("p_name"), "md5")
    return table(spark, sf_dir, "part").select("p_partkey", X.stable_id(group).alias("work_id"), X.stable_id(X.family_of(group)).alias("family_id"), m.alias("md5_id"), (m % 7).alias("soundfont"))


@Q.query("composite_id", "SELECT o_orderkey, (1 + o_custkey % 32) * 100000 + (1 + o_orderkey % 4) * 1000 + ascii(substr(o_orderstatus, 1, 1)) AS work_id FROM orders")
def composite_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.composite_id(1 + F.col("o_custkey") % 32, 1 + F.col("o_orderkey") % 4, F.col("o_orderstatus")).alias("work_id"))


@Q.query("filename_parse", r"WITH n AS (SELECT page_id, lpad((page_id % 200)::VARCHAR, 3, '0') || '_' || chr((65 + page_id % 5)::INT) || '_' || (page_id % 7) || CASE WHEN page_id % 3 = 0 THEN '_p' || (page_id % 128) ELSE '' END AS stem FROM pages) SELECT page_id, regexp_extract(stem, '^([0-9]+)_([A-Z]+)_([0-9]+)(_p[0-9]+)?$', 1) AS piece, regexp_extract(stem, '^([0-9]+)_([A-Z]+)_([0-9]+)(_p[0-9]+)?$', 2) AS section, regexp_extract(stem, '^([0-9]+)_([A-Z]+)_([0-9]+)(_p[0-9]+)?$', 3)::INT AS idx, try_cast(regexp_extract(stem, '_p([0-9]+)$', 1) AS INT) AS program, coalesce(try_cast(regexp_extract(stem, '_p([0-9]+)$', 1) AS INT), -1) AS variation FROM n")
def filename_parse(spark, sf_dir):
    i = F.col("page_id")
    stem = F.concat(F.lpad((i % 200).cast("string"), 3, "0"), F.lit("_"), F.char(65 + i % 5), F.lit("_"), (i % 7).cast("string"), F.when(i % 3 == 0, F.concat(F.lit("_p"), (i % 128).cast("string"))).otherwise(""))
    rx = r"^([0-9]+)_([A-Z]+)_([0-9]+)(?:_p([0-9]+))?$"
    n = table(spark, sf_dir, "pages").select("page_id", stem.alias("stem"))
    part = lambda k: F.regexp_extract("stem", rx, k)
    return n.select("page_id", part(1).alias("piece"), part(2).alias("section"), part(3).cast("int").alias("idx"), part(4).try_cast("int").alias("program"), X.variation_id(F.col("stem"), r"_p([0-9]+)$").alias("variation"))


RUNS = """r AS (SELECT p_partkey, lower(replace(p_brand, '#', '-')) || CASE WHEN p_partkey % 9 = 0 THEN '-meanall' WHEN p_partkey % 4 = 0 THEN '' ELSE '-layer-' || (p_size % 13) END || CASE WHEN p_partkey % 3 = 0 THEN '-fold' || (p_partkey % 5) ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '-test-window_' || (p_size % 16) ELSE '' END AS name,
CASE WHEN p_partkey % 2 = 0 THEN 'fit-fold' || (p_partkey % 5) WHEN p_partkey % 7 = 0 THEN 'test' END AS job, CASE WHEN p_partkey % 4 = 0 THEN ['x', 'layer-' || (p_size % 7), 'window3'] ELSE ['mean'] END AS tags FROM part)"""


@Q.query("sweep_coordinates", rf"""WITH {RUNS}, m AS (SELECT *, contains(name, 'meanall') OR contains(name, 'mean-all') AS mean_all, coalesce(job, '') AS j FROM r)
SELECT p_partkey, CASE WHEN mean_all THEN -1 ELSE coalesce(try_cast(regexp_extract(name, 'layer-(\d+)', 1) AS INT), try_cast(list_filter(list_transform(tags, lambda t: regexp_extract(t, 'layer-(\d+)', 1)), lambda x: x <> '')[1] AS INT)) END AS layer,
coalesce(try_cast(regexp_extract(name, 'fold[-_]?(\d+)', 1) AS INT), try_cast(regexp_extract(j, 'fold[-_]?(\d+)', 1) AS INT)) AS fold,
coalesce(try_cast(regexp_extract(name, 'window[-_]?(\d+)', 1) AS INT), try_cast(regexp_extract(j, 'window[-_]?(\d+)', 1) AS INT), try_cast(list_filter(list_transform(tags, lambda t: regexp_extract(t, 'window[-_]?(\d+)', 1)), lambda x: x <> '')[1] AS INT)) AS "window",
CASE WHEN starts_with(j, 'test') OR contains(name, '-test') OR ends_with(name, 'test') THEN 'test' WHEN starts_with(j, 'fit') OR contains(name, '-fit') OR ends_with(name, 'fit') THEN 'fit' END AS stage, CASE WHEN mean_all THEN 'meanall' ELSE 'single' END AS repr FROM m""")
def sweep_coordinates(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda prefix, v: F.concat(F.lit(prefix), v.cast("string"))
    name = F.concat(
        F.lower(F.translate("p_brand", "#", "-")),
        F.when(k % 9 == 0, "-meanall").when(k % 4 == 0, "").otherwise(text("-layer-", size % 13)),
        F.when(k % 3 == 0, text("-fold", k % 5)).otherwise(""),
        F.when(k % 5 == 0, text("-test-window_", size % 16)).otherwise(""),
    )
    job = F.when(k % 2 == 0, text("fit-fold", k % 5)).when(k % 7 == 0, "test")
    tags = F.when(k % 4 == 0, F.array(F.lit("x"), text("layer-", size % 7), F.lit("window3"))).otherwise(F.array(F.lit("mean")))
    runs = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), job.alias("job"), tags.alias("tags"))
    return runs.select("p_partkey", *X.sweep_coordinates(F.col("name"), F.col("job"), F.col("tags")))


FOLDED = f"translate(text, '{X.FOLD_FROM}', '{X.FOLD_TO}')"


@Q.query("slug", rf"SELECT doc_id, rtrim(substr(trim(regexp_replace(regexp_replace({FOLDED}, '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 80), '-') AS slug FROM documents")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@Q.query("safe_filename", r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]', '-', 'g'), '[ .]+$', ''), '-{2,}', '-', 'g') AS n FROM pages) SELECT page_id, CASE WHEN n = '' THEN '_unnamed' ELSE n END AS name FROM c""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@Q.query("nested_key", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def nested_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


LOWFOLD = f"translate(trim(lower(text)), '{X.FOLD_FROM}', '{X.FOLD_TO}')"


@Q.query("phoneme_text", rf"""SELECT item_id, trim(regexp_replace(regexp_replace({LOWFOLD}, '[.,?!:;"()\[\]\-]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM benchmark""")
def phoneme_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.phoneme_text(F.col("text")).alias("clean"))


@Q.query("asr_text", r"SELECT item_id, upper(replace(trim(regexp_replace(regexp_replace(text, '[,.!]', ' ', 'g'), '\s+', ' ', 'g')), 'ß', 'ss')) AS clean FROM benchmark")
def asr_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.asr_text(F.col("text"), ",.!").alias("clean"))


@Q.query("charset_vocabulary", r"""WITH c AS (SELECT DISTINCT unnest(string_split(upper(trim(regexp_replace(regexp_replace(text, '[,.!]', ' ', 'g'), '\s+', ' ', 'g'))), '')) AS ch FROM documents), k AS (SELECT ch FROM c WHERE ch BETWEEN 'A' AND 'Z' AND length(ch) = 1 AND ascii(ch) < 128 UNION SELECT '|' UNION SELECT '''')
SELECT ch AS token, row_number() OVER (ORDER BY ascii(ch)) - 1 AS id FROM k UNION ALL SELECT '[UNK]', count(*) FROM k UNION ALL SELECT '[PAD]', count(*) + 1 FROM k""")
def charset_vocabulary(spark, sf_dir):
    from pyspark.sql import Window

    letters = table(spark, sf_dir, "documents").select(F.explode(F.split(X.asr_text(F.col("text"), ",.!"), "")).alias("token")).distinct()
    kept = letters.where(F.col("token").rlike("^[A-Z]$")).union(spark.createDataFrame([("|",), ("'",)], "token string")).distinct()
    ids = kept.select("token", (F.row_number().over(Window.orderBy(F.ascii("token"))) - 1).cast("long").alias("id"))  # at most 28 rows
    n = ids.agg(F.count("*").alias("n"))
    return ids.union(n.select(F.lit("[UNK]"), "n")).union(n.select(F.lit("[PAD]"), F.col("n") + 1))


CHORDS = """c AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'N' ELSE list_extract(['C', 'C#', 'Db', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B'], (event_id % 13 + 1)::INT) || list_extract(['', ':maj', ':min', ':7', ':min7', ':sus4', ':dim', ':aug', ':maj7/3', ':min/5'], (event_id % 10 + 1)::INT) END AS chord FROM events)"""


def _chords(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*(F.lit(x) for x in names)), (k + 1).cast("int"))
    roots = ["C", "C#", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
    kinds = ["", ":maj", ":min", ":7", ":min7", ":sus4", ":dim", ":aug", ":maj7/3", ":min/5"]
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(i % 17 == 0, "N").otherwise(F.concat(pick(roots, i % 13), pick(kinds, i % 10))).alias("chord"))


@Q.query("chord_classes", f"""WITH {CHORDS}, s AS (SELECT event_id, chord, CASE WHEN chord = 'N' THEN 24 ELSE (list_extract([0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11], (event_id % 13 + 1)::INT)) END AS root, event_id % 10 AS k FROM c)
SELECT event_id, CASE WHEN root = 24 THEN 24 WHEN k IN (0, 1, 3, 8) THEN root WHEN k IN (2, 4, 9) THEN root + 12 ELSE -1 END AS class FROM s""")
def chord_classes(spark, sf_dir):
    return _chords(spark, sf_dir).select("event_id", M.chord_class(F.col("chord")).alias("class"))


@Q.query("chord_names", "SELECT k AS class, CASE WHEN k < 0 THEN 'X' WHEN k = 24 THEN 'N' ELSE list_extract(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'], (k % 12 + 1)::INT) || CASE WHEN k < 12 THEN ':maj' ELSE ':min' END END AS name FROM (SELECT DISTINCT (label + 15) % 26 - 1 AS k FROM (SELECT unnest(range(26)) AS label))")
def chord_names(spark, sf_dir):
    return spark.range(26).select((F.col("id").cast("int") - 1).alias("class")).select(F.col("class").cast("long").alias("class"), M.chord_name(F.col("class")).alias("name"))


@Q.query("f0_to_midi", "SELECT event_id, CASE WHEN value * 40 - 200 <= 0 THEN -1 ELSE greatest(0, least(127, round_even(69 + 12 * log2((value * 40 - 200) / 440), 0)))::INT END AS midi FROM events")
def f0_to_midi(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", M.f0_to_midi(F.col("value") * 40 - 200).alias("midi"))


@Q.query("note_to_midi", "SELECT event_id, greatest(0, least(127, event_id % 12 + ((event_id // 12) % 13 - 6 + 5) * 12))::INT AS midi FROM events")
def note_to_midi(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", M.note_to_midi(i % 12, F.floor(i / 12) % 13 - 6).alias("midi"))


@Q.query("staff_spelling", "SELECT event_id, list_extract(['C', 'D', 'E', 'F', 'G', 'A', 'B'], ((event_id % 60 - 30 + 70) % 7 + 1)::INT) AS letter, (floor((event_id % 60 - 30) / 7) + 4)::INT AS octave FROM events")
def staff_spelling(spark, sf_dir):
    m = F.col("event_id") % 60 + 30
    return table(spark, sf_dir, "events").select("event_id", M.staff_letter(m).alias("letter"), M.staff_octave(m).alias("octave"))


@Q.query("scale_degrees", """WITH n AS (SELECT event_id, event_id % 7 + 1 AS d, event_id % 3 - 1 AS a, event_id % 5 - 2 AS o, event_id % 12 AS t, event_id % 2 AS s FROM events),
p AS (SELECT event_id, o * 12 + t + a + CASE WHEN s = 0 THEN list_extract([0, 2, 4, 5, 7, 9, 11], d::INT) ELSE list_extract([0, 2, 3, 5, 7, 8, 10], d::INT) END AS p FROM n) SELECT event_id, ((p % 12 + 12) % 12)::INT AS pitch_class, floor(p / 12)::INT AS octave FROM p""")
def scale_degrees(spark, sf_dir):
    i = F.col("event_id")
    pc, octave = M.scale_degree(i % 7 + 1, i % 3 - 1, i % 5 - 2, i % 12, F.when(i % 2 == 0, "major").otherwise("minor"))
    return table(spark, sf_dir, "events").select("event_id", pc.alias("pitch_class"), octave.alias("octave"))


@Q.query("multi_hot", "SELECT event_id, list_transform(['click', 'error', 'purchase', 'view'], lambda t: (list_contains([event_type, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'none' END], t))::INT)::VARCHAR AS hot FROM events")
def multi_hot(spark, sf_dir):
    tags = F.array("event_type", F.when(F.col("event_id") % 2 == 0, "view").otherwise("none"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.array_join(M.multi_hot(tags, ["click", "error", "purchase", "view"]).cast("array<string>"), ", "), F.lit("]")).alias("hot"))


@Q.query("label_canonical", "SELECT event_type, CASE event_type WHEN 'click' THEN 'verse' WHEN 'view' THEN 'verse' WHEN 'purchase' THEN 'chorus' WHEN 'error' THEN 'bridge' ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY ALL")
def label_canonical(spark, sf_dir):
    alias = spark.createDataFrame([("click", "verse"), ("view", "verse"), ("purchase", "chorus"), ("error", "bridge")], "event_type string, label string")
    joined = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(alias), "event_type", "left")  # four rows
    return joined.select("event_type", F.coalesce("label", F.lit("other")).alias("label"), "n")


@Q.query("bars_to_seconds", "SELECT event_id, CASE WHEN ok THEN (f - 1) * 2.5::DOUBLE END AS start_sec, CASE WHEN ok THEN l * 2.5::DOUBLE END AS end_sec FROM (SELECT event_id, event_id % 12 AS f, event_id % 12 + event_id % 4 AS l, event_id % 12 >= 1 AND event_id % 12 + event_id % 4 < 11 AS ok FROM events)")
def bars_to_seconds(spark, sf_dir):
    i = F.col("event_id")
    times = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: k * F.lit(2.5))
    a, b = M.bars_to_seconds((i % 12).cast("int"), (i % 12 + i % 4).cast("int"), times)
    return table(spark, sf_dir, "events").select("event_id", a.alias("start_sec"), b.alias("end_sec"))


@Q.query("times_to_frames", "WITH e AS (SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 3600 AS t FROM events), f AS (SELECT DISTINCT user_id, round_even(t * 2, 0)::INT AS frame FROM e) SELECT user_id, frame, frame / 2.0::DOUBLE AS seconds FROM f WHERE frame >= 0 AND frame < 1000")
def times_to_frames(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 1e6 / 3600)
    frames = e.groupBy("user_id").agg(F.collect_list("t").alias("t")).select("user_id", M.times_to_frames(F.col("t"), 2.0, F.lit(1000)).alias("f"))
    return frames.select("user_id", F.explode("f").alias("frame")).withColumn("seconds", F.col("frame") / 2.0)


@Q.query("argmax_margin", "WITH l AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, list_position(v, list_max(v)) - 1 AS best, round(list_reverse_sort(v)[1] - list_reverse_sort(v)[2], 9) AS margin FROM l")
def argmax_margin(spark, sf_dir):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(v).cast("long").alias("best"), F.round(margin(v), 9).alias("margin"))


@Q.query("note_count_fallback", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value::INT END, CASE WHEN event_id % 5 = 0 THEN user_id END, CASE WHEN event_id % 7 = 0 THEN event_id END, 0) AS notes FROM events")
def note_count_fallback(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.when(i % 3 == 0, F.bround("value").cast("long")), F.when(i % 5 == 0, F.col("user_id")), F.when(i % 7 == 0, i), F.lit(0)).alias("notes"))


@Q.query("abc_noteheads", r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^([A-Za-z%]:|%%)[^\n]*$', '', 'g'), '\[[A-Za-z]:[^\]]*\]', '', 'g'), '![^!]*!', '', 'g'), '"[^"]*"', '', 'g'), '[_=^]*[A-Ga-g][,'']*')) AS heads FROM documents""")
def abc_noteheads(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.noteheads(F.col("text")).alias("heads"))


@Q.query("instrument_strip", r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'X:1' || chr(10) || 'V:' || user_id || chr(10) || 'abc nm=k' ELSE 'ticks_per_beat 480' || chr(10) || 'program_change 0 ' || user_id || ' 0' || chr(10) || 'note 1' END AS item FROM events""")
def instrument_strip(spark, sf_dir):
    i, u, nl = F.col("event_id"), F.col("user_id").cast("string"), F.lit("\n")
    abc = F.concat(F.lit("X:1"), nl, F.lit("V:"), u, F.lit(' nm="Piano" snm="P"'), nl, F.lit("abc nm=k"))
    events = F.concat(F.lit("ticks_per_beat 480"), nl, F.lit("program_change 0 "), u, F.lit(" "), u, nl, F.lit("note 1"))
    item = F.when(i % 2 == 0, abc).otherwise(events)
    return table(spark, sf_dir, "events").select("event_id", X.without_instruments(item).alias("item"))
