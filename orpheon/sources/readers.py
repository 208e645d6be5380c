"""Readers with explicit schemas. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from orpheon.functions.text import posix_path

#: The columns that every manifest has; a task adds its own.
CORE = "audio_path string, sample_rate int, num_samples long, channels int, duration double, bit_depth int"
TASKS = {
    "cover_retrieval": "work_id long, version int",
    "cover_retrieval_large": "work_id long, performance_id long, title string, artist string, youtube_id string",
    "variation_retrieval": "work_id long, variation int, piece_id string, section string, split string",
    "key": "ori_uid string, label string",
    "emotion": "label array<double>",
    "pitch": "pitch int, velocity int, instrument_family string, instrument_source string",
    "tagging": "label array<string>",
    "chords": "label array<struct<start_time:double,end_time:double,chord_str:string>>",
    "beats": "label struct<beat:array<double>,downbeat:array<double>,tempo:double,meter:string>",
    "structure_segment": "ori_uid string, work_id long, label string, seg_idx int, seg_start double, seg_end double, title string, artist string, genre string",
    "loop_type": "label string",
    "motif_window": "midi_path string, piece_id string, is_motif int, motif_letter string, occurrence_id string, start_sec double, end_sec double, fold int, split string",
}


def manifest(spark: SparkSession, path: str, task: str | None = None, extra: str = "") -> DataFrame:
    """JSON lines with the task's schema; back-slashes in audio_path become slashes."""
    schema = ", ".join(x for x in (CORE, TASKS[task] if task else "", extra) if x)
    return spark.read.schema(schema).json(path).withColumn("audio_path", posix_path(F.col("audio_path")))


def numeric_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("time", "f0")) -> DataFrame:
    """Headerless numbers; a malformed row fails the read, and so does a file of fewer columns."""
    schema = ", ".join(f"{c} double" for c in columns)
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", "true").csv(path)
    return df.select(*(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast("double")).otherwise(F.col(c)).alias(c) for c in columns))


def condition_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_program int, target_program int, map double, n_queries long").option("header", "true").csv(path)


def dense_grid(grid: DataFrame, programs: list[int]) -> DataFrame:
    return grid.groupBy("query_program").pivot("target_program", programs).agg(F.first("map"))


def segment_text(spark: SparkSession, path: str, canonical: dict[str, str]) -> DataFrame:
    """(file, start, stop, label) from lines "seconds label": each to the next; unknown labels, empty spans and `end` go."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value")).where(F.col("value").rlike(r"^[0-9.]+\s+\S"))
    parts = lines.select("file", F.regexp_extract("value", r"^([0-9.]+)\s+(.*)$", 1).cast("double").alias("start"), F.lower(F.regexp_extract("value", r"^([0-9.]+)\s+(.*)$", 2)).alias("raw"))
    spans = parts.withColumn("stop", F.lead("start").over(Window.partitionBy("file").orderBy("start")))
    names = F.create_map(*(F.lit(x) for pair in canonical.items() for x in pair))
    return spans.withColumn("label", names[F.col("raw")]).where("raw <> 'end' and stop > start and label is not null").select("file", "start", "stop", "label")


def url_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, video_id) of rows with a URL."""
    rows = spark.read.schema("id string, url string").option("header", "true").csv(path)
    return rows.where("url is not null and url <> ''").select("id", F.regexp_extract("url", r"(?:v=|youtu\.be/|/embed/)([A-Za-z0-9_-]{11})", 1).alias("video_id"))


def piece_table(spark: SparkSession, path: str, columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """(piece_id, columns) of a CSV with a header, by name; trimmed, rows without an id left out."""
    rows = spark.read.option("header", "true").csv(path)
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c)
    return rows.select(text("piece_id"), *(text(c) for c in columns)).where("piece_id <> ''")


def piece_splits(spark: SparkSession, path: str, digits: int = 5) -> DataFrame:
    """(piece_id padded with zeros, split) of a pair table: numbers only, known splits only, one row a piece."""
    rows = spark.read.option("header", "true").csv(path).select(F.trim("piece_id").try_cast("long").alias("n"), F.trim("split").alias("split"))
    kept = rows.where("n is not null and split in ('train', 'val', 'test')")
    return kept.groupBy(F.lpad(F.col("n").cast("string"), digits, "0").alias("piece_id")).agg(F.max("split").alias("split"))


def function_annotations(spark: SparkSession, path: str, canonical: dict[str, str]) -> DataFrame:
    """(file, bar_start, bar_end, label) of JSON files {Function: [{Function, BarRange: [first, last]}]}; entries with an
    unknown label, another kind of range or an empty one are left out, and so are files that are no JSON."""
    schema = "Function array<struct<Function:string,BarRange:array<int>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("Function").alias("e"))
    names = F.create_map(*(F.lit(x) for pair in canonical.items() for x in pair))
    spans = rows.select("file", F.get("e.BarRange", F.lit(0)).alias("bar_start"), F.get("e.BarRange", F.lit(1)).alias("bar_end"), F.size("e.BarRange").alias("n"), names[F.col("e.Function")].alias("label"))
    return spans.where("n = 2 and bar_end > bar_start and label is not null").drop("n")


def bar_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(piece, bar_start, bar_end, label) of JSON files {piece, segments: [{start, end, label}]}."""
    schema = "piece string, segments array<struct<start:int,end:int,label:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select("piece", F.explode("segments").alias("s")).select("piece", F.col("s.start").alias("bar_start"), F.col("s.end").alias("bar_end"), F.col("s.label").alias("label"))


def note_csv(spark: SparkSession, path: str) -> DataFrame:
    """Notes: onset, pitch, morphetic, duration, staff; whole numbers may be written as 46.0."""
    rows = spark.read.schema("onset double, pitch string, morphetic string, duration double, staff string").csv(path)
    whole = lambda c: F.col(c).try_cast("double").cast("int").alias(c)
    return rows.where("onset is not null").select("onset", whole("pitch"), whole("morphetic"), "duration", whole("staff"))


def songs(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(id, song) of a JSON object of songs; .gz is read as it is."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("id", "song"))


def files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path, size) below a folder, by extension; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))


_HEADER = T.StructType().add("sample_rate", "integer").add("num_samples", "long").add("channels", "integer").add("bit_depth", "integer")


def wav_fields(head: bytes) -> tuple | None:
    """(rate, frames, channels, bits) of a RIFF/WAVE header, or None."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(head):
        kind, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if kind == b"fmt " and at + 24 <= len(head):
            _, channels, rate, _, align, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            fmt = channels, rate, align, bits
        elif kind == b"data" and fmt:
            return fmt[1], size // max(1, fmt[2]), fmt[0], fmt[3]
        at += 8 + size + (size & 1)
    return None


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, num_samples, channels, bit_depth) of WAV files; nulls where the header is no PCM header."""

    @pandas_udf(_HEADER)
    def probe(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wav_fields(bytes(c)) or (None,) * 4 for c in content], columns=_HEADER.names).astype("Int64")

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return raw.select("path", probe(F.substring("content", 1, 4096)).alias("h")).select("path", "h.*")


def wav_slices(spark: SparkSession, path: str, clip_frames: int) -> DataFrame:
    """(path, slice, samples) of 16-bit PCM WAV files, channels averaged, the last clip padded with zeros."""
    import numpy as np

    @pandas_udf("array<array<float>>")
    def cut(content: pd.Series) -> pd.Series:
        out = []
        for c in content:
            raw = bytes(c)
            fields = wav_fields(raw)
            if fields is None or fields[3] != 16:
                out.append([])
                continue
            start = raw.index(b"data") + 8
            x = np.frombuffer(raw[start : start + fields[1] * fields[2] * 2], "<i2").reshape(-1, fields[2]).mean(axis=1) / 32768
            x = np.pad(x, (0, -len(x) % clip_frames)).astype(np.float32)
            out.append(x.reshape(-1, clip_frames).tolist())
        return pd.Series(out)

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return raw.select("path", F.posexplode(cut("content")).alias("slice", "samples"))


def run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Latest summary of each run folder that has a test/ key: (run, summary map)."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("summary"))
    tested = rows.where(F.exists(F.map_keys("summary"), lambda k: k.startswith("test/")))
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+/[^/]+$", 1)
    return tested.groupBy(folder.alias("run")).agg(F.max_by("summary", "file").alias("summary"))


def cached_embeddings(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Cached vectors, limited to wanted clip ids by a semi-join that reaches the scan where it can."""
    cached = spark.read.parquet(path)
    return cached if wanted is None else cached.join(wanted.select("clip_id"), "clip_id", "left_semi")


def consolidated(manifest_rows: DataFrame, cached: DataFrame) -> DataFrame:
    """One mean vector a file from cached clips; fails at run time if a manifest row has no clip. Both have `stem`."""
    from orpheon.functions.vectors import mean_vectors

    joined = manifest_rows.select("stem").distinct().join(cached.select("stem", "vec"), "stem", "left")
    checked = joined.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no cached clip for "), F.col("stem"))).cast("array<double>")).otherwise(F.col("vec").cast("array<double>")))
    return mean_vectors(checked, ["stem"], "vec")


def rejects(df: DataFrame, rules: list[tuple[str, object]]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, (reason, n) of the others): the first rule that does not hold is a row's reason."""
    from orpheon.operators.tables import first_failure

    marked = df.withColumn("_reason", first_failure(rules))
    return marked.where("_reason = 'ok'").drop("_reason"), marked.where("_reason <> 'ok'").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))
