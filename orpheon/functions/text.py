"""Path, name and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed fold of accented Latin letters to ASCII, character by character.
FOLD_FROM = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def posix_path(p: Column) -> Column:
    return F.translate(p, "\\", "/")


def file_stem(p: Column) -> Column:
    """The last component of a path without its last extension."""
    return F.regexp_replace(F.regexp_extract(posix_path(p), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def rewrite_path(p: Column, from_dir: str, to_dir: str, from_ext: str, to_ext: str) -> Column:
    """Replace the first from_dir literally, and the extension where it is the suffix; POSIX separators."""
    path = posix_path(p)
    at = F.instr(path, from_dir)
    moved = F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.lit(to_dir), F.substring(path, at + len(from_dir), F.length(path)))).otherwise(path)
    return F.when(moved.endswith(from_ext), F.concat(F.substring(moved, F.lit(1), F.length(moved) - len(from_ext)), F.lit(to_ext))).otherwise(moved)


def clip_id(p: Column, slice_no: Column) -> Column:
    return F.concat(file_stem(p), F.lit("__"), F.substring(F.sha1(p), 1, 8), F.lit("__c"), slice_no.cast("string"))


def config_hash(model: Column, rate: Column, seconds: Column, signature: Column, pooled: Column) -> Column:
    """First 8 hex digits of sha256 over id|rate|%.6f seconds|signature|pool or frame."""
    kind = F.when(pooled, "pool").otherwise("frame")
    return F.substring(F.sha2(F.concat_ws("|", model, rate.cast("string"), F.format_string("%.6f", seconds.cast("double")), signature, kind), 256), 1, 8)


def stable_id(text: Column, how: str = "sha1") -> Column:
    """The first 8 hex digits of a hash as an integer."""
    hashed = F.sha1(text) if how == "sha1" else F.md5(text)
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")


def family_of(group: Column) -> Column:
    return F.substring_index(group, "|", 1)


def composite_id(sonata: Column, movement: Column, letter: Column) -> Column:
    return (sonata * 100000 + movement * 1000 + F.ascii(letter)).cast("long")


def variation_id(name: Column, pattern: str) -> Column:
    """The first group of the pattern as a number, else -1; never raises."""
    return F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("int"), F.lit(-1))


def slug(title: Column, longest: int = 80) -> Column:
    """ASCII fold, runs of other characters to one dash, no dash at the ends, cut."""
    dashed = F.btrim(F.regexp_replace(F.regexp_replace(ascii_fold(title), r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(dashed, 1, longest), F.lit("-"))


def safe_filename(name: Column) -> Column:
    cleaned = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "-")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"[ .]+$", ""), r"-{2,}", "-")
    return F.when(cleaned == "", "_unnamed").otherwise(cleaned)


def ascii_fold(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def phoneme_text(text: Column, fold: bool = True) -> Column:
    """Lower, trimmed, accents folded, listed punctuation gone, white space squeezed."""
    low = F.trim(F.lower(text))
    low = ascii_fold(low) if fold else low
    return F.trim(F.regexp_replace(F.regexp_replace(low, r'[.,?!:;"()\[\]\-]', ""), r"\s+", " "))


def asr_text(text: Column, chars: str) -> Column:
    """Listed characters to spaces, white space squeezed, upper case."""
    import re

    spaced = F.regexp_replace(text, "[" + re.escape(chars) + "]", " ") if chars else text
    return F.upper(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def noteheads(abc: Column) -> Column:
    """Pitched note heads in the body of an ABC text, without fields, voice tags, decorations and quoted text."""
    body = F.regexp_replace(abc, r"(?m)^([A-Za-z%]:|%%).*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\[[A-Za-z]:[^\]]*\]", ""), r"![^!]*!", "")
    return F.regexp_count(F.regexp_replace(body, r'"[^"]*"', ""), F.lit(r"[_=^]*[A-Ga-g][,']*")).cast("long")


def without_instruments(text: Column) -> Column:
    """ABC: voice lines lose their names; event text: program changes get program 0."""
    abc = F.regexp_replace(text, r"(?m)^(V:.*?) (?:nm|snm)=.*$", "$1")
    events = F.regexp_replace(text, r"(?m)^(program_change.*) \S*$", "$1 0")
    return F.when(text.startswith("ticks_per_beat "), events).otherwise(abc)


def sweep_coordinates(name: Column, job: Column, tags: Column) -> list[Column]:
    """layer (-1 for the mean of all), fold, window, stage and repr of a run."""
    name, job, tags = F.coalesce(name, F.lit("")), F.coalesce(job, F.lit("")), F.coalesce(tags, F.array().cast("array<string>"))
    mean_all = name.contains("meanall") | name.contains("mean-all") | F.exists(tags, lambda t: t.contains("mean-all") | t.contains("meanall"))

    def number(pattern: str, *sources: Column) -> Column:
        found = [F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).cast("int") for s in sources]
        return F.coalesce(*found)

    def in_tags(pattern: str) -> Column:
        hits = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, pattern, 1)), lambda x: x != "")
        return F.get(hits, F.lit(0)).cast("int")

    layer = F.when(mean_all, F.lit(-1)).otherwise(F.coalesce(number(r"layer-(\d+)", name), in_tags(r"layer-(\d+)")))
    stage = (
        F.when(job.startswith("test") | name.contains("-test") | name.endswith("test"), "test")
        .when(job.startswith("fit") | name.contains("-fit") | name.endswith("fit"), "fit")
    )
    return [
        layer.alias("layer"),
        number(r"fold[-_]?(\d+)", name, job).alias("fold"),
        F.coalesce(number(r"window[-_]?(\d+)", name, job), in_tags(r"window[-_]?(\d+)")).alias("window"),
        stage.alias("stage"),
        F.when(mean_all, "meanall").otherwise("single").alias("repr"),
    ]
