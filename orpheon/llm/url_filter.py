"""URL filter: host/path rules first, then a Bloom filter cascade over the corpus's complete key universe.

A page's key is its host and path. The list is a table of keys; nothing about a key tells whether it is listed.
Everything here is DataFrame expressions. The cascade is exact for every key of its universe: level 0 holds the listed
keys, level 1 the unlisted keys that pass level 0, level 2 the listed keys that pass level 1, and so on until a level
lets nothing wrong through. A key's answer is the parity of the first level it fails.

A filter has at most `max_bits`. Where the listed keys need more, keys are dealt into groups by hash; each group has a
cascade of its own, and the pages of each group are judged in a pass of their own, whose result is written. So what the
executors hold at once is bounded, whatever the list, and the list is never joined to the pages.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the
cascade under the empty key. An empty list allows everything; an empty table gives no rows. Keys that are listed but
occur on no page, and null keys, change nothing. Repeated rows are judged one by one, very long urls whole; of several
rules that fit the longest wins, of equally long ones the first in order. Only the id and url columns are read (html as
well where the list is taken from pages), so extra columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Level, fill, shape
from .common import LOWER, UPPER, shared_dir, stored, table

#: Fixed rules: (verdict, host and path prefix). A host also fits its subdomains; the longest rule wins.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: A page's key is listed if one of the pages with it has one of these notices in its html, A-Z lowered.
NOTICES = ("license", "cc by nc")
#: Bits of a filter at most: 8 MB, an array of a million words in one row.
MAX_BITS = 1 << 26


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


class Cascade:
    """Exact membership of a listed set within a universe, without a join."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].passes(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def first_rate(inside: int, outside: int) -> float:
    """The false-positive rate of level 0: set by the ratio of listed to other keys, so that later levels hold no more
    keys than the first and all levels together stay within a small multiple of it."""
    return min(0.5, max(1e-9, inside / max(1, outside) / math.sqrt(2)))


def build_cascade(universe: DataFrame) -> Cascade:
    """universe: distinct (key, listed)."""
    n = universe.agg(F.count_if("listed").alias("a"), F.count_if(~F.col("listed")).alias("b")).first()
    inside, rate = n.a, first_rate(n.a, n.b)
    levels: list[Level] = []
    keep, wrong = universe.where("listed").select("key"), universe.where("not listed").select("key")
    while inside:
        levels.append(fill(keep, *shape(inside, rate), len(levels)))
        through = wrong.where(levels[-1].passes(F.col("key")))
        keep, wrong, inside, rate = through, keep, through.count(), 0.5
    return Cascade(levels)


def url_key(url: Column) -> Column:
    """Host and path of a url."""
    return F.concat(*split_url(url))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages (page_id, url). listed: a table of keys (key)."""
    spark = pages.sparkSession
    shared_dir(spark)
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    universe = rows.select(key.alias("key"), F.lit(False).alias("listed")).union(listed.where("key is not null").select("key", F.lit(True)))
    universe = stored(spark, universe.groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    n = universe.agg(F.count_if("listed").alias("a"), F.count_if(~F.col("listed")).alias("b")).first()
    groups = max(1, math.ceil(shape(n.a, first_rate(n.a, n.b))[0] * 1.25 / max_bits))  # a quarter more, as hashes deal unevenly
    group = lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(groups))
    if groups == 1:
        judged = rows.withColumn("listed", build_cascade(universe).listed(key))
    else:
        judged = None
        for g in range(groups):
            cascade = build_cascade(universe.where(group(F.col("key")) == g))
            part = stored(spark, rows.where(group(key) == g).withColumn("listed", cascade.listed(key)), "judged")
            judged = part if judged is None else judged.union(part)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "listed")


def noticed_keys(pages: DataFrame, notices=NOTICES) -> DataFrame:
    """key: of the pages whose html has one of the notices."""
    low = F.translate("html", UPPER, LOWER)
    found = F.lit(False)
    for notice in notices:
        found = found | low.contains(notice)
    return pages.where(found).select(url_key(F.col("url")).alias("key"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, noticed_keys(pages))


def _oracle() -> str:
    cases = []
    for said, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, prefix = text.partition("/")
        cases.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + prefix}') THEN '{text}'")
    said = " ".join(f"WHEN '{text}' THEN '{v}'" for v, text in RULES)
    noticed = " OR ".join(f"contains(low, '{x}')" for x in NOTICES)
    return f"""
WITH r AS (SELECT page_id, translate(coalesce(html, ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, low, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k AS (SELECT DISTINCT host || path AS key FROM p WHERE {noticed}),
j AS (SELECT *, host || path IN (SELECT key FROM k) AS listed, CASE {' '.join(cases)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {said} ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM j"""


ORACLE = _oracle()
