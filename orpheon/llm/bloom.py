"""Bloom filters as expressions: filled by aggregation, tested without UDFs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: A prefilter has at most so many bits. Beyond that many keys it only lets more through; a join decides.
PREFILTER_BITS = 1 << 24


@dataclass
class Level:
    """One Bloom filter: its bits as an array of 64-bit words in a one-row table, and how many hashes it takes."""

    bits: DataFrame
    m: int
    k: int
    seed: int

    def passes(self, key: Column) -> Column:
        """Whether key may be in the filter. The words are a scalar subquery: read once, and not part of the plan's text."""
        words = self.bits.scalar()
        found = None
        for pos in positions(key, self.m, self.k, self.seed):
            word = F.get(words, F.shiftright(pos, 6).cast("int"))
            hit = F.getbit(word, F.pmod(pos, F.lit(64)).cast("int")) == 1
            found = hit if found is None else found & hit
        return F.coalesce(found, F.lit(False))


def positions(key: Column, m: int, k: int, seed: int) -> list[Column]:
    first, second = F.xxhash64(key, F.lit(seed)), F.hash(key, F.lit(seed)).cast("long").bitwiseOR(F.lit(1))
    return [F.pmod(first + second * j, F.lit(m)) for j in range(k)]


def shape(n: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes of a filter with n keys and this false-positive rate."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return (bits + 63) // 64 * 64, max(1, round(-math.log2(rate)))


def fill(keys: DataFrame, m: int, k: int, seed: int = 0) -> Level:
    """A filter of the column `key`, OR-ed together by words; the m / 64 words meet in one row, which is checkpointed."""
    spark = keys.sparkSession
    shared_dir(spark)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), m, k, seed))).alias("pos"))
    set_bits = at.groupBy(F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    every = spark.range(m // 64).withColumnRenamed("id", "word").join(set_bits, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return Level(every.agg(F.transform(ordered, lambda x: x["bits"]).alias("words")).checkpoint(), m, k, seed)


def prefilter(keys: DataFrame) -> Level:
    """A filter of the column `key` that lets every key pass and most others not, of bounded size whatever the keys."""
    n = keys.count()
    m = min(PREFILTER_BITS, max(64, 10 * n + 63 & ~63))
    return fill(keys, m, 3 if 4 * n < m else 1)
