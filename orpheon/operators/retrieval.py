"""Ranked-retrieval metrics without a row for every pair.

All metrics follow from the ranks of the relevant items alone, and a relevant item's rank is one plus how many
gallery items beat it. So the N x N similarities are computed in tiles of TILE x TILE by matrix products and only
counts leave a tile: one row for each (query, relevant item). A single tile needs one shuffle and no pair rows;
B x B tiles move each vector 2 * B times.

Ties: equal similarities (to 12 decimals) rank by id. Self is never in the gallery. Queries without a relevant
item are skipped, never counted as 0.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096
_ITEM = ["id", "vec", "work_id", "grp", "cond", "var"]
#: Set-valued columns that items may have: letters make items relevant, a shared occurrence takes them out of a gallery.
_SETS = ["letters", "occ_ids"]


def items(df: DataFrame, id: Column, vec: Column, work_id: Column, group: Column | None = None, condition: Column | None = None, variation: Column | None = None) -> DataFrame:
    """The columns that the operators below take. group: the gallery is limited to it; condition: -1 is none."""
    none = F.lit(None).cast("long")
    return df.select(
        id.cast("long").alias("id"),
        vec.cast("array<double>").alias("vec"),
        work_id.cast("long").alias("work_id"),
        (none if group is None else group.cast("long")).alias("grp"),
        (none if condition is None else condition.cast("long")).alias("cond"),
        (none if variation is None else variation.cast("long")).alias("var"),
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _column(frame: pd.DataFrame, name: str) -> np.ndarray:
    return frame[name].fillna(-(1 << 62)).astype(np.int64).to_numpy()


def _allowed(q: pd.DataFrame, g: pd.DataFrame, twins: bool) -> np.ndarray:
    """Which gallery items a query ranks: not itself, its group if it has one, no (work, variation) twin if asked."""
    ok = q["id"].to_numpy()[:, None] != g["id"].to_numpy()[None, :]
    if q["grp"].notna().any():
        ok &= _column(q, "grp")[:, None] == _column(g, "grp")[None, :]
    if twins:
        ok &= ~((q["work_id"].to_numpy()[:, None] == g["work_id"].to_numpy()[None, :]) & (_column(q, "var")[:, None] == _column(g, "var")[None, :]))
    if "occ_ids" in q:
        ok &= ~_sharing(q["occ_ids"], g["occ_ids"])
    return ok


def _sharing(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Whether each set of a and each of b have a member in common; members are gone through one by one."""
    found = np.zeros((len(a), len(b)), bool)
    rows: dict = {}
    for side, sets in enumerate((a, b)):
        for k, members in enumerate(sets):
            for x in set(() if members is None else members):
                rows.setdefault(x, ([], []))[side].append(k)
    for mine, theirs in rows.values():
        if mine and theirs:
            found[np.ix_(mine, theirs)] = True
    return found


def _relevant(q: pd.DataFrame, g: pd.DataFrame) -> np.ndarray:
    """Items of one work, or items that share a letter where there are letters."""
    if "letters" in q:
        return _sharing(q["letters"], g["letters"])
    return q["work_id"].to_numpy()[:, None] == g["work_id"].to_numpy()[None, :]


def _dealt(df: DataFrame, tile: int) -> tuple[DataFrame, bool]:
    """df with the number of blocks of its group, by the group's size, and whether no group has more than one."""
    sizes = df.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    if (sizes.agg(F.max("blocks")).first()[0] or 1) == 1:
        return df.withColumn("blocks", F.lit(1)), True
    sizes = sizes.withColumnRenamed("grp", "_grp")
    return df.join(sizes, df["grp"].eqNullSafe(sizes["_grp"])).drop("_grp"), False


def _tiled(queries: DataFrame, gallery: DataFrame, fn, schema: str) -> DataFrame:
    """fn over tiles; rows say into how many blocks their group is dealt."""
    b = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    q = queries.withColumn("qb", b).withColumn("gb", each).withColumn("asks", F.lit(True))
    g = gallery.withColumn("gb", b).withColumn("qb", each).withColumn("asks", F.lit(False))

    def both(key, rows: pd.DataFrame) -> pd.DataFrame:
        return fn(key, rows[rows["asks"]], rows[~rows["asks"]])

    # A gallery is limited to its group, so groups never meet in a tile; without groups all rows have the null one.
    return q.unionByName(g, allowMissingColumns=True).groupBy("grp", "qb", "gb").applyInPandas(both, schema)


def relevant_ranks(df: DataFrame, twins: bool = False, within_condition: bool = False, queries: Column | None = None, tile: int = TILE) -> DataFrame:
    """(q, g, rk, n_rel, hits, qc, gc) for every relevant pair: g's rank among q's gallery, how many relevant items q
    has, and how many of them rank up to g.

    df: see items(). twins: candidates of the query's work and variation leave gallery and relevance.
    within_condition: ranks, n_rel and hits are taken within the candidates of g's condition."""
    extra = [c for c in _SETS if c in df.columns]
    df, single = _dealt(df.select(*_ITEM, *extra), tile)
    asked = df if queries is None else df.where(queries)

    def similar(key, q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(g):
            return pd.DataFrame({"q": [], "g": [], "s": [], "gc": []})
        rel = _relevant(q, g) & _allowed(q, g, twins)
        a, b = np.nonzero(rel)
        s = np.round(_unit(q["vec"]) @ _unit(g["vec"]).T, 12)
        return pd.DataFrame({"q": q["id"].to_numpy()[a], "g": g["id"].to_numpy()[b], "s": s[a, b], "gc": _column(g, "cond")[b]})

    pairs = _tiled(asked, df, similar, "q long, g long, s double, gc long")

    def beaten(q: pd.DataFrame, g: pd.DataFrame, by_query: dict) -> list[pd.DataFrame]:
        s = np.round(_unit(q["vec"]) @ _unit(g["vec"]).T, 12)
        ok = _allowed(q, g, twins)
        ids, cond = g["id"].to_numpy(), _column(g, "cond")
        out = []
        for k, me in enumerate(q["id"].tolist()):
            wanted = by_query.get(me)
            if wanted is None:
                continue
            rid, rs, rc = wanted
            counts = np.zeros(len(rid), np.int64)
            for c in np.unique(rc) if within_condition else [None]:
                at = ok[k] if c is None else ok[k] & (cond == c)
                mine = np.arange(len(rid)) if c is None else np.flatnonzero(rc == c)
                order = np.lexsort((-ids[at], s[k][at]))  # best last; of equal ones the smaller id is better
                ss, ii = s[k][at][order], ids[at][order]
                low, high = np.searchsorted(ss, rs[mine], "left"), np.searchsorted(ss, rs[mine], "right")
                better = len(ss) - high
                for j in np.flatnonzero(high > low):
                    better[j] += int((ii[low[j] : high[j]] < rid[mine[j]]).sum())
                counts[mine] = better
            out.append(pd.DataFrame({"q": me, "g": rid, "beaten": counts, "gc": rc}))
        return out

    if single:

        def whole(key, q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            found = similar(key, q, g)
            by_query = {k: (x["g"].to_numpy(), x["s"].to_numpy(), x["gc"].to_numpy()) for k, x in found.groupby("q")}
            return pd.concat(beaten(q, g, by_query) or [pd.DataFrame({"q": [], "g": [], "beaten": [], "gc": []})])

        counted = _tiled(asked, df, whole, "q long, g long, beaten long, gc long")
    else:
        listed = pairs.groupBy("q").agg(F.collect_list(F.struct("g", "s", "gc")).alias("wanted"))
        with_wanted = asked.join(listed, asked["id"] == listed["q"]).drop("q")

        def part(key, q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
            by_query = {i: (np.array([r["g"] for r in w]), np.array([r["s"] for r in w]), np.array([r["gc"] for r in w])) for i, w in zip(q["id"], q["wanted"], strict=True)}
            none = pd.DataFrame({"q": [], "g": [], "beaten": [], "gc": []})
            return pd.concat(beaten(q, g, by_query) or [none]) if len(q) and len(g) else none

        counted = _tiled(with_wanted, df, part, "q long, g long, beaten long, gc long").groupBy("q", "g", "gc").agg(F.sum("beaten").alias("beaten"))
    cond = asked.select(F.col("id").alias("q"), F.col("cond").alias("qc"))
    ranked = counted.withColumn("rk", F.col("beaten") + 1)
    own = ["q", "gc"] if within_condition else ["q"]
    by = Window.partitionBy(*own)
    ranked = ranked.withColumn("n_rel", F.count("*").over(by)).withColumn("hits", F.row_number().over(by.orderBy("rk")))
    return ranked.join(cond, "q").select("q", "g", F.col("rk").cast("long").alias("rk"), "n_rel", "hits", "qc", "gc")


def per_query(ranks: DataFrame, ks: Iterable[int] = (1, 5, 10), by: tuple[str, ...] = ("q",)) -> DataFrame:
    """One row for each query (or other keys): ap, rr, first, r_precision, and for each K recall, hit and ap."""
    part = F.col("hits") / F.col("rk")
    cols = [
        (F.sum(part) / F.first("n_rel")).alias("ap"),
        (1 / F.min("rk")).alias("rr"),
        F.min("rk").alias("first_rank"),
        (F.count_if(F.col("rk") <= F.col("n_rel")) / F.first("n_rel")).alias("r_precision"),
    ]
    for k in ks:
        within = F.col("rk") <= k
        cols += [
            (F.count_if(within) / F.first("n_rel")).alias(f"recall_{k}"),
            F.max(within.cast("double")).alias(f"hit_{k}"),
            (F.sum(F.when(within, part).otherwise(0.0)) / F.first("n_rel")).alias(f"ap_{k}"),
        ]
    return ranks.groupBy(*by).agg(*cols)


def metrics(ranks: DataFrame, ks: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """One row: map, mrr, median_rank, r_precision, n_queries, and recall / hit / map at each K."""
    ks = tuple(ks)
    each = per_query(ranks, ks)
    cols = [F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.percentile("first_rank", 0.5).alias("median_rank"), F.avg("r_precision").alias("r_precision"), F.count("*").alias("n_queries")]
    for k in ks:
        cols += [F.avg(f"recall_{k}").alias(f"recall_{k}"), F.avg(f"hit_{k}").alias(f"hit_{k}"), F.avg(f"ap_{k}").alias(f"map_{k}")]
    return each.agg(*cols)


def condition_grid(ranks: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_cond, target_cond, map, n_queries) for every pair of conditions; an empty cell is (0.0, 0).

    ranks: of relevant_ranks(within_condition=True); conditions: a column `cond`, -1 left out."""
    axis = conditions.where("cond <> -1").select("cond").distinct()
    axes = axis.select(F.col("cond").alias("query_cond")).crossJoin(axis.select(F.col("cond").alias("target_cond")))  # conditions, not items
    cells = per_query(ranks.where("qc <> -1 and gc <> -1"), (), ("q", "qc", "gc")).groupBy(F.col("qc").alias("query_cond"), F.col("gc").alias("target_cond")).agg(F.avg("ap").alias("map"), F.count("*").alias("n_queries"))
    return axes.join(cells, ["query_cond", "target_cond"], "left").select("query_cond", "target_cond", F.coalesce("map", F.lit(0.0)).alias("map"), F.coalesce("n_queries", F.lit(0)).cast("long").alias("n_queries"))


def grid_summary(grid: DataFrame) -> DataFrame:
    """mean_diag, mean_off, gap over cells with queries."""
    same = F.col("query_cond") == F.col("target_cond")
    cells = grid.where("n_queries > 0")
    return cells.agg(F.avg(F.when(same, F.col("map"))).alias("mean_diag"), F.avg(F.when(~same, F.col("map"))).alias("mean_off")).withColumn("gap", F.col("mean_diag") - F.col("mean_off"))


def score_histogram(df: DataFrame, bins: int = 50, tile: int = TILE) -> DataFrame:
    """(qc, gc, pool, bin, n, total, squares): similarities of all ordered pairs, by condition cell and pool.

    Pools: rel (same work, other variation), twin (same work and variation), distractor. Bins split [-1, 1] evenly;
    values outside are clamped and the last bin is closed. Pairs are counted inside the tiles."""
    df, _ = _dealt(df.select(*_ITEM).withColumn("grp", F.lit(None).cast("long")), tile)

    def part(key, q: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("qc", "gc", "pool", "bin", "n", "total", "squares")})
        if not len(q) or not len(g):
            return none
        s = np.round(_unit(q["vec"]) @ _unit(g["vec"]).T, 12)
        ok = q["id"].to_numpy()[:, None] != g["id"].to_numpy()[None, :]
        work = q["work_id"].to_numpy()[:, None] == g["work_id"].to_numpy()[None, :]
        twin = work & (_column(q, "var")[:, None] == _column(g, "var")[None, :])
        pool = np.where(twin, 1, np.where(work, 0, 2))
        which = np.minimum(np.floor((np.clip(s, -1, 1) + 1) / 2 * bins).astype(np.int64), bins - 1)
        qc = np.broadcast_to(_column(q, "cond")[:, None], s.shape)
        gc = np.broadcast_to(_column(g, "cond")[None, :], s.shape)
        flat = pd.DataFrame({"qc": qc[ok], "gc": gc[ok], "pool": pool[ok], "bin": which[ok], "s": s[ok]})
        flat["s2"] = flat["s"] ** 2
        out = flat.groupby(["qc", "gc", "pool", "bin"], as_index=False).agg(n=("s", "size"), total=("s", "sum"), squares=("s2", "sum"))
        out["pool"] = out["pool"].map({0: "rel", 1: "twin", 2: "distractor"})
        return out

    found = _tiled(df, df, part, "qc long, gc long, pool string, bin int, n long, total double, squares double")
    return found.where("qc <> -1 and gc <> -1").groupBy("qc", "gc", "pool", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def pool_moments(histogram: DataFrame) -> DataFrame:
    """(qc, gc, pool, n, mean, std): std is population, from the moments."""
    sums = histogram.groupBy("qc", "gc", "pool").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
    mean = F.col("t") / F.col("n")
    return sums.select("qc", "gc", "pool", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("s") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def pool_means(moments: DataFrame) -> DataFrame:
    """within, twin, honest and distractor: means of the score pools, weighted by counts. `within` is of all relevant
    pairs of equal conditions, the others of pairs of different ones: the twins, the relevant pairs of other variations,
    and the rest. moments: of pool_moments(); a pool without pairs gives null."""

    def mean(cells):
        return F.sum(F.when(cells, F.col("n") * F.col("mean"))) / F.sum(F.when(cells, F.col("n")))

    same, pool = F.col("qc") == F.col("gc"), F.col("pool")
    return moments.agg(
        mean(same & (pool != "distractor")).alias("within"),
        mean(~same & (pool == "twin")).alias("twin"),
        mean(~same & (pool == "rel")).alias("honest"),
        mean(~same & (pool == "distractor")).alias("distractor"),
    )


def histogram_auc(histogram: DataFrame, a: str, b: str) -> DataFrame:
    """auc = P(a > b), half-weighted within a bin, from bins summed over all cells."""
    bins = histogram.groupBy("bin").agg(F.sum(F.when(F.col("pool") == a, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("pool") == b, F.col("n")).otherwise(0)).alias("b"))
    before = F.sum("b").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # one row a bin
    parts = bins.withColumn("before", F.coalesce(before, F.lit(0)))
    return parts.agg((F.sum(F.col("a") * (F.col("before") + F.col("b") / 2)) / (F.sum("a") * F.sum("b"))).alias("auc"))


def multilabel_items(df: DataFrame, group: Column | None = None, id: Column | None = None) -> DataFrame:
    """Items of relevant_ranks() with set-valued relevance. df: id, vec, grp, letters, occ_ids.

    A query's gallery is its group without itself and without items that share an occurrence; relevant items share a
    letter, so an item without letters is never a query with a relevant one."""
    none = F.lit(None).cast("long")
    return df.select(
        (F.col("id") if id is None else id).cast("long").alias("id"),
        F.col("vec").cast("array<double>").alias("vec"),
        none.alias("work_id"),
        (F.col("grp") if group is None else group).cast("long").alias("grp"),
        none.alias("cond"),
        none.alias("var"),
        "letters",
        "occ_ids",
    )


def multilabel_map(df: DataFrame, tile: int = TILE) -> DataFrame:
    """map and n_queries inside groups with set-valued relevance; df: see multilabel_items()."""
    each = per_query(relevant_ranks(multilabel_items(df), tile=tile), ())
    return each.agg(F.avg("ap").alias("map"), F.count("*").alias("n_queries"))


def permutation_null(df: DataFrame, n_perms: int = 20, seed: int = 0, tile: int = TILE) -> DataFrame:
    """map, null_mean, null_std (population), lift and p of the within-group MAP under shuffled letters.

    In each permutation the letters of a group are dealt out in the order of a hash of (seed, permutation, id);
    galleries and orders stay. Each permutation of a group is a group of its own to the tiles, which give the ranks of
    relevant items only, so items are copied once for each permutation and pairs never."""
    at = df.withColumn("spot", F.row_number().over(Window.partitionBy("grp").orderBy("id")))
    perm = df.select("id", "grp", "letters", F.explode(F.sequence(F.lit(1), F.lit(n_perms))).alias("perm"))
    dealt = perm.withColumn("spot", F.row_number().over(Window.partitionBy("grp", "perm").orderBy(F.xxhash64(F.lit(seed), "perm", "id"), "id"))).select("grp", "perm", "spot", "letters")
    shuffled = at.drop("letters").join(dealt, ["grp", "spot"])
    every = at.withColumn("perm", F.lit(0)).unionByName(shuffled).drop("spot")
    turns = n_perms + 1
    each = per_query(relevant_ranks(multilabel_items(every, F.col("grp") * turns + F.col("perm"), F.col("id") * turns + F.col("perm")), tile=tile), ())
    maps = each.groupBy(F.pmod("q", F.lit(turns)).alias("perm")).agg(F.avg("ap").alias("map"))
    null = F.when(F.col("perm") > 0, F.col("map"))
    stats = maps.agg(F.max(F.when(F.col("perm") == 0, F.col("map"))).alias("real"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_std"), F.collect_list(null).alias("maps"))
    beats = F.size(F.filter("maps", lambda m: m >= F.col("real")))
    return stats.select(F.col("real").alias("map"), "null_mean", "null_std", (F.col("real") - F.col("null_mean")).alias("lift"), ((beats + 1) / turns).alias("p"))
