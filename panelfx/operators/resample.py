"""Resampling operators (#85-87, #89, #93b, #94-96, #101).

All random choices come from hashes of (seed, replicate, row key), never
from ``rand()``: a recomputed partition after an executor loss draws the
same values, and md5-based draws equal those of any other engine.

Placebos order the rows of a replicate by their draws; a row's place follows
from its draw and the draws at a few ranks.  Where rows must be paired anew
(``permute_within_replicates``) two exact ranks are joined: a base rank of each
row (by a seed-free hash of its key) and a rank by a hash of (seed, replicate,
key).  Exact ranks come from ``bucket_rank``: hash buckets, counts per bucket,
running offsets over the small count table and a position inside each
bounded bucket, so no replicate (or hot key) is ever gathered into a single
task and every value is reproducible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.expr import HASH_RANGE, hash_int, hash_uniform
from .effects import affine_score_stats, aipw_from_moments, aipw_score, finish_estimate, summarize_scores
from .frame import all_present, with_one_row
from .grouped import MATRIX_CELLS, PACKED_CELLS, groups_of, matrix_of
from .learners import crossfit_nuisances, join_on_keys
from ..session import cut_lineage


# ------------------------------------------------------------------ folds
def fold_expr(k: int, seed: int, key: Sequence[str]) -> Column:
    """#85: fold = md5(seed:key) mod k (first 13 hex digits as an integer)."""
    return F.pmod(hash_int(F.lit(seed), *[F.col(c) for c in key]), F.lit(k)).cast("long")


def fold_assign(df: DataFrame, k: int, seed: int, key: Sequence[str], out: str = "fold") -> DataFrame:
    return df.withColumn(out, fold_expr(k, seed, key))


# ------------------------------------------------------------------- rank
ROWS_PER_BUCKET = 50_000


def bucket_rank(df: DataFrame, part: Sequence[str], order: Sequence[Column | str], bucket: Column,
                out: str = "rank") -> DataFrame:
    """Exact 1-based rank within ``part`` by ``order`` (unique within a part).

    ``bucket`` must be an integer that never decreases along ``order`` (for
    example the top bits of a hash that is the first order key).  Rows are
    counted per (part, bucket); offsets are running sums over that small
    count table; each row's rank is its offset plus its position inside the
    (part, bucket) group.  Groups are bounded (uniform buckets), every value
    is deterministic, so recomputation gives the same ranks and no part is
    ever gathered into one task."""
    part = list(part)
    # One shuffle by (part, bucket) serves both the in-bucket positions and
    # the bucket sizes (the count aggregation reads the same exchange).
    lw = Window.partitionBy(*part, "_bk").orderBy(*order)
    d = df.withColumn("_bk", bucket).withColumn("_lr", F.row_number().over(lw))
    counts = d.groupBy(*part, "_bk").agg(F.max("_lr").alias("_c"))
    w = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1) if part else \
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    # ``counts`` holds (parts x buckets) rows: the window runs over that
    # small table, not over the data.
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    ranked = join_on_keys(d, offs, [*part, "_bk"], "inner")
    return ranked.withColumn(out, F.col("_off") + F.col("_lr")).drop("_bk", "_off", "_lr")


def n_buckets_for(df: DataFrame, parts: int = 1) -> int:
    """Buckets so that a (part, bucket) group holds about ROWS_PER_BUCKET
    rows (one count job)."""
    n = df.count()
    return max(1, -(-n // (max(parts, 1) * ROWS_PER_BUCKET)))


def hash_rank(df: DataFrame, part: Sequence[str], h: str, key: Sequence[str], out: str,
              n_buckets: int) -> DataFrame:
    """Rank by (h, key) within ``part`` where ``h`` is an integer of ``hash_int``."""
    bucket = F.floor(F.col(h).cast("double") / F.lit(float(HASH_RANGE)) * F.lit(float(n_buckets))).cast("long")
    return bucket_rank(df, part, [F.col(h), *[F.col(k) for k in key]], bucket, out)


def replicate(df: DataFrame, R: int, r_col: str = "r") -> DataFrame:
    return df.withColumn(r_col, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(int(R)).cast("long"))))


def permute_within_replicates(df: DataFrame, moved: Sequence[str], key: Sequence[str], R: int, seed: int,
                              r_col: str = "r", hash_method: str = "md5") -> DataFrame:
    """R copies of ``df``; in copy r the ``moved`` columns are permuted across
    rows: the row with base rank j (by md5("k":key)) takes the values of the
    row with replicate rank j (by md5(seed:r:key)).  Row count and the
    multiset of moved values are kept exactly."""
    key = list(key)
    moved = list(moved)
    stay = [c for c in df.columns if c not in moved]
    nb = n_buckets_for(df)
    base = df.withColumn("_hk", hash_int(F.lit("k"), *[F.col(c) for c in key], method=hash_method))
    base = hash_rank(base, [], "_hk", key, "_krank", nb).drop("_hk")
    src = replicate(df.select(*key, *moved), R, r_col)
    src = src.withColumn("_h", hash_int(F.lit(seed), F.col(r_col), *[F.col(c) for c in key], method=hash_method))
    src = hash_rank(src, [r_col], "_h", key, "_hrank", nb).select(r_col, F.col("_hrank").alias("_krank"), *moved)
    # Join on the base rank alone: the base rows (N, all columns) are
    # shuffled once and meet their R replicate values; only the narrow
    # (r, rank, moved) side has R x N rows.  Each base rank has exactly R
    # partners, so no key is hot.
    return src.join(base.select(*stay, "_krank"), "_krank", "inner").drop("_krank")


# ----------------------------------------------------------- placebo runs
MAX_SLOTS = 64     # (T, cell) groups that draws are told apart for; beyond, rows are ranked
RANK_BUCKETS = 4096


class Draws:
    """A row's draw in replicate r, from (seed, r, key): 52 bits as 13 hex digits of md5 (as any engine has them), or of xxhash64."""

    def __init__(self, seed: int, key_text: str, method: str = "md5"):
        self.seed, self.key, self.method = seed, key_text, method

    def column(self, r: Column) -> Column:
        if self.method == "xxhash":
            return F.pmod(F.xxhash64(F.lit(self.seed), r, F.col(self.key)), F.lit(HASH_RANGE).cast("long"))
        return F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), r.cast("string"), F.col(self.key))), 1, 13)

    def literal(self, value: int) -> Column:
        value = min(max(value, 0), HASH_RANGE - 1)
        return F.lit(f"{value:013x}") if self.method == "md5" else F.lit(value).cast("long")


def key_text(key: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in key])


def by_draw(d: DataFrame, ranks: Sequence[int], n: int, draws: Draws, R: int, r_col: str, sums: dict[str, Column],
            keep: Sequence[str] = (), width: float = 7.0) -> DataFrame:
    """r, _slot, ``keep`` and the ``sums`` over the rows of each slot; slot i are the rows whose draw ranks behind
    the i-th of ``ranks`` (rising) and up to the next, among the ``n`` rows.

    The draw at rank k of n lies within ``width`` standard deviations of k/n
    but once in 10^11.  So one pass adds up the rows between such brackets,
    whose slot is known, and keeps the few rows inside, some 14 sqrt(n) per
    rank and replicate; these are ranked.  Should a bracket miss its rank, the
    pass is made again with brackets twice as wide."""
    brackets: list[list[int]] = []
    for k in ranks:
        p = k / n
        half = width * math.sqrt(max(p * (1 - p), 1 / n) / n) + width * width / n
        low, high = math.floor((p - half) * HASH_RANGE), math.ceil((p + half) * HASH_RANGE)
        if brackets and low <= brackets[-1][1]:
            brackets[-1][1] = max(high, brackets[-1][1])
        else:
            brackets.append([low, high])
    h, piece = F.col("_h"), F.lit(2 * len(brackets))
    for i in reversed(range(len(brackets))):
        low, high = (draws.literal(v) for v in brackets[i])
        piece = F.when(h < low, F.lit(2 * i)).when(h <= high, F.lit(2 * i + 1)).otherwise(piece)
    drawn = replicate(d, R, r_col).withColumn("_h", draws.column(F.col(r_col))).withColumn("_p", piece)
    parts = cut_lineage(drawn.groupBy(r_col, "_p", F.when(F.col("_p") % 2 == 1, h).alias("_v"), *keep).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(name) for name, c in sums.items()]))
    # Rows between the same brackets are peers, and so are equal draws: they share a rank and fall to one side.
    order = Window.partitionBy(r_col).orderBy("_p", "_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_to", F.sum("_n").over(order)).withColumn("_peers", F.sum("_n").over(Window.partitionBy(r_col, "_p", "_v")))
    ahead = [F.when(F.lit(int(k)) < F.col("_to"), 1).otherwise(0) for k in ranks]
    passed = [F.when(F.lit(int(k)) <= F.col("_to") - F.col("_peers"), 1).otherwise(0) for k in ranks]
    parts = parts.withColumn("_slot", sum(ahead, F.lit(0))).withColumn("_first", sum(passed, F.lit(0)))
    if ranks and not parts.where("_v is null and _slot <> _first").isEmpty():
        return by_draw(d, ranks, n, draws, R, r_col, sums, keep, 2 * width)
    return parts.groupBy(r_col, "_slot", *keep).agg(*[F.sum(name).alias(name) for name in sums])


def slots_by_rank(d: DataFrame, sized: DataFrame, groups: list[str], draws: Draws, R: int, r_col: str, n: int, cells: int) -> DataFrame:
    """The same for any number of groups: rows are ranked within a replicate in
    buckets of draws, and ranks meet the groups' ranges bucket by bucket.
    ``sized``: groups with ``_from`` and ``_upto``.  A bucket of ranks holds a
    few groups, however many there are."""
    span = max(1, n // max(RANK_BUCKETS, cells))
    ranges = sized.withColumn("_rb", F.explode(F.sequence(F.expr(f"(_from + 1) div {span}"), F.expr(f"_upto div {span}"))))
    drawn = replicate(d.drop(*groups), R, r_col).withColumn("_h", draws.column(F.col(r_col)))
    digits = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32) if draws.method == "md5" else F.col("_h") / float(HASH_RANGE)
    buckets = max(1, -(-n // ROWS_PER_BUCKET))
    ranked = bucket_rank(drawn, [r_col], ["_h", "_key"], F.floor(digits * buckets).cast("long"), "_rank")
    ranked = ranked.withColumn("_rb", F.expr(f"_rank div {span}"))
    return ranked.join(ranges, (ranked["_rb"] == ranges["_rb"]) & (F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_upto")))


def placebo(df: DataFrame, t: str, y: str, cells: Sequence[str], key: Sequence[str], R: int = 1000,
            permute: str = "treatment", seed: int = 42, clip=(0.01, 0.99), r_col: str = "r",
            hash_method: str = "md5") -> DataFrame:
    """#94 / #95: per replicate, permute T (or Y) and re-estimate AIPW with
    cell-mean nuisances; one row per replicate.

    A replicate orders the rows by a draw from (seed, r, key).  Permuting a
    treatment gives T = 1 to the first n1 rows, T = 0 to the next n0.
    Permuting an outcome hands the rows' outcomes to the (T, cell) groups in
    turn, each group as many as it has rows.  Up to MAX_SLOTS groups one pass
    suffices (``by_draw``): no replicated row is shuffled, and the sums per
    (replicate, cell, arm) come from one map-side combined aggregation.  With
    more groups rows are ranked, and nothing but counts reaches the driver.
    Draws have 52 bits; should two rows tie at a rank, both fall to the same
    side."""
    names = [f"_cell{i}" for i in range(len(list(cells)))]
    d = cut_lineage(df.select(key_text(key).alias("_key"), F.col(t).cast("int").alias("_t"),
                              F.col(y).cast("double").alias("_y"), *[F.col(c).alias(n) for c, n in zip(cells, names)]))
    draws = Draws(seed, "_key", hash_method)
    groups = ["_t"] if permute == "treatment" else ["_t", *names]
    order = [F.col("_t").desc_nulls_last(), *[F.col(n).asc_nulls_first() for n in groups[1:]]]
    # One row per value of T, or per (T, cell): the size of the result's own cell table.
    sized = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"), F.sum("_y").alias("_sum"), F.count("_y").alias("_ys"))
    sized = sized.withColumn("_upto", F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sized = cut_lineage(sized.withColumn("_from", F.col("_upto") - F.col("_size")))
    size = sized.agg(F.count(F.lit(1)).alias("slots"), F.max("_upto").alias("n"), (F.sum("_sum") / F.sum("_ys")).alias("centre")).first()
    away = F.col("_y") - F.lit(size["centre"] or 0.0)  # squares around the common mean lose no digits
    sums = {"_c": F.when(away.isNotNull(), 1).otherwise(0), "_s": away, "_q": away * away}
    if size["slots"] <= MAX_SLOTS:
        slots = sized.orderBy("_upto").collect()
        schema = StructType([StructField("_slot", IntegerType()), *[d.schema[g] for g in groups]])
        table = d.sparkSession.createDataFrame([(i, *[s[g] for g in groups]) for i, s in enumerate(slots)], schema)
        found = by_draw(d.drop(*groups), [s["_upto"] for s in slots[:-1]], size["n"] or 0, draws, R, r_col, sums, [n for n in names if n not in groups])
        found = found.join(F.broadcast(table), "_slot")  # at most MAX_SLOTS rows
    else:
        rows = slots_by_rank(d, sized, groups, draws, R, r_col, size["n"], size["slots"])
        found = rows.groupBy(r_col, *names, "_t").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    found = found.where("_t is not null and _c > 0")
    # One row per (replicate, cell, arm) from here on.
    arms = []
    for a in (1, 0):
        c, s, q = (F.sum(F.when(F.col("_t") == a, F.col(x))) for x in ("_c", "_s", "_q"))
        arms += [F.coalesce(c, F.lit(0)).alias(f"n{a}"), (s / c + F.lit(size["centre"] or 0.0)).alias(f"ybar{a}"), F.greatest(q - s * s / c, F.lit(0.0)).alias(f"m2_{a}")]
    return aipw_from_moments(cut_lineage(found.groupBy(r_col, *names).agg(*arms)), names, [r_col], clip)


def placebo_regression(df: DataFrame, t: str, y: str, xs: Sequence[str], key: Sequence[str], R: int = 1000,
                       permute: str = "treatment", seed: int = 42, r_col: str = "r", hash_method: str = "md5") -> DataFrame:
    """#94 / #95 with linear adjustment: per replicate the coefficient of T in y on T + X, se from sigma^2 (Z'Z)^-1.

    Permuting the treatment leaves the cross products of covariates and outcome
    as they are.  So a replicate needs the sums of X and y over its treated
    rows only, which one pass gives (``by_draw``).
    Permuting the outcome pairs rows anew; that takes a join by rank and one
    cross-product aggregation."""
    from .gram import gram_sums, unit_diagonal
    from .heterogeneity import effect_regression
    import pandas as pd
    xs, names = list(xs), [f"_x{i}" for i in range(len(list(xs)))]
    d = cut_lineage(df.where(all_present([t, y, *xs])).select(
        key_text(key).alias("_key"), F.col(t).cast("int").alias("_t"), F.col(y).cast("double").alias("_y"),
        *[F.col(x).cast("double").alias(n) for x, n in zip(xs, names)]))
    if permute == "outcome":
        moved = permute_within_replicates(d, ["_y"], ["_key"], R, seed, r_col, hash_method)
        return effect_regression(moved, "_t", "_y", names, [r_col])
    draws = Draws(seed, "_key", hash_method)
    fixed = gram_sums(d, "_y", names).first()
    size = d.agg(F.count(F.lit(1)).alias("n"), F.sum("_t").alias("n1")).first()
    n, n1, p = size["n"], int(size["n1"] or 0), len(xs) + 2
    if not 0 < n1 < n:
        raise ValueError("both arms need rows")
    sums = by_draw(d.drop("_t"), [n1], n, draws, R, r_col, {"_n1": F.lit(1), **{c: F.col(c) for c in (*names, "_y")}}).where("_slot = 0")
    q = len(xs) + 1
    xtx, xty, yty = np.array(fixed["xtx"]).reshape(q, q), np.array(fixed["xty"]), fixed["yty"]
    schema = StructType([d.sparkSession.range(1).select(F.col("id").alias(r_col)).schema[0],
                         *[StructField(c, DoubleType()) for c in ("n", "n_treated", "ate", "se")]])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                inside = np.array([r[1], *r[2:2 + len(xs)]])                # T'[1, X]
                A = np.zeros((p, p))
                A[:1, :1], A[0, 2:], A[2:, 0], A[2:, 2:] = xtx[0, 0], xtx[0, 1:], xtx[1:, 0], xtx[1:, 1:]
                A[1, 1] = A[0, 1] = A[1, 0] = inside[0]
                A[1, 2:] = A[2:, 1] = inside[1:]
                b = np.array([xty[0], r[2 + len(xs)], *xty[1:]])
                scaled, scale = unit_diagonal(A)
                inverse = np.linalg.pinv(scaled, rcond=1e-10, hermitian=True) / np.outer(scale, scale)
                coef = inverse @ b
                rss = max(yty - 2 * coef @ b + coef @ A @ coef, 0.0)
                out.append((r[0], float(n), float(r[1]), coef[1], math.sqrt(rss / (n - p) * inverse[1, 1]) if n > p else None))
            yield pd.DataFrame(out, columns=schema.names)

    res = sums.select(r_col, "_n1", *names, "_y").mapInPandas(solve, schema)
    return finish_estimate(res.withColumns({"n": F.col("n").cast("long"), "n_treated": F.col("n_treated").cast("long"),
                                            "treated_pct": F.lit(100.0) * F.col("n_treated") / F.col("n")}), [r_col])


def placebo_summary(real: DataFrame, treat_reps: DataFrame | None, outcome_reps: DataFrame | None) -> DataFrame:
    """#96: rows real / treatment / outcome with ate (mean over replicates),
    spread (population std), replicate count, near-zero test
    (|mean| < 2 std), ratio real / placebo and the se of the mean."""
    real_row = real.select(F.lit("real").alias("test"), F.col("ate"), F.col("se").alias("spread"),
                           F.lit(1).cast("long").alias("n_iter"))
    parts = [real_row]
    for name, reps in (("random_treatment", treat_reps), ("permuted_outcome", outcome_reps)):
        if reps is not None:
            parts.append(reps.agg(F.lit(name).alias("test"), F.avg("ate").alias("ate"),
                                  F.stddev_pop("ate").alias("spread"), F.count(F.lit(1)).alias("n_iter")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    real_ate = real.select(F.col("ate").alias("_real"))
    out = with_one_row(out, real_ate)
    return (out.withColumn("near_zero", F.when(F.col("test") != "real",
                                               (F.abs("ate") < 2 * F.col("spread")).cast("int")))
            .withColumn("ratio", F.when(F.col("test") != "real",
                                        F.when(F.col("ate") != 0, F.col("_real") / F.col("ate"))
                                        .otherwise(F.lit(float("inf")))))
            .withColumn("se_of_mean", F.col("spread") / F.sqrt(F.col("n_iter"))).drop("_real"))


# ------------------------------------------------------------ cross-fit
def crossfit_cell_aipw(df: DataFrame, t: str, y: str, cells: Sequence[str], key: Sequence[str],
                       by: Sequence[str] = (), k: int = 5, seed: int = 42, clip=(0.01, 0.99),
                       min_arm: int = 10) -> DataFrame:
    """#89 with the cell learner (#86, #87): K folds from a hash; for test
    fold f the nuisances come from the other folds (cell sums of all folds
    minus those of fold f, so one aggregation serves every fold).  An arm
    with at most ``min_arm`` training rows falls back to its training mean
    (0 when empty).  ate = mean score, se = sqrt(var_samp / n).  The score
    is affine in Y within (fold, cell, arm), so its mean and sample variance
    come from that same aggregation: the rows are read once, never joined
    back."""
    by = list(by)
    T, Y = F.col(t).cast("double"), F.col(y).cast("double")
    # Only rows with treatment and outcome count, in the sums and in the counts alike.
    d = fold_assign(df.where(F.col(t).isNotNull() & F.col(y).isNotNull()), k, seed, key, "_fold")
    # Covariates may have any name: they become keys of their own.
    d = d.select(*by, "_fold", T.alias("_t"), Y.alias("_y"), *[F.col(x).alias(f"_cell{i}") for i, x in enumerate(cells)])
    cells = [f"_cell{i}" for i in range(len(list(cells)))]
    zero = F.lit(0.0)
    y1, y0 = F.when(F.col("_t") == 1, F.col("_y")), F.when(F.col("_t") == 0, F.col("_y"))
    sums = [F.count(F.lit(1)).alias("c"), F.sum("_t").alias("n1"), F.coalesce(F.sum(y1), zero).alias("s1"),
            F.coalesce(F.sum(y0), zero).alias("s0"),
            # test-fold moments per arm (the score is affine in Y per arm)
            F.avg(y1).alias("ybar1"), (F.var_pop(y1) * F.count(y1)).alias("m2_1"),
            F.avg(y0).alias("ybar0"), (F.var_pop(y0) * F.count(y0)).alias("m2_0")]
    # One row per (group, fold, cell): checkpointed, it feeds four small
    # aggregations without rescanning the input.
    cf = cut_lineage(d.groupBy(*by, "_fold", *cells).agg(*sums))
    ct = cf.groupBy(*by, *cells).agg(*[F.sum(c).alias(f"{c}_all") for c in ("c", "n1", "s1", "s0")])
    gf = cf.groupBy(*by, "_fold").agg(*[F.sum(c).alias(f"g{c}") for c in ("c", "n1", "s1", "s0")])
    gt = cf.groupBy(*by).agg(*[F.sum(c).alias(f"g{c}_all") for c in ("c", "n1", "s1", "s0")])
    tab = join_on_keys(join_on_keys(cf, ct, by + cells, "inner"), join_on_keys(gf, gt, by, "inner"),
                       by + ["_fold"], "inner")

    def tr(c):          # training (other folds) sums of the cell
        return F.col(f"{c}_all") - F.col(c)

    def gtr(c):         # training sums of the group
        return F.col(f"g{c}_all") - F.col(f"g{c}")

    n1c, n0c = tr("n1"), tr("c") - tr("n1")
    N1, N0 = gtr("n1"), gtr("c") - gtr("n1")
    g_mu1 = F.when(N1 > 0, F.coalesce(gtr("s1"), F.lit(0.0)) / N1).otherwise(F.lit(0.0))
    g_mu0 = F.when(N0 > 0, F.coalesce(gtr("s0"), F.lit(0.0)) / N0).otherwise(F.lit(0.0))
    c_mu1 = F.when(n1c > 0, F.coalesce(tr("s1"), F.lit(0.0)) / n1c).otherwise(g_mu1)
    c_mu0 = F.when(n0c > 0, F.coalesce(tr("s0"), F.lit(0.0)) / n0c).otherwise(g_mu0)
    ps_raw = F.when(tr("c") > 0, tr("n1") / tr("c")).otherwise(F.when(gtr("c") > 0, gtr("n1") / gtr("c")))
    ps = F.least(F.greatest(ps_raw, F.lit(clip[0])), F.lit(clip[1])) if clip else ps_raw
    mu1 = F.when(N1 > min_arm, c_mu1).otherwise(g_mu1)
    mu0 = F.when(N0 > min_arm, c_mu0).otherwise(g_mu0)
    nuis = tab.select(*by, F.col("n1").cast("long").alias("n1"),
                      (F.col("c") - F.col("n1")).cast("long").alias("n0"), "ybar1", "m2_1", "ybar0", "m2_0",
                      ps.alias("ps"), mu1.alias("mu1"), mu0.alias("mu0"))
    # psi = mu1 - mu0 + T/ps (Y - mu1) - (1-T)/(1-ps) (Y - mu0): affine in Y
    # per (fold, cell, arm); mean and sample variance from the moments.
    p_, m1, m0 = F.col("ps"), F.col("mu1"), F.col("mu0")
    nuis = nuis.withColumns({
        "beta1": F.try_divide(F.lit(1.0), p_), "alpha1": m1 - m0 - F.try_divide(m1, p_),
        "beta0": F.try_divide(F.lit(-1.0), F.lit(1.0) - p_),
        "alpha0": m1 - m0 + F.try_divide(m0, F.lit(1.0) - p_)})
    return finish_estimate(affine_score_stats(nuis, by, ddof=1), by)


def crossfit_aipw(df: DataFrame, t: str, y: str, xs: Sequence[str], key: Sequence[str], by: Sequence[str] = (), k: int = 5, seed: int = 42,
                  learner: str = "cell", clip=(0.01, 0.99), min_arm: int = 10, other_arm: str = "folds", **params) -> DataFrame:
    """#89 with any learner (#86): folds from a hash, nuisances from the other
    folds (``learners.crossfit_nuisances``), mean score, se = sqrt(var_samp / n).
    ``cell`` needs no second scan."""
    if learner == "cell":
        return crossfit_cell_aipw(df, t, y, xs, key, by, k, seed, clip, min_arm)
    d = fold_assign(df.where(all_present([t, y, *xs])), k, seed, key, "_fold")
    d = crossfit_nuisances(d, t, y, xs, learner, "_fold", k, by, clip, min_arm, other_arm, seed, **params)
    return summarize_scores(d.withColumn("psi", aipw_score(t, y)), "psi", by, t, 1, y=y)


# -------------------------------------------------------------- bootstrap
def poisson1_cdf() -> list[float]:
    """P(K <= k) of Poisson(1) from k = 0 until the sum no longer grows in double precision."""
    out, total, k = [], 0.0, 0
    while not out or total + math.exp(-1.0) / math.factorial(k) > total:
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
        k += 1
    return out


DRAWS_PER_HASH = 4  # of 32 bits each, from the 128 bits of md5


def bootstrap_sums(df: DataFrame, values: dict[str, Column], B: int, seed: int, key: Sequence[str], by: Sequence[str] = (),
                   b_col: str = "b", own_hash: bool = False) -> DataFrame:
    """#93b: ``by``, b = 1..B and per value its sum with Poisson(1) weights of replicate b.

    No row is copied.  A row's B weights are a vector cut from a few hashes,
    four weights from md5(seed:block:key), or with ``own_hash`` one of 52 bits
    from md5(seed:b:key) for each b; a task multiplies the weights of its rows
    with their values and sends B sums per group."""
    by, names = list(by), list(values)
    blocks = range(1, B + 1) if own_hash else range(-(-B // DRAWS_PER_HASH))
    hashes = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), F.col("_key"))) for i in blocks]
    if own_hash:
        hashes = [F.substring(h, 1, 16) for h in hashes]
    rows = df.select(*by, key_text(key).alias("_key"), *[c.cast("double").alias(n) for n, c in values.items()])
    rows = rows.select(*by, F.concat(*hashes).alias("_bits"), *names)
    schema = StructType([*rows.select(*by).schema.fields, StructField(b_col, LongType()), *[StructField(n, DoubleType()) for n in names]])
    cdf = np.array(poisson1_cdf())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            data = np.nan_to_num(matrix_of(batch, names))
            bits = batch.column("_bits")
            for key, at in groups_of(batch, by):
                for start in range(0, len(at), max(1, MATRIX_CELLS // B)):
                    part = at[start:start + max(1, MATRIX_CELLS // B)]
                    raw = np.frombuffer(bytes.fromhex("".join(bits.take(pa.array(part)).to_pylist())), ">u8" if own_hash else ">u4").reshape(len(part), -1)[:, :B]
                    draw = ((raw >> 12) + 0.5) / float(HASH_RANGE) if own_hash else (raw + 0.5) / float(1 << 32)
                    weight = np.searchsorted(cdf, draw, side="right").astype(np.float64)
                    total[key] = total.get(key, 0) + weight.T @ data[part]
            if len(total) * B * len(names) > PACKED_CELLS:
                yield table(total, types)
                total = {}
        if total:
            yield table(total, types)

    def table(total: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        row = pa.array(np.repeat(np.arange(len(total)), B))
        columns = [pa.array([k[i] for k in total], types[i]).take(row) for i in range(len(by))]
        sums = np.concatenate(list(total.values()))
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(1, B + 1), len(total))), *(pa.array(c) for c in sums.T.copy())], schema.names)

    return rows.mapInArrow(run, schema).groupBy(*by, b_col).agg(*[F.sum(n).alias(n) for n in names])


# ----------------------------------------------------------- amputation
SCORE_BRACKETS = 1000


def ampute(df: DataFrame, cols: Sequence[str], rate: float, mechanism: str = "MAR", key: Sequence[str] = (),
           seed: int = 0, y: str | None = None, x0: str | None = None, frac_lo: float = 0.3,
           frac_hi: float = 0.7) -> DataFrame:
    """#101: blank out values of a real table to test imputers.

    MAR: row chance logit(-1 + .3 Yz + .3 X0z); exactly round(rate n) rows
    are chosen (ranking rows by u/p, a weighted draw without replacement).  A
    chosen row draws a number of columns, uniform from int(frac_lo k) to
    int(frac_hi k) of the k columns but ``x0``, and so many of them are
    blanked, those first by a hash of the row's key and the column; ``x0`` is
    never blanked.
    MNAR: each cell but those of ``x0`` blanked with chance
    logit(a0 + .5 x), a0 = -ln((1-r)/r)."""
    cols = list(cols)
    key = list(key)
    if mechanism.upper() == "MNAR":
        a0 = -math.log((1 - rate) / rate)
        out = {}
        for j, c in enumerate(cols):
            if c == x0:
                continue
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a0) + F.lit(0.5) * F.col(c))))
            u = hash_uniform(F.lit(seed), F.lit(f"cell{j}"), *[F.col(k) for k in key])
            out[c] = F.when(u < p, F.lit(None).cast("double")).otherwise(F.col(c))
        return df.withColumns(out)
    st = df.agg(F.avg(y).alias("_ym"), F.stddev_samp(y).alias("_ys"), F.avg(x0).alias("_xm"),
                F.stddev_samp(x0).alias("_xs"), F.count(F.lit(1)).alias("_n"))
    d = with_one_row(df, st)
    z = (F.lit(-1.0) + F.lit(0.3) * (F.col(y) - F.col("_ym")) / F.col("_ys")
         + F.lit(0.3) * (F.col(x0) - F.col("_xm")) / F.col("_xs"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    u = hash_uniform(F.lit(seed), F.lit("row"), *[F.col(k) for k in key])
    d = d.withColumn("_score", F.ln(u) / p)            # larger is likelier (exponential race)
    # The cut is the round(rate n)-th largest score: brackets of equal counts
    # (sketched edges) are counted, and only the bracket that holds the cut
    # is ranked row by row.
    edges = d.agg(F.percentile_approx(F.col("_score"), [i / SCORE_BRACKETS for i in range(1, SCORE_BRACKETS)], 10_000).alias("_edges"))
    d = with_one_row(d, edges)
    bracket = F.lit(SCORE_BRACKETS) - F.size(F.filter("_edges", lambda e: e < F.col("_score")))
    d = cut_lineage(d.withColumn("_br", bracket.cast("long")).drop("_edges"))
    sizes = d.groupBy("_br").agg(F.count(F.lit(1)).alias("_size"))
    ahead = F.coalesce(F.sum("_size").over(Window.orderBy("_br").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_ahead", ahead)
    take = F.round(F.lit(float(rate)) * F.col("_n"))
    d = join_on_keys(d, sizes, ["_br"], "inner")
    split = (F.col("_ahead") < take) & (F.col("_ahead") + F.col("_size") > take)
    order = [F.col("_score").desc(), *[F.col(k) for k in key]]
    inside = d.where(split).withColumn("_rk", F.col("_ahead") + F.row_number().over(Window.partitionBy("_br").orderBy(*order)))
    ranked = d.where(~split).withColumn("_rk", F.when(F.col("_ahead") < take, F.lit(0)).otherwise(F.col("_n") + 1)).unionByName(inside)
    chosen = F.col("_rk") <= take
    free = [(j, c) for j, c in enumerate(cols) if c != x0]
    low, high = int(frac_lo * len(free)), int(frac_hi * len(free))
    row_key = [F.col(k) for k in key]
    many = F.lit(low) + F.floor(hash_uniform(F.lit(seed), F.lit("count"), *row_key) * F.lit(high - low + 1)).cast("int")
    hashes = F.array_sort(F.array(*[F.struct(hash_int(F.lit(seed), F.lit(f"col{j}"), *row_key).alias("h"), F.lit(j).alias("j")) for j, _ in free]))
    ranked = ranked.withColumn("_blank", F.when(chosen, F.transform(F.slice(hashes, F.lit(1), many), lambda x: x["j"])))
    out = {c: F.when(chosen & F.array_contains("_blank", F.lit(j)), F.lit(None).cast("double")).otherwise(F.col(c)) for j, c in free}
    return ranked.withColumns(out).drop("_ym", "_ys", "_xm", "_xs", "_n", "_score", "_rk", "_br", "_size", "_ahead", "_blank")
