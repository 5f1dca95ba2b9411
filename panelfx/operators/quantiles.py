"""Exact, interpolated percentiles that scale.

The built-in exact ``percentile`` merges every distinct value of a group in
one final task.  Here a sketch only brackets each percentile.  A row falls
between two brackets or into one, which two counts over the few bracket ends
tell; the rows between are counted, those inside per distinct value (both
map-side combined), and a window over these counts picks the exact order
statistics.  A value that a third of the rows share is one counted value.

A bracket holds some 4 n / ACCURACY rows.  While that is more than ``HELD``,
brackets are narrowed: their rows are counted in ``PARTS`` parts of equal width
and the parts that hold the wanted ranks become the bracket.  So the window
sorts at most about ``HELD`` distinct values per bracket, but for values that
lie closer than doubles can be parted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Rank error of the sketch is at most n / ACCURACY; brackets are twice that wide on either side.
ACCURACY = 10_000
HELD = 1_000_000
PARTS = 64
NARROWINGS = 400  # more than any range of doubles takes


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``by`` and, per column, an array of its percentiles.

    Linear interpolation between the order statistics floor((n-1)p) and the
    next one, missing values left out.  A group without any value of a column
    gets NULL for that array; a NULL group key is a group of its own."""
    from .learners import join_on_keys
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    named = [F.struct(F.lit(c).alias("_qc"), F.col(c).cast("double").alias("_qv")) for c in cols]
    long = df.select(*by, F.explode(F.array(*named)).alias("_q")).select(*by, "_q.*").where("_qv is not null")
    keys = [*by, "_qc"]
    slack = 2.0 / ACCURACY
    rising = sorted(set(probs))
    low = [max(0.0, p - slack) for p in rising]
    high = [min(1.0, p + slack) for p in rising]
    bracket = cut_lineage(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qn"),
                                                  F.percentile_approx("_qv", low, ACCURACY).alias("_qlow"),
                                                  F.percentile_approx("_qv", high, ACCURACY).alias("_qhigh")))
    # Eight decimals keep an integer rank an integer after the product.
    places = F.array(*[F.round((F.col("_qn") - 1) * F.lit(p), 8) for p in rising])
    bracket = bracket.withColumn("_qat", places)
    largest = bracket.agg(F.max("_qn")).first()[0] or 0
    if 2 * largest * slack > HELD:
        bracket = _narrowed(long, bracket, keys)
    v = F.col("_qv")
    below = F.size(F.filter("_qhigh", lambda e: e < v))  # brackets that end before the value
    near = join_on_keys(long, bracket.drop("_qat", "_qn"), keys, "inner").withColumn("_qj", below)
    inside = F.coalesce(F.get("_qlow", F.col("_qj")) <= v, F.lit(False))
    counted = (near.withColumn("_qs", inside).groupBy(*keys, "_qj", "_qs", F.when(inside, v).alias("_qx"))
               .agg(F.count(F.lit(1)).alias("_qm"), F.min("_qv").alias("_qmin"), F.max("_qv").alias("_qmax")))
    upto = F.sum("_qm").over(Window.partitionBy(*keys).orderBy("_qj", "_qs", "_qx").rowsBetween(Window.unboundedPreceding, 0))
    counted = join_on_keys(counted.withColumn("_qto", upto).withColumn("_qfrom", F.col("_qto") - F.col("_qm")), bracket.select(*keys, "_qat"), keys, "inner")
    # Wanted ranks (0-based): floor(at) and the next one, of every percentile.
    wanted = F.transform("_qat", lambda a, i: F.array(F.struct(i.alias("j"), F.lit(0).alias("side"), F.floor(a).alias("rank"), a.alias("at")),
                                                     F.struct(i.alias("j"), F.lit(1).alias("side"), (F.floor(a) + 1).alias("rank"), a.alias("at"))))
    held = F.filter(F.flatten(wanted), lambda w: (w["rank"] >= F.col("_qfrom")) & (w["rank"] < F.col("_qto")))
    # Between two brackets the rank can only be the first or the last value: the sketch may be off by one.
    rank = F.col("_qw.rank")
    value = F.when(F.col("_qs"), F.col("_qx")).when(rank == F.col("_qfrom"), F.col("_qmin")).when(rank == F.col("_qto") - 1, F.col("_qmax"))
    picked = counted.withColumn("_qw", F.explode(held)).groupBy(*keys, F.col("_qw.j").alias("_qi")).agg(
        F.max("_qw.at").alias("_qp"), F.max(F.when(F.col("_qw.side") == 0, value)).alias("_qa"), F.max(F.when(F.col("_qw.side") == 1, value)).alias("_qb"))
    share = F.col("_qp") - F.floor("_qp")
    final = F.when(share > 0, F.col("_qa") + (F.col("_qb") - F.col("_qa")) * share).otherwise(F.col("_qa"))
    arrays = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_qi", final.alias("p")))).alias("_qp"))
    order = [rising.index(p) for p in probs]
    wide = arrays.groupBy(*by).agg(*[
        F.max(F.when(F.col("_qc") == c, F.array(*[F.col("_qp")[i]["p"] for i in order]))).alias(c) for c in cols])
    every = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_qrows"))  # also the groups without any value
    return join_on_keys(every, wide, by, "left").drop("_qrows") if by else wide


def _narrowed(long: DataFrame, bracket: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets with at most HELD rows each, or of a single value."""
    from .learners import join_on_keys
    one = bracket.select(*keys, "_qn", F.posexplode(F.arrays_zip("_qlow", "_qhigh", "_qat")).alias("_qj", "_qe")).select(
        *keys, "_qn", "_qj", "_qe._qlow", "_qe._qhigh", "_qe._qat")
    for _ in range(NARROWINGS):
        rows = join_on_keys(long, one.select(*keys, "_qj", "_qlow", "_qhigh", "_qat"), keys, "inner").where("_qv <= _qhigh")
        width = (F.col("_qhigh") / PARTS) - (F.col("_qlow") / PARTS)
        part = F.when(F.col("_qv") < F.col("_qlow"), -1).otherwise(
            F.least(F.lit(PARTS - 1), F.floor(F.coalesce(F.try_divide(F.col("_qv") - F.col("_qlow"), width), F.lit(0.0)))).cast("int"))
        counts = rows.groupBy(*keys, "_qj", "_qat", part.alias("_qpart")).agg(F.count(F.lit(1)).alias("_qm"), F.min("_qv").alias("_ql"), F.max("_qv").alias("_qh"))
        upto = F.sum("_qm").over(Window.partitionBy(*keys, "_qj").orderBy("_qpart").rowsBetween(Window.unboundedPreceding, 0))
        held = counts.withColumn("_qto", upto).where((F.col("_qpart") >= 0) & (F.col("_qto") > F.floor("_qat")) & (F.col("_qto") - F.col("_qm") <= F.floor("_qat") + 1))
        found = held.groupBy(*keys, "_qj").agg(F.min("_ql").alias("_ql"), F.max("_qh").alias("_qh"), F.sum("_qm").alias("_qm"))
        after = join_on_keys(one, found, [*keys, "_qj"], "left")
        one = cut_lineage(after.select(*one.columns[:len(keys) + 2], F.coalesce("_ql", "_qlow").alias("_qlow"), F.coalesce("_qh", "_qhigh").alias("_qhigh"), "_qat",
                                       F.coalesce(F.col("_qm"), F.lit(0)).alias("_qm")))
        if one.where((F.col("_qm") > HELD) & (F.col("_qlow") < F.col("_qhigh"))).isEmpty():
            break
        one = one.drop("_qm")
    ends = [F.transform(F.array_sort(F.collect_list(F.struct("_qj", F.col(c).alias("x")))), lambda s: s["x"]).alias(c) for c in ("_qlow", "_qhigh", "_qat")]
    return cut_lineage(one.groupBy(*keys, "_qn").agg(*ends))
