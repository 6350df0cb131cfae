"""Statistics over customers (T01-T12): breadth buckets, Welch's t-test,
Pearson correlation, chi-square test of independence, and the validation
summaries of the health score (histogram, tier counts and means, box-plot
statistics, churn alignment).

Every statistic is built from aggregates that Spark computes in one pass with
map-side combining (counts and *exact decimal* sums), so results do not
depend on partitioning or task order. Only the final p-value of the one
result row goes through a (vectorised) Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions.numeric import safe_div
from keelson.functions.special import chi2_pvalue_udf, t_pvalue_udf
from keelson.operators.health import TIER_ORDER
from keelson.operators.prep import materialize
from keelson.sources.work import fresh

ALPHA = 0.05


def _d(c: Column) -> Column:
    return c.cast("double")


# ------------------------------------------------------------ breadth

def breadth(usage: DataFrame, cust: DataFrame) -> DataFrame:
    """Distinct features per customer, joined (inner) to the customer row."""
    fc = usage.groupBy("customer_id").agg(F.count_distinct("feature").alias("feature_count"))
    return fc.join(cust, "customer_id").select(
        "customer_id", "feature_count", "plan", "company_size", "mrr", "signup_date")


def breadth_bucket(df: DataFrame, lo: int = 3, mid: int = 6, col: str = "feature_count",
                   out: str = "usage_bucket") -> DataFrame:
    """``<= lo`` Low, ``<= mid`` Medium, else High (a column expression,
    not a per-row Python function)."""
    c = F.col(col)
    return df.withColumn(out, F.when(c <= lo, "Low").when(c <= mid, "Medium").otherwise("High"))


def mrr_by_bucket(df: DataFrame, bucket: str = "usage_bucket", value: str = "mrr") -> DataFrame:
    """Mean MRR per bucket (unrounded, from the exact sum)."""
    return df.groupBy(bucket).agg(
        safe_div(F.sum(F.col(value).cast("decimal(12,2)")), F.count(value)).alias("mean_mrr"))


# ------------------------------------------------------------ tests

HUNDREDTHS = 100.0


def _whole(c: Column, digits: int) -> Column:
    """A value with two decimals as a whole number of hundredths."""
    return (c.cast(f"decimal({digits},2)") * 100).cast(f"decimal({digits},0)")


def _center(n: Column, s: Column, digits: int) -> tuple[Column, Column]:
    """A whole number next to the mean of ``n`` whole numbers with sum ``s``, and
    the sum of the deviations from it (at most n / 2 either way), exact."""
    q = F.round(F.try_divide(s, n)).cast(f"decimal({digits},0)")
    return q, (s - q * n).cast("decimal(28,0)")


def _moments(df: DataFrame, value: str) -> list[Column]:
    x = _whole(F.col(value), 12)
    return [F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2")]


def _var(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance from count, sum and sum of squares (of hundredths).

    The squares are moved to a whole number next to the mean while they are
    exact decimals; what is left to subtract as doubles is at most half of
    them, so values far from zero with a small spread lose nothing."""
    count = n.cast("decimal(19,0)")
    q, r = _center(count, s1, 13)
    around = s2 - q * q * count - 2 * q * r
    return F.try_divide((_d(around) - F.try_divide(_d(r) * _d(r), _d(n))) / HUNDREDTHS ** 2, _d(n) - 1)


def welch_stats(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """T04 without the p-value: sizes, means, variances, t and Welch dof.

    Rows with a NULL value are ignored (the reference's pandas input would
    propagate NaN instead).
    """
    g = (df.filter(F.col(group).isin(a, b))
         .groupBy(group).agg(*_moments(df, value)))
    row = g.agg(*[F.max(F.when(F.col(group) == lab, F.col(c))).alias(f"{c}_{k}")
                  for lab, k in ((a, "a"), (b, "b")) for c in ("n", "s1", "s2")])
    va = _var(F.col("n_a"), F.col("s1_a"), F.col("s2_a"))
    vb = _var(F.col("n_b"), F.col("s1_b"), F.col("s2_b"))
    ma = F.try_divide(_d(F.col("s1_a")), HUNDREDTHS * _d(F.col("n_a")))
    mb = F.try_divide(_d(F.col("s1_b")), HUNDREDTHS * _d(F.col("n_b")))
    # the difference of the means over their common denominator, exact until it is divided
    apart = F.col("s1_a") * F.col("n_b").cast("decimal(19,0)") - F.col("s1_b") * F.col("n_a").cast("decimal(19,0)")
    apart = F.try_divide(_d(apart), HUNDREDTHS * _d(F.col("n_a")) * _d(F.col("n_b")))
    # a group without rows has size 0 and no mean or variance
    row = row.select(F.coalesce(F.col("n_a"), F.lit(0).cast("long")).alias("n_a"),
                     F.coalesce(F.col("n_b"), F.lit(0).cast("long")).alias("n_b"),
                     ma.alias("mean_a"), mb.alias("mean_b"), va.alias("var_a"), vb.alias("var_b"), apart.alias("_apart"))
    qa = F.try_divide(F.col("var_a"), _d(F.col("n_a")))
    qb = F.try_divide(F.col("var_b"), _d(F.col("n_b")))
    se2 = qa + qb
    t = F.try_divide(F.col("_apart"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.try_divide(qa * qa, _d(F.col("n_a")) - 1)
                       + F.try_divide(qb * qb, _d(F.col("n_b")) - 1))
    return row.select("*", t.alias("t_stat"), dof.alias("dof")).drop("_apart")


def welch_t(df: DataFrame, group: str = "usage_bucket", a: str = "High", b: str = "Medium",
            value: str = "mrr", alpha: float = ALPHA) -> DataFrame:
    """Welch's two-sample t-test of ``value`` between groups ``a`` and ``b``."""
    s = welch_stats(df, group, a, b, value)
    p = t_pvalue_udf(F.col("t_stat"), F.col("dof"))
    return s.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def pearson(df: DataFrame, x: str = "feature_count", y: str = "mrr") -> DataFrame:
    """Pearson correlation (NULL, not an error, for zero variance).

    The sums of squares and products are moved next to the means as exact
    decimals before they become doubles (see ``_var``)."""
    xd, yd = _whole(F.col(x), 18), _whole(F.col(y), 18)
    pair = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = pair.agg(F.count(F.lit(1)).alias("n"), F.sum(xd).alias("sx"), F.sum(yd).alias("sy"),
                 F.sum(xd * xd).alias("sxx"), F.sum(yd * yd).alias("syy"), F.sum(xd * yd).alias("sxy"))
    n, count = _d(F.col("n")), F.col("n").cast("decimal(19,0)")
    (qx, rx), (qy, ry) = _center(count, F.col("sx"), 19), _center(count, F.col("sy"), 19)
    num = _d(F.col("sxy") - qx * ry - qy * F.col("sx")) - F.try_divide(_d(rx) * _d(ry), n)
    dx = _d(F.col("sxx") - qx * rx - qx * F.col("sx")) - F.try_divide(_d(rx) * _d(rx), n)
    dy = _d(F.col("syy") - qy * ry - qy * F.col("sy")) - F.try_divide(_d(ry) * _d(ry), n)
    r = F.try_divide(num, F.sqrt(dx) * F.sqrt(dy))
    return m.select("n", F.when((dx > 0) & (dy > 0), r).alias("corr"))


def contingency(df: DataFrame, a: str = "usage_bucket", b: str = "mrr") -> DataFrame:
    """Contingency table in long form (one row per non-empty cell).

    A wide table over a continuous column would have one column per distinct
    value; the long form scales with the number of non-empty cells.
    """
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))


def chi_square_stats(df: DataFrame, a: str = "usage_bucket", b: str = "mrr") -> DataFrame:
    """T07 without the p-value: chi2 (Yates-corrected when dof = 1), dof, N.

    ``chi2 = N * (sum O^2 / (R * C) - 1)`` needs only the non-empty cells, and
    ``sum O^2 / (R_i * C_j) = sum_i (1 / R_i) * sum_j O_ij^2 / C_j``. One chain
    over the input: cells, columns with their total and cells, cells again,
    one row per level of ``a`` (the crosstab's index, here three buckets)
    holding ``R_i`` and ``sum_j O_ij^2 / C_j`` plus each column counted once,
    then one global row. For a 2x2 table every cell has the same
    ``|O - E|``, so the corrected statistic is
    ``max(|O - E| - 0.5, 0)^2 * N * sum(1/R) * sum(1/C)`` with ``|O - E|``
    taken from any observed cell.
    """
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    o, c_ = _d(F.col("observed")), _d(F.col("C"))
    first = F.col(a) == F.col("_first")
    # a column's cells, at most one per level of ``a``, meet in its row
    columns = contingency(d, a, b).groupBy(b).agg(
        F.sum("observed").alias("C"), F.min(a).alias("_first"), F.collect_list(F.struct(a, "observed")).alias("_cells"))
    per_level = (columns.select(b, "C", "_first", F.inline("_cells")).groupBy(a).agg(
        F.sum("observed").alias("R"),
        F.sum(o * o / c_).alias("S"),
        F.sum(F.when(first, 1.0 / c_).otherwise(0.0)).alias("inv_c"),
        F.sum(F.when(first, 1).otherwise(0)).alias("n_cols"),
        F.max_by(F.struct(o.alias("o"), c_.alias("c")), F.col(b)).alias("cell")))
    r_ = _d(F.col("R"))
    tot = per_level.agg(
        F.sum("R").alias("n"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_cols").alias("n_cols"),
        F.sum(F.col("S") / r_).alias("q"), F.sum(1.0 / r_).alias("inv_r"), F.sum("inv_c").alias("inv_c"),
        F.min_by(F.struct(r_.alias("r"), F.col("cell.o").alias("o"), F.col("cell.c").alias("c")), F.col(a))
        .alias("one"))
    n = _d(F.col("n"))
    dev = F.abs(F.col("one.o") - F.col("one.r") * F.col("one.c") / n)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = n * (F.col("q") - 1.0)
    yates_dev = F.greatest(dev - 0.5, F.lit(0.0))
    yates = yates_dev * yates_dev * n * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(plain)
    return tot.select("n", "n_rows", F.col("n_cols").cast("long").alias("n_cols"),
                      dof.cast("long").alias("dof"), chi2.alias("chi2"))


def chi_square(df: DataFrame, a: str = "usage_bucket", b: str = "mrr", alpha: float = ALPHA) -> DataFrame:
    """Chi-square test of independence of ``a`` and ``b``."""
    s = chi_square_stats(df, a, b)
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_pvalue_udf(F.col("chi2"), _d(F.col("dof"))))
    return s.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


# ------------------------------------------------------------ score validation

def histogram(df: DataFrame, col: str = "health_score", bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins from min to max, last bin closed.

    Bin of x: ``min(floor((x - lo) * (bins / (hi - lo))), bins - 1)``; when
    every value is equal the range is widened by 0.5 on each side. Every bin
    is returned, empty ones with 0 (the bin list is generated from the
    ``bins`` parameter, not from data). Two passes: a one-row min/max
    aggregate (a scalar subquery) and the binning aggregate.
    """
    x = F.col(col).cast("double")
    rng = df.agg(F.struct(F.min(x).alias("mn"), F.max(x).alias("mx")).alias("r")).scalar()

    def with_edges(frame: DataFrame) -> DataFrame:
        same = F.col("_r.mn") == F.col("_r.mx")
        return frame.withColumn("_r", rng).withColumns({
            "_lo": F.when(same, F.col("_r.mn") - 0.5).otherwise(F.col("_r.mn")),
            "_hi": F.when(same, F.col("_r.mx") + 0.5).otherwise(F.col("_r.mx"))})

    data = with_edges(df.select(x.alias("_x")).filter(F.col("_x").isNotNull()))
    idx = F.least(F.floor((F.col("_x") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))),
                  F.lit(bins - 1)).cast("int")
    counts = data.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = with_edges(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count")))


def tier_counts(scores: DataFrame) -> DataFrame:
    """Customers per tier, largest first."""
    return (scores.groupBy("health_tier").agg(F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("customers").desc(), F.col("health_tier")))


def _tier_rank(c: Column) -> Column:
    e = None
    for i, t in enumerate(TIER_ORDER, start=1):
        e = F.when(c == t, i) if e is None else e.when(c == t, i)
    return e


def tier_means(scores: DataFrame) -> DataFrame:
    """Mean score per tier and whether the means rise with the tier order."""
    m = (scores.groupBy("health_tier")
         .agg(F.count(F.lit(1)).alias("customers"),
              safe_div(F.sum(F.col("health_score").cast("decimal(12,2)")), F.count("health_score"))
              .alias("mean_score"))
         .withColumn("tier_rank", _tier_rank(F.col("health_tier"))))
    # the tier means in tier order as one array (tiers without customers are
    # skipped, not compared); rising when each mean exceeds the one before
    by_rank = m.agg(*[F.max(F.when(F.col("tier_rank") == i, F.col("mean_score"))).alias(f"r{i}")
                      for i in range(1, len(TIER_ORDER) + 1)])
    means = F.filter(F.array(*[F.col(f"r{i}") for i in range(1, len(TIER_ORDER) + 1)]), lambda x: x.isNotNull())
    rising = F.forall(F.sequence(F.lit(2), F.size(means)),
                      lambda i: F.element_at(means, i) > F.element_at(means, i - 1))
    mono = by_rank.select(F.when(F.size(means) < 2, F.lit(True)).otherwise(rising)).scalar()
    return m.select("health_tier", "tier_rank", "customers", "mean_score", mono.alias("monotonic"))


QUARTILES = (0.25, 0.5, 0.75)


def counted_ranges(df: DataFrame, group: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """The distinct values of each group with their counts, in ranges of (group, value),
    and for each range and group the rows before it, in it, and in the whole group.

    ``_v`` value, ``_c`` count, ``_r`` range; ``_before``, ``_in``, ``n``. The ranges are stored, so
    that everything after is based on the same ones. A range is a shuffle partition:
    however many values a group has, they are spread over the ranges.
    """
    values = df.filter(value.isNotNull() & F.col(group).isNotNull()).groupBy(group, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranged = values.repartitionByRange(group, "_v").withColumn("_r", F.spark_partition_id())
    ranged = materialize(ranged, fresh(df.sparkSession, "ranges"))
    of = Window.partitionBy(group)
    earlier = of.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    # at most a row per group and range
    starts = ranged.groupBy(group, "_r").agg(F.sum("_c").alias("_in")).withColumns({
        "_before": F.coalesce(F.sum("_in").over(earlier), F.lit(0)), "n": F.sum("_in").over(of)})
    return ranged, starts


def box_stats(df: DataFrame, group: str = "health_tier", col: str = "health_score",
              whis: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation), IQR, whiskers and outlier count.

    Exact selection by rank: the values of each group are counted and cut into ranges
    (``counted_ranges``). The ranks a quartile lies between name one or
    two ranges per group; only there counts are run up to the value at the rank. No
    task holds the values of a group. Whiskers, the most extreme values within ``whis * IQR`` of the
    box, come from the counted values and the fences, a row per group.
    """
    ranged, starts = counted_ranges(df, group, F.col(col).cast("double"))
    position = lambda q: (F.col("n") - 1) * F.lit(q)
    wanted = F.array(*[F.struct(F.lit(2 * k + up).alias("k"), (F.ceil if up else F.floor)(position(q)).alias("rank"))
                       for k, q in enumerate(QUARTILES) for up in (0, 1)])
    targets = (starts.select(group, "_r", "_before", "_in", "n", F.explode(wanted).alias("_t"))
               .filter((F.col("_t.rank") >= F.col("_before")) & (F.col("_t.rank") < F.col("_before") + F.col("_in"))))
    inside = ranged.join(targets.select(group, "_r").distinct(), [group, "_r"], "left_semi")
    upto = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(group, "_r").orderBy("_v")))
    place = F.col("_t.rank") - F.col("_before")
    hits = upto.join(targets, [group, "_r"]).filter((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c")))
    ends = hits.groupBy(group).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_t.k") == k, F.col("_v"))).alias(f"_q{k}")
                                                         for k in range(2 * len(QUARTILES))])

    def quartile(k: int, q: float) -> Column:
        part = position(q) - F.floor(position(q))
        return F.col(f"_q{2 * k}") * (1 - part) + F.col(f"_q{2 * k + 1}") * part

    q = ends.select(group, "n", *[quartile(k, p).alias(name) for k, (p, name) in enumerate(zip(QUARTILES, ("q1", "median", "q3")))])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - whis * F.col("iqr"), F.col("q3") + whis * F.col("iqr")
    w = (ranged.join(q.select(group, low.alias("_lo"), high.alias("_hi")), group)
         .groupBy(group)
         .agg(F.min(F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))).alias("whisker_lo"),
              F.max(F.when(F.col("_v") <= F.col("_hi"), F.col("_v"))).alias("whisker_hi"),
              F.sum(F.when((F.col("_v") < F.col("_lo")) | (F.col("_v") > F.col("_hi")), F.col("_c")).otherwise(0)).alias("outliers")))
    return q.join(w, group)


def churn_alignment(scores: DataFrame, subs: DataFrame, event_type: str = "subscription_cancel") -> DataFrame:
    """Mean health score of customers with a ``event_type`` event vs the rest."""
    churned = (subs.filter(F.col("event_type") == event_type).select("customer_id").distinct()
               .withColumn("_c", F.lit(True)))
    j = scores.join(churned, "customer_id", "left")
    flag = F.coalesce(F.col("_c"), F.lit(False))
    return (j.groupBy(flag.alias("churned"))
            .agg(F.count(F.lit(1)).alias("customers"),
                 safe_div(F.sum(F.col("health_score").cast("decimal(12,2)")), F.count("health_score"))
                 .alias("mean_score")))
