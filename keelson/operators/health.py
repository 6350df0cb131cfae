"""Customer health score.

Five components per customer, summed, scaled by 100/80 and tiered:

- feature usage  ``min(30, 0.2 * sessions)``            (windowed in V1)
- login activity ``min(20, total duration / 5000)``      (windowed in V1)
- support        ``max(5, 20 - 0.5 * tickets + mean sentiment points)``
- payment        ``0`` if any event of the churn type, else ``15``
- new features   ``min(15, 5 * distinct listed features used)`` (never windowed)

A customer with no rows for a component scores 0 on it. The sum is not
clamped: scores above 100 are possible and kept.

Presets: ``V1`` (window Jan-Apr 2024, churn literal ``churn``) and ``V2``
(all time, ``subscription_cancel``), which the dashboard metrics use.

Scale: the combined score is one aggregation keyed by ``customer_id`` over
the union of the four (projected) inputs, i.e. a single shuffle with
map-side combining instead of five aggregations and five joins. Arithmetic is
exact decimal, so scores and tiers do not depend on summation order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import EXACT, capped_least, exact, floored_greatest, round_to
from keelson.operators.prep import as_rollup, in_window, window_flag

# Fixed values of the score definition.
NEW_FEATURES = ("ai_insights", "automation", "dashboard", "reporting")
FEATURE_CAP, FEATURE_PER_SESSION = 30, Decimal("0.2")
LOGIN_CAP, LOGIN_SECONDS_PER_POINT = 20, 5000
SUPPORT_BASE, SUPPORT_PER_TICKET, SUPPORT_FLOOR = 20, Decimal("0.5"), 5
SENTIMENT_POINTS = {"positive": 2, "neutral": 0}  # anything else (incl. NULL): -2
SENTIMENT_OTHER = -2
PAYMENT_OK, PAYMENT_CHURNED = 15, 0
NEW_FEATURE_CAP, NEW_FEATURE_POINTS = 15, 5
SCALE_DIVISOR = 80
TIERS = (("At Risk", 40), ("Needs Attention", 65), ("Healthy", 85))
TOP_TIER = "Champions"
TIER_ORDER = ("At Risk", "Needs Attention", "Healthy", "Champions")

V1 = {"win": ("2024-01-01", "2024-04-30"), "churn_type": "churn"}
V2 = {"win": None, "churn_type": "subscription_cancel"}


# ------------------------------------------------------------ expressions

def _feature_expr(sessions: Column) -> Column:
    return exact(capped_least(FEATURE_CAP, sessions * F.lit(FEATURE_PER_SESSION)))


def _login_expr(duration: Column) -> Column:
    # duration / 5000 computed exactly in decimal (no double division)
    return exact(capped_least(LOGIN_CAP, exact(duration) / F.lit(LOGIN_SECONDS_PER_POINT)))


def _support_expr(n: Column, points: Column) -> Column:
    mean_pts = exact(F.try_divide(points.cast("double"), n.cast("double")))
    inner = F.lit(SUPPORT_BASE) - n * F.lit(SUPPORT_PER_TICKET) + mean_pts
    return F.when(n > 0, exact(floored_greatest(SUPPORT_FLOOR, inner)))


def _payment_expr(n: Column, churned: Column) -> Column:
    return F.when(n > 0, F.when(churned > 0, PAYMENT_CHURNED).otherwise(PAYMENT_OK)).cast(EXACT)


def _new_feature_expr(k: Column) -> Column:
    return exact(capped_least(NEW_FEATURE_CAP, k * NEW_FEATURE_POINTS))


def sentiment_points(col: Column) -> Column:
    e = None
    for s, p in SENTIMENT_POINTS.items():
        e = F.when(col == s, p) if e is None else e.when(col == s, p)
    return e.otherwise(SENTIMENT_OTHER)


WORD_BITS = 62


def _feature_words(features) -> list[Column]:
    """One number per ``WORD_BITS`` listed features: in word ``k`` bit ``i`` is
    set when the row's feature is ``features[k * WORD_BITS + i]``."""
    features = list(dict.fromkeys(features))
    out = []
    for at in range(0, max(1, len(features)), WORD_BITS):
        e = F.lit(0)
        for i, f in enumerate(features[at:at + WORD_BITS]):
            e = F.when(F.col("feature") == f, F.lit(1 << i)).otherwise(e)
        out.append(e.cast("long"))
    return out


def _listed(words: list[Column]) -> Column:
    """How many listed features a customer's words name."""
    counts = [F.bit_count(w) for w in words]
    return sum(counts[1:], counts[0])


# ------------------------------------------------------------ components

def _score_table(df: DataFrame, name: str, expr: Column) -> DataFrame:
    return df.select("customer_id", round_to(expr, 4).alias(name))


def feature_score(usage: DataFrame, win=None) -> DataFrame:
    """One row per customer with usage in ``win``."""
    u = as_rollup(in_window(usage, win))
    agg = u.groupBy("customer_id").agg(F.sum("events").alias("n"))
    return _score_table(agg, "feature_score", _feature_expr(F.col("n")))


def login_score(usage: DataFrame, win=None) -> DataFrame:
    """NULL (not the cap) when every duration is NULL."""
    u = as_rollup(in_window(usage, win))
    agg = u.groupBy("customer_id").agg(F.sum("duration_sum").alias("d"))
    return _score_table(agg, "login_score", _login_expr(F.col("d")))


def support_score(tix: DataFrame) -> DataFrame:
    """One row per customer with tickets; no upper clamp."""
    agg = tix.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(sentiment_points(F.col("sentiment"))).alias("p"))
    return _score_table(agg, "support_score", _support_expr(F.col("n"), F.col("p")))


def payment_score(subs: DataFrame, churn_type: str = "subscription_cancel") -> DataFrame:
    """0 when the customer has any ``churn_type`` event, else 15."""
    agg = subs.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("event_type") == churn_type, 1).otherwise(0)).alias("c"))
    return _score_table(agg, "payment_score", _payment_expr(F.col("n"), F.col("c")))


def new_feature_score(usage: DataFrame, features=NEW_FEATURES) -> DataFrame:
    """Distinct listed features used (all time), 5 points each, max 15."""
    u = usage.filter(F.col("feature").isin(list(features)))
    agg = u.groupBy("customer_id").agg(_listed([F.bit_or(w) for w in _feature_words(features)]).alias("k"))
    return _score_table(agg, "new_feature_score", _new_feature_expr(F.col("k")))


# ------------------------------------------------------------ combined

def _component_inputs(cust: DataFrame, usage: DataFrame, subs: DataFrame, tix: DataFrame,
                      win, churn_type: str, features) -> DataFrame:
    """Union of the four inputs projected onto one per-customer measure row.

    Facts without a customer id belong to nobody; a customer row without an id
    has no facts."""
    words = _feature_words(features)
    zero = F.lit(0).cast("long")
    null_long = F.lit(None).cast("long")

    def row(is_cust=zero, ev=zero, dur=null_long, bits=None, t_n=zero, t_p=zero, s_n=zero, s_c=zero):
        return [is_cust.alias("is_cust"), ev.alias("ev"), dur.alias("dur"),
                *[b.alias(f"bits{k}") for k, b in enumerate(bits or [zero] * len(words))],
                t_n.alias("t_n"), t_p.alias("t_p"), s_n.alias("s_n"), s_c.alias("s_c")]

    r = as_rollup(usage)
    inw = window_flag(win)
    u = r.select("customer_id", *row(
        ev=F.when(inw, F.col("events")).otherwise(0).cast("long"),
        dur=F.when(inw, F.col("duration_sum")),
        bits=words))
    c = cust.select("customer_id", *row(is_cust=F.lit(1).cast("long")))
    t = tix.select("customer_id", *row(
        t_n=F.lit(1).cast("long"), t_p=sentiment_points(F.col("sentiment")).cast("long")))
    s = subs.select("customer_id", *row(
        s_n=F.lit(1).cast("long"),
        s_c=F.when(F.col("event_type") == churn_type, 1).otherwise(0).cast("long")))
    known = F.col("customer_id").isNotNull()
    return c.unionByName(u.filter(known)).unionByName(t.filter(known)).unionByName(s.filter(known))


def health_components(cust: DataFrame, usage: DataFrame, subs: DataFrame, tix: DataFrame,
                      win=None, churn_type: str = "subscription_cancel",
                      features=NEW_FEATURES) -> DataFrame:
    """All five exact components per row of ``cust`` (0 where absent)."""
    words = [f"bits{k}" for k in range(len(_feature_words(features)))]
    m = (_component_inputs(cust, usage, subs, tix, win, churn_type, features)
         .groupBy("customer_id")
         .agg(F.sum("is_cust").alias("is_cust"), F.sum("ev").alias("ev"), F.sum("dur").alias("dur"),
              *[F.bit_or(w).alias(w) for w in words], F.sum("t_n").alias("t_n"), F.sum("t_p").alias("t_p"),
              F.sum("s_n").alias("s_n"), F.sum("s_c").alias("s_c"))
         .filter(F.col("is_cust") > 0)
         # a customer listed twice is scored twice
         .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("is_cust")))))
    z = F.lit(0).cast(EXACT)
    return m.select(
        "customer_id",
        F.coalesce(_feature_expr(F.col("ev")), z).alias("feature_score"),
        F.coalesce(_login_expr(F.col("dur")), z).alias("login_score"),
        F.coalesce(_support_expr(F.col("t_n"), F.col("t_p")), z).alias("support_score"),
        F.coalesce(_payment_expr(F.col("s_n"), F.col("s_c")), z).alias("payment_score"),
        F.coalesce(_new_feature_expr(_listed([F.col(w) for w in words])), z).alias("new_feature_score"),
    )


def _raw(df: DataFrame) -> Column:
    return (F.col("feature_score") + F.col("login_score") + F.col("support_score")
            + F.col("payment_score") + F.col("new_feature_score"))


def health_raw(cust: DataFrame, usage: DataFrame, subs: DataFrame, tix: DataFrame,
               win=None, churn_type: str = "subscription_cancel", features=NEW_FEATURES) -> DataFrame:
    """customer_id, raw_score (sum of components, 10 dp)."""
    comp = health_components(cust, usage, subs, tix, win, churn_type, features)
    return comp.select("customer_id", round_to(_raw(comp), 10).alias("raw_score"))


def tier(score_exact: Column) -> Column:
    e = None
    for name, upper in TIERS:
        cond = score_exact <= upper
        e = F.when(cond, name) if e is None else e.when(cond, name)
    return e.otherwise(TOP_TIER)


def health_scores(cust: DataFrame, usage: DataFrame, subs: DataFrame, tix: DataFrame,
                  win=None, churn_type: str = "subscription_cancel", features=NEW_FEATURES) -> DataFrame:
    """customer_id, health_score (2 dp), health_tier.

    ``raw / 80 * 100`` is evaluated as the exact ``raw * 1.25``; the tier is
    decided on the unrounded exact score (40.004 is "Needs Attention").
    """
    comp = health_components(cust, usage, subs, tix, win, churn_type, features)
    # no cast here: raw has at most 10 decimals, the product at most 12, and
    # rounding it to 10 first would round twice
    score = _raw(comp) * F.lit(Decimal(100) / Decimal(SCALE_DIVISOR))
    return comp.select("customer_id",
                       F.round(score, 2).cast("double").alias("health_score"),
                       tier(score).alias("health_tier"))


def health_scores_v1(cust, usage, subs, tix, features=NEW_FEATURES) -> DataFrame:
    return health_scores(cust, usage, subs, tix, features=features, **V1)


def health_scores_v2(cust, usage, subs, tix, features=NEW_FEATURES) -> DataFrame:
    return health_scores(cust, usage, subs, tix, features=features, **V2)
