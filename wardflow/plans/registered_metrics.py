"""Registered queries: model metrics over a scored table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardflow.functions import scalar as X
from wardflow.operators import demand, features, metrics, running
from wardflow.plans.catalog import register, with_views
from wardflow.sources import tables as T

SCORED_SQL = """SELECT dayofmonth(appointment_date) % 4 AS fold,
    CAST(status = 'no_show' AS INT) AS label, CAST(no_show_probability AS DOUBLE) AS score FROM visits WHERE status IN ('completed', 'no_show')"""


def scored(spark, folder):
    """Visits with an outcome, and the probability that was stored with them."""
    rows = T.visits(spark, folder).filter(X.resolved())
    return rows.select((F.dayofmonth("appointment_date") % 4).alias("fold"), X.outcome().alias("label"), F.col("no_show_probability").alias("score"))


def cuts_sql(n: int) -> str:
    rows = ", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(metrics.thresholds(n)))
    return f"SELECT * FROM (VALUES {rows}) AS t(i, threshold)"


def table_sql(n: int) -> str:
    return """SELECT threshold, CAST(sum(pos) FILTER (WHERE score >= threshold) AS BIGINT) AS tp, CAST(sum(neg) FILTER (WHERE score >= threshold) AS BIGINT) AS fp,
        CAST(sum(pos) FILTER (WHERE score < threshold) AS BIGINT) AS fn, CAST(sum(neg) FILTER (WHERE score < threshold) AS BIGINT) AS tn
        FROM cuts, (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1) GROUP BY threshold"""


ZERO = "SELECT threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM ({})"
RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy"""
AUC_SQL = """SELECT {by} (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS roc_auc
    FROM (SELECT {by} label, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by} score) - 1) / 2.0 AS r FROM {src}) {group}"""


def auc_sql(by: str = "", src: str = "scored") -> str:
    return AUC_SQL.format(by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "", group=f"GROUP BY {by}" if by else "", src=src)


AP_SQL = """SELECT sum(pos / total * tp / flagged) AS pr_auc FROM (SELECT score, pos, sum(pos) OVER () AS total,
    sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS flagged
    FROM (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY 1))"""


@register(
    "confusion_by_fold",
    with_views("visits", f"""SELECT fold, tp, fp, fn, tn, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, round(accuracy, 9) AS accuracy
        FROM (SELECT *, {RATES} FROM (SELECT fold, count(*) FILTER (WHERE score >= 0.3 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.3 AND label = 0) AS fp,
          count(*) FILTER (WHERE score < 0.3 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.3 AND label = 0) AS tn FROM scored GROUP BY 1))""", scored=SCORED_SQL),
)
def confusion_by_fold(spark, folder):
    out = metrics.confusion(scored(spark, folder), 0.3, ["fold"])
    rates = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")]
    return out.select("fold", "tp", "fp", "fn", "tn", *rates)


@register("roc_auc", with_views("visits", f"SELECT round(roc_auc, 9) AS roc_auc FROM ({auc_sql()})", scored=SCORED_SQL))
def roc_auc(spark, folder):
    return metrics.roc_auc(scored(spark, folder)).select(F.round("roc_auc", 9).alias("roc_auc"))


@register("average_precision", with_views("visits", f"SELECT round(pr_auc, 9) AS pr_auc FROM ({AP_SQL})", scored=SCORED_SQL))
def average_precision(spark, folder):
    return metrics.average_precision(scored(spark, folder)).select(F.round("pr_auc", 9).alias("pr_auc"))


@register("brier_score", with_views("visits", "SELECT fold, round(avg(pow(score - label, 2)), 9) AS brier FROM scored GROUP BY 1", scored=SCORED_SQL))
def brier_score(spark, folder):
    return metrics.brier(scored(spark, folder), ["fold"]).select("fold", F.round("brier", 9).alias("brier"))


@register(
    "fold_auc_summary",
    with_views("visits", f"SELECT round_even(round(avg(roc_auc), 9), 4) AS mean, round_even(round(stddev_pop(roc_auc), 9), 4) AS std FROM ({auc_sql('fold')})", scored=SCORED_SQL),
)
def fold_auc_summary(spark, folder):
    return metrics.mean_std(metrics.roc_auc(scored(spark, folder), ["fold"]), "roc_auc")


@register(
    "precision_recall_curve",
    with_views("visits", f"""SELECT round_even(round(threshold, 9), 4) AS threshold, round_even(round("precision", 9), 4) AS "precision",
        round_even(round(recall, 9), 4) AS recall, round_even(round(f1, 9), 4) AS f1 FROM (SELECT *, {RATES} FROM ({ZERO.format(table_sql(50))}))""",
               scored=SCORED_SQL, cuts=cuts_sql(50)),
)
def precision_recall_curve(spark, folder):
    return metrics.pr_curve(scored(spark, folder))


@register(
    "threshold_for_cost",
    with_views("visits", f"SELECT round(threshold, 9) AS threshold, CAST(fn * 3 + fp AS DOUBLE) AS cost, tp, fp, fn, tn FROM ({ZERO.format(table_sql(91))}) ORDER BY cost, threshold LIMIT 1",
               scored=SCORED_SQL, cuts=cuts_sql(91)),
)
def threshold_for_cost(spark, folder):
    out = metrics.threshold_for_cost(scored(spark, folder), 3.0, 1.0)
    return out.select(F.round("threshold", 9).alias("threshold"), "cost", "tp", "fp", "fn", "tn")


@register(
    "operating_points",
    with_views("visits", """SELECT fn_cost, round(threshold, 9) AS threshold, cost, tp, fp, fn, tn FROM (SELECT *, fn * fn_cost + fp AS cost,
          row_number() OVER (PARTITION BY fn_cost ORDER BY fn * fn_cost + fp, threshold) AS best
        FROM tab, (SELECT unnest([1.0::DOUBLE, 2.0, 3.0, 5.0]) AS fn_cost)) WHERE best = 1""",
               scored=SCORED_SQL, cuts=cuts_sql(91), tab=ZERO.format(table_sql(91))),
)
def operating_points(spark, folder):
    out = metrics.operating_points(scored(spark, folder))
    return out.select("fn_cost", F.round("threshold", 9).alias("threshold"), "cost", "tp", "fp", "fn", "tn")


@register(
    "signal_captured",
    with_views("visits", f"""SELECT round(m.roc_auc, 9) AS measured, round(c.roc_auc, 9) AS ceiling, round((m.roc_auc - 0.5) / (c.roc_auc - 0.5), 6) AS captured
        FROM ({auc_sql(src='coarse')}) m, ({auc_sql()}) c""", scored=SCORED_SQL, coarse="SELECT label, CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END AS score FROM scored"),
)
def signal_captured(spark, folder):
    rows = scored(spark, folder)
    coarse = rows.withColumn("score", F.when(F.col("score") >= 0.3, 1.0).otherwise(0.0))
    out = metrics.signal_captured(metrics.roc_auc(coarse), metrics.roc_auc(rows))
    return out.select(F.round("measured", 9).alias("measured"), F.round("ceiling", 9).alias("ceiling"), F.round("captured", 6).alias("captured"))


RANK_SQL = "SELECT {x}, {y}, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM {t}"


@register(
    "spearman_lead_no_show",
    with_views("past", f"SELECT round(corr(rx, ry), 8) AS rho, count(*) AS n FROM ({RANK_SQL.format(x='lead_days', y='no_show', t='past')})"),
)
def spearman_lead_no_show(spark, folder):
    past, _ = T.past_and_all(T.bookings(spark, folder), dt.date(2001, 1, 1))
    return running.spearman(past, "lead_days", "no_show").select(F.round("rho", 8).alias("rho"), "n")


@register(
    "average_ranks",
    with_views("visits", "SELECT duration_minutes, count(*) AS n, max(rx) AS rank FROM (SELECT duration_minutes, rank() OVER (ORDER BY duration_minutes) + (count(*) OVER (PARTITION BY duration_minutes) - 1) / 2.0 AS rx FROM visits) GROUP BY 1"),
)
def average_ranks(spark, folder):
    return running.average_ranks(T.visits(spark, folder), "duration_minutes")


@register(
    "nearest_rank_durations",
    with_views("bookings", """SELECT specialty, list_sort(list(duration_minutes))[CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS INT) + 1] AS p10,
        list_sort(list(duration_minutes))[CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS INT) + 1] AS p90 FROM bookings GROUP BY 1"""),
)
def nearest_rank_durations(spark, folder):
    return running.nearest_rank(T.bookings(spark, folder), "duration_minutes", {"p10": 0.1, "p90": 0.9}, ["specialty"])


REG_SQL = """SELECT round(avg(abs(p - y)), 8) AS mae, round(sqrt(avg(pow(p - y, 2))), 8) AS rmse, round(avg(p - y), 8) AS bias,
    round(1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)), 8) AS r2, count(*) AS support FROM ({})"""


def _rounded(out):
    return out.select(*[F.round(c, 8).alias(c) for c in ("mae", "rmse", "bias", "r2")], "support")


@register(
    "duration_baseline_metrics",
    with_views("bookings", REG_SQL.format("""SELECT CAST(duration_minutes AS DOUBLE) AS y, m AS p FROM bookings
        JOIN (SELECT specialty, avg(duration_minutes) AS m FROM bookings WHERE status = 'completed' AND appointment_date < DATE '2000-07-01' GROUP BY 1) USING (specialty)
        WHERE status = 'completed' AND appointment_date >= DATE '2000-07-01'""")),
)
def duration_baseline_metrics(spark, folder):
    done = T.bookings(spark, folder).filter("status = 'completed'")
    cut = F.lit(dt.date(2000, 7, 1))
    out = features.specialty_mean_duration(done.filter(F.col("appointment_date") < cut), done.filter(F.col("appointment_date") >= cut))
    return _rounded(metrics.regression_metrics(out.withColumn("label", F.col("duration_minutes").cast("double"))))


@register(
    "demand_baseline_metrics",
    with_views("grid", REG_SQL.format("""SELECT CAST(count AS DOUBLE) AS y, m AS p FROM grid
        JOIN (SELECT specialty, isodow(appointment_date) AS d, hour_of_day, avg(count) AS m FROM grid WHERE appointment_date < DATE '2024-01-20' GROUP BY ALL) t
          ON t.specialty = grid.specialty AND t.d = isodow(appointment_date) AND t.hour_of_day = grid.hour_of_day
        WHERE appointment_date >= DATE '2024-01-20'""")),
)
def demand_baseline_metrics(spark, folder):
    grid = demand.demand_grid(T.visits(spark, folder))
    cut = F.lit(dt.date(2024, 1, 20))
    out = demand.seasonal_naive(grid.filter(F.col("appointment_date") < cut), grid.filter(F.col("appointment_date") >= cut))
    return _rounded(metrics.regression_metrics(out.withColumn("label", F.col("count").cast("double"))))
