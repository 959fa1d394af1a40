"""Ordered scans: hashed ids, one key with most rows, near-unique values; and how many rows a window sees."""

import random

from pyspark.sql import Window, functions as F

from wardflow.operators.history import expanding_prior_rate
from wardflow.operators.intervals import queue_scan
from wardflow.operators.metrics import average_precision, ranking_metrics
from wardflow.operators.running import ID_DIGITS, ID_LEVELS, carried_totals, ordered_counts, prior_totals, with_id_digits


def hashed_rows(n, seed=3):
    """Ids over the whole 64-bit range, nine tenths of the rows under one key."""
    pick = random.Random(seed)
    ids = [pick.randrange(-(1 << 63), 1 << 63) for _ in range(n - 200)] + [(1 << 41) + i for i in range(100)] + list(range(100))
    return [(0 if pick.random() < 0.9 else pick.randrange(1, 5), pick.randrange(3), i, pick.randrange(10)) for i in ids]


def test_prior_totals_of_hashed_ids(spark):
    rows = hashed_rows(3000)
    frame = with_id_digits(spark.createDataFrame(rows, "k int, day int, id long, v int"), "id")
    got = {r["id"]: (r["n"], r["s"]) for r in prior_totals(frame, ["k"], ["day", *ID_LEVELS], ["id"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    for k in range(5):
        n = s = 0
        for _, day, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            assert got[i] == (n, s)
            n, s = n + 1, s + v


def test_windows_over_ids_stay_small_whatever_the_ids_are(spark):
    """Every window sees at most the values of one digit: no level has a group that grows with the ids' range."""
    bits = list(ID_DIGITS.values())
    assert bits == sorted(bits, reverse=True) and 64 - bits[0] <= 22 and bits[0] - bits[1] <= 22 and bits[1] <= 22
    frame = with_id_digits(spark.createDataFrame(hashed_rows(20_000), "k int, day int, id long, v int"), "id")
    # Hashed ids: a chunk of 2**20 ids would hold one row and the window over chunks all rows of the hot key.
    hot = frame.filter("k = 0")
    assert hot.select(F.shiftright("id", 20)).distinct().count() > 15_000
    per_high = hot.groupBy("day", "_high").agg(F.count_distinct("_low").alias("n")).agg(F.max("n")).first()[0]
    per_low = hot.groupBy("day", "_high", "_low").count().agg(F.max("count")).first()[0]
    assert per_high <= 110 and per_low <= 110
    carried = carried_totals(frame.withColumn("one", F.lit(1)), ["k"], ["day", *ID_LEVELS], ["one"])
    assert carried.agg(F.max("_c_one")).first()[0] < 20_000


def test_queue_of_hashed_ids(spark):
    pick = random.Random(5)
    rows = [(pick.randrange(2), 480 + 15 * pick.randrange(6), pick.randrange(2), i, 5 + pick.randrange(20)) for i in (pick.randrange(-(1 << 62), 1 << 62) for _ in range(300))]
    frame = spark.createDataFrame(rows, "d int, t int, u int, id long, s int")
    got = {r["id"]: (r["begin_minute"], r["finish_minute"]) for r in queue_scan(frame, ["d"], "t", "s", "id", [F.col("u")]).collect()}
    for d in (0, 1):
        free = 0
        for _, t, u, i, s in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[2], r[3])):
            begin = max(t, free)
            free = begin + s
            assert got[i] == (begin, free)


def test_ordered_counts_of_near_unique_scores_use_several_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pick = random.Random(9)
        rows = [(pick.random() if i % 50 else 0.5, i % 3) for i in range(4000)]
        frame = spark.createDataFrame(rows, "score double, label int")
        got = ordered_counts(frame, "score", sums={"pos": F.col("label")})
        place = {v: (n, b) for v, n, b in ((r["score"], r["n"], r["n_before"]) for r in got.collect())}
        values = sorted(v for v, _ in rows)
        for i, v in enumerate(values):
            n, before = place[v]
            assert before <= i < before + n
        assert got.agg(F.max("n_total")).first()[0] == 4000
        # the scan is cut: windows inside a block see a part of the values only
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranking_metrics_do_not_depend_on_the_cuts(spark):
    pick = random.Random(11)
    rows = [(round(pick.random(), pick.choice((1, 12))), int(pick.random() < 0.3)) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "score double, label int")
    auc, ap = ranking_metrics(frame).first()
    pairs = [(p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b]
    assert abs(auc - sum(pairs) / len(pairs)) < 1e-4
    total, seen, hits = sum(b for _, b in rows), 0, 0
    want = 0.0
    for v in sorted({v for v, _ in rows}, reverse=True):
        new = sum(b for s, b in rows if s == v)
        seen, hits = seen + sum(s == v for s, _ in rows), hits + new
        want += new / total * hits / seen
    assert abs(ap - want) < 1e-4 and abs(average_precision(frame).first()[0] - want) < 1e-4


def test_expanding_rate_of_one_hot_patient_with_sparse_ids(spark):
    rows = [(1, i * ((1 << 50) + 7), f"2024-01-{1 + i % 9:02d}", i % 2) for i in range(400)]
    frame = spark.createDataFrame(rows, "patient_id int, visit_id long, d string, label int").withColumn("appointment_date", F.to_date("d"))
    out = expanding_prior_rate(frame, 0.2).orderBy("appointment_date", "visit_id").collect()
    assert [r["prior_n"] for r in out] == list(range(400))
    running = Window.partitionBy("patient_id").orderBy("appointment_date", "visit_id").rowsBetween(Window.unboundedPreceding, -1)
    plain = frame.withColumn("k", F.coalesce(F.sum("label").over(running), F.lit(0))).orderBy("appointment_date", "visit_id").collect()
    assert [r["prior_k"] for r in out] == [r["k"] for r in plain]
