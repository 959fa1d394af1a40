"""Model fitting, selection, serving, saving and the jobs, on small data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.operators import features as FT, models
from wardflow.plans import evaluate as ev, jobs
from wardflow.plans.train import NotEnoughData, train
from wardflow.sources import registry, sinks, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    """Bookings whose outcome follows the lead time, so there is something to learn."""
    rows = tables.bookings(spark, FOLDER).filter("appointment_date < '1999-01-01'")
    lead = F.greatest(F.datediff("appointment_date", "booked_at"), F.lit(0))
    draw = F.pmod(F.hash("patient_id", "appointment_date", "start_minute"), F.lit(1000)) / 1000
    missed = draw < F.least(F.lit(0.9), F.lit(0.1) + lead / 80)
    status = F.when(F.col("status") == "cancelled", "cancelled").when(missed, "no_show").otherwise("completed")
    extra = F.when(F.col("specialty") == "ECONOMY", 40).otherwise(10)
    return rows.withColumn("status", status).withColumn("duration_minutes", extra + F.col("duration_minutes") % 7).cache()


@pytest.fixture(scope="module")
def table(frame):
    return FT.no_show_features(frame, 0.3, keep=("appointment_date",)).cache()


def test_logistic_ranks_by_lead_time_and_is_calibrated(spark, table):
    model = models.fit_no_show(table)
    assert len(model.parts) == 3 and all(c is not None for _, c in model.parts)
    scored = model.transform(table)
    mean, rate = scored.agg(F.avg("score"), F.avg("label")).first()
    assert mean == pytest.approx(rate, abs=0.08)
    short = scored.filter("lead_time_days <= 1").agg(F.avg("score")).first()[0]
    late = scored.filter("lead_time_days > 30").agg(F.avg("score")).first()[0]
    assert late > short + 0.2
    names = [n for n, _ in model.importance()]
    assert set(names[:3]) & {"lead_time_days", "log_lead_time"}
    assert sum(v for _, v in model.importance()) == pytest.approx(1.0, abs=0.01)


def test_same_seed_gives_the_same_scores(table):
    a, b = (models.fit_no_show(table, calibrate=False).transform(table).agg(F.sum("score")).first()[0] for _ in range(2))
    assert a == pytest.approx(b, rel=1e-12)


def test_estimator_selection_reports_both(table):
    winner, scores = models.select_estimator(table, n_splits=2, params={"maxIter": 3})
    assert winner in models.KINDS and set(scores) == set(models.KINDS)
    assert scores[winner] == max(scores.values())


def test_estimator_selection_query_fits_whole_models_on_three_splits(spark, monkeypatch):
    from wardflow.plans import registered_models

    fits, plain = [], models._fit_base

    def fit(kind, train, names, seed, params):
        fits.append((kind, params))
        return plain(kind, train, names, seed, {"maxIter": 1} if kind == "gradient_boosting" else params)

    monkeypatch.setattr(models, "_fit_base", fit)
    rows = registered_models.estimator_selection(spark, "/root/testdata/sf0.001").collect()
    assert {r["estimator"] for r in rows} == set(models.KINDS)
    assert sorted(fits) == [("gradient_boosting", None)] * 3 + [("logistic_regression", None)] * 3


def test_train_save_load_and_serve(spark, frame, tmp_path):
    folder = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError, match="run the training job first"):
        registry.load_model(spark, "no_show", folder)
    with pytest.raises(NotEnoughData):
        train(frame, folder, minimum_rows=10**9)
    cards = train(frame, folder, minimum_rows=500, trees=3)
    assert set(cards) == {"no_show", "demand", "duration"}
    status = {r["name"]: r for r in registry.model_status(spark, folder).collect()}
    assert status["no_show"]["n_features"] == 17 and status["demand"]["n_features"] == 10 and status["duration"]["n_features"] == 6
    assert 0.05 <= status["no_show"]["threshold"] <= 0.95

    model, card, codes, _ = registry.load_model(spark, "no_show", folder)
    candidate = lambda i, lead: (i, 1, "ECONOMY", dt.date(1998, 12, 1), 600, 30, "scheduled", "routine", False, dt.date(1998, 12, 1) - dt.timedelta(days=lead))
    asked = spark.createDataFrame(
        [candidate(1, 0), candidate(2, 40)],
        "visit_id long, patient_id long, specialty string, appointment_date date, start_minute int, duration_minutes int, status string, "
        "urgency string, is_new_patient boolean, booked_at date",
    )
    out = models.predict_no_show(asked, frame, model, base_rate=card["base_rate"], codes=codes, threshold=card["threshold"], keep=("visit_id",))
    got = {r["visit_id"]: r["no_show_probability"] for r in out.collect()}
    assert got[2] > got[1]

    u_model, u_card, u_codes, _ = registry.load_model(spark, "duration", folder)
    lengths = models.predict_duration(asked, frame, u_model, codes=u_codes, keep=("visit_id",)).collect()
    assert all(5 <= r["predicted_duration_minutes"] <= 240 and not r["fallback"] for r in lengths)
    fallback = models.predict_duration(asked, frame, None, codes=None, keep=("visit_id",)).first()
    assert (fallback["predicted_duration_minutes"], fallback["fallback"]) == (30.0, True)
    d_model, _, _, profile = registry.load_model(spark, "demand", folder)
    assert d_model.strategy in ("profile", "poisson", "gbm") and profile.count() > 0


def test_evaluation_job_writes_reports_and_gates(spark, frame, tmp_path):
    out = str(tmp_path / "report")
    jobs.run_evaluation(frame, out, trees=3, minimum_rows=500, n_folds=2, test_days=120, min_train_days=270)
    gates = {r["name"]: r["passed"] for r in spark.read.json(f"{out}/gates").collect()}
    assert gates["no_show_vs_logistic"] and gates["no_show_roc_auc"] and gates["demand_not_worse"] is not None
    assert len(gates) == 5
    assert spark.read.json(f"{out}/no_show_curve").count() == 50
    chosen = {r["fold"]: r["strategy"] for r in spark.read.json(f"{out}/demand_strategies").collect()}
    assert set(chosen) == {1, 2} and set(chosen.values()) <= {"profile", "poisson", "gbm"}
    for name, features in (("no_show", 17), ("duration", 6)):
        by_fold = spark.read.json(f"{out}/{name}_importance").groupBy("fold").count().collect()
        assert sorted((r["fold"], r["count"]) for r in by_fold) == [(1, features), (2, features)]
    folds = spark.read.json(f"{out}/no_show_per_fold")
    base = folds.filter("candidate = 'base_rate'")
    assert folds.count() == 6 and {r["roc_auc"] for r in base.collect()} == {0.5}


def test_gate_thresholds(spark):
    row = lambda c, m, v: (c, m, v, 0.0)
    make = lambda rows: spark.createDataFrame(rows, "candidate string, metric string, mean double, std double")
    ns = make([row("model", "pr_auc", 0.32), row("base_rate", "pr_auc", 0.21), row("logistic_regression", "pr_auc", 0.33), row("model", "roc_auc", 0.59)])
    demand = make([row("model", "mae", 0.48), row("seasonal_naive", "mae", 0.48)])
    duration = make([row("model", "mae", 5.3), row("specialty_mean", "mae", 5.2)])
    got = {r["name"]: r["passed"] for r in ev.gates(ns, demand, duration).collect()}
    assert got == {"no_show_beats_base_rate": True, "no_show_roc_auc": False, "no_show_vs_logistic": True, "demand_not_worse": True, "duration_not_worse": False}


def test_ablation_covers_three_groups(table):
    rows = models.ablation(table, table)
    assert [r["features"] for r in rows] == ["all features", "without patient history", "patient history only"]
    assert rows[0]["roc_auc"] > rows[2]["roc_auc"]


def test_structure_gate_job(spark, frame, tmp_path):
    assert jobs.run_gate(frame, dt.date(1999, 1, 1), str(tmp_path / "gate")) in (True, False)
    report = {r["name"]: r["passed"] for r in spark.read.json(str(tmp_path / "gate" / "structure_gate")).collect()}
    assert len(report) == 14 and report["lead_time_rho"] and report["lead_time_ratio"]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([("a", dt.date(2024, 2, 1), 9, 1.5)], "specialty string, appointment_date date, hour_of_day int, predicted_demand double")
    folder = str(tmp_path / "forecast")
    sinks.write_forecast(cells, folder, "v1")
    sinks.write_forecast(cells, folder, "v2")
    sinks.write_forecast(cells, folder, "v2")
    assert {r["model_version"] for r in spark.read.parquet(folder).collect()} == {"v1", "v2"} and spark.read.parquet(folder).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        sinks.write_forecast(cells.union(cells), folder, "v3")


def test_bookings_are_joined_once(spark, tmp_path):
    """Training and test rows are read from stored bookings, not from the joined tables again."""
    from wardflow.plans import registered_models

    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(20)]
    tables = {
        "part": ([(1, "a"), (2, "b")], "p_partkey long, p_type string"),
        "orders": ([(i, i % 3, days[i % 5], "1-URGENT") for i in range(20)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i, 1 + i % 2, 1, 1, 10.0, "RA"[i % 2], d) for i, d in enumerate(days)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    train, test = registered_models._holdout(spark, str(tmp_path))
    assert train.count() == 16 and test.count() == 4
    assert not any("lineitem" in f or "orders" in f for frame in (train, test) for f in frame.inputFiles())


def test_calibration_folds_are_dates_and_copy_no_rows(spark, table, monkeypatch):
    from wardflow.operators import splits

    days = [None, *[dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(9) for _ in range(1 + i % 3)]]
    rows = spark.createDataFrame([(d,) for d in days], "appointment_date date")
    block = {r["appointment_date"]: r["block"] for r in splits.time_series_blocks(rows, n_splits=2).collect() if r["appointment_date"]}
    dates = splits.block_dates(rows, n_splits=2)
    assert block == {d: i for d in block for i, (a, b) in dates.items() if a <= d <= b} and len(dates) == 3
    monkeypatch.setattr(models, "stored", lambda df: pytest.fail("the rows were written again"))
    assert len(models.fit_no_show(table).parts) == 3


def test_scores_and_grid_are_stored(spark, table):
    """Measures read two columns, and every use of the grid reads its cells, not the events."""
    from wardflow.plans import registered_models

    scored = registered_models._scored(models.fit_no_show(table, calibrate=False), table)
    assert scored.columns == ["label", "score"] and all("/table-" in f for f in scored.inputFiles()) and scored.count() == table.count()
    grid = registered_models._grid(spark, FOLDER)
    assert grid.count() > 0 and not any("events" in f for f in grid.inputFiles())


def test_codes_cause_no_shuffle_of_the_rows(spark):
    """The size of the stored catalogue is known when the join is planned: rows do not go to one task for each specialty."""
    from wardflow.plans import registered_models
    from wardflow.session import stored

    frame = stored(spark.range(30000).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("specialty"), F.rand(1).alias("x")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        joined = FT._with_codes(frame, registered_models._codes(frame))
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert {(r["specialty"], r["specialty_code"]) for r in joined.select("specialty", "specialty_code").distinct().collect()} == {("s0", 0), ("s1", 1), ("s2", 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_root_split_reads_its_features_from_a_table(spark, monkeypatch):
    """Edges and cells read the features several times: codes are joined once."""
    from wardflow.plans import registered_models

    monkeypatch.setattr(registered_models, "_root_split", lambda spark, rows, *rest: rows)
    rows = registered_models.duration_root_split(spark, FOLDER)
    assert rows.columns == [*registered_models.DURATION_SMALL, "duration_minutes"] and rows.count() > 0
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_those_of_the_fitted_pipeline(spark, table):
    """The score is an expression of the scaled inputs; it has the value of the fitted stages, and rows are not made vectors of."""
    from pyspark.ml.functions import vector_to_array

    model = models.fit_no_show(table, calibrate=False)
    base, names = model.parts[0][0], model.feature_names
    plain = base.transform(models._ready(table, names)).select(vector_to_array("_probability")[1].alias("p"), "_features")
    assert "UDF" not in model.transform(table)._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(r["p"] for r in plain.collect())
    assert sorted(r["score"] for r in model.transform(table).collect()) == pytest.approx(want, abs=1e-9)
    inputs = [list(r["_features"]) for r in plain.collect()]
    for column in zip(*inputs):
        mean = sum(column) / len(column)
        spread = sum((v - mean) ** 2 for v in column) / (len(column) - 1)
        assert mean == pytest.approx(0, abs=1e-6) and spread == pytest.approx(1, abs=1e-6)


def test_training_and_test_rows_read_one_history(spark, tmp_path):
    """One pass gives each side the history it has by itself, also for rows booked after the cutoff and for rows without dates."""
    from wardflow.plans import registered_models

    day = lambda i: None if i % 11 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(days=i * 7 % 40)
    tables = {
        "part": ([(1, "a"), (2, "b")], "p_partkey long, p_type string"),
        "orders": ([(i, None if i == 9 else i % 3, day(i), "1-URGENT") for i in range(60)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i // 2, 1 + i % 2, 1, i % 4, 10.0, "RAN"[i % 3], day(i * 5 + 1)) for i in range(120)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp"),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    apart, together = registered_models._holdout(spark, str(tmp_path)), registered_models._both(spark, str(tmp_path))
    for a, b in zip(apart, together):
        assert a.columns == b.columns and a.count() > 0
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert "Window" not in b._jdf.queryExecution().optimizedPlan().toString()
