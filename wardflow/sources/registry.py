"""Saved models with a card that says what produced them."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.operators.boosting import Boosted
from wardflow.operators.models import Base, DemandModel, DurationModel, NoShowModel


@dataclass
class ModelCard:
    name: str
    kind: str
    seed: int
    feature_names: list[str]
    train_rows: int
    train_date_range: list[str]
    params: dict
    metrics: dict
    threshold: float | None = None
    threshold_rationale: str | None = None
    base_rate: float | None = None
    estimator: str | None = None
    n_parts: int = 1
    calibrated: bool = False
    version: str = ""
    trained_at: str = field(default_factory=lambda: dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _save_base(spark: SparkSession, base: Base, path: str) -> None:
    """A pipeline in Spark's own format, boosted trees as one line of JSON."""
    if isinstance(base, Boosted):
        spark.createDataFrame([(base.to_json(),)], "value string").coalesce(1).write.text(f"{path}/trees")
    else:
        base.write().save(path)


def _load_base(spark: SparkSession, path: str) -> Base:
    if _exists(spark, f"{path}/trees"):
        return Boosted.from_json(spark.read.text(f"{path}/trees").first()[0])
    return PipelineModel.load(path)


def save_model(spark: SparkSession, model, card: ModelCard, folder: str, *, codes: DataFrame | None = None,
               profile: DataFrame | None = None) -> str:
    """Write the model stages, the lookup tables it was fitted with, and the card.

    Each save has a folder of its own, and the card, which names it, is
    switched last: until then the model saved before stays the current one.
    """
    root = f"{folder}/{card.name}"
    card.version = uuid.uuid4().hex
    place = f"{root}/{card.version}"
    pipelines = []
    if isinstance(model, NoShowModel):
        pipelines = model.parts
        card.estimator, card.calibrated = model.estimator, model.parts[0][1] is not None
    elif isinstance(model, DemandModel):
        card.estimator = model.strategy
        pipelines = [] if model.model is None else [(model.model, None)]
    else:
        pipelines = [(model.model, None)]
    card.n_parts = len(pipelines)
    for i, (base, calibrator) in enumerate(pipelines):
        _save_base(spark, base, f"{place}/base-{i}")
        if calibrator is not None:
            calibrator.write().save(f"{place}/calibrator-{i}")
    if codes is not None:
        codes.write.parquet(f"{place}/codes")
    if profile is not None:
        profile.write.parquet(f"{place}/profile")
    line = json.dumps({**asdict(card), "params": json.dumps(card.params), "metrics": json.dumps(card.metrics)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/card")
    return root


def load_model(spark: SparkSession, name: str, folder: str):
    """(model, card, codes or None, profile or None); a missing model says so."""
    root = f"{folder}/{name}"
    if not _exists(spark, f"{root}/card"):
        raise FileNotFoundError(f"no trained model {name!r} in {folder}: run the training job first")
    card = json.loads(spark.read.text(f"{root}/card").first()[0])
    card["params"], card["metrics"] = json.loads(card["params"]), json.loads(card["metrics"])
    place = f"{root}/{card['version']}"
    bases = [_load_base(spark, f"{place}/base-{i}") for i in range(card["n_parts"])]
    names = card["feature_names"]
    if card["kind"] == "classifier":
        calibrators = [
            IsotonicRegressionModel.load(f"{place}/calibrator-{i}") if card["calibrated"] else None for i in range(len(bases))
        ]
        model = NoShowModel(card["estimator"], names, list(zip(bases, calibrators)), card["params"])
    elif name == "demand":
        model = DemandModel(card["estimator"], names, bases[0] if bases else None)
    else:
        model = DurationModel(names, bases[0])
    tables = [spark.read.parquet(f"{place}/{t}") if _exists(spark, f"{place}/{t}") else None for t in ("codes", "profile")]
    return model, card, *tables


def model_status(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance of every saved model."""
    cards = spark.read.json(f"{folder}/*/card")
    return cards.select(
        "name", "kind", "trained_at", "seed", "train_rows", "train_date_range",
        *[F.col(c) if c in cards.columns else F.lit(None).alias(c) for c in ("threshold", "threshold_rationale")],
        F.size("feature_names").alias("n_features"),
    )
