"""What a nested run has finished, kept by fold and model so that a restart goes on from there.

Three tables in one folder, each partitioned by fold and model: trials of the grid searches,
the choice made from them, and predictions of the outer fold. A write replaces just the
partitions it holds and shows up only when its job has committed, so what is listed is whole.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.sources.sinks import write_folds


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def done(self, kind: str) -> set[tuple[int, str]]:
        """(fold, model) pairs that are there; reads partition names, not rows."""
        table = self._table(kind)
        if table is None:
            return set()
        return {(int(r["fold"]), r["model"]) for r in table.select("fold", "model").distinct().collect()}

    def put(self, kind: str, rows: DataFrame, fold: int, model: str) -> None:
        named = rows.withColumn("fold", F.lit(fold)).withColumn("model", F.lit(model))
        write_folds(named, f"{self.path}/{kind}")

    def get(self, kind: str, fold: int, model: str) -> DataFrame:
        table = self._table(kind)
        if table is None:
            raise FileNotFoundError(f"no {kind} in {self.path}")
        return table.filter((F.col("fold") == fold) & (F.col("model") == model)).drop("fold", "model")

    def put_choice(self, fold: int, model: str, params: dict, accuracy: float, features: list[str]) -> None:
        rows = self.spark.createDataFrame(
            [(json.dumps(params), accuracy, features)], "params string, inner_accuracy double, features array<string>"
        )
        self.put("choices", rows, fold, model)

    def choice(self, fold: int, model: str) -> tuple[dict, float, list[str]]:
        row = self.get("choices", fold, model).first()
        if row is None:
            raise FileNotFoundError(f"no choice for fold {fold}, {model} in {self.path}")
        return json.loads(row["params"]), row["inner_accuracy"], list(row["features"])

    def put_predictions(self, rows: DataFrame) -> None:
        """All models of a fold at once."""
        write_folds(rows, f"{self.path}/predictions")

    def predictions(self, fold: int) -> DataFrame:
        table = self._table("predictions")
        if table is None:
            raise FileNotFoundError(f"no predictions in {self.path}")
        return table.filter(F.col("fold") == fold)
