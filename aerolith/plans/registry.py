"""Versioned models: save, champion pointer, load, and tree nodes for attribution."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.tables import exists

_META = (
    "model_name string, version string, saved_at timestamp, path string, metrics map<string,double>, num_features int, "
    "features array<string>, hyperparameters string, is_champion boolean"
)

_EDGES = "version string, saved_at timestamp, feature string, edges array<double>"


class ModelRegistry:
    """Models under ``<root>/<slug>_v_<version>``; one appended row of metadata each.

    Rows are only added. The champion is the newest row marked so.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def _meta_path(self) -> str:
        return f"{self.root}/metadata"

    def save(
        self,
        model: PipelineModel,
        name: str,
        metrics: dict[str, float],
        features: Sequence[str],
        *,
        hyperparameters: dict | None = None,
        version: str | None = None,
        is_champion: bool = True,
    ) -> str:
        now = datetime.now(timezone.utc)
        version = version or f"{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"
        path = f"{self.root}/{name.lower().replace(' ', '_')}_v_{version}"
        model.write().overwrite().save(path)
        row = (name, version, now, path, {k: float(v) for k, v in metrics.items()}, len(features), list(features), json.dumps(hyperparameters or {}), is_champion)
        self.spark.createDataFrame([row], _META).coalesce(1).write.mode("append").parquet(self._meta_path)
        return path

    def save_edges(self, version: str, edges: Mapping[str, Sequence[float]]) -> None:
        """Keep the bin edges of a version's training columns, for later drift reports."""
        rows = [(version, datetime.now(timezone.utc), c, [float(e) for e in cuts]) for c, cuts in edges.items()]
        self.spark.createDataFrame(rows, _EDGES).coalesce(1).write.mode("append").parquet(f"{self.root}/edges")

    def edges(self, version: str) -> dict[str, list[float]]:
        """The newest edges kept for a version; empty if there are none. A row a column."""
        path = f"{self.root}/edges"
        if not exists(self.spark, path):
            return {}
        rows = self.spark.read.schema(_EDGES).parquet(path).filter(F.col("version") == version)
        return {r.feature: list(r.edges) for r in rows.groupBy("feature").agg(F.max_by("edges", "saved_at").alias("edges")).collect()}

    def versions(self) -> DataFrame:
        return self.spark.read.schema(_META).parquet(self._meta_path)

    def find(self, version: str | None = None) -> dict | None:
        """Metadata of a version, or of the champion."""
        if not exists(self.spark, self._meta_path):
            return None
        wanted = F.col("version") == version if version else F.col("is_champion")
        row = self.versions().filter(wanted).orderBy(F.col("saved_at").desc()).first()
        return row.asDict() if row else None

    def load(self, version: str | None = None, retrain: Callable[[], object] | None = None) -> tuple[PipelineModel, dict]:
        """Model and metadata; with nothing saved, ``retrain`` runs once first."""
        meta = self.find(version)
        if meta is None and retrain is not None:
            retrain()
            meta = self.find(version)
        if meta is None:
            raise FileNotFoundError(f"no model in {self.root}")
        return PipelineModel.load(meta["path"]), meta


def tree_nodes(spark: SparkSession, model, path: str) -> list[tuple[float, dict]]:
    """Nodes of a fitted tree ensemble as ``[(weight, {id: (value, cover, left, right, feature, threshold)})]``.

    Read from the ensemble's own saved node table, whose size is that of the model.
    """
    if not exists(spark, path):
        model.write().save(path)
    rows = (
        spark.read.parquet(f"{path}/data")
        .select("treeID", "nodeData.*")
        .select(
            "treeID",
            *["id", "prediction", "rawCount", "leftChild", "rightChild"],
            F.col("split.featureIndex").alias("feature"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        )
        .collect()
    )
    weights = list(model.treeWeights)
    # A forest averages its trees; boosting adds them with their weights.
    scale = 1.0 / len(weights) if "RandomForest" in type(model).__name__ else 1.0
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r.treeID, {})[r.id] = (r.prediction, r.rawCount, r.leftChild, r.rightChild, r.feature, r.threshold)
    return [(scale * weights[i], trees[i]) for i in sorted(trees)]
