"""Predictions of a fitted forest for batches of rows, tree by tree.

MLlib walks all trees for one row before the next row, and a forest of some hundred deep trees
does not stay in a processor's cache. Here a batch of rows goes through one tree at a time: the
rows of a node are split in two by its threshold until they reach leaves. Votes are summed in
the order of the trees and divided by their number, as MLlib does, so predictions are equal to
the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.session import scratch_path

# Rows that go through a tree together; they bound a worker's memory, never a result.
BATCH_ROWS = 65_536
# Larger forests have too few rows of a batch in a node; MLlib predicts for them.
MOST_NODES = 1_000_000


class Forest:
    """Nodes of all trees in arrays; a threshold is its place among all thresholds of its feature."""

    def __init__(self, nodes: pa.Table):
        column = {n: nodes.column(n).to_numpy() for n in nodes.column_names}
        order = np.lexsort((column["id"], column["tree"]))
        column = {n: c[order] for n, c in column.items()}
        self.roots = np.flatnonzero(column["id"] == 0)
        start = self.roots[np.searchsorted(column["tree"][self.roots], column["tree"])]
        inner = column["left"] >= 0
        self.left = np.where(inner, start + column["left"], -1)
        self.right = np.where(inner, start + column["right"], -1)
        self.value, self.feature = column["prediction"], column["feature"]
        self.place = np.zeros(len(inner), dtype=np.int64)
        self.thresholds = {}
        for f in np.unique(self.feature[inner]).tolist():
            own = inner & (self.feature == f)
            self.thresholds[f], self.place[own] = np.unique(column["threshold"][own], return_inverse=True)

    def predictions(self, rows: np.ndarray) -> np.ndarray:
        """One prediction for each row of a matrix of features; NaN goes right, as it is not below any threshold."""
        places = {}
        for f, t in self.thresholds.items():
            kind = np.uint8 if len(t) < 256 else np.uint32
            places[f] = np.searchsorted(t, rows[:, f], side="left").astype(kind)
        left, right, feature, place, value = (c.tolist() for c in (self.left, self.right, self.feature, self.place, self.value))
        total, vote, everything = np.zeros(len(rows)), np.empty(len(rows)), np.arange(len(rows))
        for root in self.roots.tolist():
            waiting = [(root, everything)]
            while waiting:
                node, own = waiting.pop()
                if left[node] < 0:
                    vote[own] = value[node]
                    continue
                below = places[feature[node]][own] <= place[node]
                for child, part in ((left[node], own[below]), (right[node], own[~below])):
                    if len(part):
                        waiting.append((child, part))
            total += vote
        return total / len(self.roots)


def forest_nodes(model: RandomForestRegressionModel, rows: DataFrame) -> pa.Table | None:
    """The nodes of a forest as it is saved, a table as small as the model; None if a split is not by a threshold."""
    path = scratch_path(rows.sparkSession, "forest-nodes")
    model.write().save(path)
    node, split = "nodeData", "nodeData.split"
    found = rows.sparkSession.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("long").alias("tree"),
        F.col(f"{node}.id").cast("long").alias("id"),
        F.col(f"{node}.leftChild").cast("long").alias("left"),
        F.col(f"{node}.rightChild").cast("long").alias("right"),
        F.col(f"{node}.prediction").alias("prediction"),
        F.col(f"{split}.featureIndex").cast("long").alias("feature"),
        F.coalesce(F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        (F.col(f"{split}.numCategories") >= 0).alias("listed"),
    )
    nodes = found.toArrow()
    listed = nodes.column("listed").to_numpy() & (nodes.column("left").to_numpy() >= 0)
    return None if listed.any() else nodes.drop(["listed"])


def batch_predictions(forest: Broadcast):
    """An Arrow function from arrays of features to predictions."""

    @F.arrow_udf("double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def given(held):
            matrix = np.concatenate([b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for b in held])
            found, at = forest.value.predictions(matrix), 0
            for b in held:
                yield pa.array(found[at:at + len(b)], pa.float64())
                at += len(b)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BATCH_ROWS:
                yield from given(held)
                held, n = [], 0
        if n:
            yield from given(held)
        else:
            yield from (pa.array([], pa.float64()) for _ in held)

    return predict


def with_forest_votes(rows: DataFrame, model: RandomForestRegressionModel) -> DataFrame:
    """What `model.transform` gives: `rows` with the model's prediction column."""
    nodes = forest_nodes(model, rows) if model.totalNumNodes <= MOST_NODES and not model.getLeafCol() else None
    if nodes is None:
        return model.transform(rows)
    predict = batch_predictions(rows.sparkSession.sparkContext.broadcast(Forest(nodes)))
    return rows.withColumn(model.getPredictionCol(), predict(vector_to_array(F.col(model.getFeaturesCol()))))
