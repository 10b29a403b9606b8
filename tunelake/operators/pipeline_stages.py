"""The surrogate as one saved ML pipeline: raw samples in, predicted costs out.

`KnobFeatures` holds the catalogue with its order and ranges, `CostScale` the range of the
throughput; the models stand between them. All of it is saved and loaded as a
`PipelineModel`, so whoever scores needs neither the catalogue nor the range again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.catalog import Knob
from tunelake.functions.scaling import denormalize, negative_cost
from tunelake.operators.surrogate import assemble_features


class KnobFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the features of samples with complete counters: normalised knobs in the order of the catalogue, then the counters.

    Samples with fewer or more counters are left out, as for a fit.
    """

    catalog = Param(Params._dummy(), "catalog", "knobs as JSON lists: name, type, min, max, default", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "name of the feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, catalog: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def knobs(self) -> list[Knob]:
        return [Knob(*k) for k in json.loads(self.getOrDefault(self.catalog))]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ready = assemble_features(dataset, self.knobs())
        return ready.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.col("features")))


class CostScale(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`, the unweighted mean of the models' predictions, and `predicted_cost`, on the throughput scale and negative."""

    inputCols = Param(Params._dummy(), "inputCols", "predictions of the models", TypeConverters.toListString)
    low = Param(Params._dummy(), "low", "throughput at 0", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "throughput at 1", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, low: float | None = None, high: float | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getOrDefault(self.inputCols)
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        cost = denormalize(F.col("prediction"), F.lit(self.getOrDefault(self.low)), F.lit(self.getOrDefault(self.high)))
        return dataset.withColumn("prediction", mean).withColumn("predicted_cost", negative_cost(cost))


def surrogate_pipeline(catalog: Sequence[Knob], models: Sequence[Model], lo: float, hi: float) -> PipelineModel:
    """Fitted models with what they need before and after them; `write().save(path)` keeps all of it."""
    features = KnobFeatures(catalog=json.dumps([list(k) for k in catalog]))
    scale = CostScale(inputCols=[m.getPredictionCol() for m in models], low=float(lo), high=float(hi))
    return PipelineModel([features, *models, scale])
