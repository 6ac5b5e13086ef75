"""The fitted preparation as Spark ML Estimator and Model: for pipelines, cross-validation and ML persistence.

`PreparationEstimator` fits medians, categories and scaling on the raw records it is given, so a
cross-validator's folds each fit their own.  The model turns raw records, of a table or a stream's batch,
into id, label and feature vector; its state is saved as the tables of `Preprocessing`.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators.encode import Preprocessing
from keepwell.operators.train import assemble, with_class_weight


class PreparationEstimator(Estimator, MLWritable, MLReadable):
    """Fits a `PreparationModel`; has no settings."""

    def _fit(self, dataset: DataFrame) -> "PreparationModel":
        return PreparationModel(Preprocessing.fit(dataset))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class PreparationModel(Model, MLWritable, MLReadable):
    """Raw records to (id, label, weight, features); weights balance the labels of the rows given, unlabelled rows weigh 1."""

    def __init__(self, state: Preprocessing | None = None) -> None:
        super().__init__()
        self.state = state or Preprocessing()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = assemble(self.state.transform(dataset), self.state.features).select(cfg.ID, "label", "features")
        # A stream's frame can't be counted ahead.
        return rows.withColumn("weight", F.lit(1.0)) if dataset.isStreaming else _weighted(rows)

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


def _weighted(rows: DataFrame) -> DataFrame:
    known = rows.where("label IS NOT NULL")
    return with_class_weight(rows) if not known.isEmpty() else rows.withColumn("weight", F.lit(1.0))


class _StateWriter(MLWriter):
    def __init__(self, instance: PreparationModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.state.save(self.sparkSession, f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PreparationModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(Preprocessing.load(self.sparkSession, f"{path}/state"))
        model._resetUid(metadata["uid"])
        return model
