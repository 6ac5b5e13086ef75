"""Predictions of a published run: probabilities, records, explanations, segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import registry, reports, score, train
from keepwell.operators.boosting import BoostedTreesModel
from keepwell.operators.encode import Preprocessing
from keepwell.operators.explain import CONTRIBUTIONS, with_explanation
from keepwell.operators.segment import Segmentation
from keepwell.operators.validate import split_by_contract
from keepwell.plans.train_job import contributions, latest_decision, serving_model
from keepwell.sources.runs import RunStore
from keepwell.sources.subscribers import path_exists

_KINDS = {registry.FIRST: LogisticRegressionModel, registry.SECOND: BoostedTreesModel}


@dataclass
class Predictor:
    """Everything a published run needs to serve."""

    prep: Preprocessing
    champion_name: str
    champion: object
    challenger_name: str | None
    challenger: object | None
    segments: Segmentation | None
    means: dict[str, float]

    @classmethod
    def load(cls, store: RunStore) -> Predictor:
        name, path = serving_model(store)
        run = store.current()
        last = latest_decision(store)
        rival = None
        if last is not None:
            rival = last["challenger"] if last["new_champion"] == name else None
        rival_path = store.path(run, f"models/{rival}")
        has_rival = rival is not None and path_exists(store.spark, rival_path)
        segment_path = store.path(run, "segmentation")
        return cls(
            Preprocessing.load(store.spark, store.path(run, "preprocessing")),
            name, _KINDS[name].load(path),
            rival if has_rival else None, _KINDS[rival].load(rival_path) if has_rival else None,
            Segmentation.load(store.spark, segment_path)
            if path_exists(store.spark, segment_path) else None,
            {r["feature"]: r["mean"] for r in store.read("background").collect()})

    def scored(self, raw: DataFrame, sequence: str | None = None) -> DataFrame:
        """Scaled features, their vector, `_row` (the engineered row) and the probability."""
        vectors = train.vectors(self.prep, self.prep.engineered(raw, sequence))
        return score.with_model(vectors, self.champion)

    def predict_proba(self, raw: DataFrame, sequence: str | None = None) -> DataFrame:
        return self.scored(raw, sequence).select(cfg.ID, "churn_probability")

    def predict_requests(self, raw: DataFrame, include_explanation: bool = False, shadow: bool = False,
                         sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(predictions of the records that keep the request contract, the others with their violations)."""
        accepted, quarantined = split_by_contract(raw)
        return self.predict_batch(accepted, include_explanation, shadow, sequence), quarantined

    def predict_batch(self, raw: DataFrame, include_explanation: bool = False,
                      shadow: bool = False, sequence: str | None = None) -> DataFrame:
        """One record per customer and each anonymous record; features are computed once for all parts."""
        rows = self.scored(raw, sequence).withColumn("clv_estimate", F.col("_row.clv_estimate"))
        carried = [cfg.ID, "churn_probability", "clv_estimate"]
        if shadow and self.challenger is not None:
            rows = score.with_model(rows, self.challenger, "_challenger_p")
            carried.append("_challenger_p")
        if include_explanation:
            rows = with_explanation(contributions(
                self.champion, rows, self.prep.features, self.means, keep=carried)) \
                .drop(CONTRIBUTIONS)
            carried += ["explanation", "top_contributors"]
        acted = score.with_retention(rows.select(*carried))
        columns = [cfg.ID, F.lit(self.champion_name).alias("served_by_model"),
                   "churn_probability", "risk_level", "retention_strategy", "retention_cost",
                   "expected_revenue_saved", F.col("clv_estimate").alias("clv")]
        columns += [c for c in carried if c in ("explanation", "top_contributors")]
        if "_challenger_p" in carried:
            columns.append(score.shadow(self.challenger_name, F.col("_challenger_p")))
        return acted.select(*columns)

    def kpis(self, raw: DataFrame, sequence: str | None = None) -> DataFrame:
        """The dashboard's figures of raw records: what they lack, the model and the features supply."""
        return reports.executive_kpis(self.scored(raw, sequence).select("_row.*", "churn_probability"))

    def get_segment(self, raw: DataFrame) -> DataFrame | None:
        """Engineered rows with probability, cluster and segment; None without segments."""
        if self.segments is None:
            return None
        return self.segments.assign(self.scored(raw).select("_row.*", "churn_probability"))
