"""The training job: prepare, balance, tune, decide, evaluate, score, segment, publish."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import evaluate, registry, score, train, validate
from keepwell.operators.explain import (
    CONTRIBUTIONS, background_means, global_importance, linear_contributions, tree_contributions)
from keepwell.operators.segment import Segmentation, mapping_table
from keepwell.sources.keyed import write_keyed
from keepwell.sources.runs import RunStore, utc_now
from keepwell.sources.scratch import materialize
from keepwell.sources.subscribers import path_exists, write_csv

METADATA_SCHEMA = """run_id string, trained_at string, best_model_name string,
  champion string, challenger string, action string, delta double,
  metrics map<string,double>, best_params string, feature_columns array<string>,
  row_count bigint, column_count bigint, critical_issues array<string>"""


def metric_rows(run_id: str, comparison: DataFrame) -> DataFrame:
    """(run_id, model, metric, value) rows of a comparison table."""
    metrics = [c for c in comparison.columns if c != "model"]
    return comparison.select(F.lit(run_id).alias("run_id"), "model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics
    ])).alias("m")).select("run_id", "model", "m.metric", "m.value")


def evaluation_tables(model, name: str, test: DataFrame, features: list[str],
                      repeats: int = cfg.PERMUTATION_REPEATS) -> dict[str, DataFrame]:
    """Everything reported about the champion on the holdout."""
    rows = train.scored_rows(model, test, name)
    return {
        "classification_report": evaluate.classification_report(rows),
        "confusion_matrix": evaluate.confusion_matrix(rows),
        "roc_curve": evaluate.roc_curve(rows),
        "pr_curve": evaluate.pr_curve(rows),
        "feature_importance": train.native_importance(model, features, test.sparkSession),
        "permutation_importance": train.permutation_importance(
            model, test, features, repeats).orderBy(F.desc("importance"), "feature"),
    }


def contributions(model, vectors: DataFrame, features: list[str], means: dict[str, float],
                  keep: Sequence[str] = (cfg.ID,)) -> DataFrame:
    """Kept columns and per-row contributions of whichever candidate it is."""
    if hasattr(model, "trees"):
        return tree_contributions(vectors, model, features, keep=keep) \
            .select(*keep, CONTRIBUTIONS)
    weights = dict(zip(features, (float(w) for w in model.coefficients.toArray())))
    return linear_contributions(vectors, weights, means).select(*keep, CONTRIBUTIONS)


def read_metadata(store: RunStore, run_id: str) -> DataFrame:
    return store.spark.read.schema(METADATA_SCHEMA).json(store.path(run_id, "model_metadata"))


def checksum(metadata: DataFrame) -> DataFrame:
    """md5 of the whole metadata row as JSON text."""
    return metadata.withColumn(
        "checksum", F.md5(F.to_json(F.struct(*[F.col(c) for c in metadata.columns]))))


def train_job(spark: SparkSession, raw: DataFrame, store: RunStore,
              budget: train.Budget | None = None, fit_scope: str = "train",
              repeats: int = cfg.PERMUTATION_REPEATS, starts: int = cfg.KMEANS_STARTS,
              threshold: float | None = None, sequence: str | None = None,
              fail_on_critical: bool = False) -> str:
    """Train, decide, write every output under a new run and publish it.

    `sequence` names the column of load order, by which a customer's first record
    is chosen.  Without `threshold` the store's own promotion threshold holds, then
    the configured one.  The validation report is an output of the run; with
    `fail_on_critical` its critical issues end the run before anything is trained.
    """
    budget = budget or train.Budget()
    trained: list = []

    def job(s: RunStore, run: str) -> dict:
        """Everything that follows from the store's state; done again where another commit came between, but for the training."""
        bar = promotion_threshold(s) if threshold is None else threshold
        records = raw.drop(sequence) if sequence else raw
        issues = [r["issue"] for r in validate.critical_issues(records).collect()]
        validate.validation_report(records).write.parquet(s.path(run, "validation_report"))
        if fail_on_critical and issues:
            raise ValueError("Data validation failed: " + "; ".join(issues))
        shape = validate.table_shape(records).first()
        if not trained:
            data = train.prepare_training(raw, budget, fit_scope, sequence=sequence)
            tuned = train.tune(data.train, budget)
            trained.extend([data, tuned, materialize(train.holdout_comparison(tuned, data.test), "comparison")])
        data, tuned, comparison = trained
        features = data.prep.features
        metrics = {r["model"]: {m: r[m] for m in comparison.columns if m != "model"}
                   for r in comparison.collect()}

        last = latest_decision(s)
        decision = registry.decide(last["new_champion"] if last else None, metrics, bar)
        champion = tuned[decision["champion"]]
        entry = {"seq": last["seq"] + 1 if last else 1, "action": decision["action"], "previous_champion": decision["previous_champion"],
                 "new_champion": decision["champion"], "challenger": decision["challenger"], "champion_metric": decision["champion_metric"],
                 "challenger_metric": decision["challenger_metric"], "delta": decision["delta"], "decided_at": utc_now(), "run_id": run,
                 "threshold": bar, "new_champion_metrics": metrics[decision["champion"]], "challenger_metrics": metrics[decision["challenger"]]}

        for name, table in evaluation_tables(
                champion.model, champion.name, data.test, features, repeats).items():
            table.write.parquet(s.path(run, f"evaluation/{name}"))
        for t in tuned.values():
            t.model.write().overwrite().save(s.path(run, f"models/{t.name}"))
        data.prep.save(spark, s.path(run, "preprocessing"))
        write_csv(comparison.coalesce(1), s.path(run, "model_comparison"))

        # Read three times below: scores, background means, contributions.
        vectors = materialize(
            train.vectors(data.prep, data.prep.engineered(raw, sequence)).select(
                cfg.ID, "label", "features", "_row", *features), "vectors")
        probable = materialize(
            score.with_model(vectors, champion.model).select("_row.*", "churn_probability"),
            "scored")
        segments = Segmentation.fit(probable, starts=starts)
        segments.save(spark, s.path(run, "segmentation"))
        means = background_means(vectors, features)
        spark.createDataFrame(list(means.items()), "feature string, mean double").coalesce(1) \
            .write.parquet(s.path(run, "background"))
        mapping_table(spark, segments.mapping).coalesce(1).write.json(
            s.path(run, "segment_mapping"))
        assigned = segments.assign(probable)
        write_csv(assigned.select(cfg.ID, "segment", "cluster_id", "churn_probability"),
                  s.path(run, "segment_assignments"))
        write_keyed(assigned.drop("cluster_id"), s.path(run, "processed_customers"), cfg.ID, "segment")
        global_importance(contributions(champion.model, vectors, features, means)) \
            .write.parquet(s.path(run, "evaluation/shap_importance"))

        metric_rows(run, comparison).unionByName(metric_rows(run, comparison.where(
            F.col("model") == champion.name).withColumn("model", F.lit("champion")))) \
            .coalesce(1).write.parquet(s.path(run, "training_runs"))
        spark.createDataFrame(
            [(run, run, champion.name, decision["champion"], decision["challenger"],
              decision["action"], decision["delta"], metrics[champion.name],
              json.dumps(champion.params, sort_keys=True), features, shape["row_count"],
              shape["column_count"], issues)],
            METADATA_SCHEMA).coalesce(1).write.json(s.path(run, "model_metadata"))
        return {"entries": [entry]}

    return store.run(train.utc_stamp(), job)


def promotion_history(store: RunStore) -> DataFrame:
    """Decisions of all published runs, rollbacks and imported entries: every entry is one row."""
    return store.commits().select(F.explode("entries").alias("entry")).select("entry.*")


def set_promotion_threshold(store: RunStore, value: float) -> None:
    """Store the threshold that later runs decide by."""
    store.log.append(lambda _: {"at": utc_now(), "threshold": float(value)})


def promotion_threshold(store: RunStore) -> float:
    """The stored threshold, else the configured one."""
    row = store.commits().where("threshold IS NOT NULL").orderBy(F.desc("version")).limit(1).collect()
    return row[0]["threshold"] if row else cfg.PROMOTION_THRESHOLD


def registry_status(store: RunStore) -> DataFrame:
    """One row: roles, their metrics, times, the threshold in force, and the last ten entries, oldest first."""
    history = promotion_history(store)
    last = history.orderBy(F.desc("seq")).limit(1)
    changed = history.where("action IN ('initial', 'promote', 'manual_rollback')") \
        .agg(F.max("decided_at").alias("promoted_at"))
    trained = history.where("run_id IS NOT NULL").agg(F.max("decided_at").alias("trained_at"))
    newest = history.orderBy(F.desc("seq")).limit(10).agg(F.sort_array(F.collect_list(
        F.struct("seq", "decided_at", "action", "previous_champion", "new_champion", "delta"))).alias("recent"))
    # Four frames of one row each.
    return last.select(F.col("new_champion").alias("champion"), "challenger", F.col("new_champion_metrics").alias("champion_metrics"),
                       "challenger_metrics", F.lit(promotion_threshold(store)).alias("threshold")) \
        .withColumn("_one", F.lit(1)).join(changed.withColumn("_one", F.lit(1)), "_one") \
        .join(trained.withColumn("_one", F.lit(1)), "_one").join(newest.withColumn("_one", F.lit(1)), "_one").drop("_one")


def import_legacy_registry(store: RunStore, path: str) -> int:
    """Take the entries and the threshold of an old registry into an empty store; returns the number of entries."""
    history, threshold = read_legacy_registry(store.spark, path)
    # An old registry is one small file; its entries become one commit.
    rows = history.withColumn("decided_at", F.date_format("decided_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).orderBy("seq").collect()
    entries = [{**r.asDict(), "challenger": r["previous_champion"] if r["new_champion"] != r["previous_champion"] else None,
                "threshold": threshold} for r in rows]

    def make(version: int) -> dict:
        if latest_decision(store) is not None:
            raise ValueError("the store has a history already")
        return {"at": utc_now(), "entries": entries, "threshold": threshold}

    store.log.append(make)
    return len(entries)


def latest_decision(store: RunStore):
    row = promotion_history(store).orderBy(F.desc("seq")).limit(1).collect()
    return row[0] if row else None


def rollback(store: RunStore) -> dict:
    """Swap champion and challenger without training; one more history row, made from the newest one."""
    made: dict = {}

    def make(version: int) -> dict:
        last = latest_decision(store)
        if last is None:
            raise ValueError("Cannot rollback before champion and challenger are initialized")
        metric = {r["model"]: r["value"] for r in store.read("training_runs").where(
            F.col("metric") == cfg.PRIMARY_METRIC).collect()}
        champion, challenger = last["challenger"], last["new_champion"]
        made.update({"seq": last["seq"] + 1, "action": "manual_rollback", "previous_champion": challenger, "new_champion": champion,
                     "challenger": challenger, "champion_metric": metric[champion], "challenger_metric": metric[challenger],
                     "delta": metric[challenger] - metric[champion], "decided_at": utc_now(), "run_id": None, "threshold": last["threshold"],
                     "new_champion_metrics": last["challenger_metrics"], "challenger_metrics": last["new_champion_metrics"]})
        return {"at": utc_now(), "entries": [made]}

    store.log.append(make)
    return {"action": "manual_rollback", "champion": made["new_champion"], "challenger": made["challenger"], "delta": made["delta"]}


def serving_model(store: RunStore) -> tuple[str, str]:
    """(model name, path) to serve: the champion by history if its files exist,
    else the one the run's metadata names."""
    run_id = store.current()
    if run_id is None:
        raise FileNotFoundError("nothing published yet")
    last = latest_decision(store)
    name = last["new_champion"] if last else None
    if name is None or not path_exists(store.spark, store.path(run_id, f"models/{name}")):
        name = read_metadata(store, run_id).first()["best_model_name"]
    return name, store.path(run_id, f"models/{name}")


LEGACY_SCHEMA = """promotion_threshold double, history array<struct<timestamp:string,action:string,
  previous_champion:string,new_champion:string,champion_metric:double,challenger_metric:double,
  delta:double>>"""


def read_legacy_registry(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """History rows and promotion threshold of an old registry kept as one JSON file."""
    payload = spark.read.schema(LEGACY_SCHEMA).option("multiLine", True).json(path)
    stored = payload.select("promotion_threshold").first()["promotion_threshold"]
    history = payload.select(F.posexplode("history").alias("at", "h")).select(
        (F.col("at") + 1).cast("bigint").alias("seq"),
        F.to_timestamp("h.timestamp").alias("decided_at"), "h.action", "h.previous_champion",
        "h.new_champion", "h.champion_metric", "h.challenger_metric", "h.delta")
    return history, cfg.PROMOTION_THRESHOLD if stored is None else stored
