"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Computed doubles are brought to six decimals (`micro`) so that they can be
compared with the same query in another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import micro, model_label, select_or_zero
from keepwell.functions.skew import by_shuffle
from keepwell.operators import (
    clean, encode, evaluate, explain, features, newton, profile_state, redact, registry, reports, sampling,
    score, segment, smote, train, validate,
)
from keepwell.operators.encode import Preprocessing
from keepwell.plans import base
from keepwell.plans import train_job as jobs
from keepwell.sources import events, scratch, subscribers
from keepwell.sources.runs import RunStore
from keepwell.streaming import jobs as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Six-decimal doubles, bigint counts as they are."""
    return df.select(*[micro(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


# ---- sources and sinks -------------------------------------------------------


@query
def scan_subscribers(spark, sf_dir):
    path = scratch.scratch_path(spark, "subscribers-csv")
    subscribers.write_csv(base.raw(spark, sf_dir), path)
    return rounded(subscribers.typed(subscribers.read_subscriber_csv(spark, path)))


def _processed_path(spark, sf_dir, partitioned=True):
    path = scratch.scratch_path(spark, "processed")
    writer = base.segmented(spark, sf_dir).drop("cluster_id").write
    (writer.partitionBy("segment") if partitioned else writer).parquet(path)
    return path


@query
def scan_processed(spark, sf_dir):
    path = _processed_path(spark, sf_dir)
    df = subscribers.load_processed(spark, path, base.raw(spark, sf_dir))
    return rounded(df.select(cfg.ID, "segment", "tenure", "MonthlyCharges", "clv_estimate",
                             "churn_probability"))


@query
def roundtrip_processed(spark, sf_dir):
    return rounded(spark.read.parquet(_processed_path(spark, sf_dir, partitioned=False)).select(
        cfg.ID, "tenure_group", *cfg.ENGINEERED_COLUMNS, "churn_probability", "segment"))


@query
def roundtrip_assignments(spark, sf_dir):
    path = scratch.scratch_path(spark, "assignments")
    subscribers.write_csv(base.segmented(spark, sf_dir).select(
        cfg.ID, "segment", "cluster_id", "churn_probability"), path)
    schema = "customerID string, segment string, cluster_id int, churn_probability double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


def _comparison(spark, sf_dir):
    df = base.engineered(spark, sf_dir)
    df = df.withColumn("label", model_label(df)).where("label is not null")
    both = scratch.materialize(df.select("label", F.explode(F.array(*[
        F.struct(F.lit(card.name).alias("model"), score.probability(card).alias("p"))
        for card in (cfg.CHAMPION, cfg.CHALLENGER)])).alias("m")).select(
        "m.model", "label", score.champion_class(F.col("m.p")).alias("prediction"),
        micro(F.col("m.p")).alias("score")), "judged")
    return evaluate.model_comparison(both)


@query
def roundtrip_comparison(spark, sf_dir):
    path = scratch.scratch_path(spark, "comparison")
    subscribers.write_csv(_comparison(spark, sf_dir).coalesce(1), path)
    schema = "model string, accuracy double, precision double, recall double, f1 double, " \
             "roc_auc double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@query
def roundtrip_importance(spark, sf_dir):
    path = scratch.scratch_path(spark, "importance")
    subscribers.write_csv(explain.global_importance(
        explain.scorecard_contributions(base.engineered(spark, sf_dir))), path)
    return rounded(spark.read.schema("feature string, importance double")
                   .option("header", True).csv(path))


def _metadata(spark, sf_dir):
    """Run metadata of the scorecard comparison, written and read back as JSON."""
    comparison = _comparison(spark, sf_dir)
    raw = base.raw(spark, sf_dir)
    best = comparison.orderBy(F.desc("roc_auc"), "model").limit(1)
    shape = validate.table_shape(raw).first()
    meta = best.select(
        F.col("model").alias("best_model_name"),
        F.struct(*[F.floor(F.col(m) * 1e6 + 0.5).alias(m) for m in
                   ("accuracy", "precision", "recall", "f1", "roc_auc")]).alias("metrics"),
        F.struct(*[F.lit(shape[c]).cast("bigint").alias(c) for c in shape.asDict()])
        .alias("validation_report"),
        F.array(*[F.lit(c) for c in cfg.CHAMPION.weights]).alias("feature_columns"))
    path = scratch.scratch_path(spark, "metadata")
    meta.write.json(path)
    return spark.read.schema(meta.schema).json(path)


@query
def run_metadata_json(spark, sf_dir):
    return _metadata(spark, sf_dir).select(
        "best_model_name", "metrics.*", "validation_report.*",
        F.array_join("feature_columns", ",").alias("feature_columns"))


@query
def run_checksum(spark, sf_dir):
    meta = _metadata(spark, sf_dir)
    return jobs.checksum(meta).select("best_model_name", "checksum")


@query
def training_run_log(spark, sf_dir):
    path = scratch.scratch_path(spark, "training-runs")
    comparison = _comparison(spark, sf_dir)
    jobs.metric_rows("run-1", comparison).write.mode("append").parquet(path)
    best = comparison.orderBy(F.desc("roc_auc"), "model").limit(1)
    jobs.metric_rows("run-1", best.withColumn("model", F.lit("champion"))) \
        .write.mode("append").parquet(path)
    return rounded(spark.read.parquet(path))


@query
def roundtrip_model_state(spark, sf_dir):
    """Scores of preparation and model before and after saving both."""
    prep, engineered = base.preprocessed(spark, sf_dir)
    data = train.with_class_weight(train.vectors(prep, engineered).where("label is not null"))
    total = float(data.agg(F.sum("weight")).first()[0])
    model = train.logistic(total).fit(data.select("label", "weight", "features"))
    prep_path = scratch.scratch_path(spark, "prep")
    model_path = scratch.scratch_path(spark, "model")
    prep.save(spark, prep_path)
    model.write().overwrite().save(model_path)
    again = Preprocessing.load(spark, prep_path)
    reloaded = type(model).load(model_path)
    first = score.with_model(train.vectors(prep, engineered), model)
    second = score.with_model(train.vectors(again, engineered), reloaded)
    both = first.select(cfg.ID, F.col("churn_probability").alias("p1")).join(
        by_shuffle(second.select(cfg.ID, F.col("churn_probability").alias("p2"))), cfg.ID)
    return both.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.col("p1") != F.col("p2")).alias("n_changed"))


@query
def publish_run(spark, sf_dir):
    """Publish, fail, publish again: what readers see after each attempt."""
    store = RunStore(spark, scratch.scratch_path(spark, "runs"))
    scored = base.scored(spark, sf_dir)

    def job(fail):
        def write(s, run):
            scored.where("churn_probability >= 0.5" if run == "run-3" else "true") \
                .write.parquet(s.path(run, "processed_customers"))
            if fail:
                raise RuntimeError("job failed after writing")
        return write

    seen = []
    for run_id, fail in (("run-1", False), ("run-2", True), ("run-3", False)):
        try:
            store.run(run_id, job(fail))
        except RuntimeError:
            pass
        seen.append(store.read("processed_customers").agg(
            F.lit(run_id).alias("attempt"), F.lit(store.current()).alias("live_run"),
            F.count(F.lit(1)).alias("live_rows")))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


# ---- profiling and validation ------------------------------------------------


@query
def profile_columns(spark, sf_dir):
    return validate.profile_columns(base.raw(spark, sf_dir)).select(
        "name", "dtype", "semantic_type", "null_count", "unique_count",
        F.array_join("sample_values", "|").alias("samples"))


@query
def table_shape(spark, sf_dir):
    return validate.table_shape(base.raw(spark, sf_dir))


@query
def missing_values(spark, sf_dir):
    return validate.missing_values(base.raw(spark, sf_dir))


@query
def duplicate_ids(spark, sf_dir):
    return validate.duplicate_ids(base.raw_copies(spark, sf_dir))


@query
def duplicate_rows(spark, sf_dir):
    """Whole-row duplicates once load order and the changed charge are left out."""
    return validate.duplicate_rows(
        base.raw_copies(spark, sf_dir).drop("load_seq", "MonthlyCharges"))


@query
def dtype_issues(spark, sf_dir):
    return validate.dtype_issues(base.raw(spark, sf_dir))


@query
def iqr_outliers(spark, sf_dir):
    return rounded(validate.iqr_outliers(base.raw(spark, sf_dir)))


@query
def target_distribution(spark, sf_dir):
    return validate.target_distribution(base.raw(spark, sf_dir))


@query
def critical_issues(spark, sf_dir):
    return validate.critical_issues(base.raw_copies(spark, sf_dir).drop("load_seq"))


@query
def describe_numeric(spark, sf_dir):
    return rounded(validate.describe_numeric(base.raw(spark, sf_dir)))


@query
def describe_text(spark, sf_dir):
    return validate.describe_text(base.raw(spark, sf_dir))


@query
def contract_violations(spark, sf_dir):
    return validate.contract_violations(base.raw(spark, sf_dir)).select(
        cfg.ID, F.array_join("violations", "; ").alias("violations"),
        (F.size("violations") == 0).cast("int").alias("accepted"))


# ---- cleaning ----------------------------------------------------------------


@query
def clean_total_charges(spark, sf_dir):
    return rounded(clean.clean_total_charges(base.raw(spark, sf_dir)).select(
        cfg.ID, "TotalCharges"))


@query
def coerce_numeric(spark, sf_dir):
    return rounded(clean.coerce_numeric(base.raw(spark, sf_dir)).select(
        cfg.ID, *cfg.NUMERIC_COLUMNS))


@query
def dedup_keep_first(spark, sf_dir):
    return rounded(clean.keep_first(base.raw_copies(spark, sf_dir), sequence="load_seq"))


@query
def fit_medians(spark, sf_dir):
    medians = clean.fit_medians(base.raw_copies(spark, sf_dir), sequence="load_seq")
    return rounded(spark.createDataFrame(
        list(medians.items()), "column_name string, median double"))


@query
def clean_subscribers(spark, sf_dir):
    return rounded(base.cleaned(spark, sf_dir))


# ---- features ----------------------------------------------------------------


def _feature_query(name, columns, numbers=True):
    """Only the named features; without `numbers` they need no fitted medians."""
    def run(spark, sf_dir):
        rows = base.engineered(spark, sf_dir) if numbers \
            else features.engineer(clean.prepare(base.raw(spark, sf_dir)))
        return rounded(rows.select(cfg.ID, *columns))
    run.__name__ = name
    return query(run)


_feature_query("tenure_groups", ["tenure", "tenure_group"])
_feature_query("service_counts", ["service_count"], numbers=False)
_feature_query("engagement_scores", ["engagement_score"], numbers=False)
_feature_query("payment_risk", ["payment_risk_score"], numbers=False)
_feature_query("contract_risk", ["Contract", "contract_risk"], numbers=False)
_feature_query("revenue_features",
               ["customer_lifetime_revenue", "avg_monthly_value", "revenue_risk"])
_feature_query("clv_estimates", ["clv_estimate"])
_feature_query("churn_flags", ["is_new_customer", "has_high_charges", "has_no_contract",
                               "has_low_engagement", "churn_propensity_score"])
_feature_query("engineer_features", ["tenure_group", *cfg.ENGINEERED_COLUMNS])


# ---- encoding and scaling ----------------------------------------------------


@query
def encode_binary(spark, sf_dir):
    return encode.encode_binary(base.raw(spark, sf_dir)).select(cfg.ID, *cfg.BINARY_COLUMNS)


@query
def fit_categories(spark, sf_dir):
    found = encode.fit_categories(base.engineered(spark, sf_dir))
    return spark.createDataFrame(
        [(c, i, v) for c, values in found.items() for i, v in enumerate(values)],
        "column_name string, position int, category string")


@query
def encode_onehot(spark, sf_dir):
    df = base.engineered(spark, sf_dir)
    categories = encode.fit_categories(df)
    names = [n for _, _, n in encode.dummy_names(categories)]
    return encode.encode_one_hot(df, categories).select(cfg.ID, *[F.col(f"`{n}`") for n in names])


@query
def align_features(spark, sf_dir):
    """Engineered rows against a fitted list in another order with one unknown name."""
    df = base.engineered(spark, sf_dir).drop("engagement_score")
    wanted = ["clv_estimate", "engagement_score", "tenure", "MonthlyCharges", "service_count"]
    return rounded(select_or_zero(df, wanted, keep=[cfg.ID]))


@query
def scale_features(spark, sf_dir):
    df = base.engineered(spark, sf_dir).select(cfg.ID, *cfg.ENGINEERED_COLUMNS)
    return rounded(encode.scale(df, encode.fit_scale(df, cfg.ENGINEERED_COLUMNS)))


@query
def model_matrix(spark, sf_dir):
    state, engineered = base.preprocessed(spark, sf_dir)
    return rounded(state.matrix(engineered))


# ---- split, resample, tune, train --------------------------------------------


def _labelled_ids(spark, sf_dir):
    raw = base.raw(spark, sf_dir)
    return raw.select(cfg.ID, model_label(raw).alias("label"))


@query
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_labelled_ids(spark, sf_dir))


@query
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(_labelled_ids(spark, sf_dir))


@query
def background_sample(spark, sf_dir):
    return rounded(sampling.background_sample(base.scored(spark, sf_dir)).select(
        cfg.ID, "churn_probability"))


def _minority(spark, sf_dir):
    state, engineered = base.preprocessed(spark, sf_dir)
    return state.matrix(engineered).where("label = 1"), state.features


@query
def smote_knn(spark, sf_dir):
    minority, names = _minority(spark, sf_dir)
    return rounded(smote.neighbor_table(minority, names))


@query
def smote_balance(spark, sf_dir):
    """Class sizes after balancing, and how many new rows leave their segment."""
    state, engineered = base.preprocessed(spark, sf_dir)
    matrix = state.matrix(engineered).where("label is not null")
    balanced = scratch.materialize(smote.balance(matrix, state.features), "balanced")
    cols = [F.col(f"`{c}`") for c in state.features]
    parents = matrix.select(F.col(cfg.ID).alias("parent"), F.array(*cols).alias("x"))
    made = balanced.where("position is not null").select(
        F.col(cfg.ID).alias("a"), F.col("other_parent").alias("b"), "position",
        F.array(*cols).alias("x"))
    placed = made.join(by_shuffle(parents.select(F.col("parent").alias("a"), F.col("x").alias("xa"))), "a") \
        .join(by_shuffle(parents.select(F.col("parent").alias("b"), F.col("x").alias("xb"))), "b")
    off = F.exists(F.zip_with(
        F.zip_with("xa", "xb", lambda p, q: p + F.col("position") * (q - p)), "x",
        lambda want, got: F.abs(want - got) > 1e-9), lambda bad: bad)
    fates = balanced.select("label", F.lit(None).cast("boolean").alias("off")).unionByName(
        placed.select(F.lit(None).cast("int").alias("label"), off.alias("off")))
    return fates.agg(F.count_if(F.col("label") == 0).alias("n_no"),
                     F.count_if(F.col("label") == 1).alias("n_yes"),
                     F.count("off").alias("n_synthetic"),
                     F.count_if(F.col("off")).alias("n_off_segment"))


def _training(spark, sf_dir, budget=None):
    return train.prepare_training(base.raw(spark, sf_dir), budget or train.Budget())


@query
def tuning_grid(spark, sf_dir):
    """The whole published search: every setting of both candidates, with each fold's class sizes."""
    budget = train.Budget()
    settings = [(train.LOGISTIC, i, c, None, None, None, None, None) for i, c in enumerate(cfg.LOGISTIC_C)]
    settings += [(train.GBT, i, None, s["n_estimators"], s["max_depth"], s["learning_rate"], s["num_leaves"], s["subsample"])
                 for i, s in enumerate(train.sampled_grid(budget))]
    grid = spark.createDataFrame(settings, "model string, setting int, c double, n_estimators int, max_depth int, "
                                           "learning_rate double, num_leaves int, subsample double")
    folds = sampling.stratified_folds(_labelled_ids(spark, sf_dir), budget.folds).groupBy("fold").agg(
        F.count_if(F.col("label") == 1).alias("n_yes"), F.count_if(F.col("label") == 0).alias("n_no"))
    every = F.explode(F.sequence(F.lit(0), F.lit(budget.folds - 1)))
    return grid.withColumn("fold", every).join(folds, "fold")


@query
def training_rows(spark, sf_dir):
    """Class and side sizes where later copies turn targets round or lack them: the first record counts."""
    copies = subscribers.subscribers_with_retold_targets(spark, sf_dir)
    _, sides = train.training_rows(copies, sequence="load_seq")
    return sides.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query
def model_invariants(spark, sf_dir):
    """(check_name, n): what must hold of any fit, counted: rows, and violations (0)."""
    data = _training(spark, sf_dir)
    total = float(data.train.agg(F.sum("weight")).first()[0])
    linear, trees = train.logistic(total).fit(data.train), train.gbt().fit(data.train)
    rows = train.scored_rows(linear, data.test, train.LOGISTIC).unionByName(
        train.scored_rows(trees, data.test, train.GBT))
    parts = [rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("holdout rows of "), "model").alias("check_name"), "n"),
        rows.agg(F.count_if(~F.col("score").between(0, 1) | ((F.col("score") > 0.5) != (F.col("prediction") == 1))).alias("n"))
        .select(F.lit("scores off").alias("check_name"), "n")]
    # At the optimum the weighted residuals balance the penalty, feature by feature.
    residual = F.col("weight") * (F.col("p") - F.col("label")) / total
    moved = linear.transform(data.train).withColumn("p", vector_to_array("probability")[1]) \
        .select(residual.alias("r"), vector_to_array("features").alias("x"))
    at = moved.select("r", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("r") * F.col("v")).alias("g"))
    pull = spark.createDataFrame([(i, float(w) / total) for i, w in enumerate(linear.coefficients)], "i int, pull double")
    parts.append(at.join(pull, "i").agg(F.count_if(F.abs(F.col("g") + F.col("pull")) > 1e-3).alias("n"))
                 .select(F.lit("gradient off").alias("check_name"), "n"))
    for name, model in ((train.LOGISTIC, linear), (train.GBT, trees)):
        auc = evaluate.roc_auc(rows.where(F.col("model") == name).select("label", "prediction", "score"))
        parts.append(auc.agg(F.count_if(F.col("roc_auc") < 0.7).alias("n"))
                     .select(F.lit(f"auc of {name} below 0.7").alias("check_name"), "n"))
        weights = train.native_importance(model, data.prep.features, spark)
        parts.append(weights.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"features of {name}").alias("check_name"), "n"))
        parts.append(weights.agg(F.count_if(F.col("importance") < 0).alias("n")).select(
            F.lit(f"negative importances of {name}").alias("check_name"), "n"))
    parts.append(train.native_importance(trees, data.prep.features, spark).agg(
        (F.abs(F.sum("importance") - 1) > 1e-9).cast("bigint").alias("n")).select(
        F.lit("importances off one").alias("check_name"), "n"))
    tables = jobs.evaluation_tables(trees, train.GBT, data.test, data.prep.features)
    parts.append(tables["confusion_matrix"].agg(F.sum("n").alias("n")).select(F.lit("rows of the matrix").alias("check_name"), "n"))
    parts.append(tables["permutation_importance"].agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("permuted features").alias("check_name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def kmeans_invariants(spark, sf_dir):
    """Rows, segments in use, and rows that lie nearer to another centre than to their own (0)."""
    df = scratch.materialize(base.scored(spark, sf_dir).select(cfg.ID, *cfg.SEGMENT_FEATURES), "scored")
    fitted = segment.Segmentation.fit(df)
    scaled = encode.scale(fitted.assign(df).select(cfg.ID, "cluster_id", *cfg.SEGMENT_FEATURES), fitted.scaling)
    distance = lambda c: sum((F.col(f) - F.lit(float(x))) ** 2 for f, x in zip(cfg.SEGMENT_FEATURES, c))
    each = [distance(c) for c in fitted.centers]
    own = F.element_at(F.array(*each), F.col("cluster_id") + 1)
    return scaled.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"),
                      F.count_if(own > F.least(*each) + 1e-9).alias("n_off"))


@query
def score_without_ids(spark, sf_dir):
    """Records scored by whether they have an id: anonymous ones are as many as came in."""
    raw = base.raw(spark, sf_dir)
    half = raw.withColumn(cfg.ID, F.when(F.col("gender") == "Male", F.col(cfg.ID)))
    scored = score.predict_batch(features.engineer(clean.fit_clean(half)[1]))
    return scored.groupBy(F.col(cfg.ID).isNull().cast("int").alias("anonymous")).agg(
        F.count(F.lit(1)).alias("n"), F.count("churn_probability").alias("n_scored"))


@query
def validation_report(spark, sf_dir):
    return rounded(validate.validation_report(base.raw(spark, sf_dir)))


@query
def profile_state_invariants(spark, sf_dir):
    """(check_name, n): the merged state of five loads against the whole table: rows, and violations (0)."""
    raw = scratch.materialize(base.raw(spark, sf_dir), "profiled")
    loads = [profile_state.profile_state(raw.where(F.pmod(F.xxhash64(cfg.ID), F.lit(5)) == i), f"load-{i}") for i in range(5)]
    states = loads[0]
    for more in (*loads[1:], loads[2]):  # the third load comes twice
        states = states.unionByName(more)
    merged = profile_state.describe_state(profile_state.merged_state(scratch.materialize(states, "states")))
    whole = validate.profile_columns(raw).select(F.col("name").alias("column_name"), "null_count", "unique_count")
    exact = validate.describe_numeric(raw).select("column_name", "n", F.col("mean").alias("true_mean"), F.col("std").alias("true_std"),
                                                  F.col("min").alias("true_min"), F.col("max").alias("true_max"))
    both = merged.join(whole, "column_name").join(exact, "column_name", "left")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > 1e-9 * (1 + F.abs(F.col(b)))
    checks = {"nulls off": F.col("nulls") != F.col("null_count"),
              "distinct counts off": F.abs(F.col("n_distinct") - F.col("unique_count")) > 4 * profile_state.DISTINCT_ERROR * F.col("unique_count") + 1,
              "numbers off": F.col("numbers") != F.coalesce("n", F.lit(0)),
              "moments off": off("mean", "true_mean") | off("std", "true_std"),
              "extremes off": (F.col("min") != F.col("true_min")) | (F.col("max") != F.col("true_max"))}
    one = both.agg(F.max("n_rows").alias("rows"), F.count(F.lit(1)).alias("columns"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    # Share of a column's numbers at or below each sketched quartile, and strictly below.
    have = [c for c in cfg.NUMERIC_COLUMNS if c in raw.columns]
    places = merged.where("numbers > 0").select("column_name", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(n).alias("at")) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])).alias("q"))
    values = raw.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), validate.number(raw, c).alias("x")) for c in have])).alias("v")).select("v.*").where("x IS NOT NULL")
    ranks = values.join(F.broadcast(places), "column_name").groupBy("column_name", "q").agg(
        F.avg((F.col("x") <= F.col("q.at")).cast("double")).alias("upto"), F.avg((F.col("x") < F.col("q.at")).cast("double")).alias("below"))
    bad = F.count_if((F.col("upto") < F.col("q.p") - profile_state.RANK_ERROR) | (F.col("below") > F.col("q.p") + profile_state.RANK_ERROR))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n")) for n in one.columns])).alias("c")).select("c.*")
    return rows.unionByName(ranks.agg(F.lit("quartiles off").alias("check_name"), bad.alias("n")))


@query
def tuning_results(spark, sf_dir):
    budget = train.Budget()
    data = _training(spark, sf_dir, budget=budget)
    tuned = train.tune(data.train, budget)
    return spark.createDataFrame(
        [(t.name, str(sorted(s.items())), float(auc), budget.folds, budget.settings, list(budget.trees)) for t in tuned.values()
         for s, auc in t.results],
        "model string, settings string, mean_auc double, folds int, sampled_settings int, trees array<int>")


@query
def search_invariants(spark, sf_dir):
    """(check_name, n): what must hold of any search, counted: settings tried, and violations (0)."""
    budget = train.Budget()
    data = _training(spark, sf_dir, budget=budget)
    tuned = train.tune(data.train, budget)
    checks = []
    for t in tuned.values():
        scores = [auc for _, auc in t.results]
        checks += [(f"settings of {t.name}", len(scores)), (f"scores of {t.name} not above chance", sum(not 0.5 < x <= 1 for x in scores)),
                   (f"better settings of {t.name} than the chosen", sum(x > dict((str(s), a) for s, a in t.results)[str(t.params)] for x in scores))]
    # Every line of the search stands where its objective is flat.
    lines = newton.fit_all(data.train, [(c, fold) for c in cfg.LOGISTIC_C for fold in range(budget.folds)])
    checks += [("lines", len(lines)), ("lines off the optimum", sum(line.slope > 1e-6 for line in lines))]
    trees = tuned[train.GBT]
    checks += [("trees off their number", abs(len(trees.model.trees) - trees.params["n_estimators"])),
               ("trees with too many leaves", sum(int((t.feature < 0).sum()) > trees.params["num_leaves"] for t in trees.model.trees))]
    rows = train.scored_rows(trees.model, data.test, train.GBT)
    counted = rows.agg(F.lit("holdout rows").alias("check_name"), F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(a, int(b)) for a, b in checks], "check_name string, n long").unionByName(counted)


@query
def fit_logistic(spark, sf_dir):
    data = _training(spark, sf_dir)
    total = float(data.train.agg(F.sum("weight")).first()[0])
    model = train.logistic(total).fit(data.train)
    return train.scored_rows(model, data.test, train.LOGISTIC)


@query
def fit_gbt(spark, sf_dir):
    data = _training(spark, sf_dir)
    return train.scored_rows(train.gbt().fit(data.train), data.test, train.GBT)


@query
def train_job(spark, sf_dir):
    store = RunStore(spark, scratch.scratch_path(spark, "store"))
    budget = train.Budget()
    jobs.train_job(spark, base.raw(spark, sf_dir), store, budget)
    searched = {"folds": budget.folds, "sampled_settings": budget.settings, "trees": max(budget.trees)}
    return store.read("training_runs").select("model", "metric", "value", *[F.lit(v).alias(k) for k, v in searched.items()])


# ---- evaluation --------------------------------------------------------------


def _judged_query(name, operator):
    def run(spark, sf_dir):
        return rounded(operator(base.judged(spark, sf_dir)))
    run.__name__ = name
    return query(run)


_judged_query("classification_metrics", evaluate.classification_metrics)
_judged_query("roc_auc", evaluate.roc_auc)
_judged_query("confusion_matrix", evaluate.confusion_matrix)
_judged_query("roc_curve", evaluate.roc_curve)
_judged_query("pr_curve", evaluate.pr_curve)
_judged_query("classification_report", evaluate.classification_report)


@query
def model_comparison(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir))


@query
def permutation_importance(spark, sf_dir):
    df = base.engineered(spark, sf_dir)
    return rounded(evaluate.permutation_importance(df.withColumn("label", model_label(df))))


def _fitted_gbt(spark, sf_dir):
    prep, engineered = base.preprocessed(spark, sf_dir)
    vectors = train.vectors(prep, engineered)
    labelled = train.with_class_weight(vectors.where("label is not null"))
    return train.gbt().fit(labelled.select(cfg.ID, "label", "weight", "features")), prep, vectors


@query
def native_importance(spark, sf_dir):
    model, prep, _ = _fitted_gbt(spark, sf_dir)
    return train.native_importance(model, prep.features, spark)


@query
def evaluation_tables(spark, sf_dir):
    """All tables about a fitted champion, as (table, rows)."""
    model, prep, vectors = _fitted_gbt(spark, sf_dir)
    tables = jobs.evaluation_tables(
        model, train.GBT, scratch.materialize(vectors.where("label is not null").select(
            cfg.ID, "label", "features"), "champion-rows"), prep.features)
    parts = [t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
             for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- scoring and retention ---------------------------------------------------


@query
def score_customers(spark, sf_dir):
    return rounded(base.scored(spark, sf_dir).select(cfg.ID, "churn_probability"))


@query
def predict_batch(spark, sf_dir):
    return rounded(score.predict_batch(base.engineered(spark, sf_dir)))


@query
def predict_single(spark, sf_dir):
    """The record of one requested customer, under medians of the whole table."""
    raw = base.raw(spark, sf_dir)
    medians = clean.fit_medians(raw)
    one = reports.customer_lookup(raw, "Customer#000000042")
    out = score.predict_batch(
        features.engineer(clean.clean(one, medians)), challenger=cfg.CHALLENGER)
    return rounded(out.select(
        *[c for c in out.columns if c != "challenger_prediction"],
        F.col("challenger_prediction.model_name").alias("challenger_model"),
        F.col("challenger_prediction.churn_probability").alias("challenger_probability"),
        F.col("challenger_prediction.prediction").alias("challenger_class")))


@query
def shadow_scores(spark, sf_dir):
    return rounded(score.shadow_scores(base.engineered(spark, sf_dir)))


@query
def shadow_agreement(spark, sf_dir):
    return rounded(score.shadow_agreement(score.shadow_scores(base.engineered(spark, sf_dir))))


@query
def risk_tiers(spark, sf_dir):
    return rounded(score.tier_report(score.with_retention(base.scored(spark, sf_dir))))


@query
def retention_actions(spark, sf_dir):
    return rounded(score.with_retention(base.scored(spark, sf_dir)).select(
        cfg.ID, "risk_level", "retention_strategy", "retention_cost", "success_rate",
        "expected_revenue_saved"))


# ---- segmentation ------------------------------------------------------------


@query
def segment_features(spark, sf_dir):
    return rounded(segment.segment_features(base.scored(spark, sf_dir)).select(
        cfg.ID, *cfg.SEGMENT_FEATURES))


@query
def segment_features_scaled(spark, sf_dir):
    df = segment.segment_features(base.scored(spark, sf_dir)).select(
        cfg.ID, *cfg.SEGMENT_FEATURES)
    return rounded(encode.scale(df, encode.fit_scale(df, cfg.SEGMENT_FEATURES)))


@query
def kmeans_segments(spark, sf_dir):
    df = scratch.materialize(
        base.scored(spark, sf_dir).select(cfg.ID, *cfg.SEGMENT_FEATURES), "scored")
    fitted = segment.Segmentation.fit(df)
    return rounded(fitted.assign(df))


def _profiles(spark, sf_dir):
    return segment.cluster_profiles(base.segmented(spark, sf_dir))


@query
def cluster_profiles(spark, sf_dir):
    return rounded(_profiles(spark, sf_dir))


@query
def segment_label_scores(spark, sf_dir):
    return rounded(segment.label_scores(_profiles(spark, sf_dir)).drop("priority"))


@query
def segment_label_mapping(spark, sf_dir):
    scores = segment.label_scores(_profiles(spark, sf_dir))
    return segment.mapping_table(spark, segment.label_mapping(scores))


@query
def assign_segments(spark, sf_dir):
    return rounded(base.segmented(spark, sf_dir).select(cfg.ID, "cluster_id", "segment"))


# ---- decisions ---------------------------------------------------------------


def _runs(spark, sf_dir):
    """The numbered run log, written as the table it would be."""
    return scratch.materialize(events.training_runs(spark, sf_dir), "runs")


def _settings(runs):
    """Stored thresholds, one per line, from the line's first event on."""
    return runs.where("seq = 1").select(
        "line", "seq", ((F.col("line") % 8 + 1) / F.lit(1000.0)).alias("value"))


@query
def promotion_decisions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return rounded(registry.promotion_decisions(runs, _settings(runs)))


@query
def promotion_replay(spark, sf_dir):
    return rounded(registry.replay(_runs(spark, sf_dir)).select(*registry.HISTORY))


@query
def current_roles(spark, sf_dir):
    return registry.current_roles(registry.replay(_runs(spark, sf_dir)))


@query
def registry_status(spark, sf_dir):
    """Each line's roles, stored threshold, number of accepted entries and last ten actions."""
    runs = _runs(spark, sf_dir)
    settings = _settings(runs)
    return rounded(registry.status(registry.replay(runs, settings), settings))


@query
def recent_promotions(spark, sf_dir):
    return rounded(registry.recent_promotions(
        registry.replay(_runs(spark, sf_dir))))


# ---- explanations ------------------------------------------------------------


def _explained(spark, sf_dir):
    return explain.scorecard_contributions(base.engineered(spark, sf_dir))


@query
def linear_contributions(spark, sf_dir):
    return rounded(_explained(spark, sf_dir).select(
        cfg.ID, F.explode(explain.CONTRIBUTIONS).alias("c")).select(cfg.ID, "c.*"))


@query
def top_contributors(spark, sf_dir):
    top = explain.with_explanation(_explained(spark, sf_dir))
    return rounded(top.select(cfg.ID, F.posexplode("top_contributors").alias("p", "c")).select(
        cfg.ID, (F.col("p") + 1).alias("rank"), "c.feature", "c.shap_value"))


@query
def explanation_text(spark, sf_dir):
    return explain.with_explanation(_explained(spark, sf_dir)).select(cfg.ID, "explanation")


@query
def global_importance(spark, sf_dir):
    return rounded(evaluate.top_features(explain.global_importance(_explained(spark, sf_dir))))


@query
def top_features(spark, sf_dir):
    return rounded(evaluate.top_features(
        explain.global_importance(_explained(spark, sf_dir)), n=3))


@query
def tree_contributions(spark, sf_dir):
    model, prep, vectors = _fitted_gbt(spark, sf_dir)
    return explain.tree_contributions(vectors, model, prep.features).select(
        cfg.ID, "margin", "base_value", F.explode(explain.CONTRIBUTIONS).alias("c")) \
        .select(cfg.ID, "margin", "base_value", "c.*")


@query
def tree_contributions_sum(spark, sf_dir):
    """Rows, and rows whose contributions and base value miss the margin."""
    model, prep, vectors = _fitted_gbt(spark, sf_dir)
    made = explain.tree_contributions(vectors, model, prep.features)
    total = F.aggregate(
        explain.CONTRIBUTIONS, F.col("base_value"), lambda a, c: a + c["shap_value"])
    return made.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.abs(total - F.col("margin")) > 1e-9).alias("n_off"))


# ---- reports -----------------------------------------------------------------


@query
def executive_kpis(spark, sf_dir):
    return rounded(reports.executive_kpis(base.scored(spark, sf_dir)))


@query
def top_risk_customers(spark, sf_dir):
    df = base.segmented(spark, sf_dir)
    return rounded(reports.top_risk(
        df.withColumn("churn_probability", micro(F.col("churn_probability")))))


@query
def customer_lookup(spark, sf_dir):
    return rounded(reports.customer_lookup(base.raw(spark, sf_dir), "Customer#000000042"))


@query
def first_customers(spark, sf_dir):
    return reports.first_customers(base.raw(spark, sf_dir))


@query
def high_risk_lookup(spark, sf_dir):
    """Records of many requested ids at once: those of the high-risk customers."""
    wanted = base.scored(spark, sf_dir).where(
        F.col("churn_probability") >= cfg.HIGH_RISK_THRESHOLD)
    return rounded(reports.customers_lookup(base.raw(spark, sf_dir), wanted))


@query
def segment_clv(spark, sf_dir):
    return rounded(reports.segment_clv(base.segmented(spark, sf_dir)))


@query
def segment_counts(spark, sf_dir):
    return reports.counts_by(base.segmented(spark, sf_dir), "segment")


@query
def churn_counts(spark, sf_dir):
    return reports.counts_by(base.raw(spark, sf_dir), cfg.TARGET)


@query
def tenure_charge_bins(spark, sf_dir):
    return reports.tenure_charge_bins(base.segmented(spark, sf_dir))


# ---- privacy -----------------------------------------------------------------


@query
def mask_columns(spark, sf_dir):
    df = score.with_retention(base.scored(spark, sf_dir)).select(
        *cfg.RAW_COLUMNS, "risk_level", "retention_strategy", "retention_cost")
    return redact.redact_record(df)


@query
def mask_nested(spark, sf_dir):
    """Nested request payloads: masked by field name at any depth, text inside too."""
    raw = base.raw(spark, sf_dir)
    payload = raw.select(
        F.struct(cfg.ID, "gender", F.concat(
            F.lit("seen tenure="), F.col("tenure").cast("string")).alias("note")).alias("request"),
        F.array(F.struct("Contract", F.lit("kept").alias("tag"))).alias("items"),
        F.md5(cfg.ID).alias("ref"))
    masked = redact.redact_record(payload)
    return masked.select("ref", F.to_json("request").alias("request"),
                         F.to_json("items").alias("items"))


@query
def redact_text(spark, sf_dir):
    lines = events.log_lines(subscribers.table(spark, sf_dir, "events"))
    return redact.redact_log(lines).select("event_id", "msg")


# ---- streams -----------------------------------------------------------------


def _landed(spark, sf_dir):
    path = scratch.scratch_path(spark, "landing")
    base.raw(spark, sf_dir).repartition(cfg.ID).write.parquet(path)
    return path


def _files_per_batch(spark):
    """Arriving files are as many as shuffle partitions; a batch takes what the cores read at once."""
    return max(1, spark.sparkContext.defaultParallelism)


@query
def stream_score(spark, sf_dir):
    medians = clean.fit_medians(base.raw(spark, sf_dir))
    out, progress = (scratch.scratch_path(spark, n) for n in ("scored", "score-progress"))
    records = streaming.read_records(spark, _landed(spark, sf_dir), files_per_batch=_files_per_batch(spark))
    streaming.score_stream(
        records, streaming.scorecard_predictor(medians), out, progress).awaitTermination()
    got = streaming.read_batches(spark, out)
    return rounded(got.select(
        *[c for c in got.columns if c != "challenger_prediction"],
        F.col("challenger_prediction.churn_probability").alias("challenger_probability"),
        F.col("challenger_prediction.prediction").alias("challenger_class")))


@query
def stream_quarantine(spark, sf_dir):
    """Arriving records that break the request contract, and what they break."""
    medians = clean.fit_medians(base.raw(spark, sf_dir))
    out, progress, aside = (scratch.scratch_path(spark, n) for n in ("scored", "score-progress", "quarantine"))
    records = streaming.read_records(spark, _landed(spark, sf_dir), files_per_batch=_files_per_batch(spark))
    streaming.score_stream(records, streaming.scorecard_predictor(medians), out, progress,
                           quarantine=aside).awaitTermination()
    return streaming.read_batches(spark, aside).select(cfg.ID, F.array_join("violations", "; ").alias("violations"))


def _event_stream(spark, sf_dir):
    schema = subscribers.table(spark, sf_dir, "events").schema
    return streaming.read_records(spark, sf_dir, schema, pattern="events.parquet")


@query
def stream_redact(spark, sf_dir):
    out, progress = (scratch.scratch_path(spark, n) for n in ("redacted", "redact-progress"))
    streaming.redact_stream(_event_stream(spark, sf_dir), out, progress).awaitTermination()
    return spark.read.parquet(out).select("event_id", "msg")


def _minute_text(df):
    return df.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query
def quota_breaches(spark, sf_dir):
    limit = cfg.QUOTAS_PER_MINUTE["train"]
    return _minute_text(streaming.quota_breaches(
        subscribers.table(spark, sf_dir, "events"), limit))


@query
def stream_quota(spark, sf_dir):
    out, progress = (scratch.scratch_path(spark, n) for n in ("quota", "quota-progress"))
    streaming.quota_stream(_event_stream(spark, sf_dir), out, progress).awaitTermination()
    return _minute_text(streaming.quota_breaches_of(
        streaming.read_batches(spark, out), cfg.QUOTAS_PER_MINUTE["train"]))

