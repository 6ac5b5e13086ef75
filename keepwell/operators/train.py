"""Candidate models, tuning, and the end-to-end training job."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import model_label
from keepwell.functions.ordered import hash_rank
from keepwell.functions.skew import by_shuffle
from keepwell.operators import boosting, evaluate, newton, registry
from keepwell.operators.clean import keep_first
from keepwell.operators.encode import Preprocessing
from keepwell.operators.sampling import seeded_hash, stratified_folds, stratified_split
from keepwell.operators.smote import balance
from keepwell.sources.scratch import materialize

LOGISTIC, GBT = registry.FIRST, registry.SECOND

#: Dealt pairs whose margins a task holds at once, for every tree.
PAIRS = 2000


@dataclass(frozen=True)
class Budget:
    """How much tuning to do: by default the whole published search.

    A smaller one is named by the caller; `trees` then replaces the grid's numbers
    of trees, so that no two settings come to the same fit.  What was searched is
    part of the tuning results.
    """

    folds: int = cfg.CV_FOLDS
    settings: int = cfg.SEARCH_SETTINGS
    trees: tuple[int, ...] = tuple(cfg.GBT_GRID["n_estimators"])


def assemble(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the feature vector; an unknown binary value counts as the mean (0 when scaled)."""
    filled = matrix.fillna(0.0, subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


def vectors(prep: Preprocessing, engineered: DataFrame) -> DataFrame:
    """Scaled features and their vector, with the engineered row kept as `_row`.

    Row by row, so scores stay with their record and need no join.
    """
    kept = engineered.withColumn("_row", F.struct("*"))
    return assemble(prep.matrix(kept, keep=("_row",)), prep.features)


def with_class_weight(df: DataFrame) -> DataFrame:
    """Adds weight n / (2 n_class) as literals of the class sizes."""
    sizes = {r["label"]: r["n"] for r in
             df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    expr = F
    for label, n in sizes.items():
        expr = expr.when(F.col("label") == label, total / (len(sizes) * n))
    return df.withColumn("weight", expr.otherwise(1.0))


def logistic(total_weight: float, c: float = 1.0) -> LogisticRegression:
    """Balanced, L2-penalised; C is the inverse penalty against the summed loss."""
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", standardization=False,
        maxIter=cfg.LOGISTIC_MAX_ITER, regParam=1.0 / (c * total_weight))


def gbt(trees: int = cfg.GBT_GRID["n_estimators"][0], depth: int = 3, step: float = 0.1, subsample: float = 1.0,
        leaves: int = 31, key: str | None = cfg.ID) -> boosting.BoostedTrees:
    return boosting.BoostedTrees(boosting.Setting(depth, leaves, step, subsample), trees, key)


def setting_of(s: dict) -> boosting.Setting:
    """What tells one fit from another: numbers of trees are prefixes of the same fit."""
    return boosting.Setting(s["max_depth"], s["num_leaves"], s["learning_rate"], s["subsample"])


def sampled_grid(budget: Budget) -> list[dict]:
    """The boosted trees' settings that a search tries."""
    axes = {**cfg.GBT_GRID, "n_estimators": budget.trees}
    grid = [dict(zip(axes, combo)) for combo in itertools.product(*axes.values())]
    return random.Random(cfg.SEED).sample(grid, min(budget.settings, len(grid)))


@dataclass
class Tuned:
    name: str
    model: object
    params: dict
    results: list[tuple] = field(default_factory=list)  # (settings, mean AUC)


def tune(train: DataFrame, budget: Budget, names: Sequence[str] = (LOGISTIC, GBT)) \
        -> dict[str, Tuned]:
    """Cross-validated search per candidate: all its settings and folds are fitted together.

    `train` holds the id, label, weight, fold and features.  A setting's score is the mean AUC
    of the folds that have both classes; ties go to the first setting.
    """
    searches = {LOGISTIC: _search_logistic, GBT: _search_trees}
    return {name: searches[name](train, budget) for name in names}


def _best(options: list[dict], found: dict[int, list[float]]) -> tuple[int, list[tuple]]:
    results = [(s, sum(found[i]) / len(found[i]) if found.get(i) else float("nan")) for i, s in enumerate(options)]
    return max(range(len(options)), key=lambda i: (results[i][1] == results[i][1], results[i][1], -i)), results


def _search_logistic(train: DataFrame, budget: Budget) -> Tuned:
    each = [(i, c, fold) for i, c in enumerate(cfg.LOGISTIC_C) for fold in range(budget.folds)]
    lines = newton.fit_all(train, [(c, fold) for _, c, fold in each])
    found: dict[int, list[float]] = {}
    for r in evaluate.roc_auc(newton.held_out(train, lines), by=["fit"]).collect():
        if r["roc_auc"] is not None:
            found.setdefault(each[r["fit"]][0], []).append(r["roc_auc"])
    options = [{"C": c} for c in cfg.LOGISTIC_C]
    best, results = _best(options, found)
    total = float(train.agg(F.sum("weight")).first()[0])
    return Tuned(LOGISTIC, logistic(total, options[best]["C"]).fit(train), options[best], results)


def _search_trees(train: DataFrame, budget: Budget) -> Tuned:
    options = sampled_grid(budget)
    stops: dict[boosting.Setting, set[int]] = {}
    for s in options:
        stops.setdefault(setting_of(s), set()).add(s["n_estimators"])
    fits = [boosting.Fit(s, fold, tuple(sorted(at))) for s, at in stops.items() for fold in range(budget.folds)]
    cuts = boosting.bin_cuts(train)
    scores, _ = boosting.fit_all(boosting.binned(train, cuts, cfg.ID), fits, max(map(len, cuts)) + 1)
    found: dict[int, list[float]] = {}
    for (m, trees), value in sorted(scores.items()):
        for i, s in enumerate(options):
            if value is not None and (setting_of(s), s["n_estimators"]) == (fits[m].setting, trees):
                found.setdefault(i, []).append(value)
    best, results = _best(options, found)
    chosen = options[best]
    return Tuned(GBT, boosting.BoostedTrees(setting_of(chosen), chosen["n_estimators"], cfg.ID).fit(train), chosen, results)


def scored_rows(model, data: DataFrame, name: str) -> DataFrame:
    """(model, key, label, prediction, score) of a fitted candidate."""
    return model.transform(data).select(
        F.lit(name).alias("model"), cfg.ID, "label", F.col("prediction").cast("int"),
        vector_to_array("probability")[1].alias("score"))


def native_importance(model, features: Sequence[str], spark) -> DataFrame:
    """|coefficient|, or a feature's share of all gains and its number of splits: one row per feature."""
    values = getattr(model, "featureImportances", None)
    values = values.toArray() if values is not None else abs(model.coefficients.toArray())
    splits = model.splitCounts.toArray() if hasattr(model, "splitCounts") else [None] * len(values)
    return spark.createDataFrame(
        [(f, float(v), None if n is None else int(n)) for f, v, n in zip(features, values, splits)],
        "feature string, importance double, splits long").orderBy(F.desc("importance"), "feature")


def permutation_importance(model, data: DataFrame, features: Sequence[str],
                           repeats: int = cfg.PERMUTATION_REPEATS, key: str = cfg.ID) -> DataFrame:
    """Mean accuracy drop of a fitted model per feature.

    Each repeat deals the rows out in a seeded hash order.  A task takes each dealt pair once, changes one
    value after the other, and works out again only what the value has a part in: its term of a
    line, the trees that split on it.  Only numbers of hits leave the task, one a feature.
    """
    rows = data.select(key, "label", vector_to_array("features").alias("x"))
    base = hash_rank(rows.withColumn("_hash", seeded_hash(key)), [], "_hash", key, out="_rank")
    each = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    targets = base.select("_rank", "label", "x").withColumn("repeat", each)
    dealt = rows.select(key, F.col("x").alias("new")).withColumn("repeat", each).withColumn(
        "_hash", F.md5(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit("|deal|"),
                                F.col("repeat").cast("string"))))
    donors = hash_rank(dealt, ["repeat"], "_hash", key, out="_rank").select(
        "repeat", "_rank", "new")
    pairs = targets.join(by_shuffle(donors), ["repeat", "_rank"]).select(F.col("label").cast("int"), "x", "new")
    change = changed_margins(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Place 0 is the untouched row: the baseline comes from the same pass.
        hits, n = np.zeros(len(features) + 1, np.int64), 0
        for batch in batches:
            for first in range(0, batch.num_rows, PAIRS):
                part = batch.slice(first, PAIRS)
                x, new = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("x", "new"))
                label = part.column("label").to_numpy() == 1
                n += len(label)
                for at, margin in enumerate(change(x, new)):
                    hits[at] += int(((margin > 0) == label).sum())
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(hits)), pa.int32()), "hits": pa.array(hits), "n": pa.array([n] * len(hits), pa.int64())})

    scored = pairs.mapInArrow(count, "at int, hits long, n long").groupBy("at").agg(
        (F.sum("hits") / F.sum("n")).alias("accuracy"))
    names = F.array(*[F.lit(f) for f in features])
    whole = F.max(F.when(F.col("at") == 0, F.col("accuracy"))).over(Window.partitionBy())
    return scored.withColumn("_base", whole).where("at > 0").select(
        F.get(names, F.col("at") - 1).alias("feature"),
        (F.col("_base") - F.col("accuracy")).alias("importance"))


def changed_margins(model) -> Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]:
    """A function of rows and their donors: margins of the rows, then with each feature's value taken from the donor."""
    if isinstance(model, boosting.BoostedTreesModel):
        cuts, start, trees = model.cuts, model.start, model.trees
        using = [[t for t, tree in enumerate(trees) if (tree.feature == f).any()] for f in range(len(cuts))]

        def of_trees(x: np.ndarray, new: np.ndarray) -> Iterator[np.ndarray]:
            own, other = boosting.to_bins(x, cuts), boosting.to_bins(new, cuts)
            values = [tree.value[tree.leaves_of(own)] for tree in trees]
            total = start + sum(values, np.zeros(len(x)))
            yield total
            for f, some in enumerate(using):
                # Rows whose bin is the donor's stay in their leaves.
                moved, margin = np.flatnonzero(own[:, f] != other[:, f]), total.copy()
                changed = own[moved]
                changed[:, f] = other[moved, f]
                for t in some if len(moved) else ():
                    margin[moved] += trees[t].value[trees[t].leaves_of(changed)] - values[t][moved]
                yield margin
        return of_trees
    weights, intercept = model.coefficients.toArray(), float(model.intercept)

    def of_line(x: np.ndarray, new: np.ndarray) -> Iterator[np.ndarray]:
        total = x @ weights + intercept
        yield total
        for f, w in enumerate(weights):
            yield total + w * (new[:, f] - x[:, f])
    return of_line


@dataclass
class TrainData:
    """What training starts from: fitted preparation, scaled rows split in two."""

    prep: Preprocessing
    matrix: DataFrame      # key, label, features as columns, is_test
    train: DataFrame       # label, weight, fold, features vector (balanced)
    test: DataFrame        # key, label, features vector


def training_rows(raw: DataFrame, sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, sides): one record per customer, and label and is_test of each labelled one.

    The record is chosen once, as a whole and in load order (`sequence`), so label,
    split and features are all of the same row.
    """
    records = materialize(keep_first(raw, sequence=sequence).drop(*([sequence] if sequence else [])),
                          "records")
    named = records.where(F.col(cfg.ID).isNotNull())
    sides = stratified_split(named.select(cfg.ID, model_label(named).alias("label")))
    return records, materialize(sides, "split")


def prepare_training(raw: DataFrame, budget: Budget, fit_scope: str = "train",
                     smote: bool = True, sequence: str | None = None) -> TrainData:
    """Split, fit the preparation, balance, weight and fold.

    fit_scope "train" fits the preparation on training rows only; "all" fits it
    on every row before the split.
    """
    if fit_scope not in ("train", "all"):
        raise ValueError("fit_scope is 'train' or 'all'")
    records, sides = training_rows(raw, sequence)
    sides = sides.select(cfg.ID, "is_test")
    fit_on = records if fit_scope == "all" else records.join(
        by_shuffle(sides.where("is_test = 0")), cfg.ID, "left_semi")
    prep = Preprocessing.fit(fit_on)
    matrix = materialize(prep.transform(records).join(by_shuffle(sides), cfg.ID), "matrix")
    train_rows = matrix.where("is_test = 0").drop("is_test")
    filled = train_rows.fillna(0.0, subset=prep.features)
    balanced = balance(filled, prep.features) if smote else filled.withColumns(
        {"other_parent": F.lit(None).cast("string"), "position": F.lit(None).cast("double")})
    # Synthetic rows need their own key for the fold order.
    keyed = balanced.withColumn("_row", F.concat_ws(
        "|", F.col(cfg.ID), "other_parent", F.col("position").cast("string")))
    folded = stratified_folds(keyed, budget.folds, key="_row")
    train = materialize(assemble(with_class_weight(folded), prep.features).select(
        F.col("_row").alias(cfg.ID), "label", "weight", "fold", "features"), "train")
    test = materialize(assemble(matrix.where("is_test = 1"), prep.features).select(
        cfg.ID, "label", "features"), "test")
    return TrainData(prep, matrix, train, test)


def holdout_comparison(tuned: dict[str, Tuned], test: DataFrame) -> DataFrame:
    """Metrics of every candidate on the holdout, one row per model."""
    parts = [scored_rows(t.model, test, t.name) for t in tuned.values()]
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    return evaluate.model_comparison(everything)


def utc_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
