"""Model quality: counts, curves, rank statistics, importances.

Input rows carry `label` (0/1), `prediction` (0/1) and `score`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.config import Scorecard
from keepwell.functions.ordered import RANGE, cut_points, hash_rank, running, with_range
from keepwell.functions.skew import by_shuffle
from keepwell.operators.sampling import seeded_hash
from keepwell.operators.score import champion_class, logistic, margin
from keepwell.sources.scratch import materialize


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _outcome_counts() -> list[Column]:
    y, p = F.col("label"), F.col("prediction")
    return [F.count_if((y == a) & (p == b)).alias(name)
            for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def classification_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall and f1 from one aggregation."""
    counts = df.groupBy(*by).agg(*_outcome_counts())
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _score_steps(df: DataFrame, by: Sequence[str], descending: bool) -> DataFrame:
    """Distinct scores with their class counts and the running class counts.

    Rows are counted per score first; the running totals are then made range
    by range, so neither a frequent score nor the whole order meets in a task.
    """
    cuts = cut_points(df, ["score"])["score"]
    steps = with_range(df, "score", cuts).groupBy(*by, RANGE, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return running(steps, by, ["score"], descending=descending,
                   sums={"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs ranked right; ties count half."""
    steps = _score_steps(df, by, descending=False)
    beaten = F.col("neg_upto") - F.col("neg") + F.col("neg") / F.lit(2.0)
    sums = steps.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * beaten).alias("_wins"),
        F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))
    return sums.select(*by, F.when(
        F.col("_p") * F.col("_n") > 0, F.col("_wins") / (F.col("_p") * F.col("_n")))
        .alias("roc_auc"))


def _class_totals(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col("label") == 1).alias("p"),
                 F.count_if(F.col("label") == 0).alias("n")).first()
    return row["p"], row["n"]


def roc_curve(df: DataFrame) -> DataFrame:
    """One point per distinct score, from high to low, after the start (0, 0)."""
    pos, neg = _class_totals(df)
    points = _score_steps(df, [], descending=True).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("neg_upto"), F.lit(neg)).alias("fpr"),
        _ratio(F.col("pos_upto"), F.lit(pos)).alias("tpr"))
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall per distinct score, and the end (recall 0, precision 1)."""
    pos, _ = _class_totals(df)
    points = _score_steps(df, [], descending=True).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto")).alias("precision"),
        _ratio(F.col("pos_upto"), F.lit(pos)).alias("recall"))
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def confusion_matrix(df: DataFrame) -> DataFrame:
    """All four (label, prediction) cells, empty ones as 0."""
    one = df.agg(*_outcome_counts())
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(c).alias("n"))
        for c, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ])).alias("r")).select("r.*")


def classification_report(df: DataFrame) -> DataFrame:
    """Per class, accuracy, macro and weighted average rows, from one aggregation."""
    one = df.agg(*_outcome_counts())
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n0, n1 = tn + fp, tp + fn
    total = n0 + n1
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, n0), _ratio(2 * tn, 2 * tn + fn + fp)
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, n1), _ratio(2 * tp, 2 * tp + fp + fn)
    acc = _ratio(tp + tn, total)

    def row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), n.alias("support"))

    def mean(a: Column, b: Column) -> Column:
        return (a + b) / F.lit(2.0)

    def weighted(a: Column, b: Column) -> Column:
        return _ratio(a * n0 + b * n1, total)

    return one.select(F.explode(F.array(
        row("0", p0, r0, f0, n0), row("1", p1, r1, f1, n1), row("accuracy", acc, acc, acc, total),
        row("macro avg", mean(p0, p1), mean(r0, r1), mean(f0, f1), total),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
    )).alias("r")).select("r.*")


def model_comparison(df: DataFrame) -> DataFrame:
    """The five metrics per model, best ROC-AUC first, missing last."""
    return classification_metrics(df, ["model"]).join(roc_auc(df, ["model"]), "model") \
        .orderBy(F.desc_nulls_last("roc_auc"), "model")


def permutation_importance(engineered: DataFrame, card: Scorecard = cfg.CHAMPION,
                           repeats: int = cfg.PERMUTATION_REPEATS,
                           key: str = cfg.ID) -> DataFrame:
    """Mean accuracy drop per feature when its values are dealt out anew.

    A repeat deals the rows in the order of a seeded key hash: the row of rank
    r receives the values of the row of rank r in that order.  Ranks are made
    range by range and joined on (repeat, rank), which is unique on both
    sides, so no key is hot.  A linear model only needs the changed term.
    """
    features = list(card.weights)
    rows = materialize(engineered.where(F.col("label").isNotNull()).select(
        key, "label", margin(card).alias("_margin"), *features), "permutation-rows")
    base = hash_rank(rows.withColumn("_hash", seeded_hash(key)), [], "_hash", key, out="_rank")
    targets = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) \
        .select("repeat", "_rank", "label", "_margin", *features)
    dealt = rows.select(key, *[F.col(f).alias(f"_new_{f}") for f in features]) \
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))) \
        .withColumn("_hash", F.md5(F.concat(
            F.coalesce(F.col(key), F.lit("")), F.lit("|deal|"), F.col("repeat").cast("string"))))
    donors = hash_rank(dealt, ["repeat"], "_hash", key, out="_rank") \
        .select("repeat", "_rank", *[f"_new_{f}" for f in features])
    pairs = targets.join(by_shuffle(donors), ["repeat", "_rank"])

    def right(m: Column) -> Column:
        return F.avg((champion_class(logistic(m)) == F.col("label")).cast("double"))

    moved = [right(F.col("_margin") + F.lit(card.weights[f]) * (F.col(f"_new_{f}") - F.col(f)))
             for f in features]
    one = pairs.agg(right(F.col("_margin")).alias("_base"),
                    *[m.alias(f"_m_{f}") for f, m in zip(features, moved)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col("_base") - F.col(f"_m_{f}")).alias("importance"))
        for f in features])).alias("r")).select("r.*")


def top_features(importance: DataFrame, n: int = cfg.TOP_FEATURES) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
