"""Per-row contributions of linear and tree models, and what is told from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.config import Scorecard
from keepwell.operators.boosting import to_bins
from keepwell.operators.sampling import background_sample

CONTRIBUTIONS = "contributions"


def background_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Feature means over the background sample: one row back."""
    row = background_sample(df.select(cfg.ID, *[F.col(f"`{f}`") for f in features])).agg(*[
        F.avg(F.col(f"`{f}`").cast("double")).alias(f"m{i}")
        for i, f in enumerate(features)]).first()
    return {f: row[f"m{i}"] for i, f in enumerate(features)}


def linear_contributions(df: DataFrame, weights: dict[str, float],
                         means: dict[str, float]) -> DataFrame:
    """Adds array<struct<feature, shap_value>>: weight x (value - background mean)."""
    return df.withColumn(CONTRIBUTIONS, F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 (F.lit(w) * (F.col(f"`{f}`") - F.lit(means[f]))).alias("shap_value"))
        for f, w in weights.items()]))


def scorecard_contributions(df: DataFrame, card: Scorecard = cfg.CHAMPION) -> DataFrame:
    return linear_contributions(df, card.weights, background_means(df, list(card.weights)))


def top_contributors(values: Column, n: int = cfg.TOP_CONTRIBUTORS) -> Column:
    """The n contributions of largest size; equal sizes keep feature order."""
    keyed = F.transform(values, lambda x, i: F.struct(
        (-F.abs(x["shap_value"])).alias("size"), i.alias("at"), x["feature"].alias("feature"),
        x["shap_value"].alias("shap_value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: F.struct(
        x["feature"].alias("feature"), x["shap_value"].alias("shap_value")))


def explanation(top: Column) -> Column:
    """Sentence from the leading contributors."""
    reasons = F.transform(F.slice(top, 1, cfg.SUMMARY_REASONS), lambda x: F.concat(
        F.replace(x["feature"], F.lit("_"), F.lit(" ")),
        F.when(x["shap_value"] > 0, " increases").otherwise(" decreases"),
        F.lit(" churn risk")))
    return F.when(F.size(top) == 0, "Insufficient data to explain churn risk.").otherwise(
        F.concat(F.lit("Why this customer may churn: "), F.array_join(reasons, "; "),
                 F.lit(".")))


def with_explanation(contributed: DataFrame) -> DataFrame:
    """Adds top_contributors and explanation."""
    return contributed.withColumn("top_contributors", top_contributors(F.col(CONTRIBUTIONS))) \
        .withColumn("explanation", explanation(F.col("top_contributors")))


def global_importance(contributed: DataFrame) -> DataFrame:
    """Mean size of each feature's contribution over all rows."""
    return contributed.select(F.explode(CONTRIBUTIONS).alias("c")).groupBy("c.feature") \
        .agg(F.avg(F.abs(F.col("c.shap_value"))).alias("importance"))


# ---- boosted trees -----------------------------------------------------------


def tree_values(x: np.ndarray, model) -> np.ndarray:
    """Path-dependent Shapley values of every row, plus the base value in the last column.

    A leaf pays out its value x product over its features of "row follows the path" (known)
    or the training share (unknown).  The Shapley weights of subsets of size s are integrals of
    t^s (1-t)^(m-1-s) over [0, 1], so a feature's value is (follows - share) x value x the
    integral of the product over the other features of t follows + (1-t) share: a
    polynomial, which Gauss's rule integrates exactly.  The products are carried down the tree
    and their sums up again, once for every node, whatever the number of features on its paths.
    """
    out = np.zeros((len(x), model.numFeatures + 1))
    out[:, -1] = model.start
    bins = to_bins(x, model.cuts)
    for tree in model.trees:
        _tree_values(bins, tree, out)
    return out


def _most_features(tree) -> int:
    """Different features on a path, at most."""
    most, stack = 1, [(0, frozenset())]
    while stack:
        node, used = stack.pop()
        most = max(most, len(used))
        if tree.feature[node] >= 0:
            below = used | {int(tree.feature[node])}
            stack += [(tree.left[node], below), (tree.right[node], below)]
    return most


def _tree_values(bins: np.ndarray, tree, out: np.ndarray) -> None:
    at, weights = np.polynomial.legendre.leggauss((_most_features(tree) + 1) // 2)
    t, weights = (at + 1) / 2, weights / 2
    n = len(bins)

    def below(node: int, product: np.ndarray, path: dict, share: float) -> np.ndarray:
        """Sum over the leaves under a node of value x product, at each point of the rule."""
        f = int(tree.feature[node])
        if f < 0:
            out[:, -1] += tree.value[node] * share
            return tree.value[node] * product
        goes_left = bins[:, f] <= tree.cut[node]
        before = path.get(f)
        total = np.zeros((n, len(t)))
        for child, goes in ((tree.left[node], goes_left), (tree.right[node], ~goes_left)):
            part = float(tree.weight[child] / tree.weight[node])
            follows, own = (goes, part) if before is None else (before[0] & goes, before[1] * part)
            factor = np.where(follows[:, None], t + (1 - t) * own, (1 - t) * own)
            moved = product * factor if before is None else product / before[2] * factor
            sums = below(child, moved, {**path, f: (follows, own, factor)}, share * part)
            out[:, f] += (follows - own) * ((sums / factor) @ weights)
            if before is not None:
                # The condition higher up has counted these leaves with its own factor.
                out[:, f] -= (before[0] - before[1]) * ((sums / before[2]) @ weights)
            total += sums
        return total

    below(0, np.ones((n, len(t))), {}, 1.0)


def tree_contributions(matrix: DataFrame, model, features: Sequence[str],
                       vector: str = "features", keep: Sequence[str] = (cfg.ID,)) -> DataFrame:
    """Kept columns, contributions, base_value and margin per row; contributions
    and base value add up to the margin.
    """
    names, keep = list(features), list(keep)
    kinds = dict(matrix.dtypes)
    parts = SimpleNamespace(cuts=model.cuts, start=model.start, trees=model.trees, numFeatures=model.numFeatures)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                values = tree_values(np.stack(pdf["x"].to_numpy()), parts)
                yield pdf[[*keep, "margin"]].assign(
                    values=list(values[:, :-1]), base_value=values[:, -1])

    scored = model.transform(matrix.select(*keep, vector)).select(
        *keep, vector_to_array(vector).alias("x"),
        (vector_to_array("rawPrediction")[1]).alias("margin"))
    raw = scored.mapInPandas(explain, ", ".join(f"`{c}` {kinds[c]}" for c in keep)
                             + ", margin double, values array<double>, base_value double")
    labels = F.array(*[F.lit(n) for n in names])
    return raw.select(*keep, "margin", "base_value", F.zip_with(
        labels, "values", lambda n, v: F.struct(n.alias("feature"), v.alias("shap_value")))
        .alias(CONTRIBUTIONS))
