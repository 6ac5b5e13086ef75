"""Customer segments: k-means clusters, their profiles and their business names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import kmeans
from keepwell.operators.encode import fit_scale
from keepwell.sources.scratch import materialize

_SCALED = "_scaled_"


def segment_features(df: DataFrame) -> DataFrame:
    """Adds what is missing of the five measures as 0 and fills nulls with 0."""
    have = set(df.columns)
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
        for c in cfg.SEGMENT_FEATURES})


def with_scaled(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        _SCALED + c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaling.items()})


def nearest_center(centers: list[list[float]]) -> Column:
    """Number of the nearest center over the scaled columns; ties go to the lower number."""
    options = []
    for i, center in enumerate(centers):
        d2 = F.lit(0.0)
        for c, v in zip(cfg.SEGMENT_FEATURES, center):
            diff = F.col(_SCALED + c) - F.lit(float(v))
            d2 = d2 + diff * diff
        options.append(F.struct(d2.alias("d2"), F.lit(i).alias("id")))
    return F.array_min(F.array(*options))["id"] if len(options) > 1 else F.lit(0)


def cluster_profiles(assigned: DataFrame) -> DataFrame:
    """Mean of the five measures per cluster."""
    return assigned.groupBy("cluster_id").agg(
        *[F.avg(c).alias(c) for c in cfg.SEGMENT_FEATURES])


def label_scores(profiles: DataFrame) -> DataFrame:
    """How well each cluster fits each label; thresholds come from all profiles.

    `profiles` has one row per cluster, so the window over all of it is k rows.
    """
    everyone = Window.partitionBy()
    at = {"clv_p60": ("clv_estimate", 0.6), "charge_p50": ("MonthlyCharges", 0.5),
          "charge_p40": ("MonthlyCharges", 0.4)}
    p = profiles.withColumns({n: F.percentile(F.col(c), F.lit(q)).over(everyone)
                              for n, (c, q) in at.items()})
    churn, charges = F.col("churn_probability"), F.col("MonthlyCharges")

    def points(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(0.0)

    rules = {
        "High Value Loyal": points(F.col("clv_estimate") >= F.col("clv_p60"), 2.0)
        + points(churn <= 0.35, 2.0) + points(F.col("tenure") >= 24, 1.5),
        "High Risk High Revenue": points(churn >= 0.55, 2.5)
        + points(charges >= F.col("charge_p50"), 2.0),
        "Low Revenue Churners": points(churn >= 0.45, 2.0)
        + points(charges <= F.col("charge_p40"), 2.0),
        "New At Risk": points(F.col("tenure") < 12, 3.0) + points(churn >= 0.4, 1.5),
        "Stable Customers": F.lit(1.0) + F.greatest(F.lit(0.0), F.lit(0.5) - churn),
    }
    return p.select("cluster_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("priority"), F.lit(name).alias("label"), score.alias("score"))
        for i, (name, score) in enumerate(rules.items())])).alias("r")) \
        .select("cluster_id", "r.priority", "r.label", "r.score")


def label_mapping(scores: DataFrame, k: int = cfg.N_CLUSTERS) -> dict[int, str]:
    """One label per cluster: labels choose in priority order, the lowest cluster
    wins a tie, only positive scores count; what is left is matched in order, and
    every cluster number below k gets a label.  At most k x labels rows come back.
    """
    rows = scores.orderBy("priority", F.desc("score"), "cluster_id").collect()
    free = {r["cluster_id"] for r in rows}
    if not free:
        return {}
    mapping: dict[int, str] = {}
    left = list(cfg.SEGMENT_LABELS)
    for label in cfg.SEGMENT_LABELS:
        best = next((r for r in rows if r["label"] == label and r["cluster_id"] in free
                     and r["score"] > 0), None)
        if best is not None:
            mapping[best["cluster_id"]] = label
            free.remove(best["cluster_id"])
            left.remove(label)
    absent = [c for c in range(k) if c not in mapping and c not in free]
    for cluster in [*sorted(free), *absent]:
        mapping[cluster] = left.pop(0) if left else cfg.FALLBACK_SEGMENT
    return mapping


@dataclass
class Segmentation:
    """Fitted segments: scaling, centers (in scaled units) and names."""

    scaling: dict[str, tuple[float, float]] = field(default_factory=dict)
    centers: list[list[float]] = field(default_factory=list)
    mapping: dict[int, str] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, k: int = cfg.N_CLUSTERS, starts: int = cfg.KMEANS_STARTS,
            seed: int = cfg.SEED) -> Segmentation:
        """Best of several k-means runs; clusters are numbered by sorted center."""
        prepared = segment_features(df).select(*cfg.SEGMENT_FEATURES)
        scaling = fit_scale(prepared, cfg.SEGMENT_FEATURES)
        columns = [_SCALED + c for c in cfg.SEGMENT_FEATURES]
        # Rows of equal features are told apart by their id where there is one.
        told = [c for c in (*cfg.SEGMENT_FEATURES, cfg.ID) if c in df.columns or c in cfg.SEGMENT_FEATURES]
        marked = with_scaled(segment_features(df), scaling).select(*columns, F.xxhash64(*told).alias(kmeans.MARK))
        found = kmeans.fit(materialize(marked, "segment-rows"), columns, k, starts, seed)
        centers = sorted(min(found, key=lambda f: f[0])[1])
        fitted = cls(scaling, centers)
        fitted.mapping = label_mapping(label_scores(cluster_profiles(fitted.clusters(df))), k)
        return fitted

    @classmethod
    def from_centroids(cls, df: DataFrame, centroids, k: int = cfg.N_CLUSTERS) -> Segmentation:
        """Centers given in raw units; only scaling and names are fitted."""
        scaling = fit_scale(segment_features(df).select(*cfg.SEGMENT_FEATURES),
                            cfg.SEGMENT_FEATURES)
        centers = [[(x - scaling[c][0]) / scaling[c][1]
                    for c, x in zip(cfg.SEGMENT_FEATURES, row)] for row in centroids]
        fitted = cls(scaling, centers)
        fitted.mapping = label_mapping(label_scores(cluster_profiles(fitted.clusters(df))), k)
        return fitted

    def clusters(self, df: DataFrame) -> DataFrame:
        """Adds cluster_id; all column expressions."""
        prepared = with_scaled(segment_features(df), self.scaling)
        found = prepared.withColumn("cluster_id", nearest_center(self.centers))
        return found.drop(*[_SCALED + c for c in cfg.SEGMENT_FEATURES])

    def segment_name(self) -> Column:
        expr = F
        for cluster, label in sorted(self.mapping.items()):
            expr = expr.when(F.col("cluster_id") == cluster, label)
        return expr.otherwise(cfg.FALLBACK_SEGMENT) if self.mapping \
            else F.lit(cfg.FALLBACK_SEGMENT)

    def assign(self, df: DataFrame) -> DataFrame:
        return self.clusters(df).withColumn("segment", self.segment_name())

    # -- persistence: one small table ------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("scaling", i, c, None, [m, s]) for i, (c, (m, s)) in
                enumerate(self.scaling.items())]
        rows += [("center", i, None, None, c) for i, c in enumerate(self.centers)]
        rows += [("segment", i, None, label, None) for i, label in self.mapping.items()]
        spark.createDataFrame(
            rows, "kind string, id int, name string, label string, numbers array<double>"
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Segmentation:
        out = cls()
        for r in spark.read.parquet(path).orderBy("id").collect():
            if r["kind"] == "scaling":
                out.scaling[r["name"]] = tuple(r["numbers"])
            elif r["kind"] == "center":
                out.centers.append(list(r["numbers"]))
            else:
                out.mapping[r["id"]] = r["label"]
        return out


def mapping_table(spark: SparkSession, mapping: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "cluster_id int, segment string")
