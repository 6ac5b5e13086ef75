"""Rows whose margin is exactly 0: what rounding leaves of it must not decide the class."""

from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.operators import evaluate, score

NAMES = ["customerID", *cfg.CHAMPION.weights]


def test_bounds(spark):
    # By hand: -2.5 + 2.7 + 1 - 0.6 - 0.4 - 0.2 = 0, and -2.2 + 2.1 + 1.8 - 2.03 + 0.81 - 0.48 = 0.
    rows = [("champion", 3, 2.0, 15.0, 45.0, 2.0), ("challenger", 3, 3.0, 58.0, 110.0, 4.0), ("above", 3, 2.0, 15.0, 45.01, 2.0)]
    df = spark.createDataFrame(rows, NAMES)
    got = {r.customerID: r for r in score.shadow_scores(df).collect()}
    assert [got[n].prediction for n in ("champion", "above")] == [0, 1]
    assert got["challenger"].challenger_prediction == 1
    judged = score.with_scorecard(df).withColumn("label", F.lit(1)).select(
        "label", score.champion_class(F.col("churn_probability")).alias("prediction"))
    cells = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(judged).collect()}
    assert cells[1, 1] == 1 and cells[1, 0] == 2
    answer = df.select("customerID", score.shadow("c", score.probability(cfg.CHALLENGER))).where("customerID = 'challenger'").first()
    assert answer.challenger_prediction.prediction == 1
