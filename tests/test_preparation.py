"""The preparation inside Spark ML pipelines: folds fit their own, saved ones score the same, streams are served."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from keepwell import config as cfg
from keepwell.operators import boosting, encode, train
from keepwell.operators.preparation import PreparationEstimator, PreparationModel
from keepwell.sources import subscribers


def scores(model, raw):
    return {r[0]: round(r[1], 12) for r in model.transform(raw).select(cfg.ID, vector_to_array("probability")[1]).collect()}


def test_pipeline(spark, sf_dir, tmp_path):
    raw = subscribers.subscribers(spark, sf_dir)
    model = Pipeline(stages=[PreparationEstimator(), boosting.BoostedTrees(boosting.Setting(3, 7), 5, cfg.ID)]).fit(raw)
    model.write().overwrite().save(f"file://{tmp_path}/p")
    again = PipelineModel.load(f"file://{tmp_path}/p")
    first = scores(model, raw)
    assert scores(again, raw) == first and len(first) == raw.select(cfg.ID).distinct().count()
    assert again.uid == model.uid and isinstance(again.stages[0], PreparationModel)
    # The state is that of the plain preparation; scores are those of its rows.
    plain = encode.Preprocessing.fit(raw)
    assert again.stages[0].state == plain
    rows = train.assemble(plain.transform(raw), plain.features)
    assert scores(again.stages[1], rows) == first


def test_folds_fit_their_own(spark, sf_dir, monkeypatch):
    raw = subscribers.subscribers(spark, sf_dir)
    fitted = []
    fit = encode.Preprocessing.fit.__func__
    monkeypatch.setattr(encode.Preprocessing, "fit", classmethod(lambda cls, df, sequence=None: fitted.append(fit(cls, df, sequence)) or fitted[-1]))
    line = LogisticRegression(weightCol="weight", maxIter=20)
    search = CrossValidator(estimator=Pipeline(stages=[PreparationEstimator(), line]), estimatorParamMaps=ParamGridBuilder().addGrid(line.regParam, [0.01]).build(),
                            evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=1)
    best = search.fit(raw)
    assert best.avgMetrics[0] > 0.7
    # Two folds and all rows: three fits that differ.
    assert len({str(sorted(p.scaling.items())) for p in fitted}) == 3


def test_stream_batches(spark, sf_dir, tmp_path):
    raw = subscribers.subscribers(spark, sf_dir)
    model = PreparationEstimator().fit(raw)
    raw.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    q = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(
        lambda df, _: seen.extend(model.transform(df).select(cfg.ID, vector_to_array("features").alias("x")).collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[cfg.ID]: r["x"] for r in model.transform(raw).select(cfg.ID, vector_to_array("features").alias("x")).collect()}
    assert {r[cfg.ID]: r["x"] for r in seen} == want
    assert model.transform(raw.limit(0)).count() == 0
