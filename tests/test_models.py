"""Promotion replay, neighbours, contributions, curves and the training job."""

import itertools
import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.ordered import RANGE
from keepwell.operators import evaluate, explain, registry, reports, sampling, smote, train
from keepwell.plans import train_job as jobs
from keepwell.plans.serve import Predictor
from keepwell.sources import scratch, subscribers
from keepwell.sources.runs import RunStore

RUN_SCHEMA = f"line int, seq bigint, kind string, lr_auc double, lr_recall double, " \
             f"gbt_auc double, gbt_recall double, {RANGE} int"


def test_decisions():
    def metrics(a, ra, b, rb):
        return {"logistic_regression": {"roc_auc": a, "recall": ra},
                "gbt": {"roc_auc": b, "recall": rb}}
    assert registry.decide(None, metrics(.839, .75, .835, .80))["champion"] == "logistic_regression"
    up = registry.decide("logistic_regression", metrics(.830, .74, .840, .72))
    assert up["action"] == "promote" and up["champion"] == "gbt"
    assert up["delta"] == pytest.approx(.01)
    low = registry.decide("logistic_regression", metrics(.830, .75, .845, .65))
    assert low["action"] == "retain"
    small = registry.decide("logistic_regression", metrics(.839, .75, .841, .72))
    assert small["action"] == "retain" and small["challenger"] == "gbt"


def _walk(events, threshold):
    """One line's history, event by event."""
    champ, lr, gbt, out = None, None, None, []
    for kind, a, ra, b, rb in events:
        prev = champ
        if kind == "train":
            lr, gbt = a, b
            if champ is None:
                champ, action, basis = (0 if a >= b else 1), "initial", None
            else:
                auc, rec = (a, b), (ra, rb)
                up = auc[1 - champ] - auc[champ] >= threshold and rec[1 - champ] >= 0.7
                champ, action, basis = (1 - champ if up else champ), \
                    "promote" if up else "retain", prev
        elif champ is None:
            out.append(("rejected", None, None, None))
            continue
        else:
            champ, action, basis = 1 - champ, "manual_rollback", None
        at = champ if basis is None else basis
        pair = (lr, gbt)
        out.append((action, None if action == "initial" else prev, champ, pair[1 - at] - pair[at]))
    return out


@pytest.mark.parametrize("threshold", [0.005, -0.02])
def test_replay_equals_a_walk_along_each_line(spark, threshold):
    rnd = random.Random(11)
    rows, want = [], {}
    for line, n in ((0, 700), (1, 40), (2, 3), (3, 1)):  # line 0 holds most rows
        events = []
        for i in range(n):
            kind = "rollback" if rnd.random() < .15 or (line == 1 and i < 3) else "train"
            events.append((kind, *[round(rnd.uniform(lo, hi), 3)
                                   for lo, hi in ((.8, .85), (.6, .9), (.8, .85), (.6, .9))]))
        want[line] = _walk(events, threshold)
        rows += [(line, i + 1, *e, i // 50) for i, e in enumerate(events)]
    runs = spark.createDataFrame(rows, RUN_SCHEMA)
    settings = spark.createDataFrame([(k, 1, threshold) for k in want],
                                     "line int, seq bigint, value double")
    names = {None: None, registry.FIRST: 0, registry.SECOND: 1}
    for line, part in registry.replay(runs, settings).toPandas().groupby("line"):
        part = part.sort_values("seq").astype(object).where(lambda x: x.notna(), None)
        got = [(r.action, names[r.previous_champion], names[r.new_champion], r.delta)
               for r in part.itertuples()]
        assert [g[:3] for g in got] == [w[:3] for w in want[line]]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want[line]])


def test_roles_and_history(spark):
    rows = [(1, 1, "train", .839, .75, .835, .80, 0), (1, 2, "train", .830, .74, .840, .72, 0),
            (1, 3, "rollback", 0., 0., 0., 0., 0)]
    history = registry.replay(spark.createDataFrame(rows, RUN_SCHEMA))
    assert [r["action"] for r in history.orderBy("seq").collect()] == [
        "initial", "promote", "manual_rollback"]
    role = registry.current_roles(history).first()
    assert (role["champion"], role["challenger"]) == ("logistic_regression", "gbt")
    assert registry.recent_promotions(history, 2).count() == 2


@pytest.mark.parametrize("block_rows,leaf_rows,near", [(2048, 64, 128), (20, 25, 1), (7, 4, 12), (3, 1, 1)])
def test_neighbours_equal_brute_force(spark, monkeypatch, block_rows, leaf_rows, near):
    monkeypatch.setattr(smote, "NEAR_ROWS", near)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(240, 4)), 1)
    x[:80] = x[0]            # a third of all rows are copies
    x[80:90] = x[85]
    ids = [f"k{i:04d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame(
        pd.DataFrame({"customerID": ids, **{f"f{j}": x[:, j] for j in range(4)}}))
    got = smote.nearest_neighbors(df, [f"f{j}" for j in range(4)], 5, block_rows=block_rows, leaf_rows=leaf_rows)
    found = {r["key"]: [n["key"] for n in r["neighbors"]] for r in got.collect()}
    assert len(found) == len(x)
    for i, key in enumerate(ids):
        d = np.zeros(len(x))
        for j in range(4):
            d += (x[:, j] - x[i, j]) ** 2
        order = sorted((math.floor(d[t] * 1e6 + 0.5), ids[t]) for t in range(len(x)) if t != i)
        assert found[key] == [k for _, k in order[:5]]


def test_balancing_puts_new_rows_between_parents(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"customerID": [f"c{i}" for i in range(90)],
                        "label": [1] * 20 + [0] * 70,
                        "a": rng.normal(size=90), "b": rng.normal(size=90)})
    out = smote.balance(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert out["label"].value_counts().to_dict() == {0: 70, 1: 70}
    at = pdf.set_index("customerID")
    made = out[out["position"].notna()]
    assert len(made) == 50
    for r in made.itertuples():
        p, q = at.loc[r.customerID], at.loc[r.other_parent]
        assert p["label"] == q["label"] == 1
        for c in ("a", "b"):
            assert getattr(r, c) == pytest.approx(p[c] + r.position * (q[c] - p[c]))


def test_a_lone_minority_row_repeats_itself(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 0, 1.0), ("c", 0, 3.0), ("d", 0, 5.0)],
                               "customerID string, label int, x double")
    out = smote.balance(df, ["x"]).where("label = 1").collect()
    assert [r["x"] for r in out] == [2.0, 2.0, 2.0]


def _brute_shapley(leaves, row, width):
    def value(known):
        total = 0.0
        for leaf in leaves:
            part = leaf.value
            for f, lo, hi, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                part *= (float(lo < row[f] <= hi)) if f in known else share
            total += part
        return total
    out = np.zeros(width)
    for f in range(width):
        others = [g for g in range(width) if g != f]
        for size in range(width):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
                out[f] += w * (value({*s, f}) - value(set(s)))
    return out


def test_tree_contributions_are_shapley_values(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["label"] = ((pdf["a"] > 0) ^ (pdf["b"] * pdf["c"] > 0.2)).astype(int)
    pdf["customerID"] = [f"c{i}" for i in range(len(pdf))]
    pdf["weight"] = 1.0
    names = list("abcd")
    data = train.assemble(spark.createDataFrame(pdf), names)
    model = train.gbt(trees=4, depth=3).fit(data)
    leaves = [SimpleNamespace(value=v, features=list(p), low=[b[0] for b in p.values()], high=[b[1] for b in p.values()], share=[b[2] for b in p.values()])
              for v, p in model.leaves()]
    got = explain.tree_values(pdf[names].to_numpy()[:25], model)
    for i in range(25):
        want = _brute_shapley(leaves, pdf[names].to_numpy()[i], 4)
        assert got[i, :4] == pytest.approx(want, abs=1e-9)
    rows = explain.tree_contributions(data, model, names).collect()
    for r in rows:
        total = r["base_value"] + sum(c["shap_value"] for c in r["contributions"])
        assert total == pytest.approx(r["margin"], abs=1e-9)


def test_explanations(spark):
    df = spark.createDataFrame([("A", 3.0, 1.0, 5.0)], "customerID string, x_one double, "
                               "y double, z double")
    made = explain.linear_contributions(df, {"x_one": 1.0, "y": -2.0, "z": 0.5},
                                        {"x_one": 1.0, "y": 0.0, "z": 5.0})
    got = explain.with_explanation(made).first()
    assert [(c["feature"], c["shap_value"]) for c in got["top_contributors"]] == [
        ("x_one", 2.0), ("y", -2.0), ("z", 0.0)]
    assert got["explanation"] == ("Why this customer may churn: x one increases churn risk; "
                                  "y decreases churn risk; z decreases churn risk.")
    empty = made.withColumn("contributions", F.slice("contributions", 1, 0))
    assert explain.with_explanation(empty).first()["explanation"] == \
        "Insufficient data to explain churn risk."


def test_curves_and_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 3000)})
    pdf["score"] = np.round(np.clip(rng.normal(.4 + .2 * pdf["label"], .2), 0, 1), 2)
    pdf.loc[:1000, "score"] = 0.5
    pdf["prediction"] = (pdf["score"] > .5).astype(int)
    df = spark.createDataFrame(pdf)
    pos, neg = pdf[pdf["label"] == 1]["score"], pdf[pdf["label"] == 0]["score"]
    wins = sum((p > neg).sum() + (p == neg).sum() / 2 for p in pos)
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(wins / len(pos) / len(neg))
    roc = evaluate.roc_curve(df).toPandas().sort_values(["fpr", "tpr"])
    assert len(roc) == pdf["score"].nunique() + 1
    assert np.trapezoid(roc["tpr"], roc["fpr"]) == pytest.approx(wins / len(pos) / len(neg))
    for r in roc.dropna().itertuples():
        assert r.tpr == pytest.approx((pos >= r.threshold).mean())
    pr = evaluate.pr_curve(df).toPandas()
    assert ((pr["recall"] == 0) & (pr["precision"] == 1)).sum() == 1


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0, .1), (0, 0, .2)], "label int, prediction int, score double")
    got = evaluate.classification_metrics(df).first()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"]) == (1.0, 0.0, 0.0, 0.0)
    assert evaluate.roc_auc(df).first()[0] is None


def test_split_sizes_and_folds(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias(cfg.ID),
                                  (F.col("id") % 5 == 0).cast("int").alias("label"))
    sides = sampling.stratified_split(df).groupBy("label", "is_test").count().collect()
    assert {(r["label"], r["is_test"]): r["count"] for r in sides} == {
        (0, 1): 160, (0, 0): 640, (1, 1): 40, (1, 0): 160}
    folds = sampling.stratified_folds(df).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r["label"] == 0} == {160} and len(folds) == 10


def test_training_job_end_to_end(spark, sf_dir):
    raw = subscribers.subscribers(spark, sf_dir.replace("sf0.001", "sf0.01"))
    store = RunStore(spark, scratch.scratch_path(spark, "store"))
    budget = train.Budget(folds=2, settings=1, trees=(5,))
    run = jobs.train_job(spark, raw, store, budget, repeats=1, starts=2)
    assert store.current() == run
    meta = jobs.read_metadata(store, run).first()
    assert meta["metrics"]["roc_auc"] > 0.9 and meta["row_count"] == 1500
    assert meta["action"] == "initial" and len(meta["feature_columns"]) == 46
    processed = store.read("processed_customers")
    assert processed.count() == 1500
    assert processed.where("churn_probability is null or segment is null").count() == 0
    name, path = jobs.serving_model(store)
    assert name == meta["best_model_name"] and subscribers.path_exists(spark, path)
    assert len(jobs.checksum(jobs.read_metadata(store, run)).first()["checksum"]) == 32
    assert jobs.promotion_history(store).count() == 1
    for table in ("classification_report", "roc_curve", "permutation_importance",
                  "shap_importance", "feature_importance"):
        assert store.read(f"evaluation/{table}").count() > 1

    # Serving: the processed table's probabilities again, with shadow and reasons.
    predictor = Predictor.load(store)
    records = predictor.predict_batch(raw, include_explanation=True, shadow=True).collect()
    assert len(records) == 1500
    stored = {r[cfg.ID]: r["churn_probability"] for r in processed.collect()}
    assert all(r["churn_probability"] == pytest.approx(stored[r[cfg.ID]]) for r in records)
    first = records[0]
    assert len(first["top_contributors"]) == 5
    assert first["explanation"].startswith("Why this customer may churn: ")
    assert first["challenger_prediction"]["model_name"] == predictor.challenger_name
    segments = predictor.get_segment(raw)
    assert segments.where("segment is not null").count() == 1500

    # Requests: anonymous records are scored, broken ones set aside with their reasons.
    asked = raw.limit(40).withColumn(cfg.ID, F.lit(None).cast("string")).fillna({"SeniorCitizen": 0}) \
        .withColumn("TotalCharges", F.lit("10.5"))
    assert predictor.predict_batch(asked).count() == 40
    broken = asked.limit(5).withColumn("tenure", F.lit(-5)).withColumn("MonthlyCharges", F.lit(-1.0))
    good, aside = predictor.predict_requests(asked.unionByName(broken))
    assert good.count() == 40 and [sorted(r["violations"]) for r in aside.collect()] == [
        ["MonthlyCharges below 0", "tenure below 0"]] * 5
    # The dashboard's figures of raw records are those of the scored table.
    assert predictor.kpis(raw).first() == pytest.approx(reports.executive_kpis(processed).first())
    # The validation report is an output of the run; critical issues can end a run.
    report = {(r["section"], r["name"]): r["value"] for r in store.read("validation_report").collect()}
    assert report["shape", "rows"] == 1500 and report["duplicates", "ids"] == 0
    with pytest.raises(ValueError, match="Data validation failed"):
        jobs.train_job(spark, raw, store, budget, repeats=1, starts=1, fail_on_critical=True)
    assert store.current() == run and jobs.promotion_history(store).count() == 1
    status = jobs.registry_status(store).first()
    assert status["champion"] == name and status["trained_at"] == status["promoted_at"] is not None
    assert status["champion_metrics"]["roc_auc"] > 0.9 and len(status["recent"]) == 1
    assert status["threshold"] == cfg.PROMOTION_THRESHOLD

    # A rollback swaps the roles and the served model follows.
    swap = jobs.rollback(store)
    assert swap["champion"] == predictor.challenger_name
    again = Predictor.load(store)
    assert again.champion_name == predictor.challenger_name
    one = again.predict_batch(raw.limit(3), include_explanation=True).collect()
    assert len(one) == 3 and all(0 <= r["churn_probability"] <= 1 for r in one)
    assert [r["action"] for r in jobs.promotion_history(store).orderBy("seq").collect()] == [
        "initial", "manual_rollback"]


def test_rollback_needs_a_published_run(spark):
    with pytest.raises(ValueError, match="Cannot rollback"):
        jobs.rollback(RunStore(spark, scratch.scratch_path(spark, "empty")))


def test_legacy_registry(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text("""{"champion": {"model_name": "a"}, "promotion_threshold": 0.02, "history": [
      {"timestamp": "2024-01-01T00:00:00+00:00", "action": "initial", "new_champion": "a",
       "previous_champion": null, "champion_metric": 0.8, "challenger_metric": 0.7,
       "delta": -0.1}]}""")
    history, threshold = jobs.read_legacy_registry(spark, str(path))
    assert threshold == 0.02 and history.first()["new_champion"] == "a"
    store = RunStore(spark, scratch.scratch_path(spark, "old"))
    assert jobs.import_legacy_registry(store, str(path)) == 1
    entry = jobs.promotion_history(store).first()
    assert entry["action"] == "initial" and entry["decided_at"] is not None and entry["run_id"] is None
    assert jobs.promotion_threshold(store) == 0.02 and jobs.registry_status(store).first()["champion"] == "a"
    with pytest.raises(ValueError, match="history already"):
        jobs.import_legacy_registry(store, str(path))


def test_stored_threshold_decides(spark):
    metrics = {"logistic_regression": {"roc_auc": 0.83, "recall": 0.75}, "gbt": {"roc_auc": 0.84, "recall": 0.75}}
    store = RunStore(spark, scratch.scratch_path(spark, "settings"))
    assert jobs.promotion_threshold(store) == cfg.PROMOTION_THRESHOLD
    assert registry.decide("logistic_regression", metrics, jobs.promotion_threshold(store))["action"] == "promote"
    jobs.set_promotion_threshold(store, 0.5)
    jobs.set_promotion_threshold(store, 0.02)
    assert registry.decide("logistic_regression", metrics, jobs.promotion_threshold(store))["action"] == "retain"


def test_training_takes_each_customer_once(spark):
    """Copies with another target or none neither take customers out of training nor move them."""
    rows = [(f"c{i:03d}", "Yes" if i % 6 == 0 else "No", 1) for i in range(150)]
    later = [(c, None if i % 2 else "No", 2) for i, (c, t, _) in enumerate(rows) if t == "Yes"]
    columns = f"{cfg.ID} string, {cfg.TARGET} string, load_seq int"
    want = {(0, 0): 100, (0, 1): 25, (1, 0): 20, (1, 1): 5}
    for sequence in ("load_seq", None):
        given = rows + (later if sequence else [x for x in later if x[1] is None])
        df = spark.createDataFrame(given, columns)
        _, sides = train.training_rows(df if sequence else df.drop("load_seq"), sequence)
        assert {(r["label"], r["is_test"]): r["count"] for r in sides.groupBy("label", "is_test").count().collect()} == want


def test_the_default_search_is_the_published_one():
    budget = train.Budget()
    grid = train.sampled_grid(budget)
    assert budget.folds == 5 and len(grid) == 15 and len({str(s) for s in grid}) == 15
    assert {s["n_estimators"] for s in grid} == {100, 200, 300}
