"""Cleaning, validation and features on literal records."""

import math

import pytest
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import select_or_zero
from keepwell.operators import clean, encode, features, score, validate
from keepwell.sources import scratch, subscribers

ONE = ("TEST-001", "Female", 0, "Yes", "No", 12, "Yes", "No", "Fiber optic", "No", "No", "No",
       "No", "Yes", "No", "Month-to-month", "Yes", "Electronic check", 89.10, "1069.20", None)


@pytest.fixture
def one(spark):
    return spark.createDataFrame([ONE], subscribers.RECORD_SCHEMA)


def test_single_record_features(one):
    medians, cleaned = clean.fit_clean(one)
    got = features.engineer(cleaned).first()
    assert medians["TotalCharges"] == 1069.20
    want = {"tenure_group": "Developing", "service_count": 3, "engagement_score": 3.0,
            "payment_risk_score": 5.0, "contract_risk": 3, "revenue_risk": 4.0,
            "is_new_customer": 0, "has_high_charges": 1, "has_no_contract": 1,
            "has_low_engagement": 0, "churn_propensity_score": 3}
    assert {k: got[k] for k in want} == want
    assert got["customer_lifetime_revenue"] == pytest.approx(1069.2)
    assert got["avg_monthly_value"] == pytest.approx(89.1)
    assert got["clv_estimate"] == pytest.approx(89.1 * 0.75 * 36 / 1.01 ** 12)


def test_single_prediction_has_all_fields(one):
    _, cleaned = clean.fit_clean(one)
    got = score.predict_batch(features.engineer(cleaned), challenger=cfg.CHALLENGER).first()
    margin = -2.5 + 0.9 * 3 + 0.5 * 5 - 0.04 * 12 + 0.02 * (89.1 - 65) - 0.1 * 3
    assert got["churn_probability"] == pytest.approx(1 / (1 + math.exp(-margin)))
    # margin 2.402, so p = 0.917: the critical tier
    assert got["risk_level"] == "Critical"
    assert got["retention_strategy"] == "Dedicated retention call"
    assert got["challenger_prediction"]["prediction"] == 1


@pytest.mark.parametrize("tenure,label", [
    (0, "New"), (11, "New"), (12, "Developing"), (24, "Stable"), (47, "Stable"), (48, "Loyal"),
    (9999, "Loyal"), (-1, "Loyal"), (None, "Loyal")])
def test_tenure_groups(spark, tenure, label):
    df = spark.createDataFrame([(tenure,)], "tenure int").select(
        features.tenure_group().alias("g"))
    assert df.first()["g"] == label


def test_blank_charges_become_the_median(spark):
    df = spark.createDataFrame(
        [("A", 0, 1, 20.0, " "), ("B", 0, 10, 50.0, "500.0")],
        "customerID string, SeniorCitizen int, tenure int, MonthlyCharges double, "
        "TotalCharges string")
    _, cleaned = clean.fit_clean(df)
    assert {r["customerID"]: r["TotalCharges"] for r in cleaned.collect()} == \
        {"A": 500.0, "B": 500.0}
    assert dict(cleaned.dtypes)["TotalCharges"] == "double"


def test_numbers_that_only_some_casts_take_are_bad(spark):
    df = spark.createDataFrame(
        [(v,) for v in ("1d", "1f", "1_000", "0x1", " 7 ", "-2.5e1", "abc", "", None)],
        "TotalCharges string")
    got = [r[0] for r in clean.clean_total_charges(df).collect()]
    assert got == [None, None, None, None, 7.0, -25.0, None, None, None]


def test_keep_first_follows_the_sequence_and_keeps_null_ids(spark):
    df = spark.createDataFrame(
        [("A", 2, 9.0), ("A", 1, 1.0), (None, 1, 5.0), (None, 3, 6.0), ("B", 1, 2.0)],
        "customerID string, load_seq int, MonthlyCharges double")
    got = [(r["customerID"], r["load_seq"], r["MonthlyCharges"])
           for r in clean.keep_first(df, sequence="load_seq").collect()]
    assert sorted(got, key=str) == sorted(
        [("A", 1, 1.0), (None, 1, 5.0), (None, 3, 6.0), ("B", 1, 2.0)], key=str)


def test_a_copy_without_a_target_loses_without_a_sequence(spark):
    df = spark.createDataFrame([("A", None, 1.0), ("A", "Yes", 2.0), ("B", "No", 3.0)],
                               "customerID string, Churn string, MonthlyCharges double")
    got = {r["customerID"]: r["Churn"] for r in clean.keep_first(df).collect()}
    assert got == {"A": "Yes", "B": "No"}


def test_missing_columns_are_tolerated(spark):
    df = spark.createDataFrame([("A", 5, "One year", 80.0, 400.0)],
                               "customerID string, tenure int, Contract string, "
                               "MonthlyCharges double, TotalCharges double")
    got = features.engineer(df).first()
    assert got["service_count"] == 0 and got["engagement_score"] == 0.0
    assert got["payment_risk_score"] == 0.0 and got["contract_risk"] == 2


def test_flags_of_missing_numbers_are_false(spark):
    df = spark.createDataFrame([(None, None, None, float("nan"))],
                               "tenure int, Contract string, MonthlyCharges double, "
                               "TotalCharges double")
    df = clean.coerce_numeric(df)
    got = features.engineer(df).first()
    assert got["has_high_charges"] == 0 and got["is_new_customer"] == 0
    assert got["clv_estimate"] == 0.0 and got["contract_risk"] == 2


def test_validation_reports(spark, one):
    bad = one.withColumn("SeniorCitizen", F.lit(None).cast("int")) \
        .withColumn("TotalCharges", F.lit("1d")).withColumn("gender", F.lit(" \t"))
    both = one.unionByName(bad)
    missing = {r["column_name"]: r["missing"] for r in validate.missing_values(both).collect()}
    assert missing == {"gender": 1, "SeniorCitizen": 1, "Churn": 2}
    issues = [r["issue"] for r in validate.dtype_issues(both.drop("tenure")).collect()]
    assert sorted(issues) == ["Missing expected numeric column: tenure",
                              "Non-numeric values found in TotalCharges: 1"]
    critical = [r["issue"] for r in validate.critical_issues(both).collect()]
    assert "Duplicate customer IDs detected" in critical and len(critical) == 4
    with pytest.raises(ValueError, match="Duplicate"):
        validate.require_valid(both)
    good, quarantined = validate.split_by_contract(both)
    assert good.count() == 1
    assert set(quarantined.first()["violations"]) == {
        "SeniorCitizen required", "TotalCharges not a number"}


def test_profile_counts_and_samples(spark):
    df = spark.createDataFrame([("c", "x", 3), ("a", None, 1), ("b", "x", 2), ("d", "y", 4),
                                ("e", "z", None)], "customerID string, extra string, n int")
    for approximate in (False, True):
        got = {r["name"]: r for r in
               validate.profile_columns(df, approximate=approximate).collect()}
        assert got["extra"]["null_count"] == 1 and got["extra"]["unique_count"] == 3
        assert got["extra"]["sample_values"] == ["x", "x", "y"]
        assert got["n"]["semantic_type"] == "numeric"
        assert got["extra"]["semantic_type"] == "categorical"


def test_encoding_drops_the_first_category_and_ignores_new_ones(spark):
    df = spark.createDataFrame([("A", "Two year", "Male"), ("B", "One year", "Female"),
                                ("C", "Month-to-month", "Other")],
                               "customerID string, Contract string, gender string")
    fitted = encode.fit_categories(df)
    assert fitted == {"Contract": ["Month-to-month", "One year", "Two year"]}
    later = df.withColumn("Contract", F.when(F.col("customerID") == "C", "Ten years")
                          .otherwise(F.col("Contract")))
    got = {r["customerID"]: r for r in
           encode.encode_one_hot(encode.encode_binary(later), fitted).collect()}
    assert got["C"]["Contract_One year"] == 0 and got["C"]["Contract_Two year"] == 0
    assert got["C"]["gender"] is None and got["A"]["gender"] == 1
    assert "Contract_Month-to-month" not in got["A"]


def test_scaling_uses_population_deviation_and_spares_constants(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (6.0, 4.0)], "x double, k double")
    state = encode.fit_scale(df, ["x", "k"])
    assert state["x"] == pytest.approx((3.0, math.sqrt(14 / 3)))
    assert state["k"] == (4.0, 1.0)
    assert [r["k"] for r in encode.scale(df, state).collect()] == [0.0, 0.0, 0.0]


def test_preprocessing_survives_saving(spark, sf_dir):
    raw = subscribers.subscribers(spark, sf_dir)
    state = encode.Preprocessing.fit(raw)
    assert len(state.features) == 46 and state.features[:2] == ["gender", "SeniorCitizen"]
    path = scratch.scratch_path(spark, "state")
    state.save(spark, path)
    again = encode.Preprocessing.load(spark, path)
    assert again == state
    # One row alone is transformed with the fitted columns.
    alone = again.transform(raw.limit(1))
    assert alone.columns == [cfg.ID, "label", *state.features]


def test_alignment_adds_zero_and_reorders(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "customerID string, b double, a double")
    got = select_or_zero(df, ["a", "new", "b"], keep=["customerID"])
    assert got.columns == ["customerID", "a", "new", "b"]
    assert tuple(got.first()) == ("A", 2.0, 0.0, 1.0)


def test_csv_keeps_blanks_and_bad_numbers(spark, one):
    path = scratch.scratch_path(spark, "csv")
    subscribers.write_csv(one.withColumn("TotalCharges", F.lit(" ")).unionByName(
        one.withColumn("TotalCharges", F.lit("NA"))), path)
    raw = subscribers.read_subscriber_csv(spark, path)
    assert sorted((r["TotalCharges"] for r in raw.collect()), key=str) == [" ", None]
    assert dict(subscribers.typed(raw).dtypes)["tenure"] == "int"


def test_processed_table_falls_back_to_raw(spark, one):
    missing = scratch.scratch_path(spark, "nothing-here")
    assert subscribers.load_processed(spark, missing, one).count() == 1


@pytest.mark.parametrize("p,action", [
    (0.95, "Dedicated retention call"), (0.75, "Discount offer"), (0.55, "Loyalty bonus"),
    (0.20, "No intervention"), (0.90, "Dedicated retention call"), (0.70, "Discount offer")])
def test_retention_actions(spark, p, action):
    df = spark.createDataFrame([(p, 1000.0)], "churn_probability double, clv_estimate double")
    got = score.with_retention(df).first()
    assert got["retention_strategy"] == action
    assert got["expected_revenue_saved"] == pytest.approx(p * 1000 * got["success_rate"])
