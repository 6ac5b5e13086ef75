"""Subscriber records: the table, its CSV form, and the projection of the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell import config as cfg
from keepwell.functions.columns import number

CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in cfg.RAW_COLUMNS])
CSV_OPTIONS = {
    "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "escape": '"', "multiLine": False,
}
RECORD_SCHEMA = T.StructType([
    T.StructField(c, T.IntegerType() if c in ("SeniorCitizen", "tenure")
                  else T.DoubleType() if c == "MonthlyCharges" else T.StringType())
    for c in cfg.RAW_COLUMNS
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Subscriber view of customer and orders.  Orders are counted per customer
# before the join, so both join sides hold one row per key.
_SUBSCRIBERS = """
WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM {orders} GROUP BY o_custkey),
b AS (
  SELECT c.c_custkey AS k, c.c_name, c.c_nationkey, c.c_mktsegment,
    CAST((c.c_custkey * 37 + coalesce(o.n_orders, 0)) % 73 AS INT) AS tenure,
    floor((18.25 + (c.c_acctbal + 1000) / 11000 * 100.5) * 100) / 100 AS MonthlyCharges,
    CASE (c.c_custkey * 7) % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' WHEN 2 THEN 'DSL'
      ELSE 'Fiber optic' END AS InternetService,
    CASE WHEN c.c_mktsegment IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN 'Month-to-month'
      WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE c.c_nationkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
      WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod
  FROM {customer} c LEFT JOIN o ON c.c_custkey = o.o_custkey)
SELECT c_name AS customerID,
  CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN k % 41 = 0 THEN NULL WHEN k % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
  CASE WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN k % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
  tenure,
  CASE WHEN k % 10 = 9 THEN 'No' ELSE 'Yes' END AS PhoneService,
  CASE WHEN k % 10 = 9 THEN 'No phone service' WHEN k % 4 < 2 THEN 'Yes' ELSE 'No' END
    AS MultipleLines,
  InternetService,
  {internet_options},
  Contract,
  CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  PaymentMethod, MonthlyCharges,
  CASE WHEN tenure = 0 THEN ' ' WHEN k % 89 = 0 THEN 'n/a'
    ELSE CAST(CAST(MonthlyCharges * tenure AS DECIMAL(12,2)) AS VARCHAR(20)) END AS TotalCharges,
  CASE WHEN (CASE WHEN Contract = 'Month-to-month' THEN 2 ELSE 0 END)
    + (CASE WHEN tenure < 24 THEN 1 ELSE 0 END)
    + (CASE WHEN InternetService = 'Fiber optic' THEN 1 ELSE 0 END)
    + (CASE WHEN PaymentMethod = 'Electronic check' THEN 1 ELSE 0 END)
    + (k * 53) % 4 >= 6 THEN 'Yes' ELSE 'No' END AS Churn,
  k AS _k
FROM b
"""
# Fixed values: (column, multiplier, modulus, below-which-active).
_INTERNET_OPTIONS = [
    ("OnlineSecurity", 11, 7, 2), ("OnlineBackup", 13, 9, 4), ("DeviceProtection", 17, 11, 5),
    ("TechSupport", 19, 13, 4), ("StreamingTV", 23, 8, 4), ("StreamingMovies", 29, 12, 6),
]


def _keyed_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ",\n  ".join(
        f"CASE WHEN InternetService = 'No' THEN 'No internet service' "
        f"WHEN (k * {a}) % {m} < {t} THEN 'Yes' ELSE 'No' END AS {c}"
        for c, a, m, t in _INTERNET_OPTIONS)
    return spark.sql(
        _SUBSCRIBERS.replace("{internet_options}", options),
        customer=table(spark, sf_dir, "customer"), orders=table(spark, sf_dir, "orders"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21 raw columns, one row per customer."""
    return _keyed_subscribers(spark, sf_dir).drop("_k")


def subscribers_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers plus later, changed copies of every fiftieth one, in load order."""
    base = _keyed_subscribers(spark, sf_dir)
    first = base.withColumn("load_seq", F.lit(1))
    again = base.where("_k % 50 = 0").withColumn("load_seq", F.lit(2)) \
        .withColumn("MonthlyCharges", F.col("MonthlyCharges") + 5)
    return first.unionByName(again).drop("_k")


def subscribers_with_retold_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers plus later copies of every fiftieth one, whose target is turned round or missing."""
    base = _keyed_subscribers(spark, sf_dir)
    other = F.when(F.col("_k") % 100 == 0, F.when(F.col(cfg.TARGET) == "Yes", "No").otherwise("Yes"))
    again = base.where("_k % 50 = 0").withColumn("load_seq", F.lit(2)).withColumn(cfg.TARGET, other)
    return base.withColumn("load_seq", F.lit(1)).unionByName(again).drop("_k")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def read_subscriber_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; every column as text, missing-value tokens as null.

    Numbers stay text so that validation can still report bad values.
    """
    raw = spark.read.options(**CSV_OPTIONS).schema(CSV_SCHEMA).csv(path)
    return raw.select(*[
        F.when(~F.col(c).isin(cfg.NA_TOKENS), F.col(c)).alias(c) for c in raw.columns])


def typed(df: DataFrame) -> DataFrame:
    """Text records with their number columns typed; TotalCharges stays text."""
    casts = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}
    return df.select(*[
        number(df, c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_processed(spark: SparkSession, processed_path: str, raw: DataFrame) -> DataFrame:
    """The processed table where one was published, else the raw records."""
    return spark.read.parquet(processed_path) if path_exists(spark, processed_path) else raw
