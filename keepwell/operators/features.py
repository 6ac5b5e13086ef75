"""Engineered features, all column expressions in two projections."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell import config as cfg
from keepwell.functions.columns import any_of, flag, lookup


def _month_to_month() -> Column:
    return F.col("Contract") == "Month-to-month"


def _total(parts: list[Column]) -> Column:
    return reduce(add, parts) if parts else F.lit(0.0)


def tenure_group() -> Column:
    """Label of the first bin holding the tenure; anything outside gets the last label."""
    expr = F
    for label, low, high in cfg.TENURE_BINS:
        expr = expr.when((F.col("tenure") >= low) & (F.col("tenure") < high), label)
    return expr.otherwise(cfg.TENURE_BINS[-1][0])


def service_count(df: DataFrame) -> Column:
    """How many of the service columns are active."""
    parts = [flag(F.lower(F.trim(F.col(c))).isin(cfg.ACTIVE_SERVICE_VALUES))
             for c in any_of(cfg.SERVICE_COLUMNS, df.columns)]
    return _total(parts) if parts else F.lit(0)


def engagement_score(df: DataFrame) -> Column:
    """Weighted sum of active services."""
    parts = []
    for name, weight in cfg.ENGAGEMENT_WEIGHTS.items():
        if name in df.columns:
            active = F.col(name).isin(cfg.INTERNET_VALUES) if name == "InternetService" \
                else F.col(name) == "Yes"
            parts.append(flag(active) * F.lit(weight))
    return _total(parts)


def payment_risk_score(df: DataFrame) -> Column:
    tests = {
        "Contract": (_month_to_month(), cfg.MONTH_TO_MONTH_WEIGHT),
        "PaymentMethod": (F.col("PaymentMethod") == "Electronic check",
                          cfg.ELECTRONIC_CHECK_WEIGHT),
        "PaperlessBilling": (F.col("PaperlessBilling") == "Yes", cfg.PAPERLESS_WEIGHT),
    }
    return _total([flag(test) * F.lit(w) for c, (test, w) in tests.items() if c in df.columns])


def contract_risk() -> Column:
    return F.coalesce(lookup(cfg.CONTRACT_RISK, F.col("Contract")),
                      F.lit(cfg.CONTRACT_RISK_DEFAULT))


def lifetime_revenue() -> Column:
    return F.col("MonthlyCharges") * F.col("tenure")


def avg_monthly_value() -> Column:
    """Total per month of tenure; a missing tenure leaves the value missing."""
    months = F.when(F.col("tenure").isNotNull(), F.greatest(F.col("tenure"), F.lit(1)))
    return F.col("TotalCharges") / months


def revenue_risk() -> Column:
    step = F.lit(cfg.REVENUE_RISK_STEP)
    return (flag(F.col("tenure") < cfg.NEW_CUSTOMER_MONTHS) * step
            + flag(F.col("MonthlyCharges") > cfg.HIGH_CHARGE) * step
            + flag(_month_to_month()) * step)


def clv_estimate() -> Column:
    """Discounted margin over the expected lifespan, 0 when an input is missing."""
    months = F.when(F.col("tenure").isNotNull(), F.greatest(F.col("tenure"), F.lit(0)))
    discount = F.pow(F.lit(1 + cfg.DISCOUNT_RATE), months)
    value = avg_monthly_value() * F.lit(cfg.GROSS_MARGIN) * F.lit(cfg.LIFESPAN_MONTHS) / discount
    return F.coalesce(value, F.lit(0.0))


def churn_flags() -> dict[str, Column]:
    """The 0/1 indicators; needs engagement_score."""
    return {
        "is_new_customer": flag(F.col("tenure") < cfg.NEW_CUSTOMER_MONTHS),
        "has_high_charges": flag(F.col("MonthlyCharges") > cfg.HIGH_CHARGE),
        "has_no_contract": flag(_month_to_month()),
        "has_low_engagement": flag(F.col("engagement_score") < cfg.LOW_ENGAGEMENT),
    }


def churn_propensity_score() -> Column:
    """Number of indicators that hold; needs the flags and payment_risk_score."""
    names = ["is_new_customer", "has_high_charges", "has_no_contract", "has_low_engagement"]
    return _total([F.col(n) for n in names]
                  + [flag(F.col("payment_risk_score") >= cfg.HIGH_PAYMENT_RISK)])


def engineer(df: DataFrame) -> DataFrame:
    """All engineered columns after the input columns.

    Levels keep later features from repeating the expressions of earlier ones.
    """
    first = df.withColumns({
        "tenure_group": tenure_group(),
        "service_count": service_count(df),
        "engagement_score": engagement_score(df),
        "payment_risk_score": payment_risk_score(df),
        "contract_risk": contract_risk(),
        "customer_lifetime_revenue": lifetime_revenue(),
        "avg_monthly_value": avg_monthly_value(),
        "revenue_risk": revenue_risk(),
        "clv_estimate": clv_estimate(),
    })
    return first.withColumns(churn_flags()) \
        .withColumn("churn_propensity_score", churn_propensity_score())
