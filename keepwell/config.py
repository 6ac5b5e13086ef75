"""Settings of the churn pipeline.

The values below are fixed: they define the results (bins, weights, maps,
thresholds, prices, label names), so they are stated plainly in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: columns and their roles --------------------------------
ID = "customerID"
TARGET = "Churn"
BINARY_COLUMNS = ["gender", "Partner", "Dependents", "PhoneService", "PaperlessBilling"]
CATEGORICAL_COLUMNS = [
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaymentMethod",
]
NUMERIC_COLUMNS = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
]

# ---- fixed values: what a CSV reader treats as missing ---------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- fixed values: validation ----------------------------------------------
IQR_MULTIPLIER = 1.5
OUTLIER_COLUMNS = ["tenure", "MonthlyCharges", "TotalCharges"]

# ---- fixed values: feature rules -------------------------------------------
TENURE_BINS = [("New", 0, 12), ("Developing", 12, 24), ("Stable", 24, 48), ("Loyal", 48, 9999)]
SERVICE_COLUMNS = [
    "PhoneService", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]
ACTIVE_SERVICE_VALUES = ["yes", "dsl", "fiber optic"]
INTERNET_VALUES = ["DSL", "Fiber optic"]
ENGAGEMENT_WEIGHTS = {
    "InternetService": 2.0, "OnlineSecurity": 1.5, "OnlineBackup": 1.0, "DeviceProtection": 1.0,
    "TechSupport": 1.5, "StreamingTV": 1.0, "StreamingMovies": 1.0,
}
MONTH_TO_MONTH_WEIGHT = 2.0
ELECTRONIC_CHECK_WEIGHT = 2.0
PAPERLESS_WEIGHT = 1.0
CONTRACT_RISK = {"Month-to-month": 3, "One year": 2, "Two year": 1}
CONTRACT_RISK_DEFAULT = 2
NEW_CUSTOMER_MONTHS = 12
HIGH_CHARGE = 70.0
LOW_ENGAGEMENT = 3.0
HIGH_PAYMENT_RISK = 3
REVENUE_RISK_STEP = 2.0
GROSS_MARGIN = 0.75
DISCOUNT_RATE = 0.01
LIFESPAN_MONTHS = 36
ENGINEERED_COLUMNS = [
    "service_count", "engagement_score", "payment_risk_score", "contract_risk",
    "customer_lifetime_revenue", "avg_monthly_value", "revenue_risk", "clv_estimate",
    "is_new_customer", "has_high_charges", "has_no_contract", "has_low_engagement",
    "churn_propensity_score",
]

# ---- fixed values: encoding -------------------------------------------------
BINARY_MAPS = {
    "gender": {"Female": 0, "Male": 1},
    "Partner": {"No": 0, "Yes": 1},
    "Dependents": {"No": 0, "Yes": 1},
    "PhoneService": {"No": 0, "Yes": 1},
    "PaperlessBilling": {"No": 0, "Yes": 1},
}
ONE_HOT_COLUMNS = CATEGORICAL_COLUMNS + ["tenure_group"]

# ---- fixed values: training -------------------------------------------------
SEED = 42
TEST_SIZE = 0.2
CV_FOLDS = 5
SEARCH_SETTINGS = 15
SMOTE_NEIGHBORS = 5
LOGISTIC_MAX_ITER = 1000
LOGISTIC_C = [0.01, 0.1, 1.0, 10.0]
GBT_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 7, -1],
    "learning_rate": [0.01, 0.05, 0.1],
    "num_leaves": [15, 31, 63],
    "subsample": [0.8, 1.0],
}
PERMUTATION_REPEATS = 10

# ---- fixed values: promotion, risk tiers, retention -------------------------
PRIMARY_METRIC = "roc_auc"
PROMOTION_THRESHOLD = 0.005
MIN_RECALL = 0.70
RISK_TIERS = [("Critical", 0.90), ("High", 0.70), ("Medium", 0.50)]
LOWEST_TIER = "Low"
HIGH_RISK_THRESHOLD = 0.7
STRATEGIES = [  # tier, action, cost, success rate
    ("Critical", "Dedicated retention call", 50.0, 0.35),
    ("High", "Discount offer", 30.0, 0.25),
    ("Medium", "Loyalty bonus", 15.0, 0.15),
    ("Low", "No intervention", 0.0, 0.0),
]

# ---- fixed values: segmentation ---------------------------------------------
N_CLUSTERS = 5
KMEANS_STARTS = 10
SEGMENT_FEATURES = [
    "tenure", "MonthlyCharges", "clv_estimate", "engagement_score", "churn_probability",
]
SEGMENT_LABELS = [
    "High Value Loyal", "High Risk High Revenue", "Low Revenue Churners", "New At Risk",
    "Stable Customers",
]
FALLBACK_SEGMENT = "Stable Customers"

# ---- fixed values: explanations, privacy, quotas ----------------------------
TOP_CONTRIBUTORS = 5
SUMMARY_REASONS = 3
TOP_FEATURES = 15
BACKGROUND_ROWS = 200
REDACTED = "[REDACTED]"
SENSITIVE_FIELDS = sorted(
    {"customerID", "PaymentMethod", "MonthlyCharges", "TotalCharges", ID}
    | set(NUMERIC_COLUMNS) | set(BINARY_COLUMNS) | set(CATEGORICAL_COLUMNS)
)
QUOTAS_PER_MINUTE = {"predict": 60, "predict_batch": 10, "train": 1}


@dataclass(frozen=True)
class Scorecard:
    """A fixed linear model on engineered columns: probability = logistic(margin)."""

    name: str
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    offsets: dict[str, float] = field(default_factory=dict)


# ---- fixed values: scorecards used where SQL must reproduce a probability ----
CHAMPION = Scorecard(
    "champion_scorecard", -2.5,
    {"contract_risk": 0.9, "payment_risk_score": 0.5, "tenure": -0.04, "MonthlyCharges": 0.02,
     "engagement_score": -0.1},
    {"MonthlyCharges": 65.0},
)
CHALLENGER = Scorecard(
    "challenger_scorecard", -2.2,
    {"contract_risk": 0.7, "payment_risk_score": 0.6, "tenure": -0.035, "MonthlyCharges": 0.018,
     "engagement_score": -0.12},
    {"MonthlyCharges": 65.0},
)

# ---- fixed values: centroids used where SQL must reproduce a segment ---------
# (tenure, MonthlyCharges, clv_estimate, engagement_score, churn_probability)
FIXED_CENTROIDS = [
    (57.5, 107.5, 4900.0, 7.75, 0.125),
    (7.0, 97.5, 800.0, 3.75, 0.825),
    (9.5, 32.5, 375.0, 1.75, 0.725),
    (2.5, 77.5, 225.0, 2.25, 0.625),
    (29.0, 59.0, 2150.0, 4.9, 0.225),
]
