"""The named queries as SQL, written on their own for comparison in another engine.

Each text starts from the same tables.  Doubles are compared after
floor(x * 1e6 + 0.5) / 1e6.
"""

from __future__ import annotations

import itertools
import random

from keepwell import config as cfg

SUBSCRIBERS = """
o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
b AS (
 SELECT c.c_custkey AS k, c.c_name, c.c_nationkey, c.c_mktsegment,
   CAST((c.c_custkey * 37 + coalesce(o.n_orders, 0)) % 73 AS INT) AS tenure,
   floor((18.25 + (c.c_acctbal + 1000) / 11000 * 100.5) * 100) / 100 AS MonthlyCharges,
   CASE (c.c_custkey * 7) % 5 WHEN 0 THEN 'No' WHEN 1 THEN 'DSL' WHEN 2 THEN 'DSL' ELSE 'Fiber optic' END AS InternetService,
   CASE WHEN c.c_mktsegment IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN 'Month-to-month' WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'One year' ELSE 'Two year' END AS Contract,
   CASE c.c_nationkey % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod
 FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey),
keyed AS (
SELECT c_name AS customerID,
 CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
 CASE WHEN k % 41 = 0 THEN NULL WHEN k % 6 = 0 THEN 1 ELSE 0 END AS SeniorCitizen,
 CASE WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
 CASE WHEN k % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
 tenure,
 CASE WHEN k % 10 = 9 THEN 'No' ELSE 'Yes' END AS PhoneService,
 CASE WHEN k % 10 = 9 THEN 'No phone service' WHEN k % 4 < 2 THEN 'Yes' ELSE 'No' END AS MultipleLines,
 InternetService,
 CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (k * 11) % 7 < 2 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
 CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (k * 13) % 9 < 4 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
 CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (k * 17) % 11 < 5 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
 CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (k * 19) % 13 < 4 THEN 'Yes' ELSE 'No' END AS TechSupport,
 CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (k * 23) % 8 < 4 THEN 'Yes' ELSE 'No' END AS StreamingTV,
 CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN (k * 29) % 12 < 6 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
 Contract,
 CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
 PaymentMethod, MonthlyCharges,
 CASE WHEN tenure = 0 THEN ' ' WHEN k % 89 = 0 THEN 'n/a' ELSE CAST(CAST(MonthlyCharges * tenure AS DECIMAL(12,2)) AS VARCHAR) END AS TotalCharges,
 CASE WHEN (CASE WHEN Contract = 'Month-to-month' THEN 2 ELSE 0 END) + (CASE WHEN tenure < 24 THEN 1 ELSE 0 END) + (CASE WHEN InternetService = 'Fiber optic' THEN 1 ELSE 0 END) + (CASE WHEN PaymentMethod = 'Electronic check' THEN 1 ELSE 0 END) + (k * 53) % 4 >= 6 THEN 'Yes' ELSE 'No' END AS Churn,
 k
FROM b),
raw AS (SELECT * EXCLUDE (k) FROM keyed),
copies AS (
 SELECT 1 AS load_seq, * EXCLUDE (k) FROM keyed
 UNION ALL BY NAME
 SELECT 2 AS load_seq, * EXCLUDE (k) REPLACE (MonthlyCharges + 5 AS MonthlyCharges) FROM keyed WHERE k % 50 = 0)
"""

NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def m(expr: str, name: str | None = None) -> str:
    """Six-decimal value of an expression."""
    return f"floor(({expr}) * 1e6 + 0.5E0) / 1e6" + (f' AS "{name}"' if name else "")


def q(name: str) -> str:
    return f'"{name}"'


def parsed(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, {NUMBER}) THEN TRY_CAST(trim({col}) AS DOUBLE) END"


def prepared(source: str) -> str:
    return f"""SELECT * REPLACE (
   CAST(coalesce(SeniorCitizen, 0) AS INT) AS SeniorCitizen, CAST(tenure AS DOUBLE) AS tenure,
   {parsed('TotalCharges')} AS TotalCharges) FROM {source}"""


CLEANED = SUBSCRIBERS + f""",
prepared AS ({prepared('raw')}),
med AS (SELECT median(tenure) AS mt, median(MonthlyCharges) AS mm, median(TotalCharges) AS mc FROM prepared),
cleaned AS (SELECT p.* REPLACE (coalesce(p.tenure, mt) AS tenure,
   coalesce(p.MonthlyCharges, mm) AS MonthlyCharges, coalesce(p.TotalCharges, mc) AS TotalCharges)
 FROM prepared p, med)
"""


def _yes(col: str, values: str, points: str) -> str:
    return f"CASE WHEN {col} IN ({values}) THEN {points} ELSE 0E0 END"


def _case(cond: str, yes: str = "1", no: str = "0") -> str:
    return f"(CASE WHEN {cond} THEN {yes} ELSE {no} END)"


_SERVICES = ["PhoneService", "InternetService", "OnlineSecurity", "OnlineBackup",
             "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
_SERVICE_COUNT = " + ".join(
    _case(f"lower(trim({c})) IN ('yes','dsl','fiber optic')") for c in _SERVICES)
_ENGAGEMENT = " + ".join(
    [_yes("InternetService", "'DSL','Fiber optic'", "2.0E0")]
    + [_yes(c, "'Yes'", w) for c, w in (
        ("OnlineSecurity", "1.5E0"), ("OnlineBackup", "1E0"), ("DeviceProtection", "1E0"),
        ("TechSupport", "1.5E0"), ("StreamingTV", "1E0"), ("StreamingMovies", "1E0"))])

ENGINEERED = CLEANED + f""",
e1 AS (SELECT *,
  CASE WHEN tenure >= 0 AND tenure < 12 THEN 'New' WHEN tenure >= 12 AND tenure < 24 THEN 'Developing'
    WHEN tenure >= 24 AND tenure < 48 THEN 'Stable' ELSE 'Loyal' END AS tenure_group,
  CAST({_SERVICE_COUNT} AS INT) AS service_count,
  {_ENGAGEMENT} AS engagement_score,
  {_case("Contract = 'Month-to-month'", "2E0", "0E0")} + {_case("PaymentMethod = 'Electronic check'", "2E0", "0E0")}
    + {_case("PaperlessBilling = 'Yes'", "1E0", "0E0")} AS payment_risk_score,
  CAST(CASE Contract WHEN 'Month-to-month' THEN 3 WHEN 'One year' THEN 2 WHEN 'Two year' THEN 1 ELSE 2 END AS INT) AS contract_risk,
  MonthlyCharges * tenure AS customer_lifetime_revenue,
  TotalCharges / greatest(tenure, 1) AS avg_monthly_value,
  {_case("tenure < 12", "2E0", "0E0")} + {_case("MonthlyCharges > 70", "2E0", "0E0")}
    + {_case("Contract = 'Month-to-month'", "2E0", "0E0")} AS revenue_risk,
  coalesce((TotalCharges / greatest(tenure, 1)) * 0.75E0 * 36 / pow(1.01E0, greatest(tenure, 0)), 0E0) AS clv_estimate
 FROM cleaned),
e2 AS (SELECT *,
  CAST({_case("tenure < 12")} AS INT) AS is_new_customer,
  CAST({_case("MonthlyCharges > 70")} AS INT) AS has_high_charges,
  CAST({_case("Contract = 'Month-to-month'")} AS INT) AS has_no_contract,
  CAST({_case("engagement_score < 3")} AS INT) AS has_low_engagement FROM e1),
engineered AS (SELECT *, CAST(is_new_customer + has_high_charges + has_no_contract + has_low_engagement
  + {_case("payment_risk_score >= 3")} AS INT) AS churn_propensity_score FROM e2)
"""

_CHAMPION_MARGIN = ("(-2.5E0 + 0.9E0 * (contract_risk - 0E0) + 0.5E0 * (payment_risk_score - 0E0)"
                    " + -0.04E0 * (tenure - 0E0) + 0.02E0 * (MonthlyCharges - 65E0)"
                    " + -0.1E0 * (engagement_score - 0E0))")
_CHALLENGER_MARGIN = ("(-2.2E0 + 0.7E0 * (contract_risk - 0E0) + 0.6E0 * (payment_risk_score - 0E0)"
                      " + -0.035E0 * (tenure - 0E0) + 0.018E0 * (MonthlyCharges - 65E0)"
                      " + -0.12E0 * (engagement_score - 0E0))")


def _logistic(x: str) -> str:
    return f"(1E0 / (1E0 + exp(-({x}))))"


SCORED = ENGINEERED + f""",
scored AS (SELECT *, {_logistic(_CHAMPION_MARGIN)} AS churn_probability,
  {_logistic(_CHALLENGER_MARGIN)} AS challenger_p,
  CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label FROM engineered),
strategies(risk_level, retention_strategy, retention_cost, success_rate) AS (VALUES
  ('Critical', 'Dedicated retention call', 50E0, 0.35E0), ('High', 'Discount offer', 30E0, 0.25E0),
  ('Medium', 'Loyalty bonus', 15E0, 0.15E0), ('Low', 'No intervention', 0E0, 0E0)),
tiered AS (SELECT *, CASE WHEN churn_probability >= 0.9E0 THEN 'Critical'
  WHEN churn_probability >= 0.7E0 THEN 'High' WHEN churn_probability >= 0.5E0 THEN 'Medium'
  ELSE 'Low' END AS risk_level FROM scored),
acted AS (SELECT t.*, s.retention_strategy, s.retention_cost, s.success_rate,
  churn_probability * clv_estimate * s.success_rate AS expected_revenue_saved
  FROM tiered t JOIN strategies s USING (risk_level))
"""

_SEGMENT = ["tenure", "MonthlyCharges", "clv_estimate", "engagement_score", "churn_probability"]
_CENTROIDS = """(0, 57.5E0, 107.5E0, 4900E0, 7.75E0, 0.125E0), (1, 7E0, 97.5E0, 800E0, 3.75E0, 0.825E0),
  (2, 9.5E0, 32.5E0, 375E0, 1.75E0, 0.725E0), (3, 2.5E0, 77.5E0, 225E0, 2.25E0, 0.625E0),
  (4, 29E0, 59E0, 2150E0, 4.9E0, 0.225E0)"""
_DISTANCE = " + ".join(
    f"pow((s.{c} - st.a{i}) / st.d{i} - (c.c{i} - st.a{i}) / st.d{i}, 2)"
    for i, c in enumerate(_SEGMENT))


def _best(label: str, n: int) -> str:
    taken = " UNION ALL ".join(f"SELECT cluster_id FROM m{i}" for i in range(1, n))
    free = f"AND cluster_id NOT IN ({taken})" if taken else ""
    return f"""m{n} AS (SELECT cluster_id, label FROM label_scores WHERE label = '{label}' AND score > 0 {free}
  ORDER BY score DESC, cluster_id LIMIT 1)"""


SEGMENTED = SCORED + f""",
st AS (SELECT {", ".join(f"avg({c}) AS a{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(_SEGMENT))} FROM scored),
cen(cluster_id, c0, c1, c2, c3, c4) AS (VALUES {_CENTROIDS}),
near AS (SELECT s.customerID AS cid, c.cluster_id, row_number() OVER (PARTITION BY s.customerID
  ORDER BY {_DISTANCE}, c.cluster_id) AS rn FROM scored s, st, cen c),
assigned AS (SELECT s.*, CAST(n.cluster_id AS INT) AS cluster_id FROM scored s JOIN near n ON n.cid = s.customerID AND n.rn = 1),
profiles AS (SELECT cluster_id, {", ".join(f"avg({c}) AS {c}" for c in _SEGMENT)} FROM assigned GROUP BY cluster_id),
th AS (SELECT quantile_cont(clv_estimate, 0.6) AS v60, quantile_cont(MonthlyCharges, 0.5) AS c50,
  quantile_cont(MonthlyCharges, 0.4) AS c40 FROM profiles),
label_scores AS (
  SELECT cluster_id, 'High Value Loyal' AS label, {_case("clv_estimate >= v60", "2E0", "0E0")}
    + {_case("churn_probability <= 0.35E0", "2E0", "0E0")} + {_case("tenure >= 24", "1.5E0", "0E0")} AS score FROM profiles, th
  UNION ALL SELECT cluster_id, 'High Risk High Revenue', {_case("churn_probability >= 0.55E0", "2.5E0", "0E0")}
    + {_case("MonthlyCharges >= c50", "2E0", "0E0")} FROM profiles, th
  UNION ALL SELECT cluster_id, 'Low Revenue Churners', {_case("churn_probability >= 0.45E0", "2E0", "0E0")}
    + {_case("MonthlyCharges <= c40", "2E0", "0E0")} FROM profiles, th
  UNION ALL SELECT cluster_id, 'New At Risk', {_case("tenure < 12", "3E0", "0E0")}
    + {_case("churn_probability >= 0.4E0", "1.5E0", "0E0")} FROM profiles, th
  UNION ALL SELECT cluster_id, 'Stable Customers', 1E0 + greatest(0E0, 0.5E0 - churn_probability) FROM profiles, th),
{", ".join(_best(label, i + 1) for i, label in enumerate(cfg.SEGMENT_LABELS))},
chosen AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4 UNION ALL SELECT * FROM m5),
labels_in_order(pos, label) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(cfg.SEGMENT_LABELS))}),
left_labels AS (SELECT label, row_number() OVER (ORDER BY pos) AS rn FROM labels_in_order WHERE label NOT IN (SELECT label FROM chosen)),
left_clusters AS (SELECT g AS cluster_id, row_number() OVER (ORDER BY (g NOT IN (SELECT cluster_id FROM profiles)), g) AS rn
  FROM generate_series(0, 4) t(g) WHERE g NOT IN (SELECT cluster_id FROM chosen)),
mapping AS (SELECT cluster_id, label AS segment FROM chosen
  UNION ALL SELECT c.cluster_id, coalesce(l.label, 'Stable Customers') FROM left_clusters c LEFT JOIN left_labels l USING (rn)),
segmented AS (SELECT a.*, mp.segment FROM assigned a JOIN mapping mp USING (cluster_id))
"""

# ---- encoding ------------------------------------------------------------------

_BINARY = {"gender": "WHEN 'Female' THEN 0 WHEN 'Male' THEN 1"} | {
    c: "WHEN 'No' THEN 0 WHEN 'Yes' THEN 1"
    for c in ("Partner", "Dependents", "PhoneService", "PaperlessBilling")}
_INTERNET = ["No", "No internet service", "Yes"]
_CATEGORIES = {
    "MultipleLines": ["No", "No phone service", "Yes"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    **{c: _INTERNET for c in ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                              "StreamingTV", "StreamingMovies")},
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check",
                      "Mailed check"],
    "tenure_group": ["Developing", "Loyal", "New", "Stable"],
}
_DUMMIES = [(c, v, f"{c}_{v}") for c, vs in _CATEGORIES.items() for v in vs[1:]]
_RAW_FEATURES = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
                 "PaperlessBilling", "MonthlyCharges", "TotalCharges"]
FEATURES = _RAW_FEATURES + list(cfg.ENGINEERED_COLUMNS) + [n for _, _, n in _DUMMIES]


def _encoded(c: str) -> str:
    return f"CASE {c} {_BINARY[c]} END" if c in _BINARY else c


_MATRIX = ENGINEERED + f""",
encoded AS (SELECT customerID, CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label,
  {", ".join(f"CAST({_encoded(c)} AS DOUBLE) AS {q(c)}" for c in _RAW_FEATURES + list(cfg.ENGINEERED_COLUMNS))},
  {", ".join(f"CAST({_case(f"{c} = '{v}'")} AS DOUBLE) AS {q(n)}" for c, v, n in _DUMMIES)} FROM engineered),
fit AS (SELECT {", ".join(f"avg({q(c)}) AS a{i}, CASE WHEN stddev_pop({q(c)}) = 0 THEN 1 ELSE stddev_pop({q(c)}) END AS d{i}" for i, c in enumerate(FEATURES))} FROM encoded),
matrix AS (SELECT customerID, label, {", ".join(f"({q(c)} - a{i}) / d{i} AS {q(c)}" for i, c in enumerate(FEATURES))} FROM encoded, fit)
"""

# ---- evaluation ------------------------------------------------------------------

JUDGED = SCORED + f""",
judged AS (SELECT customerID, label, {_case("churn_probability > 0.5E0")} AS prediction,
  {m("churn_probability")} AS score FROM scored WHERE label IS NOT NULL)
"""
_COUNTS = """count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0E0 END"


_METRICS = {"accuracy": _div("tp + tn", "tp + fp + fn + tn"), "precision": _div("tp", "tp + fp"),
            "recall": _div("tp", "tp + fn"), "f1": _div("2 * tp", "2 * tp + fp + fn")}
_COMPARISON = SCORED + f""",
judged AS (SELECT 'champion_scorecard' AS model, label, {_case("churn_probability > 0.5E0")} AS prediction, {m("churn_probability")} AS score FROM scored WHERE label IS NOT NULL
  UNION ALL SELECT 'challenger_scorecard', label, {_case("challenger_p > 0.5E0")}, {m("challenger_p")} FROM scored WHERE label IS NOT NULL),
counts AS (SELECT model, {_COUNTS} FROM judged GROUP BY model),
ranked AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2E0 AS r FROM judged),
auc AS (SELECT model, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2E0)
  / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS roc_auc FROM ranked GROUP BY model),
comparison AS (SELECT model, {", ".join(f"{x} AS {n}" for n, x in _METRICS.items())}, roc_auc FROM counts JOIN auc USING (model))
"""
_METADATA = _COMPARISON + f""",
best AS (SELECT * FROM comparison ORDER BY roc_auc DESC, model LIMIT 1),
meta AS (SELECT model AS best_model_name, {", ".join(f"CAST(floor({c} * 1e6 + 0.5E0) AS BIGINT) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))},
  (SELECT count(*) FROM raw) AS row_count, CAST(21 AS BIGINT) AS column_count FROM best)
"""
_STEPS = JUDGED + """,
steps AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM judged GROUP BY score),
cum AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM steps)
"""

# ---- decisions -------------------------------------------------------------------

RUNS = """runs AS (SELECT user_id % 20 AS line, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS seq,
 CASE WHEN event_id % 37 = 0 THEN 'rollback' ELSE 'train' END AS kind,
 0.80E0 + ((event_id * 7) % 41) / 1000E0 AS lr_auc, 0.60E0 + ((event_id * 13) % 31) / 100E0 AS lr_recall,
 0.80E0 + ((event_id * 11) % 43) / 1000E0 AS gbt_auc, 0.60E0 + ((event_id * 17) % 29) / 100E0 AS gbt_recall
FROM events)
"""
# A walk along each line, one event at a time.
REPLAY = RUNS + """,
walk AS (
 SELECT line, CAST(0 AS BIGINT) AS seq, CAST('none' AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS prev,
   CAST(NULL AS VARCHAR) AS champ, CAST(NULL AS DOUBLE) AS la, CAST(NULL AS DOUBLE) AS ga,
   CAST(NULL AS DOUBLE) AS champion_metric, CAST(NULL AS DOUBLE) AS challenger_metric
 FROM (SELECT DISTINCT line FROM runs)
 UNION ALL
 SELECT line, seq, action, prev, champ, la, ga,
   CASE WHEN champ IS NULL THEN NULL WHEN basis = 'L' THEN la ELSE ga END,
   CASE WHEN champ IS NULL THEN NULL WHEN basis = 'L' THEN ga ELSE la END
 FROM (SELECT *, CASE WHEN action IN ('initial', 'manual_rollback') THEN champ ELSE prev END AS basis FROM (
  SELECT *, CASE action WHEN 'rejected' THEN NULL WHEN 'initial' THEN CASE WHEN la >= ga THEN 'L' ELSE 'G' END
     WHEN 'retain' THEN prev ELSE CASE WHEN prev = 'L' THEN 'G' ELSE 'L' END END AS champ FROM (
   SELECT r.line, r.seq, w.champ AS prev,
    CASE WHEN r.kind = 'train' THEN r.lr_auc ELSE w.la END AS la, CASE WHEN r.kind = 'train' THEN r.gbt_auc ELSE w.ga END AS ga,
    CASE WHEN r.kind = 'rollback' THEN CASE WHEN w.champ IS NULL THEN 'rejected' ELSE 'manual_rollback' END
     WHEN w.champ IS NULL THEN 'initial'
     WHEN w.champ = 'L' AND r.gbt_auc - r.lr_auc >= 0.005E0 AND r.gbt_recall >= 0.7E0 THEN 'promote'
     WHEN w.champ = 'G' AND r.lr_auc - r.gbt_auc >= 0.005E0 AND r.lr_recall >= 0.7E0 THEN 'promote'
     ELSE 'retain' END AS action
   FROM walk w JOIN runs r ON r.line = w.line AND r.seq = w.seq + 1)))),
history AS (SELECT line, seq, action,
  CASE prev WHEN 'L' THEN 'logistic_regression' WHEN 'G' THEN 'gbt' END AS previous_champion,
  CASE champ WHEN 'L' THEN 'logistic_regression' WHEN 'G' THEN 'gbt' END AS new_champion,
  champion_metric, challenger_metric, challenger_metric - champion_metric AS delta FROM walk WHERE seq > 0)
"""

# ---- explanations ------------------------------------------------------------------

_WEIGHTS = {"contract_risk": "0.9E0", "payment_risk_score": "0.5E0", "tenure": "-0.04E0",
            "MonthlyCharges": "0.02E0", "engagement_score": "-0.1E0"}
CONTRIBUTED = SCORED + f""",
bg AS (SELECT {", ".join(f"avg({c}) AS b{i}" for i, c in enumerate(_WEIGHTS))} FROM (
  SELECT * FROM scored ORDER BY md5(customerID || '|42'), customerID LIMIT 200)),
contributed AS ({" UNION ALL ".join(
    f"SELECT customerID, {i} AS pos, '{c}' AS feature, {w} * ({c} - b{i}) AS shap_value FROM scored, bg"
    for i, (c, w) in enumerate(_WEIGHTS.items()))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(shap_value) DESC, pos) AS rank FROM contributed),
importance AS (SELECT feature, avg(abs(shap_value)) AS importance FROM contributed GROUP BY feature)
"""

# ---- log lines ---------------------------------------------------------------------

LOG = """log AS (SELECT event_id, ts, concat('line user=', cast(user_id as varchar), ' customerID=CUST-', cast(user_id as varchar),
  ' MonthlyCharges=', cast(cast(value as decimal(12,2)) as varchar), ' {', chr(39), 'tenure', chr(39), ': ',
  cast(event_id % 72 as varchar), ', "PaymentMethod": "Mailed check", ', chr(39), 'note', chr(39), ': ', chr(39), 'ok', chr(39), '}') AS msg
FROM events)"""


def _masked(expr: str) -> str:
    for f in sorted(cfg.SENSITIVE_FIELDS, key=lambda n: (-len(n), n)):
        quoted = rf"""(''{f}''|"{f}")\s*:\s*(''[^'']*''|"[^"]*"|\d+\.?\d*)"""
        expr = f"regexp_replace({expr}, '{quoted}', '\\1: ''[REDACTED]''', 'g')"
        expr = f"regexp_replace({expr}, '({f}=)([^\\s,}}]+)', '\\1[REDACTED]', 'g')"
    return expr


# ---- profiling -----------------------------------------------------------------------


def _role(c: str) -> str:
    if c == "customerID":
        return "id"
    if c == "Churn":
        return "target"
    if c in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"):
        return "numeric"
    return "binary" if c in _BINARY else "categorical"


_KINDS = {"SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}
_PROFILE = " UNION ALL ".join(f"""SELECT '{c}' AS name, '{_KINDS.get(c, "string")}' AS dtype, '{_role(c)}' AS semantic_type,
 count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
 (SELECT string_agg(v, '|' ORDER BY customerID) FROM (SELECT customerID, CAST({c} AS VARCHAR) AS v FROM raw
   WHERE {c} IS NOT NULL ORDER BY customerID LIMIT 3)) AS samples FROM raw""" for c in cfg.RAW_COLUMNS)


def _missing(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL"
        + ("" if c in ("SeniorCitizen", "tenure", "MonthlyCharges")
           else f" OR regexp_matches({c}, '^\\s*$')") + f") AS missing FROM {source}"
        for c in cfg.RAW_COLUMNS)


_RULES = [f"CASE WHEN {c} IS NULL THEN '{c} required' END" for c in cfg.RAW_COLUMNS[1:-1]] + [
    "CASE WHEN SeniorCitizen < 0 THEN 'SeniorCitizen below 0' END",
    "CASE WHEN SeniorCitizen > 1 THEN 'SeniorCitizen above 1' END",
    "CASE WHEN tenure < 0 THEN 'tenure below 0' END",
    "CASE WHEN MonthlyCharges < 0 THEN 'MonthlyCharges below 0' END",
    f"CASE WHEN TotalCharges IS NOT NULL AND ({parsed('TotalCharges')}) IS NULL THEN 'TotalCharges not a number' END",
    f"CASE WHEN ({parsed('TotalCharges')}) < 0 THEN 'TotalCharges below 0' END",
]
_NUMBERS = SUBSCRIBERS + f""",
nums AS (SELECT CAST(SeniorCitizen AS DOUBLE) AS SeniorCitizen, CAST(tenure AS DOUBLE) AS tenure, MonthlyCharges,
  {parsed('TotalCharges')} AS TotalCharges FROM raw)"""
_DESCRIBE = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS n, {m(f"avg({c})")} AS mean, {m(f"stddev_samp({c})")} AS std,
 {m(f"min({c})")} AS min, {m(f"quantile_cont({c}, 0.25)")} AS p25, {m(f"quantile_cont({c}, 0.5)")} AS p50,
 {m(f"quantile_cont({c}, 0.75)")} AS p75, {m(f"max({c})")} AS max FROM nums"""
                              for c in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"))
_OUTLIERS = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, {m("lo")} AS lower_bound, {m("hi")} AS upper_bound,
 (SELECT count(*) FROM nums WHERE {c} < lo OR {c} > hi) AS outlier_count
 FROM (SELECT q1 - 1.5E0 * (q3 - q1) AS lo, q3 + 1.5E0 * (q3 - q1) AS hi FROM (
   SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM nums))"""
                              for c in ("tenure", "MonthlyCharges", "TotalCharges"))

_PREDICT_COLUMNS = f"""customerID, 'champion_scorecard' AS served_by_model, {m("churn_probability", "churn_probability")}, risk_level,
 retention_strategy, {m("retention_cost", "retention_cost")}, {m("expected_revenue_saved", "expected_revenue_saved")}, {m("clv_estimate", "clv")}"""
_SHADOW_COLUMNS = f"""{m("challenger_p", "challenger_probability")}, CAST({_case("challenger_p >= 0.5E0")} AS INT) AS challenger_class"""
_ROUND_RAW = f"* REPLACE ({m('MonthlyCharges')} AS MonthlyCharges)"
def _sampled_settings() -> list[dict]:
    """Fifteen settings of the published grid, drawn with its seed."""
    grid = [dict(zip(cfg.GBT_GRID, x)) for x in itertools.product(*cfg.GBT_GRID.values())]
    return random.Random(cfg.SEED).sample(grid, cfg.SEARCH_SETTINGS)


_SPLIT = """SELECT customerID, label, row_number() OVER (PARTITION BY label ORDER BY md5(customerID || '|42'), customerID) AS r,
 count(*) OVER (PARTITION BY label) AS n FROM (SELECT customerID, CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label FROM raw)"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


def _features(*cols: str) -> str:
    doubles = {"engagement_score", "payment_risk_score", "customer_lifetime_revenue",
               "avg_monthly_value", "revenue_risk", "clv_estimate", "tenure"}
    return _with(ENGINEERED, "SELECT customerID, " + ", ".join(
        m(c, c) if c in doubles else c for c in cols) + " FROM engineered")


_ENGINEERED_OUT = ", ".join(
    m(c, c) if c in ("engagement_score", "payment_risk_score", "customer_lifetime_revenue",
                     "avg_monthly_value", "revenue_risk", "clv_estimate") else c
    for c in cfg.ENGINEERED_COLUMNS)


def oracle_sql() -> dict[str, str]:
    sql = {}
    # sources and sinks
    sql["scan_subscribers"] = _with(SUBSCRIBERS, f"""SELECT * REPLACE ({m('MonthlyCharges')} AS MonthlyCharges,
      nullif(TotalCharges, 'n/a') AS TotalCharges) FROM raw""")
    sql["scan_processed"] = _with(SEGMENTED, f"SELECT customerID, segment, {', '.join(m(c, c) for c in ('tenure', 'MonthlyCharges', 'clv_estimate', 'churn_probability'))} FROM segmented")
    sql["roundtrip_processed"] = _with(SEGMENTED, f"SELECT customerID, tenure_group, {_ENGINEERED_OUT}, {m('churn_probability', 'churn_probability')}, segment FROM segmented")
    sql["roundtrip_assignments"] = _with(SEGMENTED, f"SELECT customerID, segment, cluster_id, {m('churn_probability', 'churn_probability')} FROM segmented")
    comparison = _with(_COMPARISON, "SELECT model, " + ", ".join(
        m(c, c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")) + " FROM comparison")
    sql["roundtrip_comparison"] = comparison
    sql["roundtrip_importance"] = _with(CONTRIBUTED, f"SELECT feature, {m('importance', 'importance')} FROM importance")
    sql["run_metadata_json"] = _with(_METADATA, "SELECT *, 'contract_risk,payment_risk_score,tenure,MonthlyCharges,engagement_score' AS feature_columns FROM meta")
    sql["run_checksum"] = _with(_METADATA, """SELECT best_model_name, md5('{"best_model_name":"' || best_model_name || '","metrics":{"accuracy":' || accuracy
      || ',"precision":' || precision || ',"recall":' || recall || ',"f1":' || f1 || ',"roc_auc":' || roc_auc
      || '},"validation_report":{"row_count":' || row_count || ',"column_count":' || column_count
      || '},"feature_columns":["contract_risk","payment_risk_score","tenure","MonthlyCharges","engagement_score"]}') AS checksum FROM meta""")
    log_rows = " UNION ALL ".join(
        f"SELECT 'run-1' AS run_id, model, '{c}' AS metric, {m(c)} AS value FROM comparison UNION ALL "
        f"SELECT * FROM (SELECT 'run-1', 'champion', '{c}', {m(c)} FROM comparison ORDER BY roc_auc DESC, model LIMIT 1)"
        for c in ("accuracy", "precision", "recall", "f1", "roc_auc"))
    sql["training_run_log"] = _with(_COMPARISON, log_rows)
    sql["roundtrip_model_state"] = "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM customer"
    sql["publish_run"] = _with(SCORED, """SELECT 'run-1' AS attempt, 'run-1' AS live_run, count(*) AS live_rows FROM scored
      UNION ALL SELECT 'run-2', 'run-1', count(*) FROM scored
      UNION ALL SELECT 'run-3', 'run-3', count(*) FROM scored WHERE churn_probability >= 0.5E0""")
    # profiling and validation
    sql["profile_columns"] = _with(SUBSCRIBERS, _PROFILE)
    sql["table_shape"] = _with(SUBSCRIBERS, "SELECT count(*) AS row_count, CAST(21 AS BIGINT) AS column_count FROM raw")
    sql["missing_values"] = _with(SUBSCRIBERS, f"SELECT * FROM ({_missing('raw')}) WHERE missing > 0")
    sql["duplicate_ids"] = _with(SUBSCRIBERS, "SELECT count(*) - count(DISTINCT customerID) AS duplicate_ids FROM copies")
    sql["duplicate_rows"] = _with(SUBSCRIBERS, """SELECT (SELECT count(*) FROM copies) - (SELECT count(*) FROM (
      SELECT DISTINCT * EXCLUDE (load_seq, MonthlyCharges) FROM copies)) AS duplicate_rows""")
    sql["dtype_issues"] = _with(SUBSCRIBERS, f"""SELECT 'TotalCharges' AS column_name, count(*) AS invalid,
      'Non-numeric values found in TotalCharges: ' || count(*) AS issue
      FROM raw WHERE TotalCharges IS NOT NULL AND ({parsed('TotalCharges')}) IS NULL HAVING count(*) > 0""")
    sql["iqr_outliers"] = _with(_NUMBERS, _OUTLIERS)
    sql["target_distribution"] = _with(SUBSCRIBERS, "SELECT Churn, count(*) AS n FROM raw WHERE Churn IS NOT NULL GROUP BY Churn")
    sql["critical_issues"] = _with(SUBSCRIBERS, f"""SELECT 'Duplicate customer IDs detected' AS issue FROM copies HAVING count(*) > count(DISTINCT customerID)
      UNION ALL SELECT 'Missing values in ' || column_name || ': ' || missing FROM ({_missing('copies')}) WHERE missing > 0 AND column_name <> 'TotalCharges'""")
    sql["validation_report"] = _with(_NUMBERS, f"""SELECT 'shape' AS section, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM raw
      UNION ALL SELECT 'shape', 'columns', 21E0
      UNION ALL SELECT 'missing', column_name, CAST(missing AS DOUBLE) FROM ({_missing('raw')}) WHERE missing > 0
      UNION ALL SELECT 'duplicates', 'ids', CAST(count(*) - count(DISTINCT customerID) AS DOUBLE) FROM raw
      UNION ALL SELECT 'duplicates', 'rows', CAST((SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS DOUBLE)
      UNION ALL SELECT 'dtype', 'TotalCharges', CAST(count(*) AS DOUBLE) FROM raw
        WHERE TotalCharges IS NOT NULL AND ({parsed('TotalCharges')}) IS NULL HAVING count(*) > 0
      UNION ALL SELECT 'outliers', column_name, CAST(outlier_count AS DOUBLE) FROM ({_OUTLIERS})
      UNION ALL SELECT 'target', Churn, CAST(count(*) AS DOUBLE) FROM raw WHERE Churn IS NOT NULL GROUP BY Churn""")
    sql["describe_numeric"] = _with(_NUMBERS, _DESCRIBE)
    texts = [c for c in cfg.RAW_COLUMNS if c not in ("SeniorCitizen", "tenure", "MonthlyCharges")]
    sql["describe_text"] = _with(SUBSCRIBERS, " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, CAST(sum(k) OVER () AS BIGINT) AS n, count(*) OVER () AS unique_count, v AS top, k AS freq
          FROM (SELECT {c} AS v, count(*) AS k FROM raw WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY k DESC, v LIMIT 1)""" for c in texts))
    sql["contract_violations"] = _with(SUBSCRIBERS, f"SELECT customerID, violations, CAST(violations = '' AS INT) AS accepted FROM (SELECT customerID, concat_ws('; ', {', '.join(_RULES)}) AS violations FROM raw)")
    # cleaning
    sql["clean_total_charges"] = _with(SUBSCRIBERS, f"SELECT customerID, {m(parsed('TotalCharges'), 'TotalCharges')} FROM raw")
    sql["coerce_numeric"] = _with(_NUMBERS.replace("nums AS (SELECT ", "nums AS (SELECT customerID, "),
                                  f"SELECT customerID, {', '.join(m(c, c) for c in cfg.NUMERIC_COLUMNS)} FROM nums")
    first = "SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY customerID ORDER BY load_seq) = 1"
    sql["dedup_keep_first"] = _with(SUBSCRIBERS, f"SELECT {_ROUND_RAW} FROM ({first})")
    sql["fit_medians"] = _with(SUBSCRIBERS + f", firsts AS ({first}), p AS ({prepared('firsts')})", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {m(f'median({c})')} AS median FROM p" for c in cfg.NUMERIC_COLUMNS))
    sql["clean_subscribers"] = _with(CLEANED, f"SELECT * REPLACE ({', '.join(m(c) + f' AS {c}' for c in ('tenure', 'MonthlyCharges', 'TotalCharges'))}) FROM cleaned")
    # features
    sql["tenure_groups"] = _features("tenure", "tenure_group")
    sql["service_counts"] = _features("service_count")
    sql["engagement_scores"] = _features("engagement_score")
    sql["payment_risk"] = _features("payment_risk_score")
    sql["contract_risk"] = _features("Contract", "contract_risk")
    sql["revenue_features"] = _features("customer_lifetime_revenue", "avg_monthly_value", "revenue_risk")
    sql["clv_estimates"] = _features("clv_estimate")
    sql["churn_flags"] = _features("is_new_customer", "has_high_charges", "has_no_contract", "has_low_engagement", "churn_propensity_score")
    sql["engineer_features"] = _features("tenure_group", *cfg.ENGINEERED_COLUMNS)
    # encoding and scaling
    sql["encode_binary"] = _with(SUBSCRIBERS, f"SELECT customerID, {', '.join(f'CAST({_encoded(c)} AS INT) AS {c}' for c in cfg.BINARY_COLUMNS)} FROM raw")
    sql["fit_categories"] = _with(ENGINEERED, " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS position, v AS category FROM (SELECT DISTINCT {c} AS v FROM engineered WHERE {c} IS NOT NULL)"
        for c in _CATEGORIES))
    dummies = ", ".join(f"CAST({_case(f"{c} = '{v}'")} AS INT) AS {q(n)}" for c, v, n in _DUMMIES)
    sql["encode_onehot"] = _with(ENGINEERED, f"SELECT customerID, {dummies} FROM engineered")
    sql["align_features"] = _with(ENGINEERED, f"SELECT customerID, {m('clv_estimate', 'clv_estimate')}, 0E0 AS engagement_score, {m('tenure', 'tenure')}, {m('MonthlyCharges', 'MonthlyCharges')}, service_count FROM engineered")
    sql["scale_features"] = _with(_MATRIX, f"SELECT customerID, {', '.join(m(q(c), c) for c in cfg.ENGINEERED_COLUMNS)} FROM matrix")
    sql["model_matrix"] = _with(_MATRIX, f"SELECT customerID, label, {', '.join(m(q(c), c) for c in FEATURES)} FROM matrix")
    # split and resample
    sql["stratified_split"] = _with(SUBSCRIBERS, f"SELECT customerID, label, CAST(r <= ceil(0.2E0 * n) AS INT) AS is_test FROM ({_SPLIT})")
    sql["training_rows"] = _with(SUBSCRIBERS, f"SELECT label, CAST(r <= ceil(0.2E0 * n) AS INT) AS is_test, count(*) AS n FROM ({_SPLIT}) WHERE label IS NOT NULL GROUP BY ALL")
    number = lambda x: "NULL" if x is None else str(x)
    settings = [("logistic_regression", i, c, None, None, None, None, None) for i, c in enumerate(cfg.LOGISTIC_C)]
    settings += [("gbt", i, None, *s.values()) for i, s in enumerate(_sampled_settings())]
    values = ", ".join(f"('{name}', {', '.join(map(number, rest))})" for name, *rest in settings)
    sql["tuning_grid"] = _with(SUBSCRIBERS, f"""SELECT fold, model, CAST(setting AS INT) AS setting, CAST(c AS DOUBLE) AS c, CAST(n_estimators AS INT) AS n_estimators,
      CAST(max_depth AS INT) AS max_depth, CAST(learning_rate AS DOUBLE) AS learning_rate, CAST(num_leaves AS INT) AS num_leaves,
      CAST(subsample AS DOUBLE) AS subsample, n_yes, n_no
      FROM (VALUES {values}) AS g(model, setting, c, n_estimators, max_depth, learning_rate, num_leaves, subsample),
      (SELECT CAST((r - 1) % 5 AS INT) AS fold, count(*) FILTER (WHERE label = 1) AS n_yes, count(*) FILTER (WHERE label = 0) AS n_no
       FROM ({_SPLIT}) WHERE label IS NOT NULL GROUP BY 1)""")
    held = f"SELECT count(*) FROM ({_SPLIT}) WHERE label IS NOT NULL AND r <= ceil(0.2E0 * n)"
    checks = [("holdout rows of logistic_regression", f"({held})"), ("holdout rows of gbt", f"({held})"), ("rows of the matrix", f"({held})"),
              *[(c, "0") for c in ("scores off", "gradient off", "auc of logistic_regression below 0.7", "auc of gbt below 0.7", "importances off one",
                                   "negative importances of logistic_regression", "negative importances of gbt")],
              *[(c, "46") for c in ("features of logistic_regression", "features of gbt", "permuted features")]]
    sql["model_invariants"] = _with(SUBSCRIBERS, " UNION ALL ".join(f"SELECT '{c}' AS check_name, CAST({n} AS BIGINT) AS n" for c, n in checks))
    searched = [("settings of logistic_regression", "4"), ("settings of gbt", "15"), ("lines", "20"), ("holdout rows", f"({held})"),
                *[(c, "0") for c in ("scores of logistic_regression not above chance", "scores of gbt not above chance", "better settings of logistic_regression than the chosen",
                                     "better settings of gbt than the chosen", "lines off the optimum", "trees off their number", "trees with too many leaves")]]
    sql["search_invariants"] = _with(SUBSCRIBERS, " UNION ALL ".join(f"SELECT '{c}' AS check_name, CAST({n} AS BIGINT) AS n" for c, n in searched))
    profiled = [("rows", "(SELECT count(*) FROM raw)"), ("columns", "21"), *[(c, "0") for c in (
        "nulls off", "distinct counts off", "numbers off", "moments off", "extremes off", "quartiles off")]]
    sql["profile_state_invariants"] = _with(SUBSCRIBERS, " UNION ALL ".join(f"SELECT '{c}' AS check_name, CAST({n} AS BIGINT) AS n" for c, n in profiled))
    sql["kmeans_invariants"] = _with(SUBSCRIBERS, "SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_clusters, CAST(0 AS BIGINT) AS n_off FROM raw")
    sql["score_without_ids"] = _with(SUBSCRIBERS, "SELECT CAST(gender = 'Female' AS INT) AS anonymous, count(*) AS n, count(*) AS n_scored FROM raw GROUP BY 1")
    sql["stream_quarantine"] = _with(SUBSCRIBERS, f"SELECT * FROM (SELECT customerID, concat_ws('; ', {', '.join(_RULES)}) AS violations FROM raw) WHERE violations <> ''")
    sql["stratified_folds"] = _with(SUBSCRIBERS, f"SELECT customerID, label, CAST((r - 1) % 5 AS INT) AS fold FROM ({_SPLIT})")
    sql["background_sample"] = _with(SCORED, f"SELECT customerID, {m('churn_probability', 'churn_probability')} FROM scored ORDER BY md5(customerID || '|42'), customerID LIMIT 200")
    squares = " + ".join(f"(a.{q(c)} - b.{q(c)}) * (a.{q(c)} - b.{q(c)})" for c in FEATURES)
    sql["smote_knn"] = _with(_MATRIX + f""", mino AS (SELECT * FROM matrix WHERE label = 1),
      pairs AS (SELECT a.customerID AS customerID, b.customerID AS neighbor, floor(({squares}) * 1e6 + 0.5E0) AS d
        FROM mino a JOIN mino b ON a.customerID <> b.customerID),
      best AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY d, neighbor) AS rn FROM pairs)""",
                             f"SELECT customerID, CAST(rn AS INT) AS rank, neighbor, {m('d / 1e6', 'squared_distance')} FROM best WHERE rn <= 5")
    sql["smote_balance"] = _with(SUBSCRIBERS, """SELECT greatest(n, y) AS n_no, greatest(n, y) AS n_yes, abs(n - y) AS n_synthetic, CAST(0 AS BIGINT) AS n_off_segment
      FROM (SELECT count(*) FILTER (Churn = 'No') AS n, count(*) FILTER (Churn = 'Yes') AS y FROM raw)""")
    # evaluation
    sql["classification_metrics"] = _with(JUDGED, f"SELECT {', '.join(m(x, n) for n, x in _METRICS.items())} FROM (SELECT {_COUNTS} FROM judged)")
    sql["roc_auc"] = _with(_COMPARISON, f"SELECT {m('roc_auc', 'roc_auc')} FROM comparison WHERE model = 'champion_scorecard'")
    sql["confusion_matrix"] = _with(JUDGED, """SELECT CAST(l AS INT) AS label, CAST(p AS INT) AS prediction, (SELECT count(*) FROM judged j WHERE j.label = l AND j.prediction = p) AS n
      FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(l, p)""")
    sql["roc_curve"] = _with(_STEPS, f"SELECT score AS threshold, {m('fp / CAST(n AS DOUBLE)', 'fpr')}, {m('tp / CAST(p AS DOUBLE)', 'tpr')} FROM cum UNION ALL SELECT NULL, 0E0, 0E0")
    sql["pr_curve"] = _with(_STEPS, f"SELECT score AS threshold, {m('tp / CAST(tp + fp AS DOUBLE)', 'precision')}, {m('tp / CAST(p AS DOUBLE)', 'recall')} FROM cum UNION ALL SELECT NULL, 1E0, 0E0")
    per_class = f"""c AS (SELECT cls, count(*) FILTER (label = cls AND prediction = cls) AS hit, count(*) FILTER (prediction = cls) AS said,
        count(*) FILTER (label = cls) AS support FROM judged, (VALUES (0), (1)) t(cls) GROUP BY cls),
      r AS (SELECT cls, {_div('hit', 'said')} AS p, {_div('hit', 'support')} AS r, {_div('2 * hit', 'said + support')} AS f, support, hit FROM c)"""
    sql["classification_report"] = _with(JUDGED + ", " + per_class, f"""
      SELECT CAST(cls AS VARCHAR) AS class, {m('p', 'precision')}, {m('r', 'recall')}, {m('f', 'f1')}, support FROM r
      UNION ALL SELECT 'accuracy', {m('sum(hit) / CAST(sum(support) AS DOUBLE)')}, {m('sum(hit) / CAST(sum(support) AS DOUBLE)')}, {m('sum(hit) / CAST(sum(support) AS DOUBLE)')}, CAST(sum(support) AS BIGINT) FROM r
      UNION ALL SELECT 'macro avg', {m('avg(p)')}, {m('avg(r)')}, {m('avg(f)')}, CAST(sum(support) AS BIGINT) FROM r
      UNION ALL SELECT 'weighted avg', {m('sum(p * support) / sum(support)')}, {m('sum(r * support) / sum(support)')}, {m('sum(f * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM r""")
    sql["model_comparison"] = comparison
    changed = ", ".join(
        f"avg({_case(f'({_logistic(f't.margin + {w} * (d.{c} - t.{c})')} > 0.5E0) = (t.label = 1)', '1E0', '0E0')}) AS m{i}"
        for i, (c, w) in enumerate(_WEIGHTS.items()))
    sql["permutation_importance"] = _with(SCORED + f""",
      rows_ AS (SELECT customerID, label, {_CHAMPION_MARGIN} AS margin, {', '.join(_WEIGHTS)} FROM scored WHERE label IS NOT NULL),
      t AS (SELECT *, row_number() OVER (ORDER BY md5(customerID || '|42'), customerID) AS rk FROM rows_),
      d AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY md5(customerID || '|deal|' || rep), customerID) AS rk FROM rows_, generate_series(1, 10) g(rep)),
      acc AS (SELECT avg({_case(f"({_logistic('t.margin')} > 0.5E0) = (t.label = 1)", '1E0', '0E0')}) AS base, {changed} FROM t JOIN d USING (rk))""",
                                          " UNION ALL ".join(f"SELECT '{c}' AS feature, {m(f'base - m{i}', 'importance')} FROM acc" for i, c in enumerate(_WEIGHTS)))
    # scoring
    sql["score_customers"] = _with(SCORED, f"SELECT customerID, {m('churn_probability', 'churn_probability')} FROM scored")
    sql["predict_batch"] = _with(SCORED, f"SELECT {_PREDICT_COLUMNS} FROM acted")
    sql["predict_single"] = _with(SCORED, f"SELECT {_PREDICT_COLUMNS}, 'challenger_scorecard' AS challenger_model, {_SHADOW_COLUMNS} FROM acted WHERE customerID = 'Customer#000000042'")
    shadow = f"SELECT customerID, churn_probability, CAST({_case('churn_probability > 0.5E0')} AS INT) AS prediction, challenger_p, CAST({_case('challenger_p >= 0.5E0')} AS INT) AS challenger_prediction FROM scored"
    sql["shadow_scores"] = _with(SCORED, f"SELECT customerID, {m('churn_probability', 'churn_probability')}, prediction, {m('challenger_p', 'challenger_probability')}, challenger_prediction FROM ({shadow})")
    sql["shadow_agreement"] = _with(SCORED, f"""SELECT prediction, challenger_prediction, count(*) AS n, {m('avg(abs(churn_probability - challenger_p))', 'mean_abs_diff')},
      {m('avg(churn_probability)', 'avg_champion')}, {m('avg(challenger_p)', 'avg_challenger')} FROM ({shadow}) GROUP BY prediction, challenger_prediction""")
    sql["risk_tiers"] = _with(SCORED, f"""SELECT risk_level, count(*) AS n, {m('avg(churn_probability)', 'avg_probability')},
      {m('sum(churn_probability * clv_estimate)', 'revenue_at_risk')}, {m('avg(clv_estimate)', 'avg_clv')} FROM acted GROUP BY risk_level""")
    sql["retention_actions"] = _with(SCORED, f"SELECT customerID, risk_level, retention_strategy, {m('retention_cost', 'retention_cost')}, {m('success_rate', 'success_rate')}, {m('expected_revenue_saved', 'expected_revenue_saved')} FROM acted")
    # segmentation
    sql["segment_features"] = _with(SCORED, f"SELECT customerID, {', '.join(m(c, c) for c in _SEGMENT)} FROM scored")
    sql["segment_features_scaled"] = _with(SEGMENTED, f"SELECT customerID, {', '.join(m(f'({c} - a{i}) / d{i}', c) for i, c in enumerate(_SEGMENT))} FROM scored, st")
    sql["cluster_profiles"] = _with(SEGMENTED, f"SELECT cluster_id, {', '.join(m(c, c) for c in _SEGMENT)} FROM profiles")
    sql["segment_label_scores"] = _with(SEGMENTED, f"SELECT cluster_id, label, {m('score', 'score')} FROM label_scores")
    sql["segment_label_mapping"] = _with(SEGMENTED, "SELECT CAST(cluster_id AS INT) AS cluster_id, segment FROM mapping")
    sql["assign_segments"] = _with(SEGMENTED, "SELECT customerID, cluster_id, segment FROM segmented")
    # decisions
    sql["promotion_decisions"] = _with(RUNS, f"""SELECT line, seq, {m('gbt_auc - lr_auc', 'delta')}, {m('gbt_recall', 'challenger_recall')},
      {m('(line % 8 + 1) / 1000E0', 'threshold')}, CASE WHEN gbt_auc - lr_auc >= (line % 8 + 1) / 1000E0 AND gbt_recall >= 0.7E0 THEN 'promote' ELSE 'retain' END AS action
      FROM runs WHERE kind = 'train'""")
    history = f"line, seq, action, previous_champion, new_champion, {m('champion_metric', 'champion_metric')}, {m('challenger_metric', 'challenger_metric')}, {m('delta', 'delta')}"
    sql["promotion_replay"] = _with(REPLAY, f"SELECT {history} FROM history", recursive=True)
    sql["current_roles"] = _with(REPLAY, """SELECT line, new_champion AS champion, CASE new_champion WHEN 'gbt' THEN 'logistic_regression' ELSE 'gbt' END AS challenger,
      seq, action AS last_action FROM history WHERE action <> 'rejected' QUALIFY row_number() OVER (PARTITION BY line ORDER BY seq DESC) = 1""", recursive=True)
    sql["recent_promotions"] = _with(REPLAY, f"SELECT {history} FROM (SELECT * FROM history WHERE action <> 'rejected' QUALIFY row_number() OVER (PARTITION BY line ORDER BY seq DESC) <= 10)", recursive=True)
    stored = REPLAY.replace("0.005E0", "((r.line % 8 + 1) / 1000E0)")
    sql["registry_status"] = _with(stored, f"""SELECT line, new_champion AS champion, CASE new_champion WHEN 'gbt' THEN 'logistic_regression' ELSE 'gbt' END AS challenger,
      seq, action AS last_action, {m('(line % 8 + 1) / 1000E0', 'threshold')}, n_entries, recent_actions
      FROM (SELECT * FROM history WHERE action <> 'rejected' QUALIFY row_number() OVER (PARTITION BY line ORDER BY seq DESC) = 1)
      JOIN (SELECT line, count(*) AS n_entries FROM history WHERE action <> 'rejected' GROUP BY line) USING (line)
      JOIN (SELECT line, string_agg(action, ',' ORDER BY seq) AS recent_actions FROM (
        SELECT * FROM history WHERE action <> 'rejected' QUALIFY row_number() OVER (PARTITION BY line ORDER BY seq DESC) <= 10) GROUP BY line) USING (line)""", recursive=True)
    # explanations
    sql["linear_contributions"] = _with(CONTRIBUTED, f"SELECT customerID, feature, {m('shap_value', 'shap_value')} FROM contributed")
    sql["top_contributors"] = _with(CONTRIBUTED, f"SELECT customerID, CAST(rank AS INT) AS rank, feature, {m('shap_value', 'shap_value')} FROM ranked WHERE rank <= 5")
    sql["explanation_text"] = _with(CONTRIBUTED, """SELECT customerID, 'Why this customer may churn: ' || string_agg(replace(feature, '_', ' ')
      || CASE WHEN shap_value > 0 THEN ' increases' ELSE ' decreases' END || ' churn risk', '; ' ORDER BY rank) || '.' AS explanation FROM ranked WHERE rank <= 3 GROUP BY customerID""")
    sql["global_importance"] = _with(CONTRIBUTED, f"SELECT feature, {m('importance', 'importance')} FROM importance ORDER BY importance DESC, feature LIMIT 15")
    sql["top_features"] = _with(CONTRIBUTED, f"SELECT feature, {m('importance', 'importance')} FROM importance ORDER BY importance DESC, feature LIMIT 3")
    sql["tree_contributions_sum"] = "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_off FROM customer"
    # reports
    sql["executive_kpis"] = _with(SCORED, f"""SELECT {m(f"avg({_case(chr(67) + "hurn = 'Yes'", '1E0', '0E0')})", 'churn_rate')}, {m('coalesce(sum(churn_probability * clv_estimate), 0)', 'revenue_at_risk')},
      count(*) FILTER (churn_probability >= 0.7E0) AS high_risk_count, {m('avg(clv_estimate)', 'avg_clv')} FROM scored""")
    sql["top_risk_customers"] = _with(SEGMENTED, f"""SELECT customerID, {m('tenure', 'tenure')}, {m('MonthlyCharges', 'MonthlyCharges')}, p AS churn_probability, segment
      FROM (SELECT *, {m('churn_probability')} AS p FROM segmented) WHERE p >= 0.7E0 ORDER BY p DESC, customerID LIMIT 20""")
    sql["customer_lookup"] = _with(SUBSCRIBERS, f"SELECT * EXCLUDE (Churn) REPLACE ({m('MonthlyCharges')} AS MonthlyCharges) FROM raw WHERE customerID = 'Customer#000000042' LIMIT 1")
    sql["first_customers"] = _with(SUBSCRIBERS, "SELECT customerID FROM raw WHERE customerID IS NOT NULL ORDER BY customerID LIMIT 100")
    sql["high_risk_lookup"] = _with(SCORED, f"SELECT {_ROUND_RAW} FROM raw WHERE customerID IN (SELECT customerID FROM scored WHERE churn_probability >= 0.7E0)")
    sql["segment_clv"] = _with(SEGMENTED, f"SELECT segment, {m('sum(clv_estimate)', 'clv_estimate')} FROM segmented GROUP BY segment")
    sql["segment_counts"] = _with(SEGMENTED, "SELECT segment, count(*) AS n FROM segmented GROUP BY segment")
    sql["churn_counts"] = _with(SUBSCRIBERS, "SELECT Churn, count(*) AS n FROM raw GROUP BY Churn")
    sql["tenure_charge_bins"] = _with(SEGMENTED, "SELECT CAST(floor(tenure / 6) * 6 AS INT) AS tenure_from, floor(MonthlyCharges / 10) * 10 AS charges_from, segment, count(*) AS n FROM segmented GROUP BY ALL")
    # privacy
    masked = ", ".join(f"'[REDACTED]' AS {c}" for c in cfg.RAW_COLUMNS if c != "Churn")
    sql["mask_columns"] = _with(SCORED, f"SELECT {masked}, Churn, risk_level, retention_strategy, retention_cost FROM acted")
    sql["mask_nested"] = _with(SUBSCRIBERS, """SELECT md5(customerID) AS ref, '{"customerID":"[REDACTED]","gender":"[REDACTED]","note":"seen tenure=[REDACTED]"}' AS request,
      '[{"Contract":"[REDACTED]","tag":"kept"}]' AS items FROM raw""")
    redacted = _with(LOG, f"SELECT event_id, {_masked('msg')} AS msg FROM log")
    sql["redact_text"] = redacted
    # streams
    sql["stream_score"] = _with(SCORED, f"SELECT {_PREDICT_COLUMNS}, {_SHADOW_COLUMNS} FROM acted")
    sql["stream_redact"] = redacted
    quota = "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"
    sql["quota_breaches"] = quota
    sql["stream_quota"] = quota
    return sql
