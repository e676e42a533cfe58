"""Standard SQL that states the expected result of every registered query.

Each statement is independent of the Spark code: named subqueries derive the
retention tables from the given `customer` table, and rates are rounded with
integer arithmetic so that no engine's decimal rules matter.
"""

from __future__ import annotations

import re

from keepsake import schema
from keepsake.operators import features as feat
from keepsake.operators import reports
from keepsake.operators.explain import BATCH_NAMES, ONLINE_NAMES
from keepsake.plans.fixed_model import INTERCEPT, ROWS
from keepsake.sources import star_schema as star

# --- text helpers -----------------------------------------------------------------------------


def _values(rows, names: str) -> str:
    def literal(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def _pct(part: str, total: str) -> str:
    return (
        f"CASE WHEN ({total}) = 0 THEN NULL"
        f" ELSE CAST((20000 * ({part}) + ({total})) // (2 * ({total})) AS DOUBLE) / 100.0 END"
    )


def _cents(text: str) -> str:
    return f"CAST(100 * ({text}) AS BIGINT)"


def _avg_money(column: str) -> str:
    n = f"COUNT({column})"
    return (
        f"CASE WHEN {n} = 0 THEN NULL"
        f" ELSE CAST((2 * {_cents(f'SUM({column})')} + {n}) // (2 * {n}) AS DOUBLE) / 100.0 END"
    )


def _avg_int(column: str) -> str:
    n = f"COUNT({column})"
    return f"CAST((20 * CAST(SUM({column}) AS BIGINT) + {n}) // (2 * {n}) AS DOUBLE) / 10.0"


def _sum_if(condition: str, column: str) -> str:
    return f"CAST(COALESCE(SUM({column}) FILTER (WHERE {condition}), 0) AS DOUBLE)"


N = "COUNT(*)"
CHURNED = "COUNT(*) FILTER (WHERE churn)"
RATE = _pct(CHURNED, N)


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


# --- named subqueries -------------------------------------------------------------------------

_FLAGS = ", ".join(
    f"BOOL_OR(is_subscribed AND service_name = '{service}') AS {flag}"
    for flag, service in schema.SERVICE_FLAGS.items()
)
_PROFILE = (
    "c.customer_id, c.gender, c.senior_citizen, c.partner, c.dependents, c.tenure_months,"
    " c.monthly_charges, c.total_charges, c.churn"
)
_ADD_ONS = feat.ADD_ONS
_SERVICE_INPUTS = ["phone_service", "multiple_lines", *_ADD_ONS]


def _hash(column: str, seed: int = 42) -> str:
    return f"CAST('0x' || SUBSTRING(MD5('{seed}:' || {column}), 1, 8) AS BIGINT)"


def _feature_sql(source: str, online: str, fiber: str, dsl: str, reference: dict[str, str]) -> str:
    """61 features over `source` (request-shaped); `reference` gives the mode's own four."""

    def as_int(condition: str) -> str:
        return f"CASE WHEN {condition} THEN 1 ELSE 0 END"

    first = {
        "gender_male": as_int("gender = 'Male'"),
        "is_senior": as_int("senior_citizen"),
        "has_partner": as_int("partner"),
        "has_dependents": as_int("dependents"),
        "has_family": as_int("partner OR dependents"),
        "family_size_proxy": f"{as_int('partner')} + {as_int('dependents')}",
        "senior_alone": as_int("senior_citizen AND NOT partner AND NOT dependents"),
        **{f"{s}_flag": as_int(s) for s in _SERVICE_INPUTS},
        "has_internet": as_int(online),
        "internet_fiber": as_int(fiber),
        "internet_dsl": as_int(dsl),
        "total_services": " + ".join(f"({as_int(c)})" for c in [*_SERVICE_INPUTS, online]),
        "premium_service_count": " + ".join(f"({as_int(c)})" for c in _ADD_ONS),
        "has_security_bundle": as_int("online_security OR online_backup"),
        "has_support_bundle": as_int("tech_support OR device_protection"),
        "has_streaming_bundle": as_int("streaming_tv OR streaming_movies"),
        "contract_length": "CASE contract_type WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 ELSE 0 END",
        "is_month_to_month": as_int("contract_type = 'Month-to-month'"),
        "has_long_contract": as_int("contract_type IN ('One year', 'Two year')"),
        **{flag: as_int(f"payment_method = '{m}'") for flag, m in feat.PAYMENT_FLAGS.items()},
        "has_auto_payment": as_int("payment_method LIKE '%(automatic)'"),
        "paperless_billing_flag": as_int("paperless_billing"),
        "tenure_years": "tenure_months / CAST(12 AS DOUBLE)",
        "tenure_bucket": (
            "CASE WHEN tenure_months <= 6 THEN 1 WHEN tenure_months <= 12 THEN 2 WHEN tenure_months <= 24 THEN 3"
            " WHEN tenure_months <= 48 THEN 4 WHEN tenure_months <= 72 THEN 5 ELSE 6 END"
        ),
        "is_new_customer": as_int("tenure_months <= 6"),
        "is_established": as_int("tenure_months >= 24"),
        "is_loyal": as_int("tenure_months >= 48"),
    }
    second = {
        "service_diversity": "total_services / CAST(9 AS DOUBLE)",
        "avg_monthly_spend": "CASE WHEN tenure_months > 0 THEN total_charges / tenure_months ELSE monthly_charges END",
        "charge_per_service": "CASE WHEN total_services > 0 THEN monthly_charges / total_services ELSE monthly_charges END",
        "estimated_clv": "total_charges + monthly_charges * 12",
        "tenure_contract_interaction": "tenure_months * contract_length",
        "risk_mtm": "is_month_to_month",
        "risk_new": "is_new_customer",
        "risk_echeck": "payment_electronic_check",
        "risk_no_support": as_int("has_security_bundle + has_support_bundle = 0"),
        "risk_fiber": "internet_fiber",
    }
    third = {
        **reference,
        "spending_trend": (
            "CASE WHEN avg_monthly_spend > monthly_charges THEN 1 WHEN avg_monthly_spend < monthly_charges THEN -1 ELSE 0 END"
        ),
    }
    factors = " + ".join(feat.RISK_WEIGHTS)
    risk = " + ".join(f"{w} * {f}" for f, w in feat.RISK_WEIGHTS.items())
    fourth = {
        "risk_factors_count": factors,
        "risk_score": risk,
        "high_risk_flag": as_int(f"{risk} >= 5"),
        "new_high_value": "is_new_customer * is_high_value",
        "mtm_high_value": "is_month_to_month * is_high_value",
        "senior_mtm": "is_senior * is_month_to_month",
        "fiber_no_support": "internet_fiber * (1 - has_support_bundle)",
    }
    sql = source
    for layer in (first, second, third, fourth):
        sql = f"SELECT *, {_select(layer)} FROM ({sql})"
    return sql


_SERVE_REFERENCE = {
    "monthly_charge_quartile": "LEAST(GREATEST(CAST(FLOOR(monthly_charges / 25) AS BIGINT) + 1, 1), 4)",
    "tenure_quartile": "LEAST(GREATEST(tenure_months // 18 + 1, 1), 4)",
    "is_high_value": "CASE WHEN monthly_charges > 70 THEN 1 ELSE 0 END",
    "risk_high_charge": "CASE WHEN charge_per_service > 15 THEN 1 ELSE 0 END",
}
_FIT_REFERENCE = {
    "monthly_charge_quartile": (
        "1 + (monthly_charges > QUANTILE_CONT(monthly_charges, 0.25) OVER ())::INT"
        " + (monthly_charges > QUANTILE_CONT(monthly_charges, 0.5) OVER ())::INT"
        " + (monthly_charges > QUANTILE_CONT(monthly_charges, 0.75) OVER ())::INT"
    ),
    "tenure_quartile": " + ".join(
        ["1"]
        + [
            "(4 * ((ROW_NUMBER() OVER (ORDER BY tenure_months, customer_id)) - 1)"
            f" > {i} * ((COUNT(*) OVER ()) - 1))::INT"
            for i in (1, 2, 3)
        ]
    ),
    "is_high_value": "(monthly_charges > MEDIAN(monthly_charges) OVER ())::INT",
    "risk_high_charge": "(charge_per_service > 1.5 * MEDIAN(charge_per_service) OVER ())::INT",
}

_REQUEST_FIELDS = ", ".join(
    [
        "customer_id, gender, senior_citizen, partner, dependents, tenure_months",
        "CAST(monthly_charges AS DOUBLE) AS monthly_charges",
        "COALESCE(CAST(total_charges AS DOUBLE), CAST(monthly_charges AS DOUBLE) * tenure_months, 0) AS total_charges",
        "contract_type, payment_method, COALESCE(paperless_billing, FALSE) AS paperless_billing",
        "has_phone_service AS phone_service, has_multiple_lines AS multiple_lines",
        "CASE WHEN has_fiber THEN 'Fiber optic' WHEN has_dsl THEN 'DSL' ELSE 'No' END AS internet_service",
        *[f"has_{c} AS {c}" for c in _ADD_ONS],
    ]
)


def _scaled(name: str, mean: float, std: float) -> str:
    return f"((CAST({name} AS DOUBLE) - {_number(mean)}) / {_number(std)})"


def _logit() -> str:
    out = _number(INTERCEPT)
    for name, mean, std, coef in ROWS:
        out = f"({out} + {_number(coef)} * {_scaled(name, mean, std)})"
    return out


_LEVEL = (
    "CASE WHEN probability >= 0.75 THEN 'Critical' WHEN probability >= 0.5 THEN 'High'"
    " WHEN probability >= 0.25 THEN 'Medium' ELSE 'Low' END"
)


def _scored(source: str) -> str:
    return (
        f"SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS churn_prediction, {_LEVEL} AS risk_level,"
        f" ROUND(probability, 4) AS churn_probability"
        f" FROM (SELECT *, 1.0 / (1.0 + EXP(-({_logit()}))) AS probability FROM ({source}))"
    )


_SERVE = _feature_sql(
    "SELECT * FROM {source}", "internet_service <> 'No'", "internet_service = 'Fiber optic'",
    "internet_service = 'DSL'", _SERVE_REFERENCE,
)
_VALID = (
    "tenure_months BETWEEN 0 AND 72 AND monthly_charges >= 0 AND total_charges >= 0"
    " AND contract_type IS NOT NULL AND payment_method IS NOT NULL"
)

SUBQUERIES = {
    "customers": f"SELECT {_select(star.CUSTOMERS)} FROM customer",
    "customer_contracts": f"SELECT {_select(star.CONTRACTS)} FROM customer WHERE {star.CONTRACT_PRESENT}",
    "contract_types": _values(schema.CONTRACT_TYPES, "contract_type_id, contract_name, description"),
    "service_types": _values(
        schema.SERVICE_TYPES, "service_type_id, service_name, service_category, description"
    ),
    "customer_services": (
        f"SELECT {star.SERVICE_OWNER} AS customer_id, service_type_id, {star.SERVICE_SUBSCRIBED} AS is_subscribed"
        f" FROM (SELECT *, {star.SERVICE_ID} AS service_type_id FROM customer, (SELECT UNNEST(RANGE(1, 13)) AS service_row)"
        f" WHERE {star.SERVICE_GIVEN}) WHERE {star.SERVICE_PRESENT}"
    ),
    "raw": f"SELECT {_select(star.RAW)} FROM customer",
    "contracted": (
        "SELECT * FROM customers JOIN customer_contracts USING (customer_id) JOIN contract_types USING (contract_type_id)"
    ),
    "listed": (
        "SELECT * FROM customers LEFT JOIN customer_contracts USING (customer_id) LEFT JOIN contract_types USING (contract_type_id)"
    ),
    "held": "SELECT customer_id, COUNT(*) AS subscribed_rows FROM customer_services WHERE is_subscribed GROUP BY 1",
    "counted": (
        "SELECT c.*, COALESCE(h.subscribed_rows, 0) AS subscribed_rows FROM listed c LEFT JOIN held h USING (customer_id)"
    ),
    "service_flags": (
        f"SELECT customer_id, {_FLAGS} FROM customer_services JOIN service_types USING (service_type_id) GROUP BY 1"
    ),
    "base": (
        f"SELECT {_PROFILE}, t.contract_name AS contract_type, k.payment_method, k.paperless_billing, "
        + ", ".join(f"COALESCE(f.{flag}, FALSE) AS {flag}" for flag in schema.SERVICE_FLAGS)
        + " FROM customers c LEFT JOIN customer_contracts k ON k.customer_id = c.customer_id"
        " LEFT JOIN contract_types t ON t.contract_type_id = k.contract_type_id"
        " LEFT JOIN service_flags f ON f.customer_id = c.customer_id"
    ),
    "requests": f"SELECT {_REQUEST_FIELDS} FROM base",
    "valid": f"SELECT * FROM requests WHERE {_VALID}",
    "served": _SERVE.replace("{source}", "valid"),
    "served_all": _SERVE.replace("{source}", "requests"),
    "fit_input": (
        "SELECT b.customer_id, b.churn, b.has_fiber, b.has_dsl, CAST(b.total_charges AS DOUBLE) AS total_charges,"
        " b.paperless_billing, r.* EXCLUDE (customer_id, total_charges, paperless_billing)"
        " FROM base b JOIN requests r USING (customer_id)"
    ),
    "fitted": _feature_sql(
        "SELECT * FROM fit_input", "has_fiber OR has_dsl", "has_fiber", "has_dsl", _FIT_REFERENCE
    ),
    "features": "SELECT customer_id, CAST(churn AS INT) AS churn, "
    + ", ".join(f"COALESCE({f}, 0) AS {f}" for f in schema.FEATURES)
    + " FROM fitted",
    "scored": _scored("SELECT * FROM served"),
    "phi": " UNION ALL ".join(
        f"SELECT customer_id, {i} AS position, '{name}' AS feature, CAST({name} AS DOUBLE) AS value,"
        f" {_number(coef)} * {_scaled(name, mean, std)} AS phi FROM served"
        for i, (name, mean, std, coef) in enumerate(ROWS)
    ),
    "reasons": (
        "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ABS(phi) DESC, position DESC)"
        " AS reason_rank FROM phi) WHERE reason_rank <= 3"
    ),
    "ranked_split": (
        f"SELECT customer_id, churn, CAST(churn AS INT) AS label,"
        f" ROW_NUMBER() OVER (PARTITION BY churn ORDER BY {_hash('customer_id')}, customer_id) AS place,"
        f" COUNT(*) OVER (PARTITION BY churn) AS n FROM customers"
    ),
    "parts": (
        "SELECT customer_id, label, CASE WHEN place <= CAST(FLOOR(0.2 * n + 0.5) AS BIGINT) THEN 'test' ELSE 'train' END"
        " AS part FROM ranked_split"
    ),
    "judged": (
        "SELECT customer_id, churn, CAST(risk_score AS DOUBLE) AS score, high_risk_flag AS prediction FROM features"
    ),
    "by_score": (
        "SELECT score, COUNT(*) FILTER (WHERE churn = 1) AS pos, COUNT(*) FILTER (WHERE churn = 0) AS neg"
        " FROM judged GROUP BY score"
    ),
    "cumulated": (
        "SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS pos_through, SUM(neg) OVER (ORDER BY score DESC) AS neg_through"
        " FROM by_score"
    ),
    "cells": (
        "SELECT COUNT(*) FILTER (WHERE churn = 1 AND prediction = 1) AS tp,"
        " COUNT(*) FILTER (WHERE churn = 0 AND prediction = 1) AS fp,"
        " COUNT(*) FILTER (WHERE churn = 1 AND prediction = 0) AS fn,"
        " COUNT(*) FILTER (WHERE churn = 0 AND prediction = 0) AS tn FROM judged"
    ),
    "measured": (
        "SELECT 'accuracy' AS metric, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS value FROM cells"
        " UNION ALL SELECT 'precision', CAST(tp AS DOUBLE) / (tp + fp) FROM cells"
        " UNION ALL SELECT 'recall', CAST(tp AS DOUBLE) / (tp + fn) FROM cells"
        " UNION ALL SELECT 'f1', CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) FROM cells"
        " UNION ALL SELECT 'roc_auc', SUM(neg * (pos_through - pos / 2.0)) / (SUM(pos) * SUM(neg)) FROM cumulated"
        " UNION ALL SELECT 'avg_precision',"
        " SUM(pos * CAST(pos_through AS DOUBLE) / (pos_through + neg_through)) / SUM(pos) FROM cumulated"
    ),
    "scenario_list": _values(
        [(i, *row) for i, row in enumerate(reports.SCENARIOS, start=1)],
        "scenario_order, scenario, new_contract, new_payment",
    ),
    "what_if": (
        "SELECT v.* REPLACE (v.multiple_lines AND v.phone_service AS multiple_lines, "
        + ", ".join(f"v.{c} AND v.internet_service <> 'No' AS {c}" for c in _ADD_ONS)
        + ") FROM valid v"
    ),
    "varied": (
        "SELECT w.* REPLACE (s.new_contract AS contract_type, s.new_payment AS payment_method),"
        " s.scenario_order, s.scenario FROM what_if w, scenario_list s"
    ),
    "compared": "SELECT customer_id, scenario_order, scenario, churn_probability AS risk FROM ("
    + _scored(_SERVE.replace("{source}", "varied"))
    + ")",
}


def _needs(sql: str) -> list[str]:
    """Named subqueries a statement uses, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"(?:FROM|JOIN|,)\s+\(?([a-z_]+)\b", text))
        for name in SUBQUERIES:
            if name in words and name not in order:
                visit(SUBQUERIES[name])
                order.append(name)

    visit(sql)
    return order


def complete(sql: str) -> str:
    heads = ", ".join(f"{n} AS ({SUBQUERIES[n]})" for n in _needs(sql))
    return f"WITH {heads} {sql}" if heads else sql


# --- one statement per query ------------------------------------------------------------------


def _bigints(names) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def _numbers(names) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


_RAW_LOWER = ", ".join(
    f"CAST({c} AS BIGINT) AS {c.lower()}" if c in ("SeniorCitizen", "tenure") else f"{c} AS {c.lower()}"
    for c in star.RAW
)
_RAW_KEPT = ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" if c in ("SeniorCitizen", "tenure") else c for c in star.RAW
)
_TOTAL_FIXED = (
    "COALESCE(TRY_CAST(TotalCharges AS DOUBLE), MonthlyCharges * tenure, 0)"
)
SUBQUERIES["online"] = (
    "SELECT customerID AS customer_id, gender, SeniorCitizen = 1 AS senior_citizen, Partner = 'Yes' AS partner,"
    " Dependents = 'Yes' AS dependents, tenure AS tenure_months, MonthlyCharges AS monthly_charges,"
    f" {_TOTAL_FIXED} AS total_charges, Contract AS contract_type, PaymentMethod AS payment_method,"
    " PaperlessBilling = 'Yes' AS paperless_billing, PhoneService = 'Yes' AS phone_service,"
    " MultipleLines = 'Yes' AS multiple_lines, InternetService AS internet_service,"
    " OnlineSecurity = 'Yes' AS online_security, OnlineBackup = 'Yes' AS online_backup,"
    " DeviceProtection = 'Yes' AS device_protection, TechSupport = 'Yes' AS tech_support,"
    " StreamingTV = 'Yes' AS streaming_tv, StreamingMovies = 'Yes' AS streaming_movies FROM raw"
)
SUBQUERIES["served_online"] = _SERVE.replace("{source}", "online")
SUBQUERIES["phi_online"] = SUBQUERIES["phi"].replace("FROM served", "FROM served_online")
SUBQUERIES["reasons_online"] = SUBQUERIES["reasons"].replace("FROM phi", "FROM phi_online")
_YES_NO_TABLE = ", ".join(
    f"CASE {c} WHEN 'Yes' THEN TRUE WHEN 'No' THEN FALSE END AS {c.lower()}"
    for c in ("Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn")
)
_CUSTOMER_COLUMNS = (
    "customerID AS customer_id, gender, SeniorCitizen = 1 AS senior_citizen, Partner = 'Yes' AS partner,"
    " Dependents = 'Yes' AS dependents, CAST(tenure AS BIGINT) AS tenure_months,"
    " MonthlyCharges AS monthly_charges,"
    f" CAST(CAST({_TOTAL_FIXED} AS DECIMAL(10,2)) AS DOUBLE) AS total_charges, Churn = 'Yes' AS churn"
)
_INGESTED_SERVICES = (
    "SELECT customerID AS customer_id, CAST(id AS BIGINT) AS service_type_id, TRUE AS is_subscribed FROM ("
    "SELECT customerID, 1 AS id FROM raw WHERE PhoneService = 'Yes'"
    " UNION ALL SELECT customerID, 2 FROM raw WHERE PhoneService = 'Yes' AND MultipleLines = 'Yes'"
    " UNION ALL SELECT customerID, CASE InternetService WHEN 'DSL' THEN 3 WHEN 'Fiber optic' THEN 4 ELSE 5 END FROM raw"
    + "".join(
        f" UNION ALL SELECT customerID, {i} FROM raw WHERE InternetService <> 'No' AND {c} = 'Yes'"
        for i, c in enumerate(
            ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"],
            start=6,
        )
    )
    + ") AS s"
)
_INGESTED_CONTRACTS = (
    "SELECT customerID AS customer_id, CAST(contract_type_id AS BIGINT) AS contract_type_id,"
    " PaymentMethod AS payment_method, PaperlessBilling = 'Yes' AS paperless_billing,"
    f" STRFTIME(DATE '{star.AS_OF}' - CAST(30 * tenure AS INT), '%Y-%m-%d') AS contract_start_date,"
    " CAST(NULL AS VARCHAR) AS contract_end_date FROM raw LEFT JOIN contract_types ON contract_name = Contract"
)
_VIEW_HEAD = (
    "customer_id, gender, senior_citizen, partner, dependents, CAST(tenure_months AS BIGINT) AS tenure_months,"
    " CAST(monthly_charges AS DOUBLE) AS monthly_charges, CAST(total_charges AS DOUBLE) AS total_charges, churn"
)
_BASE_OUT = (
    f"{_VIEW_HEAD}, contract_type, payment_method, paperless_billing, " + ", ".join(schema.SERVICE_FLAGS)
)
_FULL = (
    f"SELECT {_VIEW_HEAD}, contract_name AS contract_type, payment_method, paperless_billing,"
    " CAST(subscribed_rows AS BIGINT) AS total_services FROM counted"
)
_LISTED = f"SELECT {_VIEW_HEAD}, contract_name AS contract_type, payment_method FROM listed"
_AT_RISK = "NOT churn AND contract_type = 'Month-to-month' AND tenure_months <= 12"


def _ladder(rules: list[tuple[str | None, str]]) -> str:
    body = " ".join(f"WHEN {c} THEN '{v}'" if c else f"ELSE '{v}'" for c, v in rules)
    return f"CASE {body} END"


_TENURE_BUCKET = _ladder(
    [
        ("tenure_months BETWEEN 0 AND 6", "0-6 months"), ("tenure_months BETWEEN 7 AND 12", "7-12 months"),
        ("tenure_months BETWEEN 13 AND 24", "13-24 months"), ("tenure_months BETWEEN 25 AND 48", "25-48 months"),
        (None, "49+ months"),
    ]
)
_SEGMENT = _ladder(
    [
        ("contract_type_id = 1 AND tenure_months < 7 AND monthly_charges > 70", "Critical Risk"),
        ("contract_type_id = 1 AND tenure_months < 13", "High Risk"),
        ("contract_type_id = 1 OR tenure_months < 13", "Medium Risk"),
        (None, "Low Risk"),
    ]
)
_FAMILY = _ladder(
    [
        ("partner AND dependents", "Family (Partner + Dependents)"),
        ("partner", "With Partner Only"),
        ("dependents", "With Dependents Only"),
        (None, "Single"),
    ]
)
_BAND = _ladder(
    [
        ("monthly_charges < 30", "$0-30"), ("monthly_charges < 50", "$30-50"),
        ("monthly_charges < 70", "$50-70"), ("monthly_charges < 90", "$70-90"), (None, "$90+"),
    ]
)
_COHORT = _ladder(
    [
        ("tenure_months >= 60", "Early Adopters (5+ years)"), ("tenure_months >= 48", "Established (4-5 years)"),
        ("tenure_months >= 36", "Mature (3-4 years)"), ("tenure_months >= 24", "Growing (2-3 years)"),
        ("tenure_months >= 12", "Developing (1-2 years)"), (None, "New (< 1 year)"),
    ]
)
_RFM = _ladder(
    [
        ("r >= 4 AND f >= 4 AND m >= 4", "Champions"), ("r >= 4 AND f >= 3 AND m >= 3", "Loyal Customers"),
        ("r >= 3 AND m >= 4", "Big Spenders"), ("r <= 2 AND f <= 2", "At Risk"),
        ("r <= 2 AND m >= 3", "High Value At Risk"), (None, "Regular"),
    ]
)
_OFFER = _ladder(
    [
        ("contract_type_id = 1 AND tenure_months >= 12 AND monthly_charges >= 70", "Upgrade to Annual (High Value Loyal)"),
        ("contract_type_id = 1 AND tenure_months <= 6 AND monthly_charges >= 80", "Urgent: Offer Contract Incentive"),
        ("contract_type_id = 2 AND tenure_months >= 24", "Upgrade to 2-Year Contract"),
        ("contract_type_id = 1 AND payment_method = 'Electronic check'", "Convert Payment Method + Offer Contract"),
        (None, "No Action Needed"),
    ]
)
_CLV = (
    "SELECT customer_id, churn, total_charges + CASE WHEN churn THEN 0 ELSE 12 * monthly_charges END AS clv FROM contracted"
)
_CLV_RANKED = (
    f"SELECT *, NTILE(4) OVER (ORDER BY clv DESC NULLS FIRST, customer_id) AS quartile,"
    f" RANK() OVER (ORDER BY clv DESC NULLS FIRST) AS place FROM ({_CLV})"
)
_RFM_TILES = (
    "SELECT *, NTILE(5) OVER (ORDER BY tenure_months, customer_id) AS r,"
    " NTILE(5) OVER (ORDER BY subscribed_rows, customer_id) AS f,"
    " NTILE(5) OVER (ORDER BY monthly_charges, customer_id) AS m FROM counted"
)
_BANDED = (
    f"SELECT {_BAND} AS charge_band, MIN(monthly_charges) AS low, {N} AS customers, {CHURNED} AS churned,"
    " SUM(monthly_charges) AS revenue FROM customers GROUP BY 1"
)
_BUNDLES = (
    "SELECT c.customer_id, c.churn, STRING_AGG(DISTINCT t.service_name, ' + ' ORDER BY t.service_name) AS service_bundle"
    " FROM customers c LEFT JOIN (SELECT * FROM customer_services WHERE is_subscribed) s USING (customer_id)"
    " LEFT JOIN service_types t USING (service_type_id) GROUP BY 1, 2"
)


def _kpi_rows() -> str:
    def text(value: str, kind: str = "BIGINT") -> str:
        return f"CAST(CAST({value} AS {kind}) AS VARCHAR)"

    def total(condition: str) -> str:
        return f"(SELECT COALESCE(SUM(monthly_charges), 0) FROM customers WHERE {condition})"

    money = "DECIMAL(18,2)"
    exposed = "FROM contracted WHERE NOT churn AND contract_type_id = 1 AND tenure_months <= 12 AND monthly_charges >= 70"
    rows = {
        "Total Customers": text("(SELECT COUNT(*) FROM customers)"),
        "Active Customers": text("(SELECT COUNT(*) FROM customers WHERE NOT churn)"),
        "Churned Customers": text("(SELECT COUNT(*) FROM customers WHERE churn)"),
        "Churn Rate (%)": text(f"(SELECT {RATE} FROM customers)", money),
        "Monthly Recurring Revenue ($)": text(total("NOT churn"), money),
        "Lost Monthly Revenue ($)": text(total("churn"), money),
        "Lifetime Revenue ($)": text("(SELECT SUM(total_charges) FROM customers)", money),
        "Avg Customer Tenure (months)": text(f"(SELECT {_avg_int('tenure_months')} FROM customers)", "DECIMAL(18,1)"),
        "Month-to-Month Customers": text("(SELECT COUNT(*) FROM contracted WHERE contract_type_id = 1)"),
        "Month-to-Month Churn Rate (%)": text(f"(SELECT {RATE} FROM contracted WHERE contract_type_id = 1)", money),
        "High-Value At-Risk Customers": text(f"(SELECT COUNT(*) {exposed})"),
        "High-Value At-Risk Revenue ($)": text(f"(SELECT SUM(monthly_charges) {exposed})", money),
    }
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value" for m, v in rows.items())


_ADOPTION = (
    "SELECT t.service_name, COUNT(DISTINCT c.customer_id) FILTER (WHERE s.is_subscribed) AS w,"
    " COUNT(DISTINCT c.customer_id) FILTER (WHERE s.is_subscribed AND c.churn) AS cw,"
    " COUNT(DISTINCT c.customer_id) FILTER (WHERE s.is_subscribed IS NOT TRUE) AS o,"
    " COUNT(DISTINCT c.customer_id) FILTER (WHERE s.is_subscribed IS NOT TRUE AND c.churn) AS co"
    " FROM customers c CROSS JOIN service_types t LEFT JOIN customer_services s"
    " ON s.customer_id = c.customer_id AND s.service_type_id = t.service_type_id GROUP BY 1"
)

_RULES = {
    ("customers", "gender_domain"): "SELECT COUNT(*) FROM customers WHERE gender NOT IN ('Male', 'Female')",
    ("customers", "tenure_not_negative"): "SELECT COUNT(*) FROM customers WHERE tenure_months < 0",
    ("customers", "tenure_at_most_72"): "SELECT COUNT(*) FROM customers WHERE tenure_months > 72",
    ("customers", "monthly_not_negative"): "SELECT COUNT(*) FROM customers WHERE monthly_charges < 0",
    ("customers", "total_not_negative"): "SELECT COUNT(*) FROM customers WHERE total_charges < 0",
    ("customer_contracts", "contract_type_given"): "SELECT COUNT(*) FROM customer_contracts WHERE contract_type_id IS NULL",
    ("customer_contracts", "payment_given"): "SELECT COUNT(*) FROM customer_contracts WHERE payment_method IS NULL",
    ("customers", "unique_customer_id"): "SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM customers",
    ("customer_contracts", "unique_customer_id"): "SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM customer_contracts",
    ("customer_services", "unique_customer_id_service_type_id"): (
        "SELECT COUNT(*) - COUNT(DISTINCT (customer_id, service_type_id)) FROM customer_services"
    ),
    ("customer_contracts", "known_customer_id"): (
        "SELECT COUNT(*) FROM customer_contracts WHERE customer_id NOT IN (SELECT customer_id FROM customers)"
    ),
    ("customer_contracts", "known_contract_type_id"): (
        "SELECT COUNT(*) FROM customer_contracts WHERE contract_type_id NOT IN (SELECT contract_type_id FROM contract_types)"
    ),
    ("customer_services", "known_customer_id"): (
        "SELECT COUNT(*) FROM customer_services WHERE customer_id NOT IN (SELECT customer_id FROM customers)"
    ),
    ("customer_services", "known_service_type_id"): (
        "SELECT COUNT(*) FROM customer_services WHERE service_type_id NOT IN (SELECT service_type_id FROM service_types)"
    ),
    ("predictions", "known_customer_id"): (
        "SELECT COUNT(*) FROM scored WHERE customer_id NOT IN (SELECT customer_id FROM customers)"
    ),
    ("predictions", "probability_0_to_1"): "SELECT COUNT(*) FROM scored WHERE probability NOT BETWEEN 0 AND 1",
    ("predictions", "risk_level_domain"): "SELECT 0 FROM (SELECT COUNT(*) FROM scored)",
}

_STORED_LEVEL = "CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END"
_STORED = "SELECT *, CAST(probability AS DECIMAL(5,4)) AS p FROM scored"


def _readable(names: dict[str, str]) -> str:
    title = (
        "LIST_AGGREGATE(LIST_TRANSFORM(STRING_SPLIT(feature, '_'),"
        " lambda w: UPPER(w[1]) || LOWER(w[2:])), 'string_agg', ' ')"
    )
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE feature {cases} ELSE {title} END"


_DIRECTION = "CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END"


def _texts(names: dict[str, str]) -> str:
    return f"{_readable(names)} || ' ' || {_DIRECTION} || ' churn risk'"


_INT_FEATURES = [
    f
    for f in schema.FEATURES
    if f not in (
        "tenure_years", "monthly_charges", "total_charges", "avg_monthly_spend", "charge_per_service",
        "estimated_clv", "service_diversity",
    )
]


def _typed(names) -> str:
    return ", ".join(
        f"CAST({n} AS {'BIGINT' if n in _INT_FEATURES or n in ('churn', 'family_size_proxy') else 'DOUBLE'}) AS {n}"
        for n in names
    )


GROUPS = {
    "f01_demographics": [
        "gender_male", "is_senior", "has_partner", "has_dependents", "has_family", "family_size_proxy", "senior_alone",
    ],
    "f02_services": [
        *[f"{s}_flag" for s in _SERVICE_INPUTS], "has_internet", "internet_fiber", "internet_dsl", "total_services",
        "has_security_bundle", "has_support_bundle", "has_streaming_bundle", "service_diversity",
        "premium_service_count",
    ],
    "f03_contract": [
        "contract_length", "is_month_to_month", "has_long_contract", *feat.PAYMENT_FLAGS, "has_auto_payment",
        "paperless_billing_flag",
    ],
    "f04_financial": [
        "avg_monthly_spend", "charge_per_service", "is_high_value", "monthly_charge_quartile", "estimated_clv",
        "spending_trend",
    ],
    "f05_tenure": [
        "tenure_years", "is_new_customer", "is_established", "is_loyal", "tenure_bucket", "tenure_quartile",
    ],
    "f06_risk": [*feat.RISK_WEIGHTS, "risk_factors_count", "risk_score", "high_risk_flag"],
    "f07_interactions": [
        "tenure_contract_interaction", "new_high_value", "mtm_high_value", "senior_mtm", "fiber_no_support",
    ],
}

_ADVICE = reports.RETENTION_ADVICE
_SUGGEST = reports.WHAT_IF_ADVICE


def _advice_rows(rules: list[tuple[str, str]], otherwise: str, source: str) -> str:
    hits = " UNION ALL ".join(
        f"SELECT customer_id, '{text}' AS advice FROM {source} WHERE {condition}" for condition, text in rules
    )
    none = " AND ".join(f"({condition}) IS NOT TRUE" for condition, _ in rules)
    return f"{hits} UNION ALL SELECT customer_id, '{otherwise}' FROM {source} WHERE {none}"


def _fixed_metrics() -> str:
    """The six metrics for three scorers, one row per model."""
    scorers = [
        (1, "RiskScore", "CAST(risk_score AS DOUBLE)", "high_risk_flag"),
        (2, "RiskFactors", "CAST(risk_factors_count AS DOUBLE)", "CASE WHEN risk_factors_count >= 3 THEN 1 ELSE 0 END"),
        (3, "MonthlyCharges", "monthly_charges", "is_high_value"),
    ]
    rows = []
    for order, name, score, prediction in scorers:
        judged = f"SELECT churn, {score} AS score, {prediction} AS prediction FROM features"
        counts = (
            "SELECT score, COUNT(*) FILTER (WHERE churn = 1) AS pos, COUNT(*) FILTER (WHERE churn = 0) AS neg"
            f" FROM ({judged}) GROUP BY 1"
        )
        run = (
            "SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS pt, SUM(neg) OVER (ORDER BY score DESC) AS nt"
            f" FROM ({counts})"
        )
        cells = (
            "SELECT COUNT(*) FILTER (WHERE churn = 1 AND prediction = 1) AS tp,"
            " COUNT(*) FILTER (WHERE churn = 0 AND prediction = 1) AS fp,"
            " COUNT(*) FILTER (WHERE churn = 1 AND prediction = 0) AS fn,"
            f" COUNT(*) FILTER (WHERE churn = 0 AND prediction = 0) AS tn FROM ({judged})"
        )
        rows.append(
            f"SELECT {order} AS model_order, '{name}' AS model, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,"
            " CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall,"
            " CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1,"
            f" (SELECT SUM(neg * (pt - pos / 2.0)) / (SUM(pos) * SUM(neg)) FROM ({run})) AS roc_auc,"
            f" (SELECT SUM(pos * CAST(pt AS DOUBLE) / (pt + nt)) / SUM(pos) FROM ({run})) AS avg_precision"
            f" FROM ({cells})"
        )
    return " UNION ALL ".join(rows)


def statements() -> dict[str, str]:
    metric_names = ["accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision"]
    sql: dict[str, str] = {}

    # sources and cleaning
    sql["s01_read_raw"] = f"SELECT {_RAW_KEPT} FROM raw"
    kept = "reason, COUNT(*) AS n, MIN(customerID) AS first_id"
    sql["s01b_rejected_lines"] = (
        f"SELECT {kept} FROM (SELECT customerID, CASE RIGHT(customerID, 1) WHEN '0' THEN 'too few fields' WHEN '1' THEN"
        " 'too many fields' WHEN '2' THEN 'not of its type' ELSE 'accepted' END AS reason FROM raw) GROUP BY 1"
    )
    sql["s02_normalise_columns"] = f"SELECT {_RAW_LOWER} FROM raw"
    sql["s03_coerce_charges"] = (
        f"SELECT customerID AS customerid, MonthlyCharges AS monthlycharges, {_TOTAL_FIXED} AS totalcharges FROM raw"
    )
    sql["s04_yes_no_to_bool"] = f"SELECT customerID AS customerid, {_YES_NO_TABLE} FROM raw"
    sql["s05_int_to_bool"] = "SELECT customerID AS customerid, SeniorCitizen <> 0 AS seniorcitizen FROM raw"
    sql["s06_to_customers"] = f"SELECT {_CUSTOMER_COLUMNS} FROM raw"
    sql["s07_assign_churn_date"] = (
        f"SELECT customerID AS customer_id, Churn = 'Yes' AS churn, CASE WHEN Churn = 'Yes' THEN"
        f" STRFTIME(DATE '{star.AS_OF}' - CAST({_hash('customerID')} % 90 + 1 AS INT), '%Y-%m-%d') END AS churn_date FROM raw"
    )
    sql["s08_to_contracts"] = _INGESTED_CONTRACTS
    sql["s09_to_services"] = _INGESTED_SERVICES
    sql["s10_lookup_use"] = (
        "SELECT 'contract' AS lookup, CAST(t.contract_type_id AS BIGINT) AS id, t.contract_name AS name,"
        " CAST(NULL AS VARCHAR) AS category, t.description, COUNT(k.customer_id) AS used"
        " FROM contract_types t LEFT JOIN customer_contracts k USING (contract_type_id) GROUP BY ALL"
        " UNION ALL SELECT 'service', CAST(t.service_type_id AS BIGINT), t.service_name, t.service_category, t.description,"
        " COUNT(s.customer_id) FROM service_types t LEFT JOIN customer_services s USING (service_type_id) GROUP BY ALL"
    )
    counts = (
        f"SELECT 'customers' AS table_name, {N} AS row_count, {CHURNED} AS churned, {RATE} AS churn_rate_pct FROM customers"
        " UNION ALL SELECT 'customer_contracts', COUNT(*), NULL, NULL FROM customer_contracts"
        " UNION ALL SELECT 'customer_services', COUNT(*), NULL, NULL FROM customer_services"
    )
    sql["s11_load_tables"] = counts
    sql["s11b_load_as_one"] = counts
    sql["s12_table_counts"] = counts
    sql["s13_check_rules"] = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{r}' AS rule, CAST(({q}) AS BIGINT) AS violations" for (t, r), q in _RULES.items()
    )
    sql["s14_write_features"] = f"SELECT customer_id, {_typed([*schema.FEATURES, 'churn'])} FROM features"
    sql["s15_write_predictions"] = (
        f"SELECT customer_id, CAST(p AS DOUBLE) AS churn_probability, churn_prediction = 1 AS churn_prediction,"
        f" {_STORED_LEVEL} AS risk_level, 'fixed-1' AS model_version, '{star.AS_OF}' AS prediction_day,"
        f" CAST(3 AS BIGINT) AS factors, r.feature AS first_factor FROM ({_STORED}) JOIN"
        " (SELECT customer_id, feature FROM reasons WHERE reason_rank = 1) r USING (customer_id)"
    )
    importance = "SELECT feature, ROUND(AVG(ABS(phi)), 6) AS importance FROM phi GROUP BY 1"
    sql["s16_artifacts"] = importance
    risk_list = (
        "SELECT customer_id, churn_probability, risk_level, contract_type, CAST(tenure_months AS BIGINT) AS tenure_months,"
        " monthly_charges, payment_method FROM scored"
    )
    sql["s17_export_risk_list"] = (
        f"{risk_list} WHERE churn_probability >= 0.5 ORDER BY churn_probability DESC, customer_id"
    )
    rules = {
        "tenure_0_to_72": "tenure_months BETWEEN 0 AND 72", "monthly_not_negative": "monthly_charges >= 0",
        "total_not_negative": "total_charges >= 0", "contract_given": "contract_type IS NOT NULL",
        "payment_given": "payment_method IS NOT NULL",
    }
    sql["s13b_rejected_requests"] = " UNION ALL ".join(
        f"SELECT customer_id, '{rule}' AS rule FROM requests WHERE ({text}) IS NOT TRUE" for rule, text in rules.items()
    )
    sql["s13c_batch_size"] = "SELECT COUNT(*) AS records, NOT COUNT(*) BETWEEN 1 AND 100 AS violated FROM requests"
    sql["s18_query_table"] = (
        f"SELECT customer_id, CAST(tenure_months AS BIGINT) AS tenure_months,"
        " CAST(monthly_charges AS DOUBLE) AS monthly_charges FROM customers"
        " WHERE tenure_months <= 12 AND monthly_charges >= 70 AND gender = 'Female'"
    )

    # views and lookups
    sql["v1_customer_full"] = _FULL
    sql["v2_services_summary"] = "SELECT * FROM service_flags"
    sql["v3_churn_summary"] = (
        f"SELECT {N} AS total_customers, {CHURNED} AS churned_customers, {RATE} AS churn_rate_pct,"
        f" {_avg_money('monthly_charges')} AS avg_monthly_charges, {_avg_int('tenure_months')} AS avg_tenure_months,"
        f" {_sum_if('churn', 'monthly_charges')} AS monthly_revenue_at_risk FROM customers"
    )
    sql["v4_feature_base"] = f"SELECT {_BASE_OUT} FROM base"
    sql["v5_get_customers"] = f"SELECT * FROM ({_FULL}) WHERE churn ORDER BY customer_id LIMIT 100"
    sql["l1_customer_by_id"] = f"SELECT {_BASE_OUT} FROM base WHERE customer_id = 'Customer#000000042'"
    sql["l2_list_customers"] = f"{_LISTED} ORDER BY customer_id LIMIT 20 OFFSET 40"
    sql["l3_at_risk_profile"] = (
        f"SELECT {_BASE_OUT} FROM base WHERE {_AT_RISK} ORDER BY base.monthly_charges DESC, customer_id LIMIT 50"
    )
    sql["l4_search_customers"] = (
        "SELECT customer_id, gender, senior_citizen, CAST(tenure_months AS BIGINT) AS tenure_months,"
        " CAST(monthly_charges AS DOUBLE) AS monthly_charges, churn, contract_name AS contract_type FROM listed"
        " WHERE customer_id ILIKE '%R#00000_1%' ORDER BY customer_id LIMIT 20"
    )
    top = f"SELECT customer_id FROM base WHERE {_AT_RISK} ORDER BY monthly_charges DESC, customer_id LIMIT 50"
    sql["l5_at_risk_scored"] = (
        "SELECT customer_id, gender, senior_citizen, partner, dependents, CAST(tenure_months AS BIGINT) AS tenure_months,"
        " monthly_charges, total_charges, FALSE AS churn, contract_type, payment_method, churn_probability, risk_level,"
        f" CAST(reason_rank AS BIGINT) AS reason_rank, feature, {_DIRECTION} AS direction"
        f" FROM scored JOIN reasons USING (customer_id) WHERE probability >= 0.8 AND customer_id IN ({top})"
    )

    sql["l2b_page_by_index"] = sql["l2_list_customers"]
    sql["l4b_search_by_index"] = sql["l4_search_customers"]
    sql["s15b_latest_predictions"] = (
        f"SELECT customer_id, CASE WHEN p > 0.5 THEN CAST(p AS DOUBLE) / 2 ELSE CAST(p AS DOUBLE) END AS churn_probability,"
        f" {_STORED_LEVEL} AS risk_level, CASE WHEN p > 0.5 THEN 'fixed-2' ELSE 'fixed-1' END AS model_version,"
        " CASE WHEN p > 0.5 THEN '2024-01-02' ELSE '2024-01-01' END AS scored_at,"
        f" CAST(CASE WHEN p > 0.5 THEN 2 ELSE 1 END AS BIGINT) AS predictions FROM ({_STORED})"
    )

    # analytic queries
    sql["q01_overall_summary"] = (
        f"SELECT {N} AS total_customers, {CHURNED} AS churned_customers,"
        f" COUNT(*) FILTER (WHERE NOT churn) AS retained_customers, {RATE} AS churn_rate_pct,"
        f" {_avg_money('monthly_charges')} AS avg_monthly_charges, {_avg_money('total_charges')} AS avg_total_charges"
        " FROM customers"
    )
    sql["q02_churn_by_contract"] = (
        f"SELECT contract_name, {N} AS total_customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct"
        " FROM contracted GROUP BY 1"
    )
    sql["q03_churn_by_tenure"] = (
        f"SELECT {_TENURE_BUCKET} AS tenure_bucket, {N} AS total_customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,"
        f" {_avg_money('monthly_charges')} AS avg_monthly_charges FROM customers GROUP BY 1"
    )
    sql["q04_churn_by_payment"] = (
        f"SELECT payment_method, {N} AS total_customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,"
        f" {_avg_money('monthly_charges')} AS avg_monthly_charges, CAST(SUM(total_charges) AS DOUBLE) AS total_revenue"
        " FROM contracted GROUP BY 1"
    )
    lost = "COALESCE(SUM(monthly_charges) FILTER (WHERE churn), 0)"
    sql["q05_revenue_impact"] = (
        f"SELECT 'Current Monthly Revenue' AS metric, {_sum_if('NOT churn', 'monthly_charges')} AS value FROM customers"
        f" UNION ALL SELECT 'Lost Monthly Revenue (Churned)', {_sum_if('churn', 'monthly_charges')} FROM customers"
        " UNION ALL SELECT 'Potential Monthly Revenue (If No Churn)', CAST(SUM(monthly_charges) AS DOUBLE) FROM customers"
        f" UNION ALL SELECT 'Revenue Loss Percentage', {_pct(_cents(lost), _cents('SUM(monthly_charges)'))} FROM customers"
    )
    sql["q06_service_adoption"] = (
        f"SELECT service_name, w AS customers_with_service, cw AS churned_with_service,"
        f" {_pct('cw', 'w')} AS churn_rate_with_service, o AS customers_without_service, co AS churned_without_service,"
        f" {_pct('co', 'o')} AS churn_rate_without_service FROM ({_ADOPTION})"
    )
    sql["q07_risk_segments"] = (
        f"SELECT {_SEGMENT} AS risk_segment, {N} AS customer_count, {CHURNED} AS actually_churned,"
        f" {RATE} AS actual_churn_rate, {_avg_money('monthly_charges')} AS avg_monthly_charges,"
        " CAST(SUM(monthly_charges) AS DOUBLE) AS total_monthly_revenue FROM contracted GROUP BY 1"
    )
    sql["q08_demographics"] = (
        f"SELECT gender, senior_citizen, {_FAMILY} AS family_status, {N} AS total_customers, {CHURNED} AS churned,"
        f" {RATE} AS churn_rate_pct FROM customers GROUP BY 1, 2, 3"
    )
    sql["q09_clv_quartiles"] = (
        "SELECT CAST(quartile AS BIGINT) AS clv_quartile, CASE quartile WHEN 1 THEN 'Top 25% (Premium)'"
        " WHEN 2 THEN '25-50% (High Value)' WHEN 3 THEN '50-75% (Medium Value)' ELSE 'Bottom 25% (Low Value)' END"
        f" AS value_segment, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,"
        f" {_avg_money('clv')} AS avg_clv, CAST(SUM(clv) AS DOUBLE) AS total_clv_at_risk FROM ({_CLV_RANKED}) GROUP BY 1, 2"
    )
    sql["q09b_clv_ranks"] = (
        "SELECT customer_id, CAST(clv AS DOUBLE) AS estimated_clv, CAST(quartile AS BIGINT) AS clv_quartile,"
        f" CAST(place AS BIGINT) AS clv_rank FROM ({_CLV_RANKED})"
    )
    sql["q10_rfm_segments"] = (
        f"SELECT {_RFM} AS rfm_segment, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct,"
        f" {_avg_money('monthly_charges')} AS avg_monthly_charges, {_avg_int('subscribed_rows')} AS avg_services,"
        f" {_avg_int('tenure_months')} AS avg_tenure FROM ({_RFM_TILES}) GROUP BY 1"
    )
    so_far = "OVER (ORDER BY low ROWS UNBOUNDED PRECEDING)"
    change = "10000 * (churned * prev_n - prev_c * customers)"
    sql["q11_charge_bands"] = (
        f"SELECT charge_band, customers, churned, {_pct('churned', 'customers')} AS churn_rate_pct,"
        " CAST(revenue AS DOUBLE) AS monthly_revenue, CAST(all_n AS BIGINT) AS cumulative_customers,"
        f" CAST(all_c AS BIGINT) AS cumulative_churned, {_pct('all_c', 'all_n')} AS cumulative_churn_rate,"
        f" CAST(SIGN({change}) * ((2 * ABS({change}) + customers * prev_n) // (2 * customers * prev_n)) AS DOUBLE) / 100.0"
        " AS churn_rate_change FROM (SELECT *, "
        f"SUM(customers) {so_far} AS all_n, SUM(churned) {so_far} AS all_c,"
        " LAG(customers) OVER (ORDER BY low) AS prev_n, LAG(churned) OVER (ORDER BY low) AS prev_c"
        f" FROM ({_BANDED}))"
    )
    sql["q12_bundle_sizes"] = (
        f"SELECT CAST(subscribed_rows AS BIGINT) AS service_count, {N} AS customers, {CHURNED} AS churned,"
        f" {RATE} AS churn_rate_pct, {_avg_money('monthly_charges')} AS avg_monthly_charges FROM counted GROUP BY 1"
    )
    sql["q12b_service_bundles"] = (
        f"SELECT service_bundle, {N} AS customers, {CHURNED} AS churned, {RATE} AS churn_rate_pct FROM ({_BUNDLES}) GROUP BY 1"
    )
    stay = "COUNT(*) FILTER (WHERE NOT churn)"
    sql["q13_tenure_cohorts"] = (
        f"SELECT {_COHORT} AS cohort, {N} AS total_customers, {stay} AS retained, {CHURNED} AS churned,"
        f" {_pct(stay, N)} AS retention_rate_pct, {_sum_if('NOT churn', 'monthly_charges')} AS active_revenue,"
        f" {_sum_if('churn', 'monthly_charges')} AS lost_revenue FROM customers GROUP BY 1"
    )
    sql["q14_contract_opportunities"] = (
        f"SELECT {_OFFER} AS recommendation, {N} AS customer_count, {_avg_money('monthly_charges')} AS avg_monthly_charges,"
        f" CAST(SUM(monthly_charges) AS DOUBLE) AS total_monthly_value, {_avg_int('tenure_months')} AS avg_tenure,"
        f" {_avg_int('subscribed_rows')} AS avg_services FROM (SELECT c.*, COALESCE(subscribed_rows, 0) AS subscribed_rows"
        " FROM contracted c LEFT JOIN held USING (customer_id)) WHERE NOT churn GROUP BY 1"
    )
    sql["q15_executive_kpis"] = _kpi_rows()
    sql["q16_loyal_low_spenders"] = (
        "SELECT * FROM (SELECT customer_id,"
        " NTILE(4) OVER (ORDER BY tenure_months DESC NULLS FIRST, customer_id) AS recency_score,"
        " NTILE(4) OVER (ORDER BY total_charges DESC NULLS FIRST, customer_id) AS monetary_score FROM customers)"
        " WHERE monetary_score = 4 AND recency_score <= 2"
    )

    # ranking
    sql["w1_global_ntile"] = (
        "SELECT customer_id, NTILE(4) OVER (ORDER BY monthly_charges, customer_id) AS charge_quarter,"
        " NTILE(5) OVER (ORDER BY tenure_months, customer_id) AS tenure_fifth FROM customers"
    )
    sql["w2_global_rank"] = (
        "SELECT customer_id, RANK() OVER (ORDER BY monthly_charges DESC) AS charge_rank FROM customers"
    )
    sql["w3_first_rank_quartile"] = (
        "SELECT customer_id, CAST(1 + (4 * (place - 1) > n - 1)::INT + (4 * (place - 1) > 2 * (n - 1))::INT"
        " + (4 * (place - 1) > 3 * (n - 1))::INT AS BIGINT) AS tenure_quartile FROM (SELECT customer_id,"
        " ROW_NUMBER() OVER (ORDER BY tenure_months, customer_id) AS place, COUNT(*) OVER () AS n FROM customers)"
    )
    sql["w4_value_quartile"] = (
        f"SELECT customer_id, CAST({_FIT_REFERENCE['monthly_charge_quartile']} AS BIGINT) AS charge_quartile"
        " FROM (SELECT customer_id, CAST(monthly_charges AS DOUBLE) AS monthly_charges FROM customers)"
    )
    sql["w5_median"] = (
        "SELECT MEDIAN(CAST(monthly_charges AS DOUBLE)) AS median_monthly,"
        " MEDIAN(CAST(total_charges AS DOUBLE)) AS median_total FROM customers"
    )
    per_tenure = f"SELECT tenure_months, {N} AS customers, {CHURNED} AS churned FROM customers GROUP BY 1"
    sql["w6_running_sum"] = (
        "SELECT CAST(tenure_months AS BIGINT) AS tenure_months, customers,"
        " CAST(SUM(customers) OVER (ORDER BY tenure_months) AS BIGINT) AS customers_so_far,"
        f" CAST(SUM(churned) OVER (ORDER BY tenure_months) AS BIGINT) AS churned_so_far FROM ({per_tenure})"
    )
    sql["w7_lag"] = (
        "SELECT CAST(tenure_months AS BIGINT) AS tenure_months, customers,"
        f" LAG(customers) OVER (ORDER BY tenure_months) AS previous_customers FROM ({per_tenure})"
    )
    sql["w8_fixed_bins"] = (
        "SELECT customer_id, CAST(CASE WHEN tenure_months <= 6 THEN 1 WHEN tenure_months <= 12 THEN 2"
        " WHEN tenure_months <= 24 THEN 3 WHEN tenure_months <= 48 THEN 4 ELSE 5 END AS BIGINT) AS tenure_bucket FROM customers"
    )
    sql["w9_histogram"] = (
        "SELECT CASE WHEN monthly_charges < 25 THEN -1 WHEN monthly_charges > 100 THEN 20 ELSE"
        " CAST(LEAST(FLOOR((CAST(monthly_charges AS DOUBLE) - 25) / 3.75), 19) AS BIGINT) END AS bin, COUNT(*) AS n"
        " FROM customers GROUP BY 1"
    )

    # features
    for key, names in GROUPS.items():
        sql[key] = f"SELECT customer_id, {_typed(names)} FROM fitted"
    sql["f08_select_features"] = f"SELECT customer_id, {_typed([*schema.FEATURES, 'churn'])} FROM features"
    sql["f09_serve_features"] = f"SELECT customer_id, {_typed(schema.FEATURES)} FROM served"
    sql["f10_profile_to_request"] = (
        "SELECT * REPLACE (CAST(tenure_months AS BIGINT) AS tenure_months) FROM requests"
    )
    sql["f11_class_balance"] = (
        "SELECT CAST(churn AS BIGINT) AS churn, COUNT(*) AS n, CAST((2000 * COUNT(*) + total) // (2 * total) AS DOUBLE) / 10.0"
        " AS share_pct FROM features, (SELECT COUNT(*) AS total FROM customers) t GROUP BY churn, total"
    )

    # training and evaluation
    sql["m01_split"] = "SELECT customer_id, CAST(label AS BIGINT) AS churn, part FROM parts"
    scaled = ", ".join(
        f"ROUND((f.{c} - s.{c}_m) / CASE WHEN s.{c}_s = 0 THEN 1 ELSE s.{c}_s END, 6) AS {c}" for c in schema.FEATURES
    )
    moments = ", ".join(f"AVG({c}) AS {c}_m, STDDEV_POP({c}) AS {c}_s" for c in schema.FEATURES)
    sql["m02_standardise"] = (
        f"SELECT f.customer_id, {scaled} FROM features f, (SELECT {moments} FROM features"
        " JOIN parts USING (customer_id) WHERE part = 'train') s"
    )
    sql["m03_smote"] = (
        "SELECT CAST(label AS BIGINT) AS churn, FALSE AS synthetic, COUNT(*) AS n FROM parts WHERE part = 'train' GROUP BY 1"
        " UNION ALL SELECT 1, TRUE, COUNT(*) FILTER (WHERE label = 0) - COUNT(*) FILTER (WHERE label = 1)"
        " FROM parts WHERE part = 'train'"
    )
    sql["m04_class_weights"] = (
        "SELECT CAST(label AS BIGINT) AS churn, n, total / (2.0 * n) AS weight, neg / CAST(pos AS DOUBLE) AS scale_pos_weight"
        " FROM (SELECT label, COUNT(*) AS n FROM parts WHERE part = 'train' GROUP BY 1), (SELECT CAST(COUNT(*) AS DOUBLE) AS total,"
        " COUNT(*) FILTER (WHERE label = 0) AS neg, COUNT(*) FILTER (WHERE label = 1) AS pos FROM parts WHERE part = 'train') t"
    )
    sql["m09_metrics"] = "SELECT metric, ROUND(value, 8) AS value FROM measured"
    sql["m10_roc_points"] = (
        "SELECT score AS threshold, CAST(neg_through AS DOUBLE) / SUM(neg) OVER () AS fpr,"
        " CAST(pos_through AS DOUBLE) / SUM(pos) OVER () AS tpr FROM cumulated UNION ALL SELECT NULL, 0.0, 0.0"
    )
    sql["m11_confusion_matrix"] = (
        "SELECT CAST(a AS BIGINT) AS actual, CAST(p AS BIGINT) AS predicted, COUNT(j.churn) AS n"
        " FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p)"
        " LEFT JOIN judged j ON j.churn = a AND j.prediction = p GROUP BY 1, 2"
    )
    rounded = ", ".join(f"ROUND({m}, 8) AS {m}" for m in metric_names)
    sql["m12_compare_models"] = (
        f"SELECT model, {rounded}, ROW_NUMBER() OVER (ORDER BY roc_auc DESC, model_order) = 1 AS is_best"
        f" FROM ({_fixed_metrics()})"
    )
    targets = _values(list(schema.METRIC_TARGETS.items()), "metric, target")
    checked = (
        "SELECT t.metric, ROUND(m.value, 8) AS actual, CAST(t.target AS DOUBLE) AS target,"
        f" m.value >= t.target AS met FROM ({targets}) t LEFT JOIN measured m USING (metric)"
    )
    sql["m13_check_targets"] = checked

    # scoring and attribution
    sql["p01_score"] = (
        "SELECT customer_id, churn_probability, CAST(churn_prediction AS BIGINT) AS churn_prediction FROM scored"
    )
    sql["p02_risk_levels"] = (
        f"SELECT customer_id, risk_level, {_STORED_LEVEL} AS stored_risk_level FROM ({_STORED})"
    )
    phi_out = "customer_id, CAST(position AS BIGINT) AS position, feature, value, ROUND(phi, 4) AS phi"
    sql["p03_linear_attribution"] = f"SELECT {phi_out} FROM phi"
    sql["p03b_centred_attribution"] = (
        "SELECT customer_id, CAST(position AS BIGINT) AS position, feature,"
        " ROUND(phi - AVG(phi) OVER (PARTITION BY feature), 8) AS phi FROM phi"
    )
    reason = (
        "SELECT customer_id, CAST(reason_rank AS BIGINT) AS reason_rank, feature, value, ROUND(ABS(phi), 4) AS impact,"
        f" {_DIRECTION} AS direction, ROUND(phi, 4) AS shap_value, {{text}} AS description FROM reasons"
    )
    held = _values(
        [(c,) for c in (
            "three_models_logged", "metrics_in_range", "best_has_largest_auc", "reloaded_scores_all_test_rows",
            "reloaded_equals_model", "parts_add_up",
        )], '"check"',
    )
    sql["m15_training_job"] = f"SELECT *, 1::BIGINT AS holds FROM ({held})"
    sql["p05_top_reasons"] = reason.replace("{text}", _texts(ONLINE_NAMES))
    sql["p06_reason_text"] = (
        f"SELECT feature, direction, {_readable(ONLINE_NAMES)} || ' ' || direction || ' churn risk' AS online_text,"
        f" {_readable(BATCH_NAMES)} || ' ' || direction || ' churn risk' AS batch_text, n FROM"
        f" (SELECT feature, {_DIRECTION} AS direction, COUNT(*) AS n FROM phi GROUP BY 1, 2)"
    )
    sql["p07_top_reason"] = (
        "SELECT customer_id, feature AS top_reason FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id"
        " ORDER BY ABS(phi) DESC, position) AS place FROM phi) WHERE place = 1"
    )
    levels = _values([(r,) for r in schema.RISK_LEVELS], "risk_level")
    summary = (
        f"SELECT l.risk_level, COUNT(s.customer_id) AS n FROM ({levels}) l LEFT JOIN scored s USING (risk_level) GROUP BY 1"
    )
    sql["p08_batch_summary"] = summary
    sql["p09_importance"] = f"{importance} ORDER BY importance DESC, feature LIMIT 20"
    sql["p10_score_customer"] = (
        "SELECT s.customer_id, s.churn_probability, s.risk_level, CAST(r.reason_rank AS BIGINT) AS reason_rank,"
        " r.feature, ROUND(ABS(r.phi), 4) AS impact FROM scored s JOIN reasons r USING (customer_id)"
        " WHERE s.customer_id = 'Customer#000000042'"
    )
    sql["p11_model_info"] = (
        "SELECT 'FixedLinear' AS model_name, CAST(61 AS BIGINT) AS n_features,"
        " (SELECT COUNT(*) FROM parts WHERE part = 'train') AS n_training_samples,"
        " (SELECT COUNT(*) FROM parts WHERE part = 'test') AS n_test_samples, metric, ROUND(value, 8) AS value FROM measured"
    )

    # report tables
    sql["d01_risk_kpis"] = (
        "SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE churn_probability >= 0.5) AS high_risk,"
        " COUNT(*) FILTER (WHERE churn_probability >= 0.75) AS critical_risk,"
        " ROUND(100.0 * COUNT(*) FILTER (WHERE churn_probability >= 0.5) / COUNT(*), 1) AS high_risk_pct,"
        " ROUND(100.0 * COUNT(*) FILTER (WHERE churn_probability >= 0.75) / COUNT(*), 1) AS critical_risk_pct,"
        " ROUND(AVG(churn_probability), 4) AS avg_probability,"
        " ROUND(SUM(monthly_charges) FILTER (WHERE churn_probability >= 0.5), 2) AS revenue_at_risk FROM scored"
    )
    bins = _values(
        [(0.0, 0.25, "Low (0-25%)"), (0.25, 0.5, "Medium (25-50%)"), (0.5, 0.75, "High (50-75%)"),
         (0.75, 1.0, "Critical (75-100%)")],
        "low, high, risk_category",
    )
    sql["d02_risk_distribution"] = (
        f"SELECT b.risk_category, COUNT(s.customer_id) AS n FROM ({bins}) b LEFT JOIN scored s"
        " ON s.churn_probability > b.low AND s.churn_probability <= b.high GROUP BY 1"
    )
    sql["d03_probability_histogram"] = (
        "SELECT CAST(LEAST(FLOOR(churn_probability / (CAST(1 AS DOUBLE) / 20)), 19) AS BIGINT) AS bin, COUNT(*) AS n FROM scored GROUP BY 1"
    )
    for key, column in (("d04_risk_by_contract", "contract_type"), ("d05_risk_by_payment", "payment_method")):
        sql[key] = (
            f"SELECT {column}, ROUND(AVG(churn_probability), 4) AS avg_churn_risk, COUNT(*) AS n FROM scored GROUP BY 1"
        )
    sql["d06_top_at_risk"] = (
        "SELECT customer_id, churn_probability, risk_level, contract_type, monthly_charges FROM scored"
        " ORDER BY churn_probability DESC, customer_id LIMIT 10"
    )
    d07 = (
        f"{risk_list} WHERE churn_probability >= 0.6 AND risk_level IN ('Critical', 'High') AND customer_id ILIKE '%r#0000%'"
        " ORDER BY churn_probability DESC, customer_id LIMIT 75"
    )
    sql["d07_risk_list"] = d07
    sql["d08_risk_list_stats"] = (
        "SELECT COUNT(*) AS shown, COUNT(*) FILTER (WHERE risk_level = 'Critical') AS critical,"
        " COUNT(*) FILTER (WHERE risk_level = 'High') AS high, ROUND(COALESCE(AVG(churn_probability), 0), 4) AS avg_probability"
        f" FROM ({d07})"
    )
    sql["d09_retention_advice"] = _advice_rows(
        [
            ("contract_type = 'Month-to-month'", _ADVICE["contract"]),
            ("payment_method = 'Electronic check'", _ADVICE["payment"]),
            ("NOT tech_support", _ADVICE["support"]),
            ("NOT online_security", _ADVICE["security"]),
            ("tenure_months < 12", _ADVICE["new"]),
        ],
        _ADVICE["none"],
        "requests",
    )
    sql["d10_what_if_inputs"] = (
        "SELECT customer_id, multiple_lines AND phone_service AS multiple_lines, "
        + ", ".join(f"{c} AND internet_service <> 'No' AS {c}" for c in _ADD_ONS)
        + " FROM requests"
    )
    sql["d11_what_if_advice"] = _advice_rows(
        [
            ("contract_type = 'Month-to-month'", _SUGGEST["contract"]),
            ("payment_method = 'Electronic check'", _SUGGEST["payment"]),
            ("NOT tech_support AND internet_service <> 'No'", _SUGGEST["support"]),
            ("NOT online_security AND internet_service <> 'No'", _SUGGEST["security"]),
        ],
        _SUGGEST["none"],
        "requests",
    )
    sql["d12_scenarios"] = (
        "SELECT customer_id, CAST(scenario_order AS BIGINT) AS scenario_order, scenario, risk FROM compared"
    )
    sql["d12b_best_scenario"] = (
        "SELECT customer_id, scenario AS best_scenario, risk AS best_risk FROM (SELECT *, ROW_NUMBER() OVER"
        " (PARTITION BY customer_id ORDER BY risk, scenario_order) AS place FROM compared) WHERE place = 1"
    )
    keywords = _values(
        [(c, k) for c, ks in reports.FEATURE_CATEGORIES.items() for k in ks], "category, keyword"
    )
    sql["d13_feature_categories"] = (
        "SELECT category, COUNT(*) AS n_features, ROUND(SUM(importance), 6) AS importance FROM"
        " (SELECT DISTINCT category, feature, importance FROM (SELECT feature, AVG(ABS(phi)) AS importance FROM phi GROUP BY 1) p"
        f" JOIN ({keywords}) k ON CONTAINS(p.feature, k.keyword)) GROUP BY 1"
    )
    sql["d14_metrics_vs_targets"] = checked

    # streams
    online = _scored("SELECT * FROM served_online")
    sql["x1_stream_scoring"] = (
        "SELECT customer_id, churn_probability, CAST(churn_prediction AS BIGINT) AS churn_prediction, risk_level,"
        f" CAST(reason_rank AS BIGINT) AS reason_rank, feature, {_DIRECTION} AS direction, ROUND(ABS(phi), 4) AS impact,"
        f" {_texts(ONLINE_NAMES)} AS description FROM ({online}) JOIN reasons_online USING (customer_id)"
    )
    sql["x2_stream_summary"] = (
        f"SELECT l.risk_level, COUNT(s.customer_id) AS n FROM ({levels}) l LEFT JOIN ({online}) s USING (risk_level) GROUP BY 1"
    )
    return {key: complete(text) for key, text in sql.items()}
