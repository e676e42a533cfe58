"""A literal scorer, so that scoring and attribution can be checked without training."""

from __future__ import annotations

from keepsake.operators.scoring import LinearModel

INTERCEPT = -0.4

# Feature, mean, deviation, coefficient.
ROWS = [
    ("tenure_months", 36.0, 21.0, -0.35),
    ("tenure_years", 3.0, 1.75, -0.15),
    ("tenure_bucket", 3.9, 1.2, -0.1),
    ("tenure_quartile", 2.5, 1.1, 0.05),
    ("monthly_charges", 68.0, 29.0, 0.45),
    ("total_charges", 2450.0, 1900.0, -0.2),
    ("avg_monthly_spend", 68.5, 29.5, 0.1),
    ("charge_per_service", 17.0, 11.0, -0.12),
    ("estimated_clv", 3270.0, 2050.0, 0.08),
    ("monthly_charge_quartile", 2.5, 1.1, 0.04),
    ("total_services", 4.1, 1.8, -0.06),
    ("service_diversity", 0.45, 0.2, 0.03),
    ("premium_service_count", 1.9, 1.5, -0.09),
    ("risk_score", 4.2, 2.4, 0.3),
    ("risk_factors_count", 2.3, 1.3, 0.15),
    ("tenure_contract_interaction", 22.0, 33.0, -0.25),
    ("gender_male", 0.5, 0.5, 0.01),
    ("is_senior", 0.16, 0.37, 0.07),
    ("has_partner", 0.48, 0.5, -0.02),
    ("has_dependents", 0.3, 0.46, -0.05),
    ("has_family", 0.62, 0.49, 0.02),
    ("senior_alone", 0.06, 0.24, 0.03),
    ("phone_service_flag", 0.9, 0.3, -0.04),
    ("multiple_lines_flag", 0.36, 0.48, 0.06),
    ("has_internet", 0.78, 0.41, 0.11),
    ("internet_fiber", 0.44, 0.5, 0.28),
    ("internet_dsl", 0.34, 0.47, -0.08),
    ("online_security_flag", 0.31, 0.46, -0.14),
    ("online_backup_flag", 0.31, 0.46, -0.07),
    ("device_protection_flag", 0.31, 0.46, -0.03),
    ("tech_support_flag", 0.31, 0.46, -0.13),
    ("streaming_tv_flag", 0.31, 0.46, 0.08),
    ("streaming_movies_flag", 0.31, 0.46, 0.09),
    ("has_security_bundle", 0.47, 0.5, -0.05),
    ("has_support_bundle", 0.47, 0.5, -0.05),
    ("has_streaming_bundle", 0.47, 0.5, 0.04),
    ("contract_length", 0.6, 0.8, -0.6),
    ("is_month_to_month", 0.6, 0.49, 0.4),
    ("has_long_contract", 0.4, 0.49, -0.2),
    ("payment_electronic_check", 0.28, 0.45, 0.22),
    ("payment_mailed_check", 0.24, 0.43, -0.03),
    ("payment_bank_transfer", 0.24, 0.43, -0.06),
    ("payment_credit_card", 0.24, 0.43, -0.07),
    ("has_auto_payment", 0.48, 0.5, -0.04),
    ("paperless_billing_flag", 0.6, 0.49, 0.16),
    ("is_new_customer", 0.1, 0.3, 0.2),
    ("is_established", 0.67, 0.47, -0.1),
    ("is_loyal", 0.34, 0.47, -0.1),
    ("is_high_value", 0.48, 0.5, 0.05),
    ("spending_trend", 0.5, 0.85, 0.02),
    ("risk_mtm", 0.6, 0.49, 0.4),
    ("risk_new", 0.1, 0.3, 0.2),
    ("risk_echeck", 0.28, 0.45, 0.22),
    ("risk_no_support", 0.4, 0.49, 0.12),
    ("risk_high_charge", 0.4, 0.49, 0.06),
    ("risk_fiber", 0.44, 0.5, 0.28),
    ("high_risk_flag", 0.42, 0.49, 0.17),
    ("new_high_value", 0.05, 0.21, 0.05),
    ("mtm_high_value", 0.29, 0.45, 0.1),
    ("senior_mtm", 0.1, 0.29, 0.04),
    ("fiber_no_support", 0.23, 0.42, 0.08),
]


def fixed_model() -> LinearModel:
    names, means, stds, coefs = (list(c) for c in zip(*ROWS))
    return LinearModel("FixedLinear", names, means, stds, coefs, INTERCEPT)
