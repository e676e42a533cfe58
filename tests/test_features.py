from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepsake.operators import features, views
from keepsake.plans.fixed_model import ROWS
from keepsake.schema import BINARY_FEATURES, FEATURES, NUMERIC_FEATURES
from keepsake.sources.star_schema import retention_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def base(spark):
    return views.feature_base(retention_tables(spark, SF)).persist()


def test_names():
    assert len(NUMERIC_FEATURES) == 16 and len(BINARY_FEATURES) == 45 and len(set(FEATURES)) == 61
    assert [r[0] for r in ROWS] == FEATURES


def test_fit_statistics_equal_pandas(spark, base):
    pdf = base.toPandas().sort_values("customer_id").reset_index(drop=True)
    monthly = pdf["monthly_charges"].astype(float)
    flags = [c for c in pdf.columns if c.startswith("has_")]
    services = pdf[[c for c in flags if c not in ("has_dsl", "has_fiber")]].sum(axis=1) + (
        pdf["has_dsl"] | pdf["has_fiber"]
    )
    per_service = np.where(services > 0, monthly / services.where(services > 0, 1), monthly)
    frame = features.training_frame(base).toPandas().sort_values("customer_id").reset_index(drop=True)
    assert (frame["total_services"] == services).all()
    assert np.allclose(frame["charge_per_service"], per_service)
    assert (frame["is_high_value"] == (monthly > monthly.median()).astype(int)).all()
    quarters = pd.qcut(monthly, 4, labels=[1, 2, 3, 4]).astype(int)
    assert (frame["monthly_charge_quartile"] == quarters).all()
    ranks = pd.qcut(pdf["tenure_months"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    assert (frame["tenure_quartile"] == ranks).all()
    high = (per_service > np.median(per_service) * 1.5).astype(int)
    assert (frame["risk_high_charge"] == high).all()
    buckets = pd.cut(
        pdf["tenure_months"], [0, 6, 12, 24, 48, 72, np.inf], labels=[1, 2, 3, 4, 5, 6], include_lowest=True
    ).astype(int)
    assert (frame["tenure_bucket"] == buckets).all()
    assert not frame.isna().any().any()


def test_fitted_mode_keeps_training_values(spark, base):
    stats = features.FeatureStats.fit(base)
    again = features.FeatureStats.from_frame(stats.to_frame(spark))
    assert again == stats
    some = base.filter("tenure_months < 20")
    fitted = features.training_frame(some, again, "fitted")
    whole = features.training_frame(base, stats)
    assert fitted.exceptAll(whole).count() == 0
    assert features.training_frame(some).exceptAll(whole).count() > 0
    with pytest.raises(ValueError):
        features.with_features(base, "fitted")
    with pytest.raises(ValueError):
        features.with_features(base, "other")


def test_serve_example(spark):
    """One record worked out by hand: just started, no total yet, long contract, paid by card."""
    row = dict(
        customer_id="y", gender="Male", senior_citizen=True, partner=False, dependents=False, tenure_months=0,
        monthly_charges=24.5, total_charges=None, contract_type="Two year",
        payment_method="Credit card (automatic)", paperless_billing=False, phone_service=True, multiple_lines=True,
        internet_service="DSL", online_security=True, online_backup=False, device_protection=False,
        tech_support=True, streaming_tv=False, streaming_movies=False,
    )
    from keepsake.schema import REQUEST_SCHEMA

    request = spark.createDataFrame([tuple(row[f.name] for f in REQUEST_SCHEMA)], REQUEST_SCHEMA)
    got = features.with_features(request, "serve").first().asDict()
    want = dict(
        total_services=5, premium_service_count=2, has_security_bundle=1, has_support_bundle=1, has_streaming_bundle=0,
        internet_dsl=1, internet_fiber=0, has_family=0, family_size_proxy=0, senior_alone=1, contract_length=2,
        is_month_to_month=0, has_long_contract=1, has_auto_payment=1, payment_credit_card=1, payment_mailed_check=0,
        tenure_bucket=1, tenure_quartile=1, is_new_customer=1, is_established=0, monthly_charge_quartile=1,
        is_high_value=0, avg_monthly_spend=24.5, charge_per_service=4.9, estimated_clv=None, spending_trend=0,
        risk_mtm=0, risk_new=1, risk_echeck=0, risk_no_support=0, risk_high_charge=0, risk_fiber=0,
        risk_factors_count=1, risk_score=2, high_risk_flag=0, senior_mtm=0, tenure_contract_interaction=0,
    )
    assert {k: got[k] for k in want} == want


def test_statistics_of_nothing(spark, base):
    blank = base.withColumns({c: F.lit(None).cast(base.schema[c].dataType) for c in ("monthly_charges", "total_charges")})
    for given in (base.limit(0), blank):
        stats = features.FeatureStats.fit(given)
        assert stats.median_monthly is None and stats.median_charge_per_service is None
        assert features.FeatureStats.from_frame(stats.to_frame(spark)) == stats
        rows = features.training_frame(given, stats).collect()
        assert len(rows) == given.count() and {(r["is_high_value"], r["risk_high_charge"]) for r in rows} <= {(0, 0)}


def test_missing_features_are_reported(spark, base):
    built = features.with_features(base, "serve").drop("risk_score")
    selected, missing = features.select_features(built)
    assert missing == ["risk_score"] and len(selected.columns) == 61
