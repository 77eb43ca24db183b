"""Stage schemas and the persistent tables."""

from __future__ import annotations

RAW_DOCS = "company string, quarter string, weight double, source string, raw_text string, filename string"
SENTENCES = "company string, quarter string, source string, sentence string"
CLAIMS = "company string, quarter string, sentence string, label string, confidence double"
ATTRIBUTES = "company string, quarter string, sentence string, metric string, direction string, magnitude string, direction_missing boolean"
FACTS = "company string, quarter string, metric string, value double, weight double"
VECTOR_DOCS = "id string, document string, metadata map<string,string>, embedding array<float>"

_CHANGES = ", ".join(f"{c}_{k}_change double" for c in ("revenue", "net_profit", "operating_profit", "profit_margin") for k in ("qoq", "yoy"))

#: name -> (columns, key). A key is unique in its table; writers keep the last row of each.
TABLES = {
    "companies": ("id bigint, folder_name string, display_name string, status string, processed_at timestamp, error_msg string, seq bigint", ["folder_name"]),
    "analysis_cache": ("company_id bigint, mode string, result_json string, created_at timestamp, seq bigint", ["company_id", "mode"]),
    "claims": ("company_id bigint, quarter string, sentence string, metric string, direction string, magnitude string, result string, actual_change double, confidence double", None),
    "timeseries": (f"company_id bigint, quarter string, revenue double, net_profit double, operating_profit double, profit_margin double, {_CHANGES}", ["company_id", "quarter"]),
    "risk": ("company_id bigint, quarter string, total_claims bigint, verification_rate double, failure_rate double, partial_rate double, direction_mismatch_rate double, consistency_score double, risk_drift double, warning_flag int", ["company_id", "quarter"]),
    "vectors": (VECTOR_DOCS, None),
}
