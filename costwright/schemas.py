"""Schemas of the billing tables and of the audit tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
DBL, BOOL = T.DoubleType(), T.BooleanType()
DAY, TIME = T.DateType(), T.TimestampType()
TAGS = T.MapType(STR, STR)
QUANTITY = T.DecimalType(18, 4)
PRICE = T.DecimalType(10, 4)


def _struct(*fields, required=()):
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields])


USAGE_METADATA = _struct(
    ("cluster_id", STR), ("warehouse_id", STR), ("job_id", STR),
    ("notebook_id", STR), ("dlt_pipeline_id", STR),
)
IDENTITY_METADATA = _struct(("run_as", STR), ("owned_by", STR))

BILLING_USAGE = _struct(
    ("record_id", STR), ("account_id", STR), ("workspace_id", STR),
    ("sku_name", STR), ("cloud", STR),
    ("usage_start_time", TIME), ("usage_end_time", TIME), ("usage_date", DAY),
    ("custom_tags", TAGS), ("usage_unit", STR), ("usage_quantity", QUANTITY),
    ("usage_metadata", USAGE_METADATA), ("identity_metadata", IDENTITY_METADATA),
    ("record_type", STR), ("ingestion_date", DAY),
    ("billing_origin_product", STR), ("product_features", STR), ("usage_type", STR),
)

LIST_PRICES = _struct(
    ("price_start_time", TIME), ("price_end_time", TIME), ("account_id", STR),
    ("sku_name", STR), ("cloud", STR), ("currency_code", STR),
    ("usage_unit", STR), ("pricing", _struct(("default", PRICE))),
)

CLUSTERS = _struct(
    ("account_id", STR), ("workspace_id", STR), ("cluster_id", STR),
    ("cluster_name", STR), ("owned_by", STR),
    ("create_time", TIME), ("delete_time", TIME),
    ("driver_node_type", STR), ("worker_node_type", STR), ("worker_count", INT),
    ("min_autoscale_workers", INT), ("max_autoscale_workers", INT),
    ("auto_termination_minutes", INT), ("enable_elastic_disk", BOOL),
    ("tags", TAGS), ("cluster_source", STR), ("init_scripts", STR),
    ("aws_attributes", STR), ("azure_attributes", STR), ("gcp_attributes", STR),
    ("driver_instance_pool_id", STR), ("worker_instance_pool_id", STR),
    ("dbr_version", STR), ("change_time", TIME), ("change_date", DAY),
    ("data_security_mode", STR), ("policy_id", STR),
)

JOB_RUNS = _struct(
    ("account_id", STR), ("workspace_id", STR), ("job_id", STR), ("run_id", STR),
    ("period_start_time", TIME), ("period_end_time", TIME),
    ("trigger_type", STR), ("run_type", STR), ("run_name", STR),
    ("compute_ids", T.ArrayType(STR)), ("result_state", STR),
    ("termination_code", STR),
)

AUDIT = {
    "runs": _struct(
        ("run_id", STR), ("job_run_id", STR), ("started_at", TIME), ("ended_at", TIME),
        ("status", STR), ("triggered_by", STR), ("mode", STR), ("dry_run", BOOL),
        ("lookback_days", INT), ("config_snapshot", STR), ("error_message", STR),
        ("duration_seconds", DBL), ("findings_count", INT),
        ("recommendations_count", INT), ("llm_calls", INT), ("llm_tokens", LONG),
        required=("run_id", "started_at"),
    ),
    "findings": _struct(
        ("finding_id", STR), ("run_id", STR), ("detected_at", TIME),
        ("finding_type", STR), ("severity", STR), ("resource_type", STR),
        ("resource_id", STR), ("resource_name", STR), ("workspace_id", STR),
        ("metric_name", STR), ("metric_value", DBL), ("baseline_value", DBL),
        ("delta_pct", DBL), ("headline", STR), ("explanation", STR),
        ("raw_data", STR), ("status", STR),
        required=("finding_id", "run_id", "detected_at", "finding_type", "severity"),
    ),
    "recommendations": _struct(
        ("recommendation_id", STR), ("run_id", STR), ("created_at", TIME),
        ("recommendation_type", STR), ("resource_type", STR), ("resource_id", STR),
        ("resource_name", STR), ("workspace_id", STR), ("title", STR),
        ("rationale", STR), ("expected_savings_usd_monthly", DBL),
        ("confidence", STR), ("priority_score", DBL), ("priority_tier", STR),
        ("implementation_steps", STR), ("risks", STR), ("status", STR),
        ("accepted_by", STR), ("implemented_at", TIME), ("actual_savings_usd", DBL),
        required=("recommendation_id", "run_id", "created_at",
                  "recommendation_type", "title"),
    ),
    "actions": _struct(
        ("action_id", STR), ("run_id", STR), ("recommendation_id", STR),
        ("finding_id", STR), ("proposed_at", TIME), ("executed_at", TIME),
        ("action_type", STR), ("target_resource", STR), ("payload", STR),
        ("dry_run", BOOL), ("status", STR), ("error_message", STR),
        required=("action_id", "run_id", "proposed_at", "action_type"),
    ),
    "llm_calls": _struct(
        ("call_id", STR), ("run_id", STR), ("called_at", TIME), ("endpoint", STR),
        ("purpose", STR), ("prompt_tokens", INT), ("completion_tokens", INT),
        ("total_tokens", INT), ("latency_seconds", DBL), ("success", BOOL),
        ("error_message", STR),
        required=("call_id", "run_id", "called_at"),
    ),
}

# Values a row takes when its writer leaves the column out.
AUDIT_DEFAULTS = {
    "runs": {"findings_count": 0, "recommendations_count": 0,
             "llm_calls": 0, "llm_tokens": 0},
    "findings": {"status": "OPEN"},
    "recommendations": {"status": "PROPOSED"},
    "actions": {},
    "llm_calls": {},
}

# The tables are laid out by the day of this time.
AUDIT_TIME_COLUMN = {
    "runs": "started_at",
    "actions": "proposed_at",
    "findings": "detected_at",
    "recommendations": "created_at",
    "llm_calls": "called_at",
}
