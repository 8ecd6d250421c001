"""Catalog tables: declared schemas, so nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "projects": "project_id BIGINT, user_id BIGINT, name STRING, github_url STRING, scan_schedule STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "scans": "scan_id BIGINT, project_id BIGINT, status STRING, branch STRING, total_vulnerabilities INT, critical_count INT, warning_count INT, info_count INT, "
    "policy_status STRING, duration_ms BIGINT, error_message STRING, created_at TIMESTAMP, completed_at TIMESTAMP",
    "findings": "scan_id BIGINT, rule_id STRING, rule_name STRING, severity STRING, confidence STRING, message STRING, file_path STRING, line INT, "
    "`column` INT, snippet STRING, cwe STRING, owasp STRING, suggestion STRING, reachable BOOLEAN, created_at TIMESTAMP",
    "policies": "policy_id STRING, user_id BIGINT, project_id BIGINT, name STRING, description STRING, enabled BOOLEAN, action STRING, conditions STRING, created_at TIMESTAMP",
    "policy_evaluations": "scan_id BIGINT, policy_id STRING, status STRING, matched_count BIGINT, created_at TIMESTAMP",
    "profiles": "user_id BIGINT, pr_scan_enabled BOOLEAN, slack_webhook_url STRING, discord_webhook_url STRING",
    "notifications": "notification_id BIGINT, user_id BIGINT, type STRING, title STRING, message STRING, link STRING, read_at TIMESTAMP, created_at TIMESTAMP",
    "answer_cache": "cache_key STRING, response STRING, created_at TIMESTAMP",
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns and types of a catalog table, in its order; columns that it lacks are null, others go."""
    schema = StructType.fromDDL(SCHEMAS[name])
    have = {c.lower(): c for c in df.columns}
    pick = lambda f: F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
    return df.select(*[pick(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet", mode: str = "append") -> None:
    conform(df, name).write.format(fmt).mode(mode).save(f"{folder.rstrip('/')}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{folder.rstrip('/')}/{name}")
