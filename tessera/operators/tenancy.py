"""Row scoping by tenant and permission lookups. Scoping is a convention of queries, not a security boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What each role may do.
ROLE_PERMISSIONS = {
    "platform_admin": (
        "tenants:manage", "plans:manage", "config:manage", "llm:manage", "revenue:view", "users:manage", "risk_config:manage_tenant", "analytics:view_tenant", "cases:read",
        "audit:read", "reports:read",
    ),
    "tenant_admin": ("users:manage", "risk_config:manage_tenant", "analytics:view_tenant", "cases:read"),
    "compliance_analyst": ("cases:work_review", "cases:note", "cases:clear", "cases:escalate", "cases:request_info", "cases:read"),
    "senior_reviewer": ("cases:work_high_risk", "cases:decide", "cases:approve_second", "cases:note", "cases:escalate", "cases:request_info", "cases:read"),
    "auditor": ("cases:read", "audit:read", "reports:read"),
    "customer": ("applications:submit_own", "applications:view_own"),
}


def scoped(df: DataFrame, tenant_id: int | None, shared: bool = False, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant, with shared also those of none; without a tenant no row of any tenant."""
    own = F.lit(False) if tenant_id is None else F.coalesce(F.col(column) == tenant_id, F.lit(False))
    return df.where(own | F.col(column).isNull() if shared else own)


def grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(role, p) for role, held in ROLE_PERMISSIONS.items() for p in held], "role string, permission string")


def allowed(people: DataFrame, granted: DataFrame, permission: str) -> DataFrame:
    """The people whose role has the permission."""
    return people.join(granted.where(F.col("permission") == permission).select("role"), "role", "left_semi").withColumn("permission", F.lit(permission))
