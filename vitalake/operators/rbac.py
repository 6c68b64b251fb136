"""Roles and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def role_permission_listing(role_permissions, roles, permissions, resources) -> DataFrame:
    """Readable role, resource and permission names of every grant."""
    return (
        role_permissions.join(roles.select(F.col("id").alias("role_id"), "role_name"), "role_id")
        .join(permissions.select(F.col("id").alias("permission_id"), "permission_name", "action_name", "resource_id"), "permission_id")
        .join(resources.select(F.col("id").alias("resource_id"), "resource_name"), "resource_id")
        .select("role_name", "resource_name", "permission_name", "action_name")
        .orderBy("role_name", "resource_name", "permission_name")
    )


def grant_role_permissions(wanted, roles, permissions, existing) -> DataFrame:
    """Name pairs resolved to ids, without repeats and without grants that exist already."""
    resolved = (
        wanted.join(roles.select(F.col("id").alias("role_id"), "role_name"), "role_name")
        .join(permissions.select(F.col("id").alias("permission_id"), "permission_name"), "permission_name")
        .select("role_id", "permission_id")
        .distinct()
    )
    return resolved.join(existing.select("role_id", "permission_id"), ["role_id", "permission_id"], "left_anti")


def permissions_for_user(users, role_permissions) -> DataFrame:
    """Sorted permission names per user; an unknown role has none.

    The set is built per role (a handful of rows) before it meets the users.
    """
    per_role = role_permissions.groupBy("role").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))
    return users.join(per_role, "role", "left").withColumn(
        "permissions", F.coalesce("permissions", F.array().cast("array<string>"))
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
