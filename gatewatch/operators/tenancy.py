"""Tenants, users, sessions, permissions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .prefix import attach_row


def role_permissions(role: Column) -> Column:
    """The role's permissions as an array, empty for an unknown role."""
    out = None
    for r, ps in R.ROLE_PERMISSIONS.items():
        arr = F.array(*[F.lit(p) for p in ps])
        out = F.when(role == r, arr) if out is None else out.when(role == r, arr)
    return out.otherwise(F.array().cast("array<string>"))


def effective_permissions(role: Column, direct: Column, active: Column) -> Column:
    """J06 / SO03: direct plus role permissions; an inactive user has none."""
    none = F.array().cast("array<string>")
    return F.when(active, F.array_union(F.coalesce(direct, none), role_permissions(role))).otherwise(none)


def has_any(perms: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(perms, F.array(*[F.lit(p) for p in wanted]))


def has_all(perms: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(p) for p in wanted]), perms)) == 0


def visible_rows(rows: DataFrame, viewer_role: str, viewer_tenant) -> DataFrame:
    """What one user may see."""
    return rows if viewer_role == "super_admin" else rows.where(F.col("tenant_id") == viewer_tenant)


def manageable_counts(users: DataFrame) -> DataFrame:
    """How many users each manager may manage.

    The rule needs only the manager's tenant and the target's role, so targets are counted per tenant
    and no (manager, target) pair is built.
    """
    per = users.groupBy("tenant_id").agg(F.count_if(F.col("role") != "super_admin").alias("_own"))
    m = users.where(F.col("role").isin("super_admin", "tenant_admin"))
    return (attach_row(m.join(per, "tenant_id"), users.agg(F.count(F.lit(1)).alias("_all")))
            .withColumn("manageable", F.when(F.col("role") == "super_admin", F.col("_all")).otherwise(F.col("_own")))
            .select("user_id", "tenant_id", "role", "manageable"))


def can_manage(manager_role: Column, manager_tenant: Column, target_role: Column, target_tenant: Column) -> Column:
    return (manager_role == "super_admin") | ((manager_role == "tenant_admin") & (
        manager_tenant == target_tenant) & (target_role != "super_admin"))


def valid_sessions(sessions: DataFrame, users: DataFrame, tenants: DataFrame, as_of_us: int) -> DataFrame:
    """Token to session, user and tenant; inactive and expired sessions are rejected."""
    s = sessions.where(F.col("is_active") & (F.col("expires_us") >= as_of_us)).drop("is_active", "created_us")
    u = users.where("is_active").select("user_id", "tenant_id", "username", "role")
    return s.join(u, "user_id").join(tenants.select("tenant_id", F.col("name").alias("tenant_name")), "tenant_id")


def session_cleanup(sessions: DataFrame, as_of_us: int) -> DataFrame:
    """ST09: the sessions that stay."""
    return sessions.where((F.col("expires_us") >= as_of_us) & F.col("is_active"))


def tenant_usage(users: DataFrame, sessions: DataFrame, bans: DataFrame | None, as_of_us: int) -> DataFrame:
    """Usage per tenant; sources that are not given count as 0."""
    u = users.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("users"),
                                       F.count_if(F.col("is_active")).alias("active_users"))
    s = (session_cleanup(sessions, as_of_us).join(users.select("user_id", "tenant_id"), "user_id")
         .groupBy("tenant_id").agg(F.count(F.lit(1)).alias("concurrent_sessions")))
    out = u.join(s, "tenant_id", "left")
    if bans is not None:
        out = out.join(bans.groupBy("tenant_id").agg(F.countDistinct("ip").alias("banned_ips")), "tenant_id", "left")
    else:
        out = out.withColumn("banned_ips", F.lit(0).cast("bigint"))
    return (out.withColumn("rules", F.lit(0).cast("bigint")).withColumn("storage_mb", F.lit(0).cast("bigint"))
            .fillna(0))


def quota_status(tenants: DataFrame, usage: DataFrame) -> DataFrame:
    """AG25 / J09: one row per tenant and resource.

    The hourly request quota reads a usage figure that is never written, so its use is always 0.
    """
    j = tenants.join(usage, "tenant_id", "left")
    cells = [F.struct(F.lit(res).alias("resource"),
                      F.coalesce(F.col(use), F.lit(0)).cast("bigint").alias("current") if use
                      else F.lit(0).cast("bigint").alias("current"), F.col(quota).alias("limit"))
             for res, quota, use in R.QUOTA_RESOURCES]
    q = j.select("tenant_id", F.explode(F.array(*cells)).alias("q")).select("tenant_id", "q.*")
    return (q.withColumn("usage_percent", F.when(F.col("limit") > 0, F.col("current") / F.col("limit") * 100)
                         .otherwise(0.0))
            .withColumn("available", F.greatest(F.lit(0).cast("bigint"), F.col("limit") - F.col("current"))))


def check_quota(status: DataFrame, resource: str, requested: int = 1) -> DataFrame:
    """Whether each tenant may take ``requested`` more; unknown resources are always allowed."""
    if resource not in [r for r, _, _ in R.QUOTA_RESOURCES]:
        return status.select("tenant_id").distinct().withColumn("allowed", F.lit(True))
    return status.where(F.col("resource") == resource).select(
        "tenant_id", (F.col("current") + requested <= F.col("limit")).alias("allowed"))


def delete_tenants(deleted: DataFrame, tenants: DataFrame, users: DataFrame, sessions: DataFrame):
    """(tenants, users, sessions) without the deleted tenants and what hangs on them."""
    d = deleted.select("tenant_id").distinct()
    kept = users.join(d, "tenant_id", "left_anti")
    gone = users.join(d, "tenant_id", "left_semi").select("user_id")
    return tenants.join(d, "tenant_id", "left_anti"), kept, sessions.join(gone, "user_id", "left_anti")


def tenant_list(tenants: DataFrame, status: str | None = None) -> DataFrame:
    """TK11."""
    t = tenants.where(F.col("status") == status) if status else tenants
    return t.orderBy("created_us", "tenant_id")


def merge_latest(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key; decided by one aggregation, so a hot key keeps one row per task."""
    cols = [c for c in stored.columns if c != key]
    row = F.max_by(F.struct(*cols), F.struct(version, "_new"))
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.select(*stored.columns).withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(row.alias("_r")).select(key, "_r.*").select(*stored.columns)


def accept_users(users: DataFrame, requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """New users that are taken: name free in the tenant, quota not full, in request order.

    Requests are numbered per tenant behind its current head count.
    """
    from .prefix import row_numbers
    first = (requests.groupBy("tenant_id", "username").agg(
        F.min_by(F.struct("user_id", "created_us"), F.struct("created_us", "user_id")).alias("r"))
        .select("tenant_id", "username", "r.*"))
    free = first.join(users.select("tenant_id", "username"), ["tenant_id", "username"], "left_anti")
    have = users.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_have"))
    n = row_numbers(free, ["tenant_id"], "created_us", "user_id", "_n", slice_us=3_600_000_000)
    return (n.join(tenants.select("tenant_id", "max_users"), "tenant_id").join(have, "tenant_id", "left")
            .where(F.coalesce("_have", F.lit(0)) + F.col("_n") <= F.col("max_users"))
            .select("tenant_id", "username", "user_id"))
