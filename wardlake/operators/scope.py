"""Grants (departments and a date range) as partition scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.idents import (
    access_key_of,
    bucket_of,
    namespace_of,
    object_of,
    path_namespace,
    usable_credential,
)
from wardlake.functions.times import checked_date
from wardlake.session import written

# The policy document's version, statement names, actions and
# resource shapes, and the size above which a policy is refused.
POLICY_VERSION = "2012-10-17"
POLICY_LIMIT_BYTES = 2048
TOO_LARGE = "policy_too_large"
LIST_ACTION, GET_ACTION = "s3:ListBucket", "s3:GetObject"
LIST_METADATA, GET_METADATA, GET_PARTITIONS = "AllowListMetadata", "AllowGetMetadata", "AllowSpecificPartitions"
RESOURCE_PREFIX = "arn:aws:s3:::"
# Bucket, namespace, table, department and day pattern of a partition.
PARTITION_RESOURCE = "arn:aws:s3:::%s/iceberg/%s/%s/data/department_name=%s/checkup_date=%s/*"


# --- date ranges -----------------------------------------------------------


def range_error(start: Column, end: Column) -> Column:
    """Why two date texts are not a range (NULL when they are)."""
    return (
        F.when(checked_date(start).isNull(), F.lit("invalid start date"))
        .when(checked_date(end).isNull(), F.lit("invalid end date"))
        .when(checked_date(end) < checked_date(start), F.lit("end date before start date"))
    )


def range_problem(start: Column, end: Column) -> Column:
    """Why two dates give no list of days (NULL when they do)."""
    return (
        F.when(start.isNull(), F.lit("open start date"))
        .when(end.isNull(), F.lit("open end date"))
        .when(end < start, F.lit("end date before start date"))
    )


def days_between(start: Column, end: Column) -> Column:
    return F.when(start <= end, F.sequence(start, end))


def expand_days(grants: DataFrame, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """One row per granted day, both ends included.

    A grant that is open or reversed is one row without a day and with the
    ``reason`` instead; fill an open end first where a last day is known. Grants
    are dealt evenly first: one file of them may hold years of days.
    """
    with_reason = grants.hint("rebalance").withColumn("reason", range_problem(F.col(start), F.col(end)))
    return with_reason.withColumn("day", F.explode_outer(days_between(F.col(start), F.col(end))))


def range_patterns(start: Column, end: Column) -> Column:
    """Array of ``yyyy-*``, ``yyyy-MM-*`` and day patterns that cover exactly the range.

    A pure expression: a grant is collapsed where it is, without a shuffle and
    without listing the days of its complete months and years. NULL where
    `range_problem` has a reason.
    """

    def of_month(first: Column) -> Column:
        last = F.last_day(first)
        days = F.sequence(F.greatest(start, first), F.least(end, last))
        whole = (start <= first) & (last <= end)
        return F.when(whole, F.array(F.date_format(first, "yyyy-MM-'*'"))).otherwise(
            F.transform(days, lambda d: d.cast("string"))
        )

    def of_year(year: Column) -> Column:
        first, last = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))
        months = F.sequence(
            F.trunc(F.greatest(start, first), "month"), F.least(end, last), F.expr("INTERVAL 1 MONTH")
        )
        whole = (start <= first) & (last <= end)
        return F.when(whole, F.array(F.date_format(first, "yyyy-'*'"))).otherwise(
            F.flatten(F.transform(months, of_month))
        )

    return F.when(start <= end, F.flatten(F.transform(F.sequence(F.year(start), F.year(end)), of_year)))


def collapse_days(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """The same patterns from any set of days (rows may repeat): ``keys, pattern``.

    The days of a month are the bits of one number per key, so a day costs the same however
    often it comes, and a key and year is twelve numbers. Rows without a day have no pattern.
    """
    month = F.trunc(day, "month").alias("_month")
    by_month = days.where(F.col(day).isNotNull()).groupBy(*keys, month).agg(F.bit_or(_bit(F.dayofmonth(day))).alias("_held"))
    by_year = by_month.groupBy(*keys, F.year("_month").alias("_year")).agg(
        F.sort_array(F.collect_list(F.struct("_month", "_held"))).alias("_months")
    )

    def whole(m: Column) -> Column:
        return m["_held"] == _bit(F.dayofmonth(F.last_day(m["_month"])) + 1) - 1

    def of_month(m: Column) -> Column:
        inside = F.filter(
            F.sequence(m["_month"], F.last_day(m["_month"])), lambda d: m["_held"].bitwiseAND(_bit(F.dayofmonth(d))) != 0
        )
        return F.when(whole(m), F.array(F.date_format(m["_month"], "yyyy-MM-'*'"))).otherwise(
            F.transform(inside, lambda d: d.cast("string"))
        )

    all_year = (F.size("_months") == 12) & F.forall("_months", whole)
    year_pattern = F.date_format(F.make_date(F.col("_year"), F.lit(1), F.lit(1)), "yyyy-'*'")
    patterns = F.when(all_year, F.array(year_pattern)).otherwise(F.flatten(F.transform("_months", of_month)))
    return by_year.select(*keys, F.explode(patterns).alias("pattern"))


def _bit(day_of_month: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), day_of_month - 1)


# --- policies --------------------------------------------------------------


def partition_resources(
    bucket: Column, namespace: Column, tables: list[str], departments: Column, patterns: Column
) -> Column:
    """Every table × department × pattern as the address of its partitions."""

    def of_table(table: str) -> Column:
        def of_department(department: Column) -> Column:
            return F.transform(
                patterns,
                lambda pattern: F.format_string(PARTITION_RESOURCE, bucket, namespace, F.lit(table), department, pattern),
            )

        return F.flatten(F.transform(departments, of_department))

    return F.concat(*[of_table(t) for t in tables])


def policy_json(
    bucket: Column, namespace: Column, tables: list[str], departments: Column, patterns: Column
) -> Column:
    """Compact policy text: list and read table metadata, read the granted partitions."""
    root = F.concat(F.lit("iceberg/"), namespace)

    def below(table: str, what: str) -> Column:
        return F.concat(root, F.lit(f"/{table}/{what}/*"))

    allow = F.lit("Allow").alias("Effect")
    prefixes = F.array(*[below(t, what) for t in tables for what in ("metadata", "data")])
    metadata = F.array(*[F.concat(F.lit(RESOURCE_PREFIX), bucket, F.lit("/"), below(t, "metadata")) for t in tables])
    listing = F.struct(
        F.lit(LIST_METADATA).alias("Sid"),
        allow,
        F.lit(LIST_ACTION).alias("Action"),
        F.concat(F.lit(RESOURCE_PREFIX), bucket).alias("Resource"),
        F.struct(F.struct(prefixes.alias("s3:prefix")).alias("StringLike")).alias("Condition"),
    )
    reading = F.struct(
        F.lit(GET_METADATA).alias("Sid"),
        allow,
        F.lit(GET_ACTION).alias("Action"),
        (metadata[0] if len(tables) == 1 else metadata).alias("Resource"),
    )
    partitions = F.struct(
        F.lit(GET_PARTITIONS).alias("Sid"),
        allow,
        F.lit(GET_ACTION).alias("Action"),
        partition_resources(bucket, namespace, tables, departments, patterns).alias("Resource"),
    )
    statements = F.concat_ws(",", F.to_json(listing), F.to_json(reading), F.to_json(partitions))
    text = F.concat(F.lit(f'{{"Version":"{POLICY_VERSION}","Statement":['), statements, F.lit("]}"))
    for mark in "<>&":
        text = F.replace(text, F.lit(mark), F.lit(f"\\u{ord(mark):04x}"))
    return text


def policy_verdict(policy: Column, limit: int = POLICY_LIMIT_BYTES) -> Column:
    return F.when(F.octet_length(policy) > limit, F.lit(TOO_LARGE)).otherwise(F.lit("ok"))


# --- checks of one request against one grant -------------------------------


def check_departments(requested: Column, approved: Column) -> Column:
    """The first requested department that is not approved, as a reason."""
    refused = F.array_except(requested, approved)
    first = F.element_at(F.filter(requested, lambda d: F.array_contains(refused, d)), 1)
    return F.when(F.size(refused) > 0, F.concat(F.lit("department not approved: "), first))


def check_dates(req_start: Column, req_end: Column, approved_start: Column, approved_end: Column) -> Column:
    """Why a requested range (text, may be empty) is outside the approved dates.

    An empty side falls back to the approved one; an open approved side allows all.
    """
    start, end = F.nullif(req_start, F.lit("")), F.nullif(req_end, F.lit(""))
    bad = (start.isNotNull() & checked_date(start).isNull()) | (end.isNotNull() & checked_date(end).isNull())
    return (
        F.when(bad, F.lit("invalid date"))
        .when(checked_date(start) < approved_start, F.lit("start before approved start"))
        .when(checked_date(end) > approved_end, F.lit("end after approved end"))
    )


def effective_dates(
    req_start: Column, req_end: Column, approved_start: Column, approved_end: Column
) -> tuple[Column, Column]:
    return (
        F.coalesce(checked_date(req_start), approved_start),
        F.coalesce(checked_date(req_end), approved_end),
    )


# --- many grants at once ---------------------------------------------------


def covered_partitions(partitions: DataFrame, grants: DataFrame) -> DataFrame:
    """The (namespace, department_name, checkup_date) of ``partitions`` some grant covers.

    Each grant adds one at its start and takes one away after its end; the
    running sum over a department's days is the number of grants in force. Both
    sides are first reduced to one row per day, so the window runs over days
    and its size does not depend on the number of grants or rows.
    """
    keys = ["namespace", "department_name"]
    opened = F.coalesce(F.col("date_start"), F.to_date(F.lit("0001-01-01")))
    edge = F.explode(
        F.array(
            F.struct(opened.alias("day"), F.lit(1).alias("step")),
            F.struct(F.date_add("date_end", 1).alias("day"), F.lit(-1).alias("step")),
        )
    )
    in_force = F.col("date_start").isNull() | F.col("date_end").isNull() | (F.col("date_start") <= F.col("date_end"))
    steps = (
        grants.filter(in_force)
        .withColumn("department_name", F.explode(F.array_distinct("departments")))
        .select(*keys, edge.alias("edge"))
        .filter("edge.day IS NOT NULL")
        .groupBy(*keys, F.col("edge.day").alias("checkup_date"))
        .agg(F.sum("edge.step").alias("step"))
        .withColumn("held", F.lit(False))
    )
    held = partitions.select(
        *keys, "checkup_date", F.lit(0).cast("long").alias("step"), F.lit(True).alias("held")
    ).distinct()
    days = (
        steps.unionByName(held)
        .groupBy(*keys, "checkup_date")
        .agg(F.sum("step").alias("step"), F.max("held").alias("held"))
    )
    running = F.sum("step").over(Window.partitionBy(*keys).orderBy("checkup_date"))
    return (
        days.withColumn("grants_in_force", running)
        .filter("held AND grants_in_force > 0")
        .select(*keys, "checkup_date", "grants_in_force")
    )


def enforce(rows: DataFrame, grants: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """The rows some grant covers.

    Whether a row is readable depends only on its partition, so grants are
    settled per partition first, into a table of at most one row per site,
    department and day. An equality join with it keeps the rows; on a
    partitioned table that also skips the partitions nobody may read.
    """
    held = rows if partitions is None else partitions
    settled = written(covered_partitions(held, grants), "covered").filter(F.col("grants_in_force") > 0)
    return rows.join(settled.drop("grants_in_force"), ["namespace", "department_name", "checkup_date"], "left_semi")


def attribute_paths(paths: DataFrame, grants: DataFrame, now: Column, path: str = "path") -> DataFrame:
    """Bucket, namespace, key and the grant each object read belongs to."""
    split = (
        paths.withColumn("_qualified", path_namespace(F.col(path)))
        .withColumn("bucket", bucket_of(F.col(path)))
        .withColumn("object", object_of(F.col(path)))
        .withColumn("namespace", namespace_of(F.col("_qualified")))
        .withColumn("access_key_id", F.upper(access_key_of(F.col("_qualified"))))
        .drop("_qualified")
    )
    approved = grants.filter(
        (F.col("status") == "APPROVED") & usable_credential(F.col("access_key_id"), F.col("cred_expiration"), now)
    )
    owners = approved.groupBy("namespace", "access_key_id").agg(F.min("grant_id").alias("grant_id"))
    found = split.join(owners, ["namespace", "access_key_id"], "left")
    verdict = F.when(F.col("grant_id").isNull(), F.lit("FORBIDDEN")).otherwise(F.lit("ALLOWED"))
    return found.withColumn("verdict", verdict)
