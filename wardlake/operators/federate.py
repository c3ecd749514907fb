"""One structured request over many sites, each read under its own grant."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.idents import check_name, usable_credential
from wardlake.operators.scope import check_dates, check_departments, effective_dates

PREVIEW_ROWS = 100
# Rows a result brings to the driver unless told otherwise.
RESULT_ROWS = 10_000
# Whole numbers, narrow first.
WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Selection:
    grant_id: str
    departments: tuple[str, ...]
    date_start: str = ""
    date_end: str = ""


@dataclass(frozen=True)
class Request:
    requestor_id: str
    selections: tuple[Selection, ...]
    table: str = "checkups"
    columns: tuple[str, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Branch:
    """A selection that passed every check, ready to be read."""

    grant_id: str
    namespace: str
    departments: tuple[str, ...]
    date_start: date | None = None
    date_end: date | None = None


class AccessDenied(ValueError):
    """A request asks for more than its grants allow."""


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    row_count: int = field(default=0)
    cut: bool = False


def checked_limit(limit: int | None) -> int | None:
    """The limit asked for, none for all rows; one that is no number of rows is refused."""
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be positive, not {limit}")
    return limit


def grant_reason(status: Column, key: Column, expiration: Column, now: Column, found: Column) -> Column:
    """Why a grant cannot be used: not found, not approved, no key, expired; NULL if it can."""
    return (
        F.when(~found, F.lit("not found"))
        .when(status != "APPROVED", F.concat(F.lit("not approved: "), status))
        .when(F.coalesce(key, F.lit("")) == "", F.lit("no credentials"))
        .when(~usable_credential(key, expiration, now), F.lit("expired"))
    )


def resolve(asked: DataFrame, grants: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``asked`` (requestor_id, grant_id, …) with its grant and the first reason against it.

    What speaks against a grant itself is found before it moves. A grant without an id is
    nobody's; the join says so itself, so that grants are not filtered and, where the asked
    ones were made from them, are shuffled once for both.
    """
    usable = grant_reason(F.col("status"), F.col("access_key_id"), F.col("cred_expiration"), now, F.lit(True))
    owners = requests.select("request_id", F.col("requestor_id").alias("_owner"))
    owned = grants.withColumn("_against", usable).join(owners, "request_id").withColumnsRenamed({"grant_id": "_grant"})
    same = F.col("grant_id").isNotNull() & F.col("grant_id").eqNullSafe(F.col("_grant"))
    joined = asked.join(owned, same & (F.col("requestor_id") == F.col("_owner")), "left")
    reason = F.when(F.col("_owner").isNull(), F.lit("not found")).otherwise(F.col("_against"))
    return joined.withColumn("reason", reason).drop("_grant", "_owner", "_against")


def check_request(request: Request, grants: DataFrame, requests: DataFrame, now: Column) -> list[Branch]:
    """The request's branches, or `AccessDenied` with the first reason.

    Only the selected grants are fetched, one row per selection.
    """
    spark = grants.sparkSession
    if not request.selections:
        raise AccessDenied("no selection")
    if any(not s.departments for s in request.selections):
        raise AccessDenied("a selection needs a department")
    asked = spark.createDataFrame(
        [
            (i, request.requestor_id, s.grant_id, list(s.departments), s.date_start, s.date_end)
            for i, s in enumerate(request.selections)
        ],
        "position int, requestor_id string, grant_id string, asked_departments array<string>,"
        " asked_start string, asked_end string",
    )
    # The selected ids reach the scan of the grants; only their requests are looked up.
    selected = grants.filter(F.col("grant_id").isin(*{s.grant_id for s in request.selections}))
    resolved = resolve(asked, selected, requests, now)
    limits = (F.col("date_start"), F.col("date_end"))
    wanted = (F.col("asked_start"), F.col("asked_end"))
    start, end = effective_dates(*wanted, *limits)
    no_namespace = F.when(F.coalesce(F.col("namespace"), F.lit("")) == "", F.lit("no namespace"))
    checked = resolved.select(
        "position",
        "grant_id",
        "namespace",
        "asked_departments",
        start.alias("start"),
        end.alias("end"),
        F.coalesce(
            "reason",
            check_departments(F.col("asked_departments"), F.col("departments")),
            check_dates(*wanted, *limits),
            no_namespace,
        ).alias("reason"),
    )
    branches = []
    for row in sorted(checked.collect(), key=lambda r: r.position):
        if row.reason:
            raise AccessDenied(f"grant {row.grant_id}: {row.reason}")
        branches.append(Branch(row.grant_id, row.namespace, tuple(row.asked_departments), row.start, row.end))
    return branches


def read_branch(table: DataFrame, branch: Branch, columns: tuple[str, ...] = ()) -> DataFrame:
    """One site's rows under its grant: partition filters and a projection."""
    rows = table.filter(F.col("department_name").isin(*branch.departments))
    if branch.date_start is not None:
        rows = rows.filter(F.col("checkup_date") >= F.lit(branch.date_start))
    if branch.date_end is not None:
        rows = rows.filter(F.col("checkup_date") <= F.lit(branch.date_end))
    return rows.select(*columns) if columns else rows


def common_type(kinds: set[str]) -> str:
    """The type of a column over sites that give it ``kinds``.

    Whole numbers widen to the widest, with fractions to double; a date among
    times is a time; text gives way to the one other type there is. Anything else is text.
    """
    others = kinds - {"string"}
    if len(others) <= 1:
        return next(iter(others), "string")
    if others <= set(WHOLE):
        return max(others, key=WHOLE.index)
    if all(k in (*WHOLE, "float", "double") or k.startswith("decimal") for k in others):
        return "double"
    return "timestamp" if others == {"date", "timestamp"} else "string"


def union_sites(parts: Mapping[str, DataFrame], unfit: str = "unfit") -> DataFrame:
    """UNION ALL over sites whose columns and types may differ.

    A column that a site lacks is null there. A value that does not fit the
    column's common type is null, and ``unfit`` says so (null where all fit): no row is lost to it.
    """
    kinds: dict[str, set[str]] = {}
    for df in parts.values():
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    wanted = {name: common_type(found) for name, found in kinds.items()}

    def fitted(site: str, df: DataFrame) -> DataFrame:
        have, columns, reasons = dict(df.dtypes), [], []
        for name, kind in wanted.items():
            if name not in have:
                columns.append(F.lit(None).cast(kind).alias(name))
            elif have[name] == kind:
                columns.append(F.col(f"`{name}`"))
            else:
                value, text = F.col(f"`{name}`").try_cast(kind), F.col(f"`{name}`").cast("string")
                columns.append(value.alias(name))
                lost = F.col(f"`{name}`").isNotNull() & value.isNull()
                reasons.append(F.when(lost, F.concat(F.lit(f"{site}.{name} is no {kind}: "), text)))
        reason = F.nullif(F.concat_ws("; ", *reasons), F.lit("")) if reasons else F.lit(None).cast("string")
        return df.select(*columns, reason.alias(unfit))

    return reduce(DataFrame.unionByName, [fitted(site, df) for site, df in parts.items()])


def federate(
    branches: list[Branch],
    tables: Mapping[str, DataFrame],
    columns: tuple[str, ...] = (),
    limit: int | None = None,
    order_by: list[Column] | None = None,
) -> DataFrame:
    """UNION ALL of the branches, limited. Rows under two grants appear twice.

    ``limit=None`` keeps every row. Without ``order_by`` a limit gives any rows.
    """
    columns = tuple(check_name(c, "column") for c in columns)
    parts = [read_branch(tables[b.namespace], b, columns) for b in branches]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if order_by:
        union = union.orderBy(*order_by)
    limit = checked_limit(limit)
    return union if limit is None else union.limit(limit)


def run(request: Request, grants: DataFrame, requests: DataFrame, tables: Mapping, now: Column) -> DataFrame:
    check_name(request.table, "table")
    for name in request.columns:
        check_name(name, "column")
    branches = check_request(request, grants, requests, now)
    sites = {b.namespace: tables[b.namespace][request.table] for b in branches}
    return federate(branches, sites, request.columns, request.limit)


def preview(df: DataFrame) -> DataFrame:
    return df.limit(PREVIEW_ROWS)


def _value(held):
    """Binary as JSON where it is JSON, else as text; anything else as it is."""
    if not isinstance(held, bytes | bytearray):
        return held
    try:
        return json.loads(held)
    except ValueError:
        return held.decode(errors="replace")


def to_result(df: DataFrame, most: int = RESULT_ROWS) -> Result:
    """Columns and rows of a result; times as RFC 3339, binary as JSON or text.

    At most ``most`` rows come to the driver; ``cut`` says whether there are more.
    """

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(name) if kind.startswith("timestamp") else c

    kept = df.limit(most + 1).select(*[shown(n, t) for n, t in df.dtypes])
    rows = [[_value(v) for v in r] for r in kept.collect()]
    return Result(df.columns, rows[:most], min(len(rows), most), len(rows) > most)
