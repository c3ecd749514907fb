"""Registry tables: requests, responses, sites, requestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.idents import usable_credential
from wardlake.operators.nest import nest

# The states a response, a request and a site can be in.
PENDING, APPROVED, REJECTED = "PENDING", "APPROVED", "REJECTED"
FORWARDED, PARTIAL = "FORWARDED", "PARTIAL_APPROVED"
ACTIVE, CREDENTIALS_ISSUED = "ACTIVE", "CREDENTIALS_ISSUED"
LISTED_SITE_STATES = (CREDENTIALS_ISSUED, ACTIVE)
SITE_LIST_COLUMNS = ("hospital_id", "name", "admin_email", "status", "created_at")


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def response_tallies(responses: DataFrame) -> DataFrame:
    status = F.col("status")
    return responses.groupBy("request_id").agg(
        _count(status == APPROVED, "approved"),
        _count(status == REJECTED, "rejected"),
        _count(status == PENDING, "pending"),
        F.count("*").alias("total"),
    )


def request_status(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with its tallies and the status they imply (forwarded when none)."""
    counts = ("approved", "rejected", "pending", "total")
    joined = requests.join(response_tallies(responses), "request_id", "left").fillna(0, list(counts))
    approved, rejected, pending, total = (F.col(c) for c in counts)
    rolled = (
        F.when(total == 0, F.lit(FORWARDED))
        .when((pending == 0) & (approved == total), F.lit(APPROVED))
        .when((pending == 0) & (rejected == total), F.lit(REJECTED))
        .when((pending == 0) | (approved > 0), F.lit(PARTIAL))
        .otherwise(F.lit(FORWARDED))
    )
    return joined.withColumn("rolled_status", rolled)


def responses_per_request(requests: DataFrame, responses: DataFrame, item: Column) -> DataFrame:
    """Each request, once, with the list of its responses."""
    return requests.join(nest(responses, ["request_id"], item, "responses"), "request_id", "left")


def site_counts(sites: DataFrame) -> DataFrame:
    status = F.col("status")
    return sites.agg(
        F.count("*").alias("total"),
        _count(status == ACTIVE, "active"),
        _count(status == CREDENTIALS_ISSUED, "credentials_issued"),
        _count(status == PENDING, "pending"),
    )


def listed_sites(sites: DataFrame) -> DataFrame:
    return sites.filter(F.col("status").isin(*LISTED_SITE_STATES))


def active_sites(sites: DataFrame) -> DataFrame:
    return sites.filter(F.col("status") == ACTIVE).select(*[c for c in SITE_LIST_COLUMNS if c in sites.columns])


def status_counters(requests: DataFrame, status: str = "status") -> DataFrame:
    """All, pending, approved and rejected requests of one node."""
    state = F.lower(F.col(status))
    return requests.agg(
        F.count("*").alias("all"),
        _count(state == "pending", "pending"),
        _count(state == "approved", "approved"),
        _count(state == "rejected", "rejected"),
    )


def requestor_dashboard(requests: DataFrame, responses: DataFrame, now: Column) -> DataFrame:
    """Per requestor: requests by status and credentials still usable."""
    key, expiration = F.col("access_key_id"), F.col("cred_expiration")
    usable = (F.col("status") == APPROVED) & (key != "") & (expiration.isNull() | (expiration > now))
    live = responses.filter(usable).groupBy("request_id").agg(F.count("*").alias("live"))
    status = F.col("status")
    return (
        requests.join(live, "request_id", "left")
        .groupBy("requestor_id")
        .agg(
            F.count("*").alias("total"),
            _count(status.isin(PENDING, FORWARDED), "pending"),
            _count(status == APPROVED, "approved"),
            _count(status == REJECTED, "rejected"),
            _count(status == PARTIAL, "partial_approved"),
            F.coalesce(F.sum("live"), F.lit(0)).alias("active_credentials"),
        )
    )


def decorate(rows: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Many-to-one lookup of names; rows without a match keep NULLs."""
    return rows.join(lookup, on, "left")


def node_poll(
    responses: DataFrame, requests: DataFrame, requestors: DataFrame, hospital_id, status: str = ""
) -> DataFrame:
    """What one site is asked for: its responses, their requests, who asks."""
    mine = responses.filter(F.col("hospital_id") == F.lit(hospital_id))
    if status:
        mine = mine.filter(F.col("status") == status)
    parents = requests.drop("status")
    return mine.select("request_id", "status").join(parents, "request_id").join(requestors, "requestor_id", "left")


def unseen_requests(central: DataFrame, stored: DataFrame, payload: str = "request_payload") -> DataFrame:
    """Central requests whose id is in no stored payload."""
    known = stored.select(F.get_json_object(payload, "$.request_id").alias("request_id"))
    return central.join(known, central["request_id"].cast("string") == known["request_id"], "left_anti")


def check_requested_sites(requests: DataFrame, sites: DataFrame, ids: str = "requested_nodes") -> DataFrame:
    """Accept a request only when each listed site is active and listed once."""
    active = sites.filter(F.col("status") == ACTIVE).select(F.col("hospital_id").alias("_site"))
    found = (
        requests.select("request_id", F.explode(F.array_distinct(ids)).alias("_site"))
        .join(active, "_site", "left_semi")
        .groupBy("request_id")
        .agg(F.count("*").alias("active_sites"))
    )
    asked = F.size(ids)
    verdict = (
        F.when(asked == 0, F.lit("no site requested"))
        .when(F.col("active_sites") == asked, F.lit("ok"))
        .otherwise(F.lit("site not active"))
    )
    return (
        requests.join(found, "request_id", "left")
        .fillna(0, ["active_sites"])
        .withColumns({"asked_sites": asked.cast("long"), "verdict": verdict})
    )
