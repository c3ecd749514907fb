"""Every operator as a query over the test tables: name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.catalogue import standins as S
from wardlake.functions import idents, text, times
from wardlake.functions.jsonlist import with_json_items
from wardlake.operators import federate, governance, jobs, listing, scope
from wardlake.operators.latest import latest
from wardlake.operators.nest import nest
from wardlake.plans import batch
from wardlake.plans.bundle import bundle_entries
from wardlake.plans.normalise import normalise, with_bundle
from wardlake.plans.validate import validate
from wardlake.session import delete_path, prepare, scratch_path
from wardlake.sources import browse, extract, ledger, publish
from wardlake.sources.denormalise import denormalise
from wardlake.streaming import ingest, sync
from wardlake.streaming import throttle as throttling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[S.Tables], DataFrame]) -> Callable:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(S.Tables(prepare(spark), folder))

    QUERIES[function.__name__] = run
    return run


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- ingest ----------------------------------------------------------------


@query
def extract_window(t):
    rows = extract.in_window(t.orders, "1996-03-01", "1998-03-01", "o_orderdate")
    return rows.select(
        F.col("o_orderkey").alias("checkup_id"), F.col("o_orderdate").cast("date").cast("string").alias("created_on")
    )


@query
def extract_slices(t):
    """A window read in eight slices of near equal rows, cut by a histogram of its days."""
    start, end = datetime(1996, 3, 1), datetime(1998, 3, 1)
    rows = extract.in_window(t.orders, start, end, "o_orderdate", include_start=True)
    edges = extract.equal_depth_edges(extract.window_histogram(rows, "o_orderdate"), 8)
    parts = extract.edge_predicates(start, end, edges, "o_orderdate", include_start=True)
    counted = [
        t.orders.where(part).agg(F.count("*").alias("records"), F.sum("o_orderkey").alias("id_sum")).withColumn("slice", F.lit(i).cast("long"))
        for i, part in enumerate(parts)
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def denormalize_checkups(t):
    return denormalise(S.clinic(t)).select(
        "checkup_id",
        "department_name",
        "patient_gender",
        "patient_allergies",
        "blood_pressure",
        F.col("patient_dob").cast("date").cast("string").alias("dob"),
        F.col("checkup_created_at").cast("date").cast("string").alias("created_on"),
        "prescription",
        "test_recommendations",
    )


@query
def normalize_department(t):
    k = F.col("o_orderkey")
    padded = F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))
    raw = t.orders.select(
        k.alias("checkup_id"),
        S.by_remainder(k, 6, {0: None, 1: "", 2: "   "}, padded).alias("department_name"),
        S.by_remainder(k, 4, {0: "MALE ", 1: " Female", 2: ""}).alias("patient_gender"),
        F.concat(F.lit(" \t"), "o_orderstatus", F.lit("  ")).alias("diagnosis"),
    )
    tidy = text.with_department(text.trim_text_columns(raw))
    return tidy.withColumn("gender_code", text.gender_code(F.col("patient_gender")))


# --- text, JSON, time ------------------------------------------------------


@query
def split_items(t):
    items = t.documents.select("doc_id", text.split_items(F.col("text")).alias("items"))
    return items.select("doc_id", long(F.size("items")).alias("n_items"), text.summary(F.col("items")).alias("summary"))


@query
def parse_json_items(t):
    k = F.col("l_partkey")
    size = F.col("l_quantity").cast("long")
    described = F.to_json(
        F.array(
            F.struct(
                F.col("p_name").alias("name"),
                F.when(k % 3 == 0, S.joined(size, "mg")).alias("dosage"),
                F.when(k % 3 == 1, size).alias("dose"),
                F.when(k % 2 == 0, F.lit("BD")).alias("frequency"),
                F.when(k % 5 == 0, F.lit("")).otherwise(S.joined(F.col("l_linenumber"), " days")).alias("duration"),
                F.when(k % 7 == 0, F.col("p_type")).alias("reason"),
            )
        )
    )
    odd = {
        8: F.to_json(F.array("p_name", "p_brand")),
        9: S.joined(" ", F.col("p_name"), " ;", F.col("p_brand"), ", "),
        10: F.to_json(F.struct("p_name")),
        11: F.lit("null"),
        12: F.lit(None).cast("string"),
    }
    raw = t.lineitem.join(t.part, k == F.col("p_partkey")).select(S.by_remainder(k, 13, odd, described).alias("raw"))
    texts = raw.groupBy("raw").agg(F.count("*").alias("copies"))
    lists = with_json_items(texts, {"raw": "list"}).select(text.summary(F.col("list")).alias("items"), "copies")
    return lists.groupBy("items").agg(F.sum("copies").alias("n"))


@query
def parse_json_objects(t):
    """Event properties are JSON objects, not lists, so every list is empty."""
    items = with_json_items(t.events, {"props": "list"}).select("event_type", F.size("list").alias("n"))
    return items.groupBy("event_type").agg(F.count("*").alias("events"), long(F.sum("n")).alias("items"))


@query
def parse_blood_pressure(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    raw = S.by_remainder(
        k,
        8,
        {
            0: S.joined(100 + size, "/", 60 + size),
            1: S.joined(" ", 100 + size, " \\ ", 40 + size, "\n"),
            2: S.joined(1000 + size, "/", size),
            3: F.col("p_brand"),
            4: S.joined(size, "/", size),
            5: "  ",
            6: None,
        },
        S.joined(90 + size, " /", 50 + size, " mmHg"),
    )
    read = t.part.select(k.alias("part_id"), text.blood_pressure(raw).alias("bp"))
    return read.select("part_id", "bp.systolic", "bp.diastolic", "bp.original")


@query
def iso_timestamps(t):
    stamped = t.events.select(
        "event_id",
        times.iso_timestamp(F.col("ts")).alias("iso"),
        times.birth_date(F.col("ts")).alias("day"),
        S.by_remainder(
            F.col("event_id"),
            6,
            {
                0: F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                1: F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
                2: F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                3: F.date_format("ts", "yyyy-MM-dd"),
                4: F.date_format("ts", "dd/MM/yyyy"),
            },
        ).alias("spelled"),
    )
    return stamped.withColumn("checkup_date", times.any_date(F.col("spelled")).cast("string"))


@query
def iso_dates(t):
    day = F.col("o_orderdate")
    return t.orders.groupBy(times.iso_timestamp(day).alias("iso"), times.birth_date(day).alias("day")).agg(
        F.count("*").alias("n")
    )


# --- bundles ---------------------------------------------------------------


@query
def normalize_lists(t):
    """Every list column of the normalised checkups, as totals per department."""
    lists = normalise(denormalise(S.clinic(t)))
    names = ("prescription_list", "test_list", "symptom_list", "diagnosis_list", "note_list")
    parsed = F.count_if(F.col("bp_parsed").contains("systolic")).alias("bp_parsed")
    return lists.groupBy("department_name").agg(
        F.count("*").alias("checkups"), parsed, *[long(F.sum(F.size(n))).alias(n) for n in names]
    )


@query
def bundle_resource_counts(t):
    bundles = with_bundle(denormalise(S.clinic(t))).select("fhir_bundle_json")
    resources = bundle_entries(bundles, fields={"status": "status", "text": "code.text"})
    final = (F.col("resource_type") == "Observation") & (F.col("status") == "final")
    labelled = resources.select("resource_type", "status", F.when(final, F.col("text")).alias("label"))
    return labelled.groupBy("resource_type", "status", "label").agg(F.count("*").alias("resources"))


@query
def bundle_ids(t):
    return t.orders.select(
        F.col("o_orderkey").alias("checkup_id"), idents.bundle_id(F.col("o_orderkey"), "v2").alias("bundle_id")
    )


def _defective(t, source=lambda rows: rows):
    """Bundles of all checkups, some of them broken by the remainder of their key."""
    k, bundle = F.col("checkup_id"), F.col("fhir_bundle_json")
    broken = S.by_remainder(
        k,
        11,
        {
            0: None,
            1: F.concat(bundle, F.lit("]")),
            2: F.replace(bundle, F.lit('"resourceType":"Patient"'), F.lit('"resourceType":"Alien"')),
            3: F.replace(bundle, F.lit('"status":"completed",'), F.lit("")),
            4: "[]",
            5: F.replace(bundle, F.lit('"status":"completed"'), F.lit('"status":""')),
        },
        bundle,
    )
    return with_bundle(source(denormalise(S.clinic(t)))).withColumn("fhir_bundle_json", broken)


@query
def validate_split(t):
    checked = validate(_defective(t), S.now())
    return checked.groupBy("fhir_validation_status", "validation_error", "validated_at").agg(
        F.count("*").alias("records")
    )


def _needs_temperature():
    """A checker of the caller's: it raises for bundles without a temperature."""
    import json

    def check(bundle: str) -> None:
        names = [e["resource"].get("code", {}).get("text") for e in json.loads(bundle)["entry"]]
        if "Temperature" not in names:
            raise ValueError("no temperature")

    return check


@query
def validator_hook(t):
    # Only what is checked goes to Python and back.
    bundles = _defective(t).select("checkup_id", "fhir_bundle_json")
    checked = validate(bundles, S.now(), checker=_needs_temperature)
    return checked.groupBy("fhir_validation_status", "validation_error").agg(F.count("*").alias("records"))


# --- publishing ------------------------------------------------------------


def _in_period(rows):
    return rows.withColumn("checkup_created_at", S.folded(F.col("checkup_created_at")).cast("timestamp"))


def _dealt_in_period(rows):
    """The rows as they are, dealt by the day that `_in_period` will give them."""
    day = S.folded(F.col("checkup_created_at"))
    return publish.clustered(rows.withColumn("_folded", day), "_folded").drop("_folded")


@query
def publish_partitions(t):
    root = scratch_path(t.spark, "publish")
    checked = validate(_in_period(_defective(t, _dealt_in_period)), S.now())
    batch.run_batch(checked, root, "b1", "1995-01-01", "2002-01-01", S.now(), checked=True, dealt=True)
    published = [
        publish.read_table(t.spark, f"{root}/{name}").withColumn("table_name", F.lit(name))
        for name in (publish.TABLE, publish.ERROR_TABLE)
    ]
    both = published[0].unionByName(published[1], allowMissingColumns=True)
    return both.groupBy(
        "table_name",
        "department_name",
        F.col("checkup_date").cast("string").alias("checkup_date"),
        "batch_id",
        "batch_start_ts",
        "batch_end_ts",
        F.col("ingest_date").cast("string").alias("ingest_date"),
    ).agg(F.count("*").alias("records"))


@query
def upsert_latest(t):
    newest = latest(S.versions(t), ["checkup_id"], S.newest_version())
    return newest.withColumns(
        {c: F.col(c).cast("string") for c in ("checkup_date", "updated_on")} | {"line": long("line")}
    )


@query
def upsert_table(t):
    """Versions merged in three batches into a partitioned table."""
    path = scratch_path(t.spark, "upsert-table")
    rows = S.versions(t)
    for flag in ("N", "A", "R"):
        publish.upsert(rows.filter(F.col("flag") == flag), path, f"batch-{flag}", ["checkup_id"], S.newest_version())
    table = publish.read_table(t.spark, path, rows.schema)
    return table.groupBy("department_name", F.col("checkup_date").cast("string").alias("checkup_date")).agg(
        F.count("*").alias("records"), F.sum("checkup_id").alias("id_sum"), F.sum("part_id").alias("part_sum")
    )


@query
def stream_publish(t):
    """The same merge, by a stream over files that arrive one after another."""
    arrivals, path, checkpoint = (scratch_path(t.spark, n) for n in ("arrivals", "stream-table", "checkpoint"))
    rows = S.versions(t)
    for flag in ("N", "A", "R"):
        rows.filter(F.col("flag") == flag).write.mode("append").parquet(arrivals)
        stream = ingest.arriving(t.spark, arrivals, rows.schema)
        ingest.stream_upsert(stream, path, checkpoint, ["checkup_id"], S.newest_version())
    table = publish.read_table(t.spark, path, rows.schema)
    return table.groupBy("department_name", F.col("checkup_date").cast("string").alias("checkup_date")).agg(
        F.count("*").alias("records"), F.sum("checkup_id").alias("id_sum"), F.sum("part_id").alias("part_sum")
    )


# --- federated reads -------------------------------------------------------


def _usable_grants(t):
    return S.grants(t).filter(
        (F.col("status") == governance.APPROVED)
        & idents.usable_credential(F.col("access_key_id"), F.col("cred_expiration"), S.now())
    )


def _request(t, columns: tuple[str, ...]) -> tuple[list[federate.Branch], dict[str, DataFrame]]:
    """One request over three sites, each under its site's first usable grant."""
    names = ("africa", "asia", "europe")
    first = (
        _usable_grants(t)
        .filter(F.col("namespace").isin(*names))
        .groupBy("namespace")
        .agg(F.min_by(F.struct("grant_id", "departments"), "k").alias("grant"))
        .select("grant.*")
    )
    selections = [
        federate.Selection(row.grant_id, tuple(row.departments), "1995-06-01", "2000-06-30") for row in first.collect()
    ]
    open_ended = {"date_start": F.lit(None).cast("date"), "date_end": F.lit(None).cast("date")}
    held = S.grants(t).drop("requestor_id").withColumns(open_ended)
    owners = held.select("request_id", F.lit("asker").alias("requestor_id"))
    asked = federate.Request("asker", tuple(selections), columns=columns)
    rows = S.checkups(t)
    sites = {n: rows.filter(F.col("namespace") == n) for n in names}
    return federate.check_request(asked, held, owners, S.now()), sites


@query
def federated_select(t):
    columns = ("checkup_id", "department_name", "checkup_date", "namespace", "patient_id")
    branches, tables = _request(t, columns)
    rows = federate.federate(branches, tables, columns, limit=None)
    return rows.withColumn("checkup_date", F.col("checkup_date").cast("string"))


@query
def federated_unequal(t):
    """Three sites: ids as text (some unreadable) in one, times for dates in another, a column more or less."""
    rows = S.checkups(t)
    site = {name: rows.where(F.col("namespace") == name) for name in ("africa", "asia", "europe")}
    patient = F.col("patient_id")
    site["asia"] = site["asia"].withColumn("patient_id", F.when(patient % 7 == 0, S.joined("P-", patient)).otherwise(S.text(patient)))
    site["europe"] = site["europe"].drop("department_name").withColumns(
        {"checkup_date": F.col("checkup_date").cast("timestamp"), "patient_id": patient.cast("int"), "ward": F.lit("w1")}
    )
    union = federate.union_sites(site)
    return union.select("checkup_id", "namespace", "department_name", "patient_id", "ward", "unfit", F.col("checkup_date").cast("string"))


@query
def federated_topk(t):
    columns = ("checkup_id", "department_name", "checkup_date")
    branches, tables = _request(t, columns)
    order = [F.col("checkup_date").desc(), F.col("checkup_id").desc()]
    rows = federate.federate(branches, tables, columns, limit=10_001, order_by=order)
    return rows.withColumn("checkup_date", F.col("checkup_date").cast("string"))


# --- scope -----------------------------------------------------------------


@query
def grant_checks(t):
    """Every grant against a request made from its own key."""
    k = F.col("k")
    shifted = F.date_add("date_start", (k % 9).cast("int") - 2).cast("string")
    start = S.by_remainder(k, 8, {0: "", 1: "1995-13-01", 2: "1995/01/01"}, shifted)
    end = S.by_remainder(k, 5, {0: "", 1: "tomorrow"}, F.date_add("date_end", (k % 4).cast("int") - 2).cast("string"))
    names = F.array(*[F.lit(d) for d in S.DEPARTMENTS])
    asked = S.by_remainder(
        k,
        4,
        {0: F.col("departments"), 1: F.array(F.lower(F.get("departments", F.lit(0)))), 2: F.slice("departments", 1, 1)},
        names,
    )
    limits = (F.col("date_start"), F.col("date_end"))
    return S.grants(t).select(
        "grant_id",
        scope.check_departments(asked, F.col("departments")).alias("department_reason"),
        scope.check_dates(start, end, *limits).alias("date_reason"),
        scope.range_error(start, end).alias("range_reason"),
        *[
            d.cast("string").alias(n)
            for n, d in zip(("effective_start", "effective_end"), scope.effective_dates(start, end, *limits))
        ],
    )


@query
def scope_days(t):
    days = scope.expand_days(S.grants(t), "long_start", "long_end")
    return days.select("grant_id", F.col("day").cast("string").alias("day"), "reason")


@query
def scope_patterns(t):
    ends = F.col("long_start"), F.col("long_end")
    reason = scope.range_problem(*ends).alias("reason")
    return S.grants(t).select("grant_id", F.explode_outer(scope.range_patterns(*ends)).alias("pattern"), reason)


@query
def scope_day_patterns(t):
    """Days granted to each requestor by any grant, collapsed together."""
    days = scope.expand_days(S.grants(t), "long_start", "long_end")
    refused = days.where("day IS NULL").select("requestor_id", F.lit(None).cast("string").alias("pattern"), "grant_id", "reason")
    patterns = scope.collapse_days(days, ["requestor_id"])
    none = F.lit(None).cast("string")
    return patterns.select("requestor_id", "pattern", none.alias("grant_id"), none.alias("reason")).union(refused)


@query
def scope_policy(t):
    patterns = scope.range_patterns(F.col("long_start"), F.col("long_end"))
    policy = scope.policy_json(
        F.lit("hospital-data"), F.col("namespace"), ["checkups"], F.col("departments"), patterns
    )
    reason = scope.range_problem(F.col("long_start"), F.col("long_end"))
    built = S.grants(t).withColumn("policy", F.when(reason.isNull(), policy))
    return built.select(
        "grant_id",
        long(F.octet_length("policy")).alias("bytes"),
        F.sha2("policy", 256).alias("policy_hash"),
        F.coalesce(reason, scope.policy_verdict(F.col("policy"))).alias("verdict"),
    )


@query
def scope_enforce(t):
    readable = scope.enforce(S.checkups(t), _usable_grants(t))
    return readable.select("checkup_id", "namespace", "department_name", F.col("checkup_date").cast("string"))


@query
def scope_coverage(t):
    """How many usable grants cover each partition that holds rows."""
    covered = scope.covered_partitions(S.checkups(t), _usable_grants(t))
    return covered.withColumn("checkup_date", F.col("checkup_date").cast("string"))


@query
def path_attribution(t):
    k = F.col("o_orderkey")
    held = S.grants(t).select(F.col("k").alias("c"), "namespace", "access_key_id")
    key = F.when(k % 5 == 0, F.lit("NOKEY")).when(k % 5 == 1, F.lower("access_key_id")).otherwise(F.col("access_key_id"))
    site = F.when(k % 7 == 0, F.col("namespace")).otherwise(F.concat("namespace", F.lit("::"), key))
    file = S.joined("/checkups/data/department_name=", F.col("o_orderpriority"), "/part-", k, ".parquet")
    place = F.when(k % 9 == 0, F.concat(F.lit("hospital-data/other/"), site, file)).otherwise(
        F.concat(F.lit("hospital-data/iceberg/"), site, file)
    )
    paths = t.orders.join(held, F.col("o_custkey") == F.col("c")).select(k.alias("checkup_id"), place.alias("path"))
    found = scope.attribute_paths(paths, S.grants(t), S.now())
    location = idents.public_location(F.concat(F.lit("s3a://"), "path"))
    return found.select(
        "checkup_id", "bucket", "object", "namespace", "access_key_id", "grant_id", "verdict", location.alias("location")
    )


@query
def grants_resolve(t):
    """Every requestor asks for every response of their own requests and one of the next order's."""
    held = S.responses(t).repartition("request_id")  # for the distinct rows and both joins with requests
    parents = S.requests(t).select("request_id", "requestor_id")
    line = S.joined(
        F.col("request_id"), "-", F.col("line"), "-", F.col("part_id"), "-", F.col("hospital_id"), "-", F.col("status")
    )
    grants = held.select(
        line.alias("grant_id"), "request_id", "status", "access_key_id", "cred_expiration", "hospital_id"
    ).distinct()
    owner = F.when(F.col("hospital_id") % 9 == 0, F.col("requestor_id") + 1).otherwise(F.col("requestor_id"))
    asked = grants.join(parents, "request_id").select("grant_id", owner.alias("requestor_id"))
    resolved = federate.resolve(asked, grants, parents, S.now())
    return resolved.groupBy("grant_id", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("n")
    )


# --- governance ------------------------------------------------------------


@query
def request_status_rollup(t):
    rolled = governance.request_status(S.requests(t), S.responses(t))
    return rolled.select("request_id", "status", "rolled_status", "approved", "rejected", "pending", "total")


@query
def response_tallies(t):
    return governance.response_tallies(S.responses(t))


@query
def response_lists(t):
    item = F.struct(
        F.col("hospital_id").alias("hospital"), "status", F.col("responded_on").cast("string").alias("on"), "line", "part_id"
    )
    lists = governance.responses_per_request(S.requests(t), S.responses(t), item)
    return lists.select(
        "request_id", long(F.coalesce(F.size("responses"), F.lit(0))).alias("n"), F.to_json("responses").alias("responses")
    )


@query
def hospital_status_counts(t):
    return governance.site_counts(S.hospitals(t))


@query
def listed_hospitals(t):
    active = governance.active_sites(S.hospitals(t)).select("hospital_id", F.lit(True).alias("active"))
    return governance.listed_sites(S.hospitals(t)).join(active, "hospital_id", "left").select(
        "hospital_id", "name", "status", F.coalesce("active", F.lit(False)).alias("active")
    )


@query
def node_request_counters(t):
    return governance.status_counters(S.requests(t))


@query
def requestor_dashboard(t):
    return governance.requestor_dashboard(S.requests(t), S.responses(t), S.now())


@query
def node_poll(t):
    polled = governance.node_poll(S.responses(t), S.requests(t), S.requestors(t), 7, "PENDING")
    return polled.select(
        "request_id",
        "requestor_id",
        "status",
        F.array_join("departments", "|").alias("departments"),
        F.col("created_at").cast("date").cast("string").alias("created_on"),
        "name",
        "email",
        "organization",
    )


@query
def sync_new_requests(t):
    payload = F.to_json(F.struct(S.text(F.col("l_orderkey")).alias("request_id"), F.col("l_linestatus").alias("s")))
    stored = t.lineitem.filter(F.col("l_returnflag") != "N").select(payload.alias("request_payload"))
    fresh = governance.unseen_requests(S.requests(t), stored)
    return fresh.select("request_id", "requestor_id", "status")


@query
def active_nodes_check(t):
    asked = (
        t.lineitem.groupBy(F.col("l_orderkey").alias("request_id"))
        .agg(F.sort_array(F.collect_set(F.col("l_suppkey"))).alias("ids"))
        .withColumn(
            "requested_nodes",
            F.when(F.col("request_id") % 6 == 0, F.slice("ids", 1, 1))
            .when(F.col("request_id") % 6 == 1, F.concat(F.slice("ids", 1, 1), F.slice("ids", 1, 1)))
            .when(F.col("request_id") % 6 == 2, F.array().cast("array<bigint>"))
            .when(F.col("request_id") % 6 == 3, F.concat(F.slice("ids", 1, 1), F.array(F.lit(-1).cast("long"))))
            .otherwise(F.col("ids")),
        )
    )
    checked = governance.check_requested_sites(asked, S.hospitals(t))
    return checked.select("request_id", "asked_sites", "active_sites", "verdict")


@query
def search_requests(t):
    rows = governance.decorate(S.requests(t), S.requestors(t), "requestor_id")
    found = listing.search(rows, "bUILd", ["requestor_id", "email", "name", "organization", "status"])
    return found.select("request_id", "requestor_id", "name", "organization", "status")


@query
def search_hospitals(t):
    return listing.search(S.hospitals(t), "ACT", ["name", "status"]).select("hospital_id", "name", "status")


@query
def list_page(t):
    rows = listing.where_equal(S.requests(t), status="FORWARDED", requestor_id="")
    newest = [F.col("created_at").desc(), F.col("request_id").desc()]
    page = listing.page(rows, newest, limit=200, offset=40)
    return page.select("request_id", "status", F.col("created_at").cast("date").cast("string").alias("created_on"), "total")


@query
def list_deep_page(t):
    """A page that begins in the middle of all requests."""
    rows = S.requests(t)
    newest = [F.col("created_at").desc(), F.col("request_id").desc()]
    page = listing.deep_page(rows, newest, limit=200, offset=rows.count() // 2)
    return page.select("request_id", "status", F.col("created_at").cast("date").cast("string").alias("created_on"), "total")


@query
def recent_requests(t):
    newest = [F.col("created_at").desc(), F.col("request_id").desc()]
    return listing.recent(S.requests(t), newest).select("request_id", "status")


@query
def audit_page(t):
    log = t.events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("action"),
        S.joined("user-", F.col("user_id")).alias("actor_id"),
        F.col("ts").alias("created_at"),
    )
    rows = listing.where_equal(log, action="purchase", actor_id=None)
    page = listing.page(rows, [F.col("created_at").desc(), F.col("id").desc()], limit=listing.MESSAGE_PAGE_SIZE)
    shown = page.withColumn("created_at", times.iso_timestamp(F.col("created_at")))
    return browse.as_json(shown.select("id", "action", "actor_id", "created_at", "total"), "entry")


@query
def expiry_status(t):
    created = F.col("created_at")
    days = F.col("request_id") % 45 - 5
    expires = times.request_expiry(created, days)
    held = times.grant_valid_until(created, F.col("status"), F.col("request_id") % 72 - 8)
    rows = S.requests(t).select(
        "request_id",
        expires.cast("date").cast("string").alias("expires_on"),
        times.effective_status(F.col("status"), expires, S.now()).alias("status"),
        times.iso_timestamp(held).alias("valid_until"),
    )
    return rows


@query
def next_runs(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("last_run_end"))
    frequency = F.col("user_id") % 24 * 3600 + 60
    due = jobs.next_runs(last, frequency, F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return due.select("user_id", times.iso_timestamp(F.col("next_run")).alias("next_run"), "next_run_in_seconds")


@query
def job_metrics(t):
    e = F.col("event_id")
    begin = F.col("ts").cast("timestamp")
    took = F.make_dt_interval(secs=((e * 37) % 400000).cast("decimal(18,6)") / 1000)
    history = t.events.select(
        e.alias("job_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.when(e % 19 != 0, begin).alias("start_time"),
        F.when(e % 17 != 0, begin + took).alias("end_time"),
        (e % 1000).alias("records_extracted"),
        (e % 1000 - e % 7).alias("records_validated"),
        (e % 7).alias("records_failed"),
    )
    return jobs.job_metrics(history)


@query
def mask_keys(t):
    key = F.col("access_key_id")
    return S.responses(t).groupBy(text.mask_key(key).alias("masked"), text.truncate(key, 8).alias("shortened")).agg(
        F.count("*").alias("n")
    )


@query
def stringify_rows(t):
    rows = S.grants(t).select("k", "departments", "date_start", "status")
    return text.stringify(rows)


@query
def stream_sync(t):
    """Ten polls, of which each brings again what the one before brought; every event is stored once."""
    arrivals, store, checkpoint = (scratch_path(t.spark, n) for n in ("arrivals", "store", "checkpoint"))
    rows = t.events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("requestor_id"), "event_type")
    for poll in range(10):
        brought = rows.where((F.col("request_id") % 10 == poll) | (F.col("request_id") % 10 == poll - 1))
        brought.write.mode("append").parquet(arrivals)
        sync.stream_sync(ingest.arriving(t.spark, arrivals, rows.schema), store, checkpoint)
    kept = t.spark.read.parquet(store)
    return kept.select("request_id", "status", "request_type", "request_payload")


def _throttled(t, events):
    """At most five events per user in six hours, over events that arrive in four stretches of time."""
    arrivals, verdicts, checkpoint = (scratch_path(t.spark, n) for n in ("arrivals", "verdicts", "checkpoint"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * i / 4 for i in range(1, 4)]
    for low, high in zip([None, *edges], [*edges, None]):
        stretch = events if low is None else events.filter(F.col("ts") >= F.lit(low))
        stretch = stretch if high is None else stretch.filter(F.col("ts") < F.lit(high))
        stretch.write.mode("append").parquet(arrivals)
        stream = ingest.arriving(t.spark, arrivals, events.schema)
        throttling.throttle_available(stream, verdicts, checkpoint, "user_id", "ts", "event_id", 6 * 3600, 5)
    schema = "key long, ident long, opened long, allowed boolean, epoch int"
    return (
        t.spark.read.schema(schema)
        .parquet(verdicts)
        .groupBy(F.col("key").alias("user_id"))
        .agg(
            F.count("*").alias("events"),
            F.count_if("allowed").alias("passed"),
            F.count_distinct("opened").alias("windows"),
            F.sum(F.when(F.col("allowed"), F.col("ident"))).alias("passed_ids"),
        )
    )


@query
def throttle(t):
    return _throttled(t, t.events)


@query
def throttle_hot_user(t):
    """The same where one user has a third of all events."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id"))
    return _throttled(t, t.events.withColumn("user_id", user))


@query
def catalog_columns(t):
    """Columns of the tables, with the rows each table holds."""
    names = ("orders", "lineitem", "customer", "events", "documents")
    columns = browse.list_columns({n: getattr(t, n) for n in names})
    counts = [getattr(t, n).agg(F.count("*").alias("records")).withColumn("table_name", F.lit(n)) for n in names]
    rows = columns.join(reduce(DataFrame.unionByName, counts), "table_name")
    return rows.select("table_name", long("position").alias("position"), "column_name", "records")


@query
def nested_medications(t):
    """Every order's lines as one list."""
    item = F.struct("l_partkey", "l_suppkey", "l_linenumber")
    lists = nest(t.lineitem, ["l_orderkey"], item, "items")
    sizes = lists.groupBy("l_orderkey").agg(
        long(F.sum(F.size("items"))).alias("items"),
        long(F.sum(F.expr("aggregate(items, 0L, (a, i) -> a + i.l_partkey)"))).alias("part_sum"),
        F.max(
            F.expr("array_join(transform(sort_array(items), i -> concat_ws('-', i.l_partkey, i.l_suppkey, i.l_linenumber)), ',')")
        ).alias("lines"),
    )
    return sizes


# --- staging, browsing, results ----------------------------------------------


@query
def stage_windows(t):
    """Two windows of the source staged as files; the one without rows writes none."""
    held = []
    for name, start, end in (("filled", "1996-03-01", "1998-03-01"), ("empty", "1900-01-01", "1900-02-01")):
        rows = extract.in_window(t.orders, start, end, "o_orderdate")
        path = extract.stage(rows, scratch_path(t.spark, "stage"))
        staged = rows.limit(0) if path is None else t.spark.read.parquet(path)
        held.append(
            staged.agg(F.count("*").alias("records"), F.sum("o_orderkey").alias("id_sum")).select(
                F.lit(name).alias("window"), F.lit(path is not None).alias("written"), "records", "id_sum"
            )
        )
    return reduce(DataFrame.unionByName, held)


@query
def sql_views(t):
    """An ad-hoc query over tables registered by name."""
    browse.register({"orders": t.orders, "customer": t.customer})
    return t.spark.sql(
        "SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT c_custkey) AS customers "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
    )


@query
def sql_governed(t):
    """Free SQL of one requestor with a bound parameter, over views that hold only the rows granted to them."""
    asking = "q4"
    own = browse.governed_session(
        t.spark,
        {"checkups": lambda spark: S.checkups(S.Tables(spark, t.folder))},
        lambda spark: _usable_grants(S.Tables(spark, t.folder)).where(F.col("requestor_id") == asking),
    )
    return browse.governed_sql(
        own,
        "SELECT namespace, department_name, count(*) AS checkups, sum(checkup_id) AS id_sum FROM checkups"
        " WHERE checkup_date >= :since GROUP BY namespace, department_name",
        since="1996-01-01",
    )


@query
def browse_tables(t):
    """Registered tables with their columns, the rows they hold and how many values are missing."""
    names = ("orders", "customer", "nation")
    browse.register({n: getattr(t, n) for n in names})
    listed = browse.list_tables(t.spark).where(F.col("table_name").isin(*names)).select("table_name").distinct()
    counted = browse.profile({n: t.spark.table(n) for n in names})
    in_default = browse.list_schemas(t.spark).where("schema_name = 'default'").agg(F.count("*").alias("n"))
    return listed.join(counted, "table_name").withColumn("schemas", in_default.scalar())


@query
def audit_export(t):
    """The newest entries of an audit log as JSON lines, read back."""
    path = scratch_path(t.spark, "audit")
    log = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), "ts")
    browse.export_json(log, path, [F.col("ts").desc(), F.col("id").desc()], 500)
    lines = t.spark.read.schema("id long, action string").json(path)
    return lines.groupBy("action").agg(F.count("*").alias("entries"), F.sum("id").alias("id_sum"))


@query
def preview_rows(t):
    newest = S.checkups(t).orderBy(F.col("checkup_date").desc(), F.col("checkup_id").desc())
    return federate.preview(newest).select("checkup_id", "department_name", F.col("checkup_date").cast("string"))


@query
def result_rows(t):
    """A result as the caller gets it: bounded rows, and whether there were more."""
    rows = t.orders.orderBy("o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderdate")
    result = federate.to_result(rows, 50)
    out = t.spark.createDataFrame([tuple(r) for r in result.rows], "o_orderkey long, o_orderstatus string, ordered_at string")
    return out.withColumns({"row_count": F.lit(result.row_count).cast("long"), "cut": F.lit(result.cut)})


def _some_unreadable(t):
    """Checkups whose creation times are texts, a part of them unreadable."""
    k = F.col("checkup_id")
    created = F.when(k % 5 == 0, F.concat(F.lit("day "), k.cast("string"))).otherwise(
        F.date_format("checkup_created_at", "yyyy-MM-dd HH:mm:ss")
    )
    return _in_period(denormalise(S.clinic(t))).withColumn("checkup_created_at", created)


def _both_tables(t, root, *columns):
    published = [
        publish.read_table(t.spark, f"{root}/{name}").select(*columns, F.lit(name).alias("table_name"))
        for name in (publish.TABLE, publish.ERROR_TABLE)
    ]
    return published[0].unionByName(published[1])


@query
def unreadable_times(t):
    """A whole run over them."""
    root = scratch_path(t.spark, "texts")
    batch.run_batch(_some_unreadable(t), root, "b1", "", "", S.now())
    both = _both_tables(t, root, "checkup_id")
    return both.groupBy("table_name").agg(F.count("*").alias("records"), F.sum("checkup_id").alias("id_sum"))


@query
def stream_checkups(t):
    """Raw checkups that arrive in three parts, and the last of them once more after its commit is lost.

    One row per run of the job history, with what the two tables hold of it.
    """
    arrivals, root, checkpoint = (scratch_path(t.spark, n) for n in ("arrivals", "lake", "checkpoint"))
    rows = _some_unreadable(t)
    whole = scratch_path(t.spark, "whole")
    rows.write.parquet(whole)
    raw = t.spark.read.schema(rows.schema).parquet(whole)
    for part in range(3):
        raw.where(F.col("checkup_id") % 3 == part).write.mode("append").parquet(arrivals)
        ingest.stream_checkups(ingest.arriving(t.spark, arrivals, rows.schema), root, checkpoint, "clinic")
    delete_path(t.spark, whole)
    delete_path(t.spark, f"{checkpoint}/commits/2")
    ingest.stream_checkups(ingest.arriving(t.spark, arrivals, rows.schema), root, checkpoint, "clinic")
    stored = _both_tables(t, root, "checkup_id", "batch_id").groupBy("batch_id").agg(
        F.count("*").alias("stored"), F.sum("checkup_id").alias("id_sum")
    )
    runs = ledger.history(t.spark, f"{root}/{ledger.RUNS}")
    return runs.join(stored, F.col("job_id") == F.col("batch_id")).select(
        F.regexp_extract("job_id", r"(\d+)$", 1).cast("long").alias("run"),
        "source",
        "status",
        "window_start",
        "window_end",
        "records_extracted",
        "records_validated",
        "records_failed",
        "stored",
        "id_sum",
    )


@query
def windowed_runs(t):
    """Three runs of one source, each from where the one before ended, as the job history has them."""
    root = scratch_path(t.spark, "lake")
    rows = _in_period(denormalise(S.clinic(t)))
    days = [datetime(1998, 1, 8), datetime(1998, 1, 8), datetime(1998, 1, 20), datetime(1998, 2, 1)]
    for now in days:  # the second finds nothing to do
        batch.run_next(rows, root, "clinic", now, datetime(1998, 1, 1))
    runs = ledger.history(t.spark, f"{root}/{ledger.RUNS}")
    shown = jobs.job_metrics(runs).where(F.col("duration").rlike(r"^(\d+m )?\d+s$"))
    due = ledger.schedule(runs, F.lit(3600), F.col("last_run_end")).select("source", "next_run_in_seconds")
    stored = publish.read_table(t.spark, f"{root}/{publish.TABLE}").groupBy("batch_id").agg(F.count("*").alias("stored"))
    return (
        shown.join(runs.select("job_id", "source", "window_start", "window_end"), "job_id")
        .join(stored, F.col("job_id") == F.col("batch_id"))
        .join(due, "source")
        .select(
            "window_start", "window_end", "status", "records_extracted", "records_validated", "records_failed", "stored",
            "next_run_in_seconds",
        )
    )


@query
def moved_dates(t):
    """Versions whose department and date both change: the key stays once, where its newest version puts it."""
    path = scratch_path(t.spark, "moved")
    rows = S.versions(t)
    late = F.col("checkup_id") % 2 == 0
    shifted = rows.withColumns(
        {
            "checkup_date": F.when(late, F.date_add("checkup_date", 1)).otherwise(F.col("checkup_date")),
            "line": F.col("line") + 100,
        }
    )
    for name, part in (("first", rows), ("corrected", shifted)):
        publish.upsert(part, path, name, ["checkup_id"], S.newest_version())
    table = publish.read_table(t.spark, path, rows.schema)
    return table.groupBy(F.col("checkup_date").cast("string").alias("checkup_date")).agg(
        F.count("*").alias("records"), F.count_distinct("checkup_id").alias("checkups"), F.sum("line").alias("lines")
    )


@query
def compact_partitions(t):
    """Rows appended three times, then every department and day packed into one file."""
    path = scratch_path(t.spark, "packed")
    rows = S.versions(t)
    for flag in ("N", "A", "R"):
        publish.write_table(rows.filter(F.col("flag") == flag), path)
    publish.compact(t.spark, path, rows.schema)
    table = publish.read_table(t.spark, path, rows.schema)
    held = table.groupBy("department_name", "checkup_date").agg(F.count("*").alias("records"), F.sum("checkup_id").alias("id_sum"))
    return held.join(publish.file_sizes(table), ["department_name", "checkup_date"]).select(
        "department_name", F.col("checkup_date").cast("string").alias("checkup_date"), "records", "id_sum", "files"
    )
