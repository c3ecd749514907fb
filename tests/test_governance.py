import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import governance, jobs, listing
from wardlake.operators.nest import nest
from wardlake.sources import browse
from wardlake.sources.denormalise import denormalise
from wardlake.streaming.throttle import _decide

A, R, P = "APPROVED", "REJECTED", "PENDING"


@pytest.mark.parametrize(
    "states, wanted",
    [
        ([A, A], "APPROVED"),
        ([R, R], "REJECTED"),
        ([A, R], "PARTIAL_APPROVED"),
        ([A, P], "PARTIAL_APPROVED"),
        ([A, R, P], "PARTIAL_APPROVED"),
        ([R, P], "FORWARDED"),
        ([P], "FORWARDED"),
        ([], "FORWARDED"),
        (["ODD"], "PARTIAL_APPROVED"),
    ],
)
def test_rolled_status(spark, states, wanted):
    requests = spark.createDataFrame([("r", "PENDING")], "request_id string, status string")
    responses = spark.createDataFrame([("r", s) for s in states], "request_id string, status string")
    row = governance.request_status(requests, responses).first()
    assert row.rolled_status == wanted
    assert row.total == len(states)


def test_sites(spark):
    sites = spark.createDataFrame(
        [(i, f"s{i}", s) for i, s in enumerate(["ACTIVE", "ACTIVE", "CREDENTIALS_ISSUED", "PENDING", "REJECTED"])],
        "hospital_id int, name string, status string",
    )
    assert tuple(governance.site_counts(sites).first()) == (5, 2, 1, 1)
    assert governance.listed_sites(sites).count() == 3
    assert governance.active_sites(sites).columns == ["hospital_id", "name", "status"]
    asked = spark.createDataFrame(
        [("a", [0, 1]), ("b", [0, 0]), ("c", [0, 2]), ("d", [0, 9]), ("e", []), ("f", [1])],
        "request_id string, requested_nodes array<int>",
    )
    got = {r.request_id: r.verdict for r in governance.check_requested_sites(asked, sites).collect()}
    assert got == {
        "a": "ok",
        "b": "site not active",
        "c": "site not active",
        "d": "site not active",
        "e": "no site requested",
        "f": "ok",
    }


def test_dashboard(spark):
    requests = spark.createDataFrame(
        [(i, "q", s) for i, s in enumerate([P, "FORWARDED", A, R, "PARTIAL_APPROVED"])],
        "request_id int, requestor_id string, status string",
    )
    now = dt.datetime(2024, 1, 1)
    later = now + dt.timedelta(seconds=1)
    rows = [(2, A, "K", None), (2, A, "K", later), (2, A, "K", now), (2, A, "", None), (2, A, None, None), (3, R, "K", None)]
    responses = spark.createDataFrame(rows, "request_id int, status string, access_key_id string, cred_expiration timestamp")
    row = governance.requestor_dashboard(requests, responses, F.lit(now)).first()
    assert tuple(row) == ("q", 5, 2, 1, 1, 1, 2)


def test_poll(spark):
    responses = spark.createDataFrame(
        [("r1", 7, P), ("r2", 7, A), ("gone", 7, P), ("r1", 8, P)], "request_id string, hospital_id int, status string"
    )
    requests = spark.createDataFrame(
        [("r1", "q1", "F"), ("r2", "q9", "F")], "request_id string, requestor_id string, status string"
    )
    people = spark.createDataFrame([("q1", "Ann")], "requestor_id string, name string")
    every = governance.node_poll(responses, requests, people, 7)
    assert {(r.request_id, r.status, r.name) for r in every.collect()} == {("r1", P, "Ann"), ("r2", A, None)}
    assert governance.node_poll(responses, requests, people, 7, P).count() == 1


def test_unseen(spark):
    central = spark.createDataFrame([("a",), ("b",)], "request_id string")
    stored = spark.createDataFrame([('{"request_id":"a"}',), ("broken",), (None,)], "request_payload string")
    assert [r.request_id for r in governance.unseen_requests(central, stored).collect()] == ["b"]


def test_listing(spark):
    df = spark.range(250).selectExpr("id", "if(id % 2 = 0, 'Even', null) name", "'X' status")
    assert listing.where_equal(df, status="", name=None).count() == 250
    assert listing.where_equal(df, name="Even").count() == 125
    assert listing.search(df, "EVE", ["name", "status"]).count() == 125
    assert listing.search(df, "  ", ["name"]).count() == 250
    assert listing.search(df, "24", ["id"]).count() == 13
    newest = [F.col("id").desc()]
    page = listing.page(df, newest, limit=999, offset=5).collect()
    assert [page[0].id, page[-1].id, len(page), page[0].total] == [244, 0, 245, 250]
    with pytest.raises(ValueError, match="limit 0"):
        listing.page(df, newest, limit=0)
    assert [r.id for r in listing.page(df, newest).collect()] == list(range(249, 229, -1))
    assert len(listing.recent(df, newest).collect()) == 5


def test_browse(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    browse.register({"some_table": df})
    assert spark.sql("SELECT b FROM some_table").first().b == "x"
    assert "some_table" in {r.table_name for r in browse.list_tables(spark).collect()}
    assert "default" in {r.schema_name for r in browse.list_schemas(spark).collect()}
    columns = browse.list_columns({"some_table": df}).orderBy("position").collect()
    assert [(r.column_name, r.data_type) for r in columns] == [("a", "int"), ("b", "string")]
    browse.export_json(spark.range(9), str(tmp_path / "out"), [F.col("id").desc()], 3)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == [6, 7, 8]
    with pytest.raises(ValueError):
        browse.register({"a b": df})


def test_nest_keeps_every_row_of_hot_keys(spark):
    rows = [("hot", i % 7, i) for i in range(500)] + [("copies", 1, 1)] * 300 + [("small", i, i) for i in range(5)]
    df = spark.createDataFrame(rows + [(None, 1, 1)], "k string, a int, b int").repartition(5)
    lists = nest(df, ["k"], F.struct("a", "b"), "items").collect()
    got = {r.k: [tuple(i) for i in r["items"]] for r in lists}
    assert len(lists) == 3
    assert got == {k: sorted((a, b) for key, a, b in rows if key == k) for k in ("hot", "copies", "small")}


def test_denormalise_keeps_one_row_per_checkup(spark):
    """However long its lists, a checkup is one row; checkups without a key stay, and no job runs while the plan is built."""

    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = {
        "checkups": frame(
            [(1, 1, 1, 1, False, "x"), (2, 2, 2, 2, False, "y"), (3, 3, 3, 3, True, "z")],
            "checkup_id int, appointment_id int, prescription_id int, recommendation_id int, is_draft boolean, notes string",
        ),
        "appointments": frame([(1, 1, 1), (2, 1, 9)], "appointment_id int, patient_id int, slot_id int"),
        "patients": frame([(1, 1, "A")], "patient_id int, user_id int, patient_address string"),
        "users": frame([(1, "MALE")], "user_id int, patient_gender string"),
        "slots": frame([(1, 1)], "slot_id int, schedule_id int"),
        "schedules": frame([(1, 1)], "schedule_id int, doctor_id int"),
        "doctors": frame([(1, 1)], "doctor_id int, department_id int"),
        "departments": frame([(1, "Cardiology")], "department_id int, department_name string"),
        "medications": frame(
            [(1, 1, f"{i} mg", 2, 3) for i in range(40)],
            "prescription_id int, drug_id int, dose_per_intake string, times_per_day int, total_days int",
        ),
        "drugs": frame([(1, "Drug")], "drug_id int, drug_name string"),
        "recommended_tests": frame([(1, i) for i in range(30)], "recommendation_id int, lab_test_id int"),
        "lab_tests": frame([(i, f"T{i}") for i in range(30)], "lab_test_id int, test_name string"),
    }
    import json

    tables["checkups"] = tables["checkups"].union(frame([(None, 1, None, None, False, "w")] * 2, tables["checkups"].schema))
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    plan = denormalise(tables)
    assert len(jobs.getJobIdsForGroup(None)) == before
    flat = plan.collect()
    assert sorted((r.checkup_id or 0) for r in flat) == [0, 0, 1, 2]
    assert {r.department_name for r in flat if r.checkup_id is None} == {"Cardiology"}
    flat = [r for r in flat if r.checkup_id]
    drugs = [m["dosage"] for r in flat if r.prescription for m in json.loads(r.prescription)]
    tests = [x["name"] for r in flat if r.test_recommendations for x in json.loads(r.test_recommendations)]
    assert sorted(drugs) == sorted(f"{i} mg" for i in range(40))
    assert sorted(tests) == sorted(f"T{i}" for i in range(30))
    assert {r.department_name for r in flat if r.checkup_id == 1} == {"Cardiology"}
    assert [r.patient_gender for r in flat if r.checkup_id == 1 and r.patient_gender] == ["MALE"]
    assert [r.notes for r in flat if r.notes] == ["x", "y"] or [r.notes for r in flat if r.notes] == ["y", "x"]
    assert [(r.department_name, r.prescription) for r in flat if r.checkup_id == 2] == [(None, None)]


def test_jobs(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("j", "completed", start, start + dt.timedelta(seconds=61), 5, 4, 1)]
    df = spark.createDataFrame(
        rows,
        "job_id string, status string, start_time timestamp, end_time timestamp, records_extracted int,"
        " records_validated int, records_failed int",
    )
    assert jobs.job_metrics(df).first().duration == "1m 1s"
    last = df.select(F.col("end_time").alias("last_run_end"))
    row = jobs.next_runs(last, F.lit(60), F.lit(start)).first()
    assert row.next_run_in_seconds == 121


def brute_throttle(times, window, limit):
    opened, count, out = None, 0, []
    for t in times:
        if opened is None or t - opened > window:
            opened, count = t, 1
            out.append((opened, True))
        elif count < limit:
            count += 1
            out.append((opened, True))
        else:
            out.append((opened, False))
    return out


def test_throttle_decisions():
    rng = np.random.default_rng(2)
    for trial in range(200):
        times = np.sort(rng.integers(0, 300, rng.integers(1, 60)))
        window, limit = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        wanted = brute_throttle(times.tolist(), window, limit)
        got, opened, passed = [], None, 0
        for piece in np.array_split(times, int(rng.integers(1, 5))):
            starts, allowed, opened, passed = _decide(piece, window, limit, opened, passed)
            got += list(zip(starts.tolist(), allowed.tolist()))
        assert got == wanted


def test_deep_pages(spark):
    rows = [(i, i % 3, "same") for i in range(900)] + [(None, 1, None)] * 5
    df = spark.createDataFrame(rows, "id int, bucket int, name string").repartition(5)
    newest = [F.col("bucket").desc(), F.col("id").asc_nulls_last()]
    whole = [tuple(r) for r in df.orderBy(*newest).collect()]
    for offset, limit in ((0, 20), (450, 50), (890, 100), (2000, 5)):
        page = listing.deep_page(df, newest, limit, offset).collect()
        assert [tuple(r)[:3] for r in page] == whole[offset : offset + limit]
        assert {r.total for r in page} <= {905}
    # All rows equal in the order: still every row on one page only.
    same = spark.createDataFrame([("x",)] * 300, "name string").withColumn("n", F.monotonically_increasing_id())
    assert listing.deep_page(same, [F.col("name")], 100, 150).count() == 100
    # Only rows of the page are sorted together: the sort before it is within the ranges.
    plan = listing.deep_page(df, newest, 20, 450)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "_rank" in plan


def test_profile(spark):
    tables = {"a": spark.createDataFrame([(1, None), (2, "x")], "id int, `odd name` string"), "b": spark.range(0)}
    got = {(r.table_name, r.column_name): (r.records, r.nulls) for r in browse.profile(tables).collect()}
    assert got == {("a", "id"): (2, 0), ("a", "odd name"): (2, 1), ("b", "id"): (0, 0)}
