import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlake.operators import federate
from wardlake.operators.federate import AccessDenied, Request, Selection
from wardlake.sources import browse

D = dt.date


def now():
    return F.to_timestamp(F.lit("2024-06-01 00:00:00"))


@pytest.fixture(scope="module")
def grants(spark):
    return spark.createDataFrame(
        [
            ("g1", "r1", "APPROVED", "K1", None, "alpha", ["X", "Y"], D(2024, 1, 1), D(2024, 1, 31)),
            ("g2", "r1", "APPROVED", "K2", None, "beta", ["X"], None, None),
            ("g3", "r1", "PENDING", "K3", None, "alpha", ["X"], None, None),
            ("g4", "r1", "APPROVED", "", None, "alpha", ["X"], None, None),
            ("g5", "r1", "APPROVED", "K5", dt.datetime(2024, 5, 1), "alpha", ["X"], None, None),
            ("g6", "r2", "APPROVED", "K6", None, "alpha", ["X"], None, None),
            ("g7", "r1", "APPROVED", "K7", None, None, ["X"], None, None),
        ],
        "grant_id string, request_id string, status string, access_key_id string, cred_expiration timestamp,"
        " namespace string, departments array<string>, date_start date, date_end date",
    )


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([("r1", "me"), ("r2", "you")], "request_id string, requestor_id string")


@pytest.fixture(scope="module")
def tables(spark):
    alpha = spark.createDataFrame(
        [(1, "X", D(2024, 1, 1)), (2, "Y", D(2024, 1, 31)), (3, "Z", D(2024, 1, 5)), (4, "X", D(2024, 2, 1))],
        "checkup_id int, department_name string, checkup_date date",
    )
    beta = spark.createDataFrame(
        [(10, "X", D(2020, 1, 1), "extra"), (11, "Y", D(2024, 1, 1), "extra")],
        "checkup_id int, department_name string, checkup_date date, note string",
    )
    return {"alpha": {"checkups": alpha}, "beta": {"checkups": beta}}


def ids(df):
    return sorted(r.checkup_id for r in df.collect())


def test_two_sites(grants, requests, tables):
    request = Request("me", (Selection("g1", ("X", "Y")), Selection("g2", ("X",))))
    rows = federate.run(request, grants, requests, tables, now())
    assert ids(rows) == [1, 2, 10]
    assert rows.columns == ["checkup_id", "department_name", "checkup_date", "note"]


def test_projection_and_narrower_range(grants, requests, tables):
    selection = Selection("g1", ("X", "Y"), "2024-01-02", "")
    rows = federate.run(Request("me", (selection,), columns=("checkup_id",)), grants, requests, tables, now())
    assert rows.columns == ["checkup_id"]
    assert ids(rows) == [2]


def test_overlapping_grants_repeat_rows(grants, requests, tables):
    request = Request("me", (Selection("g1", ("X",)), Selection("g1", ("X", "Y"))))
    assert ids(federate.run(request, grants, requests, tables, now())) == [1, 1, 2]


@pytest.mark.parametrize(
    "selection, reason",
    [
        (Selection("g0", ("X",)), "not found"),
        (Selection("g6", ("X",)), "not found"),
        (Selection("g3", ("X",)), "not approved: PENDING"),
        (Selection("g4", ("X",)), "no credentials"),
        (Selection("g5", ("X",)), "expired"),
        (Selection("g1", ("x",)), "department not approved: x"),
        (Selection("g1", ("X",), "2023-12-31"), "start before approved start"),
        (Selection("g1", ("X",), "", "2024-02-01"), "end after approved end"),
        (Selection("g2", ("X",), "yesterday"), "invalid date"),
        (Selection("g7", ("X",)), "no namespace"),
        (Selection("g1", ()), "needs a department"),
    ],
)
def test_refusals(grants, requests, tables, selection, reason):
    with pytest.raises(AccessDenied, match=reason):
        federate.run(Request("me", (selection,)), grants, requests, tables, now())


def test_bad_names(grants, requests, tables):
    for bad in (Request("me", (), table="a b"), Request("me", (), columns=("x; DROP",))):
        with pytest.raises(ValueError, match="invalid"):
            federate.run(bad, grants, requests, tables, now())
    with pytest.raises(AccessDenied, match="no selection"):
        federate.run(Request("me", ()), grants, requests, tables, now())


def test_limits():
    assert [federate.checked_limit(n) for n in (None, 1, 10_000, 10_001)] == [None, 1, 10_000, 10_001]
    for bad in (0, -1):
        with pytest.raises(ValueError, match="limit"):
            federate.checked_limit(bad)


def test_a_cut_result_says_so(spark):
    whole, cut = federate.to_result(spark.range(5), 5), federate.to_result(spark.range(6), 5)
    assert (whole.row_count, whole.cut, cut.row_count, cut.cut, len(cut.rows)) == (5, False, 5, True, 5)


def test_result(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 2), bytearray(b"x")), (2, None, bytearray(b'{"a":1}'))]
    df = spark.createDataFrame(rows, "i int, t timestamp, b binary")
    result = federate.to_result(df)
    assert result.columns == ["i", "t", "b"]
    assert result.rows == [[1, "2024-01-01T02:00:00Z", "x"], [2, None, {"a": 1}]]
    assert result.row_count == 2
    assert federate.preview(spark.range(500)).count() == 100


def test_filters_reach_the_partitions(spark, tmp_path, grants, requests):
    path = str(tmp_path / "site")
    rows = spark.createDataFrame(
        [(i, d, D(2024, 1, 1 + i % 28)) for i in range(60) for d in ("X", "Y")],
        "checkup_id int, department_name string, checkup_date date",
    )
    rows.write.partitionBy("department_name", "checkup_date").parquet(path)
    site = {"alpha": {"checkups": spark.read.parquet(path)}}
    request = Request("me", (Selection("g1", ("X",), "2024-01-03", "2024-01-04"),), columns=("checkup_id",))
    out = federate.run(request, grants, requests, site, now())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(department_name" in plan or "PartitionFilters: [isnotnull(checkup_date" in plan
    assert len(out.inputFiles()) >= 1
    assert {i % 28 for i in ids(out)} == {2, 3}


def test_common_types():
    kinds = {
        "bigint": {"int", "bigint"}, "double": {"int", "double"}, "date": {"date", "string"}, "timestamp": {"date", "timestamp", "string"},
        "string": {"date", "int"}, "int": {"int"},
    }
    assert all(federate.common_type(found) == wanted for wanted, found in kinds.items())
    assert federate.common_type({"decimal(10,2)", "int"}) == "double" and federate.common_type({"string"}) == "string"


def test_union_of_unequal_sites(spark):
    sites = {
        "a": spark.createDataFrame([(1, "2024-01-01"), (2, "soon"), (3, None)], "id int, `the day` string"),
        "b": spark.createDataFrame([(4_000_000_000, 1.5)], "id long, weight double"),
        "c": spark.sql("SELECT '7x' AS id, date'2024-02-02' AS `the day`, 'kg' AS weight"),
    }
    got = {tuple(str(v) for v in r) for r in federate.union_sites(sites).collect()}
    assert got == {
        ("1", "2024-01-01", "None", "None"),
        ("2", "None", "None", "a.the day is no date: soon"),
        ("3", "None", "None", "None"),
        ("4000000000", "None", "1.5", "None"),
        ("None", "2024-02-02", "None", "c.id is no bigint: 7x; c.weight is no double: kg"),
    }


def test_governed_sql_sees_only_granted_rows(spark, tmp_path):
    rows = [(i, "ns", "AB"[i % 2], f"2024-01-{1 + i:02d}") for i in range(6)]
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, "id int, namespace string, department_name string, day string").selectExpr(
        "id", "namespace", "department_name", "date(day) checkup_date"
    ).write.parquet(path)
    spark.createDataFrame([(1,)], "secret int").createOrReplaceTempView("hidden")

    def grants(own):
        return own.sql("SELECT 'g' grant_id, 'ns' namespace, array('A') departments, date'2024-01-02' date_start, cast(null AS date) date_end")

    own = browse.governed_session(spark, {"checkups": lambda s: s.read.parquet(path)}, grants)
    found = browse.governed_sql(own, "SELECT id FROM checkups WHERE id <= :most -- all", most=4)
    assert sorted(r.id for r in found.collect()) == [2, 4]
    for bad in ("SELECT * FROM hidden", f"SELECT * FROM parquet.`{path}`", "DROP VIEW checkups", "SELECT 1) UNION (SELECT"):
        with pytest.raises(Exception):
            browse.governed_sql(own, bad).collect()
    assert browse.governed_sql(own, "SELECT id FROM checkups WHERE department_name = :d", d="' OR true --").count() == 0
