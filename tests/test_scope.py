import calendar
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from wardlake.operators import scope


def days_of(start, end):
    return [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]


def matches(pattern, day):
    return str(day).startswith(pattern[:-1]) if pattern.endswith("*") else str(day) == pattern


def range_patterns(spark, ranges):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, s date, e date")
    got = df.select("i", scope.range_patterns(F.col("s"), F.col("e")).alias("p")).orderBy("i").collect()
    return [r.p for r in got]


D = dt.date


@pytest.mark.parametrize(
    "start, end, wanted",
    [
        (D(2025, 1, 1), D(2025, 1, 31), ["2025-01-*"]),
        (D(2024, 2, 1), D(2024, 2, 29), ["2024-02-*"]),
        (D(2025, 2, 1), D(2025, 2, 28), ["2025-02-*"]),
        (D(2025, 1, 1), D(2025, 12, 31), ["2025-*"]),
        (D(2024, 12, 30), D(2025, 1, 2), ["2024-12-30", "2024-12-31", "2025-01-01", "2025-01-02"]),
        (D(2025, 3, 5), D(2025, 3, 5), ["2025-03-05"]),
        (D(2025, 1, 2), D(2025, 1, 1), None),
        (D(2023, 12, 1), D(2026, 1, 31), ["2023-12-*", "2024-*", "2025-*", "2026-01-*"]),
    ],
)
def test_range_patterns(spark, start, end, wanted):
    assert range_patterns(spark, [(start, end)]) == [wanted]


def test_almost_complete_months_stay_days(spark):
    short, leap, year = range_patterns(
        spark,
        [
            (D(2025, 1, 1), D(2025, 1, 28)),
            (D(2024, 2, 1), D(2024, 2, 28)),
            (D(2025, 1, 1), D(2025, 12, 20)),
        ],
    )
    assert len(short) == len(leap) == 28
    assert year == [f"2025-{m:02d}-*" for m in range(1, 12)] + [f"2025-12-{d:02d}" for d in range(1, 21)]


def test_patterns_cover_exactly_the_granted_days(spark):
    """Both ways of collapsing, against brute force, on random ranges."""
    rng = random.Random(5)
    ranges = []
    for _ in range(60):
        start = D(2019, 1, 1) + dt.timedelta(days=rng.randrange(1500))
        ranges.append((start, start + dt.timedelta(days=rng.choice([0, 3, 27, 30, 31, 59, 364, 365, 366, 800]))))
    by_range = range_patterns(spark, ranges)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, date_start date, date_end date")
    listed = scope.expand_days(df)
    repeated = listed.unionByName(listed)
    by_days = {}
    for row in scope.collapse_days(repeated, ["i"]).collect():
        by_days.setdefault(row.i, []).append(row.pattern)
    for i, (start, end) in enumerate(ranges):
        assert sorted(by_range[i]) == sorted(by_days[i])
        granted = set(days_of(start, end))
        around = days_of(start - dt.timedelta(days=400), end + dt.timedelta(days=400))
        assert {d for d in around if any(matches(p, d) for p in by_range[i])} == granted


def test_day_counts(spark):
    ranges = [(D(2024, 2, 27), D(2024, 3, 1)), (D(2023, 2, 27), D(2023, 3, 1)), (D(2024, 1, 1), D(2024, 12, 31))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "i int, date_start date, date_end date")
    counts = {r.i: r["count"] for r in scope.expand_days(df).groupBy("i").count().collect()}
    assert counts == {0: 4, 1: 3, 2: 366}
    assert calendar.isleap(2024)


@pytest.mark.parametrize(
    "start, end, reason",
    [
        ("2025-01-01", "2025-01-31", None),
        ("2025-01-01", "2025-01-01", None),
        ("2025-13-01", "2025-01-31", "invalid start date"),
        ("2025/01/01", "2025-01-31", "invalid start date"),
        ("", "2025-01-31", "invalid start date"),
        ("2025-01-01", "2025-02-30", "invalid end date"),
        ("2025-01-02", "2025-01-01", "end date before start date"),
    ],
)
def test_range_error(spark, start, end, reason):
    assert spark.range(1).select(scope.range_error(F.lit(start), F.lit(end))).first()[0] == reason


@pytest.mark.parametrize(
    "requested, approved, reason",
    [
        (["Cardiology"], ["Cardiology", "Neurology"], None),
        (["Cardiology", "Neurology"], ["Cardiology", "Neurology"], None),
        ([], ["Cardiology"], None),
        (["cardiology"], ["Cardiology"], "department not approved: cardiology"),
        (["Cardiology", "X", "Y"], ["Cardiology"], "department not approved: X"),
        (["X"], [], "department not approved: X"),
    ],
)
def test_departments(spark, requested, approved, reason):
    df = spark.createDataFrame([(requested, approved)], "r array<string>, a array<string>")
    assert df.select(scope.check_departments(F.col("r"), F.col("a"))).first()[0] == reason


@pytest.mark.parametrize(
    "start, end, low, high, reason",
    [
        ("2025-02-01", "2025-02-10", "2025-01-01", "2025-12-31", None),
        ("2025-01-01", "2025-12-31", "2025-01-01", "2025-12-31", None),
        ("2024-12-31", "2025-02-10", "2025-01-01", "2025-12-31", "start before approved start"),
        ("2025-02-01", "2026-01-01", "2025-01-01", "2025-12-31", "end after approved end"),
        ("2025-2-1", "2025-02-10", "2025-01-01", "2025-12-31", "invalid date"),
        ("2025-02-01' OR 1=1", "2025-02-10", None, None, "invalid date"),
        ("", "", "2025-01-01", "2025-12-31", None),
        ("1999-01-01", "2099-01-01", None, None, None),
        ("1999-01-01", "2025-05-01", None, "2025-12-31", None),
    ],
)
def test_dates(spark, start, end, low, high, reason):
    df = spark.createDataFrame([(start, end, low, high)], "s string, e string, low string, high string")
    low_col, high_col = F.col("low").cast("date"), F.col("high").cast("date")
    assert df.select(scope.check_dates(F.col("s"), F.col("e"), low_col, high_col)).first()[0] == reason


def test_policy(spark):
    df = spark.createDataFrame(
        [(1, ["Cardiology", 'A "quoted" <unit>'], ["2025-*"]), (2, ["Cardiology"], [f"2025-01-{d:02d}" for d in range(1, 29)])],
        "i int, departments array<string>, patterns array<string>",
    )
    policy = scope.policy_json(F.lit("b"), F.lit("ns"), ["checkups"], F.col("departments"), F.col("patterns"))
    rows = df.withColumn("p", policy).withColumn("verdict", scope.policy_verdict(F.col("p"))).orderBy("i").collect()
    first = json.loads(rows[0].p)
    assert first["Version"] == "2012-10-17"
    assert [s["Sid"] for s in first["Statement"]] == ["AllowListMetadata", "AllowGetMetadata", "AllowSpecificPartitions"]
    assert first["Statement"][0]["Condition"]["StringLike"]["s3:prefix"] == [
        "iceberg/ns/checkups/metadata/*",
        "iceberg/ns/checkups/data/*",
    ]
    assert first["Statement"][2]["Resource"] == [
        "arn:aws:s3:::b/iceberg/ns/checkups/data/department_name=Cardiology/checkup_date=2025-*/*",
        'arn:aws:s3:::b/iceberg/ns/checkups/data/department_name=A "quoted" <unit>/checkup_date=2025-*/*',
    ]
    assert "<" not in rows[0].p
    assert [r.verdict for r in rows] == ["ok", "policy_too_large"]
    assert len(json.loads(rows[1].p)["Statement"][2]["Resource"]) == 28


def test_policy_of_several_tables(spark):
    departments, patterns = F.array(F.lit("A")), F.array(F.lit("2025-*"))
    text = scope.policy_json(F.lit("b"), F.lit("n"), ["checkups", "checkups_errors"], departments, patterns)
    policy = json.loads(spark.range(1).select(text).first()[0])
    assert len(policy["Statement"][1]["Resource"]) == 2
    assert len(policy["Statement"][2]["Resource"]) == 2


def test_enforcement_against_brute_force(spark):
    rng = random.Random(3)
    names, units = ["a", "b"], ["X", "Y", "Z"]
    first = D(2024, 1, 1)
    rows = [
        (i, rng.choice(names), rng.choice(units), first + dt.timedelta(days=rng.randrange(60))) for i in range(400)
    ]
    grants = []
    for i in range(25):
        start = first + dt.timedelta(days=rng.randrange(60))
        end = start + dt.timedelta(days=rng.randrange(-3, 8))
        grants.append(
            (
                i,
                rng.choice(names),
                rng.sample(units, rng.choice([1, 2])) + ["X"] * (i % 2),
                None if i == 3 else start,
                None if i == 4 else end,
            )
        )
    checkups = spark.createDataFrame(rows, "id int, namespace string, department_name string, checkup_date date")
    table = spark.createDataFrame(
        grants, "grant_id int, namespace string, departments array<string>, date_start date, date_end date"
    )

    def covering(row):
        _, site, unit, day = row
        return [
            g
            for g in grants
            if g[1] == site and unit in g[2] and (g[3] is None or g[3] <= day) and (g[4] is None or day <= g[4])
        ]

    assert {r.id for r in scope.enforce(checkups, table).collect()} == {r[0] for r in rows if covering(r)}
    counts = {
        (r.namespace, r.department_name, r.checkup_date): r.grants_in_force
        for r in scope.covered_partitions(checkups, table).collect()
    }
    assert counts == {r[1:]: len(covering(r)) for r in rows if covering(r)}


def test_enforcement_skips_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, "a", d, D(2024, 1, 1 + i % 5)) for i, d in enumerate("XYZ" * 20)]
    schema = "id int, namespace string, department_name string, checkup_date date"
    spark.createDataFrame(rows, schema).write.partitionBy("department_name", "checkup_date").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    grants = spark.createDataFrame(
        [("a", ["X"], D(2024, 1, 2), D(2024, 1, 3))],
        "namespace string, departments array<string>, date_start date, date_end date",
    )
    out = scope.enforce(table, grants)
    assert {r.id for r in out.collect()} == {r[0] for r in rows if r[2] == "X" and r[3].day in (2, 3)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "BroadcastHashJoin" in plan


def test_paths(spark):
    grants = spark.createDataFrame(
        [
            ("g2", "ns", "KEY", "APPROVED", None),
            ("g1", "ns", "KEY", "APPROVED", None),
            ("g3", "ns", "OLD", "APPROVED", dt.datetime(2020, 1, 1)),
            ("g4", "ns", "NO", "REJECTED", None),
        ],
        "grant_id string, namespace string, access_key_id string, status string, cred_expiration timestamp",
    )
    paths = spark.createDataFrame(
        [("b/iceberg/ns::key/t/f",), ("b/iceberg/ns::OLD/t",), ("b/iceberg/ns::NO/t",), ("b/iceberg/ns/t",), ("b",)],
        "path string",
    )
    found = scope.attribute_paths(paths, grants, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    got = {r.path: (r.bucket, r.object, r.namespace, r.access_key_id, r.grant_id, r.verdict) for r in found.collect()}
    assert got == {
        "b/iceberg/ns::key/t/f": ("b", "iceberg/ns::key/t/f", "ns", "KEY", "g1", "ALLOWED"),
        "b/iceberg/ns::OLD/t": ("b", "iceberg/ns::OLD/t", "ns", "OLD", None, "FORBIDDEN"),
        "b/iceberg/ns::NO/t": ("b", "iceberg/ns::NO/t", "ns", "NO", None, "FORBIDDEN"),
        "b/iceberg/ns/t": ("b", "iceberg/ns/t", "ns", "", None, "FORBIDDEN"),
        "b": ("b", "", "", "", None, "FORBIDDEN"),
    }
