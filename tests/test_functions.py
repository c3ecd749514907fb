import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlake.functions import idents, text, times
from wardlake.functions.jsonlist import with_json_items


def values(spark, rows, kind, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", make(F.col("x"))).collect(), key=lambda r: r[0])]


def test_split_items(spark):
    given = {
        None: [],
        "": [],
        "  ": [],
        ",;,": [],
        "a; b,c|d\ne": ["a", "b", "c", "d", "e"],
        "one\r\ntwo": ["one", "two"],
        "158/95, LVH": ["158/95", "LVH"],
        " x ;\ty ": ["x", "y"],
    }
    assert values(spark, list(given), "string", text.split_items) == list(given.values())


def test_blood_pressure(spark):
    given = {
        "158/95": ("158", "95", "158/95"),
        " 120 \\ 80 ": ("120", "80", "120 \\ 80"),
        "1200/80": (None, None, "1200/80"),
        "120/8": (None, None, "120/8"),
        "high": (None, None, "high"),
        "": None,
        " ": None,
        None: None,
    }
    got = values(spark, list(given), "string", text.blood_pressure)
    assert [r and tuple(r) for r in got] == list(given.values())


def test_department_default(spark):
    got = values(spark, ["Cardiology", "", None], "string", text.department_or_default)
    assert got == ["Cardiology", "unassigned", "unassigned"]
    df = text.with_department(spark.createDataFrame([(1,)], "i int"))
    assert df.first().department_name == "unassigned"


JSON_ITEMS = {
    '[{"name":"A","dosage":"5mg","frequency":"BD","duration":"5d","reason":"bp"}]': ["A 5mg BD 5d (bp)"],
    '[{"medication":"B","dose":"1"}]': ["B 1"],
    '[{"testName":"CBC"}]': ["CBC"],
    '[{"foo":1}]': ['{"foo":1}'],
    '["plain ", 7]': ["plain ", "7"],
    '[{"name":"","drug":"D","dose":0,"frequency":false}]': ["D"],
    '[{"name":"0","dosage":"05 mg","duration":0.5}]': ["0 05 mg 0.5"],
    '[{"name":"true","dosage":true,"reason":[]}]': ["true True"],
    '[{"name":["x"]}]': ['["x"]'],
    "[true, null, 2.5]": ["True", "2.5"],
    '"[\\"x\\", {\\"drug\\": \\"y\\"}]"': ["x", "y"],
    '"a; b"': ["a", "b"],
    '{"name":"A"}': [],
    "7": [],
    "true": [],
    "null": [],
    "": [],
    "  ": [],
    None: [],
    "[]": [],
    "Panadol, Brufen": ["Panadol", "Brufen"],
    "7 days": ["7 days"],
    "500 mg; twice": ["500 mg", "twice"],
    "[1] and more": ["[1] and more"],
    '{"a":1,"a":2}': [],
    "[{}]": ["{}"],
}


def test_json_items(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(JSON_ITEMS)], "i int, x string")
    got = with_json_items(df, {"x": "items"}).orderBy("i").collect()
    assert {r.x: r["items"] for r in got} == JSON_ITEMS


def test_iso_timestamp(spark):
    rows = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120), None]
    got = values(spark, rows, "timestamp", times.iso_timestamp)
    assert got[2] is None
    assert got[0] == "2024-01-02T03:04:05+00:00"
    assert got[1] == "2024-01-02T03:04:05.000120+00:00"


def test_dates(spark):
    given = {
        "2024-02-29 10:11:12.123456": "2024-02-29",
        "2024-02-29 10:11:12.123": "2024-02-29",
        "2024-02-29 10:11:12": "2024-02-29",
        "2024-02-29": "2024-02-29",
        "2023-02-29": None,
        "soon": None,
        None: None,
    }
    got = values(spark, list(given), "string", times.any_date)
    assert [d and str(d) for d in got] == list(given.values())
    born = values(spark, ["1990-05-01", "1990-05-01 10:00:00", "1990-05-01?!", ""], "string", lambda c: times.birth_date(c, "string"))
    assert born == ["1990-05-01", "1990-05-01", "1990-05-01", None]


def test_duration_label(spark):
    begin = dt.datetime(2024, 1, 1)
    rows = [
        (0, begin, begin + dt.timedelta(seconds=42)),
        (1, begin, begin + dt.timedelta(seconds=185)),
        (2, begin, None),
        (3, None, begin),
        (4, begin, begin + dt.timedelta(seconds=59.5)),
    ]
    df = spark.createDataFrame(rows, "i int, a timestamp, b timestamp")
    got = df.orderBy("i").select(times.duration_label(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["42s", "3m 5s", "In progress…", "N/A", "1m 0s"]


def test_deadlines(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    row = spark.range(1).select(
        times.request_expiry(now, F.lit(0)).alias("standard"),
        times.request_expiry(now, F.lit(7)).alias("week"),
        times.grant_valid_until(now, F.lit("APPROVED"), F.lit(5)).alias("held"),
        times.grant_valid_until(now, F.lit("REJECTED"), F.lit(5)).alias("refused"),
        times.effective_status(F.lit("PENDING"), now, now + F.make_dt_interval(days=F.lit(1))).alias("status"),
        times.next_run(now, F.lit(90)).alias("next"),
    ).first()
    assert (row.standard.month, row.standard.day) == (1, 31)
    assert row.week.day == 8
    assert row.held.hour == 5
    assert row.refused is None
    assert row.status == "EXPIRED"
    assert (row.next.minute, row.next.second) == (1, 30)


@pytest.mark.parametrize(
    "qualified, namespace, key",
    [("ns::KEY", "ns", "KEY"), ("ns", "ns", ""), ("a::b::c", "a", "b::c"), ("::k", "", "k"), ("", "", ""), ("ns::", "ns", "")],
)
def test_namespace_and_key(spark, qualified, namespace, key):
    c = F.lit(qualified)
    row = spark.range(1).select(idents.namespace_of(c), idents.access_key_of(c)).first()
    assert tuple(row) == (namespace, key)


@pytest.mark.parametrize(
    "path, namespace",
    [
        ("hospital-data/iceberg/ns::K/checkups/data/x", "ns::K"),
        ("iceberg/ns/table", "ns"),
        ("bucket/other/ns", ""),
        ("bucket/iceberg", ""),
        ("iceberg/iceberg/x", "iceberg"),
        ("", ""),
    ],
)
def test_path_namespace(spark, path, namespace):
    assert spark.range(1).select(idents.path_namespace(F.lit(path))).first()[0] == namespace


def test_credentials(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = [("K", "S", None), ("", "S", None), ("K", "", None), (None, "S", None), ("K", "S", dt.datetime(2024, 1, 1)), ("K", "S", dt.datetime(2023, 12, 31))]
    df = spark.createDataFrame(rows, "k string, s string, e timestamp")
    got = df.select(idents.usable_credential(F.col("k"), F.col("e"), now, F.col("s"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False]


def test_names():
    for good in ("checkups", "_x", "a1_b"):
        assert idents.check_name(good, "table") == good
    for bad in ("1a", "a b", "a'; DROP TABLE x", 'a"', "", "a.b", "a\n"):
        with pytest.raises(ValueError):
            idents.check_name(bad, "table")


def test_mask_and_truncate(spark):
    got = values(spark, ["ABCDEFGHIJKLMNOP", "AB"], "string", text.mask_key)
    assert got == ["ABCDEF" + "•" * 12 + "MNOP", "AB" + "•" * 12 + "AB"]
    assert values(spark, ["abcdef", "ab"], "string", lambda c: text.truncate(c, 3)) == ["abc", "ab"]


def test_stringify(spark):
    df = spark.createDataFrame([(1, ["a", "b"], dt.date(2024, 1, 2), "t", None)], "i int, l array<string>, d date, s string, n long")
    out = text.stringify(df, keep=("d",))
    assert [t for _, t in out.dtypes] == ["string", "string", "date", "string", "string"]
    assert tuple(out.first()) == ("1", '["a","b"]', dt.date(2024, 1, 2), "t", None)


def test_json_text_is_unwrapped_until_it_is_no_string(spark):
    import json

    from wardlake.functions.jsonlist import with_json_items

    texts, wanted = [], []
    for depth in range(7):
        text = json.dumps(["a", "b"])
        for _ in range(depth):
            text = json.dumps(text)
        texts.append((depth, text))
        wanted.append((depth, ["a", "b"]))
    texts += [(90, '""'), (91, '"x, y"'), (92, json.dumps('"x')), (93, '"'), (94, None)]
    wanted += [(90, []), (91, ["x", "y"]), (92, ['"x']), (93, ['"']), (94, [])]
    rows = with_json_items(spark.createDataFrame(texts, "i int, t string"), {"t": "items"}).collect()
    assert sorted((r.i, r["items"]) for r in rows) == wanted


def test_a_text_that_is_no_time_stays(spark):
    from wardlake.functions.times import iso_timestamp

    rows = spark.createDataFrame([("not a date",), ("2024-01-02 03:04:05",), (None,)], "t string")
    got = [r[0] for r in rows.select(iso_timestamp(F.col("t"))).collect()]
    assert got == ["not a date", "2024-01-02T03:04:05+00:00", None]


def test_run_batch_survives_unreadable_times(spark, tmp_path):
    from wardlake.plans.batch import run_batch

    schema = "checkup_id int, checkup_created_at string, checkup_updated_at string, department_name string, notes string"
    rows = [(1, "2024-01-02 03:04:05", None, "A", "n"), (2, "not a date", "nor this", "A", "n"), (None, "2024-01-02", None, "A", "n")]
    run = run_batch(spark.createDataFrame(rows, schema), str(tmp_path / "lake"), "b", "", "")
    assert (run.records_extracted, run.records_failed) == (3, 2)
