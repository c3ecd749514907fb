"""The library's tables built from the TPC-H-like test tables.

Each function has a twin in ``oracles.py`` that builds the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The departments of the stand-in checkups, in order, and the
# moment that counts as now.
DEPARTMENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NOW = "1999-01-01 00:00:00"
# The test dates spread a few thousand rows over some 2,400 days. Folded into the
# days of one period they fill a department and day with as many rows as a
# real one has at a larger scale; no row or day of the period is left out.
PERIOD_START, PERIOD_DAYS = "1998-01-01", 28


class Tables:
    """The test tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def folded(day: Column) -> Column:
    """A date as a day of the period."""
    begin = F.to_date(F.lit(PERIOD_START))
    return F.date_add(begin, F.pmod(F.datediff(day.cast("date"), begin), F.lit(PERIOD_DAYS)))


def text(c: Column) -> Column:
    return c.cast("string")


def joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])


def by_remainder(c: Column, n: int, values: dict, other=None) -> Column:
    """Value chosen by ``c % n``; ``other`` for the remainders not named."""

    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    chosen = None
    for r, v in values.items():
        test = c % n == r
        chosen = F.when(test, value(v)) if chosen is None else chosen.when(test, value(v))
    return chosen.otherwise(value(other))


def two_departments(k: Column) -> Column:
    names = F.array(*[F.lit(d) for d in DEPARTMENTS])
    first, second = k % 5, (k + 1 + k % 3) % 5
    return F.array(F.get(names, first.cast("int")), F.get(names, second.cast("int")))


def sites(t: Tables) -> DataFrame:
    """Customer to namespace (region name)."""
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.lower("r_name").alias("namespace"))
    )


def checkups(t: Tables) -> DataFrame:
    return t.orders.join(sites(t), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("checkup_id"),
        F.col("o_orderpriority").alias("department_name"),
        F.col("o_orderdate").cast("date").alias("checkup_date"),
        "namespace",
        F.col("o_custkey").alias("patient_id"),
    )


def grants(t: Tables) -> DataFrame:
    """One grant per customer: two departments, a short and a long date range."""
    k = F.col("c_custkey")
    first = F.to_date(F.lit("1995-01-01"))
    begin = (k * 37 % 2000).cast("int")
    return sites(t).select(
        k.alias("k"),
        joined("g", k).alias("grant_id"),
        joined("r", k).alias("request_id"),
        joined("q", k % 50).alias("requestor_id"),
        "namespace",
        two_departments(k).alias("departments"),
        F.when(k % 500 != 3, F.date_add(first, begin)).alias("date_start"),
        F.when(k % 700 != 4, F.date_add(first, begin + (k * 13 % 30).cast("int"))).alias("date_end"),
        F.date_add(first, begin + (k * 13 % 900).cast("int") - 5).alias("long_end"),
        F.date_add(first, begin).alias("long_start"),
        by_remainder(k, 7, {0: "PENDING", 3: "REJECTED"}, "APPROVED").alias("status"),
        F.when(k % 11 != 0, F.concat(F.lit("AK"), F.upper(F.left(F.sha2(text(k), 256), F.lit(12)))))
        .otherwise(F.lit(""))
        .alias("access_key_id"),
        F.when(k % 4 != 0, F.to_timestamp(F.date_add(F.to_date(F.lit("1998-01-01")), (k * 17 % 1000).cast("int"))))
        .alias("cred_expiration"),
    )


def requests(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("request_id"),
        F.col("o_custkey").alias("requestor_id"),
        F.when(F.col("o_orderstatus") == "O", "PENDING")
        .when(F.col("o_orderstatus") == "P", "FORWARDED")
        .otherwise("APPROVED")
        .alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        two_departments(k).alias("departments"),
    )


def responses(t: Tables) -> DataFrame:
    part = F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_suppkey").alias("hospital_id"),
        F.when(F.col("l_returnflag") == "A", "APPROVED")
        .when(F.col("l_returnflag") == "R", "REJECTED")
        .otherwise("PENDING")
        .alias("status"),
        F.when(part % 11 != 0, joined("AK", F.col("l_suppkey"), "-", part)).otherwise(F.lit("")).alias("access_key_id"),
        F.when(part % 4 != 0, F.col("l_shipdate").cast("timestamp")).alias("cred_expiration"),
        F.col("l_shipdate").cast("date").alias("responded_on"),
        F.col("l_linenumber").alias("line"),
        part.alias("part_id"),
    )


def requestors(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("requestor_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.col("c_mktsegment").alias("organization"),
    )


def hospitals(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    states = {0: "PENDING", 1: "CREDENTIALS_ISSUED", 2: "INACTIVE"}
    return t.supplier.select(
        k.alias("hospital_id"), F.col("s_name").alias("name"), by_remainder(k, 6, states, "ACTIVE").alias("status")
    )


def clinic(t: Tables) -> dict[str, DataFrame]:
    """The operational tables behind the checkups view."""
    k = F.col("o_orderkey")
    pressure = joined(90 + k % 80, "/", 50 + k % 60)
    spaced = joined(" ", 90 + k % 80, " \\ ", 50 + k % 60, " ")
    complaint = joined("fever; cough ", k % 13, F.when(k % 2 == 0, F.lit(" | fatigue")).otherwise(F.lit(",,")))
    visits = t.orders.join(t.documents.select("doc_id", "text"), k == F.col("doc_id"), "left")
    c = F.col("c_custkey")
    s = F.col("s_suppkey")
    return {
        "checkups": visits.select(
            k.alias("checkup_id"),
            k.alias("appointment_id"),
            k.alias("prescription_id"),
            k.alias("recommendation_id"),
            (k % 10 == 0).alias("is_draft"),
            by_remainder(k, 7, {0: None, 1: "high", 2: spaced}, pressure).alias("blood_pressure"),
            F.when(k % 9 == 0, F.lit("")).otherwise(joined(96 + k % 6, ".", k % 10)).alias("temperature"),
            F.when(k % 5 != 0, text(60 + k % 60)).alias("heart_rate"),
            F.when(k % 4 != 0, joined(80 + k % 90, " mg/dL")).alias("blood_sugar"),
            F.coalesce("text", complaint).alias("symptoms"),
            joined("type ", k % 6, ";", F.col("o_orderstatus")).alias("diagnosis"),
            F.when(k % 3 != 0, joined(" follow up in ", k % 30, " days ")).alias("notes"),
            F.when(k % 8 == 0, joined("insight ", k % 17)).alias("insights"),
            F.when(k % 12 == 0, F.lit("gap found")).otherwise(F.lit("")).alias("gap_analysis"),
            F.col("o_orderdate").cast("timestamp").alias("checkup_created_at"),
            F.to_timestamp(F.date_add(F.col("o_orderdate"), (k % 30).cast("int"))).alias("checkup_updated_at"),
        ),
        "appointments": t.orders.select(
            k.alias("appointment_id"), F.col("o_custkey").alias("patient_id"), (k * 7 % 97).alias("slot_id")
        ),
        "patients": t.customer.select(
            c.alias("patient_id"),
            c.alias("user_id"),
            F.to_timestamp(F.date_add(F.to_date(F.lit("1950-01-01")), (c * 7 % 20000).cast("int"))).alias("patient_dob"),
            by_remainder(c, 4, {0: "O+", 1: "A-", 2: None}, "").alias("patient_blood_group"),
            by_remainder(c, 3, {0: "Asthma, Diabetes", 1: F.col("c_mktsegment")}).alias("patient_medical_history"),
            by_remainder(c, 5, {0: "None", 1: "Penicillin; Peanuts|Latex"}).alias("patient_allergies"),
            F.col("c_name").alias("patient_address"),
        ),
        "users": t.customer.select(
            c.alias("user_id"), by_remainder(c, 4, {0: "MALE", 1: "FEMALE", 2: "OTHER"}, "").alias("patient_gender")
        ),
        "slots": t.supplier.select(s.alias("slot_id"), s.alias("schedule_id")),
        "schedules": t.supplier.select(s.alias("schedule_id"), s.alias("doctor_id")),
        "doctors": t.supplier.select(s.alias("doctor_id"), F.col("s_nationkey").alias("department_id")),
        "departments": t.nation.select(F.col("n_nationkey").alias("department_id"), F.col("n_name").alias("department_name")),
        "medications": t.lineitem.select(
            F.col("l_orderkey").alias("prescription_id"),
            F.col("l_partkey").alias("drug_id"),
            joined(F.col("l_quantity").cast("long"), " mg").alias("dose_per_intake"),
            F.col("l_linenumber").alias("times_per_day"),
            (1 + F.col("l_suppkey") % 14).alias("total_days"),
        ),
        "drugs": t.part.select(F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("drug_name")),
        "recommended_tests": t.lineitem.filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("recommendation_id"), F.col("l_suppkey").alias("lab_test_id")
        ),
        "lab_tests": t.supplier.select(s.alias("lab_test_id"), F.col("s_name").alias("test_name")),
    }


def versions(t: Tables) -> DataFrame:
    """Line items as versions of one checkup each; a later ship date is newer."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("checkup_id"),
        F.element_at(F.array(*[F.lit(d) for d in DEPARTMENTS]), (1 + F.col("l_suppkey") % 5).cast("int")).alias(
            "department_name"
        ),
        folded(F.col("l_shipdate")).alias("checkup_date"),
        F.col("l_shipdate").cast("date").alias("updated_on"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("hospital_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
    )


def newest_version() -> list[Column]:
    order = ("updated_on", "line", "part_id", "hospital_id", "quantity", "flag")
    return [F.col(c).desc() for c in order]
