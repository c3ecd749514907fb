"""The same results as `queries.py`, in SQL over the test tables."""

from __future__ import annotations

# White space characters, as in the text functions.
_SPACE = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
    "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)
_DEPARTMENTS = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"
_NOW = "TIMESTAMP '1999-01-01 00:00:00'"


def _strip(c: str) -> str:
    return f"trim({c}, {_SPACE})"


def _split(c: str) -> str:
    r"""Items of free text; a carriage return before a line feed is white space either way."""
    parts = f"string_split(translate({c}, chr(10) || ';,|', chr(1) || chr(1) || chr(1) || chr(1)), chr(1))"
    return f"coalesce(list_filter(list_transform({parts}, lambda x: {_strip('x')}), lambda x: x <> ''), [])"


def _pair(k: str) -> str:
    d = _DEPARTMENTS
    return f"[{d}[1 + {k} % 5], {d}[1 + ({k} + 1 + {k} % 3) % 5]]"


def _day(base: str, days: str) -> str:
    return f"(DATE '{base}' + CAST({days} AS INTEGER))"


SITES = """sites AS (
  SELECT c_custkey, lower(r_name) AS namespace FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CHECKUPS = f"""{SITES}, checkups AS (
  SELECT o_orderkey AS checkup_id, o_orderpriority AS department_name, CAST(o_orderdate AS DATE) AS checkup_date,
    namespace, o_custkey AS patient_id FROM orders JOIN sites ON o_custkey = c_custkey)"""

_BEGIN = "c_custkey * 37 % 2000"
GRANTS = f"""grants AS (
  SELECT c_custkey AS k, 'g' || c_custkey AS grant_id, 'q' || (c_custkey % 50) AS requestor_id, namespace,
    {_pair('c_custkey')} AS departments,
    CASE WHEN c_custkey % 500 <> 3 THEN {_day('1995-01-01', _BEGIN)} END AS date_start,
    CASE WHEN c_custkey % 700 <> 4 THEN {_day('1995-01-01', _BEGIN + ' + c_custkey * 13 % 30')} END AS date_end,
    {_day('1995-01-01', _BEGIN)} AS long_start,
    {_day('1995-01-01', _BEGIN + ' + c_custkey * 13 % 900 - 5')} AS long_end,
    CASE c_custkey % 7 WHEN 0 THEN 'PENDING' WHEN 3 THEN 'REJECTED' ELSE 'APPROVED' END AS status,
    CASE WHEN c_custkey % 11 <> 0 THEN 'AK' || upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12)) ELSE '' END
      AS access_key_id,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST({_day('1998-01-01', 'c_custkey * 17 % 1000')} AS TIMESTAMP) END
      AS cred_expiration
  FROM sites),
usable AS (
  SELECT * FROM grants WHERE status = 'APPROVED' AND access_key_id <> ''
    AND (cred_expiration IS NULL OR {_NOW} <= cred_expiration))"""

REQUESTS = f"""requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS requestor_id,
    CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'FORWARDED' ELSE 'APPROVED' END AS status,
    o_orderdate AS created_at, {_pair('o_orderkey')} AS departments FROM orders)"""

RESPONSES = """responses AS (
  SELECT l_orderkey AS request_id, l_suppkey AS hospital_id,
    CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'REJECTED' ELSE 'PENDING' END AS status,
    CASE WHEN l_partkey % 11 <> 0 THEN 'AK' || l_suppkey || '-' || l_partkey ELSE '' END AS access_key_id,
    CASE WHEN l_partkey % 4 <> 0 THEN l_shipdate END AS cred_expiration,
    CAST(l_shipdate AS DATE) AS responded_on, l_linenumber AS line, l_partkey AS part_id FROM lineitem)"""

HOSPITALS = """hospitals AS (
  SELECT s_suppkey AS hospital_id, s_name AS name,
    CASE s_suppkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'CREDENTIALS_ISSUED' WHEN 2 THEN 'INACTIVE' ELSE 'ACTIVE' END
      AS status FROM supplier)"""

def _folded(day: str) -> str:
    return f"(DATE '1998-01-01' + CAST(((date_diff('day', DATE '1998-01-01', CAST({day} AS DATE)) % 28) + 28) % 28 AS INTEGER))"


CLINIC = f"""meds AS (
  SELECT l_orderkey AS k, count(*) AS n_meds, '[' || string_agg(item, ',' ORDER BY name, dosage, frequency, duration)
    || ']' AS prescription FROM (
    SELECT *, '{{"name":"' || name || '","dosage":"' || dosage || '","frequency":"' || frequency || '","duration":"'
      || duration || '"}}' AS item FROM (
      SELECT l_orderkey, p_name AS name, CAST(l_quantity AS BIGINT) || ' mg' AS dosage,
        l_linenumber || ' times per day' AS frequency, (1 + l_suppkey % 14) || ' days' AS duration
      FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY l_orderkey),
tests AS (
  SELECT l_orderkey AS k, count(*) AS n_tests,
    '[' || string_agg('{{"name":"' || s_name || '"}}', ',' ORDER BY s_name) || ']' AS test_recommendations
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY l_orderkey),
clinic AS (
  SELECT o_orderkey AS checkup_id, n_name AS department_name,
    CASE c_custkey % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'OTHER' ELSE '' END AS patient_gender,
    CASE c_custkey % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'Penicillin; Peanuts|Latex' END AS patient_allergies,
    CASE c_custkey % 3 WHEN 0 THEN 'Asthma, Diabetes' WHEN 1 THEN c_mktsegment END AS patient_medical_history,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'high'
      WHEN 2 THEN ' ' || (90 + o_orderkey % 80) || ' \\ ' || (50 + o_orderkey % 60) || ' '
      ELSE (90 + o_orderkey % 80) || '/' || (50 + o_orderkey % 60) END AS blood_pressure,
    o_orderkey % 9 <> 0 AS has_temperature, o_orderkey % 5 <> 0 AS has_heart_rate, o_orderkey % 4 <> 0 AS has_sugar,
    coalesce(text, 'fever; cough ' || (o_orderkey % 13) || CASE WHEN o_orderkey % 2 = 0 THEN ' | fatigue' ELSE ',,' END)
      AS symptoms,
    'type ' || (o_orderkey % 6) || ';' || o_orderstatus AS diagnosis,
    CASE WHEN o_orderkey % 3 <> 0 THEN ' follow up in ' || (o_orderkey % 30) || ' days ' END AS notes,
    o_orderkey % 8 = 0 AS has_insights, o_orderkey % 12 = 0 AS has_gaps,
    CAST({_day('1950-01-01', 'c_custkey * 7 % 20000')} AS VARCHAR) AS dob,
    CAST(o_orderdate AS DATE) AS created_on, prescription, test_recommendations,
    coalesce(n_meds, 0) AS n_meds, coalesce(n_tests, 0) AS n_tests
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN documents ON doc_id = o_orderkey
  LEFT JOIN supplier ON s_suppkey = o_orderkey * 7 % 97 LEFT JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN meds ON meds.k = o_orderkey LEFT JOIN tests ON tests.k = o_orderkey
  WHERE o_orderkey % 10 <> 0)"""

VERSIONS = f"""versions AS (
  SELECT l_orderkey AS checkup_id, {_DEPARTMENTS}[1 + l_suppkey % 5] AS department_name,
    CAST({_folded('l_shipdate')} AS VARCHAR) AS checkup_date,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS updated_on, CAST(l_linenumber AS BIGINT) AS line,
    l_partkey AS part_id, l_suppkey AS hospital_id, CAST(l_quantity AS BIGINT) AS quantity, l_returnflag AS flag
  FROM lineitem),
newest AS (
  SELECT checkup_id, department_name, checkup_date, updated_on, line, part_id, hospital_id, quantity, flag FROM (
    SELECT *, row_number() OVER (PARTITION BY checkup_id ORDER BY updated_on DESC, line DESC, part_id DESC,
      hospital_id DESC, quantity DESC, flag DESC) AS rn FROM versions) WHERE rn = 1)"""

_MERGED = f"""WITH {VERSIONS}
SELECT department_name, checkup_date, count(*) AS records, CAST(sum(checkup_id) AS BIGINT) AS id_sum,
  CAST(sum(part_id) AS BIGINT) AS part_sum FROM newest GROUP BY ALL"""


def _iso(c: str) -> str:
    return (
        f"CASE WHEN date_trunc('second', {c}) = {c} THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"
    )


_BP = r"'^(\d{2,3})\s*[/\\]\s*(\d{2,3})$'"

# What a bundle holds, counted from the inputs: kind, status, label, how many.
_RESOURCES = f"""
    ('Patient', NULL, NULL, 1), ('AllergyIntolerance', NULL, NULL, n_allergies),
    ('Condition', NULL, NULL, n_history + n_diagnoses), ('Encounter', 'completed', NULL, 1),
    ('Observation', 'final', 'Temperature', CAST(has_temperature AS BIGINT)),
    ('Observation', 'final', 'Systolic blood pressure', n_pressure),
    ('Observation', 'final', 'Diastolic blood pressure', n_pressure),
    ('Observation', 'final', 'Blood pressure', CASE WHEN blood_pressure IS NULL THEN 0 ELSE 1 - n_pressure END),
    ('Observation', 'final', 'Blood sugar', CAST(has_sugar AS BIGINT)),
    ('Observation', 'final', 'Heart rate', CAST(has_heart_rate AS BIGINT)),
    ('Observation', 'final', 'Symptom', n_symptoms),
    ('DocumentReference', 'current', NULL, n_notes + CAST(has_gaps AS BIGINT)),
    ('ClinicalImpression', 'completed', NULL, CAST(has_insights AS BIGINT)),
    ('MedicationRequest', 'active', NULL, n_meds), ('Observation', 'unknown', NULL, n_tests),
    ('DiagnosticReport', 'partial', NULL, CASE WHEN n_tests > 0 THEN 1 ELSE 0 END)"""

COUNTED = f"""counted AS (
  SELECT *, len({_split('patient_allergies')}) AS n_allergies, len({_split('patient_medical_history')}) AS n_history,
    len({_split('diagnosis')}) AS n_diagnoses, len({_split('symptoms')}) AS n_symptoms,
    len({_split('notes')}) AS n_notes,
    coalesce(CAST(regexp_matches({_strip('blood_pressure')}, {_BP}) AS BIGINT), 0) AS n_pressure FROM clinic)"""

DEFECTS = f"""defects AS (
  SELECT CASE WHEN checkup_id % 11 < 6 THEN 'INVALID' ELSE 'VALID' END AS status,
    CASE checkup_id % 11 WHEN 0 THEN 'missing fhir_bundle_json' WHEN 1 THEN 'not JSON'
      WHEN 2 THEN 'unknown resourceType: Alien'
      WHEN 3 THEN 'Encounter.status: field required'
        || CASE WHEN has_insights THEN '; ClinicalImpression.status: field required' ELSE '' END
      WHEN 4 THEN 'not a JSON object' WHEN 5 THEN 'empty string' END AS error,
    CASE WHEN department_name IS NULL THEN 'unassigned' ELSE department_name END AS department,
    CAST({_folded('created_on')} AS VARCHAR) AS day FROM clinic)"""

_CUM = f"""steps AS (
  SELECT namespace, unnest(list_distinct(departments)) AS department_name, date_start, date_end FROM usable),
covered AS (
  SELECT p.namespace, p.department_name, p.checkup_date, count(*) AS grants_in_force
  FROM (SELECT DISTINCT namespace, department_name, checkup_date FROM checkups) p
  JOIN steps s ON p.namespace = s.namespace AND p.department_name = s.department_name
    AND (s.date_start IS NULL OR p.checkup_date >= s.date_start) AND (s.date_end IS NULL OR p.checkup_date <= s.date_end)
  GROUP BY ALL)"""

_BRANCHES = f"""branches AS (
  SELECT namespace, departments FROM (
    SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY k) AS rn FROM usable
    WHERE namespace IN ('africa', 'asia', 'europe')) WHERE rn = 1),
federated AS (
  SELECT c.* FROM checkups c JOIN branches b ON c.namespace = b.namespace
    AND list_contains(b.departments, c.department_name)
  WHERE checkup_date BETWEEN DATE '1995-06-01' AND DATE '2000-06-30')"""

_DAYS = """days AS (
  SELECT grant_id, requestor_id, k, CAST(unnest(generate_series(long_start, long_end, INTERVAL 1 DAY)) AS DATE) AS day
  FROM grants WHERE long_start <= long_end)"""


_REFUSED = """refused AS (
  SELECT * FROM (SELECT grant_id, requestor_id, CASE WHEN long_start IS NULL THEN 'open start date'
    WHEN long_end IS NULL THEN 'open end date' WHEN long_end < long_start THEN 'end date before start date' END AS reason
    FROM grants) WHERE reason IS NOT NULL)"""


def _patterns(key: str) -> str:
    return f"""marked AS (
  SELECT {key}, day, year(day) AS y, month(day) AS m,
    count(*) OVER (PARTITION BY {key}, year(day)) = dayofyear(make_date(year(day), 12, 31)) AS whole_year,
    count(*) OVER (PARTITION BY {key}, year(day), month(day)) = day(last_day(day)) AS whole_month
  FROM (SELECT DISTINCT {key}, day FROM days)),
patterns AS (
  SELECT DISTINCT {key}, CASE WHEN whole_year THEN strftime(day, '%Y-') || '*'
    WHEN whole_month THEN strftime(day, '%Y-%m-') || '*' ELSE strftime(day, '%Y-%m-%d') END AS pattern FROM marked)"""


_POLICY = f"""lists AS (
  SELECT g.grant_id, namespace, departments, list(pattern ORDER BY replace(pattern, '*', '')) AS patterns
  FROM grants g JOIN patterns p ON g.grant_id = p.grant_id GROUP BY ALL),
resources AS (
  SELECT grant_id, namespace, '[' || array_to_string(flatten(list_transform(departments, lambda d:
    list_transform(patterns, lambda p: '"arn:aws:s3:::hospital-data/iceberg/' || namespace
      || '/checkups/data/department_name=' || d || '/checkup_date=' || p || '/*"'))), ',') || ']' AS data FROM lists),
policies AS (
  SELECT grant_id, '{{"Version":"2012-10-17","Statement":['
    || '{{"Sid":"AllowListMetadata","Effect":"Allow","Action":"s3:ListBucket","Resource":"arn:aws:s3:::hospital-data",'
    || '"Condition":{{"StringLike":{{"s3:prefix":["iceberg/' || namespace || '/checkups/metadata/*","iceberg/'
    || namespace || '/checkups/data/*"]}}}}}},'
    || '{{"Sid":"AllowGetMetadata","Effect":"Allow","Action":"s3:GetObject","Resource":"arn:aws:s3:::hospital-data/iceberg/'
    || namespace || '/checkups/metadata/*"}},'
    || '{{"Sid":"AllowSpecificPartitions","Effect":"Allow","Action":"s3:GetObject","Resource":' || data || '}}]}}' AS policy
  FROM resources)"""

_CHECK_START = f"""CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN '1995-13-01' WHEN 2 THEN '1995/01/01'
  ELSE CAST(date_start + CAST(k % 9 - 2 AS INTEGER) AS VARCHAR) END"""
_CHECK_END = """CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'tomorrow'
  ELSE CAST(date_end + CAST(k % 4 - 2 AS INTEGER) AS VARCHAR) END"""

def _throttled(events: str) -> str:
    return f"""WITH RECURSIVE given AS (SELECT * FROM {events}),
anchors AS (
  SELECT user_id, min(ts) AS opened FROM given GROUP BY user_id
  UNION ALL
  SELECT a.user_id, min(e.ts) FROM anchors a JOIN given e ON e.user_id = a.user_id AND e.ts > a.opened + INTERVAL 6 HOURS
  GROUP BY a.user_id),
placed AS (
  SELECT e.user_id, e.event_id, a.opened, row_number() OVER (PARTITION BY e.user_id, a.opened ORDER BY e.ts, e.event_id) AS rn
  FROM given e ASOF JOIN anchors a ON e.user_id = a.user_id AND e.ts >= a.opened)
SELECT user_id, count(*) AS events, count(*) FILTER (rn <= 5) AS passed, count(DISTINCT opened) AS windows,
  CAST(sum(event_id) FILTER (rn <= 5) AS BIGINT) AS passed_ids FROM placed GROUP BY user_id"""


ORACLES: dict[str, str] = {
    "extract_window": """
SELECT o_orderkey AS checkup_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_on FROM orders
WHERE o_orderdate > TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1998-03-01'""",
    "denormalize_checkups": f"""WITH {CLINIC}
SELECT checkup_id, department_name, patient_gender, patient_allergies, blood_pressure, dob,
  CAST(created_on AS VARCHAR) AS created_on, prescription, test_recommendations FROM clinic""",
    "normalize_department": """
SELECT o_orderkey AS checkup_id, CASE WHEN o_orderkey % 6 < 3 THEN 'unassigned' ELSE o_orderpriority END AS department_name,
  CASE o_orderkey % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'Female' WHEN 2 THEN '' END AS patient_gender,
  chr(9) || o_orderstatus AS diagnosis,
  CASE o_orderkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender_code FROM orders""",
    "split_items": f"""
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_items, array_to_string(items, '; ') AS summary
FROM (SELECT doc_id, {_split('text')} AS items FROM documents)""",
    "parse_json_items": """
SELECT items, count(*) AS n FROM (
  SELECT CASE WHEN l_partkey % 13 < 8 THEN p_name
    || CASE l_partkey % 3 WHEN 0 THEN ' ' || CAST(l_quantity AS BIGINT) || 'mg'
       WHEN 1 THEN ' ' || CAST(l_quantity AS BIGINT) ELSE '' END
    || CASE WHEN l_partkey % 2 = 0 THEN ' BD' ELSE '' END
    || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ' ' || l_linenumber || ' days' END
    || CASE WHEN l_partkey % 7 = 0 THEN ' (' || p_type || ')' ELSE '' END
  WHEN l_partkey % 13 IN (8, 9) THEN p_name || '; ' || p_brand ELSE '' END AS items
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY items""",
    "parse_json_objects": """
SELECT event_type, count(*) AS events, CAST(0 AS BIGINT) AS items FROM events GROUP BY event_type""",
    "parse_blood_pressure": f"""
WITH raw AS (
  SELECT p_partkey AS part_id, CASE p_partkey % 8
    WHEN 0 THEN (100 + p_size) || '/' || (60 + p_size)
    WHEN 1 THEN ' ' || (100 + p_size) || ' \\ ' || (40 + p_size) || ' ' || chr(10)
    WHEN 2 THEN (1000 + p_size) || '/' || p_size WHEN 3 THEN p_brand WHEN 4 THEN p_size || '/' || p_size
    WHEN 5 THEN '  ' WHEN 6 THEN NULL ELSE (90 + p_size) || ' /' || (50 + p_size) || ' mmHg' END AS raw FROM part),
tidy AS (SELECT part_id, nullif({_strip('raw')}, '') AS t FROM raw)
SELECT part_id, nullif(regexp_extract(t, {_BP}, 1), '') AS systolic, nullif(regexp_extract(t, {_BP}, 2), '') AS diastolic,
  t AS original FROM tidy""",
    "iso_timestamps": f"""
WITH spelled AS (
  SELECT event_id, ts, CASE event_id % 6
    WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d')
    WHEN 4 THEN strftime(ts, '%d/%m/%Y') END AS spelled FROM events)
SELECT event_id, {_iso('ts')} AS iso, strftime(ts, '%Y-%m-%d') AS day, spelled,
  CASE WHEN event_id % 6 < 4 THEN strftime(ts, '%Y-%m-%d') END AS checkup_date FROM spelled""",
    "iso_dates": f"""
SELECT {_iso('o_orderdate')} AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY ALL""",
    "normalize_lists": f"""WITH {CLINIC}, {COUNTED}
SELECT coalesce(department_name, 'unassigned') AS department_name, count(*) AS checkups,
  CAST(sum(n_pressure) AS BIGINT) AS bp_parsed, CAST(sum(n_meds) AS BIGINT) AS prescription_list,
  CAST(sum(n_tests) AS BIGINT) AS test_list, CAST(sum(n_symptoms) AS BIGINT) AS symptom_list,
  CAST(sum(n_diagnoses) AS BIGINT) AS diagnosis_list, CAST(sum(n_notes) AS BIGINT) AS note_list
FROM counted GROUP BY ALL""",
    "bundle_resource_counts": f"""WITH {CLINIC}, {COUNTED}
SELECT resource_type, status, label, CAST(sum(n) AS BIGINT) AS resources
FROM counted, LATERAL (VALUES {_RESOURCES}) r(resource_type, status, label, n) GROUP BY ALL HAVING sum(n) > 0""",
    "bundle_ids": """
SELECT o_orderkey AS checkup_id, 'bundle-' || sha256(o_orderkey || 'v2') AS bundle_id FROM orders""",
    "validate_split": f"""WITH {CLINIC}, {DEFECTS}
SELECT status AS fhir_validation_status, error AS validation_error, '19990101T000000' AS validated_at, count(*) AS records
FROM defects GROUP BY ALL""",
    "validator_hook": f"""WITH {CLINIC}, {DEFECTS.replace('FROM clinic)', ', has_temperature FROM clinic)')}
SELECT CASE WHEN error IS NULL AND has_temperature THEN 'VALID' ELSE 'INVALID' END AS fhir_validation_status,
  CASE WHEN error IS NULL AND NOT has_temperature THEN 'ValueError: no temperature' ELSE error END AS validation_error,
  count(*) AS records FROM defects GROUP BY ALL""",
    "publish_partitions": f"""WITH {CLINIC}, {DEFECTS}
SELECT CASE WHEN status = 'VALID' THEN 'checkups' ELSE 'checkups_errors' END AS table_name, department AS department_name,
  day AS checkup_date, 'b1' AS batch_id, '1995-01-01' AS batch_start_ts, '2002-01-01' AS batch_end_ts,
  '1999-01-01' AS ingest_date, count(*) AS records FROM defects GROUP BY ALL""",
    "upsert_latest": f"WITH {VERSIONS} SELECT * FROM newest",
    "upsert_table": _MERGED,
    "stream_publish": _MERGED,
    "federated_select": f"""WITH {CHECKUPS}, {GRANTS}, {_BRANCHES}
SELECT checkup_id, department_name, CAST(checkup_date AS VARCHAR) AS checkup_date, namespace, patient_id FROM federated""",
    "federated_unequal": f"""WITH {CHECKUPS}
SELECT checkup_id, namespace, CASE WHEN namespace <> 'europe' THEN department_name END AS department_name,
  CASE WHEN namespace <> 'asia' OR patient_id % 7 <> 0 THEN patient_id END AS patient_id,
  CASE WHEN namespace = 'europe' THEN 'w1' END AS ward, strftime(checkup_date, '%Y-%m-%d 00:00:00') AS checkup_date,
  CASE WHEN namespace = 'asia' AND patient_id % 7 = 0 THEN 'asia.patient_id is no bigint: P-' || patient_id END AS unfit
FROM checkups WHERE namespace IN ('africa', 'asia', 'europe')""",
    "federated_topk": f"""WITH {CHECKUPS}, {GRANTS}, {_BRANCHES}
SELECT checkup_id, department_name, CAST(checkup_date AS VARCHAR) AS checkup_date FROM federated
ORDER BY checkup_date DESC, checkup_id DESC LIMIT 10001""",
    "grant_checks": f"""WITH {SITES}, {GRANTS},
asked AS (
  SELECT *, {_CHECK_START} AS s, {_CHECK_END} AS e, CASE k % 4 WHEN 0 THEN departments WHEN 1 THEN [lower(departments[1])]
    WHEN 2 THEN departments[1:1] ELSE {_DEPARTMENTS} END AS wanted FROM grants),
parsed AS (
  SELECT *, CASE WHEN regexp_full_match(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(s AS DATE) END AS sd,
    CASE WHEN regexp_full_match(e, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(e AS DATE) END AS ed,
    list_filter(wanted, lambda d: NOT list_contains(departments, d)) AS refused FROM asked)
SELECT grant_id, CASE WHEN len(refused) > 0 THEN 'department not approved: ' || refused[1] END AS department_reason,
  CASE WHEN (s <> '' AND sd IS NULL) OR (e <> '' AND ed IS NULL) THEN 'invalid date'
    WHEN sd < date_start THEN 'start before approved start' WHEN ed > date_end THEN 'end after approved end' END
    AS date_reason,
  CASE WHEN sd IS NULL THEN 'invalid start date' WHEN ed IS NULL THEN 'invalid end date'
    WHEN ed < sd THEN 'end date before start date' END AS range_reason,
  CAST(coalesce(sd, date_start) AS VARCHAR) AS effective_start, CAST(coalesce(ed, date_end) AS VARCHAR) AS effective_end
FROM parsed""",
    "scope_days": f"""WITH {SITES}, {GRANTS}, {_DAYS}, {_REFUSED}
SELECT grant_id, CAST(day AS VARCHAR) AS day, NULL AS reason FROM days
UNION ALL SELECT grant_id, NULL, reason FROM refused""",
    "scope_patterns": f"""WITH {SITES}, {GRANTS}, {_DAYS}, {_patterns('grant_id')}, {_REFUSED}
SELECT grant_id, pattern, NULL AS reason FROM patterns UNION ALL SELECT grant_id, NULL, reason FROM refused""",
    "scope_day_patterns": f"""WITH {SITES}, {GRANTS}, {_DAYS}, {_patterns('requestor_id')}, {_REFUSED}
SELECT requestor_id, pattern, NULL AS grant_id, NULL AS reason FROM patterns
UNION ALL SELECT requestor_id, NULL, grant_id, reason FROM refused""",
    "scope_policy": f"""WITH {SITES}, {GRANTS}, {_DAYS}, {_patterns('grant_id')}, {_POLICY}, {_REFUSED}
SELECT grant_id, CAST(octet_length(encode(policy)) AS BIGINT) AS bytes, sha256(policy) AS policy_hash,
  CASE WHEN octet_length(encode(policy)) > 2048 THEN 'policy_too_large' ELSE 'ok' END AS verdict FROM policies
UNION ALL SELECT grant_id, NULL, NULL, reason FROM refused""",
    "scope_enforce": f"""WITH {CHECKUPS}, {GRANTS}
SELECT checkup_id, namespace, department_name, CAST(checkup_date AS VARCHAR) AS checkup_date FROM checkups c
WHERE EXISTS (SELECT 1 FROM usable u WHERE u.namespace = c.namespace AND list_contains(u.departments, c.department_name)
  AND (u.date_start IS NULL OR c.checkup_date >= u.date_start) AND (u.date_end IS NULL OR c.checkup_date <= u.date_end))""",
    "scope_coverage": f"""WITH {CHECKUPS}, {GRANTS}, {_CUM}
SELECT namespace, department_name, CAST(checkup_date AS VARCHAR) AS checkup_date, grants_in_force FROM covered""",
    "path_attribution": f"""WITH {SITES}, {GRANTS},
made AS (
  SELECT o_orderkey AS k, namespace AS ns, 'hospital-data/' || CASE WHEN o_orderkey % 9 = 0 THEN 'other/' ELSE 'iceberg/' END
    || namespace || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '::' || CASE o_orderkey % 5 WHEN 0 THEN 'NOKEY'
    WHEN 1 THEN lower(access_key_id) ELSE access_key_id END END
    || '/checkups/data/department_name=' || o_orderpriority || '/part-' || o_orderkey || '.parquet' AS path,
    CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'NOKEY'
      ELSE access_key_id END AS access_key_id
  FROM orders JOIN grants ON o_custkey = grants.k),
named AS (SELECT *, CASE WHEN k % 9 = 0 THEN '' ELSE ns END AS namespace FROM made),
owners AS (SELECT namespace, access_key_id, min(grant_id) AS grant_id FROM usable GROUP BY ALL)
SELECT k AS checkup_id, 'hospital-data' AS bucket, substr(path, 15) AS object, n.namespace, n.access_key_id, grant_id,
  CASE WHEN grant_id IS NULL THEN 'FORBIDDEN' ELSE 'ALLOWED' END AS verdict, 's3://' || path AS location
FROM named n LEFT JOIN owners o ON n.namespace = o.namespace AND n.access_key_id = o.access_key_id""",
    "grants_resolve": f"""WITH {REQUESTS}, {RESPONSES},
held AS (
  SELECT DISTINCT request_id || '-' || line || '-' || part_id || '-' || hospital_id || '-' || status AS grant_id, request_id,
    status, access_key_id, cred_expiration, hospital_id FROM responses)
SELECT grant_id, CASE WHEN hospital_id % 9 = 0 THEN 'not found' WHEN held.status <> 'APPROVED' THEN 'not approved: ' || held.status
    WHEN access_key_id = '' THEN 'no credentials' WHEN cred_expiration < {_NOW} THEN 'expired' ELSE 'ok' END AS reason,
  count(*) AS n FROM held JOIN requests USING (request_id) GROUP BY ALL""",
    "request_status_rollup": f"""WITH {REQUESTS}, {RESPONSES}, tallies AS (
  SELECT request_id, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected,
    count(*) FILTER (status = 'PENDING') AS pending, count(*) AS total FROM responses GROUP BY request_id)
SELECT r.request_id, status, CASE WHEN total IS NULL THEN 'FORWARDED' WHEN approved = total THEN 'APPROVED'
    WHEN rejected = total THEN 'REJECTED' WHEN pending = 0 OR approved > 0 THEN 'PARTIAL_APPROVED' ELSE 'FORWARDED' END
    AS rolled_status,
  coalesce(approved, 0) AS approved, coalesce(rejected, 0) AS rejected, coalesce(pending, 0) AS pending,
  coalesce(total, 0) AS total FROM requests r LEFT JOIN tallies t ON r.request_id = t.request_id""",
    "response_tallies": f"""WITH {RESPONSES}
SELECT request_id, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected,
  count(*) FILTER (status = 'PENDING') AS pending, count(*) AS total FROM responses GROUP BY request_id""",
    "response_lists": f"""WITH {RESPONSES}, lists AS (
  SELECT request_id, count(*) AS n, '[' || string_agg('{{"hospital":' || hospital_id || ',"status":"' || status || '","on":"'
      || responded_on || '","line":' || line || ',"part_id":' || part_id || '}}', ','
      ORDER BY hospital_id, status, responded_on, line, part_id) || ']' AS responses
  FROM responses GROUP BY request_id)
SELECT o_orderkey AS request_id, coalesce(n, 0) AS n, responses
FROM orders LEFT JOIN lists ON o_orderkey = request_id""",
    "hospital_status_counts": f"""WITH {HOSPITALS}
SELECT count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active,
  count(*) FILTER (status = 'CREDENTIALS_ISSUED') AS credentials_issued,
  count(*) FILTER (status = 'PENDING') AS pending FROM hospitals""",
    "listed_hospitals": f"""WITH {HOSPITALS}
SELECT hospital_id, name, status, status = 'ACTIVE' AS active FROM hospitals
WHERE status IN ('ACTIVE', 'CREDENTIALS_ISSUED')""",
    "node_request_counters": f"""WITH {REQUESTS}
SELECT count(*) AS "all", count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'APPROVED') AS approved,
  count(*) FILTER (status = 'REJECTED') AS rejected FROM requests""",
    "requestor_dashboard": f"""WITH {REQUESTS}, {RESPONSES}, live AS (
  SELECT request_id, count(*) AS n FROM responses WHERE status = 'APPROVED' AND access_key_id <> ''
    AND (cred_expiration IS NULL OR cred_expiration > {_NOW}) GROUP BY request_id)
SELECT requestor_id, count(*) AS total, count(*) FILTER (status IN ('PENDING', 'FORWARDED')) AS pending,
  count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected,
  count(*) FILTER (status = 'PARTIAL_APPROVED') AS partial_approved,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS active_credentials
FROM requests LEFT JOIN live USING (request_id) GROUP BY requestor_id""",
    "node_poll": f"""WITH {REQUESTS}, {RESPONSES}
SELECT request_id, requestor_id, p.status, array_to_string(departments, '|') AS departments,
  CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_on, c_name AS name, lower(c_name) || '@example.org' AS email,
  c_mktsegment AS organization
FROM responses p JOIN requests USING (request_id) LEFT JOIN customer ON c_custkey = requestor_id
WHERE hospital_id = 7 AND p.status = 'PENDING'""",
    "sync_new_requests": f"""WITH {REQUESTS}
SELECT request_id, requestor_id, status FROM requests
WHERE request_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'N')""",
    "active_nodes_check": f"""WITH {HOSPITALS}, asked AS (
  SELECT request_id, CASE request_id % 6 WHEN 0 THEN ids[1:1] WHEN 1 THEN ids[1:1] || ids[1:1] WHEN 2 THEN []
    WHEN 3 THEN ids[1:1] || [CAST(-1 AS BIGINT)] ELSE ids END AS nodes
  FROM (SELECT l_orderkey AS request_id, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS ids FROM lineitem GROUP BY l_orderkey)),
found AS (
  SELECT request_id, count(DISTINCT hospital_id) AS n FROM (SELECT request_id, unnest(nodes) AS hospital_id FROM asked)
  JOIN hospitals USING (hospital_id) WHERE status = 'ACTIVE' GROUP BY request_id)
SELECT request_id, CAST(len(nodes) AS BIGINT) AS asked_sites, coalesce(n, 0) AS active_sites,
  CASE WHEN len(nodes) = 0 THEN 'no site requested' WHEN n = len(nodes) THEN 'ok' ELSE 'site not active' END AS verdict
FROM asked LEFT JOIN found USING (request_id)""",
    "search_requests": f"""WITH {REQUESTS}
SELECT request_id, requestor_id, c_name AS name, c_mktsegment AS organization, status
FROM requests LEFT JOIN customer ON requestor_id = c_custkey
WHERE contains(lower(requestor_id || ' ' || coalesce(c_name, '') || ' ' || coalesce(lower(c_name) || '@example.org', '')
  || ' ' || coalesce(c_mktsegment, '') || ' ' || status), 'build')""",
    "search_hospitals": f"""WITH {HOSPITALS}
SELECT hospital_id, name, status FROM hospitals WHERE contains(lower(name), 'act') OR contains(lower(status), 'act')""",
    "list_page": f"""WITH {REQUESTS}
SELECT request_id, status, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_on,
  (SELECT count(*) FROM requests WHERE status = 'FORWARDED') AS total
FROM requests WHERE status = 'FORWARDED' ORDER BY created_at DESC, request_id DESC LIMIT 200 OFFSET 40""",
    "list_deep_page": f"""WITH {REQUESTS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, request_id DESC) AS rn, count(*) OVER () AS total FROM requests)
SELECT request_id, status, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_on, total FROM ranked
WHERE rn > total // 2 AND rn <= total // 2 + 200""",
    "recent_requests": f"""WITH {REQUESTS}
SELECT request_id, status FROM requests ORDER BY created_at DESC, request_id DESC LIMIT 5""",
    "audit_page": f"""
SELECT '{{"id":' || event_id || ',"action":"purchase","actor_id":"user-' || user_id || '","created_at":"' || {_iso('ts')}
  || '","total":' || (SELECT count(*) FROM events WHERE event_type = 'purchase') || '}}' AS entry
FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "expiry_status": f"""WITH {REQUESTS}, due AS (
  SELECT *, created_at + to_days(CAST(CASE WHEN request_id % 45 - 5 > 0 THEN request_id % 45 - 5 ELSE 30 END AS INTEGER)) AS x,
    CASE WHEN status = 'APPROVED' AND request_id % 72 - 8 > 0 THEN created_at + to_hours(request_id % 72 - 8) END AS v
  FROM requests)
SELECT request_id, CAST(CAST(x AS DATE) AS VARCHAR) AS expires_on, CASE WHEN x < {_NOW} THEN 'EXPIRED' ELSE status END AS status,
  {_iso('v')} AS valid_until FROM due""",
    "next_runs": f"""WITH last AS (
  SELECT user_id, max(ts) + to_seconds(user_id % 24 * 3600 + 60) AS due FROM events GROUP BY user_id)
SELECT user_id, {_iso('due')} AS next_run,
  CAST(trunc((epoch_us(due) - epoch_us(TIMESTAMP '2024-02-01 00:00:00')) / 1000000) AS BIGINT) AS next_run_in_seconds
FROM last""",
    "job_metrics": """WITH history AS (
  SELECT event_id, event_type, CASE WHEN event_id % 19 <> 0 THEN ts END AS s, event_id % 17 <> 0 AS ended,
    CAST(floor((event_id * 37 % 400000) / 1000 + 0.5) AS BIGINT) AS secs FROM events)
SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN s IS NULL THEN 'N/A' WHEN NOT ended THEN 'In progress…' WHEN secs < 60 THEN secs || 's'
    ELSE (secs // 60) || 'm ' || (secs % 60) || 's' END AS duration,
  event_id % 1000 AS records_extracted, event_id % 1000 - event_id % 7 AS records_validated, event_id % 7 AS records_failed
FROM history""",
    "mask_keys": f"""WITH {RESPONSES}
SELECT left(access_key_id, 6) || repeat('•', 12) || right(access_key_id, 4) AS masked, left(access_key_id, 8) AS shortened,
  count(*) AS n FROM responses GROUP BY ALL""",
    "stringify_rows": f"""WITH {SITES}, {GRANTS}
SELECT CAST(k AS VARCHAR) AS k, '["' || departments[1] || '","' || departments[2] || '"]' AS departments,
  CAST(date_start AS VARCHAR) AS date_start, status FROM grants""",
    "stream_sync": """
SELECT event_id AS request_id, 'pending' AS status, 'data_access' AS request_type, '{"request_id":' || event_id || ',"requestor_id":' || user_id
  || ',"event_type":"' || event_type || '"}' AS request_payload FROM events""",
    "throttle": _throttled("events"),
    "throttle_hot_user": _throttled(
        "(SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id) FROM events)"
    ),
    "catalog_columns": """WITH counts AS (
  SELECT 'orders' AS table_name, count(*) AS records FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
  UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events
  UNION ALL SELECT 'documents', count(*) FROM documents)
SELECT table_name, CAST(ordinal_position - 1 AS BIGINT) AS position, column_name, records
FROM information_schema.columns JOIN counts USING (table_name)""",
    "nested_medications": """
SELECT l_orderkey, count(*) AS items, CAST(sum(l_partkey) AS BIGINT) AS part_sum,
  string_agg(l_partkey || '-' || l_suppkey || '-' || l_linenumber, ',' ORDER BY l_partkey, l_suppkey, l_linenumber) AS lines
FROM lineitem GROUP BY l_orderkey""",
    "extract_slices": """WITH days AS (
  SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n, sum(o_orderkey) AS ids FROM orders
  WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1998-03-01' GROUP BY 1),
placed AS (
  SELECT *, CAST(floor((sum(n) OVER (ORDER BY day) - n) * 8 / sum(n) OVER ()) AS BIGINT) AS place FROM days)
SELECT dense_rank() OVER (ORDER BY place) - 1 AS slice, CAST(sum(n) AS BIGINT) AS records, CAST(sum(ids) AS BIGINT) AS id_sum
FROM placed GROUP BY place""",
    "stage_windows": """
SELECT 'filled' AS window, true AS written, count(*) AS records, CAST(sum(o_orderkey) AS BIGINT) AS id_sum FROM orders
WHERE o_orderdate > TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1998-03-01'
UNION ALL SELECT 'empty', false, 0, NULL""",
    "sql_views": """
SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT c_custkey) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "sql_governed": f"""WITH {CHECKUPS}, {GRANTS}
SELECT namespace, department_name, count(*) AS checkups, CAST(sum(checkup_id) AS BIGINT) AS id_sum FROM checkups c
WHERE checkup_date >= DATE '1996-01-01' AND EXISTS (
  SELECT 1 FROM usable u WHERE u.requestor_id = 'q4' AND u.namespace = c.namespace AND list_contains(u.departments, c.department_name)
  AND (u.date_start IS NULL OR c.checkup_date >= u.date_start) AND (u.date_end IS NULL OR c.checkup_date <= u.date_end))
GROUP BY namespace, department_name""",
    "browse_tables": " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS records, count(*) - count({column}) AS nulls,"
        f" CAST(1 AS BIGINT) AS schemas FROM {table}"
        for table, columns in {
            "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
            "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
            "nation": "n_nationkey n_name n_regionkey",
        }.items()
        for column in columns.split()
    ),
    "audit_export": """
SELECT event_type AS action, count(*) AS entries, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (
  SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY event_type""",
    "preview_rows": f"""WITH {CHECKUPS}
SELECT checkup_id, department_name, CAST(checkup_date AS VARCHAR) AS checkup_date FROM checkups
ORDER BY checkup_date DESC, checkup_id DESC LIMIT 100""",
    "result_rows": """
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ordered_at, CAST(50 AS BIGINT) AS row_count,
  true AS cut FROM orders ORDER BY o_orderkey LIMIT 50""",
    "unreadable_times": f"""WITH {CLINIC}
SELECT CASE WHEN checkup_id % 5 = 0 THEN 'checkups_errors' ELSE 'checkups' END AS table_name, count(*) AS records,
  CAST(sum(checkup_id) AS BIGINT) AS id_sum FROM clinic GROUP BY 1""",
    "stream_checkups": f"""WITH {CLINIC}, given AS (
  SELECT checkup_id, checkup_id % 3 AS run, checkup_id % 5 <> 0 AS readable, {_folded('created_on')} AS day FROM clinic)
SELECT run, 'clinic' AS source, 'completed' AS status,
  strftime(min(day) FILTER (readable), '%Y-%m-%dT00:00:00+00:00') AS window_start,
  strftime(max(day) FILTER (readable), '%Y-%m-%dT00:00:00+00:00') AS window_end, count(*) AS records_extracted,
  count(*) FILTER (readable) AS records_validated, count(*) FILTER (NOT readable) AS records_failed, count(*) AS stored,
  CAST(sum(checkup_id) AS BIGINT) AS id_sum FROM given GROUP BY run""",
    "windowed_runs": f"""WITH {CLINIC}, given AS (SELECT {_folded('created_on')} AS day FROM clinic),
spans(a, b) AS (VALUES (DATE '1998-01-01', DATE '1998-01-08'), (DATE '1998-01-08', DATE '1998-01-20'),
  (DATE '1998-01-20', DATE '1998-02-01'))
SELECT strftime(a, '%Y-%m-%dT00:00:00') AS window_start, strftime(b, '%Y-%m-%dT00:00:00') AS window_end,
  'completed' AS status, count(*) AS records_extracted, count(*) AS records_validated, CAST(0 AS BIGINT) AS records_failed,
  count(*) AS stored, CAST(3600 AS BIGINT) AS next_run_in_seconds
FROM given JOIN spans ON day >= a AND day < b GROUP BY a, b""",
    "moved_dates": f"""WITH {VERSIONS}
SELECT CAST(CAST(checkup_date AS DATE) + CAST(1 - checkup_id % 2 AS INTEGER) AS VARCHAR) AS checkup_date, count(*) AS records,
  count(DISTINCT checkup_id) AS checkups, CAST(sum(line + 100) AS BIGINT) AS lines FROM newest GROUP BY 1""",
    "compact_partitions": f"""WITH {VERSIONS}
SELECT department_name, checkup_date, count(*) AS records, CAST(sum(checkup_id) AS BIGINT) AS id_sum, CAST(1 AS BIGINT) AS files
FROM versions GROUP BY department_name, checkup_date""",
}
