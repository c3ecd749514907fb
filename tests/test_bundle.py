import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wardlake.catalogue.queries import QUERIES
from wardlake.functions.jsonlist import with_json_items
from wardlake.plans.bundle import bundle_entries
from wardlake.plans.normalise import SOURCE_COLUMNS, normalise, with_bundle
from wardlake.plans.validate import status_counts, validate

FULL = {
    "checkup_id": 1,
    "blood_pressure": " 158/95 ",
    "temperature": "98.6",
    "heart_rate": "80",
    "blood_sugar": "",
    "symptoms": 'a; b,c "quoted"',
    "diagnosis": "flu",
    "notes": "rest",
    "insights": "watch",
    "gap_analysis": "none",
    "checkup_created_at": dt.datetime(2024, 1, 1, 10, 0, 0, 500000),
    "checkup_updated_at": dt.datetime(2024, 1, 2),
    "department_name": " Cardiology ",
    "patient_dob": dt.datetime(1990, 5, 1),
    "patient_blood_group": "O+",
    "patient_medical_history": "Asthma, Diabetes",
    "patient_allergies": "None",
    "patient_address": "1 Road",
    "patient_gender": "MALE",
    "prescription": '[{"name":"A","dosage":"5mg"}]',
    "test_recommendations": '["CBC","X-ray"]',
}
TIMES = ("checkup_created_at", "checkup_updated_at", "patient_dob")


def schema():
    kinds = {c: "timestamp" if c in TIMES else "string" for c in SOURCE_COLUMNS} | {"checkup_id": "long"}
    return ", ".join(f"{c} {k}" for c, k in kinds.items())


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in SOURCE_COLUMNS) for r in rows], schema())


@pytest.fixture(scope="module")
def built(spark):
    return with_bundle(frame(spark, FULL, {"checkup_id": 2, "blood_pressure": "high"}))


@pytest.fixture(scope="module")
def bundles(built):
    return {r.checkup_id: json.loads(r.fhir_bundle_json) for r in built.collect()}


def kinds(bundle):
    return [e["resource"]["resourceType"] for e in bundle["entry"]]


def test_order_of_resources(bundles):
    assert kinds(bundles[1]) == (
        ["Patient", "AllergyIntolerance", "Condition", "Condition", "Encounter"]
        + ["Observation"] * 4
        + ["Observation"] * 3
        + ["Condition", "DocumentReference", "ClinicalImpression", "DocumentReference", "MedicationRequest"]
        + ["Observation", "Observation", "DiagnosticReport"]
    )
    assert kinds(bundles[2]) == ["Patient", "Encounter", "Observation"]


def test_content(bundles):
    bundle = bundles[1]
    by_kind = {}
    for entry in bundle["entry"]:
        by_kind.setdefault(entry["resource"]["resourceType"], []).append(entry["resource"])
    subject = {"reference": "Patient/patient-1"}
    at = "2024-01-01T10:00:00.500000+00:00"
    assert (bundle["resourceType"], bundle["type"], bundle["timestamp"]) == ("Bundle", "collection", at)
    assert by_kind["Patient"] == [
        {
            "resourceType": "Patient",
            "id": "patient-1",
            "gender": "male",
            "birthDate": "1990-05-01",
            "address": [{"text": "1 Road"}],
            "extension": [
                {"url": "http://example.org/fhir/StructureDefinition/blood-group", "valueString": "O+"}
            ],
        }
    ]
    assert by_kind["AllergyIntolerance"] == [
        {
            "resourceType": "AllergyIntolerance",
            "patient": subject,
            "clinicalStatus": {"coding": [{"code": "active"}]},
            "code": {"text": "None"},
        }
    ]
    assert by_kind["Condition"][0] == {
        "resourceType": "Condition",
        "subject": subject,
        "clinicalStatus": {"text": "resolved"},
        "category": [{"text": "Medical History"}],
        "code": {"text": "Asthma"},
    }
    assert by_kind["Condition"][2] == {
        "resourceType": "Condition",
        "subject": subject,
        "clinicalStatus": {"text": "active"},
        "code": {"text": "flu"},
    }
    assert by_kind["Encounter"] == [
        {
            "resourceType": "Encounter",
            "id": "1",
            "status": "completed",
            "class": [{"coding": [{"code": "AMB", "display": "ambulatory"}]}],
            "subject": subject,
            "actualPeriod": {"end": at},
            "type": [{"coding": [{"display": "Cardiology"}]}],
        }
    ]
    seen = [(o["code"]["text"], o.get("valueString"), o["status"]) for o in by_kind["Observation"]]
    assert seen == [
        ("Temperature", "98.6", "final"),
        ("Systolic blood pressure", "158", "final"),
        ("Diastolic blood pressure", "95", "final"),
        ("Heart rate", "80", "final"),
        ("Symptom", "a", "final"),
        ("Symptom", "b", "final"),
        ("Symptom", 'c "quoted"', "final"),
        ("CBC", None, "unknown"),
        ("X-ray", None, "unknown"),
    ]
    assert by_kind["Observation"][0]["effectiveDateTime"] == at
    assert [d["type"]["text"] for d in by_kind["DocumentReference"]] == ["Clinical note", "Gap Analysis"]
    assert by_kind["DocumentReference"][0]["content"] == [{"attachment": {"title": "rest"}}]
    assert by_kind["ClinicalImpression"][0]["summary"] == "watch"
    assert by_kind["MedicationRequest"] == [
        {
            "resourceType": "MedicationRequest",
            "status": "active",
            "intent": "order",
            "priority": "routine",
            "subject": subject,
            "medication": {"concept": {"text": "A 5mg"}},
        }
    ]
    report = by_kind["DiagnosticReport"][0]
    assert report["result"] == [{"reference": "Observation/obs-test-1"}, {"reference": "Observation/obs-test-2"}]
    raw = json.loads(bundle["meta"]["extension"][0]["valueString"])
    assert raw["prescription_raw"] == ["A 5mg"]
    assert raw["patient_allergies_raw"] == "None"


def test_sparse_row(bundles):
    patient, encounter, pressure = (e["resource"] for e in bundles[2]["entry"])
    assert patient == {"resourceType": "Patient", "id": "patient-2"}
    assert "actualPeriod" not in encounter
    assert encounter["type"] == [{"coding": [{"display": "unassigned"}]}]
    assert (pressure["code"], pressure["valueString"]) == ({"text": "Blood pressure"}, "high")


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "checkup_id long, checkup_created_at timestamp")
    row = with_bundle(df).first()
    assert row.prescription_list is None
    assert row.department_name == "unassigned"
    assert kinds(json.loads(row.fhir_bundle_json)) == ["Patient", "Encounter"]


def test_summaries_and_lists(built):
    row = built.filter("checkup_id = 1").first()
    assert row.prescription_summary == "A 5mg"
    assert row.test_summary == "CBC; X-ray"
    assert json.loads(row.bp_parsed) == {"systolic": "158", "diastolic": "95", "original": "158/95"}
    assert row.symptom_list == ["a", "b", 'c "quoted"']


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "checkup_id long, fhir_bundle_json string")
    return validate(df, F.to_timestamp(F.lit("2024-01-01 00:00:00")), **options).orderBy("checkup_id").collect()


def bundle(*resources, **fields):
    return json.dumps({"resourceType": "Bundle", "type": "collection", "entry": [{"resource": r} for r in resources]} | fields)


OBSERVATION = {"resourceType": "Observation", "status": "final", "code": {"text": "x"}}


@pytest.mark.parametrize(
    "text, error",
    [
        (None, "missing fhir_bundle_json"),
        ("", "missing fhir_bundle_json"),
        ("{nope", "not JSON"),
        ('{"resourceType":"Bundle","type":"c"} tail', "not JSON"),
        ("[]", "not a JSON object"),
        ("7", "not a JSON object"),
        ("{}", "resourceType: not a Bundle; Bundle.type: field required"),
        ('{"resourceType":"Bundle","type":"c","entry":{}}', "Bundle.entry: malformed"),
        (bundle(OBSERVATION), None),
        (bundle(), None),
        (bundle({"resourceType": "Observation", "status": "final"}), "Observation.code: field required"),
        (bundle(OBSERVATION | {"code": None}), "Observation.code: field required"),
        (bundle(OBSERVATION | {"code": "text"}), "Observation.code: field required"),
        (bundle(OBSERVATION | {"code": {}}), None),
        (bundle(OBSERVATION | {"valueString": ""}), "empty string"),
        (bundle(OBSERVATION | {"valueString": 'says ": ""'}), None),
        (bundle({"resourceType": "Condition", "subject": {}}), "Condition.clinicalStatus: field required"),
        (bundle({"resourceType": "MedicationStatement"}), None),
        (bundle({"resourceType": "Potion"}), "unknown resourceType: Potion"),
        (bundle({"resourceType": "Patient", "birthDate": "rubbish 19"}), "Patient.birthDate: not a valid value"),
        (bundle({"resourceType": "Patient", "birthDate": "1990-05", "gender": "female"}), None),
        (bundle({"resourceType": "Patient", "gender": "F"}), "Patient.gender: not a valid value"),
        (bundle({}), "unknown resourceType: none"),
        (
            bundle({"resourceType": "DocumentReference", "status": "current", "content": [{"title": "x"}]}),
            "DocumentReference.content.attachment: field required",
        ),
        (
            bundle({"resourceType": "MedicationRequest"}),
            "; ".join(f"MedicationRequest.{f}: field required" for f in ("status", "intent", "medication", "subject")),
        ),
    ],
)
def test_validation(spark, text, error):
    row = check(spark, [text])[0]
    assert row.validation_error == error
    assert row.fhir_validation_status == ("VALID" if error is None else "INVALID")
    assert (row.enrichment_version, row.validated_at) == ("v2", "20240101T000000")
    if error is not None:
        assert row.fhir_bundle_json == text


def test_ids_are_filled_in(spark):
    import hashlib

    patient, encounter = {"resourceType": "Patient", "gender": "male"}, {"resourceType": "Encounter", "status": "completed"}
    rows = check(
        spark,
        [
            bundle(OBSERVATION),
            bundle(patient, encounter | {"id": "e"}, OBSERVATION),
            bundle(patient | {"id": "p"}, id="mine"),
            bundle(OBSERVATION, id=None),
            bundle(encounter, id="mine"),
        ],
        version="v9",
    )
    got = [json.loads(r.fhir_bundle_json) for r in rows]
    assert all(r.fhir_validation_status == "VALID" for r in rows)

    def own(i):
        return "bundle-" + hashlib.sha256(f"{i}v9".encode()).hexdigest()

    assert [b["id"] for b in got] == [own(0), own(1), "mine", own(3), "mine"]
    assert [e["resource"].get("id") for e in got[1]["entry"]] == ["patient-1", "e", None]
    assert got[1]["entry"][0]["resource"]["gender"] == "male"
    assert got[2] == json.loads(bundle(patient | {"id": "p"}, id="mine"))
    assert got[4]["entry"][0]["resource"]["id"] == "4"


def test_own_bundles_are_valid(built):
    assert {r.fhir_validation_status: r.records for r in status_counts(validate(built)).collect()} == {"VALID": 2}


def test_no_python_in_the_plan(spark):
    plan = validate(with_bundle(frame(spark, FULL)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Python" not in normalise(frame(spark, FULL))._jdf.queryExecution().executedPlan().toString()


def test_key_is_required(spark):
    df = spark.createDataFrame([(None, bundle(OBSERVATION)), (0, bundle(OBSERVATION))], "checkup_id long, fhir_bundle_json string")
    got = {r.checkup_id: r.validation_error for r in validate(df).collect()}
    assert got == {None: "missing checkup_id", 0: None}


def test_a_checker_that_raises_spoils_only_its_row(spark):
    bundle = '{"resourceType":"Bundle","type":"collection","entry":[]}'
    df = spark.createDataFrame([(1, bundle), (2, bundle.replace("collection", "batch")), (3, "not JSON"), (None, bundle)], "checkup_id int, fhir_bundle_json string")

    def checker():
        def check(text):
            if "batch" in text:
                raise KeyError("entry")

        return check

    rows = {r.checkup_id: r for r in validate(df, checker=checker).collect()}
    assert {k: r.validation_error for k, r in rows.items()} == {1: None, 2: "KeyError: 'entry'", 3: "not JSON", None: "missing checkup_id"}
    assert rows[1].fhir_validation_status == "VALID" and rows[2].fhir_validation_status == "INVALID"
    assert [r.asDict() for r in validate(df).collect() if r.checkup_id == 1][0]["fhir_bundle_json"] == rows[1].fhir_bundle_json
    plan = validate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_parsed_bundle_is_not_copied_to_be_checked(spark):
    rows = spark.createDataFrame([(1, '{"resourceType":"Bundle"}')], "checkup_id long, fhir_bundle_json string")
    checked = validate(rows, F.lit("2024-01-01").cast("timestamp"))
    plan = checked.select("validation_error")._jdf.queryExecution().optimizedPlan().toString()
    assert "$[0].type" in plan and "$[0], VariantType" not in plan
    assert checked.first().validation_error == "Bundle.type: field required"


def test_a_checker_gets_only_what_it_checks(spark, folder):
    plan = QUERIES["validator_hook"](spark, folder)._jdf.queryExecution().analyzed().toString()
    line = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert "fhir_bundle_json" in line and "symptoms" not in line and "prescription" not in line


def test_fields_of_entries_are_those_of_the_entries_themselves(spark):
    other = OBSERVATION | {"status": 7, "code": {"text": 'a"\\\n'}}
    entries = [
        None,
        "",
        "{nope",
        "[]",
        '{"entry":{}}',
        '{"entry":[]}',
        bundle(OBSERVATION, other, None, "x", {}),
        bundle(OBSERVATION | {"code": "t"}, other | {"status": None}, other | {"status": {"a": 1}}),
        bundle(entry=[7, {"resource": other}]),
        bundle(entry=[None, [{"resource": other}], {"other": 1}]),
        bundle(other)[:-3],
        bundle(other) + " tail",
    ]
    df = spark.createDataFrame(list(enumerate(entries)), "id long, fhir_bundle_json string")
    paths = {"status": "status", "text": "code.text"}
    read = {n: F.try_variant_get("entry", f"$.resource.{p}", "string") for n, p in paths.items()}
    columns = ["id", "position", "resource_type", *paths]
    expected = bundle_entries(df).withColumns(read).select(columns)
    got = bundle_entries(df, fields=paths)
    assert got.columns == ["id", "fhir_bundle_json", "position", "resource_type", *paths]
    rows = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert rows == sorted(map(tuple, expected.collect()), key=str)
    assert (8, 1, "Observation", "7", 'a"\\\n') in rows and len(rows) == 14


def test_entries_are_not_copied_to_be_counted(spark, folder):
    plan = QUERIES["bundle_resource_counts"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "entry#" in plan and "resource.resourceType" in plan
    assert "array<variant>" not in plan.split("Generate")[0] and "$.resource." not in plan


def test_a_listed_value_is_not_copied_to_be_read(spark):
    df = with_json_items(spark.createDataFrame([('[{"name":"A"},7]',), ('"a;b"',), ("null",), ("7 days",)], "raw string"), {"raw": "items"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "$[0], ArrayType(VariantType" in plan
    assert [r["items"] for r in df.collect()] == [["A", "7"], ["a", "b"], [], ["7 days"]]
