import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import organisation, records
from tidemark.streaming import jobs

GOOD = dict(
    schema_ok=True, has_freeze=True, contract_hash="h", has_kill_test=True, null_artifact_all_fail=True, sabotage_rejected=None, signed=False,
    abort_events=0, source="human", token="t", couldnt_drive=0,
)
RECORDS = {
    "valid": ({}, [(1, "pass")], [], "PASS"),
    "no_freeze": ({"has_freeze": False}, [], [], "REJECTED"),
    "signed_skip": ({"has_freeze": False, "signed": True}, [], [], "UNVERIFIED"),
    "forged": ({"token": "other"}, [(1, "fail")], [], "DEGRADED-custody"),
    "tier1": ({}, [(1, "fail"), (1, "undriven")], [], "FAIL"),
    "tier2": ({}, [(2, "fail")], [], "PASS"),
    "undriven": ({}, [(2, "undriven")], [], "PARTIAL"),
    "awaiting": ({}, [(3, "escalated")], ["c0"], "AWAITING-TIER3-SIGNOFF"),
    "signed_off": ({"signed": True}, [(3, "escalated")], ["c0"], "PASS"),
    "orphan": ({}, [(3, "escalated")], [], "REJECTED"),
    "aborted": ({"abort_events": 1}, [(1, "fail")], [], "ABORTED"),
    "sabotage": ({"sabotage_rejected": False}, [], [], "REJECTED"),
    "bad_schema": ({"schema_ok": False, "has_freeze": False, "signed": True}, [], [], "REJECTED"),
}


def test_verdicts(spark, rows):
    schema = (
        "run_id string, schema_ok boolean, has_freeze boolean, contract_hash string, has_kill_test boolean, null_artifact_all_fail boolean, "
        "sabotage_rejected boolean, signed boolean, abort_events int, source string, token string, couldnt_drive int"
    )
    rec = spark.createDataFrame([(k, *{**GOOD, **v[0]}.values()) for k, v in RECORDS.items()], schema)
    cri = spark.createDataFrame([(k, f"c{i}", t, r) for k, v in RECORDS.items() for i, (t, r) in enumerate(v[1])], "run_id string, id string, tier int, result string")
    esc = spark.createDataFrame([(k, c) for k, v in RECORDS.items() for c in v[2]], "run_id string, criterion_id string")
    issued = spark.createDataFrame([(k, "t") for k in RECORDS], "run_id string, token string")
    got = dict(rows(records.certify(rec, cri, esc, issued), "run_id", "verdict"))
    assert got == {k: v[3] for k, v in RECORDS.items()}


def test_record_layout(spark, rows):
    ok = {"run_id": "r", "criteria_results": [{"id": "a", "tier": 1, "result": "pass"}], "operator_signoff": None}
    bad = {
        "ok": ok, "list": [], "empty_id": {"run_id": ""}, "tier": {**ok, "criteria_results": [{"id": 3, "tier": 9}]}, "signoff": {**ok, "operator_signoff": "me"},
        "readiness": {**ok, "readiness_verdict": {}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bad.items()] + [("text", "{")], "run string, json string")
    assert rows(records.schema_check(df), "run", "path", "error") == [
        ("empty_id", "$.run_id", "min_length"), ("list", "$", "type"), ("readiness", "$.readiness_verdict.source", "missing"),
        ("readiness", "$.readiness_verdict.verdict", "missing"), ("signoff", "$.operator_signoff", "type"), ("text", "$", "type"),
        ("tier", "$.criteria_results[0].id", "type"), ("tier", "$.criteria_results[0].result", "missing"), ("tier", "$.criteria_results[0].tier", "enum"),
    ]


def test_organisation_report(spark, rows):
    state = [
        ("a", False, 2, 1, "pass", "", "0", "no-access", "0", "protected"), ("b", False, 1, 0, "fail", "build", "0", "0", "0", "protected"),
        ("c", False, 0, 0, "pass", "", "3", "0", "0", "protected"), ("d", False, 0, 0, "none", "", "no-access", "no-access", "no-access", "unprotected"),
        ("e", True, None, None, None, None, None, None, None, None),
    ]
    schema = "repo string, unreachable boolean, open_prs int, draft_prs int, ci string, failing_workflows string, dependabot string, code_scanning string, secret_scanning string, protection string"
    df = spark.createDataFrame(state, schema)
    assert rows(organisation.headline(df), "repos", "failing_ci", "with_alerts", "unprotected", "unreachable", "open_prs") == [(5, 1, 1, 1, 1, 3)]
    assert rows(organisation.needs_attention(df), "repo", "reasons") == [
        ("b", "CI failing (build)"), ("c", "3 Dependabot alert(s)"), ("d", "default branch unprotected"), ("e", "could not assess (repo metadata unreadable)"),
    ]


def test_streams_drop_copies_and_keep_state(spark, rows, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.UTC)
    schema = "ts timestamp, repo string, sha string, path string, run long"
    batches = [[(day(1), "r", "a", "f", 1), (day(2), "r", "b", "f", 2)], [(day(2), "r", "b", "f", 2), (day(3), "r", "c", "f", 3)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*"))
    flat = jobs.churn_windows(stream().drop("run"), "30 days").select("repo", "path", F.col("window.start").alias("start"), "commits")
    assert rows(jobs.drain(spark, flat, "w", "update", ["repo", "path", "start"]), "path", "commits") == [("f", 3)]
    flagged = jobs.first_flagged(stream().select("repo", "path", "run"))
    assert rows(jobs.drain(spark, flagged, "s", "update", ["repo", "path"]), "first_flagged", "last_run", "runs") == [(1, 3, 4)]


def test_layer_score(spark, rows, tmp_path):
    layers = [(0, "Present"), (1, "Partial"), (6, "Present"), (7, "Present"), (8, None), (None, "Present")]
    verdicts = spark.createDataFrame([(r, *v) for r in ("kb", "soft", "mut", "twice", "odd", "unknown", None) for v in layers], "repo string, layer int, status string")
    kinds = [("kb", "knowledge-base", False), ("soft", "software", False), ("mut", "software", True), ("twice", "software", False), ("twice", "knowledge-base", None), ("odd", None, None), ("none", "software", True), (None, "software", True)]
    verdicts.write.parquet(str(tmp_path / "verdicts"))
    spark.createDataFrame(kinds, "repo string, archetype string, mutation_run boolean").write.parquet(str(tmp_path / "kinds"))
    scored = records.layer_score(spark.read.parquet(str(tmp_path / "verdicts")), spark.read.parquet(str(tmp_path / "kinds")))
    assert rows(scored, "repo", "score", "denominator") == [("kb", 1.5, 3), ("mut", 4.5, 8), ("odd", 1.5, 8), ("soft", 4.0, 8), ("twice", 5.5, 8)]
    # a row per repository is too much for one broadcast
    assert "BroadcastHashJoin" not in scored._jdf.queryExecution().executedPlan().toString()
