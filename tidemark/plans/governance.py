"""Queries over snapshots, organisations, records, reviews and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.operators import organisation, records, snapshots
from tidemark.plans.catalog import query
from tidemark.plans.history import r6
from tidemark.plans.signals import sql_text
from tidemark.plans.tables import Tables
from tidemark.staging import staged_path
from tidemark.streaming import jobs

# --- snapshots -------------------------------------------------------------

DIFF = """dif AS (SELECT coalesce(p.repo, c.repo) AS repo, coalesce(p.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'graduated' WHEN p.path IS NULL THEN 'new'
        WHEN c.ccn - p.ccn > 0 OR (c.loc - p.loc > 50 AND c.commits - p.commits > 2) THEN 'regressed' ELSE 'persistent' END AS status,
        CASE WHEN p.path IS NULL OR c.path IS NULL THEN 0 ELSE c.ccn - p.ccn END AS ccn_delta, CASE WHEN p.path IS NULL OR c.path IS NULL THEN 0 ELSE c.commits - p.commits END AS commits_delta,
        CASE WHEN p.path IS NULL OR c.path IS NULL THEN 0 ELSE c.loc - p.loc END AS loc_delta FROM snap_prior p FULL JOIN snap_current c ON p.repo = c.repo AND p.path = c.path)"""


def transitions(t: Tables):
    return snapshots.hotspot_transitions(t.snap_prior, t.snap_current)


@query("hotspot_transitions", f"WITH {DIFF} SELECT * FROM dif")
def hotspot_transitions(t: Tables):
    return transitions(t)


@query("snapshot_full_outer_join", f"WITH {DIFF} SELECT repo, status, count(*) AS n FROM dif GROUP BY repo, status")
def snapshot_full_outer_join(t: Tables):
    return transitions(t).groupBy("repo", "status").agg(F.count(F.lit(1)).alias("n"))


@query("hotspot_transition_sets", f"WITH {DIFF} SELECT repo, path, status FROM dif WHERE status IN ('graduated', 'new')")
def hotspot_transition_sets(t: Tables):
    return snapshots.transition_sets(t.snap_prior, t.snap_current)


RUN_META = """c_name AS repo, c_custkey % 9 <> 0 AS prior_exists, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v1.2.3' WHEN 2 THEN '2.0.0' WHEN 3 THEN 'dev' ELSE '2.1.0' END AS prior_version, '2.3.4' AS version,
    c_nationkey % 2 AS prior_schema, 1 AS schema, CASE WHEN c_nationkey % 3 = 0 THEN '1.17' END AS prior_lizard, CASE WHEN c_nationkey > 10 THEN '1.18' ELSE '1.17' END AS lizard, '3.1' AS prior_scc, CASE WHEN c_nationkey = 5 THEN '3.2' ELSE '3.1' END AS scc"""


@query(
    "diff_reliability",
    f"""WITH m AS (SELECT {RUN_META} FROM customer), n AS (SELECT repo, CASE WHEN NOT prior_exists THEN NULL WHEN prior_version IS NULL THEN 'version not stamped in prior snapshot' WHEN prior_version = 'dev' THEN 'unparseable version dev, 2.3.4'
        WHEN prior_schema <> schema THEN concat('schema version changed ', prior_schema, '->', schema) WHEN prior_version = 'v1.2.3' THEN 'major version changed v1.2.3->2.3.4'
        WHEN prior_lizard <> lizard THEN concat('lizard version changed ', prior_lizard, '->', lizard) WHEN prior_scc <> scc THEN 'scc version changed 3.1->3.2' END AS note FROM m)
    SELECT repo, note IS NULL AS reliable, note, coalesce(starts_with(note, 'major'), false) AS trend_reset FROM n""",
)
def diff_reliability(t: Tables):
    return snapshots.diff_reliability(t.customer.selectExpr(*RUN_META_COLUMNS))


RUN_META_COLUMNS = [
    "c_name AS repo", "c_custkey % 9 <> 0 AS prior_exists",
    "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'v1.2.3' WHEN 2 THEN '2.0.0' WHEN 3 THEN 'dev' ELSE '2.1.0' END AS prior_version",
    "'2.3.4' AS version", "c_nationkey % 2 AS prior_schema", "1 AS schema", "CASE WHEN c_nationkey % 3 = 0 THEN '1.17' END AS prior_lizard",
    "CASE WHEN c_nationkey > 10 THEN '1.18' ELSE '1.17' END AS lizard", "'3.1' AS prior_scc", "CASE WHEN c_nationkey = 5 THEN '3.2' ELSE '3.1' END AS scc",
]


@query(
    "run_anomalies",
    """WITH r AS (SELECT c_name AS repo, c_custkey % 400 AS files, c_nationkey % 3 AS p95, c_nationkey % 9 AS mx, c_custkey % 11 AS hot, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 11 ELSE 1 END AS nw, c_nationkey % 4 AS per, c_acctbal > 0 AS prior FROM customer)
    SELECT repo, 'ZERO_FILES_SCORED' AS code, 'files_scored=0' AS detail FROM r WHERE files = 0 UNION ALL SELECT repo, 'ZERO_COMPLEXITY', concat('files_scored=', files, ', ccn_p95=0, ccn_max=0') FROM r WHERE files > 5 AND p95 = 0 AND mx = 0
    UNION ALL SELECT repo, 'EMPTY_HOTSPOTS', concat('files_scored=', files, ', hotspots_count=0') FROM r WHERE files > 200 AND hot = 0
    UNION ALL SELECT repo, 'ALL_NEW_HOTSPOTS', concat('hotspot_count=', hot, ', new_count=', nw, ', persistent_count=0') FROM r WHERE prior AND hot > 5 AND nw = hot AND per = 0
    UNION ALL SELECT c_name, 'INSTRUCTION_FILE_GRADE_MISMATCH', concat('file=AGENTS.md, line_count=', c_custkey % 500, ', grade=F') FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 500 > 200""",
)
def run_anomalies(t: Tables):
    runs = t.customer.selectExpr(
        "c_name AS repo", "c_custkey % 400 AS files_scored", "c_nationkey % 3 AS ccn_p95", "c_nationkey % 9 AS ccn_max", "c_custkey % 11 AS hotspots",
        "CASE WHEN c_nationkey % 2 = 0 THEN c_custkey % 11 ELSE 1 END AS new", "c_nationkey % 4 AS persistent", "c_acctbal > 0 AS prior_exists",
    )
    graded = t.customer.selectExpr(
        "c_name AS repo", "'docs/AGENTS.md' AS path", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'F' ELSE 'B' END AS grade", "c_custkey % 500 AS lines"
    )
    return snapshots.run_anomalies(runs, graded)


FLAGGED = """flagged AS (SELECT repo, path, CASE WHEN min(ts // 31557600) < 26 THEN 'unknown' ELSE CAST(min(ts // 31557600) AS VARCHAR) END AS first_flagged, max(ts // 31557600) AS last_run FROM numstat_ts GROUP BY repo, path)"""
NUMSTAT_TS = "numstat_ts AS (SELECT repo, path, author_ts AS ts FROM numstat)"


def flagged(t: Tables):
    runs = t.numstat.select("repo", "path", F.floor(F.col("author_ts") / 31557600).alias("run"))
    return snapshots.first_flagged(runs, 26)


@query("first_flagged_carry", f"WITH {NUMSTAT_TS}, {FLAGGED} SELECT repo, path, first_flagged, last_run FROM flagged")
def first_flagged_carry(t: Tables):
    return flagged(t)


@query(
    "hotspot_index",
    f"""WITH {DIFF}, rows AS (SELECT c.repo, c.path, d.status FROM snap_current c JOIN dif d USING (repo, path) UNION ALL SELECT repo, path, status FROM dif WHERE status = 'graduated')
    SELECT r.repo, r.path, r.status, CASE WHEN p.path IS NULL THEN 'unknown' ELSE 'run-' || p.commits END AS first_flagged, CASE WHEN c.ccn > 0 THEN c.ccn ELSE p.ccn END AS ccn, coalesce(c.loc, p.loc) AS loc
    FROM rows r LEFT JOIN snap_current c USING (repo, path) LEFT JOIN snap_prior p USING (repo, path)""",
)
def hotspot_index(t: Tables):
    first = t.snap_current.select("repo", "path", "loc", F.when(F.col("ccn") > 0, F.col("ccn")).alias("ccn"))
    known = t.snap_prior.select("repo", "path", F.concat(F.lit("run-"), "commits").alias("first_flagged"))
    return snapshots.hotspot_index(t.snap_current, transitions(t), [first, t.snap_prior], known)


@query(
    "orphan_hotspot_pages",
    "SELECT repo, path FROM (SELECT repo, concat('r', rk, '/n', nk, '/s', file_id, CASE WHEN mix % 3 = 0 THEN '.py' ELSE '.old' END) AS path, mix FROM pages_of_repo) WHERE ends_with(path, '.old') AND mix % 2 = 0",
)
def orphan_hotspot_pages(t: Tables):
    pages = t.pages_of_repo.selectExpr(
        "repo", "concat('r', rk, '/n', nk, '/s', file_id, CASE WHEN mix % 3 = 0 THEN '.py' ELSE '.old' END) AS path",
        f"CASE WHEN mix % 2 = 0 THEN 'new' ELSE '{fv.RETIRED_STATUS}' END AS status",
    )
    return snapshots.orphan_pages(pages, t.tracked)


# --- organisation ----------------------------------------------------------

LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, workflow_id ORDER BY created_at DESC, run_id DESC) AS rn FROM workflow_runs WHERE status = 'completed') x WHERE rn = 1)"""


@query("latest_per_workflow", f"WITH {LATEST} SELECT repo, workflow_id, run_id, conclusion, created_at FROM latest")
def latest_per_workflow(t: Tables):
    return organisation.latest_per_workflow(t.workflow_runs)


@query(
    "default_branch_ci",
    f"WITH {LATEST} SELECT repo, CASE WHEN bool_or(conclusion = 'failure') THEN 'fail' ELSE 'pass' END AS ci, coalesce(string_agg(workflow_id, ', ' ORDER BY workflow_id) FILTER (conclusion = 'failure'), '') AS failing FROM latest GROUP BY repo",
)
def default_branch_ci(t: Tables):
    return organisation.default_branch_ci(t.workflow_runs, t.workflow_runs)


@query("pull_request_counts", "SELECT repo, count(*) AS open, count(*) FILTER (draft) AS draft FROM prs GROUP BY repo")
def pull_request_counts(t: Tables):
    return organisation.pull_request_counts(t.prs)


ALERTED = "(TRY_CAST(dependabot AS INT) > 0 OR TRY_CAST(code_scanning AS INT) > 0 OR TRY_CAST(secret_scanning AS INT) > 0)"


@query(
    "org_state_headline",
    f"""SELECT count(*) AS repos, count(*) FILTER (ci = 'fail') AS failing_ci, count(*) FILTER (coalesce({ALERTED}, false)) AS with_alerts, count(*) FILTER (protection = 'unprotected') AS unprotected,
        count(*) FILTER (unreachable) AS unreachable, CAST(sum(coalesce(open_prs, 0)) AS BIGINT) AS open_prs FROM repo_state""",
)
def org_state_headline(t: Tables):
    return organisation.headline(t.repo_state)


@query(
    "needs_attention",
    """SELECT repo, reasons FROM (SELECT repo, concat_ws('; ', CASE WHEN unreachable THEN 'could not assess (repo metadata unreadable)' END, CASE WHEN ci = 'fail' THEN 'CI failing (' || failing_workflows || ')' END,
        CASE WHEN TRY_CAST(dependabot AS INT) > 0 THEN dependabot || ' Dependabot alert(s)' END, CASE WHEN TRY_CAST(code_scanning AS INT) > 0 THEN code_scanning || ' code-scanning alert(s)' END,
        CASE WHEN TRY_CAST(secret_scanning AS INT) > 0 THEN secret_scanning || ' secret-scanning alert(s)' END, CASE WHEN protection = 'unprotected' THEN 'default branch unprotected' END) AS reasons FROM repo_state) WHERE reasons <> ''""",
)
def needs_attention(t: Tables):
    return organisation.needs_attention(t.repo_state)


def cell(name: str) -> str:
    return f"CASE WHEN unreachable THEN '-' WHEN {name} = 'no-access' THEN 'n/a' ELSE {name} END AS {name}"


@query(
    "org_table_by_repo",
    f"""SELECT repo, CASE WHEN unreachable THEN '-' ELSE open_prs || CASE WHEN draft_prs > 0 THEN ' (' || draft_prs || ' draft)' ELSE '' END END AS prs, CASE WHEN unreachable THEN '-' ELSE ci END AS ci, {cell('dependabot')}, {cell('code_scanning')}, {cell('secret_scanning')},
        CASE WHEN unreachable THEN 'could not assess' ELSE protection END AS protection FROM repo_state""",
)
def org_table_by_repo(t: Tables):
    return organisation.state_table(t.repo_state)


def listing(t: Tables):
    return t.customer.selectExpr(
        "concat('svc-', c_custkey % 700) AS repo", "c_nationkey = 3 AS archived", "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'main' END AS default_branch"
    )


def team_listing(t: Tables):
    return t.supplier.selectExpr("concat('svc-', s_suppkey * 5) AS repo", "s_acctbal < 0 AS archived", "'main' AS default_branch")


LISTED = """org_l AS (SELECT concat('svc-', c_custkey % 700) AS repo FROM customer WHERE c_nationkey <> 3 AND c_mktsegment <> 'HOUSEHOLD'), team_l AS (SELECT concat('svc-', s_suppkey * 5) AS repo FROM supplier WHERE s_acctbal >= 0)"""


@query("active_repo_filter", f"WITH {LISTED} SELECT repo FROM org_l")
def active_repo_filter(t: Tables):
    return organisation.active_repos(listing(t))


@query("repo_discovery_union", f"WITH {LISTED} SELECT repo FROM org_l UNION SELECT repo FROM team_l")
def repo_discovery_union(t: Tables):
    return organisation.discover(listing(t), team_listing(t))


@query("repo_denylist_anti_join", f"WITH {LISTED} SELECT repo FROM org_l UNION SELECT repo FROM team_l EXCEPT SELECT concat('svc-', n_nationkey * 10) FROM nation")
def repo_denylist_anti_join(t: Tables):
    denied = t.nation.selectExpr("concat('svc-', n_nationkey * 10) AS repo")
    return organisation.without_denied(organisation.discover(listing(t), team_listing(t)), denied)


@query(
    "open_issue_queue",
    """SELECT concat('repo', o_orderkey % 20) AS repo, o_orderkey AS number, o_orderpriority = '1-URGENT' AS ready FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 100000""",
)
def open_issue_queue(t: Tables):
    label = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'agent-ready' WHEN '5-LOW' THEN 'blocked' ELSE 'bug' END")
    area = F.when(F.col("o_totalprice") > 100000, "core").otherwise("docs")
    issues = t.orders.select(
        F.concat(F.lit("repo"), F.col("o_orderkey") % 20).alias("repo"), F.col("o_orderkey").alias("number"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.array(label, area).alias("labels"),
    )
    return organisation.issue_queue(issues, ["blocked", "wontfix"], "core").select("repo", "number", "ready")


READY = """pr AS (SELECT repo20 AS repo, o_orderkey AS pr, CASE o_orderpriority WHEN '1-URGENT' THEN 'DIRTY' WHEN '2-HIGH' THEN 'UNSTABLE' ELSE 'CLEAN' END AS merge_state, o_totalprice > 90000 AS in_sync, o_custkey % 3 AS unanswered, o_custkey % 4 = 0 AS md FROM open_orders),
    base AS (SELECT repo20 AS repo, l_linenumber AS name, sum(l_quantity) % 2 = 0 AS failing FROM open_lines GROUP BY ALL),
    chk AS (SELECT l.repo20 AS repo, l.l_orderkey AS pr, bool_or(l_returnflag = 'R') AS failing, bool_or(l_returnflag = 'R' AND l_linestatus = 'O') AS req, bool_or(l_returnflag = 'R' AND b.failing) AS base_broken FROM open_lines l JOIN base b ON b.repo = l.repo20 AND b.name = l.l_linenumber GROUP BY ALL),
    th AS (SELECT repo20 AS repo, l_orderkey AS pr, bool_or(l_quantity <= 3) AS unres, bool_or(l_discount >= 0.095) AS unadd FROM open_lines GROUP BY ALL),
    rv AS (SELECT repo20 AS repo, l_orderkey AS pr, count(DISTINCT CASE WHEN l_tax <= 0.045 THEN l_suppkey END) AS app, count(*) FILTER (l_tax > 0.065) AS chg FROM open_lines WHERE l_discount <> 0.05 GROUP BY ALL),
    j AS (SELECT pr.*, coalesce(chk.failing, false) AS failing, coalesce(req, false) AS req, coalesce(base_broken, false) AS base_broken, coalesce(unres, false) AS unres, coalesce(unadd, false) AS unadd, coalesce(app, 0) AS app, coalesce(chg, 0) AS chg
        FROM pr LEFT JOIN chk USING (repo, pr) LEFT JOIN th USING (repo, pr) LEFT JOIN rv USING (repo, pr)),
    b2 AS (SELECT repo, pr, concat_ws(',', CASE WHEN NOT in_sync THEN 'out_of_sync' END, CASE WHEN failing THEN 'ci' END, CASE WHEN unadd THEN 'comments' END, CASE WHEN unanswered > 0 THEN 'conversation' END, CASE WHEN unres THEN 'threads' END) AS blockers,
        concat_ws(',', CASE WHEN NOT (merge_state = 'CLEAN' OR merge_state = 'UNSTABLE' AND NOT req) THEN 'merge_state' END, CASE WHEN app < CASE WHEN md THEN 0 ELSE 1 END THEN 'approvals' END, CASE WHEN chg > 0 THEN 'changes_requested' END, CASE WHEN base_broken THEN 'base_branch' END) AS merge_blockers FROM j)"""


@query("pr_merge_readiness", f"WITH {READY} SELECT repo, pr, blockers = '' AS ready, blockers, merge_blockers = '' AS auto_merge, merge_blockers FROM b2")
def pr_merge_readiness(t: Tables):
    prs = t.open_orders.selectExpr(
        "repo20 AS repo", "o_orderkey AS pr", "CASE o_orderpriority WHEN '1-URGENT' THEN 'DIRTY' WHEN '2-HIGH' THEN 'UNSTABLE' ELSE 'CLEAN' END AS merge_state",
        "o_totalprice > 90000 AS in_sync", "o_custkey % 3 AS unanswered", "o_custkey % 4 = 0 AS markdown_only",
    )
    lines = t.open_lines
    checks = lines.selectExpr(
        "repo20 AS repo", "l_orderkey AS pr", "CASE l_returnflag WHEN 'R' THEN 'failure' WHEN 'A' THEN 'success' ELSE 'skipped' END AS state",
        "l_linestatus = 'O' AS required", "l_linenumber AS name",
    )
    threads = lines.selectExpr("repo20 AS repo", "l_orderkey AS pr", "l_quantity > 3 AS resolved", "l_discount < 0.095 AS addressed")
    reviews = lines.selectExpr(
        "repo20 AS repo", "l_orderkey AS pr", "l_suppkey AS reviewer",
        "CASE WHEN l_tax > 0.065 THEN 'CHANGES_REQUESTED' WHEN l_tax <= 0.045 THEN 'APPROVED' ELSE 'COMMENTED' END AS state", "l_discount = 0.05 AS dismissed",
    )
    base = lines.groupBy(F.col("repo20").alias("repo"), F.col("l_linenumber").alias("name")).agg((F.sum("l_quantity") % 2 == 0).alias("failing"))
    return organisation.merge_readiness(prs, checks, threads, reviews, base)


# --- records ---------------------------------------------------------------

RECORD_JSON = """CASE o_orderkey % 11 WHEN 0 THEN 'not json' ELSE concat('{', CASE o_orderkey % 11 WHEN 1 THEN '"run_id": "", ' WHEN 2 THEN '' WHEN 6 THEN '"run_id": 5, ' ELSE concat('"run_id": "r', o_orderkey, '", ') END,
    '"contract_hash": null, "criteria_results": [{"id": "c1", "tier": 1, "result": "pass"}, {"id": "c2", "tier": ', CASE o_orderkey % 11 WHEN 3 THEN '4' ELSE '2' END, ', "result": "', CASE o_orderkey % 11 WHEN 4 THEN 'maybe' ELSE 'fail' END, '"}], ',
    '"readiness_verdict": {', CASE o_orderkey % 11 WHEN 8 THEN '' ELSE '"verdict": "ok", ' END, '"source": "', CASE o_orderkey % 11 WHEN 5 THEN 'robot' ELSE 'human' END, '"}, "couldnt_drive": ', CASE o_orderkey % 11 WHEN 7 THEN '"x"' ELSE '[]' END,
    ', "tier3_escalations": [{"criterion_id": "c9"', CASE o_orderkey % 11 WHEN 9 THEN '' ELSE ', "artifact_path": "p"' END, '}]}') END"""


@query(
    "record_schema_check",
    """SELECT o_orderkey AS run, CASE o_orderkey % 11 WHEN 0 THEN '$' WHEN 3 THEN '$.criteria_results[1].tier' WHEN 4 THEN '$.criteria_results[1].result' WHEN 5 THEN '$.readiness_verdict.source' WHEN 7 THEN '$.couldnt_drive' WHEN 8 THEN '$.readiness_verdict.verdict'
        WHEN 9 THEN '$.tier3_escalations[0].artifact_path' ELSE '$.run_id' END AS path, CASE o_orderkey % 11 WHEN 0 THEN 'type' WHEN 1 THEN 'min_length' WHEN 2 THEN 'missing' WHEN 6 THEN 'type' WHEN 7 THEN 'type' WHEN 8 THEN 'missing' WHEN 9 THEN 'missing' ELSE 'enum' END AS error
        FROM orders WHERE o_orderkey % 11 <> 10""",
)
def record_schema_check(t: Tables):
    return records.schema_check(t.orders.select(F.col("o_orderkey").alias("run"), F.expr(RECORD_JSON).alias("json")))


RECORDS = [
    "o_orderkey AS run_id", "o_custkey % 50 <> 0 AS schema_ok", "o_custkey % 7 <> 1 AS has_freeze", "CASE WHEN o_custkey % 40 = 3 THEN '' ELSE 'h' END AS contract_hash",
    "o_custkey % 40 <> 4 AS has_kill_test", "CASE WHEN o_custkey % 40 = 5 THEN false WHEN o_custkey % 40 = 6 THEN NULL ELSE true END AS null_artifact_all_fail",
    "CASE WHEN o_custkey % 40 = 8 THEN false WHEN o_custkey % 2 = 0 THEN true END AS sabotage_rejected", "o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS signed",
    "CASE WHEN o_custkey % 30 = 9 THEN 1 ELSE 0 END AS abort_events", "CASE o_orderstatus WHEN 'F' THEN 'none' ELSE 'human' END AS source",
    "concat(CASE WHEN o_custkey % 13 = 0 THEN 'x' ELSE 't' END, o_custkey) AS token", "CASE WHEN o_custkey % 17 = 0 THEN 2 ELSE 0 END AS couldnt_drive",
]
CRITERIA = "SELECT l_orderkey AS run_id, concat('c', l_linenumber) AS id, l_suppkey % 3 + 1 AS tier, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'fail' WHEN l_returnflag = 'N' AND l_quantity > 48 THEN 'undriven' WHEN l_returnflag = 'N' AND l_quantity < 3 THEN 'escalated' ELSE 'pass' END AS result, l_linestatus FROM"
CERT = f"""rec AS (SELECT {', '.join(RECORDS)}, o_custkey, o_orderpriority FROM orders), cri AS ({CRITERIA} lineitem), esc AS (SELECT DISTINCT run_id, id FROM cri WHERE result = 'escalated' AND l_linestatus = 'O'),
    agg AS (SELECT c.run_id, count(*) FILTER (tier = 1 AND result = 'fail') AS t1, count(*) FILTER (result = 'undriven') AS und, count(*) FILTER (result = 'escalated' AND e.id IS NULL) AS orp FROM cri c LEFT JOIN esc e ON e.run_id = c.run_id AND e.id = c.id GROUP BY c.run_id),
    es AS (SELECT run_id, count(*) AS n FROM esc GROUP BY run_id),
    r2 AS (SELECT rec.*, coalesce(t1, 0) AS t1, coalesce(und, 0) AS und, coalesce(orp, 0) AS orp, coalesce(es.n, 0) AS t3, token = concat('t', o_custkey) AND o_orderpriority <> '1-URGENT' AS tok FROM rec LEFT JOIN agg USING (run_id) LEFT JOIN es USING (run_id)),
    r3 AS (SELECT *, CASE WHEN NOT schema_ok THEN 'REJECTED' WHEN NOT has_freeze THEN CASE WHEN signed THEN 'UNVERIFIED' ELSE 'REJECTED' END WHEN contract_hash = '' OR NOT has_kill_test OR NOT coalesce(null_artifact_all_fail, false) OR NOT coalesce(sabotage_rejected, true) THEN 'REJECTED'
        WHEN abort_events > 0 THEN 'ABORTED' WHEN orp > 0 THEN 'REJECTED' END AS refused FROM r2),
    r4 AS (SELECT *, coalesce(refused, CASE WHEN NOT tok THEN 'DEGRADED-custody' WHEN t1 > 0 THEN 'FAIL' WHEN t3 > 0 AND NOT signed THEN 'AWAITING-TIER3-SIGNOFF' WHEN couldnt_drive > 0 OR und > 0 THEN 'PARTIAL' ELSE 'PASS' END) AS verdict FROM r3)"""


def record_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rec = t.orders.selectExpr(*RECORDS)
    cri = t.spark.sql(CRITERIA + " {lines}", lines=t.lineitem)
    esc = cri.where("result = 'escalated' AND l_linestatus = 'O'").select("run_id", F.col("id").alias("criterion_id")).distinct()
    issued = t.orders.where("o_orderpriority <> '1-URGENT'").selectExpr("o_orderkey AS run_id", "concat('t', o_custkey) AS token")
    return rec, cri.drop("l_linestatus"), esc, issued


@query(
    "run_certification",
    f"""WITH {CERT} SELECT run_id, verdict, verdict = 'PASS' AS certified, CASE WHEN refused = 'UNVERIFIED' THEN 'contract-skipped' WHEN refused IS NOT NULL THEN '' ELSE concat_ws('; ', CASE WHEN source = 'none' THEN '{fv.STAMP_DEGRADED}' END, CASE WHEN NOT tok THEN '{fv.STAMP_CUSTODY}' END,
        CASE WHEN couldnt_drive > 0 OR und > 0 THEN 'PARTIAL' END) END AS stamps FROM r4""",
)
def run_certification(t: Tables):
    return records.certify(*record_tables(t))


@query("provenance_token_join", f"WITH {CERT} SELECT run_id, tok AS token_ok FROM r2")
def provenance_token_join(t: Tables):
    rec, _, _, issued = record_tables(t)
    return records.token_check(rec, issued)


# results without a discount carry an id that no criterion has; criteria of large amounts one that no result has
RESULT_ID = "CASE WHEN l_discount <= 0.005 THEN l_linenumber + 1000 ELSE l_linenumber END"
CRITERION_ID = "CASE WHEN l_quantity >= 45 THEN l_linenumber + 2000 ELSE l_linenumber END"
KILL = f"SELECT l_orderkey AS contract, {RESULT_ID} AS id, CASE WHEN l_tax > 0.005 THEN l_returnflag = 'R' END AS passed FROM lineitem"


def kill_results(t: Tables):
    return t.lineitem.selectExpr("l_orderkey AS contract", f"{RESULT_ID} AS id", "CASE WHEN l_tax > 0.005 THEN l_returnflag = 'R' END AS passed")


@query(
    "criterion_result_join",
    f"""WITH k AS ({KILL}), c AS (SELECT DISTINCT l_orderkey AS contract, {CRITERION_ID} AS id FROM lineitem), g AS (SELECT contract, id, count(*) AS n, count(*) FILTER (passed IS NULL) AS unclear, bool_and(passed) AS passed FROM k GROUP BY ALL)
    SELECT contract, id, reason FROM (SELECT coalesce(c.contract, g.contract) AS contract, coalesce(c.id, g.id) AS id, CASE WHEN c.id IS NULL THEN 'unknown' WHEN g.id IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN unclear > 0 THEN 'not_boolean' WHEN passed THEN 'vacuous' END AS reason
        FROM c FULL JOIN g ON g.contract = c.contract AND g.id = c.id) WHERE reason IS NOT NULL""",
)
def criterion_result_join(t: Tables):
    criteria = t.lineitem.selectExpr("l_orderkey AS contract", f"{CRITERION_ID} AS id")
    return records.criterion_results(criteria, kill_results(t))


@query(
    "contract_vacuity",
    f"""WITH k AS ({KILL}), v AS (SELECT DISTINCT contract, id FROM k WHERE passed), c AS (SELECT o_orderkey AS contract, CASE o_orderpriority WHEN '1-URGENT' THEN 'cli' WHEN '2-HIGH' THEN 'interactive' WHEN '3-MEDIUM' THEN 'report' ELSE 'refactor' END AS cls FROM orders),
    f AS (SELECT l.l_orderkey AS contract, c.cls, l.l_suppkey % 3 + 1 AS tier, l_returnflag = 'A' AS justified, v.id IS NOT NULL AS vac FROM lineitem l JOIN c ON c.contract = l.l_orderkey LEFT JOIN v ON v.contract = l.l_orderkey AND v.id = l.l_linenumber),
    a AS (SELECT contract, cls, count(*) FILTER (vac) AS vacuous, count(*) FILTER (NOT justified AND cls = 'refactor' AND tier < 2) AS downgrades, bool_or(tier = 3) AS t3 FROM f GROUP BY ALL)
    SELECT contract, vacuous, downgrades, cls = 'interactive' AND NOT t3 AS interactive_without_tier3, vacuous = 0 AND downgrades = 0 AND NOT (cls = 'interactive' AND NOT t3) AS ok FROM a""",
)
def contract_vacuity(t: Tables):
    contracts = t.orders.selectExpr(
        "o_orderkey AS contract", "CASE o_orderpriority WHEN '1-URGENT' THEN 'cli' WHEN '2-HIGH' THEN 'interactive' WHEN '3-MEDIUM' THEN 'report' ELSE 'refactor' END AS cls"
    )
    criteria = t.lineitem.selectExpr(
        "l_orderkey AS contract", "l_linenumber AS id", "l_suppkey % 3 + 1 AS tier", "CASE WHEN l_returnflag = 'A' THEN 'needed' ELSE ' ' END AS justification"
    )
    return records.contract_vacuity(contracts, criteria, kill_results(t))


def floor_texts(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = fv.FLOOR_MARKER
    base = t.documents.select(F.col("doc_id").alias("file"), F.concat("text", F.lit(f"\n {m} \nrun start_gate.py then start_gate.py")).alias("text"))
    tail = F.expr(
        f"CASE n_chars % 4 WHEN 0 THEN '\\n{m}\\nrun start_gate.py then start_gate.py' WHEN 1 THEN '\\nrun start_gate.py then start_gate.py' "
        f"WHEN 2 THEN '\\n{m}\\nrun start_gate.py' ELSE '\\nsee {m} here, start_gate.py start_gate.py' END"
    )
    return base, t.documents.select(F.col("doc_id").alias("file"), F.concat("text", tail).alias("text"))


@query(
    "weakened_tokens",
    f"""SELECT doc_id AS file, CASE n_chars % 4 WHEN 2 THEN 'start_gate.py' ELSE {sql_text(fv.FLOOR_MARKER)} END AS token, CASE n_chars % 4 WHEN 2 THEN 2 ELSE 1 END AS base_n, CASE n_chars % 4 WHEN 1 THEN 0 ELSE 1 END AS head_n FROM documents WHERE n_chars % 4 <> 0""",
)
def weakened_tokens(t: Tables):
    return records.weakened_tokens(*floor_texts(t))


@query(
    "missing_clauses",
    """SELECT doc_id AS file, unnest(CASE n_chars % 3 WHEN 0 THEN ['ii', 'iii', 'iv'] WHEN 1 THEN ['i', 'iii', 'iv'] ELSE ['i', 'ii', 'iii', 'iv'] END) AS clause FROM documents""",
)
def missing_clauses(t: Tables):
    tail = F.expr(
        "CASE n_chars % 3 WHEN 0 THEN '<!-- floor-clause:i --> run-complete' WHEN 1 THEN '<!-- floor-clause:ii --> unamendable' ELSE '<!-- floor-clause:iii --> none' END"
    )
    return records.missing_clauses(t.documents.select(F.col("doc_id").alias("file"), F.concat("text", F.lit("\n"), tail).alias("text")))


LAYERS = """lay AS (SELECT c_name AS repo, layer, CASE (c_custkey + layer) % 3 WHEN 0 THEN 'Present' WHEN 1 THEN 'Partial' ELSE 'Missing' END AS status, c_nationkey % 5 = 0 AS kb, c_custkey % 2 = 0 AS mut FROM customer, (SELECT unnest(range(0, 9)) AS layer)),
    pts AS (SELECT repo, any_value(kb) AS kb, sum(CASE WHEN kb AND layer NOT IN (0, 1, 8) THEN 0.0 WHEN layer = 6 AND NOT mut THEN CASE status WHEN 'Missing' THEN 0.0 ELSE 0.5 END WHEN status = 'Present' THEN 1.0 WHEN status = 'Partial' THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM lay GROUP BY repo),
    sc AS (SELECT repo, score, CASE WHEN kb THEN 3 ELSE 8 END AS denominator FROM pts)"""
BAND = "CASE WHEN score / denominator >= 0.875 THEN 'AI-Native' WHEN score / denominator >= 0.625 THEN 'Solid' WHEN score / denominator >= 0.375 THEN 'Basic' ELSE 'Not Ready' END"


def layer_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    layers = F.explode(F.sequence(F.lit(0), F.lit(8)))
    rows = t.customer.select(F.col("c_name").alias("repo"), "c_custkey", layers.alias("layer"))
    status = F.expr("CASE (c_custkey + layer) % 3 WHEN 0 THEN 'Present' WHEN 1 THEN 'Partial' ELSE 'Missing' END")
    applicable = t.customer.selectExpr(
        "c_name AS repo", "CASE WHEN c_nationkey % 5 = 0 THEN 'knowledge-base' ELSE 'software' END AS archetype", "c_custkey % 2 = 0 AS mutation_run"
    )
    return rows.select("repo", "layer", status.alias("status")), applicable


@query(
    "layer_score",
    f"""WITH {LAYERS} SELECT repo, score, denominator, {BAND} AS band, CASE WHEN score / denominator >= 0.875 THEN 'brightgreen' WHEN score / denominator >= 0.6875 THEN 'green' WHEN score / denominator >= 0.5 THEN 'yellowgreen' WHEN score / denominator >= 0.3125 THEN 'yellow'
        WHEN score / denominator >= 0.125 THEN 'orange' ELSE 'red' END AS color FROM sc""",
)
def layer_score(t: Tables):
    return records.layer_score(*layer_inputs(t))


@query("maturity_band", f"WITH {LAYERS} SELECT {BAND} AS band, denominator, count(*) AS n FROM sc GROUP BY ALL")
def maturity_band(t: Tables):
    return records.layer_score(*layer_inputs(t)).groupBy("band", "denominator").agg(F.count(F.lit(1)).alias("n"))


FINALIZE = [
    "c_name AS repo", "CASE WHEN c_custkey % 10 = 0 THEN 'run-x' ELSE 'run-1' END AS run_id", "c_custkey % 10 * 1.0D AS score", "CASE WHEN c_nationkey % 6 = 0 THEN 3 ELSE 8 END AS denominator",
    "CASE WHEN c_custkey % 3 = 0 THEN 'Solid' WHEN c_custkey % 3 = 1 THEN 'Knowledge Base · not ready yet' ELSE 'Basic or Solid' END AS label", "CASE WHEN c_custkey % 4 = 0 THEN 1.0D ELSE 0.5D END AS layer6",
]


@query(
    "finalize_checks",
    f"""WITH f AS (SELECT {', '.join(FINALIZE).replace('1.0D', '1e0').replace('0.5D', '5e-1')}, c_nationkey, c_custkey FROM customer), b AS (SELECT *, {BAND} AS band FROM f)
    SELECT repo, 'run_id_mismatch' AS violation FROM f WHERE run_id = 'run-x' UNION ALL SELECT repo, 'denominator_mismatch' FROM f WHERE denominator = 3 UNION ALL SELECT repo, 'score_exceeds_denominator' FROM f WHERE score > denominator
    UNION ALL SELECT repo, 'maturity_mismatch' FROM b WHERE c_custkey % 3 = 0 AND band <> 'Solid' OR c_custkey % 3 = 1 AND band <> 'Not Ready' UNION ALL SELECT repo, 'layer6_cap' FROM f WHERE c_nationkey > 6 AND layer6 > 0.5
    UNION ALL SELECT repo, concat('unknown_hotspot:', path) FROM hot_s WHERE rank > 7""",
)
def finalize_checks(t: Tables):
    context = t.customer.selectExpr("c_name AS repo", "'run-1' AS run_id", "8 AS denominator", "c_nationkey <= 6 AS mutation_run")
    return records.finalize_checks(t.customer.selectExpr(*FINALIZE), context, t.hot_s, t.hot_s.where("rank <= 7"))


# --- comparisons and reviews -----------------------------------------------


@query(
    "ab_equivalence_summary",
    """WITH a AS (SELECT pair_id, count(*) FILTER (verdict = 'candidate-regressed') AS regressions, count(*) FILTER (verdict = 'candidate-diverged') AS divergences, count(*) FILTER (verdict = 'equivalent') AS equivalents,
        round(avg(candidate_directness - original_directness), 6) AS directness_gain FROM ab_cases GROUP BY pair_id) SELECT *, regressions = 0 AS pass, regressions = 0 AND directness_gain > 0 AS efficiency_gain FROM a""",
)
def ab_equivalence_summary(t: Tables):
    out = records.equivalence_summary(t.ab_cases)
    return out.withColumn("directness_gain", F.round("directness_gain", 6))


@query(
    "distill_rounds",
    """WITH b AS (SELECT doc, max(characters) FILTER (is_original) AS original, count(*) FILTER (NOT is_original) AS rounds, arg_min(round, (characters, round)) FILTER (passed AND NOT is_original) AS best_round, min(characters) FILTER (passed AND NOT is_original) AS best FROM rounds GROUP BY doc)
    SELECT doc, best_round, round(coalesce(best, original) / original, 6) AS ratio, round(coalesce(best, original) / 4, 6) AS tokens, 12 * (1 + rounds) AS runner_cost, 72 AS estimated_cost FROM b""",
)
def distill_rounds(t: Tables):
    return records.distill_rounds(t.rounds, 12).select("doc", "best_round", r6("ratio"), r6("tokens"), "runner_cost", "estimated_cost")


TRANSFER = """cs AS (SELECT l_orderkey AS doc, l_linenumber AS case_id, CASE l_suppkey % 4 WHEN 0 THEN 'happy-path' WHEN 1 THEN 'edge-case' WHEN 2 THEN 'adversarial' ELSE 'composition' END AS type, CAST(l_partkey % 6 AS INT) AS section FROM lineitem),
    se AS (SELECT o_orderkey AS doc, unnest(range(0, 4 + o_custkey % 3)) AS section FROM orders)"""


def transfer_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    cases = t.lineitem.selectExpr(
        "l_orderkey AS doc", "l_linenumber AS case_id", "CASE l_suppkey % 4 WHEN 0 THEN 'happy-path' WHEN 1 THEN 'edge-case' WHEN 2 THEN 'adversarial' ELSE 'composition' END AS type",
        "l_partkey % 6 AS section",
    )
    sections = t.orders.select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), 3 + F.col("o_custkey") % 3)).alias("section"))
    return cases, sections


@query(
    "transfer_set_coverage",
    f"""WITH {TRANSFER}, p AS (SELECT doc, count(DISTINCT case_id) AS cases, count(DISTINCT type) AS types FROM cs GROUP BY doc), c AS (SELECT se.doc, count(*) AS identified, count(u.section) AS covered FROM se LEFT JOIN (SELECT DISTINCT doc, section FROM cs) u ON u.doc = se.doc AND u.section = se.section GROUP BY se.doc)
    SELECT c.doc, identified, covered, coalesce(cases, 0) AS cases, coalesce(types, 0) AS types, identified - covered AS uncovered, coalesce(cases, 0) >= 5 AND coalesce(types, 0) = 4 AS usable FROM c LEFT JOIN p USING (doc)""",
)
def transfer_set_coverage(t: Tables):
    return records.transfer_set_coverage(*transfer_inputs(t))


@query("thin_coverage_sections", f"WITH {TRANSFER} SELECT se.doc, se.section FROM se ANTI JOIN cs ON cs.doc = se.doc AND cs.section = se.section")
def thin_coverage_sections(t: Tables):
    return records.uncovered_sections(*transfer_inputs(t))


PANEL = """ev AS (SELECT user_id AS target, CAST(floor(e_epoch / 864000) AS BIGINT) AS round, CASE event_type WHEN 'click' THEN 'fidelity' WHEN 'view' THEN 'adversarial' WHEN 'purchase' THEN 'compression' WHEN 'signup' THEN 'usability' ELSE 'trigger-routing' END AS lens,
        CASE WHEN value > 40 THEN 'HIGH' WHEN value > 10 THEN 'MED' ELSE 'LOW' END AS severity, CASE WHEN event_id % 3 = 0 THEN 'assumed-rejected' ELSE 'confirmed' END AS clause_status, CASE WHEN event_id % 4 = 0 THEN 'better' ELSE 'same' END AS verdict FROM events_t)"""


@query(
    "panel_gate_summary",
    f"""WITH {PANEL}, g1 AS (SELECT target, round, NOT bool_or(lens = 'fidelity' AND severity = 'HIGH' AND clause_status <> 'assumed-rejected') AS gate1 FROM ev GROUP BY ALL),
    d AS (SELECT target, min(round) AS high_from FROM ev WHERE lens = 'adversarial' AND severity = 'HIGH' GROUP BY target), g3 AS (SELECT target, round, bool_or(verdict = 'better') AS gate3 FROM ev WHERE lens = 'usability' GROUP BY ALL),
    j AS (SELECT g1.*, gate1 AND NOT coalesce(high_from <= g1.round, false) AS gate2, coalesce(gate3, false) AS gate3 FROM g1 LEFT JOIN d USING (target) LEFT JOIN g3 USING (target, round))
    SELECT target, round, gate1, gate2, gate3, gate2 AS promote, CASE WHEN gate2 THEN 'promoted' WHEN NOT gate1 THEN 'fidelity' WHEN gate3 THEN 'high_dissent' ELSE 'high_dissent_no_gain' END AS reason FROM j""",
)
def panel_gate_summary(t: Tables):
    ev = t.events_t.selectExpr(
        "user_id AS target", "CAST(floor(e_epoch / 864000) AS BIGINT) AS round",
        "CASE event_type WHEN 'click' THEN 'fidelity' WHEN 'view' THEN 'adversarial' WHEN 'purchase' THEN 'compression' WHEN 'signup' THEN 'usability' ELSE 'trigger-routing' END AS lens",
        "CASE WHEN value > 40 THEN 'HIGH' WHEN value > 10 THEN 'MED' ELSE 'LOW' END AS severity", "CASE WHEN event_id % 3 = 0 THEN 'assumed-rejected' ELSE 'confirmed' END AS clause_status",
        "CASE WHEN event_id % 4 = 0 THEN 'better' ELSE 'same' END AS verdict",
    )
    verdicts = ev.groupBy("target", "round", "lens").agg(F.min("verdict").alias("verdict"))
    amended = ev.where("lens = 'usability'").select("target", "round", "lens").distinct()
    return records.panel_gates(ev, ev.where("lens = 'adversarial'"), amended, verdicts)


# --- streams ---------------------------------------------------------------


# what each run of a stream finds: 30 days of arrivals; every fortieth event arrives five days late, the watermark allows two
LATENESS = 2 * 86400
WATERMARK = f"""mark AS (SELECT run, max(max(epoch)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATENESS} AS mark FROM deliveries GROUP BY run),
    judged AS (SELECT d.*, coalesce(d.epoch <= m.mark, false) AS late FROM deliveries d JOIN mark m ON m.run = d.run)"""


def landings(t: Tables) -> list[DataFrame]:
    """The deliveries of each run, in the order of their arrival."""
    path = staged_path(t.spark, "deliveries")
    t.deliveries.withColumn("ts", F.timestamp_seconds("epoch")).write.partitionBy("run").parquet(path)
    dealt = t.spark.read.parquet(path)
    last = dealt.agg(F.max("run")).first()[0]
    return [dealt.where(F.col("run") == r).drop("run") for r in range(last + 1)]


def churn_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    def build(touches: DataFrame) -> DataFrame:
        # every commit is delivered twice; the second copy is dropped
        twice = touches.select("ts", "repo", "sha", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
        counted = jobs.churn_windows(twice, "1 day", f"{LATENESS} seconds")
        return counted.select("repo", "path", F.unix_seconds("window.start").alias("window_start"), "commits")

    return jobs.drain_landings(landings(t), build, "churn-windows", "update", ["repo", "path", "window_start"])


@query(
    "stream_churn_windows",
    f"WITH {WATERMARK} SELECT repo, path, CAST(floor(epoch / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS commits FROM judged WHERE NOT late GROUP BY ALL",
)
def stream_churn_windows(t: Tables):
    return churn_of(t)[0]


@query("stream_late_rows", f"WITH {WATERMARK} SELECT run, 2 * count(*) FILTER (late) AS late_rows FROM judged GROUP BY run")
def stream_late_rows(t: Tables):
    """Delivered rows, both copies, that came behind the watermark."""
    return churn_of(t)[1]


@query(
    "stream_first_flagged",
    "SELECT repo, path, min(epoch // 86400) AS first_flagged, max(epoch // 86400) AS last_run, count(*) AS runs FROM deliveries GROUP BY ALL",
)
def stream_first_flagged(t: Tables):
    flagged = lambda s: jobs.first_flagged(s.select("repo", "path", F.floor(F.col("epoch") / 86400).alias("run")))
    return jobs.drain_landings(landings(t), flagged, "first-flagged", "update", ["repo", "path"])[0]
