"""Organisation state over many repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERTS = [("dependabot", "Dependabot alert(s)"), ("code_scanning", "code-scanning alert(s)"), ("secret_scanning", "secret-scanning alert(s)")]


def latest_per_workflow(runs: DataFrame) -> DataFrame:
    """Newest completed run of each workflow (2.5.2); a maximum, not a sort."""
    done = runs.where(F.col("status") == "completed")
    return done.groupBy("repo", "workflow_id").agg(
        F.max_by(F.struct("run_id", "conclusion", "created_at"), F.struct("created_at", "run_id")).alias("r")
    ).select("repo", "workflow_id", "r.*")


def default_branch_ci(runs: DataFrame, repos: DataFrame) -> DataFrame:
    """none, fail or pass, with the failing workflows (2.4.40)."""
    failed = F.col("conclusion") == "failure"
    state = latest_per_workflow(runs).groupBy("repo").agg(
        F.when(F.bool_or(failed), "fail").otherwise("pass").alias("ci"),
        F.array_join(F.sort_array(F.collect_set(F.when(failed, F.col("workflow_id")))), ", ").alias("failing"),
    )
    return repos.select("repo").distinct().join(state, "repo", "left").select(
        "repo", F.coalesce("ci", F.lit("none")).alias("ci"), F.coalesce("failing", F.lit("")).alias("failing")
    )


def pull_request_counts(prs: DataFrame) -> DataFrame:
    return prs.groupBy("repo").agg(F.count(F.lit(1)).alias("open"), F.count_if("draft").alias("draft"))


def alert_count(name: str) -> Column:
    """Open alerts; null when access was denied, which is not zero."""
    return F.col(name).try_cast("int")


def has_alerts() -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(alert_count(n) > 0, F.lit(False)) for n, _ in ALERTS])


def headline(state: DataFrame) -> DataFrame:
    """One row for the organisation (2.4.39)."""
    return state.agg(
        F.count(F.lit(1)).alias("repos"),
        F.count_if(F.col("ci") == "fail").alias("failing_ci"),
        F.count_if(has_alerts()).alias("with_alerts"),
        F.count_if(F.col("protection") == "unprotected").alias("unprotected"),
        F.count_if("unreachable").alias("unreachable"),
        F.sum(F.coalesce("open_prs", F.lit(0))).alias("open_prs"),
    )


def needs_attention(state: DataFrame) -> DataFrame:
    """Repositories with a reason to look, reasons joined (2.11.17)."""
    failing = F.when(
        F.col("ci") == "fail",
        F.concat(
            F.lit("CI failing"),
            F.when(F.length("failing_workflows") > 0, F.concat(F.lit(" ("), "failing_workflows", F.lit(")"))).otherwise(""),
        ),
    )
    alerts = [
        F.when(alert_count(n) > 0, F.concat(alert_count(n).cast("string"), F.lit(" " + label))) for n, label in ALERTS
    ]
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("unreachable"), "could not assess (repo metadata unreadable)"),
        failing,
        *alerts,
        F.when(F.col("protection") == "unprotected", "default branch unprotected"),
    )
    return state.select("repo", reasons.alias("reasons")).where(F.col("reasons") != "")


def state_table(state: DataFrame) -> DataFrame:
    """Display cells per repository, alphabetical (2.6.10)."""
    cell = lambda n: F.when(F.col(n) == "no-access", "n/a").otherwise(F.col(n))
    prs = F.concat(
        F.col("open_prs").cast("string"),
        F.when(F.col("draft_prs") > 0, F.concat(F.lit(" ("), F.col("draft_prs").cast("string"), F.lit(" draft)"))).otherwise(""),
    )
    shown = lambda c: F.when(F.col("unreachable"), "-").otherwise(c)
    return state.select(
        "repo", shown(prs).alias("prs"), shown(F.col("ci")).alias("ci"),
        *[shown(cell(n)).alias(n) for n, _ in ALERTS],
        F.when(F.col("unreachable"), "could not assess").otherwise(F.col("protection")).alias("protection"),
    ).orderBy("repo")


def active_repos(listing: DataFrame) -> DataFrame:
    """Repositories neither archived nor empty (2.2.21)."""
    return listing.where(~F.col("archived") & (F.coalesce("default_branch", F.lit("")) != "")).select("repo")


def discover(*listings: DataFrame) -> DataFrame:
    """Union of all listings without duplicates (2.7.4)."""
    return reduce(DataFrame.unionByName, [active_repos(df) for df in listings]).distinct()


def without_denied(repos: DataFrame, denylist: DataFrame) -> DataFrame:
    return repos.join(denylist.select("repo"), "repo", "left_anti")


def issue_queue(issues: DataFrame, excluded: list[str], scope_label: str | None = None) -> DataFrame:
    """Open issues in scope without an excluded label (2.2.20)."""
    rows = issues.where(F.col("state") == "open")
    if scope_label:
        rows = rows.where(F.array_contains("labels", scope_label))
    return rows.where(~F.arrays_overlap("labels", F.array(*[F.lit(x) for x in excluded]))).withColumn(
        "ready", F.array_contains("labels", "agent-ready")
    )


def merge_readiness(
    prs: DataFrame, checks: DataFrame, threads: DataFrame, reviews: DataFrame, base_ci: DataFrame,
    required_approvals: int = 1, markdown_approvals: int = 0,
) -> DataFrame:
    """Ready and auto-merge verdicts with what blocks them (2.11.24).

    ``prs(repo, pr, merge_state, in_sync, unanswered, markdown_only)``,
    ``checks(repo, pr, state, required, name)``,
    ``threads(repo, pr, resolved, addressed)``,
    ``reviews(repo, pr, reviewer, state, dismissed)``,
    ``base_ci(repo, name, failing)``.
    """
    key = ["repo", "pr"]
    bad = ~F.col("state").isin("success", "skipped")
    base = base_ci.where("failing").select("repo", "name", F.lit(True).alias("pre_existing"))
    known = checks.join(base, ["repo", "name"], "left")
    c = known.groupBy(*key).agg(
        F.bool_or(bad).alias("failing"),
        F.bool_or(bad & F.col("required")).alias("required_failing"),
        F.bool_or(bad & F.coalesce("pre_existing", F.lit(False))).alias("base_broken"),
    )
    th = threads.groupBy(*key).agg(
        F.bool_or(~F.col("resolved")).alias("unresolved"), F.bool_or(~F.col("addressed")).alias("unaddressed")
    )
    live = reviews.where(~F.col("dismissed"))
    rv = live.groupBy(*key).agg(
        F.count_distinct(F.when(F.col("state") == "APPROVED", F.col("reviewer"))).alias("approvals"),
        F.count_if(F.col("state") == "CHANGES_REQUESTED").alias("changes_requested"),
    )
    rows = prs.join(c, key, "left").join(th, key, "left").join(rv, key, "left").na.fill(False).na.fill(0)
    ready = F.concat_ws(
        ",",
        F.when(~F.col("in_sync"), "out_of_sync"),
        F.when(F.col("failing"), "ci"),
        F.when(F.col("unaddressed"), "comments"),
        F.when(F.col("unanswered") > 0, "conversation"),
        F.when(F.col("unresolved"), "threads"),
    )
    clean = (F.col("merge_state") == "CLEAN") | ((F.col("merge_state") == "UNSTABLE") & ~F.col("required_failing"))
    needed = F.when(F.col("markdown_only"), markdown_approvals).otherwise(required_approvals)
    merge = F.concat_ws(
        ",",
        F.when(~clean, "merge_state"),
        F.when(F.col("approvals") < needed, "approvals"),
        F.when(F.col("changes_requested") > 0, "changes_requested"),
        F.when(F.col("base_broken"), "base_branch"),
    )
    return rows.select(*key, (ready == "").alias("ready"), ready.alias("blockers"), (merge == "").alias("auto_merge"), merge.alias("merge_blockers"))
