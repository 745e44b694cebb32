"""Queries over commit history and complexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import identity, paths, scores
from tidemark.operators import accretion, churn, complexity, coupling
from tidemark.plans.catalog import query
from tidemark.plans.tables import AS_OF, Tables

WINDOW_STARTS = {label: churn.months_before(AS_OF, m) for label, m in fv.CHURN_WINDOWS if m is not None}
START_24 = WINDOW_STARTS["last 24mo"]


def r6(column: str):
    return F.round(F.col(column), 6).alias(column)


def scored_files(t: Tables):
    files = complexity.file_complexity(t.functions, t.files_p)
    return complexity.score_files(files, churn.churn_per_file(t.numstat))


SCORED = """file_ccn AS (SELECT repo, path, CAST(greatest(sum(ccn), 1) AS DOUBLE) AS ccn, CAST(max(ccn) AS DOUBLE) AS max_fn_ccn FROM functions GROUP BY repo, path),
    file_churn AS (SELECT repo, path, count(*) AS commits FROM numstat GROUP BY repo, path),
    scored AS (SELECT f.repo, f.path, f.loc, f.est_tokens, c.ccn, c.max_fn_ccn, coalesce(h.commits, 0) AS commits,
        round(sqrt(pow(c.max_fn_ccn, 0.7) * pow(c.ccn, 0.3)) * sqrt(1 + coalesce(h.commits, 0)) * sqrt(f.est_tokens), 6) AS score
        FROM files_p f JOIN file_ccn c USING (repo, path) LEFT JOIN file_churn h USING (repo, path) WHERE f.loc > 0),
    hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, path) AS rank FROM scored) x WHERE rank <= 10),
    complex10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ccn DESC, path) AS rank FROM scored) x WHERE rank <= 10),
    large10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY loc DESC, path) AS rank FROM scored) x WHERE rank <= 10)"""


# --- filters ---------------------------------------------------------------


@query("scope_filter", "SELECT repo, sha, count(*) AS files FROM commit_files WHERE path LIKE 'r1/%' GROUP BY repo, sha")
def scope_filter(t: Tables):
    return churn.scope(t.commit_files, "r1").groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("files"))


@query(
    "bulk_commit_filter",
    """SELECT repo, sha, path FROM commit_files JOIN (SELECT repo, sha FROM commit_files GROUP BY repo, sha
       HAVING count(*) BETWEEN 2 AND 50) USING (repo, sha)""",
)
def bulk_commit_filter(t: Tables):
    return coupling.bulk_commit_filter(t.commit_files).select("repo", "sha", "path")


@query("since_filter", f"SELECT repo, count(*) AS commits FROM commits WHERE ts >= {START_24} GROUP BY repo")
def since_filter(t: Tables):
    return churn.since(t.commits, START_24).groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))


@query(
    "identity_is_agent",
    f"""SELECT repo, sha, path, an, ae,
       ({' OR '.join(f"contains(lower(ae), '{x}')" for x in fv.AGENT_EMAIL_HINTS)} OR contains(lower(an), '[bot]')) AS is_agent,
       contains(lower(coauthor_text), 'copilot@') AS coauthor_agent FROM authored""",
)
def identity_is_agent(t: Tables):
    return t.authored.select(
        "repo", "sha", "path", "an", "ae",
        identity.is_agent(F.col("ae"), F.col("an")).alias("is_agent"),
        identity.any_coauthor_agent(F.split("coauthor_text", "\x1d")).alias("coauthor_agent"),
    )


# --- churn -----------------------------------------------------------------


@query("churn_per_file", "SELECT repo, path, count(DISTINCT sha) AS commits FROM commit_files GROUP BY repo, path")
def churn_per_file(t: Tables):
    return churn.churn_per_file(t.commit_files)


@query(
    "churn_window_pick",
    f"""WITH w AS (SELECT f.repo, f.path,
        count(*) FILTER (ts >= {WINDOW_STARTS['last 12mo']}) AS w0, count(*) FILTER (ts >= {WINDOW_STARTS['last 24mo']}) AS w1,
        count(*) FILTER (ts >= {WINDOW_STARTS['last 5y']}) AS w2, count(ts) AS w3
        FROM tracked f LEFT JOIN commit_files c USING (repo, path) GROUP BY f.repo, f.path),
    long AS (SELECT repo, path, unnest([0, 1, 2, 3]) AS i, unnest([w0, w1, w2, w3]) AS n FROM w),
    q AS (SELECT repo, i, max(n) AS peak, 100.0 * count(*) FILTER (n > 0) / count(*) AS cov FROM long GROUP BY repo, i),
    pick AS (SELECT repo, coalesce(min(i) FILTER (peak >= 3 AND cov >= 10.0), 3) AS i FROM q GROUP BY repo)
    SELECT long.repo, path, CASE long.i WHEN 0 THEN 'commits (last 12mo)' WHEN 1 THEN 'commits (last 24mo)' WHEN 2 THEN 'commits (last 5y)' ELSE 'commits (all-time)' END AS window_label, n AS commits
    FROM long JOIN pick ON pick.repo = long.repo AND pick.i = long.i""",
)
def churn_window_pick(t: Tables):
    return churn.pick_churn_window(t.commit_files, t.tracked, AS_OF)


@query(
    "churn_degenerate",
    """SELECT repo, count(*) >= 5 AND quantile_disc(commits, 0.95) <= 1 AS degenerate
       FROM (SELECT repo, path, count(*) AS commits FROM numstat GROUP BY repo, path) GROUP BY repo""",
)
def churn_degenerate(t: Tables):
    return churn.churn_degenerate(churn.churn_per_file(t.numstat))


@query(
    "last_commit_days",
    f"SELECT repo, path, CAST(greatest(floor(({AS_OF} - max(author_ts)) / 86400), 0) AS BIGINT) AS last_commit_days FROM numstat GROUP BY repo, path",
)
def last_commit_days(t: Tables):
    return churn.last_commit_days(t.numstat, AS_OF)


@query(
    "last_human_commit_days",
    f"""SELECT repo, path, CASE WHEN max(h) IS NOT NULL THEN CAST(greatest(floor(({AS_OF} - max(h)) / 86400), 0) AS BIGINT) END AS last_human_days
       FROM (SELECT repo, path, CASE WHEN contains(ae, '@') AND NOT contains(ae, '[bot]') THEN ts END AS h FROM authored) GROUP BY repo, path""",
)
def last_human_commit_days(t: Tables):
    return churn.last_human_commit_days(t.authored, AS_OF)


@query(
    "commit_count_decile",
    """SELECT repo, path, commits, round((rank() OVER (PARTITION BY repo ORDER BY commits) - 1) * 10.0 / count(*) OVER (PARTITION BY repo), 6) AS decile
       FROM (SELECT repo, path, count(*) AS commits FROM numstat GROUP BY repo, path)""",
)
def commit_count_decile(t: Tables):
    return churn.commit_count_decile(churn.churn_per_file(t.numstat)).select("repo", "path", "commits", r6("decile"))


@query(
    "candidate_dirs",
    """WITH d AS (SELECT DISTINCT repo, sha, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir FROM commit_files),
       n AS (SELECT repo, dir, count(*) AS n_commits FROM d GROUP BY repo, dir HAVING count(*) >= 5)
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n_commits DESC, dir) AS rank, count(*) OVER (PARTITION BY repo) AS eligible FROM n) WHERE rank <= 50""",
)
def candidate_dirs(t: Tables):
    return churn.candidate_dirs(t.commit_files)


# --- coupling --------------------------------------------------------------

PAIRS = """sized AS (SELECT *, count(*) OVER (PARTITION BY repo, sha) AS n FROM commit_files),
    co AS (SELECT a.repo, a.sha, a.path AS file_a, b.path AS file_b FROM sized a JOIN sized b ON a.repo = b.repo AND a.sha = b.sha AND a.path < b.path WHERE a.n BETWEEN 2 AND 50),
    pairs AS (SELECT repo, file_a, file_b, count(*) AS co_change_count, 100.0 * count(*) / any_value(total) AS support_pct
        FROM co JOIN (SELECT repo, count(*) AS total FROM commits GROUP BY repo) USING (repo) GROUP BY repo, file_a, file_b HAVING count(*) >= 3)"""


@query("co_change_pairs_join", f"WITH {PAIRS} SELECT repo, sha, file_a, file_b FROM co")
def co_change_pairs_join(t: Tables):
    return coupling.co_change_pairs(t.commit_files)


def pairs_of(t: Tables):
    return coupling.coupling_pairs(t.commit_files, t.commits)


@query(
    "change_coupling_pairs",
    f"WITH {PAIRS} SELECT repo, file_a, file_b, co_change_count, round(support_pct, 6) AS support_pct FROM pairs",
)
def change_coupling_pairs(t: Tables):
    return pairs_of(t).select("repo", "file_a", "file_b", "co_change_count", r6("support_pct"))


@query(
    "top_coupling_pairs",
    f"""WITH {PAIRS} SELECT repo, file_a, file_b, co_change_count, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY co_change_count DESC, file_a, file_b) AS rank FROM pairs) WHERE rank <= 100""",
)
def top_coupling_pairs(t: Tables):
    return coupling.top_coupling_pairs(pairs_of(t)).select("repo", "file_a", "file_b", "co_change_count", "rank")


CONTAINMENT = """in_dir AS (SELECT repo, sha, unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir, path FROM commit_files),
    dir_n AS (SELECT repo, sha, dir, count(*) AS n FROM in_dir GROUP BY repo, sha, dir),
    commit_n AS (SELECT repo, sha, count(*) AS total FROM commit_files GROUP BY repo, sha),
    contained AS (SELECT repo, dir, count(*) AS touching, avg(CASE WHEN n = total THEN 1.0 ELSE 0.0 END) AS containment
        FROM dir_n JOIN commit_n USING (repo, sha) GROUP BY repo, dir)"""


@query("containment_ratio", f"WITH {CONTAINMENT} SELECT repo, dir, touching, round(containment, 6) AS containment FROM contained")
def containment_ratio(t: Tables):
    return coupling.containment_ratio(t.commit_files).select("repo", "dir", "touching", r6("containment"))


@query(
    "contributor_rollup",
    """SELECT repo, path, an AS name, ae AS email, CASE WHEN contains(ae, '[bot]') THEN 'agent' WHEN contains(ae, '@') THEN 'human' ELSE 'unknown' END AS classification,
       count(*) AS commits, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_removed FROM authored GROUP BY ALL""",
)
def contributor_rollup(t: Tables):
    return coupling.contributors(t.authored)


@query(
    "authorship_class",
    """WITH f AS (SELECT repo, path, contains(ae, '[bot]') AS aa, contains(ae, '@') AND NOT contains(ae, '[bot]') AS ah,
        contains(ce, '[bot]') AS ca, contains(ce, '@') AND NOT contains(ce, '[bot]') AS ch, contains(coauthor_text, '<copilot@') AS co FROM authored),
    g AS (SELECT repo, path, bool_or(aa OR ca OR co) AS any_agent, bool_or(ah) AS any_human, bool_or(ah OR ch) AS intent_source,
        count(*) FILTER (NOT ah AND NOT (aa OR ca OR co)) AS unknown FROM f GROUP BY repo, path)
    SELECT repo, path, any_human AS human_anchor, intent_source, CASE WHEN any_agent AND any_human THEN 'mixed' WHEN any_agent AND unknown = 0 THEN 'agent'
        WHEN any_agent THEN 'unknown' WHEN any_human THEN 'human' ELSE 'unknown' END AS authorship_class FROM g""",
)
def authorship_class(t: Tables):
    return coupling.authorship_class(t.authored)


# --- accretion -------------------------------------------------------------


@query(
    "running_net_delta",
    """SELECT repo, path, sha, CAST(net AS BIGINT) AS net, CAST(lag(net) OVER (PARTITION BY repo, path ORDER BY author_ts, sha) AS BIGINT) AS prev_net FROM
       (SELECT repo, path, sha, author_ts, sum(added - deleted) OVER (PARTITION BY repo, path ORDER BY author_ts, sha ROWS UNBOUNDED PRECEDING) AS net FROM numstat)""",
)
def running_net_delta(t: Tables):
    return accretion.running_net_delta(t.numstat)


ACCRETION = """running AS (SELECT *, sum(added - deleted) OVER (PARTITION BY repo, path ORDER BY author_ts, sha ROWS UNBOUNDED PRECEDING) AS net FROM numstat),
    steps AS (SELECT *, lag(net) OVER (PARTITION BY repo, path ORDER BY author_ts, sha) AS prev FROM running),
    accreting AS (SELECT repo, path, CAST(sum(added) - sum(deleted) AS BIGINT) AS net_additions, count(*) AS commit_count,
        sum(deleted) / (sum(added) + sum(deleted)) AS deletion_fraction, (max(author_ts) - min(author_ts)) / 86400.0 / 30.44 AS time_span_months
        FROM steps GROUP BY repo, path HAVING count(*) >= 3 AND sum(added) > sum(deleted) AND sum(deleted) / (sum(added) + sum(deleted)) < 0.15 AND bool_and(prev IS NULL OR net >= prev))"""


@query(
    "accretion_ratchet",
    f"WITH {ACCRETION} SELECT repo, path, net_additions, commit_count, round(deletion_fraction, 6) AS deletion_fraction, round(time_span_months, 6) AS time_span_months FROM accreting",
)
def accretion_ratchet(t: Tables):
    return accretion.accretion(t.numstat).select(
        "repo", "path", "net_additions", "commit_count", r6("deletion_fraction"), r6("time_span_months")
    )


def band_of(t: Tables):
    scored = scored_files(t)
    return complexity.band_union(
        complexity.top_hotspots(scored), complexity.top_complex(scored), complexity.top_large(scored)
    )


BAND = "band AS (SELECT repo, path FROM hot UNION SELECT repo, path FROM complex10 UNION SELECT repo, path FROM large10)"


@query(
    "accretion_band_filter",
    f"""WITH {SCORED}, {ACCRETION}, {BAND} SELECT repo, path, net_additions, rank, total_in_band FROM
        (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY net_additions DESC, path) AS rank, count(*) OVER (PARTITION BY repo) AS total_in_band
         FROM accreting SEMI JOIN band USING (repo, path)) WHERE rank <= 12""",
)
def accretion_band_filter(t: Tables):
    kept = accretion.accretion_in_band(accretion.accretion(t.numstat), band_of(t))
    return kept.select("repo", "path", "net_additions", "rank", "total_in_band")


# --- complexity ------------------------------------------------------------


@query(
    "file_complexity",
    """SELECT f.repo, f.path, f.loc, CAST(greatest(sum(ccn), 1) AS DOUBLE) AS ccn, CAST(max(ccn) AS DOUBLE) AS max_fn_ccn
       FROM files_p f JOIN functions USING (repo, path) GROUP BY f.repo, f.path, f.loc""",
)
def file_complexity(t: Tables):
    return complexity.file_complexity(t.functions, t.files_p).select("repo", "path", "loc", "ccn", "max_fn_ccn")


@query(
    "complexity_percentiles",
    f"""WITH {SCORED}, vals AS (SELECT repo, 'loc' AS metric, CAST(loc AS DOUBLE) AS v FROM scored UNION ALL SELECT repo, 'est_tokens', est_tokens FROM scored
        UNION ALL SELECT repo, 'ccn', ccn FROM scored UNION ALL SELECT repo, 'commits', commits FROM scored UNION ALL SELECT repo, 'fn_ccn', ccn FROM functions)
    SELECT repo, metric, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max, sum(v) AS total, count(*) AS count FROM vals GROUP BY repo, metric""",
)
def complexity_percentiles(t: Tables):
    files = complexity.file_complexity(t.functions, t.files_p)
    stats = complexity.complexity_percentiles(files, t.functions, churn.churn_per_file(t.numstat))
    return stats.select("repo", "metric", r6("p50"), r6("p95"), "max", "total", "count")


RANKED = ["repo", "path", "loc", "ccn", "commits", "rank"]


@query("top_hotspots", f"WITH {SCORED} SELECT repo, path, loc, ccn, commits, rank, score FROM hot")
def top_hotspots(t: Tables):
    return complexity.top_hotspots(scored_files(t)).select(*RANKED, r6("score"))


@query("top_complex", f"WITH {SCORED} SELECT repo, path, loc, ccn, commits, rank FROM complex10")
def top_complex(t: Tables):
    return complexity.top_complex(scored_files(t)).select(*RANKED)


@query("top_large", f"WITH {SCORED} SELECT repo, path, loc, ccn, commits, rank FROM large10")
def top_large(t: Tables):
    return complexity.top_large(scored_files(t)).select(*RANKED)


@query(
    "hotspot_risk_band",
    f"WITH {SCORED} SELECT repo, path, rank, CASE WHEN rank <= 3 THEN 'high' WHEN rank <= 7 THEN 'medium' ELSE 'low' END AS risk_band FROM hot",
)
def hotspot_risk_band(t: Tables):
    return churn.hotspot_risk_band(complexity.top_hotspots(scored_files(t))).select("repo", "path", "rank", "risk_band")


@query("band_union", f"WITH {SCORED}, {BAND} SELECT repo, path FROM band")
def band_union(t: Tables):
    return band_of(t)


@query(
    "max_ccn_union",
    f"""WITH {SCORED} SELECT repo, path, max(ccn) AS ccn FROM (SELECT repo, path, ccn FROM hot UNION ALL SELECT repo, path, ccn FROM complex10
        UNION ALL SELECT repo, path, ccn FROM large10 UNION ALL SELECT repo, path, CAST(max_fn_ccn AS DOUBLE) FROM scored) GROUP BY repo, path""",
)
def max_ccn_union(t: Tables):
    scored = scored_files(t)
    return complexity.max_ccn_union(
        complexity.top_hotspots(scored),
        complexity.top_complex(scored),
        complexity.top_large(scored),
        scored.select("repo", "path", F.col("max_fn_ccn").alias("ccn")),
    )


@query(
    "scorer_union",
    """WITH first AS (SELECT repo, path, CAST(greatest(sum(ccn), 1) AS DOUBLE) AS ccn FROM functions WHERE ccn > 10 GROUP BY repo, path)
       SELECT f.repo, f.path, f.loc, coalesce(p.ccn, CAST(f.est_tokens AS DOUBLE) / 100) AS ccn, CASE WHEN p.path IS NULL THEN 'lines' ELSE 'functions' END AS source
       FROM files_p f LEFT JOIN first p USING (repo, path) WHERE f.loc > 0""",
)
def scorer_union(t: Tables):
    first = complexity.file_complexity(t.functions.where("ccn > 10"), t.files_p)
    second = t.files_p.select("repo", "path", "loc", (F.col("est_tokens") / 100).alias("ccn"), F.lit("lines").alias("source"))
    return complexity.scorer_union(first, second).select("repo", "path", "loc", "ccn", "source")


@query(
    "keyhole_budget_rollup",
    """WITH s AS (SELECT repo, split_part(path, '/', 1) || '' AS top, sum(est_tokens) AS tok, count(*) FILTER (est_tokens > 9000) AS over FROM files_p GROUP BY repo, split_part(path, '/', 1))
       SELECT repo, CAST(sum(tok) AS BIGINT) AS total, CAST(sum(over) AS BIGINT) AS files_over_budget, count(*) FILTER (tok > 9000) AS subtrees_over_budget FROM s GROUP BY repo""",
)
def keyhole_budget_rollup(t: Tables):
    return complexity.budget_rollup(t.files_p, budget=9000)


@query(
    "budget_subtrees",
    """SELECT repo, subtree, CAST(est_tokens AS BIGINT) AS est_tokens, rank, over_budget FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY est_tokens DESC, subtree) AS rank, count(*) OVER (PARTITION BY repo) AS over_budget FROM
       (SELECT repo, split_part(path, '/', 1) AS subtree, sum(est_tokens) AS est_tokens FROM files_p GROUP BY ALL HAVING sum(est_tokens) > 200000)) WHERE rank <= 10""",
)
def budget_subtrees(t: Tables):
    return complexity.budget_subtrees(t.files_p)


@query(
    "dominant_file",
    """WITH f AS (SELECT concat_ws(':', repo, brand, p_type) AS repo, path, loc FROM files_p),
       m AS (SELECT repo, arg_max(path, (loc, path)) AS path, max(loc) AS big, sum(loc) AS total, count(*) AS n FROM f GROUP BY repo)
       SELECT repo, path, round(big / total, 6) AS share FROM m WHERE n >= 2 AND big / total >= 0.3""",
)
def dominant_file(t: Tables):
    files = t.files_p.withColumn("repo", F.concat_ws(":", "repo", "brand", "p_type"))
    return complexity.dominant_file(files).select("repo", "path", r6("share"))


@query(
    "directory_rollup",
    """WITH d AS (SELECT repo, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir, unnest([0, 1, 2]) AS depth, loc FROM files_p)
       SELECT repo, dir, depth, CAST(sum(loc) AS BIGINT) AS size, count(*) AS files FROM d GROUP BY ALL""",
)
def directory_rollup(t: Tables):
    return complexity.directory_rollup(t.files_p)


# --- score columns ---------------------------------------------------------


@query(
    "effective_ccn",
    f"WITH {SCORED} SELECT repo, path, round(pow(max_fn_ccn, 0.7) * pow(ccn, 0.3), 6) AS effective FROM scored",
)
def effective_ccn(t: Tables):
    files = complexity.file_complexity(t.functions, t.files_p)
    return files.select("repo", "path", F.round(scores.effective_ccn(F.col("ccn"), F.col("max_fn_ccn")), 6).alias("effective"))


@query(
    "high_ccn_threshold",
    f"WITH {SCORED} SELECT repo, round(greatest(quantile_cont(ccn, 0.95), 10.0), 6) AS threshold FROM scored GROUP BY repo",
)
def high_ccn_threshold(t: Tables):
    files = complexity.file_complexity(t.functions, t.files_p)
    p = complexity.percentiles(files, ["repo"], "ccn")
    return p.select("repo", F.round(scores.high_ccn_threshold(F.col("p95")), 6).alias("threshold"))


@query(
    "adaptive_cap",
    """WITH a AS (SELECT repo, path, sum(added) AS n FROM numstat GROUP BY repo, path), p AS (SELECT repo, max(n) AS mx, quantile_cont(n, 0.95) AS p95 FROM a GROUP BY repo)
       SELECT repo, round(CASE WHEN mx = 0 THEN 1.0 WHEN p95 > 0 AND mx > 5 * p95 THEN p95 ELSE mx END, 6) AS cap, CASE WHEN p95 > 0 AND mx > 5 * p95 THEN 'p95 (outlier-suppressed)' ELSE 'max' END AS kind FROM p""",
)
def adaptive_cap(t: Tables):
    added = t.numstat.groupBy("repo", "path").agg(F.sum("added").alias("added"))
    p = complexity.percentiles(added, ["repo"], "added")
    return p.select(
        "repo",
        F.round(scores.adaptive_cap(F.col("max"), F.col("p95")), 6).alias("cap"),
        scores.adaptive_cap_kind(F.col("max"), F.col("p95")).alias("kind"),
    )


@query(
    "time_span_months",
    """SELECT repo, path, round((max(author_ts) - min(author_ts)) / 86400.0 / 30.44, 6) AS months, CASE WHEN (max(author_ts) - min(author_ts)) / 86400.0 / 30.44 < 1 THEN '<1mo'
       ELSE concat(CAST(round_even((max(author_ts) - min(author_ts)) / 86400.0 / 30.44, 0) AS BIGINT), 'mo') END AS label FROM numstat GROUP BY repo, path""",
)
def time_span_months(t: Tables):
    months = scores.span_months(F.min("author_ts"), F.max("author_ts"))
    return (
        t.numstat.groupBy("repo", "path")
        .agg(months.alias("m"))
        .select("repo", "path", F.round("m", 6).alias("months"), scores.months_label(F.col("m")).alias("label"))
    )


@query(
    "epoch_days_since",
    f"SELECT repo, sha, CAST(greatest(({AS_OF} - ts) // 86400, 0) AS BIGINT) AS days FROM commits",
)
def epoch_days_since(t: Tables):
    return t.commits.select("repo", "sha", scores.days_since(F.col("ts"), F.lit(AS_OF)).alias("days"))


@query(
    "canonical_pair",
    f"WITH {PAIRS} SELECT DISTINCT repo, file_a, file_b FROM co",
)
def canonical_pair(t: Tables):
    pairs = coupling.co_change_pairs(t.commit_files)
    return pairs.select("repo", paths.canonical_pair(F.col("file_b"), F.col("file_a")).alias("p")).select("repo", "p.*").distinct()


@query(
    "months_label",
    """SELECT repo, sha, CASE WHEN d < 1 THEN '<1mo' ELSE concat(CAST(round_even(d, 0) AS BIGINT), 'mo') END AS label FROM
       (SELECT repo, sha, (max(author_ts) - min(author_ts)) / 86400.0 / 30.44 AS d FROM numstat GROUP BY repo, sha)""",
)
def months_label(t: Tables):
    spans = t.numstat.groupBy("repo", "sha").agg(scores.span_months(F.min("author_ts"), F.max("author_ts")).alias("m"))
    return spans.select("repo", "sha", scores.months_label(F.col("m")).alias("label"))


@query("scope_slug", "SELECT DISTINCT repo, regexp_replace(path, '/[^/]*$', '') AS scope, replace(regexp_replace(path, '/[^/]*$', ''), '/', '-') AS slug FROM tracked")
def scope_slug(t: Tables):
    dirs = t.tracked.select("repo", paths.parent(F.col("path")).alias("scope")).distinct()
    return dirs.select("repo", "scope", paths.scope_slug(F.col("scope")).alias("slug"))
