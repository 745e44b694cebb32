"""Run records, contracts and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import scores
from tidemark.scale import top_k


def _kind(value: Column) -> Column:
    """JSON type of a variant; SQL null stays null."""
    s = F.schema_of_variant(value)
    return (
        F.when(F.startswith(s, F.lit("OBJECT")), "object")
        .when(F.startswith(s, F.lit("ARRAY")), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s == "BIGINT", "integer")
        .when(s.isNotNull(), "number")
    )


def _problems(value: Column, path: Column, types: list[str], required: bool = False, enum: list | None = None, min_length: int = 0) -> Column:
    """Violations of one declared field as ``array<struct<path, error>>``."""
    row = lambda hit, error: F.when(hit, F.struct(path.alias("path"), F.lit(error).alias("error")))
    kind = _kind(value)
    ok = kind.isin(types)
    checks = [row(kind.isNotNull() & ~ok, "type")]
    if required:
        checks.append(row(kind.isNull(), "missing"))
    if enum:
        text = F.try_variant_get(value, "$", "string")
        checks.append(row(ok & ~text.isin([str(e) for e in enum]), "enum"))
    if min_length:
        checks.append(row((kind == "string") & (F.length(F.try_variant_get(value, "$", "string")) < min_length), "min_length"))
    return F.array_compact(F.array(*checks))


def schema_check(records: DataFrame) -> DataFrame:
    """Every violation of the record layout as a row (2.11.21).

    ``records(run, json)``; text that is no JSON object is one violation.
    """
    parsed = records.select("run", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    is_object = F.coalesce(_kind(v) == "object", F.lit(False))
    found = []
    for path, types, required, enum, size in fv.RECORD_FIELDS:
        value = F.variant_get(v, f"$.{path}", "variant")
        parent = path.rpartition(".")[0]
        problems = _problems(value, F.lit(f"$.{path}"), types, required, enum, size)
        if parent and required:
            whole = _kind(F.variant_get(v, f"$.{parent}", "variant")) == "object"
            problems = F.when(whole, problems).otherwise(F.array().cast("array<struct<path:string,error:string>>"))
        found.append(problems)
    for field, key, types, required, enum in fv.RECORD_ITEM_FIELDS:
        items = F.try_variant_get(v, f"$.{field}", "array<variant>")

        each = F.flatten(_item_problems(items, field, key, types, required, enum))
        found.append(F.coalesce(each, F.array().cast("array<struct<path:string,error:string>>")))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("type").alias("error")))
    errors = F.when(is_object, F.concat(*found)).otherwise(broken)
    return parsed.select("run", F.explode(errors).alias("e")).select("run", "e.*")


def _item_problems(items: Column, field: str, key: str, types: list[str], required: bool, enum: list | None) -> Column:
    def check(item: Column, i: Column) -> Column:
        where = F.concat(F.lit(f"$.{field}["), i.cast("string"), F.lit(f"].{key}"))
        return _problems(F.try_variant_get(item, f"$.{key}", "variant"), where, types, required, enum)

    return F.transform(items, check)


def token_check(records: DataFrame, issued: DataFrame) -> DataFrame:
    """Whether a record's token is the one issued for its run (2.3.29)."""
    joined = records.select("run_id", "token").join(issued.select("run_id", F.col("token").alias("issued")), "run_id", "left")
    ok = F.coalesce((F.col("token") == F.col("issued")) & (F.col("token") != ""), F.lit(False))
    return joined.select("run_id", ok.alias("token_ok"))


def certify(records: DataFrame, criteria: DataFrame, escalations: DataFrame, issued: DataFrame) -> DataFrame:
    """Verdict of a completion record (2.4.44).

    ``records(run_id, schema_ok, has_freeze, contract_hash, has_kill_test,
    null_artifact_all_fail, sabotage_rejected, signed, abort_events, source,
    token, couldnt_drive)``, ``criteria(run_id, id, tier, result)``,
    ``escalations(run_id, criterion_id)``.
    """
    result = F.col("result")
    named = escalations.select("run_id", F.col("criterion_id").alias("id"), F.lit(True).alias("named")).distinct()
    c = criteria.join(named, ["run_id", "id"], "left").groupBy("run_id").agg(
        F.count_if((F.col("tier") == 1) & (result == "fail")).alias("tier1_fail"),
        F.count_if((F.col("tier") == 2) & (result == "fail")).alias("tier2_fail"),
        F.count_if(result == "undriven").alias("undriven"),
        F.count_if((result == "escalated") & F.col("named").isNull()).alias("orphans"),
    )
    e = escalations.groupBy("run_id").agg(F.count(F.lit(1)).alias("tier3"))
    rows = records.join(c, "run_id", "left").join(e, "run_id", "left").join(token_check(records, issued), "run_id")
    rows = rows.na.fill(0, ["tier1_fail", "tier2_fail", "undriven", "orphans", "tier3"])
    frozen = (
        (F.coalesce("contract_hash", F.lit("")) != "")
        & F.col("has_kill_test")
        & F.coalesce("null_artifact_all_fail", F.lit(False))
        & F.coalesce("sabotage_rejected", F.lit(True))
    )
    awaiting = (F.col("tier3") > 0) & ~F.col("signed")
    partial = (F.col("couldnt_drive") > 0) | (F.col("undriven") > 0)
    refused = (
        F.when(~F.col("schema_ok"), "REJECTED")
        .when(~F.col("has_freeze"), F.when(F.col("signed"), "UNVERIFIED").otherwise("REJECTED"))
        .when(~frozen, "REJECTED")
        .when(F.col("abort_events") > 0, "ABORTED")
        .when(F.col("orphans") > 0, "REJECTED")
    )
    verdict = F.coalesce(
        refused,
        F.when(~F.col("token_ok"), "DEGRADED-custody")
        .when(F.col("tier1_fail") > 0, "FAIL")
        .when(awaiting, "AWAITING-TIER3-SIGNOFF")
        .when(partial, "PARTIAL")
        .otherwise("PASS"),
    )
    stamps = F.when(refused.isNull(), F.concat_ws(
        "; ",
        F.when(F.col("source") == "none", fv.STAMP_DEGRADED),
        F.when(~F.col("token_ok"), fv.STAMP_CUSTODY),
        F.when(partial, "PARTIAL"),
    )).otherwise(F.when(refused == "UNVERIFIED", "contract-skipped").otherwise(""))
    return rows.select("run_id", verdict.alias("verdict"), (verdict == "PASS").alias("certified"), stamps.alias("stamps"))


def criterion_results(criteria: DataFrame, results: DataFrame) -> DataFrame:
    """Criteria against supplied results: each mismatch is a named reason (2.3.28)."""
    known = criteria.select("contract", "id").distinct().withColumn("declared", F.lit(True))
    given = results.groupBy("contract", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min("passed").alias("passed"), F.count_if(F.col("passed").isNull()).alias("unclear")
    )
    both = known.join(given, ["contract", "id"], "full_outer")
    reason = (
        F.when(F.col("declared").isNull(), "unknown")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "duplicate")
        .when(F.col("unclear") > 0, "not_boolean")
        .when(F.col("passed"), "vacuous")
    )
    return both.select("contract", "id", reason.alias("reason")).where(F.col("reason").isNotNull())


def contract_vacuity(contracts: DataFrame, criteria: DataFrame, results: DataFrame) -> DataFrame:
    """Contracts that anything would satisfy (2.4.45).

    ``contracts(contract, cls)``, ``criteria(contract, id, tier,
    justification)``, ``results(contract, id, passed)`` against the null artifact.
    """
    vacuous = results.where(F.col("passed")).select("contract", "id").distinct()
    flagged = criteria.join(vacuous.withColumn("vacuous", F.lit(True)), ["contract", "id"], "left").join(contracts, "contract")
    floor = F.create_map(*[F.lit(x) for c in fv.DOWNGRADE_CLASSES for x in (c, fv.CLASS_TIERS[c])])[F.col("cls")]
    unjustified = (F.col("tier") < floor) & (F.trim(F.coalesce("justification", F.lit(""))) == "")
    agg = flagged.groupBy("contract", "cls").agg(
        F.count_if("vacuous").alias("vacuous"),
        F.count_if(F.coalesce(unjustified, F.lit(False))).alias("downgrades"),
        F.bool_or(F.col("tier") == 3).alias("has_tier3"),
    )
    blind = (F.col("cls") == "interactive") & ~F.col("has_tier3")
    return agg.select(
        "contract", "vacuous", "downgrades", blind.alias("interactive_without_tier3"),
        ((F.col("vacuous") == 0) & (F.col("downgrades") == 0) & ~blind).alias("ok"),
    )


def default_tier(cls: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in fv.CLASS_TIERS.items() for x in item])
    return F.coalesce(table[cls], F.lit(2))


def weakened_tokens(base: DataFrame, head: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Tokens that occur less often than before, or lost their own line (2.7.10).

    Both sides: ``(file, text)`` with one row per line or per file.
    """
    tokens = tokens or fv.FLOOR_TOKENS

    def counts(df: DataFrame, prefix: str) -> DataFrame:
        per_row = F.array(
            *[
                F.struct(
                    F.lit(t).alias("token"),
                    (F.size(F.split("text", r"\Q" + t + r"\E")) - 1).alias("n"),
                    F.size(_own_lines(t)).alias("own"),
                )
                for t in tokens
            ]
        )
        rows = df.select("file", F.explode(per_row).alias("c"))
        return rows.groupBy("file", "c.token").agg(F.sum("c.n").alias(f"{prefix}_n"), F.sum("c.own").alias(f"{prefix}_own"))

    both = counts(base, "base").join(counts(head, "head"), ["file", "token"], "left").na.fill(0)
    lost_line = (F.col("token") == fv.FLOOR_MARKER) & (F.col("base_own") > 0) & (F.col("head_own") == 0)
    weaker = (F.col("base_n") > 0) & ((F.col("head_n") < F.col("base_n")) | lost_line)
    return both.where(weaker).select("file", "token", "base_n", "head_n")


def _own_lines(token: str) -> Column:
    return F.filter(F.split("text", "\n"), lambda line: F.trim(line) == token)


def missing_clauses(texts: DataFrame) -> DataFrame:
    """Required clauses that a file no longer carries whole (2.7.10)."""
    missing = F.array_compact(
        F.array(
            *[
                F.when(~(F.contains("text", F.lit(parts[0])) & F.contains("text", F.lit(parts[1]))), F.lit(clause))
                for clause, parts in fv.FLOOR_CLAUSES.items()
            ]
        )
    )
    return texts.select("file", F.explode(missing).alias("clause"))


def layer_score(verdicts: DataFrame, applicable: DataFrame) -> DataFrame:
    """Points over the applicable layers and the maturity band (2.4.38).

    ``verdicts(repo, layer, status)``; ``applicable(repo, archetype,
    mutation_run)``. Layer 6 stays Partial without a mutation run.
    """
    points = F.when(F.col("status") == "Present", 1.0).when(F.col("status") == "Partial", 0.5).otherwise(0.0)
    capped = F.when(F.col("layer") == 6, F.least(points, F.lit(0.5))).otherwise(points)
    # the three sums a repository may score, so that its verdicts are one row before they meet its archetype
    sums = verdicts.groupBy("repo").agg(
        F.sum(points).alias("full"), F.sum(capped).alias("capped"), F.sum(F.when(F.col("layer").isin(0, 1, 8), points).otherwise(0.0)).alias("core")
    )
    kb = F.col("archetype") == "knowledge-base"
    counted = F.when(~kb, F.when(~F.col("mutation_run"), "capped").otherwise("full")).otherwise("core")
    denominator = F.when(kb, fv.KB_DENOMINATOR).otherwise(fv.SOFTWARE_DENOMINATOR)
    kinds = applicable.groupBy("repo").agg(
        *[F.count_if(counted == c).alias(f"n_{c}") for c in ("full", "capped", "core")], F.max(denominator).alias("denominator")
    )
    # both sides have a row per repository: as a broadcast, one of them would go through the driver whole
    score = F.col("n_full") * F.col("full") + F.col("n_capped") * F.col("capped") + F.col("n_core") * F.col("core")
    agg = sums.join(kinds.hint("merge"), "repo").select("repo", score.alias("score"), "denominator")
    return agg.select(
        "repo", "score", "denominator", scores.maturity_band(F.col("score"), F.col("denominator")).alias("band"),
        scores.score_color(F.col("score"), F.col("denominator")).alias("color"),
    )


def finalize_checks(inputs: DataFrame, context: DataFrame, hotspot_actions: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Assertions on a finished run, one row per violation (2.11.16).

    ``inputs(repo, run_id, score, denominator, label, layer6)``,
    ``context(repo, run_id, denominator, mutation_run)``.
    """
    c = context.select("repo", F.col("run_id").alias("ctx_run"), F.col("denominator").alias("ctx_denominator"), "mutation_run")
    rows = inputs.join(c, "repo")
    low = F.lower("label")
    hits = [F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in ("AI-Native", "Not Ready", "Solid", "Basic")]
    claimed = F.array_compact(F.array(*hits))
    tier = F.when(F.size(claimed) == 1, F.element_at(claimed, 1))
    checks = F.array_compact(
        F.array(
            F.when((F.col("run_id") != "") & (F.col("ctx_run") != "") & (F.col("run_id") != F.col("ctx_run")), F.lit("run_id_mismatch")),
            F.when(F.col("denominator") != F.col("ctx_denominator"), F.lit("denominator_mismatch")),
            F.when(F.col("score") > F.col("denominator"), F.lit("score_exceeds_denominator")),
            F.when(tier != scores.maturity_band(F.col("score"), F.col("denominator")), F.lit("maturity_mismatch")),
            F.when(~F.col("mutation_run") & (F.col("layer6") > 0.5), F.lit("layer6_cap")),
        )
    )
    of_rows = rows.select("repo", F.explode(checks).alias("violation"))
    unknown = hotspot_actions.select("repo", "path").join(hotspots.select("repo", "path"), ["repo", "path"], "left_anti")
    return of_rows.unionByName(unknown.select("repo", F.concat(F.lit("unknown_hotspot:"), "path").alias("violation")))


def carry_status(actions: DataFrame, prior: DataFrame) -> DataFrame:
    """Status of a known directive is carried on; unknown ones are pending (2.3.27)."""
    valid = actions.where(
        F.col("rank").isNotNull() & F.col("action").isNotNull() & F.col("done_when").isNotNull() & F.col("scope_fence").isNotNull()
    )
    old = prior.groupBy("repo", "action").agg(F.max_by(F.struct("status", "claimed_by", "completed_sha"), "run").alias("old"))
    joined = valid.join(old, ["repo", "action"], "left")
    status = F.when(F.col("old.status").isin(fv.ACTION_STATUSES), F.col("old.status")).otherwise("pending")
    return joined.select(
        "repo", "rank", "action", "done_when", "scope_fence", status.alias("status"), F.col("old.claimed_by").alias("claimed_by"),
        F.col("old.completed_sha").alias("completed_sha"), scores.mode_for_finding(F.coalesce("finding", F.lit(""))).alias("mode"),
    )


def actions_by_rank(actions: DataFrame, k: int = 3) -> DataFrame:
    return top_k(actions, ["repo"], [F.asc("rank"), F.asc("action")], k, rank="position")


def equivalence_summary(cases: DataFrame) -> DataFrame:
    """Verdict counts of an A/B comparison; unclear verdicts count as regressed (2.4.42)."""
    known = F.col("verdict").isin("equivalent", "candidate-diverged")
    gain = F.avg(F.col("candidate_directness") - F.col("original_directness"))
    agg = cases.groupBy("pair_id").agg(
        F.count_if(~known).alias("regressions"),
        F.count_if(F.col("verdict") == "candidate-diverged").alias("divergences"),
        F.count_if(F.col("verdict") == "equivalent").alias("equivalents"),
        gain.alias("directness_gain"),
    )
    return agg.withColumn("pass", F.col("regressions") == 0).withColumn(
        "efficiency_gain", (F.col("regressions") == 0) & (F.col("directness_gain") > 0)
    )


def distill_rounds(rounds: DataFrame, cases: int) -> DataFrame:
    """Smallest passing round of each document, ratio and runner cost (2.4.43).

    ``rounds(doc, round, characters, is_original, passed)``.
    """
    candidate = ~F.col("is_original")
    good = F.when(candidate & F.col("passed"), F.struct("characters", "round"))
    agg = rounds.groupBy("doc").agg(
        F.max(F.when(F.col("is_original"), F.col("characters"))).alias("original"),
        F.min(good).alias("best"),
        F.count_if(candidate).alias("rounds"),
    )
    return agg.select(
        "doc", F.col("best.round").alias("best_round"),
        F.try_divide(F.coalesce(F.col("best.characters"), F.col("original")), F.col("original")).alias("ratio"),
        (F.coalesce(F.col("best.characters"), F.col("original")) / fv.CHARS_PER_TOKEN).alias("tokens"),
        (F.lit(cases) * (1 + F.col("rounds"))).alias("runner_cost"),
        F.lit(cases * (1 + fv.DEFAULT_ROUNDS)).alias("estimated_cost"),
    )


def transfer_set_coverage(cases: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections no case exercises, and whether a set is usable (2.11.23).

    ``cases(doc, case_id, type, section)``, one row per exercised section.
    """
    per_doc = cases.groupBy("doc").agg(F.count_distinct("case_id").alias("cases"), F.count_distinct("type").alias("types"))
    used = cases.select("doc", "section").distinct().withColumn("used", F.lit(True))
    hit = sections.select("doc", "section").distinct().join(used, ["doc", "section"], "left")
    cover = hit.groupBy("doc").agg(F.count(F.lit(1)).alias("identified"), F.count_if("used").alias("covered"))
    rows = cover.join(per_doc, "doc", "left").na.fill(0)
    usable = (F.col("cases") >= fv.MIN_TRANSFER_CASES) & (F.col("types") == len(fv.TRANSFER_CASE_TYPES))
    return rows.select("doc", "identified", "covered", "cases", "types", (F.col("identified") - F.col("covered")).alias("uncovered"), usable.alias("usable"))


def uncovered_sections(cases: DataFrame, sections: DataFrame) -> DataFrame:
    return sections.select("doc", "section").distinct().join(cases.select("doc", "section"), ["doc", "section"], "left_anti")


def panel_gates(findings: DataFrame, dissent: DataFrame, amendments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Three gates of a review round and whether it promotes (2.11.22).

    ``findings(target, round, lens, severity, clause_status)``,
    ``dissent(target, round, severity)`` cumulative,
    ``amendments(target, round, lens)``, ``verdicts(target, round, lens, verdict)``.
    """
    key = ["target", "round"]
    failing = (F.col("lens") == "fidelity") & (F.col("severity") == "HIGH") & (F.col("clause_status") != "assumed-rejected")
    g1 = findings.groupBy(*key).agg((~F.bool_or(failing)).alias("gate1"))
    first_high = dissent.where(F.col("severity") == "HIGH").groupBy("target").agg(F.min("round").alias("high_from"))
    gain = (
        amendments.join(verdicts, [*key, "lens"]).groupBy(*key).agg(F.bool_or(F.col("verdict") == "better").alias("gate3"))
    )
    rows = g1.join(first_high, "target", "left").join(gain, key, "left")
    gate2 = F.col("gate1") & ~F.coalesce(F.col("high_from") <= F.col("round"), F.lit(False))
    reason = (
        F.when(gate2, "promoted").when(~F.col("gate1"), "fidelity").when(F.coalesce("gate3", F.lit(False)), "high_dissent")
        .otherwise("high_dissent_no_gain")
    )
    return rows.select(*key, "gate1", gate2.alias("gate2"), F.coalesce("gate3", F.lit(False)).alias("gate3"), gate2.alias("promote"), reason.alias("reason"))
