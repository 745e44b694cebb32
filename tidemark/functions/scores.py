"""Scores, ladders and closed lookups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.create_map(*pairs)[key]


def _ladder(value: Column, steps: list[tuple[float, str]], below: str) -> Column:
    out = None
    for floor, label in steps:
        out = F.when(value >= floor, label) if out is None else out.when(value >= floor, label)
    return out.otherwise(below)


def mode_for_finding(name: Column) -> Column:
    return F.coalesce(_lookup(name, {n: mode for n, _, mode in fv.FINDINGS}), F.lit(fv.DEFAULT_MODE))


def finding_action(name: Column) -> Column:
    return _lookup(name, {n: action for n, action, _ in fv.FINDINGS})


def finding_ordinal(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n, _, _ in fv.FINDINGS]), name)


def display_name(name: Column) -> Column:
    return F.coalesce(_lookup(name, fv.DISPLAY_NAMES), F.replace(name, F.lit("_"), F.lit(" ")))


def months_label(months: Column) -> Column:
    return F.when(months < 1.0, "<1mo").otherwise(F.concat(F.bround(months, 0).cast("long").cast("string"), F.lit("mo")))


def metric_format(value: Column) -> Column:
    """Whole numbers without a decimal point, others as they are."""
    return (
        F.when(value.isNull(), "-")
        .when(value == F.floor(value), F.floor(value).cast("long").cast("string"))
        .otherwise(value.cast("string"))
    )


def days_since(epoch: Column, as_of: Column) -> Column:
    """Whole days between two epoch seconds, never negative (2.8.13)."""
    days = F.greatest(F.floor((as_of - epoch) / F.lit(86400)), F.lit(0)).cast("long")
    return F.when(epoch.isNotNull(), days)


def span_months(first: Column, last: Column) -> Column:
    return F.greatest(last - first, F.lit(0)) / F.lit(86400.0) / F.lit(fv.DAYS_PER_MONTH)


def signed_freshness(ratio: Column, source_newer: Column | None = None) -> Column:
    """+1 fresh to -1 stale; a known source order decides outright (2.8.15)."""
    by_ratio = F.greatest(
        F.lit(-1.0), F.least(F.lit(1.0), (F.lit(fv.STALENESS_RATIO) - ratio) / F.lit(fv.STALENESS_RATIO))
    )
    if source_newer is None:
        return by_ratio
    return F.when(source_newer, F.lit(-1.0)).when(~source_newer, F.lit(1.0)).otherwise(by_ratio)


def effective_ccn(ccn: Column, max_fn_ccn: Column) -> Column:
    weighted = F.pow(max_fn_ccn, F.lit(fv.PER_FUNCTION_WEIGHT)) * F.pow(ccn, F.lit(1.0 - fv.PER_FUNCTION_WEIGHT))
    return F.when(max_fn_ccn.isNull() | (max_fn_ccn == 0), ccn.cast("double")).otherwise(weighted)


def hotspot_score(ccn: Column, max_fn_ccn: Column, commits: Column, tokens: Column) -> Column:
    return F.sqrt(effective_ccn(ccn, max_fn_ccn)) * F.sqrt(F.lit(1.0) + commits) * F.sqrt(tokens)


def high_ccn_threshold(p95: Column) -> Column:
    return F.greatest(F.coalesce(p95, F.lit(0.0)), F.lit(fv.MIN_HIGH_CCN))


def adaptive_cap(peak: Column, p95: Column) -> Column:
    """The maximum, or p95 when the maximum is an outlier (2.8.19)."""
    return (
        F.when(F.coalesce(peak, F.lit(0.0)) == 0, F.lit(1.0))
        .when((p95 > 0) & (peak > 5 * p95), p95)
        .otherwise(peak)
    )


def adaptive_cap_kind(peak: Column, p95: Column) -> Column:
    return F.when((p95 > 0) & (peak > 5 * p95), "p95 (outlier-suppressed)").otherwise("max")


def hatch_level(density: Column) -> Column:
    return F.when(density > fv.HATCH_CROSS, "cross").when(density > fv.HATCH_DIAG, "diag").otherwise("")


def marker_severity(family: Column, survived: Column, decile: Column) -> Column:
    weight = F.create_map(*[F.lit(x) for item in fv.MARKER_WEIGHTS.items() for x in item])[family]
    return weight * F.greatest(F.coalesce(survived, F.lit(0)), F.lit(0)) * (1 + decile / 10)


def letter_grade(score: Column) -> Column:
    return _ladder(score, fv.LETTER_GRADES, "F")


def _ratio(score: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(score, denominator), F.lit(0.0))


def maturity_band(score: Column, denominator: Column) -> Column:
    return _ladder(_ratio(score, denominator), fv.MATURITY_BANDS, "Not Ready")


def score_color(score: Column, denominator: Column) -> Column:
    return _ladder(_ratio(score, denominator), fv.SCORE_COLORS, "red")


def badge_color(concerns: Column, stale: Column) -> Column:
    return F.when((concerns == 0) & (stale == 0), "green").when(concerns <= 2, "yellow").otherwise("orange")


def gap_signal(coverage: Column, mutation_score: Column) -> Column:
    return (
        F.when(coverage.isNull() | mutation_score.isNull(), "not assessed")
        .when(
            (coverage >= fv.HIGH_COVERAGE) & (mutation_score <= fv.LOW_MUTATION_SCORE),
            "high coverage + low mutation score",
        )
        .otherwise("no gap")
    )


def classify_node(is_entry: Column, is_reachable: Column, in_degree: Column) -> Column:
    return (
        F.when(is_entry, "entry")
        .when(is_reachable, "reachable")
        .when(in_degree == 0, "orphan")
        .otherwise("island")
    )


def semver(value: Column) -> Column:
    """Leading MAJOR.MINOR.PATCH as a struct, null when there is none (2.8.10)."""
    pattern = r"^\s*v?(\d+)\.(\d+)\.(\d+)"
    major = F.regexp_extract(value, pattern, 1).try_cast("int")
    return F.when(
        major.isNotNull(),
        F.struct(
            major.alias("major"),
            F.regexp_extract(value, pattern, 2).try_cast("int").alias("minor"),
            F.regexp_extract(value, pattern, 3).try_cast("int").alias("patch"),
        ),
    )


def major_version(value: Column) -> Column:
    """Tolerant major: leading ``v`` and missing minor are fine."""
    head = F.split(F.regexp_replace(F.trim(value), "^[vV]+", ""), r"\.")[0]
    return F.trim(head).try_cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chain_hash(previous: Column, text: Column) -> Column:
    return F.left(F.sha2(F.concat(previous, text), 256), F.lit(fv.CHAIN_LENGTH))
