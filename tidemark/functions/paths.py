"""Path predicates and decompositions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path; the repository root is the empty string."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def depth(directory: Column) -> Column:
    return F.when(directory == "", F.lit(0)).otherwise(F.size(F.split(directory, "/")))


def ancestors(path: Column) -> Column:
    """Directories above a path, shallowest first, without the root."""
    p = parts(path)
    return F.when(
        F.size(p) > 1,
        F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_join(F.slice(p, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))


def self_and_ancestors(directory: Column) -> Column:
    """A directory and everything above it, root included."""
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), ancestors(directory), F.array(directory))
    )


def common_directories(first: Column, last: Column) -> Column:
    """Directories above both paths.

    With the smallest and the largest path of a set these are the directories
    that hold the whole set, since every path between them shares their prefix.
    """
    a, b = ancestors(first), ancestors(last)
    return F.array_intersect(a, b)


def under(path: Column, folder: Column | str) -> Column:
    """Component-prefix test; an empty folder selects everything (2.2.18)."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return (folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def glob_regex(glob: str) -> str:
    """Shell glob to an anchored regex; ``*`` crosses ``/`` (2.8.7)."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def globs_regex(globs: Iterable[str]) -> str:
    """One alternation for a list of globs."""
    return "|".join(glob_regex(g) for g in globs)


def _bracket_regex(body: Column) -> Column:
    """A bracket's inside as a character class: ranges that run backwards match nothing, all else is literal."""
    escaped = lambda c: F.regexp_replace(c, r"([\\\[\]&^~-])", r"\\$1")
    first, last = lambda x: F.substring(x, 1, 1), lambda x: F.substring(x, 3, 1)
    members = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), F.lit(1)),
        lambda x: F.when(F.length(x) == 1, escaped(x)).when(first(x) <= last(x), F.concat(escaped(first(x)), F.lit("-"), escaped(last(x)))).otherwise(""),
    )
    return F.array_join(members, "")


def glob_column_regex(glob: Column) -> Column:
    """The same translation for a pattern held in a column; a bracket that does not close is literal."""
    parts = F.regexp_extract_all(glob, F.lit(r"(?s)(\[!?\]?[^\]]*\]|\*+|\?|\[|[^*?\[]+)"), F.lit(1))

    def part(x: Column) -> Column:
        inside = _bracket_regex(F.regexp_extract(x, r"(?s)^\[!?(.*)\]$", 1))
        negated = F.startswith(x, F.lit("[!"))
        bracket = (
            F.when(negated & (inside == ""), ".").when(negated, F.concat(F.lit("[^"), inside, F.lit("]")))
            .when(inside == "", "(?!)").otherwise(F.concat(F.lit("["), inside, F.lit("]")))
        )
        literal = F.regexp_replace(x, r"([.+^$(){}|\\\[\]*?&~#-])", r"\\$1")
        return (
            F.when(F.startswith(x, F.lit("*")), ".*").when(x == "?", ".")
            .when(x.rlike(r"(?s)^\[.+\]$") & (F.length(x) > 2) & (x != "[!]"), bracket).otherwise(literal)
        )

    return F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform(parts, part), ""), F.lit(")$"))


def is_excluded_path(path: Column) -> Column:
    """Any excluded directory component, or the excluded sequence (2.2.1)."""
    return F.arrays_overlap(parts(path), _strings(fv.EXCLUDED_DIRS)) | path.rlike(
        rf"(^|/){re.escape(fv.EXCLUDED_SEQUENCE)}(/|$)"
    )


def is_user_excluded(path: Column, dirs: list[str], globs: list[str]) -> Column:
    """Caller-supplied directory names and basename globs (2.2.2)."""
    hit = F.lit(False)
    if dirs:
        hit = hit | F.arrays_overlap(parts(path), _strings(dirs))
    if globs:
        hit = hit | basename(path).rlike(globs_regex(globs))
    return hit


def split_excludes(values: list[str]) -> tuple[list[str], list[str]]:
    """Plain names are directories; anything with a metacharacter is a glob."""
    globs = [v for v in values if re.search(r"[*?\[]", v)]
    return [v for v in values if v not in globs], globs


def is_build_artifact(path: Column) -> Column:
    return basename(path).rlike(globs_regex(fv.BUILD_ARTIFACT_GLOBS))


def is_test_file(path: Column) -> Column:
    return basename(path).rlike(fv.TEST_FILE_PATTERN)


def is_test_stem(path: Column) -> Column:
    return stem(path).rlike(fv.TEST_STEM_PATTERN)


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(fv.CODE_EXTENSIONS), "code")
        .when(ext.isin(fv.DOC_EXTENSIONS), "doc")
        .when(ext.isin(fv.BASE_VIEW_EXTENSIONS), "base-view")
        .otherwise("other")
    )


def is_entry_doc(path: Column) -> Column:
    """Entry basenames count at the repository root only (2.2.6)."""
    return ~F.contains(path, F.lit("/")) & F.lower(path).isin(fv.ENTRY_BASENAMES)


def is_declared_moc(path: Column) -> Column:
    return F.lower(basename(path)).isin(fv.MOC_BASENAMES) | stem(path).rlike("(?i)" + fv.MOC_STEM_PATTERN)


def is_base_doc(path: Column) -> Column:
    name = F.lower(basename(path))
    named_after_dir = F.lower(stem(path)) == F.lower(basename(parent(path)))
    return ~name.isin(fv.BOILERPLATE_BASENAMES) & (
        name.isin(fv.BASE_DOC_PRECEDENCE) | named_after_dir | is_declared_moc(path)
    )


def is_external(target: Column) -> Column:
    return target.rlike(fv.EXTERNAL_URI_PATTERN)


def strip_anchor_alias(target: Column) -> Column:
    """Drop ``|alias``, ``#anchor`` and ``?query`` (2.8.3)."""
    return F.trim(F.regexp_replace(target, r"(?s)[|#?].*$", ""))


def normalize_link(source: Column, target: Column) -> Column:
    """Join a link target to its page or the root and collapse ``.``/``..``.

    Null when the target climbs out of the repository (2.8.2).
    """
    joined = F.when(F.startswith(target, F.lit("/")), target).otherwise(
        F.concat_ws("/", parent(source), target)
    )
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        return (
            F.when(acc.isNull() | ((part == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>"))
            .when(part.isin("", "."), acc)
            .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(joined, "/"), empty, step), "/")


def normalize_keep(source: Column, target: Column) -> Column:
    """The same collapse for display: a climb above the root stays as ``..``."""
    joined = F.when(F.startswith(target, F.lit("/")), F.regexp_replace(target, "^/+", "")).otherwise(
        F.concat_ws("/", parent(source), target)
    )

    def step(acc: Column, part: Column) -> Column:
        climbs = (F.size(acc) == 0) | (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) == "..")
        return (
            F.when(part.isin("", "."), acc)
            .when((part == "..") & ~climbs, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/")


def slug_for_path(path: Column) -> Column:
    """Readable slug plus eight hex digits of the path's sha256 (2.8.8)."""
    readable = F.lower(F.regexp_replace(F.regexp_replace(path, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.concat(readable, F.lit("-"), F.left(F.sha2(path, 256), F.lit(8)))


def scope_slug(scope: Column) -> Column:
    return F.regexp_replace(scope, r"[/\\]", "-")


def canonical_pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("file_a"), F.greatest(a, b).alias("file_b"))
