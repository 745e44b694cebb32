"""Text predicates and small parsers as Column expressions.

Patterns come from other tools where ``\\w`` and ``\\b`` know Unicode letters;
``UNICODE`` keeps that meaning on the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.functions import paths

UNICODE = "(?U)"
STRINGS = "array<string>"


def _lit(pattern: str) -> Column:
    return F.lit(pattern)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, _lit(pattern), F.lit(group))


def folded(text: Column) -> Column:
    """Lower case that also folds letters whose only link is their upper case."""
    return F.lower(F.upper(text))


def count_matches(text: Column, folded_text: Column, patterns: Iterable[tuple[str, str]], flags: str = "(?i)" + UNICODE) -> Column:
    """Matches of all patterns, case ignored.

    A pattern runs only where the literal it cannot match without occurs; the
    literal test costs a fraction of the regex on a long text.
    """
    total = F.lit(0)
    for pattern, literal in patterns:
        hits = F.regexp_count(text, _lit(flags + pattern))
        total = total + F.when(F.contains(folded_text, F.lit(literal)), hits).otherwise(0)
    return total


def line_count(text: Column) -> Column:
    """Number of lines; a final line break opens no new line."""
    body = F.regexp_replace(text, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])$", "")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(
        F.regexp_count(body, _lit(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")) + 1
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, _lit(UNICODE + r"\S+"))


def strip_code_spans(text: Column) -> Column:
    """Remove fenced blocks, then inline code (2.8.4)."""
    return F.regexp_replace(F.regexp_replace(text, fv.FENCE_PATTERN, ""), fv.INLINE_CODE_PATTERN, "")


def wikilinks(text: Column) -> Column:
    return all_matches(text, fv.WIKILINK_PATTERN, 1)


def mdlinks(text: Column) -> Column:
    return all_matches(text, fv.MDLINK_PATTERN, 1)


def _strip_ref(ref: Column) -> Column:
    bare = F.regexp_replace(paths.strip_anchor_alias(ref), "^[\"']+|[\"']+$", "")
    return F.regexp_replace(bare, r"[/.,;:)]+$", "")


def path_refs(text: Column) -> Column:
    """Paths named in inline code, wikilinks or bare slash tokens (2.8.6)."""
    code = F.filter(
        F.transform(
            all_matches(text, r"`([^`\n]{1,200})`", 1),
            lambda r: F.regexp_replace(paths.strip_anchor_alias(r), "^[\"']+|[\"']+$", ""),
        ),
        lambda r: F.contains(r, F.lit("/")) | r.rlike(r"\.(md|py)$"),
    )
    bare = all_matches(F.regexp_replace(text, r"`[^`\n]{1,200}`", " "), UNICODE + fv.BARE_PATH_PATTERN, 1)
    refs = F.concat(F.transform(code, _strip_ref), F.transform(wikilinks(text), _strip_ref), F.transform(bare, _strip_ref))
    return F.array_distinct(F.filter(refs, lambda r: r != ""))


def declares_boundaries(text: Column) -> Column:
    return text.rlike(UNICODE + fv.BOUNDARY_VOCABULARY)


def in_comment(line: Column, pattern: str, is_prose: Column) -> Column:
    """A hit counts in prose, after a comment leader, or at the line start (2.2.12)."""
    # everything before the first match, looked at once
    before = F.array(F.regexp_extract(line, rf"(?s)^(.*?)(?:{pattern})", 1))
    leaders = "|".join(re.escape(mark) for mark in fv.COMMENT_LEADERS)
    marked = F.exists(before, lambda prefix: prefix.rlike(rf"(?s){leaders}|^\s*$"))
    return is_prose | (line.rlike(pattern) & marked)


def is_linked(text: Column, family: Column) -> Column:
    """Cites an issue, ticket, link or date; suppressions may also be justified (2.2.13)."""
    return text.rlike(UNICODE + fv.LINKED_PATTERN) | (
        (family == "suppression") & text.rlike(fv.JUSTIFIED_PATTERN)
    )


def is_concrete_credential(value: Column) -> Column:
    bare = F.regexp_replace(value, "^[\"']+|[\"']+$", "")
    return (bare != "") & ~bare.rlike(UNICODE + fv.CREDENTIAL_PLACEHOLDER)


def is_routable_ipv4(ip: Column) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda o: o.try_cast("int"))
    in_range = F.forall(octets, lambda o: o <= 255)
    return in_range & (F.element_at(octets, 1) != 127) & (ip.rlike("[1-9]"))


def redact(token: Column, keep: int = 0) -> Column:
    trimmed = F.trim(token)
    if keep <= 0:
        return F.lit("***")
    return F.when(F.length(trimmed) <= keep, F.lit("***")).otherwise(F.concat(F.left(trimmed, F.lit(keep)), F.lit("***")))


def est_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / F.lit(fv.CHARS_PER_TOKEN)).cast("long"))


def _unquote(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']+|[\"']+$", "")


def frontmatter_lines(text: Column) -> Column:
    """Lines of the leading ``---`` block; empty without one."""
    block = F.regexp_extract(text, r"(?s)\A\x{FEFF}?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    return F.when(block == "", F.array().cast(STRINGS)).otherwise(F.split(block, "\n"))


_KEY_VALUE = r"^([A-Za-z_][\w-]*)\s*:\s*(.*)$"
_LIST_ITEM = r"^\s*-\s+(.*)$"


def frontmatter_fields(text: Column) -> Column:
    """Scalar keys of the block as a map, tags left out (2.8.25)."""
    pairs = F.filter(
        F.transform(
            frontmatter_lines(text),
            lambda l: F.struct(
                F.lower(F.regexp_extract(l, _KEY_VALUE, 1)).alias("key"),
                _unquote(F.trim(F.regexp_extract(l, _KEY_VALUE, 2))).alias("value"),
                l.rlike(_LIST_ITEM).alias("item"),
            ),
        ),
        lambda p: ~p["item"] & (p["key"] != "") & (p["key"] != "tags") & (p["value"] != ""),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(
        F.transform(
            keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
        )
    )


def frontmatter_tags(text: Column) -> Column:
    """Tags of the block, lower case, from the inline and the list form."""
    lines = frontmatter_lines(text)
    inline = F.flatten(
        F.transform(
            F.filter(lines, lambda l: F.lower(F.regexp_extract(l, _KEY_VALUE, 1)) == "tags"),
            lambda l: F.regexp_extract_all(F.regexp_extract(l, _KEY_VALUE, 2), _lit(UNICODE + r"[#\w/-]+"), F.lit(0)),
        )
    )
    # the block list directly under an empty `tags:` key
    listed = F.split(
        F.regexp_extract(F.array_join(lines, "\n"), r"(?mi)^tags[ \t]*:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|$)|[ \t]*\n)+)", 1), "\n"
    )
    items = F.transform(F.filter(listed, lambda l: l.rlike(_LIST_ITEM)), lambda l: _unquote(F.trim(F.regexp_extract(l, _LIST_ITEM, 1))))
    tags = F.transform(F.concat(inline, items), lambda t: F.lower(F.regexp_replace(t, "^#+", "")))
    return F.array_distinct(F.filter(tags, lambda t: t != ""))


def _clean_value(value: Column) -> Column:
    uncommented = F.trim(F.substring_index(value, " #", 1))
    return F.trim(F.regexp_replace(uncommented, r"""^(["'])(.*)\1$""", "$2"))


def provenance_sources(text: Column) -> Column:
    """``source:`` as a scalar, a flow list or a block list (2.8.26)."""
    lines = frontmatter_lines(text)
    block = F.array_join(lines, "\n")
    scalar = F.trim(F.regexp_extract(block, r"(?mi)^[ \t]*source[ \t]*:[ \t]*(\S.*)$", 1))
    flow = F.when(
        scalar.rlike(r"^\[.*\]$"), F.split(F.regexp_replace(scalar, r"^\[|\]$", ""), ",")
    ).otherwise(F.array(scalar))
    listed = F.split(
        F.regexp_extract(block, r"(?mi)^[ \t]*source[ \t]*:[ \t]*\n((?:[ \t]*- .*(?:\n|$))+)", 1), "\n"
    )
    items = F.transform(listed, lambda l: F.regexp_extract(l, r"^\s*- (.*)$", 1))
    return F.filter(F.transform(F.concat(flow, items), _clean_value), lambda s: s != "")


def generated_by(text: Column) -> Column:
    block = F.array_join(frontmatter_lines(text), "\n")
    value = _clean_value(F.regexp_extract(block, r"(?mi)^[ \t]*generated_by[ \t]*:[ \t]*(.*)$", 1))
    return F.when(value != "", value)


def query_folders(text: Column) -> Column:
    """Folders a hub query selects (2.8.27)."""
    from_clauses = F.array_join(all_matches(text, UNICODE + r"(?i)\bFROM\b([^\n]*)", 1), "\n")
    return F.array_distinct(
        F.concat(
            all_matches(text, r"""(?i)inFolder\(\s*["']([^"']+)["']\s*\)""", 1),
            all_matches(from_clauses, r"""["']([^"']+)["']""", 1),
        )
    )


def query_tags(text: Column) -> Column:
    from_clauses = F.array_join(all_matches(text, UNICODE + r"(?i)\bFROM\b([^\n]*)", 1), "\n")
    found = F.concat(
        all_matches(from_clauses, UNICODE + r"#([A-Za-z0-9][\w/-]*)", 1),
        all_matches(text, UNICODE + r"""(?i)(?:hasTag\(|tags\.contains\()\s*["']#?([\w/-]+)["']""", 1),
    )
    return F.array_distinct(F.transform(found, F.lower))


QUERY_FIELD_SKIP = [
    "infolder", "hastag", "contains", "ext", "from", "where", "and", "or", "name", "tags", "file", "note",
]


def query_fields(text: Column) -> Column:
    """``key == "value"`` predicates outside the ``file.`` namespace."""
    whole = all_matches(text, UNICODE + r"""(?:\b\w+\.)?[A-Za-z_][\w-]*\s*={1,2}\s*["'][^"']+["']""", 0)
    pattern = r"""^(\w+\.)?([A-Za-z_][\w-]*)\s*={1,2}\s*["']([^"']+)["']$"""
    fields = F.transform(
        whole,
        lambda m: F.struct(
            F.lower(F.regexp_extract(m, UNICODE + pattern, 1)).alias("space"),
            F.lower(F.regexp_extract(m, UNICODE + pattern, 2)).alias("key"),
            F.regexp_extract(m, UNICODE + pattern, 3).alias("value"),
        ),
    )
    kept = F.filter(fields, lambda f: (f["space"] != "file.") & ~f["key"].isin(QUERY_FIELD_SKIP))
    return F.transform(kept, lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value")))
