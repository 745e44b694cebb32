"""Many globs at once: one automaton for all rules of a repository, run once over each path.

A rule is a row of states, one for each character it has consumed. A step moves
every state whose next token takes the character and keeps those that stand at a
star, for all rules together, as operations on one long integer. So a path costs
its length times a few operations, however many rules there are, and no rule is
tried by itself.

``*`` takes any characters, ``/`` included, ``?`` one. Brackets are as in
``functions.paths``: one that does not close is literal, a range that runs
backwards takes nothing. A rule that is not anchored may begin after any ``/``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = re.compile(r"\[!?\]?[^\]]*\]|\*+|\?|\[|[^*?\[]+", re.S)
FILES_PER_SLICE = 200_000


def _bracket(part: str) -> Callable[[str], bool] | None:
    """What a closed bracket takes; None where it is literal."""
    if len(part) <= 2 or part == "[!]" or part[-1] != "]":
        return None
    negated = part[1] == "!"
    members = re.findall(r".-.|.", part[2:-1] if negated else part[1:-1], re.S)
    single = {m for m in members if len(m) == 1}
    ranges = [(m[0], m[2]) for m in members if len(m) == 3]
    return lambda c: (c in single or any(a <= c <= b for a, b in ranges)) != negated


class GlobSet:
    """The automaton of ``(glob, anchored)`` rules; ``matches`` gives the numbers of those that take a whole path."""

    def __init__(self, rules: Iterable[tuple[str, bool]]):
        self.start = self.restart = self.loops = self.ends = self.any = 0
        self.literal: dict[str, int] = {}
        self.classes: list[tuple[Callable[[str], bool], int]] = []
        self.rule_at: dict[int, int] = {}
        self.takes: dict[str, int] = {}
        bit = 0
        for number, (glob, anchored) in enumerate(rules):
            self.start |= 1 << bit
            if not anchored:
                self.restart |= 1 << bit
            for part in PARTS.findall(glob):
                inside = _bracket(part) if part[0] == "[" else None
                if part[0] == "*":
                    self.loops |= 1 << bit
                elif part == "?":
                    self.any |= 1 << bit
                    bit += 1
                elif inside is not None:
                    self.classes.append((inside, 1 << bit))
                    bit += 1
                else:
                    for c in part:
                        self.literal[c] = self.literal.get(c, 0) | 1 << bit
                        bit += 1
            self.ends |= 1 << bit
            self.rule_at[bit] = number
            bit += 1

    def _taking(self, c: str) -> int:
        """The states whose next token takes ``c``."""
        found = self.takes.get(c)
        if found is None:
            found = self.any | self.literal.get(c, 0)
            for inside, bit in self.classes:
                if inside(c):
                    found |= bit
            self.takes[c] = found
        return found

    def matches(self, path: str) -> list[int]:
        state = self.start
        for c in path:
            state = (state & self._taking(c)) << 1 | state & self.loops
            if c == "/":
                state |= self.restart
        out, found = [], state & self.ends
        while found:
            low = found & -found
            out.append(self.rule_at[low.bit_length() - 1])
            found ^= low
        return out


def matched(rules: DataFrame, files: DataFrame, files_per_slice: int = FILES_PER_SLICE) -> DataFrame:
    """``repo, pattern, path`` for ``rules(repo, pattern, glob, anchored)`` and ``files(repo, path)``.

    The files of a repository are cut into slices of bounded size and its rules go
    to each slice, where they become one automaton; a repository without rules of
    this kind is not dealt out at all.
    """
    counts = files.join(rules.select("repo").distinct(), "repo", "left_semi").groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / F.lit(files_per_slice)).cast("long").alias("slices"))
    dealt = files.select("repo", "path").join(counts, "repo").withColumn("slice", F.pmod(F.xxhash64("path"), F.col("slices"))).drop("slices")
    own = rules.join(counts, "repo").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")

    def run(key: tuple, paths: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
        globs = GlobSet(zip(patterns["glob"], patterns["anchored"], strict=True))
        names = patterns["pattern"].tolist()
        hits = [(key[0], names[n], path) for path in paths["path"] for n in globs.matches(path)]
        return pd.DataFrame(hits, columns=["repo", "pattern", "path"], dtype="object")

    grouped = dealt.groupBy("repo", "slice").cogroup(own.groupBy("repo", "slice"))
    return grouped.applyInPandas(run, "repo string, pattern string, path string")
