"""Ignore rules as column expressions.

A rule list is small and known before the job starts, or is the text of one ignore file.
Every path carries the whole chain of its directories, so the state that a directory hands
down to its children can be folded along that chain inside the row. No join, no shuffle,
and file bodies stay where they are.

Per directory two outcomes matter: the next state if the parent is not ignored, and the
next state if it is. They differ only in name-only negations, which cannot bring back
anything below an ignored directory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.core import bind
from quire.functions.paths import normalize_path


class IgnoreRuleError(ValueError):
    """A rule that can match nothing because nothing is left of it."""


#: The character classes of bracket expressions.
_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
}


def _bracket(glob: str, start: int) -> tuple[str, int] | None:
    """Translate ``[...]`` beginning at ``start``; None when it is never closed."""
    i = start + 1
    negate = i < len(glob) and glob[i] in "!^"
    if negate:
        i += 1
    out: list[str] = []
    first = True
    while i < len(glob):
        char = glob[i]
        if char == "]" and not first:
            if negate:
                return f"[^/{''.join(out)}]", i + 1
            # Java has no empty class: what holds no character matches nothing.
            return f"[{''.join(out)}]" if out else "(?!)", i + 1
        first = False
        named = re.match(r"\[:([a-z]+):\]", glob[i:])
        if named:
            # An unknown class holds no character.
            out.append(_CLASSES.get(named.group(1), ""))
            out = [piece for piece in out if piece]
            i += named.end()
            continue
        char, i = _bracket_char(glob, i)
        if i + 1 < len(glob) and glob[i] == "-" and glob[i + 1] != "]":
            last, i = _bracket_char(glob, i + 1)
            if char <= last:  # a reversed range holds no character
                out.append(f"{_literal(char)}-{_literal(last)}")
            continue
        out.append(_literal(char))
    return None


def _bracket_char(glob: str, i: int) -> tuple[str, int]:
    if glob[i] == "\\" and i + 1 < len(glob):
        i += 1
    return glob[i], i + 1


def _literal(char: str) -> str:
    return f"\\{char}" if not char.isalnum() and char.isascii() else char


def glob_regex(glob: str) -> str:
    """Java regular expression for one path segment."""
    out: list[str] = []
    i = 0
    while i < len(glob):
        char = glob[i]
        if char == "*":
            if not out or out[-1] != "[^/]*":
                out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "[" and (group := _bracket(glob, i)):
            out.append(group[0])
            i = group[1]
            continue
        else:
            if char == "\\":
                if i + 1 == len(glob):
                    return r"(?!)"
                i += 1
                char = glob[i]
            out.append(f"\\{char}" if not char.isalnum() and char.isascii() else char)
        i += 1
    return "".join(out)


def _path_regex(segments: list[str]) -> str:
    if segments == ["**"]:
        return ".*"
    out = ""
    glued = True
    for i, segment in enumerate(segments):
        if segment != "**":
            out += ("" if glued else "/") + glob_regex(segment)
            glued = False
        elif i + 1 == len(segments):
            out += "(?:/.*)?"
        else:
            out += ("" if glued else "/") + "(?:[^/]+/)*"
            glued = True
    return out


def _below_regex(segments: list[str]) -> str:
    """Directories at or below which the pattern may still match something."""
    if segments[0] == "**":
        return ".*"
    out, closing = glob_regex(segments[0]), ""
    for segment in segments[1:]:
        if segment == "**":
            out += "(?:/.*)?"
            break
        out += "(?:/" + glob_regex(segment)
        closing += ")?"
    return out + closing


@dataclass(frozen=True)
class IgnoreRule:
    """One compiled rule. ``match`` is unanchored; ``below`` is set for path negations."""

    raw: str
    negated: bool
    dir_only: bool
    path_match: bool
    match: str
    below: str | None

    @staticmethod
    def compile(raw: str) -> IgnoreRule:
        negated = raw.startswith("!")
        source = raw[1:] if negated else raw
        dir_only = source.endswith("/")
        anchored = source.startswith("/")
        body = source[1 if anchored else 0 : len(source) - 1 if dir_only else len(source)]
        if source in ("", "/") or not body:
            raise IgnoreRuleError(f"empty ignore rule: {raw!r}")
        if not anchored and "/" not in body:
            return IgnoreRule(raw, negated, dir_only, False, glob_regex(body), None)
        segments: list[str] = []
        for part in body.split("/"):
            if part and not (part == "**" and segments[-1:] == ["**"]):
                segments.append(part)
        if not segments:
            return IgnoreRule(raw, negated, dir_only, True, "(?!)", "(?!)" if negated else None)
        return IgnoreRule(
            raw, negated, dir_only, True, _path_regex(segments),
            _below_regex(segments) if negated else None,
        )


def rule_lines(text: str) -> list[str]:
    """Rule lines of an ignore file: no blank lines, comments or trailing blanks."""
    lines = (line.rstrip("\r\n \t") for line in text.split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def _alternation(patterns: Iterable[str]) -> str:
    return "(?:" + "|".join(dict.fromkeys(patterns)) + ")"


class _PathFold:
    """Folds the state of a path's directories; rules are supplied by subclasses."""

    def _outcome(self, path: Column, base: Column, is_dir: bool, parent_ignored: bool,
                 ignored_state: Column) -> Column:
        """Next state of one node, 0 for "not ignored" or ``ignored_state``."""
        raise NotImplementedError

    def _may_match_below(self, directory: Column) -> Column | None:
        """Whether an ignored directory can still hold kept files; None means always."""
        raise NotImplementedError

    def node_ignored(self, path: Column, is_dir: bool, parent_ignored: bool = False) -> Column:
        """State of a single path, given the state of its parent directory."""
        base = F.substring_index(path, "/", -1)
        return self._outcome(path, base, is_dir, parent_ignored, F.lit(1)) == 1

    def _directory_state(self, segments: Column) -> Column:
        """State handed to a file by its directories.

        0: not ignored; 1: ignored; ``-k``: the directory at depth ``k`` is ignored and
        nothing below it can come back, so a walk would not enter it.
        """
        chain = F.transform(
            F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))),
            lambda name, i: F.struct(
                (i + 1).alias("depth"),
                F.array_join(F.slice(segments, F.lit(1), i + 1), "/").alias("path"),
                name.alias("base"),
            ),
        )

        def step(state: Column, node: Column) -> Column:
            reachable = self._may_match_below(node["path"])
            ignored = (
                F.lit(1)
                if reachable is None
                else F.when(reachable, F.lit(1)).otherwise(-node["depth"])
            )
            free = self._outcome(node["path"], node["base"], True, False, ignored)
            held = self._outcome(node["path"], node["base"], True, True, ignored)
            return F.when(state < 0, state).when(state == 0, free).otherwise(held)

        return F.aggregate(chain, F.lit(0), step)

    def _folded(self, path: Column) -> Column:
        def decide(segments: Column) -> Column:
            full = F.array_join(segments, "/")
            base = F.try_element_at(segments, F.lit(-1))
            free = self._outcome(full, base, False, False, F.lit(1)) == 1
            held = self._outcome(full, base, False, True, F.lit(1)) == 1
            return bind(
                self._directory_state(segments),
                lambda s: F.when(s < 0, F.lit(True)).when(s == 0, free).otherwise(held),
            )

        return bind(F.split(normalize_path(path), "/", -1), decide)

    def ignored(self, path: Column) -> Column:
        """Whether the file at ``path`` is ignored, its directories included."""
        return self._folded(path)

    def pruned_directory(self, path: Column) -> Column:
        """The ancestor that a walk would skip as a whole, or null."""
        return self._pruned(path)

    def _pruned(self, path: Column) -> Column:
        def locate(segments: Column) -> Column:
            return bind(
                self._directory_state(segments),
                lambda s: F.when(s < 0, F.array_join(F.slice(segments, F.lit(1), -s), "/")),
            )

        return bind(F.split(normalize_path(path), "/", -1), locate)


class IgnoreRules(_PathFold):
    """An ordered rule list that is the same for all rows; the last matching rule decides.

    >>> rules = IgnoreRules(["*.tmp", "!keep.tmp"])
    >>> files.filter(~rules.ignored(F.col("path")))
    """

    def __init__(self, lines: Iterable[str] = (), use_defaults: bool = True):
        defaults = C.DEFAULT_IGNORE_RULES if use_defaults else ()
        own = [line for raw in lines for line in rule_lines(raw)]
        self.rules = tuple(IgnoreRule.compile(raw) for raw in (*defaults, *own))
        self.has_negations = any(rule.negated for rule in self.rules)

    def _runs(self, is_dir: bool, name_negations: bool):
        usable = [
            rule
            for rule in self.rules
            if (is_dir or not rule.dir_only)
            and (name_negations or not rule.negated or rule.path_match)
        ]
        # Neighbours with the same effect share one regular expression.
        for (negated, path_match), run in groupby(
            usable, key=lambda rule: (rule.negated, rule.path_match)
        ):
            yield negated, path_match, rf"(?s)\A{_alternation(r.match for r in run)}\z"

    def _outcome(self, path: Column, base: Column, is_dir: bool, parent_ignored: bool,
                 ignored_state: Column) -> Column:
        state = ignored_state if parent_ignored else F.lit(0)
        for negated, path_match, pattern in self._runs(is_dir, not parent_ignored):
            hit = (path if path_match else base).rlike(pattern)
            state = F.when(hit, F.lit(0) if negated else ignored_state).otherwise(state)
        return state

    def _may_match_below(self, directory: Column) -> Column | None:
        negated = [rule for rule in self.rules if rule.negated]
        if any(not rule.path_match for rule in negated):
            return None
        if not negated:
            return F.lit(False)
        pattern = _alternation(rule.below for rule in negated)
        return directory.rlike(rf"(?s)\A{pattern}\z")

    def _flat_regex(self) -> str:
        """Without negations a path is ignored iff some rule hits it or a parent."""
        grouped: dict[tuple[str, str], list[str]] = {}
        for rule in self.rules:
            lead = r"\A" if rule.path_match else r"(?:\A|/)"
            tail = "/" if rule.dir_only else r"(?:/|\z)"
            grouped.setdefault((lead, tail), []).append(rule.match)
        return "(?s)" + "|".join(
            lead + _alternation(matches) + tail for (lead, tail), matches in grouped.items()
        )

    def ignored(self, path: Column) -> Column:
        if not self.rules:
            return F.lit(False)
        if not self.has_negations:
            return normalize_path(path).rlike(self._flat_regex())
        return self._folded(path)

    def pruned_directory(self, path: Column) -> Column:
        return super().pruned_directory(path) if self.rules else F.lit(None).cast("string")


#: Compiled rules as they travel in a column; patterns are anchored.
RULE_LIST = (
    "array<struct<negated:boolean,dir_only:boolean,path_match:boolean,match:string,below:string>>"
)


def compiled_rules(text: str | None, lines: tuple[str, ...], use_defaults: bool) -> list[tuple]:
    """Rules of one ignore file behind the shared ones, as rows of ``RULE_LIST``.

    Between two changes of polarity the order of rules has no effect, so each such stretch
    needs no more than four patterns: by name or by path, for directories only or for all.
    """
    compiled: list[tuple] = []
    rules = IgnoreRules([*lines, text or ""], use_defaults).rules
    for negated, stretch in groupby(rules, key=lambda rule: rule.negated):
        kinds: dict[tuple[bool, bool], list[IgnoreRule]] = {}
        for rule in stretch:
            kinds.setdefault((rule.dir_only, rule.path_match), []).append(rule)
        for (dir_only, path_match), members in kinds.items():
            below = None
            if negated and path_match:
                below = rf"(?s)\A{_alternation(rule.below for rule in members)}\z"
            match = rf"(?s)\A{_alternation(rule.match for rule in members)}\z"
            compiled.append((negated, dir_only, path_match, match, below))
    return compiled


class RuleColumn(_PathFold):
    """Rules that differ by row, taken from a column of type ``RULE_LIST``."""

    def __init__(self, rules: Column):
        self.column = rules

    def ignored(self, path: Column) -> Column:
        return bind(self.column, lambda rules: RuleColumn(rules)._folded(path))

    def pruned_directory(self, path: Column) -> Column:
        return bind(self.column, lambda rules: RuleColumn(rules)._pruned(path))

    def _outcome(self, path: Column, base: Column, is_dir: bool, parent_ignored: bool,
                 ignored_state: Column) -> Column:
        def step(state: Column, rule: Column) -> Column:
            subject = F.when(rule["path_match"], path).otherwise(base)
            usable = F.rlike(subject, rule["match"])
            if not is_dir:
                usable = ~rule["dir_only"] & usable
            if parent_ignored:
                usable = (~rule["negated"] | rule["path_match"]) & usable
            return F.when(
                usable, F.when(rule["negated"], F.lit(0)).otherwise(ignored_state)
            ).otherwise(state)

        return F.aggregate(self.column, ignored_state if parent_ignored else F.lit(0), step)

    def _may_match_below(self, directory: Column) -> Column | None:
        return F.exists(
            self.column,
            lambda rule: rule["negated"]
            & (~rule["path_match"] | F.coalesce(F.rlike(directory, rule["below"]), F.lit(False))),
        )
