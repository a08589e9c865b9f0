"""Rules as data: thousands of line rules in one step, whatever their number.

``scan.scan_lines`` makes every rule a branch of the plan, which suits a small pack. Here a pack is a value: each rule's pattern
gives literals of which every match holds one, all literals go into one trie, and a line is walked once. Only rules whose
literal occurs, and the few without one, are tried on the line. The plan is one Arrow step for any pack.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from re import _constants as op
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.rule_packs import Rule
from corpuscope.operators.scan import FINDING_COLS, MIN_LINES, REDACTED, explode_lines

# The letters beyond ASCII that a pattern without regard to case takes for an ASCII letter.
LIKE_ASCII = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def required_literals(pattern: str, flags: int = 0) -> set[str] | None:
    """Lower-case texts of which every match of the pattern holds one; None if the pattern names none."""

    def needed(parts: Iterable) -> set[str] | None:
        found, run = [], ""
        for what, value in parts:
            if what is op.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            inner = None
            if what is op.AT:  # takes no character
                continue
            if what is op.SUBPATTERN:
                inner = needed(value[3])
            elif what is op.ATOMIC_GROUP:
                inner = needed(value)
            elif what in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                inner = needed(value[2])
            elif what is op.BRANCH:
                ways = [needed(way) for way in value[1]]
                inner = set().union(*ways) if all(ways) else None
            found += [x for x in ({run} if run else None, inner) if x]
            run = ""
        found += [{run}] if run else []
        # the longest texts rule out most lines
        return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)

    return needed(_parser.parse(pattern, flags))


def flags_of(rule: Rule) -> int:
    return (re.IGNORECASE if "i" in rule.flags else 0) | (re.MULTILINE if "m" in rule.flags else 0)


class Matcher:
    """A pack ready to be tried on lines; one per worker and pack."""

    made: dict[tuple[Rule, ...], Matcher] = {}

    def __init__(self, rules: tuple[Rule, ...]):
        self.patterns: list[re.Pattern | None] = [None] * len(rules)
        self.rules, self.always, by_text = rules, [], {}
        for i, rule in enumerate(rules):
            texts = required_literals(rule.regex, flags_of(rule))
            for text in texts or ():
                by_text.setdefault(text, []).append(i)
            if not texts:
                self.always.append(i)
        self.trie = ahocorasick.Automaton()
        for text, own in by_text.items():
            self.trie.add_word(text, own)
        if by_text:
            self.trie.make_automaton()

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Matcher:
        if rules not in cls.made:
            cls.made[rules] = cls(rules)
        return cls.made[rules]

    def hits(self, line: str, language: str | None) -> Iterator[int]:
        """Rules that match, in pack order; a rule of scope ``match`` once per match."""
        likely = set(self.always)
        if len(self.trie):
            for _, own in self.trie.iter(line.translate(LIKE_ASCII).lower()):
                likely.update(own)
        for i in sorted(likely):
            rule = self.rules[i]
            if rule.languages and language not in rule.languages:
                continue
            pattern = self.patterns[i]
            if pattern is None:
                pattern = self.patterns[i] = re.compile(rule.regex, flags_of(rule))
            if rule.scope == "match":
                yield from (i for _ in pattern.finditer(line))
            elif pattern.search(line):
                yield i


def match_lines(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The findings of ``scan.scan_lines``, for packs of any size. Lines that are null match nothing."""
    rules = tuple(rules)
    told = {
        "rule_id": [r.rule_id for r in rules], "title": [r.title for r in rules], "severity": [r.severity for r in rules],
        "category": [r.category for r in rules], "description": [r.description for r in rules], "cwe": [r.cwe for r in rules],
        "owasp": [r.owasp for r in rules], "fix": [r.fix for r in rules], "detector": [r.pack for r in rules]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.of(rules)
        table = {name: pa.array(values, pa.string()) for name, values in told.items()}
        for batch in batches:
            rows, which, snippets = [], [], []
            for n, (language, line) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                for i in matcher.hits(line, language) if line is not None else ():
                    rule = rules[i]
                    rows.append(n)
                    which.append(i)
                    snippets.append(REDACTED if rule.redact else line.strip()[: rule.snippet_len])
            at, rule_at = pa.array(rows, pa.int64()), pa.array(which, pa.int64())
            out = {name: values.take(rule_at) for name, values in table.items()}
            out |= {"repo": batch.column(0).take(at), "file_path": batch.column(1).take(at), "line_no": batch.column(3).take(at),
                    "snippet": pa.array(snippets, pa.string()), "confidence": pa.nulls(len(rows), pa.float64()), "seq": rule_at}
            yield pa.RecordBatch.from_arrays([out[c] for c in FINDING_COLS], FINDING_COLS)

    source = lines.select("repo", "file_path", "language", F.col("line_no").cast("int").alias("line_no"), "line")
    kinds = {"line_no": "int", "confidence": "double", "seq": "bigint"}
    return source.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in FINDING_COLS))


def match_files(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rules over every file of at least five lines."""
    return match_lines(explode_lines(files, MIN_LINES), rules)


def rules_of(table: DataFrame) -> list[Rule]:
    """A pack from a table with Rule's columns; optional ones that are missing or null keep their defaults.

    The rows come to the driver: a pack is written by people.
    """
    known = [c for c in table.columns if c in Rule._fields]
    rules = []
    for row in table.select(*known).orderBy(*known).collect():
        values = {c: row[c] for c in known if row[c] is not None}
        if "languages" in values:
            values["languages"] = tuple(values["languages"])
        rules.append(Rule(**values))
    return rules
