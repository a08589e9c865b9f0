"""Rule scanning: literal patterns over lines, spans and whole texts.

Every pattern is a literal in the plan, so it is compiled once per task. A
line first meets one alternation of all patterns; only lines that hit it pay
for the single rules. Nothing here shuffles until findings are deduplicated.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.scoring import severity_rank
from corpuscope.functions.text import first_chars, lstrip, split_lines, strip
from corpuscope.operators.rule_packs import Rule, SpanRule
from corpuscope.skew import spread

MIN_LINES = 5
REDACTED = "[REDACTED]"
FINDING_COLS = [
    "repo", "file_path", "line_no", "rule_id", "title", "severity", "category", "description",
    "snippet", "cwe", "owasp", "fix", "confidence", "detector", "seq",
]


def java_pattern(rule: Rule) -> str:
    """The rule's pattern with Unicode classes and its flags as an inline group."""
    flags = "U" + ("iu" if "i" in rule.flags else "") + ("m" if "m" in rule.flags else "")
    return f"(?{flags}:{rule.regex})"


def explode_lines(files: DataFrame, min_lines: int = 0) -> DataFrame:
    """One row per line, numbered from 1; files shorter than ``min_lines`` are left out."""
    split = spread(files, ["file_path"]).withColumn("_lines", split_lines(F.col("content")))
    if min_lines:
        split = split.filter(F.size("_lines") >= min_lines)
    return split.select(
        "repo", "file_path", "language",
        F.posexplode("_lines").alias("_pos", "line"),
    ).select("repo", "file_path", "language", (F.col("_pos") + 1).alias("line_no"), "line")


#: characters of a snippet that the reference shows
REFERENCE_SNIPPET = 120


def redact_snippet(line: Column, redact: bool | Column, length: int | None = None) -> Column:
    """The stripped line, whole or its first ``length`` characters, or a mark in its place."""
    redact = redact if isinstance(redact, Column) else F.lit(redact)
    return F.when(redact, F.lit(REDACTED)).otherwise(first_chars(strip(line), length))


def _finding(rule: Rule, seq: int, line: Column) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.title).alias("title"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"),
        F.lit(rule.description).alias("description"),
        redact_snippet(line, rule.redact, rule.snippet_len).alias("snippet"),
        F.lit(rule.cwe).alias("cwe"), F.lit(rule.owasp).alias("owasp"),
        F.lit(rule.fix).alias("fix"), F.lit(None).cast("double").alias("confidence"),
        F.lit(rule.pack).alias("detector"), F.lit(seq).cast("bigint").alias("seq"),
    )


def scan_lines(lines: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings of each rule on each line, at most one per rule and line.

    A rule with languages applies to lines of those languages only. Rules of
    scope ``match`` give one finding per match.
    """
    rules = list(rules)
    line, language = F.col("line"), F.col("language")
    any_rule = "|".join(java_pattern(r) for r in rules)
    hits = []
    for seq, rule in enumerate(rules):
        pattern = java_pattern(rule)
        test = line.rlike(pattern)
        if rule.languages:
            test = language.isin(*rule.languages) & test
        found = F.array(_finding(rule, seq, line))
        if rule.scope == "match":
            found = F.array_repeat(
                _finding(rule, seq, line), F.regexp_count(line, F.lit(pattern))
            )
        hits.append(F.when(test, found).otherwise(F.array().cast(_ARRAY)))
    return (
        lines.filter(line.rlike(any_rule))
        .select("repo", "file_path", "line_no", F.explode(F.concat(*hits)).alias("f"))
        .select("repo", "file_path", "line_no", "f.*")
        .select(*FINDING_COLS)
    )


_ARRAY = (
    "array<struct<rule_id:string,title:string,severity:string,category:string,"
    "description:string,snippet:string,cwe:string,owasp:string,fix:string,confidence:double,"
    "detector:string,seq:bigint>>"
)


def scan_files(files: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rules over every file of at least five lines."""
    return scan_lines(explode_lines(files, MIN_LINES), rules)


def scan_spans(lines: DataFrame, rules: Iterable[SpanRule]) -> DataFrame:
    """First header before each next later target, per file and rule.

    A single pattern spanning many lines backtracks without bound, so headers
    and targets are found line by line. Only lines that are one of the two
    are shuffled, and a window never leaves its file.
    """
    rules = list(rules)
    marks = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.col("line").rlike("(?U)" + r.header).alias("is_header"),
                F.col("line").rlike("(?U)" + r.target).alias("is_target"),
            )
            for i, r in enumerate(rules)
        ]
    )
    marked = (
        lines.select("repo", "file_path", "line_no", F.explode(marks).alias("m"))
        .select("repo", "file_path", "line_no", "m.*")
        .filter("is_header or is_target")
    )
    ahead = (
        Window.partitionBy("repo", "file_path", "rule").orderBy("line_no")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    target_line = F.when(F.col("is_target"), F.col("line_no"))
    found = (
        marked.withColumn("target_line", F.min(target_line).over(ahead))
        .filter("is_header and target_line is not null")
        .groupBy("repo", "file_path", "rule", "target_line")
        .agg(F.min("line_no").alias("line_no"))
    )
    chain = F
    for i, r in enumerate(rules):
        chain = chain.when(
            F.col("rule") == i,
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("title"),
                F.lit(r.severity).alias("severity"), F.lit("PERFORMANCE").alias("category"),
                F.lit(r.description).alias("description"), F.lit("").alias("snippet"),
                F.lit("").alias("cwe"), F.lit("").alias("owasp"), F.lit(r.fix).alias("fix"),
                F.lit(None).cast("double").alias("confidence"),
                F.lit("performance").alias("detector"), F.lit(100 + i).cast("bigint").alias("seq"),
            ),
        )
    return found.select("repo", "file_path", "line_no", "target_line", chain.alias("f")).select(
        "repo", "file_path", "line_no", "target_line", "f.*"
    )


def scan_deep_nesting(lines: DataFrame, indent: int = 24) -> DataFrame:
    """First line of each file indented by at least ``indent`` characters."""
    depth = F.length("line") - F.length(lstrip(F.col("line")))
    return (
        lines.select("repo", "file_path", "line_no", depth.alias("indent"))
        .filter(F.col("indent") >= indent)
        .groupBy("repo", "file_path")
        .agg(F.min_by(F.struct("line_no", "indent"), F.col("line_no")).alias("m"))
        .select(
            "repo", "file_path", F.col("m.line_no").alias("line_no"),
            F.expr("m.indent div 4").cast("int").alias("levels"),
        )
    )


# Words that mark postponed work.
DEBT_WORDS = ("TODO", "FIXME", "HACK", "XXX", "BUG")


def scan_debt_comments(lines: DataFrame, words: Iterable[str] = DEBT_WORDS) -> DataFrame:
    """Lines that mention a debt word: how many, and the first, per file."""
    pattern = r"(?iuU)\b(" + "|".join(words) + r")\b"
    return (
        lines.filter(F.col("line").rlike(pattern))
        .groupBy("repo", "file_path")
        .agg(F.count("*").alias("debt_lines"), F.min("line_no").alias("line_no"))
    )


def scan_long_lines(lines: DataFrame, width: int = 200, more_than: int = 5) -> DataFrame:
    """Files with more than ``more_than`` lines wider than ``width``."""
    return (
        lines.filter(F.length("line") > width)
        .groupBy("repo", "file_path")
        .agg(F.count("*").alias("long_lines"), F.min("line_no").alias("line_no"))
        .filter(F.col("long_lines") > more_than)
    )


# Control-flow words and operators.
CONTROL_WORDS = ("if", "else", "elif", "for", "while", "switch", "case", "catch", "try",
                 "&&", r"\|\|")


def keyword_density(files: DataFrame, words: Iterable[str] = CONTROL_WORDS) -> DataFrame:
    """Keyword occurrences per hundred lines, at most 100, per file."""
    pattern = r"(?U)\b(" + "|".join(words) + r")\b"
    lines = F.greatest(F.size(split_lines(F.col("content"))), F.lit(1))
    hits = F.regexp_count(F.col("content"), F.lit(pattern))
    return files.select(
        "repo", "file_path", "language",
        F.least(hits / lines * F.lit(100.0), F.lit(100.0)).alias("density"),
    )


# Category -> (keywords, severity) of the window classifier.
VULNERABILITY_WORDS = {
    "Injection": (("execute", "query", "cursor", "eval", "exec", "format", "sql"), "HIGH"),
    "Auth Bypass": (("token", "jwt", "secret", "password", "auth", "login", "verify", "bypass"), "HIGH"),
    "Crypto Weak": (("md5", "sha1", "random", "seed", "base64", "encrypt", "decrypt", "hash"), "MEDIUM"),
    "Data Exposure": (("log", "print", "debug", "dump", "serialize", "pickle", "json", "response"), "MEDIUM"),
    "SSRF/RCE": (("requests", "urllib", "http", "fetch", "url", "open", "subprocess", "popen", "shell"), "HIGH"),
    "Path Traversal": (("path", "file", "open", "read", "write", "upload", "download", "filename"), "HIGH"),
    "DoS/Resource": (("sleep", "wait", "timeout", "loop", "while", "recursion", "memory", "thread"), "MEDIUM"),
    "XSS/Template": (("render", "template", "html", "escape", "sanitize", "innerhtml", "markup"), "MEDIUM"),
}


def classify_windows(
    files: DataFrame,
    categories: dict[str, tuple[tuple[str, ...], str]] = VULNERABILITY_WORDS,
    size: int = 10,
    step: int = 5,
    floor: float = 0.15,
    snippet: int | None = None,
) -> DataFrame:
    """Categories whose keywords occur in overlapping windows of lines.

    Windows are cut inside the row, so only the findings are shuffled, to keep
    the first one per (file, ten lines, category).
    """
    arr = split_lines(F.col("content"))
    every = sorted({w for words, _ in categories.values() for w in words})
    windows = (
        spread(files, ["file_path"]).withColumn("_lines", arr)
        .filter(F.size("_lines") >= MIN_LINES)
        .select(
            "repo", "file_path", "_lines",
            F.explode(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step))).alias("_at"),
        )
        .select(
            "repo", "file_path", (F.col("_at") + 1).alias("line_no"),
            F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(size)), "\n").alias("text"),
        )
        .withColumn(
            "words",
            F.array_intersect(
                F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w+\b"), F.lit(0)),
                F.array(*[F.lit(w) for w in every]),
            ),
        )
        .filter(F.size("words") > 0)
    )
    scored = F.array(
        *[
            F.struct(
                F.lit(name).alias("category"), F.lit(severity).alias("severity"),
                F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in words]))).alias("hits"),
                F.lit(len(words)).alias("total"), F.lit(order).alias("seq"),
            )
            for order, (name, (words, severity)) in enumerate(categories.items())
        ]
    )
    found = (
        windows.select("repo", "file_path", "line_no", "text", F.explode(scored).alias("c"))
        .select(
            "repo", "file_path", "line_no", "c.category", "c.severity", "c.seq", "c.hits",
            F.least(F.col("c.hits") * F.lit(2.5) / F.col("c.total"), F.lit(1.0)).alias("confidence"),
            strip(first_chars(F.col("text"), snippet)).alias("snippet"),
        )
        .filter((F.col("hits") > 0) & (F.col("confidence") >= floor))
    )
    return (
        found.groupBy("repo", "file_path", F.expr("line_no div 10").alias("_ten"), "category")
        .agg(
            F.min_by(
                F.struct("line_no", "severity", "confidence", "snippet"), F.col("line_no")
            ).alias("m")
        )
        .select("repo", "file_path", "category", "m.*")
    )


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, combined map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def dedup_findings(findings: DataFrame, by: str = "title") -> DataFrame:
    """First finding per (file, line, title or rule)."""
    return dedup_first(findings, ["repo", "file_path", "line_no", by], ["seq"])


def sort_by_severity(df: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Severity order with explicit tie keys; with a limit this is one top-k."""
    ranked = df.orderBy(severity_rank(F.col("severity")), *order)
    return ranked.limit(limit) if limit is not None else ranked


LINTER_SCHEMA = (
    "struct<results:array<struct<filename:string,line_number:int,test_name:string,"
    "issue_severity:string,issue_confidence:string,issue_text:string,issue_cwe:struct<id:int>,"
    "code:string,more_info:string>>>"
)


def merge_python_linter(reports: DataFrame, paths: DataFrame, snippet: int | None = None) -> DataFrame:
    """Findings from a Python linter's JSON reports.

    ``reports``: repo, report. ``paths``: repo, path, file_path. Findings of
    low severity and low confidence are dropped.
    """
    items = reports.select(
        "repo", F.posexplode(F.from_json("report", LINTER_SCHEMA)["results"]).alias("seq", "r")
    )
    severity = F.upper(F.coalesce("r.issue_severity", F.lit("LOW")))
    severity = F.when(severity.isin("HIGH", "MEDIUM", "LOW"), severity).otherwise("LOW")
    confidence = F.upper(F.coalesce("r.issue_confidence", F.lit("LOW")))
    found = items.select(
        "repo", F.col("r.filename").alias("path"),
        F.coalesce("r.line_number", F.lit(0)).alias("line_no"),
        F.initcap(F.replace(F.col("r.test_name"), F.lit("_"), F.lit(" "))).alias("title"),
        severity.alias("severity"), confidence.alias("tool_confidence"),
        F.coalesce("r.issue_text", F.lit("")).alias("description"),
        first_chars(strip(F.coalesce("r.code", F.lit(""))), snippet).alias("snippet"),
        F.when(F.col("r.issue_cwe.id") > 0, F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id")))
        .otherwise("").alias("cwe"),
        F.coalesce("r.more_info", F.lit("")).alias("fix"), "seq",
    ).filter(~((F.col("severity") == "LOW") & (F.col("tool_confidence") == "LOW")))
    return found.join(paths, ["repo", "path"], "left").select(
        "repo", F.coalesce("file_path", "path").alias("file_path"), "line_no", "title",
        "severity", "tool_confidence", "description", "snippet", "cwe", "fix", "seq",
    )


SCRIPT_LINTER_SCHEMA = (
    "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,"
    "message:string,line:int>>>>"
)


def merge_script_linter(reports: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings from a JavaScript linter's JSON reports; level 2 is HIGH, else LOW."""
    files = reports.select(
        "repo", F.explode(F.from_json("report", SCRIPT_LINTER_SCHEMA)).alias("f")
    )
    items = files.select(
        "repo", F.col("f.filePath").alias("path"), F.posexplode("f.messages").alias("seq", "m")
    )
    rule = F.coalesce("m.ruleId", F.lit("?"))
    return items.join(paths, ["repo", "path"], "left").select(
        "repo", F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("m.line", F.lit(0)).alias("line_no"),
        F.concat(F.lit("eslint/"), rule).alias("rule_id"),
        F.concat(F.lit("ESLint: "), rule).alias("title"),
        F.when(F.col("m.severity") == 2, "HIGH").otherwise("LOW").alias("severity"),
        F.coalesce("m.message", F.lit("")).alias("description"), "seq",
    )
