"""Severity ranks, grades, scores, status texts and notification payloads."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import first_items, number_text, round_half_up


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).when(severity == "LOW", 2)
        .otherwise(3)
    )


def severity_from_rank(rank: Column) -> Column:
    return F.when(rank == 0, "HIGH").when(rank == 1, "MEDIUM").when(rank == 2, "LOW")


def grade(index: Column) -> Column:
    """Letter grade of a maintainability index."""
    return (
        F.when(index >= 75, "A").when(index >= 55, "B").when(index >= 40, "C")
        .when(index >= 25, "D").otherwise("F")
    )


def risk_level(coverage: Column, line_count: Column) -> Column:
    return (
        F.when((coverage < 10) & (line_count > 100), "HIGH")
        .when((coverage < 30) & (line_count > 50), "MEDIUM")
        .otherwise("LOW")
    )


# Weight of one smell in the quality score and in debt hours.
SMELL_PENALTY = {"HIGH": 3.0, "MEDIUM": 1.5, "LOW": 0.5}
SMELL_HOURS = {"HIGH": 2.0, "MEDIUM": 0.75, "LOW": 0.25}


def severity_weight(severity: Column, weights: dict[str, float]) -> Column:
    chain = F
    for name, weight in weights.items():
        chain = chain.when(severity == name, F.lit(weight))
    return chain.otherwise(F.lit(0.0))


def complexity_rank(cc: Column) -> Column:
    """Published letter scale for cyclomatic complexity."""
    return (
        F.when(cc <= 5, "A").when(cc <= 10, "B").when(cc <= 20, "C").when(cc <= 30, "D")
        .when(cc <= 40, "E").otherwise("F")
    )


def quality_score(index: Column, complexity_excess: Column, smell_penalty: Column) -> Column:
    """Index less complexity and smell penalties, which together cost at most 40."""
    base = F.least(index, F.lit(100.0))
    lost = F.least(complexity_excess * F.lit(0.4) + smell_penalty, F.lit(40.0))
    return F.greatest(F.lit(0.0), base - lost)


def tech_debt_hours(complex_fns: Column, smell_hours: Column, gods: Column, loc: Column) -> Column:
    return complex_fns * F.lit(0.5) + smell_hours + gods * F.lit(4.0) + loc / F.lit(6000.0)


def maintainability_index(
    volume: Column, complexity: Column, sloc: Column, comment_percent: Column
) -> Column:
    """Published maintainability index, scaled to 0..100."""
    bend = F.sqrt(F.lit(2.46) * comment_percent * F.lit(math.pi / 180.0))
    raw = (
        F.lit(171.0) - F.lit(5.2) * F.ln(volume) - F.lit(0.23) * complexity
        - F.lit(16.2) * F.ln(sloc) + F.lit(50.0) * F.sin(bend)
    )
    scaled = F.least(F.greatest(F.lit(0.0), raw * F.lit(100.0) / F.lit(171.0)), F.lit(100.0))
    return F.when((volume <= 0) | (sloc <= 0), F.lit(100.0)).otherwise(scaled)


def coverage_estimate(has_tests: Column, test_count: Column, fn_count: Column) -> Column:
    ratio = F.least(test_count / fn_count.cast("double"), F.lit(1.0))
    return (
        F.when(~has_tests, F.lit(0.0)).when(fn_count == 0, F.lit(80.0))
        .otherwise(round_half_up(ratio * F.lit(85.0) + F.lit(10.0), 1))
    )


def quality_trend(score: Column) -> Column:
    """The constant trend label shown next to a score."""
    return F.when(score >= 80, "+4.2%").when(score >= 60, "+1.8%").otherwise("-2.1%")


def metric_cards(
    score: Column, high_total: Column, maintainability: Column, debt: Column
) -> list[Column]:
    """Value, delta and status of the four headline cards."""
    plural = F.when(high_total == 1, "").otherwise("s")
    return [
        number_text(score).alias("quality_value"),
        quality_trend(score).alias("quality_delta"),
        F.when(score >= 70, "Improved").otherwise("Needs Work").alias("quality_status"),
        high_total.alias("security_value"),
        F.concat(high_total.cast("string"), F.lit(" issue"), plural, F.lit(" found")).alias(
            "security_delta"
        ),
        F.when(high_total > 0, "Critical").otherwise("Clean").alias("security_status"),
        maintainability.alias("maintainability_value"),
        F.lit("Stable").alias("maintainability_status"),
        F.concat(debt.cast("string"), F.lit("h")).alias("debt_value"),
        F.concat(
            F.lit("-"), round_half_up(debt * F.lit(0.12), 1).cast("string"), F.lit("h")
        ).alias("debt_delta"),
        F.lit("Improving").alias("debt_status"),
    ]


def executive_summary(
    score: Column, critical: Column, vulnerable: Column, architecture: Column,
    coverage: Column, bug_risks: Column,
) -> Column:
    state = F.when(score >= 80, "strong").when(score >= 60, "moderate").otherwise("fragile")
    risk = (
        F.when(critical >= 5, "high").when((critical > 0) | (vulnerable > 0), "elevated")
        .otherwise("controlled")
    )
    return F.concat(
        F.lit("This codebase is in "), state, F.lit(" condition with a quality score of "),
        number_text(score), F.lit("/100. Delivery risk is "), risk, F.lit(": "),
        critical.cast("string"), F.lit(" critical issues, "),
        vulnerable.cast("string"), F.lit(" vulnerable dependencies, "),
        bug_risks.cast("string"), F.lit(" ML-flagged bug hotspots, "),
        number_text(coverage), F.lit("% mapped test coverage, and "),
        number_text(architecture), F.lit("% architecture alignment."),
    )


#: steps that the reference names at most
REFERENCE_STEPS = 4


def roadmap(
    critical: Column, vulnerable: Column, coverage: Column, architecture: Column,
    smells: Column, bug_risks: Column, max_steps: int | None = None,
) -> Column:
    """All applicable steps, or the first ``max_steps``, in fixed order."""
    steps = F.array(
        F.when(
            (critical > 0) | (vulnerable > 0),
            F.concat(
                F.lit("Stabilize the repo first by fixing "), critical.cast("string"),
                F.lit(" critical findings and upgrading "), vulnerable.cast("string"),
                F.lit(" vulnerable dependencies."),
            ),
        ),
        F.when(
            bug_risks > 0,
            F.concat(
                F.lit("Target the "), bug_risks.cast("string"),
                F.lit(" highest-risk functions with AI-assisted fixes, then add regression tests."),
            ),
        ),
        F.when(
            coverage < 60,
            F.concat(
                F.lit("Raise coverage from "), number_text(coverage),
                F.lit("% to at least 70% on hotspot modules before major feature work."),
            ),
        ),
        F.when(
            architecture < 70,
            F.lit(
                "Reduce cross-layer coupling and circular dependencies to improve "
                "maintainability and onboarding speed."
            ),
        ),
        F.when(
            smells > 0,
            F.concat(
                F.lit("Refactor the worst "), F.least(smells, F.lit(10)).cast("string"),
                F.lit(" code smells to reduce debt and improve future AI fix accuracy."),
            ),
        ),
    )
    kept = first_items(F.array_compact(steps), max_steps)
    default = F.array(
        F.lit(
            "Maintain the current quality bar and use the dashboard to monitor "
            "regressions over time."
        )
    )
    return F.when(F.size(kept) == 0, default).otherwise(kept)


def quality_gate(high: Column, score: Column, floor: float = 30.0) -> Column:
    return F.when((high > 0) | (score < floor), "fail").otherwise("pass")


# Chat message texts, colours and thresholds.
GREEN, YELLOW, RED = "\U0001f7e2", "\U0001f7e1", "\U0001f534"


def _text(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("text"))


def slack_payload(repo, quality, security, debt, maintainability, critical, vulnerable,
                  product: str = "Code Analysis") -> Column:
    """Chat message of a finished run as JSON; optional blocks only when they apply."""
    emoji = F.when(quality >= 75, GREEN).when(quality >= 50, YELLOW).otherwise(RED)

    def block(kind, text=None, fields=None, elements=None) -> Column:
        item = _text("x", F.lit("x"))
        return F.struct(
            F.lit(kind).alias("type"),
            (text if text is not None else F.when(F.lit(False), item)).alias("text"),
            (fields if fields is not None else F.when(F.lit(False), F.array(item))).alias("fields"),
            (elements if elements is not None else F.when(F.lit(False), F.array(item))).alias(
                "elements"
            ),
        )

    def md(*parts) -> Column:
        return _text("mrkdwn", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    ending = F.when(vulnerable == 1, "y").otherwise("ies")
    blocks = F.array(
        block("header", _text("plain_text", F.lit(f"✅ {product} Complete"))),
        block("section", md("*Repository:* `", repo, "`")),
        block(
            "section",
            fields=F.array(
                md(emoji, " *Quality Score*\n", quality.cast("string"), "/100"),
                md("\U0001f6e1️ *Security Risks*\n", security.cast("string"), " high"),
                md("⚙️ *Maintainability*\n", maintainability),
                md("⏱️ *Tech Debt*\n", debt.cast("string")),
            ),
        ),
        F.when(
            critical > 0,
            block("section", md("⚠️ *", critical.cast("string"),
                                " critical issue(s)* require immediate attention.")),
        ),
        F.when(
            vulnerable > 0,
            block("section", md(RED, " *", vulnerable.cast("string"),
                                " vulnerable dependenc", ending, "* detected.")),
        ),
        block("divider"),
        block("context", elements=F.array(md(f"Powered by *{product}*"))),
    )
    return F.to_json(F.struct(F.array_compact(blocks).alias("blocks")))


def teams_facts(quality, security, debt, maintainability, critical, vulnerable) -> Column:
    def fact(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    return F.array(
        fact("Quality Score", F.concat(quality.cast("string"), F.lit("/100"))),
        fact("Security Risks", F.concat(security.cast("string"), F.lit(" high severity"))),
        fact("Maintainability", maintainability.cast("string")),
        fact("Tech Debt", debt.cast("string")),
        fact("Critical Issues", critical.cast("string")),
        fact("Vulnerable Dependencies", vulnerable.cast("string")),
    )


def teams_payload(repo, quality, security, debt, maintainability, critical, vulnerable,
                  product: str = "Code Analysis") -> Column:
    facts = teams_facts(quality, security, debt, maintainability, critical, vulnerable)
    section = F.struct(
        F.concat(F.lit(f"✅ {product} Complete — `"), repo, F.lit("`")).alias(
            "activityTitle"
        ),
        facts.alias("facts"),
        F.lit(True).alias("markdown"),
    )
    return F.to_json(
        F.struct(
            F.lit("MessageCard").alias("@type"),
            F.lit("http://schema.org/extensions").alias("@context"),
            F.lit("6c63ff").alias("themeColor"),
            F.concat(F.lit(f"{product}: "), repo).alias("summary"),
            F.array(section).alias("sections"),
        )
    )


def high_alert_payload(repo: Column, title: Column, path: Column) -> Column:
    """Immediate chat alert for one HIGH finding."""
    def field(name: str, value: Column, short: bool) -> Column:
        return F.struct(
            F.lit(name).alias("title"), value.alias("value"), F.lit(short).alias("short")
        )

    attachment = F.struct(
        F.lit("#ff4d6a").alias("color"),
        F.array(field("Issue", title, False), field("File", path, True)).alias("fields"),
    )
    return F.to_json(
        F.struct(
            F.concat(
                F.lit("\U0001f6a8 *HIGH Severity Issue Detected in `"), repo, F.lit("`*")
            ).alias("text"),
            F.array(attachment).alias("attachments"),
        )
    )
