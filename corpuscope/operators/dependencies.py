"""Known vulnerabilities of declared packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import first_chars
from corpuscope.session import materialize
from corpuscope.skew import salted_join

# Database severity -> severity.
ADVISORY_SEVERITY = {
    "CRITICAL": "HIGH", "HIGH": "HIGH", "MODERATE": "MEDIUM", "MEDIUM": "MEDIUM", "LOW": "LOW",
    "NONE": "LOW",
}


def osv_severity(level: Column, affected: Column) -> Column:
    """Mapped database severity; without one, many affected entries make it HIGH."""
    up = F.upper(level)
    chain = F
    for name, severity in ADVISORY_SEVERITY.items():
        chain = chain.when(up == name, F.lit(severity))
    return chain.when(F.size(affected) > 3, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def first_fixed_version(affected: Column) -> Column:
    """First ``fixed`` event over affected, ranges and events; else ``latest``."""
    events = F.flatten(
        F.transform(
            affected, lambda a: F.flatten(F.transform(a["ranges"], lambda r: r["events"]))
        )
    )
    fixed = F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull())
    return F.coalesce(F.get(fixed, F.lit(0)), F.lit("latest"))


def pick_cve(aliases: Column, advisory_id: Column) -> Column:
    """First CVE alias, else the advisory's own id."""
    found = F.filter(aliases, lambda a: F.startswith(a, F.lit("CVE")))
    return F.coalesce(F.get(found, F.lit(0)), advisory_id)


BIG = 9223372036854775807
RELEASE = r"\d+(?:\.\d+)*"


def version_key(version: Column) -> Column:
    """Array of (number, word) that is ordered like the versions.

    The release numbers without closing zeros come first, then -2 for a pre-release or -1 for a
    release or what follows one (post, rev), then the identifiers of the suffix: dev
    before numbers before words. Build suffixes after ``+`` do not count; a text without digits is version 0.
    """
    def part(number: Column, word: Column) -> Column:
        return F.struct(number.cast("bigint").alias("number"), word.alias("word"))

    none = F.lit("")
    text = F.lower(F.trim(version))
    release = F.coalesce(F.nullif(F.regexp_extract(text, RELEASE, 0), none), F.lit("0"))
    suffix = F.regexp_extract(text, RELEASE + r"([^+]*)", 1)
    after = suffix.rlike(r"^[-_.]?(post|rev|r\d)")
    before = ~after & suffix.rlike(r"^(-|[_.]?[a-z])")
    numbers = F.transform(
        F.split(F.regexp_replace(release, r"(?:\.0+)+$", ""), r"\."),
        lambda p: part(F.coalesce(p.try_cast("bigint"), F.lit(BIG)), F.lit("")))
    marker = F.array(part(F.when(before, F.lit(-2)).otherwise(F.lit(-1)), none))
    identifiers = F.transform(
        F.regexp_extract_all(F.when(before | after, suffix).otherwise(none), F.lit(r"\d+|[a-z]+"), F.lit(0)),
        lambda p: part(
            F.when(p == "dev", F.lit(-3)).when(p.rlike("^[0-9]"), F.coalesce(p.try_cast("bigint"), F.lit(BIG)))
            .otherwise(F.lit(BIG)),
            F.when(p == "dev", F.lit("")).when(p.rlike("^[0-9]"), F.lit("")).otherwise(p)))
    return F.concat(numbers, marker, identifiers)


def in_ranges(version: Column, affected: Column) -> Column:
    """Does any range hold the version: introduced and not fixed between then and the version.

    A range may list any number of introduced and fixed events, in any order; without an
    introduced event it begins with the first version.
    """
    key = version_key(version)

    def covers(rng: Column) -> Column:
        def named(event: str) -> Column:
            return F.filter(F.transform(rng["events"], lambda e: e[event]), lambda v: v.isNotNull())

        starts = F.coalesce(named("introduced"), F.array(F.lit("0")))
        starts = F.when(F.size(starts) == 0, F.array(F.lit("0"))).otherwise(starts)
        ends = F.coalesce(named("fixed"), F.array().cast("array<string>"))

        def open_since(start: Column) -> Column:
            begun = (start == "0") | (version_key(start) <= key)
            over = F.exists(ends, lambda end: (version_key(end) <= key) & (
                (start == "0") | (version_key(end) > version_key(start))))
            return begun & ~over

        return F.exists(starts, open_since)

    return F.exists(affected, lambda a: F.exists(a["ranges"], covers))


def affected_intervals(affected: Column) -> Column:
    """The ranges as intervals: version keys from ``start``, below ``end`` (null: without end).

    An interval goes from an introduced event to the first fixed one behind it. The version 0 is before all
    others, and so is a range without an introduced event.
    """
    first = F.array().cast("array<struct<number:bigint,word:string>>")

    def named(rng: Column, event: str) -> Column:
        return F.filter(F.transform(rng["events"], lambda e: e[event]), lambda v: v.isNotNull())

    def intervals(rng: Column) -> Column:
        starts = F.coalesce(named(rng, "introduced"), F.array(F.lit("0")))
        starts = F.when(F.size(starts) == 0, F.array(F.lit("0"))).otherwise(starts)
        keys = F.transform(starts, lambda s: F.when(s == "0", first).otherwise(version_key(s)))
        ends = F.transform(F.coalesce(named(rng, "fixed"), F.array().cast("array<string>")), version_key)
        return F.transform(keys, lambda start: F.struct(
            start.alias("start"), F.array_min(F.filter(ends, lambda end: end > start)).alias("end")))

    none = F.array().cast("array<array<struct<start:array<struct<number:bigint,word:string>>,end:array<struct<number:bigint,word:string>>>>>")
    return F.flatten(F.transform(affected, lambda a: F.flatten(F.coalesce(F.transform(a["ranges"], intervals), none))))


def versions_in_ranges(versions: DataFrame, advisories: DataFrame, package: list[str]) -> DataFrame:
    """(package, version, id) of the versions that an advisory's ranges hold; no version meets an advisory that does not hold it.

    ``versions``: the ``package`` columns and version; ``advisories``: these, id and affected. Keys of versions and of the ends of intervals
    are sorted once per package, which turns an interval into a run of version numbers. A run is at most two nodes on
    each level of a binary tree over the numbers, and a version lies under one node of each level: an equality join.
    """
    known = versions.filter("version IS NOT NULL").select(*package, "version").distinct()
    ranges = advisories.select(*package, "id", F.explode(affected_intervals(F.col("affected"))).alias("i")).select(
        *package, "id", F.col("i.start").alias("start"), F.col("i.end").alias("end")).distinct()
    # at equal keys an end stands before the version: start <= version < end
    marks = ranges.select(*package, "id", "start", "end", F.explode(F.array(
        F.struct(F.lit("low").alias("side"), F.col("start").alias("key")),
        F.struct(F.lit("high").alias("side"), F.col("end").alias("key")))).alias("m"))
    points = known.select(
        *package, version_key(F.col("version")).alias("key"), F.lit(1).alias("is_version"), "version"
    ).unionByName(marks.filter("m.key IS NOT NULL").select(
        *package, F.col("m.key").alias("key"), F.lit(0).alias("is_version"), "id", "start", "end", F.col("m.side").alias("side")),
        allowMissingColumns=True)
    # the window of a package is bounded by its versions and advisories
    before = Window.partitionBy(*package).orderBy("key", "is_version", "version").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(
        points.withColumn("number", F.coalesce(F.sum("is_version").over(before), F.lit(0)))
        .withColumn("all", F.sum("is_version").over(Window.partitionBy(*package))).filter("all > 0").drop("key"), "version-numbers")
    runs = placed.filter("is_version = 0").groupBy(*package, "id", "start", "end").agg(
        F.max(F.when(F.col("side") == "low", F.col("number"))).alias("low"),
        F.coalesce(F.max(F.when(F.col("side") == "high", F.col("number"))), F.max("all")).alias("high"), F.max("all").alias("all"))
    levels = F.sequence(F.lit(0), F.length(F.bin("all")))

    def nodes() -> Column:
        low, high = F.expr("(low + shiftleft(1L, level) - 1) div shiftleft(1L, level)"), F.expr("high div shiftleft(1L, level)")
        return F.array_compact(F.array(
            F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1)))

    under = runs.filter("low < high").select(*package, "id", "low", "high", F.explode(levels).alias("level")).select(
        *package, "id", "level", F.explode(nodes()).alias("node"))
    over = placed.filter("is_version = 1").select(*package, "version", "number", F.explode(levels).alias("level")).select(
        *package, "version", "level", F.expr("number div shiftleft(1L, level)").alias("node"))
    return over.join(under, [*package, "level", "node"]).select(*package, "version", "id").distinct()


#: characters of an advisory summary that the reference shows
REFERENCE_SUMMARY = 200


def vulnerable_dependencies(
    dependencies: DataFrame, advisories: DataFrame, summary_chars: int | None = None
) -> DataFrame:
    """Dependencies whose version lies in an advisory's range.

    A popular package repeats in very many repositories, so advisories are
    matched against distinct (ecosystem, name, version) first, by ``versions_in_ranges``, and only the
    matches are joined back, over salted keys.
    """
    key = ["ecosystem", "_name", "version"]
    deps = dependencies.withColumn("_name", F.lower("name"))
    versions = deps.select(*key).distinct()
    known = advisories.select(
        F.col("package.ecosystem").alias("ecosystem"), F.lower("package.name").alias("_name"),
        "id", "summary", "aliases", "severity", "affected",
    )
    held = versions_in_ranges(versions, known, ["ecosystem", "_name"])
    told = known.select(
        "ecosystem", "_name", "id", first_fixed_version(F.col("affected")).alias("fixed_version"),
        osv_severity(F.col("severity"), F.col("affected")).alias("severity"),
        first_chars(F.coalesce("summary", F.lit("Known vulnerability")), summary_chars).alias("summary"),
        pick_cve(F.col("aliases"), F.col("id")).alias("cve"), F.col("id").alias("osv_id"))
    hits = held.join(told, ["ecosystem", "_name", "id"]).drop("id")
    return salted_join(deps, hits, key, ["repo", "source_file"]).select(
        "repo", F.col("name").alias("package"), "ecosystem",
        F.col("version").alias("installed_version"), "fixed_version", "severity", "summary",
        "cve", "osv_id", "source_file",
    )
