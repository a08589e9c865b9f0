"""Structural test coverage: tests mapped to sources by name, then by import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.paths import (
    coverage_module, file_stem, is_test_file, source_stem, test_stem,
)
from corpuscope.functions.scoring import coverage_estimate, risk_level, severity_rank
from corpuscope.functions.text import round_half_up, split_lines
from corpuscope.session import materialize
from corpuscope.skew import salted_join

# Languages that count as source code; import and test patterns.
SOURCE_LANGUAGES = ("Python", "JavaScript", "TypeScript", "Java", "Go", "Ruby", "PHP")
TEST_IMPORT = r"(?:import|from)\s+[\w./]+"
TEST_DEFINITION = r"def\s+test_\w+|it\s*\([\"']|test\s*\([\"']|func\s+Test\w+"


def source_files(files: DataFrame) -> DataFrame:
    return files.filter(
        F.col("language").isin(*SOURCE_LANGUAGES) & ~is_test_file(F.col("file_path"))
    )


def test_files(files: DataFrame) -> DataFrame:
    return files.filter(is_test_file(F.col("file_path")))


GRAM = 3


def grams(c: Column, n: int = GRAM) -> Column:
    """Distinct runs of ``n`` characters; a shorter text has none."""
    starts = F.sequence(F.lit(1), F.length(c) - (n - 1))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n)))))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, needle, text) of all needles that occur in a text of their repository.

    ``needles``: repo, needle; ``texts``: repo, text; both are made distinct. A needle is posted once, under its rarest run of
    three characters among the texts, or under itself if it is shorter, and meets only texts with that run. Texts are as many rows as
    characters at most. Empty needles and nulls match nothing.
    """
    needles = needles.select("repo", "needle").filter("needle <> ''").distinct()
    texts = texts.select("repo", "text").filter("text IS NOT NULL").distinct()
    sizes = [F.coalesce(grams(F.col("text"), n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    spread_out = texts.select("repo", "text", F.explode(F.concat(*sizes)).alias("gram"))
    wanted = needles.select("repo", "needle", F.explode(
        F.coalesce(grams(F.col("needle")), F.array("needle"))).alias("gram"))
    # runs that no needle has meet nothing; the others are counted before a needle chooses
    spread_out = materialize(
        spread_out.join(wanted.select("repo", "gram").distinct(), ["repo", "gram"], "left_semi"), "grams")
    often = spread_out.groupBy("repo", "gram").agg(F.count("*").alias("n"))
    posted = (
        wanted.join(often, ["repo", "gram"], "left").groupBy("repo", "needle")
        # a run that no text has rules its needle out
        .agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("least"))
        .filter("least.n IS NOT NULL").select("repo", "needle", F.col("least.gram").alias("gram"))
    )
    return posted.join(spread_out, ["repo", "gram"]).filter(F.contains("text", F.col("needle"))).select("repo", "needle", "text")


def map_tests_by_name(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo, test_path, file_path): the one source each test is named after.

    An equal stem wins, else a stem that contains or is contained in the
    other; ties go to the smallest path. Containment is looked up among distinct stems, so a file
    name repeated all over a repository is looked up once.
    """
    src = (
        sources.select("repo", source_stem(F.col("file_path")).alias("stem"), "file_path")
        .filter("stem <> ''").groupBy("repo", "stem").agg(F.min("file_path").alias("file_path"))
    )
    named = tests.select(
        "repo", F.col("file_path").alias("test_path"), test_stem(F.col("file_path")).alias("clean")
    ).filter("clean <> ''")
    clean = named.select("repo", "clean").distinct()
    inside = contained(clean.withColumnRenamed("clean", "needle"), src.select("repo", F.col("stem").alias("text")))
    around = contained(src.select("repo", F.col("stem").alias("needle")), clean.withColumnRenamed("clean", "text"))
    hits = inside.select("repo", F.col("needle").alias("clean"), F.col("text").alias("stem")).unionByName(
        around.select("repo", F.col("text").alias("clean"), F.col("needle").alias("stem")))
    best = hits.join(src, ["repo", "stem"]).groupBy("repo", "clean").agg(
        F.min(F.struct((F.col("stem") != F.col("clean")).alias("partial"), F.col("file_path")))
        .alias("b")
    ).select("repo", "clean", F.col("b.file_path").alias("file_path"))
    return salted_join(named, best, ["repo", "clean"], ["test_path"]).select(
        "repo", "test_path", "file_path"
    )


def map_tests_by_import(sources: DataFrame, tests: DataFrame, mapped: DataFrame) -> DataFrame:
    """Sources whose stem occurs in an import of a test that has no source by name."""
    rest = tests.select("repo", F.col("file_path").alias("test_path"), "content").join(
        mapped.select("repo", "test_path").distinct(), ["repo", "test_path"], "left_anti"
    )
    statements = rest.select(
        "repo", "test_path",
        F.explode(F.array_distinct(F.regexp_extract_all(
            F.lower("content"), F.lit("(?U)" + TEST_IMPORT), F.lit(0)))).alias("statement"),
    )
    distinct = statements.select("repo", "statement").distinct()
    stems = sources.select("repo", "file_path", file_stem(F.col("file_path")).alias("stem")).filter(
        "stem <> ''"
    )
    found = contained(
        stems.select("repo", F.col("stem").alias("needle")), distinct.withColumnRenamed("statement", "text")
    ).select("repo", F.col("needle").alias("stem"), F.col("text").alias("statement"))
    by_stem = salted_join(statements, found, ["repo", "statement"], ["test_path"]).select(
        "repo", "test_path", "stem"
    ).distinct()
    return by_stem.join(stems, ["repo", "stem"]).select("repo", "test_path", "file_path")


def map_tests(sources: DataFrame, tests: DataFrame) -> DataFrame:
    """Both mappings, written once: every coverage measure reads them."""
    by_name = materialize(map_tests_by_name(sources, tests), "tests-by-name")
    by_import = materialize(map_tests_by_import(sources, tests, by_name), "tests-by-import")
    return by_name.unionByName(by_import)


def count_tests(tests: DataFrame, pattern: str = TEST_DEFINITION) -> DataFrame:
    """Test definitions per test file."""
    return tests.select(
        "repo", F.col("file_path").alias("test_path"),
        F.regexp_count("content", F.lit("(?U)" + pattern)).alias("test_count"),
    )


def untested_functions(
    functions: DataFrame, mapping: DataFrame, tests: DataFrame
) -> DataFrame:
    """Public functions whose name occurs in no test mapped to their file.

    Names travel to each mapped test once and are looked up in its whole text.
    """
    public = functions.filter(~F.startswith("name", F.lit("_"))).select(
        "repo", "file_path", "name"
    ).distinct()
    names = public.groupBy("repo", "file_path").agg(F.collect_set("name").alias("names"))
    texts = tests.select("repo", F.col("file_path").alias("test_path"), "content")
    seen = (
        mapping.join(names, ["repo", "file_path"]).join(texts, ["repo", "test_path"])
        .select("repo", "file_path", F.explode(
            F.filter("names", lambda n: F.contains(F.col("content"), n))).alias("name"))
        .distinct()
    )
    return public.join(seen, ["repo", "file_path", "name"], "left_anti")


def file_coverage(
    sources: DataFrame, mapping: DataFrame, test_counts: DataFrame, function_counts: DataFrame
) -> DataFrame:
    """Coverage estimate and risk of every source file.

    ``function_counts``: repo, file_path, functions. A file without an entry
    is taken to hold one function per fifteen lines.
    """
    per_file = (
        mapping.distinct().join(test_counts, ["repo", "test_path"])
        .groupBy("repo", "file_path")
        .agg(F.count("*").alias("test_files"), F.sum("test_count").alias("test_count"))
    )
    sized = sources.select(
        "repo", "file_path", F.size(split_lines(F.col("content"))).alias("line_count")
    )
    guess = F.greatest(F.expr("line_count div 15"), F.lit(1))
    joined = (
        sized.join(per_file, ["repo", "file_path"], "left")
        .join(function_counts, ["repo", "file_path"], "left")
        .select(
            "repo", "file_path", "line_count",
            F.coalesce("test_files", F.lit(0)).alias("test_files"),
            F.coalesce("test_count", F.lit(0)).alias("test_count"),
            F.coalesce("functions", guess).alias("functions"),
        )
    )
    return joined.withColumn(
        "coverage", coverage_estimate(F.col("test_files") > 0, F.col("test_count"), F.col("functions"))
    ).withColumn(
        "risk_level", risk_level(F.col("coverage"), F.col("line_count"))
    ).withColumn("module", coverage_module(F.col("file_path")))


def coverage_summary(coverage: DataFrame, mapping: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Totals per repository; a test mapped to two sources counts once."""
    tested = F.col("test_files") > 0
    totals = coverage.groupBy("repo").agg(
        F.count("*").alias("total_source_files"), F.count_if(tested).alias("tested_files"),
        F.count_if(~tested).alias("untested_files"),
        round_half_up(F.avg("coverage"), 1).alias("overall_coverage"),
        F.count_if(~tested & (F.col("risk_level") == "HIGH")).alias("hotspots"),
    )
    used = mapping.select("repo", "test_path").distinct().join(test_counts, ["repo", "test_path"])
    tests = used.groupBy("repo").agg(F.sum("test_count").alias("total_test_count"))
    return totals.join(tests, "repo", "left").withColumn(
        "total_test_count", F.coalesce("total_test_count", F.lit(0))
    )


def coverage_hotspots(coverage: DataFrame) -> DataFrame:
    """Untested high-risk sources."""
    return coverage.filter((F.col("test_files") == 0) & (F.col("risk_level") == "HIGH")).select(
        "repo", "file_path", "module", "line_count"
    )


def uncovered_modules(coverage: DataFrame) -> DataFrame:
    return coverage.filter(F.col("test_files") == 0).withColumn(
        "risk_rank", severity_rank(F.col("risk_level"))
    )


# Framework -> markers that must all occur in the test texts, in order.
FRAMEWORK_MARKERS = [
    ("pytest", ("import pytest",)), ("pytest", ("from pytest",)),
    ("unittest", ("import unittest",)), ("jest/mocha", ("describe(", "it(")),
    ("jest", ("expect(",)), ("JUnit", ("@Test",)), ("Go testing", ("func Test",)),
]
# Framework -> (part of the manifest path, marker in its text).
FRAMEWORK_MANIFESTS = [("pytest", "requirements", "pytest"), ("jest", "package.json", "jest")]


def detect_test_framework(
    tests: DataFrame, files: DataFrame, markers=FRAMEWORK_MARKERS, manifests=FRAMEWORK_MANIFESTS
) -> DataFrame:
    """First framework whose markers occur in the tests, else in a manifest.

    Marker hits are folded to booleans map-side; texts are never shuffled.
    """
    text = F.col("content")
    words = sorted({w for _, need in markers for w in need})
    hits = tests.groupBy("repo").agg(
        *[F.bool_or(text.contains(w)).alias(f"m{i}") for i, w in enumerate(words)]
    )
    declared = files.groupBy("repo").agg(
        *[F.bool_or(F.col("file_path").contains(path) & text.contains(word)).alias(f"d{i}")
          for i, (_, path, word) in enumerate(manifests)]
    )
    chain = F
    for name, need in markers:
        test = F.lit(True)
        for w in need:
            test = test & F.col(f"m{words.index(w)}")
        chain = chain.when(test, F.lit(name))
    for i, (name, _, _) in enumerate(manifests):
        chain = chain.when(F.col(f"d{i}"), F.lit(name))
    return declared.join(hits, "repo", "left").select(
        "repo", chain.otherwise(F.lit("unknown")).alias("framework")
    )
