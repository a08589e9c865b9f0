"""Dependency manifests: one row per declared package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.paths import file_name
from corpuscope.functions.text import split_lines, strip
from corpuscope.operators.scan import dedup_first
from corpuscope.skew import top_per_key

# Name and version patterns of the manifest formats.
REQUIREMENT = r"^([A-Za-z0-9_\-\.]+)\s*(?:[=~><!\^]+\s*([\d\.]+\w*))?"
GO_REQUIRE = r"^\s*([\w\.\/\-]+)\s+v([\d\.]+[\w\-]*)"
PROJECT_LITERAL = r'"([A-Za-z0-9_\-]+)\s*(?:[>=<!~^]+\s*([\d\.]+))?'
VERSION = r"[\d\.]+"
MANIFESTS = ("requirements.txt", "Pipfile", "pyproject.toml", "package.json", "go.mod")
PACKAGE_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")
MANIFEST_SKIP_DIRS = r"(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build)/"

_RECORD = ["repo", "source_file", "name", "version", "ecosystem", "seq"]


def _manifest_lines(files: DataFrame) -> DataFrame:
    """Stripped lines with their position."""
    return files.select(
        "repo", F.col("file_path").alias("source_file"),
        F.posexplode(F.transform(split_lines(F.col("content")), strip)).alias("seq", "line"),
    )


def _first_version(text: Column) -> Column:
    return F.regexp_extract(text, VERSION, 0)


def parse_requirements(files: DataFrame) -> DataFrame:
    lines = _manifest_lines(files).filter(
        (F.col("line") != "") & ~F.col("line").rlike(r"^(#|-|git\+)")
    )
    return lines.select(
        "repo", "source_file", F.regexp_extract("line", REQUIREMENT, 1).alias("name"),
        F.regexp_extract("line", REQUIREMENT, 2).alias("version"),
        F.lit("PyPI").alias("ecosystem"), "seq",
    ).filter(F.col("name") != "")


def parse_go_mod(files: DataFrame) -> DataFrame:
    return (
        _manifest_lines(files)
        .filter(F.col("line").rlike(GO_REQUIRE))
        .select(
            "repo", "source_file", F.regexp_extract("line", GO_REQUIRE, 1).alias("name"),
            F.regexp_extract("line", GO_REQUIRE, 2).alias("version"),
            F.lit("Go").alias("ecosystem"), "seq",
        )
    )


def parse_package_json(files: DataFrame) -> DataFrame:
    schema = "struct<" + ",".join(f"{s}:map<string,string>" for s in PACKAGE_SECTIONS) + ">"
    doc = F.from_json("content", schema)
    empty = F.create_map().cast("map<string,string>")
    entries = F.concat(
        *[F.map_entries(F.coalesce(doc[section], empty)) for section in PACKAGE_SECTIONS]
    )
    return files.select(
        "repo", F.col("file_path").alias("source_file"), F.posexplode(entries).alias("seq", "e")
    ).select(
        "repo", "source_file", F.col("e.key").alias("name"),
        _first_version(F.coalesce(F.col("e.value"), F.lit(""))).alias("version"),
        F.lit("npm").alias("ecosystem"), "seq",
    )


def parse_pyproject(files: DataFrame) -> DataFrame:
    text, pattern = F.col("content"), F.lit(PROJECT_LITERAL)
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("version"),
    )
    return (
        files.select(
            "repo", F.col("file_path").alias("source_file"), F.posexplode(pairs).alias("seq", "p")
        )
        .select(
            "repo", "source_file", F.col("p.name").alias("name"),
            F.coalesce(F.col("p.version"), F.lit("")).alias("version"),
            F.lit("PyPI").alias("ecosystem"), "seq",
        )
        .filter(F.length("name") > 1)
    )


def parse_pipfile(files: DataFrame) -> DataFrame:
    """Entries below a packages header, up to the next other header.

    The section of a line is the last header at or above it; the window never
    leaves its file, and only manifest lines reach it.
    """
    lines = _manifest_lines(files)
    opens = F.col("line").contains("[packages]") | F.col("line").contains("[dev-packages]")
    closes = F.startswith("line", F.lit("[")) & ~F.col("line").contains("packages")
    state = F.when(opens, F.lit(True)).when(closes, F.lit(False))
    above = Window.partitionBy("repo", "source_file").orderBy("seq")
    inside = lines.withColumn("inside", F.last(state, ignorenulls=True).over(above))
    value = F.substring_index("line", "=", 1)
    rest = F.substr(F.col("line"), F.length(value) + 2)
    return inside.filter(F.col("inside") & ~opens & F.col("line").contains("=")).select(
        "repo", "source_file", F.btrim(strip(value), F.lit('"')).alias("name"),
        _first_version(rest).alias("version"), F.lit("PyPI").alias("ecosystem"), "seq",
    )


def collect_dependencies(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Versioned packages of all manifests, the first per (repo, name, ecosystem).

    ``limit`` keeps the first packages of each repository.
    """
    files = files.filter(~F.col("file_path").rlike(MANIFEST_SKIP_DIRS))
    name = file_name(F.col("file_path"))
    parsers = dict(zip(MANIFESTS, (
        parse_requirements, parse_pipfile, parse_pyproject, parse_package_json, parse_go_mod,
    )))
    rows = None
    for manifest, parse in parsers.items():
        part = parse(files.filter(name == manifest)).select(*_RECORD)
        rows = part if rows is None else rows.unionByName(part)
    keyed = rows.filter(F.col("version") != "").withColumn("_key", F.lower("name"))
    unique = dedup_first(
        keyed, ["repo", "_key", "ecosystem"], ["source_file", "seq"]
    ).drop("_key")
    if limit is not None:
        order = [F.asc(c) for c in ("source_file", "seq", "name")]
        unique = top_per_key(unique, ["repo"], order, limit, "_rn").drop("_rn")
    return unique
