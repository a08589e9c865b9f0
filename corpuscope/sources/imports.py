"""Import statements per language, by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Import patterns; group 1 is the target.
SCRIPT_IMPORT = r"(?:import|require)\s*[\(\s][\"']([^\"']+)[\"']"
JAVA_IMPORT = r"import\s+([\w.]+);"
GO_IMPORT = r'"([\w./]+)"'
PYTHON_IMPORT = r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)"
PYTHON_MORE = r"(?m)^[ \t]*import[ \t]+([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)+)"


def extract_imports(files: DataFrame) -> DataFrame:
    """One row per import: repo, file_path, target. Relative-only imports name no module."""
    text, lang = F.col("content"), F.col("language")

    def every(pattern: str):
        return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(1))

    lists = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit("(?U)" + PYTHON_MORE), F.lit(1)),
            lambda names: F.transform(
                F.slice(F.split(names, r"[ \t]*,[ \t]*"), F.lit(2), F.lit(1_000_000)),
                lambda n: F.regexp_extract(n, r"(?U)^([\w.]+)", 1),
            ),
        )
    )
    python = F.filter(F.concat(every(PYTHON_IMPORT), lists), lambda t: ~t.rlike(r"^\.*$"))
    targets = (
        F.when(lang == "Python", F.transform(python, lambda t: F.ltrim(t, F.lit("."))))
        .when(lang.isin("JavaScript", "TypeScript"), every(SCRIPT_IMPORT))
        .when(lang == "Java", every(JAVA_IMPORT))
        .when(lang == "Go", every(GO_IMPORT))
    )
    return files.select("repo", "file_path", F.explode(targets).alias("target"))
