"""Type-hint gaps and generated docstrings per function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.hints import docstring_text, hint_confidence, infer_return_type
from corpuscope.functions.text import round_half_up


def type_hint_gaps(functions: DataFrame) -> DataFrame:
    """Functions without hints: parameters are missing only if none is annotated."""
    name = F.col("name")
    dunder = F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))
    missing = F.when(
        F.col("has_param_ann"), F.array().cast("array<string>")
    ).otherwise(F.transform("params", lambda p: p["name"]))
    return (
        functions.filter(~dunder)
        .withColumn("missing_params", missing)
        .filter((F.size("missing_params") > 0) | ~F.col("has_return_ann"))
        .withColumn("inferred_return", infer_return_type(F.col("source")))
        .select(
            "repo", "file_path", "name", "lineno", "missing_params", "inferred_return",
            round_half_up(
                hint_confidence(F.col("missing_params"), F.col("inferred_return")), 2
            ).alias("confidence"),
        )
    )


def generate_docstrings(functions: DataFrame, max_params: int | None = None) -> DataFrame:
    """Docstrings for undocumented public functions and constructors, with all or ``max_params`` parameters."""
    private = F.startswith("name", F.lit("_")) & (F.col("name") != "__init__")
    return functions.filter((F.col("docstring") == "") & ~private).select(
        "repo", "file_path", "name", "lineno",
        docstring_text(F.col("name"), F.col("params"), F.col("source"), max_params).alias("docstring"),
        infer_return_type(F.col("source")).alias("return_type"),
    )
