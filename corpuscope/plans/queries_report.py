"""The whole report over the generated source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.plans import bindings as b
from corpuscope.plans.registry import query
from corpuscope.plans.report import analyze, report


@query("analysis_report", f"""
WITH {b.FUNCTIONS_SQL}
SELECT repo, (SELECT count(*) FROM part p WHERE p.p_brand = f.repo) + (SELECT count(*) FROM part p
         WHERE p.p_brand = f.repo AND {b.IS_TESTED}) AS total_files_analyzed,
       CAST(max(loc) AS BIGINT) AS max_function_length
FROM functions f GROUP BY repo""")
def whole_report(spark: SparkSession, sf: str) -> DataFrame:
    files = b.coverage_files(spark, sf)
    return report(files, analyze(files)).select(
        "repo", "total_files_analyzed", F.col("max_function_length").cast("bigint").alias("max_function_length")
    )
