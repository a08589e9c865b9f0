"""Queries over similarity, search and scoring models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import round_half_up
from corpuscope.operators import models, search_index, similarity, structure
from corpuscope.operators.structure import FEATURES
from corpuscope.plans import bindings as b
from corpuscope.plans.queries_aggregates import _half_up
from corpuscope.plans.queries_rules import words_sql
from corpuscope.plans.queries_scalars import PARAM_LIST, code_functions
from corpuscope.plans.registry import query
from corpuscope.session import materialize
from corpuscope.skew import shuffled
from corpuscope.sources.syntax import FUNCTION_TYPES


@query("m1_tokenize_structure")
def structure_tokens(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = code_functions(spark, sf)
    return structure.structure_tokens(nodes).select(
        "repo", "file_path", "fn_id", F.array_join("tokens", " ").alias("tokens")
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").alias("id"),
        F.expr("lang || '/' || doc_id").alias("file_path"), F.lit(1).alias("lineno"), "text",
    )


def tfidf_sql(by: str = "source") -> str:
    """Unit tf-idf weights of one- and two-word terms per group of documents."""
    return f"""
toks AS (SELECT {by} AS repo, doc_id AS id, {words_sql('lower(text)', 2)} AS w FROM documents),
grams AS (SELECT repo, id, unnest(w) AS term FROM toks
          UNION ALL SELECT repo, id, unnest(list_transform(range(1, len(w)),
                           lambda i: w[i] || ' ' || w[i + 1])) FROM toks),
tf AS (SELECT repo, id, term, count(*) AS tf FROM grams GROUP BY ALL),
stats AS (SELECT repo, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
sizes AS (SELECT {by} AS repo, count(*) AS n_docs FROM documents GROUP BY 1),
idf AS (SELECT repo, term, df, ln((n_docs + 1.0) / (df + 1.0)) + 1.0 AS idf FROM stats JOIN sizes USING (repo)),
raw AS (SELECT repo, id, term, df, tf * idf AS w FROM tf JOIN idf USING (repo, term)),
norms AS (SELECT repo, id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL),
weights AS (SELECT repo, id, term, df, w / norm AS w FROM raw JOIN norms USING (repo, id))"""


@query("m2_tfidf", f"""
WITH {tfidf_sql()}
SELECT repo, id, term, df, {_half_up('w', 6)} AS w FROM weights""")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    weights, _ = similarity.tfidf(documents(spark, sf), similarity.ngrams(F.col("text")))
    return weights.withColumn("w", round_half_up(F.col("w"), 6))


@query("m3_similar_pairs", f"""
WITH {tfidf_sql()},
vkeys AS (SELECT repo, id, md5(string_agg(term || '=' || (tf.tf), ';' ORDER BY term)) AS vkey
          FROM tf GROUP BY ALL),
reps AS (SELECT repo, vkey, min(id) AS rep, count(*) AS copies FROM vkeys GROUP BY ALL),
copies AS (SELECT v.repo, rep AS id_a, id AS id_b, 1.0 AS cosine FROM vkeys v
           JOIN reps r ON r.repo = v.repo AND r.vkey = v.vkey WHERE id <> rep),
rep_weights AS (SELECT w.repo, w.id, term, w.w FROM weights w JOIN reps r ON r.repo = w.repo AND r.rep = w.id),
dots AS (SELECT x.repo, x.id AS id_a, y.id AS id_b, sum(x.w * y.w) AS cosine
         FROM rep_weights x JOIN rep_weights y ON x.repo = y.repo AND x.term = y.term AND x.id < y.id
         GROUP BY ALL HAVING sum(x.w * y.w) >= 0.82),
pairs AS (SELECT * FROM dots UNION ALL SELECT * FROM copies)
SELECT repo, id_a, id_b, {_half_up('CAST(cosine AS DOUBLE)', 3)} AS similarity,
       CASE WHEN cosine >= 0.95 THEN 'renamed' ELSE 'semantic' END AS clone_type FROM pairs""")
def similar(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_pairs(
        documents(spark, sf), similarity.ngrams(F.col("text"))
    ).select("repo", "id_a", "id_b", "similarity", "clone_type")


@query("m3_similar_functions")
def similar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Structure clones of the generated functions, per repository."""
    nodes, functions = code_functions(spark, sf)
    tokens = structure.structure_tokens(nodes)
    docs = functions.join(shuffled(tokens), ["repo", "file_path", "fn_id"]).select(
        "repo", F.concat_ws(":", "file_path", F.lpad(F.col("lineno").cast("string"), 7, "0")).alias("id"),
        "file_path", "lineno", F.array_join("tokens", " ").alias("text"),
    )
    return similarity.similar_pairs(
        materialize(docs, "structure"), similarity.ngrams(F.col("text"))
    ).select("repo", "id_a", "id_b", "similarity", "clone_type")


STOP_WORDS = ["the", "and", "of", "to", "in", "is", "les", "la", "le", "de", "des", "der", "die",
              "und", "en", "el", "los", "las", "que", "an"]
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _search_sql(k: int, before: str = "", corpus: str = "documents", queries: str = "benchmark") -> str:
    """Best k documents per query; a corpus has doc_id and text, queries have item_id and text."""
    index = tfidf_sql("'all'").replace(
        f"{words_sql('lower(text)', 2)} AS w",
        f"list_filter({words_sql('lower(text)', 2)}, lambda t: t NOT IN ({_STOPS})) AS w",
    )
    index = before + index.replace("FROM documents", f"FROM {corpus}")
    return f"""
WITH {index},
qtoks AS (SELECT item_id AS query_id, list_filter({words_sql('lower(text)', 2)},
            lambda t: t NOT IN ({_STOPS})) AS w FROM {queries}),
qgrams AS (SELECT query_id, unnest(w) AS term FROM qtoks
           UNION ALL SELECT query_id, unnest(list_transform(range(1, len(w)),
                            lambda i: w[i] || ' ' || w[i + 1])) FROM qtoks),
qraw AS (SELECT query_id, term, count(*) * any_value(idf) AS q FROM qgrams JOIN idf USING (term) GROUP BY ALL),
qnorm AS (SELECT query_id, sqrt(sum(q * q)) AS norm FROM qraw GROUP BY 1),
scores AS (SELECT query_id, id, sum(q / norm * w) AS cosine FROM qraw JOIN qnorm USING (query_id)
           JOIN weights USING (term) GROUP BY ALL HAVING sum(q / norm * w) >= 0.05),
rounded AS (SELECT query_id, id, {_half_up('cosine', 3)} AS score FROM scores),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank
           FROM rounded)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= {k}"""


@query("m4_nl_search", _search_sql(5))
def search(spark: SparkSession, sf: str) -> DataFrame:
    terms = similarity.ngrams(F.col("text"), STOP_WORDS)
    index = search_index.build(documents(spark, sf), terms)
    queries = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search_index.search(index, queries, terms)


# One question per kind of part: its verb and name.
QUESTION = {"item_id": "p_type || '/' || p_name", "text": f"{b.VERB} || ' ' || p_name || ' total count'"}


@query("m4_function_search", _search_sql(
    3, f"""{b.FUNCTIONS_SQL},
corpus AS (SELECT file_path || ':' || lpad(CAST(lineno AS VARCHAR), 7, '0') AS doc_id,
  concat_ws(' ', replace(name, '_', ' '), CASE WHEN documented THEN 'Handles the part.' END,
            array_to_string({PARAM_LIST}, ' '), source) AS text FROM functions),
questions AS (SELECT DISTINCT {", ".join(f"{e} AS {n}" for n, e in QUESTION.items())} FROM part),
""", "corpus", "questions"))
def function_search(spark: SparkSession, sf: str) -> DataFrame:
    """Functions by the words of their names, docstrings, parameters and source."""
    _, functions = code_functions(spark, sf, FUNCTION_TYPES)
    docs = functions.select(
        F.concat_ws(":", "file_path", F.lpad(F.col("lineno").cast("string"), 7, "0")).alias("id"),
        search_index.function_text("name", "docstring", F.transform("params", lambda p: p["name"]), "source").alias("text"))
    terms = similarity.ngrams(F.col("text"), STOP_WORDS)
    index = search_index.build(materialize(docs, "function-texts"), terms)
    questions = b.table(spark, sf, "part").select(
        F.expr(QUESTION["item_id"]).alias("query_id"), F.expr(QUESTION["text"]).alias("text")).distinct()
    return search_index.search(index, questions, terms, k=3)


# --- feature models ------------------------------------------------------------


def code_features(spark: SparkSession, sf: str) -> DataFrame:
    nodes, functions = code_functions(spark, sf, structure.MEASURED_TYPES)
    return structure.function_features(functions, structure.function_counts(nodes))


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


FEATURES_SQL = f"""
{b.FUNCTIONS_SQL},
features AS (SELECT repo, file_path, name, lineno, cc AS complexity,
  loc / 100.0::DOUBLE AS loc_100, {_d('n_if')} / loc * 10.0 AS ifs, {_d('n_loop')} / loc * 10.0 AS loops,
  0.0::DOUBLE AS tries, {_d('n_call')} / loc * 10.0 AS calls, {_d('n_assign')} / loc * 10.0 AS assigns,
  {_d('n_return')} AS returns, 0.0::DOUBLE AS raises, {_d('depth')} AS depth, {_d('n_params')} AS params,
  0.0::DOUBLE AS globals, 0.0::DOUBLE AS lambdas, {_d('n_comp')} AS comprehensions, {_d('n_bool')} AS bool_ops,
  CASE WHEN documented THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS documented,
  CASE WHEN has_param_ann AND has_return_ann THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS typed,
  0.0::DOUBLE AS comment_ratio,
  CASE WHEN starts_with(name, '_') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS private FROM functions)"""


@query("m5_function_features", f"""
WITH {FEATURES_SQL}
SELECT repo, file_path, name, lineno, CAST(complexity AS BIGINT) AS complexity,
       {", ".join(f"{_half_up(f, 9)} AS {f}" for f in FEATURES)} FROM features""")
def features(spark: SparkSession, sf: str) -> DataFrame:
    rows = code_features(spark, sf)
    for f in FEATURES:
        rows = rows.withColumn(f, round_half_up(F.col(f), 9))
    return rows.drop("fn_id")


# Order lines as function features, for the models on a large table.
LINE_FEATURES = {
    "loc_100": "l_quantity / 12.5", "ifs": "CAST(l_linenumber % 4 AS DOUBLE) / 8",
    "loops": "CAST(l_linenumber % 3 AS DOUBLE) / 8", "tries": "CAST(l_linenumber % 2 AS DOUBLE) / 4",
    "calls": "CAST(l_orderkey % 8 AS DOUBLE) / 8", "assigns": "CAST(l_partkey % 8 AS DOUBLE) / 8",
    "returns": "CAST(l_linenumber AS DOUBLE)", "raises": "CAST(l_suppkey % 3 AS DOUBLE)",
    "depth": "CAST(l_partkey % 8 AS DOUBLE)", "params": "CAST(l_orderkey % 10 AS DOUBLE)",
    "globals": "CAST(l_suppkey % 4 AS DOUBLE)", "lambdas": "CAST(l_partkey % 2 AS DOUBLE)",
    "comprehensions": "CAST(l_orderkey % 2 AS DOUBLE)", "bool_ops": "CAST(l_suppkey % 5 AS DOUBLE)",
    "documented": "CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END",
    "typed": "CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END",
    "comment_ratio": "CAST(l_linenumber AS DOUBLE) / 16",
    "private": "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END",
}
LINE_FEATURES_SQL = (
    "features AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS INTEGER) "
    "AS complexity, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in LINE_FEATURES.items())
    + " FROM lineitem)"
)
_LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "lineitem").selectExpr(
        *_LINE_KEYS, "CAST(l_linenumber AS INT) AS complexity",
        *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in LINE_FEATURES.items()],
    )


_HEURISTIC = "least(100.0, loc_100 * 20.0 + depth * 10.0 + params * 5.0 + (1.0 - documented) * 15.0 + globals * 8.0)"
_BAND = "CASE WHEN s >= 70 THEN 'HIGH' WHEN s >= 50 THEN 'MEDIUM' ELSE 'LOW' END"


@query("m6_bug_risk_heuristic", f"""
WITH {LINE_FEATURES_SQL}, scored AS (SELECT *, {_HEURISTIC} AS s FROM features)
SELECT {", ".join(_LINE_KEYS)}, {_half_up('s', 1)} AS risk_score, {_BAND} AS risk_level
FROM scored WHERE s >= 40""")
def heuristic_risk(spark: SparkSession, sf: str) -> DataFrame:
    return models.bug_risk_heuristic(line_features(spark, sf)).select(
        *_LINE_KEYS, "risk_score", "risk_level"
    )


def _linear_sql(coefficients) -> str:
    weights, bias = coefficients
    return " + ".join([f"CAST({bias!r} AS DOUBLE)"]
                      + [f"{n} * CAST({w!r} AS DOUBLE)" for n, w in zip(FEATURES, weights)])


_BONUS = (
    "CASE WHEN loc_100 * 100.0 > 80.000000001 THEN 8.0 ELSE 0.0 END + CASE WHEN depth >= 5 THEN 10.0 ELSE 0.0 END "
    "+ CASE WHEN params >= 6 THEN 7.0 ELSE 0.0 END + CASE WHEN documented < 0.5 THEN 5.0 ELSE 0.0 END "
    "+ CASE WHEN globals >= 2 THEN 6.0 ELSE 0.0 END"
)


def _factor_sql() -> str:
    whole = lambda x: f"CAST(CAST(floor({x} + 1e-9) AS BIGINT) AS VARCHAR)"
    return (
        "array_to_string(list_filter(["
        f"CASE WHEN loc_100 * 100.0 > 80.000000001 THEN 'Function is ' || {whole('loc_100 * 100.0')} || ' lines' END, "
        f"CASE WHEN depth >= 5 THEN 'Nesting depth ' || {whole('depth')} END, "
        f"CASE WHEN params >= 6 THEN {whole('params')} || ' parameters' END, "
        "CASE WHEN documented < 0.5 THEN 'No documentation' END, "
        f"CASE WHEN globals >= 2 THEN {whole('globals')} || ' global accesses' END], "
        "lambda f: f IS NOT NULL)[:4], '; ')"
    )


@query("m7_bug_risk_model", f"""
WITH {LINE_FEATURES_SQL},
scored AS (SELECT *, least(100.0, 70.0 / (1.0 + exp(-({_linear_sql(models.bug_coefficients())}))) + {_BONUS}) AS s
           FROM features)
SELECT {", ".join(_LINE_KEYS)}, {_half_up('s', 1)} AS risk_score, {_BAND} AS risk_level,
       {_factor_sql()} AS factors FROM scored WHERE s >= 40""")
def model_risk(spark: SparkSession, sf: str) -> DataFrame:
    return models.bug_risk_model(line_features(spark, sf), max_factors=models.REFERENCE_FACTORS).select(
        *_LINE_KEYS, "risk_score", "risk_level", F.array_join("factors", "; ").alias("factors")
    )


@query("m7_code_bug_risk", f"""
WITH {FEATURES_SQL},
scored AS (SELECT *, least(100.0, 70.0 / (1.0 + exp(-({_linear_sql(models.bug_coefficients())}))) + {_BONUS}) AS s
           FROM features)
SELECT repo, file_path, name, lineno, {_half_up('s', 1)} AS risk_score, {_BAND} AS risk_level
FROM scored WHERE s >= 40""")
def code_risk(spark: SparkSession, sf: str) -> DataFrame:
    return models.bug_risk_model(code_features(spark, sf)).select(
        "repo", "file_path", "name", "lineno", "risk_score", "risk_level"
    )


@query("m8_complexity_model", f"""
WITH {LINE_FEATURES_SQL},
scored AS (SELECT *, greatest(0.0, least(100.0, {_linear_sql(models.complexity_coefficients())})) AS s FROM features),
d AS (SELECT *, s - complexity * 10.0 AS delta FROM scored)
SELECT {", ".join(_LINE_KEYS)}, {_half_up('s', 1)} AS ml_complexity, {_half_up('delta', 1)} AS delta,
       delta > 20 AND complexity <= 5 AS deceptive
FROM d WHERE s >= 40 OR (delta > 20 AND complexity <= 5)""")
def complexity(spark: SparkSession, sf: str) -> DataFrame:
    return models.complexity_model(line_features(spark, sf)).drop("complexity")


# Two features, of which SQL can solve the normal equations too.
FITTED = ["loc_100", "depth"]


@query("m8_fitted_complexity", f"""
WITH {LINE_FEATURES_SQL},
rows AS (SELECT {", ".join(f"f.{k}" for k in _LINE_KEYS)}, loc_100 AS x1, depth AS x2, CAST(l_extendedprice AS DOUBLE) / 1000 AS y
         FROM features f JOIN lineitem USING (l_orderkey, l_linenumber)),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM rows),
z AS (SELECT (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y - my AS t FROM rows, m),
e AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 1 AS d, sum(z1 * t) AS u, sum(z2 * t) AS v FROM z),
w AS (SELECT (d * u - b * v) / (a * d - b * b) / s1 AS w1, (a * v - b * u) / (a * d - b * b) / s2 AS w2 FROM e, m)
SELECT {", ".join(_LINE_KEYS)}, {_half_up('my + w1 * (x1 - m1) + w2 * (x2 - m2)', 5)} AS fitted FROM rows, m, w""")
def fitted_complexity(spark: SparkSession, sf: str) -> DataFrame:
    """A model of the price of an order line, fitted on all of them."""
    prices = b.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_extendedprice AS DOUBLE) / 1000 AS price")
    rows = line_features(spark, sf).join(prices, ["l_orderkey", "l_linenumber"])
    fitted = models.fit_complexity(rows, "price", FITTED)
    return rows.select(*_LINE_KEYS, round_half_up(models.linear_score(fitted, FITTED), 5).alias("fitted"))


@query("m9_complexity_heuristic", f"""
WITH {LINE_FEATURES_SQL}, scored AS (SELECT *, {_HEURISTIC} AS s FROM features)
SELECT {", ".join(_LINE_KEYS)}, {_half_up('s', 1)} AS ml_complexity, 1 AS cyclomatic,
       0.0::DOUBLE AS delta, false AS deceptive FROM scored WHERE s >= 40""")
def heuristic_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return models.complexity_heuristic(line_features(spark, sf)).drop("complexity")


@query("m10_clone_report", f"""
WITH hashed AS (SELECT lang AS repo, lang || '/' || doc_id AS file_path, source AS name,
                       md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash FROM documents),
groups AS (SELECT repo, hash, min((file_path, name)) AS head FROM hashed GROUP BY ALL HAVING count(*) > 1)
SELECT h.repo, 'Semantic Clone (exact, 100% similar)' AS title,
       head[2] || '() ↔ ' || h.name || '() — nearly identical logic.' AS description,
       h.file_path AS file_b
FROM hashed h JOIN groups g ON h.repo = g.repo AND h.hash = g.hash WHERE h.file_path <> head[1]""")
def clone_texts(spark: SparkSession, sf: str) -> DataFrame:
    from corpuscope.operators.similarity import clone_report, exact_clones

    items = b.table(spark, sf, "documents").select(
        F.col("lang").alias("repo"), F.expr("lang || '/' || doc_id").alias("file_path"),
        F.col("source").alias("name"), F.lit(1).alias("lineno"), F.col("text").alias("source"),
    )
    return clone_report(exact_clones(items)).select("repo", "title", "description", "file_b")
