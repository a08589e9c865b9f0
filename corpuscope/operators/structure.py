"""Measures of Python code: aggregations over syntax-tree node rows.

Node rows of one function sit together in their input partition, so the
map-side half of every aggregation leaves about one row per function to
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.scoring import complexity_rank, maintainability_index
from corpuscope.functions.text import round_half_up, split_lines
from corpuscope.sources.syntax import BRANCHING_TYPES, FUNCTION_TYPES

FILE = ["repo", "file_path"]
DOCUMENTED_TYPES = (*FUNCTION_TYPES, "ClassDef")
NEST_TYPES = ("If", "For", "While", "With", "Try", "ExceptHandler")

# Call names that suggest a database query, an HTTP call, a
# blocking call, an aggregation.
QUERY_CALLS = ("filter", "get", "all", "first", "last", "execute", "query", "fetchone",
               "fetchall", "find", "aggregate", "count", "exists")
HTTP_CALLS = ("get", "post", "put", "delete", "patch")
BLOCKING_CALLS = ("time.sleep", "requests.get", "requests.post", "input")
FOLD_CALLS = ("sum", "min", "max", "any", "all", "sorted")


def _is(*types: str) -> Column:
    return F.col("node_type").isin(*types)


def _issue(rows: DataFrame, severity: str, title: str, description: Column, fix: Column) -> DataFrame:
    return rows.select(
        "repo", "file_path", F.col("lineno").alias("line_no"), F.lit(severity).alias("severity"),
        F.lit(title).alias("title"), description.alias("description"), fix.alias("fix"),
        F.col("node_id").cast("bigint").alias("seq"),
    )


def calls_in_loops(nodes: DataFrame) -> DataFrame:
    """Query-like calls and HTTP requests made once per loop iteration."""
    detail = F.col("detail")
    calls = nodes.filter(_is("Call") & (F.col("loop_depth") > 0))
    quoted = F.concat(F.lit('"'), F.col("fn_name"), F.lit('"'))
    queries = _issue(
        calls.filter(detail["callee"].isin(*QUERY_CALLS)), "MEDIUM", "N+1 Query Pattern",
        F.concat(quoted, F.lit(" runs individual DB queries in a loop.")),
        F.lit("Batch with select_related(), prefetch_related(), or IN query."),
    )
    requests = _issue(
        calls.filter(detail["callee"].isin(*HTTP_CALLS) & (detail["owner"] == "requests")),
        "MEDIUM", "HTTP Request in Loop",
        F.concat(quoted, F.lit(" creates a new TCP connection per iteration.")),
        F.lit("Create requests.Session() outside the loop and reuse it."),
    )
    return queries.unionByName(requests)


def blocking_in_async(nodes: DataFrame) -> DataFrame:
    full = F.col("detail")["full"]
    blocking = F.lit(False)
    for name in BLOCKING_CALLS:
        blocking = blocking | full.contains(name)
    calls = nodes.filter(_is("Call") & F.col("in_async") & blocking)
    return _issue(
        calls, "HIGH", "Blocking I/O in Async Function",
        F.concat(F.lit('Blocking call "'), full, F.lit('" in async "'), F.col("fn_name"),
                 F.lit('" blocks the event loop.')),
        F.lit("Use asyncio.sleep(), aiofiles, or httpx.AsyncClient()."),
    )


def list_in_aggregate(nodes: DataFrame) -> DataFrame:
    """A list comprehension handed to an aggregation call."""
    name, lists = F.col("detail")["callee"], F.col("detail")["list_args"].cast("int")
    calls = nodes.filter(_is("Call") & name.isin(*FOLD_CALLS) & (lists > 0))
    return _issue(
        calls.withColumn("_each", F.explode(F.sequence(F.lit(1), lists))),
        "LOW", "Unnecessary List in Aggregation",
        F.concat(name, F.lit("() doesn't need a list comprehension.")),
        F.concat(F.lit("Use generator: "), name, F.lit("(x for x in ...)")),
    )


def wildcard_imports(nodes: DataFrame) -> DataFrame:
    module = F.col("detail")["module"]
    return _issue(
        nodes.filter(_is("ImportFrom") & F.col("detail")["wildcard"].isNotNull()),
        "LOW", "Wildcard Import",
        F.concat(F.lit("'from "), module, F.lit(" import *' pollutes namespace.")),
        F.concat(F.lit("Import only what you need from "), module, F.lit(".")),
    )


def class_method_counts(nodes: DataFrame) -> DataFrame:
    """Functions anywhere inside each class."""
    methods = (
        nodes.filter(_is("FunctionDef", "AsyncFunctionDef"))
        .select(*FILE, F.explode("class_ids").alias("node_id"))
        .groupBy(*FILE, "node_id").agg(F.count("*").alias("methods"))
    )
    return nodes.filter(_is("ClassDef")).join(methods, [*FILE, "node_id"], "left").select(
        *FILE, "node_id", "lineno", F.col("detail")["name"].alias("name"),
        F.coalesce("methods", F.lit(0)).alias("methods"),
    )


def structural_smells(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """God classes, long functions, long parameter lists."""
    def smell(rows, severity, title, description):
        return rows.select(
            *FILE, F.col("lineno").alias("line_no"), F.lit(title).alias("title"),
            F.lit(severity).alias("severity"), description.alias("description"),
        )

    gods = class_method_counts(nodes).filter(F.col("methods") > 15)
    name = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    length = F.col("loc") - 1
    return (
        smell(gods, "HIGH", "God Class",
              F.concat(F.lit("Class "), name, F.lit(" has "), F.col("methods").cast("string"),
                       F.lit(" methods. Consider splitting.")))
        .unionByName(smell(
            functions.filter(length > 50), "MEDIUM", "Long Function",
            F.concat(name, F.lit(" is "), length.cast("string"),
                     F.lit(" lines. Refactor into smaller units."))))
        .unionByName(smell(
            functions.filter(F.col("arg_count") > 5), "LOW", "Too Many Parameters",
            F.concat(name, F.lit(" has "), F.col("arg_count").cast("string"),
                     F.lit(" parameters."))))
    )


def dead_functions(functions: DataFrame) -> DataFrame:
    """Functions whose body is a single pass."""
    return functions.filter("pass_only").select(*FILE, "fn_id", "name", "lineno")


def doc_coverage(nodes: DataFrame) -> DataFrame:
    """Percent of functions and classes with a docstring, per repository."""
    documented = F.col("detail")["docstring"] != ""
    return (
        nodes.filter(_is(*DOCUMENTED_TYPES))
        .groupBy("repo")
        .agg(F.count("*").alias("total"), F.count_if(documented).alias("documented"))
        .select(
            "repo", "total", "documented",
            round_half_up(F.col("documented") * F.lit(100.0) / F.col("total"), 1).alias(
                "doc_coverage"
            ),
        )
    )


def function_lengths(functions: DataFrame) -> DataFrame:
    return functions.groupBy("repo").agg(
        round_half_up(F.avg("loc"), 1).alias("avg_function_length"),
        F.max("loc").alias("max_function_length"),
        F.count_if("pass_only").alias("dead_code_count"),
    )


# node type(s) behind each count of function_counts
COUNTED = {
    "n_if": ("If",), "n_loop": ("For", "While"), "n_try": ("Try",), "n_call": ("Call",),
    "n_assign": ("Assign",), "n_return": ("Return",), "n_raise": ("Raise",),
    "n_global": ("Global",), "n_lambda": ("Lambda",),
    "n_comp": ("ListComp", "DictComp", "SetComp", "GeneratorExp"), "n_bool": ("BoolOp",),
}


COUNTED_TYPES = tuple(sorted({t for types in COUNTED.values() for t in types} | set(NEST_TYPES)))
#: node types that all measures of functions read
MEASURED_TYPES = (*FUNCTION_TYPES, *COUNTED_TYPES, *BRANCHING_TYPES)


def function_counts(nodes: DataFrame) -> DataFrame:
    """All per-function counts in one aggregation, combined map-side.

    A node counts for every function around it; a branch only for the
    innermost one. Nested statements cost one more per level in the cognitive
    score; a boolean chain costs its extra values and hides what is below it.
    """
    scoped = nodes.filter(
        F.col("node_type").isin(*COUNTED_TYPES) | (F.col("decisions") > 0)
    ).select(
        *FILE, F.col("fn_id").alias("own"), "node_type", "decisions", "in_boolop",
        F.col("detail")["values"].cast("int").alias("values"),
        F.explode(F.arrays_zip("scope_ids", "scope_depths")).alias("s"),
    )
    nests, level = _is(*NEST_TYPES), F.col("s.scope_depths") + 1
    cognitive = F.when(
        ~F.col("in_boolop"),
        F.when(nests, level).when(F.col("node_type") == "BoolOp", F.col("values") - 1),
    )
    return scoped.groupBy(*FILE, F.col("s.scope_ids").alias("fn_id")).agg(
        *[F.count_if(_is(*types)).alias(name) for name, types in COUNTED.items()],
        F.max(F.when(nests, level)).alias("depth"),
        F.sum(cognitive).alias("cognitive"),
        F.sum(F.when(F.col("own") == F.col("s.scope_ids"), F.col("decisions"))).alias("branches"),
    )


def function_complexity(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Cyclomatic and cognitive complexity of every function."""
    keys = [*FILE, "fn_id"]
    cc = F.coalesce("branches", F.lit(0)) + 1
    return (
        functions.select(*keys, "name", "lineno", "loc")
        .join(counts.select(*keys, "branches", "cognitive"), keys, "left")
        .select(
            *keys, "name", "lineno", "loc", cc.alias("complexity"),
            complexity_rank(cc).alias("rank"), (cc > 10).alias("is_too_complex"),
            F.coalesce("cognitive", F.lit(0)).alias("cognitive"),
        )
    )


def average_complexity(complexity: DataFrame, repos: DataFrame) -> DataFrame:
    """Mean complexity per repository, 1.0 where it has no functions."""
    means = complexity.groupBy("repo").agg(F.avg("complexity").alias("mean"))
    return repos.select("repo").distinct().join(means, "repo", "left").select(
        "repo", round_half_up(F.coalesce("mean", F.lit(1.0)), 1).alias("cyclomatic_avg")
    )


FEATURES = [
    "loc_100", "ifs", "loops", "tries", "calls", "assigns", "returns", "raises", "depth",
    "params", "globals", "lambdas", "comprehensions", "bool_ops", "documented", "typed",
    "comment_ratio", "private",
]


def function_features(functions: DataFrame, counts: DataFrame) -> DataFrame:
    """Eighteen numeric features per function, in the order of FEATURES, and its complexity."""
    keys = [*FILE, "fn_id"]
    size = F.greatest("loc", F.lit(1)).cast("double")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("double")

    def per_line(name: str) -> Column:
        return number(name) / size * F.lit(10.0)

    def flag(c: Column) -> Column:
        return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))

    comments = F.col("comments") / size
    values = [
        F.col("loc") / F.lit(100.0), per_line("n_if"), per_line("n_loop"), per_line("n_try"),
        per_line("n_call"), per_line("n_assign"), number("n_return"), number("n_raise"),
        number("depth"), F.size("params").cast("double"), number("n_global"),
        number("n_lambda"), number("n_comp"), number("n_bool"), flag(F.col("docstring") != ""),
        flag(F.col("has_param_ann") & F.col("has_return_ann")), comments,
        flag(F.startswith("name", F.lit("_"))),
    ]
    # the source text itself stays behind: only its comment count is joined
    lean = functions.withColumn("comments", F.regexp_count("source", F.lit(r"#[^\n]*"))).select(
        *keys, "name", "lineno", "loc", "params", "docstring", "has_param_ann", "has_return_ann",
        "comments",
    )
    return lean.join(counts, keys, "left").select(
        *keys, "name", "lineno", (F.coalesce("branches", F.lit(0)) + 1).alias("complexity"),
        *[v.alias(n) for v, n in zip(values, FEATURES)],
    )


def halstead(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Halstead measures of a token table with columns kind (operator/operand) and token.

    Tokens are first counted per distinct token, so repeated tokens are
    combined before the shuffle and no distinct set is held in one task.
    """
    counted = tokens.groupBy(*by, "kind", "token").agg(F.count("*").alias("n"))
    op, arg = F.col("kind") == "operator", F.col("kind") == "operand"
    sums = counted.groupBy(*by).agg(
        F.count_if(op).alias("h1"), F.count_if(arg).alias("h2"),
        F.coalesce(F.sum(F.when(op, F.col("n"))), F.lit(0)).alias("N1"),
        F.coalesce(F.sum(F.when(arg, F.col("n"))), F.lit(0)).alias("N2"),
    )
    vocabulary, length = F.col("h1") + F.col("h2"), F.col("N1") + F.col("N2")
    with_volume = sums.withColumn("vocabulary", vocabulary).withColumn("length", length).withColumn(
        "volume", F.when(F.col("vocabulary") > 0, F.col("length") * F.log2("vocabulary"))
        .otherwise(F.lit(0.0)),
    ).withColumn(
        "difficulty",
        F.when(F.col("h2") > 0, F.col("h1") * F.col("N2") / (F.col("h2") * F.lit(2.0)))
        .otherwise(F.lit(0.0)),
    )
    return with_volume.withColumn("effort", F.col("difficulty") * F.col("volume"))


HALSTEAD = ["h1", "h2", "N1", "N2", "vocabulary", "length", "volume", "difficulty", "effort"]


def code_tokens(nodes: DataFrame) -> DataFrame:
    """Operator and operand tokens of Python files."""
    terms = nodes.filter(F.size("operators") > 0)
    ops = terms.select(*FILE, F.lit("operator").alias("kind"), F.explode("operators").alias("token"))
    args = terms.select(*FILE, F.lit("operand").alias("kind"), F.explode("operands").alias("token"))
    return ops.unionByName(args)


def halstead_mean(measures: DataFrame) -> DataFrame:
    """Mean of each Halstead measure over the files where it is not zero."""
    return measures.groupBy("repo").agg(
        *[round_half_up(F.avg(F.nullif(F.col(m), F.lit(0))), 2).alias(m) for m in HALSTEAD]
    )


def file_maintainability(
    files: DataFrame, measures: DataFrame, complexity: DataFrame
) -> DataFrame:
    """Maintainability index of every file from volume, complexity, size and comments."""
    lines = split_lines(F.col("content"))
    sloc = F.size(F.filter(lines, lambda s: F.trim(s) != ""))
    comments = F.size(F.filter(lines, lambda s: F.startswith(F.ltrim(s), F.lit("#"))))
    base = files.select(*FILE, sloc.alias("sloc"), comments.alias("comments"))
    cc = complexity.groupBy(*FILE).agg(F.sum("complexity").alias("cc"))
    volume = measures.select(*FILE, "volume")
    percent = F.when(F.col("sloc") > 0, F.col("comments") * F.lit(100.0) / F.col("sloc")).otherwise(
        F.lit(0.0)
    )
    return (
        base.join(volume, FILE, "left").join(cc, FILE, "left")
        .select(
            *FILE,
            maintainability_index(
                F.coalesce("volume", F.lit(0.0)), F.coalesce("cc", F.lit(0)),
                F.col("sloc").cast("double"), percent,
            ).alias("mi"),
        )
    )


def repo_maintainability(mi: DataFrame, repos: DataFrame, default: float = 70.0) -> DataFrame:
    means = mi.groupBy("repo").agg(F.avg("mi").alias("mean"))
    return repos.select("repo").distinct().join(means, "repo", "left").select(
        "repo", F.coalesce("mean", F.lit(default)).alias("maintainability_index")
    )


def type_token(node_type: Column, detail: Column) -> Column:
    """Clone-detection label of a node."""
    return (
        F.when(node_type == "Name", "NAME")
        .when(node_type == "Constant", F.concat(F.lit("CONST_"), detail["const"]))
        .when(node_type == "FunctionDef", "FUNCDEF").when(node_type == "Call", "CALL")
        .when(node_type.isin("For", "While"), "LOOP").when(node_type == "If", "IF")
        .when(node_type == "Return", "RETURN").when(node_type == "Assign", "ASSIGN")
        .otherwise(F.upper(node_type))
    )


def structure_tokens(nodes: DataFrame) -> DataFrame:
    """Tree-walk token sequence of every function, starting with the function itself.

    A function's own nodes only; the list is bounded by the size of one file.
    """
    token = type_token(F.col("node_type"), F.col("detail"))
    inside = nodes.select(*FILE, "node_id", token.alias("token"), F.explode("scope_ids").alias("fn_id"))
    heads = nodes.filter(_is("FunctionDef", "AsyncFunctionDef")).select(
        *FILE, F.col("node_id").alias("fn_id"), "node_id", token.alias("token")
    )
    return (
        inside.select(*FILE, "fn_id", "node_id", "token")
        .unionByName(heads)
        .groupBy(*FILE, "fn_id")
        .agg(F.array_sort(F.collect_list(F.struct("node_id", "token"))).alias("t"))
        .select(*FILE, "fn_id",
                F.concat(F.array(F.lit("MODULE")), F.transform("t", lambda x: x["token"])).alias(
                    "tokens"))
    )
