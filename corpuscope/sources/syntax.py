"""Python syntax trees as rows: the one step of the library that runs Python.

``parse_python`` reads each file once, inside Arrow batches, and emits flat
node rows. All measures are relational work on those rows. A file that does
not parse gives no rows and never fails its task.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuscope.functions.text import split_lines
from corpuscope.skew import dealt

NEST = frozenset({ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ExceptHandler})
LOOPS = frozenset({ast.For, ast.While})
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
FUNCTION_TYPES = ("FunctionDef", "AsyncFunctionDef")
BRANCHING = frozenset({ast.Try, ast.BoolOp, ast.If, ast.IfExp, ast.Assert, ast.For, ast.While,
                       ast.AsyncFor, ast.comprehension})
COMPUTING = frozenset({ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign, ast.Compare})
DETAILED = frozenset({*FUNCTIONS, ast.ClassDef, ast.Call, ast.Constant, ast.ImportFrom,
                      ast.BoolOp})
DECORATED = frozenset({*FUNCTIONS, ast.ClassDef})
BRANCHING_TYPES = tuple(sorted(kind.__name__ for kind in BRANCHING))
COMPUTING_TYPES = tuple(sorted(kind.__name__ for kind in COMPUTING))

NODE_SCHEMA = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("fn_id", T.IntegerType()),
        T.StructField("class_ids", T.ArrayType(T.IntegerType())),
        T.StructField("fn_name", T.StringType()),
        # every function around the node, outermost first, and the nesting inside each
        T.StructField("scope_ids", T.ArrayType(T.IntegerType())),
        T.StructField("scope_depths", T.ArrayType(T.IntegerType())),
        T.StructField("node_type", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("end_lineno", T.IntegerType()),
        T.StructField("loop_depth", T.IntegerType()),
        T.StructField("in_async", T.BooleanType()),
        T.StructField("in_boolop", T.BooleanType()),
        T.StructField("decisions", T.IntegerType()),
        T.StructField("detail", T.MapType(T.StringType(), T.StringType())),
        T.StructField("operators", T.ArrayType(T.StringType())),
        T.StructField("operands", T.ArrayType(T.StringType())),
        # functions only: parameters, which of them are annotated, source text
        T.StructField("params", T.ArrayType(T.StringType())),
        T.StructField("annotated", T.ArrayType(T.BooleanType())),
        T.StructField("source", T.StringType()),
    ]
)


def _decisions(node: ast.AST) -> int:
    """Branches a node adds to cyclomatic complexity."""
    if isinstance(node, ast.Try):
        return len(node.handlers) + bool(node.orelse)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, (ast.If, ast.IfExp, ast.Assert)):
        return 1
    if isinstance(node, (ast.For, ast.While, ast.AsyncFor)):
        return 1 + bool(node.orelse)
    if isinstance(node, ast.comprehension):
        return 1 + len(node.ifs)
    return 0


def _terms(node: ast.AST) -> tuple[list[str], list[ast.AST]]:
    """Operators of a node and the operands they apply to."""
    kind = lambda x: type(x).__name__
    if isinstance(node, ast.BinOp):
        return [kind(node.op)], [node.left, node.right]
    if isinstance(node, ast.UnaryOp):
        return [kind(node.op)], [node.operand]
    if isinstance(node, ast.BoolOp):
        return [kind(node.op)], list(node.values)
    if isinstance(node, ast.AugAssign):
        return [kind(node.op)], [node.target, node.value]
    if isinstance(node, ast.Compare):
        return [kind(o) for o in node.ops], [*node.comparators, node.left]
    return [], []


def _operand_text(node: ast.AST, context: str, number: int) -> str:
    """Same text for the same name or literal in one function; unique otherwise."""
    if isinstance(node, ast.Name):
        return f"{context}:{node.id}"
    if isinstance(node, ast.Attribute):
        return f"{context}:{node.attr}"
    if isinstance(node, ast.Constant):
        return f"{context}:{node.value!r}"
    return f"{context}:#{number}"


def _detail(node: ast.AST) -> dict[str, str]:
    if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
        out = {"name": node.name, "docstring": ast.get_docstring(node) or ""}
        if len(node.body) == 1 and isinstance(node.body[0], ast.Pass):
            out["pass_only"] = "1"
        if isinstance(node, FUNCTIONS) and node.returns is not None:
            out["returns"] = "1"
        return out
    if isinstance(node, ast.Call):
        func = node.func
        out = {}
        if isinstance(func, ast.Attribute):
            owner = func.value.id if isinstance(func.value, ast.Name) else ""
            out = {"callee": func.attr, "owner": owner,
                   "full": f"{owner}.{func.attr}" if owner else func.attr}
        elif isinstance(func, ast.Name):
            out = {"callee": func.id, "owner": "", "full": func.id}
        lists = sum(isinstance(a, ast.ListComp) for a in node.args)
        return {**out, "list_args": str(lists)} if lists else out
    if isinstance(node, ast.Constant):
        return {"const": type(node.value).__name__}
    if isinstance(node, ast.ImportFrom):
        out = {"module": node.module or "None"}
        if any(a.name == "*" for a in node.names):
            out["wildcard"] = "1"
        return out
    if isinstance(node, ast.BoolOp):
        return {"values": str(len(node.values))}
    return {}


#: what fields hold that no node is below
PLAIN = frozenset({str, int, object, str | None, int | None, list[str]})
SCOPING = frozenset({*FUNCTIONS, *NEST, *LOOPS, ast.ClassDef, ast.BoolOp})


def _below(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold nodes; all of them where Python does not tell their types."""
    known = getattr(kind, "_field_types", {})
    return tuple(f for f in kind._fields if known.get(f) not in PLAIN)


class _Plans(dict):
    """By kind of node: whether rows are made of it, whether what is below it stands in another scope, and its fields to visit."""

    def __init__(self, types: frozenset[str] | None):
        self.types = types

    def __missing__(self, kind: type) -> tuple[bool, bool, tuple[str, ...]]:
        self[kind] = plan = (self.types is None or kind.__name__ in self.types, kind in SCOPING, _below(kind))
        return plan


def _flatten(tree: ast.AST, lines: list[str], types: frozenset[str] | None = None, plans: _Plans | None = None) -> Iterator[tuple]:
    """Breadth-first node rows, the order in which a tree walk visits them; of all nodes, or those of some types."""
    plans = _Plans(types) if plans is None else plans
    # scope: scope ids, scope depths, class ids, function name, loops, async, boolop; nodes side by side share it
    queue = [(tree, None, ((), (), (), None, 0, False, False))]
    add, node_type, is_a = queue.append, ast.AST, isinstance
    for at, (node, parent, scope) in enumerate(queue):
        kind = type(node)
        wanted, scoping, fields = plans[kind]
        if wanted:
            ids, depths, classes, name, loops, in_async, in_bool = scope
            ops, operands = _terms(node) if kind in COMPUTING else ((), ())
            params = annotated = source = None
            if kind in FUNCTIONS:
                params = [a.arg for a in node.args.args]
                annotated = [a.annotation is not None for a in node.args.args]
                source = "\n".join(lines[node.lineno - 1:node.end_lineno])
            yield (
                at, parent, ids[-1] if ids else None, classes, name or "<module>", ids, depths,
                kind.__name__, getattr(node, "lineno", None), getattr(node, "end_lineno", None),
                loops, in_async, in_bool, _decisions(node) if kind in BRANCHING else 0,
                list(_detail(node).items()) if kind in DETAILED else (), ops,
                [_operand_text(o, name or "", (at + 1) * 1000 + i) for i, o in enumerate(operands)],
                params, annotated, source,
            )
        if not fields:
            continue
        if scoping:
            outer = scope
            ids, depths, classes, name, loops, in_async, in_bool = scope
            if kind in FUNCTIONS:
                ids, depths, name = (*ids, at), (*depths, 0), node.name
                in_async = in_async or kind is ast.AsyncFunctionDef
            elif kind in NEST:
                depths = tuple(d + 1 for d in depths)
            if kind is ast.ClassDef:
                classes = (*classes, at)
            scope = (ids, depths, classes, name, loops + (kind in LOOPS), in_async, in_bool or kind is ast.BoolOp)
            if kind in DECORATED and node.decorator_list:
                # what decorates stands in the scopes around, but for all else within
                decorators = {id(d) for d in node.decorator_list}
                around = (*outer[:2], *scope[2:])
                for field in fields:
                    value = getattr(node, field, None)
                    for child in value if type(value) is list else (value,):
                        if is_a(child, node_type):
                            add((child, at, around if id(child) in decorators else scope))
                continue
        for field in fields:
            value = getattr(node, field, None)
            if type(value) is list:
                for child in value:
                    if is_a(child, node_type):
                        add((child, at, scope))
            elif is_a(value, node_type):
                add((value, at, scope))


BATCH_ROWS = 20_000

Batches = Iterator[pa.RecordBatch]


def _parse_batches(schema: pa.Schema, types: frozenset[str] | None) -> Callable[[Batches], Batches]:
    """Batches of files -> batches of node rows with the columns of ``schema``."""
    places = [NODE_SCHEMA.names.index(name) for name in schema.names]

    def run(batches: Batches) -> Batches:
        rows: list[tuple] = []
        plans = _Plans(types)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array([row[k] for row in rows], type=f.type) for k, f in zip(places, schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for repo, path, content, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                if not wanted:
                    continue
                try:
                    found = [(repo, path, *row)
                             for row in _flatten(ast.parse(content), content.splitlines(), plans=plans)]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                rows.extend(found)
                if len(rows) >= BATCH_ROWS:
                    yield flush()
        if rows:
            yield flush()

    def without_cycles(batches: Batches) -> Batches:
        """Trees and rows hold no cycles, so nothing is gained by looking for some among so many objects."""
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return without_cycles


def ast_nodes(
    files: DataFrame, min_lines: int = 5, columns: Iterable[str] | None = None, types: Iterable[str] | None = None,
    deal: bool = True,
) -> DataFrame:
    """Node rows of every Python file of at least ``min_lines`` lines.

    ``columns`` and ``types`` name the columns and node types that are wanted; others are walked, but no rows are made of
    them. By default there are all. Parsing costs far more than moving a text, so files are dealt to all tasks however few
    partitions hold them, unless ``deal`` says that they are dealt already.
    """
    # lines are counted behind the deal: a filter on texts would be pulled before it, and their making with it
    python = files.filter(F.col("language") == "Python").select(
        "repo", "file_path", "content", (F.size(split_lines(F.col("content"))) >= min_lines).alias("wanted"))
    schema = T.StructType([f for f in NODE_SCHEMA if columns is None or f.name in set(columns)])
    parse = _parse_batches(to_arrow_schema(schema), None if types is None else frozenset(types))
    return (dealt(python) if deal else python).mapInArrow(parse, schema)


def extract_functions(nodes: DataFrame) -> DataFrame:
    """One row per function with its signature and source text; a plain filter of node rows."""
    detail, self_free = F.col("detail"), F.filter("params", lambda p: p != "self")
    return nodes.filter(F.col("params").isNotNull()).select(
        "repo", "file_path", F.col("node_id").alias("fn_id"), detail["name"].alias("name"),
        "lineno", "end_lineno", (F.col("end_lineno") - F.col("lineno") + 1).alias("loc"),
        (F.col("node_type") == "AsyncFunctionDef").alias("is_async"),
        F.transform(self_free, lambda p: F.struct(p.alias("name"))).alias("params"),
        F.size("params").alias("arg_count"),
        F.array_contains("annotated", True).alias("has_param_ann"),
        detail["returns"].isNotNull().alias("has_return_ann"),
        detail["docstring"].alias("docstring"),
        detail["pass_only"].isNotNull().alias("pass_only"), "source",
    )
