"""Custom column transforms: one SQL expression over the column, named ``col`` in the text."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.coerce import col
from limpid.functions.constants import CAST_LOSS_LIMIT

# Functions a transform may call: deterministic, one row in and one row out.
ALLOWED_FUNCTIONS = frozenset("""
abs btrim cast ceil ceiling char_length coalesce concat concat_ws date_format elt exp floor greatest
if ifnull initcap int instr isnotnull isnull least left length ln locate log10 log2 lower lpad ltrim
mod nanvl nullif nvl nvl2 pow power regexp_extract regexp_replace repeat replace reverse right rlike
round rpad rtrim sign sqrt split_part startswith endswith contains string substr substring
substring_index to_char to_date to_number translate trim try_add try_cast try_divide try_multiply
try_subtract try_to_date try_to_number try_to_timestamp ucase lcase upper year month day double bigint between
""".split())
# Syntax a transform may use, by the kind of its node in the parsed tree: constants, casts, arithmetic, comparisons,
# conditions, and functions that have a syntax of their own.
ALLOWED_NODES = frozenset("""
Literal Cast Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive BitwiseAnd BitwiseOr
BitwiseXor BitwiseNot And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In
IsNull IsNotNull CaseWhen If Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Concat Substring StringTrim
StringTrimLeft StringTrimRight StringLocate Overlay
""".split())
# Kinds of nodes that no resolved transform may hold, whatever name led to them.
REFUSED_NODES = frozenset("""
AggregateExpression PythonUDF PythonUDAF ScalaUDF ScalaUDAF ScalaAggregator CallMethodViaReflection TryReflect WindowExpression
ScalarSubquery Exists ListQuery InSubquery LateralSubquery LambdaFunction OuterReference Rand Randn Uuid
""".split())


def _nodes(tree):
    """All nodes of a Catalyst tree, with the name of their kind."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        yield node.getClass().getSimpleName().rstrip("$"), node
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]


def _names(node) -> list[str]:
    parts = node.nameParts()
    return [parts.apply(i).lower() for i in range(parts.size())]


def _refused_syntax(tree) -> str:
    """What a parsed, not yet resolved expression holds that a transform may not; empty if nothing."""
    for kind, node in _nodes(tree):
        if kind == "UnresolvedFunction":
            name = ".".join(_names(node))
            if name not in ALLOWED_FUNCTIONS:
                return f"function {name!r} is not allowed in a transform"
            if node.isDistinct() or node.filter().isDefined() or node.ignoreNulls():
                return f"{name!r} is called like an aggregate or window function"
        elif kind == "UnresolvedAttribute":
            if _names(node) != ["col"]:
                return f"a transform sees only col, not {'.'.join(_names(node))!r}"
        elif kind not in ALLOWED_NODES:
            return f"{kind!r} is not allowed in a transform"
        elif kind == "Literal" and node.dataType().typeName() in ("date", "timestamp", "timestamp_ntz"):
            # 'now' and 'today' hide in such constants
            return "typed dates and times are not allowed in a transform; use to_date('2020-01-31')"
    return ""


def _refused_meaning(tree) -> str:
    """What a resolved expression holds that a transform may not; empty if nothing."""
    if not tree.deterministic():
        return "a transform must give the same value each time"
    for kind, _ in _nodes(tree):
        if kind in REFUSED_NODES or kind.endswith("UDF"):
            return f"{kind!r} is not allowed in a transform"
    return ""


def check_transform(spark, code: str, data_type: str = "string") -> tuple[bool, str]:
    """(ok, reason). The parsed expression is judged, not its text.

    First every node of Spark's own parse tree must be allowed: functions by the name they are looked
    up by, however it is quoted, no columns but ``col``, no aggregates, windows, subqueries, lambdas or
    parameters. Only then Spark resolves it over a one-column frame, and the resolved tree must be
    deterministic and free of user functions, so that a function registered under an allowed name is
    refused as well. Nothing is evaluated.
    """
    if not isinstance(code, str) or not code.strip():
        return False, "a transform must be a non-empty expression"
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(code)
        reason = _refused_syntax(parsed)
        if reason:
            return False, reason
        out = spark.createDataFrame([], f"col {data_type}").select(F.expr(code).alias("col"))
        resolved = out._jdf.queryExecution().analyzed().expressions()
        reason = next(filter(None, (_refused_meaning(resolved.apply(i)) for i in range(resolved.size()))), "")
    except PySparkException as e:
        return False, f"{type(e).__name__}: {e}"
    if not reason and len(out.columns) != 1:
        reason = "a transform must yield one column"
    return not reason, reason


def bind_transform(df: DataFrame, name: str, code: str) -> DataFrame:
    """``df`` with column ``name`` replaced by the expression over it."""
    shadow = "__transform_input"
    # the text names its input ``col``; the expression sees a frame in which only that column has the name
    others = {c: f"__kept_{i}" for i, c in enumerate(df.columns) if c != name}
    renamed = df.select(*[col(c).alias(others.get(c, "col")) for c in df.columns])
    out = renamed.withColumn(shadow, F.expr(code))
    return out.select(*[
        (F.col(shadow) if c == name else F.col(others[c])).alias(c) for c in df.columns])


def damage_counts(before: Column, after: Column) -> dict[str, Column]:
    return {
        "filled": F.count(before),
        "filled_after": F.count(after),
        "invented": F.count_if(before.isNull() & after.isNotNull()),
    }


def damage_reason(counts: dict, prefix: str = "", invented_counts: bool = True) -> str:
    """Why a transform does harm, or an empty text."""
    filled, after = counts[prefix + "filled"], counts[prefix + "filled_after"]
    lost = (filled - after) / max(filled, 1)
    if lost > CAST_LOSS_LIMIT:
        return f"the transform loses {lost:.2%} of the filled cells"
    if invented_counts and counts[prefix + "invented"]:
        return f"the transform invents a value for {counts[prefix + 'invented']} empty cell(s)"
    return ""


def trial_transform(df: DataFrame, name: str, code: str) -> tuple[bool, str]:
    """Check a transform and run it over the whole column: (ok, reason)."""
    kind = df.schema[name].dataType.simpleString()
    ok, reason = check_transform(df.sparkSession, code, kind)
    if not ok:
        return ok, reason
    pair = bind_transform(df.select(col(name).alias("before"), col(name).alias("col")), "col", code)
    counts = damage_counts(F.col("before"), F.col("col"))
    try:
        row = pair.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict()
    except PySparkException as e:
        return False, f"{type(e).__name__}: {e}"
    reason = damage_reason(row)
    return not reason, reason
