"""A10 guard: whether a statement only reads registered views.

Two walks, both over plans with their expressions and subqueries. The parsed
plan must hold query nodes only, its relations must be registered views or
names of its own WITH clause, and its functions must be built-in ones of the
allowed groups; nothing is resolved, listed or read before that is known. The
analysed plan then must have no leaf outside a registered view other than
literal rows and ranges, and no call of user code. What a view itself is made
of is its owner's business and is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Groups of built-in functions, by Spark's own documentation groups. Left out are those that reach outside
# the query: misc (reflection, session and file facts, errors on demand), xml, avro, protobuf.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs",
    "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs",
    "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
PARSED_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "Join", "Union", "Except", "Intersect",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation",
    "UnresolvedInlineTable", "LocalRelation", "Offset", "Tail", "Generate", "Expand", "Window", "WithWindowDefinition", "LateralJoin",
    "Pivot", "Unpivot", "Sample", "UnresolvedTableValuedFunction", "UnresolvedOrdinal", "UnresolvedHint", "UnresolvedTVFAliases",
    "ParameterizedQuery", "UnresolvedTVFAliases", "NameParameterizedQuery", "PosParameterizedQuery",
}
LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
# Expressions that name a function at run time, and those that run code from outside Spark.
RUN_TIME_NAMES = {"ExpressionWithUnresolvedIdentifier"}
USER_CODE = {
    "CallMethodViaReflection", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "PythonUDF", "PythonUDAF", "PythonUDTF",
    "UnresolvedPythonUDTF", "HiveSimpleUDF", "HiveGenericUDF", "HiveUDAFFunction", "HiveGenericUDTF", "ApplyFunctionExpression", "V2Aggregator",
    "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(plan, into_views: bool) -> Iterator[tuple[str, object]]:
    """("plan" or "expression", node) of a plan, its WITH clause, its expressions and their subqueries."""
    plans, expressions = [plan], []
    while plans or expressions:
        if expressions:
            e = expressions.pop()
            yield "expression", e
            expressions += _items(e.children())
            if hasattr(e, "plan") and "plan" in {m.getName() for m in e.getClass().getMethods()}:
                plans.append(e.plan())
            continue
        p = plans.pop()
        yield "plan", p
        if _name(p) == "View" and not into_views:
            continue
        plans += _items(p.children())
        expressions += _items(p.expressions())
        if _name(p) == "UnresolvedWith":
            plans += [x._2() for x in _items(p.cteRelations())]
        if _name(p) == "WithCTE":
            plans += _items(p.cteDefs())


def _registered_view(spark: SparkSession, parts: list[str]) -> bool:
    catalog = spark._jsparkSession.sessionState().catalog()
    jvm = spark._jvm
    names = jvm.PythonUtils.toSeq(parts)
    if catalog.isTempView(names):
        return True
    if len(parts) > 2:
        return False
    try:
        t = spark.catalog.getTable(".".join(f"`{x}`" for x in parts))
    except Exception:  # no such table, or a path
        return False
    return t.tableType in ("VIEW", "TEMPORARY")


def _function_reason(spark: SparkSession, parts: list[str]) -> str | None:
    name = parts[-1].lower()
    if len(parts) > 1:
        return f"function not allowed: {'.'.join(parts)}"
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    info = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(identifier)
    if info.isEmpty() or info.get().getSource() != "built-in" or info.get().getGroup() not in FUNCTION_GROUPS:
        return f"function not allowed: {name}"
    return None


def parsed_reason(spark: SparkSession, sql: str) -> str | None:
    """Why the statement, as written, is not one query over registered views and allowed functions."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # any parser error is a refusal with the parser's own words
        return f"not a statement: {str(e).splitlines()[0]}"
    nodes = list(_walk(plan, True))
    ctes = {x._1().lower() for kind, n in nodes if kind == "plan" and _name(n) == "UnresolvedWith" for x in _items(n.cteRelations())}
    for kind, n in nodes:
        name = _name(n)
        if kind == "plan":
            if name not in PARSED_NODES:
                return f"not a query: {name}"
            if name == "UnresolvedRelation":
                parts = _items(n.multipartIdentifier())
                if not (len(parts) == 1 and parts[0].lower() in ctes) and not _registered_view(spark, parts):
                    return f"not a registered view: {'.'.join(parts)}"
            if name == "UnresolvedTableValuedFunction":
                parts = _items(n.name())
                if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                    return f"function not allowed: {'.'.join(parts)}"
        elif name == "UnresolvedFunction":
            if reason := _function_reason(spark, _items(n.nameParts())):
                return reason
        elif name == "UnresolvedGenerator":
            if reason := _function_reason(spark, [n.name().funcName()]):
                return reason
        elif name in RUN_TIME_NAMES:
            return f"not allowed: {name}"
    return None


def analysed_reason(df: DataFrame) -> str | None:
    """Why the analysed plan reads something other than views, or calls user code."""
    for kind, n in _walk(df._jdf.queryExecution().analyzed(), False):
        name = _name(n)
        if kind == "plan" and name != "View" and not n.children().size() and name not in LEAVES:
            return f"not a registered view: {name}"
        if kind == "plan" and name.startswith(("ScriptTransformation", "MapIn", "FlatMap", "BatchEval", "ArrowEval")):
            return f"not a query: {name}"
        if kind == "expression" and name in USER_CODE:
            return f"function not allowed: {name}"
    return None
