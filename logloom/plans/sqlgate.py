"""One SELECT over the view of events, and nothing else: decided on the parsed tree, never on its text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from logloom.operators.store import exists
from logloom.plans.rewrites import qualified
from logloom.schemas import EVENTS

VIEW = "events"
_SELECT = re.compile(r"^\s*select\b", re.IGNORECASE)
#: Plan nodes that a SELECT may have. Relations and table functions are looked at by name.
PLANS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "WithWindowDefinition",
}
#: Expression nodes that the parser makes of operators and syntax.
EXPRESSIONS = {
    "Add", "Alias", "And", "AttributeReference", "BitwiseAnd", "BitwiseNot", "BitwiseOr", "BitwiseXor", "CaseWhen", "Cast", "Coalesce", "Collate", "Concat", "CreateArray", "CreateMap", "CreateNamedStruct", "CreateStruct", "Cube", "CurrentDate", "CurrentRow$",
    "CurrentTimestamp", "Divide", "EqualNullSafe", "EqualTo", "Exists", "Extract", "FormatString", "GreaterThan", "GreaterThanOrEqual", "GroupingAnalytics", "GroupingSets", "ILike", "If", "In", "InSubquery", "IntegralDivide", "IsNotNull", "IsNull", "LambdaFunction",
    "LateralSubquery", "LessThan", "LessThanOrEqual", "Like", "LikeAll", "LikeAny", "ListQuery", "Literal", "Lower", "MakeInterval", "MultiAlias", "Multiply", "NamePlaceholder$", "Not", "NotLikeAll", "NotLikeAny", "NullIf", "Or", "Overlay", "RLike", "Remainder", "Rollup",
    "ScalarSubquery", "ShiftLeft", "ShiftRight", "ShiftRightUnsigned", "SortOrder", "SpecifiedWindowFrame", "StringLocate", "StringTrim", "StringTrimBoth", "StringTrimLeft", "StringTrimRight", "Substring", "Subtract", "TimestampAdd", "TimestampDiff", "TryCast",
    "UnaryMinus", "UnaryPositive", "UnboundedFollowing$", "UnboundedPreceding$", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal",
    "UnresolvedRegex", "UnresolvedStar", "UnresolvedStarExceptOrReplace", "UnresolvedSubqueryColumnAliases", "UnresolvedWindowExpression", "UnspecifiedFrame$", "WindowExpression", "WindowSpecDefinition", "SemiStructuredExtract",
}
#: Groups of built-in functions by Spark's own documentation; they compute from their arguments alone.
GROUPS = {"agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs"}
#: Of the functions without such a group, these.
FUNCTIONS = {"typeof", "uuid", "monotonically_increasing_id", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union", "approx_top_k_estimate"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer"}


class RejectedQuery(ValueError):
    pass


def _items(found) -> Iterator:
    """The items of a Scala sequence."""
    each = found.iterator()
    while each.hasNext():
        yield each.next()


class _Walk:
    def __init__(self, spark: SparkSession):
        registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.info = lambda name: registry.lookupFunction(identifier(name))

    def function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        found = self.info(name) if len(parts) == 1 else None
        if found is None or not found.isDefined() or (found.get().getGroup() not in GROUPS and name not in FUNCTIONS):
            raise RejectedQuery(f"function {'.'.join(parts)} is not allowed")

    def expression(self, e, names: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind not in EXPRESSIONS:
            raise RejectedQuery(f"{kind} is not allowed")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            self.function(list(_items(e.nameParts())) if kind == "UnresolvedFunction" else [e.name().funcName()])
        if kind in ("Exists", "ScalarSubquery", "ListQuery", "LateralSubquery"):
            self.plan(e.plan(), names)
        for child in _items(e.children()):
            self.expression(child, names)

    def plan(self, node, names: frozenset[str]) -> None:
        """names: the relations that can be seen from here, in lower case."""
        kind = node.getClass().getSimpleName()
        if kind not in PLANS:
            raise RejectedQuery(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in names:
                raise RejectedQuery(f"relation {'.'.join(parts)} is not allowed; query {VIEW}")
        if kind == "UnresolvedTableValuedFunction":
            parts = list(_items(node.name()))
            if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                raise RejectedQuery(f"table function {'.'.join(parts)} is not allowed")
        if kind == "UnresolvedWith":
            # a table expression sees those before it, and what follows sees all; none is seen from outside
            for relation in _items(node.cteRelations()):
                self.plan(relation._2(), names)
                names = names | {relation._1().lower()}
        if kind == "WithWindowDefinition":
            for _, spec in ((w._1(), w._2()) for w in _items(node.windowDefinitions())):
                self.expression(spec, names)
        for e in _items(node.expressions()):
            self.expression(e, names)
        for child in _items(node.children()):
            self.plan(child, names)


def check(spark: SparkSession, sql: str) -> None:
    """Raises RejectedQuery unless sql is a single SELECT whose only relation is the view of events.

    The text must begin with SELECT and have no semicolon. Then the parsed tree is walked, plans, expressions and subqueries alike:
    each node must be of a known kind, each relation the view or a table expression in scope (so files and catalogs are out of
    reach), and each function a built-in one of GROUPS, FUNCTIONS or TABLE_FUNCTIONS (so none that reads, or calls into the JVM).
    """
    if not _SELECT.match(sql) or ";" in sql:
        raise RejectedQuery("only a single SELECT is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(qualified(sql))
    except ParseException as e:
        raise RejectedQuery(f"the query can't be parsed: {e}") from e
    _Walk(spark).plan(plan, frozenset({VIEW}))


def query(spark: SparkSession, events: DataFrame, sql: str) -> DataFrame:
    """The result of a SELECT, which may have a QUALIFY clause, over the flat event table, planned by Catalyst."""
    check(spark, sql)
    events.createOrReplaceTempView(VIEW)
    return spark.sql(qualified(sql))


def query_path(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """The same over a stored table; without any stored part the result is empty."""
    check(spark, sql)
    events = spark.read.schema(EVENTS).parquet(path) if exists(spark, path) else spark.createDataFrame([], EVENTS)
    return query(spark, events, sql)


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest n (1 to 1000) events by ingest time, ties by event id."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be from 1 to 1000")
    from pyspark.sql import functions as F

    return events.orderBy(F.col("ingest_time").desc(), "event_id").limit(n).select("event_id", "ingest_time", "source_file", "parser_name", "parser_version", "event_json", "raw_sha256")
