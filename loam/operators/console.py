"""Tenant-scoped SQL over lake and reference tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.session import configure

RESULT_LIMIT = 1000
# What the tree of a parsed query may hold. Commands, writes and identifiers that are only
# known when the statement runs are not among it.
QUERY_NODES = frozenset("""
    Aggregate CTERelationDef CTERelationRef Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    LocalRelation Offset OneRowRelation Pivot Project Range RepartitionByExpression Repartition Sample Sort SubqueryAlias Tail Union
    UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
    UnresolvedWith Unpivot Window WithCTE WithWindowDefinition""".split())
LEAVES = frozenset("CTERelationRef LocalRelation OneRowRelation Range".split())
SUBQUERIES = frozenset("Exists LateralSubquery ListQuery ScalarSubquery FunctionTableSubqueryArgumentExpression".split())
REFLECTIVE = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())


def clean_sql(text: str) -> str:
    """The statement without surrounding blanks and end marks; empty text is refused."""
    statement = text.strip().rstrip(";").strip()
    if not statement:
        raise ValueError("empty statement")
    return statement


class Console:
    """One tenant's session.

    Tables with a tenant_id column are visible through pre-filtered views only. A
    statement may name those views and nothing else: no other schema's tables, no
    files by path, no commands. So it cannot reach other tenants' rows whether or
    not it uses current_user_tenant().
    """

    def __init__(self, spark: SparkSession, tenant_id: int,
                 tables: Callable[[SparkSession], dict[str, DataFrame]]):
        tenant = str(int(tenant_id))
        self.session = configure(spark.newSession())
        self.views = set()
        for name, frame in tables(self.session).items():
            if "tenant_id" in frame.columns:
                frame = frame.filter(F.col("tenant_id") == tenant)
            frame.createOrReplaceTempView(name)
            self.views.add(name.lower())
        self.session.sql("CREATE OR REPLACE TEMPORARY FUNCTION current_user_tenant() "
                         f"RETURNS STRING RETURN '{tenant}'")
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")

    def query(self, text: str, args: dict | None = None) -> DataFrame:
        statement = clean_sql(text)
        self._check_parsed(statement)
        frame = self.session.sql(statement, args=args)
        self._check_origin(frame._jdf.queryExecution().analyzed())
        return frame

    def _check_parsed(self, statement: str) -> None:
        """Refuse what is not a plain query, going by the nodes of Spark's own parse.

        Nothing is run or looked up here: a command would act as soon as it is planned.
        """
        plan = self.session._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        for node in _nodes(plan):
            kind = node.getClass().getSimpleName().rstrip("$")
            if kind not in QUERY_NODES:
                raise ValueError(f"not allowed in a query: {kind}")
            if kind == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
                raise ValueError("not a table of this tenant")
            for expression in _expressions(node):
                kind = expression.getClass().getSimpleName().rstrip("$")
                if "Identifier" in kind:
                    raise ValueError("computed identifiers are not allowed")
                if kind == "UnresolvedFunction" and _items(expression.nameParts())[-1].lower() in REFLECTIVE:
                    raise ValueError("this function is not allowed")

    def _check_origin(self, plan) -> None:
        """Every leaf of the analysed plan lies in one of the tenant's views."""
        kind = plan.getClass().getSimpleName().rstrip("$")
        if kind == "View":
            if plan.isTempView() and plan.desc().identifier().table().lower() in self.views:
                return
            raise ValueError("not a table of this tenant")
        below = [*_items(plan.children()), *_items(plan.subqueries())]
        if kind == "WithCTE":
            below += _items(plan.cteDefs())
        if not _items(plan.children()) and kind not in LEAVES:
            raise ValueError(f"not a table of this tenant: {kind}")
        for child in below:
            self._check_origin(child)

    def run(self, text: str, args: dict | None = None, limit: int = RESULT_LIMIT) -> DataFrame:
        """At most `limit` rows with every cell as text, nulls kept."""
        return stringified(self.query(text, args).limit(limit))


def _items(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _expressions(node):
    """All expressions of a plan node, nested ones too."""
    todo = _items(node.expressions())
    while todo:
        expression = todo.pop()
        yield expression
        todo += _items(expression.children())


def _nodes(plan):
    """All nodes of a parsed plan, those of subqueries and common table expressions too."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += [*_items(node.children()), *_items(node.innerChildren())]
        for expression in _expressions(node):
            if hasattr(expression, "plan") and expression.getClass().getSimpleName().rstrip("$") in SUBQUERIES:
                todo.append(expression.plan())


def stringified(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns])


def query_history(runs: DataFrame, now: str, keep: int = 20, hours: int = 24) -> DataFrame:
    """Newest runs of each (tenant, user) within the kept time."""
    from loam.plans.paging import newest
    from loam.plans.panes import since
    recent = runs.filter(since(F.col("run_at"), now, hours / 24))
    return newest(recent, ["tenant_id", "user_id"],
                  [F.col("run_at").desc(), F.col("query_id").desc()], keep)


def last_statement(runs: DataFrame) -> DataFrame:
    return runs.groupBy("tenant_id", "user_id").agg(
        F.max_by("sql", F.struct("run_at", "query_id")).alias("last_sql"))
