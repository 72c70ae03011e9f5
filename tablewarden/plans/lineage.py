"""Where the columns of a relation come from, read off its analysed plan.

Catalyst gives every attribute an expression id, and the same id is the same value wherever it shows up
in a plan. So a column is followed down by its id until a table is reached. It is lost, and the answer is
None, where it passes an alias over anything but a column or a field of one, an aggregate or window, a
generator, or a step that makes rows by code. Of a union every branch is followed.

A table is a leaf of the plan, or what ``as_table`` declared to be one. No job is started.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame

MARK = "table:"


@dataclass(frozen=True)
class Origin:
    """A column of a table, and below it the fields that were taken."""

    table: str | None
    path: tuple[str, ...]


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Declare ``df`` a table of that name: its columns are taken as they are named.

    For whoever provides tables, such as those computed from others; not for whoever queries them.
    """
    return df.alias(MARK + name)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _declared(node) -> str | None:
    """The name of a declared table."""
    if _kind(node) != "SubqueryAlias":
        return None
    name = node.identifier().name()
    return name[len(MARK) :] if name.startswith(MARK) else None


def _leaf_name(node) -> str | None:
    """The catalog name of a leaf, or the last part of the only path it reads."""
    kind = _kind(node)
    if kind in ("LogicalRelation", "StreamingRelation"):
        if kind == "LogicalRelation" and node.catalogTable().isDefined():
            return node.catalogTable().get().identifier().unquotedString()
        if kind == "LogicalRelation" and _kind(node.relation()) == "HadoopFsRelation":
            roots = _items(node.relation().location().rootPaths())
            return PurePosixPath(roots[0].getName()).stem if len(roots) == 1 else None
        return None
    return node.name() if kind.startswith("DataSourceV2") else None


class _Tracer:
    def __init__(self, plan):
        self.plan = plan
        self.ctes: dict[int, object] = {}

    def follow(self, node, attribute) -> frozenset[Origin] | None:
        """Origins of an output attribute of ``node``; none at all for a NULL literal."""
        declared = _declared(node)
        children = _items(node.children())
        kind = _kind(node)
        if declared is not None:
            return frozenset([Origin(declared, (attribute.name(),))])
        if kind == "WithCTE":
            for definition in _items(node.cteDefs()):
                self.ctes[definition.id()] = definition.children().apply(0)
            return self.follow(node.plan(), attribute)
        if kind == "CTERelationRef":
            body = self.ctes.get(node.cteId())
            return None if body is None or node.recursive() else self._by_place(node, body, attribute)
        if not children:
            return frozenset([Origin(_leaf_name(node), (attribute.name(),))])
        if kind == "Project":
            return self._named(_items(node.projectList()), children[0], attribute)
        if kind == "Aggregate":
            return self._named(_items(node.aggregateExpressions()), children[0], attribute)
        if kind == "Union":
            found = [self._by_place(node, child, attribute) for child in children]
            return None if None in found else frozenset().union(*found)
        if kind in ("UnionLoop", "Expand"):
            return None
        below = [child for child in children if child.outputSet().contains(attribute)]
        return self.follow(below[0], attribute) if len(below) == 1 else None

    def _by_place(self, node, child, attribute) -> frozenset[Origin] | None:
        place = [a.exprId().id() for a in _items(node.output())].index(attribute.exprId().id())
        return self.follow(child, child.output().apply(place))

    def _named(self, expressions: list, child, attribute) -> frozenset[Origin] | None:
        wanted = attribute.exprId().id()
        for expression in expressions:
            if expression.exprId().id() == wanted:
                return self._value(expression, child)
        return None

    def _value(self, expression, child) -> frozenset[Origin] | None:
        fields: tuple[str, ...] = ()
        while True:
            match _kind(expression):
                case "AttributeReference":
                    if not child.outputSet().contains(expression):
                        return None  # of an outer query
                    found = self.follow(child, expression)
                    return None if found is None else frozenset(Origin(o.table, o.path + fields) for o in found)
                case "Alias":
                    expression = expression.child()
                case "GetStructField":
                    fields = (expression.extractFieldName(), *fields)
                    expression = expression.child()
                case "Literal":
                    return frozenset() if expression.value() is None else None
                case "Cast" if _kind(expression.child()) == "Literal" and expression.child().value() is None:
                    return frozenset()
                case _:
                    return None


def origins(df: DataFrame) -> list[frozenset[Origin] | None]:
    """Per column of ``df`` the table columns its values are taken from, unchanged; None if it is lost."""
    plan = df._jdf.queryExecution().analyzed()
    tracer = _Tracer(plan)
    return [tracer.follow(plan, attribute) for attribute in _items(plan.output())]


def tables_of(df: DataFrame) -> list[str]:
    """Names of all tables the plan reads, those in subqueries too, in plan order."""
    found: dict[str, None] = {}

    def walk(node) -> None:
        name = _declared(node)
        if name is None:
            below = _items(node.children())
            if not below:
                name = _leaf_name(node)
            for child in below + _items(node.subqueries()):
                walk(child)
            if _kind(node) == "WithCTE":
                return
        if name is not None:
            found[name] = None

    walk(df._jdf.queryExecution().analyzed())
    return list(found)
