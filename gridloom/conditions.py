"""What an optimised plan says about the tables it scans: columns, conditions, and answers that need no scan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

OPERATORS = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}
FLIPPED = {"=": "=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


def children(node) -> list:
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def kind(node) -> str:
    return node.getClass().getSimpleName()


def plan_of(df: DataFrame):
    return df._jdf.queryExecution().optimizedPlan()


def path_of(leaf) -> str | None:
    """The folder of a scanned store."""
    if kind(leaf) != "DataSourceV2ScanRelation":
        return None
    return leaf.relation().options().get("path")


def referenced(df: DataFrame) -> set[str]:
    """Names of the columns that any node of the optimised plan refers to or returns."""
    names: set[str] = set()
    stack = [plan_of(df)]
    out = stack[0].output()
    names.update(out.apply(i).name() for i in range(out.size()))
    while stack:
        node = stack.pop()
        it = node.references().iterator()
        while it.hasNext():
            names.add(it.next().name())
        stack += children(node)
    return names


def has_join(df: DataFrame) -> bool:
    stack = [plan_of(df)]
    while stack:
        if kind(node := stack.pop()) == "Join":
            return True
        stack += children(node)
    return False


def _literal(e):
    """A number, or a time as microseconds; None for anything else."""
    if kind(e) != "Literal" or e.value() is None:
        return None
    if e.dataType().typeName() in ("byte", "short", "integer", "long", "float", "double", "timestamp_ntz"):
        return e.value()
    return None


def told(e, columns: set[int]) -> list | None:
    """A condition as sources.grid.may_pass takes it; None where it can't be told. columns: ids of those that count."""
    name = kind(e)
    if name in ("And", "Or"):
        return [name.lower(), *(told(c, columns) for c in children(e))]
    if name in OPERATORS:
        a, b = children(e)
        op = OPERATORS[name]
        if kind(a) == "Literal":
            a, b, op = b, a, FLIPPED[op]
        value = _literal(b)
        return [op, a.name(), value] if kind(a) == "AttributeReference" and a.exprId().id() in columns and value is not None else None
    if name == "Not" and kind(inner := children(e)[0]) == "EqualTo" and (was := told(inner, columns)):
        return ["<>", *was[1:]]
    if name in ("In", "InSet"):
        c, *listed = children(e)
        if name == "InSet":
            return None
        values = [_literal(x) for x in listed]
        return ["in", c.name(), values] if kind(c) == "AttributeReference" and c.exprId().id() in columns and None not in values else None
    return None


def scans(df: DataFrame) -> Iterator[tuple[str, list | None]]:
    """(folder, condition) of every scan of a store, with the conditions that stand over it and nothing but projections in between."""

    def walk(node, over: list) -> Iterator[tuple[str, list | None]]:
        if (path := path_of(node)) is not None:
            out = node.output()
            columns = {out.apply(i).exprId().id() for i in range(out.size())}
            known = [t for t in (told(e, columns) for e in over) if t is not None]
            yield path, ["and", *known] if known else None
        for c in children(node):
            yield from walk(c, [*over, node.condition()] if kind(node) == "Filter" else over if kind(node) == "Project" else [])

    yield from walk(plan_of(df), [])


def counted(df: DataFrame) -> tuple[str, list[tuple[str, str, str | None, str]]] | None:
    """(folder, [(name, "count" | "min" | "max", column or None, type)]) of a query that asks one whole store for nothing but these; None for any other."""
    node = plan_of(df)
    if kind(node) != "Aggregate" or not node.groupingExpressions().isEmpty():
        return None
    below = children(node)[0]
    while kind(below) == "Project" and all(kind(e) == "AttributeReference" for e in (below.projectList().apply(i) for i in range(below.projectList().size()))):
        below = children(below)[0]
    if (path := path_of(below)) is None:
        return None
    asked, found = node.aggregateExpressions(), []
    for i in range(asked.size()):
        e = asked.apply(i)
        if kind(e) != "Alias" or kind(e.child()) != "AggregateExpression" or e.child().isDistinct() or e.child().filter().isDefined():
            return None
        f = e.child().aggregateFunction()
        args = children(f)
        if kind(f) not in ("Count", "Min", "Max") or len(args) != 1 or kind(args[0]) not in (("Literal", "AttributeReference") if kind(f) == "Count" else ("AttributeReference",)) or (kind(args[0]) == "Literal" and args[0].value() is None):
            return None
        found.append((e.name(), kind(f).lower(), None if kind(args[0]) == "Literal" else args[0].name(), e.dataType().sql()))
    return path, found
