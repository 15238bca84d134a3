"""A small SQL-like language: select, where, groupBy, pivot and label clauses, each a string.

A clause is split into tokens, parsed into a tree and built as Columns, so everything after that is the engine's.
Arithmetic is in doubles and gives null on division by zero; missing properties are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import QueryError

# Words that must stand in back quotes to be identifiers.
RESERVED = "and asc by date datetime desc false format group is label limit not null offset options or order pivot select timeofday timestamp true where".split()
AGGREGATES: dict[str, Callable[[Column], Column]] = {"avg": F.avg, "average": F.avg, "count": F.count, "max": F.max, "min": F.min, "sum": F.sum}
SCALARS: dict[str, Callable[[Column], Column]] = {"upper": F.upper, "lower": F.lower}
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.?\d*|\.\d+)|(?P<word>[A-Za-z_]\w*)|`(?P<quoted>[^`]*)`|'(?P<single>[^']*)'|"(?P<double>[^"]*)"|(?P<op><=|>=|!=|<>|[-+*/()<>=,]))""")


@dataclass(frozen=True)
class Node:
    """kind: name, literal, call, binary, not, null (a test); text: how the result's property is called."""

    kind: str
    text: str
    value: object = None
    parts: tuple[Node, ...] = ()

    def names(self, inside_aggregate: bool = True) -> set[str]:
        if self.kind == "name":
            return {str(self.value)}
        if self.kind == "call" and self.value in AGGREGATES and not inside_aggregate:
            return set()
        return set().union(*(p.names(inside_aggregate) for p in self.parts)) if self.parts else set()

    def aggregates(self) -> bool:
        return (self.kind == "call" and self.value in AGGREGATES) or any(p.aggregates() for p in self.parts)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *ops: str) -> str | None:
        """The next token, if it is one of these operators or key words."""
        kind, text = self.peek()
        if kind in ("op", "word") and text.lower() in ops:
            self.at += 1
            return text.lower()
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise QueryError(f"expected {op!r} before {self.peek()[1]!r}")

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")

    def condition(self) -> Node:
        left = self.conjunction()
        while self.take("or"):
            right = self.conjunction()
            left = Node("binary", f"{left.text} or {right.text}", "or", (left, right))
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("and"):
            right = self.negation()
            left = Node("binary", f"{left.text} and {right.text}", "and", (left, right))
        return left

    def negation(self) -> Node:
        if self.take("not"):
            inner = self.negation()
            return Node("not", f"not {inner.text}", None, (inner,))
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        if self.take("is"):
            negated = bool(self.take("not"))
            self.need("null")
            return Node("null", f"{left.text} is {'not ' * negated}null", negated, (left,))
        if op := self.take("<=", ">=", "!=", "<>", "<", ">", "="):
            right = self.sum()
            return Node("binary", f"{left.text} {op} {right.text}", op, (left, right))
        return left

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            right = self.product()
            left = Node("binary", f"{left.text} {op} {right.text}", op, (left, right))
        return left

    def product(self) -> Node:
        left = self.atom()
        while op := self.take("*", "/"):
            right = self.atom()
            left = Node("binary", f"{left.text} {op} {right.text}", op, (left, right))
        return left

    def atom(self) -> Node:
        kind, text = self.peek()
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        if self.take("-"):
            kind, text = self.peek()
            if kind != "number":
                raise QueryError("a minus sign must stand before a number or between two terms")
            text = "-" + text
        self.at += 1
        if kind == "number":
            return Node("literal", text, float(text))
        if kind in ("single", "double"):
            return Node("literal", repr(text), text)
        if kind == "quoted":
            return Node("name", text, text)
        if kind == "word" and text.lower() in ("true", "false"):
            return Node("literal", text, text.lower() == "true")
        if kind == "word" and (self.peek() == ("op", "(")):
            name = text.lower()
            if name not in AGGREGATES and name not in SCALARS:
                raise QueryError(f"unknown function {text}")
            self.need("(")
            inner = self.sum()
            self.need(")")
            if name in SCALARS and inner.kind != "name":
                raise QueryError(f"{name} takes one identifier")
            if inner.aggregates():
                raise QueryError("aggregation functions can't be nested")
            return Node("call", f"{name}({inner.text})", name, (inner,))
        if kind == "word" and text.lower() not in RESERVED:
            return Node("name", text, text)
        raise QueryError(f"unexpected {text!r}")

    def list(self, labelled: bool = False) -> list[tuple[Node, str | None]]:
        out = []
        while True:
            node, label = self.sum(), None
            if labelled:
                kind, label = self.peek()
                if kind not in ("single", "double"):
                    raise QueryError(f"{node.text} has no label")
                self.at += 1
            out.append((node, label))
            if not self.take(","):
                self.done()
                return out


class Builder:
    """Columns of nodes over a DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def column(self, node: Node) -> Column:
        if node.kind == "name":
            return F.col(f"`{node.value}`") if node.value in self.df.columns else F.lit(None)
        if node.kind == "literal":
            return F.lit(node.value)
        if node.kind == "not":
            return ~F.coalesce(self.column(node.parts[0]), F.lit(False))
        if node.kind == "null":
            x = self.column(node.parts[0])
            return x.isNotNull() if node.value else x.isNull()
        if node.kind == "call":
            return (AGGREGATES.get(node.value) or SCALARS[node.value])(self.column(node.parts[0]))
        a, b = map(self.column, node.parts)
        if node.value in ("and", "or"):
            a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
            return a & b if node.value == "and" else a | b
        if node.value in "+-*/":
            a, b = a.cast("double"), b.cast("double")
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[node.value]()
        return F.coalesce({"=": a == b, "!=": a != b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.value], F.lit(False))


def parse_list(text: str) -> list[Node]:
    return [n for n, _ in Parser(text).list()]


def gql(df: DataFrame, query: dict) -> DataFrame:
    """Run {select, where?, groupBy?, pivot?, label?} on documents."""
    unknown = set(query) - {"select", "where", "groupBy", "pivot", "label"}
    if unknown or "select" not in query:
        raise QueryError(f"unknown clause {sorted(unknown)[0]}" if unknown else "a query needs a select clause")
    build, labels = Builder(df), {}
    if query.get("label"):
        labels = {n.text: label for n, label in Parser(query["label"]).list(labelled=True)}
    if query.get("where"):
        parser = Parser(query["where"])
        node = parser.condition()
        parser.done()
        if node.aggregates():
            raise QueryError("aggregation functions can't stand in a where clause")
        df = df.filter(build.column(node))
    groups = parse_list(query["groupBy"]) if query.get("groupBy") else []
    pivots = parse_list(query["pivot"]) if query.get("pivot") else []
    star = query["select"].strip() == "*"
    chosen = [] if star else parse_list(query["select"])
    for text in labels:
        if not star and text not in {n.text for n in chosen}:
            raise QueryError(f"label of {text}, which isn't selected")
    name = lambda n: labels.get(n.text, n.text)
    if not groups and not pivots and not any(n.aggregates() for n in chosen):
        return df if star else df.select(*(build.column(n).alias(name(n)) for n in chosen))
    grouped, pivoted = {str(n.value) for n in groups}, {str(n.value) for n in pivots}
    if any(n.kind != "name" for n in (*groups, *pivots)):
        raise QueryError("groupBy and pivot take identifiers")
    if grouped & pivoted:
        raise QueryError(f"{sorted(grouped & pivoted)[0]} is in both groupBy and pivot")
    if star or any(n.names(inside_aggregate=False) - grouped - pivoted for n in chosen):
        raise QueryError("every identifier in select must be aggregated or in groupBy")
    keys = [build.column(n).alias(f"__g{k}") for k, n in enumerate(groups)]
    plain = [n for n in chosen if not n.aggregates()]
    measures = [n for n in chosen if n.aggregates()]
    by_name = {str(n.value): F.col(f"__g{k}") for k, n in enumerate(groups)}

    def on_keys(n: Node) -> Column:
        """A selected expression of grouped identifiers."""
        return by_name[str(n.value)] if n.kind == "name" else Rebound(df, by_name).column(n)

    if not pivots:
        out = df.groupBy(*keys).agg(*(build.column(n).alias(f"__a{k}") for k, n in enumerate(measures))) if measures else df.select(*keys).distinct()
        return out.select(*(on_keys(n).alias(name(n)) if n in plain else F.col(f"__a{measures.index(n)}").alias(name(n)) for n in chosen))
    # The distinct values become columns, so they come to the driver; Spark's own limit on pivot values applies.
    text = F.concat_ws(", ", *(build.column(n).cast("string") for n in pivots))
    out = df.withColumn("__pivot", text).groupBy(*keys).pivot("__pivot")
    table = out.agg(*(build.column(n).alias(f"__a{k}") for k, n in enumerate(measures)))
    values = [c for c in table.columns if not re.fullmatch(r"__g\d+", c)]
    columns = [on_keys(n).alias(name(n)) for n in plain if n.names() <= grouped]
    for c in values:
        value, k = (c.rsplit("___a", 1)[0], int(c.rsplit("___a", 1)[1])) if len(measures) > 1 else (c, 0)
        columns.append(F.col(f"`{c}`").alias(f"{value} {name(measures[k])}"))
    return table.select(*columns)


class Rebound(Builder):
    """A builder whose identifiers are the grouped columns."""

    def __init__(self, df: DataFrame, names: dict[str, Column]):
        super().__init__(df)
        self.of = names

    def column(self, node: Node) -> Column:
        return self.of.get(str(node.value), F.lit(None)) if node.kind == "name" else super().column(node)
