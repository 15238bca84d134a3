"""JSON selectors as Columns.

A selector is checked on the driver and becomes one boolean Column of built-in expressions, so filters reach the scan. It
works on typed columns or on one VARIANT column. Conditions are met or not: a missing field meets none but
{$exists: false} and negations. In typed mode SQL NULL (and NaN) means missing; in VARIANT mode JSON null is a value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QueryError
from quern.functions import collate

COMBINERS = ("$and", "$or", "$nor", "$not")
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$exists", "$type", "$in", "$nin", "$all", "$size", "$elemMatch", "$allMatch", "$mod", "$regex", "$not", "$and", "$or", "$nor")


def yes() -> Column:
    return F.lit(True)


def no() -> Column:
    return F.lit(False)


def negated(condition: Column) -> Column:
    """True where the condition isn't met. Conditions may be null for not met: bare comparisons reach the scan as filters."""
    return ~F.coalesce(condition, F.lit(False))


def js_type(value: Any) -> str:
    """The type of a value as error messages name it."""
    if value is None:
        return "null"
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", tuple: "array", dict: "object"}.get(type(value), "object")


def shown(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return ",".join(map(shown, value))
    return "" if value is None else str(value)


def parse_path(path: str) -> list[str]:
    """Names of a dotted path; a backslash before a dot makes it part of a name."""
    return [re.sub(r"\\(.)", r"\1", p) for p in re.split(r"(?<!\\)\.", path)]


def is_operators(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(k.startswith("$") for k in value)


def is_int(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and float(value).is_integer()


def validate(selector: Any) -> None:
    """Raise QueryError for what can't be a selector. The messages are fixed values."""
    if not isinstance(selector, dict):
        raise QueryError("Selector error: expected a JSON object")
    for key, value in selector.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, list):
                raise QueryError(f"Query operator {key} must be an array. Received {js_type(value)}: {shown(value)}")
            for part in value:
                validate(part)
        elif key == "$not":
            validate(value)
        elif key.startswith("$"):
            validate_operator(key, value)
        elif is_operators(value):
            validate(value)
        elif isinstance(value, dict):
            validate(value)


def validate_operator(op: str, x: Any) -> None:
    if op not in OPERATORS:
        raise QueryError(f'unknown operator "{op}" - should be one of {", ".join(o for o in OPERATORS)}')

    def fail(what: str, said: str | None = None) -> None:
        raise QueryError(f"Query operator {op} must be {what}. Received {said or f'{js_type(x)}: {shown(x)}'}")

    if op in ("$in", "$nin", "$all") and not isinstance(x, (list, tuple)):
        fail("an array")
    if op in ("$elemMatch", "$allMatch"):
        if not isinstance(x, dict):
            fail("an object")
        validate(x)
    if op == "$exists" and not isinstance(x, bool):
        fail("a boolean")
    if op == "$size" and not is_int(x):
        fail("a integer")
    if op == "$type" and x not in collate.TYPE_NAMES:
        raise QueryError(f"Query operator $type must be a string. Supported values: null, boolean, number, string, array, or object. Received {js_type(x)}: {shown(x)}")
    if op == "$regex" and not isinstance(x, (str, re.Pattern)):
        fail("a string or an instance of a regular expression")
    if op == "$mod":
        if not isinstance(x, (list, tuple)):
            fail("an array")
        if len(x) != 2 or not all(map(is_int, x)):
            fail("in the format [divisor, remainder], where divisor and remainder are both integers")
        if x[0] == 0:
            raise QueryError("Query operator $mod's divisor cannot be 0, cannot divide by zero.")


def java_regex(pattern: str | re.Pattern) -> str:
    """The pattern for Java, with flags in front; constructs that mean something else there are refused."""
    flags, text = "", pattern if isinstance(pattern, str) else pattern.pattern
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
    if re.search(r"\(\?P[<=]|\\[QEGZzA]|[*+?}]\+", text):
        raise QueryError(f"regular expression not supported: {text}")
    return f"(?{flags}){text}" if flags else text


class Value:
    """What a selector needs to know of one field or element. A missing one is None instead."""

    def get(self, name: str) -> Value | None:
        raise NotImplementedError

    def exists(self) -> Column:
        raise NotImplementedError

    def is_type(self, kind: int) -> Column:
        raise NotImplementedError

    def compare(self, op: str, x: Any) -> Column:
        """False for missing values; op is one of the six comparisons."""
        raise NotImplementedError

    def number(self) -> Column:
        """As a double; null for anything but numbers."""
        raise NotImplementedError

    def text(self) -> Column:
        raise NotImplementedError

    def elements(self) -> tuple[Column, Callable[[Column], Value]] | None:
        """An array column (null for anything but arrays) and what makes a Value of an element; None if it can't be an array."""
        raise NotImplementedError


COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b,
}


def by_rank(op: str, mine: int, other: int) -> bool:
    """A comparison of values of different types."""
    return {"$eq": False, "$ne": True, "$gt": mine > other, "$gte": mine > other, "$lt": mine < other, "$lte": mine < other}[op]


class Typed(Value):
    """A typed column. Dates and times count as strings in ISO form, and are compared as such or, if the operand is one, as times."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind
        self.floating = isinstance(kind, (T.DoubleType, T.FloatType))

    @property
    def rank(self) -> int:
        for kinds, r in (((T.BooleanType,), collate.BOOLEAN), ((T.NumericType,), collate.NUMBER), ((T.ArrayType,), collate.ARRAY), ((T.StructType, T.MapType), collate.OBJECT), ((T.NullType,), collate.NULL)):
            if isinstance(self.kind, kinds):
                return r
        return collate.STRING

    def get(self, name: str) -> Value | None:
        if isinstance(self.kind, T.StructType) and name in self.kind.names:
            return Typed(self.column.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, T.MapType) and isinstance(self.kind.keyType, T.StringType):
            return Typed(F.try_element_at(self.column, F.lit(name)), self.kind.valueType)
        return None

    def exists(self) -> Column:
        return self.column.isNotNull() & ~F.isnan(self.column) if self.floating else self.column.isNotNull()

    def is_type(self, kind: int) -> Column:
        return self.exists() if kind == self.rank else no()

    def compare(self, op: str, x: Any) -> Column:
        x, other = collate.normalize(x), collate.rank(x)
        if other != self.rank:
            return self.exists() if by_rank(op, self.rank, other) else no()
        if other == collate.ARRAY:
            found = self.array_compare(op, x)
        elif other == collate.OBJECT:
            found = self.object_equal(x)
            found = negated(found) & self.exists() if op == "$ne" else found if op in ("$eq", "$gte", "$lte") else no()
        elif isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            found = self.time_compare(op, x)
        else:
            found = COMPARE[op](self.column, F.lit(x))
        # NaN is greater than every number to Spark, and missing here.
        return found & ~F.isnan(self.column) if self.floating and op in ("$gt", "$gte", "$ne") else found

    def array_compare(self, op: str, x: list) -> Column:
        kind = self.kind.elementType.simpleString()
        if all(collate.rank(v) == Typed(F.lit(None), self.kind.elementType).rank for v in x):
            return COMPARE[op](self.column, F.array(*map(F.lit, x)).cast(f"array<{kind}>"))
        return COMPARE[op](collate._binary_key(F.to_json(self.column)), F.lit(collate.encode(x)))

    def object_equal(self, x: dict) -> Column:
        if not isinstance(self.kind, T.StructType) or set(x) - set(self.kind.names):
            return no()
        parts = []
        for name in self.kind.names:
            inner = self.get(name)
            parts.append(inner.compare("$eq", x[name]) if name in x else ~inner.exists())
        return reduce(lambda a, b: a & b, parts, self.exists())

    def time_compare(self, op: str, x: str) -> Column:
        try:
            datetime.fromisoformat(x)
            return COMPARE[op](self.column, F.lit(x).cast(self.kind))
        except ValueError:
            return COMPARE[op](self.text(), F.lit(x))

    def number(self) -> Column:
        return self.column.cast("double") if self.rank == collate.NUMBER else F.lit(None).cast("double")

    def text(self) -> Column:
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.date_format(self.column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return self.column if self.rank == collate.STRING else F.lit(None).cast("string")

    def elements(self) -> tuple[Column, Callable[[Column], Value]] | None:
        return (self.column, lambda c: Typed(c, self.kind.elementType)) if isinstance(self.kind, T.ArrayType) else None


class Variant(Value):
    """A value in a VARIANT."""

    def __init__(self, column: Column):
        self.column = column

    def get(self, name: str) -> Value:
        # Paths have no escapes, so a name is quoted with the mark that it doesn't hold.
        if "'" in name and '"' in name:
            raise QueryError(f"a field's name can't hold both kinds of quotation marks: {name}")
        path = f'$["{name}"]' if "'" in name else f"$['{name}']"
        return Variant(F.try_variant_get(self.column, path, "variant"))

    def exists(self) -> Column:
        return self.column.isNotNull()

    def is_type(self, kind: int) -> Column:
        return F.coalesce(collate.variant_rank(self.column) == kind, no())

    def compare(self, op: str, x: Any) -> Column:
        x, other = collate.normalize(x), collate.rank(x)
        mine = collate.variant_rank(self.column)
        if other in (collate.ARRAY, collate.OBJECT):
            return COMPARE[op](collate.binary_key(self.column), F.lit(collate.encode(x)))
        if other == collate.NULL:
            same = F.lit(op in ("$eq", "$gte", "$lte"))
        else:
            kind = {collate.BOOLEAN: "boolean", collate.NUMBER: "double", collate.STRING: "string"}[other]
            same = COMPARE[op](F.try_variant_get(self.column, "$", kind), F.lit(float(x) if other == collate.NUMBER else x))
        different = F.lit(True) if op == "$ne" else F.lit(False) if op == "$eq" else mine > other if op in ("$gt", "$gte") else mine < other
        return F.coalesce(F.when(mine == other, same).otherwise(different), no()) & self.exists()

    def number(self) -> Column:
        return F.when(self.is_type(collate.NUMBER), F.try_variant_get(self.column, "$", "double"))

    def text(self) -> Column:
        return F.when(self.is_type(collate.STRING), F.try_variant_get(self.column, "$", "string"))

    def elements(self) -> tuple[Column, Callable[[Column], Value]]:
        return F.try_variant_get(self.column, "$", "array<variant>"), Variant


class Compiler:
    """Selectors over the columns of a DataFrame: typed, or all fields in one VARIANT column."""

    def __init__(self, df: DataFrame, id_col: str = "_id", variant: str | None = None):
        self.schema, self.id_col, self.variant = df.schema, id_col, variant

    def field(self, names: list[str]) -> Value | None:
        name, *rest = names
        column = self.id_col if name == "_id" else name
        if self.variant is not None and name != "_id":
            value: Value | None = Variant(F.col(self.variant)).get(name)
        elif column in self.schema.names:
            value = Typed(F.col(f"`{column}`"), self.schema[column].dataType)
            if isinstance(self.schema[column].dataType, T.VariantType):
                value = Variant(F.col(f"`{column}`"))
        else:
            value = None
        for name in rest:
            value = value.get(name) if value is not None else None
        return value

    def compile(self, selector: dict) -> Column:
        """The condition of a valid selector; {} is met by every row."""
        validate(selector)
        return self.matches(selector, None)

    def matches(self, selector: dict, base: Value | None) -> Column:
        """selector on the row (base None) or on an object; null counts as not met."""
        parts: list[Column] = []
        for key, x in selector.items():
            if key in ("$and", "$or", "$nor"):
                each = [self.matches(s, base) for s in x]
                parts.append(reduce(lambda a, b: a & b, each, yes()) if key == "$and" else self.any(each) if key == "$or" else negated(self.any(each)))
            elif key == "$not":
                parts.append(negated(self.matches(x, base)))
            elif key.startswith("$"):
                parts.append(self.operator(key, x, base, is_id=False))
            else:
                names = parse_path(key)
                value = self.field(names) if base is None else reduce(lambda v, n: v.get(n) if v is not None else None, names, base)
                parts.append(self.condition(x, value, names == ["_id"] and base is None))
        return reduce(lambda a, b: a & b, parts) if parts else yes()

    @staticmethod
    def any(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, parts, no())

    def condition(self, x: Any, value: Value | None, is_id: bool) -> Column:
        """What stands behind a field's name: operators, an object whose members are conditions, or a value to equal."""
        if is_operators(x):
            return reduce(lambda a, b: a & b, [self.operator(op, y, value, is_id) for op, y in x.items()], yes())
        if isinstance(x, dict) and x:
            return reduce(lambda a, b: a & b, [self.condition(y, value.get(n) if value is not None else None, False) for n, y in x.items()])
        return self.operator("$eq", x, value, is_id)

    def operator(self, op: str, x: Any, value: Value | None, is_id: bool) -> Column:
        if op == "$not":
            return negated(self.condition(x, value, is_id) if isinstance(x, dict) else self.operator("$eq", x, value, is_id))
        if op in ("$and", "$or", "$nor"):
            each = [self.condition(y, value, is_id) for y in x]
            return reduce(lambda a, b: a & b, each, yes()) if op == "$and" else self.any(each) if op == "$or" else negated(self.any(each))
        if op == "$exists":
            found = value.exists() if value is not None else no()
            return found if x else ~found
        if value is None:
            return no()
        if op in COMPARE:
            if is_id and not isinstance(x, str) and isinstance(value, Typed) and value.rank == collate.STRING:
                # Bounds on the primary key that aren't strings don't follow the order of types.
                return yes() if op in ("$gt", "$gte", "$ne") else no()
            return value.compare(op, x)
        if op == "$type":
            return value.is_type(collate.TYPE_NAMES[x])
        if op in ("$in", "$nin"):
            found = self.contained(value, x)
            return found if op == "$in" else value.exists() & negated(found)
        if op == "$mod":
            n = value.number()
            return (n == F.floor(n)) & (n % F.lit(float(x[0])) == F.lit(float(x[1])))
        if op == "$regex":
            return value.text().rlike(java_regex(x))
        parts = value.elements()
        if parts is None:
            return no()
        column, element = parts
        if op == "$size":
            return F.when(column.isNotNull(), F.size(column)) == int(x)
        if op == "$all":
            return reduce(lambda a, b: a & b, [self.has(column, element, y) for y in x], column.isNotNull())
        inner = lambda c: self.condition(x, element(c), False) if is_operators(x) else self.matches(x, element(c))
        if op == "$elemMatch":
            return F.exists(column, inner)
        return (F.size(column) > 0) & F.forall(column, inner)

    @staticmethod
    def has(column: Column, element: Callable[[Column], Value], x: Any) -> Column:
        return F.exists(column, lambda c: element(c).compare("$eq", x))

    def contained(self, value: Value, x: list) -> Column:
        """Whether the value, or an element of it if it's an array, equals one of x."""
        if isinstance(value, Typed) and value.rank in (collate.NUMBER, collate.STRING, collate.BOOLEAN) and not isinstance(value.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            own = [y for y in x if collate.rank(y) == value.rank]
            return value.column.isin(own) if own else no()
        found = self.any([value.compare("$eq", y) for y in x])
        if (parts := value.elements()) is not None:
            column, element = parts
            found = found | F.exists(column, lambda c: self.any([element(c).compare("$eq", y) for y in x]))
        return found


def compile_selector(df: DataFrame, selector: dict, id_col: str = "_id", variant: str | None = None) -> Column:
    return Compiler(df, id_col, variant).compile(selector)


def normal_form(selector: dict) -> dict:
    """The selector as explain() shows it: bare values as $eq, $and flattened, and $and multiplied out over $or.

    Conditions that can't be merged into one per operator stay, under $and.
    """

    def field(x: Any) -> Any:
        return x if isinstance(x, dict) else {"$eq": x}

    flat: dict[str, Any] = {}
    alternatives: list[list[dict]] = []
    others: list[dict] = []

    def add(s: dict) -> None:
        for key, x in s.items():
            if key == "$and":
                for part in x:
                    add(part)
            elif key == "$or":
                alternatives.append([normal_form(part) for part in x])
            elif key == "$nor":
                flat[key] = [*flat.get(key, []), *x]
            elif key == "$not":
                others.append({key: x}) if key in flat else flat.update({key: x})
            else:
                for op, y in field(x).items():
                    if not merge_bound(flat.setdefault(key, {}), op, y):
                        others.append({key: {op: y}})

    add(selector)
    if alternatives:
        product: list[dict] = alternatives[0]
        for other in alternatives[1:]:
            product = [normal_form({"$and": [a, b]}) for a in product for b in other]
        flat["$or"] = product
    if others:
        flat["$and"] = others
    return flat


def merge_bound(into: dict, op: str, x: Any) -> bool:
    """Bounds on one field that say the same become the tighter one; several patterns stay side by side. False if x can't be added."""
    for kind, sign in ((("$gt", "$gte"), 1), (("$lt", "$lte"), -1)):
        if op not in kind:
            continue
        for other in kind:
            if other in into:
                c = sign * collate.compare(x, into[other])
                if c < 0 or (c == 0 and not (op == kind[0] and other == kind[1])):
                    return True
                del into[other]
    if op in ("$regex", "$ne") and op in into:
        into[op] = [*(into[op] if isinstance(into[op], list) else [into[op]]), x]
    elif op in into:
        return collate.rank(into[op]) == collate.rank(x) and into[op] == x
    else:
        into[op] = x
    return True
