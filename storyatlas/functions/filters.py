"""Filters of a map as nested arrays, made into one condition that Spark pushes down like any other.

A tree is a plain value or ``[operator, argument, ...]``:

* values: ``["get", name]``, ``["literal", value]``, ``["coalesce", a, b, ...]``, ``["case", when, then, ..., else]``
* conditions: ``all``, ``any``, ``!``, ``==``, ``!=``, ``<``, ``<=``, ``>``, ``>=``, ``["has", name]``, ``["in", value, ["literal", [...]]]``

Conditions are true or false, never NULL: NULL equals NULL alone, has no order with anything, and is false where
a condition is wanted.  ``all`` of nothing is true, ``any`` of nothing is false.  Unknown operators and
names, wrong numbers of arguments and mixed types are errors before a job runs.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDER = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_PLAIN = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}
#: Arguments of each operator, at least and at most.
_ARGUMENTS = {"get": (1, 1), "has": (1, 1), "literal": (1, 1), "coalesce": (1, None), "case": (3, None), "all": (0, None), "any": (0, None), "!": (1, 1), "==": (2, 2), "!=": (2, 2), "in": (2, 2), **dict.fromkeys(_ORDER, (2, 2))}


def _kind(data: T.DataType) -> str | None:
    if isinstance(data, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "boolean"}.get(type(data))


def _one_kind(kinds: list[str], where: str) -> str:
    found = {k for k in kinds if k != "null"}
    if len(found) > 1:
        raise TypeError(f"{where} mixes {' and '.join(sorted(found))}")
    return found.pop() if found else "null"


class _Compiler:
    def __init__(self, schema: T.StructType):
        self.fields = {f.name: f.dataType for f in schema.fields}

    def field(self, name: Any) -> tuple[Column, T.DataType]:
        if name not in self.fields:
            raise ValueError(f"there is no column {name!r}")
        return F.col("`" + name.replace("`", "``") + "`"), self.fields[name]

    def condition(self, tree: Any) -> Column:
        column, kind = self.value(tree)
        if kind not in ("boolean", "null"):
            raise TypeError(f"{tree!r} is a {kind}, no condition")
        return F.coalesce(column.cast("boolean"), F.lit(False))

    def value(self, tree: Any) -> tuple[Column, str]:
        if type(tree) in _PLAIN:
            return F.lit(tree), _PLAIN[type(tree)]
        if not isinstance(tree, (list, tuple)) or not tree or not isinstance(tree[0], str) or tree[0] not in _ARGUMENTS:
            raise ValueError(f"{tree!r} is no expression")
        name, *rest = tree
        least, most = _ARGUMENTS[name]
        if len(rest) < least or (most is not None and len(rest) > most) or (name == "case" and len(rest) % 2 == 0):
            raise ValueError(f"{name} takes other arguments than {rest!r}")
        if name == "literal":
            if type(rest[0]) not in _PLAIN:
                raise ValueError(f"{rest[0]!r} stands only behind in")
            return self.value(rest[0])
        if name in ("get", "has"):
            column, data = self.field(rest[0])
            if name == "has":
                return column.isNotNull(), "boolean"
            if _kind(data) is None:
                raise TypeError(f"{rest[0]} holds {data.simpleString()}, which filters do not compare")
            return column, _kind(data)
        if name in ("all", "any"):
            join, start = (operator.and_, True) if name == "all" else (operator.or_, False)
            return reduce(join, map(self.condition, rest)) if rest else F.lit(start), "boolean"
        if name == "!":
            return ~self.condition(rest[0]), "boolean"
        if name == "coalesce":
            columns, kinds = zip(*map(self.value, rest), strict=True)
            return F.coalesce(*columns), _one_kind(list(kinds), name)
        if name == "case":
            thens = [self.value(t) for t in [*rest[1::2], rest[-1]]]
            kind, out = _one_kind([k for _, k in thens], name), thens[-1][0]
            for when, (then, _) in reversed(list(zip(rest[:-1:2], thens[:-1], strict=True))):
                out = F.when(self.condition(when), then).otherwise(out)
            return out, kind
        if name == "in":
            return self._among(*rest)
        (a, ka), (b, kb) = map(self.value, rest)
        _one_kind([ka, kb], name)
        if name in _ORDER:
            return F.coalesce(_ORDER[name](a, b), F.lit(False)), "boolean"
        same = a.eqNullSafe(b)
        return (same if name == "==" else ~same), "boolean"

    def _among(self, value: Any, choices: Any) -> tuple[Column, str]:
        column, kind = self.value(value)
        if not (isinstance(choices, (list, tuple)) and len(choices) == 2 and choices[0] == "literal" and isinstance(choices[1], (list, tuple)) and all(type(c) in _PLAIN for c in choices[1])):
            raise ValueError(f"in looks in a literal list, not in {choices!r}")
        _one_kind([kind, *(_PLAIN[type(c)] for c in choices[1])], "in")
        known = [c for c in choices[1] if c is not None]
        found = F.coalesce(column.isin(known), F.lit(False)) if known else F.lit(False)
        return (found | column.isNull() if len(known) < len(choices[1]) else found), "boolean"


def filter_condition(tree: Any, schema: T.StructType) -> Column:
    """The condition of ``tree`` on rows of ``schema``."""
    return _Compiler(schema).condition(tree)


def filter_counts(df: DataFrame, trees: dict[str, Any], year: str = "pub_year") -> DataFrame:
    """name, n: how many rows each tree shows, in one pass; a row without a year is never counted, whatever a tree says."""
    counts = F.array(*(F.struct(F.lit(n).alias("name"), F.count_if(filter_condition(t, df.schema) & F.col(year).isNotNull()).alias("n")) for n, t in trees.items()))
    if not trees:
        return df.sparkSession.createDataFrame([], "name string, n long")
    return df.agg(counts.alias("_c")).select(F.inline("_c"))
