"""A small filter language compiled to columns: clauses `name op value` joined by ` and `.

Operators: >= <= != == > <. Values: true or false, a whole number, a decimal number, or text, quoted or not. A null never
passes, not even `!=`. NaN compares as in IEEE arithmetic: it passes `!=` and nothing else. An empty expression passes all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAUSE = re.compile(r"(?P<name>\w+)\s*(?P<op>>=|<=|!=|==|>|<)\s*(?P<value>.+)", re.DOTALL)
_COMPARE = {
    ">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__,
}


def literal(text: str) -> bool | int | float | str:
    if text in ("True", "true", "False", "false"):
        return text in ("True", "true")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip("'\"")


def compile_filter(expression: str | None, types: dict[str, str]) -> Column:
    """`types`: the table's column types by name; an unknown column or a clause that isn't one is a ValueError, as is ` or `,
    which would otherwise be read as part of a value."""
    condition = F.lit(True)
    if not expression or not expression.strip():
        return condition
    if " or " in expression:
        raise ValueError("`or` is not part of the filter language")
    for clause in expression.split(" and "):
        m = _CLAUSE.match(clause.strip())
        if not m:
            raise ValueError(f"not a clause: {clause!r}")
        if m["name"] not in types:
            raise ValueError(f"no column {m['name']!r}")
        column = F.col(f"`{m['name']}`")
        passes = _COMPARE[m["op"]](column, F.lit(literal(m["value"].strip())))
        if types[m["name"]] in ("double", "float"):
            passes = (F.isnan(column) | passes) if m["op"] == "!=" else (~F.isnan(column) & passes)
        condition = condition & column.isNotNull() & passes
    return condition


def where(table: DataFrame, expression: str | None) -> DataFrame:
    return table.where(compile_filter(expression, dict(table.dtypes)))
