"""The common row of all rules: path, rule_id, message, line, column, end_line, end_column, confidence, suggestion, place.

place orders a rule's findings inside a document. Every rule is a column: an array of issue() structs made from one line, one
sentence or one document, so that any number of rules costs one scan and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkgauge.functions.text import flat, kept

ISSUE = "struct<rule_id:string,message:string,line:int,column:int,end_line:int,end_column:int,confidence:string,suggestion:string,place:array<int>>"
NONE = f"cast(array() as array<{ISSUE}>)"
COLUMNS = ["path", "rule_id", "message", "line", "column", "end_line", "end_column", "confidence", "suggestion", "place"]


def _col(value: Column | str | int | None, kind: str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


def issue(rule: str, message: Column | str, line: Column, column: Column | int, end_column: Column | None = None, end_line: Column | None = None, confidence: Column | str = "medium", suggestion: Column | str | None = None, place: tuple = ()) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"),
        _col(message, "string").alias("message"),
        _col(line, "int").alias("line"),
        _col(column, "int").alias("column"),
        _col(end_line, "int").alias("end_line"),
        _col(end_column, "int").alias("end_column"),
        _col(confidence, "string").alias("confidence"),
        _col(suggestion, "string").alias("suggestion"),
        F.array(*(_col(p, "int") for p in place or (line, column))).alias("place"),
    )


def quoted(label: str, text: Column, after: str = "") -> Column:
    return F.concat(F.lit(f"{label}: '"), text, F.lit(f"'{after}"))


def none() -> Column:
    return F.expr(NONE)


def only_if(condition: Column, issues: Column) -> Column:
    return F.when(condition, issues).otherwise(none())


def rows(items: Column, one: Callable[[Column], Column]) -> Column:
    """An issue for each item; one() may give null for none."""
    return kept(F.transform(items, one))


def of_each(items: Column, many: Callable[[Column], Column]) -> Column:
    """The issues of each item, together."""
    return flat(F.transform(items, many))
