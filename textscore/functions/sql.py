"""The measures as functions of Spark SQL, made from their own expressions.

A registered measure becomes a temporary SQL function of one STRING argument, whose body is the text of the
measure's expression. Queries that call it are planned as with the Column form: no Python
worker, no second definition.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .registry import measure, names

#: Parts of an expression's text: strings and quoted names as they are, doubles, and calls of operators.
_PARTS = re.compile(
    r"(?P<kept>'(?:[^'\\]|\\.)*'|`[^`]*`)"
    r"|(?P<double>(?<![\w.])\d+\.\d+(?:E-?\d+)?(?![\w.]))"
    r"|(?P<call>(?:[-+*/%<>=!&|^~]+|\b(?:rlike|like|ilike|and|or|not|in|div))(?=\())",
    re.DOTALL | re.IGNORECASE,
)


def sql_text(expression: Column) -> str:
    """The expression as SQL that parses back to it."""

    def write(part: re.Match) -> str:
        if part["double"]:
            return part[0] + "D"  # else it would be a decimal
        if part["call"]:
            return f"`{part[0]}`"  # an operator in the place of a function's name
        return part[0]

    return _PARTS.sub(write, expression._jc.node().sql())


def register_sql(spark: SparkSession, wanted: Iterable[str] | None = None, prefix: str = "") -> list[str]:
    """Make measures of the registry, all by default, temporary functions of the session; returns their names.

    A measure that is no native expression, such as a user's pandas UDF, raises.
    """
    made = []
    empty = spark.range(0).select(F.lit(None).cast("string").alias("text"))
    for name in names() if wanted is None else wanted:
        value = measure(name)(F.col("text"))
        probe = empty.select(value.alias("v"))
        if "PythonUDF" in probe._jdf.queryExecution().analyzed().toString() or "pythonUDF" in probe._jdf.queryExecution().optimizedPlan().toString():
            raise ValueError(f"measure {name!r} runs in Python and has no SQL text")
        kind = probe.schema["v"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{prefix}{name}`(text STRING) RETURNS {kind} RETURN {sql_text(value)}")
        made.append(prefix + name)
    return made
