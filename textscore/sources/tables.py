"""Declared schemas, readers that check them, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import ALL_METRICS


# Texts come back as they were: quotes are doubled inside a field, blanks are kept.
_CSV_EXACT = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# Characters that end a line of a file, and their escapes.
_BREAKS = {"\n": "n", "\r": "r"}


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_TEXTS = T.ArrayType(T.StringType())

BASIC_INFO = T.StructType(_strings("id", "strategy", "department", "category"))
ANSWER = T.StructType(_strings("id", "answer", "human_answer"))
NLI_INFO = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fact_ai_list", _TEXTS),
        T.StructField("fact_human_str", T.StringType()),
        T.StructField("rec_ai_list", _TEXTS),
        T.StructField("rec_human_str", T.StringType()),
    ]
)
REASONING_INFO = T.StructType(_strings("id", "reasoning_dict"))


def metric_schema(metrics: Sequence[str] = ALL_METRICS, id_type: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [T.StructField("id", id_type or T.StringType())] + [T.StructField(m, T.DoubleType()) for m in metrics]
    )


class MissingTable(FileNotFoundError):
    """An input table is not where the caller said."""


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere; a NaN of an outside writer becomes one on read."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})


def one_line(text: Column) -> Column:
    """``text`` without line breaks: a backslash, LF and CR become two characters that begin with a backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in _BREAKS.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    return out


def many_lines(text: Column) -> Column:
    """The text that :func:`one_line` was given."""
    out = text
    for char, name in _BREAKS.items():
        # the sign counts where an even number of backslashes stands before it
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*+)\\{name}", "$1" + char)
    out = F.replace(out, F.lit("\\\\"), F.lit("\\"))
    return F.when(text.contains("\\"), out).otherwise(text)


def _each_string(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: change(F.col(c)) for c in strings}) if strings else df


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet", escaped: bool | None = None, **options
) -> DataFrame:
    """Read a table with its declared schema; only the columns later used are scanned.

    A CSV file is read line by line, so that many tasks share a large one, and line breaks
    that :func:`write_table` escaped come back; ``escaped=False`` takes backslashes as they
    are. ``multiLine=True`` is for files of other writers with line breaks inside quotes: one task per
    file, nothing escaped. A path that does not exist raises :class:`MissingTable`, before any job runs.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.options(**{"header": True, **_CSV_EXACT, **options})
        escaped = not options.get("multiLine") if escaped is None else escaped
    if schema is not None:
        reader = reader.schema(schema)
    try:
        table = nan_to_null(reader.load(path))
        return _each_string(table, many_lines) if escaped else table
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingTable(f"no table at {path}") from error
        raise


def load_evaluation(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """The four input tables by name: basic_info, answer, nli_info, reasoning_info."""
    schemas = {"basic_info": BASIC_INFO, "answer": ANSWER, "nli_info": NLI_INFO, "reasoning_info": REASONING_INFO}
    return {name: read_table(spark, paths[name], schema, fmt) for name, schema in schemas.items()}


def load_analysis(spark: SparkSession, basic_info: str, metrics: str, fmt: str = "parquet") -> DataFrame:
    """Dimensions with their normalised metrics: every scenario stays, scored or not."""
    dims = read_table(spark, basic_info, fmt=fmt)
    return dims.join(read_table(spark, metrics, fmt=fmt), "id", "left")


def flat_columns(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text, for formats that only hold scalars."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return reduce(lambda d, c: d.withColumn(c, F.to_json(c)), nested, df)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()
) -> None:
    """Write as parquet, orc, json or csv, optionally one folder per ``partition_by`` value.

    CSV holds a row per line: line breaks and backslashes of texts are escaped, so that a large file can
    be split. It has no sign for an empty text, which reads back as NULL and scores the same.
    The rows stay where they are: a partition value that holds most rows is written
    by many tasks.
    """
    out = _each_string(flat_columns(df), one_line) if fmt == "csv" else df
    writer = out.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(header=True, emptyValue='""', **_CSV_EXACT)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
