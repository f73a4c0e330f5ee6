"""The stateless measures on streams, and a rolling quality index over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import MetricNormalizerModel
from ..plans.reference_free import reference_free_metrics


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", name: str | None = None, **options
) -> DataFrame:
    """Files of ``folder`` as they arrive; ``name`` is a glob that picks one table's files."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.load(folder)


def score_stream(answers: DataFrame, model: MetricNormalizerModel | None = None) -> DataFrame:
    """Reference-free measures of a stream of answers, normalised by a frozen model if given."""
    scored = reference_free_metrics(answers)
    return model.transform(scored) if model is not None else scored


def rolling_index(
    stream: DataFrame,
    time_col: str,
    value: str,
    by: str,
    width: str = "1 hour",
    slide: str | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Mean of ``value`` per group and time window; rows later than ``lateness`` are dropped.

    State holds one sum and count per open window and group.
    """
    span = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    grouped = stream.withWatermark(time_col, lateness).groupBy(span.alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "mean_value"
    )


def session_index(
    stream: DataFrame, time_col: str, value: str, by: str, gap: str = "30 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """As :func:`rolling_index`, over sessions that end after ``gap`` without a row."""
    grouped = stream.withWatermark(time_col, lateness).groupBy(F.session_window(time_col, gap).alias("w"), by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n", "mean_value"
    )


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append all input at hand to files under ``path``, then stop; a restart goes on from the checkpoint."""
    query = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
