"""Features and fitted models on streams: each row is scored on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stylomill.functions import text as X


def read_documents(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(docs: DataFrame, model=None, text: str = "text") -> DataFrame:
    """docs with the features and, if there is one, a fitted model's columns."""
    rows = X.with_features(docs, text)
    return model.transform(rows) if model is not None else rows


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, each row once; with once, until what is there has been read."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
