"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from followgraph.sources.scratch import scratch_folder as folder
from followgraph.sources.scratch import shuffles_dropped


def stored(df: DataFrame, place: str | None = None) -> DataFrame:
    """``df``, written as Parquet and read back."""
    place = place or folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
