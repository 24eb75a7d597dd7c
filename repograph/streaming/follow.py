"""Facts of files as they arrive in a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import extract
from ..sources.scan import described

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path (below folder), language, text, hash, size_bytes. Names that begin with _ or . are passed over; so is a later change of a file."""
    raw = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    below = re.escape(re.sub("^file:/*", "/", folder).rstrip("/"))
    return described(raw.select(F.regexp_replace("path", f"^(?:[a-z]+:)?/*?{below}/", "").alias("path"), "content"))


def follow(spark: SparkSession, folder: str, facts: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the facts of each new file below folder to the table at facts, exactly once; with once, ends when what is there is done.

    Files are independent, so there is neither state nor a shuffle.
    """
    writer = extract(arriving_files(spark, folder)).writeStream.format("parquet").option("path", facts).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
