"""Packages converted as they arrive, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILE = "path string, modificationTime timestamp, length long, content binary"


def watched_packages(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).load(folder)


def converted_stream(files: DataFrame, convert: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs `convert` (decoded packages -> rows with sha256) over new files and appends what `target` does not hold.

    A file seen again, or a copy of one, has a digest that is there already. A batch run again after a
    failure finds its own rows and adds nothing, so restarts are safe.
    """
    from quire.sources.packages import decoded

    def batch(frame: DataFrame, number: int) -> None:
        packages = decoded(frame).dropDuplicates(["sha256"])
        spark = frame.sparkSession
        try:
            known = spark.read.parquet(target).select("sha256").distinct()
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            packages = packages.join(known, "sha256", "left_anti")
        convert(packages).write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
