"""Reading files as they arrive in a directory."""

from pyspark.sql import DataFrame, SparkSession

from ..plans.read import Engine
from ..sources import files

FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, where: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).load(where)


def line_stream(engine: Engine, where: str) -> DataFrame:
    """Lines of the images of a directory, appended file by file; no state is kept."""
    found = file_stream(engine.spark, where)
    wanted = files.extension(found["path"]).isin(*engine.dialect.extensions)
    return engine.lines(files.pages(found.where(wanted)))
