"""Charsets: an ordered string whose i-th character is class i + 1."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ContractError


def normalise(text: Column | str):
    """Without line ends around it; spaces stay, the first character may be one."""
    return text.strip("\r\n") if isinstance(text, str) else F.regexp_replace(text, r"^[\r\n]+|[\r\n]+$", "")


def resolve(explicit: str | None, published: str | None, bundled: str | None) -> str:
    """The charset to use: the given one, else that beside the weights, else the bundled one."""
    for text in (explicit, published, bundled):
        if text is not None:
            chars = normalise(text)
            if not chars:
                raise ContractError("an empty charset")
            return chars
    raise ContractError("no charset")


def table(spark: SparkSession, chars: str) -> DataFrame:
    """(cls, ch)."""
    one = spark.createDataFrame([(normalise(chars),)], "chars string")
    return one.select(F.posexplode(F.split("chars", "")).alias("cls", "ch")).select((F.col("cls") + 1).alias("cls"), "ch")


def index(text: Column) -> Column:
    """An array of (cls, ch) structs of a charset column."""
    return F.transform(F.split(normalise(text), ""), lambda c, i: F.struct((i + 1).alias("cls"), c.alias("ch")))
