"""Text metrics as column expressions; lengths and distances count code points."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Dialect


@F.pandas_udf(T.IntegerType())
def _distance_utf16(a: pd.Series, b: pd.Series) -> pd.Series:
    def distance(x, y):
        x, y = (memoryview((t or "").encode("utf-16-le")).cast("H").tolist() for t in (x, y))
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        return row[-1]

    return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="int32")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def accuracy(prediction: Column, truth: Column, dialect: Dialect = Dialect()) -> Column:
    """(1 - distance / longer length) in percent; an empty side gives 0 (both: 100 where the dialect says so)."""
    p, t = F.coalesce(prediction, F.lit("")), F.coalesce(truth, F.lit(""))
    units = (lambda x: F.octet_length(F.encode(x, "UTF-16LE")) / 2) if dialect.accuracy_utf16 else F.length
    d = _distance_utf16(p, t) if dialect.accuracy_utf16 else F.levenshtein(p, t)
    value = (F.lit(1.0) - d / F.greatest(units(p), units(t))) * 100.0
    if dialect.accuracy_decimals is not None:
        value = F.round(value, dialect.accuracy_decimals)
    both = F.when((p == "") & (t == ""), F.lit(100.0 if dialect.both_empty_is_right else 0.0))
    return both.when((p == "") | (t == ""), F.lit(0.0)).otherwise(value).cast("double")


def cer(prediction: Column, truth: Column) -> Column:
    """Distance over the truth's length; of an empty truth 0 if the prediction is empty too, else 1."""
    p, t = F.coalesce(prediction, F.lit("")), F.coalesce(truth, F.lit(""))
    return F.when(t == "", F.when(p == "", F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(p, t) / F.length(t)).cast("double")


def tile_count(scaled_width: Column, width: int = 1024) -> Column:
    return F.greatest(F.lit(1), F.ceil(scaled_width / width)).cast("int")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def mask_checksum(position: Column, ink: Column, modulus: int) -> Column:
    """Aggregate: the sum of the places of ink, counted from one, by a modulus."""
    return F.sum(F.when(ink > 0, position + 1).otherwise(0)) % modulus
