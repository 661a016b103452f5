"""Greedy decoding of per-step class scores, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(logits: Column, seq_len: Column | int, classes: int) -> Column:
    """A flat array of scores as an array of steps."""
    n = F.lit(seq_len) if isinstance(seq_len, int) else seq_len
    return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.slice(logits, t * classes + 1, classes))


def is_sound(logits: Column, seq_len: Column | int, classes: int) -> Column:
    """Of the declared size, with a step at least, and finite; else false."""
    n = F.lit(seq_len) if isinstance(seq_len, int) else seq_len
    bad = F.exists(logits, lambda v: F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")))
    return F.coalesce((n > 0) & (F.size(logits) == n * classes) & ~bad, F.lit(False))


def argmax(scores: Column) -> Column:
    """The class of the highest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def path(logits: Column, seq_len: Column | int, classes: int) -> Column:
    return F.transform(steps(logits, seq_len, classes), argmax)


def collapse(classes: Column) -> Column:
    """A path without repeats and blanks; a blank between equal classes keeps both."""
    return F.filter(classes, lambda c, i: (c != 0) & ((i == 0) | (c != F.get(classes, i - 1))))


def text(classes: Column, charset: Column | str) -> Column:
    """Characters of a collapsed path: class 1 is the first of the charset. A class beyond it raises."""
    chars = F.lit(charset) if isinstance(charset, str) else charset
    n = F.length(chars)
    ok = F.forall(classes, lambda c: (c >= 1) & (c <= n))
    joined = F.array_join(F.transform(classes, lambda c: F.substring(chars, c, F.lit(1))), "")
    return F.when(ok, joined).otherwise(F.raise_error(F.lit("a class is beyond the charset")).cast("string"))


def greedy(logits: Column, seq_len: Column | int, classes: int, charset: Column | str) -> Column:
    """Text of a flat score array; unsound scores raise, and are looked at before any class is chosen."""
    good = is_sound(logits, seq_len, classes)
    return F.when(good, text(collapse(path(logits, seq_len, classes)), charset)).otherwise(F.raise_error(F.lit("scores of a wrong size or not finite")).cast("string"))
