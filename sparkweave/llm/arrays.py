"""Column expressions over arrays in time proportional to the array: bound values and running states."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once; inside lambdas an expression is else evaluated for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chunks(items: Column) -> Column:
    """The array in pieces of CHUNK elements; an empty array is one empty piece."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))


def scan(items: Column, start: Column, state: Callable, emit: Callable, kind: str) -> Column:
    """What emit(state, item), an array of `kind`, gives for each item in order; state(state, item) is the next state.

    Appending to an array copies it, so pieces of CHUNK elements are scanned on their own and put together at the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def step(a, x):
        return F.struct(state(a["s"], x).alias("s"), F.concat(a["out"], emit(a["s"], x)).alias("out"))

    def piece(a, c):
        inner = F.aggregate(c, F.struct(a["s"].alias("s"), none.alias("out")), step)
        return let(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return let(items, lambda i: F.flatten(F.aggregate(chunks(i), zero, piece, lambda a: a["out"])))
