"""Column helpers for spans within a text: bound values, running folds, match places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix sums run in blocks of this many values, so that long lists stay near linear.
RUN = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over all values (array<int>) before each position."""

    def prefix(items: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(
            items,
            begin,
            lambda acc, x: F.struct(
                op(acc["at"], x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")
            ),
            lambda acc: acc["all"],
        )

    def over_blocks(blocks: Column) -> Column:
        starts = prefix(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero)
        zipped = F.zip_with(blocks, starts, lambda b, s: F.struct(b.alias("b"), s.alias("s")))
        return F.flatten(F.transform(zipped, lambda z: prefix(z["b"], z["s"])))

    def cut(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * RUN + 1, RUN))

    return let(
        values,
        lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(
            let(cut(v), over_blocks)
        ),
    )


def places(
    text: Column, pattern: Column, measure: Callable[[Column], Column], make: Callable[..., Column]
) -> Column:
    """``make(start, length, match, piece before, piece after)`` of the leftmost matches of ``pattern``.

    Positions are sums of ``measure`` (characters, words) over matches and the
    pieces between them; text is scanned twice, whatever the number of matches.
    """

    def located(b: Column) -> Column:
        sizes = F.transform(
            b["m"],
            lambda m, i: F.struct(
                measure(F.get(b["p"], i)).alias("p"), measure(m).alias("m"), m.alias("t"),
                F.get(b["p"], i).alias("b"), F.get(b["p"], i + 1).alias("a"),
            ),
        )
        return let(
            sizes,
            lambda s: F.zip_with(
                s,
                running(F.transform(s, lambda x: x["p"] + x["m"]), F.lit(0), lambda x, y: x + y),
                lambda x, at: make(at + x["p"], x["m"], x["t"], x["b"], x["a"]),
            ),
        )

    both = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")
    )
    return let(both, located)
