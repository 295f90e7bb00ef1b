"""Batch translation by a pluggable callable, with repair and bounded retries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitextra.functions.numeric import drift_of, numeric_tokens, protect, registry, repair, restore
from bitextra.functions.text import leftover_source
from bitextra.operators.batching import BATCH_SIZE, assign_batches
from bitextra.operators.containment import fits_broadcast
from bitextra.operators.ranking import join_null_safe
from bitextra.operators.responses import DELIVERY_THRESHOLD, parse_columns, response_columns
from bitextra.operators.units import missing_units
from bitextra.session import cut_lineage, cut_parts, drop_folders, read_parts, shuffles_go

# Limits of splitting and gap filling.
MAX_SPLIT_DEPTH = 3
GAP_FILL_ROUNDS = 2
GAP_FILL_BATCH = 10
# A document is short while its indexes stay below those of so many full batches.
SHORT_BATCHES = 20

UNIT = ["doc_id", "unit_idx"]
Model = Callable[[str], str]


def call_tasks(spark: SparkSession) -> int:
    """Tasks that calls are dealt out over: four per core, and no fewer than a shuffle of the session has."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def call_model(batches: DataFrame, fn: Model, tasks: int | None = None) -> DataFrame:
    """One call per payload row (U1): adds ``response`` and ``error``, an exception becomes an error.

    The callable gets the JSON payload and returns the model's raw text; no
    other column travels to it. Calls are dealt out over ``tasks`` tasks
    (default: ``call_tasks``). A task that is lost repeats the calls it had
    made; finished rounds are read from files.
    """
    return _answers(batches.repartition(tasks or call_tasks(batches.sparkSession), "doc_id", "batch_id"), fn)


def _answers(batches: DataFrame, fn: Model) -> DataFrame:
    @F.pandas_udf("response STRING, error STRING")
    def ask(payloads: pd.Series) -> pd.DataFrame:
        answers = []
        for payload in payloads:
            try:
                answers.append((fn(payload), None))
            except Exception as exc:  # noqa: BLE001 - a failed batch loses only itself
                answers.append((None, f"{type(exc).__name__}: {exc}"))
        return pd.DataFrame(answers, columns=["response", "error"], dtype=object)

    # Not deterministic: one evaluation, however often the answer is used.
    return (
        batches.withColumn("_answer", ask.asNondeterministic()("payload"))
        .select(*batches.columns, "_answer.response", "_answer.error")
    )


def post_process(
    delivered: DataFrame, source: str = "text", output: str = "output", source_lang: str | None = "ru"
) -> DataFrame:
    """Verdict per delivered unit (U4): ``final`` text, or null when it must be retried.

    Numeric placeholders are restored, drift is verified and repaired; what
    stays unresolved, or leaves source-language text behind, fails. Row-local.
    """
    return _apply(delivered, _checks(source, output, source_lang))


def _checks(source: str, output: str, source_lang: str | None) -> list[tuple[str, Column]]:
    """The columns of the verdict in order; built once and used in every round."""
    leftover = leftover_source(F.col("_r.text")) if source_lang == "ru" else F.lit(False)
    return [
        ("_restored", restore(F.col(output), registry(F.col(source)))),
        ("_s", numeric_tokens(F.col(source))),
        ("_d", drift_of(F.col("_s"), numeric_tokens(F.col("_restored")))),
        ("_r", repair(F.col("_restored"), F.col("_d"), F.col("_s"))),
        ("final", F.when((F.col("_r.unresolved") == 0) & ~leftover, F.col("_r.text"))),
    ]


def _apply(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    for name, column in columns:
        df = df.withColumn(name, column)
    return df.drop("_restored", "_s", "_d", "_r")


class _Round:
    """Expressions shared by all rounds of one translation."""

    def __init__(self, source_lang: str | None):
        self.parse = response_columns("response")
        self.checks = _checks("_asked", "output", source_lang)


def _first_batches(units: DataFrame, size: int) -> DataFrame:
    """The batches of a translation, dealt out over the tasks that call.

    Texts of short documents are shuffled once: all batches of one go to the
    same task, ranked there. Long ones are ranked by their keys alone and
    dealt out batch by batch.
    """
    spark = units.sparkSession
    base = units.select(*UNIT, "unit_id", "text", "context")
    tasks = call_tasks(spark)
    with shuffles_go(spark):
        far = cut_lineage(
            units.filter(F.col("unit_idx") >= SHORT_BATCHES * size).select(F.col("doc_id").alias("_long")).distinct()
        )
        # A row stands for so many indexes at least: the list stays a small share of the units.
        far = F.broadcast(far) if fits_broadcast(far) else far
    is_long = F.col("doc_id").eqNullSafe(F.col("_long"))
    place = Window.partitionBy("doc_id").orderBy("unit_idx")
    short = (
        base.join(far, is_long, "left_anti").repartition(tasks, "doc_id")
        .withColumn("batch_id", F.floor((F.row_number().over(place) - 1) / size) + 1)
        .withColumn("batch_id", F.col("batch_id").cast("string"))
    )
    # One row a key, so that units sharing one are neither lost nor multiplied.
    long = base.join(far, is_long, "left_semi")
    numbers = assign_batches(long.select(*UNIT), size).groupBy(*UNIT).agg(
        F.min("batch_id").cast("string").alias("batch_id")
    )
    numbered = join_null_safe(long, numbers, UNIT).repartition(tasks, "doc_id", "batch_id")
    return _batches(short).unionByName(_batches(numbered))


def _batches(dealt: DataFrame) -> DataFrame:
    """Open batches with their units in order and the payload of each, numbers protected.

    The units are in the task that makes the call; the groups are not shuffled again.
    """
    unit = F.struct("unit_idx", "unit_id", "text", "context")
    return (
        dealt.groupBy("doc_id", "batch_id")
        .agg(F.array_sort(F.collect_list(unit)).alias("units"))
        .withColumn("n_units", F.size("units").cast("long"))
        .withColumn(
            "payload",
            F.to_json(
                F.transform(
                    "units",
                    lambda u: F.struct(u["unit_id"].alias("id"), protect(u["text"]).alias("text"), u["context"]),
                )
            ),
        )
    )


def _round(batches: DataFrame, fn: Model, steps: _Round, last: bool) -> DataFrame:
    """One call of every open batch: its units, each with the ``state`` it is left in.

    ``done`` units have their text and status; ``open`` ones, unless this is
    the ``last`` round, the name of their next batch: half of a split batch or
    the one retry batch of the others. A batch is named by the path from its
    root batch, so no two ever share a name. ``lost`` units are left without a
    text. All of it is found within the row of the batch.
    """
    ratio = F.size("items") / F.col("n_units")
    answers = (
        parse_columns(_answers(batches, fn), steps.parse)
        .withColumn(
            "action",
            F.when(F.col("error").isNotNull(), "lost")
            .when(F.col("items").isNull(), F.when(F.col("n_units") > 1, "split").otherwise("lost"))
            .when((ratio < DELIVERY_THRESHOLD) & (F.col("n_units") > 1), "split")
            .otherwise("deliver"),
        )
        # Of several answers for a unit the last counts.
        .withColumn("_items", F.when(F.col("action") == "deliver", F.reverse("items")))
        .withColumn("_ids", F.transform("_items", lambda x: x["id"]))
    )

    def answered(u: Column, i: Column) -> Column:
        at = F.array_position(F.col("_ids"), u["unit_id"])
        return F.struct(
            *[u[c].alias(c) for c in ("unit_idx", "unit_id", "text", "context")],
            (i < F.floor(F.col("n_units") / 2)).alias("_first"),
            F.get(F.col("_items"), (at - 1).cast("int"))["text"].alias("output"),
        )

    # The outer form: no filter on the array repeats what it is made from.
    rows = answers.select("doc_id", "batch_id", "action", F.inline_outer(F.transform("units", answered)))
    checked = _apply(
        rows.withColumn("_asked", F.when(F.col("output").isNotNull(), F.col("text"))), steps.checks
    )
    delivered, split = F.col("action") == "deliver", F.col("action") == "split"
    if last:
        state = F.when(delivered & F.col("output").isNotNull(), "done").otherwise("lost")
    else:
        state = F.when(delivered | split, "open").otherwise("lost")
    half = F.when(F.col("_first"), "/1").otherwise("/2")
    left = checked.withColumn("state", F.when(F.col("final").isNotNull(), "done").otherwise(state))
    going = F.col("state") != "done"
    return left.select(
        *UNIT, F.coalesce("final", "text").alias("text"),
        F.when(F.col("final").isNotNull(), "translated").when(~going, "source_fallback").alias("status"),
        F.when(going, F.col("unit_id")).alias("unit_id"),
        F.when(going, F.col("context")).alias("context"),
        F.when(going, F.concat("batch_id", F.when(split, half).otherwise("/r"))).alias("batch_id"),
        "state",
    )


def _rounds(
    units: DataFrame, fn: Model, batch_size: int, max_depth: int, steps: _Round
) -> tuple[list[str], list[str]]:
    """Folders of the units that have a text, and of those left without one.

    Each round writes its units once. The open ones are dropped when the next
    round is written, so at most two rounds' texts and the finished ones lie
    in the shared folder.
    """
    spark = units.sparkSession
    kinds = dict(units.dtypes)
    schema = ", ".join(
        f"{c} {kinds.get(c, 'string')}" for c in (*UNIT, "unit_id", "text", "context", "batch_id")
    )
    batches, done, lost, before = _first_batches(units, batch_size), [], [], []
    for depth in range(max_depth + 1):
        parts = cut_parts(_round(batches, fn, steps, depth == max_depth), "state")
        drop_folders(spark, before)
        done += parts.get("done", [])
        lost += parts.get("lost", [])
        before = parts.get("open", [])
        if not before:
            break
        batches = _batches(
            read_parts(spark, before, schema).repartition(call_tasks(spark), "doc_id", "batch_id")
        )
    return done, lost


def _results(units: DataFrame, done: list[str]) -> DataFrame:
    kinds = dict(units.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*UNIT, "text")) + ", status string"
    return read_parts(units.sparkSession, done, schema)


def _lost(units: DataFrame, lost: list[str]) -> DataFrame:
    kinds = dict(units.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*UNIT, "unit_id", "text", "context"))
    return read_parts(units.sparkSession, lost, schema)


def translate_units(
    units: DataFrame,
    fn: Model,
    batch_size: int = BATCH_SIZE,
    source_lang: str | None = "ru",
    max_depth: int = MAX_SPLIT_DEPTH,
    steps: _Round | None = None,
) -> DataFrame:
    """Translate units batch by batch.

    ``units``: doc_id, unit_idx, unit_id, text, context. A response that does
    not parse or delivers less than 75 % splits its batch in half, a smaller
    gap or a failed check sends the units again; both up to ``max_depth``
    times. Every round handles all open batches at once. The units of a round
    are written to the shared folder when it ends: later losses repeat no call
    of it, a task lost within the round repeats its own. Returns doc_id,
    unit_idx, text, status (translated / source_fallback); units of batches
    that kept failing have no row. A batch that exceeds the depth loses only
    its own units.
    """
    done, lost = _rounds(units, fn, batch_size, max_depth, steps or _Round(source_lang))
    drop_folders(units.sparkSession, lost)
    return _results(units, done)


def _fill(
    units: DataFrame, lost: list[str], fn: Model, rounds: int, batch_size: int, steps: _Round
) -> DataFrame:
    """The units in the folders ``lost`` sent again in ``rounds``; the rest falls back to the source."""
    done: list[str] = []
    for _ in range(rounds):
        if not lost:
            break
        more, left = _rounds(_lost(units, lost), fn, batch_size, MAX_SPLIT_DEPTH, steps)
        drop_folders(units.sparkSession, lost)
        done, lost = done + more, left
    rest = _lost(units, lost).select(*UNIT, "text", F.lit("source_fallback").alias("status"))
    return _results(units, done).unionByName(rest)


def gap_fill(
    units: DataFrame,
    delivered: DataFrame,
    fn: Model,
    rounds: int = GAP_FILL_ROUNDS,
    batch_size: int = GAP_FILL_BATCH,
    source_lang: str | None = "ru",
) -> DataFrame:
    """Send missing units again in small batches, then fall back to the source."""
    missing = missing_units(units, delivered).select(*UNIT, "unit_id", "text", "context")
    lost = cut_parts(missing.withColumn("state", F.lit("lost")), "state").get("lost", [])
    filled = _fill(units, lost, fn, rounds, batch_size, _Round(source_lang))
    return delivered.unionByName(filled.select(delivered.columns))


def translate_and_fill(
    units: DataFrame,
    fn: Model,
    batch_size: int = BATCH_SIZE,
    source_lang: str | None = "ru",
    rounds: int = GAP_FILL_ROUNDS,
    gap_batch: int = GAP_FILL_BATCH,
) -> DataFrame:
    """``translate_units`` and ``gap_fill`` in one: every unit once, as translated or as its source.

    The rounds themselves name the units they lose, so results and units are
    not compared.
    """
    steps = _Round(source_lang)
    done, lost = _rounds(units, fn, batch_size, MAX_SPLIT_DEPTH, steps)
    return _results(units, done).unionByName(_fill(units, lost, fn, rounds, gap_batch, steps))
