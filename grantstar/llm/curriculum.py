"""Mixing sources to target weights along a time-varying curriculum, with built-in functions only.

Each source has a weight schedule: straight lines between knots over training time 0 to 1. The integral of
the schedule is the source's weight, from which follow its target share of all words and so how often
its documents are repeated. The running integral is the source's cumulative demand; inverting it at the
number of words in front of a document gives that document's training position.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import fsum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantstar.llm.common import stored, words

Schedule = Sequence[tuple[float, float]]

#: Schedules dealt to the sources in order, again and again: integrals 5, 2 and 1. Heavy sources come
#: early, light ones late.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: No document is taken more often than this.
MAX_REPEATS = 3
#: Documents whose running sum one window works out; sums of such runs are added up before.
RUN_ROWS = 4096

_HASH_SPAN = float(1 << 60)


def integral(schedule: Schedule) -> float:
    """The area under the lines between the knots."""
    return fsum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:]))


def inverted(schedule: Schedule, share: Column) -> Column:
    """The time at which ``share`` (0 to 1) of the schedule's integral is reached."""
    whole, below, out = integral(schedule), 0.0, F.lit(1.0)
    pieces = []
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        piece = (b - a) * (v + w) / 2 / whole
        g, slope = v / whole, (w - v) / whole / (b - a)
        rest = F.greatest(share - below, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(g * g) + 2 * slope * rest, F.lit(0.0)))
        pieces.append((below + piece, F.lit(a) + F.when(rest == 0, F.lit(0.0)).otherwise(2 * rest / (g + root))))
        below += piece
    for upto, time in reversed(pieces):
        out = F.when(share < upto, time).otherwise(out)
    return out


def source_targets(
    sources: DataFrame, weights: Sequence[float], max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``sources`` (source, source_size) with turn, weight and target.

    Sources in code point order, null last, take the weights in turn. Together the targets are all words.
    A source above ``max_repeats`` times its size is held there and the excess reshared by weight: ordered
    by limit / weight, the held ones come first, so running sums find the level in one go. One row for each
    source is all this sees.
    """
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("turn") + 1)
    df = sources.withColumn("turn", turn.cast("int")).withColumn("weight", weight)
    df = df.withColumn("most", F.lit(float(max_repeats)) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    df = df.withColumn("level", left / F.sum("weight").over(after))
    held = F.col("most") < F.col("weight") * F.col("level")
    df = df.withColumn("held", held)
    level = F.min(F.when(~F.col("held"), F.struct(F.col("most") / F.col("weight"), "level"))).over(
        Window.partitionBy(F.lit(1))
    )
    target = F.when(F.col("held"), F.col("most")).otherwise(F.col("weight") * level["level"])
    return df.withColumn("target", target).select("source", "source_size", "turn", "weight", "target")


def _size() -> Column:
    return F.size(words(F.col("text"))).cast("long")


def mixed_keys(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``mixed`` with one row for all rows that agree in doc_id, source and size; ``rows`` is their number."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15)
    turned = F.conv(digits, 16, 10).cast("long")
    sized = docs.select("doc_id", "source", _size().alias("size"), turned.alias("turned"))
    rows = stored(
        sized.groupBy("doc_id", "source", "size", "turned").agg(F.count("*").alias("rows")), "sizes"
    )
    sources = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_keys")
    )
    sources = stored(sources, "sources")
    weights = [integral(s) for s in schedules]
    targets = source_targets(sources.drop("n_keys"), weights, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("passes", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "plan_source")
    plan = plan.join(sources.select("source", "n_keys"), F.col("source").eqNullSafe(F.col("plan_source")))
    plan = plan.withColumn("runs", F.ceil(F.col("n_keys") / RUN_ROWS)).drop("source", "n_keys")
    plan = stored(plan, "plan")

    run = F.floor(F.col("turned").cast("double") * F.col("runs") / _HASH_SPAN)
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    dealt = dealt.withColumn("run", run).withColumn("words", F.col("size") * F.col("rows")).drop("plan_source")
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "run").agg(F.sum("words").alias("run_words"))
    sums = sums.select(
        F.col("source").alias("sum_source"),
        F.col("run").alias("sum_run"),
        F.coalesce(F.sum("run_words").over(earlier), F.lit(0)).alias("before_run"),
    )
    sums = stored(sums, "runs")
    within = Window.partitionBy("source", "run").orderBy("turned", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("in_run", F.coalesce(F.sum("words").over(within), F.lit(0))).join(
        sums, F.col("source").eqNullSafe(F.col("sum_source")) & (F.col("run") == F.col("sum_run"))
    )
    placed = placed.withColumn("offset", F.col("before_run") + F.col("in_run"))
    extra = (F.col("offset") + F.col("words") / 2 < F.col("rest")).cast("long")
    placed = placed.withColumn("copies", F.col("passes") + extra)
    return placed.select(
        "doc_id",
        "source",
        "size",
        "rows",
        "source_size",
        "target",
        "turn",
        "passes",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        "offset",
        F.when(F.col("copies") > 0, position(F.col("offset"), schedules)).alias("position"),
    )


def mixed(
    docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """One row for each row of ``docs``: how often it is taken, and from which position on.

    Columns: doc_id, source, size (words), source_size, target (words the source should give), turn (of the
    schedules), passes, copies, taken (copies * size), offset (words of the source in front of it in one
    pass) and position (time of its first copy, null if it is not taken). A null text has no words, a null
    source is a source of its own. All documents are taken ``passes`` times; a last, partial pass goes through
    the source in the order of a hash of doc_id and takes each document whose middle lies within what is left
    of the target. Rows that agree in id, source and size share one decision. An empty table gives no rows, a
    source without words targets zero. Only doc_id, source and text are looked at.

    A hot source is no hot task: running sums are taken over hash ranges of about ``RUN_ROWS`` documents
    each, on top of the sums of the ranges before.
    """
    keys = mixed_keys(docs, schedules, max_repeats)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return keys.withColumn("rows", each).drop("rows")


def position(offset: Column, schedules: Sequence[Schedule] = SCHEDULES) -> Column:
    """The training time at which the source of the row has given ``offset`` words."""
    share = F.when(F.col("target") > 0, F.least(offset / F.col("target"), F.lit(1.0))).otherwise(0.0)
    out = F.lit(None).cast("double")
    for turn, schedule in enumerate(schedules):
        out = F.when(F.col("turn") == turn, inverted(schedule, share)).otherwise(out)
    return out


def training_order(mix: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """One row for each copy of a document, with its training position. Documents that are not taken have none; equal
    positions are left in any order. An empty mix gives no rows."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    copies = mix.where("copies > 0").withColumn("copy", copy)
    at = position(F.col("offset") + F.col("copy") * F.col("source_size"), schedules)
    return copies.withColumn("position", at)


def mix_documents(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """``docs`` as the mix takes them: each document as many times as it is taken, range-sorted by position.

    All columns stay as they are; the same cases as in ``mixed``. The text meets its marks by key.
    """
    keys = stored(mixed_keys(docs, schedules), "mix")
    marks = training_order(keys, schedules).select(
        F.col("doc_id").alias("__mix_id"),
        F.col("source").alias("__mix_source"),
        F.col("size").alias("__mix_size"),
        F.col("position").alias("__mix_position"),
        F.col("copy").alias("__mix_copy"),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("__mix_id"))
        & F.col("source").eqNullSafe(F.col("__mix_source"))
        & (F.col("__mix_words") == F.col("__mix_size"))
    )
    placed = docs.withColumn("__mix_words", _size()).join(marks, same)
    return placed.orderBy("__mix_position", "__mix_id", "__mix_copy").select(docs.columns)
