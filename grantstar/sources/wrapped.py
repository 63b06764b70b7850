"""Delimited text with quoted values that run over line ends, read by as many tasks as the file has splits.

Whether a line begins a record depends on all lines before it, but only through one bit: whether a quoted value is open.
So each line is a function of that bit, and so is each split, the composition of its lines. The functions of the splits
are chained in order, which gives the bit at the head of every split, and each split then cuts its own lines
into records. A record belongs to the split it begins in; lines that wrap, and only they, meet by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The rest of a line from an opening quote on, with no closing one.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+\z'
#: From the head of a line inside a quoted value to its end, or to the closing quote.
_INSIDE = r'\A[^"]*+(?:""[^"]*+)*+'


def _fields(sep: str) -> str:
    """Any number of whole fields, each with its separator. A field is quoted only if it begins with a quote; what follows
    a closing quote belongs to the field."""
    return rf'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^"{sep}][^{sep}]*+|){sep})*+'


def ends_open(line: Column, sep: str = "\t") -> Column:
    """Whether a line at the head of a record ends inside a quoted value."""
    return F.when(line.contains('"'), line.rlike(rf"\A{_fields(sep)}{_OPEN}")).otherwise(F.lit(False))


def stays_open(line: Column, sep: str = "\t") -> Column:
    """Whether a line whose head is inside a quoted value ends inside one, the same or another."""
    again = line.rlike(rf'{_INSIDE}"[^{sep}]*+{sep}{_fields(sep)}{_OPEN}')
    return F.when(line.contains('"'), line.rlike(rf"{_INSIDE}\z") | again).otherwise(F.lit(True))


def _before(*part: str, by: str):
    return Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def _composed(df: DataFrame, window) -> DataFrame:
    """Adds what the functions of all rows before make together: those are ``from_out`` and ``from_in``, the bit after
    the row by the bit before it. Counting from the last row that sets the bit whatever it was,
    only rows that turn it matter."""
    sets = F.col("from_out") == F.col("from_in")
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    df = df.withColumn("turns", F.coalesce(F.sum(turns).over(window), F.lit(0)))
    last = F.when(sets, F.struct(F.col("from_out").alias("to"), F.col("turns").alias("at")))
    return df.withColumn("set", F.last(last, ignorenulls=True).over(window))


def _open_at(initial: Column) -> Column:
    """The bit before a row of ``_composed``, from the bit at the head of its partition."""
    turned = (F.col("turns") - F.coalesce(F.col("set.at"), F.lit(0))) % 2 == 1
    return F.coalesce(F.col("set.to"), initial) != turned


def _after(before: Column) -> Column:
    return F.when(before, F.col("from_in")).otherwise(F.col("from_out"))


def _lines(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """The lines of each split in order, numbered, with their functions composed."""
    lines = spark.read.text(files).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    value = F.col("value")
    lines = lines.withColumns({"from_out": ends_open(value, sep), "from_in": stays_open(value, sep)})
    split = Window.partitionBy("file", "block").orderBy("place")
    lines = lines.withColumn("number", F.row_number().over(split))
    return _composed(lines, _before("file", "block", by="place"))


def _splits(lines: DataFrame) -> DataFrame:
    """file, block, opened (whether the split begins inside a quoted value) and the record that is open there."""
    own = {}
    for name, initial in (("out", F.lit(False)), ("in", F.lit(True))):
        before = _open_at(initial)
        own[f"from_{name}"] = F.max_by(_after(before), "place")
        own[f"last_{name}"] = F.max(F.when(~before, F.col("number")))
    held = lines.groupBy("file", "block").agg(*(c.alias(n) for n, c in own.items()))
    ahead = _before("file", by="block")
    held = _composed(held, ahead).withColumn("opened", _open_at(F.lit(False)))
    last = F.when(F.col("opened"), F.col("last_in")).otherwise(F.col("last_out"))
    last = F.when(last.isNotNull(), F.struct("block", last.alias("number")))
    return held.select("file", "block", "opened", F.last(last, ignorenulls=True).over(ahead).alias("open_record"))


def _same_splits(spark: SparkSession) -> None:
    """The splits are cut twice, and their size depends on the cores of the moment unless a number is set."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))


def records(spark: SparkSession, files: list[str], sep: str = "\t") -> DataFrame:
    """The records of files with a header line, without those lines: one row each, in the column ``record``.

    Blank lines between records are left out, as Spark's own reader does. Line ends inside values are ``\\n``. A quote that
    is never closed runs to the end of the file, as one record.
    """
    _same_splits(spark)
    states = _splits(_lines(spark, files, sep).drop("value")).select(
        F.col("file").alias("of"), F.col("block").alias("at"), "opened", "open_record"
    )
    lines = _lines(spark, files, sep)
    filled = F.col("value").rlike(r"[^\x00-\x20]")
    earlier = F.sum(filled.cast("int")).over(_before("file", "block", by="place"))
    header = (F.col("block") == 0) & filled & (F.coalesce(earlier, F.lit(0)) == 0)
    lines = lines.withColumn("header", header)
    lines = lines.join(states, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")), "left")
    changed = F.raise_error(F.lit("the splits of a file changed between two passes")).cast("boolean")
    lines = lines.withColumn("inside", _open_at(F.coalesce("opened", changed)))
    lines = lines.withColumn("continued", _after(F.col("inside")))
    until_now = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(~F.col("inside"), F.struct("block", "number")), ignorenulls=True).over(until_now)
    lines = lines.withColumn("begun", F.coalesce(begun, "open_record")).where(~F.col("header"))
    single = ~F.col("inside") & ~F.col("continued")
    # A column of its own: a reader's check of the records must not be tried on lines that are none.
    whole = lines.select(F.when(single & filled, F.col("value")).alias("record")).where("record is not null")
    parts = lines.where(~single).groupBy("file", "begun").agg(
        F.array_sort(F.collect_list(F.struct("block", "number", "value"))).alias("parts")
    )
    return whole.unionByName(parts.select(F.array_join(F.col("parts.value"), "\n").alias("record")))


def parsed(rows: DataFrame, schema: str, sep: str, malformed: str | None = None) -> DataFrame:
    """The fields of ``records`` by a schema (DDL, columns in the order of the file). ``malformed`` names the column of
    it that gets rows with too many or too few fields."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    if malformed:
        options["columnNameOfCorruptRecord"] = malformed
    return rows.select(F.from_csv("record", schema, options).alias("row")).select("row.*")
