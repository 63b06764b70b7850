"""Delimited raw feeds: contract check, reading and one-off conversion to parquet."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Sequence
from functools import partial, reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantstar.schemas import CONTRACT_BY_NAME, CONTRACTS, FeedContract, Feeds
from grantstar.session import concurrently, files_below, first_line, in_parallel
from grantstar.sources.wrapped import ends_open, parsed, records

# The texts pandas reads as missing by default. Not applied unless asked for, since
# they include a country code (NA) and surnames (Null, None).
PANDAS_NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_CONTRACT_REPORT = "feed string, exists boolean, missing_columns string, ok boolean"


def files_over_lines(spark: SparkSession, path: str | list[str], sep: str = "\t") -> list[str]:
    """The files in which a value runs over a line end.

    The first such line of a file stands at the head of a record, as all before it are whole; so a file has one exactly
    if some line, taken for a record, ends inside a quoted value. This look is split like any text scan.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    found = lines.where(ends_open(F.col("value"), sep)).select("file").distinct().collect()
    return sorted(r.file for r in found)


def list_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The data files with content at or below a path or several."""
    paths = [path] if isinstance(path, str) else path
    return [file for p in paths for file, size, _ in files_below(spark, p) if size]


def _named_columns(line: str, sep: str) -> tuple[str, ...]:
    """The columns of a header line. Names that are empty or come again get their number, as in Spark's reader."""
    names = next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep), [])
    seen = Counter(n.lower() for n in names)
    return tuple(f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names))


def headers(spark: SparkSession, files: Sequence[str], sep: str = "\t") -> dict[str, tuple[str, ...]]:
    """The columns by file. First lines are read side by side as the file listing is, without a job and without
    looking at the rest of any file."""
    return dict(zip(files, in_parallel(lambda file: _named_columns(first_line(spark, file), sep), files)))


_MALFORMED = "_malformed_line"


def by_header(
    spark: SparkSession, files: list[str], over_lines: Sequence[str], sep: str = "\t"
) -> list[tuple[tuple[str, ...], bool, list[str]]]:
    """The files in groups that can be read together: (columns, whether values run over lines, files)."""
    found = set(map(_plain, over_lines))
    groups: dict[tuple, list[str]] = {}
    for file, header in headers(spark, files, sep).items():
        groups.setdefault((header, _plain(file) in found), []).append(file)
    return [(header, over, own) for (header, over), own in groups.items()]


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    name: str,
    null_tokens: Sequence[str] = (),
    multiline: bool | None = None,
) -> DataFrame:
    """The contract columns of one feed as text, and ``_malformed_line``: null, or the text of a row that
    has more or fewer fields than the header.

    Parts with the same header are read together, by name, so parts may order their columns
    differently. Every file is split; one with values that run over lines takes the way through ``wrapped.records``.
    """
    contract = CONTRACT_BY_NAME[name]
    try:
        files = list_files(spark, path)
    except FileNotFoundError:
        files = []
    if not files:
        return spark.read.option("header", True).csv(path).select(*contract.columns)  # raises what is wrong
    if multiline is None:
        wrapped = files_over_lines(spark, files) if contract.multiline else []
    else:
        wrapped = files if multiline else []
    frames = []
    for header, over_lines, own in by_header(spark, files, wrapped):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, _MALFORMED)])
        if over_lines:
            raw = parsed(records(spark, own), schema.toDDL(), "\t", _MALFORMED)
        else:
            # A parser that skips columns would not notice fields too many or too few.
            reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("escape", '"')
            reader = reader.option("enforceSchema", False).option("columnPruning", False)
            raw = reader.option("columnNameOfCorruptRecord", _MALFORMED).csv(own)
        frames.append(raw.select(*contract.columns, _MALFORMED))
    raw = reduce(DataFrame.unionByName, frames)
    if not null_tokens:
        return raw
    tokens = list(null_tokens)
    return raw.withColumns({c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in contract.columns})


def _plain(path: str) -> str:
    """A path without its scheme and empty authority, as the two listings spell it differently."""
    return unquote(re.sub(r"^file:/+", "/", path))


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    name: str,
    null_tokens: Sequence[str] = (),
    multiline: bool | None = None,
    skip_malformed: bool = False,
) -> DataFrame:
    """The contract columns of one feed, as text.

    ``path`` may be a file, a folder of part files or a list of paths. Empty fields are null;
    ``null_tokens`` adds more texts that count as missing. ``multiline`` says whether values hold line
    ends; by default the feeds with free text are looked through for such values. A row with more or
    fewer fields than the header is an error when it is read, unless ``skip_malformed`` leaves such
    rows out; ``malformed_rows`` counts them.
    """
    lines = read_lines(spark, path, name, null_tokens, multiline)
    # Spark refuses to read the column of malformed lines alone, so a count must need another one, too.
    other = F.length(F.coalesce(CONTRACT_BY_NAME[name].columns[0], F.lit(""))) < 0
    bad = F.col(_MALFORMED).isNotNull() | other
    if skip_malformed:
        kept = lines.where(~bad)
    else:
        stop = F.raise_error(F.concat(F.lit(f"malformed row in feed {name}: "), F.col(_MALFORMED)))
        kept = lines.where(F.when(bad, stop.cast("boolean")).otherwise(F.lit(True)))
    return kept.select(*CONTRACT_BY_NAME[name].columns)


def malformed_rows(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(feed, rows, malformed) of all given feeds."""
    counts = []
    for name, path in paths.items():
        lines = read_lines(spark, path, name)
        bad = F.count_if(F.col(_MALFORMED).isNotNull())
        # As in ``read_feed``, one more column is needed.
        whole = F.count(CONTRACT_BY_NAME[name].columns[0])
        totals = lines.agg(F.count(F.lit(1)).alias("rows"), bad.alias("malformed"), whole.alias("whole"))
        counts.append(
            totals.where("whole >= 0").select(F.lit(name).alias("feed"), "rows", "malformed")
        )
    return reduce(DataFrame.unionByName, counts)


def header_of(spark: SparkSession, path: str) -> list[str] | None:
    """The column names that every part of a feed has, none for a folder without files, None without
    such a path."""
    try:
        found = list(headers(spark, list_files(spark, path)).values())
    except FileNotFoundError:
        return None
    return [c for c in found[0] if all(c in h for h in found)] if found else []


def check_parts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(feed, part, missing_columns, extra_columns, reordered, ok) of every part file of the given feeds.

    Extra columns are those the contract does not name; ``reordered`` says that the part has its contract columns in another
    order than the contract. Neither is an error, as parts are read by name.
    """
    rows = []
    for name, path in paths.items():
        wanted = CONTRACT_BY_NAME[name].columns
        for file, header in headers(spark, list_files(spark, path)).items():
            missing = [c for c in wanted if c not in header]
            extra = [c for c in header if c not in wanted]
            own = [c for c in header if c in wanted]
            reordered = own != [c for c in wanted if c in header]
            rows.append((name, file.rsplit("/", 1)[1], ",".join(missing), ",".join(extra), reordered, not missing))
    return spark.createDataFrame(
        rows, "feed string, part string, missing_columns string, extra_columns string, reordered boolean, ok boolean"
    )


def _verdict(contract: FeedContract, columns: list[str] | None) -> tuple[str, bool, str, bool]:
    missing = [c for c in contract.columns if c not in (columns or [])]
    text = ",".join(missing) if columns is not None else ""
    return contract.name, columns is not None, text, columns is not None and not missing


def feed_paths(folder: str) -> dict[str, str]:
    return {c.name: f"{folder.rstrip('/')}/{c.file}" for c in CONTRACTS}


def check_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(feed, exists, missing_columns, ok), read off the header lines of all parts alone."""
    rows = [
        _verdict(c, header_of(spark, paths[c.name]) if c.name in paths else None)
        for c in CONTRACTS
    ]
    return spark.createDataFrame(rows, _CONTRACT_REPORT)


def check_feeds(feeds: Feeds) -> DataFrame:
    """The same contract check for loaded feeds, with their row counts."""

    def one(name: str, df: DataFrame) -> DataFrame:
        feed, exists, missing, ok = _verdict(CONTRACT_BY_NAME[name], df.columns)
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(feed).alias("feed"),
            F.lit(exists).alias("exists"),
            F.lit(missing).alias("missing_columns"),
            F.lit(ok).alias("ok"),
            "rows",
        )

    return reduce(DataFrame.unionByName, (one(name, df) for name, df in feeds.items()))


def read_feeds(spark: SparkSession, paths: dict[str, str], **options) -> Feeds:
    """All six feeds from delimited text. ``options`` go to ``read_feed``."""
    return Feeds(**{c.name: read_feed(spark, paths[c.name], c.name, **options) for c in CONTRACTS})


def convert_feeds(
    spark: SparkSession,
    paths: dict[str, str],
    folder: str,
    rows_per_file: int = 5_000_000,
    skip_malformed: bool = False,
    **options,
) -> Feeds:
    """Write the feeds as parquet and read them back.

    After this step every scan is split, pruned to the columns it needs and filtered at the source.
    Malformed rows are counted while the rest is written: they are an error that names the feeds and
    the counts, unless ``skip_malformed`` is set. ``options`` go to ``read_lines``.
    """

    def convert(name: str) -> tuple[str, int]:
        seen = Observation()
        lines = read_lines(spark, paths[name], name, **options)
        bad = F.count_if(F.col(_MALFORMED).isNotNull()).alias("malformed")
        feed = lines.observe(seen, bad).where(F.col(_MALFORMED).isNull()).drop(_MALFORMED)
        writer = feed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{folder}/{name}")
        return name, seen.get["malformed"]

    found = dict(concurrently(*(partial(convert, contract.name) for contract in CONTRACTS)))
    if not skip_malformed and any(found.values()):
        detail = ", ".join(f"{name}: {n}" for name, n in found.items() if n)
        raise ValueError(f"malformed rows in the raw feeds ({detail})")
    return read_converted(spark, folder)


def read_converted(spark: SparkSession, folder: str) -> Feeds:
    def load(contract: FeedContract) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in contract.columns)
        return spark.read.schema(schema).parquet(f"{folder}/{contract.name}")

    return Feeds(**{c.name: load(c) for c in CONTRACTS})
