"""CSV files as tables: header names, surplus and missing fields, inferred types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegraph.functions.text import quoted

from tablegraph.operators.manifest import check_csv_headers
from tablegraph.operators.positions import number_scan, number_small_file, scan_order
from tablegraph.operators.profile import cast_columns, column_facts, normalize_missing
from tablegraph.session import work_path
from tablegraph.sources.listing import TableFiles, table_files

RECORD = "_bad_record"
MARKS = ("_file", "_block", "_place")

# How the reader words a part whose header is not that of the first part.
_HEADER_MESSAGES = (
    "CSV header does not conform to the schema",
    "Number of column in CSV header is not equal to number of fields in the schema",
)

#: A file below this size is one task whichever way it is read.
SPLIT_BYTES = 64 * 1024 * 1024

#: Spark cuts files into blocks no smaller than this.
LEAST_SPLIT_BYTES = 4 * 1024 * 1024


def csv_fields(line: Column, sep: str = ",") -> Column:
    """The fields of one CSV record, quotes removed."""
    one = "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep
    pattern = f'(?s)(?:^|{one})("[^"]*+(?:""[^"]*+)*+"|[^{one}]*+)'
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
    return F.transform(
        found, lambda field: F.replace(F.regexp_replace(field, '^"|"$', ""), F.lit('""'), F.lit('"'))
    )


def header_line(text: Column) -> Column:
    """The first physical line of a file, without a byte-order mark."""
    return F.regexp_extract(text, r"^﻿?([^\r\n]*)", 1)


def header_fields(text: Column, sep: str = ",") -> Column:
    """Column names in the first line of a file; none when that line is blank."""
    line = header_line(text)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(csv_fields(line, sep))


def _raw_names(spark: SparkSession, path: str, sep: str = ",") -> tuple[list[str], list[str]]:
    """Column names of one table and the header's fields as written; raises when it is not a header."""
    first = spark.read.text(path).limit(1).withColumn("raw", header_fields(F.col("value"), sep))
    row = check_csv_headers(first, F.col("raw")).select("names", "raw", "reject_reason").first()
    reason = "no_header" if row is None else row["reject_reason"]
    if reason is not None:
        raise ValueError(f"{path}: {reason}")
    return row["names"], row["raw"]


def header_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of one table, from its first line only; raises when it is not a header."""
    return _raw_names(spark, path, sep)[0]


def _has_other_headers(spark: SparkSession, path: str, sep: str, raw: list[str]) -> bool:
    """Whether a part of a table begins with another header; empty parts have none."""
    lines = scan_order(spark.read.text(path)).where(F.col("_block") == 0)
    heads = lines.groupBy("_file").agg(F.min_by("value", "_place").alias("head"))
    expected = F.array(*[F.lit(name) for name in raw])
    return not heads.where(header_fields(F.col("head"), sep) != expected).isEmpty()


def _has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, so a field may span lines."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _leaves_open(text: Column, sep: str) -> Column:
    """Whether a text that begins at a record's start ends inside a quoted field."""
    one = "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep
    whole = f'"[^"]*+(?:""[^"]*+)*+"[^{one}]*+|[^"{one}][^{one}]*+'
    return text.rlike(f'(?s)^(?:(?:{whole})?+{one})*+"[^"]*+(?:""[^"]*+)*+\\z')


def _moves(value: Column, sep: str) -> tuple[Column, Column]:
    """What a line does to the state "inside quotes": the state it forces, or whether it turns it over.

    A line without quotes does neither.
    """
    text = F.regexp_replace(value, "^\ufeff", "")
    has_quotes = value.contains('"')
    outside = F.when(has_quotes, _leaves_open(text, sep)).otherwise(F.lit(False)).cast("int")
    inside = F.when(has_quotes, _leaves_open(F.concat(F.lit('"'), value), sep)).otherwise(F.lit(True)).cast("int")
    return F.when(outside == inside, outside), F.when(outside > inside, 1).otherwise(0)


def _running(df: DataFrame, piece: list[str], order: str) -> DataFrame:
    """Moves composed up to each row (not counting it) of a piece: ``_last`` forced state, ``_flips`` in all.

    A forced state is kept as if all turns of the piece came after it, so that
    the state before a row is ``_last``, or else the piece's first, plus ``_flips``.
    """
    earlier = Window.partitionBy(*piece).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum("_flip").over(earlier), F.lit(0))
    forced = df.withColumn("_flips", flips).withColumn("_anchor", (F.col("_force") + F.col("_flips")) % 2)
    return forced.withColumn("_last", F.last("_anchor", ignorenulls=True).over(earlier))


def _block_states(lines: DataFrame) -> DataFrame:
    """Per file block: the state it begins in, and the block that holds the start of a record open there.

    Only line numbers and moves are shuffled; one row per block is put in order.
    """
    after = F.coalesce(F.col("_anchor"), F.col("_last")) + F.col("_flips") + F.col("_flip")
    free = F.col("_anchor").isNull() & F.col("_last").isNull()
    turned = (F.col("_flips") + F.col("_flip")) % 2
    moves = (
        _running(lines, ["_file", "_block"], "_place")
        .groupBy("_file", "_block")
        .agg(
            F.max_by("_anchor", F.when(F.col("_anchor").isNotNull(), F.col("_place"))).alias("_end"),
            F.sum("_flip").alias("_turns"),
            F.coalesce(F.bool_or(~free & (after % 2 == 0)), F.lit(False)).alias("_closed"),
            F.coalesce(F.bool_or(free & (turned == 1)), F.lit(False)).alias("_closed_if_open"),
            F.min_by("_crlf", "_place").alias("_crlf"),
        )
        .withColumn("_force", (F.col("_end") + F.col("_turns")) % 2)
        .withColumn("_flip", F.when(F.col("_force").isNull(), F.col("_turns") % 2).otherwise(0))
    )
    lead = (F.coalesce(F.col("_last"), F.lit(0)) + F.col("_flips")) % 2
    led = _running(moves, ["_file"], "_block").withColumn("_lead", lead)
    in_file = Window.partitionBy("_file").orderBy("_block")
    ends_open = F.coalesce(F.col("_force"), (F.col("_lead") + F.col("_flip")) % 2) == 1
    begins = ends_open & ((F.col("_lead") == 0) | F.col("_closed") | F.col("_closed_if_open"))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(begins, F.col("_block")), ignorenulls=True).over(earlier)
    crlf = F.first("_crlf").over(in_file)
    return led.select("_file", "_block", "_lead", owner.alias("_owner"), crlf.alias("_crlf"))


def quoted_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Records of CSV files whose quoted fields may hold line ends, read by many tasks.

    A line maps the state "inside quotes" at its start to that at its end; maps
    are composed per file block and then over the blocks of a file, so every
    task knows where the records of its block begin. Whole lines stay where
    they are; only lines of records that span some meet, and pieces cut by a
    block's end are joined to the block where their record starts. Columns:
    ``record``, and the marks of ``scan_order`` for its first line; ``_place``
    counts from 0 in each block. Headers and lines of blanks are left out.
    A quote that is never closed makes the rest of its file one record.
    """
    force, flip = _moves(F.col("value"), sep)
    lines = scan_order(spark.read.option("lineSep", "\n").text(path)).withColumns({"_force": force, "_flip": flip})
    blocks = _block_states(lines.withColumn("_crlf", F.col("value").endswith("\r")).drop("value"))
    here = ["_file", "_block"]
    state = (F.coalesce(F.col("_last"), F.col("_lead")) + F.col("_flips")) % 2
    so_far = Window.partitionBy(*here).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.col("value").rlike(r"^[\x00-\x20]*$")
    first = (F.col("_block") == 0) & (F.count_if(F.col("_starts") & ~blank).over(so_far) == 1)
    placed = (
        _running(lines.join(blocks, here), here, "_place")
        .withColumn("_before", state)
        .withColumn("_open", F.coalesce(F.col("_force"), (F.col("_before") + F.col("_flip")) % 2) == 1)
        .withColumn("_starts", F.col("_before") == 0)
        .withColumn("_kept", F.col("_starts") & ~blank & ~first)
        .withColumn("_index", F.count_if("_kept").over(so_far) - 1)
        .withColumn("_own", F.last(F.when(F.col("_starts"), F.col("_place")), ignorenulls=True).over(so_far))
    )
    shown = [*here, F.col("_index").alias("_place"), F.col("value").alias("record")]
    whole = placed.where(F.col("_kept") & ~F.col("_open")).select(*shown)

    def joined(order: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("value").alias("value"))))
        return F.array_join(F.transform(parts, lambda part: part["value"]), "\n")

    # A file whose first line ends in CRLF has its line ends inside quotes read as LF, as the reader does.
    plain = F.when(F.col("_crlf"), F.regexp_replace("value", "\r\n", "\n")).otherwise(F.col("value"))

    pieces = (
        placed.where(~F.col("_starts") | F.col("_open"))
        .groupBy(*here, "_own", "_owner", "_crlf")
        .agg(
            joined("_place").alias("value"),
            F.max_by("_open", "_place").alias("_open"),
            F.min_by("_index", "_place").alias("_index"),
            F.min_by("_kept", "_place").alias("_kept"),
        )
        .withColumn("value", plain)
    )
    cut = F.col("_own").isNull() | F.col("_open")
    inner = pieces.where(~cut & F.col("_kept")).select(*shown)
    home = F.when(F.col("_own").isNull(), F.col("_owner")).otherwise(F.col("_block"))
    across = (
        pieces.where(cut)
        .groupBy("_file", home.alias("_home"))
        .agg(
            joined("_block").alias("value"),
            F.min_by("_index", "_block").alias("_place"),
            F.min_by("_kept", "_block").alias("_kept"),
            F.first("_crlf").alias("_crlf"),
        )
        .where("_kept")
        .select("_file", F.col("_home").alias("_block"), "_place", plain.alias("record"))
    )
    return whole.unionByName(inner).unionByName(across).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def _scan(
    spark: SparkSession, table: TableFiles, sep: str, names: list[str], raw: list[str], split_bytes: int
) -> tuple[DataFrame, bool]:
    """All fields as text, plus the raw record of rows whose field count is off; and whether rows carry marks.

    Large files are checked for fields that span lines: without one they are
    split at lines, else at records, which carry the marks of ``scan_order``.
    A line of blanks alone is no row either way; in a table of one column
    neither is a value of blanks alone, which the readings can't tell apart.
    Parts of one table with differing headers end the read: their columns
    would be merged by place.
    """

    def schema(columns: list[str]) -> str:
        return ", ".join("`" + name.replace("`", "``") + "` string" for name in [*columns, RECORD])

    small = table.largest < split_bytes
    options = {
        "sep": sep,
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": RECORD,
        "maxColumns": str(max(len(names) * 2 + 16, 20480)),
    }
    blanks = quoted(names[0]).rlike(r"^[\x00-\x20]+$")
    if len(names) > 1:
        blanks = blanks & F.col(RECORD).rlike(r"^[\x00-\x20]+$")
    not_blank = blanks.isNull() | ~blanks
    if not small and _has_open_lines(spark, table.path):
        if table.n_files > 1 and _has_other_headers(spark, table.path, sep, raw):
            raise ValueError(f"{table.name}: differing_headers")
        parsed = F.from_csv("record", F.lit(schema(names)), options).alias("_row")
        # Stored once, as the rows are read for the profile, the positions and the result.
        stored = work_path(spark, "csv_records")
        quoted_records(spark, table.path, sep).write.parquet(stored)
        records = spark.read.parquet(stored).select(*MARKS, parsed).select("_row.*", *MARKS)
        if len(names) > 1:
            return records, True
        within = Window.partitionBy("_file", "_block").orderBy("_place")
        return records.where(not_blank).withColumn("_place", F.row_number().over(within) - 1), True
    scanned = (
        spark.read.schema(schema(names if table.n_files == 1 else raw))
        .options(header=True, multiLine=small, enforceSchema=table.n_files == 1, **options)
        .csv(table.path)
    )
    if scanned.columns != [*names, RECORD]:
        scanned = scanned.toDF(*names, RECORD)
    if len(names) > 1 and not small:
        return scanned, False  # reading line by line leaves such lines out
    return scanned.where(not_blank), False


def _surplus(n_cols: int, sep: str) -> tuple[Column, Column]:
    """Whether a row holds more fields than the header, and how many it holds."""
    fields = csv_fields(F.regexp_replace(F.col(RECORD), r"[\r\n]+$", ""), sep)
    extra = F.slice(fields, n_cols + 1, F.greatest(F.size(fields) - n_cols, F.lit(1)))
    broken = (
        F.col(RECORD).isNotNull()
        & (F.size(fields) > n_cols)
        & F.exists(extra, lambda field: field != "")
    )
    return broken, F.size(fields)


def csv_surplus_rows(scanned: DataFrame, n_cols: int, sep: str = ",") -> DataFrame:
    """Rows holding more fields than the header, which make a file unreadable.

    Rows that are merely short are fine (their missing fields are null), and so
    are surplus fields that are all empty.
    """
    broken, n_fields = _surplus(n_cols, sep)
    return scanned.where(broken).withColumn("n_fields", n_fields)


def scan_csv(spark: SparkSession, path: str, sep: str = ",") -> dict[str, DataFrame]:
    """The unchecked text form of each table: header columns plus ``_bad_record``."""
    return {
        table.name: _scan(spark, table, sep, *_raw_names(spark, table.path, sep), SPLIT_BYTES)[0].drop(*MARKS)
        for table in table_files(spark, path, "csv")
    }


def read_csv_tables(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    typed: bool = True,
    positions: bool = False,
    split_bytes: int | None = None,
) -> dict[str, DataFrame]:
    """Each CSV file as a table: missing values null, types inferred over all rows.

    Raises when a row holds more fields than the header, or parts of a table
    have differing headers. Files of ``split_bytes`` and more are read by many
    tasks, with the same rows.
    """
    split_bytes = SPLIT_BYTES if split_bytes is None else split_bytes
    tables = {}
    for table in table_files(spark, path, "csv"):
        names, raw = _raw_names(spark, table.path, sep)
        scanned, marked = _scan(spark, table, sep, names, raw, split_bytes)
        # One pass over the file checks every row and profiles every column.
        checked = normalize_missing(
            scanned.withColumn("_surplus", _surplus(len(names), sep)[0]), columns=names
        )
        try:
            facts = column_facts(checked, names, F.count_if("_surplus").alias("surplus")).first()
        except Exception as error:
            if any(message in str(error) for message in _HEADER_MESSAGES):
                raise ValueError(f"{table.name}: differing_headers") from error
            raise
        if facts["surplus"]:
            raise ValueError(f"{table.name}: {facts['surplus']} rows have more fields than the header")
        source = scanned.drop(RECORD)
        if positions:
            one_task = table.n_files == 1 and table.largest < split_bytes
            blocks = table.n_files * (table.largest // LEAST_SPLIT_BYTES + 1)
            if one_task:
                source = number_small_file(source)
            else:
                source = number_scan(source if marked else scan_order(source), pieces=blocks)
        elif marked:
            source = source.drop(*MARKS)
        text = normalize_missing(source, columns=names)
        labels = {row["column"]: row["inferred_type"] for row in facts["types"]}
        tables[table.name] = cast_columns(text, labels) if typed else text
    return tables
