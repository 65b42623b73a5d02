"""SQL dumps as tables: statements are cut out and read for structure, never executed.

Everything is pattern functions over the dump's text on the executors. The
patterns know strings, quoted names, dollar quotes, comments and parentheses;
they do not know SQL beyond the three statements that carry structure or rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegraph.functions.phrases import COLUMN_SEPARATOR, link_names
from tablegraph.operators.positions import MOST_PIECES, ROW_ID, number_scan, scan_offsets, with_row_id
from tablegraph.operators.profile import union_all
from tablegraph.sources.dataset import Dataset
from tablegraph.session import work_path
from tablegraph.sources.listing import file_listing

UNKNOWN_TYPE = "unknown"
LINK_TYPE = "FOREIGN_KEY"
STATEMENT_END, STATEMENT_END_CRLF = ";\n", ";\r\n"

#: Up to this many names of files are sent to every task.
MOST_FILES = 10_000

#: Bytes of declared tables that are sent to every task; more are joined.
CREATE_BYTES = 32 << 20

# Pieces of the patterns. Possessive throughout, so long texts do not recurse.
_ESCAPED = r"(?<=\b[eE])'(?:[^'\\]++|\\.|'')*+'"
_STRING = r"'[^']*+(?:''[^']*+)*+'"
_NAME_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_DOLLAR = r"\$(?<tag>\w*+)\$[\s\S]*?\$\k<tag>\$"
_COMMENT = r"--[^\n]*+|/\*[\s\S]*?\*/"
_TEXTUAL = f"{_ESCAPED}|{_STRING}|{_NAME_QUOTED}|{_DOLLAR}"
_SIMPLE = f"{_ESCAPED}|{_STRING}|{_NAME_QUOTED}"

_STATEMENT = rf"(?:[^;'\"$/\-]++|{_TEXTUAL}|{_COMMENT}|[$/\-'\"])++"


def _nest(inner: str) -> str:
    """One level more than ``inner``: strings whole, parentheses and brackets around ``inner``."""
    return rf"(?:[^()\[\]'\"]++|{_SIMPLE}|[(\[]{inner}[)\]])*+"


def _nested(levels: int) -> str:
    """Text with balanced parentheses and brackets to the given depth, strings taken whole."""
    inner = rf"(?:[^()\[\]'\"]++|{_SIMPLE})*+"
    for _ in range(levels):
        inner = _nest(inner)
    return inner


#: Levels that the patterns know without looking at a statement; deeper statements get patterns of their own.
LEVELS = 4
_BALANCED = _nested(LEVELS)


def _item(balanced: str) -> str:
    return rf"(?:[^,()\[\]'\"]++|{_SIMPLE}|[(\[]{balanced}[)\]])++"


_ITEM = _item(_BALANCED)
_NAME = rf"(?:{_NAME_QUOTED}|[^\s\"'(),.;]++)"
_TARGET = rf"(?:{_NAME}\s*\.\s*)*+({_NAME})"
_REFERENCE = rf"(?is)\bREFERENCES\s+{_TARGET}\s*(?:\(({_BALANCED})\))?"
_FOREIGN_KEY = rf"(?is)\bFOREIGN\s+KEY\s*\({_BALANCED}\)\s*REFERENCES\s+(?:{_NAME}\s*\.\s*)*+{_NAME}\s*(?:\({_BALANCED}\))?"
_TABLE_RULE = r"(?is)^(?:CONSTRAINT|PRIMARY\s+KEY|UNIQUE|CHECK|FOREIGN\s+KEY|EXCLUDE|LIKE)\b"
_TYPE_END = (
    r"\b(?:CONSTRAINT|NOT\s+NULL|NULL|DEFAULT|PRIMARY\s+KEY|UNIQUE|REFERENCES|CHECK|GENERATED|COLLATE)\b"
)

_INTEGER = r"^[+-]?\s*[0-9]+$"
_FLOAT = r"^[+-]?\s*(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_BLANKS = " \t\r\n"

# Other spellings of declared types, and the label each is given.
TYPE_LABELS = {
    "INTEGER": "INT",
    "INT4": "INT",
    "INT8": "BIGINT",
    "INT2": "SMALLINT",
    "NUMERIC": "DECIMAL",
    "DEC": "DECIMAL",
    "FLOAT4": "REAL",
    "FLOAT": "REAL",
    "FLOAT8": "DOUBLE PRECISION",
    "DOUBLE": "DOUBLE PRECISION",
    "BOOL": "BOOLEAN",
    "CHARACTER VARYING": "VARCHAR",
    "CHARACTER": "CHAR",
    "BPCHAR": "CHAR",
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "TIME WITHOUT TIME ZONE": "TIME",
    "TIME WITH TIME ZONE": "TIMETZ",
}


def _all(text: Column, pattern: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(group))


def _depth(text: Column) -> Column:
    """The deepest nesting of parentheses and brackets outside strings, ``LEVELS`` at least.

    Counted only where one bracket opens inside another.
    """
    marks = _all(text, rf"{_SIMPLE}|[()\[\]]")
    start = F.struct(F.lit(0).alias("now"), F.lit(LEVELS).alias("most"))

    def step(seen: Column, mark: Column) -> Column:
        now = seen["now"] + F.when(mark.isin("(", "["), 1).when(mark.isin(")", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    nests = text.rlike(rf"[(\[](?:[^()\[\]'\"]++|{_SIMPLE})*+[(\[]")
    return F.when(nests, F.aggregate(marks, start, step, lambda seen: seen["most"])).otherwise(LEVELS)


def _balanced(depth: Column) -> Column:
    """The pattern of balanced text for a depth that is a column: it grows by one level at a time."""
    opening, closing = _nest("\0").split("\0")
    deeper = F.aggregate(
        F.sequence(F.lit(LEVELS), depth),
        F.lit(_BALANCED),
        lambda inner, _: F.concat(F.lit(opening), inner, F.lit(closing)),
    )
    return F.when(depth > LEVELS, deeper).otherwise(_BALANCED)


def _items(text: Column) -> Column:
    """Comma-separated items of a text, at any depth of nesting."""
    opening, closing = _item("\0").split("\0")
    return _all(text, F.concat(F.lit(opening), _balanced(_depth(text)), F.lit(closing)))


def _plain_strings(text: Column) -> Column:
    """Dollar-quoted strings written as ordinary ones."""
    def plain(part: Column) -> Column:
        body = F.regexp_replace(part, r"^\$\w*\$|\$\w*\$$", "")
        quoted = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.when(part.rlike(r"^\$\w*\$"), quoted).otherwise(part)

    parts = _all(text, rf"{_TEXTUAL}|[^'\"$]++|['\"$]")
    return F.when(text.rlike(r"\$\w*\$"), F.array_join(F.transform(parts, plain), "")).otherwise(text)


def _name(raw: Column) -> Column:
    """A name as written, without its quotes."""
    bare = F.replace(F.regexp_replace(raw, '^"|"$', ""), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"'), bare).otherwise(raw)


def _names(listed: Column) -> Column:
    return F.transform(_all(listed, _ITEM), lambda item: _name(F.trim(item)))


def dump_statements(spark: SparkSession, path: str) -> DataFrame:
    """One row per statement, in file-name order: kind, target table and text.

    A file is read in pieces that end at ``;`` and a line end (LF, or CRLF where
    its first line ends so), so a large dump is spread over many tasks. That is
    exact where no piece ends inside a string or comment, which every piece is
    checked for. The pieces of other files are joined first, see ``joined_pieces``;
    no file is ever read whole by one task.

    Statements are cut once and stored by kind, so the few that declare tables
    are found again without reading the rows.
    """
    files = [row["path"] for row in file_listing(spark, path, "sql").orderBy("path").collect()]
    stage = work_path(spark, "statements")
    by_end = _by_line_end(spark, files)
    _store_statements(_pieces_of(spark, by_end), f"{stage}/split")
    statements = _stored_statements(spark, f"{stage}/split")
    # At most one row per file.
    cut = {row["_file"] for row in statements.where("open").select("_file").distinct().collect()}
    if cut:
        again = {end: [file for file in own if file in cut] for end, own in by_end.items()}
        joined = [joined_pieces(_pieces(spark, own, lineSep=end), end) for end, own in again.items() if own]
        _store_statements(union_all(joined), f"{stage}/joined")
        gone = spark.createDataFrame([(file,) for file in sorted(cut)], "_file string")
        kept = statements.join(F.broadcast(gone) if len(cut) <= MOST_FILES else gone, "_file", "left_anti")
        statements = kept.unionByName(_stored_statements(spark, f"{stage}/joined"))
    scan_offsets(statements).write.parquet(f"{stage}/offsets")
    return number_scan(
        statements.withColumn("file", F.regexp_extract("_file", r"([^/]+)$", 1)).drop("open"),
        row_id="stmt_no",
        offsets=spark.read.parquet(f"{stage}/offsets"),
    )


def numbered_statements(pieces: DataFrame, stage: str) -> DataFrame:
    """The statements of given texts (``value``, ``_file``, ``_block``), in the order of their files."""
    spark = pieces.sparkSession
    _store_statements(pieces, f"{stage}/statements")
    statements = _stored_statements(spark, f"{stage}/statements")
    return number_scan(statements.withColumn("file", F.col("_file")).drop("open"), row_id="stmt_no")


def _by_line_end(spark: SparkSession, files: list[str]) -> dict[str, list[str]]:
    """Files by what ends their statements, as their first lines tell; one job per some hundred files."""
    windows = set()
    for at in range(0, len(files), 200):
        firsts = [_pieces(spark, [file], lineSep="\n").limit(1) for file in files[at : at + 200]]
        ends = union_all(firsts).where(F.col("value").endswith("\r"))
        windows |= {row["_file"] for row in ends.select("_file").collect()}
    return {
        STATEMENT_END: [file for file in files if file not in windows],
        STATEMENT_END_CRLF: [file for file in files if file in windows],
    }


def _pieces_of(spark: SparkSession, by_end: dict[str, list[str]]) -> DataFrame:
    return union_all([_pieces(spark, files, lineSep=end) for end, files in by_end.items() if files] or [_pieces(spark, [])])


# --- Pieces that end inside a string or comment ---------------------------------

# States of the lexer at a piece's end, by the text that opens them: none (between tokens), a string, one with
# backslash escapes, a quoted name, a block comment, a line comment (which the piece's own line end closes), or the
# whole mark of a dollar quote.
_CODE, _IN_STRING, _IN_ESCAPED, _IN_NAME, _IN_COMMENT, _IN_LINE = "", "'", "E", '"', "/*", "-"
_RUN = (
    rf"\A(?:[^'\"$/\-]++|{_ESCAPED}|(?<!\b[eE]){_STRING}|{_NAME_QUOTED}|{_DOLLAR}|--[^\n]*+\n|/\*[\s\S]*?\*/"
    r"|-(?!-)|\$(?!\w*\$)|/(?!\*))*+"
)
_OPENING = rf"{_RUN}(?:((?<=\b[eE])')|(--|/\*|'|\"|\$\w*\$))?[\s\S]*\z"
_EXITS = {
    _IN_STRING: r"\A[^']*+(?:''[^']*+)*+'",
    _IN_ESCAPED: r"\A(?:[^'\\]++|\\[\s\S]|'')*+'",
    _IN_NAME: r'\A[^"]*+(?:""[^"]*+)*+"',
    _IN_COMMENT: r"\A[\s\S]*?\*/",
}


def _state_after(text: Column) -> Column:
    """The state at the end of a text that begins between tokens."""
    found = F.regexp_replace(text, _OPENING, "$2|$3")
    return F.when(found == "'|", _IN_ESCAPED).when(found == "|--", _IN_LINE).otherwise(F.substring(found, 2, 1 << 20))


def lexer_moves(text: Column) -> Column:
    """How a piece moves the lexer: its state at the end by its state at the start, where the two differ.

    A map of at most five fixed states and the dollar marks that stand in the piece; any other mark is not closed by
    it. Maps of consecutive pieces compose, so neither order nor place of the work matters.
    """

    def entry(start: str | Column, end: Column) -> Column:
        return F.struct((F.lit(start) if isinstance(start, str) else start).alias("start"), end.alias("end"))

    fixed = [entry(_CODE, _state_after(text))]
    for state, leave in _EXITS.items():
        fixed.append(entry(state, F.when(text.rlike(leave), _state_after(F.regexp_replace(text, leave, ""))).otherwise(state)))
    marks = F.array_distinct(_all(text, r"(?=(\$\w*\$))\$", 1))  # one mark may begin with the end of another
    # What stands behind the first of each mark.
    behind = lambda mark: F.call_function("substr", text, F.call_function("locate", mark, text) + F.length(mark))
    dollars = F.transform(marks, lambda mark: entry(mark, _state_after(behind(mark))))
    moved = F.filter(F.concat(F.array(*fixed), dollars), lambda e: e["start"] != e["end"])
    none = F.map_from_entries(F.filter(F.array(entry("", F.lit(""))), lambda e: e["start"] != ""))
    return F.when(text.rlike(r"['\"$/*\-]"), F.map_from_entries(moved)).otherwise(none)


def _follow(moves: list[tuple[str, str]], state: str) -> str:
    state = _CODE if state == _IN_LINE else state
    return next((end for start, end in moves if start == state), state)


def _block_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moves of whole file blocks: those of its pieces, in the order of the scan, one after another."""
    at, states = None, {}

    def told() -> pa.RecordBatch:
        moved = [(start, end) for start, end in states.items() if start != end]
        kind = pa.map_(pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([moved], kind)], ["_file", "_block", "moves"])

    for rows in batches:
        for file, block, moves in zip(*(rows.column(name).to_pylist() for name in ("_file", "_block", "moves")), strict=True):
            if at != (file, block):
                if at is not None:
                    yield told()
                at, states = (file, block), {state: state for state in (_CODE, *_EXITS)}
            for start, _ in moves:
                states.setdefault(start, start)  # a dollar mark that no earlier piece of the block holds
            states = {start: _follow(moves, state) for start, state in states.items()}
    if at is not None:
        yield told()


def _join_block(end: str):
    """Pieces of a block joined where one ends inside a token: (value, whether it goes on from the block before, and
    whether into the next). Only the statement at hand is held."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, held, left = None, _CODE, [], False
        names = ["_file", "_block", "value", "goes_on", "left_open"]

        def told(right: bool) -> pa.RecordBatch:
            row = [at[0], at[1], end.join(held), left, right]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        for rows in batches:
            columns = (rows.column(name).to_pylist() for name in ("_file", "_block", "value", "moves", "start", "inside"))
            for file, block, value, moves, start, inside in zip(*columns, strict=True):
                if at != (file, block):
                    if held:
                        yield told(True)
                    at, state, held, left = (file, block), start, [], inside
                state = _follow(moves, state)
                held.append(value)
                if state == _CODE:
                    yield told(False)
                    held, left = [], False
        if held:
            yield told(True)

    return work


def joined_pieces(pieces: DataFrame, end: str) -> DataFrame:
    """The same text in pieces that each end outside strings and comments.

    A prefix scan over lexer moves: every block composes those of its pieces, the few blocks of a file give each its
    state at the start, and then each block joins its own pieces. What crosses blocks is one statement a block at
    most and put together by file. Blocks of the result are numbered so that such statements keep their place.
    """
    spark = pieces.sparkSession
    moving = pieces.select("value", "_file", "_block", lexer_moves(F.col("value")).alias("moves"))
    stage = work_path(spark, "lexer")
    moving.select("_file", "_block", "moves").mapInArrow(
        _block_moves, "_file string, _block bigint, moves map<string,string>"
    ).write.parquet(f"{stage}/blocks")
    blocks = spark.read.parquet(f"{stage}/blocks")
    begun = F.struct(F.lit(_CODE).alias("state"), F.array().cast("array<struct<_block:bigint,start:string>>").alias("starts"))

    def step(seen: Column, block: Column) -> Column:
        state = F.when(seen["state"] == _IN_LINE, _CODE).otherwise(seen["state"])
        return F.struct(
            F.coalesce(F.try_element_at(block["moves"], state), state).alias("state"),
            F.array_append(seen["starts"], F.struct(block["_block"].alias("_block"), seen["state"].alias("start"))).alias("starts"),
        )

    # Maps can't be sorted: they are put in order as lists of entries.
    entries = F.sort_array(F.collect_list(F.struct("_block", F.map_entries("moves").alias("moves"))))
    listed = F.transform(entries, lambda b: F.struct(b["_block"].alias("_block"), F.map_from_entries(b["moves"]).alias("moves")))
    starts = blocks.groupBy("_file").agg(listed.alias("blocks")).select(
        "_file", F.inline(F.aggregate("blocks", begun, step)["starts"])
    )
    starts.write.parquet(f"{stage}/starts")
    starts = spark.read.parquet(f"{stage}/starts")
    if starts.count() > MOST_PIECES:
        raise ValueError("more blocks of dump files than one load can hold")
    # A broadcast keeps the order of the scan. A block that the first scan did not cut alike must not be lost.
    placed = moving.join(F.broadcast(starts), ["_file", "_block"], "left")
    start = F.coalesce("start", F.raise_error(F.lit("file blocks differ between two scans; load again")))
    kept = placed.select("_file", "_block", "value", "moves", start.alias("start")).withColumn("inside", F.col("start") != _CODE)
    schema = "_file string, _block bigint, value string, goes_on boolean, left_open boolean"
    kept.mapInArrow(_join_block(end), schema).write.parquet(f"{stage}/pieces")
    done = spark.read.schema(schema).parquet(f"{stage}/pieces")
    whole = done.where("not goes_on and not left_open").select("value", "_file", (F.col("_block") * 2).alias("_block"))
    # At most two a block: the statement it goes on with and the one it leaves open.
    order = Window.partitionBy("_file").orderBy("_block", F.col("goes_on").desc())
    parts = done.where("goes_on or left_open").withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("_block", "value"))), lambda part: part["value"])
    crossing = parts.groupBy("_file", "run").agg(F.array_join(texts, end).alias("value"), F.min("_block").alias("_block"))
    return whole.unionByName(crossing.select("value", "_file", (F.col("_block") * 2 + 1).alias("_block")))


_STORED_SCHEMA = "_file string, _block bigint, open boolean, target string, text string, _place bigint, kind string"


def _store_statements(pieces: DataFrame, path: str) -> None:
    """Cut pieces of text into statements and write them by kind."""
    raw = F.col("raw")
    commented = raw.contains("--") | raw.contains("/*")
    bare = F.when(commented, F.regexp_replace(raw, rf"({_TEXTUAL})|{_COMMENT}", "$1")).otherwise(raw)
    # The piece is dropped before its statements are spread over rows, and the
    # outer form keeps the planner from cutting it more than once.
    cut = pieces.select(
        "_file", "_block", (_state_after(F.col("value")) != _CODE).alias("open"), _all(F.col("value"), _STATEMENT).alias("raws")
    )
    statements = (
        cut.select("_file", "_block", "open", F.explode_outer("raws").alias("raw"))
        .select("_file", "_block", "open", F.trim(bare, F.lit(_BLANKS)).alias("text"))
        .where(F.col("text") != "")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    statements.select("*", *_classified(F.col("text"))).write.partitionBy("kind").parquet(path)


def _stored_statements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED_SCHEMA).parquet(path)


def _pieces(spark: SparkSession, files: list[str], **options) -> DataFrame:
    return (
        spark.read.format("text")
        .options(**options)
        .load(files)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )


def _classified(text: Column) -> tuple[Column, Column]:
    """The kind of a statement and the table it is about, by one pattern."""
    head = (
        r"(?is)^(?:(?:CREATE\s+(?:(?:GLOBAL|LOCAL|TEMPORARY|TEMP|UNLOGGED)\s+)*+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
        rf"(?={_TARGET}\s*\())|ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?|INSERT\s+INTO\s+){_TARGET}"
    )
    target = F.regexp_extract(text, head, 2)
    kind = F.when(target == "", "ignored").otherwise(F.lower(F.regexp_extract(text, r"^(\w+)", 1)))
    return kind.alias("kind"), F.when(target != "", _name(target)).alias("target")


def _create_items(text: Column) -> Column:
    text = _plain_strings(text)
    pattern = F.concat(F.lit(r"(?s)\(("), _balanced(_depth(text)), F.lit(r")\)"))
    body = F.call_function("regexp_extract", text, pattern, F.lit(1))
    return F.transform(_items(body), lambda item: F.trim(item, F.lit(_BLANKS)))


def _type_label(item: Column) -> Column:
    """The declared type of a column definition, in one spelling, or ``unknown``."""
    written = F.regexp_extract(item, rf"(?is)^{_NAME}\s+(.*?)\s*(?:{_TYPE_END}|$)", 1)
    upper = F.regexp_replace(F.upper(F.trim(written)), r"\s+", " ")
    size = F.regexp_replace(F.regexp_extract(upper, r"(\([^)]*\))", 1), r"\s*,\s*", ", ")
    array = F.regexp_extract(upper, r"((?:\[\d*\])+)$", 1)
    base = F.trim(F.regexp_replace(F.regexp_replace(upper, r"\s*\([^)]*\)", ""), r"(?:\[\d*\])+$", ""))
    labels = F.create_map(*[F.lit(part) for pair in TYPE_LABELS.items() for part in pair])
    known = F.coalesce(F.try_element_at(labels, base), base)
    return F.when(base == "", UNKNOWN_TYPE).otherwise(F.concat(known, size, array))


def dump_creates(stmts: DataFrame) -> DataFrame:
    """One row per ``CREATE TABLE``: its definitions cut apart, its columns in order."""
    items = _create_items(F.col("text"))
    columns = F.transform(
        F.filter("items", lambda item: ~item.rlike(_TABLE_RULE)),
        lambda item: F.struct(
            _name(F.regexp_extract(item, f"^({_NAME})", 1)).alias("name"),
            _type_label(item).alias("inferred_type"),
        ),
    )
    return (
        stmts.where(F.col("kind") == "create")
        .select(F.col("target").alias("table"), "stmt_no", items.alias("items"))
        .withColumn("columns", columns)
    )


def dump_columns(stmts: DataFrame) -> DataFrame:
    """Declared columns of each table, in order; a later CREATE replaces an earlier one."""
    last = dump_creates(stmts).groupBy("table").agg(F.max_by("columns", "stmt_no").alias("columns"))
    return last.select("table", F.posexplode("columns").alias("position", "column")).select(
        "table", "position", "column.name", "column.inferred_type"
    )


def _link_parts(source: Column, text: Column) -> list[Column]:
    to_table = _name(F.regexp_extract(text, _REFERENCE, 1))
    to_column = F.array_join(_names(F.regexp_extract(text, _REFERENCE, 2)), COLUMN_SEPARATOR)
    name, inverse = link_names(source, to_table)
    return [
        to_table.alias("to_table"),
        F.lit(LINK_TYPE).alias("type"),
        source.alias("from_column"),
        F.nullif(to_column, F.lit("")).alias("to_column"),
        name.alias("name"),
        inverse.alias("inverse_name"),
    ]


def dump_links(stmts: DataFrame) -> DataFrame:
    """Foreign keys of the created tables, in the order they are declared.

    Declared on a column, on the table, or added by ALTER TABLE; composite keys
    are one link with the columns joined by commas, and a target without
    columns has a null there. Links of tables never created are left out.
    """
    keys = _all(F.col("text"), _FOREIGN_KEY)
    table_level = F.transform(
        keys,
        lambda key: F.struct(
            F.array_join(
                _names(F.regexp_extract(key, rf"(?is)FOREIGN\s+KEY\s*\(({_BALANCED})\)", 1)), COLUMN_SEPARATOR
            ).alias("source"),
            key.alias("text"),
        ),
    )
    added = stmts.where(F.col("kind") == "alter").select(
        F.col("target").alias("from_table"), "stmt_no", F.posexplode(table_level).alias("item_no", "key")
    )
    item = F.col("item")
    declared = (
        dump_creates(stmts)
        .select(F.col("table").alias("from_table"), "stmt_no", F.posexplode("items").alias("item_no", "item"))
        .where(item.rlike(_REFERENCE))
        .select(
            "from_table",
            "stmt_no",
            "item_no",
            F.struct(
                F.when(
                    item.rlike(_TABLE_RULE),
                    F.array_join(
                        _names(F.regexp_extract(item, rf"(?is)FOREIGN\s+KEY\s*\(({_BALANCED})\)", 1)),
                        COLUMN_SEPARATOR,
                    ),
                )
                .otherwise(_name(F.regexp_extract(item, f"^({_NAME})", 1)))
                .alias("source"),
                item.alias("text"),
            ).alias("key"),
        )
    )
    created = stmts.where(F.col("kind") == "create").select(F.col("target").alias("from_table")).distinct()
    links = declared.unionByName(added).select(
        "from_table", *_link_parts(F.col("key.source"), F.col("key.text")), "stmt_no", "item_no"
    )
    return links.join(created, "from_table", "left_semi")


def sql_literal(text: Column) -> tuple[Column, Column]:
    """The kind of a trimmed literal and its value as text.

    Kinds are null, boolean, string, integer, wide (an integer past 64 bits) and
    float; any other expression keeps its SQL text.
    """
    upper = F.upper(text)
    quoted = text.startswith("'") & text.rlike(rf"^{_STRING}$")
    escaped = F.upper(F.substring(text, 1, 2)).eqNullSafe("E'") & text.rlike(r"^[eE]'(?:[^'\\]++|\\.|'')*+'$")
    dollar = text.startswith("$") & text.rlike(rf"^(?:{_DOLLAR})$")
    digits = F.regexp_replace(text, r"\s|^\+", "")
    kind = (
        F.when(text.isNull() | (upper == "NULL"), "null")
        .when(quoted | dollar, "string")
        .when(text.rlike(_INTEGER), F.when(digits.try_cast("bigint").isNull(), "wide").otherwise("integer"))
        .when(text.rlike(_FLOAT), "float")
        .when(upper.isin("TRUE", "FALSE"), "boolean")
        .when(escaped, "string")
        .otherwise("expression")
    )
    inner = F.replace(F.substring(text, 2, F.length(text) - 2), F.lit("''"), F.lit("'"))
    body = F.replace(F.substring(text, 3, F.length(text) - 3), F.lit("''"), F.lit("'"))
    unescaped = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(body, r"\\n", "\n"), r"\\t", "\t"), r"\\(.)", "$1"
    )
    spaced = text.rlike(r"^(?:\+|-\s)") & (text.rlike(_INTEGER) | text.rlike(_FLOAT))
    value = (
        F.when(upper == "NULL", None)
        .when(quoted, inner)
        .when(dollar, F.regexp_replace(text, r"^\$\w*\$|\$\w*\$$", ""))
        .when(upper.isin("TRUE", "FALSE"), F.lower(text))
        .when(escaped, unescaped)
        .when(spaced, F.regexp_replace(text, r"^\+|\s", ""))
        .otherwise(text)
    )
    return kind, value


_INSERT_HEAD = (
    rf"(?is)^INSERT\s+INTO\s+(?:{_NAME}\s*\.\s*)*+{_NAME}\s*(?:\(({_BALANCED})\)\s*)?(?:OVERRIDING\s+\w+\s+VALUE\s*)?VALUES\s*(?=\()"
)


def _tuples(text: Column) -> Column:
    """The tuples of an INSERT, without their parentheses.

    Each match starts where the last one ended, so clauses after the list are not rows.
    """
    values = _plain_strings(F.regexp_replace(text, _INSERT_HEAD, ""))
    return _all(values, F.concat(F.lit(r"\G\s*,?\s*\(("), _balanced(_depth(values)), F.lit(r")\)")), 1)


def dump_tuples(stmts: DataFrame) -> DataFrame:
    """One row per VALUES tuple of a created table: its column names and raw fields.

    Names are the listed columns, else those declared by the last CREATE before
    the statement; an INSERT without a CREATE before it is dropped.
    """
    text = F.col("text")
    inserts = (
        stmts.where((F.col("kind") == "insert") & text.rlike(_INSERT_HEAD))
        .select(
            F.col("target").alias("table"),
            "stmt_no",
            _names(F.regexp_extract(text, _INSERT_HEAD, 1)).alias("listed"),
            F.posexplode(_tuples(text)).alias("tuple_no", "tuple"),
        )
        .withColumn("fields", _items(F.col("tuple")))
        .drop("tuple")
    )
    declared = dump_creates(stmts).withColumn("names", F.transform("columns", lambda c: c["name"]))
    creates = declared.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("stmt_no", "names"))).alias("creates"))
    # Counted in their own small part of the store, so that rows stay where they are.
    size = stmts.where("kind = 'create'").agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= CREATE_BYTES:
        creates = F.broadcast(creates)
    earlier = F.filter("creates", lambda c: c["stmt_no"] < F.col("stmt_no"))
    return (
        inserts.join(creates, "table")
        .withColumn("create", F.try_element_at(earlier, F.lit(-1)))
        .where(F.col("create").isNotNull())
        .withColumn("names", F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.col("create.names")))
        .select("table", "stmt_no", "tuple_no", "names", "fields", F.element_at("creates", -1)["names"].alias("columns"))
    )


def dump_cells(stmts: DataFrame, names: bool = False) -> DataFrame:
    """The rows of all created tables in one pass: per row the kind and value of each declared column, in order.

    Values of columns that were not declared are dropped, and declared columns an INSERT does not list are null.
    With ``names`` each row carries the names of its columns.
    """
    # One lambda reads every cell, so the code does not grow with tables or columns.
    def cell(text: Column) -> Column:
        kind, value = sql_literal(text)
        return F.struct(kind.alias("kind"), value.alias("value"))

    raws = F.transform(
        "columns", lambda name: F.trim(F.get("fields", F.array_position("names", name).cast("int") - 1))
    )
    keep = ["table", "stmt_no", "tuple_no", *(["columns"] if names else [])]
    return dump_tuples(stmts).select(*keep, F.transform(raws, cell).alias("cells")).withColumnsRenamed({"columns": "names"})


def cell_kinds(cells: DataFrame) -> DataFrame:
    """Per table and column position the kinds of its cells and the digits of its widest integer, by one grouping."""
    digits = F.when(F.col("kind") == "wide", F.length(F.regexp_replace("value", r"^-?0*", "")))
    return (
        cells.select("table", F.posexplode("cells").alias("position", "cell"))
        .select("table", "position", "cell.kind", "cell.value")
        .groupBy("table", "position")
        .agg(F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))).alias("kinds"), F.max(digits).alias("digits"))
    )


def stored_type(kinds: list[str], digits: int | None) -> str:
    """The Spark type of a column whose cells are of the given kinds."""
    found = set(kinds)
    if found == {"integer"}:
        return "bigint"
    if found and found <= {"integer", "wide"}:
        # Of more digits than a decimal holds, they stay text.
        return "string" if digits > 38 else "decimal(38,0)"
    if found and found <= {"integer", "wide", "float"}:
        return "double"
    return "boolean" if found == {"boolean"} else "string"


def stored_type_of(kinds: str, digits: str) -> Column:
    """``stored_type`` of columns of kinds and digits."""
    found, some = F.coalesce(kinds, F.array().cast("array<string>")), F.size(F.coalesce(kinds, F.array().cast("array<string>"))) > 0
    within = lambda *names: F.forall(found, lambda kind: kind.isin(*names))
    return (
        F.when(some & within("integer"), "bigint")
        .when(some & within("integer", "wide"), F.when(F.col(digits) > 38, "string").otherwise("decimal(38,0)"))
        .when(some & within("integer", "wide", "float"), "double")
        .when(some & within("boolean"), "boolean")
        .otherwise("string")
    )


def _typed_cells(cells: DataFrame, names: list[str], types: dict[int, str], *keep: str) -> DataFrame:
    values = [F.get("cells", F.lit(i))["value"].cast(types.get(i, "string")).alias(name) for i, name in enumerate(names)]
    return cells.select(*values, *keep)


def _types_by_table(cells: DataFrame) -> dict[str, dict[int, str]]:
    """One entry per declared column, as the catalog will hold it anyway."""
    types: dict[str, dict[int, str]] = {}
    for row in cell_kinds(cells).collect():
        types.setdefault(row["table"], {})[row["position"]] = stored_type(row["kinds"], row["digits"])
    return types


def dump_rows(stmts: DataFrame, table: str) -> DataFrame:
    """The rows inserted into one table, under its declared columns and typed by their values; a table without rows
    keeps its columns. ``dump_dataset`` reads all tables at once."""
    own = stmts.where(F.col("target") == table)
    names = [row["name"] for row in dump_columns(own).orderBy("position").collect()]
    cells = dump_cells(own)
    return _typed_cells(cells, names, _types_by_table(cells).get(table, {}), "stmt_no", "tuple_no")


def dump_unread(stmts: DataFrame) -> DataFrame:
    """Statements that should have given columns or rows and could not be read: number, kind, target and reason.

    ``no_columns``: a CREATE TABLE whose definitions no pattern finds. ``no_values``: an INSERT without VALUES, such as
    one from a query. ``no_rows``: VALUES of which no tuple could be cut. ``no_table``: rows for a table that no earlier
    statement creates.
    """
    text, creates = F.col("text"), stmts.where("kind = 'create'").groupBy(F.col("target")).agg(F.min("stmt_no").alias("created"))
    broken = dump_creates(stmts).where(F.size("columns") == 0).select(
        "stmt_no", F.lit("create").alias("kind"), F.col("table").alias("target"), F.lit("no_columns").alias("reason")
    )
    inserts = stmts.where("kind = 'insert'").join(creates, "target", "left")
    reason = (
        F.when(F.coalesce(F.col("created") > F.col("stmt_no"), F.lit(True)), "no_table")
        .when(~text.rlike(_INSERT_HEAD), "no_values")
        .when(F.size(_tuples(text)) == 0, "no_rows")
    )
    unread = inserts.select("stmt_no", "kind", "target", reason.alias("reason")).where("reason is not null")
    return broken.unionByName(unread)


def dump_dataset(spark: SparkSession, path: str) -> Dataset:
    """Every table a load of dumps creates, with its rows; files share one state in name order.

    The rows of all tables are cut, numbered and stored by table together, so the scans do not grow with the tables.
    """
    stmts = dump_statements(spark, path)
    columns: dict[str, list[tuple[str, str]]] = {}
    for row in dump_columns(stmts).orderBy("table", "position").collect():
        columns.setdefault(row["table"], []).append((row["name"], row["inferred_type"]))
    cells = stored_cells(stmts)
    types = _types_by_table(cells)
    tables = {
        name: _typed_cells(cells.where(F.col("table") == name), [c for c, _ in listed], types.get(name, {}), ROW_ID)
        for name, listed in columns.items()
    }
    return Dataset(tables, columns, dump_links(stmts))


def numbered_cells(stmts: DataFrame, names: bool = False) -> DataFrame:
    """``dump_cells``, each row with its position in its table."""
    numbered = with_row_id(dump_cells(stmts, names), "table", "stmt_no", "tuple_no", row_id="_all")
    # One row per table: how many rows come before its own.
    firsts = numbered.groupBy("table").agg(F.min("_all").alias("_before"))
    listed = ["names"] if names else []
    return numbered.join(firsts, "table").select("table", (F.col("_all") - F.col("_before")).alias(ROW_ID), "cells", *listed)


def stored_cells(stmts: DataFrame) -> DataFrame:
    """``numbered_cells`` stored by table."""
    stage = work_path(stmts.sparkSession, "cells")
    numbered_cells(stmts).write.partitionBy("table").parquet(stage)
    schema = f"{ROW_ID} bigint, cells array<struct<kind:string,value:string>>, table string"
    return stmts.sparkSession.read.schema(schema).parquet(stage)


def read_dump_tables(spark: SparkSession, path: str, positions: bool = False) -> dict[str, DataFrame]:
    """The tables of ``dump_dataset``."""
    tables = dump_dataset(spark, path).tables
    return tables if positions else {name: df.drop(ROW_ID) for name, df in tables.items()}
