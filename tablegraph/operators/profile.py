"""Column types from values: missing-value tokens, inference, and the labels tables carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegraph.functions.text import quoted

# Texts a CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts a CSV reader takes as a boolean.
BOOL_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]

INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"

# Labels of inferred types and the Spark type each is stored as.
STORED_TYPES = {
    "int64": "bigint",
    "uint64": "decimal(20,0)",
    "float64": "double",
    "bool": "boolean",
    "object": "string",
}


def normalize_missing(
    df: DataFrame, tokens: list[str] = NA_TOKENS, columns: list[str] | None = None
) -> DataFrame:
    """Missing-value texts become null in the given (or all text) columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = set(columns)
    listed = ", ".join("'" + token.replace("'", "\\'") + "'" for token in tokens)

    def present(name: str) -> str:
        c = "`" + name.replace("`", "``") + "`"
        return f"CASE WHEN {c} NOT IN ({listed}) THEN {c} END AS {c}" if name in chosen else c

    return df.selectExpr(*map(present, df.columns))


def _numeric_text(c: Column) -> Column:
    return F.trim(c)


# Classes of a text value, as bits: the ways in which a column can be read
# follow from which of them occur.
_INT, _NEGATIVE, _UNSIGNED, _WIDE, _FLOAT, _BOOL, _TEXT = 1, 2, 4, 8, 16, 32, 64
_WHOLE = _INT | _NEGATIVE | _UNSIGNED | _WIDE
_INT_LEAST, _INT_MOST, _UNSIGNED_MOST = "-9223372036854775808", "9223372036854775807", "18446744073709551615"


def _value_class(c: Column) -> Column:
    """The class of one value; the usual cases are settled by the first test that fits.

    No cast here can fail: a failing one costs far more than a pattern.
    """
    number = _numeric_text(c)
    digits = F.length(F.regexp_replace(number, "^[+-]?0*", ""))
    whole = number.cast("decimal(38,0)")
    narrow = F.when(number.startswith("-"), _NEGATIVE).otherwise(_INT)
    long_whole = (
        F.when(digits > 38, _WIDE)
        .when(whole.between(F.lit(_INT_LEAST).cast("decimal(38,0)"), F.lit(_INT_MOST).cast("decimal(38,0)")), narrow)
        .when(whole.between(0, F.lit(_UNSIGNED_MOST).cast("decimal(38,0)")), _UNSIGNED)
        .otherwise(_WIDE)
    )
    return (
        F.when(c.isNull(), 0)
        .when(number.rlike(INT_PATTERN), F.when(F.length(number) < 19, narrow).otherwise(long_whole))
        .when(number.rlike(FLOAT_PATTERN), _FLOAT)
        .when(c.isin(BOOL_TOKENS), _BOOL)
        .otherwise(_TEXT)
    )


def inferred_type(fact: Column) -> Column:
    """The type of a column from the classes seen in it and whether values are missing."""
    seen, gapped, rows = fact["seen"], fact["gaps"] > 0, fact["rows"]

    def within(bits: int) -> Column:
        return seen.bitwiseAND(F.lit(~bits)) == 0

    return (
        F.when(rows == 0, "object")
        .when(seen == 0, "float64")
        .when(within(_INT | _NEGATIVE), F.when(gapped, "float64").otherwise("int64"))
        .when(within(_INT | _UNSIGNED) & ~gapped, "uint64")
        .when(within(_WHOLE), "object")
        .when(within(_WHOLE | _FLOAT), "float64")
        .when(within(_BOOL) & ~gapped, "bool")
        .otherwise("object")
    )


def seen_classes(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per key what ``inferred_type`` needs to know of its values, by one grouping with a combine."""
    classed = values.withColumn("_class", _value_class(quoted(value)))
    fact = F.struct(
        F.bit_or("_class").alias("seen"), F.count_if(F.col("_class") == 0).alias("gaps"), F.count("*").alias("rows")
    )
    return classed.groupBy(*keys).agg(fact.alias("fact"))


def column_facts(df: DataFrame, columns: list[str], *extra: Column) -> DataFrame:
    """One row: the inferred type of every column under ``types``, and any extra aggregates.

    One aggregation over the table, whatever the number of columns.
    """
    # One lambda classifies every value and one names every type, so neither
    # the plan nor the code grows with more than a line per column.
    texts = F.array(*[quoted(name).cast("string") for name in columns])
    classed = df.withColumn("_classes", F.transform(texts, _value_class))
    fact = "struct(bit_or(_classes[{0}]) AS seen, count_if(_classes[{0}] = 0) AS gaps, count(*) AS rows)"
    facts = F.expr("array(" + ", ".join(fact.format(i) for i in range(len(columns))) + ")")
    names = F.array(*map(F.lit, columns))

    def described(one: Column, i: Column) -> Column:
        return F.struct(
            i.alias("position"), F.get(names, i).alias("column"), inferred_type(one).alias("inferred_type")
        )

    found = classed.agg(facts.alias("facts"), *extra)
    return found.withColumn("types", F.transform("facts", described)).drop("facts")


def profile_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per text column: its position and the type its values amount to."""
    return column_facts(df, df.columns if columns is None else columns).select(F.inline("types"))


def cast_columns(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Cast text columns to the types their labels are stored as."""

    def typed(name: str) -> Column:
        target = STORED_TYPES[labels[name]] if name in labels else "string"
        if target == "string":
            return quoted(name)
        if target == "boolean":
            return (F.lower(quoted(name)) == "true").alias(name)
        return _numeric_text(quoted(name)).cast(target).alias(name)

    return df.select(*[typed(name) for name in df.columns])


# Labels of typed columns read from Parquet.
_PARQUET_LABELS = [
    (T.ByteType, "int8"),
    (T.ShortType, "int16"),
    (T.IntegerType, "int32"),
    (T.LongType, "int64"),
    (T.FloatType, "float32"),
    (T.DoubleType, "float64"),
    (T.BooleanType, "bool"),
    (T.TimestampNTZType, "datetime64[us]"),
    (T.TimestampType, "datetime64[us, UTC]"),
]


def _plain_label(dtype: T.DataType) -> str:
    return next((label for kind, label in _PARQUET_LABELS if isinstance(dtype, kind)), "object")


def typed_labels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column of a typed table: position, name and type label.

    An integer column with a gap reads as ``float64`` and a boolean one as
    ``object``, so nulls are counted, in one aggregation over those columns.
    """
    names = df.columns if columns is None else columns
    entries, gaps = [], []
    for i, name in enumerate(names):
        label = _plain_label(df.schema[name].dataType)
        shown = F.lit(label)
        gapped = "float64" if label.startswith("int") else "object" if label == "bool" else None
        if gapped is not None:
            gaps.append(F.count_if(quoted(name).isNull()).alias(f"g{i}"))
            shown = F.when(F.col(f"g{i}") > 0, gapped).otherwise(label)
        entries.append(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), shown.alias("inferred_type"))
        )
    facts = df.agg(F.count("*").alias("rows"), *gaps)
    return facts.select(F.inline(F.array(*entries)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
