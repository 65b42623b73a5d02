"""Values as text: join keys, row labels and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_LENGTH = 32
EDGE_ID_SEPARATOR = "|"
ARROW = " → "

_FLOATING = (T.DoubleType, T.FloatType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def _float_text(c: Column) -> Column:
    """A double the way Python prints it: plain between 1e-4 and 1e16, else ``1.5e-07``."""
    c = c.cast("double")
    raw = c.cast("string")
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)

    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    size = F.abs(c)
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(c == F.lit(float("inf")), F.lit("inf"))
        .when(c == F.lit(float("-inf")), F.lit("-inf"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def value_text(c: Column, dtype: T.DataType) -> Column:
    """A value as the text a reader of the table would see."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, _FLOATING):
        return _float_text(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    return c.cast("string")


def join_key(c: Column, dtype: T.DataType) -> Column:
    """A join value in the form both sides of a link agree on, null if it cannot join.

    Whole floats meet integers (``1.0`` and ``1``); missing, NaN and infinite
    values meet nothing. Whole floats past 38 digits keep their float text.
    """
    if not isinstance(dtype, _FLOATING):
        return value_text(c, dtype)
    c = c.cast("double")
    whole = c.try_cast("decimal(38,0)").cast("string")
    return F.when(
        _finite(c),
        F.when(c == F.rint(c), F.coalesce(whole, _float_text(c))).otherwise(_float_text(c)),
    )


def same_integral(left: T.DataType, right: T.DataType) -> bool:
    """Both sides are integers, so the native values match exactly when the texts do."""
    return isinstance(left, _INTEGRAL) and isinstance(right, _INTEGRAL)


def row_label(df: DataFrame, position: Column, columns: list[str] | None = None) -> Column:
    """First non-null value in column order, cut to 32 characters, else ``row N`` from 1."""
    names = df.columns if columns is None else columns
    shown = [value_text(quoted(name), df.schema[name].dataType) for name in names]
    fallback = F.concat(F.lit("row "), (position + 1).cast("string"))
    return F.substring(F.coalesce(*shown, fallback), 1, LABEL_LENGTH)


def row_id(table: Column | str, position: Column) -> Column:
    """``table#position``, the identity of a row in a row graph."""
    name = F.lit(table) if isinstance(table, str) else table
    return F.concat(name, F.lit("#"), position.cast("string"))


def edge_id(source: Column, target: Column, label: Column) -> Column:
    return F.concat_ws(EDGE_ID_SEPARATOR, source, target, label)
