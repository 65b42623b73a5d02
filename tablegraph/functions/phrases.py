"""How links read: phrases from foreign keys, labels for edges, numeric type labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegraph.functions.text import ARROW

COLUMN_SEPARATOR = ","

# The phrases of a foreign key, forwards and backwards.
FORWARD_PHRASE = "belongs to"
INVERSE_PHRASE = "has many"

# Parts of a type label that mark it as numeric.
NUMERIC_TYPE_PARTS = ["int", "float", "double", "decimal", "numeric", "real"]


def _without_plural(word: Column) -> Column:
    cut = word.substr(F.lit(1), F.length(word) - 1)
    return F.when((F.length(word) > 2) & word.endswith("s"), cut).otherwise(word)


def link_role(from_column: Column, to_table: Column) -> Column:
    """The role a key column names (``manager_id`` gives ``manager``), null when it names none.

    Only an ``_id`` ending names a role, and only when it differs from the
    target table's own name. A composite key names none.
    """
    lowered = F.lower(from_column)
    role = lowered.substr(F.lit(1), F.length(lowered) - 3)
    names_role = (
        lowered.endswith("_id")
        & ~lowered.contains(COLUMN_SEPARATOR)
        & (F.length(lowered) > 3)
        & (_without_plural(role) != _without_plural(F.lower(to_table)))
    )
    return F.when(names_role, role)


def link_names(from_column: Column, to_table: Column) -> tuple[Column, Column]:
    """A foreign key as a phrase, forwards (``belongs to``) and backwards (``has many``)."""
    role = link_role(from_column, to_table)
    return (
        F.concat_ws(" ", F.lit(FORWARD_PHRASE), role),
        F.concat_ws(" ", F.lit(INVERSE_PHRASE), role),
    )


def edge_columns(from_column: Column, to_column: Column, link_type: Column) -> Column:
    """The columns a link joins through, or its type in words when it names none."""
    by_type = F.replace(F.lower(link_type), F.lit("_"), F.lit(" "))
    by_column = F.concat(from_column, F.lit(ARROW), F.coalesce(to_column, F.lit("?")))
    return F.when(F.coalesce(from_column, F.lit("")) == "", by_type).otherwise(by_column)


def edge_label(name: Column, from_column: Column, to_column: Column, link_type: Column) -> Column:
    """What an edge says: the link's name, else its columns."""
    return F.coalesce(name, edge_columns(from_column, to_column, link_type))


def is_numeric_type(label: Column) -> Column:
    """Whether a type label reads as a number, by substring and without regard to case."""
    return label.rlike("(?i)" + "|".join(NUMERIC_TYPE_PARTS))
