"""What a load of any format comes to: tables, described columns, declared links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dataset:
    """Tables by name with ``_row_id``, their columns as (name, type label), and links if declared."""

    tables: dict[str, DataFrame]
    columns: dict[str, list[tuple[str, str]]]
    links: DataFrame | None = None
