"""File names of an upload: safe bare names and the format their extension means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that can be read, each named by its extension.
FORMATS = ["csv", "json", "sql", "parquet"]


def safe_filename(name: Column) -> Column:
    """A client-supplied name cut down to its last part, null when nothing usable is left.

    Directories are dropped first by ``/`` and then by ``\\``, a drive letter
    goes too, and hidden names and ``.``/``..`` are refused.
    """
    posix = F.regexp_extract(F.regexp_replace(name, r"/+(\./+)*\.?$", ""), r"([^/]*)$", 1)
    # A drive letter or a bare network share is an anchor, not a name.
    local = F.regexp_replace(posix, r"^(?:(?s:.):|\\\\[^\\]+\\[^\\]+\\?$)", "")
    bare = F.regexp_extract(F.regexp_replace(local, r"\\+(\.\\+)*\.?$", ""), r"([^\\]*)$", 1)
    return F.when((bare != "") & ~bare.startswith("."), bare)


def extension_of(name: Column) -> Column:
    """The last extension in lower case; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def format_of(name: Column) -> Column:
    """The format a sanitised name stands for, null when it is not supported."""
    extension = extension_of(name)
    return F.when(extension.isin(FORMATS), extension)
