import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablegraph.session import BUILD_SETTINGS, SETTINGS, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tablegraph-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tablegraph-tests-"))
    )
    for key, value in {**BUILD_SETTINGS, **SETTINGS}.items():
        builder = builder.config(key, value)
    session = configure(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    """Write named files into a folder of their own and return its path."""

    def write(**files):
        root = tmp_path / f"files{len(os.listdir(tmp_path))}"
        root.mkdir()
        for name, content in files.items():
            stem, _, extension = name.rpartition("_")
            data = content if isinstance(content, bytes) else content.encode("utf-8")
            (root / f"{stem}.{extension}").write_bytes(data)
        return str(root)

    return write


def rows(df, *order):
    """Rows as tuples in a fixed order."""
    return [tuple(row) for row in (df.orderBy(*order) if order else df).collect()]
