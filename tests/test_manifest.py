import hashlib

import pytest
from pyspark.sql import functions as F

from tablegraph.operators.manifest import batch_totals, check_utf8, describe_content, manifest, reject_reason
from tests.conftest import rows

BIG, OLD = b"x" * 9, b"known"
# Files of a batch (name, content), and the first rule it breaks with the place of the file; at most 8 bytes a batch.
BATCHES = [
    ([("a.csv", b"one")], (None, None)),
    ([("a.csv", b"one"), ("b.csv", b"two")], (None, None)),
    ([(f"{k}.csv", bytes([65 + k])) for k in range(5)], (None, None)),
    ([(f"{k}.csv", bytes([65 + k])) for k in range(6)], ("too_many_files", None)),
    ([("hot.csv", b"hot")] * 3000, ("too_many_files", None)),
    ([(".h", b"one")], ("invalid_filename", 0)),
    ([("a.csv", b"one"), ("..", b"two")], ("invalid_filename", 1)),
    ([("a.csv", b"one"), ("x/a.csv", b"two")], ("duplicate_filename", 1)),
    ([("a.txt", b"one")], ("invalid_extension", 0)),
    ([("a.csv", b"one"), ("n", b"two")], ("invalid_extension", 1)),
    ([("a.csv", b"one"), ("b.json", b"two")], ("mixed_formats", None)),
    ([("a.csv", b"one"), ("b.csv", b"")], ("empty_file", 1)),
    ([("a.csv", BIG)], ("batch_too_large", 0)),
    ([("a.csv", b"12345"), ("b.csv", b"6789")], ("batch_too_large", 1)),
    ([("a.csv", b"123"), ("b.csv", b"45678")], (None, None)),
    ([("a.csv", b"one"), ("b.csv", b"one")], ("duplicate_content", 1)),
    ([("a.csv", OLD)], ("already_ingested", 0)),
    ([("a.csv", b"one"), ("b.csv", OLD)], ("already_ingested", 1)),
    # Two rules at once: names file by file, then formats, then contents file by file, then the record.
    ([(".h", b"")] * 6, ("too_many_files", None)),
    ([("a.txt", b"1"), (".h", b"2")], ("invalid_extension", 0)),
    ([(".h", b"1"), ("a.txt", b"2")], ("invalid_filename", 0)),
    ([("a.csv", b"1"), ("a.csv", b"2"), (".h", b"3")], ("duplicate_filename", 1)),
    ([("a.txt", b"1"), ("a.txt", b"2")], ("invalid_extension", 0)),
    ([("a.csv", b"1"), ("b.json", b"2"), ("c.txt", b"3")], ("invalid_extension", 2)),
    ([("a.csv", b""), ("b.json", b"2")], ("mixed_formats", None)),
    ([("a.csv", b""), ("b.csv", BIG)], ("empty_file", 0)),
    ([("a.csv", BIG), ("b.csv", b"")], ("batch_too_large", 0)),
    ([("a.csv", b"one"), ("b.csv", b"one"), ("c.csv", b"")], ("duplicate_content", 1)),
    ([("a.csv", b"12345"), ("b.csv", b"12345")], ("batch_too_large", 1)),
    ([("a.csv", OLD), ("b.csv", b"")], ("empty_file", 1)),
    ([("a.csv", b"k"), ("b.csv", b"k"), ("c.csv", OLD)], ("duplicate_content", 1)),
]


def test_first_broken_rule_of_each_batch(spark):
    data = [(batch, pos, *file) for batch, (files, _) in enumerate(BATCHES) for pos, file in enumerate(files)]
    m = describe_content(spark.createDataFrame(data, "batch int, pos int, filename string, content binary"))
    on_record = spark.createDataFrame([(hashlib.sha256(OLD).hexdigest(),)], "sha256 string")
    got = {row["batch"]: (row["reject_reason"], row["at_pos"]) for row in reject_reason(m, on_record, max_bytes=8).collect()}
    assert got == {batch: verdict for batch, (_, verdict) in enumerate(BATCHES)}


def test_batch_without_files(spark):
    m = spark.createDataFrame([(1, 0, "a.csv", 3, "x")], "batch int, pos int, filename string, size int, sha256 string")
    opened = spark.createDataFrame([(1,), (2,)], "batch int")
    assert rows(reject_reason(m, batches=opened).select("batch", "reject_reason"), "batch") == [(1, None), (2, "no_files")]


def test_totals(spark):
    m = spark.createDataFrame([(1, 4), (1, 3)], "batch int, size int")
    assert rows(batch_totals(m)) == [(1, 2, 7)]


def test_manifest_of_files(spark, folder):
    path = folder(a_csv=b"id\n1\n", b_csv=b"\xff\xfe")
    got = {row["path"].rsplit("/", 1)[-1]: row for row in manifest(spark, path).collect()}
    assert got["a.csv"]["sha256"] == hashlib.sha256(b"id\n1\n").hexdigest() and got["a.csv"]["size"] == 5
    assert got["a.csv"]["utf8"] is True and got["b.csv"]["utf8"] is False


@pytest.mark.parametrize(("content", "broken"), [(b"abc", 0), ("é".encode(), 0), (b"\xe9", 1), (b"\xed\xa0\x80", 1)])
def test_utf8(spark, content, broken):
    df = spark.createDataFrame([(content,)], "content binary")
    assert check_utf8(df).count() == broken


def test_files_of_a_hot_batch_come_back_marked(spark):
    from tablegraph.operators.manifest import check_batch

    m = spark.range(5000).select(
        F.lit(1).alias("batch"), F.col("id").alias("pos"), F.lit("a.csv").alias("filename"),
        F.lit(1).alias("size"), F.lit("h").alias("sha256"),
    )
    checked = check_batch(m)
    assert checked.where("too_many_files").count() == 5000
    assert checked.where("duplicate_content is not null or duplicate_filename is not null").count() == 0
    assert rows(reject_reason(m)) == [(1, 5000, "too_many_files", None)]


def test_files_past_the_limit_equal_nothing(spark, folder):
    from tablegraph.operators.manifest import check_batch, duplicate_content

    path = folder(a_csv=b"id\n1\n2\n", b_csv=b"id\n3\n4\n", c_csv=b"id\n")
    assert [row["sha256"] is None for row in manifest(spark, path, max_bytes=5).orderBy("path").collect()] == [True, True, False]
    assert manifest(spark, path, max_bytes=10**9).where("sha256 is null").count() == 0
    m = manifest(spark, path, max_bytes=5).select(
        F.lit(1).alias("batch"), F.regexp_extract("path", "([^/]+)$", 1).alias("pos"),
        F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "size", "sha256",
    )
    assert check_batch(m).where("duplicate_content").count() == 0 and duplicate_content(m).count() == 0
