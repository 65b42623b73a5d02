import datetime
import io
import os

import pyarrow as pa
import pyarrow.parquet as pq

from tablegraph.operators.catalog import read_catalog
from tablegraph.plans.bulk import stored_table
from tablegraph.streaming import landing as N
from tablegraph.streaming import messages as S
from tests.conftest import rows

JOB = "3f2b9c14-8e7a-4d21-9b55-1c0a7e6d4f38"


def test_message_bodies(spark):
    good = f'{{"job_id":"{JOB}","session_id":"{JOB}"'
    cases = [
        (good + "}", (JOB, 0, False)),
        (good + ',"attempt":2,"more":1}', (JOB, 2, False)),
        (good + ',"attempt":"3"}', (JOB, 3, False)),
        (good.replace("-", "").replace("3f2b", "3F2B") + "}", (JOB, 0, False)),
        (good + ',"attempt":null}', (JOB, None, True)),
        (good + ',"attempt":1.5}', (JOB, None, True)),
        (f'{{"job_id":"{JOB}"}}', (JOB, 0, True)),
        ('{"job_id":7,"session_id":8}', (None, 0, True)),
        ("not json", (None, None, True)),
        ("[]", (None, None, True)),
    ]
    df = spark.createDataFrame([(i, bytearray(text.encode())) for i, (text, _) in enumerate(cases)], "i int, value binary")
    got = rows(S.decode_messages(df).select("i", "job_id", "attempt", "malformed"), "i")
    for (_, job_id, attempt, malformed), (text, want) in zip(got, cases, strict=True):
        assert malformed == want[2], text
        if not malformed:
            assert (job_id, attempt) == want[:2], text


def test_bytes_that_are_not_text_are_kept(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xfe"),)], "value binary")
    row = S.decode_messages(df).first()
    assert row["malformed"] and bytes(row["value"]) == b"\xff\xfe"


def test_late_copies_are_dropped_across_batches(spark, tmp_path):
    source, settled, checkpoint = (str(tmp_path / name) for name in ("in", "settled", "checkpoint"))
    schema = "job_id string, n int"

    def run(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        started = S.settle_messages(stream, settled, checkpoint)
        started.awaitTermination()
        return started.lastProgress

    run(("a", 1), ("a", 2), ("b", 1))
    run(("a", 3), ("c", 1))
    assert rows(spark.read.parquet(settled).select("job_id"), "job_id") == [("a",), ("b",), ("c",)]
    run(*[(f"d{k}", k) for k in range(100)])
    # However many ids are settled, a batch looks up its own, one look more for each it adds, and reads its own rows.
    progress = run(("a", 4), ("e", 5))
    state = progress["stateOperators"][0]
    assert (state["numRowsTotal"], state["numRowsUpdated"]) == (104, 1) and state["customMetrics"]["rocksdbGetCount"] <= 3
    assert [source["numInputRows"] for source in progress["sources"]] == [2]
    assert spark.read.parquet(settled).count() == 104


def test_landed_uploads_are_taken_once(spark, tmp_path):
    landing, out, checkpoint = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def land(session, **files):
        folder = landing / session
        folder.mkdir(parents=True)
        for name, content in files.items():
            stem, _, extension = name.rpartition("_")
            (folder / f"{stem}.{extension}").write_text(content)

    land("s1", people_csv="id,name\n1,a\n2,b\n", towns_csv="id\n7\n")
    land("s2", all_json='{"t":[{"id":1}]}', other_csv="id\n1\n")
    N.ingest_stream(spark, str(landing), out, checkpoint).awaitTermination()
    land("s3", copy_csv="id,name\n1,a\n2,b\n")
    land("s4", d_sql="CREATE TABLE c (id INT, p_id INT REFERENCES c(id));\nINSERT INTO c VALUES (1, NULL);\n")
    N.ingest_stream(spark, str(landing), out, checkpoint).awaitTermination()
    N.ingest_stream(spark, str(landing), out, checkpoint).awaitTermination()

    sessions = read_catalog(spark, out, "sessions", N.SESSIONS_SCHEMA)
    assert rows(sessions.select("session_id", "status", "reject_reason"), "session_id") == [
        ("s1", "ready", None), ("s2", "failed", "mixed_formats"), ("s3", "failed", "already_ingested"), ("s4", "ready", None)
    ]
    tables = read_catalog(spark, out, "tables")
    assert rows(tables.select("session_id", "name", "row_count"), "session_id", "name") == [
        ("s1", "people", 2), ("s1", "towns", 1), ("s4", "c", 1)
    ]
    assert rows(stored_table(spark, out, "s1", "people"), "_row_id") == [(1, "a", 0), (2, "b", 1)]


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    folder = tmp_path / "landing" / "s1"
    folder.mkdir(parents=True)
    (folder / "t.csv").write_text("id\n1\n")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "landing"))
    out = str(tmp_path / "out")
    for _ in range(2):
        N.take_uploads(files, out, 0)
    assert read_catalog(spark, out, "sessions", N.SESSIONS_SCHEMA).count() == 1
    assert read_catalog(spark, out, "tables").count() == 1


def test_a_bad_upload_fails_alone_and_equal_bytes_are_taken_once(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    uploads = {
        "a": {"t.csv": "id\n1\n"},
        "b": {"t.csv": "id\n1\n", "u.csv": "id\n2\n"},
        "c": {"u.csv": "id\n2\n"},
        "ragged": {"r.csv": "a,b\n1,2,3\n"},
        "six": {f"{i}.csv": f"id\n{i + 10}\n" for i in range(6)},
    }
    for place, (session, files) in enumerate(uploads.items()):
        (landing / session).mkdir(parents=True)
        for name, content in files.items():
            (landing / session / name).write_text(content)
            os.utime(landing / session / name, (1_000_000 + place, 1_000_000 + place))
    N.ingest_stream(spark, str(landing), out, str(tmp_path / "checkpoint")).awaitTermination()
    sessions = read_catalog(spark, out, "sessions", N.SESSIONS_SCHEMA)
    assert rows(sessions.select("session_id", "status", "reject_reason"), "session_id") == [
        ("a", "ready", None), ("b", "failed", "already_ingested"), ("c", "ready", None),
        ("ragged", "failed", "unreadable"), ("six", "failed", "too_many_files"),
    ]
    assert sessions.where("session_id = 'ragged' and error is not null").count() == 1
    assert rows(read_catalog(spark, out, "tables").select("session_id", "name"), "session_id") == [("a", "t"), ("c", "u")]


def parquet(**columns):
    sink = io.BytesIO()
    pq.write_table(pa.table(columns), sink)
    return sink.getvalue()


MOMENT = datetime.datetime(2020, 1, 1, 1, 2, 3, 4)
UPLOADS = {
    "csv": {"people.csv": b'id,name,note\n1,a,"two\nlines, ""q"""\n2,b\n\n3,NA,x\n', "towns.csv": b"\xef\xbb\xbfid\r\n7\r\n"},
    "json": {"all.json": b'{"t":[{"id":1,"a":{"b":1.5}},{"id":true}],"none":[],"n":3}', "one.json": b'{"k":"v"}'},
    "sql": {"d.sql": b"CREATE TABLE c (id INT, p INT REFERENCES c(id), t TEXT);\nINSERT INTO c VALUES (1, NULL, 'a;\nb'), (2, 1, 'x');\n"},
    "sql2": {"e.sql": b"CREATE TABLE c (id INT);\nINSERT INTO c VALUES (9);\nCREATE TABLE e (x INT);\n"},
    "parquet": {"p.parquet": parquet(i=pa.array([1, None], pa.int32()), t=[MOMENT, None], s=["a", "é"], l=[[1], [2, 3]])},
    "x_json": {"bad.json": b'{"id":'},
    "x_scalar": {"bad.json": b"42"},
    "x_parquet": {"p.parquet": b"PAR1 but nothing more"},
    "x_bytes": {"p.csv": b"a,b\n\xff\xfe,1\n"},
    "x_ragged": {"fine.csv": b"a\n5\n", "r.csv": b"a,b\n1,2,3\n"},
    "x_header": {"h.csv": b"1,2\n1,2\n"},
    "x_twice": {"a.json": b'{"t":[{"id":1}]}', "b.json": b'{"t":[{"id":2}]}'},
}


def land_all(landing, uploads):
    for session, files in uploads.items():
        (landing / session).mkdir(parents=True)
        for name, content in files.items():
            (landing / session / name).write_bytes(content)


def test_every_kind_of_broken_file_fails_its_own_upload(spark, tmp_path):
    land_all(tmp_path / "landing", UPLOADS)
    out = str(tmp_path / "out")
    N.ingest_stream(spark, str(tmp_path / "landing"), out, str(tmp_path / "checkpoint")).awaitTermination()
    sessions = read_catalog(spark, out, "sessions", N.SESSIONS_SCHEMA).collect()
    for row in sessions:
        broken = row["session_id"].startswith("x_")
        assert (row["status"], row["reject_reason"]) == (("failed", "unreadable") if broken else ("ready", None)), row
        assert (row["error"] is not None) == broken and row["created_at"] is not None
    tables = read_catalog(spark, out, "tables")
    assert rows(tables.select("session_id", "name", "row_count"), "session_id", "name") == [
        ("csv", "people", 3), ("csv", "towns", 1), ("json", "none", 0), ("json", "one", 1), ("json", "t", 2),
        ("parquet", "p", 2), ("sql", "c", 2), ("sql2", "c", 1), ("sql2", "e", 0),
    ]
    assert tables.select("table_id").distinct().count() == 9
    want = {
        ("csv", "people"): [(1, "a", 'two\nlines, "q"', 0), (2, "b", None, 1), (3, None, "x", 2)],
        ("csv", "towns"): [(7, 0)],
        ("json", "t"): [(1, 1.5, 0), (1, None, 1)],
        ("sql", "c"): [(1, None, "a;\nb", 0), (2, 1, "x", 1)],
        ("sql2", "c"): [(9, 0)],
        ("parquet", "p"): [(1, MOMENT, "a", "[1]", 0), (None, None, "é", "[2, 3]", 1)],
    }
    for (session, name), expected in want.items():
        assert rows(stored_table(spark, out, session, name), "_row_id") == expected
    described = read_catalog(spark, out, "columns").where("session_id in ('csv', 'parquet') and table <> 'towns'")
    assert [(r["name"], r["inferred_type"], r["stored_type"]) for r in described.orderBy("session_id", "position").collect()] == [
        ("id", "int64", "bigint"), ("name", "object", "string"), ("note", "object", "string"),
        ("i", "float64", "int"), ("t", "datetime64[us]", "timestamp_ntz"), ("s", "object", "string"), ("l", "object", "string"),
    ]
    assert rows(read_catalog(spark, out, "links").select("session_id", "from_table", "to_table")) == [("sql", "c", "c")]


def test_jobs_do_not_grow_with_uploads(spark, tmp_path):
    def jobs(n):
        root = tmp_path / str(n)
        land_all(root, {f"s{k}": {"t.csv": f"id,a{k % 3}\n{k},x\n".encode(), "u.csv": f"k\n{k + 50}\n".encode()} for k in range(n)})
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
        spark.sparkContext.setJobGroup(f"take-{n}", "")
        try:
            N.take_uploads(files, str(tmp_path / f"out{n}"), 0)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert read_catalog(spark, str(tmp_path / f"out{n}"), "tables").count() == 2 * n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"take-{n}"))

    assert jobs(12) <= jobs(3) + 3
