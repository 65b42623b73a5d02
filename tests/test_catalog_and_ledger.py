import datetime
import os

from pyspark.sql import functions as F

from tablegraph.operators import catalog as C
from tablegraph.operators import ledger as G
from tablegraph.operators import links as L
from tablegraph.operators.paging import session_page
from tablegraph.plans.bulk import load_uploads, stored_table
from tablegraph.plans.ingest import ingest
from tablegraph.plans.schema_graph import schema_graph
from tests.conftest import rows

NOW = datetime.datetime(2024, 1, 1, 12)
JOB = (
    "job_id string, session_id string, status string, attempt_count int, error_message string, "
    "queued_at timestamp_ntz, started_at timestamp_ntz, completed_at timestamp_ntz"
)


def ago(seconds):
    return NOW - datetime.timedelta(seconds=seconds)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def job(job_id, status, started=None, attempts=1, queued=0):
    return (job_id, "s-" + job_id, status, attempts, None, ago(queued), started, None)


def test_schema_graph_and_dangling_links(spark):
    tables = spark.createDataFrame(
        [("s", 1, "customers", 2), ("s", 2, "orders", 3), ("t", 3, "customers", 9)],
        "session_id string, table_id int, name string, row_count bigint",
    )
    columns = spark.createDataFrame([(1, 0, "customer_id", "int64"), (2, 0, "order_id", "int64"), (2, 1, "customer_id", "int64")],
                                    "table_id int, position int, name string, inferred_type string")
    links = spark.createDataFrame(
        [("s", "orders", "customers", "FOREIGN_KEY", "customer_id", "customer_id", None, None),
         ("s", "orders", "ghost", "FOREIGN_KEY", "x", "y", None, None),
         ("t", "orders", "customers", "FOREIGN_KEY", "x", "y", None, None)],
        "session_id string, from_table string, to_table string, type string, from_column string, to_column string, "
        "name string, inverse_name string",
    )
    graph = schema_graph(tables, columns, links, session_id="s")
    assert rows(graph.nodes.select("name", "column_count"), "name") == [("customers", 1), ("orders", 2)]
    assert rows(graph.edges.select("from_table_id", "to_table_id", "label")) == [(2, 1, "customer_id → customer_id")]
    assert rows(L.dangling_links(tables, links).select("session_id", "to_table", "missing"), "session_id") == [
        ("s", "ghost", "to"), ("t", "customers", "from")
    ]
    assert rows(L.neighbour_tables(links, tables, "orders").select("session_id", "neighbour")) == [("s", "customers")]


def test_stored_table_is_replaced_by_a_second_run(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([(0, 1, "a"), (1, 2, "b")], "_row_id bigint, id bigint, name string")
    C.write_table(first, root, "s", "people")
    path = C.write_table(first.where("id = 1"), root, "s", "people")
    assert rows(spark.read.parquet(path)) == [(0, 1, "a")]
    assert C.write_table(first.select("_row_id"), root, "s", "none") is None
    assert C.table_path("/r", "../s", "a/../b").startswith("/r/parsed/%2E%2E%2Fs/a%2F")


def test_every_format_is_ingested_with_its_description(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    ingest(spark, folder(people_csv="id,name\n1,a\n2,\n"), "csv", out, "c")
    ingest(spark, folder(items_json='{"items":[{"id":1,"at":{"x":1.5}}],"none":[]}'), "json", out, "j")
    dump = "CREATE TABLE o (id INT, c_id INT REFERENCES c(id), FOREIGN KEY (c_id) REFERENCES c (id));\nINSERT INTO o VALUES (1, 2);\n"
    for _ in range(2):
        ingest(spark, folder(d_sql=dump), "sql", out, "d")
    parquet = str(tmp_path / "in" / "events.parquet")
    spark.createDataFrame([(1, "alice"), (2, "bob")], "id bigint, name string").write.parquet(parquet)
    ingest(spark, str(tmp_path / "in"), "parquet", out, "p")
    assert rows(C.read_catalog(spark, out, "tables").select("session_id", "name", "row_count"), "session_id", "name") == [
        ("c", "people", 2), ("d", "o", 1), ("j", "items", 1), ("j", "none", 0), ("p", "events", 2)
    ]
    described = C.read_catalog(spark, out, "columns").select("session_id", "position", "name", "inferred_type")
    assert rows(described, "session_id", "position") == [
        ("c", 0, "id", "int64"), ("c", 1, "name", "object"), ("d", 0, "id", "INT"), ("d", 1, "c_id", "INT"),
        ("j", 0, "id", "integer"), ("j", 1, "at.x", "float"), ("p", 0, "id", "int64"), ("p", 1, "name", "object"),
    ]
    # The key is declared twice and kept once.
    assert C.read_catalog(spark, out, "links").count() == 1


def test_delete_takes_finished_sessions_only(spark):
    sessions = spark.createDataFrame([("a", "ready"), ("b", "processing"), ("c", "failed")], "session_id string, status string")
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "session_id string, f int")
    left = C.delete_session(sessions, {"files": files}, spark.createDataFrame([("a",), ("b",), ("x",)], "session_id string"))
    assert rows(left["sessions"].select("session_id"), "session_id") == [("b",), ("c",)]
    assert rows(left["files"].select("session_id"), "session_id") == [("b",), ("c",)]


def test_replaced_session_without_rows_disappears(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, v int")
    again = spark.createDataFrame([("a",)], "session_id string")
    assert rows(C.replace_session(old, old.limit(0), again)) == [("b", 2)]


def test_session_page_is_newest_first(spark):
    sessions = spark.createDataFrame([(i, ago(i * 10)) for i in range(7)], "session_id int, created_at timestamp_ntz")
    assert [(r["session_id"], r["total"]) for r in session_page(sessions, limit=2, offset=1).collect()] == [(1, 7), (2, 7)]


JOBS = [
    job("queued", "queued"), job("held", "processing", ago(0)), job("edge", "processing", ago(600)),
    job("expired", "processing", ago(660)), job("done", "done"), job("failed", "failed"),
]


def test_delivery_verdicts(spark):
    jobs = spark.createDataFrame(JOBS, JOB)
    msgs = spark.createDataFrame([(j[0],) for j in JOBS] + [("unknown",), ("queued",)], "job_id string")
    assert rows(G.delivery_verdict(msgs, jobs, now()), "job_id") == [
        ("done", "already_settled"), ("edge", "in_progress"), ("expired", "claimable"), ("failed", "already_settled"),
        ("held", "in_progress"), ("queued", "claimable"), ("queued", "claimable"), ("unknown", "missing"),
    ]
    assert rows(G.expired_leases(jobs, now()).select("job_id")) == [("expired",)]


def test_results_of_a_lost_claim_do_not_count(spark):
    jobs = spark.createDataFrame(
        [job("a", "processing", ago(5)), job("b", "processing", ago(5)), job("c", "done", ago(5)),
         job("d", "processing", ago(5), attempts=3), job("e", "processing", ago(5), attempts=1)], JOB)
    results = spark.createDataFrame(
        [("a", ago(5), True, False, None), ("b", ago(4), True, False, None), ("c", ago(5), True, False, None),
         ("d", ago(5), False, False, "boom"), ("e", ago(5), False, False, "try again")],
        "job_id string, started_at timestamp_ntz, succeeded boolean, permanent boolean, message string")
    after = G.apply_results(jobs, results, now()).select("job_id", "status", "error_message", "session_status", "completed_at")
    assert rows(after, "job_id") == [
        ("a", "done", None, "ready", NOW), ("b", "processing", None, None, None), ("c", "done", None, None, None),
        ("d", "failed", "boom", "failed", NOW), ("e", "queued", "try again", None, None),
    ]
    permanent = results.withColumn("permanent", F.lit(True))
    assert G.apply_results(jobs, permanent, now()).where("job_id = 'e'").first()["status"] == "failed"
    # Told twice, once as done and once as failed: one row, and the success counts.
    twice = results.union(results.withColumn("succeeded", ~F.col("succeeded")))
    told = G.apply_results(jobs, twice, now())
    assert told.count() == jobs.count() and told.where("job_id in ('a', 'd', 'e') and status <> 'done'").count() == 0


def test_failure_routes(spark):
    cases = [(0, "transient"), (1, "transient"), (2, "transient"), (0, "permanent"), (1, "held"), (5, "held")]
    df = spark.createDataFrame(cases, "attempt int, outcome string")
    got = G.route_failures(df).select("attempt", "outcome", "route", "delay_seconds", "next_attempt").collect()
    assert [tuple(row) for row in got] == [
        (0, "transient", "retry", 5, 1), (1, "transient", "retry", 25, 2), (2, "transient", "dead", None, 2),
        (0, "permanent", "dead", None, 0), (1, "held", "retry", 30, 1), (5, "held", "retry", 30, 5),
    ]
    delays = spark.range(0, 6).select(G.retry_delay(F.col("id").cast("int"))).collect()
    assert [row[0] for row in delays] == [5, 5, 25, 25, 25, 25]


def test_stuck_jobs_latest_job_and_status(spark):
    jobs = spark.createDataFrame([job("a", "queued", queued=301), job("b", "queued", queued=300), job("c", "done", queued=900)], JOB)
    assert rows(G.stuck_jobs(jobs, now()).select("job_id")) == [("a",)]
    one = jobs.withColumn("session_id", F.lit("s"))
    assert G.latest_job(one).first()["job_id"] == "b"
    sessions = spark.createDataFrame([("s", "queued"), ("t", "uploading")], "session_id string, status string")
    assert rows(G.session_status(sessions, one).select("session_id", "job_status"), "session_id") == [("s", "queued"), ("t", None)]
    assert rows(G.queue_depth(jobs), "status") == [("done", 1), ("queued", 2)]


def test_links_are_kept_once(spark):
    links = spark.createDataFrame(
        [(0, "o", "c", "FOREIGN_KEY", "x", "", "first"), (1, "o", "c", "FOREIGN_KEY", "x", None, "second"),
         (2, "o", "c", "OTHER", "x", None, "third")],
        "ord int, from_table string, to_table string, type string, from_column string, to_column string, name string")
    assert rows(L.dedupe_links(links, ["ord"]).select("type", "to_column", "name"), "type") == [
        ("FOREIGN_KEY", None, "first"), ("OTHER", None, "third")
    ]


def test_neighbourhood_of_a_node(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("c", "d")], "source string, target string")
    inside, near = L.closed_neighbourhood(nodes, edges, "a")
    assert rows(inside, "id") == [("a",), ("b",), ("c",)] and near.count() == 2
    assert rows(L.closed_neighbourhood(nodes, edges.limit(0), "d")[0]) == [("d",)]


def test_a_second_load_replaces_everything_of_the_first(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    dump = "CREATE TABLE o (id INT, c_id INT REFERENCES o(id));\nINSERT INTO o VALUES (1, NULL);\n"
    ingest(spark, folder(d_sql=dump), "sql", out, "s")
    ingest(spark, folder(d_sql=dump), "sql", out, "other")
    first = C.read_catalog(spark, out, "tables").where("session_id = 's'").first()
    ingest(spark, folder(o_csv="id\n1\n2\n"), "csv", out, "s")
    tables = C.read_catalog(spark, out, "tables")
    second = tables.where("session_id = 's'").first()
    assert second["table_id"] == first["table_id"] and second["row_count"] == 2
    assert not os.path.exists(first["parquet_path"]) and spark.read.parquet(second["parquet_path"]).count() == 2
    assert rows(C.read_catalog(spark, out, "links").select("session_id")) == [("other",)]
    listing = C.table_listing(tables, C.read_catalog(spark, out, "columns")).where("session_id = 's'").first()
    assert [c["name"] for c in listing["columns"]] == ["id"]
    assert len(os.listdir(tmp_path / "out" / "parsed" / "s")) - 1 <= 1  # the load that counts, no other
    audit = C.audit_catalog(tables=tables, columns=C.read_catalog(spark, out, "columns"))
    assert audit.count() == 0


def test_deleted_sessions_leave_neither_rows_nor_description(spark, tmp_path):
    out = str(tmp_path / "out")
    uploads = [(s, "csv", "t.csv", bytearray(f"id\n{k}\n".encode())) for k, s in enumerate("abc")]
    files = spark.createDataFrame(uploads, "session_id string, format string, filename string, content binary")
    load_uploads(files, out, "batch-0")
    sessions = spark.createDataFrame([("a", "ready"), ("b", "ready"), ("c", "queued")], "session_id string, status string")
    C.commit(sessions, out, "batch-0")
    for _ in range(2):
        gone = C.delete_stored(sessions, out, sessions.where("session_id <> 'b'"))
        assert rows(gone) == [("a",)]
    assert rows(C.read_catalog(spark, out, "tables").select("session_id"), "session_id") == [("b",), ("c",)]
    assert rows(spark.read.parquet(f"{out}/rows").select("session_id"), "session_id") == [("b",), ("c",)]
    assert rows(spark.read.parquet(f"{out}/catalog/columns").select("session_id"), "session_id") == [("b",), ("c",)]
    assert rows(stored_table(spark, out, "b", "t")) == [(1, 0)]
    C.delete_stored(sessions, out, sessions.where("session_id = 'b'"))
    assert rows(C.read_catalog(spark, out, "tables").select("session_id")) == [("c",)]
