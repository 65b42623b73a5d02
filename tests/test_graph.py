import random

import pytest
from pyspark.sql import functions as F

from tablegraph.operators.paging import page_info, read_page
from tablegraph.operators.positions import parquet_with_row_id, with_row_id
from tablegraph.plans.row_graph import full_row_graph, hot_keys, plan_links, row_edge_counts, row_graph, with_edge_ids
from tests.conftest import rows

LINKS = "from_table string, to_table string, type string, from_column string, to_column string, name string, inverse_name string"


def links(spark, *pairs):
    return spark.createDataFrame(
        [(a, b, "FOREIGN_KEY", f, t, name, None) for a, b, f, t, name in pairs], LINKS
    )


def placed(spark, values, schema):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(values)], "_row_id bigint, " + schema)


@pytest.fixture
def shop(spark):
    return {
        "orders": placed(spark, [(10, 1), (11, 2), (12, 1)], "order_id int, customer_id int"),
        "customers": placed(spark, [(1, "Alice"), (2, "Bob"), (3, "Eve")], "customer_id int, name string"),
    }


TO_CUSTOMER = ("orders", "customers", "customer_id", "customer_id", "belongs to")


def test_rows_meet_their_targets(spark, shop):
    graph = row_graph(shop, links(spark, TO_CUSTOMER), "orders")
    assert rows(graph.edges.select("source", "target", "label"), "source") == [
        ("orders#0", "customers#0", "belongs to"),
        ("orders#1", "customers#1", "belongs to"),
        ("orders#2", "customers#0", "belongs to"),
    ]
    # Eve is not referenced, so she is not drawn.
    assert rows(graph.nodes.select("id", "label"), "id") == [
        ("customers#0", "1"), ("customers#1", "2"), ("orders#0", "10"), ("orders#1", "11"), ("orders#2", "12")
    ]
    assert graph.truncated.first()[0] is False


def test_row_content_is_kept_on_request(spark, shop):
    nodes = row_graph(shop, links(spark, TO_CUSTOMER), "orders", content=True).nodes
    assert nodes.where(F.col("id") == "customers#1").first()["row"] == '{"customer_id":2,"name":"Bob"}'


def test_more_rows_than_drawn(spark, shop):
    graph = row_graph(shop, links(spark, TO_CUSTOMER), "orders", limit=2)
    assert graph.nodes.where(F.col("table") == "orders").count() == 2
    assert graph.truncated.first()[0] is True


def test_composite_and_nameless_links_draw_nothing(spark, shop):
    unusable = links(spark, ("orders", "customers", "a,b", "c,d", None), ("orders", "customers", None, None, None),
                     ("orders", "customers", "", "x", None))
    graph = row_graph(shop, unusable, "orders")
    assert graph.edges.count() == 0 and graph.nodes.count() == 3


def test_link_declared_twice_gives_one_edge(spark, shop):
    twice = links(spark, TO_CUSTOMER, TO_CUSTOMER).withColumn("type", F.concat("type", F.monotonically_increasing_id()))
    assert row_graph(shop, twice, "orders").edges.count() == 3
    # Two different columns that meet in the same pair of rows under one label are one edge as well.
    tables = {
        "orders": placed(spark, [(1, 1), (1, 2)], "bill int, ship int"),
        "addresses": placed(spark, [(1,), (2,)], "id int"),
    }
    both = links(spark, ("orders", "addresses", "bill", "id", "x"), ("orders", "addresses", "ship", "id", "x"))
    assert rows(full_row_graph(tables, both).select("source_pos", "target_pos"), "source_pos", "target_pos") == [
        (0, 0), (1, 0), (1, 1)
    ]


def test_missing_keys_meet_nothing(spark):
    tables = {
        "a": placed(spark, [(None,), (float("nan"),), (float("inf"),), (1.0,)], "k double"),
        "b": placed(spark, [(None,), ("nan",), ("inf",), ("1",)], "k string"),
    }
    found = full_row_graph(tables, links(spark, ("a", "b", "k", "k", None)))
    assert rows(found.select("source_pos", "target_pos", "label")) == [(3, 3, "k → k")]


def test_edge_cap_keeps_the_first_edges(spark):
    tables = {
        "a": placed(spark, [(0,)] * 30, "k int"),
        "b": placed(spark, [(0,)] * 100, "k int"),
    }
    link = links(spark, ("a", "b", "k", "k", "x"))
    graph = row_graph(tables, link, "a", edge_cap=250)
    assert rows(graph.edges.select("source_pos", "target_pos"), "source_pos", "target_pos") == [
        (i // 100, i % 100) for i in range(250)
    ]
    assert graph.truncated.first()[0] is True
    assert row_graph(tables, link, "a", edge_cap=3000).truncated.first()[0] is False
    assert row_graph(tables, link, "a", edge_cap=3000, neighbour_cap=7).edges.count() == 210


def test_neighbour_cap_is_flagged(spark):
    tables = {"a": placed(spark, [(0,)] * 3, "k int"), "b": placed(spark, [(i,) for i in (5, 6, 0)], "k int")}
    link = links(spark, ("a", "b", "k", "k", "x"))
    graph = row_graph(tables, link, "a", neighbour_cap=2)
    assert graph.edges.count() == 0 and graph.truncated.first()[0] is True
    assert row_graph(tables, link, "a", neighbour_cap=3).truncated.first()[0] is False


def test_self_link_stays_on_the_page(spark):
    staff = placed(spark, [(1, None), (2, 1), (3, 9), (9, 1)], "id int, manager_id int")
    link = links(spark, ("staff", "staff", "manager_id", "id", "belongs to manager"))
    graph = row_graph({"staff": staff}, link, "staff", limit=3)
    assert rows(graph.edges.select("source", "target")) == [("staff#1", "staff#0")]
    assert full_row_graph({"staff": staff}, link).count() == 3


@pytest.mark.parametrize("seed", range(2))
def test_edges_match_brute_force_on_a_hot_key(spark, seed):
    rng = random.Random(seed)
    pool = [None, 1, 1, 1, 2, 3, 4, 5]
    left = [rng.choice(pool) for _ in range(60)]
    right = [rng.choice([None, 1.0, 1.0, 2.0, 2.5, float("nan")]) for _ in range(40)]
    tables = {"l": placed(spark, [(v,) for v in left], "k bigint"), "r": placed(spark, [(v,) for v in right], "k double")}
    link = links(spark, ("l", "r", "k", "k", "x"))
    expected = {
        (f"l#{i}", f"r#{j}", f"l#{i}|r#{j}|x")
        for i, a in enumerate(left)
        for j, b in enumerate(right)
        if a is not None and a == b  # 1 and 1.0 are one key; a missing or unordered value is none
    }
    assert set(rows(with_edge_ids(full_row_graph(tables, link)).select("source", "target", "id"))) == expected
    assert row_edge_counts(tables, plan_links(link, tables)).first()["n_edges"] == len(expected)


def test_limits_are_checked(spark, shop):
    for limit in (0, 201):
        with pytest.raises(ValueError):
            row_graph(shop, links(spark, TO_CUSTOMER), "orders", limit=limit)


def test_pages(spark, tmp_path):
    cities = ["Hanoi", "Hue", "HCM", None, "Vinh"]
    df = placed(spark, [(i, city) for i, city in enumerate(cities)], "id int, city string")
    assert [row["id"] for row in read_page(df, 1, 2).collect()] == [1, 2]
    assert read_page(df, 99, 2).collect() == []
    assert tuple(page_info(df, 2, 2).first()) == (2, 2, 5, 3, 4, True, True)
    assert tuple(page_info(df, 99, 2, total=5).first()) == (99, 2, 5, None, None, True, False)
    for offset, limit in ((-1, 5), (0, 0), (0, 501)):
        with pytest.raises(ValueError):
            read_page(df, offset, limit)


def test_late_page_reads_only_its_row_groups(spark, tmp_path):
    path = str(tmp_path / "ids.parquet")
    spark.range(0, 50000, 1, 8).select(F.col("id").alias("_row_id"), "id").write.parquet(path)
    page = read_page(spark.read.parquet(path), 49990, 5)
    assert [row["id"] for row in page.collect()] == list(range(49990, 49995))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_row_id,49990)" in plan and "LessThan(_row_id,49995)" in plan


def test_positions_over_many_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 3000, 1, 7).write.parquet(path)
    got = rows(parquet_with_row_id(spark, path).select("_row_id", "id"), "_row_id")
    assert got == [(i, i) for i in range(3000)]


def test_positions_in_a_given_order(spark):
    values = list(range(2000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v int, g int").repartition(9)
    got = rows(with_row_id(df, "g", F.desc("v")).select("v", "g", "_row_id"), "_row_id")
    assert [(v, g) for v, g, _ in got] == sorted(((v, v % 7) for v in values), key=lambda p: (p[1], -p[0]))
    assert [position for _, _, position in got] == list(range(2000))


@pytest.mark.parametrize("key", [7, "seven"])
def test_hot_keys_are_dealt_over_cells(spark, key):
    """A key with a third of both sides gives each pair once, from many cells."""
    kind = "string" if isinstance(key, str) else "long"

    def table(n):
        values = [key if i % 3 == 0 else (None if i % 31 == 0 else type(key)(100 + i % 50)) for i in range(n)]
        return spark.createDataFrame(list(enumerate(values)), f"_row_id long, k {kind}"), values

    (left, a), (right, b) = table(240), table(150)
    tables, link = {"a": left, "b": right}, links(spark, ("a", "b", "k", "k", None))
    planned = plan_links(link, tables)
    hot = hot_keys(tables, planned, hot_rows=40)
    assert hot == {planned[0].ord: [(str(key), 80, 50)]} and hot_keys(tables, planned) == {}
    expected = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and x == y)
    for edges in (full_row_graph(tables, link, hot_rows=40, cell_rows=9), full_row_graph(tables, link)):
        assert sorted(rows(edges.select("source_pos", "target_pos"))) == expected
    assert full_row_graph(tables, link, most_edges=len(expected)).count() == len(expected)
    with pytest.raises(ValueError, match=f"{len(expected)} edges"):
        full_row_graph(tables, link, most_edges=len(expected) - 1)
