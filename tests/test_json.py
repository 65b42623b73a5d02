import json
import random

import pytest
from pyspark.sql import functions as F

from tablegraph.sources import json as J
from tablegraph.sources.json import (
    describe_records,
    flatten_entries,
    flatten_json,
    infer_json_types,
    json_dataset,
    pivot_flat,
    read_json_documents,
    read_json_tables,
    root_kind,
)
from tests.conftest import rows


def test_array_is_one_table(spark, folder):
    tables = read_json_tables(spark, folder(people_json='[{"id":1,"name":"alice"}]'))
    assert {name: rows(df) for name, df in tables.items()} == {"people": [(1, "alice")]}


def test_record_sets(spark, folder):
    tables = read_json_tables(spark, folder(all_json='{"customers":[{"id":1}],"orders":[{"id":9}],"n":3}'))
    assert {name: rows(df) for name, df in tables.items()} == {"customers": [(1,)], "orders": [(9,)]}


def test_single_object(spark, folder):
    tables = read_json_tables(spark, folder(config_json='{"id":1,"name":"alice"}'))
    assert rows(tables["config"]) == [(1, "alice")]


def test_nested_objects_are_dotted(spark, folder):
    dataset = json_dataset(spark, folder(p_json='[{"id":1,"address":{"city":"Hanoi","geo":{"lat":21.0}}}]'))
    assert dataset.columns["p"] == [("id", "integer"), ("address.city", "string"), ("address.geo.lat", "float")]
    assert rows(dataset.tables["p"].drop("_row_id")) == [(1, "Hanoi", 21.0)]


def test_sparse_records_keep_first_seen_order(spark, folder):
    dataset = json_dataset(spark, folder(s_json='[{"b":1},{"a":2,"b":3}]'))
    assert [name for name, _ in dataset.columns["s"]] == ["b", "a"]
    assert rows(dataset.tables["s"], "_row_id") == [(0, 1, None), (1, 3, 2)]


@pytest.mark.parametrize(
    ("value", "label"),
    [("true", "boolean"), ("1", "integer"), ("1.5", "float"), ('["x"]', "array"), ('"x"', "string"), ("null", "null")],
)
def test_type_names(spark, folder, value, label):
    assert json_dataset(spark, folder(t_json=f'[{{"f":{value}}}]')).columns["t"] == [("f", label)]


@pytest.mark.parametrize("big", ["9" * 20, "9" * 45])
def test_integers_past_64_bits_beside_fractions(spark, folder, big):
    texts = [f'{{"f":{big},"s":"1.5","v":[1.5,2]}}', f'{{"f":{big}.0,"s":"1.5","v":[1.5,2]}}']
    for order, label in ((texts, "float"), (texts[::-1], "float"), (texts[:1], "integer")):
        dataset = json_dataset(spark, folder(t_json="[" + ",".join(order) + "]"))
        assert dict(dataset.columns["t"])["f"] == label


def test_scalar_root_and_broken_text_fail(spark, folder):
    for content in ("42", '{"id":', '[{"id":1}'):
        with pytest.raises(Exception, match="root must be|[Mm]alformed|MALFORMED"):
            read_json_tables(spark, folder(bad_json=content))


def test_root_kinds(spark, folder):
    docs = read_json_documents(spark, folder(a_json="[1]", b_json="{}", c_json="42", d_json="{"))
    assert rows(docs.select("name", root_kind(F.col("doc"))), "name") == [
        ("a", "array"), ("b", "object"), ("c", "scalar"), ("d", "invalid")
    ]


def test_tables_without_records(spark, folder):
    dataset = json_dataset(spark, folder(x_json='{"a":[],"b":[1,"{}"],"c":[{"id":1}]}'))
    assert dataset.columns == {"a": [], "b": [], "c": [("id", "integer")]}
    assert dataset.tables["b"].count() == 0


def test_same_table_from_two_files_is_refused(spark, folder):
    with pytest.raises(ValueError, match="more than one file"):
        read_json_tables(spark, folder(a_json='{"t":[{"id":1}]}', b_json='{"t":[{"id":2}]}'))


# Texts of values, and what each counts as; a null says nothing.
LEAVES = {
    "1": "integer", "-2": "integer", "2.0": "float", "1e3": "float", "true": "boolean", "null": None, '"s"': "string",
    '"2.0"': "string", '"{"': "string", "[1,{}]": "array", "[]": "array",
}
# Type of a column by all that it holds; any other mixture is a string.
TYPES = {
    "": "null", "boolean": "boolean", "integer": "integer", "float": "float", "array": "array", "boolean integer": "integer",
    "boolean float": "float", "float integer": "float", "boolean float integer": "float",
}


def _made(rng, depth, above=""):
    """A random object as text, with the (path, value text) of its leaves in order."""
    text, leaves = [], []
    for key in rng.sample(["a", "b", "c", "a.b", "x y", 'q"t'], rng.randint(0, 4)):
        if depth and rng.random() < 0.35:
            value, below = _made(rng, depth - 1, f"{above}{key}.")
        else:
            value = rng.choice(list(LEAVES))
            below = [(above + key, value)]
        text.append(f"{json.dumps(key)}:{value}")
        leaves += below
    return "{" + ",".join(text) + "}", leaves


@pytest.mark.parametrize("seed", range(2))
def test_flattening_of_random_records(spark, seed):
    rng = random.Random(seed)
    made = [_made(rng, 3) for _ in range(60)]
    data = [("t", i, text) for i, (text, _) in enumerate(made)]
    records = spark.createDataFrame(data, "table string, pos int, record string")
    # Of two leaves with one path the last counts, in the place of the first.
    flat = [dict(leaves) for _, leaves in made]
    held = {path: {LEAVES[record[path]] for record in flat if path in record} - {None} for record in flat for path in record}
    expected = [(path, TYPES.get(" ".join(sorted(kinds)), "string")) for path, kinds in held.items()]

    long_form = infer_json_types(flatten_json(records)).orderBy("first").collect()
    by_shape = describe_records(records).orderBy("first").collect()
    assert {(r["path"], r["inferred_type"]) for r in long_form} == set(expected)
    assert [(r["path"], r["inferred_type"]) for r in long_form] == [(r["path"], r["inferred_type"]) for r in by_shape]

    wide = pivot_flat(flatten_entries(records), [(r["path"], "string") for r in by_shape]).orderBy("pos").collect()
    for row, record in zip(wide, flat, strict=True):
        for path, _ in expected:
            want = json.loads(record.get(path, "null"))
            got = row[path] if want is None or isinstance(want, str) or row[path] is None else json.loads(row[path])
            assert got == want


def test_documents_without_tables_are_told(spark):
    docs = {
        "object": '{"a":1}', "array": ' [{"a":1}] ', "scalar": "42", "text": '"x"', "null": "null", "empty": "", "cut": '{"id":',
        "two": '{"a":1}\n{"a":2}', "listed": '{"a":1},{"a":2}', "closed": '{"a":1}]', "closed twice": '{"a":1}}', "stray": "],[",
    }
    table = spark.createDataFrame(list(docs.items()), "name string, doc string")
    told = {row["name"]: row["reason"] for row in J.json_rejects(table).collect()}
    assert told == {name: "scalar" if name in ("scalar", "text", "null") else "invalid" for name in docs if name not in ("object", "array")}
    records = J.json_record_sets(table, strict=False).collect()
    assert sorted((row["name"], row["record"]) for row in records) == [("array", '{"a":1}'), ("object", '{"a":1}')]
    for name in ("two", "listed", "closed", "closed twice"):
        with pytest.raises(Exception, match="(?i)more than one value|malformed"):
            J.json_record_sets(table.where(F.col("name") == name)).collect()
