import random
import re

import pytest
from pyspark.sql import functions as F

from tablegraph.sources import dump as D
from tablegraph.sources.dump import dump_columns, dump_links, dump_statements, read_dump_tables
from tests.conftest import rows

CUSTOMERS = "CREATE TABLE customers (id INTEGER PRIMARY KEY, name TEXT);\n"


def links(spark, path):
    found = dump_links(dump_statements(spark, path)).orderBy("stmt_no", "item_no")
    return rows(found.drop("stmt_no", "item_no"))


def test_columns_and_rows(spark, folder):
    path = folder(d_sql=CUSTOMERS + "INSERT INTO customers (id, name) VALUES (1, 'alice'), (2, 'bob');\n")
    assert rows(dump_columns(dump_statements(spark, path)), "position") == [
        ("customers", 0, "id", "INT"), ("customers", 1, "name", "TEXT")
    ]
    assert rows(read_dump_tables(spark, path)["customers"], "id") == [(1, "alice"), (2, "bob")]


def test_rows_without_a_column_list(spark, folder):
    path = folder(d_sql=CUSTOMERS + "INSERT INTO customers VALUES (1, 'a');\nINSERT INTO customers VALUES (2, 'b');\n")
    tables = read_dump_tables(spark, path, positions=True)
    assert rows(tables["customers"], "_row_id") == [(1, "a", 0), (2, "b", 1)]


def test_foreign_keys_in_every_place(spark, folder):
    path = folder(
        d_sql=CUSTOMERS
        + """CREATE TABLE orders (id INT, customer_id INT, FOREIGN KEY (customer_id) REFERENCES customers(id));
CREATE TABLE employees (id INT, manager_id INT REFERENCES employees(id));
CREATE TABLE sales (sku INT REFERENCES products(sku), paid INT REFERENCES invoices(paid));
CREATE TABLE parts (plant INT, part INT, FOREIGN KEY (plant, part) REFERENCES public.parts (plant, part));
CREATE TABLE notes (id INT, o INT);
ALTER TABLE ONLY public.notes ADD CONSTRAINT n FOREIGN KEY (o) REFERENCES public.orders;
ALTER TABLE notes OWNER TO postgres;
ALTER TABLE ghost ADD CONSTRAINT g FOREIGN KEY (o) REFERENCES orders(id);
"""
    )
    assert links(spark, path) == [
        ("orders", "customers", "FOREIGN_KEY", "customer_id", "id", "belongs to", "has many"),
        ("employees", "employees", "FOREIGN_KEY", "manager_id", "id", "belongs to manager", "has many manager"),
        ("sales", "products", "FOREIGN_KEY", "sku", "sku", "belongs to", "has many"),
        ("sales", "invoices", "FOREIGN_KEY", "paid", "paid", "belongs to", "has many"),
        ("parts", "parts", "FOREIGN_KEY", "plant,part", "plant,part", "belongs to", "has many"),
        ("notes", "orders", "FOREIGN_KEY", "o", None, "belongs to", "has many"),
    ]


def test_table_without_rows_keeps_its_columns(spark, folder):
    tables = read_dump_tables(spark, folder(d_sql="CREATE TABLE empty_table (id INTEGER, label TEXT);\n"))
    assert tables["empty_table"].columns == ["id", "label"] and tables["empty_table"].count() == 0


def test_destructive_and_undeclared_statements(spark, folder):
    path = folder(d_sql="DROP TABLE customers;\n" + CUSTOMERS + "TRUNCATE customers;\nINSERT INTO ghost VALUES (1);\n")
    assert list(read_dump_tables(spark, path)) == ["customers"]


def test_rows_before_their_table_are_dropped(spark, folder):
    path = folder(d_sql="INSERT INTO customers VALUES (1, 'early');\n" + CUSTOMERS + "INSERT INTO customers VALUES (2, NULL);\n")
    assert rows(read_dump_tables(spark, path)["customers"]) == [(2, None)]


def test_files_share_one_state_in_name_order(spark, folder):
    path = folder(a_sql=CUSTOMERS, b_sql="INSERT INTO customers (name) VALUES ('x');\n")
    assert rows(read_dump_tables(spark, path)["customers"]) == [(None, "x")]


def test_later_create_replaces_columns(spark, folder):
    path = folder(d_sql=CUSTOMERS + "CREATE TABLE customers (code TEXT);\nINSERT INTO customers VALUES ('z');\n")
    assert rows(read_dump_tables(spark, path)["customers"]) == [("z",)]


TRICKY = CUSTOMERS + r"""-- it's a comment; with 'marks
/* another; ' one */
INSERT INTO customers VALUES (1, 'semi;
colon (''quoted'') -- not a comment');
INSERT INTO customers VALUES (2, E'it\'s; \n'), (-3, 'a,b'), (+4, now());
CREATE FUNCTION f() RETURNS void AS $body$ BEGIN
INSERT INTO customers VALUES (9, 'never');
END; $body$ LANGUAGE plpgsql;
INSERT INTO customers VALUES (5, $$not; one$$);
"""


def test_strings_comments_and_function_bodies(spark, folder):
    table = read_dump_tables(spark, folder(d_sql=TRICKY), positions=True)["customers"]
    assert rows(table, "_row_id") == [
        (1, "semi;\ncolon ('quoted') -- not a comment", 0),
        (2, "it's; \n", 1),
        (-3, "a,b", 2),
        (4, "now()", 3),
        (5, "not; one", 4),
    ]


def test_split_and_whole_reading_agree(spark, folder):
    inserts = "".join(f"INSERT INTO customers VALUES ({i}, 'n{i}');\n" for i in range(300))
    path = folder(a_sql=CUSTOMERS + inserts, b_sql="INSERT INTO customers VALUES (300, 'x;\ny');\n")
    stmts = dump_statements(spark, path)
    assert [row["stmt_no"] for row in stmts.orderBy("stmt_no").collect()] == list(range(302))
    assert stmts.groupBy("kind").count().where(F.col("kind") == "insert").first()["count"] == 301
    table = read_dump_tables(spark, path, positions=True)["customers"]
    assert [row["id"] for row in table.orderBy("_row_id").collect()] == list(range(301))


def test_types_follow_the_values(spark, folder):
    path = folder(
        d_sql="CREATE TABLE t (a INT, b INT, c BOOLEAN, d NUMERIC(10,2), e);\n"
        "INSERT INTO t VALUES (1, 1, true, 1, NULL);\nINSERT INTO t VALUES (2, 'x', FALSE, 1.5, NULL);\n"
    )
    df = read_dump_tables(spark, path)["t"]
    assert [kind for _, kind in df.dtypes] == ["bigint", "string", "boolean", "double", "string"]
    assert rows(df, "a") == [(1, "1", True, 1.0, None), (2, "x", False, 1.5, None)]
    labels = [row["inferred_type"] for row in dump_columns(dump_statements(spark, path)).orderBy("position").collect()]
    assert labels == ["INT", "INT", "BOOLEAN", "DECIMAL(10, 2)", "unknown"]


def test_nesting_arrays_dollar_quotes_and_tails(spark, folder):
    deep = "(" * 14 + "a > 0" + ")" * 14
    path = folder(
        d_sql=f"CREATE TABLE t (a INT, b TEXT DEFAULT ARRAY['x','y'], c TEXT[], CHECK ({deep}), d INT REFERENCES u (id));\n"
        "INSERT INTO t VALUES (1, ARRAY[1,2], 'x', 1) ON CONFLICT (a) DO NOTHING;\n"
        "INSERT INTO t (a, b, c) VALUES (2, $$a, (b$$, 'y]'), (3, $q$it's$q$, '(') RETURNING (a);\n"
        "INSERT INTO t VALUES (4, ((((((((2)))))))), f(g(h(1, ARRAY[2, 3]), 4), ')'), NULL);\n"
    )
    names = [row["name"] for row in dump_columns(dump_statements(spark, path)).orderBy("position").collect()]
    assert names == ["a", "b", "c", "d"]
    assert rows(read_dump_tables(spark, path)["t"], "a") == [
        (1, "ARRAY[1,2]", "x", 1),
        (2, "a, (b", "y]", None),
        (3, "it's", "(", None),
        (4, "((((((((2))))))))", "f(g(h(1, ARRAY[2, 3]), 4), ')')", None),
    ]
    assert links(spark, path) == [("t", "u", "FOREIGN_KEY", "d", "id", "belongs to", "has many")]


def test_integers_past_64_bits(spark, folder):
    path = folder(
        d_sql="CREATE TABLE t (a INT, b INT, c INT);\n"
        f"INSERT INTO t VALUES (99999999999999999999, 1, {'9' * 40}), (-1, 99999999999999999999, 1), (2, 0.5, 2);\n"
    )
    df = read_dump_tables(spark, path)["t"]
    assert [kind for _, kind in df.dtypes] == ["decimal(38,0)", "double", "string"]
    assert [int(row["a"]) for row in df.collect()] == [99999999999999999999, -1, 2]
    assert [row["c"] for row in df.collect()] == ["9" * 40, "1", "2"]


def pieces_in_turn(texts, end):
    """What cutting at statement ends and joining open pieces must give, walking character by character."""
    out, held, state, k = [], "", "", 0
    text = end.join(texts)
    while k < len(text):
        ch, rest = text[k], text[k:]
        step = 1
        if not state:
            if rest.startswith(end):
                out, held, k = [*out, held], "", k + len(end)
                continue
            mark = re.match(r"\$\w*\$", rest)
            if ch == "'":
                state = "E" if re.search(r"\b[eE]$", text[:k]) else "'"
            elif ch == '"':
                state = '"'
            elif rest[:2] in ("--", "/*"):
                state, step = rest[:2], 2
            elif mark:
                state, step = mark[0], len(mark[0])
        elif state == "E" and ch == "\\":
            step = 2
        elif state in ("'", "E") and rest[:2] == "''" or state == '"' and rest[:2] == '""':
            step = 2
        elif state in ("'", "E") and ch == "'" or state == '"' and ch == '"' or state == "--" and ch == "\n":
            state = ""
        elif state == "/*" and rest[:2] == "*/":
            state, step = "", 2
        elif state.startswith("$") and rest.startswith(state):
            state, step = "", len(state)
        held += text[k : k + step]
        k += step
    return [*out, held] if held else out


@pytest.mark.parametrize("end", [";\n", ";\r\n"])
def test_pieces_join_over_any_block_borders(spark, end):
    rng = random.Random(len(end))
    words = ["a", "b;", "c d", "e", "1, 2", "'", "''", '"', "--", "\n", "/*", "*/", "$$", "$x$", "$y$", "E'", " E'it\\'s", "it''s", "b c", "-", "/", "\\", "$"]
    for _ in range(2):
        texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
        want = pieces_in_turn(texts, end)
        for borders in (1, 3):
            data = [(t, "file:/d.sql", k // borders * 100) for k, t in enumerate(texts)]
            table = spark.createDataFrame(data, "value string, _file string, _block bigint").coalesce(1)
            got = [r["value"] for r in D.joined_pieces(table, end).orderBy("_block").collect()]
            assert got == want if borders == 1 else sorted(got) == sorted(want)


def test_a_value_with_statement_ends_is_cut_in_many_tasks(spark, folder):
    """CRLF, and statement ends inside values, comments and function bodies, in files far larger than a block."""
    body = "CREATE FUNCTION f() RETURNS void AS $b$ BEGIN;\n INSERT INTO t VALUES (0, 'no');\n END $b$ LANGUAGE sql;\n"
    lines = [f"INSERT INTO t VALUES ({k}, 'line; {k};\nnext -- ''{k}''') -- it's;\n;\n" for k in range(4000)]
    text = "CREATE TABLE t (id INT, note TEXT);\n" + body + "".join(lines)
    path = folder(d_sql=text, e_sql="CREATE TABLE u (id INT);\r\n" + "".join(f"INSERT INTO u VALUES ({k});\r\n" for k in range(300)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        stmts = D.dump_statements(spark, path)
        assert stmts.where("kind = 'insert' and target = 'u'").count() == 300
        tables = D.read_dump_tables(spark, path, positions=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = rows(tables["t"].select("_row_id", "id", "note"), "_row_id")
    assert got == [(k, k, f"line; {k};\nnext -- '{k}'") for k in range(4000)]
    assert rows(tables["u"], "_row_id") == [(k, k) for k in range(300)]


def test_interleaved_tables_keep_their_own_order(spark, folder):
    inserts = "".join(f"INSERT INTO {'ab'[k % 2]} VALUES ({k}), ({k + 100});\n" for k in range(20))
    path = folder(d_sql="CREATE TABLE a (x INT);\nCREATE TABLE b (x TEXT);\nCREATE TABLE c (x INT);\n" + inserts)
    tables = D.read_dump_tables(spark, path, positions=True)
    assert [r["x"] for r in rows_of(tables["a"])] == [v for k in range(0, 20, 2) for v in (k, k + 100)]
    assert [r["_row_id"] for r in rows_of(tables["b"])] == list(range(20)) and tables["c"].columns == ["x", "_row_id"]


def rows_of(df):
    return df.orderBy("_row_id").collect()


def test_statements_that_give_nothing_are_told(spark, folder):
    path = folder(d_sql=(
        "INSERT INTO a VALUES (1);\nCREATE TABLE a (x INT);\nINSERT INTO a SELECT 1;\nINSERT INTO a VALUES (1;\n"
        "INSERT INTO a VALUES (1), (2);\nCREATE TABLE b (CHECK (1 > 0));\n"
    ))
    unread = D.dump_unread(D.dump_statements(spark, path))
    assert rows(unread.select("stmt_no", "target", "reason"), "stmt_no") == [
        (0, "a", "no_table"), (2, "a", "no_values"), (3, "a", "no_rows"), (5, "b", "no_columns")
    ]
