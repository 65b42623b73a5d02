"""JSON documents as tables: record sets, nested objects as dotted columns, widened types.

Records stay one row each throughout. Flattening works inside the row on an
array of entries, so building a table needs no shuffle; the long form (one row
per value) exists for questions about columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.functions.text import quoted
from tablegraph.operators.positions import ROW_ID
from tablegraph.session import work_path
from tablegraph.sources.dataset import Dataset
from tablegraph.sources.listing import stem, table_entry

PATH_SEPARATOR = "."

#: A document is parsed as one text, so a file past this size is refused.
MAX_DOCUMENT_BYTES = 1024 * 1024 * 1024


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: the table name it gives and its whole text.

    Raises inside the job when a file is too large to be one text.
    """
    size = F.col("_metadata.file_size")
    checked = F.when(
        size > MAX_DOCUMENT_BYTES,
        F.raise_error(F.concat(F.col("_metadata.file_path"), F.lit(": larger than one document may be"))),
    ).otherwise(F.col("value"))
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(stem(table_entry(F.col("_metadata.file_path"))).alias("name"), checked.alias("doc"))
    )


def root_kind(doc: Column) -> Column:
    """``object``, ``array``, ``scalar``, or ``invalid`` when the text is not JSON."""
    parsed = F.try_parse_json(doc)
    schema = F.schema_of_variant(parsed)
    return (
        F.when(parsed.isNull(), "invalid")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("scalar")
    )


def _kind(schema: Column, raw: Column) -> Column:
    """The JSON kind of a value, from its variant schema and its own text."""
    return (
        F.when(schema.isNull() | (schema == "VOID"), "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(raw.rlike("[.eE]"), "float")
        .otherwise("integer")
    )


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _last_of_each(items: Column, keys: Column) -> Column:
    """Items whose key does not occur again later; the usual case costs one comparison."""
    later = lambda item, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), items).otherwise(F.filter(items, later))


def object_entries(text: Column, prefix: Column | None = None, order: Column | None = None) -> Column:
    """The members of one JSON object: path, order, kind and raw text, in written order.

    Key order and number text come from a map of raw texts, kinds from a map of
    variants read from the same object. A repeated key keeps its first place
    and its last value.
    """
    parsed = F.struct(
        F.from_json(text, "map<string,string>").alias("raw"),
        F.from_json(text, "map<string,variant>").alias("typed"),
    )

    def members(maps: Column) -> Column:
        keys = F.map_keys(maps["raw"])
        shapes = F.transform(F.map_values(maps["typed"]), lambda v: F.schema_of_variant(v))
        found = F.arrays_zip(keys.alias("key"), F.map_values(maps["raw"]).alias("raw"), shapes.alias("shape"))

        def entry(member: Column) -> Column:
            key, value = member["key"], member["raw"]
            place = F.array((F.array_position(keys, key) - 1).cast("int"))
            return F.struct(
                (key if prefix is None else F.concat(prefix, F.lit(PATH_SEPARATOR), key)).alias("path"),
                (place if order is None else F.concat(order, place)).alias("ord"),
                _kind(member["shape"], value).alias("kind"),
                F.when(member["shape"] != "VOID", value).alias("value"),
            )

        return F.transform(_last_of_each(found, keys), entry)

    return _bind(parsed, members)


def document_fault(doc: Column) -> Column:
    """Why a document holds no tables: ``invalid`` when it is not one JSON value, ``scalar`` when that is neither
    object nor array; null when it may hold some.

    A parser stops at the end of the first value, so the document is read as the item of a list and as the member of
    an object: text behind it breaks one of the two or makes it two items.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"d":'), doc, F.lit("}")))
    item = lambda k: F.try_variant_get(listed, f"$[{k}]", "variant")
    shape = F.schema_of_variant(item(0))
    one = listed.isNotNull() & member.isNotNull() & item(0).isNotNull() & item(1).isNull()
    return F.when(~one, "invalid").when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), "scalar")


def json_rejects(docs: DataFrame) -> DataFrame:
    """The documents that hold no tables, with the reason."""
    return docs.select("name", document_fault(F.col("doc")).alias("reason")).where("reason is not null")


def json_record_sets(docs: DataFrame, strict: bool = True) -> DataFrame:
    """The tables in each document: one row per record, with its position in its table.

    An array is one table. An object with list values is one table per such
    key, its other keys dropped; an object without lists is a table of one row.
    List items that are not objects are skipped, and a list without any object
    leaves a row with neither position nor record, so its table is not lost.
    A document without tables ends the job; unless ``strict`` it gives no rows
    and is left to ``json_rejects``.
    """
    doc = F.col("doc")
    if strict:
        alone = (F.size(F.from_json(F.concat(F.lit("["), doc, F.lit("]")), "array<string>", _STRICT)) == 1) & F.from_json(
            F.concat(F.lit('{"d":'), doc, F.lit("}")), "map<string,string>", _STRICT
        ).isNotNull()
        several = F.raise_error(F.concat(F.col("name"), F.lit(": more than one value")))
        checked = docs.select("name", F.when(alone, doc).otherwise(several).alias("doc"))
    else:
        checked = docs.where(document_fault(doc).isNull())
    return _tables(checked).select(
        "name", "table", F.posexplode_outer("records").alias("pos", "record")
    )


#: Text that is not JSON ends the job, as a file of it ends a load.
_STRICT = {"mode": "FAILFAST"}


def _objects(text: Column) -> Column:
    """The objects of an array, as texts.

    An item's text tells an object from all but a string that starts with a
    brace; only an array that may hold one is parsed again to be sure.
    """
    items = F.from_json(text, "array<string>", _STRICT)
    shapes = F.transform(F.from_json(text, "array<variant>"), lambda v: F.schema_of_variant(v))
    checked = F.filter(
        F.arrays_zip(items.alias("raw"), shapes.alias("shape")), lambda item: item["shape"].startswith("OBJECT")
    )
    return F.when(
        text.rlike(r'"\s*\{'), F.transform(checked, lambda item: item["raw"])
    ).otherwise(F.filter(items, lambda item: item.startswith("{")))


def _tables(docs: DataFrame) -> DataFrame:
    """One row per table of a document, its object records as an array of texts."""
    doc = F.col("doc")
    opening = F.substring(F.ltrim(doc), 1, 1)

    def table(name: Column, records: Column) -> Column:
        return F.struct(name.cast("string").alias("table"), records.alias("records"))

    lists = F.filter(object_entries(doc), lambda e: e["kind"] == "array")
    whole = F.when(F.from_json(doc, "map<string,string>", _STRICT).isNotNull(), F.array(table(F.col("name"), F.array(doc))))
    sets = (
        F.when(opening == "[", F.array(table(F.col("name"), _objects(doc))))
        .when((opening == "{") & ~doc.contains("["), whole)
        .when(
            opening == "{",
            _bind(
                lists,
                lambda found: F.when(
                    F.size(found) > 0, F.transform(found, lambda e: table(e["path"], _objects(e["value"])))
                ).otherwise(whole),
            ),
        )
        .otherwise(
            F.raise_error(F.concat(F.col("name"), F.lit(": the root must be an object or an array")))
        )
    )
    return docs.select("name", F.inline(sets))


def nesting_depth(text: Column) -> Column:
    """How many levels of objects a text holds, counting braces outside of strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    level = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(seen: Column, brace: Column) -> Column:
        now = seen["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    return F.aggregate(braces, level, step, lambda seen: seen["most"])


def flatten_entries(records: DataFrame, record: str = "record", depth: int | None = None) -> DataFrame:
    """Add ``entries``: each record's leaves under their dotted paths.

    Objects are opened level by level inside the row. The number of levels is
    the deepest nesting of the input, found by one aggregate unless given.
    A leaf written twice under one dotted path keeps the later value.
    """
    if depth is None:
        depth = records.agg(F.max(nesting_depth(quoted(record)))).first()[0] or 0
    entries = object_entries(quoted(record))
    for _ in range(max(depth - 1, 0)):
        opened = F.transform(
            entries,
            lambda e: F.when(
                e["kind"] == "object", object_entries(e["value"], e["path"], e["ord"])
            ).otherwise(F.array(e)),
        )
        entries = F.flatten(opened)
    leaves = F.filter(entries, lambda e: e["kind"] != "object")
    return records.withColumn("entries", _bind(leaves, _one_per_path))


def _one_per_path(leaves: Column) -> Column:
    """A path written twice in one record (``a.b`` and ``a: {b}``): its first place, its last value."""
    paths = F.transform(leaves, lambda e: e["path"])

    def merged(found: Column) -> Column:
        last = F.filter(leaves, lambda e, i: ~F.array_contains(F.slice(found, i + 2, F.size(found)), e["path"]))
        return F.transform(
            last,
            lambda e: F.struct(
                e["path"].alias("path"),
                F.get(leaves, F.array_position(found, e["path"]).cast("int") - 1)["ord"].alias("ord"),
                e["kind"].alias("kind"),
                e["value"].alias("value"),
            ),
        )

    return F.when(F.size(F.array_distinct(paths)) == F.size(leaves), leaves).otherwise(_bind(paths, merged))


def flatten_json(records: DataFrame, record: str = "record", depth: int | None = None) -> DataFrame:
    """The long form: one row per leaf, with path, order in the record, kind and raw text."""
    keys = [name for name in records.columns if name != record]
    flat = flatten_entries(records, record, depth)
    # The outer form keeps the planner from testing the entries for emptiness
    # first, which would compute them more than once.
    return flat.select(*map(quoted, keys), F.inline_outer("entries")).where(F.col("path").isNotNull())


def infer_json_types(flat: DataFrame) -> DataFrame:
    """One row per table and path: its place among the columns and its widened type.

    Kinds are gathered as a set of at most six names, combined before the shuffle.
    """
    seen = flat.groupBy("table", "path").agg(
        F.min(F.struct("pos", "ord")).alias("first"),
        F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))).alias("kinds"),
    )
    kinds = F.col("kinds")

    def only(*names: str) -> Column:
        return F.forall(kinds, lambda kind: kind.isin(*names))

    label = (
        F.when(F.size(kinds) == 0, "null")
        .when(only("boolean"), "boolean")
        .when(only("boolean", "integer"), "integer")
        .when(only("boolean", "integer", "float"), "float")
        .when(only("array"), "array")
        .otherwise("string")
    )
    return seen.select("table", "path", "first", label.alias("inferred_type"))


# JSON type labels and the Spark type each is stored as.
STORED_TYPES = {
    "boolean": "boolean",
    "integer": "bigint",
    "float": "double",
    "array": "string",
    "string": "string",
    "null": "string",
}


def _number_forms(text: Column) -> Column:
    """What is left of a record when its strings and flat arrays are emptied and its numbers told apart only as
    fractions and integers."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), r"\[[^\[\]{}]*+\]", "[]")
    bare = F.regexp_replace(bare, r"-?[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+)", "f")
    return F.regexp_replace(bare, "-?[0-9]+", "i")


def describe_records(records: DataFrame) -> DataFrame:
    """``infer_json_types`` over the records themselves, at the price of one parse each.

    Records of one shape (the same keys with the same kinds) say the same about
    the columns, and the first of them decides the order. So shapes are counted
    with a combine before the shuffle, and only one record per shape is flattened.
    Past 64 bits a fraction and an integer may share a shape; such records are
    told apart by the forms of their numbers as well.
    """
    spark = records.sparkSession
    shape = F.schema_of_variant(F.parse_json("record"))
    vague = F.col("shape").rlike(r"DOUBLE|DECIMAL\((?:19|[23][0-9]),0\)")
    shaped = records.select("table", "pos", shape.alias("shape"), "record")
    forms = F.when(vague, F.xxhash64(_number_forms(F.col("record"))))
    firsts = shaped.groupBy("table", "shape", forms.alias("forms")).agg(F.min("pos").alias("pos"))
    # Stored, so that the planner knows their size before it joins the records.
    stage = work_path(spark, "shapes")
    firsts.select("table", "pos").write.parquet(stage)
    chosen = records.select("table", "pos", "record").join(
        spark.read.parquet(stage), ["table", "pos"], "left_semi"
    )
    return infer_json_types(flatten_json(chosen))


def _typed(text: Column, path: str, label: str) -> Column:
    target = STORED_TYPES[label]
    if target in ("bigint", "double"):
        # A column of numbers may hold booleans, which count as 1 and 0.
        text = F.when(text == "true", "1").when(text == "false", "0").otherwise(text)
    return (text if target == "string" else text.cast(target)).alias(path)


def pivot_flat(flat: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Records of one table as rows with the given ``(path, type)`` columns.

    Takes the output of ``flatten_entries``. Absent keys are null. Each row is
    built from its own entries, so nothing is shuffled.
    """
    pairs = F.transform("entries", lambda e: F.struct(e["path"], e["value"]))
    keep = [name for name in flat.columns if name not in ("entries", "record")]
    mapped = flat.withColumn("entries", F.map_from_entries(pairs))
    values = [
        _typed(F.try_element_at(F.col("entries"), F.lit(path)), path, label) for path, label in columns
    ]
    return mapped.select(*map(quoted, keep), *values)


def _path_tree(paths: list[str]) -> dict | None:
    """The nesting that the dotted paths amount to, None when it is not certain.

    It is not when a path is both a value and an object, as ``a`` and ``a.b``.
    """
    tree: dict = {}
    for path in paths:
        node = tree
        *outer, last = path.split(PATH_SEPARATOR)
        for part in outer:
            node = node.setdefault(part, {})
            if node is None:
                return None
        if last in node:
            return None
        node[last] = None
    return tree


def _tree_schema(tree: dict) -> str:
    def name(part: str) -> str:
        return "`" + part.replace("`", "``") + "`"

    return ", ".join(
        f"{name(part)}: string" if inner is None else f"{name(part)}: struct<{_tree_schema(inner)}>"
        for part, inner in tree.items()
    )


def json_table(records: DataFrame, columns: list[tuple[str, str]], dotted_keys: bool) -> DataFrame:
    """Records of one table as rows, read by one parse under the columns' own schema.

    Records whose keys hold dots, or whose paths are objects in one record and
    values in another, are flattened entry by entry instead.
    """
    tree = None if dotted_keys else _path_tree([path for path, _ in columns])
    if tree is None or not columns:
        return pivot_flat(flatten_entries(records), columns)
    keep = [name for name in records.columns if name != "record"]
    parsed = records.select(
        *map(quoted, keep), F.from_json("record", f"struct<{_tree_schema(tree)}>").alias("_record")
    )

    def value(path: str) -> Column:
        found = F.col("_record")
        for part in path.split(PATH_SEPARATOR):
            found = found.getField(part)
        return found

    return parsed.select(*map(quoted, keep), *[_typed(value(path), path, label) for path, label in columns])


def has_dotted_keys(records: DataFrame) -> bool:
    """Whether some key holds a dot itself, so that a path does not tell the nesting."""
    return not records.where(F.col("record").rlike(r'"[^"]*\.[^"]*"\s*:')).isEmpty()


def json_dataset(spark: SparkSession, path: str) -> Dataset:
    """Every record set below the path as a typed table, columns in first-seen order.

    Documents are cut into records once and stored by table; each table is then
    described and read from its own records.
    """
    stage = work_path(spark, "records")
    json_record_sets(read_json_documents(spark, path)).write.partitionBy("table").parquet(stage)
    schema = "name string, pos int, record string, table string"
    records = spark.read.schema(schema).parquet(stage)
    sources = records.groupBy("table").agg(F.count_distinct("name").alias("files")).orderBy("table").collect()
    for row in sources:
        if row["files"] > 1:
            raise ValueError(f"{row['table']}: named by more than one file")
    found = records.where(F.col("record").isNotNull())
    columns: dict[str, list[tuple[str, str]]] = {row["table"]: [] for row in sources}
    for row in describe_records(found).orderBy("table", "first").collect():
        columns[row["table"]].append((row["path"], row["inferred_type"]))

    dotted = has_dotted_keys(found)
    tables = {}
    for name, described in columns.items():
        own = found.where(F.col("table") == name).select(F.col("pos").cast("bigint").alias(ROW_ID), "record")
        tables[name] = json_table(own, described, dotted)
    return Dataset(tables, columns)


def read_json_tables(spark: SparkSession, path: str, positions: bool = False) -> dict[str, DataFrame]:
    """The tables of ``json_dataset``."""
    tables = json_dataset(spark, path).tables
    return tables if positions else {name: df.drop(ROW_ID) for name, df in tables.items()}
