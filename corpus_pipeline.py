"""From documents to packed training sequences: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of ``docs``; the
last returns the packed pieces. Documents are told apart by ``doc_id``: rows of one id stay or go together.
Rows without an id can be neither rejected nor linked and stay to the end. Empty tables pass through. Other
columns, whatever their names, are carried along. All but substring dedup, which cuts text, only drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegraph.llm import decontaminate, jaccard, packing, passages, quality
from tablegraph.llm.common import join_checked, saved
from tablegraph.llm.queries import ranks_path
from tablegraph.session import configure, work_path


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows with an id in ``ids``."""
    gone = saved(ids.where("doc_id is not null").select("doc_id").distinct(), "gone")
    return join_checked(docs, gone, ["doc_id"], "left_anti", 24).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents scored below the threshold; labels of the table ``labels`` train the classifier. Where
    they are too few to train one, nothing is known against any document and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored, fitted = quality.classified(docs, labels)
    return _without(docs, scored.where("predicted = 0")) if fitted else docs


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; of rows with one id, the one with
    the smallest text."""
    linked = saved(jaccard.link(docs), "linked")
    kept = _without(docs, linked.where("component_id <> doc_id"))
    again = saved(linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    single = join_checked(kept, again, ["doc_id"], "left_anti", 24)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Each row is carried as one value, so that no column of it meets a name of this function.
    rows = join_checked(kept, again, ["doc_id"], "left_semi", 24).select("doc_id", "text", F.struct(*columns).alias("row"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    several = rows.select("row", place.alias("place")).where("place = 1")
    return single.select(*columns).unionByName(several.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from all documents but the one with the smallest id; a document of which nothing
    is left goes."""
    cut = passages.without_repeats(docs, passages.shared_passages(docs))
    return cut.where("text is null or text <> ''")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the table ``benchmark``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(docs, benchmark))


def multi_length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences: one row per piece."""
    return packing.pack(docs, ranks_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", multi_length_packing),
]

#: SQL can't express the tokenizer, the classifier or the embeddings; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
