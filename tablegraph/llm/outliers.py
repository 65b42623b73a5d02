"""Quality rules: base rules, and robust outliers by minimum covariance determinant per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm.common import join_checked, saved

_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a window that may repeat.
WINDOW = 5
#: Transformed statistics of a text with words.
DIMS = ("x0", "x1", "x2", "x3", "x4")
#: Standard deviation added to each statistic: most texts have no symbols or repeats at all, and a subset of
#: them has no variance there.
FLOORS = (0.2, 0.15, 0.15, 0.25, 0.25)
#: Share of a group's rows whose covariance determinant is made small.
SUBSET = 0.75
#: Makes the covariance of the innermost 75 % of a 5-dimensional normal consistent:
#: 0.75 / P(chi2 with 7 degrees <= 6.63).
CONSISTENCY = 1.41
#: Rows by which a group's estimate leans on that of its language, and a language's on all.
LEAN = 50
STEPS = 3
#: Squared robust distance beyond which a text is rejected: chi2 with 5 degrees passes it once in 10,000.
CUTOFF = 25.74


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda at: F.slice(words, at, WINDOW))
    coded = F.transform(grams, lambda gram, at: F.struct(F.xxhash64(gram).alias("g"), at.alias("at")))
    return F.when(F.size(words) < WINDOW + 1, F.array().cast("array<struct<g:bigint,at:int>>")).otherwise(coded)


def text_counts(docs: DataFrame) -> DataFrame:
    """The base counts of every whole text, with ``lang``, ``source`` and the number of lines that hold words.

    Each count is one expression over an array of words or lines; repeated windows are found by sorting the
    window hashes inside the row, and only in texts whose windows are not all distinct.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(_WORD)).alias("lines"),
        F.length(text).alias("n_all"),
        F.length(F.translate(text, "#*$%&|<>", "")).alias("n_plain"),
    )
    counted = base.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.col("n_all") - F.col("n_plain")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("grams"),
    )
    # Windows in order of (hash, place): a window repeats when a neighbour has its hash.
    has_repeats = F.size(F.array_distinct(F.col("grams.g"))) < F.size("grams")
    none = F.array().cast("array<struct<g:bigint,at:int>>")
    ordered = counted.withColumn("grams", F.when(has_repeats, F.array_sort("grams")).otherwise(none))
    repeated = F.filter(
        F.transform(
            "grams",
            lambda gram, k: F.when(
                (F.get("grams", k - 1)["g"] == gram["g"]) | (F.get("grams", k + 1)["g"] == gram["g"]), gram["at"]
            ),
        ),
        lambda at: at.isNotNull(),
    )
    placed = ordered.withColumn("places", F.array_sort(repeated)).drop("grams")
    # Each window covers the words up to the next repeated window's start, its own length at most.
    covered = F.aggregate(
        F.transform("places", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - at, F.lit(WINDOW)))),
        F.lit(0),
        lambda total, part: total + part,
    )
    return placed.withColumn("n_repeat_words", covered.cast("long")).drop("places")


def _vector() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    chars = F.greatest("word_chars", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _middle(rows: DataFrame) -> DataFrame:
    """Start of the search: the median and quartile spread of each statistic per group, from counts of bins."""
    bins = rows.select(
        "lang",
        "source",
        F.posexplode(F.array(*[F.floor(F.col(x) / F.lit(0.05)).cast("int") for x in DIMS])).alias("dim", "bin"),
    )
    counts = bins.groupBy("lang", "source", "dim", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source", "dim")
    placed = counts.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("below") >= F.lit(share) * F.col("all"), F.col("bin")))

    spread = placed.groupBy("lang", "source", "dim").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    return spread.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("dim") == k, (F.col("q2") + 0.5) * 0.05)).alias(f"m{k}") for k in range(len(DIMS))],
        *[
            F.max(F.when(F.col("dim") == k, F.pow((F.col("q3") - F.col("q1") + 1) * 0.05 / 1.35, F.lit(2)))).alias(f"v{k}{k}")
            for k in range(len(DIMS))
        ],
    )


def _triangle() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _whitened(groups: DataFrame) -> DataFrame:
    """Per group the mean and the inverse ``w`` of the Cholesky factor of its covariance, as plain columns."""
    p = len(DIMS)
    for i, j in _triangle():
        if f"v{i}{j}" not in groups.columns:
            groups = groups.withColumn(f"v{i}{j}", F.lit(0.0))
    for j in range(p):
        for i in range(j, p):
            left = F.col(f"v{i}{j}") * F.lit(CONSISTENCY) + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(
                f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}")
            )
    for j in range(p):
        for i in range(j, p):
            if i == j:
                value = 1 / F.col(f"l{i}{i}")
            else:
                total = F.lit(0.0)
                for k in range(j, i):
                    total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                value = -total / F.col(f"l{i}{i}")
            groups = groups.withColumn(f"w{i}{j}", value)
    return groups.select(
        "lang", "source", *[f"m{k}" for k in range(p)], *[f"w{i}{j}" for i, j in _triangle()]
    )


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(len(DIMS)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(DIMS[j]) - F.col(f"m{j}"))
        total = total + z * z
    return total


def _estimates(rows: DataFrame) -> DataFrame:
    """Mean and covariance per group of the rows with ``inner``, leaning on its language and on all rows."""
    p = len(DIMS)
    sums = ["n", *[f"s{k}" for k in range(p)], *[f"q{i}{j}" for i, j in _triangle()]]
    own = saved(
        rows.where("inner").groupBy("lang", "source").agg(
            F.count("*").cast("double").alias("n"),
            *[F.sum(x).alias(f"s{k}") for k, x in enumerate(DIMS)],
            *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i, j in _triangle()],
        ),
        "sums",
    )
    by_language = own.groupBy("lang").agg(*[F.sum(c).alias(f"lang_{c}") for c in sums])
    overall = own.agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    joined = own.join(by_language, "lang").join(F.broadcast(overall))  # one row
    # The sums of LEAN rows like the average row of all are added to a language's, and of its to the group's.
    for c in sums:
        share_all = F.col(f"all_{c}") / F.col("all_n") * LEAN
        share = (F.col(f"lang_{c}") + share_all) / (F.col("lang_n") + LEAN) * LEAN
        joined = joined.withColumn(f"t_{c}", F.col(c) + share)
    return joined.select(
        "lang",
        "source",
        *[(F.col(f"t_s{k}") / F.col("t_n")).alias(f"m{k}") for k in range(p)],
        *[
            (F.col(f"t_q{i}{j}") / F.col("t_n") - F.col(f"t_s{i}") * F.col(f"t_s{j}") / F.col("t_n") / F.col("t_n")).alias(
                f"v{i}{j}"
            )
            for i, j in _triangle()
        ],
    )


def _inner(rows: DataFrame) -> DataFrame:
    """Marks per group the rows with the smallest distances, ``SUBSET`` of them and those of the last bin."""
    # Bins of the logarithm: a few hundred per group at most.
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 32).cast("int"))
    counts = binned.groupBy("lang", "source", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "source")
    placed = counts.withColumn("below", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    last = saved(
        placed.where(F.col("below") >= F.lit(SUBSET) * F.col("all")).groupBy("lang", "source").agg(F.min("bin").alias("last")),
        "last_bin",
    )
    return join_checked(binned, last, ["lang", "source"], "inner", 200).withColumn("inner", F.col("bin") <= F.col("last"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The base counts, ``base_failed``, the robust squared distance ``d2`` and ``kept`` for every row.

    Counts are saved once; each concentration step is then two aggregations of the saved vectors by
    (language, source), both with a combine, so a source that holds a third of all rows is summed where it
    lies. Group estimates are joined back broadcast while their counted size is small and by a shuffle join
    that can be split beyond it. Null languages and sources form groups of their own with the empty name;
    rows that fail the base rules take no part in the estimates and have no distance. Null and empty texts
    have zero counts and fail; repeated rows and null ids are judged row by row.
    """
    counted = text_counts(docs)
    for name, x in zip(DIMS, _vector(), strict=True):
        counted = counted.withColumn(name, x.cast("double"))
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    counted = saved(counted.withColumn("base_failed", failed), "counts")
    sound = counted.where("not base_failed").select("lang", "source", *DIMS)
    groups = saved(_whitened(saved(_middle(sound), "middle")), "start")
    for step in range(STEPS):
        placed = join_checked(sound, groups, ["lang", "source"], "inner", 400)
        marked = _inner(placed.select("lang", "source", *DIMS, _distance().alias("d2")))
        groups = saved(_whitened(_estimates(marked)), f"step{step}")
    judged = join_checked(counted, groups, ["lang", "source"], "left", 400)
    d2 = F.when(~F.col("base_failed"), _distance())
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(d2 <= F.lit(cutoff), F.lit(True))).alias("kept"),
        d2.alias("d2"),
    )
