"""Each operator against a brute-force version, an exact round trip or held-out labels, and on odd rows."""

import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import corpus_pipeline
from tablegraph.llm import (
    decontaminate,
    jaccard,
    licenses,
    outliers,
    packing,
    passages,
    quality,
    sharding,
    tokens,
    toxicity,
)
from tablegraph.llm.common import WordHashes
from tablegraph.llm.queries import QUERIES, ranks_path

SF = "/root/testdata/sf0.001"
SF_LABELS = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, row int, n long"
LONG = " ".join(f"word{k % 3001}" for k in range(60_000))
ODD = [
    (1, None, None, None, None, 0.5, "x", 1, 1),
    (2, "", "en", None, 0, 0.5, "x", 1, 1),
    (None, "no id here but some words to read in it today", "en", "s", 5, None, None, None, None),
    (3, "same words here " * 30, "en", "s", 5, None, None, None, None),
    (3, "same words here " * 30, "en", "s", 5, None, None, None, None),
    (4, "same words here " * 30, None, "s", 5, None, None, None, None),
    (5, LONG, "en", "s", 5, None, None, None, None),
    (6, LONG + " end", "en", "s", 5, None, None, None, None),
    (7, " \n\t\r ", "en", "s", 5, None, None, None, None),
    (8, "é ñ 漢字 MIT\nLicense <|endoftext|> #*$", "en", "s", 5, None, None, None, None),
]
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1), (5, 1, None), (None, 0, 0), (5, 1, 0)], LABELS)
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "some words to read in it today")], "item_id long, text string")
    return {
        "pack": lambda d: packing.pack(d, ranks_path(), with_ids=True),
        "toxicity": lambda d: toxicity.score(d, labels),
        "shard": lambda d: sharding.shard(d),
        "decontaminate": lambda d: decontaminate.contaminated(d, benchmark),
        "licenses": lambda d: licenses.scan(d),
        "jaccard": lambda d: jaccard.link(d),
        "outliers": lambda d: outliers.judge(d),
        "quality": lambda d: quality.classify(d, labels),
        "tokens": lambda d: tokens.count_tokens(d, ranks_path()),
        "passages": lambda d: passages.merged(passages.shared_passages(d)),
    }


PER_ROW = {"toxicity", "shard", "licenses", "jaccard", "outliers", "quality", "tokens"}


@pytest.mark.parametrize("name", [
    "pack", "toxicity", "shard", "decontaminate", "licenses", "jaccard", "outliers", "quality", "tokens", "passages"
])
def test_odd_rows_and_empty_tables(spark, name):
    run = operators(spark)[name]
    rows = run(odd(spark)).collect()
    if name in PER_ROW:
        assert Counter(row["doc_id"] for row in rows) == Counter(row[0] for row in ODD)
    assert run(odd(spark, [])).count() == 0
    by_id = {row["doc_id"]: row for row in rows}
    if name == "licenses":
        assert by_id[8]["base_labels"] == "mit" and by_id[1]["labels"] == "" and by_id[1]["first_word"] is None
    if name == "jaccard":
        assert by_id[4]["component_id"] == 3 and by_id[6]["component_id"] == 5 and by_id[1]["component_id"] == 1
        assert by_id[None]["component_id"] is None and by_id[7]["n_shingles"] == 0
    if name == "outliers":
        assert by_id[1]["base_failed"] and not by_id[1]["kept"] and by_id[7]["n_words"] == 0
    if name == "tokens":
        assert by_id[1]["n_tokens"] == 0
    if name == "decontaminate":
        assert [(row["doc_id"], row["item_id"], row["edits"]) for row in rows] == [(None, 4, 0)]
    if name == "passages":
        assert {row["doc_id"] for row in rows} == {3, 4, 5, 6}
        assert min(row["n_words"] for row in rows) >= 50


def test_stages_take_odd_rows_and_keep_columns(spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd(spark), SF_LABELS)
        assert out.columns == odd(spark).columns
        out.collect()
        assert stage(spark, odd(spark, []), SF_LABELS).count() == 0


def test_packing_holds_every_id_once_without_padding(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {row["doc_id"]: row["text"] for row in documents(spark).collect()} | {-1: "", -2: " a <|endoftext|> b\r\n  é漢  "}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = packing.pack(table, ranks_path(), with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in row["ids"])) == row["ids_crc32"]
    assert set(pieces) == set(docs)
    for doc, text in docs.items():
        own = sorted(pieces[doc], key=lambda row: row["start"])
        assert [i for row in own for i in row["ids"]] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert own[0]["start"] == 0 and own[0]["doc_tokens"] == sum(row["length"] for row in own)
    for own in sequences.values():
        own.sort(key=lambda row: row["offset"])
        total = 0
        for row in own:
            assert row["offset"] == total
            total += row["length"]
        assert total == own[0]["window"] <= 2048 and total & (total - 1) == 0


def test_step_groups_hold_as_many_tokens_and_close_work(spark):
    rows = packing.pack(documents(spark), ranks_path(), step_tokens=8192).collect()
    groups = defaultdict(dict)
    for row in rows:
        groups[row["step_group"]][row["sequence_id"]] = row["window"]
    assert all(len(set(own.values())) == 1 and sum(own.values()) <= 8192 for own in groups.values())


def test_shards_follow_the_schedule(spark):
    docs = documents(spark).select("doc_id", "text").collect()
    rows = sharding.shard(documents(spark)).collect()
    shard_of = {row["doc_id"]: row["shard"] for row in rows}
    by_text = defaultdict(set)
    sizes = Counter()
    for doc in docs:
        by_text[doc["text"]].add(shard_of[doc["doc_id"]])
        sizes[xxhash.xxh64_intdigest(doc["text"].encode(), 42)] += len(doc["text"].encode()) + 8
    assert all(len(shards) == 1 for shards in by_text.values())
    slots = defaultdict(list)
    for row in rows:
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    # The same rule by hand: groups over 1/8192 of the bytes alone, the others in bundles of their hash.
    total, items = sum(sizes.values()), Counter()
    for key, size in sizes.items():
        signed = key - (1 << 64) if key >> 63 else key
        bundle = (key >> 8) % 2048 + (2048 if signed % 64 < 6 else 0)
        items[(0, signed) if size * 8192 > total else (1, bundle)] += size
    loads = [(0, s) for s in range(24)]
    for _, size in sorted(items.items(), key=lambda item: (-item[1], item[0])):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, s))
    got = Counter()
    for row in rows:
        got[row["shard"]] += row["size"]
    assert dict(got) == {s: load for load, s in loads if load}


def _licence_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_license_scan_finds_phrases_and_notices(spark):
    rows = {row["doc_id"]: row for row in licenses.scan(documents(spark)).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for doc in documents(spark).select("doc_id", "text").collect():
        words, row = _licence_words(doc["text"]), rows[doc["doc_id"]]
        found = [(at, label) for label, p in phrases.items() for at in range(len(words)) if words[at : at + len(p)] == p]
        assert row["n_words"] == len(words) and row["n_base"] == len(found)
        assert row["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert (row["first_word"], row["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
    texts = [
        (1, "intro Licensed under CC BY-NC 4.0. end"),
        (2, "licensed by the committee under a cc rule"),
        (3, "Redistribution and use, in source and binary forms, with or without changes"),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of it"),
    ]
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert labels == {1: "cc-by-nc", 2: "", 3: "bsd", 4: "mit"}


def test_license_notice_is_found_wherever_else_its_words_stand(spark):
    """Every label agrees with sliding each template over the words, in texts that repeat the rare words."""
    source = random.Random(11)
    texts = [
        "Redistribution and use in source and binary forms, with or without modifications. See modification notes.",
        "obtaining copy charge: Permission is hereby granted, free of cost, to any person obtaining the copy",
        "source and binary forms only", "", None, "mit " * 500 + "license",
    ]
    for _ in range(150):
        template = source.choice(licenses.TEMPLATES).words
        words = [source.choice(template) if source.random() < 0.2 else word for word in template]
        around = source.choices(template, k=source.randrange(6))
        texts.append(" ".join([*around, *words, *reversed(around)]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(rows).collect()}
    for doc, text in enumerate(texts):
        words, labels, score = _licence_words(text or ""), set(), 0.0
        for template in (*licenses.BASE, *licenses.TEMPLATES):
            base, n, (at, k) = template in licenses.BASE, len(template.words), template.key
            for start in range(-n, len(words)):
                same = [0 <= start + q < len(words) and words[start + q] == template.words[q] for q in range(n)]
                if all(same[at : at + k]) and sum(same) >= (n if base else licenses.COVERAGE * n):
                    labels.add(template.label)
                    score = 1.0 if base else max(score, sum(same) / n)
        assert got[doc] == (",".join(sorted(labels)), score), text
    assert got[0][0] == "bsd"


def _shingles(text, lower=True):
    words = (text.encode().lower() if lower else text.encode()).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def _groups(texts):
    sets = {doc: _shingles(text) for doc, text in texts.items()}
    holders, shared = defaultdict(list), Counter()
    for doc, own in sets.items():
        for s in own:
            holders[s].append(doc)
    for own in holders.values():
        shared.update((a, b) for i, a in enumerate(own) for b in own[i + 1 :])
    parent = {doc: doc for doc in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), o in shared.items():
        if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {doc: (len(sets[doc]), root(doc)) for doc in texts}


def test_jaccard_groups_are_exact(spark):
    random.seed(5)
    texts = {row["doc_id"]: row["text"] for row in documents(spark).collect()}
    # Chains of near copies whose ends no longer link, and pairs exactly at the limit.
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    for k in range(40):
        base[random.randrange(120)] = f"x{k}"
        texts[10_000 + k] = " ".join(base)
    for k in range(6, 60):
        own = [f"a{k}b{i}" for i in range(k)]
        texts[20_000 + 2 * k], texts[20_001 + 2 * k] = " ".join(own), " ".join(own[: k - k // 6])
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in jaccard.link(table).collect()}
    assert got == _groups(texts)


def test_a_row_without_an_id_hides_no_link_of_its_copies(spark):
    near = [f"n{k}" for k in range(90)]
    rows = [(None, " ".join(near)), (8, " ".join(near)), (9, " ".join([*near, "more"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.link(table).collect()} == {None: None, 8: 8, 9: 8}
    assert {r["doc_id"] for r in passages.shared_passages(table).collect()} == {8, 9}


def test_bitmaps_bound_the_overlap_from_above():
    import numpy as np

    source = np.random.default_rng(3)
    for _ in range(200):
        pool = source.integers(0, 2**63, 400).astype(np.uint64)
        x, y = (np.unique(pool[source.integers(0, 400, source.integers(1, 300))]) for _ in "ab")
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum())
        assert len(np.intersect1d(x, y)) * 2 <= len(x) + len(y) - differ


def test_outlier_counts_and_clean_documents(spark):
    rows = {row["doc_id"]: row for row in outliers.judge(documents(spark, SF_LABELS)).collect()}
    for doc in documents(spark, SF_LABELS).select("doc_id", "text").collect():
        text, row = doc["text"], rows[doc["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        grams = defaultdict(list)
        for k in range(len(words) - 4):
            grams[tuple(words[k : k + 5])].append(k)
        repeated = {p for at in grams.values() if len(at) > 1 for k in at for p in range(k, k + 5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
    good = duckdb.sql(f"SELECT doc_id FROM '{SF_LABELS}/labels.parquet' WHERE quality = 1").fetchall()
    sound = [rows[doc] for (doc,) in good if not rows[doc]["base_failed"]]
    assert sum(row["kept"] for row in sound) >= 0.99 * len(sound)


def test_outlier_distance_is_that_of_numpy(spark):
    import numpy as np

    groups = spark.createDataFrame(
        [("en", "s", *[0.1 * k for k in range(5)], *[1.0 + i if i == j else 0.3 for i, j in outliers._triangle()])],
        "lang string, source string, " + ", ".join([f"m{k} double" for k in range(5)] + [f"v{i}{j} double" for i, j in outliers._triangle()]),
    )
    row = outliers._whitened(groups).crossJoin(spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)], ", ".join(f"{x} double" for x in outliers.DIMS)))
    got = row.select(outliers._distance().alias("d")).first()["d"]
    cov = np.full((5, 5), 0.3) + np.diag([0.7 + i for i in range(5)])
    cov = cov * outliers.CONSISTENCY + np.diag(np.square(outliers.FLOORS))
    x = np.arange(1.0, 6.0) - 0.1 * np.arange(5)
    assert got == pytest.approx(x @ np.linalg.solve(cov, x))


@pytest.mark.parametrize("name, label, least", [("op8_quality_classifier", "quality", 0.97), ("op2_toxicity", "toxic", 0.8)])
def test_classifiers_on_held_out_labels(spark, name, label, least):
    sf = "/root/testdata/sf0.1" if label == "toxic" else SF_LABELS
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    modulus, left = (4, 2) if label == "quality" else (3, 1)
    rows = QUERIES[name](spark, sf).collect()
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % modulus == left) for row in rows)
    assert all(0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7) for row in rows)
    seen = [(row["score"], truth[row["doc_id"]]) for row in rows if row["held_out"] and row["doc_id"] in truth]
    ones, zeros = ([s for s, t in seen if t == k] for k in (1, 0))
    # Chance that a document of label 1 scores higher.
    assert sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / len(ones) / len(zeros) >= least


def test_toxicity_join_agrees_with_broadcast(spark):
    labels = spark.read.parquet(f"{SF_LABELS}/labels.parquet")
    docs = documents(spark, SF_LABELS)
    one, other = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, model_bytes=b).collect()} for b in (1 << 30, 0))
    assert one.keys() == other.keys() and all(other[k] == pytest.approx(v, abs=1e-6) for k, v in one.items())


def test_token_counts_are_those_of_the_best_segmentation(spark):
    import public_tokenizers
    import regex

    scores = tokens.unigram(ranks_path())
    longest = max(map(len, scores))

    def best(word):
        top = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            here = None
            for start in range(max(0, end - longest), end):
                if word[start:end] in scores:
                    s, n = top[start][0] + scores[word[start:end]], top[start][1] + 1
                    if here is None or s > here[0] or s == here[0] and n < here[1]:
                        here = (s, n)
            top.append(here)
        return top[-1][1]

    docs = documents(spark).limit(40)
    rows = {row["doc_id"]: row for row in tokens.count_tokens(docs, ranks_path()).collect()}
    for doc in docs.collect():
        words = regex.findall(public_tokenizers.PATTERN, doc["text"])
        assert rows[doc["doc_id"]]["n_pretokens"] == len(words)
        assert rows[doc["doc_id"]]["n_tokens"] == sum(best(w.encode()) for w in words)


def test_edit_distance_and_planted_items(spark):
    random.seed(11)

    def slow(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item, 1):
            before, row[0] = row[0], i
            for j, b in enumerate(text, 1):
                before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
        return min(row)

    for _ in range(200):
        item, text = (bytes(random.choices(b"abc", k=random.randrange(1, 30))) for _ in "ab")
        assert decontaminate.least_edits(item, text) == slow(item, text)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    planted = []
    for k, item in enumerate(items):
        text = list(item["text"])
        for _ in range(len(text) // 25):  # four in a hundred characters changed, dropped or added
            at = random.randrange(len(text))
            text[at : at + random.randrange(2)] = random.choice(["x", "", "yz"])
        filler = " ".join(f"z{random.randrange(10**6)}" for _ in range(60))
        planted += [(2 * k, f"{filler} {''.join(text)} {filler}"), (2 * k + 1, f"{filler} {filler}")]
    table = spark.createDataFrame(planted, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {(2 * k, item["item_id"]) for k, item in enumerate(items)}
    assert found <= want and len(found) >= 0.95 * len(want)


def test_compact_windows_split_all_subsequences():
    import numpy as np

    random.seed(2)
    for _ in range(100):
        values = np.array([random.randrange(50) << 40 for _ in range(random.randrange(1, 40))], np.uint64)
        width = random.randrange(1, 8)
        left, centre, right = passages.compact_windows(values, width)
        for i in range(len(values)):
            for j in range(i + width - 1, len(values)):
                inside = [c for a, c, b in zip(left, centre, right, strict=True) if a <= i <= c <= j <= b]
                assert inside == [i + int(np.argmin(values[i : j + 1]))]


def test_repeated_passages_are_found_and_cut(spark):
    random.seed(4)

    def prose(n):
        return [f"q{random.randrange(10**7)}" for _ in range(n)]

    passage = prose(55)
    texts = {k: prose(80) + passage + prose(40) for k in range(8)} | {20 + k: prose(200) for k in range(8)}
    texts[7][100] = "changed"  # one word of the passage
    short = prose(45)
    texts[20][50:95] = texts[21][60:105] = short
    table = spark.createDataFrame([(k, " ".join(w), len(w)) for k, w in texts.items()], "doc_id long, text string, n_chars long")
    found = passages.shared_passages(table)
    rows = passages.merged(found).collect()
    assert {row["doc_id"] for row in rows} == set(range(8))
    assert all((row["first_word"], row["n_words"]) == (80, 55) for row in rows if row["doc_id"] < 7)
    cut = {row["doc_id"]: row for row in passages.without_repeats(table, found).collect()}
    assert cut[0]["text"] == " ".join(texts[0]) and cut[20]["text"] == " ".join(texts[20])
    assert cut[3]["text"].split() == texts[3][:80] + texts[3][135:] and cut[3]["n_chars"] == len(cut[3]["text"])


def test_windows_of_one_key_meet_their_like_across_batches_and_tasks(spark):
    random.seed(9)
    side = {doc: random.randrange(400) for doc in range(3000)}
    # One key holds nearly all windows, each of 400 shingles beside some eight; others hold one or two.
    rows = [(doc, doc, [7, 1000 + doc // 2], [doc % 50, 3], [c, doc]) for doc, c in side.items()]
    found = spark.createDataFrame(rows, "doc_id long, key long, windows array<long>, places array<long>, beside array<int>")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "100"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        met = passages.meetings(found).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(met) <= 2 * 2 * len(rows) and all(row["doc_a"] != row["doc_b"] for row in met)

    def parts(links):
        parent = {doc: doc for doc in side}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        return len({root(doc) for doc in side})

    links = [(row["doc_a"], row["doc_b"]) for row in met]
    assert parts([(a, b) for a, b in links if side[a] == side[b]]) == len(set(side.values()))
    stars = [(row["doc_a"], row["doc_b"]) for row in met if row["star"]]
    assert parts(stars) == 1 and {(2 * k, 2 * k + 1) for k in range(1500)} <= set(links)


def test_intervals_hold_every_run_once_and_equal_runs_hash_alike():
    import numpy as np

    random.seed(21)
    for _ in range(40):
        values = np.array([random.randrange(1 << 60) for _ in range(random.choice((9, 60, 200)))], np.uint64)
        values = values[np.array([random.randrange(len(values)) for _ in range(len(values))])]  # some stand twice
        width = 9
        left, centre, right = passages.compact_windows(values, width)
        keys, begins = passages._intervals(values, values, left, centre, right, width)
        ends = np.r_[begins[1:], len(values) - width + 1].astype(int)
        assert begins[0] == 0 and (begins.astype(int) < ends).all()
        key_of = {}
        for key, since, until in zip(keys.tolist(), begins.astype(int), ends, strict=True):
            for i in range(since, until):  # equal runs have one key, and runs of one key have one least value
                assert key_of.setdefault(tuple(values[i : i + width].tolist()), key) == key
        least = defaultdict(set)
        for run, key in key_of.items():
            least[key].add(min(run))
        assert all(len(found) == 1 for found in least.values())
        runs = passages.run_hashes(values, width)
        sides = [tuple(values[i : i + width].tolist()) for i in range(len(values) - width + 1)]
        assert len(runs) == len(sides) and len(set(zip(sides, runs.tolist()))) == len(set(sides)) == len(set(runs.tolist()))
    assert len(passages.run_hashes(values[:5], 9)) == 0


def test_repeats_beside_a_boilerplate_of_many_texts_are_found(spark):
    random.seed(31)

    def prose(n):
        return [f"w{random.randrange(10**7)}" for _ in range(n)]

    boilerplate, texts = prose(45), {}
    for k in range(200):
        texts[1000 + k] = prose(30) + boilerplate + prose(30)
    for k in range(60):  # two texts each share the boilerplate and ten words more, others of the key stand between
        own, side = prose(10), k % 2
        for doc in (500 + k, 1500 + k):
            texts[doc] = prose(25) + (own + boilerplate if side else boilerplate + own) + prose(25)
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    found = {(row["doc_id"], row["other_doc_id"], row["n_words"]) for row in passages.shared_passages(table).collect()}
    want = {pair for k in range(60) for pair in ((500 + k, 1500 + k, 55), (1500 + k, 500 + k, 55))}
    assert found == want


def test_every_exact_repeat_of_fifty_words_is_found(spark):
    texts = {row["doc_id"]: row["text"].encode().lower().split() for row in documents(spark).collect()}
    holders = defaultdict(set)
    for doc, words in texts.items():
        for k in range(len(words) - 49):
            holders[tuple(words[k : k + 50])].add(doc)
    want = {doc for docs in holders.values() if len(docs) > 1 for doc in docs}
    got = {row["doc_id"] for row in QUERIES["op10_substring_dedup"](spark, SF).collect()}
    assert want <= got


def test_pipeline_drops_what_its_stages_name(spark):
    docs = documents(spark, SF_LABELS)
    labels, rejected = spark.read.parquet(f"{SF_LABELS}/labels.parquet"), set()
    rejected = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 0").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in rejected}
    kept = {doc for doc, (_, first) in _groups(texts).items() if doc == first}
    rows = corpus_pipeline.run(spark, SF_LABELS).collect()
    packed = {row["doc_id"] for row in rows}
    assert packed <= kept and len(packed) >= 0.9 * len(kept)
    items = [t.lower() for (t,) in duckdb.sql(f"SELECT text FROM '{SF_LABELS}/benchmark.parquet'").fetchall()]
    clean = {doc for doc in kept if not any(item in texts[doc].lower() for item in items)}
    assert math.isclose(len(clean & packed), len(clean), rel_tol=0.02)
    assert sum(row["length"] for row in rows) == sum({row["doc_id"]: row["doc_tokens"] for row in rows}.values())


@pytest.mark.parametrize("own", [[], [(k, 1, 0) for k in range(40)], [(k, int(k > 0), 0) for k in range(40)]])
def test_the_quality_stage_drops_nothing_without_a_model(spark, tmp_path, own):
    spark.createDataFrame(own, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.createDataFrame([(k, f"some words of text {k}") for k in range(40)] + [(None, "no id")], "doc_id long, text string")
    assert corpus_pipeline.quality_classifier(spark, table, str(tmp_path)).count() == 41


def _similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_passages_with_changed_phrases_and_insertions_are_found_as_by_brute_force():
    import numpy as np

    source, width = np.random.default_rng(8), 8
    for _ in range(300):
        a = source.permutation(1000)[:30]
        b = a.copy()
        for _ in range(source.integers(0, 4)):
            at, n = source.integers(0, len(b)), source.integers(1, 6)
            other = source.integers(2000, 10**6, source.integers(0, 6))
            b = np.r_[b[:at], other, b[at + n * source.integers(0, 2) :]]
        if source.random() < 0.3:  # some shingles stand in b twice
            b = np.r_[b, b[3:6]]
        found = passages.shared_spans(a.astype(np.uint64), b.astype(np.uint64), [], width)
        x, y = a.tolist(), b.tolist()
        covered = {k for f, t, _, _ in found for k in range(f, t + 1)}
        assert all(_similar(set(x[f : t + 1]), set(y[f2 : t2 + 1])) and max(t - f, t2 - f2) + 1 >= width for f, t, f2, t2 in found)
        for f in range(len(x)):
            for t in range(f + width - 1, len(x)):
                if x[f] in y and x[t] in y:
                    f2, t2 = y.index(x[f]), y.index(x[t])
                    if f2 <= t2 and _similar(set(x[f : t + 1]), set(y[f2 : t2 + 1])):
                        assert covered.issuperset(range(f, t + 1))


def test_passages_around_replaced_and_inserted_words_are_found(spark):
    random.seed(12)

    def prose(n):
        return [f"r{random.randrange(10**7)}" for _ in range(n)]

    one, other = prose(100), prose(100)
    replaced = [*one[:49], "new", "words", *one[51:]]
    inserted = [*other[:50], *prose(15), *other[50:]]
    texts = [prose(30) + one + prose(30), prose(60) + replaced + prose(9), prose(30) + other + prose(30), inserted + prose(70)]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    rows = {(r["doc_id"], r["first_word"], r["n_words"]) for r in passages.shared_passages(table).collect()}
    assert {(0, 30, 100), (1, 60, 100), (2, 30, 100), (3, 0, 115)} <= rows


@pytest.mark.parametrize("rate, least", [(0, 1.0), (0.05, 0.95), (0.1, 0.9), (0.2, 0.5)])
def test_items_are_found_where_their_opening_words_repeat(rate, least):
    random.seed(3)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_LABELS}/benchmark.parquet' ORDER BY item_id").fetchall()
    index = decontaminate.build([(item, text.encode()) for item, text in items], decontaminate.EDITS)
    texts, want = [], set()
    for k, (_, text) in enumerate(items):
        filler = [f"z{random.randrange(10**6)}" for _ in range(50)]
        opening = [w for _ in range(3) for w in [*text.split()[:3], *filler[: random.randrange(5)]]]
        edited = list(text)
        for _ in range(int(len(text) * rate)):
            at = random.randrange(len(text))
            edited[at : at + random.randrange(2)] = random.choice(["x", "", "y"])
        texts.append(" ".join([*filler[:20], *opening, "".join(edited), *filler[20:]]).encode())
        item = decontaminate.normal(text.encode())[1]
        if decontaminate.least_edits(item, decontaminate.normal(texts[-1])[1]) <= decontaminate.EDITS * len(item):
            want.add((k, k))
    found = {(k, i) for k, i, *_ in decontaminate._search(index, decontaminate.EDITS, texts, WordHashes())}
    assert found <= want and len(want) == len(items) and len(found) >= least * len(want)


def test_stages_carry_columns_of_any_name(spark):
    """Names that the stages use inside, and rows that repeat an id."""
    text = ("one two three " * 40).strip()
    rows = [(1, text, "a", 1, "r", 2), (2, text, "b", 1, "r", 2), (3, "x", None, None, None, None),
            (3, "y", "c", 0, "r", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _cuts string, _first int, `row` string, place int")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, table, SF_LABELS)
        assert out.columns == table.columns
        kept = {(row["doc_id"], row["_cuts"]) for row in out.collect()}
        assert kept == ({(1, "a"), (3, None)} if name == "ngram_jaccard_join" else {(1, "a"), (3, None), (3, "c")})


def test_copies_stand_as_a_whole_and_their_text_once(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    shared = " ".join(words[:70])
    rows = [(k, " ".join(words)) for k in range(10, 40)] + [(k, f"{shared} other {k}") for k in range(50, 55)]
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = defaultdict(set)
    for row in found:
        spans[row["doc_id"]].add((row["first_word"], row["n_words"], row["other_doc_id"]))
    assert set(spans) == {doc for doc, _ in rows}
    assert all(spans[k] == {(0, 400, 10)} for k in range(11, 40)) and (0, 400, 39) in spans[10]
    assert all(any(first == 0 and n >= 70 for first, n, _ in spans[k]) for k in range(50, 55))


def test_toxicity_looks_up_a_large_batch_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnop" for c in "qrstu"]
    texts = [" ".join(rng.choices(vocabulary, k=3000)) for _ in range(900)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(900), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    known = np.sort(toxicity._keys(" ".join(vocabulary).encode(), WordHashes())[0])
    weight = np.ones(len(known), np.float32)

    def totals(rows):
        return [t for part in toxicity._looked_up(iter([rows]), known, weight) for t in part.column("total").to_pylist()]

    alone = [totals(rows.slice(k, 1))[0] for k in range(5)]
    tracemalloc.start()
    together = totals(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert together[:5] == alone and len(together) == 900
    assert peak < 8 * rows.nbytes


def test_every_passage_within_the_edits_is_found():
    """Also those that keep no word of the item, short items, and items of one word; against each whole text."""
    source = random.Random(5)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_LABELS}/benchmark.parquet' ORDER BY item_id LIMIT 12").fetchall()
    items += [(900, "one"), (901, "a b"), (902, "some short item of words"), (903, "sentence of words " * 40)]
    index = decontaminate.build([(item, text.encode()) for item, text in items], decontaminate.EDITS)
    texts, known = [], [word for _, text in items for word in text.split()]
    for _, text in items:
        for rate in (0.1, 0.18, 0.2, 0.22):
            edited = list(text)
            # One edit every few characters, so that hardly a word stays as it is.
            for at in range(len(text) - 1, -1, -round(1 / rate)):
                edited[at : at + source.randrange(2)] = source.choice(["q", "", "z"])
            around = [" ".join(source.choices(known, k=source.randrange(30))) for _ in "ab"]
            texts.append(f"{around[0]} {''.join(edited)} {around[1]}".encode())
    want = {}
    for k, text in enumerate(texts):
        for i, item in enumerate(index.items):
            edits = decontaminate.least_edits(item, decontaminate.normal(text)[1])
            if edits <= decontaminate.EDITS * len(item):
                want[k, i] = edits
    found = decontaminate._search(index, decontaminate.EDITS, texts)
    assert {(k, i): edits for k, i, _, edits, _ in found} == want and len(want) > 40
    for k, i, word, edits, _ in found:  # the passage begins in the word that is named
        words = decontaminate.normal(texts[k])[1].split(b" ")
        assert decontaminate.least_edits(index.items[i], b" ".join(words[word:])) <= edits + len(words[word])


def test_bitmaps_are_joined_to_the_tiles_last(spark, monkeypatch):
    """No join or grouping of tiles carries the bitmaps through its shuffle."""
    plans, candidates = [], jaccard.candidates

    def seen(placed, nearest):
        plans.append(placed._jdf.queryExecution().optimizedPlan().toString())
        return candidates(placed, nearest)

    monkeypatch.setattr(jaccard, "candidates", seen)
    jaccard.link(documents(spark))
    for plan in plans:
        carried = [line for line in plan.splitlines() if "Project" in line and "bitmap" in line]
        assert len(carried) <= 2 and len(plans) == 3  # the table of bitmaps itself, and what the last join gives


def test_stretches_travel_as_five_bytes_a_word():
    import numpy as np

    hashes = WordHashes()
    words = [f"s{k % 37}".encode() for k in range(200)]
    sent = passages.short_hashes(hashes.of(words)).tobytes()
    grams = passages.stretch_grams(sent)
    assert len(sent) == 5 * len(words) and len(grams) == len(words) - 4
    same = {tuple(words[k : k + 5]): set() for k in range(len(grams))}
    for k, gram in enumerate(grams.tolist()):
        same[tuple(words[k : k + 5])].add(gram)
    assert all(len(g) == 1 for g in same.values()) and len(np.unique(grams)) == len(same)
    # A part cut out by place has the shingles of those words; a part shorter than a shingle has none.
    assert (passages.stretch_grams(sent[5 * 50 : 5 * 90]) == grams[50:86]).all()
    assert len(passages.stretch_grams(sent[: 5 * 4])) == 0 and len(passages.stretch_grams(b"")) == 0


def test_tasks_take_large_batches_in_pieces_of_four_megabytes():
    import pyarrow as pa

    from tablegraph.llm.common import pieces

    rows = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array(["x" * 2000] * 6000)], names=["doc_id", "text"])
    own = list(pieces(iter([rows])))
    assert max(part.nbytes for part in own) <= 4 << 20
    assert [k for part in own for k in part.column("doc_id").to_pylist()] == list(range(6000))


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """A split of long texts reaches a task in parts."""
    import pyarrow as pa

    from tablegraph.llm.common import arrow_map, batch

    spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 2000) AS text").write.parquet(f"{tmp_path}/long")

    def work(batches):
        sizes = [(rows.num_rows, rows.nbytes) for rows in batches]
        yield batch(n=pa.array([n for n, _ in sizes], pa.int64()), size=pa.array([b for _, b in sizes], pa.int64()))

    rows = arrow_map(spark.read.parquet(f"{tmp_path}/long").coalesce(1), work, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 8000 and max(r["size"] for r in rows) < 5 << 20


def test_bounds_of_grams_never_exceed_their_edits_and_tell_three():
    """Against the fewest edits between each gram and each item; what is remembered and forgotten changes nothing."""
    import numpy as np

    source = random.Random(8)
    items = [bytes(source.choices(b"abcdefgh ", k=source.randrange(3, 90))) for _ in range(70)]
    index = decontaminate.build(list(enumerate(items)), decontaminate.EDITS)
    order = decontaminate._by_length(index)
    near = decontaminate.Bounds(index.items, order)
    grams = [bytes(source.choices(b"abcdefghij", k=decontaminate.GRAM)) for _ in range(150)]
    grams += [item[at : at + decontaminate.GRAM] for item in index.items for at in range(0, len(item) - decontaminate.GRAM, 9)]
    codes = np.unique(np.array([int.from_bytes(gram, "big") for gram in grams], np.uint64))
    for own in (codes[::3], codes, codes[::2]):  # the second and the third find some there already
        packed, columns = near.of(own)
        for code, column in zip(own.tolist(), columns.tolist(), strict=True):
            gram = code.to_bytes(decontaminate.GRAM, "big")
            got = packed[:, column].copy().view(np.uint8)[: len(order)]
            want = [min(decontaminate.NEAR + 1, decontaminate.least_edits(gram, index.items[k])) for k in order.tolist()]
            assert (got <= want).all() and (got == want).mean() > 0.9


@pytest.mark.parametrize("limit", [32 << 20, 100])
def test_texts_without_an_open_interval_are_not_shuffled(spark, monkeypatch, limit):
    """Where the ranges fit a broadcast no text moves, else, if their ids do, those with a range alone."""
    seen = {}

    def noted(df, work, schema):
        if "ranges" in df.columns and "text" in df.columns:
            seen["plan"], seen["rows"] = df._jdf.queryExecution().executedPlan().toString(), df.count()
        return arrow_map(df, work, schema)

    arrow_map = passages.arrow_map
    monkeypatch.setattr(passages, "arrow_map", noted)
    monkeypatch.setattr(passages, "BROADCAST_BYTES", limit, raising=False)
    source = random.Random(2)
    prose = lambda n: [f"w{source.randrange(5000)}" for _ in range(n)]
    line, own = prose(45), prose(10)
    rows = [(k, " ".join(prose(30) + line + (own if k in (7, 31) else prose(10)) + prose(30))) for k in range(40)]
    rows += [(100 + k, " ".join(prose(90))) for k in range(60)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"] for r in found} >= {7, 31} and 0 < seen["rows"] <= 40
    assert "BroadcastHashJoin" in seen["plan"] and ("SortMergeJoin" in seen["plan"]) == (limit == 100)


def test_word_hashes_are_one_to_a_word_wherever_it_stands(monkeypatch):
    from tablegraph.llm import common

    source = random.Random(4)
    words = {"".join(source.choices("abcdeäñ\u00a0日", k=source.randrange(1, 9))) for _ in range(3000)} | {"x" * 300, "x" * 301, "ab", "ba"}
    row = [w for w in [*words, *words] for w in (w, w.upper().replace("SS", "ss"))]
    source.shuffle(row)
    text = "".join(w + source.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"]) for w in row).encode()
    plain = common.word_bytes(text)
    hashes = common.word_hashes(text)
    assert len(hashes) == len(plain) and len(set(zip(plain, hashes.tolist()))) == len(set(plain)) == len(set(hashes.tolist()))
    monkeypatch.setattr(common, "HASHED_BYTES", 100)
    assert (common.word_hashes(text) == hashes).all() and (common.word_hashes(b"\n " + text[:-1]) == hashes).all()
    assert [len(common.word_hashes(t)) for t in (b"", b" \n", b"a", b" a", b"a b ")] == [0, 0, 1, 1, 2]


def test_a_phrase_said_over_and_over_is_covered_and_meets_few_times(spark, monkeypatch):
    """Every run of fifty words that two texts share lies in a passage, and the runs of such a text are few rows."""
    rng = random.Random(12)
    tables, saved = {}, passages.saved

    def noted(df, name):
        tables[name] = saved(df, name)
        return tables[name]

    monkeypatch.setattr(passages, "saved", noted)

    def prose(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    # The first text of the windows' keys says it too few times for a passage, so that the others' runs stay open.
    texts = {1: prose(40) + ["go", "on"] * 12 + prose(40)}
    for doc in range(2, 22):
        texts[doc] = prose(20 + doc) + ["go", "on"] * 300 + prose(30)
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    found = passages.shared_passages(table).collect()
    for doc in range(2, 22):
        held = {at for r in found if r["doc_id"] == doc for at in range(r["first_word"], r["first_word"] + r["n_words"])}
        assert held == set(range(20 + doc, 620 + doc))
    assert all(r["doc_id"] > 1 for r in found)
    assert tables["runs"].count() <= 20 * 100  # of 551 places each


def test_runs_on_the_meetings_shifts_hold_all_runs_of_any_of_them():
    import numpy as np

    rng, width = random.Random(13), 5
    for _ in range(200):
        phrase = [rng.randrange(4) for _ in range(rng.choice((1, 2, 3)))]
        a = np.array([9] * rng.randrange(4) + phrase * rng.randrange(3, 9) + [rng.randrange(5) for _ in range(8)], np.uint64)
        b = np.array([8] * rng.randrange(4) + phrase * rng.randrange(3, 30) + [rng.randrange(5) for _ in range(8)], np.uint64)
        shifts = np.array(rng.sample(range(-len(a), len(b)), 9))
        got = passages._straight(a, b, shifts, width)
        assert all(t - f == u - s and t - f + 1 >= width and (a[f : t + 1] == b[s : u + 1]).all() for f, t, s, u in got)
        runs = [(i, i + k) for k in shifts.tolist() for i in range(len(a) - width + 1) if 0 <= i + k <= len(b) - width and (a[i : i + width] == b[i + k : i + k + width]).all()]
        assert {i for i, _ in runs} == {i for f, t, _, _ in got for i in range(f, t - width + 2)}
        assert {j for _, j in runs} == {j for _, _, s, u in got for j in range(s, u - width + 2)}


def test_thinned_runs_leave_no_open_word_out():
    import numpy as np

    rng = random.Random(14)
    for _ in range(200):
        width = rng.choice((1, 2, 5, 9))
        runs = np.array([rng.randrange(rng.choice((1, 3, 40))) for _ in range(rng.randrange(1, 120))], np.uint64)
        wanted = np.array([rng.random() < 0.9 for _ in runs])
        opened = wanted & np.array([rng.random() < rng.choice((0.3, 1)) for _ in runs])
        kept = passages._thinned_runs(runs, wanted, opened, width).tolist()
        assert kept == sorted(set(kept)) and wanted[kept].all() and set(runs[kept]) == set(runs[wanted])
        for run in set(runs[opened].tolist()):
            own = [k for k in kept if runs[k] == run and opened[k]]
            for at in np.flatnonzero(opened & (runs == run)).tolist():  # it is kept, or lies between two that are near
                low, high = max((k for k in own if k <= at), default=None), min((k for k in own if k >= at), default=None)
                assert low is not None and high is not None and high - low <= width


def test_tasks_of_one_worker_share_the_bounds_of_grams(monkeypatch):
    import types

    import pyarrow as pa

    made, works = [], []
    bounds = decontaminate.Bounds
    monkeypatch.setattr(decontaminate, "Bounds", lambda *a: made.append(bounds(*a)) or made[-1])
    monkeypatch.setattr(decontaminate, "texts", lambda docs: docs)
    monkeypatch.setattr(decontaminate, "arrow_map", lambda docs, work, schema: works.append(work))
    items = [f"the {k} item speaks of {'one two three four five '[: 5 * k]} things and of no more" for k in range(12)]
    index = decontaminate.build([(k, item.encode()) for k, item in enumerate(items)], decontaminate.EDITS)
    decontaminate._scan(None, types.SimpleNamespace(value={"index": vars(index)}), decontaminate.EDITS)
    words = random.Random(15).choices("one two thing item speaks more of no".split(), k=4000)
    rows = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([items[3], " ".join(words), f"so {items[7]} so"])], names=["doc_id", "text"])
    found = [[(r["doc_id"], r["item_id"], r["edits"]) for part in works[0](iter([rows])) for r in part.to_pylist()] for _ in range(2)]
    assert found[0] == found[1] and {(0, 3, 0), (2, 7, 0)} <= set(found[0])
    assert len(made) == 1


def test_half_an_item_and_a_shorter_string_decide_most_pairs(monkeypatch):
    """What is within the edits has its own number, all else a number above them; also where the passage is cut short."""
    import numpy as np

    rng = random.Random(16)
    items = ["".join(rng.choices("abcdef ", k=n)).strip() for n in (30, 64, 65, 90, 128, 129, 200, 333)]
    index = decontaminate.build([(k, item.encode()) for k, item in enumerate(items)], decontaminate.EDITS)
    owners, strings = [], []
    for k, item in enumerate(index.items):
        for _ in range(40):
            edited = bytearray(item)
            for _ in range(rng.randrange(int(0.25 * len(item)))):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randrange(2)] = rng.choice([b"", b"z", b"zz"])
            if rng.random() < 0.5:  # the end of it is missing
                edited = edited[: len(edited) - rng.randrange(int(0.2 * len(item)))]
            around = ["".join(rng.choices("abcdef ", k=rng.randrange(30))).encode() for _ in "ab"]
            strings.append(bytes(around[0] + edited + (b"" if rng.random() < 0.5 else around[1])))
            owners.append(k)
        strings.append("".join(rng.choices("uvwxyz", k=400)).encode())
        owners.append(k)
    taken, least = [], decontaminate._least_edits

    def noted(masks_of, lengths, owners, strings):
        taken.append(sum(map(len, strings)))
        return least(masks_of, lengths, owners, strings)

    monkeypatch.setattr(decontaminate, "_least_edits", noted)
    for few in (0, 10**6):
        monkeypatch.setattr(decontaminate, "FEW", few)
        got = decontaminate._distances(index, np.array(owners), strings)
        for k, string, edits in zip(owners, strings, got.tolist(), strict=True):
            want, room = decontaminate.least_edits(index.items[k], string), int(index.room[k])
            assert edits == want if want <= room else edits > room
    assert taken[0] < 0.8 * sum(map(len, strings)) and len(taken) == 3


def test_bounds_of_grams_are_made_once_for_many_texts(monkeypatch):
    """300,000 grams stay remembered, in a byte for four items; before, they were forgotten past 262,144 of eight times that size."""
    import numpy as np

    source = random.Random(17)
    index = decontaminate.build([(k, bytes(source.choices(b"abcdefgh ", k=60))) for k in range(16)], decontaminate.EDITS)
    near = decontaminate.Bounds(index.items, decontaminate._by_length(index))
    made, make = [], near._make
    monkeypatch.setattr(near, "_make", lambda grams, out: made.append(len(grams)) or make(grams, out))
    grams = np.unique(np.random.default_rng(17).integers(0x616161616161, 0x696969696969, 300_000, dtype=np.uint64))
    for own in (grams[::2], grams[1::2], grams[::2], grams[1::3]):
        near.of(own)
    assert sum(made) == len(grams)
    assert near.below.nbytes <= 4 * decontaminate.REMEMBERED_GRAMS


def test_windows_are_those_whose_bounds_add_up_to_no_more_than_the_room(monkeypatch):
    """Against sums window by window, over more items than are added up at once and more grams than stay in the cache."""
    import numpy as np

    source = random.Random(18)
    sizes = [*range(40, 110), 700, 900]  # the last two pass what a byte may add up to
    items = [bytes(source.choices(b"abcde ", k=n)).strip() or b"a" for n in sizes]
    index = decontaminate.build(list(enumerate(items)), decontaminate.EDITS)
    order, held = decontaminate._by_length(index), (index.lengths - index.room - decontaminate.GRAM + 1) // decontaminate.GRAM
    assert len(items) > 8 * decontaminate.ADDED_GROUPS
    monkeypatch.setattr(decontaminate, "ADDED_GRAMS", 100)
    near = decontaminate.Bounds(index.items, order)
    text = b"".join(source.choice([items[source.randrange(len(items))], bytes(source.choices(b"abcxyz ", k=60))]) for _ in range(40))
    n = len(text) // decontaminate.GRAM
    keys = np.array([int.from_bytes(text[6 * k : 6 * k + 6], "big") for k in range(n)], np.uint64)
    grams, place = np.unique(keys, return_inverse=True)
    packed, columns = near.of(grams)
    found = {item: dict(zip(at.tolist(), sums.tolist(), strict=True)) for item, at, sums in decontaminate._windows(index, order, packed, columns[place], held)}
    total = 0
    for rank, item in enumerate(order.tolist()):
        bounds = [int(packed[rank // 8, c]) >> 8 * (rank % 8) & 255 for c in columns[place].tolist()]
        sums = {at: sum(bounds[at : at + int(held[item])]) for at in range(n - int(held[item]) + 1)}
        want = {at: value for at, value in sums.items() if value <= index.room[item]}
        assert found.get(item, {}) == want
        total += len(want)
    assert total > 100


def test_windows_of_texts_laid_end_to_end_are_those_of_each():
    """Against each text by itself, repeats and texts of just a passage's length included; made with few calls for many texts."""
    import numpy as np

    from tablegraph.llm.common import shingles, word_hashes, word_hashes_of

    source, width, functions = random.Random(19), 6, 3
    texts = [" ".join(source.choices("abcdefghijklmnop", k=source.choice([0, 1, 4, 5, 9, 10, 11, 40, 90]))) for _ in range(150)]
    texts += [("one two " * 60).strip(), "  and\n\nblank  ends\t", " ".join("same" for _ in range(80)), "é ñ 漢字   MIT " * 9]
    hashes, lengths = word_hashes_of([text.encode() for text in texts])
    assert lengths.tolist() == [len(text.encode().split()) for text in texts]
    assert (hashes == np.concatenate([word_hashes(text.encode()) for text in texts])).all()
    rows = [k for k, n in enumerate(lengths.tolist()) if n >= width + 4]
    chosen = [shingles(word_hashes(texts[k].encode())) for k in rows]
    made, ranges = passages._windows_of(chosen, np.array(rows), width, functions)
    for row, grams in zip(rows, chosen, strict=True):
        want, first = [], None
        for k in range(functions):
            values = passages._function(grams, k)
            left, centre, right = passages.compact_windows(values, width)
            if k == 0:
                first = passages._intervals(grams, values, left, centre, right, width)
            if len(set(values[centre].tolist())) < len(centre):
                centre = passages._thinned(values, centre, width // 2)
            want += [(int(values[at]), at, int(grams[min(at + 5, len(grams) - 1)]) & 0x7FFFFFFF) for at in centre]
        own = made[0] == row
        assert list(zip(*(column[own].tolist() for column in made[1:]), strict=True)) == want
        own = ranges[0] == row
        assert ranges[1][own].tolist() == first[0].tolist() and ranges[2][own].tolist() == first[1].tolist()


def test_pairs_that_share_too_few_shingles_are_not_joined(monkeypatch):
    """The answer is that of joining all runs, and pairs with a few common shingles never come to it."""
    import numpy as np

    rng = np.random.default_rng(20)
    joined, width, far = [], 46, 0
    whole = passages._joined
    monkeypatch.setattr(passages, "_joined", lambda *a: joined.append(1) or whole(*a))
    for turn in range(300):
        a = rng.integers(0, 1 << 60, 150).astype(np.uint64)
        b = rng.integers(0, 1 << 60, 150).astype(np.uint64)
        n = int(rng.integers(1, 70))
        b[20 : 20 + n] = a[40 : 40 + n]
        b[20 : 20 + n : 9] += np.uint64(turn % 2)
        if turn % 5 == 0:  # the first one says a shingle again and again
            a[60:120] = a[59]
        want = whole(a, b, passages._places(a, b, np.array([-20]))[0], width)
        assert passages.shared_spans(a, b, np.array([-20]), width) == want
        far += n < 36 and turn % 5 > 0
    assert len(joined) <= 300 - far < 200


def test_task_functions_need_no_package_on_the_executors():
    """What is sent names no module of this package, whatever this process has made of it already."""
    from pyspark import cloudpickle

    from tablegraph.llm import common

    common.word_hashes(b"some words")
    sent = cloudpickle.dumps([passages._windows_of, passages.run_hashes, common.word_hashes_of, decontaminate._search])
    code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); print(len(f[2]([b'a b', b'c'])[0]), 'tablegraph' in sys.modules)"
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env={"PATH": "/usr/bin"})
    assert run.stdout.decode().split() == ["3", "False"], run.stderr.decode()[-500:]
    assert len(sent) < 1 << 20
