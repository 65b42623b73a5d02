"""SimHash near-duplicates against all pairs, and the Golay code against its definition."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tablegraph.llm import fuzzy
from tablegraph.llm.queries import QUERIES
from tests.llm.test_operators import ODD, documents, odd


def slow_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """Smallest id reachable per row, comparing all pairs of fingerprints."""
    prints = [p for _, p in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2:
                parent[top(i)] = top(j)
    ids = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        ids[top(k)] += [doc] if doc is not None else []
    return [min(ids[top(k)], default=None) for k in range(len(rows))]


def test_every_word_lies_within_three_bits_of_one_codeword():
    parity, errors = fuzzy.golay()
    codewords = np.arange(4096) << 11 | parity & 2047
    assert sorted({int(w) for w in np.bitwise_count(codewords)}) == [0, 7, 8, 11, 12, 15, 16, 23]
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    index = fuzzy.decoded(words)
    distance = np.bitwise_count(words[:, None] ^ codewords[None, :])
    assert (distance.argmin(axis=1) == index).all() and distance.min(axis=1).max() == 3


def test_any_two_prints_within_two_bits_share_a_key():
    rng = random.Random(1)
    for _ in range(300):
        one = rng.getrandbits(64)
        other = one
        for bit in rng.sample(range(64), rng.choice([1, 2, 2, 2])):
            other ^= 1 << bit
        row, key = fuzzy.fuzzy_keys(np.array([one, other], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])
        assert len(key) <= 36


@pytest.mark.parametrize("crowd", [1, 3, fuzzy.CROWD])
def test_links_join_what_all_pairs_join(spark, crowd):
    """Chains and clouds of near prints, with crowded keys and without."""
    rng = random.Random(crowd)
    prints = {0, 3, 5}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            prints.add(base)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                base ^= 1 << bit
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = fuzzy.links(spark.createDataFrame([(p,) for p in signed], "print long"), crowd).distinct().collect()
    parent = {p: p for p in signed}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for edge in edges:
        parent[top(edge["a"])] = top(edge["b"])
    numbered = {p: k for k, p in enumerate(signed)}
    want = slow_components([(numbered[s], p) for s, p in zip(signed, prints, strict=True)])
    groups = defaultdict(set)
    for p in signed:
        groups[top(p)].add(numbered[p])
    got = {k: min(group) for group in groups.values() for k in group}
    assert [got[k] for k in range(len(signed))] == want


@pytest.mark.parametrize(("crowd", "common"), [(fuzzy.CROWD, fuzzy.COMMON), (2, 3)])
def test_documents_against_brute_force(spark, crowd, common):
    rng = random.Random(5)
    rows = [(row["doc_id"], row["text"]) for row in documents(spark).select("doc_id", "text").collect()]
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400)).split()
    for k in range(60):  # near copies, of which many differ in a bit or two
        words = base[:]
        words[rng.randrange(400)] = f"x{rng.randrange(5)}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000 + k, "one text that many rows repeat") for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(row) for row in fuzzy.near_duplicates(table, crowd, common).collect()]
    prints = [(doc, slow_print(text)) for doc, text in rows]
    want = [(doc, f"{p:016x}", c) for (doc, p), c in zip(prints, slow_components(prints), strict=True)]
    assert sorted(out) == sorted(want)
    assert len({c for doc, _, c in out if 10_000 <= doc < 20_000}) < 40


def test_odd_rows_and_empty_tables(spark):
    rows = fuzzy.near_duplicates(odd(spark)).collect()
    assert Counter(row["doc_id"] for row in rows) == Counter(row[0] for row in ODD)
    prints = [(row[0], slow_print(row[1])) for row in ODD if row[0] not in (5, 6)]
    want = {(doc, f"{p:016x}", c) for (doc, p), c in zip(prints, slow_components(prints), strict=True)}
    assert {tuple(row) for row in rows if row["doc_id"] not in (5, 6)} == want
    by_id = {row["doc_id"]: row for row in rows}
    assert by_id[7]["fingerprint"] == "0" * 16 and by_id[7]["component_id"] == 1 and by_id[None]["component_id"] is None
    assert fuzzy.near_duplicates(odd(spark, [])).collect() == []


def test_query_returns_every_document(spark):
    out = QUERIES["op13_simhash_near_dedup"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == documents(spark).count()
