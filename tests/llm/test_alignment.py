"""Tokenizer alignment against a walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from tablegraph.llm import alignment
from tablegraph.llm.queries import QUERIES, ranks_path
from tests.llm.test_operators import ODD, documents, odd

FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def byte_letters():
    """The letter that stands for each byte in the byte-level vocabulary: itself if printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def walked(rows):
    letters = byte_letters()
    first, second = Tokenizer.from_file(path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    first.encode_special_tokens = True

    def piece(k):
        name = second.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if second.is_byte(k) else name.replace("▁", " ").encode()

    held, groups_of = Counter(), []
    for _, text in rows:
        groups = []
        if text:
            a = [(k, bytes(letters[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
            b = [(k, piece(k)) for k in second.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                common, start = sorted(ends[0] & ends[1]), 0
                for end in common:
                    groups.append([[], []])
                    for k, side in enumerate((a, b)):
                        at = 0
                        for number, x in side:
                            at += len(x)
                            if start < at <= end:
                                groups[-1][k].append(number)
                    start = end
        groups_of.append(groups)
        held.update({(x, y) for a, b in groups for x in a for y in b})
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for (doc, _), groups in zip(rows, groups_of, strict=True):
        links = [(x, y) for a, b in groups for x in a for y in b]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
            sum(held[link] == top[link[0]] for link in links), sum(held[link] for link in links),
        )


TEXTS = [
    (1, "the same words, the same pieces"), (1, "the same words, the same pieces"), (2, None), (3, ""),
    (4, "a <|endoftext|> mark and <s> another </s>"), (5, "a ▁ that no side gives back"), (6, " \n\t  spaces   "),
    (None, "no id: 漢字かな交じり文 ñandú Größe Привет мир 🙂🙂"), (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 4), (8, "\x00\x01 é"),
    (9, "-=" * 700),
]


@pytest.mark.parametrize("held", [alignment.HELD_PAIRS, 40, 0])
def test_alignment_equals_a_walk_over_both_sides(spark, held):
    sample = [tuple(row) for row in documents(spark).select("doc_id", "text").where("length(text) < 600").limit(60).collect()]
    rows = TEXTS + sample
    out = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), ranks_path(), alignment.piece_path(), held)
    got = [tuple(row) for row in out.select(*FIELDS).collect()]
    assert sorted(got, key=str) == sorted(walked(rows), key=str)
    by_id = {row[0]: row for row in got}
    assert by_id[5][1:] == (0, 0, 0, 0, "", 0, 0) == by_id[2][1:] and by_id[1][7] > 0


def test_overlaps_are_those_of_all_pairs():
    cuts = np.random.default_rng(3)
    for _ in range(20):
        sides = []
        for _ in range(2):
            ends = np.r_[np.flatnonzero(cuts.random(80) < 0.4) + 1, 81]
            sides.append(pd.DataFrame({"start": np.r_[0, ends[:-1]], "end": ends}))
        a, b = sides
        want = {(i, j) for i, x in a.iterrows() for j, y in b.iterrows() if x.start < y.end and y.start < x.end}
        got = list(zip(*alignment.overlaps(a, b), strict=True))
        assert set(got) == want and len(got) == len(want)


def test_a_wide_group_counts_as_its_links(monkeypatch):
    rows = [(1, "-=" * 500 + " x"), (2, "🙂" * 50)]
    usual = alignment._Aligner(ranks_path(), alignment.piece_path()).align([t.encode() for _, t in rows])
    monkeypatch.setattr(alignment, "WIDE_GROUP", 0)
    narrow = alignment._Aligner(ranks_path(), alignment.piece_path()).align([t.encode() for _, t in rows])
    assert {k: v.to_pylist() for k, v in usual.items()} == {k: v.to_pylist() for k, v in narrow.items()}
    assert sum(narrow["times"].to_pylist()[0]) == narrow["n_links"].to_pylist()[0]


def test_odd_rows_and_empty_tables(spark):
    out = alignment.align(odd(spark), ranks_path(), alignment.piece_path())
    rows = out.collect()
    assert Counter(row["doc_id"] for row in rows) == Counter(row[0] for row in ODD)
    by_id = {row["doc_id"]: row for row in rows}
    assert by_id[1]["groups_sha256"] == by_id[2]["groups_sha256"] == "" and by_id[8]["n_groups"] > 0
    assert by_id[3]["groups_sha256"] == by_id[4]["groups_sha256"] and by_id[5]["n_a"] > 60_000
    assert alignment.align(odd(spark, []), ranks_path(), alignment.piece_path()).collect() == []


def test_query_returns_every_document(spark):
    out = QUERIES["op11_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    assert out.count() == documents(spark).count()
