"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the id pairs it links."""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.common import arrow_map, batch, pieces, saved, text_bytes, texts

#: Id pairs whose counts the tasks hold at once (16 bytes each); rarer ones are joined to the documents that hold them.
HELD_PAIRS = 2_000_000
#: Bytes of text whose tokens are merged at once, one text at least.
BLOCK_BYTES = 1 << 20
#: A group of more links than this is counted by its distinct ids.
WIDE_GROUP = 1 << 12
#: Distinct pairs a task counts before it hands them on.
COUNTED_PAIRS = 1_000_000
#: An id pair as one long: A's id, then B's below this many bits.
ID_BITS = 31

_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def piece_path() -> str:
    """The public model of pieces: ``TOKENIZER_PIECES``, or the file of the installed package."""
    chosen = os.environ.get("TOKENIZER_PIECES")
    package = importlib.util.find_spec("public_tokenizers") if not chosen else None
    return chosen or os.path.join(os.path.dirname(package.origin), "piece_bpe_32k.model")


class Tokenizer:
    """Ids of texts and the bytes of each id."""

    def __init__(self, encode, token_bytes: list[bytes]):
        self.encode, self.token_bytes = encode, token_bytes
        self.lengths = np.array([len(token) for token in token_bytes], np.int64)


def byte_tokenizer(ranks_path: str) -> Tokenizer:
    """The byte-level vocabulary whose ranks a file holds; marks of special tokens are plain text."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    token_bytes = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        token_bytes[rank] = token
    return Tokenizer(lambda texts: [made.encode_ordinary(" " + text) for text in texts], token_bytes)


def piece_tokenizer(model_path: str) -> Tokenizer:
    """The vocabulary of pieces in a model file; byte pieces stand for their byte, U+2581 for a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def bytes_of(k: int) -> bytes:
        piece = model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode("utf-8")

    tokens = [bytes_of(k) for k in range(model.get_piece_size())]
    return Tokenizer(lambda texts: model.encode(texts, num_threads=1), tokens)


def _laid(tokens: list[list[int]], tokenizer: Tokenizer) -> pd.DataFrame:
    """Tokens of a block of documents end to end: id, the block's byte where each starts and ends, and its document."""
    ids = np.concatenate([np.asarray(t, np.int64) for t in tokens]) if tokens else np.zeros(0, np.int64)
    ends = np.cumsum(tokenizer.lengths[ids])
    document = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    return pd.DataFrame({"start": ends - tokenizer.lengths[ids], "end": ends, "id": ids, "doc": document})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of a, of b) of all tokens whose byte ranges overlap.

    Each start of one side finds the token of the other side that covers it, in both directions; every overlap
    begins at the start of one of its tokens. Both sides tile the same bytes, document after document, so the place
    in the block is also the key of the document.
    """
    left = pd.DataFrame({"start": a["start"], "a": np.arange(len(a))})
    right = pd.DataFrame({"start": b["start"], "b": np.arange(len(b))})
    forth = pd.merge_asof(left, right, on="start")
    back = pd.merge_asof(right, left, on="start")
    starts_later = a["start"].to_numpy()[back["a"].to_numpy()] != b["start"].to_numpy()
    back = back[starts_later]  # where both start together the first direction has the pair
    return np.r_[forth["a"].to_numpy(), back["a"].to_numpy()], np.r_[forth["b"].to_numpy(), back["b"].to_numpy()]


class _Aligner:
    def __init__(self, ranks_path: str, model_path: str):
        self.a, self.b = byte_tokenizer(ranks_path), piece_tokenizer(model_path)
        # Per id its decimal followed by each of the marks that may come after it.
        marks = [b",", b"|", b";"]
        self.words = [b"%d%s" % (k, m) for k in range(max(len(self.a.lengths), len(self.b.lengths))) for m in marks]

    def tokens(self, text: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the joined token bytes of either differ from space and text."""
        strings = [t.decode("utf-8") for t in text]
        sides = self.a.encode(strings), self.b.encode(strings)
        for k, t in enumerate(text):
            whole = b" " + t
            sound = t and all(
                b"".join(map(side.token_bytes.__getitem__, ids[k])) == whole
                for side, ids in zip((self.a, self.b), sides, strict=True)
            )
            if not sound:
                sides[0][k], sides[1][k] = [], []
        return sides

    def align(self, text: list[bytes]) -> dict[str, pa.Array]:
        tokens_a, tokens_b = self.tokens(text)
        a, b = _laid(tokens_a, self.a), _laid(tokens_b, self.b)
        docs = len(text)
        n_a, n_b = (np.bincount(side["doc"], minlength=docs) for side in (a, b))
        row_a, row_b = overlaps(a, b)
        n_overlaps = np.bincount(a["doc"].to_numpy()[row_a], minlength=docs)
        # Overlapping tokens that end together close a group.
        closing = a["end"].to_numpy()[row_a] == b["end"].to_numpy()[row_b]
        groups = []
        for rows, side in ((row_a, a), (row_b, b)):
            last = np.zeros(len(side), bool)
            last[rows[closing]] = True
            groups.append((np.cumsum(last) - last, last))
        (group_a, last_a), (group_b, last_b) = groups
        count = int(last_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        of_doc = a["doc"].to_numpy()[last_a]
        n_groups = np.bincount(of_doc, minlength=docs)
        n_links = np.zeros(docs, np.int64)
        np.add.at(n_links, of_doc, size_a * size_b)
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        pairs, times = self._linked(ids_a, ids_b, size_a, size_b, of_doc, docs)
        return {
            "n_a": pa.array(n_a, pa.int64()),
            "n_b": pa.array(n_b, pa.int64()),
            "n_groups": pa.array(n_groups, pa.int64()),
            "n_links": pa.array(n_links),
            "n_overlaps": pa.array(n_overlaps, pa.int64()),
            "groups_sha256": pa.array(self._digests(ids_a, ids_b, group_a, group_b, last_a, last_b, n_a + n_b)),
            "pairs": pairs,
            "times": times,
        }

    @staticmethod
    def _linked(ids_a, ids_b, size_a, size_b, of_doc, docs) -> tuple[pa.ListArray, pa.ListArray]:
        """Per document its distinct linked id pairs and how often each is linked."""
        from_a, from_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        wide = size_a * size_b > WIDE_GROUP
        at = np.flatnonzero(~wide)
        links = size_a[at] * size_b[at]
        group = np.repeat(at, links)
        place = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        code = ids_a[from_a[group] + place // size_b[group]] << ID_BITS | ids_b[from_b[group] + place % size_b[group]]
        codes, owners, weights = [code], [of_doc[group]], [np.ones(len(code), np.int64)]
        for g in np.flatnonzero(wide):
            one, times_one = np.unique(ids_a[from_a[g] : from_a[g] + size_a[g]], return_counts=True)
            two, times_two = np.unique(ids_b[from_b[g] : from_b[g] + size_b[g]], return_counts=True)
            codes.append((one[:, None] << ID_BITS | two[None, :]).ravel())
            weights.append((times_one[:, None] * times_two[None, :]).ravel())
            owners.append(np.full(len(codes[-1]), of_doc[g]))
        code, owner, weight = np.concatenate(codes), np.concatenate(owners), np.concatenate(weights)
        order = np.lexsort((code, owner))
        code, owner, weight = code[order], owner[order], weight[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]) if len(code) else np.zeros(0, int)
        weight = np.add.reduceat(weight, first) if len(first) else weight
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(owner[first], minlength=docs))], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(code[first])), pa.ListArray.from_arrays(offsets, pa.array(weight))

    def _digests(self, ids_a, ids_b, group_a, group_b, last_a, last_b, per_doc) -> list[str]:
        """SHA-256 of each document's groups as text, built from the decimals and the marks after them."""
        count = int(last_a.sum())
        before_a, before_b = (np.r_[0, np.cumsum(np.bincount(group, minlength=count))] for group in (group_a, group_b))
        word = np.empty(len(ids_a) + len(ids_b), np.int64)
        # A's tokens of a group come first: behind B's of all groups before, B's behind A's up to their own group.
        word[np.arange(len(ids_a)) + before_b[group_a]] = 3 * ids_a + last_a
        word[np.arange(len(ids_b)) + before_a[group_b + 1]] = 3 * ids_b + 2 * last_b
        words = list(map(self.words.__getitem__, word.tolist()))
        ends = np.cumsum(per_doc).tolist()
        return [
            hashlib.sha256(b"".join(words[lo:hi])[:-1]).hexdigest() if hi > lo else "" for lo, hi in pairwise([0, *ends])
        ]


def aligned(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Per row the tokens, groups, links and overlaps, with the distinct linked id pairs and their times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(ranks_path, model_path)
        for part in pieces(batches, BLOCK_BYTES):
            yield batch(doc_id=part.column("doc_id"), **aligner.align(text_bytes(part)))

    return arrow_map(texts(docs), work, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, in how many rows it is linked, and whether that is the most of its A id. Tasks add up what they
    meet before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in pieces(batches):
            held.append(np.unique(part.column("pairs").flatten().to_numpy(), return_counts=True))
            if sum(len(pair) for pair, _ in held) > COUNTED_PAIRS:
                held = [added(held)]
                if len(held[0][0]) > COUNTED_PAIRS // 2:
                    yield batch(pair=held[0][0], n=held[0][1])
                    held = []
        if held:
            pair, n = added(held)
            yield batch(pair=pair, n=n)

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, where, np.concatenate([c for _, c in held]))
        return pair, n

    counts = saved(arrow_map(rows.select("pairs"), work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy(F.shiftright("pair", ID_BITS).alias("a")).agg(F.max("n").alias("most"))
    best = F.broadcast(most)  # a row per id of the vocabulary at most
    return counts.join(best, F.shiftright("pair", ID_BITS) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best")
    )


def align(docs: DataFrame, ranks_path: str, model_path: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Per row the tokens of both vocabularies, the groups they fall into and how common their links are.

    A (byte-level) reads a space and the text, B (pieces) the text, to which it adds the space. Starts of either side
    are matched to the covering token of the other with ``merge_asof``, both directions give the overlaps, and equal
    ends among them close the groups. Texts are encoded once: the linked pairs of each row are kept in the shared
    folder, counted over the corpus and looked up again. The most frequent pairs, ``held_pairs`` at most, go to the
    tasks as sorted arrays; rows that hold rarer ones are joined to those.

    Null and empty texts, and texts that either side doesn't give back byte for byte (with a U+2581, say), have no
    tokens: zeros and an empty hash. Whole texts are read, however long; a run without common ends is one group, of
    which only distinct ids are paired. Repeated rows and rows without an id count like any other, row by row. Other
    columns are left out.
    """
    spark = docs.sparkSession
    rows = saved(aligned(docs, ranks_path, model_path), "aligned")
    counts = saved(pair_counts(rows), "pair_counts")
    # Pairs by powers of two of their count: a few dozen rows. As many of the top ones as may be held.
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    least, total = 1 << (sizes[0]["power"] + 1 if sizes else 0), 0
    for size in sizes:
        total += size["count"]
        if total > held_pairs:
            break
        least = 1 << size["power"]
    table = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    pair, n, best = (table.column(name).to_numpy() for name in ("pair", "n", "best"))
    sent = spark.sparkContext.broadcast((pair, n, best))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for part in pieces(batches):
            own, offsets = part.column("pairs").flatten().to_numpy(), part.column("pairs").offsets.to_numpy()
            times, offsets = part.column("times").flatten().to_numpy(), offsets - offsets[0]
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            weight = np.where(known, times, 0)
            at = np.where(known, at, 0)
            sums = [np.r_[0, np.cumsum(weight * (w[at] if len(pair) else 0))] for w in (n, best)]
            rest = np.r_[0, np.cumsum(~known)][offsets]
            rare = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(v[~known])) for v in (own, times)]
            yield batch(
                **{name: part.column(name) for name in names},
                n_best=np.diff(sums[1][offsets]),
                count_sum=np.diff(sums[0][offsets]),
                pairs=rare[0],
                times=rare[1],
            )

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]
    schema = _ALIGNED.replace("pairs array", "n_best long, count_sum long, pairs array")
    told = arrow_map(rows, work, schema)
    if least > 1:  # equal groups have equal links: rarer pairs are added up once per hash
        told = saved(told, "told")
        rare = told.where(F.size("pairs") > 0).groupBy("groups_sha256").agg(F.first(F.arrays_zip("pairs", "times")).alias("own"))
        rare = rare.select("groups_sha256", F.inline("own")).withColumnRenamed("pairs", "pair")
        sums = rare.join(counts.where(F.col("n") < least), "pair").groupBy("groups_sha256").agg(
            F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
        )
        told = told.drop("pairs", "times").join(sums, "groups_sha256", "left")
        told = told.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        told = told.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return told.select(*names, "n_best", "count_sum")
