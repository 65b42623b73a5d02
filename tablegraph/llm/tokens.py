"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablegraph.llm.common import arrow_map, batch, pieces, text_bytes, texts

#: Trie nodes a task keeps before it starts a new trie.
MOST_NODES = 1_500_000
#: Pre-tokens longer than this are scored on their own, outside the trie.
LONGEST_STORED = 256

SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_bytes long"


def unigram(ranks_path: str) -> dict[bytes, float]:
    """A score per token of a public vocabulary.

    The vocabulary lists tokens by falling frequency, so by Zipf's law the logarithm of a token's
    probability is minus the logarithm of its place, up to a constant that each token adds.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    norm = math.log(sum(1.0 / (rank + 1) for rank in ranks.values()))
    return {token: -math.log(rank + 1) - norm for token, rank in ranks.items()}


class Trie:
    """Pre-tokens by bytes. Each node holds the best score of its prefix and the number of tokens of that
    segmentation (fewer tokens among equal scores); a prefix is scored once, however many pre-tokens share it."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.best = [0.0]
        self.tokens = [0]

    def insert(self, word: bytes) -> int:
        """Insert a pre-token and return the token count stored at its end."""
        children, node, path = self.children, 0, [0]
        for depth, value in enumerate(word):
            child = children[node].get(value)
            if child is None:
                child = self._grow(node, word, depth + 1, path)
            node = child
            path.append(node)
        return self.tokens[node]

    def _grow(self, parent: int, word: bytes, depth: int, path: list[int]) -> int:
        scores, best, tokens = self.scores, self.best, self.tokens
        top, count = -math.inf, 0
        for start in range(max(0, depth - self.longest), depth):
            score = scores.get(word[start:depth])
            if score is not None:
                before = path[start]
                score += best[before]
                n = tokens[before] + 1
                if score > top or score == top and n < count:
                    top, count = score, n
        child = len(self.children)
        self.children.append({})
        best.append(top)
        tokens.append(count)
        self.children[parent][word[depth - 1]] = child
        return child


class _Counts(dict):
    """Terminal counts by pre-token, filled through the trie."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8")
        if len(raw) > LONGEST_STORED:  # a text without breaks: its own trie, dropped at once
            return Trie(self.trie.scores).insert(raw)
        count = self[word] = self.trie.insert(raw)
        return count


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Pre-tokens, tokens and bytes of every whole text.

    Pre-tokens are those of the public byte-level pattern. A task inserts the distinct pre-tokens it meets
    into a trie whose nodes are bounded (a full trie is dropped and begun anew, which changes no count), and
    sums the stored counts over each text; nothing is shuffled. All 256 bytes are tokens, so every text has a
    segmentation. A null or empty text counts zero; repeated rows and null ids are counted row by row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        pretokens = regex.compile(public_tokenizers.PATTERN)
        trie = Trie(unigram(ranks_path))
        counts = _Counts(trie)
        for part in pieces(batches):
            n_words, n_tokens, n_bytes = [], [], []
            for text in text_bytes(part):
                words = pretokens.findall(text.decode("utf-8"))
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
                n_bytes.append(len(text))
                if len(trie.children) > MOST_NODES:
                    trie.clear()
                    counts.clear()
            yield batch(
                doc_id=part.column("doc_id"),
                n_pretokens=pa.array(n_words, pa.int64()),
                n_tokens=pa.array(n_tokens, pa.int64()),
                n_bytes=pa.array(n_bytes, pa.int64()),
            )

    return arrow_map(texts(docs), work, SCHEMA)
