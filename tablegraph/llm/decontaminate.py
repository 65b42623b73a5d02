"""Benchmark decontamination: bounds from grams, CGK embeddings with bit-sampling LSH, edit verification of all that is left."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.common import WordHashes, arrow_map, batch, pieces, text_bytes, texts

#: Edits allowed per character of an item.
EDITS = 0.2
#: Random walks, tables of each, and symbols a table samples. A window that begins a word off and has edits
#: besides keeps about half of the sampled symbols, so one table misses it with 1 - 0.5 ** 3 and all 24 with
#: 4 %; what they miss is verified without them.
WALKS, TABLES, SYMBOLS = 4, 6, 3
#: Symbols are sampled from the steps in which a walk is still inside its string.
REACH = 1.8
#: Bytes of a gram of a document; grams lie end to end.
GRAM = 6
#: Edits up to which a gram is told from the strings of an item; it counts one more where none is so near.
NEAR = 2
#: Slots of a table of items' grams, as a power of two. A gram stands in two of them; one that shares both with others
#: has its bound lowered, never raised.
SLOT_BITS = 16
#: Grams whose bounds a task remembers, two bits an item.
REMEMBERED_GRAMS = 1 << 19
#: Grams whose bounds are added up at once: as many as stay in a core's cache for all items.
ADDED_GRAMS = 1024
#: Groups of items whose sums are held at once, over all grams of the text searched.
ADDED_GROUPS = 8
#: Bytes of benchmark text, and items, searched for at once: tables take a byte an item for eight slots.
BLOCK_BYTES, BLOCK_ITEMS = 256 << 10, 256
#: Bytes of document text searched at once; longer texts are cut, with as much overlap as a passage is long.
TEXT_BYTES = 2 << 20
#: Windows embedded or verified at once.
AT_ONCE = 4096
#: Windows up to which they are sooner verified one by one.
FEW = 64
#: Stretches whose texts are held at once, to be dealt by length.
STRETCHES = 8 * AT_ONCE

SCHEMA = "doc_id long, item_id long, first_word int, edits int, n_chars int"


@dataclass
class Index:
    """Items of one block: texts, where each byte stands in them, and the buckets of their embeddings."""

    ids: list[int]
    items: list[bytes]
    lengths: np.ndarray
    room: np.ndarray  # edits allowed
    masks: list[np.ndarray]  # per item, byte and 64 places of it: where the byte stands; places before the item match all
    heads: list[np.ndarray]  # the same of its first half, made up to whole words
    buckets: dict[int, list[int]]


def _random() -> tuple[np.ndarray, np.ndarray]:
    """The walks' fixed random bits per (walk, step mod 4096, byte) and the sampled places as shares of the reach."""
    source = np.random.default_rng(20_240_601)
    bits = source.integers(0, 2, (WALKS, 4096, 256), dtype=np.uint8)
    return bits, source.random((WALKS, TABLES * SYMBOLS))


def bucket_keys(strings: np.ndarray, lengths: np.ndarray, bits: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """A key per string and table. ``strings`` is a matrix of bytes padded with zeros.

    A walk writes the byte under its pointer and then moves on or stays, as a random bit of the step and the
    byte says; two strings walk in step again soon after an edit, so the written strings differ in few places.
    """
    rows = np.arange(len(strings))
    flat, begin = strings.ravel(), rows * strings.shape[1]
    steps = int(lengths.max() * REACH) + 1
    keys = []
    for walk in range(WALKS):
        at = np.zeros(len(strings), np.int64)
        written = np.zeros((steps, len(strings)), np.uint8)
        last = strings.shape[1] - 1
        for step in range(steps):
            byte = flat.take(begin + at)
            written[step] = byte
            at += bits[walk, step % 4096].take(byte)
            np.minimum(at, last, out=at)
        sampled = (shares[walk][None, :] * (lengths[:, None] * REACH)).astype(np.int64)
        symbols = written[sampled, rows[:, None]].reshape(len(strings), TABLES, SYMBOLS).astype(np.uint64)
        for table in range(TABLES):
            key = (lengths.astype(np.uint64) << np.uint64(46)) | np.uint64((walk * TABLES + table) << 40)
            for k in range(SYMBOLS):
                key |= symbols[:, table, k] << np.uint64(8 * k)
            keys.append(key)
    return np.stack(keys, axis=1)


def _matrix(strings: list[bytes]) -> np.ndarray:
    width = max(map(len, strings)) + 1
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def normal(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.lower().split()
    return words, b" ".join(words)


def _left_out() -> list[tuple[int, tuple[int, ...], list[tuple[int, tuple[int, ...]]]]]:
    """(edits, places left out of a gram, windows): a gram is so many edits from a string just when, for one of these
    entries, it is equal, without those places, to one of the item's windows of a size without some places of its own.

    A place changed is left out on both sides, one dropped of the gram alone, one added inside of the window alone.
    """
    inner = range(1, GRAM)
    entries = [(0, (), [(GRAM, ())]), (1, (), [(GRAM + 1, (q,)) for q in inner])]
    entries += [(1, (i,), [(GRAM, (i,)), (GRAM - 1, ())]) for i in range(GRAM)]
    entries.append((2, (), [(GRAM + 2, (p, q)) for q in range(2, GRAM + 1) for p in range(1, q)]))
    for i in range(GRAM):
        dropped = [(GRAM, (q,)) for q in range(1, GRAM - 1)]
        changed = [(GRAM + 1, tuple(sorted((q, i if i < q else i + 1)))) for q in inner]
        entries.append((2, (i,), dropped + changed))
        entries += [(2, (i, j), [(GRAM, (i, j)), (GRAM - 1, (i,)), (GRAM - 1, (j - 1,)), (GRAM - 2, ())]) for j in range(i + 1, GRAM)]
    return entries


def _slots(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of the string of these bytes."""
    key = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        key = key * np.uint64(0x100000001B3) + column
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    rest = np.uint64((1 << SLOT_BITS) - 1)
    return (key >> np.uint64(64 - SLOT_BITS)).astype(np.intp), (key & rest).astype(np.intp)


#: The bits of a byte as the bytes of a word, once and twice.
_SPREAD = sum((np.arange(256, dtype=np.uint64) >> np.uint64(k) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))
_SPREAD_TWICE = _SPREAD << np.uint64(1)


class Bounds:
    """Lower bounds, up to ``NEAR`` + 1, of the edits between a gram and any string of an item, remembered by gram.

    A table has a bit per slot and item. The items stand by length, eight to a word of bounds, a byte each. Remembered
    is how far a bound lies below the highest, as two bits.
    """

    def __init__(self, items: list[bytes], order: np.ndarray):
        self.words = -(-len(items) // 64)
        self.groups = -(-len(items) // 8)
        text = np.frombuffer(b"".join(items[k] for k in order.tolist()), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(items[k]) for k in order.tolist()])
        self.tables = []
        flags = np.zeros((1 << SLOT_BITS, self.words * 64), bool)
        for edits, places, windows in _left_out():
            flags[:] = False
            for size, gone in windows:
                n = max(0, len(text) - size + 1)
                whole = np.flatnonzero(owner[:n] == owner[size - 1 : size - 1 + n])
                for slots in _slots([text[whole + k] for k in range(size) if k not in gone]):
                    flags[slots, owner[whole]] = True
            bits = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
            self.tables.append((edits, [k for k in range(GRAM) if k not in places], bits))
        self._forget()

    def _forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.below = np.empty((REMEMBERED_GRAMS, 2, self.groups), np.uint8)

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of bounds per group of items and column, column of each gram) of distinct grams in order.

        The words of one gram lie side by side in memory.
        """
        place = np.searchsorted(self.known, grams)
        new = np.ones(len(grams), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != grams[inside]
        if len(self.known) + int(new.sum()) > REMEMBERED_GRAMS and len(self.known):
            self._forget()
            return self.of(grams)
        if new.any():
            first, last = len(self.known), len(self.known) + int(new.sum())
            if last > len(self.below):
                self.below = np.empty((last, 2, self.groups), np.uint8)  # nothing is known yet
            self._make(grams[new], self.below[first:last])
            self.at = np.insert(self.at, place[new], np.arange(first, last))
            self.known = np.insert(self.known, place[new], grams[new])
            place = np.searchsorted(self.known, grams)
        words = np.empty((len(grams), self.groups), np.uint64)
        for since in range(0, len(grams), ADDED_GRAMS):
            below = self.below.take(self.at[place[since : since + ADDED_GRAMS]], 0)
            own = words[since : since + ADDED_GRAMS]
            np.subtract(0x0101010101010101 * (NEAR + 1), _SPREAD.take(below[:, 0]), out=own)
            own -= _SPREAD_TWICE.take(below[:, 1])
        return words.T, np.arange(len(grams))

    def _make(self, grams: np.ndarray, out: np.ndarray) -> None:
        for since in range(0, len(grams), 2048):
            own = grams[since : since + 2048]
            columns = [(own >> np.uint64(8 * (GRAM - 1 - k))) & np.uint64(255) for k in range(GRAM)]
            near = np.zeros((NEAR + 1, len(own), self.words), np.uint64)
            one, other = np.empty_like(near[0]), np.empty_like(near[0])
            for edits, places, bits in self.tables:
                first, second = _slots([columns[k] for k in places])
                bits.take(first, 0, one, "clip")
                bits.take(second, 0, other, "clip")
                one &= other
                near[edits] |= one
            # What is found at some edits counts at more too: one below where at two alone, two at one, three at none.
            near[1] |= near[0]
            near[2] |= near[1]
            for k, bits in enumerate((near[0] ^ near[1] ^ near[2], near[1])):
                out[since : since + 2048, k] = bits.view(np.uint8)[:, : self.groups]


def build(rows: list[tuple[int, bytes]], edits: float) -> Index | None:
    """The index of the items that hold a word."""
    kept = [(item, plain) for item, text in rows if (plain := normal(text)[1])]
    if not kept:
        return None
    items = [plain for _, plain in kept]
    lengths = np.array([len(plain) for plain in items])
    masks = [_masks(plain) for plain in items]
    heads = [_masks(plain[:n]) for plain, n in zip(items, _head(lengths).tolist(), strict=True)]
    bits, shares = _random()
    buckets: dict[int, list[int]] = {}
    for k, row in enumerate(bucket_keys(_matrix(items), lengths, bits, shares).tolist()):
        for bucket in row:
            buckets.setdefault(bucket, []).append(k)
    room = np.array([int(edits * n) for n in lengths.tolist()])
    return Index([i for i, _ in kept], items, lengths, room, masks, heads, buckets)


def _head(lengths: np.ndarray) -> np.ndarray:
    """Places of the first half of items, made up to whole words of 64."""
    return np.minimum(lengths, -(-lengths // 128) * 64)


def _masks(plain: bytes) -> np.ndarray:
    free = -len(plain) % 64
    bits = np.zeros((256, free + len(plain)), np.uint8)
    bits[:, :free] = 1
    bits[np.frombuffer(plain, np.uint8), np.arange(free, free + len(plain))] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _scores(item: bytes, text: bytes, anchored: bool = False) -> Iterator[int]:
    """Per end in ``text``: the fewest edits between ``item`` and a string that ends there, or, ``anchored``, the text
    up to there. The bit-parallel recurrence over the columns of the edit matrix, one machine word of any length per
    column."""
    m = len(item)
    masks = [0] * 256
    for k, byte in enumerate(item):
        masks[byte] |= 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for byte in text:
        equal = masks[byte]
        horizontal = (((equal & up) + up) ^ up) | equal
        less = up & horizontal
        more = down | full & ~(horizontal | up)
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        yield score
        vertical = equal | down
        more = (more << 1 | anchored) & full
        up = less << 1 & full | full & ~(vertical | more)
        down = more & vertical


def least_edits(item: bytes, text: bytes) -> int:
    """Fewest edits between ``item`` and any substring of ``text``."""
    return min(_scores(item, text), default=len(item)) if item else 0


def _start(item: bytes, text: bytes, edits: int) -> int:
    """Where the first substring of ``text`` begins that is ``edits`` away, the fewest of all, from ``item``."""
    end = next(k for k, score in enumerate(_scores(item, text)) if score == edits) + 1
    back = next(k for k, score in enumerate(_scores(item[::-1], text[:end][::-1], True)) if score == edits) + 1
    return end - back


def _distances(index: Index, owners: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """``least_edits`` of many pairs at once, or a number above the edits allowed: half of each item decides most pairs.

    The first half has no more edits than the whole, and as many places of the string as the other half has may be left
    out at its end: where the passage has fewer there, it has as many edits more, and so may the first half.
    """
    heads, lengths = _head(index.lengths)[owners], index.lengths[owners]
    begun = [string[: max(0, len(string) - rest)] for string, rest in zip(strings, (lengths - heads).tolist(), strict=True)]
    best = _least_edits(index.heads, heads, owners, begun)
    left = np.flatnonzero((best <= index.room[owners]) & (heads < lengths))
    if len(left) > FEW:
        best[left] = _least_edits(index.masks, lengths[left], owners[left], [strings[k] for k in left.tolist()])
    else:
        best[left] = [least_edits(index.items[owners[k]], strings[k]) for k in left.tolist()]
    return best


def _least_edits(masks_of: list[np.ndarray], lengths: np.ndarray, owners: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Fewest edits between what the masks of each item stand for, of that length, and any substring: the recurrence of
    ``_scores``, 64 places to a word, a pair to a lane."""
    best = np.zeros(len(owners), np.int64)
    words = -(-lengths // 64)
    order = np.lexsort(([len(s) for s in strings], words))
    one, top, full = np.uint64(1), np.uint64(63), ~np.uint64(0)
    for same in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        for at in range(0, len(same), AT_ONCE):
            lanes = same[at : at + AT_ONCE]
            width = int(words[lanes[0]])
            text = np.ascontiguousarray(_matrix([strings[k] for k in lanes.tolist()]).T)
            held, own = np.unique(owners[lanes], return_inverse=True)
            masks = np.ascontiguousarray(np.stack([masks_of[k] for k in held.tolist()]).transpose(2, 0, 1)).reshape(width, -1)
            base = own.ravel() * 256
            free = (-lengths[lanes] % 64).astype(np.uint64)
            # No edits before the item's first place.
            up, down = [full << free] + [np.full(len(lanes), full) for _ in range(1, width)], [np.zeros(len(lanes), np.uint64)] * width
            score = width * 64 - free.astype(np.int64)
            least = score.copy()
            for column in text[:-1]:
                place = base + column
                for w in range(width):
                    equal = masks[w].take(place)
                    vertical = equal | down[w]
                    if w:
                        equal |= minus
                    horizontal = equal & up[w]
                    horizontal += up[w]
                    horizontal ^= up[w]
                    horizontal |= equal
                    more, less = horizontal | up[w], up[w] & horizontal
                    np.invert(more, out=more)
                    more |= down[w]
                    out_plus, out_minus = more >> top, less >> top
                    more <<= one
                    less <<= one
                    if w:
                        more |= plus
                        less |= minus
                    down[w] = more & vertical
                    vertical |= more
                    np.invert(vertical, out=vertical)
                    less |= vertical
                    up[w] = less
                    plus, minus = out_plus, out_minus
                score += plus.view(np.int64)
                score -= minus.view(np.int64)
                np.minimum(least, score, out=least)
            best[lanes] = least
    return best


def _sums(packed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Per group of items the sums of the bounds of all grams before each place, and of all."""
    n, rows = len(place), np.ascontiguousarray(packed.T)
    out = np.zeros((len(packed), n + 1), np.uint64)
    for since in range(0, n, ADDED_GRAMS):
        own = rows.take(place[since : since + ADDED_GRAMS], 0)
        own[0] += out[:, since]
        np.cumsum(own, axis=0, out=out[:, since + 1 : since + 1 + len(own)].T)
    return out


def _windows(index: Index, order: np.ndarray, packed: np.ndarray, place: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, grams, sums): where the bounds of the grams from there on, as many as a passage of the item holds, add
    up to no more than its room. Eight items of like length are added up at once, a byte of a word each.
    """
    most, n = NEAR + 1, len(place)
    # Large arrays are made once: to make them anew for each group costs as much as to fill them.
    within_of, high_of, flags = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64), np.empty(n + 1, bool)
    for group in range(len(packed)):
        if group % ADDED_GROUPS == 0:
            sums_of = _sums(packed[group : group + ADDED_GROUPS], place)
        own, added = order[8 * group : 8 * group + 8], sums_of[group % ADDED_GROUPS]
        able = (held[own] > 0) & (held[own] <= len(place)) & (most * held[own] > index.room[own])
        # Sums pass 64 bits, their differences do not: a byte holds what a window may add up to, and its high bit
        # stays within room.
        small = able & (index.room[own] < 128) & (most * held[own] <= 128 + index.room[own])
        if small.any():
            fewest, room = int(held[own[small]].min()), np.zeros(8, np.uint8)
            room[: len(own)] = np.where(small, index.room[own], 127) | 128
            left, high, rest = (array[: n + 1 - fewest] for array in (within_of, high_of, flags))
            np.subtract(added[fewest:], added[:-fewest], out=left)
            np.subtract(room.view(np.uint64)[0], left, out=left)
            np.bitwise_and(left, _bytes(np.where(small, 128, 0)), out=high)
            np.not_equal(high, 0, out=rest)
            some = np.flatnonzero(rest)
            left = left[some].view(np.uint8).reshape(-1, 8)
        for k in np.flatnonzero(able).tolist():
            item = int(own[k])
            grams_of, allowed = int(held[item]), int(index.room[item])
            if small[k]:
                at = some[np.flatnonzero(left[:, k] & 128)]
                at = at[: np.searchsorted(at, n - grams_of, "right")]  # this item's passages may hold more grams
                sums = added.take(at + grams_of) - added.take(at)
                sums = (sums >> np.uint64(8 * k) & np.uint64(255)).astype(np.int64)
            else:
                sums = np.cumsum(np.r_[0, np.diff(added).view(np.uint8)[k::8].astype(np.int64)])
                sums = sums[grams_of:] - sums[:-grams_of]
                at = np.arange(len(sums))
            good = sums <= allowed
            yield item, at[good], sums[good]


def _bytes(values: np.ndarray) -> np.uint64:
    """Up to eight small numbers as the bytes of a word."""
    out = np.zeros(8, np.uint8)
    out[: len(values)] = values
    return out.view(np.uint64)[0]


def _regions(index: Index, near: Bounds, texts_of: list[bytes]) -> np.ndarray:
    """Columns (text, item, begin, end, window) of all stretches that may hold a passage of the item.

    Grams of a document lie end to end, so those inside a passage are turned into strings of the item one by one:
    the passage has no fewer edits than they have together, and it holds as many as the shortest passage must. A
    stretch is left out only where their bounds add up to more than the edits allowed. ``window`` is where the least
    sum begins, if it is at most half of what is allowed, else -1.
    """
    padded = [text + b"\0" * (-len(text) % GRAM) for text in texts_of]
    joined = np.frombuffer(b"".join(padded), np.uint8)
    n = len(joined) // GRAM
    # Grams that a passage of an item holds at least, wherever it begins.
    held = (index.lengths - index.room - GRAM + 1) // GRAM
    sizes_of = np.array([len(text) for text in texts_of])
    out = [np.empty((5, 0), np.int64)]
    for item in np.flatnonzero((held <= 0) | ((NEAR + 1) * held <= index.room)).tolist():
        k = np.flatnonzero(sizes_of >= index.lengths[item] - index.room[item])
        out.append(np.stack([k, np.full_like(k, item), np.zeros_like(k), sizes_of[k], np.full_like(k, -1)]))
    if n <= 0:
        return np.concatenate(out, axis=1)
    sizes = np.array([len(text) // GRAM for text in padded])
    owner, first = np.repeat(np.arange(len(padded)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
    keys = np.zeros(n, np.uint64)
    for k in range(GRAM):
        keys = keys << np.uint64(8) | joined[k::GRAM]
    grams, place = np.unique(keys, return_inverse=True)
    packed, columns = near.of(grams)
    place = columns[place]
    for item, at, here in _windows(index, _by_length(index), packed, place, held):
        grams_of, room = int(held[item]), int(index.room[item])
        whole = owner[at] == owner[np.minimum(at + grams_of - 1, n - 1)]
        at, here = at[whole], here[whole]
        if not len(at):
            continue
        of = owner[at]
        fresh = np.ones(len(at), bool)
        np.logical_or(at[1:] - at[:-1] > grams_of, of[1:] != of[:-1], out=fresh[1:])
        lo = np.flatnonzero(fresh)
        hi = np.append(lo[1:], len(at)) - 1
        # The first of the least sums of each stretch: sums and places as one number.
        least = np.minimum.reduceat(here * len(at) + np.arange(len(at)), lo) % len(at)
        k = of[lo]
        begin, end, window = (GRAM * (at[x] - first[k]) for x in (lo, hi, least))
        end = np.minimum(sizes_of[k], end + int(index.lengths[item]) + room)
        window[2 * here[least] > room] = -1
        out.append(np.stack([k, np.full_like(k, item), np.maximum(0, begin - GRAM + 1), end, window]))
    return np.concatenate(out, axis=1)


def _by_length(index: Index) -> np.ndarray:
    return np.argsort(index.lengths, kind="stable")


def _parts(index: Index, plain: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text, offset, bytes) of texts put together, or cut, to about ``TEXT_BYTES``."""
    overlap, size = int((index.lengths + index.room).max()), 0
    part: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    for k, text in enumerate(plain):
        for at in range(0, max(1, len(text) - overlap), TEXT_BYTES):
            own = text[at : at + TEXT_BYTES + overlap]
            for column, value in zip(part, (k, at, own), strict=True):
                column.append(value)
            size += len(own)
            if size >= TEXT_BYTES:
                yield part
                part, size = ([], [], []), 0
    if part[0]:
        yield part


def _meet(index: Index, opened: list[tuple[int, bytes]]) -> list[bool]:
    """Whether the embedding of an item-sized window meets the item's in one of the tables."""
    bits, shares = _random()
    out: list[bool] = []
    for at in range(0, len(opened), AT_ONCE):
        part = opened[at : at + AT_ONCE]
        lengths = np.array([index.lengths[item] for item, _ in part])
        strings = [window for _, window in part]
        keys = bucket_keys(_matrix(strings + [b"\0" * int(lengths.max())])[:-1], lengths, bits, shares)
        out += [any(item in index.buckets.get(key, ()) for key in row) for (item, _), row in zip(part, keys.tolist(), strict=True)]
    return out


def _search(index: Index, edits: float, docs: list[bytes], hashes: WordHashes | None = None, near: Bounds | None = None) -> list[tuple[int, int, int, int, int]]:
    """(place of the document, item, first word, edits, characters) of all passages within ``edits``, best per item."""
    plain = [normal(text)[1] for text in docs]
    near = near or Bounds(index.items, _by_length(index))
    made, opened = [], []
    for owners, offsets, texts_of in _parts(index, plain):
        k, item, begin, end, window = _regions(index, near, texts_of)
        # Long stretches are cut, with as much overlap as a passage is long, so that lanes are of like length.
        reach = index.lengths[item] + index.room[item]
        step = np.maximum(256, reach)
        cuts = np.maximum(1, -(-(end - reach - begin) // step))
        of = np.repeat(np.arange(len(k)), cuts)
        at = begin[of] + step[of] * (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        inside = np.flatnonzero((at <= window[of]) & (window[of] < at + step[of]))
        since = sum(part.shape[1] for part in made)
        for place, text, own, first in zip(inside.tolist(), *(column[of[inside]].tolist() for column in (k, item, window)), strict=True):
            opened.append((since + place, own, texts_of[text][first : first + int(index.lengths[own])]))
        shift = np.array(offsets)[k[of]]
        made.append(np.stack([np.array(owners)[k[of]], item[of], shift + at, shift + np.minimum(end[of], at + step[of] + reach[of])]))
    columns = np.concatenate(made, axis=1) if made else np.empty((4, 0), np.int64)
    if not columns.shape[1]:
        return []
    met = _meet(index, [(item, window) for _, item, window in opened])
    first = np.array([at for (at, _, _), meets in zip(opened, met, strict=True) if meets], np.int64)
    distances = np.empty(columns.shape[1], np.int64)
    distances[first] = [least_edits(index.items[item], plain[k][begin:end]) for k, item, begin, end in columns[:, first].T.tolist()]
    # What no table brings together is verified too, many at a time.
    rest = np.ones(len(distances), bool)
    rest[first] = False
    rest = np.flatnonzero(rest)
    for since in range(0, len(rest), STRETCHES):
        some = rest[since : since + STRETCHES]
        own, item, begin, end = columns[:, some]
        strings = [plain[k][low:high] for k, low, high in zip(own.tolist(), begin.tolist(), end.tolist(), strict=True)]
        distances[some] = _distances(index, item, strings)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    good = np.flatnonzero(distances <= index.room[columns[1]])
    for (k, item, begin, end), distance in zip(columns[:, good].T.tolist(), distances[good].tolist(), strict=True):
        best[k, item] = min(best.get((k, item), (distance + 1, 0, 0)), (distance, begin, end))
    out = []
    for (k, item), (distance, begin, end) in sorted(best.items()):
        start = begin + _start(index.items[item], plain[k][begin:end], distance)
        out.append((k, item, plain[k].count(b" ", 0, start + 1), distance, len(index.items[item])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Passages of benchmark items in documents: one row per document row and item, with its fewest edits.

    Texts are compared in lower case with single spaces. A passage counts when some substring of the
    document is within ``edits`` times the item's length of the whole item in edit distance; ``first_word`` is the
    word it begins in. None is left out: stretches are passed over only where bounds of their grams add up to more
    edits (``_regions``). In the others, windows whose sampled CGK embeddings meet the item's in one of 24 tables
    are verified one by one, and all that meet in none are verified too. Items of fewer than some twenty characters
    have too few grams for a bound and are verified over whole texts.

    The benchmark is a stated set of queries, searched for in blocks of bounded size: each block is
    collected, indexed and sent to the tasks, and the documents are read once per block. Items with a null
    or empty text are no passage, and neither is an item without an id. An empty table on
    either side gives no row; null ids and repeated rows are searched row by row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES), -(-n // BLOCK_ITEMS))
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct()
        index = build(sorted((row["item_id"], row["text"].encode("utf-8")) for row in own.collect()), edits)
        if index is not None:
            part = _scan(docs, spark.sparkContext.broadcast({"index": vars(index)}), edits)
            found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def _scan(docs: DataFrame, shared, edits: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A Python worker keeps the value of a broadcast while its tasks use it: the next one finds tables and bounds there.
        kept = shared.value
        index = Index(**kept["index"])
        if "near" not in kept:
            kept["near"] = Bounds(index.items, _by_length(index))
        near = kept["near"]
        for part in pieces(batches):
            found = _search(index, edits, text_bytes(part), near=near)
            if found:
                where, item, word, distance, size = zip(*found, strict=True)
                yield batch(
                    doc_id=part.column("doc_id").take(pa.array(where)),
                    item_id=pa.array([index.ids[i] for i in item], pa.int64()),
                    first_word=pa.array(word, pa.int32()),
                    edits=pa.array(distance, pa.int32()),
                    n_chars=pa.array(size, pa.int32()),
                )

    return arrow_map(texts(docs), work, SCHEMA)
