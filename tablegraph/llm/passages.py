"""Substring deduplication: compact windows of token min-hashes, joined by interval and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm.common import (
    BROADCAST_BYTES,
    SHINGLE,
    arrow_map,
    batch,
    join_checked,
    lists,
    mixed,
    pieces,
    saved,
    shingles,
    text_bytes,
    texts,
    word_hashes,
    word_hashes_of,
    wrapping_powers,
)

#: Words of the shortest passage.
LEAST_WORDS = 50
#: Hash functions. Each finds every exact repeat; two passages of similarity 0.8 share the least hash under
#: one of them at least with probability 1 - 0.2 ** 3.
FUNCTIONS = 3
#: Similarity of the shingle sets of two passages.
SHARE, PARTS = 80, 100
REMEMBERED_TEXTS = 200_000
#: Bytes of texts, or stretches, laid end to end to be worked on at once.
WINDOWED_BYTES = 1 << 18
#: Shingles read on either side of the meetings of two texts: a passage of two parts, each just too short to be one
#: by itself, may have its only meeting at the far end of one of them.
MARGIN = 128
#: Bytes of a word's hash that travel with a stretch. Shingles are made of five of them where stretches meet, so two
#: that differ in one word alone are taken for equal once in 2 ** 40.
WORD_BYTES = 5
#: Bytes of a range of places in a row of Spark.
RANGE_BYTES = 48
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_MET = "doc_a long, place_a int, doc_b long, place_b int, star boolean, part int, window long, beside int, key long"
_EXTRA = (("window", pa.int64()), ("beside", pa.int32()), ("key", pa.int64()))

_FOUND = (
    "doc_id long, n_words int, key long, key2 long, windows array<long>, places array<long>, beside array<int>, "
    "values array<long>, begins array<int>"
)

SPANS = "doc_id long, first_word int, n_words int, other_doc_id long"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minima inside blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, _NONE)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _centres(values: np.ndarray, width: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in the order of ``values``, and the centres of the compact windows alone.

    ``whole`` tells, where ``values`` are of several texts, which of the places begin ``width`` tokens of one.
    """
    n = len(values)
    # The place fills the low bits, so values are distinct and the first of equal ones is the least.
    bits = np.uint64(max(24, n.bit_length()))
    ranked = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    if n < width:
        return ranked, np.zeros(0, np.int64)
    least = _least(ranked, width)
    # Least values stand at places that never fall back, so equal ones lie side by side.
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if whole is not None:
        at = at[whole]
    return ranked, at[np.r_[True, at[1:] != at[:-1]]]


def compact_windows(values: np.ndarray, width: int) -> tuple[list[int], list[int], list[int]]:
    """(left, centre, right) of the compact windows of at least ``width`` tokens.

    They are the nodes of the Cartesian tree over ``values`` whose subtree spans ``width`` tokens: every
    subsequence of that length has its least value, the first of equal ones, at the centre of exactly one of
    them. A node spans that much just when it is the least of some ``width`` consecutive tokens, and then so
    do its ancestors; so the tree is built over those tokens alone.
    """
    ranked, chosen = _centres(values, width)
    centres = chosen.tolist()
    left, right = _reaches(centres, ranked[chosen].tolist(), 0, len(values) - 1)
    return left, centres, right


def _reaches(centres: list[int], heights: list[int], first: int, last: int) -> tuple[list[int], list[int]]:
    """How far each centre is the least, to the left and to the right, in a sequence from ``first`` to ``last``."""
    left, right, stack = [first] * len(centres), [last] * len(centres), []
    for k, height in enumerate(heights):
        while stack and heights[stack[-1]] > height:
            right[stack.pop()] = centres[k] - 1
        if stack:
            left[k] = centres[stack[-1]] + 1
        stack.append(k)
    return left, right


def _thinned(values: np.ndarray, centres: list[int], step: int) -> list[int]:
    """``centres`` without most of those in a row that have one value, as in a text of one repeated line: the
    first and last stay and one every ``step`` tokens, so a passage of twice that still holds one."""
    kept: list[int] = []
    for k, at in enumerate(centres):
        last = k + 1 == len(centres) or values[centres[k + 1]] != values[at]
        if not kept or last or values[kept[-1]] != values[at] or at - kept[-1] >= step:
            kept.append(at)
    return kept


def _function(grams: np.ndarray, k: int) -> np.ndarray:
    return mixed(grams ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))


def _key(grams: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.md5(grams.tobytes()).digest(), np.int64).tolist())


def windows(docs: DataFrame, least_words: int, functions: int) -> DataFrame:
    """Per document its text's key, and the join keys and centres of its compact windows, and 31 bits of the
    shingle that follows the centre's words.

    A window's join key is the function and its least shingle. The intervals of the first function's windows are
    kept too (``_intervals``): ``values`` holds their keys in order, ``begins`` the first place of each, and the last
    one ends with the text. Copies met by one task send theirs once; a row without an id sends none.
    """
    width = least_words - SHINGLE + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for part in pieces(batches, WINDOWED_BYTES):
            words, lengths = word_hashes_of(text_bytes(part))
            # Shingles at the end of a text would reach into the next one: they are left out.
            grams, past = shingles(words), np.cumsum(lengths)
            text_keys, rows, chosen = [], [], []
            named = part.column("doc_id").is_valid().to_pylist()
            for row, (begin, end) in enumerate(zip((past - lengths).tolist(), past.tolist(), strict=True)):
                own = grams[begin : end - SHINGLE + 1] if end - begin >= SHINGLE else shingles(words[begin:end])
                key = _key(own)
                text_keys.append(key)
                whole = key[0] << 64 | key[1] & 0xFFFFFFFFFFFFFFFF
                if named[row] and end - begin >= least_words and whole not in sent:
                    if len(sent) >= REMEMBERED_TEXTS:
                        sent.clear()
                    sent.add(whole)
                    rows.append(row)
                    chosen.append(own)
            made, ranges = _windows_of(chosen, np.array(rows, np.int64), width, functions)
            stacked = np.array(text_keys, np.int64).reshape(-1, 2)
            n = part.num_rows
            yield batch(
                doc_id=part.column("doc_id"),
                n_words=pa.array(lengths, pa.int32()),
                key=np.ascontiguousarray(stacked[:, 0]),
                key2=np.ascontiguousarray(stacked[:, 1]),
                windows=_lists_of(made[0], made[1], n, pa.int64()),
                places=_lists_of(made[0], made[2], n, pa.int64()),
                beside=_lists_of(made[0], made[3], n, pa.int32()),
                values=_lists_of(ranges[0], ranges[1], n, pa.int64()),
                begins=_lists_of(ranges[0], ranges[2], n, pa.int32()),
            )

    return arrow_map(texts(docs), work, _FOUND)


def _lists_of(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """The values of ``n`` rows, in order of their rows, as a list each."""
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=n))].astype(np.int32)
    flat = values.view(np.int64) if kind == pa.int64() else values.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _windows_of(
    chosen: list[np.ndarray], rows: np.ndarray, width: int, functions: int
) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Columns (row, key, place, beside) of the windows of texts, each ``width`` shingles at least, and (row, key, first
    place) of their intervals, both in order of the rows; the texts are laid end to end for it."""
    none = np.zeros(0, np.uint64)
    if not chosen:
        empty = np.zeros(0, np.int64)
        return (empty, none, none, none), (empty, none, none)
    grams = np.concatenate(chosen)
    sizes = np.array([len(own) for own in chosen])
    last = np.cumsum(sizes) - 1
    first = last + 1 - sizes
    whole = np.arange(len(grams) - width + 1) <= np.repeat(last - width + 1, sizes)[: len(grams) - width + 1]
    columns: list[tuple[np.ndarray, ...]] = []
    for k in range(functions):
        values = _function(grams, k)
        ranked, at = _centres(values, width, whole)
        ends = np.searchsorted(at, last, "right")
        begins = np.r_[0, ends[:-1]]
        if k == 0:
            centres, heights, left, right = at.tolist(), ranked[at].tolist(), [], []
            for low, high, begin, end in zip(begins.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
                reach = _reaches(centres[low:high], heights[low:high], begin, end)
                left += reach[0]
                right += reach[1]
            keys, places = _intervals(grams, values, left, centres, right, width, ends)
            places = places.astype(np.int64)
            of = np.searchsorted(last, places)
            ranges = rows[of], keys, (places - first[of]).astype(np.uint64)
        of = np.repeat(np.arange(len(chosen)), ends - begins)
        own = values[at]
        order = np.lexsort((own, of))
        twice = np.zeros(len(chosen), bool)
        twice[of[order[1:]][(own[order][1:] == own[order][:-1]) & (of[order][1:] == of[order][:-1])]] = True
        if twice.any():
            kept = ~twice[of]
            for text in np.flatnonzero(twice).tolist():
                low, high = int(begins[text]), int(ends[text])
                some = _thinned(values, at[low:high].tolist(), width // 2)
                kept[low + np.searchsorted(at[low:high], some)] = True
            at, of, own = at[kept], of[kept], own[kept]
        beside = grams[np.minimum(at + SHINGLE, last[of])] & np.uint64(0x7FFFFFFF)
        columns.append((rows[of], own, (at - first[of]).astype(np.uint64), beside))
    made = [np.concatenate(column) for column in zip(*columns, strict=True)]
    order = np.argsort(made[0], kind="stable")
    return tuple(column[order] for column in made), ranges


def _intervals(
    grams: np.ndarray, values: np.ndarray, left: list[int], centre: list[int], right: list[int], width: int, ends: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(key, first place) of the runs of ``width`` tokens that each window holds around its centre.

    The windows' runs lie one behind the other and leave none out, so where one interval ends the next begins. A
    window has one for the runs that reach half a width past its centre and one for those that reach as far
    before it; the key is of the centre's value and of the half that all of them hold, so equal runs have equal keys,
    and texts that only share the centre do not meet. Neighbours of one key are one interval. Of several texts laid end
    to end, ``ends`` tells how many windows there are up to the end of each.
    """
    if not centre:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    half = (width + 1) // 2
    at = np.array(centre)
    low, high = np.maximum(np.array(left), at - width + 1), np.minimum(at, np.array(right) - width + 1)
    # Runs that begin before ``middle`` hold the half up to the centre, the others the half that begins there.
    middle = np.clip(at - half + 1, low, high + 1)
    begins, blocks = np.empty(2 * len(at), np.int64), np.empty(2 * len(at), np.int64)
    begins[::2], begins[1::2] = low, middle
    blocks[::2], blocks[1::2] = at - half + 1, at
    # Where an interval is empty, so that the next begins at its place, its half may lie outside the text.
    some = np.append(begins[1:] > begins[:-1], True)
    final = (np.array([len(at)]) if ends is None else ends) - 1
    some[2 * final + 1] = high[final] >= middle[final]
    begins = begins[some]
    keys = mixed(np.repeat(values[at], 2)[some] + run_hashes(grams, half, blocks[some]))
    fresh = np.append(True, keys[1:] != keys[:-1])
    # The first interval of a text begins where the text does, and is its own whatever its key.
    fresh[np.cumsum(some)[2 * final[:-1] + 1]] = True
    return keys[fresh], begins[fresh].astype(np.uint64)


def meetings(found: DataFrame) -> DataFrame:
    """(doc_a, place_a, doc_b, place_b, star): windows of different texts with one join key.

    Windows are dealt by ranges of key, document and place, so a key of any number of windows is spread over
    many tasks, each of which reads its rows as a sorted stream. A window meets the first one of its key
    (``star``) and, besides, the first whose shingle beside the centre is also the same, or else the one before
    it: a run of any length gives two meetings a row, and a shingle that many unlike passages hold still
    brings like ones together. Where a key is cut between tasks, the first windows of its parts, and of each
    part's shingles beside, meet those of the parts before.
    """
    rows = found.where("doc_id is not null").select(
        F.explode(F.arrays_zip("windows", "places", "beside")).alias("w"), "doc_id", "key"
    )
    rows = rows.select(
        F.col("w.windows").alias("window"), "doc_id", F.col("w.places").cast("int").alias("place"),
        F.col("w.beside").alias("beside"), "key",
    )
    order = ["window", "doc_id", "place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # Of the key still open at a batch's end: its first window, the first of each shingle beside, its last.
        held, leading = None, True

        def ends(table: dict, chosen: np.ndarray) -> pa.RecordBatch:
            """The first windows of a key that other tasks may hold too; ``star`` marks the first of all."""
            none = pa.nulls(len(chosen), pa.int64())
            return _met(none, none.cast(pa.int32()), table, chosen, np.arange(len(chosen)) == 0, part)

        for own in batches:
            if not own.num_rows:
                continue
            table = {name: own.column(name).to_numpy() for name in own.schema.names}
            carried = 0
            if held is not None:
                if held["window"][0] == table["window"][0]:
                    carried = len(held["window"])
                    table = {name: np.r_[held[name], values] for name, values in table.items()}
                elif leading:
                    yield ends(held, held["leads"])
                    leading = False
            window, beside, doc, key = (table[name] for name in ("window", "beside", "doc_id", "key"))
            at = np.arange(len(window))
            starts = np.r_[0, np.flatnonzero(window[1:] != window[:-1]) + 1]
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(window)]))
            first = starts[run]
            by_side = np.lexsort((beside, run))
            fresh = np.r_[True, (np.diff(run[by_side]) != 0) | (beside[by_side][1:] != beside[by_side][:-1])]
            leader = np.empty(len(at), np.int64)
            leader[by_side] = by_side[np.maximum.accumulate(np.where(fresh, at, 0))]
            later = at[(at >= carried) & (at != first)]
            second = np.where((leader[later] != later) & (leader[later] != first[later]), leader[later], later - 1)
            chain = second != first[later]
            a, b = np.r_[first[later], second[chain]], np.r_[later, later[chain]]
            star = np.r_[np.ones(len(later), bool), np.zeros(int(chain.sum()), bool)]
            unlike = (key[a] != key[b]) & (doc[a] != doc[b])
            a, b, star = a[unlike], b[unlike], star[unlike]
            if len(a):
                yield _met(pa.array(doc[a]), pa.array(table["place"][a]), table, b, star, part)
            if leading and len(starts) > 1:
                yield ends(table, np.flatnonzero((leader == at) & (run == 0)))
                leading = False
            leads = np.flatnonzero((leader == at) & (run == run[-1]))
            open_rows = np.unique(np.r_[leads, len(at) - 1])
            held = {name: values[open_rows] for name, values in table.items()}
            held["leads"] = np.searchsorted(open_rows, leads)
        if held is not None:
            yield ends(held, held["leads"])

    made = saved(arrow_map(ordered, work, _MET), "met")
    firsts = made.where("doc_a is null").drop("doc_a", "place_a")
    met = made.where("doc_a is not null").select("doc_a", "place_a", "doc_b", "place_b", "star")
    for star, keys in ((True, ["window"]), (False, ["window", "beside"])):
        # One row a task and key (and shingle beside): as many rows in a window as there are tasks.
        line = Window.partitionBy(*keys).orderBy("part")
        before = F.lag(F.struct(F.col("doc_b").alias("doc"), F.col("place_b").alias("place"), "key")).over(line)
        across = (firsts.where("star") if star else firsts).withColumn("before", before)
        across = across.where("before.key <> key and before.doc <> doc_b")
        met = met.unionByName(
            across.select(F.col("before.doc").alias("doc_a"), F.col("before.place").alias("place_a"), "doc_b", "place_b", F.lit(star).alias("star"))
        )
    return met


def _met(doc_a: pa.Array, place_a: pa.Array, table: dict, b: np.ndarray, star: np.ndarray, part: int) -> pa.RecordBatch:
    """Rows of ``_MET``; what only the first windows of a key need is null elsewhere."""
    firsts = doc_a.null_count > 0
    extra = {name: pa.array(table[name][b]) if firsts else pa.nulls(len(b), kind) for name, kind in _EXTRA}
    return batch(
        doc_a=doc_a, place_a=place_a, doc_b=table["doc_id"][b], place_b=table["place"][b], star=star,
        part=pa.array(np.full(len(b), part, np.int32)), **extra,
    )


def _before(codes: np.ndarray) -> np.ndarray:
    """The last earlier place of the same code, or -1."""
    order = np.argsort(codes, kind="stable")
    same = np.r_[False, codes[order][1:] == codes[order][:-1]]
    out = np.full(len(codes), -1)
    out[order[same]] = order[np.flatnonzero(same) - 1]
    return out


def _straight(a: np.ndarray, b: np.ndarray, shifts: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Passages of equal shingles on the meetings' shifts: (first, last in a, first, last in b). Of those that overlap
    there are as few as hold, on either side, all runs of ``width`` that any of them holds."""
    spans = []
    for shift in np.unique(shifts).tolist():
        low, past = max(0, -shift), min(len(a), len(b) - shift)
        if past - low < width:
            continue
        ends = np.flatnonzero(np.diff(np.r_[False, a[low:past] == b[low + shift : past + shift], False])) + low
        spans += [(f, t - 1, f + shift, t - 1 + shift) for f, t in ends.reshape(-1, 2).tolist() if t - f >= width]
    return sorted({*_covering(spans, 0, width), *_covering(spans, 2, width)})


def _covering(spans: list[tuple[int, int, int, int]], side: int, width: int) -> list[tuple[int, int, int, int]]:
    """Few of ``spans`` that hold all runs of ``width`` that any of them holds on that side."""
    kept, end, furthest = [], width - 2, None
    for span in sorted(spans, key=lambda s: (s[side], -s[side + 1])):
        if furthest is not None and span[side] > end - width + 2:
            kept.append(furthest)
            end, furthest = furthest[side + 1], None
        if span[side + 1] > (end if furthest is None else furthest[side + 1]):
            furthest = span
    return kept if furthest is None else [*kept, furthest]


def _places(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, bool]:
    """For each shingle of ``a`` the place of the same one in ``b``, or -1, and whether ``b`` holds one twice;
    ``shifts`` lead from one to the other."""
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    places = np.where(ranked[at] == a, order[at], -1)
    if not (ranked[1:] == ranked[:-1]).any():
        return places, False
    # A shingle that b repeats counts where a meeting's shift puts it, or else next to its neighbour.
    fixed = np.zeros(len(a), bool)
    for shift in np.unique(shifts).tolist():
        there = np.arange(len(a)) + shift
        inside = (there >= 0) & (there < len(b))
        same = np.zeros(len(a), bool)
        same[inside] = a[inside] == b[there[inside]]
        places[same] = there[same]
        fixed |= same
    for step, turn in ((1, range(1, len(a))), (-1, range(len(a) - 2, -1, -1))):
        for k in turn:
            there = places[k - step] + step
            if places[k] < 0 or fixed[k] or places[k - step] < 0 or there == places[k] or not 0 <= there < len(b):
                continue
            alone = step > 0 or k == 0 or places[k - 1] + 1 != places[k]
            if alone and b[there] == a[k]:
                places[k] = there
    return places, True


def shared_spans(a: np.ndarray, b: np.ndarray, shifts: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Verified near-duplicate passages of two shingle sequences: (first, last in a, first, last in b).

    Runs of equal shingles are joined over gaps of any length: from each run on, the furthest one is taken to
    which the shingle sets of the two sides are similar enough. So a passage begins and ends with a run, a run
    of the least length is one by itself, and what a longer passage of the same runs fails, a shorter may pass.
    Of the two sides the longer one has the least length; passages that lie in one already found are left out.
    A shingle of ``a`` has one place in ``b`` for this, so where ``b`` repeats some, the runs on the meetings' shifts
    are passages besides.
    """
    if not len(a) or not len(b):
        return []
    places, repeated = _places(a, b, shifts)
    if not repeated and _too_few(a, places, width):
        return []
    kept = _joined(a, b, places, width)
    if repeated and len(shifts) > 1:
        inside = lambda f, t, s, u: any(f0 <= f and t <= t0 and s0 <= s and u <= u0 for f0, t0, s0, u0 in kept)
        kept += [span for span in _straight(a, b, shifts, width) if not inside(*span)]
    return kept


def _too_few(a: np.ndarray, places: np.ndarray, width: int) -> bool:
    """Whether no passage can be similar enough, as in most pairs: of two sequences that repeat no shingle, the second one
    is known not to, the longer side of a passage has ``width`` different ones, and of them all a share is in both."""
    if PARTS * np.count_nonzero(places >= 0) >= SHARE * width:
        return False
    ranked = np.sort(a)
    return not (ranked[1:] == ranked[:-1]).any()


def _joined(a: np.ndarray, b: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """The passages of ``shared_spans`` under one place in ``b`` for each shingle of ``a``."""
    on = np.flatnonzero(places >= 0)
    if not len(on):
        return []
    cuts = np.flatnonzero((np.diff(on) > 1) | (np.diff(places[on]) != 1)) + 1
    first, last = on[np.r_[0, cuts]], on[np.r_[cuts - 1, len(on) - 1]]
    low, high = places[first], places[last]
    if len(first) == 1:
        return [(int(first[0]), int(last[0]), int(low[0]), int(high[0]))] if last[0] - first[0] + 1 >= width else []
    values, codes = np.unique(np.r_[a, b], return_inverse=True)
    in_a, in_b, kinds = codes[: len(a)], codes[len(a) :], len(values)
    before_a, before_b = _before(in_a), _before(in_b)
    kept: list[tuple[int, int, int, int]] = []
    for i in range(len(first)):
        f, s = int(first[i]), int(low[i])
        since = max((t for f0, t, s0, t2 in kept if f0 <= f and last[i] <= t and s0 <= s and high[i] <= t2), default=-1)
        ends = np.arange(i, len(first))
        ends = ends[(high[ends] >= high[i]) & (last[ends] > since)]
        ends = ends[np.maximum(last[ends] - f, high[ends] - s) + 1 >= width]
        if not len(ends):
            continue
        # Distinct shingles from the run's start on, on both sides, and where those of a first stand in b.
        stands = np.full(kinds, len(b))
        stands[in_b[s:][::-1]] = np.arange(len(b) - 1, s - 1, -1)
        new_a, new_b = np.flatnonzero(before_a[f:] < f) + f, np.flatnonzero(before_b[s:] < s) + s
        partner = stands[in_a[new_a]]
        n_a, n_b = np.searchsorted(new_a, last[ends], "right"), np.searchsorted(new_b, high[ends], "right")
        most = np.searchsorted(new_a[partner < len(b)], last[ends], "right")
        able = (PARTS + SHARE) * np.minimum(most, n_b) >= SHARE * (n_a + n_b)
        for j, x, y in zip(ends[able][::-1].tolist(), n_a[able][::-1].tolist(), n_b[able][::-1].tolist(), strict=True):
            shared = int(np.count_nonzero(partner[:x] <= high[j]))
            if PARTS * shared >= SHARE * (x + y - shared):
                kept.append((f, int(last[j]), s, int(high[j])))
                break
    return kept


def short_hashes(words: np.ndarray) -> np.ndarray:
    """Word hashes cut to ``WORD_BYTES`` bytes, a row each."""
    return np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]


def stretch_grams(words) -> np.ndarray:
    """The shingles of a stretch of short word hashes; none if it is shorter than one."""
    return stretches_grams([words])[0]


def stretches_grams(stretches: list[bytes]) -> list[np.ndarray]:
    """``stretch_grams`` of each, made at once; shingles that reach from one stretch into the next are left out."""
    short = np.frombuffer(b"".join(stretches), np.uint8).reshape(-1, WORD_BYTES)
    whole = np.zeros((len(short), 8), np.uint8)
    whole[:, :WORD_BYTES] = short
    grams, out, at = shingles(whole.view(np.uint64).ravel()), [], 0
    for words in stretches:
        n = len(words) // WORD_BYTES
        out.append(grams[at : at + max(0, n - SHINGLE + 1)])
        at += n
    return out


def verified(docs: DataFrame, met: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, first_word, n_words, other_doc_id), both ways, of the passages around the meetings.

    Of each document concerned the stretch between its outermost meetings is read again, and each pair of
    documents takes along its own part of it; texts as a whole never move.
    """
    pairs = met.groupBy("doc_a", "doc_b").agg(
        F.collect_set(F.col("place_b") - F.col("place_a")).alias("shifts"),
        *[f(f"place_{s}").alias(f"{n}_{s}") for s in "ab" for n, f in (("lo", F.min), ("hi", F.max))],
    )
    pairs = saved(pairs, "pairs")
    ends = [F.struct(F.col(f"doc_{s}").alias("doc_id"), F.col(f"lo_{s}").alias("lo"), F.col(f"hi_{s}").alias("hi")) for s in "ab"]
    wanted = pairs.select(F.explode(F.array(*ends)).alias("w")).select("w.*")
    wanted = wanted.groupBy("doc_id").agg(
        F.greatest(F.min("lo") - MARGIN, F.lit(0)).alias("since"), (F.max("hi") + MARGIN).alias("until")
    )
    again = join_checked(texts(docs), saved(wanted, "wanted"), ["doc_id"], "inner", 32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, WINDOWED_BYTES):
            since, until = part.column("since").to_pylist(), part.column("until").to_pylist()
            # Another text under the same id may end before the stretch.
            hashes, lengths = word_hashes_of(text_bytes(part))
            short, past = short_hashes(hashes), np.cumsum(lengths)
            ends = zip((past - lengths).tolist(), past.tolist(), since, until, strict=True)
            words = pa.array([short[begin:end][lo : hi + SHINGLE - 1].tobytes() for begin, end, lo, hi in ends], pa.binary())
            yield batch(doc_id=part.column("doc_id"), since=part.column("since"), words=words)

    stretches = arrow_map(again, read, "doc_id long, since int, words binary").repartition("doc_id")
    joined = pairs
    for s in "ab":
        own = stretches.select(F.col("doc_id").alias(f"doc_{s}"), F.col("since").alias(f"since_{s}"), F.col("words").alias(f"words_{s}"))
        start = F.greatest(F.col(f"lo_{s}") - MARGIN, F.lit(0))
        n = F.col(f"hi_{s}") + MARGIN - start + SHINGLE - 1
        part = F.substring(f"words_{s}", (start - F.col(f"since_{s}")) * WORD_BYTES + 1, n * WORD_BYTES)
        joined = joined.join(own, f"doc_{s}").withColumn(f"words_{s}", part).withColumn(f"since_{s}", start)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, WINDOWED_BYTES):
            rows = []
            ends = zip(*(part.column(c).to_pylist() for c in ("doc_a", "doc_b", "since_a", "since_b")), strict=True)
            grams_a, grams_b = (stretches_grams(part.column(c).to_pylist()) for c in ("words_a", "words_b"))
            for k, (a, b, (doc_a, doc_b, from_a, from_b)) in enumerate(zip(grams_a, grams_b, ends, strict=True)):
                shifts = part.column("shifts")[k].values.to_numpy() + (from_a - from_b)
                for f, t, f2, t2 in shared_spans(a, b, shifts, width):
                    rows.append((doc_a, f + from_a, t - f + SHINGLE, doc_b))
                    rows.append((doc_b, f2 + from_b, t2 - f2 + SHINGLE, doc_a))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            names = ("doc_id", "first_word", "n_words", "other_doc_id")
            yield batch(**{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    columns = ["doc_a", "doc_b", "shifts", "since_a", "since_b", "words_a", "words_b"]
    return arrow_map(joined.select(*columns), verify, SPANS)


def run_hashes(grams: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of ``width`` shingles, or of those that begin ``at`` some places, from sums of powers."""
    n = len(grams)
    powers, inverse = wrapping_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(grams * powers[:n], out=sums[1:])
    at = np.arange(max(0, n - width + 1)) if at is None else at
    return mixed((sums[at + width] - sums[at]) * inverse[at])


def _thinned_runs(runs: np.ndarray, wanted: np.ndarray, opened: np.ndarray, width: int) -> np.ndarray:
    """The places wanted, in order, but for most of those of one run that a text holds again and again.

    Of places that are not open the first of each run stays, which is enough to meet. Open ones that follow closely stay
    but for those between two that lie no more than ``width`` apart: the passages of the two hold all words between.
    """
    at = np.flatnonzero(wanted)
    order = at[np.lexsort((at, opened[at], runs[at]))]
    same = np.r_[False, (runs[order][1:] == runs[order][:-1]) & (opened[order][1:] == opened[order][:-1])]
    if not same.any():
        return at
    half = max(1, width // 2)
    near = same & (np.diff(order, prepend=0) <= half)
    last = np.append(~near[1:], True)
    # One at least of each half of a width, and the ends of those that follow closely.
    fresh = np.r_[True, order[1:] // half != order[:-1] // half]
    return np.sort(order[np.where(opened[order], ~near | last | fresh, ~same)])


def _texts_wanted(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The texts of the documents in ``wanted``, a saved table of ``size`` bytes, with its columns; where that is too
    large to be broadcast, its ids may not be, and the other texts stay where they are."""
    if size <= BROADCAST_BYTES:
        return texts(docs).join(F.broadcast(wanted), "doc_id")
    return join_checked(texts(docs), wanted.select("doc_id"), ["doc_id"], "left_semi", 16).join(wanted, "doc_id")


def open_meetings(docs: DataFrame, found: DataFrame, rep: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """(doc_a, place_a, doc_b, place_b) of exact repeats that no meeting of windows has brought to light.

    An interval is open while one of its runs of ``width`` shingles lies in no passage of ``near``. In a key that
    unlike texts share, be they any number, and that has an open interval, all intervals are joined on the runs
    they hold: a run held twice is a repeat by itself, so an open one meets the first of its run, or the last if it is
    the first, and none is left out. Intervals of a key that no other text has, or without an open one, are not
    read again.
    """
    intervals = F.arrays_zip(
        "values", F.col("begins").alias("begins"),
        F.concat(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.col("n_words") - SHINGLE - width + 2)).alias("until"),
    )
    rows = found.where(F.col("doc_id").isNotNull() & (F.size("values") > 0)).select(
        "doc_id", "key", F.explode(intervals).alias("w")
    )
    rows = rows.select("doc_id", "key", F.col("w.values").alias("window"), F.col("w.begins").alias("begins"), F.col("w.until").alias("until"))
    shared = rows.groupBy("window").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    shared = saved(shared.where("low <> high").select("window"), "shared_keys")
    held = join_checked(rows.drop("key"), shared, ["window"], "inner", 16).join(rep, "doc_id")
    held = held.select("rep", "window", "begins", "until").distinct()
    held = held.groupBy("rep").agg(F.collect_list(F.struct("window", "begins", "until")).alias("held"))
    spans = near.groupBy("doc_id", "first_word").agg(F.max("n_words").alias("span")).groupBy(F.col("doc_id").alias("rep"))
    spans = spans.agg(F.collect_list(F.struct("first_word", (F.col("first_word") + F.col("span") - SHINGLE - width + 2).alias("past"))).alias("spans"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            reps, keys, begins, ends, opens, shuts = [], [], [], [], [], []
            for k, doc in enumerate(part.column("rep").to_pylist()):
                own = part.column("held")[k].values
                window, since, until = (own.field(c).to_numpy() for c in ("window", "begins", "until"))
                # Over the places where runs begin: how many passages hold the run, then how many places none holds.
                cover = np.zeros(int(until.max()) + 1, np.int64)
                if part.column("spans")[k].is_valid:
                    passages = part.column("spans")[k].values
                    first, past = (np.minimum(passages.field(c).to_numpy(), len(cover) - 1) for c in ("first_word", "past"))
                    # The shorter side of a passage may hold no run of that length.
                    np.add.at(cover, first, 1)
                    np.add.at(cover, np.maximum(first, past), -1)
                # The first and the last open place of each interval.
                free = np.flatnonzero(np.cumsum(cover)[:-1] <= 0)
                lo, hi = np.searchsorted(free, since), np.searchsorted(free, until)
                padded = np.r_[free, 0]
                reps.append(np.full(len(window), doc))
                keys.append(window)
                begins.append(since)
                ends.append(until)
                opens.append(np.where(hi > lo, padded[lo], 0).astype(np.int32))
                shuts.append(np.where(hi > lo, padded[hi - 1] + 1, 0).astype(np.int32))
            if reps:
                yield batch(
                    rep=np.concatenate(reps), window=np.concatenate(keys), begins=np.concatenate(begins),
                    until=np.concatenate(ends), open=np.concatenate(opens), shut=np.concatenate(shuts),
                )

    judged = saved(
        arrow_map(held.join(spans, "rep", "left"), judge, "rep long, window long, begins int, until int, open int, shut int"), "intervals"
    )
    keys = judged.groupBy("window").agg(F.max("shut").alias("shut"), F.min("rep").alias("low"), F.max("rep").alias("high"))
    keys = saved(keys.where("shut > 0 and low <> high").select("window"), "open_keys")
    wanted = join_checked(judged, keys, ["window"], "inner", 16).groupBy(F.col("rep").alias("doc_id"))
    wanted = saved(wanted.agg(F.collect_list(F.struct("begins", "until", "open", "shut")).alias("ranges")), "open_ranges")
    again = _texts_wanted(docs, wanted, wanted.agg(F.sum(F.size("ranges") * RANGE_BYTES + 64)).first()[0] or 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            docs_of, found_runs, places, states = [], [], [], []
            for k, (doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), text_bytes(part), strict=True)):
                words = word_hashes(text)
                if len(words) < SHINGLE + width - 1:  # another text under the same id
                    continue
                runs = run_hashes(shingles(words), width)
                ranges = part.column("ranges")[k].values
                inside = []
                for since, until in (("begins", "until"), ("open", "shut")):
                    marks = np.zeros(len(runs) + 1, np.int64)
                    np.add.at(marks, np.minimum(ranges.field(since).to_numpy(), len(runs)), 1)
                    np.add.at(marks, np.minimum(ranges.field(until).to_numpy(), len(runs)), -1)
                    inside.append(np.cumsum(marks)[:-1] > 0)
                at = _thinned_runs(runs, inside[0], inside[1], width)
                states.append(inside[1][at])
                docs_of.append(np.full(len(at), doc))
                found_runs.append(runs[at].view(np.int64))
                places.append(at.astype(np.int32))
            if docs_of:
                yield batch(doc=np.concatenate(docs_of), run=np.concatenate(found_runs), place=np.concatenate(places), open=np.concatenate(states))

    runs = saved(arrow_map(again, read, "doc long, run long, place int, open boolean"), "runs")
    own = F.struct("doc", "place")
    ends = runs.groupBy("run").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.max("open").alias("open"))
    # A table of its own, so that a run of many rows can be split between tasks when it meets it.
    ends = saved(ends.where("open and first.doc <> last.doc").select("run", "first", "last"), "run_ends")
    met = join_checked(runs.where("open"), ends, ["run"], "inner", 64).withColumn("other", F.when(F.col("doc") == F.col("first.doc"), F.col("last")).otherwise(F.col("first")))
    # A pair is one whichever of the two is open.
    a, b = F.least(own, "other"), F.greatest(own, "other")
    met = met.select(a.alias("a"), b.alias("b"))
    return met.select(
        F.col("a.doc").alias("doc_a"), F.col("a.place").alias("place_a"), F.col("b.doc").alias("doc_b"), F.col("b.place").alias("place_b")
    )


def shared_passages(docs: DataFrame, least_words: int = LEAST_WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """Near-duplicate passages: rows (doc_id, first_word, n_words, other_doc_id), one per passage and partner.

    Both documents of a pair get a row for each passage of at least ``least_words`` words that they share;
    of equal passages of one document only the row with the smallest partner stays. Documents with equal word
    sequences are one text: each of them is a passage as a whole, and what the text shares with others is sought
    once and returned under its smallest id. Within one text nothing is compared.

    Windows are found in one pass over the whole texts, met by one shuffle of their keys, and verified pair
    by pair on the shingle sequences of the two texts, read again for the documents concerned only. A window
    meets two others of its key; what that leaves open is joined on the runs that the windows' intervals hold,
    so every exact repeat of ``least_words`` words is found, however many unlike texts share its keys.

    Null and empty texts and texts of fewer than ``least_words`` words have no passage. Rows without an id
    take no part. An id that repeats with several texts is compared under that id, never with itself.
    """
    width = least_words - SHINGLE + 1
    found = saved(windows(docs, least_words, functions), "windows")
    texts_of = found.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)).select("doc_id", "n_words", "key", "key2")
    classes = saved(
        texts_of.groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.first("n_words").alias("n_words")),
        "classes",
    )
    # A text stands under its smallest id, whichever document a task sent its windows for.
    rep = texts_of.join(classes.select("key", "key2", "rep"), ["key", "key2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"))
    rep = saved(rep, "representatives")
    met = meetings(found)
    for side in ("doc_a", "doc_b"):
        met = met.join(rep.withColumnRenamed("doc_id", side), side).drop(side).withColumnRenamed("rep", side)
    met = saved(met.where("doc_a <> doc_b"), "meetings")
    near = saved(verified(docs, met.where("star"), width), "near")
    # A window whose passage the first of its run doesn't share may yet share it with the one before.
    rest = met.where("not star")
    spans = near.select(F.col("doc_id").alias("doc"), "first_word", (F.col("first_word") + F.col("n_words") - SHINGLE).alias("last"))
    inside = (F.col("doc_b") == F.col("doc")) & F.col("place_b").between(F.col("first_word"), F.col("last"))
    rest = rest.join(spans, inside, "left_anti")
    near = saved(near.unionByName(verified(docs, rest, width)), "near")
    near = near.unionByName(verified(docs, open_meetings(docs, found, rep, near, width), width))
    # A document that copies another is a passage as a whole, which holds all others of its text: they stand under
    # the representative alone.
    members = texts_of.join(classes.where("rep < other").select("key", "key2", "rep", "other"), ["key", "key2"])
    copy = F.when(F.col("doc_id") == F.col("rep"), F.col("other")).otherwise(F.col("rep"))
    whole = members.select("doc_id", F.lit(0).alias("first_word"), "n_words", copy.alias("other_doc_id"))
    return saved(
        near.unionByName(whole).groupBy("doc_id", "first_word", "n_words").agg(F.min("other_doc_id").alias("other_doc_id")),
        "passages",
    )


def merged(passages: DataFrame) -> DataFrame:
    """The passages of each document with those that overlap made one, its partner the smallest of theirs."""
    spans = passages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("first_word", F.col("n_words").alias("span"), "other_doc_id"))).alias("spans")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for doc, spans_of in zip(part.column("doc_id").to_pylist(), part.column("spans").to_pylist(), strict=True):
                open_span: list[int] = []
                for span in spans_of:
                    first, end, other = span["first_word"], span["first_word"] + span["span"], span["other_doc_id"]
                    if open_span and first <= open_span[1]:
                        open_span[1], open_span[2] = max(open_span[1], end), min(open_span[2], other)
                    else:
                        if open_span:
                            rows.append((doc, open_span[0], open_span[1] - open_span[0], open_span[2]))
                        open_span = [first, end, other]
                rows.append((doc, open_span[0], open_span[1] - open_span[0], open_span[2]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield batch(**{n: pa.array(c, k) for n, c, k in zip(("doc_id", "first_word", "n_words", "other_doc_id"), columns, kinds, strict=True)})

    return arrow_map(spans, work, SPANS)


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with each passage left only in the smallest id of the documents that share it.

    A span is cut from a document whose partner has a smaller id; the white space around the cut stays on its
    left side. Where nothing is cut the text is unchanged to the byte, null texts included, and so are all
    other columns but ``n_chars``, which is counted anew for texts that were cut. A text cut as a whole
    becomes empty; the row stays.
    """
    cuts = passages.where("other_doc_id < doc_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("_cuts")
    )
    cuts = saved(cuts, "cuts")
    # Each row is carried as one value, so that no column of it meets a name of this function.
    rows = docs.select("doc_id", F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = join_checked(rows, cuts, ["doc_id"], "left", 96)
    changed = joined.where(F.col("_cuts").isNotNull()).select("row", "text", "_cuts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        for part in pieces(batches):
            out = []
            for text, cuts_of in zip(text_bytes(part), part.column("_cuts").to_pylist(), strict=True):
                at = [m.span() for m in word.finditer(text or b"")]
                kept, end = [], 0
                for cut in cuts_of:
                    first, last = cut["first_word"], cut["first_word"] + cut["n_words"] - 1
                    if last >= len(at):  # another text under the same id
                        continue
                    kept.append(text[end : max(end, at[first][0])])
                    end = max(end, at[last][1])
                kept.append(text[end:] if text is not None else b"")
                out.append(b"".join(kept).decode("utf-8") if text is not None else None)
            yield batch(row=part.column("row"), text=pa.array(out, pa.string()))

    row_type = changed.schema["row"].dataType.simpleString()
    mended = arrow_map(changed, work, f"row {row_type}, text string")
    mended = mended.select(
        *[
            F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
    plain = joined.where(F.col("_cuts").isNull()).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return plain.unionByName(mended)
