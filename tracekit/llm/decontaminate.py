"""Benchmark decontamination with spaced seeds.

A seed is a mask over a few words that ignores some of them, so two texts
with a changed word still share seeds whose ignored positions cover it. The
masked hashes of the benchmark are joined with those at every position of
every document; around each hit the document and the benchmark item are laid
side by side, and the longest run of equal and few substituted words counts
if it is long enough.

The benchmark is the smaller side: it is taken in blocks of bounded size,
each sent to the executors as a sorted hash table, and the documents are
read once per block, so no document text or hash is shuffled and a passage
that fills a third of the documents is no hot key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm._common import union_all
from tracekit.llm._text import MARK, batch_hashes, text_groups, utf8, window_hashes, window_hashes_at, word_hashes

# 1 counts, 0 is ignored; chosen so that 13 or more words of which up to a fifth are substituted, wherever, share a seed
MASKS = ("11110111", "1100101111", "111101101", "10111001011", "111000100111", "110001010111", "110111000101", "1110100111")
MIN_WORDS = 13
MAX_SUBSTITUTED = 0.2
BLOCK_WORDS = 2_000_000  # benchmark words sent to the executors at a time: at most 100 MB of tables
ROW_WORDS = 8  # what a row of the benchmark counts for besides its words
HITS = 2_000_000  # hits of a batch of texts that are held before they are merged
FILTER_BITS = 22


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def short_shapes(n: int, max_substituted: float) -> list[list[int]]:
    """Places in an item of ``n`` words such that the item with any allowed
    substitutions is equal at all places of one of them: an item is cut into
    parts, and each shape leaves out as many parts as words may be replaced."""
    gone = min(n - 1, int(max_substituted * n + 1e-9))
    parts = [range(i, min(n, i + 2)) for i in range(0, n, 2)]
    if n < 7 or len(parts) <= gone:
        parts = [range(i, i + 1) for i in range(n)]
    return [[i for part in left for i in part] for left in itertools.combinations(parts, len(parts) - gone)]


def _low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter(hashes: np.ndarray) -> np.ndarray:
    """Marks the low bits that occur; most absent hashes end there."""
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[_low(hashes)] = True
    return seen


class Seeds:
    """The seeds of a block of benchmark items, for lookups inside tasks."""

    def __init__(self, items: list[tuple[int, str | None, int]], masks: tuple[str, ...], max_substituted: float):
        """``items`` are (id, text, how many rows are equal)."""
        self.ids, self.times = [i for i, *_ in items], [n for *_, n in items]
        self.words = [word_hashes(utf8(text), MARK) for _, text, _ in items]
        self.known = _filter(np.concatenate([*self.words, np.empty(0, np.uint64)]))
        # the masks hold for runs of MIN_WORDS; shorter items are looked up by shapes of their own length
        span = max(MIN_WORDS, *(len(m) for m in masks))
        self.shapes, self.tables = [], []
        long = [i for i, w in enumerate(self.words) if len(w) >= span]
        for mask in masks:
            shape = offsets(mask)
            self._add(shape, [(window_hashes(self.words[i], shape), i) for i in long], 0)
        for n in sorted({len(w) for w in self.words if 0 < len(w) < span}):
            of = [i for i, w in enumerate(self.words) if len(w) == n]
            for places in short_shapes(n, max_substituted):
                shape = [o - places[0] for o in places]
                self._add(shape, [(window_hashes(self.words[i][places[0]:], shape)[:1], i) for i in of], places[0])

    def _add(self, shape: list[int], found: list[tuple[np.ndarray, int]], lead: int) -> None:
        keys = np.concatenate([h for h, _ in found]) if found else np.empty(0, np.uint64)
        item = np.concatenate([np.full(len(h), i) for h, i in found]) if found else np.empty(0, np.int64)
        at = np.concatenate([np.arange(len(h)) for h, _ in found]) + lead if found else np.empty(0, np.int64)
        order = np.lexsort((at, item, keys))
        keys, item, at = keys[order], item[order], at[order]
        # places of an item that follow one another are one entry: repetitive items have few
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1)][:len(keys)])
        last = np.r_[first[1:], len(keys)][:len(first)] - 1
        self.shapes.append(shape)
        self.tables.append((keys[first], item[first], at[first], at[last], _filter(keys)))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, position of the item's first word in the text) of all
        hits in a batch of texts, sorted and distinct."""
        known = self.known[_low(hashes)]
        held, n_held = np.empty((0, 4), np.int64), 0
        parts: list[np.ndarray] = []
        for shape, (keys, item, at_first, at_last, seen) in zip(self.shapes, self.tables):
            n = len(hashes) - shape[-1]
            if n <= 0 or not len(keys):
                continue
            whole = known[:n].copy()
            for o in shape[1:]:
                whole &= known[o:o + n]
            places = np.flatnonzero(whole)
            own = window_hashes_at(hashes, shape, places)
            maybe = seen[_low(own)]
            places, own = places[maybe], own[maybe]
            text = np.searchsorted(first, places, "right") - 1
            left, right = (np.searchsorted(keys, own, side) for side in ("left", "right"))
            right[places + shape[-1] >= first[text + 1]] = 0  # a window over two texts
            found = np.flatnonzero(left < right)
            times = right[found] - left[found]
            # a bounded number of entries at a time; a place has one for each item at least
            cuts = np.flatnonzero(np.diff(np.cumsum(times) // HITS)) + 1
            for own_part, n_part in zip(np.split(found, cuts), np.split(times, cuts)):
                entry = np.repeat(left[own_part] - np.cumsum(n_part) + n_part, n_part) + np.arange(n_part.sum())
                k = np.repeat(own_part, n_part)
                shift = places[k] - first[text[k]]
                parts.append(np.stack([text[k], item[entry], shift - at_last[entry], shift - at_first[entry]], axis=1))
                n_held += len(k)
                if n_held > HITS:
                    held, parts = _merged_ranges(np.concatenate([held, *parts])), []
                    n_held = 0
        ranges = _merged_ranges(np.concatenate([held, *parts]))
        many = ranges[:, 3] - ranges[:, 2] + 1
        shift = np.repeat(ranges[:, 2] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.column_stack([np.repeat(ranges[:, :2], many, axis=0), shift]).tolist()


def _merged_ranges(rows: np.ndarray) -> np.ndarray:
    """(text, item, low, high) with overlapping and neighbouring ranges of a
    pair as one, in order."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    pair = np.cumsum(np.r_[0, (rows[1:, :2] != rows[:-1, :2]).any(1)])
    # highest end so far within the pair: pairs are moved apart
    apart = (rows[:, 3].max() - rows[:, 2].min() + 2) * pair
    reach = np.maximum.accumulate(rows[:, 3] + apart)
    start = np.flatnonzero(np.r_[True, rows[1:, 2] + apart[1:] > reach[:-1] + 1])
    end = np.r_[start[1:], len(rows)] - 1
    return np.column_stack([rows[start, :3], reach[end] - apart[end]])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, max_substituted: float, min_words: int) -> tuple[int, int, int]:
    """The longest run on one diagonal that has at most the allowed share of
    substituted words and begins and ends with equal ones, or is the whole of
    an item of fewer than ``min_words``, as (start in the document, words, equal words); of the longest ones
    the first with the most equal words.

    Equal words gain the allowed share and others cost the rest of one, so a
    run is allowed if its sum isn't negative; the first start whose running
    sum is at most the end's gives the end's longest run.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[low + shift:high + shift] == item[low:high]
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0, 0
    if len(same) == len(item) < min_words and len(item) - len(starts) <= max_substituted * len(item) + 1e-9:
        return shift, len(item), len(starts)
    total = np.concatenate([[0.0], np.cumsum(np.where(same, max_substituted, max_substituted - 1.0))])
    lowest = np.minimum.accumulate(total[starts])
    place = np.searchsorted(-lowest, -total[starts + 1] - 1e-9)
    words, equal = starts - starts[place], np.arange(len(starts)) - place
    best = int(np.argmax(words * (len(same) + 1) + equal))
    return low + shift + int(starts[place[best]]), int(words[best]) + 1, int(equal[best]) + 1


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS,
                 max_substituted: float = MAX_SUBSTITUTED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal, item_share) for each
    document row and benchmark item that overlap in at least ``min_words``
    words, or in the whole of a shorter item, with at most
    ``max_substituted`` of them replaced; the longest run represents the
    pair, with the most equal words and then the first among equals. Runs
    begin and end with equal words; a shorter item may have replaced words at
    its ends too. The given masks find all runs for up to 20 % and at least 13 words.

    Words are runs of letters and digits, lower-cased, so marks between them
    don't matter. Null and empty texts, and items without words, overlap with
    nothing; items with a null id take part; repeated rows and items each
    give their own row; empty tables give none; other columns are not used.
    Runs a job on the benchmark for the number of blocks.
    """
    texts = docs.select("doc_id", "text")
    return union_all([_against(texts, seeds, min_words, max_substituted) for seeds in _blocks(benchmark, masks, max_substituted, block_words)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS,
                      max_substituted: float = MAX_SUBSTITUTED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap with no
    benchmark item; the same rules as ``contaminated``. Maps only."""
    at = docs.columns.index("text")
    for seeds in _blocks(benchmark, masks, max_substituted, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for place, *_ in _overlaps(sent.value, batch.column(at).to_pylist(), min_words, max_substituted):
                    keep[place] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def _blocks(benchmark: DataFrame, masks: tuple[str, ...], max_substituted: float, block_words: int) -> Iterator[Seeds]:
    """The benchmark's seeds, in blocks of about ``block_words`` words (a row
    counts for some more); equal items are one."""
    items = benchmark.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    # the same words that the scan takes
    words = F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0))
    total = items.agg(F.sum(words + ROW_WORDS)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for b in range(n_blocks):
        rows = items.where(block == b).collect()
        yield Seeds(sorted(((r["item_id"], r["text"], r["times"]) for r in rows), key=str), masks, max_substituted)


def _overlaps(seeds: Seeds, texts: list[str | None], min_words: int, max_substituted: float) -> list[tuple]:
    """(place of the text, item id, first word, words, equal words, share of
    the item, rows of the item)."""
    out = []
    for start, end in text_groups(texts):
        hashes, first = batch_hashes(texts[start:end], MARK)
        best: dict[tuple[int, int], tuple] = {}
        for t, i, shift in seeds.hits(hashes, first):
            at, n, same = overlap(hashes[first[t]:first[t + 1]], seeds.words[i], shift, max_substituted, min_words)
            if n >= min(min_words, len(seeds.words[i])):
                best[t, i] = max(best.get((t, i), (0, 0)), (n, same, -at))
        out += [(start + t, seeds.ids[i], -at, n, same, same / len(seeds.words[i]), seeds.times[i])
                for (t, i), (n, same, at) in sorted(best.items())]
    return out


def _against(texts: DataFrame, seeds: Seeds, min_words: int, max_substituted: float) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(seeds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _overlaps(sent.value, batch.column(1).to_pylist(), min_words, max_substituted)
            cols = list(zip(*out)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()),
                 *[pa.array(c, k) for c, k in zip(cols[2:], kinds)]],
                names=["doc_id", "item_id", "first_word", "n_words", "n_equal", "item_share", "times"])

    found = texts.mapInArrow(rows, "doc_id long, item_id long, first_word long, n_words long, n_equal long, item_share double, times long")
    # a row for each of equal items
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
