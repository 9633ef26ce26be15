"""Evaluation passages inside a corpus, by Wu-Manber search over words.

The patterns are all runs of ``span`` consecutive words of the passages. The searcher slides over the
words of a text: a block of two words looks up how far the search may jump without missing a
pattern (``span - 1`` words if the block is in none); a block that ends some pattern leads to the bucket of
patterns with that suffix, which the first word narrows down and a direct comparison confirms.
The result is exact: every run of ``span`` shared words is found, wherever it stands in the text.

Passages of up to ``PASS_CHARS`` characters are broadcast with their tables. Beyond it (``leaks_by_hash``) the patterns stay a
distributed table: the shift table and a filter over the patterns are arrays of a fixed size, indexed by hashes (a collision can only make the
searcher look once more), the windows that pass both are joined with the patterns, and the join compares the words themselves.
Either way the corpus is read once.

Defined results: a null or empty text holds nothing; a passage with fewer than ``span`` words has no
pattern; repeated passages are each reported; a repeated document row is reported per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

#: Shared words that make a leak.
SPAN = 10
#: Words of a block in the shift table.
BLOCK = 2
#: Characters of passages that are broadcast; more passages are searched by hashed tables and a join.
PASS_CHARS = 20_000_000
#: Slots of the hashed shift table, bits of the filter over the patterns' hashes, and bytes of a piece while they are put together.
SHIFT_SLOTS, FILTER_BITS, PIECE = 1 << 22, 1 << 27, 1 << 16

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


class WordSearch:
    """Shift table and suffix buckets over the word runs of a set of passages."""

    def __init__(self, passages: list[tuple[int, str]], span: int = SPAN) -> None:
        self.span = span
        self.far = span - BLOCK + 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[str, dict[tuple[str, ...], list[int]]]] = {}
        for item, passage in passages:
            words = words_of(passage)
            for start in range(len(words) - span + 1):
                self._add(item, tuple(words[start : start + span]))

    def _add(self, item: int, pattern: tuple[str, ...]) -> None:
        for end in range(BLOCK - 1, self.span):
            block = pattern[end - 1], pattern[end]
            jump = self.span - 1 - end
            if jump < self.shift.get(block, self.far):
                self.shift[block] = jump
        items = self.buckets.setdefault(pattern[-2:], {}).setdefault(pattern[0], {}).setdefault(pattern, [])
        if item not in items:
            items.append(item)

    def hits(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(position of the first word, items) of each pattern in ``words``, from left to right."""
        at, n, last = self.span - 1, len(words), self.span - 1
        shift, far = self.shift, self.far
        while at < n:
            block = words[at - 1], words[at]
            jump = shift.get(block, far)
            if jump:
                at += jump
                continue
            start = at - last
            same_start = self.buckets.get(block, {}).get(words[start])
            if same_start is not None:
                items = same_start.get(tuple(words[start : at + 1]))
                if items is not None:
                    yield start, items
            at += 1

    def leaks(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (first word, words) of the longest run of the text in which every window belongs to the item."""
        open_runs: dict[int, tuple[int, int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for start, items in self.hits(words_of(text)):
            for item in items:
                begin, end = open_runs.get(item, (start, start - 1))
                begin = begin if end == start - 1 else start
                open_runs[item] = begin, start
                length = start - begin + self.span
                if item not in best or length > best[item][1]:
                    best[item] = begin, length
        return best


_searches: dict[int, WordSearch] = {}


def _search(passages: list[tuple[int, str]], span: int) -> WordSearch:
    """The tables of these passages, built once in a worker process; those of an earlier query are let go."""
    key = hash((span, *passages))
    if key not in _searches:
        _searches.clear()
        _searches[key] = WordSearch(passages, span)
    return _searches[key]


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, words): the items of which a document holds ``span`` consecutive words.

    ``words`` is the length of the longest such run and ``first_word`` its position in the document. One narrow pass over the
    documents; nothing is shuffled unless the passages have more than ``pass_chars`` characters.
    """
    passages = items.select("item_id", "passage").filter("item_id IS NOT NULL AND passage IS NOT NULL")
    if (passages.agg(F.sum(F.length("passage"))).first()[0] or 0) > pass_chars:
        return leaks_by_hash(documents, passages, span)
    rows = sorted((r[0], r[1]) for r in passages.collect())
    shared = documents.sparkSession.sparkContext.broadcast(rows)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _search(shared.value, span)
        for batch in batches:
            rows = [
                (doc, item, first, words)
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                if isinstance(text, str)
                for item, (first, words) in tables.leaks(text).items()
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "words"])

    rows = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    return rows.mapInPandas(search, "doc_id long, item_id long, first_word int, words int")


def _hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def _patterns(passages: DataFrame, span: int) -> DataFrame:
    """(item_id, run): every run of ``span`` words of the passages, once an item."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for item, passage in zip(batch["item_id"], batch["passage"], strict=True):
                words = words_of(passage)
                found += [(item, " ".join(words[i : i + span])) for i in range(len(words) - span + 1)]
            yield pd.DataFrame(found, columns=["item_id", "run"])

    return passages.mapInPandas(runs, "item_id long, run string").distinct()


def _hashed_tables(patterns: DataFrame, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The shift of each slot, and a bit for each pattern's hash; put together in pieces, so that only arrays of a fixed size move."""
    far = span - BLOCK + 1

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, bits = np.full(SHIFT_SLOTS, far, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for run in batch["run"]:
                words = run.split(" ")
                for end in range(BLOCK - 1, span):
                    slot = _hash(words[end - 1 : end + 1]) % SHIFT_SLOTS
                    shift[slot] = min(shift[slot], span - 1 - end)
                bit = _hash(words) % FILTER_BITS
                bits[bit >> 3] |= 1 << (bit & 7)
        pieces = [(kind, i, table[i : i + PIECE]) for kind, table, rest in (("shift", shift, far), ("bits", bits, 0)) for i in range(0, len(table), PIECE) if (table[i : i + PIECE] != rest).any()]
        yield pd.DataFrame([(k, i, t.tobytes()) for k, i, t in pieces], columns=["kind", "at", "bytes"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, table = None, None
        for batch in batches:
            for kind, at, raw in batch.itertuples(index=False):
                piece = np.frombuffer(raw, np.uint8)
                if (kind, at) == key:
                    table = np.minimum(table, piece) if kind == "shift" else table | piece
                    continue
                if key is not None:
                    yield pd.DataFrame([(*key, table.tobytes())], columns=["kind", "at", "bytes"])
                key, table = (kind, at), piece
        if key is not None:
            yield pd.DataFrame([(*key, table.tobytes())], columns=["kind", "at", "bytes"])

    schema = "kind string, at int, bytes binary"
    pieces = patterns.select("run").mapInPandas(build, schema).repartition("kind", "at").sortWithinPartitions("kind", "at")
    shift, bits = np.full(SHIFT_SLOTS, far, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8)
    for kind, at, raw in pieces.mapInPandas(merged, schema).toLocalIterator():
        (shift if kind == "shift" else bits)[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
    return shift, bits


def leaks_by_hash(documents: DataFrame, passages: DataFrame, span: int = SPAN) -> DataFrame:
    """``leaks`` for any number of passages: a hashed Wu-Manber scan emits the windows that may be patterns, a join confirms them.

    A window that stands in many documents is a hot key of the windows' side alone, which adaptive execution splits.
    """
    patterns = written(_patterns(passages, span), "patterns")
    shared = documents.sparkSession.sparkContext.broadcast(_hashed_tables(patterns, span))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, bits = shared.value
        for batch in batches:
            found = []
            for place, doc, text in zip(batch["place"], batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                at = span - 1
                while at < len(words):
                    jump = int(shift[_hash(words[at - 1 : at + 1]) % SHIFT_SLOTS])
                    if not jump:
                        run = words[at - span + 1 : at + 1]
                        bit = _hash(run) % FILTER_BITS
                        if bits[bit >> 3] >> (bit & 7) & 1:
                            found.append((place, doc, at - span + 1, " ".join(run)))
                    at += jump or 1
            yield pd.DataFrame(found, columns=["place", "doc_id", "start", "run"])

    rows = documents.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text").filter(F.col("text").isNotNull())
    windows = written(rows.mapInPandas(scan, "place long, doc_id long, start int, run string"), "windows")
    hits = windows.join(patterns, "run").select("place", "doc_id", "item_id", "start")
    # consecutive starts of one item are one run; a window holds one document's hits of one item
    island = F.col("start") - F.row_number().over(Window.partitionBy("place", "item_id").orderBy("start"))
    runs = hits.withColumn("island", island).groupBy("place", "doc_id", "item_id", "island")
    runs = runs.agg(F.min("start").alias("first"), (F.count(F.lit(1)) + span - 1).cast("int").alias("n"))
    best = runs.groupBy("place", "doc_id", "item_id").agg(F.max(F.struct("n", (-F.col("first")).alias("before"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.before")).alias("first_word"), F.col("b.n").alias("words"))
