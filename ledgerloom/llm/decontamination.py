"""Benchmark decontamination by SimHash over item-sized windows.

For every item length the windows of that many words are fingerprinted; a multi-index finds the items whose fingerprint
is within RADIUS bits, without a miss: with BLOCKS blocks of 8 bits, two fingerprints within the radius differ by at most
RADIUS // BLOCKS bits in some block, and each block's index holds all values that near. Candidates are verified by the
weighted similarity of their 5-word shingles (the sum of the lesser counts over the sum of the greater).

Only windows that can reach the threshold are fingerprinted: a window of n shingles needs 2t / (1 + t) of them to be
shingles of the benchmark, which prefix sums tell. A window that doesn't begin with such a shingle is never better than
its right neighbour, so only those that do begin a window, and the last window of the text.

The benchmark is read in blocks of BLOCK_ITEMS items, so what each task holds is bounded; the corpus isn't shuffled.

An item of fewer than five words is one shingle, so only windows of exactly its words match it; those are looked up by
their hash, wherever they stand in a text.

Defined cases: null and empty texts and items match nothing; a text of fewer than five words is one shingle to longer
items; a text shorter than an item is one window; null ids stay null; repeated rows are judged alike and repeated items count once; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import Prefix, batch, byte_codes, mix, slices, small_batches, text_bytes, words

SHINGLE = 5
THRESHOLD = (75, 100)
BLOCKS = 8
RADIUS = 23
BLOCK_ITEMS = 20_000


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """Hash of the shingle at each word (of a row's last words and of short rows: what is left), rows' first words, the
    number of shingles of each row, and hashes of any words."""
    begin, end, rows = words(data, offsets)
    sums = Prefix(Prefix(byte_codes(data, lower=True)).of(begin, end))
    at = np.arange(len(begin))
    row = np.searchsorted(rows, at, "right") - 1
    n = np.diff(rows)
    return sums.of(at, np.minimum(at + SHINGLE, rows[1:][row])), rows, np.maximum(np.where(n > 0, 1, 0), n - SHINGLE + 1), sums


_BIT = np.arange(64, dtype=np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    return (((mix(h)[:, None] >> _BIT) & np.uint64(1)).astype(np.int32) << 1) - 1


def fingerprint(total: np.ndarray) -> np.ndarray:
    return ((total > 0).astype(np.uint64) << _BIT).sum(-1, dtype=np.uint64)


class Items:
    """The benchmark as shingle counts, fingerprints and, for each block of bits, the items near each of its values."""

    def __init__(self, names: list, texts: list[str | None]):
        column = pa.array(texts, pa.string())
        h, rows, n, _ = shingles(*text_bytes(column))
        size = np.diff(rows)
        #: Items of fewer words than a shingle by their number of words and hash.
        self.short: dict[int, dict[int, list]] = {}
        for i in np.flatnonzero((size > 0) & (size < SHINGLE)).tolist():
            self.short.setdefault(int(size[i]), {}).setdefault(int(h[rows[i]]), []).append(names[i])
        keep = np.flatnonzero(size >= SHINGLE)
        self.names = [names[i] for i in keep]
        self.words = np.diff(rows)[keep]
        self.sets = [dict(zip(*(x.tolist() for x in np.unique(h[rows[i] : rows[i] + n[i]], return_counts=True)), strict=True)) for i in keep]
        self.prints = np.array([fingerprint(signs(h[rows[i] : rows[i] + n[i]]).sum(0)) for i in keep], np.uint64)
        self.known = np.unique(np.concatenate([h[rows[i] : rows[i] + n[i]] for i in keep])) if len(keep) else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = sorted(set(self.words.tolist()))
        values = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(values[:, None] ^ values) <= RADIUS // BLOCKS
        self.index = {}
        for length in self.lengths:
            own = np.flatnonzero(self.words == length)
            cells = self.prints[own].view(np.uint8).reshape(-1, BLOCKS)
            self.index[length] = (own, [[np.flatnonzero(near[v][cells[:, k]]) for v in range(256)] for k in range(BLOCKS)])

    def among(self, h: np.ndarray) -> np.ndarray:
        hit = self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        place = np.searchsorted(self.known, h[at])
        hit[at] = self.known[np.minimum(place, len(self.known) - 1)] == h[at]
        return hit

    def within(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """(position in prints, item) of all items of the length within the radius."""
        own, tables = self.index[length]
        cells = prints.view(np.uint8).reshape(-1, BLOCKS)
        for k in range(len(prints)):
            some = np.unique(np.concatenate([tables[j][cells[k, j]] for j in range(BLOCKS)]))
            for i in own[some[np.bitwise_count(self.prints[own[some]] ^ prints[k]) <= RADIUS]].tolist():
                yield k, i

    def short_matches(self, sums: Prefix, rows: np.ndarray) -> Iterator[tuple[int, object, int, int]]:
        """(row, item, first word, words) of each short item that a row has, at its first place there."""
        for length, known in self.short.items():
            at = np.arange(max(0, int(rows[-1]) - length + 1))
            row = np.searchsorted(rows, at, "right") - 1
            inside = at + length <= rows[1:][row]
            at, row = at[inside], row[inside]
            h = sums.of(at, at + length)
            hit = np.flatnonzero(np.isin(h, np.array(list(known), np.uint64)))
            _, first = np.unique(np.stack([row[hit].astype(np.uint64), h[hit]], 1), axis=0, return_index=True)
            for k in hit[first].tolist():
                for item in known[int(h[k])]:
                    yield int(row[k]), item, int(at[k] - rows[row[k]]), length

    def matches(self, h: np.ndarray, hit: np.ndarray, n: int, total: int) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of a document's best window; h and hit by word, n shingles."""
        found: dict[int, tuple[float, int, int]] = {}
        count = np.concatenate([[0], np.cumsum(hit[:n])])
        starts = np.flatnonzero(hit[:n])
        sums = None
        a, b = THRESHOLD
        for length in self.lengths:
            size = max(1, length - SHINGLE + 1)
            end_start = max(0, n - size)
            s = np.unique(np.append(np.minimum(starts, end_start), end_start))
            e = np.minimum(s + size, n)
            # Of shingles of a window and of an item in common: t / (1 + t) of both together.
            s_ok = (count[e] - count[s]) * (a + b) >= a * (e - s + size)
            s, e = s[s_ok], e[s_ok]
            if not len(s):
                continue
            if sums is None:
                low, high = int(starts[0]), min(n, int(starts[-1]) + max(self.lengths))
                low = min(low, max(0, n - max(self.lengths)))
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(h[low:n]), 0, dtype=np.int32)])
            for k, i in self.within(fingerprint(sums[e - low] - sums[s - low]), length):
                own = dict(zip(*(x.tolist() for x in np.unique(h[s[k] : e[k]], return_counts=True)), strict=True))
                both = sum(min(c, own.get(x, 0)) for x, c in self.sets[i].items())
                every = sum(self.sets[i].values()) + int(e[k] - s[k]) - both
                if b * both >= a * every and (i not in found or both / every > found[i][0]):
                    found[i] = (both / every, int(s[k]), min(length, total - int(s[k])))
        return found


_MATCH = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())]
_MATCH_DDL = "doc_id long, item_id long, start long, n_words long, similarity double"


_built: dict[str, Items] = {}


def _search(name: str, names: list, texts: list[str | None]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker's tasks share one index.
        if name not in _built:
            _built.clear()
            _built[name] = Items(names, texts)
        items = _built[name]
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            doc, out = b.column(0), []
            for i, j in slices(np.diff(offsets)) if items.names or items.short else ():
                h, rows, n, sums = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, item, at, size in items.short_matches(sums, rows):
                    out.append((doc[i + k].as_py(), item, at, size, 1.0))
                if not items.names:
                    continue
                hit = items.among(h)
                any_ = np.concatenate([[0], np.cumsum(hit)])
                for k in np.flatnonzero(any_[rows[1:]] > any_[rows[:-1]]).tolist():
                    s, e = int(rows[k]), int(rows[k + 1])
                    if not hit[s : s + n[k]].any():
                        continue
                    for item, (similarity, at, size) in items.matches(h[s:e], hit[s:e], int(n[k]), e - s).items():
                        out.append((doc[i + k].as_py(), items.names[item], at, size, similarity))
            yield batch(_MATCH, list(map(list, zip(*out, strict=True))) if out else [[] for _ in _MATCH])

    return f


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: each document's best window for each item it contains."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col("text")).distinct()
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for k in range(blocks):
        # Bounded: about BLOCK_ITEMS items at a time.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        here = plain.mapInArrow(_search(uuid.uuid4().hex, [r["item_id"] for r in part], [r["text"] for r in part]), _MATCH_DDL)
        found = here if found is None else found.unionByName(here)
    return found
