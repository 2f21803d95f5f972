"""Substring dedup by a compressed FM-index per shard.

An index holds the Burrows-Wheeler transform of a shard's text as a wavelet matrix: one bit plane for each bit of a
symbol, packed to 64-bit words with a running count. Documents' segments stream against it by backward search, all in
step, which gives the matching statistics of every window up to the threshold; windows that reach it with another
document are reported with the smallest document that has them. See repeats for the way from documents to shards.

Defined cases: a null text is empty; texts of fewer words than a window lose nothing; a null doc_id counts as the
smallest; rows with one doc_id, or with none, are each cut by itself and don't remove each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import batch, by_row, text_bytes
from ledgerloom.llm.repeats import Units, apply_spans, covered, repeated_spans, runs

WINDOW = 13
GRAM = 5


class WaveletMatrix:
    """rank(c, i): how often c occurs before i, for arrays of c and i at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        x = symbols
        for level in range(self.levels - 1, -1, -1):
            b = (x >> level) & 1
            packed = np.zeros((len(x) + 64) // 64 * 8, np.uint8)
            small = np.packbits(b.astype(np.uint8), bitorder="little")
            packed[: len(small)] = small
            plane = packed.view(np.uint64)
            self.bits.append(plane)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(x) - self.counts[-1][-1]))
            x = np.concatenate([x[b == 0], x[b == 1]])
        every = np.arange(sigma)
        self.base = self._down(every, np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            up = (c >> (self.levels - 1 - k)) & 1 == 1
            i = np.where(up, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.base[c]


class FMIndex:
    """Backward search for patterns of up to depth symbols; suffixes are ordered only that far. Symbol 0 separates."""

    def __init__(self, text: np.ndarray, depth: int):
        n, sigma = len(text), int(text.max(initial=0)) + 1
        rank, have = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -have)
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            have *= 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the window of depth symbols at each start: how many of its last symbols match elsewhere in the index (at
        most depth), and the interval of suffixes that carry the part searched. A window whose interval has a single
        suffix left is not searched on."""
        c = text[starts + depth - 1]
        lo, hi, reached = self.first[c].copy(), self.first[c + 1].copy(), np.ones(len(starts), np.int64)
        live = np.flatnonzero(hi - lo > 1)
        for k in range(depth - 2, -1, -1):
            if not len(live):
                break
            c = text[starts[live] + k]
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
            more = hi[live] - lo[live] > 1
            reached[live[more]] += 1
            live = live[more]
        return reached, lo, hi


def fm_kernel(window: int):
    """Windows of a shard that another of its segments has too, each with the smallest document of them all."""

    def kernel(segs: list[bytes], doc: np.ndarray, m: np.ndarray, n: np.ndarray):
        seen: dict[bytes, int] = {}
        parts = [[seen.setdefault(w, len(seen) + 1) for w in s.split()] for s in segs]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(int(begin[-1]), np.int64)
        place = np.ones(len(text), bool)
        place[begin[1:] - 1] = False
        text[place] = np.fromiter((c for p in parts for c in p), np.int64, int(sizes.sum()))
        seg = np.repeat(np.arange(len(segs)), n)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        starts = begin[seg] + at
        reached, lo, _ = FMIndex(text, window).matching_statistics(text, starts, window)
        least = np.full(len(text) + 1, np.iinfo(np.int64).max)
        full = reached == window
        np.minimum.at(least, lo[full], doc[seg[full]])
        smallest = doc[seg].copy()
        smallest[full] = least[lo[full]]
        return runs((m[seg] > 1) | full, smallest, seg, at)

    return kernel


_KEPT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]


def _cut_words(digest: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            spans = b.column(2)
            out = []
            for i in range(b.num_rows):
                ws = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n = len(ws)
                if spans[i].is_valid:
                    gone = covered(n, spans[i].as_py())
                    ws = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                text = b" ".join(ws)
                out.append((n, n - len(ws), hashlib.sha256(text).hexdigest() if digest else text.decode()))
            yield batch(_KEPT, [b.column(0), *map(list, zip(*out, strict=True))] if out else [b.column(0), [], [], []])

    return f


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the text's words without those of repeated windows (or their SHA-256)."""
    plain = by_row(docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")), "doc").select("row", "doc", "text")
    spans = repeated_spans(plain, Units(window, min(GRAM, window), True), fm_kernel(window), False)
    return apply_spans(plain, spans, _cut_words(digest), "doc_id long, n_words long, n_removed long, kept string")
