"""Repeated windows of a corpus: which windows of T symbols occur in more than one place, at a cost linear in the corpus.

Both repeat operators, the FM-index one over words and the radix-sort one over bytes, share this plan:

1. Every window has an anchor: the smallest hash among its grams, leftmost on ties. Equal windows have equal anchors.
   Consecutive windows with one anchor form a segment (about a fifth of all positions for words, a hundredth for bytes).
2. Segments whose anchor occurs once hold no repeated window. The others stay, with a hash of their content.
3. Of segments with one content a single copy goes on, with its number of occurrences and the smallest document, so a
   passage that a third of the corpus shares is one row from here on.
4. Distinct segments meet by anchor in shards of bounded size, where the operator's own kernel finds equal windows.
   An anchor that more than CROWD distinct segments share is too much for a shard. It is split by a longer gram: the
   windows of a segment are halved by where the anchor stands in them, each half has more symbols in common than the
   anchor alone, and those are its anchor from then on. So it goes on until every part fits; at the end stands a window by
   itself, which is its own anchor and one row.
5. What repeats returns to its documents as spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import NO_DOC, SECOND, Prefix, batch, byte_codes, cut, keep, mix, release, slices, small_batches, sweep, text_bytes, words

#: Distinct segments of an anchor beyond which it is split. It bounds a shard of one anchor to some MB.
CROWD = 10_000
#: Rows of small tables about crowded anchors that are sent to every executor; larger ones are joined by key.
FEW = 100_000
#: Bytes of segments that a shard holds, unless one anchor alone has more (at most CROWD segments).
SHARD_BYTES = 2_000_000
#: Low bits that hold a gram's place while the smallest is sought: enough for the longest text there can be.
BITS = 31


@dataclass(frozen=True)
class Units:
    """Windows of `window` symbols, words or bytes, anchored by grams of `gram` symbols."""

    window: int
    gram: int
    by_word: bool

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash code of each symbol, each row's first symbol (one more than rows), begin and end byte of each symbol."""
        if not self.by_word:
            at = np.arange(len(data))
            return byte_codes(data), offsets, at, at + 1
        begin, end, rows = words(data, offsets)
        return Prefix(byte_codes(data)).of(begin, end), rows, begin, end


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments_of(units: Units, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Row, first window within the row, number of windows, anchor hash and content hash of every segment."""
    codes, rows, _, _ = units.read(data, offsets)
    n, t = len(codes), units.window
    if n < t:
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "fp", "sh")}
    sums = Prefix(codes)
    at = np.arange(n - units.gram + 1)
    grams = sums.of(at, at + units.gram)
    # A hash of the whole segment that shares neither base nor codes with that of the anchor.
    whole_of = Prefix(mix(codes), SECOND)
    bits = np.uint64(BITS)
    lowest = _sliding_min((grams >> bits << bits) | at.astype(np.uint64), t - units.gram + 1)
    step = np.zeros(n - t + 2, np.int8)
    whole = np.diff(rows) >= t
    step[rows[:-1][whole]] += 1
    step[rows[1:][whole] - t + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "fp", "sh")}
    anchor = (lowest[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    first = starts[head]
    row = np.searchsorted(rows, first, "right") - 1
    return {"row": row, "start": first - rows[row], "n": count, "fp": grams[anchor[head]].view(np.int64), "sh": whole_of.of(first, first + count - 1 + t).view(np.int64)}


_ANCHOR = [("fp", pa.int64()), ("sh", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]


def _anchors(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            row, doc = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, j in slices(np.diff(offsets)):
                s = segments_of(units, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(0, len(s["row"]), 100_000):
                    p = {x: v[k : k + 100_000] for x, v in s.items()}
                    yield batch(_ANCHOR, [p["fp"], p["sh"], row[i:j][p["row"]], doc[i:j][p["row"]], p["start"].astype(np.int32), p["n"].astype(np.int32)])

    return f


_SEGMENT = [("fp", pa.int64()), ("sh", pa.int64()), ("doc", pa.int64()), ("m", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()), ("seg", pa.binary())]
_SEGMENT_DDL = "fp long, sh long, doc long, m long, n int, anchor int, seg binary"


def _extract(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The content of the wanted segments, and where the anchor stands in it (-1 unless it is crowded)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            wanted = b.column(3)
            held = wanted.flatten()
            part = {name: held.field(name).to_numpy(zero_copy_only=False) for name in ("fp", "sh", "doc", "m", "n", "start", "crowded")}
            lists = np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
            for i, j in slices(np.diff(offsets), 1 << 20):
                text = data[offsets[i] : offsets[j]]
                codes, rows, begin, end = units.read(text, offsets[i : j + 1] - offsets[i])
                own = {name: v[lists[i] : lists[j]] for name, v in part.items()}
                first = rows[np.repeat(np.arange(j - i), np.diff(lists[i : j + 1]))] + own["start"]
                last = first + own["n"] + units.window - 2
                raw, anchor = text.tobytes(), np.full(len(first), -1, np.int32)
                grams = Prefix(codes) if own["crowded"].any() else None
                for k in np.flatnonzero(own["crowded"]).tolist():
                    at = np.arange(first[k], last[k] + 2 - units.gram)
                    anchor[k] = np.argmax(grams.of(at, at + units.gram).view(np.int64) == own["fp"][k])
                segs = [raw[x:y] for x, y in zip(begin[first].tolist(), end[last].tolist(), strict=True)]
                yield batch(_SEGMENT, [own["fp"], own["sh"], own["doc"], own["m"], own["n"], anchor, segs])

    return f


_PART = [("fp", pa.int64()), ("sh", pa.int64()), ("ofp", pa.int64()), ("osh", pa.int64()), ("skip", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("doc", pa.int64()), ("m", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()), ("seg", pa.binary())]
_PART_DDL = "fp long, sh long, ofp long, osh long, skip int, low int, high int, doc long, m long, n int, anchor int, seg binary"


def _halves(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each part, which holds windows with the anchor at place low to high, the two halves by that place.

    All windows with the anchor at low to high have the symbols from anchor - low on to anchor - high + window in common,
    and so has every other segment with such a window: they are the half's anchor.
    """
    t, glue = units.window, b" " if units.by_word else b""

    def name(*of: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"\0".join(of), digest_size=8).digest(), "little", signed=True)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.to_pylist():
                symbols = p["seg"].split() if units.by_word else p["seg"]
                cut_ = (lambda x, y: glue.join(symbols[x:y])) if units.by_word else (lambda x, y: symbols[x:y])  # noqa: B023
                middle = (p["low"] + p["high"]) // 2
                for low, high in ((p["low"], middle), (middle + 1, p["high"])):
                    # Windows of the part, by their first symbol.
                    first, last = max(0, p["anchor"] - high), min(p["n"] - 1, p["anchor"] - low)
                    if first > last:
                        continue
                    seg, place = cut_(first, last + t), f"{low} {high}".encode()
                    out.append((name(place, cut_(p["anchor"] - low, p["anchor"] - high + t)), name(b"whole", place, seg), p["ofp"], p["osh"], p["skip"] + first, low, high, p["doc"], p["m"], last - first + 1, p["anchor"] - first, seg))
            yield batch(_PART, list(map(list, zip(*out, strict=True))) if out else [[] for _ in _PART])

    return f


def _small(df: DataFrame) -> DataFrame:
    """df, which is cut, to be sent to every executor if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _crowds(rows: DataFrame) -> DataFrame:
    """Anchors fp of distinct segments (fp, sh) that are too many for one shard."""
    return rows.groupBy("fp").agg(F.count("*").alias("k")).where(F.col("k") > CROWD).select("fp")


def _in_shards(distinct: DataFrame, kernel: Kernel) -> DataFrame:
    return distinct.select("fp", "sh", "doc", "m", "n", "seg").repartition("fp").sortWithinPartitions("fp").mapInArrow(_shards(kernel), _FOUND_DDL)


def _crowded_runs(segments: DataFrame, units: Units, kernel: Kernel) -> DataFrame:
    """What _in_shards finds, of segments with crowded anchors: by halves until every anchor's parts fit a shard."""
    whole = segments.select("fp", "sh", F.col("fp").alias("ofp"), F.col("sh").alias("osh"), F.lit(0).alias("skip"), F.lit(0).alias("low"), F.lit(units.window - units.gram).alias("high"), "doc", "m", "n", "anchor", "seg")
    parts, every = cut(whole), None
    while not parts.isEmpty():
        halves = cut(parts.mapInArrow(_halves(units), _PART_DDL))
        release(parts)
        crowds = cut(_crowds(halves.select("fp", "sh").distinct()))
        fit = halves.join(crowds, "fp", "left_anti")
        # Parts of several segments may be one and the same.
        one = fit.groupBy("fp", "sh").agg(F.min("doc").alias("doc"), F.sum("m").alias("m"), F.first("n").alias("n"), F.first("seg").alias("seg"))
        found = _in_shards(one, kernel).join(fit.select("fp", "sh", "ofp", "osh", "skip"), ["fp", "sh"])
        found = found.select(F.col("ofp").alias("fp"), F.col("osh").alias("sh"), (F.col("b") + F.col("skip")).alias("b"), (F.col("e") + F.col("skip")).alias("e"), "lo")
        every = found if every is None else every.unionByName(found)
        parts = cut(halves.join(crowds, "fp", "left_semi").where("low < high"))
    return every


#: Finds repeated windows in one shard: (segments, documents, occurrences, windows in each) -> (segment, first window,
#: end window, smallest document) of each run.
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
_FOUND = [("fp", pa.int64()), ("sh", pa.int64()), ("b", pa.int32()), ("e", pa.int32()), ("lo", pa.int64())]
_FOUND_DDL = "fp long, sh long, b int, e int, lo long"


def _shards(kernel: Kernel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by anchor. A shard is closed at an anchor's end once it holds enough, so memory is bounded."""

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        fp, sh = t["fp"].to_numpy(), t["sh"].to_numpy()
        _, one = np.unique(np.stack([fp, sh], 1), axis=0, return_index=True)
        t, fp, sh = t.take(one), fp[one], sh[one]
        seg, b, e, lo = kernel(t["seg"].to_pylist(), t["doc"].to_numpy(), t["m"].to_numpy(), t["n"].to_numpy())
        return batch(_FOUND, [fp[seg], sh[seg], b.astype(np.int32), e.astype(np.int32), lo])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            while b.num_rows:
                fp = b.column(0).to_numpy()
                lengths = np.diff(text_bytes(b.column(5))[1])
                total = np.cumsum(lengths) + size
                end = b.num_rows
                if total[-1] > SHARD_BYTES:
                    full = int(np.searchsorted(total, SHARD_BYTES))
                    changes = np.flatnonzero(fp[1:] != fp[:-1]) + 1
                    if held and held[-1].column(0)[-1].as_py() != fp[0] and full == 0:
                        yield judge(held)
                        held, size = [], 0
                        continue
                    later = changes[changes > full]
                    if len(later):
                        end = int(later[0])
                        held.append(b.slice(0, end))
                        yield judge(held)
                        held, size = [], 0
                        b = b.slice(end)
                        continue
                held.append(b)
                size = int(total[-1])
                break
        if held:
            yield judge(held)

    return f


def runs(flag: np.ndarray, value: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows with one value: segment, first window, end window, value."""
    if not len(flag):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    new = np.ones(len(flag), bool)
    new[1:] = (flag[1:] != flag[:-1]) | (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(flag)) - 1
    keep = flag[head]
    return seg[head][keep], at[head][keep], at[last][keep] + 1, value[head][keep]


def repeated_spans(docs: DataFrame, units: Units, kernel: Kernel, any_copy: bool) -> DataFrame:
    """(row, spans) with spans an array of (b, e) in symbols, of rows that have any; docs has columns row, doc, text.

    any_copy: a window counts if it starts anywhere else too; else only if it starts in a document with a smaller id.
    A null id is the smallest. Texts are found again by row, which is of one row alone; ids are only compared.
    """
    small_batches(docs.sparkSession)
    known = docs.select("row", F.coalesce("doc", F.lit(NO_DOC)).alias("doc"), "text")
    found = known.mapInArrow(_anchors(units), "fp long, sh long, row long, doc long, start int, n int")
    # Cut, so that the join below deals out both sides anew and Spark can split a hot anchor's rows.
    often = cut(found.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1"))
    kept = keep(found.join(often.select("fp"), "fp"))
    release(often)
    sweep(docs.sparkSession)

    # One of the segments with each content, and of them all the smallest document.
    single = keep(kept.groupBy("fp", "sh").agg(F.min("row").alias("row"), F.min_by("start", "row").alias("start"), F.min("doc").alias("doc"), F.min("n").alias("n"), F.count("*").alias("m")))
    sweep(docs.sparkSession)

    def wanted(single: DataFrame, crowded: bool) -> DataFrame:
        return single.groupBy("row").agg(F.collect_list(F.struct("fp", "sh", "doc", "m", "n", "start", F.lit(crowded).alias("crowded"))).alias("wanted"))

    def contents(wanted: DataFrame) -> DataFrame:
        # All columns, as apply_spans has them, so that one exchange serves both.
        return docs.join(wanted, "row").select("row", "doc", "text", "wanted").mapInArrow(_extract(units), _SEGMENT_DDL)

    crowded_runs, crowds = None, cut(_crowds(single))
    if not crowds.isEmpty():
        held = cut(single.join(_small(crowds), "fp", "left_semi"))
        few = held.count() <= FEW
        crowded_runs = _crowded_runs(contents(F.broadcast(wanted(held, True)) if few else wanted(held, True)), units, kernel)
        single = single.join(_small(crowds), "fp", "left_anti")
        sweep(docs.sparkSession)
    # Not cut: the texts dealt out by row serve this join and that of apply_spans in one shuffle.
    hits = _in_shards(contents(wanted(single, False)), kernel)
    hits = hits if crowded_runs is None else hits.unionByName(crowded_runs)
    runs_ = kept.select("fp", "sh", "row", "doc", "start").join(hits, ["fp", "sh"])
    if not any_copy:
        runs_ = runs_.where("lo < doc")
    spans = runs_.select("row", F.struct((F.col("start") + F.col("b")).alias("b"), (F.col("start") + F.col("e") - 1 + units.window).alias("e")).alias("s"))
    return spans.groupBy("row").agg(F.collect_list("s").alias("spans"))


def apply_spans(docs: DataFrame, spans: DataFrame, f: Callable, schema: str) -> DataFrame:
    """f over batches of (doc_id, text, spans); every row of docs once."""
    return docs.join(spans, "row", "left").select("doc", "text", "spans").mapInArrow(f, schema)


def covered(length: int, spans: list[dict]) -> np.ndarray:
    """Which of `length` symbols the spans cover."""
    step = np.zeros(length + 1, np.int32)
    for s in spans:
        step[min(s["b"], length)] += 1
        step[min(s["e"], length)] -= 1
    return np.cumsum(step[:-1]) > 0
