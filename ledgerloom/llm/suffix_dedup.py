"""Suffix dedup by a depth-limited radix sort.

Inside a shard (see repeats) the suffixes are sorted from the most significant digit on, eight bytes a digit, and only
through the threshold: what is still in one group then is the same window, byte for byte. A pass re-sorts only the
groups in which the digit differs and drops suffixes that stand alone.

Defined cases: a null text is empty; texts shorter than a window lose nothing; repeated rows are copies of each other
and lose what they share; a null doc_id is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import batch, by_row, text_bytes
from ledgerloom.llm.repeats import NO_DOC, Units, apply_spans, covered, repeated_spans, runs

WINDOW = 200
GRAM = 32
DIGIT = 8


def equal_groups(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Positions in starts of which another one has the same `depth` bytes, each with its group: (position, group)."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    digits = np.zeros(len(data) + 1, np.uint64)
    for k in range(DIGIT):
        digits = (digits << np.uint64(8)) | padded[k : k + len(digits)]
    who = np.arange(len(starts))
    heads = np.zeros(min(1, len(who)), np.int64)
    for d in range(0, depth, DIGIT):
        if not len(who):
            break
        drop = np.uint64(8 * max(0, DIGIT - (depth - d)))
        digit = digits[starts[who] + d] >> drop
        size = np.diff(np.append(heads, len(who)))
        group = np.repeat(np.arange(len(heads)), size)
        mixed = np.logical_or.reduceat(digit != digit[heads][group], heads)
        new = np.zeros(len(who), bool)
        new[heads] = True
        if mixed.any():
            part = np.flatnonzero(mixed[group])
            order = part[np.lexsort((digit[part], group[part]))]
            who[part], digit[part] = who[order], digit[order]
            new[part[1:]] |= (digit[part[1:]] != digit[part[:-1]]) & (group[part[1:]] == group[part[:-1]])
        alone = new & np.append(new[1:], True)
        keep = ~alone
        who, new = who[keep], new[keep]
        heads = np.flatnonzero(new)
    return np.stack([who, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(who))))])


def radix_kernel(window: int):
    def kernel(segs: list[bytes], doc: np.ndarray, m: np.ndarray, n: np.ndarray):
        begin = np.concatenate([[0], np.cumsum([len(s) for s in segs])]).astype(np.int64)
        data = np.frombuffer(b"".join(segs), np.uint8)
        seg = np.repeat(np.arange(len(segs)), n)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        again = m[seg] > 1
        again[equal_groups(data, begin[seg] + at, window)[0]] = True
        return runs(again, np.full(len(seg), NO_DOC), seg, at)

    return kernel


_KEPT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]


def _cut_bytes(digest: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            spans = b.column(2)
            out = []
            for i in range(b.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                n = len(own)
                found = 0
                if spans[i].is_valid:
                    gone = covered(n, spans[i].as_py())
                    found = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                    own = own[~gone]
                out.append((n, n - len(own), found, hashlib.sha256(own).hexdigest().encode() if digest else own.tobytes()))
            yield batch(_KEPT, [b.column(0), *map(list, zip(*out, strict=True))] if out else [b.column(0), [], [], [], []])

    return f


def dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the bytes outside repeated windows (or their SHA-256 in hex)."""
    plain = by_row(docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")), "doc").select("row", "doc", "text")
    spans = repeated_spans(plain, Units(window, min(GRAM, window), False), radix_kernel(window), True)
    return apply_spans(plain, spans, _cut_bytes(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
