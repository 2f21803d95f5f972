"""Quality classifier by Bradley-Terry ranking.

From labelled documents, pairs of a better and a worse one are drawn; a linear score is learned by logistic loss on the
difference of their features, so that the better one scores higher. The scores of the labelled documents then give the
quantile at which to cut: the one that splits them with the fewest errors. Scores are shown from 0 to 1 with that cut
at CUT. Features are counts and shares of a whole text and of its worst line, taken from its bytes on numpy.

Bounds: learning uses at most SAMPLE labelled rows, chosen by a hash of their id, and PAIRS pairs. Only their features
come to the driver. Every document is scored.

Defined cases: null and empty texts have features of zero and a score like any other; a null doc_id is not held out and
is never learned from; repeated rows score alike; of an id with several texts or labels the least is learned from; labels of one kind alone, or none, give every text the score CUT; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import Prefix, batch, byte_codes, slices, small_batches, text_bytes, words
from ledgerloom.llm.near_dedup import shingle_sets

SAMPLE = 20_000
PAIRS = 60_000
CUT = 0.7
HELD_OUT = 2
RIDGE = 1e-3

_KINDS = np.zeros((7, 256), bool)
_KINDS[0, list(b"#*$%&|<>")] = True
_KINDS[1, 65:91] = True
_KINDS[2, 48:58] = True
_KINDS[3, list(b".,;:")] = True
_KINDS[4, list(b"!?")] = True
_KINDS[5, 128:] = True
_KINDS[6, list(b"-_=/\\@()[]{}~^+'\"")] = True


def _shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row: shares of kinds of bytes, words, mean word length, words equal to the one before, distinct words."""
    begin, end, rows = words(data, offsets)
    size = np.maximum(np.diff(offsets), 1)
    n = np.diff(rows)
    columns = [np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offsets]) / size for kind in _KINDS]
    long = np.diff(np.concatenate([[0], np.cumsum(end - begin)])[rows]) / np.maximum(n, 1)
    h = Prefix(byte_codes(data, lower=True)).of(begin, end)
    row = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again = np.diff(np.concatenate([[0], np.cumsum(again)])[rows]) / np.maximum(n, 1)
    order = np.lexsort((h, row))
    new = np.ones(len(h), np.int64)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.diff(np.concatenate([[0], np.cumsum(new)])[rows]) / np.maximum(n, 1)
    return np.stack([*columns, np.log1p(n), np.minimum(long, 30) / 10, again, distinct, (n < 10).astype(float)], 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    whole = _shares(data, offsets)
    # Lines: cut at every newline and at every text's begin.
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    lines = _shares(data, cuts)
    many = lines[:, 7] >= np.log1p(4)
    text = np.searchsorted(offsets, cuts[:-1], "right") - 1
    worst = np.zeros((len(offsets) - 1, 5))
    for k, c in enumerate((0, 1, 4, 9)):
        np.maximum.at(worst[:, k], text[many], lines[many, c])
    np.maximum.at(worst[:, 4], text[many], 1 - lines[many, 10])
    h, at = shingle_sets(data, offsets)
    n = np.round(np.expm1(whole[:, 7]))
    repeats = 1 - np.diff(at) / np.maximum(np.where(n >= 5, n - 4, np.minimum(n, 1)), 1)
    one = np.concatenate([whole, worst, repeats[:, None]], 1)
    # Steps let a linear score see "more than a little" as such.
    steps = [one[:, c] > t for c in (0, 1, 4, 9, 12, 13, 14, 15, 17) for t in (0.02, 0.1, 0.3)]
    return np.concatenate([one, np.sqrt(np.abs(one)), np.stack(steps, 1)], 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(2))
        for i, j in slices(np.diff(offsets)):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch([("label", pa.int32()), ("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))], [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), list(x)])


def learn(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, rounds: int = 50) -> dict | None:
    """Mean, scale and weights of the score, its cut and its spread; None if there is nothing to compare."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    draw = np.random.Generator(np.random.PCG64(11))
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))
        slope = d.T @ p / pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
        if np.linalg.norm(step) < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    # Errors if the first k are called bad.
    wrong = np.concatenate([[0], np.cumsum(label[order] == 1)]) + (label == 0).sum() - np.concatenate([[0], np.cumsum(label[order] == 0)])
    allowed = np.concatenate([[True], s[order][1:] > s[order][:-1], [True]])
    k = int(np.flatnonzero(allowed)[np.argmin(wrong[allowed])])
    edge = np.concatenate([[s[order][0] - 1], s[order], [s[order][-1] + 1]])
    return {"mean": mean, "scale": scale, "w": w, "cut": float((edge[k] + edge[k + 1]) / 2), "spread": float(max(s.std(), 1e-9)), "quantile": k / len(s)}


def score(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), CUT)
    s = (((x - model["mean"]) / model["scale"]) @ model["w"] - model["cut"]) / model["spread"]
    return 1 / (1 + np.exp(-np.clip(2 * s + np.log(CUT / (1 - CUT)), -50, 50)))


_SCORE = [("doc_id", pa.int64()), ("score", pa.float64())]


def _scores(model: dict | None):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in slices(np.diff(offsets)):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch(_SCORE, [b.column(0).slice(i, j - i), score(x, model)])

    return f


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == HELD_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    share = max(1, -(-known.count() // SAMPLE))
    # About SAMPLE rows; the limit makes the bound of what is broadcast and collected a proven one.
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    own = plain.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = own.select("label", "doc_id", "text").mapInArrow(_features, "label int, doc_id long, x array<double>").toPandas()
    # The order in which rows come must not tell which pairs are drawn.
    rows = rows.sort_values("doc_id")
    model = learn(np.stack(rows["x"]), rows["label"].to_numpy()) if len(rows) else None
    out = plain.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
