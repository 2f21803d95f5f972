"""Kernels of the corpus operators against brute force, without Spark."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontamination, near_dedup, quality_classifier, quality_rules, token_ids
from ledgerloom.llm._base import text_bytes, words
from ledgerloom.llm.repeats import Units, segments_of
from ledgerloom.llm.substring_dedup import FMIndex, WaveletMatrix, fm_kernel
from ledgerloom.llm.suffix_dedup import equal_groups, radix_kernel

TEXT = st.text(alphabet="aAbB é\n\t.", max_size=60)


@given(st.lists(TEXT, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    begin, end, rows = words(data, offsets)
    for k, t in enumerate(texts):
        got = [data[b:e].tobytes() for b, e in zip(begin[rows[k] : rows[k + 1]], end[rows[k] : rows[k + 1]], strict=True)]
        assert got == re.findall(rb"[^\x20\x09-\x0D]+", t.encode())


@given(st.lists(st.integers(0, 5), min_size=1, max_size=200), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_rank(symbols, c):
    x = np.array(symbols)
    w = WaveletMatrix(x, 6)
    at = np.arange(len(x) + 1)
    assert w.rank(np.full(len(at), c), at).tolist() == [symbols[:i].count(c) for i in at]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=4, max_size=12), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_fm_kernel(segs):
    segs = list({tuple(s): None for s in segs})
    doc, n = np.arange(len(segs)), np.array([len(s) - 3 for s in segs])
    first = {}
    for d, s in enumerate(segs):
        for i in range(len(s) - 3):
            first.setdefault(s[i : i + 4], d)
    seg, b, e, lo = fm_kernel(4)([b" ".join(s) for s in segs], doc, np.ones(len(segs), np.int64), n)
    got = {(s, i): m for s, x, y, m in zip(seg, b, e, lo, strict=True) for i in range(x, y)}
    for d, s in enumerate(segs):
        for i in range(len(s) - 3):
            assert got.get((d, i), d) == first[s[i : i + 4]]


def test_matching_statistics():
    text = np.array([1, 2, 3, 0, 1, 2, 4, 0])
    reached, lo, hi = FMIndex(text, 4).matching_statistics(text, np.array([0, 4]), 2)
    assert reached.tolist() == [2, 2]
    assert (hi - lo).tolist() == [2, 2]


@given(st.binary(min_size=0, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_radix(data, depth):
    starts = np.arange(max(0, len(data) - depth + 1))
    who, _ = equal_groups(np.frombuffer(data, np.uint8), starts, depth)
    count = Counter(data[i : i + depth] for i in starts)
    assert sorted(who.tolist()) == [i for i in starts if count[data[i : i + depth]] > 1]


def test_radix_kernel_counts_copies():
    seg, b, e, _ = radix_kernel(3)([b"abcd", b"xabc"], np.array([0, 1]), np.array([2, 1]), np.array([2, 2]))
    assert list(zip(seg.tolist(), b.tolist(), e.tolist(), strict=True)) == [(0, 0, 2), (1, 1, 2)]


@pytest.mark.parametrize("by_word", [True, False])
def test_segments_cover_every_window(by_word):
    texts = ["a b c d e f g h i", "", None, "x", "a b c d e f g h i" * 3]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    s = segments_of(Units(5, 2, by_word), data, offsets)
    for k, t in enumerate(texts):
        n = len((t or "").split()) if by_word else len(t or "")
        covered = sorted(i for r, a, m in zip(s["row"], s["start"], s["n"], strict=True) if r == k for i in range(a, a + m))
        assert covered == list(range(max(0, n - 4)))


@given(st.lists(TEXT, max_size=5))
@settings(max_examples=60, deadline=None)
def test_shingle_sets(texts):
    h, at = near_dedup.shingle_sets(*text_bytes(pa.array(texts, pa.string())))
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert at[k + 1] - at[k] == len(want)
    assert np.all(np.diff(at) >= 0)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.booleans())
@settings(max_examples=40, deadline=None)
def test_planes(ids, bits):
    x = np.array(ids, np.uint32)
    half = len(ids) // 2
    image = token_ids.encode(x, [5, None], np.array([half, len(ids) - half]), bits)
    assert token_ids.decode(image).tolist() == ids
    assert token_ids.decode(image, 3, 9).tolist() == ids[3:9]
    assert zlib.crc32(token_ids.decode(image).astype("<u4").tobytes()) == zlib.crc32(x.astype("<u4").tobytes())


def test_planes_over_several_chunks():
    x = np.arange(token_ids.CHUNK * 2 + 7, dtype=np.uint32)
    image = token_ids.encode(x, [1], np.array([len(x)]))
    assert np.array_equal(token_ids.decode(image, token_ids.CHUNK - 2, token_ids.CHUNK + 3), x[token_ids.CHUNK - 2 : token_ids.CHUNK + 3])


def test_items_within_radius():
    items = decontamination.Items([1, 2], ["a b c d e f g h i j", "k l m n o p q r s t"])
    near = items.prints[0] ^ np.uint64(0b1011)
    assert (0, 0) in set(items.within(np.array([near]), 10))
    far = items.prints[0] ^ np.uint64((1 << 30) - 1)
    assert (0, 0) not in set(items.within(np.array([far]), 10))


def test_learning_rules():
    patterns = [((1, 1), 900), ((-1, 1), 50), ((1, -1), 50), ((0, 0), 10)]
    prior, ratios = quality_rules.learn(patterns, ["a", "b"])
    assert prior > 0
    assert ratios[0][-1] < 0 < ratios[0][1]
    assert quality_rules.learn([], ["a"])[0] == 0


def test_ranking():
    draw = np.random.default_rng(1)
    label = (draw.random(400) < 0.8).astype(int)
    x = np.stack([label + draw.normal(0, 0.2, 400), draw.normal(size=400)], 1)
    model = quality_classifier.learn(x, label, pairs=4000)
    assert (((quality_classifier.score(x, model) >= 0.7) == label).mean()) > 0.97
    assert quality_classifier.learn(x, np.ones(400)) is None
    assert quality_classifier.score(x, None).tolist() == [0.7] * 400
