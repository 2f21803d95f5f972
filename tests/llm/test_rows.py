"""The corpus operators on tables in which several rows have no id, or one id stands for several texts."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from ledgerloom.llm import decontamination, mixing, near_dedup, repeats, substring_dedup, suffix_dedup

BASE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"x{i}" for i in range(70))
ROWS = [
    (None, BASE), (None, "short one"), (None, OTHER + " tail"), (None, None), (None, BASE + " " + OTHER), (None, BASE), (1, "a " + BASE), (2, OTHER), (2, "b " + BASE + " b"), (2, " ".join(f"y{i}" for i in range(50))), (3, "c " + " ".join(f"y{i}" for i in range(50))), (3, OTHER),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_substrings_by_row(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    lowest = lambda k: -1 if k is None else k
    first = {}
    for k, t in sorted(ROWS, key=lambda r: lowest(r[0])):
        w = (t or "").split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), lowest(k))
    want = Counter()
    for k, t in ROWS:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < lowest(k) for j in range(i, i + 13)}
        want[(k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert Counter(map(tuple, substring_dedup.dedup(docs).collect())) == want


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_suffixes_by_row(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    texts = [(k, (t or "").encode()) for k, t in ROWS]
    count = Counter(b[i : i + 150] for _, b in texts for i in range(len(b) - 149))
    want = Counter()
    for k, b in texts:
        gone = {j for i in range(len(b) - 149) if count[b[i : i + 150]] > 1 for j in range(i, i + 150)}
        want[(k, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest())] += 1
    out = suffix_dedup.dedup(docs, window=150, digest=True).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"].decode()) for r in out) == want


def test_near_duplicates_by_row(spark):
    draw = random.Random(5)
    text = lambda: [f"t{draw.randrange(10**6)}" for _ in range(80)]
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: " ".join([*t[:-2], "end"])
    rows = [(None, " ".join(a)), (None, " ".join(b)), (None, " ".join(a)), (None, " ".join(c)), (4, near(c)), (5, near(a)), (6, near(b)), (7, " ".join(d)), (7, " ".join(e)), (8, near(d)), (9, near(e)), (10, " ".join(b))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string")
    out = near_dedup.groups(docs, row="n").collect()
    kept = {r["n"] for r in out if r["kept"]}
    assert kept in ({0, 1, 3, 7, 8}, {2, 1, 3, 7, 8})
    assert {r["n"]: r["component_id"] for r in out} == {**dict.fromkeys((0, 1, 2, 3, 4, 5, 6, 11)), **dict.fromkeys((7, 8, 9, 10), 7)}
    plain = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(docs.drop("n").repartition(3)).collect())
    assert plain == Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out)


def test_mixing_by_row(spark):
    rows = [(None, "w " * 20, "a")] * 200 + [(None, "w " * (1 + i % 30), "b") for i in range(200)] + [(5, "w " * 25, "c")] * 40 + [(i, "w " * 30, "c") for i in range(10, 100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(out) == len(rows)
    assert all(r["copies"] <= 2 for r in out)
    for s in {r["source_size"] for r in out}:
        own = [r for r in out if r["source_size"] == s]
        assert own[0]["target"] - 30 <= sum(r["taken"] for r in own) <= own[0]["target"]


def test_stages_by_row(spark, tmp_path):
    draw = random.Random(4)
    text = lambda: " ".join("".join(draw.choices("aeioulnrst", k=5)) for _ in range(60)) + "."
    good, leak, bad = [text() for _ in range(40)], text(), "### $$$ " * 40
    rows = [(i if i < 20 else None, t, "en", "s0", 1) for i, t in enumerate(good)] + [(None, leak, "en", "s0", 1), (None, bad, "en", "s0", 1), (None, good[30], "en", "s0", 1), (3, leak + " a", "en", "s0", 1), (4, bad, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = {n: lambda d, f=f: Counter((r["doc_id"], r["text"]) for r in f(spark, d, str(tmp_path)).collect()) for n, f in corpus_pipeline.STAGES}
    every = Counter((r[0], r[1]) for r in rows)
    assert stage["quality_rules"](docs) == Counter({k: n for k, n in every.items() if k[1] != bad})
    assert stage["near_dedup"](docs) == Counter({(k if k is not None else None, t): 1 for k, t in [*((r[0], r[1]) for r in rows[:42])]})
    assert stage["decontamination"](docs) == Counter({k: n for k, n in every.items() if not k[1].startswith(leak)})
    mixed = stage["mixing"](docs)
    assert set(mixed) <= set(every)
    assert all(n <= 2 * every[k] for k, n in mixed.items())
    assert len(set(mixed.values())) > 1


def test_short_items_inside_texts(spark):
    texts = {1: "so A b C d e f g", 2: "x a b c", 3: "a b c", 4: "one two three four five six a", 5: "a b", 6: "c\td", 7: None, 8: "", 9: "a b c a b c a b c"}
    docs = spark.createDataFrame([*texts.items(), (None, "at the end a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (2, "C D"), (3, "a"), (4, "two THREE four five"), (5, "A b c"), (6, None), (7, ""), (8, "one two three four five six")], "item_id long, text string")
    want = set()
    for k, t in [*texts.items(), (None, "at the end a b c")]:
        w = (t or "").lower().split()
        for r in items.collect():
            x = (r["text"] or "").lower().split()
            at = [i for i in range(len(w) - len(x) + 1) if x and w[i : i + len(x)] == x]
            want |= {(k, r["item_id"], at[0], len(x), 1.0)} if at else set()
    found = decontamination.find(docs, items).collect()
    assert len(found) == len(want)
    assert {tuple(r) for r in found} == want
    only = decontamination.find(docs, items.where("item_id <= 5")).collect()
    assert {tuple(r) for r in only} == {x for x in want if x[1] <= 5}
