"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontamination, mixing, near_dedup, quality_classifier, quality_rules, repeats, sharding, substring_dedup, suffix_dedup, token_ids, url_filter
from ledgerloom.llm._base import shared_folder

BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = {0: BASE, 1: BASE, 2: "intro " + BASE, 3: None, 4: "", 5: " \n\t", 6: "A b c", 7: "a B c", 8: BASE.upper() + " tail end here", 9: " ".join(f"v{i % 97}" for i in range(3000)), 10: "Loja " * 40}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), "x", "y", "z") for k, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[2], (None, "no id", None, None, None, None, None, None)], SCHEMA).repartition(3)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules(docs):
    out = quality_rules.judge(docs).collect()
    assert len(out) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in out}
    assert by[10]["n_repeat_words"] == 40
    assert by[10]["base_failed"]
    assert not by[10]["kept"]
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0
    assert quality_rules.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_substrings(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    out = substring_dedup.dedup(docs).collect()
    assert len(out) == len(TEXTS) + 2
    first = {}
    for k, t in sorted(TEXTS.items()):
        w = tokens(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    for r in out:
        if r["doc_id"] is None:
            continue
        w = tokens(TEXTS[r["doc_id"]])
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r["doc_id"]:
                gone |= set(range(i, i + 13))
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_suffixes(docs, crowd, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = docs.collect()
    count = Counter()
    for r in rows:
        b = (r["text"] or "").encode()
        count.update(b[i : i + 200] for i in range(len(b) - 199))
    want = Counter()
    for r in rows:
        b = (r["text"] or "").encode()
        gone = set()
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone |= set(range(i, i + 200))
        spans = sum(1 for i in gone if i - 1 not in gone)
        want[(r["doc_id"], len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"].decode()) for r in suffix_dedup.dedup(docs, digest=True).collect())
    assert got == want


def test_near_duplicates(docs):
    by = {r["doc_id"]: r for r in near_dedup.groups(docs).collect()}
    assert by[1]["component_id"] == by[2]["component_id"] == by[8]["component_id"] == 0
    assert by[7]["component_id"] == 6
    assert by[3]["component_id"] == 3
    assert by[3]["n_shingles"] == 0
    assert by[6]["n_shingles"] == 1
    assert [k for k, r in by.items() if r["kept"] and k is not None and k < 3] == [0]
    assert near_dedup.groups(docs.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in near_dedup.components(e).collect()}
    assert all(roots[i] == 0 for i in range(1, 41))
    assert roots[102] == roots[101] == 100


def test_urls(spark):
    pages = spark.createDataFrame([
        (1, "https://Example.COM/en/1?x", '<a href="https://bad.test/x">'), (2, "https://example.com/en/7a", None), (3, "http://sub.example.net/de/81", ""), (4, None, None), (5, "no scheme", "<a href='//hub.test/y'>"),
        (6, "http://a.net/de/?q://z/", '<a href="http://hub.test/">'), (7, "ftp://bad.test", '<a href="/self">'), (8, "http://xexample.org/es/", None), (9, "http://hub.test#f", None),
    ], "page_id long, url string, html string")
    by = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("example.com", "/en/1", "com/en/", "block")
    assert (by[2]["rule"], by[2]["verdict"]) == ("example.com/en/7", "allow")
    assert (by[3]["rule"], by[3]["verdict"]) == ("example.net/de/8", "block")
    assert (by[4]["host"], by[4]["path"], by[4]["rule"], by[4]["verdict"]) == ("", "", None, "allow")
    assert by[6]["rule"] == "net/de/"
    assert by[8]["rule"] == "org/es/"
    assert by[9]["trust"] > 0
    assert by[9]["verdict"] == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = shared_folder(spark, "test-ids")
    token_ids.write(docs, folder, path, 2)
    out = token_ids.read_digests(spark, folder).orderBy("start").collect()
    assert len(out) == docs.count()
    reader = Tokenizer.from_file(path)
    at = 0
    for r in out:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        ids = [*reader.encode(text or "", add_special_tokens=False).ids, 2]
        n = len(ids)
        assert (r["start"], r["n_tokens"]) == (at, n)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += n
    assert [r["doc_id"] for r in out[1:]] == sorted(r["doc_id"] for r in out[1:])


def test_words_as_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    draw = random.Random(3)
    signs = [*"abzABZ019 \t\n\r\x0b\x0c\x1c\x00\x7f\x85\xa0'’.,-<|>$éÉñßİıΣςÀ\u0301ﬁ漢🙂ª²ǆ\u200b", "'s", "'LL", "<|endoftext|>", " don't ", "''s", "<|", "'re"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(1500)]
    texts += ["It's 12 'stops' <|endoftext|>x ΣΑΣ don't!!'s é e\u0301 a\u00a0b", None, "", "İstanbul 漢字 🙂ok"]
    library, reader = Tokenizer.from_file(path), token_ids.Words(path)
    assert reader.by_piece
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for begin in (0, 700):
        ids, n = reader.encode(pa.array(texts[begin:], pa.string()))
        assert n.tolist() == [len(w) for w in want[begin:]]
        assert ids.tolist() == [i for w in want[begin:] for i in w]


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        own = json.load(f)
    own["normalizer"]["normalizers"].pop()
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(own, f)
    reader, texts = token_ids.Words(path), ["It IS a Test's", "", None, "é b"]
    assert not reader.by_piece
    ids, n = reader.encode(pa.array(texts, pa.string()))
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert (ids.tolist(), n.tolist()) == ([i for w in want for i in w], [len(w) for w in want])


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, BASE), (2, "q1 q2 q3 q4 q5 q6"), (3, None), (4, ""), (5, "a b c")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, items).collect()}
    assert found == {(0, 1), (1, 1), (2, 1), (8, 1), (6, 5), (7, 5)}
    assert decontamination.find(docs, items.limit(0)).count() == 0


def test_mixing(spark):
    rows = spark.createDataFrame([(i, "w " * (5 + i % 50), "abc"[i % 3] if i % 9 else None) for i in range(900)], "doc_id long, text string, source string")
    out = mixing.mix(rows).join(rows, "doc_id")
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("taken"), F.first("source_size").alias("s")).collect()
    total = sum(r["s"] for r in per)
    assert abs(sum(r["t"] for r in per) - 1.5 * total) < 1e-6 * total
    assert all(abs(r["taken"] - r["t"]) <= 55 and r["t"] <= 2 * r["s"] for r in per)
    assert out.where("taken > 2 * size").count() == 0
    assert mixing.mix(rows.limit(0)).count() == 0


def test_sharding(docs):
    out = sharding.assign(docs, limit=500).collect()
    assert len(out) == len(TEXTS) + 2
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["n_bytes"]
    members = Counter(r["shard"] for r in out)
    texts = {s: {r["text"] for r in out if r["shard"] == s} for s in members}
    assert all(n <= 500 or len(texts[s]) == 1 for s, n in sizes.items())
    names = sorted(members)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    assert "lang" in docs.columns


def test_classifier(spark):
    rows = spark.createDataFrame([(i, ("good plain words and more of them " * 3) if i % 4 else "bad### bad### x$$$ &&& " * 4) for i in range(80)] + [(80, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id long, quality int")
    out = quality_classifier.classify(rows, labels).collect()
    assert len(out) == 81
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in out if r["doc_id"] < 80)
    assert quality_classifier.classify(rows, labels.limit(0)).where("score = 0.7").count() == 81


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    draw = __import__("random").Random(3)
    text = lambda: " ".join("".join(draw.choices("aeioulnrst", k=5)) for _ in range(60)) + "."
    rows = [(i, text(), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s0", 1), (51, "### $$$ " * 40, "en", "s1", 1), (52, rows[0][1][:100] + " " + rows[5][1], "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {7, 50, 51, 52}
    assert {"shard", "depth", "n_bytes"} <= set(out.columns)


def brute_groups(texts):
    """(set size, component) of each text, by all pairs."""
    sets = []
    for t in texts:
        w = tokens(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))], links


@pytest.mark.parametrize("edges", [1 << 20, 0])
def test_near_duplicates_as_brute_force(spark, monkeypatch, edges):
    """Groups of copies that differ around the threshold, passages that many texts share, and texts of two passages."""
    monkeypatch.setattr(near_dedup, "EDGES", edges)
    draw = random.Random(11)
    fresh = lambda n: [f"z{draw.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        base, small = fresh(draw.choice([20, 60, 150])), fresh(8)
        for _ in range(30):
            w = list(base)
            for _ in range(draw.randint(1, max(2, len(base) // 20))):
                w[draw.randrange(len(w))] = draw.choice(small)
            texts.append(w[draw.randint(0, 3) :])
    passages = [fresh(40) for _ in range(6)]
    texts += [draw.choice(passages) + draw.choice(passages) + fresh(draw.randint(0, 12)) for _ in range(80)]
    texts += [fresh(draw.randint(1, 6)) for _ in range(20)] + [["a", "b"], ["A", "b"], []]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in near_dedup.groups(docs).collect()}
    sizes, roots, links = brute_groups(texts)
    assert links > 300
    assert [out[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [out[i]["component_id"] for i in range(len(texts))] == roots
    assert [i for i in range(len(texts)) if out[i]["kept"]] == sorted(set(roots))


def test_copies_of_one_text_meet_hubs_first(spark, monkeypatch):
    """Of 300 copies with zero to four changed words, those that the first hubs miss don't meet all the others."""
    draw = random.Random(3)
    texts = []
    for _ in range(300):
        w = [f"t{i}" for i in range(150)]
        for k in draw.sample(range(150), draw.randint(0, 4)):
            w[k] = f"x{draw.randrange(10**9)}"
        texts.append(" ".join(w))
    met, estimate = [], near_dedup._estimate

    def counted(pairs, classes, threshold):
        met.append(pairs.count())
        return estimate(pairs, classes, threshold)

    monkeypatch.setattr(near_dedup, "_estimate", counted)
    out = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [out[i] for i in range(300)] == brute_groups(texts)[1]
    assert sum(met) < 1500


def test_near_duplicates_by_small_plans(spark):
    """No step of the whole is one plan that a driver needs hundreds of MB for; the lists stay open, so every step runs."""
    draw = random.Random(5)
    texts = [" ".join(f"x{draw.randrange(10**9)}" if k in own else f"t{k}" for k in range(150)) for own in (set(draw.sample(range(150), draw.randint(0, 4))) for _ in range(200))]
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = ran().size()
    assert near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).count() == 200
    plans = [ran().apply(i).physicalPlanDescription() for i in range(before, ran().size())]
    trees = [p.split("\n\n\n")[0].split("== Initial Plan ==")[-1] for p in plans]
    assert len(trees) > 15
    assert max(t.count("Join") for t in trees) <= 5
