"""Near-duplicate documents by bottom-k sketches of one hash function.

Each document's set of shingles gives a sketch: its k smallest hashes. Documents with one set are one class from the
start. Inverted lists of the sketch values bring classes together; the union sketch of a pair estimates its similarity
and drops hopeless pairs; the rest is verified on the full sets.

How no list is expanded into all its pairs: with similarity t or more, the number of common sketch values is at least
the number of the union's k smallest that both have, about t * k. A pair that matters shares SHARED values or more
(the chance of fewer is under 1e-7 at t = 0.75), so it shares one of each one's k - SHARED + 1 rarest values, and
frequent values (boilerplate) are never followed. Each list's members are held against one hub, the member whose values
are the most common, and verified links are contracted. Lists that still have several components are worked again with
sketches of k = n, the whole sets: there the bound on common values is exact, so the prefixes are short (see _whole_lists),
and what is of one component already isn't held against itself; whoever is linked with the hub of one of these lists, its
most template-like member, isn't held against the rest of the hub's component either.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; a null
doc_id counts as the smallest; rows with one id, or with none, are compared each by itself, and of equal ones a single row
is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import NO_DOC, Prefix, batch, by_row, byte_codes, cut, keep, release, slices, small_batches, sweep, text_bytes, words

SHINGLE = 5
K = 40
SHARED = 14
THRESHOLD = (75, 100)
#: A graph of at most so many edges is settled in one task, a larger one in rounds.
EDGES = 1 << 20
#: Up to so many components with new roots are sent to every executor; more are joined by key.
FEW = 100_000
#: Sizes within this factor share a bucket.
STEP = 1.03


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and where each row's begin (one more than rows)."""
    begin, end, rows = words(data, offsets)
    # ASCII capitals count as small letters.
    sums = Prefix(Prefix(byte_codes(data, lower=True)).of(begin, end))
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    h = sums.of(first, np.minimum(first + size, rows[1:][row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))]).astype(np.int64)


_SKETCH = [("doc", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.list_(pa.int64()))]


def _sketches(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for i, j in slices(np.diff(offsets)):
                h, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at)
                digests = b"".join(hashlib.blake2b(h[x:y], digest_size=16).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                names = np.frombuffer(digests, np.int64).reshape(-1, 2)
                few = np.minimum(n, k)
                row = np.repeat(np.arange(j - i), few)
                pick = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(few) - few, few)
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32)), pa.array(h[pick].view(np.int64)))
                yield batch(_SKETCH, [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), n, names[:, 0], names[:, 1], sketch])

    return f


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc, id, n (set size), s1 and s2 (a 128-bit digest of the whole set), sketch: one row per row of docs (doc, id, text)."""
    return docs.mapInArrow(_sketches(k), "doc long, id long, n long, s1 long, s2 long, sketch array<long>")


_ROOT = [("node", pa.int64()), ("root", pa.int64())]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all edges (a, b) with the smallest node it reaches."""
    parts = [np.stack([b.column(k).to_numpy() for k in range(2)]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    yield batch(_ROOT, [nodes, nodes[root]])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the smallest node it reaches.

    Up to EDGES edges, by a count, one task has room for the graph. Beyond, large and small stars alternate: each round is
    two joins whose right sides have one row a node; hubs are left to Spark's skew join.
    """
    if edges.count() <= EDGES:
        return cut(edges.select("a", "b").coalesce(1).mapInArrow(_settled, "node long, root long"))
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.distinct())
        sums = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = sums(new) == sums(e)
        release(e)
        e = new
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


_LINK = [("a", pa.int64()), ("b", pa.int64())]


def _verify(threshold: tuple[int, int]):
    """Pairs of texts whose full sets are similar enough."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ta, oa = text_bytes(b.column(2))
            tb, ob = text_bytes(b.column(3))
            for i, j in slices(np.diff(oa) + np.diff(ob)):
                ha, pa_ = shingle_sets(ta[oa[i] : oa[j]], oa[i : j + 1] - oa[i])
                hb, pb = shingle_sets(tb[ob[i] : ob[j]], ob[i : j + 1] - ob[i])
                na, nb, good = np.diff(pa_), np.diff(pb), []
                for k in range(j - i):
                    both = len(np.intersect1d(ha[pa_[k] : pa_[k + 1]], hb[pb[k] : pb[k + 1]], assume_unique=True))
                    good.append(threshold[1] * both >= threshold[0] * (na[k] + nb[k] - both) and both > 0)
                keep = pa.array(good)
                yield batch(_LINK, [b.column(0).slice(i, j - i).filter(keep), b.column(1).slice(i, j - i).filter(keep)])

    return f


def _unsigned(x):
    """Order of 64-bit hashes as they were sorted: as unsigned numbers."""
    return x.bitwiseXOR(F.lit(NO_DOC))


def _estimate(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Drops pairs that can't be similar by size, or whose union sketch says so beyond doubt. A union sketch that isn't
    full holds both whole sets, so it is exact."""
    own = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    p = pairs.join(own("a"), "a").join(own("b"), "b")
    p = p.where(threshold[1] * F.least("na", "nb") >= threshold[0] * F.greatest("na", "nb"))
    p = p.select("a", "b", F.transform("sa", _unsigned).alias("sa"), F.transform("sb", _unsigned).alias("sb"))
    p = p.select("a", "b", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K).alias("su"), F.array_intersect("sa", "sb").alias("si"))
    shared, size = F.size(F.array_intersect("su", "si")), F.size("su")
    return p.where(F.when(size < K, threshold[1] * shared >= threshold[0] * size).otherwise(shared >= SHARED)).select("a", "b")


def _held(classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(doc, n, common, vs): each class with its rarest sketch values, as many as a similar class can't all miss, and how
    common its values are altogether.

    A set of n needs min(SHARED, t * n) common values; values that no other class has are the rarest and drop out.
    """
    values = classes.select("doc", "n", F.explode("sketch").alias("v"))
    counted = values.join(values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "v")
    # Bounded by K values a class.
    held = counted.groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("r"))
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * threshold[0] / threshold[1])).cast("int")
    held = held.where(F.size("r") >= need)
    common = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.log2(x["c"])) / F.least("n", F.lit(K))
    return held.select("doc", "n", common.alias("common"), F.transform(F.slice("r", F.lit(1), F.size("r") - need + 1), lambda x: x["v"]).alias("vs"))


def links(docs: DataFrame, classes: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Components (node, root) of the similarity graph between classes (doc, n, sketch); docs has their texts."""
    held = cut(_held(classes, threshold))
    lists = held.select("doc", "n", "common", F.explode("vs").alias("v"))
    texts = keep(docs.join(held.select("doc"), "doc", "left_semi"))
    known = classes.join(held.select("doc"), "doc", "left_semi")
    sweep(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        # Written between the steps: a plan of all of them at once took hundreds of MB of the driver while it ran.
        met = keep(pairs)
        near = keep(_estimate(met, known, threshold))
        release(met)
        one = near.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
        two = one.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
        good = cut(two.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a long, b long"))
        release(near)
        return good

    hub = lists.groupBy("v").agg(F.max(F.struct("common", "doc")).alias("h"))
    found = verified(lists.join(hub, "v").where(F.col("doc") != F.col("h.doc")).select(F.least("doc", "h.doc").alias("a"), F.greatest("doc", "h.doc").alias("b")).distinct())
    roots = components(found)
    named = lists.join(roots, lists.doc == roots.node, "left").select("doc", "n", "v", F.coalesce("root", "doc").alias("root"))
    mixed = named.groupBy("v").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("v")
    sweep(docs.sparkSession)
    still_open = cut(named.join(mixed, "v").select("doc", "n", "root").distinct())
    if not still_open.isEmpty():
        keys = keep(_whole_lists(texts, still_open, threshold))
        sweep(docs.sparkSession)
        # What is linked with a hub of its lists needn't meet the rest of the hub's component.
        found = found.unionByName(verified(_to_hubs(keys, threshold)))
        sweep(docs.sparkSession)
        mixed = keep(_mixed(_renamed(keys, components(found))))
        release(keys)
        sweep(docs.sparkSession)
        more = verified(_across(mixed, threshold))
        release(mixed)
        sweep(docs.sparkSession)
        roots = components(found.unionByName(more))
    release(held, texts, still_open)
    return roots


def _whole_lists(texts: DataFrame, members: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(s, b1, b2, own, doc, n, root, place, common): members (doc, n, root) under the shingles that a similar set of another
    component can't all miss.

    Two sets of sizes m and n need o = t / (1 + t) * (m + n) shingles in common, so of one order from rare to frequent
    their first m - o + 1 and n - o + 1 share one. Sizes are grouped into narrow buckets, and a set stands in the lists
    of each bucket pair with the prefix that this pair of sizes asks for. Shingles of one set alone fill its prefix
    first, so copies that each differ in much of their own meet nobody, however many there are. place is the shingle's
    place in its set's order, by which _across holds each pair to the prefix that its two sizes ask for; common is how common
    the set's shingles are altogether.
    """
    rows = texts.join(members.select("doc"), "doc").select("doc", "text").mapInArrow(_shingle_rows, "doc long, s long")
    counts = rows.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    # Bounded by the document's own length.
    ordered = rows.join(counts, "s").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("r")).join(members, "doc")
    ordered = ordered.withColumn("common", F.aggregate("r", F.lit(0.0), lambda a, x: a + F.log2(x["c"])) / F.col("n"))
    share = threshold[0] / (threshold[0] + threshold[1])
    bucket = lambda n: F.floor(F.log(n) / F.log(F.lit(STEP))).cast("int")
    low, high = F.ceil(F.col("n") * threshold[0] / threshold[1]), F.floor(F.col("n") * threshold[1] / threshold[0])
    each = ordered.withColumn("own", bucket(F.col("n"))).withColumn("other", F.explode(F.sequence(bucket(low.cast("double")), bucket(high.cast("double")))))
    need = F.ceil((F.col("n") + F.floor(F.pow(F.lit(STEP), F.col("other")))) * share - 1e-6)
    unique = F.col("n") - F.size("r")
    each = each.withColumn("take", (F.col("n") - need + 1 - unique).cast("int")).where("take > 0")
    keys = each.select("doc", "n", "root", "own", "common", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), unique.alias("alone"), F.posexplode(F.slice("r", F.lit(1), F.col("take"))).alias("i", "r"))
    return keys.select(F.col("r.s").alias("s"), "b1", "b2", "own", "doc", "n", "root", (F.col("alone") + F.col("i")).alias("place"), "common")


def _alike(threshold: tuple[int, int]):
    """Whether sets of sizes na and nb can be similar."""
    return threshold[1] * F.least("na", "nb") >= threshold[0] * F.greatest("na", "nb")


def _to_hubs(keys: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of a set and the hub of a list it is in, of different components: no more than a row of keys each.

    A hub is the list's member whose shingles are the most common. Of copies with changes of their own it is the least
    changed one, which is similar to more of them than any other. Lists are those of the sets' own buckets, whatever the hub's.
    """
    own = keys.where("b1 = b2").select("s", "doc", F.col("n").alias("na"), "root", "common")
    hub = own.groupBy("s").agg(F.max(F.struct("common", "doc", "root", "na")).alias("h"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    hub = hub.select("s", F.col("h.doc").alias("hub"), F.col("h.root").alias("rb"), F.col("h.na").alias("nb"))
    pairs = own.join(hub, "s").where((F.col("root") != F.col("rb")) & _alike(threshold))
    return pairs.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def _renamed(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """keys with the roots that their components have now."""
    new = roots.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_new"))
    new = F.broadcast(new) if new.count() <= FEW else new
    return keys.join(new, "root", "left").withColumn("root", F.coalesce("_new", "root")).drop("_new")


def _mixed(keys: DataFrame) -> DataFrame:
    """keys of lists with sets of several components, with out: whether a set isn't of the list's largest component."""
    at = ["s", "b1", "b2"]
    main = keys.groupBy(*at, "root").count().groupBy(*at).agg(F.max_by("root", "count").alias("main"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    return keys.join(main.select(*at, "main"), at).select(*at, "own", "doc", "n", "root", "place", (F.col("root") != F.col("main")).alias("out"))


def _across(mixed: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that meet in a list of mixed and are of different components.

    The smaller bucket's sets meet the larger one's, never each other, under the prefix for both sizes. Of a list's
    largest component the members meet the others alone: the tag 0 brings them together, 1 all the rest.
    """
    at = ["s", "b1", "b2"]
    left = mixed.where("own = b1").select(*at, F.col("out").cast("int").alias("tag"), F.col("doc").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("place").alias("pa"))
    tags = F.when(F.col("out"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    right = mixed.where("own = b2").select(*at, F.explode(tags).alias("tag"), F.col("doc").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    both = sum(threshold)
    need = F.floor((threshold[0] * (F.col("na") + F.col("nb")) + both - 1) / both)
    held = (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)
    pairs = left.join(right, [*at, "tag"]).where((F.col("ra") != F.col("rb")) & ((F.col("b1") < F.col("b2")) | (F.col("a") < F.col("b"))) & _alike(threshold) & held)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        doc = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in slices(np.diff(offsets)):
            h, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch([("doc", pa.int64()), ("s", pa.int64())], [np.repeat(doc[i:j], np.diff(at)), h.view(np.int64)])


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept, a row for each row of docs; with row,
    a column that no two rows share, that too.

    A class of equal sets is named by a row of its smallest id, and of a component one row of the smallest id is kept.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(*([F.col(f"`{row}`").cast("long").alias("row")] if row else []), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_DOC)).alias("id"), F.col(f"`{text}`").alias("text"))
    plain = (plain if row else by_row(plain, "id")).select(F.col("row").alias("doc"), "id", "text")
    every = cut(sketches(plain))
    sets = ["n", "s1", "s2"]
    filled = every.where("n > 0")
    named = cut(filled.groupBy(*sets).agg(F.min("id").alias("low"), F.min_by(F.struct("doc", "sketch"), F.struct("id", "doc")).alias("first")).select(*sets, "low", F.col("first.doc").alias("rep"), F.col("first.sketch").alias("sketch")))
    classes = named.select(F.col("rep").alias("doc"), "n", "sketch")
    roots = links(plain.select("doc", "text"), classes, threshold)
    # A root is the smallest row; the smallest id is found among classes, which are fewer than rows.
    member = named.drop("sketch").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    first = member.groupBy("root").agg(F.min(F.struct("low", "rep")).alias("first"))
    member = member.join(first, "root").select(*sets, F.col("first.low").alias("component"), F.col("first.rep").alias("stays"))
    out = every.select("doc", "id", *sets).join(member, sets, "left")
    real = lambda c: F.when(c != NO_DOC, c)
    return out.select(*([F.col("doc").alias(row)] if row else []), real(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "id")).alias("component_id"), (F.col("doc") == F.coalesce("stays", "doc")).alias("kept"))
