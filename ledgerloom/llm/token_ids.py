"""Token ids in binary files of shuffled bit or byte planes.

A file image holds a header, an index of chunks, an index of documents, and the chunks. A chunk is a block of CHUNK ids
(the last may be shorter) transposed into planes, bits or bytes from the lowest on, each compressed with zstandard and
stored with its length; planes of nothing but zeros take no space. So ids of a range of tokens are read by unpacking
only the chunks that the index names.

Spark sorts documents by range, each task tokenises its range and closes an image every IMAGE_IDS ids, and Spark's own
writer commits the images as rows (part, seq, ids, image) to the shared folder: a task that is lost is written again,
and nothing is taken from it twice. Reading needs the images alone.

The tokenizer drops white space and never joins across pieces (runs of letters, digits, other marks), so a text's ids are
those of its words' pieces in turn. Pieces without a known result are given to the library in bulk.

Defined cases: a null text is empty and has the end id alone; a null doc_id comes first; repeated rows each take their
own place, ordered by id, then a hash of the text; an empty table gives no images and an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm._base import SPACES, batch, slices, small_batches, text_bytes, words

MAGIC = b"PLN1"
CHUNK = 1 << 16
IMAGE_IDS = 1 << 20
CACHE = 700_000
# The rules of the tokenizer files whose words are cut into pieces here.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PIECE}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


def pack(ids: np.ndarray, bits: bool) -> bytes:
    """One chunk: number of planes, length of each, planes."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=3)
    if bits:
        planes = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1) for k in range(32)]
    else:
        planes = list(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T))
    packed = [zip_.compress(p.tobytes()) if p.any() else b"" for p in planes]
    return struct.pack(f"<B{len(packed)}I", len(packed), *map(len, packed)) + b"".join(packed)


def unpack(chunk: bytes, n: int) -> np.ndarray:
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    count = chunk[0]
    sizes = struct.unpack_from(f"<{count}I", chunk, 1)
    at, out = 1 + 4 * count, np.zeros(n, np.uint32)
    for k, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(unzip.decompress(chunk[at : at + size]), np.uint8)
            out |= (np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(k)) if count == 32 else plane.astype(np.uint32) << np.uint32(8 * k)
        at += size
    return out


def encode(ids: np.ndarray, docs: list[int | None], lengths: np.ndarray, bits: bool = False) -> bytes:
    """A file image."""
    chunks = [pack(ids[i : i + CHUNK], bits) for i in range(0, len(ids), CHUNK)]
    known = np.array([d is not None for d in docs], np.uint8)
    names = np.array([d or 0 for d in docs], "<i8")
    head = struct.pack("<4sQII", MAGIC, len(ids), len(chunks), len(docs))
    index = np.array([len(c) for c in chunks], "<u4").tobytes() + names.tobytes() + known.tobytes() + np.asarray(lengths, "<u4").tobytes()
    return head + index + b"".join(chunks)


def _index(image: bytes) -> tuple[int, np.ndarray, np.ndarray, list[int | None], np.ndarray]:
    magic, n, chunks, docs = struct.unpack_from("<4sQII", image)
    if magic != MAGIC:
        raise ValueError("not a file of token planes")
    at = struct.calcsize("<4sQII")
    sizes = np.frombuffer(image, "<u4", chunks, at).astype(np.int64)
    names = np.frombuffer(image, "<i8", docs, at := at + 4 * chunks)
    known = np.frombuffer(image, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(image, "<u4", docs, at := at + docs)
    places = at + 4 * docs + np.concatenate([[0], np.cumsum(sizes)])
    return n, places, sizes, [int(d) if k else None for d, k in zip(names, known, strict=True)], lengths.astype(np.int64)


def decode(image: bytes, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin to end of an image; only the chunks that hold them are unpacked."""
    n, places, sizes, _, _ = _index(image)
    end = n if end is None else min(end, n)
    parts = [unpack(image[places[k] : places[k] + sizes[k]], min(CHUNK, n - k * CHUNK)) for k in range(begin // CHUNK, -(-end // CHUNK))] if end > begin else []
    return np.concatenate(parts)[begin % CHUNK :][: end - begin] if parts else np.zeros(0, np.uint32)


def _kinds() -> np.ndarray:
    """Of each byte: white space, letter, digit, other mark, or one whose word is left to the slower rules."""
    kind = np.full(256, OTHER, np.uint8)
    kind[:33], kind[127:] = ODD, ODD
    kind[list(SPACES)] = SPACE
    kind[list(b"'")] = ODD
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    return kind


SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Ids of texts by their words' pieces, which are remembered up to a bound.

    Words of plain ASCII are cut into pieces on numpy, all words of a slice at once; words with an apostrophe, a special
    token or other letters one by one. A tokenizer with other rules than _RULES is given whole texts.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        special = all(t["content"].startswith("<|") and t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in own["added_tokens"])
        self.by_piece = special and own["model"].get("end_of_word_suffix") == "</w>" and {k: own[k] for k in _RULES} == _RULES
        self.piece = regex.compile(_PIECE)
        self.latin = regex.compile("[!-~\u00a1-\u024f]+").fullmatch
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Many pieces in one text; each ends with its only id that stands for a word's end."""
        groups = [new[i : i + 256] for i in range(0, len(new), 256)]
        for group, raw in zip(groups, self._plain([" ".join(g) for g in groups]), strict=True):
            ids = np.frombuffer(raw, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and (not len(ids) or ends[-1] == len(ids)):
                begin = 0
                for p, e in zip(group, ends.tolist(), strict=True):
                    self.pieces[p] = raw[4 * begin : 4 * e]
                    begin = e
            else:
                self.pieces.update(zip(group, self._plain(group), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Words that are not plain, by the pattern; the library's own rules of case and normal form are left to it beyond
        the Latin letters, and so are control characters."""
        simple = [w for w in words if self.latin(w) and "<|" not in w]
        split = [self.piece.findall((w if w.isascii() else unicodedata.normalize("NFC", w)).lower()) for w in simple]
        self._learn(list({p for ps in split for p in ps} - self.pieces.keys()))
        by_pieces = {w: b"".join(self.pieces[p] for p in ps) for w, ps in zip(simple, split, strict=True)}
        other = [w for w in words if w not in by_pieces]
        self.pieces.update(zip(other, self._plain(other), strict=True))
        self.pieces.update(by_pieces)

    def of(self, units: list[str]) -> list[bytes]:
        """Ids of each distinct piece or word."""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        new = [u for u in units if u not in self.pieces]
        odd = [u for u in new if not (u.isascii() and u.isprintable()) or "'" in u or "<|" in u]
        self._learn(list(set(new).difference(odd)))
        self._learn_words(odd)
        return list(map(self.pieces.__getitem__, units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each text."""
        if not self.by_piece:
            raw = self._plain([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(raw), np.uint32), np.array([len(r) // 4 for r in raw], np.int64)
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        begin, end, _ = words(data, offsets)
        kind = _KIND[data]
        odd = kind == ODD
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        seen = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
        whole = seen[end] > seen[begin]
        step = np.zeros(len(data) + 1, np.int8)
        step[begin[whole]] += 1
        step[end[whole]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        # Where a piece begins: at a word's begin, and within plain words where the kind changes and at each digit.
        new = kind == DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        new &= ~inside
        new[begin] = True
        held = kind != SPACE
        new &= held
        at, low = np.flatnonzero(new), np.where(inside, data, _LOWER[data])[held]
        cuts = np.append(np.flatnonzero(new[held]), len(low)).astype(np.int32)
        units = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(cuts), pa.py_buffer(low)]).dictionary_encode()
        codes = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = self.of(units.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, first = np.frombuffer(b"".join(known), np.uint32), np.cumsum(size) - size
        n = size[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[codes] - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(at, offsets)])


_IMAGE = [("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("image", pa.binary())]


@functools.lru_cache(maxsize=1)
def _known(path: str) -> Words:
    """A worker's tasks share one tokenizer and what it has learned."""
    return Words(path)


def _images(path: str, end_id: int, bits: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, part, seq = _known(path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal held, docs, lengths, total, seq
            image = encode(np.concatenate(held), docs, np.concatenate(lengths), bits)
            row = batch(_IMAGE, [[part], [seq], [total], [image]])
            held, docs, lengths, total, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            texts = b.column(1)
            for i, j in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 4 << 20):
                ids, n = reader.encode(texts.slice(i, j - i))
                # The end id after each document.
                whole = np.full(len(ids) + j - i, end_id, np.uint32)
                place = np.ones(len(whole), bool)
                place[np.cumsum(n + 1) - 1] = False
                whole[place] = ids
                held.append(whole)
                docs.extend(b.column(0).slice(i, j - i).to_pylist())
                lengths.append(n + 1)
                total += len(whole)
                if total >= IMAGE_IDS:
                    yield close()
        if docs:
            yield close()

    return f


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", bits: bool = False) -> None:
    """Writes images of all documents to the table at path, in ascending order of ids by (part, seq)."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("_h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ordered.select("doc_id", "text").mapInArrow(_images(tokenizer, end_id, bits), "part int, seq int, n_ids long, image binary").write.parquet(path)


_DOC = [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, image in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            _, _, _, docs, n = _index(image)
            ids = decode(image).astype("<u4").tobytes()
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield batch(_DOC, [[part] * len(docs), [seq] * len(docs), docs, ends - n, n, crc])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the images alone."""
    images = spark.read.schema("part int, seq int, n_ids long, image binary").parquet(path)
    sizes = images.select("part", "seq", "n_ids")
    # One row a task of the writer, then one a image within a task.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    local = sizes.withColumn("skip", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    places = local.join(parts, "part").select("part", "seq", (F.col("base") + F.col("skip")).alias("base"))
    docs = images.select("part", "seq", "image").mapInArrow(_digests, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
