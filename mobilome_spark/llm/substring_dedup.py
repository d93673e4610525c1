"""Exact-substring dedup by Rabin-Karp hashes of every fixed-length word window.

A word counts by its 128-bit hash. The first half feeds a polynomial modulo the
prime 2**61 - 1 over the words of a window, the second half another one modulo
2**64; 61 bits of the one and three of the other stand for the window, and the
other's next bits choose its bucket, so two different windows meet with a chance
of 2**-64 over the number of buckets. Spark groups equal windows and
marks each that also starts in a document with a smaller doc_id. Marked windows
of a document merge into maximal intervals, which are removed.

What travels is one packed row per (group of documents, bucket): sorted hashes
as byte planes of their differences. A corpus has so many buckets that a task
holds one; where they outnumber what a group of documents (``GROUP_BYTES``) can
fill, windows go to ranges of buckets first and are packed again there, so that
the work for a window never depends on the size of the corpus. Windows that a
group holds more than once are settled inside the group, so that a passage in
very many documents sends one hash per group.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm.common import byte_column, groups_of_rows

WIDTH = 13
#: Bytes of text per bucket aimed at and per group of documents, buckets (or ranges of them) that a group sends to at most.
BUCKET_BYTES, GROUP_BYTES, MOST_BUCKETS = 12 << 20, 4 << 20, 4096
#: Words whose hashes a task remembers, windows hashed at a time, windows packed again at a time.
MEMORY, STEP, AGAIN = 1 << 20, 1 << 15, 4 << 20
#: The prime of the first polynomial, its base (below 2**31) and the second one's.
PRIME, BASE, ODD = (1 << 61) - 1, 0x5DEECE67, 0xD1342543DE82EF95
_NO_ID = (1 << 63) - 1
_P, _LOW30, _LOW31 = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


class Words(dict):
    """Numbers words as they come and keeps both halves of their 128-bit hashes."""

    def __init__(self):
        self.first, self.second = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        both = xxhash.xxh3_128_intdigest(word)
        self[word] = n = len(self.first)
        self.first.append((both >> 64) % PRIME)
        self.second.append(both & 0xFFFFFFFFFFFFFFFF)
        return n

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out = np.frombuffer(self.first, np.uint64)[at], np.frombuffer(self.second, np.uint64)[at]
        if len(self.first) > MEMORY:
            self.clear()
            self.first, self.second = array("Q"), array("Q")
        return out


def _folded(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times_base(x: np.ndarray) -> np.ndarray:
    """x * BASE modulo the prime, for x below it."""
    high = _folded((x >> np.uint64(30)) * np.uint64(BASE))  # below 2**62
    high = ((high & _LOW31) << np.uint64(30)) + (high >> np.uint64(31))  # times 2**30
    return _folded(high + (x & _LOW30) * np.uint64(BASE))


def window_hashes(first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number that chooses the bucket) of the windows that start at each word but the last width - 1."""
    n = len(first) - width + 1
    long, short = np.zeros(max(0, n), np.uint64), np.zeros(max(0, n), np.uint64)
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        h, g = first[a:b], second[a:b].copy()
        for k in range(1, width):
            h = _folded(times_base(h) + first[a + k : b + k])
            g = g * np.uint64(ODD) + second[a + k : b + k]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0x9E3779B97F4A7C15)
        long[a:b] = h | (g >> np.uint64(61)) << np.uint64(61)
        short[a:b] = g & _P
    return long, short


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, dtype: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(-1, n).T).view(dtype).ravel()


def encode(hashes: np.ndarray, docs: np.ndarray) -> bytes:
    """Pack (hash, doc_id) pairs that are sorted by hash."""
    known, which = np.unique(docs, return_inverse=True)
    kind = "<u2" if len(known) <= 1 << 16 else "<u4"
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    body = struct.pack("<II", len(hashes), len(known)) + _planes(np.diff(known, prepend=0).astype("<i8")) + _planes(steps) + _planes(which.ravel().astype(kind))
    return zstandard.compress(body, 1)


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.decompress(blob)
    n, k = struct.unpack_from("<II", body)
    at = 8 + 8 * k
    known = np.cumsum(_values(body[8:at], "<i8", k))
    hashes = np.cumsum(_values(body[at : at + 8 * n], "<u8", n), dtype=np.uint64)
    return hashes, known[_values(body[at + 8 * n :], "<u2" if k <= 1 << 16 else "<u4", n)]


SENT = "range bigint, bucket bigint, settled boolean, data binary"


def _packed(bucket: np.ndarray, h: np.ndarray, doc: np.ndarray, settled: bool, buckets: int, per: int) -> list[tuple]:
    """(range, bucket, settled, data) of pairs that are sorted by bucket and hash, a row
    for each bucket. Settled pairs only pass through: they are dealt out evenly."""
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = int(bucket[a])
        out.append(((own + int(doc[a])) % buckets // per if settled else own // per, own, settled, encode(h[a:b], doc[a:b])))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["range", "bucket", "settled", "data"])


def _sent(rows: DataFrame, buckets: int, per: int, width: int) -> DataFrame:
    """Packed windows, for each group of documents a row per range of ``per`` buckets; with
    several buckets to a range the bucket of a window that is not settled is found again from
    the number beside its hash, so such rows hold (hash, number, doc_id) in two parts."""

    def emit(batches):
        memory = Words()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            _, offsets = byte_column(batch.column(1))
            texts = batch.column(1)
            for first, last in groups_of_rows(offsets, GROUP_BYTES):
                words, counts = [], []
                for row in range(first, last):
                    own = texts[row].as_py().split()
                    words += own
                    counts.append(len(own))
                if len(words) < width:
                    continue
                row = np.repeat(np.arange(first, last), counts)
                h, g = window_hashes(*memory.hashes(words), width)
                inside = row[: len(h)] == row[width - 1 :]
                doc, h, g = ids[row[: len(h)][inside]], h[inside], g[inside]
                if not len(h):
                    continue
                bucket = (g % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((doc, h, bucket))
                doc, h, bucket = doc[order], h[order], bucket[order]
                fresh = np.ones(len(h), bool)  # the first of each (bucket, hash), which has the smallest document
                fresh[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
                least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                again = ~fresh & (doc > least)
                again[1:] &= (doc[1:] != doc[:-1]) | fresh[1:]  # once for each document
                if per == 1:
                    yield _batch(_packed(bucket[fresh], h[fresh], doc[fresh], False, buckets, 1) + _packed(bucket[again], h[again], doc[again], True, buckets, 1))
                    continue
                sent = []
                for own, settled in ((fresh, False), (again, True)):
                    part = bucket[own] // per
                    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        to = int(part[a]) if not settled else (int(part[a]) + int(doc[own][a])) % (-(-buckets // per))
                        held = np.sort(bucket[own][a:b], kind="stable")
                        sent.append((to, -1, settled, struct.pack("<I", b - a) + zstandard.compress(_planes(np.diff(held, prepend=0).astype("<i8")) + _planes(h[own][a:b].astype("<u8")) + _planes(doc[own][a:b].astype("<i8")), 1)))
                if sent:
                    yield _batch(sent)

    return rows.mapInArrow(emit, SENT)


def _packed_again(ranges: DataFrame, buckets: int, per: int) -> DataFrame:
    """Rows of ranges as rows of buckets, of as many windows at a time as memory allows."""

    def regroup(batches):
        held: dict[bool, list] = {False: [], True: []}
        size = 0

        def flush():
            out = []
            for settled, parts in held.items():
                if parts:
                    bucket, h, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.lexsort((h, bucket))
                    out += _packed(bucket[order], h[order], doc[order], settled, buckets, 1)
                parts.clear()
            return _batch(out)

        for batch in batches:
            for settled, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, body = struct.unpack_from("<I", data)[0], zstandard.decompress(data[4:])
                bucket = np.cumsum(_values(body[: 8 * n], "<i8", n))
                held[settled].append((bucket, _values(body[8 * n : 16 * n], "<u8", n), _values(body[16 * n :], "<i8", n)))
                size += n
                if size >= AGAIN:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return ranges.repartition("range").mapInArrow(regroup, SENT)


def _pairs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [decode(b) for b in blobs]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _judge(table: pa.Table) -> pa.Table:
    """(d, h, b): the windows of a bucket that start in a smaller document too, and settled ones."""
    bucket, settled = table.column("bucket").to_pylist(), table.column("settled").to_pylist()
    blobs = table.column("data").to_pylist()
    h, d = _pairs([b for b, s in zip(blobs, settled, strict=True) if not s])
    own = {b for b, s in zip(bucket, settled, strict=True) if not s}
    out = []
    if len(h):
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        again = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(h))))
        out.append((d[again], h[again], np.full(int(again.sum()), own.pop(), np.int64)))
    for b, s, data in zip(bucket, settled, blobs, strict=True):
        if s:
            h, d = decode(data)
            out.append((d, h, np.full(len(h), b, np.int64)))
    d, h, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(d, kind="stable")  # rows of a document stand together: the shuffle packs them better
    return pa.table({"d": pa.array(d[order]), "h": pa.array(h[order].view(np.int64)), "b": pa.array(b[order])})


def bucket_count(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(8, -(-size // BUCKET_BYTES))


def repeated_windows(rows: DataFrame, buckets: int, width: int = WIDTH) -> DataFrame:
    """(_id, windows): per document the (h, b) of its windows that start in a smaller one
    too, hash and bucket. ``rows``: (_id, text), neither of them null."""
    per = -(-buckets // MOST_BUCKETS)
    sent = _sent(rows, buckets, per, width)
    if per > 1:
        sent = _packed_again(sent, buckets, per)
    marked = sent.groupBy("range").applyInArrow(_judge, "d bigint, h bigint, b bigint")
    return marked.groupBy(F.col("d").alias("_id")).agg(F.collect_set(F.struct("h", "b")).alias("windows"))


def substring_dedup(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, intervals) of every row of ``documents``.

    Words are what ASCII white space separates, unchanged. A word is removed if
    a window of ``width`` consecutive words covers it whose word sequence also
    starts in a document with a smaller doc_id; windows are judged on the input.
    ``kept`` joins the other words by one space; ``intervals`` are the maximal
    removed ranges of word positions [from, to). Null and empty texts have no
    words. Rows that repeat a doc_id are one document for the others and don't
    remove from each other; a null doc_id is larger than all others. An empty
    table gives no rows.
    """
    rows = documents.select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("bigint").alias("_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    buckets = bucket_count(rows)
    marked = repeated_windows(rows, buckets, width)

    def squeeze(batches):
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], pa.array([press(t.as_py()) for t in batch.column(2)], pa.binary())], ["doc_id", "_key", "packed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    # the text travels packed: half of the bytes that a shuffle would otherwise write
    texts = documents.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).cast("bigint").alias("_key"), F.coalesce("text", F.lit("")).cast("binary"))
    texts = texts.mapInArrow(squeeze, f"doc_id {kind}, _key bigint, packed binary")
    joined = texts.join(marked, F.col("_key") == F.col("_id"), "left").select("doc_id", "packed", F.col("windows.h").alias("h"), F.col("windows.b").alias("b"))

    def remove(batches):
        open_, memory = zstandard.ZstdDecompressor().decompress, Words()
        for batch in batches:
            words_n, removed, kept, spans = [], [], [], []
            for packed, h, b in zip(*batch.columns[1:], strict=True):
                text = open_(packed.as_py())
                words = text.split()
                gone = np.zeros(len(words), bool)
                if h.is_valid and len(words) >= width:
                    long, short = window_hashes(*memory.hashes(words), width)
                    hit = _members(long, (short % np.uint64(buckets)).astype(np.int64), h.values.to_numpy().view(np.uint64), b.values.to_numpy())
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + width, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                words_n.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words if not len(change) else [w for w, g in zip(words, gone, strict=True) if not g]))
                spans.append([{"from": int(a), "to": int(b)} for a, b in change.reshape(-1, 2)])
            kinds = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kinds)], ["doc_id", "n_words", "n_removed", "kept", "intervals"])

    out = joined.mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary, intervals array<struct<from:bigint,to:bigint>>")
    return out.withColumn("kept", F.col("kept").cast("string"))


def _members(long: np.ndarray, bucket: np.ndarray, h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the windows whose hash and bucket are both among the pairs (h, b)."""
    kind = np.dtype([("h", np.uint64), ("b", np.int64)])
    own, lost = np.empty(len(long), kind), np.empty(len(h), kind)
    own["h"], own["b"], lost["h"], lost["b"] = long, bucket, h, b
    at = np.flatnonzero(np.isin(long, h))
    return at[np.isin(own[at], lost)]
