"""Incremental line dedup: exact reference counts behind sharded cuckoo filters.

``LineIndex`` keeps, in a folder that all executors share,

* ``refs``: one row per (line key, document) that holds the line, in runs: an
  insertion or a deletion writes what it adds or takes away as one more run,
* ``frequent``: the exact count of documents, and the largest of them, of every
  key that stands in enough documents to be dropped, and
* ``filters``: for each shard of the key space a cuckoo filter of those keys.

Deleting documents makes counts fall again and lines come back: every step is
reversible. A change counts anew only the keys that it touches: those that
crossed the threshold are inserted into or deleted from the filters of their
shards. ``LineIndex.open`` finds an index again by its folder.

Documents are cleaned by sending each line's key to the filter of its shard;
only keys that it lets through meet the exact counts, which also remove the
filter's false positives. Filters never leave their shard, at any size.

A key is the pair of 64-bit halves of the MD5 of the line without white space
at both ends and with A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilome_spark.llm.common import SPACES, join_counted, materialize, scratch_dir
from mobilome_spark.llm.cuckoo import CuckooFilter

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIN_LENGTH, MIN_DOCS = 40, 5
#: Keys of a shard's filter and lines that a task asks it about, about; runs after which the references are written anew.
SHARD_KEYS, ASKED, RUNS = 1 << 18, 1 << 19, 16
_CONTINUATION = re.compile(rb"[\x80-\xBF]")


def line_keys(text: bytes, min_length: int = MIN_LENGTH) -> list[bytes | None]:
    """The 16-byte key of each line, None for lines that are too short to count."""
    out, digest = [], hashlib.md5
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(SPACES)
        n = len(key)
        if n >= min_length and not key.isascii():
            n -= len(_CONTINUATION.findall(key))
        out.append(digest(key).digest() if n >= min_length else None)
    return out


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0], both[:, 1]


def line_refs(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(k1, k2, doc_id): each document's distinct countable lines."""

    def emit(batches):
        for batch in batches:
            ids, rows, keys = batch.column(0), [], []
            for row, text in enumerate(batch.column(1)):
                own = {k for k in line_keys(text.as_py() or b"", min_length) if k is not None}
                rows += [row] * len(own)
                keys += own
                if len(keys) > 1 << 17 or row == len(ids) - 1:
                    k1, k2 = _halves(keys)
                    yield pa.record_batch([pa.array(k1), pa.array(k2), ids.take(pa.array(rows, pa.int64()))], ["k1", "k2", "doc_id"])
                    rows, keys = [], []

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(emit, f"k1 bigint, k2 bigint, doc_id {kind}")


class LineIndex:
    """Reference counts of lines in a folder, with cuckoo filters in front.

    ``insert`` and ``delete`` change the index; ``counts`` are exact at any time.
    A document is known by its doc_id: inserting one that is present adds the
    lines it didn't have; deleting one that is absent does nothing. Null and
    empty texts have one empty line, which never counts. A new index holds no
    lines: all lines stay.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, doc_id: str = "bigint"):
        self.spark, self.min_docs, self.min_length, self.doc_id = spark, min_docs, min_length, doc_id
        self.folder, self.version = scratch_dir(spark, "line-index"), 0
        self.state: dict = {"runs": [], "frequent": None, "filters": None, "shards": 1}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index that ``folder`` holds, as its last change left it."""
        held = [json.loads(r.value) for r in spark.read.text(f"{folder}/versions/*").collect()]  # a line for each change
        last = max(held, key=lambda x: x["version"])
        out = cls(spark, last["min_docs"], last["min_length"], last["doc_id"])
        out.folder, out.version, out.state = folder, last["version"], last["state"]
        return out

    def _table(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema) if path is None else self.spark.read.schema(schema).parquet(path)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{self.version}"
        df.write.parquet(path)
        return path

    @property
    def refs(self) -> DataFrame:
        """(k1, k2, doc_id) of all lines held; the same row may come twice."""
        out, kind = self._table(None, f"k1 bigint, k2 bigint, doc_id {self.doc_id}"), f"k1 bigint, k2 bigint, doc_id {self.doc_id}"
        for n, (sign, path) in enumerate(self.state["runs"]):
            run = self._table(path, kind if sign > 0 else f"doc_id {self.doc_id}")
            out = run if not n and sign > 0 else out.unionByName(run) if sign > 0 else out.join(run, "doc_id", "left_anti").select("k1", "k2", "doc_id")
        return out

    @property
    def frequent(self) -> DataFrame:
        """(k1, k2, _n, last): keys that stand in enough documents, their number and the largest."""
        return self._table(self.state["frequent"], f"k1 bigint, k2 bigint, _n bigint, last {self.doc_id}")

    @property
    def filters(self) -> DataFrame:
        return self._table(self.state["filters"], "shard int, filter binary")

    def insert(self, documents: DataFrame) -> LineIndex:
        if not self.state["runs"]:
            self.doc_id = documents.schema["doc_id"].dataType.simpleString()
        self.version += 1
        path = self._write(line_refs(documents, self.min_length), "refs")
        before = bool(self.state["runs"])
        self.state["runs"].append((1, path))
        self._settle(self.spark.read.parquet(path).select("k1", "k2") if before else None)
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        if not self.state["runs"]:
            return self
        self.version += 1
        path = self._write(doc_ids.select(F.col("doc_id").cast(self.doc_id).alias("doc_id")).distinct(), "gone")
        touched = materialize(self.refs.join(self.spark.read.parquet(path), "doc_id", "left_semi").select("k1", "k2").distinct(), "line-touched")
        self.state["runs"].append((-1, path))
        self._settle(touched)
        return self

    def counts(self, touched: DataFrame | None = None) -> DataFrame:
        """(k1, k2, n_docs, last): exact number of documents of each key and the largest."""
        rows = self.refs if touched is None else self.refs.join(touched.distinct(), ["k1", "k2"], "left_semi")
        # a document that is given twice counts once: its rows are equal
        per_doc = rows.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("_one"))
        return per_doc.groupBy("k1", "k2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last"))

    def _settle(self, touched: DataFrame | None) -> None:
        """Counts of the keys that a change touched (None: all), filters of their shards, and the state's version."""
        found = self.counts(touched).filter(F.col("n_docs") >= self.min_docs).select("k1", "k2", F.col("n_docs").alias("_n"), "last")
        old, held, shards = self.frequent, self.filters, self.state["shards"]
        if touched is not None:
            found = old.join(touched.distinct(), ["k1", "k2"], "left_anti").unionByName(found)
        self.state["frequent"] = self._write(found, "frequent")
        n = self.frequent.count()
        self.state["shards"] = 1 << max(0, -(-n // SHARD_KEYS) - 1).bit_length()
        shard = F.pmod(F.col("k2"), F.lit(self.state["shards"])).cast("int")
        if touched is None or self.state["shards"] != shards:
            keys = self.frequent.select(shard.alias("shard"), "k1")
            made = keys.groupBy("shard").applyInArrow(_build, "shard int, filter binary")
        else:
            now, was = self.frequent.select("k1", "k2"), old.select("k1", "k2")
            new = now.join(was, ["k1", "k2"], "left_anti").select(shard.alias("shard"), "k1", F.lit(1).alias("sign"))
            gone = was.join(now, ["k1", "k2"], "left_anti").select(shard.alias("shard"), "k1", F.lit(-1).alias("sign"))
            changes = materialize(new.unionByName(gone), "line-changes")
            # a filter that gets too full is built anew from its keys; shards without changes keep theirs
            stay = held.join(changes.select("shard").distinct(), "shard", "left_anti")
            moved = self.filters.join(changes.select("shard").distinct(), "shard", "left_semi")
            keys = self.frequent.select(shard.alias("shard"), "k1", F.lit(0).alias("sign")).join(changes.select("shard").distinct(), "shard", "left_semi")
            parts = changes.unionByName(keys).groupBy("shard")
            made = stay.unionByName(moved.groupBy("shard").cogroup(parts).applyInArrow(_change, "shard int, filter binary"))
        self.state["filters"] = self._write(made, "filters")
        if len(self.state["runs"]) > RUNS:
            self.state["runs"] = [(1, self._write(self.refs.distinct(), "all-refs"))]
        row = {"version": self.version, "min_docs": self.min_docs, "min_length": self.min_length, "doc_id": self.doc_id, "state": self.state}
        self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.text(f"{self.folder}/versions/{self.version}")

    def dropped(self, refs: DataFrame) -> DataFrame:
        """(doc_id, keys): for documents that lose lines, the 16-byte keys of those.

        ``refs``: (k1, k2, doc_id) of the documents, as ``line_refs`` gives them."""
        shards, n = self.state["shards"], refs.count()
        parts = max(1, n // (ASKED * shards))  # a shard's lines may be many, one line in most documents: each part asks a copy of the filter
        shard = F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")
        asked = refs.select(shard, F.pmod(F.xxhash64("doc_id", "k1"), F.lit(parts)).cast("int").alias("part"), "k1", "k2", "doc_id").groupBy("shard", "part")
        copied = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter").groupBy("shard", "part")
        maybe = asked.cogroup(copied).applyInArrow(_probe, f"k1 bigint, k2 bigint, doc_id {self.doc_id}")
        lost = join_counted(materialize(maybe, "line-maybe"), self.frequent, ["k1", "k2"], n).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))

    def clean(self, documents: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """``documents`` without ``text`` as struct ``_row``, and ``_kept`` (the text
        that stays, null for a null text), ``_n_lines`` and ``_n_dropped``.

        ``refs``: their lines, where they are at hand."""
        lost = self.dropped(materialize(line_refs(documents, self.min_length), "line-asked") if refs is None else refs).select(F.col("doc_id").alias("_id"), "keys")
        rest = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"])
        rows = documents.select(rest.alias("_row"), F.col("text").alias("_text"))
        joined = rows.join(lost, F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
        least = self.min_length

        def strip(batches):
            for batch in batches:
                kept, lines, gone = [], [], []
                for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                    text, lost = text.as_py(), lost.as_py()
                    every = (text or b"").split(b"\n")
                    stay = every
                    if lost:
                        out = {k["k1"].to_bytes(8, "big", signed=True) + k["k2"].to_bytes(8, "big", signed=True) for k in lost}
                        stay = [x for x, k in zip(every, line_keys(text, least), strict=True) if k not in out]
                    kept.append(None if text is None else text if stay is every else b"\n".join(stay))
                    lines.append(len(every))
                    gone.append(len(every) - len(stay))
                yield pa.record_batch([batch.column(0), pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["_row", "_kept", "_n_lines", "_n_dropped"])

        kind = rows.schema["_row"].dataType.simpleString()
        out = joined.select("_row", F.col("_text").cast("binary"), "keys").mapInArrow(strip, f"_row {kind}, _kept binary, _n_lines bigint, _n_dropped bigint")
        return out.withColumn("_kept", F.col("_kept").cast("string"))


def _build(table: pa.Table) -> pa.Table:
    keys = table.column("k1").to_numpy()
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.build(keys).to_bytes()], pa.binary())})


def _change(held: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its keys changed (signs 1 and -1); all its keys come with sign 0, for a filter built anew."""
    shard = (held if len(held) else changes).column("shard")[0].as_py()
    filters = [x for x in held.column("filter").to_pylist() if x is not None]
    kept = CuckooFilter.from_bytes(filters[0]) if filters else CuckooFilter(4)
    keys, sign = changes.column("k1").to_numpy(), changes.column("sign").to_numpy()
    kept.delete(keys[sign < 0])
    new = keys[sign > 0]
    if np.count_nonzero(kept.slots) + len(new) > 0.9 * kept.slots.size or not kept.insert(new):
        kept = CuckooFilter.build(keys[sign == 0])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([kept.to_bytes()], pa.binary())})


def _probe(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The lines that their shard's filter may hold."""
    rows = asked.select(["k1", "k2", "doc_id"])
    if not len(asked) or not len(filters):
        return rows.slice(0, 0)
    return rows.filter(pa.array(CuckooFilter.from_bytes(filters.column("filter")[0].as_py()).contains(rows.column("k1").to_numpy())))


def line_dedup(documents: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """``_row`` (columns but the text), ``_kept``, ``_n_lines`` and ``_n_dropped`` of each row.

    A text is split at line feeds (null or empty: one empty line). Keys of at
    least ``min_length`` code points found in at least ``min_docs`` documents
    lose all their lines except in the largest doc_id that holds them. Shorter
    lines always stay. Repeated rows count as one document and are all cleaned
    alike; a document with a null doc_id is cleaned but doesn't count. An empty
    table gives no rows.
    """
    index = LineIndex(documents.sparkSession, min_docs, min_length).insert(documents)
    return index.clean(documents, index.refs)


def cleaned_documents(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with their cleaned texts; ``n_chars``, if present, follows.

    A null text stays null.
    """
    out = line_dedup(documents, **options)
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("bigint")}
    return out.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in documents.columns])
