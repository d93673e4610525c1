"""Media columns: texts stored as AVI motion-JPEG, read back and cut into shots.

``encode`` turns each text into a media column; ``clips`` parses that column's
RIFF index, decodes the frames to luma samples and finds shots: a frame starts a
new shot where its histogram differs from the one before by more than the mean and two
deviations of the differences so far (and at least ``FLOOR``).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm import avi

BINS, FLOOR, SPREAD = 32, 0.25, 2.0


def pad(text: bytes) -> bytes:
    """``text`` and zero bytes up to a positive multiple of 64."""
    return text + b"\x00" * (max(64, -(-len(text) // 64) * 64) - len(text))


def encode(documents: DataFrame) -> DataFrame:
    """(doc_id, media): every whole text as an AVI file; null texts are empty."""

    def store(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                made = [avi.encode(pad(t.as_py()), len(t.as_py())) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(made, pa.binary())], ["doc_id", "media"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(store, f"doc_id {kind}, media binary")


def histograms(planes: list[np.ndarray]) -> np.ndarray:
    """(frames, BINS) shares of luma values."""
    out = [np.bincount(p.ravel() >> 3, minlength=BINS) / max(1, p.size) for p in planes]
    return np.array(out).reshape(len(planes), BINS)


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """[first, last) frame ranges: cuts where the histograms' difference stands out."""
    cuts, n, mean, square = [0], 0, 0.0, 0.0
    steps = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2 if len(hist) > 1 else []
    for k, d in enumerate(np.asarray(steps).tolist(), 1):
        if d > max(FLOOR, mean + SPREAD * max(0.0, square - mean * mean) ** 0.5):
            cuts.append(k)
        n += 1
        mean, square = mean + (d - mean) / n, square + (d * d - square) / n
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True)) if len(hist) else []


def read(media: bytes) -> tuple[bytes, int, list[dict], np.ndarray]:
    """(payload, unpadded length, clips, mean histogram) of a stored file; what is not one raises ValueError."""
    held = avi.parse(media)
    frames = [avi.parse_frame(f) for f in held["frames"]]
    values = np.concatenate([f.parts[0].blocks.ravel() for f in frames]) if frames else np.zeros(0, np.int16)
    payload = np.where(values > 0, values, values + 255).astype(np.uint8).tobytes()
    size = held["payload_bytes"] if held["payload_bytes"] is not None else len(payload)
    planes = [avi.pixels(f) for f in frames]
    hist = histograms(planes)
    clips = [
        {"clip": k, "from_frame": a, "to_frame": b, "from_s": a / held["rate"], "to_s": b / held["rate"], "mean": float(np.mean([p.mean() for p in planes[a:b]]))}
        for k, (a, b) in enumerate(shots(hist))
    ]
    return payload[:size], held["n_bytes"] if held["n_bytes"] is not None else size, clips, hist.mean(axis=0) if len(hist) else np.zeros(BINS)


CLIP = "struct<clip:bigint,from_frame:bigint,to_frame:bigint,from_s:double,to_s:double,mean:double>"


def decode(media: DataFrame) -> DataFrame:
    """One row per file: its payload's digests, its own, its clips and a feature.

    ``feature`` lists frames, clips and the mean histogram of luma in thousandths,
    so equal files have equal features. Of a file that can't be read the figures
    of its payload and ``feature`` are null and it has no clips; of a null one
    ``media_bytes`` and ``media_sha256`` are null too. Repeated rows come back as
    they are; an empty table gives no rows.
    """
    kinds = pa.list_(pa.struct([("clip", pa.int64()), ("from_frame", pa.int64()), ("to_frame", pa.int64()), ("from_s", pa.float64()), ("to_s", pa.float64()), ("mean", pa.float64())]))

    def load(batches):
        for batch in batches:
            out = []
            for m in batch.column(1):
                stored = m.as_py()
                try:
                    payload, n, clips, hist = read(stored or b"")
                except (ValueError, struct.error):
                    own = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
                    out.append((None, None, None, None, *own, None, []))
                    continue
                frames = clips[-1]["to_frame"] if clips else 0
                feature = f"{frames}:{len(clips)}:" + ",".join(str(x) for x in np.round(hist * 1000).astype(int).tolist())
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, clips))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kinds]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(load, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips array<{CLIP}>")


def media_columns(documents: DataFrame) -> DataFrame:
    """Store every whole text and read it back: a row per row of ``documents``.

    Null and empty texts are a payload of 64 zero bytes; repeated rows and null
    doc_ids come back as they are; an empty table gives no rows.
    """
    return decode(encode(documents))


def clips(documents: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, from_frame, to_frame, from_s, to_s, mean)."""
    return media_columns(documents).select("doc_id", F.inline("clips"))
