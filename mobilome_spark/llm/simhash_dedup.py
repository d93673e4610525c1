"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints that
differ in at most three bits differ in at most one bit of one segment, so each
looks up, for each segment, the Hamming ball of radius one around its own value
(33 keys) in a table keyed by segment value, and the full distance of what it
finds is verified. Only distinct fingerprints take part.

A segment value that very many distinct fingerprints share would make the
lookups grow with the square of their number. Fingerprints that meet such a
value are linked exactly in another way: x and y differ in at most three bits
if and only if some z is within one bit of one and two bits of the other. Every
z that is within one bit of some fingerprint gets the smallest such one as its
centre, and all within two bits of z link to that centre: a star, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm.common import join_counted, materialize, release_memory
from mobilome_spark.llm.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED, SHINGLE, RADIUS = 42, 3, 3
#: Distinct fingerprints that may share a segment value before stars replace lookups.
HOT = 512


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's bytes: a bit is set if over half of the shingles' hashes have it.

    A-Z are lower-cased; words are what ASCII white space separates; a text of
    fewer words than a shingle is one shingle; one without words gives 0.
    """
    words = (text or b"").translate(LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
    starts = [0, *[e + 1 for e in ends[: n - shingle]]]
    ones, total = np.zeros(64, np.int64), n - shingle + 1
    for first in range(0, total, 1 << 16):  # bounds the memory of very long texts
        part = zip(starts[first : first + (1 << 16)], ends[first + shingle - 1 : first + shingle - 1 + (1 << 16)], strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], np.dtype("<u8"))
        ones += _bit_sums(hashes)
    bits = ones * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, keyed: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; with
    ``keyed`` also text_key, which tells apart texts of the same doc_id."""

    def score(batches):
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *extra])

    extra = ["text_key"] if keyed else []
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("_text"), *[text_key(F.col("text")).alias("text_key") for _ in extra])
    return rows.mapInArrow(score, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp bigint" + ", text_key bigint" * keyed)


def _masks(bits: int, radius: int) -> list[int]:
    out = []
    for r in range(radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
    return [_signed(m) for m in out]


def _around(column, masks: list[int]):
    """One row for each value of the Hamming ball."""
    held = F.from_json(F.lit(str(masks)), "array<bigint>")  # folded to one constant; a call per mask would swell the plan
    return F.explode(F.transform(held, lambda m: column.bitwiseXOR(m)))


def near_pairs(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect all
    that are joined by steps of at most three differing bits."""
    halves = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)]
    table = distinct.select("fp", F.posexplode(F.array(*halves)).alias("seg", "key"))
    probes = table.select("fp", "seg", _around(F.col("key"), _masks(32, 1)).alias("key"))
    crowded = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("seg", "key")
    crowded = materialize(crowded, "simhash-crowded")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    kept = table.join(crowded, ["seg", "key"], "left_anti").withColumnRenamed("fp", "b")
    pairs = probes.withColumnRenamed("fp", "a").join(kept, ["seg", "key"]).filter((F.col("a") < F.col("b")) & (differ <= RADIUS)).select("a", "b")
    if crowded.isEmpty():
        return pairs
    dense = probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
    dense = materialize(dense, "simhash-dense")
    centres = dense.select("fp", _around(F.col("fp"), _masks(64, 1)).alias("z")).groupBy("z").agg(F.min("fp").alias("b"))
    spokes = dense.select(F.col("fp").alias("a"), _around(F.col("fp"), _masks(64, 2)).alias("z"))
    stars = spokes.join(centres, "z").select("a", "b").filter("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``documents``.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest
    doc_id reachable over links. Null, empty and blank texts have fingerprint
    zero and link like any other. Repeated rows come back as often as they are
    given; a null doc_id is never the smallest unless it is alone. An empty
    table gives no rows. Other columns are ignored.
    """
    prints = materialize(fingerprints(documents, shingle), "simhash-prints")
    named, total = _named(prints, hot)
    return join_counted(prints, named, ["fp"], total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(prints: DataFrame, hot: int) -> tuple[DataFrame, int]:
    """(fp, component_id, _n) of each distinct fingerprint, and the number of rows."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n")), "simhash-distinct")
    linked = materialize(near_pairs(distinct.select("fp"), hot), "simhash-links")
    roots = materialize(connected_components(linked), "simhash-roots")
    named, total = _least(distinct.withColumnRenamed("fp", "key"), roots.withColumnRenamed("node", "key"), F.col("doc_id"))
    return named.select(F.col("key").alias("fp"), F.col("least").alias("component_id"), "_n"), total


def _least(keys: DataFrame, roots: DataFrame, value) -> tuple[DataFrame, int]:
    """(key, least, _n): the least ``value`` over each key's component, and the sum of ``_n``.

    A component may hold most keys: its rows are dealt out."""
    named = materialize(keys.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")).select("root", "key", value.alias("value"), F.col("_n").alias("_rows")), "components-named")
    least = materialize(named.groupBy("root").agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("_n")), "components-first")
    counted = named.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    out = join_counted(named, least, ["root"], counted[0]).select("key", "least", F.col("_rows").alias("_n"))
    return materialize(out, "components-least"), counted[1] or 0


def _first_rows(documents: DataFrame, keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each component one row of ``documents``: that with the smallest doc_id (null
    last), of several such rows that with the smallest text, of equal ones one.

    ``keyed``: (doc_id, text_key, key) of every row; ``roots``: (key, root)."""
    value = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    own = keyed.groupBy("key").agg(F.min(value).alias("_value"), F.count(F.lit(1)).alias("_n"))
    named = own.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = named.groupBy("root").agg(F.min("_value").alias("_value")).select("_value.doc_id", "_value.text_key")
    times = keyed.groupBy("doc_id", "text_key").count()
    same = times["doc_id"].eqNullSafe(kept["doc_id"]) & (times["text_key"] == kept["text_key"])
    kept = materialize(times.join(kept, same, "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key"), "count"), "representatives")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(row.alias("_row"), F.col("doc_id").alias("_d"), text_key(F.col("text")).alias("_k"))
    rows = rows.join(kept, rows["_d"].eqNullSafe(kept["_id"]) & (rows["_k"] == kept["_text_key"])).select("_row", "_id", "_text_key", "count")
    # few rows repeat a doc_id and its text; of those the one whose columns hash lowest stays
    again = rows.filter("count > 1").withColumn("_h", F.xxhash64("_row")).groupBy("_id", "_text_key").agg(F.min_by("_row", "_h").alias("_row"))
    return rows.filter("count = 1").select("_row.*").unionByName(again.select("_row.*"))


def text_key(text):
    """Tells apart the texts of rows that share a doc_id; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def representatives(documents: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """Rows of ``documents`` without near-duplicates: one row of each component
    stays, columns unchanged.

    It is the row with the smallest doc_id (null last); of several rows with
    that doc_id the one with the smallest hash of its text, of equal rows one.
    Null, empty and blank texts are near-duplicates of each other. An empty
    table gives no rows.
    """
    keyed = materialize(fingerprints(documents, shingle, True).withColumnRenamed("fp", "key"), "simhash-prints")
    distinct = keyed.select(F.col("key").alias("fp")).distinct()
    roots = connected_components(materialize(near_pairs(materialize(distinct, "simhash-distinct"), hot), "simhash-links"))
    return _first_rows(documents, keyed, roots.withColumnRenamed("node", "key"))


#: Words of a shingle of near copies in corpus stages; bands of smallest hashes and rows of a band.
STAGE_SHINGLE, BANDS, ROWS = 5, 24, 5
#: Comparisons with one text that a task of ``_verified`` makes, about.
COMPARED = 4096
#: Longs of the parity bitmap of a set of shingles.
PARITY = 16
#: Keys that are sent to all tasks at most, about 24 MB there.
SENT = 1 << 19


def shingle_sets(documents: DataFrame, shingle: int = STAGE_SHINGLE, whole: bool = False) -> DataFrame:
    """(doc_id, text_key, key, fp, bands): a key for the set of distinct shingles' hashes of
    every text, its SimHash and a key for each band of smallest hashes.

    With ``whole`` (key, hashes, parity) instead: the hashes themselves in order, several times
    the text, and a bitmap: bit i is set if an odd number of hashes end in i."""
    rng = np.random.default_rng(SEED)
    odd, plus = (rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    odd = (odd * np.uint64(2) + np.uint64(1))[:, None]
    digest = xxhash.xxh64_intdigest

    def one(text: bytes | None):
        words = (text or b"").translate(LOWER).split()
        n, joined = len(words), b" ".join(words)
        if n <= shingle:
            hashes = np.array([digest(joined, SEED)] if n else [], np.uint64)
        else:
            ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
            starts = [0, *[e + 1 for e in ends[: n - shingle]]]
            hashes = np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, n - shingle + 1))
        key = _signed(digest(hashes.tobytes(), SEED))
        if whole:
            odds = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
            return key, hashes.view(np.int64), np.packbits(odds.astype(np.uint8), bitorder="little").view("<i8")
        least, ones = np.full(BANDS * ROWS, np.iinfo(np.uint64).max), np.zeros(64, np.int64)
        for first in range(0, len(hashes), 1 << 12):  # bounds the memory of very long texts
            part = hashes[first : first + (1 << 12)]
            mixed = part[None, :] * odd
            mixed += plus[:, None]
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            least = np.minimum(least, mixed.min(axis=1))
            ones += _bit_sums(part.astype("<u8"))
        fp = int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if n else 0
        bands = [digest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))]
        return key, _signed(fp), np.array(bands, np.uint64).view(np.int64)

    kept = [] if whole else ["doc_id", "text_key"]
    kinds = {"key": pa.int64(), "hashes": pa.list_(pa.int64()), "parity": pa.list_(pa.int64())} if whole else {"key": pa.int64(), "fp": pa.int64(), "bands": pa.list_(pa.int64())}

    def score(batches):
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                found = [one(t.as_py()) for t in part.column(0)]
                yield pa.record_batch([*part.columns[1:], *[pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())]], [*kept, *kinds])
        release_memory()

    columns = {"doc_id": F.col("doc_id"), "text_key": text_key(F.col("text"))}
    rows = documents.select(F.col("text").cast("binary").alias("_text"), *[columns[c].alias(c) for c in kept])
    types = {"doc_id": documents.schema["doc_id"].dataType.simpleString(), "bands": "array<bigint>", "hashes": "array<bigint>", "parity": "array<bigint>"}
    return rows.mapInArrow(score, ", ".join(f"{c} {types.get(c, 'bigint')}" for c in [*kept, *kinds]))


def _texts(documents: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, hashes, parity) of the ``wanted`` keys, a row each, from a document of each.

    Only those documents' hashes are made: held for all texts, they take twice the input and a
    shuffle of as much. Up to ``SENT`` keys are sent to all tasks, so that no text is shuffled."""
    row = lambda: F.xxhash64("doc_id", "text_key").alias("_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    # grouped first: very many documents may hold one text
    rows = sets.groupBy("key").agg(least.alias("_v")).join(wanted, "key", "left_semi").select("_v.doc_id", "_v.text_key").select(row()).distinct()
    rows = materialize(rows, "close-wanted")
    rows = F.broadcast(rows) if rows.count() <= SENT else rows
    # a document that meets another's number by chance only adds a row of its own key
    held = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).withColumn("_row", row()).join(rows, "_row", "left_semi")
    return shingle_sets(held.select("doc_id", "text"), whole=True).dropDuplicates(["key"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets have a Jaccard similarity of 0.8 or more.

    A text that very many are compared with is sent to several tasks."""
    pairs = materialize(pairs.distinct(), "close-pairs")
    if pairs.isEmpty():
        return pairs
    # a row for each COMPARED pairs at most
    often = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > COMPARED)
    often = materialize(often.select("b", F.ceil(F.col("_n") / COMPARED).cast("int").alias("_parts")), "close-often")
    left = texts.select(F.col("key").alias("a"), F.col("hashes").alias("_x"))
    right, on = texts.select(F.col("key").alias("b"), F.col("hashes").alias("_y")), ["b"]
    if not often.isEmpty():
        parts, often, on = F.coalesce("_parts", F.lit(1)), F.broadcast(often), ["b", "_part"]
        pairs = pairs.join(often, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("_part"))
        right = right.join(often, "b", "left").select("b", "_y", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    both = F.size(F.array_intersect("_x", "_y"))
    near = pairs.join(left, "a").join(right, on)
    return materialize(near.filter(both * 5 >= (F.size("_x") + F.size("_y") - both) * 4).select("a", "b"), "close-links")


def _possible(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of a band, of different components, that can have a similarity of 0.8: they
    differ in a ninth of their sizes' sum at most."""
    most = F.col("a_size") + F.col("b_size")
    bits = sum((F.bit_count(F.get("a_parity", F.lit(i)).bitwiseXOR(F.get("b_parity", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    fits = (F.abs(F.col("a_size") - F.col("b_size")) * 9 <= most) & (bits * 9 <= most)
    apart = (F.col("a_key") < F.col("b_key")) & (F.col("a_root") != F.col("b_root"))
    return left.join(right, ["n", "band"]).filter(apart & fits).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))


def close_representatives(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows of ``documents`` without near copies: one row of each component stays,
    columns unchanged; which one, nulls, repeated rows and empty tables as in
    ``representatives``.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity
    of 0.8 or more, which is verified. Candidates are what multi-index hashing finds
    among the sets' fingerprints, and, as texts of that similarity differ in some
    ten bits and not in three, those that share a band of smallest hashes: of pairs
    at 0.8 a share of 7e-5 has none in common. The texts of a band are compared
    with the one that shares most bands with others, those that are not in its
    component then with the next such text, and texts of a band that are in several
    components after that with each other, if their bitmaps allow the similarity:
    two sets differ in at least as many shingles as their parity bitmaps differ in
    bits, so that loses nothing.
    """
    sets = materialize(shingle_sets(documents), "close-sets")
    bands = sets.select("key", F.posexplode("bands").alias("n", "band")).distinct()
    bands = materialize(bands, "close-bands")
    prints = materialize(sets.groupBy("fp").agg(F.min("key").alias("key"), F.max("key").alias("_last"), F.count(F.lit(1)).alias("_n")), "close-prints")
    size = F.count(F.lit(1))
    shared = materialize(bands.groupBy("n", "band").agg(size.alias("_n"), size.alias("met")).filter("_n > 1"), "close-shared")
    met = materialize(join_counted(bands, shared, ["n", "band"], bands.count()), "close-met")
    # how many texts a text meets in all its bands: the middle of a group of edited copies meets most
    met = met.join(met.groupBy("key").agg(F.sum("met").alias("meets")), "key").select("key", "n", "band", "meets")
    placed = materialize(met, "close-placed")

    def central(rows: DataFrame) -> DataFrame:
        """(a, b): the rows' keys with the most central key of their band."""
        first = rows.groupBy("n", "band").agg(F.max(F.struct("meets", "key")).getField("key").alias("b"), size.alias("_n"))
        pairs = join_counted(rows, materialize(first, "close-central"), ["n", "band"], rows.count())
        return pairs.filter("key <> b").select(F.col("key").alias("a"), "b")

    stars = central(placed)
    # fingerprints within three bits, by a text of each; texts of one fingerprint by the first of them
    near = materialize(near_pairs(prints.select("fp"), hot), "close-near")
    held = prints.select("fp", "key")
    near = near.join(held.select(F.col("fp").alias("a"), F.col("key").alias("x")), "a").join(held.select(F.col("fp").alias("b"), F.col("key").alias("y")), "b")
    same = join_counted(sets.select("fp", "key").distinct(), prints.filter("key <> _last").select("fp", F.col("key").alias("b"), "_n"), ["fp"], sets.count())
    near = near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same.filter("key <> b").select(F.col("key").alias("a"), "b"))
    stars = materialize(stars.unionByName(near).distinct(), "close-stars")
    wanted = stars.select(F.col("a").alias("key")).unionByName(stars.select(F.col("b").alias("key"))).distinct()
    texts = materialize(_texts(documents, sets, wanted), "close-texts")
    links = _verified(stars, texts)

    def apart(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(roots, rows of ``placed`` of bands that hold several components, with their
        root and ``first``, the root of their band's most central key)."""
        roots = materialize(connected_components(links), "close-roots").withColumnRenamed("node", "key")
        rows = materialize(placed.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "close-rooted")
        first = F.max(F.struct("meets", "key", "root")).getField("root").alias("first")
        mixed = rows.groupBy("n", "band").agg(F.min("root").alias("_r"), F.max("root").alias("_s"), first, size.alias("_n")).filter("_r <> _s")
        mixed = materialize(mixed.select("n", "band", "first", "_n"), "close-mixed")
        return roots, materialize(join_counted(rows, mixed, ["n", "band"], rows.count()), "close-apart")

    _, rows = apart(links)
    links = links.unionByName(_verified(central(rows.filter("root <> first")), texts))
    roots, rows = apart(links)
    if not rows.isEmpty():
        rows = rows.join(texts.select("key", "parity", F.size("hashes").alias("size")), "key").select("n", "band", "key", "root", "size", "parity")
        rows = materialize(rows, "close-rest")
        rest = _possible(rows.select("n", "band", *[F.col(c).alias(f"a_{c}") for c in rows.columns[2:]]), rows.select("n", "band", *[F.col(c).alias(f"b_{c}") for c in rows.columns[2:]]))
        roots = connected_components(links.unionByName(_verified(rest, texts))).withColumnRenamed("node", "key")
    return _first_rows(documents, sets.select("doc_id", "text_key", "key"), roots)
