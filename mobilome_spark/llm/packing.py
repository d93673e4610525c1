"""Best-fit packing: a configuration linear program over the length histogram.

Only the histogram of piece lengths (at most ``CAPACITY`` numbers) reaches the
driver. The program asks for the fewest sequences so that the chosen
configurations (multisets of lengths that fit a sequence) cover the histogram.
It is solved by multiplicative weights: lengths that are covered ahead of the
others lose weight, and the most valuable configurations for the present weights
come from an unbounded-knapsack dynamic program, until a fractional solution
covers every length within ``GAP`` of the dual bound. It is rounded to whole
sequences and what rounding leaves over, a smaller share the more pieces there
are of a length, goes in by best fit. Every piece then finds its place from its rank among the
pieces of its length; the ranks come from counts of (length, part) cells.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mobilome_spark.llm.common import materialize, release_memory

CAPACITY, END = 2048, 0
#: Gap to the dual bound at which the program ends, rounds that it ends after in any case.
GAP, ROUNDS = 0.01, 2000
#: Rate of the weights, share of its worth that a choice may fall short by.
RATE, SLACK = 0.02, 2e-3
#: Most and fewest pieces aimed at per (length, part) cell.
CELL, SMALL_CELL = 4096, 64
VOCABULARY = "byte_bpe_50k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# ---------------------------------------------------------------- the program


def price(values: np.ndarray, capacity: int, slack: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(worth, first length) of the most valuable multiset of lengths for every room (unbounded knapsack).

    ``values[l]`` is the worth of a piece of length l; index 0 is unused. With
    ``rng`` a choice may be worth up to a share ``slack`` less, so that choices
    of nearly equal worth take turns. First length 0 leaves one token empty.
    """
    lengths = np.flatnonzero(values[1:] > 0) + 1
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth, fits = values[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], fit = best[room - 1], fits[room]
        if fit:
            total = worth[:fit] + best[room - lengths[:fit]]
            k = int(np.argmax(total if rng is None else total * (1 - slack * rng.random(fit))))
            if total[k] > best[room]:
                best[room], pick[room] = total[k], lengths[k]
    return best, pick


@lru_cache(maxsize=1 << 16)
def _pair(length: int, times: int) -> tuple[int, int]:
    """One object for all configurations that hold it: a program keeps very many."""
    return length, times


def _filled(pick: np.ndarray, first: int, room: int) -> tuple[tuple[int, int], ...]:
    """The configuration of a piece of length ``first`` and what ``price`` puts into the room beside it."""
    out = Counter({first: 1})
    while room > 0:
        if pick[room]:
            out[int(pick[room])] += 1
        room -= int(pick[room]) or 1
    return tuple(_pair(*x) for x in sorted(out.items(), reverse=True))


def program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[list[tuple[tuple[tuple[int, int], ...], float]], float, float]:
    """([(configuration, times)], sequences, bound): a fractional solution that covers all counts.

    A round asks for one more helping of every length's count. From the longest
    down, a length that lags behind takes the configuration priced best beside
    it. The weight of a length falls exponentially with the helpings it is ahead
    by. ``bound`` is the best dual value met: the worth of all pieces over that
    of the most valuable configuration. Rounds go on until the solution, scaled
    to cover every length just once, is within ``gap`` of it; ``rounds`` only
    keeps a case that does not get there from running for ever.
    """
    lengths = np.flatnonzero(counts)
    need, size = counts.astype(float), np.arange(len(counts)) / capacity
    covered, weight, rng = np.zeros(len(counts)), size.copy(), np.random.default_rng(capacity)
    taken: dict[tuple[tuple[int, int], ...], float] = {}
    total, low, bound = 0.0, 1.0, float(need @ size)
    for t in range(1, rounds + 1):
        values = np.zeros(len(counts))
        values[lengths] = weight[lengths]
        pick = price(values, capacity, SLACK, rng)[1]
        for l in lengths[::-1].tolist():
            lag = need[l] * t - covered[l]
            if lag > 1e-9 * need[l]:
                config = _filled(pick, l, capacity - l)
                times = lag / dict(config)[l]
                for other, n in config:
                    covered[other] += n * times
                taken[config] = taken.get(config, 0.0) + times
                total += times
        helpings = covered[lengths] / need[lengths]
        low = float(helpings.min())
        weight[lengths] = size[lengths] * np.exp(-RATE * np.clip(helpings - t, 0, 20 / RATE))
        if t % 10 == 0:
            values[lengths] = weight[lengths]
            bound = max(bound, float(need @ values) / float(price(values, capacity)[0][capacity]))
            if total / low <= bound * (1 + gap):
                break
    for config in taken:
        taken[config] /= low
    return list(taken.items()), total / low, bound


def rounded(solution: list[tuple[tuple[tuple[int, int], ...], float]], left: np.ndarray) -> Counter:
    """Whole times of a fractional solution, as far as ``left`` has the pieces; takes them from it.

    Configurations of the same longest piece hand on what is below a whole, so
    that many small fractions are not all rounded to nothing.
    """
    out, carried, capacity = Counter(), Counter(), len(left) - 1
    for config, times in solution:
        first = config[0][0]
        carried[first] += times
        while True:
            # the sums of fractions end a little below the whole they stand for
            wanted = int(carried[first] + 1e-6)
            whole = min(wanted, *(int(left[l]) // n for l, n in config))
            if whole > 0:
                out[config] += whole
                carried[first] -= whole
                for l, n in config:
                    left[l] -= whole * n
            # a cover has more of some lengths than there are pieces: go without them if nothing else fits
            config = tuple((l, min(n, int(left[l]))) for l, n in config if left[l])
            room = capacity - sum(l * n for l, n in config)
            spare = left[: room + 1] - np.array([dict(config).get(l, 0) for l in range(room + 1)]) if whole < wanted and config else None
            if spare is None or config[0][0] != first or (spare > 0).any():
                break
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(configuration, times)]: sequences that hold exactly the pieces counted.

    ``counts[l]`` pieces of length l; a configuration is ((length, times), ...)
    from the longest down. Deterministic. Sequences that one piece fills are
    left out by the caller or come back as they are.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: Counter = Counter()
    if left[capacity]:
        out[((capacity, 1),)] += int(left[capacity])
        left[capacity] = 0
    if left.any():
        out.update(rounded(program(left, capacity, rounds)[0], left))
    out.update(_best_fit(left, capacity))
    return sorted(out.items(), reverse=True)


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """What rounding left: filled by the fullest choice for each sequence, longest piece first."""
    out: Counter = Counter()
    left = left.copy()
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        config, room = Counter({longest: 1}), capacity - longest
        while room:
            open_ = left[: room + 1] - np.array([config[l] for l in range(room + 1)])
            at = np.flatnonzero(open_[1:] > 0) + 1
            if not len(at):
                break
            # reach the end with one or two pieces where that is possible, else take the longest
            pair = np.isin(room - at, at)
            exact = at[at == room]
            l = int(exact[0]) if len(exact) else int(at[pair][-1]) if pair.any() else int(at[-1])
            config[l] += 1
            room -= l
        times = min(int(left[l]) // n for l, n in config.items())
        out[tuple(sorted(config.items(), reverse=True))] += times
        for l, n in config.items():
            left[l] -= n * times
    return out


def places(solution: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, arrays over the configurations that hold it: the rank of
    the first piece there, pieces per sequence, first sequence and offset."""
    at: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    sequence = 0
    for config, times in solution:
        offset = 0
        for l, n in config:
            at.setdefault(l, []).append((seen[l], n, sequence, offset))
            seen[l] += n * times
            offset += l * n
        sequence += times
    return {l: dict(zip(("rank", "each", "sequence", "offset"), np.array(rows, np.int64).T, strict=True)) for l, rows in at.items()}


# ----------------------------------------------------------------- the pieces


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies,
    printable bytes for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _spec(path: str) -> tuple[dict, str]:
    with open(path, "rb") as f:
        raw = f.read()
    return json.loads(raw), hashlib.sha256(raw).hexdigest()


def _ranks(spec: dict) -> dict[bytes, int]:
    letters, added = _byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}


@lru_cache(maxsize=2)
def ranked_vocabulary(path: str) -> str | None:
    """The digest of a tokenizer file if merging by vocabulary number is the same
    as merging by its list of merges, else None.

    It is the same where the file is byte-level BPE, the merges make the tokens in
    the order of their numbers, all bytes come before them, and every token, its
    bytes merged by the lower numbers alone, comes down to the two parts that its
    merge names. Inside a longer text no merge that crosses a token's edge leaves
    the token whole, so its parts merge there as they do alone.
    """
    spec, digest = _spec(path)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    odd = spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")
    if model.get("type", "BPE") != "BPE" or not plain or odd:
        return None
    ranks, letters = _ranks(spec), _byte_letters()
    pairs = [tuple(bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    numbers = [ranks.get(a + b, -1) for a, b in pairs]
    bytes_last = max(ranks.get(bytes([b]), 1 << 60) for b in range(256))
    rising = all(a < b for a, b in zip([bytes_last, *numbers], numbers, strict=False))
    if not rising or len(pairs) + 256 != len(ranks):
        return None
    for (a, b), number in zip(pairs, numbers, strict=True):
        parts = [bytes([x]) for x in a + b]
        while len(parts) > 2:
            least = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], number))
            if ranks.get(parts[least] + parts[least + 1], number) >= number:
                break
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        if parts != [a, b]:
            return None
    return digest


@lru_cache(maxsize=2)
def encoder(path: str, ranked: str | None):
    """A function from a text to the ids that ``tokenizers`` gives it.

    Where the file is the one that ``ranked_vocabulary`` vouches for, ``tiktoken``
    merges by the same numbers, which is about three times as fast. Texts with one
    of the added tokens, and every other file, are left to ``tokenizers``.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec, digest = _spec(path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    if digest != ranked:
        return slow
    added = {t["content"] for t in spec.get("added_tokens", [])}
    # the split that byte-level pre-tokenizers make
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=_ranks(spec), special_tokens={}).encode_ordinary
    return lambda text: slow(text) if any(t in text for t in added) else fast(text)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's pieces.

    Ids are the tokenizer's, then id 0. Documents longer than ``capacity`` are
    cut into pieces of that length, the first of which may be shorter. Null
    texts are empty.
    """

    ranked = ranked_vocabulary(tokenizer)

    def cut(batches):
        encode = encoder(tokenizer, ranked)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first in range(0, len(ids), 1024):
                out: tuple[list, ...] = ([], [], [], [], [])
                for row in range(first, min(first + 1024, len(ids))):
                    tokens = np.array([*encode(texts[row].as_py() or ""), END], "<u4")
                    n = len(tokens)
                    start, size, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        for held, value in zip(out, (row, piece, start, size, zlib.crc32(tokens[start : start + size].tobytes())), strict=True):
                            held.append(value)
                        start, size, piece = start + size, capacity, piece + 1
                yield pa.record_batch([ids.take(pa.array(out[0])), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    Sequences hold at most ``capacity`` tokens and have no gaps. Every row of
    ``documents`` is packed, repeated rows and null doc_ids too; empty and null
    texts are the single id 0. An empty table gives no rows.
    """
    cut = materialize(pieces(documents, tokenizer or default_tokenizer(), capacity), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most one row per length
        counts[row["length"]] = row["count"]
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a length that most pieces have is dealt out like the others, over at least the tasks there are
    cell = max(SMALL_CELL, min(CELL, int(counts.sum()) // (4 * tasks)))
    parts = F.from_json(F.lit(str(np.maximum(1, counts // cell).tolist())), "array<bigint>")
    # equal rows are alike, so any order among them serves: a cell is ordered by all of its columns
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(parts, (F.col("length") + 1).cast("int"))))
    cells = materialize(cut.groupBy("length", "_part").count(), "pack-cells")
    at = places(solve(counts, capacity, rounds))
    release_memory()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")
    cells = cells.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), before.alias("_before"))
    order = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(cells, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def settle(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for l in np.unique(length):
                own, held = np.flatnonzero(length == l), at[int(l)]
                c = np.searchsorted(held["rank"], rank[own], "right") - 1
                k = rank[own] - held["rank"][c]
                sequence[own] = held["sequence"][c] + k // held["each"][c]
                offset[own] = held["offset"][c] + k % held["each"][c] * l
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return ranked.select(*columns, "_rank").mapInArrow(settle, f"doc_id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
