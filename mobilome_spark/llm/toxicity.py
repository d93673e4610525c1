"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are densities of lexicon words, how near they stand to the
second person, capitals, punctuation and obfuscation rates. Besides a fixed
lexicon there is one learned from labels: words and stems that toxic documents
have far more often than others. Labels are learned from a bounded sample
(``SAMPLE`` rows of each label) of the documents outside the held-out fold; one
half of it teaches the lexicon, the rest the trees, so that the trees see the
lexicon as new texts do. Calibration is fitted on the scores that the rows of
each third of that rest get from trees of the other two.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm.boosting import BoostedTrees, Isotonic
from mobilome_spark.llm.common import materialize, release_memory

THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
#: Labelled rows of each label that the model may be fitted on, and entries of the learned lexicon.
SAMPLE, TERMS = 6000, 4000
STEMS, NEAR = (4, 5, 6), 5
#: Least log ratio of document shares for a term of the learned lexicon.
MIN_RATIO = 3.0

# Common insults and slurs' milder forms, and second-person words.
INSULTS = frozenset(
    b"idiot idiots idiotic moron morons moronic stupid dumb dumbass scum scumbag trash garbage pathetic worthless disgusting "
    b"clown clowns loser losers imbecile fool fools jerk creep pig pigs vermin filth filthy ugly retard retarded bastard bitch "
    b"asshole fuck fucking shit crap damn hate kill die shut freak weirdo coward liar useless vile repulsive dirtbag lowlife "
    b"dummkopf arschloch scheisse idioten bloed abschaum connard salaud merde imbecile ordure pendejo estupido basura mierda asco".split()
)
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes".split())
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")

_WORD = re.compile(rb"[a-z\x80-\xff]+")
_ODD = re.compile(rb"[a-z\x80-\xff]+[0-9@$*!]+[a-z\x80-\xff]+|\b[a-z](?:[.\-_*][a-z]){3,}")
_RUN = re.compile(rb"([a-z])\1{3,}")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
NAMES = (
    "insults", "insult_rate", "insult_kinds", "learned", "learned_rate", "learned_weight", "learned_kinds", "near_you", "you_rate", "capitals",
    "capital_words", "exclaims", "questions", "symbols", "odd_rate", "odd_insults", "runs", "words",
)


def terms_of(text: bytes) -> set[bytes]:
    """The words of a text and their stems, which carry a trailing ``*``."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + b"*" for w in words for n in STEMS if len(w) >= n}


class Features:
    """Dense features of a text under a learned lexicon {term: weight}."""

    def __init__(self, learned: dict[bytes, float]):
        self.learned, self.memo = learned, {}

    def _weight(self, word: bytes) -> float:
        found = self.learned.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                found = max(found, self.learned.get(word[:n] + b"*", 0.0))
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[word] = found
        return found

    def __call__(self, text: bytes) -> list[float]:
        data = np.frombuffer(text, np.uint8)
        lower = text.lower()
        words = _WORD.findall(lower)
        n, size = max(1, len(words)), max(1, len(data))
        bad, found, weight, second = [], [], 0.0, []
        memo, rate = self.memo, self._weight
        for i, w in enumerate(words):
            x = memo.get(w)
            if x is None:
                x = rate(w)
            if x:
                found.append(i)
                weight += x
            if w in INSULTS:
                bad.append(i)
            elif w in SECOND_PERSON:
                second.append(i)
        odd = _ODD.findall(lower)
        hidden = sum(1 for w in odd if (_WORD.findall(w.translate(LEET, b".-_*")) or [b""])[0] in INSULTS)
        near = 0
        if second and (bad or found):
            marks, at = np.array(second), np.array(bad + found)
            right = np.searchsorted(marks, at)
            gap = np.minimum(np.abs(at - marks[np.minimum(right, len(marks) - 1)]), np.abs(at - marks[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR).sum())
        counts = np.bincount(data, minlength=256)
        letters, capitals = int(counts[_LETTER].sum()), int(counts[_CAPITAL].sum())
        symbols = size - letters - int(counts[48:58].sum()) - int(counts[_SPACE].sum()) if len(data) else 0
        shouted = len(re.findall(rb"\b[A-Z]{3,}\b", text)) if capitals > 2 else 0
        return [
            len(bad), len(bad) / n, len({words[i] for i in bad}), len(found), len(found) / n, weight, len({words[i] for i in found}), near / n, len(second) / n,
            capitals / max(1, letters), shouted / n, int(counts[33]) / size, int(counts[63]) / size, symbols / size, len(odd) / n, hidden, len(_RUN.findall(lower)) / n, float(np.log1p(len(words))),
        ]


class Model:
    """Lexicon, trees and calibration; scores any text. ``trees`` may be None: then the base rate is the score."""

    def __init__(self, learned: dict[bytes, float], trees: BoostedTrees | None, calibration: Isotonic | None, base: float):
        self.learned, self.trees, self.calibration, self.base = learned, trees, calibration, base

    def scores(self, texts: list[bytes], features: Features) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.base)
        return np.clip(self.calibration(self.trees.raw(np.array([features(t) for t in texts]))), 0, 1)


def _sampled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic, part) of the sample, and the share of each label in it: at most ``SAMPLE`` rows of each label on
    average of the hash, outside the held-out fold; of several rows of a doc_id the
    smallest text. Part 0 teaches the lexicon, 1 to 3 are the thirds for the trees."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r.toxic: min(1.0, SAMPLE / r["count"]) for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for label, x in share.items():
        keep = keep | ((F.col("toxic") == label) & (place < x))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(6))
    part = F.greatest(part - 2, F.lit(0))
    # the ids are bounded by SAMPLE, so sending them spares the texts a shuffle
    chosen = F.broadcast(known.filter(keep).select("doc_id", "toxic", part.alias("part")))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id")
    return rows.groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")).select("text", "toxic", "part"), share


def _learn_terms(sample: DataFrame) -> dict[bytes, float]:
    """Terms that toxic documents of the lexicon's half have far more often: {term: log ratio}."""
    half = sample.filter("part = 0")
    totals = {r.toxic: r["count"] for r in half.groupBy("toxic").count().collect()}
    yes_n, no_n = totals.get(1, 0), totals.get(0, 0)
    if not yes_n or not no_n:
        return {}

    def count(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                seen[toxic.as_py()].update(terms_of(text.as_py()))
        terms = list(seen[0] | seen[1])
        yield pa.record_batch([pa.array(terms, pa.binary()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "yes", "no"])

    counted = half.select("text", F.col("toxic").cast("int")).mapInArrow(count, "term binary, yes bigint, no bigint").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    ratio = F.log((F.col("yes") + 0.5) / (yes_n + 1)) - F.log((F.col("no") + 0.5) / (no_n + 1))
    best = counted.filter("yes >= 3").withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "term").limit(TERMS)
    return {bytes(r.term): r.ratio for r in best.collect()}


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn a model; without documents of both labels its score is the base rate."""
    sampled, share = _sampled(documents, labels)
    sample = materialize(sampled, "toxicity-sample")
    learned = _learn_terms(sample)

    def dense(batches):
        features = Features(learned)
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "part"])

    held = sample.select("text", F.col("toxic").cast("int"), F.col("part").cast("int")).mapInArrow(dense, "x array<double>, toxic int, part int").toPandas()
    y, part = held["toxic"].to_numpy(float), held["part"].to_numpy()
    # a sampled row stands for 1 / share rows, so that scores are chances among all labelled documents
    weight = np.array([1 / share[int(v)] for v in y])
    base = float(np.average(y, weights=weight)) if len(y) else 0.0
    x = np.array(held["x"].tolist()).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T, y, part))[(part == 0).sum() :]  # the sample comes back in no fixed order; part 0 stands first
    x, y, weight, part = x[order], y[order], weight[order], part[order]
    if len(set(y)) < 2:
        return Model(learned, None, None, base)
    raw = np.zeros(len(y))
    for third in (1, 2, 3):
        own = part == third
        if own.any() and not own.all():
            raw[own] = BoostedTrees().fit(x[~own], y[~own]).raw(x[own])
    return Model(learned, BoostedTrees().fit(x, y), Isotonic().fit(raw, y, weight), base)


def toxicity(documents: DataFrame, labels: DataFrame, model: Model | None = None, whole: bool = False) -> DataFrame:
    """``_row`` (the columns of ``documents``, the text only if ``whole``), ``held_out``, ``score`` and ``predicted``.

    Every whole text is scored, null and empty ones as texts without words.
    ``held_out`` tells whether crc32 of the doc_id as text leaves 1 modulo 3:
    such rows never teach the model; a null doc_id is never held out. Repeated
    rows score alike. Without usable labels all scores are the base rate. An
    empty table gives no rows.
    """
    model = model or fit(documents, labels)

    def score(batches):
        features = Features(model.learned)
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                found = model.scores([t.as_py() for t in part.column(1)], features)
                yield pa.record_batch([part.column(0), pa.array(found)], ["_row", "score"])
        release_memory()

    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns if whole or c != "text"])
    rows = documents.select(row.alias("_row"), F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    scored = rows.mapInArrow(score, f"_row {rows.schema['_row'].dataType.simpleString()}, score double")
    fold = F.coalesce(F.crc32(F.col("_row.doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("_row", fold.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def accepted_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` that are not predicted toxic, columns unchanged.

    Repeated rows stay or go alike; null and empty texts are scored like others;
    without usable labels the base rate decides for all. No documents, no rows.
    """
    return toxicity(documents, labels, whole=True).filter("predicted = 0").select("_row.*")
