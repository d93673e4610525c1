"""Language identification by error-correcting output codes.

Each language has a codeword of plus and minus ones. For every bit a binary
classifier over hashed byte n-grams (orders 1 to 3) predicts it; the language
whose codeword has the least loss against the predicted margins, each bit
weighted by how well its classifier does, is chosen. A choice that is hardly
better than the second is flagged as ambiguous.

The classifiers are fitted on a bounded sample: about ``SAMPLE`` documents of
each language outside the held-out fold, fewer where there are so many languages
that ``TOTAL`` would be passed. A fifth of it weighs the bits and teaches nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm.common import materialize

FOLDS, HELD_OUT, UNKNOWN = 5, 0, "und"
#: Documents of each language, hashed n-gram classes, rounds of fitting, and the lead below which a choice is ambiguous.
SAMPLE, TOTAL, SIZE, ROUNDS, LEAD = 750, 16_000, 2048, 120, 0.2
#: Rows of ids or languages that may be sent to every task.
MANY = 100_000
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of letters; one blank stands for all else."""
    c = _CLASS[np.frombuffer(b" " + text + b" ", np.uint8)]
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    out = np.bincount(c % SIZE, minlength=SIZE)
    pair = c[:-1] * np.uint32(257) + c[1:]
    out = out + np.bincount((pair * np.uint32(2654435761) >> np.uint32(21)) % SIZE, minlength=SIZE)
    if len(c) > 2:
        triple = pair[:-1] * np.uint32(257) + c[2:]
        out = out + np.bincount((triple * np.uint32(2246822519) >> np.uint32(21)) % SIZE, minlength=SIZE)
    return np.sqrt(out / out.sum()).astype(np.float32)


def has_letter(text: bytes) -> bool:
    if _LETTER[np.frombuffer(text, np.uint8)].any():
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of -1 and 1: all distinct splits for up to four languages,
    else random ones that keep rows far apart."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 4:
        splits = [[1 if k == 0 or (s >> (k - 1)) & 1 else -1 for k in range(languages)] for s in range(2 ** (languages - 1) - 1)]
        return np.array(splits, float).T
    rng = np.random.default_rng(languages)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        gap = min((code[i] != code[j]).sum() for i in range(languages) for j in range(i))
        if gap > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, gap
    return best


class Model:
    """Languages, codewords, a linear classifier per bit and the weights of bits."""

    def fit(self, x: np.ndarray, languages: list[str]) -> Model:
        """``x``: features, rows in a fixed order. Every fifth row weighs the bits only."""
        self.languages = sorted(set(languages))
        self.code = codewords(len(self.languages))
        place = {l: k for k, l in enumerate(self.languages)}
        at = np.array([place[l] for l in languages])
        weighs = np.arange(len(at)) % 5 == 4
        counts = np.bincount(at[~weighs], minlength=len(self.languages))
        weighs &= counts[at] > 0
        sign, share = self.code[at], (1 / np.maximum(1, np.bincount(at)))[at]
        teach, taught = x[~weighs].astype(np.float32), sign[~weighs]
        part = (share[~weighs] / share[~weighs].sum())[:, None]
        w, bias = np.zeros((SIZE, sign.shape[1])), np.zeros(sign.shape[1])
        ahead, ahead_bias, step = w.copy(), bias.copy(), 8.0
        for t in range(ROUNDS):  # accelerated gradient descent on the mean logistic loss
            margin = teach @ ahead.astype(np.float32) + ahead_bias
            pull = part * taught / (1 + np.exp(np.clip(taught * margin, -40, 40)))
            new = ahead + step * (teach.T @ pull.astype(np.float32) - 1e-5 * ahead)
            new_bias = ahead_bias + step * (pull.sum(axis=0) - 1e-5 * ahead_bias)
            lead = t / (t + 3)
            ahead, w, ahead_bias, bias = new + lead * (new - w), new, new_bias + lead * (new_bias - bias), new_bias
        self.w = np.vstack([w, bias])
        judge = weighs if weighs.any() else ~weighs
        right = np.sign(x[judge] @ w + bias) == sign[judge]
        weight = np.maximum((share[judge, None] * right).sum(axis=0) / share[judge].sum() - 0.5, 0.01)
        self.weight = weight / weight.sum()
        return self

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each row of features."""
        margin = np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.w, -30, 30)
        loss = (self.weight * np.log1p(np.exp(-self.code[None] * margin[:, None, :]))).sum(axis=2)
        chance = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        chance /= chance.sum(axis=1, keepdims=True)
        order = np.sort(chance, axis=1)
        lead = order[:, -1] - (order[:, -2] if chance.shape[1] > 1 else 0)
        at = chance.argmax(axis=1)
        return [self.languages[k] for k in at], chance[np.arange(len(x)), at], lead < LEAD


def fit(documents: DataFrame) -> Model | None:
    """Learn from text and non-null lang outside the held-out fold; None if there are none."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold != HELD_OUT))
    counts = known.groupBy("lang").count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    languages = counts.count()
    each = min(float(SAMPLE), TOTAL / max(1, languages))
    share = counts.select(F.col("lang"), (F.lit(each) / F.col("count")).alias("_share"))
    ids = materialize(known.select("doc_id", "lang").join(F.broadcast(share) if languages <= MANY else share, "lang").filter(place < F.col("_share")).select("doc_id").distinct(), "language-sample")
    # a small sample goes to the texts; otherwise Spark chooses how to join
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(ids) if ids.count() <= MANY else ids, "doc_id")
    # a doc_id teaches once, however many rows it has
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("_row")).select("_row.*")

    def dense(batches):
        for batch in batches:
            rows = [(l.as_py(), features(t.as_py()).tobytes()) for l, t in zip(*batch.columns, strict=True) if has_letter(t.as_py())]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])

    held = sample.select("lang", F.col("text").cast("binary")).mapInArrow(dense, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if held.empty:
        return None
    x = np.frombuffer(b"".join(held["x"]), np.float32).reshape(-1, SIZE)
    return Model().fit(x, held["lang"].tolist())


def language_id(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything where no language could be learned. Whole texts are read.
    Repeated rows are predicted alike; a null doc_id is never held out and never
    taught from. An empty table gives no rows.
    """
    model = model or fit(documents)

    def score(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = [t.as_py() for t in part.column(1)]
                readable = [k for k, t in enumerate(texts) if model is not None and t is not None and has_letter(t)]
                lang, chance, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if readable:
                    found, p, close = model.predict(np.stack([features(texts[k]) for k in readable]))
                    chance[readable], unsure[readable] = p, close
                    for k, l in zip(readable, found, strict=True):
                        lang[k] = l
                yield pa.record_batch([part.column(0), pa.array(lang, pa.string()), pa.array(chance), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "ambiguous")
