"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear layer
and a softmax follow. Embeddings and layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows. A part of the sample is not trained on: it sets the
temperature of the scores and the score below which a prediction is rejected.

Mean and layer are both linear, so a trained model is applied as one table with a row of
class scores per hash bucket.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microatlas.llm.common import by_text, col

UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
CHUNK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the expected sample of each language, ``max_texts`` that of all;
    a sampled text is learned from by its ``max_features`` commonest n-grams. More than
    ``max_classes`` languages are an error, as none may be left out unseen. ``calibration`` is
    the share of the sample held for temperature and rejection; ``max_error`` the share of
    accepted calibration texts that may be wrong."""

    per_class: int = 400
    max_texts: int = 20_000
    max_features: int = 4096
    max_classes: int = 1000
    calibration: float = 0.25
    orders: tuple[int, ...] = (1, 2, 3)
    bucket_bits: int = 15
    dimension: int = 16
    epochs: int = 8
    rate: float = 4.0
    max_error: float = 0.01
    seed: int = 17


def _is_letter() -> np.ndarray:
    """Whether a code point of the first plane is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(1 << 16)])


class Subwords:
    """Hashed n-grams of a text's letters; runs of anything else are one boundary."""

    def __init__(self, settings: Settings) -> None:
        self.settings, self.letter = settings, _is_letter()

    def __call__(self, text: str | None) -> Iterator[np.ndarray]:
        """Bucket numbers, for a stretch of the text at a time; none without a letter."""
        if not text:
            return
        text = text.lower()
        widest = max(self.settings.orders)
        for start in range(0, len(text), CHUNK):
            part = text[start : start + CHUNK + widest - 1]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            low = points < (1 << 16)
            letter = self.letter[np.where(low, points, 0)]
            for i in np.flatnonzero(~low):
                letter[i] = unicodedata.category(chr(points[i]))[0] == "L"
            if not letter.any():
                continue
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # the first mark after a letter stays, as boundary
            points = np.concatenate([[np.uint32(32)], np.where(letter, points, np.uint32(32))[keep], [np.uint32(32)]]).astype(np.uint32)
            shift = np.uint32(32 - self.settings.bucket_bits)
            for n in self.settings.orders:
                if len(points) < n:
                    continue
                h = np.full(len(points) - n + 1, n * 0x01000193 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ points[k : len(points) - n + 1 + k]) * _FACTORS[k % 4]
                    h ^= h >> np.uint32(15)
                yield ((h * np.uint32(0x2C1B3C6D)) >> shift).astype(np.int64)


@dataclass
class Model:
    """``table``: scores of each class by bucket; the rest turns them into a verdict."""

    settings: Settings
    classes: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None, subwords: Subwords) -> np.ndarray | None:
        total, n = np.zeros(len(self.classes)), 0
        for buckets in subwords(text):
            total += self.table[buckets].sum(0, dtype=np.float64)
            n += len(buckets)
        return total / n + self.bias if n else None


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str, bool]], settings: Settings) -> Model:
    """Fit on (buckets, shares, language, held for calibration)."""
    classes = sorted({s[2] for s in samples})
    if not classes:
        return Model(settings, [], np.zeros((1 << settings.bucket_bits, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(settings.seed)
    size, k = 1 << settings.bucket_bits, len(classes)
    embed = rng.uniform(-1, 1, (size, settings.dimension)) / settings.dimension
    layer, bias = np.zeros((settings.dimension, k)), np.zeros(k)
    number = {c: i for i, c in enumerate(classes)}
    fit = [s for s in samples if not s[3]] or samples
    steps, step = settings.epochs * len(fit), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(fit)):
            buckets, shares, language, _ = fit[i]
            rate = settings.rate * (1 - step / steps)
            step += 1
            mean = shares @ embed[buckets]
            error = _softmax(mean @ layer + bias)
            error[number[language]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            embed[buckets] -= rate * shares[:, None] * back
    model = Model(settings, classes, (embed @ layer).astype(np.float32), bias)
    held = [s for s in samples if s[3]] or fit
    logits = np.array([s[1] @ model.table[s[0]] + bias for s in held])
    truth = np.array([number[s[2]] for s in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    scores = _softmax(logits / model.temperature)
    order = np.argsort(-scores.max(1), kind="stable")
    wrong = np.cumsum(scores.argmax(1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(wrong <= settings.max_error)
    model.threshold = float(scores.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, text: str, label: str, learn: Column, settings: Settings) -> list[tuple]:
    """Hashed features of a sample of labelled texts, the same for the same texts.

    Texts are taken by their hash, at a rate that gives each language its share; copies of
    a text count once. At most twice as many as expected reach the driver, in the order of
    the hash, with at most ``max_features`` features each: 1.3 GB at the very most.
    """
    body = col(text).cast("string")
    usable = docs.filter(learn & col(text).isNotNull() & col(label).isNotNull()).select(
        body.alias("text"), col(label).cast("string").alias("label"), F.shiftrightunsigned(F.xxhash64(body), 11).alias("place")
    )
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().orderBy("label").limit(settings.max_classes + 1).collect()}
    if len(counts) > settings.max_classes:
        raise ValueError(f"more than {settings.max_classes} languages: raise max_classes")
    if not counts:
        return []
    each = max(1, min(settings.per_class, settings.max_texts // len(counts)))
    bound = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(int(min(1.0, each / n) * (1 << 53))))])
    taken = usable.filter(F.col("place") < bound[F.col("label")]).groupBy("place", "label").agg(F.min("text").alias("text"))
    fields = [T.StructField("buckets", T.BinaryType()), T.StructField("times", T.BinaryType())]

    def compute(texts, subwords):
        out = []
        for t in texts:
            total = np.zeros(1 << settings.bucket_bits, np.int64)
            for buckets in subwords(t):
                total += np.bincount(buckets, minlength=len(total))
            used = np.flatnonzero(total)
            if len(used) > settings.max_features:
                used = np.sort(used[np.argsort(-total[used], kind="stable")[: settings.max_features]])
            out.append((used.astype(np.int32).tobytes(), total[used].astype(np.int32).tobytes()))
        return [b for b, _ in out], [n for _, n in out]

    hashed = by_text(taken, "text", fields, compute, ["label", "place"], lambda: Subwords(settings))
    rows = hashed.orderBy("place", "label").limit(2 * each * len(counts)).collect()
    found = []
    for r in sorted(rows, key=lambda r: (r.place, r.label)):
        times = np.frombuffer(r.times, np.int32).astype(np.float64)
        if len(times):
            held = (r.place * 0x9E3779B97F4A7C15 & (1 << 64) - 1) / (1 << 64) < settings.calibration
            found.append((np.frombuffer(r.buckets, np.int32), times / times.sum(), r.label, held))
    return found


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``accepted``.

    The whole text is read. Null texts and those without a letter are ``und`` with score
    0, as is everything if the model has no class; ``accepted`` is false there and where
    the score is under the calibrated threshold. Of equal scores the first language in code
    order is taken. Repeated rows get the same result; an empty table gives none. Input columns named like a result are replaced.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]

    def compute(texts, subwords):
        names, scores = [], []
        for t in texts:
            logits = model.logits(t, subwords) if model.classes else None
            if logits is None:
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                p = _softmax(logits / model.temperature)
                best = int(np.argmax(p))
                names.append(model.classes[best])
                scores.append(float(p[best]))
        return names, scores, [n != UNKNOWN and s >= model.threshold for n, s in zip(names, scores)]

    return by_text(docs, text, fields, compute, keep, lambda: Subwords(model.settings))


def identify(
    docs: DataFrame, held_out: Column, text: str = "text", label: str = "lang", keep: list[str] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Learn from the labelled rows that are not held out, and predict all rows."""
    return predict(docs, train(sample(docs, text, label, ~held_out, settings), settings), text, keep)
