"""Language identification with averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import name, row_of

BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
WIDTH = 16
GRAMS = (2, 3, 4)
#: Rows of each language that the classifier is fitted on.
LANGUAGE_ROWS = 500
#: Characters that are hashed at a time; a longer text is counted in blocks, wholly.
BLOCK = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """How often each bucket is hit by the text's character n-grams."""
    text, total = text.lower(), np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(text), BLOCK):
        part = text[start : start + BLOCK + max(GRAMS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        own = min(BLOCK, len(text) - start)
        mixed = codes
        for n in range(2, max(GRAMS) + 1):
            mixed = mixed[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
            if n in GRAMS and len(mixed):
                spread = (mixed[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
                total += np.bincount(spread, minlength=BUCKETS)
    return total


def average(hits: np.ndarray) -> np.ndarray:
    return hits / max(1, hits.sum())


@dataclass
class Sparse:
    """Rows of averages, of which only the buckets that were hit are held."""

    places: list[np.ndarray]
    values: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.places)

    def take(self, rows: np.ndarray) -> Sparse:
        return Sparse([self.places[i] for i in rows], [self.values[i] for i in rows])

    def dense(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for own, i in zip(found, rows):
            own[self.places[i]] = self.values[i]
        return found


@dataclass
class Model:
    """Scores of the buckets per language, which fold the embeddings into the softmax."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    sharpness: float = 1.0
    threshold: float = 0.0

    def logits(self, averages: np.ndarray) -> np.ndarray:
        return averages @ self.scores + self.bias

    def chances(self, averages: np.ndarray) -> np.ndarray:
        return self.softmax(self.logits(averages))

    def softmax(self, logits: np.ndarray) -> np.ndarray:
        x = logits * self.sharpness
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)


def fit(
    averages: Sparse,
    labels: np.ndarray,
    languages: list[str],
    epochs: int = 6,
    batch: int = 32,
    rate: float = 0.5,
    seed: int = 7,
) -> Model:
    """Embeddings and softmax by stochastic gradient descent, steps scaled by past gradients."""
    draws, kinds = np.random.default_rng(seed), len(languages)
    embed = draws.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = draws.normal(0, 0.1, (WIDTH, kinds)).astype(np.float32)
    bias = np.zeros(kinds, dtype=np.float32)
    past = [np.full_like(w, 1e-6) for w in (embed, soft, bias)]
    scale = float(np.sqrt(BUCKETS))
    for epoch in range(epochs):
        order = draws.permutation(len(averages))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = averages.dense(rows) * np.float32(scale)
            hidden = x @ embed
            logits = hidden @ soft + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(rows)), labels[rows]] -= 1
            chance /= len(rows)
            steps = (x.T @ (chance @ soft.T), hidden.T @ chance, chance.sum(axis=0))
            for weight, step, square in zip((embed, soft, bias), steps, past):
                square += step * step
                weight -= rate / (1 + epoch) ** 0.5 * 0.2 * step / np.sqrt(square)
    return Model(languages, (embed @ soft).astype(np.float64) * scale, bias.astype(np.float64))


def calibrate(model: Model, averages: Sparse, labels: np.ndarray, lost: float = 0.002) -> Model:
    """Set the sharpness that makes scores likely, and the score below which a text is rejected.

    At most a share ``lost`` of the calibration rows falls below it, and it is never above 0.5.
    """
    if not len(labels):
        return model
    parts = np.array_split(np.arange(len(labels)), -(-len(labels) // 64))
    logits = np.concatenate([model.logits(averages.dense(rows).astype(np.float64)) for rows in parts])
    grid = [2.0**k for k in range(-6, 4)]
    losses = []
    for model.sharpness in grid:
        own = model.softmax(logits)[np.arange(len(labels)), labels]
        losses.append(-np.log(np.maximum(own, 1e-12)).mean())
    model.sharpness = grid[int(np.argmin(losses))]
    best = model.softmax(logits).max(axis=1)
    model.threshold = min(0.5, float(np.quantile(best, lost)))
    return model


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, values = [], []
        for text in batch.column(2).to_pylist():
            hits = average(counts(text)).astype("<f4")
            places.append(np.flatnonzero(hits).astype("<u2").tobytes())
            values.append(hits[hits > 0].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
            names=["lang", "test", "places", "values"],
        )


def train(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "lang",
    rows: int = LANGUAGE_ROWS,
) -> Model:
    """Fit on rows with a label and a letter whose key's CRC-32 leaves a remainder other than 0.

    About ``rows`` of each language are used, chosen by hash, or as many as there are, and no
    language is left out. What reaches the driver grows with the languages, not with the data:
    the buckets that each row hits. A fifth of them calibrates.
    """
    known = docs.select(
        name(key).cast("string").alias("key"), name(text).alias("text"), name(label).cast("string").alias("lang")
    ).where((remainder(F.col("key")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    kinds = known.groupBy("lang").count().collect()
    found = {r["lang"]: r["count"] for r in kinds}
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    listed = [(lang, max(1, rows) / found[lang]) for lang in languages]
    shares = docs.sparkSession.createDataFrame(listed, "lang string, share double")
    chosen = known.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select(
        "lang", (F.pmod(F.xxhash64("key", F.lit("test")), F.lit(5)) == 0).alias("test"), "text"
    )
    sample = chosen.mapInArrow(_features, "lang string, test boolean, places binary, values binary").toArrow()
    held = sorted(zip(*(sample.column(i).to_pylist() for i in range(4))))
    del sample
    inputs = Sparse([np.frombuffer(x[2], "<u2") for x in held], [np.frombuffer(x[3], "<f4") for x in held])
    number = {x: i for i, x in enumerate(languages)}
    labels = np.array([number[x[0]] for x in held], dtype=np.int64)
    test = np.array([x[1] for x in held], dtype=bool)
    fitted = np.flatnonzero(~test) if (~test).any() else np.arange(len(test))
    model = fit(inputs.take(fitted), labels[fitted], languages)
    return calibrate(model, inputs.take(np.flatnonzero(test)), labels[test])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores, rejected = [], [], []
            for text in batch.column(1).to_pylist():
                if not model.languages or text is None or not LETTER.search(text):
                    languages.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                chances = model.chances(average(counts(text)))
                best = int(chances.argmax())
                languages.append(model.languages[best])
                scores.append(float(chances[best]))
                rejected.append(bool(chances[best] < model.threshold))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages), pa.array(scores, pa.float64()), pa.array(rejected)]
                + batch.columns[2:],
                names=["key", "lang_pred", "score", "rejected", *batch.schema.names[2:]],
            )

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, lang_pred, score, rejected.

    The language is that with the highest score, from the whole text. A null text and one
    without a letter (an empty one, too) are ``und`` with score 0 and rejected; so is every text
    if nothing was learned. Others are rejected below the model's threshold. Repeated rows are
    answered each; other columns are not read; an empty table gives no rows.
    """
    source = docs.select(name(key).alias("key"), name(text).cast("string").alias("body"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double, rejected boolean"
    return source.mapInArrow(_predict(model), schema)


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    source = docs.select(
        F.lit(0).alias("key"), name(text).cast("string").alias("body"), row_of(docs).alias("row")
    )
    schema = T.StructType(
        [
            T.StructField("key", T.IntegerType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
            source.schema["row"],
        ]
    )
    return source.mapInArrow(_predict(model), schema).where(~F.col("rejected")).select("row.*")
