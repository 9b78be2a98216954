"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are cut at ASCII white space. Each word gives two tokens: its letters and digits in lower case,
and its shape (letter case, digits, the marks before and after). Features are single tokens and pairs
of neighbours of either kind, and words equal to the one before, hashed to ``2 ** BITS`` slots, with counts scaled to unit length; one
more group of slots holds the share of word pairs that occurred before in the document, in tenths.
A score is the logistic function of the sparse dot product with the weights.

Training takes a bounded sample, ``MAX_TRAIN`` labelled rows with the smallest hashes of their ids. It
is dealt by hash to ``SHARDS`` groups, each goes through its rows ``EPOCHS`` times, and the weights are
averaged. Only the weights (1 MB a shard, whatever the input) pass the driver, and only they are sent
to the tasks. Everything else covers all rows and whole texts.

Defined results: null and empty texts are scored by the bias and the repeat group; labels that are
null or not 0/1 are no training rows; an id labelled twice counts with its smaller label; a null id is
never held out; repeated rows are scored each; without any training rows all scores are 0.5.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import mix64

BITS = 18
MAX_TRAIN = 20_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-6, 1e-6
KEEP_AT = 0.7
REPEATS = 11  # slots after the hashed ones, by tenths of repeated word pairs
SLOTS = (1 << BITS) + REPEATS
CORE = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def _shape(core: str) -> str:
    if not core:
        return "-"
    if core.isdigit():
        return "9"
    if core.isupper():
        return "A" if len(core) == 1 else "AA"
    if core.islower():
        return "a"
    return "Aa" if core[0].isupper() and core[1:].islower() else "x"


class Tokens(dict):
    """The two hashed tokens of a word, remembered while there are not too many."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> tuple[int, int]:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        before, core, after = CORE.match(word).groups() if len(word) < 200 else ("", word, "")
        shape = f"{before[:3]}{_shape(core)}{after[:3]}"
        self[word] = value = (xxhash.xxh3_64_intdigest(core.lower()), xxhash.xxh3_64_intdigest("\x00" + shape))
        return value


def features(text: str | None, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and their values for one text."""
    words = (text or "").split()
    pairs = np.fromiter((h for w in words for h in tokens[w]), np.uint64, 2 * len(words)).reshape(-1, 2)
    parts, repeated = [], 0
    for column, salt in ((0, 1), (1, 2)):
        h = pairs[:, column]
        two = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt))
        parts += [mix64(h + np.uint64(salt)), two]
        if column == 0 and len(two):
            repeated = int(10 * (1 - len(np.unique(two)) / len(two)))
            parts.append(mix64(np.full(int((h[1:] == h[:-1]).sum()), 3, np.uint64)))  # the same word again
    slots, counts = np.unique(np.concatenate(parts) >> np.uint64(64 - BITS), return_counts=True)
    values = np.sqrt(counts)
    values /= max(float(np.sqrt((values**2).sum())), 1e-12)
    return np.append(slots.astype(np.int64), (1 << BITS) + repeated), np.append(values, 1.0)


class Ftrl:
    """Follow-the-regularised-leader, per coordinate; the last slot is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        out = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, out)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, SLOTS), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("order", "ascending"), ("text", "ascending")])
    tokens, model = Tokens(), Ftrl()
    examples = [(*features(t, tokens), y) for t, y in zip(rows["text"].to_pylist(), rows["quality"].to_pylist(), strict=True)]
    for _ in range(EPOCHS):
        for slots, values, label in examples:
            model.learn(slots, values, label)
    return pa.table({"n": [len(examples)], "weights": [model.weights().astype(np.float32).tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = MAX_TRAIN) -> np.ndarray:
    """Weights learned from the labelled documents for which ``train`` holds."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if train is not None:
        marks = marks.filter(train)
    marks = marks.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # At most max_rows short rows, so the broadcast is bounded.
    sample = marks.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    shards = rows.select("order", "text", "quality", F.pmod("order", F.lit(SHARDS)).alias("shard")).groupBy("shard")
    learned = shards.applyInArrow(_train_shard, "n long, weights binary").collect()
    if not learned:
        return np.zeros(SLOTS + 1, np.float32)
    total = sum(r.n for r in learned)
    ordered = sorted(learned, key=lambda r: bytes(r.weights))  # the same sum whatever order they come in
    return np.sum([np.frombuffer(r.weights, np.float32) * (r.n / total) for r in ordered], axis=0)


def with_scores(docs: DataFrame, weights: np.ndarray, name: str = "score", text: str = "text") -> DataFrame:
    """The documents with one more column, the chance that the quality label is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))
    schema = docs.withColumn(name, F.lit(0.0)).schema
    at = docs.columns.index(text)

    def score(batches):
        w, tokens = shared.value, Tokens()
        for batch in batches:
            out = []
            for value in batch.column(at):
                slots, values = features(value.as_py(), tokens)
                out.append(1 / (1 + np.exp(-np.clip(w[slots] @ values + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the quarter that is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = fit(docs, labels, ~held_out(F.col("doc_id")))
    return with_scores(docs.select("doc_id", "text"), weights).select("doc_id", "score")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return trained_scores(docs, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The documents the classifier does not reject, with the columns they had."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    weights = fit(docs, labels, ~held_out(F.col("doc_id")))
    return with_scores(docs, weights, name).filter(F.col(name) >= at).drop(name)
