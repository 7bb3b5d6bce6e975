"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal, sparse dot products.

Features of a text are its word unigrams and bigrams, and unigrams to trigrams of the
words' shapes (letters, capitals, digits and each punctuation mark as classes, runs
collapsed, so that ``Ends!!`` and ``Starts!!`` agree), each hashed into 2^bits columns.
A feature's value is its count over the Euclidean norm of all counts.  ``same`` marks a
word that equals the one before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_with_ids, settle, tidy
from .words import Words, batches, mix, odd_weights, shapes_of, words_of

_SEED = odd_weights(8, 9)
_AT_ONCE = 1 << 17  # words whose features are in memory together


@dataclass(frozen=True)
class QualityParams:
    """The sample that the one training task holds has at most ``most_labelled`` rows, and no more
    of them than have ``most_entries`` features (8 bytes each; a text has at most 2^bits) in all.

    The sample is the labelled rows with the least seeded hashes, so it is the same
    whatever the partitions.  Everything else covers all rows.
    """

    bits: int = 18
    most_labelled: int = 4000
    most_entries: int = 1 << 23
    epochs: int = 10
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-5
    threshold: float = 0.3
    seed: int = 9


def _keys(h: np.ndarray, s: np.ndarray, room: np.ndarray, text: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Text and hashed column of every n-gram that starts in the first ``n`` words, as one number."""
    with np.errstate(over="ignore"):
        one, two, three = np.arange(n), np.flatnonzero(room[:n] >= 2), np.flatnonzero(room[:n] >= 3)
        same = two[h[two] == h[two + 1]]
        grams = (
            (h[one], one),
            (mix(h[two] * _SEED[5]) + h[two + 1], two),
            (s[one], one),
            (mix(s[two] * _SEED[6]) + s[two + 1], two),
            (mix(mix(s[three] * _SEED[6]) + s[three + 1]) + s[three + 2], three),
            (np.full(len(same), 1, np.uint64), same),
        )
        parts = []
        for k, (values, at) in enumerate(grams):
            column = mix(values * _SEED[k] + np.uint64(k)) >> np.uint64(64 - bits)
            parts.append((text[at].astype(np.uint64) << np.uint64(bits)) | column)
    return np.concatenate(parts)


def features_of(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR form: columns, values, first entry of each text.  A text without words has no entries.

    Words are taken ``_AT_ONCE`` at a time, so memory beyond the words and the result is bounded.
    """
    h, s, room = words.hash, shapes_of(words), words.room()
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at in range(0, len(h), _AT_ONCE):
        to = min(at + _AT_ONCE, len(h))
        key, count = np.unique(_keys(h[at : to + 2], s[at : to + 2], room[at : to + 2], text[at : to + 2], to - at, bits), return_counts=True)
        if len(keys) and len(keys[-1]) and keys[-1][-1] >= key[0]:  # a text that goes on: add to its counts
            cut = int(np.searchsorted(keys[-1], key[0] >> np.uint64(bits) << np.uint64(bits)))
            both, place = np.unique(np.concatenate([keys[-1][cut:], key]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([counts[-1][cut:], count]), len(both)).astype(np.int64)
            keys[-1], counts[-1], key, count = keys[-1][:cut], counts[-1][:cut], both, sums
        keys.append(key)
        counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    row, col = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.searchsorted(row, np.arange(len(words.counts) + 1))
    norm = np.sqrt(np.bincount(row, count.astype(np.float64) ** 2, len(words.counts)))
    return col, count / norm[row], first


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last weight is the bias."""

    def __init__(self, params: QualityParams):
        self.p = params
        size = (1 << params.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, p = self.z[at], self.p
        shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
        return -shrunk / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)

    def learn(self, col: np.ndarray, value: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(col)
        g = importance * (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[col]
        self.z[col] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[col] = n + g * g


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], params: QualityParams) -> np.ndarray:
    """Weights (float32) learnt in seeded orders from (columns, values) of each text, rarer labels
    weighing more; all zero without examples."""
    model = Ftrl(params)
    bias = 1 << params.bits
    rng = np.random.default_rng(params.seed)
    share = np.bincount(np.asarray(labels, int), minlength=2)[:2] / max(len(labels), 1)
    importance = 0.5 / np.maximum(share, 0.05)  # both classes weigh alike
    for _ in range(params.epochs):
        for d in rng.permutation(len(labels)):
            col, value = examples[d]
            model.learn(np.append(col, bias), np.append(value, 1.0), labels[d], importance[labels[d]])
    return model.weights().astype(np.float32)


def _examples(params: QualityParams):
    """Each sample text as its features, worked out where the text lies: the training task gets no text."""

    def run(it):
        for batch in batches(it):
            col, value, first = features_of(words_of(batch.column("text")), params.bits)
            rows = list(zip(first[:-1].tolist(), first[1:].tolist()))
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([b - a for a, b in rows], pa.int64()),
                    pa.array([col[a:b].astype(np.int32).tobytes() for a, b in rows], pa.binary()),
                    pa.array([value[a:b].astype(np.float32).tobytes() for a, b in rows], pa.binary()),
                ],
                ["id", "label", "entries", "col", "value"],
            )

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, params: QualityParams, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, label, entries, col, value`` (written) of the labelled rows that training may use.

    Rows of ``labels`` with a null id or label, or without a document, are ignored; of several
    labels for an id the larger counts, of several texts the one with the least sha256.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    own = own.filter("id is not null and label in (0, 1)").filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id", F.lit(params.seed))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    there = texts.select("id").filter("id is not null").distinct()
    sample = settle(own.join(there, "id", "left_semi").orderBy(order, "id").limit(params.most_labelled), "labelled")
    held = rows_with_ids(texts, sample.select("id"), "id")
    one = held.groupBy("id").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    rows = one.join(F.broadcast(sample), "id").select("id", "label", "text")
    return settle(rows.mapInArrow(tidy(_examples(params)), "id long, label int, entries long, col binary, value binary"), "examples")


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """Train in one task on the bounded sample; it holds features only, ``most_entries`` at most."""
    examples = labelled_sample(docs, labels, params, id_col, text_col, label_col)
    order = Window.orderBy(F.xxhash64("id", F.lit(params.seed)), "id")  # over the sample's ids and sizes, at most most_labelled rows
    fits = examples.select("id", F.sum("entries").over(order).alias("total")).filter(F.col("total") <= max(params.most_entries, 1 << params.bits))
    rows = examples.join(F.broadcast(fits.select("id")), "id", "left_semi").select("id", "label", "col", "value")

    def run(it):
        held = []
        for batch in it:
            cols, values = ([np.frombuffer(x.as_py(), kind) for x in batch.column(c)] for c, kind in (("col", np.int32), ("value", np.float32)))
            held += zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), cols, values)
        held.sort(key=lambda r: r[0])
        w = train([(c, v) for _, _, c, v in held], [label for _, label, _, _ in held], params)
        yield pa.record_batch([pa.array([w.tobytes()], pa.binary())], ["w"])

    trained = settle(rows.repartition(1).mapInArrow(tidy(run), "w binary"), "weights").collect()
    return np.frombuffer(trained[0].w, np.float32) if trained else np.zeros((1 << params.bits) + 1, np.float32)


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row ``doc_id, held_out, score, predicted``, and the columns of ``carry``.

    Whole texts are scored; null and empty ones get the bias alone.  held_out: crc32 of the
    id's decimal text leaves 0 modulo 5 (false for a null id); labels of such rows are never
    used.  predicted: 1 from ``params.threshold`` on.  Without any label every score is 0.5.
    Ids may repeat: the score is the text's, and a label of a repeated id goes with the text of
    the least sha256.  ``carry`` names columns that come along under names ``carry_0, carry_1, ...``;
    other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, params, id_col, text_col, label_col))

    kept = [F.col(f"`{c}`").alias(f"carry_{k}") for k, c in enumerate(carry)]
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *kept)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), *source.schema.fields[2:]])

    def run(it):
        w = weights.value
        for batch in batches(it):
            col, value, first = features_of(words_of(batch.column("text")), params.bits)
            total = np.concatenate([[0.0], np.cumsum(w[col] * value)])
            score = 1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + w[-1], -35, 35)))
            yield pa.record_batch([batch.column("id"), pa.array(np.round(score, 6)), *batch.columns[2:]], schema.names)

    return source.mapInArrow(tidy(run), schema).select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
        *schema.names[2:],
    )
