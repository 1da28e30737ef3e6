"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecrest.llm.common import mix, range_hashes, text_slices, utf8, words

#: A word's terms: itself, and its first bytes where it has more.
PREFIXES = (4, 5, 6)


def terms(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text number, hash) of all terms, one pair of arrays for each kind of term."""
    text = utf8(texts)
    found = words(text)
    doc = np.repeat(np.arange(len(texts)), np.diff(found.first))
    out = [(doc, range_hashes(text.data, found.starts, found.ends))]
    for n in PREFIXES:
        longer = found.ends - found.starts > n
        starts = found.starts[longer]
        out.append((doc[longer], mix(range_hashes(text.data, starts, starts + n) + np.uint64(n))))
    return out


class FactorizationMachine:
    """score = sigmoid(b + sum of w over a text's terms + sum of <v_i, v_j> over its pairs of terms)."""

    def __init__(self, hashes: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.bias, self.weights, self.factors = hashes[order], bias, weights[order], factors[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        docs, slots = [], []
        for doc, h in terms(texts) if len(self.hashes) else []:
            maybe = self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)]
            doc, h = doc[maybe], h[maybe]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[k] == h
            docs.append(doc[known])
            slots.append(k[known])
        z = np.full(n, self.bias)
        if docs:
            pairs = np.unique(np.stack((np.concatenate(docs), np.concatenate(slots)), 1), axis=0)
            doc, slot = pairs[:, 0], pairs[:, 1]
            z += np.bincount(doc, self.weights[slot], n)
            for f in range(self.factors.shape[1]):
                v = self.factors[slot, f]
                z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(labels: np.ndarray, docs: np.ndarray, hashes: np.ndarray, most_terms: int = 1024, rank: int = 4, steps: int = 300, least_docs: int = 3, decay: float = 1e-4, least_chi2: float = 30.0, seed: int = 7) -> FactorizationMachine:
    """Learns from distinct (text number, hash) pairs of labelled texts.

    Terms are those that at least ``least_docs`` texts have and whose chi-square against the label
    is at least ``least_chi2``, at most ``most_terms`` of them. Without both labels the machine
    gives the label's share to every text, 0 without any.
    """
    n, positive = len(labels), float(labels.sum())
    none = np.zeros(0, np.uint64)
    if not n or positive in (0, n):
        share = positive / n if n else 0.0
        return FactorizationMachine(none, 20.0 if share else -20.0, np.zeros(0), np.zeros((0, rank)))
    known, slot = np.unique(hashes, return_inverse=True)
    all_ = np.bincount(slot, minlength=len(known)).astype(float)
    pos = np.bincount(slot, labels[docs], len(known))
    rest = n - all_
    cross = pos * (n - positive - (all_ - pos)) - (all_ - pos) * (positive - pos)
    chi2 = n * cross**2 / np.maximum(positive * (n - positive) * all_ * rest, 1e-9)
    chosen = np.flatnonzero((all_ >= least_docs) & (chi2 >= least_chi2))
    chosen = chosen[np.lexsort((known[chosen], -chi2[chosen]))][:most_terms]
    column = np.full(len(known), -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[slot] >= 0
    x = np.zeros((n, len(chosen)), np.float32)
    x[docs[keep], column[slot[keep]]] = 1
    rng = np.random.default_rng(seed)
    p = np.concatenate((np.zeros((len(chosen), 1)), rng.normal(0, 0.05, (len(chosen), rank))), axis=1).astype(np.float32)
    bias, m, s, mb, sb = 0.0, np.zeros_like(p), np.zeros_like(p), 0.0, 0.0
    for t in range(1, steps + 1):
        z = x @ p
        total = z[:, 1:]
        score = bias + z[:, 0] + 0.5 * ((total * total).sum(axis=1) - x @ (p[:, 1:] ** 2).sum(axis=1))
        miss = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels).astype(np.float32) / n
        grad = x.T @ np.concatenate((miss[:, None], miss[:, None] * total), axis=1)
        grad[:, 1:] -= p[:, 1:] * (x.T @ miss)[:, None]
        grad += decay * p
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * miss.sum(), 0.999 * sb + 0.001 * miss.sum() ** 2
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        bias -= 0.05 * float(mb / (1 - 0.9**t)) / (float(np.sqrt(sb / (1 - 0.999**t))) + 1e-8)
    return FactorizationMachine(known[chosen], bias, p[:, 0].astype(float), p[:, 1:].astype(float))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 3000, sample_bytes: int = 96 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """A machine learned from at most ``per_label`` labelled ids of each label, those with the least hashes.

    Ids are chosen from ``labels`` alone (0 and 1 count, other labels and null ids don't; of an id with both, 1 counts), so their
    number is bounded before any text is read. Texts of more than an even share of ``sample_bytes`` (16 KiB) aren't
    learned from, and an id of several rows has one text, the first in order, so the driver gets the terms of ``sample_bytes`` of text at most.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("id"))
    rows = [r for label in (0, 1) for r in known.where(F.col("label") == label).orderBy("h", "id").limit(per_label).select("id", "label").collect()]
    if not rows:
        return train(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    chosen = docs.sparkSession.createDataFrame(rows, "id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes // (2 * per_label))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most 2 * per_label rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            kinds = terms(batch.column(batch.schema.get_field_index("text")))
            doc, h = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
            pairs = np.unique(np.stack((doc.astype(np.uint64), h), 1), axis=0)
            ends = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("label")), lists], names=["id", "label", "terms"])

    rows = found.mapInArrow(run, "id long, label int, terms array<long>").toArrow().sort_by("id").combine_chunks()
    if not rows.num_rows:
        return train(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    lists = pa.concat_arrays(rows.column("terms").chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    return train(rows.column("label").to_numpy().astype(float), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().view(np.uint64))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a double ``into``: the chance of label 1, from every whole text.

    Null and empty texts have no terms and get the score of the bias alone. A column named ``into``
    is replaced; other columns and repeated rows are kept as they are.
    """
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FactorizationMachine.__new__(FactorizationMachine)
        vars(known).update(shared.value)
        for batch in text_slices(batches, at):
            score = known.score(batch.column(names.index(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    out = docs.toDF(*names).mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.col("score").alias(into))
