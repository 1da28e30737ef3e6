"""Language identification: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavecrest.llm.common import text_slices, utf8

#: Families of language codes. A code that is not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
BINS = 1 << 13
UND = "und"


def family(code: str) -> str:
    return _FAMILY_OF.get(code.lower().replace("_", "-").split("-")[0], code)


def gram_bins(data: np.ndarray, n: int) -> np.ndarray:
    """The bin of the n bytes from each position but the last n - 1."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.uint32)
    for k in range(n):
        code = code << np.uint32(8) | data[k : len(data) - n + 1 + k]
    return ((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - 13)).astype(np.int64)


def padded(text) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with ASCII digits and marks as spaces, two spaces around each text; and offsets."""
    n = len(text.offsets) - 1
    offsets = text.offsets + 4 * np.arange(n + 1)
    out = np.full(offsets[-1], 32, np.uint8)
    keep = np.arange(len(text.data)) + np.repeat(4 * np.arange(n) + 2, np.diff(text.offsets))
    letter = (text.data >= 128) | ((text.data >= 97) & (text.data <= 122))
    out[keep] = np.where(letter, text.data, 32)
    return out, offsets


def gram_means(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per text, the mean over its 2-grams and 3-grams of each row of ``weights`` (models, BINS)."""
    out = np.zeros((len(offsets) - 1, len(weights)))
    at = np.minimum(offsets[:-1], max(0, len(data) - 1))
    for n in (2, 3):
        # every text ends in two spaces, so grams that begin there hold the next text's spaces only, and the last text gets as many
        bins = gram_bins(np.append(data, np.full(n - 1, 32, np.uint8)), n)
        for k, row in enumerate(weights):
            out[:, k] += np.add.reduceat(row[bins], at) if len(data) else 0
    return out / np.maximum(2 * np.diff(offsets), 1)[:, None]


class GramRows(NamedTuple):
    """Shares of a text's grams by bin, for each text: ``bins`` and ``shares`` from ``first[i]`` to ``first[i + 1]``."""

    first: np.ndarray
    bins: np.ndarray
    shares: np.ndarray


def gram_rows(data: np.ndarray, offsets: np.ndarray) -> GramRows:
    bins, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, n = np.unique(np.concatenate([gram_bins(data[a:b], k) for k in (2, 3)]), return_counts=True)
        bins.append(own)
        shares.append(n / max(n.sum(), 1))
    return GramRows(np.cumsum([len(x) for x in bins]), np.concatenate(bins), np.concatenate(shares))


def train_svm(x: GramRows, rows: np.ndarray, y: np.ndarray, c: float = 1.0, passes: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM with hinge loss by dual coordinate descent over some rows of x; y is 1 or -1."""
    rng = np.random.default_rng(seed)
    alpha, w = np.zeros(len(y)), np.zeros(BINS)
    own = [(x.bins[x.first[i] : x.first[i + 1]], x.shares[x.first[i] : x.first[i + 1]]) for i in rows.tolist()]
    norm = [max(float(v @ v), 1e-12) for _, v in own]
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            bins, v = own[i]
            new = min(max(alpha[i] - (y[i] * (v @ w[bins]) - 1) / norm[i], 0.0), c)
            if new != alpha[i]:
                w[bins] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * c:
            break
    return w


class LanguageModel:
    """One-versus-one machines between families, and within each family between its languages."""

    def __init__(self, texts: list[str], langs: list[str], c: float = 1.0):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        x = gram_rows(*padded(utf8(pa.array(texts, pa.string()))))
        lengths = np.sqrt(np.add.reduceat(x.shares**2, x.first[:-1])) if len(texts) else np.zeros(0)
        self.scale = 1 / max(float(lengths.mean()), 1e-9) if len(texts) else 1.0
        x = x._replace(shares=x.shares * self.scale)
        self.machines: dict[tuple, int] = {}
        rows = []
        own = np.array([family(y) for y in langs])
        lang = np.array(langs)
        for level, names, labels in [("family", self.families, own), *[(f, m, lang) for f, m in self.members.items()]]:
            for a, b in combinations(names, 2):
                chosen = np.flatnonzero((labels == a) | (labels == b))
                self.machines[level, a, b] = len(rows)
                rows.append(train_svm(x, chosen, np.where(labels[chosen] == a, 1.0, -1.0), c))
        self.weights = (np.array(rows) * self.scale if rows else np.zeros((0, BINS))).astype(np.float32)

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes, ties by the sum of squashed margins; and the mean chance against its rivals."""
        if len(names) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        chance = np.zeros((len(margins), len(names)))
        votes = np.zeros((len(margins), len(names)))
        for a, b in combinations(range(len(names)), 2):
            p = 1 / (1 + np.exp(-2 * np.clip(margins[:, self.machines[level, names[a], names[b]]], -30, 30)))
            chance[:, a] += p
            chance[:, b] += 1 - p
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
        best = np.argmax(votes + chance / (2 * len(names)), axis=1)
        return best, chance[np.arange(len(best)), best] / (len(names) - 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UND] * n, np.zeros(n)
        margins = gram_means(*padded(utf8(texts)), self.weights)
        best, score = self._vote("family", self.families, margins)
        out = np.empty(n, object)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(best == k)
            if len(own):
                inner, chance = self._vote(f, self.members[f], margins[own])
                out[own] = np.array(self.members[f], object)[inner]
                score[own] *= chance
        letters = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        out[~letters] = UND
        return out.tolist(), np.where(letters, score, 0.0)


def fit_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 500, sample_bytes: int = 128 << 20, seed_col: str = "doc_id") -> LanguageModel:
    """A model learned from at most ``per_language`` rows of each language, those with the least hashes.

    Rows need a language and a text of at least a byte and at most an even share of ``sample_bytes`` (64 KiB for
    four languages), so the driver gets at most so many bytes of text, however many languages there are. A language whose texts are all longer than that
    is learned from the shortest of its rows (of some four times ``per_language``) that together keep within its part of ``sample_bytes``; it is left out only if none does.
    """
    size = F.octet_length(text_col)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(seed_col)).alias("h"), size.alias("size"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()  # one row a language
    if not sizes:
        return LanguageModel([], [])
    share = sample_bytes // (len(sizes) * per_language)
    budget = share * per_language
    # an even cut of the hash's range first, so that ranking sees few rows
    cut = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, 4 * per_language / r["n"]) * (1 << 20)) + 1)])
    most = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], budget if (r["least"] or 0) > share else share)])
    near = rows.where((F.pmod("h", F.lit(1 << 20)) < cut[F.col("lang")]) & (F.col("size") >= 1) & (F.col("size") <= most[F.col("lang")]))
    order = Window.partitionBy("lang").orderBy(F.when(most[F.col("lang")] > share, F.col("size")), "h", "text")
    ranked = near.withColumns({"k": F.row_number().over(order), "used": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))}).where((F.col("k") <= per_language) & (F.col("used") <= budget))
    sample = ranked.orderBy("lang", "k").select("text", "lang").collect()
    return LanguageModel([r[0] for r in sample], [r[1] for r in sample])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` (lang_pred, score).

    Every whole text is read. A null text, and one without a letter, is ``und`` with score 0; any
    text is ``und`` if the model has learned no language. A column named ``into`` is replaced.
    """
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageModel.__new__(LanguageModel)
        vars(known).update(shared.value)
        for batch in text_slices(batches, at):
            lang, score = known.predict(batch.column(names.index(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    out = docs.toDF(*names).mapInArrow(run, T.StructType([*fields, *T.StructType.fromDDL("lang_pred string, score double").fields]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.struct("lang_pred", "score").alias(into))
