"""Connectivity of channels and features of the graphs it makes."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.functions.signal import analytic, butter_bandpass, filtfilt, linear_detrend, slepian
from wavecrest.operators.quarantine import Outcome, guarded, signals

EDGES = "subject string, task string, i int, j int, w double"
_KEYS = ["subject", "task"]


def _by_recording(recordings: DataFrame):
    keyed = recordings.select(F.col("subject").cast("string"), F.col("task").cast("string"), F.col("ch_idx").cast("int"), "signal")
    return keyed.groupBy(*_KEYS)


def phase_lag_edges(recordings: DataFrame, sfreq: float = 500.0, lo: float | None = 8.0, hi: float | None = 13.0, detrend: bool = False) -> DataFrame:
    """What ``phase_lags`` gives for the recordings it works for."""
    return phase_lags(recordings, sfreq, lo, hi, detrend).good


def phase_lags(recordings: DataFrame, sfreq: float = 500.0, lo: float | None = 8.0, hi: float | None = 13.0, detrend: bool = False) -> Outcome:
    """Weighted phase-lag index of channel pairs i < j of each (subject, task); no band without ``lo``. ``detrend`` takes each channel's line off first.

    A group is one recording, whose channels are filtered once each; pairs are taken row by row.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ch, x = signals(pdf)
        x = linear_detrend(x) if detrend else x
        if lo is not None:
            x = filtfilt(*butter_bandpass(lo, hi, sfreq), x)
        z, out = analytic(x), []
        for i in range(len(z) - 1):
            im = np.imag(z[i] * np.conj(z[i + 1 :]))
            below = np.abs(im).mean(axis=1)
            w = np.where(below < 1e-15, 0.0, np.abs(im.mean(axis=1)) / np.maximum(below, 1e-300))
            out += [(*key, int(ch[i]), int(b), float(v)) for b, v in zip(ch[i + 1 :], w, strict=True)]
        return pd.DataFrame(out, columns=["subject", "task", "i", "j", "w"])

    return guarded(_by_recording(recordings), _KEYS, run, EDGES, "wpli")


def analytic_signals(recordings: DataFrame, sfreq: float = 500.0, lo: float = 8.0, hi: float = 13.0) -> DataFrame:
    """``recordings`` with re and im of the band-passed analytic signal instead of signal: what phase_lag_edges works on, to be kept or looked at."""

    @F.pandas_udf("re array<double>, im array<double>")
    def run(xs: pd.Series) -> pd.DataFrame:
        z = [None if x is None else analytic(filtfilt(*butter_bandpass(lo, hi, sfreq), np.asarray(x)))[0] for x in xs]
        return pd.DataFrame([(None, None) if v is None else (v.real, v.imag) for v in z], columns=["re", "im"])

    return recordings.withColumn("_z", run("signal")).select(*[c for c in recordings.columns if c != "signal"], "_z.re", "_z.im")


def entropy_bits(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def bin_numbers(x: np.ndarray, bins: int) -> np.ndarray:
    """Equal-width bins over a signal's range, the last one closed; a constant signal's range is one wide."""
    lo, hi = x.min(), x.max()
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    return np.minimum(np.floor((x - lo) / (hi - lo) * bins).astype(np.int64), bins - 1)


def mutual_information(recordings: DataFrame, bins: int | None = None) -> DataFrame:
    """What ``informations`` gives for the recordings it works for."""
    return informations(recordings, bins).good


def informations(recordings: DataFrame, bins: int | None = None) -> Outcome:
    """(subject, task, i, j, w) in bits over equal-width bins of each channel's own range, i <= j; i = j gives the entropy.

    Bins are the rounded root of the number of samples. A group is one recording, whose channels are binned once each;
    pairs are counted one by one.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        channels, x = signals(pdf)
        nb = bins or max(1, round(x.shape[1] ** 0.5))
        binned = [bin_numbers(row, nb) for row in x]
        single = [entropy_bits(np.bincount(b, minlength=nb)) for b in binned]
        ch, out = channels.tolist(), []
        for i, a in enumerate(binned):
            out.append((*key, ch[i], ch[i], single[i]))
            out += [(*key, ch[i], ch[j], single[i] + single[j] - entropy_bits(np.bincount(a * nb + binned[j], minlength=nb * nb))) for j in range(i + 1, len(binned))]
        return pd.DataFrame(out, columns=["subject", "task", "i", "j", "w"])

    return guarded(_by_recording(recordings), _KEYS, run, EDGES, "mi")


def mutual_information_edges(recordings: DataFrame, bins: int | None = None) -> DataFrame:
    """Mutual information of channel pairs i < j as edges, for strength, betweenness and features like any other edges."""
    return mutual_information(recordings, bins).where("i < j")


#: Measures of spectral_connectivity, and what each is between a channel and itself.
MEASURES = {"wpli": 0.0, "coh": 1.0, "plv": 1.0}


def spectral_connectivity(recordings: DataFrame, sfreq: float, lo: float, hi: float, epoch_sec: float = 2.0, overlap: float = 0.5, methods: Sequence[str] = ("wpli", "coh", "plv"), half_bandwidth: float = 4.0, diagonal: bool = False) -> DataFrame:
    """What ``spectral_measures`` gives for the recordings it works for."""
    return spectral_measures(recordings, sfreq, lo, hi, epoch_sec, overlap, methods, half_bandwidth, diagonal).good


def spectral_measures(recordings: DataFrame, sfreq: float, lo: float, hi: float, epoch_sec: float = 2.0, overlap: float = 0.5, methods: Sequence[str] = ("wpli", "coh", "plv"), half_bandwidth: float = 4.0, diagonal: bool = False) -> Outcome:
    """(subject, task, i, j, and a column for each of ``methods``) of channels i < j, and i = j if ``diagonal``: means over the band's bins of measures over epochs.

    An epoch, less its mean, has a spectrum for each Slepian taper; its cross-spectrum is their mean, weighted by the tapers' concentrations. ``wpli`` is the weighted phase-lag index, ``coh``
    coherence and ``plv`` the phase-locking value of the epochs' cross-spectra; a channel with itself has 0, 1 and 1. A recording shorter than an epoch, or a
    band without a bin, fails.
    """
    unknown = [m for m in methods if m not in MEASURES]
    if unknown or not methods:
        raise ValueError(f"methods are of {list(MEASURES)}, not {unknown}")
    n = int(round(epoch_sec * sfreq))
    tapers, weights = slepian(n, half_bandwidth)
    f = np.fft.rfftfreq(n, 1 / sfreq)
    band = (f >= lo) & (f <= hi)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ch, x = signals(pdf)
        if x.shape[1] < n:
            raise ValueError(f"{x.shape[1]} samples are less than an epoch of {n}")
        if not band.any():
            raise ValueError(f"no bin between {lo} and {hi}")
        epochs = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, :: max(1, int(round(n * (1 - overlap))))]
        epochs = epochs - epochs.mean(axis=2, keepdims=True)
        # channel, epoch, taper, bin; a taper at a time, so that only the band's bins are held
        z = np.stack([np.fft.rfft(epochs * taper, axis=2)[:, :, band] for taper in tapers], axis=2)
        share = (weights / weights.sum())[:, None]
        power, out = ((np.abs(z) ** 2) * share).sum(axis=2).mean(axis=1), []
        for i in range(len(z)):
            if diagonal:
                out.append((*key, int(ch[i]), int(ch[i]), *(MEASURES[m] for m in methods)))
            for j in range(i + 1, len(z)):
                s = (z[i] * np.conj(z[j]) * share).sum(axis=1)
                found = {}
                if "wpli" in methods:
                    below = np.abs(s.imag).mean(axis=0)
                    found["wpli"] = np.where(below < 1e-15, 0, np.abs(s.imag.mean(axis=0)) / np.maximum(below, 1e-300)).mean()
                if "coh" in methods:
                    found["coh"] = (np.abs(s.mean(axis=0)) / np.maximum(np.sqrt(power[i] * power[j]), 1e-300)).mean()
                if "plv" in methods:
                    found["plv"] = np.abs((s / np.maximum(np.abs(s), 1e-300)).mean(axis=0)).mean()
                out.append((*key, int(ch[i]), int(ch[j]), *(float(found[m]) for m in methods)))
        return pd.DataFrame(out, columns=["subject", "task", "i", "j", *methods])

    return guarded(_by_recording(recordings), _KEYS, run, "subject string, task string, i int, j int, " + ", ".join(f"{m} double" for m in methods), "spectral connectivity")


def matrices(edges: DataFrame) -> DataFrame:
    """(subject, task, nodes, matrix): edges i < j as symmetric matrices with a zero diagonal, rows in the order of ``nodes``."""
    both = edges.select("subject", "task", "i", "j", "w").union(edges.select("subject", "task", "j", "i", "w"))
    own = edges.select("subject", "task", F.explode(F.array("i", "j")).alias("i")).distinct().select("subject", "task", "i", F.col("i").alias("j"), F.lit(0.0).alias("w"))
    rows = both.union(own).groupBy("subject", "task", "i").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("r"))
    return rows.groupBy("subject", "task").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("m")).select("subject", "task", F.col("m.i").alias("nodes"), F.transform("m", lambda x: x["r"]["w"]).alias("matrix"))


def threshold(edges: DataFrame, least: float = 0.2) -> DataFrame:
    """Weights under ``least`` become 0; a weight equal to it stays."""
    return edges.withColumn("w", F.when(F.col("w") < least, 0.0).otherwise(F.col("w")))


def strength(edges: DataFrame) -> DataFrame:
    """(subject, task, node, strength): the sum of a node's weights, without threshold."""
    ends = edges.select("subject", "task", F.explode(F.array("i", "j")).alias("node"), "w")
    return ends.groupBy("subject", "task", "node").agg(F.sum("w").alias("strength"))


def brandes(n: int, edges: list[tuple[int, int, float]]) -> list[float]:
    """Betweenness of nodes of an undirected graph with lengths, not normalised."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, d in edges:
        near[i].append((j, d))
        near[j].append((i, d))
    out = [0.0] * n
    for s in range(n):
        dist, paths, before, order, heap, seen = {}, [0.0] * n, [[] for _ in range(n)], [], [(0.0, s, s)], {s: 0.0}
        paths[s] = 1.0
        while heap:
            d, u, v = heapq.heappop(heap)
            if v in dist:
                continue
            if v != s:
                paths[v] += paths[u]
            dist[v] = d
            order.append(v)
            for w, length in near[v]:
                e = d + length
                if w not in dist and (w not in seen or e < seen[w]):
                    seen[w] = e
                    heapq.heappush(heap, (e, v, w))
                    paths[w], before[w] = 0.0, [v]
                elif w not in dist and e == seen[w]:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = [0.0] * n
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] * (1 + share[w]) / paths[w]
            if w != s:
                out[w] += share[w] / 2
    return out


def betweenness(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """(subject, task, node, betweenness) of graphs of edges w > 0 with length 1 / w; nodes without edges have 0."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*pdf["i"], *pdf["j"]})
        at = {v: k for k, v in enumerate(nodes)}
        got = brandes(len(nodes), [(at[i], at[j], 1 / w) for i, j, w in zip(pdf["i"], pdf["j"], pdf["w"], strict=True) if w > 0])
        n = len(nodes)
        scale = 2 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
        return pd.DataFrame({"subject": key[0], "task": key[1], "node": nodes, "betweenness": [g * scale for g in got]})

    return edges.groupBy("subject", "task").applyInPandas(run, "subject string, task string, node int, betweenness double")


def graph_features(edges: DataFrame, least: float = 0.2) -> DataFrame:
    """(subject, task, features): betweenness after the threshold of each node in order, then strengths without it."""
    nodes = betweenness(threshold(edges, least)).join(strength(edges), ["subject", "task", "node"])
    rows = F.array_sort(F.collect_list(F.struct("node", "betweenness", "strength")))
    grouped = nodes.groupBy("subject", "task").agg(rows.alias("r"))
    return grouped.select("subject", "task", F.concat(F.transform("r", lambda x: x["betweenness"]), F.transform("r", lambda x: x["strength"])).alias("features"))


def graph_summary(edges: DataFrame, least: float = 0.2) -> DataFrame:
    """(subject, task, n_edges, density, connected) after the threshold; a graph is connected if its edges reach all its nodes."""

    def reached(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        root = {v: v for v in {*pdf["i"], *pdf["j"]}}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        for i, j in pdf.loc[pdf["w"] > 0, ["i", "j"]].itertuples(index=False):
            root[find(i)] = find(j)
        n = int((pdf["w"] > 0).sum())
        return pd.DataFrame({"subject": [key[0]], "task": [key[1]], "n_edges": [n], "density": [n / len(pdf)], "connected": [len({find(v) for v in root}) == 1]})

    return threshold(edges, least).groupBy("subject", "task").applyInPandas(reached, "subject string, task string, n_edges long, density double, connected boolean")


def top_nodes(nodes: DataFrame, measure: str, k: int = 5) -> DataFrame:
    """The k nodes of each (subject, task) with the largest ``measure``, ties by node."""
    rank = F.row_number().over(Window.partitionBy("subject", "task").orderBy(F.desc(measure), "node"))
    return nodes.withColumn("rank", rank).where(F.col("rank") <= k)
