"""Runs of labels and Welch spectra over streams; what a later micro-batch needs is kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavecrest.functions.signal import welch, window

#: What a step gets and gives: the state's values (None for none), rows in order, whether what is open must end; then rows of the result and the state's values.
Step = Callable[[tuple | None, pd.DataFrame, bool], tuple[list[tuple], tuple | None]]


def _packed(rows: pd.DataFrame) -> bytes | None:
    if not len(rows):
        return None
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> list[pd.DataFrame]:
    return [] if data is None else [pa.ipc.open_stream(data).read_pandas()]


def scanned(rows: DataFrame, by: list[str], order: str, value: str, gap: str, late: str, carry: str, out: str, step: Step) -> DataFrame:
    """Rows of each sequence ``by`` through ``step``, in order of (ts, ``order``), whatever micro-batch they come in.

    Rows wait in the state until the watermark, ``late`` behind the newest ts, has passed them, so a sequence's state is what comes in that time and ``carry``, whose last field is the
    latest ts in milliseconds. Later rows are dropped. Once the watermark is ``gap`` beyond a sequence's last row, a timer ends what is open and the state goes. Rows without a ts are left out.
    """
    pause = int(pd.Timedelta(gap).total_seconds() * 1000)
    fields, names = carry.split(", "), [*by, *(c.split()[0] for c in out.split(", "))]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None,) * (len(fields) + 1)
        kept = None if held[-1] is None else tuple(held[1:])
        passed = state.getCurrentWatermarkMs()
        parts = _unpacked(held[0]) + ([] if state.hasTimedOut else [b[["ms", order, value]] for b in batches])
        waiting = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"ms": np.zeros(0, np.int64), order: np.zeros(0, np.int64), value: []})
        waiting = waiting.sort_values(["ms", order], kind="stable")
        now = waiting["ms"] < passed
        found, kept = step(kept, waiting[now], False) if now.any() else ([], kept)
        waiting = waiting[~now]
        if kept is not None and kept[-1] + pause < passed:
            more, kept = step(kept, waiting[:0], True)
            found += more
        if kept is None and not len(waiting):
            if state.exists:
                state.remove()
        else:
            state.update((_packed(waiting), *(kept or (None,) * len(fields))))
            state.setTimeoutTimestamp(max(passed + 1, min([*waiting["ms"].head(1).tolist(), *([kept[-1] + pause + 1] if kept else [])])))
        if found:
            yield pd.DataFrame([(*key, *r) for r in found], columns=names)

    keyed = rows.where("ts is not null").withWatermark("ts", late).select(*[F.col(c).cast("string").alias(c) for c in by], "ts", F.unix_millis("ts").alias("ms"), F.col(order).cast("long").alias(order), value)
    kinds = ", ".join(f"{c} string" for c in by)
    return keyed.groupBy(*by).applyInPandasWithState(run, f"{kinds}, {out}", f"ahead binary, {carry}", "append", GroupStateTimeout.EventTimeTimeout)


def stream_runs(labels: DataFrame, gap: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """(subject, [task,] run, label, start_sample, end_sample, n) of maximal runs of equal labels in a stream of (subject, [task,] ts, t, label).

    The same as ``windows.label_runs`` for a sequence without pauses; a pause longer than ``gap`` ends a run too. A run is given once the next has begun or a timer has ended
    it. Numbers go on while a sequence has state, and begin at 1 again after such a pause. Nulls are a label like others; several rows of one t count each.
    """
    pause = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(kept: tuple | None, rows: pd.DataFrame, end: bool) -> tuple[list[tuple], tuple | None]:
        found = []
        if len(rows):
            ms, t = rows["ms"].to_numpy(), rows["t"].to_numpy()
            label = rows["label"].astype(object).where(rows["label"].notna(), None).to_numpy()
            new = np.ones(len(rows), bool)
            new[1:] = (label[1:] != label[:-1]) | (np.diff(ms) > pause)
            first = np.flatnonzero(new)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=True):
                rest = kept is not None and ms[a] - kept[-1] > pause
                if kept is not None and kept[1] == label[a] and not rest:
                    kept = (kept[0], kept[1], min(kept[2], int(t[a:b].min())), max(kept[3], int(t[a:b].max()) + 1), kept[4] + b - a, int(ms[b - 1]))
                    continue
                if kept is not None:
                    found.append(kept[:-1])
                number = 1 if kept is None or rest else kept[0] + 1
                kept = (number, label[a], int(t[a:b].min()), int(t[a:b].max()) + 1, b - a, int(ms[b - 1]))
        if end and kept is not None:
            found, kept = [*found, kept[:-1]], None
        return found, kept

    by = [c for c in ("subject", "task") if c in labels.columns]
    named = labels.withColumn("label", F.col("label").cast("string"))
    out = "run long, label string, start_sample long, end_sample long, n long"
    return scanned(named, by, "t", "label", gap, late, "run long, label string, first long, last long, n long, ms long", out, step)


def stream_spectra(chunks: DataFrame, sfreq: float, nperseg: int = 1024, noverlap: int | None = None, name: str = "hann", gap: str = "1 hour", late: str = "1 minute") -> DataFrame:
    """(subject, task, channel, n_samples, n_segments, freq, p): Welch spectra of signals that come as chunks (subject, task, channel, ts, first, signal).

    A chunk's samples follow those of the chunk before in order of (ts, first), however they are cut. The state is the sum of the segments' spectra and the samples that the next segment needs. A signal ends, and
    has its row, after a pause longer than ``gap``; what comes then is a new one. It is the spectrum that ``signal.welch`` gives for the whole, and that of all samples where there are fewer than ``nperseg``.
    Null and empty chunks add nothing; a signal without a sample has no row.
    """
    pause = int(pd.Timedelta(gap).total_seconds() * 1000)
    overlap = min(nperseg // 2 if noverlap is None else noverlap, nperseg - 1)
    weights, hop = window(name, nperseg), nperseg - overlap

    def ended(kept: tuple) -> list[tuple]:
        tail, total, segments, samples, _ = kept
        if not samples:
            return []
        if not segments:
            freq, p = welch(np.asarray(tail, float), sfreq, nperseg, noverlap, name)
            return [(samples, 1, freq.tolist(), p.tolist())]
        p = np.asarray(total, float) / segments / (sfreq * (weights * weights).sum())
        p[1 : len(p) - (nperseg % 2 == 0)] *= 2
        return [(samples, segments, np.fft.rfftfreq(nperseg, 1 / sfreq).tolist(), p.tolist())]

    def step(kept: tuple | None, rows: pd.DataFrame, end: bool) -> tuple[list[tuple], tuple | None]:
        found = []
        for ms, x in zip(rows["ms"].tolist(), rows["signal"], strict=True):
            if kept is not None and ms - kept[-1] > pause:
                found, kept = found + ended(kept), None
            tail, total, segments, samples, _ = kept or ([], np.zeros(nperseg // 2 + 1), 0, 0, 0)
            own = np.zeros(0) if x is None else np.asarray(x, float)
            x = np.concatenate((np.asarray(tail, float), own))
            total = np.asarray(total, float)
            if len(x) >= nperseg:
                parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop]
                total = total + (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * weights, axis=1)) ** 2).sum(axis=0)
                segments, x = segments + len(parts), x[hop * len(parts) :]
            kept = (x.tolist(), total.tolist(), segments, samples + len(own), ms)
        if end and kept is not None:
            found, kept = found + ended(kept), None
        return found, kept

    out = "n_samples long, n_segments long, freq array<double>, p array<double>"
    return scanned(chunks, ["subject", "task", "channel"], "first", "signal", gap, late, "tail array<double>, total array<double>, segments long, samples long, ms long", out, step)
