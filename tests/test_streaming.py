"""Streams cut anywhere give what the whole table gives."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavecrest.functions.signal import welch
from wavecrest.operators.windows import label_runs
from wavecrest.streaming.state import stream_runs, stream_spectra

BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def streamed(spark, tmp_path, frames, schema, make):
    """The rows that ``make`` gives for micro-batches ``frames``, one file each."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, f in enumerate(frames):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = make(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert query.awaitTermination(150)
    return spark.read.parquet(str(tmp_path / "out"))


def test_runs_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "subject string, ts timestamp, t long, label string"
    rows = []
    for s in ("a", "b"):
        label = np.repeat(rng.choice(["x", "y", None], 30), rng.integers(1, 6, 30))
        rows += [(s, BEGIN + dt.timedelta(seconds=k), k, x) for k, x in enumerate(label)]
    rows.sort(key=lambda r: (r[1], r[0]))
    near = [r for k in range(0, len(rows), 8) for r in rows[k : k + 8][::-1]]  # out of order by some seconds
    end = [("end", BEGIN + dt.timedelta(days=1), 0, "z")]
    frames = [near[:7], near[7:50], near[50:53], near[53:], end]
    got = streamed(spark, tmp_path, frames, schema, lambda s: stream_runs(s, "1 hour", "20 seconds"))
    want = label_runs(spark.createDataFrame(rows, schema)).select("subject", "run", "label", "start_sample", "end_sample")
    found = sorted(map(tuple, got.select(*want.columns).collect()))
    numbered = pd.DataFrame(sorted(map(tuple, want.collect())), columns=want.columns)
    numbered["run"] = numbered.groupby("subject")["start_sample"].rank().astype(int)
    key = lambda r: (r[0], r[3])
    wanted = [(r.subject, r.run, None if pd.isna(r.label) else r.label, r.start_sample, r.end_sample) for r in numbered.itertuples()]
    assert sorted(found, key=key) == sorted(wanted, key=key) and len(found) > 30
    assert got.agg(F.sum("n")).first()[0] == len(rows)


@pytest.mark.parametrize("n,noverlap", [(700, None), (40, None), (300, 10)])
def test_spectra_of_a_stream_are_those_of_the_signal(spark, tmp_path, n, noverlap):
    rng = np.random.default_rng(n)
    schema = "subject string, task string, channel string, ts timestamp, first long, signal array<double>"
    x, after, rows = rng.normal(size=n), rng.normal(size=64), []
    edges = [0, *sorted(rng.choice(np.arange(1, n), 9, replace=False).tolist()), n]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows.append(("s", "t", "Cz", BEGIN + dt.timedelta(seconds=a), a, x[a:b].tolist()))
    rows.append(("s", "t", "Cz", BEGIN + dt.timedelta(seconds=n), n, None))
    late = [("s", "t", "Cz", BEGIN + dt.timedelta(hours=5), 0, after.tolist())]
    end = [("s", "t", "Pz", BEGIN + dt.timedelta(days=1), 0, [])]
    got = streamed(spark, tmp_path, [rows[:4], rows[4:][::-1] + late, end], schema, lambda s: stream_spectra(s, 64.0, 64, noverlap, gap="1 hour", late="30 minutes"))
    found = {r.n_samples: r for r in got.collect()}
    assert set(found) == {n, 64}
    for size, signal in ((n, x), (64, after)):
        freq, p = welch(signal, 64.0, 64, noverlap)
        assert found[size].freq == pytest.approx(freq) and found[size].p == pytest.approx(p, rel=1e-9)
