"""Large NPY and MAT files: planned, cut, chosen and damaged."""

import json
import struct
import zlib

import numpy as np
import pytest

from tests.test_operators import mat_file
from wavecrest.sources import matrices as M
from wavecrest.sources import recordings as R


def planned(path, kind, **options):
    return M.MatrixReader({"path": str(path), "kind": kind} | {k: str(v) for k, v in options.items()}).partitions()


def signals(outcome):
    return {(r.subject, r.task, r.ch_idx): np.array(r.signal) for r in outcome.good.collect()}


def same(got, x, subject, task):
    assert {k for k in got if k[:2] == (subject, task)} == {(subject, task, c) for c in range(len(x))}
    assert all((got[subject, task, c] == row).all() for c, row in enumerate(x))


@pytest.mark.parametrize(("order", "dtype", "samples", "channels"), [("C", "<f4", 100_001, 3), ("F", ">f8", 70_000, 3), ("C", "<i2", 40_000, 2), ("F", "<f8", 20_000, 9)])
def test_a_large_npy_file_is_many_tasks(spark, tmp_path, order, dtype, samples, channels):
    x = np.asarray(np.random.default_rng(1).normal(0, 1000, (samples, channels)).astype(dtype), order=order)
    np.save(tmp_path / "s.npy", x)
    np.save(tmp_path / "t.npy", x[:10])
    piece = 200_000 if dtype != "<i2" else 60_000
    parts = planned(tmp_path, "npy", rows="parts", piece_bytes=piece)
    assert len(parts) >= 3 and max((p.parts[0].hi - p.parts[0].lo) * p.parts[0].size for p in parts) <= max(piece, M.CHUNK * channels * 8)
    got = signals(R.npy_files(spark, str(tmp_path), piece))
    same(got, x.T.astype(float), "s", "npy")
    same(got, x[:10].T.astype(float), "t", "npy")
    longest = R.matrix_chunks(spark, str(tmp_path / "s.npy"), "npy", "parts", piece).selectExpr("max(size(signal))").first()[0]
    assert longest <= M.CHUNK


def test_variables_of_a_large_mat_file_are_tasks_and_those_not_asked_for_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    wide, tall = rng.normal(size=(3, 50_000)), rng.normal(size=(40_000, 2))
    made = {"A_1_IDG": wide, "A_1_IDE": tall, "A_2_IDG": wide + 1, "A_RST1": tall + 1, "other": wide[:, :5]}  # those of odd places are compressed
    (tmp_path / "x_Sub_3.mat").write_bytes(mat_file(made))
    (tmp_path / "x_Sub_4.mat").write_bytes(mat_file({"A_1_IDG": wide[:, :9]}))
    got = signals(R.mat_files(spark, str(tmp_path), 300_000))
    for task, x in (("1_IDG", wide), ("1_IDE", tall.T), ("2_IDG", wide + 1), ("1_rest", tall.T + 1)):
        same(got, x, "3", task)
    same(got, wide[:, :9], "4", "1_IDG")
    assert len(got) == 13
    everything = planned(tmp_path, "mat", piece_bytes=300_000)
    one = planned(tmp_path, "mat", tasks=json.dumps(["1_IDE"]), piece_bytes=300_000)
    other = planned(tmp_path, "mat", subjects=json.dumps(["4", "9"]), piece_bytes=300_000)
    assert len(everything) == 11 and len(one) == 2 and len(other) == 1
    chunks = R.matrix_chunks(spark, str(tmp_path), "mat", piece_bytes=300_000)
    assert chunks.rdd.getNumPartitions() == 11 and R.matrix_chunks(spark, str(tmp_path), "mat", piece_bytes=300_000, tasks=["1_IDE"]).rdd.getNumPartitions() == 2
    assert {(r.subject, r.task) for r in chunks.where("task = '1_IDG'").collect()} == {("3", "1_IDG"), ("4", "1_IDG")}
    some = R.mat_files(spark, str(tmp_path), 300_000, subjects=["3"], tasks=["1_IDG", "1_rest"])
    assert {k[:2] for k in signals(some)} == {("3", "1_IDG"), ("3", "1_rest")} and some.failed.count() == 0


@pytest.mark.parametrize("wide", [True, False])
def test_no_channel_of_a_damaged_variable_is_read(spark, tmp_path, wide):
    x = np.random.default_rng(3).normal(size=(2, 50_000))
    x = x if wide else x.T
    raw = bytearray(mat_file({"A_1_IDG": x, "A_1_IDE": x}))
    assert raw[-8:] != bytes(8)
    raw[-1] ^= 1  # the checksum of the second, compressed variable
    (tmp_path / "d.mat").write_bytes(raw)
    for piece in (100_000, M.PIECE):
        got = R.mat_files(spark, str(tmp_path), piece)
        same(signals(got), x if wide else x.T, "d", "1_IDG")
        assert len(signals(got)) == 2
        assert [(r.subject, r.task) for r in got.failed.collect()] == [("d", "1_IDE")]
    (tmp_path / "d.mat").write_bytes(raw[:-30])
    assert [r.subject for r in R.mat_files(spark, str(tmp_path), 100_000).failed.collect()] == ["d"] and not signals(R.mat_files(spark, str(tmp_path), 100_000))


def test_files_are_found_by_folder_name_and_pattern(spark, tmp_path):
    for name in ("a/x.npy", "a/_hidden.npy", "b/y.NPY", "b/z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with open(tmp_path / name, "wb") as f:
            np.save(f, np.zeros((0, 2)) if "y" in name.split("/")[1][:1] else np.arange(3))
    assert [p.rsplit("/", 1)[-1] for p, _ in M.listed(f"file://{tmp_path}/*/*", "npy")] == ["x.npy", "y.NPY"]
    assert [p for p, _ in M.listed(str(tmp_path / "a"), "npy")] == [str(tmp_path / "a" / "x.npy")]
    with pytest.raises(FileNotFoundError):
        M.listed(str(tmp_path / "none"), "npy")
    assert R.read_npy(spark, f"{tmp_path}/*/*").orderBy("subject", "ch_idx").select("subject", "ch_idx", "signal").collect() == [("x", 0, [0, 1, 2]), ("y", 0, []), ("y", 1, [])]
    assert R.read_npy(spark, str(tmp_path / "a" / "none*.npy")).count() == 0


def test_labels_of_a_long_file(spark, tmp_path):
    labels = np.random.default_rng(4).integers(0, 4, 50_000)
    np.save(tmp_path / "l.npy", labels)
    found = R.npy_labels(spark, str(tmp_path / "l.npy"))
    assert [r.label for r in found.orderBy("t").collect()] == labels.tolist() and found.agg({"t": "max"}).first()[0] == 49_999
    (tmp_path / "bad.npy").write_bytes(b"\x93NUMPY")
    with pytest.raises(Exception, match="bad.npy"):
        R.npy_labels(spark, str(tmp_path / "bad.npy")).collect()


def test_small_elements_and_other_types():
    def small(kind, data):
        return struct.pack("<I", len(data) << 16 | kind) + data.ljust(4, b"\0")

    body = struct.pack("<IIII", 6, 8, 9, 0) + struct.pack("<IIii", 5, 8, 1, 3) + small(1, b"ab") + small(2, bytes([1, 2, 3]))
    packed = zlib.compress(struct.pack("<II", 14, len(body)) + body)
    name, m = M._mat_variable(zlib.decompress(packed), "<", "f.mat", 0, None)
    assert (name, m.channels, m.n, m.dtype, m.at) == ("ab", 1, 3, "|u1", 8 + len(body) - 4)
    assert M._mat_variable(struct.pack("<II", 9, 8) + bytes(8), "<", "f.mat", 0, None) is None
