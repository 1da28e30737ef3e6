"""Readers of recordings, montages and summaries; rows are (subject, task, ch_idx, signal)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.operators.quarantine import Outcome
from wavecrest.sources import matrices

#: The channels of the built-in montage, in order; Cz has place 23 in the 64-channel form.
CHANNELS_63 = (
    "Fp1 Fz F3 F7 FT9 FC5 FC1 C3 T7 TP9 CP5 CP1 Pz P3 P7 O1 Oz O2 P4 P8 TP10 CP6 CP2 C4 T8 FT10 FC6 FC2 F4 F8 Fp2 "
    "AF7 AF3 AFz F1 F5 FT7 FC3 FCz C1 C5 TP7 CP3 P1 P5 PO7 PO3 POz PO4 PO8 P6 P2 CPz CP4 TP8 C6 C2 FC4 FT8 F6 F2 AF4 AF8"
).split()
CHANNELS_64 = [*CHANNELS_63[:23], "Cz", *CHANNELS_63[23:]]
RECORDING = "subject string, task string, ch_idx int, signal array<double>"


def _subject(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def read_task_json(spark: SparkSession, path: str) -> DataFrame:
    """What ``json_files`` gives for the files it can read."""
    return json_files(spark, path).good


def json_files(spark: SparkSession, path: str) -> Outcome:
    """Files of ``{task: [[samples of a channel], ...]}``; the subject is the file's name. One-dimensional tasks are one channel.

    A text that is no such object, or a task that is no list of numbers or of such lists, is a failure.
    """
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.[jJ][sS][oO][nN]").select(_subject(F.col("_metadata.file_path")).alias("subject"), "value")
    tasks = F.from_json("value", "map<string,string>")
    raw = text.select("subject", F.explode_outer(F.when(F.size(F.coalesce(tasks, F.create_map().cast("map<string,string>"))) > 0, F.map_entries(tasks))).alias("e"), F.trim("value").rlike(r"^\{\s*\}$").alias("_none"))
    raw = raw.where("e is not null or not _none").select("subject", F.col("e.key").alias("task"), F.col("e.value").alias("json"))
    flat = F.col("json").rlike(r"^\s*\[\s*[^\s\[]")
    parsed = raw.withColumn("_x", F.when(flat, F.array(F.from_json("json", "array<double>"))).otherwise(F.from_json("json", "array<array<double>>")))
    bad = F.col("_x").isNull() | F.exists("_x", lambda x: x.isNull())
    error = F.when(F.col("task").isNull(), "no object of tasks").when(bad, "a task is no list of numbers")
    told = parsed.withColumn("_error", error)
    rows = told.select("subject", "task", F.posexplode_outer(F.when(F.col("_error").isNull(), F.col("_x"))).alias("ch_idx", "signal"), "_error")
    return Outcome(rows.where("ch_idx is not null or _error is not null"), "read")


def matrix_chunks(spark: SparkSession, path: str, kind: str, rows: str = "chunks", piece_bytes: int = matrices.PIECE, chunk: int = matrices.CHUNK, subjects: list[str] | None = None, tasks: list[str] | None = None) -> DataFrame:
    """(file, subject, task, ch_idx, start, n, signal, error): the numbers of NPY or MAT files in chunks of samples, as ``sources.matrices`` has it.

    Only matrices of ``subjects`` and ``tasks`` are read, if they are given; a filter on these columns afterwards reads all. A damaged matrix has a row with
    an error and may have chunks before it, but no whole channel.
    """
    spark.dataSource.register(matrices.Matrices)
    options = {"kind": kind, "rows": rows, "piece_bytes": piece_bytes, "chunk": chunk} | {k: json.dumps(v) for k, v in (("subjects", subjects), ("tasks", tasks)) if v}
    return spark.read.format("wavecrest_matrices").options(**options).load(path)


def _matrix_files(spark: SparkSession, path: str, kind: str, piece_bytes: int, **chosen) -> Outcome:
    """Whole signals. Those of small files are read whole; only chunks of larger ones are shuffled and put together, by channel."""
    keys = ["subject", "task", "ch_idx"]
    small = matrix_chunks(spark, path, kind, "whole", piece_bytes, **chosen).select(*keys, "signal", F.col("error").alias("_error"))
    parts = matrix_chunks(spark, path, kind, "parts", piece_bytes, **chosen)
    joined = parts.groupBy("file", *keys).agg(F.max("n").alias("_n"), F.max("error").alias("_error"), F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("start", "signal")))).alias("_c"))
    large = joined.select(*keys, F.when(F.col("_error").isNull(), F.flatten(F.transform("_c", lambda c: c["signal"]))).alias("signal"), "_error", "_n")
    complete = large.where(F.col("_error").isNotNull() | (F.size("signal") == F.col("_n"))).drop("_n")
    return Outcome(small.unionByName(complete), "read")


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """What ``mat_files`` gives for the files it can read."""
    return mat_files(spark, path).good


def mat_files(spark: SparkSession, path: str, piece_bytes: int = matrices.PIECE, subjects: list[str] | None = None, tasks: list[str] | None = None) -> Outcome:
    """Level 5 MAT files; named tasks if there are any, else every two-dimensional variable not beginning with ``__``.

    A damaged file, or one without such variables, is a failure; of a file with a damaged compressed variable, the others are read. Only ``subjects`` and ``tasks`` are read, if given.
    """
    return _matrix_files(spark, path, "mat", piece_bytes, subjects=subjects, tasks=tasks)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """What ``npy_files`` gives for the files it can read."""
    return npy_files(spark, path).good


def npy_files(spark: SparkSession, path: str, piece_bytes: int = matrices.PIECE) -> Outcome:
    """NPY arrays, (samples, channels) or (samples,), as recordings of task ``npy``; others are failures."""
    return _matrix_files(spark, path, "npy", piece_bytes)


def npy_labels(spark: SparkSession, path: str) -> DataFrame:
    """(t, label): the numbers of a one-channel NPY file as labels; a long file's are dealt over tasks as they are read and never are one row."""
    found = matrix_chunks(spark, path, "npy").where("ch_idx = 0 or error is not null")
    told = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("signal"))
    return found.select("start", F.posexplode(told).alias("_k", "x")).select((F.col("start") + F.col("_k")).alias("t"), F.col("x").cast("int").alias("label"))


def samples(recordings: DataFrame) -> DataFrame:
    """Long form: one row a sample."""
    return recordings.select("subject", "task", "ch_idx", F.posexplode("signal").alias("t", "x"))


def montage(spark: SparkSession, channels: list[str] | None = None) -> DataFrame:
    """(ch_idx, channel) of the built-in 63 channels, or of a list."""
    return spark.createDataFrame(list(enumerate(channels or CHANNELS_63)), "ch_idx int, channel string")


def _numbered(lines: DataFrame, name) -> DataFrame:
    kept = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).where(~F.trim("text").rlike("^([#;%]|$)"))
    picked = kept.select("line", name.alias("channel")).where(F.col("channel") != "")
    rows = [r.channel for r in picked.orderBy("line").collect()]  # a montage file has a line for each channel
    if not rows:
        raise ValueError("no channels in the file")
    return lines.sparkSession.createDataFrame(list(enumerate(rows)), "ch_idx int, channel string")


def read_locs(spark: SparkSession, path: str) -> DataFrame:
    """Location files: the first token with a letter names a line's channel, else the second."""
    tokens = F.split(F.trim("text"), r"[\s,]+")
    named = F.filter(tokens, lambda x: x.rlike("[A-Za-z]"))
    return _numbered(spark.read.text(path, wholetext=True), F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(tokens, F.lit(2)), F.lit("")))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """Channel lists: location files, comma-separated files, or a name a line."""
    if re.search(r"\.(locs|eloc|sfp)$", path.lower()):
        return read_locs(spark, path)
    if path.lower().endswith(".csv"):
        return parse_channels(spark, " ".join(r[0] for r in spark.read.text(path).collect()))
    return _numbered(spark.read.text(path, wholetext=True), F.trim("text"))


def parse_channels(spark: SparkSession, names: str) -> DataFrame:
    return montage(spark, [x.strip() for x in names.split(",") if x.strip()])


def with_channels(recordings: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds channel names; a recording with another number of channels than the montage has names Ch1, Ch2, ..."""
    n = channels.count()
    sizes = recordings.groupBy("subject", "task").agg(F.countDistinct("ch_idx").alias("_n"))
    joined = recordings.join(sizes, ["subject", "task"]).join(F.broadcast(channels), "ch_idx", "left")
    return joined.withColumn("channel", F.when(F.col("_n") == n, F.col("channel")).otherwise(F.concat(F.lit("Ch"), F.col("ch_idx") + 1))).drop("_n")


_SUMMARY = """baseline string, mode string, channel_order array<string>, bands map<string,map<string,array<double>>>,
by_channel map<string,map<string,map<string,array<double>>>>"""


def read_trp_summaries(spark: SparkSession, path: str | None = None, glob: str = "trp_1_rest.json", files: list[str] = ()) -> DataFrame:
    """(file, subject, baseline, mode, task, band, ch_idx, channel, value) of named files and of those below a folder, each file once.

    A file with ``by_channel`` lists a value of each of several subjects by channel name; one with ``bands`` has a value of each channel in
    order, of one subject, and names them if it has ``channel_order``. Values without a name have ``ch_idx`` only, and the other way round.
    """
    sources = [spark.read.text(list(files), wholetext=True)] if files else []
    if path is not None:
        sources.append(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob))
    texts = [x.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", _SUMMARY).alias("d")) for x in sources]
    text = (texts[0].union(texts[1]) if len(texts) > 1 else texts[0]).dropDuplicates(["file"])
    subject = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    head = text.select("file", subject.alias("subject"), "d.baseline", "d.mode", "d.channel_order", "d.bands", "d.by_channel")
    keys = ["file", "subject", "baseline", "mode"]
    plain = head.where("by_channel is null").select(*keys, "channel_order", F.explode("bands").alias("task", "bands")).select(*keys, "channel_order", "task", F.explode("bands").alias("band", "values"))
    plain = plain.select(*keys, "channel_order", "task", "band", F.posexplode("values").alias("k", "value"))
    plain = plain.select(*keys, "task", "band", F.when(F.col("channel_order").isNull(), F.col("k")).alias("ch_idx"), F.get("channel_order", "k").alias("channel"), "value")
    named = head.select(*keys, F.explode("by_channel").alias("task", "bands")).select(*keys, "task", F.explode("bands").alias("band", "channels")).select(*keys, "task", "band", F.explode("channels").alias("channel", "values"))
    named = named.select(*keys, "task", "band", "channel", F.posexplode("values").alias("k", "value"))
    named = named.withColumns({"subject": F.concat_ws("#", "subject", "k"), "ch_idx": F.lit(None).cast("int")}).select(plain.columns)
    return plain.union(named)


def placed(values: DataFrame, channels: DataFrame) -> DataFrame:
    """Values with the place in ``channels`` of those that only have a channel's name; names that aren't there go."""
    own = channels.select(F.col("ch_idx").alias("_place"), F.col("channel").alias("_name"))
    joined = values.join(F.broadcast(own), F.col("channel") == F.col("_name"), "left")
    return joined.withColumn("ch_idx", F.coalesce("ch_idx", "_place")).where("ch_idx is not null").drop("_place", "_name")
