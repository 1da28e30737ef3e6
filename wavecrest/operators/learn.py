"""Classifiers over feature arrays: splits, scaling, nearest neighbours, networks and machines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavecrest.operators import machines, network
from wavecrest.operators.neighbours import nearest
from wavecrest.storage import stored

#: Parts of task names and their classes; longer names are tried first.
CLASSES = {"idg": "IDG", "ide": "IDE", "idr": "IDR", "rst": "RST", "idea generation": "IDG", "idea evolution": "IDE", "idea rating": "IDR", "rest": "RST"}


def task_class(task, classes: dict[str, str] | None = None, legacy: bool = False):
    """The class whose name is in a task's name; ``legacy`` tries names in their given order, so "idea" is IDE."""
    names = classes or CLASSES
    order = list(names) if legacy else sorted(names, key=lambda x: -len(x))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in order:
        out = out.when(F.instr(F.lower(task), name) > 0, names[name])
    return out


def _ranked(samples: DataFrame, seed: int) -> DataFrame:
    """Adds ``_k``, a row's place among its label's by md5 of id and seed, from 1, and ``_n``, how many the label has.

    Rows are ranked within 4,096 ranges of the md5, and the counts of the ranges before are added, so a label is
    no single task's work. Counts are one row for each label and range.
    """
    marked = samples.withColumn("_md5", F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), F.lit(str(seed))))).withColumn("_range", F.substring("_md5", 1, 3))
    counts = marked.groupBy("label", "_range").count()
    whole = Window.partitionBy("label")
    before = counts.select("label", "_range", (F.sum("count").over(whole.orderBy("_range")) - F.col("count")).alias("_before"), F.sum("count").over(whole).alias("_n"))
    ranked = marked.withColumn("_k", F.row_number().over(Window.partitionBy("label", "_range").orderBy("_md5", "sample_id")))
    return ranked.join(before, ["label", "_range"]).withColumn("_k", F.col("_k") + F.col("_before")).drop("_md5", "_range", "_before")


def split(samples: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``test``: the first share of each label by an md5 of id and seed."""
    return _ranked(samples, seed).withColumn("test", F.col("_k") <= F.ceil(F.col("_n") * F.lit(test_share))).select(*samples.columns, "test")


def folds(samples: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``, from 0: rows of a label are dealt out one after another in the order of the md5."""
    return _ranked(samples, seed).withColumn("fold", ((F.col("_k") - 1) % n).cast("int")).select(*samples.columns, "fold")


def standardise(samples: DataFrame) -> DataFrame:
    """``features`` less the train rows' mean, over their deviation (1 where it is 0)."""
    long = samples.where(~F.col("test")).select(F.posexplode("features").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = long.agg(F.array_sort(F.collect_list(F.struct("k", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("_scale"))
    joined = samples.join(F.broadcast(scale), F.lit(True))
    return joined.withColumn("features", F.zip_with("features", "_scale", lambda v, c: (v - c["m"]) / c["s"])).drop("_scale")


def classify(samples: DataFrame, model: str, seed: int = 42, of_train: bool = False) -> DataFrame:
    """(sample_id, label, predicted) of the test rows by a network (``mlp``) or kernel machines (``svm``) learned from the others, or of those others themselves if ``of_train``.

    The network has 100 and 50 rectified hidden nodes, is learned by Adam and stops early; see ``network.fit``. Machines are one a pair of labels, with a hinge loss, C of 1 and
    a Gaussian kernel whose width is the number of features times their variance, learned from all rows; see ``machines.learned``. The rows are stored once, as fits read them many times.
    No rows to predict, or none to learn from, give no rows.
    """
    samples = stored(samples, "samples")
    learned = samples.where(~F.col("test"))
    about = learned.agg(F.count("*"), F.array_sort(F.collect_set("label")), F.min(F.size("features")), F.max(F.size("features"))).first()
    n, labels, width, most = about
    asked = learned if of_train else samples.where("test")
    nothing = asked.select("sample_id", "label", F.col("label").alias("predicted")).where(F.lit(False))
    if not n:
        return nothing
    if width != most:
        raise ValueError(f"rows have {width} to {most} features")
    if len(labels) < 2:
        raise ValueError(f"there is one class, {labels[0]!r}")
    code = F.coalesce(*[F.when(F.col("label") == x, float(k)) for k, x in enumerate(labels)])
    if model == "svm":
        spread = learned.select(F.explode("features").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        fitted = machines.learned(learned.select("sample_id", code.cast("int").alias("_y"), "features"), len(labels), 1 / (width * spread))
        got = machines.predicted(asked, fitted)
    else:
        fitted = network.fit(learned.select("sample_id", code.cast("int").alias("_y"), "features"), [width, 100, 50, len(labels)], seed)
        got = network.predicted(asked, fitted)
    return got.select("sample_id", "label", F.element_at(F.array(*map(F.lit, labels)), F.col("_p").cast("int") + 1).alias("predicted"))


def predict(samples: DataFrame, model: str, seed: int = 42, of_train: bool = False) -> DataFrame:
    """(sample_id, label, predicted) of the test rows, or of those learned from, by ``knn``, ``mlp`` or ``svm``."""
    if model != "knn":
        return classify(samples, model, seed, of_train)
    learned = samples.where(~F.col("test"))
    asked = learned if of_train else samples.where("test")
    return nearest(learned, asked).join(asked.select("sample_id", "label"), "sample_id")


def cross_validate(samples: DataFrame, model: str, n: int = 5, seed: int = 42) -> DataFrame:
    """(fold, accuracy, n): each fold of ``samples`` predicted by a model of the others. Nearest neighbours of all folds are found in one job."""
    dealt = folds(samples, n, seed)
    if model == "knn":
        dealt = stored(dealt, "folds")
        said = nearest(dealt, dealt, apart="fold").join(dealt.select("sample_id", "label", "fold"), "sample_id")
        return _fold_scores(said)
    parts = [predict(dealt.withColumn("test", F.col("fold") == k), model, seed).withColumn("fold", F.lit(k)) for k in range(n)]
    said = parts[0]
    for part in parts[1:]:
        said = said.unionByName(part)
    return _fold_scores(said)


def _fold_scores(said: DataFrame) -> DataFrame:
    return said.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def cross_summary(scores: DataFrame) -> DataFrame:
    """(cv_mean, cv_std) over folds; the deviation is that of all folds."""
    return scores.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "predicted").count()


def report(predictions: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each true label."""
    sides = predictions.select(F.explode(F.array(F.struct(F.col("label").alias("label"), F.lit(1).alias("true"), F.lit(0).alias("said"), (F.col("label") == F.col("predicted")).cast("int").alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("true"), F.lit(1).alias("said"), F.lit(0).alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("true").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit")).where("support > 0")
    precision, recall = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.col("hit") / F.col("support")
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), F.when(F.col("hit") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), "support")


def summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
