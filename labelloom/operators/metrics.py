"""Classification metrics. All are computed from the confusion table, which is bounded by the classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ABSTAIN, CARDINALITY, CLASSES


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``(label, pred, n)``."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(table: DataFrame, n_classes: int = CARDINALITY) -> DataFrame:
    """One row with accuracy, precision, recall, F1, Matthews correlation and coverage of a confusion table.

    Precision, recall and F1 run over the class ids; a class without rows counts as zero.
    The correlation uses every value that occurs, abstentions included.
    """
    label, pred = F.col("label"), F.col("pred")
    values = [ABSTAIN, *range(n_classes)]
    sums = [_count(label == pred).alias("c"), _count(F.lit(True)).alias("s"), _count(pred != ABSTAIN).alias("voted")]
    for i, k in enumerate(values):
        sums += [_count((label == k) & (pred == k)).alias(f"tp{i}"), _count(pred == k).alias(f"p{i}"), _count(label == k).alias(f"t{i}")]
    one = table.agg(*sums)
    ids = range(1, n_classes + 1)

    def total(name: str, over) -> Column:
        return sum((F.col(f"{name}{i}") for i in over), F.lit(0.0))

    def products(a: str, b: str) -> Column:
        return sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(n_classes + 1)), F.lit(0.0))

    def mean(parts) -> Column:
        return sum(parts, F.lit(0.0)) / n_classes

    s, c = F.col("s"), F.col("c")
    precision = {i: _ratio(F.col(f"tp{i}"), F.col(f"p{i}")) for i in ids}
    recall = {i: _ratio(F.col(f"tp{i}"), F.col(f"t{i}")) for i in ids}
    f1 = {i: _ratio(2 * F.col(f"tp{i}"), F.col(f"p{i}") + F.col(f"t{i}")) for i in ids}
    root = F.sqrt((s * s - products("p", "p")) * (s * s - products("t", "t")))
    return one.select(
        _ratio(c, s).alias("accuracy"),
        _ratio(total("tp", ids), total("p", ids)).alias("precision_micro"),
        mean(precision.values()).alias("precision_macro"),
        mean(recall.values()).alias("recall_macro"),
        _ratio(2 * total("tp", ids), total("p", ids) + total("t", ids)).alias("f1_micro"),
        mean(f1.values()).alias("f1_macro"),
        _ratio(c * s - products("p", "t"), root).alias("mcc"),
        _ratio(F.col("voted"), s).alias("coverage"),
    )


def class_distribution(df: DataFrame, label: str, class_names=CLASSES) -> DataFrame:
    """``(label, class_name, n)`` with the classes that do not occur. Classes are few: they become the rows of the result."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    table = df.sparkSession.createDataFrame(list(enumerate(class_names)), "label int, class_name string")
    return table.join(counts, "label", "left").select("label", "class_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
