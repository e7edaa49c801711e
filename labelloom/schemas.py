"""Table schemas, label sentinels and the class list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# The seven classes, ids in alphabetical order, and the label sentinels.
CLASSES = (
    "AUTONOMOUS",
    "CONNECTIVITY",
    "DIGITALISATION",
    "ELECTRIFICATION",
    "INDIVIDUALISATION",
    "SHARED",
    "SUSTAINABILITY",
)
CARDINALITY = len(CLASSES)
ABSTAIN = -1
UNANNOTATED = -2


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SEED = _strings("CLASS", "KEYWORD", "URL")
RAW_TEXTS = _strings("CLASS", "KEYWORD", "DOMAIN", "URL", "URL_TEXT")
RAW_CLASSES = _strings("CLASS", "DOMAIN", "URL", "URL_TEXT")
CLEANED_TEXTS = _strings("CLASS", "KEYWORD", "DOMAIN", "URL", "URL_TEXT", "LANG")
TOPICED_TEXTS = _strings("CLASS", "KEYWORD", "DOMAIN", "URL", "URL_TEXT", "LANG", "TOPIC")
LABELED_TEXTS = T.StructType(TOPICED_TEXTS.fields + [T.StructField("LABEL", T.IntegerType())])


def class_table(spark: SparkSession) -> DataFrame:
    """``(label, class_name)`` for the seven classes."""
    return spark.createDataFrame(list(enumerate(CLASSES)), "label int, class_name string")
