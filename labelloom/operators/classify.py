"""Text classifier: a Spark ML pipeline with class-weighted multinomial regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import WORD
from ..functions.text import stopwords_for
from ..schemas import CLASSES
from ..session import stored
from .metrics import confusion, metrics
from .splits import class_weights


def feature_stages(text: str, lang: str = "en", n_features: int = 1 << 14) -> list:
    """Text to normalised TF-IDF features; hashing keeps the width fixed for any vocabulary."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=f"[{WORD}]+", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stopwords_for(lang))),
        HashingTF(inputCol="_kept", outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features"),
    ]


def clf_features(df: DataFrame, text: str, lang: str = "en", n_features: int = 1 << 14) -> DataFrame:
    stages = feature_stages(text, lang, n_features)
    return Pipeline(stages=stages).fit(df).transform(df).drop("_words", "_kept", "_tf", "_idf")


def clf_train(
    train: DataFrame, text: str, label: str, lang: str = "en", max_iter: int = 20, reg: float = 1e-3, n_features: int = 1 << 14
) -> PipelineModel:
    """Multinomial logistic regression; the weight of a row is the inverse share of its class.

    Stages that learn nothing come first. Their term counts are stored, so that idf weights and regression do not read the texts again.
    """
    weighted = class_weights(train.filter(F.col(label) >= 0), label)
    regression = LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", family="multinomial", maxIter=max_iter, regParam=reg
    )
    stages = feature_stages(text, lang, n_features)
    fixed, learning = stages[:3], stages[3:] + [regression]
    counts = stored(PipelineModel(fixed).transform(weighted).select(label, "weight", "_tf"), "clf_counts")
    return PipelineModel(fixed + Pipeline(stages=learning).fit(counts).stages)


def clf_predict(model: PipelineModel, df: DataFrame, class_names=CLASSES) -> DataFrame:
    """Add ``pred`` and ``class_name``; works on a stream as on a table."""
    names = F.array(*[F.lit(n) for n in class_names])
    scored = model.transform(df).withColumn("pred", F.col("prediction").cast("int"))
    dropped = ("_words", "_kept", "_tf", "_idf", "features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("class_name", F.get(names, F.col("pred"))).drop(*dropped)


def clf_evaluate(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """All metrics over the whole annotated set."""
    return metrics(confusion(clf_predict(model, df), label, "pred"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
