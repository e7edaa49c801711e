"""The stage tables from stored pages to a trained classifier, each as one plan over the operators.

Every function takes the table of the stage before and what is done already,
and returns the rows to add or the result; the caller decides what to store.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.text import compute_once
from ..operators import classify, clean, labelmodel, search, splits, tables, topics, votes, web
from ..operators.lang import LanguageModel
from ..schemas import ABSTAIN, UNANNOTATED
from ..session import stored


def raw_texts(pages: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``pages(CLASS, KEYWORD, URL, html, ord)`` to raw texts; pages of ``old`` are not read again."""
    todo = tables.first_per_key(pages, ["URL"], [F.col("ord")])
    if old is not None:
        todo = tables.todo_antijoin(todo, old, "URL")
    text = web.blocked_page_blank(web.html_body_text(F.col("html")))
    return todo.select("CLASS", "KEYWORD", web.domain_of(F.col("URL")).alias("DOMAIN"), "URL", text.alias("URL_TEXT"))


def cleaned_texts(
    raw: DataFrame, model: LanguageModel, lang: str | None, done: DataFrame | None = None, rules: dict | None = None
) -> DataFrame:
    """Clean the raw texts that are not in ``done``, and keep the wanted language."""
    todo = tables.drop_empty_text(raw, "URL_TEXT")
    if done is not None:
        todo = tables.todo_antijoin(todo, done, "URL")
    keep = [c for c in raw.columns if c not in ("URL_TEXT", "LANG")]
    text = compute_once(todo, keep, clean.clean_text(F.col("URL_TEXT"), rules), "URL_TEXT")
    found = model.detect(text, "URL_TEXT", "LANG").drop("lang_score")
    return clean.filter_language(found, "LANG", lang)


def topiced_texts(cleaned: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Add the topic terms as one comma-joined column."""
    todo = cleaned if done is None else tables.todo_antijoin(cleaned, done, "URL")
    terms = topics.topic_terms_doc(F.col("URL_TEXT"), F.col("LANG"))
    return tables.null_to_empty(todo.withColumn("TOPIC", F.array_join(terms, ",")))


@dataclass(frozen=True)
class LabelRun:
    """What a labelling run leaves behind."""

    model: labelmodel.LabelModel
    coverage: DataFrame
    trials: DataFrame
    accepted: bool


def label_run(
    corpus: DataFrame,
    annotated: DataFrame,
    registry: votes.LFRegistry,
    configs: DataFrame,
    key: str = "URL",
    ks: Sequence[int] = range(2, 10),
    champion: labelmodel.LabelModel | None = None,
) -> LabelRun:
    """Cross-validated search for the label model.

    ``annotated(key, LABEL, split)`` holds the annotated test and validation
    rows. The corpus without labels and the test rows are the folds; the best
    configuration is fitted on both, and must beat ``champion`` on the
    validation rows to be accepted.
    """
    names = registry.names
    voted = stored(votes.apply_lfs(corpus, registry, [key]), "votes")
    marks = annotated.select(key, "LABEL", "split")
    joined = voted.join(marks, key, "left").withColumn("LABEL", F.coalesce("LABEL", F.lit(UNANNOTATED)))
    train = joined.filter(F.col("split").isNull() | (F.col("split") != "validate"))
    patterns = stored(search.fold_patterns(train, names, key, "LABEL", ks), "patterns")
    coverage = votes.lf_summary(patterns, names, ["k", "fold"])
    trials = stored(search.cross_validate(configs, patterns, names), "trials")
    best = search.best_config(trials, "accuracy", ["k", "fold", "config_id"]).first()
    model = labelmodel.lm_fit(votes.vote_patterns(train, names), names, **{k: best[k] for k in search.GRID})
    check = joined.filter((F.col("split") == "validate") & ~F.col("LABEL").isin(ABSTAIN, UNANNOTATED))
    accepted = labelmodel.champion_check(check, "LABEL", model, champion, key).first()["replace"]
    return LabelRun(model, coverage, trials, accepted)


def classifier_run(labelled: DataFrame, text: str, label: str, key: str = "URL", lang: str = "en", **options) -> tuple[PipelineModel, DataFrame]:
    """Split 60/20/20, train on the first part, and score the untouched validation part."""
    parts = stored(splits.split_60_20_20(tables.label_range(labelled, label), key), "labelled")
    model = classify.clf_train(parts.filter("split = 'train'"), text, label, lang, **options)
    return model, classify.clf_evaluate(model, parts.filter("split = 'validate'"), label)
