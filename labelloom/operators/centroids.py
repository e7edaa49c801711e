"""Fixed centroids and nearest-centroid assignment."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from .features import attach_by_term, document_frequency, term_table
from .tables import lookup_join, union_rows


def cluster_names(classes: DataFrame, class_col: str) -> DataFrame:
    """``(cluster, class)``: ids in alphabetical class order."""
    names = classes.select(class_col).distinct()
    return names.select((F.dense_rank().over(Window.orderBy(class_col)) - 1).alias("cluster"), class_col)


def centroid_idf(doc_terms: DataFrame, class_terms: DataFrame, n_docs: DataFrame, n_classes: DataFrame) -> DataFrame:
    """``(term, df, idf)`` over the documents and the class documents together."""
    n = n_docs.scalar() + n_classes.scalar()
    both = union_rows(doc_terms.select("term"), class_terms.select("term"))
    return document_frequency(both).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def fixed_centroids(class_tf: DataFrame, idf: DataFrame) -> DataFrame:
    """``(cluster, term, weight)``: the TF-IDF rows of the class documents, length one.

    Terms are unique in ``idf`` and occur at most once per class, so no key is hot.
    """
    raw = class_tf.join(idf, "term").select("cluster", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("cluster").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "cluster").select("cluster", "term", (F.col("w") / F.col("norm")).alias("weight"))


def nearest_centroid(docs: DataFrame, id_col: str, terms: str, idf: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """``(id, cluster, distance)`` to the nearest of ``k`` centroids; ties and empty texts go to the lowest id.

    The centroids become one weight vector per term. A single aggregation by
    document then gives its length and all ``k`` dot products at once.
    """
    per_cluster = [F.coalesce(F.sum(F.when(F.col("cluster") == i, F.col("weight"))), F.lit(0.0)) for i in range(k)]
    by_term = centroids.groupBy("term").agg(F.array(*per_cluster).alias("c"))
    square = centroids.groupBy().agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("cluster") == i, F.col("weight") ** 2)), F.lit(0.0)) for i in range(k)])
    ).scalar()
    weighted = attach_by_term(term_table(docs, id_col, terms), idf)
    w = F.col("tf") * F.col("idf")
    dots = (
        lookup_join(weighted.select(id_col, "term", w.alias("w")), by_term, "term", "left")
        .groupBy(id_col)
        .agg(
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"),
            F.array(*[F.sum(F.col("w") * F.coalesce(F.get("c", F.lit(i)), F.lit(0.0))) for i in range(k)]).alias("dot"),
        )
    )
    joined = docs.select(id_col).join(dots, id_col, "left").withColumn("cc", square)
    dd = F.when(F.col("len") > 0, 1.0).otherwise(0.0)
    dot = F.transform(F.coalesce("dot", F.array(*[F.lit(0.0)] * k)), lambda x: F.when(F.col("len") > 0, x / F.col("len")).otherwise(0.0))
    dist = F.transform(
        F.zip_with(dot, "cc", lambda a, c: dd + c - 2 * a), lambda s: F.round(F.sqrt(F.greatest(s, F.lit(0.0))), 9)
    )
    with_dist = joined.select(id_col, dist.alias("d"))
    return with_dist.select(
        id_col, (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster"), F.array_min("d").alias("distance")
    )


def mean_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``(label, centre)``: mean vector per label, combined before the shuffle."""
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    means = df.select(label, v.alias("v")).groupBy(label).agg(Summarizer.mean(F.col("v")).alias("m"))
    return means.select(label, vector_to_array("m").alias("centre"))


def nearest_centroid_vec(df: DataFrame, id_col: str, vector: str, centres: DataFrame, label: str, max_centres: int = 1_000) -> DataFrame:
    """``(id, cluster, distance)`` on dense vectors. The centres are few (checked) and become part of the plan."""
    rows = centres.orderBy(label).limit(max_centres + 1).collect()
    if len(rows) > max_centres:
        raise ValueError(f"more than {max_centres} centres")
    table = F.array(
        *[F.struct(F.lit(r[label]).alias("id"), F.array(*[F.lit(float(x)) for x in r["centre"]]).alias("c")) for r in rows]
    )
    v = F.transform(vector, lambda x: x.cast("double"))
    dist = F.transform(
        table,
        lambda t: F.struct(
            F.aggregate(F.zip_with("v", t.c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d2"),
            t.id.alias("id"),
        ),
    )
    best = df.select(id_col, v.alias("v")).select(id_col, F.array_min(dist).alias("best"))
    return best.select(id_col, F.col("best.id").alias("cluster"), F.sqrt("best.d2").alias("distance"))
