"""Queries over text features, topics, coherence and centroids, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import compute_once, ngrams_1_2, remove_stopwords, term_counts, tokenize, top_counted, unnest
from ..operators import centroids as N, coherence as W, features as X, topicmodel as T, topics as P
from ..operators.votes import LFRegistry, apply_lfs
from ..schemas import CARDINALITY
from ..session import stored
from .inputs import KEYWORDS, KEYWORD_NAMES, VOTES_SQL, documents, stopword_filter, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
KEPT_SQL = f"""
    tok AS (SELECT doc_id, lang, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) AS pos FROM documents),
    kept AS (SELECT doc_id, lang, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok WHERE {stopword_filter()})"""
GRAMS_SQL = """
    grams AS (
      SELECT doc_id, term FROM kept
      UNION ALL
      SELECT doc_id, concat(term, ' ', nxt) FROM (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM kept) x WHERE nxt IS NOT NULL)"""
TOPIC_SQL = """
    cnt AS (SELECT doc_id, term, count(*) AS n FROM kept GROUP BY 1, 2),
    top AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rk FROM cnt QUALIFY rk <= 14),
    topics AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY rk) AS p FROM top WHERE length(term) > 3)"""


def kept_tokens(spark, d) -> DataFrame:
    """Documents with their tokens after stop-word removal."""
    return documents(spark, d).select("doc_id", "lang", "text", remove_stopwords(tokenize(F.col("text")), F.col("lang")).alias("tokens"))


QUERIES["stopwords_remove"] = lambda spark, d: kept_tokens(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))
ORACLES["stopwords_remove"] = f"""
    WITH {KEPT_SQL}, r AS (SELECT doc_id, string_agg(term, ' ' ORDER BY p) AS t FROM kept GROUP BY 1)
    SELECT doc_id, coalesce(t, '') AS tokens FROM documents LEFT JOIN r USING (doc_id)"""


def ngrams(spark, d):
    grams = kept_tokens(spark, d).select("doc_id", ngrams_1_2(F.col("tokens")).alias("g"))
    return X.term_table(grams, "doc_id", "g").withColumn("tf", F.col("tf").cast("bigint"))


QUERIES["ngrams_1_2"] = ngrams
ORACLES["ngrams_1_2"] = f"WITH {KEPT_SQL}, {GRAMS_SQL} SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2"


def tfidf(spark, d):
    # tokens contain no blank; as one text they take less room where they are stored and moved
    docs = kept_tokens(spark, d).select("doc_id", F.array_join("tokens", " ").alias("kept"))
    tokens = F.filter(F.split("kept", " "), lambda t: t != "")
    return X.tfidf(docs, "doc_id", ngrams_1_2(tokens)).select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"), F.round("tfidf", 6).alias("tfidf"))


QUERIES["tfidf"] = tfidf
ORACLES["tfidf"] = f"""
    WITH {KEPT_SQL}, {GRAMS_SQL},
    tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1)
    SELECT doc_id, term, tf, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM tf JOIN idf USING (term)"""


def topic_terms(spark, d):
    docs = documents(spark, d)
    return docs.select("doc_id", F.array_join(P.topic_terms_doc(F.col("text"), F.col("lang")), ",").alias("topic"))


QUERIES["topic_terms_doc"] = topic_terms
ORACLES["topic_terms_doc"] = f"""
    WITH {KEPT_SQL}, {TOPIC_SQL}, r AS (SELECT doc_id, string_agg(term, ',' ORDER BY p) AS t FROM topics GROUP BY 1)
    SELECT doc_id, coalesce(t, '') AS topic FROM documents LEFT JOIN r USING (doc_id)"""


# Corpus topics: two, after six iterations.
TOPICS, TOPIC_ROUNDS, ALPHA, BETA = 2, 6, 0.1, 0.01


def corpus_topics(spark, d) -> tuple[T.TopicModel, DataFrame]:
    docs = stored(kept_tokens(spark, d).select("doc_id", "tokens"), "tokens")
    return T.fit_topics(docs, "doc_id", "tokens", TOPICS, TOPIC_ROUNDS, ALPHA, BETA), docs


def topic_model_corpus(spark, d):
    return T.topic_terms(corpus_topics(spark, d)[0]).withColumn("weight", F.round("weight", 6))


def dominant_topic(spark, d):
    model, docs = corpus_topics(spark, d)
    return T.dominant_topic(model, docs, "doc_id").withColumn("share", F.round("share", 6))


def coherence_windows(spark, d):
    """The corpus topics scored on windows of 110 tokens."""
    model, docs = corpus_topics(spark, d)
    scores = W.coherence_windows(T.topic_terms(model), docs, "doc_id", "tokens")
    return scores.select("topic", "n_terms", F.round("npmi", 6).alias("npmi"), F.round("c_v", 6).alias("c_v"))


def _topic_model_sql() -> str:
    """CTEs ``tt`` (topic, rank, term, weight) and ``shares`` (doc_id, s0 ...): the same iterations in SQL."""
    ks = range(TOPICS)
    cols = lambda f: ", ".join(f(i) for i in ks)
    draw = lambda i: f"1 + CAST(concat('0x', substr(md5(concat('42:{i}:', term)), 1, 8)) AS BIGINT) / 4294967296.0"
    out = f"""{KEPT_SQL},
    counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY 1, 2),
    raw AS (SELECT term, {cols(lambda i: f"CAST({draw(i)} AS DOUBLE) AS r{i}")} FROM (SELECT DISTINCT term FROM counted) x),
    t_0 AS MATERIALIZED (SELECT term, {cols(lambda i: f"r{i} / sum(r{i}) OVER () AS w{i}")} FROM raw),
    d_0 AS MATERIALIZED (SELECT DISTINCT doc_id, {cols(lambda i: f"1.0::DOUBLE AS s{i}")} FROM counted)"""
    for n in range(TOPIC_ROUNDS):
        whole = " + ".join(f"w{i} * s{i}" for i in ks)
        out += f""",
    q_{n} AS MATERIALIZED (SELECT doc_id, term, {cols(lambda i: f"tf * w{i} * s{i} / ({whole}) AS q{i}")} FROM counted JOIN t_{n} USING (term) JOIN d_{n} USING (doc_id)),
    d_{n + 1} AS MATERIALIZED (SELECT doc_id, {cols(lambda i: f"(sum(q{i}) + {ALPHA}) / (sum({' + '.join(f'q{j}' for j in ks)}) + {ALPHA * TOPICS}) AS s{i}")} FROM q_{n} GROUP BY 1),
    m_{n} AS (SELECT term, {cols(lambda i: f"sum(q{i}) AS r{i}")} FROM q_{n} GROUP BY 1),
    t_{n + 1} AS MATERIALIZED (SELECT term, {cols(lambda i: f"(r{i} + {BETA}) / (sum(r{i}) OVER () + {BETA} * count(*) OVER ()) AS w{i}")} FROM m_{n})"""
    long = " UNION ALL ".join(f"SELECT {i} AS topic, term, w{i} AS weight FROM t_{TOPIC_ROUNDS}" for i in ks)
    return out + f""",
    tt AS MATERIALIZED (SELECT CAST(topic AS INT) AS topic, CAST(rank AS INT) AS rank, term, weight FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, {T.DIGITS}) DESC, term) AS rank FROM ({long}) x) y WHERE rank <= 7)"""


TOPIC_MODEL_SQL = _topic_model_sql()
_SHARES = [f"s{i}" for i in range(TOPICS)]
QUERIES["topic_model_corpus"] = topic_model_corpus
ORACLES["topic_model_corpus"] = f"WITH {TOPIC_MODEL_SQL} SELECT topic, rank, term, round(weight, 6) AS weight FROM tt"
QUERIES["dominant_topic"] = dominant_topic
ORACLES["dominant_topic"] = f"""
    WITH {TOPIC_MODEL_SQL}
    SELECT doc_id, CASE WHEN s0 IS NOT NULL THEN CAST(list_position([{', '.join(_SHARES)}], greatest({', '.join(_SHARES)})) - 1 AS INT) END AS topic, round(coalesce(greatest({', '.join(_SHARES)}), 0), 6) AS share
    FROM documents LEFT JOIN d_{TOPIC_ROUNDS} USING (doc_id)"""
QUERIES["coherence_windows"] = coherence_windows
ORACLES["coherence_windows"] = f"""
    WITH {TOPIC_MODEL_SQL},
    len AS (SELECT doc_id, max(p) AS n FROM kept GROUP BY 1),
    spots AS (SELECT doc_id, topic, term, p - 1 AS p, greatest(n - 110, 0) AS last FROM kept JOIN tt USING (term) JOIN len USING (doc_id)),
    held AS MATERIALIZED (SELECT DISTINCT doc_id, topic, term, unnest(range(greatest(p - 109, 0), least(p, last) + 1)) AS s FROM spots),
    total AS (SELECT sum(greatest(n - 109, 1)) AS n FROM len),
    single AS (SELECT topic, term, count(*) AS n FROM held GROUP BY 1, 2),
    joint AS (SELECT a.topic, a.term AS t1, b.term AS t2, count(*) AS n FROM held a JOIN held b USING (doc_id, topic, s) GROUP BY 1, 2, 3),
    cells AS (SELECT a.topic, a.term AS t1, b.term AS t2, coalesce(joint.n, 0) / total.n + 1e-12 AS j, a.n / total.n AS p1, b.n / total.n AS p2
              FROM single a JOIN single b USING (topic) LEFT JOIN joint ON joint.topic = a.topic AND t1 = a.term AND t2 = b.term, total),
    m AS (SELECT topic, t1, t2, ln(j / (p1 * p2)) / -ln(j) AS m FROM cells),
    whole AS (SELECT topic, t2, sum(m) AS s FROM m GROUP BY 1, 2),
    cos AS (SELECT topic, t1, sum(m * s) / sqrt(sum(m * m) * sum(s * s)) AS c FROM m JOIN whole USING (topic, t2) GROUP BY 1, 2)
    SELECT topic, n_terms, round(npmi, 6) AS npmi, round(c_v, 6) AS c_v
    FROM (SELECT topic, count(*) AS n_terms, avg(c) AS c_v FROM cos GROUP BY 1) JOIN (SELECT topic, avg(m) AS npmi FROM m WHERE t1 < t2 GROUP BY 1) USING (topic)"""

QUERIES["class_text_concat"] = lambda spark, d: P.class_text_concat(documents(spark, d), "lang", "text", "doc_id", rows_per_part=1000)
ORACLES["class_text_concat"] = """
    SELECT lang, CAST(doc_id // 1000 AS BIGINT) AS part, string_agg(text, '|' ORDER BY doc_id) AS text FROM documents GROUP BY 1, 2"""

# Topics for the coherence measures: the seven most widespread terms of every language.
LANG_TOPICS_SQL = f"""
    {KEPT_SQL}, have AS (SELECT DISTINCT doc_id, lang, term FROM kept WHERE length(term) > 3),
    tt AS (SELECT lang AS topic, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank FROM have GROUP BY 1, 2 QUALIFY rank <= 7),
    pairs AS (SELECT a.topic, a.term AS t1, b.term AS t2 FROM tt a JOIN tt b ON a.topic = b.topic AND a.rank < b.rank),
    d1 AS (SELECT term, count(*) AS n FROM have WHERE term IN (SELECT term FROM tt) GROUP BY 1),
    d12 AS (SELECT x.term AS t1, y.term AS t2, count(*) AS n FROM have x JOIN have y USING (doc_id)
            WHERE x.term IN (SELECT term FROM tt) AND y.term IN (SELECT term FROM tt) GROUP BY 1, 2),
    pc AS (SELECT topic, p.t1, p.t2, a.n AS d1, b.n AS d2, coalesce(c.n, 0) AS d12, (SELECT count(*) FROM documents) AS n
           FROM pairs p JOIN d1 a ON a.term = p.t1 JOIN d1 b ON b.term = p.t2 LEFT JOIN d12 c ON c.t1 = p.t1 AND c.t2 = p.t2)"""


def _lang_topics(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = kept_tokens(spark, d).select(
        "doc_id", "lang", F.array_distinct(F.filter("tokens", lambda t: F.length(t) > 3)).alias("terms")
    )
    counts = unnest(docs, ["lang"], F.col("terms"), "term").groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "term"))
    topics = counts.withColumn("rank", rank).filter(F.col("rank") <= 7).select(F.col("lang").alias("topic"), "rank", "term")
    return topics, docs


def coherence_umass(spark, d):
    topics, docs = _lang_topics(spark, d)
    return P.coherence_umass(topics, docs, "terms").select("topic", F.round("umass", 6).alias("umass"))


def coherence_npmi(spark, d):
    topics, docs = _lang_topics(spark, d)
    return P.coherence_npmi(topics, docs, "terms").select("topic", F.round("npmi", 6).alias("npmi"))


def coherence_pairwise(spark, d):
    """Vectors of one label play the part of the term vectors of one topic."""
    scores = P.coherence_pairwise(table(spark, d, "embeddings"), "label", "embedding")
    return scores.select("label", "n_terms", F.round("coherence", 6).alias("coherence"))


QUERIES["coherence_umass"] = coherence_umass
ORACLES["coherence_umass"] = f"WITH {LANG_TOPICS_SQL} SELECT topic, round(avg(ln((d12 + 1.0) / d1)), 6) AS umass FROM pc GROUP BY 1"
QUERIES["coherence_npmi"] = coherence_npmi
ORACLES["coherence_npmi"] = f"""
    WITH {LANG_TOPICS_SQL}
    SELECT topic, round(avg(CASE WHEN d12 = 0 THEN -1.0 WHEN d12 = n THEN 1.0
      ELSE ln((d12 / n) / ((d1 / n) * (d2 / n))) / -ln(d12 / n) END), 6) AS npmi FROM pc GROUP BY 1"""
QUERIES["coherence_pairwise"] = coherence_pairwise
ORACLES["coherence_pairwise"] = """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT label, count(*) AS n_terms FROM v GROUP BY 1)
    SELECT a.label, any_value(n.n_terms) AS n_terms, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS coherence
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id JOIN n ON n.label = a.label GROUP BY 1"""


# Terms of a document and of a class document that centroids see, before short ones go: the most frequent are short.
CENTROID_TERMS = 100


def topiced(spark, d) -> DataFrame:
    """Documents with their counted terms, the topic terms, and votes for the classes whose keywords they contain: a stored stage table."""
    docs = kept_tokens(spark, d)
    votes = apply_lfs(docs, LFRegistry.standard(KEYWORDS, "text"), ["doc_id", "lang", "tokens"])
    counted = compute_once(votes, ["doc_id", *KEYWORD_NAMES], term_counts(F.col("tokens")), "counts")
    return stored(counted.select("doc_id", "counts", top_counted(F.col("counts"), CENTROID_TERMS).alias("topic"), *KEYWORD_NAMES), "stage")


def centroid_parts(spark, d):
    """``(docs, idf, centroids)``: the class documents are the documents that contain a keyword of the class."""
    stage = topiced(spark, d)
    member = F.filter(F.array(*KEYWORD_NAMES), lambda v: v >= 0)
    class_terms = P.class_topic_terms(stage, member, "tokens", "cluster", CENTROID_TERMS, counts="counts", n_classes=CARDINALITY)
    class_docs = class_terms.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda e: e.term).alias("topic")
    )
    # a few hundred rows: at most CENTROID_TERMS terms per class, and their pairs
    class_tf = stored(X.term_table(class_docs.select("cluster", ngrams_1_2(F.col("topic")).alias("g")), "cluster", "g"))
    docs = stored(stage.select("doc_id", ngrams_1_2(F.col("topic")).alias("g"), *KEYWORD_NAMES))
    n_classes = class_tf.agg(F.count_distinct("cluster"))
    idf = stored(N.centroid_idf(X.term_table(docs, "doc_id", "g"), class_tf, docs.agg(F.count(F.lit(1))), n_classes), "idf")
    return docs, idf, N.fixed_centroids(class_tf, idf)


CENTROID_SQL = f"""
    {KEPT_SQL}, {TOPIC_SQL.replace('rk <= 14', f'rk <= {CENTROID_TERMS}')},
    votes AS ({VOTES_SQL}),
    member AS (SELECT doc_id, unnest([{', '.join(KEYWORD_NAMES)}]) AS cluster FROM votes),
    ctop AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, term) AS rk
             FROM member JOIN kept USING (doc_id) WHERE cluster >= 0 GROUP BY 1, 2 QUALIFY rk <= {CENTROID_TERMS}),
    ctopics AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY rk) AS p FROM ctop WHERE length(term) > 3),
    dg AS (SELECT doc_id, term FROM topics
           UNION ALL SELECT a.doc_id, concat(a.term, ' ', b.term) FROM topics a JOIN topics b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
    cg AS (SELECT cluster, term FROM ctopics
           UNION ALL SELECT a.cluster, concat(a.term, ' ', b.term) FROM ctopics a JOIN ctopics b ON a.cluster = b.cluster AND b.p = a.p + 1),
    dtf AS (SELECT doc_id, term, count(*) AS tf FROM dg GROUP BY 1, 2),
    ctf AS (SELECT cluster, term, count(*) AS tf FROM cg GROUP BY 1, 2),
    nn AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(DISTINCT cluster) FROM ctf) AS n),
    idf AS (SELECT term, ln((1.0 + (SELECT n FROM nn)) / (1.0 + count(*))) + 1 AS idf
            FROM (SELECT term FROM dtf UNION ALL SELECT term FROM ctf) x GROUP BY 1),
    cw AS (SELECT cluster, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY cluster)) AS w FROM ctf JOIN idf USING (term)),
    dw AS (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM dtf JOIN idf USING (term)),
    ids AS (SELECT unnest(range({CARDINALITY})) AS cluster),
    cc AS (SELECT i.cluster, coalesce(sum(w * w), 0) AS cc FROM ids i LEFT JOIN cw USING (cluster) GROUP BY 1),
    dd AS (SELECT d.doc_id, CASE WHEN count(dw.term) > 0 THEN 1 ELSE 0 END AS dd FROM documents d LEFT JOIN dw USING (doc_id) GROUP BY 1),
    dot AS (SELECT doc_id, cluster, sum(dw.w * cw.w) AS dot FROM dw JOIN cw USING (term) GROUP BY 1, 2),
    dist AS (SELECT doc_id, cluster, round(sqrt(greatest(dd + cc - 2 * coalesce(dot, 0), 0)), 9) AS distance
             FROM dd CROSS JOIN cc LEFT JOIN dot USING (doc_id, cluster)),
    nearest AS (SELECT doc_id, CAST(cluster AS INT) AS cluster, distance FROM dist
                QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, cluster) = 1)"""


def nearest(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, idf, centroids = centroid_parts(spark, d)
    return docs, N.nearest_centroid(docs, "doc_id", "g", idf, centroids, CARDINALITY)


def fixed_centroids(spark, d):
    return centroid_parts(spark, d)[2].select("cluster", "term", F.round("weight", 6).alias("weight"))


QUERIES["fixed_centroids"] = fixed_centroids
ORACLES["fixed_centroids"] = f"WITH {CENTROID_SQL} SELECT cluster, term, round(w, 6) AS weight FROM cw"
QUERIES["nearest_centroid"] = lambda spark, d: nearest(spark, d)[1].withColumn("distance", F.round("distance", 6))
ORACLES["nearest_centroid"] = f"WITH {CENTROID_SQL} SELECT doc_id, cluster, round(distance, 6) AS distance FROM nearest"


def nearest_centroid_vec(spark, d):
    vectors = table(spark, d, "embeddings")
    centres = N.mean_vectors(vectors, "label", "embedding")
    near = N.nearest_centroid_vec(vectors, "vec_id", "embedding", centres, "label")
    return near.withColumn("distance", F.round("distance", 6))


QUERIES["nearest_centroid_vec"] = nearest_centroid_vec
ORACLES["nearest_centroid_vec"] = """
    WITH v AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label AS cluster, i, avg(x) AS m FROM v GROUP BY 1, 2),
    d AS (SELECT vec_id, cluster, sqrt(sum((x - m) * (x - m))) AS distance FROM v JOIN c USING (i) GROUP BY 1, 2)
    SELECT vec_id, cluster, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1"""

QUERIES["cluster_names"] = lambda spark, d: N.cluster_names(
    table(spark, d, "documents").withColumnRenamed("source", "CLASS"), "CLASS"
)
ORACLES["cluster_names"] = """
    SELECT CAST(dense_rank() OVER (ORDER BY CLASS) - 1 AS INT) AS cluster, CLASS FROM (SELECT DISTINCT source AS CLASS FROM documents) x"""
