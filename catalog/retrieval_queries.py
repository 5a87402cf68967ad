"""Keyword and vector retrieval."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import table
from matchweave.functions import vectors as V
from matchweave.functions.text import tokens
from matchweave.operators.nearest import approximate_topk, vector_topk
from matchweave.operators.bm25 import corpus_topk, term_statistics

TOKENS = """
doc_tokens AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term
  FROM documents
),
doc_terms AS (SELECT doc_id, term, count(*) AS tf FROM doc_tokens GROUP BY ALL),
lengths AS (
  SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS dl FROM documents
),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
query_terms AS (
  SELECT item_id, term, count(*) AS qtf
  FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term
        FROM benchmark) GROUP BY ALL
),
wanted AS (SELECT DISTINCT term FROM query_terms),
frequency AS (SELECT term, count(*) AS df FROM doc_terms JOIN wanted USING (term) GROUP BY term),
idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM frequency, stats)
"""


@query("bm25_topk_documents", f"""
WITH {TOKENS},
scores AS (
  SELECT item_id, doc_id,
    round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM query_terms JOIN idf USING (term) JOIN doc_terms USING (term) JOIN lengths USING (doc_id), stats
  GROUP BY item_id, doc_id
)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores
) WHERE rank <= 10
""")
def bm25_topk_documents(spark, folder):
    return corpus_topk(table(spark, folder, "benchmark"), table(spark, folder, "documents"), 10,
                       query_key="item_id", query_text="text", doc_key="doc_id", doc_text="text")


@query("bm25_corpus_statistics", f"WITH {TOKENS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_corpus_statistics(spark, folder):
    terms = table(spark, folder, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term"))
    stats = term_statistics(table(spark, folder, "documents"), "text", terms)
    return stats.withColumn("idf", F.round("idf", 6))


@query("vector_topk_cosine", """
SELECT query_id, vec_id, distance + 0 AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, i.vec_id,
      round(1 - list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[])
        / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
         * sqrt(list_inner_product(i.embedding::DOUBLE[], i.embedding::DOUBLE[]))), 9) AS distance
    FROM embeddings q, embeddings i)
) WHERE rank <= 100
""")
def vector_topk_cosine(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vector_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 100, item_key="vec_id")


@query("vector_topk_pruned", """
WITH rows AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT -1, list_transform(max(embedding)::DOUBLE[], lambda x: 0::DOUBLE) FROM embeddings UNION ALL SELECT -2, NULL),
sized AS (SELECT *, sqrt(list_inner_product(v, v)) AS size FROM rows),
pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id,
    CASE WHEN q.size > 0 AND i.size > 0 THEN round(1 - list_inner_product(q.v, i.v) / (q.size * i.size), 9) + 0 ELSE 2 END AS distance
  FROM sized q, sized i WHERE i.v IS NOT NULL)
SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
""")
def vector_topk_pruned(spark, folder):
    """Small cells, so that most are left out; a null and a zero vector are among the rows."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    zero = rows.agg(F.lit(-1).cast(rows.schema["vec_id"].dataType).alias("vec_id"), F.transform(F.max("embedding"), lambda x: (x * 0).cast("float")).alias("embedding"))
    none = spark.range(1).select(F.lit(-2).cast(rows.schema["vec_id"].dataType).alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"))
    rows = rows.unionAll(zero).unionAll(none)
    return vector_topk(rows.withColumnRenamed("vec_id", "query_id"), rows, 10, item_key="vec_id", cell_rows=64)


@query("vector_topk_lsh")
def vector_topk_lsh(spark, folder):
    """Found through random projections; its recall against ``vector_topk`` is tested."""
    vectors = table(spark, folder, "embeddings")
    return approximate_topk(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 10, item_key="vec_id")


@query("vector_functions", """
WITH centre AS (
  SELECT label, list(m ORDER BY pos) AS mean FROM (
    SELECT label, pos, avg(v) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label
)
SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], mean), 6) AS dot_product,
  round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  round(1 - list_inner_product(embedding::DOUBLE[], mean) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))
    * sqrt(list_inner_product(mean, mean))), 6) AS cosine_distance,
  round(sqrt(list_sum(list_transform(list_zip(embedding, mean), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))), 6) AS l2_distance,
  round(list_inner_product(embedding::DOUBLE[], mean) / ((sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)
    * (sqrt(list_inner_product(mean, mean)) + 1e-8)), 6) AS semantic
FROM embeddings JOIN centre USING (label)
""")
def vector_functions(spark, folder):
    rows = table(spark, folder, "embeddings")
    a, m = F.col("embedding"), F.col("mean")
    return rows.join(label_centres(rows), "label").select(
        "vec_id", F.round(V.dot(a, m), 6).alias("dot_product"), F.round(V.norm(a), 6).alias("norm"),
        F.round(V.cosine_distance(a, m), 6).alias("cosine_distance"),
        F.round(V.l2_distance(a, m), 6).alias("l2_distance"), F.round(V.cosine(a, m), 6).alias("semantic"))


def label_centres(vectors):
    """(label, mean): mean vector per label; one row per (label, dimension) before it is put together."""
    means = (vectors.select("label", F.posexplode("embedding").alias("pos", "v"))
             .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m")))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("mean"))
