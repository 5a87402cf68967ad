"""BM25 keyword scoring, over a whole corpus or over each search's candidate set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import spaced, tokens
from matchweave.operators.blocked import keyword_topk


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def saturation(tf: Column, length: Column, average: Column,
               k1: float = vocab.BM25_K1, b: float = vocab.BM25_B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, qtf): a repeated query term counts each time."""
    return (queries.select(key, F.explode(tokens(F.col(text))).alias("term"))
            .groupBy(key, "term").agg(F.count("*").alias("qtf")))


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(doc, dl, term, tf), optionally only for wanted terms.

    A document's tokens sit in one row, so the partial count already gives one row per
    (document, term) before the shuffle, and only wanted terms reach it.
    """
    rows = docs.select(key, tokens(F.col(text)).alias("_t"))
    rows = rows.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents and mean token count."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def document_frequency(docs: DataFrame, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, df): documents that hold a term, optionally only for wanted terms.

    Each document names a term once, so the partial counts reach the shuffle as one row per
    term and task.
    """
    rows = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def term_statistics(docs: DataFrame, text: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) over the corpus, optionally only for wanted terms."""
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    return document_frequency(docs, text, terms).withColumn("idf", idf(n_docs, F.col("df")))


def corpus_topk(queries: DataFrame, docs: DataFrame, k: int, *, query_key: str, query_text: str,
                doc_key: str, doc_text: str, k1: float = vocab.BM25_K1, b: float = vocab.BM25_B,
                **layout) -> DataFrame:
    """(query, doc, score, rank): the k best documents of every query over the whole corpus.

    Words most documents hold would join most queries with most documents, so scores are not
    summed over joined rows.  Query weights come from one counting pass; blocks of queries then meet
    slices of the documents.
    """
    docs = docs.select(doc_key, doc_text)
    qterms = query_terms(queries, query_key, query_text)
    corpus = corpus_stats(docs, doc_text).select(F.struct("n_docs", "avgdl")).scalar()
    known = qterms.join(document_frequency(docs, doc_text, qterms), "term").withColumn("_corpus", corpus)
    weight = (F.col("qtf") * idf(F.col("_corpus.n_docs"), F.col("df"))).alias("weight")
    wanted = (known.groupBy(query_key).agg(F.collect_list(F.struct("term", weight)).alias("_e"),
                                           F.max("_corpus.avgdl").alias("avgdl"))
              .select(query_key, F.col("_e.term").alias("terms"), F.col("_e.weight").alias("weights"), "avgdl"))
    texts = docs.select(doc_key, spaced(F.col(doc_text)).alias("_text"))
    return keyword_topk(wanted, texts, k, query_key=query_key, item_key=doc_key, k1=k1, b=b, **layout)


def candidate_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame, *,
                     query_key: str = "query_id", doc_key: str = "id",
                     query_text: str = "free_text", doc_text: str = "document") -> DataFrame:
    """(query, doc, bm25) with statistics over each query's own candidates.

    ``pairs`` hold the bounded candidate lists of the search (at most the candidate limit per
    query), so windows by query and by (query, term) are small.  Every pair is kept; one
    without a shared term scores 0.
    """
    held = docs.join(pairs.select(doc_key).distinct(), doc_key, "left_semi")
    qterms = query_terms(queries, query_key, query_text)
    posted = postings(held, doc_key, doc_text, qterms)
    lengths = held.select(doc_key, F.size(tokens(F.col(doc_text))).alias("dl"))
    per_query = Window.partitionBy(query_key)
    sized = (pairs.select(query_key, doc_key).join(lengths, doc_key)
             .withColumn("n_docs", F.count("*").over(per_query))
             .withColumn("avgdl", F.avg("dl").over(per_query)))
    hits = (sized.join(qterms, query_key)
            .join(posted.select(doc_key, "term", "tf"), [doc_key, "term"])
            .withColumn("df", F.count("*").over(Window.partitionBy(query_key, "term"))))
    part = F.col("qtf") * idf(F.col("n_docs"), F.col("df")) * saturation(
        F.col("tf"), F.col("dl"), F.col("avgdl"))
    scores = hits.groupBy(query_key, doc_key).agg(F.sum(part).alias("bm25"))
    return (pairs.select(query_key, doc_key).join(scores, [query_key, doc_key], "left")
            .withColumn("bm25", F.coalesce("bm25", F.lit(0.0))))
