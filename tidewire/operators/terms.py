"""Headline documents, document frequencies, TF-IDF and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.functions import text, values


def headline_documents(articles: DataFrame, by: str = "day") -> DataFrame:
    """One document for each distinct normalised headline of a day, with its copies.

    Syndicated copies fall together; the copy that comes first in scan order (newest, then feed and title) stands for
    them. Documents without a stem are dropped. `position` orders a day's documents oldest first.
    """
    scan = F.struct(-F.unix_micros(F.coalesce("published_at", "fetched_at")), "feed_url", "title", "seq")
    toks = text.tokens(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("summary"), F.lit("")))
    rows = articles.select("*", toks.alias("toks")).where(F.size("toks") > 0)
    rows = rows.withColumn("headline_key", F.array_join(F.transform("toks", lambda t: t["stem"]), " "))
    copy = F.struct(
        scan.alias("scan"), "seq", F.col("url_hash").cast("string").alias("url_hash"), "feed_url", "feed_title", "title",
        F.coalesce("published_at", "fetched_at").alias("at"),
    )
    grouped = rows.groupBy(by, "headline_key").agg(F.min_by(F.struct("seq", "title", "toks"), scan).alias("head"), F.array_sort(F.collect_list(copy)).alias("copies"))
    stems = F.transform("head.toks", lambda t: t["stem"])
    return grouped.select(
        by, "headline_key", F.col("head.seq").alias("doc_id"), F.col("head.title").alias("title"), text.terms(stems).alias("terms"),
        text.surfaces(F.col("head.toks")).alias("surfaces"), "copies", F.get("copies", F.lit(0))["at"].alias("at"),
    )


def document_frequency(documents: DataFrame, by: str = "day") -> DataFrame:
    return documents.select(by, F.explode(F.array_distinct("terms")).alias("term")).groupBy(by, "term").agg(F.count("*").alias("df"))


def tfidf(documents: DataFrame, by: str = "day", space: DataFrame | None = None) -> DataFrame:
    """Long form (by, doc_id, term_at, term, weight): tf over all terms of the headline, smoothed natural-log idf.

    `space` gives the corpus whose frequencies count; without it, the documents' own day. Terms the corpus never saw have
    frequency 0. term_at is where the term first stands.
    """
    corpus = documents if space is None else space
    n = corpus.groupBy(by).agg(F.count("*").alias("n"))
    df = document_frequency(corpus, by)
    long = documents.select(by, "doc_id", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "term"))
    counts = long.groupBy(by, "doc_id", "term").agg(F.count("*").alias("tf"), F.min("at").alias("term_at"), F.first("size").alias("size"))
    weighed = counts.join(df, [by, "term"], "left").join(n, by)
    return weighed.select(by, "doc_id", "term_at", "term", (F.col("tf") / F.col("size") * values.idf(F.col("n"), F.col("df"))).alias("weight"))


def vectors(long: DataFrame, by: str = "day") -> DataFrame:
    """Terms and weights of each document as arrays, in order of first occurrence."""
    cells = F.array_sort(F.collect_list(F.struct("term_at", "term", "weight")))
    return long.groupBy(by, "doc_id").agg(cells.alias("cells")).select(
        by, "doc_id", F.transform("cells", lambda c: c["term"]).alias("vector_terms"), F.transform("cells", lambda c: c["weight"]).alias("vector_weights")
    )
