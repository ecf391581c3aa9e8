"""Ranked text search: BM25 over a table of postings, and scores of whole pages for questions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.checkpoints import shared_folder
from codeloom.functions.text import any_of, occurrences, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("name", "qualified_name", "docstring", "signature")


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


@dataclass(frozen=True)
class SearchIndex:
    """postings (token, id, tf, dl) and one row of corpus numbers (n, avgdl)."""

    postings: DataFrame
    corpus: DataFrame


def index_tables(nodes: DataFrame) -> SearchIndex:
    """The postings of all nodes, over all text fields together; nodes are known by ``id``."""
    terms = nodes.select("id", F.concat(*(tokens(c) for c in FIELDS if c in nodes.columns)).alias("terms")).withColumn("dl", F.size("terms"))
    # A node's terms are in one row, so its counts are complete before the shuffle; keys of token and id spread frequent tokens.
    postings = terms.select("id", "dl", F.explode("terms").alias("token")).groupBy("token", "id").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
    return SearchIndex(postings, terms.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def write_index(nodes: DataFrame, path: str | None = None) -> SearchIndex:
    """The postings as Parquet files sorted by token, so that a search reads the pages of its prefixes only; by default in the shared folder."""
    spark = nodes.sparkSession
    path = path or f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    index = index_tables(nodes)
    index.postings.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    return open_index(spark, path)


def open_index(spark, path: str) -> SearchIndex:
    return SearchIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus"))


def bm25(tf: Column, df: Column, dl: Column) -> Column:
    idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def search_index(index: SearchIndex, query: str) -> DataFrame:
    """(id, score) of all nodes that have one of the query's words as a prefix, by Okapi BM25; a frequent prefix counts a little still."""
    words = query_words(query)
    if not words:
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    found = index.postings.where(any_of([F.startswith("token", F.lit(w)) for w in words]))
    hits = found.groupBy("id").agg(F.first("dl").alias("dl"), *(F.sum(F.when(F.startswith("token", F.lit(w)), F.col("tf")).otherwise(0)).alias(f"tf{k}") for k, w in enumerate(words)))
    df = hits.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))))
    numbers = index.corpus.join(F.broadcast(df), F.lit(True))  # one row each
    total = sum((bm25(F.col(f"tf{k}"), F.col(f"df{k}"), F.col("dl")) for k in range(len(words))), F.lit(0.0))
    return hits.join(F.broadcast(numbers), F.col("n") > 0).select("id", F.round(total, 6).alias("score"))


def search_nodes(nodes: DataFrame, query: str, kinds: Sequence[str] | None = None, languages: Sequence[str] | None = None, include: str | None = None, exclude: str | None = None, limit: int = 20, offset: int = 0, index: SearchIndex | None = None) -> DataFrame:
    """(id, score) of the best nodes for any of the query's words. index: of these nodes; without one it is worked out for this search.

    Filters choose among the hits; the numbers of the corpus are those of all nodes.
    """
    hits = search_index(index or index_tables(nodes), query)
    some = nodes
    for name, values in (("kind", kinds), ("language", languages)):
        if values is not None:
            some = some.where(F.col(name).isin(list(values)))
    if include:
        some = some.where(F.col("file_path").rlike(include))
    if exclude:
        some = some.where(~F.col("file_path").rlike(exclude))
    if some is not nodes:
        hits = hits.join(some.select("id"), "id", "left_semi")
    return hits.select("id", "score").orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def search_many(index: SearchIndex, queries: DataFrame, limit: int = 15) -> DataFrame:
    """(number, id, pos): the best nodes for each (number, text), in order from 0.

    Words and tokens meet by their first two characters before prefixes are compared, so neither table need be small.
    """
    asked = queries.select("number", F.explode(F.array_distinct(tokens("text"))).alias("word"))
    words = asked.select("word").distinct().withColumn("begin", F.substring("word", 1, 2))
    begins = F.array_distinct(F.array(F.substring("token", 1, 1), F.substring("token", 1, 2)))  # words may have one character
    known = index.postings.select("token").distinct().withColumn("begin", F.explode(begins)).join(words, "begin").where(F.startswith("token", F.col("word"))).select("token", "word")
    tf = index.postings.join(known, "token").groupBy("word", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    part = tf.join(df, "word").join(F.broadcast(index.corpus), F.col("n") > 0).select("word", "id", bm25(F.col("tf"), F.col("df"), F.col("dl")).alias("s"))
    total = asked.join(part, "word").groupBy("number", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    # The best of each question are chosen while they are aggregated, so a question with many hits is no hot task.
    best = total.groupBy("number", F.pmod(F.xxhash64("id"), F.lit(32)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, limit).alias("x"))
    top = best.groupBy("number").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, limit).alias("x"))
    return top.select("number", F.posexplode("x").alias("pos", "r")).select("number", F.col("r.id").alias("id"), "pos")


def ask_scores(pages: DataFrame, question: str, content: str = "content") -> DataFrame:
    """pages with a score: occurrences of the question's words of more than two characters, and 50 for the whole question."""
    text = F.lower(F.coalesce(content, F.lit("")))
    total = F.when(F.contains(text, F.lit(question.lower())), 50).otherwise(0).cast("long")
    for term in question.lower().split():
        if len(term) > 2:
            total = total + occurrences(text, term)
    return pages.withColumn("score", total)


def ask_top(pages: DataFrame, question: str, key: str, content: str = "content", limit: int = 5) -> DataFrame:
    return ask_scores(pages, question, content).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def ask_context(pages: DataFrame, question: str, key: str, title: str, content: str = "content", room: int = 24000) -> DataFrame:
    """One row: the texts of the best pages under headings, each with an equal share of the room, and how many there are."""
    top = ask_top(pages, question, key, content)
    n = top.agg(F.count("*").alias("n"))
    best = top.join(F.broadcast(n), F.col("n") > 0)
    share = F.floor(F.lit(room) / F.col("n")).cast("int")
    block = F.concat(F.lit("\n\n--- PAGE: "), F.col(title).cast("string"), F.lit(" ("), F.col(key).cast("string"), F.lit(") ---\n"), F.substr(F.coalesce(content, F.lit("")), F.lit(1), share))
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), block.alias("block")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["block"]), "").alias("context"), F.size("rows").cast("long").alias("n_pages"))
