"""Retrieval of context: chunks, keyword scores, cosine scores, the best k per query as text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.functions import wordlists as W
from heddle.operators.vectors import CellIndex, exact_top_k, units
from heddle.sources.staging import stage

WORD = re.compile("[a-z0-9_]+")


def chunk_files(files: DataFrame, size: int = 512) -> DataFrame:
    """files(project, path, content) to (project, path, idx, text)."""
    return files.select("project", "path", F.posexplode(T.chunks(F.coalesce("content", F.lit("")), size)).alias("idx", "text"))


def keywords(prompt: Column, most: int = 10) -> Column:
    """First words of four letters or more that are no stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(prompt), F.lit(r"(?<![a-zA-Z0-9_])[a-zA-Z]{4,}(?![a-zA-Z0-9_])"), F.lit(0))
    return F.slice(F.filter(found, lambda w: ~w.isin(W.STOP_WORDS)), 1, most)


def keyword_scores(chunks: DataFrame, queries: DataFrame, query_id: str = "query_id", prompt: str = "prompt", same_project: bool = False) -> DataFrame:
    """query_id, project, path, idx, score: the number of the query's keywords that a chunk contains; texts are joined to the best only.

    With same_project, queries carry a project and only meet its chunks (an equi-join).  Without, the distinct keywords of
    all queries are a stated set: every chunk is searched once for them, and only what it contains is joined to the queries.
    """
    q = queries.select(query_id, *(["project"] if same_project else []), keywords(F.col(prompt)).alias("_k"))
    if same_project:
        score = F.size(F.filter("_k", lambda w: F.contains(F.lower("text"), w)))
        return chunks.join(q, "project").withColumn("score", score).filter("score > 0").select(query_id, "project", "path", "idx", "score")
    each = q.select(query_id, F.explode("_k").alias("_w")).groupBy(query_id, "_w").agg(F.count(F.lit(1)).alias("_n"))
    named = chunks.withColumn("_low", F.lower("text"))
    hits = found_words(named, "_low", each.select("_w").distinct())
    return hits.join(each, "_w").groupBy(query_id, "project", "path", "idx").agg(F.sum("_n").cast("int").alias("score"))


def found_words(chunks: DataFrame, low: str, words: DataFrame, most: int = 100_000) -> DataFrame:
    """project, path, idx, _w: which of words(_w) each chunk contains as text.

    Up to most words are held in every task, as an automaton (pyahocorasick) that reads a text once for all of them.  More of
    them are joined instead, by their first four characters, with the same rows as result.
    """
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, 4))
    table = [r["_w"] for r in words.orderBy("_w").limit(most + 1).collect()]
    spark = chunks.sparkSession
    key = ["project", "path", "idx"]
    if len(table) > most:
        by_start = words.withColumn("_g", F.substring("_w", 1, 4))
        pairs = chunks.select(*key, low, F.explode(F.array_distinct(grams(F.col(low)))).alias("_g"))
        return pairs.join(by_start, "_g").filter(F.contains(low, F.col("_w"))).select(*key, "_w").distinct()
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(sent.value)
        for texts in batches:
            yield texts.map(find)

    return chunks.select(*key, F.explode(search(F.col(low))).alias("_w"))


def finder(words: list[str]) -> Callable[[str | None], list[str]]:
    """A function from a text to those of the words that it contains."""
    import ahocorasick

    tree = ahocorasick.Automaton()
    for w in words:
        tree.add_word(w, w)
    if not words:
        return lambda t: []
    tree.make_automaton()
    return lambda t: list({w for _, w in tree.iter(t)}) if t else []


def fit_vectoriser(texts: DataFrame, column: str = "text", size: int = 256, buckets: int = 1 << 16) -> Callable[[list[str]], list[list[float]]]:
    """A function from texts to vectors: words by term frequency times inverse document frequency, hashed with signs, length 1.

    The document frequencies are counted over all texts, by the word's hash, so they are a table of at most so many numbers.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(WORD.pattern), F.lit(0)), lambda w: F.pmod(F.crc32(w), F.lit(buckets))))
    seen = texts.select(F.explode(words).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n, counts = texts.count(), np.zeros(buckets)
    counts[seen["b"].to_numpy(dtype=np.int64)] = seen["n"].to_numpy()
    weight = (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)

    def run(batch: list[str]) -> list[list[float]]:
        out = np.zeros((len(batch), size))
        for row, text in zip(out, batch, strict=True):
            for w, times in Counter(WORD.findall(text.lower())).items():
                h = zlib.crc32(w.encode())
                g = zlib.crc32(b"place " + w.encode())
                row[(g >> 1) % size] += (1 if g & 1 else -1) * times * float(weight[h % buckets])
        return units(out).tolist()

    return run


def embed(texts: DataFrame, column: str = "text", vectoriser: Callable[[list[str]], list[list[float]]] | None = None, into: str = "embedding") -> DataFrame:
    """texts with the vectors that a function from a list of texts to a list of vectors gives, a batch at a time; without one,
    of a function that is fitted on these texts."""
    vectoriser = vectoriser or fit_vectoriser(texts, column)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(vectoriser(batch.fillna("").tolist()))

    return texts.withColumn(into, run(F.col(column)))


def best(scores: DataFrame, k: int = 5, query_id: str = "query_id") -> DataFrame:
    """The k best chunks of each query; ties go to the smaller path and index.  The window is limited before it is shuffled."""
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "path", "idx")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def as_text(top: DataFrame, query_id: str = "query_id", note: Column | None = None) -> DataFrame:
    """One text per query: its k chunks in order, each under its file's name and, if given, a note."""
    head = F.concat(F.lit("From "), "path", F.lit(":\n"), "text") if note is None else F.concat(F.lit("From "), "path", F.lit(" (chunk "), (F.col("idx") + 1).cast("string"), F.lit(", "), note, F.lit("):\n"), "text")
    parts = F.array_sort(F.collect_list(F.struct("rank", head.alias("t"))))
    return top.groupBy(query_id).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 where it is undefined."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.nanvl(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)), F.lit(0.0))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar vectors of each query, itself left out: a stated query set against all rows."""
    return exact_top_k(vectors, queries, k, id_col, vector)


def retrieve(files: DataFrame, queries: DataFrame, method: str = "keyword", k: int = 5, size: int = 512, vectoriser: Callable[[list[str]], list[list[float]]] | None = None, index: bool = False) -> DataFrame:
    """query_id, context: the text of the best chunks for each of queries(query_id, prompt), or (query_id, project, prompt),
    which then meet their project's files alone.

    "embedding" embeds chunks and prompts by the vectoriser (fitted on the chunks, if none is given) and takes the most similar
    chunks; queries it finds nothing for, as their prompt has no vector or a vector of zeros, fall back to "keyword".  index
    searches by an index of cells in place of all chunks (queries without project).  "keyword", and any other method, counts
    keywords; queries of a project without any hit get the first chunk of their first k files.
    """
    chunks = chunk_files(files, size)
    same = "project" in queries.columns
    if method != "embedding":
        return _by_keywords(chunks, queries, k, same)
    chunks = stage(chunks.withColumn("vec_id", F.monotonically_increasing_id()), "chunks")
    model = vectoriser or fit_vectoriser(chunks)
    # Ids of queries are below zero: they share a column with those of chunks and must not meet them.
    asked = stage(queries.withColumn("vec_id", -1 - F.monotonically_increasing_id()), "asked")
    rows, prompts = stage(embed(chunks, "text", model), "embedded"), stage(embed(asked, "prompt", model), "embedded-prompts")
    prompts = prompts.filter(F.exists("embedding", lambda x: x != 0))
    if index and not same:
        hits = CellIndex(rows).search(prompts, k)
    else:
        hits = exact_top_k(rows, prompts, k, key="project" if same else None)
    top = hits.join(chunks, "vec_id").join(asked.select(F.col("vec_id").alias("_asked"), F.col("query_id").alias("_named")), F.col("query_id") == F.col("_asked"))
    top = top.select(F.col("_named").alias("query_id"), "rank", "path", "idx", "text", "score")
    found = stage(as_text(top, note=F.concat(F.lit("similarity: "), F.format_string("%.3f", "score"))), "contexts")
    return found.unionByName(_by_keywords(chunks.drop("vec_id"), queries.join(found, "query_id", "left_anti"), k, same))


def _by_keywords(chunks: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    top = best(keyword_scores(chunks, queries, same_project=same), k).join(chunks, ["project", "path", "idx"])
    found = as_text(top, note=F.concat(F.lit("keyword matches: "), F.col("score").cast("string")))
    if not same:
        return found
    first = chunks.filter("idx = 0").join(queries.join(found, "query_id", "left_anti").select("query_id", "project"), "project")
    spare = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("path"))).filter(F.col("rank") <= k)
    return found.unionByName(as_text(spare))
