"""Quality rules with host verdicts (DataFrame functions only).

Every document is measured; rule failures are counted by host, the hosts' rates are shrunk towards an
empirical beta prior, and the verdict on its host is joined back to each document.

Defined results: a null text has no words, so it fails the base rule.  A null host is a host of its own.
Repeated rows are measured and counted each.  An empty table gives an empty result.
Other columns are carried along, whatever their names, but for those that the result adds, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import SPACES, stage, words

SYMBOLS = "#*$%&|<>"


def _repeat_words(w: Column, n: int) -> tuple[Column, Column]:
    """Hashes of the windows of n words, as an array."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    window = lambda h: F.when(
        F.size(h) >= n,
        F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashed, window


def packed(docs: DataFrame, more: dict[str, str]) -> DataFrame:
    """The columns of docs as one struct, _row, and those named in more beside it, so that no name of the caller's clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.col(f"`{c}`").alias(k) for k, c in more.items()])


def unpacked(docs: DataFrame) -> DataFrame:
    """The columns of _row, then those beside it, which replace columns of _row that have their names."""
    beside = [c for c in docs.columns if c != "_row"]
    return docs.select(*[F.col("_row")[c].alias(c) for c in docs.schema["_row"].dataType.names if c not in beside], *beside)


def measures(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (bigint), which replace columns of these names.

    A word counts as repeated if it lies in a window of so many words that the text holds twice or more;
    the windows are compared by a 64-bit hash within one text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    docs = packed(docs, {"text": text})
    hashed, windows_of = _repeat_words(words(F.col("text")), window)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACES}]")))
    out = docs.withColumns(
        {
            "word_chars": F.length(F.regexp_replace(t, f"[{SPACES}]+", "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
            "_h": hashed,
            "_lines": lines,
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_h").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_w": windows_of(F.col("_h")),
        }
    ).drop("_h", "_lines")
    # Only texts with a repeated window pay for sorting: (hash, place) pairs, then equal neighbours.
    pairs = F.when(
        F.size(F.array_distinct("_w")) < F.size("_w"),
        F.sort_array(F.transform(F.col("_w"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    out = out.withColumn("_p", pairs).drop("_w")
    twice = F.filter(
        F.col("_p"),
        lambda x, j: ((j > 0) & (F.get(F.col("_p"), j - 1)["h"] == x["h"])) | F.coalesce(F.get(F.col("_p"), j + 1)["h"] == x["h"], F.lit(False)),
    )
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_p")
    covered = F.aggregate(
        F.col("_at"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + window - F.greatest(s["end"], i)).alias("n"), (i + window).alias("end")),
        lambda s: s["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_at", "text")
    return unpacked(out)


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = 0.6) -> DataFrame:
    """One row per host: docs, failures, shrunk rate, host_kept.

    The beta prior has the mean m of the hosts' raw rates, weighing each host alike, and (by moments) the part of their
    spread that chance alone does not make: their variance less the mean of m (1 - m) / docs.  Its strength alpha + beta
    is kept between 1 and 1000, and is 1000 if nothing is left.  A host is rejected if (failures + alpha) / (docs + alpha +
    beta) exceeds max_rate.  Hosts are one row each: the only ungrouped aggregate is over partial sums of them.
    """
    by_host = measured.groupBy(F.col(f"`{host}`").alias("_host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = by_host.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("raw"), F.avg(1 / F.col("n_docs")).alias("share"))
    most = F.col("m") * (1 - F.col("m"))
    prior = prior.withColumn("v", F.col("raw") - most * F.col("share"))
    prior = prior.withColumn("strength", F.when(F.col("v") > 1e-12, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), most / F.col("v") - 1))).otherwise(F.lit(1000.0)))
    return by_host.crossJoin(F.broadcast(prior)).select(  # prior: one row
        "_host",
        "n_docs",
        "n_failed",
        ((F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("host_rate"),
    ).withColumn("host_kept", F.col("host_rate") <= max_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.6, min_words: int = 20, repeat_percent: int = 30, keep_text: bool = True) -> DataFrame:
    """docs with the measures, base_failed, host_rate and kept; one row per row of docs.

    Measured rows are staged once, with the texts only if these are kept, then read for the hosts and for the verdicts (one
    row per host), which are joined to the documents by host.  Staging also keeps later filters from being pushed into the
    measures, whose expressions would then be repeated many times over.  Where the hosts are over Spark's broadcast limit
    the join is by shuffle, and adaptive execution splits the partition of a host that holds many documents.
    """
    m = measures(docs, text).withColumn("base_failed", base_failed(min_words, repeat_percent))
    m = stage(m if keep_text else m.drop(text), "rules")
    hosts = stage(host_verdicts(m, host, max_rate), "hosts")
    v = hosts.select("_host", "host_rate", "host_kept")
    m = packed(m, {"base_failed": "base_failed", "host": host})
    out = m.join(v, m["host"].eqNullSafe(v["_host"]), "left")
    return unpacked(out.select("_row", "host_rate", (~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).alias("kept")))
