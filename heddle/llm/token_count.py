"""Token counts by a two-tier lookup.

Tier one is a compact table of the corpus's frequent pre-tokens and their lengths in tokens, broadcast to all tasks;
tier two is a bounded cache on each worker, which encodes what the table lacks.  Pre-tokens are never shuffled: the
table comes from bounded summaries, one per task.

A pre-token is what stands between two single spaces.  No piece of the vocabulary has a space after another character
(the worker checks this), so merges never cross the cut and the lengths add up.  Runs of spaces can be one piece, and the
model takes U+2581 for a space: a text with two spaces side by side, or with that character, is encoded as a whole.

Defined results: a null text counts as empty, with 0 tokens and 0 bytes.  One row per row of the table, repeated or not;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Recent, small_batches, worker_state

SPACE = "▁"


class PieceCounter:
    """Lengths of pre-tokens under a sentencepiece model, with a bounded cache."""

    def __init__(self, path: str, most: int = 800_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or m.encode("a") != m.encode("a b")[: len(m.encode("a"))]:
            raise ValueError(f"pieces of {path} cross spaces: lengths of pre-tokens would not add up")
        self.lengths = Recent(most)

    def encode(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(words, num_threads=1)]

    def text(self, text: str, table: dict[str, int]) -> int:
        if not text:
            return 0
        chunks = text.split(" ")
        if "" in chunks or SPACE in text:  # runs of spaces can be pieces
            return len(self.model.encode(text))
        near = self.lengths
        found = [table.get(c) or near[c] for c in chunks]
        if None in found:
            new = list({c for c, n in zip(chunks, found, strict=True) if n is None})
            lengths = dict(zip(new, self.encode(new), strict=True))
            found = [lengths[c] if n is None else n for c, n in zip(chunks, found, strict=True)]
            for c, n in lengths.items():
                near.keep(c, n)
        return sum(found)


def counter(path: str) -> PieceCounter:
    state = worker_state()
    if ("pieces", path) not in state:
        state["pieces", path] = PieceCounter(path)
    return state["pieces", path]


def frequent(docs: DataFrame, text: str = "text", size: int = 16_384, per_task: int = 4_096, room: int = 100_000) -> list[str]:
    """The corpus's frequent pre-tokens: each task counts all of its texts, in so much room, and reports its per_task most frequent.

    What is in the table only decides what is looked up where, never a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update((t or "").split(" "))
                if len(seen) > room:  # lossy counting: the rare half goes
                    seen = Counter(dict(seen.most_common(room // 2)))
        top = [(w, n) for w, n in seen.most_common(per_task) if 0 < len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    found = docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(size).collect()]


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 4096, keep: tuple[str, ...] = ("doc_id",), table_size: int = 16_384) -> DataFrame:
    """keep, n_bytes (UTF-8), n_tokens, over_limit for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    words = frequent(docs, text, table_size)
    lengths = PieceCounter(path).encode(words) if words else []
    # Compact: one string and one byte a word (longer ones are left to the workers).
    kept = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256]
    table = spark.sparkContext.broadcast((" ".join(w for w, _ in kept), bytes(n for _, n in kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        joined, sizes = table.value
        near = dict(zip(joined.split(" "), sizes, strict=True)) if sizes else {}
        for batch in batches:
            column = batch.column(text)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in keep),
                    pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64()),
                    n := pa.array([c.text(t, near) if t else 0 for t in column.to_pylist()], pa.int64()),
                    pc.greater(n, limit),
                ],
                names=[*keep, "n_bytes", "n_tokens", "over_limit"],
            )

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{k}` {fields[k]}" for k in keep), "n_bytes bigint, n_tokens bigint, over_limit boolean"]))
