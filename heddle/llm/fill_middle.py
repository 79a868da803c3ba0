"""Fill-in-the-middle: texts are cut in three and put together anew, the middle last.

One numpy kernel works on the UTF-8 buffer of many rows at once.  A table gives every byte its class; a second table says,
for a byte's class and that of the byte before it, whether a unit (a code point, a word or a line) starts there; the first
byte of a text always starts one.  Running sums of these marks, less the sum before the text's first byte, number the units
of every text, and one search in the running sums finds the bytes at which all texts are cut.

Cuts and form hang on the text's id alone (sha256 of "<seed>:<id>"), so they are the same in every run: h1 to h4 are the
hash's first four groups of 8 hex digits; the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the
middle after the larger one.  A text is left plain if it is empty, if it holds a marker, or if h3 % 100 >= percent; of the
others those with h4 % 100 < spm_percent are written suffix first ("spm"), the rest prefix first ("psm").

Defined results: a null text is an empty one, a null id hashes as "<seed>:".  Rows are taken one by one, repeated or not; an
empty table gives an empty result; columns beside the text are carried along, whatever their names, but for those that the
result adds, which are replaced.  Bytes are worked on in pieces of some megabytes, a longer text by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.host_rules import packed, unpacked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Classes of bytes: 0 inside a code point, 1 starts one, 2 ASCII white space, 3 line end.
CLASSES = np.ones(256, dtype=np.uint8)
CLASSES[0x80:0xC0] = 0
CLASSES[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 2
CLASSES[0x0A] = 3

#: Whether a unit starts, by the class of the byte before and that of the byte itself.
_before, _here = np.indices((4, 4))
STARTS = {
    "char": _here > 0,
    "word": (_before >= 2) & (_here == 1),  # white space after a word belongs to it
    "line": _before == 3,
}


def cut_points(values: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "char") -> tuple[np.ndarray, ...]:
    """Units n of each text, the units of prefix and middle, and the bytes of values at which prefix and middle end."""
    first, end = offsets[:-1], offsets[1:]
    if not len(values):
        none = np.zeros(len(first), dtype=np.int64)
        return none, none, none, first, first
    classes = CLASSES[values]
    marks = np.empty(len(values), dtype=bool)
    marks[1:] = STARTS[unit][classes[:-1], classes[1:]]
    marks[first[first < end]] = True
    running = np.cumsum(marks)
    before = np.where(first > 0, running[first - 1], 0)
    n = np.where(end > first, running[end - 1] - before, 0)
    one, two = h1 % (n + 1), h2 % (n + 1)
    least, most = np.minimum(one, two), np.maximum(one, two)
    cut = lambda k: np.where(k == n, end, np.searchsorted(running, before + k + 1))
    return n, least, most - least, cut(least), cut(most)


def _arranged(batch: pa.RecordBatch, unit: str, percent: int, spm_percent: int, markers: tuple[str, str, str]) -> pa.RecordBatch:
    """_row, n, form, prefix_chars, middle_chars, output of the rows of batch."""
    text = batch.column("text")
    marked = pc.match_substring(text, markers[0])
    for m in markers[1:]:
        marked = pc.or_(marked, pc.match_substring(text, m))
    text = text.cast(pa.large_string())
    _, offsets, values = text.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    values = np.frombuffer(values, dtype=np.uint8)[low:high] if high > low else np.empty(0, dtype=np.uint8)
    offsets = offsets - low
    h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in ("h1", "h2", "h3", "h4"))
    n, prefix, middle, p_end, m_end = cut_points(values, offsets, h1, h2, unit)
    plain = (n == 0) | marked.to_numpy(zero_copy_only=False) | (h3 % 100 >= percent)
    spm = ~plain & (h4 % 100 < spm_percent)
    view, (p, s, m) = memoryview(values), (x.encode() for x in markers)
    parts: list[bytes | memoryview] = []
    for a, b, c, d, is_plain, is_spm in zip(offsets[:-1].tolist(), p_end.tolist(), m_end.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
        if is_plain:
            parts.append(view[a:d])
        elif is_spm:
            parts += (s, view[c:d], p, view[a:b], m, view[b:c])
        else:
            parts += (p, view[a:b], s, view[c:d], m, view[b:c])
    sizes = np.diff(offsets) + np.where(plain, 0, len(p) + len(s) + len(m))
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    output = pa.StringArray.from_buffers(len(text), pa.py_buffer(ends), pa.py_buffer(b"".join(parts)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("_row"),
            pa.array(n, pa.int64()),
            pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
            pa.array(prefix, pa.int64(), mask=plain),
            pa.array(middle, pa.int64(), mask=plain),
            output,
        ],
        names=["_row", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def arrange(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1", unit: str = "char", percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), piece_bytes: int = 4 << 20) -> DataFrame:
    """docs without its text, with n, form, prefix_chars, middle_chars (units; null if plain) and output."""
    if unit not in STARTS:
        raise ValueError(f"unit is one of {', '.join(STARTS)}")
    if len(set(markers)) < 3 or any("<" in m[1:] or m[:1] != "<" for m in markers):
        raise ValueError("markers are three different strings that hold '<' at their start alone, so that no text can run into one")
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_none"))
    rows = packed(docs.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit(""))), {"text": "_text", "id": id_col})
    kept = [F.col("_row")[c].alias(c) for c in rest.columns[:-1]]
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(h, 8 * k - 7, 8), 16, 10).cast("bigint").alias(f"h{k}") for k in range(1, 5)]
    rows = rows.select((F.struct(*kept) if kept else F.struct(F.lit(0).alias("_none"))).alias("_row"), "text", *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            # Rows whose texts end in the same stretch of so many bytes are one piece.
            cuts = np.flatnonzero(np.diff(ends // piece_bytes)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                yield _arranged(batch.slice(a, b - a), unit, percent, spm_percent, markers)

    row = rows.schema["_row"].dataType.simpleString()
    out = unpacked(rows.mapInArrow(run, f"_row {row}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"))
    return out if kept else out.drop("_none")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of the given form was made of."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    back = F.when(form == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2))).when(form == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
    return back.otherwise(output)
