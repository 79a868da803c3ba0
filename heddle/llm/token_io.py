"""Token ids as binary files, written by a context-mixing range coder and read back.

Documents are range-partitioned by id and sorted; each task encodes its texts with the tokenizers library, ends every
document with an end id, and writes files of at most segment_ids ids into a folder that all executors reach.  A file
holds an index of its documents and independently coded blocks, each with the checksum of its payload:

    magic "HTK4", then little-endian int64: part, segment, documents, ids, block length, blocks, bytes of the tables
    per document int64 doc_id and int64 ids with the end id (a null id is written as the least int64)
    the tables of order 0 and order 1 and the first weights, from which every block starts, and their uint32 crc32
    per block uint32 payload length and uint32 crc32 of the payload; then the payloads
    (the last block is filled up with end ids)

A task that is run again writes the same file under the same name: the file appears whole, by a rename.

Ids are held in 16 bits: a vocabulary of over 65,536 ids is refused.

Defined results: a null text is encoded as an empty one, to its end id alone.  Null ids come first; rows that share an
id follow each other, in the order of their texts' hashes.  An empty table gives no file and an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.bpe import PATTERN, byte_chars
from heddle.llm.common import Recent, shared_dir, small_batches, stage, worker_state
from heddle.llm.context_coder import Tables, checksum, decode_blocks, encode_blocks

MAGIC = b"HTK4"
NULL_ID = -(1 << 63)
BLOCK = 1024  # ids
LANES = 8192  # blocks that are coded in step


#: A chunk of a word and ASCII marks; no pre-token of letters and marks goes over the border between both.
WORD_MARKS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\[-`{-~]*)$"


def end_to_end(flat: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces at of flat, whose pieces have n ids each, one after the other; and their sizes."""
    sizes = n[at]
    stop = np.cumsum(sizes, dtype=np.int32)
    start = np.cumsum(n, dtype=np.int32) - n
    place = np.repeat(start[at] - (stop - sizes), sizes)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], sizes


class LibraryEncoder:
    """The tokenizers library behind a bounded table of pre-tokens; the texts are cut into chunks at single spaces.

    A pre-token of the byte-level pattern has a space only at its start, so the ids of chunks add up to those of the text,
    unless a chunk is empty or touches other white space, or the text holds a special string: such texts are encoded whole.
    Pre-tokens that the table lacks go to the library together, in the characters that stand for their bytes: a second
    tokenizer of the same model cuts them apart at line ends, which takes half the time of a text for each.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has over 65,536 ids, more than the files' 16 bits hold")
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        chars = byte_chars()
        self.chars, self.line_end = dict(enumerate(chars)), self.library.token_to_id(chars[10])
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(chars[10], "isolated")
        self.pre = regex.compile(PATTERN).findall
        self.table = Recent(most)  # ids of a pre-token, 16 bits each

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, from the library; those that hold line ends go alone."""
        if self.line_end is None:
            return [x.tobytes() for x in self.whole(pretokens)]
        text = "\n".join(pretokens) + "\n"
        if text.count("\n") <= len(pretokens):
            return self.joined(text, len(pretokens)) if pretokens else []
        apart, rest = [p for p in pretokens if "\n" not in p], [p for p in pretokens if "\n" in p]
        found = {p: x.tobytes() for p, x in zip(rest, self.whole(rest), strict=True)}
        if apart:
            found |= zip(apart, self.joined("\n".join(apart) + "\n", len(apart)))
        return [found[p] for p in pretokens]

    def joined(self, text: str, n: int) -> list[bytes]:
        """Ids of n pre-tokens, each with a line end after it."""
        text = text.encode().decode("latin-1").translate(self.chars)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint16)
        ends = 2 * np.flatnonzero(ids == self.line_end)
        if len(ends) != n:
            raise ValueError("the library's ids of pre-tokens do not fit them")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(ends + 2).tolist()], ends.tolist())]

    def known(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each of the pre-tokens, which are distinct, from the table or the library."""
        table = self.table
        found = list(map(table.get, pretokens))
        lack = [k for k, x in enumerate(found) if x is None]
        if lack and table.old:
            for k in lack:
                found[k] = table[pretokens[k]]
            lack = [k for k in lack if found[k] is None]
        if lack:
            names = [pretokens[k] for k in lack]
            for k, p, x in zip(lack, names, self.merged(names), strict=True):
                found[k] = x
                table.keep(p, x)
        return found

    def found(self, chunks: list[str], before: str) -> list[bytes]:
        """Ids of each chunk after the text before; b"" if it is empty or touches other white space."""
        split = self.pre
        parts = [split(before + c) if c and not c[0].isspace() and not c[-1].isspace() else [] for c in chunks]
        distinct = list(dict.fromkeys(chain.from_iterable(parts)))
        known = dict(zip(distinct, self.known(distinct), strict=True)).__getitem__
        return [b"".join(map(known, pre)) for pre in parts]

    def laid(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that follow a space, end to end, and the ids of each; none if it is empty or touches other white space."""
        cut = pc.extract_regex(chunks, WORD_MARKS)  # most chunks are a word and the marks after it, one pre-token each
        other = np.flatnonzero(pc.is_null(cut).to_numpy(zero_copy_only=False))
        word, mark = (pc.struct_field(cut, k).dictionary_encode() for k in ("word", "mark"))
        words, marks = [" " + w for w in word.dictionary.to_pylist()], mark.dictionary.to_pylist()
        parts = self.known(words) + self.known(marks) + self.found(chunks.take(pa.array(other)).to_pylist(), " ") + [b""]
        at = np.full((len(chunks), 2), len(parts) - 1, dtype=np.int32)
        at[:, 0] = word.indices.fill_null(len(parts) - 1).to_numpy()
        at[:, 1] = mark.indices.fill_null(len(parts) - 1 - len(words)).to_numpy() + len(words)
        at[other, 0] = np.arange(len(other)) + len(words) + len(marks)
        n = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts)) >> 1
        flat, sizes = end_to_end(np.frombuffer(b"".join(parts), dtype=np.uint16), n, at.reshape(-1))
        return flat, sizes[::2] + sizes[1::2]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text (uint16); the distinct chunks of all texts are looked up or encoded once, and laid end to end."""
        if not len(texts):
            return
        texts = texts.cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy()
        coded = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        first, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        at, chunks = coded.indices.to_numpy().copy(), coded.dictionary
        heads, place = np.unique(at[first], return_inverse=True)
        # One table for both kinds of chunks: those after a space, then those that start a text.
        at[first] = len(chunks) + place
        flat, n = self.laid(chunks)
        parts = self.found(chunks.take(pa.array(heads)).to_pylist(), "")
        flat = np.concatenate([flat, np.frombuffer(b"".join(parts), dtype=np.uint16)])
        n = np.concatenate([n, np.array([len(x) >> 1 for x in parts], dtype=np.int32)])
        ids, sizes = end_to_end(flat, n, at)
        odd = np.logical_or.reduceat(sizes == 0, first)
        for special in self.specials:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        stop = np.cumsum(sizes, dtype=np.int64)
        odd = np.flatnonzero(odd)
        alone = dict(zip(odd.tolist(), self.whole(texts.take(pa.array(odd)).to_pylist()), strict=True)) if len(odd) else {}
        a = 0
        for k, b in enumerate(stop[ends - 1].tolist()):
            yield alone.get(k, ids[a:b]) if alone else ids[a:b]
            a = b


def file_bytes(part: int, segment: int, doc_ids: list[int], counts: list[int], ids: np.ndarray, end: int) -> bytes:
    length = min(BLOCK, len(ids))
    n = -(-len(ids) // length)
    blocks = np.full(n * length, end, dtype=np.uint16)
    blocks[: len(ids)] = ids
    tables = Tables.of(blocks, length)
    blocks = blocks.reshape(n, length)
    payloads = [p for a in range(0, n, LANES) for p in encode_blocks(blocks[a : a + LANES], tables)]
    index = np.empty((len(doc_ids), 2), dtype="<i8")
    index[:, 0], index[:, 1] = doc_ids, counts
    model = tables.to_bytes()
    sums = np.array([(len(p), checksum(p)) for p in payloads], dtype="<u4")
    head = struct.pack("<7q", part, segment, len(doc_ids), len(ids), length, n, len(model))
    return b"".join([MAGIC, head, index.tobytes(), model, struct.pack("<I", checksum(model)), sums.tobytes(), *payloads])


def read_file(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """part, segment, index (doc_id, count), ids of a file; raises if a checksum fails."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    part, segment, n_docs, n_ids, length, n, n_model = struct.unpack("<7q", data[4:60])
    index = np.frombuffer(data, dtype="<i8", count=2 * n_docs, offset=60).reshape(-1, 2)
    at = 60 + 16 * n_docs
    model = data[at : at + n_model]
    at += n_model + 4
    if struct.unpack("<I", data[at - 4 : at])[0] != checksum(model):
        raise ValueError(f"the tables of part {part}, segment {segment} are damaged")
    tables, _ = Tables.from_bytes(model)
    table = np.frombuffer(data, dtype="<u4", count=2 * n, offset=at).reshape(-1, 2)
    at += 8 * n
    payloads = []
    for b, (size, crc) in enumerate(table.tolist()):
        payloads.append(data[at : at + size])
        at += size
        if checksum(payloads[-1]) != crc:
            raise ValueError(f"block {b} of part {part}, segment {segment} is damaged")
    ids = np.concatenate([decode_blocks(payloads[a : a + LANES], length, tables) for a in range(0, n, LANES)]).reshape(-1)[:n_ids]
    return part, segment, index, ids


def write(docs: DataFrame, path: str, folder: str, end: int = 0, id_col: str = "doc_id", text: str = "text", segment_ids: int = 8_000_000, parts: int | None = None, part_bytes: int = 128 << 20) -> DataFrame:
    """Writes docs to folder (a URI that all executors reach) and returns part, segment, file, n_docs, n_ids of each file."""
    spark = docs.sparkSession
    small_batches(spark)
    if not parts:  # as many as shuffles have, more if they held over part_bytes of text each
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(parts, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // part_bytes))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        part, segment = task.partitionId(), 0
        state = worker_state()
        encoder = state.get(("library", path)) or state.setdefault(("library", path), LibraryEncoder(path))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held: list[np.ndarray] = []
        stop = np.array([end], dtype=np.uint16)
        doc_ids: list[int] = []
        counts: list[int] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            name = f"part-{part:05d}-{segment:04d}.tok"
            temporary = f"{base}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(temporary) as f:
                f.write(file_bytes(part, segment, doc_ids, counts, ids, end))
            store.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "file": name, "n_docs": len(doc_ids), "n_ids": len(ids)}])

        for batch in batches:
            ids_column = batch.column("id").to_pylist()
            for doc_id, ids in zip(ids_column, encoder.texts(batch.column("text")), strict=True):
                held += (ids, stop)
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                counts.append(len(ids) + 1)
                n_held += counts[-1]
                if n_held >= segment_ids:
                    yield flush()
                    segment += 1
                    n_held, held, doc_ids, counts = 0, [], [], []
        if held:
            yield flush()

    return stage(rows.select("id", "text").mapInArrow(run, "part bigint, segment bigint, file string, n_docs bigint, n_ids bigint"), "token-files")


def read_index(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """part, segment, doc_id, before (ids of the file before it), n_tokens, ids_crc32, from the files' decoded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                part, segment, index, ids = read_file(content.as_py())
                ends = np.cumsum(index[:, 1])
                starts = ends - index[:, 1]
                wide = ids.astype("<u4")
                n = len(index)
                out = {
                    "part": pa.array(np.full(n, part), pa.int64()),
                    "segment": pa.array(np.full(n, segment), pa.int64()),
                    "doc_id": pa.array([None if i == NULL_ID else i for i in index[:, 0].tolist()], pa.int64()),
                    "before": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(index[:, 1], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("content")
    schema = "part bigint, segment bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return files.mapInArrow(run, schema)


def write_and_read(docs: DataFrame, path: str, folder: str | None = None, end: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files read back; start counts all ids before it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/heddle-tokens-{uuid.uuid4().hex}"
    files = write(docs, path, folder, end, id_col, text)
    if files.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    # One row per file passes through the ungrouped window.
    before = files.select("part", "segment", (F.sum("n_ids").over(Window.orderBy("part", "segment")) - F.col("n_ids")).alias("file_start"))
    out = read_index(spark, folder).join(before, ["part", "segment"])
    return out.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
