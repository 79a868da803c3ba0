"""Byte-level BPE encoding and decoding.

A pre-token's bytes are a doubly linked list of symbols; a priority queue holds the ranks of the merges that
neighbours allow, entries whose neighbours have changed meanwhile are skipped.  Decoding concatenates the vocabulary's
byte strings.  Vocabulary files are read on the workers from a path that is a parameter; nothing is trained.

Defined results: a null text is encoded as an empty one, to no ids.  Rows keep their number and order in a partition,
repeated or not; an empty table gives an empty result; extra columns are ignored.  A special string inside a text
becomes its id.  Bytes that are no UTF-8 after decoding become U+FFFD, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from heddle.llm.common import Recent, small_batches, worker_state

#: White space by Unicode's property, and the pre-token pattern of byte-level BPE.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


#: Whether a chunk is of letters alone, so that it is one pre-token, with or without a space before it.
letters = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Unclean(Exception):
    """A chunk between two single spaces that is empty or touches other white space."""


class BytePairCoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.first = [vocab[c] for c in chars]
        self.text_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of |= {i: t.encode() for t, i in self.specials.items()}
        # By pair of ids: place in the order of merges, from 1, above 32 bits for a position.  By that place: the id it makes.
        self.rank: dict[int, int] = {}
        self.made = [0]
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.made) << 32
            self.made.append(vocab[a + b])
        self.pairs = [self.rank.get(a << 20 | b, 0) for a in self.first for b in self.first]  # ranks of the pairs of bytes
        self.pre = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else None
        self.pretokens = Recent(500_000, lambda t: tuple(self.merge(t.encode())))
        self.inner = Recent(1_000_000, lambda c: self.clean(c, " " + c))
        self.outer = Recent(60_000, lambda c: self.clean(c, c))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        get, made = self.rank.get, self.made
        ids = list(map(self.first.__getitem__, data))
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        want = [pairs[a << 8 | b] for a, b in zip(data, data[1:])]  # rank of the pair that starts at a symbol, 0: no merge
        want.append(0)
        heap = [r | i for i, r in enumerate(want) if r]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i = x & 0xFFFFFFFF
            if want[i] | i != x:
                continue  # stale: a neighbour was merged since
            j = after[i]
            ids[i] = new = made[x >> 32]
            ids[j], want[j] = -1, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                want[i] = r = get(new << 20 | ids[k], 0)
                if r:
                    heappush(heap, r | i)
            else:
                want[i] = 0
            h = before[i]
            if h >= 0:
                want[h] = r = get(ids[h] << 20 | new, 0)
                if r:
                    heappush(heap, r | h)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, self.pre(text))))

    def clean(self, chunk: str, text: str) -> tuple[int, ...]:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Unclean
        return self.pretokens[text] if letters(chunk) else self.words(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        A pre-token has a space only at its start, so a text may be cut before every single space that stands between
        two characters that are no white space; the chunks are encoded once and looked up after that.
        """
        if self.special:
            parts = self.special(text)
            if len(parts) > 1:
                return [i for p in parts for i in ([self.specials[p]] if p in self.specials else self.plain(p))]
        return self.plain(text)

    def plain(self, text: str) -> list[int]:
        if not text:
            return []
        chunks = text.split(" ")
        try:
            out = list(self.outer[chunks[0]])
            out.extend(chain.from_iterable(map(self.inner.__getitem__, chunks[1:])))
        except Unclean:
            return list(self.words(text))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def coder(path: str) -> BytePairCoder:
    """The worker's coder for a vocabulary file."""
    state = worker_state()
    if ("bpe", path) not in state:
        state["bpe", path] = BytePairCoder(path)
    return state["bpe", path]


def _mapped(docs: DataFrame, schema: str, make: Callable, keep: list[str], column: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = make(batch.column(column))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays.values()], names=[*keep, *arrays])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*keep, *([column] if column not in keep else [])).mapInArrow(run, ", ".join([*(f"`{c}` {fields[c]}" for c in keep), schema]))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and ids array<int> for every row of docs."""

    def make(column: pa.Array) -> dict[str, pa.Array]:
        c = coder(path)
        return {"ids": pa.array([c.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))}

    return _mapped(docs, "ids array<int>", make, list(keep), text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and text for every row of encoded; null ids give an empty text."""

    def make(column: pa.Array) -> dict[str, pa.Array]:
        c = coder(path)
        return {"text": pa.array([c.decode(x or []) for x in column.to_pylist()], pa.string())}

    return _mapped(encoded, "text string", make, list(keep), ids)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text) for every row.

    Ids and decoded texts do not leave the task; with_ids adds the ids as a column.
    """

    def make(column: pa.Array) -> dict[str, pa.Array]:
        c = coder(path)
        state = worker_state()
        if ("decimal", path) not in state:
            state["decimal", path] = {i: str(i) for i in c.text_of}
        decimal = state["decimal", path].__getitem__
        n, a, b, every = [], [], [], []
        for t in column.to_pylist():
            ids = c.encode(t or "")
            data = c.decode_bytes(ids)
            back = data.decode("utf-8", errors="replace")
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                every.append(ids)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
        return out | ({"ids": pa.array(every, pa.list_(pa.int32()))} if with_ids else {})

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _mapped(docs, schema, make, list(keep), text)
