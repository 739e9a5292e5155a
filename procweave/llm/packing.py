"""Packing tokenized documents into sequences of a fixed length.

A document's ids end with an id of its own. Documents longer than a sequence are cut into full
pieces, each a sequence by itself, and a last piece. The last pieces are dealt by a hash of their row's number into
groups of a few thousand, whatever the corpus' size; a group is filled best-fit decreasing and
then improved by local search: pieces are moved, or exchanged one for one or two for one, between
underfull sequences so that the sum of squared fills grows, until sequences empty.

Null texts are empty; an empty text is one piece of the end id. Equal texts give equal pieces,
repeated rows pieces of their own. Every id is in exactly one piece, whatever a text's length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.text import slices
from procweave.session import Staging

#: Words whose ids a worker remembers.
CACHED_WORDS = 700_000

#: Words of letters that need no normalizing and are one match of the pattern, with a mark after it
#: that is another: a-z and the lower-case letters of U+00E0 to U+00FF, as UTF-8.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+)([.,]?)")

#: The character that stands for a byte in byte-level vocabularies: printable Latin-1 characters
#: for themselves, the other bytes, in order, from U+0100.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Last pieces that are packed together.
GROUP_PIECES = 8000


#: What a tokenizer file must declare for its words to be encoded one by one: fixed values of the format.
BY_WORDS = (
    ["NFC", "Replace", "Lowercase"], [r"\s+", " "], ["Split", "ByteLevel"],
    [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True, False, False], None, ["BPE", "</w>", None],
    [("<|startoftext|>", False), ("<|endoftext|>", False)],
)


def parts_of(declared: dict) -> tuple | None:
    """The parts of a tokenizer file that BY_WORDS is about; None if they are of other kinds."""
    try:
        normalizers, splits, model = declared["normalizer"]["normalizers"], declared["pre_tokenizer"]["pretokenizers"], declared["model"]
        replace, split, level = normalizers[1], splits[0], splits[1]
        return (
            [n["type"] for n in normalizers], [replace["pattern"]["Regex"], replace["content"]], [s["type"] for s in splits],
            [split["pattern"]["Regex"], split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]], declared["post_processor"],
            [model["type"], model["end_of_word_suffix"], model["dropout"]], [(t["content"], t["normalized"]) for t in declared["added_tokens"]],
        )
    except (KeyError, IndexError, TypeError):
        return None


class WordIds(dict):
    """Ids of words by their bytes, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and no match of its pattern crosses it, so a text's ids are
    those of its runs of other characters, one after another. It lower-cases, so A-Z may be
    lowered first, unless the text could come to hold a special token. Words not seen before are
    encoded once for all texts given: plain ones by the model alone, the rest together. Files that declare
    other parts than BY_WORDS encode whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.by_words = parts_of(declared) == BY_WORDS
        if not self.by_words:
            return
        self.model = self.tokenizer.model
        self.marks = {m.encode(): array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in (".", ",")}

    def learn(self, fresh: set[bytes]) -> None:
        others, tokenize = [], self.model.tokenize
        for word in fresh:
            if plain := PLAIN.fullmatch(word):
                stem, mark = plain.groups()
                ids = self.get(stem)
                if ids is None:
                    ids = self[stem] = array("I", [t.id for t in tokenize(stem.decode("latin-1").translate(BYTE_CHARS))]).tobytes()
                if mark:
                    self[word] = ids + self.marks[mark]
            else:
                others.append(word)
        for k in range(0, len(others), 10_000):
            part = others[k : k + 10_000]
            made = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
            self.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, made, strict=True))

    def of(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(self.get, w)) for w in words]
        lacking = [(w, f, [k for k, x in enumerate(f) if x is None]) for w, f in zip(words, found, strict=True) if None in f]
        self.learn({w[k] for w, _, at in lacking for k in at})
        for w, f, at in lacking:
            for k in at:
                f[k] = self[w[k]]
        if len(self) > CACHED_WORDS:
            self.clear()
        return [b"".join(f) for f in found]


@cache
def word_ids(path: str) -> WordIds:
    """A worker's own, for all its tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids in pieces of at most `length`."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in slices(batches, text):
            at, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, own_ids in enumerate(words.of([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])):
                found = own_ids + end
                n = len(found) // 4
                for p, s in enumerate(range(0, n, length)):
                    own = found[4 * s : 4 * (s + length)]
                    at.append(i)
                    piece.append(p)
                    start.append(s)
                    size.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype("int32"))
            made = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            if with_ids:
                offsets = np.cumsum([0, *map(len, ids)], dtype="int32")
                flat = np.concatenate(ids) if ids else np.array([], "int32")
                made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of indexes of sizes."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        roomy = open_mask >> size
        if roomy:
            free = size + (roomy & -roomy).bit_length() - 1
            k = by_free[free].pop()
            if not by_free[free]:
                open_mask ^= 1 << free
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        if free > size:
            by_free[free - size].append(k)
            open_mask |= 1 << (free - size)
    return bins


class _Search:
    """Local search over the underfull bins; squared fill grows with each step, so it ends."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.open = {k for k, f in enumerate(self.fill) if f < capacity}
        self.has: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # size -> open bins with it, and an item
        self.mask = 0
        for k in self.open:
            self._list(k)

    def _list(self, k: int) -> None:
        for i in self.bins[k]:
            self.has[self.sizes[i]][k] = i
            self.mask |= 1 << self.sizes[i]

    def _unlist(self, k: int) -> None:
        for i in self.bins[k]:
            own = self.has[self.sizes[i]]
            own.pop(k, None)
            if not own:
                self.mask &= ~(1 << self.sizes[i])

    def exchange(self, k: int, give: list[int], t: int, take: list[int]) -> None:
        """Bin t, the fuller, gets `give` of bin k for `take`."""
        for b in (k, t):
            self._unlist(b)
        for source, target, items in ((k, t, give), (t, k, take)):
            for i in items:
                self.bins[source].remove(i)
                self.bins[target].append(i)
        for b in (k, t):
            self.fill[b] = sum(self.sizes[i] for i in self.bins[b])
            if self.fill[b] == self.capacity or not self.bins[b]:
                self.open.discard(b)
            else:
                self.open.add(b)
                self._list(b)

    def _partner(self, k: int, given: int, largest: int) -> tuple[int, int] | None:
        """A bin at least as full as k with an item under `given` that makes room for it: the item leaving least room."""
        low = max(1, given - largest)
        window = self.mask & ((1 << given) - 1) & ~((1 << low) - 1)
        best = None
        while window:
            size = (window & -window).bit_length() - 1
            window &= window - 1
            for t, i in self.has[size].items():
                room = self.capacity - self.fill[t] - (given - size)
                if t != k and room >= 0 and self.fill[t] >= self.fill[k] and (best is None or room < best[0]):
                    best = (room, t, i)
                    if not room:
                        return best[1:]
        return best[1:] if best else None

    def improve(self, k: int) -> bool:
        """One step that takes from bin k, the emptier."""
        sizes = self.sizes
        largest = max((self.capacity - self.fill[t] for t in self.open if t != k), default=0)
        if not largest:
            return False
        own = sorted(self.bins[k], key=lambda i: -sizes[i])
        for i in own:  # move
            if sizes[i] <= largest:
                room, t = min(((self.capacity - self.fill[t] - sizes[i], t) for t in self.open if t != k and self.capacity - self.fill[t] >= sizes[i] and self.fill[t] >= self.fill[k]), default=(0, None))
                if t is not None:
                    self.exchange(k, [i], t, [])
                    return True
        for i in own:  # one for one
            if found := self._partner(k, sizes[i], largest):
                self.exchange(k, [i], found[0], [found[1]])
                return True
        for a in range(len(own)):  # two for one
            for b in range(a + 1, len(own)):
                given = sizes[own[a]] + sizes[own[b]]
                if given <= self.capacity and (found := self._partner(k, given, largest)):
                    self.exchange(k, [own[a], own[b]], found[0], [found[1]])
                    return True
        return False


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes of sizes, none over capacity. The local search goes on until no step grows the squared fill."""
    bins = best_fit(sizes, capacity)
    least = -(-sum(sizes) // capacity)
    if len(bins) > least:
        search = _Search(sizes, bins, capacity)
        moved = True
        while moved and sum(map(bool, bins)) > least:
            moved = False
            for k in sorted(search.open, key=lambda k: search.fill[k]):
                while k in search.open and search.improve(k):
                    moved = True
    return [b for b in bins if b]


def place(cut: DataFrame, length: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. cut is read twice: it should be a written table."""
    whole = cut.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < length)
    groups = max(1, round(rest.count() / group_pieces))
    # rows' numbers in the written table, so that repeated rows are dealt out as others are
    rest = rest.withColumn("__pw_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        sizes = rows["length"].tolist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for k, items in enumerate(pack(sizes, length)):
            at = 0
            for i in items:
                sequence[i], offset[i] = (int(rows["__pw_group"].iat[0]) << 32) + k, at
                at += sizes[i]
        return rows.drop(columns="__pw_group").assign(sequence_id=sequence, offset=offset)

    placed = rest.groupBy("__pw_group").applyInPandas(fill, whole.schema)
    return whole.unionByName(placed)


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0) -> DataFrame:
    """Each piece of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The ids themselves are those of pieces(), by doc_id and piece."""
    staging = Staging(docs.sparkSession, "packing")
    cut = staging.write(pieces(docs, tokenizer, doc_id, text, length, end_id, with_ids=False), "pieces")
    return place(cut, length)
