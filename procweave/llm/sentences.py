"""SentencePiece encoding with the N best segmentations, and decoding.

The pieces of a text's lattice are a model's normal pieces with their log probabilities: the scores of
a unigram model; of a BPE model, whose scores are the ranks of its merges, those of Zipf and
Mandelbrot's law, 1 / (rank + ZIPF) over its sum. A character that is no piece is spelled in byte
pieces, at the least score less a penalty, which is also the score of pieces of one or more spaces
where the model leaves it open. A segmentation's score is the sum of its pieces' scores. Spaces are
written as U+2581, one is put in front of the text, and nothing else is normalized; models that
normalize otherwise, or that aren't unigram or BPE models, are refused.

A text's own encoding is what the model's kind defines: the best segmentation for unigram models, and
for BPE models the merges in their order, which the best one of the lattice often but not always is.

Pieces have U+2581 at their start alone, once or more, so a text's lattice falls into units, one for
each run of spaces with what follows it and each line break, and its best segmentation into the
units' best ones; no merge crosses a unit's border either. A unit's forward Viterbi scores are the exact heuristics of a backward A* search, which so pops its segmentations in order of
score and expands little else. The N best of a text differ from the best one in at most the N - 1
units whose second best costs least: these alone are searched, and combined exactly.

Null and empty texts have no pieces: one empty segmentation of score 0. Ties go to the segmentation
that the search meets first, always the same one, so equal texts get equal results.
U+2581 in a text decodes to a space, as SentencePiece defines; all else decodes to itself.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from math import log
from struct import unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from procweave.llm.text import slices

SPACE = "▁"
#: What a byte piece costs more than the worst piece; where a model leaves a piece's score open, it is under this.
PENALTY, OPEN = 10.0, -1e8
#: Of the law that gives a BPE model's pieces their probabilities.
ZIPF = 100
#: Scores are multiples of 1 / GRID, so their sums are exact: rounding would tell equal ways apart, and the search
#: of a long run of one character would widen to all of them.
GRID = 1 << 24
#: Numbers of a model file's fields and of its kinds of pieces and models: fixed values of the format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, USER_DEFINED = 1, 2, 3, 1, 4
MODEL_TYPE, UNIGRAM, BPE = 3, 1, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
#: Units, their longest in characters, and units' N best segmentations that a worker remembers.
CACHED_UNITS, CACHED_CHARS, SEARCHED_UNITS = 1_000_000, 64, 20_000
INFINITE = float("inf")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 0x7F) << shift, shift + 7, at + 1
            if byte < 0x80:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, message[at : at + size]
        at += size


class Pieces(dict):
    """A model; as a dict, the units seen: (ids, score of the best, what the second best costs, own encoding)."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.learned: dict[str, bytes] = {}
        size = model.get_piece_size()
        with open(path, "rb") as file:
            parts = list(fields(file.read()))
        of = lambda number: dict(f for k, v in parts if k == number for f in fields(v))
        normalizer, self.kind = of(NORMALIZER), of(TRAINER).get(MODEL_TYPE, UNIGRAM)
        if normalizer.get(CHARSMAP) or normalizer.get(REMOVE_SPACES, 1) or not (normalizer.get(DUMMY_PREFIX, 1) and normalizer.get(ESCAPE_SPACES, 1)):
            raise ValueError("models that normalize texts are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        table = [dict(fields(v)) for k, v in parts if k == PIECES]
        if any(p.get(KIND, NORMAL) == USER_DEFINED for p in table):
            raise ValueError("models with pieces of the user's own are not supported")
        normal = [(i, p[PIECE].decode(), unpack("<f", p[SCORE])[0] if SCORE in p else 0.0) for i, p in enumerate(table) if p.get(KIND, NORMAL) == NORMAL]
        self.rank = {p: -s for _, p, s in normal}
        total = log(sum(1 / (ZIPF - s) for _, _, s in normal if s > OPEN)) if self.kind == BPE else 0.0
        scored = [(i, p, s if self.kind == UNIGRAM or s <= OPEN else -log(ZIPF - s) - total) for i, p, s in normal]
        scored = [(i, p, round(s * GRID) / GRID) for i, p, s in scored]
        self.byte_score = min(s for _, _, s in scored if s > OPEN) - PENALTY
        self.pieces = {p: (i, s if s > OPEN else self.byte_score) for i, p, s in scored}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces) or any("\n" in p for p in self.pieces):
            raise ValueError("pieces that cross spaces or lines are not supported")
        self.longest = max(map(len, self.pieces))
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        if SPACE not in self.pieces and (i := model.piece_to_id(SPACE)) != self.unknown:
            self.pieces[SPACE] = (i, self.byte_score)  # models leave its score open
        self.spelled = {i: bytes([b]) for b, i in self.bytes.items()} | {i: p.replace(SPACE, " ").encode() for p, (i, _) in self.pieces.items()}
        self[""] = (b"", 0.0, INFINITE, b"")
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.searched: dict[tuple[str, int], list] = {}
        # pieces as a tree of characters; "" holds the (id, score) of the piece that ends there
        self.tree: dict = {}
        for p, found in self.pieces.items():
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = found

    def forward(self, unit: str) -> list[float]:
        """The score of the best way to each place."""
        n, tree = len(unit), self.tree
        best = [0.0] + [-INFINITE] * n
        for i in range(n):
            here, node, j = best[i], tree, i
            while j < n and (node := node.get(unit[j])) is not None:
                j += 1
                if (found := node.get("")) is not None and here + found[1] > best[j]:
                    best[j] = here + found[1]
            if unit[i] not in self.pieces:
                best[i + 1] = max(best[i + 1], here + self.byte_score)
        return best

    def arcs(self, unit: str, place: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the lattice's arcs that end at a place."""
        for start in range(max(0, place - self.longest), place):
            if (found := self.pieces.get(unit[start:place])) is not None:
                yield start, found[:1], found[1]
        if unit[place - 1] not in self.pieces:
            raw = unit[place - 1].encode("utf-8", "replace")
            yield place - 1, tuple(self.bytes.get(b, self.unknown) for b in raw), self.byte_score

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit, (score, ids), by A* from its end to its start."""
        forward = self.forward(unit)
        # (-(score so far + best of the rest), place, order, score so far, what follows); of equals the
        # one nearest the start goes on, so that ties don't widen the search
        heap, order, out = [(-forward[-1], len(unit), 0, 0.0, None)], 0, []
        while heap and len(out) < n:
            _, place, _, score, after = heappop(heap)
            if not place:
                ids: list[int] = []
                while after:
                    ids += after[0]
                    after = after[1]
                out.append((score, tuple(ids)))
                continue
            for start, own_ids, own in self.arcs(unit, place):
                order += 1
                heappush(heap, (-(score + own + forward[start]), start, order, score + own, (own_ids, after)))
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Merges the units of texts that weren't seen before, all at once, by the library."""
        if self.kind == UNIGRAM:
            return
        every = set().union(*texts)
        wanted = sorted({s for u in every if u not in self and (s := self.stem(u)).startswith(SPACE) and s not in self})
        # the library puts a space in front itself
        self.learned = {u: array("I", ids).tobytes() for u, ids in zip(wanted, self.model.encode([u[1:] for u in wanted], num_threads=1), strict=True)}

    def stem(self, unit: str) -> str:
        """A unit without last characters that no piece has after the ones before, as with most marks after a word."""
        while 2 < len(unit) <= CACHED_CHARS and unit[-2:] not in self.pairs:
            unit = unit[:-1]
        return unit

    def merged(self, unit: str) -> bytes:
        """A unit's ids by a BPE model's merges: the pair that makes the piece of least rank first, the left one of equals."""
        parts, before, after = list(unit), list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def pair(left: int, right: int) -> None:
            if left >= 0 and right < len(parts) and (rank := self.rank.get(parts[left] + parts[right])) is not None:
                heappush(heap, (rank, left, right, parts[left] + parts[right]))

        for k in range(len(parts) - 1):
            pair(k, k + 1)
        while heap:
            _, left, right, piece = heappop(heap)
            if after[left] != right or parts[left] + parts[right] != piece or not parts[left]:
                continue
            parts[left], parts[right], after[left] = piece, "", after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            pair(before[left], left)
            pair(left, after[left])
        ids = array("I")
        for p in filter(None, parts):
            if (found := self.pieces.get(p)) is not None:
                ids.append(found[0])
            else:
                ids.extend(self.bytes.get(b, self.unknown) for b in p.encode("utf-8", "replace"))
        return ids.tobytes()

    def __missing__(self, unit: str) -> tuple[bytes, float, float, bytes]:
        """Forward Viterbi that keeps the two best scores of each place.

        Where no piece has a unit's last two characters side by side, as with most marks after a
        word, the unit is what comes before, seen often by itself, and its last character."""
        if 2 < len(unit) <= CACHED_CHARS and unit[-2:] not in self.pairs:
            left, right = self[unit[:-1]], self[unit[-1]]
            ids = left[0] + right[0]
            own = left[3] + right[3]
            return self._keep(unit, (ids, left[1] + right[1], min(left[2], right[2]), ids if own == ids else own))
        n, tree = len(unit), self.tree
        best, second, back = [0.0] + [-INFINITE] * n, [-INFINITE] * (n + 1), [None] * (n + 1)
        for i in range(n):
            here, other = best[i], second[i]
            alone, node, j = True, tree, i
            while j < n and (node := node.get(unit[j])) is not None:
                j += 1
                if (found := node.get("")) is not None:
                    if j == i + 1:
                        alone = False
                    own = found[1]
                    score = here + own
                    if score > best[j]:
                        second[j] = best[j] if best[j] > other + own else other + own
                        best[j], back[j] = score, (i, found[0])
                    elif score > second[j]:
                        second[j] = score
            if alone:
                raw = unit[i].encode("utf-8", "replace")
                cost = self.byte_score
                if here + cost > best[i + 1]:
                    second[i + 1] = max(best[i + 1], other + cost)
                    best[i + 1], back[i + 1] = here + cost, (i, tuple(self.bytes.get(b, self.unknown) for b in raw))
                else:
                    second[i + 1] = max(second[i + 1], here + cost)
        ids, at = [], n
        while at:
            at, own = back[at]
            ids.append(own)
        ids.reverse()
        flat = array("I", ids if all(type(x) is int for x in ids) else [i for x in ids for i in (x if type(x) is tuple else (x,))])
        raw = flat.tobytes()
        own = raw if self.kind == UNIGRAM else self.learned.pop(unit, None) or self.merged(unit)
        return self._keep(unit, (raw, best[n], best[n] - second[n], raw if own == raw else own))

    def _keep(self, unit: str, found: tuple[bytes, float, float, bytes]) -> tuple[bytes, float, float, bytes]:
        if len(unit) <= CACHED_CHARS:
            if len(self) > CACHED_UNITS:
                self.clear()
                self[""] = (b"", 0.0, INFINITE, b"")
            self[unit] = found
        return found

    @staticmethod
    def units(text: str) -> list[str]:
        # a space right after another one starts no unit of its own
        return f"{SPACE}{text.replace(' ', f' {SPACE}')}".replace(f"{SPACE} ", SPACE).replace("\n", " \n ").split(" ") if text else []

    def own(self, text: str | None) -> bytes:
        """The text's own encoding, ids as unsigned 32-bit numbers."""
        return self.both(self.units(text or ""), 1)[0]

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text, or all if there are fewer: (score, ids as unsigned 32-bit numbers)."""
        return self.both(self.units(text or ""), n)[1]

    def both(self, units: list[str], n: int) -> tuple[bytes, list[tuple[float, bytes]]]:
        """The own encoding and the n best segmentations of a text's units."""
        found = [self[u] for u in units]
        ids = [f[0] for f in found]
        score = sum([f[1] for f in found])
        out = [(score, b"".join(ids))]
        if n > 1 and units:
            costs = np.array([f[2] for f in found])
            near = np.argsort(costs, kind="stable")[: n - 1] if len(costs) <= 4 * n else self._least(costs, n - 1)
            combined: list[tuple[float, tuple]] = [(0.0, ())]
            for k in sorted(int(k) for k in near if costs[k] < INFINITE):
                options = self.searched.get((units[k], n))
                if options is None:
                    if len(self.searched) >= SEARCHED_UNITS:
                        self.searched.clear()
                    options = [(s, array("I", o).tobytes()) for s, o in self.n_best(units[k], n)]
                    if len(units[k]) <= CACHED_CHARS:
                        self.searched[units[k], n] = options
                first = options[0][0]
                # the cached best stands for the first option: ties must not give it twice
                choices = [(0.0, None)] + [(first - s, o) for s, o in options if o != ids[k]]
                combined = sorted(((c + d, (*changes, (k, o)) if o is not None else changes) for c, changes in combined for d, o in choices), key=lambda x: x[0])[:n]
            for cost, changes in combined[1:]:
                other = list(ids)
                for k, o in changes:
                    other[k] = o
                out.append((score - cost, b"".join(other)))
        return b"".join([f[3] for f in found]), out

    @staticmethod
    def _least(costs: np.ndarray, n: int) -> np.ndarray:
        """The places of the n least costs, earlier ones first among equals."""
        limit = np.partition(costs, n - 1)[n - 1]
        below, equal = np.flatnonzero(costs < limit), np.flatnonzero(costs == limit)
        return np.concatenate([below, equal[: n - len(below)]])

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.spelled.__getitem__, array("I", ids)))
        return raw.decode("utf-8", "replace")[1:]


@cache
def pieces(path: str) -> Pieces:
    """A worker's own, for all its tasks."""
    return Pieces(path)


def encoded(docs: DataFrame, model: str, n_best: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, segmentations): for each row its own encoding, and an array of up to n_best (score, ids), best first."""
    pieces(model)  # a model that isn't supported is refused here

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        kinds = pa.list_(pa.int32()), pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in slices(batches, text):
            units = [own.units(t or "") for t in batch.column(1).to_pylist()]
            own.learn(units)
            made = [own.both(u, n_best) for u in units]
            ids = [np.frombuffer(i, np.int32) for i, _ in made]
            found = [[{"score": s, "ids": np.frombuffer(i, np.int32)} for s, i in best] for _, best in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kinds[0]), pa.array(found, kinds[1])], ["doc_id", "ids", "segmentations"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(rows, f"doc_id {kind}, ids array<int>, segmentations array<struct<score:double,ids:array<int>>>")


def decoded(rows: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with arrays of ids; null ids give a null text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            made = [None if i is None else own.decode(array("I", i).tobytes()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.select(doc_id, ids).mapInArrow(texts, f"doc_id {kind}, text string")


def described(docs: DataFrame, model: str, n_best: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each row's encodings: pieces and crc32 of its own one's ids, whether that decodes to the
    text, the scores and crc32s of the N best segmentations, and whether the best one is its own."""
    pieces(model)
    names = ("n_pieces", "ids_crc32", "round_trip", "nbest_scores", "nbest_crc32", "best_is_own")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in slices(batches, text):
            out, texts = [], batch.column(1).to_pylist()
            units = [own.units(t or "") for t in texts]
            own.learn(units)
            for t, u in zip(texts, units, strict=True):
                ids, found = own.both(u, n_best)
                out.append((len(ids) // 4, zlib.crc32(ids), own.decode(ids) == (t or "").replace(SPACE, " "), [s for s, _ in found], [zlib.crc32(i) for _, i in found], found[0][1] == ids))
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(rows, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean, nbest_scores array<double>, nbest_crc32 array<long>, best_is_own boolean")
