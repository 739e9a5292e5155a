"""Token counts of fields or sections, from one encoding of the whole document.

Each document is encoded once by a byte-level BPE, whose tokens spell the text's bytes one after
another, so every token has a span of bytes. Sections are spans of characters: given in a column,
or the document's lines, each with its line break. Token spans are joined with section spans by
binary search in the sorted section ends. A token within a section counts there. One that crosses a
boundary is allocated by a rule: `majority`, the section with most of its bytes, the earlier one of
equals; `start`, the section of its first byte; `proportional`, to each section the share of its
bytes. Tokens, or shares, outside all sections count in a row whose section is null.

Null and empty texts have no tokens; given sections still get rows, of 0, and a document that would have
no row has one without a section, of 0, so totals keep it. Sections are cut to the text. Where sections
overlap, what they share belongs to the one that starts first, or ends first of those. A section whose
start or end is null, or that ends before it starts, holds nothing: its row has 0 tokens. Repeated rows
give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.text import slices

RULES = ("majority", "start", "proportional")


class Encoder:
    """A rank file's encoding, and the number of bytes that each id spells."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            made = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=made, special_tokens={})
        self.sizes = np.zeros(max(made.values()) + 1, np.int64)
        for token, rank in made.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The end of each token in the text's bytes, ascending."""
        return np.cumsum(self.sizes[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


@cache
def encoder(ranks: str, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def attributed(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens of each section, tokens of those that cross its border, tokens outside).

    ends: of the tokens. starts, stops: of the sections, sorted and disjoint; all in bytes."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    counts, crossing = np.zeros(len(starts) + 1), np.zeros(len(starts), np.int64)
    # bytes lie in 2 n + 1 stretches: before, in and after each section in turn
    borders = np.empty(2 * len(starts), np.int64)
    borders[::2], borders[1::2] = starts, stops
    first, last = np.searchsorted(borders, begins, side="right"), np.searchsorted(borders, ends - 1, side="right")
    owner = lambda stretch: np.where(stretch % 2 == 1, stretch // 2, len(starts))
    within = first == last
    np.add.at(counts, owner(first[within]), 1)
    for k in np.flatnonzero(~within).tolist():
        shares: dict[int, int] = {}
        for stretch in range(int(first[k]), int(last[k]) + 1):
            a = begins[k] if stretch == 0 else max(begins[k], borders[stretch - 1])
            b = ends[k] if stretch == len(borders) else min(ends[k], borders[stretch])
            if b > a:
                own = int(owner(np.int64(stretch)))
                shares[own] = shares.get(own, 0) + int(b - a)
        for own in shares:
            if own < len(starts) and len(shares) > 1:
                crossing[own] += 1
        if rule == "proportional":
            for own, share in shares.items():
                counts[own] += share / int(ends[k] - begins[k])
        else:
            counts[max(shares, key=shares.get) if rule == "majority" else next(iter(shares))] += 1
    return counts[:-1], crossing, float(counts[-1])


def lines_of(text: str) -> list[tuple[str, int, int]]:
    """A text's lines as sections, each with its line break; an empty text has none."""
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            out.append((str(k), at, end))
        at = end
    return out


def own_parts(given: list[dict | None], size: int) -> list[tuple[str, int | None, int | None, int, int]]:
    """(name, start, end, own start, own end) of sections, in order; own parts are disjoint, and empty for bad sections."""
    clip = lambda x: None if x is None else min(max(x, 0), size)
    spans = [(s["name"], clip(s["start"]), clip(s["end"])) for s in given if s is not None]
    good = sorted((s for s in spans if s[1] is not None and s[2] is not None and s[1] <= s[2]), key=lambda s: s[1:])
    out, at = [], 0
    for name, start, end in good:
        begin = max(start, at)
        at = max(begin, end)
        out.append((name, start, end, begin, at))
    return out + [(*s, at, at) for s in spans if s[1] is None or s[2] is None or s[1] > s[2]]


def byte_places(text: str, raw: bytes, chars: list[int]) -> np.ndarray:
    """The byte where each character place begins."""
    if len(raw) == len(text):
        return np.array(chars, np.int64)
    begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.append(begins, len(raw))[np.array(chars, np.int64)] if chars else np.zeros(0, np.int64)


def section_counts(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "majority") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each section of each document.

    sections: a column of array<struct<name string, start int, end int>> in characters; None for
    lines, named by number from 0. n_crossing: tokens with bytes in the section and elsewhere. What
    is outside all sections has a row with null section, start, end and n_crossing, if there is anything or the
    document has no section."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks, pattern)
        for batch in slices(batches, "text"):
            at, out = [], []
            for i, (t, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                t = t or ""
                spans = [(*s, *s[1:]) for s in lines_of(t)] if sections is None else own_parts(given or [], len(t))
                raw = t.encode()
                starts, stops = byte_places(t, raw, [s[3] for s in spans]), byte_places(t, raw, [s[4] for s in spans])
                counts, crossing, outside = attributed(own.ends(t), starts, stops, rule)
                for span, n, c in zip(spans, counts.tolist(), crossing.tolist(), strict=True):
                    at.append(i)
                    out.append((*span[:3], n, c))
                if outside or not spans:
                    at.append(i)
                    out.append((None, None, None, outside, None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = docs.schema[doc_id].dataType.simpleString()
    spans = F.col(sections) if sections else F.lit(None).cast("array<struct<name:string,start:int,end:int>>")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), spans.alias("spans"))
    return given.mapInArrow(rows, f"doc_id {kind}, section string, start int, end int, n_tokens double, n_crossing long")
