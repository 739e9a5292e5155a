"""Near-duplicate groups: banded MinHash, sequential Bayesian pruning, exact verification.

A document's set is its distinct shingles of five words (words end at ASCII white space, A-Z is
lower-cased); a text of one to four words is one shingle. Documents are linked when
100 * |intersection| >= 75 * |union|; results are the connected components of all links.

1. Equal sets are one class, known by a 128-bit hash of the set; one row stands for each class.
2. Classes whose minima agree in a band share a bucket. Each bucket has a hub, the member whose
   hash with the bucket's key is least, so that different bands choose different hubs; every
   member is a candidate with its hub. Candidates grow with the rows, not with a bucket's square.
3. Candidates' signatures are compared in batches. With m of n minima equal and a uniform prior,
   the posterior of the similarity is Beta(m + 1, n - m + 1); a pair is pruned when its chance of
   reaching the threshold is under `miss`. Survivors are verified on their full sets.
4. First each row's likeliest candidate is verified, then those candidates that the links so far
   have not joined. Buckets of three or more that still hold several components are then compared
   member with member, so no link between them is lost: signatures alone, in wide blocks, which tells
   the members that have an unpruned partner in another component. Only these get their texts, in
   blocks of a bounded number of rows; pairs are verified inside their block and links alone leave
   it. So members that are like nobody cost a comparison of bytes with each other, and no text.

Minima are compared by one byte: of two different ones, one in 256 agrees, which prunes less and
loses nothing. A pair at the threshold is missed by all bands with chance (1 - t^rows)^bands, 2e-5.

Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows are
equal sets; rows without an id join groups but are never a group's smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.llm.components import components
from procweave.llm.text import slices
from procweave.session import Staging

SHINGLE_WORDS, THRESHOLD = 5, 75  # a hundredth
ROWS, BANDS = 5, 40
LANES = ROWS * BANDS
#: Chance of reaching the threshold below which a pair is pruned, and minima compared at a time.
MISS, BATCH = 1e-6, 40
#: Rows of a bucket whose texts are compared at once with as many others, and such blocks whose signatures are.
BLOCK, WIDE = 256, 16

_rng = np.random.default_rng(20240229)
_POWER, _TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE = _rng.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 2**31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, LANES, dtype=np.uint32)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    lowered = [(t or b"").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*lowered, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    inside = np.flatnonzero(~_SPACES[data])
    if not len(inside):
        return [np.empty(0, np.uint64)] * len(texts)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # each word's first place in `inside`
    sizes = np.diff(first, append=len(inside))
    powers = np.cumprod(np.full(int(sizes.max()), _POWER, np.uint64))
    at = np.arange(len(inside)) - np.repeat(first, sizes)
    hashes = _mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[at], first) + sizes.astype(np.uint64))
    begins = np.searchsorted(inside[first], np.concatenate([[0], ends]))
    padded = np.concatenate([hashes, np.zeros(SHINGLE_WORDS, np.uint64)])
    every = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE_WORDS):
        every += padded[k : k + len(hashes)] * _PLACE[k]
    every = _mix(every)
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        n = int(b - a)
        if n >= SHINGLE_WORDS:
            out.append(np.unique(every[a : b - SHINGLE_WORDS + 1]))
        elif n:
            out.append(_mix(np.array([sum(int(h) * int(p) for h, p in zip(hashes[a:b], _PLACE, strict=False)) + n * int(_TAG) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The least value of the set under each of LANES permutations of 32-bit numbers."""
    low = np.full(LANES, 0xFFFFFFFF, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(small), chunk):
        np.minimum(low, (small[None, k : k + chunk] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of the band's number and minima."""
    sums = (low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)
    return _mix(sums + np.arange(1, BANDS + 1, dtype=np.uint64) * _TAG).view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """The fewest of n equal minima with which a pair may still reach the threshold.

    P(S >= t) under Beta(m + 1, n - m + 1) is P(Bin(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


NEEDED = [(n, least_matches(n)) for n in range(BATCH, LANES + 1, BATCH)]


def surviving(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of byte signatures (rows), the indexes of those not pruned, and their equal minima."""
    alive, found = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, least in NEEDED:
        part = slice(n - BATCH, n)
        found = found + (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
        keep = found >= least
        alive, found = alive[keep], found[keep]
    return alive, found


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted distinct sets reach the threshold."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist())
        lows = [signature(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([None if x is None else band_keys(x) for x in lows], pa.list_(pa.int64())),
                pa.array([None if x is None else (x >> np.uint32(24) ^ x).astype(np.uint8).tobytes() for x in lows], pa.binary()),
            ],
            ["doc_id", "text", "n_shingles", "cls", "bands", "sig"],
        )


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) to (a, b, matches), without the pairs that Bayes' bound prunes."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LANES) for c in ("sig_a", "sig_b"))
            alive, found = surviving(left, right)
            kept = batch.select(["a", "b"]).take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int32())], ["a", "b", "matches"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the (a, b) that are linked."""
    for batch in slices(slices(batches, "text_a"), "text_b"):
        left, right = (shingle_sets(batch.column(c).cast(pa.binary()).to_pylist()) for c in ("text_a", "text_b"))
        yield batch.select(["a", "b"]).filter(pa.array([linked(x, y) for x, y in zip(left, right, strict=True)], pa.bool_()))


def _first_shared(bands: np.ndarray, key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of rows that share the band of this key, whether it is the first that they share."""
    band = int(np.flatnonzero(bands[0] == key)[0])
    return ~(bands[left, :band] == bands[right, :band]).any(axis=1)


def _screened(comp: np.ndarray, block: np.ndarray, wide: np.ndarray, same_block: bool, key: int, bands: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) of rows of one bucket, in different components, that Bayes' bound doesn't prune.

    Two wide blocks are compared with each other, or one with itself."""
    lanes, least = np.ascontiguousarray(sig[:, :BATCH].T), NEEDED[0][1]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(sig) - 1):
        alive = (lanes[:, k + 1 :] == lanes[:, k, None]).sum(axis=0, dtype=np.uint8) >= least
        alive &= (comp[k + 1 :] != comp[k]) & ((wide[k + 1 :] != wide[k]) | same_block)
        other = np.flatnonzero(alive) + k + 1
        if len(other):
            kept, _ = surviving(np.broadcast_to(sig[k], (len(other), LANES)), sig[other])
            other = other[kept]
            other = other[_first_shared(bands, key, np.full(len(other), k), other)]
            left.append(np.full(len(other), k))
            right.append(other)
    return np.concatenate(left), np.concatenate(right)


def _screen_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, one, other), of at most two wide blocks a group, to (key, one, other, rid, comp): the
    members of each pair that isn't pruned, under the narrow blocks that hold the two."""

    def done(key: int, same_block: bool, group: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(group)
        rid, comp, block, wide = (rows.column(c).to_numpy() for c in ("rid", "comp", "block", "wide"))
        bands = np.stack(rows.column("bands").to_numpy())
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, LANES)
        left, right = _screened(comp, block, wide, same_block, key, bands, sig)
        low, high = np.minimum(block[left], block[right]), np.maximum(block[left], block[right])
        found = np.unique(np.concatenate([np.stack([low, high, side], axis=1) for side in (left, right)]), axis=0) if len(left) else np.zeros((0, 3), np.int64)
        kinds = pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()
        made = (np.full(len(found), key), found[:, 0], found[:, 1], rid[found[:, 2]], comp[found[:, 2]])
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], ["key", "one", "other", "rid", "comp"])

    group, name = [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("key", "wide_one", "wide_other")], axis=1)
        cuts = np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1 if len(names) else []
        for start, end in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if start == end:
                continue
            own = tuple(names[start].tolist())
            if group and own != name:
                yield done(name[0], name[1] == name[2], group)
                group = []
            name = own
            group.append(batch.slice(start, end - start))
    if group:
        yield done(name[0], name[1] == name[2], group)


def _block_links(rows: list[tuple], same_block: bool) -> list[tuple[int, int]]:
    """Links between different components among rows of (rid, comp, block, key, bands, sig, text).

    A pair is compared in the first band that it shares and in one block pair alone. The likeliest
    pairs are verified first, and none whose components a link has already joined."""
    rid, comp, block, key = (np.array(x) for x in list(zip(*rows, strict=True))[:4])
    bands = np.array([r[4] for r in rows], np.int64)
    sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, LANES)
    left, right = _screened(comp, block, block, same_block, int(key[0]), bands, sig)
    score = -(sig[left] == sig[right]).sum(axis=1, dtype=np.int32)
    root, sets, out = {c: c for c in comp.tolist()}, {}, []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for _, i, j in sorted(zip(score.tolist(), left.tolist(), right.tolist(), strict=True)):
        x, y = find(int(comp[i])), find(int(comp[j]))
        if x != y:
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_sets([rows[k][6]])[0]
            if linked(sets[i], sets[j]):
                root[max(x, y)] = min(x, y)
                out.append((int(min(rid[i], rid[j])), int(max(rid[i], rid[j]))))
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, one, other), of at most two blocks a group, to links (a, b)."""
    group, name = [], None

    def done() -> pa.RecordBatch:
        found = _block_links(group, name[1] == name[2]) if len(group) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in slices(batches, "text"):
        columns = [batch.column(c) for c in ("key", "one", "other", "rid", "comp", "block", "bands", "sig", "text")]
        columns = [c.cast(pa.binary()).to_pylist() if k == 8 else c.to_pylist() for k, c in enumerate(columns)]
        for key, one, other, rid, comp, block, bands, sig, text in zip(*columns, strict=True):
            if (key, one, other) != name:
                if group:
                    yield done()
                group, name = [], (key, one, other)
            group.append((rid, comp, block, key, bands, sig, text))
    if group:
        yield done()


class NearDuplicates:
    """Groups of near duplicates of a table of documents; the steps of the module's text, one a method."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, wide: int = WIDE):
        self.staging, self.block, self.wide = Staging(docs.sparkSession, "minhash"), block, wide
        kind = docs.schema[doc_id].dataType.simpleString()
        described = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            _described, f"doc_id {kind}, text string, n_shingles long, cls binary, bands array<long>, sig binary"
        )
        self.rows = self.staging.write(described.withColumn("rid", F.monotonically_increasing_id()), "rows")
        self.classes = self.staging.write(self.rows.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least_id")), "classes")

    def buckets(self) -> DataFrame:
        """(key, rid, hub, size) of the buckets that hold more than one class."""
        own = self.rows.select("rid", "bands").join(self.classes.select("rid").hint("merge"), "rid")
        bands = self.staging.write(own.select("rid", F.explode("bands").alias("key")), "bands")
        hub = F.min(F.struct(F.xxhash64("rid", "key").alias("h"), F.col("rid"))).getField("rid")
        live = bands.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("size")).where("size > 1")
        live = self.staging.write(live, "live")
        members = self.staging.write(bands.join(live.hint("merge"), "key"), "members")
        self.staging.drop("bands")
        self.staging.drop("live")
        return members

    def pruned(self, pairs: DataFrame, name: str) -> DataFrame:
        left, right = (self.known.select(F.col("rid").alias(end), F.col("sig").alias(f"sig_{end}")) for end in ("a", "b"))
        return self.staging.write(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_pruned, "a long, b long, matches int"), name)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        left, right = (self.known.select(F.col("rid").alias(end), F.col("text").alias(f"text_{end}")) for end in ("a", "b"))
        return self.staging.write(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), name)

    def joined(self, comps: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
        """Components (v, comp) after more links; those before are contracted to a vertex each."""
        if comps is None:
            return components(links, self.staging, name)
        bridges = self.between(links, comps).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
        later = components(bridges, self.staging, name).select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        both = comps.join(later, "comp", "left").select("v", F.coalesce("root", "comp").alias("comp"))
        fresh = later.select(F.col("comp").alias("v"), F.col("root").alias("comp")).join(comps, "v", "left_anti")
        return self.staging.write(both.unionByName(fresh), f"{name}_all")

    @staticmethod
    def between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components."""
        for end in ("a", "b"):
            pairs = pairs.join(comps.select(F.col("v").alias(end), F.col("comp").alias(f"comp_{end}")), end, "left")
            pairs = pairs.withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
        return pairs.where("comp_a <> comp_b")

    def unsettled(self, members: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """Links across the components of buckets that members' hubs alone don't settle."""
        own = members.where("size > 2").select("key", "rid").join(comps.select(F.col("v").alias("rid"), "comp"), "rid", "left")
        own = self.staging.write(own.withColumn("comp", F.coalesce("comp", "rid")), f"{name}_members")
        mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")
        own = own.join(self.staging.write(mixed, f"{name}_mixed"), "key")
        blocks = F.ceil(F.col("size") / self.block).cast("int")
        own = own.withColumn("block", F.pmod(F.xxhash64("rid", "key"), blocks).cast("int"))
        screen = own.withColumn("wide", F.floor(F.col("block") / self.wide).cast("int")).withColumn("partner", F.explode(F.sequence(F.lit(0), F.floor((blocks - 1) / self.wide).cast("int"))))
        screen = screen.join(self.known.select("rid", "bands", "sig"), "rid")
        screen = screen.select("key", F.least("wide", "partner").alias("wide_one"), F.greatest("wide", "partner").alias("wide_other"), "rid", "comp", "block", "wide", "bands", "sig")
        screen = screen.repartition("key", "wide_one", "wide_other").sortWithinPartitions("key", "wide_one", "wide_other")
        alive = self.staging.write(screen.mapInArrow(_screen_blocks, "key long, one int, other int, rid long, comp long").distinct(), f"{name}_alive")
        rows = alive.join(own.select("key", "rid", "block"), ["key", "rid"]).join(self.known, "rid")
        rows = rows.select("key", "one", "other", "rid", "comp", "block", "bands", "sig", "text")
        rows = rows.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other")
        return self.staging.write(rows.mapInArrow(_compare_blocks, "a long, b long"), name)

    def components(self) -> DataFrame:
        """(v, comp) of the classes that are linked with another; v and comp are rids."""
        members = self.buckets()
        # the one shuffle of texts: rows in no bucket with another are done; merged whatever the size, as sizes differ
        ids = members.select("rid").distinct().hint("merge")
        self.known = self.staging.write(self.rows.select("rid", "sig", "bands", "text").join(ids, "rid"), "known")
        pairs = members.where("rid <> hub").select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()
        pairs = self.pruned(pairs, "pairs")
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")).select("a", "b")
        comps = self.joined(None, self.verified(best, "links_1"), "comps_1")
        rest = self.between(pairs, comps).select("a", "b")
        comps = self.joined(comps, self.verified(rest, "links_2"), "comps_2")
        comps = self.joined(comps, self.unsettled(members, comps, "links_3"), "comps_3")
        return comps

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id and kept of each row, and its text."""
        comps = self.components()
        named = self.classes.join(comps.select(F.col("v").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        named = self.staging.write(named, "named")
        least = self.staging.write(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "least")
        ids = self.staging.write(named.join(least, "comp").select("cls", "component_id"), "ids")
        self.staging.keep("rows", "ids")
        out = self.rows.select("doc_id", "text", "n_shingles", "cls").join(ids, "cls", "left")
        group = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        out = out.withColumn("component_id", group)
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the row's group), kept: a row for each of docs."""
    return NearDuplicates(docs, doc_id, text).groups().select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group, the one with the smallest id; columns stay.

    Rows that share the smallest id all stay, as do all documents without words."""
    kept = near_duplicates(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("__pw_id")).distinct()
    return docs.join(kept, docs[doc_id].eqNullSafe(F.col("__pw_id")), "left_semi")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: length(x) > 0) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r(doc_id, o) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o
), c AS (
  SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
