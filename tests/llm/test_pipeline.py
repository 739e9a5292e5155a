import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from procweave.llm import minhash, packing, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept string, n_words int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    made = []
    for i in range(60):
        made.append((i, f"Shared Line of all\n{sentence(rng, 90)}\nmail me{i}@host.example.com now"))
    words = made[3][1].split(" ")
    words[40] = "changed"
    made += [(100, " ".join(words)), (101, made[4][1]), (102, "too short"), (103, None), (104, ""), (105, "x !! " * 80), (None, sentence(rng, 80)), (5, made[5][1])]
    return [(i, t, "en", None, 0, "c", 1) for i, t in made]


def jaccard_groups(texts):
    """Components by comparing all pairs of whole sets."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))], [len(s) for s in sets]


def test_stages_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert good.columns == docs.columns
    kept = good.collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([*range(60), 100, 101, None, 5])
    lines = corpus_pipeline.shared_lines(spark, good, "")
    got = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == docs.columns and lines.count() == len(kept)
    assert all("Shared" not in r["text"] and r["n_chars"] == len(r["text"]) for r in got.values())
    one = corpus_pipeline.near_dedup(spark, lines, "")
    assert Counter(r["doc_id"] for r in one.collect()) == Counter([*range(60), None, 5])
    private = corpus_pipeline.pseudonyms(spark, one, "")
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    assert not any(f"me{i}@host.example.com" in texts[i] for i in range(60)) and private.columns == docs.columns
    last = corpus_pipeline.pack(spark, private, "").toPandas()
    assert len(last) == 62 and last.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_applies_the_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 62
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(4)
    base = [sentence(rng, rng.randint(5, 60)).split() for _ in range(25)]
    texts = [None, "", "  \n", "a b", "A  b", "a b c", "one two three four five", "ONE two\tthree four five"]
    for w in base:
        for _ in range(rng.randint(1, 12)):
            own = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = sentence(rng, 1)
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "a b", "x")], "doc_id long, text string, kept string")
    found = minhash.NearDuplicates(docs, block=4, wide=2).groups().collect()
    group, sizes = jaccard_groups(texts)
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r["component_id"], r["n_shingles"]) == (group[r["doc_id"]], sizes[r["doc_id"]]), texts[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.one_of_each(docs).columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_bucket_of_many_is_compared_in_blocks():
    import numpy as np

    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in [*range(40), *rng.integers(1000, 9999, 3)]) for _ in range(12)] + ["unlike " * 3]
    sets = minhash.shingle_sets([t.encode() for t in texts])
    lows = [minhash.signature(s) for s in sets]
    rows = [(i, i, 0, int(minhash.band_keys(lows[0])[7]), minhash.band_keys(x).tolist(), (x >> np.uint32(24) ^ x).astype(np.uint8).tobytes(), t.encode()) for i, (x, t) in enumerate(zip(lows, texts, strict=True))]
    links = minhash._block_links(rows, True)
    assert all(minhash.linked(sets[a], sets[b]) for a, b in links) and 12 not in {x for pair in links for x in pair}


def test_a_bucket_of_unlike_members_moves_no_texts(spark):
    """20,000 members that share one band's minima and nothing else, and a few that are like one another."""
    import numpy as np
    import pandas as pd

    rng, n, key = np.random.default_rng(5), 20_000, 77
    sig, bands = rng.integers(0, 256, (n, minhash.LANES), dtype=np.uint8), rng.integers(-(2**62), 2**62, (n, minhash.BANDS))
    texts, planted = np.full(n, "unlike", object), {}
    for group in range(5):
        words = [f"w{group}x{k}" for k in range(60)]
        for k, place in enumerate(rng.choice(n, 3, replace=False)):
            text = " ".join([*words[:59], f"own{k}"])
            low = minhash.signature(minhash.shingle_sets([text.encode()])[0])
            sig[place], bands[place], texts[place] = (low >> np.uint32(24) ^ low).astype(np.uint8), minhash.band_keys(low), text
            planted[int(place)] = group
    bands[:, 0] = key  # so the band in question is the first that any two share
    own = object.__new__(minhash.NearDuplicates)
    own.staging, own.block, own.wide = minhash.Staging(spark, "minhash"), minhash.BLOCK, minhash.WIDE
    frame = pd.DataFrame({"rid": np.arange(n), "sig": [x.tobytes() for x in sig], "bands": list(bands), "text": texts})
    own.known = own.staging.write(spark.createDataFrame(frame, "rid long, sig binary, bands array<long>, text string"), "known")
    members = own.known.select(F.lit(key).cast("long").alias("key"), "rid", F.lit(0).cast("long").alias("hub"), F.lit(n).cast("long").alias("size"))
    comps = spark.createDataFrame([], "v long, comp long")
    links = own.unsettled(members, comps, "links").collect()
    assert all(planted[a] == planted[b] for a, b in links) and {x for pair in links for x in pair} == planted.keys()
    alive = spark.read.parquet(f"{own.staging.root}/links_alive")
    assert {r["rid"] for r in alive.select("rid").collect()} == planted.keys()
    own.staging.drop()


def test_least_matches_is_the_posterior_bound():
    import numpy as np

    # the share of the posterior's mass at or over the threshold, by summing its density
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, least in minhash.NEEDED:
        for m, below in ((least, False), (least - 1, True)):
            log = m * np.log(grid) + (n - m) * np.log(1 - grid)
            density = np.exp(log - log.max())
            assert (density[grid >= 0.75].sum() / density.sum() < minhash.MISS) == below


def brute_quality(t):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_against_loops(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a b c", "a a a a", "a b c a b c", "x " * 60, "é\x0bß #*$ %&|<> 😀 " * 9, "l\nl\n\nl \n", "THE END " * 3 + "W " * 60]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["\n".join(sentence(rng, 12) for _ in range(9)), sentence(rng, 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, None, 1)], "doc_id long, text string, n_words int")
    got = quality.judge(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:7] == brute_quality(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])
    assert {r["doc_id"]: r["kept"] for r in got}[len(texts) - 2]
    for order in (quality.RULES, quality.RULES[::-1]):
        verdict = {r["doc_id"]: r["kept"] for r in quality.cascade(docs, "text", order).collect()}
        assert verdict == {r["doc_id"]: r["kept"] for r in got}
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0
    assert [r.name for r in quality.ordered(docs.where(F.lit(False)))] == [r.name for r in quality.RULES]


def test_the_pipeline_uses_its_operators():
    assert (packing.GROUP_PIECES, pii.ROUNDS) == (8000, 8)
