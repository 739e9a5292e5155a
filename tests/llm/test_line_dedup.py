import hashlib
import random
from collections import Counter

import pytest

from procweave.llm import line_dedup
from procweave.session import Staging, settings

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(texts, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if found[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["Common line", " common LINE\t", "ÉCOLE", "école", "", "  ", "x\x0b", "own", " nbsp"]
    texts = [None, "", "\n", "only\nown lines", "a\n" * 3000] + ["\n".join(rng.choice([*pool, f"u{rng.random()}"]) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    texts += texts[5:9] * 3
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_lines string, row int")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"] or "") for r in line_dedup.drop_shared_lines(docs, min_docs=5, batches=7, fanout=2).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 5)
    kept = line_dedup.without_shared_lines(docs, min_docs=5)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert kept.where("doc_id = 0").first()["text"] is None


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.without_shared_lines(docs).count() == 0


def hashes_of(*numbers):
    return [(hashlib.md5(bytes([x])).digest(),) for x in numbers]


def operators(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_by_level_and_reopened(spark):
    folder = Staging(spark, "test").root
    batch = hashes_of(1, 1, 2, 3)
    for k in range(5):  # each batch by a job of its own
        runs = line_dedup.LineRuns(spark, folder, min_docs=3, fanout=2, buckets=3)
        assert runs.version == (0, 1, 3, 4, 7)[k]
        runs.add(spark.createDataFrame(batch, "line_hash binary"))
        runs.close()
    runs = line_dedup.LineRuns(spark, folder, min_docs=3, fanout=2, buckets=99)
    assert [len(x) for x in runs.levels] == [1, 0, 1] and runs.buckets == 3
    found = [bytes(r[0]) for r in runs.frequent().collect()]
    assert sorted(found) == sorted({h for h, in batch})
    total = {bytes(r["line_hash"]): (r["n_docs"], r["total"]) for r in spark.table(runs.names()[1]).collect()}
    assert total[batch[2][0]] == (3, 3)  # settled after three batches, so later ones add nothing
    assert spark.table(runs.names()[0]).count() == 0
    with pytest.raises(ValueError):
        line_dedup.LineRuns(spark, folder, min_docs=4, fanout=2)
    runs.close(keep=False)


def test_old_runs_are_merged_where_they_are(spark):
    """The one exchange of a batch is that of its own counts; compaction has none, and runs aren't sorted again."""
    runs = line_dedup.LineRuns(spark, Staging(spark, "test").root, min_docs=30, fanout=4, buckets=3)
    for k in range(3):
        runs.add(spark.createDataFrame(hashes_of(*range(k, 100 + k)), "line_hash binary"))
    with runs._settings(), settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = operators(runs.counted(spark.createDataFrame(hashes_of(*range(50)), "line_hash binary")))
        assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
        assert "Exchange" not in operators(runs.merged(runs.names()[1:]))
    total = {r["total"] for r in runs.merged(runs.names()).collect()}
    assert total == {1, 2, 3}
    runs.close(keep=False)


def test_lines_of_earlier_jobs_count(spark):
    folder = Staging(spark, "test").root
    first = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(6)], "doc_id long, text string")
    later = spark.createDataFrame([(i, f"shared\nown {i}") for i in range(10, 16)], "doc_id long, text string")
    dropped = lambda docs, **more: {r["n_dropped"] for r in line_dedup.drop_shared_lines(docs, **more).collect()}
    assert dropped(first, folder=folder, batches=2) == {0} and dropped(later) == {0}
    assert dropped(later, folder=folder, batches=2) == {1}
