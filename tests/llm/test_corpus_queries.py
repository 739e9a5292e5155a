"""Every registered query over tables with nulls, repeated rows and clashing columns, and over empty ones."""

import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from procweave.llm import queries

CLASHING = ["kept", "n_words", "row", "rid", "cls", "text_hash", "spans", "held_out", "score", "predicted", "section", "n_shingles", "component_id", "key", "sig", "bands", "piece", "start", "length", "offset", "sequence_id", "n_lines", "n_dropped", "kept_text", "feature", "content", "rejected_by", "words", "value", "kind"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING)


def written(spark, path, rows):
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, None, k) for i, k in ((1, 0), (2, 1), (3, None), (None, 1), (4, 0), (4, 0))] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    prose = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(60))
    rows = [(1, prose, "en", "s", 1), (2, "le chat est sur la table", "fr", None, None), (2, "le chat est sur la table", "fr", None, None), (None, "no id here", None, None, None)]
    rows += [(3, None, "en", None, None), (4, "", None, None, None), (None, None, None, None, None), (5, " \n\t\n", "de", None, None), (6, "wort " * 40_000, "de", "s", 3), (7, prose, "en", "s", 2)]
    rows += [(8, "x" * 150_000, None, None, None), (9, "same line\n" * 30, "en", None, None), (10, "call +1 (212) 555-1234 now 😀", "en", None, None)]
    return written(spark, tmp_path_factory.mktemp("odd"), rows), rows


@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_odd_tables(spark, folder, name):
    path, rows = folder
    out = (corpus_pipeline.run if name == "pipeline" else queries.queries()[name])(spark, path).collect()
    if name == "pipeline":
        assert {r["doc_id"] for r in out} == {1}
    elif name == "op8_token_counts":
        assert {r["doc_id"] for r in out} == {r[0] for r in rows}
    elif name == "op7_best_fit_packing":
        assert {r["doc_id"] for r in out} == {r[0] for r in rows} and sum(r["piece"] == 0 for r in out) == len(rows)
    else:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    if name in ("op3_language_id", "op9_toxicity"):
        for r in out:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    if name == "op2_minhash_near_dedup":
        group = {r["doc_id"]: r["component_id"] for r in out}
        assert group[7] == 1 and group[2] == 2 and group[3] == 3 and group[None] is None


@pytest.mark.parametrize("name", [*queries.queries(), "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    path = written(spark, tmp_path, [])
    assert (corpus_pipeline.run if name == "pipeline" else queries.queries()[name])(spark, path).count() == 0


def test_the_entry_has_them():
    assert {*queries.queries(), "pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
