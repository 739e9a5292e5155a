import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from procweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\n", "a", "It's we'll  THE 'S 'Re", "x<|endoftext|>y <|startoftext|> z", "a\u0085b c d e", "é ́x e ́",
    "ΑΣ ΟΔΟΣ ΑΣ.", "İstanbul ǅ ß ﬁ", "日本語 テキスト", "a\x1cb\x1fc\x00d", "1234 ½ ٣", "tab\tvt\x0bff\x0ccr\rend", "😀 👩‍👩‍👧 x", "word " * 3000, "q" * 5000,
    "École, façade. ça÷va Ñandú. ÿ, naïve., a.b x,y ...! . , <|ENDOFTEXT|> A",
]


def reference_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_whole_text(text):
    words = packing.WordIds(PATH)
    assert np.frombuffer(words.of([(text or "").encode()])[0], "<u4").tolist() == reference_ids(text)


def test_pack_is_valid_and_close_to_the_bound():
    rng = random.Random(5)
    for sizes in ([rng.randint(1, 100) for _ in range(500)], [rng.randint(20, 60) for _ in range(400)], [51] * 30, [], [100] * 3, [70, 60, 40, 30, 50, 50]):
        bins = packing.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 100))
    assert len(packing.pack([70, 60, 40, 30, 50, 50], 100)) == 3


def test_local_search_beats_best_fit():
    rng = random.Random(1)
    better = 0
    for _ in range(40):
        sizes = [rng.choice([21, 26, 33, 35, 41, 52]) for _ in range(60)]
        better += len(packing.pack(sizes, 100)) < len(packing.best_fit(sizes, 100))
    assert better


def test_packed_covers_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "\n\n"), (3, "\n\n")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, sequence_id string, offset int")
    out = packing.packed(docs, PATH).toPandas()
    expected = []
    for i, t in rows:
        ids = np.array([*reference_ids(t), 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            expected.append((i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(None if v != v else int(v) for v in r) for r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=key) == sorted(expected, key=key)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048


def test_packed_of_an_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_pieces_keep_their_ids(spark):
    docs = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    assert packing.pieces(docs, PATH).first()["ids"] == [*reference_ids("Hello there"), 0]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = packing.WordIds(path)
    texts = ["Hello  there\n\tx", "", "It's"]
    own = Tokenizer.from_file(path)
    assert packing.WordIds(PATH).by_words and not words.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in words.of([t.encode() for t in texts])] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeated_rows_are_dealt_out(spark):
    cut = spark.range(3000).selectExpr("7L as doc_id", "0 as piece", "0L as start", "1000L as length", "5L as ids_crc32").repartition(3)
    out = packing.place(cut, 2048, 500).toPandas()
    assert len(out) == 3000 and (out["sequence_id"] >= 0).all() and (out["sequence_id"] // 2**32).nunique() == 6
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
