import random
import struct
import time
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from procweave.llm import sentences, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "a", "Hello  world", "línea\n\nnueva \n x", "日本語 ☃ 😀\ttab", "the tion and " * 50, "x" * 3000, " lead and trail ", "naïve, café.  nbsp\x00"]


def all_segmentations(own, unit):
    """Every way to cover a unit, by recursion."""
    if not unit:
        yield 0.0, ()
        return
    for k in range(1, len(unit) + 1):
        if (found := own.pieces.get(unit[:k])) is not None:
            ids, score = found[:1], found[1]
        elif k == 1:
            raw = unit[0].encode()
            ids, score = tuple(own.bytes[b] for b in raw), own.byte_score
        else:
            continue
        for s, rest in all_segmentations(own, unit[k:]):
            yield score + s, ids + rest


@pytest.mark.parametrize("text", ["hello", "the tion", "aaa bb", "é☃a", "a b c", "in\non", "thon he"])
def test_n_best_against_all_segmentations(text):
    own = sentences.Pieces(MODEL)
    whole = (sentences.SPACE + text.replace(" ", sentences.SPACE))
    every = sorted({(-s, i) for s, i in all_segmentations(own, whole)})
    got = own.encode(text, 6)
    assert [s for s, _ in got] == pytest.approx([-s for s, _ in every[:6]])
    found = {i: -s for s, i in every}
    assert len({i for _, i in got}) == len(got) and all(found[tuple(array("I", i))] == pytest.approx(s) for s, i in got)


@pytest.mark.parametrize("text", ["b  c", "b   c", "  on", "a  ", " ", "in\n    on", "a \n  b", "a▁ b", " " * 9 + "é"])
def test_runs_of_spaces_against_all_pieces_of_the_model(text):
    own, model = sentences.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    normal = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))}
    assert normal == own.pieces.keys() and sum(len(p) > 1 and not p.strip(sentences.SPACE) for p in normal) == 14
    every = sorted({(-s, i) for s, i in all_segmentations(own, sentences.SPACE + text.replace(" ", sentences.SPACE))})
    got, found = own.encode(text, 6), {i: -s for s, i in every}
    assert [s for s, _ in got] == pytest.approx([-s for s, _ in every[:6]])
    assert len({i for _, i in got}) == len(got) and all(found[tuple(array("I", i))] == pytest.approx(s) for s, i in got)
    assert array("I", own.own(text)).tolist() == model.encode(text)
    assert own.decode(got[0][1]) == text.replace(sentences.SPACE, " ")


def test_long_runs_of_spaces():
    own = sentences.Pieces(MODEL)
    text = f"def f():\n{' ' * 20_000}return"
    got = own.encode(text, 4)
    assert len({i for _, i in got}) == 4 and all(own.decode(i) == text for _, i in got)
    assert len(got[0][1]) // 4 < 20_000 / 16 + 20


@pytest.mark.parametrize("text", ["x" * 150_000, "ab" * 60_000, "word " * 40_000, "é" * 50_000, "=" * 100_000, "日本" * 30_000])
def test_long_ties_do_not_widen_the_search(text):
    own = sentences.Pieces(MODEL)
    began = time.process_time()
    got = own.encode(text, 4)
    assert time.process_time() - began < 60 and len({i for _, i in got}) == len(got)
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True) and all(own.decode(i) == text for _, i in got)


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_of_all_segmentations(text):
    own = sentences.Pieces(MODEL)
    for _, ids in own.encode(text, 4):
        assert own.decode(ids) == text
        assert sentencepiece.SentencePieceProcessor(model_file=MODEL).decode(array("I", ids).tolist()) == text


def test_units_cost_what_a_star_finds():
    own, rng = sentences.Pieces(MODEL), random.Random(1)
    for _ in range(200):
        unit = "".join(rng.choice(["th", "e", "on", "tion", "é", "zq", "☃"]) for _ in range(rng.randint(1, 5)))
        best = own.n_best(unit, 2)
        ids, score, cost, _ = own[unit]
        assert score == pytest.approx(best[0][0]) and array("I", ids).tolist() == list(best[0][1])
        assert cost == pytest.approx(best[0][0] - best[1][0]) if len(best) > 1 else cost == sentences.INFINITE


def test_sentences_of_documents(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*TEXTS, None, "a"])], "doc_id long, text string, n_pieces string")
    rows = {r["doc_id"]: r for r in sentences.described(docs, MODEL, 3).collect()}
    assert len(rows) == len(TEXTS) + 2 and all(r["round_trip"] for r in rows.values())
    full = sentences.encoded(docs, MODEL, 3)
    for r in full.collect():
        assert [zlib.crc32(array("i", s["ids"]).tobytes()) for s in r["segmentations"]] == rows[r["doc_id"]]["nbest_crc32"]
    back = sentences.decoded(full.select("doc_id", "ids"), MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate([*TEXTS, None, "a"])}
    assert sentences.described(docs.limit(0), MODEL).count() == 0


def test_own_encoding_is_the_library_s(spark):
    own, model = sentences.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("text").collect()]
    for t in [*TEXTS, *texts, "def f():\n    return  1\n", "  two  spaces ", "▁ x"]:
        assert array("I", own.own(t)).tolist() == model.encode(t)
    other = sentences.Pieces(MODEL)
    other.learn([other.units(t) for t in texts])
    assert other.learned and all(other.merged(u) == ids for u, ids in [*other.learned.items()][:2000])
    assert all(other.own(t) == own.own(t) for t in [*texts, *TEXTS])
    words = sorted({w for t in texts for w in t.split()})
    agree = sum(own.encode(w, 1)[0][1] == own.own(w) for w in words) / len(words)
    assert agree > 0.7  # of invented words


def field(number, value):
    def varint(n):
        return bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 0x7F else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def unigram(pieces, normalizer=b""):
    """A unigram model file of given pieces and scores, with byte pieces."""
    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in pieces]]
    normalizer = normalizer or field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in every) + field(2, field(3, 1) + field(35, 1)) + field(3, normalizer)


def test_unigram_models_against_the_library(tmp_path):
    rng = random.Random(3)
    parts = ["▁", "a", "b", "n", "an", "ana", "ban", "na", "▁b", "▁ba", "▁ban", "nab", "▁▁", "▁a", "é", "né", "日", "日本"]
    (tmp_path / "m.model").write_bytes(unigram([(p, -float(rng.randint(100, 900)) / 64) for p in parts]))
    own, model = sentences.Pieces(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    for t in ["banana", "ban  nab a", "né 日本 banané", "x banana y", "bananabanana anan", *("".join(rng.choice("abn é") for _ in range(rng.randint(1, 14))) for _ in range(60))]:
        got, library = own.encode(t, 5), model.nbest_encode_as_ids(t, 5)
        assert array("I", own.own(t)).tolist() == model.encode(t) == array("I", got[0][1]).tolist()
        score = lambda ids: sum(own.byte_score if i < 259 else model.get_score(i) for i in ids)
        if all(c in "abn é日本" for c in t) and "x" not in t:
            assert [s for s, _ in got] == pytest.approx([score(i) for i in library], abs=1e-4)
            if len({round(s, 4) for s, _ in got}) == len(got):
                assert [array("I", i).tolist() for _, i in got[:-1]] == library[: len(got) - 1]


def test_models_that_normalize_are_refused(tmp_path):
    (tmp_path / "m.model").write_bytes(unigram([("▁", -1.0), ("a", -2.0)], field(1, b"x") + field(4, 1)))
    with pytest.raises(ValueError):
        sentences.Pieces(str(tmp_path / "m.model"))


def brute_counts(text, spans, rule):
    """Token by token and byte by byte, with another library's encoding."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    tokens = t.encode(text, add_special_tokens=False).tokens
    owner = []
    for i, c in enumerate(text):
        own = next((k for k, (_, a, b) in enumerate(spans) if a <= i < b), len(spans))
        owner += [own] * len(c.encode())
    counts, at = [0.0] * (len(spans) + 1), 0
    for token in tokens:
        held = owner[at : at + len(token)]
        at += len(token)
        if rule == "start":
            counts[held[0]] += 1
        elif rule == "proportional":
            for h in held:
                counts[h] += 1 / len(held)
        else:
            counts[max(dict.fromkeys(held), key=held.count)] += 1
    assert at == len(owner)
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_against_brute_force(spark, rule):
    rng = random.Random(7)
    rows = []
    for i, t in enumerate([*TEXTS, "\n\n\n", "ab\n\n\ncd  ef", None]):
        cuts = sorted(rng.choices(range(len(t or "") + 1), k=6))
        rows.append((i, t, [(f"s{k}", cuts[2 * k], cuts[2 * k + 1]) for k in range(3)], "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<name:string,start:int,end:int>>, section string")
    for given in (None, "spans"):
        got = {}
        for r in token_counts.section_counts(docs, RANKS, public_tokenizers.PATTERN, sections=given, rule=rule).collect():
            got.setdefault(r["doc_id"], {})[r["section"]] = r["n_tokens"]
        for i, t, spans, _ in rows:
            spans = token_counts.lines_of(t or "") if given is None else spans
            assert i in got
            expected = brute_counts(t or "", spans, rule)
            assert [got.get(i, {}).get(s[0], 0) for s in spans] == pytest.approx(expected[:-1])
            assert got.get(i, {}).get(None, 0) == pytest.approx(expected[-1])
    assert token_counts.section_counts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_lines_tile_the_text():
    for t in [*TEXTS, "\n", "a\n", "\na\n\n"]:
        spans = token_counts.lines_of(t)
        assert "".join(t[a:b] for _, a, b in spans) == t and all(a < b for _, a, b in spans)


def test_odd_sections_have_results(spark):
    spans = [("late", 6, 30), ("all", 0, 11), ("back", 9, 2), ("open", None, 4), ("end", 3, None), None, ("none", 5, 5), (None, 2, 4)]
    docs = spark.createDataFrame([(1, "Hello wide world", spans), (2, None, spans), (3, "ab", None), (4, "", None)], "doc_id long, text string, spans array<struct<name:string,start:int,end:int>>")
    for rule in token_counts.RULES:
        got = token_counts.section_counts(docs, RANKS, public_tokenizers.PATTERN, sections="spans", rule=rule).collect()
        one = {r["section"] or ("name" if r["start"] is not None else "outside"): r["n_tokens"] for r in got if r["doc_id"] == 1}
        assert one["all"] + one["late"] == 3 and all(one[k] == 0 for k in ("back", "open", "end", "none", "name")) and "outside" not in one
        two = [r for r in got if r["doc_id"] == 2]
        assert len(two) == 7 and all(r["n_tokens"] == 0 for r in two)
        assert [(r["section"], r["n_tokens"]) for r in got if r["doc_id"] > 2] == [(None, 1), (None, 0)]


def test_bad_rules_are_refused(spark):
    with pytest.raises(ValueError):
        token_counts.section_counts(spark.createDataFrame([], "doc_id long, text string"), RANKS, "x", rule="none")
