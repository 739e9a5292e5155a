import random
import unicodedata

import numpy as np
import pytest

from procweave.llm import langid, ngrams, toxicity

SYLLABLES = {"en": ["the", "tion", "and", "er", "wh", "ou"], "fr": ["eau", "é", "que", "ment", "oi", "les"], "ru": ["при", "вет", "ст", "ов", "ни"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, lang, 40), lang) for i in range(60) for lang in SYLLABLES] + [(900, None, "en"), (901, "x", None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain_words(text):
    out, own = [], ""
    for c in (text or "") + "\n":
        if c.isalpha() or own and unicodedata.category(c)[0] == "M":
            own += c.lower() if len(c.lower()) == 1 else c
        elif own:
            out.append(own)
            own = ""
    return out


def test_words_and_sums_against_a_loop():
    texts = ["Thé cat,sat 12on", None, "", "ΑΒ ab\n\nprivét привет", "a", "日本語 x😀y", "हिन्दी में \u0301x e\u0301t\u0301", "\U00030010 \u0301", "தமிழ்"]
    got = ngrams.words_of(texts)
    expected = [(i, w) for i, t in enumerate(texts) for w in plain_words(t)]
    assert list(zip(got.doc.tolist(), got.size.tolist(), strict=True)) == [(i, len(w)) for i, w in expected]
    for (i, w), a, n in zip(expected, got.begin.tolist(), got.size.tolist(), strict=True):
        assert plain_words(texts[i][a : a + n]) == [w]
    weights = np.random.default_rng(0).random((97, 2))
    total = np.zeros((len(expected), 2))
    for k in range(len(expected)):
        s, n = int(got.start[k]), int(got.size[k])
        one = ngrams.Words(np.zeros(1, np.int64), got.size[k : k + 1], got.script[k : k + 1], got.framed[s : s + n + 2], np.zeros(1, np.int64))
        for order in (1, 3, 5):
            for at, buckets in one.grams((order,), 97):
                assert len(at) == max(0, n + 2 - order + 1)
                total[k] += weights[buckets].sum(axis=0)
    assert np.allclose(got.sums((1, 3, 5), weights), total)


def test_viterbi_against_a_loop(model):
    rng = np.random.default_rng(4)
    doc = np.repeat([0, 1, 3, 4], [5, 1, 9, 30])
    scores = rng.normal(0, 9, (len(doc), 3))
    got = langid.Model(["a", "b", "c"], np.zeros(0), np.zeros(0), 6.0).viterbi(doc, scores)
    for d in (0, 1, 3, 4):
        own = scores[doc == d]
        best, back = own[0].copy(), []
        for row in own[1:]:
            came = [[best[j] - (6.0 if j != k else 0) for j in range(3)] for k in range(3)]
            back.append([int(np.argmax(c)) for c in came])
            best = np.array([max(c) for c in came]) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(b[path[-1]])
        value = lambda p, own=own: sum(own[i, x] for i, x in enumerate(p)) - 6.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(got[doc == d].tolist()) == pytest.approx(value(path[::-1]))


def test_languages_and_spans(model):
    rng = random.Random(2)
    texts = [words(rng, lang, 30) for lang in SYLLABLES for _ in range(20)]
    names, score, _ = model.spans(texts)
    assert sum(a == b for a, b in zip(names, [x for x in SYLLABLES for _ in range(20)], strict=True)) >= 59
    assert all(0 <= s <= 1 for s in score)
    names, score, runs = model.spans([words(rng, "en", 20) + " " + words(rng, "fr", 20), "", None, "12 . 3", "привет"])
    assert [r[0] for r in runs[0]] == ["en", "fr"] and abs(runs[0][0][1] - 20) <= 2
    text = words(rng, "en", 20) + " 1, " + words(rng, "fr", 20) + "!"
    (_, n, a, b), (_, m, c, d) = model.spans(["", text])[2][1]
    assert len(text[a:b].replace("1,", "").split()) == n and len(text[c:d].split()) == m and (a, d) == (0, len(text) - 1) and n + m == 40
    assert names[1:] == ["und", "und", "und", "ru"] and score[1:4] == [0, 0, 0]


def test_identified(spark, model):
    docs = spark.createDataFrame([(1, "the tion and", "x"), (1, "the tion and", "x"), (None, None, "y"), (2, "é" * 100_000, "z")], "doc_id long, text string, score string")
    out = langid.identified(docs, model).collect()
    assert len(out) == 4 and {r["lang_pred"] for r in out if r["doc_id"] == 1} == {"en"}
    assert langid.identified(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0).withColumnRenamed("score", "lang"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identified(docs, nothing).collect()} == {("und", 0.0)}


def test_toxicity_finds_bad_words_and_their_misspellings(spark):
    rng = random.Random(3)
    bad = ["moron", "stupid", "pathetic", "worthless"]

    def text(toxic):
        own = words(rng, rng.choice(["en", "fr"]), rng.randint(10, 300)).split()
        for _ in range(toxic * max(1, len(own) // 40)):
            own.insert(rng.randrange(len(own)), rng.choice(bad))
        return " ".join(own)

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(500)] + [(9000, None, 1), (9001, "x", None)]
    model = toxicity.train(spark.createDataFrame(rows[:400] + rows[500:], "doc_id long, text string, toxic int"))
    found = model.scores([r[1] for r in rows[400:500]]) >= 0.5
    truth = np.array([r[2] for r in rows[400:500]]) == 1
    assert (found == truth).mean() >= 0.97
    assert (model.scores(["the and morron tion", "patheticc ou", "the and er"]) >= 0.5).tolist() == [True, True, False]
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "moron", 3), (3, "moron", 3)], "doc_id long, text string, predicted int")
    got = toxicity.scored(docs, model).collect()
    assert [r["predicted"] for r in sorted(got, key=lambda r: r["doc_id"])] == [0, 0, 1, 1]
    assert toxicity.scored(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs.withColumnRenamed("predicted", "toxic").limit(0))
    assert nothing.scores(["moron", ""]).tolist() == pytest.approx([0.001, 0.001])


def test_languages_and_scores_against_a_loop(model):
    """What spans() says of texts, from the labels and the words' scores, one word at a time."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.choice([*SYLLABLES]), rng.randint(1, 9)) for _ in range(rng.randint(1, 4))) for _ in range(20)] + ["", "日本"]
    names, score, runs = model.spans(texts)
    found, scores = model.word_scores(texts)
    labels = model.viterbi(found.doc, scores)
    for i in range(len(texts)):
        own = [k for k in range(len(found.doc)) if found.doc[k] == i]
        letters, sums, expected = dict.fromkeys(range(3), 0), [0.0] * 3, []
        for k in own:
            letters[int(labels[k])] += int(found.size[k])
            for j in range(3):
                sums[j] += float(scores[k, j]) if np.isfinite(scores[k, j]) else -50.0
            if not expected or expected[-1][0] != model.languages[labels[k]]:
                expected.append([model.languages[labels[k]], 0])
            expected[-1][1] += 1
        assert [list(r[:2]) for r in runs[i]] == expected
        if not own:
            assert (names[i], score[i]) == ("und", 0)
            continue
        best = max(letters, key=letters.get)
        margin = sums[best] - max(s for j, s in enumerate(sums) if j != best)
        assert names[i] == model.languages[best]
        assert score[i] == pytest.approx(letters[best] / sum(letters.values()) * (1 + 1 / (1 + np.exp(-np.clip(margin, -50, 50)))) / 2)


def test_toxicity_scores_against_a_loop():
    """Each window's n-grams one by one, hashed as ngrams.py says."""
    rng = random.Random(8)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS), 0.3, -2.0)
    texts = ["", "12 !", "a", "moron moron moron idiot", *(words(rng, rng.choice([*SYLLABLES]), rng.randint(1, 60)) for _ in range(12))]
    mask = (1 << 64) - 1

    def bucket(codes):
        h = (len(codes) + sum((c + 1) * int(p) for c, p in zip(codes, ngrams.PLACES, strict=False))) & mask
        return ((((h ^ h >> 29) * int(ngrams.PLACES[7])) & mask) >> 32) % toxicity.BUCKETS

    for text, got in zip(texts, model.scores(texts), strict=True):
        own, best = plain_words(text), None
        for k in range(0, len(own), toxicity.WINDOW):
            total = count = 0
            for word in dict.fromkeys(own[k : k + toxicity.WINDOW]):
                framed = [0, *map(ord, word), 0]
                for order in toxicity.ORDERS:
                    for i in range(len(framed) - order + 1):
                        total, count = total + model.odds[bucket(framed[i : i + order])], count + 1
            value = total / max(count, toxicity.LEAST_GRAMS)
            best = value if best is None else max(best, value)
        expected = model.prior if best is None else best + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-expected)))


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    vectors, out, bias = rng.normal(size=(9, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    bucket, of = rng.integers(0, 9, 30), np.sort(rng.integers(0, 5, 30))
    size, labels, weight = np.full((5, 1), 7.0), np.array([0, 1, 1, 0, 1]), rng.random(5) + 0.5

    def loss():
        total = 0.0
        for k in range(5):
            logits = vectors[bucket[of == k]].sum(axis=0) / size[k, 0] @ out + bias
            total += weight[k] * (np.log(np.exp(logits).sum()) - logits[labels[k]])
        return total

    u, g_v, g_out, g_bias = toxicity.gradients(vectors, out, bias, bucket, of, size, labels, weight)
    full = np.zeros_like(vectors)
    full[u] = g_v
    for array, gradient in ((vectors, full), (out, g_out), (bias, g_bias)):
        for at in np.ndindex(array.shape):
            kept, sides = array[at], []
            for step in (1e-6, -1e-6):
                array[at] = kept + step
                sides.append(loss())
            array[at] = kept
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(gradient[at], abs=1e-5)
