"""Quality rules as a short-circuit cascade of DataFrame expressions.

Each rule rejects a document by a condition on metrics of its text. A bounded sample of rows tells how
much a rule's metrics cost, from their words and bytes, and what share of documents it rejects; the rules then run in order of
rejection per cost, and a document that one has rejected is not measured for the later ones.
A document is kept if no rule rejects it, so the order changes the work and not the verdict.

Null and empty texts have no words: every count is 0 and the first base rule rejects them.
Repeated rows are judged one by one, equal texts alike. Other columns pass through; columns
named like a verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.llm.text import words_of

#: Characters that count as symbols; fixed values of the rule.
SYMBOLS = "#*$%&|<>"

#: Rows, on average, that cost and selectivity are estimated on.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """metrics: those that the condition needs, by name. rejects: from their columns to a condition."""

    name: str
    metrics: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


#: The base rules, then those of the method's verdict. Ratios are kept in integers.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
VERDICT_RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("n_filled_lines", "n_dup_lines"), lambda m: 2 * m["n_dup_lines"] > m["n_filled_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] > 15 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    Rule("capitals", ("word_chars", "n_capitals"), lambda m: 10 * m["n_capitals"] > 7 * m["word_chars"]),
)
RULES = BASE_RULES + VERDICT_RULES

#: Work of a metric, in rough nanoseconds a word and a byte, as measured once.
COST = {
    "n_words": (60, 0), "word_chars": (20, 0), "n_symbols": (0, 12), "n_filled_lines": (0, 3),
    "n_dup_lines": (0, 4), "n_repeat_words": (800, 0), "n_capitals": (0, 15),
}

W, V, KEYS, CAND = "__pw_words", "__pw_windows", "__pw_keys", "__pw_candidates"


def _symbols(text: Column) -> Column:
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    return (F.octet_length(text) - F.octet_length(bare)).cast("long")


def _hashes(words: Column) -> Column:
    """A hash of each 3-word window, in order."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def _window_keys(words: Column, hashes: Column) -> Column:
    """A sorted array of one long for each 3-word window: its position in the low bits, bits of its
    hash above. Neighbours that agree above may be equal windows."""
    mask = _position_mask(words)
    return F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))


def _some_alike(hashes: Column) -> Column:
    """Whether two windows may be equal: mostly none are, and nothing more is to be done."""
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def _position_mask(words: Column) -> Column:
    """One less than the power of two that is above any position; from the array's size alone."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words) + F.lit(1.0)))).cast("long") - 1


def _candidates(words: Column, keys: Column) -> Column:
    """Positions of the windows whose hash bits are not alone."""
    mask, last = _position_mask(words), F.size(keys) - 1
    same = lambda a, b: keys[a].bitwiseXOR(keys[b]).bitwiseAND(F.bitwise_not(mask)) == 0
    found = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | ((k < last) & same(k, F.least(k + 1, last))))
    return F.transform(found, lambda k: keys[k].bitwiseAND(mask).cast("int"))


def _covered(words: Column, candidates: Column) -> Column:
    """Words in windows found twice or more, by the windows' own words."""
    window = lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i"))
    ordered = F.array_sort(F.transform(candidates, window))
    last = F.size(candidates) - 1
    # aggregate() binds the sorted array once, whatever the number of uses below
    positions = lambda s: F.flatten(F.transform(F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["w"] == s[k]["w"])) | ((k < last) & (s[k]["w"] == s[F.least(k + 1, last)]["w"]))), lambda k: F.array(s[k]["i"], s[k]["i"] + 1, s[k]["i"] + 2)))
    marked = F.flatten(F.transform(F.array(ordered), positions))
    return F.when(F.size(candidates) > 0, F.size(F.array_distinct(marked))).otherwise(0).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, and only where the whole is."""
    return F.transform(F.array(value), use)[0]


def _filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.octet_length(F.btrim(x, F.lit(" \t\u000b\f\r"))) > 0)


def _repeated(words: Column) -> Column:
    counted = lambda keys: _let(_candidates(words, keys), lambda found: _covered(words, found))
    zero = F.lit(0).cast("long")
    return F.when(F.size(words) >= 3, _let(_hashes(words), lambda h: F.when(_some_alike(h), _let(_window_keys(words, h), counted)).otherwise(zero))).otherwise(zero)


#: Each metric from the text, not null, and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.char_length(F.array_join(words, "")).cast("long"),
    "n_symbols": lambda text, words: _symbols(text),
    "n_filled_lines": lambda text, words: F.size(_filled_lines(text)).cast("long"),
    "n_dup_lines": lambda text, words: _let(_filled_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda text, words: _repeated(words),
    "n_capitals": lambda text, words: F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
}


def measured(docs: DataFrame, text: str, metrics: tuple[str, ...]) -> DataFrame:
    """docs with those metrics of all rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn(W, words_of(body))
    made = {m: METRICS[m](body, F.col(W)) for m in metrics}
    if "n_repeat_words" in metrics:  # in columns of their own, which code generation takes up, where no row is spared
        docs = docs.withColumn(V, F.when(F.size(W) >= 3, _hashes(F.col(W))))
        docs = docs.withColumn(KEYS, F.when(_some_alike(F.col(V)), _window_keys(F.col(W), F.col(V))))
        docs = docs.withColumn(CAND, F.when(F.col(KEYS).isNotNull(), _candidates(F.col(W), F.col(KEYS))))
        made["n_repeat_words"] = F.when(F.col(CAND).isNotNull(), _covered(F.col(W), F.col(CAND))).otherwise(F.lit(0).cast("long"))
    return docs.withColumns(made)


def ordered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost, estimated on about `sample_rows` rows drawn one by one.

    The sample only sets the order. With no rows to estimate on, the given order stands."""
    n = docs.count()
    sample = docs.select(text).where(F.rand(11) < min(1.0, sample_rows / max(n, 1)))
    names = tuple(dict.fromkeys(m for r in rules for m in r.metrics))
    row = measured(sample, text, names).agg(
        F.count("*").alias("n"), F.avg(F.octet_length(text)).alias("bytes"), F.avg(F.size(W)).alias("words"),
        *[F.avg(r.rejects({m: F.col(m) for m in r.metrics}).cast("int")).alias(r.name) for r in rules],
    ).first()
    if not row["n"]:
        return list(rules)

    def worth(rule: Rule) -> float:
        cost = sum(a * (row["words"] or 0) + b * (row["bytes"] or 0) for a, b in (COST[m] for m in rule.metrics)) + 1
        return (row[rule.name] or 0.0) / cost

    return sorted(rules, key=worth, reverse=True)


def first_rejecting(text: Column, words: Column, rules: list[Rule] | tuple[Rule, ...], known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does.

    CASE stops at the first condition that holds, so what later rules need isn't computed. known:
    metrics that exist as columns."""
    out, known = F.lit(None).cast("string"), known or {}
    for rule in reversed(rules):
        values = F.struct(*[(known[m] if m in known else METRICS[m](text, words)).alias(m) for m in rule.metrics])
        out = F.when(_let(values, _condition(rule)), F.lit(rule.name)).otherwise(out)
    return out


def _condition(rule: Rule) -> Callable[[Column], Column]:
    return lambda s: rule.rejects({m: s[m] for m in rule.metrics})


def cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with rejected_by, the first of the rules in this order that rejects, and kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop("rejected_by", "kept").withColumn("rejected_by", _let(words_of(body), lambda words: first_rejecting(body, words, rules)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that every rule lets through, with the columns of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    rules = ordered(docs.select(F.col(text).alias("__pw_text")), "__pw_text")
    return docs.where(_let(words_of(body), lambda words: first_rejecting(body, words, rules)).isNull())


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the base metrics, whether a base rule fails, and the verdict.

    The base metrics are results here, so all rows have them; the other rules run as a cascade on
    what the base rules leave."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__pw_text"))
    order = [r for r in ordered(base, "__pw_text") if r in VERDICT_RULES]
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = measured(base, "__pw_text", shown)
    known = {m: F.col(m) for m in shown}
    out = out.withColumn("base_failed", BASE_RULES[0].rejects(known) | BASE_RULES[1].rejects(known))
    rejected = first_rejecting(F.coalesce("__pw_text", F.lit("")), F.col(W), order, known)
    return out.select("doc_id", *shown, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected.isNull()).alias("kept"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: length(x) > 0) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d
), k AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM g
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k) WHERE c > 1
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_filled_lines,
         CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_filled_lines
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_capitals > 7 * word_chars) AS kept
FROM b
"""
