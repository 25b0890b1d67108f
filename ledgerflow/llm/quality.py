"""Quality of documents by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything that touches rows is Spark SQL. Of the corpus only the table of vote
patterns comes to the driver: at most 3 ** rules rows, however many documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, fresh, materialize, words, writable

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Texts with more distinct repeated windows than this find their places by sorting.
FEW_REPEATS = 64

#: What is expected before the data speak: the share of good documents, a rule's bad votes on good ones and on bad ones; and how much that weighs, as a share of the documents.
GOOD, OF_GOOD, OF_BAD, WEIGHT = 0.85, 0.03, 0.3, 0.01

#: For each rule its measure, the value up to which it votes "good" and the one from which it votes "bad"; between them it abstains.
#: Repeated lines and odd word ends are found in good documents too: their votes weigh less, and other rules can overrule them.
RULES = {
    "symbols_per_word": ("n_symbols / n_words", 0.05, 0.2),
    "repeated_share": ("n_repeat_words / n_words", 0.1, 0.3),
    "duplicate_line_share": ("n_dup_lines / n_lines", 0.1, 0.2),
    "upper_share": ("n_upper / word_chars", 0.1, 0.3),
    "marks_per_word": ("n_marks / n_words", 0.1, 0.4),
    "repeats_per_word": ("n_later_repeats / n_words", 0.05, 0.2),
    "odd_word_ends": ("n_odd_ends / n_words", 0.2, 0.3),
}


def _with_repeats(df: DataFrame, words: str, out: str, size: int) -> DataFrame:
    """``df`` with ``out``: the number of words inside of windows of ``size`` words that a text has twice or more, and the number of windows that were there before.

    Windows are compared by hash. The sorted places of repeated ones cover
    min(size, gap) words each. With few distinct repeats their places are looked
    up, else they are sorted along with the hashes: n log n for any text.
    """
    h, s, d = (fresh(df, f"{out}_{x}") for x in "hsd")
    at = f"sequence(0, size({words}) - {size})"
    df = df.withColumn(h, F.expr(f"CASE WHEN size({words}) <= {size} THEN array() ELSE transform({at}, i -> xxhash64({', '.join(f'get({words}, i + {k})' for k in range(size))})) END"))
    df = df.withColumn(s, F.sort_array(h)).withColumn(s, F.expr(f"filter({s}, (x, i) -> x = get({s}, i - 1))")).withColumn(d, F.array_distinct(s))
    places = f"""CASE WHEN size({d}) <= {FEW_REPEATS} THEN filter(sequence(0, size({h}) - 1), i -> array_contains({d}, {h}[i]))
        ELSE sort_array(flatten(transform(array(sort_array(transform({h}, (x, i) -> struct(x AS h, i AS i)))),
          t -> transform(filter(t, (x, i) -> x.h = get(t, i - 1).h OR x.h = get(t, i + 1).h), x -> x.i)))) END"""
    covered = f"aggregate({places}, struct(0L AS n, -{size} AS last), (a, p) -> struct(a.n + least({size}, p - a.last) AS n, p AS last), a -> a.n)"
    return df.withColumn(out, F.struct(F.expr(f"CASE WHEN size({d}) = 0 THEN 0L ELSE {covered} END").alias("words"), F.size(s).cast("long").alias("later"))).drop(h, s, d)


def measures(docs: DataFrame, text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with a struct column ``quality_measures`` of counts of a text's words, characters, lines and repeats.

    Null text counts as empty: all counts are zero. Other columns may have any
    name; a ``quality_measures`` in the input is replaced.
    """
    docs = docs.drop("quality_measures")
    w, ln, rep = (fresh(docs, x) for x in ("qm_words", "qm_lines", "qm_repeats"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def chars(pattern: str) -> Column:
        """Characters that are left when those of ``pattern`` go."""
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    length = F.length(text).cast("long")
    out = docs.withColumns({w: words(F.col(text_col)), ln: F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)})
    out = _with_repeats(out, w, rep, size)
    fields = {
        "n_words": F.size(w).cast("long"),
        "word_chars": chars(f"[{SPACE}]+"),
        "n_symbols": length - chars(r"[#*$%&|<>]+"),
        "n_lines": F.size(ln).cast("long"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": F.col(rep).words,
        "n_later_repeats": F.col(rep).later,
        "n_upper": length - chars(r"\p{Lu}+"),
        "n_marks": length - chars(r"[!?]+"),
        "n_odd_ends": length - chars(rf"[^\p{{L}}\p{{N}}{SPACE}](?![^{SPACE}])"),
    }
    return out.withColumn("quality_measures", F.struct(*(c.alias(n) for n, c in fields.items()))).drop(w, ln, rep)


def _vote(rule: str) -> Column:
    """1 for good, -1 for bad, 0 to abstain (also where the measure isn't defined)."""
    measure, good, bad = RULES[rule]
    over, under = (F.col(f"quality_measures.{x}") for x in measure.split(" / "))
    share = F.when(under > 0, over / under)
    return F.when(share >= bad, -1).when(share <= good, 1).otherwise(0)


def fit(patterns: list[tuple[list[int], int]], rules: int, rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts: the share of good documents, and for each rule the probabilities of a bad vote, if it votes, for good and for bad documents.

    The expected values of above count as WEIGHT of the documents more. They
    tell the two kinds apart at the start and keep a rule that never votes
    where it began; nothing else bounds the estimates. With no patterns the
    expected values stay.
    """
    prior, odds = GOOD, [(OF_GOOD, OF_BAD)] * rules
    n = sum(count for _, count in patterns)
    weight = WEIGHT * n
    for _ in range(rounds if n else 0):
        good = 0.0
        seen = [[0.0, 0.0, 0.0, 0.0] for _ in range(rules)]  # bad votes and votes: of good documents, of bad ones
        for votes, count in patterns:
            logit = math.log(prior / (1 - prior))
            for v, (g, b) in zip(votes, odds):
                logit += v and (math.log(g / b) if v < 0 else math.log((1 - g) / (1 - b)))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))
            good += p * count
            for v, s in zip(votes, seen):
                if v:
                    s[1] += p * count
                    s[3] += (1 - p) * count
                    if v < 0:
                        s[0] += p * count
                        s[2] += (1 - p) * count
        prior = (good + GOOD * weight) / (n + weight)
        odds = [((gb + OF_GOOD * weight) / (g + weight), (bb + OF_BAD * weight) / (b + weight)) for gb, g, bb, b in seen]
    return prior, odds


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those of ``carry``) with ``quality_measures``, ``base_failed``, ``good_probability`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them inside of
    repeated 3-word windows. ``kept``: false for these, else whether the
    posterior probability of "good" is at least one half. Null and empty texts
    have no words and fail. Repeated rows get the same verdict each; an empty
    table gives an empty result. Input columns named like the added ones are replaced.
    """
    added = ("quality_measures", "base_failed", "good_probability", "kept")
    docs = writable(docs.drop(*added))
    columns = [c for c in (docs.columns if carry is None else carry)]
    measured = materialize(measures(docs, text_col).select(*(F.col(f"`{c}`") for c in columns), "quality_measures"), "quality")
    rules = list(RULES)
    counted = measured.filter("quality_measures.n_words > 0").groupBy(*(_vote(r).alias(f"v{i}") for i, r in enumerate(rules))).count()
    prior, odds = fit([(list(x)[:-1], x["count"]) for x in counted.collect()], len(rules))  # 3 ** rules rows at most
    logit = F.lit(math.log(prior / (1 - prior)))
    for rule, (g, b) in zip(rules, odds):
        v = _vote(rule)
        logit = logit + F.when(v < 0, math.log(g / b)).when(v > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    m = F.col("quality_measures")
    failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
    out = measured.withColumns({"base_failed": failed, "good_probability": 1 / (1 + F.exp(-logit))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= 0.5))
