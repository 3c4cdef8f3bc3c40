"""Quality rules as weak supervision: rules vote or abstain, a label model weighs them.

Each rule looks at one statistic of a document and votes 1 (good), -1 (bad) or 0
(abstains). Expectation-maximisation over the counts of vote patterns estimates, for each
rule, how often it gives each vote on good and on bad documents; the posterior
probability of a good document then replaces the rule that all filters must pass.

Everything runs as built-in expressions. The pattern counts are the only thing that
reaches the driver: at most 3 ** len(RULES) rows however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import held, stripped, words_of
from terrakit.session import written

WINDOW = 8

#: The largest share of good documents that a rule may call bad.
MOST_FALSE = 0.05

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines",
    "n_upper", "n_letters", "n_chars_all", "n_next_same", "n_ended", "n_marks",
)

#: Name, statistic, bound of a good vote or None, bound of a bad vote. At most the first
#: is good, at least the second is bad; what lies between abstains. Most rules recognise
#: one kind of junk and say nothing about a document without it.
RULES = (
    ("symbols", lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)), None, 0.10),
    ("marks", lambda: F.col("n_marks") / F.greatest("n_words", F.lit(1)), None, 0.50),
    ("upper", lambda: F.col("n_upper") / F.greatest("n_letters", F.lit(1)), None, 0.40),
    ("repeats", lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)), None, 0.30),
    ("dup_lines", lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), None, 0.40),
    ("word_length", lambda: F.abs(F.col("word_chars") / F.greatest("n_words", F.lit(1)) - 5.0), 1.0, 2.0),
    ("distinct", lambda: -F.col("n_distinct") / F.greatest("n_words", F.lit(1)), None, -0.30),
    ("neighbours", lambda: F.col("n_next_same") / F.greatest("n_words", F.lit(1)), None, 0.20),
    ("letters", lambda: -F.col("n_letters") / F.greatest("n_chars_all", F.lit(1)), -0.76, -0.70),
    ("ended", lambda: -F.col("n_ended") / F.greatest("n_lines", F.lit(1)), -0.60, -0.20),
)


def _merged(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long, from each hash and the one ``step`` later."""
    short = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(
        F.slice(hashes, 1, short), F.slice(hashes, step + 1, short), lambda a, b: F.xxhash64(a, b)
    )


def document_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of STATS; null text has no words.

    ``n_repeat_words`` counts the words that lie in an 8-word window found twice or more.
    Windows are compared by 64-bit hashes inside one document. A document without two
    equal windows needs a hash set only; the others sort their windows. Each step counts
    what it can, so that the next generator need not copy texts, lines and words along.
    """
    text = F.coalesce("text", F.lit(""))
    chars = F.char_length(text)
    rows = docs.withColumn("__qr_lines", held(F.filter(F.split(text, "\n"), lambda x: stripped(x) != "")))
    stats = {
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines")),
        "n_lines": F.size("__qr_lines"),
        "n_upper": F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        "n_letters": chars - F.char_length(F.regexp_replace(text, r"\p{L}+", "")),
        "n_chars_all": chars,
        "n_marks": F.regexp_count(text, F.lit("[!?]")),
        "n_ended": F.size(F.filter("__qr_lines", lambda x: F.rlike(x, F.lit(r"[.!?][ \t-\r]*$")))),
    }
    early = {f"__qr_{name}": value.cast("long") for name, value in stats.items()}
    rows = rows.withColumns(early).withColumn("__qr_words", held(words_of(text)))
    rows = rows.withColumn("__qr_word_chars", F.char_length(F.array_join("__qr_words", "")).cast("long"))
    rows = rows.withColumn("__qr_w1", held(F.transform("__qr_words", lambda w: F.xxhash64(w))))
    rows = rows.withColumn("__qr_w2", held(_merged(F.col("__qr_w1"), 1)))
    rows = rows.withColumn("__qr_w4", held(_merged(F.col("__qr_w2"), 2)))
    rows = rows.withColumn("__qr_w8", held(_merged(F.col("__qr_w4"), 4)))
    windows = F.col("__qr_w8")
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    rows = rows.withColumn("__qr_sorted", held(F.when(some, placed)))
    order, n = F.col("__qr_sorted"), F.size("__qr_sorted")
    pairs = F.zip_with(
        F.slice(order, 1, F.greatest(n - 1, F.lit(0))), F.slice(order, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    rows = rows.withColumn("__qr_starts", held(starts))
    s, k = F.col("__qr_starts"), F.greatest(F.size("__qr_starts") - 1, F.lit(0))
    gaps = F.zip_with(F.slice(s, 1, k), F.slice(s, 2, k), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(
        F.size("__qr_starts") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda total, g: total + g)
    ).otherwise(F.lit(0))
    w1, m = F.col("__qr_w1"), F.greatest(F.size("__qr_w1") - 1, F.lit(0))
    same = F.filter(
        F.zip_with(F.slice(w1, 1, m), F.slice(w1, 2, m), lambda a, b: a == b), lambda x: x
    )
    stats = {name: F.col(f"__qr_{name}") for name in (*stats, "word_chars")} | {
        "n_words": F.size("__qr_w1"),
        "n_repeat_words": covered,
        "n_distinct": F.size(F.array_distinct("__qr_w1")),
        "n_next_same": F.size(same),
    }
    inner = [c for c in rows.columns if c.startswith("__qr_")]
    return rows.withColumns({name: stats[name].cast("long") for name in STATS}).drop(*inner)


def vote_columns() -> list[Column]:
    """One column per rule: 1, -1, or 0 where the rule abstains. No words: all abstain."""
    votes = []
    for name, value, good, bad in RULES:
        vote = F.when(F.col("n_words") == 0, 0).when(value() >= bad, -1)
        if good is not None:
            vote = vote.when(value() <= good, 1)
        vote = vote.otherwise(0)
        votes.append(vote.cast("int").alias(f"vote_{name}"))
    return votes


def _anchored(rule: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """The rule with at most MOST_FALSE bad votes on good documents, the rest in proportion."""
    false = rule[-1][0]
    if false <= MOST_FALSE:
        return rule
    wider = (1 - MOST_FALSE) / (1 - false)
    return {v: ((MOST_FALSE if v < 0 else p[0] * wider), p[1]) for v, p in rule.items()}


def fit_label_model(
    patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-10
) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over (votes, count) rows.

    Returns the share of good documents and, per rule and vote, its probability on good
    and on bad documents. Starts from rules that say bad of one good document in a
    hundred and of three bad ones in ten; each vote's count is smoothed by one, so none
    has probability 0. A rule says bad of at most ``MOST_FALSE`` of the good documents:
    that is what makes them the good ones, also where most documents are junk. No
    patterns: the start.
    """
    n_rules = len(RULES)
    share = 0.8
    table = [{1: (0.495, 0.2), 0: (0.495, 0.5), -1: (0.01, 0.3)} for _ in range(n_rules)]
    patterns = sorted(patterns)
    last = -math.inf
    for _ in range(rounds if patterns else 0):
        good_total, bad_total, likelihood = 1.0, 1.0, 0.0
        sums = [{v: [1.0, 1.0] for v in (1, 0, -1)} for _ in range(n_rules)]
        for votes, count in patterns:
            good = math.log(share) + sum(math.log(table[r][v][0]) for r, v in enumerate(votes))
            bad = math.log(1 - share) + sum(math.log(table[r][v][1]) for r, v in enumerate(votes))
            top = max(good, bad)
            both = math.exp(good - top) + math.exp(bad - top)
            p = math.exp(good - top) / both
            likelihood += count * (top + math.log(both))
            good_total += count * p
            bad_total += count * (1 - p)
            for r, v in enumerate(votes):
                sums[r][v][0] += count * p
                sums[r][v][1] += count * (1 - p)
        share = min(max(good_total / (good_total + bad_total), 1e-6), 1 - 1e-6)
        table = [
            {v: (s[v][0] / sum(x[0] for x in s.values()), s[v][1] / sum(x[1] for x in s.values())) for v in s}
            for s in sums
        ]
        table = [_anchored(rule) for rule in table]
        if likelihood - last < tolerance * abs(likelihood):
            break
        last = likelihood
    return share, table


def judged(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, STATS, ``base_failed``, ``posterior``, ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 percent of the words in
    repeated windows. ``kept`` is false then, and else says whether the posterior reaches
    ``min_posterior``.

    - Null or empty text: no words, all rules abstain, ``base_failed``.
    - Documents that fail the base rules take part in the votes like all others.
    - Repeated rows are judged alike, each on its own; a null ``doc_id`` stays null.
    - Other columns do not take part and do not come out. Empty table: empty result.
    """
    stats = document_stats(docs.select("doc_id", "text")).select("doc_id", *STATS)
    stats = written(stats.select("*", *vote_columns()), "quality-stats")
    names = [f"vote_{rule[0]}" for rule in RULES]
    counts = stats.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    share, table = fit_label_model([(tuple(row[n] for n in names), row["n"]) for row in counts])
    odds = F.lit(math.log(share / (1 - share)))
    for name, votes in zip(names, table):
        weight = {v: math.log(p[0] / p[1]) for v, p in votes.items()}
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return (
        stats.withColumn("base_failed", failed)
        .withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))
    )


def keep_good(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their columns as they were.

    Rows meet their verdict by id and a hash of their text, so rows that share an id are
    told apart.
    """
    marked = docs.withColumns({"__qr_id": F.col("doc_id"), "__qr_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    own = docs.select(
        F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("doc_id"), "text"
    )
    verdict = judged(own, min_posterior).filter("kept").select(
        F.col("doc_id.doc_id").alias("__qr_v"), F.col("doc_id.h").alias("__qr_h")
    ).distinct()
    same = F.col("__qr_id").eqNullSafe(F.col("__qr_v")) & (F.col("__qr_hash") == F.col("__qr_h"))
    return marked.join(verdict, same, "left_semi").drop("__qr_id", "__qr_hash")
