"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation learns how far each rule can be
trusted, and a document is kept by its posterior probability instead of by passing every rule.

All work on rows is DataFrame expressions. The only thing that reaches the driver is the count of each vote pattern:
at most 3 ** len(rules()) rows, whatever the corpus.

Defined cases: a null text counts as empty; an empty text has no words and fails the base test; repeated rows are judged
each by itself and alike; an empty table gives an empty result; other columns of the input pass through unless they
have the name of a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._base import clean, cut

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
GOOD, BAD, ABSTAIN = 1, -1, 0
KEEP_FROM = 0.5
ITERATIONS = 60
#: A rule's bad votes are taken to hit at most this share of good documents. The bound keeps the two classes from
#: settling on another split of the corpus, such as that between one kind of defect and all the others.
FALSE_ALARMS = 0.002


def _per(name: str, of: str, bad: float, good: float) -> Column:
    """Bad above one share, good up to another, no vote between."""
    share = F.col(name) / F.greatest(F.col(of), F.lit(1))
    return F.when(F.col(of) == 0, ABSTAIN).when(share > bad, BAD).when(share <= good, GOOD).otherwise(ABSTAIN)




def rules() -> dict[str, Column]:
    """The rules are built late, as columns need a session."""
    words = F.col("n_words")
    mean_length = F.col("word_chars") / F.greatest(words, F.lit(1))
    return {
        "length": F.when(words < 10, BAD).when(words >= 30, GOOD).otherwise(ABSTAIN),
        "symbols": _per("n_symbols", "word_chars", 0.05, 0.01),
        "repetition": _per("n_repeat_words", "n_words", 0.2, 0.15),
        "lines": _per("n_dup_lines", "n_lines", 0.5, 0.35),
        "shouting": _per("n_capitals", "word_chars", 0.3, 0.1),
        "word_length": F.when(words == 0, ABSTAIN).when((mean_length < 2.5) | (mean_length > 14), BAD).when((mean_length >= 3) & (mean_length <= 10), GOOD).otherwise(ABSTAIN),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals.

    Repetition within a text is found inside its own row: hashes of its 5-word windows, of which only texts with a hash
    twice are looked at further. So nothing is shuffled, and one long text costs no more than its length.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(plain, SYMBOLS + "+", "")
    d = docs.withColumns({
        "_ws": F.filter(F.split(plain, WORD_BREAK), lambda w: w != ""),
        "_lines": F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.length(plain) - F.length(bare)).cast("long"),
        "n_capitals": (F.length(plain) - F.length(F.regexp_replace(plain, r"\p{Lu}{2,}", ""))).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("_ws").cast("long"),
        "word_chars": F.length(F.array_join("_ws", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_word_hashes": F.transform("_ws", lambda w: F.xxhash64(w)),
    })
    windows = F.transform("_word_hashes", lambda h, i: F.xxhash64(h, *[F.get("_word_hashes", i + k) for k in range(1, WINDOW)]))
    d = d.withColumn("_hashes", F.when(F.col("n_words") > WINDOW, F.slice(windows, F.lit(1), F.size("_ws") - (WINDOW - 1))).otherwise(F.array().cast("array<long>")))
    d = d.withColumn("_twice", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    at = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("_sorted", F.when(F.col("_twice"), F.sort_array(at)).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    same = lambda a, b: F.coalesce(F.get("_sorted", a)["h"] == F.get("_sorted", b)["h"], F.lit(False))
    d = d.withColumn("_again", F.sort_array(F.transform(F.filter(F.transform("_sorted", lambda x, k: F.struct(x["i"].alias("i"), (same(k, k - 1) | same(k, k + 1)).alias("hit"))), lambda x: x["hit"]), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_again", lambda p, k: F.least(F.coalesce(F.get("_again", k + 1), p + WINDOW) - p, F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return d.withColumn("n_repeat_words", F.when(F.size("_again") > 0, covered).otherwise(F.lit(0).cast("long"))).drop("_ws", "_lines", "_word_hashes", "_hashes", "_twice", "_sorted", "_again")


def learn(patterns: list[tuple[tuple[int, ...], int]], names: list[str], iterations: int = ITERATIONS) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over counted vote patterns: each rule votes by its own odds in either class.

    It starts from the belief that a document with a bad vote is bad. Returns the log-odds of the prior, and per rule
    the log-likelihood ratio of each vote. One pseudo-document in each cell keeps a vote that never occurs neutral.
    """
    believed = [0.1 if BAD in p else 0.9 for p, _ in patterns]
    prior, ratios = 0.0, [{v: 0.0 for v in (GOOD, BAD, ABSTAIN)} for _ in names]
    for _ in range(iterations if patterns else 0):
        good = sum(q * n for q, (_, n) in zip(believed, patterns, strict=True))
        total = sum(n for _, n in patterns)
        prior = math.log((good + 1) / (total - good + 1))
        for j in range(len(names)):
            if_good, if_bad = {}, {}
            for v in (GOOD, BAD, ABSTAIN):
                here = sum(q * n for q, (p, n) in zip(believed, patterns, strict=True) if p[j] == v)
                both = sum(n for p, n in patterns if p[j] == v)
                if_good[v], if_bad[v] = (here + 1) / (good + 3), (both - here + 1) / (total - good + 3)
            alarms = min(if_good[BAD], FALSE_ALARMS)
            left = (1 - alarms) / (1 - if_good[BAD])
            if_good = {v: alarms if v == BAD else x * left for v, x in if_good.items()}
            ratios[j] = {v: math.log(if_good[v]) - math.log(if_bad[v]) for v in (GOOD, BAD, ABSTAIN)}
        before, believed = believed, [1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(r[v] for r, v in zip(ratios, p, strict=True)))))) for p, _ in patterns]
        if max((abs(a - b) for a, b in zip(before, believed, strict=True)), default=0) < 1e-9:
            break
    return prior, ratios


def posterior(votes: DataFrame, names: list[str], prior: float, ratios: list[dict[int, float]]) -> Column:
    """Probability of good, as an expression over the vote columns."""
    odds = F.lit(prior)
    for name, r in zip(names, ratios, strict=True):
        odds = odds + F.when(F.col(f"vote_{name}") == GOOD, r[GOOD]).when(F.col(f"vote_{name}") == BAD, r[BAD]).otherwise(r[ABSTAIN])
    return 1 / (1 + F.exp(-odds))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "base_failed", "p_good", "kept"]


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_from: float = KEEP_FROM) -> DataFrame:
    """key, the counts, each rule's vote, base_failed, p_good (the posterior) and kept, one row per row of docs.

    The counts are checkpointed, a few numbers a row, so that texts are read and measured once for learning and judging.
    """
    counted = cut(measure(clean(docs, key, text), text).drop(text))
    made = rules()
    names = list(made)
    votes = counted.withColumns({f"vote_{n}": v for n, v in made.items()})
    # Bounded: one row for each pattern of votes, at most 3 ** len(names).
    seen = votes.groupBy(*[f"vote_{n}" for n in names]).count().collect()
    patterns = sorted((tuple(r[f"vote_{n}"] for n in names), r["count"]) for r in seen)
    prior, ratios = learn(patterns, names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = votes.withColumns({"base_failed": failed, "p_good": posterior(votes, names, prior, ratios)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
