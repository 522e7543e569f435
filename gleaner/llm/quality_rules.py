"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Base figures of a text (words are runs of other characters than ASCII white space):
word_chars, n_symbols, n_dup_lines and n_repeat_words as the columns say. Each rule of RULES votes 1 (good), 0 (bad) or
abstains, and abstaining says something, too. A text's unknown label is good or one of a few ways to be bad (KINDS), each
looked at by several rules, so that it shows in votes that go together. Given the label the rules are taken as
independent. EM over the counts of the vote patterns (at most 3 ** rules rows, whatever the number of documents) finds the
labels' shares and, for each of them, how often each rule votes bad, good or not at all. Nothing binds these estimates but
a start that trusts the rules of a kind on it, which also weighs in as PSEUDO of the table; so a rule that finds no
company loses its say, and several good votes outvote a bad one. All estimates depend on the shares of the patterns
alone, not on the size of the table. A text is kept if the posterior probability of good is at least 0.5 and the base
rules did not fail it.

DataFrame functions throughout. Cases: a null text has no words (all figures 0) and fails the base; a text of one line
or of fewer than eight words has no repeats; with no documents nothing is estimated; repeated rows count each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._shared import rows_by_id, written

WINDOW = 8


def figures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base figures and some more, a row per document.

    A lambda that named an array's expression would take the array anew for each element, so arrays become columns first,
    each named more than once by what follows: the optimizer then leaves them their own projection.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = documents.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    hashes, none = F.col("hashes"), F.array().cast("array<bigint>")
    d = d.withColumn("windows", F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(none))
    # windows that come again, by hash and place; empty for most texts, and dear only for the others
    windows = F.col("windows")
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    d = d.withColumn("placed", F.when(again, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    placed = F.col("placed")
    met = F.filter(placed, lambda x, k: (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"]))
    covered = F.aggregate(
        F.sort_array(F.transform(met, lambda x: x["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(i - s["last"], F.lit(WINDOW))).alias("n")),
        lambda s: s["n"],
    )
    return d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(placed) == 0, F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_shouts"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_letterless"),
    )


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), F.lit(0)).when(F.expr(good), F.lit(1))


_SHOWN = ("100 * n_symbols {0} * n_words", "100 * n_shouts {1} * n_words", "100 * n_capitals {2} * word_chars", "100 * n_repeat_words {3} * n_words")

#: name: (votes good where, votes bad where); abstains between the two. Whole numbers, so that no rounding decides.
RULES = {
    "symbols": (_SHOWN[0].format("<= 2"), _SHOWN[0].format("> 10")),
    "letters": ("n_words > 0 AND 100 * n_letters >= 90 * word_chars", "n_words > 0 AND 100 * n_letters < 80 * word_chars"),
    "letterless": ("n_words > 0 AND 100 * n_letterless <= 10 * n_words", "100 * n_letterless > 25 * n_words"),
    "shouts": (_SHOWN[1].format("", "<= 5"), _SHOWN[1].format("", "> 20")),
    "capitals": (_SHOWN[2].format("", "", "<= 15"), _SHOWN[2].format("", "", "> 30")),
    "lines": ("10 * n_dup_lines <= n_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    "windows": (_SHOWN[3].format("", "", "", "<= 10"), _SHOWN[3].format("", "", "", "> 25")),
    "variety": ("n_words < 500 AND 100 * n_distinct_words >= 40 * n_words", "n_words < 500 AND 100 * n_distinct_words < 25 * n_words"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
}
#: Ways to be bad, each with the rules that look at it; word_length looks at none of its own.
KINDS = (("symbols", "letters", "letterless"), ("shouts", "capitals"), ("lines", "windows", "variety"))

#: How far a vote is trusted at the start.
TRUST = 0.8
#: Weight of the start as a share of the table, so that a table and a hundred copies of it are estimated alike.
PSEUDO = 0.01
Votes = tuple[int | None, ...]


class Model(NamedTuple):
    """shares[label], and chances[label, rule, outcome] of the outcomes bad, good and no vote; label 0 is good."""

    shares: np.ndarray
    chances: np.ndarray

    def posteriors(self, outcomes: np.ndarray) -> np.ndarray:
        """The probability of each label for patterns of outcomes (0, 1, 2), a row each."""
        logs = np.log(self.shares) + sum(np.log(self.chances[:, r, outcomes[:, r]]).T for r in range(outcomes.shape[1]))
        parts = np.exp(logs - logs.max(1, keepdims=True))
        return parts / parts.sum(1, keepdims=True)


def first_model(rules: tuple[str, ...] = tuple(RULES), kinds: tuple[tuple[str, ...], ...] = KINDS) -> Model:
    rest = (1 - TRUST) / 2
    shares = np.array([TRUST] + [(1 - TRUST) / len(kinds)] * len(kinds))
    chances = np.array([[[TRUST, rest, rest] if r in kind else [rest, TRUST, rest] for r in rules] for kind in ((), *kinds)])
    return Model(shares, chances)


def estimate(counts: list[tuple[Votes, int]], steps: int = 100, start: Model | None = None) -> Model:
    """EM over (votes, count), from a start that weighs PSEUDO of the table."""
    start = first_model() if start is None else start
    total = sum(n for _, n in counts)
    if not total:
        return start
    counts = sorted(counts, key=str)
    outcomes = np.array([[2 if v is None else v for v in votes] for votes, _ in counts])
    weight = np.array([n / total for _, n in counts])
    model = start
    for _ in range(steps):
        mass = model.posteriors(outcomes) * weight[:, None]
        seen = np.stack([mass.T @ (outcomes == o) for o in range(3)], 2)
        share = mass.sum(0)
        model = Model((share + PSEUDO * start.shares) / (1 + PSEUDO), (seen + PSEUDO * start.chances) / (share + PSEUDO)[:, None, None])
    return model


def posterior(votes: list[Votes], model: Model) -> list[float]:
    """The probability of good of each pattern of votes."""
    return model.posteriors(np.array([[2 if v is None else v for v in x] for x in votes]))[:, 0].tolist() if votes else []


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) of each row."""
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    votes = [_vote(*x) for x in RULES.values()]
    f = written(figures(documents, id_col, text_col), "figures")  # else every vote would take the figures anew
    pattern = sum((F.coalesce(v, F.lit(2)) * 3**r for r, v in enumerate(votes)), F.lit(0))
    f = f.withColumn("base_failed", base).withColumn("pattern", pattern.cast("int"))
    counts = {r["pattern"]: r["count"] for r in f.groupBy("pattern").count().collect()}  # 3 ** rules rows at most
    cast = {k: tuple((0, 1, None)[k // 3**r % 3] for r in range(len(RULES))) for k in counts}
    model = estimate([(cast[k], n) for k, n in counts.items()])
    good = dict(zip(cast, posterior(list(cast.values()), model), strict=True))
    rows = [F.struct(F.lit(k).alias("pattern"), F.lit(p).alias("posterior")) for k, p in sorted(good.items())]
    none = F.array().cast("array<struct<pattern:int,posterior:double>>")
    known = documents.sparkSession.range(1).select(F.inline(F.array(*rows) if rows else none))
    f = f.join(F.broadcast(known), "pattern")
    good = F.col("posterior")
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (good >= 0.5)).alias("kept"), good)


def filtered(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents whose ids are kept; rows that share an id stay if one of them is kept."""
    kept = judged(documents, id_col, text_col).where("kept").select("doc_id").distinct()
    return rows_by_id(documents, id_col, kept)
