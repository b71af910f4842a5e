"""Quality rules by weak supervision (op 8, DataFrame functions only).

Every rule votes "good" (1), "bad" (0) or abstains (null) on measures of the
whole text.  Expectation-maximisation over the table of vote patterns (at most
3^rules rows, whatever the corpus size) estimates how accurate each rule's
votes are; a text is kept when its posterior probability of being good reaches
``threshold``.  A text without any vote has the class balance as posterior.

Words are runs of ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``.

Defined results for odd input
- null text: as the empty text: no words, every count 0, all rules abstain
  (and base_failed holds)
- ties: a posterior equal to the threshold keeps the text
- repeated rows: each gets its own, equal, result
- empty table: an empty result (the model keeps its starting values)
- extra columns: kept by ``measure``/``judge`` unless they clash with an output
  column, which replaces them
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_ended_lines", "n_upper", "n_shouts", "n_bars"]


def _without(text: Column, chars: str) -> Column:
    for ch in chars:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


LOW = (1 << 20) - 1      # low bits of a window key: its position


def _repeat_words(words: Column) -> Column:
    """Number of words covered by a 3-word window that occurs twice or more.

    A window's key is one long, its hash above its position, so one sort of
    longs brings equal windows together; the words themselves confirm them.
    Texts of more than 2^20 words sort (hash, position) pairs instead.
    """
    def fields(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def keys(w: Column) -> Column:
        return F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: fields(w, i).bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long"))))

    def same(w: Column, x: Column, y: Column) -> Column:
        i = x.bitwiseAND(F.lit(LOW)).cast("int")
        j = y.bitwiseAND(F.lit(LOW)).cast("int")
        return ((x.bitwiseOR(F.lit(LOW)) == y.bitwiseOR(F.lit(LOW))) & (F.get(w, i) == F.get(w, j))
                & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2)))

    def from_keys(w: Column) -> Column:
        return _let(keys(w), lambda s: _cover(F.transform(
            F.filter(s, lambda x, k: same(w, x, F.get(s, k + 1)) | same(w, x, F.get(s, k - 1))),
            lambda x: x.bitwiseAND(F.lit(LOW)).cast("int"))))

    def pairs(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            fields(w, i).alias("h"), i.alias("i"))))

    def from_pairs(w: Column) -> Column:
        return _let(pairs(w), lambda s: _cover(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"])),
            lambda x: x["i"])))

    return _let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long"))
                .when(F.size(w) <= LOW, from_keys(w)).otherwise(from_pairs(w)))


def _cover(starts: Column) -> Column:
    """Number of words covered by 3-word windows at the given starts."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(starts), zero, lambda a, x: F.struct(
        x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the measures of each whole text (one narrow pass)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.rtrim(F.translate(x, "\t\x0b\x0c\r", "    "))),
                     lambda x: x != "")
    raw_lines = F.filter(F.split(t, "\n"), lambda x: _without(x, " \t\x0b\x0c\r") != "")
    bare = _without(t, SPACES)
    by_word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"),
                                             _repeat_words(w).alias("r")))
    by_line = _let(raw_lines, lambda a: F.struct(
        F.size(a).cast("long").alias("n"),
        (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    ended = F.size(F.filter(lines, lambda x: x.endswith(".") | x.endswith("!") | x.endswith("?")
                            | x.endswith('"') | x.endswith("”") | x.endswith(":"))).cast("long")
    base = docs.drop(*[c for c in MEASURES if c != text])
    return (base
            .withColumn("__words", by_word).withColumn("__lines", by_line)
            .withColumn("n_words", F.col("__words.n"))
            .withColumn("word_chars", F.length(bare).cast("long"))
            .withColumn("n_symbols", (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"))
            .withColumn("n_dup_lines", F.col("__lines.dup"))
            .withColumn("n_repeat_words", F.col("__words.r"))
            .withColumn("n_lines", F.col("__lines.n"))
            .withColumn("n_ended_lines", ended)
            .withColumn("n_upper", F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).cast("long"))
            .withColumn("n_shouts", ((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2)
                        .cast("long"))
            .withColumn("n_bars", (F.length(t) - F.length(_without(t, "|"))).cast("long"))
            .drop("__words", "__lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, 0 bad, null abstains.  Most rules only ever
    vote bad: a text that breaks none of them has no vote against it."""
    n, some = F.col("n_words"), F.col("n_words") >= 10
    # Spark computes shared quotients before ``some``: a divisor of 0 must give null, not an error
    by_word = lambda c: F.try_divide(F.col(c), n)
    by_line = lambda c: F.try_divide(F.col(c), F.col("n_lines"))
    by_char = lambda c: F.try_divide(F.col(c), F.col("word_chars"))
    bad = lambda c: F.when(some & c, F.lit(0))
    return {
        "symbols_by_word": bad(by_word("n_symbols") > 0.4),
        "symbols_by_char": bad(by_char("n_symbols") > 0.05),
        "bars": bad(by_word("n_bars") > 0.2),
        "capitals": bad(by_char("n_upper") > 0.4),
        "shouts": bad(by_word("n_shouts") > 0.2),
        "repeats": bad(by_word("n_repeat_words") > 0.35),
        "dup_lines": bad((F.col("n_lines") >= 4) & (by_line("n_dup_lines") > 0.4)),
        "word_length": bad((by_word("word_chars") < 2) | (by_word("word_chars") > 20)),
        "line_ends": F.when(some & (F.col("n_lines") >= 3) & (by_line("n_ended_lines") < 0.1), F.lit(0))
                      .when(some & (by_line("n_ended_lines") > 0.6), F.lit(1)),
        "prose": F.when(some & (by_word("n_symbols") < 0.05) & (by_char("n_upper") < 0.2)
                        & (by_word("n_repeat_words") < 0.25), F.lit(1)),
    }


@dataclass
class RuleModel:
    """Accuracy of each rule's votes, and the class balance (a parameter)."""
    accuracy: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5
    rounds: int = 0

    def weights(self) -> dict[str, float]:
        return {k: math.log(a / (1 - a)) for k, a in self.accuracy.items()}

    def posterior(self, votes: dict[str, Column]) -> Column:
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, w in self.weights().items():
            logit = logit + F.when(votes[name] == 1, F.lit(w)).when(votes[name] == 0, F.lit(-w)) \
                .otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))


def fit(measured: DataFrame, *, max_rounds: int = 50, tolerance: float = 1e-6, start: float = 0.9,
        pseudo: float = 20.0, prior: float = 0.5) -> RuleModel:
    """EM over the vote patterns of all rows of ``measured``.

    Spark counts the patterns; there are at most 3^rules of them, however
    many rows, and the loop over them is a few sums.  The expectation step gives each
    pattern's probability of being good, the maximisation step each rule's
    accuracy: the expected share of its votes that were right.  ``pseudo``
    votes at ``start`` keep a rule that hardly votes near its starting value;
    a rule is never taken to be worse than chance.
    """
    votes = rules()
    counted = measured.select(*[v.alias(k) for k, v in votes.items()]) \
        .groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    counted.sort(key=str)
    model = RuleModel({k: start for k in votes}, prior)
    for rnd in range(1, max_rounds + 1):
        w = model.weights()
        right = {k: pseudo * start for k in votes}
        cast = {k: pseudo for k in votes}
        for r in counted:
            z = math.log(prior / (1 - prior)) + sum(
                w[k] * (1 if r[k] == 1 else -1) for k in votes if r[k] is not None)
            good = 1 / (1 + math.exp(-z))
            for k in votes:
                if r[k] is not None:
                    cast[k] += r["n"]
                    right[k] += r["n"] * (good if r[k] == 1 else 1 - good)
        new = {k: min(max(right[k] / cast[k], 0.55), 0.99) for k in votes}
        change = max(abs(new[k] - model.accuracy[k]) for k in votes)
        model = RuleModel(new, prior, rnd)
        if change < tolerance:
            break
    return model


def judge(measured: DataFrame, model: RuleModel, threshold: float = 0.5) -> DataFrame:
    """``measured`` plus base_failed, p_good and kept."""
    base = measured.drop("base_failed", "p_good", "kept")
    return (base.withColumn("base_failed", base_failed())
            .withColumn("p_good", model.posterior(rules()))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))
