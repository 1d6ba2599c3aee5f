"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each, a posterior decides.

Counts are taken from whole texts inside one row. The votes of the texts that pass the base test are summed to one
row per vote pattern (at most ``3 ** len(RULES)``, whatever the input), expectation-maximisation runs on those sums,
and the learned weights go back into a column expression. All votes of these texts are used, none sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import count_of, let, space_words
from rookery.session import stage

SYMBOLS = "#*$%&|<>"
GOOD, BAD, NONE = 1, -1, 0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words which occurs twice or more, the first occurrence included.

    Windows of one text are compared by a 64-bit hash; two different ones of a text of 20,000 words agree with
    a chance below 1e-10. Windows are sorted with their positions, so the work is n log n per text.
    """

    def covered(hashes: Column) -> Column:
        def equal_neighbour(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])),
            )

        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        positions = let(placed, lambda s: F.sort_array(F.transform(equal_neighbour(s), lambda x: x["i"])))
        steps = let(positions, lambda p: F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < width, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
            )
        )

    hashes = let(words, windows)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")



def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text, one row per input row. A null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.col("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(F.col(id_col), F.col(text_col)).withColumn("_words", space_words(text)).select(
        F.col(id_col),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count_of(text, "A-Z").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[.,;:?][\x20\x09-\x0D]")).cast("long").alias("n_stops"),
    )


def base_failed(df_prefix: str = "") -> Column:
    n, r = F.col(f"{df_prefix}n_words"), F.col(f"{df_prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


@dataclass(frozen=True)
class Rule:
    """Bad if ``bad`` holds, else good if ``good`` holds, else no vote."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 5", "n_words >= 80"),
    Rule("symbols", "10 * n_symbols > 3 * n_words", "100 * n_symbols < 2 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    Rule("lines", "10 * n_dup_lines > 4 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words < n_words"),
    Rule("capitals", "10 * n_upper > 4 * word_chars", "10 * n_upper < word_chars"),
    Rule("stops", "n_words >= 30 AND 100 * n_stops < 6 * n_words", "100 * n_stops > 8 * n_words"),
)


def votes(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One ``vote_<rule>`` column per rule: 1 good, -1 bad, 0 no vote. A text without words gets no votes but for its length."""
    return counts.withColumns({
        f"vote_{r.name}": F.when((F.col("n_words") == 0) & (F.lit(r.name) != "length"), NONE)
        .when(F.expr(r.bad), BAD).when(F.expr(r.good), GOOD).otherwise(NONE)
        for r in rules
    })


@dataclass(frozen=True)
class VoteModel:
    """``prior`` of a good text; per rule and class the chance of each vote."""

    rules: tuple[str, ...]
    prior: float
    chances: tuple[dict[int, tuple[float, float]], ...]  # vote -> (given good, given bad)

    def log_odds(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        return odds + sum(math.log(c[v][0]) - math.log(c[v][1]) for c, v in zip(self.chances, pattern) if v != NONE)

    def posterior(self, pattern: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.log_odds(pattern)))))

    def accuracy(self) -> dict[str, float]:
        """Chance that a vote of the rule is right, over both classes."""
        found = {}
        for name, c in zip(self.rules, self.chances):
            right = self.prior * c[GOOD][0] + (1 - self.prior) * c[BAD][1]
            cast = right + self.prior * c[BAD][0] + (1 - self.prior) * c[GOOD][1]
            found[name] = right / cast
        return found

    def column(self) -> Column:
        """The posterior as a native expression over the vote columns."""
        odds = F.lit(math.log(self.prior) - math.log(1 - self.prior))
        for name, c in zip(self.rules, self.chances):
            v = F.col(f"vote_{name}")
            odds = odds + F.when(v == GOOD, math.log(c[GOOD][0] / c[GOOD][1])).when(v == BAD, math.log(c[BAD][0] / c[BAD][1])).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[str, ...], rounds: int = 100) -> VoteModel:
    """Expectation-maximisation over counted vote patterns; abstaining says nothing about the class.

    Starts from texts with a bad vote as bad, because a rule that finds nothing wrong says less than one that
    does. Without any vote the prior stays at the start value.
    """
    weight = {pattern: 0.05 if BAD in pattern else 0.95 for pattern, _ in patterns}
    total = sum(n for _, n in patterns)
    model = VoteModel(rules, 0.9, tuple({GOOD: (0.9, 0.5), BAD: (0.1, 0.5)} for _ in rules))
    for _ in range(rounds if total else 0):
        good = sum(weight[p] * n for p, n in patterns)
        chances = []
        for j in range(len(rules)):
            cell = {GOOD: [1.0, 0.5], BAD: [0.1, 0.5]}
            for p, n in patterns:
                if p[j] != NONE:
                    cell[p[j]][0] += weight[p] * n
                    cell[p[j]][1] += (1 - weight[p]) * n
            sums = [cell[GOOD][k] + cell[BAD][k] for k in (0, 1)]
            chances.append({v: (cell[v][0] / sums[0], cell[v][1] / sums[1]) for v in (GOOD, BAD)})
        before = model
        model = VoteModel(rules, min(0.999, max(0.001, (good + 9) / (total + 10))), tuple(chances))
        weight = {p: model.posterior(p) for p, _ in patterns}
        if abs(model.prior - before.prior) < 1e-9:
            break
    return model


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> VoteModel:
    """Sums all rows to one row per vote pattern and runs the estimation on those."""
    names = [f"vote_{r.name}" for r in rules]
    rows = voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    return fit_votes([(tuple(row[c] for c in names), row["n"]) for row in rows], tuple(r.name for r in rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior ``p_quality`` and the verdict ``kept``, one row per input row.

    ``kept`` is false for a text that fails the base test, else whether the posterior reaches ``threshold``. The model
    is that of texts that pass the base test: fitted with the others, the bad class is what the base test removes
    anyway, and rules against other junk look weak beside it.
    Null and empty texts have no words and fail the base test; repeated rows each get their row; other columns
    of the input are not looked at; an empty table gives an empty table.
    """
    counted = stage(votes(features(docs), rules), "quality_votes")
    model = fit(counted.where(~base_failed()), rules)
    return counted.withColumns({"p_quality": model.column(), "base_failed": base_failed()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold)
    )
