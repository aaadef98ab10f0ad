"""Pairwise judgments, win rates and significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsons as js

CRITERIA = ("comprehensiveness", "diversity", "empowerment", "directness")
#: Win rates that two criteria should pass, and the level of significance (fixed values).
TARGETS, ALPHA = {"comprehensiveness": 0.72, "diversity": 0.62}, 0.05


def grid(questions: DataFrame, criteria: tuple[str, ...] = CRITERIA, runs: int = 5) -> DataFrame:
    """A row for each question, criterion and run."""
    rows = questions.withColumn("criterion", F.explode(F.array(*map(F.lit, criteria))))
    return rows.withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def coin(*keys: Column | str, seed: int = 42) -> Column:
    """Which system is shown as A: 1 or 0, the same in each run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2)).cast("int")


def parsed_judgments(rows: DataFrame) -> DataFrame:
    """Adds winner_letter, score_a, score_b from JSON of column ``response``; TIE and 50 where it can't be read."""
    v = F.col("_v")
    rows = rows.withColumn("_v", js.parsed("response"))
    letter = F.upper(F.trim(F.try_variant_get(v, "$.winner", "string")))
    score = lambda name: js.whole(F.try_variant_get(v, name, "variant"), 50, 0, 100)
    return rows.withColumns({"winner_letter": F.when(letter.isin("A", "B"), letter).otherwise("TIE"), "score_a": score("$.score_a"), "score_b": score("$.score_b")}).drop("_v")


def unswapped(rows: DataFrame, first: str = "global", second: str = "local") -> DataFrame:
    """Adds system_a, system_b and winner from a coin (1: ``first`` was shown as A) and the winner's letter; scores 0..100."""
    a = F.when(F.col("coin") == 1, first).otherwise(second)
    b = F.when(F.col("coin") == 1, second).otherwise(first)
    winner = F.when(F.col("winner_letter") == "A", a).when(F.col("winner_letter") == "B", b).otherwise("tie")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(c, F.lit(50))))
    return rows.withColumns({"system_a": a, "system_b": b, "winner": winner, "score_a": clamp("score_a"), "score_b": clamp("score_b")})


def criterion_results(rows: DataFrame, first: str = "global", second: str = "local", by: tuple[str, ...] = ("question_id", "criterion")) -> DataFrame:
    """Wins, ties, win rate (half if none is decisive), mean scores by system, and the majority's winner."""
    score = lambda s: F.avg(F.when(F.col("system_a") == s, F.col("score_a")).otherwise(F.col("score_b")))
    out = rows.groupBy(*by).agg(
        F.count_if(F.col("winner") == first).alias("wins_first"), F.count_if(F.col("winner") == second).alias("wins_second"), F.count_if(F.col("winner") == "tie").alias("ties"),
        F.round(score(first), 1).alias("avg_first"), F.round(score(second), 1).alias("avg_second"),
    )
    decisive = F.col("wins_first") + F.col("wins_second")
    majority = F.when(F.col("wins_first") > F.col("wins_second"), first).when(F.col("wins_first") < F.col("wins_second"), second).otherwise("tie")
    return out.withColumn("win_rate", F.coalesce(F.try_divide("wins_first", decisive), F.lit(0.5))).withColumn("majority", majority)


def binomial_tail(k: Column | str, n: Column | str) -> Column:
    """Chance of k or more heads in n tosses of a fair coin; null without tosses. One pass over 0…n with two numbers of state."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (k, n))
    one = F.array(F.struct(k.cast("int").alias("k"), n.cast("int").alias("n")))

    def tail(t: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))

        def step(s: Column, i: Column) -> Column:
            # the logarithm of n over i, from that of n over i - 1
            log = s["log"] + F.when(i > 0, F.log((t["n"] - i + 1) / i)).otherwise(0.0)
            return F.struct(log.alias("log"), (s["sum"] + F.when(i >= t["k"], F.exp(log - t["n"] * math.log(2))).otherwise(0.0)).alias("sum"))

        return F.aggregate(F.sequence(F.lit(0), t["n"]), start, step, lambda s: s["sum"])

    return F.when(n > 0, F.least(F.lit(1.0), F.get(F.transform(one, tail), F.lit(0))))


def summary(results: DataFrame) -> DataFrame:
    """Of each criterion: mean and population deviation of win rates, totals, p-value of the wins, and targets."""
    rows = results.groupBy("criterion").agg(F.count("*").alias("questions"), F.round(F.avg("win_rate"), 4).alias("mean_win_rate"), F.round(F.stddev_pop("win_rate"), 4).alias("std_win_rate"), F.sum("wins_first").alias("wins_first"), F.sum("wins_second").alias("wins_second"), F.sum("ties").alias("ties"))
    p = binomial_tail(F.col("wins_first"), F.col("wins_first") + F.col("wins_second"))
    target = F.create_map(*(x for c, t in TARGETS.items() for x in (F.lit(c), F.lit(t))))
    rows = rows.withColumn("p_value", F.round(p, 6)).withColumn("significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False)))
    return rows.withColumn("meets_target", F.col("mean_win_rate") > F.try_element_at(target, F.col("criterion")))


def signed_ranks(rows: DataFrame, difference: str, by: list[str]) -> DataFrame:
    """Wilcoxon's sums of the ranks of positive and negative differences; zeros are left out, ties share their mean rank.

    Equal sizes are counted first, so what is ranked is one row for each size. Also the number of zeros, and the sum of t³ - t
    over groups of t ties, which the p-value asks for.
    """
    d = F.col(difference)
    sizes = rows.groupBy(*by, F.abs(d).alias("_size")).agg(F.count_if(d > 0).alias("_up"), F.count_if(d < 0).alias("_down"), F.count_if(d == 0).alias("_zero"))
    sizes = sizes.withColumn("_n", F.col("_up") + F.col("_down"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_size").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_rank", F.coalesce(before, F.lit(0)) + (F.col("_n") + 1) / 2.0)
    return sizes.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_up") * F.col("_rank")).alias("w_plus"), F.sum(F.col("_down") * F.col("_rank")).alias("w_minus"),
        F.sum("_zero").alias("zeros"), F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("tied"),
    ).where("n > 0")


#: Differences up to which the p-value is exact, if there are neither zeros nor ties.
EXACT_N = 50


def _exact_tail(w: Column, n: Column) -> Column:
    """Chance that the ranks 1…n with random signs have positive ones that sum up to ``w`` or more."""
    one = F.array(F.struct(w.cast("int").alias("w"), n.cast("int").alias("n")))
    # how many subsets of the ranks so far have each sum, as doubles: they are whole numbers up to 2**50
    start = lambda t: F.transform(F.sequence(F.lit(0), (t["n"] * (t["n"] + 1) / 2).cast("int")), lambda x: (x == 0).cast("double"))
    more = lambda s, r: F.transform(s, lambda c, i: c + F.when(i >= r, F.get(s, i - r)).otherwise(0.0))
    tail = lambda t: F.aggregate(F.sequence(F.lit(1), t["n"]), start(t), more, lambda s: F.aggregate(F.slice(s, t["w"] + 1, F.size(s)), F.lit(0.0), lambda x, c: x + c)) / F.pow(F.lit(2.0), t["n"])
    return F.get(F.transform(one, tail), F.lit(0))


def signed_rank_p(w_plus: Column | str, n: Column | str, tied: Column | str | None = None, zeros: Column | str | None = None) -> Column:
    """One-sided p-value of ``w_plus``: exact for up to ``EXACT_N`` differences without zeros and ties, else by the normal
    approximation with its variance lessened by ties. Null without differences."""
    w, n, tied, zeros = (F.lit(0) if c is None else F.col(c) if isinstance(c, str) else c for c in (w_plus, n, tied, zeros))
    z = (w - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - tied / 2.0) / 24.0)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    exact = (n <= EXACT_N) & (tied == 0) & (zeros == 0)
    return F.when(n > 0, F.when(exact, _exact_tail(w, F.least(n, F.lit(EXACT_N)))).when(z >= 0, tail).otherwise(1 - tail))


def compared_counts_p(rows: DataFrame, first: str = "claims_first", second: str = "claims_second") -> DataFrame:
    """(n, p_value) of ``first`` being greater than ``second`` over all rows; null if no two differ."""
    ranks = signed_ranks(rows.withColumn("_d", F.col(first) - F.col(second)).withColumn("_all", F.lit(1)), "_d", ["_all"])
    return ranks.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(signed_rank_p("w_plus", "n", "tied", "zeros")).alias("p_value"))


def token_usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tokens and costs; a cost is null only if all are."""
    return rows.groupBy(*by).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"))
