"""From evidence to a status: rules for candidates, aligned passes, stability over folds, multiplicity, marginal picks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cross_section import rank_pct, residual
from tidemark.operators.holdings import calendar

# fixed values
COLLAPSED, FLIPPED, OUT_OF_SAMPLE, CONSISTENT = 0.03, 0.20, 0.10, 0.70
STABILITY = {"selected": 0.35, "validation": 0.25, "marginal": 0.20, "passed": 0.10, "apart": 0.10}
ACTIONS = ("disclose", "disclose_acknowledge", "require_adjusted_or_override")


def candidate_status(field_ok: Column, held_out_icir: Column, consistency: Column) -> Column:
    """candidate if the held-out ICIR and the share of folds of one sign reach their bars, else draft; nulls are draft."""
    strong = (F.abs(held_out_icir) >= OUT_OF_SAMPLE) & (consistency >= CONSISTENT)
    return F.when(F.coalesce(field_ok & strong, F.lit(False)), "candidate").otherwise("draft")


def historical_status(field_ok: Column, inside: Column, outside: Column, consistency: Column) -> Column:
    """deprecated if the ICIR collapsed or changed sign out of sample, candidate if it held, else draft; nulls are draft."""
    no = F.lit(False)
    flipped = (inside * outside < 0) & (F.abs(inside) >= FLIPPED)
    held = (inside * outside > 0) & (F.abs(outside) >= OUT_OF_SAMPLE) & (consistency >= CONSISTENT)
    return (
        F.when(~F.coalesce(field_ok, no) | inside.isNull() | outside.isNull(), "draft").when((F.abs(outside) < COLLAPSED) | flipped, "deprecated")
        .when(F.coalesce(held, no), "candidate").otherwise("draft")
    )


def aligned_pass(side: Column, rank_icir: Column, sharpe: Column, floor: float = 1.0) -> Column:
    """Whether ICIR and long-short Sharpe, signed by the side held, are above 0 and the floor; False for nulls and other sides."""
    folded = F.lower(F.trim(side))
    sign = F.when(folded == "long", 1.0).when(folded == "short", -1.0)
    return F.coalesce((sign * rank_icir > 0) & (sign * sharpe > floor), F.lit(False))


def stability_scores(decisions: DataFrame) -> DataFrame:
    """factor, selected, validation, marginal, passed, apart, score: weighted ranks of a factor's means over its folds.

    decisions: factor, selected, validation_icir, marginal_icir, passed, max_corr. Unknown marginal ICIR counts as 0, and
    max_corr is cut to 0..1 (unknown: 0) after its largest value over the folds is taken.
    """
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    apart = 1 - F.least(F.greatest(F.coalesce(F.max("max_corr"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    means = decisions.groupBy("factor").agg(
        share("selected"), F.avg(F.abs("validation_icir")).alias("validation"), F.avg(F.coalesce(F.abs("marginal_icir"), F.lit(0.0))).alias("marginal"), share("passed"), apart.alias("apart"),
    ).withColumn("_all", F.lit(1))  # a row for each factor of the catalog
    total = F.lit(0.0)
    for name, weight in STABILITY.items():
        total = total + weight * F.coalesce(rank_pct(F.col(name), "_all"), F.lit(0.0))
    return means.withColumn("score", total).drop("_all")


def multiplicity(ledger: DataFrame, window: str, frozen: str, warn: int = 5, hard: int = 10) -> DataFrame:
    """window, spent (distinct frozen sets), action: what a claim on this window needs."""
    n = F.col("spent")
    spent = ledger.groupBy(window).agg(F.count_distinct(frozen).alias("spent"))
    return spent.withColumn("action", F.when(n < warn, ACTIONS[0]).when(n < hard, ACTIONS[1]).otherwise(ACTIONS[2]))


def usable_until(days: DataFrame, horizon: int, date: str = "date") -> DataFrame:
    """date, usable: the last date whose label over `horizon` open dates is known by date; null if there is none."""
    return calendar(days, date).select(date, F.lag(date, horizon).over(Window.orderBy(date)).alias("usable"))


def marginal_on(panel: DataFrame, candidate: str, bases: list[str], date: str = "date", min_rows: int = 10) -> DataFrame:
    """panel with factor and value: the candidate's residual by date on any number of bases, over rows that have all.

    Bases are made orthogonal one after another, so each step has one slope, and all windows share one shuffle by date.
    A base that the earlier ones explain wholly has no spread left; the residual is then null.
    """
    whole = panel.withColumn("_ok", F.lit(True))
    for c in (candidate, *bases):
        whole = whole.withColumn("_ok", F.col("_ok") & F.col(c).isNotNull())
    names = [f"_b{i}" for i in range(len(bases))]
    for n, c in zip([*names, "value"], [*bases, candidate], strict=True):
        whole = whole.withColumn(n, F.when(F.col("_ok"), F.col(c).cast("double")))
    for i, n in enumerate(names):
        for later in (*names[i + 1 :], "value"):
            whole = whole.withColumn(later, residual(F.col(later), F.col(n), date, min_rows=min_rows))
    return whole.drop("_ok", *names).withColumn("factor", F.lit(candidate))


def select_marginal(metrics: dict[str, tuple[str, float]], correlations: dict[tuple[str, str], float], caps: dict[str, int], floor: float, references: tuple[str, ...] = ()) -> list[tuple[str, float]]:
    """(factor, score) in the order taken: each time the largest |icir| * (1 - largest |correlation| to those taken).

    metrics: factor to (family, icir). References only count as taken. Stops when the caps are full or, after the first,
    when the best score is below the floor; ties go to the factor listed first. A catalog's metrics, so plain Python.
    """
    rho = lambda a, b: abs(correlations.get((a, b), correlations.get((b, a), 0.0)) or 0.0)
    taken: list[tuple[str, float]] = []
    held: Counter[str] = Counter()
    left = dict(metrics)
    nearest = {f: max((rho(f, g) for g in references), default=0.0) for f in left}
    while left:
        open_to = [f for f, (family, _) in left.items() if family not in caps or held[family] < caps[family]]
        if not open_to:
            break
        best = max(open_to, key=lambda f: abs(left[f][1]) * (1 - nearest[f]))
        score = abs(left[best][1]) * (1 - nearest[best])
        if taken and score < floor:
            break
        taken.append((best, score))
        held[left.pop(best)[0]] += 1
        nearest = {f: max(nearest[f], rho(f, best)) for f in left}
    return taken
