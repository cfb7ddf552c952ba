"""Shares of true pairs among candidates, learned from the candidates themselves."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and true pairs, that the values given to start with count as; rounds of expectation and maximisation; steps of a decade
#: in which the expected number of namesakes is counted.
PRIOR_ROWS, PRIOR_PAIRS, ROUNDS, STEPS = 2000.0, 200.0, 60, 8


def learn(pairs: DataFrame, start: dict[str, float], levels: dict[str, float], rows: Callable[[str], float],
          control: Callable[[str], str | None] = lambda cell: None) -> tuple[dict[str, float], dict[str, float]]:
    """(prior of each cell, share of each level) by expectation maximisation over candidate ``pairs`` (cell, level, expected).

    A pair is true with odds prior(cell) x share(level) / expected, where ``expected`` namesakes come about by chance; a prior is
    the number of true pairs over ``rows(cell)``. Pairs enter as counts by cell, level and step of ``expected``, a table whose size
    does not depend on the data. ``control`` names a cell in which nothing can be true; what the same estimate
    gives there is taken off."""
    step = F.floor(F.log10(F.greatest(F.col("expected"), F.lit(1e-18))) * STEPS)
    hist = [(r["cell"], r["level"], 10 ** ((r["s"] + 0.5) / STEPS), r["n"]) for r in
            pairs.groupBy("cell", "level", step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()]
    prior, share = {c: max(p, 1e-9) for c, p in start.items()}, dict(levels)
    for _ in range(ROUNDS):
        true_c, true_l = dict.fromkeys(prior, 0.0), dict.fromkeys(share, 0.0)
        for c, l, e, n in hist:
            odds = prior[c] * share[l] / e
            t = n * odds / (1 + odds)
            true_c[c] += t
            if not math.isnan(t) and control(c) != c:
                true_l[l] += t
        prior = {c: max(1e-9, (t + PRIOR_ROWS * start[c]) / (rows(c) + PRIOR_ROWS)) for c, t in true_c.items()}
        total = sum(true_l.values())
        share = {l: (t + PRIOR_PAIRS * levels[l]) / (total + PRIOR_PAIRS) for l, t in true_l.items()}
    out = {c: max(1e-9, p - (prior[control(c)] if control(c) else 0.0)) for c, p in prior.items()}
    return {c: p for c, p in out.items() if control(c) != c}, share


def as_map(values: dict[str, float]) -> Column:
    """A dictionary as a map column."""
    return F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
