"""Fisher's exact test as column expressions; no table of factorials and no array as long as the population.

One point probability comes from log-gamma; its neighbours follow by their ratios, as far as terms count: 12 standard
deviations and a few more. On either side of the mode probabilities fall, so what lies under the observed one is found by
bisection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Point probabilities this near to the observed one count as equal in the two-sided test.
RELATIVE = 1e-7


def lgamma_column(x: Column) -> Column:
    """log of gamma(x) for x >= 1, by Stirling's series after a shift by 8; relative error under 1e-13."""
    y = x.cast("double") + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shift = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5) + F.log(x + 6) + F.log(x + 7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def fisher(a: Column, b: Column, c: Column, d: Column, side: str = "greater") -> Column:
    """p of the table ((a, b), (c, d)) with its margins fixed; side is greater, less or two-sided (ASC-13)."""
    if side not in ("greater", "less", "two-sided"):
        raise ValueError(side)
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, col, total, rest = a + b, a + c, a + b + c + d, d - a
    one, none = F.lit(1.0), F.lit(0.0)
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  # x once, as lambdas are not searched for equal parts
    lf = lambda x: lgamma_column(x + 1)
    real = lambda x: x.cast("double")
    low, high = F.greatest(F.lit(0).cast("long"), -rest), F.least(row, col)
    fixed = lf(row) + lf(c + d) + lf(col) + lf(b + d) - lf(total)
    middle = F.least(high, F.greatest(low, F.floor(real(row + 1) * real(col + 1) / real(total + 2))))
    spread = F.sqrt(real(row) * real(c + d) * real(col) * real(b + d) / (real(total) * real(total) * F.greatest(one, real(total - 1))))
    steps = F.sequence(F.lit(0), F.ceil(12 * F.coalesce(spread, none)).cast("int") + 64)

    def body(v: Column) -> Column:
        mode = v["mode"]
        point = lambda k: let(k, lambda k: F.exp(v["fixed"] - lf(k) - lf(row - k) - lf(col - k) - lf(rest + k)))

        def tail(start: Column, up: bool) -> Column:
            """The sum of the points from start outwards; ratios become 0 at the end of the range."""

            def add(state: Column, i: Column) -> Column:
                k = state["k"]
                ratio = real(row - k) * real(col - k) / (real(k + 1) * real(rest + k + 1)) if up else real(k) * real(rest + k) / (real(row - k + 1) * real(col - k + 1))
                return F.struct((k + (1 if up else -1)).alias("k"), (state["t"] * ratio).alias("t"), (state["s"] + state["t"]).alias("s"))

            return let(start, lambda k: F.aggregate(v["steps"], F.struct(k.alias("k"), point(k).alias("t"), none.alias("s")), add, lambda state: state["s"]))

        if side == "greater":
            return F.when(a <= low, one).when(a > mode, tail(a, True)).otherwise(1 - tail(a - 1, False))
        if side == "less":
            return F.when(a >= high, one).when(a < mode, tail(a, False)).otherwise(1 - tail(a + 1, True))

        def both(most: Column) -> Column:
            def first(up: bool) -> Column:
                """The nearest to the mode, on one side, whose probability is at most that of a; one past the end if there is none."""

                def halve(state: Column, _: Column) -> Column:
                    middle = F.floor((state["near"] + state["far"]) / 2) if up else F.ceil((state["near"] + state["far"]) / 2)
                    chosen = lambda mid: let(point(mid) <= most, lambda under: F.struct(F.when(under, state["near"]).otherwise(mid).alias("near"), F.when(under, mid).otherwise(state["far"]).alias("far")))
                    return let(middle, chosen)

                return F.aggregate(F.sequence(F.lit(1), F.lit(44)), F.struct(mode.alias("near"), (high + 1 if up else low - 1).alias("far")), halve, lambda state: state["far"])

            right = let(first(True), lambda k: F.when(k <= high, tail(k, True)).otherwise(none))
            left = let(first(False), lambda k: F.when(k >= low, tail(k, False)).otherwise(none))
            return F.when(most >= point(mode), one).otherwise(right + left)

        return let(point(a) * (1 + RELATIVE), both)

    return F.greatest(none, F.least(one, let(F.struct(fixed.alias("fixed"), middle.alias("mode"), steps.alias("steps")), body)))
