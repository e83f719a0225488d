"""Exact order statistics and quantiles of whole columns, several at once, without ordering a column anywhere.

Selection by brackets: a sketch proposes two values around each wanted rank,
a counting pass says how many rows lie below and up to them, and only the rows
between them are looked at in the next round. A value is the answer when the
counts prove it. All columns and ranks share each pass; every pass is one
map-side combined aggregation of one row, and a round shrinks the rows between
the ends by a factor of about a thousand.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY  # ranks that a proposal keeps off the wanted one, as a share of the rows between the ends; beyond the sketch's error


def order_statistics(df: DataFrame, wanted: dict[str, set[int]], sizes: dict[str, int]) -> dict[tuple[str, int], float]:
    """The values of these ranks (0 is the smallest) of each column's non-null values; `df` is read twice per round and should be stored.

    `sizes` has the number of non-null values of each column.
    """
    open_ = {(c, r): (None, None, 0, sizes[c]) for c, ranks in wanted.items() for r in ranks}  # lowest, highest value, rows below, rows up to
    found: dict[tuple[str, int], float] = {}
    while open_:
        inside = {}
        for (c, _), (lo, hi, *_) in open_.items():
            v = F.col(c)
            inside[c, lo, hi] = v if lo is None else F.when((v >= lo) & (v <= hi), v)
        asked = []
        for n, ((c, r), (lo, hi, below, upto)) in enumerate(open_.items()):
            m = upto - below
            shares = [min(1.0, max(0.0, (r - below + 0.5) / m + e)) for e in (-MARGIN, MARGIN)]
            asked.append(F.percentile_approx(inside[c, lo, hi], shares, ACCURACY).alias(f"p{n}"))
        proposed = df.agg(*asked).first()
        counts = []
        for n, (c, _) in enumerate(open_):
            for k, end in enumerate(proposed[n]):
                counts += [F.count(F.when(F.col(c) < end, 1)).alias(f"b{n}_{k}"), F.count(F.when(F.col(c) <= end, 1)).alias(f"u{n}_{k}")]
        counted = df.agg(*counts).first()
        rest = {}
        for n, (key, (lo, hi, below, upto)) in enumerate(open_.items()):
            rank = key[1]
            for k, end in enumerate(proposed[n]):
                b, u = counted[f"b{n}_{k}"], counted[f"u{n}_{k}"]
                if b <= rank < u:
                    found[key] = end
                elif u <= rank and u > below:
                    lo, below = math.nextafter(end, math.inf), u
                elif b > rank and b < upto:
                    hi, upto = math.nextafter(end, -math.inf), b
            if key not in found:
                if not below <= rank < upto:
                    raise AssertionError(f"rank {rank} of {key[0]} is not between the ends")
                lo, hi = -math.inf if lo is None else lo, math.inf if hi is None else hi
                rest[key] = (lo, hi, below, upto)
        open_ = rest
    return found


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Linearly interpolated quantiles: name -> value, from name -> (column, share). None where a column has no value.

    Nulls and values that are no numbers do not count. The columns are stored once and read twice per round;
    the number of rounds grows with the logarithm of the number of rows to the base of about a thousand.
    """
    columns = sorted({c for c, _ in wanted.values()})
    rows = stage(df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns)), "quantiles")
    sizes = rows.agg(*(F.count(c).alias(c) for c in columns)).first().asDict()
    position = {name: (sizes[c] - 1) * p for name, (c, p) in wanted.items() if sizes[c]}
    ranks: dict[str, set[int]] = {}
    for name, x in position.items():
        ranks.setdefault(wanted[name][0], set()).update({math.floor(x), min(math.floor(x) + 1, sizes[wanted[name][0]] - 1)})
    values = order_statistics(rows, ranks, sizes)
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for name, x in position.items():
        c, low = wanted[name][0], math.floor(x)
        a, b = values[c, low], values[c, min(low + 1, sizes[c] - 1)]
        out[name] = a if x == low else a + (b - a) * (x - low)
    return out


def exact_quantile(df: DataFrame, value: str, p: float) -> float | None:
    """One quantile, see exact_quantiles."""
    return exact_quantiles(df, {"q": (value, p)})["q"]
