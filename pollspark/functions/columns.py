"""Column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 2002, 2023

# Ordered (pattern, replacement) rules for survey item names.
ITEM_RULES = (
    ("concern", "worry"),
    ("worry_worry", "worry"),
    ("human_caused", "attribution"),
    ("human_cause", "attribution"),
    ("human", "attribution"),
)
# Further rules applied to microdata column names only.
COLUMN_RULES = ITEM_RULES + (
    ("happening_aware_", "aware_"),
    ("happening_aware", "aware"),
)

# Published bin edges and labels.
STD_BREAKS = (-3, -2, -1.5, -1, -0.5, 0.5, 1, 1.5, 2, 4)
STD_LABELS = ("-2", "-1.5", "-1", "-0.5", "0", "0.5", "1", "1.5", "2+")
SCL_BREAKS = (-1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1)
SCL_LABELS = (
    "0-0.1", "0.1-0.2", "0.2-0.3", "0.3-0.4", "0.4-0.5",
    "0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9-1",
)
PER_HEAD_BREAKS = (-1, 1, 2, 3, 4, 5, 10, 20, 100)
PER_HEAD_LABELS = ("0-1", "1-2", "2-3", "3-4", "4-5", "5-10", "10-20", "20+")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def biennium(year: Column | str) -> Column:
    """``2002-03`` .. ``2022-23`` for a calendar year, missing outside."""
    y = _col(year)
    start = (y - y % 2).cast("int")
    end = F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    return F.when(y.between(FIRST_YEAR, LAST_YEAR), F.concat_ws("-", start.cast("string"), end))


def five_year(year: Column | str) -> Column:
    """Alternative collapse: up to 2004, 2005-2009, 2010-2014, 2015-2021."""
    y = _col(year)
    # Last years and labels of the spans.
    return (
        F.when(y <= 2004, "1998-2004")
        .when(y <= 2009, "2005-2009")
        .when(y <= 2014, "2010-2014")
        .when(y <= 2021, "2015-2021")
    )


def cut(value: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(a, b]``; a value outside every bin is missing."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per interval")
    v = _col(value)
    bins = list(zip(breaks, breaks[1:], labels, strict=False))
    expr = None
    for low, high, label in bins:
        test = (v > float(low)) & (v <= float(high))
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr


def direction(delta: Column | str) -> Column:
    d = _col(delta)
    return F.when(d > 0, "increase").when(d < 0, "decrease").when(d == 0, "stable")


def recode(value: Column | str, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Replace listed values; others keep their value (or take ``default``)."""
    v = _col(value)
    expr = reduce(
        lambda acc, kv: F.when(v == kv[0], kv[1]) if acc is None else acc.when(v == kv[0], kv[1]),
        mapping.items(),
        None,
    )
    fallback = v if default is None else _col(default)
    return fallback if expr is None else expr.otherwise(fallback)


def param_name(variable: Column | str) -> Column:
    """``region_alpha[3,7]`` -> ``region_alpha``."""
    return F.regexp_replace(_col(variable), r"\[.+\]", "")


# Model parameters whose bracket index is decoded.
INDEXED_PARAMETERS = ("country_alpha", "region_alpha", "country_poststrat", "region_effect", "beta", "gamma")


def param_index(variable: Column | str, position: int) -> Column:
    """The ``position``-th (from 1) integer in the brackets of a decoded parameter."""
    v = _col(variable)
    inside = F.regexp_extract(v, r"\[(.+)\]$", 1)
    part = F.get(F.split(inside, ","), F.lit(position - 1))
    return F.when(param_name(v).isin(*INDEXED_PARAMETERS), part.try_cast("int"))


def rename_items(value: Column | str, rules: Sequence[tuple[str, str]] = ITEM_RULES) -> Column:
    """Apply text replacements one after the other; the order matters."""
    return reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, _col(value))


def split_label(value: Column | str, sep: str, n: int, merge: bool = True) -> list[Column]:
    """First ``n`` parts of a label. ``merge`` keeps the rest in the last part."""
    limit = n if merge else -1
    pattern = F.split(_col(value), "\\Q" + sep + "\\E", limit)
    return [F.get(pattern, F.lit(i)) for i in range(n)]


def paste(sep: str, *cols: Column | str) -> Column:
    """Join into one text; a missing part becomes the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def drop_last(value: Column | str, n: int) -> Column:
    v = _col(value)
    return F.substring(v, F.lit(1), F.greatest(F.length(v) - n, F.lit(0)))


def safe_ln(value: Column | str) -> Column:
    """Logarithm, missing for zero and negative input."""
    v = _col(value)
    return F.when(v > 0, F.ln(v))


def finite(value: Column | str) -> Column:
    """The value if it is an ordinary number, else missing."""
    v = _col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def log_sigmoid(x: Column) -> Column:
    """``log(1 / (1 + exp(-x)))`` without overflow."""
    return -F.greatest(-x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def ordered_logit(option: Column, n_thresholds: Column, eta: Column, lower: Column, upper: Column) -> Column:
    """Log probability of ``option`` in an ordered logit.

    ``lower`` and ``upper`` are the scaled cutpoints below and above the option;
    the first option has no lower and the last no upper one.
    """
    above, below = eta - lower, eta - upper
    # F(above) - F(below), with F the logistic curve and gap = upper - lower > 0.
    gap = above - below
    middle = log_sigmoid(above) + log_sigmoid(-below) + F.log1p(-F.exp(-gap))
    return (
        F.when(option == 1, log_sigmoid(-below))
        .when(option == n_thresholds + 1, log_sigmoid(above))
        .otherwise(middle)
    )


# Rational approximation of the normal quantile (Wichura 1988, AS 241).
_AS241_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_AS241_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_AS241_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(table, r: Column) -> Column:
    def poly(coefs):
        return reduce(lambda acc, c: acc * r + F.lit(c), reversed(coefs[:-1]), F.lit(coefs[-1]))

    return poly(table[0]) / poly(table[1])


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1."""
    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(tail <= 5, _ratio(_AS241_MIDDLE, tail - 1.6)).otherwise(_ratio(_AS241_TAIL, tail - 5))
    centre = q * _ratio(_AS241_CENTRE, F.lit(0.180625) - q * q)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer)
