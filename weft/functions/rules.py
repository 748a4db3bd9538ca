"""Decision rules as column expressions: comparisons, bands, buckets, repairs of readings, dates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and letters that readers take for each other, and what they stand for among digits.
LOOKALIKES, DIGITS = "OoIlSBZ", "0011582"


def tri_state(a: Column, b: Column, tolerance: Column | float = 0) -> Column:
    """`?` if either side is null, `=` within the tolerance, else `!`."""
    return F.when(a.isNull() | b.isNull(), "?").when(F.abs(a - b) <= tolerance, "=").otherwise("!")


def mixed_tolerance(a: Column, absolute: float, relative: float) -> Column:
    """The wider of an absolute tolerance and a rounded share of a."""
    return F.greatest(F.lit(float(absolute)), F.round(F.abs(a) * relative))


def nearest_of(x: Column, values: list[float]) -> Column:
    """The nearest of the values, the smaller one on ties; null stays null."""
    costs = F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(v).alias("v")) for v in values])
    return F.when(x.isNotNull(), F.array_min(costs)["v"])


def demoted(status: Column, confidence: Column, score: Column, bands: list[tuple[float, float, str | None]]) -> list[Column]:
    """Status and confidence after caps: the first band (upper score, cap, status or None) above the score applies."""
    new_status, cap = status, F.lit(1.0)
    for below, limit, named in reversed(bands):
        cap = F.when(score < below, F.lit(limit)).otherwise(cap)
        new_status = F.when(score < below, F.lit(named) if named else status).otherwise(new_status)
    return [new_status.alias("status"), F.least(confidence, cap).alias("confidence")]


def rubric(error: Column, best: float, worst: float, points: float) -> Column:
    """Full points up to `best`, none from `worst` on, linear between; null without an error."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(points)), points * (worst - error) / (worst - best)))


def first_of(*outcomes: tuple[Column, str], other: str) -> Column:
    """The name of the first outcome that holds; null conditions don't hold."""
    out = F.lit(other)
    for holds, name in reversed(outcomes):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def by_pattern(text: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """The class of the first pattern found in the text; null text has the class `other`."""
    return first_of(*[(text.rlike(p), name) for p, name in patterns], other=other)


def previous_window(start: Column, month: int, day: int) -> Column:
    """Whether a date lies before the given day of its year."""
    return F.month(start) * 100 + F.dayofmonth(start) < month * 100 + day


def is_identifier(name: Column) -> Column:
    return name.rlike(r"(?i)(^|_)(id|name|phone|code)$|key$")


def window_share(start: Column, end: Column, cut: Column) -> Column:
    """Share of the days of [start, end) before cut, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(cut, start) / F.datediff(end, start)))


def zoned(text: Column) -> Column:
    """A timestamp of an ISO text with a zone; null for texts without one."""
    zone = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$")
    return F.when(zone, F.try_to_timestamp(text))


def repaired_digits(text: Column) -> Column:
    """Look-alike letters beside a digit become digits."""
    chars = F.split(text, "")
    return F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                F.coalesce(F.get(chars, i + 1), F.lit("")).rlike("[0-9]") | ((i > 0) & F.coalesce(F.get(chars, F.greatest(i - 1, F.lit(0))), F.lit("")).rlike("[0-9]")),
                F.translate(c, LOOKALIKES, DIGITS),
            ).otherwise(c),
        ),
        "",
    )


def grid_number(label: Column) -> Column:
    """Number of a grid label: A is 1, AA is 27, B.1 is 2.1, 12 is 12; null for other texts."""
    letters = F.regexp_extract(label, r"^([A-Z]+)(?:\.(\d))?$", 1)
    part = F.regexp_extract(label, r"^([A-Z]+)(?:\.(\d))?$", 2)
    value = F.aggregate(F.split(letters, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(t * 26 + F.ascii(c) - 64))
    tenth = F.when(part == "", 0.0).otherwise(F.try_divide(part.try_cast("double"), F.lit(10.0)))
    return F.when(letters != "", value + tenth).otherwise(label.try_cast("double"))


def french_number(x: Column, digits: int) -> Column:
    """Spaces between thousands and a decimal comma."""
    return F.translate(F.format_number(x, digits), ",.", " ,")


def saturation(level: Column, rate: Column) -> Column:
    """1 - exp(-rate * level)."""
    return -F.expm1(-rate * level)


def saturation_rate(share: Column, level: Column) -> Column:
    """The rate at which `level` gives `share`; null outside 0 < share < 1 and level > 0."""
    return F.when((share > 0) & (share < 1) & (level > 0), -F.log1p(-share) / level)


def extent(points: Column, angle: float) -> Column:
    """Width of an array of structs x, y along a direction in radians."""
    along = F.transform(points, lambda p: p["x"] * F.cos(F.lit(angle)) + p["y"] * F.sin(F.lit(angle)))
    return F.array_max(along) - F.array_min(along)


def seen_from(points: Column, distance: float, height: float) -> Column:
    """Points at a height above the plane, moved to where they are in the plane: scaled about their centre."""
    scale = (distance - height) / distance
    mean = lambda c: F.aggregate(points[c], F.lit(0.0), lambda t, v: t + v) / F.size(points)
    x, y = mean("x"), mean("y")
    return F.transform(points, lambda p: F.struct((x + (p["x"] - x) * scale).alias("x"), (y + (p["y"] - y) * scale).alias("y")))


def severity(attribute: Column, delta: Column, order: dict[tuple[str, int], str], other: str) -> Column:
    """The level named for an attribute and the sign of a difference."""
    out = F.lit(other)
    for (name, sign), level in order.items():
        out = F.when((attribute == name) & (F.signum(delta) == sign), level).otherwise(out)
    return out


def combined_confidence(parts: list[Column], factor: Column, low: float = 0.05, high: float = 0.99) -> Column:
    """Least confidence times a factor, between low and high, two digits."""
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.least(*parts) * factor)), 2)


def least_subset(values: Column, target: Column) -> Column:
    """The positions (bit mask) of the smallest set of an array's values with the target as sum; null without one.

    For short arrays: all 2**n sets are looked at, the smallest first, ties to the lowest mask.
    """
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(values)).cast("int") - 1)
    total = lambda m: F.aggregate(
        F.transform(values, lambda v, i: F.when(F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1, v).otherwise(0.0)),
        F.lit(0.0), lambda t, v: t + v,
    )
    fits = F.filter(masks, lambda m: total(m) == target)
    return F.array_min(F.transform(fits, lambda m: F.struct(F.bit_count(m).alias("n"), m.alias("mask"))))["mask"]
