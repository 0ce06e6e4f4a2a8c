"""Column expressions shared by the operators. Missing stays null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_div(num, den) -> Column:
    """num / den where the denominator is positive, else null."""
    return F.when(col(den) > 0, col(num) / col(den))


def clamp(c, low: float, high: float) -> Column:
    """Limited to [low, high]; null stays null (least and greatest alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def weighted_mean(parts: list[tuple]) -> Column:
    """Sum of value * weight over the sum of the weights whose value is present; null if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, w in parts:
        total = total + F.coalesce(col(value) * float(w), F.lit(0.0))
        weight = weight + F.when(col(value).isNotNull(), float(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def flag(c) -> Column:
    """A condition that is false where it is null."""
    return F.coalesce(col(c), F.lit(False))


def codes(pairs: list[tuple]) -> Column:
    """Names of the conditions that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(flag(c), F.lit(n)) for c, n in pairs])))


def ladder(steps: list[tuple], otherwise=None) -> Column:
    """First matching step's value; null conditions don't match."""
    out = F.when(flag(steps[0][0]), F.lit(steps[0][1]))
    for c, v in steps[1:]:
        out = out.when(flag(c), F.lit(v))
    return out.otherwise(F.lit(otherwise))


def ramp(c, low: float, high: float) -> Column:
    """0 at ``low``, 100 at ``high``, limited to both."""
    return clamp((col(c) - float(low)) / (float(high) - float(low)) * 100.0, 0, 100)


def share_of(c, target: float) -> Column:
    return clamp(col(c) / float(target) * 100.0, 0, 100)


def money(c) -> Column:
    """Rounded to cents, halves upward."""
    return F.floor(col(c) * 100 + 0.5) / 100


def rounded(c, digits: int) -> Column:
    """A double rounded as DuckDB does it: the scaled double to a whole number, halves away from zero.

    ``F.round`` rounds the shortest decimal text of the number instead, so that 2.675 becomes 2.68 there and 2.67 here."""
    scale = 10.0**digits
    return F.round(col(c) * scale) / scale


def normalize_cik(c) -> Column:
    """Digits only, filled with zeros to ten; null if there is none."""
    digits = F.regexp_replace(col(c).cast("string"), r"\D", "")
    return F.when(digits != "", F.when(F.length(digits) < 10, F.lpad(digits, 10, "0")).otherwise(digits))


def normalize_ticker(c) -> Column:
    """Trimmed, upper case, dots as dashes; null if blank."""
    t = F.replace(F.upper(F.trim(col(c).cast("string"))), F.lit("."), F.lit("-"))
    return F.when(t != "", t)


#: Device names that can't be file names on some systems (fixed values).
RESERVED = ["CON", "PRN", "AUX", "NUL"] + [f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)]


def artifact_stem(c) -> Column:
    """A file name's stem for a ticker: other characters as dashes, reserved names escaped."""
    t = F.regexp_replace(F.upper(F.trim(col(c))), r"[^\p{L}\p{N}\-_.]", "-")
    t = F.regexp_replace(t, r"^[ .]+|[ .]+$", "")
    t = F.when(t == "", F.lit("UNKNOWN")).otherwise(t)
    return F.when(F.upper(F.substring_index(t, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), t)).otherwise(t)


def ticker_of_stem(c) -> Column:
    s = F.upper(col(c))
    bare = F.regexp_replace(s, "^_", "")
    return F.when(s.startswith("_") & F.substring_index(bare, ".", 1).isin(RESERVED), bare).otherwise(s)


#: Words that searches skip (fixed values).
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with"]
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"


def search_tokens(c) -> Column:
    """Lower-case search terms in order, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS) & (F.length(t) > 1))


def token_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(0)))


def jaccard(a, b) -> Column:
    """Overlap of two token sets; two empty sets are alike."""
    both, either = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 where either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
