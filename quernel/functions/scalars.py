"""Column expressions for sensor values, ratios, labels, bands and flags. All native, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label band, clear-label limits, dose limits.
LABEL_LOW, LABEL_HIGH, LABEL_TARGET = 8.20, 8.70, 8.45
CLEAR = {"clear_low": 8.10, "ok_low": 8.30, "ok_high": 8.60, "clear_high": 8.80}
DOSE_LOW, DOSE_HIGH = 700.0, 1300.0
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on", "pass", "passed")
LEAK_PREFIXES, LEAK_SUFFIXES = ("pred_", "p_", "target_"), ("_pred", "_target")


def finite(c: Column) -> Column:
    """Numbers as they are; NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def num(c: Column) -> Column:
    """Permissive cast to double: what isn't a number, and NaN, becomes null."""
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def strict_num(c: Column) -> Column:
    """As ``num``, and infinities become null too."""
    return finite(c.try_cast("double"))


def timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def normalise_tag(c: Column, drop_prefix: str | None = None) -> Column:
    """Upper case, separators as single underscores, none at the ends."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"[/.\- ]", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.regexp_replace(t, f"^{drop_prefix}", "") if drop_prefix else t


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where both are finite and b isn't zero, else null."""
    return finite(F.when(finite(b) != 0, finite(a) / finite(b)))


def clean_ratio(a: Column, b: Column) -> Column:
    """a / b for a >= 0 and b > 0, else null."""
    return F.when((a >= 0) & (b > 0), safe_ratio(a, b))


def label_flags(v: Column) -> dict[str, Column]:
    """0/1 flags of a label; a null label has none of them."""
    def flag(cond: Column) -> Column:
        return F.coalesce(cond.cast("int"), F.lit(0))

    low, high = flag(v < LABEL_LOW), flag(v > LABEL_HIGH)
    return {"y_ok": flag(v.between(LABEL_LOW, LABEL_HIGH)), "y_low": low, "y_high": high, "y_out_spec": F.greatest(low, high)}


def clear_label(v: Column) -> Column:
    return (
        F.when(v.between(CLEAR["ok_low"], CLEAR["ok_high"]), "clear_ok").when(v <= CLEAR["clear_low"], "clear_low")
        .when(v >= CLEAR["clear_high"], "clear_high").when(v.isNotNull(), "uncertain_boundary")
    )


def desirability(v: Column, width: float = 0.25, power: float = 2.0) -> Column:
    return 1 / (1 + F.pow(F.abs(v - LABEL_TARGET) / width, F.lit(power)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def inverse_logit(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))))


def fuse(p: Column, q: Column, alpha: float) -> Column:
    """Two probabilities mixed on the logit scale, alpha of the first."""
    return inverse_logit(alpha * logit(p) + (1 - alpha) * logit(q))


def within(c: Column, lower: Column, upper: Column) -> Column:
    """The value, or null where it is outside the limits; missing limits don't count."""
    return F.when(F.coalesce(c < lower, F.lit(False)) | F.coalesce(c > upper, F.lit(False)), None).otherwise(c)


def ordered_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Lower and upper of two bounds in either order; if one is missing, both are."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def bound_reason(c: Column, lower: Column, upper: Column, *more: tuple[Column, str]) -> Column:
    """Why a value is invalid: the names of all rules it breaks, joined by ``;``, null if none."""
    said = F.concat_ws(";", F.when(c < lower, "below_lower_bound"), F.when(c > upper, "above_upper_bound"), *[F.when(cond, name) for cond, name in more])
    return F.nullif(said, F.lit(""))


def clip(c: Column, lower: Column | float, upper: Column | float) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lower, upper))
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def band_position(v: Column, lower: Column, upper: Column) -> Column:
    """Where a value lies; the band is closed at both ends."""
    return F.when(v.isNull() | lower.isNull() | upper.isNull(), "missing").when(v < lower, "below_band").when(v > upper, "above_band").otherwise("inside_band")


def audited_position(v: Column, lower: Column, upper: Column, recommended: Column) -> Column:
    """As ``band_position``, with the reasons for a missing position told apart."""
    return F.when(~F.coalesce(recommended, F.lit(False)), "not_recommended").when(v.isNull(), "missing_current_dose").when(lower.isNull() | upper.isNull(), "missing_recommended_band").otherwise(band_position(v, lower, upper))


# The actions that later stages know.
ACTIONS = {"below_band": "increase_to_band", "above_band": "decrease_to_band", "inside_band": "hold_in_band"}
NO_ACTION = "hold_or_manual_check"


def action_hint(position: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[position], F.lit(NO_ACTION))


def action_from_band(v: Column, lower: Column, upper: Column) -> Column:
    return action_hint(band_position(v, lower, upper))


def feed(ratio: Column, flow: Column) -> Column:
    return ratio * flow


def dry_mass(flow: Column, concentration: Column) -> Column:
    return flow * concentration * 0.01


def truthy(c: Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*words), F.lit(False))


def safe_columns(columns: Sequence[str], leaks: Sequence[str] = ()) -> list[str]:
    """Columns that tell nothing of the target."""
    return [c for c in columns if c not in leaks and not c.startswith(LEAK_PREFIXES) and not c.endswith(LEAK_SUFFIXES)]


def line_matches(c: Column, line: str) -> Column:
    """Whether a text names a line: X, X followed by the word for line, or X with a dash or underscore after it."""
    t = F.upper(F.regexp_replace(c, r"\s+", ""))
    return (t == line) | t.startswith(f"{line}线") | t.startswith(f"{line}-") | t.startswith(f"{line}_")


def split_list(c: Column) -> Column:
    """Items of a list in a text, parted by the first of ``; , |`` that occurs."""
    by = F.when(c.contains(";"), ";").when(c.contains(","), ",").otherwise("\\|")
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")


def flag_set(*flags: Column) -> Column:
    """Names that aren't null, sorted, each once, joined by ``;``."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*flags), lambda x: x.isNotNull()))), ";")


BANDS = "array<struct<dose_min:double,dose_max:double>>"


def parse_bands(c: Column, lower: Column, upper: Column) -> Column:
    """Bands in a JSON text, or the one band of the scalar fallback."""
    return F.coalesce(F.from_json(c, BANDS), F.when(lower.isNotNull() & upper.isNotNull(), F.array(F.struct(lower.alias("dose_min"), upper.alias("dose_max"))).cast(BANDS)))


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of band b that band a covers."""
    return F.when(b2 > b1, F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1)) / (b2 - b1)).otherwise(0.0)


def best_overlap(a1: Column, a2: Column, bands: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(bands, lambda b: overlap_ratio(a1, a2, b["dose_min"], b["dose_max"]))), F.lit(0.0))


def band_key(lower: Column, upper: Column) -> Column:
    return F.struct(F.round(lower, 9).alias("lower"), F.round(upper, 9).alias("upper"))


def missing_names(columns: Mapping[str, Column] | Sequence[str]) -> Column:
    """Names of required columns that are null in this row."""
    cols = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    return F.filter(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in cols.items()]), lambda x: x.isNotNull())


def row_mean(*cols: Column) -> Column:
    n = row_count(*cols)
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / n)


def row_count(*cols: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def round_minute(ts: Column) -> Column:
    """The nearest minute, half to the even one."""
    us = F.unix_micros(ts.cast("timestamp"))
    minute, rest = F.floor(us / 60_000_000), us % 60_000_000
    up = (rest > 30_000_000) | ((rest == 30_000_000) & (minute % 2 == 1))
    return F.timestamp_micros((minute + up.cast("bigint")) * 60_000_000).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Seconds of a time without a zone since 1970, as double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy_MM")


def offset_name(minutes: int, variant: str) -> str:
    return f"{variant}_{'m' if minutes < 0 else 'p'}{abs(minutes)}"


def offset_of(name: str) -> tuple[str, int]:
    variant, _, at = name.rpartition("_")
    return variant, int(at[1:]) * (-1 if at[0] == "m" else 1)
