"""Column expressions over log fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names, patterns and limits that decide the results.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
SEVERITY_PATTERN = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
COMPONENT_PATTERN = r"\[([A-Za-z][\w.$-]{1,80})\]"
NUMBER_PATTERN = r"(?<![\w.])[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
BLOCK_PATTERN = r"(blk_[-]?\d+)"
WHITE_SPACE = r"\s\x1c-\x1f"
TIME_PATTERN = "yyyy-MM-dd-HH.mm.ss.SSSSSS"
NUMBER_LIMIT = 1e12
COMPONENT_BINS = 32


def stripped(value: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(value.cast("string"), rf"(?U)^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def blank_to_null(value: Column) -> Column:
    return F.when(stripped(value) != "", value)


def first_nonblank(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def group_key(value: Column, pattern: str = BLOCK_PATTERN) -> Column:
    """First capture of ``pattern``, null where it does not match."""
    return F.nullif(F.regexp_extract(value, pattern, 1), F.lit(""))


def label_to_int(label: Column) -> Column:
    return F.when(label == "Anomaly", 1).when(label == "Normal", 0)


def checked_binary(value: Column) -> Column:
    """``value`` as int; the job fails on a value other than 0 and 1. Null stays null."""
    whole = value.cast("int")
    message = F.concat(F.lit("a label must be 0 or 1, not "), value.cast("string"))
    return F.when(whole.isNull() | whole.isin(0, 1), whole).otherwise(F.raise_error(message).cast("int"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of the time as written, whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz")) / F.lit(1e6)


def parse_time(text: Column, pattern: str = TIME_PATTERN) -> Column:
    """Epoch seconds from the exact pattern, else from Spark's own parse; the job fails if neither fits."""
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit(pattern)), F.try_to_timestamp(text))
    message = F.concat(F.lit("unable to parse time: "), F.coalesce(text, F.lit("null")))
    return F.when(parsed.isNotNull(), epoch_seconds(parsed)).otherwise(F.raise_error(message).cast("double"))


def event_time(columns: Sequence[str]) -> Column:
    """Numeric ``Timestamp`` when the log has it, else ``Time`` parsed."""
    if "Timestamp" in columns:
        return F.col("Timestamp").cast("double")
    return parse_time(F.col("Time"))


def time_or_index(ts: Column, position: Column) -> Column:
    """``ts`` as a number, or the row's position where it is none."""
    return F.coalesce(ts.try_cast("double"), position.cast("double"))


def event_or_message(template: Column, message: Column | None = None) -> Column:
    """The template, or the message where the template is missing, or UNKNOWN."""
    present = F.when((template != "") & (F.lower(template) != "nan"), template)
    fallback = [] if message is None else [message]
    return F.coalesce(present, *fallback, F.lit("UNKNOWN"))


def severity(level: Column, message: Column) -> Column:
    """Severity name from the level field, else from the message."""
    found = F.upper(F.coalesce(stripped(blank_to_null(level)), F.regexp_extract(message, SEVERITY_PATTERN, 1)))
    named = F.when(found == "WARNING", "WARN").when(found == "CRITICAL", "FATAL").otherwise(found)
    return F.when(named.isin(*SEVERITIES), named).otherwise("UNKNOWN")


def severity_onehot(name: Column) -> Column:
    return F.array(*[(name == level).cast("double") for level in SEVERITIES])


def component(comp: Column, subsystem: Column, message: Column) -> Column:
    """Lower-case component, ``component::subsystem`` when they differ, else a bracketed name."""
    comp, subsystem = blank_to_null(comp), blank_to_null(subsystem)
    joined = F.when(
        F.lower(comp) != F.lower(subsystem), F.concat(comp, F.lit("::"), subsystem)
    ).otherwise(comp)
    bracketed = F.nullif(F.regexp_extract(message, COMPONENT_PATTERN, 1), F.lit(""))
    name = F.coalesce(joined, subsystem, bracketed, F.lit("UNKNOWN"))
    return F.coalesce(F.nullif(F.lower(stripped(name)), F.lit("")), F.lit("UNKNOWN"))


def component_bin(comp: Column, bins: int = COMPONENT_BINS) -> Column:
    """A stable bin: the first 15 hex digits of md5 modulo ``bins``."""
    return F.pmod(F.conv(F.substring(F.md5(comp), 1, 15), 16, 10).cast("bigint"), F.lit(bins)).cast("int")


def component_onehot(comp: Column, bins: int = COMPONENT_BINS) -> Column:
    at = component_bin(comp, bins)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (i == at).cast("double"))


def finite_clipped(values: Column) -> Column:
    """Finite numbers of an array, clipped to +-1e12."""
    finite = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.transform(finite, lambda v: F.greatest(F.least(v, F.lit(NUMBER_LIMIT)), F.lit(-NUMBER_LIMIT)))


def numbers_in(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))
    return finite_clipped(F.transform(found, lambda v: v.try_cast("double")))


def numeric_params(params: Column | None, message: Column) -> Column:
    """Numbers in the parameter strings (array<string>), else in the message when there are no parameters."""
    from_message = F.coalesce(numbers_in(message), F.array().cast("array<double>"))
    if params is None:
        return from_message
    from_params = F.flatten(F.transform(params, lambda p: F.coalesce(numbers_in(p), F.array().cast("array<double>"))))
    return F.when(params.isNotNull(), from_params).otherwise(from_message)


def clean_text(message: Column) -> Column:
    """Letters and white space only, lower case, trimmed."""
    letters = F.lower(F.regexp_replace(message, rf"(?U)[^a-zA-Z{WHITE_SPACE}]", ""))
    return F.regexp_replace(letters, rf"(?U)^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def log1p_nonnegative(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def clamped_gap(ts: Column, next_ts: Column) -> Column:
    """Seconds to the next row, never negative."""
    return F.greatest(F.lit(0.0), next_ts - ts)


def finite_or(value: Column, default: float) -> Column:
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(number)


def node_label(*values: Column) -> Column:
    """The first name that is given."""
    return F.coalesce(*[v.cast("string") for v in values])


def concat_features(*blocks: Column) -> Column:
    """One vector out of several; missing blocks count as empty."""
    empty = F.array().cast("array<double>")
    return F.concat(*[F.coalesce(b.cast("array<double>"), empty) for b in blocks])


def take_dims(vector: Column, k: int) -> Column:
    return F.slice(vector, 1, k)
