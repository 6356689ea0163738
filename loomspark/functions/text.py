"""Scalar functions as Column expressions; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in ascending order, and the weights of their order.
SEVERITIES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SOURCES = ["eslint", "complexity", "react", "ai"]


def squash(x: Column) -> Column:
    """Trimmed, with runs of white space as one blank; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def fingerprint(source: Column, rule: Column, path: Column, line: Column, column: Column, message: Column) -> Column:
    return F.concat_ws(":", source, rule, path, F.coalesce(line.cast("string"), F.lit("")), F.coalesce(column.cast("string"), F.lit("")), squash(message))


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(F.coalesce(x, F.lit(""))) / 3).cast("long")


def severity_weight(x: Column) -> Column:
    """1 to 4; an unknown severity is an error."""
    found = F.coalesce(*[F.when(x == k, v) for k, v in SEVERITIES.items()])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(x, F.lit("null")))).cast("int"))


# The replacements that make an id, in order.
_SPACES = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
KEBAB = [("([a-z0-9])([A-Z])", "$1-$2"), ("([A-Z]+)([A-Z][a-z0-9])", "$1-$2"), (f"[_{_SPACES}.]+", "-")]


def trimmed(x: Column) -> Column:
    """Without white space of any script at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), f"^[{_SPACES}]+|[{_SPACES}]+$", "")


def kebab(x: Column) -> Column:
    """Words split at case changes, underscores, white space and dots, lower-cased and joined by hyphens; 'candidate' for an empty name."""
    y = x
    for pattern, to in KEBAB:
        y = F.regexp_replace(y, pattern, to)
    y = F.regexp_replace(F.lower(y), "^-+|-+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "candidate").otherwise(y)


def slug_rule(x: Column) -> Column:
    """A model's rule id: lower-cased, other characters as hyphens, under ai/ once."""
    y = F.regexp_replace(F.lower(x), "[^a-z0-9/-]", "-")
    rest = F.regexp_replace(F.regexp_replace(y, "^ai-?", ""), "^-+", "")
    return F.when(y.startswith("ai/"), y).otherwise(F.concat(F.lit("ai/"), F.when(rest == "", "issue").otherwise(rest)))


def prop_name(x: Column) -> Column:
    return F.regexp_replace(x, "^handle([A-Z].*)$", "on$1")


def normal_path(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\", "/"), r"^(\./|/)+", "")


def line_count(x: Column) -> Column:
    """Lines of a text; one final line end adds none, and no text has fewer than one."""
    n = F.size(F.split(x, "\r?\n", -1)) - F.when(x.endswith("\n"), 1).otherwise(0)
    return F.greatest(n, F.lit(1)).cast("long")


def hunks(diff: Column) -> Column:
    """Array of (start, end) of the new side's changed lines in a unified diff; pure deletions give none."""
    start = F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"), F.lit(1))
    count = F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"), F.lit(2))
    pairs = F.transform(F.arrays_zip(start.alias("s"), count.alias("n")), lambda h: F.struct(h["s"].cast("int").alias("start"), F.when(h["n"] == "", 1).otherwise(h["n"].cast("int")).alias("n")))
    return F.transform(F.filter(pairs, lambda h: h["n"] > 0), lambda h: F.struct(h["start"].alias("start"), (h["start"] + h["n"] - 1).alias("end")))


# What is masked, in order, and the mask.
SECRETS = ["sk-[a-zA-Z0-9_-]{20,}", "gsk_[a-zA-Z0-9_-]{20,}", r"(?i)bearer\s+[a-zA-Z0-9_\-.]+", r"(?i)key=[a-zA-Z0-9_\-.]+"]
MASK = "[REDACTED_API_KEY]"


def redact(x: Column) -> Column:
    """Keys, bearer tokens and assigned keys masked."""
    for pattern in SECRETS:
        x = F.regexp_replace(x, pattern, MASK)
    return x


def no_angles(x: Column) -> Column:
    return F.translate(x, "<>", "")


def eol(x: Column) -> Column:
    return F.when(x.contains("\r\n"), "\r\n").otherwise("\n")


def is_component(x: Column) -> Column:
    return x.rlike("^[A-Z][A-Za-z0-9_]*$")


def is_hook(x: Column) -> Column:
    return x.rlike("^use[A-Z]")


def is_constant(x: Column) -> Column:
    return x.rlike("^[A-Z_0-9]{3,}$")


# How provider errors are told apart, in order: kind, status codes, error names, words of the message.
ERRORS = [
    ("authentication", [401, 403], ["AuthenticationError", "PermissionDeniedError"], "incorrect api key|invalid api key|unauthorized|authentication"),
    ("rate-limit", [429], ["RateLimitError"], "rate limit|quota exceeded|too many requests"),
    ("timeout", [], ["APIConnectionTimeoutError", "TimeoutError"], "timed? ?out"),
    ("network", [], ["APIConnectionError"], "fetch failed|network|econnrefused|econnreset|enotfound|socket hang up"),
    ("invalid-response", [], ["ZodError", "LengthFinishReasonError", "ContentFilterFinishReasonError"], "did not match schema|invalid response|failed to parse"),
]


def error_kind(status: Column, name: Column, message: Column) -> Column:
    """The kind of a provider's error; the first of ERRORS that its status, name or message shows."""
    said = F.coalesce(message, F.lit(""))
    kinds = [F.when(F.coalesce(status.isin(codes) if codes else F.lit(False), F.lit(False)) | F.coalesce(name.isin(names), F.lit(False)) | said.rlike(f"(?i){words}"), kind) for kind, codes, names, words in ERRORS]
    return F.coalesce(*kinds, F.lit("provider-error"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars at prices for a million tokens, to six decimals; null without a price."""
    return F.round(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)
