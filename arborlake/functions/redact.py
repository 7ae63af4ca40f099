"""Masking of secrets and personal data by tagged, non-overlapping spans.

Spans of all rules are sorted by start and then length, and kept greedily; that
sweep is sequential within a text, so it is one Arrow-batched function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules by name.
SECRETS = (
    ("aws_access_key_id", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\b(?:gh[pousr]_[A-Za-z0-9_]{36,}|github_pat_[A-Za-z0-9_]{82})\b"),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b"),
    ("private_key_block", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("bearer_token", r"(?i)\bbearer\s+[A-Za-z0-9\-._~+/]+=*"),
    ("api_key_assignment", r"""(?i)\b(?:api_key|apikey|secret_key|client_secret)\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"]"""),
)
PERSONAL = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("us_phone", r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"),
    ("credit_card", r"\b(?:[0-9][ -]?){13,16}\b"),
)
_RULES = [("secret", n, re.compile(p)) for n, p in SECRETS] + [("pii", n, re.compile(p)) for n, p in PERSONAL]


def card_ok(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return 13 <= len(digits) <= 16 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def redact_text(text: str | None) -> tuple[str | None, int]:
    """(text with tags in place of spans, number of spans)."""
    if not text:
        return text, 0
    spans = [(m.start(), -m.end(), kind, name) for kind, name, p in _RULES for m in p.finditer(text) if name != "credit_card" or card_ok(m.group())]
    out, at, n = [], 0, 0
    for s, neg, kind, name in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[REDACTED:{kind}:{name}]"]
            at, n = -neg, n + 1
    return "".join(out) + text[at:], n


def redact(df: DataFrame, col: str = "text") -> DataFrame:
    """df with the column masked and redactions, the number of spans."""

    @F.pandas_udf("struct<text:string,n:int>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact_text(x) for x in s], columns=["text", "n"])

    x = df.withColumn("_r", run(F.col(col)))
    return x.withColumn(col, F.col("_r.text")).withColumn("redactions", F.coalesce("_r.n", F.lit(0))).drop("_r")


def hidden_command(command: Column) -> Column:
    """A command with its program and a known subcommand, arguments hidden."""
    parts = F.split(F.trim(command), r"\s+")
    prog = F.regexp_replace(F.lower(F.element_at(F.split(parts[0], r"[/\\]"), -1)), r"\.(?:exe|cmd|bat)$", "")
    sub = F.lower(F.get(parts, F.lit(1)))
    known = F.lit(False)
    for p, subs in SAFE_SUBCOMMANDS.items():
        known = known | ((prog == p) & sub.isin(*subs.split()))
    hidden = F.lit(" [args redacted]")
    return (
        F.when(F.trim(command) == "", F.lit(""))
        .when(F.size(parts) == 1, parts[0])
        .when(F.coalesce(known, F.lit(False)), F.concat(parts[0], F.lit(" "), parts[1], F.when(F.size(parts) > 2, hidden).otherwise(F.lit(""))))
        .otherwise(F.concat(parts[0], hidden))
    )


#: Subcommands that tell nothing about arguments.
SAFE_SUBCOMMANDS = {
    "git": "status diff log branch show commit push pull fetch checkout", "uv": "sync lock pip run add remove", "npm": "test run build install", "pnpm": "test run build install",
    "yarn": "test run build install", "cargo": "build test check clippy run", "docker": "build run ps images", "ruff": "check format",
}
