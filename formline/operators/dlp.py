"""Sensitive data in records: names, secrets, cards, entropy, and redaction."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strictjson import Array, Limits, Number, Rejected, parse
from ..session import ship

# Parts of names whose fields are masked whole.
SENSITIVE = (
    "password", "passwd", "passphrase", "apikey", "apitoken", "accesstoken", "refreshtoken", "idtoken", "clientsecret", "privatekey", "signingkey", "encryptionkey", "secretkey",
    "connectionstring", "webhooksecret", "sessionid", "sessiontoken", "setcookie", "cookie", "credential", "mnemonic", "recoverycode", "passport", "taxid", "bankaccount",
    "routingnumber", "sortcode", "cvv", "iban", "pesel", "ssn", "oauthtoken", "bearertoken", "authtoken", "pwd", "secret",
)

# Patterns of secrets and of e-mail addresses.
SECRETS = [
    r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}",
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    r"\bssh-(rsa|ed25519|dss|ecdsa)\s+[A-Za-z0-9+/]{20,}",
    r"(?i)\b(bearer|basic)\s+[A-Za-z0-9+/._~=-]{8,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\b(sk|pk|rk)_(live|test)_[A-Za-z0-9]{16,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@",
]
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}")
#: A maximal run of digits with single spaces or dashes between them.
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")


def sensitive_name(name: Column) -> Column:
    """ASCII names: letters and digits alone, lower-cased, hold a sensitive part."""
    bare = F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")
    return bare.rlike("|".join(SENSITIVE))


def secret(text: Column) -> Column:
    """Whether a text has a secret that a pattern alone tells."""
    out = F.lit(False)
    for p in SECRETS:
        out = out | text.rlike(p)
    return out


def pattern_class(text: Column) -> Column:
    return F.when(secret(text), "secret").when(text.rlike(EMAIL), "pii")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check, in SQL functions."""
    each = F.reverse(F.transform(F.split(digits, ""), lambda c: c.try_cast("int")))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_SECRETS = [re.compile(p) for p in SECRETS]
_EMAIL = re.compile(EMAIL)


def scalar_class(text: str) -> str | None:
    """secret, pii or None: patterns, blobs of high entropy, payment cards, then addresses."""
    if any(p.search(text) for p in _SECRETS):
        return "secret"
    if any(entropy(m[0]) >= 2.5 for m in _HEX.finditer(text)) or any(entropy(m[0]) >= 3.5 for m in _BASE64.finditer(text)):
        return "secret"
    if any(13 <= len(d) <= 19 and _luhn(d) for d in (re.sub(r"[ -]", "", m[0]) for m in _DIGITS.finditer(text))):
        return "secret"
    return "pii" if _EMAIL.search(text) else None


def _name(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", name).lower() if c.isalnum())


MAX_DEPTH, MAX_FINDINGS = 32, 40


def redact(node: object, depth: int = MAX_DEPTH, findings: int = MAX_FINDINGS) -> tuple[object, Counter, bool]:
    """(document, counts, whether it must be dropped) of a strictly parsed document.

    Fields with sensitive names keep the name and lose the whole value; keys that are themselves sensitive get a number;
    numbers are looked at as text, and only secrets among them masked.
    """
    counts: Counter = Counter()
    deep = False

    def mask(kind: str) -> str:
        counts[kind] += 1
        return f"[REDACTED_{kind.upper()}]"

    def walk(x: object, d: int) -> object:
        nonlocal deep
        if d > depth:
            deep = True
            return None
        if isinstance(x, dict):
            out = {}
            for k, v in x.items():
                if any(s in _name(k) for s in SENSITIVE):
                    out[k] = mask("field")
                    continue
                if scalar_class(k):
                    counts["key"] += 1
                    k = f"[REDACTED_KEY_{counts['key']}]"
                out[k] = walk(v, d + 1)
            return out
        if isinstance(x, list):
            return [walk(v, d + 1) for v in x]
        if isinstance(x, str):
            kind = scalar_class(x)
            return mask(kind) if kind == "secret" or kind and not isinstance(x, Number) else x
        return x

    out = walk(node, 0)
    return out, counts, deep or sum(counts.values()) > findings


def written(node: object) -> str:
    """JSON of a parsed document, its numbers as they came."""
    if isinstance(node, Number):
        return str(node)
    if isinstance(node, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v)}" for k, v in node.items()) + "}"
    if isinstance(node, list):
        return "[" + ",".join(map(written, node)) + "]"
    return json.dumps(node, ensure_ascii=False)


def truncated(node: object) -> bool:
    """Whether an array of the document lost elements to a limit."""
    if isinstance(node, dict):
        return any(map(truncated, node.values()))
    return isinstance(node, list) and (isinstance(node, Array) and node.truncated or any(map(truncated, node)))


def redacted(column: Column, limits: Limits = Limits()) -> Column:
    """JSON text as struct of document, findings and dropped; what does not parse strictly and whole is dropped."""

    @F.pandas_udf("struct<document string, findings long, dropped boolean>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                node = None if v is None else parse(v.encode() if isinstance(v, str) else bytes(v), limits)
            except Rejected:
                v = None
            if v is None or truncated(node):
                rows.append((None, 0, True))
                continue
            doc, counts, drop = redact(node)
            rows.append((None if drop else written(doc), sum(counts.values()), drop))
        return pd.DataFrame(rows, columns=["document", "findings", "dropped"])

    return run(column)


MAX_SAMPLE_IN, MAX_SAMPLE_OUT = 64 << 10, 8 << 10


def samples(records: DataFrame, allowed: list[str], value: str = "value") -> DataFrame:
    """Redacted samples of records of the allowed sources, none by default: (all other columns, document); what is too large before or after, or must be dropped, is left out."""
    ship(records.sparkSession)
    fit = records.where(F.col("source").isin(*allowed) & (F.octet_length(value) <= MAX_SAMPLE_IN)) if allowed else records.limit(0)
    done = fit.withColumn("__r", redacted(F.col(value)))
    return done.where(~F.col("__r.dropped") & (F.octet_length("__r.document") <= MAX_SAMPLE_OUT)).select(*[c for c in records.columns if c != value], F.col("__r.document").alias("document"))
