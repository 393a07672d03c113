"""Redaction of secrets and addresses, field by field (X11, X12). Never run it over several fields at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CREDENTIAL, TOKEN, KEY = "[REDACTED:credential-shaped]", "[REDACTED:token-shaped]", "[REDACTED:key-shaped]"
#: A value in a sentence ends before these; an unquoted one needs a mark or a digit in eight letters, or twelve letters. Fixed values.
_VALUE = r"[^\s\\\"'`,;.)}\]>]"
_MARK = r"[0-9!@#$%^&*_+\-=~?/|]"
_SAID = r"(?:[ \t]+(?:is|was|set[ \t]+to|changed[ \t]+to)[ \t]+|[ \t]*(?::|=|->)[ \t]*)"
_TRIGGER = r"(?i:(?<![A-Za-z0-9_])(?:password|passwd|passphrase|passcode|pwd|pin)(?![A-Za-z0-9_]))"
#: What assigns a secret in code or configuration. Fixed value.
_NAME = r"(?i:(?<![A-Za-z0-9])[A-Za-z0-9_\-]*(?:api[_\-]?key|secret|token|access[_\-]?key|auth[_\-]?key|client[_\-]?secret|password|passwd|pwd))"
#: (pattern, what replaces it) in the order in which they are applied. Fixed values.
RULES = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", KEY),
    (r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", KEY),
    (r"(?<![A-Za-z0-9])(?:sk|pk|rk|ghp|gho|ghs|xoxb|xoxp)[-_][A-Za-z0-9_\-]{16,}", TOKEN),
    (r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,}", TOKEN),
    (r"(?i)(bearer[ \t]+)[A-Za-z0-9._~+/\-]{20,}=*", "$1" + TOKEN),
    (r"(?i)([a-z][a-z0-9+.\-]*://[^ /:@\n]*:)[^ /@\n]+(@)", "$1" + CREDENTIAL + "$2"),
    (r"(" + _TRIGGER + _SAID + r")(\"[^\"\n]{1,200}\"|'[^'\n]{1,200}')", "$1" + CREDENTIAL),
    (r"(" + _NAME + r"[ \t]*[:=][ \t]*)(?:\"[^\"\s]{8,200}\"|'[^'\s]{8,200}'|(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-+/]{16,}=*)", "$1" + TOKEN),
    (r"(" + _TRIGGER + _SAID + r")(?!\[REDACTED)(?![*_]*[a-z]+[*_]*(?!" + _VALUE + r"))(?:(?=" + _VALUE + r"{0,200}?" + _MARK + r")" + _VALUE + r"{8,}|" + _VALUE + r"{12,})", "$1" + CREDENTIAL),
    (r"(?i)((?:mysql|psql|mariadb|sshpass|smbclient|redis-cli)[^\n]{0,40}? -p[ \t]?)(?=[^ \n]{6,})[^ \n]+", "$1" + CREDENTIAL),
)
#: Mail hosts that say nothing about an organisation. Fixed values.
FREEMAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "me.com", "msn.com", "live.com", "comcast.net", "protonmail.com", "proton.me", "gmx.com")
ADDRESS = r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+\-]+@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})(?![A-Za-z0-9_])"


def redact(text: Column, known: tuple[str, ...] = (), rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """X11: secrets by shape, and the known ones literally; null stays null. rules: other shapes than RULES, applied in order."""
    out = text
    for secret in known:
        out = F.replace(out, F.lit(secret), F.lit("[REDACTED:known-credential]"))
    for pattern, mark in rules:
        out = F.regexp_replace(out, pattern, mark)
    return out


def has_secret(text: Column) -> Column:
    return ~(redact(text).eqNullSafe(text))


def scrub_addresses(text: Column, keep: tuple[str, ...] = ()) -> Column:
    """Mail addresses to [email] (free hosts) or [email@host]; those of kept hosts stay."""
    free = "|".join(d.replace(".", r"\.") for d in FREEMAIL)
    kept = "".join(rf"(?![^@ \n]+@(?:[A-Za-z0-9\-]+\.)*{d.replace('.', chr(92) + '.')}(?![A-Za-z0-9.\-]))" for d in keep)
    local = r"(?<![A-Za-z0-9_])" + kept + r"[A-Za-z0-9._%+\-]+@"
    out = F.regexp_replace(text, rf"(?i){local}(?:{free})(?![A-Za-z0-9_.\-])", "[email]")
    return F.regexp_replace(out, rf"{local}([A-Za-z0-9.\-]+\.[A-Za-z]{{2,}})(?![A-Za-z0-9_])", "[email@$1]")


def redact_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each text column by itself, arrays of texts element by element."""
    out = df
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        out = out.withColumn(c, F.transform(c, lambda s: redact(s)) if kind == "array" else redact(F.col(c)))
    return out
