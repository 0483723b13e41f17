"""Ingest gate: which paths and contents look like credentials. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.text import entropy, glob_regex

SECRET, PRIVATE = "secret", "repo:private"
MIN_ENTROPY = 3.9

# Path shapes that hold credentials by convention.
SECRET_PATHS = (
    ".env", ".env.*", "*.env", "env.*.json", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore",
    "id_rsa*", "id_dsa*", "id_ecdsa*", "id_ed25519*", ".npmrc", ".pypirc", ".netrc", "_netrc", ".htpasswd",
    "credentials", "credentials.*", "*credentials.json", "service-account*.json", "*serviceaccount*.json",
    "*.tfstate", "*.tfstate.backup", "*.tfvars", "kubeconfig", "*.kubeconfig", "*_rsa", "*_ed25519",
    "secrets.yaml", "secrets.yml", "secrets.json", "*.secrets.*", ".aws/*", ".ssh/*", ".gnupg/*", ".docker/config.json",
)
# Content that is a credential beyond doubt.
STRONG = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\bsk-[A-Za-z0-9_\-]{20,}",
    r"\bAIza[0-9A-Za-z_\-]{30,}",
    r'"type"\s*:\s*"service_account"',
)
# An assignment of a value of 16 or more characters to a credential's name.
ASSIGNMENT = (
    r"(?i)(?:^|[^A-Za-z0-9])(?:secret|token|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)"
    r"""[ \t\f]*["']?[ \t\f]*[:=][ \t\f]*["']?([A-Za-z0-9+/=_\-]{16,})"""
)
PLACEHOLDER = r"(?i)^(?:x{4,}|y{4,}|your[_-]|my[_-]|some[_-]|dummy|sample|example|changeme|placeholder|redacted|test[_-]?only|0{6,}|1{6,})"


def path_is_secret(path: Column) -> Column:
    whole = glob_regex([*SECRET_PATHS, *(f"**/{p}" for p in SECRET_PATHS)])
    return path.rlike(whole) | F.substring_index(path, "/", -1).rlike(glob_regex(SECRET_PATHS))


def strong(content: Column) -> Column:
    return content.rlike("|".join(f"(?:{p})" for p in STRONG))


def assigned(content: Column) -> Column:
    """Values assigned to names of credentials."""
    return F.regexp_extract_all(content, F.lit(ASSIGNMENT), 1)


def random_value(value: Column, least: float = MIN_ENTROPY) -> Column:
    return ~value.rlike(PLACEHOLDER) & (entropy(value) >= least)


def content_is_secret(content: Column, least: float = MIN_ENTROPY) -> Column:
    return strong(content) | F.exists(assigned(content), lambda v: random_value(v, least))


def label(path: Column, content: Column, allow: tuple[str, ...] = (), least: float = MIN_ENTROPY) -> Column:
    """``secret`` or ``repo:private``; the whole content counts, allowed paths win."""
    secret = path_is_secret(path) | content_is_secret(content, least)
    if allow:
        secret = ~path.rlike(glob_regex(allow)) & secret
    return F.when(secret, SECRET).otherwise(PRIVATE)
