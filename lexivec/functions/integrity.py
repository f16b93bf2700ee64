"""Hashes, fingerprints and scans as column expressions and small driver functions."""

from __future__ import annotations

import json
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers and patterns of the artifact and evidence scans.
NAME_MARKERS = ("api-key", "api_key", "trycloudflare.com", "/secrets/", "\\secrets\\")
SOURCE_SUFFIXES = ("py", "sh", "md", "example", "ipynb", "toml", "cfg", "yaml", "yml")
EVIDENCE_MARKERS = (*NAME_MARKERS, "ghp_", "github_pat_", "GH_TOKEN", "GITHUB_TOKEN")
BEARER = r"Authorization:\s*Bearer\s+[A-Za-z0-9\-._~+/]{8,}"
TUNNEL = r"https?://[a-z0-9][a-z0-9-]{5,}\.trycloudflare\.com\b"
CREDENTIAL = r'"username"\s*:\s*"[^"]+"\s*,\s*"key"\s*:\s*"[^"]+"'
ACCESS_TOKEN = r"ghp_|github_pat_"


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def json_hash(*columns: str) -> Column:
    """SHA-256 of the compact JSON object of the columns, keys sorted, text unescaped."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(value: object) -> str:
    """SHA-256 of a value's canonical JSON, the same in any order of keys."""
    return sha256(canonical_json(value).encode("utf-8")).hexdigest()


@F.udf(T.StringType(), useArrow=True)
def map_fingerprint(value):
    """For maps whose keys are not known before; batches travel as Arrow."""
    return None if value is None else fingerprint(value)


def model_fingerprint(files: list[Path]) -> str:
    """Over sorted files: name and size, and for JSON files their content; weights count by size."""
    parts = (f"{f.name}\0{f.stat().st_size}\0".encode() + (f.read_bytes() if f.suffix == ".json" else b"") for f in sorted({*files}))
    return sha256(b"".join(p + b"\n" for p in parts)).hexdigest()


def holds(content: Column, secret: str) -> Column:
    """Whether bytes contain a secret; an empty secret is in nothing."""
    return F.contains(content, F.lit(secret.encode("utf-8"))) if secret else F.lit(False)


def _findings(files: DataFrame, checks: list[tuple[Column, str, str]]) -> DataFrame:
    found = F.array(*[F.when(ok, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))) for ok, kind, reason in checks])
    return (
        files.select("member", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
        .select("member", "f.kind", "f.reason")
        .distinct()
    )


def scan_members(files: DataFrame) -> DataFrame:
    """``member, kind, reason`` of archive members with secrets or caches; ``files``: member, text.

    Sources are checked by name alone; their text may mention what is looked for.
    """
    name, body = F.col("member"), F.coalesce("text", F.lit(""))
    source = F.lower(name).rlike(r"\.(" + "|".join(SOURCE_SUFFIXES) + ")$")
    checks = [(name.contains(m), "secret", m) for m in NAME_MARKERS]
    checks.append((name.rlike(r"\.pytest_cache|__pycache__|\.pyc"), "cache", "cache member"))
    checks.append((~source & body.rlike(BEARER), "secret", "Authorization: Bearer"))
    checks.append((~source & body.rlike(TUNNEL), "secret", "trycloudflare.com"))
    return _findings(files, checks)


def scan_evidence(files: DataFrame) -> DataFrame:
    """``member, kind, reason`` of evidence files; the checksum list itself is not scanned."""
    name, body = F.col("member"), F.coalesce("text", F.lit(""))
    checks = [(name.contains(m), "secret", "name-marker") for m in EVIDENCE_MARKERS]
    checks += [
        (body.rlike(BEARER), "secret", "bearer content"),
        (body.rlike(TUNNEL), "secret", "tunnel content"),
        (body.rlike(ACCESS_TOKEN), "secret", "access token pattern"),
        (body.rlike(CREDENTIAL), "secret", "credential JSON"),
    ]
    return _findings(files.where(~name.rlike(r"(^|/)SHA256SUMS\z")), checks)


def allowed(settings: Column, names: tuple[str, ...]) -> Column:
    """The entries of a settings map that may be published, in the order of their names."""
    kept = F.map_filter(settings, lambda k, v: k.isin(*names))
    return F.map_from_entries(F.array_sort(F.map_entries(kept)))
