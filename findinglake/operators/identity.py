"""Identities of findings: fingerprints of each kind, scoped to a repository, and keyed digests.  All in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from findinglake.functions.columns import digest
from findinglake.operators.findings import fingerprint_code


def fingerprint() -> Column:
    """The fingerprint of a row by its source_kind; missing parts count as empty.

    SECRET: vuln_class, path, secret_hash.  DEPENDENCY: ecosystem, name without case, advisory_id or else rule_id.
    LLM_TEST: target_scope, rule_id.  Others, null included: engine, vuln_class, path, function_name, snippet.
    """
    c, kind = F.col, F.col("source_kind")
    secret = digest(F.lit("secret"), c("vuln_class"), c("path"), c("secret_hash"))
    package = digest(F.lit("dependency"), c("ecosystem"), F.lower("package_name"), F.coalesce("advisory_id", "rule_id"))
    test = digest(F.lit("llm"), c("target_scope"), c("rule_id"))
    code = fingerprint_code(c("engine"), c("vuln_class"), c("path"), c("function_name"), c("snippet"))
    return F.when(kind == "SECRET", secret).when(kind == "DEPENDENCY", package).when(kind == "LLM_TEST", test).otherwise(code)


def scoped(repository_id: Column, fingerprint_: Column) -> Column:
    """A fingerprint within a repository."""
    return digest(F.concat(F.lit("repository:"), repository_id.cast("string")), fingerprint_)


def keyed_hash(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text in hex; null stays null.  The key's two pads are constants of the plan."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    once = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, once), 256)
