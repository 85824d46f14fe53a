"""Scalar functions over text columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions import constants


def slug(name: Column) -> Column:
    """Lower-case words joined by hyphens; `service` if nothing is left."""
    out = F.lower(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(F.coalesce(F.length(out), F.lit(0)) == 0, F.lit("service")).otherwise(out)


def owner(symbol: Column) -> Column:
    """The owner of a member symbol: what stands before the first dot, after a leading `this.`."""
    return F.substring_index(F.regexp_replace(symbol, r"^this\.", ""), ".", 1)


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def query_terms(text: Column) -> Column:
    """The letters-and-digits runs of a query, in order."""
    return F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), 0)


def keywords(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct lower-case words of three letters or more, in order of first use, without stop words."""
    stop = F.array(*(F.lit(w) for w in (stop_words or constants.STOP_WORDS)))
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset, from 0."""
    return F.size(F.split(F.substr(text, F.lit(1), offset), "\n"))


def redacted(text: Column) -> Column:
    """The text with key blocks, cloud keys, assigned secrets and bearer tokens replaced, in that order."""
    for pattern, replacement in constants.REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def estimated_tokens(payload: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(payload) / 4).cast("long")


def fingerprint(payload: Column, size: int | None = None) -> Column:
    """The SHA-256 of a text, or its first bytes, in unpadded URL-safe base64."""
    digest = F.unhex(F.sha2(payload, 256))
    digest = F.substring(digest, 1, size) if size else digest
    return F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("="))


def provenance(confidence: Column) -> Column:
    return F.when(confidence.isNull(), F.lit("deterministic")).otherwise(F.lit("llm"))


def severity_rank(severity: Column) -> Column:
    """0 for critical, 1 for warning, 2 for info: an order for people, beside the lexical one."""
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms; 0 for null, empty or zero vectors. A longer vector's rest has no partner and adds nothing to the product."""
    n = F.least(F.size(a), F.size(b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))
    square = lambda v: total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))
    norms = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0) & (norms > 0), dot / norms).otherwise(F.lit(0.0))


def is_client_error(role: Column, protocol: Column, code: Column, internal_type: Column) -> Column:
    """Whether a contract raises or maps a typed error as an HTTP status of 400 to 499; a code that is no number is none."""
    return F.coalesce(role.isin("raises", "maps") & (protocol == "http") & internal_type.isNotNull() & code.try_cast("int").between(400, 499), F.lit(False))
