"""Pages that can be gone on with, by tokens that tell what they belong to, and checks of what a page has answered.

A token, with a checksum but no secret, names the last key of a page, the filter it was asked with and the version of the tables it was read from. It is refused
where any of these is no longer so, or where it was changed; so the pages of one walk are disjoint and complete, or the walk ends.
"""

from __future__ import annotations

import base64
import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import constants, text
from latticework.sources.catalog import Catalog


class Refused(ValueError):
    """A token that does not belong here, or no longer."""


def version_of(catalog: Catalog, tables: list[str]) -> str:
    """What tells the present state of some tables from any other."""
    state = json.dumps([(t, catalog.current(t)) for t in sorted(tables)])
    return hashlib.sha256(state.encode()).hexdigest()


def _sealed(body: dict) -> str:
    packed = json.dumps(body, separators=(",", ":"), sort_keys=True)
    proof = hashlib.sha256(packed.encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(f"{proof}{packed}".encode()).decode().rstrip("=")


def _opened(token: str) -> dict:
    try:
        told = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
        body = json.loads(told[16:])
    except (ValueError, UnicodeDecodeError) as e:
        raise Refused("not a token") from e
    if not isinstance(body, dict) or hashlib.sha256(told[16:].encode()).hexdigest()[:16] != told[:16]:
        raise Refused("the token was changed")
    return body


def page(rows: DataFrame, keys: list[str], asked: dict[str, Any], version: str, limit: int = constants.PAGE_DEFAULT, token: str | None = None) -> tuple[list, str | None]:
    """(rows, token): the next rows in the order of their keys, at most so many, and the token of what follows, if anything does.

    keys tell all rows apart; nulls come first. asked: what the rows were filtered by, as plain values. The page is found by its
    keys, not by an offset: rows before it are not sorted, and only a page and one row go to the driver.
    """
    if not 1 <= limit <= constants.PAGE_MOST:
        raise ValueError(f"a page has 1 to {constants.PAGE_MOST} rows")
    filter_ = hashlib.sha256(json.dumps(asked, sort_keys=True).encode()).hexdigest()
    place = lambda c: F.struct(c.isNotNull().alias("there"), c.alias("value"))
    if token is not None:
        body = _opened(token)
        if (body.get("asked"), body.get("keys")) != (filter_, keys):
            raise Refused("the token is of another question")
        if body.get("version") != version:
            raise Refused("the tables have changed since")
        after = [F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(keys, body["after"], strict=True)]
        rows = rows.filter(F.struct(*(place(F.col(k)).alias(f"_{i}") for i, k in enumerate(keys))) > F.struct(*(place(v).alias(f"_{i}") for i, v in enumerate(after))))
    found = rows.orderBy(*(F.col(k).asc_nulls_first() for k in keys)).limit(limit + 1).collect()
    if len(found) <= limit:
        return found, None
    last = [None if found[limit - 1][k] is None else str(found[limit - 1][k]) for k in keys]
    return found[:limit], _sealed({"after": last, "asked": filter_, "keys": keys, "version": version})


WORKLOAD = ["kind", "name", "container"]


def checked_follow_up(expected: DataFrame, returned: DataFrame, more: bool, previous: str | None = None) -> DataFrame:
    """One row: (status, matched, missing, fingerprint, continue_pagination) of a page that should tell of the expected workloads.

    expected, returned: (kind, name, container). complete: all are there; needs_next_page: some are missing and the page says that
    more follows; stalled: so it is, but the page is the same as the previous one, by its fingerprint; incomplete: nothing follows.
    Workloads that lack a kind or name are none; `missing` are in order, each once.
    """
    valid = lambda df: df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in WORKLOAD)).filter("kind <> '' AND name <> ''").distinct()
    want, got = valid(expected), valid(returned)
    both = want.join(got.withColumn("_there", F.lit(True)), WORKLOAD, "left")
    # A change unit's workloads: as many as one unit has.
    missing = F.sort_array(F.collect_list(F.when(F.col("_there").isNull(), F.struct(*WORKLOAD))))
    counted = both.agg(F.count("_there").alias("matched"), missing.alias("missing"))
    print_ = got.agg(text.fingerprint(F.to_json(F.sort_array(F.collect_list(F.struct(*WORKLOAD))))).alias("_print"))
    out = counted.join(print_)
    follows = F.lit(more) & (F.size("missing") > 0)
    status = F.when(F.size("missing") == 0, "complete").when(~follows, "incomplete").when(F.col("_print") == F.lit(previous), "stalled").otherwise("needs_next_page")
    out = out.withColumn("status", status)
    return out.select("status", "matched", "missing", F.when(F.col("status") == "needs_next_page", F.col("_print")).alias("fingerprint"), (F.col("status") == "needs_next_page").alias("continue_pagination"))
