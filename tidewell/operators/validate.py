"""Validation: events, requests, constraints, and the dead-letter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import normalized
from tidewell.sources.events import ENVELOPE

UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def valid_event(event_id: Column, name: Column, distinct_id: Column, properties: Column, occurred_at: Column) -> Column:
    """Whether an event may be stored. Absent properties count as an empty object."""
    short = lambda c: F.coalesce(F.char_length(c).between(1, 200), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(properties)).startswith("OBJECT"), properties.isNull())
    return F.coalesce(event_id.rlike(UUID), F.lit(False)) & short(name) & short(distinct_id) & is_object & normalized(occurred_at).isNotNull()


def valid_requests(events: DataFrame, valid: Column, request: str) -> DataFrame:
    """Per request the number of its events and whether it is accepted: one bad event rejects all."""
    return events.groupBy(request).agg(F.count("*").alias("events"), F.bool_and(valid).alias("accepted"))


#: Fixed value: events that a request may have.
MOST_EVENTS = 500


def outcomes(requests: DataFrame, known: Column, valid: Column, events: Column, *, oversized: Column | None = None, allowed: Column | None = None, retry_after_ms: Column | None = None, most: int = MOST_EVENTS) -> DataFrame:
    """Requests with the `status` that a client gets: 401 without a valid key, 422 for a bad or empty request, 413 for one
    with too many events, for one that no bucket can ever hold and for an event above a message's size, 429 while the
    bucket is too empty, else 202. The rules hold in this order."""
    never = F.lit(False) if retry_after_ms is None else F.coalesce(retry_after_ms < 0, F.lit(False))
    passes = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(True))
    big = F.lit(False) if oversized is None else F.coalesce(oversized, F.lit(False))
    status = F.when(~F.coalesce(known, F.lit(False)), 401).when(~F.coalesce(valid, F.lit(False)) | (events < 1), 422).when(events > most, 413)
    return requests.withColumn("status", status.when(~passes & never, 413).when(~passes, 429).when(big, 413).otherwise(202))


def oversized(events: DataFrame, size: Column, limit: int = 200_000) -> DataFrame:
    """Events whose JSON text and a comma are longer than a message may be."""
    return events.where(size + 1 > limit)


def violations(df: DataFrame, checks: list[str]) -> DataFrame:
    """Per check how many rows break it; a null result breaks none, as in SQL."""
    one = df.agg(*[F.count_if(F.expr(f"not ({c})")).alias(f"c{i}") for i, c in enumerate(checks)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("constraint"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(checks)])).alias("x")).select("x.*")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def check_range(start: str, end: str, limit: int = 10, *, most_days: int = 366) -> int:
    """The length of a range in days; errors as the query's callers expect them."""
    from datetime import date

    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    if days < 1:
        raise ValueError("end must not precede start")
    if days > most_days:
        raise ValueError(f"at most {most_days} days")
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")
    return days


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Message lines with their envelope as `message`; it is null where a line isn't one, so that one bad line stops no other."""
    m = F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"})
    ok = m["batch_id"].isNotNull() & m["tenant_id"].isNotNull() & m["events"].isNotNull()
    return lines.withColumn("message", F.when(ok, m))
