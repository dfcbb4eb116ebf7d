"""Column functions of the event model: JSON fields, days, hashes and composite keys. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(properties: Column, field: str) -> Column:
    """A field of a JSON object if it is a JSON string, else null: numbers, booleans, nulls and absent fields don't count."""
    v = F.variant_get(F.try_parse_json(properties), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(F.try_parse_json(properties), f"$.{field}", "string"))


def utc_day(at: Column) -> Column:
    return F.to_date(at)


def normalized(at: Column) -> Column:
    """An ISO-8601 text as a timestamp; without an offset it is UTC (the session's zone). Null if it can't be read."""
    return F.try_to_timestamp(at)


def url_part(text: Column) -> Column:
    """A text percent-encoded as a part of a URL: all but letters, digits and - . _ ~ as the hex digits of its UTF-8 bytes."""
    form = F.url_encode(text)  # of forms, which write some characters otherwise
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def hex64(item: Column) -> Column:
    """The first 64 bits of an md5 as 16 hex digits, which sort as the unsigned number."""
    return F.substring(F.md5(item.cast("binary")), 1, 16)


def unsigned32(hex8: Column) -> Column:
    return F.conv(hex8, 16, 10).cast("bigint")


def write_shard(event_id: Column, shards: int = 8) -> Column:
    """The first 32 bits of an md5, modulo the number of write shards."""
    return unsigned32(F.substring(F.md5(event_id.cast("binary")), 1, 8)) % shards


def item_key(tenant: Column, day: Column, shard: Column) -> Column:
    return F.concat_ws("#", tenant, day.cast("string"), shard.cast("string"))


def instant_text(at: Column) -> Column:
    """A fixed-width text of an instant, so that texts sort as the instants do."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def bits64(item: Column) -> Column:
    return F.lpad(F.conv(hex64(item), 16, 2), 64, "0")


def hll_index(item: Column, p: int) -> Column:
    """The register of an item: the first p bits of its hash."""
    return F.conv(F.substring(bits64(item), 1, p), 2, 10).cast("int")


def hll_rank(item: Column, p: int) -> Column:
    """The place of the first 1 among the other bits, one past them if there is none."""
    at = F.instr(F.substring(bits64(item), p + 1, 64 - p), "1")
    return F.when(at == 0, 64 - p + 1).otherwise(at).cast("int")


def cms_column(item: Column, row: Column, width: int) -> Column:
    """The column of an item's cell in a row, by double hashing with an odd step."""
    h = F.md5(item.cast("binary"))
    one, two = unsigned32(F.substring(h, 1, 8)), unsigned32(F.substring(h, 9, 8)).bitwiseOR(F.lit(1).cast("bigint"))
    return (one + row * two) % width
