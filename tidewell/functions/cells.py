"""Tolerant readers of cells, numbers, times and model payloads as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import strip


def _items(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def cell_list(cell: Column) -> Column:
    """A cell as a list: a JSON array, or text split at ';', '|' and ','; blank items and null give none."""
    text = strip(F.coalesce(cell, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    return F.when(text.startswith("[") & parsed.isNotNull(), _items(F.filter(parsed, lambda x: x.isNotNull()))).otherwise(_items(F.split(text, "[;|,]")))


def chain_list(cell: Column) -> Column:
    """A chain cell as a list: split at '|||', else at '->', else at ';'."""
    text = F.coalesce(cell, F.lit(""))
    return F.when(F.contains(text, F.lit("|||")), _items(F.split(text, "\\|\\|\\|"))).when(F.contains(text, F.lit("->")), _items(F.split(text, "->"))).otherwise(_items(F.split(text, ";")))


def number_or(cell: Column, default: float) -> Column:
    """The number of a cell, or the default."""
    return F.coalesce(cell.try_cast("double"), F.lit(default))


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def iso_time(cell: Column) -> Column:
    """An ISO time, Z included; null if it is none. Sort it descending with nulls last."""
    return strip(cell).try_cast("timestamp")


def json_object_text(raw: Column) -> Column:
    """The JSON object within free or fenced text: from the first brace to the last; null without one."""
    found = F.regexp_extract(F.regexp_replace(raw, "```(?:json)?", ""), "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def bounded_strings(values: Column, most: int, longest: int) -> Column:
    """At most `most` non-blank strings, each cut to `longest` characters."""
    return F.slice(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.left(strip(x), F.lit(longest))), lambda x: x.isNotNull() & (x != "")), 1, most)


def known_flags(values: Column, known: list[str], default: str) -> Column:
    """The known flags, each once in their order; the default alone if none is left."""
    kept = F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isin(known)))
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def answer_text(payload: Column) -> Column:
    """The text of a chat answer in any shape: choices with a message, an object with content, else the payload itself."""
    whole = F.ltrim(payload).startswith("{") & F.try_parse_json(payload).isNotNull()
    chosen, content = F.get_json_object(payload, "$.choices[0].message.content"), F.get_json_object(payload, "$.content")
    has = lambda key: F.array_contains(F.json_object_keys(payload), key)
    message = F.get_json_object(payload, "$.choices[0].message")
    return F.when(payload.isNull(), "").when(~whole, payload).when(has("choices"), F.when(message.isNull(), payload).otherwise(F.coalesce(chosen, F.lit("")))).when(has("content"), F.coalesce(content, F.lit(""))).otherwise(payload)


def now_iso() -> Column:
    """The time of the query in UTC, as ISO text; the same for all rows."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def masked(secret: Column) -> Column:
    """A secret's first and last four characters; of eight or fewer the first and last alone; '***' for null."""
    s = F.coalesce(secret, F.lit(""))
    keep = F.when(F.length(s) <= 8, 1).otherwise(4)
    return F.concat(F.left(s, keep), F.lit("***"), F.right(s, keep))
