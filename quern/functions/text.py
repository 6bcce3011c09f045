"""Scalar functions over text columns: tokens, trimming, blank checks, request checks, event codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ID = 4294967295

#: Messages that callers of the search service see.
MSG_MODE = "Invalid mode: must be 'and' or 'or'"
MSG_LIMIT = "Invalid limit: must be between 1 and 100"
MSG_REQUEST = "Invalid request: empty query or limit < 1"
MSG_BLANK = "Invalid request: content must be non-empty and non-whitespace"
MSG_JSON = "Invalid JSON body"
MSG_ID = "Missing or invalid 'id' field (must be a non-negative integer)"
MSG_CONTENT = "Missing or invalid 'content' field (must be a string)"

#: An error message's category is that of the first line with a part that it contains.
CATEGORIES = (
    ("ConnectionRefused", ("Connection failed", "connection refused")),
    ("ConnectionReset", ("Connection reset", "reset by peer")),
    ("Timeout", ("timeout", "Timeout")),
    ("TransportError", ("Request failed", "Unknown error communicating")),
    ("AlreadyExists", ("already exists",)),
    ("NotFound", ("not found",)),
    ("InvalidRequest", ("Invalid request", "Missing")),
    ("ServerError", ("Server error", "Internal server error")),
)
RETRYABLE = ("ConnectionRefused", "ConnectionReset", "Timeout", "TransportError")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("shard_id", T.LongType()),
        T.StructField("source_node_id", T.LongType()),
        T.StructField("document_content", T.StringType()),
    ]
)


#: The characters outside ASCII whose lower case has ASCII letters: dotted capital I and the Kelvin sign.
ODD_CASE = "\u0130\u212a"


def tokens(content: Column) -> Column:
    """Maximal runs of ASCII letters and digits, lower-cased, in order; null gives [].

    A text is lower-cased as a whole, which is cheaper than each run; the characters that
    would turn into ASCII ones are blanked before.
    """
    text = F.coalesce(content, F.lit(""))
    odd = F.contains(text, F.lit(ODD_CASE[0])) | F.contains(text, F.lit(ODD_CASE[1]))
    lowered = F.lower(F.when(odd, F.translate(text, ODD_CASE, " " * len(ODD_CASE))).otherwise(text))
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))


def distinct_terms(content: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens(content)))


def terms_indexed(content: Column) -> Column:
    return F.size(F.array_distinct(tokens(content))).cast("long")


def trim_query(query: Column) -> Column:
    """Without spaces, tabs, line feeds and carriage returns at both ends."""
    return F.regexp_replace(query, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def blank(content: Column) -> Column:
    """Nothing but spaces, tabs, line feeds and carriage returns; null counts as blank."""
    return ~F.coalesce(content, F.lit("")).rlike(r"[^ \t\n\r]")


def request_error(query: Column, mode: Column, limit: Column) -> Column:
    """The message of the first rule that a search request breaks, or null."""
    return (
        F.when(~F.coalesce(mode, F.lit("")).isin("", "and", "or"), MSG_MODE)
        .when(limit.isNotNull() & ~limit.between(1, 100), MSG_LIMIT)
        .when(F.coalesce(trim_query(query), F.lit("")) == "", MSG_REQUEST)
    )


def json_kind(payload: Column, field: str) -> Column:
    """The type of a field of a JSON object, as BIGINT, STRING, ...; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant"))


def is_unsigned(payload: Column, field: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "bigint")
    return F.coalesce((json_kind(payload, field) == "BIGINT") & value.between(0, MAX_ID), F.lit(False))


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def ingest_error(payload: Column) -> Column:
    """Why a JSON body can't be ingested, or null."""
    return (
        F.when(F.try_parse_json(payload).isNull(), MSG_JSON)
        .when(~is_unsigned(payload, "id"), MSG_ID)
        .when(F.coalesce(json_kind(payload, "content") != "STRING", F.lit(True)), MSG_CONTENT)
    )


def failure_category(message: Column) -> Column:
    out = None
    for name, parts in CATEGORIES:
        hit = F.lit(False)
        for p in parts:
            hit = hit | message.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def encode_event(event_id, event_type, document_id, shard_id, source_node_id, content) -> Column:
    """A mutation event as JSON; null content (a removal) leaves the field out."""
    fields = zip(EVENT_SCHEMA.names, (event_id, event_type, document_id, shard_id, source_node_id, content), strict=True)
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]))


def decode_event(payload: Column) -> Column:
    """A struct of the event's fields; null fields where missing."""
    return F.from_json(payload, EVENT_SCHEMA)
