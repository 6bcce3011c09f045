"""Boolean retrieval over bitmaps of document ids.

The ids of a term are cut into buckets of 32,768 consecutive ones; each bucket that has
any is one bitmap of fixed width. A term that stands in every document costs a bit for
each, and a query combines a few bitmaps per bucket where postings would take rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import check_mode, query_terms

#: The places of the set bits of a byte, by its value.
_BITS = [[b for b in range(8) if v >> b & 1] for v in range(256)]


def build_bitmaps(postings: DataFrame) -> DataFrame:
    """(term, bucket, bits) of (term, document_id)."""
    marked = postings.select("term", F.bitmap_bucket_number("document_id").alias("bucket"), F.bitmap_bit_position("document_id").alias("bit"))
    return marked.groupBy("term", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def unpack(bitmaps: DataFrame, bits: str = "bits") -> DataFrame:
    """(document_id) of (bucket, bits): the places of set bits, byte by byte."""
    pairs = bitmaps.select("bucket", F.posexplode(F.regexp_extract_all(F.hex(bits), F.lit(".."), F.lit(0))).alias("byte", "pair")).where("pair <> '00'")
    table = F.array(*[F.array(*[F.lit(b) for b in row]).cast("array<int>") for row in _BITS])
    value = F.conv("pair", 16, 10).cast("int")
    rows = pairs.select("bucket", "byte", F.explode(F.get(table, value)).alias("bit"))
    # bucket 1 begins with id 1; ids from 0 down stand in buckets from 0 down
    place = F.col("byte") * 8 + F.col("bit")
    document_id = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place)
    return rows.select(document_id.cast("long").alias("document_id"))


def boolean_bitmaps(bitmaps: DataFrame, query: str, mode: str = "or") -> DataFrame:
    """The rows of boolean_query, from bitmaps: one aggregate per bucket, and for "and" only buckets that all terms have."""
    check_mode(mode)
    terms = query_terms(query)
    asked = bitmaps.where(F.col("term").isin(*terms)) if terms else bitmaps.where(F.lit(False))
    combined: Column = F.bitmap_and_agg("bits") if mode == "and" else F.bitmap_or_agg("bits")
    grouped = asked.groupBy("bucket").agg(combined.alias("bits"), F.count(F.lit(1)).alias("k"))
    return unpack(grouped.where(F.col("k") == len(terms)) if mode == "and" else grouped)


def count_matches(bitmaps: DataFrame, query: str, mode: str = "or") -> DataFrame:
    """The number of documents that match, in one row; nothing is unpacked."""
    check_mode(mode)
    terms = query_terms(query)
    asked = bitmaps.where(F.col("term").isin(*terms)) if terms else bitmaps.where(F.lit(False))
    combined: Column = F.bitmap_and_agg("bits") if mode == "and" else F.bitmap_or_agg("bits")
    grouped = asked.groupBy("bucket").agg(combined.alias("bits"), F.count(F.lit(1)).alias("k"))
    grouped = grouped.where(F.col("k") == len(terms)) if mode == "and" else grouped
    return grouped.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("total"))
