"""Text expressions: normalisation, tokens, item and query texts, hash buckets, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet and the pattern of remote services.
TOKEN = "[a-zа-я0-9]+"
REMOTE = "онлайн|удален|удалён|дистанц|по всей росси|по всей стране|по россии|любой город|любом городе|доставк|отправк|почтой|сдэк|cdek|zoom|skype|телеграм|whatsapp"


def norm(s: Column) -> Column:
    return F.replace(F.lower(s), F.lit("ё"), F.lit("е"))


def tokens(s: Column) -> Column:
    """Runs of the token alphabet, repeats and order kept; all else parts words."""
    return F.regexp_extract_all(norm(s), F.lit(f"({TOKEN})"), F.lit(1))


def item_text(title: Column, params: Column, description: Column) -> Column:
    """White space as RE2 and DuckDB's trim have it: no vertical tab in a run, all space separators at the ends."""
    body = F.regexp_replace(F.regexp_replace(description, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")
    return F.concat(title, F.lit(". "), params, F.lit(". "), F.left(body, F.lit(300)))


def query_text(query: Column, filters: Column) -> Column:
    return F.when(filters == "", query).otherwise(F.concat(query, F.lit(" | "), filters))


def pseudo_query(title: Column) -> Column:
    """First six tokens of a title; null if shorter than three characters."""
    q = F.array_join(F.slice(tokens(title), 1, 6), " ")
    return F.when(F.length(q) >= 3, q)


def without_title(text: Column, title: Column) -> Column:
    return F.when(F.startswith(text, title), F.substring(text, F.length(title) + 3, F.length(text))).otherwise(text)


def price(x: Column) -> Column:
    """log1p of one more than the price; null counts as -1 and negatives as 0."""
    return F.log1p(F.when(x.isNull(), F.lit(-1.0)).otherwise(F.greatest(x, F.lit(0.0))) + 1)


def hash_bucket(hex_id: Column, buckets: int = 1000) -> Column:
    """The last six hex digits, modulo buckets."""
    return F.conv(F.right(hex_id, F.lit(6)), 16, 10).cast("long") % buckets


def distance(lat: Column, lon: Column, lat_c: Column, lon_c: Column) -> Column:
    """Equirectangular, in degrees."""
    return F.sqrt(F.pow(lat - lat_c, F.lit(2)) + F.pow((lon - lon_c) * F.cos(F.radians(lat_c)), F.lit(2)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
