"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "with")

# Short forms of words in column names.
ABBREVIATIONS = {
    "amt": "amount",
    "qty": "quantity",
    "cust": "customer",
    "prod": "product",
    "num": "number",
    "ts": "timestamp",
    "dt": "date",
    "desc": "description",
    "cat": "category",
    "addr": "address",
    "pmt": "payment",
    "txn": "transaction",
    "avg": "average",
    "tot": "total",
    "pct": "percent",
    "percentage": "percent",
    "promo": "promotion",
    "rev": "revenue",
}

# What a search token is made of.
IDENTIFIER, PART = r"[a-z0-9_]+(?:\.[a-z0-9_]+)*", "[a-z0-9]+"


def search_tokens(text: Column) -> Column:
    """Alphanumeric parts without stop words; of an identifier with several parts also its underscored segments, and the whole if dotted."""

    def of(ident: Column) -> Column:
        parts = F.regexp_extract_all(ident, F.lit(PART), F.lit(0))
        plain = F.filter(parts, lambda p: ~p.isin(*STOP))
        segments = F.filter(F.split(ident, r"\."), lambda s: s.contains("_"))
        whole = F.when(ident.contains("."), F.array(ident)).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(parts) > 1, F.concat(plain, segments, whole)).otherwise(plain)

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(IDENTIFIER), F.lit(0)), of))


def name_tokens(text: Column) -> Column:
    """Lower-case tokens of a name: split at non-alphanumerics and before capitals."""
    spaced = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda t: t != "")


def singular(token: Column) -> Column:
    plural = (F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss")
    return F.when(plural, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def rewritten(token: Column) -> Column:
    """A token without its plural ending, then in full where it is a known short form."""
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    one = singular(token)
    return F.coalesce(known[one], one)


def content_id(prefix: str, *parts: Column) -> Column:
    """A short id of content: the prefix and eight hex digits of the SHA-1 of its parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8))


def hash_fraction(salt: str, value: Column) -> Column:
    """A fraction in [0, 1) that depends on the value alone: for splits that don't change."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), value), 256), 1, 8), 16, 10).cast("double") / 2.0**32


def contains_word(text: Column, word: str) -> Column:
    import re

    return text.rlike(rf"(?i)(?<!\w){re.escape(word)}(?!\w)")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3)


def without_one(text: Column) -> Column:
    """A text and all texts that it becomes without one character: two texts one edit apart have one of these in common."""
    at = F.sequence(F.lit(0), F.length(text))
    return F.array_distinct(F.transform(at, lambda i: F.when(i == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))))
