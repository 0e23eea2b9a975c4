"""Text rules: search predicates, masking, assembled keys, validation."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from .fixed_values import (ANONYMOUS_NAME, DEFAULT_PROVIDER, INQUIRY_CODES,
                           LOGIN_ID_PATTERN)

# The white space that the web's trim() removes.
WHITE_SPACE = ("\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units, the unit of the shop's length limits."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("bigint")


def is_blank(col: Column) -> Column:
    return F.coalesce(trimmed(col), F.lit("")) == ""


def contains_literal(col: Column, text: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` have no meaning; null is no match."""
    return F.coalesce(F.contains(F.lower(col), F.lit(text.lower())), F.lit(False))


def contains_wild(col: Column, text: str) -> Column:
    """Case-insensitive substring in which ``%`` and ``_`` act as wildcards."""
    return F.coalesce(col.ilike(f"%{text}%"), F.lit(False))


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def label_of(code: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Look a code up in a small fixed table; unknown codes fall back to themselves."""
    table = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    return F.coalesce(F.element_at(table, code), code if default is None else default)


def masked_name(name: Column) -> Column:
    """First character and up to three stars; one-character names get three."""
    known = F.coalesce(F.nullif(name, F.lit("")), F.lit(ANONYMOUS_NAME))
    stars = F.least(F.length(known) - 1, F.lit(3))
    return F.when(F.length(known) > 1, F.concat(F.substring(known, 1, 1), F.repeat(F.lit("*"), stars))) \
        .otherwise(F.concat(known, F.lit("***")))


def is_login_id(col: Column) -> Column:
    return col.rlike(LOGIN_ID_PATTERN)


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def email_address(name: Column, domain: Column) -> Column:
    """``name@domain``, or empty text when either part is blank."""
    return F.when(is_blank(name) | is_blank(domain), F.lit("")) \
        .otherwise(F.concat_ws("@", trimmed(name), trimmed(domain)))


def phone_number(*parts: Column) -> Column:
    """Parts joined by ``-``, or empty text when any part is blank."""
    return F.when(any_of([is_blank(p) for p in parts]), F.lit("")) \
        .otherwise(F.concat_ws("-", *[trimmed(p) for p in parts]))


def fallback_email(provider: Column, provider_id: Column, domain: str = "shop.invalid") -> Column:
    return F.concat(provider, F.lit("_"), provider_id, F.lit("@" + domain))


def inquiry_code(choice: Column) -> Column:
    return label_of(choice, INQUIRY_CODES, F.lit("etc"))


def clean_payment_method(method: Column) -> Column:
    """Drop the first 'PaymentMethod'; empty or missing becomes UNKNOWN."""
    short = F.regexp_replace(method, "^(.*?)PaymentMethod", "$1")
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("UNKNOWN"))


def payment_provider(provider: Column) -> Column:
    return F.coalesce(F.nullif(provider, F.lit("")), F.lit(DEFAULT_PROVIDER))


def categories_allowed(limit_to: Column, given: Column) -> Column:
    """An empty or missing limit allows everything; otherwise any overlap does."""
    return limit_to.isNull() | (F.size(limit_to) == 0) | F.coalesce(F.arrays_overlap(limit_to, given), F.lit(False))


def text_array(json_text: Column) -> Column:
    return F.from_json(json_text, "array<string>")
