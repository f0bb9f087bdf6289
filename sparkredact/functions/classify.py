"""The categories of a text: a struct of flags, and the sorted array of those that hold.

The flags are fields of one struct, so a query that reads one category computes
that one only; the array form computes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import detectors as d
from .dialect import NOT_S, THAI, D
from .lexicon import CATEGORIES

#: Categories that no single pattern gives, and those of the second layer.
STRUCTURED = ("credit_card", "ip_address", "iban", "crypto_wallet")
#: What keeps a long token from counting as a key.
_SUPPRESSING = ("api_key", "access_token", "email", "url", "thai_national_id", "bank_account", "passport_number")


#: Columns that the steps add and drop again.
_PARTS = ("_text", "_low", "_stripped", "_tokens", "_stripped_tokens", "_low_tokens", "_low_stripped_tokens", "_digit", "_thai", "_assigns", "_dotted")


def with_text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the parts of the text that several detectors share, each computed once.

    Four cheap tests come with them: most texts have no digit, no Thai, no sign of an
    assignment or nothing like a domain, and need none of the patterns that ask for one. In
    _low the long s counts as an s, which patterns in either case take it for.
    """
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_text", plain)
    t = F.col("_text")
    df = df.withColumns({"_low": F.translate(F.lower(t), "\u017f", "s"), "_digit": t.rlike(D), "_thai": t.rlike(f"[{THAI}]"), "_assigns": t.contains("=") | t.contains(":"), "_dotted": t.contains("://") | t.rlike(f"\\.{NOT_S}")})
    df = df.withColumn("_stripped", F.when(F.col("_dotted"), d.stripped(t)).otherwise(t))
    df = df.withColumn("_tokens", d.tokens(t))
    df = df.withColumn("_stripped_tokens", F.when(F.col("_dotted"), d.tokens(F.col("_stripped"))).otherwise(F.col("_tokens")))
    return df.withColumns({"_low_tokens": F.lower("_tokens"), "_low_stripped_tokens": F.lower("_stripped_tokens")})


def raw_flags(apart: bool = False) -> dict[str, Column]:
    """The conditions of single detectors over the parts of with_text_parts(); apart: see detectors.CARD_APART."""
    text, low, bare, bare_joined, low_joined, low_bare_joined = (F.col(c) for c in ("_text", "_low", "_stripped", "_stripped_tokens", "_low_tokens", "_low_stripped_tokens"))
    digit, thai, assigns, dotted = (F.col(c) for c in ("_digit", "_thai", "_assigns", "_dotted"))
    return {
        "thai_national_id": digit & d.thai_national_id(text),
        "bank_account": digit & text.rlike(d.BANK_ACCOUNT),
        "passport_number": digit & text.rlike(d.PASSPORT),
        "license_plate": digit & thai & text.rlike(d.PLATE),
        "date_of_birth": digit & d.date(text),
        "thai_address": thai & d.thai_address(text),
        "job_title": (thai & d.thai_job_title(text)) | d.latin_job_title(F.lower(text), low_joined),
        "email": text.contains("@") & text.rlike(d.EMAIL),
        "url": dotted & text.rlike(d.URL),
        "money_amount": digit & text.rlike(d.MONEY),
        "percent_value": text.contains("%") & digit & text.rlike(d.PERCENT),
        "access_token": d.any_of_patterns(text, text, d.ACCESS_TOKEN) | d.any_of_patterns(text, low, d.BEARER) | (assigns & d.any_of_patterns(text, low, d.TOKEN_ASSIGNED)),
        "secret": d.any_of_patterns(text, text, d.PRIVATE_KEY) | (assigns & d.any_of_patterns(text, low, d.SECRET_ASSIGNED)),
        "phone": digit & d.phone(text),
        "key": d.any_of_patterns(text, text, d.API_KEY) | (assigns & d.any_of_patterns(text, low, d.KEY_ASSIGNED)),
        "long_token": digit & text.rlike(r"[A-Za-z0-9_\-]{24}") & text.rlike(d.LONG_TOKEN),
        "organization_name": (thai & d.thai_organization(text)) | d.latin_organization(low_bare_joined),
        "person_name": (thai & d.thai_person(text)) | d.latin_person(F.lower(bare), bare_joined, low_bare_joined),
        "credit_card": digit & d.credit_card(text, apart),
        "ip_address": d.ip_address(text),
        "iban": digit & d.iban(text),
        "crypto_wallet": digit & d.crypto_wallet(text),
    }


def flags() -> dict[str, Column]:
    """Each category's condition over the raw flags, which are columns by then."""
    own = {c: F.col(f"_f_{c}") for c in raw_flags()}
    out = {c: own[c] for c in CATEGORIES if c in own}
    out["phone_number"] = ~own["thai_national_id"] & own["phone"]
    none = F.lit(True)
    for c in _SUPPRESSING:
        none = none & ~own["key" if c == "api_key" else c]
    out["api_key"] = own["key"] | (none & own["long_token"])
    return out


def with_flags(df: DataFrame, text: str = "text", structured: bool = True, apart: bool = False) -> DataFrame:
    """df with flags, a struct of one boolean for each category, in the order of the categories."""
    raw = {f"_f_{c}": F.coalesce(x, F.lit(False)) for c, x in raw_flags(apart).items() if structured or c not in STRUCTURED}
    df = with_text_parts(df, text).withColumns(raw)
    found = flags()
    own = [found[c].alias(c) for c in CATEGORIES if structured or c not in STRUCTURED]
    return df.withColumn("flags", F.struct(*own)).drop(*_PARTS, *raw)


def categories_of(flag_struct: str, names) -> Column:
    """The sorted array of the categories that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"{flag_struct}.{c}"), F.lit(c)) for c in names))))


def classify(df: DataFrame, text: str = "text", structured: bool = True, apart: bool = False) -> DataFrame:
    """df with categories array<string>: sorted, empty where nothing holds; never null.

    Null and blank texts have none. Other types than strings are cast. With apart, card numbers
    are looked for as the SQL does, which misses some; see detectors.CARD_APART.
    """
    names = [c for c in CATEGORIES if structured or c not in STRUCTURED]
    return with_flags(df, text, structured, apart).withColumn("categories", categories_of("flags", names)).drop("flags")
