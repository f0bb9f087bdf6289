"""Results of entity recognisers made into categories: tag lists, entities with scores, and spans over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which recogniser labels stand for which category.
TAGS = {
    "PERSON": "person_name",
    "ORGANIZATION": "organization_name",
    "LOCATION": "thai_address",
    "EMAIL": "email",
    "PHONE": "phone_number",
    "URL": "url",
    "ZIP": "thai_address",
    "DATE": "date_of_birth",
    "MONEY": "money_amount",
}
GROUPS = {
    "PERSON": "person_name",
    "ORGANIZATION": "organization_name",
    "ORG": "organization_name",
    "LOCATION": "thai_address",
    "LOC": "thai_address",
    "EMAIL": "email",
    "PHONE": "phone_number",
    "URL": "url",
    "ZIP": "thai_address",
    "DATE": "date_of_birth",
    "TIME": "date_of_birth",
    "MONEY": "money_amount",
}
PATTERN_ENTITIES = {
    "CREDIT_CARD": "credit_card",
    "IP_ADDRESS": "ip_address",
    "IBAN_CODE": "iban",
    "CRYPTO": "crypto_wallet",
    "EMAIL_ADDRESS": "email",
    "PHONE_NUMBER": "phone_number",
    "URL": "url",
    "US_BANK_NUMBER": "bank_account",
    "US_SSN": "thai_national_id",
    "US_PASSPORT": "passport_number",
}
GROUP_SCORE, PATTERN_SCORE = 0.5, 0.4


def mapped(label: Column, names: dict[str, str]) -> Column:
    """The category of a label in any case; null for one that isn't known."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, F.upper(label))


def tag_categories(tokens: Column) -> Column:
    """The sorted categories of an array of structs (token, tag): what follows the first hyphen of a tag other than O."""
    kinds = F.transform(F.filter(tokens, lambda t: t["tag"].isNotNull() & (t["tag"] != "O") & t["tag"].contains("-")), lambda t: mapped(F.regexp_extract(t["tag"], "^[^-]*-([\\s\\S]*)$", 1), TAGS))
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(kinds, F.array().cast("array<string>")))))


def entity_categories(entities: DataFrame, names: dict[str, str] = GROUPS, least: float = GROUP_SCORE) -> DataFrame:
    """entities with category: known labels whose score (1 if null) is high enough; entity_group before entity."""
    label = F.col("entity_group") if "entity" not in entities.columns else F.coalesce("entity_group", "entity")
    return entities.filter(F.coalesce(F.col("score"), F.lit(1.0)) >= least).withColumn("category", mapped(label, names)).filter("category IS NOT NULL")


def page_offsets(segments: DataFrame) -> DataFrame:
    """segments with start and end in the page's text, the segments joined by single spaces in order."""
    before = Window.partitionBy("image_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    return segments.withColumn("start", F.coalesce(F.sum(length + 1).over(before), F.lit(0)).cast("long")).withColumn("end", F.col("start") + length)


def overlapping(segments: DataFrame, entities: DataFrame, names: dict[str, str] = GROUPS, least: float = GROUP_SCORE) -> DataFrame:
    """(image_id, seg_idx, categories) of the segments that an entity's span touches.

    An equi-join on the page with the overlap as a condition: pages are small, so
    there is nothing to gain from binning. Spans that are empty or without ends are left out.
    """
    good = entity_categories(entities, names, least).filter("end > start").select("image_id", "category", F.col("start").alias("from"), F.col("end").alias("to"))
    placed = page_offsets(segments).select("image_id", "seg_idx", "start", "end")
    found = placed.join(good, "image_id").filter("start < to AND from < end").select("image_id", "seg_idx", "category").distinct()
    return found.groupBy("image_id", "seg_idx").agg(F.array_sort(F.collect_list("category")).alias("categories"))
