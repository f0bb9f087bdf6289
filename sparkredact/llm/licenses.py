"""License scans by canonical digest: normalised whole texts hash-joined to known licences.

Everything here is DataFrame functions. A text is normalised as follows: typographic quotes and
dashes become plain; lines that state a copyright are dropped; list marks at the start of a line are
dropped; A-Z become lower case; all but letters, digits and characters beyond
ASCII separates words; equivalent spellings become one. What is left is hashed
with SHA-256, and joined with the digests of the known licences, which get the
same treatment; of long licences just the digests are held. The known digests are a fixed list of a few rows, so that side is
broadcast; nothing is shuffled, and equal texts cost no more than others.

A line can also be the whole of a notice ("Released under the MIT License."):
the lines of a text are normalised with it, and those that are known notices are listed.

Defined results: a null text is the empty text, whose digest no licence has. A
text of a known licence among other words is no match - whole texts are looked up
- but a notice on a line of its own is. Repeated rows give repeated rows; other
columns are ignored by scan(); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import any_of
from .common import table
from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TYPOGRAPHIC, _PLAIN = "“”„‘’–—‐", "\"\"\"''---"
#: A line that states a copyright or reserves rights; the same in Java and in RE2.
COPYRIGHT_LINE = r"(?im)^[ \t*#/;.-]*(?:(?:copyright|\(c\)|©)[ \t:]*(?:\(c\)|©|[0-9]{4}|<year>|\[year\]|by )[^\n]*|all rights reserved\.?[ \t]*)$"
LIST_MARK = r"(?m)^[ \t]*(?:[*+-]|\(?(?:[0-9]{1,2}|[A-Za-z])[.)])[ \t]+"
NO_WORD = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def _same(words: Column) -> Column:
    """Equivalent spellings made one; words have two spaces about them, so neighbours share none.

    A text in which one pass finds none of the spellings is left as it is: no replacement would find any either.
    """
    same = words
    for old, new in SPELLINGS:
        same = F.replace(same, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.when(words.rlike(f" {any_of(old for old, _ in SPELLINGS)} "), same).otherwise(words)


def _lowered(text: Column) -> Column:
    """text with A-Z in lower case and plain quotes and dashes; a text of ASCII alone has no others."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _TYPOGRAPHIC + _UPPER, _PLAIN + _LOWER))


def canonical_lines(text: Column) -> Column:
    """The normalised text with its line ends; each line begins and ends with two spaces."""
    text = _lowered(F.coalesce(text.cast("string"), F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, ""), LIST_MARK, "")
    text = F.regexp_replace(text, NO_WORD, "  ")
    return _same(F.concat(F.lit("  "), F.replace(text, F.lit("\n"), F.lit("  \n  ")), F.lit("  ")))


def canonical(lines: Column) -> Column:
    """The normalised text in one line, from canonical_lines()."""
    return _same(F.regexp_replace(lines, "[ \n]+", "  "))


def digest(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of licences given as (identifier, text); of equal digests the smallest identifier."""
    rows = spark.createDataFrame(TEXTS + NOTICES if texts is None else texts, "license_id string, text string")
    return rows.groupBy(digest(canonical(canonical_lines(F.col("text")))).alias("text_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licences: DataFrame | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, text_digest, license_id, notices array<string>) of each row of docs."""
    spark = docs.sparkSession
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    own = lines.select("doc_id", "lines", digest(canonical(F.col("lines"))).alias("text_digest"))
    if licences is None:
        licences = known(spark).unionByName(spark.createDataFrame(DIGESTS, "license_id string, text_digest string"))
    found = own.join(F.broadcast(licences), "text_digest", "left")
    of_line = {}
    for name, text in sorted(NOTICES if notices is None else notices, reverse=True):
        of_line[text] = name
    one_line = lambda x: F.regexp_replace(x, " +", "  ")
    table_of = F.create_map(*(c for text, name in of_line.items() for c in (canonical(canonical_lines(F.lit(text))), F.lit(name))))
    maybe = F.split("lines", "\n")
    if all("license" in text.lower() for text in of_line):  # a line without it cannot be one
        maybe = F.filter(maybe, lambda x: x.contains("license"))
    names = F.array_sort(F.array_distinct(F.array_compact(F.transform(maybe, lambda x: F.try_element_at(table_of, one_line(x))))))
    return found.select("doc_id", "text_digest", "license_id", names.alias("notices"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_same(words: str) -> str:
    for old, new in SPELLINGS:
        words = f"replace({words}, ' {old} ', ' {new} ')"
    return words


def _sql_lines(text: str) -> str:
    text = f"translate(coalesce({text}, ''), {_quoted(_TYPOGRAPHIC)}, {_quoted(_PLAIN)})"
    text = f"regexp_replace(regexp_replace({text}, {_quoted(COPYRIGHT_LINE)}, '', 'g'), {_quoted(LIST_MARK)}, '', 'g')"
    text = f"regexp_replace(translate({text}, '{_UPPER}', '{_LOWER}'), {_quoted(NO_WORD)}, '  ', 'g')"
    return _sql_same(f"('  ' || replace({text}, chr(10), '  ' || chr(10) || '  ') || '  ')")


def _sql_whole(lines: str) -> str:
    return _sql_same(f"regexp_replace({lines}, '[ \\n]+', '  ', 'g')")


_VALUES = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in TEXTS + NOTICES)
_NOTICES = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in NOTICES)

OP2_SQL = f"""
WITH known AS (SELECT sha256({_sql_whole(_sql_lines("t"))}) AS text_digest, min(i) AS license_id FROM (VALUES {_VALUES}) k(i, t) GROUP BY 1),
notice AS (SELECT {_sql_whole(_sql_lines("t"))} AS line, min(i) AS name FROM (VALUES {_NOTICES}) k(i, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_lines("text")} AS lines FROM documents),
l AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM (SELECT r, regexp_replace(unnest(string_split(lines, chr(10))), ' +', '  ', 'g') AS line FROM d) JOIN notice USING (line) GROUP BY r)
SELECT doc_id, sha256({_sql_whole("lines")}) AS text_digest, license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON known.text_digest = sha256({_sql_whole("lines")}) LEFT JOIN l USING (r)
"""
