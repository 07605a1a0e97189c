"""Licence scan: canonical digests of entire texts and lines, joined to those of known licences.

Native: DataFrame functions only. The canonical form has lower case, no copyright notices, one spelling
of words that are written in several ways, and single blanks for everything else than letters and
digits. The known digests are made by the same expression from the given texts.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import license_texts

#: Equivalent spellings (written, canonical); fixed values.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("honour", "honor"), ("programme", "program"), ("copy-right", "copyright"), ("whilst", "while"),
    ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("initialis", "initializ"),
    ("https://", "http://"), ("&", " and "),
]
#: A line that begins with copyright, (c) or the sign and goes on with one of these or a year.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(?:(?:copyright|\(c\))[ \t:,]*(?:copyright|\(c\)|©|[\[<{]?(?:(?:19|20)[0-9]{2}|y{4}|year))|©)[^\n]*"
#: In a paragraph between blank lines: a line that begins otherwise than with copyright.
OTHER_LINE = r"(^|\n)(?!copyright)"


def _without_notice_paragraphs(text: Column) -> Column:
    """Paragraphs of which every line begins with copyright go. Blanks before lines go, too."""
    framed = F.regexp_replace(F.concat(F.lit("\n\n"), text, F.lit("\n\n")), r"\n[ \t]+", "\n")
    kept = F.filter(F.split(framed, "\n{2,}"), lambda p: p.rlike(OTHER_LINE))
    return F.when(F.contains(text, F.lit("copyright")), F.array_join(kept, "\n\n")).otherwise(text)


def canonical_lines(text: str | Column) -> Column:
    """The canonical form with its line ends kept."""
    out = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    out = F.regexp_replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), COPYRIGHT_LINE, "\n")
    out = _without_notice_paragraphs(out)
    for written, canonical in SPELLINGS:
        out = F.replace(out, F.lit(written), F.lit(canonical))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(digest, license_id) of known texts, also below each of their titles; of several licences with one
    digest the first in order of name."""
    rows = spark.createDataFrame(license_texts.titled(texts), "license_id string, text string")
    digest = F.sha2(canonical(canonical_lines("text")), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, texts: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(doc_id, digest, n_canonical, license_id, notice_ids) of each row.

    license_id names the known licence that the entire text is, with or without a title, else null. notice_ids lists in order
    of name the licences of which a whole line is a known notice. Null text is the empty text; an
    empty canonical text is no licence. Repeated rows stay; other columns are ignored. The known
    texts are dictionaries of the driver, which bounds what is broadcast; no text leaves its task.
    """
    spark = docs.sparkSession
    lined = docs.select("doc_id", canonical_lines("text").alias("lines"))
    whole = canonical(F.col("lines"))
    forms = spark.createDataFrame(sorted(notices.items()), "text string, license_id string")
    forms = forms.select(canonical(canonical_lines("text")).alias("form"), "license_id").distinct().collect()
    lines = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
    seen = F.array_intersect(lines, F.array(*[F.lit(r["form"]) for r in forms]).cast("array<string>"))
    names = F.create_map(*[F.lit(x) for r in forms for x in (r["form"], r["license_id"])]) if forms else None
    ids = F.array_sort(F.array_distinct(F.transform(seen, lambda x: names[x]))) if forms else F.array().cast("array<string>")
    scanned = lined.select("doc_id", whole.alias("whole"), ids.alias("notice_ids"))
    scanned = scanned.select("doc_id", F.sha2("whole", 256).alias("digest"), F.length("whole").cast("long").alias("n_canonical"), "notice_ids")
    known = F.broadcast(known_digests(spark, texts))
    out = scanned.join(known, "digest", "left")
    licence = F.when(F.col("n_canonical") > 0, F.col("license_id")).alias("license_id")
    return out.select("doc_id", "digest", "n_canonical", licence, "notice_ids")


def license_folder(spark: SparkSession, path: str) -> dict[str, str]:
    """Licence -> text from a folder of whole texts, each in a file named by its licence (MPL-2.0.txt).

    Such a folder holds some hundred files, so the texts come to the driver.
    """
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("name"), "value")
    return {unquote(r["name"]): r["value"] for r in rows.collect()}


def scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs, license_texts.TEXTS, license_texts.notices())
