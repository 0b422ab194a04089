"""Cleaning rules as data: defaults, the usual additions of a library, and the rules of a book's own file.

Rules are regular expressions, found anywhere, whatever the case, with ^ and $ at lines. A book's document
may add lists to the defaults or, with `replace_defaults`, stand alone; a book without one has the additions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.cleaning import CITATIONS, CUTOFF_RULES, TITLE_RULES

KINDS = {"drop_chapter_title_patterns": TITLE_RULES, "section_cutoff_patterns": CUTOFF_RULES, "remove_patterns": CITATIONS}
#: Titles of front and back matter that a library drops where a book says nothing, each as a whole.
ADDED_TITLES = sorted(re.escape(t) for t in (
    "APPENDIXES", "About the Publisher", "By the Same Author", "Chronology", "Colophon", "Copyright Page", "Cover Page", "Editorial Board",
    "End User License Agreement", "Expanded table of contents", "Figures", "General index", "Half Title", "Halftitle Page", "Illustrations", "Imprint",
    "List of Abbreviations", "List of contributors", "List of illustrations", "List of works cited", "Maps", "Notes on the Contributors",
    "Picture Credits", "Praise", "Suggested Further Reading", "Titlepage",
))
#: These need only begin so.
ADDED_BEGINNINGS = [re.escape(t) for t in ("Also By", "List of figures")]
ADDED = {"drop_chapter_title_patterns": [f"^{t}$" for t in ADDED_TITLES] + ["^" + ADDED_BEGINNINGS[0] + "$", "^" + ADDED_BEGINNINGS[1]]}
_SCHEMA = "replace_defaults boolean, " + ", ".join(f"{k} array<string>" for k in KINDS)


def _words(items: list[str]) -> Column:
    return F.array(*map(F.lit, items)).cast("array<string>")


def effective(books: DataFrame, document: str = "rules", defaults: dict[str, list[str]] | None = None, added: dict[str, list[str]] | None = None) -> DataFrame:
    """`books` with a column for each kind of rule (an array in order) and replace_defaults, from the JSON in `document`.

    Without a document (null) a book has the defaults and the added rules. A kind that isn't a list, or a document that
    isn't an object, is an error. The document is no longer a column of the result.
    """
    defaults, added = KINDS if defaults is None else defaults, ADDED if added is None else added
    said = F.from_json(document, _SCHEMA)
    alone = F.coalesce(said["replace_defaults"], F.lit(False))
    out = books.withColumn("_said", said).withColumn("_alone", alone)
    for kind in KINDS:
        raw = F.get_json_object(document, f"$.{kind}")
        own = F.when(raw.isNull() | F.startswith(raw, F.lit("[")), F.coalesce(F.col(f"_said.{kind}"), _words([]))).otherwise(F.raise_error(F.concat(F.lit(f"{kind} is not a list: "), raw)).cast("array<string>"))
        base = F.when(F.col("_alone"), _words([])).otherwise(_words(defaults.get(kind, [])))
        out = out.withColumn(kind, F.when(F.col(document).isNull(), _words([*defaults.get(kind, []), *added.get(kind, [])])).otherwise(F.concat(base, own)))
    bad = F.col(document).isNotNull() & ~F.startswith(F.trim(document), F.lit("{"))
    checked = F.when(bad, F.raise_error(F.lit("a rule document is not an object")).cast("boolean")).otherwise(F.col("_alone"))
    return out.withColumn("replace_defaults", checked).drop("_said", "_alone", document)


def rows(books: DataFrame, book: str) -> DataFrame:
    """book, kind, ord (from 1) and pattern of the rules of `effective`."""
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("patterns")) for kind in KINDS))
    kinds = books.select(book, F.explode(each).alias("k"))
    return kinds.select(book, F.col("k.kind").alias("kind"), F.posexplode("k.patterns").alias("ord", "pattern")).withColumn("ord", F.col("ord") + 1)


def own_rules(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rules (kind, pattern) that aren't among the defaults, as a book's file keeps them, each once."""
    return rules.distinct().join(defaults.select("kind", "pattern").distinct(), ["kind", "pattern"], "left_anti")
