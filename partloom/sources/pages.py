"""Lines of stored texts and web pages, and the sections that headings part."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from partloom.functions.text import any_of, strip

#: What a page does not show, what begins a line, and any other tag.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAKS = r"(?i)</?(?:br|p|li|ul|ol|h[1-6]|title|div|tr|td|th|table|article|section|nav|body|head|html)\b[^>]*>"
TAG = r"<[^>]*>"
#: Entities, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
#: The headings of a guide's sections.
HEADINGS = ("APPLICATION", "INTERCHANGE", "POSSIBLE SUBSTITUTIONS", "SPECIFICATIONS")


def html_text(html: Column) -> Column:
    """What a page shows, a line for each block."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAG, "")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def sections(text: Column, headings: Iterable[str] = HEADINGS) -> Column:
    """Structs (section, text): the lines under each heading, a fold over the lines of a document. What comes before the first one has no name; sections without lines are left out.

    A text that holds no heading's words is one section as it is.
    """
    headings = list(headings)
    part = "array<struct<section:string,lines:array<string>>>"

    def closed(s: Column) -> Column:
        return F.when(F.size(s["lines"]) > 0, F.concat(s["out"], F.array(F.struct(s["section"].alias("section"), s["lines"].alias("lines"))))).otherwise(s["out"])

    def state(section: Column, lines: Column, out: Column) -> Column:
        return F.struct(section.alias("section"), lines.alias("lines"), out.alias("out"))

    none = F.array().cast("array<string>")
    step = lambda s, line: F.when(strip(line).isin(*headings), state(strip(line), none, closed(s))).otherwise(state(s["section"], F.concat(s["lines"], F.array(line)), s["out"]))
    found = F.aggregate(F.split(text, "\n"), state(F.lit(""), none, F.array().cast(part)), step, closed)
    parts = F.transform(found, lambda x: F.struct(x["section"].alias("section"), F.array_join(x["lines"], "\n").alias("text")))
    held = any_of([text.contains(h) for h in headings])
    return F.when(~held, F.array(F.struct(F.lit("").alias("section"), text.alias("text")))).otherwise(parts)
