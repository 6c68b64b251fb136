"""Visible text of an HTML page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Entities that are decoded, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Markup removed, block ends as line breaks, blanks collapsed; whole page."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    return F.btrim(F.regexp_replace(text, r" *\n[ \n]*", "\n"), F.lit("\n "))
