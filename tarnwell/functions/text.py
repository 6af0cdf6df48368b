"""Text functions over columns: HTML to text, titles, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import page


def normalize_space(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; none at the ends.
    Soft hyphens and zero-width spaces go."""
    return F.trim(F.regexp_replace(F.translate(text, "\u00ad\u200b", ""), "[ \t\n\f\r\u00a0]+", " "))


def html_text(html: Column) -> Column:
    """The visible text of a page, title included."""
    return normalize_space(page(html)["text"])


def html_title(html: Column) -> Column:
    """The first title; empty where there is none."""
    return normalize_space(page(html)["title"])


def fold_yo(text: Column) -> Column:
    """Small yo becomes ye; the capital stays, and later splits its word."""
    return F.translate(text, "ё", "е")


def clean_text(html: Column) -> Column:
    return fold_yo(html_text(html))
