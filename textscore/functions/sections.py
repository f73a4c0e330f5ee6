"""Sections of a human-written answer in Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import SECTIONS
from .text import EDGE_RIGHT, strip

_FLAGS = "(?dmsiu)"
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"


def extract_section(text: Column, section: str) -> Column:
    """Text under the heading ``## section``, stripped; ``""`` where the heading is absent.

    Observations and interpretations end at the next ``## `` heading;
    recommendations run to the end of the text, later headings included.
    """
    name = section.strip().lower()
    if name not in SECTIONS:
        raise ValueError(f"unknown section {section!r}; expected one of {', '.join(SECTIONS)}")
    head = rf"{_FLAGS}^##{_SPACE}*{name}"
    if name == "recommendations":
        pattern = rf"{head}{EDGE_RIGHT}{_SPACE}*(.*)\z"
    else:
        pattern = rf"{head}{_SPACE}*(.*?)(?=^##{_SPACE}|\z)"
    return strip(F.regexp_extract(text, pattern, 1))


def extract_observations(text: Column) -> Column:
    return extract_section(text, "observations")


def extract_interpretations(text: Column) -> Column:
    return extract_section(text, "interpretations")


def extract_recommendations(text: Column) -> Column:
    return extract_section(text, "recommendations")
