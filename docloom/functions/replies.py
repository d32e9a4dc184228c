"""Tolerant parsing of model replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fenced_json_text(col) -> Column:
    """The outermost ``{...}`` of a reply (fences and prose around it dropped);
    NULL when the reply holds no object."""
    j = F.regexp_extract(_c(col), r"(?s)(\{.*\})", 1)
    return F.when(j == "", F.lit(None).cast("string")).otherwise(j)


def json_is_valid(json_text) -> Column:
    return F.try_parse_json(_c(json_text)).isNotNull()


def json_field(json_text, field: str) -> Column:
    """Scalar field as text: ``"1"`` and ``1`` both give ``1``."""
    return F.get_json_object(_c(json_text), f"$.{field}")


def json_int(json_text, field: str) -> Column:
    """Integer field; non-numeric values (``"clarté"``) give NULL."""
    return json_field(json_text, field).try_cast("int")


def labelled_field(col, label: str) -> Column:
    """Text after ``Label:`` up to the next ``\\nWord:`` line or the end."""
    lab = re.escape(label[:1].upper() + label[1:])
    return py_strip(F.regexp_extract(_c(col), rf"(?s){lab}:\s*(.*?)(?:\n\w+:|\z)", 1))
