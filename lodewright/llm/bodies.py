"""The body of a record: the text inside the fence of display_content."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

_OPEN = re.compile(r"^(`{3,})[^\n]*\n", re.M)


def body_span(text: str | None) -> tuple[int, int] | None:
    """(start, end) of the body in display_content; None without an opening fence line and the equal fence at the end.

    The line break before the closing fence belongs to the fence, so a fence right after the opening line
    holds the empty body.
    """
    if not text or not (m := _OPEN.search(text)):
        return None
    fence, start = m[1], m.end()
    end = len(text.rstrip())
    if not text.startswith(fence, end - len(fence)) or end - len(fence) < start or text[end - len(fence) - 1] not in "\n":
        return None
    end -= len(fence)
    return start, max(start, end - 1)


def body(text: str | None) -> str | None:
    span = body_span(text)
    return None if span is None else text[span[0] : span[1]]


def fence_column(display) -> F.Column:
    """The opening fence of display_content as a column; empty if there is none."""
    return F.regexp_extract(display, r"(?m)^(`{3,})[^\n]*\n", 1)
