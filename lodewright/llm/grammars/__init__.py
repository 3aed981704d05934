"""Recognisers of five languages: does a text parse?"""

from __future__ import annotations

import json
import re
import sys
import warnings

from lodewright.llm.grammars import c, go, javascript
from lodewright.llm.grammars.stream import Invalid

LANGUAGES = ("python", "javascript", "go", "c", "json")


def _python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compile(text.encode("utf-8", "surrogatepass"), "<file>", "exec", dont_inherit=True)
    return True


def _refuse(name: str):
    raise ValueError(name)


def _json(text: str) -> bool:
    json.loads(text, parse_constant=_refuse)
    return True


_JSON = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def _flat_json(text: str) -> bool:
    """JSON with a stack of its own, for texts nested too deep for the usual parser."""
    stack: list[str] = []
    want, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        if not (m := _JSON.match(text, at)):
            return False
        at = m.end()
        mark, string, other = m.groups()
        if want in ("value", "value or ]") and mark in ("{", "["):
            stack.append(mark)
            want = "key or }" if mark == "{" else "value or ]"
        elif (want == "key or }" and mark == "}") or (want == "value or ]" and mark == "]") or (want == "next" and stack and mark == {"{": "}", "[": "]"}[stack[-1]]):
            stack.pop()
            want = "next"
        elif want in ("value", "value or ]") and (string or other):
            want = "next"
        elif want in ("key", "key or }") and string:
            want = ":"
        elif want == ":" and mark == ":":
            want = "value"
        elif want == "next" and stack and mark == ",":
            want = "key" if stack[-1] == "{" else "value"
        else:
            return False
    return want == "next" and not stack


_PARSERS = {"python": _python, "json": _json, "javascript": javascript.parse, "go": go.parse, "c": c.parse}


def _deep(text: str, language: str) -> bool:
    """Texts nested deeper than the recursion limit: frames of the recognisers lie on the heap, so the limit is raised for the text."""
    if language == "json":
        return _flat_json(text)
    if language == "python":
        return False  # what Python's own compiler cannot nest is not Python
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(min(2**31 - 1, max(limit, 20 * len(text) + 10_000)))
    try:
        return _PARSERS[language](text)
    except (Invalid, ValueError, IndexError):
        return False
    finally:
        sys.setrecursionlimit(limit)


def parses(text: str, language: str) -> bool:
    """Whether text is valid for the language, however deep it nests."""
    try:
        return _PARSERS[language](text)
    except RecursionError:
        return _deep(text, language)
    except (Invalid, SyntaxError, ValueError, IndexError, MemoryError):
        return False


__all__ = ["LANGUAGES", "parses"]
