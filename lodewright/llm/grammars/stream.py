"""Token streams for the recognisers.

A text becomes lines of shapes first: identifiers, numbers and strings lose their spelling in a few passes
of compiled patterns. Code repeats shapes far more than spellings, so the tokens of a line, and whole
statements that fill a line, are remembered by shape.
"""

from __future__ import annotations

import re


class Invalid(Exception):
    """The text is not of this language."""


MEMO = 1 << 16


class Shapes:
    """Lines to tokens. An identifier is i, a number 0, a string s, other literals as the language says."""

    def __init__(self, keywords: frozenset[str], punctuation: list[str], ident: str, number: str, literals: str):
        marks = "|".join(re.escape(p) for p in sorted(punctuation, key=len, reverse=True))
        self.keywords = keywords
        self.number = re.compile(number)
        self.ident = re.compile(ident)
        self.token = re.compile(rf"[A-Za-z]+|0|{literals}|{marks}")
        self.space = re.compile(r"[ \t\f\v\xa0\ufeff]+")
        self.lines: dict[str, tuple[str, ...]] = {}

    def shape(self, text: str) -> str:
        """text, its literals already replaced by private-use characters, with identifiers and numbers reduced."""
        words = self.keywords
        text = self.number.sub("0", text)
        return self.ident.sub(lambda m: m[0] if m[0] in words else "i", text)

    def of_line(self, line: str) -> tuple[str, ...]:
        got = self.lines.get(line)
        if got is None:
            rest = self.space.sub(" ", line)
            out, at = [], 0
            while at < len(rest):
                if rest[at] == " ":
                    at += 1
                    continue
                m = self.token.match(rest, at)
                if not m:
                    raise Invalid(f"character {rest[at]!r}")
                word = m[0]
                if word[0].isalpha() and word not in self.keywords and word != "i":
                    raise Invalid(word)
                out.append(word)
                at = m.end()
            got = tuple(out)
            if len(self.lines) > MEMO:
                self.lines.clear()
            self.lines[line] = got
        return got


class Stream:
    """Tokens with the line each begins, an end mark, and a memory of statements that fill a line."""

    __slots__ = ("t", "p", "first", "known")

    def __init__(self, tokens: list[str], first: dict[int, tuple[str, int]], known: set):
        self.t, self.p, self.first, self.known = tokens, 0, first, known

    def at(self, *words: str) -> bool:
        return self.t[self.p] in words

    def take(self, word: str) -> bool:
        if self.t[self.p] == word:
            self.p += 1
            return True
        return False

    def need(self, word: str) -> None:
        if self.t[self.p] != word:
            raise Invalid(f"{self.t[self.p]} where {word} is needed")
        self.p += 1

    def fail(self) -> None:
        raise Invalid(self.t[self.p])


HEAD = 12


class Watched(list):
    """Tokens that remember how far they were looked at."""

    top = 0

    def __getitem__(self, i):
        self.top = max(self.top, i if isinstance(i, int) else i.stop or len(self))
        return list.__getitem__(self, i)


def head(text: str) -> str | None:
    """The first HEAD lines of a longer text, if no comment, string or line goes on beyond them; else None."""
    at = -1
    for _ in range(HEAD):
        at = text.find("\n", at + 1)
        if at < 0:
            return None
    first = text[: at + 1]
    return None if "`" in first or "\\\n" in first or first.rfind("/*") > first.rfind("*/") else first


def refused(stream: Stream, ends: int, run) -> bool:
    """Whether run refuses the tokens of a text's head before it looks at what follows them, so that it refuses the text as
    well; ends is the number of end marks."""
    end = len(stream.t) - ends
    stream.t = Watched(stream.t)
    try:
        run()
    except (Invalid, IndexError):
        return stream.t.top < end
    except RecursionError:
        pass
    return False
