"""Recogniser of C translation units: grammar only, directives are taken out, names need not be known."""

from __future__ import annotations

import re

from lodewright.llm.grammars.stream import MEMO, Invalid, Shapes, Stream, head, refused

END = "\x00"
_STORAGE = frozenset("auto extern register static typedef inline const volatile restrict _Noreturn _Thread_local _Atomic __inline __inline__ __extension__ __restrict __const __volatile__".split())
_TYPES = frozenset("char double float int long short signed unsigned void _Bool _Complex __int128 __signed__".split())
_OTHER = frozenset("break case continue default do else enum for goto if return sizeof struct switch union while _Alignas _Alignof _Static_assert _Generic typeof __typeof__ __attribute__ asm __asm__ __asm".split())
_MARKS = "... <<= >>= -> ++ -- << >> <= >= == != && || += -= *= /= %= &= ^= |= { } ( ) [ ] ; , : ? = . & * + - ~ ! / % < > ^ |".split()
_SHAPES = Shapes(_STORAGE | _TYPES | _OTHER, _MARKS, r"[^\W\d]\w*", r"(?<![\w])(?:0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*(?:[pP][+-]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfF]*(?![\w])", "[\ue000\ue001]")
_STRING, _CHAR = "\ue000", "\ue001"
_LITERAL = re.compile(r"""//[^\n]*|/\*(?s:.*?)\*/|(?:\bu8|\b[LuU])?"(?:[^"\\\n]|\\.)*"|(?:\b[LuU])?'(?:[^'\\\n]|\\.)+'|["']|/\*""")
_DIRECTIVE = re.compile(r"^[ \t]*#[^\n]*", re.M)
_ELSE = re.compile(r"^[ \t]*#[ \t]*(if|el|endif)")
_BINARY = frozenset("|| && | ^ & == != < > <= >= << >> + - * / %".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_DECL = _STORAGE | _TYPES | {"struct", "union", "enum", "typeof", "__typeof__", "_Alignas", "_Static_assert", "__attribute__"}
_AFTER_CAST = frozenset(["i", "0", _STRING, _CHAR, "sizeof", "!", "~", "{"])
_KNOWN: set = set()


def _literal(m: re.Match) -> str:
    s = m[0]
    if s.startswith("//"):
        return ""
    if s in ('"', "'", "/*"):
        raise Invalid("a literal or comment without end")
    if s.startswith("/*"):
        return "\n" if "\n" in s else " "
    return _CHAR if s[-1] == "'" else _STRING


def _first_branches(text: str) -> str:
    out, drop = [], []
    for line in text.split("\n"):
        if m := _ELSE.match(line):
            if m[1] == "if":
                drop.append(False)
            elif m[1] == "el" and drop:
                drop[-1] = True
            elif m[1] == "endif" and drop:
                drop.pop()
            out.append("")
        elif not any(drop):
            out.append(line)
    return "\n".join(out)


def parse(text: str) -> bool:
    if "\x00" in text:
        raise Invalid("NUL")
    text = text[1:] if text.startswith("\ufeff") else text
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\\\n", "")
    try:
        if (first := head(text)) and refused(s := _recogniser(first, set()), 3, s.unit):
            raise Invalid("in its first lines")
        return _recogniser(text, _KNOWN).unit()
    except Invalid:
        if "#el" in text.replace(" ", ""):
            return _recogniser(_first_branches(text), _KNOWN).unit()
        raise


def _recogniser(text: str, known: set) -> _C:
    # a directive's quotes need not pair, so directives go first, but not those inside comments
    blank = _LITERAL.sub(_literal, _without_directives(text))
    tokens: list[str] = []
    first: dict[int, tuple[str, int]] = {}
    for line in _SHAPES.shape(blank).split("\n"):
        line = line.strip()
        if not line:
            continue
        at = len(tokens)
        tokens += _SHAPES.of_line(line)
        first[at] = (line, len(tokens))
    tokens += [END, END, END]
    return _C(tokens, first, known)


def _without_directives(text: str) -> str:
    if "#" not in text:
        return text
    spans = [(m.start(), m.end()) for m in re.finditer(r"/\*(?s:.*?)\*/", text)]

    def drop(m: re.Match) -> str:
        if any(a < m.start() < b for a, b in spans):
            return m[0]
        tail = m[0].rfind("/*")
        return m[0][tail:] if tail >= 0 and "*/" not in m[0][tail:] else ""

    return _DIRECTIVE.sub(drop, text)


class _C(Stream):
    __slots__ = ()

    def unit(self) -> bool:
        while not self.at(END):
            if not self.take(";"):
                self.external()
        return True

    def external(self) -> None:
        if self.at("asm", "__asm__", "__asm"):
            self.p += 1
            self.balanced()
            return self.need(";")
        if self.at("i") and self.t[self.p + 1] == "(":
            # a macro call, or a function without a type
            back = self.p
            self.p += 1
            self.balanced()
            if self.take(";"):
                return
            self.p = back
        if self.declaration(True) and self.at("{"):
            self.block()

    def balanced(self) -> None:
        depth = 0
        while True:
            w = self.t[self.p]
            if w in ("(", "[", "{"):
                depth += 1
            elif w in (")", "]", "}"):
                depth -= 1
            elif w == END:
                self.fail()
            self.p += 1
            if not depth:
                return

    def attributes(self) -> None:
        while self.at("__attribute__", "asm", "__asm__", "__asm", "_Alignas"):
            self.p += 1
            self.balanced()

    def specifiers(self) -> bool:
        """Whether a type was named."""
        typed = False
        while True:
            w = self.t[self.p]
            if w in _STORAGE:
                self.p += 1
            elif w in _TYPES:
                self.p += 1
                typed = True
            elif w in ("struct", "union"):
                self.p += 1
                self.attributes()
                named = self.take("i")
                if self.at("{"):
                    self.members()
                elif not named:
                    self.fail()
                typed = True
            elif w == "enum":
                self.p += 1
                named = self.take("i")
                if self.take("{"):
                    while not self.take("}"):
                        self.need("i")
                        if self.take("="):
                            self.conditional()
                        if not self.at("}"):
                            self.need(",")
                elif not named:
                    self.fail()
                typed = True
            elif w in ("typeof", "__typeof__"):
                self.p += 1
                self.balanced()
                typed = True
            elif w in ("__attribute__", "_Alignas"):
                self.attributes()
            elif w == "i":
                nxt = self.t[self.p + 1]
                if not typed and (nxt in ("i", "*") or nxt in _STORAGE or nxt in _TYPES or nxt == "(" and self.t[self.p + 2] == "*"):
                    typed = True
                elif not (nxt in _TYPES or nxt == "struct" or typed and nxt in ("i", "__attribute__")):
                    return typed
                self.p += 1
            else:
                return typed

    def members(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.at("_Static_assert"):
                self.declaration(False)
                continue
            if not self.specifiers() and not self.at("i"):
                self.fail()
            if not self.at(";"):
                while True:
                    if not self.at(":"):
                        self.declarator(True)
                    if self.take(":"):
                        self.conditional()
                    self.attributes()
                    if not self.take(","):
                        break
            self.need(";")

    def declaration(self, outside: bool) -> bool:
        """A declaration with its semicolon, or up to a function's body: then true."""
        if self.take("_Static_assert"):
            self.balanced()
            self.need(";")
            return False
        start = self.p
        typed = self.specifiers()
        if not typed and not (outside and (self.at("i") and self.t[self.p + 1] == "(" or self.p > start)) and self.p == start:
            self.fail()
        if self.take(";"):
            return False
        lone = True
        while True:
            called = self.declarator(True)
            self.attributes()
            if outside and called and lone and self.at("{"):
                return True
            if outside and called and lone and not self.at(";", ",", "="):
                while not self.at("{"):  # parameters declared after the list
                    self.declaration(False)
                return True
            if not typed and not called:
                self.fail()
            if self.take("="):
                self.initializer()
            lone = False
            if not self.take(","):
                break
        self.need(";")
        return False

    def declarator(self, named: bool) -> bool:
        """Whether it declares a function; without named the name may be missing."""
        while self.at("*", "^") or self.t[self.p] in _STORAGE or self.at("__attribute__"):
            if self.at("__attribute__"):
                self.attributes()
            else:
                self.p += 1
        if self.at("(") and (named or self.t[self.p + 1] in ("*", "(", "^", "i") and not (self.t[self.p + 1] == "i" and self.t[self.p + 2] != ")")):
            self.p += 1
            self.declarator(named)
            self.need(")")
        elif self.at("i"):
            self.p += 1
        elif named:
            self.fail()
        called = False
        while True:
            if self.take("["):
                while self.at("static") or self.t[self.p] in _STORAGE:
                    self.p += 1
                if not self.at("]"):
                    self.assignment()
                self.need("]")
            elif self.at("("):
                self.p += 1
                self.parameters()
                called = True
            else:
                return called

    def parameters(self) -> None:
        while not self.take(")"):
            if not self.take("..."):
                typed = self.specifiers()
                if not typed:
                    self.need("i")
                if not self.at(",", ")"):
                    self.declarator(False)
                self.attributes()
            if not self.at(")"):
                self.need(",")
                if self.at(")"):
                    self.fail()

    def initializer(self) -> None:
        if not self.take("{"):
            return self.assignment()
        while not self.take("}"):
            designated = False
            while self.at("[", "."):
                designated = True
                if self.take("."):
                    self.need("i")
                else:
                    self.p += 1
                    self.conditional()
                    if self.take("..."):
                        self.conditional()
                    self.need("]")
            if designated:
                self.need("=")
            elif self.at("i") and self.t[self.p + 1] == ":":
                self.p += 2
            self.initializer()
            if not self.at("}"):
                self.need(",")

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            got = self.first.get(self.p)
            if got and got[0] in self.known:
                self.p = got[1]
                continue
            self.item()
            if got and self.p == got[1] and self.t[self.p - 1] == ";" and not self.at("else", "while"):
                if len(self.known) > MEMO:
                    self.known.clear()
                self.known.add(got[0])

    def item(self) -> None:
        w = self.t[self.p]
        if w in _DECL:
            self.declaration(False)
        elif w == "i" and (self.t[self.p + 1] == "i" or self.t[self.p + 1] in _DECL):
            self.declaration(False)
        elif w == "i" and self.t[self.p + 1] == "*":
            back = self.p
            try:
                self.statement()
            except Invalid:
                self.p = back
                self.declaration(False)
        else:
            self.statement()

    def statement(self) -> None:
        w = self.t[self.p]
        if w == "{":
            return self.block()
        if w == ";":
            self.p += 1
            return
        if w == "i" and self.t[self.p + 1] == ":":
            self.p += 2
            self.attributes()
            return None if self.at("}") else self.item()
        if w in ("case", "default"):
            self.p += 1
            if w == "case":
                self.conditional()
                if self.take("..."):
                    self.conditional()
            self.need(":")
            return None if self.at("}") else self.item()
        if w in ("if", "while", "switch"):
            self.p += 1
            self.condition()
            self.statement()
            if w == "if" and self.take("else"):
                self.statement()
            return
        if w == "for":
            self.p += 1
            self.need("(")
            if self.t[self.p] in _DECL or self.at("i") and self.t[self.p + 1] == "i":
                self.declaration(False)
            else:
                if not self.at(";"):
                    self.expression()
                self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
            self.need(")")
            return self.statement()
        if w == "do":
            self.p += 1
            self.statement()
            self.need("while")
            self.condition()
            return self.need(";")
        if w in ("break", "continue"):
            self.p += 1
        elif w == "goto":
            self.p += 1
            self.take("*")
            self.need("i")
        elif w == "return":
            self.p += 1
            if not self.at(";"):
                self.expression()
        elif w in ("asm", "__asm__", "__asm"):
            self.p += 1
            while self.t[self.p] in _STORAGE or self.at("goto"):
                self.p += 1
            self.balanced()
        else:
            self.expression()
        self.need(";")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.conditional()
        if self.t[self.p] in _ASSIGN:
            self.p += 1
            self.assignment()

    def conditional(self) -> None:
        self.binary()
        if self.take("?"):
            if not self.at(":"):
                self.expression()
            self.need(":")
            self.conditional()

    def binary(self) -> None:
        while True:
            self.unary()
            if self.t[self.p] not in _BINARY:
                return
            self.p += 1

    def type_name(self) -> None:
        if not self.specifiers():
            self.need("i")
        self.declarator(False)

    def cast(self) -> bool:
        """Whether the parenthesis here holds a type that is applied to what follows; if so it is passed."""
        w = self.t[self.p + 1]
        if w in _DECL:
            self.p += 1
            self.type_name()
            self.need(")")
            return True
        if w == "i":
            k = self.p + 2
            while self.t[k] == "*" or self.t[k] in _STORAGE:
                k += 1
            if self.t[k] == ")" and (k > self.p + 2 or self.t[k + 1] in _AFTER_CAST):
                self.p = k + 1
                return True
        return False

    def unary(self) -> None:
        while True:
            w = self.t[self.p]
            if w in ("+", "-", "!", "~", "*", "&", "++", "--", "__extension__"):
                self.p += 1
            elif w == "&&":
                self.p += 1
                return self.need("i")
            elif w in ("sizeof", "_Alignof"):
                self.p += 1
                if self.at("(") and self.t[self.p + 1] in _DECL:
                    self.p += 1
                    self.type_name()
                    self.need(")")
                    if self.at("{"):
                        self.initializer()
                    return
            elif w == "(" and self.cast():
                if self.at("{"):
                    self.initializer()
                    return self.suffixes()
            else:
                return self.postfix()

    def postfix(self) -> None:
        w = self.t[self.p]
        if w in ("i", "0", _CHAR):
            self.p += 1
            if w == "i" and self.at(_STRING):
                self.strings()
        elif w == _STRING:
            self.strings()
        elif w == "(":
            self.p += 1
            if self.at("{"):
                self.block()
            else:
                self.expression()
            self.need(")")
        elif w == "_Generic":
            self.p += 1
            self.balanced()
        else:
            self.fail()
        self.suffixes()

    def strings(self) -> None:
        while self.at(_STRING) or self.at("i") and (self.t[self.p - 1] == _STRING or self.t[self.p + 1] == _STRING):
            self.p += 1

    def suffixes(self) -> None:
        while True:
            w = self.t[self.p]
            if w == "[":
                self.p += 1
                self.expression()
                self.need("]")
            elif w == "(":
                self.p += 1
                while not self.take(")"):
                    if self.t[self.p] in _DECL:
                        self.type_name()
                    else:
                        self.assignment()
                    if not self.at(")"):
                        self.need(",")
                        if self.at(")"):
                            self.fail()
            elif w in (".", "->"):
                self.p += 1
                self.need("i")
            elif w in ("++", "--"):
                self.p += 1
            else:
                return
