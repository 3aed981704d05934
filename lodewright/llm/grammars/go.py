"""Recogniser of Go source files, after the language specification."""

from __future__ import annotations

import re

from lodewright.llm.grammars.stream import MEMO, Invalid, Shapes, Stream

END = "\x00"
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_MARKS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()
_SHAPES = Shapes(_KEYWORDS, _MARKS, r"[^\W\d]\w*", r"(?<![\w])(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bBoO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?(?![\w])", "[\ue000\ue001]")
_LITERAL = re.compile(r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'|["`']|/\*""")
_ESCAPE = re.compile(r"""\\(?![abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})""")
_ENDS = frozenset(["i", "0", "\ue000", "\ue001", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_STRING, _RUNE = "\ue000", "\ue001"
_KNOWN: set = set()
_PACKAGE = re.compile(r"(?:\s|;|//[^\n]*(?:\n|\Z)|/\*(?s:.*?)\*/)*+package\b")  # what every file begins with


def _literal(m: re.Match) -> str:
    s = m[0]
    if s.startswith("//"):
        return ""
    if len(s) == 1 or s == "/*":
        raise Invalid("a literal or comment without end")
    if s.startswith("/*"):
        return "\n" if "\n" in s else " "
    if s[0] == '"' and "\\" in s and _ESCAPE.search(s.replace("\\\\", "")):
        raise Invalid("escape")
    return _RUNE if s[0] == "'" else _STRING


def parse(text: str) -> bool:
    if "\x00" in text:
        raise Invalid("NUL")
    text = text[1:] if text.startswith("\ufeff") else text
    if not _PACKAGE.match(text):
        raise Invalid("no package clause")
    shape = _SHAPES.shape(_LITERAL.sub(_literal, text.replace("\r\n", "\n").replace("\r", " ")))
    tokens: list[str] = []
    first: dict[int, tuple[str, int]] = {}
    for line in shape.split("\n"):
        line = line.strip()
        if not line:
            continue
        got = _SHAPES.of_line(line)
        at = len(tokens)
        tokens += got
        if got and got[-1] in _ENDS:
            tokens.append(";")
        first[at] = (line, len(tokens))
    tokens += [END, END]
    return _Go(tokens, first, _KNOWN).file()


class _Go(Stream):
    __slots__ = ("level",)

    def file(self) -> bool:
        self.level = 0
        self.need("package")
        self.need("i")
        self.need(";")
        while self.take("import"):
            self.group(self.import_spec)
            self.need(";")
        while not self.at(END):
            if self.at("func"):
                self.p += 1
                self.function()
            else:
                self.declaration()
            if not self.at(END):
                self.need(";")
        return True

    def import_spec(self) -> None:
        if self.at("i", "."):
            self.p += 1
        self.need(_STRING)

    def group(self, spec) -> None:
        if not self.take("("):
            return spec()
        while not self.take(")"):
            spec()
            if not self.at(")"):
                self.need(";")

    def declaration(self) -> None:
        word = self.t[self.p]
        if word not in ("const", "var", "type"):
            self.fail()
        self.p += 1
        self.group({"const": self.const_spec, "var": self.var_spec, "type": self.type_spec}[word])

    def names(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")

    def const_spec(self) -> None:
        self.names()
        if not self.at(";", ")", "="):
            self.type_()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("i")
        if self.at("["):
            back = self.p
            try:
                self.type_parameters()
                self.take("=")
                return self.type_()
            except Invalid:
                self.p = back
        self.take("=")
        self.type_()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.take(",") or self.at("]"):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def function(self) -> None:
        if self.at("("):
            self.parameters()
        self.need("i")
        if self.at("["):
            self.type_parameters()
        self.signature()
        if self.at("{"):
            self.body()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.starts_type():
            self.type_()

    def starts_type(self) -> bool:
        return self.at("i", "*", "[", "map", "chan", "struct", "interface", "func", "<-", "(")

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            if not self.take("..."):
                self.type_()
                self.take("...")
                if self.starts_type():
                    self.type_()
            else:
                self.type_()
            if not self.at(")"):
                self.need(",")

    def type_(self) -> None:
        w = self.t[self.p]
        self.p += 1
        if w == "i":
            if self.take("."):
                self.need("i")
            if self.at("[") and self.t[self.p + 1] != "]":
                self.p += 1
                self.type_()
                while self.take(","):
                    if self.at("]"):
                        break
                    self.type_()
                self.need("]")
        elif w == "*":
            self.type_()
        elif w == "[":
            if not self.take("]"):
                if not self.take("..."):
                    self.inside(self.expression)
                self.need("]")
            self.type_()
        elif w == "map":
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif w == "chan":
            self.take("<-")
            self.type_()
        elif w == "<-":
            self.need("chan")
            self.type_()
        elif w == "func":
            self.signature()
        elif w == "(":
            self.type_()
            self.need(")")
        elif w == "struct":
            self.need("{")
            while not self.take("}"):
                self.field()
                self.take(_STRING)
                if not self.at("}"):
                    self.need(";")
        elif w == "interface":
            self.need("{")
            while not self.take("}"):
                if self.at("i") and self.t[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                if not self.at("}"):
                    self.need(";")
        else:
            self.p -= 1
            self.fail()

    def field(self) -> None:
        if self.at("*"):
            return self.type_()
        self.need("i")
        if self.take("."):
            self.need("i")
            return
        if self.at(";", "}", _STRING):
            return
        while self.take(","):
            self.need("i")
        self.type_()

    def inside(self, what) -> None:
        level, self.level = self.level, 0
        what()
        self.level = level

    def body(self) -> None:
        self.inside(self.block)

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not self.at("}", "case", "default", END):
            got = self.first.get(self.p)
            if got and got[0] in self.known:
                self.p = got[1]
                continue
            start = self.p
            self.statement()
            if not self.at("}"):
                self.need(";")
                if got and self.p == got[1] and start < self.p and self.t[start] != "case":
                    if len(self.known) > MEMO:
                        self.known.clear()
                    self.known.add(got[0])

    def statement(self) -> None:
        w = self.t[self.p]
        if w == ";":
            return
        if w == "{":
            return self.body()
        if w in ("const", "var", "type"):
            return self.declaration()
        if w in ("return", "go", "defer", "goto", "break", "continue", "fallthrough"):
            self.p += 1
            if w in ("go", "defer"):
                self.expression()
                if self.t[self.p - 1] != ")":
                    self.fail()
            elif w == "goto":
                self.need("i")
            elif w == "return":
                if not self.at(";", "}"):
                    self.expressions()
            elif w != "fallthrough":
                self.take("i")
            return
        if w == "if":
            return self.if_()
        if w == "for":
            return self.for_()
        if w in ("switch", "select"):
            return self.switch(w)
        if w == "i" and self.t[self.p + 1] == ":":
            self.p += 2
            if not self.at("}"):
                self.statement()
            return
        self.simple()

    def simple(self) -> None:
        if self.take("range"):
            return self.expression()
        self.expressions()
        w = self.t[self.p]
        if w in _ASSIGN:
            self.p += 1
            if not (w in ("=", ":=") and self.take("range")):
                return self.expressions()
            self.expression()
        elif w in ("++", "--"):
            self.p += 1
        elif w == "<-":
            self.p += 1
            self.expression()

    def header(self) -> None:
        """Of if and switch: simple statement, condition, both or for switch none."""
        level, self.level = self.level, -1
        if not self.at("{", ";"):
            self.simple()
        if self.take(";") and not self.at("{"):
            self.simple()
        self.level = level

    def if_(self) -> None:
        self.need("if")
        if self.at("{"):
            self.fail()
        self.header()
        self.block_in()
        if self.take("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block_in()

    def block_in(self) -> None:
        self.inside(self.block)

    def for_(self) -> None:
        self.need("for")
        level, self.level = self.level, -1
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                if not self.at(";"):
                    self.simple()
                self.need(";")
                if not self.at("{"):
                    self.simple()
        self.level = level
        self.block_in()

    def switch(self, word: str) -> None:
        self.p += 1
        if word == "switch":
            self.header()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                if word == "select":
                    self.inside(self.simple)
                else:
                    self.inside(self.cases)
            else:
                self.need("default")
            self.need(":")
            self.inside(self.statements)

    def cases(self) -> None:
        while True:
            self.expression()
            if not self.take(","):
                return

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        while True:
            while self.at("+", "-", "!", "^", "*", "&", "<-", "~"):
                self.p += 1
            self.operand()
            if self.t[self.p] in _BINARY:
                self.p += 1
                continue
            return

    def operand(self) -> None:
        w = self.t[self.p]
        composite = False
        if w == "i":
            self.p += 1
            composite = True
        elif w in ("0", _STRING, _RUNE):
            self.p += 1
        elif w == "(":
            self.p += 1
            self.inside(self.expression)
            self.need(")")
        elif w == "func":
            self.p += 1
            self.signature()
            if self.at("{"):
                self.body()
        elif w in ("[", "map", "chan", "struct", "interface"):
            self.type_()
            composite = True
            if self.at("{"):
                self.literal()
                composite = False
        else:
            self.fail()
        while True:
            w = self.t[self.p]
            if w == ".":
                self.p += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                    composite = False
                else:
                    self.need("i")
            elif w == "(":
                self.p += 1
                self.inside(self.arguments)
                composite = False
            elif w == "[":
                self.p += 1
                self.inside(self.index)
            elif w == "{" and composite and self.level >= 0:
                self.literal()
                composite = False
            else:
                return

    def arguments(self) -> None:
        while not self.take(")"):
            self.expression()
            self.take("...")
            if not self.at(")"):
                self.need(",")

    def index(self) -> None:
        colons = 0
        if not self.at(":"):
            self.expression()
            while self.take(","):
                if self.at("]"):
                    break
                self.expression()
        while self.take(":"):
            colons += 1
            if not self.at("]", ":"):
                self.expression()
        if colons > 2:
            self.fail()
        self.need("]")

    def literal(self) -> None:
        self.inside(self.elements)

    def elements(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.at("}"):
                self.need(",")

    def element(self) -> None:
        if self.at("{"):
            self.elements()
        else:
            self.expression()
