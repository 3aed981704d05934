"""Recogniser of ECMAScript scripts and modules, after the language specification, with automatic semicolons."""

from __future__ import annotations

import re

from lodewright.llm.grammars.stream import MEMO, Invalid, Shapes, Stream, head, refused

END = "\x00"
_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_CONTEXT = frozenset("let static async of get set await yield from as target meta accessor".split())
_MARKS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . #i @".split()
_SHAPES = Shapes(_RESERVED | _CONTEXT, _MARKS, r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4})*", r"(?<![\w$])(?:0[xX][0-9a-fA-F_]+n?|0[bBoO][0-7_]+n?|\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?![\w$])", "[\ue000\ue001\ue002]")
_STRING, _TEMPLATE, _REGEX = "\ue000", "\ue001", "\ue002"
_LITERAL = re.compile(r"""//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\(?s:.))*"|'(?:[^'\\\n]|\\(?s:.))*'|[`/"']""")
_REGEX_BODY = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield|await)$")
_BINARY = frozenset("?? || && | ^ & == != === !== < > <= >= instanceof in << >> >>> + - * / % **".split())
_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_STARTS = frozenset(["i", "0", _STRING, _TEMPLATE, _REGEX, "(", "[", "{", "+", "-", "!", "~", "++", "--", "function", "class", "new", "this", "super", "null", "true", "false", "typeof", "void", "delete", "import", "#i", *_CONTEXT])
_KNOWN: set = set()


def _blank_literals(text: str) -> tuple[str, list[str]]:
    """text with comments and literals replaced, and the expressions inside its templates."""
    out, inner, pos, operand = [], [], 0, False
    while m := _LITERAL.search(text, pos):
        between = text[pos : m.start()]
        out.append(between)
        seen = between.rstrip()
        s, pos = m[0], m.end()
        if s == "/":
            if seen:
                divides = (seen[-1] in ")]" or seen[-1].isalnum() or seen[-1] in "_$") and not _BEFORE_REGEX.search(seen[-12:])
            else:
                divides = operand
            r = None if divides else _REGEX_BODY.match(text, m.start())
            out.append(_REGEX if r else "/")
            pos = r.end() if r else pos
            operand = bool(r)
        elif s == "`":
            pos = _template(text, pos, inner)
            out.append(_TEMPLATE)
            operand = True
        elif s[0] == "/":
            out.append("\n" if "\n" in s else " ")
            operand = operand and not seen or bool(seen) and (seen[-1].isalnum() or seen[-1] in ")]_$")
        elif len(s) == 1:
            raise Invalid("a string without end")
        else:
            out.append(_STRING)
            operand = True
    out.append(text[pos:])
    return "".join(out), inner


def _template(text: str, pos: int, inner: list[str]) -> int:
    """Where the template that begins before pos ends; its expressions are added to inner."""
    while pos < len(text):
        c = text[pos]
        if c == "\\":
            pos += 2
        elif c == "`":
            return pos + 1
        elif c == "$" and text.startswith("{", pos + 1):
            start, depth, pos = pos + 2, 1, pos + 2
            while depth:
                if pos >= len(text):
                    raise Invalid("a template without end")
                c = text[pos]
                if c == "`":
                    pos = _template(text, pos + 1, [])
                    continue
                if c in "\"'":
                    m = _LITERAL.match(text, pos)
                    pos = m.end()
                    continue
                depth += (c == "{") - (c == "}")
                pos += 1
            inner.append(text[start : pos - 1])
        else:
            pos += 1
    raise Invalid("a template without end")


def _stream(text: str, known: set = _KNOWN) -> tuple[_JavaScript, list[str]]:
    blank, inner = _blank_literals(text)
    shape = _SHAPES.shape(blank)
    tokens: list[str] = []
    first: dict[int, tuple[str, int]] = {}
    for line in shape.split("\n"):
        line = line.strip()
        if not line:
            continue
        at = len(tokens)
        tokens += _SHAPES.of_line(line)
        first[at] = (line, len(tokens))
    tokens += [END, END, END]
    first[len(tokens) - 3] = ("", len(tokens) - 3)
    return _JavaScript(tokens, first, known), inner


def parse(text: str) -> bool:
    text = text[1:] if text.startswith("\ufeff") else text
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n")
    if text.startswith("#!"):
        text = "//" + text
    if (first := head(text)) and refused(s := _stream(first, set())[0], 3, s.program):
        raise Invalid("in its first lines")
    s, inner = _stream(text)
    s.program()
    while inner:
        s, more = _stream(inner.pop())
        s.function = 1
        s.expression()
        if not s.at(END):
            s.fail()
        inner += more
    return True


class _JavaScript(Stream):
    __slots__ = ("function", "no_in")

    def __init__(self, *a):
        super().__init__(*a)
        self.function, self.no_in = 0, False

    def program(self) -> None:
        while not self.at(END):
            self.item()

    def newline(self) -> bool:
        return self.p in self.first

    def semicolon(self) -> None:
        if self.take(";") or self.at("}", END) or self.newline():
            return
        self.fail()

    def name(self) -> None:
        w = self.t[self.p]
        if w != "i" and w not in _CONTEXT:
            self.fail()
        self.p += 1

    def is_name(self, k: int = 0) -> bool:
        w = self.t[self.p + k]
        return w == "i" or w in _CONTEXT

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.at(END):
                self.fail()
            self.item()

    def item(self) -> None:
        got = self.first.get(self.p)
        key = (got[0], self.function > 0) if got else None
        if key in self.known:
            nxt = self.t[got[1]]
            if nxt in _STARTS and nxt not in "([+-++--" and nxt not in (_TEMPLATE, _REGEX) or nxt in ("}", END) or self.t[got[1] - 1] in ";}":
                self.p = got[1]
                return
        self.statement()
        # ends with a mark, so what follows on the next line cannot continue it
        if got and self.p == got[1] and self.t[self.p - 1] in (";", "}") and not self.at("else", "catch", "finally", "while"):
            if len(self.known) > MEMO:
                self.known.clear()
            self.known.add(key)

    def statement(self) -> None:
        w = self.t[self.p]
        if w == "i":
            if self.t[self.p + 1] == ":":
                self.p += 2
                return self.statement()
            return self.expression_statement()
        if w == "{":
            return self.block()
        if w == ";":
            self.p += 1
        elif w in ("var", "const") or w == "let" and (self.is_name(1) or self.t[self.p + 1] in ("[", "{")):
            self.p += 1
            self.bindings()
            self.semicolon()
        elif w == "function" or w == "async" and self.t[self.p + 1] == "function" and (self.p + 1) not in self.first:
            self.function_(True)
        elif w == "class":
            self.class_(True)
        elif w == "@":
            self.p += 1
            self.unary_member()
            self.statement()
        elif w == "if":
            self.p += 1
            self.condition()
            self.item()
            if self.take("else"):
                self.item()
        elif w == "for":
            self.for_()
        elif w == "while":
            self.p += 1
            self.condition()
            self.item()
        elif w == "do":
            self.p += 1
            self.item()
            self.need("while")
            self.condition()
            self.take(";")
        elif w in ("return", "throw", "break", "continue"):
            self.p += 1
            if w == "return" and not self.function:
                self.fail()
            if w in ("return", "throw"):
                if not (self.at(";", "}", END) or self.newline()):
                    self.expression()
                elif w == "throw":
                    self.fail()
            elif self.is_name() and not self.newline():
                self.p += 1
            self.semicolon()
        elif w == "switch":
            self.p += 1
            self.condition()
            self.need("{")
            while not self.take("}"):
                if self.take("case"):
                    self.expression()
                else:
                    self.need("default")
                self.need(":")
                while not self.at("case", "default", "}"):
                    if self.at(END):
                        self.fail()
                    self.item()
        elif w == "try":
            self.p += 1
            self.block()
            caught = False
            if self.take("catch"):
                caught = True
                if self.take("("):
                    self.target()
                    self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif not caught:
                self.fail()
        elif w == "debugger":
            self.p += 1
            self.semicolon()
        elif w == "with":
            self.p += 1
            self.condition()
            self.item()
        elif w == "import" and self.t[self.p + 1] not in ("(", "."):
            self.import_()
        elif w == "export":
            self.export()
        elif w in _CONTEXT and self.t[self.p + 1] == ":":
            self.p += 2
            self.statement()
        else:
            self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def condition(self) -> None:
        self.need("(")
        self.inside(self.expression)
        self.need(")")

    def inside(self, what, *a) -> None:
        no_in, self.no_in = self.no_in, False
        what(*a)
        self.no_in = no_in

    def bindings(self, header: bool = False) -> bool:
        """Declared names; whether one pattern or constant lacks its value, which for-in and for-of allow."""
        bare = False
        while True:
            pattern = self.at("[", "{")
            self.target()
            if self.take("="):
                self.assignment()
            elif pattern:
                bare = True
            if not self.take(","):
                break
        if bare and not header:
            self.fail()
        return bare

    def target(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.element()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.name()
                else:
                    named = self.is_name()
                    self.key()
                    if self.take(":"):
                        self.element()
                    elif not named:
                        self.fail()
                    elif self.take("="):
                        self.inside(self.assignment)
                if not self.at("}"):
                    self.need(",")
        else:
            self.name()

    def element(self) -> None:
        self.target()
        if self.take("="):
            self.inside(self.assignment)

    def key(self) -> None:
        w = self.t[self.p]
        self.p += 1
        if w == "[":
            self.inside(self.assignment)
            self.need("]")
        elif not (w in ("i", "0", _STRING, "#i") or w in _CONTEXT or w in _RESERVED):
            self.p -= 1
            self.fail()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            rest = self.take("...")
            self.element()
            if not self.at(")"):
                if rest:
                    self.fail()
                self.need(",")

    def body(self) -> None:
        self.function += 1
        self.inside(self.block)
        self.function -= 1

    def function_(self, named: bool) -> None:
        self.take("async")
        self.need("function")
        self.take("*")
        if named or self.is_name():
            self.name()
        self.parameters()
        self.body()

    def class_(self, named: bool) -> None:
        self.need("class")
        if named or self.is_name():
            self.name()
        if self.take("extends"):
            self.unary_member()
        self.need("{")
        while not self.take("}"):
            if self.at(END):
                self.fail()
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        while self.take("@"):
            self.unary_member()
        after = ("(", "=", ";", "}", ":", ",")
        if self.at("static") and self.t[self.p + 1] not in after:
            self.p += 1
            if self.at("{"):
                return self.body()
        for w in ("async", "get", "set", "accessor"):
            if self.at(w) and self.t[self.p + 1] not in after and (self.p + 1) not in self.first:
                self.p += 1
                break
        self.take("*")
        self.key()
        if self.at("("):
            self.parameters()
            return self.body()
        if self.take("="):
            self.function += 1
            self.inside(self.assignment)
            self.function -= 1
        self.semicolon()

    def for_(self) -> None:
        self.need("for")
        self.take("await")
        self.need("(")
        w = self.t[self.p]
        if not self.at(";"):
            no_in, self.no_in = self.no_in, True
            bare = False
            if w in ("var", "const") or w == "let" and (self.is_name(1) or self.t[self.p + 1] in ("[", "{")):
                self.p += 1
                bare = self.bindings(True)
            else:
                self.expression()
            self.no_in = no_in
            if self.at("of", "in"):
                self.p += 1
                self.inside(self.expression)
                self.need(")")
                return self.item()
            if bare:
                self.fail()
        self.need(";")
        if not self.at(";"):
            self.inside(self.expression)
        self.need(";")
        if not self.at(")"):
            self.inside(self.expression)
        self.need(")")
        self.item()

    def import_(self) -> None:
        self.need("import")
        if not self.take(_STRING):
            if not self.at("{", "*"):
                self.name()
                if not self.take(","):
                    self.need("from")
                    self.need(_STRING)
                    return self.attributes()
            if self.take("*"):
                self.need("as")
                self.name()
            else:
                self.specifiers()
            self.need("from")
            self.need(_STRING)
        self.attributes()

    def attributes(self) -> None:
        if self.at("with") and not self.newline():
            self.p += 1
            self.unary_member()
        self.semicolon()

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.key()
            if self.take("as"):
                self.key()
            if not self.at("}"):
                self.need(",")

    def export(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.at("function") or self.at("async") and self.t[self.p + 1] == "function":
                return self.function_(False)
            if self.at("class"):
                return self.class_(False)
            self.assignment()
            return self.semicolon()
        if self.take("*"):
            if self.take("as"):
                self.key()
            self.need("from")
            self.need(_STRING)
            return self.attributes()
        if self.at("{"):
            self.specifiers()
            if self.take("from"):
                self.need(_STRING)
                return self.attributes()
            return self.semicolon()
        if not self.at("var", "let", "const", "function", "class", "async", "@"):
            self.fail()
        self.statement()

    def expression(self) -> str:
        kind = self.assignment()
        while self.take(","):
            kind = self.assignment()
        return kind

    def arrow_ahead(self) -> bool:
        """Whether the parenthesis here closes before an arrow."""
        depth, k = 0, self.p
        while True:
            w = self.t[k]
            if w in ("(", "[", "{"):
                depth += 1
            elif w in (")", "]", "}"):
                depth -= 1
                if not depth:
                    return self.t[k + 1] == "=>"
            elif w == END:
                return False
            k += 1

    def arrow(self) -> str:
        self.need("=>")
        if self.at("{"):
            self.body()
        else:
            self.function += 1
            self.assignment()
            self.function -= 1
        return "value"

    def assignment(self) -> str:
        w = self.t[self.p]
        if w == "yield" and self.function and (self.t[self.p + 1] in _STARTS or self.t[self.p + 1] in ("*", ")", "]", "}", ",", ";", ":")):
            self.p += 1
            if not self.newline() and (self.take("*") or self.t[self.p] in _STARTS):
                self.assignment()
            return "value"
        if w == "async" and (self.p + 1) not in self.first:
            if self.is_name(1) and self.t[self.p + 2] == "=>":
                self.p += 2
                return self.arrow()
            if self.t[self.p + 1] == "(":
                self.p += 1
                if self.arrow_ahead():
                    self.parameters()
                    return self.arrow()
                self.p -= 1
        if self.is_name() and self.t[self.p + 1] == "=>":
            self.p += 1
            return self.arrow()
        if w == "(" and self.arrow_ahead():
            self.parameters()
            return self.arrow()
        kind = self.conditional()
        w = self.t[self.p]
        if w == "=":
            if kind not in ("ref", "pattern"):
                self.fail()
            self.p += 1
            self.assignment()
            return "value"
        if w in _ASSIGN:
            if kind != "ref":
                self.fail()
            self.p += 1
            self.assignment()
            return "value"
        return kind

    def conditional(self) -> str:
        kind = self.binary()
        if self.take("?"):
            self.inside(self.assignment)
            self.need(":")
            self.assignment()
            return "value"
        return kind

    def binary(self) -> str:
        kind = self.unary()
        while True:
            w = self.t[self.p]
            if w not in _BINARY or w == "in" and self.no_in:
                return kind
            self.p += 1
            self.unary()
            kind = "value"

    def unary(self) -> str:
        w = self.t[self.p]
        if w in ("+", "-", "!", "~", "typeof", "void", "delete"):
            self.p += 1
            self.unary()
            return "value"
        if w in ("++", "--"):
            self.p += 1
            if self.unary() != "ref":
                self.fail()
            return "value"
        if w == "await" and self.t[self.p + 1] in _STARTS and self.t[self.p + 1] not in ("(", "[", "+", "-", "++", "--", "of", "as", "from") and (self.p + 1) not in self.first:
            self.p += 1
            self.unary()
            return "value"
        kind = self.unary_member()
        if self.at("++", "--") and not self.newline():
            if kind != "ref":
                self.fail()
            self.p += 1
            return "value"
        return kind

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.inside(self.assignment)
            if not self.at(")"):
                self.need(",")

    def unary_member(self) -> str:
        w = self.t[self.p]
        kind = "value"
        if w == "i" or w in _CONTEXT and not (w == "async" and self.t[self.p + 1] == "function"):
            self.p += 1
            kind = "ref"
        elif w in ("0", _STRING, _TEMPLATE, _REGEX, "this", "super", "null", "true", "false"):
            self.p += 1
        elif w == "(":
            self.p += 1
            no_in, self.no_in = self.no_in, False
            kind = self.expression()
            self.no_in = no_in
            kind = "ref" if kind == "ref" else "value"
            self.need(")")
        elif w == "[":
            self.p += 1
            kind = "pattern"
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.inside(self.assignment)
                if not self.at("]"):
                    self.need(",")
        elif w == "{":
            self.object()
            kind = "pattern"
        elif w in ("function", "async"):
            self.function_(False)
        elif w == "class":
            self.class_(False)
        elif w == "new":
            self.p += 1
            if self.take("."):
                self.need("target")
            else:
                self.new_target()
        elif w == "import":
            self.p += 1
            if self.take("."):
                self.name()
            elif not self.at("("):
                self.fail()
        elif w == "#i" and self.t[self.p + 1] == "in":
            self.p += 1
        else:
            self.fail()
        while True:
            w = self.t[self.p]
            if w == ".":
                self.p += 1
                self.dotted()
                kind = "ref"
            elif w == "?.":
                self.p += 1
                if self.at("("):
                    self.arguments()
                elif self.take("["):
                    self.inside(self.expression)
                    self.need("]")
                else:
                    self.dotted()
                kind = "value"
            elif w == "[":
                self.p += 1
                self.inside(self.expression)
                self.need("]")
                kind = "ref"
            elif w == "(":
                self.arguments()
                kind = "value"
            elif w == _TEMPLATE:
                self.p += 1
                kind = "value"
            else:
                return kind

    def dotted(self) -> None:
        w = self.t[self.p]
        if not (w in ("i", "#i") or w in _CONTEXT or w in _RESERVED):
            self.fail()
        self.p += 1

    def new_target(self) -> None:
        if self.take("new"):
            self.new_target()
        elif self.at("("):
            self.condition()
        elif self.at("class"):
            self.class_(False)
        elif self.at("function"):
            self.function_(False)
        elif not self.take("this"):
            self.name()
        while self.at(".", "["):
            if self.take("."):
                self.dotted()
            else:
                self.p += 1
                self.inside(self.expression)
                self.need("]")
        if self.at("("):
            self.arguments()

    def object(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.property()
            if not self.at("}"):
                self.need(",")

    def property(self) -> None:
        if self.take("..."):
            self.inside(self.assignment)
            return
        after = ("(", ":", ",", "}", "=")
        for w in ("async", "get", "set"):
            if self.at(w) and self.t[self.p + 1] not in after:
                self.p += 1
                self.take("*")
                self.key()
                self.parameters()
                return self.body()
        if self.take("*"):
            self.key()
            self.parameters()
            return self.body()
        named = self.is_name()
        self.key()
        if self.at("("):
            self.parameters()
            self.body()
        elif self.take(":"):
            self.inside(self.assignment)
        elif not named:
            self.fail()
        elif self.take("="):
            self.inside(self.assignment)
