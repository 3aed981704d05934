"""Chunks, definitions and call edges of files, in Python workers over Arrow batches.

A file is one row and its state is sequential, so each is parsed by one worker; files are independent of each other.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodewright.parse.extracts import NON_CALLS

MAX_CHARS, OVERLAP, MAX_REFS, CLIPPED = 2400, 6, 80, " [line truncated]"
RECORD = "record_type string, record_id string, parent_record_id string, symbol string, symbol_kind string, line_start int, line_end int, body string, refs array<string>"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_SKIP = frozenset(NON_CALLS)


def clip(line: str, limit: int) -> str:
    """A line that fits a chunk by itself."""
    return line if len(line) <= limit else line[: limit - 22].rstrip() + CLIPPED


def line_windows(lines: list[tuple[int, str]], limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[list[tuple[int, str]]]:
    """Numbered lines filled up to limit characters with their breaks; each window begins with the last lines of the one before."""
    out: list[list[tuple[int, str]]] = []
    now: list[tuple[int, str]] = []
    size = 0
    for n, raw in lines:
        line = clip(raw, limit)
        if now and size + len(line) + 1 > limit:
            out.append(now)
            now = now[-overlap:] if overlap else []
            size = sum(len(x) + 1 for _, x in now)
        now.append((n, line))
        size += len(line) + 1
    return out + [now] if now else out


_MARK = re.compile(r"""[/"'`{};]""")
_UNQUOTE = {q: re.compile(rf"[\\{q}]") for q in "\"'`"}


def brace_end(lines: list[str], start: int) -> int | None:
    """The line where the block that opens at or soon after start closes, however far; strings and comments are passed over."""
    depth, opened, comment, quote = 0, False, False, ""
    for i in range(start, len(lines)):
        line, k = lines[i], 0
        while k < len(line):
            if comment:
                k = line.find("*/", k)
                if k < 0:
                    break
                comment, k = False, k + 2
                continue
            m = (_UNQUOTE[quote] if quote else _MARK).search(line, k)
            if not m:
                break
            k = m.start()
            two, c = line[k : k + 2], line[k]
            if quote:
                if c == "\\":
                    k += 1
                elif c == quote:
                    quote = ""
            elif two == "//":
                break
            elif two == "/*":
                comment, k = True, k + 1
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i
            elif c == ";" and not opened and depth == 0:
                return None
            k += 1
        if quote in ("'", '"'):
            quote = ""
    return None


# how definitions of brace languages begin: (kind, pattern with the groups owner and name)
_ID = r"[A-Za-z_$][\w$]*"
BRACES: dict[str, list[tuple[str, re.Pattern]]] = {
    "c": [("function", re.compile(rf"^(?!\s|#|else\b|return\b|typedef\b)(?:[\w*]+[\s*]+)+\*?(?P<name>{_ID})\s*\([^;]*$")), ("struct", re.compile(rf"^\s*(?:typedef\s+)?(?:struct|union)\s+(?P<name>{_ID})\s*\{{?\s*$")), ("enum", re.compile(rf"^\s*(?:typedef\s+)?enum\s+(?P<name>{_ID})\s*\{{"))],
    "go": [("method", re.compile(rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>{_ID})")), ("function", re.compile(rf"^func\s+(?P<name>{_ID})")), ("struct", re.compile(rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+struct\b")), ("interface", re.compile(rf"^type\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+interface\b"))],
    "javascript": [("class", re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})")), ("function", re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*[(<]")), ("function", re.compile(rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{_ID}\s*=>)")), ("interface", re.compile(rf"^\s*(?:export\s+)?interface\s+(?P<name>{_ID})")), ("method", re.compile(rf"^\s+(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<name>{_ID})\s*\([^)]*\)\s*\{{\s*$"))],
    "rust": [("function", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>{_ID})")), ("struct", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>{_ID})")), ("enum", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>{_ID})")), ("interface", re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>{_ID})")), ("impl", re.compile(rf"^\s*impl\b(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{_ID})"))],
    "shell": [("shell_function", re.compile(r"^\s*(?:function\s+)?(?P<name>[A-Za-z_]\w*)\s*(?:\(\))?\s*\{\s*$"))],
    "dts": [("dts_node", re.compile(r"^\s*(?:\w+\s*:\s*)?(?P<name>[\w,.-]+(?:@[0-9a-fA-F]+)?|/)\s*\{\s*$"))],
}
BRACES["typescript"] = BRACES["javascript"]
BRACES["java"] = [("class", re.compile(rf"^\s*(?:public|private|protected|abstract|final|static|\s)*(?:class|interface|enum|record)\s+(?P<name>{_ID})")), ("method", re.compile(rf"^\s+(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[\w<>\[\], ]+\s+(?P<name>{_ID})\s*\([^;]*$"))]


def calls(body: str, skip: set[str] = frozenset()) -> list[str]:
    """Names called in body, the owner's last part kept with a member; sorted, keywords and skip left out."""
    got = set()
    for m in _CALL.finditer(body):
        parts = m[1].split(".")
        name = ".".join(parts[-2:])
        if parts[-1] not in _SKIP and name not in skip and parts[-1] not in skip:
            got.add(name)
    return sorted(got)[:160]


def python_definitions(text: str) -> list[tuple[str, str, int, int]]:
    """(qualified name, kind, first line with decorators, last line)."""
    out: list[tuple[str, str, int, int]] = []

    def visit(node: ast.AST, owner: list[str], in_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(x, ast.ClassDef)
                first = min([x.lineno, *(d.lineno for d in x.decorator_list)])
                out.append((".".join([*owner, x.name]), "class" if is_class else "method" if in_class else "function", first, x.end_lineno or x.lineno))
                visit(x, [*owner, x.name], is_class)
            else:
                visit(x, owner, in_class)

    visit(ast.parse(text), [], False)
    return sorted(out, key=lambda d: (d[2], d[0]))


def brace_definitions(text: str, language: str) -> list[tuple[str, str, int, int]]:
    lines = text.split("\n")
    out, spans = [], []
    for i, line in enumerate(lines):
        for kind, p in BRACES[language]:
            m = p.match(line)
            if not m or m["name"] in _SKIP:
                continue
            end = brace_end(lines, i)
            if end is None:
                break
            if kind == "impl":
                spans.append((m["name"], i, end, "::"))
                break
            owner = m.groupdict().get("owner")
            inside = [s for s in spans if s[1] < i <= s[2]]
            joint = inside[-1][3] if inside else "."
            name = f"{owner}.{m['name']}" if owner else joint.join([*(s[0] for s in inside[-1:]), m["name"]])
            if kind in ("class", "interface", "struct"):
                spans.append((m["name"], i, end, "."))
            out.append((name, "method" if inside and kind == "function" else kind, i + 1, end + 1))
            break
    return out


def records_of(path: str, language: str, text: str) -> list[tuple]:
    """Records of a file: definitions with a chunk each, then what no definition covers; without definitions line windows.

    A file that fails to parse becomes line windows.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    try:
        found = python_definitions(text) if language == "python" else brace_definitions(text, language) if language in BRACES else []
    except (SyntaxError, ValueError, RecursionError):
        found = []
    out: list[tuple] = []
    covered: set[int] = set()
    blocks = kconfig_records(text) if language == "kconfig" else make_records(text) if language == "make" else []
    for name, kind, a, b, body, refs in blocks:
        out.append(("config_symbol" if language == "kconfig" else kind, f"{path}::{kind}::{name}::{a:06d}", None, name, kind, a, b, body, refs))
        covered.update(range(a, b + 1))
    found = found if not blocks else []
    for name, kind, a, b in found:
        body = "\n".join(lines[a - 1 : b])
        rid = f"{path}::{kind}::{name}::{a:06d}"
        refs = calls(body, {name, name.rsplit(".", 1)[-1]})
        out.append(("symbol_definition", rid, None, name, kind, a, b, body, refs))
        for w in line_windows(list(enumerate(lines[a - 1 : b], a))):
            out.append(("code_chunk", f"{path}::chunk::{w[0][0]:06d}-{w[-1][0]:06d}", rid, name, kind, w[0][0], w[-1][0], "\n".join(x for _, x in w), []))
        covered.update(range(a, b + 1))
    if not found and not blocks:
        for w in line_windows(list(enumerate(lines, 1))):
            body = "\n".join(x for _, x in w)
            if body.strip():
                out.append(("code_chunk", f"{path}::chunk::{w[0][0]:06d}-{w[-1][0]:06d}", None, None, None, w[0][0], w[-1][0], body, calls(body)))
        return out
    rest = [(n, x) for n, x in enumerate(lines, 1) if n not in covered and x.strip()]
    for k, w in enumerate(line_windows(rest, MAX_CHARS, 0), 1):
        body = "\n".join(x for _, x in w)
        out.append(("module_chunk", f"{path}::module_chunk::{k:06d}", None, None, None, w[0][0], w[-1][0], body, calls(body)[:MAX_REFS]))
    return out


def patch_records(text: str) -> list[tuple[str, int, int, str]]:
    """(file, first line, last line, hunk header) of the hunks of a unified diff."""
    out: list[tuple[str, int, int, str]] = []
    file, start, head = "", 0, ""
    lines = text.split("\n")
    for n, line in enumerate([*lines, "diff --git"], 1):
        if head and (line.startswith(("@@", "diff --git", "--- "))):
            out.append((file, start, n - 1, head))
            head = ""
        if line.startswith("+++ "):
            file = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif line.startswith("@@"):
            start, head = n, line
    return out


def _map(fn: Callable[[str, str, str], list[tuple]], names: list[str]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, p, k, t in zip(pdf["file_id"], pdf["path"], pdf["language"], pdf["text"]) if t is not None for r in fn(p, k or "", t)]
            yield pd.DataFrame(rows, columns=["file_id", *names])

    return work


def parse_files(files: DataFrame) -> DataFrame:
    """Records of files (file_id, path, language, text); null texts have none, rows that repeat are parsed again."""
    return files.select("file_id", "path", "language", "text").mapInPandas(_map(records_of, _NAMES), f"file_id long, {RECORD}")


def scan_patches(files: DataFrame) -> DataFrame:
    return files.select("file_id", "path", "language", "text").mapInPandas(_map(lambda p, k, t: patch_records(t), ["file", "line_start", "line_end", "hunk"]), "file_id long, file string, line_start int, line_end int, hunk string")


def kconfig_records(text: str) -> list[tuple[str, str, int, int, str, list[str]]]:
    """(symbol, kind, first line, last line, body, symbols it depends on or selects) of config and menuconfig blocks."""
    lines = text.split("\n")
    heads = [(i, m) for i, x in enumerate(lines) if (m := re.match(r"^\s*(config|menuconfig|choice|menu|endmenu|endchoice|if|endif|source|comment)\b\s*(\w*)", x))]
    out = []
    for (i, m), nxt in zip(heads, [*(h[0] for h in heads[1:]), len(lines)]):
        if m[1] in ("config", "menuconfig") and m[2]:
            body = "\n".join(lines[i:nxt]).rstrip()
            refs = re.findall(r"\b[A-Z][A-Z0-9_]+\b", "\n".join(re.findall(r"(?m)^\s*(?:depends on|select|imply|default .* if)\s+(.*)$", body)))
            out.append((f"CONFIG_{m[2]}", m[1], i + 1, i + 1 + body.count("\n"), body, sorted(set(refs))))
    return out


def make_records(text: str) -> list[tuple[str, str, int, int, str, list[str]]]:
    """(name, kind, first line, last line, body, names used) of define blocks, top-level assignments and targets of a Makefile."""
    lines = text.split("\n")
    out, i = [], 0
    while i < len(lines):
        start = i
        if m := re.match(r"^define\s+(\S+)", lines[i]):
            while i < len(lines) - 1 and not re.match(r"^endef\b", lines[i]):
                i += 1
            kind, name = "make_define", m[1]
        elif m := re.match(r"^([A-Za-z_][\w.-]*)\s*(?:\?|:|\+|::)?=", lines[i]):
            while i < len(lines) - 1 and lines[i].endswith("\\"):
                i += 1
            kind, name = "make_assignment", m[1]
        elif m := re.match(r"^([\w./%$(){}-]+(?:\s+[\w./%$(){}-]+)*)\s*:(?!=)", lines[i]):
            while i < len(lines) - 1 and lines[i + 1].startswith("\t"):
                i += 1
            kind, name = "make_target", m[1]
        else:
            i += 1
            continue
        body = "\n".join(lines[start : i + 1])
        out.append((name, kind, start + 1, i + 1, body, sorted(set(re.findall(r"\$[({](\w+)[)}]", body)))))
        i += 1
    return out
