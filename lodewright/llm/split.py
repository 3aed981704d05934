"""Oversized texts cut into pieces under a limit, at natural boundaries, with an overlap.

A text is worked on in ranges of RANGE characters (files: FILE_RANGE bytes), each with a halo of LIMIT characters on both
sides. Every range has an anchor, the best boundary among its first LIMIT characters, judged by a window of LIMIT
characters on both sides of the range's begin that the range before it sees as well; so a worker knows both anchors
between which it cuts, and the last lines before the first, without any other range. What ranges do not know is how
many lines and pieces lie before them: their counts are stitched by prefix sums over (id, range). No group needs a whole
text, and of a file no worker reads more than its range and the halos.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewright.llm.bodies import body_span
from lodewright.session import cut

LIMIT, OVERLAP_LINES, RANGE, FILE_RANGE = 2400, 6, 1 << 13, 1 << 20
HARD, SPACE, LINE, STATEMENT, BLANK = range(5)
_LINE_END = re.compile(r"\n")
_ENDS = set(";}.!?)]\"'`>")
_GOES_ON = re.compile(r"(?:[,(\[{\\:=+\-*/&|<^%]|\b(?:and|or|not|in|is|else|return))$")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Offsets after each line break, and how natural a cut there is."""
    at, kind = [], []
    start = 0
    for m in _LINE_END.finditer(text):
        line = text[start : m.start()].rstrip()
        start = m.end()
        at.append(start)
        if not line.strip():
            kind.append(BLANK)
        elif line[-1] in _ENDS or (not _GOES_ON.search(line[-8:]) and line[-1].isalnum() and "(" in line):
            kind.append(STATEMENT)
        else:
            kind.append(LINE)
    return at, kind


def best_cut(text: str, at: list[int], kind: list[int], lo: int, hi: int) -> int:
    """The cut in (lo, hi]: the last blank line of the second half, else the last blank line or end of a statement,
    else the last line end, else after the last white space, else hi."""
    a, b = bisect_right(at, lo), bisect_right(at, hi)
    middle = (lo + hi) // 2
    for k in range(b - 1, a - 1, -1):
        if at[k] <= middle:
            break
        if kind[k] == BLANK:
            return at[k]
    for k in range(b - 1, a - 1, -1):
        if kind[k] >= STATEMENT:
            return at[k]
    if b > a:
        return at[b - 1]
    return next((p + 1 for p in range(hi - 1, lo - 1, -1) if text[p].isspace()), hi)


def anchor(text: str, lo: int, limit: int) -> int:
    """Where the range that begins at lo starts its pieces: the first most natural boundary of its first limit characters.

    Only the limit + 1 characters before lo and the limit after it are looked at, which both ranges at this border hold.
    """
    zero, end = max(0, lo - limit - 1), min(lo + limit, len(text))
    at, kind = boundaries(text[zero:end])
    a, b = bisect_left(at, lo - zero), bisect_left(at, end - zero)
    if b > a:
        best = max(kind[a:b])
        return zero + at[a + kind[a:b].index(best)]
    return next((p for p in range(lo, end) if text[p - 1].isspace()), lo)


def cuts(text: str, first: int, last: int, at: list[int], kind: list[int], limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, int]]:
    """(begin, new, end) of each piece of text[first:last]; text before first may be repeated, begin..new is what is."""
    out, p = [], first
    while p < last:
        k = bisect_left(at, p)
        begin = p
        if p and k < len(at) and at[k] == p:  # only after a whole line
            after = at[k + 1] if k + 1 < len(at) else last
            room = limit - (min(after, last) - p)
            for j in range(k - 1, max(k - 1 - overlap, -2), -1):
                line = at[j] if j >= 0 else 0
                if p - line > room:
                    break
                begin = line
        end = last if last - begin <= limit else best_cut(text, at, kind, p, min(last, begin + limit))
        out.append((begin, p, end))
        p = end
    return out


def range_pieces(text: str, lo: int, hi: int, whole: bool, more: bool, limit: int = LIMIT, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, int]]:
    """Pieces of the range [lo, hi) of text, which holds its halos; whole: it is the text's first range, more: another follows."""
    at, kind = boundaries(text)
    first = lo if whole else anchor(text, lo, limit)
    last = anchor(text, hi, limit) if more else len(text)
    return cuts(text, first, last, at, kind, limit, overlap)


def _body_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["id", "record_id", "line_start", "rng", "lo", "left", "size", "first", "more", "n_lines", "text"]
    for pdf in batches:
        out = []
        for i, rid, line, text in zip(pdf["id"], pdf["record_id"], pdf["line_start"], pdf["display_content"]):
            span = body_span(text)
            if span is None or span[1] - span[0] <= LIMIT:
                continue
            b0, b1 = span
            for r, lo in enumerate(range(b0, b1, RANGE)):
                hi, left = min(lo + RANGE, b1), max(b0, lo - LIMIT - 1)
                out.append((i, rid, None if pd.isna(line) else int(line), r, lo - b0, lo - left, hi - lo, r == 0, hi < b1, text.count("\n", lo, hi), text[left : min(b1, hi + LIMIT)]))
        yield pd.DataFrame(out, columns=names).astype({"line_start": "Int32"})


_RANGES = "id long, record_id string, line_start int, rng int, lo long, left int, size int, first boolean, more boolean, n_lines long, text string"
_PIECES = "id long, record_id string, rng int, line_start long, line_end long, char_start long, char_new long, char_end long, text string"


def _cut_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            base = (1 if pd.isna(r.line_start) else int(r.line_start)) + int(r.lines_before)
            zero = r.lo - r.left  # text's first character in the whole
            at_lo = r.text.count("\n", 0, r.left)
            for begin, new, end in range_pieces(r.text, r.left, r.left + r.size, r.first, r.more):
                lines = lambda p: base + r.text.count("\n", 0, p) - at_lo  # noqa: B023, E731
                out.append((r.id, r.record_id, r.rng, lines(begin), lines(end - 1), zero + begin, zero + new, zero + end, r.text[begin:end]))
        yield pd.DataFrame(out, columns=names)


def split_records(records: DataFrame) -> DataFrame:
    """(id, parent_record_id, piece, line_start, line_end, char_start, char_new, char_end, text): pieces of bodies over 2,400 characters.

    Pieces count from 1 in order; text[char_new:char_end] of all pieces in order is the body, text[char_start:char_new]
    is repeated: the last 6 lines before, fewer if they and the next line do not fit. A line longer than the limit is
    cut after its last white space within the limit, or hard where there is none. Records with shorter, null or unfenced bodies have no pieces;
    a null line_start counts as 1. Rows delivered twice give one set of pieces; rows without an id and empty tables none.
    """
    long = records.select("id", "record_id", "line_start", "display_content").filter((F.length("display_content") > LIMIT) & F.col("id").isNotNull()).dropDuplicates(["id"])
    ranges = cut(long.mapInPandas(_body_ranges, _RANGES))
    w = Window.partitionBy("id").orderBy("rng")
    slim = ranges.filter(F.col("more") | ~F.col("first")).select("id", "rng", "n_lines")
    before = slim.select("id", "rng", F.coalesce(F.sum("n_lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lines_before"))
    alone = ranges.filter(~F.col("more") & F.col("first")).withColumn("lines_before", F.lit(0).cast("long"))
    stitched = ranges.filter(F.col("more") | ~F.col("first")).join(before, ["id", "rng"]).select(*alone.columns)
    return numbered(stitched.unionByName(alone).mapInPandas(_cut_ranges, _PIECES)).withColumnRenamed("record_id", "parent_record_id")


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with their ordinal: counts per range are summed up, then added to the place within the range."""
    pieces = cut(pieces)
    n = pieces.groupBy("id", "rng").agg(F.count(F.lit(1)).alias("n"))
    n = n.select("id", "rng", (F.sum("n").over(Window.partitionBy("id").orderBy("rng")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("id", "rng").orderBy("char_new"))
    out = pieces.withColumn("place", place).join(n, ["id", "rng"])
    return out.select("id", "record_id", (F.col("before") + F.col("place")).alias("piece"), "line_start", "line_end", "char_start", "char_new", "char_end", "text")


def _range_of_file(path: str, n: int, lo: int, hi: int):
    """(text, first character of the range, its characters, byte of the first character, lines in the range) with halos.

    Invalid bytes are kept as surrogates, so that lengths in bytes stay exact.
    """
    halo = 4 * (LIMIT + 1)
    a, z = max(0, lo - halo), min(n, hi + halo)
    fs, name = pafs.FileSystem.from_uri(path)  # file, hdfs and object stores alike
    with fs.open_input_file(name) as f:
        raw = f.read_at(z - a, a)

    def whole(p: int) -> int:
        """The first byte from p on that begins a character."""
        return next((q for q in range(p, min(p + 4, len(raw))) if raw[q] & 0xC0 != 0x80), min(p, len(raw)))

    start, at_lo, at_hi = whole(0) if a else 0, whole(lo - a) if lo else 0, whole(hi - a) if hi < n else len(raw)
    stop = len(raw) if z == n else next((q for q in range(len(raw) - 1, max(len(raw) - 5, at_hi - 1), -1) if raw[q] & 0xC0 != 0x80), len(raw))
    parts = [raw[i:j].decode("utf-8", "surrogateescape") for i, j in ((start, at_lo), (at_lo, at_hi), (at_hi, max(at_hi, stop)))]
    left = parts[0][-(LIMIT + 1) :]
    text = left + parts[1] + parts[2][:LIMIT]
    return text, len(left), len(parts[1]), a + at_lo - len(left.encode("utf-8", "surrogateescape")), parts[1].count("\n")


def split_files(spark: SparkSession, paths: list[str] | str, range_bytes: int = FILE_RANGE) -> DataFrame:
    """(path, piece, line_start, line_end, byte_new, byte_end, text): pieces of UTF-8 files, read by byte ranges.

    paths is what Spark's readers take; files are listed by Spark without reading them, and each task reads its
    range and the halos only, through the file system that the path names. Line and piece counts are stitched as for
    records. text is the new part of a piece after what it repeats; invalid bytes read as U+FFFD and keep their
    place in the offsets. Files up to the limit give one piece, empty files none.
    """
    sizes = spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0")
    ranges = sizes.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("rng", "lo"))
    names = ["id", "rng", "n_lines", "line_start", "line_end", "char_new", "byte_new", "byte_end", "text"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, n, r, lo in pdf.itertuples(index=False):
                hi = min(lo + range_bytes, n)
                text, left, size, at, n_lines = _range_of_file(path, n, lo, hi)
                rows, upto, at_lo = [(path, r, n_lines, 0, 0, -1, 0, 0, None)], 0, text.count("\n", 0, left)
                for begin, new, end in range_pieces(text, left, left + size, lo == 0, hi < n):
                    b_new = at + len(text[upto:new].encode("utf-8", "surrogateescape"))
                    b_end = b_new + len(text[new:end].encode("utf-8", "surrogateescape"))
                    upto, at = end, b_end
                    lines = [text.count("\n", 0, p) - at_lo for p in (begin, end - 1)]
                    shown = "".join(c if not "\udc80" <= c <= "\udcff" else "\ufffd" for c in text[begin:end])
                    rows.append((path, r, 0, *lines, b_new, b_new, b_end, shown))
                yield pd.DataFrame(rows, columns=names)

    schema = "id string, rng int, n_lines long, line_start long, line_end long, char_new long, byte_new long, byte_end long, text string"
    done = cut(ranges.select("path", "length", "rng", "lo").repartition("path", "rng").mapInPandas(work, schema))
    w = Window.partitionBy("id").orderBy("rng")
    n = done.groupBy("id", "rng").agg(F.sum("n_lines").alias("n_lines"), F.count("text").alias("n"))
    n = n.select("id", "rng", (F.sum("n_lines").over(w) - F.col("n_lines")).alias("lines_before"), (F.sum("n").over(w) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("id", "rng").orderBy("byte_new"))
    out = done.filter("text IS NOT NULL").withColumn("place", place).join(n, ["id", "rng"])
    line = lambda c: (F.col(c) + F.col("lines_before") + 1).alias(c)
    return out.select(F.col("id").alias("path"), (F.col("before") + F.col("place")).alias("piece"), line("line_start"), line("line_end"), "byte_new", "byte_end", "text")
