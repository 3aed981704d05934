"""Text search over records: term plans, match scores, ranking, snippets, full-text match.

Terms are few and known when the plan is made, so each condition is unrolled into column expressions over one
scan; the top k is a TakeOrdered, never a global sort.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERM = re.compile(r"[A-Za-z0-9_$./:+@-]+")  # fixed value
OPERATORS = ("and", "or", "not")  # fixed value
MOST_TERMS = 16
SECURITY_WORDS = ("cve", "cwe", "security", "security_pattern", "vulnerability", "vulnerabilities")  # fixed value
SEARCHED = ("title", "summary", "symbol", "source_path", "record_id", "display_content")


def query_terms(query: str) -> list[str]:
    """Distinct terms in order of appearance without operator words, 16 at most."""
    found = (t for t in TERM.findall(query) if t.lower() not in OPERATORS)
    return list(dict.fromkeys(found))[:MOST_TERMS]


def wants_security(query: str) -> bool:
    low = [t.casefold() for t in query_terms(query)]
    return any(t in SECURITY_WORDS or t.startswith(("cve-", "cwe-")) for t in low)


def looks_like_identifier(terms: list[str]) -> bool:
    """One term with a mark, digit or capital that a plain word has not."""
    return len(terms) == 1 and bool(re.fullmatch(r"[$A-Za-z_][$A-Za-z0-9_$./:+@-]*", terms[0])) and bool(re.search(r"[$_./:+@\-0-9A-Z]", terms[0]))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _has(c: Column, term: str) -> Column:
    return F.contains(F.lower(c), F.lit(term.lower()))


def match_score(terms: list[str], config_rule: bool = True) -> Column:
    """Points of a record: per term for the symbol in full, its start, title, path, key, summary and text; all add up."""
    symbol, title = _text("symbol"), _text("title")
    total: Column = F.lit(0)
    for t in terms:
        low = t.lower()
        bare = F.regexp_replace(F.lower(symbol), "^config_", "")
        points = [
            (symbol == t, 120), (F.lower(symbol) == low, 80), (F.lower(title) == low, 32), (F.lower(symbol).startswith(low), 20), (_has(title, t), 12),
            (_has(_text("source_path"), t), 8), (_has(_text("record_id"), t), 6), (_has(_text("summary"), t), 4), (_has(_text("display_content"), t), 1),
        ]
        if config_rule:
            points.append(((F.col("record_type") == "config_symbol") & (bare == low), 80))
        total = reduce(lambda acc, p: acc + F.when(p[0], p[1]).otherwise(0), points, total)
    return total


def _hits(terms: list[str]) -> list[Column]:
    whole = F.concat_ws(" ", *SEARCHED)
    return [_has(whole, t) for t in terms]


def all_terms(terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, _hits(terms), F.lit(True))


def any_terms(terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, _hits(terms), F.lit(False))


def term_count(terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [h.cast("int") for h in _hits(terms)], F.lit(0))


def text_search(records: DataFrame, query: str, limit: int, mode: str, record_type: str | None = None) -> DataFrame:
    """The best records for query; mode is all or any. Adds rank (any: terms found, all: null) and match_score.

    Records of security patterns are left out unless asked for. Ties are broken by newest update, then the greatest id.
    """
    terms = query_terms(query)
    df = records.filter(F.col("record_type") == record_type) if record_type else records
    if not record_type and not wants_security(query):
        df = df.filter("record_type <> 'security_pattern'")
    df = df.filter(all_terms(terms) if mode == "all" else any_terms(terms))
    df = df.withColumn("match_score", match_score(terms)).withColumn("rank", term_count(terms) if mode == "any" else F.lit(None).cast("int"))
    order = [F.desc("rank")] if mode == "any" else []
    return df.orderBy(*order, F.desc("match_score"), F.desc("updated_at"), F.desc("id")).limit(limit)


def planned_search(records: DataFrame, query: str, limit: int) -> tuple[str, DataFrame]:
    """The first stage that finds anything: full text, all terms, any term; or the listing for a query without terms."""
    terms = query_terms(query)
    if not terms:
        return "list", records.orderBy(F.asc_nulls_last("source_path"), F.asc_nulls_last("line_start"), "id").limit(limit)
    stages = [] if looks_like_identifier(terms) else [("websearch", lambda: full_text(records, query, limit))]
    stages += [("all_terms", lambda: text_search(records, query, limit, "all")), ("any_terms", lambda: text_search(records, query, limit, "any"))]
    for name, make in stages:
        df = make()
        if name == "any_terms" or not df.isEmpty():
            return name, df
    raise AssertionError


def location_dedupe(df: DataFrame, order: list[Column]) -> DataFrame:
    """Of rows with one (path, line_start, line_end) only the first in order, with preference for code chunks, then
    definitions; rows without lines all stay. The key's rows are those of one result page."""
    kind = F.when(F.col("record_type") == "code_chunk", 0).when(F.col("record_type") == "symbol_definition", 1).otherwise(99)
    w = Window.partitionBy("source_path", "line_start", "line_end").orderBy(kind, *order)
    return df.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | F.col("line_start").isNull() | F.col("line_end").isNull()).drop("_n")


def fenced_body(display) -> Column:
    """The text inside the fence of display_content; null without one."""
    got = F.regexp_extract(display, r"(?s)(?:^|\n)(`{3,})[^\n`]*\n(.*?)\n?\1\s*$", 2)
    return F.when(F.length(got) > 0, F.rtrim(got))


def snippet(display, terms: list[str], length: int = 200) -> Column:
    """length characters of the body around the first place where a term of three or more letters is, with dots where cut."""
    body = fenced_body(display)
    wanted = [t for t in terms if len(t) >= 3] or terms
    low = F.lower(body)
    places = [F.when(F.locate(t.lower(), low) > 0, F.locate(t.lower(), low) - 1) for t in wanted]
    at = F.array_min(F.array(*places)) if places else F.lit(None).cast("int")
    n = F.length(body)
    dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
    start0 = F.greatest(F.lit(0), F.least(at - length // 2, n - length))
    width = length - F.when(start0 > 0, 3).otherwise(0) - F.when(start0 + length < n, 3).otherwise(0)
    start = F.greatest(F.lit(0), F.least(at - F.floor(width / 2).cast("int"), n - width))
    cut = F.concat(dots(start > 0), F.rtrim(F.substr(body, start + 1, width)), dots(start + width < n))
    return F.when((n <= length) | at.isNull(), F.rtrim(F.left(body, F.lit(length)))).otherwise(cut)


# ---- full text -----------------------------------------------------------------------------------------------

STOP = frozenset("a an and are as at be but by for from has have if in into is it its no not of on or such that the their then there these they this to was were will with".split())  # fixed value
_SUFFIX = (("ational", "ate"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("ization", "ize"), ("ing", ""), ("edly", ""), ("ies", "i"), ("ied", "i"), ("ed", ""), ("es", ""), ("ly", ""), ("s", ""))


def stem(word: str) -> str:
    """A light suffix stripper: one suffix, if three letters are left."""
    for end, to in _SUFFIX:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)] + to
    return word


def stem_column(words) -> Column:
    def one(w: Column) -> Column:
        return reduce(lambda rest, et: F.when(w.endswith(et[0]) & (F.length(w) - len(et[0]) >= 3), F.concat(w.substr(F.lit(1), F.length(w) - len(et[0])), F.lit(et[1]))).otherwise(rest), reversed(_SUFFIX), w)

    return F.transform(words, one)


def lexemes(text, stemmed: bool = True) -> Column:
    w = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), lambda x: ~x.isin(*sorted(STOP)) if stemmed else F.lit(True))
    return stem_column(w) if stemmed else w


def parse_web_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (or) of conjunctions of (wanted, phrase); a leading - negates, quotes make phrases."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not neg and not phrase and word.lower() == "or":
            out.append([])
            continue
        parts = [stem(w) for w in re.findall(r"[a-z0-9]+", (phrase or word).lower()) if w not in STOP]
        if parts:
            out[-1].append((not neg, parts))
    return [a for a in out if a]


def full_text(records: DataFrame, query: str, limit: int) -> DataFrame:
    """Records whose lexemes match query, ranked by weight class: title, path, symbol 1, summary 0.4, text 0.2 a hit.

    Phrases must stand in order in one field. Rank is a sum over hits damped by 1 + log of the length, not cover density.
    """
    fields = [("title", 1.0, True), ("source_path", 1.0, False), ("symbol", 1.0, False), ("summary", 0.4, True), ("record_type", 0.4, False), ("embedding_text", 0.2, True)]
    df = records.withColumns({f"_l_{c}": lexemes(F.col(c), s) for c, _, s in fields})

    def hit(parts: list[str], c: str) -> Column:
        if len(parts) == 1:
            return F.array_contains(f"_l_{c}", parts[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(f"_l_{c}", " "), F.lit(" ")), F.lit(" " + " ".join(parts) + " "))

    alternatives = parse_web_query(query)
    any_field = lambda parts: reduce(lambda a, b: a | b, [hit(parts, c) for c, _, _ in fields])
    match = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [any_field(p) if want else ~any_field(p) for want, p in alt]) for alt in alternatives], F.lit(False))
    wanted = [p for alt in alternatives for want, p in alt if want]
    size = 1 + F.log(1 + F.size("_l_embedding_text"))
    rank = sum((F.when(hit(p, c), w).otherwise(0.0) for p in wanted for c, w, _ in fields), F.lit(0.0)) / size
    df = df.filter(match).withColumn("rank", F.round(rank, 9)).withColumn("match_score", match_score(query_terms(query)))
    return df.drop(*[f"_l_{c}" for c, _, _ in fields]).orderBy(F.desc("rank"), F.desc("match_score"), F.desc("updated_at"), F.desc("id")).limit(limit)
