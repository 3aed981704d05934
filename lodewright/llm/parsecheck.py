"""Source files that do not parse, and what they are instead.

Every file is parsed with all grammars, in the order of a ranking by tokens typical of each language, whatever its
path says; this needs no other table, so it is done where the file is read and no content is shuffled. Only then its
path's language is looked up: a file its own grammar accepts is valid, one that only others accept has a wrong
extension, one that none accepts is corrupt (cut off, in conflict, damaged).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.grammars import LANGUAGES, parses

# tokens typical of a language (fixed values)
_TYPICAL = {
    "python": ("def ", "elif ", "self.", "from ", "None", ":\n"),
    "javascript": ("===", "=>", "const ", "function", "export ", "let ", "require("),
    "go": ("package ", ":=", "func ", "defer ", "nil", "chan "),
    "c": ("#include", "->", "struct ", "void", "unsigned ", "sizeof"),
    "json": ('": ', '":', "{\n", "[\n"),
}


def ranking(text: str) -> list[str]:
    """Languages by how many of their typical tokens text has, most first."""
    n = {k: sum(map(text.count, words)) for k, words in _TYPICAL.items()}
    return sorted(LANGUAGES, key=lambda k: (-n[k], k))


def examine(text: str) -> list[str]:
    """All languages text is valid for, the best ranked first. A blank text tells of none but those it is valid for."""
    return [k for k in ranking(text) if parses(text, k)]


def path_languages(files: DataFrame) -> DataFrame:
    """The language most rows give for each (collection, repo, source_path); ties go to the lesser name."""
    n = files.filter("language IS NOT NULL").groupBy("collection", "repo", "source_path", "language").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("collection", "repo", "source_path").agg(F.min(F.struct((-F.col("n")).alias("n"), "language")).alias("x")).select("collection", "repo", "source_path", F.col("x.language").alias("language"))


def _examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(accepted=[examine(t) for t in pdf["content"]], blank=[not t.strip() for t in pdf["content"]]).drop(columns="content")


def parse_check(raw: DataFrame, files: DataFrame) -> DataFrame:
    """(raw_id, collection, repo, source_path, file_sha256, language, accepted, parsed_as, verdict): one row per file version of the five languages.

    accepted are all languages whose grammar takes the file, the best ranked first. verdict is valid, wrong_extension or
    corrupt; parsed_as is the path's language if valid, else the best ranked of accepted; blank files, which could be of any
    language, are corrupt where they are not valid. Digests are in lower case. Rows with null raw_id or content, or whose
    path has no language or another one, are left out; rows delivered twice are one row. Whole contents are parsed. Empty
    tables give no rows; extra columns are ignored.
    """
    known = path_languages(files).filter(F.col("language").isin(*LANGUAGES))
    r = raw.select("raw_id", "collection", "repo", "source_path", F.lower("file_sha256").alias("file_sha256"), "content").filter("content IS NOT NULL AND raw_id IS NOT NULL")
    out = r.mapInPandas(_examine, "raw_id long, collection string, repo string, source_path string, file_sha256 string, accepted array<string>, blank boolean")
    out = out.dropDuplicates(["raw_id"]).join(known, ["collection", "repo", "source_path"])
    own = F.array_contains("accepted", F.col("language"))
    parsed = F.when(own, F.col("language")).when(~F.col("blank"), F.try_element_at("accepted", F.lit(1)))
    verdict = F.when(own, "valid").when(F.col("parsed_as").isNotNull(), "wrong_extension").otherwise("corrupt")
    return out.withColumn("parsed_as", parsed).withColumn("verdict", verdict).drop("blank")


def rates(checked: DataFrame, files: DataFrame) -> DataFrame:
    """Counts and the rate of invalid files per repo and language, and the paths that were not read for a skipped_reason."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = checked.groupBy("collection", "repo", "language").agg(F.count(F.lit(1)).alias("n_files"), n("wrong_extension").alias("n_wrong_extension"), n("corrupt").alias("n_corrupt"))
    skipped = files.filter(F.col("skipped_reason").isNotNull() & F.col("language").isin(*LANGUAGES)).select("collection", "repo", "language", "source_path").distinct()
    skipped = skipped.groupBy("collection", "repo", "language").agg(F.count(F.lit(1)).alias("n_skipped"))
    both = out.unionByName(skipped, allowMissingColumns=True).groupBy("collection", "repo", "language")
    out = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_files", "n_wrong_extension", "n_corrupt", "n_skipped")])
    return out.withColumn("invalid_rate", F.when(F.col("n_files") > 0, F.round((F.col("n_wrong_extension") + F.col("n_corrupt")) / F.col("n_files"), 6)))
