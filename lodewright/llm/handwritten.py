"""Generated, minified, vendored files and data blobs among source files.

1. Each file version shows features from its text and path: phrases of tools and notices of rights in its leading or
   trailing comments, mechanical numbering, line and white-space statistics, shares of literal data, runs of tokens
   shared with known library files, its name. None decides a label: a notice of rights stands in many hand-written files.
2. How likely each value is under each label is fitted by expectation maximisation over all versions, starting from
   LIKELY, which counts as many versions as there are of a label, LEAST at least. Versions with equal values weigh
   the same in every round, so each of the 2,304 combinations of values is one row with its count of versions.
3. Labels are inferred by belief propagation over the directory tree: a directory's label makes those of its files and
   subdirectories likely, so that files support their siblings and files without marks follow their tree. The tree has
   no loops: one pass up and one down give exact marginals. Messages of a directory's children are summed with
   map-side combination, so a hot directory is no hot task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.llm.parsecheck import path_languages
from lodewright.session import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
LANGUAGES = ("python", "javascript", "go", "c")
RUN, MOST_RUNS, LEAST, ROUNDS = 5, 8_000_000, 200, 4
# fixed values: how likely a file (first) or a subdirectory (second) has a label (column) if its directory has one (row)
COMPATIBLE = {
    "handwritten": (0.89, 0.04, 0.02, 0.02, 0.03),
    "generated": (0.04, 0.90, 0.02, 0.02, 0.02),
    "minified": (0.40, 0.02, 0.50, 0.02, 0.06),
    "vendored": (0.02, 0.01, 0.01, 0.95, 0.01),
    "blob": (0.45, 0.02, 0.06, 0.02, 0.45),
}
NESTED = {
    "handwritten": (0.9928, 0.002, 0.002, 0.0002, 0.003),
    "generated": (0.09, 0.90, 0.002, 0.005, 0.003),
    "minified": (0.47, 0.005, 0.50, 0.005, 0.02),
    "vendored": (0.02, 0.005, 0.002, 0.97, 0.003),
    "blob": (0.50, 0.005, 0.03, 0.005, 0.46),
}
# fixed values: what names of directories hint at, and how likely such a directory has a label outside vendored trees
DIRECTORY_HINTS = {
    "vendored": ("vendor", "third_party", "3rdparty", "thirdparty", "node_modules", "deps", "external", "bower_components", "site-packages"),
    "generated": ("gen", "generated", "stubs", "autogen", "__generated__"),
    "minified": ("dist",),
}
# values of each feature, and how likely each is under the five labels before any fit (fixed values)
LIKELY = {
    "marker": ((0.9995, 0.25, 0.98, 0.99, 0.98), (0.0005, 0.75, 0.02, 0.01, 0.02)),  # a tool's phrase: no, yes
    "counting": ((0.9995, 0.50, 0.99, 0.99, 0.95), (0.0005, 0.50, 0.01, 0.01, 0.05)),  # mechanical numbering: no, yes
    "notice": ((0.94, 0.95, 0.95, 0.30, 0.98), (0.06, 0.05, 0.05, 0.70, 0.02)),  # a notice of rights: no, yes
    "data": ((0.999, 0.98, 0.98, 0.995, 0.05), (0.001, 0.02, 0.02, 0.005, 0.95)),  # half of the text is literal data: no, yes
    "form": ((0.994, 0.97, 0.03, 0.98, 0.50), (0.005, 0.02, 0.07, 0.015, 0.40), (0.001, 0.01, 0.90, 0.005, 0.10)),  # usual, long lines, long dense lines
    "shared": ((0.9948, 0.9948, 0.99, 0.35, 0.9948), (0.005, 0.005, 0.005, 0.15, 0.005), (0.0002, 0.0002, 0.005, 0.50, 0.0002)),  # runs known from libraries: under 30 %, under half, more
    "named": ((0.985, 0.60, 0.40, 0.98, 0.75), (0.01, 0.39, 0.005, 0.01, 0.005), (0.002, 0.005, 0.59, 0.005, 0.005), (0.003, 0.005, 0.005, 0.005, 0.24)),  # by name: nothing, generated, minified, blob
    "place": ((0.975, 0.70, 0.75, 0.25, 0.97), (0.015, 0.28, 0.02, 0.01, 0.01), (0.005, 0.01, 0.22, 0.01, 0.01), (0.005, 0.01, 0.01, 0.73, 0.01)),  # a directory above it hints: nothing, generated, minified, vendored
}
FEATURES = tuple(k for k in LIKELY if k != "place")  # the tree knows the place
PRIOR = (0.90, 0.03, 0.02, 0.03, 0.02)
HINTED = {
    "vendored": (0.08, 0.01, 0.005, 0.90, 0.005),
    "generated": (0.28, 0.70, 0.01, 0.005, 0.005),
    "minified": (0.50, 0.01, 0.47, 0.01, 0.01),
}
_NAME_HINTS = (
    ("generated", re.compile(r"(?:_generated|_pb2|\.pb|\.gen|_gen|^zz_generated.*|\.generated|_autogen|\.g)\.\w+$|^zz_generated")),
    ("minified", re.compile(r"[.\-](?:min|bundle)\.\w+$|\.min\.|\.bundle\.")),
    ("blob", re.compile(r"_data\.\w+$")),
)
_COMMENT = re.compile(r"^\s*(?://+|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|undef|pragma|error)\b)|/\*+!?|\*+(?!/)(?=\s|$)|--)\s*(.*?)\s*(?:\*+/)?\s*$|^\s*\*+/\s*$")
# fixed values: phrases by which tools mark their output, and projects their files
_MARKED = re.compile(
    r"(?i)@generated|<auto-?generated|auto(?:matically)?[- ]?(?:generated|created)|(?<!be )(?<!not )\b(?:machine[- ])?generated (?:by|from|on|with|output|file|code)|code generated|do not (?:edit|modify)|changes will be lost|"
    r"produced from|do not modify it by hand|erzeugt von|nicht (?:bearbeiten|ändern)|généré|ne pas modifier|generado|no (?:editar|modificar)|gegenereerd|自動生成|自动生成"
)
_WISH = re.compile(r"(?i)\b(?:todo|fixme|should|could|would|not generated|was generated)\b")
_NOTICE = re.compile(r"(?i)copyright|\(c\)|©|licen[cs]ed?\b|\brights\b|\bcontributors\b|\bauthors?\b")
_TOKEN = re.compile(r"[A-Za-z0-9_]+")
_NUMBER = re.compile(r"\d+")
_DATA_STRING = re.compile(r"""(["'`])(?:[A-Za-z0-9+/=\n\\_-]{40,}|(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}){10,})\1""")
_DATA_LINE = re.compile(r"""^[\s\["'`(+]*(?:(?:-?(?:0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?)[uUlLfF]*\s*,\s*){3,}-?(?:0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?)?[uUlLfF]*|[A-Za-z0-9+/]{40,}={0,2})[\s,;"'`)\]}+\\]*$""")


def run_hashes(text: str) -> np.ndarray:
    """Distinct hashes of runs of five tokens."""
    t = _TOKEN.findall(text)
    if len(t) < RUN:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, t), np.uint64, len(t))
    x = np.zeros(len(t) - RUN + 1, np.uint64)
    for k in range(RUN):
        x = (x ^ h[k : len(t) - RUN + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return np.unique(x)


def edge_comments(lines: list[str]) -> list[str]:
    """Texts of the comment lines before the first and after the last other line; all of them if there is no other."""
    marks = [(m[1] or "") if (m := _COMMENT.match(x)) else None for x in lines]
    code = [i for i, x in enumerate(lines) if x.strip() and marks[i] is None]
    if not code:
        return [x for x in marks if x]
    return [x for x in [*marks[: code[0]], *marks[code[-1] + 1 :]] if x]


def counting_share(lines: list[str]) -> tuple[int, float]:
    """Lines whose first or last number is one more than that of the last line of the same shape; also as a share."""
    last: dict[str, tuple[int, int]] = {}
    steps = 0
    for line in lines:
        n = _NUMBER.findall(line)
        if not n or len(line) > 300:
            continue
        shape = re.sub(r"[A-Za-z_]+", "i", _NUMBER.sub("0", line.strip()))
        a, b = int(n[0][:18]), int(n[-1][:18])
        if (p := last.get(shape)) and (a == p[0] + 1 or b == p[1] + 1):
            steps += 1
        last[shape] = (a, b)
    return steps, steps / max(1, sum(1 for x in lines if x.strip()))


def features(text: str, path: str) -> tuple[int, ...]:
    """Values of all FEATURES but shared for one version."""
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    n = sum(map(len, full))
    name = path.rsplit("/", 1)[-1]
    named = next((i for i, (_, p) in enumerate(_NAME_HINTS, 1) if p.search(name)), 0)
    if not n:
        return 0, 0, 0, 0, 0, named
    comments = edge_comments(lines)
    steps, share = counting_share(lines)
    data = sum(len(x) for x in full if _DATA_LINE.match(x))
    data = max(data, sum(len(m[0]) for m in _DATA_STRING.finditer(text))) / n
    space = sum(map(len, re.findall(r"\s+", text))) / len(text)
    mean = n / len(full)
    form = 2 if mean >= 110 and space < 0.10 and data < 0.8 else 1 if mean >= 250 else 0
    marker = any(_MARKED.search(c) and not _WISH.search(c) for c in comments)
    return int(marker), int(steps >= 8 and share >= 0.15), int(any(_NOTICE.search(c) for c in comments)), int(data >= 0.5), form, named


def _library_runs(library: DataFrame) -> DataFrame:
    """(h): distinct run hashes of the library files."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["content"]:
                yield pd.DataFrame({"h": run_hashes(text or "").view(np.int64)})

    return cut(library.select("content").mapInPandas(runs, "h long").distinct())


_SHOWN = [k for k in FEATURES if k != "shared"]


def shown(content: DataFrame, library: DataFrame) -> DataFrame:
    """content (raw_id, collection, repo, source_path, content) with its features in the place of the text.

    The library's runs are met in blocks of MOST_RUNS, which are broadcast one after another; hits of blocks add up,
    so the size of the library changes the number of passes and nothing else.
    """
    known = _library_runs(library)
    n_blocks = max(1, -(-known.count() // MOST_RUNS))
    spark = content.sparkSession

    def block(i: int):
        h = known.filter(F.pmod("h", F.lit(n_blocks)) == i).toPandas()["h"].to_numpy(np.int64)  # MOST_RUNS rows
        return spark.sparkContext.broadcast(np.sort(h.view(np.uint64)))

    def hits(h: np.ndarray, lib: np.ndarray) -> int:
        return int((lib[np.minimum(np.searchsorted(lib, h), len(lib) - 1)] == h).sum()) if len(h) and len(lib) else 0

    first = block(0)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*features(t, p or ""), len(h), hits(h, first.value)) for t, p in zip(pdf["content"], pdf["source_path"]) for h in [run_hashes(t)]]
            yield pd.concat([pdf.drop(columns="content").reset_index(drop=True), pd.DataFrame(rows, columns=[*_SHOWN, "n", "hits"], dtype="int32")], axis=1)

    schema = "raw_id long, collection string, repo string, source_path string, " + ", ".join(f"{x} int" for x in [*_SHOWN, "n", "hits"])
    out = content.mapInPandas(work, schema).dropDuplicates(["raw_id"])
    for i in range(1, n_blocks):
        other = block(i)

        def more(batches, other=other):
            for pdf in batches:
                yield pd.DataFrame({"raw_id": pdf["raw_id"], "more": [hits(run_hashes(t), other.value) for t in pdf["content"]]})

        met = content.select("raw_id", "content").mapInPandas(more, "raw_id long, more int").dropDuplicates(["raw_id"])
        out = out.join(met, "raw_id").withColumn("hits", F.col("hits") + F.col("more")).drop("more")
    share = F.col("hits") / F.greatest("n", F.lit(1))
    return out.withColumn("shared", F.when(share >= 0.5, 2).when(share >= 0.3, 1).otherwise(0)).drop("n", "hits")


def fitted(rows: np.ndarray, times: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Log likelihoods, values x labels, of each feature after ROUNDS of expectation maximisation over rows of feature values;
    times: how many versions have a row's values, one if not given."""
    table = {k: np.array(v) for k, v in LIKELY.items()}
    prior = np.array(PRIOR)
    times = np.ones(len(rows)) if times is None else times
    for _ in range(ROUNDS if len(rows) else 0):
        log = np.log(prior) + sum(np.log(table[k])[rows[:, i]] for i, k in enumerate(LIKELY))
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p *= times[:, None] / p.sum(axis=1, keepdims=True)
        prior = (p.sum(axis=0) + LEAST * np.array(PRIOR)) / (times.sum() + LEAST)
        anchor = np.maximum(p.sum(axis=0), LEAST)
        for i, (k, v) in enumerate(LIKELY.items()):
            seen = np.stack([p[rows[:, i] == x].sum(axis=0) for x in range(len(v))])
            table[k] = (seen + anchor * np.array(v)) / (p.sum(axis=0) + anchor)
    return {k: np.log(v) for k, v in table.items()}


def _place(path) -> F.Column:
    names = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    has = lambda x: F.arrays_overlap(names, F.array(*[F.lit(w) for w in DIRECTORY_HINTS[x]]))
    return F.when(has("vendored"), 3).when(has("generated"), 1).when(has("minified"), 2).otherwise(0)


def evidence(seen: DataFrame) -> DataFrame:
    """Paths with e_label, the log likelihood of their features averaged over versions."""
    kinds = seen.withColumn("place", _place(F.col("source_path"))).groupBy(*LIKELY).count().toPandas().sort_values([*LIKELY])  # 2,304 rows at most
    table = fitted(kinds[[*LIKELY]].to_numpy(int), kinds["count"].to_numpy(float))
    at = lambda k, i: F.element_at(F.array(*[F.lit(float(x)) for x in table[k][:, i]]), F.col(k) + 1)
    log = {f"e_{x}": F.avg(sum((at(k, i) for k in FEATURES[1:]), at(FEATURES[0], i))) for i, x in enumerate(LABELS)}
    return seen.groupBy(*KEY, "source_path").agg(*[v.alias(k) for k, v in log.items()])


KEY = ["collection", "repo"]


def _parent(path) -> F.Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _of_files(y: str, i: int) -> F.Column:
    """How likely a file has label i if its directory has label y."""
    return F.lit(COMPATIBLE[y][i])


def _of_directories(y: str, i: int) -> F.Column:
    """The same of the subdirectory in column dir. A telling name speaks for itself, so that what lies in a vendor directory
    says nothing of the directory around it."""
    if y == "vendored":
        return F.lit(NESTED[y][i])
    name, out = F.lower(F.element_at(F.split("dir", "/"), -1)), F
    for x, names in DIRECTORY_HINTS.items():
        out = out.when(name.isin(*names), HINTED[x][i])
    return out.otherwise(NESTED[y][i])


def _messages(nodes: DataFrame, prefix: str, likely) -> DataFrame:
    """Columns m_label: what a node with log beliefs prefix_label tells its directory; likely: _of_files or _of_directories."""
    high = F.greatest(*[F.col(f"{prefix}{x}") for x in LABELS])
    at = {x: F.exp(F.col(f"{prefix}{x}") - high) for x in LABELS}
    to = lambda y: F.log(sum(at[x] * likely(y, i) for i, x in enumerate(LABELS)))
    return nodes.withColumns({f"m_{y}": to(y) for y in LABELS})


def _down(likely) -> dict:
    """Log message of a directory with beliefs t_label, its child's own message m_label taken out, to that child."""
    rest = {y: F.col(f"t_{y}") - F.col(f"m_{y}") for y in LABELS}
    high = F.greatest(*rest.values())
    return {x: F.log(sum(F.exp(rest[y] - high) * likely(y, i) for y in LABELS)) for i, x in enumerate(LABELS)}


def propagate(files: DataFrame) -> DataFrame:
    """files (collection, repo, source_path, e_label...) with columns label and p_label, the marginals.

    One job a level of the deepest path, up and down; each level's directories are cut off by a checkpoint.
    """
    files = cut(_messages(files.withColumn("dir", _parent(F.col("source_path"))), "e_", _of_files))
    depth_of = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "/")))
    files = files.withColumn("depth", depth_of("dir"))
    deepest = files.agg(F.max("depth")).first()[0] or 0
    sums = [F.sum(f"m_{x}").alias(f"s_{x}") for x in LABELS]
    own = cut(files.groupBy(*KEY, "dir", "depth").agg(*sums))
    levels: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, -1, -1):
        here = own.filter(F.col("depth") == d).select(*KEY, "dir", *[F.col(f"s_{x}").alias(f"m_{x}") for x in LABELS])
        if below is not None:
            here = here.unionByName(below)
        here = here.groupBy(*KEY, "dir").agg(*sums)
        here = here.withColumns({f"u_{x}": F.col(f"s_{x}") + F.lit(math.log(p) if d == 0 else 0.0) for x, p in zip(LABELS, PRIOR)})
        here = cut(_messages(here, "u_", _of_directories).select(*KEY, "dir", *[f"u_{x}" for x in LABELS], *[f"m_{x}" for x in LABELS]))
        levels[d] = here
        below = here.select(*KEY, _parent(F.col("dir")).alias("dir"), *[f"m_{x}" for x in LABELS]) if d else None
    total = levels[0].select(*KEY, "dir", *[F.col(f"u_{x}").alias(f"t_{x}") for x in LABELS])
    all_dirs = [total]
    for d in range(1, deepest + 1):
        up = total.withColumnRenamed("dir", "above")
        here = levels[d].withColumn("above", _parent(F.col("dir"))).join(up, [*KEY, "above"])
        told = _down(_of_directories)
        total = cut(here.select(*KEY, "dir", *[(F.col(f"u_{x}") + told[x]).alias(f"t_{x}") for x in LABELS]))
        all_dirs.append(total)
    dirs = all_dirs[0]
    for more in all_dirs[1:]:
        dirs = dirs.unionByName(more)
    out = files.join(dirs, [*KEY, "dir"])
    told = _down(_of_files)
    out = out.withColumns({f"b_{x}": F.col(f"e_{x}") + told[x] for x in LABELS})
    high = F.greatest(*[F.col(f"b_{x}") for x in LABELS])
    norm = sum(F.exp(F.col(f"b_{x}") - high) for x in LABELS)
    best = F.array_max(F.array(*[F.struct(F.col(f"b_{x}").alias("b"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(LABELS)]))
    return out.select(*KEY, "source_path", best["x"].alias("label"), *[(F.exp(F.col(f"b_{x}") - high) / norm).alias(f"p_{x}") for x in LABELS])


def source_labels(raw: DataFrame, files: DataFrame, library: DataFrame) -> DataFrame:
    """(collection, repo, source_path, label, p_label...): one row per path of the four source languages with content.

    Rows with null raw_id, content, collection, repo or path and paths without a known language are left out; empty
    contents are handwritten but for what their path tells. Rows delivered twice count once. An empty library
    has no copies; empty tables give no rows; extra columns are ignored. Whole texts are read.
    """
    known = path_languages(files).filter(F.col("language").isin(*LANGUAGES)).select(*KEY, "source_path")
    r = raw.select("raw_id", *KEY, "source_path", "content").filter("content IS NOT NULL AND raw_id IS NOT NULL").join(known, [*KEY, "source_path"], "left_semi")
    return propagate(evidence(cut(shown(r, library))))
