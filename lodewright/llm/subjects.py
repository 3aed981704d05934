"""Subjects of documents from the proportions of latent Dirichlet topics.

1. Texts become rows of word hashes, a sentence per run (encode): code blocks, quoted names and tokens with marks of
   names, paths or numbers are left out. Words are counted per language over all distinct texts.
2. A text's language is the one most of its words belong to, whatever its lang says. Every language has TOPICS topics,
   fitted over all its distinct texts by stochastic variational Bayes (Hoffman et al., 2010): texts lie in disjoint
   batches by their hash, a round is one job over one batch of each language, tasks sum the statistics of their texts,
   the shuffle sums those of the tasks, and words x topics numbers come back. Words weigh by the square of their inverse
   document frequency, so that those of any text do not shape topics; none is cut off for being frequent, and frequent
   terms which labels show to be of one subject keep their weight.
3. The top terms of a topic are inspected: the mean of their shares of subjects among the labelled documents is the
   topic's profile. A term has its own share where enough labelled documents show one, else that of its topics.
4. A document's topic proportions, mapped to subjects by the profiles, give its subjects: those with at least LEAST
   expected words. An exact check follows, since a passing mention is no case: a sentence is devoted to a subject if it
   names two of its terms (adjacent words are one, the document's proportions decide ambiguous ones), and a subject
   needs SENTENCES of them.

Bounded are the words of a language (VOCABULARY, most frequent first, and all words of four or more labelled texts) and
the labelled documents inspected (LABELLED, by least hash). Counts, topics and assignment cover all texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodewright.session import cut, remove, shared_dir

VOCABULARY, LABELLED, TOPICS, ROUNDS, BATCH, LEAST_TEXTS = 8192, 20_000, 24, 30, 1000, 50
SENTENCES, TERMS, LEAST, LIFT = 3, 2, 2.0, 3
ALPHA, ETA, STEPS, ALIKE = 0.1, 0.02, 15, 0.5
_CODE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)")
_QUOTED = re.compile(r"`[^`\n]*`")
_MARKS = frozenset("_/\\@#<>{}=0123456789")  # fixed value: characters of names, paths and numbers
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_BREAK = re.compile(r"[.!?;:]\Z|\|")
_JOIN = frozenset("of de du des del la le les der d l à".split())  # fixed value: words inside terms


def words_of(token: str) -> list[str]:
    """Words of a text between two white spaces, "" where a sentence ends in or after it; none if it has marks."""
    if not _MARKS.isdisjoint(token):
        return []
    out: list[str] = []
    for i, part in enumerate(_BREAK.split(token)):
        out += [""] * (i > 0) + [w for w in _WORD.findall(part) if w not in _JOIN]
    return out


def encode(text: str, memo: dict[str, list[int]]) -> np.ndarray:
    """Hashes of the words of a text without code and quoted names, a 0 after each sentence; empty if it has no word. memo holds
    those of texts between white spaces, which repeat."""
    out: list[int] = []
    for line in _QUOTED.sub(" ", _CODE.sub("\n", text.lower())).split("\n"):
        for token in line.split():
            got = memo.get(token)
            if got is None:
                if len(memo) > 1 << 18:
                    memo.clear()
                got = memo[token] = [(xxhash.xxh3_64_intdigest(w) - 2**63 or 1) if w else 0 for w in words_of(token)]
            out += got
        out.append(0)
    t = np.array(out, np.int64)
    t = t[(t != 0) | np.r_[False, t[:-1] != 0]]  # one 0 a sentence
    return t if t.any() else t[:0]


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, list[int]] = {}
    for pdf in batches:
        tokens = [encode(t, memo) for t in pdf["text"]]
        raw = [t.tobytes() for t in tokens]
        one = pdf.drop(columns="text").assign(k1=[xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw], k2=[xxhash.xxh64_intdigest(r) - 2**63 for r in raw], tokens=tokens)
        yield one[[len(t) > 0 for t in tokens]]


def digamma(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        out -= small / x
        x = x + small
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def infer(ids: np.ndarray, cts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gamma of each document, words x topics shares of each of its words): the variational step for documents whose
    distinct words ids with weights cts lie one after another from starts, under the words x topics weights beta."""
    k = beta.shape[1]
    who = np.repeat(np.arange(len(starts)), sizes)
    b = beta[ids]
    gamma = np.full((len(starts), k), ALPHA) + (np.add.reduceat(cts, starts) / k)[:, None]
    for _ in range(STEPS):
        theta = np.exp(digamma(gamma)).astype(np.float32)
        norm = np.einsum("ij,ij->i", theta[who], b) + np.float32(1e-30)
        new = ALPHA + theta * np.add.reduceat(b * (cts / norm)[:, None], starts, axis=0)
        moved, gamma = np.abs(new - gamma).mean(), new
        if moved < 1e-2:
            break
    shares = np.exp(digamma(gamma)).astype(np.float32)[who] * b
    return gamma, shares / (shares.sum(axis=1, keepdims=True) + np.float32(1e-30))


def bags(doc: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, starts, sizes) of the distinct words of each of the documents that have any, by document."""
    pair, cts = np.unique(doc.astype(np.int64) * n + ids, return_counts=True)
    d = pair // n
    starts = np.r_[0, np.flatnonzero(np.diff(d)) + 1] if len(d) else np.zeros(0, int)
    return (pair % n).astype(np.int32), cts.astype(np.float32), starts, np.diff(np.r_[starts, len(d)])


class Lexicon:
    """Words of each language: sorted hashes, weights, and the language each word belongs to."""

    def __init__(self, counts: pd.DataFrame, sizes: dict[str, int]):
        """counts: rows lang, w, n, the texts of a language with a word; sizes: the texts of each language that has topics."""
        by = {k: c.sort_values("w") for k, c in counts.groupby("lang")}
        share = {k: pd.Series(by[k]["n"].to_numpy() / sizes[k], index=by[k]["w"].to_numpy()) for k in sorted(sizes, key=lambda k: (-sizes[k], k)) if k in by}
        self.langs: list[str] = []
        for k, s in share.items():  # a language whose words are those of a larger one is that one
            alike = lambda o: (s * o).sum() / np.sqrt((s**2).sum() * (o**2).sum())  # noqa: B023, E731
            if not any(alike(share[o]) > ALIKE for o in self.langs):
                self.langs.append(k)
        self.sizes = [sizes[k] for k in self.langs]
        self.words = [by[k]["w"].to_numpy(np.int64) for k in self.langs]
        self.weight = [(np.log(np.maximum(n / by[k]["n"].to_numpy(), 1.001)) / np.log(1 / 0.03)).astype(np.float32) ** 2 for k, n in zip(self.langs, self.sizes)]
        best = pd.concat([share[k].rename(i) for i, k in enumerate(self.langs)], axis=1).fillna(0.0).sort_index() if self.langs else pd.DataFrame()
        self.all, self.of = best.index.to_numpy(np.int64), best.to_numpy().argmax(axis=1) if len(best) else np.zeros(0, int)

    @staticmethod
    def find(known: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens in known, which is sorted; -1 where they are not."""
        if not len(known):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        return np.where(known[at] == tokens, at, -1)

    def languages(self, doc: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
        """The language of each of n documents: that of most of its words; the first if it has no known word."""
        at = self.find(self.all, tokens)
        votes = np.bincount(doc[at >= 0] * len(self.langs) + self.of[at[at >= 0]], minlength=n * len(self.langs))
        return votes.reshape(n, -1).argmax(axis=1)

    def batches(self, lang: int) -> int:
        return int(min(ROUNDS, max(1, self.sizes[lang] // BATCH)))


def blocks(pdf: pd.DataFrame, most: int = 400_000) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each token, sentence of each token, token) of parts of about most tokens; a longer text is a part alone."""
    size = pdf["tokens"].str.len().to_numpy() if len(pdf) else np.zeros(0, int)
    part = np.cumsum(size) // most
    for p in np.unique(part):
        one = pdf[part == p]
        tok = np.concatenate(one["tokens"].to_list())
        doc = np.repeat(np.arange(len(one)), size[part == p])
        word = tok != 0
        yield one, doc[word], np.cumsum(~word)[word], tok[word]


def _counted(texts: DataFrame) -> DataFrame:
    """Distinct texts per language and word."""
    words = F.explode(F.array_distinct(F.filter("tokens", lambda x: x != 0))).alias("w")
    return texts.select("lang", words).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))


def _votes(read: DataFrame, labels: DataFrame) -> DataFrame:
    """(w, subject, v): labelled texts with a word by subject, one vote a text however often it is posted."""
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects")).filter(F.size("subjects") > 0)
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    seen = read.select("doc_id", "k1", "k2", "tokens").join(F.broadcast(one), "doc_id")
    seen = seen.groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"), F.sort_array(F.flatten(F.collect_list("subjects"))).alias("subjects"))
    words = seen.select("subjects", F.explode(F.array_distinct("tokens")).alias("w"))  # 0, which ends sentences, counts all texts
    return words.select("w", F.explode("subjects").alias("subject"), (1.0 / F.size("subjects")).alias("v")).groupBy("w", "subject").agg(F.sum("v").alias("v"))


def lexicon(texts: DataFrame, votes: DataFrame) -> Lexicon:
    """The words of all languages of texts (lang, tokens): of at least three texts, VOCABULARY a language and the labelled ones."""
    sizes = {r["lang"]: r["count"] for r in texts.filter("lang <> ''").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(256).collect()}
    if not sizes:
        sizes = {"": texts.count()}
    named = [k for k, n in sizes.items() if n >= LEAST_TEXTS] or [next(iter(sizes))]
    lang = F.coalesce("lang", F.lit(""))
    texts = texts.withColumn("lang", F.when(lang.isin(named), lang)) if named != [""] else texts.withColumn("lang", F.lit(""))
    labelled = votes.groupBy("w").agg(F.sum("v").alias("v")).filter("v >= 3.5").select("w", F.lit(True).alias("labelled"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    counts = _counted(texts.filter("lang IS NOT NULL")).filter("n >= 3")
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= VOCABULARY).drop("rank")
    more = counts.join(F.broadcast(labelled), "w", "left_semi").select("lang", "w", "n")  # words of at most LABELLED texts
    return Lexicon(top.unionByName(more).distinct().toPandas(), {k: sizes[k] for k in named})


def _batched(texts: DataFrame, lex: Lexicon, path: str) -> DataFrame:
    """Texts as (batch, ids) in files at path by batch: language * ROUNDS + one of the language's batches, by the text's hash."""
    n = sum(lex.sizes)
    n_batches = np.array([lex.batches(i) for i in range(len(lex.langs))])

    def work(batches):
        for pdf in batches:
            for rows, doc, _, tok in blocks(pdf):
                lang = lex.languages(doc, tok, len(rows))
                at = np.full(len(tok), -1)
                for i in np.unique(lang):
                    mine = lang[doc] == i
                    at[mine] = lex.find(lex.words[i], tok[mine])
                ends = np.searchsorted(doc[at >= 0], np.arange(len(rows) + 1))
                kept = at[at >= 0].astype(np.int32)
                k = rows["k1"].to_numpy()
                yield pd.DataFrame({"batch": lang * ROUNDS + np.abs(k % n_batches[lang]), "salt": k // 65536 % 4096, "ids": [kept[a:b] for a, b in zip(ends, ends[1:])]})

    salts = max(1, n // (ROUNDS * 50_000))
    out = texts.select("k1", "tokens").mapInPandas(work, "batch int, salt int, ids array<int>").filter(F.size("ids") > 0)
    out.repartition("batch", F.col("salt") % salts).select("batch", "ids").write.partitionBy("batch").parquet(path)
    return texts.sparkSession.read.schema("ids array<int>, batch int").parquet(path)


def fit_topics(batched: DataFrame, lex: Lexicon, topics: int = TOPICS, rounds: int = ROUNDS, seed: int = 11) -> list[np.ndarray]:
    """Words x topics parameters of each language."""
    spark = batched.sparkSession
    rng = np.random.default_rng(seed)
    lam = [rng.gamma(100, 0.01, (len(w), topics)) for w in lex.words]
    names = [f"s{k}" for k in range(topics)]
    schema = "lang int, word int, " + ", ".join(f"{s} double" for s in names) + ", n long"
    for r in range(rounds):
        beta = spark.sparkContext.broadcast([np.exp(digamma(x) - digamma(x.sum(axis=0, keepdims=True))).astype(np.float32) for x in lam])

        def work(batches, beta=beta):
            total = [np.zeros((len(w), topics)) for w in lex.words]
            n = [0] * len(total)
            for pdf in batches:
                lang = pdf["batch"].to_numpy() // ROUNDS
                for i in np.unique(lang):
                    mine = pdf["ids"][lang == i].to_list()
                    for lo in range(0, len(mine), 2000):
                        part = mine[lo : lo + 2000]
                        ids, cts, starts, sizes = bags(np.repeat(np.arange(len(part)), [len(x) for x in part]), np.concatenate(part), len(lex.words[i]))
                        cts *= lex.weight[i][ids]
                        _, shares = infer(ids, cts, starts, sizes, beta.value[i])
                        order = np.argsort(ids, kind="stable")
                        first = np.r_[0, np.flatnonzero(np.diff(ids[order])) + 1]
                        total[i][ids[order][first]] += np.add.reduceat((shares * cts[:, None])[order], first, axis=0)
                        n[i] += len(part)
            for i, x in enumerate(total):
                seen = np.flatnonzero(x.any(axis=1))
                one = pd.DataFrame(x[seen], columns=names)
                one.insert(0, "word", seen.astype(np.int32))
                one.insert(0, "lang", np.int32(i))
                one["n"] = np.where(np.arange(len(seen)) == 0, n[i], 0)
                yield one

        now = batched.filter(F.col("batch").isin([i * ROUNDS + r % lex.batches(i) for i in range(len(lex.langs))]))
        got = now.mapInPandas(work, schema).groupBy("lang", "word").agg(*[F.sum(s).alias(s) for s in names], F.sum("n").alias("n")).toPandas()  # words x topics
        rho = (r + 2) ** -0.6
        for i, own in got.groupby("lang"):
            new = np.full(lam[i].shape, ETA)
            new[own["word"]] += own[names].to_numpy() * (lex.sizes[i] / max(1, own["n"].sum()))
            lam[i] = (1 - rho) * lam[i] + rho * new
        beta.unpersist()
    return lam


def profiles(lam: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Topics x subjects (the last: none): the shares of the top terms of each topic among labelled texts."""
    total = votes.sum(axis=1)
    share = votes / np.maximum(total, 1e-9)[:, None]
    phi, given = lam / lam.sum(axis=0), lam / lam.sum(axis=1, keepdims=True)
    out = np.zeros((lam.shape[1], votes.shape[1]))
    for t in range(lam.shape[1]):
        top = [i for i in np.argsort(-phi[:, t])[:40] if total[i] >= 2 and given[i, t] >= 0.3]
        if top:
            out[t] = np.average(share[top], axis=0, weights=phi[top, t])
    return out


def lifted(votes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Words x subjects: whether a word is at least LIFT times as likely in labelled texts of the subject as in the others,
    which words of any text are not; base holds all labelled texts by subject."""
    total = votes.sum(axis=1, keepdims=True)
    return votes[:, :-1] * (base.sum() - base[:-1]) >= LIFT * (total - votes[:, :-1]) * base[:-1]


def marked(votes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """How surely each word is a term of one subject by labels alone."""
    total = votes.sum(axis=1)
    return np.where(lifted(votes, base), votes[:, :-1], 0.0).max(axis=1, initial=0.0) / (total + 1.5)


def term_subjects(lam: np.ndarray, votes: np.ndarray, profile: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Words x subjects: weights of the subjects of terms; rows of words that are no term are 0."""
    n = votes.shape[1] - 1
    total = votes.sum(axis=1)
    trust = (total / (total + 1.5))[:, None]
    p = trust * votes / np.maximum(total, 1e-9)[:, None] + (1 - trust) * (lam / lam.sum(axis=1, keepdims=True) @ profile)
    p = np.where(lifted(votes, base) | (total < 2)[:, None], p[:, :n], 0.0)
    two = np.sort(np.pad(p, ((0, 0), (2, 0))), axis=1)[:, -2:]
    sure = p.max(axis=1) >= 0.45
    mixed = ~sure & (trust[:, 0] >= 0.7) & (two.sum(axis=1) >= 0.75) & (two[:, 0] >= 0.2)  # a word of two subjects: its document decides
    kept = np.where((sure | mixed)[:, None] & (p >= 0.15), p, 0.0)
    return (kept / np.maximum(kept.sum(axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Model:
    """All that assigning needs: the words, and each language's topics, profiles and terms."""

    def __init__(self, lex: Lexicon, lam: list[np.ndarray], votes: list[np.ndarray], base: np.ndarray):
        self.lex = lex
        self.beta = [np.exp(digamma(x) - digamma(x.sum(axis=0, keepdims=True))).astype(np.float32) for x in lam]
        self.profile = [profiles(x, v) for x, v in zip(lam, votes)]
        self.terms = [term_subjects(x, v, p, base) for x, v, p in zip(lam, votes, self.profile)]

    def expected(self, lang: int, doc: np.ndarray, ids: np.ndarray, n_docs: int) -> np.ndarray:
        """Documents x subjects: the words each document is expected to have by its topic proportions."""
        out = np.zeros((n_docs, self.profile[lang].shape[1] - 1))
        if len(ids):
            words, cts, starts, sizes = bags(doc, ids, len(self.lex.words[lang]))
            _, shares = infer(words, cts * self.lex.weight[lang][words], starts, sizes, self.beta[lang])
            out[np.unique(doc)] = np.add.reduceat(shares * cts[:, None], starts, axis=0) @ self.profile[lang][:, :-1]
        return out

    def subjects(self, doc: np.ndarray, sentence: np.ndarray, tokens: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, subjects) of n_docs documents whose tokens lie in order, per language."""
        langs = self.lex.languages(doc, tokens, n_docs)
        for lang in np.unique(langs):
            mine = langs[doc] == lang
            d, s, at = doc[mine], sentence[mine], self.lex.find(self.lex.words[lang], tokens[mine])
            known = at >= 0
            expected = self.expected(lang, d[known], at[known], n_docs)
            n = expected.shape[1]
            lean = (expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-9) + 0.01).astype(np.float32)
            named = np.full(len(at), -1)
            place = np.flatnonzero(known)[self.terms[lang][at[known]].any(axis=1)] if known.any() else np.zeros(0, int)
            for lo in range(0, len(place), 1 << 18):
                x = place[lo : lo + (1 << 18)]
                q = self.terms[lang][at[x]] * lean[d[x]]
                best = q.argmax(axis=1)
                named[x] = np.where(q[np.arange(len(x)), best] >= 0.5 * q.sum(axis=1), best, -1)
            begins = (named >= 0) & ~(np.r_[False, (named[1:] == named[:-1]) & (s[1:] == s[:-1])])  # adjacent words of a subject are one term
            pair, times = np.unique(s[begins].astype(np.int64) * n + named[begins], return_counts=True)
            pair = pair[times >= TERMS]
            owner = d[np.searchsorted(s, pair // n)]
            pair, times = np.unique(owner * n + pair % n, return_counts=True)
            pair = pair[times >= SENTENCES]
            pair = pair[expected[pair // n, pair % n] >= LEAST]
            yield pair // n, pair % n


def _matrix(votes: DataFrame, lex: Lexicon, subjects: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Votes for the words of each language, words x subjects, and those of all texts; the last column holds those without a subject."""
    words = votes.sparkSession.createDataFrame(pd.DataFrame({"w": np.r_[lex.all, 0]}))
    got = votes.join(F.broadcast(words), "w", "left_semi").toPandas()  # words of the lexicon only
    column = got["subject"].map({s: i for i, s in enumerate(subjects)}).fillna(len(subjects)).astype(int).to_numpy()
    out = []
    for known in lex.words:
        at = lex.find(known, got["w"].to_numpy(np.int64))
        m = np.zeros((len(known), len(subjects) + 1))
        np.add.at(m, (at[at >= 0], column[at >= 0]), got["v"].to_numpy()[at >= 0])
        out.append(m)
    base = np.zeros(len(subjects) + 1)
    np.add.at(base, column[got["w"] == 0], got["v"][got["w"] == 0].to_numpy())
    return out, base


def document_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """(doc_id, subject): the subjects to which at least three sentences of a document are devoted.

    Null, empty and blank texts have none. Whole texts are read. Rows with a doc_id seen before give no second
    row, rows without one none. Without labels, areas or documents there are no rows. Extra columns are ignored.
    """
    spark = documents.sparkSession
    none = spark.createDataFrame([], "doc_id long, subject string")
    subjects = sorted(r["subject"] for r in areas.select("subject").distinct().collect() if r["subject"])
    read = documents.select("doc_id", F.lower("lang").alias("lang"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    read = cut(read.mapInPandas(_encoded, "doc_id long, lang string, k1 long, k2 long, tokens array<long>"))
    texts = cut(read.groupBy("k1", "k2").agg(F.min("lang").alias("lang"), F.first("tokens").alias("tokens")))
    votes = cut(_votes(read, labels))
    lex = lexicon(texts, votes) if subjects else Lexicon(pd.DataFrame({"lang": [], "w": [], "n": []}), {})
    if not lex.langs or not any(len(w) for w in lex.words) or votes.isEmpty():
        return none
    seen, base = _matrix(votes, lex, subjects)
    lex.weight = [np.maximum(w, marked(v, base)).astype(np.float32) for w, v in zip(lex.weight, seen)]
    path = f"{shared_dir(spark).rstrip('/')}/topics-{uuid.uuid4().hex}"
    try:
        model = Model(lex, fit_topics(_batched(texts, lex, path), lex, **fit), seen, base)
    finally:
        remove(spark, path)
    shared = spark.sparkContext.broadcast((subjects, model))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, fitted = shared.value
        names = np.array(names, dtype=object)
        for pdf in batches:
            for rows, doc, sentence, tok in blocks(pdf):
                for d, s in fitted.subjects(doc, sentence, tok, len(rows)):
                    yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[d], "subject": names[s]})

    return read.select("doc_id", "tokens").mapInPandas(assign, "doc_id long, subject string").distinct()
