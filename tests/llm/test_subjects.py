import random

import numpy as np
import pandas as pd

from lodewright.llm import subjects as S

TERMS = {"music": "violin,cello,octave,chord,tempo,choir,melody,piano roll".split(","), "farming": "wheat,tractor,barley,silage,compost,hay bale,herd,pasture".split(",")}
TERMS["law"] = "clause,verdict,appeal,court,judge,tort,statute,legal brief".split(",")
PLAIN = ["Thanks, I will look tomorrow.", "Nothing else depends on it.", "Please decide this next week.", "The value looked odd to me."]


def corpus():
    rnd = random.Random(8)
    docs, truth = [], {}
    for i in range(900):
        mine = [s for s in TERMS if rnd.random() < 0.15]
        text = [rnd.choice(PLAIN) for _ in range(3)]
        for s in mine:
            for _ in range(rnd.randrange(3, 7)):
                a, b = rnd.sample(TERMS[s], 2)
                text.append(rnd.choice(["The {} did not agree with the {}.", "Each {} carries the related {}.", "When a {} is late, the {} stays open."]).format(a, b))
        for s in TERMS:
            if s not in mine and rnd.random() < 0.2:
                text.append(f"Someone compared it with a {rnd.choice(TERMS[s])}, but that is another story.")
        rnd.shuffle(text)
        docs.append((i, " ".join(text), "EN" if i % 9 else None, "x"))
        truth[i] = set(mine)
    docs += [(None, "violin and cello. " * 5, "en", "x"), (9001, None, "en", "x"), (9002, "", None, "x"), (9003, "   \n", "en", "x"), (9004, "violin " * 20_000, "en", "x"), (9005, "```\nThe violin and the cello.\n```\n" * 9, "en", "x")]
    return docs, truth


def test_subjects_of_labelled_documents(spark):
    docs, truth = corpus()
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, lang string, subject string")
    areas = spark.createDataFrame([(s, "d") for s in TERMS] + [(None, "d")], "subject string, description string")
    labels = spark.createDataFrame([(i, s, "a") for i, t in truth.items() if i % 3 == 0 for s in (t or {"none"})], "doc_id long, subject string, annotator string")
    got = [(r["doc_id"], r["subject"]) for r in S.document_subjects(df, areas, labels, topics=6, rounds=12).collect()]
    want = {(i, s) for i, t in truth.items() for s in t}
    assert len(got) == len(set(got)) and len(set(got) ^ want) <= 0.03 * len(want)
    assert S.document_subjects(df, areas, labels.filter("doc_id < 0"), topics=6, rounds=2).count() == 0
    assert S.document_subjects(df.filter("doc_id < 0"), areas, labels).count() == 0


def tokens(text):
    t = S.encode(text, {})
    return np.zeros(int((t != 0).sum()), int), np.cumsum(t == 0)[t != 0], t[t != 0]


def test_sentences():
    h = lambda t: [int(x) for x in S.encode(t, {})]
    a, b, c, x, e = (h(w)[0] for w in "abcxe")
    assert h("a b. c\nx | e") == [a, b, 0, c, 0, x, 0, e, 0] and h("a b.c;\n\n|\nx") == [a, b, c, 0, x, 0]
    long = h("X" * 400_000 + " violin a/b c_d `q r` 12 End. `open\n```\ncode\n```\nnext")
    assert long == [h("x" * 400_000)[0], h("violin")[0], h("end")[0], 0, h("open")[0], 0, h("next")[0], 0]
    assert all(len(S.encode(t, {})) == 0 for t in (" \n", "", "12 a/b .", "```\ncode\n```"))


def model(words, terms):
    """A model of one language with one topic a subject."""
    h = {w: int(S.encode(w, {})[0]) for w in words}
    counts = pd.DataFrame({"lang": "en", "w": list(h.values()), "n": 30})
    lex = S.Lexicon(counts, {"en": 1000})
    order = sorted(h, key=h.get)
    lam = np.array([[30.0 * terms[w][k] + 0.02 for k in range(2)] for w in order])
    votes = np.array([[9.0 * terms[w][0], 9.0 * terms[w][1], 0.0] for w in order])
    return S.Model(lex, [lam], [votes], np.array([100.0, 100.0, 800.0]))


def test_proportions_decide_subjects():
    m = model(["violin", "piano", "roll", "herd", "hay", "hold"], {"violin": (1, 0), "piano": (1, 0), "roll": (1, 0), "herd": (0, 1), "hay": (0, 1), "hold": (0.5, 0.5)})
    got = lambda t: [int(s) for _, ss in m.subjects(*tokens(t), 1) for s in ss]
    assert got("violin with piano. " * 3) == [0] and got("violin with piano. " * 2 + "herd with hay.") == []
    assert got("piano roll herd. " * 5) == []  # adjacent words are one term
    assert got("violin with hold. " * 3) == [0] and got("herd with hold. " * 3) == [1]  # the document's proportions tell whose "hold" is
    e = m.expected(0, np.zeros(8, int), m.lex.find(m.lex.words[0], tokens("violin piano violin roll violin piano herd hay")[2]), 1)[0]
    assert 5 < e[0] < 7 and 1 < e[1] < 3


def test_the_named_language_of_a_text_does_not_count():
    h = lambda w: int(S.encode(w, {})[0])
    rows = [("en", h(w), n) for w, n in (("violin", 40), ("house", 60), ("wald", 2))] + [("de", h(w), n) for w, n in (("geige", 30), ("wald", 40), ("violin", 3))]
    rows += [("pt", h(w), n) for w, n in (("violin", 20), ("house", 30))]  # English under another name
    lex = S.Lexicon(pd.DataFrame(rows, columns=["lang", "w", "n"]), {"en": 200, "de": 100, "pt": 99})
    assert lex.langs == ["en", "de"]
    t = [tokens(x)[2] for x in ("violin house", "geige wald violin", "unknown")]
    assert lex.languages(np.repeat([0, 1, 2], [len(x) for x in t]), np.concatenate(t), 3).tolist() == [0, 1, 0]


def test_a_subject_or_text_of_a_third_of_the_documents(spark):
    docs, truth = corpus()
    docs = [x for x in docs if x[0] is not None and x[0] < 900]
    rnd = random.Random(4)
    for i in range(900, 1700):  # a subject of nearly half of all documents, its few terms in most of them
        docs.append((i, " ".join(f"The {a} stays with the {b}." for a, b in (rnd.sample(["kernel", "compiler", "socket", "thread"], 2) for _ in range(5))) + " " + rnd.choice(PLAIN), "en", "x"))
        truth[i] = {"software"}
    copied = "The violin met the choir. A cello and the octave. The chord left the melody. Nothing else depends on it."
    docs += [(i, copied, "en", "x") for i in range(2000, 3200)]
    truth |= {i: {"music"} for i in range(2000, 3200)}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, subject string")
    areas = spark.createDataFrame([(s, "d") for s in [*TERMS, "software"]], "subject string, description string")
    labels = spark.createDataFrame([(i, s, "a") for i, t in truth.items() if i % 3 == 0 for s in (t or {"none"})], "doc_id long, subject string, annotator string")
    got = {(r["doc_id"], r["subject"]) for r in S.document_subjects(df, areas, labels, topics=6, rounds=12).collect()}
    want = {(i, s) for i, t in truth.items() for s in t}
    assert len(got ^ want) <= 0.03 * len(want)


def test_words_of_any_text_are_no_terms():
    base, votes = np.array([60.0, 20, 20]), np.array([[50.0, 0, 1], [60, 20, 20], [0, 5, 0]])  # a frequent term, "the", a rare term
    assert S.lifted(votes, base).tolist() == [[True, False], [False, False], [False, True]]
    terms = S.term_subjects(np.ones((3, 2)), votes, np.zeros((2, 3)), base)
    assert terms.argmax(axis=1).tolist() == [0, 0, 1] and terms.sum(axis=1).tolist() == [1, 0, 1]
