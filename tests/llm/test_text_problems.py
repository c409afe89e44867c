import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import langid, models, stuffing
from corvane.llm.maincontent import Weights, cut_labels, kind_of, main_content, max_flow_labels
from corvane.llm.sitelines import components, repeated_lines, without_lines
from corvane.session import Scratch

SAMPLES = "lang_samples"


@pytest.fixture(scope="module")
def samples(spark, small):
    return spark.read.parquet(f"{small}/{SAMPLES}.parquet")


@pytest.fixture(scope="module")
def labelled(samples):
    return [(r["lang"], r["text"]) for r in samples.collect()]


# --- languages -------------------------------------------------------------------------------------------------------
def test_held_out_accuracy(labelled):
    right = 0
    for fold in range(4):
        m = models.train([r for k, r in enumerate(labelled) if k % 4 != fold])
        part = [r for k, r in enumerate(labelled) if k % 4 == fold]
        cost, _, _ = models.Scorer(m).lines([models.LETTERS.findall(t.lower()) for _, t in part])
        right += sum(m.languages[k] == lang for k, (lang, _) in zip(cost.argmin(1), part, strict=True))
    assert right / len(labelled) > 0.95


def test_probabilities_sum_to_one(labelled):
    import numpy as np

    m = models.train(labelled[:200])
    total = np.zeros(len(m.languages))
    letters = sorted({ch for _, t in labelled[:200] for w in models.LETTERS.findall(t.lower()) for ch in w})
    # the first character of a word: all one-letter beginnings and the end of an empty word
    codes, at, owner = models._padded(letters)
    first = at[np.flatnonzero(np.diff(owner, prepend=-1))]
    h, before = models._hashes(codes, first), models._hashes(codes, first - 1)
    p = np.full((len(first), len(m.languages)), m.uniform)
    for n in range(models.ORDER):
        if n:
            where, hit = models._find(m.contexts[n][0], before[n - 1])
            back = np.where(hit[:, None], m.contexts[n][1][where], 1.0)
        else:
            back = np.repeat(m.contexts[0][1], len(first), 0)
        where, hit = models._find(m.grams[n][0], h[n])
        p = back * p + np.where(hit[:, None], m.grams[n][1][where], 0.0)
    total = p.sum(0)
    assert ((total > 0.97) & (total <= 1.0001)).all()


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("German", "de"), ("xx", None), ("", None), (None, None), ("n/a", None), ("spa", "es")])
def test_labels(label, code):
    assert langid.label_code(label) == code


def test_documents_and_lines(spark, samples):
    en = "The old lighthouse was closed because of the weather, and nobody had asked for it before the summer."
    de = "Der alte Leuchtturm wurde wegen des Wetters geschlossen, und niemand hatte vor dem Sommer danach gefragt."
    rows = [
        (1, f"{en}\n{de}\n{en}", "en"), (2, f"{de}\n{de}", "English"), (3, de, None), (4, "the cat", None), (5, None, "en"), (6, "", "de"),
        (7, "```\nx = call(y)\nfor a in b: pass\n```", None), (8, "\n".join("cheap,offer,deal,price,shoes,shop,shoes,sale" for _ in range(20)), "fr"), (None, f"{en}\n{en}", "de"),
    ]
    df = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id bigint, text string, lang string, confidence string, wrong int")
    got = {(r["doc_id"], r["line_no"]): (r["lang"], r["wrong"]) for r in langid.languages_of(df, samples).collect()}
    assert got == {(1, 0): ("en", False), (1, 2): ("de", None), (2, 0): ("de", True), (3, 0): ("de", True), (None, 0): ("en", True)}
    assert langid.languages_of(df.limit(0), samples).count() == 0


# --- stuffed pages ---------------------------------------------------------------------------------------------------
HONEST = "The council has met in the town hall, and it was said that the bridge would be closed for a week. "


@pytest.mark.parametrize(
    ("text", "stuffed"),
    [
        (HONEST * 10, False),
        (HONEST * 6 + "\n- https://a.example/x\n- https://b.example/y\nTags: bridge, town, week", False),
        ("shoes cheap shoes offer shoes sale " * 20, True),
        ("\n".join(f"https://shop{k}.example/item-{k}" for k in range(30)), True),
        ("; ".join(f"tag{k % 40}" for k in range(100)), True),
        ("\n".join(f"Item{k} size XL 19.99 € | red, blue" for k in range(20)), True),
        (HONEST + "shoes cheap shoes offer shoes sale\n" * 30, True),
        ("```\n" + "x = f(y)\n" * 50 + "```\n" + HONEST, False),
        ("short", False), ("", False), (None, False), ("​" * 50, False),
    ],
)
def test_stuffing(labelled, text, stuffed):
    c = stuffing.calibrate(labelled)
    assert stuffing.assess(text, c).stuffed is stuffed
    assert stuffing.assess(text, c, quick=True).stuffed is stuffed


def test_stuffed_table(spark, samples, rows):
    df = spark.createDataFrame([(1, "shoes cheap shoes offer " * 30, 1), (None, HONEST * 5, 2), (3, None, 3)], "doc_id bigint, text string, words int")
    assert rows(stuffing.stuffed_pages(df, samples).select("doc_id", "stuffed")) == sorted([(1, True), (None, False), (3, False)], key=str)
    assert stuffing.stuffed_pages(df.limit(0), samples).count() == 0
    with pytest.raises(ValueError, match="bound"):
        stuffing.stuffed_pages(df, spark.range(20_001).select(F.lit("en").alias("lang"), F.lit("x").alias("text")))


# --- lines of a site -------------------------------------------------------------------------------------------------
def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"This is the legal notice number {'abcdefgh'[k]} of the site" for k in range(8)]
    docs = []
    for i in range(60):
        lines = [f"own line {i} {''.join(rng.choices('abcdefghij', k=20))}" for _ in range(3)] + rng.sample(pool, 3) + ["", "Short"]
        rng.shuffle(lines)
        docs.append((i, rng.choice(["a", "b", "c"]), "\n".join(x.upper() if rng.random() < 0.2 else x + " 123" for x in lines), "n", 1))
    docs += [(60, "a", None, "n", 1), (61, None, pool[0], "n", 1), (None, "a", pool[0], "n", 1), (62, "a", "", "n", 1), docs[0], docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, node string, place int")
    key = lambda s: "".join(ch for ch in s.lower() if ch.isalpha())
    seen = {}
    for i, source, text, *_ in docs:
        if None not in (i, source, text):
            for line in text.split("\n"):
                if len(key(line)) >= 12:
                    seen.setdefault((source, key(line)), set()).add(i)
    expected = {(i, no) for i, source, text, *_ in docs if None not in (i, source, text) for no, line in enumerate(text.split("\n"), 1) if len(seen.get((source, key(line)), ())) >= 5}
    got = repeated_lines(df)
    assert {(r["id"], r["line_no"]) for r in got.collect()} == expected and expected
    assert {(r["id"], r["line_no"]) for r in repeated_lines(df, small=0).collect()} == expected
    clean = without_lines(df.where("doc_id IS NOT NULL"), got).collect()
    assert len(clean) == len(docs) - 1
    for r in clean:
        if r["text"] and r["source"]:
            assert not any(len(seen.get((r["source"], key(x)), ())) >= 5 for x in r["text"].split("\n"))
    assert repeated_lines(df.limit(0)).count() == 0


def test_blocks_are_components(spark, rows):
    scratch = Scratch(spark, "t")
    chain = [(k, k + 1) for k in range(20)] + [(30, 31)]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a bigint, b bigint")
    nodes = spark.createDataFrame([(k,) for k in [*range(21), 30, 31, 40]], "node bigint")
    assert rows(components(nodes, edges, scratch)) == sorted([(k, 0) for k in range(21)] + [(30, 30), (31, 30), (40, 40)], key=str)


# --- main content ----------------------------------------------------------------------------------------------------
def test_minimum_cut_is_minimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        cost = rng.normal(0, 2, n).round(2)
        edges = [(i, i + d, float(rng.uniform(0, 2))) for d in (1, 2) for i in range(n - d)]
        price = lambda x: sum(c for c, k in zip(cost, x, strict=True) if c > 0 and not k) + sum(-c for c, k in zip(cost, x, strict=True) if c < 0 and k) + sum(w for a, b, w in edges if x[a] != x[b])
        least = min(price(x) for x in itertools.product([False, True], repeat=n))
        assert abs(price(max_flow_labels(cost, edges)) - least) < 1e-6 and abs(price(cut_labels(cost, edges)) - least) < 1e-6


def test_kinds():
    assert kind_of("Home | News | Sport | Weather")[0] == "menu"
    assert kind_of("The council met in the town hall and it was said to be long.")[0] == "paragraph"
    assert kind_of("The council met in the town hall and it…")[0] == "cut"
    assert kind_of("© 2020 Site")[0] == "mark" and kind_of("Shoes now 19,99")[0] == "price"


def test_pages(spark, rows):
    body = ["A headline about the bridge over the river", HONEST.strip(), "Two Words", HONEST.strip() + " It went on."]
    foot = ["Imprint", "All rights reserved by the site", "Send corrections to the desk"]
    pages = []
    for k in range(12):
        order = foot[k % 3 :] + foot[: k % 3]
        own = [b.replace("bridge", f"bridge {'abcdefghijkl'[k] * 4}") for b in body]
        own = [x if x != "Two Words" else f"Name {'abcdefghijkl'[k] * 5}" for x in own]
        pages.append((k, "\n".join(["Home | News | Sport | Mail", "", *own, " ".join(order), "Related stories", f"Some other headline {'abcdefghijkl'[k] * 3} about the town", f"Another {'abcdefghijkl'[k] * 4} headline about the sea"]), "x", 1))
    pages += [(20, None, "x", 1), (21, "", "x", 1), (22, "Home | News | Sport | Mail\nRelated stories", "x", 1)]
    df = spark.createDataFrame(pages, "page_id bigint, text string, nodes string, seat int")
    got = rows(main_content(df))
    assert got == sorted([(k, no) for k in range(12) for no in (3, 4, 5, 6)], key=str)
    assert rows(main_content(df, small=0)) == got  # the join gives what the shipped array gives
    assert main_content(df.limit(0)).count() == 0
    assert Weights().paragraph > 0


def test_lines_are_counted_within_their_site(spark):
    quote = "The same short quotation of a poet stands in many articles of the world."
    body = lambda k: "\n".join([f"Headline of the article number {k} on this page", f"The council of town {k} met in the hall, and it was said that the bridge would be closed.", quote, f"It was the {k}th time that they had to vote on this, and nobody was content with it."])
    notice = "Please accept the cookies of this site before you read on in it."
    rows = [(k, f"site{k}", body(k)) for k in range(8)] + [(10 + k, "same", notice + "\n" + body(100 + k)) for k in range(8)] + [(99, None, body(99))]
    df = spark.createDataFrame(rows, "page_id bigint, source string, text string")
    for small in (1_000_000, 0):
        got = {(r[0], r[1]) for r in main_content(df, source="source", small=small).collect()}
        assert all((k, 3) in got for k in (*range(8), 99))
        assert not any((10 + k, no) in got for k in range(8) for no in (1, 4))  # the notice, and what this one site quotes everywhere
