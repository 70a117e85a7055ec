"""A small corpus with every awkward case, and plain restatements of what the operators compute."""

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id long, words string, chunk long, rate double"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return BLANKS.findall(text or "")


def alnum(text):
    return ALNUM.findall((text or "").translate(FOLD))


def corpus():
    rnd = random.Random(3)
    vocab = {"en": ["the", "thing", "water", "Stone", "and", "over", "with", "house", "river", "long"], "fr": ["le", "éléphant", "où", "Chose", "rivière", "maison", "avec", "très", "long", "sur"]}
    passage = " ".join(rnd.choices(vocab["en"], k=40))
    docs = []
    for i in range(70):
        lang = ("en", "fr")[i % 3 == 0]
        body = " ".join(rnd.choices(vocab[lang], k=rnd.choice([3, 30, 60, 120])))
        docs.append([i, body, lang, f"s{i % 2}"])
    for i in (5, 17, 34, 37):
        docs[i][1] += "\n" + passage + "."
    for i in (20, 21, 22):
        docs[i][1], docs[i][2] = docs[19][1:3]
    docs[23][2] = docs[19][2]
    docs[23][1] = docs[19][1] + " extra"
    docs[40][1], docs[41][1], docs[42][1] = None, "", " \t\n\x0b "
    docs[43][1], docs[44][1] = "word", "WORD"
    docs[45][2] = "en"
    docs[45][1] = "a" * 5000 + " " + " ".join(rnd.choices(vocab["en"], k=30_000))  # very long
    docs[46][1] = "\n".join(["same line here", "same line here", "other line"] * 20)
    docs[47][1] = "### $$$ %% | <> " * 30
    docs[49][2] = docs[50][2] = None
    docs[51][3] = None
    docs[52][1] = "日本語 の 文章 です 🙂 " * 20
    docs[53][1] = "123 456 !!! ..."
    docs.append(list(docs[19]))  # a repeated row
    docs.append([None, docs[5][1], "en", "s0"])
    return [tuple([*d, len(d[1]) if d[1] else 0, 0.5, True, 7, "w", 3, 9.0]) for d in docs]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 0 if "#" in (r[1] or "") or (r[0] or 0) % 7 == 3 else 1, 1 if r[0] == 9 else 0, "x") for r in rows if r[0] is not None and r[0] % 5 != 4], "doc_id long, quality int, toxic int, score string")
