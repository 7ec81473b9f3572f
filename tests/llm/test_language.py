"""Languages: n-grams and vectors against brute force, accuracy on rows that teach nothing, defined cases."""

import random
import zlib
from collections import Counter

import numpy as np

from inkgauge.llm import language

SCHEMA = "doc_id long, text string, lang string, chance string, vec string, cosine string"
WORDS = {
    "en": "the and of house water green would through thing which their about another people because should world before great think".split(),
    "de": "der und die haus wasser grün würde durch ding welche ihre über andere leute weil sollte welt bevor groß denken".split(),
    "fi": "talo ja vesi vihreä kautta asia joka heidän toinen ihmiset koska pitäisi maailma ennen suuri ajatella kanssa olisi tämä".split(),
}


def made(n=240, seed=4):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS[name], k=rng.randrange(5, 60))).capitalize() + ".", name) for k in range(n) for name in [("en", "de", "fi")[k % 3]]]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "v", "o") for r in rows], SCHEMA).repartition(3)


def places(text):
    """The places of all n-grams, one at a time, in whole numbers of 64 bits."""
    mask = (1 << 64) - 1
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = " " + " ".join(plain.split()) + " "
    out = Counter()
    for n in range(1, language.GRAMS + 1):
        for i in range(len(plain) - n + 1):
            gram = plain[i : i + n]
            if gram == " ":
                continue
            code = 0
            for k, c in enumerate(gram, 1):
                code = (code * int(language._ODD) + ord(c) + k) & mask
            out[((code ^ (code >> 29)) * int(language._ODD) & mask) >> (64 - language.WIDTH.bit_length() + 1)] += 1
    return out


def test_counts_against_single_grams(monkeypatch):
    texts = ["The end.", "  a  b\n\nc ", "x", "Straße ΑΒΓ и 日本語 12 ab", "one two three four five six seven " * 9, "é" * 50 + "  " * 30 + "z", "ab.."]
    for block in (1 << 20, 7, 16):
        monkeypatch.setattr(language, "BLOCK", block)
        for t in texts:
            got = language.counts(t)
            want = places(t)
            assert {i: int(got[i]) for i in np.flatnonzero(got)} == dict(want), (t, block)
    assert language.counts("12 !? \n 3½") is None and language.counts("") is None


def test_held_out_rows_are_known_and_defined_cases(spark):
    rows = made()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, " 123 \n !!", "fi"), (None, "der und die haus wasser", "fi"), (1003, "the and of water", None), (3, rows[3][1], rows[3][2]), (1004, "日本語の文章です。これは長い文です。" * 40, None), (1005, "the water house " * 40_000, None)]
    docs = table(spark, rows + odd)
    model = language.fit(docs)
    assert model.languages == ["de", "en", "fi"] and len(model.centroids) == len(model.owner) >= 6
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0 and by[1000].rejected
    assert by[None].lang_pred == "de" and by[1003].lang_pred == by[1005].lang_pred == "en"
    assert by[1004].rejected and by[1004].lang_pred in WORDS  # the nearest, but too far
    unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [by[i].lang_pred == name for i, _, name in unseen]
    assert len(right) > 30 and all(right)
    # against the formula, one text
    idf = model.idf
    v = np.zeros(language.WIDTH)
    for place, n in places(rows[5][1]).items():
        v[place] = np.log1p(n) * idf[place]
    v /= np.linalg.norm(v)
    assert abs(max(model.centroids @ v) - by[5].cosine) < 1e-5


def test_what_teaches(spark):
    """Labels of the held-out fold, null ids and null languages change nothing."""
    rows = made(60)
    one = language.fit(table(spark, rows))
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else name) for i, t, name in rows] + [(None, "xyz xyz xyz", "yy"), (7000, "xyz xyz", None)]
    two = language.fit(table(spark, other))
    assert one.languages == two.languages and np.allclose(one.centroids, two.centroids) and np.allclose(one.idf, two.idf)
    nothing = language.fit(table(spark, [(1, "some text", None), (None, "some text", "en")]))
    assert [tuple(r) for r in language.identify(table(spark, [(1, "some text", None)]), nothing).collect()] == [(1, "und", 0.0, 0.0, True)]
    assert language.identify(table(spark, []), language.fit(table(spark, []))).count() == 0


def test_mislabelled_rows_make_no_centroid(spark):
    rows = made(240)
    rng = random.Random(1)
    wrong = [(2000 + k, " ".join(rng.choices(WORDS["en"], k=40)), "fi") for k in range(3)]
    got = language.identify(table(spark, rows), language.fit(table(spark, rows + wrong)))
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {i: name for i, _, name in rows}
