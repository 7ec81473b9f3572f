"""Vector codes and clusters against plain Lloyd rounds in Python's own whole numbers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from inkgauge.llm import clustering, elkan, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, v string, own string, upper string, lower string, squares string, e string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", "o", "u", "l", "s", "e") for r in rows], SCHEMA).repartition(3)


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def plain(points, entries, rounds):
    """Lloyd's algorithm, every distance worked out: the entry and squared distance of each point, and the entries."""
    entries = [list(e) for e in entries]
    nearest = lambda p: min((square(p, e), k) for k, e in enumerate(entries))
    for _ in range(rounds):
        own = [nearest(p)[1] for p in points]
        for k in set(own):
            mine = [p for p, o in zip(points, own) if o == k]
            entries[k] = [math.floor(sum(c) / len(mine)) if abs(sum(c)) < 2**50 else sum(c) // len(mine) for c in zip(*mine)]
    return [nearest(p)[::-1] for p in points], entries


def vectors(length, n=400, seed=3):
    """Random vectors of a few groups with ties, copies, repeated and null ids, and rows that must be left out."""
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 0.3) for _ in range(length)] for _ in range(7)]
    rows = [(k, [x + rng.gauss(0, 0.1) for x in rng.choice(mids)], k % 5 if k % 11 else None) for k in range(n)]
    rows += [(n + k, [round(x * 2) / 2 for x in rng.choice(mids)], 1) for k in range(60)]  # many ties and copies
    rows += [(7, rows[9][1], 2), (None, rows[3][1], None), (None, rows[4][1], 3)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.5] * (length - 1) + [None], 1), (903, [float("nan")] + [0.0] * (length - 1), 1), (904, [float("-inf")] * length, 1), (905, [0.1] * (length + 3), 1), (906, [0.1], None)]
    return rows, bad


def test_codes_against_plain_rounds(spark):
    rows, bad = vectors(8)
    coded, books = vector_codes.encode(table(spark, rows + bad))
    got = vector_codes.digest(coded, books).collect()
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, ints[k]))
    codes, errors, flat = [""] * len(rows), [0] * len(rows), []
    for p in range(4):
        part = [v[2 * p : 2 * p + 2] for v in ints]
        found, entries = plain(part, [part[k] for k in order[:256]], 4)
        for k, (e, d) in enumerate(found):
            codes[k], errors[k] = codes[k] + f"{e:02x}", errors[k] + d
        flat += [x for e in entries for x in e]
    sums = {}
    for (_, _, label), e in zip(rows, errors):
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    key = lambda r: (r[0] is None, r)
    want = sorted(((i, c, e, sums[label], sha) for (i, _, label), c, e in zip(rows, codes, errors)), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == want and key
    back = {r.vec_id: r.embedding for r in vector_codes.decode(coded, books).collect()}
    assert all(square(back[i], v) <= 4 * (e + 100) / 1024**2 for (i, v, _), e in zip(rows[20:200], errors[20:200]))


def test_clusters_against_plain_rounds(spark):
    rows, bad = vectors(64)
    got = clustering.digest(*clustering.cluster(table(spark, rows + bad))).collect()
    ints = [[math.floor(64 * x) for x in v] for _, v, _ in rows]
    chance = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, chance(rows[k][0]), ints[k]))
    found, centroids = plain(ints, [ints[k] for k in order[:16]], 3)
    inertia = {}
    for c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _, _), (c, d) in zip(rows, found)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_few_rows_and_no_rows(spark):
    few = [(3, [0.25, -0.5, 1e30, -1e300], None), (1, [0.25, -0.5, 0.0, 0.0], 4)]
    rows = {r.vec_id: r for r in vector_codes.digest(*vector_codes.encode(table(spark, few))).collect()}
    assert rows[1].code == "00000000" and rows[3].code == "00000101" and rows[3].error == rows[3].label_error == 0
    assert vector_codes.digest(*vector_codes.encode(table(spark, []))).count() == 0
    assert clustering.digest(*clustering.cluster(table(spark, few))).count() == 0
    one = clustering.digest(*clustering.cluster(table(spark, [(None, [0.1] * 64, 1), (5, [0.1] * 64, 1)]))).collect()
    assert {r.vec_id for r in one} == {None, 5} and {(r.cluster, r.distance) for r in one} == {(0, 0)}


@pytest.mark.parametrize("spread", [3, 40, 1 << 22])
def test_bounds_never_change_an_assignment(spread):
    """Rounds of the pruned step against all distances, with small whole numbers (many ties), coinciding entries and large numbers."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (700, 5))
    entries = x[:40].copy()
    entries[7] = entries[3]
    book = elkan.Book.of(entries)
    held = elkan.started(x, book)
    skipped = 0
    for _ in range(6):
        all_ = np.array([[square(a.tolist(), e.tolist()) for e in book.entries] for a in x])
        assert (held.own == all_.argmin(1)).all()
        exact = np.sqrt(all_.astype(float))
        assert (held.upper >= exact[np.arange(700), held.own]).all() and (held.lower <= exact + 1e-9).all()
        sums = np.zeros((1, 40, 6), object)
        for k in range(40):
            mine = x[held.own == k]
            sums[0, k, 0], sums[0, k, 1:] = len(mine), [int(v) for v in mine.sum(0)]
        [book] = elkan.updated([book], sums)
        held.lower = np.clip(np.floor(held.lower / book.step), 0, 255) * book.step
        skipped += int(((held.upper + book.move[held.own])[:, None] < held.lower - book.move).sum())
        held = elkan.moved(x, book, held)
    assert skipped > 1_000 or spread == 3


def test_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    x, e = rng.integers(-(1 << 27), 1 << 27, (20, 16)), rng.integers(-(1 << 27), 1 << 27, (9, 16))
    assert elkan.squares(x, e).tolist() == [[square(a, b) for b in e.tolist()] for a in x.tolist()]
    at, entry = np.array([0, 3, 3]), np.array([1, 0, 8])
    assert elkan.between(x, e, at, entry).tolist() == [square(x[a].tolist(), e[b].tolist()) for a, b in zip(at, entry)]
    assert pa.array(elkan.root_up(np.array([2**60]))).to_pylist()[0] > 2**30


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroid_clusters"])
def test_registered_queries_against_their_sql(spark, tmp_path, name):
    import duckdb

    from inkgauge.llm import queries

    rows, bad = vectors(64, 300)
    bad = [r for r in bad if r[1] is None or len(r[1]) == 64]  # the SQL knows one length
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()[name]).fetchall(), key=repr) and len(got) == len(rows)


def test_registered_language_query(spark, tmp_path):
    import zlib

    from inkgauge.llm import queries

    rows = [(k, "the house and the water of the world " * (k % 3 + 1) if k % 2 else "das haus und das wasser der welt " * (k % 3 + 1), "en" if k % 2 else "de", "s", 9) for k in range(40)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_language_id(spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in ("doc_id", "held_out", "lang_pred", "score")} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = df.collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == 41
    assert all(r.lang_pred == ("und" if r.doc_id is None else "en" if r.doc_id % 2 else "de") and 0 <= r.score <= 1 for r in got)
