"""The registered queries on a small folder with nulls, repeats, ties, empty and very long texts, clashing columns and empty tables."""

import hashlib
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgauge.llm import bpe, common, components, decontamination, licenses, neardup, packing, quality, queries, secret_scan, toxicity

#: Names that the operators use themselves.
CLASHING = ("row", "_id", "_own", "_md5", "own", "sk", "th", "md5", "spans", "base", "found", "score", "a", "b", "key", "cluster", "y", "x", "text2")
COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_token_counts": "doc_id bigint, n_tokens bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
}


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    plain = [" ".join(word() for _ in range(90)) + "." for _ in range(60)]
    plain[1::5] = [p.replace(" ", " idiot ", 9) for p in plain[1::5]]
    plain[2::4] = [" | ".join(w.upper() + "###" for w in p.split()) for p in plain[2::4]]
    passage = " ".join(word() for _ in range(25))
    long = " ".join(word() for _ in range(20_000))
    more = [plain[0], plain[0] + " more", "x " + passage + " y", long, long + " end", "", None, " \n ", "MIT License. cc by, token=abcdefgh12", "日本語" * 7000, plain[0]]
    return plain + more, passage


def folder(spark, path, empty=False):
    own, passage = texts()
    ids = [*range(len(own) - 2), None, 3]
    rows = [] if empty else [(i, t, *["c"] * len(CLASHING)) for i, t in zip(ids, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    labels = [] if empty else [(i, int(i % 4 != 2), int(i % 5 == 1)) for i in range(60)] + [(None, 1, 1), (0, 1, 0)]
    bench = [] if empty else [("7", passage), ("7", passage), (None, "qqq rrr"), ("8", None), ("9", "")]
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return own, ids


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    return (path, *folder(spark, path))


def in_order(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, small, name):
    path, own, ids = small
    df = queries.queries()[name](spark, path)
    kinds = dict(df.dtypes)
    wanted = dict(c.split(" ") for c in COLUMNS[name].split(", "))
    assert {c: kinds[c] for c in wanted} == wanted
    rows = df.collect()
    if name == "op7_packing":
        assert {r.doc_id for r in rows} == set(ids)
        full = {}
        for r in rows:
            full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
        assert all(n == 1024 for s, n in full.items() if s != max(full))
        return
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in ids)
    by = {r.doc_id: r for r in rows if r.doc_id != 3}
    if "held_out" in wanted:
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
        limit = 0.5 if name == "op4_quality" else 0.7
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in rows)
    if name == "op1_license_scan":
        at = own.index("MIT License. cc by, token=abcdefgh12")
        assert (by[at].base_labels, by[at].first_word, by[at].last_word, by[at].n_base) == ("cc-by,mit", 0, 2, 2)
        assert (by[own.index("")].first_word, by[own.index("")].labels, by[own.index("")].score) == (None, "", 0.0)
    if name == "op5_decontamination":
        assert [r.doc_id for r in rows if r.contaminated] == [62] and by[62].n_hit == 25
        assert by[62].items_sha256 == hashlib.sha256(b"7").hexdigest()
    if name == "op8_secret_scan":
        assert by[own.index("MIT License. cc by, token=abcdefgh12")].n_assign == 1
    if name == "op10_near_dedup":
        assert (by[60].component_id, by[61].component_id, by[64].component_id, by[65].component_id) == (0, 0, 63, 65)
        assert [r.kept for r in rows if r.doc_id == 3].count(True) == 1 and by[None].n_shingles == 1


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, tmp_path, name):
    folder(spark, str(tmp_path), empty=True)
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline_from_end_to_end(spark, small):
    path, own, ids = small
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.table(stage(spark, docs, path), "test")
        assert after.columns == docs.columns
        seen.append(sorted((r.doc_id is None, r.doc_id or 0) for r in after.collect()))
        docs = after
    judged = docs.sparkSession.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(judged, spark.read.parquet(f"{path}/labels.parquet"))
    good = judged.where(quality.score(F.col("text"), model) >= 0.5)
    assert seen[0] == sorted((r.doc_id is None, r.doc_id or 0) for r in good.collect())
    assert set(seen[3]) == set(seen[2]) <= set(seen[1]) <= set(seen[0]) and (False, 62) not in seen[2]
    assert "abcdefgh12" not in "".join((r.text or "") for r in docs.collect())
    packed = corpus_pipeline.run(spark, path).collect()
    want = [e.ids + [0] for e in bpe.ChunkEncoder("byte_bpe_50k.json").library.encode_batch([(r.text or "") for r in docs.collect()], add_special_tokens=False)]
    assert sum(r.length for r in packed) == sum(map(len, want))
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, {}).setdefault(r.doc_tokens, []).append((r.start, r.length, r.ids_crc32))
    for row, ids in zip(docs.collect(), want):  # ids that repeat have texts of different lengths here
        at = 0
        for start, length, crc in sorted(set(pieces[row.doc_id][len(ids)])):
            assert start == at and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder(spark, str(tmp_path), empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_encoder_memory_is_bounded():
    coder = bpe.ChunkEncoder("byte_bpe_50k.json")
    rng = random.Random(2)
    kana = [chr(c) for c in range(0x3041, 0x30F0)]
    used = set()
    for _ in range(4):
        some = ["".join(rng.choices(kana, k=300)) for _ in range(200)]
        flat, sizes = coder.encode(pa.array(some))
        want = [e.ids for e in coder.library.encode_batch(some, add_special_tokens=False)]
        assert flat.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
        used.add(coder.used)
    assert used == {0} and len(coder.index) == 0


def test_remembered_chunks_are_compact():
    coder = bpe.ChunkEncoder("byte_bpe_50k.json")
    texts = pa.array([" ".join(f"w{k:07d}" for k in range(lo, lo + 20_000)) for lo in range(0, 100_000, 20_000)])
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        coder.encode(texts)
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(coder.index) >= 99_000 and held < 130 * len(coder.index)


def test_long_texts_cost_in_proportion(spark):
    took = {}
    for n in (2_000, 20_000, 40_000):
        docs = spark.createDataFrame([(1, "token=abcdefgh12 " * n)], "doc_id long, text string")
        began = time.time()
        clean = secret_scan.without_secrets(docs).first().text
        took[n] = time.time() - began
        assert clean == "[REDACTED] " * n
    assert took[40_000] < 3 * took[20_000] + 1


def test_discriminant_against_its_formula():
    rng = np.random.default_rng(3)
    x = {0: rng.normal(0, 1, (400, 3)), 1: rng.normal(0.8, 0.5, (300, 3))}
    both = np.concatenate([x[0], x[1]])
    centre, scale = both.mean(0), both.std(0)
    covs = {c: np.cov(((v - centre) / scale).T, bias=True) for c, v in x.items()}
    means = [((v - centre) / scale).mean(0) for v in x.values()]
    factors = [np.linalg.inv(np.linalg.cholesky(covs[c])) for c in (0, 1)]
    model = quality.Model(centre, scale, means, factors, [float(np.linalg.slogdet(covs[c])[1]) for c in (0, 1)])
    z = (both - centre) / scale
    density = [-0.5 * np.einsum("ij,jk,ik->i", z - means[c], np.linalg.inv(covs[c]), z - means[c]) - 0.5 * np.linalg.slogdet(covs[c])[1] for c in (0, 1)]
    assert np.allclose(model.difference(both), density[1] - density[0])


def dense_label_model(v, y):
    """The label model row by row in dense arrays, each sum written out."""
    first, low, high = toxicity.ACCURACY
    n, m = v.shape
    silent = v[:, -1] == 1
    q = np.where(y >= 0, np.where(y == 1, first, 1 - first), np.where(silent, 0.02, 0.3))
    share = np.ones(m)
    for k in range(toxicity.ROUNDS):
        rate1 = ((q[:, None] * v).sum(0) + 0.3) / (q.sum() + 1.6)
        rate0 = (((1 - q)[:, None] * v).sum(0) + 0.3) / ((1 - q).sum() + 1.6)
        if k in toxicity.CORRELATED_AT:
            rest = v - q[:, None] * rate1 - (1 - q)[:, None] * rate0
            cov = sum(np.outer(r, r) for r in rest)
            dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            rho = cov / np.outer(dev, dev) - np.eye(m)
            share = np.array([1 / (1 + sum(x for x in row if x >= toxicity.CORRELATED)) for row in rho])
        known = y >= 0
        accuracy = min(high, max(low, np.where(y == 1, q, 1 - q)[known].mean()))
        balance = (q.sum() + 1) / (n + 2)
        logit = np.log(balance / (1 - balance)) + v @ (share * np.log(rate1 / rate0)) + np.where(known, np.where(y == 1, 1, -1) * np.log(accuracy / (1 - accuracy)), 0)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def test_label_model_against_brute_force(spark):
    rng = random.Random(5)
    rows, truth = [], []
    for k in range(1500):
        toxic = rng.random() < 0.3
        votes = [j for j, (hit, false) in enumerate(((0.8, 0.02), (0.6, 0.03), (0.4, 0.01))) if rng.random() < (hit if toxic else false)]
        if 1 in votes and rng.random() < 0.9:
            votes.append(3)  # says what the second says
        rows.append((votes or [4], int(toxic) if k < 300 else -1, 1.0))
        truth.append(toxic)
    model = toxicity.label_model(spark.createDataFrame(rows, "votes array<int>, y int, weight double"), 4)
    gold = np.array([y for _, y, _ in rows])
    q = model.posterior([np.array(v) for v, _, _ in rows], gold)
    v = np.zeros((len(rows), 5))
    for i, (votes, _, _) in enumerate(rows):
        v[i, votes] = 1
    assert np.allclose(q, dense_label_model(v, gold), atol=1e-6) and model.share[1] < 0.7 and model.share[0] > 0.9
    assert np.mean((q > 0.5) == np.array(truth)) > 0.9


def test_noisy_labels_are_found_out(spark):
    """Labels that are right in 70 of 100 rows, beside four good voters: their accuracy is estimated, and the posterior is far better than they are."""
    rng = random.Random(6)
    rows, truth = [], []
    for _ in range(2000):
        toxic = rng.random() < 0.4
        votes = [j for j, hit in enumerate((0.9, 0.85, 0.8, 0.8)) if rng.random() < (hit if toxic else 0.015)]
        rows.append((votes or [4], int(toxic == (rng.random() < 0.7)), 1.0))
        truth.append(toxic)
    model = toxicity.label_model(spark.createDataFrame(rows, "votes array<int>, y int, weight double"), 4)
    gold = np.array([y for _, y, _ in rows])
    q = model.posterior([np.array(v) for v, _, _ in rows], gold)
    assert 0.65 < model.accuracy < 0.75 and np.mean((q > 0.5) == np.array(truth)) > 0.95
    v = np.zeros((len(rows), 5))
    for i, (votes, _, _) in enumerate(rows):
        v[i, votes] = 1
    assert np.allclose(q, dense_label_model(v, gold), atol=1e-6)


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_WORDS", 50)
    voters = toxicity.Voters(["=clown", "^trash"], [3.0, 2.0])
    plain = toxicity.Voters(["=clown", "^trash"], [3.0, 2.0])
    texts = ["clown trashy " + "x" * (30 + k) + " " + "".join(random.Random(k).choices("abcdefgh", k=7)) for k in range(200)]
    monkeypatch.setattr(toxicity, "PATTERNS", ())
    monkeypatch.setattr(toxicity, "_PATTERNS", ())
    assert [voters.counts(t) for t in texts] == [plain.counts(t) for t in texts] and voters.counts(texts[0])[1] == 2
    assert len(voters.seen) <= 54 and max(map(len, voters.seen)) <= toxicity.HELD_LENGTH


def test_many_notices_cost_in_proportion():
    from inkgauge.llm import licence_texts

    index = licenses.Index({}, 1000)
    one = licenses.words_of(next(text for label, text, _ in licence_texts.NOTICES if label.startswith("mit")) + " and so on and on")
    took = {}
    for n in (1_000, 4_000):
        began = time.time()
        found, _ = index.scan(one * n)
        took[n] = time.time() - began
        assert len([m for m in found if m[0].startswith("mit") and not m[4]]) == n
    assert took[4_000] < 4 * 1.5 * took[1_000] + 0.5


def test_notices_are_found_by_agreeing_rare_words():
    from inkgauge.llm import licence_texts

    index = licenses.Index({b"the": 900, b"software": 300, b"license": 200}, 1000)
    for label, text, _ in licence_texts.NOTICES:
        own = licenses.words_of("some words before " + text + " and some after")
        found, score = index.scan(own)
        assert label.split("-")[0] in {m[0].split("-")[0] for m in found if not m[4]} and score > 0.9, label
    assert index.scan(licenses.words_of("in the event that the software will be made available to a person")) == ([], pytest.approx(0, abs=0.4))


def test_hub_and_chain_components(spark):
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5400)] + [(rng.randrange(9000, 9100), rng.randrange(9000, 9100)) for _ in range(80)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {v: find(v) for v in root}


def test_clashing_names_and_repeated_ids(spark):
    rows = [(1, "one two three four five six", *["c"] * len(CLASHING)), (1, "one two three four five six", *["d"] * len(CLASHING)), (1, "quite another text of some words", *["e"] * len(CLASHING)), (None, "one two three four five six", *["f"] * len(CLASHING))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    kept = neardup.dedupe(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["one two three four five six", "quite another text of some words"]
    bench = spark.createDataFrame([("i", "quite another text of some words")], "item_id string, text string")
    left = decontamination.without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == 3
    assert packing.pack(docs).select("doc_id").distinct().count() == 2 and secret_scan.without_secrets(docs).columns == docs.columns
