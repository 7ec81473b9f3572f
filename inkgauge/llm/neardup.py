"""Near-duplicates: universal hash minima with banding, signature verification, full-set confirmation, connected components.

1. Every text becomes the set of its k-word shingles (64-bit hashes; k is 4 unless the caller says otherwise). Documents of
   equal sets are one node from here on.
2. A node has BANDS * ROWS minima under hash functions a*x + b. Nodes that agree on all minima of a band share a bucket; two
   texts at the similarity of 0.8 share none with a probability of (1 - 0.8^ROWS)^BANDS = 3e-6.
3. In each bucket, members are compared by their signatures (one byte a minimum): pairs with 60 % equal minima stay candidates
   (six standard deviations below 0.8). Only a spanning forest leaves the bucket. Its connected components are clusters that
   hold every candidate pair.
4. In each cluster, full sets are compared through an inverted index of their shingles; again only a spanning forest of the
   confirmed links leaves it. Its connected components are the answer.

A bucket or cluster of any size is cut into blocks of a fixed size, and each pair of blocks is a task's unit: no task holds an
unbounded group, no pair leaves a task but as one of at most n - 1 tree edges, and no pair is skipped. Sets of texts outside
any cluster are hardly ever shuffled: a filter of eight bits a member, 2^FILTER_BITS at most, lets the second scan pass on the
members. Keys that hold more than a thousandth of a join's rows are joined by broadcast, so they stay spread.

Defined cases: null or empty texts have no shingles and are linked with nothing; a text of fewer than k words is one shingle of
all its words; repeated rows are linked like other copies; rows of one doc_id are told apart by their text; a null doc_id sorts
last, a group of null ids alone has a null component_id and one keeper; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common
from inkgauge.llm.components import connected

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
#: Percent of equal minima from which a pair is confirmed on its full sets.
SIGNATURE_PERCENT = 60
#: Members of a bucket's block, and shingles of a cluster's block.
BUCKET_BLOCK, CLUSTER_BLOCK = 4096, 1_500_000
FILTER_BITS = 30
#: Words of a shingle where the caller doesn't say.
WIDTH = 4

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 300_000:
                self.clear()
            self[word] = h
        return h


_words = _WordHashes()


def shingle_set(text: str, k: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    x = np.full(n, width, np.uint64)
    for i in range(width):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(x)


def _set_key(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; none for the empty one."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, MINIMA, np.uint32)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x MINIMA, for sets that aren't empty."""
    a, b = _functions()
    flat = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, room = np.empty((MINIMA, len(sets)), np.uint32), np.empty_like(flat)
    for i in range(MINIMA):
        np.multiply(flat, a[i], out=room)
        np.add(room, b[i], out=room)
        np.minimum.reduceat(room, starts, out=out[i])
    return out.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    """len(signature) x BANDS bucket keys; a key is of its band alone."""
    x = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + signature[:, r::ROWS].astype(np.uint64))
    return x.view(np.int64)


_SIGNED = "row long, doc_id long, th long, n int, sk binary, keys array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    common.only_cache("neardup", _words.clear)
    row = TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in common.portions(whole, 250_000):
            sets = [shingle_set(t, k) for t in common.texts(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = minima([sets[i] for i in full]) if full else np.zeros((0, MINIMA), np.uint32)
            keys, small = band_keys(sig).tolist(), (sig >> np.uint32(7)).astype(np.uint8)
            at = {i: n for n, i in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)),
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([keys[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([small[at[i]].tobytes() if i in at else None for i in range(len(sets))], pa.binary()),
                ],
                names=["row", "doc_id", "th", "n", "sk", "keys", "sig"],
            )
            row += batch.num_rows


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by some columns, cut between groups only, with the places where groups start."""

    def starts_of(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[:1] = True
        for c in by:
            x = t.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        starts = starts_of(held)
        if len(starts) > 1:
            yield held.slice(0, int(starts[-1])), starts[:-1]
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield held, starts_of(held)


def _forest(n: int, label: np.ndarray, linked: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Tree edges that join what linked(a) (a mask over n members) says; members of a label are joined already."""
    edges = []
    for a in range(n):
        if (label != label[a]).any():
            other = np.flatnonzero(linked(a) & (label != label[a]))
            for group in np.unique(label[other]):
                edges.append((a, int(other[label[other] == group][0])))
                label[label == group] = label[a]
    return edges


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: np.ndarray | list, b: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], schema=_EDGES)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature verification inside buckets: edges of a spanning forest of the pairs that pass."""
    need = -(-SIGNATURE_PERCENT * MINIMA // 100)
    for rows, starts in _whole_groups(batches, ["key", "i", "j"]):
        node = rows.column("node").to_numpy()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, MINIMA)
        ends = np.append(starts[1:], len(node))
        first = np.repeat(starts, ends - starts)
        equal = np.concatenate([(sig[x : x + 20_000] == sig[first[x : x + 20_000]]).sum(1) for x in range(0, len(node), 20_000)])
        passed = equal >= need
        star = passed & (first != np.arange(len(node)))
        yield _edges(node[first[star]], node[star])
        mixed = np.flatnonzero(np.add.reduceat(~passed, starts) > 0)
        a, b = [], []
        for s, e in zip(starts[mixed], ends[mixed]):
            own, n = sig[s:e], int(e - s)
            label = np.where(passed[s:e], 0, np.arange(n))
            for x, y in _forest(n, label, lambda k, own=own: (own == own[k]).sum(1) >= need):
                a.append(node[s + x])
                b.append(node[s + y])
        yield _edges(a, b)


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= 80 * union, by an inverted index of the shingles."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, term, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posting, place = owner[np.argsort(term, kind="stable")], np.concatenate([[0], np.cumsum(df)])
    edge = np.concatenate([[0], np.cumsum(size)])

    def linked(a: int) -> np.ndarray:
        own = term[edge[a] : edge[a + 1]]
        n = df[own]
        ends = np.cumsum(n)
        both = np.bincount(posting[np.repeat(place[own] - (ends - n), n) + np.arange(ends[-1])], minlength=len(sets))
        return 100 * both >= 80 * (size[a] + size - both)

    return _forest(len(sets), np.arange(len(sets)), linked)


def _confirm(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Full-set confirmation inside clusters."""
    common.only_cache("neardup", _words.clear)
    for rows, starts in _whole_groups(batches, ["cluster", "i", "j"]):
        ends = np.append(starts[1:], rows.num_rows)
        a, b = [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            part = rows.slice(s, e - s)
            found: dict[int, np.ndarray] = {}
            for node, sk, text in zip(part.column("node").to_pylist(), part.column("sk").to_pylist(), part.column("text").to_pylist()):
                if node not in found and _set_key(own := shingle_set(text or "", k)) == sk:  # else another text of the same doc_id
                    found[node] = own
            nodes = list(found)
            if len(nodes) > 1:
                for x, y in links(list(found.values())):
                    a.append(nodes[x])
                    b.append(nodes[y])
        yield _edges(a, b)


def _blocks(df: DataFrame, by: str, n_blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its block is in: i <= j."""
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    rows = df.withColumn("n_blocks", n_blocks.cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return rows.drop("own", "other", "n_blocks").repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def _members_only(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """id, no, th, text of the documents whose doc_id may be among n members, by a one-hash Bloom filter; equal rows of a partition once."""
    bits_in_all = min(FILTER_BITS, max(20, (8 * n).bit_length()))
    words = 1 << (bits_in_all - 6)
    h = F.xxhash64("doc_id")
    word, bit = F.pmod(h, F.lit(words)), F.pmod(F.shiftright(h, bits_in_all - 6), F.lit(64)).cast("int")
    set_bits = members.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))  # 2^FILTER_BITS bits at most: 128 MB

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int | None, int]] = set()
        for batch in batches:
            w, b = batch.column("word").to_numpy(), batch.column("bit").to_numpy()
            mask = ((sent.value[w] >> b.astype(np.uint64)) & _U(1)).astype(bool)
            at = np.flatnonzero(mask)
            own = zip(batch.column("doc_id").take(pa.array(at)).to_pylist(), batch.column("th").take(pa.array(at)).to_pylist())
            for i, key in zip(at.tolist(), own):
                mask[i] = key not in seen
                seen.add(key)
            yield batch.select(["doc_id", "th", "text"]).filter(pa.array(mask))

    found = docs.withColumns({"word": word, "bit": bit}).mapInArrow(keep, "doc_id long, th long, text string")
    return found.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no"), "th", "text")


def groups(docs: DataFrame, k: int = WIDTH) -> DataFrame:
    """row, doc_id, n_shingles, sk (the set's key), component_id and keeper (exactly one row of each component) for every document."""
    docs = common.columns(docs, doc_id="long", text="string").withColumn("th", F.xxhash64("text"))
    signed = common.table(docs.mapInArrow(lambda batches: _sign(batches, k), _SIGNED), "neardup-signed")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row", "th")
    nodes = signed.where("sk is not null").groupBy("sk").agg(F.min("row").alias("node"), F.min(rank).alias("best"), F.count("*").alias("copies"))
    nodes = common.table(nodes, "neardup-nodes")
    one = signed.select("row", "n", "keys", "sig").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    one = common.table(one.withColumnRenamed("row", "node"), "neardup-one")

    member = one.select("node", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("members"), F.count("*").alias("copies")).where("members > 1")
    shared = common.join_hot(member, shared, "key", "copies", BANDS * one.count()).join(one.select("node", "sig"), "node")
    candidates = _blocks(shared, "key", F.ceil(F.col("members") / BUCKET_BLOCK)).select("key", "i", "j", "node", "sig").mapInArrow(_verify, "a long, b long")
    cluster = common.table(connected(candidates, "neardup-clusters"), "neardup-cluster")

    best = nodes.select("node", "sk", F.col("best.doc_id").alias("doc_id"), F.col("best.th").alias("th"))
    inside = common.table(cluster.join(best, "node").join(one.select("node", "n"), "node"), "neardup-inside")
    weight = inside.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("copies"))
    n_inside = inside.count()
    text = _members_only(docs, inside.select("doc_id"), n_inside)
    inside = common.join_hot(inside, weight, "root", "copies", n_inside).withColumnRenamed("root", "cluster")
    inside = inside.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("no", F.col("doc_id").isNull()).drop("doc_id")
    # a node is known by its best row's id and text, so rows of one id meet their own nodes alone
    met = text.join(inside.hint("merge"), ["id", "no", "th"]).select("cluster", "node", "sk", "text", "weight")
    confirmed = _blocks(met, "cluster", F.ceil(F.col("weight") / CLUSTER_BLOCK)).select("cluster", "i", "j", "node", "sk", "text").mapInArrow(lambda batches: _confirm(batches, k), "a long, b long")
    found = connected(confirmed, "neardup-links")

    # nodes of a component, and nodes that stand for several rows; all other rows are alone
    labelled = common.table(nodes.join(found, "node", "left").select("sk", "best", "copies", F.coalesce("root", "node").alias("root")), "neardup-labelled")
    chosen = labelled.groupBy("root").agg(F.min("best").alias("chosen"), F.count("*").alias("n")).where("n > 1")
    named = common.join_hot(labelled, chosen, "root", "n", labelled.count(), "left").where("copies > 1 or chosen is not null")
    named = named.select("sk", F.coalesce("chosen", "best").alias("chosen"), "copies")
    rows = signed.select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), "sk")
    joined = common.join_hot(rows.where("sk is not null"), named, "sk", "copies", signed.count(), "left")
    joined = joined.unionByName(rows.where("sk is null"), allowMissingColumns=True)
    alone = F.col("chosen").isNull()
    return joined.select("row", "doc_id", "n_shingles", "sk", F.when(alone, F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("component_id"), (alone | (F.col("chosen.row") == F.col("row"))).alias("keeper"))


def dedupe(docs: DataFrame, k: int = WIDTH) -> DataFrame:
    """docs without the documents that aren't their group's keeper; all columns stay."""
    decided = common.table(groups(docs, k), "neardup-decided")
    by_id = decided.groupBy("doc_id").agg(F.bool_and("keeper").alias("all_stay"), F.count_if("keeper").alias("stay"))
    some = common.table(by_id.where("not all_stay"), "neardup-leaving")
    staying = docs.join(some, docs["doc_id"].eqNullSafe(some["doc_id"]), "left_anti")
    again = some.where("stay > 0").select("doc_id")
    if again.isEmpty():
        return staying
    # ids that belong to several rows, some of which stay: told apart by their texts
    mixed = docs.join(again, docs["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    verdicts = decided.join(again.withColumnRenamed("doc_id", "own_id"), decided["doc_id"].eqNullSafe(F.col("own_id")), "left_semi").where("keeper").select("doc_id", "sk").distinct()
    return staying.unionByName(_of_repeated(mixed, verdicts, k))


def _of_repeated(docs: DataFrame, verdicts: DataFrame, k: int) -> DataFrame:
    """The rows of docs, whose ids repeat, that verdicts (doc_id and sk of the keepers) keep: one of a doc_id and sk, or all where a text has no shingles."""
    whole = docs.select(F.monotonically_increasing_id().alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    numbered = common.table(whole, "neardup-repeated")
    known = numbered.select("own", F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").cast("string").alias("text"))
    known = common.table(known.mapInArrow(lambda batches: _set_keys(batches, k), "own long, doc_id long, sk binary"), "neardup-repeated-keys")
    names = verdicts.select(F.col("doc_id").alias("own_id"), F.col("sk").alias("own_sk"))
    kept = known.join(names, known["doc_id"].eqNullSafe(F.col("own_id")) & known["sk"].eqNullSafe(F.col("own_sk")), "left_semi")
    # a whole set of one id has one keeper at most: equal sets are one node
    first = kept.where("sk is not null").groupBy("doc_id", "sk").agg(F.min("own").alias("own")).select("own")
    return numbered.join(first.union(kept.where("sk is null").select("own")), "own", "left_semi").select("whole.*")


def _set_keys(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.portions(whole):
            keys = [_set_key(shingle_set(t, k)) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("doc_id"), pa.array(keys, pa.binary())], names=["own", "doc_id", "sk"])


def sql(k: int = WIDTH) -> str:
    """The groups in DuckDB's SQL: all pairs of documents that share a shingle, as strings; labels spread along the links."""
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + {k - 1}], ' ') AS shingle
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {k}, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM shared JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
ends AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
label(rid, least) AS (SELECT rid, doc_id FROM d UNION SELECT y, least FROM label JOIN ends ON x = label.rid),
whole AS (SELECT rid, min(least) AS component_id FROM label GROUP BY rid)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d LEFT JOIN n USING (rid) JOIN whole USING (rid)"""
