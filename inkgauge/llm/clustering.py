"""Centroid clustering of vectors by Elkan's form of Lloyd's algorithm (llm.elkan), over whole numbers floor(FACTOR * x).

Each vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to each of the CLUSTERS centroids;
distances between centroids rule out most of the rest. Final distances are exact whole numbers.

Defined cases: vectors that are null, have another length than LENGTH, or hold a null, NaN or infinite component are left out.
Components are held within bounds (elkan.largest) that no squared distance can overflow. Repeated ids are rows of their own; where ids
tie for a start, their numbers decide; null ids have no hash and start a cluster only where all others do already. Fewer vectors than
CLUSTERS give as many clusters as vectors. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common, elkan

FACTOR, LENGTH, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, factor: int = FACTOR, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """A table of vec_id, own (the cluster, in an array of one) and squares (its distance, likewise) of vectors (vec_id, embedding); the final centroids."""
    rows = common.columns(vectors, vec_id="long", embedding="array<double>").where((F.size("embedding") == length) & elkan.sound(F.col("embedding")))
    numbers = common.table(rows.select("vec_id", elkan.whole(F.col("embedding"), factor, elkan.largest(length)).alias("v")), "clusters-numbers")
    chance = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = [r["v"] for r in numbers.orderBy(F.asc_nulls_last(chance), "v").limit(clusters).select("v").collect()]  # clusters rows
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, own array<int>, squares array<long>"), np.zeros((0, length), np.int64)
    found, books = elkan.lloyd(numbers, [np.array(first, np.int64)], ["vec_id"], rounds, "clusters-state")
    common.drop(numbers)
    return found, books[0]


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the inertia of its cluster and of all, and its centroid's checksum."""
    each = found.select("vec_id", F.col("own")[0].alias("cluster"), F.col("squares")[0].alias("distance"))
    sums = {r["cluster"]: r["s"] for r in each.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each cluster
    told = [(k, sums.get(k, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(table: str = "embeddings") -> str:
    """digest() as DuckDB SQL, its rounds written one after the other."""
    kept = f"""kept as materialized (
      select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) as r, vec_id, v from (
        select vec_id, list_transform(embedding, lambda x: floor({FACTOR} * x::double)::bigint) as v from {table}
        where len(embedding) = {LENGTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
    mid0 as materialized (select r - 1 as c, v from kept where r <= {CLUSTERS})"""
    square = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} as materialized (
      select r, any_value(v) as v, arg_min(c, (d, c)) as c, min(d) as d from (select a.r, a.v, b.c, {square}::bigint as d from kept a, mid{k} b) group by r)""")
        if k < ROUNDS:
            steps.append(f"""mid{k + 1} as materialized (
      select m.c, coalesce(n.v, m.v) as v from mid{k} m left join (
        select c, list(floor_mean order by i) as v from (
          select c, i, (s - ((s % n) + n) % n) // n as floor_mean from (
            select c, i, sum(v[i])::hugeint as s, count(*)::hugeint as n from near{k}, range(1, {LENGTH} + 1) t(i) group by c, i)) group by c) n using (c))""")
    return f"""with {kept}, {', '.join(steps)}
    select k.vec_id, n.c::integer as cluster, n.d as distance, (sum(n.d) over (partition by n.c))::bigint as cluster_inertia,
      (sum(n.d) over ())::bigint as inertia, sha256(array_to_string(m.v, ',')) as centroid_sha256
    from kept k join near{ROUNDS} n using (r) join mid{ROUNDS} m using (c)"""
