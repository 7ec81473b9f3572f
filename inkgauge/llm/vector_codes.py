"""Product quantization of vectors into short codes: each part of a vector by the number of the nearest entry of its part's codebook.

Components become floor(FACTOR * x); codebooks start as the parts of the ENTRIES smallest ids and are moved by ROUNDS of Elkan's form of
Lloyd's algorithm (llm.elkan), whose bounds are kept with each vector: one upper bound a part, one lower bound an entry.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite component, are left out; so are empty vectors and those of
another length than the commonest one that PARTS divides (of equally common ones the shortest), since they have no place in the
codebooks. Components are held within bounds (elkan.largest) that no squared distance can overflow. Repeated ids are rows of their own;
for the start, equal ids are ordered by their numbers, null ids come last and may be coded like others. Fewer rows than ENTRIES give as
many entries as rows. Null labels are one group. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common, elkan

FACTOR, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
_CODED = "vec_id long, label string, code binary, error long"


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> tuple[DataFrame, list[np.ndarray]]:
    """A table of vec_id, label, own (an entry's number for each part) and squares (the squared distance to it) of vectors (vec_id, embedding, label); the codebooks by part."""
    spark = vectors.sparkSession
    rows = common.columns(vectors, vec_id="long", embedding="array<double>", label="string").where(elkan.sound(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().where(f"n > 0 and n % {parts} = 0").orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, label string, own array<int>, squares array<long>"), []
    length = sizes["n"]
    width = length // parts
    numbers = rows.where(F.size("embedding") == length).select("vec_id", "label", elkan.whole(F.col("embedding"), factor, elkan.largest(width)).alias("v"))
    numbers = common.table(numbers, "codes-numbers")
    first = np.array([r["v"] for r in numbers.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], np.int64)  # entries rows
    start = [first[:, p * width : (p + 1) * width] for p in range(parts)]
    coded, books = elkan.lloyd(numbers, start, ["vec_id", "label"], rounds, "codes-state")
    common.drop(numbers)
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of its label. Sums are made before they move; rows of common labels stay where they are."""
    keyed = coded.withColumn("group", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = common.table(keyed.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies")), "codes-labels")
    total = sums.agg(F.sum("copies")).first()[0] or 0
    return common.join_hot(keyed, sums, "group", "copies", total).drop("group")


def digest(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, code in hexadecimal, error, label_error and the checksum of all codebooks."""
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    code = F.array_join(F.transform("own", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    rows = coded.select("vec_id", "label", code.alias("code"), F.aggregate("squares", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    return label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: list[np.ndarray], factor: int = FACTOR) -> DataFrame:
    """coded with embedding, the vector that its code stands for: each entry's components, in the middle of what was rounded down to them."""
    held = F.array(*(F.array(*(F.array(*(F.lit((v + 0.5) / factor) for v in e)) for e in b.tolist())) for b in books)) if books else F.expr("cast(array() as array<array<array<double>>>)")
    return coded.withColumn("embedding", F.flatten(F.transform("own", lambda e, p: F.get(F.get(held, p), e))))


def sql(table: str = "embeddings") -> str:
    """digest() as DuckDB SQL, its rounds written one after the other."""
    kept = f"""kept as materialized (
      select row_number() over (order by vec_id nulls last, v) as r, vec_id, label, v from (
        select vec_id, label, list_transform(embedding, lambda x: floor({FACTOR} * x::double)::bigint) as v from {table}
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
    parts as materialized (
      select r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as w from kept, range({PARTS}) t(p)),
    book0 as materialized (select p, r - 1 as e, w from parts where r <= {ENTRIES})"""
    square = "list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} as materialized (
      select r, p, any_value(w) as w, arg_min(e, (d, e)) as e, min(d) as d from (
        select a.r, a.p, a.w, b.e, {square}::bigint as d from parts a join book{k} b using (p)) group by r, p)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} as materialized (
      select b.p, b.e, coalesce(n.w, b.w) as w from book{k} b left join (
        select p, e, list(floor_mean order by i) as w from (
          select p, e, i, (s - ((s % n) + n) % n) // n as floor_mean from (
            select p, e, i, sum(w[i])::hugeint as s, count(*)::hugeint as n from near{k}, range(1, (select max(len(w)) from parts) + 1) t(i) group by p, e, i)) group by p, e) n using (p, e))""")
    last = f"near{ROUNDS}"
    return f"""with {kept}, {', '.join(steps)},
    coded as materialized (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from {last} group by r),
    books as (select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS})
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
    from kept join coded using (r), books"""
