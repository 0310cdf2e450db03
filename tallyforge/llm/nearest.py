"""Approximate nearest neighbours by cosine over balanced posting lists.

Equal vectors are one entry that carries its smallest ids, so a vector that a third of the rows share is searched and stored once, and its
rows meet again only in the answers. Postings and probes are joined per list, and long lists are split into blocks, so no task
holds more than a block of vectors and the probes of its list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.posting_lists import PostingIndex, fit_index, unit
from tallyforge.llm.shared import stored

#: The bound of the sample that the index is fitted on; vectors per list aimed at; the most lists; postings per block; pairs scored at a time.
MOST_SAMPLED, LIST_SIZE, MOST_LISTS, BLOCK, PAIRS = 20_000, 200, 4096, 4096, 1 << 14


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def usable(vector: Column) -> Column:
    """Not null, of finite components, and not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & (length > 0)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``vector, ids``: the ``most`` smallest ids of each distinct vector, ascending. Tasks keep that many per vector before the shuffle."""
    ranked = rows.select("vector", "id").distinct().withColumn("rank", F.expr("row_number() OVER (PARTITION BY vector ORDER BY id)")).where(F.col("rank") <= most)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def search(table: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, probes: int | None = None, ratio: float = 1.35, copies: int = 4, boundary: float = 1.15) -> DataFrame:
    """Per row of ``table`` for which ``is_query`` holds: its ``k`` nearest other rows found, as ``query_id, rank, id_col, score``.

    Score is the cosine in double precision of the vectors as they are; equal scores go to smaller ids. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do rows without id, nor vectors of another length than the most common
    one (ties: the longest). Rows that repeat a query's id are never its neighbours, and the query is answered once. With fewer candidates there
    are fewer rows; an empty table gives none. ``lists`` and ``probes`` grow with the number of distinct vectors by default.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), is_query.alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    answer = f"query_id long, rank int, {id_col} long, score double"
    if sizes is None:
        return spark.createDataFrame([], answer)
    rows = rows.where(F.size("vector") == sizes["d"])
    entries = stored(distinct_vectors(rows.select("id", "vector"), k + 1), "vectors")
    n = entries.count()
    lists = lists or int(np.clip(n // LIST_SIZE, 8, MOST_LISTS))
    probes = probes or max(32, lists // 6)
    sample = entries.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).select("vector").limit(MOST_SAMPLED).toArrow()
    index = spark.sparkContext.broadcast(fit_index(unit(_matrix(sample.column("vector").combine_chunks())), lists))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                at, where = index.value.assign(unit(_matrix(part.column("vector"))), copies=copies, ratio=boundary)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), taken.column("vector"), taken.column("ids")], ["list", "vector", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                at, where = index.value.probe(unit(_matrix(part.column("vector"))), most=probes, ratio=ratio)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), taken.column("query"), taken.column("vector")], ["list", "query", "vector"])

    postings = stored(entries.mapInArrow(post, "list int, vector array<float>, ids array<long>").withColumn("entry", F.xxhash64("vector")), "postings")
    # At most ``lists`` rows, whatever the table's size.
    blocks = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.col("entry"), F.col("blocks")).cast("int")
    dealt = postings.join(F.broadcast(blocks), "list").select("list", block.alias("block"), "vector", "ids", "entry")
    askers = rows.where("is_query").groupBy("vector").agg(F.min("id").alias("query"))
    asked = askers.select("query", "vector").mapInArrow(probe, "list int, query long, vector array<float>").join(F.broadcast(blocks), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "vector")

    def score(posted: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if posted.num_rows and asking.num_rows:
            v = _matrix(posted.column("vector").combine_chunks()).astype(np.float64)
            ids, entry = posted.column("ids").to_pylist(), posted.column("entry").to_pylist()
            length, smallest = np.sqrt((v * v).sum(axis=1)), np.array([x[0] for x in ids])
            for a in range(0, asking.num_rows, 256):
                part = asking.slice(a, 256)
                q = _matrix(part.column("vector").combine_chunks()).astype(np.float64)
                near = (q @ v.T) / length
                asker = np.sqrt((q * q).sum(axis=1))
                # All that the fast product's rounding leaves open; the exact measure, then the smallest id, decides.
                wide = min(len(v), k + 1)
                last = np.partition(near, len(v) - wide, axis=1)[:, len(v) - wide]
                one, other = np.nonzero(near >= (last - 4 * (v.shape[1] + 8) * np.finfo(np.float64).eps * asker)[:, None])
                exact = np.empty(len(one))
                for b in range(0, len(one), PAIRS):
                    i, j = one[b : b + PAIRS], other[b : b + PAIRS]
                    exact[b : b + PAIRS] = (q[i] * v[j]).sum(axis=1) / (asker[i] * length[j])
                order = np.lexsort((smallest[other], -exact, one))
                at = np.arange(len(order)) - np.searchsorted(one, one)
                query = part.column("query").to_pylist()
                out += [(query[one[p]], entry[other[p]], ids[other[p]], exact[p]) for p in order[at <= k]]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()))], ["query", "entry", "ids", "score"])

    scored = dealt.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInArrow(score, "query long, entry long, ids array<long>, score double")
    # A list's copies give an entry again. Ids may repeat, so a vector's hash tells entries apart.
    best = scored.groupBy("query", "entry").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = best.withColumn("place", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, ids[0])")).where(F.col("place") <= k + 1)
    found = best.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    queries = rows.where("is_query").select(F.col("id").alias("query_id"), "vector").join(askers, "vector").join(found, "query").select("query_id", "found").dropDuplicates(["query_id"])
    near = queries.select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("id")).where("id <> query_id")
    ranked = near.distinct().withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
