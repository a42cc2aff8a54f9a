"""The most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded, seeded sample; every vector is indexed. A vector belongs to the list of its
nearest centroid and keeps its residual as one byte per subspace. There are about 2 * sqrt(n) lists at every size: where the sample
can't support so many centroids, each is refined by residual centroids that all share. As a query a vector looks into as many
lists as a wanted recall takes, which is measured: a seeded set of held-out queries is searched exactly over all vectors, and
the lists their true neighbours lie in are counted.

Lists that lie close together share a bucket, and a vector travels once to each bucket it looks into. In a bucket, tables of the products of
query and codewords give approximate cosines of all members (asymmetric distances), the best of the whole bucket are reranked with the full
vectors. Buckets with many members or many askers are cut along both into parts, so no task holds all of either.

Equal vectors are searched once and take part in the result as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import Scratch

LEAST_PROBES = 4  # lists a vector looks into at least
HELD_OUT = 512  # queries whose exact neighbours decide how many lists to look into


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of the rows of ``x``; empty clusters restart from random rows."""
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centers = sums / np.maximum(n, 1)[:, None].astype(x.dtype)
        empty = np.flatnonzero(n == 0)
        centers[empty] = x[rng.choice(len(x), len(empty))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centers of each row, nearest first."""
    far = (centers**2).sum(1)[None, :] - 2 * x @ centers.T
    if k == 1:
        return far.argmin(1)[:, None]
    k = min(k, len(centers))
    some = np.argpartition(far, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)


@dataclass
class Index:
    """The fitted parts: about 2 * sqrt(n) centroids, 256 codewords a subspace, and where the lists lie."""

    centers: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]
    bucket: np.ndarray  # of each list
    member_parts: np.ndarray  # of each bucket
    asker_parts: np.ndarray
    probes: int

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        parts = [nearest(residuals[:, a:b], book, 1)[:, 0] for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        return np.stack(parts, axis=1).astype(np.uint8)


def _buckets(centers: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Bucket of each list: lists are halved along their widest direction until a bucket's weight is at most ``most``."""
    bucket = np.zeros(len(centers), dtype=np.int32)
    count, todo = 0, [np.arange(len(centers))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or weight[own].sum() <= most:
            bucket[own] = count
            count += 1
            continue
        x = centers[own] - centers[own].mean(0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        order = own[np.argsort(along, kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2) + 1, 1, len(order) - 1))
        todo += [order[:half], order[half:]]
    return bucket


def coarse_centers(sample: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """``lists`` centroids, or slightly more: at most one for 4 vectors of the sample is fitted, each refined by the same residual centroids."""
    fitted = k_means(sample, min(lists, max(1, len(sample) // 4)), 8, rng)
    fine = -(-lists // len(fitted))
    if fine == 1:
        return fitted
    residuals = sample - fitted[nearest(sample, fitted, 1)[:, 0]]
    return (fitted[:, None, :] + k_means(residuals, fine, 8, rng)[None, :, :]).reshape(-1, sample.shape[1])


def probes_for(recall: float, queries: np.ndarray, owners: np.ndarray, neighbours: np.ndarray, centers: np.ndarray) -> int:
    """The lists to look into so that the share ``recall`` of the neighbours (rows of vectors; owners: their query's place) lies in them."""
    if not len(neighbours):
        return min(LEAST_PROBES, len(centers))
    own = nearest(neighbours, centers, 1)[:, 0]
    far = (centers**2).sum(1)[None, :] - 2 * queries @ centers.T
    rank = np.sort((far[owners] < far[owners, own][:, None]).sum(1))
    needed = int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1
    return min(len(centers), max(LEAST_PROBES, needed))


def fit_index(sample: np.ndarray, centers: np.ndarray, total: int, probes: int, subspaces: int, bucket_rows: int, seed: int) -> Index:
    rng = np.random.default_rng(seed)
    near = nearest(sample, centers, probes)
    own = near[:, 0]
    residuals = sample - centers[own]
    cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int).tolist()
    books = [k_means(residuals[:, a:b], 256, 6, rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    scale = total / len(sample)
    weight = np.bincount(own, minlength=len(centers)) * scale
    bucket = _buckets(centers, weight, bucket_rows)
    members = np.bincount(bucket, weights=weight)
    seen = np.unique(np.repeat(np.arange(len(sample)), near.shape[1]) * (bucket.max() + 1) + bucket[near].ravel())  # a vector asks a bucket once
    askers = np.bincount(seen % (bucket.max() + 1), minlength=len(members)) * scale
    parts = lambda rows, most: np.maximum(1, np.ceil(rows / most)).astype(np.int64)
    return Index(centers, cuts, books, bucket, parts(members, 2 * bucket_rows), parts(askers, 16 * bucket_rows), probes)


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), dtype=kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


PLACED = "bucket int, part int, asks int, cid long, id string, vec binary, list int, codes binary, looks array<int>"


def place_vectors(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    """Rows (PLACED) that carry the vectors (cid, id, vec) of a batch to their buckets: as a member to its own, as an asker to all it looks into.

    A bucket is cut into ``member_parts`` x ``asker_parts`` groups; a member goes to all of its row, an asker to all of its column.
    """
    x = _matrix(batch.column(2))
    near = nearest(x, index.centers, index.probes)
    codes = index.codes(x - index.centers[near[:, 0]])
    cid = batch.column(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(x)), near.shape[1])
    looks, at = near.ravel(), index.bucket[near].ravel()
    order = np.lexsort((at, row))
    row, looks, at = row[order], looks[order].astype(np.int32), at[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
    length = np.diff(np.r_[first, len(row)])
    g_row, g_bucket = row[first], at[first]
    mixed = (cid[g_row].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n_m, n_a = index.member_parts[g_bucket], index.asker_parts[g_bucket]
    own_m, own_a = (mixed >> np.uint64(33)).astype(np.int64) % n_m, (mixed >> np.uint64(17)).astype(np.int64) % n_a
    belongs = g_bucket == index.bucket[near[g_row, 0]]
    # as askers: all member parts, the own asker part
    g = np.repeat(np.arange(len(first)), n_m)
    m = np.arange(len(g)) - np.repeat(np.cumsum(n_m) - n_m, n_m)
    a = own_a[g]
    asks = np.ones(len(g), dtype=bool)
    # as members: the own member part, the other asker parts
    more = np.repeat(np.flatnonzero(belongs), n_a[belongs])
    if len(more):
        more_a = np.arange(len(more)) - np.repeat(np.cumsum(n_a[belongs]) - n_a[belongs], n_a[belongs])
        other = more_a != own_a[more]
        g, m, a = np.r_[g, more[other]], np.r_[m, own_m[more[other]]], np.r_[a, more_a[other]]
        asks = np.r_[asks, np.zeros(int(other.sum()), dtype=bool)]
    member = belongs[g] & (m == own_m[g])
    size = np.where(asks, length[g], 0)
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    inside = np.repeat(first[g], size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    take = pa.array(g_row[g])
    code = _binary(codes).take(pa.array(np.where(member, g_row[g], 0), mask=~member))
    arrays = [
        pa.array(g_bucket[g].astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(a.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
        pa.array(np.where(member, near[g_row[g], 0], -1).astype(np.int32)), code, pa.ListArray.from_arrays(pa.array(ends), pa.array(looks[inside])),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "part", "asks", "cid", "id", "vec", "list", "codes", "looks"])


def search_bucket(rows: pa.Table, index: Index, k: int, shortlist: int, least: float) -> pa.Table:
    """(q, n, name, cos) of the askers in ``rows`` (PLACED): up to k members each, of equal cosines the smaller names."""
    rows = rows.combine_chunks()
    vecs, cids, own = _matrix(rows["vec"]), rows["cid"].to_numpy(), rows["list"].to_numpy()
    lists = rows["looks"].combine_chunks()
    asker = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    looks = lists.flatten().to_numpy()
    order = np.argsort(looks, kind="stable")
    looks, asker = looks[order], asker[order]
    held = np.flatnonzero(own >= 0)
    held = held[np.argsort(own[held], kind="stable")]
    code_of = _matrix(rows["codes"].combine_chunks().drop_null(), np.uint8)
    code_at = np.full(len(rows), -1)
    code_at[own >= 0] = np.arange(len(code_of))
    best = np.full((len(rows), shortlist), -np.inf, dtype=np.float32)  # approximate cosines of the shortlist so far
    who = np.zeros((len(rows), shortlist), dtype=np.int32)
    present, begins = np.unique(own[held], return_index=True)
    for lst, members in zip(present, np.split(held, begins[1:]), strict=False):
        codes = code_of[code_at[members]]
        askers = asker[np.searchsorted(looks, lst) : np.searchsorted(looks, lst, side="right")]
        step = max(1, min(1024, (1 << 22) // len(members)))
        for at in range(0, len(askers), step):
            q = askers[at : at + step]
            x = vecs[q]
            about = np.repeat((index.centers[lst] @ x.T)[None, :], len(members), axis=0)
            for m, book in enumerate(index.books):
                about += (book @ x[:, index.cuts[m] : index.cuts[m + 1]].T)[codes[:, m]]
            about = about.T
            good = np.flatnonzero(about.max(1) > best[q].min(1))  # the others can't improve their shortlist
            if not len(good):
                continue
            q, about = q[good], np.ascontiguousarray(about[good])
            about[q[:, None] == members[None, :]] = -np.inf
            take = min(shortlist, len(members))
            some = np.argpartition(-about, take - 1, axis=1)[:, :take] if take < len(members) else np.tile(np.arange(take), (len(q), 1))
            near = np.hstack([best[q], np.take_along_axis(about, some, 1)])
            names = np.hstack([who[q], members[some].astype(np.int32)])
            keep = np.argpartition(-near, shortlist - 1, axis=1)[:, :shortlist]
            best[q], who[q] = np.take_along_axis(near, keep, 1), np.take_along_axis(names, keep, 1)
    asks = np.unique(asker) if len(held) else asker[:0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(asks), 2048):
        q = asks[at : at + 2048]
        cos = np.matmul(vecs[who[q]], vecs[q][:, :, None])[:, :, 0]
        r, c = np.nonzero(np.isfinite(best[q]) & (cos >= least))
        found.append((q[r], who[q[r], c], cos[r, c]))
    q, n, cos = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    ids = rows["id"].combine_chunks()
    name = pd.factorize(np.asarray(ids.to_pylist(), dtype=object), sort=True)[0] if len(rows) else np.zeros(0, dtype=int)
    order = np.lexsort((cids[n], name[n], -cos, q))
    q, n, cos = q[order], n[order], cos[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, n, cos = (x[keep] for x in (q, n, cos))
    return pa.table({"q": pa.array(cids[q]), "n": pa.array(cids[n]), "name": ids.take(pa.array(n)), "cos": pa.array(cos.astype(np.float64))})


def exact_neighbours(classes: DataFrame, queries: np.ndarray, own: list[int], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, vector) of the k most similar of all ``classes`` (cid, vec) for each query, whose own class is ``own``, of cosine ``least`` or more.

    A partition keeps k candidates a query, whatever its rows.
    """
    shared = classes.sparkSession.sparkContext.broadcast((queries, np.array(own)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, mine = shared.value
        cos = np.full((len(asked), 0), -np.inf, dtype=np.float32)
        held = np.zeros((len(asked), 0, asked.shape[1]), dtype=np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            about = asked @ x.T
            about[mine[:, None] == batch.column(0).to_numpy(zero_copy_only=False)[None, :]] = -np.inf
            take = min(k, len(x))
            some = np.argpartition(-about, take - 1, axis=1)[:, :take]
            cos, held = np.hstack([cos, np.take_along_axis(about, some, 1)]), np.concatenate([held, x[some]], axis=1)
            keep = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            cos, held = np.take_along_axis(cos, keep, 1), np.take_along_axis(held, keep[:, :, None], 1)
        q, at = np.nonzero(cos >= least)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(cos[q, at].astype(np.float64)), _binary(held[q, at])], ["q", "cos", "vec"])

    met = classes.select("cid", "vec").mapInArrow(best, "q int, cos double, vec binary")
    top = met.withColumn("_at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos")))).where(F.col("_at") <= k)
    rows = top.select("q", "vec").collect()  # HELD_OUT x k at most
    vecs = np.frombuffer(b"".join(bytes(r["vec"]) for r in rows), dtype=np.float32).reshape(len(rows), queries.shape[1])
    return np.array([r["q"] for r in rows], dtype=np.int64), vecs


def nearest_vectors(
    vectors: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, recall: float = 0.98, subspaces: int = 8, shortlist: int = 128,
    fit_rows: int = 20_000, bucket_rows: int = 4096, seed: int = 3, scratch: Scratch | None = None,
) -> DataFrame:
    """(query, neighbor, cosine, place): up to ``k`` most similar other vectors for each, of cosine ``least`` or more.

    ``recall``: the share of the true neighbours (the k nearest, of cosine ``least`` or more) that must lie in the lists looked into, as
    measured with HELD_OUT queries against all vectors; quantisation loses some tenths of a percent more. ``fit_rows`` bounds the sample that
    centroids and codebooks are fitted on.

    Left out are null keys, null vectors, all-zero ones, ones with null, NaN or infinite elements, and ones whose length isn't the
    most frequent (of equally frequent the smallest). Ties go to smaller keys. Repeated keys are rows of their
    own. Empty tables give empty results.
    """
    if not 0 < recall <= 1 or k < 1:
        raise ValueError("recall must be above 0 and at most 1, k at least 1")
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    given = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    lengths = given.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    dims = lengths[0]["n"] if lengths else 0

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _binary((x[good] / norm[good][:, None]).astype(np.float32))], ["id", "vec"])

    usable = given.where((F.size("v") == dims) & ~F.exists("v", lambda e: e.isNull()) & (F.size("v") > 0))
    rows = scratch.save(usable.mapInArrow(unit, "id string, vec binary"))
    classes = rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes, total = scratch.save_counted(classes.withColumn("cid", F.monotonically_increasing_id()))
    if total == 0:
        return spark.createDataFrame([], "query string, neighbor string, cosine double, place int")
    chosen = classes.orderBy(F.xxhash64("vec", F.lit(seed)), "cid").limit(fit_rows).select("cid", "vec").collect()
    sample = np.frombuffer(b"".join(bytes(r["vec"]) for r in chosen), dtype=np.float32).reshape(len(chosen), dims)
    centers = coarse_centers(sample, max(1, int(2 * np.sqrt(total))), np.random.default_rng(seed))
    held = sample[:HELD_OUT]
    probes = probes_for(recall, held, *exact_neighbours(classes, held, [r["cid"] for r in chosen[:HELD_OUT]], k, least), centers)
    shared = spark.sparkContext.broadcast(fit_index(sample, centers, total, probes, subspaces, bucket_rows, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                yield place_vectors(batch.slice(at, 2048), shared.value)

    spread = classes.select("cid", "id", "vec").mapInArrow(place, PLACED)
    per_bucket = spread.groupBy("bucket", "part", "asks").applyInArrow(lambda g: search_bucket(g, shared.value, k, shortlist, least), "q long, n long, name string, cos double")
    best = Window.partitionBy("q").orderBy(F.desc("cos"), "name", "n")
    hits = scratch.save(per_bucket.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at", "name"))
    return _expanded(hits, classes, rows, k, least)


def _expanded(hits: DataFrame, classes: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours of single vectors from those of classes of equal vectors.

    A class is known by its k + 1 smallest keys; its candidates are those and its neighbours' in the order
    (cosine, key), of which k + 1 are enough for every member.
    """
    many = classes.where("copies > 1").select("vec", "cid")
    members = rows.join(many, "vec").select("cid", "id")  # only of classes with more than one vector
    firsts = members.withColumn("at", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("at") <= k + 1).select("cid", "id")
    singles = classes.where("copies = 1").select("cid", "id")
    shown = singles.unionByName(firsts)
    from_hits = hits.join(shown.withColumnRenamed("cid", "n"), "n").select(F.col("q").alias("cid"), "id", "cos")
    from_own = firsts.select("cid", "id", F.lit(1.0).alias("cos")) if least <= 1 else firsts.limit(0).withColumn("cos", F.lit(1.0))
    order = Window.partitionBy("cid").orderBy(F.desc("cos"), "id")
    listed = from_hits.unionByName(from_own).withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    askers = singles.unionByName(members).withColumnRenamed("id", "query")
    pairs = askers.join(listed, "cid").where(F.col("query") != F.col("id"))
    final = Window.partitionBy("query", "cid").orderBy("at")
    placed = pairs.withColumn("place", F.row_number().over(final)).where(F.col("place") <= k)
    return placed.select("query", F.col("id").alias("neighbor"), F.col("cos").alias("cosine"), "place")
