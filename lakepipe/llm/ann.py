"""Approximate nearest neighbours by additive quantisation.

A vector's direction is written as a sum of one full-dimensional codeword from each of a few codebooks. Codebooks are fitted
on a bounded sample, each on what the ones before leave over, then all together by least squares on the sample's codes. Every
row is encoded by a beam search over the books; its code, its length and the length of its decoded direction are stored. A
query's inner products with all codewords make lookup tables, whose sums, scaled by the two stored lengths, estimate the
inner product with any coded row. Each query's best by the estimate are then measured exactly, in double precision on the
original vectors.

Queries go in blocks of bounded size over the whole index, which is not shuffled: each task scans its rows, ROW_BLOCK at a
time, keeps one shortlist for each query, measures it, and only each query's best are merged. Rows with the same vector are
estimated and measured once, so a vector that very many rows share crowds nothing out. Ties go to the smaller id.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those without an id
or of another length than most. Every other row is a candidate; rows of one id with different vectors are rows of their own
(as queries too), those that agree in both are one. A query's own row is that of its id and vector. No rows: no rows. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakepipe.llm.common import dropped, new_folder, written

#: Queries that go over the index together; with the dimension this bounds what is sent to each task.
QUERY_BLOCK = 4096
#: Rows that a task holds, and has a shortlist of, at a time.
ROW_BLOCK = 65_536


@dataclass(frozen=True)
class Quantiser:
    """``books``: (books, codewords, dimension)."""

    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, n_books: int = 20, n_words: int = 256, rounds: int = 6, sweeps: int = 10, seed: int = 5) -> Quantiser:
        """``x``: directions of length one."""
        rng = np.random.default_rng(seed)
        n_words = max(1, min(n_words, len(x)))
        left, books = x.astype(np.float32), []
        for _ in range(n_books):
            words = left[rng.choice(len(left), n_words, replace=False)].copy()
            for _ in range(rounds):
                near = (left @ words.T - (words**2).sum(1) / 2).argmax(1)
                sums = np.zeros_like(words)
                np.add.at(sums, near, left)
                count = np.bincount(near, minlength=n_words)
                words[count > 0] = sums[count > 0] / count[count > 0, None]
            near = (left @ words.T - (words**2).sum(1) / 2).argmax(1)
            left = left - words[near]
            books.append(words)
        made = cls(np.stack(books))
        # least squares on the codes that the beam search gives, book by book in turn, held to the words so far by a small weight
        codes, prior = made.encode(x).astype(np.intp), made.books
        better, left = prior.copy(), x.astype(np.float32) - made.decode(codes)
        for _ in range(sweeps):
            for b in range(n_books):
                at = codes[:, b]
                left += better[b][at]
                order = np.argsort(at, kind="stable")
                used, starts, count = np.unique(at[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(left[order], starts, axis=0)
                better[b][used] = (sums + 0.1 * prior[b][used]) / (count[:, None] + 0.1)
                left -= better[b][at]
        return cls(better)

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """(rows, books) of codeword numbers: of ``beam`` partial sums for each row, the nearest in the end."""
        n, dim = x.shape
        n_books, n_words, _ = self.books.shape
        out = np.zeros((n, n_books), dtype=np.uint16)
        for a in range(0, n, 2048):
            part = x[a : a + 2048].astype(np.float32)
            m = len(part)
            left = part[:, None, :]  # rows, beams, dimension
            codes = np.zeros((m, 1, n_books), dtype=np.uint16)
            for b in range(n_books):
                words = self.books[b]
                width = left.shape[1]
                # distance after adding a word, without the part that all share
                far = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, dim) @ words.T).reshape(m, width, n_words) + (words**2).sum(1)
                flat = far.reshape(m, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, word = best // n_words, best % n_words
                rows = np.arange(m)[:, None]
                left = left[rows, parent] - words[word]
                codes = codes[rows, parent]
                codes[:, :, b] = word
            last = (left**2).sum(2).argmin(1)
            out[a : a + 2048] = codes[np.arange(m), last]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(books, codewords, queries) of inner products."""
        return np.einsum("bwd,qd->bwq", self.books, queries.astype(np.float32), optimize=True).astype(np.float32)


def estimate(tables: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(rows, queries): estimated inner products, by lookups. ``scale``: length over decoded length."""
    total = np.take(tables[0], codes[:, 0], axis=0)
    found = np.empty_like(total)
    for b in range(1, len(tables)):
        np.take(tables[b], codes[:, b], axis=0, out=found, mode="clip")
        total += found
    total *= scale[:, None]
    return total


def exact(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of rows with queries, pair by pair, component by component in order, so that equal vectors get equal
    numbers wherever they stand."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d] * queries[..., d]
    return total


def _best(query: np.ndarray, item: np.ndarray, value: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``keep`` items of the largest value, then the smallest item; by query, in that order."""
    order = np.lexsort((item, -value, query))
    query, item, value = query[order], item[order], value[order]
    starts = np.searchsorted(query, query)  # where each one's query begins
    kept = np.arange(len(query)) - starts < keep
    return query[kept], item[kept], value[kept]


def _best_guesses(query: np.ndarray, item: np.ndarray, value: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _best, for 32-bit values and items that come in order: sorted by one number, of the query and the value's bits."""
    bits = value.view(np.uint32)
    down = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))  # the larger the value, the smaller
    order = np.argsort(query.astype(np.uint64) << np.uint64(32) | down, kind="stable")
    query = query[order]
    count = np.bincount(query) if len(query) else np.zeros(0, np.int64)
    kept = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) < keep
    return query[kept], item[order][kept], value[order][kept]


def _shortlist(tables: np.ndarray, codes: np.ndarray, scale: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``keep`` rows with the best estimates for each query."""
    n = tables.shape[2]
    out_q, out_r = [], []
    for q0 in range(0, n, 256):  # queries and rows in pieces that stay in the processor's cache
        part = np.ascontiguousarray(tables[:, :, q0 : q0 + 256])
        width = part.shape[2]
        least = np.full(width, -np.inf, dtype=np.float32)
        found: tuple[list, list, list] = ([], [], [])
        held = 0
        for r0 in range(0, len(codes), 512):
            guess = estimate(part, codes[r0 : r0 + 512], scale[r0 : r0 + 512])
            rows, queries = np.nonzero(guess > least)
            for x, y in zip(found, (queries, rows + r0, guess[rows, queries]), strict=True):
                x.append(y)
            held += len(rows)
            if held > 3 * width * keep:
                q, r, v = _best_guesses(*[np.concatenate(x) for x in found], keep)
                found, held = ([q], [r], [v]), len(q)
                count = np.bincount(q, minlength=width)
                full = count >= keep
                least[full] = v[np.cumsum(count) - 1][full]
        if held:
            q, r, _ = _best_guesses(*[np.concatenate(x) for x in found], keep)
            out_q.append(q + q0)
            out_r.append(r)
    none = np.zeros(0, np.int64)
    return np.concatenate(out_q or [none]), np.concatenate(out_r or [none])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)


@dataclass
class Index:
    """``rows``: a written table of vec_id, vector, code, length (of the vector) and decoded (length of the coded direction)."""

    rows: DataFrame
    quantiser: Quantiser | None
    dim: int

    def search(self, queries: DataFrame, k: int = 20, rerank: int = 400, own: bool = False) -> DataFrame:
        """``queries``: query_id and vector. Gives query_id, rank, vec_id, score; ``own``: whether a query may find its own row.

        ``rerank``: how many different vectors of each ROW_BLOCK rows of a task are measured exactly for a query.
        """
        spark = queries.sparkSession
        schema = "query int, query_id long, vec_id long, score double"
        best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        n = queries.count() if self.quantiser is not None else 0
        blocks = math.ceil(n / (QUERY_BLOCK * 0.9)) if n > QUERY_BLOCK else 1
        out = new_folder(spark, "neighbours")
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        found = [empty]
        for at in range(blocks if n else 0):
            part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)
            rows = part.select("query_id", "vector").toArrow()
            if not rows.num_rows:
                continue
            ids = rows.column("query_id").to_numpy()
            vectors = _matrix(rows.column("vector").combine_chunks(), self.dim)
            hits = self.rows.mapInArrow(_scan(self.quantiser, ids, vectors, self.dim, k, rerank, own), schema)
            hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            if blocks > 1:
                hits.write.mode("append").parquet(out)
            else:
                found.append(hits)
        if blocks > 1:
            return spark.read.schema(empty.schema).parquet(out)
        return found[-1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ROW_BLOCK rows, but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, ROW_BLOCK - rows)
            held.append(part)
            rows += part.num_rows
            b = b.slice(part.num_rows)
            if rows == ROW_BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scan(quantiser: Quantiser, ids: np.ndarray, vectors: np.ndarray, dim: int, k: int, rerank: int, own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        best_q, best_id, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in _blocks(batches):
            if tables is None:
                tables = quantiser.tables(vectors)
            vec_id = b.column("vec_id").to_numpy()
            rows = _matrix(b.column("vector"), dim)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype="<u2").reshape(len(rows), -1).astype(np.intp)
            # same vectors as one; their ids in order
            order = np.argsort(vec_id, kind="stable")
            _, first, group = np.unique(np.ascontiguousarray(rows[order]).view(f"V{dim * 8}").ravel(), return_index=True, return_inverse=True)
            by_group = np.argsort(group, kind="stable")
            members = vec_id[order][by_group]
            starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
            first = order[first]
            scale = (b.column("length").to_numpy() / np.maximum(b.column("decoded").to_numpy(), 1e-30))[first].astype(np.float32)
            rows, code = rows[first], code[first]
            q, g = _shortlist(tables, code, scale, rerank)
            # in pieces that stay in the processor's cache
            score = np.concatenate([exact(rows[g[i : i + 1024]], vectors[q[i : i + 1024]]) for i in range(0, len(q), 1024)] or [np.zeros(0)])
            # a query wants no more groups than rows, and of a group no more rows; its own may be one of them
            q, g, score = _first_groups(q, g, score, members[starts[:-1]], k + 1)
            size = np.minimum(starts[g + 1] - starts[g], k + 1)
            at = np.repeat(starts[g] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            q, score, found = np.repeat(q, size), np.repeat(score, size), members[at]
            if not own:
                mine = found == ids[q]
                mine[mine] = (rows[np.repeat(g, size)[mine]] == vectors[q[mine]]).all(axis=1)
                q, score, found = q[~mine], score[~mine], found[~mine]
            best_q, best_id, best_score = _best(np.concatenate([best_q, q]), np.concatenate([best_id, found]), np.concatenate([best_score, score]), k)
        for i in range(0, len(best_q), 65_536):
            part = slice(i, i + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(best_q[part].astype(np.int32)), pa.array(ids[best_q[part]]), pa.array(best_id[part]), pa.array(best_score[part])], names=["query", "query_id", "vec_id", "score"])

    return run


def _first_groups(q: np.ndarray, g: np.ndarray, score: np.ndarray, least_id: np.ndarray, keep: int):
    """_best of groups, ties by their smallest ids."""
    order = np.lexsort((least_id[g], -score, q))
    q, g, score = q[order], g[order], score[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < keep
    return q[kept], g[kept], score[kept]


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, those that agree in both once."""
    v = F.col("vector")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull())
    rows = rows.where(F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
    return rows.distinct()


def build(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", sample_rows: int = 8192, beam: int = 4, **how) -> Index:
    """Fits on the ``sample_rows`` rows with the smallest hash of their id (the bound of what comes to the driver), encodes all."""
    rows = written(usable(vectors, vec_id, vector), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "vec_id long, vector array<double>, code binary, length double, decoded double"
    if not lengths:
        return Index(rows.sparkSession.createDataFrame([], schema), None, 0)
    dim = lengths[0]["d"]
    fit_on = rows.where(F.size("vector") == dim)
    sample = fit_on.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    x = _matrix(sample.column("vector").combine_chunks(), dim)
    quantiser = Quantiser.fit(x / _norm(x)[:, None], **how)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("vector"), dim)
            length = _norm(v)
            codes = quantiser.encode(v / length[:, None], beam)
            raw = np.ascontiguousarray(codes.astype("<u2"))
            kept = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * dim + 1, dim), pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), kept, pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(length), pa.array(_norm(quantiser.decode(codes).astype(np.float64)))], names=["vec_id", "vector", "code", "length", "decoded"])

    index = written(fit_on.mapInArrow(encode, schema), "index")
    dropped(rows)
    return Index(index, quantiser, dim)


def _norm(x: np.ndarray) -> np.ndarray:
    """Lengths, also of vectors whose squares are out of range."""
    most = np.abs(x).max(1) if x.size else np.zeros(len(x))
    most = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))
