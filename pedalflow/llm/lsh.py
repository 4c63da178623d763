"""Approximate nearest neighbours with multiprobe p-stable hashing and exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors
from .shared import lean, materialise, partitions_for, read
from .words import mix

#: Hash tables, width of a projection's cells (of vectors scaled to length 1), buckets that a query visits at most in
#: each table, and rows of an index part.
TABLES, WIDTH, PROBES, PART_ROWS = 14, 1.8, 220, 50_000
SEED = 20
#: Quotient of the longest and shortest norm of a range.
RANGE = 1.25
#: Classes that share a bucket of a table, about, by which the guess of projections a table goes; the pilot begins a step
#: above it and goes down in steps.
SHARE_A_BUCKET, STEP = 32, 2
#: Classes and, of these, queries of a length's pilot, the part of its neighbours that has to be found, and lengths,
#: the most frequent ones, that have a pilot.
PILOT_ROWS, PILOT_ASKED, PILOT_RECALL, PILOTS = 4096, 128, 0.97, 4
#: What a visit to a bucket costs, counted in candidates that are scored: it travels as a row, they lie side by side.
#: In a table of fewer classes than so many times SMALL it counts for less, as a scan would always be cheapest there.
VISIT, SMALL = 32, 1500
#: Queries that an index part answers at once.
ASK = 1024

#: For each length of vectors: projections a table, probes a table, and the ranges of norms, each with its longest.
Plans = dict[int, tuple[int, int, list[tuple[int, float]]]]


@lru_cache(maxsize=8)
def template(m: int, probes: int = PROBES) -> tuple[tuple[int, ...], ...]:
    """Sets of ranks among a query's 2m cell-wall distances, likeliest first.

    The expected square of the j-th smallest of these distances is known in closed form when the query lies uniformly
    in its cell, so the order of the sets by expected sum is the same for all queries. Ranks j and 2m - 1 - j are the
    two walls of one projection and never go together.
    """

    def expected(j: int) -> float:
        if j <= m:
            return j * (j + 1) / (4 * (m + 1) * (m + 2))
        r = 2 * m + 1 - j
        return 1 - r / (m + 1) + r * (r + 1) / (4 * (m + 1) * (m + 2))

    cost = [expected(j) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, have = heapq.heappop(heap)
        if len({min(j, 2 * m - 1 - j) for j in have}) == len(have):
            out.append(have)
        last = have[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*have[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*have, last + 1)))
    return tuple(out)


@lru_cache(maxsize=8)
def projections(d: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions (one more component than the vectors) and offsets of all tables of m projections."""
    rng = np.random.default_rng([SEED, d, m])
    return rng.standard_normal((d + 1, TABLES * m)), rng.random(TABLES * m) * WIDTH


def cells(x: np.ndarray, extra: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers and places inside the cells (0 to 1), vector by table by projection."""
    turn, shift = projections(x.shape[1], m)
    at = (np.column_stack((x, extra)) @ turn + shift) / WIDTH
    whole = np.floor(at)
    shape = (len(x), TABLES, m)
    return whole.astype(np.int64).reshape(shape), (at - whole).reshape(shape)


def bucket_ids(whole: np.ndarray, d: int) -> np.ndarray:
    """One number for each (table, cells)."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(TABLES, dtype=np.uint64) + np.uint64(d * 1000 + 1))
        h = np.broadcast_to(h.reshape((1, TABLES) + (1,) * (whole.ndim - 3)), whole.shape[:-1]).copy()
        for j in range(whole.shape[-1]):
            h = mix(h + whole[..., j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return h.view(np.int64)


def probe_ids(x: np.ndarray, m: int, probes: int = PROBES) -> np.ndarray:
    """The buckets that unit queries visit: query by table by probe, likeliest first."""
    whole, inside = cells(x, np.zeros(len(x)), m)
    n = len(x)
    walls = np.concatenate((inside, 1 - inside), axis=2)  # below, above
    order = np.argsort(walls, axis=2, kind="stable")
    sets = template(m)[:probes]
    out = np.empty((n, TABLES, len(sets)), np.int64)
    for p, ranks in enumerate(sets):
        moved = whole.copy()
        for j in ranks:
            wall = order[:, :, j]
            step = np.where(wall < m, -1, 1)
            np.put_along_axis(moved, (wall % m)[:, :, None], np.take_along_axis(moved, (wall % m)[:, :, None], 2) + step[:, :, None], 2)
        out[:, :, p] = bucket_ids(moved, x.shape[1])
    return out


def _rows_by_length(batch: pa.RecordBatch):
    sizes = batch.column("d").to_numpy()
    for d in np.unique(sizes).tolist():
        yield batch.filter(pa.array(sizes == d))


def ranged(buckets: np.ndarray, span: int) -> np.ndarray:
    """The numbers of buckets inside a range of norms."""
    with np.errstate(over="ignore"):
        return mix(buckets.view(np.uint64) + np.array([span], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _index(batches: Iterator[pa.RecordBatch], plans: Plans) -> Iterator[pa.RecordBatch]:
    """Each class once a table. Vectors are scaled by the longest of their range and get a component that makes them
    unit long, so that nearness in space orders those of a range as their inner products with a query do."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            for of_length in _rows_by_length(batch.slice(i, 2000)):
                d, place = of_length.column("d")[0].as_py(), of_length.column("span").to_numpy()
                m, _, spans = plans[d]
                for span, longest in spans:
                    own = of_length.filter(pa.array(place == span))
                    if not own.num_rows:
                        continue
                    x = vectors.matrix(own.column("vec"), np.float64) / longest
                    whole, _ = cells(x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1))), m)
                    found = ranged(bucket_ids(whole, d), span)
                    for t in range(TABLES):
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, t]), own.column("cid"), own.column("vec"), own.column("ids")], names=["bucket", "cid", "vec", "ids"])


def _probes(batches: Iterator[pa.RecordBatch], plans: Plans) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            for own in _rows_by_length(batch.slice(i, 500)):
                x = vectors.matrix(own.column("vec"), np.float64)
                x /= np.sqrt((x**2).sum(axis=1))[:, None]
                m, probes, spans = plans[x.shape[1]]
                visits = probe_ids(x, m, probes).reshape(len(x), -1)
                found = [np.concatenate([ranged(row, span) for span, _ in spans]) for row in map(np.unique, visits)]
                offs = np.concatenate(([0], np.cumsum([len(row) for row in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("cid"), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(found)))], names=["cid", "buckets"])


def found_at(x: np.ndarray, longest: np.ndarray, asked: np.ndarray, m: int) -> np.ndarray:
    """For each unit query and each vector, which has the longest of its range beside it, the number of probes a table
    after which the query has met it; one more than PROBES if it never does."""
    scaled = x / longest[:, None]
    whole, _ = cells(scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1))), m)
    held, visits = bucket_ids(whole, x.shape[1]), probe_ids(asked, m)
    first = np.full((len(asked), len(x)), PROBES + 1)
    for t in range(TABLES):
        order = np.argsort(held[:, t], kind="stable")
        ids = held[order, t]
        low, high = (np.searchsorted(ids, visits[:, t], side) for side in ("left", "right"))
        for q, p in zip(*np.nonzero(high > low), strict=True):
            met = order[low[q, p] : high[q, p]]
            first[q, met] = np.minimum(first[q, met], p + 1)
    return first


def guess(total: int) -> int:
    """Projections a table for so many classes."""
    return max(1, round(math.log2(max(2, total / SHARE_A_BUCKET))))


def fit(pilot: list[tuple[np.ndarray, float]], total: int, k: int) -> tuple[int, int]:
    """Projections and probes a table with which a pilot's queries find PILOT_RECALL of their neighbours at the least
    cost: the part of all classes that they meet, and the buckets they ask for. Where nothing reaches that, what finds
    most. At least the bucket itself and those behind each of its walls are visited.

    ``pilot`` holds vectors with the longest norm of their range. A share of all vectors has that share of the
    neighbours of a query, the nearest ones: in a larger table these are nearer, and fewer probes find them.
    """
    middle = guess(total)
    if len(pilot) < 2:
        return middle, PROBES
    x, longest = np.array([v for v, _ in pilot], np.float64), np.array([n for _, n in pilot])
    n = min(PILOT_ASKED, len(x))
    asked = x[:n] / np.sqrt((x[:n] ** 2).sum(axis=1))[:, None]
    scores = asked @ x.T
    scores[np.arange(n), np.arange(n)] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(len(x) - 1, -(-k * len(x) // total)))]
    visit = min(VISIT, max(1.0, total / SMALL))
    tried: dict[int, tuple[float, float, int, int]] = {}

    def attempt(m: int) -> float:
        first = found_at(x, longest, asked, m)
        met = np.sort(np.take_along_axis(first, near, 1).ravel())
        probes = int(min(PROBES, max(2 * m + 1, met[math.ceil(PILOT_RECALL * len(met)) - 1])))
        recall = float((met <= probes).mean())
        tried[m] = (-min(recall, PILOT_RECALL), total * float((first <= probes).mean()) + visit * TABLES * probes, m, probes)
        return recall

    reached = 0
    for m in range(middle + STEP, 0, -STEP):
        reached += attempt(m) >= PILOT_RECALL
        if reached >= 2 and min(tried.values())[2] != m:
            break  # fewer projections meet more
    best = min(tried.values())[2]
    for m in {best - STEP // 2, best + STEP // 2} - {0, *tried}:
        attempt(m)
    return min(tried.values())[2:]


def names_of(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector's bits, which tells classes apart."""
    with np.errstate(over="ignore"):
        place = np.arange(x.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return np.concatenate([mix(np.ascontiguousarray(x[i : i + 4096]).view(np.uint64) + place).sum(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.uint64)])


class Pool:
    """The best candidates of a part's queries; pairs come in heaps and all but the best k + 1 of each query go.

    Heaps are ranked by matrix products, whose last digits depend on the shapes. Pairs within their rounding error of
    the cut are scored again one by one, always in the same way, and ordered by that score and their smallest id.
    """

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k + 1
        self.wide = 4 * asked.shape[1] * np.finfo(float).eps * np.sqrt((asked**2).sum(axis=1))
        self.longest = 0.0
        self.least = np.full(len(asked), -np.inf)
        self.q = np.zeros(0, np.int64)
        self.s = np.zeros(0)
        self.v = np.zeros((0, asked.shape[1]))
        self.names = np.zeros(0, np.uint64)
        self.ids: list[tuple[int, ...]] = []
        self.pending: list = []
        self.held = 0

    def offer(self, which: np.ndarray, block: np.ndarray, places: np.ndarray, flat: np.ndarray, offs: np.ndarray, names: np.ndarray | None = None, longest: float | None = None) -> None:
        """Queries by number against places, which follow each other, of a candidate block; ``names`` and ``longest``
        are its classes' hashes and its longest norm, if they are known."""
        own = block[places[0] : places[-1] + 1]
        scores = self.asked[which] @ own.T
        self.longest = max(self.longest, float(np.sqrt((own**2).sum(axis=1).max(initial=0))) if longest is None else longest)
        a, b = np.nonzero(scores >= (self.least[which] - self.wide[which] * self.longest)[:, None])
        if len(a):
            known = names_of(own)[b] if names is None else names[places[b]]
            self.pending.append((which[a], scores[a, b], block, places[b], flat, offs, known))
            self.held += len(a)
            if self.held > 1 << 18:
                self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        q, s, names = (np.concatenate([first, *[p[i] for p in self.pending]]) for first, i in ((self.q, 0), (self.s, 1), (self.names, 6)))
        # Where each pair's candidate lies: old ones first, then heap by heap.
        source = np.concatenate([np.full(len(self.q), -1), *[np.full(len(p[0]), i) for i, p in enumerate(self.pending)]])
        place = np.concatenate([np.arange(len(self.q)), *[p[3] for p in self.pending]])
        # One candidate may come from several tables.
        order = np.lexsort((names, q))
        new = np.concatenate(([True], (np.diff(q[order]) != 0) | (names[order][1:] != names[order][:-1])))
        order = order[new]
        order = order[np.lexsort((-s[order], q[order]))]
        q, s, source, place, names = q[order], s[order], source[order], place[order], names[order]
        # Classes of equal ids and scores count once, below; an id of two vectors is that rare that some room is enough.
        reach = self.k + 4
        last = np.minimum(np.searchsorted(q, q) + reach, np.searchsorted(q, q, side="right")) - 1
        near = np.flatnonzero(s >= s[last] - 2 * self.wide[q] * self.longest)
        q, source, place, names = q[near], source[near], place[near], names[near]
        s, smallest = np.empty(len(q)), np.empty(len(q), np.int64)
        by_source = np.argsort(source, kind="stable")
        edges = np.flatnonzero(np.diff(source[by_source], prepend=-2, append=len(self.pending) + 1))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for a in range(i, j, 1 << 15):
                rows = by_source[a : min(j, a + (1 << 15))]
                at, of = place[rows], int(source[by_source[i]])
                s[rows] = np.sum(self.asked[q[rows]] * (self.v[at] if of < 0 else self.pending[of][2][at]), axis=1)
                smallest[rows] = [self.ids[c][0] for c in at.tolist()] if of < 0 else self.pending[of][4][self.pending[of][5][at]]
        order = np.lexsort((names, smallest, -s, q))
        q, s, source, place, smallest, names = q[order], s[order], source[order], place[order], smallest[order], names[order]

        def ids_of(r: int) -> tuple[int, ...]:
            if source[r] < 0:
                return self.ids[place[r]]
            flat, offs = self.pending[source[r]][4:6]
            return tuple(flat[offs[place[r]] : offs[place[r] + 1]].tolist())

        whole = np.ones(len(q), bool)
        for r in (np.flatnonzero((np.diff(q) == 0) & (np.diff(s) == 0) & (np.diff(smallest) == 0)) + 1).tolist():
            before = r - 1
            while before >= 0 and whole[r] and (q[before], s[before], smallest[before]) == (q[r], s[r], smallest[r]):
                whole[r] = ids_of(before) != ids_of(r)
                before -= 1
        q, s, source, place, names = q[whole], s[whole], source[whole], place[whole], names[whole]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.least[q[rank == self.k - 1]] = s[rank == self.k - 1]
        keep = np.flatnonzero(rank < self.k)
        ids = [ids_of(r) for r in keep.tolist()]
        vecs = [self.v[place[r]] if source[r] < 0 else self.pending[source[r]][2][place[r]] for r in keep.tolist()]
        self.q, self.s, self.ids, self.names = q[keep], s[keep], ids, names[keep]
        self.v = np.array(vecs).reshape(len(keep), self.asked.shape[1])
        self.pending, self.held = [], 0

    def listed(self) -> dict[int, list[tuple[float, int]]]:
        """For each query with candidates, (score, id), best first."""
        self.settle()
        out: dict[int, list[tuple[float, int]]] = {}
        for q, s, ids in zip(self.q.tolist(), self.s, self.ids, strict=True):
            out.setdefault(q, []).extend((-float(s), v) for v in ids)
        return {q: [(-s, v) for s, v in sorted(set(rows))[: self.k]] for q, rows in out.items()}


class Part:
    """An index part's candidates of one length, which come by bucket: heaps of at most PART_ROWS rows, about."""

    def __init__(self):
        self.heaps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]] = []
        self.of: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        buckets = rows.column("bucket").to_numpy()
        flat, offs = vectors.ragged(rows.column("list"))
        starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True):
            self.of.setdefault(int(buckets[i]), []).append((len(self.heaps), i, j))
        x = vectors.matrix(rows.column("vec"), np.float64)
        self.heaps.append((x, flat, offs, names_of(x), float(np.sqrt((x**2).sum(axis=1).max(initial=0)))))

    def answer(self, rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The best candidates of some queries among the buckets that each asks for."""
        pool = Pool(vectors.matrix(rows.column("vec"), np.float64), k)
        flat, offs = vectors.ragged(rows.column("list"))
        probe, whose = flat[offs[0] : offs[-1]], np.repeat(np.arange(rows.num_rows), np.diff(offs))
        order = np.argsort(probe, kind="stable")
        probe, whose = probe[order], whose[order]
        begin = np.flatnonzero(np.concatenate(([True], probe[1:] != probe[:-1])))
        for bucket, which in zip(probe[begin].tolist(), np.split(whose, begin[1:]), strict=True):
            for heap, i, j in self.of.get(bucket, ()):
                x, ids, bounds, names, longest = self.heaps[heap]
                for s in range(i, j, 512):
                    pool.offer(which, x, np.arange(s, min(j, s + 512)), ids, bounds, names, longest)
        found = list(pool.listed().items())
        cids = rows.column("cid").to_pylist()
        return pa.RecordBatch.from_pydict(
            {
                "cid": pa.array([cids[q] for q, _ in found], pa.string()),
                "scores": pa.array([[s for s, _ in x] for _, x in found], pa.list_(pa.float64())),
                "ids": pa.array([[v for _, v in x] for _, x in found], pa.list_(pa.int64())),
            }
        )


def _rerank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by index part: its candidates by bucket, which are held, then its queries, which pass by."""
    now, part = None, Part()
    for batch in batches:
        keys, sizes, kinds = (batch.column(c).to_numpy() for c in ("part", "d", "kind"))
        change = np.flatnonzero(np.diff(keys) | np.diff(sizes) | np.diff(kinds)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if (keys[a], sizes[a]) != now:
                now, part = (keys[a], sizes[a]), Part()
            if kinds[a] == 0:
                part.add(batch.slice(a, b - a))
            elif part.heaps:
                for i in range(a, b, ASK):
                    yield part.answer(batch.slice(i, min(ASK, b - i)), k)


def nearest(rows: DataFrame, k: int = vectors.K, every: int = vectors.EVERY) -> DataFrame:
    """Each query's k nearest rows found, by largest inner product in double precision: query_id, rank, vec_id, score.

    Queries are the rows whose id ``every`` divides; candidates all rows but those with the query's own id; all rows
    are in the index, none is sampled. Vectors are dealt into ranges of like norm, each scaled by its own longest, so
    that a few long ones do not make the others alike. Every class of equal vectors lies in one bucket of each table; a
    query visits some buckets of each in every range, likeliest first. How many projections make a bucket and how many
    buckets are visited, up to PROBES, follows from the number of classes and a pilot on PILOT_ROWS of them, for each
    of the PILOTS most frequent lengths of vectors; other lengths get all PROBES. All it meets are scored on the
    original vectors; a query that meets fewer than k others is scored against all of its length. Buckets go to index
    parts of about PART_ROWS rows, of which a task holds one while queries pass by; a bucket with more is dealt over
    several, and a query goes to a part once with the list of its buckets there.

    Null ids or vectors, empty vectors, zero vectors and vectors with null or non-finite components take no part;
    equal rows count once; vectors of another length are no candidates. Ties go to the smaller id. Fewer candidates
    than k give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    some = vectors.valid(rows).where(F.exists("embedding", lambda x: x != 0))
    held, found = vectors.classes(some, F.col("embedding"), "lsh-rows", k, every)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    span = F.floor(F.log("norm") / F.lit(math.log(RANGE)) + F.lit(0.5)).cast("int")  # a norm of 1 lies inside a range
    ready = materialise(found.withColumn("norm", norm).withColumn("d", F.size("vec")).withColumn("span", span), "lsh-classes")
    # A row for each length of vectors and range of norms.
    sizes = ready.groupBy("d", "span").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    total: dict[int, int] = {}
    ranges: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(sizes, key=lambda r: (r["d"], r["span"])):
        total[r["d"]] = total.get(r["d"], 0) + r["n"]
        ranges.setdefault(r["d"], []).append((r["span"], float(r["longest"])))
    plans: Plans = {d: (guess(n), PROBES, ranges[d]) for d, n in total.items()}
    for d in sorted(total, key=lambda d: (-total[d], d))[:PILOTS]:
        # A bounded sample, by hash.
        longest = dict(ranges[d])
        pilot = ready.where(F.col("d") == d).select("cid", "vec", "span").orderBy(F.xxhash64("cid"), "cid").limit(PILOT_ROWS).collect()
        plans[d] = (*fit([(np.asarray(r["vec"], np.float64), longest[r["span"]]) for r in pilot], total[d], k), ranges[d])
    parts = max(partitions_for(spark), -(-sum(total.values()) * TABLES // PART_ROWS))

    kind = ready.schema["vec"].dataType.simpleString()  # vectors travel as they came; sums are made in double
    index = materialise(ready.select("d", "span", "cid", "vec", "ids").mapInArrow(lean(_index, plans), f"bucket long, cid string, vec {kind}, ids array<long>"), "lsh-index")
    # A table of its own, so that its size, mostly nothing, is known before it is joined.
    large = index.groupBy("bucket").count().where(F.col("count") > PART_ROWS)
    shares = materialise(large.select("bucket", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("shares")), "lsh-shares")

    def part_of(share):
        return F.pmod(F.xxhash64("bucket", share), F.lit(parts)).cast("int").alias("part")

    candidates = index.join(shares, "bucket", "left").withColumn("_share", F.pmod(F.xxhash64("cid"), F.coalesce("shares", F.lit(1))).cast("int"))
    candidates = candidates.select(part_of(F.col("_share")), F.size("vec").alias("d"), F.lit(0).alias("kind"), "bucket", F.lit(None).cast("string").alias("cid"), "vec", F.col("ids").alias("list"))
    asked = ready.where("asked").select("d", "cid", "vec")
    visits = asked.mapInArrow(lean(_probes, plans), "cid string, buckets array<long>").select("cid", F.explode("buckets").alias("bucket"))
    dealt = visits.join(shares, "bucket", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    lists = dealt.select("cid", "bucket", part_of(F.col("_share"))).groupBy("cid", "part").agg(F.collect_list("bucket").alias("list"))
    queries = lists.join(asked, "cid").select("part", "d", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "cid", "vec", "list")
    both = queries.unionByName(candidates).repartition(min(parts, 8 * partitions_for(spark)), "part").sortWithinPartitions("part", "d", "kind", "bucket")
    schema = "cid string, scores array<double>, ids array<long>"
    result = materialise(both.mapInArrow(lean(_rerank, k), schema), "lsh-found")

    # A query that met fewer than k others is scored against all vectors of its length.
    met = result.groupBy("cid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("met"))
    short = materialise(asked.join(met, "cid", "left").where(F.coalesce("met", F.lit(0)) <= k).select("d", "cid", "vec"), "lsh-short")
    if not short.isEmpty():
        shares_of = F.create_map(*[F.lit(x) for d, n in total.items() for x in (d, -(-n // PART_ROWS))])
        every_part = F.explode(F.sequence(F.lit(0), shares_of[F.col("d")] - 1)).alias("part")
        left = short.select(every_part, "d", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "cid", "vec", F.array(F.lit(0).cast("long")).alias("list"))
        own_part = F.pmod(F.xxhash64("cid"), shares_of[F.col("d")]).cast("int").alias("part")
        right = ready.select(own_part, "d", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("string").alias("cid"), "vec", F.col("ids").alias("list"))
        scan = left.unionByName(right).repartition(partitions_for(spark), "part", "d").sortWithinPartitions("part", "d", "kind", "bucket")
        result = result.unionByName(scan.mapInArrow(lean(_rerank, k), schema))
    return vectors.answers(held, result, "double", k, every)


def op7_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
