"""Near-duplicate classes: an exact Jaccard join over word shingles as a blocked sparse matrix product.

1. A document's set is its distinct shingles' 64-bit hashes. Equal sets are one class.
2. Each set's smallest hashes, in number just enough that two linked sets must share a given count of them, go to
   columns (one a hash). Sets with too few columns that another set has can't be linked with anything and go.
3. Overlaps are first counted on the columns alone, for columns of few sets pair by pair. A pair stays a candidate
   while its count, and the large columns that both might share, reach what a link takes; sets with that many large
   columns stay candidates of all sets in these. What candidates connect is a family.
4. Families are cut into blocks of rows by size, and pairs of blocks are multiplied, document by shingle times its transpose:
   the product holds exact overlap counts. Pairs below the bound that both sizes give are discarded.
5. The links that are left are united to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import Union, components, edge_batch
from .shared import drop, lean, materialise, partitions_for, read
from .words import grams, mix, pieces

#: Words a shingle; links need PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 5, 80
#: Every COMMON-th part of a set must be found among the shared columns.
COMMON = 5
#: Sets and shingles of a block, and columns multiplied at once.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 768, 1 << 19, 1024
#: Pairs of a shingle up to which they are added up one by one, and how many of these at once.
FEW_PAIRS, ADDED = 100, 1 << 19
#: Sets of a column up to which its pairs are counted, and pairs a task counts at once.
FEW, PAIRS = 24, 1 << 19
#: Classes a task remembers so as to send their columns once.
SEEN = 200_000


def shingle_sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, without words none."""
    for i, j, words in pieces(batch, column, lower=True):
        found, begins = grams(words, SHINGLE)
        for d in range(j - i):
            a, b = words.offsets[d], words.offsets[d + 1]
            if b == a:
                yield np.zeros(0, np.uint64)
            elif b - a < SHINGLE:
                h = np.uint64(b - a)
                for x in words.hashes[a:b]:
                    h = mix(np.array([h], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
                yield np.array([h], np.uint64)
            else:
                yield np.unique(found[begins[d] : begins[d + 1]])


def least_overlap(n: int) -> int:
    """The fewest shingles that a set of n shares with any set it is linked with."""
    return -(-PERCENT * n // 100)


def columns_of(n: int) -> int:
    """How many of its smallest hashes a set of n sends: those that a linked set may lack, and a share besides."""
    return min(n, n - least_overlap(n) + -(-n // COMMON))


def least_columns(n: int) -> int:
    """How many of these any linked set sends too; its own share may be that of the smallest size that can be linked."""
    return -(-least_overlap(n) // COMMON)


def class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and class, and the class's columns where the task meets it for the first time."""
    seen: set[int] = set()
    for batch in batches:
        sizes, classes, columns, counts = [], [], [], []
        for s in shingle_sets(batch):
            n = len(s)
            c = class_of(s) if n else None
            new = n > 0 and c not in seen
            if new:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
            sent = s[: columns_of(n)] if new else s[:0]
            sizes.append(n), classes.append(c), columns.append(sent), counts.append(len(sent))
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        flat = np.concatenate(columns) if columns else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
            names=["row", "n", "class", "columns"],
        )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (class, n, h) whose column another class has too, with the column's number of rows."""
    found = rows.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows")).where("low < high")
    # A table of its own: a join with it can split a column that very many classes have.
    return rows.select("class", "n", "h").join(materialise(found.select("h", "rows"), "jaccard-columns"), "h")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by column; counts in how many of a task's columns each pair of sets of fitting sizes is."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    carry: pa.RecordBatch | None = None

    def out() -> pa.RecordBatch:
        a, b, na, nb = (np.concatenate(x) for x in zip(*held, strict=True))
        key = mix(a.view(np.uint64)) ^ mix(b.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        return pa.RecordBatch.from_pydict({"a": pa.array(a[first]), "b": pa.array(b[first]), "n_a": pa.array(na[first]), "n_b": pa.array(nb[first]), "got": pa.array(count.astype(np.int64))})

    def count(batch: pa.RecordBatch) -> None:
        nonlocal size
        h, c, n = (batch.column(x).to_numpy() for x in ("h", "class", "n"))
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        h, c, n = h[once], c[once], n[once]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.append(begin, len(h)))
        for g in np.unique(sizes).tolist():
            if g < 2:
                continue
            members = begin[sizes == g][:, None] + np.arange(g)
            i, j = np.triu_indices(g, 1)
            for k in range(0, len(members), max(1, PAIRS // len(i))):
                part = members[k : k + max(1, PAIRS // len(i))]
                x, y = part[:, i].ravel(), part[:, j].ravel()
                fit = 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
                x, y = x[fit], y[fit]
                held.append((c[x], c[y], n[x], n[y]))
                size += len(x)

    for batch in batches:
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        h = batch.column("h").to_numpy()
        whole = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last column may go on in the next batch
        carry = batch.slice(whole)
        if whole:
            count(batch.slice(0, whole))
        if size > PAIRS:
            yield out()
            held, size = [], 0
    if carry is not None and carry.num_rows:
        count(carry)
    if held and size:
        yield out()


def candidates(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that may be linked: every linked pair is connected by them."""
    need = F.ceil(F.ceil(F.col("n") * PERCENT / 100) / COMMON).alias("need")
    many = materialise(rows.where(F.col("rows") > FEW).select("class", "h", need), "jaccard-many")
    large = many.groupBy("class", "need").agg(F.count("*").alias("large"))
    few = rows.where(F.col("rows") <= FEW).select("class", "n", "h").repartition(partitions_for(rows.sparkSession), "h").sortWithinPartitions("h")
    pairs = few.mapInArrow(lean(_pairs), "a long, b long, n_a long, n_b long, got long").groupBy("a", "b", "n_a", "n_b").agg(F.sum("got").alias("got"))
    for side in ("a", "b"):
        pairs = pairs.join(large.select(F.col("class").alias(side), F.col("large").alias(f"large_{side}")), side, "left")
    least = F.ceil(F.ceil(F.least("n_a", "n_b") * PERCENT / 100) / COMMON)
    both = F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    likely = pairs.where(F.col("got") + both >= least).select("a", "b")
    heavy = materialise(many.join(large.where(F.col("large") >= F.col("need")).select("class"), "class").select("class", "h"), "jaccard-heavy")
    # A table of its own, as above.
    centres = materialise(heavy.groupBy("h").agg(F.min("class").alias("a")), "jaccard-centres")
    stars = heavy.join(centres, "h").select("a", F.col("class").alias("b"))
    return likely.unionByName(stars.where("a <> b").distinct())


def _enough(rows: DataFrame) -> DataFrame:
    """Rows of classes that share as many columns as a link takes."""
    need = F.ceil(F.ceil(F.col("n") * PERCENT / 100) / COMMON)
    return rows.join(rows.groupBy("class", "n").agg(F.count("*").alias("got")).where(F.col("got") >= need).select("class"), "class")


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Counts of common shingles, row by column: the product of both incidence matrices. Shingles that few sets of
    either side have add up their pairs one by one; frequent ones are multiplied as dense columns, so many at a time."""
    out = np.zeros((len(rows), len(cols)), np.int32)
    if len(rows) * len(cols) <= 16:
        for i, a in enumerate(rows):
            for j, b in enumerate(cols):
                out[i, j] = len(np.intersect1d(a, b, assume_unique=True))
        return out
    left, right = np.concatenate(rows), np.concatenate(cols)
    both = np.intersect1d(left, right)
    if not len(both):
        return out

    def entries(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        whose = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return whose[hit][order], at[hit][order]

    (lr, lc), (rr, rc) = entries(left, rows), entries(right, cols)
    n_left, n_right = np.bincount(lc, minlength=len(both)), np.bincount(rc, minlength=len(both))
    dense = n_left * n_right > FEW_PAIRS
    sparse = ~dense[lc]
    times, begin, row = n_right[lc[sparse]], (np.cumsum(n_right) - n_right)[lc[sparse]], lr[sparse]
    ends = np.cumsum(times)
    a = 0
    while a < len(times):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ADDED)))
        part = times[a:b]
        within = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
        pair = np.repeat(row[a:b] * len(cols), part) + rr[np.repeat(begin[a:b], part) + within]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape).astype(np.int32)
        a = b

    number = np.cumsum(dense) - 1
    (lr, lc), (rr, rc) = ((r[dense[c]], number[c[dense[c]]]) for r, c in ((lr, lc), (rr, rc)))
    for c in range(0, int(dense.sum()), COLUMNS):
        a, b = np.searchsorted(lc, (c, c + COLUMNS)), np.searchsorted(rc, (c, c + COLUMNS))
        x, y = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(cols), COLUMNS), np.float32)
        x[lr[a[0] : a[1]], lc[a[0] : a[1]] - c] = 1
        y[rr[b[0] : b[1]], rc[b[0] : b[1]] - c] = 1
        out += (x @ y.T).astype(np.int32)
    return out


def linked(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Which pairs are linked: exact, in integers."""
    common = overlaps(rows, cols).astype(np.int64)
    total = np.array([len(x) for x in rows])[:, None] + np.array([len(x) for x in cols])[None, :] - common
    return 100 * common >= PERCENT * total


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by task key; side 0 are a block's rows and side 1 the columns they are multiplied with, none where a
    block is multiplied with itself. Gives a spanning forest of the links."""
    now, sides = None, ({}, {})

    def out() -> pa.RecordBatch:
        left, right = (list(s.items()) for s in sides)
        found = Union()
        if not right:
            right = left
        a, b = [x for x, _ in left], [x for x, _ in right]
        for i, j in zip(*np.nonzero(linked([s for _, s in left], [s for _, s in right])), strict=True):
            if a[i] != b[j]:
                found.unite(a[i], b[j])
        return edge_batch(*found.forest())

    for batch in batches:
        for key, side, c, data in zip(*(batch.column(x).to_pylist() for x in ("key", "side", "class", "data")), strict=True):
            if key != now:
                if now is not None and sum(map(len, sides)) > 1:
                    yield out()
                now, sides = key, ({}, {})
            sides[side][c] = np.frombuffer(data, np.uint64)
    if now is not None and sum(map(len, sides)) > 1:
        yield out()


def multiply(pairs: DataFrame) -> DataFrame:
    """Links (a, b) of task rows (key, side, class, data)."""
    n = partitions_for(pairs.sparkSession)
    return pairs.repartition(n, "key").sortWithinPartitions("key", "side").select("key", "side", "class", "data").mapInArrow(lean(_multiply), "a long, b long")


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the number of blocks that their keys' sets take, as ``name``."""
    size = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return rows.join(rows.groupBy(*keys).agg(size.alias(name)), keys)


def family_links(sets: DataFrame) -> DataFrame:
    """Links that connect what the families' links connect. ``sets``: family, class, n, data.

    A family of one block is multiplied with itself. A larger one is cut into steps of size, so that linked sets lie
    in one step or in neighbours, and each step into blocks. Every block is first multiplied with itself and with the
    first block of its step; what is connected then need not be compared again, so only sets outside the family's
    largest component are multiplied with all blocks of their own step and the two beside it.
    """
    placed = materialise(_blocks(sets, ["family"], "blocks"), "jaccard-families")

    def key(*parts):
        return F.concat_ws(":", *parts).alias("key")

    def side(rows: DataFrame, k: Column, number: int) -> DataFrame:
        return rows.select(k, F.lit(number).alias("side"), "class", "data")

    own = side(placed.where("blocks = 1"), key("family"), 0)
    # Sizes of linked sets differ by a factor of 100 / PERCENT at most, which is one step.
    step = F.floor(F.log("n") / F.lit(np.log(100 / PERCENT)) + 1e-9).cast("int")
    stepped = _blocks(placed.where("blocks > 1").drop("blocks").withColumn("step", step), ["family", "step"], "blocks")
    large = materialise(stepped.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "jaccard-blocks")
    if large.isEmpty():
        links = materialise(multiply(own), "jaccard-links")
        drop(placed, large)
        return links
    diagonal = side(large, key("family", "step", "block"), 0)
    to_first = side(large.where("block > 0"), key("family", "step", "block", F.lit("first")), 0)
    # A step's first block goes to each of its other blocks: rows of one block, times their number.
    spread = large.where("block = 0 and blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    first = side(spread, key("family", "step", "other", F.lit("first")), 1)
    links = materialise(multiply(own.unionByName(diagonal).unionByName(to_first).unionByName(first)), "jaccard-links")

    known = components(links, "jaccard-known").withColumnRenamed("node", "class")
    labelled = large.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    count = labelled.groupBy("family", "component").agg(F.count("*").alias("n_sets"))
    main = count.groupBy("family").agg(F.max_by("component", F.struct("n_sets", "component")).alias("main"))
    marked = materialise(labelled.join(main, "family").withColumn("rest", F.col("component") != F.col("main")).select(*large.columns, "rest"), "jaccard-marked")
    rest = _blocks(marked.where("rest"), ["family", "step"], "shares").withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int"))
    # Task rows: a share of the rest of a step against a block of a step beside it. Two sets of the rest meet in the
    # smaller one's turn, so the step below counts without its rest.
    places = marked.groupBy("family", "step", "block").agg(F.bool_or(~F.col("rest")).alias("settled"))
    shares = rest.select("family", "step", "share").distinct()
    tasks = (
        shares.withColumn("beside", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .join(places.select("family", (F.col("step")).alias("_step"), "block", "settled"), "family")
        .where((F.col("_step") == F.col("step") + F.col("beside")) & ((F.col("beside") >= 0) | F.col("settled")))
        .select("family", "step", "share", "_step", "block", "beside", key("family", "step", "share", "_step", "block"))
    )
    left = side(rest.join(tasks.select("family", "step", "share", "key"), ["family", "step", "share"]), F.col("key"), 0)
    right = marked.withColumnRenamed("step", "_step").join(tasks.drop("step", "share"), ["family", "_step", "block"])
    right = side(right.where((F.col("beside") >= 0) | ~F.col("rest")), F.col("key"), 1)
    more = materialise(multiply(left.unionByName(right)), "jaccard-more-links")
    drop(placed, large, marked)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class (equal for equal
    sets; null without shingles), component (the smallest class reachable) and the columns in ``carry``.

    Null and empty texts, and texts without words, have no shingles and are their own component. Rows without a
    doc_id take part; a component of such rows alone has a null id. Repeated rows are one class. An empty table gives
    no rows. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_text", F.xxhash64("text"))
    rows = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), *carry).alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    schema = T.StructType([rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("class", T.LongType()), T.StructField("columns", T.ArrayType(T.LongType()))])
    sets = materialise(rows.mapInArrow(lean(_sets), schema), "jaccard-sets")
    sent = sets.select("class", "n", F.explode("columns").alias("h"))
    shared = materialise(_shared(sent), "jaccard-shared")
    wide, sets = sets, materialise(sets.drop("columns"), "jaccard-classes")
    drop(wide)
    enough = materialise(_enough(shared), "jaccard-enough")
    drop(shared)
    again = materialise(_enough(materialise(_shared(enough), "jaccard-shared-again")), "jaccard-candidates")
    drop(enough)
    families = components(candidates(again), "jaccard-families")
    drop(again)
    families = families.select(F.col("node").alias("class"), F.col("component").alias("family"))

    # One text stands for a class, one that few rows repeat. It is found by its id and its hash, so that rows without an
    # id, or with one id, don't all meet.
    copies = sets.where("n > 0").groupBy("class", "row.doc_id", "row._text").agg(F.count("*").alias("copies"))
    chosen = copies.groupBy("class").agg(F.min(F.struct("copies", "doc_id", "_text")).alias("x")).join(families, "class")
    chosen = chosen.select(F.col("x.doc_id").alias("_id"), F.col("x._text").alias("_hash"), "class", "family")
    texts = base.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))).select("class", "family", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            keep, n, data = [], [], []
            wanted = batch.column("class").to_pylist()
            first = [r for r, c in enumerate(wanted) if not (c in sent or sent.add(c))]  # rows may repeat a text
            batch = batch.take(pa.array(first, pa.int64()))
            if len(sent) > SEEN:
                sent.clear()
            wanted = batch.column("class").to_pylist()
            for r, s in enumerate(shingle_sets(batch)):
                if len(s) and class_of(s) == wanted[r]:
                    keep.append(r), n.append(len(s)), data.append(s.tobytes())
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("family"), part.column("class"), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["family", "class", "n", "data"])

    links = family_links(texts.mapInArrow(lean(full), "family long, class long, n long, data binary"))
    found = components(links, "jaccard-components").withColumnRenamed("node", "class")
    labelled = materialise(
        sets.select("row.*", "n", "class").join(found, "class", "left").withColumn("component", F.coalesce("component", "class")), "jaccard-labelled"
    )
    # A table of its own: a join with it can split a component that very many documents are in.
    smallest = materialise(labelled.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-smallest")
    return labelled.join(smallest, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "class",
        "component",
        *carry,
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM t),
e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""
