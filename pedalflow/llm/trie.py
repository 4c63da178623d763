"""A trie of conversation prefixes: MSD radix partitioning over dictionary-encoded turns, by Spark until buckets are
local, then multikey quicksort in tasks.

Turns get numbers from a dictionary of the distinct (role, text). Equal sequences of numbers are one sequence, with
the count and the smallest id of its conversations. A bucket holds the sequences that share their first turns. What
they all share beyond those is the common prefix of the smallest and the largest of them, so each round jumps over it
and parts the bucket by the next turn: rounds follow branchings, not depths, and copies cost none. A bucket of few
turns goes to one task with others of its kind, where a recursion sorts it turn by turn and gives the nodes that it
passes. Sums over subtrees come back up round by round, one row a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, drop, lean, materialise, partitions_for, prepare, read

#: Turns beyond the common prefix that a bucket has at most when a task finishes it, unless it is one sequence.
LOCAL_TURNS = 4096
#: Bytes of joined ids after which a task hands on a piece, and nodes after which it hands on a batch.
PIECE_BYTES, NODE_BATCH = 1 << 16, 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string, up_depth long"


def encoded(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, seq): the turns of each conversation in order, as structs of their number in a dictionary of all
    distinct (role, text) and their number of words.

    Turns are ordered by ``turn``, null first; those of one number by role, then text. Null roles and texts are empty.
    Rows without conv_id take no part, repeated rows are turns of their own, further columns are dropped. Texts of any
    length are read whole and told apart by SHA-256. A conversation is one record of 16 bytes a turn.
    """
    prepare(conversations.sparkSession)
    clean = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    words = F.size(F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)")).cast("long")
    turns = materialise(clean.select("conv_id", F.row_number().over(place).alias("pos"), key.alias("key"), words.alias("words")), "trie-turns")
    names = materialise(turns.groupBy("key").agg(F.max("words").alias("words")).select("key", "words", F.monotonically_increasing_id().alias("id")), "trie-names")
    numbered = turns.drop("words").join(names, "key").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("all"))
    found = materialise(numbered.select("conv_id", F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("seq")), "trie-sequences")
    drop(turns, names)
    return found


def rebuilt(sequences: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c with its first h turns, h = crc32(c) % heads, replaced by those of conversation
    c - c % group: all if that has fewer, none if it doesn't exist."""
    lead = sequences.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("lead"), F.slice("seq", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = sequences.select("conv_id", "seq", (F.col("conv_id") - F.col("conv_id") % group).alias("lead"), h.alias("h")).join(lead, "lead", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("seq", 1, 0))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("seq"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key and conv_id; gives the ids of each key in pieces, joined by commas, with the first of each."""
    now, first, parts, size = None, 0, [], 0
    for batch in batches:
        out: list[tuple[bytes, int, str]] = []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if parts and (key != now or size > PIECE_BYTES):
                out.append((now, first, ",".join(parts)))
                parts, size = [], 0
            if not parts:
                now, first = key, conv
            parts.append(str(conv))
            size += len(parts[-1]) + 1
        yield _pieces(out)
    if parts:
        yield _pieces([(now, first, ",".join(parts))])


def _pieces(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    key, first, piece = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(piece, pa.string())], names=["key", "first", "piece"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come by key and first id; gives the SHA-256 of each key's ids, of which it never holds more than a piece."""
    now, state = None, None

    def out(keys: list[bytes], hashes: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends"])

    for batch in batches:
        keys, hashes = [], []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if key == now:
                state.update(b"," + piece.encode())
                continue
            if state is not None:
                keys.append(now)
                hashes.append(state.hexdigest())
            now, state = key, hashlib.sha256(piece.encode())
        yield out(keys, hashes)
    if state is not None:
        yield out([now], [state.hexdigest()])


def _distinct(sequences: DataFrame) -> DataFrame:
    """Rows (lead, n, ends, seq): each distinct sequence, its smallest conversation, their number and the hash of all
    their ids in ascending order. Ids are joined in pieces by range first, so a sequence of very many conversations
    reaches the one task that hashes it as a few rows."""
    key = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda x: x["id"].cast("string")), ",").cast("binary"), 256))
    keyed = materialise(sequences.select(key.alias("key"), "conv_id", "seq"), "trie-keyed")
    n = partitions_for(keyed.sparkSession)
    pieces = keyed.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lean(_join_ids), "key binary, first long, piece string")
    ends = pieces.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(lean(_hash), "key binary, ends string")
    one = keyed.groupBy("key").agg(F.min("conv_id").alias("lead"), F.count("*").alias("n"), F.first("seq").alias("seq"))
    found = materialise(one.join(ends, "key").select("lead", "n", "ends", "seq"), "trie-distinct")
    drop(keyed)
    return found


def _common(low: str, high: str) -> Column:
    """How many first turns two sequences share."""
    same = F.zip_with(low, high, lambda a, b: F.coalesce(a["id"] == b["id"], F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def _chain(depth: Column, common: Column) -> Column:
    """Words of the turns that end at depths from depth to common; 0 for the root."""
    turns = F.slice("low", F.greatest(depth, F.lit(1)), common - F.greatest(depth, F.lit(1)) + 1)
    words = F.transform(turns, lambda x: x["words"])
    return F.when(depth == 0, F.concat(F.array(F.lit(0).cast("long")), words)).otherwise(words)


def _summary(lead: str = "lead") -> list[Column]:
    """Of a bucket's sequences."""
    return [F.min(lead).alias("conv"), F.sum("n").alias("n"), F.count("*").alias("seqs"), F.sum(F.size("seq")).alias("turns"), F.min("seq").alias("low"), F.max("seq").alias("high")]


def grow(rows: list[tuple], depth: int) -> list[list]:
    """The nodes of a bucket of distinct sequences that share their first ``depth`` turns, its top first.

    rows: (lead, n, ends, ids, words). Gives lists: conv_id, depth, parent's conv_id (the top's: None), n_convs,
    n_children, n_leaves, saved_tokens, ends. Multikey quicksort: rows of one node are parted by their next turn into
    smaller, equal and larger ones; the equal ones are a child, the others are parted again.
    """
    conv, deep, parent, n, children, saved, ends = [], [], [], [], [], [], []
    open_nodes = [(rows, depth, -1)]
    while open_nodes:
        held, d, up = open_nodes.pop()
        k = len(conv)
        live, end = [], EMPTY
        for row in held:
            if len(row[3]) > d:
                live.append(row)
            else:
                end = row[2]
        conv.append(min(row[0] for row in held))
        n.append(sum(row[1] for row in held))
        deep.append(d)
        parent.append(up)
        children.append(0)
        ends.append(end)
        saved.append((n[k] - 1) * held[0][4][d - 1] if d else 0)
        if up >= 0:
            children[up] += 1
        parts = [live] if live else []
        while parts:
            part = parts.pop()
            pivot = part[len(part) // 2][3][d]
            less, more, equal = [], [], []
            for row in part:
                turn = row[3][d]
                (equal if turn == pivot else less if turn < pivot else more).append(row)
            open_nodes.append((equal, d + 1, k))
            parts += [x for x in (less, more) if x]
    leaves = [int(c == 0) for c in children]
    for k in range(len(conv) - 1, 0, -1):  # children come after their parents
        leaves[parent[k]] += leaves[k]
        saved[parent[k]] += saved[k]
    above = [None if up < 0 else conv[up] for up in parent]
    return [conv, deep, above, n, children, leaves, saved, ends]


def _batch(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*NODE, "ends_sha256", "up_depth"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket; gives all nodes of each."""
    held: list[tuple] = []
    made: list[list] = [[] for _ in range(9)]
    now: tuple = ()

    def close() -> None:
        _, depth, up_conv, up_depth = now
        found = grow(held, depth)
        found[2][0] = up_conv
        for column, values in zip(made, [*found, [up_depth] + [None] * (len(found[0]) - 1)], strict=True):
            column.extend(values)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "depth", "up_conv", "up_depth", "lead", "n", "ends")]
        seq = batch.column("seq")
        offsets = seq.offsets.to_numpy()
        ids, words = (seq.values.field(k).to_numpy() for k in range(2))
        for r, (conv, depth, up_conv, up_depth, lead, n, ends) in enumerate(zip(*columns, strict=True)):
            bucket = (conv, depth, up_conv, up_depth)
            if held and bucket != now:
                close()
                held = []
                if len(made[0]) > NODE_BATCH:
                    yield _batch(made)
                    made = [[] for _ in range(9)]
            now = bucket
            a, b = offsets[r], offsets[r + 1]
            held.append((lead, n, ends, ids[a:b].tolist(), words[a:b].tolist()))
    if held:
        close()
    yield _batch(made)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket that Spark parted, the nodes from its top to where it branches."""
    for batch in batches:
        for row in batch.to_pylist():
            words = np.asarray(row["chain"], np.int64)
            count, conv = len(words), row["conv"]
            saved = np.cumsum(words[::-1])[::-1] * (row["n"] - 1) + row["below"]
            yield _batch(
                [
                    [conv] * count,
                    range(row["depth"], row["depth"] + count),
                    [row["up_conv"]] + [conv] * (count - 1),
                    [row["n"]] * count,
                    [1] * (count - 1) + [row["children"]],
                    [row["leaves"]] * count,
                    saved,
                    [EMPTY] * (count - 1) + [row["ends"] or EMPTY],
                    [None] * count,
                ]
            )


def prefix_trie(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row for each node of the trie of these sequences (conv_id, seq as ``encoded`` gives it; one row a
    conv_id): conv_id, the smallest of its members, which start with it; depth; parent_conv_id (root: null); n_convs;
    n_children; n_leaves, childless nodes in its subtree; saved_tokens, over its subtree the words of each node's last
    turn times n_convs - 1; ends_sha256, of the ascending ids, joined by commas, of the members that end there.

    A sequence without turns ends at the root. Equal sequences share every node. Without any sequence there is no
    root and no row. Sequences may be of any length; a task holds those of one bucket, local_turns turns beyond what
    they share, or one sequence.
    """
    spark = sequences.sparkSession
    prepare(spark)
    every = _distinct(sequences)
    tops = every.agg(*_summary()).withColumn("common", _common("low", "high")).withColumn("depth", F.lit(0))
    null = F.lit(None).cast("long")
    top = materialise(tops.where("conv is not null").select("conv", "depth", null.alias("up_conv"), null.cast("int").alias("up_depth"), "n", "common", _chain(F.col("depth"), F.col("common")).alias("chain")), "trie-root")
    root = top.select("conv", "common").first()
    if root is None:
        return spark.createDataFrame([], NODES).drop("up_depth")
    now = every.select(F.lit(root["conv"]).alias("conv"), F.lit(0).alias("depth"), F.lit(root["common"]).alias("common"), "lead", "n", "ends", "seq")
    rounds, buckets, local = [now], [top], []
    while True:
        live = rounds[-1].where(F.size("seq") > F.col("common")).withColumn("turn", F.get("seq", F.col("common"))["id"])
        own = live.select(F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth"), "turn", "common", "lead", "n", "ends", "seq")
        parted = own.groupBy("up_conv", "up_depth", "turn", F.col("common").alias("above")).agg(*_summary())
        beyond = F.col("turns") - F.col("seqs") * (F.col("above") + 1)
        kids = materialise(
            parted.withColumn("common", _common("low", "high")).withColumn("depth", F.col("above") + 1)
            .select("up_conv", "up_depth", "turn", "conv", "depth", "n", "common", ((F.col("seqs") > 1) & (beyond > local_turns)).alias("large"), F.when((F.col("seqs") > 1) & (beyond > local_turns), _chain(F.col("depth"), F.col("common"))).alias("chain")),
            "trie-buckets",
        )
        sent = own.drop("common").join(kids.drop("n", "chain"), ["up_conv", "up_depth", "turn"])
        local.append(sent.where(~F.col("large")).select("conv", "depth", "up_conv", "up_depth", "lead", "n", "ends", "seq"))
        if not kids.where("large").take(1):
            break
        rounds.append(materialise(sent.where("large").select("conv", "depth", "common", "lead", "n", "ends", "seq"), "trie-open"))
        buckets.append(kids.where("large"))
    small = local[0]
    for part in local[1:]:
        small = small.unionByName(part)
    n = partitions_for(spark)
    nodes = materialise(small.repartition(n, "conv", "depth").sortWithinPartitions("conv", "depth").mapInArrow(lean(_finish), NODES), "trie-nodes")
    out = nodes.drop("up_depth")
    below = nodes.where("up_depth is not null").select(F.col("parent_conv_id").alias("conv"), F.col("up_depth").alias("depth"), "n_leaves", "saved_tokens")
    inner = below.limit(0)
    for bucket, held in zip(buckets[::-1], rounds[::-1], strict=True):
        sums = below.unionByName(inner).groupBy("conv", "depth").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        ended = held.where(F.size("seq") == F.col("common")).select("conv", "depth", "ends")
        whole = bucket.select("conv", "depth", "up_conv", "up_depth", "n", "chain").join(sums, ["conv", "depth"], "left").join(ended, ["conv", "depth"], "left")
        zero = F.lit(0).cast("long")
        done = materialise(whole.withColumns({"children": F.coalesce("children", zero), "leaves": F.coalesce("leaves", F.lit(1).cast("long")), "below": F.coalesce("below", zero)}), "trie-upper")
        out = out.unionByName(done.mapInArrow(lean(_chains), NODES).drop("up_depth"))
        saved = F.col("below") + (F.col("n") - 1) * F.aggregate("chain", zero, lambda a, x: a + x)
        inner = done.select(F.col("up_conv").alias("conv"), F.col("up_depth").cast("long").alias("depth"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"))
    drop(every, *rounds[1:])
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(encoded(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


#: crc32 by its table of 256 remainders, which a recursion makes bit by bit.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS n, 0 AS step, i::UBIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT n, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE step < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE step = 8),
own AS (
  SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT FOR x IN string_split(CAST(c AS VARCHAR), '')]),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM own), tab),
mixed AS (
  SELECT k.c, 0 AS side, i, role, text FROM convs k JOIN own o ON o.c = k.c - k.c % 20 AND i <= h
  UNION ALL SELECT k.c, 1, i, role, text FROM convs k JOIN own o ON o.c = k.c AND i > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY side, i) AS d, role, text FROM mixed),
p AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM s
  UNION ALL SELECT c, 0, 0, '' FROM convs),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(words) AS words FROM p GROUP BY d, k),
v AS (SELECT node.*, u.k AS up FROM node LEFT JOIN p u ON u.c = conv_id AND u.d = node.d - 1),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS children FROM v WHERE up IS NOT NULL GROUP BY d, up),
full_v AS (SELECT v.*, coalesce(children, 0) AS children FROM v LEFT JOIN kids USING (d, k)),
sub AS (SELECT a.d, a.k, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * v.words) AS saved FROM full_v v JOIN p a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.d, a.k),
ends AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM p GROUP BY c) GROUP BY d, k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, v.children AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_v v LEFT JOIN node u ON u.d = v.d - 1 AND u.k = v.up JOIN sub ON sub.d = v.d AND sub.k = v.k LEFT JOIN ends ON ends.d = v.d AND ends.k = v.k
"""
