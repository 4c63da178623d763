"""Byte-level BPE encoding in overlapping chunks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, materialise, others, read, vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters a chunk owns, and characters it shares with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: A boundary closer than this to a chunk's cut end is not trusted: a pre-token's end depends on two more characters.
MARGIN = 2


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(vocabulary(path), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    ranks = ranks_of(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


PATTERN = regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, whole_end: bool) -> np.ndarray:
    """Where pre-tokens begin in a chunk; near a cut end, only places that what follows can't move."""
    found = np.asarray([m.start() for m in PATTERN.finditer(text)], np.int64)
    return found if whole_end else found[found <= len(text) - MARGIN]


def cut_points(heads: list[np.ndarray], tails: list[np.ndarray], sure: bool = False) -> list[int | None]:
    """For each chunk but the first: the smallest place that both its predecessor and it hold for a boundary.

    heads[i] are the boundaries that chunk i found in the part it shares with chunk i-1, tails[i] those it found in
    the part it shares with chunk i+1, both as places of the document. The pattern never looks back, so from a common
    boundary on both chunks find the same pre-tokens. None: they never meet, and the chunk is read on with its
    predecessor.

    The first chunk is right from its start, a later one from its cut point. After a chunk without one, the next two
    that meet resynchronise most likely, but both may be off alike: whoever reads the piece before such a cut must see
    its scan arrive there. With ``sure`` only cuts that need no such look are made.
    """
    out: list[int | None] = []
    for head, tail in zip(heads[1:], tails[:-1], strict=True):
        both = np.intersect1d(head, tail) if not sure or None not in out else ()
        out.append(int(both[0]) if len(both) else None)
    return out


def _chunk_rows(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Cuts whole texts into chunks of one row each; a chunk holds its own part and the part shared with the next."""
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            starts = range(0, len(text), chunk)
            for k, s in enumerate(starts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.string()), pa.array([k], pa.int32()), pa.array([s], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([text[s : s + chunk + overlap]], pa.string())],
                    names=["row", "k", "at", "length", "part"],
                )


def _scan(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Pre-tokenises each chunk alone and keeps the boundaries in the two shared parts."""
    for batch in batches:
        rows = batch.to_pydict()
        heads, tails = [], []
        for at, length, part in zip(rows["at"], rows["length"], rows["part"], strict=True):
            found = boundaries(part, at + len(part) == length) + at
            heads.append(found[found < at + overlap].tolist())
            tails.append(found[found >= at + chunk].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["row"], pa.string()), pa.array(rows["k"], pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
            names=["row", "k", "head", "tail"],
        )


def _stitch(pdf: pd.DataFrame, sure: bool = False) -> pd.DataFrame:
    """Of one document: for each chunk, the piece it belongs to, where that piece begins, where the next one does and
    whether its reader must see the scan arrive there."""
    pdf = pdf.sort_values("k")
    cuts = cut_points([np.asarray(x) for x in pdf["head"]], [np.asarray(x) for x in pdf["tail"]], sure)
    row, piece, first, out = pdf["row"].iloc[0], 0, 0, []
    for k, cut in zip(pdf["k"], [0, *cuts], strict=True):
        if cut is not None:
            piece, first = k, cut
        out.append((row, k, piece, first))
    found = pd.DataFrame(out, columns=["row", "k", "piece", "first"])
    begins = found.groupby("piece")["first"].first()
    many = found.groupby("piece").size() > 1
    found["stop"] = found["piece"].map(begins.shift(-1)).fillna(-1).astype("int64")
    found["look"] = found["piece"].map(many) & (found["stop"] >= 0)
    return found


PLACED = "row string, k int, piece int, first long, stop long, look boolean"
PIECES = "row string, piece int, ids binary, met boolean"


def _encode_pieces(pdf: pd.DataFrame, path: str) -> pd.DataFrame:
    """Encodes one piece: the text from its cut point to the next piece's, over one chunk or, where neighbours never
    met, several. ``met`` is false where the scan from its begin doesn't arrive at its end."""
    pdf = pdf.sort_values("k")
    parts, begin, end = [], int(pdf["at"].iloc[0]), int(pdf["at"].iloc[0])
    for at, part in zip(pdf["at"], pdf["part"], strict=True):
        parts.append(part[end - at :])
        end = at + len(part)
    text, first, stop = "".join(parts), int(pdf["first"].iloc[0]), int(pdf["stop"].iloc[0])
    stop, met = (end, True) if stop < 0 else (stop, True)
    if pdf["look"].iloc[0]:
        # Text goes on behind the end, so the last pre-tokens before it are those of the whole text.
        met = any(m.start() == stop - begin for m in PATTERN.finditer(text, first - begin))
    ids = encoder(path).encode_ordinary(text[first - begin : stop - begin]) if met else []
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "piece": [int(pdf["piece"].iloc[0])], "ids": [np.asarray(ids, "<u4").tobytes()], "met": [met]})


def _encode_short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            ids = [np.asarray(enc.encode_ordinary(t), "<u4").tobytes() if t else b"" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.binary())], names=["row", "ids"])


def _join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """A text's ids, null where some piece didn't meet its end."""
    if not pdf["met"].all():
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "ids": [None]})
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "ids": [b"".join(pdf.sort_values("piece")["ids"])]})


def encode(
    docs: DataFrame,
    path: str,
    keep: list[str] | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    column: str = "text",
    then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
    fields: T.StructType | None = None,
) -> DataFrame:
    """The columns ``keep`` of docs (default: all) and a binary column ``ids``: the token ids of the whole text,
    little-endian unsigned 32-bit.

    Texts of up to ``chunk`` characters are one chunk. Longer ones are cut into chunks that overlap, pre-tokenised
    in parallel, stitched at the first boundary that both neighbours find in their shared part, and encoded piece by
    piece; where neighbours never meet (one run longer than the overlap), the text is read on until two chunks do and
    the scan is seen to arrive there. Only one text's ids and boundaries ever meet in one task, and copies of a long
    text are encoded once.

    ``then`` maps batches of (row, ids) to (row, ``fields``) in the same workers' pass, so that ids needn't travel.

    Null or empty text: no ids. Repeated rows are encoded each. An empty table gives no rows. A column that is
    called ``ids``, in any case, is replaced. ``path`` is a rank file or the bare name of a public one.
    """
    out_names = fields.names if fields else ["ids"]
    keep = others(docs.columns if keep is None else keep, *out_names)
    kept = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    long_text = F.length(text) > chunk

    short = docs.where(~long_text).select(F.struct(*kept).alias("row"), text.alias("text"))
    row = short.schema["row"]
    out = T.StructType([row, *(fields or T.StructType([T.StructField("ids", T.BinaryType())]))])
    follow = then or (lambda batches: batches)
    short = short.mapInArrow(lean(lambda batches: follow(_encode_short(batches, path))), out)

    named = docs.where(long_text).select(F.struct(*kept).alias("kept"), F.sha2(text, 256).alias("row"), text.alias("text"))
    parts = materialise(
        named.select("row", "text").dropDuplicates(["row"]).mapInArrow(lambda it: _chunk_rows(it, chunk, overlap), "row string, k int, at long, length long, part string"),
        "bpe-chunks",
    )
    spread = parts.repartition("row", "k")
    scanned = materialise(spread.mapInArrow(lambda it: _scan(it, chunk, overlap), "row string, k int, head array<long>, tail array<long>"), "bpe-boundaries")

    def joined(rows: DataFrame, sure: bool) -> DataFrame:
        placed = rows.groupBy("row").applyInPandas(lambda pdf: _stitch(pdf, sure), PLACED)
        pieces = parts.join(placed, ["row", "k"]).groupBy("row", "piece").applyInPandas(lambda pdf: _encode_pieces(pdf, path), PIECES)
        return pieces.groupBy("row").applyInPandas(_join_pieces, "row string, ids binary")

    found = materialise(joined(scanned, False), "bpe-long")
    # Texts, if any, of which two chunks were off alike are read on from the last sure cut as one piece.
    again = joined(scanned.join(found.where("ids is null").select("row"), "row", "left_semi"), True)
    long_ids = found.where("ids is not null").unionByName(again)
    whole = named.drop("text").join(long_ids, "row").select(F.col("kept").alias("row"), "ids")
    if then is not None:
        whole = whole.mapInArrow(lean(follow), out)
    return short.unionByName(whole).select("row.*", *out.names[1:])


def decode_bytes(ids: bytes, path: str) -> bytes:
    """The raw bytes of some token ids, concatenated."""
    pieces = token_bytes(path)
    return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with a binary column ``decoded``, the bytes that the column ``ids`` stands for; null ids give null. A
    column that is called ``decoded``, in any case, is replaced."""
    kept = others(encoded.columns, "decoded")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [None if x is None else decode_bytes(x, path) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.binary())], names=["row", "decoded"])

    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "ids")
    done = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("decoded", T.BinaryType())]))
    return done.select("row.*", "decoded")


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Decodes ids and reduces both sides to a count and digests."""
    for batch in batches:
        n, a, b = [], [], []
        for x in batch.column("ids").to_pylist():
            n.append(len(x) // 4)
            a.append(hashlib.sha256(x).hexdigest())
            b.append(hashlib.sha256(decode_bytes(x, path)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["row", *DIGESTS.names])


def digests(docs: DataFrame, path: str, keep: list[str], **how: int) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 of every whole text: encoded, decoded again."""
    return encode(docs, path, keep, then=lambda batches: _digest(batches, path), fields=DIGESTS, **how)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), RANKS, ["doc_id"])
