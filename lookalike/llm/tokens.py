"""Encoding of whole texts with a public byte-level BPE vocabulary, and decoding.

Texts are cut into overlapping chunks. Chunks are pre-tokenised apart from one another; a chunk may
begin inside a pre-token, so it counts only from the first boundary in the overlap that the chunk before
also has. Pre-tokenisation depends on nothing before its position, so from there on both agree. The
pieces between such joints are encoded apart and their ids put together in order. The chunks of an ordinary text
stay in the task that reads it; those of a very long one are dealt out to many.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.session import stage_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of the vocabulary; fixed by it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST_CONTRACTION = 3
#: Characters of a chunk and of the overlap with the next.
CHUNK, OVERLAP = 1_000, 100
#: Texts of more characters have their chunks, SPREAD_CHUNK long, encoded by different tasks.
SPREAD, SPREAD_CHUNK, SPREAD_OVERLAP = 1_000_000, 100_000, 2_000
PART = pa.schema([("key", pa.int64()), ("k", pa.int32()), ("at", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_array(ids: list[list[int]]) -> pa.Array:
    return pa.array(ids, pa.list_(pa.int32()))


_PRE_TOKENS = regex.compile(PATTERN)


def boundaries(text: str, least: int = 0) -> Iterator[int]:
    """Where pre-tokens begin, from `least` on, but for those after white space: a run of it is split by what follows,
    so a piece that ended there would be pre-tokenised in another way."""
    for m in _PRE_TOKENS.finditer(text):
        at = m.start()
        if at >= least and not (at and text[at - 1].isspace()):
            yield at


def piece_starts(text: str, chunk: int, overlap: int) -> list[int]:
    """Where the pieces of a text begin: at 0, and at the first boundary behind each border of two chunks that
    both have. An overlap without one, as inside a pre-token longer than it, is doubled until there is one."""
    starts, begun = [0], 0
    for at in range(chunk, len(text), chunk):
        if at <= starts[-1]:
            continue
        stop = at
        while True:
            stop = min(len(text), at + max(overlap, 2 * (stop - at)))
            before = set(boundaries(text[begun:stop], at - begun))
            # Cut at different places: where a text is cut, a contraction may seem to have a boundary inside.
            joint = next((at + c for c in boundaries(text[at : stop + LONGEST_CONTRACTION]) if at - begun + c in before), None)
            if joint is not None or stop == len(text):
                break
        if joint is None:
            break
        starts.append(joint)
        begun = at
    return starts


def encoded_pieces(coder, text: str | None, chunk: int, overlap: int) -> list[int]:
    if not text:
        return []
    starts, ids = piece_starts(text, chunk, overlap), []
    for start, stop in zip(starts, [*starts[1:], len(text)]):
        ids += coder.encode_ordinary(text[start:stop])
    return ids


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids): the ids of each text as stored, without special tokens, in any row order.

    Null and empty texts give an empty list; names of special tokens in a text are ordinary text. Every
    row gives one row, repeated and null doc_ids included. Other columns are not read. Every text of more than
    `chunk` characters is cut as above; of up to `spread` characters within the task that reads it, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            ids = [encoded_pieces(coder, t, chunk, overlap) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids_array(ids)], names=["doc_id", "ids"])

    rows = documents.select("doc_id", "text")
    long = F.coalesce(F.length("text") > spread, F.lit(False))
    near = rows.where(~long).mapInArrow(run, "doc_id bigint, ids array<int>")
    far = rows.where(long)
    if far.isEmpty():
        return near
    return near.unionByName(encode_spread(far, vocabulary, min(spread, SPREAD_CHUNK), min(overlap, SPREAD_OVERLAP) if spread < SPREAD else SPREAD_OVERLAP))


def encode_spread(rows: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """As encode, with the chunks of each text dealt out to many tasks; only boundaries in the overlaps meet by text.
    Where an overlap has no joint, the text's pieces are found in one task, which widens it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for k, at in enumerate(range(0, len(text), chunk)):
                    last = at + chunk >= len(text)
                    part = text[at : at + chunk + (0 if last else overlap)]
                    yield pa.RecordBatch.from_pylist([{"key": key, "k": k, "at": at, "last": last, "part": part}], PART)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for at, last, part in zip(*(batch.column(c).to_pylist() for c in ("at", "last", "part"))):
                cuts = list(boundaries(part))
                heads.append([at + c for c in cuts if c <= overlap])
                tails.append([] if last else [at + c for c in cuts if c >= chunk])
            added = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "head", "tail"])

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            ids = []
            for at, start, stop, part in zip(*(batch.column(c).to_pylist() for c in ("at", "start", "stop", "part"))):
                ids.append(coder.encode_ordinary(part[start - at : None if stop is None else stop - at]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), ids_array(ids)], names=["key", "k", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            ids = [encoded_pieces(coder, t, chunk, overlap) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids_array(ids)], names=["key", "ids"])

    # Staged: numbers given in passing may differ each time the rows are read.
    keyed = stage_table(rows.withColumn("key", F.monotonically_increasing_id()), "long")
    parts = keyed.select("key", "text").mapInArrow(cut, "key bigint, k int, at bigint, last boolean, part string").repartition("key", "k")
    marked = stage_table(parts.mapInArrow(pretokenise, "key bigint, k int, at bigint, last boolean, part string, head array<bigint>, tail array<bigint>"), "chunks")
    in_text = Window.partitionBy("key").orderBy("k")
    joints = marked.select("key", "k", "last", "head", F.lag("tail").over(in_text).alias("before"))
    start = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before")))
    joints = joints.select("key", "k", "last", start.alias("start")).withColumn("stop", F.lead("start").over(in_text))
    joints = stage_table(joints, "joints")
    broken = joints.where(F.col("start").isNull()).select("key").distinct()
    pieces = marked.select("key", "k", "at", "part").join(joints.select("key", "k", "start", "stop"), ["key", "k"]).join(broken, "key", "left_anti")
    done = pieces.select("key", "k", "at", "start", "stop", "part").mapInArrow(encode_pieces, "key bigint, k int, ids array<int>")
    done = done.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    rest = keyed.join(broken, "key", "left_semi").select("key", "text").mapInArrow(whole, "key bigint, ids array<int>")
    return keyed.select("doc_id", "key").join(done.unionByName(rest), "key").select("doc_id", "ids")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the bytes of all ids in order, read as UTF-8. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            texts = [b"".join(coder.decode_tokens_bytes(ids or [])).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, chars, same): whether decoding gives back each text; null counts as empty."""
    encoded = encode(documents, vocabulary)
    back = decode(encoded, vocabulary).select("doc_id", F.md5("text").alias("back"))
    sizes = encoded.select("doc_id", F.size("ids").alias("tokens"))
    text = F.coalesce("text", F.lit(""))
    given = documents.select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("given"))
    return given.join(sizes, "doc_id").join(back, "doc_id").select("doc_id", "tokens", "chars", (F.col("given") == F.col("back")).alias("same"))
