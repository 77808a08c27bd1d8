"""Evaluation texts leaking into a corpus: spaced-seed hashing and verification of the overlaps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
RUN = 13
#: Word positions that the mask reads where no word may differ; it ignores the others. Cut to the item where that is shorter.
#: Equal words hash equally under any mask, so one finds every overlap; verification reads all positions.
EXACT_MASK = "1101101110111"
#: Bytes of evaluation text in a block at most, and blocks that one pass over the corpus holds.
BLOCK_BYTES, BLOCKS_AT_ONCE = 16_000_000, 4

_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_BROKEN = re.compile("(?<=[^\\W_])[-\u2010][ \t]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[ \t]*(?=[^\\W_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """NFKC, invisible characters deleted, words broken at line ends rejoined, lower-cased, split."""
    if not text:
        return []
    text = _BROKEN.sub("", _UNSEEN.sub("", unicodedata.normalize("NFKC", text)))
    return _WORD.findall(text.lower())


def masks_for(wrong: int, run: int = RUN) -> tuple[str, ...]:
    """Masks of which one ignores any `wrong` positions, also when cut short. Positions are dealt in turn into
    wrong + 2 classes; a mask ignores `wrong` of these, and there is one for each choice of them."""
    if not wrong:
        return (EXACT_MASK,)
    classes = wrong + 2
    return tuple("".join("0" if k % classes in ignored else "1" for k in range(run)) for ignored in combinations(range(classes), wrong))


class Index:
    """Spaced seeds of one block of evaluation items."""

    def __init__(self, items: list[tuple[int, str]], run: int, masks: tuple[str, ...]):
        self.run, self.vocabulary = run, {}
        self.ids, texts = [], []
        for item, text in items:
            if found := words(text):
                self.ids.append(item)
                texts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))
        self.words = np.concatenate([*texts, np.zeros(0, np.int64)])
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.need = np.minimum(self.length, run)
        self.weight = np.random.default_rng(5).integers(1, 2**62, run) | 1
        self.seeds = []
        for span in np.unique(self.need):
            own = np.flatnonzero(self.need == span)
            at = np.concatenate([self.start[i] + np.arange(self.length[i] - span + 1) for i in own])
            item = np.repeat(own, self.length[own] - span + 1)
            for mask in dict.fromkeys(m[:span] for m in masks):
                read = np.array([k for k, c in enumerate(mask) if c == "1"], np.int64)
                key = self.hash(self.words, at, read)
                order = np.argsort(key, kind="stable")
                self.seeds.append((int(span), read, key[order], item[order], (at - self.start[item])[order]))

    def hash(self, ids: np.ndarray, at: np.ndarray, read: np.ndarray) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for k in read:
            key = (key ^ ((ids[at + k] + 7) * self.weight[k])) * np.int64(0x9E3779B97F4A7C1 | 1)
            key ^= key >> 29
        return key

    def hits(self, ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Columns (document, item, word of the document minus word of the item), each once.

        ids: words of all documents, -1 for words in no item; doc: each word's document; ends: by document."""
        found = [np.zeros((3, 0), np.int64)]
        for span, read, key, item, offset in self.seeds:
            at = np.flatnonzero(np.arange(len(ids)) + span <= ends[doc]) if len(ids) else np.zeros(0, np.int64)
            if not len(read):  # all of the item may differ: any place of a document will do
                at = at[np.unique(doc[at], return_index=True)[1]]
            for k in read:
                at = at[ids[at + k] >= 0]
            own = self.hash(ids, at, read)
            low, high = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            n = high - low
            hit = np.repeat(np.arange(len(at)), n)
            seed = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.stack([doc[at[hit]], item[seed], at[hit] - offset[seed]]))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def verify(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, hits: np.ndarray, wrong: int) -> list[tuple[int, int, int, int]]:
        """(document, item, words, substitutions) of the longest stretch on each diagonal that has at most
        `wrong` substitutions in any `need` words, where it is long enough."""
        kept = []
        for doc, item, shift in hits.T.tolist():
            first = max(0, starts[doc] - shift)
            last = min(self.length[item], ends[doc] - shift)
            need = int(self.need[item])
            if last - first < need:
                continue
            at = self.start[item]
            same = self.words[at + first : at + last] == ids[shift + first : shift + last]
            missed = np.concatenate([[0], np.cumsum(~same)])
            good = np.flatnonzero(missed[need:] - missed[:-need] <= wrong)
            if len(good):
                cuts = np.flatnonzero(np.diff(good) > 1)
                for lo, hi in zip(good[np.r_[0, cuts + 1]], good[np.r_[cuts, len(good) - 1]] + need):
                    kept.append((doc, item, int(hi - lo), int(missed[hi] - missed[lo])))
        return kept


def blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; only one block is on the driver at a time."""
    block, held = [], 0
    for row in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        if block and held + len(row.text) * 4 > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += len(row.text) * 4
    if block:
        yield block


def overlaps(
    documents: DataFrame, items: DataFrame, wrong: int = 0, run: int = RUN, masks: tuple[str, ...] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, words, substitutions): the longest overlap of each document with each item.

    An overlap is a stretch of aligned words, at least `run` of them or all of an item that has fewer,
    with at most `wrong` substitutions in any so many. Every overlap is found: equal words hash equally under
    any mask, and wherever the substitutions are, one of the masks of `masks_for` ignores them. So an item of
    no more words than `wrong` overlaps with every document that has as many.
    Null, empty and wordless texts on either side overlap with nothing; rows without an id are passed
    over; repeated items count as one each; other columns are not read. The corpus is scanned once for every
    4 blocks of items, whole texts, without a shuffle but for dropping repeats; a block's size is checked.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, words int, substitutions int"
    found = spark.createDataFrame([], schema)
    given = blocks(items, block_bytes)
    while held := [spark.sparkContext.broadcast(block) for block in islice(given, BLOCKS_AT_ONCE)]:

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            indexes = [Index(sent.value, run, masks or masks_for(wrong, run)) for sent in held]
            for batch in batches:
                doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for lo in range(0, len(texts), 2000):
                    each = [words(t) for t in texts[lo : lo + 2000]]
                    lengths = np.array([len(e) for e in each], np.int64)
                    ends, doc = np.cumsum(lengths), np.repeat(np.arange(len(each)), lengths)
                    rows = []
                    for index in indexes:
                        known = index.vocabulary
                        ids = np.fromiter((known.get(w, -1) for e in each for w in e), np.int64, len(doc))
                        kept = index.verify(ids, ends - lengths, ends, index.hits(ids, doc, ends), wrong)
                        rows += [(doc_ids[lo + d], index.ids[i], n, s) for d, i, n, s in kept]
                    yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "words", "substitutions"), r)) for r in rows], OUT)

        part = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(scan, schema)
        found = found.union(part)
    best = F.max_by(F.struct("words", "substitutions"), F.col("words") * 1000 - F.col("substitutions")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.words", "best.substitutions")


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("substitutions", pa.int32())])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): 13 consecutive words, or all of a shorter item, occur in the document."""
    return overlaps(documents, items).select("doc_id", "item_id")
