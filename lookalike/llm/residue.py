"""Template residue, filler, error pages and script notices, by likelihood ratios of character n-grams.

Three character models are fitted: of filler and template slots, of error and script notices, and of natural prose with
texts that merely mention residue. Along a text the log likelihood ratio of each character is taken, of either kind of
residue against prose; windows of it localise residue, and a piece (a sentence, or a line) is residue if enough of it is
covered by such windows of one kind. Prose, and residue beyond the seed texts, are counted over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookalike.llm import residue_seeds as seeds

ORDER, LEAST_ORDER = 6, 3
#: Added to the frequency of every n-gram: half of one in two million characters; a smaller corpus is taken to be so
#: large, as its own residue would else weigh too much in its prose. One occurrence is taken off every count of natural
#: text, as the piece that is being judged is among those counted.
BACKGROUND = 2e6
UNSEEN = 0.5 / BACKGROUND
TABLE_BITS = 20
#: Shares of the corpus in the model of residue and of the mentions in that of prose; seed texts make up the rest.
FROM_CORPUS, MENTIONED = 0.5, 0.01
#: How much each seed text weighs: one with a slot, any other.
SLOT_WEIGHT, SEED_WEIGHT = 1.0, 2.0
#: Characters in a window, least mean log ratio of a covered one, least covered share of a piece.
WINDOW, WINDOW_RATIO, COVERAGE = 8, 0.0, 0.6
#: Of a piece without and with a slot: least mean log ratio; the same for it to count as residue in the fitting; least
#: sum of log ratios, so that a short one must be plainer.
PIECE_RATIO, MOVE_RATIO, EVIDENCE = (0.5, 0.0), (0.8, 0.2), (12.0, 2.0)
FILLER, NOTICES, PROSE = range(3)

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|(?<=[a-zа-яё][.!?])(?=[A-ZА-Я])")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n(?=[^\W\d_])")
_SLOT = re.compile(
    r"\{\{[^{}\n]{1,200}\}\}|\{%[^%\n]{1,200}%\}|[$#]?\{[^{}\n]{1,200}\}|<%=?[^%\n]{1,200}%>|<<[^<>\n]{1,200}>>|<[^\W\d][^<>\n]{1,200}>|\[\[[^\[\]\n]{1,200}\]\]"
    r"|\[[^\W\d][^\[\]\n]{1,200}\]|__[^_\s][^\n]{0,198}?__|@@[^@\n]{1,200}@@|%[^\W\d][^%\n]{1,200}%|#[^\W\d][^#\n]{1,200}#"
)
_NAME = re.compile(r"(?<=[^\W_] )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{3,}\b|(?<=\W )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{3,}\b|^[A-Z][a-z]{3,}(?= – )|(?<=\()[A-Z][a-z]{3,}(?=\))")
_LEAD = re.compile(r"^[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{3,24}: (?=[a-zß-öø-ÿ])")
_DIGITS = re.compile(r"\d+")


def pieces(text: str) -> list[str]:
    """Sentences, across lines that were broken for width; other lines stay apart."""
    out, held = [], ""
    for line in _HYPHEN.sub("", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n"):
        line = line.strip()
        broken = len(last) >= 24 and (last[-1].isalpha() or last[-1] in ",;") and " > " not in last if held else False
        goes_on = broken and line[:1].isalpha() and not line[0].isupper()
        if held and not goes_on:
            out.append(held)
            held = ""
        held, last = f"{held} {line}" if held else line.lstrip("> *~\t-"), line
    return [s.strip() for h in (*out, held) for s in _SENTENCE.split(h) if s.strip()]


def plain(piece: str) -> str:
    """What the models see: a slot is one character, a number another, letters are lower case. Beside a
    slot, names count as slots that were filled; a name before a colon, of whom or what is spoken, is left out."""
    piece, slots = _SLOT.subn("\ue000", _LEAD.sub("", piece))
    if slots:
        piece = _NAME.sub("\ue000", piece)
    return _DIGITS.sub("0", piece.lower())


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each of the longer orders, the table slots of the n-grams that end at each character of all texts; the
    lengths of the texts). Each text stands between marks of begin and end; the end mark counts as one."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    chars = np.frombuffer(("\x02" * (ORDER - 1) + ("\x03" + "\x02" * (ORDER - 1)).join(texts) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = chars.astype(np.uint64)
    ends = np.flatnonzero(chars != 2)
    out, key = [], np.zeros(len(ends), np.uint64)
    for n in range(ORDER):
        key = (key ^ chars[ends - n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        key ^= key >> np.uint64(29)
        if n >= LEAST_ORDER - 1:
            out.append((key >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    return out, lengths


def empty_counts() -> np.ndarray:
    """(model, order, slot): n-grams hashed into tables of a fixed size."""
    return np.zeros((3, ORDER - LEAST_ORDER + 1, 1 << TABLE_BITS), np.float32)


def add(counts: np.ndarray, texts: list[str], weights: np.ndarray | float = 1.0) -> None:
    """Count the n-grams of texts in the tables of one model, each as often as its weight says."""
    if texts:
        slots, lengths = grams(texts)
        each = np.repeat(np.broadcast_to(np.asarray(weights, np.float64), len(texts)), lengths)
        for n, at in enumerate(slots):
            counts[n] += np.bincount(at, each, minlength=1 << TABLE_BITS).astype(np.float32)


def seed_counts(filler: tuple[str, ...] = seeds.FILLER, notices: tuple[str, ...] = seeds.ERRORS + seeds.SCRIPTS, mentions: tuple[str, ...] = seeds.MENTIONS) -> np.ndarray:
    counts = empty_counts()
    own = lambda texts: sorted({plain(p) for s in texts for p in {s, *pieces(s)}})
    add(counts[FILLER], sorted({plain(p) for t in seeds.slot_texts() for p in pieces(t)}), SLOT_WEIGHT)
    add(counts[FILLER], own(filler), SEED_WEIGHT)
    add(counts[NOTICES], own(notices), SEED_WEIGHT)
    add(counts[PROSE], [plain(t) for t in mentions])
    return counts


class Model:
    """For either kind of residue, the log ratio of each n-gram's frequency to that in prose: tables of a fixed size.

    Whole n-grams are compared, not next characters: the latter are as predictable in natural text that holds some
    residue as in residue itself. An n-gram that neither side has counts 0. All is relative frequencies, so corpora
    of two million characters and more with the same texts in the same shares give the same model.
    """

    def __init__(self, seed: np.ndarray, corpus: np.ndarray):
        total = lambda counts: max(float(counts[..., 0, :].sum()), 1.0)
        share = FROM_CORPUS if corpus[:PROSE].any() else 0.0
        prose = (1 - MENTIONED) * np.maximum(corpus[PROSE] - 1, 0) / max(total(corpus[PROSE]), BACKGROUND) + MENTIONED * seed[PROSE] / total(seed[PROSE])
        residue = (1 - share) * seed[:PROSE] / total(seed[:PROSE]) + share * corpus[:PROSE] / total(corpus[:PROSE])
        self.tables = np.log((residue + UNSEEN) / (prose + UNSEEN)).astype(np.float32)

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, as given by `plain`, and either kind: (share in windows that look like residue, mean log ratio)."""
        slots, lengths = grams(texts)
        first = np.cumsum(lengths) - lengths
        text, at = np.repeat(np.arange(len(texts)), lengths), np.arange(lengths.sum())
        w = np.minimum(WINDOW, lengths)[text]
        fits = at + w <= (first + lengths)[text]
        shares, means = [], []
        for kind in (FILLER, NOTICES):
            ratio = np.mean([self.tables[kind, n][s] for n, s in enumerate(slots)], axis=0, dtype=np.float64)
            sums = np.concatenate([[0.0], np.cumsum(ratio)])
            hot = at[fits][(sums[(at + w)[fits]] - sums[at[fits]]) > WINDOW_RATIO * w[fits]]
            edges = np.bincount(hot, minlength=len(ratio) + 1).astype(np.int64) - np.bincount(hot + w[hot], minlength=len(ratio) + 1)
            lit = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
            shares.append((lit[first + lengths] - lit[first]) / lengths)
            means.append((sums[first + lengths] - sums[first]) / lengths)
        return np.array(shares), np.array(means)

    def kinds(self, texts: list[str], least: tuple[float, float] = PIECE_RATIO) -> np.ndarray:
        """The kind of each text: FILLER, NOTICES, or PROSE if it is no residue."""
        found = np.full(len(texts), PROSE)
        for lo in range(0, len(texts), 5000):
            part = texts[lo : lo + 5000]
            share, mean = self.measured(part)
            sizes = np.array([len(t) + 1 for t in part])
            slot = np.array(["\ue000" in t for t in part]).astype(np.int64)
            good = (share >= COVERAGE) & (mean >= np.array(least)[slot]) & (mean * sizes >= np.array(EVIDENCE)[slot])
            found[lo : lo + 5000] = np.where(good.any(axis=0), np.where(good, mean, -np.inf).argmax(axis=0), PROSE)
        worded = np.array([sum(map(str.isalpha, t)) > 1 or "\ue000" in t for t in texts], bool)
        return np.where(worded, found, PROSE)


def corpus_counts(documents: DataFrame, model: Model | None) -> np.ndarray:
    """Counts of the pieces of all documents, each for the model of the kind that `model` gives it; without one, as prose.

    A task adds up its documents and sends on only what isn't 0; sums are combined before the shuffle. What
    reaches the driver are tables of a fixed size, however many documents there are.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = empty_counts()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                seen = Counter(plain(p) for t in whole.column("text").slice(lo, 1000).to_pylist() if t for p in pieces(t))
                texts, times = list(seen), np.array(list(seen.values()), np.float64)
                kinds = sent.value.kinds(texts, MOVE_RATIO) if sent.value and texts else np.full(len(texts), PROSE)
                for kind in (FILLER, NOTICES, PROSE):
                    own = np.flatnonzero(kinds == kind)
                    add(counts[kind], [texts[i] for i in own], times[own])
        flat = counts.ravel()
        for part in np.array_split(np.flatnonzero(flat), 64):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(flat[part].astype(np.int64))], names=["slot", "n"])

    sums = documents.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    sent.destroy()
    out = empty_counts()
    out.ravel()[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def fit(documents: DataFrame, seed: np.ndarray | None = None) -> Model:
    """Fit on all documents, in two passes: against prose that still holds the corpus's residue, pieces that look like
    residue are told apart; then they count as residue and the others as prose."""
    seed = seed_counts() if seed is None else seed
    return Model(seed, corpus_counts(documents, Model(seed, corpus_counts(documents, None))))


def residue_pieces(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, chars, found, piece): of each document, its length, the characters of residue and the longest such piece.

    Every document is read whole. Null, empty and blank texts have none, and rows without an id are kept
    with a null id; repeated rows give repeated rows; other columns are not read; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                each = [pieces(t) for t in texts]
                forms = [[plain(p) for p in own] for own in each]
                known = sorted({f for own in forms for f in own})
                residue = {f for f, kind in zip(known, sent.value.kinds(known)) if kind != PROSE} if known else set()
                hits = [[p for p, f in zip(own, form) if f in residue] for own, form in zip(each, forms)]
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(map(len, h)) for h in hits], pa.int64()),
                    pa.array([max(h, key=len, default=None) for h in hits], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chars", "found", "piece"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id bigint, chars bigint, found bigint, piece string")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id): documents with a piece that never became or is no longer real content."""
    return residue_pieces(documents).where(F.col("found") > 0).select("doc_id")
