"""Reading level of each document by a familiar-word formula.

The formula weighs, for every sentence, the share of its words outside the high-frequency list (words in many of
the corpus's documents), the average sentence length of its document, its own length, and the shares of
its words outside graded lists. Cut-points between levels are fitted on rated documents. A document has the level of
most of its prose.

The graded lists are document frequencies as well: a word is familiar at level k if, among the prose of that level
or easier, it is in at least half as large a share of documents as at its best level. They start from the rated
documents and are counted again over all documents, sentence by sentence, so words no rated document holds get
their grade from the company they keep.

Words are kept as 64-bit hashes and split once; all passes after that are array arithmetic over whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.session import materialize, spread

LEVELS = 4
#: Rated documents used for fitting (the only sample here) and the words kept: those in most documents. All others
#: are outside every list.
MAX_RATED, MAX_WORDS = 20_000, 60_000
#: The high-frequency list holds the words in at least this share of the documents with prose.
FREQUENT = 0.01
#: A word needs this share of its best level's document frequency to be familiar at a level.
FAMILIAR = 0.5
#: Sentences of fewer words say nothing about their level, and are no prose.
MIN_WORDS = 3
#: Longer sentences vote in pieces of nearly equal size, so that a text without full stops has more than one vote.
PIECE = 80
#: Steps of the fit's bins: shares and logarithms of lengths. The fit sees each bin's means.
SHARE_STEP, LENGTH_STEP = 0.05, 0.5
#: Ridge of the fit per weight. The last three features are nearly the same for all of a document's sentences, so a few
#: rated documents must not be enough to make them decide.
RIDGE = (0.0, 0.01, 1.0, 1.0, 1.0)

_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_NO_PROSE = re.compile(
    r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d\S*[ \t]+(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b[^\n]*?(?:exit=\d+|$)"  # log lines
    r"|^[ \t]*\|[^\n]*\|[ \t]*$|^[ \t]*[|+][-+|: ]{3,}$"  # table rows
    r"|\b[0-9a-fA-F]{32,}\b(?:[ \t]+[\w.-]+(?=[ \t]*(?:$|-[ \t]+[0-9a-f]{32})))?"  # hashes, with the word a listing gives each
    r"|\bsha(?:1|256|384|512)-[\w+/=-]{20,}",
    re.M,
)
_HEAD = re.compile(r"^[ \t>]*(?:[-*+][ \t]+|\d+[.)][ \t]+)*(?:#{1,6}[ \t]+\S+(?=[ \t]{2}|[ \t]*$))?", re.M)
_TICKS = re.compile(r"`[^`\n]*`")
_CODE = regex.compile(r"[/_=<>{}|\\@`]|\w[.]\w|\p{L}\p{Ll}\p{Lu}|\b[0-9a-f]*\d[0-9a-f]{6,}\b")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’\-]\p{L}[\p{L}\p{M}]*)*")
#: What a match of _NO_PROSE must hold, for texts that hold none of it.
_LOG_WORDS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
_LONG_HEX = re.compile(r"[0-9a-fA-F]{32}")
_STOP = re.compile(r"(?<=[.!?;:。！？])[\s)\"'»”]+|\n[ \t]*\n|\n(?=[ \t>]*(?:[-*+]|\d+[.)]|#)[ \t])")


@lru_cache(200_000)
def _words(token: str) -> tuple[str, ...]:
    """The words of what stands between blanks, lower case; none if it looks like code, a path or a hash."""
    return () if _CODE.search(token) else tuple(w.lower() for w in _WORD.findall(token))


def word_id(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(200_000)
def _ids(token: str) -> tuple[int, ...]:
    return tuple(map(word_id, _words(token)))


def _sentences(text: str | None, words) -> list[list]:
    if not text:
        return []
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n"))
    if "|" in text or "+" in text or "sha" in text or any(w in text for w in _LOG_WORDS) or _LONG_HEX.search(text):
        text = _NO_PROSE.sub("\n\n", text)
    found = []
    for piece in _STOP.split(text):
        if "#" in piece or ">" in piece:  # other list marks hold no words
            piece = _HEAD.sub(" ", piece)
        if "`" in piece:
            piece = _TICKS.sub(" ", piece)
        sentence = [w for token in piece.split() for w in words(token)]
        if len(sentence) >= MIN_WORDS:
            found.append(sentence)
    return found


def sentences(text: str | None) -> list[str]:
    """The sentences of running prose, as lower-case words with single blanks; code, logs, tables and listings are left out."""
    return [" ".join(s) for s in _sentences(text, _words)]


PROSE = "doc_id long, ids array<long>, sizes array<int>, lengths array<int>"


def pieces_of(length: int) -> list[int]:
    """The sizes of the pieces of a sentence: as few as there must be, nearly equal."""
    n = -(-length // PIECE)
    return [length // n + (i < length % n) for i in range(n)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, lengths = [], [], []
        for t in batch.column(1):
            found = _sentences(t.as_py(), _ids)
            parts = [(n, len(s)) for s in found for n in pieces_of(len(s))]
            ids.append([w for s in found for w in s])
            sizes.append([n for n, _ in parts])
            lengths.append([n for _, n in parts])
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (ids, sizes, lengths), kinds)], names=["doc_id", "ids", "sizes", "lengths"])


def prose(documents: DataFrame) -> DataFrame:
    """The documents with running prose: the words' ids in order, the sizes of its pieces and the lengths of their sentences."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_cut, PROSE).where("size(ids) > 0")


class Batch:
    """Arrays over the words and pieces of a batch of documents: ids, size and length per piece, document per piece."""

    def __init__(self, batch: pa.RecordBatch):
        ids, sizes, lengths = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "sizes", "lengths"))
        self.n = batch.num_rows
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)
        self.size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.length = lengths.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.doc = np.repeat(np.arange(self.n), sizes.value_lengths().to_numpy(zero_copy_only=False))
        self.end = np.cumsum(self.size)

    def count(self, mark: np.ndarray) -> np.ndarray:
        """Marked words per piece."""
        total = np.concatenate([[0], np.cumsum(mark)])
        return total[self.end] - total[self.end - self.size]

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, self.n)


#: Features of a piece: share outside the graded list, share outside the high-frequency list, logarithms of the
#: sentence's length and of the document's average sentence length.
FEATURES = 4


class Formula:
    """Words (sorted ids) with their grades (0: none) and whether they are frequent; weights per boundary: constant, FEATURES.

    rest: the grade of words outside the list; LEVELS, outside all lists, where the list was too short for all words.
    """

    def __init__(self, words: np.ndarray, grades: np.ndarray, frequent: np.ndarray, rest: int = 0, weights: np.ndarray | None = None):
        self.words, self.grades, self.frequent, self.rest = words, grades, frequent, rest
        self.weights = weights if weights is not None else np.array([[-2.0, 10.0, 0.0, 0.0, 0.0]] * (LEVELS - 1))

    def place(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the batch's words in the list, and which of them are in it."""
        if not len(self.words):
            return np.zeros(len(b.ids), int), np.zeros(len(b.ids), bool)
        at = np.minimum(np.searchsorted(self.words, b.ids), len(self.words) - 1)
        return at, self.words[at] == b.ids

    def features(self, b: Batch, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per boundary and piece the features; which pieces have a graded word."""
        none = np.zeros(len(at), bool)
        g = np.where(hit, self.grades[at], self.rest) if len(self.words) else none.astype(int)
        known = b.count(g > 0)
        some = np.maximum(known, 1)
        unfamiliar = 1 - b.count(hit & self.frequent[at] if len(self.words) else none) / np.maximum(b.size, 1)
        average = b.per_document(b.size) / np.maximum(b.per_document(b.size / b.length), 1e-9)
        both = [unfamiliar, np.log(b.length), np.log(np.maximum(average, 1))[b.doc]]
        return np.stack([np.stack([b.count(g > k) / some, *both], 1) for k in range(1, LEVELS)]), known > 0

    def levels(self, b: Batch, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """1 to 4 per piece, 0 if no word of it is graded."""
        x, known = self.features(b, at, hit)
        above = [x[k] @ self.weights[k, 1:] + self.weights[k, 0] > 0 for k in range(LEVELS - 1)]
        return np.where(known, 1 + np.sum(above, 0), 0)

    def documents(self, b: Batch) -> np.ndarray:
        """The level of most prose, by words; ties go to the easier; 2, the usual, if nothing is known."""
        level = self.levels(b, *self.place(b))
        total = np.stack([b.per_document(np.where(level == k, b.size, 0)) for k in range(1, LEVELS + 1)])
        return np.where(total.max(0) > 0, total.argmax(0) + 1, 2)

    def fit(self, bins: dict[int, np.ndarray], rounds: int = 30) -> None:
        """Logistic fit of every boundary by Newton steps with a small ridge; bins: rows of weight, share above, feature means."""
        for k, rows in bins.items():
            w, above = rows[:, 0], rows[:, 1]
            if above.min() == above.max():
                continue
            a = np.column_stack([np.ones(len(rows)), rows[:, 2:]])
            ridge = np.diag(RIDGE)
            z = np.zeros(FEATURES + 1)
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
                h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge + 1e-6 * np.eye(FEATURES + 1)
                z = z - np.linalg.solve(h, a.T @ (w * (p - above)) + ridge @ z)
            self.weights[k] = z


def grade(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Grades from document frequencies per level (rows: words): the lowest level at which a word is familiar, 0 without any."""
    rates = counts / np.maximum(1.0, documents)
    best = rates.max(1, initial=0)
    return np.where(best > 0, (rates >= FAMILIAR * best[:, None]).argmax(1) + 1, 0).astype(np.int8)


def rated_levels(ratings: DataFrame) -> DataFrame:
    """doc_id and level: the median over raters of each rater's last rating within 1 to 4, halves rounded to the even level."""
    good = ratings.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, LEVELS))
    last = good.groupBy("doc_id", "rater").agg(F.max(F.struct("rated_at", "reading_level")).alias("r"))
    return last.groupBy("doc_id").agg(F.bround(F.percentile("r.reading_level", F.lit(0.5))).cast("int").alias("level"))


COUNTS = "id long, level int, n long"


def _emit(ids: np.ndarray, level: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(level, pa.int32()), pa.array(n, pa.int64())], names=["id", "level", "n"])


def _per_level(doc: np.ndarray, level: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, level, documents that hold the word at the level)."""
    cells = (LEVELS + 1) * width
    cell = level * width + word
    if len(doc) == 0 or (doc[-1] + 1) * cells > 256 * len(doc):  # few words for so wide a list: sort them
        per = np.bincount(np.unique(doc * cells + cell) % cells)
    else:  # mark them, so many documents at a time as fit in 64 MB
        per, step = np.zeros(cells, np.int64), max(1, (64 << 20) // cells)
        for first in range(0, int(doc[-1]) + 1, step):
            a, b = np.searchsorted(doc, [first, first + step])
            marks = np.zeros((step, cells), bool)
            marks[doc[a:b] - first, cell[a:b]] = True
            per += np.count_nonzero(marks, axis=0)
    at = np.flatnonzero(per)
    return at % width, at // width, per[at]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies: of all documents as level 0, of rated ones at their level as well. Id null counts documents."""
    for batch in batches:
        b = Batch(batch)
        rated = np.array([x or 0 for x in batch.column(batch.schema.get_field_index("level")).to_pylist()], dtype=np.int64)
        ids, word = np.unique(b.ids, return_inverse=True)
        doc = np.repeat(b.doc, b.size)
        for level, keep in ((np.zeros(b.n, np.int64), slice(None)), (rated, rated[doc] > 0)):
            w, k, n = _per_level(doc[keep], level[doc[keep]], word[keep], len(ids))
            yield _emit(ids[w], k, n)
        held = np.bincount(rated, minlength=LEVELS + 1)
        held[0] = b.n
        yield pa.RecordBatch.from_arrays([pa.nulls(LEVELS + 1, pa.int64()), pa.array(range(LEVELS + 1), pa.int32()), pa.array(held, pa.int64())], names=["id", "level", "n"])


def _count_levels(formula: Formula):
    """Document frequencies of the list's words per level, every piece at the level the formula gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            at, hit = formula.place(b)
            level = formula.levels(b, at, hit)
            keep = hit & (np.repeat(level, b.size) > 0)
            w, k, n = _per_level(np.repeat(b.doc, b.size)[keep], np.repeat(level, b.size)[keep], at[keep], max(1, len(formula.words)))
            yield _emit(formula.words[w], k, n)
            held = np.bincount(np.unique(b.doc * (LEVELS + 1) + level) % (LEVELS + 1), minlength=LEVELS + 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(LEVELS, pa.int64()), pa.array(range(1, LEVELS + 1), pa.int32()), pa.array(held[1:], pa.int64())], names=["id", "level", "n"])

    return run


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in most documents (MAX_WORDS and one more, by id), their documents per level 0 to 4, and all documents per level."""
    per = [F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(LEVELS + 1)]
    counts = rows.groupBy("id").agg(*per).withColumn("most", F.greatest(*[F.col(f"n{k}") for k in range(LEVELS + 1)]))
    got = counts.orderBy(F.col("id").isNotNull(), F.desc("most"), "id").limit(MAX_WORDS + 2).toArrow()  # the list's length bounds this
    n = np.stack([got.column(f"n{k}").to_numpy() for k in range(LEVELS + 1)], 1).astype(float)
    ids = got.column("id").combine_chunks()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    documents = n[none].sum(0) if none.any() else np.zeros(LEVELS + 1)
    words = ids.filter(pa.array(~none)).to_numpy(zero_copy_only=False)
    return words, n[~none], documents


def _bins(formula: Formula, rated: DataFrame) -> dict[int, np.ndarray]:
    """The rated documents' pieces as bins per boundary, each document of weight 1; their number is bounded by the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            level = np.array(batch.column(batch.schema.get_field_index("level")).to_pylist())[b.doc]
            x, known = formula.features(b, *formula.place(b))
            own = b.per_document(known)[b.doc]
            for k in range(LEVELS - 1):
                v, above = x[k][known], (level > k + 1)[known]
                steps = np.rint(v / np.array([SHARE_STEP, SHARE_STEP, LENGTH_STEP, LENGTH_STEP])).astype(int)
                code = [",".join(map(str, c)) for c in steps]
                columns = [pa.array(np.full(len(v), k), pa.int32()), pa.array(code, pa.string()), pa.array(above.astype(int), pa.int32()), pa.array(1 / own[known])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v[:, i]) for i in range(FEATURES))], names=["k", "code", "above", "w", *(f"x{i}" for i in range(FEATURES))])

    rows = rated.mapInArrow(run, "k int, code string, above int, w double, " + ", ".join(f"x{i} double" for i in range(FEATURES)))
    means = [(F.sum(F.col("w") * F.col(f"x{i}")) / F.sum("w")).alias(f"x{i}") for i in range(FEATURES)]
    got = rows.groupBy("k", "code", "above").agg(F.sum("w").alias("w"), *means).orderBy("k", "code", "above").toArrow()
    table = np.column_stack([got.column(c).to_numpy().astype(float) for c in ("k", "w", "above", *(f"x{i}" for i in range(FEATURES)))]) if got.num_rows else np.zeros((0, 3 + FEATURES))
    return {k: table[table[:, 0] == k][:, 1:] for k in range(LEVELS - 1) if (table[:, 0] == k).any()}


def fit_formula(found: DataFrame, ratings: DataFrame, rounds: int = 2) -> Formula:
    """The formula for a corpus: ``found`` as of prose(), materialized; ``rounds`` recounts over all documents."""
    picked = rated_levels(ratings).join(found.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_RATED)
    picked = materialize(picked)
    marked = found.join(F.broadcast(picked), "doc_id", "left")  # at most MAX_RATED rows of two numbers
    words, n, documents = _table(marked.mapInArrow(_count_words, COUNTS))
    rest = LEVELS if len(words) > MAX_WORDS else 0
    words, n = words[:MAX_WORDS], n[:MAX_WORDS]
    order = np.argsort(words)
    words, n = words[order], n[order]
    frequent = n[:, 0] >= FREQUENT * max(1.0, documents[0])
    formula = Formula(words, grade(n[:, 1:], documents[1:]), frequent, rest)
    rated = materialize(marked.where("level is not null"))
    formula.fit(_bins(formula, rated))
    for _ in range(rounds):
        ids, n, documents = _table(found.mapInArrow(_count_levels(formula), COUNTS))
        counts = np.zeros((len(words), LEVELS))
        if len(ids):
            counts[np.searchsorted(words, ids)] = n[:, 1:]
        formula = Formula(words, grade(counts, documents[1:]), frequent, rest, formula.weights)
        formula.fit(_bins(formula, rated))
    return formula


def reading_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """doc_id and reading_level (1 to 4) of each document with running prose.

    ``documents``: doc_id, text; ``ratings``: doc_id, rater, reading_level, rated_at. Null, empty and blank
    texts, and texts of code, logs, tables, listings or symbols only, give no row. Without ratings every word
    is unknown and each document gets the usual level 2. Repeated rows give repeated results; further columns
    are ignored; whole texts count, whatever their length.
    """
    found = materialize(prose(documents))
    formula = fit_formula(found, ratings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(formula.documents(Batch(batch)), pa.int32())], names=["doc_id", "reading_level"])

    return found.mapInArrow(run, "doc_id long, reading_level int")
