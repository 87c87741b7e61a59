"""Encoding of a corpus with a public byte-level BPE vocabulary.

A pair occurrence index over all distinct words of a block: every adjacent pair is mapped to all positions
at which it occurs, active ranks are taken in ascending order, a rank's positions are merged from left to
right, and only the lists of the pairs beside a merge are updated. Work is proportional to the merges made,
also for a single word of a million bytes.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.session import spread

#: Where the vocabulary files are.
TOKENIZERS = os.environ.get("REFWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Characters of text whose words are indexed together; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Fixed value: how byte-level BPE cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PairIndexEncoder:
    """Encodes blocks of texts. ``known`` keeps the ids of words met before, up to ``keep`` words."""

    def __init__(self, folder: str = TOKENIZERS, name: str = VOCABULARY, keep: int = 400_000):
        import regex

        with open(os.path.join(folder, name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        self.byte_ids = [vocabulary[x] for x in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.pairs = [None] * len(model["merges"])
        for pair, (rank, _) in self.merges.items():
            self.pairs[rank] = pair
        self.words = regex.compile(WORDS).findall
        self.known: dict[str, list[int]] = {}
        self.keep = keep

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of each of some distinct words."""
        token: list[int] = []
        start = []
        for w in words:
            start.append(len(token))
            token.extend(map(self.byte_ids.__getitem__, w.encode("utf-8")))
            token.append(-1)  # a wall between words
        n = len(token)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            if (m := merges.get((token[i], token[i + 1]))) is not None:
                where.setdefault(m[0], []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b = self.pairs[rank]
            new = merges[a, b][1]
            for i in sorted(where.pop(rank)):
                j = right[i]
                if token[i] != a or j >= n or token[j] != b:
                    continue  # changed since it was listed
                k = right[j]
                token[i], token[j] = new, -2
                right[i] = k
                if k < n:
                    left[k] = i
                    if (m := merges.get((new, token[k]))) is not None:
                        if m[0] not in where:
                            where[m[0]] = []
                            heapq.heappush(active, m[0])
                        where[m[0]].append(i)
                h = left[i]
                if h >= 0 and (m := merges.get((token[h], new))) is not None:
                    if m[0] not in where:
                        where[m[0]] = []
                        heapq.heappush(active, m[0])
                    where[m[0]].append(h)
        out = {}
        for w, i in zip(words, start):
            ids = []
            while token[i] != -1:
                ids.append(token[i])
                i = right[i]
            out[w] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words(t) if t else [] for t in texts]
        fresh = {w for words in cut for w in words} - self.known.keys()
        if len(self.known) + len(fresh) > self.keep:
            self.known = {}
            fresh = {w for words in cut for w in words}
        self.known |= self.learn(list(fresh))
        known = self.known
        return [[i for w in words for i in known[w]] for words in cut]


def blocks(texts: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list]]:
    """Slices of a batch of texts, (offset, texts), each of about ``limit`` characters or of one text."""
    first, total, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t.as_py()
        if held and total + len(t or "") > limit:
            yield first, held
            first, total, held = i, 0, []
        held.append(t)
        total += len(t or "")
    if held:
        yield first, held


_encoders: dict[tuple[str, str], PairIndexEncoder] = {}


def _worker_encoder(folder: str, name: str) -> PairIndexEncoder:
    """This process's encoder: a Python worker reads the vocabulary once, not once a task. The file comes with the job where
    the driver has sent it, else from ``folder``."""
    from pyspark import SparkFiles

    sent = os.path.join(SparkFiles.getRootDirectory(), name) if SparkFiles._root_directory else ""
    where = os.path.dirname(sent) if sent and os.path.exists(sent) else folder
    if (where, name) not in _encoders:
        _encoders[where, name] = PairIndexEncoder(where, name)
    return _encoders[where, name]


def _encoder(folder: str, name: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(folder, name)
        for batch in batches:
            for first, texts in blocks(batch.column(batch.num_columns - 1)):
                ids = encoder.encode(texts)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if lengths_only:
                    result = pa.array(sizes)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    result = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                kept = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], result], names=[*batch.schema.names[:-1], "out"])

    return run


def encode(df: DataFrame, text: str, keep: list[str], out: str = "ids", lengths_only: bool = False, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and the token ids (array<int>) of ``text``, or their number, one row per row.

    No special tokens are added, and text that looks like one is ordinary text. Null and empty texts have an
    empty list (number 0). Any length and any Unicode; repeated rows give repeated results; an empty table
    gives no rows. The columns kept may have any name but the text's own is encoded whatever it is called.
    """
    if os.path.exists(os.path.join(folder, name)):
        df.sparkSession.sparkContext.addFile(os.path.join(folder, name))  # executors need not have the folder
    picked = df.select(*[F.col(c) for c in keep], F.col(text).alias("out"))
    kind = "long" if lengths_only else "array<int>"
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    rows = spread(picked).mapInArrow(_encoder(folder, name, lengths_only), f"{schema}, `out` {kind}")
    return rows.withColumnRenamed("out", out)


def n_tokens(df: DataFrame, text: str, keep: list[str], **named) -> DataFrame:
    return encode(df, text, keep, out="n_tokens", lengths_only=True, **named)


