"""Importance resampling towards a target distribution over hashed runs of words.

A run of one to three words is a feature, known by its CRC32 alone, modulo a number of buckets. Each task keeps the features
of a block of texts as a trie: a node is a run of words, known by its parent and its last word; it holds how often the run
occurs and the CRC state of its bytes, which its children continue. The counts of all nodes are added up by bucket, so a task
sends no more than one row a bucket. For scoring, the tries are grown again, each node gets its bucket's gain, and a document's
words walk the paths. The nodes of a level lie in arrays.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, released, stored

BUCKETS = 10_000
#: Words of a run at most.
LONGEST = 3
#: Documents of fewer words are scored but never drawn.
LEAST_WORDS = 20
#: Share of the documents drawn: 5 in 100.
SHARE = (5, 100)
SEED = 42
#: Words of a trie: longer texts are walked in pieces, short ones share a trie.
BLOCK_WORDS = 1 << 19

#: A to Z in lower case; digits, a to z and all bytes of other characters as they are; the rest ends a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Up to this many bytes, a CRC state is moved on by tables; longer words continue it byte by byte.
_REACH = 64


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k = b of a CRC state comes to behind n bytes more."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    out = np.empty((_REACH + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    for n in range(1, _REACH + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ one[out[n - 1] & np.uint32(255)]
    return out


_SHIFTS = _shifts()


def continued(states: np.ndarray, words: np.ndarray, spaced: list[bytes], sizes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The CRC states of runs followed by a space and a word. spaced: those by number, with their sizes and their own CRCs."""
    near = np.minimum(sizes[words], _REACH)
    out = tails[words]
    for k in range(4):
        out = out ^ _SHIFTS[near, k, (states >> np.uint32(8 * k)) & np.uint32(255)]
    for at in np.flatnonzero(sizes[words] > _REACH):
        out[at] = zlib.crc32(spaced[words[at]], int(states[at]))
    return out


def pieces(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(n, words): the words of a folded text in lists of at most BLOCK_WORDS, behind the last n words of the list before."""
    context: list[bytes] = []
    while True:
        words = text.split(None, BLOCK_WORDS)
        text = words.pop() if len(words) > BLOCK_WORDS else b""
        yield len(context), context + words
        if not text:
            return
        context = (context + words)[1 - LONGEST :]


class Trie:
    """The runs of words of some pieces of texts, level by level.

    Of level k: `states[k]` and `counts[k]` of its nodes, and `paths[k]`, the node that each word of the pieces ends (-1: none).
    Words that a piece only repeats from the piece before end no run of their own.
    """

    def __init__(self, block: list[tuple[int, list[bytes]]]):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        ids = np.array(list(map(number.__getitem__, chain.from_iterable(words for _, words in block))), dtype=np.int64)
        sizes = np.array([len(words) for _, words in block], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        before = np.arange(len(ids)) - np.repeat(start, sizes)  # words of the piece before each
        self.own = before >= np.repeat([n for n, _ in block], sizes)
        spaced = [b" " + w for w in number]
        length = np.array([len(w) for w in spaced], dtype=np.int64)
        tails = np.array([zlib.crc32(w) for w in spaced], dtype=np.uint32)
        self.states = [np.array([zlib.crc32(w) for w in number], dtype=np.uint32)]
        self.counts = [np.bincount(ids[self.own], minlength=len(number))]
        self.paths = [ids]
        for level in range(1, LONGEST):
            at = np.flatnonzero(before >= level)
            nodes, found = np.unique(self.paths[-1][at - 1] * len(number) + ids[at], return_inverse=True)
            parents, words = np.divmod(nodes, max(len(number), 1))
            self.states.append(continued(self.states[-1][parents], words, spaced, length, tails))
            self.counts.append(np.bincount(found[self.own[at]], minlength=len(nodes)))
            path = np.full(len(ids), -1, dtype=np.int64)
            path[at] = found
            self.paths.append(path)

    def totals(self, buckets: int) -> np.ndarray:
        """How many features fall into each bucket."""
        out = np.zeros(buckets, dtype=np.int64)
        for states, counts in zip(self.states, self.counts, strict=True):
            np.add.at(out, states % np.uint32(buckets), counts)
        return out

    def walked(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: how many runs it ends, and the sum of their gains."""
        runs, sums = np.zeros(len(self.own), dtype=np.int64), np.zeros(len(self.own), dtype=np.int64)
        for states, path in zip(self.states, self.paths, strict=True):
            attached = gains[states % np.uint32(len(gains))]
            at = self.own & (path >= 0)
            runs += at
            sums[at] += attached[path[at]]
        return runs, sums


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[tuple[int, list[bytes]]]]]:
    """(rows, pieces) of about BLOCK_WORDS words: the row of each piece."""
    rows, block, size = [], [], 0
    for row, text in enumerate(texts):
        for n, words in pieces((text or b"").translate(FOLD)):
            if block and size + len(words) > BLOCK_WORDS:
                yield rows, block
                rows, block, size = [], [], 0
            if len(words) > n:
                rows.append(row)
                block.append((n, words))
                size += len(words)
    if block:
        yield rows, block


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (a column `text`) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in released(batches):
            for _, block in _blocks(batch.column(0).to_pylist()):
                totals += Trie(block).totals(buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket at most
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much likelier a bucket is in the target, each bucket counted once more."""
    whole, wanted = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratios = (target + 1.0) * whole / ((source + 1.0) * wanted)
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variable that depends on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return math.floor(-1000 * math.log(-math.log((int.from_bytes(digest[:4], "big") + 0.5) / 4294967296)))


def _scorer(gains: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            words, runs, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for rows, block in _blocks(batch.column(1).to_pylist()):
                trie = Trie(block)
                ended, sums = trie.walked(gains)
                of = np.repeat(np.array(rows), [len(w) for _, w in block])
                np.add.at(words, of, trie.own)
                np.add.at(runs, of, ended)
                np.add.at(weight, of, sums)
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, runs, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Documents weighted by how much their runs of words look like the target's, and a sample drawn by these weights.

    docs: doc_id, text; target: text (more columns are ignored, whatever their names). Words are runs of digits, letters a to z (A
    to Z are folded) and characters beyond ASCII. Returns per row of docs: doc_id, n_features, weight (the sum of the gains of all
    its features), score (weight and a Gumbel variable of the id), rank (1 for the highest score; null where not drawn). Of the
    rows with at least `least_words` words the given share is drawn, rounded down: the highest scores, ties to the smaller
    doc_id. Null, empty and wordless texts have no features, weight 0 and are not drawn. A null doc_id draws as an empty text would
    and comes behind all ids; rows that repeat an id are documents of their own with one Gumbel variable, ties to fewer
    features. A very long text is walked in pieces. An empty target is uniform over the buckets; an empty table gives an
    empty result.
    """
    gains = bucket_gains(bucket_totals(docs, buckets), bucket_totals(target, buckets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    scored = stored(texts.mapInArrow(_scorer(gains, seed), "doc_id long, n_words long, n_features long, weight long, score long"))
    enough = F.col("n_words") >= least_words
    line = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = in_order(scored.filter(enough), line, [])
    drawn = share[0] * scored.filter(enough).count() // share[1]
    rank = F.when(F.col("__number") < drawn, F.col("__number") + 1).cast("long")
    ranked = placed.withColumn("rank", rank).unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")
