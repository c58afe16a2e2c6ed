"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents become pieces of at most `capacity` tokens. How pieces meet depends on nothing but how many there are of each
length, so the plan is made on that histogram, of at most `capacity` numbers whatever the size of the corpus: pieces
above a third of the capacity, of which a sequence holds two at most, are matched greedily, the longest with the longest
that fits; shorter ones go, longest first, into the tightest gap that takes them. The plan says which run of pieces of
each length goes to which run of sequences; numbering the pieces of each length, which is distributed, applies it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

CAPACITY = 2048
#: The id behind each document.
SEPARATOR = 0
ROWS_A_BATCH = 1_000


def pack_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place counts[n] pieces of each length n."""
    left = np.array(counts, dtype=np.int64)
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def place(length: int, number: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), number, sequence, offset))
        used[length] += number
        left[length] -= number

    def leave(gap: int, sequence: int, number: int) -> None:
        if gap > 0 and number > 0:
            if gap not in open_runs:
                open_runs[gap] = []
                insort(gaps, gap)
            open_runs[gap].append((sequence, number))

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            top = min(length, capacity - length)
            partners = np.flatnonzero(left[third + 1 : top + 1]) + third + 1 if top > third else []
            if len(partners) and partners[-1] == length and left[length] < 2:
                partners = partners[:-1]
            if not len(partners):
                number, gap = int(left[length]), capacity - length
                place(length, number, sequences, 0)
            else:
                other = int(partners[-1])
                number, gap = int(left[length] // 2 if other == length else min(left[length], left[other])), capacity - length - other
                place(length, number, sequences, 0)
                place(other, number, sequences, length)
            leave(gap, sequences, number)
            sequences += number
    for length in range(third, 0, -1):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                number, copies = (int(left[length]) // each, each) if left[length] >= each else (1, int(left[length]))
                for k in range(copies):
                    place(length, number, sequences, k * length)
                leave(capacity - copies * length, sequences, number)
                sequences += number
                continue
            gap = gaps[at]
            sequence, number = open_runs[gap].pop()
            take = min(number, int(left[length]))
            if take < number:
                open_runs[gap].append((sequence + take, number - take))
            if not open_runs[gap]:
                del open_runs[gap], gaps[at]
            place(length, take, sequence, capacity - gap)
            leave(gap - length, sequence, take)
    return runs


#: Fixed value: how the byte-level tokenizer cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with a run of white space as long as this is too much for the pattern's look-ahead.
LONG_RUN = re.compile(r"\s{5000}")


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it prints, else the next free letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in prints)}


class Encoder:
    """Token ids by a byte-level BPE file of the tokenizers library.

    In such a file the ids of merged tokens follow the order of the merges, so the vocabulary is a table of ranks; with it
    tiktoken gives the same ids (which the tests hold it to) in a fifth of the time.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        letters = _letters()
        added = self.slow.get_added_tokens_decoder()
        special = {t.content for t in added.values()}
        #: Tokens that the file adds to its vocabulary, which keep their id within a text; and whether texts can be cut at them.
        self.ids = {t.content: id_ for id_, t in added.items()}
        self.added = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cuts = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        ranks = {bytes(letters[c] for c in token): rank for token, rank in self.slow.get_vocab().items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids that the library gives with add_special_tokens=False."""
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        if not self.cuts:
            return self._slow(text)
        parts, at = [], 0
        for token in self.added.finditer(text):
            parts += [self._plain(text[at : token.start()]), np.array([self.ids[token.group()]], dtype=np.uint32)]
            at = token.end()
        return np.concatenate([*parts, self._plain(text[at:])])

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        return self._slow(text) if LONG_RUN.search(text) else self.fast.encode_to_numpy(text, disallowed_special=())


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for at in range(0, len(batch), ROWS_A_BATCH):
                part = batch.slice(at, ROWS_A_BATCH)
                rows: list[list] = [[], [], [], [], [], []]
                for k, text in enumerate(part.column(1)):
                    ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(SEPARATOR)).astype("<u4")
                    begin = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    for piece, (lo, hi) in enumerate(zip(begin, begin[1:], strict=False)):
                        for to, x in zip(rows, (k, piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())), strict=False):
                            to.append(x)
                        if with_ids:
                            rows[5].append(ids[lo:hi])
                columns = [part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(rows[5], pa.list_(pa.int64()))] if with_ids else []), names)

    return run


def _placed(plan, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            columns = [*kept, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    docs: doc_id, text (more columns are ignored). A document is the ids of its text and then id 0; one that is longer
    than `capacity` is cut into pieces of that length, of which the first may be shorter. Returns per piece: doc_id, piece (from 0), start, length,
    ids_crc32 (of little-endian unsigned 32-bit ids), ids if asked for, sequence_id, offset. Null texts are empty, and so a
    document of one id. Strings of the file's special tokens in a text become their ids, as they do in the library. A very long text
    is encoded whole, in one task, and cut. Rows without an id are packed as any others; repeated rows as often as they
    come; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer_path, capacity, with_ids), schema))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, number in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = number
    runs = np.array(sorted(pack_plan(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    plan = docs.sparkSession.sparkContext.broadcast((runs[:, 0] << 48 | runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    ranked = ranked.select(*pieces.columns, "rank")
    return ranked.mapInArrow(_placed(plan, capacity), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces that carry them; a sequence never holds more than the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
