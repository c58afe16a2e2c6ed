"""Runs of words that repeat with a period, found with whole texts as bits of large integers.

The words of some texts get numbers, and each bit of these numbers over all words is one large integer, a plane. At a lag, a plane
XOR itself shifted by the lag has a 1 where two words differ in that bit; the OR over all planes marks the words that
differ from those a lag behind. A run with that period is a long stretch of words that don't: AND with itself shifted, by
1, 2, 4 and so on, leaves ones only where such a stretch begins. Texts of similar length lie side by side in the same
integers, parted by words that occur nowhere else, which no run can cross.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored, word_count

#: A run has at least this many words, and two periods.
LEAST = 12
#: Words that share integers.
GROUP_WORDS = 1 << 14
#: The planes of a first look: where even these differ too often, the others aren't needed.
FIRST_PLANES = 3
#: Texts of more bytes are searched by several tasks, each taking some of the lags.
LONG_BYTES = 1 << 20
#: Words times lags of such a task.
WORK = 1 << 33
#: Bytes of texts that are held as words at a time.
SLICE_BYTES = 1 << 22

Run = tuple[int, int, int]  # start, length, period
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a periodic end in a tenth of the documents, as their ids say; none without an id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers, each text followed by a number of its own."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = [np.array(list(map(number.__getitem__, words)), dtype=np.int64) for words in texts]
    return np.concatenate([part for k, own in enumerate(ids) for part in (own, [len(number) + k])])


def _planes(ids: np.ndarray) -> list[int]:
    return [int.from_bytes(np.packbits((ids >> b) & 1 == 1, bitorder="little").tobytes(), "little") for b in range(int(ids.max()).bit_length() or 1)]


def _beginnings(equal: int, need: int) -> int:
    """Ones where `need` ones in a row begin."""
    have = 1
    while equal and 2 * have <= need:
        equal &= equal >> have
        have *= 2
    return equal & (equal >> (need - have)) if have < need else equal


def _places(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), dtype=np.uint8), bitorder="little"))


def periodic(ids: np.ndarray, lags: range) -> dict[tuple[int, int], int]:
    """{(start, end): period} of the runs whose period is among the lags, and the least of them.

    A stretch that repeats at a lag and is twice as long has a smallest period that divides the lag (Fine and Wilf, 1965), and is as
    long as the run with that period; so of equal stretches the first lag counts.
    """
    planes, n = _planes(ids), len(ids)
    ones, found = (1 << n) - 1, {}
    for lag in lags:
        need = max(lag, LEAST - lag)
        if n - lag < need:
            break
        whole, differ = ones >> lag, 0
        for k, plane in enumerate(planes):
            differ |= plane ^ (plane >> lag)
            if k == FIRST_PLANES - 1 and not _beginnings(whole ^ (differ & whole), need):
                break
        else:
            begins = _beginnings(whole ^ (differ & whole), need)
            if begins:
                first, last = begins ^ (begins & (begins << 1)), begins ^ (begins & (begins >> 1))
                for span in zip(_places(first).tolist(), (_places(last) + (need + lag)).tolist(), strict=True):
                    found.setdefault(span, lag)
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    order = sorted((k for k, words in enumerate(texts) if len(words) >= LEAST), key=lambda k: len(texts[k]))
    group: list[int] = []
    for place, k in enumerate(order):
        group.append(k)
        if place + 1 == len(order) or sum(len(texts[i]) for i in (*group, order[place + 1])) > GROUP_WORDS:
            sizes = np.array([len(texts[i]) + 1 for i in group])
            starts = np.cumsum(sizes) - sizes
            for (start, end), period in periodic(_numbers([texts[i] for i in group]), range(1, len(texts[k]) // 2 + 1)).items():
                at = int(np.searchsorted(starts, start, side="right")) - 1
                out[group[at]].append((start - int(starts[at]), end - start, period))
            group = []
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def _described(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    exponent = 1000 * length // period if runs else None
    return doc_id, len(runs), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


_ARROW = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in SCHEMA.split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of their column text."""
    for batch in released(batches):
        texts = batch.column(batch.schema.get_field_index("text"))
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(row, end - row)
            row = end


def _words(batch: pa.RecordBatch, plant: bool) -> list[list[bytes]]:
    """The words of the batch's columns doc_id and text; bytes.split() parts at the six bytes that end a word."""
    ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
    return [planted(words, i) if plant else words for i, words in zip(ids, ((t or b"").split() for t in texts), strict=True)]


def periodic_runs(docs: DataFrame, plant: bool = True, long_bytes: int = LONG_BYTES, work: int = WORK) -> DataFrame:
    """The periodic runs of each text's words.

    docs: doc_id, text (more columns are ignored, whatever their names). A run is a stretch of words with smallest period q and
    length of at least LEAST and 2 q that no neighbouring word extends. plant: give a tenth of the documents a periodic end first
    (see planted). Returns per row: doc_id, n_runs; start, length, period and exponent_milli (1000 length / period, rounded down)
    of the longest run, ties to the smaller start and then period, null without runs; runs_sha256 of all runs and
    collapsed_sha256 of the words that stay once all runs are cut to one period. Null, empty and wordless texts have no run; a
    null doc_id plants nothing; repeated rows are answered each; an empty table gives an empty result. A text of more than
    `long_bytes` is searched by several tasks, a range of lags each; the work grows with the square of a text's length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = _words(batch, plant)
            found = [_described(*row) for row in zip(batch.column(0).to_pylist(), words, runs_of(words), strict=True)]
            # A long text is left for later, and known by its missing digests.
            found = [(row[0], 0, *[None] * 6) if later else row for row, later in zip(found, batch.column(2).to_pylist(), strict=True)]
            yield _batch(found)

    first = stored(rows.select("doc_id", F.when(~long, F.col("text")).alias("text"), long.alias("later")).mapInArrow(whole, SCHEMA))
    if first.filter("runs_sha256 is null").isEmpty():
        return first

    def some_lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for row, words, lo, hi in zip(batch.column(0).to_pylist(), _words(batch, plant), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = periodic(_numbers([words]), range(lo, hi))
                spans = [(row, start, end, period) for (start, end), period in found.items()]
                names = ["row", "start", "end", "period"]
                yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], pa.int64()) for k in range(4)], names)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            runs = [sorted(((r["start"], r["end"] - r["start"], r["period"]) for r in found or ()), key=lambda run: (run[0], run[2])) for found in batch.column(2).to_pylist()]
            yield _batch([_described(*row) for row in zip(batch.column(0).to_pylist(), _words(batch, plant), runs, strict=True)])

    later = stored(rows.filter(long).withColumn("row", F.monotonically_increasing_id()).withColumn("n", word_count(F.col("text").cast("string"))))
    lags = F.greatest(F.lit(1), F.floor(F.lit(work) / F.greatest("n", F.lit(1)))).cast("long")
    lo = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("long"), lags))
    parts = later.select("row", "doc_id", "text", "n", lags.alias("lags"), lo.alias("lo"))
    parts = parts.repartition(F.col("row"), F.col("lo")).select("row", "doc_id", "text", "lo", F.least(F.col("lo") + F.col("lags"), F.floor(F.col("n") / 2) + 1).alias("hi"))
    spans = parts.mapInArrow(some_lags, "row long, start long, end long, period long")
    runs = spans.groupBy("row", "start", "end").agg(F.min("period").alias("period")).groupBy("row").agg(F.collect_list(F.struct("start", "end", "period")).alias("runs"))
    rest = later.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(described, SCHEMA)
    return first.filter("runs_sha256 is not null").unionByName(rest)
