"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Documents are ordered by the hash of their text and then the hash of their id, so equal texts lie together and a shard
is a random part of the corpus. Splitters of that order are found by counting: each round takes, for every splitter, the
interval of keys that holds it, and counts the exact bytes in 256 parts of it (4096 in the first round), on all
partitions at once, until the part is within tolerance or one text. A text's copies are split, by the hash of their ids,
only if they weigh more than a tenth of a shard. Then rows are dealt and numbered in one exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

SHARDS = 40
OVERHEAD = 16
#: Of a shard's size, by which a splitter may miss its mark.
TOLERANCE = 0.01
#: Of a shard's size, up to which the copies of a text that a splitter meets stay together.
GROUP = 0.1
#: Bits of the order that each round resolves: 64 of the text's hash, then 64 of the id's.
ROUNDS = (12, 8, 8, 8, 8, 8, 8, 4, *[8] * 8)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the place in the order, as two unsigned numbers in signed form."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64("text").alias("key"), F.xxhash64("doc_id").alias("spread"))


def _digits(upto: int) -> tuple[Column, Column]:
    """The place's first bits before a round, and the bits that the round resolves."""
    done, bits = sum(ROUNDS[:upto]), ROUNDS[upto]
    word, at = (F.col("key"), done) if done < 64 else (F.col("spread"), done - 64)
    digit = F.shiftrightunsigned(F.shiftleft(word, at), 64 - bits)
    if not done:
        return F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), digit
    high = F.col("key") if done >= 64 else F.shiftrightunsigned(F.col("key"), 64 - done)
    low = F.shiftrightunsigned(F.col("spread"), 128 - done) if done > 64 else F.lit(0).cast("long")
    return F.struct(high.alias("a"), low.alias("b")), digit


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass
class _Search:
    """One splitter: the bytes that should lie below it, and the interval of the order that holds it."""

    mark: int
    prefix: int = 0  # the first bits of the interval
    below: int = 0  # bytes before it
    at: int | None = None  # the splitter, as a number of 128 bits, once found


def splitters(table: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Places in the order at which shards 1, 2, ... begin; table: as from keyed()."""
    total = table.agg(F.sum("size")).first()[0] or 0
    searches = [_Search(total * k // shards) for k in range(1, shards)]
    slack, group = tolerance * total / shards, GROUP * total / shards
    for turn, bits in enumerate(ROUNDS):
        left = [s for s in searches if s.at is None]
        if not left:
            break
        done = sum(ROUNDS[:turn])
        prefix, digit = _digits(turn)
        rows = table
        if turn:
            wanted = {s.prefix for s in left}
            pairs = [(_signed(p if done <= 64 else p >> (done - 64)), 0 if done <= 64 else _signed(p & ((1 << (done - 64)) - 1))) for p in wanted]
            rows = rows.filter(prefix.isin([F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in pairs]))
        found = rows.groupBy(prefix.alias("prefix"), digit.alias("digit")).agg(F.sum("size").alias("bytes"), F.min(F.struct("key", "spread")).alias("lo"), F.max(F.struct("key", "spread")).alias("hi"))
        parts: dict[int, list] = {}
        for r in found.collect():  # at most `shards` intervals of 256 parts, or one of 4096
            a, b = r.prefix.a & ((1 << 64) - 1), r.prefix.b & ((1 << 64) - 1)
            whole = a if done <= 64 else a << (done - 64) | b
            parts.setdefault(whole, []).append((r.digit, r.bytes, tuple(r.lo) == tuple(r.hi), r.lo.key == r.hi.key))
        for s in left:
            below = s.below
            for part, size, one_row, one_text in sorted(parts.get(s.prefix, [])):
                if below + size > s.mark:
                    place = (s.prefix << bits | part) << (128 - done - bits)
                    end = place + (1 << (128 - done - bits))
                    if size <= slack or one_row or (one_text and size <= group) or turn == len(ROUNDS) - 1:
                        s.at = place if s.mark - below <= below + size - s.mark else end
                    else:
                        s.prefix, s.below = s.prefix << bits | part, below
                    break
                below += size
            else:
                s.at = 1 << 128  # nothing is left above the mark
    return sorted(s.at for s in searches)


def shard_of(places: list[int]) -> Column:
    """The shard of a row of keyed(): how many splitters lie at or below it."""
    flip = 1 << 63  # signed numbers compare as unsigned ones once the top bit is flipped
    key, spread = (F.col(c).bitwiseXOR(F.lit(-flip).cast("long")) for c in ("key", "spread"))
    shard = F.lit(0)
    for place in places:
        if place < 1 << 128:
            hi, lo = (place >> 64) - flip, (place & ((1 << 64) - 1)) - flip
            shard = shard + ((key > hi) | ((key == hi) & (spread >= lo))).cast("int")
    return shard


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Deal documents to shards of near equal bytes.

    docs: doc_id, text (more columns are ignored). Returns per row: doc_id, size (UTF-8 bytes and 16), text_crc32, law
    ("bytes"), shard, slot (its place there, from 0 without gaps), grown_shard (null under this law). A null text has no bytes. Equal
    texts share a shard unless they straddle a splitter and weigh more than a tenth of a shard. Repeated rows are dealt like copies;
    rows that repeat an id and a text, and copies without an id, are one place in the order and aren't split. A very long text
    is one row and can make its shard larger than the others. With
    fewer rows than shards some shards stay empty; an empty table gives an empty result.
    """
    table = stored(keyed(docs))
    dealt = stored(table.withColumn("shard", shard_of(splitters(table, shards, tolerance))))
    out = numbered(dealt, ["shard"], ["key", "spread", "doc_id", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """Write whole documents, with all their columns, as one folder per shard (shard=0, ...; shard_=0 where docs has a column shard)."""
    places = splitters(stored(keyed(docs)), shards, tolerance)
    name = "shard"
    while name in docs.columns:
        name += "_"
    row, where = F.struct("key", "spread"), shard_of(places)
    keyed_rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"), F.xxhash64("doc_id").alias("spread"))
    placed = keyed_rows.select("row.*", where.alias(name), F.pmod(F.xxhash64(row), F.lit(16)).alias("deal__"))
    placed.repartition(name, "deal__").drop("deal__").write.partitionBy(name).parquet(path)
