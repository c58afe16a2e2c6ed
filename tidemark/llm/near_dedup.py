"""Near-duplicate documents by min-max hashing.

Each of 256 permutations of the shingle hashes gives two signature values, its minimum and its maximum, so 512 values
cost 256 hash evaluations; their last 8 bits are kept, and 16 of those that make bands. Bands of four values, all from
different permutations, give candidate pairs; a pair at the threshold of 0.75 shares no band with probability
(1 - 0.75^4)^32 = 5e-6. Candidates that the 512 values estimate below 0.666 are dropped (4.4 standard deviations below
the threshold, which is 5e-6 again), the others are confirmed on their full shingle sets. Documents with equal sets are
one node from the start.

No bucket is expanded into all its pairs. Every bucket first links its members to one pivot, the member that collides
most often. What is then still in different components within a bucket is compared inside tasks, signature block
against signature block; of the pairs across components that pass the estimate, first the most similar leave them, and
once those have been confirmed and joined, all that still lie across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, reconnected, released, signed, splitmix, stored, text_blocks, word_hashes

PERMUTATIONS = 256
BANDS = 32
#: The threshold that the bands, the test of sizes and the least estimate are made for.
LEAST_PERCENT = 75
#: Estimated similarity below which a candidate pair isn't confirmed on full sets.
LEAST_ESTIMATE = 0.666
#: Buckets up to this size are paired by a join, larger ones in blocks inside tasks.
SMALL_BUCKET = 12
#: Partners of each document outside a bucket's main component that are tried before all that are left.
NEAREST = 2
#: Signatures of one block: 0.6 MB.
SIGNATURE_ROWS = 1024
#: Node ids up to this many are broadcast (8 bytes each) to fetch their texts or signatures; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_A = splitmix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(1000)).astype(np.uint32) | np.uint32(1)
_B = splitmix(np.arange(PERMUTATIONS, dtype=np.uint64) + np.uint64(5000)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles of `width` words, sorted."""
    for first, end, data, bounds in text_blocks(texts):
        words, _, _, begin = word_hashes(data, bounds)
        if len(words) >= width:
            rolled = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                rolled = splitmix(rolled) + words[k : len(words) - width + 1 + k]
            rolled = splitmix(rolled)
        for i in range(end - first):
            lo, hi = begin[i], begin[i + 1]
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                whole = words[lo : lo + 1].copy()
                for k in range(1, hi - lo):
                    whole = splitmix(whole) + words[lo + k]
                yield splitmix(whole + np.uint64(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """640 bytes: the last bytes of all minima and maxima, and the bytes before those of the values that make bands."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    short = shingles.astype(np.uint32)
    for at in range(0, len(short), 512):
        hashed = short[None, at : at + 512] * _A[:, None]
        hashed += _B[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    more = np.concatenate([low[: 2 * BANDS], high[-2 * BANDS :]]) >> np.uint32(8)
    return np.concatenate([low, high, more]).astype(np.uint8)


def similarity(signatures: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimates of the Jaccard similarity; one in 256 of the values that differ agree in their last byte."""
    agree = (signatures[:, : 2 * PERMUTATIONS] == other[..., : 2 * PERMUTATIONS]).mean(axis=1)
    return (256 * agree - 1) / 255


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of the 32 bands, one row per signature: two minima and two maxima of four different permutations."""
    s = signatures.astype(np.uint64)
    low = s[:, : 2 * BANDS] | s[:, -4 * BANDS : -2 * BANDS] << np.uint64(8)
    high = s[:, 2 * PERMUTATIONS - 2 * BANDS : 2 * PERMUTATIONS] | s[:, -2 * BANDS :] << np.uint64(8)
    four = low[:, 0::2] << np.uint64(48) | low[:, 1::2] << np.uint64(32) | high[:, 0::2] << np.uint64(16) | high[:, 1::2]
    return splitmix(splitmix(four) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in released(batches):
                n, hi, lo, sig = [], [], [], []
                for shingles in shingle_sets(batch.column(1), width):
                    n.append(len(shingles))
                    hi.append(int(splitmix(shingles).sum(dtype=np.uint64)))
                    lo.append(int(splitmix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                    sig.append(signature(shingles).tobytes() if len(shingles) else None)
                key = [pa.array(signed(np.array(k, dtype=np.uint64))) for k in (hi, lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *key, pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "key_hi", "key_lo", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), 2 * PERMUTATIONS + 4 * BANDS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in released(batches):
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                keys = signed(band_keys(_signatures(part.column(1))).reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS))], ["bucket", "node"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        if len(batch):
            same = similarity(_signatures(batch.column(2)), _signatures(batch.column(3)))
            keep = same >= LEAST_ESTIMATE
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(same[keep])], ["a", "b", "estimate"])


def _across(limit: int | None):
    """Pairs of one block pair of a bucket: in different components, similar by estimate, and first met in this bucket.

    With a limit, only that many of the most similar partners of each document outside the bucket's main component.
    """

    def run(table: pa.Table) -> pa.Table:
        node, root, half, n, minor = (table.column(c).to_numpy() for c in ("node", "root", "half", "n", "minor"))
        sig = _signatures(table.column("sig").combine_chunks())
        with np.errstate(over="ignore"):
            keys = band_keys(sig)
        here = np.argmax(signed(keys[:1]) == table.column("bucket")[0].as_py())
        left, right = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
        similar = np.zeros((len(left), len(right)))
        for k, i in enumerate(left):
            at = np.flatnonzero((root[right] != root[i]) & (4 * np.minimum(n[right], n[i]) >= 3 * np.maximum(n[right], n[i])))
            at = at[np.argmax(keys[right[at]] == keys[i], axis=1) == here] if len(at) else at
            similar[k, at] = similarity(sig[right[at]], sig[i])
        kept = similar >= LEAST_ESTIMATE
        if limit is not None and kept.size:
            tops = np.zeros_like(kept)
            for axis in (0, 1):
                most = min(limit, similar.shape[axis])
                least = np.partition(similar, -most, axis=axis).take([-most], axis=axis)
                tops |= (similar >= least) & (True if axis else minor[right][None, :])
            kept &= tops
        a, b = node[left[kept.nonzero()[0]]], node[right[kept.nonzero()[1]]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in released(batches):
                for at in range(0, len(batch), 500):
                    part = batch.slice(at, 500)
                    sets = [signed(s) for s in shingle_sets(part.column(1), width)]
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    values = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "shingles"])

    return run


def _of(rows: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """The rows whose key is one of the nodes (a stored table of distinct ones)."""
    wanted = nodes.withColumnRenamed("node", key)
    return rows.join(F.broadcast(wanted) if nodes.count() <= BROADCAST_IDS else wanted, key, "left_semi")


def _linked(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    nodes = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    sets = stored(_of(texts, "doc_id", nodes).select("doc_id", "text").mapInArrow(_sets(width), "node long, shingles array<long>"))
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    common = F.size(F.array_intersect("one", "two"))
    similar: Column = 100 * common >= percent * (F.size("one") + F.size("two") - common)
    return pairs.select("a", "b").join(one, "a").join(two, "b").filter(similar).select("a", "b")


def _free(rows: DataFrame) -> int:
    """Where 2^62 numbers begin that no doc_id uses; raises ValueError where ids lie in all quarters of the longs."""
    quarter = F.shiftright("doc_id", 61)  # from -4 to 3
    used = {r[0] for r in rows.filter("doc_id is not null").select(quarter.alias("q")).distinct().collect()}
    begins = [q << 61 for q in (2, 1, 0, -2, -1, -4, -3) if not {q, q + 1} & used]
    if not begins:
        raise ValueError("the ids leave no numbers for rows without one")
    return begins[0]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Groups of documents whose sets of `width`-word shingles have a Jaccard similarity of percent / 100 or more.

    docs: doc_id long, text string (more columns are ignored). Returns one row per row of docs: doc_id, n_shingles (size
    of its set), component_id (the smallest doc_id that links reach), kept (doc_id = component_id).

    Null or wordless texts have an empty set, link with nothing and are kept. Texts of fewer than `width` words are one
    shingle. Rows that share a doc_id are one document, so links of either hold for both, and both rows come out. Rows with a null
    doc_id link as all others do and join the groups of what they resemble; where no member has an id, component_id is null and
    the row is kept. A very long text is one set, whatever its size. An empty
    table gives an empty result. The bands and bounds hold for a percent of LEAST_PERCENT or more; less raises ValueError.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}, but links below {LEAST_PERCENT} would be missed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Rows without an id get numbers that no id uses, until the end.
    if nameless := not texts.filter("doc_id is null").isEmpty():
        begin = _free(texts)
        numbers = stored(texts.filter("doc_id is null").select((F.lit(begin) + F.monotonically_increasing_id()).alias("doc_id"), "text"))
        texts = texts.filter("doc_id is not null").unionByName(numbers)
    rows = stored(texts.mapInArrow(_features(width), "doc_id long, n_shingles long, key_hi long, key_lo long, sig binary"))
    full = rows.filter("n_shingles > 0")
    nodes = stored(full.groupBy("key_hi", "key_lo").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))

    buckets = nodes.select("node", "sig").mapInArrow(_bands, "bucket long, node long")
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = stored(buckets.join(crowded, "bucket"))
    # Signatures are wide, and most nodes of a corpus share no bucket: only those that do go through the joins below.
    known = stored(_of(nodes, "node", stored(members.select("node").distinct())).select("node", "n", "sig"))
    met = members.groupBy("node").agg(F.sum("members").alias("met"))
    ranked = members.join(met, "node")
    pivots = ranked.groupBy("bucket").agg(F.bitwise_not(F.max(F.struct("met", F.bitwise_not("node").alias("minus")))["minus"]).alias("pivot"))
    starred = ranked.join(pivots, "bucket").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    estimated = stored(_estimated(starred, known))

    # First the best partner of each node, then whatever still lies between different components.
    best = estimated.groupBy("a").agg(F.max_by("b", F.struct("estimate", F.bitwise_not("b").alias("x"))).alias("b"))
    same_id = full.select("doc_id", "key_hi", "key_lo").join(nodes, ["key_hi", "key_lo"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    same_id = same_id.join(repeated, same_id["a"] == repeated["doc_id"], "left_semi")
    roots = stored(connected(_linked(texts, best, width, percent).unionByName(same_id)))

    tried = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    for limit in (NEAREST, None):
        rooted = members.join(roots, "node", "left").select("bucket", "node", "members", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("bucket")
        open_rows = stored(rooted.join(mixed, "bucket", "left_semi").join(known, "node").select("bucket", "node", "members", "root", "n", "sig"))
        rest = _estimated(_small_pairs(open_rows), known).select("a", "b").unionByName(_large_pairs(open_rows, limit)).distinct()
        rest = stored(rest.join(tried, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            tried = tried.unionByName(rest)
            roots = stored(reconnected(roots, _linked(texts, rest, width, percent)))

    grouped = nodes.join(roots, "node", "left").select("key_hi", "key_lo", F.coalesce("root", "node").alias("component"))
    plain = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.join(grouped, ["key_hi", "key_lo"]).select("doc_id", "n_shingles", F.col("component").alias("component_id")).unionByName(plain)
    if nameless:  # a component is known by its smallest id, not by a number that stands for none
        named = F.when(~F.col("doc_id").between(begin, begin + (1 << 62) - 1), F.col("doc_id"))
        out = stored(out.withColumn("doc_id", named).withColumnRenamed("component_id", "component"))
        least = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        out = out.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _estimated(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) with the agreement of their signatures, where that is high enough."""
    one = known.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("sig").alias("s1"))
    two = known.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sig").alias("s2"))
    sized = pairs.join(one, "a").join(two, "b").filter(4 * F.least("n1", "n2") >= 3 * F.greatest("n1", "n2"))
    return sized.select("a", "b", "s1", "s2").mapInArrow(_estimates, "a long, b long, estimate double")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs across components in buckets of a bounded size."""
    small = rows.filter(F.col("members") <= SMALL_BUCKET)
    one = small.select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    two = small.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"))
    fits = 4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")
    return one.join(two, "bucket").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits).select("a", "b").distinct()


def _large_pairs(rows: DataFrame, limit: int | None) -> DataFrame:
    """Pairs across components in larger buckets, compared block against block inside tasks.

    Every such pair has a member outside the bucket's main component. Those members fall into blocks of a bounded size,
    and each block meets all members, in blocks too: where few are outside, a row is copied about twice. The main component
    reaches a bucket's rows block by block, and the pairs of blocks of one bucket are dealt over all tasks.
    """
    blocks = lambda number: F.ceil(number / SIGNATURE_ROWS).cast("int")
    pick = lambda number: F.pmod(F.xxhash64("node"), blocks(number)).cast("int")
    each = lambda number: F.explode(F.sequence(F.lit(0), blocks(F.col(number)) - 1))
    large = rows.filter(F.col("members") > SMALL_BUCKET).withColumn("hi", pick(F.col("members")))
    by_root = large.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.first("members").alias("of"))
    mains = by_root.groupBy("bucket").agg(F.max(F.struct("c", "root"))["root"].alias("main"), (F.sum("c") - F.max("c")).alias("outside"), F.first("of").alias("of"))
    large = large.join(mains.withColumn("hi", each("of")).drop("of"), ["bucket", "hi"]).withColumn("minor", F.col("root") != F.col("main"))
    rest = large.withColumn("lo", each("outside"))
    minor = large.filter("minor").withColumn("hi", each("members")).withColumn("lo", pick(F.col("outside")))
    columns = ["bucket", "lo", "hi", "half", "minor", "node", "root", "n", "sig"]
    met = minor.withColumn("half", F.lit(0)).select(*columns).unionByName(rest.withColumn("half", F.lit(1)).select(*columns))
    # Without a shuffle of their own, the block pairs would stay where the join by bucket and block has put them.
    return met.repartition("bucket", "lo", "hi").groupBy("bucket", "lo", "hi").applyInArrow(_across(limit), "a long, b long")
