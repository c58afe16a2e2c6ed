"""Language-model scores by a weighted backoff automaton over words, pairs and triples.

The model: a word's probability behind nothing is its count with Dirichlet smoothing over the known words and one class
for all unknown ones; behind one word, its pair count with Dirichlet smoothing by that; behind two words, its triple count
less a discount, the mass so gained going to the shorter history. As an automaton: the root, the beginning of a text, every
known word and every pair that has been followed by something are states. A state has an arc for each word seen behind
its history, with the log-probability, to the state of the longest known history; and a failure arc to the state of the
history without its first word, with the log of the mass left for it. A text is read from left to right: at each word the
automaton takes the state's arc, or fails over to shorter histories until one has an arc, and adds up the weights.

The model grows with the corpus and is never gathered in one place. Documents fall into chunks of bounded bytes. Each
chunk asks for its distinct words and triples, with the training counts it has seen itself; the requests are dealt over
shards by word or by the triple's first two words, a shard adds up the counts and answers every chunk, and each chunk
builds the part of the automaton that its documents can reach and reads them with it. A frequent key is one number a chunk, so
it can't overload a shard. Keys travel as hashes, sorted and packed: words by 64 bits, pairs by 44, the third word by 20 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import splitmix, stored, text_blocks, word_hashes

#: Pseudo-counts that a word's state gives to the root's distribution, and the discount of every triple.
PAIR_MASS = 20.0
DISCOUNT = 0.9
#: Bytes of text of a chunk and of a shard's part of the corpus, a row counting ROW_BYTES more. Requests are chunks times shards.
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
ROW_BYTES = 64
#: Bits of a triple's key that tell third words apart; the others are the pair's.
WORD_BITS = 20
#: Tokens that are read side by side with all others of the chunk; longer texts are read in lanes of so many.
LANE = 256

_END = np.uint64(0x5EED0E4D)
_START = np.uint64(0x5EED0B06)
_PAD = np.uint64(0x5EED0FAD)


class Tokens:
    """The tokens of some texts (words, then the end of each), one array for all.

    token: hashes; row: its text's number; first: where each text begins (and the end). triple: at each token, the key of
    the two words before it and itself; there is one more behind each text, so that every token is within the pair of the next
    triple. after: where in `triple` the triple behind each token is.
    """

    def __init__(self, texts: pa.Array):
        parts = []
        for _, _, data, bounds in text_blocks(texts):
            words, _, _, begin = word_hashes(data, bounds)
            parts.append((words, np.diff(begin)))
        words = np.concatenate([np.zeros(0, dtype=np.uint64), *(p[0] for p in parts)])
        number = np.concatenate([np.zeros(0, dtype=np.int64), *(p[1] for p in parts)]) + 1
        self.first = np.concatenate([[0], np.cumsum(number)])
        n, texts_ = len(words) + len(number), len(number)
        self.row = np.repeat(np.arange(texts_), number)
        self.token = np.full(n, _END, dtype=np.uint64)
        is_word = np.ones(n, dtype=bool)
        is_word[self.first[1:] - 1] = False
        self.token[is_word] = words
        # Texts with a start before and a pad behind: the triple that ends at each place but the first two.
        wide = np.full(n + 2 * texts_, _PAD, dtype=np.uint64)
        shift = np.arange(n) + 2 * self.row + 1
        wide[shift] = self.token
        wide[shift[self.first[:-1]] - 1] = _START
        pair = splitmix(splitmix(wide[:-2]) + wide[1:-1]) >> np.uint64(WORD_BITS) << np.uint64(WORD_BITS)
        triple = pair | splitmix(wide[2:] + np.uint64(7)) >> np.uint64(64 - WORD_BITS)
        ends = np.ones(len(triple), dtype=bool)
        between = (shift[self.first[1:] - 1] + 1)[:-1]  # the pads of all texts but the last: no triple may cross them
        for back in (0, 1):
            ends[between + 1 - 2 + back] = False
        self.triple = triple[ends]
        self.after = np.arange(n)
        #: The triple of the token itself; a text's first token has none.
        self.own = np.maximum(self.after - 1, 0)
        self.begins = np.zeros(n, dtype=bool)
        self.begins[self.first[:-1]] = True


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of equal bytes, compressed; sorted numbers are best packed by their steps."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(blob: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, np.uint64), dtype=np.uint64)


def _shard_cuts(keys: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Where each shard's keys begin and end in a sorted array of keys; a pair's triples are never parted."""
    firsts = [(s << 64) // shards >> WORD_BITS << WORD_BITS for s in range(1, shards)]
    cuts = [0, *np.searchsorted(keys, np.array(firsts, dtype=np.uint64)).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False))


def _vocabulary(shards: int):
    """Per batch and shard: the distinct words of training texts; in shard -1 the numbers of tokens and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                kept = batch.filter(batch.column(1))
                if not len(kept):
                    continue
                tokens = Tokens(kept.column(0))
                keys = np.unique(tokens.token)
                copies = kept.column(2).to_numpy()
                blobs = [_packed(_steps(keys[lo:hi])) for lo, hi in _shard_cuts(keys, shards)]
                n = [0] * shards
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1, *range(shards)], pa.int32()), pa.array([b"", *blobs], pa.binary()), pa.array([int(copies[tokens.row].sum()), *n], pa.int64()), pa.array([int(copies.sum()), *n], pa.int64())],
                    ["shard", "keys", "tokens", "texts"],
                )

    return run


def _distinct(table: pa.Table) -> pa.Table:
    with np.errstate(over="ignore"):
        parts = [_keys(x) for x in table.column("keys").to_pylist() if x]
    keys = np.concatenate([np.zeros(0, dtype=np.uint64), *parts])
    total = lambda name: pa.array([sum(table.column(name).to_pylist())], pa.int64())
    return pa.table({"words": pa.array([len(np.unique(keys))], pa.int64()), "tokens": total("tokens"), "texts": total("texts")})


def _requests(shards: int):
    """Of one chunk and each shard: the distinct words and triples of its texts and how often its training texts have them."""

    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            tokens = Tokens(table.column("text"))
            weight = np.where(table.column("train").to_numpy(), table.column("copies").to_numpy(), 0)[tokens.row]
            out: dict[str, list] = {}
            for name, keys in (("words", tokens.token), ("triples", tokens.triple)):
                unique, inverse = np.unique(keys, return_inverse=True)
                counts = np.bincount(inverse, weights=weight, minlength=len(unique)).astype(np.uint64)
                cuts = _shard_cuts(unique, shards)
                out[name] = [_packed(_steps(unique[lo:hi])) for lo, hi in cuts]
                out[f"{name}_n"] = [_packed(counts[lo:hi]) for lo, hi in cuts]
        columns = {"chunk": pa.array([table.column("chunk")[0].as_py()] * shards, pa.int32()), "shard": pa.array(range(shards), pa.int32())}
        return pa.table(columns | {name: pa.array(blobs, pa.binary()) for name, blobs in out.items()})

    return run


def _pairs(triples: np.ndarray) -> np.ndarray:
    """Where each pair's triples begin in a sorted array of triples."""
    high = triples >> np.uint64(WORD_BITS)
    return np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(triples) else np.zeros(0, dtype=np.int64)


def _answers(table: pa.Table) -> pa.Table:
    """Of one shard: for each chunk, in its order, the total counts of its words and triples, and of its pairs the count and the number of words seen behind."""

    def summed(name: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        asked = [_keys(x) for x in table.column(name).to_pylist()]
        counts = np.concatenate([_unpacked(x, np.uint64) for x in table.column(f"{name}_n").to_pylist()])
        unique, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        return asked, unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.uint64)

    with np.errstate(over="ignore"):
        words, all_words, word_counts = summed("words")
        triples, all_triples, triple_counts = summed("triples")
        starts = _pairs(all_triples)
        pair_counts = np.add.reduceat(triple_counts, starts) if len(starts) else triple_counts
        behind = np.add.reduceat((triple_counts > 0).astype(np.uint64), starts) if len(starts) else triple_counts
        high = all_triples[starts] >> np.uint64(WORD_BITS)
        out: dict[str, list] = {"words": [], "triples": [], "pairs": [], "behind": []}
        for w, t in zip(words, triples, strict=True):
            out["words"].append(_packed(word_counts[np.searchsorted(all_words, w)]))
            out["triples"].append(_packed(triple_counts[np.searchsorted(all_triples, t)]))
            at = np.searchsorted(high, t[_pairs(t)] >> np.uint64(WORD_BITS))
            out["pairs"].append(_packed(pair_counts[at]))
            out["behind"].append(_packed(behind[at]))
    return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard")} | {name: pa.array(blobs, pa.binary()) for name, blobs in out.items()})


class Automaton:
    """States with arcs and failure arcs. State 0 is the root, which has an arc for every symbol; weights are log10 probabilities."""

    def __init__(self, symbols: int, arcs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], failure: tuple[np.ndarray, np.ndarray]):
        """arcs: state, symbol, weight, target; failure: the state that each state fails over to, and the weight of that."""
        state, symbol, weight, target = arcs
        key = state * symbols + symbol
        order = np.argsort(key)
        self.symbols, self.key, self.weight, self.target = symbols, key[order], weight[order], target[order]
        self.failure, self.failure_weight = failure

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states reached by one symbol each, and the weights on the way."""
        at = np.searchsorted(self.key, wanted := state * self.symbols + symbol)
        missing = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] != wanted)
        weight = np.zeros(len(state))
        while len(missing):  # down to the root, which has an arc
            weight[missing] += self.failure_weight[state[missing]]
            state = state.copy()
            state[missing] = self.failure[state[missing]]
            wanted = state[missing] * self.symbols + symbol[missing]
            at[missing] = np.searchsorted(self.key, wanted)
            missing = missing[self.key[np.minimum(at[missing], len(self.key) - 1)] != wanted]
        return self.target[at], weight + self.weight[at]

    def read(self, symbols: np.ndarray, first: np.ndarray, start: int, lane: int = LANE) -> np.ndarray:
        """The weight of each text; symbols of all texts, where each begins (and the end), the state in which a text begins.

        Texts are read side by side. A state is a history of at most two words, so wherever reading begins, two words
        lead to the state that the whole text would have led to; long texts are therefore read in lanes, each of which reads the two
        words before it without adding them up.
        """
        number = -(-np.diff(first) // lane)
        text = np.repeat(np.arange(len(number)), number)
        begin = first[:-1][text] + lane * (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number))
        end = np.minimum(begin + lane, first[1:][text])
        at = np.where(begin > first[:-1][text], begin - 2, begin)
        state = np.where(begin > first[:-1][text], 0, start)
        order = np.argsort(at - end, kind="stable")  # the longest first
        text, begin, end, at, state = (x[order] for x in (text, begin, end, at, state))
        length, total = end - at, np.zeros(len(text))
        for k in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -k))
            state[:active], weight = self.step(state[:active], symbols[at[:active] + k])
            total[:active] += np.where(at[:active] + k >= begin[:active], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(number))


def _model(tokens: Tokens, counts: dict[str, np.ndarray], n: int, words: int, texts: int) -> tuple[np.ndarray, np.ndarray, Automaton, int]:
    """Symbols and counts of the tokens, the automaton they can reach, and the state in which a text begins. counts: of the
    distinct words and triples in order, and of their pairs with the number of words behind."""
    unique, symbol = np.unique(tokens.token, return_inverse=True)
    triples, first_at, triple = np.unique(tokens.triple, return_index=True, return_inverse=True)
    pair_of = np.cumsum(np.isin(np.arange(len(triples)), _pairs(triples))) - 1
    word_n, triple_n, pair_n, behind = (counts[c].astype(np.float64) for c in ("words", "triples", "pairs", "behind"))
    end = int(np.searchsorted(unique, _END))

    # Root: one class more than there are words takes the unknown ones.
    classes = words or 1
    root = (word_n + classes / (words + 1.0)) / (n + classes)
    # Of each token: its pair with the word before, and that word (or the beginning of a text).
    pair = pair_of[triple[tokens.after]]
    before = np.where(tokens.begins, -1, np.concatenate([[0], symbol[:-1]]))
    before_n = np.where(tokens.begins, float(texts), word_n[before])
    second = (pair_n[pair] + PAIR_MASS * root[symbol]) / (before_n + PAIR_MASS)
    # Of each token but the first of a text: its triple, and the pair before it.
    history = pair_of[triple[tokens.own]]
    third_n, history_n = triple_n[triple[tokens.own]], pair_n[history]
    with np.errstate(divide="ignore", invalid="ignore"):
        third = (np.maximum(third_n - DISCOUNT, 0.0) + DISCOUNT * behind[history] * second) / history_n

    # States: the root, the beginning, known words, pairs that something follows.
    start, word_states = 1, 2
    pair_states = word_states + len(unique)
    word_state = np.where((word_n > 0) & (np.arange(len(unique)) != end), word_states + np.arange(len(unique)), 0)
    last = np.zeros(len(pair_n), dtype=np.int64)
    last[pair] = symbol
    pair_state = np.where((pair_n > 0) & (last != end), pair_states + np.arange(len(pair_n)), word_state[last])
    before_state = np.where(before < 0, start, word_states + before)

    _, a = np.unique(pair, return_index=True)  # one token for each distinct pair
    a = a[pair_n[pair[a]] > 0]
    inner = np.flatnonzero(~tokens.begins)
    _, b = np.unique(triple[tokens.own[inner]], return_index=True)
    b = inner[b]
    b = b[third_n[b] > 0]
    every = np.arange(len(unique))
    arcs = (
        np.concatenate([np.zeros(len(unique), dtype=np.int64), before_state[a], pair_states + history[b]]),
        np.concatenate([every, symbol[a], symbol[b]]),
        np.log10(np.concatenate([root, second[a], third[b]])),
        np.concatenate([word_state, pair_state[pair[a]], pair_state[pair[b]]]),
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        lost = np.concatenate([[0.0], np.log10(PAIR_MASS / (np.concatenate([[texts], word_n]) + PAIR_MASS)), np.log10(DISCOUNT * behind / pair_n)])
    failure = np.concatenate([np.zeros(pair_states, dtype=np.int64), word_state[last]]), lost
    return symbol, word_n[symbol], Automaton(len(unique), arcs, failure), start


def _scores(n: int, words: int, texts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("shard").to_numpy())
        counts = {}
        for name in ("words", "triples", "pairs", "behind"):
            blobs = answers.column(name).to_pylist()
            counts[name] = np.concatenate([_unpacked(blobs[k], np.uint64) for k in order])
        with np.errstate(over="ignore"):
            tokens = Tokens(docs.column("text"))
            symbol, word_n, automaton, start = _model(tokens, counts, n, words, texts)
        rows = docs.num_rows
        add = lambda x: np.bincount(tokens.row, weights=x, minlength=rows)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "copies": docs.column("copies"),
                "held_out": pa.array(~docs.column("train").to_numpy()),
                "n_tokens": pa.array(np.diff(tokens.first).astype(np.int64)),
                "n_known": pa.array(add(word_n > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, n, dtype=np.int64)),
                "base_score": pa.array(add(np.log10((word_n + 1.0) / (n + words + 1.0)))),
                "score": pa.array(automaton.read(symbol, tokens.first, start)),
            }
        )

    return run


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Log10 probabilities of all whole texts under a model of those that aren't held out.

    docs: doc_id, text (more columns are ignored). Returns per row: doc_id, held_out, n_tokens, n_known (tokens seen in
    training), train_tokens, base_score (add-one unigram model), score (this model). Null texts are empty, and so the end
    token alone; a null held_out counts as false, and so do rows without an id where it is made of the id. Repeated rows count as
    often as they come and are gathered first, so that they don't meet in one chunk. A very long text is read whole, in
    one task. With no training texts every token is unknown and has probability 1 at the root. An empty table gives an
    empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, copies long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(~held_out, F.lit(True)).alias("train"))
    name = F.xxhash64("doc_id", "text")
    size = texts.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    repeated = not texts.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    if repeated:
        texts = stored(texts.groupBy("doc_id", "text", "train").agg(F.count(F.lit(1)).alias("copies")))
    else:
        texts = texts.withColumn("copies", F.lit(1).cast("long"))
    shards, chunks = max(12, -(-size // SHARD_BYTES)), max(12, -(-size // CHUNK_BYTES))
    texts = texts.withColumn("chunk", F.pmod(name, F.lit(chunks)).cast("int"))
    parts = texts.select("text", "train", "copies").mapInArrow(_vocabulary(shards), "shard int, keys binary, tokens long, texts long")
    sizes = parts.groupBy("shard").applyInArrow(_distinct, "words long, tokens long, texts long")
    words, tokens, trained = (x or 0 for x in sizes.agg(F.sum("words"), F.sum("tokens"), F.sum("texts")).first())
    asked = texts.groupBy("chunk").applyInArrow(_requests(shards), "chunk int, shard int, words binary, words_n binary, triples binary, triples_n binary")
    answers = asked.groupBy("shard").applyInArrow(_answers, "chunk int, shard int, words binary, triples binary, pairs binary, behind binary")
    scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(tokens, words, trained), schema)
    if repeated:
        scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy")
    return scored.drop("copies")
