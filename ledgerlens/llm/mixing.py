"""LM scoring by online logistic context mixing.

A text is a sequence of tokens (runs of non-space bytes, A-Z lower-cased, then one end), a token its bytes and a terminator, a
byte eight binary decisions.  Five predictors estimate each bit, from the bits seen so far and a context: the last one to
four bytes (beyond the token's start the kind of the token before) and the token so far.  Their log-odds are added with weights from a set that
a gate selects (place in the token, and how much evidence the longer contexts have); the sum is refined by an adaptive
probability map.  All bits together give the probability of the text, as log10 and in bits per byte.

What is learnt, and how it scales:

- Bit counts of all contexts come from all training texts: tokens are counted in Spark first, so a token is taken apart once,
  however often it occurs.  Every context has counts of its own; no table of them is gathered or broadcast.  Distinct tokens lie in
  shards of about ``SHARD_ROWS`` rows and ``SHARD_BYTES`` bytes at most, ranged by token.  Tokens that begin alike share a shard, so the counts after the token so far are
  complete there, but for the beginnings of a shard's first and last token.  Those, and the counts after one to four bytes, are
  summed in Spark by context, and each shard gets back the ones that it holds.
- Mixing weights and the map are learnt online (one step for each small batch of tokens, every token's own count left out) in
  the same shards, in an order by hash; the shards' weights are averaged.  A shard returns one row, and rows are added up in tasks.
- The scores of all distinct tokens, and their counts for the plain base score: the ``TOP_TOKENS`` most frequent are broadcast, all
  others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import textbytes as B

ORDERS = 5  # predictors: last one, two, three, four bytes, the token so far
TOP_TOKENS = 1 << 17
SHARD_ROWS, SHARD_BYTES = 100_000, 2 << 20  # rows, and bytes of their tokens, of a shard on average
BATCH_TOKENS = 1024
PRIOR = 0.1
KINDS = 4  # of the token before: none, word, sentence stop, other
PLACES, SEEN = 4, 12
GATES = PLACES * SEEN * SEEN
MAP_CELLS = 33
RATE = 0.05
STEP_SYMBOLS = 1 << 16  # scored at a time

_SLOTS = 1 << 16  # of a table for a few hundred tokens, as the tests make; a shard's table has eight for each context and symbol
PREFIX = np.uint64(1 << 63)  # marks the contexts of tokens so far
EXACT = 64  # counts up to this are kept exactly, larger ones to six steps an octave, so that a count is one byte
_COUNT = np.concatenate([np.arange(EXACT + 1), EXACT * 2 ** (np.arange(1, 256 - EXACT) / 6)]).astype(np.float32)
_ODDS = (np.log(_COUNT[None, :] + PRIOR) - np.log(_COUNT[:, None] + PRIOR)).astype(np.float32).ravel()  # by zeros' code, ones' code
_LEVEL = np.minimum(np.log2(_COUNT[None, :] + _COUNT[:, None] + 1), SEEN - 1).astype(np.int32).ravel()
_U = np.uint32
_FILL = np.zeros(256, dtype=np.uint8)
_FILL[:] = 3
_FILL[48:58] = _FILL[65:91] = _FILL[97:123] = _FILL[128:] = 1
_FILL[[33, 46, 63]] = 2


def pairs_of(buf: np.ndarray, off: np.ndarray):
    """Tokens of all texts with their ends: starts, ends, kind of the token before, and the first token of each text."""
    start, end, first = B.tokens(buf, off, B.NOT_SPACE)
    n = np.diff(first)
    at = first[1:] + np.arange(n.size)  # where each text's end comes among all tokens
    s, e = np.empty(start.size + n.size, np.int64), np.empty(start.size + n.size, np.int64)
    word = np.ones(s.size, dtype=bool)
    word[at] = False
    s[word], e[word] = start, end
    s[at] = e[at] = off[1:]
    begins = first + np.arange(first.size)
    kind = np.zeros(s.size, np.uint8)
    if s.size:
        kind[1:] = np.where(word[:-1], _FILL[buf[np.maximum(e[:-1] - 1, 0)]] if buf.size else 0, 0)
        kind[begins[:-1]] = 0
    return s, e, kind, begins


def gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges one after another, and where each begins."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    return buf[np.repeat(start - off[:-1], size) + np.arange(off[-1])], off


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), off.size - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _raw_binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return B.raw(col.cast(pa.large_binary()).view(pa.large_string()) if pa.types.is_large_binary(col.type) else col.view(pa.string()))


def _count_tokens(batches):
    """(kind, token, n, m) of each part of (text, training) rows: occurrences in training texts and in all."""
    for batch in batches:
        for part in B.slices(batch, "text", 4 << 20):
            buf, off = B.raw(part.column(0))
            buf = B.LOWER[buf]
            s, e, kind, begins = pairs_of(buf, off)
            _, one, back, m = np.unique(_pair(buf, s, e, kind), return_index=True, return_inverse=True, return_counts=True)
            training = np.repeat(np.asarray(part.column(1).to_numpy(zero_copy_only=False), np.float64), np.diff(begins))
            n = np.bincount(back, training, one.size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind[one].astype(np.int32)), _binary(*gathered(buf, s[one], e[one])), pa.array(n), pa.array(m)], names=["kind", "token", "n", "m"])


def _pair(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return B.hashes(buf, start, end) ^ (kind.astype(np.uint64) << np.uint64(61))


class Bits:
    """Contexts of every symbol (byte or terminator) of some tokens."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray):
        size = np.diff(off) + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        total = int(begin[-1])
        self.owner = np.repeat(np.arange(size.size), size)
        self.begin = begin
        place = np.arange(total) - begin[:-1][self.owner]
        self.symbol = np.full(total, 32, np.uint8)
        inner = np.ones(total, dtype=bool)
        inner[begin[1:] - 1] = False
        self.symbol[inner] = data
        self.place = np.minimum(place, PLACES - 1).astype(np.int32)
        k = (kind.astype(_U) + _U(1))[self.owner]
        last = []
        for d in range(1, 5):
            prev = np.zeros(total, _U)
            prev[d:] = self.symbol[:-d]
            last.append(np.where(place >= d, prev, np.where(place == d - 1, k, _U(0))))
        power = np.cumprod(np.full(int(size.max(initial=1)), 0x100000001B3, dtype=np.uint64))
        with np.errstate(over="ignore"):
            summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.symbol.astype(np.uint64) + np.uint64(1)) * power[place])])
            so_far = B.mix((summed[:-1] - summed[begin[:-1]][self.owner]) * np.uint64(2) + np.uint64(1))
        two = last[0] | last[1] << _U(8)
        three = two | last[2] << _U(16)
        contexts = [last[0], two, three, three | last[3] << _U(24)]
        # A context and the symbol that follows it as one number; what follows the token so far is told apart by the top bit.
        keys = [np.uint64(i) << np.uint64(40) | c.astype(np.uint64) << np.uint64(8) for i, c in enumerate(contexts)]
        keys.append(so_far & ~np.uint64(255) | PREFIX)
        self.keys, at = np.unique(np.concatenate(keys) | np.tile(self.symbol, ORDERS).astype(np.uint64), return_inverse=True)
        self.at = at.astype(np.int32).reshape(ORDERS, total)
        self.first = [_first(self.keys, b).astype(np.int32) for b in range(8)]

    def bit(self, b: int, some: slice = slice(None)) -> tuple[list[np.ndarray], np.ndarray]:
        """Slots of all predictors and the value of the b-th bit of some symbols."""
        return [self.first[b][at[some]] * 8 + b for at in self.at], (self.symbol[some] >> np.uint8(7 - b)) & np.uint8(1)


def _first(keys: np.ndarray, b: int) -> np.ndarray:
    """For sorted keys the index of the first one with the same context and the same ``b`` first bits of the symbol."""
    node = keys >> np.uint64(8 - b)
    new = np.ones(keys.size, dtype=bool)
    new[1:] = node[1:] != node[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1] if keys.size else np.zeros(0, np.int64)


def _path_codes(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts, as codes, at the eight decisions that lead to each symbol after its context; the keys are sorted and complete for their contexts."""
    codes = np.zeros((keys.size, 8), np.uint16)
    for b in range(8):
        first = _first(keys, b)
        all_ = np.bincount(first, n, keys.size)[first]
        ones = np.bincount(first, n * (keys >> np.uint64(7 - b) & np.uint64(1)), keys.size)[first]
        codes[:, b] = _code(all_ - ones) << 8 | _code(ones)
    return codes


def _code(n: np.ndarray) -> np.ndarray:
    """One byte for a count: itself up to ``EXACT``, six steps an octave beyond."""
    return np.where(n <= EXACT, n, np.minimum(255, EXACT + np.rint(6 * np.log2(np.maximum(n, EXACT) / EXACT)))).astype(np.uint16)


def _border(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The contexts that tokens of other shards may share among those of the tokens so far: beginnings of the first and the last token."""
    words = [data[off[i] : off[i + 1]].tobytes() for i in _ends(data, off)]
    some = Bits(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]), np.zeros(len(words), np.uint8))
    return np.unique(some.keys[some.keys >= PREFIX] >> np.uint64(8))


def _ends(data: np.ndarray, off: np.ndarray) -> list[int]:
    """Indices of the first and the last token in byte order."""
    words = pa.array(np.arange(off.size - 1)), _binary(data, off)
    order = pa.table(words, names=["i", "token"]).sort_by("token")["i"]
    return [order[0].as_py(), order[len(order) - 1].as_py()]


def _held(group: pa.Table) -> pa.Table:
    """(part, key, n): counts of a shard that other shards may add to."""
    data, off, kind, n = _columns(group)
    bits = Bits(data, off, kind)
    total = _totals(bits, n)
    outer = (bits.keys < PREFIX) | np.isin(bits.keys >> np.uint64(8), _border(data, off, kind))
    part = np.full(int(outer.sum()), group["part"][0].as_py(), np.int32)
    return pa.table([part, bits.keys[outer].view(np.int64), total[outer]], names=["part", "key", "n"])


def _totals(bits: Bits, n: np.ndarray) -> np.ndarray:
    weight = n[bits.owner].astype(np.float64)
    return sum(np.bincount(at, weight, bits.keys.size) for at in bits.at).astype(np.int64)


def _columns(group: pa.Table):
    """(bytes, offsets, kind, n) of a shard's tokens."""
    data, off = _raw_binary(group["token"].combine_chunks())
    return data, off, group["kind"].to_numpy(), group["n"].to_numpy()


def _sum_held(batches):
    """(part, key, low, high) of rows (part, key, n) sorted by key: for each the codes of the counts of all shards."""
    rest = [np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for batch in batches:
        got = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        rest = [np.concatenate(x) for x in zip(rest, got, strict=True)]
        context = rest[1] >> np.uint64(8)
        whole = int(np.flatnonzero(context != context[-1])[-1]) + 1 if context.size and context[0] != context[-1] else 0
        if whole:  # all but the last context
            yield _summed(*(x[:whole] for x in rest))
            rest = [x[whole:] for x in rest]
    if rest[0].size:
        yield _summed(*rest)


def _summed(part: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    keys, back = np.unique(key, return_inverse=True)
    codes = _path_codes(keys, np.bincount(back, n, keys.size))[back].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(codes[:, 0].copy()), pa.array(codes[:, 1].copy())], names=["part", "key", "low", "high"])


def _shard(group: pa.Table, summed: pa.Table) -> tuple[Bits, np.ndarray, np.ndarray]:
    """Contexts of a shard's tokens, slots' codes, and the tokens' counts."""
    data, off, kind, n = _columns(group)
    bits = Bits(data, off, kind)
    codes = _path_codes(bits.keys, _totals(bits, n))
    at = np.searchsorted(bits.keys, summed["key"].to_numpy().view(np.uint64))
    codes.view(np.int64)[at] = np.stack([summed["low"].to_numpy(), summed["high"].to_numpy()], 1)
    return bits, codes.reshape(-1), n


def _by_hash(group: pa.Table) -> pa.Table:
    """The rows in an order that has nothing to do with the texts."""
    data, off, kind, _ = _columns(group)
    return group.take(pa.array(np.argsort(_pair(data, off[:-1], off[1:], kind), kind="stable")))


def _gate(place: np.ndarray, four: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Weight set of each symbol's bit from its place and the levels of evidence of the order-4 and prefix predictors."""
    return (place * SEEN + four) * SEEN + prefix


def _cell(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + MAP_CELLS // 2, 0, MAP_CELLS - 1).astype(np.int64)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Mixer:
    """Bit counts of a shard, gated weights and the adaptive map."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # zeros' code in the high byte, ones' in the low one
        self.weights = np.full((GATES, ORDERS + 1), 0.3, np.float32)
        self.weights[:, ORDERS] = 0
        self.map: np.ndarray | None = None

    def log10(self, bits: Bits) -> np.ndarray:
        """log10 probability of each token (with its terminator)."""
        cost = np.zeros(bits.symbol.size, np.float32)
        for b in range(8):
            for at in range(0, cost.size, STEP_SYMBOLS):
                some = slice(at, at + STEP_SYMBOLS)
                slots, value = bits.bit(b, some)
                codes = [self.codes[s] for s in slots]
                w = self.weights[_gate(bits.place[some], _LEVEL[codes[3]], _LEVEL[codes[4]])]
                z = w[:, ORDERS].copy()
                for i, c in enumerate(codes):
                    z += w[:, i] * _ODDS[c]
                z = np.clip(self._refined(z, b), -14, 14)
                cost[some] += np.log1p(np.exp(np.where(value == 1, -z, z)))
        return -np.add.reduceat(cost.astype(np.float64), bits.begin[:-1]) / np.log(10) if bits.begin.size > 1 else np.zeros(0)

    def _refined(self, z: np.ndarray, b: int) -> np.ndarray:
        """Half the mixed log-odds, half what the map has seen at them."""
        return z if self.map is None else (z + self.map[b, _cell(z)]) / 2

    def learn(self, bits: Bits, n: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Online pass over tokens that occur ``n`` times: their number, weights and map counts."""
        weights = self.weights.astype(np.float64)
        seen = np.zeros((2, 8, MAP_CELLS))
        power = np.full(weights.shape, 1e-3)
        for at in range(0, n.size, BATCH_TOKENS):
            some = slice(bits.begin[at], bits.begin[min(at + BATCH_TOKENS, n.size)])
            each = n[bits.owner[some]].astype(np.float64)
            for b in range(8):
                slots, value = bits.bit(b, some)
                y = (value == 1).astype(np.float32)
                x = np.empty((y.size, ORDERS + 1), np.float32)
                x[:, ORDERS] = 1
                left = {}
                for i, s in enumerate(slots):  # the token itself left out once
                    code = self.codes[s]
                    ones, zeros = np.maximum(_COUNT[code & 255] - y, 0), np.maximum(_COUNT[code >> 8] - (1 - y), 0)
                    left[i] = np.minimum(np.log2(ones + zeros + 1), SEEN - 1).astype(np.int32)
                    x[:, i] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
                gate = _gate(bits.place[some], left[3], left[4])
                z = np.clip((weights[gate] * x).sum(1), -14, 14)
                cell = _cell(z)
                seen[0, b] += np.bincount(cell, each, MAP_CELLS)
                seen[1, b] += np.bincount(cell, each * y, MAP_CELLS)
                error = (y - _squash(z)) * each
                total = np.bincount(gate, each, GATES)
                step = np.stack([np.bincount(gate, error * x[:, i], GATES) for i in range(ORDERS + 1)], 1) / np.maximum(total, 1)[:, None]
                power += step**2
                weights += RATE * step / np.sqrt(power)
        return int(n.sum()), weights, seen

    def take(self, mass: float, weights: np.ndarray, seen: np.ndarray) -> None:
        """Average the shards' weights, summed by mass; take their summed map counts."""
        if not mass:
            return
        self.weights = (weights.reshape(GATES, -1) / mass).astype(np.float32)
        n, ones = seen.reshape(2, 8, MAP_CELLS)
        centre = _squash((np.arange(MAP_CELLS) - MAP_CELLS // 2) / 2)
        p = (ones + 8 * centre) / (n + 8)
        self.map = np.log(p / (1 - p)).astype(np.float32)


def _learn(group: pa.Table, summed: pa.Table) -> pa.Table:
    """What a shard learnt, as one row: its mass, weights times mass and map counts, as the bytes of one array."""
    bits, codes, n = _shard(_by_hash(group), summed)
    mass, weights, seen = Mixer(codes).learn(bits, n)
    x = np.concatenate([[float(mass)], weights.ravel() * mass, seen.ravel()])
    return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})


def _added(group: pa.Table) -> pa.Table:
    """Rows of what shards learnt as their sum, in the order of their shards."""
    rows = sorted(zip(group["part"].to_pylist(), group["x"].to_pylist(), strict=True))
    total = np.sum([np.frombuffer(x) for _, x in rows], axis=0)
    return pa.table({"part": pa.array([rows[0][0]], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})


def _score(learnt):
    """(kind, token, n, m, c, first, score) of a shard's tokens: c counts the token after any kind, first marks one row of each token."""

    def run(group: pa.Table, summed: pa.Table) -> pa.Table:
        bits, codes, n = _shard(group, summed)
        mixer = Mixer(codes)
        mixer.weights, mixer.map = learnt.value
        data, off, _, _ = _columns(group)
        _, one, back = np.unique(B.hashes(data, off[:-1], off[1:]), return_index=True, return_inverse=True)
        first = np.zeros(n.size, dtype=bool)
        first[one] = True
        c = np.bincount(back, n, one.size).astype(np.int64)[back]
        return pa.table([group["kind"], group["token"], group["n"], group["m"], c, first, mixer.log10(bits)], names=["kind", "token", "n", "m", "c", "first", "score"])

    return run


def _scorer(top):
    """Scores of (id, row, text) rows; tokens that are not in the broadcast top list are listed for the join."""

    def run(batches):
        known, seen, logs, scores = top.value
        for batch in batches:
            for part in B.slices(batch, "text"):
                buf, off = B.raw(part.column(2))
                buf = B.LOWER[buf]
                s, e, kind, begins = pairs_of(buf, off)
                pair = _pair(buf, s, e, kind)
                pos = np.minimum(np.searchsorted(known, pair), max(0, known.size - 1))
                hit = known[pos] == pair if known.size else np.zeros(pair.size, dtype=bool)
                sums = [np.add.reduceat(np.where(hit, x[pos] if known.size else 0, 0), begins[:-1]) for x in (seen, logs, scores)]
                rest = np.flatnonzero(~hit)
                doc = np.searchsorted(begins, rest, "right") - 1
                tokens = pa.StructArray.from_arrays([pa.array(kind[rest].astype(np.int32)), _binary(*gathered(buf, s[rest], e[rest]))], ["kind", "token"])
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(begins.size)).astype(np.int32)), tokens)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(begins)), pa.array(np.diff(off)), *map(pa.array, sums), tail],
                    names=["id", "row", "n_tokens", "n_bytes", "n_known", "base", "score", "tail"],
                )

    return run


def score_tokens(pairs: DataFrame, root: str) -> DataFrame:
    """``kind, token, n, m, c, first, score`` of token counts ``kind, token, n, m``; tables are written under ``root``."""
    spark = pairs.sparkSession
    size = pairs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size.rows // SHARD_ROWS), -(-size.bytes // SHARD_BYTES))
    pairs.repartitionByRange(shards, "token").withColumn("part", F.spark_partition_id()).write.parquet(f"{root}/shards")
    tokens = spark.read.parquet(f"{root}/shards")
    held = tokens.groupBy("part").applyInArrow(_held, "part int, key bigint, n bigint")
    held = held.repartition(F.shiftrightunsigned("key", 8)).sortWithinPartitions("key")
    held.mapInArrow(_sum_held, "part int, key bigint, low bigint, high bigint").write.parquet(f"{root}/summed")
    both = tokens.groupBy("part").cogroup(spark.read.parquet(f"{root}/summed").groupBy("part"))
    # One row for each shard, added up in groups of about the square root of their number, then all groups.
    learnt = both.applyInArrow(_learn, "part int, x binary").withColumn("some", F.pmod("part", F.lit(max(1, round(shards**0.5)))))
    merged = learnt.groupBy("some").applyInArrow(lambda t: _added(t.drop(["some"])), "part int, x binary")
    one = merged.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: _added(t.select(["part", "x"])), "part int, x binary").collect()
    mixer = Mixer(np.zeros(0, np.uint16))
    if one:
        got = np.frombuffer(one[0].x)
        at = 1 + mixer.weights.size
        mixer.take(got[0], got[1:at], got[at:])
    learnt = spark.sparkContext.broadcast((mixer.weights, mixer.map))
    scored = both.applyInArrow(_score(learnt), "kind int, token binary, n bigint, m bigint, c bigint, first boolean, score double")
    scored.write.parquet(f"{root}/tokens")
    return spark.read.parquet(f"{root}/tokens")


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_bytes, n_known, train_tokens, base_score, score, bits_per_byte`` of every text.

    Learns from the rows of ``docs`` where ``training`` holds (null: does not).  ``base_score``: sum over tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))) with the token's count c, all tokens N and distinct tokens V of the training texts;
    ``n_known``: tokens with c > 0.  ``score``: the model's log10 probability of the text.  A null text is empty: it has one
    token, its end; its bits per byte are null.  One row per input row, repeated rows included.  With no training rows
    N and V are 0 and the model predicts evenly.  Other columns are read only by ``training``.
    """
    spark = docs.sparkSession
    root = scratch_path(spark, "mixing")
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    counted = docs.select(text, F.coalesce(training, F.lit(False)).alias("training")).mapInArrow(_count_tokens, "kind int, token binary, n bigint, m bigint")
    counted.groupBy("kind", "token").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).write.parquet(f"{root}/pairs")
    tokens = score_tokens(spark.read.parquet(f"{root}/pairs"), root)
    all_ = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).first()
    whole = all_.n + 0.1 * (all_.v + 1)

    frequent = tokens.orderBy(F.desc("m"), "token", "kind").limit(TOP_TOKENS).select("kind", "token", "c", "score").toArrow()
    data, off = _raw_binary(frequent["token"].combine_chunks()) if frequent.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    known = _pair(data, off[:-1], off[1:], frequent["kind"].to_numpy())
    order = np.argsort(known)
    c = frequent["c"].to_numpy()[order]
    top = spark.sparkContext.broadcast((known[order], (c > 0).astype(np.int64), np.log10((c + 0.1) / whole), frequent["score"].to_numpy()[order]))

    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(top), f"id {kind}, row bigint, n_tokens bigint, n_bytes bigint, n_known bigint, base double, score double, tail array<struct<kind:int,token:binary>>")
    scored.write.parquet(f"{root}/scored")
    scored = spark.read.parquet(f"{root}/scored")
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.kind", "t.token")
    base = F.log10((F.col("c") + F.lit(0.1)) / F.lit(whole))
    rest = tail.join(tokens.select("kind", "token", "c", F.col("score").alias("log10")), ["kind", "token"])
    rest = rest.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("known"), F.sum(base).alias("more"), F.sum("log10").alias("added"))
    out = scored.drop("tail").join(rest, "row", "left")
    score = F.col("score") + F.coalesce("added", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_bytes",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(all_.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
