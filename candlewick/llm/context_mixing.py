"""Language-model scores by online logistic context mixing.

A text is its lower-cased (A-Z) UTF-8 bytes and an end symbol. Every symbol is
a path of binary decisions down a Huffman tree, one for each byte before it, of
the training bytes. Several predictors each look a decision up in a table of
hashed contexts (the last 3 or 5 bytes; the letters of the word so far) that
holds how often each branch was taken in the training texts. Their log odds are
mixed by weights that a gate selects (kind of the byte before, depth in the
tree, what the word's table knows), and the weights are refined by gradient steps
while a text is read: each decision is predicted with the weights that came out of
the blocks of decisions before it. The sum of all decisions' costs is the text's
total in bits, and so its probability.

The counts cover all training texts. Each task counts into its own tables and
sends them as compressed blocks; blocks are added up sixteen at a time, so no group
grows with the number of tasks. The number of slots of a table follows the training
bytes up to ``MOST_SLOTS``, the bound of what is broadcast (one byte a slot and
predictor; two for the fit). The first weights are fitted on every decision of all
training texts: a second scan looks each one up in the finished tables, less itself,
and counts it by its gate and the levels (``LEVELS``) of what the predictors say. Newton
steps on that table, whose size is bounded, find the weights on the driver. Both scans take
equal symbols in equal contexts together, some megabytes of text at a time.

The base score is that of an add-one unigram model over all training words. The
most frequent words are broadcast; all others meet their counts in a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.bytewords import WHITE, byte_table, joined, runs, words_of
from candlewick.llm.common import doc_remainder, drop, give_back, written

HELD_OUT_MODULUS, HELD_OUT = 7, 2
#: Contexts: so many bytes before; the word so far (the last one) reaches back this far.
ORDERS, WORD_REACH = (3, 5), 8
REACH = max(*ORDERS, WORD_REACH)
PREDICTORS = len(ORDERS) + 1
#: Slots of a table: one for so many training bytes, from LEAST_SLOTS to what each predictor has at most.
BYTES_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 16, (1 << 20, 1 << 22, 1 << 22)
#: Slots a block; blocks that are added up in one group.
BLOCK, FAN_IN = 1 << 15, 16
#: Count added to both branches; log odds are stored in steps of 1 / STEP.
PRIOR, STEP = 0.4, 12
#: A weight moves by RATE times the gradient, by FAR at most for all decisions of a gate and block.
RATE, FAR = 0.004, 0.1
#: Symbols of a text before its weights move for the first time (then twice as many, up to MOST_BLOCK).
FIRST_BLOCK, MOST_BLOCK = 128, 2048
#: Words that are broadcast at most, and their greatest size; bytes of words and of decisions handled together.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 256
WORD_RUN, TEXT_RUN, PAIR_RUN = 1 << 22, 1 << 16, 1 << 16
#: Bytes whose equal symbols in equal contexts are counted together, and handled together; bits of a pair's number.
GRAM_RUN, GRAM_PIECE, PAIR_BITS = 1 << 22, 1 << 15, 14
END = 256
#: Bytes that lower-cased texts do not hold: the end or no byte, a byte that no context sees.
OUTSIDE, UNSEEN = b"AB"
#: Gates: kind of the byte before, depth in the tree, and whether the word's table knows nothing, little or more.
DEPTHS, TRUSTS, LITTLE = 4, 3, 15

_WHITE = byte_table(WHITE)
_LETTER = byte_table(bytes([*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]))
_BREAK = ~_LETTER
_LETTER_BITS = np.where(_LETTER, 0xFFFFFFFF, 0).astype(np.uint32)
#: Gate of the byte before: nothing, a letter, white space, something else.
_KIND = np.concatenate(([0], np.where(_LETTER, 1, np.where(_WHITE, 2, 3)))).astype(np.int32)
GATES = 4 * DEPTHS * TRUSTS
#: What a predictor says for the branch that was taken, in levels: 0, and from these steps on, for and against it.
#: LITTLE ends a level, so that a level tells the trust.
_EDGES = np.array([1, 4, 8, 12, 16, 21, 27, 34, 43, 55, 71, 93])
LEVELS = 2 * len(_EDGES) + 1
_FOR = np.searchsorted(_EDGES, np.arange(128), "right")
_LEVEL = np.concatenate((-_FOR[:0:-1], _FOR)).astype(np.int8) + np.int8(len(_EDGES))     #: of steps -127 to 127
#: The middle of each level in steps.
_MIDDLE = np.bincount(_LEVEL, np.arange(-127, 128)) / np.bincount(_LEVEL)
#: Counts of decisions by kind, depth and all levels, filled up to whole blocks.
SEEN = -(-4 * DEPTHS * LEVELS ** PREDICTORS // (2 * BLOCK)) * 2 * BLOCK
#: Newton steps of the fit, the most a weight moves in one, and what holds it at its start (decisions).
NEWTON, NEWTON_FAR, HOLD, START = 12, 0.5, 16.0, 1 / PREDICTORS + 0.1


# ---------------------------------------------------------------- decisions

def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """(node, branch) steps to each of the 257 symbols in the Huffman tree of ``counts``; no symbol
    counts for less than 1 in 65,536, which bounds the depth."""
    weight = np.maximum(counts + 1 / 64, counts.sum() / 65536)
    heap = [(float(w), i, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (a[2], b[2])))
    paths, nodes, stack = {}, 0, [(heap[0][2], [])]
    while stack:
        tree, path = stack.pop()
        if isinstance(tree, tuple):
            stack += [(tree[0], path + [(nodes, 0)]), (tree[1], path + [(nodes, 1)])]
            nodes += 1
        else:
            paths[tree] = path
    return [paths[s] for s in range(END + 1)]


@dataclass
class Code:
    """The trees: of each byte before (0: none) and symbol the path as a stretch of hashed nodes and bits
    (and both as one number, ``branch``)."""
    length: np.ndarray
    first: np.ndarray
    hashed: np.ndarray
    bit: np.ndarray
    branch: np.ndarray
    row: np.ndarray                        #: row of the weights that the depth selects
    other: np.ndarray                      #: what turns steps for branch 1 into log odds of the branch not taken

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        """From the counts of all 257 symbols behind each of 256 bytes or nothing (257 x 257)."""
        total = counts.sum(0)
        total = total / max(1, total.sum())
        unseen = _paths(total)
        trees = [_paths(c + total) if c.any() else unseen for c in counts]
        paths = [path for tree in trees for path in tree]
        length = np.array([len(p) for p in paths])
        first = np.cumsum(length) - length
        node = np.array([n for p in paths for n, _ in p])
        depth = np.minimum(np.arange(len(node)) - np.repeat(first, length), DEPTHS - 1)
        hashed = (node & 63) ^ ((node >> 6) * 0x2C1B3C40 & LEAST_SLOTS - 1)   # 64 nodes of a context are neighbours
        bit = np.array([b for p in paths for _, b in p], np.uint8)
        other = np.where(bit, -1 / STEP, 1 / STEP).astype(np.float32)
        return cls(length, first, hashed, bit, hashed * 2 + bit, depth * TRUSTS, other)


def _contexts(buf: np.ndarray, place: np.ndarray, skip: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each byte from ``skip`` on: its hashed contexts, the byte before it plus one (0: none), and
    that one's kind. ``place`` is each byte's position in its own text; nothing reaches across its beginning."""
    def lags() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        padded = np.concatenate((np.zeros(WORD_REACH, np.uint32), buf.astype(np.uint32) + np.uint32(1)))
        letter = np.concatenate((np.zeros(WORD_REACH, np.uint32), _LETTER_BITS.take(buf)))
        begin = np.flatnonzero(place[skip:] == 0)
        outside = begin[:0]
        for lag in range(1, WORD_REACH + 1):
            cut = slice(skip + WORD_REACH - lag, len(padded) - lag)
            outside = np.concatenate((outside, begin + (lag - 1)))          # all places less than the lag
            outside = outside[outside < len(buf) - skip]
            b = padded[cut]
            if lag <= max(ORDERS):
                b = b.copy()
                b[outside] = 0
            yield b, letter[cut], outside
    return _hashed(len(buf) - skip, lags())


def _hashed(size: int, lags: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
            ) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The contexts from the bytes at each lag from 1 on: (byte plus one or 0, its letter bits, where no byte is)."""
    prime, out = np.uint32(0x9E3779B1), []
    h, word, inside = np.zeros(size, np.uint32), np.full(size, 77, np.uint32), np.full(size, 0xFFFFFFFF, np.uint32)
    for lag, (b, letter, outside) in enumerate(lags, 1):
        if lag <= max(ORDERS):
            h += b
            h *= prime
            h ^= h >> np.uint32(15)
            if lag in ORDERS:
                out.append((h + np.uint32(lag)) * np.uint32(0x85EBCA6B))
        if lag == 1:
            last, kind = b.astype(np.int64), _KIND.take(b)
        inside &= letter
        inside[outside] = 0
        longer = word + b
        longer *= prime
        longer ^= word
        longer &= inside                                     # the word stays where its beginning was passed
        word ^= longer
    out.append((word ^ (word >> np.uint32(15))) * np.uint32(0xC2B2AE35))
    for c in out:
        c ^= c >> np.uint32(13)
    return out, last, kind


@dataclass
class Decisions:
    """The decisions of a stretch of texts in order of the symbols: which symbol, where in the code."""
    symbol: np.ndarray
    path: np.ndarray
    ends: np.ndarray                       #: of each symbol, the decisions up to its end

    @classmethod
    def of(cls, code: Code, index: np.ndarray) -> Decisions:
        """``index``: of each symbol, the byte before it (plus one) times 257 and itself."""
        length = code.length.take(index)
        ends = np.cumsum(length)
        symbol = np.repeat(np.arange(len(index)), length)
        path = _look(code.first.take(index) - ends + length, symbol)
        path += np.arange(len(path))
        return cls(symbol, path, ends)


def _by_depth(code: Code, symbols: np.ndarray, last: np.ndarray, contexts: list[np.ndarray], slots: list[int],
              kind: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The same decisions where their order does not matter: (depth, kinds, times, of each predictor twice
    the slots plus the branch). Long paths come first, so that a depth is a beginning of the symbols."""
    index = last * (END + 1) + symbols
    length = code.length.take(index)
    order = np.argsort((255 - length).astype(np.uint8), kind="stable")
    first, kind, times = code.first.take(index.take(order)), kind.take(order), times.take(order)
    doubled = [((c & np.uint32(n - 1)) << np.uint32(1)).take(order).astype(np.intp) for c, n in zip(contexts, slots)]
    for depth, n in enumerate((len(length) - np.cumsum(np.bincount(length))).tolist()[:-1]):
        branch = _look(code.branch, first[:n] + depth)
        yield depth, kind[:n], times[:n], [c[:n] ^ branch for c in doubled]


def _look(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries of a table; all places are inside it, and numpy clips faster than it checks."""
    return table.take(at, mode="clip")


def _stretches(texts: pa.Array, run: int | None = None
               ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first text, texts, bytes, symbols, places, bytes to skip): all texts in stretches of about ``run``
    (TEXT_RUN) bytes; a longer text comes in several, which overlap by the reach of the contexts."""
    run = run or TEXT_RUN
    for a, b in runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), run):
        buf, starts = joined(texts.slice(a, b - a))
        ends = np.append(starts[1:], len(buf))
        symbol = buf.astype(np.int16)
        symbol[ends - 1] = END
        place = np.arange(len(buf), dtype=np.int32)
        place -= np.repeat(starts.astype(np.int32), ends - starts)
        if b - a > 1:
            yield a, b - a, buf, symbol, place, 0
            continue
        for at in range(0, len(buf), run):
            low = max(0, at - REACH)
            cut = slice(low, at + run)
            yield a, 1, buf[cut], symbol[cut], place[cut], at - low


def _grams(buf: np.ndarray, symbol: np.ndarray, place: np.ndarray, skip: int) -> Iterator[tuple]:
    """(symbols, last, contexts, kinds, times): the different symbols with all that their contexts see, and
    how often each occurs in the stretch, a few at a time.

    A gram is one number: four pairs of bytes before the symbol, numbered within the stretch, the nearest
    first, and the symbol. Sorted, equal ones are neighbours, and so are those of like contexts. Bytes that
    no context sees are left out. A stretch of too many different pairs is halved."""
    size = len(buf) - skip
    head = np.concatenate((np.full(REACH - min(skip, REACH), OUTSIDE, np.uint8), buf[max(0, skip - REACH):]))
    head[np.flatnonzero(symbol[skip:] == END) + REACH] = OUTSIDE             # the end, and no byte for what comes later
    begun = np.flatnonzero(place[:skip + 1] == 0)[-1:]                       # a text that began among the skipped bytes
    head[:max([0, *(begun + REACH - skip)])] = OUTSIDE
    held = np.zeros(1 << 16, bool)
    held[UNSEEN::256] = True                                                 # of all bytes: nothing is seen before them
    for a in range(0, len(head), GRAM_PIECE):
        held[_byte_pairs(head[a:a + GRAM_PIECE + 1])] = True
    names = np.flatnonzero(held).astype(np.uint16)
    if len(names) > 1 << PAIR_BITS and size > 1:
        middle = skip + size // 2
        low = max(0, middle - REACH)
        yield from _grams(buf[:middle], symbol[:middle], place[:middle], skip)
        yield from _grams(buf[low:], symbol[low:], place[low:], middle - low)
        return
    number, key = np.cumsum(held, dtype=np.uint16) - np.uint16(1), np.empty(size, np.uint64)
    for a in range(0, size, GRAM_PIECE):
        key[a:a + GRAM_PIECE] = _gram_keys(head[a:a + GRAM_PIECE + REACH], number)
    key.sort()
    last = np.flatnonzero(np.append(key[1:] != key[:-1], [True] * (size > 0)))
    key, times = key[last], np.diff(last, prepend=-1).astype(np.int32)
    for a in range(0, len(key), GRAM_PIECE):
        yield *_gram_parts(key[a:a + GRAM_PIECE], names), times[a:a + GRAM_PIECE]


def _byte_pairs(head: np.ndarray) -> np.ndarray:
    """Each byte but the first, and the one before it, as a number."""
    out = head[1:].astype(np.uint16)
    out <<= 8
    out |= head[:-1]
    return out


def _gram_keys(head: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The grams of all symbols of ``head`` but the first REACH; ``number``: of the pairs of bytes."""
    size, coded, breaks = len(head) - REACH, number.take(_byte_pairs(head)), _BREAK.take(head)
    near, mid, far, farthest = (coded[REACH - lag:REACH - lag + size] for lag in range(2, REACH + 1, 2))
    cut = breaks[REACH - 1:-1].copy()
    for lag in range(2, max(ORDERS) + 1):
        cut |= breaks[REACH - lag:-lag]                      # the word began later, and no order reaches further
    far = np.where(cut, number[UNSEEN::256].take(head[REACH - 5:-5]), far)
    cut |= breaks[REACH - 6:-6]
    farthest = np.where(cut, number[UNSEEN], farthest)
    key = _joined_bits(near, mid).astype(np.uint64)
    key <<= np.uint64(2 * PAIR_BITS)
    key |= _joined_bits(far, farthest).astype(np.uint64)
    key <<= np.uint64(8)
    key |= head[REACH:].astype(np.uint64)
    return key


def _joined_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two numbers of pairs as one."""
    out = a.astype(np.uint32)
    out <<= np.uint32(PAIR_BITS)
    out |= b.astype(np.uint32)
    return out


def _gram_parts(key: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Symbols, last bytes, contexts and kinds of grams; ``names``: the pairs by number."""
    def lags() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        inside = np.ones(len(key), bool)
        for k in range(REACH // 2):
            shift = 8 + PAIR_BITS * (REACH // 2 - 1 - k)
            pair = names.take((key >> np.uint64(shift) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.intp))
            for byte in ((pair >> np.uint16(8)).astype(np.uint8), pair.astype(np.uint8)):
                inside &= byte != OUTSIDE
                b = byte.astype(np.uint32)
                b += np.uint32(1)
                b *= inside
                yield b, _LETTER_BITS.take(byte), byte[:0]               # OUTSIDE is no letter, so the word ends there
    contexts, last, kind = _hashed(len(key), lags())
    symbol = (key & np.uint64(255)).astype(np.int64)
    symbol[symbol == OUTSIDE] = END
    return symbol, last, contexts, kind


# ---------------------------------------------------------------- counts

_TABLES = "predictor int, block int, part int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """A block of counts, each in as many bytes (told by the first one) as the greatest takes."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max() < 1 << 8 * w)
    return bytes([width]) + pa.compress(counts.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    counts = pa.decompress(memoryview(raw)[1:], BLOCK * 2 * width, codec="zstd", asbytes=True)
    return np.frombuffer(counts, f"<u{width}").astype(np.int64)


def _count_into(tables: list[np.ndarray], code: Code, buf: np.ndarray, symbol: np.ndarray, place: np.ndarray,
                skip: int) -> None:
    slots = [len(t) // 2 for t in tables]
    for symbols, last, contexts, kind, times in _grams(buf, symbol, place, skip):
        for _, _, often, at in _by_depth(code, symbols, last, contexts, slots, kind, times):
            for table, spots in zip(tables, at):
                np.add.at(table, spots, often)


def _count_tables(shared, slots: list[int]):
    """Task code: how often each slot's branches were taken in the task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, part = shared.value, [np.zeros(n * 2, np.int32) for n in slots], TaskContext.get().partitionId()
        for batch in batches:
            for _, _, *stretch in _stretches(batch.column("text"), GRAM_RUN):
                _count_into(tables, code, *stretch)
        yield from _blocks(tables, part)
        del tables
        give_back()
    return run


def _blocks(tables: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    for predictor, table in enumerate(tables):
        for block, cut in enumerate(table.reshape(-1, BLOCK * 2)):
            if cut.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([predictor], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()),
                     pa.array([_packed(cut)], pa.binary())], ["predictor", "block", "part", "counts"])


def _add_up(fan_in: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        return pa.table({"predictor": first["predictor"], "block": first["block"],
                         "part": pa.array([first["part"][0].as_py() // fan_in], pa.int32()),
                         "counts": pa.array([_packed(sum(_unpacked(c.as_py()) for c in table["counts"]))], pa.binary())})
    return run


def _merged(tables: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, str]:
    """One row a predictor and block, by rounds that add up at most ``fan_in`` rows a group."""
    now, path = written(tables, "lm-tables")
    while (now.agg(F.max("part")).first()[0] or 0) > 0:
        more, more_path = written(now.groupBy("predictor", "block", F.floor(F.col("part") / fan_in))
                                  .applyInArrow(_add_up(fan_in), _TABLES), "lm-tables")
        drop(tables.sparkSession, path)
        now, path = more, more_path
    return now, path


# ---------------------------------------------------------------- mixing

@dataclass
class Model:
    code: Code
    odds: list[np.ndarray]                 #: of each predictor, log odds of branch 1 in steps of 1 / STEP
    weights: np.ndarray                    #: predictors x gates, at the beginning of a text
    words: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()))
    word_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of branch 1 from the counts (slots x 2), rounded to steps."""
    return np.clip(np.rint(np.log((counts[:, 1] + PRIOR) / (counts[:, 0] + PRIOR)) * STEP), -127, 127).astype(np.int8)


def _gates(code: Code, d: Decisions, gate: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Each decision's row of the weights, from its symbol's first one; ``word``: what the word's table says in steps."""
    out = _look(gate, d.symbol)
    out += _look(code.row, d.path)
    out += (word != 0).view(np.int8) + (np.abs(word) > LITTLE).view(np.int8)
    return out


def _block_edges(size: int) -> np.ndarray:
    """The places of a text of ``size`` symbols where its blocks begin, and one beyond its end."""
    early = FIRST_BLOCK * ((1 << np.arange(int(np.log2(MOST_BLOCK // FIRST_BLOCK)) + 1)) - 1)
    return np.append(early, np.arange(early[-1] + MOST_BLOCK, max(size, early[-1]) + MOST_BLOCK + 1, MOST_BLOCK))


def _mix(x: list[np.ndarray], weights: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost (nats) of each decision and the probability of the other branch, from its inputs (positive ones
    speak for that other branch) and its row of the weights."""
    e = x[0] * _look(weights[0], row)
    for inputs, w in zip(x[1:], weights[1:]):
        e += inputs * _look(w, row)
    np.exp(e, out=e)                                     # odds of the branch that was not taken
    whole = e + np.float32(1)
    e /= whole
    return np.log(whole, out=whole), e


def _step(weights: np.ndarray, row: np.ndarray, x: list[np.ndarray], error: np.ndarray) -> None:
    """One gradient step of the weights (predictors x rows) that the decisions used."""
    count = np.bincount(row, minlength=weights.shape[1])
    rate = np.minimum(RATE, FAR / np.maximum(count, 1))
    for k in range(len(weights)):
        weights[k] -= rate * np.bincount(row, error * x[k], weights.shape[1])


class Reader:
    """Costs of texts that come in stretches, with weights of their own for each text."""

    def __init__(self, model: Model):
        self.model = model
        # the slots of all predictors side by side in one number
        bits = [len(odds).bit_length() - 1 for odds in model.odds]
        self.shifts = [sum(bits[:k]) for k in range(PREDICTORS)]
        self.nodes = np.bitwise_or.reduce([model.code.hashed << shift for shift in self.shifts])

    def _inputs(self, d: Decisions, contexts: np.ndarray) -> Iterator[np.ndarray]:
        """What each predictor says of the decisions."""
        slots = _look(contexts, d.symbol)
        slots ^= _look(self.nodes, d.path)
        for odds, shift in zip(self.model.odds, self.shifts):
            at = slots >> shift
            at &= len(odds) - 1
            yield _look(odds, at)

    def cost(self, first: int, texts: int, buf: np.ndarray, symbol: np.ndarray, place: np.ndarray, skip: int) -> np.ndarray:
        """Nats of each text of a stretch (a longer text's stretches follow each other).

        Symbols are put in order of block and text, so that every block of all texts is one
        run of decisions."""
        model = self.model
        if place[0] == 0:
            self.weights = np.tile(model.weights.astype(np.float32), texts)       # predictors x (text, gate)
        hashes, last, kind = _contexts(buf, place, skip)
        place, index = place[skip:], last * (END + 1) + symbol[skip:]
        contexts = np.zeros(len(place), np.int64)
        for c, odds, shift in zip(hashes, model.odds, self.shifts):
            contexts |= (c & np.uint32(len(odds) - 1)).astype(np.int64) << shift
        begin = np.flatnonzero(place == 0) if texts > 1 else -place[:1].astype(np.int64)
        size = np.append(begin[1:], len(place)) - begin
        # runs of a text's symbols of a block, by block and text
        edges = _block_edges(size.max())[:, None]
        low, high = np.maximum(begin + edges[:-1], 0), begin + np.minimum(edges[1:], size)
        block, text = np.nonzero(low < high)
        low, many = low[block, text], (high - low)[block, text]
        until = np.cumsum(many)
        gate = kind * (DEPTHS * TRUSTS)
        if texts > 1:
            order = np.repeat(low - until + many, many)
            order += np.arange(len(order))
            index, gate, contexts = (_look(v, order) for v in (index, gate, contexts))
        d = Decisions.of(model.code, index)
        x = list(self._inputs(d, contexts))
        row = _gates(model.code, d, gate + np.repeat(text * GATES, many), x[-1])
        other = _look(model.code.other, d.path)
        x = [inputs * other for inputs in x]
        ends, out = np.append(0, d.ends[until - 1]), np.zeros(texts)             # of the runs, in decisions
        for a, b in _bounds(block):
            spot = slice(ends[a], ends[b])
            xs = [inputs[spot] for inputs in x]
            cost, error = _mix(xs, self.weights, row[spot])
            out[text[a:b]] += np.add.reduceat(cost.astype(np.float64), ends[a:b] - ends[a])
            _step(self.weights, row[spot], xs, error)
        return out


def _bounds(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    edges = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)])).tolist()
    return list(zip(edges, edges[1:]))


# ---------------------------------------------------------------- first weights

def _levels(counts: np.ndarray) -> np.ndarray:
    """What the counts (slots x 2), less the decision itself, say for each branch when it is taken, as a level."""
    own, other = np.maximum(counts - 1, 0) + PRIOR, counts[:, ::-1] + PRIOR
    return _LEVEL[np.clip(np.rint(np.log(own / other) * STEP), -127, 127).astype(np.int64) + 127].astype(np.uint8).ravel()


def _see(seen: np.ndarray, code: Code, levels: list[np.ndarray], buf: np.ndarray, symbol: np.ndarray,
         place: np.ndarray, skip: int) -> None:
    """Count all decisions of a stretch by kind, depth and the predictors' levels."""
    slots = [len(t) // 2 for t in levels]
    for symbols, last, contexts, kind, times in _grams(buf, symbol, place, skip):
        for depth, kinds, often, at in _by_depth(code, symbols, last, contexts, slots, kind, times.astype(np.int64)):
            spot = kinds * np.int32(DEPTHS) + np.int32(min(depth, DEPTHS - 1))
            for table, spots in zip(levels, at):
                spot *= np.int32(LEVELS)
                spot += _look(table, spots)
            np.add.at(seen, spot, often)


def _seen_tables(shared):
    """Task code: the task's decisions by kind, depth and levels, in blocks as those of the counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (code, levels), seen, part = shared.value, np.zeros(SEEN, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for _, _, *stretch in _stretches(batch.column("text"), GRAM_RUN):
                _see(seen, code, levels, *stretch)
        yield from _blocks([seen], part)
        give_back()
    return run


def _fit(seen: np.ndarray) -> np.ndarray:
    """First weights (predictors x gates): least cost of all decisions seen, by Newton steps."""
    spots = np.flatnonzero(seen)
    gate, *level = np.unravel_index(spots, (SEEN // LEVELS ** PREDICTORS, *[LEVELS] * PREDICTORS))
    away = np.abs(level[-1] - len(_EDGES))
    row = gate * TRUSTS + (away > 0) + (away > np.searchsorted(_EDGES, LITTLE, "right"))
    x, times = [_MIDDLE[v] / STEP for v in level], seen[spots].astype(float)
    weights = np.full((PREDICTORS, GATES), START)
    for _ in range(NEWTON):
        error = 1 / (1 + np.exp(np.clip(sum(v * w[row] for v, w in zip(x, weights)), -60, 60)))
        slope = np.array([np.bincount(row, times * error * v, GATES) for v in x]) - HOLD * (weights - START)
        bend = np.array([[np.bincount(row, times * error * (1 - error) * v * u, GATES) for u in x] for v in x])
        step = np.linalg.solve(bend.transpose(2, 0, 1) + HOLD * np.eye(PREDICTORS), slope.T[..., None])[..., 0].T
        weights += np.clip(step, -NEWTON_FAR, NEWTON_FAR)
    return weights


# ---------------------------------------------------------------- Spark side

def _pairs(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each symbol stands behind each byte or a beginning, a few bytes at a time."""
    out, ends = np.zeros((END + 1) ** 2, np.int64), np.append(starts[1:], len(buf)) - 1
    for at in range(0, len(buf), PAIR_RUN):
        cut = buf[at:at + PAIR_RUN]
        last, symbol = np.ones(len(cut), np.intp), cut.astype(np.intp)
        last[1:] += cut[:-1]
        last[0] += buf[max(at - 1, 0)]                                # the first byte of all is a beginning
        for places, values, value in ((starts, last, 0), (ends, symbol, END)):
            values[places[slice(*np.searchsorted(places, (at, at + len(cut))))] - at] = value
        last *= END + 1
        last += symbol
        out += np.bincount(last, minlength=len(out))
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs, and each symbol behind each byte."""
    for batch in batches:
        text = batch.column("text")
        for a, b in runs(pc.fill_null(pc.binary_length(text), 0).to_numpy(), WORD_RUN):
            buf, starts = joined(text.slice(a, b - a))
            words = words_of(buf, starts, _WHITE)
            count, names = np.bincount(words.code, minlength=len(words.names)), words.names
            held = np.flatnonzero(count)
            del words
            pairs = _pairs(buf, starts)
            some = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(held)).cast(pa.string()), pa.nulls(len(held), pa.int32()),
                 pa.array(count[held].astype(np.int64))], ["word", "pair", "f"])
            del names
            give_back()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(pairs[some].astype(np.int64))],
                ["word", "pair", "f"])


def _numbers(names: pa.Array, words: pa.Array) -> np.ndarray:
    """Of each name its place among ``words``, or -1; both without repeats. The names, which are
    fewer, are what gets hashed."""
    out, at = np.full(len(names), -1, np.int64), pc.index_in(words, value_set=names)
    held = pc.is_valid(at).to_numpy(zero_copy_only=False)
    out[at.drop_null().to_numpy()] = np.flatnonzero(held)
    return out


_SCORED = "cost double, n_bytes long, n_words long, head_known long, head_log double, " \
          "tail array<struct<word:string,n:long>>"


def _score(shared):
    """Task code: a text's cost, and what its frequent words add; the other words as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        logs = np.log10(model.word_counts + 1.0)
        for batch in batches:
            text = batch.column("text")
            cost, reader = np.zeros(len(text)), Reader(model)
            for first, texts, *stretch in _stretches(text):
                cost[first:first + texts] += reader.cost(first, texts, *stretch)
            give_back()
            for a, b in runs(pc.fill_null(pc.binary_length(text), 0).to_numpy(), WORD_RUN):
                buf, starts = joined(text.slice(a, b - a))
                words, texts = words_of(buf, starts, _WHITE), b - a
                known = _numbers(words.names, model.words)[words.code]
                head = known >= 0
                key, times = np.unique(words.doc[~head] * np.int64(len(words.names) + 1) + words.code[~head], return_counts=True)
                of, code = np.divmod(key, len(words.names) + 1)
                ends = np.searchsorted(of, np.arange(texts + 1)).astype(np.int32)
                tail = pa.StructArray.from_arrays([words.names.take(pa.array(code)).cast(pa.string()),
                                                   pa.array(times.astype(np.int64))], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, texts), pa.array(cost[a:b]),
                     pa.array((np.append(starts[1:], len(buf)) - starts - 1).astype(np.int64)),
                     pa.array(np.bincount(words.doc, minlength=texts).astype(np.int64)),
                     pa.array(np.bincount(words.doc[head], minlength=texts).astype(np.int64)),
                     pa.array(np.bincount(words.doc[head], logs[known[head]], texts).astype(np.float64)),
                     pa.ListArray.from_arrays(pa.array(ends), tail)],
                    ["doc_id", "cost", "n_bytes", "n_words", "head_known", "head_log", "tail"])
    return run


def _head(words: DataFrame) -> pa.Table:
    """The most frequent words and their counts: whole levels of counts (32 a doubling), as many as
    HEAD_WORDS holds. Nothing is sorted, and no task sees more than its own words."""
    short = words.where(F.octet_length("word") <= HEAD_BYTES).select("word", "f", F.floor(F.log2("f") * 32).alias("level"))
    room, least = HEAD_WORDS, None
    for r in sorted(short.groupBy("level").count().collect(), reverse=True):              # 2,016 levels at most
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    return short.where(F.col("level") >= F.lit(least)).select("word", "f").toArrow()


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """The model of the training ``texts`` (text) with their ``counts`` (word, pair, f)."""
    spark = texts.sparkSession
    pairs = np.zeros((END + 1, END + 1))
    for r in counts.where(F.col("pair").isNotNull()).toArrow().to_pylist():            # 257 x 257 rows at most
        pairs.ravel()[r["pair"]] = r["f"]
    code = Code.of(pairs)
    wanted = 1 << int(pairs.sum() / BYTES_A_SLOT).bit_length()
    slots = [min(most, max(LEAST_SLOTS, wanted)) for most in MOST_SLOTS]
    tables, path = _merged(texts.mapInArrow(_count_tables(spark.sparkContext.broadcast(code), slots), _TABLES))
    odds, levels = [], []
    for predictor, size in enumerate(slots):
        odds.append(np.zeros(size, np.int8))
        levels.append(np.full(size * 2, len(_EDGES), np.uint8))
        for r in tables.where(F.col("predictor") == predictor).toArrow().to_pylist():     # MOST_SLOTS bound it
            at, total = r["block"] * BLOCK, _unpacked(r["counts"]).reshape(-1, 2)
            odds[-1][at:at + BLOCK] = _odds(total)
            levels[-1][at * 2:(at + BLOCK) * 2] = _levels(total)
    drop(spark, path)
    shared = spark.sparkContext.broadcast((code, levels))
    tables, path = _merged(texts.mapInArrow(_seen_tables(shared), _TABLES))
    seen = np.zeros(SEEN, np.int64)
    for r in tables.toArrow().to_pylist():                                                # SEEN bounds it
        seen[r["block"] * BLOCK * 2:(r["block"] + 1) * BLOCK * 2] = _unpacked(r["counts"])
    drop(spark, path)
    shared.unpersist()
    return Model(code, odds, _fit(seen))


def score_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row a row.

    Learns from the rows whose crc32 of the id modulo 7 is not 2. ``score`` is
    the log10 probability of the whole lower-cased text with its end,
    ``bits_per_byte`` what that is in bits over its bytes (and the end). Null
    texts count as empty and score their end alone; repeated rows are trained on
    and scored as often as they stand there; a text of any length is read whole;
    without training rows every decision costs a bit and no word is known.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held_out = doc_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    texts = thin.where(~held_out).select("text")
    counts, _ = written(texts.mapInArrow(_count_words, "word string, pair int, f long")
                                  .groupBy("word", "pair").agg(F.sum("f").alias("f")), "lm-words")
    documents = thin.where(~held_out).count()
    words = counts.where(F.col("word").isNotNull())
    total, distinct = words.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count("*")).first()
    total, distinct = total + documents, distinct + (documents > 0)
    model = train(texts, counts)
    head = _head(words)
    model.words = head["word"].combine_chunks().cast(pa.large_string())
    model.word_counts = head["f"].to_numpy()
    scored, _ = written(thin.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {id_type}, {_SCORED}")
                        .withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = (scored.select("row", F.inline("tail")).join(words.select("word", "f"), "word").groupBy("row")
            .agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("f") + 1.0)).alias("tail_log")))
    tokens = F.col("n_words") + 1                                # the end is a token
    whole = scored.drop("tail").join(tail, "row", "left")
    found = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + F.log10(F.lit(documents + 1.0))
    return whole.select(
        "doc_id", held_out.alias("held_out"), tokens.alias("n_tokens"),
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(documents > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (found - tokens * F.log10(F.lit(total + distinct + 1.0))).alias("base_score"),
        (-F.col("cost") / np.log(10.0)).alias("score"),
        (F.col("cost") / np.log(2.0) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
