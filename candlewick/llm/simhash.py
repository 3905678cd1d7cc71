"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has one bit per position that is set in more than
half of its shingle hashes. Two fingerprints at most three bits apart are
linked. Emitting the whole radius-2 ball (2,081 variants a fingerprint) on
both sides would cover distance three, but shuffles two thousand rows a
document. Instead each fingerprint emits its radius-1 ball four times, each
time with one 16-bit block masked out: 4 x (1 + 48) = 196 rows. Two
fingerprints that differ

* in no more than two bits meet in a bucket whose masked block is equal,
* in three bits spread over two or three blocks meet in a bucket whose masked
  block differs in one bit and whose visible bits differ in two,
* in three bits of one block meet, both unflipped, in that block's bucket.

So every link is found in one of three places of a bucket, all of which are
looked up (never enumerated as pairs): equal masked block, masked block one
flip away, or unflipped members at most three flips away. Each found link is
verified by its Hamming distance, and a task passes on only the links that
join two groups it has not joined before (a spanning forest keeps every
component). A bucket holds distinct fingerprints, at most 49 x 65,536.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import fresh, give_back, written
from candlewick.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BLOCKS = 4
BLOCK_BITS = 16
#: Forest entries a task keeps before it starts a new forest (bounds its memory).
FOREST_ENTRIES = 500_000

_LANES = np.uint64(0x0101010101010101)


def _count_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have bit i set, for i in 0..63: eight byte lanes at a
    time, summed over runs of 255 so that no lane overflows."""
    out = np.zeros(64, np.int64)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & _LANES
        runs = np.add.reduceat(lanes, np.arange(0, len(lanes), 255))
        out[bit::8] = runs.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64-bit SimHash of the text's word shingles; null or wordless text gives 0.

    ``bytes.lower`` folds A-Z only and ``bytes.split`` splits on exactly space
    and the control characters 0x09-0x0D.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in
                       zip(starts[:len(tokens) - width + 1].tolist(), ends[width - 1:].tolist())],
                      np.uint64)
    bits = _count_bits(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit column."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
        give_back()
        return pd.Series(values.view(np.int64))
    return run(text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _ball(fp: Column) -> Column:
    """The 196 (block, variant) pairs of a fingerprint: one block masked, at most one
    visible bit flipped."""
    entries = []
    for block in range(BLOCKS):
        keep = ~(((1 << BLOCK_BITS) - 1) << (block * BLOCK_BITS)) & ((1 << 64) - 1)
        flips = [0] + [1 << b for b in range(64) if b // BLOCK_BITS != block]
        entries += [F.struct(F.lit(block).cast("byte").alias("block"),
                             F.lit(_signed(keep)).cast("long").alias("keep"),
                             F.lit(_signed(flip)).cast("long").alias("flip")) for flip in flips]
    return F.explode(F.array(*entries))


class _Forest:
    """Union-find over the links a task has passed on."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x], x = top, up
        return top

    def joins(self, a: int, b: int) -> bool:
        if len(self.parent) > FOREST_ENTRIES:
            self.parent.clear()
        ra, rb = self._root(a), self._root(b)
        if ra == rb:
            return False
        self.parent.setdefault(ra, ra)
        self.parent[rb] = ra
        return True


_NEAR = np.array([sum(1 << b for b in bits) for n in range(1, MAX_BITS + 1)
                  for bits in combinations(range(BLOCK_BITS), n)], np.uint64)
_FLIPS = np.array([1 << b for b in range(BLOCK_BITS)], np.uint64)


def bucket_links(block: int, variant: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct fingerprints of one bucket that keep it connected as far
    as fingerprints at most three bits apart connect it."""
    members = np.sort(members)
    shift = np.uint64(block * BLOCK_BITS)
    low = np.uint64((1 << BLOCK_BITS) - 1)
    hidden = (members >> shift) & low
    values, first, back = np.unique(hidden, return_index=True, return_inverse=True)
    heads = members[first]                      # smallest member of each masked value
    left, right = [heads[back]], [members]
    found = np.searchsorted(values, values[:, None] ^ _FLIPS)   # masked values one flip away
    flipped = values[:, None] ^ _FLIPS
    hit = (values[np.minimum(found, len(values) - 1)] == flipped) & (flipped > values[:, None])
    i, k = np.nonzero(hit)
    left.append(heads[i]), right.append(heads[found[i, k]])
    exact = (members & ~(low << shift)) == np.uint64(variant)
    centres, spots = members[exact], hidden[exact]              # distinct masked values, ascending
    if len(centres) > 1:
        if len(centres) <= len(_NEAR):
            near = np.bitwise_count(spots[:, None] ^ spots) <= MAX_BITS
            i, k = np.nonzero(np.triu(near, 1))
            left.append(centres[i]), right.append(centres[k])
        else:
            for mask in _NEAR:
                at = np.minimum(np.searchsorted(spots, spots ^ mask), len(spots) - 1)
                i = np.nonzero((spots[at] == spots ^ mask) & (spots[at] > spots))[0]
                left.append(centres[i]), right.append(centres[at[i]])
    a, b = np.concatenate(left), np.concatenate(right)
    true = (a != b) & (np.bitwise_count(a ^ b) <= MAX_BITS)
    return a[true], b[true]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets in rows sorted by (block, variant)."""
    forest = _Forest()
    held: tuple[np.ndarray, ...] | None = None

    def bucket_edges(blocks, variants, fps, bounds):
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= MAX_BITS]
        found = [(fps[near], fps[near + 1])]
        for s, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist()):
            found.append(bucket_links(int(blocks[s]), int(variants[s]), fps[s:s + n]))
        kept = [(x, y) for a, b in found for x, y in zip(a.tolist(), b.tolist()) if forest.joins(x, y)]
        ends = np.array(kept, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["u", "v"])

    for batch in batches:
        cols = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64),
                batch.column(2).to_numpy().view(np.uint64))
        if held is not None:
            cols = tuple(np.concatenate(x) for x in zip(held, cols))
        blocks, variants, fps = cols
        if not len(fps):
            continue
        starts = np.concatenate(([0], np.nonzero((np.diff(blocks) != 0) | (np.diff(variants) != 0))[0] + 1))
        yield bucket_edges(blocks, variants, fps, starts)     # all but the last, still open bucket
        held = tuple(x[starts[-1]:] for x in cols)
    if held is not None:
        yield bucket_edges(*held, np.array([0, len(held[2])]))


def fingerprint_links(fps: DataFrame, column: str = "fp") -> DataFrame:
    """(u, v): verified links (distance 1..3) among distinct fingerprints, enough of
    them to connect every component."""
    variants = (fps.select(F.col(column).alias("fp"), _ball(F.col(column)).alias("e"))
                .select(F.col("e.block").alias("block"),
                        (F.col("fp").bitwiseAND(F.col("e.keep")))
                        .bitwiseXOR(F.col("e.flip")).alias("variant"), "fp"))
    return (variants.repartition("block", "variant").sortWithinPartitions("block", "variant")
            .mapInArrow(_links, "u long, v long"))


def component_map(prints: DataFrame, doc_id: str, fp: str) -> DataFrame:
    """(fp, root, component_id, members): one row per distinct fingerprint."""
    classes, _ = written(prints.groupBy(F.col(fp).alias("fp"))
                         .agg(F.min(doc_id).alias("low"), F.count("*").alias("copies")), "classes")
    roots = connected_components(fingerprint_links(classes))
    rooted, _ = written(classes.join(roots, classes.fp == roots.vertex, "left")
                        .select("fp", "low", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    tops = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("members"))
    return written(rooted.join(tops, "root").select("fp", "root", "component_id", "members"), "components")[0]


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id, members), one row per input row.

    * ``fingerprint``: 16 lowercase hex digits; a null, empty or wordless text
      has fingerprint zero and is linked like any other.
    * ``component_id``: smallest non-null doc_id reachable over links of at
      most three differing bits (null if a component has only null ids).
    * Repeated rows come back as often as they went in; other columns of
      ``docs`` are not read, so their names never clash; an empty table gives
      an empty result.
    """
    prints, _ = written(docs.select(F.col(doc_id).alias("doc_id"),
                                    fingerprint_column(F.col(text), words).alias("fp")), "prints")
    return (prints.join(component_map(prints, "doc_id", "fp"), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id", "members"))


def _row_hash(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row (nulls and their places count)."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields]
    cols = [F.map_entries(c) if f.dataType.typeName() == "map" else c
            for c, f in zip(cols, docs.schema.fields)]
    marks = F.array(*[c.isNull() for c in cols])
    return [F.xxhash64(marks, *cols), F.xxhash64(F.lit("row"), marks, *cols)]


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row per near-duplicate component: its smallest doc_id
    (nulls last), ties by a hash of the whole row.

    Winners are decided on thin rows (id, fingerprint, row hash). Equal rows
    are cut to one by a rank-one window, which Spark applies within each task
    before the shuffle too, so a row that makes up a third of the table
    travels as one row a task; the winners then join on the row hash, which
    is unique by then. Texts are shuffled once. Columns of ``docs`` keep their
    names, order and types; an empty table gives an empty result.
    """
    h1, h2, rank = (fresh(docs, x) for x in ("row_hash", "row_hash_two", "row_rank"))
    first, second = _row_hash(docs)
    thin, _ = written(docs.select(F.col(doc_id).alias("doc_id"), first.alias("h1"), second.alias("h2"),
                                  fingerprint_column(F.col(text), words).alias("fp")), "prints")
    groups = component_map(thin, "doc_id", "fp").select("fp", "root")
    winners = (thin.join(groups, "fp").groupBy("root")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")).alias("w"))
               .select(F.col("w.h1").alias(h1), F.col("w.h2").alias(h2)))
    one = Window.partitionBy(h1, h2).orderBy(F.lit(0))
    return (docs.withColumns({h1: first, h2: second})
            .withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
            .join(winners, [h1, h2], "left_semi").select(*[f"`{c}`" for c in docs.columns]))
