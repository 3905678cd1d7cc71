"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-cased words; in scripts without spaces every
character is a word. Documents and test items are joined
on shared five-word seeds; for each pair that shares any, greedy string
tiling (Wise's running Karp-Rabin form) covers the item with the longest
matches that do not overlap in the item nor in the document, in whatever
order they come, down to ``MIN_MATCH`` words. A document is contaminated by an
item if the tiles cover at least ``MIN_COVERAGE`` of the item's words, so a
passage whose sentences were put in another order is caught too.

An item of ``SHORT_LEAST`` to four words is its own seed: it matches where it
stands whole. Shorter ones are too common to tell a copy from chance and match
nothing.

The item side is held in blocks of at most ``BLOCK_BYTES`` bytes of text (plus
the item that crosses the mark); each block is broadcast and the documents are
scanned once a block, without a shuffle. A tile contains a seed, so only the
parts of a document that seeds cover enter the tiling.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from candlewick.llm.common import fresh, give_back
from candlewick.llm.prefix import running

MIN_MATCH = 5
MIN_COVERAGE = 0.5
SHORT_LEAST = 3
BLOCK_BYTES = 16 << 20
#: Length with which the search for tiles starts.
FIRST_LENGTH = 20

#: Characters of scripts without spaces (Thai to Khmer, kana, Han): each is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``length`` ids (modulo 2 ** 64)."""
    ids = ids.astype(np.uint64)
    out = np.zeros(max(0, len(ids) - length + 1), np.uint64)
    for k in range(length):
        out = out * _BASE + ids[k:k + len(out)]
    return out


def _free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` without a marked position."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return np.nonzero(total[length:] == total[:-length])[0] if len(marked) >= length else np.zeros(0, np.int64)


def _scan(pattern, text, taken_p, taken_t, length):
    """Maximal unmarked matches of at least ``length``: (size, start in pattern, start in text)."""
    starts = defaultdict(list)
    hashes = _rolling(text, length)
    for t in _free_windows(taken_t, length).tolist():
        starts[int(hashes[t])].append(t)
    hashes = _rolling(pattern, length)
    p_list, t_list = pattern.tolist(), text.tolist()
    found = []
    for p in _free_windows(taken_p, length).tolist():
        for t in starts.get(int(hashes[p]), ()):
            if p and t and not taken_p[p - 1] and not taken_t[t - 1] and p_list[p - 1] == t_list[t - 1]:
                continue                       # part of the match that began one word earlier
            n = 0
            while (p + n < len(p_list) and t + n < len(t_list) and p_list[p + n] == t_list[t + n]
                   and not taken_p[p + n] and not taken_t[t + n]):
                n += 1
            if n >= length:
                found.append((n, p, t))
    return found


def greedy_string_tiling(pattern: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), longest first (ties: earliest).

    Ids below zero match nothing. Every pass marks the longest matches there
    are; the search length falls from the longest match to ``least``.
    """
    taken_p, taken_t = pattern < 0, text < 0
    tiles = []
    length = max(least, FIRST_LENGTH)
    while True:
        found = _scan(pattern, text, taken_p, taken_t, length)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * length:               # much longer than searched for: start there
            length = longest
            continue
        again = False
        for n, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not taken_p[p:p + n].any() and not taken_t[t:t + n].any():
                taken_p[p:p + n] = taken_t[t:t + n] = True
                tiles.append((p, t, n))
            else:
                again = True                   # what is left of an overlapped match may still be long
        if again and any(n >= length for n, _, _ in _scan(pattern, text, taken_p, taken_t, length)):
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


class Matcher:
    """Test items of one block, indexed by their seeds."""

    def __init__(self, items: list[tuple[object, str | None]]):
        split = [(key, words_of(text)) for key, text in items]
        self.short: dict[int, dict[tuple[str, ...], list]] = {}       # words -> the items that consist of them
        for key, words in split:
            if SHORT_LEAST <= len(words) < MIN_MATCH:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(key)
        split = [(key, words) for key, words in split if len(words) >= MIN_MATCH]
        self.keys = [key for key, _ in split]
        self.vocabulary: dict[str, int] = {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
                      for _, words in split]
        seeds = [_rolling(ids, MIN_MATCH) for ids in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds] or [np.zeros(0, np.int64)])
        flat = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.seeds, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))

    def matches(self, text: str | None) -> list[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """(item key, item words, covered words, tiles (document word, item word, length))
        of the items that cover enough."""
        words = words_of(text)
        return self._whole(words) + self._tiled(words)

    def _whole(self, words: list[str]) -> list[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """The short items that stand whole in the text, at their first place."""
        out = []
        for n, items in self.short.items():
            first = {}
            for at, run in enumerate(zip(*[words[k:] for k in range(n)])):
                if run in items:
                    first.setdefault(run, at)
            out += [(key, n, n, [(at, 0, n)]) for run, at in first.items() for key in items[run]]
        return out

    def _tiled(self, words: list[str]) -> list[tuple[object, int, int, list[tuple[int, int, int]]]]:
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        if len(ids) < MIN_MATCH or not len(self.seeds):
            return []
        starts = _free_windows(ids == 0, MIN_MATCH)
        hashes = _rolling(ids, MIN_MATCH)[starts]
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        hit = self.seeds[at] == hashes
        shared = defaultdict(lambda: ([], []))             # item -> seed places in document and item
        for d, s in zip(starts[hit].tolist(), at[hit].tolist()):
            for k in range(self.first[s], self.last[s]):
                places = shared[int(self.owner[k])]
                places[0].append(d), places[1].append(int(self.place[k]))
        out = []
        span = np.arange(MIN_MATCH)
        for item, (in_doc, in_item) in sorted(shared.items()):
            pattern = self.items[item]
            need = MIN_COVERAGE * len(pattern)
            if len(np.unique(np.add.outer(in_item, span))) < need:      # no tiling can cover more
                continue
            spots = np.unique(np.add.outer(in_doc, span))
            gaps = np.nonzero(np.diff(spots) > 1)[0] + 1
            spots = np.insert(spots, gaps, -1)
            tiles = greedy_string_tiling(pattern, np.where(spots < 0, -1, ids[spots]))
            covered = sum(n for _, _, n in tiles)
            if covered >= need:
                out.append((self.keys[item], len(pattern), covered,
                            [(int(spots[t]), p, n) for p, t, n in tiles]))
        return out


def matchers(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator:
    """A broadcast matcher for each block of test items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"),
                             F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    total = items.agg(F.sum("bytes")).first()[0] or 0
    if total <= BLOCK_BYTES:
        blocks = [items]
    else:
        numbered = running(items, [F.col("item_id"), F.col("text")], {"before": "bytes"}) \
            .withColumn("block", F.expr(f"before div {BLOCK_BYTES}"))
        blocks = [numbered.where(F.col("block") == b) for b in range(-(-total // BLOCK_BYTES))]
    for block in blocks:
        rows = block.select("item_id", "text").orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Matcher([(r.item_id, r.text) for r in rows]))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles) of every pair of
    document and test item whose coverage is ``MIN_COVERAGE`` or more.

    ``tiles`` lists (document word, item word, length), longest first. Null
    and empty texts and items under ``SHORT_LEAST`` words match nothing, texts of
    any length are tiled whole; of tiles that are equally long the first in the
    item is taken; repeated documents and items give their rows as often as
    they occur; ids may be of any type; other columns are not read; if either
    table is empty, so is the result.
    """
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    doc_type = thin.schema["doc_id"].dataType.simpleString()
    item_type, item_kind = (f(benchmark.schema[item_id].dataType) for f in (lambda t: t.simpleString(), to_arrow_type))
    schema = (f"doc_id {doc_type}, item_id {item_type}, item_words int, covered_words int, coverage double, "
              "tiles array<struct<doc_word:int,item_word:int,length:int>>")
    tile = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("length", pa.int32())]))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, m) for i, t in enumerate(batch.column("text"))
                        for m in shared.value.matches(t.as_py())]
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([i for i, _ in rows], pa.int64())),
                     pa.array([m[0] for _, m in rows], item_kind), pa.array([m[1] for _, m in rows], pa.int32()),
                     pa.array([m[2] for _, m in rows], pa.int32()),
                     pa.array([m[2] / m[1] for _, m in rows], pa.float64()),
                     pa.array([[dict(zip(("doc_word", "item_word", "length"), x)) for x in m[3]]
                               for _, m in rows], tile)],
                    ["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"])
        return run

    out = None
    for shared in matchers(benchmark, item_id, item_text):
        part = thin.mapInArrow(scan(shared), schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that any test item contaminates; columns unchanged.

    Null and empty texts stay, repeated rows stay or go together, other columns
    are passed on whatever their names; an empty table of either kind drops nothing."""
    def flag(shared):
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            out = pd.Series([bool(shared.value.matches(t)) for t in texts], dtype=bool)
            give_back()
            return out
        return run
    for shared in matchers(benchmark, item_id, item_text):
        name = fresh(docs, "contaminated")
        docs = docs.withColumn(name, flag(shared)(F.col(text))).where(~F.col(name)).drop(name)
    return docs
