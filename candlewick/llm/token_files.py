"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0 for the most frequent), and
ranks are stored with one to four bytes each, little-endian. The lengths are
kept apart from the data in control bytes, two bits an id, four ids a control
byte; numpy decodes them through a 256-entry table of length quadruples.

A token folder holds Parquet tables, so that any Hadoop store and Spark's own
commit protocol keep them whole when executors are lost:

* ``ids/``: one row a document in ascending doc_id order (``part`` and
  ``before``, the ids of the same part in front of it, then ``doc_id``,
  ``n_tokens``, ``control``, ``data``);
* ``parts/``: how many ids each part holds; a part's first id comes after all
  ids of the parts before it;
* ``ranks/``: the id of each rank.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.common import drop, give_back, written
from candlewick.session import scratch_path

END_ID = 0
#: Bytes of words and ids that a Python worker remembers, behind a space and otherwise: two
#: generations of this many; what an entry takes besides its word and ids.
SPACED_BYTES, PLAIN_BYTES, ENTRY = 24 << 20, 6 << 20, 150
#: Characters of text whose words are looked up together; words, and ids, handled at a time
#: (few enough for the arrays to stay in a core's cache).
TEXT_RUN, WORD_RUN, ID_RUN = 8_000_000, 40_000, 100_000

# ---------------------------------------------------------------- byte coding

#: The four lengths (1 to 4) that each control byte stands for, lowest bits first.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each number when every document's are padded to a multiple of four;
    control bytes of each document."""
    quads = -(-counts // 4)
    shift = (np.cumsum(quads) - quads) * 4 - (np.cumsum(counts) - counts)
    return np.arange(counts.sum()) + np.repeat(shift, counts), quads


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to): neighbours that hold about ``most`` together, at least one each."""
    at = 0
    while at < len(sizes):
        to, room = at, most
        while to < len(sizes) and (room > 0 or to == at):
            room -= sizes[to]
            to += 1
        yield at, to
        at = to


def _joined(column: pa.Array, dtype) -> np.ndarray:
    """The values of a binary column end to end, without copies."""
    if not len(column):
        return np.zeros(0, dtype)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]].view(dtype) if raw else np.zeros(0, dtype)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces (``sizes`` in bytes) of ``values``."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control bytes and data bytes of each document, from the unsigned 32-bit numbers
    of all documents end to end and how many each has."""
    ranks, counts = np.ascontiguousarray(ranks, "<u4"), np.asarray(counts, np.int64)
    size = np.ones(len(ranks), np.uint8)
    for top in (0xFF, 0xFFFF, 0xFFFFFF):
        size += ranks > top
    place, quads = _padded(counts)
    codes = np.zeros(quads.sum() * 4, np.uint8)
    codes[place] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    data = np.empty(ends[-1], np.uint8)
    data[ends[:-1]] = ranks.astype(np.uint8)          # the lowest byte
    for k in (1, 2, 3):
        longer = np.nonzero(size > k)[0]
        data[ends[longer] + k] = (ranks[longer] >> np.uint32(8 * k)).astype(np.uint8)
    last = np.cumsum(counts)
    return _binary(control, quads), _binary(data, ends[last] - ends[last - counts])


def decode_ranks(control: pa.Array, data: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The numbers of all documents end to end."""
    place, _ = _padded(np.asarray(counts, np.int64))
    size = LENGTHS[_joined(control, np.uint8)].ravel()[place]
    raw = _joined(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.nonzero(size > k)[0]
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---------------------------------------------------------------- tokenizer

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters (Latin up to U+024F), ASCII marks but the apostrophe, perhaps a line end and the like again.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)(?:\n([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*))?")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on.
_ALPHABET = {b: b for b in _PRINTABLE} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class _Memory:
    """Word -> ids: what was met lately, in two generations of ``room`` bytes."""

    def __init__(self, encode, room: int):
        self.encode, self.room, self.held, self.young, self.old = encode, room, 0, {}, {}

    def __getitem__(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self.encode(word)
            if self.held >= self.room:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[word] = ids
            self.held += ENTRY + len(word) + len(ids)
        return ids


class WordEncoder:
    """Whole-text encoding through a word memory.

    The byte-level tokenizer's words never cross from a space that stands
    between two other characters into the text before it: the space starts the
    next word. So a text's ids are those of its first piece and of each
    following " piece", and a piece that is plain letters and marks falls into
    a letter word, a mark word, a line end and so on in the same way. Each
    distinct word is given to the tokenizer library once and remembered. All
    other texts and pieces (added tokens, doubled spaces, digits, other
    scripts) go to the tokenizer as they are, and so does everything when the
    file holds another kind of tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        splitter, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.by_word = (spec["normalizer"] is None and splitter.get("type") == "ByteLevel"
                        and splitter.get("use_regex") and not splitter.get("add_prefix_space")
                        and model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token"))
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = _Memory(self._spaced_word, SPACED_BYTES)                      # letter words after a space
        self.plain = _Memory(self._word, PLAIN_BYTES)                               # letter words and marks

    def _word(self, word: str) -> bytes:
        if not word.isascii() or word == "\n":
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _spaced_word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.code, [t.id for t in self.model.tokenize("Ġ" + word)]).tobytes()

    def _piece(self, piece: str, before: str) -> bytes | None:
        """Ids of a piece with ``before`` (a space, or nothing) in front; None if a space at
        its edge has white space on the other side, where the text must not be cut."""
        match = _PLAIN.fullmatch(piece)
        if not match:
            if before and not piece or piece and (piece[-1].isspace() or before and piece[0].isspace()):
                return None
            return self._whole([before + piece])[0] if piece else b""
        word, marks, next_word, next_marks = match.groups()
        words, plain = self.spaced if before else self.plain, self.plain
        known = plain.young.get                # most words and marks are: no call for them
        ids = words.young.get(word) or words[word]
        if marks:
            ids += known(marks) or plain[marks]
        if next_word:
            ids += plain["\n"] + (known(next_word) or plain[next_word])
            if next_marks:
                ids += known(next_marks) or plain[next_marks]
        return ids

    def _look_up(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces that follow a space. Only letter words are remembered:
        other pieces are made of them."""
        out = list(map(self.spaced.young.get, pieces))
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                out[i] = self.spaced[piece] if piece.isalpha() and (piece.isascii() or _LATIN.fullmatch(piece)) \
                    else self._piece(piece, " ")
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes()
                for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _slow(self, text: str) -> np.ndarray:
        """Ids of one text that is not cut at every space."""
        if not self.by_word or any(a in text for a in self.added):
            ids = self._whole([text])[0]
        else:
            head, *rest = _CUT.split(text)
            ids = self._piece(head, "") or self._whole([head])[0]
            ids += b"".join([self._piece(p, " ") or self._whole([" " + p])[0] for p in rest])
        return np.frombuffer(ids, self.dtype)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and how many each has."""
        collects = gc.isenabled()
        gc.disable()                       # millions of short-lived strings, no cycles
        try:
            return self._encode(pc.fill_null(texts, "").cast(pa.large_string()))
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Arrow numbers the pieces between spaces; each distinct one is looked up once."""
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy()
        pieces = lists.values
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()       # quicker than to_pylist
        heads = pieces.take(pa.array(starts[:-1])).to_pylist()
        codes = coded.indices.to_numpy().copy()
        codes[starts[:-1]] = len(words) + np.arange(len(heads))
        slow = np.zeros(len(texts), bool) if self.by_word else np.ones(len(texts), bool)
        for added in self.added:
            slow |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        ids = [None] * (len(words) + len(heads)) if slow.all() else \
            self._look_up(words) + [self._piece(w, "") for w in heads]
        ragged = np.array([x is None for x in ids], bool)
        if ragged.any():
            slow |= np.logical_or.reduceat(ragged[codes], starts[:-1])
            ids = [x or b"" for x in ids]
        ids.append(np.array([END_ID], self.dtype).tobytes())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), self.dtype)
        out, counts = [], []
        for a, b in _runs(np.diff(starts).tolist(), WORD_RUN):
            run = np.insert(codes[starts[a]:starts[b]], starts[a + 1:b + 1] - starts[a], len(ids) - 1)
            taken = size[run]
            spot = np.repeat(first[run] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
            out.append(flat[spot])
            counts.append(np.add.reduceat(taken, starts[a:b] - starts[a] + np.arange(b - a)))
        done, counts = np.concatenate(out), np.concatenate(counts)
        if slow.any():
            parts = np.split(done, np.cumsum(counts)[:-1])
            for i in np.nonzero(slow)[0]:
                parts[i] = np.append(self._slow(texts[i].as_py()), self.dtype.type(END_ID))
            done, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return done, counts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Forget all words. Called by name, so that a task's closure never carries the encoders."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
    give_back()


# ---------------------------------------------------------------- Spark side

def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order; ``before`` counts the ids of the part in front of each row."""
        part, before, tokens = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for at, to in _runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), TEXT_RUN):
                ids, counts = tokens.encode(texts.slice(at, to - at))
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                seen, times = _histogram(ids)
                once = pa.array([0] + [len(seen)] * (to - at), pa.int32())       # all in the run's first row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(to - at, part, np.int32)), pa.array(starts),
                     batch.column("doc_id").slice(at, to - at), pa.array(counts),
                     _binary(ids, counts * ids.itemsize),
                     pa.ListArray.from_arrays(once, pa.array(seen)), pa.ListArray.from_arrays(once, pa.array(times))],
                    ["part", "before", "doc_id", "n_tokens", "ids", "seen", "times"])
                del ids
                give_back()
    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in _runs(batch.column("n_tokens").to_pylist(), ID_RUN):
            yield batch.slice(at, to - at)


def _histogram(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and how often each occurs."""
    total = np.zeros(0, np.int64)
    for at in range(0, len(ids), ID_RUN):
        run = np.bincount(ids[at:at + ID_RUN], minlength=len(total))
        run[:len(total)] += total
        total = run
    seen = np.nonzero(total)[0]
    return seen.astype(np.int32), total[seen]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id",
                 text: str = "text") -> None:
    """Write the token folder ``path`` for ``docs``.

    Texts are range-partitioned on the id and sorted (null ids first; rows of
    one id by length and crc32 of the text; a random last key lets equal rows
    spread), tokenized once, counted over all of them, and re-coded by rank.
    A null or empty text is the end id alone. An empty table gives a folder
    without documents.
    """
    spark = docs.sparkSession
    dtype = encoder(tokenizer_path).dtype
    content = F.col("text").cast("binary")
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length("text"), F.crc32(content), F.rand(13)]
    placed = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
              .select("doc_id", "text", *[c.alias(f"k{i}") for i, c in enumerate(order[1:])])
              .repartitionByRange(F.col("doc_id").asc_nulls_first(), "k0", "k1", "k2")
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k0", "k1", "k2")
              .select("doc_id", "text"))
    id_type = placed.schema["doc_id"].dataType.simpleString()
    raw_path = scratch_path(spark, "token-ids")
    (placed.mapInArrow(_tokenize(tokenizer_path),
                       f"part int, before long, doc_id {id_type}, n_tokens long, ids binary, seen array<int>, times array<long>")
     .write.parquet(raw_path))
    raw = spark.read.parquet(raw_path)
    counts = (raw.select(F.explode(F.arrays_zip("seen", "times")).alias("e"))
              .groupBy(F.col("e.seen").alias("id")).agg(F.sum("e.times").alias("n")))
    ranked = [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]     # at most the vocabulary
    spark.createDataFrame(list(enumerate(ranked)), "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()                          # all texts are tokenized: the worker needs its memory elsewhere
        for batch in _slices(batches):
            ids = _joined(batch.column("ids"), dtype)
            control, data = encode_ranks(shared.value[ids], batch.column("n_tokens").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("part", "before", "doc_id", "n_tokens")]
                + [control, data],
                ["part", "before", "doc_id", "n_tokens", "control", "data"])

    (raw.drop("seen", "times").mapInArrow(recode, f"part int, before long, doc_id {id_type}, n_tokens long, control binary, data binary")
     .write.parquet(f"{path}/ids"))
    (spark.read.parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
     .write.parquet(f"{path}/parts"))
    drop(spark, raw_path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a token folder; with ``digest`` the unsigned
    crc32 of the ids as little-endian unsigned 32-bit integers in place of the ids."""
    by_rank = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    shared = spark.sparkContext.broadcast(np.array(by_rank, np.uint32))
    rows = spark.read.parquet(f"{path}/ids")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in _slices(batches):
            counts = batch.column("n_tokens").to_numpy()
            ids = shared.value[decode_ranks(batch.column("control"), batch.column("data"), counts)]
            ends = np.concatenate(([0], np.cumsum(counts)))
            if digest:
                raw = memoryview(ids.astype("<u4")).cast("B")
                last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())],
                                pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("part", "before", "doc_id", "n_tokens")]
                + [last],
                ["part", "before", "doc_id", "n_tokens", "last"])

    out = "ids_crc32" if digest else "ids"
    decoded = rows.mapInArrow(decode, f"part int, before long, doc_id {id_type}, n_tokens long, "
                                      f"last {'long' if digest else 'array<long>'}")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = spark.read.parquet(f"{path}/parts").select(       # one row a part
        "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("first"))
    return (decoded.join(F.broadcast(firsts), "part")
            .select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens",
                    F.col("last").alias(out)))


def token_digest(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as a token folder under the shared checkpoint folder, read it back
    and return (doc_id, start, n_tokens, ids_crc32), one row per input row."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, doc_id, text)
    return read_tokens(docs.sparkSession, path, digest=True)
