"""Secret scans: fixed patterns plus character Markov models.

Base spans come from three fixed patterns. Beside them, two first-order
Markov models over characters, one of random strings and one of ordinary
identifiers and words, are compared: a run of token characters whose
log-likelihood ratio favours the random model is a secret too (kind
``markov``), and so is the part of a run, of any length and with dots, that the
random model explains best, whatever ordinary words it is joined to. What is
left of a run beside base spans is scanned as well. Both models are trained on labelled samples that the patterns give:
values of the base spans are random strings, words and numbers of the texts are
ordinary. As the values may all be of one kind (hex, say), the random model also
gets the transitions of generated strings over usual alphabets, in proportion.
Where a string falls back far in between, as two keys joined by a path do, its
pieces are looked at one by one. A string without a letter (a number, a version,
an address) or of few characters is no secret. Transition counts cover all documents; only their sums (one number
a character pair and class) reach the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ALNUM, _LETTER = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: A run is a secret if its log-likelihood ratio is this much in all and a character.
MIN_RATIO, MIN_RATIO_PER_CHAR = 12.0, 0.4
#: A string that falls back this far in between is two; no secret is shorter than this.
MOST_DROP, LEAST_CHARS = 12.0, 8
#: Alphabets of generated random strings: together they count as much as the labelled ones.
GENERATED = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
#: Counts that every transition starts with.
SMOOTHING = 0.5

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1                                  # the last class ends and begins a string
_CLASS = np.full(256, _SIZE - 1, np.int64)
_CLASS[[ord(c) for c in _ALPHABET]] = np.arange(_SIZE - 1)
_SORT = np.zeros(256, np.int8)                              # 1 letter, 2 digit
_SORT[[ord(c) for c in _ALPHABET if c.isalpha()]] = 1
_SORT[[ord(c) for c in _ALPHABET if c.isdigit()]] = 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, unordered."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _value(text: str, span: tuple[str, int, int]) -> str:
    kind, start, end = span
    return _ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]


def _pairs(strings: list[str]) -> np.ndarray:
    """Counts of the transitions in strings of the alphabet, ends included."""
    raw = np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("latin-1", "replace"), np.uint8)
    classes = _CLASS[raw]
    return np.bincount(classes[:-1] * _SIZE + classes[1:], minlength=_SIZE * _SIZE)


def _ordinary_pairs(texts: list[str]) -> np.ndarray:
    """Transitions inside the words and the numbers of whole texts (runs of ASCII letters,
    runs of digits), ends included; between a letter and a digit nothing is counted."""
    raw = np.frombuffer("\n".join(["", *texts, ""]).encode("latin-1", "replace"), np.uint8)
    sort = _SORT[raw]
    classes = np.where(sort > 0, _CLASS[raw], _SIZE - 1)
    a, b = sort[:-1], sort[1:]
    keep = ((a == b) | (a == 0) | (b == 0)) & ((a > 0) | (b > 0))
    return np.bincount((classes[:-1] * _SIZE + classes[1:])[keep], minlength=_SIZE * _SIZE)


def _generated(total: float) -> np.ndarray:
    """Expected transitions of random strings of 32 characters over the usual alphabets, ``total`` in all."""
    out = np.zeros((_SIZE, _SIZE))
    for alphabet in GENERATED:
        at = [_ALPHABET.index(c) for c in alphabet]
        out[np.ix_(at, at)] += 31 / len(at) ** 2
        out[-1, at] += 1 / len(at)
        out[at, -1] += 1 / len(at)
    return out * (total / out.sum())


def _fall(sums: np.ndarray) -> tuple[float, int, int]:
    """The deepest fall of running sums: how deep, from where and to where."""
    falls = np.maximum.accumulate(sums) - sums
    to = int(falls.argmax())
    return float(falls[to]), int(sums[:to + 1].argmax()), to


def _secret(string: str) -> bool:
    return len(string) >= LEAST_CHARS and _LETTER.search(string) is not None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, _SIZE * _SIZE), np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        values = [_value(t, s) for t in texts for s in base_spans(t)]
        if values:
            total[1] += _pairs(values)
        if texts:
            total[0] += _ordinary_pairs(texts)
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)),
                                      pa.array(total[label, pair])], ["label", "pair", "n"])


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each character transition.

    Without any random sample the ratio is zero throughout, so nothing is added.
    """
    return tables(docs, text)[0]


def tables(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """``train``'s ratios for whole runs, and those for parts of runs: there a separator
    ends a word, and ordinary text may end a word and begin another between any two
    characters, so that a change from letters to digits or of case alone is no evidence."""
    rows = (docs.select(F.col(text).alias("text")).mapInArrow(_count, "label int, pair int, n long")
            .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect())       # at most 2 * 69 * 69
    counts = np.zeros((2, _SIZE * _SIZE))
    for r in rows:
        counts[r.label, r.pair] = r.n
    if not counts[0].any() or not counts[1].any():
        return np.zeros((_SIZE, _SIZE)), np.zeros((_SIZE, _SIZE))
    counts = counts.reshape(2, _SIZE, _SIZE)
    counts[1] += _generated(counts[1].sum()) if counts[1].any() else 0
    counts += SMOOTHING
    chance = np.log(counts / counts.sum(2, keepdims=True))
    end, alnum = _SIZE - 1, np.array([c.isalnum() for c in _ALPHABET] + [False])
    part = chance[1] - np.maximum(chance[0], chance[0][:, [end]] + chance[0][[end], :])
    part[:, ~alnum] = (chance[1] - chance[0])[:, [end]]
    part[~alnum, :] = (chance[1] - chance[0])[[end], :]
    part[np.ix_(~alnum, ~alnum)] = 0
    return chance[1] - chance[0], part


def ratio(table: np.ndarray, string: str) -> float:
    classes = _CLASS[np.frombuffer(("\n" + string + "\n").encode("latin-1", "replace"), np.uint8)]
    return float(table[classes[:-1], classes[1:]].sum())


def _left(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a stretch after cutting out the taken ones (sorted)."""
    out = []
    for s, e in taken:
        if e <= start or s >= end:
            continue
        if s > start:
            out.append((start, s))
        start = e
    return out + [(start, end)] if start < end else out


def _likely(text: str, part: np.ndarray) -> list[tuple[int, int]]:
    """The runs whose favourable transitions alone come up to ``MIN_RATIO``."""
    classes = _CLASS[np.frombuffer(("\n" + text + "\n").encode("latin-1", "replace"), np.uint8)]
    gain = np.maximum(part[classes[:-1], classes[1:]], 0).cumsum()
    inside = classes != _SIZE - 1
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])           # of the text, not of the padded one
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    before = np.where(starts > 0, gain[starts - 1], 0)
    hit = gain[ends] - before >= MIN_RATIO
    return list(zip(starts[hit].tolist(), ends[hit].tolist()))


def _whole(text: str, s: int, e: int, a: int, b: int, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """A stretch inside [a, b) grown to the borders of the letters and digits it begins and ends
    in; an ordinary word of which it only holds the beginning or the end is left off."""
    while s < e and not _ALNUM.match(text[s]):
        s += 1
    first, last = s, e
    while first > a and _ALNUM.match(text[first - 1]):
        first -= 1
    while last < b and _ALNUM.match(text[last]):
        last += 1
    runs = [m.span() for m in _ALNUM.finditer(text, first, last)]
    while len(runs) > 1 and _gain(text, *runs[-1], part) < 0:
        runs.pop()
    while len(runs) > 1 and _gain(text, *runs[0], part) < 0:
        runs.pop(0)
    if runs:
        end = last if runs[-1][1] == last or text[runs[-1][1]:last].strip("=") == "" else runs[-1][1]
        if _secret(text[runs[0][0]:end]):
            yield runs[0][0], end


def _gain(text: str, s: int, e: int, part: np.ndarray) -> float:
    classes = _CLASS[np.frombuffer(("\n" + text[s:e] + "\n").encode("latin-1", "replace"), np.uint8)]
    return float(part[classes[:-1], classes[1:]].sum())


def _parts(text: str, start: int, end: int, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """The best-scoring part of a stretch, then those of what is left on either side; each
    grown to the borders of the letters and digits it begins and ends in."""
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        if a >= b:
            continue
        classes = _CLASS[np.frombuffer(("\n" + text[a:b] + "\n").encode("latin-1", "replace"), np.uint8)]
        sums = np.concatenate(([0.0], part[classes[:-1], classes[1:]].cumsum()))
        gains = sums - np.minimum.accumulate(sums)
        last = int(gains.argmax())
        first = int(sums[:last + 1].argmin())
        if gains[last] < MIN_RATIO:
            continue
        s, e = a + max(first - 1, 0), a + min(last, b - a)
        deep, high, low = _fall(sums[first:last + 1])
        if deep >= MOST_DROP:                  # two strings with something ordinary in between
            todo += [(a, a + first + high), (max(a + first + low - 1, a + first + high), b)]
            continue
        if gains[last] >= MIN_RATIO_PER_CHAR * (e - s):
            for x, y in _whole(text, s, e, a, b, part):
                yield x, y
                s, e = min(s, x), max(e, y)
        todo += [(a, s), (e, b)]


def markov_spans(text: str, table: np.ndarray, taken: list[tuple[str, int, int]],
                 part: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """Runs of token characters, and with ``part`` parts of them, that the random model
    explains better, outside ``taken``."""
    used, out = sorted((s, e) for _, s, e in taken), []
    for m in _RUN.finditer(text):
        for s, e in _left(*m.span(), used):
            score = ratio(table, text[s:e]) if e - s >= 16 and _secret(text[s:e]) else 0.0
            if score >= MIN_RATIO and part is not None and part.any():
                classes = _CLASS[np.frombuffer(("\n" + text[s:e] + "\n").encode("latin-1", "replace"), np.uint8)]
                if _fall(part[classes[:-1], classes[1:]].cumsum()[:-1])[0] >= MOST_DROP:
                    continue                   # left to its parts
            if score >= MIN_RATIO and score >= MIN_RATIO_PER_CHAR * (e - s):
                out.append(("markov", s, e))
    if part is not None and part.any():
        used = sorted(used + [(s, e) for _, s, e in out])
        for run in _likely(text, part):
            for rest in _left(*run, used):
                out += [("markov", s, e) for s, e in _parts(text, *rest, part)]
    return out


def render(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed; code points, end exclusive."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in
                    sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)), one row per input row, spans by start.

    Null and empty texts have no spans; repeated rows come back as often as
    they went in; other columns are not read; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables(docs, text))     # 2 * 69 * 69 numbers
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                spans = base + markov_spans(t or "", shared.value[0], base, shared.value[1])
                spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, span)], ["doc_id", "spans"])

    id_type = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(scan, f"doc_id {id_type}, spans array<struct<kind:string,start:int,end:int>>")


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets``: the base spans' sha256 and all spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs).select(
        "doc_id", *[number(k) for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s.kind != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), number(KINDS[3]))
