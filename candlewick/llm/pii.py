"""Personal data: fixed patterns plus bootstrapped contextual extraction.

Base spans (e-mail, IP address, card, phone) come from fixed patterns; they
are the seed entities, trusted from the start. A trusted entity's neighbourhood
induces lexical patterns (the two words in front of it; the word in front and
the word behind). A pattern that ``MIN_SEEDS`` distinct trusted entities share
is a candidate, if they fill at least ``MIN_SHARE`` of its slots; every token
in its slots is an instance, grown over the digit groups and the spelled-out
address (``bob at host dot org``) that it begins. An instance that stands more
often outside the candidates' slots than in them is a known other; all others
are unseen identifiers for the time being.

Patterns and instances score each other, in rounds, until no score moves by
``TOLERANCE``: an unseen instance is worth its best pattern's confidence, a
pattern the mean worth of its instances, where trusted entities count 1, known
others 0, and all unseen ones together weigh no more than what is known (so a
round halves the error at least, and unseen ones alone move nothing: the limit
is then the trusted share of what is known). Patterns that reach ``CONFIDENCE``
are trusted and so are their unseen instances. These induce patterns in turn,
wherever they stand, until nothing new is found. Found identifiers are marked
in every slot of a trusted pattern and wherever else they stand whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import drop, written
from candlewick.llm.marks import Members, members_of

KINDS = ("email", "ip", "card", "phone", "found")
CONFIDENCE = 0.9
#: Distinct trusted entities that make a pattern a candidate, and their least share of its slots.
MIN_SEEDS, MIN_SHARE = 3, 0.05
#: The rounds end when no confidence moves by this much.
TOLERANCE = 0.001

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = ".,;:!?()[]{}<>\"'"
_STOPS = ".,;:!?"
#: A group of a spaced identifier, a sign between groups, letters that may lead them.
_GROUP = re.compile(r"[+(\[]*[0-9A-Z]*[0-9][0-9A-Z]*(?:[-./()]+[0-9A-Z]+)*")
_SIGN = re.compile(r"[-/.–]+")
_LEAD = re.compile(r"\(?[A-Z]{1,4}")
_AT, _DOT = re.compile(r"[(\[{<]?(?:at|@)[)\]}>]?"), re.compile(r"[(\[{<]?(?:dot|\.)[)\]}>]?")
_HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Linear in the text: each @ looks back over its own run of local characters only."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                end = domain.end()
                spans.append((start, end))
        at = text.find("@", at + 1)
    return spans


def _ips(text: str) -> list[tuple[int, int]]:
    """Groups of four parts along each maximal dotted run of digits."""
    spans = []
    for run in _DOTTED.finditer(text):
        parts = [m.span() for m in _PART.finditer(text, *run.span())] if "." in run[0] else []
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
                spans.append((four[0][0], four[3][1]))
    return spans


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    spans = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        spans += [("ip", *s) for s in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
    return spans


class _Words:
    """The tokens of a text: where they are, and in lower case."""

    def __init__(self, text: str, words: list[str] | None = None):
        self.text, self.words = text, text.lower().split() if words is None else words
        self.at = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts = [a for a, _ in self.at]

    def around(self, start: int, end: int) -> list[str]:
        """Lexical patterns of a span, which may begin or end inside a token."""
        i, j = bisect_left(self.starts, start), bisect_right(self.starts, end)
        before, after = self.words[max(0, i - 2):i], self.words[j:j + 1]
        if i and self.at[i - 1][1] > start:
            before[-1] = self.text[self.starts[i - 1]:start].lower()
        if j and self.at[j - 1][1] > end:
            after = [self.text[end:self.at[j - 1][1]].lower()]
        return _patterns(before, after)

    def grown(self, k: int) -> int:
        """The last token of the identifier that token ``k`` begins."""
        token, words, last = [self.text[a:b] for a, b in self.at[k:k + 2]], self.words, k
        if _GROUP.fullmatch(token[0].rstrip(_EDGE)) or (len(token) > 1 and _LEAD.fullmatch(token[0])
                                                        and _GROUP.fullmatch(token[1].rstrip(_EDGE))):
            while not self.text[self.at[last][1] - 1] in _STOPS:
                n = last + 1
                if n + 1 < len(words) and _SIGN.fullmatch(words[n]):
                    n += 1
                if n >= len(words) or not _GROUP.fullmatch(self.text[slice(*self.at[n])].rstrip(_EDGE)):
                    break
                last = n
        if last == k and k + 2 < len(words) and _AT.fullmatch(words[k + 1]):
            last = k + 2
            while last + 2 < len(words) and _DOT.fullmatch(words[last + 1]):
                last += 2
            if last == k + 2 and not _HOST.fullmatch(words[last].rstrip(_EDGE)):
                last = k
        return last

    def span(self, k: int, last: int) -> tuple[int, int]:
        """Where tokens ``k`` to ``last`` are, without marks at the edges but with brackets that close inside."""
        a, b = self.at[k][0], self.at[last][1]
        inner = self.text[a:b].lstrip(_EDGE)
        s = b - len(inner)
        e = s + len(inner.rstrip(_EDGE))
        for left, right in ("()", "[]"):
            if s > a and self.text[s - 1] == left and self.text.count(right, s, e) > self.text.count(left, s, e):
                s -= 1
            if e < b and self.text[e] == right and self.text.count(left, s, e) > self.text.count(right, s, e):
                e += 1
        return s, e


def _patterns(before: list[str], after: list[str]) -> list[str]:
    """Lexical patterns from up to two words before and one behind."""
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _may_hold(words: list[str], hits: set[str], marks: Members) -> bool:
    """Whether a token, or what may grow from it, stands in a member pattern's slot."""
    for a, b, c in zip([None, *words], words[:-1], [*words[2:], None]):
        if b in hits:
            if a is not None and f"{a} {b} _" in marks:
                return True
            if c is not None and (f"{b} _ {c}" in marks or _DIGIT.search(c) or _SIGN.fullmatch(c) or _AT.fullmatch(c)):
                return True
    return False


def instances(text: str, base: list[tuple[str, int, int]],
              marks: Members | None = None) -> list[tuple[int, int, bool, str, list[str]]]:
    """(start, end, is seed, identifier, patterns) of every base span and every other
    token, grown to the whole identifier and stripped of marks at its edges; with
    ``marks`` only of the tokens behind a marked word."""
    words = text.lower().split()
    hits = None if marks is None else marks.among(set(words))
    if hits is not None and not (hits and _may_hold(words, hits, marks)):
        return []
    of = _Words(text, words)
    out = [] if marks is not None else [(s, e, True, text[s:e], of.around(s, e)) for _, s, e in base]
    taken = []                                              # base spans, overlapping ones as one
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    ends = [e for _, e in taken]

    def free(s: int, e: int) -> bool:
        i = bisect_right(ends, s)
        return i == len(taken) or taken[i][0] >= e

    for k in range(len(words)):
        if hits is not None and (not k or words[k - 1] not in hits):
            continue
        following = words[k + 1:k + 2]
        grows = following and (_DIGIT.search(following[0]) or _SIGN.fullmatch(following[0]) or _AT.fullmatch(following[0]))
        if hits is not None and not grows and not any(p in marks for p in _patterns(words[max(0, k - 2):k], following)):
            continue                                        # most tokens: in no marked slot
        last = of.grown(k) if grows else k
        while last > k and not free(*of.span(k, last)):
            last -= 1
        s, e = of.span(k, last)
        if s < e and free(s, e):
            out.append((s, e, False, text[s:e], _patterns(words[max(0, k - 2):k], words[last + 1:last + 2])))
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,identifier:string,patterns:array<string>>>"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, identifier) of the seeds, each once a batch."""
    for batch in batches:
        pairs = set()
        for t in batch.column("text").to_pylist():
            base = base_spans(t or "")
            of = _Words(t) if base else None
            for _, s, e in base:
                pairs.update((p, t[s:e]) for p in of.around(s, e))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()),
                                          pa.array([i for _, i in pairs], pa.string())], ["pattern", "identifier"])


def _pattern_members(patterns: DataFrame) -> Members:
    """Patterns and the word in front of their slot."""
    words = F.split("pattern", " ")
    return members_of(patterns, F.col("pattern"), F.when(words[1] == "_", words[0]).otherwise(words[1]))


#: Marks at a token's edge, as white space.
_BARE = str.maketrans(_EDGE, " " * len(_EDGE))


def _identifier_members(identifiers: DataFrame) -> Members:
    """Identifiers and the first word that each holds besides marks."""
    bare = F.split(F.trim(F.translate("identifier", _EDGE, " " * len(_EDGE))), r"\s+")[0]
    return members_of(identifiers, F.col("identifier"), bare)


def _slots(text: str, base: list[tuple[str, int, int]], marks: Members) -> Iterator[tuple[int, int, str, list[str]]]:
    """The instances that are no seeds in slots of marked patterns."""
    for s, e, _, identifier, patterns in instances(text, base, marks):
        hit = [p for p in patterns if p in marks]
        if hit:
            yield s, e, identifier, hit


def _pairs(marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pattern, identifier, n): how often an identifier stands in a marked pattern's slot."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = Counter()
            for t in batch.column("text").to_pylist():
                for _, _, identifier, patterns in _slots(t or "", base_spans(t or ""), marks.value):
                    pairs.update((p, identifier) for p in patterns)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in pairs], pa.string()), pa.array([i for _, i in pairs], pa.string()),
                 pa.array(list(pairs.values()), pa.int64())], ["pattern", "identifier", "n"])
    return scan


def _shares(patterns, identifiers) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pattern, trusted, slots): how many tokens stand in a member pattern's slot, and how often a
    trusted entity does."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_patterns, known = patterns.value, identifiers.value
        for batch in batches:
            trusted, slots = Counter(), Counter()
            for t in batch.column("text").to_pylist():
                words = (t or "").lower().split()
                hits = of_patterns.among(set(words))
                if not hits:
                    continue
                held = []
                for a, b, c in zip([None, *words], words[:-1], [*words[2:], None]):
                    if b in hits:
                        if a is not None and (p := f"{a} {b} _") in of_patterns:
                            held.append(p)
                        if c is not None and (p := f"{b} _ {c}") in of_patterns:
                            held.append(p)
                slots.update(held)
                base = base_spans(t)
                of = _Words(t, words) if base else None
                for _, s, e in base:
                    trusted.update(p for p in of.around(s, e) if p in of_patterns)
                for _, _, _, found in _standing(t, base, known):
                    trusted.update(p for p in found if p in of_patterns)
            names = list(slots | trusted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([trusted[p] for p in names], pa.int64()),
                 pa.array([slots[p] for p in names], pa.int64())], ["pattern", "trusted", "slots"])
    return scan


def _tokens(marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(identifier, total): how often tokens of marked identifiers stand anywhere."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.value
        for batch in batches:
            total = Counter()
            for t in batch.column("text").to_pylist():
                bare = list(map(str.strip, (t or "").split(), repeat(_EDGE)))
                hits = known.among(set(bare))
                if hits:
                    total.update(w for w in bare if w in hits)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                             ["identifier", "total"])
    return scan


def _standing(text: str, base: list[tuple[str, int, int]], marks: Members) -> Iterator[tuple[int, int, str, list[str]]]:
    """(start, end, identifier, patterns) wherever a marked identifier stands whole, outside base spans."""
    if not marks or not marks.among(set(text.translate(_BARE).split())):
        return
    of = _Words(text)
    for k, (a, b) in enumerate(of.at):
        if any(w in marks for w in text[a:b].translate(_BARE).split()[:1]):
            s, e = of.span(k, last := of.grown(k))
            if s < e and text[s:e] in marks and not any(x < e and s < y for _, x, y in base):
                yield s, e, text[s:e], _patterns(of.words[max(0, k - 2):k], of.words[last + 1:last + 2])


def _contexts(marks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pattern, identifier) wherever marked identifiers stand, each once a batch."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for t in batch.column("text").to_pylist():
                for _, _, identifier, patterns in _standing(t or "", base_spans(t or ""), marks.value):
                    pairs.update((p, identifier) for p in patterns)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()),
                                              pa.array([i for _, i in pairs], pa.string())], ["pattern", "identifier"])
    return scan


def _extract(patterns, identifiers) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The base spans, the slots of marked patterns and the places of marked identifiers, a row a text."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    slot = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("identifier", pa.string()),
                               ("patterns", pa.list_(pa.string()))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, found = [], []
            for t in batch.column("text").to_pylist():
                base = base_spans(t or "")
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                spots = []
                if patterns is not None:
                    spots = [*_slots(t or "", base, patterns.value), *_standing(t or "", base, identifiers.value)]
                found.append([dict(zip(("start", "end", "identifier", "patterns"), x)) for x in spots])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, span), pa.array(found, slot)],
                                             ["doc_id", "base", "slots"])
    return scan


def confidences(candidates: DataFrame, pairs: DataFrame, others: DataFrame) -> DataFrame:
    """(pattern, confidence) at the end of the rounds, each written once.

    ``candidates`` (pattern, seeds: its distinct trusted entities), ``pairs`` (pattern, identifier: its
    other instances), ``others`` (identifier: those that are known others)."""
    spark = pairs.sparkSession
    known = pairs.join(others, "identifier").groupBy("pattern").agg(F.count("*").alias("others"))
    edges, edges_path = written(pairs.select("pattern", "identifier").join(others, "identifier", "left_anti"), "pii-edges")
    unseen = edges.groupBy("pattern").agg(F.count("*").alias("unseen"))
    state = (candidates.select("pattern", "seeds").join(known, "pattern", "left").join(unseen, "pattern", "left")
             .fillna(0, ["others", "unseen"]).withColumn("weight", F.least(
                 F.lit(1.0), (F.col("seeds") + F.col("others")) / F.greatest(F.col("unseen"), F.lit(1)))))
    now, path = written(state.withColumn("confidence", F.col("seeds") / (F.col("seeds") + F.col("others"))), "pii-scores")
    while True:
        worth = edges.join(now.select("pattern", "confidence"), "pattern").groupBy("identifier").agg(F.max("confidence").alias("worth"))
        mass = edges.join(worth, "identifier").groupBy("pattern").agg(F.sum("worth").alias("mass"))
        weighed = F.col("weight") * F.coalesce("mass", F.lit(0.0))
        new, new_path = written(
            now.withColumnRenamed("confidence", "before").join(mass, "pattern", "left").withColumn(
                "confidence", (F.col("seeds") + weighed) / (F.col("seeds") + F.col("others") + F.col("weight") * F.col("unseen")))
            .drop("mass"), "pii-scores")
        moved = new.agg(F.max(F.abs(F.col("confidence") - F.col("before")))).first()[0]
        drop(spark, path)
        now, path = new.drop("before"), new_path
        if moved is None or moved < TOLERANCE:
            drop(spark, edges_path)
            return now.select("pattern", "confidence")


def discover(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(trusted patterns, known others, found identifiers) of ``texts`` (text); None if nothing is found.

    Every turn scans the texts for what the newest trusted entities induce. A turn ends
    the search if it finds no identifier that was not trusted before."""
    spark, send = texts.sparkSession, texts.sparkSession.sparkContext.broadcast
    pair, result = "pattern string, identifier string", None
    support, _ = written(texts.mapInArrow(_seeds, pair).distinct(), "pii-support")
    newest, found = support, spark.createDataFrame([], "identifier string")
    while True:
        candidates, _ = written(
            support.join(newest.select("pattern").distinct(), "pattern").groupBy("pattern")
            .agg(F.count_distinct("identifier").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS), "pii-candidates")
        if candidates.isEmpty():
            return result
        shares = (texts.mapInArrow(_shares(send(_pattern_members(candidates)), send(_identifier_members(found))),
                                   "pattern string, trusted long, slots long")
                  .groupBy("pattern").agg(F.sum("trusted").alias("trusted"), F.sum("slots").alias("slots")))
        open_, _ = written(candidates.join(shares, "pattern").where(F.col("trusted") >= MIN_SHARE * F.col("slots"))
                           .select("pattern", "seeds"), "pii-open")
        if open_.isEmpty():
            return result
        pairs, _ = written(texts.mapInArrow(_pairs(send(_pattern_members(open_))), pair + ", n long")
                           .groupBy("pattern", "identifier").agg(F.sum("n").alias("n"))
                           .join(open_.select("pattern"), "pattern").join(found, "identifier", "left_anti"), "pii-pairs")
        # an occurrence in two slots counts twice as inside, which is on the side of the unseen
        inside = pairs.groupBy("identifier").agg(F.sum("n").alias("inside"))
        total = (texts.mapInArrow(_tokens(send(members_of(pairs, F.col("identifier")))), "identifier string, total long")
                 .groupBy("identifier").agg(F.sum("total").alias("total")))
        others, _ = written(inside.join(total, "identifier").where(F.col("total") - F.col("inside") > F.col("inside"))
                            .select("identifier"), "pii-others")
        trusted, _ = written(confidences(open_, pairs, others).where(F.col("confidence") >= CONFIDENCE - 1e-9)
                             .select("pattern"), "pii-trusted")
        new, _ = written(pairs.join(trusted, "pattern", "left_semi").join(others, "identifier", "left_anti")
                         .select("identifier").distinct(), "pii-found")
        if result is not None:
            trusted, others = trusted.union(result[0]).distinct(), others.union(result[1]).distinct()
        found = found.union(new)
        result = trusted, others, found
        if new.isEmpty():
            return result
        newest, _ = written(texts.mapInArrow(_contexts(send(_identifier_members(new))), pair).distinct()
                            .join(new, "identifier", "left_semi").select("pattern", "identifier"), "pii-support")
        support = support.union(newest)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found), one row per input row.

    ``base`` lists (kind, start, end) of the fixed patterns by kind and start,
    ``found`` the added spans by start; they never overlap base spans. Offsets
    are code points, ends exclusive. Null and empty texts have no spans;
    repeated rows come back as often as they went in; other columns are not
    read; an empty table gives an empty result.

    Texts are scanned for seeds, for the slots of their patterns, up to three
    times more for each turn that has patterns to trust, and for the spans.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = thin.schema["doc_id"].dataType.simpleString()
    known = discover(thin.select("text"))
    marks = (None, None) if known is None else (_pattern_members(known[0]), _identifier_members(known[2]))
    marks = [None if m is None else spark.sparkContext.broadcast(m) for m in marks]
    rows, _ = written(thin.mapInArrow(_extract(*marks), f"doc_id {id_type}, base {_SPANS}, slots {_FOUND}")
                      .withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    if known is None:
        return rows.select("doc_id", "base", F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    trusted, others, found = known
    spots = rows.select("row", F.inline("slots"))
    by_pattern = (spots.select("row", "start", "end", "identifier", F.explode("patterns").alias("pattern"))
                  .join(trusted, "pattern", "left_semi").join(others, "identifier", "left_anti"))
    by_identifier = spots.join(found, "identifier", "left_semi")
    spans = (by_pattern.select("row", "start", "end").union(by_identifier.select("row", "start", "end"))
             .groupBy("row", "start").agg(F.max("end").alias("end"))
             # of an identifier found from two of its groups the longer span stays
             .withColumn("before", F.max("end").over(Window.partitionBy("row").orderBy("start")
                                                     .rowsBetween(Window.unboundedPreceding, -1)))
             .where(F.col("before").isNull() | (F.col("end") > F.col("before")))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found")))
    return (rows.join(spans, "row", "left")
            .select("doc_id", "base", F.coalesce("found", F.array().cast("array<struct<start:int,end:int>>"))
                    .alias("found")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``: the base spans' sha256 and all spans."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.transform("base", lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    found = F.transform("found", lambda s: F.concat_ws(":", F.lit(KINDS[4]), s.start, s.end))
    return find_pii(docs).select(
        "doc_id", *[number(k) for k in KINDS[:4]], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, found), ",").alias("spans"), F.size("found").cast("long").alias("n_found"))
