import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import secret_scan
from candlewick.llm.secret_scan import base_spans, find_secrets, ratio, render, secrets_digest, train

SF = "/root/testdata/sf0.001"


def slow_base(text):
    text, out = text or "", []
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for m in re.finditer(f"({either})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "ApiKey", "paſſword", "toKen", "=", ":", " ", '"',
                                 "'", "abc", "0f" * 12, "AKIA", "A1B2C3D4E5F6G7H8", "x.y/z", "é", "\n", "f"]), max_size=12).map("".join))
def test_base_spans(text):
    assert sorted(base_spans(text)) == sorted(slow_base(text))


def test_query_against_slow(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in secrets_digest(docs).collect()}
    for r in docs.collect():
        base, g = slow_base(r.text), got[r.doc_id]
        counts = [sum(k == kind for k, _, _ in base) for kind in secret_scan.KINDS[:3]]
        assert [g.n_assign, g.n_access, g.n_hex] == counts
        assert g.base_sha256 == hashlib.sha256(render(base).encode()).hexdigest()
        assert [s for s in g.spans.split(",") if s and not s.startswith("markov")] == [s for s in render(base).split(",") if s]
    assert len(got) == docs.count()


def corpus(rng):
    words = ["configuration", "temperature", "the", "internationalization", "get_user_account_name", "of", "description"]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))                               # noqa: E731
    key = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    return text, key


def test_markov_tells_random_from_ordinary(spark):
    rng = random.Random(4)
    text, key = corpus(rng)
    rows = [(k, f"{text()} password = {key()} {text()}", "x") for k in range(200)]
    hidden = key()
    rows += [(900, f"{text()} {hidden} {text()}", "x"), (901, text(), "x"), (None, None, "x"), (902, "", "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find_secrets(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got}
    at = rows[200][1].index(hidden)
    assert by_id[900] == [("markov", at, at + 32)] and by_id[901] == by_id[None] == by_id[902] == []
    assert all(k == "assign" for d, spans in by_id.items() if d is not None and d < 200 for k, _, _ in spans)
    table = train(df)
    held = [key() for _ in range(200)]                                   # unseen strings of both classes
    assert sum(ratio(table, k) > secret_scan.MIN_RATIO for k in held) > 190
    assert not any(ratio(table, w) > 0 for w in ("internationalization", "description_of_temperature"))


def test_without_samples(spark):
    df = spark.createDataFrame([(1, "no secrets in here at all, only ordinaryidentifierwords")], "doc_id long, text string")
    assert [r.spans for r in secrets_digest(df).collect()] == [""]
    assert secrets_digest(df.limit(0)).count() == 0


def test_secrets_joined_to_words_and_beside_base_spans(spark):
    rng = random.Random(5)
    text, key = corpus(rng)
    rows = [(k, f"{text()} password = {key()} {text()}") for k in range(200)]
    hidden = key()
    path = "/configuration/description/temperature/internationalization/configuration/description/temperature/"
    access = "AKIA" + "A1B2C3D4E5F6G7H8"
    rows += [(900, f"{text()} {path}{hidden} {text()}"), (901, f"{text()} {path}of {text()}"),
             (902, f"of {access}/{hidden} the"), (903, f"of the.{hidden}.of the")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in
           find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc in (900, 902, 903):
        at = dict(rows)[doc].index(hidden)
        assert any(k == "markov" and s <= at and at + 32 <= e <= at + 33 for k, s, e in got[doc])
    assert got[901] == [] and ("access", 3, 23) in got[902]
    at = rows[200][1].index(hidden)
    assert got[900] == [("markov", at, at + 32)]


def test_hex_samples_find_keys_of_other_alphabets_and_no_numbers(spark):
    """All labelled strings are hex; keys of 16 and more characters are found all the same, apart
    where a path joins them, and numbers, versions and addresses are left alone."""
    rng = random.Random(6)
    text, _ = corpus(rng)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    rows = [(k, f"{text()} {''.join(rng.choice('0123456789abcdef') for _ in range(40))} {text()}") for k in range(150)]
    rows += [(1000 + k, f"{text()} 10.{k}.22.{k} Version 2.{k} 2024-01-{k:02d} the.2.0 of") for k in range(60)]
    single = {2000 + k: key(16 + k % 30) for k in range(200)}
    pairs = {3000 + k: (key(32), key(32)) for k in range(100)}
    rows += [(d, f"the {v} of") for d, v in single.items()]
    rows += [(d, f"of {a}/configuration/description/temperature/{b} the") for d, (a, b) in pairs.items()]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "markov"] for r in
           find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert not any(got[1000 + k] for k in range(60))
    near = lambda spans, t, v: any(abs(s - t.index(v)) <= 1 and abs(e - t.index(v) - len(v)) <= 1 for s, e in spans)
    assert sum(near(got[d], texts[d], v) for d, v in single.items()) >= 190
    assert sum(len(got[d]) == 2 and all(near(got[d], texts[d], v) for v in both) for d, both in pairs.items()) >= 95
