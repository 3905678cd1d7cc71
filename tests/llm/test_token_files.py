import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from candlewick.llm.token_files import WordEncoder, decode_ranks, encode_ranks, read_tokens, token_digest, write_tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [0]


@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=30), max_size=6))
def test_byte_coding_round_trip(docs):
    counts, flat = [len(d) for d in docs], [x for d in docs for x in d]
    control, data = encode_ranks(np.array(flat, np.uint32), counts)
    assert [len(c) for c in control.to_pylist()] == [-(-n // 4) for n in counts]
    assert [len(d) for d in data.to_pylist()] == [sum(max(1, -(-x.bit_length() // 8)) for x in d) for d in docs]
    assert decode_ranks(control, data, np.array(counts, np.int64)).tolist() == flat


WORDS = WordEncoder(PATH)
ODD = [" ", "  ", "\n", " ", " ", "\x1c", "\x85", "'s", "don't", "42", "é", "日本", "!!", "a", "Zoë", "<|endoftext|>",
       "\t", "x" * 70, "́", "\U0001f600", "Straße,", "word.\nNext", "a\n\nb", "it's", "x%%%\nY###", "ɏĀ", "я"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD + [" "] * 8), st.text(max_size=4)), max_size=25))
def test_word_memory_equals_whole_text(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    for texts in ([text], ["a b", text, None, "x  y", text + " z"]):
        ids, counts = WORDS.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ids_of(t) for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, texts = Tokenizer.from_file(path), ["Hello  there, you", "one two", ""]
    ids, counts = WordEncoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == \
        [other.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def expected(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()))):
        ids = ids_of(t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in token_digest(docs, PATH).collect())
    assert got == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(spark):
    rows = [(3, ""), (1, None), (1, "one two"), (2, "é " * 9000), (2, "é " * 9000), (None, "null id")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in token_digest(df, PATH).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert token_digest(df.limit(0), PATH).count() == 0


def test_files_hold_the_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write_tokens(docs, str(tmp_path / "t"), PATH)
    got = {r.doc_id: r.ids for r in read_tokens(spark, str(tmp_path / "t")).collect()}
    assert all(got[r.doc_id] == ids_of(r.text) for r in docs.collect())
    rows = spark.read.parquet(str(tmp_path / "t/ids")).orderBy("part", "before").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    with pytest.raises(Exception):
        write_tokens(docs, str(tmp_path / "t"), PATH)           # never overwrites
