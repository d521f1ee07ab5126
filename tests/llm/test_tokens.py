import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bpe, queries, tokenfile

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "I'm we're they'll he'd 'sfoo ''s x's's", "a" * 3000, "thth" * 700,
    "漢字 １２3½ ـ 😀 \xa0\x85 é" * 3, "tail  ", "  lead", "tab\t\tx\r\ny", "<|endoftext|> plain", "dup", "dup",
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y é<|endoftext|>", "<|endof", "text|>", "end",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, ids_crc32 long")


def reference_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(spark):
    library = reference_encoding()
    rows = bpe.decode(bpe.encode(frame(spark, TEXTS), RANKS), RANKS).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    fused = bpe.round_trip(frame(spark, TEXTS), RANKS).collect()
    assert sorted(map(str, fused)) == sorted(map(str, rows)) and fused[0].ids_crc32 == 0


def test_bpe_query_on_documents(spark):
    library = reference_encoding()
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op9_bpe_round_trip(spark, sf).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = library.encode_ordinary(want[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest()


def test_bpe_empty_table_and_bad_ids(spark):
    assert bpe.decode(bpe.encode(frame(spark, []), RANKS), RANKS).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), RANKS).collect()


LIBRARY = {match: Tokenizer.from_file(TOKENIZER) for match in (True, False)}
LIBRARY[False].encode_special_tokens = True


def library_ids(text, match_added=True):
    library = LIBRARY[match_added]
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("match_added", [True, False])
def test_token_files(spark, match_added):
    manifest = tokenfile.write(frame(spark, TEXTS).orderBy("text"), TOKENIZER, end_id=2, partitions=3, match_added=match_added)
    rows = sorted(tokenfile.read(spark, manifest).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(rows, TEXTS, strict=True):
        ids = [*library_ids(text, match_added), 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [m["base"] for m in manifest] == list(np.cumsum([0, *(m["ids"] for m in manifest)])[:-1])
    assert tokenfile.read(spark, tokenfile.write(frame(spark, []), TOKENIZER, 2)).count() == 0


def test_token_files_of_null_and_equal_ids(spark):
    rows = [(None, "no id"), (4, "x"), (4, "yy <|endoftext|>"), (None, None), (-3, "first"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("key", F.lit(9))
    got = sorted(tokenfile.read(spark, tokenfile.write(df, TOKENIZER, end_id=2, partitions=4)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -3, 4, 4, 4]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), [*library_ids(t), 2]) for d, t in rows)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_token_files_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    start, want = 0, []
    for r in sorted(queries.table(spark, sf, "documents").collect(), key=lambda r: r.doc_id):
        ids = [*library_ids(r.text), 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_files(spark, sf).collect()) == want
