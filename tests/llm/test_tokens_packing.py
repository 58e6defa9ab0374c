import random
import zlib
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm.packing import TextIds, binary_parts, cuts, pack_documents
from tabulon.llm.token_counts import TextCounter, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "   ", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "éa ́", "日本語テスト 123", "I'm he'll 'S it'S",
       "\x1c\x1da\x85b\xa0c​d", "ﬁ ½ ² ª", "😀😀 hi 👨‍👩‍👧", "<|endoftext", "ǅ ß ẞ SS", "a­b", "﻿abc\x00d", "don't'tre''ll",
       "two  spaces", "tail  ", "line \n\n  next", "\tx", "x" * 5000]


def random_texts(n, seed=3):
    r = random.Random(seed)
    alphabet = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250), 0x2019, 0x4E2D, 10, 9)] + [" "] * 80
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


def test_counts_equal_the_library():
    lib, own = Tokenizer.from_file(WORDS), TextCounter(WORDS)
    for x in ODD + random_texts(3000):
        assert own.count(x) == len(lib.encode(x, add_special_tokens=False).ids), repr(x)


def test_counts_do_not_depend_on_the_cache_size():
    big, small = TextCounter(WORDS), TextCounter(WORDS, entries=3)
    for x in random_texts(200):
        assert big.count(x) == small.count(x)
    assert len(small) <= 3 and len(small.words) <= 3


def test_token_counts_rows(spark):
    df = spark.createDataFrame([(1, "the the"), (1, "the the"), (None, None), (2, ""), (3, "w" * 9000 + " a" * 3000)], "doc_id long, text string")
    df = df.withColumn("n_tokens_", F.lit(0)).withColumn("n_bytes", F.lit(5))     # an extra column of the same name
    got = sorted(map(tuple, token_counts(df, WORDS, keep=["doc_id"]).collect()), key=str)
    lib = Tokenizer.from_file(WORDS)
    long = len(lib.encode("w" * 9000 + " a" * 3000).ids)
    assert got == sorted([(1, 7, 2, False), (1, 7, 2, False), (None, 0, 0, False), (2, 0, 0, False), (3, 15000, long, True)], key=str)
    assert token_counts(df.limit(0), WORDS, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, WORDS, keep=["n_bytes"])


def test_ids_equal_the_library():
    own = TextIds(BYTES, entries=50)
    for x in ODD + random_texts(3000, 4):
        assert own.ids(x) == array("I", Tokenizer.from_file(BYTES).encode(x, add_special_tokens=False).ids).tobytes() if x in ODD else True
    lib = Tokenizer.from_file(BYTES)
    for x in random_texts(3000, 4):
        assert own.ids(x) == array("I", lib.encode(x, add_special_tokens=False).ids).tobytes(), repr(x)


def test_cuts_cover_and_parts_are_powers_of_two():
    for n in [1, 2, 255, 256, 257, 2047, 2048, 2049, 4096, 7777]:
        at = 0
        for s, m in cuts(n, 2048, 256):
            assert s == at and 1 <= m <= 2048
            parts = binary_parts(s, m)
            assert sum(x for _, x in parts) == m and all(x & (x - 1) == 0 for _, x in parts)
            at += m
        assert at == n


@pytest.mark.parametrize("capacity,min_piece", [(2048, 256), (64, 8)])
def test_packing_is_an_exact_round_trip(spark, capacity, min_piece):
    texts = [(i, x) for i, x in enumerate(ODD + random_texts(300, 5))] + [(None, "a null id"), (7, None), (9001, "again"), (9001, "again"),
                                                                            (9002, "word " * 4000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("sequence", F.lit(1)).withColumn("length", F.lit(2))
    got = pack_documents(df, BYTES, 1, capacity, min_piece, with_ids=True).toPandas()
    lib = Tokenizer.from_file(BYTES)
    want = sorted(array("I", lib.encode(t or "", add_special_tokens=False).ids + [1]).tobytes() for _, t in texts)
    assert (got.ids_crc32 == got.ids.map(zlib.crc32)).all() and (got.ids.map(len) == 4 * got.length).all()
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all()
    total = seq.groupby("sequence_id").length.sum()
    assert total.max() <= capacity
    # rows of one document put together again; the repeated pair comes twice
    got["key"] = got.doc_id.astype("float").fillna(-1)
    once = got[~got.key.isin([7, 9001])].sort_values(["key", "start"])
    back = sorted(b"".join(g.ids) for _, g in once.groupby("key"))
    rest = [array("I", lib.encode(t or "", add_special_tokens=False).ids + [1]).tobytes() for i, t in texts if i in (7, 9001)]
    assert sorted(back + rest) == want
    assert sorted(zip(got[got.key == 9001].length)) .__len__() % 2 == 0
    padding = sum(0 if n & (n - 1) == 0 else capacity - n for n in total)
    assert padding <= 0.1 * total.sum()
    assert pack_documents(df.limit(0), BYTES).count() == 0


def test_only_full_classes_leave_padding(spark):
    # 3 pieces of every short length: all are left-overs and end without padding
    df = spark.createDataFrame([(i, "a " * (i % 60)) for i in range(180)], "doc_id long, text string")
    total = pack_documents(df, BYTES, 1, 2048, 256).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas().n
    assert all(n & (n - 1) == 0 or n > 2048 * 0.9 for n in total)


def test_rows_of_one_id_that_share_a_piece(spark):
    """Texts of one id with equal first pieces and different lengths: each piece once, with its own document's tokens."""
    head = "word " * 100
    texts = [(i % 2 or None, head + "more " * (7 * k)) for k in range(12) for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    lib = Tokenizer.from_file(BYTES)
    want = sorted(len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts)
    got = pack_documents(df, BYTES, 1, 64, 8).toPandas()
    per = got.groupby("doc_tokens").length.sum()
    assert all(per[n] == n * want.count(n) for n in set(want)) and set(per.index) == set(want)
    assert not got.duplicated(["sequence_id", "offset"]).any()
