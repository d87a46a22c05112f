import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F
from quillon.llm.spool import Spool
from quillon.llm.token_orc import WordEncoder, read_tokens, token_digests, write_tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def brute(plain, rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


EDGE = [(5, None), (6, ""), (7, " \n\t\x0b\x0c"), (8, "x" * 70_000), (9, "It's <|endoftext|>end<|startoftext|> a b c é ́x ΣΣ İ"), (-3, "minus"), (10, "don't stop 12345 !!! ... ünï 漢字かな 🎉🎉"), (10, "again")]


def test_words_give_the_ids_of_whole_texts(plain):
    r = random.Random(3)
    pieces = list("abcABZ019'.,!<|>éÉßΣσ̧́ͅ  　漢🎉‍\x1c\x85 \n\t ") + ["<|endoftext|>", "'s", " 've", "\r\n", "İ", "İ,", "e\u0301.", "x…", "…!", "ﬁ!", "Ⅷ.", "١٢.", "(a)", "a--b", "a.b.", "!?", "\u200d,", "ñ\u0303;", "한.", "\u1100\u1161!", "ǅ,"]
    texts = ["".join(r.choices(pieces, k=r.choice([1, 5, 40]))) for _ in range(3000)] + [t or "" for _, t in EDGE]
    encoder = WordEncoder(PATH)
    for i in range(0, len(texts), 500):
        ids, ends = encoder.encode([t.encode() for t in texts[i : i + 500]], 1)
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts[i : i + 500]]


@pytest.mark.parametrize("most", [40, 300])
def test_forgetting_pieces_changes_no_id(plain, most):
    r = random.Random(most)
    pieces = [*"abcXYZ019'.,!|<é漢 \n\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "J\u030c", "'LL", "word", "naïveté", "supercalifragilisticexpialidocious"]
    encoder = WordEncoder(PATH, most)
    for _ in range(5):
        texts = ["".join(r.choices(pieces, k=r.choice([0, 1, 5, 200]))) for _ in range(400)]
        ids, ends = encoder.encode([t.encode() for t in texts], 1)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, whole = ["It's  two\nlines", "", "é"], Tokenizer.from_file(path)
    ids, ends = WordEncoder(path).encode([t.encode() for t in texts], 1)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_files_hold_every_id_in_order(spark, sf, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(d - 1000, t) for d, t in EDGE]
    df = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, start int, file string").repartition(4)
    path = Spool(spark, "test").path("tokens")
    write_tokens(df, path, PATH)
    assert answer(token_digests(read_tokens(spark, path))) == brute(plain, rows)
    one = read_tokens(spark, path).where("doc_id = -992")
    assert one.count() == 1
    plan = one._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,-992)" in plan
    files = sorted(p for p in __import__("glob").glob(path.removeprefix("file:") + "/*.orc"))
    firsts = [x for x in (orc.read_table(f).column("doc_id").to_pylist() for f in files) if x]
    assert all(x == sorted(x) for x in firsts) and [x[0] for x in firsts] == sorted(x[0] for x in firsts)


def test_null_id_and_empty_table(spark, plain):
    spool = Spool(spark, "test")
    write_tokens(spark.createDataFrame([(None, "a b"), (1, "c")], "doc_id long, text string"), spool.path("a"), PATH)
    assert answer(token_digests(read_tokens(spark, spool.path("a")))) == brute(plain, [(None, "a b"), (1, "c")])
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), spool.path("b"), PATH)
    assert read_tokens(spark, spool.path("b")).agg(F.count("*")).first()[0] == 0
