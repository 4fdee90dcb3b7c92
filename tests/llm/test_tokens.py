import random

import duckdb
import pyarrow as pa
from tokenizers import Tokenizer

from symbolmill.llm import tokens
from symbolmill.llm.tokens import TOKENIZERS, VOCABULARY, _PATTERN, count_tokens, encode_documents, encoded_words, merge_replay, slice_words, sliced, words_of

SCHEMA = "doc_id long, text string, ids string"


def reference():
    t = Tokenizer.from_file(f"{TOKENIZERS}/{VOCABULARY}")
    t.encode_special_tokens = True
    return t


def odd_texts(n=400):
    rnd = random.Random(5)
    pool = [chr(i) for i in range(0x250)] + list("’“–…→①数据👩‍💻🚚ыД\u200b\u0301\u2028\u3000") + ["  ", "\r\n", "'re", " don't", "12345", "foo", "Bar_baz", "<|endoftext|>"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 60))) for _ in range(n)]


def test_same_as_the_public_tokenizer(spark):
    con = duckdb.connect()
    texts = [r[0] for r in con.execute("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += [*odd_texts(), None, "", " ", "\n\n", "a" * 5000, "ab" * 3000 + " x", "<|endoftext|>"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    expected = reference().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert len(got) == len(texts)
    assert [i for i, e in enumerate(expected) if got[i] != e.ids] == []
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert all(sizes[i] == len(e.ids) for i, e in enumerate(expected))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (1, "abc", "x")], SCHEMA)
    assert encode_documents(df).count() == 2
    assert encode_documents(df.limit(0)).count() == 0


def test_round_trip_of_words():
    ids = merge_replay(f"{TOKENIZERS}/{VOCABULARY}").encode(["hello", " world", "", "aaaaaaa"])
    assert reference().decode(ids[0] + ids[1]) == "hello world" and ids[2] == [] and reference().decode(ids[3]) == "aaaaaaa"
    assert all(words_of(t) == _PATTERN.findall(t) for t in odd_texts(2000))


def test_a_word_of_the_corpus_is_encoded_in_one_partition(spark):
    rows = [(i, f"every text has the word{i % 7} and its own x{i}", "x") for i in range(3000)] + [(None, None, "x"), (None, "", "x")]
    slices = sliced(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert slices.select("slice").distinct().count() > 1
    words = slice_words(slices)
    coded = encoded_words(words, f"{TOKENIZERS}/{VOCABULARY}")
    from pyspark.sql import functions as F

    parts = coded.withColumn("p", F.spark_partition_id()).groupBy("word").agg(F.countDistinct("p").alias("n"), F.countDistinct("ids").alias("m"))
    assert parts.filter("n > 1 or m > 1").count() == 0
    assert coded.count() == words.distinct().count()


class Direct:
    """Stands for a DataFrame: hands back what would run over its batches."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_text_that_comes_again_is_not_split_again(monkeypatch):
    rnd, split = random.Random(2), []
    pool = [" The", " plan's", " foo(bar);", "\n    return", " \u0441\u043b\u043e\u0432\u043e", " \u20ac12.50", "\t\t}", "  12345"]
    texts = ["".join(rnd.choice(pool) for _ in range(300)) for _ in range(200)] + [None, ""]
    expected = {w for t in texts if t for w in _PATTERN.findall(t)}
    monkeypatch.setattr(tokens, "words_of", lambda t: split.append(len(t)) or words_of(t))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(texts), pa.int64()), pa.array(texts)], ["slice", "text"])
    out = pa.Table.from_batches(slice_words(Direct())(iter([batch])))
    assert set(out["word"].to_pylist()) == expected and set(out["slice"].to_pylist()) == {7} and len(out) == len(expected)
    assert sum(split) < sum(len(t or "") for t in texts) / 100


def test_pieces_have_the_words_of_their_texts():
    rnd = random.Random(3)
    blanks = [" ", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", *map(chr, (0x1680, 0x2000, 0x2003, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
    signs = ["a", "B", "1", "?", "'s", "'re", *map(chr, (0xC9, 0xDF, 0xE0, 0x81, 0x301, 0x44B, 0x200B, 0x2019, 0x180E, 0xFEFF, 0x6570, 0x10400, 0x1F469))]
    for _ in range(300):
        texts = ["".join(rnd.choice(rnd.choice((blanks, signs))) for _ in range(rnd.randrange(14))) for _ in range(30)] + [None, "", None]
        pieces, bounds = tokens.pieces_of(pa.array(["cut off", *texts, "cut off"])[1:-1])
        words, firsts = tokens.words_of_pieces(pieces.dictionary)
        order = pieces.indices.to_pylist()
        got = [[w for k in order[a:z] for w in words[firsts[k] : firsts[k + 1]]] for a, z in zip(bounds, bounds[1:], strict=False)]
        assert got == [_PATTERN.findall(t or "") for t in texts]
    assert tokens.pieces_of(pa.array([], pa.string()))[1].tolist() == [0] and tokens.words_of_pieces(pa.array([], pa.string()))[0] == []
