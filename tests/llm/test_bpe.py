import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chalkline.llm import automaton, counts, vocabulary

PIECES = ["a", "b", "é", "É", "Σ", "σας", "İ", "ß", "ﬁ", "ab", "the", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'ll", "'RE",
          "1", "23", "½", "!!", "...", "<|endoftext|>", "<|startoftext|>", "<|endo", "é", "́", "한", "日本", "😀", "👍🏽", "​", "aaa", "ab" * 40, "\x00", "ʰ", "Ⅷ"]


def texts():
    rng = random.Random(4)
    odd = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(1500)]
    return odd + ["", "a" * 30_000, "ab" * 20_000, "!" * 5000, " " * 3000, "\n " * 500, "x" + " " * 50 + "y", "Then, here: it IS. " * 800]


@pytest.fixture(scope="module")
def word():
    path = public_tokenizers.path("word_bpe_49k.json")
    return vocabulary.load(path), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def byte():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return vocabulary.load(path), Tokenizer.from_file(path)


def test_automaton_against_the_library(word):
    vocab, library = word
    codec = automaton.WordCodec(automaton.compile_merges(vocab), vocab.special)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        ids, decoded = codec.code(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_automaton_against_plain_merging():
    """Random small vocabularies, all words over their symbols."""
    rng = random.Random(6)
    for _ in range(20):
        symbols, merges = ["a", "b", "c"], []
        for _ in range(8):
            pair = (rng.choice(symbols), rng.choice(symbols))
            if pair not in merges and "".join(pair) not in symbols:
                merges.append(pair)
                symbols.append("".join(pair))
        vocab = vocabulary.Vocabulary({s: k for k, s in enumerate(symbols)}, merges, {}, "")
        auto = automaton.compile_merges(vocab)
        for _ in range(200):
            parts = rng.choices("abc", k=rng.randint(1, 12))
            text = "".join(parts)
            for pair in merges:
                k = 0
                while k + 1 < len(parts):
                    if (parts[k], parts[k + 1]) == pair:
                        parts[k:k + 2] = ["".join(pair)]
                    k += 1
            assert [symbols[k] for k in auto.encode(text)] == parts


def test_counts_against_the_library(byte):
    vocab, library = byte
    counter = counts.Counter(counts.Merges(vocab), vocab.special)
    for t in texts():
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:60]


def test_queries_on_odd_rows(spark, make_docs, word, byte):
    rows = [(1, None), (1, None), (2, ""), (3, "One two. Three!"), (None, "É é"), (5, "w " * 2000)]
    docs = make_docs(rows).withColumn("id", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(0))
    full = {(r.id, r.decoded): r.ids for r in automaton.encode_documents(docs, word[0]).collect()}
    for i, t in rows:
        want = word[1].encode(t or "", add_special_tokens=False).ids
        assert full[i, word[1].decode(want, skip_special_tokens=False)] == want
    digests = sorted(automaton.encode_digests(docs, word[0]).collect(), key=str)
    assert len(digests) == len(rows)
    assert sum(r.ids_sha256 == sha256(b"").hexdigest() and r.n_tokens == 0 for r in digests) == 3
    got = sorted(((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(docs, byte[0]).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(byte[1].encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert got == sorted(want, key=str)
    assert automaton.encode_documents(make_docs([]), word[0]).count() == 0 and counts.count_tokens(make_docs([]), byte[0]).count() == 0
