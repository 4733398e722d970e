"""Encoding and prefix counts against the libraries, on whole tables and odd texts."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bpe, prefix_counts
from barloom.llm.queries import LIBRARY_FILE, QUERIES, RANKS

RANK_TABLE = bpe.read_ranks(RANKS)
ODD = st.lists(
    st.sampled_from(
        ["a", " b", "the", " ", "  ", "\n", "\t", "'ll", "'re", "'s", "'", "é", "漢", "🙂", "!", "1", "<|endoftext|>",
         "<|endo", "\x1c", "　", "aba", "Th"]
    ),
    max_size=14,
).map("".join)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANK_TABLE, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.library_model(RANKS), bpe.PATTERN)


@pytest.fixture(scope="module")
def counter():
    with open(LIBRARY_FILE, encoding="utf-8") as f:
        return prefix_counts.Counter(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(LIBRARY_FILE)


def unpack(b):
    return np.frombuffer(b, dtype="<u4").tolist()


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=150, deadline=None)
@given(text=ODD)
def test_ids_offsets_and_pieces(encoder, reference, text):
    ids = unpack(encoder.pack([text])[0])
    assert ids == reference.encode_ordinary(text)
    words = {i: t for t, i in RANK_TABLE.items()}
    assert "".join(bpe.pieces_of_text(words, ids)) == text
    starts, ends, _ = encoder.offsets(text, np.array(ids, dtype=np.int64))
    for i, a, b in zip(ids, starts, ends):
        assert words[i] in text[a:b].encode()


@settings(max_examples=150, deadline=None)
@given(text=ODD)
def test_every_prefix_count(counter, library, text):
    counts = np.cumsum(np.frombuffer(counter.text(text), dtype="<i2"), dtype=np.int64).tolist()
    assert counts == [
        len(e.ids) for e in library.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)
    ]


def test_long_piece(counter, library, encoder, reference):
    text = "ab" * 30_000 + " " * 5_000
    assert unpack(encoder.pack([text])[0]) == reference.encode_ordinary(text)
    assert np.frombuffer(counter.text(text), dtype="<i2").sum() == len(library.encode(text, add_special_tokens=False).ids)


def test_op1_whole_table(spark, sf_dir, reference):
    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"][0](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_op10_whole_table(spark, sf_dir, library):
    got = {r.doc_id: r for r in QUERIES["op10_token_counts"][0](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 1024)
        assert got[r.doc_id].n_bytes == len((r.text or "").encode())


def test_odd_rows(docs, reference, library):
    done = bpe.decode(bpe.encode(docs, RANKS, offsets=True), RANKS)
    done = prefix_counts.prefix_counts(bpe.decode_pieces(done, RANKS), LIBRARY_FILE)
    rows = done.withColumns(
        {"cut": prefix_counts.longest_within(F.col("prefix.steps"), F.lit(5)),
         "at": prefix_counts.tokens_at(F.col("prefix.steps"), F.lit(3))}
    ).collect()
    assert len(rows) == docs.count() and "_k" in done.columns
    for r in rows:
        text = r.text or ""
        assert unpack(r.tokens.ids) == reference.encode_ordinary(text)
        assert bytes(r.decoded).decode() == text and "".join(r.pieces) == text
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert r.prefix.n == count(text) and r["at"] == count(text[:3])
        assert r.cut == max([k for k in range(min(len(text), 60) + 1) if count(text[:k]) <= 5] or [0])


def test_empty_table(no_docs):
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).count() == 0
    assert prefix_counts.prefix_counts(no_docs, LIBRARY_FILE).count() == 0


class Counted(dict):
    """A vocabulary that counts how often it is asked."""

    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_only_lengths_that_end_so_are_looked_up():
    with open(LIBRARY_FILE, encoding="utf-8") as f:
        counter = prefix_counts.Counter(f.read())
    counter.vocab = Counted(counter.vocab)
    words = [" internationalisation", " xqzvreconsiderations", " untokenisability", " zzyzx", " données"]
    letters = sum(len(w.encode()) for w in words)
    for w in words:
        counter.counts(w)
    assert counter.vocab.asked < 5 * letters
