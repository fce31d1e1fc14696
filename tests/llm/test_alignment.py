"""Alignment of two tokenisations (11) against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from murmurate.llm import crosstoken, tokens
from murmurate.llm.queries import BYTE_PIECES, QUERIES, SENTENCE_PIECES

PATTERN = public_tokenizers.PATTERN
DIRECT = {special: Tokenizer.from_file(BYTE_PIECES) for special in (True, False)}
ODD = [None, "", " ", "\n\t ", "a", "é😀 x", "<|endoftext|> <s> </s>", "▁x", "a\x00b", "same", "same", "x" * 300, "word " * 60, "1" * 200, " ٣ ߁ Ⅷ", "naïve Straße ½", "  two  blanks \n\n x", "\x85\xa0 x", "\x1c\x1dx"]


def plain(texts):
    """Per text: tokens of either side, groups, links, links of the best pairs, sum of counts, groups as text."""
    a_side = Tokenizer.from_file(BYTE_PIECES)
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=SENTENCE_PIECES)
    a_bytes, b_bytes = tokens.byte_level(BYTE_PIECES, PATTERN, False).pieces(), tokens.sentence_pieces(SENTENCE_PIECES).pieces()
    rows, counts = [], Counter()
    for text in texts:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
            a, b = [], []
        spans = []
        for ids, of in ((a, a_bytes), (b, b_bytes)):
            ends = np.cumsum([len(of[k]) for k in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [
            "|".join(",".join(str(k) for k, (s, e) in zip(ids, own, strict=True) if low <= s and e <= high) for ids, own in zip((a, b), spans, strict=True))
            for low, high in zip([0, *cuts], cuts, strict=False)
        ]
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if max(s, u) < min(e, v)]
        counts.update(links)
        rows.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n, m, g, len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links), text) for n, m, g, links, text in rows]


def given_docs(spark, texts):
    """Documents with extra columns under names that the operator uses."""
    rows = [(k, x, "a", 1, [1]) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, place int, docs array<int>")


def result(docs, **more):
    found = crosstoken.align(docs, BYTE_PIECES, SENTENCE_PIECES, PATTERN, with_groups=True, **more).collect()
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in found}, found


@pytest.mark.parametrize("size", [40, crosstoken.BLOCK])
def test_alignment_equals_brute_force(spark, size):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choices("abc é\n😀1", k=rng.randint(1, 60))) for _ in range(150)] + ["of the people " * 30] * 40
    found, rows = result(given_docs(spark, texts), size=size)
    assert [found[k] for k in range(len(texts))] == plain(texts)
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows)
    assert sum(not r["n_a"] for r in rows) == 3  # null, empty and the text whose blank mark is no blank
    assert all(r["n_links"] == max(0, r["n_a"] + r["n_b"] - r["n_groups"]) for r in rows)


def test_alignment_of_repeated_and_null_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "one two")], "doc_id int, text string")
    found = crosstoken.align(docs, BYTE_PIECES, SENTENCE_PIECES, PATTERN)
    assert found.schema["doc_id"].dataType.simpleString() == "int" and found.count() == 4
    assert sorted(r["count_sum"] for r in found.collect()) == sorted(x[5] for x in plain(["one two", "one two", "three", "one two"]))
    assert crosstoken.align(docs.limit(0), BYTE_PIECES, SENTENCE_PIECES, PATTERN).count() == 0


@pytest.mark.parametrize("text", ["a" * 5_000_000, " " * 5_000_000, "7" * 5_000_000, "word " * 1_000_000], ids=["letters", "blanks", "digits", "words"])
def test_alignment_of_very_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    one = {r["doc_id"]: r for r in crosstoken.align(docs, BYTE_PIECES, SENTENCE_PIECES, PATTERN).collect()}[1]
    a = Tokenizer.from_file(BYTE_PIECES).encode(" " + text, add_special_tokens=False).ids
    assert one["n_a"] == len(a) and one["n_links"] == one["n_a"] + one["n_b"] - one["n_groups"] > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True), st.lists(st.integers(0, 400), unique=True))
def test_gallop_counts_smaller_ends(keys, ends):
    keys, ends = np.sort(np.array(keys, np.int64)), np.sort(np.array(ends, np.int64))
    assert crosstoken.gallop(keys, ends).tolist() == np.searchsorted(ends, keys).tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab1'sé ½\n\t \u0085\x1cǅ٣߁😀.!?"), max_size=40) | st.text(max_size=40))
def test_cached_words_give_the_ids_of_the_tokenizer(text):
    for special, direct in DIRECT.items():
        direct.encode_special_tokens = not special
        for x in (text, text + "<|endoftext|>"):
            assert tokens.byte_level(BYTE_PIECES, PATTERN, special).encode(x).tolist() == direct.encode(x, add_special_tokens=False).ids


def test_words_survive_the_turn_of_the_cache(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    coder, rng = tokens.ByteLevel(BYTE_PIECES, PATTERN, True), random.Random(12)
    for _ in range(100):
        text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 80)))
        assert coder.encode(text).tolist() == DIRECT[True].encode(text, add_special_tokens=False).ids
        assert len(coder.known) <= 130 and len(coder.older) <= 130


def test_words_that_came_first_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    encoded, word = [], tokens.ByteLevel._word
    monkeypatch.setattr(tokens.ByteLevel, "_word", lambda self, x: encoded.append(x) or word(self, x))
    coder = tokens.ByteLevel(BYTE_PIECES, PATTERN, True)
    frequent = " ".join(f"first{c}" for c in "abcdefghij")
    rare = [" ".join("rare" + chr(97 + k // 26) + chr(97 + k % 26) + c for c in "abcdefghij") for k in range(100)]
    for text in (frequent, *rare, frequent):
        assert coder.encode(text).tolist() == DIRECT[True].encode(text, add_special_tokens=False).ids
    assert len(encoded) == len(set(encoded))


def test_alignment_query_keeps_every_document(spark):
    found = QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    expected = plain([r["text"] for r in docs if len(r["text"] or "") < 300])
    short = {r["doc_id"] for r in docs if len(r["text"] or "") < 300}
    rows = found.collect()
    assert len(rows) == len(docs)
    assert sorted((r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in rows if r["doc_id"] in short) == sorted(x[:4] for x in expected)
