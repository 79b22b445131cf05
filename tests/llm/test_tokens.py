"""Token counts and packing against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakestream.llm import packing, token_counts
from lakestream.llm.pieces import cutter
from tests.llm.conftest import DOCUMENTS, TRICKY, document

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "it's we'll I'D they'Ve 'tis ''s !'s don't",
    "<|endoftext|> a<|startoftext|>b <|endoftext| > <|ENDOFTEXT|>",
    "Ünïcödé Straße ŁÓDŹ ﬁne ℌ ½ ²3 ٣ Ⅷ İstanbul ΣΊΣΥΦΟΣ ẞ ǅ ŉ ſ ǰ",
    "H̱ é ño ẖ Å",
    "日本語 テスト 한국어 ไทย 🙂👍🏽 \U00010400",
    "nbsp nel\u0085 ogham  zw​sp soft­hyphen \x1c\x1d\x1e\x1f \x00 \x7f",
    "tab\tline\nfeed\x0b\x0c\r\n",
    "a" * 3000 + " " + "!" * 500 + "1" * 100,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_give_the_tokens_of_the_text(tokenizer, text):
    cut = cutter(PATH)
    ids = cut.tokens(cut.cut(text))[0].tolist()
    assert ids == ids_of(tokenizer, text)


def test_every_character_is_cut_as_the_tokenizer_does(tokenizer):
    cut = cutter(PATH)
    for start in range(0, 0x3000, 64):
        text = " x".join(f"{chr(i)}a{chr(i)}1{chr(i)}!{chr(i)}" for i in range(start, start + 64) if not 0xD800 <= i < 0xE000)
        ids = cut.tokens(cut.cut(text))[0].tolist()
        assert ids == ids_of(tokenizer, text), hex(start)


def check_counts(rows, texts, tokenizer):
    want = sorted((repr(i), len((t or "").encode()), len(ids_of(tokenizer, t))) for i, t in texts)
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_token_counts(spark, given, tricky, nothing, tokenizer):
    docs, texts = given
    check_counts(token_counts.token_counts(docs, PATH).collect(), texts.items(), tokenizer)
    check_counts(token_counts.token_counts(tricky, PATH).collect(), [r[:2] for r in TRICKY], tokenizer)
    odd = spark.createDataFrame([document(i, t) for i, t in enumerate(ODD)], DOCUMENTS)
    check_counts(token_counts.token_counts(odd, PATH).collect(), enumerate(ODD), tokenizer)
    assert token_counts.token_counts(nothing, PATH).count() == 0


def check_packing(pieces, texts, tokenizer, window):
    """Sequences are gapless, and each document's pieces are its ids, once each."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        documents[p["doc_id"]].append(p)
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert sorted(sizes, reverse=True)[:-1] == [window] * (len(sizes) - 1) and max(sizes) <= window
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append([*ids_of(tokenizer, text), 1])
    for doc_id, ids in want.items():
        parts = sorted(documents.pop(doc_id), key=lambda p: (p["doc_tokens"], p["sequence_id"], p["offset"]))
        for one in sorted(ids, key=len):
            at = 0
            while at < len(one):
                p = next(p for p in parts if p["doc_tokens"] == len(one) and p["start"] == at)
                parts.remove(p)
                data = np.array(one[at : at + p["length"]], "<u4").tobytes()
                assert zlib.crc32(data) == p["ids_crc32"]
                at += p["length"]
                ends = (p["start"] == 0, at == len(one))
                assert p["boundary"] == {(1, 1): "whole", (1, 0): "begins", (0, 1): "ends", (0, 0): "crosses"}[ends]
        assert not parts
    assert not documents


def test_packing(given, tricky, nothing, tokenizer):
    docs, texts = given
    check_packing(packing.packed(docs, PATH).collect(), texts.items(), tokenizer, 2048)
    pieces = packing.packed(tricky, PATH, window=64).collect()
    check_packing(pieces, [r[:2] for r in TRICKY], tokenizer, 64)
    assert packing.packed(nothing, PATH).count() == 0


def test_remembered_ids_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    known = packing.Ids(PATH)
    for text in ("a b c d e", "a b", "f g h i j k"):
        ids, sizes = known.of([text, "", text])
        assert ids.tolist() == 2 * ids_of(tokenizer, text) and sizes.tolist() == [len(ids) // 2, 0, len(ids) // 2]
