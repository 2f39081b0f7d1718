"""The codec against the tokenizer's own library, and round trips."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evalweave.llm import bpe_codec, packed
from tests.llm import messy

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "it's  I'LL we've 'd\n\n  \t x", " ", "   ", "\r\n   x", "<|endoftext|>a <|endoftext|>", "<|endoftext",
    "ab" * 5000, "՘࢏ new letters \U00010d40౜", "é ퟿ �\x00", "١٢٣ ½ ²x", "-- ''s", "🙂🙂 👩‍👩‍👧",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    decoded = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), digest(",".join(map(str, ids))), digest(decoded)


@pytest.mark.parametrize("words, buckets", [(4_000_000, None), (40, 3)])
def test_digests(spark, library, monkeypatch, words, buckets):
    monkeypatch.setattr(bpe_codec, "WORDS_AT_ONCE", words)
    rows = messy.TEXTS + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = bpe_codec.digests(messy.docs(spark, rows).repartition(3), PATH, buckets=buckets)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(library, *r) for r in rows)


def test_ids_and_texts(spark, library):
    got = bpe_codec.encode_decode(messy.docs(spark, [(i, t) for i, t in enumerate(TEXTS)]), PATH).collect()
    for row in got:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == library.encode(TEXTS[row.doc_id], add_special_tokens=False).ids
        assert row.decoded == TEXTS[row.doc_id]


def test_no_rows(spark):
    assert bpe_codec.digests(messy.empty(spark), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_words_are_the_library_s(text):
    codec = bpe_codec.codec(PATH)
    words = codec.split(text)
    assert "".join(words) == text
    ids = codec.ids.library.encode(text, add_special_tokens=False).ids
    assert b"".join(codec.ids.of(w) for w in words) == np.array(ids, "<u4").tobytes()


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.loads(open(PATH).read())
    spec["added_tokens"][0]["lstrip"] = True
    changed = tmp_path / "changed.json"
    changed.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe_codec.Codec(str(changed))


def test_word_lists_and_packed_integers():
    lists = [[], [b""], [b"a", b"", "é".encode()], [b"x" * 70_000, b"\n"]]
    assert [bpe_codec._unlisted(bpe_codec._listed(x)) for x in lists] == lists
    for kind, values in (("<i4", [0, -1, 2**31 - 1]), ("<i8", [2**40, -5]), ("<u4", [2**32 - 1]), ("<i4", [])):
        assert packed.unpack(packed.pack(np.array(values), kind), kind).tolist() == values
    assert packed.runs(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
