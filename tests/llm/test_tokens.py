"""Token counts and packing against the libraries themselves."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalweave.llm import packing, token_counts
from tests.llm import messy

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab  \n\n\t.,'▁é字\U0001f600<s></s><|endoftext|>0١2½ \x85\xa0　\x1c\x00ſ\r"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    return messy.TEXTS + [(100 + i, t) for i, t in enumerate(odd)]


def test_segments_lose_nothing():
    text = " a  b\n\n c ▁d "
    assert "".join(token_counts.segments(text)) == " " + text.replace("▁", " ")
    assert token_counts.segments("") == []


def test_whole_tokens_are_proven():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    whole = token_counts.prove_model(MODEL)
    assert " the" in whole and len(whole) > 20_000
    for text in random.Random(2).sample(sorted(whole), 200):
        assert len(model.encode("\n" + text)) == len(model.encode("\n")) + 1


def test_counts(spark, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = messy.docs(spark, texts).repartition(3)
    got = token_counts.count_tokens(df, MODEL, limit=20).collect()
    want = Counter()
    for i, t in texts:
        n = len(model.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 20] += 1
    assert Counter(tuple(r) for r in got) == want
    assert token_counts.count_tokens(messy.empty(spark), MODEL).count() == 0


def check_packing(rows, texts, window, end=0):
    library = Tokenizer.from_file(BYTES)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        own = sorted((r for r in pieces[i] if r.doc_tokens == len(ids)), key=lambda r: r.start)
        copies = sum(1 for r in own if r.start == 0)
        assert copies >= 1
        covered = Counter()
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.length > 0
            covered.update(range(r.start, r.start + r.length))
        assert set(covered) == set(range(len(ids))) and set(covered.values()) == {copies}
        want[i] += len(ids)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    padding = 0
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += (window - at) if at & (at - 1) else 0
    return padding


@pytest.mark.parametrize("window, most_open", [(1024, 4096), (64, 3)])
def test_packing(spark, texts, monkeypatch, window, most_open):
    monkeypatch.setattr(packing, "MOST_OPEN", most_open)
    df = messy.docs(spark, texts).repartition(3)
    rows = packing.pack(df, BYTES, window).collect()
    assert check_packing(rows, texts, window) == 0
    assert packing.pack(messy.empty(spark), BYTES).count() == 0


def test_same_ids_as_the_library():
    ids = packing.TextIds(BYTES)
    library = Tokenizer.from_file(BYTES)
    assert ids.fast is not None
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 64):
        for text in ("".join(every[at : at + 64]), " a".join(every[at : at + 64])):
            assert np.frombuffer(ids.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_choice():
    """The level chosen never changes the sum of squares more than another would."""
    rng = np.random.default_rng(3)
    packer = packing.Packer(32, most_open=10**6)
    for doc in range(400):
        size = int(rng.integers(1, 32))
        before = packer.counts.copy()

        def after(level, size=size, before=before):
            counts = before.copy()
            counts[level] -= level > 0
            counts[level + size] += level + size < 32
            return int((counts[1:32] ** 2).sum())

        open_levels = [0, *(h for h in range(1, 33 - size) if before[h])]
        packer.add(doc, b"\1\0\0\0" * size)
        assert int((packer.counts[1:32] ** 2).sum()) == min(map(after, open_levels))
    packer.finish()
    assert sum(p[2] for p in packer.pieces) == packer.next_sequence * 32 - sum(
        32 - sum(p[2] for p in packer.pieces if p[5] == s)
        for s in range(packer.next_sequence)
    )
