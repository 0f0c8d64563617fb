"""Packing: an exact round trip of token ids, certified bin counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.packing import Encoder, best_fit, lower_bound, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", " b", "\n", ".", " ,", "é", "1", "'s", "  ", "\t", "<|endoftext|>", "漢"]), max_size=20).map("".join))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert np.frombuffer(ENCODER.ids(text), "<u4").tolist() == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, got, room=1024):
    ids = {r[0]: ENCODER.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r.ids_crc32
    copies = {i: sum(r[0] == i for r in rows) for i in ids}
    for i, own in pieces.items():
        n = len(ids[i])
        want = [(0, 0, n)] if n <= room else None
        if want is None:
            first = n % room or room
            want = [(k, s, min(first if k == 0 else room, n - s)) for k, s in enumerate([0, *range(first, n, room)])]
        assert sorted((p.piece, p.start, p.length) for p in own) == sorted(want * copies[i])
    assert pieces.keys() == ids.keys()
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= room
    return len(sequences)


@pytest.mark.parametrize("per_task", [20000, 60])
def test_pieces_and_sequences(make_docs, per_task):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "tokens", "é", "x1"]) for _ in range(rng.choice([3, 50, 300, 700, 1500, 5000]))), "en", "a") for i in range(250)]
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "a " * 60000, None, None), (1003, " a" * 1023, None, None), (1004, " a" * 1024, None, None)]
    rows += rows[:5] + [rows[-1]]
    got = pack(make_docs(rows), PATH, per_task=per_task).collect()
    n = check(rows, got)
    bound = lower_bound(np.bincount([r.length for r in got], minlength=1025))
    assert bound <= n <= bound + 1 + (per_task < 100)


def test_nothing_to_pack(make_docs):
    assert pack(make_docs([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_are_bounds(seed):
    rng = random.Random(seed)
    room = 24
    lengths = [rng.randrange(1, room + 1) for _ in range(9)]

    def fewest(items, free):
        if not items:
            return len(free)
        best = fewest(items[1:], [*free, room - items[0]])
        for i in {f: i for i, f in enumerate(free) if f >= items[0]}.values():
            best = min(best, fewest(items[1:], [*free[:i], free[i] - items[0], *free[i + 1:]]))
        return best

    exact = fewest(sorted(lengths, reverse=True), [])
    bins, offsets, free = best_fit(np.array(lengths), room)
    assert lower_bound(np.bincount(lengths, minlength=room + 1)) <= exact <= len(free)
    assert lower_bound(np.bincount([13] * 6, minlength=room + 1)) == 6
    for b in range(len(free)):
        own = sorted((offsets[i], lengths[i]) for i in range(9) if bins[i] == b)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == room - free[b]
