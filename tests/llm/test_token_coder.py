"""The token files' coder: cheap steps, exact carries, counts that stay in their lanes, damage that is found."""

import numpy as np
import pytest

from keystrata.llm import token_files


def test_a_step_passes_words_on_once(monkeypatch):
    """Each round of words costs calls over all blocks; a step of several rounds took the query beyond its CPU budget."""
    rounds, pass_on = [], token_files._Writer._pass_on
    monkeypatch.setattr(token_files._Writer, "_pass_on", lambda self, due: (rounds.append(1), pass_on(self, due))[1])
    ids = (np.random.default_rng(3).zipf(1.2, 200 * 128) % 50257).astype(np.uint32)
    coded = token_files.encode_blocks(ids, 128)
    assert (token_files.decode_blocks(coded, len(ids), 128) == ids).all()
    assert len(rounds) <= 128 + 4


def as_integer(parts):
    """Begin and end of the part that the puts lead to, of 2**64 shifted up by the words passed on, in exact arithmetic."""
    low, width = 0, (1 << 64) - 1
    for cum, freq, total, place, bits in parts:
        width //= total
        low, width = low + cum * width, width * freq >> bits
        low += place * width
        if width < 1 << 32:
            low, width = low << 32, width << 32
    return low


@pytest.mark.parametrize("kind", ["any", "highest", "carries"])
def test_words_equal_exact_arithmetic(kind):
    """``highest`` makes words of ones alone, which ``carries`` then lets overflow."""
    rng, n, steps = np.random.default_rng(5), 50, 60
    puts = []
    for t in range(steps):
        total = rng.integers(2, 1 << 15, n)
        cum = total - 1 if kind != "any" and t < steps - 1 else rng.integers(0, total)
        freq = rng.integers(1, total - cum + 1)
        bits = rng.integers(0, 17, n)
        place = (1 << bits) - 1 if kind == "highest" else rng.integers(0, 1 << bits)
        puts.append((cum, freq, total, place, bits))
    writer = token_files._Writer(n, steps + 4)
    if kind == "carries":
        writer.low[:] = 0xFFFFFFFFFFFFFFFF  # after words of ones, as if it had been passed on so
        writer.at += n * 2
        writer.words[n : 2 * n] = 0xFFFFFFFF
        writer.width[:] = 1 << 40
    for put in puts:
        writer.put(*(x.astype(np.uint64) for x in put))
    coded = writer.end()
    if kind == "carries":
        assert all(b[:8] == bytes([1, 0, 0, 0, 0, 0, 0, 0]) for b in coded)
        return
    for i, b in enumerate(coded):
        words = np.frombuffer(b, "<u4").tolist()
        assert sum(w << 32 * k for k, w in enumerate(reversed(words))) == as_integer([[int(x[i]) for x in put] for put in puts])
    reader = token_files._Reader(coded)
    for cum, freq, total, place, bits in puts:
        value = reader.value(total.astype(np.uint64)).astype(np.int64)
        assert ((value >= cum) & (value < cum + freq)).all()
        assert (reader.take(*(x.astype(np.uint64) for x in (cum, freq, bits))).astype(np.int64) == place).all()


def test_counts_stay_in_their_lanes():
    """The same outcome at the same confidences all along, and outcomes that alternate."""
    for ids in (np.full(5000, 7), np.tile([1, 60000], 2500), np.arange(5000)):
        model = token_files._Model(1)
        for x in ids.astype(np.uint32):
            f, cum, total = model.look()
            lanes = f.view(np.uint16).ravel()
            assert lanes.min() >= 1 and lanes.astype(int).sum() == total[0] < 1 << 15
            assert cum.view(np.uint16).ravel().tolist() == np.cumsum(lanes).tolist()
            right = model.guess == x
            out = np.array([0 if right[2] else 1 if right[1] else 2 if right[0] else 3])
            model.update(np.array([x]), right, out, model.lane + out)


def test_large_ids_and_long_blocks():
    rng = np.random.default_rng(9)
    for ids in (np.full(9000, 7), np.array([2**30 - 1, 2**30, 2**32 - 1, 0, 76287, 76288, 10751, 10752] * 40), rng.integers(0, 2**32, 700), np.full(300, 2**30 - 1)):
        ids = ids.astype(np.uint32)
        for block in (1, 16, 33, 4096):
            assert (token_files.decode_blocks(token_files.encode_blocks(ids, block), len(ids), block) == ids).all()


def test_any_damaged_byte_is_found():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 3000) % 90000).astype(np.uint32)
    segment = token_files.pack_segment(np.array([1]), np.array([True]), np.array([len(ids)]), ids, 64)
    for at in [*rng.integers(28, len(segment), 60).tolist()]:
        broken = bytearray(segment)
        broken[at] ^= int(rng.integers(1, 256))
        try:
            assert (token_files.unpack_segment(memoryview(bytes(broken)), 0)[3] == ids).all()  # a byte behind all that decides
        except ValueError as e:
            assert "checksum" in str(e) or "no sound segment" in str(e)
