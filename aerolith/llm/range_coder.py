"""Adaptive context-mixing range coder for token ids, over many blocks at a time.

A segment of ids is cut into blocks; every block starts from the same state, so each can be decoded without the others.
Blocks advance in step: one NumPy operation serves the same place of ``LANES`` blocks, so that what the coder needs besides
ids and code doesn't grow with the segment.

Each id is predicted by three orders. Order 2 and order 1 remember, for the last two ids and the last id, which id came
next and how often that held. Their confidences, and whether they agree, choose a mix: how much of the coding range goes
to the id of order 2, to the id of order 1, and to all others. Mixes adapt after every id, in each block by itself. The
others are coded by order 0, the ids' frequencies in the segment, sent once in its header.

The coder has 64 bits of range and writes 32 bits when less than that many are left; a carry goes back into what is written.
"""

from __future__ import annotations

import zlib

import numpy as np

U, W = np.uint64, np.uint32
#: Blocks that advance in step; places for which their ids are laid out at a time.
LANES, STRIP = 8192, 64
#: Contexts are hashed to this many places in each block (a power of 2).
SLOT_BITS = 9
#: Bits of a mix's shares, of their adapted values, and of order-0 frequencies.
MIX_BITS, FINE_BITS, ID_BITS = 12, 16, 18
#: How fast mixes adapt, and what a share gets for every hit, so that two shares of a mix stay below the whole.
RATE, GAIN = 4, 4080
#: Confidences (0, 1, 3) have 2 bits; a mix is kept for each pair of them and agreement.
MIXES = 32
SHIFT32, LEAST, LOW32, ZERO = U(32), U(1 << 32), U((1 << 32) - 1), U(0)
#: What orders 2 and 1 get at first, by their confidence.
PRIOR = ((300, 300), (6_000, 3_000), (0, 0), (40_000, 20_000))


class CorruptBlock(ValueError):
    """A block's checksum doesn't match its contents."""


def order_0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, sorted, and their frequencies out of 2 ** ID_BITS, none of them 0."""
    known, n = np.unique(ids, return_counts=True)
    if len(known) > 1 << (ID_BITS - 1):
        raise ValueError("too many distinct ids in one segment")
    free = (1 << ID_BITS) - len(known)
    freq = 1 + n * free // max(1, int(n.sum()))
    if len(n):
        freq[np.argmax(n)] += (1 << ID_BITS) - int(freq.sum())
    return known.astype(W), freq.astype(W)


def first_mixes() -> np.ndarray:
    """Shares of order 2 (high half) and order 1 (low half) that a block begins with, by the two confidences and agreement."""
    at = np.arange(MIXES)
    p2 = np.array([p for p, _ in PRIOR])[at >> 3]
    p1 = np.where(at & 1, 0, np.array([p for _, p in PRIOR])[(at >> 1) & 3])
    return (p2 << FINE_BITS | np.minimum(p1, (64_000 - p2) // 2)).astype(W)


class Mixer:
    """What the orders remember and the mixes, for each block in its own row. Before a context is met it predicts id 0.

    Both shares of a mix are halves of one number, so that they are looked up and adapted together; places are 64-bit
    numbers and results go to arrays that are there already, as NumPy takes longest over conversions and new memory."""

    def __init__(self, lanes: int):
        self.seen2, self.seen1 = np.zeros((2, lanes << SLOT_BITS), W)  # id << 2 | confidence
        self.mix = np.tile(first_mixes(), lanes)
        self.all64 = [np.arange(lanes) << SLOT_BITS, np.arange(lanes) * MIXES, *np.zeros((3, lanes), np.int64)]
        self.all32 = list(np.zeros((11, lanes), W))
        self.narrow(lanes)

    def narrow(self, k: int) -> None:
        """From now on only the first k blocks go on."""
        self.all64, self.all32 = [x[:k] for x in self.all64], [x[:k] for x in self.all32]

    def predict(self):
        """The ids of order 2 and 1, and their shares of the range."""
        row, mix_row, at2, at1, pat = self.all64
        hash1, before, v2, v1, g2, g1, mix, w2, w1, x, y = self.all32
        np.right_shift(before, W(3), out=x)
        np.bitwise_xor(x, hash1, out=x)
        np.multiply(x, W(0xC2B2AE35), out=x)
        np.right_shift(x, W(32 - SLOT_BITS), out=x)
        np.add(row, x, out=at2)
        np.right_shift(hash1, W(32 - SLOT_BITS), out=x)
        np.add(row, x, out=at1)
        self.seen2.take(at2, out=v2, mode="clip")
        self.seen1.take(at1, out=v1, mode="clip")
        np.right_shift(v2, W(2), out=g2)
        np.right_shift(v1, W(2), out=g1)
        # where both predict one id, order 1 is never hit, and its share goes to 0
        np.bitwise_and(v2, W(3), out=x)
        np.left_shift(x, W(2), out=x)
        np.bitwise_and(v1, W(3), out=y)
        np.bitwise_or(x, y, out=x)
        np.left_shift(x, W(1), out=x)
        np.add(x, (g2 == g1).view(np.uint8), out=x)
        np.add(mix_row, x, out=pat)
        self.mix.take(pat, out=mix, mode="clip")
        np.right_shift(mix, W(2 * FINE_BITS - MIX_BITS), out=w2)
        np.add(w2, W(1), out=w2)
        np.right_shift(mix, W(FINE_BITS - MIX_BITS), out=w1)
        np.bitwise_and(w1, W((1 << MIX_BITS) - 1), out=w1)
        np.add(w1, W(1), out=w1)
        return g2, g1, w2, w1

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit1: the id of order 1 and not that of order 2."""
        _, _, at2, at1, pat = self.all64
        hash1, before, v2, v1, g2, g1, mix, _, _, x, y = self.all32
        np.right_shift(mix, W(RATE), out=x)
        np.bitwise_and(x, W(((1 << FINE_BITS - RATE) - 1) * ((1 << FINE_BITS) + 1)), out=x)
        np.subtract(mix, x, out=mix)
        np.add(mix, np.multiply(hit2, W(GAIN << FINE_BITS), out=x), out=mix)
        np.add(mix, np.multiply(hit1, W(GAIN), out=x), out=mix)
        self.mix[pat] = mix
        np.left_shift(ids, W(2), out=y)
        np.bitwise_or(y, W(1), out=y)
        # a confidence of 3 where the id is met again
        self.seen2[at2] = np.add(y, hit2.view(np.uint8) << np.uint8(1), out=x)
        self.seen1[at1] = np.add(y, (g1 == ids).view(np.uint8) << np.uint8(1), out=x)
        self.all32[:2] = before, hash1
        np.add(ids, W(1), out=before)
        np.multiply(before, W(0x9E3779B1), out=before)


def _lengths(n: int, block: int) -> np.ndarray:
    return np.array([block] * (n // block) + [n % block] * (n % block > 0), np.int64)


def carry(out: np.ndarray, ends: np.ndarray) -> None:
    """Adds one to what is written before these places, each of another block."""
    while len(ends):
        ends = ends - 1
        out[ends] += W(1)
        ends = ends[out[ends] == 0]


def encode(ids: np.ndarray, block: int) -> tuple[bytes, list[bytes]]:
    """Header and blocks; a block is its checksum (4 bytes, of its ids as little-endian 32-bit numbers) and its code."""
    ids = np.ascontiguousarray(ids, W)
    if len(ids) and ids.max() >= 1 << 30:
        raise ValueError("ids must be below 2 ** 30")
    known, freq = order_0(ids)
    header = zlib.compress(np.array([len(ids), block, len(known)], W).tobytes() + np.diff(known, prepend=W(0)).tobytes() + freq.tobytes(), 6)
    if not len(ids):
        return header, []
    place = ((np.cumsum(freq) - freq).astype(U) << SHIFT32) | freq.astype(U)
    if known[-1] < 1 << 22:  # start and frequency of an id, by itself
        by_id = np.zeros(int(known[-1]) + 1, U)
        by_id[known] = place
        place_of = lambda x: by_id.take(x.astype(np.int64), mode="clip")
    else:
        place_of = lambda x: place.take(np.searchsorted(known, x))
    blocks: list[bytes] = []
    for at in range(0, len(ids), LANES * block):
        blocks += _encode_lanes(ids[at : at + LANES * block], block, place_of)
    return header, blocks


def _encode_lanes(ids: np.ndarray, block: int, place_of) -> list[bytes]:
    """Blocks of ids that advance in step. place_of: start and frequency of each id, in one number."""
    length = _lengths(len(ids), block)
    lanes = len(length)
    full = len(ids) // block
    whole_blocks, tail, strip = ids[: full * block].reshape(full, block), ids[full * block :], np.zeros((STRIP, lanes), W)
    out = np.zeros(lanes * (block + 4), W)
    begin = np.arange(lanes) * (block + 4)
    pos, low_all, span_all = begin.copy(), np.zeros(lanes, U), np.full(lanes, U(2**64 - 1), U)
    mixer, whole, k = Mixer(lanes), W(1 << MIX_BITS), lanes
    low, span = low_all, span_all
    for t in range(block):
        if k == lanes and t == length[-1]:
            k = full
            mixer.narrow(k)
            low, span = low_all[:k], span_all[:k]
        if not k:
            break
        at = t % STRIP
        if not at:
            strip[: block - t, :full] = whole_blocks[:, t : t + STRIP].T
            strip[: len(tail[t : t + STRIP]), full:] = tail[t : t + STRIP, None]
        x = strip[at, :k]
        g2, g1, w2, w1 = mixer.predict()
        hit2 = g2 == x
        hit1 = (g1 == x) > hit2
        hit = hit2 | hit1
        r = span >> U(MIX_BITS)
        both = w2 + w1
        new = np.where(hit, w2 * hit1, both) * r
        new += low
        np.multiply(np.where(hit, np.where(hit2, w2, w1), whole - both), r, out=span)
        other = place_of(x)
        np.right_shift(span, U(ID_BITS), out=r)
        new += np.where(hit, ZERO, (other >> SHIFT32) * r)
        other &= LOW32
        other *= r
        span[:] = np.where(hit, span, other)
        over = new < low
        if over.any():
            carry(out, pos[np.flatnonzero(over)])
        low[:] = new
        j = np.flatnonzero(span < LEAST)
        if len(j):
            at = pos[j]
            lo = low[j]
            out[at] = lo >> SHIFT32
            pos[j] = at + 1
            low[j] = lo << SHIFT32
            span[j] = span[j] << SHIFT32
        mixer.update(x, hit2, hit1)
    # of the numbers in the last range one has only zeros after its first 32 bits
    last = low_all + (LEAST - U(1))
    carry(out, pos[np.flatnonzero(last < low_all)])
    out[pos] = last >> SHIFT32
    pos += 1
    blocks, first = [], np.cumsum(length) - length
    for i in range(lanes):
        crc = zlib.crc32(ids[first[i] : first[i] + length[i]].astype("<u4", copy=False).tobytes())
        blocks.append(crc.to_bytes(4, "little") + out[begin[i] : pos[i]].astype("<u4", copy=False).tobytes())
    return blocks


def decode(header: bytes, blocks: list[bytes], only: list[int] | None = None) -> np.ndarray:
    """The ids of a segment, or those of some of its blocks; raises CorruptBlock where a checksum doesn't match."""
    raw = np.frombuffer(zlib.decompress(header), W)
    n, block, n_known = (int(v) for v in raw[:3])
    known = np.cumsum(raw[3 : 3 + n_known], dtype=W)
    freq = raw[3 + n_known :].astype(np.int64)
    if not n:
        return np.zeros(0, W)
    length = _lengths(n, block)
    if only is not None:
        blocks, length = [blocks[i] for i in only], length[only]
    place = ((np.cumsum(freq) - freq).astype(U) << SHIFT32) | freq.astype(U)
    symbol = np.repeat(np.arange(n_known, dtype=np.uint16 if n_known <= 1 << 16 else np.int32), freq)  # small, to stay near the CPU
    out, at = np.zeros(int(length.sum()), W), 0
    for i in range(0, len(length), LANES):
        n = int(length[i : i + LANES].sum())
        out[at : at + n] = _decode_lanes(blocks[i : i + LANES], length[i : i + LANES], i, block, known, place, symbol)
        at += n
    return out


def _decode_lanes(blocks: list[bytes], length: np.ndarray, number: int, block: int, known: np.ndarray, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The ids of blocks that advance in step; number: the first one's."""
    order = np.argsort(-length, kind="stable")
    sorted_length, lanes = length[order], len(order)
    words = [np.frombuffer(blocks[i], "<u4")[1:] for i in order]
    code = np.zeros((lanes, max(map(len, words)) + 4), W)
    for i, w in enumerate(words):
        code[i, : len(w)] = w
    #: What is left of the code above the range's lower end.
    rest_all, span_all = (code[:, 0].astype(U) << SHIFT32) | code[:, 1].astype(U), np.full(lanes, U(2**64 - 1), U)
    width = code.shape[1]
    code = code.reshape(-1)
    pos, end = np.arange(lanes) * width + 2, np.arange(1, lanes + 1) * width - 1
    grid = np.zeros((block, lanes), W)
    mixer, whole, k = Mixer(lanes), W(1 << MIX_BITS), lanes
    rest, span = rest_all, span_all
    for t in range(int(sorted_length[0])):
        if sorted_length[k - 1] <= t:
            k = int(np.searchsorted(-sorted_length, -t))
            mixer.narrow(k)
            rest, span = rest_all[:k], span_all[:k]
        g2, g1, w2, w1 = mixer.predict()
        r = span >> U(MIX_BITS)
        both = w2 + w1
        a, b = w2 * r, both * r
        hit2, miss = rest < a, rest >= b
        hit = ~miss
        hit1 = hit > hit2
        rest -= np.where(hit, a * hit1, b)
        np.multiply(np.where(hit, np.where(hit2, w2, w1), whole - both), r, out=span)
        # order 0, of all blocks, as most ids come from it
        np.right_shift(span, U(ID_BITS), out=r)
        s = symbol.take((rest // r).view(np.int64), mode="clip").astype(np.int64)
        other = place.take(s, mode="clip")
        x = np.where(hit2, g2, np.where(hit, g1, known.take(s, mode="clip")))
        rest -= np.where(hit, ZERO, (other >> SHIFT32) * r)
        other &= LOW32
        other *= r
        span[:] = np.where(hit, span, other)
        j = np.flatnonzero(span < LEAST)
        if len(j):
            at = pos[j]
            rest[j] = (rest[j] << SHIFT32) | code[at]
            pos[j] = np.minimum(at + 1, end[j])
            span[j] = span[j] << SHIFT32
        grid[t, :k] = x
        mixer.update(x, hit2, hit1)
    out, first = np.zeros(int(length.sum()), W), np.cumsum(length) - length
    for lane, i in enumerate(order):
        mine = out[first[i] : first[i] + length[i]]
        mine[:] = grid[: length[i], lane]
        if zlib.crc32(mine.astype("<u4", copy=False).tobytes()) != int.from_bytes(blocks[i][:4], "little"):
            raise CorruptBlock(f"block {number + i}")
    return out
