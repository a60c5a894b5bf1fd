"""An adaptive context-mixing range coder for token ids, run over many independent blocks in lockstep.

Each block is reset and coded alone: its bytes decode without any other block. Three predictions are mixed into one interval
for each id: the id last seen after the same two ids (order 2), the one last seen after the same id (order 1), and the whole
id's frequency (order 0). The shares of the three are adaptive: those of orders 2 and 1 come from hit counts under their joint
confidence, mixed with those of each order alone in proportion to the evidence. Order 0 is a prior over whole ids, gathered
from the blocks that are coded together and kept beside each block's bytes: the TOP most frequent ids one by one, all others by
their upper byte. A block learns which ids follow which after every SEGMENT ids and settles its shares after one, two, four,
eight ... segments, so encoder and decoder see the same model and numpy can learn in bulk. Quotients are of integers below
2 ** 64: blocks decode alike on any machine. Lanes are blocks: numpy codes one id of every block at a time. The encoder knows its
ids and looks up a segment of a lane after the other, so that a lane's tables stay in the cache.
"""

from __future__ import annotations

import numpy as np

SEGMENT, BITS1, BITS2, TOP = 64, 10, 11, 1024
KIND, REST = 11, 20  # bits of the shares of the three predictions, and of the frequencies of ids
TOTAL = KIND + REST
GROUP, ROWS = 512, 8  # lanes whose segment the encoder looks up together, places that the decoder learns together
#: The coder's interval has 64 bits and words have 32: as TOTAL is below 32, one word an id always suffices.
WORD, LOW = np.uint64(32), np.uint64((1 << 32) - 1)
MIX1, MIX2 = np.uint16(40503), np.uint16(30011)
#: A table's entry has the id and, above it, its confidence of 0 to 3 in steps of this: the sum of both orders' is their place.
AGREE1, AGREE2 = np.uint32(2 << 16), np.uint32(8 << 16)
TOP1, TOP2, ABOVE = np.uint32(3 * AGREE1), np.uint32(3 * AGREE2), np.uint32(0xFFFF0000)
SHIFT1, SHIFT2 = np.uint16(16 - BITS1), np.uint16(16 - BITS2)
HIGH, SHARE, WHOLE, SUM = np.uint32(16), np.uint32(0xFFFF), np.uint32(1 << KIND), np.uint32(REST)
STEP = np.uint64(TOTAL)
#: Counts are kept to quarters of a power of two, level 0 being none.
LEVELS = np.array([0] + [round(2 ** (k / 4)) for k in range(200)], np.float64).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.round(np.log2(np.maximum(counts, 1)) * 4).astype(np.int64) + 1, 0)


def prior_of(ids: np.ndarray) -> bytes:
    """The frequencies of ids as bytes: levels of the upper bytes of all but the top ids, then the top ids and their levels."""
    counts = sum(np.bincount(ids[k : k + (1 << 18)], minlength=1 << 16) for k in range(0, len(ids), 1 << 18))
    top = np.argsort(-counts, kind="stable")[:TOP]
    top = np.sort(top[counts[top] > 0])
    rest = counts.copy()
    rest[top] = 0
    return levels_of(rest.reshape(256, 256).sum(1)).astype(np.uint8).tobytes() + top.astype("<u2").tobytes() + levels_of(counts[top]).astype(np.uint8).tobytes()


class Prior:
    """Frequencies with their sums, and the id of each of 2 ** REST slots. An id whose upper byte and self have no level has no slot."""

    def __init__(self, data: bytes) -> None:
        bins, n = np.frombuffer(data[:256], np.uint8), (len(data) - 256) // 3
        top, level = np.frombuffer(data[256 : 256 + 2 * n], "<u2"), np.frombuffer(data[256 + 2 * n :], np.uint8)
        weight = np.repeat(LEVELS[bins], 256)
        weight[top] = LEVELS[level] << 8
        used = np.flatnonzero(weight)
        if not len(used):
            weight[0], used = 1, np.array([0])
        freq = np.zeros(1 << 16, np.int64)
        freq[used] = 1 + weight[used] * ((1 << REST) - len(used)) // weight.sum()
        freq[weight.argmax()] += (1 << REST) - freq.sum()
        #: The frequency in the upper half, the sum of those before in the lower one: one look and one product serve both.
        self.pairs = (freq.astype(np.uint64) << WORD) | (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(1 << 16, dtype=np.uint16), freq)


class Coder:
    """Carryless range coder over lanes; each lane writes or reads its own 32-bit words."""

    def __init__(self, lanes: int, words: int, data: np.ndarray | None = None) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.data = np.zeros((lanes, words), np.uint32) if data is None else data
        self.flat, self.at = self.data.reshape(-1), np.arange(lanes) * self.data.shape[1]
        self.begin, self.spare = self.at.copy(), np.empty(lanes, np.uint64)
        self.code = None
        if data is not None:
            self.code = (data[:, 0].astype(np.uint64) << WORD) | data[:, 1]
            self.at += 2

    def narrow(self, n: int, low: np.ndarray, freq: np.ndarray, step: np.ndarray) -> None:
        """Narrows the first n lanes to freq steps from low, and writes or reads a word where the interval got short."""
        base, span = self.low[:n], self.range[:n]
        np.add(base, np.multiply(low, step, out=self.spare[:n]), out=base)
        np.multiply(step, freq, out=span)
        go = np.flatnonzero(span <= LOW)
        if not len(go):
            return
        b, at = base[go], self.at[go]
        # an interval that crosses a word's end keeps the part before it
        span[go] = np.minimum(span[go], (LOW - (b & LOW)) + np.uint64(1)) << WORD
        if self.code is None:
            self.flat[at] = b >> WORD
        else:
            self.code[go] = (self.code[go] << WORD) | self.flat[at]
        base[go] = b << WORD
        self.at[go] = at + 1

    def flush(self) -> None:
        """One word that lies in each lane's interval; the reader takes zeros after it."""
        self.flat[self.at] = (self.low >> WORD) + ((self.low & LOW) > 0)
        self.at += 1


class Model:
    """What each lane has learnt from its own block so far."""

    def __init__(self, lanes: int, prior: Prior) -> None:
        self.lanes, self.prior = lanes, prior
        lane = np.arange(lanes)
        self.base1, self.base2, self.base_share = (lane << b for b in (BITS1, BITS2, 5))
        self.next1, self.next2 = np.zeros(lanes << BITS1, np.uint32), np.zeros(lanes << BITS2, np.uint32)
        #: How often orders 2 and 1 and neither were right, by the confidence of both, whether they agree, and lane.
        self.kinds = np.zeros((3, 4, 4, 2, lanes), np.int32)
        self.news: list[np.ndarray] = []
        self.segments = 0
        self.settle()

    def settle(self) -> None:
        """Turns the counts into shares (order 2, orders 2 and 1), two packed into one number."""
        if self.news:
            counts = np.bincount(np.concatenate(self.news), minlength=self.kinds.size).reshape(3, self.lanes, 32)
            self.kinds += counts.transpose(0, 2, 1).astype(np.int32, order="C").reshape(self.kinds.shape)
        self.news = []
        joint = self.kinds
        prior = lambda n: ((n + 1) << KIND) // (n.sum(0, dtype=np.int32) + 4)
        by2, by1 = prior(joint.sum((2, 3), dtype=np.int32)), prior(joint.sum((1, 3), dtype=np.int32))
        mixed = (by2[:, :, None] * 3 + by1[:, None]) >> 2
        shares = ((joint << KIND) + 24 * mixed[:, :, :, None]) // (joint.sum(0, dtype=np.int32) + 24)
        most = (1 << KIND) - 32
        two = np.clip(shares[0], 1, most - 64)
        one = np.clip(shares[1], 1, most - two)
        one[:, :, 1] = 0  # both orders predict the same id
        self.shares = (two | ((two + one) << 16)).reshape(32, self.lanes).T.astype(np.uint32, order="C").reshape(-1)

    def look(self, last: np.ndarray, before: np.ndarray, lanes: slice | tuple, into: tuple = (None,) * 5) -> tuple[np.ndarray, ...]:
        """(order-1 slot, its entry, order-2 slot, its entry, index of the shares) of ids after `before` and `last`."""
        mixed = last * MIX1
        s1 = np.right_shift(mixed, SHIFT1, out=into[0], dtype=None if into[0] is not None else np.int64)
        s1 += self.base1[lanes]
        mixed += before * MIX2
        s2 = np.right_shift(mixed, SHIFT2, out=into[2], dtype=None if into[2] is not None else np.int64)
        s2 += self.base2[lanes]
        e1, e2 = self.next1.take(s1, mode="clip", out=into[1]), self.next2.take(s2, mode="clip", out=into[3])
        seen = e2 >> HIGH
        seen += e1 >> HIGH
        seen += e1.astype(np.uint16) == e2.astype(np.uint16)
        return s1, e1, s2, e2, np.add(self.base_share[lanes], seen, out=into[4])

    def learn(self, parts: list[tuple[np.ndarray, tuple[np.ndarray, ...]]]) -> None:
        """Learns a segment's ids, in groups, from what look() gave for them. Lanes that end in the segment may learn anything."""
        for ids, (s1, e1, s2, e2, at) in parts:
            hit1, hit2 = e1.astype(np.uint16) == ids, e2.astype(np.uint16) == ids
            kind = (np.uint8(2) - hit1.view(np.uint8)) * (~hit2).view(np.uint8)
            place = np.multiply(kind, self.lanes << 5, dtype=np.int64)
            place += at
            self.news.append(place.reshape(-1))
            for table, slots, e, hit, more, most in ((self.next1, s1, e1, hit1, AGREE1, TOP1), (self.next2, s2, e2, hit2, AGREE2, TOP2)):
                grown = e & ABOVE
                grown += more
                np.minimum(grown, most, out=grown)
                grown *= hit
                grown |= ids
                table[slots] = grown  # the last of equal slots stays
        self.segments += 1
        if self.segments & (self.segments - 1) == 0:
            self.settle()


def _intervals(model: Model, ids: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of known ids: the frequency, of a total of 2 ** TOTAL, in the upper half, where it begins in the lower one."""
    _, e1, _, e2, at = found
    share = model.shares.take(at, mode="clip")
    both = share >> HIGH
    out = model.prior.pairs.take(ids, mode="clip")
    out *= WHOLE - both
    out += both << SUM
    hit2 = e2.astype(np.uint16) == ids
    go = np.flatnonzero(hit2 | (e1.astype(np.uint16) == ids))
    out.reshape(-1)[go] = _known(share.reshape(-1)[go], hit2.reshape(-1)[go])
    return out


def _known(share: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The intervals, as of _intervals, of ids that order 2 or else order 1 predicts."""
    share = share.astype(np.uint64)
    two, both = (share & np.uint64(0xFFFF)) << np.uint64(REST), (share >> np.uint64(16)) << np.uint64(REST)
    return np.where(second, two << WORD, ((both - two) << WORD) | two)


def _read(model: Model, coder: Coder, n: int, step: np.ndarray, found: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """Reads the ids that the code of the first n lanes stands for, and gives their intervals."""
    _, e1, _, e2, at = found
    share = model.shares.take(at, mode="clip")
    x = coder.code[:n] - coder.low[:n]
    x //= step
    x = x.astype(np.uint32)
    both = share >> HIGH
    rest = WHOLE - both
    both <<= SUM
    y = x - both
    y //= rest
    model.prior.slots.take(y, mode="clip", out=ids)
    out = model.prior.pairs.take(ids, mode="clip")
    out *= rest
    out += both
    go = np.flatnonzero(x < both)
    if len(go):
        own = share[go]
        second = x[go] < (own & SHARE) << SUM
        ids[go], out[go] = np.where(second, e2[go], e1[go]), _known(own, second)  # an entry's lower half is its id
    return out


def _active(lengths: np.ndarray, t: int, end: int) -> list[int]:
    """How many lanes have an id at each place of a segment."""
    return np.searchsorted(-lengths, -np.arange(t, end), "left").tolist()


def _write_all(lengths: np.ndarray, coder: Coder, ids: np.ndarray, prior: Prior) -> None:
    """Codes the rows of ids, a row a lane. Lengths fall from lane to lane; ids has two columns of zeros before all."""
    model, most = Model(len(lengths), prior), int(lengths[0])
    for t in range(0, most, SEGMENT):
        end = min(t + SEGMENT, most)
        active = _active(lengths, t, end)
        m = active[0]
        parts = []
        for at in range(0, m, GROUP):
            lanes = slice(at, min(at + GROUP, m))
            own = np.ascontiguousarray(ids[lanes, t + 2 : end + 2])
            found = model.look(np.ascontiguousarray(ids[lanes, t + 1 : end + 1]), np.ascontiguousarray(ids[lanes, t:end]), (lanes, None))
            parts.append((own, found, _intervals(model, own, found).T))
        out = np.concatenate([x for _, _, x in parts], axis=1)
        low, freq = out & LOW, out >> WORD
        for k, n in enumerate(active):
            coder.narrow(n, low[k, :n], freq[k, :n], coder.range[:n] >> STEP)
        if end < most:
            model.learn([(own, found) for own, found, _ in parts])


def _read_all(lengths: np.ndarray, coder: Coder, ids: np.ndarray, prior: Prior) -> None:
    """Decodes into the columns of ids, a column a lane. Lengths fall from lane to lane; ids has two rows of zeros before all."""
    model, most = Model(len(lengths), prior), int(lengths[0])
    # what each step of a segment looked up, to learn from
    looked = [np.empty((SEGMENT, len(lengths)), kind) for kind in (np.int64, np.uint32, np.int64, np.uint32, np.int64)]
    for t in range(0, most, SEGMENT):
        end = min(t + SEGMENT, most)
        active = _active(lengths, t, end)
        m = active[0]
        for k, n in enumerate(active):
            step = coder.range[:n] >> STEP
            seen = model.look(ids[t + k + 1, :n], ids[t + k, :n], slice(0, n), tuple(held[k, :n] for held in looked))
            out = _read(model, coder, n, step, seen, ids[t + k + 2, :n])
            coder.narrow(n, out & LOW, out >> WORD, step)
        if end < most:
            parts = []
            for k in range(0, end - t, ROWS):
                rows = slice(k, min(k + ROWS, end - t))
                found = tuple(held[rows, :m] for held in looked)
                if active[-1] < m:  # rows of lanes that ended are not filled
                    found = model.look(ids[t + 1 : end + 1, :m][rows], ids[t:end, :m][rows], slice(0, m))
                parts.append((ids[t + 2 : end + 2, :m][rows], found))
            model.learn(parts)


def encode_blocks(blocks: list[np.ndarray]) -> tuple[list[bytes], bytes]:
    """The bytes of each block of ids below 65,536, and the prior that they share."""
    if not blocks or not max(map(len, blocks)):
        return [b""] * len(blocks), b""
    if max(int(b.max(initial=0)) for b in blocks) >> 16:
        raise ValueError("ids must be below 65,536")
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    lengths = np.array([len(blocks[i]) for i in order], np.int64)
    ids = np.zeros((len(blocks), int(lengths[0]) + 2), np.uint16)
    for k, i in enumerate(order):
        ids[k, 2 : lengths[k] + 2] = blocks[i]
    prior = prior_of(np.concatenate(blocks))
    coder = Coder(len(blocks), int(lengths[0]) + 2)
    _write_all(lengths, coder, ids, Prior(prior))
    coder.flush()
    out = [b""] * len(blocks)
    for k, i in enumerate(order):
        out[i] = coder.data[k, : coder.at[k] - coder.begin[k]].astype("<u4").tobytes()
    return out, prior


def decode_blocks(payloads: list[bytes], lengths: list[int], prior: bytes) -> list[np.ndarray]:
    """The ids of blocks that have one prior; any of them, in any order, decode alike."""
    if not payloads or not max(lengths):
        return [np.empty(0, np.uint16)] * len(payloads)
    order = np.argsort([-n for n in lengths], kind="stable")
    data = np.zeros((len(payloads), max(map(len, payloads)) // 4 + 4), np.uint32)
    for k, i in enumerate(order):
        data[k, : len(payloads[i]) // 4] = np.frombuffer(payloads[i], "<u4")
    sizes = np.array([lengths[i] for i in order], np.int64)
    ids = np.zeros((int(sizes[0]) + 2, len(payloads)), np.uint16)
    _read_all(sizes, Coder(len(payloads), 0, data), ids, Prior(prior))
    ids = np.ascontiguousarray(ids.T)
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(payloads)
    for k, i in enumerate(order):
        out[i] = ids[k, 2 : sizes[k] + 2].copy()
    return out
