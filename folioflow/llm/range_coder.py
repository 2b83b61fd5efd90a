"""Blocks of token ids under an adaptive context-mixing range coder.

A block is coded on its own: its tables start afresh, and it ends up as one byte string with a checksum
of the ids. Its ids are dealt out to up to ``LANES`` lanes of consecutive ids, and all lanes take a step
together, so that each operation handles a whole column of ids. All lanes of a block learn from one
set of tables:

* order 2: the id expected after the last two ids, found by their hash, and how far to trust it;
* order 1: the id expected after the last id, likewise;
* order 0: how often each id of the block's alphabet has come so far, over all.

How much of the coder's interval the order-2 and the order-1 expectation get is learned too, for each
pair of trusts apart; the order-0 counts share the rest. A step codes its column first and learns from it
then, so the decoder, which knows all columns before, has the same tables. All arithmetic is in integers.

The coder keeps 64 bits of ``low`` and of ``range`` for each lane. When a range falls under 2 ** 32 the lane
writes the upper half of ``low``; a range that straddles the boundary then is cut there, so no carry occurs.
"""

from __future__ import annotations

import struct
import zlib
import numpy as np

MAGIC = b"TIDR"
#: magic, number of ids, lanes, length of the packed alphabet, checksum of the ids
HEADER = struct.Struct("<4sQIII")
LANES = 8192
#: Steps of a block that has fewer ids than all lanes could take.
STEPS = 256
PAIR_BITS = 18
TRUST = 3
MIX_BITS, COUNT_BITS = 12, 18
TOTAL_BITS = np.uint64(MIX_BITS + COUNT_BITS)
#: Order-0 counts are brought up to date after so many steps.
RENEW = 8
HALF = np.uint64(32)
LEAST_RANGE = np.uint64(1 << 32)
LOWER = np.uint64((1 << 32) - 1)


class Model:
    """What a block's lanes expect next. ``first`` is an index into the block's alphabet."""

    def __init__(self, lanes: int, alphabet: int):
        self.alphabet, self.age = alphabet, 0
        self.after_one = np.zeros(alphabet, np.int64)  # expected id * 4 + trust
        self.after_two = np.zeros(1 << PAIR_BITS, np.int64)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.outcomes = np.tile(np.array([1, 1, 2], np.int64), (2 * (TRUST + 1) ** 2, 1))
        self.outcomes[:, 0] += np.arange(len(self.outcomes)) // 4 % (TRUST + 1) * 2
        self.count = np.zeros(alphabet, np.int64)
        self.seen: list[np.ndarray] = []
        self.renewed = 0
        self.renew()

    def renew(self) -> None:
        """Bring counts and shares up to date; every id of the alphabet keeps one slot at least."""
        slots = 1 << COUNT_BITS
        self.renewed += 1
        if self.seen:
            self.count += np.bincount(np.concatenate(self.seen), minlength=self.alphabet)
            self.seen = []
        all_of = int(self.count.sum())
        share = 1 + (self.count * (slots - self.alphabet) // all_of if all_of else np.zeros(self.alphabet, np.int64))
        share[int(np.argmax(share))] += slots - int(share.sum())
        self.share, self.start = share, np.cumsum(share) - share
        whole = self.outcomes.sum(axis=1)
        part = (1 << MIX_BITS) - 3
        self.two_share = 1 + self.outcomes[:, 0] * part // whole
        self.both_share = self.two_share + 1 + self.outcomes[:, 1] * part // whole

    def expect(self) -> None:
        """Set the expected ids of all lanes and the bounds of their parts of the interval."""
        self.at = (self.before * 40503 + self.last * 12289) & ((1 << PAIR_BITS) - 1)
        self.entry_two, self.entry_one = self.after_two.take(self.at), self.after_one.take(self.last)
        self.two, self.one = self.entry_two >> 2, self.entry_one >> 2
        self.state = ((self.entry_two & 3) << 2) + (self.entry_one & 3) + ((self.two == self.one) << 4)
        self.upto_two, self.upto_one = self.two_share.take(self.state), self.both_share.take(self.state)

    def learn(self, ids: np.ndarray, hit_two: np.ndarray, hit_one: np.ndarray) -> None:
        """Take in the step's ids; ``hit_two`` and ``hit_one`` say which expectation coded an id, if any."""
        missed = ~(hit_two | hit_one)
        self.seen.append(ids[missed])
        outcome = self.state * 3 + hit_one + 2 * missed
        self.outcomes += np.bincount(outcome, minlength=self.outcomes.size).reshape(self.outcomes.shape)
        fresh = ids << 2
        self.after_two[self.at] = self.trusted(self.entry_two, hit_two, fresh)
        self.after_one[self.last] = self.trusted(self.entry_one, ids == self.one, fresh)
        self.before, self.last = self.last, ids
        self.age += 1
        if self.age % RENEW == 0 or self.age < RENEW:
            self.renew()

    @staticmethod
    def trusted(entry: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """An expectation that holds is trusted more, one that fails less, and then it is replaced."""
        trust = entry & 3
        return np.where(hit, entry + (trust < TRUST), np.where(trust > 0, entry - 1, fresh))


def _turned(table: np.ndarray) -> np.ndarray:
    """The transposed table, copied in strips that the processor's caches hold."""
    out = np.empty(table.shape[::-1], table.dtype)
    for a in range(0, table.shape[0], 256):
        for b in range(0, table.shape[1], 256):
            out[b : b + 256, a : a + 256] = table[a : a + 256, b : b + 256].T
    return out


def _shape(n: int, lanes: int) -> tuple[int, int]:
    """Lanes and steps for ``n`` ids."""
    lanes = max(1, min(lanes, -(-n // STEPS)))
    steps = -(-n // lanes)
    return -(-n // steps) if steps else 0, steps


def encode_block(ids: np.ndarray, lanes: int = LANES) -> bytes:
    """The coded block of ``ids``, unsigned integers under 2 ** 24 with at most 2 ** 17 different ones; 2 ** 16 lanes at most."""
    if not 1 <= lanes <= 1 << 16:
        raise ValueError("a block has 1 to 2 ** 16 lanes")
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes, steps = _shape(n, lanes)
    if n and int(ids.max()) >= 1 << 24:
        raise ValueError("ids must be under 2 ** 24")
    present = np.bincount(ids) > 0
    alphabet = int(present.sum())
    if alphabet > 1 << 17:
        raise ValueError("a block has at most 2 ** 17 different ids")
    packed = zlib.compress(np.packbits(present).tobytes(), 6)
    head = HEADER.pack(MAGIC, n, lanes, len(packed), zlib.crc32(ids))
    if n == 0:
        return head + packed
    columns = np.zeros(lanes * steps, np.int64)
    columns[:n] = (np.cumsum(present) - 1)[ids]
    columns = _turned(columns.reshape(lanes, steps))
    model = Model(lanes, alphabet)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for column in columns:
        model.expect()
        hit_two = column == model.two
        hit_one = (column == model.one) & ~hit_two
        rest = (1 << MIX_BITS) - model.upto_one
        start = (model.upto_one << COUNT_BITS) + rest * model.start.take(column)
        size = rest * model.share.take(column)
        two = np.flatnonzero(hit_two)
        start[two], size[two] = 0, model.upto_two[two] << COUNT_BITS
        one = np.flatnonzero(hit_one)
        start[one], size[one] = model.upto_two[one] << COUNT_BITS, (model.upto_one[one] - model.upto_two[one]) << COUNT_BITS
        unit = width >> TOTAL_BITS
        low += unit * start.view(np.uint64)
        width = unit * size.view(np.uint64)
        model.learn(column, hit_two, hit_one)
        short = np.flatnonzero(width < LEAST_RANGE)
        if len(short):
            at, _ = _settle(low, width, short)
            words.append((at >> HALF).astype(np.uint32))
            owners.append(short.astype(np.uint16))
    for _ in range(2):  # what is left of ``low``
        words.append((low >> HALF).astype(np.uint32))
        owners.append(np.arange(lanes, dtype=np.uint16))
        low = low << HALF
    owner = np.concatenate(owners)
    body = np.concatenate(words)[np.argsort(owner, kind="stable")]
    lengths = np.bincount(owner, minlength=lanes)
    return b"".join((head, packed, lengths.astype("<u4").tobytes(), body.astype("<u4").tobytes()))


def _settle(low: np.ndarray, width: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop the upper half of the short lanes' ``low``; a range over a boundary is cut there."""
    at, size = low[short], width[short]
    room = LEAST_RANGE - (at & LOWER)
    size = np.minimum(size, room)
    low[short], width[short] = at << HALF, size << HALF
    return at, size


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a coded block; raises ``ValueError`` where the block is damaged."""
    magic, n, lanes, packed, check = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    if n == 0:
        return np.zeros(0, np.uint32)
    at = HEADER.size
    letters = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(block[at : at + packed]), np.uint8)))
    at += packed
    lengths = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    body = np.frombuffer(block, "<u4", offset=at + 4 * lanes).astype(np.uint64)
    if int(lengths.sum()) != len(body):
        raise ValueError("a block's lanes don't add up")
    steps = -(-n // lanes)
    model = Model(lanes, len(letters))
    place = np.cumsum(lengths) - lengths
    code = (body[place] << HALF) | body[place + 1]
    place += 2
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    columns = np.zeros((steps, lanes), np.int64)
    slots, age = None, -1
    for k in range(steps):
        model.expect()
        unit = width >> TOTAL_BITS
        slot = ((code - low) // unit).view(np.int64)
        mixed = slot >> COUNT_BITS
        hit_two = mixed < model.upto_two
        hit_one = (mixed < model.upto_one) & ~hit_two
        column = np.where(hit_two, model.two, model.one)
        start = np.where(hit_two, 0, model.upto_two << COUNT_BITS)
        size = np.where(hit_two, model.upto_two, model.upto_one - model.upto_two) << COUNT_BITS
        miss = np.flatnonzero(mixed >= model.upto_one)
        if len(miss):
            if age != model.renewed:
                slots, age = np.repeat(np.arange(len(letters)), model.share), model.renewed
            upto = model.upto_one[miss]
            rest = (1 << MIX_BITS) - upto
            inside = np.minimum((slot[miss] - (upto << COUNT_BITS)) // rest, (1 << COUNT_BITS) - 1)
            found = slots.take(inside)
            column[miss] = found
            start[miss] = (upto << COUNT_BITS) + rest * model.start.take(found)
            size[miss] = rest * model.share.take(found)
        low += unit * start.view(np.uint64)
        width = unit * size.view(np.uint64)
        columns[k] = column
        model.learn(columns[k], hit_two, hit_one)
        short = np.flatnonzero(width < LEAST_RANGE)
        if len(short):
            _settle(low, width, short)
            from_here = place[short]
            code[short] = (code[short] << HALF) | body[from_here]
            place[short] = from_here + 1
    ids = letters[_turned(columns).reshape(-1)[:n]].astype("<u4")
    if zlib.crc32(ids) != check:
        raise ValueError("a block's ids don't match its checksum")
    return ids
