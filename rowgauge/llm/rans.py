"""Range asymmetric numeral system over a static table: blocks of interleaved lanes, in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Token i of a block belongs to lane i modulo the number of lanes; a step is one token per lane.
LANES = 2048
SMALL_LANES = 16
#: Steps between two places at which decoding can start.
CHECKPOINT_STEPS = 128

_MAGIC = b"RGR1"
_HEADER = struct.Struct("<4sIIIQQI")  # magic, table check, bits, lanes, tokens, words, checkpoints
_LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63) and give off 32 bits at a time
_HALF = np.uint64(32)


class FrequencyTable:
    """Frequencies of ids scaled to a power of two; every id that occurs keeps at least one."""

    def __init__(self, scaled: np.ndarray, bits: int) -> None:
        self.scaled, self.bits = scaled.astype(np.uint64), bits
        self.below = np.concatenate([[0], np.cumsum(self.scaled)]).astype(np.uint64)[:-1]
        self.check = zlib.crc32(self.scaled.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """Scale counts; what rounding leaves over goes to the most frequent ids."""
        counts = counts.astype(np.float64)
        used = np.flatnonzero(counts)
        if not len(used):
            return cls(np.zeros(len(counts)), 16)
        bits = max(16, min(24, int(len(used)).bit_length() + 4))
        size = 1 << bits
        scaled = np.zeros(len(counts), dtype=np.int64)
        scaled[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * size)).astype(np.int64)
        order = used[np.argsort(-counts[used], kind="stable")]
        over = int(scaled.sum()) - size
        for i in order:
            if over <= 0:
                break
            less = min(over, int(scaled[i]) - 1)
            scaled[i] -= less
            over -= less
        scaled[order[0]] -= min(over, 0)
        return cls(scaled, bits)

    @property
    def slots(self) -> np.ndarray:
        """The id that owns each of the 2^bits slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.scaled), dtype=np.uint32), self.scaled.astype(np.int64))
        return self._slots


def encode(tokens: np.ndarray, table: FrequencyTable) -> bytes:
    """One independent block: header, final states, checkpoints, words, and a CRC-32 of it all."""
    n = len(tokens)
    lanes = LANES if n >= 16 * LANES else SMALL_LANES
    frequency, below = table.scaled[tokens], table.below[tokens]
    bits, shift = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    parts: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    given = 0
    for step in range(-(-n // lanes) - 1, -1, -1):
        own = slice(step * lanes, min(n, (step + 1) * lanes))
        f, x = frequency[own], state[: own.stop - own.start]
        full = x >= (f << shift)
        out = x[full].astype(np.uint32)
        if len(out):
            parts.append(out)
            given += len(out)
            x = np.where(full, x >> _HALF, x)
        whole = x // f
        state[: len(x)] = (whole << bits) + (x - whole * f) + below[own]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, given, state.tobytes()))
    words = np.concatenate(parts[::-1]) if parts else np.zeros(0, np.uint32)
    body = [
        _HEADER.pack(_MAGIC, table.check, table.bits, lanes, n, len(words), len(marks)),
        state.tobytes(),
    ]
    body += [struct.pack("<QQ", step, len(words) - at) + kept for step, at, kept in reversed(marks)]
    body.append(words.astype("<u4").tobytes())
    block = b"".join(body)
    return block + struct.pack("<I", zlib.crc32(block))


def decode(block: bytes, table: FrequencyTable, first: int = 0, last: int | None = None) -> np.ndarray:
    """Tokens first..last of a block, from the last checkpoint at or before `first`.

    Raises ValueError if the block is damaged or was written with another table.
    """
    if len(block) < _HEADER.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, check, bits, lanes, n, n_words, n_marks = _HEADER.unpack_from(block)
    if magic != _MAGIC or check != table.check or bits != table.bits:
        raise ValueError("block of another format or frequency table")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    place = _HEADER.size
    step, at, start = 0, 0, place
    place += 8 * lanes
    for _ in range(n_marks):
        mark_step, mark_at = struct.unpack_from("<QQ", block, place)
        if mark_step * lanes <= first:
            step, at, start = mark_step, mark_at, place + 16
        place += 16 + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, place).astype(np.uint64)
    state = np.frombuffer(block, "<u8", lanes, start).copy()
    width, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    slots, frequency, below = table.slots, table.scaled, table.below
    begin, found = step * lanes, []
    while step * lanes < last:
        x = state[: min(lanes, n - step * lanes)]
        slot = x & mask
        token = slots[slot]
        found.append(token)
        x = frequency[token] * (x >> width) + slot - below[token]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _HALF) | words[at : at + len(low)]
            at += len(low)
        state[: len(x)] = x
        step += 1
    return np.concatenate(found)[first - begin : last - begin]
