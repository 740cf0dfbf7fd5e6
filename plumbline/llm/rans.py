"""Static range asymmetric numeral coding of token ids, in interleaved lanes.

A block is coded by itself: lane l codes tokens l, l + lanes, l + 2 * lanes, ... and all lanes write 32-bit words to one
stream, so numpy codes a step of all lanes at once. The state of a lane is in [2^31, 2^63). Every ``every`` steps the
block holds a checkpoint (the lane states and the place in the stream) from which decoding can begin, so the stretches
between checkpoints can be decoded in parallel; each has a CRC-32 of its ids, and the block one of its bytes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"PLR1"
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIQQ")  # magic, lanes, steps between checkpoints, checkpoints, documents, tokens, words


@dataclass(frozen=True)
class Frequencies:
    """Frequencies of ids that sum to 2^bits; 0: the id never occurs and can't be coded."""

    bits: int
    freq: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, least_bits: int = 16) -> Frequencies:
        """Shares by largest remainder, with at least 1 for each id that occurs."""
        counts = np.asarray(counts, np.int64)
        used = np.nonzero(counts)[0]
        bits = max(least_bits, int(len(used)).bit_length() + 4)
        freq = np.zeros(len(counts), np.int64)
        if len(used):
            room, n = (1 << bits) - len(used), counts[used].astype(np.float64)
            share = n / n.sum() * room
            whole = np.floor(share).astype(np.int64)
            left = room - int(whole.sum())
            whole[np.argsort(-(share - whole), kind="stable")[:left]] += 1
            freq[used] = whole + 1
        return cls(bits, freq)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequency and start by id, and the id of each of the 2^bits slots."""
        start = np.cumsum(self.freq) - self.freq
        return self.freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)


class Coder:
    def __init__(self, frequencies: Frequencies) -> None:
        self.bits = frequencies.bits
        self.freq, self.start, self.slot = frequencies.tables()

    def encode(self, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, lanes: int = 1024, every: int = 128) -> bytes:
        """A block of whole documents: ids are their tokens in order, lengths the number of each."""
        n = len(ids)
        lanes = min(lanes, 1 << max(0, (n // 64).bit_length() - 1)) if n else 1
        steps = -(-n // lanes)
        f, c = self.freq[ids], self.start[ids]
        if n and not f.all():
            raise ValueError("an id that the frequency table doesn't have")
        x, shift, bits = np.full(lanes, LOW), np.uint64(63 - self.bits), np.uint64(self.bits)
        words: list[np.ndarray] = []
        states: list[np.ndarray] = []
        for s in range(steps - 1, -1, -1):
            lo, hi = s * lanes, min(n, (s + 1) * lanes)
            fs, y = f[lo:hi], x[: hi - lo]
            full = y >= (fs << shift)
            words.append(y[full].astype(np.uint32))
            y = np.where(full, y >> np.uint64(32), y)
            q = y // fs
            x[: hi - lo] = (q << bits) + (y - q * fs) + c[lo:hi]
            if s % every == 0:
                states.append(x.copy())
        words.reverse()
        states.reverse()
        at = np.cumsum([0, *map(len, words)])[:-1][::every] if steps else np.zeros(0, np.int64)
        ids32 = ids.astype("<u4")
        sums = [zlib.crc32(ids32[s * lanes : (s + every) * lanes].tobytes()) for s in range(0, steps, every)]
        stream = np.concatenate(words) if words else np.zeros(0, np.uint32)
        body = b"".join(
            [
                _HEAD.pack(MAGIC, lanes, every, len(states), len(doc_ids), n, len(stream)),
                doc_ids.astype("<i8").tobytes(),
                lengths.astype("<u8").tobytes(),
                at.astype("<u8").tobytes(),
                np.array(sums, "<u4").tobytes(),
                b"".join(s.astype("<u8").tobytes() for s in states),
                stream.astype("<u4").tobytes(),
            ]
        )
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, lengths and the tokens of stretches first to last - 1 (all of them unless told otherwise)."""
        if len(block) < _HEAD.size + 4 or block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("not a whole block")
        _, lanes, every, points, docs, n, n_words = _HEAD.unpack_from(block)
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, count, at)
            at += out.nbytes
            return out

        doc_ids, lengths, offsets, sums = take("<i8", docs), take("<u8", docs), take("<u8", points), take("<u4", points)
        states, stream = take("<u8", points * lanes).reshape(points, lanes), take("<u4", n_words)
        steps, last = -(-n // lanes), points if last is None else last
        out = np.zeros(max(0, min(n, last * every * lanes) - first * every * lanes), np.uint32)
        mask, bits, base = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), first * every * lanes
        for p in range(first, last):
            x, pos = states[p].astype(np.uint64), int(offsets[p])
            for s in range(p * every, min(steps, (p + 1) * every)):
                lo, hi = s * lanes, min(n, (s + 1) * lanes)
                y = x[: hi - lo]
                slot = y & mask
                ids = self.slot[slot]
                y = self.freq[ids] * (y >> bits) + slot - self.start[ids]
                low = np.nonzero(y < LOW)[0]
                y[low] = (y[low] << np.uint64(32)) | stream[pos : pos + len(low)]
                pos += len(low)
                x[: hi - lo] = y
                out[lo - base : hi - base] = ids
            if zlib.crc32(out[p * every * lanes - base : min(n, (p + 1) * every * lanes) - base].astype("<u4").tobytes()) != sums[p]:
                raise ValueError("a stretch of the block is damaged")
        return doc_ids, lengths, out
