"""Static range asymmetric numeral system for token ids, vectorised over interleaved lanes.

A segment has one frequency table, shared by its blocks. A block is BLOCK ids, dealt in turn to LANES lanes; each lane
is a 64-bit state in [2^31, 2^63) that emits 32-bit words. Blocks are independent: a block's checkpoint is its place in
the words, its lane states and the crc32 of its ids, so that any block can be decoded alone, and several at once. All
blocks of a segment are coded together in numpy, a step a round over all lanes.

Segment, little endian: magic 'RLT1', then as 32-bit numbers: documents, ids (64 bits), distinct symbols, blocks, lengths
in bytes of the zlib-packed parts; then those parts (document ids as 64-bit numbers, null flags, ids per document,
symbols, frequencies), words per block, crc32 per block, states, words, and the crc32 of all that.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS, PRECISION = 64, 256, 20
BLOCK = LANES * STEPS
_LOW, _WORD, _P = np.uint64(1 << 31), np.uint64(32), np.uint64(PRECISION)
_MASK = np.uint64((1 << PRECISION) - 1)
MAGIC = b"RLT1"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive frequencies that add up to 2**PRECISION, near in proportion to positive counts."""
    total = 1 << PRECISION
    if len(counts) > total:
        raise ValueError("more distinct symbols than the precision holds")
    out = np.maximum(1, (counts * (total / counts.sum())).astype(np.int64))
    order = np.argsort(-out, kind="stable")
    rest = total - int(out.sum())
    if rest > 0:
        out[order[0]] += rest
    while rest < 0:  # take from the largest, a fraction of each
        room = out[order] - 1
        take = np.minimum(room, np.maximum(1, room // 8))
        upto = np.minimum(np.cumsum(take), -rest)
        out[order] -= np.diff(np.concatenate(([0], upto)))
        rest = total - int(out.sum())
    return out


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, frequencies, words per block, crc32 per block, states, words) of a segment's ids."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    freq = frequencies(counts[symbols])
    cum = np.concatenate(([0], np.cumsum(freq)))[:-1]
    blocks = -(-len(ids) // BLOCK)
    crc = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)], np.uint32)
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    filled = np.full(blocks * BLOCK, int(np.argmax(freq)), np.int64)
    filled[: len(ids)] = place[ids]
    # (steps, blocks * lanes): id i of a block is at step i // LANES of lane i % LANES
    order = filled.reshape(blocks, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, blocks * LANES)
    f64, c64 = freq.astype(np.uint64), cum.astype(np.uint64)
    x = np.full(blocks * LANES, _LOW, np.uint64)
    out, sent = np.zeros((STEPS, blocks * LANES), np.uint32), np.zeros((STEPS, blocks * LANES), bool)
    for t in range(STEPS - 1, -1, -1):
        f = f64[order[t]]
        full = x >= f << np.uint64(63 - PRECISION)
        out[t] = x  # the low 32 bits
        sent[t] = full
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << _P) + (x - q * f) + c64[order[t]]
    words = [out.reshape(STEPS, blocks, LANES)[:, b][sent.reshape(STEPS, blocks, LANES)[:, b]] for b in range(blocks)]
    return symbols, freq, np.array([len(w) for w in words], np.uint32), crc, x, np.concatenate(words) if words else np.zeros(0, np.uint32)


def decode_ids(n: int, symbols: np.ndarray, freq: np.ndarray, sizes: np.ndarray, crc: np.ndarray, states: np.ndarray, words: np.ndarray, blocks: range | None = None) -> np.ndarray:
    """The ids of the chosen blocks (all by default), checked against their checksums."""
    chosen = range(len(sizes)) if blocks is None else blocks
    if not len(chosen):
        return np.zeros(0, np.uint32)
    table = np.repeat(np.arange(len(symbols)), freq)
    cum = np.concatenate(([0], np.cumsum(freq)))[:-1].astype(np.uint64)
    f64 = freq.astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))[list(chosen)]
    x = states.reshape(-1, LANES)[list(chosen)].reshape(-1).copy()
    got = np.empty((STEPS, len(x)), np.int64)
    words = np.append(words, np.uint32(0))
    for t in range(STEPS):
        slot = x & _MASK
        s = table[slot.astype(np.int64)]
        got[t] = s
        x = f64[s] * (x >> _P) + slot - cum[s]
        need = (x < _LOW).reshape(-1, LANES)
        rank = np.cumsum(need, axis=1)
        flat = need.reshape(-1)
        place = (at[:, None] + rank - 1).reshape(-1)[flat]
        x[flat] = (x[flat] << _WORD) | words[place].astype(np.uint64)
        at = at + rank[:, -1]
    out = symbols[got.reshape(STEPS, -1, LANES).transpose(1, 0, 2)].astype(np.uint32).reshape(len(chosen), BLOCK)
    parts = [row[: max(0, min(BLOCK, n - b * BLOCK))] for b, row in zip(chosen, out, strict=True)]
    for b, part in zip(chosen, parts, strict=True):
        if zlib.crc32(part.astype("<u4").tobytes()) != int(crc[b]):
            raise ValueError(f"block {b}: checksum differs")
    return np.concatenate(parts)


_HEAD = struct.Struct("<4sIQII5I")


def pack(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment's bytes."""
    symbols, freq, sizes, crc, states, words = encode_ids(ids) if len(ids) else (np.zeros(0, np.int64),) * 6
    parts = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in (doc_ids.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<u4"), np.diff(symbols, prepend=0).astype("<u4"), freq.astype("<u4"))]
    body = b"".join((_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(symbols), len(sizes), *map(len, parts)), *parts, sizes.astype("<u4").tobytes(), crc.astype("<u4").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, null flags, ids per document, ids) of a segment, all checksums checked."""
    body = memoryview(data)[:-4]
    magic, docs, n, _, blocks, *sizes_of = _HEAD.unpack_from(body)
    if magic != MAGIC or zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a token segment, or it is damaged")
    at, parts = _HEAD.size, []
    for size, kind in zip(sizes_of, ("<i8", np.uint8, "<u4", "<u4", "<u4"), strict=True):
        parts.append(np.frombuffer(zlib.decompress(body[at : at + size]), kind))
        at += size
    doc_ids, nulls, lengths, symbols, freq = parts
    sizes, crc = np.frombuffer(body, "<u4", blocks, at), np.frombuffer(body, "<u4", blocks, at + 4 * blocks)
    states = np.frombuffer(body, "<u8", blocks * LANES, at + 8 * blocks)
    words = np.frombuffer(body[at + 8 * blocks + 8 * blocks * LANES :], "<u4")
    ids = decode_ids(n, np.cumsum(symbols.astype(np.int64)), freq.astype(np.int64), sizes, crc, states, words)
    return doc_ids, nulls.astype(bool), lengths, ids
