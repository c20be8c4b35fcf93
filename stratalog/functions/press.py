"""The compressed stream format of packed assets: literals and matches, optionally entropy coded, in checked blocks.

A stream is a header (magic, version, original size), blocks of at most 256 KiB of the original, and an empty
block. A block has its size, the xxHash32 of its original bytes, a kind and a body. The body of kind RAW is
a sequence of literals and matches: bytes below 0xFE stand for themselves, 0xFF stands before a literal 0xFE or 0xFF,
0xFE before a match (distance of two bytes, length less 4). Of kind CODED it is that sequence under a range
coder of four interleaved states: 256 frequencies that sum to 4096, the number of symbols, the states, the bytes.
Version 1 has no kind; there a block is coded if its frequencies sum to 4096.

This is byte work that Spark has no expression for; it runs in Arrow batches.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from itertools import accumulate

import xxhash

#: Fixed values of the format.
MAGIC, VERSION, LEGACY = b"PRSS", 2, 1
RAW, CODED = 0, 1
BLOCK, WINDOW, LEAST, MOST = 256 << 10, 0xFFFF, 4, 258
MATCH, ESCAPE = 0xFE, 0xFF
SCALE, LOW, STATES = 4096, 1 << 23, 4
HEADER, BLOCK_HEAD = struct.Struct("<4sBBHQ"), struct.Struct("<II")

#: Candidates looked at for a match, by level from 1 to 9.
TRIES = (1, 2, 4, 8, 16, 24, 32, 64, 128)
_ITEMS = re.compile(rb"[^\xfe\xff]+|\xff([\xfe\xff])|\xfe(...)", re.DOTALL)


def normalise(counts: dict[int, int]) -> dict[int, int]:
    """Frequencies of byte values scaled to sum to SCALE, each at least 1; the largest (lowest value on ties) takes up the difference."""
    total = sum(counts.values())
    if not total:
        return dict.fromkeys(range(256), SCALE // 256)
    scaled = {s: max(1, n * SCALE // total) for s, n in counts.items() if n}
    while (rest := SCALE - sum(scaled.values())) != 0:
        ranked = sorted(scaled, key=lambda s: (-scaled[s], s))
        best = ranked[0]
        if rest > 0:
            scaled[best] += rest  # it stays the largest
        elif scaled[best] == 1:
            break
        else:
            level = scaled[ranked[1]] if len(ranked) > 1 else 1
            scaled[best] -= min(-rest, max(1, scaled[best] - level))
    return scaled


def longest_match(raw: bytes, at: int, places: list[int]) -> tuple[int, int]:
    """Distance and length of the longest of the matches at the places, the first looked at on ties; (0, 0) without one."""
    here = int.from_bytes(raw[at : at + MOST], "little")
    most, best, distance = min(MOST, len(raw) - at), 0, 0
    for place in places:
        differs = here ^ int.from_bytes(raw[place : place + most], "little")
        size = most if not differs else ((differs & -differs).bit_length() - 1) >> 3
        if size > best:
            best, distance = size, at - place
            if size == most:
                break
    return (distance, best) if best >= LEAST else (0, 0)


def matched(raw: bytes, level: int = 5) -> bytes:
    """Literals and matches of a block."""
    tries, seen, out, at = TRIES[min(9, max(1, level)) - 1], {}, bytearray(), 0
    while at < len(raw):
        key = raw[at : at + LEAST]
        places = seen.get(key, [])
        distance, size = longest_match(raw, at, [p for p in places[: -tries - 1 : -1] if at - p <= WINDOW]) if places and len(key) == LEAST else (0, 0)
        if size:
            out += bytes((MATCH,)) + distance.to_bytes(2, "little") + bytes((size - LEAST,))
        else:
            size = 1
            out += bytes((ESCAPE, raw[at])) if raw[at] >= MATCH else raw[at : at + 1]
        for p in range(at, min(at + size, len(raw) - LEAST + 1)):
            seen.setdefault(raw[p : p + LEAST], []).append(p)
        at += size
    return bytes(out)


def unmatched(items: bytes) -> bytes:
    out, end = bytearray(), 0
    for m in _ITEMS.finditer(items):
        if m.start() != end:
            break
        end = m.end()
        if m[2] is not None:
            distance, size = int.from_bytes(m[2][:2], "little"), m[2][2] + LEAST
            if not 0 < distance <= len(out):
                raise ValueError("a match begins before the block")
            source = out[-distance:][:size]
            out += (source * (size // len(source) + 1))[:size]
        else:
            out += m[1] or m[0]
    if end != len(items):
        raise ValueError("the block's items are cut short")
    return bytes(out)


def coded(symbols: bytes, frequency: dict[int, int]) -> bytes:
    """Symbols under the range coder, the last first; symbol i belongs to state i mod STATES."""
    starts = dict(zip(sorted(frequency), accumulate([0, *[frequency[s] for s in sorted(frequency)]])))
    state, out = [LOW] * STATES, bytearray()
    for i in range(len(symbols) - 1, -1, -1):
        s = symbols[i]
        f, x = frequency[s], state[i % STATES]
        while x >= f << 19:  # (LOW / SCALE) << 8 times f
            out.append(x & 255)
            x >>= 8
        state[i % STATES] = (x // f) * SCALE + x % f + starts[s]
    return b"".join(x.to_bytes(4, "big") for x in state) + bytes(reversed(out))


def decoded(data: bytes, frequency: dict[int, int], number: int) -> bytes:
    if len(data) < 4 * STATES or sum(frequency.values()) != SCALE:
        raise ValueError("no range coded body")
    slots, starts, at = bytearray(), {}, 4 * STATES
    for s in sorted(frequency):
        starts[s] = len(slots)
        slots += bytes((s,)) * frequency[s]
    state, out = [int.from_bytes(data[4 * i : 4 * i + 4], "big") for i in range(STATES)], bytearray(number)
    for i in range(number):
        x = state[i % STATES]
        slot = x % SCALE
        s = out[i] = slots[slot]
        x = frequency[s] * (x // SCALE) + slot - starts[s]
        while x < LOW and at < len(data):
            x = x << 8 | data[at]
            at += 1
        state[i % STATES] = x
    return bytes(out)


def press(raw: bytes, level: int = 5) -> bytes:
    out = [HEADER.pack(MAGIC, VERSION, 0, 0, len(raw))]
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        items = matched(part, level)
        frequency = normalise(Counter(items))
        body = bytes((CODED,)) + struct.pack("<256HI", *[frequency.get(s, 0) for s in range(256)], len(items)) + coded(items, frequency)
        if len(body) > len(items):
            body = bytes((RAW,)) + items
        out += [BLOCK_HEAD.pack(len(body), xxhash.xxh32_intdigest(part)), body]
    return b"".join([*out, BLOCK_HEAD.pack(0, 0)])


def unpress(data: bytes) -> bytes:
    """Raises ValueError for whatever is no whole stream."""
    if len(data) < HEADER.size or data[:4] != MAGIC or data[4] not in (VERSION, LEGACY):
        raise ValueError("no compressed stream")
    version, total, at, out = data[4], HEADER.unpack_from(data)[4], HEADER.size, []
    while at + BLOCK_HEAD.size <= len(data):
        size, check = BLOCK_HEAD.unpack_from(data, at)
        at += BLOCK_HEAD.size
        if not size:
            break
        body, at = data[at : at + size], at + size
        if len(body) != size:
            raise ValueError("a block is cut short")
        if version == VERSION:
            kind, body = body[0], body[1:]
        else:
            kind = CODED if size >= 516 and sum(struct.unpack_from("<256H", body)) == SCALE else RAW
        if kind == CODED:
            if len(body) < 516:
                raise ValueError("a block is cut short")
            *frequency, number = struct.unpack_from("<256HI", body)
            if number > 2 * BLOCK:
                raise ValueError("a block has too many symbols")
            body = decoded(body[516:], {s: f for s, f in enumerate(frequency) if f}, number)
        elif kind != RAW:
            raise ValueError("a block of an unknown kind")
        part = unmatched(body)
        if xxhash.xxh32_intdigest(part) != check:
            raise ValueError("a block's checksum is wrong")
        out.append(part)
    whole = b"".join(out)
    if len(whole) != total:
        raise ValueError("the stream's size is wrong")
    return whole


def original_size(data: bytes) -> int:
    """What the header says; 0 for other data."""
    return HEADER.unpack_from(data)[4] if len(data) >= HEADER.size and data[:4] == MAGIC and data[4] in (VERSION, LEGACY) else 0
