"""SHA-256 whose state can be kept: one compression at a time, over many messages at once.

Messages are digests written as hex text, 64 bytes each, so every child of a node fills exactly one
block of the hash. The state before a child's slot is then eight numbers, which fit into a table and can be
resumed by any task. Arrays have a row per 32-bit word and a column per message.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

WORDS = 8
BYTES = 32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= x else (low, middle - 1)
    return low


def _fraction(x: int) -> np.uint32:
    return np.uint32(x & 0xFFFFFFFF)


# The standard's constants by their rule: fractions of the square and cube roots of the first primes.
START = np.array([_fraction(isqrt(p << 64)) for p in _primes(8)], np.uint32)
ROUND = [_fraction(_cube_root(p << 96)) for p in _primes(64)]

#: Sixteen bits as four hex characters, in one word.
HEX = np.frombuffer("".join(f"{x:04x}" for x in range(1 << 16)).encode(), ">u4").astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8, m) after one block (16, m) each."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def fresh(m: int) -> np.ndarray:
    """The state before the first child, m times."""
    return np.repeat(START[:, None], m, axis=1)


def feed(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states after one more child, whose digest (8, m) is fed as hex text."""
    block = np.empty((16, digests.shape[1]), np.uint32)
    block[0::2], block[1::2] = HEX[digests >> np.uint32(16)], HEX[digests & np.uint32(0xFFFF)]
    return compress(state, block)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The digests of messages that end here, after so many children each."""
    block = np.zeros((16, state.shape[1]), np.uint32)
    block[0] = np.uint32(0x80000000)
    bits = children.astype(np.uint64) * np.uint64(512)
    block[14], block[15] = (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)
    return compress(state, block)


def unpack(packed: bytes) -> np.ndarray:
    """Digests or states of 32 bytes each, as columns."""
    return np.ascontiguousarray(np.frombuffer(packed, ">u4").reshape(-1, WORDS).T).astype(np.uint32)


def pack(columns: np.ndarray) -> bytes:
    return np.ascontiguousarray(columns.T).astype(">u4").tobytes()


def parents(digests: np.ndarray, place: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the parents, and for every child the parent's state before that child's slot.

    Children are ordered; ``place`` is a child's number among those of its tree, so runs of ``arity`` from
    place 0 share a parent.
    """
    slot = place % arity
    parent = np.cumsum(slot == 0) - 1
    state, before = fresh(parent[-1] + 1 if len(parent) else 0), np.empty_like(digests)
    for s in range(arity):
        at = np.flatnonzero(slot == s)
        if not len(at):
            break
        before[:, at] = state[:, parent[at]]
        state[:, parent[at]] = feed(before[:, at], digests[:, at])
    return finish(state, np.bincount(parent, minlength=state.shape[1])), before
