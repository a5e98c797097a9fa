"""Content-chosen anchors: in every window of `window` bytes, one k-gram picked by its bytes alone.

Two equal windows pick the same k-gram at the same place inside them, so work that must find all
equal windows can look at one position in about twelve instead of every byte.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B1
_MASK = 0xFFFFFFFF


class Anchors(NamedTuple):
    """at: position of each anchor; first, last: the windows (by start) that chose it, without gaps."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def gram_length(window: int) -> int:
    return max(1, window // 2 - 1)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 31-bit hash of the k bytes that start at each position, never 0."""
    level = data.astype(np.uint32) + np.uint32(1)
    width, covered, out = 1, 0, None
    while True:
        if k & width:
            if out is None:
                out, covered = level, width
            else:
                n = len(level) - covered
                out = out[:n] * np.uint32(pow(_BASE, width, 1 << 32)) + level[covered:]
                covered += width
        if width * 2 > k:
            break
        level = level[:-width] * np.uint32(pow(_BASE, width, 1 << 32)) + level[width:]
        width *= 2
    out = out[: len(data) - k + 1].copy()
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out | np.uint32(1)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[:-rest], values[rest:]) if rest else values


def _anchors_of_block(data: np.ndarray, bounds: np.ndarray, window: int) -> Anchors:
    k = gram_length(window)
    span = window - k + 1
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return Anchors(none, none, none)
    grams = _gram_hashes(data, k)
    least = _slide(grams, span, np.minimum)
    inside = np.ones(len(data) + 1, bool)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        inside[max(begin, end - window + 1) : end] = False
    inside = inside[: len(least)]
    held = np.zeros(len(least) + 2 * (span - 1), np.uint32)
    held[span - 1 : span - 1 + len(least)] = np.where(inside, least, np.uint32(0))
    chosen = _slide(held, span, np.maximum) == grams
    at = np.flatnonzero(chosen)
    if not len(at):
        return Anchors(none, none, none)
    starts = np.flatnonzero(inside)
    before = np.cumsum(chosen, dtype=np.int32)
    index = (before[starts] - chosen[starts]).astype(np.int64)
    wanted, values = least[starts], grams[at]
    wrong = np.flatnonzero(values[index] != wanted)
    while len(wrong):
        index[wrong] += 1
        wrong = wrong[values[index[wrong]] != wanted[wrong]]
    edge = np.flatnonzero(np.diff(index)) + 1
    begins, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(index)])) - 1
    return Anchors(at[index[begins]], starts[begins], starts[ends])


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, block: int = 1 << 18) -> Anchors:
    """Anchors of the texts data[bounds[i]:bounds[i+1]]; no window crosses a bound."""
    parts, i = [], 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, "right")) - 1)
        base = int(bounds[i])
        found = _anchors_of_block(data[base : int(bounds[j])], bounds[i : j + 1] - base, window)
        parts.append(Anchors(*(x + base for x in found)))
        i = j
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none)
    return Anchors(*(np.concatenate(x) for x in zip(*parts)))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def fingerprints(data: np.ndarray, at: np.ndarray, k: int, block: int = 1 << 14) -> np.ndarray:
    """64-bit fingerprints of the k bytes at each position."""
    width = -(-k // 8) * 8
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), block):
        part = np.zeros((len(at[i : i + block]), width), np.uint8)
        part[:, :k] = data[at[i : i + block, None] + np.arange(k)]
        words = part.view("<u8")
        h = np.full(len(part), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
        for j in range(words.shape[1]):
            h = mix64(h ^ words[:, j])
        out[i : i + block] = h
    return out
