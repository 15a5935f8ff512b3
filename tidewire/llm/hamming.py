"""Vantage-point trees over 64-bit fingerprints.

Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // 2`` bits in their
lower or in their upper half. There is one tree for each half. Its nodes split by the distance of that
half to a vantage point, or, where the half is too alike, by the distance of the whole fingerprint. The
triangle bound tells which sides a fingerprint's partners can be on: at distance d, and with a side
ending at t, partners are inside only if d - r <= t and outside only if d + r > t, r being the radius
of the split's own distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidewire.llm.common import Links

LOW, WHOLE = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)
HALVES = (LOW, WHOLE ^ LOW)
#: Pairs compared at once, which bounds memory.
BLOCK = 1 << 21


@dataclass
class Node:
    """A split, or a leaf where ``vantage`` is None."""

    leaf: int = -1
    vantage: np.uint64 | None = None
    mask: np.uint64 = WHOLE
    radius: int = 0
    upto: int = 0
    inside: Node | None = None
    outside: Node | None = None


def distance(points: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask).astype(np.int16)


def choose_split(points: np.ndarray, half: np.uint64, radius: int, seed: int = 0):
    """The vantage point, mask, radius and end of the inner side that leave the least to compare.

    None if no split leaves less than nine tenths.
    """
    look = points if len(points) <= 4096 else points[:: len(points) // 2048]
    n, best, found = len(look), 0.9, None
    tries = look[np.random.default_rng(seed).integers(0, n, 4)]
    for mask, r in ((half, radius // 2), (WHOLE, radius)):
        for vantage in tries:
            counts = np.bincount(distance(look, vantage, mask), minlength=66)
            upto = np.cumsum(counts)
            for t in range(int(np.searchsorted(upto, 0.1 * n)), int(np.searchsorted(upto, 0.9 * n)) + 1):
                inner, inner_visits = upto[t], upto[min(t + r, 65)]
                outer_visits = n - (upto[t - r] if t >= r else 0)
                cost = (inner * inner_visits + (n - inner) * outer_visits) / (n * n)
                if cost < best and 0 < inner < n:
                    best, found = cost, (vantage, mask, r, t)
        if found:
            return found
    return None


def grow(sample: np.ndarray, half: np.uint64, radius: int, leaf_points: int) -> tuple[Node, int]:
    """A tree whose leaves hold about ``leaf_points`` of the sample, and its number of leaves."""
    count = 0

    def node(points: np.ndarray, depth: int) -> Node:
        nonlocal count
        split = choose_split(points, half, radius, depth) if len(points) > leaf_points and depth < 60 else None
        if split is None:
            count += 1
            return Node(leaf=count - 1)
        vantage, mask, r, t = split
        near = distance(points, vantage, mask) <= t
        return Node(-1, vantage, mask, r, t, node(points[near], depth + 1), node(points[~near], depth + 1))

    return node(np.asarray(sample, dtype=np.uint64), 0), count


def visits(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, leaf, home) of every leaf that a point lies in or may have partners in."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def walk(node: Node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node.vantage is None:
            out.append((at, node.leaf, home))
            return
        d = distance(points[at], node.vantage, node.mask)
        near = d <= node.upto
        reach = d <= node.upto + node.radius
        walk(node.inside, at[reach], (home & near)[reach])
        reach = d > node.upto - node.radius
        walk(node.outside, at[reach], (home & ~near)[reach])

    walk(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
    return (
        np.concatenate([at for at, _, _ in out]),
        np.concatenate([np.full(len(at), leaf, np.int32) for at, leaf, _ in out]),
        np.concatenate([home for _, _, home in out]),
    )


def link_shard(points: np.ndarray, home: np.ndarray, half: np.uint64, radius: int, small: int = 64) -> np.ndarray:
    """The root of every point's group, from links between home points and all points of the shard.

    Inside the shard the tree goes on down. A vantage point links itself to all within the radius; as
    these are one group from then on, only pairs that reach out of it are compared further.
    """
    links = Links(len(points))

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(q)))
        for start in range(0, len(p), step):
            rows = p[start : start + step]
            i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[q][None, :]) <= radius)
            links.add(rows[i], q[j])

    def walk(p: np.ndarray, q: np.ndarray, depth: int) -> None:
        while len(p) and len(q):
            if len(p) <= small or len(q) <= small or depth > 200:
                compare(p, q)
                return
            depth += 1
            split = choose_split(points[p], half, radius, depth)
            vantage = p[0] if split is None else None
            if split is not None:
                at, mask, r, t = split
                dp, dq = distance(points[p], at, mask), distance(points[q], at, mask)
                walk(p[dp <= t], q[dq <= t + r], depth)
                p, q = p[dp > t], q[dq > t - r]
                continue
            dp, dq = distance(points[p], points[vantage], WHOLE), distance(points[q], points[vantage], WHOLE)
            in_p, in_q = dp <= radius, dq <= radius
            if in_p.sum() * 8 < len(p):
                compare(p, q)
                return
            links.add(np.full(in_p.sum(), vantage), p[in_p])
            links.add(np.full(in_q.sum(), vantage), q[in_q])
            walk(p[in_p], q[~in_q & (dq <= 2 * radius)], depth)
            walk(p[~in_p & (dp <= 2 * radius)], q[in_q], depth)
            p, q = p[~in_p], q[~in_q]

    walk(np.flatnonzero(home), np.arange(len(points)), 0)
    return links.settle()
