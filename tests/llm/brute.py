"""Plain definitions that tests compare with, written without the package."""

import re

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str, k: int) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = SPACED.findall(lower)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) > k else [" ".join(w)] if w else []


def simhash(text: str, k: int) -> int:
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges) -> dict:
    """Each node's representative."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}
