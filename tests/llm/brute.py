"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def suffix_dedup(texts: dict[int, str | None], window: int) -> dict[int, tuple]:
    seen: dict[bytes, int] = {}
    data = {k: (t or "").encode() for k, t in texts.items()}
    for b in data.values():
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            seen[w] = seen.get(w, 0) + 1
    out = {}
    for k, b in data.items():
        gone = [False] * len(b)
        end = 0
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                for j in range(max(i, end), i + window):
                    gone[j] = True
                end = i + window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def classes_of(ids, links) -> dict:
    """The least id that each id reaches over links."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        s, t = top(a), top(b)
        root[max(s, t)] = min(s, t)
    return {i: top(i) for i in ids}
