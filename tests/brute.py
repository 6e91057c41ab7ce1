"""Plain-Python oracles used only by the tests (small fixtures, exact semantics)."""

from __future__ import annotations

import re

import numpy as np


def py_strip(s: str) -> str:
    return s.strip()


def recursive_split(text: str, size: int = 512, overlap: int = 50, seps=("\n\n", "\n", ". ", " ", ""),
                    length=len) -> list[str]:
    """Greedy recursive character splitting, separator kept at the start of the following piece."""

    def pack(pieces):
        out, cur, total = [], [], 0
        for d in pieces:
            ln = length(d)
            if total + ln > size and cur:
                joined = "".join(cur).strip()
                if joined:
                    out.append(joined)
                while total > overlap or (total + ln > size and total > 0):
                    total -= length(cur[0])
                    cur = cur[1:]
            cur.append(d)
            total += ln
        joined = "".join(cur).strip()
        if joined:
            out.append(joined)
        return out

    def split(t, seplist):
        chosen, rest = seplist[-1], []
        for i, s in enumerate(seplist):
            if s == "":
                chosen = s
                break
            if s in t:
                chosen, rest = s, list(seplist[i + 1:])
                break
        if chosen:
            raw = re.split("(" + re.escape(chosen) + ")", t)
            pieces = [raw[0]] + [raw[i] + raw[i + 1] for i in range(1, len(raw), 2)]
        else:
            pieces = list(t)
        pieces = [p for p in pieces if p != ""]
        final, good = [], []
        for p in pieces:
            if length(p) < size:
                good.append(p)
            else:
                if good:
                    final.extend(pack(good))
                    good = []
                if not rest:
                    final.append(p)
                else:
                    final.extend(split(p, rest))
        if good:
            final.extend(pack(good))
        return final

    return split(text, list(seps))


def window_split(text: str, size: int, overlap: int) -> list[str]:
    return recursive_split(text, size, overlap, seps=("",))


def semantic_split(text: str, embed, amount: float = 50.0, digits: int = 9) -> list[str]:
    sents = re.split(r"(?<=[.?!])\s+", text)
    if len(sents) == 1:
        return sents
    comb = [" ".join(sents[max(i - 1, 0): min(i + 1, len(sents) - 1) + 1]) for i in range(len(sents))]
    vecs = [np.asarray(embed(c), dtype=float) for c in comb]
    dists = []
    for a, b in zip(vecs, vecs[1:]):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        sim = float(np.dot(a, b) / (na * nb)) if na > 0 and nb > 0 else 0.0
        dists.append(round(1.0 - sim, digits))
    thr = float(np.percentile(dists, amount))
    out, start = [], 0
    for i, d in enumerate(dists):
        if d > thr:
            out.append(" ".join(sents[start: i + 1]))
            start = i + 1
    if start < len(sents):
        out.append(" ".join(sents[start:]))
    return out
