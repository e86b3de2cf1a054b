"""The definitions of the index, in plain Python."""

from __future__ import annotations

import re

LETTERS = "ACGT"


def kmers(seqs, k):
    return {r[i : i + k] for s in seqs for r in re.findall("[ACGT]+", s) for i in range(len(r) - k + 1)}


def padded(ks, k, seqs=None):
    ends = {x[1:] for x in ks}
    out = set(ks) | {"$" * k}
    for x in ks:
        if x[:-1] not in ends:
            out |= {x[:i].rjust(k, "$") for i in range(k)}
    if seqs:
        for s in seqs:
            for r in re.findall("[ACGT]+", s):
                out |= {r[:i].rjust(k, "$") for i in range(1, min(k - 1, len(r)) + 1)}
    return sorted(out, key=lambda x: x[::-1])


def labels(nodes, k):
    follow = {}
    for x in nodes:
        if x != "$" * k:
            follow.setdefault(x[:-1], set()).add(x[-1])
    out, seen = [], set()
    for x in nodes:
        out.append("" if x[1:] in seen else "".join(sorted(follow.get(x[1:], ()))))
        seen.add(x[1:])
    return out


def lcs(nodes):
    out = [0]
    for a, b in zip(nodes, nodes[1:]):
        n = 0
        while n < len(a) and a[-1 - n] == b[-1 - n] != "$":
            n += 1
        out.append(n)
    return out


def interval(nodes, s):
    at = [i for i, x in enumerate(nodes) if x.endswith(s)]
    return (at[0], at[-1] + 1) if at else None


def matching(nodes, k, query, bound=None):
    out, bound = [], bound or k
    for i in range(len(query)):
        run = re.search("([ACGT]*)$", query[max(0, i - k + 1) : i + 1]).group(1)
        d = next(d for d in range(min(len(run), bound), -1, -1) if d == 0 or interval(nodes, run[len(run) - d :]))
        out.append((d, *interval(nodes, run[len(run) - d :])))
    return out


def shortest(nodes, k, query, t):
    out = []
    for i in range(len(query)):
        run = re.search("([ACGT]*)$", query[max(0, i - k + 1) : i + 1]).group(1)
        found = None
        for d in range(len(run) + 1):
            r = interval(nodes, run[len(run) - d :])
            if r is None:
                break
            if r[1] - r[0] <= t:
                found = (d, *r)
                break
        out.append(found)
    return out


def unitigs(ks, k):
    ks = set(ks)
    out = {x: [x[1:] + c for c in LETTERS if x[1:] + c in ks] for x in ks}
    into = {x: [c + x[:-1] for c in LETTERS if c + x[:-1] in ks] for x in ks}

    def walk(x):
        path = [x]
        while len(out[path[-1]]) == 1:
            y = out[path[-1]][0]
            if y == x or len(into[y]) != 1:
                break
            path.append(y)
        return path

    found, seen = [], set()
    for cyclic in (False, True):
        for x in sorted(ks):
            first = len(into[x]) != 1 or len(out[into[x][0]]) > 1
            if x not in seen and (cyclic or first):
                path = walk(x)
                seen |= set(path)
                found.append((path[0] + "".join(y[-1] for y in path[1:]), cyclic))
    return sorted(found)
