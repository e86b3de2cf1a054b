"""Similarity self-join of documents on the Jaccard index of their word n-grams, and the groups that it links.

Rare-first prefix filtering. Of two sets with a Jaccard index of at least t, the first n - ceil(t n) + 1 elements, in
any order common to all, share one. The order is by the number of documents that hold an n-gram, rarest first.

1. Documents: a pass over the texts gives each document's set size, a digest of its word sequence (documents of one
   sequence are one class, represented by the smallest), a signature for the suffix filter, and the n-grams that are
   very frequent. These are found by lossy counting: what makes up more than one in HOTS of all occurrences is found
   for certain, so at most HOTS n-grams are broadcast, whatever the input. They come last in the order.
2. Frequencies: a second pass deals the even half of all other hashes by ranges, packed (4 bytes an n-gram and the
   documents' ids once a pack). A task sorts its range and sends back, for each n-gram that two documents share, the
   document and the exact count. N-grams of one document alone, usually most, never travel again. The even half holds
   several times a prefix's length, so the rarest of it make the prefix; it comes first in the order, by the counts,
   then the odd half by hash (which only very small sets need), then the very frequent ones.
3. Prefixes: a document's n-grams that nobody else has come first, so the shared ones' positions follow from their
   number. Those within the prefix are the postings (n-gram, document, set size, position).
4. Candidates: documents with a posting in common that pass the length filter, the positional filter and the suffix
   filter (fixed pivots cut the hashes into PARTS parts; the parts' numbers of elements bound the overlap).
5. Each candidate pair is verified once, on the words of the texts themselves, so no hash makes a link.

Pairs are not all made. In a round, the documents of an n-gram, in blocks of at most BLOCK, are gathered greedily: a
leader takes all that pass the filters with it, and the next leader comes from what is left; a document gives one pair
an n-gram. Verified links give components. Rounds go on, with blocks dealt anew, while n-grams are left whose documents
lie in several components and would make many pairs. Last, every pair that passes the filters, shares a posting and
lies in different components is verified, by pairs of blocks: documents outside an n-gram's largest component against
all. So groups are exact, and a group of many similar documents costs about a comparison each.

Hashes of n-grams have 64 bits, of which postings keep 32 besides the range's: an n-gram's words are hashed by BLAKE2b
and then mixed. What equal hashes of different n-grams could do is make a set one smaller (n_shingles; two n-grams of
one document, 2**-64 a pair), or add a candidate, which verification drops. Word sequences are told apart by 128 bits of
BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import common

#: At most so many n-grams are broadcast as frequent; none that occurs fewer than HOT_LEAST times.
HOTS, HOT_LEAST = 1 << 18, 256
#: Parts that pivots cut the hashes into, for the suffix filter (half a byte each).
PART_BITS = 8
PARTS = 1 << PART_BITS
#: Bytes of text that are worked on at once (a longer text is one batch).
BATCH = 1 << 19
#: N-grams that a task deals at once, and that a task of the second pass gets (about).
FLUSH, TASK_GRAMS = 1 << 20, 1 << 21
#: Documents of an n-gram that are compared in one task.
BLOCK = 1024
#: Rounds of greedy gathering, at most; what they leave is compared anyway.
ROUNDS = 3
#: Words whose hashes a worker keeps.
KEPT_WORDS = 100_000
#: Bits of a hash that n-grams of one range are told apart by (about a million share a range).
LOW_BITS = 32


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int, digests: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document number, n-gram hash) of each distinct n-gram of some texts, a document's together.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words than width is one n-gram,
    one without words has none. digests: gets the digest of each text's word sequence.
    """
    get = common.hold("n-grams", _Words).__getitem__
    hashes, counts = [], []
    for t in texts:
        words = t.lower().split()
        counts.append(len(words))
        hashes.append(np.fromiter(map(get, words), dtype=np.uint64, count=len(words)))
        if digests is not None:
            digests.append(blake2b(b" ".join(words), digest_size=16).digest())
    word, many = np.concatenate(hashes or [np.zeros(0, dtype=np.uint64)]), np.array(counts, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(many)[:-1])) if len(many) else many

    def rolled(at: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(at), k, dtype=np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + word[at + i])
        return h

    of = np.flatnonzero(many >= width)
    n = many[of] - width + 1
    cut = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(of, n)
    gram = rolled(np.repeat(first[of], n) + np.arange(cut[-1]) - np.repeat(cut[:-1], n), width)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        gram[a:b].sort()
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    docs, grams = [doc[new]], [gram[new]]
    for k in range(1, width):  # texts of k words
        short = np.flatnonzero(many == k)
        docs.append(short)
        grams.append(rolled(first[short], k))
    return np.concatenate(docs), np.concatenate(grams)


def _batches(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[list[list[int | None]], list[bytes]]]:
    """(values of each key, texts) of about BATCH bytes each, of columns keys and text."""
    held, texts, size = [], [], 0
    for b in batches:
        for *key, t in zip(*(b.column(k).to_pylist() for k in keys), b.column("text")):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            if texts and size + len(raw) > BATCH:
                yield [list(x) for x in zip(*held)], texts
                held, texts, size = [], [], 0
            held.append(key)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield [list(x) for x in zip(*held)], texts


def _record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max((len(c) for c in columns.values()), default=0)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KIND[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


# --- 1: documents
STATS = "doc long, node long, n int, digest binary, sig binary, gram long, seen long"


class _Frequent:
    """Lossy counting: whatever makes up more than 1 / HOTS of all that was added is among the counts."""

    def __init__(self):
        self.gram, self.n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.waiting, self.size, self.total = [], 0, 0

    def add(self, grams: np.ndarray, last: bool = False) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size >= FLUSH or last:
            gram, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            keep = n >= max(2, self.size / HOTS)
            both, at = np.unique(np.concatenate((self.gram, gram[keep])), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate((self.n, n[keep])), minlength=len(both)).astype(np.int64)
            self.total += self.size
            keep = n >= max(2, self.total / HOTS)
            self.gram, self.n = both[keep], n[keep]
            self.waiting, self.size = [], 0


def _signatures(docs: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """How many of a document's hashes lie in each part, at most 15, two parts a byte."""
    part = (grams >> np.uint64(64 - PART_BITS)).astype(np.int64)
    spread = np.minimum(np.bincount(docs * PARTS + part, minlength=n * PARTS), 15).astype(np.uint8).reshape(n, PARTS)
    return spread[:, ::2] | (spread[:, 1::2] << 4)


def _counted(sigs: np.ndarray) -> np.ndarray:
    return np.concatenate((sigs & 15, sigs >> 4), axis=-1).astype(np.int16)


def _stats(width: int):
    schema = _schema(STATS)

    def run(batches):
        frequent = _Frequent()
        for (ids, nodes), texts in _batches(batches, "doc", "node"):
            digests: list[bytes] = []
            docs, grams = shingle_sets(texts, width, digests)
            n = np.bincount(docs, minlength=len(texts)).astype(np.int32)
            yield _record(schema, doc=ids, node=nodes, n=n, digest=digests, sig=[x.tobytes() for x in _signatures(docs, grams, len(texts))])
            frequent.add(grams)
        frequent.add(np.zeros(0, dtype=np.uint64), last=True)
        yield _record(schema, gram=frequent.gram.view(np.int64), seen=frequent.n)

    return run


# --- 2: frequencies
def _part(nodes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(nodes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first: what they have in common is compressed away when they are shuffled."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _of_planes(raw: np.ndarray, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(-1, n).T).reshape(-1).view(kind)


DEALT = "bucket int, part int, body binary"


def _sliced(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal keys begin and end."""
    start = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()] if len(keys) else []
    return list(zip(start, [*start[1:], len(keys)]))


def _dealt(width: int, num: int, den: int, bits: int, parts: int, hot):
    """Packs of even n-grams by bucket (the first bits of the hash): ids and numbers of n-grams of the documents, and the n-grams.

    Of each document, the number of n-grams that aren't dealt, and those of them that its prefix reaches, go to its part
    at once: in packs of a part of 0 or more.
    """
    schema = _schema(DEALT)
    shift = np.uint64(64 - bits - LOW_BITS)

    def run(batches):
        frequent, rank = hot.value
        held, direct, size = [], [], 0

        def flush():
            node, gram = (np.concatenate(x) for x in zip(*held))
            bucket = (gram >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64) if bits else np.zeros(len(gram), dtype=np.uint16)
            order = np.argsort(bucket, kind="stable")
            node, low, bucket = node[order], (gram[order] >> shift).astype(np.uint32), bucket[order].astype(np.int64)
            run = np.concatenate(([True], (node[1:] != node[:-1]) | (bucket[1:] != bucket[:-1]))) if len(node) else np.zeros(0, dtype=bool)
            buckets, of, bodies = [], [], []
            for a, b in _sliced(bucket):
                at = np.flatnonzero(run[a:b])
                many = np.diff(np.append(at, b - a)).astype(np.uint32)
                buckets.append(int(bucket[a]))
                of.append(-1)
                bodies.append(np.uint32(len(at)).tobytes() + _planes(node[a:b][at]) + _planes(many) + low[a:b].tobytes())
            node, special, many, token = (np.concatenate(x) for x in zip(*direct))
            part = _part(node, parts)
            ends = np.cumsum(many)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                tokens = [token[ends[d] - many[d] : ends[d]] for d in mine[many[mine] > 0]]
                buckets.append(int(p))
                of.append(int(p))
                bodies.append(np.uint32(len(mine)).tobytes() + _planes(node[mine]) + _planes(special[mine]) + _planes(many[mine]) + b"".join([x.tobytes() for x in tokens]))
            yield _record(schema, bucket=buckets, part=of, body=bodies)

        for (nodes,), texts in _batches(batches, "node"):
            nodes = np.array(nodes, dtype=np.int64)
            docs, grams = shingle_sets(texts, width)
            n = np.bincount(docs, minlength=len(texts))
            late = (grams & np.uint64(1)).astype(np.int64)  # 0: dealt, 1: odd half, over 1: very frequent
            if len(frequent) and len(grams):
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                late = np.where(frequent[at] == grams, 2 + rank[at], late)
            special = np.bincount(docs[late > 0], minlength=len(texts))
            need = np.where(n > 0, n - (-(-num * n // den)) + 1 - (n - special), 0)  # how many of these the prefix reaches
            reached = (late > 0) & (need[docs] > 0)
            doc, token, order = docs[reached], grams[reached] >> shift, late[reached]
            by = np.lexsort((grams[reached], order, doc))
            doc, token = doc[by], token[by]
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            kept = nth < need[doc]
            direct.append((nodes, special.astype(np.uint32), np.bincount(doc[kept], minlength=len(texts)).astype(np.uint32), token[kept]))
            held.append((nodes[docs[late == 0]], grams[late == 0]))
            size += len(grams)
            if size >= FLUSH:
                yield from flush()
                held, direct, size = [], [], 0
        if held:
            yield from flush()

    return run


SENT = "part int, bucket int, body binary, node long, n int"


def _frequencies(parts: int):
    """Of a bucket's packs, the n-grams that two documents have at least, with their counts, to the documents' parts."""
    schema = _schema(SENT)

    def run(batches):
        common.hold("n-grams", _Words)
        now, packs = None, []

        def finish():
            nodes, lows = [], []
            for raw in packs:
                raw = np.frombuffer(raw, dtype=np.uint8)
                k = int(raw[:4].view(np.uint32)[0])
                nodes.append(np.repeat(_of_planes(raw[4 : 4 + 8 * k], k, np.int64), _of_planes(raw[4 + 8 * k : 4 + 12 * k], k, np.uint32)))
                lows.append(raw[4 + 12 * k :].view(np.uint32))
            node, low = np.concatenate(nodes), np.concatenate(lows)
            order = np.argsort(low, kind="stable")
            node, low = node[order], low[order]
            start = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
            n = np.diff(np.append(start, len(low)))  # documents of each
            n = np.repeat(n, n)
            node, low, n = node[n > 1], low[n > 1], n[n > 1]
            if not len(node):
                return
            part = _part(node, parts)
            order = np.argsort(part, kind="stable")
            node, low, n, part = node[order], low[order], np.minimum(n[order], 65535).astype(np.uint16), part[order]
            cuts = _sliced(part)
            bodies = [np.uint32(b - a).tobytes() + _planes(node[a:b]) + _planes(n[a:b]) + low[a:b].tobytes() for a, b in cuts]
            yield _record(schema, part=[int(part[a]) for a, _ in cuts], bucket=np.full(len(cuts), now, dtype=np.int32), body=bodies)

        for b in batches:
            for bucket, part, body in zip(b.column("bucket").to_pylist(), b.column("part").to_pylist(), b.column("body")):
                if part >= 0:
                    yield _record(schema, part=[part], body=[body.as_py()])
                    continue
                if bucket != now and packs:
                    yield from finish()
                    packs = []
                now = bucket
                packs.append(body.as_py())
        if packs:
            yield from finish()

    return run


def _heads(parts: int):
    schema = _schema(SENT)

    def run(batches):
        for b in batches:
            nodes = np.asarray(b.column("node"))
            yield _record(schema, part=_part(nodes, parts), node=b.column("node"), n=b.column("n"))

    return run


# --- 3: prefixes
POSTING = "token long, node long, n int, pos int"


def _prefixes(num: int, den: int):
    schema = _schema(POSTING)

    def run(batches):
        common.hold("n-grams", _Words)
        now, rows = None, []

        def finish():
            heads = {node: n for _, body, node, n in rows if body is None}
            if not heads:
                return
            ids = np.array(sorted(heads), dtype=np.int64)
            size = np.array([heads[i] for i in ids.tolist()], dtype=np.int64)
            special = np.full(len(ids), -1, dtype=np.int64)
            node, token, df = [], [], []
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # tokens, documents' numbers, positions

            def numbers(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Documents' numbers, and which are representatives at all."""
                at = np.minimum(np.searchsorted(ids, nodes), len(ids) - 1)
                return at, ids[at] == nodes

            for bucket, body, *_ in rows:
                if body is None:
                    continue
                raw = np.frombuffer(body, dtype=np.uint8)
                k = int(raw[:4].view(np.uint32)[0])
                if bucket is None:  # what wasn't dealt
                    at, known = numbers(_of_planes(raw[4 : 4 + 8 * k], k, np.int64))
                    rest, many = (_of_planes(raw[4 + a * k : 4 + (a + 4) * k], k, np.uint32).astype(np.int64) for a in (8, 12))
                    tokens = raw[4 + 16 * k :].view(np.int64)
                    known &= special[at] < 0  # rows alike come more than once
                    special[at[known]] = rest[known]
                    d = np.repeat(np.arange(k), many)
                    nth = np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many)
                    mine = known[d]
                    d, nth = d[mine], nth[mine]
                    out.append((tokens[mine], at[d], size[at[d]] - rest[d] + nth))
                    continue
                node.append(_of_planes(raw[4 : 4 + 8 * k], k, np.int64))
                df.append(_of_planes(raw[4 + 8 * k : 4 + 10 * k], k, np.uint16))
                token.append(raw[4 + 10 * k :].view(np.uint32).astype(np.int64) | (bucket << LOW_BITS))
            if node:
                node, token, df = np.concatenate(node), np.concatenate(token), np.concatenate(df)
                at, known = numbers(node)
                at, token, df = at[known], token[known], df[known]
                order = np.lexsort((token, df, at))
                at, token = at[order], token[order]
                new = np.ones(len(at), dtype=bool)  # rows alike
                new[1:] = (at[1:] != at[:-1]) | (token[1:] != token[:-1])
                at, token = at[new], token[new]
                shared = np.bincount(at, minlength=len(ids))
                alone = np.maximum(size - shared - np.maximum(special, 0), 0)
                pos = alone[at] + np.arange(len(at)) - (np.cumsum(shared) - shared)[at]
                kept = pos < (size - (-(-num * size // den)) + 1)[at]
                out.append((token[kept], at[kept], pos[kept]))
            if out:
                token, at, pos = (np.concatenate(x) for x in zip(*out))
                yield _record(schema, token=token, node=ids[at], n=size[at].astype(np.int32), pos=pos.astype(np.int32))

        for b in batches:
            parts, *columns = (b.column(c).to_pylist() for c in ("part", "bucket", "body", "node", "n"))
            for part, *row in zip(parts, *columns):
                if part != now and rows:
                    yield from finish()
                    rows = []
                now = part
                rows.append(row)
        if rows:
            yield from finish()

    return run


# --- 4: candidates
class _Group:
    """Postings of one n-gram (or of two blocks of it) as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        for c in ("node", "n", "pos", "comp"):
            setattr(self, c, np.asarray(batch.column(c)).astype(np.int64))
        self.sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)

    def passes(self, a: int | np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which of b may link with a: length, positional (for the first n-gram that two sets share) and suffix filter."""
        na, nb = self.n[a], self.n[b]
        size = na + nb
        ok = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
        ok &= np.minimum(na - self.pos[a], nb - self.pos[b]) * (num + den) >= size * num
        at = np.flatnonzero(ok)
        if len(at):
            # elements in different parts aren't equal, so the sets differ by the parts' differences at least
            apart = np.abs(_counted(self.sig[a if np.isscalar(a) else a[at]]) - _counted(self.sig[b[at]])).sum(axis=-1)
            ok[at] = apart <= (size - 2 * (-(-num * size // (num + den))))[at]
        return ok


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by keys: tables, and where their groups begin."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            x = np.asarray(t.column(k))
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
            held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


PAIR = "a long, b long"


def _greedy(num: int, den: int, seed: int):
    """(leader, document) for the documents of each n-gram that pass the filters and lie in different components."""
    schema = _schema(PAIR)

    def run(batches):
        common.hold("n-grams", _Words)
        for t, start in _groups(batches, ["token", "block"]):
            g = _Group(t)
            end = np.append(start[1:], t.num_rows)
            two = start[end - start == 2]  # by far most of them
            two = two[(g.comp[two] != g.comp[two + 1]) & (g.node[two] != g.node[two + 1])]
            for k in range(0, len(two), 4096):
                a = two[k : k + 4096]
                a = a[g.passes(a, a + 1, num, den)]
                yield _record(schema, a=g.node[a], b=g.node[a + 1])
            for i, j in zip(start.tolist(), end.tolist()):
                if j - i < 3:
                    continue
                left = np.arange(i, j)
                left = left[np.lexsort((mix(g.node[left].view(np.uint64) + np.uint64(seed)), g.n[left] if not seed else g.comp[left] * 0))]
                while len(left) > 1:
                    a, left = int(left[0]), left[1:]
                    other = g.comp[left] != g.comp[a]
                    taken = np.zeros(len(left), dtype=bool)
                    taken[other] = g.passes(a, left[other], num, den)
                    if taken.any():
                        yield _record(schema, a=np.full(int(taken.sum()), g.node[a]), b=g.node[left[taken]])
                    left = left[~taken & other]
        yield _record(schema, a=[], b=[])

    return run


def _across(num: int, den: int):
    """All pairs (a, b), of rows outside their n-gram's largest component (role 0) and all others, that pass and lie in different components."""
    schema = _schema(PAIR)

    def run(batches):
        common.hold("n-grams", _Words)
        for t, start in _groups(batches, ["token", "i", "j"]):
            g = _Group(t)
            role, main = np.asarray(t.column("role")), np.asarray(t.column("main"))
            for i, j in zip(start.tolist(), [*start[1:].tolist(), t.num_rows]):
                every = np.arange(i, j)
                against = every[role[i:j] == 1]
                for a in every[role[i:j] == 0].tolist():
                    b = against[(g.comp[against] != g.comp[a]) & ((g.comp[against] == main[a]) | (g.node[against] > g.node[a]))]
                    b = b[g.passes(a, b, num, den)] if len(b) else b
                    if len(b):
                        yield _record(schema, a=np.full(len(b), g.node[a]), b=g.node[b])
        yield _record(schema, a=[], b=[])

    return run


# --- 5: verification
def linked(a: bytes, b: bytes, width: int, num: int, den: int) -> bool:
    """Whether den * |A & B| >= num * |A | B| for the sets of n-grams of two texts, told by the words themselves."""
    number: dict[bytes, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t.lower().split()], dtype=np.int64) for t in (a, b))
    if not len(x) or not len(y):
        return False
    if min(len(x), len(y)) < width:
        return num <= den and np.array_equal(x, y)
    n, size = len(number), 1
    cut = len(x) - width + 1
    g = np.concatenate((x[:cut], y[: len(y) - width + 1]))
    for k in range(1, width):
        size *= n
        if size * n >= 1 << 62:  # the n-grams so far are numbered anew
            g = np.unique(g, return_inverse=True)[1]
            size = len(g)
        g = g * n + np.concatenate((x[k : cut + k], y[k : len(y) - width + 1 + k]))
    p, q = np.unique(g[:cut]), np.unique(g[cut:])
    both = len(np.intersect1d(p, q, assume_unique=True))
    return den * both >= num * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) for pairs (a, b)."""
    schema = _schema("a long, b long, linked boolean")

    def run(batches):
        common.hold("n-grams", _Words)
        for r in batches:
            out = [linked(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), width, num, den) for x, y in zip(r.column("ta"), r.column("tb"))]
            yield _record(schema, a=r.column("a"), b=r.column("b"), linked=out)

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v) is connected with.

    Alternating stars: a node's greater neighbours, then its smaller ones, are linked to its smallest neighbour, until
    every node hangs on its component's smallest. Each round is written to the shared folder.
    """

    def count(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    e = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = count(e)
    for _ in range(max_rounds):
        if not before.n:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.written(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        after = count(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _postings(rows: DataFrame, found: DataFrame, hot, total: int, width: int, num: int, den: int) -> DataFrame:
    """The postings of class representatives, by exact frequencies."""
    tasks = max(1, -(-total // TASK_GRAMS))
    bits, parts = min(24, (2 * tasks - 1).bit_length()), 2 * tasks
    dealt = rows.where("node IS NOT NULL").select("node", "text").mapInArrow(_dealt(width, num, den, bits, parts, hot), DEALT)
    sent = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequencies(parts), SENT)
    heads = found.where("rep = node AND n > 0").select("node", "n").mapInArrow(_heads(parts), SENT)
    return sent.unionByName(heads).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_prefixes(num, den), POSTING)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, class_id.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of distinct word n-grams; component_id is the
    smallest id reachable, class_id the smallest id with the very same words. Null and empty texts, or texts of white
    space, have no n-grams and link with nothing. Rows that share an id are one document that links through any of its
    rows (their texts are shuffled to tell them apart). A null id takes part in nothing and has null component and
    class. Empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    twice = common.written(rows.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("k")).where("k > 1"), "twice")
    repeated = twice.limit(1).count() > 0
    if repeated:  # each text of an id gets a number of its own
        rows = common.lookup(rows, twice, ["doc"], "k", rows.count()).select("doc", "text", F.when(F.col("k").isNull(), F.col("doc")).otherwise(F.xxhash64("doc", "text")).alias("node"))
    else:
        rows = rows.withColumn("node", F.col("doc"))
    stats = common.written(rows.mapInArrow(_stats(width), STATS), "stats")
    of_docs = stats.where("n IS NOT NULL")
    sums = of_docs.agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).first()
    total, n_grams = sums.rows, int(sums.grams or 0)

    # frequent n-grams: HOTS at most, as their numbers are from below
    often = stats.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(n_grams / HOTS, HOT_LEAST)).toPandas()
    gram, seen = often["gram"].to_numpy(dtype=np.int64).view(np.uint64), often["seen"].to_numpy(dtype=np.int64)
    rank = np.empty(len(gram), dtype=np.int64)
    rank[np.lexsort((gram, seen))] = np.arange(len(gram))
    order = np.argsort(gram)
    hot = spark.sparkContext.broadcast((gram[order], rank[order].astype(np.int32)))

    # classes of equal word sequences
    classes = of_docs.where("n > 0 AND node IS NOT NULL").groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("size")).where("size > 1")
    classes = common.written(classes, "classes")
    rep = F.when(F.col("node").isNotNull(), F.coalesce("rep", "node")).alias("rep")
    met = common.lookup(of_docs.select("doc", "node", "n", "sig", "digest"), classes, ["digest"], "size", total)
    found = common.written(met.select("doc", "node", "n", "sig", rep, F.coalesce("size", F.lit(1)).cast("long").alias("size")), "found")
    common.drop(stats, classes)

    live = common.written(_postings(rows, found, hot, n_grams, width, num, den).where("token IS NOT NULL"), "postings")
    n_live = live.count()
    sigs = found.where("rep = node").select("node", "sig")
    sigs = sigs.dropDuplicates(["node"]) if repeated else sigs
    done: DataFrame | None = None
    labels: DataFrame | None = None

    def joined(links: DataFrame) -> None:
        """Brings the components up to date; components so far are single nodes."""
        nonlocal labels
        if labels is not None:
            now = links.join(labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
            links = now.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v")))
        labels = common.written(components(links), "components")

    def verify(pairs: DataFrame) -> None:
        nonlocal done
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = common.written(pairs, "pairs")
        n = pairs.count()
        if not n:
            return
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().withColumn("h", F.xxhash64("node"))
        texts = rows.withColumn("h", F.xxhash64("node")).where(common.bloom(wanted, "h", 2 * n)).drop("h")
        texts = common.written(texts.join(wanted, "node", "left_semi").select("node", "text"), "texts")
        new = common.written(_verified(pairs, texts, width, num, den), "links")
        common.drop(pairs, texts)
        done = new if done is None else done.unionByName(new)
        joined(new.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))

    def several() -> tuple[DataFrame, int]:
        """Postings of n-grams whose documents lie in several components, and a bound on the pairs that these would make."""
        nonlocal live
        now = live.withColumn("comp", F.col("node"))
        if labels is not None:
            now = live.join(labels.select("node", "component"), "node", "left").select(*live.columns, F.coalesce("component", "node").alias("comp"))
        now = common.written(now, "labelled")
        sizes = now.groupBy("token", "comp").agg(F.count("*").alias("k"))
        main = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("x"), F.sum("k").alias("k"), F.count("*").alias("comps")).where("comps > 1")
        main = common.written(main.select("token", F.col("x.comp").alias("main"), F.col("x.k").alias("inside"), "k"), "open")
        work = main.agg(F.sum((F.col("k") - F.col("inside")) * F.col("k"))).first()[0] or 0
        now = common.written(common.lookup(now, main, ["token"], "k", n_live).where("k IS NOT NULL"), "live")
        live = now.select(*live.columns)  # components only grow, so no other n-gram has several later
        return now.join(sigs, "node"), work

    def block(n_rows, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(n_rows / BLOCK)).cast("int")

    if repeated:  # the rows of an id are linked
        joined(found.where("node <> doc").select(F.col("rep").alias("u"), F.min("rep").over(Window.partitionBy("doc")).alias("v")).distinct())
    for seed in range(ROUNDS):
        now, work = several()
        if not work or seed and work <= 4 * n_live:
            break
        dealt = now.withColumn("block", block(F.col("k"), seed)).repartition("token", "block").sortWithinPartitions("token", "block")
        verify(dealt.mapInArrow(_greedy(num, den, seed), PAIR))
    else:
        now, work = several()
    if work:  # all that is left
        outside = now.where("comp <> main").withColumns({"role": F.lit(0), "i": block(F.col("k") - F.col("inside"), -1), "j": F.explode(F.sequence(F.lit(0), F.ceil(F.col("k") / BLOCK).cast("int") - 1))})
        every = now.withColumns({"role": F.lit(1), "j": block(F.col("k"), -1), "i": F.explode(F.sequence(F.lit(0), F.ceil((F.col("k") - F.col("inside")) / BLOCK).cast("int") - 1))})
        dealt = outside.unionByName(every).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
        verify(dealt.mapInArrow(_across(num, den), PAIR))

    out = found.select("doc", "n", "rep", "size")
    if labels is not None:
        of_class = found.where("rep IS NOT NULL").groupBy("rep").agg(F.max("size").alias("size"))
        table = labels.select(F.col("node").alias("rep"), "component").join(of_class, "rep")
        out = common.lookup(out.drop("size"), table, ["rep"], "size", total).withColumn("component", F.coalesce("component", "rep"))
    else:
        out = out.withColumn("component", F.col("rep"))
    if repeated:  # numbers become ids again
        for c in ("component", "rep"):
            names = out.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("doc").alias(f"least_{c}"), F.count("*").alias("many"))
            out = common.lookup(out, names, [c], "many", total).drop("many")
        out = out.select("doc", "n", F.col("least_component").alias("component"), F.col("least_rep").alias("rep"))
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("rep").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with the smallest id of each group only. Rows of null id stay, and all rows of an id that stays."""
    groups = near_groups(docs, id_col, text_col, width, num, den)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return common.without(docs, gone, id_col)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "class_id")


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i : i + 2] END AS g
  FROM t, LATERAL unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id,
       CASE WHEN len(t.w) = 0 THEN t.doc_id ELSE min(t.doc_id) OVER (PARTITION BY t.w) END AS class_id
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = t.doc_id
"""
