"""Secret scans: fixed rules, and a character convolutional network in numpy over every other candidate.

The rules' matches always stay. Candidates are all runs of LEAST_CANDIDATE or more token characters, less what a rule
covers; what is left of a run is a candidate if it is still that long. The network judges a candidate from its
characters and those around it, in windows that cover all of it; the highest score counts. A filter looks at five
neighbouring symbols (letters apart in either case); the largest response in the context before, in the candidate and
in the context after feed a logistic unit.

It is trained on labelled findings: all candidates of all documents, positive where a rule matched. Every
positive finding comes twice: as it is, and altered so that no rule would match it: cut to fewer characters than the
rules ask for, half of them in upper case, without the words around. Half of all training copies have their context
blanked, so that the candidate itself must tell. Findings are split into FOLDS; each fold is scored by a network that
was trained on the others. On these scores the unit is calibrated (Platt), and the threshold is the highest one that
still finds MIN_RECALL of the positives. The network that scans is trained on all findings.

Up to START_FINDINGS of either label are learned on the driver, in several epochs. Beyond that, this is how all networks
start, and one pass over all findings follows, in ROUNDS rounds: every shard goes on from the networks of the round before
with findings of its own, and the mean of what the shards have learned is the next round's start. Weights follow the
numbers of all findings; calibration and threshold use the scores of all findings, to 1/GRID.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

# The rules.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "model")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
# runs that are long enough: the leftmost matches of the rule are its maximal runs, so the short ones can go at once
_hex = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
LEAST_CANDIDATE = 10
_candidate = re.compile(r"[A-Za-z0-9+/_=\-]{%d,}" % LEAST_CANDIDATE)

#: Findings of either label that training starts with.
START_FINDINGS = 2_000
#: The pass over all: rounds, findings a shard, shards at most (their networks meet on the driver), findings a step, rate.
ROUNDS, SHARD_FINDINGS, MOST_SHARDS, STEP, RATE = 4, 20_000, 96, 256, 0.001
GRID = 1024
MIN_RECALL = 0.98
FOLDS = 3

BEFORE, INSIDE, AFTER, TAPS, FILTERS = 24, 48, 16, 5, 16
#: Windows judged at once.
ASKED = 512
ZONES = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, BEFORE + INSIDE + AFTER))
#: Candidates of up to SHORT characters leave out the empty columns from LEAVE on: no filter that reaches them sees both sides.
SHORT = 22
LEAVE = SHORT + TAPS // 2


def rule_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' matches, by start and then kind in KINDS' order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, rules: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of what the rules leave of runs of token characters, and of the runs that a rule has a part of."""
    free, met = [], []
    k = 0
    for m in _candidate.finditer(text):
        at, end = m.span()
        while k < len(rules) and rules[k][1] <= at and rules[k][0] < at:
            k += 1  # ended before this run, and so before all later ones
        if k == len(rules) or rules[k][0] >= end and not any(e > at for _, e, _ in rules[max(0, k - len(KINDS)) : k]):
            free.append((at, end))
            continue
        touched, start, j = False, at, max(0, k - len(KINDS))
        while j < len(rules) and rules[j][0] < end:
            s, e, _ = rules[j]
            if e > at:
                touched = True
                if s - start >= LEAST_CANDIDATE:
                    free.append((start, s))
                start = max(start, e)
            j += 1
        if end - start >= LEAST_CANDIDATE:
            free.append((start, end))
        if touched:
            met.append((at, end))
    return free, met


def _symbols() -> np.ndarray:
    """A number for each byte: letters by themselves in either case, digits as one, marks by themselves."""
    table = np.full(256, 2, dtype=np.uint8)  # anything beyond ASCII
    table[:128] = 1
    table[0] = 0  # nothing there
    for k in range(26):
        table[97 + k], table[65 + k] = 3 + k, 29 + k
    table[48:58] = 55
    for k, c in enumerate(" \n\t\"':=/+-_.@,|()[]{}"):
        table[ord(c)] = 56 + k
    return table


SYMBOL = _symbols()
N_SYMBOLS = int(SYMBOL.max()) + 1


def _raw(s: str) -> bytes:
    """A byte for each character, 255 for those beyond ASCII."""
    if s.isascii():
        return s.encode("ascii")
    parts = (np.frombuffer(s[k : k + (1 << 20)].encode("utf-32-le", "surrogatepass"), dtype="<u4") for k in range(0, len(s), 1 << 20))
    return b"".join(np.where(x < 128, x, 255).astype(np.uint8).tobytes() for x in parts)


def _cut(raw: bytes, start: int, end: int) -> list[bytes]:
    at = [start] if end - start <= INSIDE else [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    stop = [min(a + INSIDE, end) for a in at]
    return [raw[max(0, a - BEFORE) : a].rjust(BEFORE, b"\0") + raw[a:b].ljust(INSIDE, b"\0") + raw[b : b + AFTER].ljust(AFTER, b"\0") for a, b in zip(at, stop)]


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Context before, up to INSIDE characters, context after, with 0 where there is nothing; half a window apart in a longer candidate."""
    return _cut(_raw(text), start, end)


def altered(window: bytes) -> bytes:
    """A positive finding as no rule would match it: cut short, without context, and in upper case by a hash of it."""
    inside = window[BEFORE : BEFORE + INSIDE].rstrip(b"\0")
    h = hashlib.md5(window).digest()
    inside = inside[: 12 + h[0] % 8]  # below the 20 of the shortest rule without a name
    return bytes(BEFORE) + (inside.upper() if h[1] % 2 else inside).ljust(INSIDE, b"\0") + bytes(AFTER)


def _largest(x: np.ndarray) -> np.ndarray:
    """x.max(axis=1), by halves: these lie together in memory. They share a column if there is an odd number of them."""
    while (w := x.shape[1]) > 1:
        x = np.maximum(x[:, : (w + 1) // 2], x[:, w // 2 :])
    return x[:, 0]


class CharNet:
    """Convolution over symbols, largest response by zone, logistic unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (TAPS, N_SYMBOLS, FILTERS)).astype(np.float32)
        self.filters[:, 0] = 0
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.3, len(ZONES) * FILTERS)
        self.shift = 0.0
        self.platt = (1.0, 0.0)
        self.threshold = 1.1  # nothing is added by an untrained network
        self.recall = 0.0  # of findings that the scoring network had not seen

    @staticmethod
    def ids(windows: list[bytes]) -> np.ndarray:
        return SYMBOL[np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(len(windows), -1)]

    def tables(self) -> list[np.ndarray]:
        """What neighbouring symbols add to the response: a row for every pair, for the last tap one for every symbol.

        An empty place in the middle is far below 0, where every response ends.
        """
        middle = self.filters[TAPS // 2].copy()
        middle[0] = -1e3
        taps = [self.filters[k] if k != TAPS // 2 else middle for k in range(TAPS)]
        pairs = [(taps[k][:, None] + taps[k + 1][None]).reshape(-1, FILTERS) for k in range(0, TAPS - 1, 2)]
        pairs[0] += self.bias
        return [*pairs, taps[-1]]

    def features(self, ids: np.ndarray, tables: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest responses by zone, 0 at least; with places also the TAPS symbols that gave each."""
        n = len(ids)
        out = np.empty((n, len(ZONES) * FILTERS), dtype=np.float32)
        seen = np.empty((TAPS, n, len(ZONES) * FILTERS), dtype=np.int32) if places else None
        long = ids[:, BEFORE + SHORT : BEFORE + INSIDE].any(axis=1)
        for rows, width in ((np.flatnonzero(~long), LEAVE), (np.flatnonzero(long), INSIDE)):
            if not len(rows):
                continue
            x = ids if len(rows) == n else ids[rows]
            length = BEFORE + width + AFTER
            wide = np.zeros((len(rows), length + TAPS - 1), dtype=np.int32)
            at = TAPS // 2
            wide[:, at : at + BEFORE + width] = x[:, : BEFORE + width]
            wide[:, at + BEFORE + width : at + length] = x[:, BEFORE + INSIDE :]
            pairs = wide[:, :-1] * N_SYMBOLS + wide[:, 1:]
            response = np.take(tables[0], pairs[:, :length], axis=0)
            for k in range(1, len(tables) - 1):
                response += np.take(tables[k], pairs[:, 2 * k : 2 * k + length], axis=0)
            response += np.take(tables[-1], wide[:, TAPS - 1 :], axis=0)
            for z, (lo, hi) in enumerate(((0, BEFORE), (BEFORE, BEFORE + width), (BEFORE + width, length))):
                best, filters = _largest(response[:, lo:hi]), slice(z * FILTERS, (z + 1) * FILTERS)
                out[rows, filters] = np.maximum(best, 0.0)
                if places:
                    left = np.arange(hi - lo, 0, -1, dtype=np.uint8)[None, :, None]  # largest at the first of equal ones
                    first = hi - _largest((response[:, lo:hi] == best[:, None]).view(np.uint8) * left).astype(np.int64)
                    first += np.arange(len(rows))[:, None] * wide.shape[1]
                    for tap in range(TAPS):
                        seen[tap, rows, filters] = wide.ravel()[first + tap]
        return out, seen

    def forward(self, ids: np.ndarray):
        features, seen = self.features(ids, self.tables(), places=True)
        return ids, features, seen, features @ self.out + self.shift

    def logits(self, ids: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """What forward gives last, without what only training needs; tables: this network's, where they are at hand."""
        return self.features(ids, tables or self.tables())[0] @ self.out + self.shift

    def fit(self, ids: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        moments = self.moments()
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                k = order[at : at + batch]
                self.step(ids[k], labels[k], weight[k], moments, rng, rate)

    def moments(self) -> list:
        return [0, [(np.zeros_like(p), np.zeros_like(p)) for p in (self.filters, self.bias, self.out)]]

    def step(self, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, moments: list, rng: np.random.Generator, rate: float) -> None:
        """One step of Adam on a batch; half of it without context."""
        x = ids.copy()
        blank = rng.random(len(x)) < 0.5
        x[blank, :BEFORE] = 0
        x[blank, BEFORE + INSIDE :] = 0
        _, features, seen, z = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(x)
        g_out = features.T @ d + 1e-4 * self.out
        g_features = np.outer(d, self.out) * (features > 0)
        rows, f = np.nonzero(g_features)
        at = (np.arange(TAPS)[:, None] * N_SYMBOLS + seen[:, rows, f]) * FILTERS + f % FILTERS
        g_filters = np.bincount(at.ravel(), np.tile(g_features[rows, f], TAPS), self.filters.size).reshape(self.filters.shape)
        g_filters[:, 0] = 0
        g_bias = g_features.reshape(len(x), len(ZONES), FILTERS).sum(axis=(0, 1))
        self.shift -= rate * d.sum()
        moments[0] += 1
        n = moments[0]
        for p, g, (m, v) in zip((self.filters, self.bias, self.out), (g_filters, g_bias, g_out), moments[1]):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)

    def learned(self) -> np.ndarray:
        return np.concatenate([self.filters.ravel(), self.bias, self.out, [self.shift]])

    @classmethod
    def of(cls, learned: np.ndarray) -> CharNet:
        net = cls()
        n = net.filters.size
        net.filters, net.bias = learned[:n].reshape(net.filters.shape).astype(np.float32), learned[n : n + FILTERS].astype(np.float32)
        net.out, net.shift = learned[n + FILTERS : -1].copy(), float(learned[-1])
        return net

    def calibrate(self, ids: np.ndarray, labels: np.ndarray, min_recall: float) -> None:
        """Platt scaling, then the highest threshold that keeps min_recall of the positives."""
        self._calibrate(self.logits(ids), labels, min_recall)

    def _calibrate(self, z: np.ndarray, labels: np.ndarray, min_recall: float, times: np.ndarray | None = None) -> None:
        """times: how many findings a score stands for, 1 if not given."""
        z = np.clip(z, -30, 30)
        times = np.ones(len(z)) if times is None else times
        a, b = 1.0, 0.0
        n1, n0 = (labels * times).sum(), ((1 - labels) * times).sum()
        part = times / times.sum()
        goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(300):
            p = 1 / (1 + np.exp(-(a * z + b)))
            a -= 0.05 * ((p - goal) * z * part).sum()
            b -= 0.05 * ((p - goal) * part).sum()
        self.platt = (max(a, 1e-3), b)
        positive, times = self._probable(z)[labels == 1], times[labels == 1]
        order = np.argsort(positive, kind="stable")
        positive, times = positive[order], times[order]
        if len(positive):
            self.threshold = float(positive[np.searchsorted(np.cumsum(times), np.floor((1 - min_recall) * n1), side="right")])
            self.recall = float(times[positive >= self.threshold].sum() / n1)

    def _probable(self, z: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))

    def probability(self, ids: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        return self._probable(self.logits(ids, tables))


def findings(texts) -> list[tuple[bytes, int, bytes]]:
    """(window, label, the finding it is of) of all candidates of some texts; the label is 1 where a rule matched."""
    out = []
    for t in texts:
        if t:
            free, met = candidates(t, rule_spans(t))
            raw = _raw(t) if free or met else b""
            out += [(w, 0, w) for c in free for w in _cut(raw, *c)]
            for c in met:
                for w in _cut(raw, *c):
                    out += [(w, 1, w), (altered(w), 1, w)]
    return out


def _fold(of: bytes) -> int:
    return hashlib.md5(of).digest()[0] % FOLDS


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", start_findings: int = START_FINDINGS, min_recall: float = MIN_RECALL) -> CharNet:
    """A network from all findings in all documents; start_findings: how many of either label are learned on the driver."""

    def label(batches):
        for b in batches:
            got = findings(b["text"].to_pylist())
            yield _batch(window=pa.array([w for w, *_ in got], pa.binary()), label=pa.array([y for _, y, _ in got], pa.int32()), fold=pa.array([_fold(x) for *_, x in got], pa.int32()))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(label, "window binary, label int, fold int").groupBy("window").agg(F.max("label").alias("label"), F.min("fold").alias("fold"))
    found = common.written(found, "findings")
    numbers = {r.label: r["count"] for r in found.groupBy("label").count().collect()}  # two rows
    net = CharNet()
    if min(numbers.get(0, 0), numbers.get(1, 0)) < 4:
        return net
    rows = []
    for y in (0, 1):
        rows += found.where(F.col("label") == y).orderBy(F.xxhash64("window"), "window").limit(start_findings).collect()  # at most start_findings
    labels = np.array([r.label for r in rows], dtype=np.float64)
    ids = net.ids([bytes(r.window) for r in rows])
    fold = np.array([r.fold for r in rows])
    others = {}  # by the fold that the network doesn't see
    for k in range(FOLDS):
        rest = fold != k
        if rest.all() or min(labels[rest].sum(), (1 - labels[rest]).sum()) < 1:
            continue
        others[k] = CharNet()
        others[k].fit(ids[rest], labels[rest])
    net.fit(ids, labels)
    if sum(numbers.values()) > len(rows):
        nets = _over_all(found, {-1: net} | others, numbers)
        net = nets.pop(-1)
        z, labels, times = _scores(found, nets)
    else:
        z, times = np.full(len(rows), np.nan), np.ones(len(rows))
        for k, other in others.items():
            z[fold == k] = other.logits(ids[fold == k])
    apart = ~np.isnan(z)
    if min((labels * times)[apart].sum(), ((1 - labels) * times)[apart].sum()) < 1:
        return CharNet()
    net._calibrate(z[apart], labels[apart], min_recall, times[apart])
    return net


def _over_all(found: DataFrame, nets: dict[int, CharNet], numbers: dict[int, int]) -> dict[int, CharNet]:
    """The networks (by the fold that they don't see) after one pass over all findings; the same however these are dealt."""
    spark, total = found.sparkSession, sum(numbers.values())
    shards = min(max(total // SHARD_FINDINGS, 1), MOST_SHARDS)
    weight = np.array([0.5 * total / numbers[0], 0.5 * total / numbers[1]])
    h = F.xxhash64("window")
    found = found.withColumns({"shard": F.pmod(h, F.lit(shards)).cast("int"), "round": F.pmod(F.shiftrightunsigned(h, 32), F.lit(ROUNDS)).cast("int")})
    for r in range(ROUNDS):
        start = spark.sparkContext.broadcast({k: net.learned() for k, net in nets.items()})  # of fixed size

        def learn(batches, start=start, r=r):
            at, held = None, []

            def steps(least):
                while held and (n := sum(len(x) for x, *_ in held)) >= least:
                    ids, y, fold = (np.concatenate(x) for x in zip(*held))
                    held[:] = [(ids[STEP:], y[STEP:], fold[STEP:])] if n > STEP else []
                    ids, y, fold = ids[:STEP], y[:STEP], fold[:STEP]
                    for k, (net, moments, rng) in mine.items():
                        if (use := fold != k).any():
                            net.step(ids[use], y[use].astype(np.float64), weight[y[use]], moments, rng, RATE)
                            seen[k] += int(use.sum())

            def ended():
                steps(1)
                shard, fold, n = pa.array([at] * len(mine), pa.int32()), pa.array(mine, pa.int32()), pa.array([seen[k] for k in mine], pa.int64())
                return _batch(shard=shard, fold=fold, n=n, learned=pa.array([net.learned().tobytes() for net, *_ in mine.values()], pa.binary()))

            for b in batches:
                shards, y, fold = (b[c].to_numpy() for c in ("shard", "label", "fold"))
                ids = CharNet.ids(b["window"].to_pylist())
                starts = [*np.flatnonzero(np.diff(shards, prepend=-1)), len(shards)]
                for lo, hi in zip(starts, starts[1:]):  # rows come by shard
                    if shards[lo] != at:
                        if at is not None:
                            yield ended()
                        at, seen = int(shards[lo]), dict.fromkeys(start.value, 0)
                        mine = {k: (net := CharNet.of(x), net.moments(), np.random.default_rng([r, at])) for k, x in start.value.items()}
                    held.append((ids[lo:hi], y[lo:hi], fold[lo:hi]))
                    steps(STEP)
            if at is not None:
                yield ended()

        dealt = found.where(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", h, "window").select("shard", "window", "label", "fold")
        got = sorted(dealt.mapInArrow(learn, "shard int, fold int, n long, learned binary").collect(), key=lambda x: (x.fold, x.shard))  # a row for each shard and network
        for k in nets:
            mine = [x for x in got if x.fold == k and x.n]
            if mine:
                nets[k] = CharNet.of(np.average([np.frombuffer(x.learned) for x in mine], axis=0, weights=[x.n for x in mine]))
    return nets


def _scores(found: DataFrame, nets: dict[int, CharNet]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all findings, each by the network that hasn't seen its fold, rounded down to the grid: score, label, how many."""
    shared = found.sparkSession.sparkContext.broadcast(nets)  # of fixed size

    def score(batches):
        tables = {k: net.tables() for k, net in shared.value.items()}
        top = 30 * GRID
        counts = np.zeros((2, 2 * top + 1), dtype=np.int64)  # by label and score
        for b in batches:
            ids, y, fold = CharNet.ids(b["window"].to_pylist()), b["label"].to_numpy(), b["fold"].to_numpy()
            for k, net in shared.value.items():
                if len(rows := np.flatnonzero(fold == k)):
                    z = np.floor(np.clip(net.logits(ids[rows], tables[k]), -30, 30) * GRID).astype(np.int64)
                    np.add.at(counts, (y[rows], z + top), 1)
        y, z = np.nonzero(counts)
        yield _batch(z=pa.array(z - top, pa.int32()), label=pa.array(y, pa.int32()), n=pa.array(counts[y, z]))

    rows = found.select("window", "label", "fold").mapInArrow(score, "z int, label int, n long").groupBy("z", "label").agg(F.sum("n").alias("n")).orderBy("z", "label").collect()  # at most 2 * 60 * GRID + 2
    return np.array([r.z for r in rows]) / GRID, np.array([r.label for r in rows], dtype=np.float64), np.array([r.n for r in rows], dtype=np.float64)


def scan(texts: list[str | None], net: CharNet) -> list[list[tuple[int, int, str, float]]]:
    """For each text (start, end, kind, score) of its secrets, by start and kind; rules score 1."""
    out: list[list[tuple[int, int, str, float]]] = []
    ask: list[bytes] = []
    whose: list[tuple[int, int, int]] = []
    best: dict[tuple[int, int, int], float] = {}
    tables = net.tables() if net.threshold <= 1 else None

    def judge():
        for key, x in zip(whose, net.probability(net.ids(ask), tables)):
            if x >= net.threshold:
                best[key] = max(best.get(key, 0.0), float(x))
        ask.clear()
        whose.clear()

    for n, t in enumerate(texts):
        t = t or ""
        rules = rule_spans(t)
        out.append([(*r, 1.0) for r in rules])
        if net.threshold <= 1:
            free = candidates(t, rules)[0]
            raw = _raw(t) if free else b""
            for c in free:
                for w in _cut(raw, *c):
                    ask.append(w)
                    whose.append((n, *c))
                    if len(ask) == ASKED:
                        judge()
    if ask:
        judge()
    for (n, s, e), x in best.items():
        out[n].append((s, e, "model", x))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "secrets", net: CharNet | None = None, **settings) -> DataFrame:
    """docs, all columns, with array<struct<start, end, kind, score>>: secrets in characters, end exclusive.

    Null and empty texts have none; equal texts have equal secrets. The network is trained on all docs if none is given;
    with fewer than four findings of either label it adds nothing and the rules stand alone. Rules' spans may overlap
    each other; the network's overlap none of them. An existing column of the name is replaced.
    """
    net = net or train(docs, id_col, text_col, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    @F.pandas_udf("array<struct<start:long,end:long,kind:string,score:double>>")
    def secrets(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in x] for x in scan(texts.tolist(), shared.value)])

    return docs.withColumn(out_col, secrets(F.col(text_col)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "secrets")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "model")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
