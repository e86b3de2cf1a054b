"""Quality classifier by co-training two views of a document: its text's content and its page's metadata.

Content: frequencies of hashed character trigrams and of hashed five-grams of character kinds (letter in lower or upper
case, digit, each mark, white space), and the shares of distinct and of repeated words and of distinct lines, numbers and lengths of words and lines. Metadata:
source, language and recorded length, as hashed categories; it never sees the text. Either view is a logistic regression. In each round both judge
all unlabelled documents, and the most confident verdicts of one, in the labels' proportion and CONFIDENT more of all
documents every round, teach the other. Then both are calibrated (Platt) on labelled documents kept apart, and a logistic unit over the two
calibrated scores, fitted on these too, gives the document's score. The threshold keeps KEEP_GOOD of the good ones.

Fitting reads a sample of about LABELLED labelled documents, chosen by hash. The unlabelled ones are judged in tasks,
from a table of their views. Their verdicts come back in bounded size: a histogram of each view's scores, by which the
cut of the most confident is set, and for each view, verdict and kind of document (source and language, hashed to
KINDS_APART) the sum of the views of all documents within the cut. The mean of such a group, weighted by its number, is
a row of the other view's training set; all of them together have at most half the weight of the labelled ones, and
less by how little better than chance the view that gave them puts the labelled documents kept apart in order.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

#: Bound on the sample of labelled documents that fitting reads (expected number).
LABELLED = 3000
ROUNDS, CONFIDENT = 4, 0.05
KEEP_GOOD = 0.995
GRAMS, KINDS, DENSE, META = 1024, 1024, 8, 256
CONTENT = GRAMS + KINDS + DENSE
LEAST = 10
#: Groups of documents whose confident verdicts are summed; bins of a score between -REACH and REACH.
KINDS_APART, BINS, REACH = 32, 4096, 16.0
#: Logarithm of nine.
EDGE = 2.1972245773362196
#: Sums are of whole numbers, so that no order of adding changes them.
UNIT = float(1 << 24)


def _kind_table() -> np.ndarray:
    """A small number for each code point below 128: letters by case, digits, white space and every mark."""
    out = np.zeros(129, dtype=np.uint32)
    for c in range(128):
        ch = chr(c)
        out[c] = 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch == " " else 5 if ch in "\n\r\v\f" else 6 if ch == "\t" else 7 + c
    out[128] = 0
    return out


KIND = _kind_table()
# letters beyond ASCII count by case, all else there as one kind
WIDE = 300


def content_slots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigram at each position but the last two, and the hashed five-gram of kinds at each but the last four."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = KIND[np.minimum(code, 128)]
    kind = np.where((code > 128) & (code < WIDE), np.where((code >= 0xDF), 1, 2), kind).astype(np.uint32)
    low = code + np.where((code >= 65) & (code <= 90), 32, 0).astype(np.uint32)

    def mixed(parts):
        h = np.zeros(max(len(parts[-1]), 0), dtype=np.uint32)
        for p in parts:
            h = (h ^ p) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return h

    three = mixed([low[:-2], low[1:-1], low[2:]]) % GRAMS if len(low) > 2 else np.zeros(0, dtype=np.uint32)
    n = len(kind) - 4
    five = mixed([kind[k : n + k] for k in range(5)]) % KINDS if n > 0 else np.zeros(0, dtype=np.uint32)
    return three, five


def dense(text: str) -> np.ndarray:
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n = max(len(words), 1)
    again = sum(map(operator.eq, words, words[1:])) / n
    return np.array([1.0, 3 * again, 2 * len(set(words)) / n, len(set(lines)) / max(len(lines), 1), min(len(text) / n, 40.0) / 10.0, min(np.log1p(len(words)), 12.0) / 10.0, min(np.log1p(text.count("\n")), 12.0) / 5.0, min(np.log1p(len(text) / (text.count("\n") + 1)), 12.0) / 5.0])


WINDOW = 1_000_000


def _slots_by_window(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """content_slots() of the whole text, WINDOW positions at a time, so that memory stays bounded for any text."""
    for at in range(0, len(text), WINDOW):
        three, five = content_slots(text[at : at + WINDOW + 4])
        yield three[:WINDOW], five[:WINDOW]


def content(text: str) -> np.ndarray:
    """The content view: frequencies (scaled) and shares."""
    out = np.zeros(CONTENT)
    for three, five in _slots_by_window(text):
        out[:GRAMS] += np.bincount(three, minlength=GRAMS)
        out[GRAMS : GRAMS + KINDS] += np.bincount(five, minlength=KINDS)
    out[: GRAMS + KINDS] *= SCALE / (len(text) + DAMPING)
    out[GRAMS + KINDS :] = dense(text)
    return out


SCALE = 20.0
#: Added to a text's length, so that the frequencies of short texts stay small.
DAMPING = 100


def metadata(source: str | None, lang: str | None, n_chars: float | None) -> list[int]:
    """The metadata view: slots that are 1."""
    length = -1 if n_chars is None or n_chars != n_chars or n_chars < 0 else int(2 * np.log2(1 + n_chars))
    marks = [f"s:{source}", f"l:{lang}", f"n:{length}"]
    return sorted({zlib.crc32(m.encode("utf-8", "replace")) % META for m in marks})


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's gradient steps. Products with x are made in its own precision, so it is never copied."""
    weight = np.ones(len(y)) / len(y) if weight is None else weight / weight.sum()
    kind = x.dtype

    def across(w: np.ndarray) -> np.ndarray:
        return (x @ w.astype(kind)).astype(np.float64)

    def down(d: np.ndarray) -> np.ndarray:
        return (d.astype(kind) @ x).astype(np.float64)

    w, b = np.zeros(x.shape[1]), 0.0
    pw, pb = w.copy(), b
    # the greatest curvature, by power iteration from the mean
    v, u, top = down(weight), 1.0, 1.0
    for _ in range(30):
        size = float(np.sqrt(v @ v + u * u))
        p = weight * (across(v / size) + u / size)
        v, u = down(p), float(p.sum())
        top = float(np.sqrt(v @ v + u * u))
    rate = 1.0 / (0.25 * 1.1 * top + ridge)
    for k in range(steps):
        m = k / (k + 3.0)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        d = weight * (1 / (1 + np.exp(-np.clip(across(vw) + vb, -30, 30))) - y)
        pw, pb = w, b
        w, b = vw - rate * (down(d) + ridge * vw), vb - rate * d.sum()
    return w, b


def ordered(z: np.ndarray, y: np.ndarray) -> float:
    """How much better than chance scores put good before bad ones: 1 for all pairs, 0 for no more than half of them."""
    order = np.argsort(np.argsort(z, kind="stable"), kind="stable")
    n1, n0 = y.sum(), (1 - y).sum()
    return max(0.0, 2 * float((order[y == 1].sum() - n1 * (n1 - 1) / 2) / max(n1 * n0, 1)) - 1)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(z).max()), 1e-6)
    w, b = logistic((z / scale)[:, None], goal, ridge=1e-4, steps=400)
    return float(w[0] / scale), float(b)


@dataclass
class CoTrained:
    content_w: np.ndarray
    content_b: float
    meta_w: np.ndarray
    meta_b: float
    content_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    mix: tuple[float, float, float]
    threshold: float

    def score(self, text: str, source: str | None, lang: str | None, n_chars: float | None) -> tuple[float, float, float]:
        """(score, content's, metadata's): calibrated probabilities of good quality."""
        z = self.content_b
        if text:
            total = 0.0
            for three, five in _slots_by_window(text):
                total += float(self.content_w[:GRAMS][three].sum() + self.content_w[GRAMS : GRAMS + KINDS][five].sum())
            z += total * SCALE / (len(text) + DAMPING)
        z += float(self.content_w[GRAMS + KINDS :] @ dense(text))
        m = self.meta_b + float(self.meta_w[metadata(source, lang, n_chars)].sum())
        a, b = self.content_cal[0] * z + self.content_cal[1], self.meta_cal[0] * m + self.meta_cal[1]
        c = self.mix[0] * a + self.mix[1] * b + self.mix[2]
        return tuple(1 / (1 + np.exp(-np.clip((c, a, b), -30, 30))))


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, others: Unlabelled, apart: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT, keep_good: float = KEEP_GOOD) -> CoTrained:
    """x, m: the two views of labelled documents; apart: those kept for calibration; others: the unlabelled ones."""
    base = np.flatnonzero(~apart)
    share = y[base].mean()
    trust = [1.0, 1.0]
    taught: list[list[tuple[float, float, np.ndarray]]] = [[], []]  # (pseudo-label, number, mean) of groups of documents, for each view

    def even(y: np.ndarray) -> np.ndarray:
        """Weights by which either label of the labelled documents counts the same."""
        return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def train(view: int):
        mine = (x, m)[view][base]
        extra = taught[view]
        if not extra:
            return logistic(mine, y[base], even(y[base]))
        number = np.array([n for _, n, _ in extra])
        weight = np.concatenate((np.ones(len(base)), 0.5 * trust[1 - view] * number * min(1.0, len(base) / number.sum())))
        weight *= even(np.concatenate((y[base], [q for q, _, _ in extra])))
        return logistic(np.concatenate((mine, np.array([mean for _, _, mean in extra], dtype=mine.dtype))), np.concatenate((y[base], [q for q, _, _ in extra])), weight)

    test = np.flatnonzero(apart)
    for k in range(rounds if others.n else 0):
        models = (train(0), train(1))
        if not k:
            trust = [ordered(v[test] @ w + b, y[test]) for v, (w, b) in zip((x, m), models)]
        for groups, more in zip(taught, others.verdicts(models, confident, share)):
            groups += more
    (cw, cb), (mw, mb) = train(0), train(1)
    z, v = x[test] @ cw + cb, m[test] @ mw + mb
    c_cal, m_cal = platt(z, y[test]), platt(v, y[test])
    a, b = c_cal[0] * z + c_cal[1], m_cal[0] * v + m_cal[1]
    views = np.stack((a, b), axis=1)
    scale = np.maximum(np.abs(views).max(axis=0), 1e-6)
    w, shift = logistic(views / scale, y[test], ridge=1e-4, steps=400)
    mix = (float(w[0] / scale[0]), float(w[1] / scale[1]), float(shift))
    final = 1 / (1 + np.exp(-np.clip(views @ np.array(mix[:2]) + mix[2], -30, 30)))
    good = np.sort(final[y[test] == 1])
    threshold = min(0.5, float(good[int((1 - keep_good) * len(good))])) if len(good) else 0.0
    return CoTrained(cw, float(cb), mw, float(mb), c_cal, m_cal, mix, threshold)


NAMES = ("text", "source", "lang", "n_chars")


def _views(docs: DataFrame) -> DataFrame:
    """(key, y, view vectors as sparse binaries) for documents with the columns key, y and NAMES."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, y, text, source, lang, n_chars in zip(f["key"], f["y"], *(f[c] for c in NAMES)):
                text = text or ""
                v = content(text).astype(np.float32)
                at = np.flatnonzero(v).astype(np.int32)
                out.append((key, y, at.tobytes(), v[at].tobytes(), np.array(metadata(source, lang, n_chars), dtype=np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["key", "y", "at", "value", "meta"])

    return docs.select("key", "y", *NAMES).mapInPandas(run, "key long, y int, at binary, value binary, meta binary")


def _packed(docs: DataFrame) -> DataFrame:
    """The views of documents in few bytes: kind, meta, and which slots of the content view hold what, compressed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, source, lang, n_chars in zip(*(f[c] for c in NAMES)):
                text = text or ""
                v = content(text)
                # the frequencies are counts by one factor
                counts = np.rint(v[: GRAMS + KINDS] * ((len(text) + DAMPING) / SCALE)).astype("<u4")
                held = counts > 0
                body = np.packbits(held).tobytes() + v[GRAMS + KINDS :].astype("<f8").tobytes() + np.array([SCALE / (len(text) + DAMPING)]).astype("<f8").tobytes() + counts[held].tobytes()
                meta = np.array(metadata(source, lang, n_chars), dtype="<u2").tobytes()
                out.append((zlib.crc32(f"{source} {lang}".encode("utf-8", "replace")) % KINDS_APART, meta, zlib.compress(body, 1)))
            yield pd.DataFrame(out, columns=["kind", "meta", "body"])

    return docs.select(*NAMES).mapInPandas(run, "kind int, meta binary, body binary")


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a content view."""
    raw = zlib.decompress(body)
    n = (GRAMS + KINDS) // 8
    at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, n)))
    rest = np.frombuffer(raw, "<f8", DENSE + 1, n)
    return np.concatenate((at, np.arange(GRAMS + KINDS, CONTENT))), np.concatenate((np.frombuffer(raw, "<u4", -1, n + 8 * (DENSE + 1)) * rest[DENSE], rest[:DENSE]))


def _bin(z: float) -> int:
    return int(min(max((z + REACH) / (2 * REACH), 0.0), 1.0 - 1e-9) * BINS)


def _edges(share: float) -> tuple[float, float]:
    """Scores below and above which a view is confident: odds of nine to one, for the commoner label on top of its share."""
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    return -EDGE + min(prior, 0.0), EDGE + max(prior, 0.0)


def _side(z: float, cut: tuple[int, int], edges: tuple[float, float]) -> int | None:
    """The verdict on a document of this score, if it is confident and within the cut."""
    return 0 if z < edges[0] and _bin(z) <= cut[0] else 1 if z > edges[1] and _bin(z) >= cut[1] else None


class Unlabelled:
    """All documents without a label, judged in tasks from a table of their views."""

    def __init__(self, docs: DataFrame, labelled: DataFrame):
        """docs: doc_id and NAMES; labelled: doc_id of those with a label. Rows alike count once, but for those without an id."""
        docs = docs.withColumn("h", F.xxhash64("doc_id"))
        labelled = labelled.distinct()
        # ids are shuffled, and the texts only of documents that the filters can't tell from others or that occur again
        again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
        asked = common.written(labelled.unionByName(again).distinct().select("doc_id", F.xxhash64("doc_id").alias("h")), "asked")
        maybe = F.col("doc_id").isNotNull() & common.bloom(asked, "h", asked.count())
        wanted = common.written(docs.where(maybe).select("doc_id", "h").distinct().join(labelled, "doc_id", "left_anti"), "wanted")
        rest = docs.where(maybe & common.bloom(wanted, "h", wanted.count())).dropDuplicates(["doc_id", *NAMES]).join(wanted.select("doc_id"), "doc_id", "left_semi")
        self.rows = common.written(_packed(docs.where(~maybe).select(*NAMES).unionByName(rest.select(*NAMES))), "unlabelled")
        self.n = self.rows.count()
        self.earlier: list = []  # the models, cuts and edges of each round so far

    def _judged(self, models, schema: str, judge) -> DataFrame:
        """judge(rows of kind, meta slots, content slots and values, and each view's score or None if an earlier round took the document) in each task."""
        shared = self.rows.sparkSession.sparkContext.broadcast((models, self.earlier))  # of fixed size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            common.hold("quality", lambda: None)
            models, earlier = shared.value

            def scores(models, slots, at, value):
                (cw, cb), (mw, mb) = models
                return float(cw[at] @ value) + cb, float(mw[slots].sum()) + mb

            def rows():
                for f in frames:
                    for kind, meta, body in zip(f["kind"], f["meta"], f["body"]):
                        slots = np.frombuffer(meta, "<u2")
                        at, value = _unpacked(body)
                        taken = [False, False]
                        for old, cuts, edges in earlier:
                            z = scores(old, slots, at, value)
                            taken = [t or _side(z[v], cuts[v], edges) is not None for v, t in enumerate(taken)]
                        if not all(taken):
                            z = scores(models, slots, at, value)
                            yield kind, slots, at, value, [None if t else z[v] for v, t in enumerate(taken)]

            yield from judge(rows())

        return self.rows.mapInPandas(run, schema)

    def verdicts(self, models, part: float, share: float) -> list[list[tuple[float, float, np.ndarray]]]:
        """For each view (pseudo-label, number, mean) of the groups that the other view is confident of now and wasn't before.

        These are the documents of lowest and of highest score, part of all in the labels' proportion (share: of good
        ones), of which the view is confident. Documents in the last bin that is needed are all
        taken, and the numbers lowered in proportion to what was wanted.
        """

        edges = _edges(share)

        def count(rows):
            held = np.zeros((2, BINS), dtype=np.int64)
            for *_, z in rows:
                for view in (0, 1):
                    if z[view] is not None:
                        held[view, _bin(z[view])] += 1
            view, at = np.nonzero(held)
            yield pd.DataFrame({"view": view.astype(np.int32), "bin": at.astype(np.int32), "n": held[view, at]})

        held = np.zeros((2, BINS), dtype=np.int64)
        for r in self._judged(models, "view int, bin int, n long", count).groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():  # 2 * BINS rows at most
            held[r.view, r.bin] = r.n
        wanted = [max(1.0, part * self.n * q) for q in (1 - share, share)]
        cuts = [(int(np.searchsorted(np.cumsum(h), wanted[0])), BINS - 1 - int(np.searchsorted(np.cumsum(h[::-1]), wanted[1]))) for h in held]

        def gather(rows):
            sums: dict[tuple[int, int, int], list] = {}
            for kind, slots, at, value, z in rows:
                for view in (0, 1):
                    label = None if z[view] is None else _side(z[view], cuts[view], edges)
                    if label is not None:
                        key = (1 - view, label, int(kind))
                        if key not in sums:
                            sums[key] = [0, np.zeros(META if view == 0 else CONTENT, dtype=np.int64)]
                        sums[key][0] += 1
                        if view == 0:
                            sums[key][1][slots] += 1
                        else:
                            sums[key][1][at] += np.rint(value * UNIT).astype(np.int64)
            yield pd.DataFrame([(*key, n, v.tobytes()) for key, (n, v) in sums.items()], columns=["view", "label", "kind", "n", "total"])

        def add(f: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(t, dtype=np.int64) for t in f["total"])
            return pd.DataFrame({"view": f["view"][:1], "label": f["label"][:1], "kind": f["kind"][:1], "n": [int(f["n"].sum())], "total": [total.tobytes()]})

        schema = "view int, label int, kind int, n long, total binary"
        got = self._judged(models, schema, gather).groupBy("view", "label", "kind").applyInPandas(add, schema).collect()  # 4 * KINDS_APART rows at most
        self.earlier.append((models, cuts, edges))
        out: list[list[tuple[float, float, np.ndarray]]] = [[], []]
        for r in sorted(got, key=lambda r: (r.view, r.label, r.kind)):
            total = np.frombuffer(bytes(r.total), dtype=np.int64).astype(float)
            fewer = min(1.0, wanted[r.label] / sum(x.n for x in got if (x.view, x.label) == (r.view, r.label)))
            out[r.view].append((float(r.label), r.n * fewer, total / r.n / (UNIT if r.view == 0 else 1.0)))
        return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, **settings) -> CoTrained | None:
    """A model, or None if there are fewer than LEAST labelled documents of either quality.

    docs: doc_id and NAMES; labels: doc_id, quality. Labels that are null, or whose document isn't there, teach
    nothing; of several labels of a document the lowest counts.
    """
    docs = docs.select("doc_id", *NAMES)
    dice = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(17)), 11).cast("double") / F.lit(float(1 << 53))
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    n_labels = labels.count()
    known = usable.where(dice < min(1.0, labelled / max(n_labels, 1))).groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").cast("int").alias("y"))
    known = common.written(known, "known")  # about `labelled` rows
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["key"]).select("key", "y", *NAMES)
    # of rows that share an id one counts: the first by its views' bytes
    views = _views(rows).groupBy("key").agg(F.min(F.struct("y", "at", "value", "meta")).alias("v")).select("key", "v.*")
    got = common.written(views, "views").toPandas()
    got = got.sort_values("key", kind="stable").reset_index(drop=True)

    def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, m = np.zeros((len(rows), CONTENT), dtype=np.float32), np.zeros((len(rows), META), dtype=np.float32)
        for k, (at, value, meta) in enumerate(zip(rows["at"], rows["value"], rows["meta"])):
            x[k, np.frombuffer(at, dtype=np.int32)] = np.frombuffer(value, dtype=np.float32)
            m[k, np.frombuffer(meta, dtype=np.int32)] = 1
        return x, m

    y = got["y"].to_numpy(dtype=np.float64)
    if min(y.sum(), (1 - y).sum()) < LEAST:
        return None
    x, m = matrix(got)
    got = None
    common.give_back()
    apart = np.zeros(len(y), dtype=bool)
    for q in (0, 1):
        apart[np.flatnonzero(y == q)[::3]] = True
    model = co_train(x, m, y, Unlabelled(docs, usable.select("doc_id")), apart, **settings)
    del x, m
    common.give_back()
    return model


def scored(docs: DataFrame, model: CoTrained | None, out_col: str = "quality_scores") -> DataFrame:
    """docs, all columns, with a struct (score, p_content, p_meta, kept). Without a model all have score 1 and are kept.

    An existing column of the struct's name is replaced.
    """
    if model is None:
        one = F.lit(1.0)
        return docs.withColumn(out_col, F.struct(one.alias("score"), one.alias("p_content"), one.alias("p_meta"), F.lit(True).alias("kept")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("score double, p_content double, p_meta double, kept boolean")
    def judge(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        common.hold("quality", lambda: None)  # no state of its own, but none of others either
        model = shared.value
        out = [model.score(t or "", s, x, n) for t, s, x, n in zip(text, source, lang, n_chars)]
        f = pd.DataFrame(out, columns=["score", "p_content", "p_meta"], dtype=float)
        f["kept"] = f["score"] >= model.threshold
        return f

    return docs.withColumn(out_col, judge(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("double")))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects. Null and empty texts are judged like any other."""
    out = scored(docs, fit(docs.select("doc_id", *NAMES), labels, **settings), "__quality")
    return out.where("__quality.kept").drop("__quality")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, p_content, p_meta, kept: one row per row of documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", *NAMES)
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return scored(docs, fit(docs, labels)).select("doc_id", "quality_scores.*")
