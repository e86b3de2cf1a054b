"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi.

A word is a run of letters. Its score for a language is the sum, over its letters, of the log-likelihood ratios of the
trigram and the pentagram around each letter, from hashed count tables learned on labelled documents. A word's script
(the range its first letter lies in) narrows the candidates to languages seen with that script in training: all others
score OUT less than any of a word's languages, far more than the two switches that spare them the word; words of a
script that no language has say nothing. Viterbi with a constant penalty for each switch then labels the words, and
neighbouring words of one label form a span.

Scoring works on whole batches of texts with array operations, about WINDOW characters at a time, never cutting a word. Most texts are in one
language, which is recognised exactly: if no stretch of words gains more than one penalty over the best single
language, no path with a switch is better, and the recursion is run for the others only.

Training reads about DOCS_PER_LANG documents of every language, chosen by hash; its tables have a fixed size.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

UNDETERMINED = "und"
#: Bound on the training sample: the expected number of documents for each language.
DOCS_PER_LANG = 1500
SLOTS = 1 << 16
SWITCH = 12.0
OUT = 10_000.0
SMOOTHING = 0.5
#: Characters that are turned into arrays at once.
WINDOW = 400_000

# The Unicode blocks of the scripts told apart, as first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
}

def _tables() -> tuple[np.ndarray, np.ndarray]:
    script = np.zeros(0x110000, dtype=np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            script[lo : hi + 1] = k + 1
    return np.array([chr(c).isalpha() for c in range(0x110000)]), script


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its script's number (0: any other)."""
    return common.hold("letters", _tables)


def lowered(text: str) -> str:
    """Lower case with as many characters as the text has."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: word starts and ends; of its letters: first letter's index of each word, trigram and pentagram slots."""
    letter, _ = _letters()
    code = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.zeros(len(code) + 4, dtype=np.uint32)
    is_letter = letter[code]
    c[2:-2] = np.where(is_letter, code, 0)
    edge = np.diff(np.concatenate(([0], is_letter.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(is_letter) + 2
    a, b, m, d, e = c[at - 2], c[at - 1], c[at], c[at + 1], c[at + 2]
    a = np.where(b == 0, 0, a)
    e = np.where(d == 0, 0, e)
    three = b * np.uint32(0x9E3779B1) + m * np.uint32(0x85EBCA77) + d * np.uint32(0xC2B2AE3D)
    three ^= three >> np.uint32(15)
    three *= np.uint32(0x27D4EB2F)
    five = (three + a) * np.uint32(0x165667B1) + e * np.uint32(0x9E3779B1)
    five ^= five >> np.uint32(13)
    five *= np.uint32(0x85EBCA77)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
    return starts, ends, firsts, three >> np.uint32(16), five >> np.uint32(16)


#: Characters that are no letters, whatever else.
_gap = re.compile(r"[\W\d_]")


def windows(text: str) -> list[tuple[int, str]]:
    """The text in stretches of about WINDOW characters that end between words; a longer word is within one stretch."""
    out, at = [], 0
    while len(text) - at > WINDOW:
        cut = text.rfind(" ", at + WINDOW // 2, at + WINDOW) + 1
        if not cut:
            gap = _gap.search(text, at + WINDOW // 2)
            cut = gap.end() if gap else len(text)
        out.append((at, text[at:cut]))
        at = cut
    out.append((at, text[at:]))
    return out


class SpanModel:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        """counts: (2, SLOTS, langs), of trigrams and pentagrams; scripts: (scripts + 1, langs), words seen."""
        self.langs, self.switch = langs, switch
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * SLOTS)
        score = np.log(share)
        score -= score.mean(axis=2, keepdims=True) if langs else 0
        self.score = score.astype(np.float32) * 0.5  # the two overlap, so each counts half
        seen = scripts > 0.001 * scripts.sum(axis=0, keepdims=True)
        self.silent = ~seen.any(axis=1)
        self.candidate = seen | self.silent[:, None]

    def words(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: word starts, ends, scores (words, langs)."""
        _, script = _letters()
        joined = " ".join(texts)
        starts, ends, firsts, three, five = word_grams(joined)
        if len(starts):
            per = self.score[0][three] + self.score[1][five]
            w = np.add.reduceat(per, firsts, axis=0)
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[starts]
            kind = script[code]
            if not self.candidate[kind].all():
                w = np.where(self.candidate[kind], w, w.min(axis=1, keepdims=True) - np.float32(OUT))
            w[self.silent[kind]] = 0.0
        else:
            w = np.zeros((0, len(self.langs)), dtype=np.float32)
        out, at = [], 0
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = np.searchsorted(starts, begins)
        for k, at in enumerate(begins[:-1]):
            s = slice(cuts[k], cuts[k + 1])
            out.append((starts[s] - at, ends[s] - at, w[s]))
        return out

    def path(self, w: np.ndarray) -> np.ndarray:
        """The best sequence of languages (their numbers) for word scores."""
        n, m = w.shape
        total = w.sum(axis=0)
        best = int(total.argmax())
        if m == 1:
            return np.zeros(n, dtype=np.int64)
        gain = np.delete(w, best, axis=1).max(axis=1) - w[:, best]
        run = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
        if (run - np.minimum.accumulate(run)).max() <= self.switch:
            return np.full(n, best)
        states = range(m)
        value, back = [0.0] * m, []
        for row in w.tolist():
            top = max(value)
            source = value.index(top)
            floor = top - self.switch
            came = [k if value[k] >= floor else source for k in states]
            value = [(value[k] if value[k] >= floor else floor) + row[k] for k in states]
            back.append(came)
        k = value.index(max(value))
        out = np.empty(n, dtype=np.int64)
        for t in range(n - 1, -1, -1):
            out[t] = k
            k = back[t][k]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """For each text its spans (start, end, lang); none where there is no letter or no language was learned."""
        out: list[list[tuple[int, int, str]]] = []
        batch: list[str] = []
        size = 0

        def flush():
            nonlocal batch, size
            for s, e, w in self.words(batch) if batch else []:
                out.append(self._spans(s, e, w))
            batch, size = [], 0

        for t in texts:
            t = t or ""
            if len(t) > WINDOW:
                flush()
                parts = [(at, *self.words([part])[0]) for at, part in windows(t)]
                out.append(self._spans(*(np.concatenate(x) for x in zip(*[(s + at, e + at, w) for at, s, e, w in parts]))))
                continue
            if size + len(t) > WINDOW:
                flush()
            batch.append(t)
            size += len(t) + 1
        flush()
        return out

    def _spans(self, starts: np.ndarray, ends: np.ndarray, w: np.ndarray) -> list[tuple[int, int, str]]:
        if not len(starts) or not self.langs:
            return []
        path = self.path(w)
        first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        last = np.concatenate((first[1:] - 1, [len(path) - 1]))
        return [(int(starts[a]), int(ends[b]), self.langs[path[a]]) for a, b in zip(first, last)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """For each text: the language with most of the characters in spans, its share of these, number of spans."""
        out = []
        for spans in self.spans(texts):
            size: dict[str, int] = {}
            for s, e, lang in spans:
                size[lang] = size.get(lang, 0) + e - s
            if not size:
                out.append((UNDETERMINED, 0.0, 0))
                continue
            best = min(size, key=lambda k: (-size[k], k))
            out.append((best, size[best] / sum(size.values()), len(spans)))
        return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG, switch: float = SWITCH) -> SpanModel:
    """A model from documents with a language; null texts and null languages teach nothing."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("key"))
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(n)
    if not langs:
        return SpanModel([], np.zeros((2, SLOTS, 0)), np.zeros((len(SCRIPTS) + 1, 0)), switch)
    number = {x: k for k, x in enumerate(langs)}
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, docs_per_lang / n[x]))) for x in langs])
    dice = F.shiftrightunsigned(F.xxhash64("key"), 11).cast("double") / F.lit(float(1 << 53))
    sample = rows.where(dice < share).select("lang", "text")

    def count(frames):
        letters, script = _letters()
        held = np.zeros((2, SLOTS, len(langs)), dtype=np.int64)
        seen = np.zeros((len(SCRIPTS) + 1, len(langs)), dtype=np.int64)
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                k = number[lang]
                for _, part in windows(text):
                    starts, _, _, three, five = word_grams(part)
                    held[0, :, k] += np.bincount(three, minlength=SLOTS)
                    held[1, :, k] += np.bincount(five, minlength=SLOTS)
                    if len(starts):
                        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[starts]
                        seen[:, k] += np.bincount(script[code], minlength=len(SCRIPTS) + 1)
        for kind in (0, 1):
            slot, k = np.nonzero(held[kind])
            yield pd.DataFrame({"kind": np.full(len(slot), kind, dtype=np.int32), "slot": slot.astype(np.int32), "k": k.astype(np.int32), "n": held[kind][slot, k]})
        slot, k = np.nonzero(seen)
        yield pd.DataFrame({"kind": np.full(len(slot), 2, dtype=np.int32), "slot": slot.astype(np.int32), "k": k.astype(np.int32), "n": seen[slot, k]})

    sums = sample.mapInPandas(count, "kind int, slot int, k int, n long").groupBy("kind", "slot", "k").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # at most (2 * SLOTS + scripts) rows a language
    counts = np.zeros((2, SLOTS, len(langs)))
    scripts = np.zeros((len(SCRIPTS) + 1, len(langs)))
    grams, seen = got[got["kind"] < 2], got[got["kind"] == 2]
    counts[grams["kind"], grams["slot"], grams["k"]] = grams["n"]
    scripts[seen["slot"], seen["k"]] = seen["n"]
    return SpanModel(langs, counts, scripts, switch)


def predictor(spark: SparkSession, model: SpanModel):
    """A function of a text column that gives (lang_pred, score, n_spans). The model's size depends on the number of languages only."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_spans long")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score", "n_spans"])

    return predict


def label_spans(docs: DataFrame, model: SpanModel, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs, all columns, with array<struct<start, end, lang>>: the spans of the text in characters, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:long,end:long,lang:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "lang": x} for s, e, x in t] for t in shared.value.spans(texts.tolist())])

    return docs.withColumn(out_col, spans(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the remainder of the id's checksum is 0; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score (share of the letters' spans), n_spans.

    Learns from rows that are not held out. A text that is null or has no letter is `und` with score 0, as is every
    text if nothing could be learned; equal shares go to the smaller language name. Empty input gives no rows.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col, id_col, **settings)
    got = predictor(docs.sparkSession, model)(F.col(text_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), got.alias("__p")).select(id_col, "held_out", "__p.lang_pred", "__p.score", "__p.n_spans")


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
