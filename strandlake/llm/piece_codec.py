"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

A segmentation of a string is the one that BPE merging yields exactly if every two neighbouring pieces are compatible,
that is, if merging the concatenation of just these two yields them again. So every prefix of a string has one last
piece, and the table of last pieces is filled from left to right: an Aho-Corasick automaton reports the pieces that
end at a position, and the one that is compatible with the last piece of the prefix before it is stored. The ids are
then recovered backwards. The table costs time linear in the text and needs no merge queue.

No piece holds a space mark after another character, so texts fall apart into words that begin with a mark,
and then into parts between two characters that stand side by side in no piece. Words and parts are encoded once per
worker process and kept in bounded tables. Pieces of marks only all rank last and equal, so
runs of marks are cut from the left into the longest such pieces. Characters in no piece become their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import string
from array import array

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import common

MARK = "▁"
NEVER = float("-inf")
START = -1
PUNCTUATION = string.punctuation
#: Words, and parts of words, in a worker's tables before these start anew; what was used since the time before stays.
KEPT_WORDS, KEPT_PARTS = 100_000, 100_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> dict:
    """What encoding and decoding need of a model file: pieces with scores, byte ids, unknown id.

    Raises on a model in which pieces of marks only don't all rank last and equal, or that has marks within pieces.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
    names = [sp.id_to_piece(i) for i in plain]
    marks = {sp.get_score(i) for i, p in zip(plain, names) if not p.strip(MARK)}
    if len(marks) != 1 or any(sp.get_score(i) <= min(marks) for i, p in zip(plain, names) if p.strip(MARK)) or any(MARK in p[1:] for p in names if p.strip(MARK)):
        raise ValueError(f"{path}: marks are ranked or placed otherwise than this codec takes for given")
    with open(path, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    return {
        "key": key,
        "pieces": {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain},
        "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
        "other": {i: "" if sp.is_control(i) else " ⁇ " for i in range(n) if sp.is_control(i) or sp.is_unknown(i)},
    }


class PieceCodec:
    def __init__(self, vocabulary: dict):
        self.pieces = vocabulary["pieces"]
        self.byte_ids = vocabulary["bytes"]
        self.scores = {p: x for p, (_, x) in self.pieces.items()}
        self.text_of = {i: p for p, (i, _) in self.pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.other = vocabulary["other"]
        self.automaton = ahocorasick.Automaton()
        for p, (i, _) in self.pieces.items():
            if p.strip(MARK) or p == MARK:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        runs = {len(p): i for p, (i, _) in self.pieces.items() if not p.strip(MARK)}
        self.longest_run = max(runs)
        self.runs = runs
        self.after: list[dict[int, bool]] = [{} for _ in range(1 + max(self.text_of))]
        self.length = [len(self.text_of.get(i, "")) for i in range(1 + max(self.text_of))]
        self.alphabet = {c for p in self.pieces for c in p}
        # ids as 32-bit numbers
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        size = 1 + max(*self.text_of, *self.byte_ids)
        # every id as a decimal number and a comma, filled up with zero bytes
        self.numbers = np.array([f"{i},".encode() for i in range(size)])
        # what an id stands for by itself: a piece, or a byte of ASCII
        ascii_ = {i: chr(b) for i, b in self.byte_of.items() if b < 128}
        self.spelled = [self.text_of[i].replace(MARK, " ") if i in self.text_of else ascii_.get(i, "") for i in range(size)]
        self.odd = np.array([i not in self.text_of and i not in ascii_ for i in range(size)])
        self.lone = array("i", [runs[1]]).tobytes()
        self.bigrams = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}

    # --- compatibility of pieces
    def _merged(self, text: str) -> list[str]:
        """BPE merging from single characters: the best-scored pair first, the leftmost among equals."""
        score, parts = self.scores.get, list(text)
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def _test(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a; a is START where b comes first."""
        x, y = "" if a == START else self.text_of[a], self.text_of[b]
        out = self.after[b][a] = self._merged(x + y) == ([x, y] if x else [y])
        return out

    # --- encoding
    def _segment(self, text: str) -> list[int]:
        """Ids of a string of the pieces' characters."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = START
        after = self.after
        for end, (i, k) in self.automaton.iter(text):
            if last[end + 1] is None:
                a = last[end + 1 - k]
                ok = after[i].get(a)
                if ok or ok is None and self._test(a, i):
                    last[end + 1] = i
        out, end, length = [], len(text), self.length
        while end:
            i = last[end]
            out.append(i)
            end -= length[i]
        out.reverse()
        return out

    def _part(self, part: str) -> bytes:
        """The ids of a string across whose ends no piece reaches, kept if it is short."""
        out = self.parts.get(part) or self.old_parts.get(part)
        if out is None:
            # else it is one character that is in no piece
            out = array("i", self._segment(part) if self.alphabet.issuperset(part) else [self.byte_ids[b] for b in part.encode("utf-8")]).tobytes()
        if len(part) <= 64:
            if len(self.parts) >= KEPT_PARTS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = out
        return out

    def word(self, word: str) -> bytes:
        """The ids of a word with the mark before it, kept if it is short."""
        out = self.old_words.get(word)
        if out is None:
            if word.isalpha() and self.alphabet.issuperset(word):
                out = array("i", self._segment(MARK + word)).tobytes()
            else:
                out = self._cut(word)
        if len(word) <= 64:
            if len(self.words) >= KEPT_WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = out
        return out

    def _cut(self, word: str) -> bytes:
        """As word(), for words of more than letters: by their parts."""
        bigrams = self.bigrams
        core = word.rstrip(PUNCTUATION)
        n = len(core)
        if 0 < n < len(word) and word[n - 1 : n + 1] not in bigrams:  # no piece reaches across this, so the core is a word of its own
            head = self.words.get(core) or self.word(core)
            tail = word[n:]
            cuts = [k for k in range(1, len(tail)) if tail[k - 1 : k + 1] not in bigrams]
        else:
            head, tail = None, MARK + word
            cuts = [k for k in range(1, len(tail)) if tail[k - 1 : k + 1] not in bigrams]
        return (head or b"") + b"".join([self._part(tail[a:b]) for a, b in zip([0, *cuts], [*cuts, len(tail)])])

    def _run(self, n: int) -> bytes:
        out = []
        while n > 0:
            k = min(n, self.longest_run)
            while k not in self.runs:
                k -= 1
            out.append(self.runs[k])
            n -= k
        return array("i", out).tobytes()

    def _words(self, text: str) -> list[bytes]:
        """What word() gives, for the words and runs of marks of a text in order."""
        words, word = self.words.get, self.word
        split = text.replace(MARK, " ").split(" ")
        if "" not in split:
            return [words(w) or word(w) for w in split]
        out, marks, lone = [], 0, self.lone
        for k, w in enumerate(split):
            marks += 1
            if not w and k + 1 < len(split):
                continue
            if w:
                found = words(w) or word(w)
                if marks > 1:
                    # the last mark belongs to the run before if the word didn't take it
                    if found.startswith(lone):
                        found = found[4:]
                        marks += 1
                    out.append(self._run(marks - 1))
                out.append(found)
            else:
                out.append(self._run(marks))
            marks = 0
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; an array takes a tenth of a list's memory."""
        return np.frombuffer(b"".join(self._words(text)) if text else b"", dtype=np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD each, the mark that encoding puts first is taken off."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        listed, spelled = ids.tolist(), self.spelled
        odd = np.flatnonzero(self.odd[ids])
        if len(odd):  # runs of bytes beyond ASCII, and of ids that are no text
            out, at = [], 0
            for run in np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1):
                out += map(spelled.__getitem__, listed[at : run[0]])
                at = int(run[-1]) + 1
                out.append(self._odd(listed[run[0] : at]))
            back = "".join([*out, *map(spelled.__getitem__, listed[at:])])
        else:
            back = "".join(map(spelled.__getitem__, listed))
        return back[1:] if listed[0] in self.text_of and back.startswith(" ") else back

    def _odd(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            while raw:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[:size]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("\ufffd")
                    size = 1
                del raw[:size]
            if i is not None:
                out.append(self.other[i])
        return "".join(out)

    def whole(self, text: str) -> tuple[np.ndarray, int, str, str]:
        """Ids, their number, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from the ids."""
        ids = self.encode(text)
        joined = self.numbers[ids].tobytes().translate(None, b"\0")[:-1]
        back = self.decode(ids).encode("utf-8", "surrogatepass")
        return ids, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the text decoded from the ids."""
        return self.whole(text)[1:]


def _codec(shared) -> PieceCodec:
    """The worker process's codec."""
    vocabulary = shared.value
    return common.hold(f"codec {vocabulary['key']}", lambda: PieceCodec(vocabulary))


def _vocabulary(spark: SparkSession, path: str | None):
    """Broadcast: a vocabulary's size is that of its model file, whatever the corpus."""
    return spark.sparkContext.broadcast(load_vocabulary(path or tokenizer_path()))


def encoded(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs, all columns, with the ids of the text as array<int>; null and empty text have no ids. An existing column of that name is replaced."""
    shared = _vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return texts.map(lambda t: codec.encode(t or ""))

    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decoded(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of its ids; null ids give an empty text. Raises on ids that the vocabulary doesn't have."""
    shared = _vocabulary(df.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = _codec(shared)
        return ids.map(lambda x: codec.decode(x) if x is not None else "")

    return df.withColumn(text_col, text(F.col(ids_col)))


def digest(spark: SparkSession, path: str | None = None):
    """A function of a text column that gives (n_tokens, ids_sha256, decoded_sha256), computed where the text is encoded."""
    shared = _vocabulary(spark, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(shared)
        return pd.DataFrame([codec.digests(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def tokenised(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs, all columns, with ids (array<int>), n_tokens, ids_sha256 and decoded_sha256 of the text, in one pass.

    Null text counts as empty; existing columns of these names are replaced.
    """
    shared = _vocabulary(docs.sparkSession, path)

    @F.pandas_udf("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(shared)
        return pd.DataFrame([codec.whole(t or "") for t in texts], columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.withColumn("__tokens", run(F.col(text_col)))
    return out.withColumns({c: F.col(f"__tokens.{c}") for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")}).drop("__tokens")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty; empty input gives no rows."""
    out: Column = digest(docs.sparkSession, path)(F.col(text_col))
    return docs.select(F.col(id_col), out.alias("__d")).select(id_col, "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(common.table(spark, sf_dir, "documents"))
