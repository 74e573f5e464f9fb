"""Language identification: scripts narrow the candidates, Viterbi over word scores labels the spans of mixed text.

A word's score for a language is the sum over its letters of the log probability of the letter with its neighbours
(hashed trigrams, non-letters count as blanks).  A switch of language between two words costs a penalty, so single odd
words don't break a span.  The document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, texts

#: Bound of the fitted sample: documents of each language, whole texts, taken by hash of the id.
SAMPLE_DOCS = 3_000
BUCKETS = 1 << 16
SWITCH = 9.0
#: Texts of a batch are worked on in groups of about so many characters.
GROUP_CHARS = 1_500_000
# fixed values: first and last code point of the letters of a script
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter; the bit of its script (other letters share the highest bit)."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.where(letter, np.uint32(1 << 31), np.uint32(0))
    for bit, spans in enumerate(SCRIPTS.values()):
        for lo, hi in spans:
            script[lo : hi + 1] = np.where(letter[lo : hi + 1], np.uint32(1 << bit), np.uint32(0))
    return letter, script


class Words:
    """The words of some texts: of each text the first word and the number, of each word letters and scripts, of each letter the trigram."""

    def __init__(self, group: list[str]):
        letter, script = tables()
        cps = np.frombuffer(" ".join([*group, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (cps == 32) | ((cps >= 9) & (cps <= 13))
        is_letter = letter[cps]
        begins = ~blank
        begins[1:] &= blank[:-1]
        starts = np.flatnonzero(begins)
        # texts are told apart by position; lower() may change a length, so it is taken of each text again
        ends = np.cumsum([len(t.lower()) + 1 for t in group])
        self.first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
        self.count = np.diff(np.concatenate([self.first, [len(starts)]]))
        c = np.where(is_letter, cps, np.uint32(32)).astype(np.uint64)
        prev, nxt = np.concatenate([c[:1] * 0 + 32, c[:-1]]), np.concatenate([c[1:], c[:1] * 0 + 32])
        key = (prev * np.uint64(0x9E3779B97F4A7C15)) ^ (c * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (nxt * np.uint64(0x165667B19E3779F9))
        at = np.flatnonzero(is_letter)
        self.key = ((key[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)
        if len(starts):
            self.letters = np.add.reduceat(is_letter, starts, dtype=np.int64)
            self.scripts = np.bitwise_or.reduceat(script[cps], starts)
        else:
            self.letters, self.scripts = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.script_of_letter = script[cps[at]]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Of each word, the sum over its letters of the rows of a table."""
        out = np.zeros((len(self.letters), table.shape[1]))
        has = np.flatnonzero(self.letters)
        if len(has):
            edge = np.concatenate([[0], np.cumsum(self.letters[has])[:-1]])
            out[has] = np.add.reduceat(table[self.key], edge, axis=0)
        return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray

    def word_scores(self, words: Words) -> np.ndarray:
        """Languages that never use a script of the word are out, unless none is left: then the word says nothing."""
        e = words.sums(self.table)
        out = (words.scripts[:, None] & self.scripts[None, :]) == 0
        none = out.all(1)
        e[out & ~none[:, None]] -= 1e3
        e[none] = 0
        return e


def viterbi(e: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word.  All texts step together, longest first, so that those still running come first."""
    label = np.zeros(len(e), np.int8)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    n = int(np.searchsorted(-count, 0))
    if not n:
        return label
    back = np.zeros(e.shape, np.int8)
    stay = np.arange(e.shape[1], dtype=np.int8)
    running = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")
    v = e[first[:n]].copy()
    for t in range(1, count[0]):
        a = running[t]
        old, at = v[:a], first[:a] + t
        best = old.argmax(1)
        top = old[np.arange(a), best][:, None] - switch
        moved = top > old
        back[at] = np.where(moved, best[:, None].astype(np.int8), stay)
        v[:a] = np.where(moved, top, old) + e[at]
    state = v.argmax(1)
    for t in range(count[0] - 1, -1, -1):
        a = running[t]
        at = first[:a] + t
        label[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return label


def identify(group: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, share of the letters it holds, and the spans (first word, last word, language) of each text."""
    words = Words(group)
    e = model.word_scores(words)
    label = viterbi(e, words.first, words.count)
    known = np.where((words.scripts[:, None] & model.scripts[None, :]).any(1), words.letters, 0)
    out = []
    for a, n in zip(words.first.tolist(), words.count.tolist(), strict=True):
        own, weight = label[a : a + n], known[a : a + n]
        letters = int(words.letters[a : a + n].sum())
        if not letters:
            out.append(("und", 0.0, []))
            continue
        by = np.bincount(own, weight, len(model.langs))
        if by.sum() == 0:  # no learned script: the likeliest of all by its letters alone
            by = np.bincount([int(e[a : a + n].sum(0).argmax())], minlength=len(model.langs)).astype(float) * 1e-9
        best = int(by.argmax())
        cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]])
        spans = [(int(i), int(j) - 1, model.langs[own[i]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        out.append((model.langs[best], float(by[best]) / letters, spans))
    return out


def groups(values: list[str | None]):
    """(positions, texts) of about GROUP_CHARS characters each; null texts count as empty."""
    at, some, n = [], [], 0
    for i, t in enumerate(values):
        at.append(i), some.append(t or "")
        n += len(t or "")
        if n >= GROUP_CHARS:
            yield at, some
            at, some, n = [], [], 0
    if at:
        yield at, some


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from text and non-null lang of ``docs``, which must hold training rows only.

    Trigrams are counted on the executors over whole texts of a sample bounded for each language; the driver gets one
    count for each language and hash bucket at most.  No training rows: a model without languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(1, np.uint32))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1_000_000, sample_docs * 1_000_000 // n[x]))) for x in langs])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < share)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            by: dict[str, list[str]] = {}
            for x, t in zip(texts(batch, "lang"), texts(batch), strict=True):
                by.setdefault(x, []).append(t)
            out: list[tuple[str, np.ndarray, np.ndarray]] = []
            for x, own in by.items():
                for _, group in groups(own):
                    words = Words(group)
                    c = np.bincount(words.key, minlength=BUCKETS)
                    k = np.flatnonzero(c)
                    bits = [(BUCKETS + b, int(((words.script_of_letter >> b) & 1).sum())) for b in range(32)]
                    k2 = np.array([b for b, m in bits if m], np.int64)
                    out.append((x, np.concatenate([k, k2]), np.concatenate([c[k], np.array([m for _, m in bits if m], np.int64)])))
            return pa.record_batch(
                [pa.array([x for x, k, _ in out for _ in range(len(k))]), pa.array(np.concatenate([k for _, k, _ in out])), pa.array(np.concatenate([c for *_, c in out]))],
                ["lang", "bucket", "n"],
            )

        return f

    counts = arrow_map(sample.select("lang", "text"), make, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table, scripts = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs), np.uint32)
    for i, x in enumerate(langs):
        own = counts[counts["lang"] == x]
        k, c = own["bucket"].to_numpy(np.int64), own["n"].to_numpy(float)
        letters = k < BUCKETS
        total = c[letters].sum()
        row = np.full(BUCKETS, 0.2)
        row[k[letters]] += c[letters]
        table[:, i] = np.log(row / row.sum())
        for b, m in zip(k[~letters] - BUCKETS, c[~letters], strict=True):
            if m >= 0.005 * total:
                scripts[i] |= np.uint32(1 << int(b))
    table -= table.mean(1, keepdims=True)
    return Model(langs, np.clip(table, -6, 6), scripts)


def language_id(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, lang_pred, score and spans array<struct<first_word, last_word, lang>> for every whole text.

    Null and empty texts, and texts without a letter, are ``und`` with score 0 and no spans; so is every text if the
    model knows no language.  Ties go to the language first by code point.  Null ids and repeated rows keep a row each;
    columns that aren't carried are not read.
    """
    kept = docs.select(*carry)
    text = "text" if "text" in carry else "_text"  # a carried text is not sent twice

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = texts(batch, text)
            out: list = [("und", 0.0, [])] * len(values)
            if model.langs:
                for at, group in groups(values):
                    for i, x in zip(at, identify(group, model), strict=True):
                        out[i] = x
            spans = pa.array([[{"first_word": a, "last_word": b, "lang": x} for a, b, x in s] for *_, s in out], pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string())])))
            return pa.record_batch([*(column(batch, c) for c in carry), pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.float64()), spans], [*carry, "lang_pred", "score", "spans"])

        return f

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double, spans array<struct<first_word:int,last_word:int,lang:string>>"])
    return arrow_map(kept if text == "text" else docs.select(*carry, F.col("text").alias("_text")), make, schema)
