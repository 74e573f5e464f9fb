"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

The trees are grown here, by histograms, with logistic loss.  A feature may carry a monotonic constraint: with +1 the
score never falls as the feature rises, with -1 it never rises.  Every split obeys them: it is dropped if its two
leaves stand in the wrong order, and the midpoint of the leaves bounds what either subtree may return.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, bound_batches, column, texts

#: At most so many labelled rows are fitted; they are taken by hash of the id, so reruns agree.
SAMPLE_ROWS = 20_000
#: Feature and its monotonic constraint (0: none).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "exclaim_per_word": -1, "upper_share": -1, "digit_share": 0, "stop_per_word": 0, "short_line_share": 0,
}
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def repeat_words(words: list[bytes]) -> int:
    """Word positions that lie in a 3-word window found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    k = len(number)
    if k < 2_000_000:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # too many words for one product: number the pairs first
        _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base figures of a text (null: none of anything), and the features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(raw.count(c) for c in _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    w, c, m = max(n, 1), max(len(raw), 1), max(len(lines), 1)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    features = [
        float(np.log1p(n)), word_chars / w, symbols / w, dup_lines / m, repeats / w, len(set(words)) / w,
        raw.count(b"!") / w, upper / c, digits / c, raw.count(b".") / w, sum(len(x) < 30 for x in lines) / m,
    ]
    return [n, word_chars, symbols, dup_lines, repeats], features


@dataclass
class Trees:
    """Flat node arrays: feature (-1: leaf), threshold, left child (the right one follows), value; roots starts each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows go down one tree at a time, a level a step."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                at = node[inner]
                node[inner] = self.left[at] + (x[rows[inner], self.feature[at]] > self.threshold[at])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, leaf: float = 5.0, lam: float = 1.0) -> Trees:
    """Boosted trees by logistic loss.  One class only, or no rows: a constant."""
    n = len(y)
    p = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(p / (1 - p)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        margin = np.full(n, base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            roots.append(len(feature))
            feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
            todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
            while todo:
                node, rows, level, low, high = todo.pop()
                sg, sh = g[rows].sum(), h[rows].sum()
                value[node] = rate * float(np.clip(-sg / (sh + lam), low, high))
                best = (1e-6, None)
                if level < depth:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, j]
                        lg = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                        lh = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                        rg, rh = sg - lg, sh - lh
                        lv, rv = np.clip(-lg / (lh + lam), low, high), np.clip(-rg / (rh + lam), low, high)
                        gain = lg**2 / (lh + lam) + rg**2 / (rh + lam) - sg**2 / (sh + lam)
                        gain[(lh < leaf / 4) | (rh < leaf / 4) | (constraints[j] * (rv - lv) < 0)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], (j, k, lv[k], rv[k]))
                if best[1] is None:
                    margin[rows] += value[node]
                    continue
                j, k, lv, rv = best[1]
                feature[node], threshold[node], left[node] = j, float(cuts[j][k]), len(feature)
                mid = (lv + rv) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(constraints[j], ((low, high),) * 2)
                goes = binned[rows, j] <= k
                for part, bound in ((rows[goes], bounds[0]), (rows[~goes], bounds[1])):
                    todo.append((len(feature), part, level + 1, *bound))
                    feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
    return Trees(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(value, float), np.array(roots, np.int64), base)


def sample_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label) of about ``rows`` labelled documents at most, by hash of the id; ids with more labels give their largest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return known


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on the bounded sample: only its feature rows reach the driver."""
    chosen = F.broadcast(sample_labels(labels, label, rows))
    joined = docs.select("doc_id", "text").join(chosen, "doc_id")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([column(batch, "doc_id"), column(batch, "_label"), pa.array([statistics(t)[1] for t in texts(batch)], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

        return f

    got = arrow_map(joined, make, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, model: Trees, threshold: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """doc_id, base statistics, base_failed, kept and score for every document.

    Null and empty texts have no words and so fail the base rules.  A null doc_id is kept as a row.  Repeated rows and
    ties are scored each on its own.  Other columns of ``docs`` are not read.
    """
    bound_batches(docs.sparkSession)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [statistics(t) for t in texts(batch)]
            base = np.array([b for b, _ in both], np.int64)
            score = model.score(np.array([x for _, x in both], float))
            failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeat * base[:, 0])
            cols = [column(batch, "doc_id"), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            return pa.record_batch(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

        return f

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id long, {BASE_SCHEMA}, base_failed boolean, kept boolean, score double")
