"""Text quality statistics, and which documents are not running text.

Statistics are taken of every whole text. Labelling rules that decide only clear
cases give weak labels; gradient-boosted trees are trained on a bounded sample
of them and on one half of the documents labelled by hand, and their score
becomes a probability by a logistic curve fitted to the other half. The trees
then score every document.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.keys import uniform_key
from cellframe.runtime import Scratch

#: Weakly labelled rows of each class that the trees are trained on at most; drawn by the hash of doc_id.
TRAIN_ROWS = 3000
HOLDOUT = Path(__file__).with_name("quality_holdout.json")
NAMED = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
FEATURES = (*NAMED, "sentences", "digits", "upper", "same_shape", "same_lines", "distinct", "odd_words", "separators", "sentence_length", "cjk", "high_latin", "long_tokens", "line_words", "top_word", "letters", "short_lines", "single_letters", "packed", "brackets", "listed_lines", "bare_starts", "same_sentences")

CJK = r"぀-ヿ㐀-鿿豈-﫿가-힯"
MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
WORDS = re.compile(rf"[{CJK}]|[^\W\d_{CJK}]+")
WORDS_ASCII, WORDS_LATIN = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")
CJK_CHAR = re.compile(rf"[{CJK}]")
STOPS = re.compile(r"[.!?。！？]+")
ODD = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}|\b[bcdfghjklmnpqrstvwxz]{3,}\b")
SHAPE_WORD = re.compile(r"[^\W\d_]+(?:[ \t]+[^\W\d_]+)*")
SHAPE_NUMBER = re.compile(r"\d+")
MARKER = re.compile(r"[ \t]*[(\[\-*•#|\d]")
BULLET = re.compile(r"[ \t]*(?:[-*•–]|\([a-z]{1,4}\)|\d{1,3}[.)])[ \t]+(?=[a-zß-ÿ])")
CLOSERS = " \t\r\"'”’»」』)]）"
END = frozenset(".!?。！？")
PAUSE = END | frozenset(":：;；,，、…")
# Kinds of characters: letter, upper Latin, other Latin-1 letter, digit, separator, other punctuation of prose, symbol, symbol of Latin-1, CJK.
LETTER, UPPER, HIGH, DIGIT, SEPARATOR, PROSE, SYMBOL, HIGH_SYMBOL, ASIAN, SPACE = range(10)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point up to 0xFFFF."""
    kind = np.empty(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            k = SPACE
        elif c in ",;/|":
            k = SEPARATOR
        elif c in ".:!?()'\"-。、，；：！？（）「」":
            k = PROSE
        elif CJK_CHAR.match(c):
            k = ASIAN
        elif c.isalpha():
            k = UPPER if "A" <= c <= "Z" else HIGH if 0x80 <= i <= 0xFF else LETTER
        elif c.isdecimal():
            k = DIGIT
        elif unicodedata.category(c) in ("Cf", "Mn", "Mc"):  # marks and characters without width
            k = PROSE
        else:
            k = HIGH_SYMBOL if 0x80 <= i <= 0xFF or i == 0xFFFD else SYMBOL
        kind[i] = k
    return kind


def measures(text: str, common: frozenset[str], common_cjk) -> list[float]:
    """The features of a text that isn't blank, in the order of FEATURES."""
    text = MARKUP.sub(" ", text) if "<" in text else text
    flat = " ".join(text.split())
    codes = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32)
    kinds = _kinds()[np.minimum(codes, 0xFFFF)]
    kinds[codes > 0xFFFF] = SYMBOL
    held = np.bincount(kinds, minlength=10).tolist()
    n, cjk = max(1, len(flat)), held[ASIAN]
    low = flat.lower()
    found = (WORDS if cjk else WORDS_ASCII if flat.isascii() else WORDS_LATIN).findall(low)
    count = max(1, len(found))
    latin = max(1, count - cjk)
    known = sum(map(common.__contains__, found))
    if cjk and common_cjk:
        known += sum(map(len, common_cjk.findall(flat)))
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [text]
    last = [x.rstrip(CLOSERS)[-1:] for x in lines]
    marked = [bool(MARKER.match(x)) for x in lines]
    shapes = [x for x in SHAPE_NUMBER.sub("9", SHAPE_WORD.sub("a", text)).replace(" ", "").split("\n") if x and not x.isspace()] or [""]
    other = np.concatenate([[0], np.cumsum((kinds >= DIGIT) & (kinds <= HIGH_SYMBOL))])
    gap = np.concatenate([[0], np.cumsum(kinds == SPACE)])
    good, parts, stop = 0, [], 0
    for m in [*STOPS.finditer(flat), None]:
        start, stop = stop, m.end() if m else len(flat)
        if stop <= start + 1:
            continue
        size, gaps = stop - start, int(gap[stop] - gap[start + 1])
        asian = cjk > 0 and gaps < size / 15
        if m:
            parts.append(flat[start : m.start()].strip())
        wide = 80 < gaps <= 300 and size >= 4.8 * gaps and 0.2 < sum(map(common.__contains__, low[start:stop].split())) / gaps < 0.7  # text without stops, and no string of short words
        if (wide or m and (6 <= size <= 300 if asian else 3 <= gaps <= 80)) and other[stop] - other[start] <= (0.4 if asian else 0.25) * size:
            good += size
    letters = sum(map(len, found))
    counts = Counter(found)
    body = flat.encode("utf-8", "replace")
    return [
        float(len(found)),
        letters / count,
        (held[SYMBOL] + held[HIGH_SYMBOL]) / n,
        sum(x in PAUSE for x in last) / len(lines),
        known / count,
        good / n,
        held[DIGIT] / n,
        held[UPPER] / n,
        1 - len(set(shapes)) / len(shapes),
        1 - len(set(lines)) / len(lines),
        len(counts) / math.sqrt(count),
        0.0 if cjk > 0.3 * n else len(ODD.findall(low)) / latin,
        (held[SEPARATOR] + text.count("\t")) / count,
        math.log1p(count / len(parts) if parts else count),
        cjk / n,
        (held[HIGH] + held[HIGH_SYMBOL]) / n,
        0.0 if cjk > 0.1 * n else sum(x for x in map(len, flat.split(" ")) if x > 25) / n,
        math.log1p(count / len(lines)),
        max(counts.values(), default=0) / count,
        letters / n,
        sum(len(x) < 25 for x in lines) / len(lines),
        sum(v for w, v in counts.items() if len(w) == 1 and w.isascii()) / latin,
        len(zlib.compress(body, 1)) / max(1, len(body)),
        flat.count("(") / count,
        sum(m and x not in END for m, x in zip(marked, last)) / len(lines),
        sum(bool(BULLET.match(y)) or x in END and y.lstrip()[:1].islower() for x, y in zip(["", *last], lines)) / len(lines),
        1 - len(set(parts)) / len(parts) if len(parts) > 3 else 0.0,
    ]


def weak_label(x: dict[str, float]) -> int:
    """1 for clear junk, 0 for clear prose, -1 if the rules don't say."""
    asian = x["cjk"] > 0.3
    if x["words"] < 4 or x["letters"] < 0.45 and not asian or x["digits"] > 0.3 or x["symbol_ratio"] > 0.12 or x["same_lines"] > 0.6 or x["same_sentences"] > 0.6:
        return 1
    if x["long_tokens"] > 0.4 or x["high_latin"] > 0.25 or x["common_words"] > 0.85 or x["odd_words"] > 0.2 or x["single_letters"] > 0.35 and not asian or x["listed_lines"] > 0.8 or x["bare_starts"] > 0.6:
        return 1
    if x["sentences"] < 0.12 and (x["same_shape"] > 0.3 or x["separators"] > 0.3 or x["short_lines"] > 0.5):
        return 1
    if x["sentences"] > 0.45 and x["odd_words"] < 0.1 and x["listed_lines"] < 0.25 and (x["common_words"] > 0.2 or asian or x["separators"] < 0.12) and x["same_lines"] < 0.3 and x["bare_starts"] < 0.2 and x["same_sentences"] < 0.3:
        return 0
    return -1


def _measured(words: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frozenset(w.lower() for _, w in words)
        asian = sorted({w for _, w in words if CJK_CHAR.search(w)}, key=lambda w: (-len(w), w))
        common_cjk = re.compile("|".join(map(re.escape, asian))) if asian else None
        common -= frozenset(asian)
        for batch in batches:
            rows, labels = [], []
            for text in batch.column(1):
                text = text.as_py()
                if not text or text.isspace() or not text.strip("\ufeff\u200b\u00a0 \t\r\n\u3000"):
                    rows.append(None)
                    labels.append(None)
                else:
                    rows.append(measures(text, common, common_cjk))
                    labels.append(weak_label(dict(zip(FEATURES, rows[-1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], ["doc_id", "features", "weak"])

    return run


def statistics(documents: DataFrame, common_words: DataFrame, max_words: int = 100_000) -> DataFrame:
    """(doc_id, features, weak): the measures of each whole text; null features and label for null, empty and blank texts.

    `common_words` has lang and word; at most max_words of them are sent to the
    tasks, more raise. Rows that repeat a doc_id are measured each.
    """
    words = [(r.lang, r.word) for r in common_words.select("lang", "word").where("word is not null").limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError(f"more than {max_words} common words")
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return read.mapInArrow(_measured(sorted(set(words), key=str)), "doc_id long, features array<double>, weak int")


class Trees:
    """Gradient-boosted trees of fixed depth for the logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, penalty: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.base, self.trees, self.slope, self.shift = 0.0, [], 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(y), int), [], []
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, -1.0)
                pick, at = np.zeros(width, int), np.full(width, self.bins, int)
                for f in range(x.shape[1]):
                    slot = node * self.bins + binned[:, f]
                    sums = [np.bincount(slot, v, width * self.bins).reshape(width, self.bins).cumsum(1) for v in (g, h)]
                    gl, hl = (s[:, :-1] for s in sums)
                    gt, ht = (s[:, -1:] for s in sums)
                    gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hl < self.least * 0.05) | (ht - hl < self.least * 0.05)] = -1
                    top = gain.argmax(1)
                    value = gain[np.arange(width), top]
                    better = value > best + 1e-12
                    best[better], pick[better], at[better] = value[better], f, top[better]
                feature.append(pick)
                cut.append(np.array([edges[f][a] if b > 0 and a < len(edges[f]) else np.inf for f, a, b in zip(pick, at, best)]))
                node = 2 * node + (x[np.arange(len(y)), pick[node]] > cut[-1][node])
            leaves = 2**self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            self.trees.append((feature, cut, value))
            score += value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for pick, c in zip(feature, cut):
                node = 2 * node + (x[rows, pick[node]] > c[node])
            out += value[node]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Trees:
        """Logistic curve over the score, by damped Newton steps with smoothed targets and a weak prior."""
        if not len(y):
            return self
        s = np.clip(self.score(x), -8, 8)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((t - p) * s).sum() - (a - 1), (t - p).sum() - b])
            hess = np.array([[(w * s * s).sum() + 1, (w * s).sum()], [(w * s).sum(), w.sum() + 1]])
            step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
            a, b = min(max(a + step[0], 0.1), 4.0), min(max(b + step[1], -4.0), 4.0)
        self.slope, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.clip(self.score(x), -8, 8) + self.shift)))


@lru_cache(maxsize=1)
def holdout() -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Features, labels given by reading (1: not running text) and doc_ids of the documents labelled by hand.

    The file names the table that the doc_ids are of. Its features are a cache of
    what measures() gives; remeasured() makes them anew, and a test fails where
    they differ.
    """
    rows = json.loads(HOLDOUT.read_text())["rows"]
    return np.array([r["features"] for r in rows], float), np.array([r["label"] for r in rows], float), [r["doc_id"] for r in rows]


def remeasured(documents: DataFrame, common_words: DataFrame) -> dict[int, list[float]]:
    """The features of the hand-labelled documents by the code at hand, from the table that the file names."""
    ids = holdout()[2]
    return {r.doc_id: [float(f"{v:.7g}") for v in r.features] for r in statistics(documents.where(F.col("doc_id").isin(ids)), common_words).collect()}


def train(measured: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most `rows` weakly labelled rows a class and the even half of the hand-labelled ones, calibrated on the odd half.

    Rows are drawn by a keyed number of doc_id below a share that gives about
    `rows` of them, so that no task sends more than its part. A corpus without
    clear cases is scored by what the hand-labelled rows teach.
    """
    parts, counts = [], dict(measured.where("weak >= 0").groupBy("weak").count().collect())
    drawn = uniform_key(F.col("doc_id"), 8)
    for label in (0, 1):
        share = (1.2 * rows + 100) / max(1, counts.get(label, 0))
        part = measured.where((F.col("weak") == label) & (drawn < share)).select("doc_id", "features").orderBy(drawn, "doc_id", "features").limit(rows).collect()
        parts.append(np.array([r.features for r in part], float).reshape(-1, len(FEATURES)))
    held, labels, _ = holdout()
    y = np.concatenate([np.repeat([0.0, 1.0], [len(p) for p in parts]), labels[::2]])
    return Trees().fit(np.concatenate([*parts, held[::2]]), y).calibrate(held[1::2], labels[1::2])


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.probability(x))], ["doc_id", "features", "probability"])

    return run


def junk_probability(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, features, probability): how likely a text isn't running text; null, empty and blank texts have no row."""
    measured = Scratch(documents.sparkSession, "quality").save(statistics(documents, common_words).where("features is not null"), "measured")
    return measured.mapInArrow(_scored(train(measured)), "doc_id long, features array<double>, probability double")
