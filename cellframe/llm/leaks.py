"""Test items whose wording stands in corpus documents, by spaced seeds.

Texts become folded words: case, markup, accents, look-alike letters and common
scan faults vanish in the fold. A seed is a fixed mask over neighbouring words:
masks with holes ignore a changed word. Seeds of the items are joined with those
of the corpus; around the hits of a document and an item the item's words are
aligned with the document's, and the share of the item that is found in order,
in stretches, decides.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heappop, heappush
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.operators.skew import heavy_keys, salted_join
from cellframe.runtime import Scratch

MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4))
#: Items of up to four words count where they stand as a whole: the mask of their length is their only seed.
WHOLE = {1: (0,), 2: (0, 1), 3: (0, 1, 2), 4: (0, 1, 2, 3)}
SHORT = max(WHOLE)
ALL_MASKS = (*MASKS, *(m for m in WHOLE.values() if m not in MASKS))
#: Share of an item that must be found: midway between a third (no case) and a half (a case).
SHARE = 5 / 12
#: Weight from which a stretch of found words counts, in words that no other item has: about a sentence with its own names and numbers.
STRETCH = 2.7
#: A stretch of this share of the item's weight counts, too, however light it is.
PART = 0.3
#: Lighter stretches count together if their words weigh on average at least so much of what the item's words do.
OWN = 0.8
#: Share of an item's weight that stands at positions hit by seeds before its wording is compared.
LEAST = 0.2
#: A seed that stands in more items than this is common wording, and is used for items only that have more than a sixteenth of their weight in it.
COMMON = 12
#: Up to so many seeds and words of the items their index goes to the tasks that read the corpus; beyond it seeds are joined by shuffle.
INDEX_ROWS = 1_000_000
#: Bits of the filter that keeps the corpus's other seeds out of that shuffle: 16 MB whatever the tables' size.
FILTER_BITS = 1 << 27

TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
BREAK = re.compile(r"[-\xad\u2010\u2011][ \t\r]*\n\s*(?=\w)|\xad")
REFERENCE = re.compile(r"\(\s?\d{1,4}[a-z]?\s?\)|\[\d{1,5}\]")
# Scripts that are written without spaces: each of their characters is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD, CHARACTER = re.compile(r"[^\W_]+"), re.compile(f"[{UNSPACED}]")
MIXED = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
# Letters of other scripts that look like Latin ones, and characters of no width.
ALIKE = str.maketrans("авсеһіјкмнорѕтухԁԛԝгёοαρνιτυκηεβχγß", "abcehijkmhopstyxdqwreoapvitukhebxys")
NONE = dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)])
# Scan faults: characters that are taken for each other fall together, but no two digits do.
FOLD = str.maketrans("01i|j!58e29faq", "olllllsbczgtog")
PAIRS = (("rn", "m"), ("ll", "h"), ("cl", "d"), ("vv", "w"))


@lru_cache(maxsize=2)
def _table(scan: bool) -> np.ndarray:
    """What the code points up to 0xFFFF become, 0 for nothing: of scan faults, or of look-alikes and characters without width."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for k, v in (FOLD if scan else ALIKE).items():
        table[k] = v
    if not scan:
        table[list(NONE)] = 0
    return table


def _mapped(text: str, table: np.ndarray) -> str:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = table[np.minimum(codes, 0xFFFF)]
    out = np.where(codes > 0xFFFF, codes, low)
    return out[out != 0].tobytes().decode("utf-32-le")


def folded(text: str | None) -> list[str]:
    """The folded words of a text; none for a null or blank one."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = text.lower()
    if not text.isascii():
        text = _mapped(unicodedata.normalize("NFKD", text), _table(False))
    text = REFERENCE.sub(" ", BREAK.sub("", text))
    text = text.translate(FOLD) if text.isascii() else _mapped(text, _table(True))
    for a, b in PAIRS:
        text = text.replace(a, b)
    return (WORD if text.isascii() or not CHARACTER.search(text) else MIXED).findall(text)


def seeds(codes: np.ndarray, masks: tuple = MASKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask the positions and 64-bit hashes of its seeds; code 0 (no item's word) makes no seed."""
    out = []
    for mask in masks:
        k = ALL_MASKS.index(mask)
        n = len(codes) - mask[-1]
        if n <= 0:
            continue
        h = np.full(n, k + 1, np.uint64)
        good = np.ones(n, bool)
        with np.errstate(over="ignore"):
            for o in mask:
                c = codes[o : o + n]
                good &= c != 0
                h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out.append((np.flatnonzero(good), h[good].view(np.int64)))
    return out


def masks_for(lengths) -> tuple:
    """The masks that find items of these numbers of words."""
    return (*MASKS, *(WHOLE[n] for n in sorted(set(lengths)) if n in WHOLE and WHOLE[n] not in MASKS))


def word_code(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) | 1


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for item, words in zip(frame.item_id, frame.words):
            codes = np.array([word_code(w) for w in words], np.uint64)
            for at, h in seeds(codes, MASKS if len(words) > SHORT else (WHOLE[len(words)],)):
                rows += [(item, len(words), int(p), int(x)) for p, x in zip(at, h)]
        yield pd.DataFrame(rows, columns=["item_id", "n", "at", "seed"])


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(5)) & np.uint64(FILTER_BITS - 1)


def _filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds to the bytes of the filter that they set."""
    for batch in batches:
        slot = np.unique(_slot(batch.column(0).to_numpy(zero_copy_only=False)))
        byte, first = np.unique(slot >> np.uint64(3), return_index=True)
        if len(byte):
            bits = np.bitwise_or.reduceat(np.left_shift(1, slot & np.uint64(7)).astype(np.uint8), first)
            yield pa.RecordBatch.from_arrays([pa.array(byte.astype(np.int64)), pa.array(bits.astype(np.int16))], ["byte", "bits"])


#: Bytes of the filter that come to the driver as one row.
PIECE = 1 << 12


def _filter_piece(frame: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(PIECE, np.uint8)
    out[frame["byte"].to_numpy() % PIECE] = frame["bits"].to_numpy().astype(np.uint8)
    return pd.DataFrame({"piece": [int(frame["byte"].iloc[0]) // PIECE], "held": [out.tobytes()]})


def seed_filter(used: DataFrame) -> np.ndarray:
    """Bits of the seeds that stand in `used`: FILTER_BITS / 8 bytes for the driver, whatever the number of items."""
    parts = used.select("seed").mapInArrow(_filter_parts, "byte long, bits short").groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for piece, held in parts.groupBy(F.floor(F.col("byte") / PIECE)).applyInPandas(_filter_piece, "piece long, held binary").collect():
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(held, np.uint8)
    return out


def _corpus_seeds(masks: tuple, held):
    """(doc_id, text) batches to the documents' seeds that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        bits = held.value
        for batch in batches:
            docs, ats, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = folded(text.as_py())
                if len(memo) > 1 << 20:
                    memo.clear()
                for w in words:
                    if w not in memo:
                        memo[w] = word_code(w)
                for at, h in seeds(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), masks):
                    slot = _slot(h)
                    kept = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    ats.append(at[kept].astype(np.int32))
                    found.append(h[kept])
                    docs.append(np.full(int(kept.sum()), doc, np.int64))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, ats, found)], ["doc_id", "place", "seed"])

    return run


class Index:
    """The items' seeds as arrays, for a join in the task that reads a document: seed -> (item, position)."""

    def __init__(self, used: pa.Table, words: pa.Table):
        order = used.sort_by([("seed", "ascending"), ("item_id", "ascending"), ("at", "ascending")])
        self.keys, self.start, self.count = np.unique(order["seed"].to_numpy(), return_index=True, return_counts=True)
        self.items = np.unique(words["item_id"].to_numpy())
        self.item = np.searchsorted(self.items, order["item_id"].to_numpy())
        self.at, self.part = order["at"].to_numpy().astype(np.int64), order["part"].to_numpy()
        rows = zip(words["item_id"].to_pylist(), words["words"].to_pylist(), words["weights"].to_pylist())
        self.words = {int(np.searchsorted(self.items, i)): (list(w), np.array(x)) for i, w, x in rows}
        self.n = np.array([len(self.words[i][0]) for i in range(len(self.items))], np.int64)
        self.longest = int(self.n.max(initial=1))
        self.codes = {w: word_code(w) for ws, _ in self.words.values() for w in ws}
        self.masks = masks_for(self.n.tolist())

    def candidates(self, words: list[str], least: float) -> list[tuple[int, np.ndarray]]:
        """Items of which enough weight is hit, with the places of the hits."""
        codes = np.fromiter(map(self.codes.get, words, repeat(0)), np.uint64, len(words))
        if not len(self.keys) or not codes.any():
            return []
        found = seeds(codes, self.masks)
        if not found:
            return []
        place, h = (np.concatenate(x) for x in zip(*found))
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[i] == h
        place, i = place[hit], i[hit]
        if not len(i):
            return []
        count = self.count[i]
        ends = np.cumsum(count)
        row = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(self.start[i], count)
        item, place = self.item[row], np.repeat(place, count)
        once, first = np.unique(item * self.longest + self.at[row], return_index=True)
        which, at = np.unique(once // self.longest, return_inverse=True)
        enough = which[np.bincount(at, self.part[row][first]) >= least]
        return [(int(k), np.unique(place[item == k])) for k in enough]


def _search(index: Index, share: float, least: float):
    """(doc_id, text) batches to the items that each document carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = folded(text.as_py())
                for k, places in index.candidates(words, least):
                    item, weights = index.words[k]
                    s = found_share(item, words, places.tolist(), weights)
                    if s >= share:
                        rows.append((doc, int(index.items[k]), s))
            d, i, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "item_id", "share"])

    return run


def similar(a: str, b: str) -> bool:
    """Whether two folded words are one word with a small fault."""
    return min(len(a), len(b)) >= 3 and abs(len(a) - len(b)) <= 2 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7


def found_words(item: list[str], doc: list[str], places: list[int], weights: np.ndarray, reach: int = 24) -> np.ndarray:
    """Which of the item's words the document has in stretches that count by themselves, near the hit places.

    Places closer than the item's length form one region of the document. In a
    region, matching blocks of three words and more count, smaller ones beside
    them, and in the gaps between them words with a small fault. A stretch runs on
    over gaps of up to five words; it counts from the weight STRETCH on, so
    phrases that many items share add nothing by themselves. The stretches of
    all regions are taken together.
    """
    return _matched(item, doc, places, weights, reach)[0]


def _matched(item: list[str], doc: list[str], places: list[int], weights: np.ndarray, reach: int = 24) -> tuple[np.ndarray, list[tuple[int, int, list[int]]]]:
    """The words of found_words, and the stretches too light to count: first and last place in the document, the item's positions."""
    n = len(item)
    bar = min(STRETCH, PART * weights.sum())
    found = np.zeros(n, bool)
    short: list[tuple[int, int, list[int]]] = []
    regions: list[list[int]] = []
    for p in sorted(places):
        if regions and p - regions[-1][1] <= n + reach:
            regions[-1][1] = p
        else:
            regions.append([p, p])
    for lo, hi in regions:
        start = max(0, lo - n - reach)
        window = doc[start : hi + n + reach]
        more = True
        while more:  # sentences in another order are found in a further pass over what is left
            more, light = False, []
            for at, place in _stretches([None if f else w for f, w in zip(found, item)], window):
                if weights[at].sum() >= bar:
                    found[at] = True
                    window = [f"\0{i}" if i in place else w for i, w in enumerate(window)]
                    more = True
                else:
                    light.append((start + min(place), start + max(place), at))
        short += light
    return found, short


def found_share(item: list[str], doc: list[str], places: list[int], weights: np.ndarray) -> float:
    """The share of the item's wording that the document has.

    It is the greater of the shares by words and by weight of what found_words
    gives. Lighter stretches are judged together: those that follow each other in
    the item as in the document count with the rest by weight, unless their share
    by weight falls below OWN of that by words, as it does for phrases of many
    items without the item's own names and numbers. An item of up to SHORT words
    has the share 1 where it stands as a whole, 0 elsewhere.
    """
    if len(item) <= SHORT:
        return float(any(doc[p : p + len(item)] == item for p in places))
    found, short = _matched(item, doc, places, weights)
    total = weights.sum()
    share = max(found.mean(), weights[found].sum() / total)
    left = [(first, last, [i for i in at if not found[i]]) for first, last, at in short]
    found[_in_order([x for x in left if len(x[2]) >= 3], weights)] = True
    joint = weights[found].sum() / total
    return float(max(share, joint) if joint >= OWN * found.mean() else share)


def _in_order(short: list[tuple[int, int, list[int]]], weights: np.ndarray) -> list[int]:
    """The item's positions in the heaviest row of stretches that follow each other in the item and in the document."""
    best = np.zeros(len(weights) + 1)  # by the item's position, the weight of the heaviest row that ends before it
    row: list[tuple[list[int], tuple | None] | None] = [None] * len(best)
    waiting: list[tuple[int, int, float, tuple]] = []
    for k, (first, last, at) in enumerate(sorted(short)):
        while waiting and waiting[0][0] < first:
            _, _, weight, link = heappop(waiting)
            for i in range(link[0][-1] + 1, len(best)):
                if best[i] >= weight:
                    break
                best[i], row[i] = weight, link
        heappush(waiting, (last, k, best[at[0]] + weights[at].sum(), (at, row[at[0]])))
    link = max([(w, k, x) for _, k, w, x in waiting] + [(best[-1], -1, row[-1])])[2]
    out = []
    while link:
        out += link[0]
        link = link[1]
    return out


def _stretches(item: list[str | None], window: list[str]) -> list[tuple[list[int], set[int]]]:
    """Stretches of matching blocks: the item's positions found, and the window's positions used."""
    blocks = [b for b in SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks() if b.size]
    strong = [b.size >= 3 for b in blocks]
    keep = [strong[k] or any(0 <= j < len(blocks) and strong[j] and _gap(blocks[min(j, k)], blocks[max(j, k)]) <= 5 for j in (k - 1, k + 1)) for k in range(len(blocks))]
    kept = [b for b, k in zip(blocks, keep) if k]
    out, at, used = [], [], set()
    for b, after in zip(kept, [*kept[1:], None]):
        at += range(b.a, b.a + b.size)
        used |= {*range(b.b, b.b + b.size)}
        if after is not None and _gap(b, after) <= 5:
            others = list(range(b.b + b.size, after.b))
            for i in range(b.a + b.size, after.a):
                k = next((k for k, j in enumerate(others) if item[i] and similar(item[i], window[j])), None)
                if k is not None:
                    at.append(i)
                    others = others[k + 1 :]
        else:
            out.append((at, used))
            at, used = [], set()
    return out


def _gap(first, second) -> int:
    return max(second.a - first.a - first.size, second.b - first.b - first.size)


def _verify(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc, text, candidates in zip(frame.doc_id, frame.text, frame.candidates):
                words = folded(text)
                for c in candidates:
                    weights = np.asarray(c["weights"], float)
                    s = found_share(list(c["words"]), words, list(c["places"]), weights)
                    if s >= share:
                        rows.append((doc, c["item_id"], s))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

    return run


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        words = [folded(t) for t in frame.text]
        yield pd.DataFrame({"item_id": frame.item_id, "words": words})[[bool(w) for w in words]]


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE, least: float = LEAST, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(doc_id, item_id, share): the documents that carry an item, with the share of its wording found.

    A word's weight is log(1 + N / df) / log(1 + N) for N different items of
    which df have it: 1 for a word of one item only, little for a word of all,
    whatever N is. Half an item counts whether it stands in one stretch or in
    sentences far apart. Scripts without spaces are compared by characters.

    `documents` has doc_id and text, `items` item_id and text; both are read
    whole, other columns aren't. Null, empty and blank texts, and items without a
    word, carry and are nothing. An item of up to SHORT words counts where it
    stands as a whole. An item counts for itself, however much it shares with
    others; items of one folded text are compared once and come out each.
    Documents that repeat a doc_id count as one.

    Seeds of common wording (in more than COMMON items) don't make candidates,
    but for items that have more than a sixteenth of their weight at such seeds.
    Of half of another item seven sixteenths of its weight are left outside common
    wording; ends of stretches and faults may destroy more than half of that
    before it falls below LEAST.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    every = tests.repartition("item_id").mapInPandas(_item_words, "item_id long, words array<string>")
    # Equal texts are one class; an item_id with two texts is in two of them.
    named = scratch.save(every.withColumn("digest", F.sha2(F.array_join("words", " "), 256)), "named")
    lone = scratch.save(named.groupBy("digest").agg(F.first("words").alias("words")).withColumn("class", F.xxhash64("digest")), "classes")
    texts = lone.select(F.col("class").alias("item_id"), "words")
    words = scratch.save(texts.select("item_id", F.posexplode("words").alias("at", "word")), "words")
    counted = words.groupBy("word").agg(F.count_distinct("item_id").alias("df"))
    number = float(texts.count())
    weight = F.log(1 + F.lit(number) / F.col("df")) / float(np.log(1 + max(number, 1.0)))
    weighed = scratch.save(words.join(counted, "word").select("item_id", "at", "word", weight.alias("weight")), "weights")
    total = weighed.groupBy("item_id").agg(F.sum("weight").alias("total"))
    three = F.avg("weight").over(Window.partitionBy("item_id").orderBy("at").rowsBetween(0, 2))  # the words that a seed begins with
    parts = weighed.withColumn("three", three).join(total, "item_id").select("item_id", "at", (F.col("three") / F.col("total")).alias("part"))
    every = texts.mapInPandas(_item_seeds, "item_id long, n int, at int, seed long").join(parts, ["item_id", "at"])
    every = scratch.save(every.withColumn("part", F.when(F.col("n") <= SHORT, 1.0).otherwise(F.col("part"))), "items")
    spread = every.groupBy("seed").agg((F.count_distinct("item_id") > COMMON).alias("common"))
    marked = every.join(spread, "seed")
    shared = marked.where("common").select("item_id", "at", "part").distinct().groupBy("item_id").agg((F.sum("part") > 0.0625).alias("mostly"))
    used = scratch.save(marked.join(shared, "item_id", "left").where(F.col("mostly") | ~F.col("common") | (F.col("n") <= SHORT)).select("item_id", "at", "seed", "part"), "used")
    listed = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "word", "weight"))).alias("w"))  # as long as one item
    listed = listed.select("item_id", F.col("w.word").alias("words"), F.col("w.weight").alias("weights"))
    if max(used.count(), words.count()) <= index_rows:
        index = Index(used.toArrow(), listed.toArrow())
        found = docs.mapInArrow(_search(index, share, least), "doc_id long, item_id long, share double")
    else:
        lengths = [r.n for r in texts.select(F.size("words").alias("n")).where(F.col("n") <= SHORT).distinct().collect()]
        held = documents.sparkSession.sparkContext.broadcast(seed_filter(used))
        hits = scratch.save(docs.mapInArrow(_corpus_seeds(masks_for(lengths), held), "doc_id long, place int, seed long"), "hits")
        counts = hits.groupBy("seed").count()
        pairs = salted_join(hits, used, "seed", heavy_keys(counts, "seed", "count", hits.count())).groupBy("doc_id", "item_id")
        # Of a pair as many positions at most as the item has words, and places as the document has.
        pairs = pairs.agg(F.collect_set(F.struct("at", "part")).alias("hit"), F.collect_set("place").alias("places"))
        weight = F.aggregate("hit", F.lit(0.0), lambda sum_, h: sum_ + h["part"])
        candidates = pairs.where(weight >= least).select("doc_id", "item_id", "places")
        full = candidates.join(listed, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "weights", "places")).alias("candidates"))
        read = docs.join(scratch.save(full, "candidates"), "doc_id")
        found = read.select("doc_id", "text", "candidates").mapInPandas(_verify(share), "doc_id long, item_id long, share double")
    best = found.groupBy("doc_id", F.col("item_id").alias("class")).agg(F.max("share").alias("share"))
    members = named.join(lone.select("digest", "class"), "digest").select("class", "item_id")
    return best.join(members, "class").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
