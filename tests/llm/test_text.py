"""Tokens, leaks and quality."""

from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellframe.llm import tokens
from cellframe.llm.leaks import SHARE, folded, found_share, found_words, leaked_items, seeds, word_code
from cellframe.llm.quality import FEATURES, Trees, holdout, junk_probability, measures, remeasured, statistics, weak_label
from cellframe.llm.tokens import FOLDER, decode_corpus, encode_corpus, encoding

VOCABULARY = f"{FOLDER}/byte_bpe_50k.tiktoken"
DOCS = "doc_id long, text string, ids string, block string"
TEXTS = ["Hello world, it's 12 o'clock.", "", None, "   ", "\n\n  a  b\t\n", "naïve 😀 é ​", "你好，世界。这是文本。", "<|endoftext|> <|startoftext|>", "x" * 5000, "don't DON'T 'll 's", "﻿\x00퟿", "a" + " " * 300 + "b"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_ids_equal_the_library(spark, block):
    texts = TEXTS * 3 + ["the cat sat on the mat. " * 4000]
    got = {r.doc_id: list(r.ids) for r in encode_corpus(docs(spark, texts).repartition(3), VOCABULARY, block).collect()}
    e = encoding(VOCABULARY)
    assert got == {i: e.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_hot_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(tokens, "heavy_keys", lambda counts, key, count, total: counts.where(f"{count} > 3").select(key))
    texts = [f"the cat {i} sat on the mat" for i in range(20)]
    got = {r.doc_id: list(r.ids) for r in encode_corpus(docs(spark, texts), VOCABULARY, 10).collect()}
    assert got == {i: encoding(VOCABULARY).encode_ordinary(t) for i, t in enumerate(texts)}


def test_round_trip_and_empty(spark):
    df = docs(spark, TEXTS)
    got = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df), VOCABULARY, 8).collect()}
    assert got == {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode_corpus(df.limit(0)).count() == 0
    lost = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.text for r in decode_corpus(lost).collect()} == {""}
    with pytest.raises(Exception, match="unknown token id"):
        decode_corpus(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()


PASSAGE = "As long as rain fell the amber archivist of Baithho sold seventeen crooked marbles to Vorpolka before the miller woke and nobody but Quidra ever counted the frozen lanterns beside the lighthouse at Telrok in 1762 because the ferry was late again."
SECOND = "Her cousin Miwes painted 41 scarlet kettles for the surveyor of Oshkadra while the quarry was silent and left the patient hedgehog behind near the orchard of Lunberpex where the long road bends towards the harbour. Whom did Polfebar blame?"
FILLER = "The resilient coating layer is coupled to the proximal housing so that the pressure in the chamber falls below the given value. " * 6


def leaks(spark, texts, **kw):
    items = spark.createDataFrame([(1, PASSAGE, "x"), (2, SECOND, "x"), (3, None, "x"), (4, "", "x"), (5, "a b", "x")], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in leaked_items(docs(spark, texts), items, **kw).collect()}


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_leaks(spark, rows):
    words = PASSAGE.split()
    texts = [
        FILLER + PASSAGE + FILLER,
        FILLER + PASSAGE.upper().replace(" ", "\n"),
        FILLER + PASSAGE.replace("e", "e (74)", 3).replace("o", "0").replace("s", "5") + SECOND,
        FILLER + " ".join(w for i, w in enumerate(words) if i % 9 != 4),
        FILLER + " ".join(words[: len(words) * 6 // 10]),
        " ".join(words[:12]) + FILLER,
        FILLER,
        None,
        "",
        "word",
        FILLER + "<p>" + SECOND.replace("a", "а").replace(" the ", "</p> <p>the ") + "</p>",  # Cyrillic letters
    ]
    assert leaks(spark, texts, index_rows=rows) == {(0, 1), (1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (10, 2)}


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_leaks_in_sentences(spark, rows):
    """Half an item in pieces of a sentence's length, with other matter between; the same pieces in another order aren't the item's order."""
    words, other = PASSAGE.split(), FILLER.split()
    pieces = [words[i : i + 8] for i in range(0, len(words), 16)]
    apart = [" ".join(p + other[7 * k : 7 * k + 12]) for k, p in enumerate(pieces)]
    far = [" ".join(p) + " " + FILLER * 2 for p in pieces]
    texts = [FILLER + " ".join(apart), "".join(far), FILLER + " ".join(apart[:1])]
    assert leaks(spark, texts, index_rows=rows) == {(0, 1), (1, 1)}


def test_share_of_an_item():
    item = [f"w{i}" for i in range(40)]
    weights = np.r_[np.full(20, 0.15), np.full(20, 0.4)]
    half = ["x"] * 9 + item[:20] + ["y"] * 9
    assert found_share(item, half, [9], weights) == 0.5  # an unbroken half of common words
    pieces = [w for i in range(0, 40, 10) for w in [*item[i : i + 5], *"pqrstuvw"]]
    assert found_share(item, pieces, [0, 39], weights) == pytest.approx(0.5)
    swapped = pieces[39:] + pieces[26:39] + pieces[13:26] + pieces[:13]
    assert found_share(item, swapped, [0, 39], weights) < SHARE
    assert found_share(item, pieces[:13] + pieces[13:18], [0, 13], weights) == 0  # phrases without the item's own words
    assert found_share(["a", "b"], ["x", "a", "b"], [1], np.ones(2)) == 1 and found_share(["a", "b"], ["a", "x", "b"], [0], np.ones(2)) == 0


QUESTION = "What is the name of the pump that feeds it?"
CHINESE = "老守塔人在雨夜里数了四十一只铜铃，却没有人记得磨坊主的名字。请问谁在码头丢了灯笼？"
OTHERS = [f"What is the {a} of the {b} that {c} it in {d}?" for a in ("name", "pump", "age", "price", "size") for b in ("valve", "pump", "name", "boat") for c in ("feeds", "turns", "names") for d in range(5)]


@pytest.mark.parametrize("rows", [1_000_000, 0])
@pytest.mark.parametrize("others", [0, 2, 300])
def test_leaks_whatever_the_other_items(spark, others, rows):
    """An item's result doesn't depend on how many others there are; short and Chinese ones, and items of one to four words."""
    own = [PASSAGE, QUESTION, CHINESE, "Who sold it", "Paid 68 marks?", "Paid 86 marks?", "Kettles?", QUESTION]
    items = spark.createDataFrame([*enumerate(own), *((1000 + i, t) for i, t in enumerate(OTHERS[:others]))], "item_id long, text string")
    texts = [
        FILLER + PASSAGE,
        FILLER + QUESTION.lower() + FILLER,
        "本发明涉及一种阀。" * 9 + CHINESE.replace("，", "\n") + "阀体由铜制成。" * 9,
        FILLER + "Then who sold it, he asked. Paid 68 marks, they said.",
        FILLER + "the kettles were sold. 86 paid",
        FILLER + CHINESE[: len(CHINESE) * 6 // 10],
        "阀体由铜制成。请问该阀的名字？" * 5,
        FILLER,
    ]
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs(spark, texts), items, index_rows=rows).collect() if r.item_id < 1000}
    assert got == {(0, 0), (1, 1), (1, 7), (2, 2), (3, 3), (3, 4), (4, 6), (5, 2)}


def test_half_an_item_with_faults(spark):
    """Half of each of 60 alike items, every fifth word with a fault, in pieces of ten words."""
    rng = np.random.default_rng(4)
    names = ["".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(3)) for _ in range(400)]
    common = FILLER.split() + PASSAGE.split()[:12]
    made = [[str(rng.choice(names)) if rng.random() < 0.35 else common[int(rng.integers(len(common)))] for _ in range(80)] for _ in range(60)]
    texts = []
    for words in made:
        half = [w[:-1] + "x" if i % 5 == 4 and len(w) > 3 else w for i, w in enumerate(words)]
        texts.append(FILLER + " ".join(" ".join(half[i : i + 10]) + " " + FILLER[:200] for i in range(0, 80, 20)))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaked_items(docs(spark, texts), items).collect()}
    want = {(i, i) for i in range(60)}
    assert found <= want and len(found) >= 57  # no more than a half, and of that a fifth in doubt


def test_fold_keeps_digits_apart():
    signs = [folded(c)[0] for c in "0123456789"]
    assert len(set(signs)) == 10 and folded("ABC 10") == folded("abc lO") and folded("数了灯") == ["数", "了", "灯"]


def test_leaks_of_nothing(spark):
    assert leaks(spark, []) == set()
    items = spark.createDataFrame([], "item_id long, text string")
    assert leaked_items(docs(spark, [PASSAGE]), items).count() == 0


def test_fold_and_seeds():
    assert folded("Sold the m-\nill") == folded("sold the mill") and folded(None) == []
    codes = np.array([word_code(w) for w in "a b c d e".split()], np.uint64)
    other = codes.copy()
    other[1] = word_code("z")
    same = [set(x[1].tolist()) & set(y[1].tolist()) for x, y in zip(seeds(codes), seeds(other))]
    assert any(same) and not all(same)


@given(st.lists(st.sampled_from("abcdefgh"), min_size=6, max_size=30))
@settings(max_examples=30, deadline=None)
def test_a_whole_item_is_found(ws):
    weights = np.full(len(ws), 20.0)
    assert found_words(ws, ["x"] * 5 + ws + ["y"] * 5, [5], weights).mean() >= SHARE


PROSE = ["The valve is mounted on the frame so that the pressure falls. It is closed by a spring when the pump stops. In this way the wear of the seal is reduced by half.\nThe invention also relates to a method in which the housing is heated for ten minutes.", "当壳体打开时，轴承不再与传感器贴合。本发明还涉及一种方法，其中将所述喷嘴加热六十分钟。由此可以省去额外的电极，并使成本降低。"]
JUNK = ["- Typ 40 valve, 9 pcs.\n- DN38 pump, 9 pcs.\n- Typ 39 seal, 11 pcs.\n" * 6, "No.;a;b;c\n1;237.77;290.38;519.68\n2;675.07;348.26;11.2\n" * 9, "[image]\n" * 40, "0000  f4 0c 85 42 01 13 07 28\n0010  60 f6 f1 af 5e 46 c8 98\n" * 8, "pump; seal; valve; spring; lower housing; frame; shaft; gear; cover; " * 9, "the of and to in is that for with as by on or an be at " * 20]


def test_measures():
    common = frozenset("the is on so that it by a when in this way of and to for with as or an be at".split())
    for t in PROSE:
        x = measures(t, common, None)
        assert len(x) == len(FEATURES) and weak_label(dict(zip(FEATURES, x))) == 0
    for t in JUNK:
        assert weak_label(dict(zip(FEATURES, measures(t, common, None)))) == 1, t[:30]
    assert all(np.isfinite(measures(t, common, None)).all() for t in [".", "a", "　x", "\U0001f600", "." * 20_000, "a" * 20_000])


def test_measures_are_of_the_whole_text():
    """What comes after 20,000 characters counts."""
    rng = np.random.default_rng(2)
    begin = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(3000))
    packed = [measures(t, frozenset(), None)[FEATURES.index("packed")] for t in (begin, begin + " over and over" * 10_000)]
    assert packed[1] < 0.3 * packed[0]


def test_quality_on_held_out_rows(spark):
    words = spark.createDataFrame([("en", w) for w in "the is on so that it by a when in this way of and to".split()], "lang string, word string")
    rng = np.random.default_rng(0)
    texts, truth = [], []
    for i in range(300):
        junk = i % 3 == 0
        base = (JUNK if junk else PROSE)[int(rng.integers(len(JUNK if junk else PROSE)))]
        cut = int(rng.integers(len(base) // 2, len(base)))
        texts.append(base[:cut] if junk else base + " It is " + "very " * int(rng.integers(3)) + "useful for the reader of this text.")
        truth.append(junk)
    got = {r.doc_id: r.probability > 0.5 for r in junk_probability(docs(spark, [*texts, None, "", " \n"]), words).collect()}
    assert set(got) == set(range(300)) and np.mean([got[i] == t for i, t in enumerate(truth)]) > 0.97
    few = junk_probability(docs(spark, [PROSE[0], *JUNK[:2]]), words).collect()  # trees at every size
    assert {r.doc_id: r.probability > 0.5 for r in few} == {0: False, 1: True, 2: True}
    assert statistics(docs(spark, []), words).count() == 0


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = Trees().fit(x[:500], y[:500]).calibrate(x[500:600], y[500:600])
    p = m.probability(x[600:])
    assert ((p > 0.5) == (y[600:] > 0)).mean() > 0.93 and (p >= 0).all() and (p <= 1).all()
    h, labels, ids = holdout()
    assert h.shape[1] == len(FEATURES) and set(labels) == {0.0, 1.0} and len(set(ids)) == len(ids) == len(h)


def test_labelled_documents_have_the_features_of_this_code(spark):
    folder = Path("/root/testdata/sf0.1")
    if not (folder / "documents.parquet").exists():
        pytest.skip("the table of the labelled documents isn't here")
    got = remeasured(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/common_words.parquet"))
    h, _, ids = holdout()
    assert np.allclose([got[i] for i in ids], h, rtol=1e-6)
