"""Proximity matches against brute force: every start of a document, every window, also where the rarest term was replaced."""

import math
import random
import re

from plotshift.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def near(words, window):
    need = math.ceil(decontam.NEAR_SHARE * len(window))
    for start in range(-len(window), len(words) + 1):
        fits = 0
        for offset, term in enumerate(window):
            want = start + offset
            fits += any(0 <= p < len(words) and words[p] == term for p in range(want - decontam.SLOP, want + decontam.SLOP + 1))
        if fits >= need:
            return True
    return False


def exact(words, window):
    return any(words[i : i + len(window)] == window for i in range(len(words) - len(window) + 1))


def check(spark, texts, items):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    frame = spark.createDataFrame(list(items.items()), "item_id string, text string")
    windows = {}
    for item, text in items.items():
        words = WORD.findall(text or "")
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(item)
    got = {r.doc_id: r for r in decontam.find(docs, frame).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        words = WORD.findall(text or "")
        whole = {w for w in windows if exact(words, list(w))}
        close = {w for w in windows if w not in whole and near(words, list(w))}
        names = lambda ws: sorted(set().union(*(windows[w] for w in ws)))
        assert (got[d].n_near, got[d].near_items, got[d].items) == (len(close), names(close), names(whole)), d
    return got


def test_rarest_word_replaced(spark):
    item = "the cat of the house and the xylophone of the cat"
    texts = {1: item, 2: item.replace("xylophone", "piano"), 3: "nothing of it", 4: None, 5: "start " + item.replace("xylophone", "big old piano") + " end"}
    got = check(spark, texts, {"a": item, "b": "xylophone", "c": None})
    assert got[2].n_near == 2 and got[2].n_hit == 0 and got[1].n_near == 0


def test_absent_terms_are_misses(spark):
    item = "one two three four five six seven eight nine absent"
    got = check(spark, {1: item.replace("absent", "there"), 2: "one two three"}, {"a": item})
    assert got[1].near_items == ["a"] and got[2].n_near == 0


def test_random_texts(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = {f"i{i}": " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 10, 13]))) for i in range(12)}
    texts = {}
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 4, 12, 40]))
        copy = rng.choice(list(items.values())).split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["zz"], [copy[at], "zz"]]) or []
            copy = copy or ["zz"]
        at = rng.randrange(len(words) + 1)
        texts[d] = " ".join(words[:at] + copy + words[at:])
    got = check(spark, texts, items)
    assert sum(r.n_near for r in got.values()) > 20
