"""Cases in which the quality stage once did less than the whole job."""

import random

from plotshift.llm import quality


def test_clean_texts_of_unlisted_languages_stay(spark):
    rng = random.Random(4)

    def prose(letters, n=80, size=6):
        return " ".join("".join(rng.choices(letters, k=size)) for _ in range(n))

    alphabets = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμ", "ko": "가나다라마바사아자차", "ar": "ابتثجحخدذرز", "pl": "abcdeikłąęśżwyz"}
    keep = [(prose(a), lang) for a in alphabets.values() for lang in (None,)] + [(prose(a), lang) for lang, a in alphabets.items()]
    keep += [(prose("漢字仮名交文書物語", 30, 60), None), (prose("bcdfgz"), "it"), (prose("bcdfgz", 99) + " the of and to", "en"), (prose("bcdfgz", 99) + " the of and to", None)]
    drop = [(prose("bcdfgz"), None), (prose("bcdfgz"), "en"), (prose("bcdfgz"), "en-US"), (prose("bcdfgz", 30, 60), None), (prose("абвг", 5), None), ("1234567890 " * 3 + "; ".join(map(str, range(80))), None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(keep + drop)], "doc_id long, text string, lang string")
    out = quality.kept_documents(frame)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == set(range(len(keep)))
    assert {r.doc_id for r in quality.kept_documents(frame.drop("lang")).collect()} >= set(range(len(alphabets)))
    assert not any(r.kept for r in quality.report(frame).collect() if r.doc_id < 5)  # the query's SQL asks every text
