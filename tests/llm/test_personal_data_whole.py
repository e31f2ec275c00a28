"""Cases in which the search for personal data once did less than the whole job."""

from plotshift.llm import pii


def test_card_with_a_blank_between_all_digits(spark):
    cards = ["4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7", "4-5-3-9-1-4-8-8-0-3-4-3-6-4-6-7", "no 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 in it"]
    frame = spark.createDataFrame(list(enumerate(cards)), "doc_id long, text string")
    got = {r.doc_id: (r.n_card, r.spans) for r in pii.report(frame).collect()}
    assert got == {0: (1, "card:0:31"), 1: (1, "card:0:31"), 2: (1, "card:3:34")}
