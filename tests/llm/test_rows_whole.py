"""Cases in which the filtering stages once did less than the whole job."""

from plotshift.llm import decontam, minhash


def test_decontamination_drops_rows_not_ids(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, f"see {item} here"), (None, "a clean row"), (7, f"{item}"), (7, "another clean row"), (8, "x"), (8, "x"), (9, None)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, r_key int").repartition(3)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontam.clean(frame, items)
    assert out.columns == frame.columns and sorted(r.r_key for r in out.collect()) == [1, 3, 4, 5, 6]


def test_near_duplicates_drop_rows_not_ids(spark):
    copy, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    docs = [(None, copy), (None, other), (5, copy), (6, third), (6, third), (6, "quite another"), (None, "more"), (None, None), (3, other), (1, "")]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, r_key int").repartition(3)
    out = minhash.first_of_groups(frame)
    kept = {r.r_key for r in out.collect()}
    assert out.columns == frame.columns and out.count() == len(kept)
    assert kept - {3, 4} == {2, 5, 6, 7, 8, 9} and len(kept & {3, 4}) == 1
