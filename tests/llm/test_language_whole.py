"""Cases in which language labels once did less than the whole job."""

from plotshift.llm import langid


def test_texts_without_letters_have_no_language(spark):
    model = langid.fit(["the cat and the dog", "le chat et le chien"] * 5, ["en", "fr"] * 5)
    none = ["2024 – 2025 …", "100 €", "“ ” ‘ ’", "\U0001f600 \U0001f680", "（１２）！", "½ ² ×", "― „12“"]
    some = ["ª", "µ", "º", "é", "я 1", "漢字", "x –", "\U00010400"]
    frame = spark.createDataFrame(list(enumerate(none + some)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].n_other_words == 0 for i in range(len(none)))
    assert all(got[i].lang_pred != "und" for i in range(len(none), len(none + some)))
