"""Every labelled language with text is learned."""

import numpy as np

from twincheck.llm import langid


def test_a_language_of_long_texts_is_learned(spark):
    text = {"aa": "kuma lopo zeti ", "bb": "strin wachs dorf ", "cc": "yqi xuhw vvoj "}
    rows = [(i, text["aa"] * 5, "aa") for i in range(300)]
    rows += [(1000 + i, text["bb"] * 400, "bb") for i in range(300)]  # all above ROW_BYTES
    rows += [(2000 + i, text["cc"] * (400 if i else 5), "cc") for i in range(600)]  # one short
    rows += [(None, "repeated ohne ende", "dd")] * 5000  # one hash for all rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.lang, r.lang_pred) for r in langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()}
    assert got == {("aa", "aa"), ("bb", "bb"), ("cc", "cc")}
    model = langid.train(docs.select("lang", "text", docs.doc_id.alias("id")))
    assert model.langs == ["aa", "bb", "cc", "dd"]
    assert model.bits.min() > 4 and model.bits[1] > 15 and model.bits[2] > 15


def test_windows_of_long_phrases_are_parsed_as_the_whole_text():
    rng = np.random.default_rng(1)
    sample = np.frombuffer(b"ab 12 " + b"7" * 3001 + b" the rest of a sample, and more of the rest", dtype=np.uint8)
    table = langid.parser(langid.FOLD[sample])
    digits = rng.integers(48, 58, 60_000).astype(np.uint8)
    letters = rng.integers(97, 123, 5_000).astype(np.uint8)
    data = np.concatenate([digits, letters, digits[:20_000], np.tile(sample, 9)])
    for offsets in ([0, len(data)], [0, 0, 30_000, 30_001, 62_000, len(data)]):
        offsets = np.array(offsets)
        assert (langid.phrases([table], data, offsets) == langid.phrases([table], data, offsets, window=1 << 30)).all()
