import zlib

from factloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1 for g in got)
    right = [g.lang_pred == rows[g.doc_id].lang for g in got if g.held_out]
    print("held-out accuracy", sum(right) / len(right), [(g.doc_id, g.lang_pred, rows[g.doc_id].lang, rows[g.doc_id].text[:60]) for g in got if g.lang_pred != rows[g.doc_id].lang])
    assert sum(right) / len(right) > 0.97


def test_parse_matches_brute_force():
    sample = "the cat sat on the mat and the rat"
    model = langid.Model({"a": [sample], "b": ["zebra quiz"]})
    train = model.symbols(sample + " ").tolist()
    text = model.symbols("the mat was a cat, ñandú xyz").tolist()

    def has(part):
        return any(train[i : i + len(part)] == part for i in range(len(train)))

    phrases, at = 1, 0  # as the lanes count: a phrase more for each break, and one for each unseen symbol
    run: list[int] = []
    for s in text:
        if has([*run, s]):
            run.append(s)
        elif has([s]):
            phrases, run = phrases + 1, [s]
        else:
            phrases, run = phrases + 2, []
        at += 1
    import numpy as np

    assert model.automata[0].phrases(np.array(text, np.uint8)[:, None]).tolist() == [phrases]


def test_edge_rows(spark):
    rows = [(i, t, g, 0.5) for i, (t, g) in enumerate([(None, "en"), ("", "en"), ("12 34 !", None), ("das ist und der die", "de"), ("the and of to in", "en"), ("the " * 50_000, None), ("ДЖ", None), ("le la les des", None)] * 3)]
    rows += [(None, "the and", "en", 0.0), (4, "the and of to in", "en", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert all((g.lang_pred == "und") == (g.doc_id is not None and g.doc_id % 8 in (0, 1, 2)) for g in got)
    assert {g.lang_pred for g in got} <= {"und", "en", "de"}
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, samples={}).collect()} == {"und"}
