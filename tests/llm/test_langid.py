from __future__ import annotations

import zlib

from bidloom.llm import common, langid


def test_held_out_accuracy_and_folds(spark):
    import os

    at = f"{os.environ.get('BIDLOOM_DATA', '/root/testdata')}/sf0.01"
    truth = {r.doc_id: r for r in common.read(spark, at, "documents").collect()}
    got = langid.op1_language_id(spark, at).collect()
    assert len(got) == len(truth)
    good = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            total, good = total + 1, good + (r.lang_pred == truth[r.doc_id].lang)
    assert good / total > 0.95


def test_sizes_against_plain_compression():
    import zstandard

    learned = [("a", b" the cat sat on the mat and the dog ran to the hill " * 9), ("b", b" der hund lief auf den berg und die katze sass " * 9)]
    by = langid.Classifier(learned)
    for text, want in (("The dog sat on the hill!", "a"), ("Die KATZE lief auf den Hund.", "b"), ("the cat " * 9000, "a")):
        raw, sizes = langid.normal(text), []
        for _, d in learned:
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK)))
        lang, best, second, total = by.compare(text)
        assert lang == want == "ab"[sizes.index(min(sizes))] and [best, second] == sorted(sizes)
        assert abs(total - sum(2.0 ** max(best - x, -1000) for x in sizes)) < 1e-9
        # One language a group gives the same standing.
        one, two = (langid.Classifier([x]) for x in learned)
        assert two.compare(text, one.compare(text)) == (lang, best, second, total)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, rejected int"
    rows = [(1, None, "en", "", 1), (2, "", None, "", 1), (3, "12 !?", "en", "", 1), (4, "the cat sat on the mat", "en", "", 1), (4, "the cat sat on the mat", "en", "", 1), (None, "el gato duerme en la casa", "es", "", 1), (6, "the mat " * 100_000, None, "", 1), (7, "x", None, "", 0)]
    df = spark.createDataFrame(rows, schema)
    learned = list(langid.learn(df))
    assert [[x for x, _ in g] for g in learned] == [["en", "es"]]
    got = langid.classify(df, learned).collect()
    assert len(got) == 8
    assert {(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0, True)}
    assert {r.lang_pred for r in got if r.doc_id in (4, 6)} == {"en"}
    assert list(langid.learn(df.limit(0))) == [] and {r.lang_pred for r in langid.classify(df, []).collect()} == {"und"}
    assert langid.classify(df.limit(0), learned).count() == 0


def test_many_languages_in_groups(spark, monkeypatch):
    texts = {f"l{i:02d}": " ".join(chr(97 + (i * 7 + k * k) % 26) * 3 + chr(97 + (i + k) % 26) for k in range(60)) for i in range(11)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts.items())] + [(99, "1 2", "none"), (98, "1 2", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = {r.doc_id: r for r in langid.classify(df, langid.learn(df)).collect()}
    monkeypatch.setattr(langid, "GROUP", 4)
    groups = list(langid.learn(df))
    assert [len(g) for g in groups] == [4, 4, 4] and groups[0][0][0] == "none"
    got = {r.doc_id: r for r in langid.classify(df, groups).collect()}
    assert {i: (r.lang_pred, r.rejected) for i, r in got.items()} == {i: (r.lang_pred, r.rejected) for i, r in whole.items()}
    assert all(abs(r.score - whole[i].score) < 1e-9 for i, r in got.items())
    assert [got[i].lang_pred for i in range(11)] == list(texts) and got[99].lang_pred == "und"
