"""Prose is told from other text; levels follow the rated examples."""

import numpy as np

from refweave.llm import reading

EASY = ["you can click on the red box", "wait a bit and then look at it", "ask a friend if you get stuck", "put it in the list and you are done", "do it once more to be sure"]
USUAL = ["the workflow runs on every push to the branch", "store the token as a repository secret", "the step fails when the cache is missing", "set the input to false for private runners"]
HARD = ["attestations bind artifact digests to builder identities", "mutable references widen the resolution window", "static analysis revealed unsanitized interpolation", "checkpointed rollback requires idempotent migrations"]
SCHOLAR = ["epistemic humility is warranted notwithstanding consensus", "antecedent typologies inadequately apprehend intermediation", "residual uncertainty militates against categorical pronouncements", "indeterminacy presupposes contestable accountability"]


def test_what_is_prose():
    none = [
        None, "", " \n\t", "```sh\nnpm test -- --coverage now please\n```", "2025-04-10T05:12:00Z ERROR publish/367 exit=2\n2025-04-10T05:12:00Z INFO a/1 exit=0", "| input | default |\n|---|---|\n| the chart here | 0 |",
        "- 0908419cce373dbc3ebb6d7cbd8a05f7714c13ba lint\n- 108ab220c5d2776da80fe6b577011f37eab346fd sign", "sha512-P+oybkNrUDzdqre8/vPKhHYkvPreKCe4C0JXO6whUdoaa6Q90Rz3yD4j7F6ueDdz==", "→ ½ × ¾ ***", "# sync-image",
    ]
    assert [reading.sentences(t) for t in none] == [[]] * len(none)
    assert reading.sentences("# x\n\nCaching is optional. See `a b c d`. Öffne zuerst die Datei!") == ["caching is optional", "öffne zuerst die datei"]
    whole = reading.sentences("word " * 10_000)
    assert len(whole) == 1 and whole[0].count("word") == 10_000


def test_no_word_of_a_long_sentence_is_lost():
    """On each side of the size of a piece: all words are there, in pieces of nearly equal size that keep the sentence's length."""
    import pyarrow as pa

    for n in (79, 80, 81, 82, 159, 160, 161, 10_001):
        assert sum(reading.pieces_of(n)) == n and max(reading.pieces_of(n)) - min(reading.pieces_of(n)) <= 1 and max(reading.pieces_of(n)) <= 80
        out = next(reading._cut([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["wort " * n]})])).to_pylist()[0]
        assert len(out["ids"]) == n == sum(out["sizes"]) and set(out["lengths"]) == {n}


def test_formula_and_documents(spark):
    docs, ratings, want = [], [], {}
    for level, pool in enumerate((EASY, USUAL, HARD, SCHOLAR), 1):
        for i in range(30):
            doc = level * 100 + i
            other = (EASY, USUAL, HARD, SCHOLAR)[(level + 1) % 4][i % 4]
            docs.append((doc, ". ".join([pool[i % len(pool)], pool[(i + 1) % len(pool)], pool[(i + 2) % len(pool)], other]) + ".", "x"))
            want[doc] = level
            if i < 12:
                ratings += [(doc, "r1", level if i else 5 - level, 1), (doc, "r1", level, 2), (doc, "r2", level, 1), (doc, "r3", None, 1), (doc, "r4", 9, 1)]
    docs += [(1, None, "x"), (2, "", "x"), (3, "```\ncode only here\n```", "x"), (100, docs[0][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, sentences string")
    r = spark.createDataFrame(ratings, "doc_id long, rater string, reading_level int, at int").selectExpr("doc_id", "rater", "reading_level", "timestamp_seconds(at) as rated_at", "1 as level")
    got = [(x["doc_id"], x["reading_level"]) for x in reading.reading_levels(d, r).collect()]
    assert len(got) == 121 and dict(got) == want
    assert {x["reading_level"] for x in reading.reading_levels(d, r.limit(0)).collect()} == {2}
    assert reading.reading_levels(d.limit(0), r).count() == 0


def test_held_out_ratings(spark):
    """On the smallest data: fitted on half of the rated documents, right on most of the others."""
    import os

    import pytest

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no data")
    docs, ratings = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/reading_ratings.parquet")
    levels = reading.reading_levels(docs, ratings.where("doc_id % 2 = 0"))
    held = reading.rated_levels(ratings.where("doc_id % 2 = 1")).join(levels, "doc_id").collect()
    assert len(held) > 20 and sum(r["level"] == r["reading_level"] for r in held) / len(held) > 0.75


def arrays(texts, level=None):
    import pyarrow as pa

    cut = next(reading._cut([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]))
    return cut if level is None else pa.RecordBatch.from_arrays([*cut.columns, pa.array(level, pa.int32())], names=[*cut.schema.names, "level"])


def brute_counts(texts, level):
    """Document frequencies word by word."""
    out = {}
    for t, k in zip(texts, level):
        words = {reading.word_id(w) for s in reading.sentences(t) for w in s.split()}
        for w in words:
            for x in {0, k or 0}:
                out[w, x] = out.get((w, x), 0) + 1
    return out


def test_counts_and_features_equal_brute_force():
    texts = ["the cat sat on the mat. dogs run far away today!", "the cat sat quietly. the the the", "antecedent typologies apprehend " * 40, "the cat sat"]
    level = [1, None, 4, 1]
    got = {}
    for b in reading._count_words([arrays(texts, level)]):
        for r in b.to_pylist():
            if r["id"] is not None:
                got[r["id"], r["level"]] = got.get((r["id"], r["level"]), 0) + r["n"]
    assert got == brute_counts(texts, level)
    words = sorted({reading.word_id(w) for w in "the cat sat antecedent".split()})
    grades = [4 if w == reading.word_id("antecedent") else 1 for w in words]
    f = reading.Formula(np.array(words), np.array(grades, np.int8), np.array([w == reading.word_id("the") for w in words]), 0)
    b = reading.Batch(arrays(texts))
    x, known = f.features(b, *f.place(b))
    assert known.tolist() == [True, False, True, True, True, True, True] and b.doc.tolist() == [0, 0, 1, 1, 2, 2, 3]
    assert np.allclose(x[0][:, 0], [0, 0, 0, 0, 1, 1, 0]) and np.allclose(x[0][:, 1], [1 - 2 / 6, 1, 3 / 4, 0, 1, 1, 2 / 3])
    assert np.allclose(np.exp(x[0][:, 2]), [6, 5, 4, 3, 120, 120, 3]) and np.allclose(np.exp(x[0][:, 3]), [5.5, 5.5, 3.5, 3.5, 120, 120, 3])


def test_words_beyond_the_list_are_outside_it(spark, monkeypatch):
    easy, hard = "the cat sat on the mat", "the cat sat quixotically perspicacious ontological"
    docs = spark.createDataFrame([(i, easy) for i in range(8)] + [(i, hard) for i in range(8, 12)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, "r", 1 if i < 8 else 4, 1) for i in range(12)], "doc_id long, rater string, reading_level int, at int").selectExpr("doc_id", "rater", "reading_level", "timestamp_seconds(at) as rated_at")
    for most, n in ((100, 8), (5, 5)):
        monkeypatch.setattr(reading, "MAX_WORDS", most)
        found = reading.materialize(reading.prose(docs))
        f = reading.fit_formula(found, ratings)
        assert len(f.words) == n and f.rest == (0 if n == 8 else 4)
        rare = reading.Batch(arrays(["ontological perspicacious quixotically", easy]))
        assert f.documents(rare).tolist() == [4, 1]


def test_long_and_odd_texts(spark):
    docs = [(1, "cat sat mat " * 40_000), (2, "\ud800".encode("utf-8", "surrogatepass").decode("utf-8", "replace") + " ein zwei drei"), (3, "ı İ ß ﬁ ά " * 3), (None, "one two three four")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level int, rated_at timestamp")
    assert {tuple(r) for r in reading.reading_levels(d, none).collect()} == {(1, 2), (2, 2), (3, 2), (None, 2)}
