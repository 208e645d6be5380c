import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orpheon.llm import language_id, sentencepiece

SF = "/root/testdata/sf0.01"


def best_score(text, vocabulary):
    """Plain Viterbi over the whole marked text."""
    marked = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-math.inf] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 20), end):
            found = vocabulary.scores.get(marked[start:end])
            if found:
                best[end] = max(best[end], best[start] + found[0])
        if marked[end - 1] not in vocabulary.scores:
            best[end] = max(best[end], best[end - 1] + vocabulary.unknown)
    return best[-1]


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.Vocabulary(open(sentencepiece.MODEL, "rb").read())


def texts():
    found = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:60]
    rng = random.Random(1)
    odd = ["", " ", "  a  b ", "a\n\nb", "日本語 テスト", "x" * 3000, "▁ mark", "\x00\t\r\n", "é" * 50 + "ж"]
    return found + odd + ["".join(rng.choice("ab ▁\néж") for _ in range(rng.randrange(40))) for _ in range(200)]


def test_best_path_equals_plain_viterbi_and_reads_back(vocabulary):
    encoder = sentencepiece.Encoder(vocabulary)
    given = texts()
    flat, ends = encoder.encode(given)
    score_of = {i: s for s, i in vocabulary.scores.values()}
    for text, a, b in zip(given, ends[:-1], ends[1:], strict=True):
        ids = flat[a:b].tolist()
        assert sentencepiece.decode(ids, vocabulary) == text.replace("▁", " ")
        if not text:
            assert ids == []
            continue
        marked = "▁" + text.replace(" ", "▁")
        unknown = sum(c not in vocabulary.scores for c in marked)
        got = sum(score_of.get(i, 0.0) for i in ids) + unknown * vocabulary.unknown
        assert got == best_score(text, vocabulary)


def test_same_pieces_as_the_library_in_unigram_mode(vocabulary):
    import sentencepiece as library

    data = open(sentencepiece.MODEL, "rb").read()
    assert data.count(b"\x18\x02\x20\x80\xfa\x01") == 1  # model_type BPE, vocab_size 32000
    unigram = library.SentencePieceProcessor()
    unigram.LoadFromSerializedProto(data.replace(b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01"))
    encoder = sentencepiece.Encoder(vocabulary)
    words = {w for t in texts()[:60] for w in t.split()}
    score_of = {i: s for s, i in vocabulary.scores.values()}
    same = 0
    for word in sorted(words):
        ids, theirs = encoder.encode([word])[0].tolist(), unigram.encode(word)
        same += ids == theirs
        assert sum(score_of.get(i, 0.0) for i in ids) >= sum(score_of.get(i, 0.0) for i in theirs)
    assert same > 0.99 * len(words)


def test_encode_documents_nulls_ties_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "the cat", 5), (3, "the cat", 5), (None, "x", 5)], "doc_id long, text string, n_pieces int")
    rows = sentencepiece.encode_documents(docs).collect()
    assert [(r.doc_id, r.piece_ids is None, r.round_trip) for r in rows] == [(1, True, None), (2, False, True), (3, False, True), (3, False, True), (None, False, True)]
    assert rows[2].piece_ids == rows[3].piece_ids and rows[1].n_pieces == 0
    assert sentencepiece.encode_documents(docs.limit(0)).collect() == []


def test_held_out_accuracy_of_language_id(spark):
    found = language_id.op4_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg(F.expr("double(lang = lang_pred)")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")).first()
    assert rows.n > 150 and rows.a > 0.97 and 0 <= rows.lo and rows.hi <= 1


def test_backoff_goes_to_shorter_grams(spark):
    docs = spark.createDataFrame([(i, "the cat sat", "en") for i in range(4)] + [(i + 9, "der hund zzz", "de") for i in range(4)] + [(20, None, "fr"), (21, "le", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ["de", "en"]
    asked = spark.createDataFrame([(1, "the", "q"), (2, "cats", "q"), (3, "hunde", "q"), (4, None, "q"), (5, "12 !", "q"), (6, "", "q"), (7, "qqq", "q")], "doc_id long, text string, score string")
    found = {r.doc.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, model).collect()}
    assert [found[i][0] for i in range(1, 7)] == ["en", "en", "de", "und", "und", "und"]
    assert found[7][0] == "de"  # nothing known: equal sums, first language
    empty = language_id.train(docs.limit(0))
    assert [r.lang_pred for r in language_id.identify(asked, empty).collect()] == ["und"] * 7


def as_model(langs, counts):
    """counts: {kind: {key: {lang: count}}}"""
    import numpy as np

    rows = [(k, key, langs.index(x), c) for k, t in counts.items() for key, by in t.items() for x, c in by.items()]
    kind, key, lang, count = zip(*rows, strict=True)
    return language_id.LanguageModel(langs, np.array(kind), np.array(key, object), np.array(lang), np.array(count, float))


def test_all_of_a_long_run_counts():
    assert list(language_id.grams_of("a" * 64 + "xyz", 3))[-2:] == ["xyz", "yz>"] and len(list(language_id.grams_of("a" * 500, 1))) == 500
    model = as_model(["aa", "bb"], {1: {"a": {"aa": 9, "bb": 1}, "b": {"aa": 1, "bb": 9}}})
    for n in (5000, 200_000):
        memo = language_id.Memo(model)
        assert language_id.predict(["a" * 64 + "b" * n], memo)[0][0] == "bb" and len(memo) == 0


def brute_languages(learn, asked):
    """Word-first backoff by dictionaries. learn: (lang, text); asked: texts."""
    import re
    from collections import Counter

    letters = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    tables = [{} for _ in range(6)]
    for lang, text in sorted(set(learn)):
        for w in letters.findall(text.lower()):
            for n in range(6):
                tables[n].setdefault(lang, Counter()).update([w] if n == 0 else grams(w, n))
    langs = sorted(tables[0])
    for n, t in enumerate(tables):
        for lang, c in t.items():
            t[lang] = dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language_id.WORDS if n == 0 else language_id.GRAMS])
    keys = [set().union(*t.values()) for t in tables]
    logs = lambda n, key: [math.log((tables[n][x].get(key, 0) + 0.5) / (sum(tables[n][x].values()) + 0.5 * len(keys[n]))) for x in langs]
    known = {}

    def value(w):
        if w not in known:
            known[w] = logs(0, w) if w in keys[0] else [0.0] * len(langs)
            if w not in keys[0]:
                for n in range(5, 0, -1):
                    if hits := [logs(n, g) for g in grams(w, n) if g in keys[n]]:
                        known[w] = [sum(h) / len(hits) for h in zip(*hits, strict=True)]
                        break
        return known[w]

    found = []
    for text in asked:
        words = letters.findall((text or "").lower())
        if not any(c.isalpha() for c in text or ""):
            found.append(("und", 0.0))
            continue
        sums = [sum(v) for v in zip(*map(value, words), strict=True)]
        top = max(sums)
        found.append((langs[sums.index(top)], 1 / sum(math.exp(v - top) for v in sums)))
    return found


def test_whole_table_equals_brute_force(spark):
    import zlib

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in t["doc_id"]}
    learn = [(x, text) for i, x, text in zip(t["doc_id"], t["lang"], t["text"], strict=True) if x is not None and text is not None and not held[i]]
    expected = dict(zip(t["doc_id"], brute_languages(learn, t["text"]), strict=True))
    rows = language_id.op4_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(expected)
    for r in rows:
        lang, score = expected[r.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, held[r.doc_id]) and r.score == pytest.approx(score, abs=1e-6)


def test_every_language_can_be_predicted_however_many(spark):
    """150 languages, each with a word and a letter of its own; one has only copies of one text."""
    rows = [(i, f"common w{chr(0x4E00 + i % 150)}{chr(0x4E00 + i % 150)} common", f"l{i % 150:03}") for i in range(450)] + [(1000 + i, "lonely copies", "zz") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for how in ({}, {"sample": 151}, {"docs_per_lang": 1, "entries": 300}):
        model = language_id.train(docs, **how)
        assert len(model.langs) == 151
    model = language_id.train(docs)
    found = language_id.predict([f"w{chr(0x4E00 + i)}{chr(0x4E00 + i)}" for i in range(150)] + ["lonely"], language_id.Memo(model))
    assert [f[0] for f in found] == model.langs


def test_sample_is_bounded_and_learns_copies_once(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('word', if(id % 3 = 0, 0, id)) as text", "if(id % 10 = 0, 'b', 'a') as lang")
    sizes = {r.lang: r["count"] for r in language_id.training_sample(docs, docs_per_lang=500).groupBy("lang").count().collect()}
    assert 250 < sizes["a"] < 420 and 250 < sizes["b"] < 420  # a third are copies
    assert {r.lang: r["count"] for r in language_id.training_sample(docs, docs_per_lang=30_000).groupBy("lang").count().collect()} == {"a": 12001, "b": 1334}
