import pyarrow.parquet as pq

import corpus_pipeline
from orpheon.llm import decontaminate, language_id, line_dedup, sentencepiece
from orpheon.llm.common import id_crc, release

from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    source = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    docs = {i: t for i, t in zip(source["doc_id"], source["text"], strict=True)}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(table.where(id_crc() % 4 != 2))
    memo = language_id.Memo(model)
    kept = {i: t for i, t in docs.items() if (p := language_id.predict([t], memo)[0])[0] != "und" and p[1] >= 0.5}
    assert len(kept) > 0.9 * len(docs)

    # Lines: classes by comparing every two different lines.
    names = {}
    for t in kept.values():
        for x in line_dedup.lines_of((t or "").encode()):
            names.setdefault(x, len(names))
    names.pop(b"", None)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = sorted((x for x in names if len(x) >= line_dedup.SHORT), key=len)
    for k, a in enumerate(long):
        for b in long[k + 1 :]:
            if len(b) - len(a) > 2:
                break
            most = min(2, len(a) // 12)
            if line_dedup.edit_distance(a, b, most) <= most:
                parent[find(a)] = find(b)
    places = {}
    for i in sorted(kept):
        for no, x in enumerate(line_dedup.lines_of((kept[i] or "").encode())):
            if x:
                places.setdefault(find(x), []).append((i, no, x))
    cleaned = {}
    for i, t in kept.items():
        rows, sizes = [], []
        for no, x in enumerate(line_dedup.lines_of((t or "").encode())):
            if x:
                sizes.append(len(x))
                members = places[find(x)]
                docs_of = len({(d, y) for d, _, y in members})
                if len(members) > 1:
                    rows.append({"no": no, "size": len(x), "first_doc": members[0][0], "first_hash": 0, "first_no": members[0][1], "docs": docs_of})
        gone = set(line_dedup.lines_to_remove(i, 0, sizes, rows))
        cleaned[i] = "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone) if gone else t
    single = {i for i, (_, root) in near_brute(list(cleaned.items()), 80).items() if root == i}

    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    index = decontaminate.Index(list(zip(items["item_id"], items["text"], strict=True)))
    import numpy as np

    def leaks(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return bool(index.search(raw, np.array([0, len(raw)]))[0])

    expected = {i for i in single if not leaks(cleaned[i])}
    assert any(leaks(cleaned[i]) for i in single) and len(single) < len(kept) and any(cleaned[i] != kept[i] for i in kept)

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == expected
    vocabulary = sentencepiece.Vocabulary(open(sentencepiece.MODEL, "rb").read())
    for i, r in rows.items():
        assert r.round_trip and sentencepiece.decode(r.piece_ids, vocabulary) == cleaned[i]


def test_stages_take_odd_tables(spark):
    frame = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (3, "the cat sat on the mat\n" * 3, "en", None, 9), (3, "the cat sat on the mat\n" * 3, "en", None, 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (frame, frame.limit(0)):
            out = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert sorted(out.columns) == sorted(frame.columns), name
            out.collect()
    release(spark)
