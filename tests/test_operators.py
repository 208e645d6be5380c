"""Small hand-checked cases: the rules that a query over a table would not show."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orpheon.functions import music, text
from orpheon.functions.vectors import softmax
from orpheon.operators import align, geometry, hmm, metrics, retrieval, tables, tokens
from orpheon.sources import readers, sinks
from orpheon.streaming import online


def items(spark, rows):
    df = spark.createDataFrame(rows, "id long, vec array<double>, work long, cond int, var int, grp int")
    return retrieval.items(df, F.col("id"), F.col("vec"), F.col("work"), F.col("grp"), F.col("cond"), F.col("var"))


def test_perfect_retrieval_and_self_exclusion(spark):
    rows = [(0, [1.0, 0.0], 1, 0, 0, None), (1, [1.0, 0.01], 1, 1, 0, None), (2, [0.0, 1.0], 2, 0, 0, None), (3, [0.01, 1.0], 2, 1, 0, None)]
    m = retrieval.metrics(retrieval.relevant_ranks(items(spark, rows)), (1,)).first()
    assert (m.map, m.mrr, m.r_precision, m.median_rank, m.n_queries) == (1.0, 1.0, 1.0, 1.0, 4)
    assert retrieval.relevant_ranks(items(spark, rows)).where("q = g").count() == 0


def test_unique_works_have_no_queries(spark):
    rows = [(k, [1.0, float(k)], k, 0, 0, None) for k in range(4)]
    m = retrieval.metrics(retrieval.relevant_ranks(items(spark, rows)), (1,)).first()
    assert m.n_queries == 0 and m.map is None


def test_ties_rank_by_id_and_tiles_agree(spark):
    rng = random.Random(0)
    rows = [(k, [float(rng.randrange(3)), float(rng.randrange(3)), 1.0], k % 4, k % 3, k // 7 % 2, k % 2) for k in range(40)]
    for how in ({}, {"twins": True}, {"within_condition": True}):
        one = sorted(map(tuple, retrieval.relevant_ranks(items(spark, rows), **how).collect()))
        many = sorted(map(tuple, retrieval.relevant_ranks(items(spark, rows), tile=7, **how).collect()))
        assert one == many and one
    v = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows}
    grp = {r[0]: r[5] for r in rows}
    for q, g, rk, *_ in sorted(map(tuple, retrieval.relevant_ranks(items(spark, rows)).collect())):
        order = sorted((k for k in v if k != q and grp[k] == grp[q]), key=lambda k: (-round(float(v[q] @ v[k]), 12), k))
        assert order.index(g) + 1 == rk


def test_empty_grid_cells_are_zero(spark):
    rows = [(0, [1.0, 0.0], 1, 0, 0, None), (1, [1.0, 0.1], 1, 1, 0, None), (2, [0.0, 1.0], 2, -1, 0, None)]
    frame = items(spark, rows)
    cells = {(r.query_cond, r.target_cond): (r.map, r.n_queries) for r in retrieval.condition_grid(retrieval.relevant_ranks(frame, within_condition=True), frame).collect()}
    assert cells == {(0, 0): (0.0, 0), (0, 1): (1.0, 1), (1, 0): (1.0, 1), (1, 1): (0.0, 0)}


def test_whitening(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    n, mean, cov = geometry.moments(df, "v")
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    flat = geometry.whiten(df, "v", 0.0).orderBy("id").collect()
    centered = geometry.center(df, "v").orderBy("id").collect()
    assert np.allclose([r.v for r in flat], [r.v for r in centered])
    with pytest.raises(ValueError):
        geometry.treatment(df, "v", "nonsense")


def test_music_rules(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first().x
    assert [f(music.f0_to_midi(F.lit(x))) for x in (440.0, 0.0, -3.0, 1e9, 1e-9)] == [69, -1, -1, 127, 0]
    assert [f(music.chord_class(F.lit(c))) for c in ("C:maj7", "Bb:min7/b3", "N", "F#:sus4", "Cb", "H:maj")] == [0, 22, 24, -1, 11, None]
    assert [f(music.chord_name(F.lit(k))) for k in (-1, 0, 13, 24)] == ["X", "C:maj", "C#:min", "N"]
    assert f(text.file_stem(F.lit("a\\b/c.d.wav"))) == "c.d" and f(text.file_stem(F.lit(".hidden"))) == ".hidden"
    assert f(text.variation_id(F.lit("052_A_7"), r"_(\d+)$")) == 7 and f(text.variation_id(F.lit("none"), r"_(\d+)$")) == -1
    assert f(text.safe_filename(F.lit("..."))) == "_unnamed"


def test_metric_edges(spark):
    lists = spark.createDataFrame([([], []), ([1.0], []), ([], [1.0]), ([1.0, 2.0], [1.05, 9.0])], "est array<double>, ref array<double>")
    rows = metrics.boundary_metrics(lists.withColumn("id", F.monotonically_increasing_id()), "id", "ref", "est", (0.1,)).collect()
    assert sorted(r.f_0 for r in rows) == [0.0, 0.0, 0.5, 1.0]
    both = metrics.event_f_measure(lists.limit(0), "est", "ref").first()
    assert both.matched is None or both.f1 in (0.0, 1.0)
    rng = random.Random(1)
    for _ in range(100):  # greedy is optimal
        a, b = [rng.random() * 3 for _ in range(5)], [rng.random() * 3 for _ in range(5)]
        best = 0
        for mask in range(1 << 5):
            chosen = [x for k, x in enumerate(a) if mask >> k & 1]
            from itertools import permutations

            if len(chosen) > best and any(all(abs(x - y) <= 0.3 for x, y in zip(chosen, p, strict=False)) for p in permutations(b, len(chosen))):
                best = len(chosen)
        assert metrics.match_count(a, b, 0.3) == best
    frames = spark.createDataFrame([([1, 13, -1], [1, 1, -1, 4])], "p array<int>, t array<int>")
    assert metrics.frame_accuracy(frames, "p", "t").first().accuracy == 0.5
    assert metrics.frame_accuracy(frames, "p", "t", modulo=12).first().accuracy == 1.0
    none = spark.createDataFrame([([1], [-1])], "p array<int>, t array<int>")
    assert metrics.frame_accuracy(none, "p", "t").first().accuracy == 0.0
    with pytest.raises(Exception, match="tolerance"):
        metrics.frame_accuracy(spark.createDataFrame([([1], [1, 1, 1, 1, 1])], "p array<int>, t array<int>"), "p", "t").collect()
    relabelled = spark.createDataFrame([(0, "a", 7), (0, "a", 7), (0, "b", 9)], "k int, r string, e int")
    assert metrics.pairwise_f(relabelled, ["k"], "r", "e").first().f == 1.0
    wer = spark.createDataFrame([("a b c".split(), "a c".split()), ([], [])], "r array<string>, h array<string>")
    assert metrics.error_rate(wer, "r", "h").first().rate == pytest.approx(1 / 3)
    assert spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("x")).first().x == [0.5, 0.5]


def test_alignment_rules(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first().x
    values = F.array(*(F.lit(x) for x in (0.1, 0.9, 0.9, 0.2, 0.8, 0.1, 0.7)))
    assert f(align.peaks(values, 0.5, 1)) == [1, 2, 4, 6] and f(align.peaks(values, 0.5, 3)) == [1, 4]
    assert f(align.widen(F.array(*(F.lit(x) for x in (0, 0, 1, 0, 0, 0))), 2)) == [0.25, 0.5, 1.0, 0.5, 0.25, 0.0]
    assert f(align.sliding_chunks(F.lit(23), 10, 0.5, "overlap")) == [0, 5, 10, 13] and f(align.sliding_chunks(F.lit(7), 10, 0.5, "discard")) == []
    frames = spark.createDataFrame([(1, 0, 0.0, k, float(k)) for k in range(6)], "u int, clip int, clip_start double, frame int, t double")
    chords = spark.createDataFrame([(1, 1.0, 5), (1, 3.0, 24), (1, 4.0, 7)], "u int, start double, chord int")
    assert [r.chord for r in align.chord_frames(frames, chords, "u").orderBy("frame").collect()] == [24, 5, 5, 5, 7, 7]


def test_splits():
    sizes = {f"g{k}": k % 4 + 1 for k in range(17)}
    folds = tables.group_folds(sizes, 5, 0.15, 3)
    tested = [g for f in folds for g, s in f.items() if s == "test"]
    assert sorted(tested) == sorted(sizes) and all(set(f) == set(sizes) for f in folds)
    with pytest.raises(ValueError):
        tables.group_folds({"a": 1, "b": 1}, 5)
    with pytest.raises(ValueError):
        tables.group_folds({f"g{k}": 1 for k in range(2)}, 2)
    rr = tables.round_robin_folds([str(k) for k in range(20)])
    assert sorted(x for f in rr for x, s in f.items() if s == "test") == sorted(str(k) for k in range(20))
    assert tables.ratio_split(["a", "b", "c"], given={"a": "test"})["a"] == "test"


def naive_viterbi(a, b, init, obs):
    import itertools

    best = 0.0
    for path in itertools.product(range(len(a)), repeat=len(obs)):
        p = max(init[s] * a[s][path[0]] for s in range(len(a))) * b[path[0]][obs[0]]
        for x, y, o in zip(path, path[1:], obs[1:], strict=False):
            p *= a[x][y] * b[y][o]
        best = max(best, p)
    return best


def test_viterbi_and_forward():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(2), 3)
        init, obs = rng.dirichlet(np.ones(3)), rng.integers(0, 2, 5)
        prev, to = np.nonzero(a)
        t = hmm.Transitions.build(to, prev, a[prev, to])
        path, score = hmm.viterbi(t, np.arange(3), np.log(b.T[obs]), init)
        own = max(init[s] * a[s][path[0]] for s in range(3)) * b[path[0]][obs[0]]
        for x, y, o in zip(path, path[1:], obs[1:], strict=False):
            own *= a[x][y] * b[y][o]
        assert score == pytest.approx(math.log(naive_viterbi(a, b, init, obs))) == pytest.approx(math.log(own))
        alpha = init
        for row, o in zip(hmm.forward(t, np.arange(3), b.T[obs], init), obs, strict=True):
            alpha = (alpha @ a) * b[:, o]
            alpha /= alpha.sum()
            assert np.allclose(row, alpha)
    blocked = hmm.viterbi(t, np.arange(3), np.full((2, 3), -np.inf))
    assert len(blocked[0]) == 0 and blocked[1] == -math.inf
    with pytest.raises(ValueError):
        hmm.Transitions.build([0], [0], [0.5])


def test_beats_are_found():
    model = hmm.BeatModel(20.0, 60, 180)
    x = np.full(200, 0.02)
    x[3::10] = 0.9
    assert np.allclose(hmm.track_beats(x, model)[1:-1], np.arange(3, 200, 10)[1:-1] / 20)
    assert len(hmm.track_beats(np.zeros(50), model)) == 0 and len(hmm.track_beats(x, model, 0.95)) == 0
    both = np.full((240, 2), 0.02)
    both[2::10, 0] = 0.8
    both[2::40] = [0.05, 0.85]
    found = hmm.track_downbeats(both, [hmm.BeatModel(20.0, 90, 160, beats=b) for b in (3, 4)])
    assert set(found[:, 1]) == {1, 2, 3, 4}


def test_online_equals_offline(spark, tmp_path):
    x = [0.9 if k % 10 == 3 else 0.02 for k in range(60)]
    frames = spark.createDataFrame([(u, k, x[(k + 3 * u) % 60]) for u in range(3) for k in range(60)], "key long, frame long, activation double")
    for lo in (0, 25):
        frames.where(f"frame >= {lo} and frame < {lo + 25 if lo == 0 else 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    got = online.run_to_table(online.online_beats(stream, 20.0, min_bpm=60, max_bpm=180), "append", "t_online").collect()
    want = online.offline_beats(frames, 20.0, min_bpm=60, max_bpm=180).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_patches(spark):
    def run(text, column):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]

    abc = "X:1\nK:C\n|: a | b || c :|\n"
    assert run(abc, tokens.patches) == ["X:1\n", "K:C\n", "|: a |", " b ||", " c :|\n"]
    assert run("ticks_per_beat 480\nnote 1\nnote 2\ntempo 3\n", tokens.patches) == ["ticks_per_beat 480\n", "note 1\t2\n", "tempo 3\n"]
    assert run("a|b\nL:1/8\nno bar\n|\n||x|\u00e9|\n%%c\n", tokens.patches) == ["a|\n", "||x|", "e|\n", "%%c\n"]
    assert run("", tokens.patches) == [] and run(None, tokens.patches) == []
    assert run("ab", lambda c: tokens.code_points(c, 6)) == [1, 97, 98, 2, 0, 0] and run("abcdef", lambda c: tokens.code_points(c, 4)) == [1, 97, 98, 99]
    texts = lambda **how: run(abc, lambda c: F.transform(tokens.tokenise(c, 16, 2, **how), tokens.patch_text))
    assert texts() == ["X:1\n", "K:C\n"] and texts(cut="tail") == [" b ||", " c :|\n"] and texts(cut="middle") == ["|: a |", " b ||"]
    rows = run("X:1\n", lambda c: tokens.tokenise(c, 4, 4, pad=True, special=True))
    assert rows == [[1] * 4, [1, 88, 58, 49], [2] * 4, [0] * 4]


def test_windows_fall_evenly_on_free_places():
    from orpheon.operators import prepare

    found = prepare.free_windows([(2.0, 3.0), (2.5, 4.0), (9.0, 9.5)], 12.0, 4000, "x")
    assert len(found) == 4000 and all(0 <= a and b <= 12 and (b <= 2 or 4 <= a and b <= 9 or a >= 9.5) for a, b in found)
    longest = [a for a, b in found if b - a > 1.4]  # length 1.5: room 0.5, 3.5 and 1
    shares = [sum(lo <= a <= hi for a in longest) / len(longest) for lo, hi in ((0, 0.5), (4, 7.5), (9.5, 10.5))]
    assert all(abs(s - w) < 0.04 for s, w in zip(shares, (0.1, 0.7, 0.2), strict=True))


def wav(samples, rate=100, channels=1):
    data = struct.pack(f"<{len(samples)}h", *samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16, b"data", len(data))
    return head + data


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"audio_path": "a\\\\b.wav", "sample_rate": 10, "work_id": 3}\n{"audio_path": "c.wav"}\n')
    rows = readers.manifest(spark, str(tmp_path / "m.jsonl"), "cover_retrieval").collect()
    assert sorted(r.audio_path for r in rows) == ["a/b.wav", "c.wav"] and {r.work_id for r in rows} == {3, None}
    (tmp_path / "f.csv").write_text("0.0,440\n0.1,0\n")
    assert readers.numeric_csv(spark, str(tmp_path / "f.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("0.0\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.numeric_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "s.txt").write_text("0.0 Intro\n2.5 verse_a\n2.5 noise\n9.0 end\n")
    spans = readers.segment_text(spark, str(tmp_path / "s.txt"), {"intro": "intro", "verse_a": "verse"}).collect()
    assert sorted((r.start, r.stop, r.label) for r in spans)[0] == (0.0, 2.5, "intro")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.wav").write_bytes(wav(list(range(25))))
    (tmp_path / "w" / "y.wav").write_bytes(b"junk")
    heads = {r.path[-5:]: r for r in readers.wav_headers(spark, str(tmp_path / "w")).collect()}
    assert (heads["x.wav"].sample_rate, heads["x.wav"].num_samples, heads["x.wav"].channels) == (100, 25, 1) and heads["y.wav"].sample_rate is None
    assert readers.wav_slices(spark, str(tmp_path / "w"), 10).count() == 3
    assert readers.files(spark, str(tmp_path / "w"), ("WAV",)).count() == 2
    df = spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [3.0, 4.0])], "clip_id string, vec array<double>")
    sinks.embeddings(df, str(tmp_path / "cache"), "enc", "task", "h", 2)
    with pytest.raises(Exception, match="width"):
        sinks.embeddings(df, str(tmp_path / "cache"), "enc", "task", "h", 3)
    report = sinks.cache_report(spark, str(tmp_path / "cache")).first()
    assert report.clips == 2 and report.bytes > 0
    assert readers.cached_embeddings(spark, str(tmp_path / "cache"), df.limit(1)).count() == 1
    sinks.split_jsonl(spark.createDataFrame([(0, "train", 1), (0, "test", 2)], "fold int, split string, x int"), str(tmp_path / "splits"))
    assert sorted(p.name for p in (tmp_path / "splits" / "_fold=0").iterdir()) == ["_split=test", "_split=train"]
    stems = spark.createDataFrame([("a",), ("b",)], "stem string")
    clips = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "stem string, vec array<double>")
    assert readers.consolidated(stems.limit(1), clips).first().vec == [2.0, 4.0]
    with pytest.raises(Exception, match="no cached clip"):
        readers.consolidated(stems, clips).collect()


def test_chords_in_keys():
    major = music.SCALES["major"]
    assert music.chord_of(1, 5, 0, major) == (0, (4, 3)) and music.chord_of(5, 7, 0, major) == (7, (4, 3, 3))
    assert music.chord_of(1, 5, 0, major, suspensions=(4,)) == (0, (5, 2)) and music.chord_of(1, 5, 0, major, adds=(6,)) == (0, (4, 3, 14))
    assert music.chord_of(1, 5, 0, major, omits=(5,)) == (0, (4,)) and music.chord_of(5, 7, 0, major, alterations=("b9",)) == (7, (4, 3, 3, 3))
    assert music.chord_of(1, 5, 0, major, borrowed="minor") == (0, (3, 4)) and music.chord_of(5, 7, 0, major, applied=5) == (2, (4, 3, 3))
    with pytest.raises(ValueError):
        music.chord_of(1, 5, 0, major, omits=(7,))


def test_preparation(spark):
    from orpheon.operators import prepare

    taken = [(1.0, 2.0), (5.0, 6.5)]
    for a, b in prepare.free_windows(taken, 20.0, 30, "s"):
        assert 0 <= a < b <= 20 and all(b <= x or a >= y for x, y in taken)
    assert prepare.free_windows(taken, 0.5, 5, "s") == [] and prepare.free_windows([], 9, 3, "s") == []
    assert prepare.selection("1,3-5, 99,x", 6) == [1, 3, 4, 5] and prepare.selection("5-3", 6) == [3, 4, 5]
    assert prepare.selection("none", 6) == [] and prepare.selection("q", 6) is None and prepare.selection("all", 2) == [1, 2]
    assert prepare.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert prepare.guard_schedule(None, {"x": 1}) == prepare.guard_schedule(prepare.schedule_hash({"x": 1}), {"x": 1})
    with pytest.raises(ValueError):
        prepare.guard_schedule("other", {"x": 1})
    with pytest.raises(ValueError):
        prepare.frame_count(10.0, 0.33)
    fit, rest = prepare.work_disjoint([1, 1, 2, 3, 3], 0.5)
    assert fit and rest and not fit & rest
    with pytest.raises(Exception, match="too few"):
        prepare.require_share(spark.range(2), 100, 0.1).collect()
    with pytest.raises(Exception, match="not in order"):
        spark.range(1).select(prepare.sorted_events(F.array(F.lit(2.0), F.lit(1.0)))).collect()


def test_audio_arrays(spark):
    from orpheon.functions import audio

    wave = F.array(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(3.0), F.lit(5.0)))
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert f(audio.channels(wave, 1, "mix")) == [[2.0, 4.0]] and f(audio.channels(wave, 3)) == [[1.0, 3.0], [3.0, 5.0], [3.0, 5.0]]
    assert f(audio.crop(wave[0], 3)) == [1.0, 3.0, 0.0]
    tone = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.sin(k * (2 * math.pi * 8 / 64)))
    spectrum = np.array(f(audio.spectrogram(tone, 64, 16)))
    assert (spectrum[3:-3].argmax(axis=1) == 8).all()


def test_patterns_switch_at_bar_ends():
    three, four = (hmm.BeatModel(20.0, 100, 140, beats=b) for b in (3, 4))
    both = hmm.PatternModel([three, four], 0.1)
    to, prev, p = both.transitions.triples()
    assert np.allclose(np.bincount(prev, weights=p), 1) and both.transitions.n == three.transitions.n + four.transitions.n
    crossing = both.pattern[to] != both.pattern[prev]
    assert crossing.any() and (both.positions[to[crossing]] == 0).all()
    x = np.full((240, 2), 0.02)
    x[2::10, 0] = 0.8
    x[2::40] = [0.05, 0.85]
    path, score = hmm.viterbi(both.transitions, both.column, np.log(both.densities(x)))
    assert (both.pattern[path[20:-20]] == 1).all() and np.isfinite(score)
    with pytest.raises(ValueError):
        hmm.PatternModel([three, four], [[0.5, 0.4], [0.0, 1.0]])


def test_piece_files(spark, tmp_path):
    (tmp_path / "pieces.csv").write_text("piece_id,url,title\n00001,u, One \n,u,none\n")
    assert [tuple(r) for r in readers.piece_table(spark, str(tmp_path / "pieces.csv")).collect()] == [("00001", "One")]
    (tmp_path / "pairs.csv").write_text("piece_id,other,split\n1,x,train\n2,x,junk\nq,x,val\n12,x,test\n12,y,test\n")
    assert sorted(map(tuple, readers.piece_splits(spark, str(tmp_path / "pairs.csv")).collect())) == [("00001", "train"), ("00012", "test")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "00001.json").write_text('{"Function": [{"Function": "A", "BarRange": [1, 4]}, {"Function": "?", "BarRange": [5, 8]}, {"Function": "A", "BarRange": [9, 9]}, {"Function": "A", "BarRange": [1]}]}')
    (tmp_path / "a" / "00002.json").write_text("no json")
    assert [tuple(r) for r in readers.function_annotations(spark, str(tmp_path / "a"), {"A": "verse"}).collect()] == [("00001.json", 1, 4, "verse")]


def test_small_tiles_give_the_same_set_valued_ranks(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 3, rng.sample("abcd", rng.randrange(3)), [f"o{k // 4}"]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp long, letters array<string>, occ_ids array<string>")
    whole, tiled = (retrieval.multilabel_map(df, tile=t).first() for t in (4096, 4))
    assert whole.n_queries == tiled.n_queries > 10 and whole.map == pytest.approx(tiled.map)
    aps = []
    for q in rows:
        gallery = [g for g in rows if g[2] == q[2] and g[0] != q[0] and not set(g[4]) & set(q[4])]
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        order = sorted(gallery, key=lambda g: (-round(float(unit(q[1]) @ unit(g[1])), 12), g[0]))
        hits = [k for k, g in enumerate(order, 1) if set(g[3]) & set(q[3])]
        if hits:
            aps.append(sum((n + 1) / k for n, k in enumerate(hits)) / len(hits))
    assert whole.n_queries == len(aps) and whole.map == pytest.approx(sum(aps) / len(aps))
