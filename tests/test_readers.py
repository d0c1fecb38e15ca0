from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessitura.sources import readers as R
from tessitura.sources import writers as K


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segments_and_speakers(spark, tmp_path):
    seg = put(tmp_path, "segments.txt", "u1 r1.wav 0.0 1.5\nu2 r1.wav 1.5 2.0\n\nu3 r2.wav 0 4\n")
    assert rows(R.read_segments(spark, seg)) == [("u1", "r1", 0.0, 1.5), ("u2", "r1", 1.5, 2.0), ("u3", "r2", 0.0, 4.0)]
    assert rows(R.read_recordings(spark, put(tmp_path, "r.txt", "u1 r1.wav\nu2 r2.flac 0 1\n"))) == [("u1", "r1"), ("u2", "r2")]
    put(tmp_path, "utt2spk.txt", "u1 a\nu2 a\nu3 b\n")
    corpus = R.Corpus.load(spark, str(tmp_path), "c")
    assert [(r.utt, r.duration) for r in corpus.durations().orderBy("utt").collect()] == [("u1", 1.5), ("u2", 0.5), ("u3", 4.0)]
    K.save_corpus(corpus.subcorpus(spark.createDataFrame([("u3",)], "utt string"), "d"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/d/segments")).count() == 1
    assert rows(R.read_gender(spark, put(tmp_path, "g.txt", "a m\nb f\n"))) == [("a", "m"), ("b", "f")]
    for bad in ("u1 r1.wav 0.0\n", "u1 r1 0 1\n"):
        with pytest.raises(Exception, match="a segment is"):
            R.read_segments(spark, put(tmp_path, "bad.txt", bad)).collect()
    with pytest.raises(Exception, match="spk and m or f"):
        R.read_gender(spark, put(tmp_path, "bad2.txt", "a x\n")).collect()


def test_corpus_with_text_and_lexicon(spark, tmp_path):
    put(tmp_path, "segments.txt", "u1 r1.wav 0 1\nu2 r1.wav 1 2\n")
    put(tmp_path, "utt2spk.txt", "u1 a\nu2 a\n")
    put(tmp_path, "text.txt", "u1 one two\nu2\n")
    put(tmp_path, "lexicon.txt", "one W AH N\ntwo T UW\ntwo T AH\n")
    corpus = R.Corpus.load(spark, str(tmp_path), "c")
    assert rows(corpus.text) == [("u1", ["one", "two"]), ("u2", [])]
    assert rows(corpus.lexicon) == [("one", ["W", "AH", "N"]), ("two", ["T", "AH"]), ("two", ["T", "UW"])]
    assert corpus.subcorpus(spark.createDataFrame([("u2",)], "utt string"), "d").text.count() == 1
    put(tmp_path, "utt2spk.txt", "u1 a\nu1 b\n")
    put(tmp_path, "text.txt", "u1 one three\nu9 two\n")
    with pytest.raises(ValueError) as told:
        R.Corpus.load(spark, str(tmp_path), "c")
    for part in ("utt2spk: an utterance has several rows (u1)", "no speaker (u2)", "no segment (u9)", "not in the lexicon (three)"):
        assert part in str(told.value)
    assert R.Corpus.load(spark, str(tmp_path), "c", validate=False).segments.count() == 2


def test_items_with_and_without_their_feature_columns(spark, tmp_path):
    path = put(tmp_path, "a.item", "#file onset offset #phone prev-phone speaker\nf1 0.1 0.2 AA SIL s1\n")
    assert rows(R.read_items(spark, path)) == [("f1", "0.1", "0.2", "AA", "SIL", "s1")]
    assert R.read_items(spark, path, features=False).columns == ["phone", "prev_phone", "speaker"]


def test_archive_has_a_row_for_each_frame(spark, tmp_path):
    path = put(tmp_path, "a.txt", "utt1  [\n  1 2\n  3 4 ]\nutt2  [\n  5 6 ]\n")
    got = [(r.item, r.frame, round(r.t, 4), r.x) for r in R.read_archive(spark, path).orderBy("item", "frame").collect()]
    assert got == [("utt1", 0, 0.0125, [1.0, 2.0]), ("utt1", 1, 0.0225, [3.0, 4.0]), ("utt2", 0, 0.0125, [5.0, 6.0])]
    wide = R.to_wide(R.read_archive(spark, path))
    assert rows(R.to_long(wide).select("item", "frame")) == [("utt1", 0), ("utt1", 1), ("utt2", 0)]
    K.append_features(R.read_archive(spark, path), str(tmp_path / "f"))
    assert R.read_features(spark, str(tmp_path / "f"), "utt2").count() == 1


def test_alignment_units_and_durations(spark, tmp_path):
    a = put(tmp_path, "ali.txt", "u1 0 0.1 0.9 AA word\nu1 0.1 0.3 0.5 B\n")
    assert rows(R.read_alignment(spark, a).select("post", "phone")) == [(0.5, "B"), (0.9, "AA")]
    assert rows(R.read_utterance_ids(spark, a)) == [("u1",)]
    units = R.read_unit_ids(spark, put(tmp_path, "state.txt", "AA 0 3\nB 1 4\n")).select("unit", "phone", "hmm_state", "pdf_id")
    assert rows(units) == [(0, "AA", 0, 3), (1, "B", 1, 4)]
    assert [(r.unit, r.phone) for r in R.read_unit_ids(spark, put(tmp_path, "phone.txt", "AA B C\n")).orderBy("unit").collect()] == [(0, "AA"), (1, "B"), (2, "C")]
    d = {r.unit: r.duration for r in R.read_durations(spark, put(tmp_path, "dur.txt", "1 2 3\n\n4\n")).collect()}
    assert d == {0: 2.0, 1: None, 2: 4.0}
    assert R.count_lines(spark, a).collect()[0].n == 2 and R.read_token_lists(spark, str(tmp_path / "phone.txt")).collect()[0].n == 3


def test_models_in_both_orientations(spark, tmp_path):
    one = spark.createDataFrame([(-0.5, [0.0], [[1.0]]), (-1.0, [2.0], [[3.0]])], "logpi double, mu array<double>, Sigma array<array<double>>")
    one.withColumn("component", F.col("mu")[0].cast("int")).write.parquet(str(tmp_path / "a"))
    one.agg(F.sort_array(F.collect_list(F.struct("mu", "logpi", "Sigma"))).alias("clusters")).write.parquet(str(tmp_path / "b"))
    assert rows(R.read_model(spark, str(tmp_path / "a")).select("log_weight", "mean")) == rows(R.read_model(spark, str(tmp_path / "b")).select("log_weight", "mean"))


def test_results_by_file_name(spark, tmp_path):
    for name in ("wsj_mfcc.csv", "csj_mfcc.csv", "csj_raw.csv"):
        put(tmp_path, name, "contrast,error\na-b,0.1\na-c,0.3\n")
    got = R.fetch_results(spark, str(tmp_path), "contrast string, error double", lambda f: f.contains("mfcc"), lambda f: {"corpus": F.split_part(f, F.lit("_"), F.lit(1))})
    assert rows(got.groupBy("corpus").count()) == [("csj", 2), ("wsj", 2)]
    mean = lambda df: df.groupBy("contrast").agg(F.avg("error").alias("error"))
    cache = str(tmp_path / "cache")
    for _ in range(2):
        est, boot = R.apply_analysis(got, mean, got, cache)
        assert est.count() == boot.count() == 2
    assert R.list_files(spark, str(tmp_path), "*.csv").count() == 3
    assert rows(R.templated(spark.createDataFrame([("a", 3)], "x string, y int"), "%s/%03d.txt", "x", "y").select("path")) == [("a/003.txt",)]
    indexed = put(tmp_path, "i.csv", ",phone,d\n0,AA,1.5\n1,B,2\n")
    assert rows(R.read_indexed_csv(spark, indexed, "phone string, d double")) == [("AA", 1.5), ("B", 2.0)]


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([("b", "r1", 0.0, 1.0), ("B", "r2", 0.0, 2.0)], R.SEGMENTS)
    K.save_lines(s, ["utt", "rec"], str(tmp_path / "lines"))
    text = "".join(p.read_text() for p in (tmp_path / "lines").glob("part-*"))
    assert text == "B r2\nb r1\n"
    t = K.recording_tables(s, spark.createDataFrame([("b", "s")], R.UTT2SPK), "/wavs/")
    assert rows(t["wav.scp"]) == [("r1 /wavs/r1.wav",), ("r2 /wavs/r2.wav",)] and rows(t["utt2spk"]) == [("b s",)]
    x = spark.createDataFrame([([float(i)] * 4,) for i in range(100)], "x array<double>").coalesce(1)
    K.save_matrix(x, str(tmp_path / "m"), most_bytes=8 * 4 * 30, width=4)
    assert len(list((tmp_path / "m").glob("part-*"))) == 4 and R.read_matrix_parts(spark, [str(tmp_path / "m")]).count() == 100
    K.save_items(s, str(tmp_path / "items"))
    assert R.read_items(spark, str(tmp_path / "items")).columns == ["utt", "rec", "start", "stop"]
    s.withColumns({"n_subsets": F.lit(2), "subset_id": F.lit(1)}).transform(lambda d: K.save_subsets(d, str(tmp_path / "sub")) or d)
    assert (tmp_path / "sub/n_subsets=2/subset_id=1").exists()
    two = s.withColumns({"n_subsets": F.lit(2), "subset_id": F.when(F.col("utt") == "b", 0).otherwise(1)})
    K.save_subset_files(two, str(tmp_path / "files"))
    assert rows(R.read_segments(spark, str(tmp_path / "files/file=segments__2subsets__subset2.txt"))) == [("B", "r2", 0.0, 2.0)]
    K.save_stats(s.groupBy("rec").agg(F.sum("stop").alias("total")), str(tmp_path / "stats"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "stats"))) == [("r1", "1.0"), ("r2", "2.0")]
    assert [o for o in range(1, 76) if K.is_checkpoint(o, 75)] == [1, 2, 4, 8, 16, 32, 64, 75]
