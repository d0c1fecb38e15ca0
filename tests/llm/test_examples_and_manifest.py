"""Merkle manifest, fill-in-middle examples and toxicity, against versions that go row by row."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import merkle, toxicity
from tessitura.llm.infill import boundaries, fill_in_middle, op12_infill, restored
from tessitura.llm.merkle import byte_words, folded, merkle_manifest, op11_merkle, proof, radix_ranks
from tessitura.llm.toxicity import fit, op13_toxicity, score

from .cases import SCHEMA, corpus, frame, prose


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest -------------------------------------------------------------------------------------------------------


def field_text(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more: int = 0) -> str:
    doc, text, lang, source, n = row
    return sha("".join(map(field_text, (doc, source, lang, n if n is None else n + more, text))))


def brute_tree(digests: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """(root, for each leaf the digests beside its way, lowest level first)."""
    beside, members = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(i, min(i + fanout, len(digests))) for i in range(0, len(digests), fanout)]
        for run in runs:
            for i in run:
                for leaf in members[i]:
                    beside[leaf] += [digests[j] for j in run if j != i]
        members = [[leaf for i in run for leaf in members[i]] for run in runs]
        digests = [sha("".join(digests[i] for i in run)) for run in runs]
    return digests[0], beside


def brute_manifest(rows, fanout: int = 2):
    """A counter of (doc_id, leaf, subroot, root, digest of the siblings)."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    trees = []
    for lang in sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode()):
        own = sorted(groups[lang], key=lambda r: (-math.inf if r[0] is None else r[0], int(leaf_of(r)[:16], 16) - (1 << 64) * (leaf_of(r)[0] in "89abcdef")))
        leaves = [leaf_of(r) for r in own]
        trees.append((own, leaves, *brute_tree(leaves, fanout)))
    root, above = brute_tree([t[2] for t in trees], fanout)
    return collections.Counter((r[0], leaf, sub, root, sha("".join(s + up))) for (own, leaves, sub, ways), up in zip(trees, above, strict=True) for r, leaf, s in zip(own, leaves, ways, strict=True))


def siblings(df):
    left, right = proof(F.col("left"), F.col("right"))
    return df.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256), folded(F.col("leaf"), left, right))


@pytest.mark.parametrize("fanout,span,most,digit", [(2, 4096, 4096, 12), (2, 8, 3, 2), (3, 9, 1, 4), (7, 8, 5, 12)])
def test_manifest_equals_a_tree_built_row_by_row(spark, monkeypatch, fanout, span, most, digit):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle, "DIGIT", digit)
    monkeypatch.setattr(merkle, "MOST", most)
    rows = corpus()
    found = siblings(merkle_manifest(frame(spark, rows), fanout=fanout)).collect()
    assert collections.Counter(tuple(r)[:5] for r in found) == brute_manifest(rows, fanout)
    assert all(r[5] == r[3] for r in found)


def test_manifest_of_few_rows_and_clashing_names(spark):
    assert merkle_manifest(frame(spark, [])).count() == 0
    one = merkle_manifest(frame(spark, corpus()[:1]).withColumn("leaf", F.lit(1)), keep=("doc_id", "leaf")).collect()
    assert [(r.leaf, r._leaf, r.subroot, r.root, r.left, r.right) for r in one] == [(1, leaf_of(corpus()[0]), r._leaf, r._leaf, [], []) for r in one]
    same = [(5, "x", "aa", None, 1)] * 9
    found = siblings(merkle_manifest(frame(spark, same))).collect()
    assert collections.Counter(tuple(r)[:5] for r in found) == brute_manifest(same) and all(r[5] == r[3] for r in found)


def test_ranks_of_hot_keys_and_any_longs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([7, 7, 7, rng.randrange(-(1 << 63), 1 << 63), rng.randrange(50), -1, (1 << 63) - 1, -(1 << 63)]), i) for i in range(600)]
    got = radix_ranks(spark.createDataFrame(rows, "g string, k long, i long").repartition(4), "g", ["k", "i"], most=4).collect()
    for g in "ab":
        own = sorted((k, i) for h, k, i in rows if h == g)
        assert [(r.k, r.i, r["size"]) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == [(k, i, len(own)) for k, i in own]
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(len(own)))


def test_words_order_as_bytes_do(spark):
    names = ["", "=", "=a", "=a\0", "=aaaaaaaab", "=aaaaaaaa", "=é", "=z", "=ÿ", "=\U0001f600", "=aaaaaaaa\0\0"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    words = byte_words(F.col("n"), max(len(n.encode()) for n in names))
    assert [r.n for r in df.orderBy(*words).collect()] == sorted(names, key=str.encode)


def test_op11_tells_changed_documents(spark, tmp_path):
    rows = [r for r in corpus() if r[0] is not None][:-2]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    brute = {k[0]: k for k in brute_manifest(rows)}
    found = op11_merkle(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        changed = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and dict((x[0], x) for x in rows)[r.doc_id][4] is not None
        assert (r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) == brute[r.doc_id] and r.verified != changed and (r.folded_root == r.root) == r.verified
    assert any(not r.verified for r in found) and any(r.verified for r in found)


# Fill-in-middle --------------------------------------------------------------------------------------------------------

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_infill(doc_id, text, sentinels=("<P>", "<S>", "<M>")):
    text, units = text or "", TOKEN.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = sentinels
    return (len(units), "spm", len(pre), len(mid), s + suf + p + pre + m + mid) if h4 % 100 < 80 else (len(units), "psm", len(pre), len(mid), p + pre + s + suf + m + mid)


ODD = ["a", " a", "a ", "  ", "\t\n a\x0b\x0cb\r", "a\x1cb c", "a b", "é \U0001f600x  y", "<P> in it", "x <S>", "<M>", "<", "a <S b> <", "< P>", "\0 \0a", ""]


def odd_rows():
    return corpus() + [(1000 + i * 20 + k, t, None, None, 0) for i, t in enumerate(ODD) for k in range(20)]


def test_boundaries_are_those_of_the_pattern():
    for text in [*ODD, *[r[1] or "" for r in corpus()]]:
        at = boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == TOKEN.findall(text)


def test_examples_equal_brute_force_and_are_read_back(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("form", F.lit("own"))
    found = fill_in_middle(docs, keep=("doc_id", "text", "form"))
    out = found.withColumn("back", restored(F.col("output"), F.col("_form"))).collect()
    assert collections.Counter((r.doc_id, r.n, r._form, r.prefix_chars, r.middle_chars, r.output) for r in out) == collections.Counter((r[0], *brute_infill(r[0], r[1])) for r in rows)
    assert all(r.back == (r.text or "") and r.form == "own" for r in out)
    assert {r._form for r in out} == {"plain", "psm", "spm"} and fill_in_middle(frame(spark, [])).count() == 0


def test_op12_gives_digests_of_output_and_text(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter((r[0], *brute_infill(r[0], r[1])[:4], sha(brute_infill(r[0], r[1])[4]), sha(r[1] or "")) for r in rows)
    assert collections.Counter(tuple(r) for r in op12_infill(spark, str(tmp_path)).collect()) == want


# Toxicity --------------------------------------------------------------------------------------------------------------

RUDE = ["grumpel", "snarfo", "blorktard"]


def labelled(n: int = 400, seed: int = 5):
    """Prose, a third of it with rude words in it, inflected and in longer words."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = prose(rng, rng.randint(4, 60))
        if i % 3 == 0:
            parts = text.split(" ")
            for _ in range(rng.randint(2, 4)):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(RUDE) + rng.choice(["", "en", "s", "ia"]))
            text = " ".join(parts)
        rows.append((i, text, None, None, int(i % 3 == 0)))
    return rows


def grams(text):
    text = re.sub("[\t-\r]", " ", f" {(text or '').lower()} ")
    return {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)}


def bucket_of(gram: str) -> int:
    """The bucket of one n-gram, step by step."""
    h = 0
    for c in gram:
        h = (h + ord(c)) * 0x9E3779B1 % (1 << 32)
    h = ((h ^ h >> 15) * 0x85EBCA6B + len(gram)) % (1 << 32)
    return (h ^ h >> 13) * 0x9E3779B1 % (1 << 32) >> (32 - toxicity.BITS)


def features(text):
    return {bucket_of(g) for g in grams(text)}


def brute_scores(learn, texts, z=toxicity.Z, ridge=toxicity.RIDGE):
    """The same model over sets of buckets, by dense Newton steps."""
    seen = [features(t) for t, _ in learn]
    y = np.array([v for _, v in learn], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    one, zero = collections.Counter(g for s, v in zip(seen, y, strict=True) if v for g in s), collections.Counter(g for s, v in zip(seen, y, strict=True) if not v for g in s)
    ratio = {g: math.log((one[g] + 1) / (n1 + 2)) - math.log((zero[g] + 1) / (n0 + 2)) for g in one.keys() | zero.keys()}
    error = {g: math.sqrt((p := (one[g] + zero[g]) / len(y)) * (1 - p) * (1 / n1 + 1 / n0)) for g in ratio}
    kept = sorted(g for g in ratio if abs(one[g] / n1 - zero[g] / n0) > z * error[g] > 0)
    x = lambda s: [ratio[g] if g in s else 0.0 for g in kept] + [1.0]
    a = np.array([x(s) for s in seen])
    w, hold = np.zeros(len(kept) + 1), np.append(np.full(len(kept), ridge), 0.0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(hold + 1e-12), a.T @ (p - y) / len(y) + hold * w)
        w -= step * min(1.0, 2 / max(1e-12, np.abs(a @ step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return [1 / (1 + math.exp(-np.dot(x(features(t)), w))) for t in texts]


def in_training(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def test_op13_equals_the_same_model_over_sets(spark, tmp_path):
    rows = labelled() + [(900, None, None, None, 0), (901, "", None, None, 0), (902, " ".join(r[1] for r in labelled()) * 3, None, None, 0), (None, RUDE[0], None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(r[0], 1, r[4]) for r in rows[:400]] + [(3, 0, 1), (4, 1, None), (5, 1, 7), (None, 1, 1), (5000, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in op13_toxicity(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    want = brute_scores([(r[1], r[4]) for r in rows[:400] if in_training(r[0])], [r[1] for r in rows])
    for r, p in zip(rows, want, strict=True):
        got = found[r[0]]
        assert got.score == pytest.approx(p, abs=2e-3) and got.predicted == int(got.score >= 0.3)
        assert got.held_out == (r[0] is None or not in_training(r[0]))
    told = [found[r[0]].predicted == r[4] for r in rows[:400] if not in_training(r[0])]
    assert len(told) > 80 and np.mean(told) > 0.97 and found[900].score == found[901].score < 0.3


def test_buckets_are_those_of_the_n_grams():
    texts = ["Ab\tc", None, "", "x", "été ÉTÉ été", "longer text " * 40]
    got: dict = collections.defaultdict(set)
    for row, bucket in toxicity.buckets(texts):
        assert (np.diff(row << toxicity.BITS | bucket) > 0).all()
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            got[r].add(b)
    assert got == {i: features(t) for i, t in enumerate(texts) if features(t)}
    each = [np.concatenate([b for _, b in toxicity.buckets([t])]) for t in texts]
    together = np.concatenate([b for _, b in toxicity.buckets(texts)])
    assert (np.concatenate(each) == together).all()


def test_toxicity_does_not_depend_on_the_partitioning_and_samples_are_bounded(spark):
    rows = labelled()
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    one, two = fit(docs.repartition(2), labels), fit(docs.repartition(5), labels.repartition(3))
    assert one.bias == two.bias and (one.weight == two.weight).all() and (one.bucket == two.bucket).all()
    few, known = toxicity.sampled(docs, labels, sample=20)
    assert collections.Counter(r._label for r in few.collect()) == {0: 20, 1: 20} and known[0] + known[1] == sum(in_training(r[0]) for r in rows)


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame(labelled(40), SCHEMA).withColumn("score", F.lit(7))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks, want in ((none, 0), (spark.createDataFrame([(i, 0) for i in range(40)], none.schema), 0), (spark.createDataFrame([(i, 1) for i in range(40)], none.schema), 1)):
        out = score(docs, fit(docs, marks)).collect()
        assert len(out) == 40 and all(r._score == pytest.approx(want) and r.predicted == want and r.score == 7 for r in out)
    assert score(frame(spark, []), fit(docs, none)).count() == 0


@pytest.mark.parametrize("entries", [1 << 20, 7])
def test_regression_reaches_the_least_loss(monkeypatch, entries):
    monkeypatch.setattr(toxicity, "ENTRIES", entries)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)) * (rng.random((80, 5)) < 0.5)
    y = (x @ [2, -1, 0, 0.5, 1] + rng.normal(size=80) > 0.2).astype(float)
    row, column = np.nonzero(x)
    share = np.full(80, 1 / 80)
    there = (x != 0).astype(float)
    scale, x = np.array([1.0, -2.0, 0.5, 1.0, 3.0]), there * [1.0, -2.0, 0.5, 1.0, 3.0]
    w = toxicity.regression(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=80))]), column.astype(np.int16), scale, y, share, ridge=1e-2)
    miss = share * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
    assert np.abs(x.T @ miss + 1e-2 * w[:-1]).max() < 1e-4 and abs(miss.sum()) < 1e-4
