from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import textkit as T
from tessitura.llm.decontaminate import decontaminate
from tessitura.llm.jpeg import stored_texts
from tessitura.llm.lines import dedup_lines, op9_line_dedup, within_one
from tessitura.llm.neardup import near_duplicates, op8_near_duplicates, overlaps, signatures, similar_links
from tessitura.llm.suffixes import BlindTrie, cut_repeats, repeats

from .cases import SCHEMA, corpus, frame, prose, words_of


def key(row):
    return repr(row)


# Kernels ---------------------------------------------------------------------------------------------------------------


def buffers(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_words_match_the_pattern():
    texts = [r[1] or "" for r in corpus()]
    row, word, start, end = T.words(*buffers(texts))
    raw = T.WORD_BYTES[buffers(texts)[0]].tobytes()
    got = collections.defaultdict(list)
    for r, a, b in zip(row, start, end):
        got[r].append(raw[a:b].decode())
    assert [got[i] for i in range(len(texts))] == [words_of(t) for t in texts]
    by_text = collections.defaultdict(set)
    for h, a, b in zip(word, start, end):
        by_text[raw[a:b]].add(int(h))
    assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_span_hashes_depend_on_content_only():
    raw = np.frombuffer(b"abcabcXabc", np.uint8)
    h = T.span_hash(T.prefix_hash(raw), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]


# Decontamination -------------------------------------------------------------------------------------------------------


def brute_decontaminate(rows, items, size=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows[tuple(w[i : i + k])].add("" if item is None else str(item))
    out = []
    for r in rows:
        w, hit, found = words_of(r[1]), set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((r[0], len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=key)


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_decontaminate_equals_brute_force(spark, block):
    rows = corpus(1)
    rng = random.Random(3)
    pick = [words_of(rows[i][1]) for i in (7, 17, 60)]
    items = [(10, " ".join(pick[0][5:40])), (2, prose(rng, 30)), (3, " ".join(pick[1][:3])), (4, None), (5, "..."), (None, " ".join(pick[2][100:115]).upper()), (10, " ".join(pick[0][5:30])), (7, pick[1][0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(frame(spark, rows), bench, block=block)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    got = [tuple(r) for r in found.select("doc_id", "n_words", n_hit, F.array_join("items", ",")).collect()]
    assert sorted(got, key=key) == brute_decontaminate(rows, items)


def test_decontaminate_empty_tables_and_clashing_names(spark):
    docs = frame(spark).withColumns({"items": F.lit(1), "_rid": F.lit("x"), "Starts": F.lit(2)})
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate(docs, bench, keep=tuple(docs.columns))
    assert out.count() == len(corpus()) and {"items", "_items", "_rid", "Starts", "_starts"} <= set(out.columns)
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_cut_repeats_and_stored_texts_keep_clashing_names(spark):
    docs = frame(spark).withColumns({n: F.lit("x") for n in ("spans", "kept", "n_bytes", "media", "Width", "_text", "_row", "_rid")})
    for out, own in ((cut_repeats(docs, keep=tuple(docs.columns)), ("_spans", "_kept", "_n_bytes")), (stored_texts(docs, keep=tuple(docs.columns)), ("_media", "_width", "_n_bytes", "payload_bytes"))):
        assert set(own) <= set(out.columns) and set(docs.columns) <= set(out.columns)
        assert out.where("kept = 'x' and media = 'x' and _n_bytes = octet_length(coalesce(text, ''))").count() == len(corpus())
    assert stored_texts(docs.limit(0)).count() == 0


# Substrings ------------------------------------------------------------------------------------------------------------


def brute_cut(rows, length):
    count = collections.Counter()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in data:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
    out = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 48, 20_000), (60, 16, 20_000), (60, 16, 1)])
def test_cut_repeats_equals_brute_force(spark, length, gram, hot):
    rows = corpus(2)
    rng = random.Random(5)
    common = prose(rng, 40)
    rows += [(100 + i, f"{prose(rng, 9)} {common} {prose(rng, 9)}", None, None, 0) for i in range(20)]
    rows += [(200, "aaaa" * 200, None, None, 0), (201, "xyz " * 120 + common, None, None, 0)]
    cut = cut_repeats(frame(spark, rows), length=length, gram=gram, hot=hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    got = [tuple(r) for r in cut.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()]
    assert sorted(got, key=key) == brute_cut(rows, length)


def test_cut_repeats_of_nothing(spark):
    assert cut_repeats(frame(spark, [])).count() == 0


def test_blind_trie_orders_suffixes_and_finds_longest_prefixes():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    trie, seen = BlindTrie(text, 30), []
    for s in rng.sample(range(370), 200):
        common, _ = trie.insert(s)
        best = max((next((k for k in range(30) if text[s + k] != text[o + k]), 30) for o in seen), default=0)
        assert common == best
        if common < 30:
            seen.append(s)
    assert trie.order() == sorted(seen, key=lambda s: text[s : s + 30])


def test_repeats_within_one_anchor():
    a = b"0123456789" * 3
    segments = [b"L" + a + b"x", b"M" + a + b"y", b"N" + a[:20] + b"z" * 11]
    got = repeats(segments, np.array([13, 13, 13]), np.array([1, 1, 1]), np.zeros(3, int), length=20)
    covered = [sorted({i for s in runs for i in range(*s)}) for runs in got]
    assert covered[0] == covered[1] == list(range(1, 31)) and covered[2] == list(range(1, 21))


# Near-duplicates -------------------------------------------------------------------------------------------------------


def shingles_of(text, k=5):
    w = words_of(text)
    return collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else collections.Counter()


def brute_classes(rows, similarity=0.8):
    sets = [shingles_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            both, either = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if rows[i][1] == rows[j][1] or either and both / either >= similarity:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    return sorted((tuple(sorted(g, key=key)) for g in groups.values()), key=key)


def near_rows():
    rng = random.Random(7)
    rows = corpus(4)
    base = prose(rng, 300).split(" ")
    for i in range(25):  # near copies of one text, each far from the others
        copy = list(base)
        for _ in range(6):
            copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
        rows.append((300 + i, " ".join(copy), None, None, 0))
    rows.append((299, " ".join(base), None, None, 0))
    return [(i, *r[1:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = near_rows()
    out = near_duplicates(frame(spark, rows), block=block).collect()
    groups = collections.defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
    assert sorted((tuple(sorted(g, key=key)) for g in groups.values()), key=key) == brute_classes(rows)
    assert sum(r["first"] for r in out) == len(groups) and all(r["first"] == (r.doc_id == r.head_id) for r in out)


def test_op8_finds_the_classes_of_brute_force(spark, tmp_path):
    rows = near_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    groups = collections.defaultdict(list)
    for r in op8_near_duplicates(spark, str(tmp_path)).collect():
        groups[r.class_id].append(r.doc_id)
    assert sorted((tuple(sorted(g, key=key)) for g in groups.values()), key=key) == brute_classes(rows)


def test_near_duplicates_edge_cases(spark):
    rows = [(5, "!!!", None, None, 0), (4, "!!!", None, None, 0), (3, "???", None, None, 0), (2, None, None, None, 0), (1, None, None, None, 0), (None, "one two three", None, None, 0), (9, "One, two three", None, None, 0), (9, "one two three", None, None, 0)]
    out = sorted(((r.doc_id, r.head_id) for r in near_duplicates(frame(spark, rows)).collect()), key=key)
    assert out == sorted([(5, 4), (4, 4), (3, 3), (2, 2), (1, 1), (None, 9), (9, 9), (9, 9)], key=key)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_with_repeated_and_null_ids_stay_apart(spark):
    rng = random.Random(3)
    one, two, three = (prose(rng, 40) for _ in range(3))
    rows = [(1, one, None, None, 0), (1, two, None, None, 0), (2, one, None, None, 0), (None, three, None, None, 0), (None, None, None, None, 0), (None, None, None, None, 0)]
    groups = collections.defaultdict(list)
    for r in near_duplicates(frame(spark, rows).withColumn("class_id", F.lit(0))).collect():
        groups[r.class_id].append((r.doc_id, r["first"]))
    assert sorted(map(sorted, groups.values()), key=key) == sorted([[(1, True), (2, False)], [(1, True)], [(None, True)], [(None, True)], [(None, True)]], key=key)


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(8)
    words = [prose(rng, 1) for _ in range(5000)]
    long = [rng.choice(words) for _ in range(300_000)]
    other = list(long)
    for _ in range(4000):
        other[rng.randrange(len(other))] = "changed"
    far = [rng.choice(words) for _ in range(300_000)]
    rows = [(1, " ".join(long), None, None, 0), (2, " ".join(other), None, None, 0), (3, " ".join(far), None, None, 0)]
    assert {r.doc_id: r.head_id for r in near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_signatures_estimate_weighted_jaccard():
    a = np.array([5, 1, 1, 3, 40, 2, 7, 1] * 10)
    b = np.array([3, 1, 2, 3, 30, 9, 0, 1] * 10)
    seeds = np.random.default_rng(0).integers(1, 2**63, len(a)).astype(np.uint64)
    row = np.repeat([0, 1], len(a))
    count = np.concatenate([a, b])
    s = signatures(row[count > 0], np.concatenate([seeds, seeds])[count > 0], count[count > 0], 2, 4000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / 4000) ** 0.5
    assert np.isfinite(s).all()


def test_overlaps_count_multisets():
    import pyarrow as pa

    texts = [prose(random.Random(i), 40) for i in range(6)]
    other = [t.replace(" ", "  ", 3) if i % 2 else t.rsplit(" ", 4)[0] for i, t in enumerate(texts)]
    got = overlaps(pa.array(texts), pa.array(other))
    for g, x, y in zip(got, texts, other):
        p, q = shingles_of(x), shingles_of(y)
        assert g == pytest.approx(sum((p & q).values()) / sum((p | q).values()))


def test_similar_links_join_what_similar_pairs_join():
    rng = np.random.default_rng(1)
    for trial in range(30):
        base = [rng.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(3)]
        sets = [np.unique(np.concatenate([base[rng.integers(3)][: rng.integers(50, 61)], rng.integers(0, 1 << 60, rng.integers(1, 16)).astype(np.uint64)])) for _ in range(24)]
        label = rng.integers(0, 6, 24)
        a, b = list(range(14)), list(range(14, 24))
        found = similar_links((label[a], [sets[k].tobytes() for k in a]), (label[b], [sets[k].tobytes() for k in b]), 0.8)

        def classes(pairs):
            own = {int(x): {int(x)} for x in label}
            for i, j in pairs:
                both = own[int(label[i])] | own[int(label[j])]
                for x in both:
                    own[x] = both
            return {frozenset(v) for v in own.values()}

        similar = [(i, j) for i in a for j in b if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
        assert set(links := [(a[i], b[j]) for i, j in found]) <= set(similar) and classes(links) == classes(similar) and len(found) <= 5


def test_classes_of_hundreds_are_linked_once():
    common = np.arange(1, 101, dtype=np.uint64)
    sides = [(np.full(300, k), [np.append(common, np.uint64(1000 + 300 * k + i)).tobytes() for i in range(300)]) for k in range(2)]
    assert len(similar_links(*sides, 0.8)) == 1


# Lines -----------------------------------------------------------------------------------------------------------------


def brute_lines(rows, shortest=0):
    order = [(i, k, x) for i, r in enumerate(rows) if r[1] is not None for k, x in enumerate(r[1].split("\n")) if x.strip(" \t\n\v\f\r")]
    texts = sorted({x for _, _, x in order})
    parent = {x: x for x in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [x for x in texts if len(x) >= shortest]
    for a in long:
        for b in long:
            if a < b and within_one(a, b):
                parent[root(a)] = root(b)
    seen, gone = set(), collections.defaultdict(set)
    for i, k, x in order:
        c = root(x)
        if c in seen:
            gone[i].add(k)
        seen.add(c)
    out = []
    for i, r in enumerate(rows):
        own = [] if r[1] is None else r[1].split("\n")
        kept = None if r[1] is None else "\n".join(x for k, x in enumerate(own) if k not in gone[i])
        out.append((r[0], len(own), len(gone[i]), kept))
    return sorted(out, key=key)


def test_dedup_lines_equals_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, *r[1:]) for i, r in enumerate(corpus(6))]
    for i in range(40):
        line = list(rng.choice(["A line that many documents hold, éüñ, again.", "x" * 25, "Another rather common line of text here"]))
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(line))
            rng.choice([lambda: line.insert(p, "q"), lambda: line.pop(p), lambda: line.__setitem__(p, "é")])()
        rows.append((400 + i, prose(rng, 5) + "\n" + "".join(line) + "\n\nend", None, None, 0))
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = [tuple(r) for r in dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "kept").collect()]
    assert sorted(got, key=key) == brute_lines(rows)


def test_dedup_lines_compares_short_lines(spark):
    rng = random.Random(13)
    lines = ["Read more", "Read more.", "read more", "Home", "Hom", "é", "x", "xyz", "zyx", "ab", "ba", "q" * 18, "q" * 19 + "r", "q" * 19, "q" * 21, "A line of 19 chars.", "A line of 19 chars..", "A line of 20 charsX..", " ", ""]
    lines += ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 24))) for _ in range(150)]
    rows = [(i, "\n".join(rng.sample(lines, 4)), None, None, 0) for i in range(70)] + [(70, None, None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for shortest in (0, 4):
        got = [tuple(r) for r in dedup_lines(docs, shortest=shortest).select("doc_id", "n_lines", "n_removed", "kept").collect()]
        assert sorted(got, key=key) == brute_lines(rows, shortest)
    assert brute_lines(rows, 0) != brute_lines(rows, 20)


def test_dedup_lines_counts_every_link(spark):
    rng = random.Random(17)
    lines = [f"Page {i} of the report on something long" for i in range(1, 13)] + ["Page of the report on something long", "Page  of the report on something long", "aab", "ab", "aa", "a", "b", "é", "q" * 19, "q" * 20, "q" * 21, "q" * 20 + "r"]
    lines += ["".join(rng.choice("ab") for _ in range(rng.randint(2, 28))) for _ in range(60)]
    rows = [(i, "\n".join(lines[i : i + 3] + [rng.choice(lines)]), None, None, 0) for i in range(0, len(lines), 3)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for shortest in (0, 20):
        texts = [x for x in set(lines) if len(x) >= shortest]
        many = {x: sum(x != y and within_one(x, y) for y in texts) for x in texts}
        got = {r.doc_id: r.n_links for r in dedup_lines(docs, shortest=shortest).collect()}
        assert got == {r[0]: sum(many.get(x, 0) for x in r[1].split("\n")) for r in rows}


def thue_morse(n=10):
    """Two texts of 2**n characters that differ everywhere and that any polynomial hash modulo 2**64 takes for one."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_lines_that_polynomials_modulo_two_to_the_64_confuse(spark):
    a, b = thue_morse()
    docs = spark.createDataFrame([(1, a, None, None, 0), (2, b, None, None, 0), (3, a, None, None, 0)], SCHEMA).coalesce(1)
    assert {r.doc_id: r.n_removed for r in dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 1}


def test_near_duplicates_that_polynomials_modulo_two_to_the_64_confuse(spark):
    a, b = thue_morse()
    rows = [(1, " ".join([a] * 9), None, None, 0), (2, " ".join([b] * 9), None, None, 0)]
    assert len({r.class_id for r in near_duplicates(frame(spark, rows)).collect()}) == 2


def test_dedup_lines_keeps_the_least_of_an_order_and_clashing_names(spark):
    rows = [(5, "some line\nx", None, None, 0), (None, "some line", None, None, 0), (2, "some line", None, None, 0), (2, "some line", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit(1), "_rid": F.lit("r"), "N_lines": F.lit(2)}).coalesce(1)
    out = dedup_lines(docs, keep=tuple(docs.columns), order="doc_id")
    assert {"kept", "_kept", "_rid", "N_lines", "_n_lines", "text"} <= set(out.columns)
    assert sorted((r.doc_id or 0, r.n_removed) for r in out.collect()) == [(0, 1), (2, 0), (2, 1), (5, 1)]


def test_op9_links_lines_of_any_length(spark, tmp_path):
    rows = [(1, "Read more\nlonger text of no other document here", None, None, 0), (2, "Read more.\nA line of 19 chars.", None, None, 0), (3, "A line of 19 chars..", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in op9_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1}


def test_dedup_lines_edge_cases(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(1, "", None, None, 0), (2, None, None, None, 0), (3, "a\na\n\n\nb", None, None, 0)], SCHEMA).coalesce(1), shortest=20).collect()}
    assert out[1].kept == "" and out[2].kept is None and out[3].kept == "a\n\n\nb"


def test_within_one():
    assert within_one("abc", "abc") and within_one("abc", "abXc") and within_one("abc", "ac") and within_one("abc", "abX") and not within_one("abc", "acb") and not within_one("", "ab") and within_one("", "a")
