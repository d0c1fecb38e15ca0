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

from tessitura.llm import jpeg
from tessitura.llm.language import Classifier, fit, held_out, identify
from tessitura.llm.mixing import mix, mix_plan, op5_mixing, targets
from tessitura.llm.sharding import assign, communication_matrix, op2_sharding, shard_rows
from tessitura.llm.tokens import HUGE, Counter, count_tokens, op6_tokens, stable_starts
from tessitura.llm.urls import RULES, filter_urls

from .cases import SCHEMA, corpus, frame, prose

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


# Sharding --------------------------------------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_keep_all_rows(spark):
    docs = frame(spark).withColumns({"shard": F.lit("s"), "_RID": F.lit(1)})
    out = shard_rows(docs, 7).collect()
    assert len(out) == len(corpus()) and out[0].shard == "s"
    slots = collections.defaultdict(list)
    for r in out:
        slots[r._shard].append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert collections.Counter((r.doc_id, r.text) for r in out) == collections.Counter((r[0], r[1]) for r in corpus())
    assert shard_rows(frame(spark, [])).count() == 0 and shard_rows(frame(spark, corpus()[:3])).count() == 3


def test_assignment_is_the_same_again_and_close_to_uniform(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "_rid")
    one = {r._rid: (r.shard, r.slot) for r in assign(ids, "_rid", 40).collect()}
    assert one == {r._rid: (r.shard, r.slot) for r in assign(ids.repartition(5), "_rid", 40).collect()}
    # The first half of the ids lies in each shard like a hypergeometric draw: 250 of 500, deviation 11.
    first = collections.Counter(s for i, (s, _) in one.items() if i < 10_000)
    assert all(abs(first[s] - 250) < 5.5 * 11.2 for s in range(40)) and len(set(first.values())) > 5


def test_matrix_keeps_margins_and_has_hypergeometric_spread(spark):
    sizes = spark.createDataFrame([(0, 300), (1, 0), (2, 50), (3, 650)], "block int, n long")
    cells = []
    for seed in range(60):
        m = {r.block: np.diff(r.ends) for r in communication_matrix(sizes, 4, seed, 2).collect()}
        assert [int(m[b].sum()) for b in range(4)] == [300, 0, 50, 650] and sum(m.values()).tolist() == [250] * 4
        cells.append(m[0][1])
    var = 300 * 0.25 * 0.75 * 700 / 999
    assert abs(np.mean(cells) - 75) < 4 * math.sqrt(var / 60) and 0.5 * var < np.var(cells) < 1.8 * var


# Mixing ----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: dict = {}
    while True:
        left, open_ = sum(sizes.values()) - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(epochs * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 900, None: 40}, {"a": 100}, {"a": 0, "b": 10}, {"é": 7, "z": 9, "b": 1000, "c": 3, "d": 2}])
def test_targets_equal_iterated_resharing(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == {k: pytest.approx(v) for k, v in brute_targets(sizes).items()}


def test_mix_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = corpus(3) + [(1000 + i, prose(rng, rng.randint(1, 60)), None, rng.choice(["s0", "s1", "s2", "s3"]), 0) for i in range(400)]
    out = mix_plan(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    biggest = max(r.size for r in out)
    taken, target = collections.Counter(), {}
    for r in out:
        assert 0 <= r.copies <= 3
        taken[r.source_size] += r.copies * r.size
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= biggest for s in target)
    again = mix_plan(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    unique = lambda rs: collections.Counter((r.doc_id, r.size, r.copies) for r in rs if r.doc_id not in (0, None))
    assert unique(out) == unique(again)


def test_mix_repeats_whole_rows(spark):
    docs = frame(spark).withColumns({"copies": F.lit("c"), "_rid": F.lit(3)})
    out = mix(docs)
    assert out.columns == docs.columns
    known = {(r[0], r[1]) for r in corpus()}
    assert all((r.doc_id, r.text) in known for r in out.collect())
    assert mix(frame(spark, [])).count() == 0 and mix_plan(frame(spark, [])).count() == 0


# Language --------------------------------------------------------------------------------------------------------------


def labelled(n=400):
    rng = random.Random(9)
    alphabets = {"aa": ["tion", "the", "ing", "er"], "bb": ["ción", "que", "ado", "ñ"], "cc": ["sch", "ung", "keit", "ß"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(alphabets))
        text = " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80)))
        rows.append((i, text.upper() + "!!" if i % 7 == 0 else text, lang, "s", len(text)))
    return rows


def test_language_of_held_out_documents(spark):
    docs = frame(spark, labelled())
    out = identify(docs, fit(docs)).select("*", held_out("doc_id").alias("out")).collect()
    held = [r for r in out if r.out]
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_dictionaries_are_excerpts_of_many_documents_and_judge_every_length(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]} " * (20_000 if i % 3 == 0 else 400), "aa", "s", 0) for i in range(400)]
    made = fit(frame(spark, rows))["aa"]
    # No document has more than a small share of any dictionary, however long it is.
    assert all(max(collections.Counter(d.split()).values()) <= 0.1 * len(d.split()) and len(set(d.split())) > 30 for d in made)
    classifier, seen = Classifier({"aa": [b"alpha beta gamma " * 9, b"one two three four " * 9], "bb": [b"alpha beta gamma " * 9, b"x " * 99]}), []
    for repeat in (1, 3, 200):
        text = " ".join(f"one two {x} three four" for x in ["red", "blue"] * repeat)
        seen.append(classifier.classify(text)[0])
    assert seen == ["aa", "aa", "aa"]  # told by the second dictionary only
    assert all(c > 0 for c in classifier.costs(b"one"))


def test_language_rejects_junk_and_languages_left_out(spark):
    rng = random.Random(21)
    docs = frame(spark, labelled(900)).cache()
    junk = [(10_000 + i, " ".join("".join(rng.choice("bcdfghjklmpqvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(15, 200))), None, "s", 0) for i in range(120)]
    learned = fit(docs)
    assert len(learned.margins) == 11 and max(learned.margins) > 0
    rejected = {r.doc_id for r in identify(docs.where(held_out("doc_id")).union(frame(spark, junk)), learned).collect() if r.rejected}
    clean = {r.doc_id for r in docs.where(held_out("doc_id")).collect()}
    assert len(rejected & clean) <= 0.04 * len(clean) and len(rejected - clean) >= 0.9 * len(junk)
    two = identify(docs.where(held_out("doc_id")), fit(docs.where("lang <> 'cc'"))).collect()
    assert np.mean([r.rejected for r in two if r.lang == "cc"]) >= 0.8 and np.mean([r.rejected for r in two if r.lang != "cc"]) <= 0.05
    # One language: rejected where its dictionaries hardly help.
    one = identify(docs.where(held_out("doc_id")).where("lang = 'aa'").union(frame(spark, junk)), fit(docs.where("lang = 'aa'"))).collect()
    assert np.mean([r.rejected for r in one if r.lang is None]) >= 0.9 and np.mean([r.rejected for r in one if r.lang]) <= 0.05


def test_language_fits_every_language_and_repeated_rows_count_once(spark, monkeypatch):
    from tessitura.llm import language

    rows = labelled(300)
    hot = [(7, "the tion ing " * 50, "aa", "s", 0)] * 2000  # one id and text, many rows
    made = fit(frame(spark, rows + hot))
    assert set(made) == {"aa", "bb", "cc"} and sum(d.count(b"the tion ing the tion ing the tion ing the") for d in made["aa"]) <= 1200
    assert all(len(set(d.split())) > 50 for d in made["aa"])
    monkeypatch.setattr(language, "FULL_LANGUAGES", 1)
    small = fit(frame(spark, rows))
    assert set(small) == {"aa", "bb", "cc"} and all(len(d) <= language.DICTIONARY_BYTES // 3 for own in small.values() for d in own)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 values"):
        fit(frame(spark, rows))


def test_language_edge_cases(spark):
    learned = fit(frame(spark, labelled()))
    rows = [(1, None, "aa", None, 0), (2, "", "aa", None, 0), (3, "123 !?", "aa", None, 0), (4, "the tion " * 30_000, None, None, 0)]
    docs = frame(spark, rows).withColumns({"score": F.lit(5), "Lang_Pred": F.lit("x")})
    out = {r.doc_id: r for r in identify(docs, learned).collect()}
    assert [out[i]["_lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "aa"] and out[1].rejected and not out[4].rejected and out[1].score == 5
    assert fit(frame(spark, [])) == {} and identify(frame(spark, []), {}).count() == 0
    assert identify(frame(spark, rows), {}).where("lang_pred = 'und'").count() == 4
    one = {"aa": learned["aa"]}
    assert {r.lang_pred for r in identify(frame(spark, rows), one).where("doc_id = 4").collect()} == {"aa"}


# Tokens ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return Counter(TOKENIZER)


ODD = ["", " ", "a", "  two  spaces ", "tabs\t\tand\n\n\nlines \n x", "I'm you're 'tis", "nb\u00a0sp\u3000wide \u2003em", "x<|endoftext|>y <|endoftext|>", "12 345,6 ½ Ⅷ", "é é\u0301 ñ", "日本語 テキスト", "🙂 🙂🙂", "a\x85b \x1c c", "\u200b zero", "word" * 50 + " " * 40 + "end", "Ω ß ſ K", " lead", "trail \n"]


def test_pieces_count_as_the_tokenizer_does(counter):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é1.,'\n\t \u00a0ñ日<|>") for _ in range(rng.randint(0, 60))) for _ in range(600)] + [r[1] or "" for r in corpus(8)]
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    want = counter.encode(texts)
    assert counter.count(raw, offsets).tolist() == want
    assert counter.count(raw, offsets).tolist() == want  # from what it has kept


def test_huge_texts_are_spliced_exactly(counter):
    rng = random.Random(6)
    texts = [prose(rng, 3000), "x" * 9000, "ab" * 500 + " " + "cd" * 4000 + " end", " ".join(ODD) * 30, "\n" * 5000 + "a b", "é " * 3000, "日本" * 2000 + " a b c " * 50, "a " * 4000]
    for t in texts:
        assert counter.huge(t, chunk=700, overlap=16) == len(counter.tokenizer.encode(t, add_special_tokens=False)), t[:20]


def test_stable_starts_are_spaces_after_solid_characters():
    assert stable_starts(np.frombuffer("a b\u00a0 c\né d".encode(), np.uint8)).tolist() == [1, 7, 10]


def test_count_tokens_edge_cases(spark, counter):
    out = {r.doc_id: r for r in count_tokens(frame(spark), TOKENIZER, limit=10).collect()}
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    assert all(out[i].n_bytes == len(t.encode()) and out[i].n_tokens == counter.encode([t])[0] and out[i].over_limit == (out[i].n_tokens > 10) for i, t in texts.items())
    assert count_tokens(frame(spark, []), TOKENIZER).count() == 0


def test_op6_counts_whole_texts_of_any_length_as_the_library_does(spark, counter, tmp_path):
    from .test_text_operators import thue_morse

    rng = random.Random(31)
    texts = [*thue_morse(), prose(rng, 30_000), prose(rng, 3_000), "x" * 20_000, "short one", "", None, *(" ".join(rng.choice(ODD) for _ in range(rng.randint(1, 4000))) for _ in range(6))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len((t or "").encode()), n := len(counter.tokenizer.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op6_tokens(spark, str(tmp_path)).collect()} == want
    assert sum(v[0] > HUGE for v in want.values()) > 4
    out = count_tokens(docs.withColumns({"n_tokens": F.lit("x"), "_text": F.lit(1)}), TOKENIZER, keep=("doc_id", "n_tokens", "_text", "text"), huge=100, chunk=50)
    assert {r.doc_id: (r.n_bytes, r["_n_tokens"], r.over_limit) for r in out.collect()} == want and out.columns[:4] == ["doc_id", "n_tokens", "_text", "text"]


# Urls ------------------------------------------------------------------------------------------------------------------


def brute_url(url, rules):
    import re

    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x", "https://example.org/en/123#f", "http://xexample.org/es/", "http://org", "http://org/", "ftp://a.com/de/x", "http://b.com/fr/y?://z", "http://com/de/", "http://example.com/de", "http://é.com/fr/ü", "http://a.org?q=/es/", "x://y.org:80/en/1", "http://a.com\n/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[4])], "page_id long, url string")
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages).collect()]
    assert sorted(got, key=repr) == sorted(((u, *brute_url(u, RULES)) for u in [*urls, urls[4]]), key=repr)
    many = [("block", f"site{i}.com", f"/{'p' * (i % 5)}") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.site{i * 7}.com/{'p' * (i % 4)}/x") for i in range(800)], "page_id long, url string")
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, many).collect()]
    assert sorted(got) == sorted((r.url, *brute_url(r.url, many)) for r in pages.collect()) if all(g[3] for g in got) else {tuple(g) for g in got} == {(r.url, *brute_url(r.url, many)) for r in pages.collect()}
    clash = filter_urls(pages.withColumns({"Host": F.lit("h"), "rule": F.lit("r")}).union(spark.createDataFrame([(1, "http://a.com/de/" + "x" * 100_000, "h", "r")], "page_id long, url string, Host string, rule string"))).collect()
    assert all((r.Host, r.rule, r["_host"], r.path, r["_rule"], r.verdict) == ("h", "r", *brute_url(r.url, RULES)) for r in clash)
    assert filter_urls(pages.limit(0)).count() == 0 and filter_urls(pages, []).where("rule is not null").count() == 0


# Registered queries ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    frame(spark).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_op2_shards_every_document(spark, documents):
    out = op2_sharding(spark, documents).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "rows", None) for r in corpus())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op5_takes_whole_copies_up_to_the_targets(spark, documents):
    out = op5_mixing(spark, documents).collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    by_source = collections.Counter()
    for r in corpus():
        by_source[r[3]] += size(r[1])
    names = sorted((s for s in by_source if s is not None)) + [None]
    weights, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, sum(by_source.values())
    while open_sources := [s for s in names if s not in target]:
        share = {s: left * weights[s] / sum(weights[x] for x in open_sources) for s in open_sources}
        over = [s for s in open_sources if share[s] > 3 * by_source[s]]
        target |= {s: 3 * by_source[s] for s in over} if over else share
        left -= sum(3 * by_source[s] for s in over)
    assert len(out) == len(corpus())
    source_of = {(by_source[s]): s for s in names}
    assert collections.Counter((r.doc_id, r.size, r.source_size) for r in out) == collections.Counter((r[0], size(r[1]), by_source[r[3]]) for r in corpus())
    taken = collections.Counter()
    for r in out:
        s = source_of[r.source_size]
        assert r.target == pytest.approx(target[s]) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        whole = math.floor(target[s] / by_source[s] + 1e-12) if by_source[s] else 0
        assert r.taken in (whole * r.size, (whole + 1) * r.size)
        taken[s] += r.taken
    for s in names:  # cut at the document that crosses the target
        assert abs(taken[s] - target[s]) <= max(size(r[1]) for r in corpus() if r[3] == s)
    assert sorted(map(repr, out)) == sorted(map(repr, op5_mixing(spark, documents).collect()))


def test_op10_gives_digests_of_the_payload_and_of_a_file_that_holds_it(spark, documents):
    out = jpeg.op10_media(spark, documents).collect()
    want, files = collections.Counter(), {r.doc_id: r.media for r in jpeg.stored_texts(frame(spark)).collect()}
    for r in corpus():
        data = (r[1] or "").encode()
        padded = data + b"\0" * (-len(data) % 64) or bytes(64)
        want[(r[0], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    for r in out:
        if r.doc_id is not None:
            f = bytes(files[r.doc_id])
            (thumb,) = jpeg.decode([im := jpeg.parse(f)], [f])  # the general decoder, not unpack
            assert (r.media_bytes, r.media_sha256, r.feature) == (len(f), hashlib.sha256(f).hexdigest(), f"{im.width}x{im.height}:{jpeg.thumbnail_hash(thumb)}")


# Media -----------------------------------------------------------------------------------------------------------------


def test_texts_round_trip_through_jpeg(spark):
    out = jpeg.stored_texts(frame(spark)).collect()
    assert len(out) == len(corpus())
    want = collections.Counter()
    for r in corpus():
        data = (r[1] or "").encode()
        padded = data + b"\0" * (-len(data) % 64) or bytes(64)
        want[(r[0], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert jpeg.stored_texts(frame(spark, [])).count() == 0


def test_pack_keeps_any_bytes():
    rng = np.random.default_rng(3)
    raw = np.concatenate([rng.integers(0, 256, 64 * 300), np.full(64 * 3, 128), np.full(64, 255), rng.choice([127, 128, 129], 64 * 20)]).astype(np.uint8)
    offsets = np.array([0, 64, 64 * 9, 64 * 200, len(raw)])
    for (im, thumb, back), a, b in zip(jpeg.unpack(jpeg.pack(raw, offsets)), offsets[:-1], offsets[1:]):
        assert (back == raw[a:b]).all() and thumb.size * 64 == im.width * im.height


def colour_jpeg(interval, scans=((0, 1, 2),), seed=5):
    """A 4:2:0 colour file of 5 x 3 MCUs with random DCs and some ACs, made symbol by symbol; (file, luminance DCs).

    scans: the components of each scan. Alone, luminance has 10 x 6 blocks and either colour 5 x 3.
    """
    rng = random.Random(seed)
    dc = {s: 4 for s in range(12)}
    ac = {0x00: 2, 0x01: 3, 0x11: 3, 0x02: 4, 0xF0: 5, 0x21: 6}
    dc_body, dc_code, dc_length = jpeg.canonical(dc)
    ac_body, ac_code, ac_length = jpeg.canonical(ac)
    head = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([16]) * 64) + jpeg._segment(0xC0, bytes([8, 0, 42, 0, 77, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + jpeg._segment(0xC4, b"\x00" + dc_body) + jpeg._segment(0xC4, b"\x10" + ac_body)
    head += jpeg._segment(0xDD, bytes([0, interval])) if interval else b""
    bits, out, dcs, before = "", bytearray(), np.zeros((6, 10), int), [0, 0, 0]

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for i in range(0, len(bits), 8):
            out.append(int(bits[i : i + 8], 2))
            if out[-1] == 0xFF:
                out.append(0)
        bits = ""

    def value(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for scan in scans:
        out += jpeg._segment(0xDA, bytes([len(scan), *(x for c in scan for x in (c + 1, 0)), 0, 63, 0]))
        before = [0, 0, 0]
        for m in range(60 if scan == (0,) else 15):
            if interval and m and m % interval == 0:
                flush()
                out += bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
                before = [0, 0, 0]
            for c in scan:
                for b in range(4 if c == 0 and len(scan) > 1 else 1):
                    v = rng.randint(-60, 60)
                    if c == 0:
                        dcs[(m // 5 * 2 + b // 2, m % 5 * 2 + b % 2) if len(scan) > 1 else divmod(m, 10)] = v
                    n, extra = value(v - before[c])
                    before[c] = v
                    bits += format(dc_code[n], f"0{dc_length[n]}b") + extra
                    for s in rng.sample([0x01, 0x11, 0x02, 0xF0, 0x21], rng.randint(0, 4)):
                        bits += format(ac_code[s], f"0{ac_length[s]}b") + "".join(rng.choice("01") for _ in range(s & 15))
                    bits += format(ac_code[0], f"0{ac_length[0]}b")
        flush()
    return head + bytes(out) + b"\xff\xd9", dcs


@pytest.mark.parametrize("scans", [((0,), (1,), (2,)), ((2,), (0,), (1,)), ((1, 2), (0,)), ((1,), (0, 2))])
@pytest.mark.parametrize("interval", [0, 4])
def test_decoder_reads_components_in_scans_of_their_own(interval, scans):
    data, dcs = colour_jpeg(interval, scans)
    (thumb,) = jpeg.decode([jpeg.parse(data)], [data])
    assert (thumb == np.clip(dcs * 2 + 128, 0, 255)).all()


def test_images_decode_the_same_side_by_side_and_damaged_ones_spoil_no_other():
    rng, files, alone = random.Random(8), [], []
    for k in range(40):
        data = bytearray(colour_jpeg(k % 5, (((0, 1, 2),), ((1,), (0,), (2,)))[k % 2], k)[0])
        if k % 3 == 0:
            for _ in range(5):
                data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data if k % 7 else data[: rng.randrange(250, len(data))]))
    images = []
    for data in list(files):
        try:
            images.append(jpeg.parse(data))
        except (ValueError, KeyError, IndexError, TypeError, jpeg.struct.error):
            files.remove(data)
    for im, data in zip(images, files):
        alone += jpeg.decode([im], [data])
    both = jpeg.decode(images, files)
    assert len(both) == len(alone) > 25 and sum(t is not None for t in both) >= 22
    assert all((x is None) == (y is None) and (x is None or (x == y).all()) for x, y in zip(alone, both))


@pytest.mark.parametrize("interval", [0, 1, 4])
def test_decoder_reads_subsampled_colour(spark, interval):
    data, dcs = colour_jpeg(interval)
    im = jpeg.parse(data)
    (thumb,) = jpeg.decode([im], [data])
    assert (im.width, im.height) == (77, 42) and (thumb == np.clip(dcs * 16 // 8 + 128, 0, 255)[:6, :10]).all()
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"")), (4, bytearray(b"\xff\xd8\xff\xc2\x00\x04ab")), (5, bytearray(data[:200]))], "width int, image binary")
    out = {r.width: r for r in jpeg.media_columns(rows).collect()}
    assert out[1]["_width"] == 77 and out[1].thumbnail == thumb.tobytes() and len(out[1].thumbnail_hash) == 16
    assert all(out[i].thumbnail is None and out[i]["_width"] is None for i in (2, 3, 4, 5))
    assert jpeg.media_columns(rows.limit(0)).count() == 0
