from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm.common import saved, table

from .cases import SCHEMA, prose
from .test_other_operators import labelled
from .test_text_operators import brute_classes, brute_decontaminate


def write_tables(spark, folder):
    rng = random.Random(12)
    rows = [(i, t, lang, rng.choice(["s0", "s0", "s1", None]), n) for i, t, lang, _, n in labelled(160)]
    items = [(k, prose(rng, 24)) for k in range(3)]
    for k in range(30):
        old = rng.choice(rows)
        text = old[1]
        if k % 3 == 0:
            text = f"{old[1]} {items[k % 2][1]} {old[1]}"
        elif k % 3 == 1 and len(text.split()) > 40:
            text = text + " more"
        rows.append((500 + k, text, old[2], old[3], len(text)))
    rows += [(900, None, "aa", "s0", None), (901, "", None, "s0", 0), (902, "12 34", "aa", "s1", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_each_stage_does_its_part(spark, tmp_path):
    rows, items = write_tables(spark, str(tmp_path))
    docs, kept = table(spark, str(tmp_path), "documents"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)))
        kept.append([tuple(r) for r in docs.select(*columns).collect()])
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    told, once, clean, mixed, dealt = kept
    # Only texts without letters, or those that no language encodes best, are gone.
    gone = {r[0] for r in rows} - {r[0] for r in told}
    assert gone >= {900, 901, 902} and len(gone) <= 8 and set(told) <= set(rows)
    assert sorted(r[0] for r in once) == sorted(min(g) for g in brute_classes(told))
    dirty = {r[0] for r in brute_decontaminate(once, items) if r[2]}
    assert dirty and sorted(r[0] for r in clean) == sorted(r[0] for r in once if r[0] not in dirty)
    assert set(mixed) <= set(clean) and max(collections.Counter(mixed).values()) <= 3
    assert collections.Counter(dealt) == collections.Counter(mixed)
    sizes = collections.Counter(r.shard for r in docs.collect())
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1


def test_run_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-2:] == ["shard", "slot"]


def test_stages_bear_repeated_and_null_ids_and_clashing_names(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i // 2 if i % 5 else None, t, lang, None if i % 7 == 0 else "s0", n) for i, t, lang, _, n in labelled(80)]
    rows += [rows[0], rows[0], (3, None, None, None, None), (3, prose(rng, 12), None, "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, name in enumerate(("rejected", "items", "n_words", "_rid", "first", "copies", "target", "shard", "slot")):
        docs = docs.withColumn(name, F.lit(k))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, prose(rng, 15))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = table(spark, str(tmp_path), "documents"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, str(tmp_path)))
        assert docs.columns[: len(columns)] == columns
        kept.append(collections.Counter(tuple(r) for r in docs.select(*columns[:5]).collect()))
    assert docs.columns[len(columns) :] == ["_shard", "_slot"]
    told, once, clean, mixed, dealt = kept
    assert not told - collections.Counter(rows) and rows[0] in once and once[rows[0]] == 1
    assert len({r[1] for r in once}) == once.total() and not clean - once and set(mixed) <= set(clean) and dealt == mixed
