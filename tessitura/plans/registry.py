"""The registered queries of the speech-corpus operators over the driver's tables, each with the DuckDB SQL it must equal.

Tables stand in for speech data: events are utterances (user = speaker, value = seconds), embeddings are feature vectors
(label = phone), suppliers and customers two corpora to match, line items results by condition. Floating sums depend on
the order of addition, so they are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..mixture import posteriors as mix
from ..operators import abx, corpus, frames, scans, summaries
from ..session import shared_dir
from ..sources import readers
from ..sources.readers import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _utts(spark: SparkSession, sf: str) -> DataFrame:
    """events as utterances of their users, end to end in order of time: one starts at the very number at which the last stops."""
    e = _t(spark, sf, "events").select(F.col("user_id").alias("spk"), F.col("event_id").alias("utt"), "ts", F.col("value").alias("duration"), F.col("event_type").alias("rec"))
    return corpus.running(e, "spk", ["ts", "utt"]).select("spk", "utt", "ts", "rec", "duration", F.col("prev").alias("start"), F.col("cum").alias("stop"))


_UTTS = "utts AS (SELECT user_id AS spk, event_id AS utt, ts, event_type AS rec, value AS duration, sum(value) OVER w - value AS start, sum(value) OVER w AS stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"


# Corpus ---------------------------------------------------------------------------------------------------------------


@query("SELECT user_id AS spk, round(sum(value), 4) AS amount FROM events GROUP BY user_id")
def speaker_amount(spark, sf):
    return corpus.speaker_amount(_utts(spark, sf)).select("spk", _r("amount", 4).alias("amount"))


@query("SELECT user_id AS spk, round(sum(value), 4) AS amount, count(*) AS n_utts, min(value) AS shortest FROM events GROUP BY user_id")
def speaker_stats(spark, sf):
    return corpus.speaker_stats(_utts(spark, sf)).withColumn("amount", _r("amount", 4))


@query("SELECT round(min(a), 4) AS least FROM (SELECT sum(value) AS a FROM events GROUP BY user_id)")
def least_amount(spark, sf):
    return corpus.least_amount(_utts(spark, sf)).select(_r("least", 4).alias("least"))


@query("SELECT user_id AS spk, event_type AS rec, round(sum(value), 4) AS amount FROM events GROUP BY user_id, event_type")
def recording_amount(spark, sf):
    return corpus.recording_amount(_utts(spark, sf)).withColumn("amount", _r("amount", 4))


def _speakers(spark, sf):
    return _t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("spk"), F.col("c_mktsegment").alias("gender"), F.col("c_acctbal").alias("amount"))


@query("SELECT c_custkey AS spk, c_mktsegment AS gender, c_acctbal AS amount, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer WHERE c_acctbal > 0")
def ranked_by_gender(spark, sf):
    s = _speakers(spark, sf)
    return corpus.ranked_by_gender(s.drop("gender"), s).select("spk", "gender", "amount", "rank")


@query("SELECT c_mktsegment AS gender, count(*) AS n, round(sum(c_acctbal), 4) AS amount FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def amounts_by_group(spark, sf):
    return corpus.amounts_by_group(_speakers(spark, sf)).withColumn("amount", _r("amount", 4))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_aligned(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return corpus.aligned(o, _t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")[0]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_unaligned(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return corpus.aligned(o, _t(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")[1]


@query("SELECT k, 'left' AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT k, 'right' FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def key_difference(spark, sf):
    return corpus.key_difference(_t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), _t(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k")


_HIST = """
WITH e AS (SELECT c_mktsegment AS gender, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_acctbal > 0 GROUP BY 1),
w AS (SELECT gender, CASE WHEN lo < hi THEN lo ELSE lo - 0.5 END AS lo, CASE WHEN lo < hi THEN hi ELSE hi + 0.5 END AS hi FROM e),
n AS (SELECT c.c_mktsegment AS gender, least(4, CAST(floor((c.c_acctbal - w.lo) / ((w.hi - w.lo) / 5)) AS INTEGER)) AS bin, count(*) AS n FROM customer c JOIN w ON w.gender = c.c_mktsegment WHERE c.c_acctbal > 0 GROUP BY 1, 2)
SELECT w.gender, CAST(b.bin AS INTEGER) AS bin, round(lo + (hi - lo) / 5 * b.bin, 6) AS low, round(lo + (hi - lo) / 5 * (b.bin + 1), 6) AS high, coalesce(n.n, 0) AS n
FROM w CROSS JOIN (SELECT unnest(range(5)) AS bin) b LEFT JOIN n ON n.gender = w.gender AND n.bin = b.bin
"""


@query(_HIST)
def hist5(spark, sf):
    return corpus.histogram(_speakers(spark, sf), ["gender"], "amount").withColumns({"low": _r("low"), "high": _r("high")})


_SLICES = f"""
WITH {_UTTS},
c AS (SELECT *, stop AS cum, coalesce(lag(stop) OVER (PARTITION BY spk ORDER BY ts, utt), 0) AS prev, last_value(stop) OVER (PARTITION BY spk ORDER BY ts, utt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM utts),
j AS (SELECT c.*, s.j, s.j * total / 10 AS low, (s.j + 1) * total / 10 AS high FROM c, (SELECT unnest(range(10)) AS j) s WHERE cum > s.j * total / 10 AND prev < (s.j + 1) * total / 10),
r AS (SELECT *, row_number() OVER (PARTITION BY spk, j ORDER BY ts, utt) AS f, row_number() OVER (PARTITION BY spk, j ORDER BY ts DESC, utt DESC) AS b FROM j)
SELECT spk AS user_id, utt AS event_id, CAST(j AS INTEGER) AS subset_id, round(CASE WHEN f = 1 AND prev <= low THEN stop - (cum - low) ELSE start END, 4) AS start, round(CASE WHEN b = 1 THEN stop - (cum - high) ELSE stop END, 4) AS stop FROM r
"""


@query(_SLICES)
def subset_slices(spark, sf):
    """Ten slices of equal duration of each speaker's utterances."""
    cut = corpus.subset_slices(_utts(spark, sf), 10, order=("ts", "utt"))
    return cut.select(F.col("spk").alias("user_id"), F.col("utt").alias("event_id"), "subset_id", _r("start", 4).alias("start"), _r("stop", 4).alias("stop"))


@query(f"WITH {_UTTS} SELECT spk, utt, round(stop, 4) AS cum, round(stop - duration, 4) AS prev FROM utts")
def running_sum(spark, sf):
    r = corpus.running(_t(spark, sf, "events").select(F.col("user_id").alias("spk"), F.col("event_id").alias("utt"), "ts", F.col("value").alias("duration")), "spk", ["ts", "utt"])
    return r.select("spk", "utt", _r("cum", 4).alias("cum"), _r(F.col("cum") - F.col("duration"), 4).alias("prev"))


_TRIM = f"""
WITH {_UTTS},
t AS (SELECT spk, sum(CAST(round(duration * 100) AS BIGINT)) * 7 // 10 AS target FROM utts GROUP BY spk),
p AS (SELECT u.*, CAST(round(u.duration * 100) AS BIGINT) AS d, t.target, sum(CAST(round(u.duration * 100) AS BIGINT)) OVER (PARTITION BY u.spk, rec) AS rt, sum(CAST(round(u.duration * 100) AS BIGINT)) OVER (PARTITION BY u.spk) AS al FROM utts u JOIN t USING (spk)),
r AS (SELECT *, sum(d) OVER o AS run FROM p WINDOW o AS (PARTITION BY spk ORDER BY rt, rec, ts DESC, utt ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, run - d AS before FROM r)
SELECT spk, utt FROM m WHERE NOT (al - run > target OR (al - before > target AND abs(target - (al - before)) > abs(target - (al - run))))
"""


@query(_TRIM)
def trim_prefix(spark, sf):
    """Utterances left when each speaker is trimmed to 70 % of its hundredths of seconds."""
    u = _utts(spark, sf).withColumn("duration", F.round(F.col("duration") * 100).cast("long"))
    goal = u.groupBy("spk").agg(F.expr("sum(duration) * 7 div 10").alias("target"))
    return corpus.trim(u, goal, start="ts").select("spk", "utt")


@query("""
WITH r AS (SELECT c_custkey AS spk, c_mktsegment AS gender, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS rn FROM customer WHERE c_acctbal > 0),
g AS (SELECT *, rn // 3 AS g FROM r)
SELECT spk, gender, CASE WHEN row_number() OVER (PARTITION BY gender, g ORDER BY spk % 7, spk) <= ceil(count(*) OVER (PARTITION BY gender, g) * 2 / 3.0 - 1e-9) THEN 'train' ELSE 'test' END AS part FROM g
""")
def balanced_split(spark, sf):
    return corpus.balanced_split(_speakers(spark, sf), order=F.col("spk") % 7).select("spk", "gender", "part")


@query()
def greedy_match(spark, sf):
    """Suppliers (small, by half their balance) matched with customers (big) of their nation's region by balance."""
    nation = _t(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("gender"))
    big = _t(spark, sf, "customer").where("c_acctbal > 0").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("gender", F.col("c_custkey").alias("spk"), F.col("c_acctbal").alias("amount"))
    small = _t(spark, sf, "supplier").where("s_acctbal > 0").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("gender", F.col("s_suppkey").alias("spk"), (F.col("s_acctbal") / 2).alias("amount"))
    return corpus.match_speakers(big, small)


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM n WHERE n >= 2 AND r <= 5
""")
def threshold_cells(spark, sf):
    items = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return corpus.threshold_cells(items, ["l_suppkey", "l_returnflag"], 2, 5, F.struct("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 100000")
def lowest_posteriors(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return corpus.lowest(rows, F.struct("l_extendedprice", "l_orderkey", "l_linenumber"))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1")
def most_common(spark, sf):
    return corpus.most_common(_t(spark, sf, "part").select(F.col("p_type").alias("value")), "value")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_type LIKE '%ECO%' AND p_size > 49)")
def without_phones(spark, sf):
    lexicon = _t(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_type").contains("ECO") & (F.col("p_size") > 49), "drop").otherwise("keep").alias("phone"))
    return corpus.without_phones(lexicon, ["drop"], word="p_brand").select("p_partkey", "p_brand")


@query("""
WITH l AS (SELECT user_id AS spk, event_type AS rec, max(value) AS length FROM events GROUP BY 1, 2),
o AS (SELECT spk, rec, coalesce(sum(length) OVER (PARTITION BY spk ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l)
SELECT e.event_id AS utt, e.user_id AS spk, e.user_id AS rec, round(off, 4) AS start, round(e.value + off, 4) AS stop FROM events e JOIN o ON o.spk = e.user_id AND o.rec = e.event_type
""")
def merged_recordings(spark, sf):
    u = _t(spark, sf, "events").select(F.col("event_id").alias("utt"), F.col("user_id").alias("spk"), F.col("event_type").alias("rec"), F.lit(0.0).alias("start"), F.col("value").alias("stop"))
    return corpus.merged_recordings(u).withColumns({"start": _r("start", 4), "stop": _r("stop", 4)})


# Frames and intervals --------------------------------------------------------------------------------------------------


def _frames(spark, sf):
    """One frame for each event at its middle."""
    return _utts(spark, sf).select("spk", F.col("utt").alias("frame"), (F.col("start") + F.col("duration") / 2).alias("t"))


_SEGS = "segs AS (SELECT spk, min(start) AS start, max(stop) AS stop, CAST(floor(rn / 4) AS BIGINT) AS seg FROM (SELECT *, row_number() OVER (PARTITION BY spk ORDER BY ts, utt) - 1 AS rn FROM utts) GROUP BY spk, floor(rn / 4))"


def _segs(spark, sf):
    numbered = scans.ranked(_utts(spark, sf), ["spk"], ["ts", "utt"], "rn")
    return numbered.withColumn("seg", F.floor((F.col("rn") - 1) / 4)).groupBy("spk", "seg").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


@query(f"WITH {_UTTS}, {_SEGS} SELECT u.spk, u.utt AS frame, s.seg FROM utts u JOIN segs s ON s.spk = u.spk AND u.start + u.duration / 2 BETWEEN s.start AND s.stop")
def range_join_frames(spark, sf):
    return frames.frames_in_segments(_frames(spark, sf), _segs(spark, sf), rec="spk").select("spk", "frame", "seg")


@query(f"WITH {_UTTS} SELECT utt, round(start + duration / 2 - start, 4) AS t FROM utts")
def rebase_times(spark, sf):
    u = _utts(spark, sf)
    return frames.rebase(_frames(spark, sf).withColumnRenamed("frame", "utt").select("utt", "t"), u).select("utt", _r("t", 4).alias("t"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS chunk FROM orders")
def chunked_rows(spark, sf):
    return frames.chunked(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 1000, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "chunk")


@query("SELECT vec_id FROM embeddings")
def shuffled_rows(spark, sf):
    return frames.shuffled(_t(spark, sf, "embeddings").select("vec_id"))


@query("SELECT p_brand AS rec, count(DISTINCT p_size) = 1 AS single FROM part GROUP BY 1")
def one_speaker_each(spark, sf):
    return frames.one_speaker_each(_t(spark, sf, "part").select(F.col("p_brand").alias("rec"), F.col("p_size").alias("spk")))


@query("SELECT bool_and(starts_with(p_brand, 'Brand')) AS prefixed FROM part")
def all_prefixed(spark, sf):
    return frames.all_prefixed(_t(spark, sf, "part").select(F.col("p_brand").alias("rec"), F.lit("Brand").alias("spk")))


@query("SELECT n_regionkey || '_' || n_name AS utt, n_name AS rec, CAST(n_regionkey AS VARCHAR) AS spk FROM nation")
def recordings_as_utterances(spark, sf):
    return frames.recordings_as_utterances(_t(spark, sf, "nation").select(F.col("n_name").alias("rec"), F.col("n_regionkey").cast("string").alias("spk")))


@query("SELECT vec_id, CAST(g - 1 AS INTEGER) AS frame, round(0.0125 + 0.01 * (g - 1), 6) AS t, round(CAST(embedding[g] AS DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS g)")
def long_features(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "v"))
    return e.select("vec_id", "frame", _r(F.lit(0.0125) + F.lit(0.01) * F.col("frame")).alias("t"), _r(F.col("v").cast("double")).alias("x"))


@query("SELECT c_custkey, substr(c_name, strpos(c_name, '#') + 1) AS rest FROM customer")
def without_speaker_prefix(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.translate("c_name", "#", "_").alias("utt"))
    return c.select("c_custkey", C.without_speaker_prefix(F.col("utt")).alias("rest"))


# Derived columns --------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(2 * (l_extendedprice - l_quantity) / (l_extendedprice + l_quantity), 6) AS rel FROM lineitem")
def relative_difference(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _r(C.relative_difference(F.col("l_extendedprice"), F.col("l_quantity"))).alias("rel"))


_MODELS = "models AS (SELECT o_orderkey, 'gmm_' || lower(o_orderstatus) || '_subsets' || (1 + o_orderkey % 1000) || '-' || (1 + o_custkey % 10) || '_iter' || (o_orderkey % 1501) || CASE WHEN o_orderkey % 3 = 0 THEN '-final' ELSE '' END AS name FROM orders)"


@query(f"""
WITH {_MODELS},
p AS (SELECT o_orderkey, CAST(split_part(substr(split_part(name, '_', 3), 8), '-', 1) AS INTEGER) AS split_factor, CAST(split_part(substr(split_part(name, '_', 3), 8), '-', 2) AS INTEGER) AS subset, CAST(regexp_replace(substr(split_part(name, '_', 4), 5), '-final$', '') AS INTEGER) AS iteration FROM models)
SELECT *, CAST(CASE WHEN split_factor > 100 THEN split_factor // 100 + 1 WHEN split_factor > 10 THEN split_factor // 10 + 1 ELSE split_factor END AS BIGINT) AS grp FROM p
""")
def parse_model_name(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("gmm_"), F.lower("o_orderstatus"), F.lit("_subsets"), (1 + key % 1000).cast("string"), F.lit("-"), (1 + cust % 10).cast("string"), F.lit("_iter"), (key % 1501).cast("string"), F.when(key % 3 == 0, "-final").otherwise(""))
    parsed = _t(spark, sf, "orders").select("o_orderkey", name.alias("name")).withColumns(C.parse_model_name(F.col("name"))).drop("name")
    return parsed.withColumn("grp", C.subcorpus_group(F.col("split_factor")))


_SETS = """CASE {0} % 5 WHEN 0 THEN 'WSJ' WHEN 1 THEN 'GPJ' WHEN 2 THEN 'BUC' WHEN 3 THEN 'CSJ' ELSE 'None' END"""
_LANGUAGE = "CASE WHEN {0} IN ('WSJ', 'BUC') THEN 'American English' WHEN {0} IN ('GPJ', 'CSJ') THEN 'Japanese' ELSE 'None' END"
_REGISTER = "CASE WHEN {0} IN ('WSJ', 'GPJ') THEN 'Read' WHEN {0} IN ('BUC', 'CSJ') THEN 'Spontaneous' ELSE 'None' END"


def _set(key):
    """A training or test set by a key; models that are not trained have the set 'None'."""
    return F.coalesce(C.recode((key % 5).cast("string"), {"0": "WSJ", "1": "GPJ", "2": "BUC", "3": "CSJ"}), F.lit("None"))


def _of_set(name, what: int):
    return F.coalesce(C.recode(name, {corpus: of[what] for corpus, of in C.CORPORA.items()}), F.lit("None"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber, {_SETS.format("l_suppkey")} AS x, {_SETS.format("l_partkey")} AS y FROM lineitem),
l AS (SELECT *, {_LANGUAGE.format("x")} AS lx, {_LANGUAGE.format("y")} AS ly, {_REGISTER.format("x")} AS rx, {_REGISTER.format("y")} AS ry FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN x = 'None' OR y = 'None' THEN 'NA' WHEN x = y THEN 'same C' WHEN lx = ly AND rx <> ry THEN 'same L diff R' WHEN rx = ry AND lx <> ly THEN 'diff L same R' WHEN lx = ly AND rx = ry THEN 'same L same R' ELSE 'diff L diff R' END AS cond FROM l
""")
def condition_case(spark, sf):
    """How the sets of training and test match, 'None' on either side included."""
    x, y = F.col("x"), F.col("y")
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _set(F.col("l_suppkey")).alias("x"), _set(F.col("l_partkey")).alias("y"))
    cond = C.train_test_match(_of_set(x, 0), _of_set(y, 0), _of_set(x, 1), _of_set(y, 1), x, y)
    return rows.select("l_orderkey", "l_linenumber", cond.alias("cond"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS code FROM customer")
def recode(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", C.recode(F.col("c_mktsegment"), {"BUILDING": "b", "MACHINERY": "m"}).alias("code"))


@query("SELECT doc_id, split_part(replace(text, chr(10), '_'), '_', 1) AS first, split_part(replace(text, chr(10), '_'), '_', -1) AS last FROM documents")
def name_parts(spark, sf):
    name = F.translate("text", "\n", "_")
    return _t(spark, sf, "documents").select("doc_id", C.first_part(name).alias("first"), C.last_part(name).alias("last"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' AND (p_type LIKE '%ECO%' OR p_type LIKE '%PRO%')")
def name_filter(spark, sf):
    p = _t(spark, sf, "part")
    return p.where(C.name_contains(F.col("p_name"), all_of=("ring",)) & C.name_contains(F.col("p_type"), any_of=("ECO", "PRO"))).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE split_part(CASE n_regionkey % 3 WHEN 0 THEN 'SIL' WHEN 1 THEN 'a' ELSE 'SPN' END || '-' || n_name, '-', 1) NOT IN ('NSN', 'SPN', 'SIL')")
def not_silence(spark, sf):
    m = F.col("n_regionkey") % 3
    contrast = F.concat(F.when(m == 0, "SIL").when(m == 1, "a").otherwise("SPN"), F.lit("-"), F.col("n_name"))
    return _t(spark, sf, "nation").where(C.not_silence(contrast)).select("n_nationkey")


@query("SELECT doc_id, CASE source WHEN 'src0' THEN 'American English' WHEN 'src1' THEN 'Japanese' WHEN 'src2' THEN 'American English' WHEN 'src3' THEN 'Japanese' END AS train_language, CASE source WHEN 'src0' THEN 'Read' WHEN 'src1' THEN 'Read' WHEN 'src2' THEN 'Spontaneous' WHEN 'src3' THEN 'Spontaneous' END AS train_register FROM documents")
def language_register(spark, sf):
    code = C.recode(F.col("source"), {"src0": "WSJ", "src1": "GPJ", "src2": "BUC", "src3": "CSJ"})
    return C.with_language_register(_t(spark, sf, "documents").select("doc_id", code.alias("corpus")), "corpus", "train").drop("corpus")


@query(f"""
WITH s AS (SELECT c_custkey, {_SETS.format("c_nationkey")} AS x FROM customer), l AS (SELECT *, {_LANGUAGE.format("x")} AS lx FROM s)
SELECT c_custkey, CASE WHEN x = 'None' THEN 'No language tuning' WHEN lx = 'American English' THEN 'Am. Eng. native' ELSE 'Jap. native' END AS cond FROM l
""")
def tuning_condition(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", _set(F.col("c_nationkey")).alias("x"))
    return rows.select("c_custkey", C.tuning_condition(F.col("x"), _of_set(F.col("x"), 0)).alias("cond"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'WSJ' WHEN 1 THEN 'GPJ' WHEN 2 THEN 'BUC' ELSE 'CSJ' END AS train, CASE c_mktsegment WHEN 'BUILDING' THEN 'HMM-phone' WHEN 'MACHINERY' THEN 'HMM-state' ELSE 'GMM' END AS model FROM customer),
g AS (SELECT *, CASE WHEN train IN ('WSJ', 'GPJ') THEN 'GMM (read)' ELSE 'GMM (spont.)' END AS gmm, CASE model WHEN 'HMM-phone' THEN 'Phoneme recognizer baseline' WHEN 'HMM-state' THEN 'Phone-state baseline' END AS baseline FROM c)
SELECT c_custkey, coalesce(baseline, gmm) AS cond, coalesce(baseline, gmm || ' 1-2h') AS cond_small, CASE WHEN train IN ('WSJ', 'BUC') THEN 'AE' ELSE 'JP' END AS test_lang FROM g
""")
def model_condition(spark, sf):
    train = C.recode((F.col("c_nationkey") % 4).cast("string"), {"0": "WSJ", "1": "GPJ", "2": "BUC", "3": "CSJ"})
    model = F.coalesce(C.recode(F.col("c_mktsegment"), {"BUILDING": "HMM-phone", "MACHINERY": "HMM-state"}), F.lit("GMM"))
    c = _t(spark, sf, "customer").select("c_custkey", train.alias("train"), model.alias("model"))
    both = [C.model_condition(F.col("train"), F.col("model"), amount) for amount in ("", "1-2h")]
    lang = C.recode(F.col("train"), {"WSJ": "AE", "BUC": "AE", "GPJ": "JP", "CSJ": "JP"})
    return c.select("c_custkey", both[0].alias("cond"), both[1].alias("cond_small"), lang.alias("test_lang"))


@query("SELECT event_id, round(value * 0.5, 6) AS raw, round(value * 0.5 / ln(2), 6) AS bits, round(1000 * value, 6) AS ms, round(value * 100, 6) AS frames FROM events")
def unit_conversions(spark, sf):
    v, raw = F.col("value"), C.scaled(F.col("value"), F.lit(0.5))
    return _t(spark, sf, "events").select("event_id", _r(raw).alias("raw"), _r(C.bits(raw)).alias("bits"), _r(C.milliseconds(v)).alias("ms"), _r(C.frames_of(v)).alias("frames"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) ELSE 'None' END AS spk FROM events")
def speaker_placeholder(spark, sf):
    return _t(spark, sf, "events").select("event_id", C.speaker_or_placeholder(F.col("user_id").cast("string"), F.col("event_type") == "click").alias("spk"))


# Summaries -------------------------------------------------------------------------------------------------------------


def _results(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model_type"), F.when(F.col("l_partkey") % 2 == 0, "C").otherwise("V").alias("contrast_type"), F.col("l_linestatus").alias("cond"), F.col("l_discount").alias("error"), F.col("l_quantity").alias("size"))


_RES = "res AS (SELECT l_returnflag AS model_type, CASE WHEN l_partkey % 2 = 0 THEN 'C' ELSE 'V' END AS contrast_type, l_linestatus AS cond, l_discount AS error, l_quantity AS size FROM lineitem)"


@query(f"WITH {_RES} SELECT model_type, contrast_type, cond, round(avg(error), 6) AS error, round(avg(size), 6) AS size FROM res GROUP BY 1, 2, 3")
def condition_mean(spark, sf):
    return summaries.by_condition(_results(spark, sf), ["cond"], ["error", "size"]).withColumns({"error": _r("error"), "size": _r("size")})


@query(f"WITH {_RES}, m AS (SELECT model_type, contrast_type, cond, avg(error) AS error FROM res GROUP BY 1, 2, 3) SELECT model_type, cond, round(avg(error), 6) AS error FROM m GROUP BY 1, 2")
def mean_of_means(spark, sf):
    means = summaries.by_condition(_results(spark, sf), ["cond"], ["error"])
    return summaries.consonants_and_vowels(means, ["cond"], ["error"]).withColumn("error", _r("error"))


@query("""
WITH b AS (SELECT l_returnflag AS model_type, l_quantity AS v, b.boot_id, (l_orderkey * 31 + l_linenumber * 17 + b.boot_id * 13) % 4 AS times FROM lineitem, (SELECT unnest(range(1000)) AS boot_id) b),
s AS (SELECT model_type, boot_id, sum(v * times) / sum(times) AS v FROM b WHERE times > 0 GROUP BY 1, 2),
e AS (SELECT l_returnflag AS model_type, avg(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT e.model_type, round(e.v, 6) AS v, round(d.std, 6) AS std FROM e LEFT JOIN (SELECT model_type, stddev_samp(v) AS std FROM s GROUP BY 1) d USING (model_type)
""")
def bootstrap_std(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model_type"), F.col("l_quantity").alias("v"), (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17).alias("k"))
    boots = summaries.bootstrap_sums(rows, 1000, ["model_type"], "v", F.col("k"), weight=lambda b, k: (k + b * 13) % 4).select("model_type", "boot_id", (F.col("total") / F.col("times")).alias("v"))
    return summaries.with_std(summaries.mean_by(rows, ["model_type"], ["v"]), boots, ["model_type"], "v").select("model_type", _r("v").alias("v"), _r("std").alias("std"))


@query("SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS nunique FROM part GROUP BY 1, 2")
def even_words(spark, sf):
    return summaries.even_words(_t(spark, sf, "part"), ["p_brand", "p_size"], "p_retailprice").select("p_brand", "p_size", _r("p_retailprice").alias("nunique"))


@query("SELECT p_brand, true AS by_spk, round(avg(p_retailprice), 6) AS v FROM part WHERE p_size <= 25 GROUP BY 1 UNION ALL SELECT p_brand, false, round(p_retailprice, 6) FROM part WHERE p_size > 25")
def over_speakers(spark, sf):
    p = _t(spark, sf, "part").select("p_brand", (F.col("p_size") <= 25).alias("by_spk"), F.col("p_retailprice").alias("v"))
    return summaries.over_speakers(p, ["p_brand"], "v").withColumn("v", _r("v"))


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS v, round(stddev_samp(p_retailprice), 6) AS std FROM part GROUP BY 1")
def over_seeds(spark, sf):
    p = _t(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("v"))
    return summaries.over_seeds(p, ["p_brand"], "v").withColumns({"v": _r("v"), "std": _r("std")})


@query("WITH a AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), b AS (SELECT p_brand, avg(v) AS v FROM a GROUP BY 1) SELECT round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM b")
def two_level_mean(spark, sf):
    return summaries.two_level_mean(_t(spark, sf, "part"), "p_brand", "p_size", "p_retailprice").select(_r("mean").alias("mean"), _r("std").alias("std"))


@query("SELECT DISTINCT l_returnflag AS cond, l_discount AS y FROM lineitem")
def distinct_averages(spark, sf):
    return summaries.distinct_averages(_t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cond"), F.col("l_discount").alias("y")), ["cond"], "y")


@query("SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END), 6) AS not_negative, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative, round(avg(CASE WHEN c_acctbal = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero FROM customer GROUP BY 1")
def sign_fractions(spark, sf):
    f = summaries.sign_fractions(_t(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])
    return f.withColumns({c: _r(c) for c in ("not_negative", "positive", "negative", "zero")})


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def distinct_contrasts(spark, sf):
    return summaries.distinct_count(_t(spark, sf, "lineitem"), "l_partkey")


@query("SELECT l_suppkey, count(*) AS n_components FROM lineitem GROUP BY 1")
def component_counts(spark, sf):
    return summaries.component_counts(_t(spark, sf, "lineitem"), ["l_suppkey"])


@query("SELECT coalesce(a.k, b.k) AS k, a.d, b.info FROM (SELECT c_custkey AS k, c_acctbal AS d FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS k, c_mktsegment AS info FROM customer WHERE c_custkey % 2 > 0) b ON a.k = b.k")
def outer_join_units(spark, sf):
    c = _t(spark, sf, "customer")
    return summaries.units_with_durations(c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("d")), c.where("c_custkey % 2 > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("info")), ("k",))


@query("""
WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS e FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, round(a.e, 6) AS e_a, round(n.e, 6) AS e_n, round(r.e, 6) AS e_r FROM m a JOIN m n ON n.l_suppkey = a.l_suppkey AND n.l_returnflag = 'N' JOIN m r ON r.l_suppkey = a.l_suppkey AND r.l_returnflag = 'R' WHERE a.l_returnflag = 'A'
""")
def merge_all(spark, sf):
    m = summaries.mean_by(_t(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_discount"]).withColumnRenamed("l_discount", "e")
    parts = [m.where(F.col("l_returnflag") == f).select("l_suppkey", "e") for f in ("A", "N", "R")]
    out = summaries.merge_all(parts, ["l_suppkey"], ["_a", "_n", "_r"])
    return out.select("l_suppkey", *[_r(c).alias(c) for c in ("e_a", "e_n", "e_r")])


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber % 2 AS test, avg(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS a, avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(test AS INTEGER) AS test, round(CASE WHEN test = 0 THEN n - a ELSE a - n END, 6) AS advantage FROM m WHERE a IS NOT NULL AND n IS NOT NULL
""")
def native_advantage(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 2).cast("int").alias("test"), "l_returnflag", "l_discount")
    wide = summaries.by_level(rows, ["l_suppkey", "test"], "l_returnflag", ["A", "N"], "l_discount")
    return wide.select("l_suppkey", "test", _r(C.native_advantage(F.col("test"), 0, F.col("A"), F.col("N"))).alias("advantage"))


@query("SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey")
def lookup_types(spark, sf):
    types = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", F.col("p_size").alias("size"))
    return summaries.lookup(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), types, "l_partkey").drop("l_partkey")


@query("SELECT c_custkey AS k, c_acctbal AS bal, NULL AS seg FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def stacked(spark, sf):
    return summaries.stacked([_t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("seg"))])


@query("SELECT p_partkey, 'p_size' AS count_type, CAST(p_size AS DOUBLE) AS nunique FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_bounds(spark, sf):
    return summaries.bounds_as_rows(_t(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double")), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT DISTINCT a.p_size AS factor, b.l_returnflag AS train FROM part a, (SELECT DISTINCT l_returnflag FROM lineitem) b")
def parameter_grid(spark, sf):
    """Every split factor with every training set, of those that the tables have."""
    return summaries.grid(_t(spark, sf, "part").select(F.col("p_size").alias("factor")), _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("train")))


# ABX -------------------------------------------------------------------------------------------------------------------


def _items(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("phone"), (F.col("vec_id") % 5).alias("speaker"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_ITEMS = "items AS (SELECT vec_id AS id, label AS phone, vec_id % 5 AS speaker, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_TASK = "task AS (SELECT a.speaker, a.id AS a, b.id AS b, x.id AS x, a.phone AS on_a, b.phone AS on_b FROM items a JOIN items x ON x.speaker = a.speaker AND x.phone = a.phone AND x.id <> a.id JOIN items b ON b.speaker = a.speaker AND b.phone <> a.phone)"


@query("""
WITH i AS (SELECT vec_id % 5 AS speaker, label AS phone, count(*) AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY speaker) AS al FROM i)
SELECT speaker, CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_levels, CAST(sum(n * (n - 1) * (al - n)) AS BIGINT) AS n_triplets FROM t GROUP BY 1
""")
def abx_triplet_counts(spark, sf):
    return abx.triplet_counts(_items(spark, sf), "phone", ["speaker"])


@query(f"WITH {_ITEMS}, {_TASK} SELECT * FROM task")
def abx_triplets(spark, sf):
    return abx.triplets(_items(spark, sf), "phone", ["speaker"])


@query(f"""
WITH {_ITEMS}, {_TASK},
d AS (SELECT *, round(acos(greatest(-1, least(1, list_dot_product(xa.x, xx.x) / (sqrt(list_dot_product(xa.x, xa.x)) * sqrt(list_dot_product(xx.x, xx.x)))))) / pi(), 9) AS da, round(acos(greatest(-1, least(1, list_dot_product(xb.x, xx.x) / (sqrt(list_dot_product(xb.x, xb.x)) * sqrt(list_dot_product(xx.x, xx.x)))))) / pi(), 9) AS db FROM task t JOIN items xa ON xa.id = t.a JOIN items xb ON xb.id = t.b JOIN items xx ON xx.id = t.x)
SELECT on_a, on_b, round(avg(CASE WHEN da < db THEN 1.0 WHEN da > db THEN -1.0 ELSE 0.0 END), 6) AS score, count(*) AS n, round(avg(CASE WHEN da < db THEN 0.0 WHEN da > db THEN 1.0 ELSE 0.5 END), 6) AS error FROM d GROUP BY 1, 2
""")
def abx_scored_cos(spark, sf):
    return abx.cell_scores(_items(spark, sf), "cos", "phone", ["speaker"], over=[], digits=9).select("on_a", "on_b", _r("score").alias("score"), "n", _r("error").alias("error"))


_ASKED = "asked AS (SELECT least(a, x) AS i, greatest(a, x) AS j FROM task UNION SELECT least(b, x), greatest(b, x) FROM task)"
_NEAR = _TASK + ", " + _ASKED + ", near AS (SELECT i, j, p.x AS x, q.x AS y FROM asked JOIN items p ON p.id = i JOIN items q ON q.id = j)"


def _near(items, distance, **options):
    """The distances that the task (phones within speakers) asks for."""
    return abx.cell_distances(items, distance, "phone", ["speaker"], **options)


@query(f"WITH {_ITEMS}, {_TASK}, {_ASKED} SELECT i, j FROM asked")
def abx_pairs(spark, sf):
    return abx.task_pairs(_items(spark, sf), "phone", ["speaker"])


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label")
def stimulus_pairs(spark, sf):
    """All pairs of a phone's stimuli."""
    return abx.cell_distances(_items(spark, sf), "euc", by=["phone"], digits=6).select("i", "j", "d")


@query(f"WITH {_ITEMS}, {_NEAR} SELECT i, j, round(list_distance(x, y), 6) AS d FROM near")
def pairwise_euclid(spark, sf):
    return _near(_items(spark, sf), "euc", digits=6).select("i", "j", "d")


@query(f"WITH {_ITEMS}, {_NEAR} SELECT i, j, round(acos(greatest(-1, least(1, list_cosine_similarity(x, y)))) / pi(), 6) AS d FROM near")
def pairwise_angular(spark, sf):
    return _near(_items(spark, sf), "cos", digits=6).select("i", "j", "d")


@query(f"""
WITH {_ITEMS}, {_TASK}, {_ASKED}, s AS (SELECT id, list_transform(x, lambda v: exp(v)) AS e FROM items), n AS (SELECT id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM s)
SELECT a.id AS i, b.id AS j, round(list_sum(list_transform(range(1, 65), lambda k: (a.p[k] - b.p[k]) * (ln(a.p[k]) - ln(b.p[k])))), 6) AS d FROM asked JOIN n a ON a.id = i JOIN n b ON b.id = j
""")
def pairwise_kl(spark, sf):
    soft = _items(spark, sf).withColumn("x", C.softmax(F.col("x")))
    return _near(soft, "kl", digits=6).select("i", "j", "d")


@query()
def dtw_distance(spark, sf):
    """Warped angular distance of the task's pairs, each vector cut into eight frames of eight."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("x", k * 8 + 1, F.lit(8)))
    items = _items(spark, sf).withColumn("x", cut)
    return _near(items, "cos", warp=True, digits=6).select("i", "j", "d")


@query("SELECT event_id, user_id, event_type AS phone, lag(event_type) OVER w AS prev_phone, lead(event_type) OVER w AS next_phone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def phone_items(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("utt"), F.col("event_type").alias("phone"), "ts", "event_id")
    spk = e.select("utt").distinct().withColumn("spk", F.col("utt"))
    return abx.phone_items(e, spk, ["ts", "event_id"]).select("event_id", F.col("utt").alias("user_id"), "phone", "prev_phone", "next_phone")


def _units(spark, sf):
    e = scans.ranked(_t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "rn")
    return e.select(F.col("user_id").alias("item"), (F.col("rn") - 1).alias("frame"), F.col("event_type").alias("unit"))


@query("""
WITH u AS (SELECT user_id, event_type AS unit, row_number() OVER w AS r, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY r) AS run FROM u), n AS (SELECT user_id, run, unit, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT unit, count(*) AS n, round(avg(n) * 0.01, 6) AS duration FROM n WHERE n > 1 GROUP BY 1
""")
def unit_activations(spark, sf):
    return abx.activation_durations(_units(spark, sf), 1).withColumn("duration", _r("duration"))


@query("SELECT event_type AS phone, user_id AS spk, round(avg(value), 9) AS duration FROM events GROUP BY 1, 2")
def phone_durations(spark, sf):
    e = _t(spark, sf, "events").select(F.col("event_id").alias("utt"), F.col("event_type").alias("phone"), F.lit(0.0).alias("start"), F.col("value").alias("stop"), F.col("user_id").alias("spk"))
    return abx.phone_durations(e.drop("spk"), e.select("utt", "spk")).withColumn("duration", _r("duration", 9))


# Mixtures --------------------------------------------------------------------------------------------------------------


@query("SELECT label, CAST(g - 1 AS INTEGER) AS dim, count(*) AS n, round(sum(CAST(embedding[g] AS DOUBLE)), 6) AS sum, round(sum(CAST(embedding[g] AS DOUBLE) * CAST(embedding[g] AS DOUBLE)), 6) AS sum_sq FROM embeddings, (SELECT unnest(range(1, 65)) AS g) GROUP BY 1, 2")
def gmm_suffstats(spark, sf):
    s = mix.diagonal_stats(_t(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double"))), "label", "embedding")
    return s.withColumns({"sum": _r("sum"), "sum_sq": _r("sum_sq")})


#: Coordinates of an embedding.
_DIM = 64


def _points(spark, sf):
    """Whole vectors as points labelled by class."""
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("pid"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").alias("z"))


@query("SELECT label AS z, CAST(g AS INTEGER) AS i, CAST(h AS INTEGER) AS j, count(*) AS n, round(sum(CAST(embedding[g] AS DOUBLE) * CAST(embedding[h] AS DOUBLE)), 6) AS s FROM embeddings, (SELECT unnest(range(1, 65)) AS g), (SELECT unnest(range(1, 65)) AS h) GROUP BY 1, 2, 3")
def full_suffstats(spark, sf):
    """Each class's matrix of second moments."""
    s = _class_stats(spark, sf).select("z", F.element_at("stat", 1).cast("long").alias("n"), F.posexplode(F.slice("stat", 2 + _DIM, _DIM * _DIM)).alias("at", "s"))
    return s.select("z", (F.floor(F.col("at") / _DIM) + 1).cast("int").alias("i"), (F.col("at") % _DIM + 1).cast("int").alias("j"), "n", _r("s").alias("s"))


def _class_stats(spark, sf):
    from ..mixture.priors import NormalInverseWishart
    import numpy as np

    return mix.component_stats(_points(spark, sf).withColumn("side", F.lit(0)), NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM)))


@query("SELECT p_brand, p_size, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def multinomial_counts(spark, sf):
    docs = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return mix.term_counts(docs, "p_brand", "p_size", "l_quantity").withColumn("n", F.col("n").cast("long"))


@query("""
WITH c AS (SELECT p_brand, p_size, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
k AS (SELECT p_brand, sum(lgamma(n + 1.0)) AS l, sum(n) AS t, count(*) AS m FROM c GROUP BY 1)
SELECT round(sum(l + lgamma(50.0) - lgamma(t + 50.0)) / 1e6, 6) AS value FROM k
""")
def dirichlet_marginal(spark, sf):
    """Log marginal of term counts by brand under a symmetric Dirichlet(1) over 50 terms, in millions."""
    each = mix.count_marginals(multinomial_counts(spark, sf), ["p_brand"], 50)
    return each.agg(_r(F.sum("value") / 1e6).alias("value"))


_COUNTS = "c AS (SELECT p_brand, p_size, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


@query(f"""
WITH {_COUNTS}, k AS (SELECT p_brand, sum(lgamma(n + 1.0)) + lgamma(50.0) - lgamma(sum(n) + 50.0) AS v FROM c GROUP BY 1),
p AS (SELECT x.p_brand AS a, y.p_brand AS b, x.v + y.v AS apart FROM k x JOIN k y ON x.p_brand < y.p_brand),
m AS (SELECT a, b, any_value(apart) AS apart, p_size, sum(n) AS n FROM p JOIN c ON c.p_brand IN (a, b) GROUP BY a, b, p_size)
SELECT a, b, round(sum(lgamma(n + 1.0)) + lgamma(50.0) - lgamma(sum(n) + 50.0) - any_value(apart), 2) AS gain FROM m GROUP BY a, b
""")
def merge_gains(spark, sf):
    """What the log marginal gains if two brands' part sizes are one component's."""
    counts = multinomial_counts(spark, sf).withColumnsRenamed({"p_brand": "component", "p_size": "term"})
    return mix.merge_gains(counts, 50).withColumn("gain", _r("gain", 2))


@query("""
WITH d AS (SELECT l_suppkey AS pid, p_size AS term, sum(l_quantity) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
c AS (SELECT l_returnflag AS component, p_size AS term, sum(l_quantity) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
t AS (SELECT component, sum(n) AS t FROM c GROUP BY 1),
s AS (SELECT pid, term, d.n, t.component, ln((coalesce(c.n, 0) + 1.0) / (t + 50.0)) AS lp FROM d CROSS JOIN t LEFT JOIN c USING (component, term))
SELECT pid, component, round(lgamma(sum(n) + 1.0) - sum(lgamma(n + 1.0)) + sum(n * lp), 2) AS log_p FROM s GROUP BY 1, 2
""")
def count_densities(spark, sf):
    """Log probability of each supplier's part sizes under those of each return flag."""
    sold = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    docs = mix.term_counts(sold, "l_suppkey", "p_size", "l_quantity").withColumnsRenamed({"l_suppkey": "pid", "p_size": "term"})
    counts = mix.term_counts(sold, "l_returnflag", "p_size", "l_quantity").withColumnsRenamed({"l_returnflag": "component", "p_size": "term"})
    return mix.count_densities(docs, counts, 50).withColumn("log_p", _r("log_p", 2))


@query("""
WITH x AS (SELECT label, CAST(g AS INTEGER) AS dim, CAST(embedding[g] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS g)),
n AS (SELECT label, dim, count(*) AS n, sum(v) AS t, sum(v * v) AS q FROM x GROUP BY 1, 2),
p AS (SELECT dim, n, 1.0 + n AS kappa, 4.0 + n AS nu, t / (1.0 + n) AS theta, q FROM n),
s AS (SELECT dim, n, kappa, nu, 4.0 + q - kappa * theta * theta AS scale FROM p),
m AS (SELECT dim, n, -n / 2.0 * ln(pi()) + lgamma(nu / 2) - lgamma(2.0) + 2.0 * ln(4.0) - nu / 2 * ln(scale) - 0.5 * ln(kappa) AS ml FROM s)
SELECT dim, round(lgamma(1.0) - lgamma(1.0 + sum(n)) + sum(lgamma(n) + ml), 4) AS value FROM m GROUP BY 1
""")
def joint_loglik(spark, sf):
    """Log probability of the labels with each coordinate by itself, under a Dirichlet process of Gaussians."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart

    one, stats = NormalInverseWishart(np.zeros(1), np.eye(1)), {r.z: np.array(r.stat) for r in _class_stats(spark, sf).collect()}
    at = lambda s, k: s[[0, 1 + k, 1 + _DIM + k * (_DIM + 1)]]
    return spark.createDataFrame([(k + 1, round(mix.joint_log_likelihood({z: at(s, k) for z, s in stats.items()}, one), 4)) for k in range(_DIM)], "dim int, value double")


@query("""
WITH x AS (SELECT vec_id, label, CAST(g AS INTEGER) AS dim, CAST(embedding[g] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS g)),
n AS (SELECT label, dim, 1.0 + count(*) AS kappa, 4.0 + count(*) AS df, sum(v) / (1.0 + count(*)) AS m, sum(v * v) AS q FROM x GROUP BY 1, 2),
p AS (SELECT label, dim, df, m, (4.0 + q - kappa * m * m) * (kappa + 1) / (kappa * df) AS s FROM n)
SELECT vec_id, round(sum(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi() * s) - (df + 1) / 2 * ln(1 + (v - m) * (v - m) / (df * s))), 4) AS log_p FROM x JOIN p USING (label, dim) GROUP BY 1
""")
def predictive_density(spark, sf):
    """Log density of each vector as one more of its class, each coordinate by itself."""
    x = _t(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    t = mix.coordinate_predictives(mix.diagonal_stats(x, "label"), "label")
    t = t.withColumn("constant", C.log_gamma((F.col("df") + 1) / 2) - C.log_gamma(F.col("df") / 2))
    each = x.select("vec_id", "label", F.posexplode("x").alias("dim", "v")).join(t, ["label", "dim"])
    log_p = mix.student_log_density(F.col("v"), F.col("df"), F.col("centre"), F.col("spread"), F.col("constant"))
    return each.groupBy("vec_id").agg(_r(F.sum(log_p), 4).alias("log_p"))


@query("SELECT CAST(g AS INTEGER) AS i, CAST(h AS INTEGER) AS j, round(avg(CAST(embedding[g] AS DOUBLE)), 5) + 0.0 AS mean, round(covar_samp(CAST(embedding[g] AS DOUBLE), CAST(embedding[h] AS DOUBLE)), 5) + 0.0 AS cov FROM embeddings, (SELECT unnest(range(1, 65)) AS g), (SELECT unnest(range(1, 65)) AS h) GROUP BY 1, 2")
def global_moments(spark, sf):
    """Mean and covariance of all vectors: what the prior of a mixture is made of."""
    mean, cov = mix.global_moments(_points(spark, sf).select("pid", "x"))
    return spark.createDataFrame([(i + 1, j + 1, float(mean[i]), float(cov[i, j])) for i in range(_DIM) for j in range(_DIM)], "i int, j int, mean double, cov double").withColumns({"mean": _r("mean", 5) + 0.0, "cov": _r("cov", 5) + 0.0})  # no negative zeros


@query("SELECT count(*) AS k, max(n) AS largest FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def largest_component(spark, sf):
    """How many components there are, and how many points the largest has."""
    return mix.component_sizes(_points(spark, sf))


@query()
def joint_loglik_full(spark, sf):
    """The same with whole vectors under full covariances."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart

    return spark.createDataFrame([(round(mix.label_log_likelihood(_points(spark, sf), NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM))), 4),)], "value double")


def _diagonal_model(spark, sf):
    s = mix.diagonal_stats(_points(spark, sf), "z", "x").withColumn("m", F.col("sum") / F.col("n"))
    s = s.withColumn("v", F.col("sum_sq") / F.col("n") - F.col("m") * F.col("m"))
    packed = s.groupBy("z").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "m", "v"))).alias("a"))
    return packed.select(F.col("z").alias("component"), F.log(F.col("n")).alias("log_weight"), F.transform("a", lambda c: c["m"]).alias("mean"), F.transform("a", lambda c: c["v"]).alias("var"))


_POST = """
WITH x AS (SELECT vec_id, label, CAST(g AS INTEGER) AS dim, CAST(embedding[g] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS g)),
s AS (SELECT label, dim, count(*) AS n, sum(v) / count(*) AS m, sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)) AS var FROM x GROUP BY 1, 2),
j AS (SELECT x.vec_id, s.label AS component, max(ln(s.n)) - 0.5 * (sum((x.v - s.m) * (x.v - s.m) / s.var + ln(s.var)) + 64 * ln(2 * pi())) AS j FROM x JOIN s ON s.dim = x.dim GROUP BY 1, 2),
t AS (SELECT *, max(j) OVER (PARTITION BY vec_id) AS m FROM j),
p AS (SELECT vec_id, component, exp(j - m) / sum(exp(j - m)) OVER (PARTITION BY vec_id) AS post FROM t)
"""


@query(_POST + "SELECT vec_id AS pid, component, round(post, 6) AS post FROM p")
def gmm_posterior(spark, sf):
    return mix.diagonal_posteriors(_points(spark, sf), _diagonal_model(spark, sf), "pid").withColumn("post", _r("post"))


@query(_POST + "SELECT vec_id AS pid, arg_max(component, post) AS component FROM p GROUP BY 1")
def label_reassign(spark, sf):
    return mix.best_components(_points(spark, sf), _diagonal_model(spark, sf), "pid")


@query()
def gmm_posterior_full(spark, sf):
    """Posteriors under full covariances: a component for each class, at its posterior mean under a unit prior."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart

    prior, rows = NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM)), []
    for r in sorted(_class_stats(spark, sf).collect(), key=lambda r: r.z):
        _, nu, theta, scale = prior.posterior(np.array(r.stat))
        rows.append((r.z, float(np.log(r.stat[0])), theta.tolist(), (scale / nu).tolist()))
    model = spark.createDataFrame(rows, "component int, log_weight double, mean array<double>, cov array<array<double>>")
    return mix.posteriors(_points(spark, sf), model).select("pid", F.transform("post", lambda p: F.round(p, 6)).alias("post"))


#: Sweeps of the registered fits; `fit` defaults to 1500.
SWEEPS = 40
#: Sweeps over the words of all documents.
WORD_SWEEPS = 8


@query()
def dpmm_fit(spark, sf):
    """The sub-cluster sampler over whole vectors: the trace without its times."""
    from ..mixture.priors import NormalInverseWishart
    from ..mixture.sampler import fit

    points = _points(spark, sf).select("pid", "x")
    mean, cov = mix.global_moments(points)
    return fit(points, NormalInverseWishart(mean, cov), steps=SWEEPS, k=4).trace_table().select("iter", "loglik", "k", "nk")


@query()
def connected_superclusters(spark, sf):
    """Groups of classes linked by a sampled nearest neighbour, by divergence of their Gaussians."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart
    from ..mixture.sampler import Cluster, superclusters

    prior = NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM))
    rows = sorted(_class_stats(spark, sf).collect(), key=lambda r: r.z)
    rng = np.random.default_rng(0)
    clusters = [Cluster([np.array(r.stat), np.zeros(prior.size)], prior.draw(np.array(r.stat), rng)) for r in rows]
    return spark.createDataFrame([(r.z, int(g)) for r, g in zip(rows, superclusters(clusters, prior, rng), strict=True)], "z int, grp int")


@query("""
WITH RECURSIVE x AS (SELECT label, g AS dim, CAST(embedding[g] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS g)),
s AS (SELECT label, dim, sum(v) / count(*) AS m, sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)) AS var FROM x GROUP BY 1, 2),
d AS (SELECT a.label AS a, b.label AS b, sum(0.5 * (b.var / a.var + a.var / b.var + (a.m - b.m) * (a.m - b.m) * (1 / a.var + 1 / b.var)) - 1) AS d FROM s a JOIN s b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2),
n AS (SELECT a, arg_min(b, d) AS b FROM d GROUP BY 1),
l AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
r AS (SELECT a AS z, a AS y FROM l UNION SELECT r.z, l.b FROM r JOIN l ON l.a = r.y)
SELECT z, min(y) AS first FROM r GROUP BY 1
""")
def nearest_superclusters(spark, sf):
    """Groups of classes linked by their nearest neighbour, by divergence of their diagonal Gaussians; each by its first class."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart
    from ..mixture.sampler import Cluster, superclusters

    prior = NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM))
    rows = sorted(_diagonal_model(spark, sf).collect(), key=lambda r: r.component)  # one for each class
    clusters = [Cluster([np.zeros(prior.size)] * 2, (np.array(r.mean), np.diag(r.var))) for r in rows]
    groups, first = superclusters(clusters, prior, None), {}
    for r, g in zip(rows, groups, strict=True):
        first.setdefault(g, r.component)
    return spark.createDataFrame([(r.component, first[g]) for r, g in zip(rows, groups, strict=True)], "z int, first int")


@query()
def finite_mixture_fit(spark, sf):
    """The finite approximation with twelve components."""
    from ..mixture.priors import NormalInverseWishart
    from ..mixture.sampler import fit

    points = _points(spark, sf).select("pid", "x")
    mean, cov = mix.global_moments(points)
    return fit(points, NormalInverseWishart(mean, cov), steps=SWEEPS, k=12, kind="finite").trace_table().select("iter", "loglik", "k", "nk")


def _term_docs(spark, sf):
    """Suppliers as documents: quantities by part size (sparse counts over 51 terms)."""
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_size").agg(F.sum("l_quantity").cast("int").alias("n"))
    return rows.groupBy(F.col("l_suppkey").cast("long").alias("pid")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p_size", "n")))).alias("x"))


@query()
def multinomial_fit(spark, sf):
    """The sub-cluster sampler on sparse counts, with superclusters."""
    from ..mixture.priors import DirichletMultinomial
    from ..mixture.sampler import fit

    return fit(_term_docs(spark, sf), DirichletMultinomial(51), steps=SWEEPS, k=5, grouped=True).trace_table().select("iter", "loglik", "k", "nk")


@query()
def word_mixture_fit(spark, sf):
    """The finite approximation over the words of all documents, as sparse counts over their whole vocabulary."""
    from ..mixture.terms import TermChain
    from ..session import saved

    words = _t(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("word"))
    counts = saved(words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).cast("int").alias("n")))
    terms = saved(frames.numbered_rows(counts.select("word").distinct(), ["word"], "term"))
    rows = counts.join(terms, "word").groupBy(F.col("doc_id").alias("pid")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("term").cast("int"), "n")))).alias("x"))
    return TermChain(rows, terms.count(), 0.1, k=4).run(WORD_SWEEPS).trace_table().select("iter", "loglik", "k", "nk")


@query()
def collapsed_gibbs(spark, sf):
    """Two chains of collapsed Gibbs with merge-split moves, each over its half of the vectors."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart
    from ..mixture.sequential import collapsed

    points = _points(spark, sf).select("pid", "x", F.col("z").cast("int").alias("z"), (F.col("pid") % 2).alias("chain"))
    return collapsed(points, NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM)), sweeps=1)


@query()
def supercluster_gibbs(spark, sf):
    """One sweep of Gibbs within superclusters of the classes."""
    import numpy as np

    from ..mixture.priors import NormalInverseWishart
    from ..mixture.sequential import supercluster_sweep

    return supercluster_sweep(_points(spark, sf), NormalInverseWishart(np.zeros(_DIM), np.eye(_DIM)), groups=4).select("pid", "z")


@query()
def matching_corpora(spark, sf):
    """Customers' orders as utterances, matched with suppliers' line items and trimmed to them."""
    big = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("utt"), F.col("o_custkey").cast("string").alias("spk"), F.col("o_orderstatus").alias("rec"), F.col("o_orderdate").alias("start"), F.col("o_totalprice").alias("duration"))
    small = _t(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("utt"), F.col("l_suppkey").cast("string").alias("spk"), F.col("l_returnflag").alias("rec"), F.col("l_shipdate").alias("start"), (F.col("l_extendedprice") / 100).alias("duration"))
    with_gender = lambda u: corpus.speaker_amount(u).withColumn("gender", F.when(F.col("spk").cast("int") % 2 == 0, "f").otherwise("m"))
    matches = corpus.match_speakers(with_gender(big), with_gender(small))
    a, b = corpus.matching_corpora(big, small, matches)
    return a.select(F.lit("big").alias("corpus"), "spk", "utt").unionByName(b.select(F.lit("small").alias("corpus"), "spk", "utt"))


@query("""
WITH u AS (SELECT user_id AS rec, event_type AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
p AS (SELECT rec, frame // 10 AS id, CAST(frame // 10 % 3 AS INTEGER) AS type, min(frame) AS lo FROM u GROUP BY rec, frame // 10),
a AS (SELECT p.rec, p.id, p.type, u.frame, u.unit, lag(u.unit) OVER (PARTITION BY p.rec, p.id ORDER BY u.frame) AS before FROM p JOIN u ON u.rec = p.rec AND u.frame BETWEEN p.lo + 2 AND p.lo + 6),
r AS (SELECT rec, id, type, string_agg(CASE WHEN before IS NULL OR before <> unit THEN unit END, ',' ORDER BY frame) AS rep FROM a GROUP BY 1, 2, 3)
SELECT type, count(*) AS n_items, count(DISTINCT rep) AS nunique FROM r GROUP BY 1
""")
def phone_representations(spark, sf):
    """Sequences of units around the middles of runs of ten frames, as phones of three types."""
    units = _units(spark, sf).withColumn("t", F.col("frame").cast("double"))
    phones = units.groupBy(F.col("item").alias("rec"), F.floor(F.col("frame") / 10).alias("k")).agg((F.min("frame") + 4.0).alias("centre"))
    phones = phones.select(F.concat_ws("-", "rec", "k").alias("id"), (F.col("k") % 3).cast("int").alias("type"), "rec", "centre")
    return abx.phone_representations(units, phones, half=2.0)


_DRAWN = """
WITH u AS (SELECT user_id AS rec, event_type AS unit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
p AS (SELECT rec, frame // 10 AS k, CAST(frame // 10 % 3 AS INTEGER) AS type, min(frame) AS lo FROM u GROUP BY rec, frame // 10),
x AS (SELECT *, rec || '-' || k AS id FROM p WHERE NOT (type = 2 AND rec % 5 = 0)),
s AS (SELECT x.*, seed, (k * 7 + rec * 3 + seed * 13) % 11 AS draw FROM x, (SELECT unnest([0, 1, 2]) AS seed)),
{cell},
w AS (SELECT d.id, u.frame, u.unit, abs(u.frame - d.lo - 4) <= 1 AS sure FROM (SELECT DISTINCT id, rec, lo FROM d) d JOIN u ON u.rec = d.rec AND u.frame BETWEEN d.lo + 2 AND d.lo + 6),
a AS (SELECT *, lag(unit) OVER (PARTITION BY id ORDER BY frame) AS before, lag(unit) OVER (PARTITION BY id, sure ORDER BY frame) AS sure_before FROM w),
r AS (SELECT id, coalesce(string_agg(CASE WHEN sure AND (sure_before IS NULL OR sure_before <> unit) THEN unit END, ',' ORDER BY frame), '') AS sure, string_agg(CASE WHEN before IS NULL OR before <> unit THEN unit END, ',' ORDER BY frame) AS most FROM a GROUP BY id),
c AS (SELECT type, {spk} AS spk, seed, count(*) AS n_items, count(DISTINCT sure) AS a, count(DISTINCT most) AS b FROM d JOIN r USING (id) GROUP BY 1, 2, 3)
SELECT type, spk, CAST(seed AS INTEGER) AS seed, n_items, 'lower bound' AS count_type, least(a, b) AS nunique FROM c UNION ALL SELECT type, spk, CAST(seed AS INTEGER), n_items, 'upper bound', greatest(a, b) FROM c
"""
_WITHIN = "n AS (SELECT *, count(*) OVER (PARTITION BY type, rec, seed) AS size, row_number() OVER (PARTITION BY type, rec, seed ORDER BY draw, id) AS rank FROM s), d AS (SELECT * FROM n WHERE size >= 2 AND rank <= 2)"
_ACROSS = "t AS (SELECT *, row_number() OVER (PARTITION BY type, rec, seed ORDER BY draw, id) AS turn FROM s), n AS (SELECT *, count(*) OVER (PARTITION BY type, seed) AS size, row_number() OVER (PARTITION BY type, seed ORDER BY turn, draw, id) AS rank FROM t), d AS (SELECT * FROM n WHERE rank <= (SELECT min(size) FROM n))"


def _counted(spark, sf, **sampling):
    """Counts of unit sequences around the middles of runs of ten frames, as phones of three types; one type is left out for every fifth speaker."""
    units = _units(spark, sf).withColumn("t", F.col("frame").cast("double"))
    phones = units.groupBy(F.col("item").alias("spk"), F.floor(F.col("frame") / 10).alias("k")).agg((F.min("frame") + 4.0).alias("centre"))
    phones = phones.select(F.concat_ws("-", "spk", "k").alias("id"), (F.col("k") % 3).cast("int").alias("type"), "spk", F.col("spk").alias("rec"), "centre", "k")
    without = phones.where("spk % 5 = 0").select("spk", F.lit(2).alias("type")).distinct()
    order = (F.col("k") * 7 + F.col("spk") * 3 + F.col("seed") * 13) % 11
    return abx.representation_counts(units, phones, half=2.0, doubt=0.5, seeds=(0, 1, 2), exclude=without, order=order, **sampling)


@query(_DRAWN.format(cell=_WITHIN, spk="rec"))
def representations_within_speakers(spark, sf):
    """Two phones of each type and speaker."""
    return _counted(spark, sf, n=2)


@query(_DRAWN.format(cell=_ACROSS, spk="CAST(NULL AS BIGINT)"))
def representations_across_speakers(spark, sf):
    """As many phones of each type as the least has, the speakers in turn."""
    return _counted(spark, sf, by_spk=False)


_KINDS = "(VALUES ('L-R', 0, 1), ('W-Y', 2, 3), ('all_C', NULL, NULL)) k(kind, p, q)"


@query(f"""
WITH {_ITEMS}, {_TASK},
d AS (SELECT *, round(list_distance(xa.x, xx.x), 6) AS da, round(list_distance(xb.x, xx.x), 6) AS db FROM task t JOIN items xa ON xa.id = t.a JOIN items xb ON xb.id = t.b JOIN items xx ON xx.id = t.x),
e AS (SELECT speaker, on_a, on_b, avg(CASE WHEN da < db THEN 0.0 WHEN da > db THEN 1.0 ELSE 0.5 END) AS error FROM (SELECT t.speaker, t.on_a, t.on_b, da, db FROM d t) GROUP BY 1, 2, 3),
m AS (SELECT speaker, least(on_a, on_b) AS a, greatest(on_a, on_b) AS b, avg(error) AS error FROM e GROUP BY 1, 2, 3)
SELECT speaker, kind, count(*) AS n, round(avg(error), 6) AS error FROM m JOIN {_KINDS} ON CASE WHEN kind = 'all_C' THEN a < 8 AND b < 8 ELSE a = p AND b = q END GROUP BY 1, 2
""")
def contrast_kinds(spark, sf):
    """Errors of each speaker by kind of contrast: two single contrasts, and all between consonants (phones 0 to 7)."""
    scores = abx.cell_scores(_items(spark, sf), "euc", "phone", ["speaker"], digits=6)
    return abx.errors_by_kind(scores, ["speaker"], {"L-R": (0, 1), "W-Y": (2, 3)}, {"all_C": list(range(8))}).withColumn("error", _r("error"))


# Files -------------------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A new folder in the one that driver and executors share."""
    import uuid

    return f"{shared_dir(spark)}/tessitura-files-{uuid.uuid4().hex}"


def _lines(df, path: str, *columns) -> None:
    df.select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


@query("""
SELECT 'u' || event_id AS utt, 's' || user_id AS spk, event_type AS rec, round(CAST(event_id % 100 AS DOUBLE), 6) AS start, round(value, 6) AS duration, 1 + event_id % 3 AS n_words, CAST(length(event_type) * (1 + event_id % 3) AS BIGINT) AS n_phones FROM events
""")
def corpus_from_files(spark, sf):
    """events as a corpus of text files (segments, speakers, texts, lexicon), loaded and validated again."""
    at, e = _folder(spark), _t(spark, sf, "events").withColumns({"utt": F.concat(F.lit("u"), "event_id"), "start": (F.col("event_id") % 100).cast("double")})
    _lines(e, f"{at}/segments.txt", "utt", F.concat("event_type", F.lit(".wav")), F.col("start").cast("string"), (F.col("start") + F.col("value")).cast("string"))
    _lines(e, f"{at}/utt2spk.txt", "utt", F.concat(F.lit("s"), "user_id"))
    _lines(e, f"{at}/text.txt", "utt", F.array_join(F.array_repeat("event_type", (F.col("event_id") % 3 + 1).cast("int")), " "))
    _lines(e.select("event_type").distinct(), f"{at}/lexicon.txt", "event_type", F.array_join(F.split("event_type", "(?<=.)(?=.)"), " "))
    loaded = Corpus.load(spark, at, "events")
    phones = loaded.lexicon.select(F.col("word"), F.size("phones").alias("n"))
    words = loaded.text.select("utt", F.explode("words").alias("word")).join(phones, "word").groupBy("utt").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n_phones"))
    return loaded.durations().join(words, "utt").select("utt", "spk", "rec", _r("start").alias("start"), _r("duration").alias("duration"), "n_words", "n_phones")


@query("SELECT 'v' || vec_id AS item, CAST(f - 1 AS INTEGER) AS frame, round(CAST(0.0125 AS DOUBLE) + 0.01 * (f - 1), 6) AS t, CAST(g AS INTEGER) AS dim, round(CAST(embedding[(f - 1) * 8 + g] AS DOUBLE), 5) AS x FROM embeddings, (SELECT unnest(range(1, 9)) AS f), (SELECT unnest(range(1, 9)) AS g)")
def archive_frames(spark, sf):
    """embeddings as a text feature archive of eight frames an item, read again."""
    at = _folder(spark)
    row = lambda k: F.array_join(F.transform(F.slice("embedding", k * 8 + 1, F.lit(8)), lambda v: v.cast("double").cast("string")), " ")
    rows = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), row), "\n  ")
    _t(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id", F.lit("  [\n  "), rows, F.lit(" ]")).alias("value")).write.text(at)
    found = readers.read_archive(spark, at).select("item", "frame", _r("t").alias("t"), F.posexplode("x").alias("dim", "x"))
    return found.select("item", "frame", "t", (F.col("dim") + 1).alias("dim"), _r("x", 5).alias("x"))


@query("SELECT 'u' || user_id AS utt, event_type AS phone, CASE WHEN event_id % 2 = 0 THEN 'w' || event_id % 7 END AS word, round(value, 6) AS duration, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def alignment_from_file(spark, sf):
    """events as an alignment of phones, some with a word, read again; n: phones of the utterance, of those that the file has."""
    at, e = _folder(spark), _t(spark, sf, "events")
    _lines(e, at, F.concat(F.lit("u"), "user_id"), F.lit("0.0"), F.col("value").cast("string"), F.lit("1.0"), "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("w"), F.col("event_id") % 7)))
    rows = readers.read_alignment(spark, at)
    sizes = rows.join(readers.read_utterance_ids(spark, at), "utt", "left_semi").groupBy("utt").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "utt").select("utt", "phone", "word", _r(C.duration()).alias("duration"), "n")


@query("SELECT c_mktsegment AS grp, a.c_custkey AS spk, arg_min(b.s_suppkey, (abs(a.c_acctbal - b.s_acctbal), b.s_suppkey)) AS near FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey GROUP BY 1, 2")
def nearest_supplier(spark, sf):
    """For each customer the supplier of its nation with the nearest balance, the first if equal."""
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("on"), F.col("c_custkey").alias("spk"), F.col("c_acctbal").alias("v"))
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("on"), F.col("s_suppkey").alias("spk"), F.col("s_acctbal").alias("v"))
    grp = _t(spark, sf, "customer").select(F.col("c_custkey").alias("spk"), F.col("c_mktsegment").alias("grp"))
    return corpus.nearest(c, s, "on", "v", "spk").join(grp, "spk").select("grp", "spk", "near")
