"""Column expressions: derived values, recodes, predicates, text keys, vector arithmetic. All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Corpus code -> (language, register), and hours of training speech.
CORPORA = {"WSJ": ("American English", "Read"), "GPJ": ("Japanese", "Read"), "BUC": ("American English", "Spontaneous"), "CSJ": ("Japanese", "Spontaneous")}
SILENCES = ("NSN", "SPN", "SIL")


def duration(start: str = "start", stop: str = "stop") -> Column:
    return F.col(stop) - F.col(start)


def relative_difference(big: Column, small: Column) -> Column:
    """Difference over the mean: 2 (b - s) / (b + s)."""
    return 2 * (big - small) / (big + small)


#: What stands in a set's place where there is none.
NO_SET = ("None", "NA")


def no_set(name: Column) -> Column:
    return name.isNull() | name.isin(*NO_SET)


def train_test_match(train_lang: Column, test_lang: Column, train_reg: Column, test_reg: Column, train_set: Column, test_set: Column) -> Column:
    """NA without a training or a test set, else the first that holds: same corpus, or how language (L) and register (R) match."""
    same_l, same_r = train_lang == test_lang, train_reg == test_reg
    return (
        F.when(no_set(train_set) | no_set(test_set), "NA").when(train_set == test_set, "same C").when(same_l & ~same_r, "same L diff R").when(~same_l & same_r, "diff L same R").when(same_l & same_r, "same L same R").otherwise("diff L diff R")
    )


def tuning_condition(train_set: Column, train_lang: Column, native: str = "American English", labels: tuple[str, str] = ("Am. Eng. native", "Jap. native")) -> Column:
    """The label of models trained on `native` speech, that of all others, or no tuning for those without a training set."""
    return F.when(no_set(train_set), "No language tuning").when(train_lang == native, labels[0]).otherwise(labels[1])


def model_condition(train: Column, model: Column, amount: str = "") -> Column:
    """`GMM (read)` or `GMM (spont.)` by the training corpus, with the amount after it if given; baselines by their kind."""
    read = [corpus for corpus, (_, register) in CORPORA.items() if register == "Read"]
    gmm = F.concat(F.when(train.isin(*read), "GMM (read)").otherwise("GMM (spont.)"), F.lit(f" {amount}" if amount else ""))
    return F.when(model == "GMM", gmm).when(model == "HMM-phone", "Phoneme recognizer baseline").otherwise("Phone-state baseline")


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """The mapped value; null where there is none."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), value)


def parse_model_name(name: Column) -> dict[str, Column]:
    """split_factor, subset and iteration of `<a>_<b>_subsetsN-M_iterI[-final]`; other numbers of tokens are errors."""
    t = F.split(name, "_")
    ok = F.when(F.size(t) == 4, t).otherwise(F.raise_error(F.concat(F.lit("not a model name: "), name)).cast("array<string>"))
    counts = F.split(F.substring(ok[2], len("subsets") + 1, 1000), "-")
    return {"split_factor": counts[0].cast("int"), "subset": counts[1].cast("int"), "iteration": F.regexp_replace(F.substring(ok[3], len("iter") + 1, 1000), "-final$", "").cast("int")}


def subcorpus_group(e: Column) -> Column:
    return F.when(e > 100, F.floor(e / 100) + 1).when(e > 10, F.floor(e / 10) + 1).otherwise(e).cast("long")


def amount(corpus: Column, hours: dict[str, float], factor: Column) -> Column:
    """Training amount: the corpus's hours over the split factor."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in hours.items() for x in kv]), corpus) / factor


def scaled(d: Column, scale: Column) -> Column:
    return d * scale


def bits(nats: Column) -> Column:
    return nats / F.log(F.lit(2.0))


def native_advantage(test: Column, first: str, error_first_trained: Column, error_other_trained: Column) -> Column:
    """Error of the models trained elsewhere less that of the native ones, for each test condition."""
    return F.when(test == first, error_other_trained - error_first_trained).otherwise(error_first_trained - error_other_trained)


def milliseconds(seconds: Column) -> Column:
    return 1000 * seconds


def frames_of(seconds: Column, rate: int = 100) -> Column:
    return seconds * rate


def first_part(s: Column, sep: str = "_") -> Column:
    return F.split_part(s, F.lit(sep), F.lit(1))


def last_part(s: Column, sep: str = "_") -> Column:
    return F.element_at(F.split(s, sep), -1)


def with_language_register(df: DataFrame, corpus: str, prefix: str) -> DataFrame:
    """df with <prefix>_language and <prefix>_register of its corpus code, from the four-row table above."""
    table = df.sparkSession.createDataFrame([(c, lang, reg) for c, (lang, reg) in CORPORA.items()], f"`{corpus}` string, {prefix}_language string, {prefix}_register string")
    return df.join(F.broadcast(table), corpus, "left")  # four rows


def speaker_or_placeholder(spk: Column, by_spk: Column) -> Column:
    return F.when(by_spk, spk).otherwise("None")


def not_silence(contrast: Column, silences: tuple[str, ...] = SILENCES) -> Column:
    """Neither part of `p1-p2` is a silence."""
    parts = F.split(contrast, "-")
    return ~parts[0].isin(*silences) & ~parts[1].isin(*silences)


def name_contains(name: Column, any_of: tuple[str, ...] = (), all_of: tuple[str, ...] = ()) -> Column:
    out = F.lit(True)
    for part in all_of:
        out = out & name.contains(part)
    if any_of:
        some = F.lit(False)
        for part in any_of:
            some = some | name.contains(part)
        out = out & some
    return out


def between(t: Column, start: Column, stop: Column, inclusive: str = "both") -> Column:
    """start <= t <= stop with the named ends closed: both, left, right or neither."""
    low = t >= start if inclusive in ("both", "left") else t > start
    high = t <= stop if inclusive in ("both", "right") else t < stop
    return low & high


def without_speaker_prefix(utt: Column) -> Column:
    """What stands after the first underscore; an error if nothing does."""
    rest = F.substr(utt, F.instr(utt, "_") + 1)
    return F.when((F.instr(utt, "_") > 0) & (F.length(rest) > 0), rest).otherwise(F.raise_error(F.concat(F.lit("no speaker prefix: "), utt)).cast("string"))


def result_name_parts(name: Column) -> dict[str, Column]:
    """Parts of `<model>FEAT__<...>DIS` names: what stands before FEAT__ and between it and DIS (greedy)."""
    pattern = "(.*)FEAT__(.*)DIS"
    return {"feat": F.regexp_extract(name, pattern, 1), "dis": F.regexp_extract(name, pattern, 2)}


def ends_in_digit(s: Column) -> Column:
    return s.rlike("[0-9]$")


# Vectors (array<double>) ---------------------------------------------------------------------------------------------


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def angular(a: Column, b: Column) -> Column:
    """Angle over pi, 0 to 1."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))) / F.pi()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once for each row, not for each element of an array that is made with it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(a: Column) -> Column:
    return once(a, lambda v: once(total(v), lambda s: F.transform(v, lambda x: x / s)))


def log_sum_exp(a: Column) -> Column:
    m = F.array_max(a)
    return m + F.log(total(F.transform(a, lambda x: F.exp(x - m))))


def softmax(a: Column) -> Column:
    return once(a, lambda v: once(F.array_max(v), lambda m: normalised(F.transform(v, lambda x: F.exp(x - m)))))


def log_gamma(x: Column) -> Column:
    """Log of the gamma function of positive numbers, for sums over few rows: it runs in Python."""
    return _log_gamma()(x)


def _log_gamma():
    @F.pandas_udf("double")
    def one(x: pd.Series) -> pd.Series:
        return x.map(math.lgamma, na_action="ignore").astype(float)

    return one


def kl(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of positive vectors that sum to 1; terms with p = 0 are 0."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)))


def symmetric_kl(p: Column, q: Column) -> Column:
    """Both directions: the sum of (p - q)(log p - log q)."""
    return total(F.zip_with(p, q, lambda x, y: (x - y) * (F.log(x) - F.log(y))))


def duration_distance(x: Column, y: Column) -> Column:
    """Difference in the number of frames."""
    return F.abs(F.size(x) - F.size(y))
