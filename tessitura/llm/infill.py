"""Fill-in-middle examples: each text cut at two token boundaries, its pieces put in one of two orders behind sentinels.

A text is decoded to an array of UTF-32 code points. A token is a run of other characters with the spaces before it, or
the spaces at the text's end, so one begins at the text's start and wherever a space follows no space: comparing the
class of each code point with its neighbour's gives all boundaries at once. Two of them, by a hash of seed and id, are
the ends of prefix and middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import ship
from .common import beside, packed, table

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Texts of a batch that are cut before their outputs are handed on, in bytes.
SLICE = 8 << 20


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Places where tokens begin in an array of code points, and its end; only 0 for an empty one."""
    if not len(codes):
        return np.zeros(1, np.int64)
    space = (codes == 32) | (codes - np.uint32(9) < 5)  # unsigned: what is under 9 wraps around
    return np.concatenate([[0], np.flatnonzero(space[1:] & ~space[:-1]) + 1, [len(codes)]])


def example(text: str, digest: str, percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix's and middle's code points, output) of one text; digest: hexadecimal digits that decide."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(codes)
    n = len(at) - 1
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in sentinels) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (codes[:a], codes[a:b], codes[b:]))
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), percent: int = 50, spm_percent: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of keep with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output.

    `percent` of the texts are cut, `spm_percent` of those with the suffix first. Texts that are empty, null (as empty) or
    hold a sentinel stay plain, whatever their length; the numbers of characters are then null. Rows of one id make the
    same draws, so equal rows give equal results; a null id draws as the empty string. Every text is decoded whole, in 4
    bytes a character. No rows give no rows; names that keep has get an underscore before them.
    """
    ship(docs.sparkSession)
    rows = packed(docs, keep, text, _id=key).withColumn("_digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)).drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            for k in range(batch.num_rows):
                found = example(batch.column("_text")[k].as_py() or "", batch.column("_digest")[k].as_py(), percent, spm_percent, sentinels)
                held.append(found)
                size += len(found[-1])
                if size > SLICE or k == batch.num_rows - 1:
                    columns = [pa.array([h[i] for h in held], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column("_row").slice(first, len(held)), *columns], ["_row", *names])
                    held, size, first = [], 0, k + 1

    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [StructField(c, StringType() if c in ("form", "output") else LongType()) for c in names]
    return beside(rows.mapInArrow(run, StructType([rows.schema["_row"], *kinds])), *names)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from. No piece holds a sentinel, so the first of each is the one that was put in."""
    p, s, m = sentinels

    def between(left: str, right: str | None) -> Column:
        begin = F.instr(output, left) + len(left)
        return F.substr(output, begin, F.instr(output, right) - begin) if right else F.substr(output, begin)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_infill(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`fill_in_middle` with its defaults; the output is read back by :func:`restored`."""
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: DuckDB: the tokens by pattern, the pieces as joined slices of them.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
