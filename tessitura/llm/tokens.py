"""Exact token counts of a byte-level BPE, with huge documents in overlapping chunks.

Two paths, both counted by the tokenizer itself:

* Texts over `huge` bytes are encoded in chunks of `chunk` characters that overlap, with offsets. The splice is the
  first place in the overlap of two chunks that is proven stable, if the tokens of both encodings from there to the last
  such place agree. Where there are not two such places or the tokens differ, the overlap is doubled, up to a longer left
  chunk.
* Ordinary texts are cut at all their stable places and the distinct pieces are encoded, each once; the counts are kept
  by the pieces' bytes, MEMO pieces at most.

A place is stable if a token must begin there whatever surrounds it. With the GPT-2 pre-tokenisation, no token holds both
a non-space character and a space after it (a space is only ever first in a token of letters, digits or marks, or in a
run of spaces), the pieces left of such a place match the same at the text's end as before a space, and what is right of
it is matched from there on. Added tokens hold no space.

Other tokenizer files than byte-level ones with this pre-tokenisation encode whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..session import ship
from .common import beside, packed, table
from .textkit import slices, utf8

#: Bytes over which a text goes in chunks, characters of a chunk and of the first overlap, pieces that are remembered.
HUGE, CHUNK, OVERLAP, MEMO = 1 << 13, 1 << 12, 128, 1 << 19

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that surely end a character that is no space: visible ASCII. Two-byte characters are judged by their lead.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xE0] = True  # 0xC2 leads two spaces


def stable_starts(raw: np.ndarray) -> np.ndarray:
    """Byte places at which a token begins whatever the context: an ASCII space after a character that is none."""
    n = len(raw)
    if n < 2:
        return np.zeros(0, np.int64)
    solid = _VISIBLE[raw[:-1]]
    solid[1:] |= _LEADS[raw[:-2]] & (raw[1:-1] >= 0x80)
    return np.flatnonzero(_SPACES[raw[1:]] & solid) + 1


class Counter:
    """Token counts by one tokenizer file; lives as long as the Python worker."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.above, self.chunk, self.memo = Tokenizer.from_file(path), huge, chunk, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(set(" \t\n\v\f\r") & set(t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j, part, at in slices(raw, offsets, 1 << 19):
            if not self.pieces:
                out[i:j] = self.encode([bytes(part[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)])
                continue
            small = np.diff(at) <= self.above
            if small.any():
                out[i:j] = self.ordinary(part, at, small)
            for k in np.flatnonzero(~small):
                out[i + k] = self.huge(bytes(part[at[k] : at[k + 1]]).decode(), self.chunk)
        return out

    def ordinary(self, raw: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Tokens of the rows that are marked, from the counts of their pieces; 0 for the others."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[stable_starts(raw)] = True
        cut[offsets] = True
        edge = np.flatnonzero(cut)
        row = np.searchsorted(offsets, edge[:-1], "right") - 1
        keep = rows[row]
        whole = raw.tobytes()
        pieces = [whole[a:b] for a, b in zip(edge[:-1][keep].tolist(), edge[1:][keep].tolist(), strict=True)]
        new = [p for p in set(pieces) if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(set(pieces))
        if new:
            self.memo.update(zip(new, self.encode([p.decode() for p in new]), strict=True))
        counts = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        return np.bincount(row[keep], counts, len(offsets) - 1).astype(np.int64)

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of text from overlapping chunks, spliced where both sides must agree."""
        n, total, begin, stop = len(text), 0, 0, min(chunk, len(text))
        left = self.offsets(text[:stop])
        skip = 0  # tokens of the left chunk that are before the last splice
        while stop < n:
            width = overlap
            while True:
                start = max(begin, stop - width)
                more_stop = min(n, start + max(chunk, 2 * width))
                right = self.offsets(text[start:more_stop])
                splice = self.splice(text, left, begin, right, start, stop)
                if splice:
                    break
                if start == begin:  # the overlap is the chunk: encode a longer chunk instead, from the same splice on
                    stop = min(n, begin + 2 * (stop - begin))
                    left = self.offsets(text[begin:stop])
                    if stop == n:
                        return total + len(left) - skip
                width *= 2
            total += splice[0] - skip
            left, skip, begin, stop = right, splice[1], start, more_stop
        return total + len(left) - skip

    def offsets(self, text: str):
        """The encoding, with the offsets of its tokens."""
        return self.tokenizer.encode(text, add_special_tokens=False)

    @staticmethod
    def splice(text: str, left, begin: int, right, start: int, stop: int) -> tuple[int, int] | None:
        """(tokens of the left chunk before a stable place, tokens of the right one before it), or None.

        Of the stable places those are taken at which a space stands after a visible ASCII character and before an ASCII
        letter: offsets of byte-level tokens leave the space out, so the place is found by the token of the letter, which
        is as many tokens after the place in one encoding as in the other.
        """
        places = [m.start() + 1 for m in _SPLICE.finditer(text, start, stop)]
        if len(places) < 2:
            return None
        first, last = places[0], places[-1]
        i, k = left.char_to_token(first + 1 - begin), right.char_to_token(first + 1 - start)
        li, lk = left.char_to_token(last + 1 - begin), right.char_to_token(last + 1 - start)
        if None in (i, k, li, lk) or left.ids[i:li] != right.ids[k:lk]:
            return None
        return i, k


_SPLICE = re.compile("[!-~] [A-Za-z]")
_counters: dict[tuple, Counter] = {}


def counter(path: str, huge: int = HUGE, chunk: int = CHUNK) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if (path, huge, chunk) not in _counters:
        _counters[path, huge, chunk] = Counter(path, huge, chunk)
    return _counters[path, huge, chunk]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep: tuple[str, ...] = ("doc_id",), huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """The columns of keep with n_bytes, n_tokens and over_limit (more than limit tokens). path: a tokenizer .json.

    Null and empty texts have no bytes and no tokens; each row is counted for itself, so repeated rows and null ids don't
    matter, and no rows give no rows. Texts over `huge` bytes go in chunks of `chunk` characters, with the same result.
    The three names get an underscore before them where keep has them. The file must be at path on every executor.
    """
    ship(docs.sparkSession)
    rows = packed(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessitura.llm.tokens import counter  # the worker's own, so that what it has learned stays

        counts = counter(path, huge, chunk)
        for batch in batches:
            raw, offsets = utf8(batch.column("_text"))
            tokens = counts.count(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["_row", "n_bytes", "n_tokens", "over_limit"])

    kinds = [StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())]
    return beside(rows.mapInArrow(run, StructType([rows.schema["_row"], *kinds])), "n_bytes", "n_tokens", "over_limit")


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    """One row for each document, by :func:`count_tokens` with its defaults."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
