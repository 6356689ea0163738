"""Token counts by the whole-token shortcut.

Offline, once per worker: every vocabulary string that is one pre-token and
that the merges turn into exactly one token is proved "whole". Counting then
splits a text into pre-tokens; a whole one counts 1 by a set lookup, and only
the others go through the merges (with a bounded memo).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as Tokenizer.encode(text, add_special_tokens=False) does, with no truncation or padding.

    Holds for a byte-level BPE without normaliser; others are refused.
    """

    def __init__(self, path: str):
        tok = Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError("the whole-token shortcut needs a byte-level BPE without normaliser or prefix space")
        self.model, self.letters = tok.model, byte_letters()
        self.find = regex.compile(PATTERN, regex.V0).findall
        added = [x for x in spec["added_tokens"]]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError("added tokens that strip or need word bounds are not handled")
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
        self.whole = self.prove(spec["model"]["vocab"])
        self.memo: dict[str, int] = {}

    def prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """Vocabulary strings that are valid text, one pre-token, and one token after all merges."""
        back = {c: b for b, c in self.letters.items()}
        whole = {}
        for word in vocab:
            try:
                text = bytes(back[c] for c in word).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.find(text) == [text] and len(self.model.tokenize(word)) == 1:
                whole[text] = 1
        return whole

    def merged(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = len(self.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))
            if len(piece) <= 64:
                self.memo[piece] = n
        return n

    def count(self, text: str) -> int:
        parts, n = [text], 0
        if self.special and "<" in text or self.special and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        whole, merged = self.whole, self.merged
        for part in parts:
            for piece in self.find(part):
                n += 1 if piece in whole else merged(piece)
        return n


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and tokens. Rows map one to one, so
    repeated rows give repeated results, nulls in doc_id stay, other columns
    are not read, and an empty table gives an empty result. No shuffle.
    path: the vocabulary file, installed on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in batches:
            n = [count(x) if x else 0 for x in b.column("text").to_pylist()]
            size = pc.binary_length(b.column("text").cast(pa.large_binary())).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
