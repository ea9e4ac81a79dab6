"""Token counts by a whole-token shortcut (numbered operator 11).

A byte-level BPE tokenizer cuts a text to pre-tokens by a pattern and merges the bytes of each pre-token by itself. So a pre-token
that is one token when merged alone is one token wherever it stands. `whole_tokens` proves offline, by merging every string of the
vocabulary, for which this holds; counting then looks pre-tokens up among these and merges only the others.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

# Fixed value: the pattern of byte-level BPE pre-tokens.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens that a worker remembers; beyond that it starts anew. Longer ones than LONG are merged each time.
MOST, LONG = 500_000, 256
#: Texts over so many characters are scanned piece by piece, so their pieces are never all held.
SCAN = 1 << 20


def byte_letters() -> dict[int, str]:
    """Byte to letter of the vocabulary's spelling: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SPELL = byte_letters()


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that merge to one token alone. The file must be of a byte-level BPE tokenizer without normaliser, whose
    added tokens match anywhere; a ValueError says so otherwise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
    back = {c: b for b, c in _SPELL.items()}
    merge, out = counter(path).merge, set()
    for spelt in model["vocab"]:
        try:
            text = bytes(map(back.__getitem__, spelt)).decode()
        except (KeyError, UnicodeDecodeError):  # an added token, or a part of a character: never a pre-token
            continue
        if merge(text) == 1:
            out.add(text)
    return frozenset(out)


class Counter(dict):
    """Pre-token to its number of tokens: proved ones are set at the start, others are merged when first met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.proved = Tokenizer.from_file(path), frozenset()
        self.model = self.tokenizer.model
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.trusted: dict[str, bool] = {}

    def start(self, proved: frozenset[str]) -> Counter:
        if len(self.proved) != len(proved):
            self.proved = proved
            self.clear()
        if len(self) > MOST:
            self.clear()
        if not self:
            self.update(dict.fromkeys(proved, 1))
        return self

    def merge(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(_SPELL)))

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        if len(piece) <= LONG:
            self[piece] = n
        return n

    def known(self, text: str) -> bool:
        """Whether all characters were assigned in Unicode 3.2. On these the pattern's classes agree with the tokenizer's, whose tables
        are older than those of the regex module."""
        for c in set(text):
            if c not in self.trusted:
                self.trusted[c] = unicodedata.ucd_3_2_0.category(c) != "Cn"
            if not self.trusted[c]:
                return False
        return True

    def count(self, text: str, latin: bool) -> int:
        """Tokens of a text; latin: it has no character from U+0240 on."""
        if not (latin or self.known(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts, special = [text], 0
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            special = len(parts) - 1
        for p in parts:
            found = PIECES.findall(p) if len(p) <= SCAN else (m.group() for m in PIECES.finditer(p))
            special += sum(map(self.__getitem__, found))
        return special


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each Python process, so that all its tasks share what was merged."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes long, n_tokens long, over_limit boolean (n_tokens > limit), one row per row of docs.

    `tokenizer` is the path of a byte-level BPE file, readable by driver and executors; counts are those of its library, without
    begin and end tokens. Null and empty texts have 0 bytes and tokens; repeated rows are counted each, null doc_ids kept, other
    columns ignored; an empty table gives no rows. No shuffle: each row is counted where it is read. What travels with the tasks is
    one string for each proved string of the vocabulary.
    """
    proved = whole_tokens(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for first, end, data, offsets in text_chunks(b.column(1)):
                high = np.concatenate([[0], np.cumsum(data >= 0xC9)])
                latin = high[offsets[1:]] == high[offsets[:-1]]
                raw = data.tobytes()
                own.start(proved)
                for k in range(end - first):
                    n[first + k] = own.count(raw[offsets[k] : offsets[k + 1]].decode(errors="replace"), latin[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
