"""Byte-pair encoding in linear time, as a backtracking encoder over longest matches.

A piece of text is covered from the left with the longest vocabulary entry that starts there, found for all
positions in one pass of an Aho-Corasick automaton.  Two adjacent tokens are compatible if merging by rank
would itself have left that boundary; this is decided from the split table and remembered in a pair table.
Where the longest entry is not compatible with the token before it, the next shorter entry that starts there is
tried, and where none is, the last token is taken back.  Places that led nowhere are marked, so each is tried
once.  The result equals merging pairs in order of rank.

Decoding looks up every id's bytes in one offset table.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Split of text into pieces of the byte-level vocabularies; merges never cross pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The vocabulary of a rank file: one line ``base64-token rank`` each, or of a tokenizer's JSON."""
    if data.lstrip()[:1] == b"{":
        return _ranks_of_json(json.loads(data))
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _ranks_of_json(spec: dict) -> dict[bytes, int]:
    """Byte-level JSON writes each byte as a printable character: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


class Encoder:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for t, r in ranks.items():
            self.tokens[r] = t
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        # ranks in order of merging: single bytes first, then by id
        self.order = [0] * n
        for i, r in enumerate(sorted(ranks.values(), key=lambda r: (len(self.tokens[r]) > 1, r))):
            self.order[r] = i
        self.left, self.right = list(range(n)), list(range(n))
        self.pairs: dict[tuple[int, int], int] = {}
        for r in sorted(ranks.values(), key=self.order.__getitem__):
            if len(self.tokens[r]) > 1:
                self._split(r)
        # the automaton works on text; latin-1 gives each byte one character
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        # the longest entry that is a proper prefix of another
        self.prefix = [-1] * n
        for t, r in ranks.items():
            for k in range(len(t) - 1, 0, -1):
                if (p := ranks.get(t[:k])) is not None:
                    self.prefix[r] = p
                    break
        self.compatible: dict[tuple[int, int], bool] = {}
        ends = np.cumsum([0, *map(len, self.tokens)])
        self.offsets, self.bytes = ends.astype(np.int64), np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, list[int]] = {}

    def _split(self, r: int) -> None:
        """Record the last merge that makes token ``r``, by merging its bytes with the earlier entries."""
        parts = [self.byte[b] for b in self.tokens[r]]
        while len(parts) > 2:
            rank, i = min(((self.order[x], i) for i in range(len(parts) - 1) if (x := self.pairs.get((parts[i], parts[i + 1]))) is not None), default=(None, -1))
            if rank is None:
                break
            parts[i : i + 2] = [self.pairs[parts[i], parts[i + 1]]]
        if len(parts) == 2:
            self.left[r], self.right[r] = parts
            self.pairs[parts[0], parts[1]] = r

    def pair_is_compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps the boundary between tokens a and b when both are whole."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= 5 * CACHE_PIECES:
                self.compatible.clear()
            known = self.compatible[a, b] = self._decide(a, b)
        return known

    def _decide(self, a: int, b: int) -> bool:
        """Undo merges on either side of the boundary, latest first; a merge across it before that breaks it."""
        order, limit = self.order, len(self.order) + 1
        while True:
            m = self.pairs.get((a, b))
            if m is not None and order[m] < limit:
                return False
            # the side made later is taken apart first
            if order[a] > order[b]:
                limit, inner = order[a], self.right[a]
                if inner == a:
                    return True
                a = inner
            else:
                # on equal ranks the left pair merges first, so the right one counts as later
                limit, inner = order[b] + 1, self.left[b]
                if inner == b:
                    if self.right[a] == a:
                        return True
                    limit, a = order[a], self.right[a]
                else:
                    b = inner

    def _piece(self, text: str) -> list[int]:
        raw = text.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [self.byte[b] for b in raw]
        length = [1] * n
        for end, r in self.automaton.iter(raw.decode("latin-1")):
            k = len(self.tokens[r])
            if k > length[end - k + 1]:
                longest[end - k + 1], length[end - k + 1] = r, k
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (not out or self.pair_is_compatible(out[-1], token)):
                    break
                token = self.prefix[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= len(self.tokens[last])
                token = self.prefix[last]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text without special tokens; an empty or null text gives the empty list."""
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for p in self.pattern.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= 64:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[p] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        first = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.bytes[first + np.arange(len(first))].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(data: bytes) -> Encoder:
    """One encoder a worker process for a vocabulary."""
    return Encoder(read_ranks(data))


def vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file, read on the driver; about a megabyte, it travels to the workers with the task."""
    with open(path, "rb") as f:
        return f.read()


def _slices(batches, rows: int = 1_000):
    """The batches in slices of few texts, so that neither their lists nor their ids grow large."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _encode_batches(data):
    def run(batches):
        e = encoder(data.value)
        for b in _slices(batches):
            ids = [e.encode(t) for t in b["_text"].to_pylist()]
            flat = np.concatenate([np.asarray(i, np.int32) for i in ids])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["_id", "_ids"])

    return run


def _count_batches(data):
    def run(batches):
        e = encoder(data.value)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array([len(e.encode(t)) for t in b["_text"].to_pylist()], pa.int64())], ["_id", "_n"])

    return run


def _apply(texts: DataFrame, id_: str, text: str, path: str, run, out: str) -> DataFrame:
    spark = texts.sparkSession
    data = spark.sparkContext.broadcast(vocabulary(path))
    t = texts.select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    kind = dict(t.dtypes)["_id"]
    return t.mapInArrow(run(data), f"_id {kind}, {out}")


def encode(texts: DataFrame, *, id_: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_`` and ``ids``, the list of token ids of each row's whole text, without special tokens.

    Every row gives one row, in the order of the input, also rows with a null or repeated id.  Empty and null
    texts give the empty list.  Strings that look like special tokens are ordinary text.  Other columns are
    ignored.
    """
    return _apply(texts, id_, text, path, _encode_batches, "_ids array<int>").select(F.col("_id").alias(id_), F.col("_ids").alias("ids"))


def count_tokens(texts: DataFrame, *, id_: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_`` and ``n_tokens`` of each row's whole text; 0 for empty and null texts."""
    return _apply(texts, id_, text, path, _count_batches, "_n bigint").select(F.col("_id").alias(id_), F.col("_n").alias("n_tokens"))


def decode(encoded: DataFrame, *, id_: str = "doc_id", ids: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``id_`` and ``text``: the inverse of ``encode``; a null list gives null."""
    data = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        e = encoder(data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array([None if i is None else e.decode(i) for i in b["_ids"].to_pylist()], pa.string())], ["_id", "_text"])

    t = encoded.select(F.col(id_).alias("_id"), F.col(ids).alias("_ids"))
    return t.mapInArrow(run, f"_id {dict(t.dtypes)['_id']}, _text string").select(F.col("_id").alias(id_), F.col("_text").alias("text"))
