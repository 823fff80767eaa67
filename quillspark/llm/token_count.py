"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as a doubly linked list of single-byte symbols. A heap holds the adjacent
pairs that the vocabulary can merge, lowest rank first; popping one unlinks its right symbol and
pushes the two new neighbours. The piece's tokens are its initial symbols minus the merges made;
no token identifiers are produced.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tune

#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same splits for texts of Latin-1 characters without the two kinds in ODD, on which the two regex engines' classes
#: differ; alternatives that begin with different characters are put in order of frequency.
LATIN = r""" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"""
ODD = bytes([0x1C, 0x1D, 0x1E, 0x1F, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
#: Pieces of at most so many characters are remembered; longer ones are merged anew each time.
MEMO_CHARS = 48
#: Remembered pieces per worker; the memo is emptied when full, so its memory is bounded.
MEMO_SIZE = 800_000
#: Bits of a symbol id in the key of a pair.
SHIFT = 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Memo(dict):
    """Tokens of the pieces met so far."""

    def __init__(self, model: HeapBpe):
        super().__init__()
        self.model = model

    def __missing__(self, text: str) -> int:
        n = self.model.merge_count(list(text.encode("utf-8")))
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[text] = n
        return n


class HeapBpe:
    """Counts the tokens of a byte-level BPE file (the ``tokenizers`` JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = {c: i for i, c in enumerate(byte_alphabet())}
        self.ranks: dict[int, int] = {}  # left id * 2**SHIFT + right id: rank
        self.made: list[int] = []  # id of what the merge of a rank gives
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left] << SHIFT | ids[right]] = rank
            self.made.append(ids.setdefault(left + right, len(ids)))
        self.specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.split = regex.compile(PATTERN)
        self.latin = re.compile(LATIN)
        self.memo = Memo(self)

    def merge_count(self, live: list[int]) -> int:
        """Tokens left of a list of symbols after all merges; the list is used up."""
        n, get, made = len(live), self.ranks.get, self.made
        heap = [r << 32 | i for i, (a, b) in enumerate(pairwise(live)) if (r := get(a << SHIFT | b)) is not None]
        heapq.heapify(heap)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = right[i]
            if live[i] < 0 or j >= n or get(live[i] << SHIFT | live[j]) != rank:
                continue  # the pair that stood here was changed by an earlier merge
            new = live[i] = made[rank]
            live[j] = -1
            merges += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := get(new << SHIFT | live[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = left[i]
            if h >= 0 and (r := get(live[h] << SHIFT | new)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def pieces(self, text: str) -> list[str]:
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return (self.latin if len(plain.translate(None, ODD)) == len(plain) else self.split).findall(text)

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special token's string counts as one token, as the library has it."""
        if not text:
            return 0
        parts, extra = [text], 0
        for special in self.specials:
            if special in text:
                parts = [x for p in parts for x in p.split(special)]
                extra = len(parts) - 1
        total = extra
        for part in parts:
            total += sum(map(self.memo.__getitem__, self.pieces(part)))
        return total


@lru_cache(2)
def _model(path: str) -> HeapBpe:
    return HeapBpe(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens; null or repeated ids are carried through, one
    output row per input row; other columns are ignored whatever their names; an empty table gives
    an empty table. Texts of any length are counted whole, in one linear pass with a heap per
    piece. ``vocabulary`` is a path that every executor can read (an installed package's file)."""
    tune(docs.sparkSession)

    def run(batches):
        model = _model(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [model.count(t) for t in texts]
            yield pa.record_batch(
                [b.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
