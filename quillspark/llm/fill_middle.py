"""Fill-in-the-middle by overlapping chunks.

Where a text may be cut depends on two adjacent characters alone: a predicate says whether a unit (a
character, a word, a line) begins between them. A text is taken as chunks that overlap by one byte,
so that each chunk counts the units that begin in it without the others. Prefix sums over the chunks'
counts give the number of units and say which chunk holds either cut; only those are scanned again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, raw_text, slices, tune

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk, and of the run of chunks that is counted in one step.
CHUNK, STEP = 4096, 1 << 20

#: Whether a unit begins at a byte, from the byte before it and itself: at a byte that doesn't continue a character;
#: at a word that follows white space (a word takes what follows it along); after a line feed.
BEGINS = {
    "char": lambda left, right: (right & 0xC0) != 0x80,
    "word": lambda left, right: WS[left] & ~WS[right],
    "line": lambda left, right: left == 0x0A,
}


def begun(data: np.ndarray, a: int, b: int, heads: np.ndarray, unit: str) -> np.ndarray:
    """Flags of the bytes a..b-1 at which a unit begins; ``heads`` are the first bytes of texts, at
    which one always does. Reads one byte before a."""
    right = data[a:b]
    left = data[a - 1 : b - 1] if a else np.concatenate([np.zeros(1, np.uint8), right[:-1]])
    flags = BEGINS[unit](left, right)
    i, j = np.searchsorted(heads, [a, b])
    flags[heads[i:j] - a] = True
    return flags


def chunk_counts(data: np.ndarray, starts: np.ndarray, heads: np.ndarray, unit: str) -> np.ndarray:
    """Units that begin in each chunk; chunks are adjacent and begin at ``starts``."""
    ends, out, i = np.append(starts[1:], len(data)), [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, side="right")))
        flags = begun(data, int(starts[i]), int(ends[j - 1]), heads, unit)
        out.append(np.add.reduceat(flags, starts[i:j] - starts[i], dtype=np.int64))
        i = j
    return np.concatenate(out) if out else np.empty(0, np.int64)


class Cutter:
    """The units of the texts of ``data`` and where the cuts of given ranks lie."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, unit: str, chunk: int):
        self.data, self.offs, self.unit = data, offs, unit
        sizes = -(-np.diff(offs) // chunk)  # chunks of each text; none of an empty one
        first = np.concatenate([[0], np.cumsum(sizes)])
        nth = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
        self.starts = np.repeat(offs[:-1], sizes) + nth * chunk
        self.heads = offs[:-1][sizes > 0]
        self.sums = np.concatenate([[0], np.cumsum(chunk_counts(data, self.starts, self.heads, unit))])
        self.base = self.sums[first[:-1]]
        self.n = self.sums[first[1:]] - self.base

    def cut(self, row: int, rank: int) -> int:
        """The byte at which unit number ``rank`` of a text begins, its end if it has no more."""
        if rank >= self.n[row]:
            return int(self.offs[row + 1])
        at = int(self.base[row]) + rank
        k = int(np.searchsorted(self.sums, at, side="right")) - 1
        a, b = int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.data)
        return a + int(np.flatnonzero(begun(self.data, a, b, self.heads, self.unit))[at - self.sums[k]])


def checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels whose first character occurs nowhere else in them: none can then arise across the end of a part."""
    p, s, m = sentinels
    if len({p, s, m}) < 3 or not all((p, s, m)) or any(x[0] in y[1:] for x in (p, s, m) for y in (p, s, m)):
        raise ValueError("the first character of a sentinel may not occur inside of one")
    return p, s, m


def fill_in_middle(
    docs: DataFrame,
    unit: str = "char",
    seed: int = 1,
    transformed: int = 90,
    suffix_first: int = 20,
    sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row, where n is the number of units
    and ``output`` the text as ``form`` has it: plain, psm (prefix, suffix, middle) or spm (suffix first).

    Four numbers come from the SHA-256 of ``seed:id``: two cut ranks modulo n + 1, a percentage below
    ``transformed`` for a text to be changed, one below ``suffix_first`` for spm. The prefix ends after
    the smaller rank's units, the middle after the larger's. Empty and null texts, and texts that hold a
    sentinel, stay plain; their prefix_chars and middle_chars are null. Both ranks may be equal or at an
    end: parts may be empty. Null ids share the numbers of ``seed:null``; repeated ids those of
    their id; every input row gives one output row. Long texts are cut whole, in chunks of ``chunk`` bytes.
    Other columns are ignored whatever their names; an empty table gives an empty table."""
    tune(docs.sparkSession)
    tags = [x.encode() for x in checked(sentinels)]
    p, s, m = tags
    if unit not in BEGINS:
        raise ValueError(f"unknown unit {unit!r}")

    def run(batches):
        for b in batches:
            data, offs = raw_text(b.column(1))
            for i, j in slices(offs):
                part = offs[i : j + 1] - offs[i]
                own = data[offs[i] : offs[j]]
                cutter, forms, heads, middles, out = Cutter(own, part, unit, chunk), [], [], [], []
                for row, h in enumerate(b.column(2).slice(i, j - i).to_pylist()):
                    whole, n = own[part[row] : part[row + 1]].tobytes(), int(cutter.n[row])
                    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
                    if not n or h3 % 100 >= transformed or any(x in whole for x in tags):
                        forms.append("plain")
                        heads.append(None)
                        middles.append(None)
                        out.append(whole)
                        continue
                    x, y = (cutter.cut(row, r) - int(part[row]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = whole[:x], whole[x:y], whole[y:]
                    spm = h4 % 100 < suffix_first
                    forms.append("spm" if spm else "psm")
                    heads.append(len(prefix.decode()))
                    middles.append(len(middle.decode()))
                    out.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
                yield pa.record_batch(
                    [b.column(0).slice(i, j - i), pa.array(cutter.n, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    rows = docs.select(F.col(id_col), F.col(text_col), digest.alias("digest"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    p, s, m = checked(sentinels)

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring(output, F.locate(a, output) + len(a), F.length(output)), b, 1)

    last = F.substring(output, F.locate(m, output) + len(m), F.length(output))
    psm, spm = F.concat(between(p, s), last, between(s, m)), F.concat(between(p, m), last, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
