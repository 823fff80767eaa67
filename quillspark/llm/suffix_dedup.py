"""Repeated-string removal by suffix sorting over a difference cover, one suffix bucket at a time.

Equal 50-byte strings hold the same least hash of a 16-byte substring, so the strings of a text fall
into runs that share this key: contexts, of 67 bytes and 18 strings on average. Hashes only place
contexts; bytes decide which strings are equal.

1. Contexts are dealt out by key into buckets, packed and compressed. Where one task holds very many
   contexts of a key, it sorts them first and sends only strings that it didn't find in a smaller
   document.
2. A bucket sorts the suffixes of contexts whose key stands in several documents. A sample over the
   difference cover {0, 1, 3} modulo 7 is ranked by doubling; then the suffixes are sorted one range of
   first bytes at a time, long ties by the sample's ranks. Neighbours with 50 equal bytes form runs, and
   whatever in a run isn't in its smallest document is a repeat.
3. A key with more different contexts than a task sorts at once leaves the bucket string by string;
   Spark's external sort brings equal strings together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fmix, materialize, prefix_hash, raw_text, slices, span_hash, tune

LENGTH, ANCHOR = 50, 16
PERIOD, COVER = 7, (0, 1, 3)
#: Contexts that a task holds before it writes them out.
FLUSH = 1 << 19
#: Contexts of one key in a task from which they are sorted before they are sent.
OFTEN = 32
#: Bytes of contexts in a bucket; the number of buckets follows from the data.
BUCKET_BYTES = 64 << 20
#: Bytes of contexts that a task keeps of one bucket, and that it keeps of one key.
BUCKET_MOST, KEY_MOST = 160 << 20, 4 << 20
#: Bytes of contexts sorted at once, and suffixes in one range of first bytes.
PIECE, SUFFIXES = 2 << 20, 1 << 18
#: Bytes of one text that are looked at together.
LONG = 8 << 20
#: Odd factors of the anchors' hash.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)
#: What stands for a null id: no id is larger.
NULL_ID = (1 << 63) - 1

#: For two residues, the first offset from 1 on that moves both into the cover.
_DELTA = [[next(d for d in range(1, PERIOD + 1) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]


# --------------------------------------------------------------------------- suffix sorting


def words8(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros follow the end."""
    pad = np.zeros(len(x) + 8, np.uint8)
    pad[: len(x)] = x
    view = np.lib.stride_tricks.as_strided(pad, (len(x), 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def dense(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(values)
    found = values[order]
    step = np.zeros(len(values), np.int64)
    np.cumsum(found[1:] != found[:-1], out=step[1:])
    out = np.empty(len(values), np.int64)
    out[order] = step
    return out


def cover_ranks(w8: np.ndarray) -> np.ndarray:
    """For each position of the difference cover its rank by 49 bytes (ties share a rank); -1 elsewhere
    and after the end."""
    n = len(w8)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.full(n + 2 * LENGTH, -1, np.int64)
    rank[at] = dense(w8[at] >> np.uint64(8))
    for step in (PERIOD, 2 * PERIOD, 3 * PERIOD):  # 14, 28 and 49 bytes
        rank[at] = dense(rank[at] * (n + 2) + rank[at + step] + 1)
    return rank


def sort_suffixes(x: np.ndarray, starts: np.ndarray, most: int | None = None):
    """The given suffixes in the order of their first ``LENGTH`` bytes, one range of first bytes at a
    time: (8-byte words, sorted starts) of each range. A range holds at most ``most`` suffixes or
    those that begin with the same two bytes."""
    w8, most = words8(x), most or SUFFIXES
    rank = cover_ranks(w8)
    first = (w8[starts] >> np.uint64(48)).astype(np.int64)
    upto = np.cumsum(np.bincount(first, minlength=1 << 16))
    low = 0
    while low < 1 << 16:
        done = int(upto[low - 1]) if low else 0
        high = max(int(np.searchsorted(upto, done + most, side="right")), low + 1)
        if upto[high - 1] > done:
            mine = starts[(first >= low) & (first < high)]
            head = w8[mine]
            order = np.argsort(head)
            yield w8, resolve(mine[order], head[order], rank)
        low = high


def resolve(starts: np.ndarray, head: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort suffixes that are in the order of their heads: ties by the cover's ranks. Suffixes of two
    residues are compared at the offset that moves both into the cover."""
    new = np.append(True, head[1:] != head[:-1])
    tied = ~(new & np.append(new[1:], True))
    out = starts.copy()
    if not tied.any():
        return out
    group = np.cumsum(new)[tied] << 32
    starts = starts[tied]
    residue = starts % PERIOD
    place = np.zeros(len(starts), np.int64)
    classes = []
    for r in range(PERIOD):
        mine = np.flatnonzero(residue == r)
        classes.append(mine[np.argsort(group[mine] + rank[starts[mine] + _DELTA[r][r]])])
    for a, mine in enumerate(classes):
        for b, other in enumerate(classes):
            if len(mine) and len(other):
                d = _DELTA[a][b]
                there = np.sort(group[other] + rank[starts[other] + d])
                place[mine] += np.searchsorted(there, group[mine] + rank[starts[mine] + d])
    out[tied] = starts[np.argsort(place, kind="stable")]
    return out


def repeats(x: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The starts whose string also starts in a smaller document; docs has the document of each byte of x."""
    out = [np.empty(0, np.int64)]
    for w8, order in sort_suffixes(x, starts):
        same = np.ones(max(len(order) - 1, 0), bool)
        for o in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            same &= w8[order[1:] + o] == w8[order[:-1] + o]
        runs = np.flatnonzero(np.append(True, ~same))
        d = docs[order]
        low = np.repeat(np.minimum.reduceat(d, runs), np.diff(np.append(runs, len(order))))
        out.append(order[d > low])
    return np.concatenate(out)


# --------------------------------------------------------------------------- contexts


def ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... (n[0] of them), lo[1], ..."""
    out = np.arange(int(n.sum()))
    return out + np.repeat(lo - (np.cumsum(n) - n), n)


@dataclass
class Contexts:
    """Runs of strings: ``n`` strings from ``at`` on in the text of (doc, twin); ``text`` holds the
    n + 49 bytes of each, one context after the other."""

    tag: np.ndarray  # 32 bits of the key, to find what may be equal
    doc: np.ndarray
    twin: np.ndarray
    at: np.ndarray
    n: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.tag)

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.n + (LENGTH - 1))

    def take(self, which: np.ndarray) -> Contexts:
        lo = (self.ends - self.n - (LENGTH - 1))[which]
        return Contexts(*(getattr(self, f.name)[which] for f in fields(self)[:-1]), self.text[ragged(lo, self.n[which] + (LENGTH - 1))])

    def part(self, i: int, j: int) -> Contexts:
        ends = self.ends
        return Contexts(*(getattr(self, f.name)[i:j] for f in fields(self)[:-1]), self.text[ends[i - 1] if i else 0 : ends[j - 1] if j else 0])

    @staticmethod
    def join(parts: list[Contexts]) -> Contexts:
        kinds = (np.uint32, np.int64, np.int64, np.int64, np.int64, np.uint8)
        return Contexts(*(np.concatenate([getattr(p, f.name) for p in parts]) if parts else np.empty(0, k) for f, k in zip(fields(Contexts), kinds, strict=True)))


def anchors(data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each position on that has as many."""
    n = len(data)
    pad = np.zeros(n + 16, np.uint8)
    pad[:n] = data
    words = np.empty(n, np.uint64)  # the 8 bytes from each position on
    for r in range(8):
        k = len(words[r::8])
        words[r::8] = pad[r : r + 8 * k].view(np.uint64)
    h = words[: n - ANCHOR + 1] * _ODD[0]
    h ^= h >> np.uint64(32)
    h += words[ANCHOR - 8 : n - 7]
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    h *= _ODD[2]
    return h


def contexts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, key) of the contexts of a slice of texts."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low = anchors(data)
    for size in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-size], low[size:])
    low = np.minimum(low[:n], low[LENGTH - ANCHOR - 31 :][:n])
    past = np.zeros(n + 1, np.int32)
    ends = offs[1:-1]
    np.add.at(past, np.minimum(np.maximum(offs[:-2], ends - LENGTH + 1), n), 1)
    np.add.at(past, np.minimum(ends, n), -1)
    s = np.flatnonzero(np.cumsum(past[:n]) == 0)
    if not len(s):
        return s, s, s.astype(np.uint64)
    key = low[s]
    new = np.flatnonzero(np.append(True, (np.diff(s) != 1) | (key[1:] != key[:-1])))
    return s[new], np.diff(np.append(new, len(s))), fmix(key[new])


def pieces(text_ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` bytes each, or of one context."""
    i = 0
    while i < len(text_ends):
        j = int(np.searchsorted(text_ends, (text_ends[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def copies(x: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """For each context the one that stands for its text, which has the smallest document of those with that
    text; the distinct ones of these. Hashes find equal texts, bytes decide."""
    size = x.n + (LENGTH - 1)
    lo = x.ends - size
    h = span_hash(prefix_hash(x.text), lo, lo + size)
    order = np.lexsort((x.doc, h))
    new = np.append(True, h[order][1:] != h[order][:-1])
    stands = np.empty(len(x), np.int64)
    stands[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    own = np.arange(len(x))
    stands = np.where(size == size[stands], stands, own)
    for i, j in pieces(x.ends, PIECE):
        mine = i + np.flatnonzero(stands[i:j] != own[i:j])
        if len(mine):
            n = size[mine]
            other = x.text[ragged(lo[mine], n)] != x.text[ragged(lo[stands[mine]], n)]
            differ = mine[np.add.reduceat(other, np.cumsum(n) - n, dtype=np.int64) > 0]
            stands[differ] = differ
    return stands, np.flatnonzero(stands == own)


def judged(x: Contexts) -> np.ndarray:
    """Which strings of the contexts, one after the other, also start in a smaller document of them.

    Contexts with equal text collapse: one of the smallest document is looked at, and its strings are repeats in
    every larger document. Of the distinct texts, those whose key no other document has are left out, then
    strings whose hash stands in one document alone; the suffixes of the others are sorted."""
    stands, first = copies(x)
    order, starts, several = groups(x.tag[first], x.doc[first])
    several = order[np.repeat(several, np.diff(np.append(starts, len(order))))]
    at = np.sort(first[several])
    found = np.zeros(int(x.n.sum()), bool)
    of = np.cumsum(x.n) - x.n  # where a context's strings begin
    if len(at):
        found[ragged(of[at], x.n[at])] = _judged(x.take(at))
    again = np.flatnonzero(stands != np.arange(len(x)))
    if len(again):
        own = x.doc[again] == x.doc[stands[again]]
        found[ragged(of[again[~own]], x.n[again[~own]])] = True
        found[ragged(of[again[own]], x.n[again[own]])] = found[ragged(of[stands[again[own]]], x.n[again[own]])]
    return found


def _judged(x: Contexts) -> np.ndarray:
    lo = ragged(x.ends - x.n - (LENGTH - 1), x.n)
    h = span_hash(prefix_hash(x.text), lo, lo + LENGTH)
    order, starts, several = groups(h, np.repeat(x.doc, x.n))
    again = np.zeros(len(lo), bool)
    again[order] = np.repeat(several, np.diff(np.append(starts, len(order))))
    if again.any():
        y = chosen(x, again, True)
        size = y.n + (LENGTH - 1)
        starts = ragged(y.ends - size, y.n)
        flags = np.zeros(len(y.text), bool)
        flags[repeats(y.text, starts, np.repeat(dense(y.doc), size))] = True
        again[again] = flags[starts]
    return again


def runs(x: Contexts, flags: np.ndarray, value: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first string in it, strings) of the runs of strings whose flag has the value."""
    of = np.repeat(np.arange(len(x)), x.n)
    nth = ragged(np.zeros(len(x), np.int64), x.n)
    hit = np.flatnonzero(flags == value)
    if not len(hit):
        return hit, hit, hit
    new = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)))
    return of[hit[new]], nth[hit[new]], np.diff(np.append(new, len(hit)))


def spans(x: Contexts, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, twin, start, end) of what repeated strings cover."""
    of, nth, n = runs(x, again, True)
    lo = x.at[of] + nth
    return x.doc[of], x.twin[of], lo, lo + n + (LENGTH - 1)


def chosen(x: Contexts, flags: np.ndarray, value: bool) -> Contexts:
    """The contexts cut to the strings whose flag has the value."""
    of, nth, n = runs(x, flags, value)
    lo = (x.ends - x.n - (LENGTH - 1))[of] + nth
    return Contexts(x.tag[of], x.doc[of], x.twin[of], x.at[of] + nth, n, x.text[ragged(lo, n + (LENGTH - 1))])


def shrink(x: Contexts, found: list) -> Contexts:
    """Sort the contexts piece by piece; the strings that weren't found in a smaller document."""
    left = []
    for i, j in pieces(x.ends, PIECE):
        part = x.part(i, j)
        again = judged(part)
        found.append(spans(part, again))
        left.append(chosen(part, again, False) if again.any() else part)
    return Contexts.join(left)


def groups(tag: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by tag, starts of the groups in it, whether each group has several documents)."""
    order = np.argsort(tag)
    starts = np.flatnonzero(np.append(True, tag[order][1:] != tag[order][:-1])) if len(tag) else np.empty(0, np.int64)
    if not len(tag):
        return order, starts, np.empty(0, bool)
    d = doc[order]
    return order, starts, np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)


# --------------------------------------------------------------------------- packing

_LEVEL = 3
_META = (("tag", np.uint32), ("doc", np.int64), ("twin", np.int64), ("at", np.uint32), ("n", np.uint32))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as their differences, byte by byte of all numbers, compressed."""
    out = []
    for c in columns:
        d = c.copy()
        d[1:] -= c[:-1]
        out.append(np.ascontiguousarray(d.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(out))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, i = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        d = np.ascontiguousarray(raw[i : i + n * size].reshape(size, n).T).view(k).ravel()
        out.append(np.cumsum(d, dtype=k))
        i += n * size
    return out


def encode(x: Contexts) -> tuple[bytes, bytes]:
    return pack(*(getattr(x, name).astype(k) for name, k in _META)), zstandard.ZstdCompressor(level=_LEVEL).compress(x.text.tobytes())


def decode_meta(blob: bytes) -> list[np.ndarray]:
    tag, doc, twin, at, n = unpack(blob, *(k for _, k in _META))
    return [tag, doc, twin, at.astype(np.int64), n.astype(np.int64)]


def decode_text(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _table(rows: list[tuple], schema: pa.Schema):
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.record_batch([pa.array([r[k] for r in part], f.type) for k, f in enumerate(schema)], schema=schema)


#: What is sent to buckets: packed contexts, or the packed spans found before.
_SENT = pa.schema([("bucket", pa.int32()), ("meta", pa.binary()), ("text", pa.binary()), ("spans", pa.binary())])
#: What a bucket leaves: packed spans by bucket of documents, or single strings.
_LEFT = pa.schema([("bucket", pa.int32()), ("spans", pa.binary()), ("h", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("at", pa.int64()), ("s", pa.binary())])
_SPANS = (np.int64, np.int64, np.uint32, np.uint32)


def pack_spans(found: list, buckets: int) -> list[tuple[int, bytes]]:
    """Spans by bucket of documents."""
    if not found:
        return []
    doc, twin, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(4))
    at = (fmix(doc.view(np.uint64) ^ fmix(twin.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((lo, twin, doc, at))
    doc, twin, lo, hi, at = doc[order], twin[order], lo[order].astype(np.uint32), hi[order].astype(np.uint32), at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[i]), pack(doc[i:j], twin[i:j], lo[i:j], hi[i:j])) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True) if j > i]


# --------------------------------------------------------------------------- tasks


class _Held:
    """Contexts of a task until they are sent: where they stand in the texts held with them."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.texts: list[np.ndarray] = []
        self.n = self.size = 0

    def add(self, data, offs, doc, twin, base=0) -> None:
        """Texts of a slice; ``base`` is where the only one begins if it is a part of a longer one."""
        first, n, key = contexts(data, offs)
        if len(first):
            row = np.searchsorted(offs, first, side="right") - 1
            self.rows.append((key, doc[row], twin[row], first - offs[row] + base, n, first + self.size))
            self.texts.append(data)
            self.n += len(first)
            self.size += len(data)

    def send(self, buckets: int):
        if not self.n:
            return
        key, doc, twin, at, n, src = (np.concatenate([r[k] for r in self.rows]) for k in range(6))
        data = np.concatenate(self.texts)
        self.__init__()
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        tag = key.astype(np.uint32)
        order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | tag)
        key, doc, twin, at, n, src, bucket, tag = (c[order] for c in (key, doc, twin, at, n, src, bucket, tag))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lens = np.diff(np.append(starts, len(key)))
        often = np.repeat(lens > OFTEN, lens)
        found: list = []

        def texts(which):
            return Contexts(tag[which], doc[which], twin[which], at[which], n[which], data[ragged(src[which], n[which] + (LENGTH - 1))])

        hot = np.flatnonzero(often)
        kept, of = [], []
        for i, j in pieces(np.cumsum(n[hot] + (LENGTH - 1)), 4 * PIECE):
            b = bucket[hot[i:j]]
            for at_bucket in np.unique(b).tolist():
                kept.append(shrink(texts(hot[i:j][b == at_bucket]), found))
                of.append(at_bucket)
        more: dict[int, list[Contexts]] = {}
        for b, x in zip(of, kept, strict=True):
            more.setdefault(b, []).append(x)
        rare = np.flatnonzero(~often)
        cuts = np.flatnonzero(np.diff(bucket[rare])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rare)], strict=True):
            if j > i:
                b = int(bucket[rare[i]])
                for p, q in pieces(np.cumsum(n[rare[i:j]] + (LENGTH - 1)), 4 * PIECE):
                    x = Contexts.join([texts(rare[i + p : i + q]), *more.pop(b, [])])
                    yield (b, *encode(x), None)
        for b, parts in more.items():
            yield (b, *encode(Contexts.join(parts)), None)
        for b, blob in pack_spans(found, buckets):
            yield (b, None, None, blob)


def _send(batches, buckets: int):
    held = _Held()
    for b in batches:
        doc, twin = b.column(0).to_numpy(), b.column(1).to_numpy()
        data, offs = raw_text(b.column(2))
        for i, j in slices(offs):
            if j > i + 1 or offs[j] - offs[i] <= LONG:
                held.add(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], doc[i:j], twin[i:j])
            else:  # one long text, in parts that share 49 bytes
                for at in range(int(offs[i]), int(offs[j]) - LENGTH + 1, LONG):
                    end = min(at + LONG + LENGTH - 1, int(offs[j]))
                    held.add(data[at:end], np.array([0, end - at]), doc[i:j], twin[i:j], at - int(offs[i]))
                    if held.n > FLUSH:
                        yield from _table(list(held.send(buckets)), _SENT)
            if held.n > FLUSH:
                yield from _table(list(held.send(buckets)), _SENT)
    yield from _table(list(held.send(buckets)), _SENT)


def _leave(x: Contexts) -> list[tuple]:
    """The contexts string by string."""
    lo = ragged(x.ends - x.n - (LENGTH - 1), x.n)
    h = span_hash(prefix_hash(x.text), lo, lo + LENGTH).view(np.int64)
    of = np.repeat(np.arange(len(x)), x.n)
    at = ragged(x.at, x.n)
    raw = x.text.tobytes()
    return [(None, None, a, b, c, d, raw[e : e + LENGTH]) for a, b, c, d, e in zip(h.tolist(), x.doc[of].tolist(), x.twin[of].tolist(), at.tolist(), lo.tolist(), strict=True)]


def _sort_bucket(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    metas: list[list[np.ndarray]] = []
    packed: list[bytes] = []
    gone = np.empty(0, np.uint32)  # keys that have left string by string
    size = 0

    def pool(which=None) -> Contexts:
        """All contexts held, or those with a flag of theirs, in the order in which they came."""
        parts, done = [], 0
        for meta, blob in zip(metas, packed, strict=True):
            hit = np.arange(len(meta[0])) if which is None else np.flatnonzero(which[done : done + len(meta[0])])
            done += len(meta[0])
            if len(hit):
                parts.append(Contexts(*meta, decode_text(blob)).take(hit))
        return Contexts.join(parts)

    def compact():
        """Give back memory: sort what is held, let the largest keys leave."""
        nonlocal size, gone
        x = pool()
        order, starts, several = groups(x.tag, x.doc)
        lens = np.diff(np.append(starts, len(x)))
        several = np.repeat(several, lens)
        found: list = []
        x = Contexts.join([x.take(order[~several]), shrink(x.take(order[several]), found)])
        rows = [(b, blob, None, None, None, None, None) for b, blob in pack_spans(found, buckets)]
        tags, of = np.unique(x.tag, return_inverse=True)
        room = np.bincount(of, x.n + (LENGTH - 1), len(tags))
        if room.sum() > BUCKET_MOST // 2:
            largest = np.argsort(-room)
            out = tags[largest[: int(np.searchsorted(np.cumsum(room[largest]), room.sum() - BUCKET_MOST // 4)) + 1]]
            hit = np.isin(x.tag, out)
            rows += _leave(x.take(np.flatnonzero(hit)))
            x = x.take(np.flatnonzero(~hit))
            gone = np.union1d(gone, out)
        metas[:], packed[:] = [], []
        size = len(x.text)
        if len(x):
            meta, text = encode(x)
            metas.append(decode_meta(meta))
            packed.append(text)
        yield from _table(rows, _LEFT)

    for b in batches:
        early = [(k, s, None, None, None, None, None) for k, s in zip(b.column("bucket").to_pylist(), b.column("spans").to_pylist(), strict=True) if s is not None]
        yield from _table(early, _LEFT)
        for meta, text in zip(b.column("meta").to_pylist(), b.column("text").to_pylist(), strict=True):
            if meta is None:
                continue
            meta = decode_meta(meta)
            if len(gone) and (hit := gone[np.minimum(np.searchsorted(gone, meta[0]), len(gone) - 1)] == meta[0]).any():
                x = Contexts(*meta, decode_text(text))
                yield from _table(_leave(x.take(np.flatnonzero(hit))), _LEFT)
                meta, text = encode(x.take(np.flatnonzero(~hit)))
                meta = decode_meta(meta)
            metas.append(meta)
            packed.append(text)
            size += int(meta[4].sum()) + (LENGTH - 1) * len(meta[4])
            if size > BUCKET_MOST:
                yield from compact()
    if not metas:
        return
    tag, doc = (np.concatenate([m[k] for m in metas]) for k in (0, 1))
    order, starts, several = groups(tag, doc)
    wanted = np.empty(len(tag), bool)
    wanted[order] = np.repeat(several, np.diff(np.append(starts, len(tag))))
    x = pool(wanted)
    packed.clear()
    order, starts, several = groups(x.tag, x.doc)
    x = x.take(order)
    ends = x.ends[np.append(starts[1:], len(x)) - 1] if len(x) else np.empty(0, np.int64)  # of the groups
    bounds = np.append(starts, len(x))
    found: list = []
    for i, j in pieces(ends, PIECE):
        part = x.part(int(bounds[i]), int(bounds[j]))
        if j == i + 1 and len(part.text) > KEY_MOST:
            part = shrink(part, found)
            if len(part.text) > KEY_MOST:
                yield from _table(_leave(part), _LEFT)
                continue
        found.append(spans(part, judged(part)))
    yield from _table([(b, blob, None, None, None, None, None) for b, blob in pack_spans(found, buckets)], _LEFT)


def _sorted_strings(batches, buckets: int):
    """Single strings in the order of hash and document: the first document of each string has it for the others."""
    last, seen = None, {}
    for b in batches:
        hit = []
        for h, doc, twin, at, s in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if h != last:
                last, seen = h, {}
            if seen.setdefault(s, doc) < doc:
                hit.append((doc, twin, at))
        if hit:
            doc, twin, at = (np.array(c, np.int64) for c in zip(*hit, strict=True))
            rows = pack_spans([(doc, twin, at, at + LENGTH)], buckets)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "spans"])


def _merge_spans(table: pa.Table) -> pa.Table:
    """One row per text: what is covered, without overlaps."""
    parts = [unpack(s, *_SPANS) for s in table.column("spans").to_pylist()]
    doc, twin, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((lo, twin, doc))
    doc, twin, lo, hi = doc[order], twin[order], lo[order], hi[order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(twin) != 0)) + 1
    rows = []
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        a, b = lo[i:j], np.maximum.accumulate(hi[i:j])
        new = np.append(True, a[1:] > b[:-1])
        rows.append((int(doc[i]), int(twin[i]), a[new].tobytes(), b[np.append(np.flatnonzero(new)[1:] - 1, j - i - 1)].tobytes()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc", "twin", "lo", "hi"])


def _cut(batches):
    for b in batches:
        data, offs = raw_text(b.column(1))
        n, gone, parts, kept = [], [], [], []
        for i, (lo, hi) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            text = data[offs[i] : offs[i + 1]].tobytes()
            lo, hi = np.frombuffer(lo or b"", np.uint32).tolist(), np.frombuffer(hi or b"", np.uint32).tolist()
            n.append(len(text))
            gone.append(sum(hi) - sum(lo))
            parts.append(len(lo))
            kept.append(b"".join(text[a:z] for a, z in zip([0, *hi], [*lo, len(text)], strict=True)))
        yield pa.record_batch(
            [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


# --------------------------------------------------------------------------- the operator


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is the text
    that is left, as binary.

    Texts are UTF-8 bytes (null: empty) and matches never cross rows. Every byte covered by a
    50-byte string that also starts in a row with a smaller id is removed; strings are judged on the
    input. Texts under 50 bytes are left alone. Rows with the same id don't remove from each other;
    a null id counts as the largest bigint. Where ids repeat, rows of one id are told apart by a
    64-bit hash of their texts, since equal texts of one id lose the same. Of very long texts, parts
    are placed one after the other. An empty table gives an empty table; other columns are ignored."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    stats = docs.agg(F.count("*").alias("n"), F.countDistinct("doc").alias("d"), F.sum(F.octet_length("t")).alias("b")).first()
    unique = stats["n"] == stats["d"]
    docs = docs.withColumn("twin", F.lit(0).cast("bigint") if unique else F.xxhash64("t"))
    once = docs if unique else docs.dropDuplicates(["doc", "twin"])
    buckets = max(128, -(-int(stats["b"] or 0) * (LENGTH + 17) // 18 // BUCKET_BYTES))

    def ddl(schema: pa.Schema) -> str:
        return ", ".join(f"{f.name} {({pa.int32(): 'int', pa.int64(): 'bigint'}).get(f.type, 'binary')}" for f in schema)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sort_bucket(batches, buckets)

    sort.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    sent = once.select("doc", "twin", "t").mapInArrow(lambda b: _send(b, buckets), ddl(_SENT))
    left = materialize(sent.groupBy("bucket").applyInArrow(sort, ddl(_LEFT)), "repeats")
    found = left.where("spans is not null").select("bucket", "spans")
    single = left.where("h is not null").select("h", "doc", "twin", "at", "s")
    if not single.isEmpty():
        found = found.unionByName(single.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(lambda b: _sorted_strings(b, buckets), "bucket int, spans binary"))
    merged = found.groupBy("bucket").applyInArrow(_merge_spans, "doc bigint, twin bigint, lo binary, hi binary")
    rows = docs.join(merged, ["doc", "twin"], "left").select("doc_id", "t", "lo", "hi")
    return rows.mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
