"""Secret scan by token efficiency.

Three kinds of base patterns find keys that announce themselves. The token-efficiency test finds
the others: a random string breaks into many short tokens under a vocabulary learned from text, so
few characters per token expose it. Known digests and identifiers are excluded first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import tune
from .token_count import PATTERN

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: A candidate of the token-efficiency test has so many characters at least.
MIN_CHARS = 20
#: At most so many characters per token make a candidate random. Random base-62 strings come to 1.3 to 1.7, words to over 2.5.
MAX_RATIO = 2.0
#: Lengths of hexadecimal digests in common use (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = {32, 40, 56, 64, 96, 128}

_assign, _access = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS)
_hex, _run = re.compile(r"[0-9a-f]{24,}"), re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_words = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_uuid = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_known = re.compile(r"(?<![A-Za-z0-9])(?:" + _uuid.pattern + "|" + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in sorted(DIGESTS)) + r")(?![A-Za-z0-9])")
_named = re.compile(r"[A-Za-z]+\d{0,4}([_/-][A-Za-z]*\d{0,4})+=*")
_has_hex = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_has_run = bytes(120 if i < 128 and re.match(r"[A-Za-z0-9+/_=-]", chr(i)) else 32 for i in range(256))


@lru_cache(2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str, data: bytes | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and non-overlapping on its own."""
    data = text.encode("utf-8") if data is None else data
    found = []
    low = data.lower()
    if any(w in low for w in _words):
        found += [(m.start(), "assign", m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), "access", m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in data.translate(_has_hex):
        found += [(m.start(), "hex", m.end()) for m in _hex.finditer(text)]
    return found


def excluded(run: str) -> bool:
    """Known digests and identifiers: hexadecimal of a digest's length, UUIDs, names of several parts of
    letters with a few digits at the end of each, and runs without a letter. A single part, of letters
    alone too, is left to its ratio."""
    bare = run.rstrip("=")
    if _uuid.fullmatch(run) or _named.fullmatch(run) or not re.search(r"[A-Za-z]", bare):
        return True
    return len(bare) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare) is not None


def dense(piece: str, encoding: tiktoken.Encoding, most: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of a piece that windows cover which take many tokens: the shortest windows
    of MIN_CHARS or more that begin or end with each token. Windows that meet are one part."""
    ends = [0, *accumulate(len(x) for x in encoding.decode_tokens_bytes(encoding.encode_ordinary(piece)))]
    after = [bisect_left(ends, x + MIN_CHARS) for x in ends]
    before = [bisect_right(ends, x - MIN_CHARS) - 1 for x in ends]
    out: list[tuple[int, int]] = []
    for i, j in sorted({(i, j) for i, j in enumerate(after) if j < len(ends)} | {(i, j) for j, i in enumerate(before) if i >= 0}):
        start, end = ends[i], ends[j]
        if end - start <= most * (j - i) and not excluded(piece[start:end].strip("/_-=+")):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
    return out


def random_spans(text: str, encoding: tiktoken.Encoding, data: bytes | None = None, most: float = MAX_RATIO) -> list[tuple[int, str, int]]:
    """(start, "random", end) of runs that take many tokens for their characters, and of such windows in
    runs that as a whole don't: a random key behind a longer readable part. Digests and UUIDs among the
    parts of a run cut it."""
    data = text.encode("utf-8") if data is None else data
    if b"x" * MIN_CHARS not in data.translate(_has_run):
        return []
    out = []
    for m in _run.finditer(text):
        run = m[0]
        if excluded(run):
            continue
        if len(run) <= most * len(encoding.encode_ordinary(run)):
            out.append((m.start(), "random", m.end()))
            continue
        at = 0
        for cut in [*_known.finditer(run), None]:
            piece = run[at : cut.start() if cut else len(run)]
            if len(piece) >= MIN_CHARS:
                out += [(m.start() + at + s, "random", m.start() + at + e) for s, e in dense(piece, encoding, most)]
            at = cut.end() if cut else at
    return out


def scan_secrets(docs: DataFrame, vocabulary: str, most: float = MAX_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every row, found being array<struct<kind, start, end, text>> in the order of
    start and kind; offsets are code points, the end exclusive.

    A random span that touches a base span is left to that base span. Null and empty texts have no
    spans; null and repeated ids are carried through; texts are scanned whole; other columns are
    ignored; an empty table gives an empty table."""
    tune(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches):
        encoding = _encoding(vocabulary)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                data = text.encode("utf-8")
                spans = base_spans(text, data)
                more = random_spans(text, encoding, data, most)
                spans += [x for x in more if not any(s < x[2] and x[0] < e for s, _, e in spans)]
                spans.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                out.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, k, e in spans])
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(item))], names=["doc_id", "found"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, found array<struct<kind string, start bigint, end bigint, text string>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
