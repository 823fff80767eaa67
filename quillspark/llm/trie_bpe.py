"""Byte-pair encoding by a trie of words, and decoding.

Every prefix of a word has one encoding, and that encoding without its last token is the encoding of
a shorter prefix. So the last token is all the state that a prefix needs: it is the one token that
ends the prefix and may follow the last token of what stands before it. The distinct words of a batch
form a trie; sorted, they are its leaves in depth-first order, and what a word shares with the one before
is the path that both have. The walk keeps the last tokens of the nodes on the current path, so each
node's is found once for all words below it, and a word's encoding is read off along the path.

Two tokens may stand side by side if merging their symbols never joins the two. Each token has one
derivation by merges of rising rank, so only merges between the right edge of one and the left edge of
the other have to be looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import raw_text, slices, tune
from .token_count import byte_alphabet

#: Encodings of words of at most so many characters are kept for later batches.
KEPT_CHARS = 48
#: Words and pairs of tokens that a worker remembers. Of the words, half is forgotten when full: those not met since
#: it was last full. The pairs are emptied. So memory is bounded.
WORDS, PAIRS = 250_000, 200_000
#: Bytes of texts whose words form one trie (or one longer text).
BATCH_BYTES = 4 << 20

# The normaliser and splitter of lower-case vocabularies with word ends, as their files state them.
LOWER_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
LOWER_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWER_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": LOWER_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same splits of texts whose characters are all in PLAIN, which is closed under lower case and has no characters to
#: compose, and not in ODD, on whose classes engines differ.
WESTERN = re.compile(r"[a-zªµºß-öø-ÿĀ-ſ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zªµºß-öø-ÿĀ-ſ0-9]+")
PLAIN, ODD = re.compile("[\x00-įı-ſ\u2000-\u206f€]*"), re.compile("[\x1c-\x1f²³¹¼½¾]")
#: Characters whose properties have been the same for many versions of Unicode; others go by the library.
SETTLED = re.compile("[\x00-ɏͰ-ͷ΄-ΊΌΎ-ΡΣ-ԯ\u2000-\u2064₠-₹←-⏳ぁ-ゖ゠-ヿ一-鿌\U0001f300-\U0001f320\U0001f600-\U0001f64f]*")


class TrieBpe:
    """Encodes with a byte-level BPE file (the ``tokenizers`` JSON format), with or without an end-of-word
    suffix. Files whose tokens have several derivations, or merges that come before those of their parts,
    are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges") or spec["post_processor"] not in (None, *[x for x in [spec["post_processor"]] if x and x["type"] == "ByteLevel"]):
            raise ValueError("only plain byte-level BPE files are read")
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.ended = bool(suffix)
        vocab = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.specials = sorted(vocab, key=len, reverse=True)
        self.special_ids = {t: array("i", [i]).tobytes() for t, i in vocab.items()}
        vocab = model["vocab"] | vocab
        name = {i: t for t, i in vocab.items()}

        def symbols(token: str) -> str:
            """A token as one character for each byte, the last one of a word beyond 255."""
            end = bool(suffix) and token.endswith(suffix)
            codes = [self.byte[c] for c in (token[: -len(suffix)] if end else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * end)

        # Of each token: the two that were merged into it, and the rank of that merge; -1 for a symbol.
        top = max(vocab.values()) + 1
        self.left, self.right, self.made = (array("i", [-1]) * top for _ in range(3))
        self.rank: dict[int, int] = {}
        known = {vocab[t] for c in self.byte for t in (c, c + suffix)}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            if made in known or a not in known or b not in known:
                raise ValueError("a merge is not the only one of its token, or precedes those of its parts")
            known.add(made)
            self.left[made], self.right[made], self.made[made] = a, b, rank
            self.rank[a << 32 | b] = rank
        self.pairs: dict[int, bool] = {}
        ids: dict[str, int] = {}
        whole: set[int] = set()  # tokens whose symbols merge into them
        for t in sorted(known, key=self.made.__getitem__):
            a, b = self.left[t], self.right[t]
            if a < 0 or a in whole and b in whole and self.crossing(a, b) == self.made[t]:
                whole.add(t)
                ids[symbols(name[t])] = t
        self._automaton(ids)
        self.plain = spec.get("normalizer") == LOWER_NORMALIZER and spec.get("pre_tokenizer") == LOWER_SPLITTER
        self.split = regex.compile(LOWER_PATTERN)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.nodes = 0  # of all tries so far

    def _automaton(self, ids: dict[str, int]) -> None:
        """Tokens as an automaton that reads a word once: each state's ``hit`` is the longest token that ends
        there, as a state, and ``shorter`` leads from it to the next one."""
        self.step, self.fail, self.token, self.size = {}, array("i", [0]), array("i", [-1]), array("i", [0])
        made = []
        for text, t in ids.items():
            node = 0
            for c in text:
                key = node << 9 | ord(c)
                below = self.step.get(key)
                if below is None:
                    below = self.step[key] = len(self.fail)
                    self.fail.append(0)
                    self.token.append(-1)
                    self.size.append(self.size[node] + 1)
                    made.append((self.size[below], node, ord(c), below))
                node = below
            self.token[node] = t
        self.hit, self.shorter = array("i", bytes(4 * len(self.fail))), array("i", bytes(4 * len(self.fail)))
        for size, above, c, node in sorted(made):
            if size > 1:
                at = self.fail[above]
                while (to := self.step.get(at << 9 | c)) is None and at:
                    at = self.fail[at]
                self.fail[node] = to or 0
            self.shorter[node] = self.hit[self.fail[node]]
            self.hit[node] = node if self.token[node] >= 0 else self.shorter[node]

    def _edge(self, token: int, part: array) -> list[tuple[int, int, int]]:
        """(piece, rank that made it, rank that used it) of the pieces that stand at one end of a token as it is merged."""
        out, until = [], 1 << 40
        while token >= 0:
            out.append((token, self.made[token], until))
            until, token = self.made[token], part[token]
        return out

    def crossing(self, a: int, b: int) -> int | None:
        """The rank of the first merge that joins the end of token a with the beginning of b; None if none does.
        A merge takes place if both pieces stand when its turn comes; of equal pairs the left one goes first."""
        best, left = None, self._edge(b, self.left)
        for x, x_from, x_to in self._edge(a, self.right):
            for y, y_from, y_to in left:
                q = self.rank.get(x << 32 | y)
                if q is not None and x_from < q < x_to and y_from < q <= y_to and (best is None or q < best):
                    best = q
        return best

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.crossing(a, b) is None
        return found

    def walk(self, words: Iterable[str]) -> dict[str, bytes]:
        """The encodings of distinct words, as 32-bit ids: a depth-first walk through their trie."""
        step, fail, hit, shorter, token, size, pairs, made = self.step, self.fail, self.hit, self.shorter, self.token, self.size, self.pairs, {}
        # Of each node on the path: its state, its last token, the depth before that.
        state, last, back, shared = [0], [-1], [0], b""
        for data, word in sorted((w.encode("utf-8"), w) for w in words):
            codes = list(data)
            codes[-1] += 256 * self.ended
            # Where word ends are marked, a last byte is a symbol of its own, and paths part before it.
            depth, most = 0, min(len(data), len(shared)) - self.ended
            while depth < most and data[depth] == shared[depth]:
                depth += 1
            del state[depth + 1 :], last[depth + 1 :], back[depth + 1 :]
            at = state[depth]
            for d in range(depth, len(codes)):
                c = codes[d]
                while (to := step.get(at << 9 | c)) is None:
                    at = fail[at]
                at = to
                found = hit[at]
                while True:  # tokens that end here, longest first
                    t, i = token[found], d + 1 - size[found]
                    if i == 0:
                        break
                    fits = pairs.get(last[i] << 32 | t)
                    if fits or fits is None and self.may_follow(last[i], t):
                        break
                    found = shorter[found]
                state.append(at)
                last.append(t)
                back.append(i)
            self.nodes += len(codes) - depth
            shared, d, ids = data, len(codes), []
            while d:
                ids.append(last[d])
                d = back[d]
            ids.reverse()
            made[word] = array("i", ids).tobytes()
        return made

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if self.plain and (text.isascii() or PLAIN.fullmatch(text)):
            return (self.split if ODD.search(text) else WESTERN).findall(text.lower())
        if self.plain and SETTLED.fullmatch(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no form of its own at a word's end
            return self.split.findall(text.lower())
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.byte.__getitem__, w)).decode("utf-8") for w, _ in found]

    def parts(self, text: str) -> list[str]:
        """Special tokens and what stands between them, in turn: leftmost first, the longest of those that begin there."""
        if any(s in text for s in self.specials):
            return re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text)
        return [text]

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers; special tokens' strings stand for themselves."""
        split = [[(k % 2, p if k % 2 else self.words(p)) for k, p in enumerate(self.parts(t))] for t in texts]
        new = set()
        for parts in split:
            for special, words in parts:
                if not special:
                    new.update(words)
        if len(self.memo) >= WORDS // 2:
            self.memo, self.older = {}, self.memo
        new.difference_update(self.memo)
        met = new & self.older.keys()
        self.memo.update((w, self.older[w]) for w in met)
        made = self.walk(new - met)
        self.memo.update(made)
        get = self.memo.__getitem__
        out = [b"".join(self.special_ids[p] if special else b"".join(map(get, p)) for special, p in parts) for parts in split]
        for w in made:
            if len(w) > KEPT_CHARS:
                del self.memo[w]
        return out


class Decoder:
    """Decodes with a byte-level BPE file: tokens joined by spaces where the file has no decoder, else the text
    of their bytes. Other decoders are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder {kind!r}")
        self.token: dict[int, str | bytes] = {i: t for t, i in spec["model"]["vocab"].items()}
        if kind:
            byte = {c: b for b, c in enumerate(byte_alphabet())}
            self.token = {i: bytes(map(byte.__getitem__, t)) for i, t in self.token.items()}
        self.token |= {t["id"]: t["content"].encode() if kind else t["content"] for t in spec.get("added_tokens") or []}
        self.spaced = kind is None

    def decode(self, ids: Iterable[int]) -> str:
        tokens = map(self.token.__getitem__, ids)
        return " ".join(tokens) if self.spaced else b"".join(tokens).decode("utf-8", "replace")


@lru_cache(1)
def _model(path: str) -> TrieBpe:
    return TrieBpe(path)


@lru_cache(1)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids of the text's tokens in order.

    Null and empty texts, and texts of white space alone, have none. Null or repeated ids are carried
    through, one output row per input row; other columns are ignored whatever their names; an empty
    table gives an empty table. Texts of any length are encoded whole; the words of ``BATCH_BYTES`` of
    texts, or of one longer text, form one trie, and encodings are kept for the next. ``vocabulary`` is a path that every executor can read (an installed package's
    file). A special token's string in a text is that token."""
    tune(docs.sparkSession)

    def run(batches):
        model = _model(vocabulary)
        for b in batches:
            _, offs = raw_text(b.column(1))
            for i, j in slices(offs, BATCH_BYTES):
                made = model.encode_batch(t or "" for t in b.column(1).slice(i, j - i).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in made)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(made), np.int32)))
                yield pa.record_batch([b.column(0).slice(i, j - i), ids], names=["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of every row of ids. Null counts as no ids, whose text is empty; ids that
    the vocabulary lacks, and null ids in a list, raise KeyError."""
    tune(encoded.sparkSession)

    def run(batches):
        model = _decoder(vocabulary)
        for b in batches:
            lists = b.column(1)
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            texts = [model.decode(ids[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
