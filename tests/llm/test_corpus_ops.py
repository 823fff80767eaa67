"""Operators over whole corpora: exact and near copies, repeated strings, mixing, components."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from quillspark.llm import exact_dedup, jaccard_join, mixing, suffix_dedup
from quillspark.llm.common import connected_components

ODD = [None, "", "  \t", "a", "a", " a", "one two three", "One  TWO three", "x" * 5000, "w " * 3000]


def table(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS n", "'k' AS key", "2 AS kept", "3 AS doc", "4 AS root", "'s' AS source")
    return df.repartition(parts) if rows else df


def corpus(seed=4, n=80):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randrange(2, 7))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(10, 10 + n):
        if i % 3 == 0 and i > 20:
            w = (rng.choice([t for _, t in rows[10:] if t]) or "").split()
            for _ in range(rng.randrange(4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.randrange(0, 90)))))
    return rows + [(7, "one two three"), (12, rows[12][1]), (None, rows[13][1]), (None, "only null ids " * 4)]


@pytest.mark.parametrize("budget", [1 << 26, 2000])
def test_exact_dedup(spark, budget):
    rows = corpus()
    got = exact_dedup.exact_dedup(table(spark, rows), budget=budget).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(groups)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_open_addressing_compares_whole_texts():
    t = exact_dedup.Table()
    for i in range(3000):
        t.add(5, i, 1, 1, str(i % 1500).encode())  # all hashes collide
        if i > 60:
            break
    for i in range(5000):
        t.add(i * 7, i, 1, 1, str(i).encode())
    t.add(7, -1, 1, 1, b"1")
    row = next(r for r in t.rows if r[0] == 7 and r[4] == b"1")
    assert row[1:4] == [-1, 1, 2]


def brute_near(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links = {a: [b for b in range(len(rows)) if b != a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])] for a in range(len(rows))}
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], len(sets[a]), min(ids, default=None), len(links[a])))
    return sorted(out, key=repr)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = corpus(9, 120)
    base = " ".join(f"g{i}" for i in range(60)).split()
    rng = random.Random(3)
    for i in range(200, 290):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    want = brute_near(rows)
    key = lambda r: (r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"])
    assert sorted(map(key, jaccard_join.near_duplicates(table(spark, rows)).collect()), key=repr) == want
    for name, value in (("TILE", 8), ("BLOCK_MIN", 8), ("HOT_TOKEN", 4), ("BROADCAST_KEYS", 1)):  # tiles in pieces, hot tokens dealt out, keys of tiles salted
        monkeypatch.setattr(jaccard_join, name, value)
    assert sorted(map(key, jaccard_join.near_duplicates(table(spark, rows)).collect()), key=repr) == want
    assert jaccard_join.near_duplicates(table(spark, [])).count() == 0


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, rng.choice(a, len(a) // 2)]))
        x, y = jaccard_join.bitmap(a), jaccard_join.bitmap(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard_join.fold(x, size) ^ jaccard_join.fold(y, size)).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


def brute_repeats(rows):
    texts = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, x in texts:
        for p in range(len(x) - 49):
            first[x[p : p + 50]] = min(first.get(x[p : p + 50], i), i)
    out = []
    for (i, x), (orig, _) in zip(texts, rows, strict=True):
        m = bytearray(len(x))
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                m[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, f in zip(x, m, strict=True) if not f)
        out.append((orig, len(x), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeated", [False, True])
def test_repeats_equal_brute_force(spark, repeated):
    rows = corpus(6, 60)
    rng = random.Random(8)
    shared = ["".join(rng.choices("abcd ", k=k)) for k in (49, 50, 51, 120, 400)]
    rows += [(300 + i, "".join(rng.choices("wxyz ", k=rng.randrange(40))) + rng.choice(shared) + "".join(rng.choices("wxyz ", k=30)) + rng.choice(shared)) for i in range(40)]
    rows += [(400, "ab" * 60), (401, "ba" * 60), (402, "é" * 80)]
    if not repeated:
        rows = [(i, t) for k, (i, t) in enumerate(rows) if i is not None and i not in {r[0] for r in rows[:k]}]
    got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_contexts_of_one_anchor_are_not_mistaken(spark):
    line = "All rights reserved by the owners of this small site."
    # The contexts of the line with these ends agree in 32 bits of the hash that was used before.
    rows = [(1, line + "pgobgffebasayeccexovdrvmeqmivnfbmsihczcujpodaktjpbtwwjyrfwzr"), (2, line + "uicdkrjlgwlxvejdsabrxaavlwncsgsbmpgttvdwyrujktjzfclfhmxciojd")]
    got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in got} == {1: rows[0][1], 2: rows[1][1][len(line) :]}


def local_repeats(rows, monkeypatch, **bounds):
    """The operator's tasks one after the other in this process, with small bounds."""
    for name, value in bounds.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    doc = np.array([suffix_dedup.NULL_ID if i is None else i for i, _ in rows], np.int64)
    twin = np.array([zlib.crc32((t or "").encode()) for _, t in rows], np.int64)
    once = list(dict.fromkeys(zip(doc.tolist(), twin.tolist(), [t for _, t in rows], strict=True)))
    batches = [pa.record_batch([pa.array(c, k) for c, k in zip(zip(*once[i : i + 17], strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc", "twin", "t"]) for i in range(0, len(once), 17)]
    sent = pa.Table.from_batches(list(suffix_dedup._send(iter(batches), 3)), suffix_dedup._SENT)
    left = []
    for b in range(3):
        mine = sent.filter(pa.compute.equal(sent["bucket"], b))
        left += suffix_dedup._sort_bucket(iter(mine.to_batches(2)), 3)
    left = pa.Table.from_batches(left, suffix_dedup._LEFT)
    single = left.filter(left["h"].is_valid()).sort_by([("h", "ascending"), ("doc", "ascending")]).select(["h", "doc", "twin", "at", "s"])
    spans = pa.concat_tables([left.filter(left["spans"].is_valid()).select(["bucket", "spans"]), pa.Table.from_batches(list(suffix_dedup._sorted_strings(single.to_batches(5), 3)), pa.schema([("bucket", pa.int32()), ("spans", pa.binary())]))])
    found = {}
    for b in range(3):
        mine = spans.filter(pa.compute.equal(spans["bucket"], b))
        if mine.num_rows:
            found |= {(r["doc"], r["twin"]): (r["lo"], r["hi"]) for r in suffix_dedup._merge_spans(mine).to_pylist()}
    cover = [found.get((d, w), (None, None)) for d, w in zip(doc.tolist(), twin.tolist(), strict=True)]
    batch = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string()), pa.array([c[0] for c in cover], pa.binary()), pa.array([c[1] for c in cover], pa.binary())], names=["doc_id", "t", "lo", "hi"])
    got = next(suffix_dedup._cut([batch])).to_pylist()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr), single.num_rows


def test_repeats_with_small_bounds(monkeypatch):
    """Hot keys, full buckets, keys that leave string by string, long texts in parts."""
    line = "All rights reserved by the owners of this small site. "
    rng = random.Random(12)
    rows = corpus(6, 60) + [(500 + i, "".join(rng.choices("abc ", k=30)) + line + "".join(rng.choices("abc ", k=40))) for i in range(150)]
    rows += [(700 + i, line * 3) for i in range(60)] + [(None, line + str(i)) for i in range(40)] + [(800, "-" * 400), (801, "-" * 300), (802, "xy" * 200 + "-" * 80)]
    rng.shuffle(rows)
    want = brute_repeats(rows)
    assert local_repeats(rows, monkeypatch, FLUSH=200)[0] == want
    assert local_repeats(rows, monkeypatch, OFTEN=3, PIECE=600, SUFFIXES=64)[0] == want
    assert all(local_repeats([(i, t)], monkeypatch, LONG=k)[0] == brute_repeats([(i, t)]) for k in (1, 77) for i, t in rows[:3])
    monkeypatch.setattr("quillspark.llm.common.SLICE_BYTES", 1)
    assert local_repeats(rows, monkeypatch, LONG=90)[0] == want
    got, single = local_repeats(rows, monkeypatch, KEY_MOST=400)
    assert got == want and single > 0
    got, single = local_repeats(rows, monkeypatch, KEY_MOST=4 << 20, BUCKET_MOST=5000)
    assert got == want and single > 0


def test_equal_contexts_are_sorted_once(monkeypatch):
    rng = random.Random(21)
    text, other = ("".join(rng.choices("abcdefgh ", k=600)) for _ in range(2))
    rows = [(i, text) for i in range(40)] + [(50 + i, other[: 90 + i] + text[100:400]) for i in range(3)] + [(7, other), (None, text)]
    rng.shuffle(rows)
    seen, real = [], suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda x, starts, docs: seen.append(len(starts)) or real(x, starts, docs))
    assert local_repeats(rows, monkeypatch)[0] == brute_repeats(rows)
    assert sum(seen) < len(text)  # of about 45 copies of its strings


def test_equal_hashes_of_different_contexts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "span_hash", lambda c, starts, ends: np.zeros(len(starts), np.uint64))
    rows = corpus(9, 40)
    assert local_repeats(rows, monkeypatch)[0] == brute_repeats(rows)


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        cols = [rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(-(1 << 62), 1 << 62, n), rng.integers(0, 9, n).astype(np.uint32)]
        for a, b in zip(cols, suffix_dedup.unpack(suffix_dedup.pack(*cols), *(c.dtype for c in cols)), strict=True):
            assert (a == b).all() and len(a) == len(b)


def test_difference_cover_sort():
    rng = np.random.default_rng(2)
    for k in (2, 3, 20):
        x = rng.integers(97, 97 + k, 1500).astype(np.uint8)
        x[700:900] = x[100:300]
        starts = np.arange(len(x) - 50)
        got = np.concatenate([o for _, o in suffix_dedup.sort_suffixes(x, starts, most=200)])
        raw = x.tobytes()
        keys = [raw[i : i + 50] for i in got.tolist()]
        assert sorted(got.tolist()) == starts.tolist() and keys == sorted(keys)
        docs = np.arange(len(x)) // 250
        first = {}
        for i in starts.tolist():
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], 99), docs[i])
        assert sorted(suffix_dedup.repeats(x, starts, docs).tolist()) == [i for i in starts.tolist() if first[raw[i : i + 50]] < docs[i]]


def test_water_filling():
    assert mixing.water_fill([10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    got = mixing.water_fill([1, 100, 100], [5, 2, 1], 3)
    assert got[0] == 3 and abs(sum(got) - 201) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert mixing.water_fill([0, 0], [5, 2], 3) == [0, 0] and mixing.water_fill([], [], 3) == []


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else "w " * rng.randrange(1, 60), ["hot", "b", "é", None, "tiny"][0 if i % 3 else rng.randrange(1, 4)]) for i in range(900)] + [(900, "a b", "tiny"), (None, "x y z", "b"), (None, "x", "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS size", "2 AS target", "3 AS h")
    one, two = (sorted(mixing.mix_sources(x).collect(), key=repr) for x in (d.repartition(2), d.repartition(5)))
    assert one == two and len(one) == len(rows)
    by = {}
    for r in one:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    names = sorted((s for s in by if s is not None)) + [None]
    want = mixing.water_fill([sum(r["size"] for r in by[s]) for s in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3)
    for s, target in zip(names, want, strict=True):
        assert abs(by[s][0]["target"] - target) < 1e-6 and abs(sum(r["taken"] for r in by[s]) - target) <= max(r["size"] for r in by[s])
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_many_sources_are_levelled_by_aggregates(spark, monkeypatch):
    rng = random.Random(6)
    held = {f"s{i:03d}" if i else None: rng.choice([0, 1, 5, 40, 3000]) for i in range(120)}
    names = [*sorted(s for s in held if s is not None), None]
    want = mixing.water_fill([held[s] for s in names], [[5, 2, 1][i % 3] for i in range(len(names))], 3)
    got = mixing.level_sources(spark.createDataFrame(list(held.items()), "source string, words bigint").repartition(7), (5.0, 2.0, 1.0), 3)
    got = {r["source"]: r for r in got.collect()}
    for s, target in zip(names, want, strict=True):
        assert abs(got[s]["target"] - target) < 1e-6 and got[s]["source_size"] == held[s]
        assert abs(got[s]["whole"] * held[s] + got[s]["rest"] - target) < 1e-6 and 0 <= got[s]["whole"] <= 3
    d = spark.createDataFrame([(i, "w " * rng.randrange(1, 30), f"s{i % 9}") for i in range(300)], "doc_id bigint, text string, source string")
    few = sorted(mixing.mix_sources(d).select("doc_id", "taken", "copies").collect())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    assert sorted(mixing.mix_sources(d).select("doc_id", "taken", "copies").collect()) == few


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
