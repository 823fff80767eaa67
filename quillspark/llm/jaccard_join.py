"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

1. Every text becomes its sorted set of 64-bit shingle hashes; equal sets are one class.
2. Two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each, in any one
   order of all shingles; the order is by estimated frequency, so common shingles come last. Sets
   that share such a shingle and lie in neighbouring size bands form a tile.
3. Within a tile, bitmaps bound the overlap from above: a bitmap toggles one bit per shingle, so two
   bitmaps differ in no more bits than the sets differ in shingles. Pairs that can still reach the
   threshold hold together a super-tile.
4. Within a super-tile all pairs are decided by exact intersection of the arrays, in blocks.

Links come from step 4 alone; steps 2 and 3 never lose one. No step keeps pairs: tiles leave as
trees, super-tiles as trees and counts.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fmix, materialize, shingle_sets, tune

#: Buckets of the frequency estimate, and groups in which it is added up. Broadcast size: 2**20 bytes.
FREQ_BITS, FREQ_GROUPS = 20, 64
#: Shingles or tokens that a task holds before it writes them out.
FLUSH = 1 << 20
#: Prefix entries of one bucket; the number of buckets follows from the data.
BUCKET_ENTRIES = 1 << 19
#: Estimated sets with a token above which its tile is dealt to several buckets.
HOT_TOKEN = 1 << 18
#: Sets of a tile compared in one piece; a larger tile is compared in pairs of pieces.
TILE = 1024
#: The same for super-tiles: from the first number of sets, grown up to the second with the tile.
BLOCK_MIN, BLOCK_MAX, BLOCK_SHARE = 64, 1024, 32
#: Most large tiles or super-tiles that are broadcast (12 bytes each); beyond it their rows are dealt by so many salts.
BROADCAST_KEYS, SALTS = 50_000, 64


def set_key(s: np.ndarray, salt: int) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16, salt=struct.pack("<Q", salt)).digest()


def bitmap(s: np.ndarray) -> np.ndarray:
    """A power of two of bits, at least as many as shingles; each shingle toggles one."""
    bits = max(256, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width: neighbouring bits fall together."""
    while len(b) > size:
        bits = np.unpackbits(b)
        b = np.packbits(bits[0::2] ^ bits[1::2])
    return b


def band(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Size band; sets whose sizes differ by the factor den / num at most are in the same or in neighbouring bands."""
    return np.floor(np.log(n) / math.log(den / num) + 1e-9).astype(np.int64)


def _blobs(bucket: np.ndarray, *arrays: np.ndarray):
    """One row per bucket: the bucket and the bytes of each array's part."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    arrays = [a[order] for a in arrays]
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True):
        if hi > lo:
            yield (int(b[lo]), *(a[lo:hi].tobytes() for a in arrays))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), kind)


def tile_tree(ids: np.ndarray, sizes: np.ndarray, maps: list[bytes], num: int, den: int):
    """(id, smallest id) of the sets of one tile that pairs within the bound hold together."""
    m = len(ids)
    width = min(map(len, maps))
    bits = np.stack([fold(np.frombuffer(x, np.uint8), width) for x in maps])
    bits = np.ascontiguousarray(bits).view(np.uint64)
    label = np.arange(m)
    for a in range(m - 1):
        differ = np.bitwise_count(bits[a] ^ bits[a + 1 :]).sum(1, dtype=np.int64)
        both = sizes[a] + sizes[a + 1 :]
        most = np.minimum((both - differ) // 2, np.minimum(sizes[a], sizes[a + 1 :]))
        near = label[a + 1 :][den * most >= num * (both - most)]
        if len(near) and (near != label[a]).any():
            of = np.isin(label, np.append(near, label[a]))
            label[of] = label[of].min()
            if not label.any():
                break
    for root in np.unique(label).tolist():
        of = ids[label == root]
        if len(of) > 1:
            low = int(of.min())
            yield from ((low, int(x)) for x in of.tolist() if x != low)


def exact_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int):
    """(i, js) of the pairs at or above the threshold: of left with right, or within left.

    The hashes are coded by their places in the sorted union of all arrays; an array's intersections
    with all others are then sums over a mask."""
    every = left if right is None else [*left, *right]
    lens = np.array([len(x) for x in every], np.int64)
    codes = np.unique(np.concatenate(every), return_inverse=True)[1]
    starts = np.zeros(len(every) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    mask = np.zeros(int(codes.max()) + 1, np.int32)
    for i in range(len(left)):
        lo = i + 1 if right is None else len(left)
        if lo >= len(every):
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mask[mine] = 1
        inter = np.add.reduceat(mask[codes[starts[lo] :]], starts[lo:-1] - starts[lo])
        mask[mine] = 0
        js = np.flatnonzero(den * inter >= num * (lens[i] + lens[lo:] - inter))
        if len(js):
            yield i, js + lo


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row.

    Two rows link when den * intersection >= num * union of their sets of distinct k-word shingles
    (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer than k words are one shingle). n_links
    counts the other rows a row links with, rows with the same set included. component_id is the
    smallest id reachable by links, the row's own included. A null, empty or blank text has an empty
    set, links with nothing and is its own component. Null ids take part but are no component_id
    unless all ids of a component are null; rows that repeat an id are rows of their own. An empty
    table gives an empty table; other columns are ignored.

    Shingles are compared as 64-bit hashes (a chance of 1e-9 of one false equality within 1e5 pairs
    of 1000 shingles); sets are identified by 128 bits."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))

    # ------------------------------------------------ sets, classes and the frequency estimate
    for salt in range(4):
        rows = materialize(docs.mapInArrow(lambda b, salt=salt: _sets(b, k, salt), "doc_id bigint, n int, key binary, map binary, grp int, at binary, cnt binary"), "sets")
        sets = rows.where("grp is null")
        classes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("map").alias("map"))
        classes = materialize(classes.withColumn("uid", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("bigint")), "classes")
        count = classes.agg(F.count("*").alias("c"), F.countDistinct("uid").alias("u"), F.sum("n").alias("n")).first()
        if count["c"] == count["u"]:
            break  # no two classes share their 64-bit name
    else:
        raise RuntimeError("classes share their 64-bit names under every salt")
    total = int(count["n"] or 0)

    freq = np.zeros((FREQ_GROUPS, (1 << FREQ_BITS) // FREQ_GROUPS), np.uint8)
    found = rows.where("grp is not null").select("grp", "at", "cnt").groupBy("grp").applyInArrow(_add_frequencies, "grp int, level binary")
    for r in found.collect():
        freq[r["grp"]] = np.frombuffer(r["level"], np.uint8)
    levels = spark.sparkContext.broadcast(freq.ravel())

    # ------------------------------------------------ tiles
    buckets = max(128, -(-total // (4 * BUCKET_ENTRIES)))
    entry = "bucket int, token binary, uid binary, n binary"
    members = docs.mapInArrow(lambda b: _prefixes(b, k, salt, num, den, levels.value, buckets), entry).groupBy("bucket").applyInArrow(lambda t: _tiles(t, num, den, levels.value), "uid bigint, tiles array<bigint>")
    tiles = materialize(members.select("uid", F.explode("tiles").alias("tile")).distinct(), "tiles")
    members = tiles  # the plan that made them is dropped, and its shuffle files with it

    # ------------------------------------------------ bitmaps: plausible pairs hold super-tiles together
    large = members.groupBy("tile").count().where(F.col("count") > TILE).select("tile", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    pieces = _pieces(_with_parts(members, "tile", large), "tile", members)
    pieces = pieces.join(classes.select("uid", "n", "map"), "uid")
    groups = max(128, total >> 20)
    plain = pieces.withColumn("g", F.pmod("piece", F.lit(groups)).cast("int"))
    edges = plain.select("g", "piece", "uid", "n", "map").groupBy("g").applyInArrow(lambda t: _trees(t, num, den), "a bigint, b bigint")
    roots = materialize(connected_components(edges, tag="plausible"), "plausible")

    # ------------------------------------------------ exact intersections within super-tiles
    inside = roots.join(classes.select(F.col("uid").alias("node"), "first_id", "copies", "key"), "node")
    texts = docs.join(inside.where("first_id is not null"), F.col("doc_id") == F.col("first_id"))
    orphans = inside.where("first_id is null")
    if not orphans.isEmpty():  # classes of null ids only: found by their key
        named = docs.where("doc_id is null")
        keyed = named.mapInArrow(lambda b: _keys(b, k, salt), "key binary, t string").dropDuplicates(["key"])
        texts = texts.select("t", "node", "root", "copies", "key").unionByName(keyed.join(orphans, "key").select("t", "node", "root", "copies", "key"))
    texts = texts.select("t", "node", "root", "copies", "key").mapInArrow(lambda b: _arrays(b, k, salt), "uid bigint, root bigint, copies bigint, arr binary")
    arrays = materialize(texts.dropDuplicates(["uid"]), "arrays")
    del texts
    tall = arrays.groupBy("root").count().where(F.col("count") > BLOCK_MIN)
    size = F.least(F.greatest(F.ceil(F.col("count") / BLOCK_SHARE), F.lit(BLOCK_MIN)), F.lit(BLOCK_MAX))
    tall = tall.select("root", F.ceil(F.col("count") / size).cast("int").alias("parts"))
    blocks = _pieces(_with_parts(arrays, "root", tall), "root", arrays).withColumn("g", F.pmod("piece", F.lit(8 * groups)).cast("int"))
    linked = blocks.select("g", "piece", "side", "pair", "uid", "copies", "arr").groupBy("g").applyInArrow(lambda t: _links(t, num, den), "a bigint, b bigint, uid bigint, links bigint")
    linked = materialize(linked, "links")

    # ------------------------------------------------ answers
    trees = connected_components(linked.where("a is not null").select("a", "b"), tag="links")
    links = linked.where("uid is not null").groupBy("uid").agg(F.sum("links").alias("links"))
    named = classes.select("key", "uid", "first_id", "copies").join(trees.withColumnRenamed("node", "uid"), "uid", "left").join(links, "uid", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "uid")), "named")
    lows = named.groupBy("root").agg(F.min("first_id").alias("low"))
    named = named.join(lows, "root").select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = sets.where("n > 0").select("doc_id", "n", "key").join(named, "key").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("low").alias("component_id"), F.col("links").alias("n_links"))
    none = sets.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(none)


def _with_parts(rows: DataFrame, key: str, large: DataFrame) -> DataFrame:
    """``rows`` with the number of ``parts`` of their key, null for keys that aren't large.

    No task gathers the rows of one key: the large keys are counted and broadcast, and where they are
    too many for that, rows are salted and each key is repeated for every salt."""
    large = materialize(large, "large")
    if large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(large), key, "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    keys = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(keys, [key, "salt"], "left").drop("salt")


def _pieces(rows: DataFrame, key: str, like: DataFrame) -> DataFrame:
    """Deal the rows of a large key, which has a number of ``parts``, to all pairs of parts.

    Adds ``piece`` (a hash that names the pair), ``side`` (which part of it the row is in) and
    ``pair`` (whether the two parts differ). Rows of other keys have one piece."""
    mine = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.withColumn("piece", F.xxhash64(key, lo, hi)).withColumn("side", (F.col("mine") > F.col("other")).cast("int")).withColumn("pair", F.col("mine") != F.col("other"))
    return rows.select(*like.columns, "piece", "side", "pair")


def _sets(batches, k: int, salt: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.binary()), ("map", pa.binary()), ("grp", pa.int32()), ("at", pa.binary()), ("cnt", pa.binary())])
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    size = 0

    def flush():
        at, cnt = np.unique(np.concatenate(held) >> np.uint64(64 - FREQ_BITS), return_counts=True)
        keep = cnt > 1  # shingles that a task meets once say nothing
        at, cnt = at[keep].astype(np.int32), cnt[keep].astype(np.int32)
        span = (1 << FREQ_BITS) // FREQ_GROUPS
        return [(None, None, None, None, g, a, c) for g, a, c in _blobs(at // span, at % span, cnt)]

    for b in batches:
        out = []
        for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), k), strict=True):
            key, bits = b"", None
            if len(s):
                key = set_key(s, salt)
                if key not in seen:
                    seen.add(key)
                    bits = bitmap(s).tobytes()
                    held.append(s)
                    size += len(s)
            out.append((i, len(s), key, bits, None, None, None))
        if size > 4 * FLUSH:
            out += flush()
            held, size = [], 0
        yield _batch(out, schema)
    if held:
        yield _batch(flush(), schema)


def _add_frequencies(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << FREQ_BITS) // FREQ_GROUPS, np.int64)
    for at, cnt in zip(table.column("at").to_pylist(), table.column("cnt").to_pylist(), strict=True):
        np.add.at(total, np.frombuffer(at, np.int32), np.frombuffer(cnt, np.int32))
    level = np.ceil(np.log2(total + 1)).astype(np.uint8)
    return pa.table({"grp": pa.array([table.column("grp")[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})


def _prefixes(batches, k: int, salt: int, num: int, den: int, levels: np.ndarray, buckets: int):
    """Each distinct set's first shingles in the common order, as blobs by bucket. A token is the
    estimated frequency's level followed by 56 bits of the hash."""
    schema = pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("uid", pa.binary()), ("n", pa.binary())])
    seen: set[bytes] = set()
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def flush():
        token = np.concatenate([x[0] for x in held])
        lens = [len(x[0]) for x in held]
        uid = np.repeat(np.array([x[1] for x in held], np.int64), lens)
        n = np.repeat(np.array([x[2] for x in held], np.int32), lens)
        spread = (np.uint64(1) << (token >> np.uint64(56))) // np.uint64(HOT_TOKEN)
        salted = fmix(uid.view(np.uint64)) % np.maximum(spread, np.uint64(1))
        bucket = ((fmix(token) + salted) % np.uint64(buckets)).astype(np.int32)
        rows = list(_blobs(bucket, token, uid, n))
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256], schema)

    for b in batches:
        for s in shingle_sets(b.column(1), k):
            if not len(s):
                continue
            key = set_key(s, salt)
            if key in seen:
                continue
            seen.add(key)
            p = len(s) - -(-num * len(s) // den) + 1
            token = levels[s >> np.uint64(64 - FREQ_BITS)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
            held.append((np.partition(token, p - 1)[:p], struct.unpack(">q", key[:8])[0], len(s)))
            size += p
        if size > FLUSH:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _tiles(table: pa.Table, num: int, den: int, levels: np.ndarray) -> pa.Table:
    """The tiles of a bucket with two sets or more. A tile is named by its members, so that the many
    tokens that two near copies share give one tile and not as many."""
    token, uid, n = _joined(table, "token", np.uint64), _joined(table, "uid", np.int64), _joined(table, "n", np.int32)
    order = np.lexsort((uid, token))
    token, uid, n = token[order], uid[order], n[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (uid[1:] != uid[:-1])
    token, uid, n = token[keep], uid[keep], n[keep]
    hot = (token >> np.uint64(56)) > np.uint64(HOT_TOKEN.bit_length() - 1)  # other buckets have members too
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    shared |= hot
    token, uid, n, hot = token[shared], uid[shared], n[shared], hot[shared]
    level = band(n, num, den)
    # A set is in the tile of its band and in the one that the band below shares with it.
    token, uid, hot = np.tile(token, 2), np.tile(uid, 2), np.tile(hot, 2)
    level = np.concatenate([level, level - 1])
    tile = fmix(token + fmix(level.view(np.uint64) + np.uint64(77)))
    order = np.lexsort((uid, tile))
    tile, uid, hot = tile[order], uid[order], hot[order]
    first = np.ones(len(tile), bool)
    first[1:] = tile[1:] != tile[:-1]
    starts = np.flatnonzero(first)
    if len(starts):
        lens = np.diff(np.append(starts, len(tile)))
        members = np.add.reduceat(fmix(uid.view(np.uint64) + np.uint64(99)), starts)
        name = np.where(hot[starts], tile[starts], fmix(members))
        keep = np.repeat((lens > 1) | hot[starts], lens)
        tile, uid = np.repeat(name, lens)[keep], uid[keep]
        order = np.lexsort((tile, uid))
        tile, uid = tile[order], uid[order]
    ids, at = np.unique(uid, return_index=True)
    offs = pa.array(np.append(at, len(uid)).astype(np.int32))
    return pa.table({"uid": pa.array(ids, pa.int64()), "tiles": pa.ListArray.from_arrays(offs, pa.array(tile.view(np.int64), pa.int64()))})


def _runs(table: pa.Table):
    """(row numbers) of each piece in a group of pieces."""
    piece = table.column("piece").to_numpy()
    order = np.argsort(piece, kind="stable")
    cut = np.flatnonzero(np.diff(piece[order])) + 1
    return [x for x in np.split(order, cut) if len(x) > 1]


def _trees(table: pa.Table, num: int, den: int) -> pa.Table:
    ids, sizes, maps = table.column("uid").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("map").to_pylist()
    found = {e for of in _runs(table) for e in tile_tree(ids[of], sizes[of], [maps[i] for i in of.tolist()], num, den)}
    return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})


def _keys(batches, k: int, salt: int):
    for b in batches:
        yield pa.record_batch([pa.array([set_key(s, salt) if len(s) else b"" for s in shingle_sets(b.column(1), k)], pa.binary()), b.column(1)], names=["key", "t"])


def _arrays(batches, k: int, salt: int):
    """The shingle arrays of the texts that belong to their key (rows that repeat an id may not)."""
    for b in batches:
        sets, keys = list(shingle_sets(b.column(0), k)), b.column(4).to_pylist()
        keep = pa.array([set_key(s, salt) == key for s, key in zip(sets, keys, strict=True)], pa.bool_())
        out = pa.record_batch([b.column(1), b.column(2), b.column(3), pa.array([s.tobytes() for s in sets], pa.binary())], names=["uid", "root", "copies", "arr"])
        yield out.filter(keep)


def _links(table: pa.Table, num: int, den: int) -> pa.Table:
    """A forest (a, b) of the links of each piece, and how many rows each set links with (uid, links)."""
    ids, copies, side = table.column("uid").to_numpy(), table.column("copies").to_numpy(), table.column("side").to_numpy()
    pair, arrs = table.column("pair").to_pylist(), table.column("arr").to_pylist()
    a, b, uids, links = [], [], [], []
    for of in _runs(table):
        if pair[of[0]]:
            of = of[np.argsort(side[of], kind="stable")]
        sets = [np.frombuffer(arrs[i], np.uint64) for i in of.tolist()]
        cut = int((side[of] == 0).sum()) if pair[of[0]] else len(of)
        count, weight = np.zeros(len(of), np.int64), copies[of]
        up = list(range(len(of)))

        def top(x: int, up=up) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        if cut == 0 or pair[of[0]] and cut == len(of):
            continue
        for i, js in exact_links(sets[:cut], sets[cut:] if pair[of[0]] else None, num, den):
            count[i] += weight[js].sum()
            count[js] += weight[i]
            for j in js.tolist():
                x, y = top(i), top(j)
                if x != y:
                    up[y] = x
                    a.append(int(ids[of[i]]))
                    b.append(int(ids[of[j]]))
        hit = np.flatnonzero(count)
        uids += ids[of[hit]].tolist()
        links += count[hit].tolist()
    none, rest = [None] * len(uids), [None] * len(a)
    return pa.table({"a": pa.array(a + none, pa.int64()), "b": pa.array(b + none, pa.int64()), "uid": pa.array(rest + uids, pa.int64()), "links": pa.array(rest + links, pa.int64())})
