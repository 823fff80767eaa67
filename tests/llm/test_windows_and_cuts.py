"""Rolling windows, trie encoding and fill-in-the-middle, against plain versions."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspark.llm import fill_middle, queries, rolling, trie_bpe  # noqa: E402

DIR = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_rolling_windows", "op13_fill_middle"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    res = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)


# --------------------------------------------------------------------------- windows

EVENTS = "doc_id bigint, source string, lang string, event_s bigint, length bigint, chunk string, t string"


def plain_windows(rows, windows, percents):
    out = []
    for r in rows:
        for w in windows:
            mine = [x for x in rows if x[1] == r[1] and r[3] is not None and x[3] is not None and r[3] - w <= x[3] < r[3]]
            v = sorted(x[4] for x in mine if x[4] is not None)
            out.append((r[0], r[1], r[3], w, len(mine), sum(v), len({x[2] for x in mine} - {None}), *(v[-(-p * len(v) // 100) - 1] if v else None for p in percents)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [None, 50, 1000])
def test_windows_equal_the_plain_version(spark, chunk):
    rng = random.Random(7)
    rows = [(rng.choice([None, i, i]), rng.choice(["hot", "hot", "b", None]), rng.choice(["de", "en", None, "fr"]), rng.choice([None, *range(-300, 700, 7)] if i % 9 else [60]), rng.choice([None, 0, 5, 5, rng.randrange(1000)]), "x", "y") for i in range(400)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    for windows, percents in (((60, 210), (50, 75)), ((1,), (1, 100))):
        got = rolling.rolling_features(df, windows, percents, chunk=chunk)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_windows(rows, windows, percents)


def test_windows_of_empty_and_timeless_tables(spark):
    assert rolling.rolling_features(spark.createDataFrame([], EVENTS)).count() == 0
    got = rolling.rolling_features(spark.createDataFrame([(1, None, None, None, None, "", ""), (2, "a", None, 0, None, "", "")], EVENTS))
    assert {(r["id"], r["n_events"], r["total"], r["n_kinds"], r["p50"]) for r in got.collect()} == {(1, 0, 0, 0, None), (2, 0, 0, 0, None)} and got.count() == 4


# --------------------------------------------------------------------------- tokens

ODD = [None, "", " ", "\t\n \x0b", "a", "a" * 3000, "aaaaaaaa " * 200, "\x1c\x1d x\x85y​", "½ ² ⅷ ٣", "日本語 é 🙂", "it's WE'LL 'S", "ΑΣ Σ İ ẞ Å ﬁ ꟎ \U0003fc36", "é É", "<|endoftext|>", "a<|endoftext|> <|startoftext|><|endoftext|>b"]


def table(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS ids", "1 AS n", "'plain' AS form", "doc_id AS digest", "'z' AS output")


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_tokens_equal_the_library(spark, path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    rng = random.Random(11)
    texts = [*ODD, "".join(rng.choice("etaoinshr") for _ in range(5000))]
    texts += ["".join(rng.choice("ab éß0 1'\n.,#ñ漢ΣİǺ½🙂s't") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(150)]
    got = trie_bpe.decode(trie_bpe.encode(table(spark, texts), path), path).collect()
    for r, text in zip(sorted(got), texts, strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert (r["ids"], r["text"]) == (want, lib.decode(want, skip_special_tokens=False)), text
    assert trie_bpe.encode(table(spark, []), path).count() == 0
    assert trie_bpe.encode(table(spark, ["a", "a"], [None, None]), path).count() == 2
    assert trie_bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), path).first()["text"] == ""


def test_words_share_the_nodes_of_their_prefixes():
    model = trie_bpe.TrieBpe(WORDS)
    words = ["internation", "international", "internationally", "internationals"]
    first = model.encode_batch(words)
    # "internatio" once; then n + end, n, a, l + end, l, l, y + end, s + end.
    assert model.nodes == 10 + 8
    assert model.encode_batch(words) == first and model.nodes == 18
    kept, trie_bpe.WORDS = trie_bpe.WORDS, 2
    try:  # what was met before comes from the older half, what was not is forgotten
        assert model.encode_batch([*words[:2], "other"])[:2] == first[:2] and set(model.memo) == {*words[:2], "other"} and model.nodes == 18 + 5
        assert model.encode_batch(words) == first and model.nodes == 18 + 5 + 10 + 8 - 2
    finally:
        trie_bpe.WORDS = kept


def test_text_of_bytes_comes_back(spark):
    texts = [t for t in ODD if t and "<|" not in t]
    back = trie_bpe.decode(trie_bpe.encode(table(spark, texts), BYTES), BYTES).collect()
    assert [r["text"] for r in sorted(back)] == texts


# --------------------------------------------------------------------------- fill in the middle


def units(text, unit):
    if unit == "char":
        return list(text)
    white = "\x20\t\n\x0b\x0c\r" if unit == "word" else "\n"
    out = []
    for c in text:
        begins = not out or (out[-1][-1] in white and (unit == "line" or c not in white))
        if begins:
            out.append(c)
        else:
            out[-1] += c
    return out


def plain_fim(i, text, unit, tags):
    text, (p, s, m) = text or "", tags
    u, h = units(text, unit), hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in tags) or h3 % 100 >= 90:
        return i, len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h4 % 100 < 20
    return i, len(u), "spm" if spm else "psm", len(x), len(y), s + z + p + x + m + y if spm else p + x + s + z + m + y


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("tags", [fill_middle.SENTINELS, ("[pre]", "[suf]", "[mid]")])
def test_cuts_equal_the_plain_version(spark, unit, tags):
    rng = random.Random(13)
    texts = [None, "", "x", "\n", " a", "é", "a<P>b", "a<", "S>b<S", "ab\n\ncd\n", "🙂" * 500, "long line é\n" * 3000, *("".join(rng.choice("aé漢🙂 \n<>PSM[]") for _ in range(rng.randrange(90))) for _ in range(300))]
    ids = [None, None, *range(2, len(texts))]
    df = table(spark, texts, ids)
    for chunk in (1, 7, 4096):
        got = fill_middle.fill_in_middle(df, unit, sentinels=tags, chunk=chunk).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), tags)).collect()
        assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((plain_fim(i, t, unit, tags) for i, t in zip(ids, texts, strict=True)), key=repr)
        assert sorted(r["back"] for r in got) == sorted(t or "" for t in texts)


def test_cuts_of_empty_tables_and_bad_sentinels(spark):
    assert fill_middle.fill_in_middle(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="sentinel"):
        fill_middle.fill_in_middle(table(spark, ["a"]), sentinels=("<P>", "<S>", "<M<"))
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_in_middle(table(spark, ["a"]), unit="page")
