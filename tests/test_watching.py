"""Registration, debounce and folder events as streams: restarts, and the rows of their batch forms."""

import os
import random
import time

import pytest

from quillspark.operators import registry
from quillspark.streaming import registration, watching

ARRIVAL = "seq bigint, filename string, checksum string, session_id string"


def run(df, folder, schema=None):
    """Process what there is into a table, and give all its rows."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return [r.asDict() for r in df.sparkSession.read.parquet(f"{folder}/out").collect()]


def by_seq(rows):
    return sorted((r["seq"], r["filename"], r["checksum"], r["session_id"], r["outcome"], r["version"]) for r in rows) if rows else []


@pytest.mark.parametrize("held", [False, True])
def test_registration_does_not_depend_on_batches(spark, tmp_path, held):
    rng = random.Random(8)
    # What the registry held before counts as the first arrivals of the plain form.
    before = [(k, f"f{k % 3}", f"old{k}", None) for k in range(4)] if held else []
    rows = [(k, f"f{rng.randrange(4)}", f"{rng.choice(['old', 'x'])}{rng.randrange(9)}", rng.choice([None, None, "s1", ""])) for k in range(10, 60)]
    want = by_seq(r.asDict() for r in registry.register(spark.createDataFrame(before + rows, ARRIVAL)).collect() if r["seq"] >= 10)
    known = spark.createDataFrame([(f, c, 1 + (k > 2), None) for k, f, c, _ in before], "filename string, checksum string, version int, session_id string") if held else None
    got = []
    for part in (rows[:3], rows[3:4], rows[4:30], rows[30:]):  # the query is stopped and started again between batches
        spark.createDataFrame(part, ARRIVAL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(registration.register_stream(spark.readStream.schema(ARRIVAL).parquet(f"{tmp_path}/in"), known), tmp_path)
    assert len(got) == len(rows) and set(by_seq(got)) == set(want)


def test_folder_events_survive_a_restart(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    seen = 0

    def step():
        nonlocal seen
        rows = run(watching.folder_events(spark, f"file://{box}"), tmp_path)
        new, seen = len(rows) - seen, len(rows)
        return sorted([(r["kind"], r["path"], r["moved_to"]) for r in rows], key=repr), new

    for name, text in (("a.pdf", "one"), ("b.PDF", "three"), ("c.txt", "no")):
        (box / name).write_text(text)
        os.utime(box / name, (1, len(text)))
    all_rows, new = step()
    assert new == 2 and all_rows == [("created", "a.pdf", None), ("created", "b.PDF", None)]
    assert step()[1] == 0
    # While nothing runs: a change, a move, an arrival; then a deletion.
    (box / "a.pdf").write_text("changed")
    (box / "b.PDF").rename(box / "moved.pdf")
    (box / "new.pdf").write_text("new one")
    all_rows, new = step()
    assert new == 3 and {("modified", "a.pdf", None), ("moved", "b.PDF", "moved.pdf"), ("created", "new.pdf", None)} <= set(all_rows)
    (box / "a.pdf").unlink()
    all_rows, new = step()
    assert new == 1 and ("deleted", "a.pdf", None) in all_rows


def test_listing_changes_and_removals(spark):
    before = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4), ("e", 4, 4), ("k", 9, 9)], "path string, size int, modified int")
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("x", 3, 3), ("y", 4, 4), ("n", 5, 5), ("k", 9, 9)], "path string, size int, modified int")
    got = sorted((r["kind"], r["path"], r["moved_to"] or "") for r in watching.listing_changes(before, after).collect())
    assert got == [("created", "n", ""), ("created", "y", ""), ("deleted", "d", ""), ("deleted", "e", ""), ("modified", "b", ""), ("moved", "c", "x")]
    assert watching.listing_changes(before, before).count() == 0
    docs = [("1", "one.pdf", 1, None, "archive/one.v1.pdf"), ("2", "two.pdf", 1, None, None), ("3", "three.pdf", 1, None, None), ("4", "four.pdf", 1, "s", None)]
    reg = spark.createDataFrame(docs, "document_id string, filename string, version int, session_id string, archive_path string")
    events = [("moved", "in/one.pdf", "inbox", "one.pdf"), ("deleted", "in/two.pdf", "inbox", "two.pdf"), ("deleted", "in/three.pdf", "inbox", "three.pdf"), ("created", "in/x.pdf", "inbox", "x.pdf"), ("deleted", "in/four.pdf", "inbox", "four.pdf")]
    listing = spark.createDataFrame([("archive", "one.v1.pdf"), ("inbox", "three.pdf")], "folder string, name string")
    got = watching.removed_documents(spark.createDataFrame(events, "kind string, path string, folder string, name string"), reg, listing)
    assert [r["document_id"] for r in got.collect()] == ["2"]


def test_a_file_that_grows_while_it_is_read_is_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    marks = str(tmp_path)

    def probe(path):
        if path == "gone":
            raise FileNotFoundError(path)
        if path == "locked" and not os.path.exists(f"{marks}/unlocked"):
            open(f"{marks}/unlocked", "w").close()
            raise PermissionError(path)
        return os.path.getsize(f"{marks}/grows"), 0

    def digest(path):
        if path == "grows" and os.path.getsize(f"{marks}/grows") < 2:
            with open(f"{marks}/grows", "a") as f:
                f.write("x")
        return f"sum {os.path.getsize(f'{marks}/grows')}"

    open(f"{marks}/grows", "w").close()
    source = spark.readStream.schema("path string").json(f"{marks}/in")
    q = watching.settled(source, probe, digest, 300).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{marks}/at").trigger(processingTime="200 milliseconds").start()
    try:
        spark.createDataFrame([("grows",), ("grows",), ("gone",), ("locked",)], "path string").coalesce(1).write.mode("append").json(f"{marks}/in")
        end = time.time() + 90
        while spark.table("settled").count() < 2 and time.time() < end:
            time.sleep(0.5)
            assert q.exception() is None
    finally:
        q.stop()
    got = {r["path"]: (r["size"], r["checksum"], r["events"]) for r in spark.table("settled").collect()}
    assert got == {"grows": (2, "sum 2", 2), "locked": (got["locked"][0], got["locked"][1], 1)} and spark.table("settled").count() == 2


def test_suffixes_in_either_case(spark):
    rows = spark.createDataFrame([("x/a.PDF",), ("b.pdf",), ("c.pdf.txt",), ("pdf",)], "path string")
    assert [r[0] for r in rows.where(watching.supported(rows["path"])).collect()] == ["x/a.PDF", "b.pdf"]
