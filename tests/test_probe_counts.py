"""Line counts of probes: a path's literals meet its texts in blocks, not pair by pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.operators import probes


def plain(asked, texts):
    return {(a, s): sum(s in line for b, text in texts if b == a for line in text.split("\n")) for a, s in asked}


@pytest.mark.parametrize("cells", [1 << 24, 0])
def test_counts_of_a_block(monkeypatch, cells):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abä\0 \n語") for _ in range(n))
    asked = sorted({(rng.choice("xyz"), word(rng.randint(1, 5))) for _ in range(300)} | {("x", "aaaa"), ("x", "a\nb"), ("none", "a"), ("x", "ab" * 40)})
    texts = [(rng.choice("xyzw"), word(rng.randint(0, 400))) for _ in range(60)] + [("x", "aaaaaa\naaaa\n" + "ab" * 50), ("x", "")]
    monkeypatch.setattr(probes, "TABLE_CELLS", cells)
    monkeypatch.setattr(probes, "PIECE_BYTES", 300)
    table = lambda rows, names: pa.table([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=names)
    got = probes._count_lines(table(asked, ["a0", "a1"]), table(texts, ["a0", "text"]))
    assert {(r["a0"], r["a1"]): r["n"] for r in got.to_pylist()} == plain(asked, texts)
    assert probes._count_lines(table(asked, ["a0", "a1"]), table([], ["a0", "text"])).num_rows == len(asked)
    assert probes._count_lines(table([], ["a0", "a1"]), table(texts, ["a0", "text"])).num_rows == 0


def test_counts_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(probes, "BLOCK_BYTES", 100)
    monkeypatch.setattr(probes, "BLOCK_LITERALS", 3)
    files = [(f"/f{k % 2}/{k}", f"w{k} w{k % 7}\nw{k % 5}") for k in range(40)] + [("/f0/0", "w0"), ("/f1/1", None)]
    asked = [(f, f"w{k}") for f in ("/f0", "/f1", "/", "/f0/0", "/gone") for k in range(12)]
    rows = spark.createDataFrame(files, "path string, text string")
    below = rows.select("path").distinct().select("path", F.explode(probes._above(F.col("path"))).alias("key"))
    got = probes._line_counts(spark.createDataFrame(asked, "a0 string, a1 string"), below, rows).collect()
    under = [(a, text or "") for path, text in files for a in ("/", path.rsplit("/", 1)[0], path)]
    assert len(got) == 48 and {(r["a0"], r["a1"]): r["n"] for r in got} == plain([x for x in asked if x[0] != "/gone"], under)


def test_a_path_that_comes_twice_counts_twice(spark):
    files = spark.createDataFrame([("/a/x", "one"), ("/a/x", "one\none")], "path string, text string")
    docs = spark.createDataFrame([("c", 1, "n", "grep_count /a :: one", "3", None)], "corpus string, doc_ord long, name string, probe string, probe_expected string, valid_until timestamp")
    none = "repo string, ref string, sha string, peeled string", "repo string, sha string, at timestamp, on_mainline boolean"
    rows = probes.sweep(docs, files, *[spark.createDataFrame([], s) for s in none], F.lit("2024-07-01").cast("timestamp")).collect()
    assert [(r["verdict"], r["actual"]) for r in rows] == [("FRESH", "3")]
