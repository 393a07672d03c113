"""The divergence rules beside their SQL, which counts references and distances by words and characters, not by hashes and bytes."""

import os
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.llm import bpe, langid, packing, ppm, quality
from loomery.llm.queries import ORACLE_SQL, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def both(spark, folder):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if os.path.isfile(f'{folder}/documents.parquet') else '/*.parquet'}'")
    got = QUERIES["op4_divergence_rules"](spark, folder)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['op4_divergence_rules']})").fetchall()
    rows = got.collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    return {r["doc_id"]: r for r in rows}


def made():
    r = random.Random(4)
    en, fr = "river stone light walks under green sky the of and".split(), "le la des été où maïs être rivière pierre verte".split()
    text = lambda pool, n: " ".join(r.choice(pool) for _ in range(n))
    rows = [(k, text(en, 90), "en") for k in range(40)] + [(100 + k, text(fr, 80), "fr") for k in range(30)]
    rows += [(200, None, "en"), (201, "", None), (202, "a b", "en"), (203, text(en, 120), None), (204, "xq " * 60 + "zz# " * 20, "en"), (205, " ".join(f"{k}{k * 7}%% $" for k in range(90)), "xx")]
    rows += [(206, "\n".join(["same line here", "", " \t", "same line here", "oth\x7fer É!"] * 6), "fr"), (207, text(en + fr, 300), "en"), (208, text(en, 49) + "\x0b\x1f\x00", "en"), (0, rows[0][1], "en"), (None, text(fr, 60), "fr")]
    return rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_quality_equals_sql(spark):
    assert any(r["kept"] for r in both(spark, SF).values())


def test_quality_equals_sql_at_the_edges(spark, tmp_path):
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = both(spark, str(tmp_path))
    assert not got[204]["kept"] and not got[200]["kept"] and got[205]["nearest_lang"] == "xx" and got[203]["nearest_lang"] == "en"


def test_quality_without_references(spark, tmp_path):
    spark.createDataFrame([(k, t, None) for k, t, _ in made()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = both(spark, str(tmp_path))
    assert all(r["kept"] != r["base_failed"] and r["nearest_lang"] is None for r in got.values())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.fit(empty) == [] and quality.judge(empty, []).count() == 0


def test_columns_that_differ_in_case_give_way(spark):
    d = spark.createDataFrame(made()[:45], SCHEMA).withColumn("Kept", F.lit("x")).withColumn("Score", F.lit("x")).withColumn("IDS", F.lit("x"))
    assert quality.judge(d, quality.fit(d)).where("kept").count() > 0
    out = bpe.encode(d, vocabulary("word_bpe_49k.json"))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == 45
    assert langid.predict(d, langid.fit(d)).where("score >= 0").count() == 45


def test_repeats_are_dealt_to_all_groups(spark):
    d = spark.createDataFrame([(1, "the same text")] * 2000, "doc_id long, text string")
    sizes = Counter()
    for r in ppm.dealt(d, F.lit(False), 4, "text", "doc_id").collect():
        sizes[r["g"]] += ppm.opened(pa.table({"blob": [bytes(r["blob"])]})).num_rows
    assert sum(sizes.values()) == 2000 and len(sizes) == 4 and max(sizes.values()) < 700


def test_packing_of_two_texts_of_one_id_and_length(spark):
    rows = [(1, "one two three"), (1, "two one three"), (1, "three two one")] * 20
    t = packing.encoded(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json"))
    first, again = (packing.pack(t.repartition(n), digests=True).collect() for n in (1, 7))
    assert sorted(first) == sorted(again) and len({r["ids_crc32"] for r in first}) == 3
