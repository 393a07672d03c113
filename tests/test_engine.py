from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomery import api
from loomery.operators import capture, commits, keyword, querylog, ranking, state, structure, upkeep
from loomery.sources import readers, writers

NOW = datetime(2024, 7, 1)
TEXTS = {
    "hub-log": "The freehub service used two pawls and light grease. See [[wheel-notes]].",
    "grease-pawls": "Light grease belongs on the pawls, never on the bearing seals.",
    "grease-bearing": "Thick grease belongs on the bearing, never on the pawls.",
    "wheel-notes": "Spokes were laced three cross and tension balanced by tone.",
    "kiln": "The kiln fires at twelve hundred degrees for eight hours.",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("curated", i, n, f"{n}.md", t[:40], None, None, "hot", False, NOW - timedelta(days=i), None, t) for i, (n, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "corpus string, doc_ord long, name string, file string, description string, account string, project string, tier string, in_memory_index boolean, modified timestamp, session_id string, body string").cache()


def asks(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "query_id long, query string")


def test_word_order_separates_opposite_claims(spark, docs):
    rows, verdicts = ranking.search(asks(spark, "light grease belongs on the pawls", "thick grease belongs on the bearing"), docs, NOW)
    first = {r["query_id"]: r["name"] for r in rows.where("rank = 1").collect()}
    assert first == {0: "grease-pawls", 1: "grease-bearing"}
    assert {r["confidence"] for r in verdicts.collect()} == {"unrated"}


def test_hybrid_refuses_what_is_not_there(spark, docs):
    near = docs.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("query_id"), "corpus", "doc_ord", F.lit(0.3).alias("cos"))
    rows, verdicts = ranking.search(asks(spark, "airspeed velocity unladen zebra", "light grease belongs on the pawls"), docs, NOW, semantic=near)
    by = {r["query_id"]: r for r in verdicts.collect()}
    assert by[0]["no_strong_match"] and not by[1]["no_strong_match"]
    assert {r["weak"] for r in rows.where("query_id = 1").collect()} == {False}


def test_term_stats_orphans(spark, docs):
    r = keyword.term_stats(asks(spark, "grease zeppelin greasegun"), docs).first()
    assert r["orphans"] == ["zeppelin"] and 0 < r["orphan_share"] < 1


def test_links_and_names(spark, docs):
    edges, lost = structure.link_edges(docs)
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [(0, 3)] and lost.isEmpty()
    got = structure.resolve_names(spark.createDataFrame([("HUB-log",), ("kiln.md",), ("wheelnotes",)], "asked string"), docs)
    assert {r["asked"]: r["doc_ord"] for r in got.collect()} == {"HUB-log": 0, "kiln.md": 4, "wheelnotes": 3}


def test_sections(spark):
    body = "intro\n" + "\n".join(f"## part v{k}\n" + "x" * 7000 for k in range(1, 5)) + "\n```\n## no\n```"
    d = spark.createDataFrame([("c", 1, "f", "big", "d", "hot", "memory", body)], "corpus string, doc_ord long, file string, name string, description string, tier string, type string, body string")
    out = {r["name"]: r for r in structure.section_docs(d).collect()}
    assert set(out) == {"big", "big#part-v1", "big#part-v2", "big#part-v3", "big#part-v4"}
    assert out["big"]["is_section_parent"] and out["big#part-v1"]["tier"] == "archive" and out["big#part-v4"]["tier"] == "hot"
    o = structure.outline(spark.createDataFrame([(1, "# A\ntext\n## B\nmore\n# C\n")], "doc_ord long, body string")).orderBy("ix").collect()
    assert [(r["heading"], r["chars"]) for r in o] == [("A", 19), ("B", 10), ("C", 4)]


def test_pdf_and_chapters(spark):
    pages = "\f".join(f"HEADER\nbody {k}\nmore {k}\nlines {k}\nHEADER" for k in range(5))
    t = structure.pdf_pages(spark.createDataFrame([(1, pages)], "doc_ord long, body string")).first()["text"]
    assert "HEADER" not in t and t.count("## p.") == 5
    book = "CHAPTER I\nCHAPTER II\nCHAPTER III\ntext\nCHAPTER I\nx\nCHAPTER II\ny\nCHAPTER III\nz"
    t = structure.promote_chapters(spark.createDataFrame([(1, book)], "doc_ord long, body string")).first()["text"]
    assert t.count("## CHAPTER") == 3 and t.startswith("CHAPTER I\n")


def test_front_matter(spark):
    texts = ["---\nname: a\nmetadata:\n  tier: archive\n  ts: 2024-01-01\nd: 'q'\n---\nbody", "﻿---\r\nname: b\r\n---\r\nx", "---\nname: open\nbody", "plain", "---\rname: c\r---\rx"]
    rows = [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(readers.front_matter(F.col("t")).alias("f")).collect()]
    assert rows[0]["meta"] == {"name": "a", "metadata.tier": "archive", "metadata.ts": "2024-01-01", "d": "q"} and rows[0]["rest"] == "body"
    assert rows[1]["meta"] == {"name": "b"} and rows[2]["unterminated"] and not rows[3]["has"] and not rows[4]["has"]


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: alpha\n---\n# Head\n\ntext [[b]]")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "secret.md").write_text("---\nmetadata:\n  secret: true\n---\nx")
    docs, excluded, skipped = readers.read_markdown(readers.scan(spark, str(tmp_path)), "curated")
    assert [r["name"] for r in docs.collect()] == ["alpha"] and excluded.first()["reason"] == "secret" and skipped.count() == 1
    assert readers.scan(spark, str(tmp_path / "none")).isEmpty()


def test_exchanges_and_commits(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("s", 0, "system", "sys", t0), ("s", 1, "user", "first question?", t0 + timedelta(minutes=1)), ("s", 2, "assistant", "reply", t0 + timedelta(minutes=2)), ("s", 3, "user", "<system-reminder>x", t0 + timedelta(minutes=3)), ("s", 4, "user", "second", t0 + timedelta(minutes=5))]
    ex = capture.exchanges(spark.createDataFrame(rows, "session_id string, ix long, role string, text string, ts timestamp"))
    got = ex.orderBy("n").collect()
    assert [r["ask"] for r in got] == ["first question?", "second"] and got[1]["previous"] == got[0]["name"]
    c = spark.createDataFrame([("s", f"c{k}", t0 + timedelta(minutes=k)) for k in (0, 1, 4, 6, 60)], "session_id string, sha string, at timestamp")
    pairs = {(r["exchange"], r["sha"]) for r in capture.commits_to_exchanges(ex.select("session_id", "name", "ts"), c, ["session_id"]).collect()}
    assert pairs == {(got[0]["name"], "c1"), (got[0]["name"], "c4"), (got[1]["name"], "c6")}


def test_latest_relaxes(spark, docs):
    rows, info = state.latest(asks(spark, "grease pawls", "grease zeppelin", "zzz"), docs)
    by = {r["query_id"]: r for r in info.collect()}
    assert by[0]["total_mentions"] == 3 and not by[0]["relaxed"] and by[1]["relaxed"] and by[1]["dropped_terms"] == ["zeppelin"] and by[2]["total_mentions"] == 0


def test_streak_and_retries(spark):
    t0 = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(k, t0 + timedelta(hours=k), o) for k, o in enumerate(["success", "failed", "failed"])], "seq long, at timestamp, outcome string")
    assert upkeep.failure_streak(runs).first()["streak"] == 2
    log = spark.createDataFrame([(1, t0, 1, "a b", True), (2, t0 + timedelta(seconds=170), 1, "b c", False), (3, t0 + timedelta(seconds=400), 1, "a", False)], "seq long, ts timestamp, query_id long, q string, failed boolean")
    r = querylog.retries(log, F.split("q", " "), "query_id").first()
    assert r["later_calls"] == 1 and r["recovered"]


def test_cited_commits_take_the_first_repo(spark):
    d = spark.createDataFrame([(1, "see abcdef1 and 1234567 and deadbeef99")], "doc_ord long, body string")
    c = spark.createDataFrame([("r2", 1, "abcdef1" + "0" * 33, NOW, True, ""), ("r1", 0, "abcdef1" + "f" * 33, NOW, True, "")], "repo string, repo_ord int, sha string, at timestamp, on_mainline boolean, subject string")
    assert [(r["token"], r["repo"]) for r in commits.cited(d, c).collect()] == [("abcdef1", "r1")]


def test_publish_and_contract(spark, docs, tmp_path):
    contract = {k: 1 for k in readers.CONTRACT}
    writers.publish(docs, str(tmp_path), contract)
    assert readers.read_index(spark, str(tmp_path), contract).count() == 5
    with pytest.raises(ValueError, match="dim"):
        readers.read_index(spark, str(tmp_path), contract | {"dim": 2})
    with pytest.raises(ValueError, match="vanished"):
        writers.publish(docs.limit(0), str(tmp_path), contract, previous=docs)


def test_facades(spark, docs):
    reader = api.Reader(docs, NOW)
    assert not hasattr(reader, "set_tier") and not hasattr(reader, "index")
    assert api.expand_scopes("all") == list(api.CONFIG.scopes)
    with pytest.raises(ValueError, match="did you mean curated"):
        api.expand_scopes("curatd")
    for bad in (0, 51):
        with pytest.raises(ValueError):
            reader.search(["x"], limit=bad)
    with pytest.raises(ValueError):
        reader.search(["x" * 9000])
    assert reader.get("kiln").first()["total"] == len(TEXTS["kiln"])
    assert {r["kind"] for r in reader.neighbors("wheel-notes").collect()} == {"inbound"}


def test_streamed_capture_is_batch_capture(spark, tmp_path):
    import json

    from loomery.streaming import capture as live

    t0 = datetime(2024, 1, 1)
    turns = [{"session_id": "abc", "ix": k, "role": r, "text": f"t{k}", "ts": (t0 + timedelta(minutes=k)).isoformat(), "stop_reason": "end_turn" if r == "assistant" else None} for k, r in enumerate(["user", "assistant", "user", "assistant", "user"])]
    src = tmp_path / "in"
    src.mkdir()
    for n, part in enumerate((turns[:2], turns[2:])):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        live.start(live.turns_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["ask"]: r for r in live.captured(spark, str(tmp_path / "out")).collect()}
    assert set(got) == {"t0", "t2", "t4"} and not got["t0"]["in_flight"] and got["t4"]["in_flight"] and got["t2"]["reply"] == "t3"


def test_terms_inside_of_long_runs(spark):
    """Terms are found through pieces of runs: across their borders, longer than a piece, beside other letters."""
    import random

    from loomery.operators import fresh

    r = random.Random(3)
    long = "".join(r.choice("abc.-_9") for _ in range(1500))
    texts = ["", None, "Léa said abc-def.", long, f"x {long[700:900]}é{long[:90]}", "ABCdef " * 5, "ab"]
    terms = sorted({long[i : i + k] for i in range(40, 1300, 61) for k in (3, 11, 12, 13, 64, 65, 127, 128, 200)} | {"abc", "bcd", "abc-d", "zzz", "said", "ab"})
    d = spark.createDataFrame(list(enumerate(texts)), "doc_ord long, body string")
    got = fresh.saying(spark.createDataFrame([(t,) for t in terms], "term string"), d, ["doc_ord"], "body").collect()
    want = sorted((k, t) for k, x in enumerate(texts) for t in terms if len(t) >= 3 and t in (x or "").lower())
    assert sorted((x["doc_ord"], x["term"]) for x in got) == want
