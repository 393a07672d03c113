"""The persistent index, unread files, phrasings, vectors and the bucket table, against plain computations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomery.functions import vectors
from loomery.operators import fresh, keyword, postings, ranking, structure, upkeep
from loomery.sources import buckets, shared

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 7, 1)
TEXTS = {"kiln": "kiln temperature glaze firing schedule", "pawls": "light grease on freehub pawls only", "tyre": "tubeless sealant tyre pressure", "wheel": "wheel truing spoke tension grease", "hub": "hub bearing service grease interval"}


def frame(spark, texts, corpus="curated"):
    rows = [(corpus, k, n, n, f"about {n}", t, "hot", False, T0 + timedelta(days=k), None, [f"{n} notes"]) for k, (n, t) in enumerate(sorted(texts.items()))]
    return spark.createDataFrame(rows, "corpus string, doc_ord long, name string, file string, description string, body string, tier string, in_memory_index boolean, modified timestamp, session_id string, headings array<string>")


def asks(spark, *q):
    return spark.createDataFrame(list(enumerate(q)), "query_id long, query string")


def facts(index):
    posts = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in index.postings().collect())
    return posts, sorted(map(tuple, index.document_frequency().collect())), sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in index.stats().collect())


def test_updates_equal_one_build(spark, tmp_path):
    old = {**TEXTS, "kiln": "other words here", "gone": "will be removed grease"}
    del old["tyre"]
    both = frame(spark, TEXTS).unionByName(frame(spark, {"only": "a second corpus grease"}, "library"))
    path = str(tmp_path / "grown")
    first = postings.build(frame(spark, old), path)
    grown = postings.build(both, path)
    assert {k: grown.manifest[k] for k in ("docs", "added", "changed", "removed", "vanished")}["removed"] == 1 and len(grown.segments) == 2
    assert facts(grown) == facts(postings.build(both, str(tmp_path / "once")))
    plain = keyword.prepare(asks(spark, "grease pawls"), both)
    assert sorted((r["corpus"], r["term"], r["doc_ord"], round(r["tf_title"], 6), round(r["len_body"], 6)) for r in plain.posts.collect()) == sorted((r["corpus"], r["term"], r["doc_ord"], round(r["tf_title"], 6), round(r["len_body"], 6)) for r in grown.prepare(asks(spark, "grease pawls")).posts.collect())
    assert postings.build(both, path).manifest["version"] == grown.manifest["version"]  # nothing to do
    small = postings.compact(grown)
    assert len(small.segments) == 1 and facts(small) == facts(grown) and postings.Index.open(spark, path).segments == small.segments
    assert {r["name"] for r in first.documents().collect()} == set(old)  # readers of an older version still find it
    assert {r["corpus"] for r in grown.scoped(["library"]).postings().collect()} == {"library"}


def test_builds_that_are_refused_and_failures(spark, tmp_path):
    d, path = frame(spark, TEXTS), str(tmp_path / "ix")
    assert postings.Index.open(spark, path) is None
    with pytest.raises(ValueError, match="no documents"):
        postings.build(d.limit(0), path)
    bad = d.withColumn("file", F.when(F.col("doc_ord") > 0, F.col("file")))
    one = postings.build(bad, path)
    assert one.manifest["failed"] == 1 and one.manifest["docs"] == 4
    with pytest.raises(ValueError, match="vanished"):
        postings.build(d.limit(0), path)
    with pytest.raises(ValueError, match="failed"):
        postings.build(d.withColumn("file", F.lit(None).cast("string")).unionByName(d), path)
    assert postings.Index.open(spark, path).manifest["version"] == 0
    assert postings.build(d.limit(0), path, allow_shrink=True).postings().isEmpty()
    # an interrupted build leaves a segment that no manifest names
    with pytest.MonkeyPatch.context() as m:
        m.setattr(shared, "commit_version", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            postings.build(d, path)
    assert postings.build(d, path).postings().select("doc_ord").distinct().count() == 5


def test_search_reads_the_partitions_of_its_terms(spark, tmp_path):
    d = frame(spark, TEXTS)
    index = postings.build(d, str(tmp_path / "ix"))
    q = asks(spark, "grease on pawls", "tubeless tyre", "zeppelin")
    for filters in (None, ranking.passes(before=F.lit(T0 + timedelta(days=2)))):
        want = [ranking.search(q, d, NOW, filters=filters)[k] for k in (0, 1)]
        got = [ranking.search(q, None, NOW, filters=filters, index=index)[k] for k in (0, 1)]
        for a, b in zip(want, got):
            cols = sorted(set(a.columns) & set(b.columns) - {"own_chunks"})
            key = lambda r: repr([round(v, 6) if isinstance(v, float) else v for v in r])
            assert sorted(map(key, a.select(*cols).collect())) == sorted(map(key, b.select(*cols).collect()))
    plan = index.postings(keyword.query_terms(asks(spark, "pawls")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "In(term" in plan or "EqualTo(term" in plan


def test_stale_terms_of_names_and_contents(spark):
    stale = spark.createDataFrame([("c", "release-v111.md", "nothing", 5, False), ("c", "x.md", "ships 31cab63 today", 4, False), ("c", "y.md", "31CAB63 again", 6, False), ("c", "private-31cab63.md", "31cab63", 9, True)], "corpus string, file string, body string, mtime_ms long, gated boolean")
    un = spark.createDataFrame([(1, "v111"), (1, "31cab63"), (2, "absent"), (2, "zz")], "query_id long, term string")
    got = {(r["query_id"], r["term"]): (r["in_names"], r["in_contents"], r["n_files"]) for r in fresh.stale_terms(un, stale).collect()}
    assert got == {(1, "v111"): (["release-v111.md"], [], 0), (1, "31cab63"): ([], ["y.md", "x.md"], 2)}
    assert fresh.stale_terms(un, stale.limit(0)).isEmpty()


def live_frame(spark, files):
    return frame(spark, {n: t for n, (t, *_) in files.items()}).join(spark.createDataFrame([(n, *x[1:]) for n, x in files.items()], "file string, mtime_ms long, size long, gated boolean"), "file").withColumn("modified", F.timestamp_millis("mtime_ms")).withColumn("ts", F.col("modified")).withColumn("modified_source", F.lit(None).cast("string"))


def test_direct_reads_come_first_and_gated_files_never(spark):
    from dataclasses import replace

    from loomery.config import CONFIG

    files = {"a": ("grease old", 10, 5, False), "b": ("grease new", 40, 5, False), "secret": ("grease secret", 50, 5, True), "c": ("glaze", 30, 5, False)}
    live = live_frame(spark, files)
    indexed = live.where("file = 'a'").drop("size", "gated")
    rows, info = fresh.latest(asks(spark, "grease"), indexed, live)
    assert [(r["name"], r["provenance"]) for r in rows.orderBy("rank").collect()] == [("b", "unindexed-direct"), ("a", "index")]
    i = info.first()
    assert (i["scanned"], i["merged"], i["excluded"], i["total"], i["recency_void"]) == (3, 1, 1, 3, False)
    rows, info = fresh.latest(asks(spark, "grease"), indexed, live, cfg=replace(CONFIG, unindexed_files=1))
    i = info.first()
    assert [r["name"] for r in rows.collect()] == ["a"] and i["recency_void"] and i["unread_files"] == ["b", "c"] and i["unread_count"] == 2
    _, info = fresh.direct_reads(live, indexed, replace(CONFIG, unindexed_bytes=4))  # the first file is read whatever its size
    assert info.first()["scanned"] == 1


def test_phrasings_label_and_add_but_never_move(spark):
    d = frame(spark, TEXTS)
    q = asks(spark, "glaze kiln", "zeppelin")
    said = spark.createDataFrame([(0, 0, "Kiln? GLAZE kiln"), (0, 1, "GLAZE -- kiln!"), (0, 2, " "), (0, 3, "grease pawls"), (0, 4, "grease, pawls"), (1, 0, "tubeless tyre"), (1, 1, "nothing known")], "query_id long, pos int, query string")
    clean = {(r["query_id"], r["variant"]): r["query"] for r in ranking.clean_phrasings(q, said).collect()}
    assert clean == {(0, 1): "Kiln? GLAZE kiln", (0, 2): "grease pawls", (1, 1): "tubeless tyre", (1, 2): "nothing known"}
    plain = ranking.search(q, d, NOW)[0].select("query_id", "rank", "name", "score").collect()
    got = ranking.search_phrasings(q, said, d, NOW)
    assert sorted(got.rows.select("query_id", "rank", "name", "score").collect()) == sorted(plain)
    assert {r["name"]: r["matched_via"] for r in got.rows.where("query_id = 0").collect()} == {"kiln": ["query", "queries[0]"]}
    via = {(r["query_id"], r["name"]): r for r in got.via.collect()}
    assert (0, "pawls") in via and via[0, "pawls"]["matched_via"] == ["queries[1]"] and via[0, "pawls"]["query_score"] == 0.0
    assert (1, "tyre") in via and not any(r["query_id"] == 1 for r in plain)  # a refused question stays refused
    runs = {(r["query_id"], r["variant"]): (r["no_strong_match"], r["strong_rows"] > 0) for r in got.runs.collect()}
    assert runs[1, 1] == (False, True) and runs[1, 2] == (True, False)


def test_hybrid_phrasing_of_a_refused_question(spark):
    d = frame(spark, TEXTS)
    q, said = asks(spark, "what of zeppelins"), spark.createDataFrame([(0, 0, "light grease on freehub pawls only")], "query_id long, pos int, query string")
    sem = spark.createDataFrame([(0, v, "curated", k, c) for v, base in ((0, 0.42), (1, 0.5)) for k, c in [(2, base + 0.18 * v), (0, base)]], "query_id long, variant int, corpus string, doc_ord long, cos double")
    got = ranking.search_phrasings(q, said, d, NOW, semantic=sem)
    v = got.verdicts.first()
    assert v["no_strong_match"] and {r["weak"] for r in got.rows.collect()} == {True} and {r["matched_via"] for r in got.rows.collect()} == {None}
    via = {r["doc_ord"]: r for r in got.via.collect()}
    assert 2 in via and via[2]["also_best_weak"] and via[2]["query_score"] < 0.38 <= via[2]["score"]


def test_section_bulk_in_hybrid_rankings(spark):
    from dataclasses import replace

    from loomery.config import CONFIG

    body = "\n".join(f"## part v{k}\n" + f"word{k} " * 2000 for k in range(1, 5))
    d = frame(spark, {"big": body, **TEXTS}).withColumn("type", F.lit("note"))
    s = structure.section_docs(d, replace(CONFIG, section_min_doc=5000))
    rows = {r["name"]: r for r in s.collect()}
    assert len(rows) == 10 and rows["big#part-v1"]["tier"] == "archive" and rows["big#part-v2"]["type"] == "note" and rows["big#part-v2"]["headings"] == ["part v2"]
    assert len({r["doc_ord"] for r in rows.values()}) == 10 and len({r["hash"] for r in rows.values() if r["is_section"]}) == 4
    assert rows["big"]["body"] == "about big\n\n(4 sections, indexed individually.)"
    sem = s.select(F.lit(0).cast("long").alias("query_id"), "corpus", "doc_ord", F.lit(0.6).alias("cos"))
    for beta, own in ((1.0, False), (0.0, True)):
        got = {r["doc_ord"]: r for r in ranking.candidates(asks(spark, "word2"), s, sem, replace(CONFIG, section_beta=beta))[0].collect()}
        x = got[rows["big#part-v3"]["doc_ord"]]
        assert x["parent_chunks"] > x["own_chunks"] and x["n_chunks"] == (x["own_chunks"] if own else x["parent_chunks"])


def test_vectors_through_text(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [float("nan"), 1.0])]
    d = vectors.encode(spark.createDataFrame(rows, "id long, vec array<float>"), "vec", "blob")
    got = {r["id"]: r for r in vectors.decode(d.withColumn("Refusal", F.lit("x")), "blob", "back", 2).collect()}
    assert got[0]["back"] == [1.0, 2.0] and got[0]["refusal"] is None and got[2]["back"] is None and got[2]["refusal"] is None
    assert got[1]["back"] is None and got[1]["refusal"] == "1 floats, not 2" and got[3]["refusal"] == "entries that are not finite"
    assert vectors.decode(d.limit(0), "blob", "back", 2).count() == 0
    assert {r["id"]: r["refusal"] for r in vectors.accept(spark.createDataFrame(rows, "id long, vec array<float>"), "vec", 2).collect()} == {0: None, 1: "1 floats, not 2", 2: None, 3: None}


def test_bucket_table_rewrites_what_it_touches(spark, tmp_path):
    t = buckets.BucketTable(spark, str(tmp_path / "t"), "name", 8)
    assert t.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "name string, v int")
    assert t.upsert(rows(*[(f"n{k}", k) for k in range(40)]), [F.col("v")], 1)
    before = t.manifest()["folders"]
    assert t.upsert(rows(("n3", 300), ("n3", 200)), [F.col("v")], 2) and not t.upsert(rows(("n3", 1)), [F.col("v")], 2)
    after = t.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r["name"]: r["v"] for r in t.read().collect()} == {f"n{k}": 200 if k == 3 else k for k in range(40)}
    with pytest.MonkeyPatch.context() as m:  # dies between files and manifest
        m.setattr(shared, "commit_version", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.upsert(rows(("n4", 0)), [F.col("v")], 3)
    assert {r["v"] for r in t.read().where("name = 'n4'").collect()} == {4} and t.upsert(rows(("n4", 9)), [F.col("v")], 3)
    assert t.upsert(rows(("x", 1)).limit(0), [F.col("v")]) and t.read().count() == 40


def test_streamed_capture_with_event_time_timers(spark, tmp_path):
    import json

    from loomery.streaming import capture as live

    src = tmp_path / "in"
    src.mkdir()
    line = lambda s, k, role, at: json.dumps({"session_id": s, "ix": k, "role": role, "text": f"{s}{k}", "ts": (T0 + timedelta(minutes=at)).isoformat(), "stop_reason": None})
    for n, part in enumerate(([line("aaa", 0, "user", 0), line("aaa", 1, "assistant", 1)], [line("bbb", 0, "user", 60)], [line("bbb", 1, "user", 61)])):
        (src / f"{n}.json").write_text("\n".join(part))
        live.start(live.turns_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), event_time=True).awaitTermination(120)
    got = {r["ask"]: r["in_flight"] for r in live.captured(spark, str(tmp_path / "out")).collect()}
    assert got["aaa0"] is False and got["bbb1"] is True  # quiet for an hour of turns' time, not of the clock's


def test_run_log_rules(spark):
    def runs(*rows):
        return spark.createDataFrame([(k, T0 + timedelta(hours=k), *r) for k, r in enumerate(rows)], "seq long, at timestamp, pid long, session string, trigger string, outcome string, reconcile string")

    log = runs((1, "s", None, "captured", None), (1, "s", None, "failed", None), (2, "s", None, "skipped", None), (3, "s", "audit", "failed", None), (3, "s", "walker", "finished", "failed"), (4, "s", "walker", "started", None))
    x = upkeep.failure_streak(log).first()
    assert (x["streak"], x["since"], x["last_at"], x["lower_bound"]) == (2, T0 + timedelta(hours=1), T0 + timedelta(hours=4), False)
    assert upkeep.failure_streak(log.where("seq > 0")).first()["lower_bound"] and not upkeep.failure_streak(log.where("seq = 2")).first()["lower_bound"]
    none = spark.createDataFrame([], "pid long")
    dead = runs((1, "a", None, "started", None), (2, "b", "walker", "started", None), (3, "b", "audit", "started", None))
    assert [r["pid"] for r in upkeep.crashed_runs(dead, none, F.lit(NOW)).collect()] == [1]
    assert upkeep.crashed_runs(dead, dead.select("pid"), F.lit(NOW)).isEmpty() and upkeep.crashed_runs(dead, none, F.lit(T0 + timedelta(minutes=9))).isEmpty()
    for repair in ((9, "other", None, "captured", None), (9, "other", "walker", "finished", "agrees"), (9, "x", None, "crash-recovered", None)):
        assert upkeep.crashed_runs(runs((1, "a", None, "exited", None), repair), none, F.lit(NOW)).isEmpty()
    assert not upkeep.crashed_runs(runs((1, "a", None, "exited", None), (9, "o", "audit", "captured", None), (9, "o", "walker", "finished", "failed")), none, F.lit(NOW)).isEmpty()
