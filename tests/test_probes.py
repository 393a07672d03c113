"""Probes, drafts and document shapes at their edges."""

from datetime import datetime

from pyspark.sql import functions as F

from loomery.operators import capture, probes, querylog, structure

DOC = "corpus string, doc_ord long, name string, probe string, probe_expected string, valid_until timestamp"


def swept(spark, asked, **more):
    files = spark.createDataFrame([("/srv/a/x.md", "one two\ntwo\nthree\n"), ("/srv/a/b/y.md", "two"), ("/srv/a/z.md", None)], "path string, text string")
    refs = spark.createDataFrame([("/repo", "refs/tags/v1", "aaa1", "bbb1"), ("/repo", "refs/heads/v1", "ccc1", None), ("/repo", "HEAD", "ddd1", None)], "repo string, ref string, sha string, peeled string")
    log = spark.createDataFrame([("/repo", "e" * 40, datetime(2024, 1, k), k != 3) for k in (1, 2, 3, 4)], "repo string, sha string, at timestamp, on_mainline boolean")
    docs = spark.createDataFrame([("c", k, f"n{k}", *row) for k, row in enumerate(asked)], DOC)
    rows = probes.sweep(docs, files, refs, log, F.lit(datetime(2024, 7, 1)), **more).orderBy("doc_ord").collect()
    return [(r["verdict"], r["actual"], r["reason"]) for r in rows]


def test_sweep(spark):
    asked = [
        ("grep_count /srv/a/x.md :: two", "2", None), ("grep_count /srv/a :: two", ">= 3", None), ("grep_count /srv/none :: two", "1", None), ("grep_count /srv/a", "1", None),
        ("file_hash_span /srv/a/x.md :: 2-9", "x", None), ("file_hash_span /srv/a/x.md :: two", "x", None), ("file_exists /srv/a/b", "true", None), ("file_exists /srv/a/q.md", "false", None),
        ("file_exists /nowhere/q.md", "true", None), ("file_exists /srv/$a.md", "true", None), ("git_tag_exists /repo :: v1", "true", None), ("git_tag_exists /other :: v1", "true", None),
        ("git_rev_parse /repo :: v1", "aaa1", None), ("git_rev_parse /repo :: v1^{}", "~BBB", None), ("git_rev_parse /repo :: gone", "x", None), ("git_rev_parse /repo :: " + "e" * 40, "~eee", None),
        ("git_rev_count /repo :: HEAD", "3", None), ("git_rev_count /repo :: --since=2024-01-02", "> 1", None), ("date_past 2024-01-01", None, None), (None, None, datetime(2030, 1, 1)), ("date_past 2024-01-01", "true", datetime(2024, 1, 1)),
        ("http_status http://localhost/", "200", None), ("moon full", "true", None), ("date_past 2024-01-01", ">= x", None), ("", "true", None),
    ]
    got = swept(spark, asked)
    assert len(got) == len(asked) - 1  # an empty probe without expiry asks for nothing
    assert [g[0] for g in got] == ["FRESH", "FRESH", "UNPROVABLE", "UNKNOWN", "UNPROVABLE", "UNKNOWN", "FRESH", "FRESH", "UNPROVABLE", "UNKNOWN", "FRESH", "UNPROVABLE", "FRESH", "FRESH", "UNKNOWN", "FRESH", "FRESH", "FRESH", "UNKNOWN", "UNKNOWN", "STALE", "UNKNOWN", "UNKNOWN", "STALE"]
    assert [g[2] for g in got if g[0] == "UNKNOWN"] == ["refused", "refused", "refused", "error", "no-expected", "no-probe", "needs-level-all", "unknown-predicate"]
    assert swept(spark, asked[:1], level="off") == [("UNKNOWN", None, "level-off")] and swept(spark, []) == []


def test_expected(spark):
    rows = [("Abc", "~ B", True), ("5", ">= 5", True), ("", "< 1", True), ("x", "> 1", False), ("x", ">x", False), ("a ", "a", True), (None, "", True)]
    d = spark.createDataFrame(rows, "a string, e string, want boolean")
    assert d.where(probes.matches_expected(F.col("a"), F.col("e")) != F.col("want")).count() == 0


def test_drafts(spark):
    body = "ship `universal-v12` at abc1234\n```\nsee `/srv/a/b.md`\n```\n> see `/srv/a/b.md`\nsee `/srv/a/c.md` and `/tmp/a/c.md` and `/srv/<x>/c.md`\nOrigin: http://localhost:1/\nhttp://localhost:2/x). http://127.0.0.1/ http://localhost:99999/ https://example.com/\nsee `/Volumes/a/b.md`"
    docs = spark.createDataFrame([(1, body, None, None), (2, body, "date_past 2020", None), (3, body, None, "p"), (4, None, None, None)], "doc_ord long, body string, probe string, parent_name string")
    rows = [(r["probe"], r["veto"]) for r in probes.propose(docs).orderBy("doc_ord", "line_no", F.desc("probe")).collect()]
    assert rows == [("git_rev_parse <repo> :: universal-v12^{}", "unresolved-repo"), ("file_exists /srv/a/c.md", None), ("http_status http://localhost:1/", "header-value"), ("http_status http://localhost:2/x", None), ("http_status http://127.0.0.1/", None)]
    assert probes.propose(docs, "/r").where("veto is null").first()["probe_expected"] == "~abc1234"
    bare = spark.createDataFrame([("grep_count a.js :: NAME", ">= 1"), ("grep_count a.js :: NAME = 1", ">= 1")], "p string, e string")
    assert [r[0] for r in bare.select(probes.veto(F.col("p"), F.col("e"), F.lit(""))).collect()] == ["bare-identifier", None]


def test_pages_and_chapters_at_their_edges(spark):
    inside = "\f".join(f"HEAD\na{k}\nb{k}\nHEAD\nc{k}\nd{k}" for k in range(4))
    d = spark.createDataFrame([(1, "one page"), (2, " \f\n"), (3, None), (4, "a\fa\fa"), (5, inside), (6, "x\f\f y")], "doc_ord long, body string")
    out = {r["doc_ord"]: r["text"] for r in structure.pdf_pages(d).collect()}
    assert out[1] == "one page" and out[2] == "" and out[3] == "" and out[4].count("a") == 3 and "HEAD" not in out[5] and "## p.3" in out[6] and "## p.2" not in out[6]
    texts = ["Chapter 1\nChapter 2\nChapter 3", "CHAPTER 1 Loomings\nCHAPTER 2 Bags\nCHAPTER 3. Inn\n", "SECTION 1\nSECTION 2\nSECTION 3", "# T\nChapter 1\nChapter 2\nChapter 3", "#### T\nChapter 1\nChapter 2\nChapter 3", "Chapter 1\nChapter 2", None, "    Part One\n   Part Two\nPart Three\nACT IV\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_ord long, body string")
    out = [r["text"] for r in structure.promote_chapters(d).orderBy("doc_ord").collect()]
    assert [t.count("## ") - t.count("### ") for t in out] == [3, 3, 0, 0, 3, 0, 0, 3] and out[3] == texts[3] and out[6] == ""


def test_versions_titles_questions(spark):
    rows = [(k, f"plan-v{k}", None, None, False, False) for k in range(5)] + [(5, "plan-v0", "r", None, False, False), (6, "plan-v0", None, "p", False, False), (7, "plan-v0", None, None, True, False), (8, "plan-v0", None, None, False, True), (9, "plan-v1-v2", None, None, None, None), (10, "plan_v1", None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_ord long, name string, root string, parent_name string, read_only boolean, tier_explicit boolean").selectExpr("*", "'c' AS corpus", "'hot' AS tier")
    assert {r["doc_ord"] for r in structure.demote_versions(d).where("tier = 'archive'").collect()} == {0, 1}
    assert structure.demote_versions(d).count() == len(rows)
    turns = [("a", 0, "user", "<system-reminder> x", None), ("a", 1, "assistant", "no", None), ("a", 2, "queue", "write  to\nbob@acme.com now. Then", "enqueue"), ("b", 0, "user", None, None), ("c", 0, "user", "x" * 90, None)]
    t = {r[0]: r[1] for r in capture.session_titles(spark.createDataFrame(turns, "session_id string, ix int, role string, text string, operation string")).collect()}
    assert t == {"a": "write to [email@acme", "c": "x" * 80}
    words = spark.createDataFrame([(" ".join(f"word{k:02d}" for k in range(25)),), ("with " * 30,), (None,), ("same " * 24,)], "t string")
    assert [r[0] for r in words.select(querylog.self_query(F.col("t"))).collect()] == ["word00 word04 word08 word12 word16 word20", None, None, "same"]
