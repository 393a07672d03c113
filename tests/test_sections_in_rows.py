"""Sections are cut where a document's row is; a file's terms are counted without a shuffle of their postings."""

from dataclasses import replace

from pyspark.sql import functions as F

from loomery.config import CONFIG
from loomery.operators import keyword, postings, structure

ODD = [
    "intro\n## A v1\none\n```\n## not\n~~~\n## B v3\ntwo\n## B v3\n\nthree\r\n##\n##\tTab  v2 \n  ~~~\n## x\n```\n## ä語 v3\n", "## A\n## A\n## a!\n##  \n## A",
    "##no\n# no\n### no", "## only", "", None, " ## no\n\n## last v0", "```\n## in a fence that stays open\n## too", "## one\x0b\n##\x0btwo\n## three ",
]


def plain(text):
    """Sections line by line."""
    out, start, inside = [], 0, False
    for line in (text or "").split("\n"):
        fence = line.lstrip(" \t").startswith(("```", "~~~"))
        inside = inside != fence
        rest = line[2:].lstrip(" \t")
        if not inside and not fence and line.startswith("##") and rest != line[2:] and rest and rest[0] not in "\x0b\f\r":
            out.append([start, start + len(line), [line]])
        elif out:
            out[-1][1], out[-1][2] = start + len(line), out[-1][2] + [line]
        start += len(line) + 1
    return [(k, a, b, "\n".join(lines)) for k, (a, b, lines) in enumerate(out)]


def test_sections_of_odd_texts(spark):
    d = spark.createDataFrame(list(enumerate(ODD)), "doc_ord long, body string")
    for least in (0, 8):
        got = sorted((r["doc_ord"], r["ix"], r["first"], r["stop"], r["text"]) for r in structure.split_sections(d, least).collect())
        assert got == [(n, *row) for n, t in enumerate(ODD) for row in plain(t) if len(row[3]) >= least]


def test_section_docs_need_no_shuffle(spark):
    d = spark.createDataFrame([("c", n, f"f{n}", f"d{n}", "", "hot", t) for n, t in enumerate(ODD)], "corpus string, doc_ord long, file string, name string, description string, tier string, body string")
    out = structure.section_docs(d, replace(CONFIG, section_min_doc=0, section_min_chars=0, section_min_count=3, section_keep=2))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r["name"]: r for r in out.collect()}
    assert [n for n in rows if n.startswith("d1#")] == ["d1#a", "d1#a-2", "d1#a-3", "d1#a-4"] and rows["d1"]["section_count"] == 4 and rows["d1"]["headings"] == []
    assert {n: r["tier"] for n, r in rows.items() if n.startswith("d0#")} == {"d0#a-v1": "archive", "d0#b-v3": "hot", "d0#b-v3-2": "hot", "d0#tab-v2": "archive", "d0#v3": "archive"}
    assert rows["d3"]["body"] == "## only" and not rows["d3"]["is_section_parent"] and rows["d5"]["body"] is None


def test_leads_are_the_files_of_a_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword, "TEXT_BYTES", 60)
    rows = [(f"c{n % 2}", n, f"f{n % 7}", f"name {n}", "", f"wide word{n % 3} word{n % 5} " * (1 + n % 4)) for n in range(80)]
    d = spark.createDataFrame(rows, "corpus string, doc_ord long, file string, name string, description string, body string")
    plans, write = {}, postings._write
    monkeypatch.setattr(postings, "_write", lambda rows, path, table, *a: plans.update({table: rows._jdf.queryExecution().optimizedPlan().toString()}) or write(rows, path, table, *a))
    want = {(r["corpus"], r["term"]): r["n"] for r in keyword.postings(keyword.field_tokens(d)).groupBy("corpus", "term").agg(F.countDistinct("file").alias("n")).collect()}
    for size in (1, 1 << 40):
        monkeypatch.setattr(postings, "DIRECT_BYTES", size)
        index = postings.build(d, str(tmp_path / f"ix{size}"))
        assert {(r["corpus"], r["term"]): r["df"] for r in index.document_frequency().collect()} == want
        assert "distinct" not in plans["terms"].lower() and index.documents().count() == 80 and {r["n_docs"] for r in index.stats().collect()} == {7}
