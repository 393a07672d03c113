"""Written files meet the prose of their session in blocks, each text read once."""

import random
import time

import pytest

from loomery.operators import filewrites, probes


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_names_beside_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(probes, "BLOCK_BYTES", block)
    monkeypatch.setattr(probes, "PIECE_BYTES", 100)
    monkeypatch.setattr(probes, "BLOCK_LITERALS", 4)
    rng = random.Random(5)
    paths = ["/a/notes_of_today.md", "/b/notes_of_today.md", "/a/first_module.py", "/a/b\nc/odd_fold_name.py", "/é/schön_long_name.py", "/a/x.py", "/a/first_module.pyc"]
    said = [*paths, "notes_of_today.md", "first_module.py", "odd_fold_name.py", "schön_long_name.py", "x.py", "\n", " ", "plain"]
    files = sorted({(s, rng.choice(paths)) for s in range(9) for _ in range(4)})
    turns = [(s, k, rng.choice(["user", "assistant"]), "".join(rng.choice(said) for _ in range(rng.randint(0, 4)))) for s in range(10) for k in range(6)]
    turns.append((3, None, "user", paths[0]))
    want = set()
    for s, path in files:
        base = path.rsplit("/", 1)[1]
        alone = sum(p.rsplit("/", 1)[1] == base for t, p in files if t == s) == 1
        terms = [path, base] if alone and len(base) >= 12 else [path]
        want |= {(s, path) for t, _, _, text in turns if t == s and any(x in text for x in terms)}
    frames = spark.createDataFrame(turns, "session_id long, ix int, role string, content string"), spark.createDataFrame(files, "session_id long, path string")
    got = [tuple(r) for r in filewrites.named(*frames).collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_long_turn_costs_no_square(spark):
    """With grams cut anew for each place 40,000 letters took minutes."""
    turns = spark.createDataFrame([(1, 1, "user", "some words of it " * 2_400 + "/srv/a_long_file.py")], "session_id long, ix int, role string, content string")
    files = spark.createDataFrame([(1, "/srv/a_long_file.py"), (1, "/srv/not_said.py")], "session_id long, path string")
    began = time.monotonic()
    assert [tuple(r) for r in filewrites.named(turns, files).collect()] == [(1, "/srv/a_long_file.py")]
    assert time.monotonic() - began < 45
