"""Substring dedup by relative Lempel-Ziv parsing against the corpus itself.

The reference is every document's text, indexed by phrases of ``WINDOW`` words: for each phrase that
more than one document holds, its first place (smallest doc_id, then position). The index lies in hash
partitions, its blocks; a join asks each block for a document's phrases. The parse is greedy: a
factor starts at the first word whose phrase has its first place in an earlier document, and goes on while
the document and the text from that place on agree, word for word. The phrase that would begin before a
factor's end and reach beyond it is looked up itself, so a repeat that goes on in another reference is
not lost: factors may overlap by up to ``WINDOW`` - 1 words. Hashes only propose factors. The reference's words
travel to the document, and a factor ends at the first word that differs; what is left is a duplicate span
if it has ``WINDOW`` words.

Phrases that occur once are most of a corpus, so they are kept out of the index early: each phrase has
an anchor, the smallest hash among its runs of ``GRAM`` words. Equal phrases have equal anchors, and
neighbouring phrases mostly share theirs, so one row for every dozen and a half words tells which
anchors more than one document has; only phrases with such an anchor are indexed and looked up.

Phrases and passages with very many places are cut into salted parts before they are joined. What is
gathered in one place is one document's places, and the passages that it is compared with.

Defined results: a null or empty text has no words. A row with a null id removes nothing and loses
nothing. Rows with one id are one document each (rows of one id and text are alike), and none is a
reference for the other. Texts shorter than ``WINDOW`` words stay whole. Equal phrases go to the smallest
doc_id, then the smallest position. Extra columns are handed through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordvec as V
from .sparkutil import small_batches, spread_join, written

WINDOW, GRAM = 50, 16


def phrase_anchors(words: V.Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, anchor) of every phrase of a run of texts."""
    hashes = words.hashes()
    starts, phrases = V.window_hashes(hashes, words.first, window)
    at, grams = V.window_hashes(hashes, words.first, gram)
    least = np.full(len(hashes) + window, np.iinfo(np.uint64).max, V.U64)
    least[at] = grams
    width, want = 1, window - gram + 1
    while 2 * width <= want:
        least = np.minimum(least, np.append(least[width:], np.full(width, np.iinfo(np.uint64).max, V.U64)))
        width *= 2
    if want > width:
        rest = want - width
        least = np.minimum(least, np.append(least[rest:], np.full(rest, np.iinfo(np.uint64).max, V.U64)))
    return starts, phrases, least[starts]


def _runs(batch_text: pa.Array) -> Iterator[tuple[int, int, V.Words]]:
    data, offsets = V.flat(batch_text)
    for i, j in V.spans(offsets):
        yield i, j, V.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, rid, text): rid tells rows of one id apart by their text. Should two texts of one id
    share it, each is compared word by word with the factors of both."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.hash(body).alias("rid"), body.alias("text"))


def repeated(df: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rid, pos, ref_doc, ref_rid, ref_pos): phrases that also start in a document with a smaller id.

    A place's position and rid travel as one number, position first.
    """
    small_batches(df.sparkSession)
    docs = _keyed(df, text, doc_id).where(F.col("doc_id").isNotNull())

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in _runs(batch.column(2)):
                starts, _, least = phrase_anchors(w, window, gram)
                if not len(starts):
                    continue
                owner = np.searchsorted(w.first, starts, "right") - 1
                new = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))
                pick = pa.array(owner[new] + i)
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick)], names=["anchor", "doc_id", "rid"])

    found = written(docs.mapInArrow(anchors, "anchor long, doc_id long, rid int"), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    lists = found.join(shared, "anchor").groupBy("doc_id", "rid").agg(F.collect_set("anchor").alias("anchors"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(3)
            flat, cut = np.asarray(known.flatten()).view(V.U64), np.append(0, np.cumsum(np.asarray(known.value_lengths())))
            for i, j, w in _runs(batch.column(2)):
                starts, hashes, least = phrase_anchors(w, window, gram)
                edges = np.searchsorted(starts, w.first)
                keep = np.zeros(len(starts), bool)
                for k in range(j - i):
                    a, b = edges[k], edges[k + 1]
                    if b > a:
                        keep[a:b] = np.isin(least[a:b], flat[cut[i + k] : cut[i + k + 1]])
                at = starts[keep]
                owner = np.searchsorted(w.first, at, "right") - 1
                pick = pa.array(owner + i)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), batch.column(0).take(pick), pa.array((at - w.first[owner]) << 32 | np.asarray(batch.column(1)).astype(np.int64)[owner + i] + (1 << 31))], names=["phrase", "doc_id", "at"])

    places = docs.join(lists, ["doc_id", "rid"]).select("doc_id", "rid", "text", "anchors").mapInArrow(phrases, "phrase long, doc_id long, at long")
    places = written(places, "phrases")
    index = places.groupBy("phrase").agg(F.min(F.struct("doc_id", "at")).alias("ref"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("ref.doc_id < last")
    index = index.select("phrase", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.at").alias("ref_at"), "n")
    parts = [((F.col(c) % (1 << 32)) - (1 << 31)).cast("int") for c in ("at", "ref_at")]
    hits = spread_join(places, index, ["phrase"], places.count()).where("doc_id > ref_doc")
    return hits.select("doc_id", parts[0].alias("rid"), F.shiftright("at", 32).cast("int").alias("pos"), "ref_doc", parts[1].alias("ref_rid"), F.shiftright("ref_at", 32).cast("int").alias("ref_pos"))


HIT = ["pos", "ref_doc", "ref_rid", "ref_pos"]
FACTOR = ["start", "words", "ref_doc", "ref_rid", "ref_start"]


def factors(pos: np.ndarray, ref_doc: np.ndarray, ref_rid: np.ndarray, ref_pos: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """The greedy parse of one document: first word, words, reference document and its first word of each factor that the index proposes."""
    order = np.argsort(pos, kind="stable")
    pos, ref_doc, ref_rid, ref_pos = pos[order], ref_doc[order], ref_rid[order], ref_pos[order]
    go_on = (pos[1:] == pos[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1]) & (ref_rid[1:] == ref_rid[:-1]) & (ref_pos[1:] == ref_pos[:-1] + 1)
    heads = np.flatnonzero(np.append(True, ~go_on)) if len(pos) else np.zeros(0, np.int64)
    tails = np.append(heads[1:] - 1, len(pos) - 1) if len(pos) else heads
    return [pos[heads], pos[tails] - pos[heads] + window, ref_doc[heads], ref_rid[heads], ref_pos[heads]]


def proposed(df: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rid, start, words, ref_doc, ref_rid, ref_start): the factors that the index proposes."""
    rows = repeated(df, window, min(GRAM, window), text, doc_id).groupBy("doc_id", "rid").agg(F.collect_list(F.struct(*HIT)).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            flat, cut = hits.flatten(), np.append(0, np.cumsum(np.asarray(hits.value_lengths())))
            parts = [np.asarray(flat.field(k)) for k in range(len(HIT))]
            found = [factors(*(p[a:b] for p in parts), window) for a, b in zip(cut[:-1], cut[1:])]
            own = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(len(FACTOR))]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, types))], names=["doc_id", "rid", *FACTOR])

    return rows.mapInArrow(run, "doc_id long, rid int, start int, words int, ref_doc long, ref_rid int, ref_start int")


def parsed(df: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, rid, factors): of each document that has any, first word, words and the reference's words of each factor."""
    found = written(proposed(df, window, text, doc_id), "factors")
    place = ["ref_doc", "ref_rid", "ref_start"]
    wanted = found.groupBy(*place).agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("n"))
    lists = wanted.groupBy("ref_doc", "ref_rid").agg(F.collect_list(F.struct("ref_start", "words", "n")).alias("wanted"))
    docs = _keyed(df, text, doc_id)
    both = docs.join(lists, (docs["doc_id"] == lists["ref_doc"]) & (docs["rid"] == lists["ref_rid"])).select("ref_doc", "ref_rid", "text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(2)[k].as_py().encode("utf-8", "surrogatepass").split()
                want = batch.column(3)[k].as_py()
                passages = [b" ".join(words[w["ref_start"] : w["ref_start"] + w["words"]]).decode("utf-8", "surrogatepass") for w in want]
                own = pa.array([k] * len(want), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([w["ref_start"] for w in want], pa.int32()), pa.array([w["n"] for w in want], pa.int64()), pa.array(passages, pa.string())], names=[*place, "n", "passage"])

    passages = both.mapInArrow(cut, "ref_doc long, ref_rid int, ref_start int, n long, passage string")
    passages = written(passages.dropDuplicates(place), "passages")
    return spread_join(found, passages, place, found.count()).groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "words", "passage")).alias("factors"))


def kept_words(raw: bytes, found: list[dict] | None, window: int = WINDOW) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space) of a text: each proposed factor is compared with the reference's words."""
    words = raw.split()
    if not found:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for f in found:
        a, n = f["start"], f["words"]
        own, other = words[a : a + n], f["passage"].encode("utf-8", "surrogatepass").split(b" ")[:n]
        if own != other:
            n = next(k for k, (x, y) in enumerate(zip([*own, None], [*other, b""])) if x != y)
        if n >= window:
            edge[a] += 1
            edge[a + n] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(df: DataFrame, window: int = WINDOW, digests: bool = False, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Removes repeated spans. Gives doc_id, n_words, n_removed and kept_sha256 with ``digests``; else the
    columns of df (or ``keep``), ``text`` being the kept words joined by a space where words were removed."""
    import pyspark.sql.types as T

    spans = parsed(df, window, text, doc_id)
    others = [] if digests else [c for c in (df.columns if keep is None else keep) if c != text]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    left = df.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.hash(body).alias("__rid"), F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(others)])
    joined = left.join(spans, (F.col("__id") == spans["doc_id"]) & (F.col("__rid") == spans["rid"]), "left").select("__id", "__text", "factors", *[f"__c{k}" for k in range(len(others))])
    if digests:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        schema = T.StructType([df.schema[c] for c in others] + [T.StructField(text, T.StringType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            done = [kept_words((t or "").encode("utf-8", "surrogatepass"), f, window) for t, f in zip(texts, found)]
            gone = pa.array([d[1] for d in done], pa.int64())
            if digests:
                cols = [batch.column(0), pa.array([d[0] for d in done], pa.int64()), gone, pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())]
            else:
                cols = [*(batch.column(3 + k) for k in range(len(others))), pa.array([d[2].decode("utf-8", "surrogatepass") if d[1] else t for t, d in zip(texts, done)], pa.string()), gone]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(run, schema)
