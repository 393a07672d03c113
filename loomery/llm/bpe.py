"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch, sorted, are the depth-first order of their trie: the part that a word
shares with the word before it is the path that is still on the stack. Each step down keeps one state,
the last token of the prefix's encoding. It is the only vocabulary token that ends the prefix and may
follow the last token of what stands before it, so a shared prefix is worked out once for all words
below it, and a word's tokens are read by walking back over the states. The end-of-word suffix makes
other symbols of the last character, so a word's last token comes from the suffixed vocabulary.

Two tokens may stand side by side if merging their symbols gives the two again; the answers are kept.

Contract of :func:`encode`: one row per input row, with ``ids`` (array of int) and ``decoded``
(string), or with their digests. A null or empty text has no tokens and decodes to the empty string.
Repeated rows give repeated results; no row depends on another. Columns not named are passed through
unless they clash with a result column, which then wins. Special tokens in a text get their own ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import wordvec as V
from .sparkutil import free_name, small_batches

#: Entries of a worker's word table; it starts anew beyond that. Bounds memory, changes no result.
TABLE_ROWS = 250_000
SLICE = 1 << 21


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class TrieBpe:
    """A BPE model with an end-of-word suffix, read from a tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        cut = len(self.suffix)
        self.inner = {t: i for t, i in self.vocab.items() if not (cut and t.endswith(self.suffix))}
        self.final = {t[:-cut] if cut else t: i for t, i in self.vocab.items() if not cut or t.endswith(self.suffix)}
        self.inner_ends, self.final_ends = ({t[k:] for t in v for k in range(len(t))} for v in (self.inner, self.final))
        self.byte = byte_chars()
        self.byte_table = {i: c for i, c in enumerate(self.byte)}
        self.pairs: dict[int, bool] = {}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short run of symbols: lowest rank first, leftmost of equals."""
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = self.ranks.get((symbols[i], symbols[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        cut = len(self.suffix)
        if cut and token.endswith(self.suffix):
            body = token[:-cut]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left; left below 0: whether right may begin a word."""
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            tokens = [self.names[right]] if left < 0 else [self.names[left], self.names[right]]
            known = self.pairs[key] = self.merged([s for t in tokens for s in self.symbols(t)]) == tokens
            if len(self.pairs) > 2_000_000:
                self.pairs = {key: known}
        return known

    def last(self, path: str, end: int, vocab: dict[str, int], ends: set[str], tokens: list[int]) -> tuple[int, int]:
        """(token, length) of the last token of path[:end], from the states of shorter prefixes."""
        get, known, fits = vocab.get, self.pairs.get, self.fits
        begin = end - 1
        while begin >= 0 and (part := path[begin:end]) in ends:
            t = get(part)
            if t is not None:
                left = tokens[begin]
                ok = known((left + 1) << 32 | t)
                if ok or ok is None and fits(left, t):
                    return t, end - begin
            begin -= 1
        raise KeyError(path[:end])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct, sorted words of byte characters: one depth-first walk over their trie."""
        out: list[list[int]] = []
        tokens, sizes, before = [-1], [0], ""
        for word in words:
            top = min(len(before), len(word), len(tokens) - 1)
            shared = 0
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del tokens[shared + 1 :], sizes[shared + 1 :]
            n = len(word)
            inner_end = n - 1 if self.suffix else n
            for end in range(len(tokens), inner_end + 1):
                t, size = self.last(word, end, self.inner, self.inner_ends, tokens)
                tokens.append(t)
                sizes.append(size)
            if self.suffix:
                t, size = self.last(word, n, self.final, self.final_ends, tokens)
                ids, at = [t], n - size
            else:
                ids, at = [], n
            while at:
                ids.append(tokens[at])
                at -= sizes[at]
            out.append(ids[::-1])
            before = word
        return out


@lru_cache(maxsize=4)
def model(path: str) -> TrieBpe:
    return TrieBpe(path)


def normal(text: str) -> str:
    """NFC, then lower case character by character (white space is dropped later anyway)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower() would look at what follows a sigma
    return text.lower()


class WordTable:
    """What a worker knows of words so far, by hash: count of ids, the ids as text, the tokens as text."""

    def __init__(self, bpe: TrieBpe):
        self.bpe, self.at = bpe, {}
        self.count, self.ids, self.pieces = [], [], []

    def look_up(self, hashes: list[int], word_at) -> list[int]:
        """Indices of the words; word_at(i) gives the text of an unknown one."""
        if len(self.at) > TABLE_ROWS:
            self.__init__(self.bpe)
        found = list(map(self.at.get, hashes))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            table, bpe = self.bpe.byte_table, self.bpe
            texts = [word_at(i).encode("utf-8", "surrogatepass").decode("latin-1").translate(table) for i in new]
            order = sorted(range(len(new)), key=texts.__getitem__)
            for k, ids in zip(order, bpe.encode_words([texts[k] for k in order])):
                found[new[k]] = self.at[hashes[new[k]]] = len(self.count)
                self.count.append(len(ids))
                self.ids.append(" ".join(map(str, ids)))
                self.pieces.append(" ".join(map(bpe.names.__getitem__, ids)))
        return found


_tables: dict[str, WordTable] = {}


def encode_texts(path: str, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    """(number of ids, ids as text, decoded text) of each text."""
    bpe = model(path)
    words = _tables.setdefault(path, WordTable(bpe))
    parts: list[str] = []  # normalised texts, a text with special tokens in several
    shape: list[list[int | str]] = []
    for text in texts:
        text = text or ""
        if bpe.split_specials and "<" in text and len(cut := bpe.split_specials.split(text)) > 1:
            row: list[int | str] = []
            for k, piece in enumerate(cut):
                if k % 2:
                    row.append(piece)
                else:
                    row.append(len(parts))
                    parts.append(normal(piece))
            shape.append(row)
        else:
            shape.append([len(parts)])
            parts.append(normal(text))
    done: list[tuple[int, str, str]] = []
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    edges = np.append(0, np.cumsum(sizes))
    for i, j in V.spans(edges, SLICE):
        joined = "".join(parts[i:j])
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts, ends = V.pretokens(cps, edges[i : j + 1] - edges[i], lead_space=False)
        hashes = V.span_hashes(cps, starts, ends, V.cp_random())
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.asarray(words.look_up(distinct.tolist(), lambda k: joined[starts[first[k]] : ends[first[k]]]), dtype=np.int64)[back]
        cuts = np.searchsorted(starts, edges[i : j + 1] - edges[i])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = at[a:b].tolist()
            done.append((sum(map(words.count.__getitem__, own)), " ".join(map(words.ids.__getitem__, own)), " ".join(map(words.pieces.__getitem__, own))))
    for row in shape:
        if len(row) == 1:
            yield done[row[0]]
        else:
            got = [(1, str(bpe.specials[x]), x) if isinstance(x, str) else done[x] for x in row]
            got = [x for x in got if x[0]]
            yield sum(x[0] for x in got), " ".join(x[1] for x in got), " ".join(x[2] for x in got)


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Encodes and decodes ``text`` of every row with the tokenizer file at ``path``.

    Adds ``n_tokens`` and either ``ids`` and ``decoded`` or, with ``digests``, the SHA-256 of the ids in
    decimal and of the decoded text. ``keep`` names the columns to pass through (all by default).
    """
    import pyspark.sql.types as T

    small_batches(df.sparkSession)
    new = [("n_tokens", T.LongType())] + ([("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())])
    names = [n for n, _ in new]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names and (keep is not None or c.lower() != text.lower())]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(encode_texts(path, batch.column(batch.num_columns - 1).to_pylist()))
            count = pa.array([r[0] for r in rows], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(r[k].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string()) for k in (1, 2)]
            else:
                cols = [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), count, *cols], names=[*kept, *names])

    from pyspark.sql import functions as F

    base = df.select(*[F.col(f"`{c}`") for c in kept])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(free_name(base, "text_in"))).mapInArrow(run, schema)
