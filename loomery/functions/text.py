"""Text operators as Column expressions (T01-T07, T13-T16, X10, X13, X14, X20); no Python runs on the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from loomery.config import CONFIG, STOP_WORDS

#: White space as this engine splits on it, spelled out because \s differs between regex engines.
BLANK = r"[\x20\x09-\x0D]+"


def edged(pattern: str) -> str:
    r"""A pattern whose \b stands beside ASCII word characters; this engine's own counts letters of all scripts."""
    return pattern.replace(r"\b", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")


def words(text: Column) -> Column:
    """White-space words; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words there are, without a list of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def stem(t: Column) -> Column:
    """Light suffix stripping of plain lower-case words of five letters or more."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when(~t.rlike("^[a-z]{5,}$"), t)
        .when(t.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(t.rlike("(sses|shes|ches)$"), cut(2))
        .when(t.endswith("ing") & (n > 6), cut(3))
        .when(t.endswith("ed") & (n > 5), cut(2))
        .when(t.endswith("es") & (n > 5), cut(1))
        .when(t.endswith("s") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def tokenize(text: Column) -> Column:
    """Search terms in order, compounds before their parts, without stop words (T02), stemmed."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[`*_~>#|]", " ")
    compounds = F.filter(F.transform(F.split(plain, r"[^a-z0-9.+/\-]+"), lambda t: F.regexp_replace(t, r"^[.\-/+]+|[.\-/+]+$", "")), lambda t: t != "")

    def spread(t: Column) -> Column:
        parts = F.filter(F.split(t, r"[.\-/]"), lambda p: F.length(p) > 1)
        return F.when(F.size(parts) > 1, F.concat(F.array(t), parts)).otherwise(F.array(t))

    terms = F.filter(F.flatten(F.transform(compounds, spread)), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.transform(terms, stem)


def headings(body: Column) -> Column:
    """Texts of ATX headings, levels 1 to 6, fences not skipped."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda s: s.rlike(r"^#{1,6}[ \t]+\S"))
    return F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(s, r"^#{1,6}[ \t]+", ""), r"[ \t\r]+$", ""))


def wiki_links(body: Column) -> Column:
    """Targets of [[slug]] and [[slug|label]], distinct, in order."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != ""))


def slug(text: Column, cap: int | None = 60) -> Column:
    """Lower case, runs of anything else than letters and digits as a hyphen, trimmed, cut at cap."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, cap), "-+$", "") if cap else s


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value as a variable: an expression would be computed again in each turn of a loop inside of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_total(n: Column, size: int = CONFIG.chunk_words, overlap: int = CONFIG.chunk_overlap) -> Column:
    """How many windows a text of n words has before the cap."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(float(size - overlap))) + 1).cast("long")


def chunks(text: Column, size: int = CONFIG.chunk_words, overlap: int = CONFIG.chunk_overlap, cap: int | None = CONFIG.chunk_cap) -> Column:
    """Overlapping word windows, at most ``cap`` of them or, if it is None, all (``chunk_total`` tells how many there are)."""

    def cut(w: Column) -> Column:
        n = chunk_total(F.size(w), size, overlap)
        n = n if cap is None else F.least(n, F.lit(cap))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.array_join(F.slice(w, i * (size - overlap) + 1, size), " ")))

    return once(words(text), cut)


def unchunk(parts: Column, overlap: int = CONFIG.chunk_overlap) -> Column:
    """The inverse of :func:`chunks`: later windows lose what they share with the one before."""
    return once(parts, lambda p: _joined(p, overlap))


def _joined(parts: Column, overlap: int) -> Column:
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda c: F.slice(F.split(c, " "), overlap + 1, 1_000_000))
    return F.when(F.size(parts) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.split(F.element_at(parts, 1), " "), F.flatten(rest)), " "))


def count_hits(hay: Column, term: Column) -> Column:
    """Non-overlapping occurrences of term."""
    return ((F.length(hay) - F.length(F.replace(hay, term, F.lit("")))) / F.length(term)).cast("long")


def whole_word(hay: Column, term: Column) -> Column:
    """term with no ASCII word character beside it; term holds no regex syntax but . and -."""
    return F.expr("true") & F.regexp_like(hay, F.concat(F.lit("(?<![A-Za-z0-9_])"), F.regexp_replace(term, r"([.\-+])", r"\\$1"), F.lit("(?![A-Za-z0-9_])")))


def sha_tokens(text: Column, words: bool = True) -> Column:
    """7 to 10 hex digits that stand alone and are not all digits, distinct, in order; not ``words``: nor all letters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])([0-9a-f]{7,10})(?![A-Za-z0-9_])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: s.rlike("[a-f]") & (F.lit(words) | s.rlike("[0-9]"))))


def version_token(text: Column) -> Column:
    """The number of the first v-number, null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?<![A-Za-z0-9_])[vV](\d{1,4})(?![A-Za-z0-9_])", 1), F.lit("")), F.lit("9999")).cast("int")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))


def trim_snippet(text: Column, limit: int = CONFIG.snippet_chars) -> Column:
    """White space squeezed; longer texts cut at a word with an ellipsis."""
    t = squeeze(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", ""), F.lit("…")))


def first_words(text: Column, n: int) -> Column:
    """The first n words with single spaces; no more of the text is cut than they are."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), rf"^{BLANK[:-1]}*+((?:[^\x20\x09-\x0D]++(?:{BLANK}+|\z)){{0,{n}}})", 1)
    return F.array_join(F.slice(words(head), 1, n), " ")


#: The named entities that are decoded, in the order in which that is done. Fixed values.
ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", "\""), ("&#0?39;", "'"))


def html_to_text(html: Column) -> Column:
    """Headings as # lines, blocks as paragraphs, all other markup gone, common entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1>", " ")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|tr|table|ul|ol|blockquote|section|article)>", "\n\n")
    t = F.regexp_replace(t, r"(?i)<(br|hr)[ \t]*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for pattern, plain in ENTITIES:
        t = F.regexp_replace(t, pattern, plain)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^{BLANK}|{BLANK}$", "")
