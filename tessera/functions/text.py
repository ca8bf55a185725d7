"""Column functions on text. Patterns keep to what Java's and RE2's dialects share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in texts of all scripts: ASCII, no-break and ideographic space.
SPACE = r"[\s\x{00A0}\x{3000}]+"
PUNCTUATION = r"[!-/:-@\[-`{-~\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF1A}\x{FF1B}\x{FF1F}\x{201C}\x{201D}\x{2018}\x{2019}\x{300A}\x{300B}\x{FF08}\x{FF09}]+"
TOKEN = r"[\x{4E00}-\x{9FFF}]|[A-Za-z0-9]+"
NUMBER = r"\d+(?:[.:\x{FF1A}/\-]\d+)*%?"


def normalize_match(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), SPACE, ""), PUNCTUATION, "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def rule_clean(text: Column) -> Column:
    """Location marks, control characters, runs of blanks, and more than two line ends in a row."""
    t = F.regexp_replace(text, r"<\|LOC_\d+\|>", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


#: The entities that are replaced, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def attr_key(name: Column, limit: int = 64) -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(name)), r"[ -]+", "_"), r"[^a-z0-9_]", "")
    return F.substring(F.concat(F.lit("dim_"), key), 1, limit)


def canonical_key(title: Column) -> Column:
    """What stands before the first dash, bar, slash or colon, without surrounding blanks."""
    return F.btrim(F.split(title, r"[-\x{2014}_\x{FF5C}/:\x{FF1A}]", 2)[0])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def runs(text: Column, n: int = 2) -> Column:
    """All runs of *n* characters, in time linear in the text: places in UTF-8 aren't searched anew for each."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars) - k, F.lit(0))), lambda x, y: F.concat(x, y))
    return F.filter(out, lambda r: r.isNotNull())


def char_ngrams(text: Column, n: int = 2) -> Column:
    """The distinct runs of *n* characters of the text without white space."""
    return F.array_distinct(runs(compact(text), n))


def word_ngrams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def answer_norm(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    words = F.split(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"[ \t\n\x0B\f\r]+")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", "a", "an", "the")), " ")


def count_words(text: Column, words: list[str]) -> Column:
    """How often any of *words* occurs in the text; words are runs of ASCII letters and digits and of all other scripts' characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def sentences(text: Column, ends: str = "。！？；!?;") -> Column:
    """Runs up to and with one of *ends* or a line end, trimmed; empty ones are left out."""
    found = F.regexp_extract_all(text, F.lit(f"[^{ends}\\n]+[{ends}]?"), 0)
    return F.filter(F.transform(found, lambda s: F.btrim(s)), lambda s: s != "")


#: The ends of sentences in Latin scripts.
LATIN_ENDS = ".!?;"


def safe_json(raw: Column) -> Column:
    """A JSON value from the text, from a fenced block in it, or from its outermost braces or brackets; else null."""
    tries = (raw, F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.regexp_extract(raw, r"(?s)(\[.*\])", 1))
    return F.coalesce(*[F.try_parse_json(F.when(x != "", x)) for x in tries])
