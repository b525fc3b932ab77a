"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it; Java's \\s alone misses the ideographic and no-break spaces.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def terms_array(terms: list[str]) -> Column:
    """Plan-time list of terms."""
    return F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Outer white space removed, all of Unicode's."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c) == "")


def first_non_blank(*columns: Column) -> Column:
    """The first value that isn't blank, stripped."""
    return F.coalesce(*(F.when(~blank(c), strip(c)) for c in columns))


def collapse(c: Column, most: int | None = None, tail: str = "") -> Column:
    """White space runs as one blank, stripped, and cut to `most` characters (`tail` added to what was cut)."""
    one = strip(F.regexp_replace(c, f"{SPACE}+", " "))
    if most is None:
        return one
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit(tail))).otherwise(one)


def compact(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, f"{SPACE}+", ""))


def contains_any(c: Column, terms: list[str]) -> Column:
    """Whether any term occurs; no terms: false."""
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms), F.lit(False))


def matched_terms(c: Column, terms: list[str]) -> Column:
    """The terms that occur, in list order, each once."""
    return F.array_distinct(F.filter(terms_array(terms), lambda t: F.contains(c, t)))


def first_matched(c: Column, terms: list[str]) -> Column:
    """The first term of the list that occurs, without regard to case; '' for none."""
    return F.coalesce(F.try_element_at(F.filter(terms_array(terms), lambda t: F.contains(F.lower(c), F.lower(t))), F.lit(1)), F.lit(""))


def excerpt_of(c: Column, term: str, margin: int = 28) -> Column:
    """The text around the first occurrence of a fixed term; '' without one."""
    at = F.instr(c, term)
    start = F.greatest(F.lit(1), at - margin)
    return F.when(at > 0, F.substring(c, start, at - start + len(term) + margin)).otherwise("")


def safe_id(c: Column) -> Column:
    """Letters, digits, underscore, hyphen and dot; anything else becomes an underscore."""
    return F.regexp_replace(c, "[^\\p{L}\\p{N}_.-]", "_")


def content_sha1(c: Column, most: int = 300) -> Column:
    """SHA-1 of the first characters without white space; of '' for null."""
    return F.sha1(F.left(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", ""), F.lit(most)))


def short_hash_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 16 hex digits of the SHA-1 of the parts joined by bars."""
    return F.concat(F.lit(prefix), F.left(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), F.lit(16)))


def characters(c: Column) -> Column:
    """Distinct characters; an empty list for '' (splitting '' would give one empty string)."""
    return F.when(F.length(c) > 0, F.array_distinct(F.split(c, ""))).otherwise(F.array().cast("array<string>"))


def ngrams(c: Column, n: int = 2) -> Column:
    """Distinct runs of n characters; a shorter text is its own only run, '' has none."""
    # a text is bound once; its characters are split once, as each substring would count from the start again
    def of(t: Column) -> Column:
        runs = F.transform(F.array(F.split(t, "")), lambda ch: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ch) - n + 1)), lambda i: F.array_join(F.slice(ch, i, n), "")))[0]
        return F.when(F.length(t) > n, F.array_distinct(runs)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(c), of)[0]


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct items; `empty` if both are empty, 0 if one is."""
    # arrays of one struct bind the sets and then their sizes, so that each is worked out once
    sizes = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("both"), (F.size(x["a"]) + F.size(x["b"])).alias("sum")))
    return F.transform(sizes, lambda s: F.when(s["sum"] == 0, F.lit(empty)).otherwise(s["both"] / (s["sum"] - s["both"])))[0]


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets without white space; 0 if either is empty."""
    x, y = (characters(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", "")) for c in (a, b))
    return jaccard(x, y)


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of character pairs without white space; 0 if either is empty."""
    x, y = (ngrams(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", "")) for c in (a, b))
    return jaccard(x, y)


def word_terms(c: Column, stop: list[str], longest: int = 12, sizes: tuple[int, ...] = (6, 5, 4), most: int = 8) -> Column:
    """Runs of Han letters, Latin letters and digits of two or more characters, without stop terms.

    A longer run than `longest` is replaced by its first `most` windows of the given sizes.
    """
    runs = F.filter(F.regexp_extract_all(c, F.lit("[\\x{4e00}-\\x{9fff}A-Za-z0-9]{2,}"), 0), lambda t: ~t.isin(stop) if stop else F.lit(True))

    def of_size(t: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substring(t, i, F.lit(n)))

    def windows(t: Column) -> Column:
        parts = [of_size(t, n) for n in sizes]
        return F.slice(F.array_distinct(F.concat(*parts)), 1, most)

    return F.array_distinct(F.flatten(F.transform(runs, lambda t: F.when(F.length(t) > longest, windows(t)).otherwise(F.array(t)))))


def loosely_contains(text: Column, term: Column) -> Column:
    """Whether the text holds the term, its first four characters, or its first two words."""
    words = F.split(term, f"{SPACE}+|[，,、。；;]")
    head = F.filter(F.slice(words, 1, 2), lambda w: F.length(w) >= 2)
    return (F.length(term) > 0) & (F.contains(text, term) | ((F.length(term) >= 4) & F.contains(text, F.left(term, F.lit(4)))) | F.exists(head, lambda w: F.contains(text, w)))


def supported_by(claim: Column, text: Column, least: int = 2) -> Column:
    """Whether at least min(least, n) of the claim's n words occur in the text; no words: false."""
    words = F.array_distinct(F.filter(F.split(claim, f"{SPACE}+|[，,、。；;：:]"), lambda w: F.length(w) >= 2))
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return (F.size(words) > 0) & (hits >= F.least(F.lit(least), F.size(words)))


def term_list(values: Column, stop: list[str], longest: int = 20) -> Column:
    """The terms of all values, and each value itself if it has at most `longest` characters; each once."""
    given = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: strip(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return F.array_distinct(F.flatten(F.transform(given, lambda v: F.concat(word_terms(v, stop), F.when(F.length(v) <= longest, F.array(v)).otherwise(F.array().cast("array<string>"))))))


def is_specific(term: Column, stop: list[str], generic: list[str]) -> Column:
    """Whether a term of two or more characters is no stop term and holds no generic topic."""
    return (F.length(term) >= 2) & ~term.isin(stop) & ~contains_any(term, generic)


def alias_supported(name: Column, text: Column, aliases: dict[str, list[str]]) -> Column:
    """Whether the text holds the name, loosely, or an alias of any word in it. aliases: word to its aliases."""
    return loosely_contains(text, name) | reduce(lambda a, b: a | b, (F.contains(name, F.lit(w)) & contains_any(text, forms) for w, forms in aliases.items()), F.lit(False))


def natural_key(c: Column) -> tuple[Column, Column]:
    """Sort columns of an id: its prefix and its trailing number."""
    return F.regexp_extract(c, "^(.*?)(\\d*)$", 1), F.coalesce(F.regexp_extract(c, "(\\d+)$", 1).try_cast("long"), F.lit(-1))


def percent(c: Column, places: int = 1) -> Column:
    """A share as a percentage text."""
    return F.concat(F.format_number(F.round(c * 100, places), places), F.lit("%"))
