"""One consistent form for texts that look alike.

Each text is decomposed, freed of characters of no width, its full-width forms and single blanks brought to ASCII, and
each letter replaced by the class of letters that share its shape. The runs of letters are then read anew: every
class is a column of a lattice, and Viterbi finds the reading with the best character bigram score, where a step from
one script to another costs `SWITCH`. Bigram counts are taken over the words of one script in the whole corpus. As a
reading depends on the classes only, texts that look alike get the same form, and texts that don't keep apart, for
each reading maps back to its classes.

Defined cases: null stays null; empty and blank texts keep their (normalised) blanks and never enter pairs; letter
case, accents, raised or circled digits and unit signs are kept; repeated rows are treated alike; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut_lineage, spread

#: Letters of one shape: Latin, then its Greek and Cyrillic look-alikes (fixed values).
SHAPES = [
    "AΑА", "BΒВ", "CϹС", "EΕЕ", "HΗН", "IΙІӀ", "JͿЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "QԚ", "SЅ", "TΤТ", "WԜ", "XΧХ", "YΥУҮ", "ZΖ",
    "aа", "cϲс", "dԁ", "eе", "hһ", "iі", "jϳј", "oοо", "pр", "qԛ", "sѕ", "vν", "wԝ", "xх", "yуү", "ΓГ", "ΠП", "ΦФ", "κк",
]
#: Characters of no width (fixed values).
IGNORABLE = "\u00ad\u034f\u061c\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Blanks that look like a space (fixed values).
BLANKS = "    　"
#: Cost of a change of script within a word, in nats.
SWITCH = 12.0

#: Copies of one text that one task attaches to a pair.
SHARE = 1000

_TO_CLASS = {ord(c): s[0] for s in SHAPES for c in s[1:]}
_MAP = {**{ord(c): None for c in IGNORABLE}, **{ord(c): " " for c in BLANKS}, **{c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}}
_TABLE = {**_MAP, **_TO_CLASS}
_OPTIONS = {s[0]: s for s in SHAPES}
#: A word: letters of the three scripts with their accents.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ̀-ͯ]+")


def script(c: str) -> str:
    """Script of a letter; accents and others belong to any."""
    o = ord(c)
    return "L" if o < 0x250 and c.isalpha() else "G" if 0x370 <= o < 0x400 else "C" if 0x400 <= o < 0x530 else ""


def skeleton(text: str) -> str:
    """The text with every letter replaced by its class; equal for texts that look alike."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", text).translate(_TABLE)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigram counts of one partition's words of one script; the words are counted first."""
    total: Counter[str] = Counter()
    for b in batches:
        words: Counter[str] = Counter()
        for t in b.column(0).to_pylist():
            if t:
                words.update(_WORD.findall(t if t.isascii() else unicodedata.normalize("NFD", t).translate(_MAP)))
        for w, n in words.items():
            if len({script(c) for c in w} - {""}) == 1:
                for a, c in zip("^" + w, w + "$"):
                    total[a + c] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])


class Reader:
    """Viterbi over look-alike lattices."""

    def __init__(self, counts: dict[str, int]):
        first: Counter[str] = Counter()
        for g, n in counts.items():
            first[g[0]] += n
        self.size = len({g[1] for g in counts}) + 1
        self.counts, self.first = counts, first
        self.known: dict[str, str] = {}

    def score(self, a: str, c: str) -> float:
        s, t = script(a), script(c)
        return math.log((self.counts.get(a + c, 0) + 0.1) / (self.first.get(a, 0) + 0.1 * self.size)) - (SWITCH if s and t and s != t else 0.0)

    def read(self, word: str) -> str:
        """The best reading of a word given by its classes; ties go to the earlier script in SHAPES."""
        best = [(0.0, "^", "")]
        for c in word:
            if not script(c):  # an accent belongs to the letter before it
                best = [(s, last, path + c) for s, last, path in best]
                continue
            best = [max(((s + self.score(last, o), o, path + o) for s, last, path in best), key=lambda x: x[0]) for o in _OPTIONS.get(c, c)]
        return max(((s + self.score(last, "$"), last, path) for s, last, path in best), key=lambda x: x[0])[2]

    def _word(self, m: re.Match) -> str:
        w = m.group()
        r = self.known.get(w)
        if r is None:
            if len(self.known) > 200_000:  # a cache of results, not of data: what is lost is computed again
                self.known.clear()
            r = self.known[w] = self.read(w)
        return r

    def canonical(self, text: str | None) -> str | None:
        if text is None:
            return None
        out = _WORD.sub(self._word, skeleton(text))
        return out if out.isascii() else unicodedata.normalize("NFC", out)


def fit_bigrams(df: DataFrame, text_col: str) -> dict[str, int]:
    """Bigram counts over all texts. At most the square of the letters of three scripts, so safe to broadcast."""
    grams = spread(df.select(F.col(text_col).cast("string").alias("t"))).mapInArrow(_bigrams, "gram string, n long")
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def _apply(df: DataFrame, id_col: str, text_col: str, keys: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(fit_bigrams(df, text_col))
    docs = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                raw = part.column("text").to_pylist()
                new = [reader.canonical(t) for t in raw]
                if keys:
                    of = lambda ts: pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) if t and t.strip() else None for t in ts], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column("id"), of(new), of(raw)], names=["id", "look", "exact"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(new, pa.string())], names=["id", "canonical"])

    return docs.mapInArrow(run, f"id {kind}, look binary, exact binary" if keys else f"id {kind}, canonical string")


def canonical_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, canonical): each text in its consistent form."""
    return _apply(df, id_col, text_col, keys=False)


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), smaller first: texts that look alike without being identical.

    Only 128-bit hashes are shuffled. Distinct texts of one look are paired first, and rows are attached to the two
    ends of each such pair, so a text that a third of all rows share is never paired with itself.
    """
    keys = cut_lineage(_apply(df, id_col, text_col, keys=True).where("look IS NOT NULL AND exact IS NOT NULL"))
    texts = keys.select("look", "exact").distinct()
    pairs = texts.alias("a").join(texts.alias("b"), "look").where("a.exact < b.exact").select("look", F.col("a.exact").alias("exact_a"), F.col("b.exact").alias("exact_b"))
    # the copies of a text stand in shares, so that no task attaches all of a hot one's
    share = F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")
    sized = keys.groupBy("look", "exact").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    pairs = pairs.join(sized.select("look", F.col("exact").alias("exact_b"), "shares"), ["look", "exact_b"])
    left = keys.select("look", F.col("exact").alias("exact_a"), F.col("id").alias("x"))
    to_all = pairs.join(left, ["look", "exact_a"]).select("look", "exact_b", "x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = keys.join(sized, ["look", "exact"]).select("look", F.col("exact").alias("exact_b"), share.alias("share"), F.col("id").alias("y"))
    both = to_all.join(right, ["look", "exact_b", "share"])
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a <> id_b")
