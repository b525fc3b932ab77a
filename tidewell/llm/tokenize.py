"""Encoding of a corpus with a public byte-level BPE vocabulary.

Short texts are encoded where they lie. A text longer than `leaf_chars` is cut into leaves that are encoded in
parallel tasks; its leaves are then concatenated as a tree. At each join a window of the last tokens of the left
side and the first of the right is taken and grown until each side shows a position that is a pre-token boundary
whatever surrounds it and at which a token of that side ends: there both sides agree with the encoding of the whole
text, so the text between the two positions is encoded anew and spliced in. If no such positions exist, the window
grows to both sides entirely, which is encoding their concatenation. The result is thus exact for every text.

Defined cases: null and empty text give an empty list; blank text is encoded like any other; repeated ids are kept as
they come, except that two long rows with one id are told apart by a row tag; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import spread

#: Folder of the public vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-token pattern published with the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest text, in characters, that one call encodes; longer ones are cut into leaves of this length.
LEAF_CHARS = 16_384

#: A run of letters, or of digits, always ends a pre-token, whatever precedes or follows it.
_SURE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


class Codec:
    """A vocabulary, with exact concatenation of encoded texts."""

    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int32)

    def _left_anchor(self, raw: bytes, lengths: list[int]) -> tuple[int, int] | None:
        """Last sure boundary in the left window at which a token ends: its byte and the number of tokens before it."""
        lead = next((i for i, b in enumerate(raw) if b & 0xC0 != 0x80), len(raw))
        text = raw[lead:].decode("utf-8")
        ends = {0: 0}
        at = 0
        for k, n in enumerate(lengths, 1):
            at += n
            ends[at] = k
        for m in reversed(list(_SURE.finditer(text))):
            byte = lead + len(text[: m.start()].encode())
            if byte in ends:
                return byte, ends[byte]
        return None

    def _right_anchor(self, raw: bytes, lengths: list[int]) -> tuple[int, int] | None:
        """First sure boundary in the right window at which a token ends."""
        text = raw.decode("utf-8", errors="ignore")
        ends = {}
        at = 0
        for k, n in enumerate(lengths, 1):
            at += n
            ends[at] = k
        for m in _SURE.finditer(text):
            byte = len(text[: m.start()].encode())
            if byte in ends:
                return byte, ends[byte]
        return None

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 32) -> np.ndarray:
        """The encoding of the concatenated texts of two encodings."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = left[-window:], right[:window]
            pa_, pb = [self.pieces[t] for t in a], [self.pieces[t] for t in b]
            ra, rb = b"".join(pa_), b"".join(pb)
            lo = self._left_anchor(ra, [len(p) for p in pa_]) or ((0, 0) if len(a) == len(left) else None)
            hi = self._right_anchor(rb, [len(p) for p in pb]) or ((len(rb), len(b)) if len(b) == len(right) else None)
            if lo and hi:
                middle = self.encode((ra[lo[0] :] + rb[: hi[0]]).decode("utf-8"))
                return np.concatenate([left[: len(left) - len(a) + lo[1]], middle, right[hi[1] :]])
            window *= 2

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        """Tree concatenation of neighbouring encodings."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.empty(0, np.int32)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One vocabulary per worker process; workers are reused. The file comes with the job where the path isn't there."""
    return Codec(path if Path(path).exists() else SparkFiles.get(Path(path).name))


def shipped(spark: SparkSession, path: str) -> str:
    """The path of a vocabulary, whose file goes to the executors with the job, once for each context."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_tidewell_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return path


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def _leaf_rows(long: DataFrame, leaf_chars: int) -> DataFrame:
    """(id, row, leaf, chunk) of long texts, spread over all tasks by leaf."""
    n = F.ceil(F.length("text") / F.lit(leaf_chars)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * leaf_chars + 1, F.lit(leaf_chars)))
    tagged = long.withColumn("row", F.monotonically_increasing_id())
    return tagged.select("id", "row", F.posexplode(cuts).alias("leaf", "chunk")).repartition("id", "leaf")


def encode_texts(df: DataFrame, id_col: str | Column, text_col: str | Column, path: str = f"{TOKENIZERS}/{VOCABULARY}", leaf_chars: int = LEAF_CHARS, counts_only: bool = False) -> DataFrame:
    """(id, ids array<int>) of each row, or (id, n_tokens) where only counts are needed.

    Only texts over `leaf_chars` are shuffled, by leaf; their encodings, never their texts, meet again by id.
    """
    path = shipped(df.sparkSession, path)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    docs = spread(df.select(as_col(id_col).alias("id"), as_col(text_col).cast("string").alias("text")))
    kind = docs.schema["id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    tail = "n_tokens int" if counts_only else "ids array<int>"

    def pack(ids: pa.Array, rows: list[np.ndarray], names: list[str], more: list[pa.Array]) -> pa.RecordBatch:
        last = pa.array([len(r) for r in rows], pa.int32()) if counts_only and not more else _lists(rows)
        return pa.RecordBatch.from_arrays([ids, *more, last], names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in _slices(batches):
            yield pack(b.column("id"), [c.encode(t) for t in b.column("text").to_pylist()], ["id", "n_tokens" if counts_only else "ids"], [])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in _slices(batches, 128):
            yield pack(b.column("id"), [c.encode(t) for t in b.column("chunk").to_pylist()], ["id", "row", "leaf", "ids"], [b.column("row"), b.column("leaf")])

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        whole = codec(path).join_all([np.asarray(x.values, dtype=np.int32) for x in table.column("ids")])
        last = pa.array([len(whole)], pa.int32()) if counts_only else _lists([whole])
        return pa.table({"id": table.column("id").slice(0, 1), "n_tokens" if counts_only else "ids": last})

    near = docs.where(~is_long).mapInArrow(short, f"id {kind}, {tail}")
    far = _leaf_rows(docs.where(is_long), leaf_chars).mapInArrow(leaves, f"id {kind}, row long, leaf int, ids array<int>")
    return near.unionByName(far.groupBy("id", "row").applyInArrow(tree, f"id {kind}, {tail}"))
