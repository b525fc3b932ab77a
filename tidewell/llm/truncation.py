"""Values cut off by field limits or mid-transfer.

A value that ends openly (no closing mark) is judged by the first of these paths that can tell:

* `source`: an excerpt is sought in its own source text; what follows it there decides.
* `marks`: marks left by a cut (ellipses, dashes, replacement characters) after an open end.
* `prefix`: the self-join by prefix. All values of a field are sorted; a value's longer copies follow it directly, so
  one pass over the sorted values tells how they go on after it. A value that all its longer copies continue within a
  clause was cut; one that a longer copy ends a statement at is whole. The sort is a range partitioning on whole values,
  so a beginning that a third of all rows share is split like any other; what runs over a partition's end is settled
  from one summary for each partition.
* `window`: a fall-back for values without a telling longer copy, which looks for longer copies of the value's end
  alone. Prefixes of all values are hashed by their last characters, over windows of growing length, alone and together
  with the value's head. For each window the self-join counts how often it closes a statement or a value and how often
  the text goes on. The counts are blended from the shortest window to the longest (each adds ALPHA pseudo-counts of
  the one before), which gives the chance that a statement ends there; below `least` the value was cut.

Numbers count as one digit. Defined cases: null and blank values and null ids are left out; rows that repeat kind, id
and field count once, and are cut if one of them is; a closed value is whole whatever its length; equal values are
judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut_lineage, written

#: Windows in characters, short to long; True: together with the value's head.
WINDOWS = [(2, False), (4, False), (4, True), (8, False), (8, True), (12, True), (16, True)]
ALPHA = 4.0
_PAD = 16
_CLOSING = "。！？!?"
#: Marks that a cut may leave, and dots, which are one only in runs (fixed values).
_MARK = "…�-—–~"
_BLANK = " \t\r\n\u00a0\u3000"
_LONE_DOT = re.compile("(?s).*(?<![.])[.](?![.])")
_QUOTES = "”\"』」）)’'"
#: Marks between clauses, where a value may end without being cut (fixed values).
_BETWEEN = "，,、；;：:（(”’\"'」』）)\x02\x03"
#: How a longer copy goes on after a value.
WITHIN, CLAUSE, STATEMENT, WORD = 1, 2, 4, 8
_DIGITS = re.compile("[0-9]+")
_SPACE = re.compile("[ \t\r\n 　]+")
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stem_of(value: str) -> tuple[str, bool]:
    """The value without white space and marks at its end, and whether marks of a cut were there."""
    core = value.rstrip(_MARK + _BLANK + ".")
    lone = _LONE_DOT.match(value[len(core) :])  # a single dot closes the statement before it
    stem = value[: len(core) + (lone.end() if lone else 0)]
    return stem, any(c in _MARK + "." for c in value[len(stem) :])


def stem(value: Column) -> Column:
    """`stem_of` as a Column."""
    core = F.length(F.rtrim(value, F.lit(_MARK + _BLANK + ".")))
    lone = F.length(F.regexp_extract(F.substring(value, core + 1, F.length(value)), "(?s)^.*(?<![.])[.](?![.])", 0))
    return F.left(value, core + lone)


def is_closed(stem: str) -> bool:
    """Whether the last mark closes a statement, perhaps inside quotes or brackets."""
    core = stem.rstrip(_QUOTES)
    return bool(core) and (core[-1] in _CLOSING or core[-1] == ".")


def is_open(value: str) -> bool:
    return not is_closed(stem_of(value)[0])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def goes_on(text: str, at: int) -> int:
    """How a text goes on at a place."""
    c, after = text[at], text[at + 1 : at + 2]
    if c in _CLOSING or (c == "." and after in ("", " ", "\x03")):
        return STATEMENT
    return CLAUSE if c in _BETWEEN else WORD if c == " " else WITHIN


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of the sorted (field, stem, asked): (tag, pid, field, stem, kinds, lead) rows.

    tag 0: an asked stem with all ways in which its longer copies go on; 1: one whose longer copies may go on into the
    next partition; 2: the partition's first stem, with the ways in which the partition goes on after each part of it.
    """
    names = ["tag", "pid", "field", "stem", "kinds", "lead"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    pid = TaskContext.get().partitionId()
    first: tuple[str, str] | None = None
    lead, same = bytearray(), 0
    field, stack, out = None, [], []

    def done(tag: int) -> None:
        text, kinds = stack.pop()
        out.append((tag, pid, field, text, kinds, None))

    for b in batches:
        for f, text, asked in zip(b.column("field").to_pylist(), b.column("stem").to_pylist(), b.column("asked").to_pylist()):
            while stack and not (f == field and text.startswith(stack[-1][0])):
                done(0)
            field = f
            if first is None:
                first, same = (f, text), len(text)
                lead = bytearray(goes_on(text, i) for i in range(len(text)))
            elif same and f == first[0]:
                while not text.startswith(first[1][:same]):
                    same -= 1
                if same < len(text):
                    lead.extend(b"\0" * (same + 1 - len(lead)))
                    lead[same] |= goes_on(text, same)
            if stack:  # those below have heard the same from the one above them
                stack[-1][1] |= goes_on(text, len(stack[-1][0]))
            if asked:
                stack.append([text, 0])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)
        out = []
    while stack:
        done(1)
    if first:
        out.append((2, pid, *first, 0, bytes(lead)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)


def longer_copies(values: DataFrame) -> DataFrame:
    """(field, stem, kinds): how the longer copies of each asked stem go on, as a sum of flags; 0 without any.

    values: (field, stem, asked), each once. Only what a partition's end leaves open passes through the driver: a chain of stems
    that are prefixes of each other, and one summary, for each partition.
    """
    rows = values.select("field", "stem", "asked").repartitionByRange("field", "stem").sortWithinPartitions("field", "stem")
    out = written(rows.mapInArrow(_longer, "tag int, pid int, field string, stem string, kinds int, lead binary"))
    parts = sorted(out.where("tag = 2").select("pid", "field", "stem", "lead").collect())
    settled = []
    for r in out.where("tag = 1").select("pid", "field", "stem", "kinds").collect():
        kinds = r["kinds"]
        for p in parts:
            if p["pid"] > r["pid"]:
                if p["field"] != r["field"] or not p["stem"].startswith(r["stem"]):
                    break
                kinds |= p["lead"][len(r["stem"])]
        settled.append((r["field"], r["stem"], kinds))
    return out.where("tag = 0").select("field", "stem", "kinds").unionByName(values.sparkSession.createDataFrame(settled, "field string, stem string, kinds int"))


def _head(s: str) -> str:
    return s[:2] if s[:1] and ord(s[0]) > 0x2E80 else s.split(" ", 1)[0][:8]


def windows_of(values: list[str], field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of all prefixes: (levels x positions), with each position's value and length of prefix."""
    flat = np.concatenate([np.concatenate([np.zeros(_PAD, np.uint32), np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)]) for s in values]).astype(np.uint64)
    lengths = np.array([len(s) for s in values])
    starts = np.concatenate([[0], np.cumsum(lengths + _PAD)[:-1]]) + _PAD
    owner = np.repeat(np.arange(len(values)), lengths)
    within = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    at = starts[owner] + within + 1  # one past the last character of the prefix
    salt = np.array([xxhash.xxh3_64_intdigest(field.encode())], np.uint64)
    heads = np.array([np.uint64(int.from_bytes(_head(s).encode("utf-8", "surrogatepass")[-8:].ljust(8), "little")) for s in values], np.uint64)
    out = np.empty((len(WINDOWS), len(at)), np.uint64)
    for level, (k, with_head) in enumerate(WINDOWS):
        h = np.zeros(len(at), np.uint64)
        for j in range(k, 0, -1):
            h = h * _BASE + flat[at - j] + np.uint64(1)
        extra = _mix(heads * _MIX)[owner] if with_head else np.uint64(0)
        out[level] = _mix(h ^ extra ^ _mix(salt + np.full(1, level, np.uint64) * _MIX))
    return out, owner, within + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, ends, goes_on) of a batch's stems, each counted n times, combined."""
    for b in batches:
        for i in range(0, b.num_rows, 1500):
            part = b.slice(i, 1500)
            by_field: dict[str, tuple[list[str], list[int]]] = {}
            for field, stem, n in zip(part.column("field").to_pylist(), part.column("stem").to_pylist(), part.column("n").to_pylist()):
                if stem:  # an open end tells nothing: it may be a cut at the limit that many values share
                    values, times = by_field.setdefault(field, ([], []))
                    values.append(stem + ("\x03" if is_closed(stem) else "\x02"))
                    times.append(n)
            for field, (values, times) in by_field.items():
                keys, owner, n = windows_of(values, field)
                codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
                nxt = np.concatenate([codes[1:], [3]])
                lengths = np.array([len(v) for v in values])
                inner = n < lengths[owner]  # the last position is the sentinel itself
                nxt2 = np.concatenate([codes[2:], [3, 3]])
                stops = np.isin(nxt, [ord(c) for c in _CLOSING] + [3]) | ((nxt == ord(".")) & np.isin(nxt2, [3, 32]))
                use = inner & (nxt != 2)
                weight = np.array(times, np.float64)[owner][use]
                uniq, inverse = np.unique(keys[:, use].ravel(), return_inverse=True)
                total = np.bincount(inverse, weights=np.tile(weight, len(WINDOWS)), minlength=len(uniq)).astype(np.int64)
                closing = np.bincount(inverse, weights=np.tile(weight * stops[use], len(WINDOWS)), minlength=len(uniq)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uniq.astype(np.int64)), pa.array(closing), pa.array(total - closing)], names=["window", "ends", "goes_on"])


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, level, window) of the open stems' own ends."""
    for b in batches:
        rows, keys = [], []
        for i, (field, stem) in enumerate(zip(b.column("field").to_pylist(), b.column("stem").to_pylist())):
            if stem:
                rows.append(i)
                keys.append(windows_of([stem], field)[0][:, -1].astype(np.int64))
        at = pa.array(np.repeat(np.array(rows, np.int64), len(WINDOWS)))
        yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), pa.array(np.tile(np.arange(len(WINDOWS), dtype=np.int32), len(rows))), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))], names=["k1", "k2", "level", "window"])


def ending_chances(stems: DataFrame, asked: DataFrame) -> DataFrame:
    """(k1, k2, chance): the chance that a statement ends where the stem does. stems: (field, stem, n); asked: with k1, k2."""
    counts = stems.select("field", "stem", "n").mapInArrow(_counts, "window long, ends long, goes_on long")
    counts = counts.groupBy("window").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    windows = asked.select("k1", "k2", "field", "stem").mapInArrow(_questions, "k1 long, k2 long, level int, window long")
    # the planner takes what Python gives for as large as what it gets, so the joins say that both sides are shuffled
    got = windows.join(counts.hint("merge"), "window", "left").groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("level", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("goes_on", F.lit(0)).alias("goes_on")))).alias("w"))
    blend = F.aggregate("w", F.lit(0.1), lambda p, x: (x["ends"].cast("double") + ALPHA * p) / (x["ends"] + x["goes_on"] + ALPHA))
    return got.select("k1", "k2", blend.alias("chance"))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For an excerpt and its source: 1 cut, 0 whole, null not found."""
    for b in batches:
        out = []
        for value, text in zip(b.column("value").to_pylist(), b.column("text").to_pylist()):
            stem = _SPACE.sub("", stem_of(value)[0])
            verdict = None
            if text and len(stem) >= 4:
                # inside a line white space doesn't count, at its end it does
                body = "\n".join(_SPACE.sub("", line) for line in text.split("\n"))
                for k in (len(stem), 24, 16, 10):  # the whole excerpt; shorter ends where it was damaged on its way
                    tail, at = stem[-k:], -1
                    while (at := body.find(tail, at + 1)) >= 0:
                        after = body[at + len(tail) : at + len(tail) + 1]
                        ends = after in ("", "\n") or after in _CLOSING or (after == "." and not body[at + len(tail) + 1 : at + len(tail) + 2].isdigit())
                        verdict = 0 if ends or verdict == 0 else 1
                    if verdict is not None or len(stem) < k:
                        break
            out.append(verdict)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "id", "field")), pa.array(out, pa.int32())], names=["kind", "id", "field", "verdict"])


def _filled(values: DataFrame) -> DataFrame:
    return values.where(F.col("id").isNotNull() & F.col("value").isNotNull() & (F.length(F.translate("value", _BLANK, "")) > 0))


def judged_values(values: DataFrame, sources: DataFrame | None = None, least: float = 0.012) -> DataFrame:
    """(kind, id, field, grp, path, cut) of all open values: what judged them, and how.

    values: (kind, id, field, value, grp, ref). sources: (ref, text), the texts that excerpts were taken from.
    """
    types = {f.name: f.dataType.simpleString() for f in values.schema}
    base = _filled(values.select("kind", "id", "field", "value", "grp", "ref")).withColumn("bare", stem(F.col("value")))
    base = base.withColumn("closed", F.rtrim("bare", F.lit(_QUOTES)).rlike("[。！？!?.]$")).withColumn("marked", F.substring("value", F.length("bare") + 1, F.length("value")).rlike("[…�.—–~-]"))
    base = base.withColumn("stem", F.regexp_replace("bare", "[0-9]+", "0")).drop("bare")
    base = written(base.withColumns({"k1": F.xxhash64("field", "stem"), "k2": F.xxhash64(F.lit(1), "field", "stem")}))
    opened = base.where(~F.col("closed"))

    stems = written(base.groupBy("field", "stem").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("closed") & ~F.col("marked")).alias("asked"), F.first("k1").alias("k1"), F.first("k2").alias("k2")))
    asked = stems.where("asked")
    kinds = longer_copies(stems.where("stem <> ''"))
    verdict = F.when(F.col("kinds").bitwiseAND(STATEMENT) > 0, 0).when(F.col("kinds") == WITHIN, 1)
    told = cut_lineage(kinds.select(F.xxhash64("field", "stem").alias("k1"), F.xxhash64(F.lit(1), "field", "stem").alias("k2"), verdict.alias("longer")).where("longer IS NOT NULL"))
    left = asked.join(told.hint("merge"), ["k1", "k2"], "left_anti")
    chances = ending_chances(stems, left).withColumn("longer", F.lit(None).cast("int"))
    known = chances.unionByName(told.withColumn("chance", F.lit(None).cast("double")))
    judged = opened.join(known.hint("merge"), ["k1", "k2"], "left")
    if sources is not None:
        cited = opened.where(F.col("ref").isNotNull()).select("kind", "id", "field", "value", "ref").join(sources.select("ref", "text").hint("merge"), "ref").select("kind", "id", "field", "value", "text")
        verdicts = cited.mapInArrow(_follow, ", ".join(f"{c} {types[c]}" for c in ("kind", "id", "field")) + ", verdict int").groupBy("kind", "id", "field").agg(F.max("verdict").alias("verdict"))
        judged = judged.join(verdicts.hint("merge"), ["kind", "id", "field"], "left")
    else:
        judged = judged.withColumn("verdict", F.lit(None).cast("int"))
    path = F.when(F.col("verdict").isNotNull(), "source").when(F.col("marked"), "marks").when(F.col("longer").isNotNull(), "prefix").otherwise("window")
    cut = F.when(F.col("path") == "source", F.col("verdict") == 1).when(F.col("path") == "prefix", F.col("longer") == 1).otherwise(F.coalesce(F.col("marked") | (F.col("chance") < least), F.lit(False)))
    return judged.withColumn("path", path).select("kind", "id", "field", "grp", "path", cut.alias("cut"))


def truncated(values: DataFrame, sources: DataFrame | None = None, least: float = 0.012) -> DataFrame:
    """(kind, id, field, grp, path) of values that were cut, each once."""
    cut = judged_values(values, sources, least).where("cut")
    return cut.groupBy("kind", "id", "field").agg(F.min(F.struct("path", "grp")).alias("v")).select("kind", "id", "field", "v.grp", "v.path")


def truncation_rates(values: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, field, grp, n_values, n_cut, rate) over all non-blank values, repeated ones counted once."""
    keys = ["kind", "field", "grp"]
    all_ = _filled(values).select(*keys, "id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    cut = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cut"))
    on = [all_[k].eqNullSafe(cut[k]) for k in keys]
    out = all_.join(cut, on, "left").select(*(all_[k] for k in keys), "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return out.withColumn("rate", F.col("n_cut") / F.col("n_values"))
