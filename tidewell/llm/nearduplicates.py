"""Near-duplicate records by one-permutation hashing.

1. One pass over the records hashes each record's runs of characters once and yields its node (the 128-bit hash of its
   text without white space), a one-permutation signature of `bands * rows` bins (empty bins are filled by optimal
   densification: each probes a fixed random sequence of bins until it meets a full one), and a sketch of SKETCH_BITS
   bits of the same bins. What follows works on these features; texts are read again only for pairs near enough.
2. Exact copies share their node, so a text that a third of all rows share is one node from here on.
3. Bands of the signature are buckets. Each bucket gives star-shaped edges: one member is the centre, and every other
   member gets one edge to it, so n members give n - 1 edges. The centre's order differs from band to band, so that
   members of one group meet in several stars. Of a batch's members of one bucket only the local centre is sent on, so
   a hot bucket shrinks by the size of a batch before the shuffle.
4. Edges are weighed by the sketches (the chance to lose a pair at the threshold is below 1e-4) and then exactly, on
   whole texts. Only texts that an edge needs are shuffled: a bit table of at most WORDS words, whatever the data's
   size, finds most of the others where they are read.
5. Edges that hold join into classes. Pairs of one class that no edge has weighed meet in cells of two blocks of BLOCK
   members, where the join's condition compares their sketches: no class is gathered in one task, and only pairs near
   enough leave the join, to be weighed exactly. Copies are attached at the end, in shares of SHARE.

Nodes meet in buckets by their first 64 bits. Two texts that agree in these and differ in the rest share a bucket row,
and both are weighed from there on, so that no text is lost to a collision.

Defined cases: rows with null id are left out; redelivered ids count once; null and empty texts, and records with
fewer characters than a run, belong to no pair; null titles count as empty; ties are broken by hash and id; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.lines import BLANK, once
from tidewell.session import cut_lineage, discard, spread, written

RUN = 5
BANDS, ROWS = 80, 6
SKETCH_BITS = 256
#: Most sketch bits that may differ: the expectation at similarity 0.6 is 51, its deviation 6.4.
SKETCH_SLACK = 4.0
#: Members of a block of a large class, and copies that one task attaches to one text.
BLOCK, SHARE = 512, 1000
#: Words of 64 bits in the table of wanted ids; it is broadcast, and this is its bound.
WORDS = 1 << 20

_BLANKS = np.array([ord(c) for c in BLANK + "\n"], np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
_SKETCH = ["s0", "s1", "s2", "s3"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(codes: np.ndarray) -> np.ndarray:
    """A hash of the run of RUN characters that begins at each place."""
    n = len(codes) - RUN + 1
    a = codes.astype(np.uint64)
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(RUN if n > 0 else 0):
        h = h * _ODD + a[i : n + i] + np.uint64(1)
    return _mix(h)


def run_hashes(text: str) -> np.ndarray:
    """Distinct hashes of all runs of RUN characters, sorted."""
    return np.unique(_rolled(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))


def bodies_of(titles: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all bodies (title and text without white space) in a row, and each one's number of them.

    Null and empty texts have none.
    """
    whole = [(t or "") + x if x else "" for t, x in zip(titles, texts)]
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.ones(len(codes), bool)
    for c in _BLANKS:
        keep &= codes != c
    upto = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum([len(w) for w in whole])
    return codes[keep], np.diff(upto[ends], prepend=0)


def _probes(bins: int, tries: int = 64) -> np.ndarray:
    """The bins that each empty bin probes, one row for each try."""
    k = np.arange(bins, dtype=np.uint64)[None, :] + (np.arange(tries, dtype=np.uint64)[:, None] + np.uint64(1)) * np.uint64(1_000_003)
    return (_mix(k * _ODD) % np.uint64(bins)).astype(np.int64)


def signatures(codes: np.ndarray, lengths: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures with optimal densification; a row for each body, of at least RUN characters each."""
    h = _rolled(codes)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the body's end
    inside = np.flatnonzero(left >= RUN)
    h = h[inside]
    sig = np.full(len(lengths) * bins, _NONE, np.uint64)
    np.minimum.at(sig, owner[inside] * bins + (h % np.uint64(bins)).astype(np.int64), h)
    sig = sig.reshape(len(lengths), bins)
    out = sig.copy()
    row, col = np.nonzero(sig == _NONE)
    for t, probe in enumerate(_probes(bins)):
        if not len(row):
            break
        got = sig[row, probe[col]]
        full = got != _NONE
        out[row[full], col[full]] = _mix(got[full] + np.uint64(t + 1))
        row, col = row[~full], col[~full]
    if len(row):  # tiny sets
        out[row, col] = _mix(sig.min(axis=1)[row])
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each of SKETCH_BITS minima, as 64-bit words; bits agree in (1 + similarity) / 2 of the places."""
    bits = (_mix(sig[:, :SKETCH_BITS] ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _ODD
    for r in range(parts.shape[2]):
        key = _mix(key ^ parts[:, :, r])
    return key


def _features(bands: int, rows: int):
    """Rows (id, at, title, text) to (id, at, node, rid, sketch, bands); bodies shorter than a run give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                codes, lengths = bodies_of(part.column("title").to_pylist(), part.column("text").to_pylist())
                ok = lengths >= RUN
                codes, mask, lengths = codes[np.repeat(ok, lengths)], pa.array(ok), lengths[ok]
                sig = signatures(codes, lengths, bands * rows)
                nodes = _nodes(codes, lengths)
                rids = np.array([int.from_bytes(n[:8], "big", signed=True) for n in nodes], np.int64)
                words = sketches(sig) if len(sig) else np.empty((0, 4), np.int64)
                keys = _band_keys(sig, bands).astype("<u8").tobytes()
                packed = [keys[k : k + 8 * bands] for k in range(0, len(keys), 8 * bands)]
                yield pa.RecordBatch.from_arrays([part.column("id").filter(mask), part.column("at").filter(mask), pa.array(nodes, pa.binary()), pa.array(rids), *(pa.array(words[:, k]) for k in range(4)), pa.array(packed, pa.binary())], names=["id", "at", "node", "rid", *_SKETCH, "bands"])

    return run


def _nodes(codes: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [xxhash.xxh3_128_digest(codes[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]


def _star(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combines one batch: (bucket, centre, member) rows; the member of a row that sends a centre on is that centre."""
    rank = _mix(ids.astype(np.uint64)[:, None] ^ np.arange(keys.shape[1], dtype=np.uint64)[None, :] * _ODD).ravel()
    k, i = keys.ravel(), np.repeat(ids, keys.shape[1])
    order = np.lexsort((rank, k))
    k, i = k[order], i[order]
    head = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    centre = i[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))] if len(k) else i
    bucket = np.where(head, k, _mix(k ^ i.astype(np.uint64)))  # local edges need no bucket: spread them
    return bucket.astype(np.int64), centre, i


def candidate_edges(features: DataFrame, bands: int = BANDS) -> DataFrame:
    """(a, b), a < b: star edges of all buckets, each once. features: (rid bigint, bands binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4000):
                part = b.slice(i, 4000)
                ids, at = np.unique(part.column("rid").to_numpy(), return_index=True)
                keys = np.frombuffer(b"".join(part.column("bands").to_pylist()), "<u8").reshape(-1, bands)[at]
                bucket, centre, member = _star(keys, ids)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(centre), pa.array(member)], names=["bucket", "centre", "member"])

    stars = features.select("rid", "bands").mapInArrow(run, "bucket long, centre long, member long").repartition("bucket")

    # within a partition a bucket's centres lie together after a sort; the first is the bucket's centre
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_bucket, last_centre = None, -1
        for b in batches:
            k, c, m = (b.column(x).to_numpy() for x in ("bucket", "centre", "member"))
            local = m != c
            kk, cc = k[~local], c[~local]
            if len(kk):
                head = np.concatenate([[kk[0] != last_bucket], kk[1:] != kk[:-1]])
                at = np.maximum.accumulate(np.where(head, np.arange(len(kk)), -1))
                centre = np.where(at >= 0, cc[np.maximum(at, 0)], last_centre)
                last_bucket, last_centre = kk[-1], int(centre[-1])
                x = np.concatenate([centre[~head], c[local]])
                y = np.concatenate([cc[~head], m[local]])
            else:
                x, y = c[local], m[local]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            keep = lo != hi
            yield pa.RecordBatch.from_arrays([pa.array(lo[keep]), pa.array(hi[keep])], names=["a", "b"])

    return stars.sortWithinPartitions("bucket", F.xxhash64("bucket", "centre")).mapInArrow(link, "a long, b long").distinct()


def _differing(x: str, y: str) -> Column:
    """Number of differing sketch bits of two rows."""
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))


def _near(edges: DataFrame, known: DataFrame, allowed: int) -> DataFrame:
    """(a, b) nodes, a < b, of the edges whose sketches differ in at most `allowed` bits."""
    x = edges.join(known.hint("merge"), edges.a == known.rid).select("b", F.struct("node", *_SKETCH).alias("x"))
    y = known.select(F.col("rid").alias("b"), F.struct("node", *_SKETCH).alias("y"))
    both = x.join(y.hint("merge"), "b").where((_differing("x", "y") <= allowed) & (F.col("x.node") != F.col("y.node")))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _bodies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, body) of the wanted (node, id). rows: (id, title, text)."""
    spot = F.xxhash64("id")
    word, bit = F.shiftrightunsigned(spot, 6).bitwiseAND(WORDS - 1), spot.bitwiseAND(63).cast("int")
    words = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    maybe = rows.withColumn("word", word).join(F.broadcast(words), "word").where(F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                codes, lengths = bodies_of(part.column("title").to_pylist(), part.column("text").to_pylist())
                nodes, ends = _nodes(codes, lengths), np.cumsum(lengths)
                text = [codes[e - n : e].tobytes().decode("utf-32-le", "surrogatepass") for e, n in zip(ends.tolist(), lengths.tolist())]
                mask = pa.array([n == w for n, w in zip(nodes, part.column("node").to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()).filter(mask), pa.array(text, pa.string()).filter(mask)], names=["node", "body"])

    hit = maybe.select("id", "title", "text").join(wanted.hint("merge"), "id")
    return hit.select("title", "text", "node").mapInArrow(run, "node binary, body string").dropDuplicates(["node"])


def _verified(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold, by their whole texts."""
    left = bodies.select(F.col("node").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "x", "y")]
            out = np.empty(batch.num_rows, np.float64)
            for i, (a, b, x, y) in enumerate(zip(*cols)):
                if len(known) > 256:
                    known.clear()
                p = known[a] if a in known else known.setdefault(a, run_hashes(x))
                q = known[b] if b in known else known.setdefault(b, run_hashes(y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                out[i] = both / max(1, len(p) + len(q) - both)
            keep = out >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array(out[keep])], names=["a", "b", "similarity"])

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, similarity double")


def classes_of(edges: DataFrame) -> DataFrame:
    """(rid, class): connected components of (a, b) edges; a class is named by its smallest member.

    Classes are contracted: in each round a class joins its neighbour of the least rank, ranks being hashes drawn anew
    each round, and edges between classes replace edges between members until none is left. A round takes away a fixed
    share of the classes that still have edges, whatever the shape, so even a chain ends after about log n rounds. All
    is written to the shared folder round by round, so a lost executor costs one round at most.
    """
    links = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct())
    labels = written(links.select(F.col("u").alias("rid"), F.col("u").alias("class")).distinct())
    for step in count():
        rank = lambda c: F.xxhash64(F.lit(step), F.col(c))  # noqa: B023, E731
        best = links.groupBy("u").agg(F.min(F.struct(rank("v").alias("rank"), "v")).alias("m"))
        to = best.select("u", F.when(F.col("m.rank") < rank("u"), F.col("m.v")).otherwise(F.col("u")).alias("to"))
        to = written(to.join(to.select(F.col("u").alias("to"), F.col("to").alias("far")), "to").select("u", F.col("far").alias("to")))
        moved = labels.join(to, labels["class"] == to.u, "left").select("rid", F.coalesce("to", "class").alias("class"))
        rest = links.join(to.withColumnRenamed("to", "x"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
        old, labels = (labels, links, to), written(moved)
        links = written(rest.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        for table in old:
            discard(table)
        if links.isEmpty():
            return labels.join(labels.groupBy("class").agg(F.min("rid").alias("first")), "class").select("rid", F.col("first").alias("class"))


def _class_pairs(labels: DataFrame, known: DataFrame, done: DataFrame, allowed: int, block: int = BLOCK) -> DataFrame:
    """(a, b) nodes of one class that are near by their sketches and not in `done`. known: (node, sketch)."""
    sized = labels.join(labels.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "class")
    sized = sized.join(known.hint("merge"), sized.rid == known.node)
    ends = F.ceil(F.col("n") / block).cast("int") - 1
    blocks = sized.select("class", "node", *_SKETCH, F.pmod(F.xxhash64("node"), ends + 1).cast("int").alias("block"), ends.alias("ends"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ends")))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    x, y = cells.alias("x"), cells.alias("y")
    same = (F.col("x.class") == F.col("y.class")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    cross = F.when(F.col("x.i") == F.col("x.j"), F.col("x.node") < F.col("y.node")).otherwise((F.col("x.block") == F.col("x.i")) & (F.col("y.block") == F.col("y.j")))
    pairs = x.join(y.hint("merge"), same & cross & (_differing("x", "y") <= allowed)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return pairs.join(done.hint("merge"), ["a", "b"], "left_anti")


def _found(df: DataFrame, id_col: str, title_col: str, text_col: str, order_col: str | None, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, node) of each id with a body, (a, b) of all pairs of nodes, and (rid, class) of the nodes in pairs."""
    rows = df.select(F.col(id_col).alias("id"), (F.col(order_col) if order_col else F.lit(0)).alias("at"), F.col(title_col).cast("string").alias("title"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    features = written(spread(rows).mapInArrow(_features(BANDS, ROWS), f"id {types['id']}, at {types['at']}, node binary, rid long, s0 long, s1 long, s2 long, s3 long, bands binary"))
    members = cut_lineage(once(features.select("id", "at", "node"), "id", ["node"], "at"))
    known = features.select("rid", "node", *_SKETCH).dropDuplicates(["node"])

    allowed = int(SKETCH_BITS * (1 - threshold) / 2 + SKETCH_SLACK * (SKETCH_BITS * (1 + threshold) / 2 * (1 - threshold) / 2) ** 0.5)
    near = cut_lineage(_near(candidate_edges(features), known, allowed))
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    wanted = cut_lineage(members.join(ends.hint("merge"), "node").groupBy("node").agg(F.min("id").alias("id")))
    bodies = written(_bodies(rows.select("id", "title", "text"), wanted))

    direct = cut_lineage(_verified(near, bodies, threshold))
    labels = classes_of(direct)
    rest = _verified(_class_pairs(labels, known.select("node", *_SKETCH), near, allowed), bodies, threshold)
    return members, direct.unionByName(rest).select("a", "b"), labels


def near_duplicates(df: DataFrame, id_col: str, title_col: str, text_col: str, order_col: str | None, threshold: float) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of ids whose similarity reaches the threshold."""
    members, found, _ = _found(df, id_col, title_col, text_col, order_col, threshold)

    # copies: of one text, and of the two texts of each pair; the one side in shares, the other sent to each of them
    sized = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / SHARE).cast("int"))
    own = members.join(sized.where("n > 1").hint("merge"), "node").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    to_all = own.select("node", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    within = to_all.join(own.select("node", "share", F.col("id").alias("y")), ["node", "share"]).where("x < y").select("x", "y")

    ends = found.join(sized.select(F.col("node").alias("b"), "shares").hint("merge"), "b")
    shared = members.join(sized.select("node", "shares").hint("merge"), "node")
    left = ends.join(members.select(F.col("node").alias("a"), F.col("id").alias("x")).hint("merge"), "a").select("b", "x", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    right = shared.select(F.col("node").alias("b"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    across = left.join(right.hint("merge"), ["b", "share"]).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, id_col: str, title_col: str, text_col: str, order_col: str | None, threshold: float) -> DataFrame:
    """(id, group_id, n_links): each id with a body, the smallest id of its class, and the other texts near its own.

    The form for collections in which texts have so many copies that pairs of ids are too many to write.
    """
    members, found, labels = _found(df, id_col, title_col, text_col, order_col, threshold)
    links = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classed = members.join(labels.withColumnRenamed("rid", "node").hint("merge"), "node", "left").join(links.hint("merge"), "node", "left")
    classed = cut_lineage(classed.select("id", F.coalesce("class", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    first = classed.groupBy("class").agg(F.min("id").alias("group_id"))
    return classed.join(first.hint("merge"), "class").select("id", "group_id", "n_links")
