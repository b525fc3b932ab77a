"""Mapping of freely typed values to a reference list.

Each reference entry has spelled-out variants (ALIASES gives the short forms of its words; place names may lose their
suffix or be left out). A symmetric-delete dictionary holds every variant and every variant with up to `depth`
characters taken out; a value, cleaned of wrappers, meets it by itself and by its own deletions of as many. Depth 1
reaches every single edit; two edits within the default limit are doubled or look-alike characters, for which both sides
also have a key with those folded. A higher limit needs a greater depth. Candidates that share a key are ranked by
weighted Damerau-Levenshtein distance: a doubled character, a swap of neighbours, a letter of the same sound or shape
and a lost character are cheap, any other change is too dear to match, as another place or body is often one character
away. Ties go to the entry that exact values name most often; what is left is a miss.

The dictionary is broadcast while it has at most BROADCAST_KEYS keys, counted after the variants and deletions are
made, and joined by key beyond. Distances are computed once for each distinct cleaned value, so a value that a third of
all rows share costs no more.

Defined cases: null and blank values, null ids and null list items give no row (items keep their positions); general
values and unknown bodies give ref_id 0; a value that equals a variant of several entries is a tie; repeated ids are
the caller's to fold; an empty reference list makes every value a miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import cut_lineage, written

#: Short forms of words in reference names (fixed values).
ALIASES = {
    "人民政府": ["人民政府", "政府"],
    "住房和城乡建设局": ["住房和城乡建设局", "住房城乡建设局", "住建局"],
    "教育局": ["教育局"],
    "卫生健康局": ["卫生健康局", "卫健局"],
    "市场监督管理局": ["市场监督管理局", "市场监管局", "市监局"],
    "有限公司": ["有限公司", "有限责任公司", "公司", ""],
}
#: Words around a name that speak of the body all the same (fixed values).
BEFORE = ["据", "当地的", "当地", "涉事的", "涉事", "有关", "来自", "某"]
AFTER = ["值班室", "相关负责人", "有关负责人", "负责人", "(回复)", "(官方回应)", ":回应方", "回应方", "方面", "工作人员", "发言人", "代表", "职工", "员工", "的"]
#: Traditional and simplified forms (fixed values).
TRADITIONAL = "區監衛設學業醫務場東會員體關館鄉濟團應與門臺廣縣聯號實產權車廠灣嶺橋崗蘆鷺螢葦樺櫟霽嵐澤氣飲檢測術管運國長發書總處黨"
SIMPLIFIED = "区监卫设学业医务场东会员体关馆乡济团应与门台广县联号实产权车厂湾岭桥岗芦鹭萤苇桦栎霁岚泽气饮检测术管运国长发书总处党"
#: Characters that stand for each other by sound or shape (fixed values).
ALIKE = ["区曲", "局菊", "市事", "教较", "康慷", "管馆", "公工", "政正", "卫位", "住驻", "建健", "物务", "技计", "院园", "监间", "督都", "生声", "业叶", "司思", "测侧", "检捡"]
#: Costs; a candidate dearer than LIMIT is no match.
DOUBLED, SWAP, SIMILAR, LOST, OTHER, LIMIT = 0.5, 0.6, 0.5, 0.8, 1.5, 1.0
#: Keys of a dictionary that is broadcast; a key with its variant takes some 100 bytes.
BROADCAST_KEYS = 500_000

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_ALIKE = {(a, b) for s in ALIKE for a in s for b in s if a != b}


def cleaned(value: Column) -> Column:
    """The value without width, wrappers, blanks, invisible characters and traditional forms."""
    v = F.translate(value, _WIDE + TRADITIONAL, _NARROW + SIMPLIFIED)
    v = F.regexp_replace(v, "[\\s\\u00a0\\u3000\\u00ad\\u200b-\\u200f\\u2060\\ufeff·•'\"“”‘’「」『』【】《》〈〉\\[\\]—_-]", "")
    before = "|".join(map(re.escape, BEFORE))
    after = "|".join(map(re.escape, AFTER))
    return F.regexp_replace(F.regexp_replace(v, f"^(?:{before})+", ""), f"(?:{after}|\\([^()]*\\))+$", "")


def variants(name: str) -> set[str]:
    """All spelled-out forms of a reference name."""
    heads = {""}
    rest = name
    if m := re.match("(.{2,3})(市|州|县)(.+)", name):  # the city may lose its suffix or be left out
        city, suffix, rest = m.groups()
        heads = {city + suffix, city, ""}
    out = {rest}
    for word, forms in ALIASES.items():
        out = {o[: -len(word)] + f for o in out for f in forms if o.endswith(word)} | {o for o in out if not o.endswith(word)}
    full = {h + o for h in heads for o in out}
    if m := re.match("(.{1,3}区)(.+)", rest):
        if not any(m.group(2).endswith(w) for w in ALIASES):  # a body with a name of its own needs no district
            full |= {h + m.group(2) for h in heads}
    return {v for v in full if len(v) >= 3}


def _alias_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        refs, names = [], []
        for ref, name in zip(b.column("ref_id").to_pylist(), b.column("name").to_pylist()):
            for v in sorted(variants(name)):
                refs.append(ref)
                names.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(names, pa.string())], names=["ref_id", "alias"])


def deletions(value: Column, depth: int = 1) -> Column:
    """The value and the value without up to `depth` of its characters; null for null and ''."""

    def less(v: Column) -> Column:
        n = F.length(v)
        one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, n)))
        return F.when(n > 0, one).otherwise(F.array().cast("array<string>"))

    out = F.array(value)
    for _ in range(depth):
        out = F.array_distinct(F.concat(F.array(value), F.flatten(F.transform(out, less))))
    return F.when(F.length(value) > 0, out)


def keys_of(value: Column, depth: int = 1) -> Column:
    """The deletions, and the value with runs of a character and characters of one sound or shape as one."""
    folded = F.translate(value, "".join(s[1] for s in ALIKE), "".join(s[0] for s in ALIKE))
    return F.concat(deletions(value, depth), F.array(F.concat(F.lit("\x01"), F.regexp_replace(folded, "(.)\\1+", "$1"))))


def weighted_distance(value: str, alias: str, limit: float = float("inf")) -> float:
    """Weighted Damerau-Levenshtein distance from a reference form to a typed value; infinite beyond the limit."""
    n, m = len(value), len(alias)
    inf = float("inf")
    if n == m and value == alias:
        return 0.0
    before: list[float] = []
    last = [j * LOST for j in range(m + 1)]
    for i in range(1, n + 1):
        a = value[i - 1]
        extra = DOUBLED if (i > 1 and value[i - 2] == a) or (i < n and value[i] == a) else OTHER
        row = [i * OTHER] + [inf] * m
        for j in range(1, m + 1):
            b = alias[j - 1]
            best = min(last[j - 1] + (0 if a == b else SIMILAR if (a, b) in _ALIKE else OTHER), last[j] + extra, row[j - 1] + LOST)
            if i > 1 and j > 1 and a != b and a == alias[j - 2] and value[i - 2] == b:
                best = min(best, before[j - 2] + SWAP)
            row[j] = best
        if min(row) > limit and min(last) > limit:  # no later cell can come back below it
            return inf
        before, last = last, row
    return last[m]


def _weigh(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = np.array([weighted_distance(v, a, limit) for v, a in zip(b.column("form").to_pylist(), b.column("alias").to_pylist())], np.float64)
            keep = pa.array(costs <= limit)
            yield pa.RecordBatch.from_arrays([b.column("form").filter(keep), b.column("ref_id").filter(keep), pa.array(costs).filter(keep)], names=["form", "ref_id", "cost"])

    return run


def match_forms(forms: DataFrame, reference: DataFrame, id_col: str, name_col: str, depth: int = 1, limit: float = LIMIT) -> DataFrame:
    """(form, ref_id, cost) of every distinct (form, n) that an entry matches; n is the number of rows of the form."""
    listed = reference.select(F.col(id_col).cast("long").alias("ref_id"), F.col(name_col).alias("name")).where("ref_id IS NOT NULL AND name IS NOT NULL")
    aliases = listed.mapInArrow(_alias_rows, "ref_id long, alias string")
    keyed = written(aliases.select("ref_id", "alias", F.explode(keys_of(F.col("alias"), depth)).alias("key")))
    small = keyed.count() <= BROADCAST_KEYS
    asked = forms.select("form", F.explode(keys_of(F.col("form"), depth)).alias("key"))
    pairs = asked.join(F.broadcast(keyed) if small else keyed.hint("merge"), "key").select("form", "alias", "ref_id")
    spark = forms.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.repartition(tasks, "form").distinct()  # few bytes but much work: as many tasks as there are, by form
    costs = cut_lineage(pairs.mapInArrow(_weigh(limit), "form string, ref_id long, cost double").groupBy("form", "ref_id").agg(F.min("cost").alias("cost")))
    exact = costs.where("cost = 0").join(forms, "form").groupBy("ref_id").agg(F.sum("n").alias("named"))
    ranked = costs.join(exact, "ref_id", "left").withColumn("named", F.coalesce("named", F.lit(0)))
    return ranked.groupBy("form").agg(F.min_by(F.struct("ref_id", "cost"), F.struct("cost", -F.col("named"), "ref_id")).alias("best")).select("form", "best.*")


def map_to_reference(values: DataFrame, reference: DataFrame, id_col: str, name_col: str, depth: int = 1, limit: float = LIMIT) -> DataFrame:
    """(kind, id, pos, value, ref_id, cost) of every non-blank value; ref_id 0 and null cost for a miss.

    values: (kind, id, pos, value). depth: deletions on either side; limit: the dearest match.
    """
    base = values.where(F.col("id").isNotNull() & F.col("value").isNotNull() & (F.regexp_replace("value", "[\\s\\u00a0\\u3000]", "") != ""))
    base = base.select("kind", "id", "pos", "value", cleaned(F.col("value")).alias("form"))
    forms = cut_lineage(base.groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    matched = match_forms(forms, reference, id_col, name_col, depth, limit)
    return base.join(matched, "form", "left").select("kind", "id", "pos", "value", F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id"), "cost")


def misses(mapped: DataFrame) -> DataFrame:
    """(value, n): values without an entry and how many rows hold them."""
    return mapped.where("ref_id = 0").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
