"""Lines of a text: keys that ignore white space, width and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space within a line (fixed values: space, tab, CR, no-break space, ideographic space).
BLANK = " \t\r 　"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))


def site_of(domain: Column) -> Column:
    """The site: the domain in lower case without a leading `www.`; null for none."""
    d = F.regexp_replace(F.lower(F.trim(domain.cast("string"))), r"^www\.", "")
    return F.when(d != "", d)


def line_forms(text: Column) -> Column:
    """The lines of a text without white space, with ASCII width and every number as `0`; a blank line is ''."""
    return F.split(F.regexp_replace(F.translate(text, WIDE + BLANK, NARROW), "[0-9]+", "0"), "\n", -1)


def line_keys(text: Column) -> Column:
    """array<struct<no bigint, key bigint>> of the non-blank lines, numbered from 1."""
    forms = F.transform(line_forms(text), lambda x, i: F.struct((i + 1).cast("long").alias("no"), F.xxhash64(x).alias("key"), (x == "").alias("blank")))
    return F.transform(F.filter(forms, lambda x: ~x["blank"]), lambda x: F.struct(x["no"].alias("no"), x["key"].alias("key")))


def once(df: DataFrame, id_col: str, values: list[str], order_col: str | None = None) -> DataFrame:
    """One row for each id: the first by `order_col` (nulls last), ties by the values' hash. Null ids are left out."""
    rest = F.struct(*values)
    first = F.struct(F.col(order_col).isNull() if order_col else F.lit(False), F.col(order_col) if order_col else F.lit(0), F.xxhash64(*values))
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(rest, first).alias("__v")).select(id_col, "__v.*")
