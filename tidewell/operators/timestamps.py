"""Normalising written moments to UTC by expectation-maximisation over format mixtures.

Every value is read in each order of its numbers that gives a day of the calendar: year first, day first, month first.
Values whose year comes last, or has two digits, or eight digits that can't begin with a year, have several. Each
source is a mixture of the three orders for each family of such values. EM runs on the source's counts of values by the
set of orders that are valid for them: the E step shares out each set by the mixture's weights, the M step counts. A
declared order is a prior of DECLARED pseudo-counts, so it decides within its source unless the source has as many
values that contradict it. A value's posterior over its readings, which comes from the mixture alone, picks the reading
if it reaches `sure`; below, the value is marked ambiguous, and where the mixture makes all its readings impossible, it
is marked so. Values without a source form one source for each kind.

Then the zone is resolved: an offset in the value, else a zone name in it, else an abbreviation that belongs to the
place's zone, else the place's zone.

Statuses: ok, missing, unparsed, impossible, ambiguous_order, unknown_zone, skipped, repeated.

Defined cases: null and blank values are missing; redelivered ids are the caller's to fold; ties of the posterior are ambiguous; extra columns are not carried; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.instants import fold, in_zone, local_second, offset_of, readings, written, zone_abbreviations, zone_names

#: Iterations of EM; a mixture over seven counts converges geometrically.
ROUNDS = 50
#: Pseudo-counts of a declared order, and the share below which a mixture rules an order out.
DECLARED, NEVER = 1e15, 1e-6
ORDERS = ["ymd", "dmy", "mdy"]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator keeps Catalyst from copying them into each later use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def order_mixtures(parsed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(source, family, w_ymd, w_dmy, w_mdy): the weights of the orders in each family of a source.

    parsed: (source, family, date_order, valid), valid being a sum of 1, 2 and 4 for the orders. The counts by valid are
    the sufficient statistics, so EM runs on one row for each source and family.
    """
    sets = range(1, 8)
    counts = [F.count_if(F.col("valid") == v).cast("double").alias(f"n{v}") for v in sets]
    stats = parsed.groupBy("source", "family").agg(F.max("date_order").alias("declared"), *counts)
    members = {v: [k for i, k in enumerate(ORDERS) if v >> i & 1] for v in sets}
    prior = {k: F.when(F.col("declared") == k, F.lit(DECLARED)).otherwise(0.5) for k in ORDERS}

    def step(w: Column, _: Column) -> Column:
        total = {v: sum((w[k] for k in ks[1:]), w[ks[0]]) for v, ks in members.items()}
        raw = {k: prior[k] + sum((F.col(f"n{v}") * w[k] / total[v] for v in sets if k in members[v]), F.lit(0.0)) for k in ORDERS}
        n = raw["ymd"] + raw["dmy"] + raw["mdy"]
        return F.struct(*((raw[k] / n).alias(k) for k in ORDERS))

    start = F.struct(*(F.lit(1 / 3).alias(k) for k in ORDERS))
    fitted = stats.select("source", "family", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("w") if rounds else start.alias("w"))
    return fitted.select("source", "family", *(F.col("w")[k].alias(f"w_{k}") for k in ORDERS))


def normalise_moments(df: DataFrame, sure: float = 0.99, rounds: int = ROUNDS) -> DataFrame:
    """(kind, id, utc_second, status, order_posterior, order_by) of rows (kind, id, value, source, place_zone, date_order).

    order_by: `form` where the value has one reading, else `mixture`.
    """
    spark = df.sparkSession
    base = computed(df.select("kind", "id", "value", F.coalesce("source", F.concat(F.lit("\x00"), "kind")).alias("source"), "place_zone", "date_order"), v=fold(F.col("value")))
    base = computed(base, w=written(F.col("v"))).select("*", "w.*").drop("w", "value")
    base = computed(base, **readings({c: F.col(c) for c in ("family", "year", "a", "b")}))
    base = computed(base, valid=sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(ORDERS)), F.lit(0)))
    loose = F.coalesce(F.col("family").isin("last", "short"), F.lit(False))

    mixtures = order_mixtures(base.where(loose & (F.col("valid") > 0)).select("source", "family", "date_order", "valid"), rounds)
    base = base.join(mixtures, ["source", "family"], "left")
    # of a loose value each valid reading is as likely as its order is in the source; others have one reading
    like = {k: F.when(F.col(k).isNotNull(), F.when(loose, F.col(f"w_{k}")).otherwise(1.0)).otherwise(0.0) for k in ORDERS}
    base = computed(base, **{f"l_{k}": c for k, c in like.items()})
    total = F.col("l_ymd") + F.col("l_dmy") + F.col("l_mdy")
    best = F.greatest(*(F.when(F.col(f"l_{k}") > 0, F.struct(F.col(f"l_{k}").alias("l"), F.col(k).alias("day"))) for k in ORDERS))
    base = computed(base, total=total, day=F.when(total >= NEVER, best["day"]))
    agreed = sum((F.when(F.col(k) == F.col("day"), F.col(f"l_{k}")).otherwise(0.0) for k in ORDERS), F.lit(0.0))  # 11/11 reads the same either way
    posterior = F.when(F.col("day").isNotNull(), agreed / F.col("total")).when(F.col("epoch").isNotNull(), 1.0)
    year, month, day = (F.col("day") / 10000).cast("int"), (F.col("day") / 100).cast("int") % 100, F.col("day") % 100
    zero = lambda c: F.when(F.col("dated"), 0).otherwise(F.col(c))
    base = computed(base, posterior=posterior, local=local_second(year, month, day, zero("hour"), zero("minute"), zero("second")))

    # the zone: offset, then name, then an abbreviation of the place's zone, then the place's zone
    names = list(zone_names())
    base = computed(base, place=F.when(F.col("place_zone").isin(names), F.col("place_zone")), named=F.when(F.col("zone").isin(names), F.col("zone")), offset=offset_of(F.col("zone")))
    short = F.col("zone").isNotNull() & F.col("offset").isNull() & F.col("named").isNull()
    base = computed(base, short=short, at=F.when(F.col("zone").isNull(), F.col("place")).otherwise(F.col("named")))
    table = spark.createDataFrame(list(zone_abbreviations()), "place string, zone string, short_offset int")  # bounded by the zone database
    options = table.groupBy("place", "zone").agg(F.collect_set("short_offset").alias("short_offsets"))
    base = base.join(F.broadcast(options), ["place", "zone"], "left")

    utc, skipped, repeated = in_zone(F.col("local"), F.coalesce("at", F.lit("UTC")))
    # an abbreviation names the instant if its offset is in force in the place then
    fits = F.filter("short_offsets", lambda o: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(F.col("local") - o), F.coalesce("place", F.lit("UTC")))) == F.col("local"))
    base = computed(base, fits=fits, in_utc=utc, skipped=skipped & ~F.col("dated"), repeated=repeated & ~F.col("dated"))
    status = (
        F.when(F.coalesce(F.col("v"), F.lit("")) == "", "missing")
        .when(F.col("family").isNull(), "unparsed")
        .when(F.col("epoch").isNotNull(), "ok")
        .when(F.coalesce(F.col("posterior") < sure, F.lit(False)) & F.col("local").isNotNull(), "ambiguous_order")
        .when(F.col("local").isNull() | F.col("posterior").isNull(), "impossible")
        .when(F.col("offset").isNotNull(), "ok")
        .when(F.col("short"), F.when(F.size("fits") == 1, "ok").otherwise("unknown_zone"))
        .when(F.col("at").isNull(), "unknown_zone")
        .when(F.col("skipped"), "skipped")
        .when(F.col("repeated"), "repeated")
        .otherwise("ok")
    )
    second = F.coalesce("epoch", F.when(F.col("offset").isNotNull(), F.col("local") - F.col("offset")).when(F.col("short"), F.col("local") - F.try_element_at("fits", F.lit(1))).otherwise(F.col("in_utc")))
    out = computed(base, status=status)
    return out.select("kind", "id", F.when(F.col("status") == "ok", second).cast("long").alias("utc_second"), "status", F.col("posterior").alias("order_posterior"), F.when(loose & (F.col("valid").isin(3, 5, 6, 7)), "mixture").otherwise("form").alias("order_by"))
