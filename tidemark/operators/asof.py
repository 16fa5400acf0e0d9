"""As-of and trailing-window joins of few keys and many ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunk(ts: str, chunk_ms: int) -> Column:
    return F.floor(F.col(ts) / chunk_ms).cast("long")


def asof_join(left: DataFrame, right: DataFrame, *, keys: list[str], left_ts: str, right_ts: str, seq: str, chunk_ms: int, after: str | Column | None = None, max_age_ms: int | None = None, name: str = "last") -> DataFrame:
    """``left`` with a struct ``name``: the last right row at or before the left instant, or null.

    Of rows at the same instant the one with the largest ``seq`` counts. ``after`` is an
    exclusive lower bound; ``max_age_ms`` an inclusive largest age. Left rows all stay, repeated
    ones too; null instants or keys match nothing.

    A handful of keys hold all rows, so rows are dealt by key and chunk of time. A chunk's last
    row before it is carried in: one row per chunk is found by a combined aggregation, and only
    these few rows see a window per key. Results don't depend on ``chunk_ms``.
    """
    values = [c for c in right.columns if c not in keys]
    row = F.struct(F.col(right_ts).alias("__ts"), F.col(seq).alias("__seq"), F.struct(*values).alias("__row"))
    r = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(right_ts).alias("__at"), _chunk(right_ts, chunk_ms).alias("__chunk"), row.alias("__r")).filter(F.col("__at").isNotNull())
    names = [f"__k_{k}" for k in keys]
    dated = left.withColumns({f"__k_{k}": F.col(k) for k in keys} | {"__at": F.col(left_ts), "__chunk": _chunk(left_ts, chunk_ms)})
    own = F.struct(*[F.col(c) for c in left.columns]).alias("__l")
    asked = dated.select(*names, "__at", "__chunk", own)
    last = r.groupBy(*names, "__chunk").agg(F.max(F.struct("__r.__ts", "__r.__seq")).alias("__m"), F.max_by("__r", F.struct("__r.__ts", "__r.__seq")).alias("__r")).drop("__m")
    chunks = asked.select(*names, "__chunk").distinct().withColumn("__asks", F.lit(True))
    both = last.join(chunks, [*names, "__chunk"], "full")
    before = Window.partitionBy(*names).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("__r", F.last("__r", ignorenulls=True).over(before)).filter("__asks and __r is not null").select(*names, F.col("__chunk"), "__r")
    none_l = F.lit(None).cast(asked.schema["__l"].dataType).alias("__l")
    rows = r.select(*names, "__chunk", "__at", "__r", none_l).union(carried.select(*names, "__chunk", F.col("__r.__ts").alias("__at"), "__r", none_l))
    rows = rows.withColumn("__side", F.lit(0)).union(asked.select(*names, "__chunk", "__at", F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), "__l", F.lit(1)))
    upto = Window.partitionBy(*names, "__chunk").orderBy("__at", "__side", F.col("__r.__seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__r", F.last("__r", ignorenulls=True).over(upto)).filter("__side = 1").select("__l.*", "__at", "__r")
    fits = F.col("__at").isNotNull()
    if after is not None:
        fits = fits & (F.col("__r.__ts") > (F.col(after) if isinstance(after, str) else after))
    if max_age_ms is not None:
        fits = fits & (F.col("__at") - F.col("__r.__ts") <= max_age_ms)
    return found.select(*left.columns, F.when(fits, F.col("__r.__row")).alias(name))


def window_join(prompts: DataFrame, stream: DataFrame, *, keys: list[str], at: str, ts: str, window_ms: int, outer: bool = False) -> DataFrame:
    """Each prompt beside its stream rows in (at - window, at].

    Both sides are dealt by key and bucket of one window's width: a prompt goes to the two
    buckets its window touches, a row to its own, and the edges are tested after. The row count
    is what the windows hold, never key by key. ``outer`` keeps prompts without rows.
    """
    bucket = F.floor(F.col(at) / window_ms).cast("long")
    p = prompts.withColumn("__b", F.explode(F.array(bucket - 1, bucket)))
    s = stream.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__sb", F.floor(F.col(ts) / window_ms).cast("long"))
    same = (F.col("__b") == F.col("__sb")) & (F.col(ts) > F.col(at) - window_ms) & (F.col(ts) <= F.col(at))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    joined = p.join(s, same).drop("__b", "__sb", *[f"__{k}" for k in keys])
    if not outer:
        return joined
    mine = prompts.columns
    rest = [c for c in joined.columns if c not in mine]
    found = joined.select(*[F.col(c).alias(f"__f_{c}") for c in mine], *rest)
    return prompts.join(found, [prompts[c].eqNullSafe(found[f"__f_{c}"]) for c in mine], "left").select(*mine, *rest)


def chunked(rows: DataFrame, *, keys: list[str], ts: str, seq: str, chunk_ms: int, halo_ms: int = 0, carry: bool = False) -> DataFrame:
    """``rows`` dealt by key and chunk of time, with ``__chunk`` and ``__halo``.

    Rows of the ``halo_ms`` before a chunk come along as its halo; with ``carry`` the last row
    before the chunk does in any case. A window over keys and ``__chunk`` then sees all that a
    frame so long (or a lag of one) needs; drop the halo's rows after it.
    """
    own = rows.withColumn("__chunk", _chunk(ts, chunk_ms)).withColumn("__halo", F.lit(False))
    out = own
    if halo_ms:
        ahead = F.explode(F.sequence(F.col("__chunk") + 1, _chunk_at(F.col(ts) + halo_ms, chunk_ms)))
        late = own.filter(_chunk_at(F.col(ts) + halo_ms, chunk_ms) > F.col("__chunk")).withColumn("__c", ahead)
        out = out.unionByName(late.withColumn("__chunk", F.col("__c")).drop("__c").withColumn("__halo", F.lit(True)))
    if carry:
        columns = rows.columns
        last = own.groupBy(*keys, "__chunk").agg(F.max_by(F.struct(*columns), F.struct(ts, seq)).alias("__r"))
        before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("__r", F.last("__r", ignorenulls=True).over(before)).filter("__r is not null").select("__r.*", "__chunk", F.lit(True).alias("__halo"))
        out = out.unionByName(carried.filter(F.col(ts) < F.col("__chunk") * chunk_ms - halo_ms))
    return out


def _chunk_at(at: Column, chunk_ms: int) -> Column:
    return F.floor(at / chunk_ms).cast("long")


def without_halo(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("__halo")).drop("__chunk", "__halo")
