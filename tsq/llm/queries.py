"""Queries of the training-data operators of this subpackage, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm import bpe, chunks, leaks, nearest, percentiles
from tsq.sources.tables import table

PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.9, 0.99]
TOLERANCE_MS = 5_000


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "collection_elements")
    groups = e.select("grp", "metric").distinct()  # of three kinds each
    found = percentiles.bisect(percentiles.reading_items(e), ["grp", "metric", "kind"], PERCENTILES, groups, percentiles.BROADCAST_INTERVALS // 3)
    return found.select("grp", "metric", "kind", "pct", F.round("n", 6).alias("n"), "value")


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable summary of each UTC day."""
    items = percentiles.reading_items(table(spark, d, "collection_elements"), by_day=True)
    return percentiles.summarise(items, ["day", "grp", "metric", "kind"]).select("day", "grp", "metric", "kind", "bucket", F.round("w", 6).alias("w"))


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the combined daily summaries, with their bounds."""
    return percentiles.merged(p2_daily(spark, d), ["grp", "metric", "kind"], PERCENTILES).select("grp", "metric", "kind", "pct", F.round("n", 6).alias("n"), "lower", "upper")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    s, v = nearest.emits(table(spark, d, "scalar_emits"), table(spark, d, "vector_emits"))
    return nearest.nearest(s, v, TOLERANCE_MS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("left_id").alias("scalar_id"), F.col("right_id").alias("vector_id"))


def p5_distances(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("left_id").alias("scalar_id"), F.col("right_id").alias("vector_id"), F.col("distance").alias("distance_ms"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "eval_items"), table(spark, d, "documents")).select("item_id", "doc_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents, and how closely."""
    return leaks.leaks(table(spark, d, "eval_items"), table(spark, d, "documents")).groupBy("item_id").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("edits") == 0, 1).otherwise(0)).alias("exact"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("piece_no = 0").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_percentiles, p2_daily, p2_merged, p5_found, p5_distances, p7_ids, p8_found, p8_items, p9_found, p9_pieces)}


_ITEMS = """
with e as (
  select distinct element_id, array_to_string(grp, '.') grp, array_to_string(metric, '.') metric, tp_ms, value,
         case value.kind when 4 then value.d when 3 then coalesce(value.i::double, value.u::double) when 2 then value.i::double end v
  from collection_elements
  where tp_ms is not null and element_id is not null and list_extract(list_transform(list_filter(tags, lambda t: t.k = 'host'), lambda t: t.v.s), 1) is not null),
i as (
  select grp, metric, 'value' kind, floor(tp_ms / 86400000)::bigint as day, v + 0.0 x, 1.0::double w from e where v is not null and isfinite(v)
  union all
  select grp, metric, k.kind, floor(tp_ms / 86400000)::bigint, if(k.kind = 'range_lo', r.lo, r.hi) + 0.0, r.cnt
  from (select *, unnest(value.h) r from e where value.kind = 6), (values ('range_lo'), ('range_hi')) k(kind)
  where isfinite(r.lo) and isfinite(r.hi) and isfinite(r.cnt) and r.cnt > 0)
"""

#: The bucket of a value: its exponent and the first 8 bits of its fraction as one number, of negative values rounded away from zero.
_BUCKETS = _ITEMS + """, l as (select *, abs(x) a, floor(log2(nullif(abs(x), 0)))::int e0 from i),
  m as (select *, e0 + case when a / pow(2.0, e0) >= 2 then 1 when a / pow(2.0, e0) < 1 then -1 else 0 end e from l),
  o as (select *, (a / pow(2.0, e) - 1) * 256 f from m),
  t as (select *, case when x = 0 then 0 when x > 0 then (e + 1023) * 256 + floor(f)::int else -((e + 1023) * 256 + ceil(f)::int) end::bigint bucket from o)
"""


def _val(b: str) -> str:
    """SQL of the least magnitude in a bucket, and of the step between doubles there."""
    return f"(pow(2.0, {b} // 256 - 1023) * (1 + ({b} % 256) / 256.0::double))"


def _ulp(b: str) -> str:
    return f"pow(2.0, {b} // 256 - 1023 - 52)"


_TINY = "pow(2.0, -1074)"
_LOWER = f"case when bucket = 0 then 0.0 when bucket > 0 then {_val('bucket')} else -{_val('(-bucket)')} end"
_UPPER = f"case when bucket = 0 then 17592186044415 * {_TINY} when bucket > 0 then {_val('(bucket + 1)')} - {_ulp('bucket')} when bucket = -1 then -{_TINY} else -({_val('(-bucket - 1)')} + {_ulp('(-bucket - 1)')}) end"

_PCTS = ", ".join(f"({p}::double)" for p in PERCENTILES)

_P5 = """
with s as (select distinct emit_id, pipe, tp_ms from scalar_emits where pipe is not null and tp_ms is not null and (value.kind in (2, 3) or value.kind = 4 and not isnan(value.d))),
v as (select pipe, tp_ms, min(emit_id) emit_id from vector_emits where pipe is not null and tp_ms is not null
      and len(list_filter(tagged, lambda t: t.value.kind in (2, 3) or t.value.kind = 4 and not isnan(t.value.d))) > 0 group by all),
b as (select s.emit_id scalar_id, v.emit_id vector_id, s.tp_ms - v.tp_ms distance_ms from s asof join v on s.pipe = v.pipe and s.tp_ms >= v.tp_ms),
a as (select s.emit_id scalar_id, v.emit_id vector_id, v.tp_ms - s.tp_ms distance_ms from s asof join v on s.pipe = v.pipe and s.tp_ms <= v.tp_ms),
n as (select *, row_number() over (partition by scalar_id order by distance_ms, o) r from (select *, 0 o from b union all select *, 1 o from a) where distance_ms <= 5000)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_percentiles": f"""{_ITEMS}, c as (select *, sum(w) over (partition by grp, metric, kind order by x rows unbounded preceding) upto, sum(w) over (partition by grp, metric, kind) n from i),
            p(pct) as (values {_PCTS})
            select grp, metric, kind, pct, round(n, 6) n, min(x) as value from c, p where upto >= greatest(pct * n - n * 1e-12, n * 1e-13) group by grp, metric, kind, pct, n""",
        "p2_daily": _BUCKETS + "select day, grp, metric, kind, bucket, round(sum(w), 6) w from t group by all",
        "p2_merged": f"""{_BUCKETS}, s as (select grp, metric, kind, bucket, sum(w) w from t group by all),
            c as (select *, sum(w) over (partition by grp, metric, kind order by bucket) upto, sum(w) over (partition by grp, metric, kind) n from s), p(pct) as (values {_PCTS}),
            h as (select grp, metric, kind, pct, n, min(bucket) bucket from c, p where upto >= greatest(pct * n - n * 1e-12, n * 1e-13) group by all)
            select grp, metric, kind, pct, round(n, 6) n, {_LOWER} as "lower", {_UPPER} as "upper" from h""",
        "p5_found": _P5 + "select scalar_id, vector_id from n where r = 1",
        "p5_distances": _P5 + "select scalar_id, vector_id, distance_ms from n where r = 1",
    }
