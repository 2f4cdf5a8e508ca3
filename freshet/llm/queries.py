"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import distinct, frequent, langid, leaks, packing, quantiles
from freshet.util import has_time, table

DAY_MS = 86_400_000
PCT_EPS, MIN_VALUES = 0.005, 20
PCTS = [10, 25, 50, 75, 90, 99]
METRICS = ("in_bytes", "in_packets")
ITEM_SHARE, ITEM_EPS = 0.01, 0.0005
ITEM_KINDS = {"srcaddr": ("srcaddr", None), "dstaddr": ("dstaddr", None), "dstaddr_octets": ("dstaddr", "doctets")}
MIN_ROWS = 20


def day_text(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")


# --- 1: percentiles


def _values(spark: SparkSession, d: str) -> DataFrame:
    """exporter_id, day (number), metric (place in METRICS), value. A day is that of first_ms as stored."""
    f = table(spark, d, "flows").where(has_time(F.col("first_ms"), F.col("last_ms")) & F.col("exporter_id").isNotNull())
    pairs = [F.struct(F.lit(i).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(METRICS)]
    x = f.select("exporter_id", F.floor(F.col("first_ms") / DAY_MS).cast("int").alias("day"), F.explode(F.array(*pairs)).alias("x"))
    return x.select("exporter_id", "day", "x.metric", "x.value")


def _metric_name(metric: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in METRICS]), metric + 1)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per exporter and day, per exporter, per day and over all (NULL: combined)."""
    s = quantiles.group_summaries(_values(spark, d), ["exporter_id", "day", "metric"], "value", PCT_EPS)
    none = F.lit(None).cast("int")
    both = s.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("how"))
    part = both.select(F.when(F.col("how") < 2, F.col("exporter_id")).otherwise(none).alias("exporter_id"), F.when(F.col("how") != 1, F.col("day")).otherwise(none).alias("day"), "metric", "n", "v", "rmin", "rmax")
    merged = quantiles.merge_summaries(part, ["exporter_id", "day", "metric"], PCT_EPS)
    total = quantiles.merge_summaries(merged.where("exporter_id is not null and day is null"), ["metric"], PCT_EPS)
    every = merged.unionByName(total.withColumns({"exporter_id": none, "day": none}))
    p = quantiles.percentiles(every, ["exporter_id", "day", "metric"], PCTS)
    return p.select("exporter_id", day_text(F.col("day")).alias("flow_day"), _metric_name(F.col("metric")).alias("metric"), "n", "pct", "estimate", "lower", "upper", "rank_error")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose percentile may exceed its level by the bounds of the summaries; for those the rows up to the level are counted."""
    x = _values(spark, d)
    keys = ["exporter_id", "day", "metric"]
    s = quantiles.group_summaries(x, keys, "value", PCT_EPS).where(F.col("n") >= MIN_VALUES)
    levels = table(spark, d, "pct_levels").select("exporter_id", (F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric")) - 1).cast("int").alias("metric"), "pct", "level_value")
    may = quantiles.percentiles(s, keys, [50, 90]).join(levels, ["exporter_id", "metric", "pct"]).where("upper > level_value").select(*keys, "pct", "n", "level_value")
    # at most as many rows as pct_levels, a fixed table, has for each day: they grow with the days, not with the flows
    counted = x.join(F.broadcast(may), keys).groupBy(*keys, "pct", "n", "level_value").agg(F.count_if(F.col("value") <= F.col("level_value")).alias("below"))
    proven = counted.where(F.col("below") < F.ceil(F.col("pct") * F.col("n") / 100))
    return proven.select("exporter_id", day_text(F.col("day")).alias("flow_day"), _metric_name(F.col("metric")).alias("metric"), "pct")


# --- 2: most frequent items


def _items(spark: SparkSession, d: str) -> DataFrame:
    candidates = frequent.intervals(frequent.merge(frequent.summarize(table(spark, d, "v1_records"), ITEM_KINDS, ITEM_EPS)), ITEM_SHARE, ITEM_EPS)
    return candidates


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from the summaries, then their exact counts."""
    exact = frequent.verified(table(spark, d, "v1_records"), ITEM_KINDS, _items(spark, d))
    return exact.where(F.col("exact").cast("decimal(38,0)") * round(1 / ITEM_SHARE) >= F.col("total")).select("kind", "item")


# --- 6: distinct identifiers


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "v1_records").where("received_ms is not null and exporter_id is not null")
    return r.select("exporter_id", F.floor(F.col("received_ms") / DAY_MS).cast("int").alias("day"), "srcaddr", "dstaddr")


FIELDS = ["srcaddr", "dstaddr"]


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per exporter and day, per exporter, per day and over all (NULL: combined), from one set of partial bitmaps."""
    parts = distinct.build(_identifiers(spark, d), ["exporter_id", "day"], FIELDS)
    none = F.lit(None).cast("int")
    sets = [distinct.merge(parts.select(*[F.col(k) if k in keep else none.alias(k) for k in ("exporter_id", "day")], "field", "level", "word", "mask", "n_rows"), ["exporter_id", "day"]) for keep in (("exporter_id", "day"), ("exporter_id",), ("day",), ())]
    every = sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])
    e = distinct.bounded(distinct.estimate(every, ["exporter_id", "day"]))
    return e.select("exporter_id", day_text(F.col("day")).alias("rec_day"), "field", "n_rows", "n_distinct", "rel_error", "lower", "upper")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The bitmaps decide the groups whose bounds lie on one side of half the rows; the others are counted exactly, spread by value."""
    x = _identifiers(spark, d)
    keys = ["exporter_id", "day"]
    parts = distinct.build(x, keys, FIELDS)
    both = parts.select(F.explode(F.array(F.col("exporter_id"), F.lit(0))).alias("exporter_id"), "day", "field", "level", "word", "mask", "n_rows")
    e = distinct.bounded(distinct.estimate(distinct.merge(both, keys), keys)).where(F.col("n_rows") >= MIN_ROWS)
    # said here so that both uses below have one plan, and the bitmaps are made once
    e = e.where("exporter_id is not null and day is not null and field is not null")
    sure = e.where(F.col("lower") * 2 >= F.col("n_rows")).select(*keys, "field")
    open_ = e.where((F.col("lower") * 2 < F.col("n_rows")) & (F.col("upper") * 2 >= F.col("n_rows"))).select(*keys, "field", "n_rows")
    values = x.select(F.explode(F.array(F.col("exporter_id"), F.lit(0))).alias("exporter_id"), "day", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x")).select(*keys, "x.*")
    # at most one row per exporter (a fixed table), day and field, whatever the number of records
    exact = values.where("value is not null").join(F.broadcast(open_), [*keys, "field"]).select(*keys, "field", "n_rows", "value").distinct().groupBy(*keys, "field", "n_rows").count()
    proven = exact.where(F.col("count") * 2 >= F.col("n_rows")).select(*keys, "field")
    return sure.unionByName(proven).select("exporter_id", day_text(F.col("day")).alias("rec_day"), "field")


# --- 8: filling containers


def p8_assign(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", packing.token_count(F.col("text")).alias("tokens"))
    return packing.assign(docs, "doc_id", "tokens", table(spark, d, "containers"), "container_class", "capacity_tokens")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_assign(spark, d), table(spark, d, "containers"), "container_class", "capacity_tokens")


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing: each class has all documents with all their tokens, in as many parts as they need, and no container
    holds more than its capacity."""
    assigned = p8_assign(spark, d)
    per = assigned.groupBy("container_class", "container_id").agg(F.count_if(F.col("part") == 0).alias("n_items"), F.count(F.lit(1)).alias("n_parts"), F.sum("size").alias("tokens"))
    caps = table(spark, d, "containers").select("container_class", "capacity_tokens")  # a short fixed list
    x = per.join(F.broadcast(caps), "container_class").groupBy("container_class")
    return x.agg(F.sum("n_items").alias("n_items"), F.sum("n_parts").alias("n_parts"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("n_overfull"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose parts lie in more than one container: those that alone exceed the capacity."""
    lies = p8_assign(spark, d).groupBy("container_class", "doc_id").agg(F.count_distinct("container_id").alias("n"))
    return lies.where("n > 1").select("container_class", "doc_id")


# --- 9: leaked evaluation items


def _sides(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(*_sides(spark, d))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_spans(*_sides(spark, d))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All documents without the leaked spans: doc_id, n_chars before and after, and a hash of what is left."""
    docs, *rest = _sides(spark, d)
    x = leaks.cleaned(docs.select("doc_id", "text", F.length("text").alias("chars_before")), *rest)
    return x.select("doc_id", "chars_before", F.length("text").alias("chars_after"), F.md5("text").alias("text_md5"))


# --- 10: languages


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """All segments of all documents, with confidence."""
    docs = table(spark, d, "documents")
    model = langid.fit(langid.sample(docs, "doc_id", "text", "lang"))
    return langid.segments(docs, "doc_id", "text", "lang", model)


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Main language of each document, whether its label is missing or wrong, and the confidence of the main language's segments."""
    s = p10_segments(spark, d).where("lang = main_lang").groupBy("doc_id", "lang", "named", "n_langs").agg((F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence"))
    verdict = F.when(F.col("named").isNull(), "missing").when(F.col("named") != F.col("lang"), "wrong").otherwise("right")
    return s.select("doc_id", "lang", "n_langs", "confidence", verdict.alias("label"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_segments(spark, d).where("n_langs > 1 or named is null or named <> main_lang").select("doc_id", "segment_no", "lang")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_percentiles, p2_found, p2_intervals, p6_found, p6_counts, p8_found, p8_assign, p8_fill, p8_totals, p9_found, p9_spans, p9_cleaned, p10_found, p10_segments, p10_documents)}


def oracle_sql() -> dict[str, str]:
    day = "strftime(make_timestamp({0} // 86400000 * 86400000 * 1000), '%Y-%m-%d')"
    values = " union all ".join(f"select exporter_id, {day.format('first_ms')} flow_day, '{m}' metric, {m} v from flows where first_ms <> 0 and last_ms <> 0 and {m} is not null" for m in METRICS)
    return {
        "p1_found": f"with x as ({values}), g as (select *, row_number() over (partition by exporter_id, flow_day, metric order by v) i, count(*) over (partition by exporter_id, flow_day, metric) n from x) select g.exporter_id, flow_day, g.metric, pct from g join pct_levels l on l.exporter_id = g.exporter_id and l.metric = g.metric where n >= {MIN_VALUES} and i = (pct * n + 99) // 100 and v > level_value",
        "p2_found": "select 'srcaddr' kind, srcaddr item from v1_records where srcaddr is not null group by 2 having 100 * count(*) >= (select count(*) from v1_records) union all select 'dstaddr', dstaddr from v1_records where dstaddr is not null group by 2 having 100 * count(*) >= (select count(*) from v1_records) union all select 'dstaddr_octets', dstaddr from v1_records where dstaddr is not null group by 2 having 100 * sum(doctets) >= (select sum(doctets) from v1_records)",
        "p6_found": f"with r as (select exporter_id, {day.format('received_ms')} rec_day, srcaddr, dstaddr from v1_records where received_ms is not null), b as (select * from r union all select 0, rec_day, srcaddr, dstaddr from r) "
        + " union all ".join(f"select exporter_id, rec_day, '{f}' field from b group by exporter_id, rec_day having count(*) >= {MIN_ROWS} and 2 * count(distinct {f}) >= count(*)" for f in FIELDS),
        "p8_totals": "select container_class, count(*) n_items, cast(sum((strlen(text) + capacity_tokens) // capacity_tokens) as bigint) n_parts, cast(sum(strlen(text) + 1) as bigint) tokens, cast(0 as bigint) n_overfull from documents, containers where text is not null group by 1",
        "p8_found": "select container_class, doc_id from documents, containers where text is not null and strlen(text) + 1 > capacity_tokens",
    }
