"""Sources, cleaning and response log on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelscore.functions.scalar import micros
from panelscore.operators import accrue, clean, hashtree, quality
from panelscore.plans import bindings as b
from panelscore.plans import oracle as o
from panelscore.plans.catalogue.common import tidy, work_folder
from panelscore.sources import cachelog, files, landed, payloads, versions

AS_OF = "2024-01-20 00:00:00"
TTL = 3 * 24 * 3600


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def p1(spark, sf):
    out = clean.normalize(b.event_obs(spark, sf))
    return tidy(out.select("entity", "indicator", "period", "value", "source", "flag", "seq"))


def p2(spark, sf):
    flagged = clean.flag_quality(clean.drop_incomplete(clean.normalize(b.event_obs(spark, sf))), b.EVENT_MODEL)
    return flagged.groupBy("indicator", "flag").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high")
    )


def event_clean(spark, sf):
    return clean.clean_long(b.event_obs(spark, sf), b.EVENT_MODEL)


def p5(spark, sf):
    return tidy(event_clean(spark, sf))


def p4(spark, sf):
    return tidy(clean.clean_long(b.event_obs(spark, sf), b.EVENT_MODEL, periods=[3, 17]))


def p6(spark, sf):
    return tidy(b.nation_full_long(spark, sf).select("entity", "indicator", "period", "value", "flag"))


def p7(spark, sf):
    return tidy(clean.to_wide(event_clean(spark, sf), b.EVENT_TYPES))


def p8(spark, sf):
    return tidy(clean.to_long(b.user_day(spark, sf), b.EVENT_TYPES))


def p9(spark, sf):
    periods = event_clean(spark, sf).groupBy("period").agg(F.count(F.lit(1)).alias("rows"))
    return periods.select("period", "rows")


def response_log(spark, sf):
    e = b.read(spark, sf, "events")
    url = F.concat(F.lit("/user/"), F.col("user_id").cast("string"))
    return e.select(
        cachelog.cache_key(F.col("event_type"), url).alias("cache_key"),
        F.col("event_type").alias("source"),
        url.alias("url"),
        F.round("value", 6).alias("body"),
        F.when(F.col("event_id") % 7 == 0, 503).otherwise(200).alias("status_code"),
        F.col("ts").alias("retrieved_at"),
        F.col("event_id").alias("entry"),
    )


def _good(spark, sf):
    return response_log(spark, sf).where((F.col("status_code") == 200) & (F.col("retrieved_at") <= as_of()))


def s10(spark, sf):
    return cachelog.newest_per_key(_good(spark, sf), tie="entry").select("cache_key", "source", "url", "body", "entry")


def s11(spark, sf):
    return cachelog.lookup(_good(spark, sf), as_of(), TTL, tie="entry").select("cache_key", "source", "body", "freshness_seconds")


def s12(spark, sf):
    return cachelog.last_known_good(_good(spark, sf), as_of(), TTL, tie="entry").select(
        "cache_key", "source", "body", "freshness_seconds", "stale"
    )


def s13(spark, sf):
    """With entries of which nobody noted the source."""
    log = response_log(spark, sf)
    log = log.withColumn("source", F.when(F.col("entry") % 11 != 0, F.col("source")))
    return cachelog.statistics(log).select(
        F.when(F.col("is_total"), F.lit("(total)")).otherwise(F.coalesce("source", F.lit("(none)"))).alias("source"),
        "entries",
        micros(F.col("oldest")).alias("oldest_us"),
        micros(F.col("newest")).alias("newest_us"),
    )


def q11(spark, sf):
    log = response_log(spark, sf).where(F.col("retrieved_at") <= as_of())
    return cachelog.freshness(log, as_of(), 1800).select("source", "age_seconds", "state")


def q12(spark, sf):
    return cachelog.bookkeeping(_good(spark, sf), as_of(), TTL).select(
        "source", "fresh", "cached", micros(F.col("cache_date")).alias("cache_date_us")
    )


# --- payloads: the tables are turned into provider documents, then parsed back -----------------


def _order_groups(spark, sf, *period):
    """Order aggregates per nation and period, by customer first."""
    per_customer = b.read(spark, sf, "orders").groupBy("o_custkey", *period).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")
    )
    names = b.nation_dimension(spark, sf).select("n_nationkey", "entity")
    customers = b.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    keys = [c for c in per_customer.columns if c not in ("o_custkey", "n", "top")]
    return (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", *keys)
        .agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        .join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def _year():
    return F.year("o_orderdate").cast("int").alias("period")


def _record_documents(spark, sf):
    cells = _order_groups(spark, sf, _year())
    item = F.struct(
        F.lower("entity").alias("countryiso3code"),
        F.when(F.col("period") == 1995, "n/a").otherwise(F.col("period").cast("string")).alias("date"),
        F.when(F.col("n_nationkey") % 7 != 0, F.col("top")).alias("value"),
    )
    # One document per nation: a handful of years each.
    documents = cells.groupBy("n_nationkey").agg(
        F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(item)), F.lit("]")).alias("payload")
    )
    broken = documents.select("n_nationkey", F.lit('[{"message":"no data"}]').alias("payload"))
    return documents.unionByName(broken)


def s1(spark, sf):
    rows = payloads.records_to_long(_record_documents(spark, sf))
    return rows.select("entity", "period", F.round("value", 4).alias("value"), "source", "flag")


def _land(spark, documents, key):
    """One file for each document, and one that is cut off; the name has the key."""
    folder = work_folder(spark)
    named = documents.select(F.col(key).cast("string").alias("key"), "payload")
    torn = named.limit(1).select(F.lit("torn").alias("key"), F.expr("left(payload, length(payload) - 3)").alias("payload"))
    named.withColumn("key", F.concat("key", F.lit("-"), F.pmod(F.xxhash64("payload"), F.lit(10**9)).cast("string"))).union(torn).repartition("key").write.partitionBy("key").text(folder)
    return folder


def s1_source(spark, sf):
    rows = landed.read(spark, _land(spark, _record_documents(spark, sf), "n_nationkey"), "records", suffix=".txt", partitionBytes="2000")
    return landed.records_to_long(rows).select("entity", "period", F.round("value", 4).alias("value"), "source", "flag")


def s1_rejects(spark, sf):
    """The documents that a provider answered with a message, and the one that is cut off."""
    rows = landed.read(spark, _land(spark, _record_documents(spark, sf), "n_nationkey"), "records", rejects=True, suffix=".txt")
    return rows.select(F.regexp_extract("origin", "key=([^/-]+)", 1).alias("key"), F.substring_index("reason", ":", 1).alias("reason"))


def s3_source(spark, sf):
    """As s3, from files: the entity is in the file's name."""
    rows = landed.read(spark, _land(spark, _quarter_documents(spark, sf), "entity"), "observations", suffix=".txt")
    rows = rows.withColumn("entity", F.url_decode(F.regexp_extract("origin", "key=(.+)-[^/-]+/", 1)))
    return landed.quarterly_to_annual(rows, ["entity"], digits=None).select("entity", "period", F.round("value", 4).alias("value"))


def s2(spark, sf):
    e = b.read(spark, sf, "events")
    line = F.concat_ws(
        ",",
        F.when(F.col("event_id") % 50 == 0, "2024-13-45").otherwise(F.date_format("ts", "yyyy-MM-dd")),
        F.when(F.col("event_id") % 33 == 0, ".").otherwise(F.col("value").cast("string")),
    )
    lines = e.select(F.col("event_type").alias("series"), line.alias("line"))
    return tidy(payloads.lines_to_annual(lines, ["series"], 2000, 2030))


def _sdmx_groups(spark, sf):
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    cells = _order_groups(spark, sf, quarter.alias("label"))
    return cells.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("label", F.col("top").alias("v")))).alias("o")
    )


def _quarter_documents(spark, sf):
    """Quarterly largest order as one SDMX document per nation."""
    times = F.transform("o", lambda x: F.struct(x["label"].alias("id")))
    observed = F.map_from_entries(
        F.transform("o", lambda x, i: F.struct(i.cast("string").alias("key"), F.array(x["v"]).alias("value")))
    )
    document = F.struct(
        F.array(F.struct(F.create_map(F.lit("0"), F.struct(observed.alias("observations"))).alias("series"))).alias("dataSets"),
        F.struct(
            F.struct(F.array(F.struct(F.lit("TIME_PERIOD").alias("id"), times.alias("values"))).alias("observation")).alias(
                "dimensions"
            )
        ).alias("structure"),
    )
    return _sdmx_groups(spark, sf).select("entity", F.to_json(F.struct(document.alias("data"))).alias("payload"))


def s3(spark, sf):
    """Read back to year-end values."""
    docs = _quarter_documents(spark, sf)
    return payloads.quarterly_to_annual(docs, digits=None).select("entity", "period", F.round("value", 4).alias("value"))


def _aliases(spark, sf):
    """Two-letter-style codes for the first 20 nations; the others pass through."""
    n = b.read(spark, sf, "nation").where(F.col("n_nationkey") < 20)
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("entity"))


def _series_documents(spark, sf):
    """Annual order counts, one document per region with one series per nation."""
    names = b.nation_dimension(spark, sf).select("n_nationkey", "region")
    code = F.when(F.col("n_nationkey") < 20, F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).otherwise(F.col("entity"))
    cells = _order_groups(spark, sf, _year()).join(names, "n_nationkey")
    series = cells.groupBy("region", code.alias("code")).agg(
        F.collect_list(F.struct("period", F.col("n").cast("double").alias("v"))).alias("o")
    )
    packed = series.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("code", "o"))).alias("s"))
    years = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.transform(x["o"], lambda y: y["period"])))))
    packed = packed.withColumn("years", years)
    observed = F.map_from_entries(
        F.transform(
            "s",
            lambda x, i: F.struct(
                F.concat(F.lit("0:"), i.cast("string"), F.lit(":0")).alias("key"),
                F.struct(
                    F.map_from_entries(
                        F.transform(
                            x["o"],
                            lambda y: F.struct(
                                (F.array_position("years", y["period"]) - 1).cast("string").alias("key"),
                                F.array(y["v"]).alias("value"),
                            ),
                        )
                    ).alias("observations")
                ).alias("value"),
            ),
        )
    )
    dims = F.array(
        F.struct(F.lit("FREQ").alias("id"), F.array(F.struct(F.lit("A").alias("id"))).alias("values")),
        F.struct(F.lit("REF_AREA").alias("id"), F.transform("s", lambda x: F.struct(x["code"].alias("id"))).alias("values")),
    )
    times = F.transform("years", lambda y: F.struct(y.cast("string").alias("id")))
    document = F.struct(
        F.array(F.struct(observed.alias("series"))).alias("dataSets"),
        F.struct(
            F.struct(
                dims.alias("series"),
                F.array(F.struct(F.lit("TIME_PERIOD").alias("id"), times.alias("values"))).alias("observation"),
            ).alias("dimensions")
        ).alias("structure"),
    )
    return packed.select("region", F.to_json(document).alias("payload"))


def _panel_nations(spark, sf):
    return b.read(spark, sf, "nation").where(F.col("n_nationkey") != 3).select(F.col("n_name").alias("entity"))


def s4(spark, sf):
    """Read back to rows."""
    docs = _series_documents(spark, sf).drop("region")
    return payloads.series_to_long(docs, _panel_nations(spark, sf), _aliases(spark, sf))


def s4_source(spark, sf):
    rows = landed.read(spark, _land(spark, _series_documents(spark, sf), "region"), "observations", suffix=".txt")
    return landed.series_to_long(rows, _panel_nations(spark, sf), _aliases(spark, sf)).drop("origin")


def s5(spark, sf):
    n = b.read(spark, sf, "nation").select(F.lower("n_name").alias("entity"), "n_nationkey")
    coded = payloads.to_code(n, _aliases(spark, sf)).drop("entity")
    return payloads.to_entity(coded, _aliases(spark, sf)).join(
        coded.select("n_nationkey", "code"), "n_nationkey"
    ).select("n_nationkey", "code", "entity")


def s15(spark, sf):
    """Each series from its own collector; one collector delivered nothing."""
    long = b.nation_long(spark, sf)
    parts = {
        "AVG_ORDER_VALUE": long.where(F.col("indicator") == "AVG_ORDER_VALUE"),
        "AVG_DISCOUNT": long.where(F.col("indicator") == "AVG_DISCOUNT").drop("flag"),
        "AVG_TAX": None,
    }
    return tidy(files.route_sources(parts).select("entity", "indicator", "period", "value", "source"))


def q1(spark, sf):
    panel = event_clean(spark, sf)
    users = b.read(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"))
    absent = b.read(spark, sf, "nation").select(F.col("n_name").alias("entity"))
    days = sorted(r[0] for r in panel.select("period").distinct().collect())
    return tidy(quality.coverage(panel, users.unionByName(absent), b.EVENT_TYPES, days))


def q1_bits(spark, sf):
    """The same from bitmaps: three loads, merged one after the other into a table."""
    path, panel = work_folder(spark), event_clean(spark, sf)
    users = b.read(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"))
    absent = b.read(spark, sf, "nation").select(F.col("n_name").alias("entity"))
    part = F.pmod(F.xxhash64("entity", "period"), F.lit(3))
    for k in range(3):
        bits = accrue.coverage_bits(panel.where((part == k) | (part == 0)), b.EVENT_TYPES, 0)
        held = accrue.merge_bits(versions.read_version(spark, path), bits) if k else bits
        versions.commit(held, path, partition_by=None)
    days = sorted(r[0] for r in panel.select("period").distinct().collect())
    return tidy(accrue.coverage(versions.read_version(spark, path), users.unionByName(absent), b.EVENT_TYPES, days, 0))


def q10(spark, sf):
    """Fingerprints of events by day against a copy with one day changed and one day lost."""
    e = b.read(spark, sf, "events")
    day = F.to_date("ts")
    recorded = quality.fingerprint(e, "events", day)
    changed = e.withColumn("value", F.when(day == F.lit("2024-01-05").cast("date"), F.col("value") + 1).otherwise(F.col("value")))
    current = quality.fingerprint(changed.where(day != F.lit("2024-01-09").cast("date")), "events", day)
    return quality.compare_fingerprints(recorded, current)


def q10_rows(spark, sf):
    """Events by day and a copy with changed, lost and added rows: the trees lead to the events that differ."""
    folder = work_folder(spark)
    e = b.read(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    n = F.col("event_id")
    changed = e.withColumn("value", F.when((n % 97 == 0) & F.col("value").isNotNull(), F.col("value") + 1).otherwise(F.col("value")))
    added = e.where((n % 101 == 0) & (F.col("day") == "2024-01-12")).withColumn("event_id", n + 10**12)
    frames = []
    for name, frame in (("old", e), ("new", changed.where((n % 89 != 0) | (F.col("day") != "2024-01-09")).unionByName(added))):
        frame.write.partitionBy("day").parquet(f"{folder}/{name}")
        frames.append(spark.read.schema(e.schema).parquet(f"{folder}/{name}"))
    trees = []
    for name, frame in zip(("old", "new"), frames):
        hashtree.tree(hashtree.leaves(frame, ["event_id"], F.col("day"))).write.partitionBy("level").parquet(f"{folder}/{name}_tree")
        trees.append(spark.read.parquet(f"{folder}/{name}_tree"))
    found = hashtree.differences(*trees)
    return hashtree.drifted_rows(*frames, found, ["event_id"], F.col("day"))


def s6(spark, sf):
    """The wide panel landed as CSV with ids as people type them, read back by header."""
    path = work_folder(spark)
    wide = b.nation_base(spark, sf).withColumn("entity", F.concat(F.lit("  "), F.lower("entity")))
    files.write_table(wide, path, partition_by=None, fmt="csv")
    return tidy(files.read_wide_csv(spark, path, [*b.NATION_BASE, "NOT_DELIVERED"]))


def s8(spark, sf):
    """Written by period, then again as a full reload without some of its periods."""
    path, long = work_folder(spark), b.nation_long(spark, sf)
    files.write_table(long, path)
    files.write_table(long.where("period >= 1996 and period <> 1998"), path)
    return tidy(files.read_long(spark, path).select("entity", "indicator", "period", "value"))


def s9(spark, sf):
    """Two periods of a versioned table replaced, one by nothing, one from its own rows, after a write that failed."""
    path = work_folder(spark)
    versions.commit(b.nation_long(spark, sf), path)
    own = versions.read_version(spark, path)
    broken = F.when(F.col("value").isNotNull(), F.raise_error(F.lit("a write that fails"))).otherwise(F.col("value"))
    try:
        versions.commit(own.withColumn("value", broken.cast("double")), path, replace=[1996])
    except Exception as error:
        if "a write that fails" not in str(error):
            raise
    versions.commit(own.where("period <> 1995").withColumn("value", F.col("value") + 1), path, replace=[1995, 1997])
    return tidy(versions.read_version(spark, path).select("entity", "indicator", "period", "value"))


def s9_versions(spark, sf):
    """What each of three versions holds by period: a full load, a replacement from its own rows, a shrinking reload."""
    path = work_folder(spark)
    versions.commit(b.nation_long(spark, sf), path)
    versions.commit(versions.read_version(spark, path).withColumn("value", F.col("value") * 2), path, replace=[1996, 1998])
    versions.commit(versions.read_version(spark, path).where("period < 1997"), path)
    each = [versions.read_version(spark, path, n).withColumn("version", F.lit(n)) for n in (1, 2, 3)]
    whole = each[0].unionByName(each[1]).unionByName(each[2])
    return tidy(whole.groupBy("version", "period").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")))


QUERIES = {
    "p1_normalize": p1,
    "p2_flags": p2,
    "p4_period_policy": p4,
    "p5_keep_last": p5,
    "p6_finalize": p6,
    "p7_pivot": p7,
    "p8_unpivot": p8,
    "p9_periods": p9,
    "s1_records_json": s1,
    "s2_annual_csv": s2,
    "s3_quarterly_sdmx": s3,
    "s4_series_sdmx": s4,
    "s1_data_source": s1_source,
    "s1_rejects": s1_rejects,
    "s3_data_source": s3_source,
    "s4_data_source": s4_source,
    "s5_code_mapping": s5,
    "s6_wide_csv": s6,
    "s8_sink": s8,
    "s9_reload": s9,
    "s9_versions": s9_versions,
    "s10_upsert": s10,
    "s11_ttl_lookup": s11,
    "s12_last_known_good": s12,
    "s13_cache_stats": s13,
    "s15_routing": s15,
    "q1_coverage": q1,
    "q1_bitmaps": q1_bits,
    "q10_fingerprint": q10,
    "q10_drifted_rows": q10_rows,
    "q11_freshness": q11,
    "q12_bookkeeping": q12,
}

LOG = f"""
WITH log AS (
  SELECT sha256(event_type || '|' || '/user/' || user_id) AS cache_key, event_type AS source, '/user/' || user_id AS url,
         round(value, 6) AS body, CASE WHEN event_id % 7 = 0 THEN 503 ELSE 200 END AS status_code,
         ts AS retrieved_at, event_id AS entry
  FROM events),
good AS (SELECT * FROM log WHERE status_code = 200 AND retrieved_at <= TIMESTAMP '{AS_OF}'),
newest AS (
  SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(retrieved_at)) / 1e6 AS age FROM good
  QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY retrieved_at DESC, entry DESC) = 1)
"""
PIVOT = ", ".join(f"max(value) FILTER (indicator = '{t}') AS {t}" for t in b.EVENT_TYPES)
USER_DAY = f"""
WITH ud AS (
  SELECT 'U' || user_id AS entity, 'G' || (user_id % 5) AS peer_group, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS period,
         {", ".join(f"avg(value) FILTER (event_type = '{t}') AS {t}" for t in b.EVENT_TYPES)}
  FROM events GROUP BY ALL)
"""
NATION_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

COVERAGE = f"""{o.EVENT_OBS}, ents AS (SELECT DISTINCT 'U' || user_id AS entity FROM events UNION SELECT n_name FROM nation)
        , grid AS (SELECT {len(b.EVENT_TYPES)} * count(DISTINCT period) AS expected FROM clean)
        SELECT entity, any_value(expected)::BIGINT AS expected, count(indicator)::BIGINT AS observed,
          {o.r6('count(indicator) * 100.0 / any_value(expected) AS coverage_pct')}
        FROM ents CROSS JOIN grid LEFT JOIN (SELECT DISTINCT entity, indicator, period FROM clean) USING (entity) GROUP BY entity"""

ORACLE = {
    "p1_normalize": f"{o.EVENT_OBS} SELECT entity, indicator, period, {o.r6('value')}, source, 'ok' AS flag, seq FROM raw",
    "p2_flags": f"""{o.EVENT_OBS} SELECT indicator, flag, count(*) AS rows, {o.r6('min(value) AS low', 'max(value) AS high')}
        FROM flagged WHERE period IS NOT NULL GROUP BY 1, 2""",
    "p4_period_policy": f"{o.EVENT_OBS} SELECT entity, indicator, period, {o.r6('value')}, source, flag FROM clean WHERE period IN (3, 17)",
    "p5_keep_last": f"{o.EVENT_OBS} SELECT entity, indicator, period, {o.r6('value')}, source, flag FROM clean",
    "p6_finalize": f"{o.FULL} SELECT entity, indicator, period, {o.r6('value')}, 'ok' AS flag FROM full_long",
    "p7_pivot": f"""{o.EVENT_OBS} SELECT entity, period, {o.r6(*b.EVENT_TYPES)} FROM (
        SELECT entity, period, {PIVOT} FROM clean WHERE value IS NOT NULL GROUP BY 1, 2)""",
    "p8_unpivot": f"""{USER_DAY} SELECT entity, period, indicator, {o.r6('value')} FROM ({
        " UNION ALL ".join(f"SELECT entity, period, '{t}' AS indicator, {t} AS value FROM ud" for t in b.EVENT_TYPES)})""",
    "p9_periods": f"{o.EVENT_OBS} SELECT period, count(*) AS rows FROM clean GROUP BY 1",
    "s1_records_json": f"""SELECT n_name AS entity, year(o_orderdate)::INT AS period,
        round(max(o_totalprice), 4) AS value, 'World Bank' AS source, 'ok' AS flag
        FROM {NATION_ORDERS} WHERE year(o_orderdate) <> 1995 AND n_nationkey % 7 <> 0 GROUP BY 1, 2""",
    "s2_annual_csv": f"""SELECT event_type AS series, year(ts)::INT AS period, {o.r6('avg(value) AS value')} FROM events
        WHERE event_id % 50 <> 0 AND event_id % 33 <> 0 GROUP BY 1, 2""",
    "s3_quarterly_sdmx": f"""WITH q AS (
          SELECT n_name AS entity, year(o_orderdate)::INT AS period, quarter(o_orderdate) AS q,
                 max(o_totalprice) AS v FROM {NATION_ORDERS} GROUP BY 1, 2, 3)
        SELECT entity, period, round(v, 4) AS value FROM q
        QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY q DESC) = 1""",
    "s4_series_sdmx": f"""SELECT n_name AS entity, year(o_orderdate)::INT AS period, count(*)::DOUBLE AS value
        FROM {NATION_ORDERS} WHERE n_nationkey <> 3 GROUP BY 1, 2""",
    "s5_code_mapping": """SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'N' || n_nationkey ELSE n_name END AS code,
        n_name AS entity FROM nation""",
    "s10_upsert": f"{LOG} SELECT cache_key, source, url, body, entry FROM newest",
    "s11_ttl_lookup": f"{LOG} SELECT cache_key, source, body, floor(age)::BIGINT AS freshness_seconds FROM newest WHERE age <= {TTL}",
    "s12_last_known_good": f"""{LOG} SELECT cache_key, source, body, floor(age)::BIGINT AS freshness_seconds,
        age > {TTL} AS stale FROM newest""",
    "s6_wide_csv": f"""{o.LONG} SELECT entity, period, {o.r6(*b.NATION_BASE)} FROM base""",
    "s8_sink": f"""{o.LONG} SELECT entity, indicator, period, {o.r6('value')} FROM obs WHERE period >= 1996 AND period <> 1998""",
    "s9_reload": f"""{o.LONG} SELECT entity, indicator, period, {o.r6('(CASE WHEN period = 1997 THEN value + 1 ELSE value END) AS value')} FROM obs WHERE period <> 1995""",
    "s9_versions": f"""{o.LONG}, v AS (
        SELECT 1 AS version, period, value FROM obs UNION ALL
        SELECT 2, period, CASE WHEN period IN (1996, 1998) THEN 2 * value ELSE value END FROM obs UNION ALL
        SELECT 3, period, CASE WHEN period = 1996 THEN 2 * value ELSE value END FROM obs WHERE period < 1997)
        SELECT version::INT AS version, period, count(*) AS rows, {o.r6('sum(value) AS total')} FROM v GROUP BY version, period""",
    "s13_cache_stats": f"""{LOG}, known AS (SELECT CASE WHEN entry % 11 <> 0 THEN source END AS source, retrieved_at FROM log)
        SELECT CASE WHEN grouping(source) = 1 THEN '(total)' ELSE coalesce(source, '(none)') END AS source, count(*) AS entries,
        epoch_us(min(retrieved_at)) AS oldest_us, epoch_us(max(retrieved_at)) AS newest_us FROM known GROUP BY ROLLUP (source)""",
    "s15_routing": f"""{o.LONG} SELECT entity, indicator, period, {o.r6('value')},
        CASE WHEN indicator = 'AVG_DISCOUNT' THEN 'lineitem' ELSE 'orders' END AS source
        FROM obs WHERE indicator IN ('AVG_ORDER_VALUE', 'AVG_DISCOUNT')""",
    "q1_coverage": COVERAGE,
    "q1_bitmaps": COVERAGE,
    "q10_fingerprint": """WITH changed AS (
          SELECT * REPLACE (CASE WHEN ts::DATE = DATE '2024-01-05' THEN value + 1 ELSE value END AS value) FROM events WHERE ts::DATE <> DATE '2024-01-09'),
        old AS (SELECT strftime(ts, '%Y-%m-%d') AS p, count(*) AS n, sum(hash(event_id, ts, user_id, event_type, value, props)::HUGEINT) AS h FROM events GROUP BY 1),
        new AS (SELECT strftime(ts, '%Y-%m-%d') AS p, count(*) AS n, sum(hash(event_id, ts, user_id, event_type, value, props)::HUGEINT) AS h FROM changed GROUP BY 1)
        SELECT 'events' AS "table", p AS "partition", old.n AS old_rows, new.n AS new_rows,
          CASE WHEN new.h IS NULL THEN 'missing' WHEN old.h IS NULL THEN 'new' WHEN old.h = new.h AND old.n = new.n THEN 'ok' ELSE 'drifted' END AS status
        FROM old FULL JOIN new USING (p)""",
    "q10_drifted_rows": """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)
        SELECT day AS "partition", event_id, CASE WHEN event_id % 89 = 0 AND day = '2024-01-09' THEN 'missing' ELSE 'changed' END AS status
        FROM e WHERE (event_id % 89 = 0 AND day = '2024-01-09') OR (event_id % 97 = 0 AND value IS NOT NULL)
        UNION ALL SELECT day, event_id + 1000000000000, 'new' FROM e WHERE event_id % 101 = 0 AND day = '2024-01-12'""",
    "q11_freshness": f"""WITH log AS (
          SELECT event_type AS source, ts, event_id % 7 <> 0 AS good FROM events WHERE ts <= TIMESTAMP '{AS_OF}'),
        g AS (SELECT source, max(ts) AS attempt, max(ts) FILTER (good) AS newest FROM log GROUP BY 1),
        a AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(newest)) / 1e6 AS age FROM g)
        SELECT source, floor(age)::BIGINT AS age_seconds, CASE WHEN newest IS NULL THEN 'UNAVAILABLE' WHEN attempt > newest THEN 'CACHED'
          WHEN age <= 1800 THEN 'LIVE' ELSE 'STALE' END AS state FROM a""",
    "q12_bookkeeping": f"""{LOG} SELECT source, count(*) FILTER (age <= {TTL}) AS fresh, count(*) FILTER (age > {TTL}) AS cached,
        epoch_us(max(retrieved_at) FILTER (age > {TTL})) AS cache_date_us FROM newest GROUP BY 1""",
}
ORACLE |= {f"{k}_data_source": ORACLE[name] for k, name in (("s1", "s1_records_json"), ("s3", "s3_quarterly_sdmx"), ("s4", "s4_series_sdmx"))}
ORACLE["s1_rejects"] = f"""SELECT DISTINCT n_nationkey::VARCHAR AS key, 'ValueError' AS reason FROM {NATION_ORDERS}
    UNION ALL SELECT 'torn', 'JSONDecodeError'"""
