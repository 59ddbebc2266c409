"""Record tables over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.operators import records as R
from pulsegrid.plans import tables as T

NOW = "1999-01-01 00:00:00"
HEADS_SQL = f"SELECT user_id, max(seq) AS seq, CAST(max(seq) // 4 AS BIGINT) AS pruned_seq FROM ({T.RECORDS_SQL}) r GROUP BY user_id"


def heads(spark, sf):
    return T.record_changes(spark, sf).groupBy("user_id").agg(
        F.max("seq").alias("seq"), F.floor(F.max("seq") / F.lit(4)).alias("pruned_seq"))


CURSORS_SQL = f"SELECT user_id, CAST(c AS BIGINT) AS cursor FROM ({HEADS_SQL}) h, (VALUES (0), (10), (150)) v(c)"


def cursors(spark, sf):
    return heads(spark, sf).select("user_id", F.explode(F.array(*[F.lit(c).cast("long") for c in (0, 10, 150)])).alias("cursor"))


@query("record_current", T.RECORD_TABLE_SQL)
def _(spark, sf):
    return T.record_table(spark, sf)


@query("record_changes_since", f"""
WITH c AS (SELECT c.user_id, cursor, seq AS head, cursor > 0 AND cursor < pruned_seq AS reset,
                  CASE WHEN cursor > 0 AND cursor < pruned_seq THEN 0 ELSE cursor END AS since
           FROM ({CURSORS_SQL}) c JOIN ({HEADS_SQL}) h USING (user_id)),
h AS (SELECT r.*, c.cursor, c.head, c.reset, row_number() OVER (PARTITION BY r.user_id, c.cursor ORDER BY r.seq) AS k
      FROM ({T.RECORD_TABLE_SQL}) r JOIN c ON c.user_id = r.user_id AND r.seq > since AND r.seq <= head AND (since > 0 OR NOT deleted)),
e AS (SELECT user_id, cursor, max(k) > 50 AS more, max(seq) FILTER (WHERE k <= 50) AS last FROM h GROUP BY user_id, cursor)
SELECT user_id, cursor, id, seq, deleted, bytes, version, edited_at, reset, more, CASE WHEN more THEN last ELSE head END AS next_cursor
FROM h JOIN e USING (user_id, cursor) WHERE k <= 50""")
def _(spark, sf):
    return R.changes_since(T.record_table(spark, sf), heads(spark, sf), cursors(spark, sf), page=50)


WRITES_SQL = f"""
SELECT user_id, id, seq AS arrival, CAST(CASE WHEN seq % 3 = 0 THEN 0 WHEN seq % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS base_version,
       seq % 11 = 0 AS is_delete, bytes FROM ({T.RECORDS_SQL}) w"""
STORED_SQL = f"SELECT user_id, id, version, deleted FROM ({T.RECORD_TABLE_SQL}) t"


def writes(spark, sf):
    m = F.col("seq") % 3
    return T.record_changes(spark, sf).select(
        "user_id", "id", F.col("seq").alias("arrival"), F.when(m == 0, 0).when(m == 1, 2).otherwise(1).cast("long").alias("base_version"),
        (F.col("seq") % 11 == 0).alias("is_delete"), "bytes", F.col("edited_at").alias("updated_at"))


# the same rule replayed one write at a time
REPLAY_SQL = f"""
WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY arrival) AS i FROM ({WRITES_SQL}) x),
r AS (
 SELECT w.user_id, w.id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS base_version,
        coalesce(s.version, 0) AS v, coalesce(s.deleted, TRUE) AS dead, FALSE AS took, FALSE AS clash
 FROM (SELECT DISTINCT user_id, id FROM w) w LEFT JOIN ({STORED_SQL}) s USING (user_id, id)
 UNION ALL
 SELECT w.user_id, w.id, w.i, w.arrival, w.base_version,
        r.v + CASE WHEN fits THEN 1 ELSE 0 END, CASE WHEN fits THEN w.is_delete ELSE r.dead END, fits,
        NOT fits AND NOT (w.is_delete AND r.dead)
 FROM r JOIN w ON w.user_id = r.user_id AND w.id = r.id AND w.i = r.i + 1,
 LATERAL (SELECT CASE WHEN w.is_delete THEN r.v > 0 AND NOT r.dead AND w.base_version = r.v ELSE w.base_version = r.v END AS fits) f)
"""


@query("record_writes_accepted", REPLAY_SQL + "SELECT user_id, id, arrival, v AS version, dead AS deleted FROM r WHERE took")
def _(spark, sf):
    stored = T.record_table(spark, sf).withColumnRenamed("edited_at", "updated_at")
    _, accepted, _ = R.apply_writes(stored, heads(spark, sf), writes(spark, sf))
    return accepted.select("user_id", "id", "arrival", "version", "deleted")


@query("record_writes_conflicts", REPLAY_SQL + "SELECT user_id, id, arrival, base_version, v AS current_version FROM r WHERE clash")
def _(spark, sf):
    stored = T.record_table(spark, sf).withColumnRenamed("edited_at", "updated_at")
    _, _, conflicts = R.apply_writes(stored, heads(spark, sf), writes(spark, sf))
    return conflicts


LOCAL_SQL = f"""
SELECT user_id, id, (epoch_us(edited_at) // 1000) + (id % 5 - 2) * 40000000000 AS edit_ms, version - id % 2 AS version, id % 3 <> 0 AS dirty, id % 7 = 0 AND id % 3 <> 0 AS deleted
FROM ({T.RECORD_TABLE_SQL}) t WHERE version >= 2"""
REMOTE_SQL = f"SELECT user_id, id, (epoch_us(edited_at) // 1000) AS edit_ms, version, deleted, (epoch_us(edited_at) // 1000) + 60000 AS server_ms FROM ({T.RECORD_TABLE_SQL}) t WHERE edited_at >= TIMESTAMP '1996-01-01'"


@query("record_reconcile", f"""
WITH j AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.id, r.id) AS id, l.edit_ms AS le, l.version AS lv, l.dirty, l.deleted AS ld,
                  r.edit_ms AS re, r.version AS rv, r.deleted AS rd, r.server_ms FROM ({LOCAL_SQL}) l FULL JOIN ({REMOTE_SQL}) r ON l.user_id = r.user_id AND l.id = r.id),
a AS (SELECT *, CASE WHEN lv IS NULL THEN CASE WHEN rd THEN 'keep' ELSE 'take' END
  WHEN rv IS NULL THEN CASE WHEN NOT dirty THEN 'keep' WHEN ld THEN 'drop' ELSE 'create' END
  WHEN NOT dirty AND rd THEN 'drop' WHEN NOT dirty THEN CASE WHEN lv >= rv THEN 'keep' ELSE 'take' END
  WHEN rd THEN CASE WHEN ld OR server_ms >= le THEN 'drop' ELSE 'push' END
  WHEN lv = rv THEN 'push' WHEN re >= le THEN 'take' ELSE 'push' END AS action FROM j)
SELECT user_id, id, action, CASE action WHEN 'push' THEN rv WHEN 'create' THEN 0 END AS base_version,
       CASE WHEN action = 'take' THEN re ELSE le END AS edit_ms, CASE WHEN action = 'take' THEN rv ELSE lv END AS version FROM a""")
def _(spark, sf):
    t = T.record_table(spark, sf)
    ms = T.millis("edited_at")
    local = t.filter("version >= 2").select(
        "user_id", "id", (ms + (F.col("id") % 5 - 2) * 40_000_000_000).alias("edit_ms"), (F.col("version") - F.col("id") % 2).alias("version"),
        (F.col("id") % 3 != 0).alias("dirty"), ((F.col("id") % 7 == 0) & (F.col("id") % 3 != 0)).alias("deleted"))
    remote = t.filter("edited_at >= TIMESTAMP_NTZ '1996-01-01'").select("user_id", "id", ms.alias("edit_ms"), "version", "deleted", (ms + 60000).alias("server_ms"))
    return R.reconcile_lww(local, remote)


@query("record_drop_unseen", f"""
SELECT user_id, id, version FROM ({LOCAL_SQL}) l WHERE dirty OR version = 0 OR EXISTS (
 SELECT 1 FROM ({REMOTE_SQL}) r WHERE r.user_id = l.user_id AND r.id = l.id AND NOT r.deleted)""")
def _(spark, sf):
    t = T.record_table(spark, sf)
    local = t.filter("version >= 2").select("user_id", "id", (F.col("version") - F.col("id") % 2).alias("version"), (F.col("id") % 3 != 0).alias("dirty"))
    listing = t.filter("edited_at >= TIMESTAMP_NTZ '1996-01-01' AND NOT deleted")
    return R.drop_unseen(local, listing).select("user_id", "id", "version")


@query("record_edit_clock", f"""
SELECT user_id, seq, max((epoch_us(edited_at) // 1000) - seq) OVER (PARTITION BY user_id ORDER BY seq) + seq AS edit_ms FROM ({T.RECORDS_SQL}) r""")
def _(spark, sf):
    r = T.record_changes(spark, sf).withColumn("now_ms", T.millis("edited_at"))
    return R.edit_clock(r, ["user_id"], ["seq"], "now_ms").select("user_id", "seq", "edit_ms")


@query("record_prune", f"""
SELECT user_id, id, seq, version FROM ({T.RECORD_TABLE_SQL}) t WHERE NOT (deleted AND edited_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY)""")
def _(spark, sf):
    t = T.record_table(spark, sf).withColumnRenamed("edited_at", "updated_at")
    kept, _ = R.prune(t, heads(spark, sf), F.lit(NOW).cast("timestamp_ntz"))
    return kept.select("user_id", "id", "seq", "version")


@query("record_prune_heads", f"""
SELECT user_id, h.seq, greatest(pruned_seq, coalesce(p, 0)) AS pruned_seq FROM ({HEADS_SQL}) h LEFT JOIN (
 SELECT user_id, max(seq) AS p FROM ({T.RECORD_TABLE_SQL}) t WHERE deleted AND edited_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY GROUP BY user_id) x USING (user_id)""")
def _(spark, sf):
    t = T.record_table(spark, sf).withColumnRenamed("edited_at", "updated_at")
    return R.prune(t, heads(spark, sf), F.lit(NOW).cast("timestamp_ntz"))[1]


@query("record_usage", f"SELECT user_id, count(*) AS n_records, sum(bytes) AS bytes FROM ({T.RECORD_TABLE_SQL}) t WHERE NOT deleted GROUP BY user_id")
def _(spark, sf):
    return R.usage(T.record_table(spark, sf))


# a fold over the writes of each user: what each accepted record holds is a map that the next write reads
@query("record_admission", f"""
WITH RECURSIVE w AS (SELECT user_id, id, seq AS arrival, bytes, row_number() OVER (PARTITION BY user_id ORDER BY seq, id) AS i FROM ({T.RECORDS_SQL}) r),
s AS (SELECT user_id, map_from_entries(list({{'k': id, 'v': bytes}})) AS m FROM ({T.RECORD_TABLE_SQL}) t WHERE NOT deleted GROUP BY user_id),
f AS (
  SELECT u.user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS reason,
         coalesce(s.m, MAP {{}}::MAP(BIGINT, BIGINT)) AS m FROM (SELECT DISTINCT user_id FROM w) u LEFT JOIN s USING (user_id)
  UNION ALL
  SELECT user_id, i, id, arrival, bytes, reason,
         CASE WHEN reason IS NULL THEN map_from_entries(list_append(o, {{'k': id, 'v': bytes}})) ELSE m END FROM (
    SELECT *, CASE WHEN bytes > 60000 THEN 'too_large' WHEN len(o) >= 280 THEN 'records'
                   WHEN coalesce(list_sum(list_transform(o, lambda e: e.v)), 0) + bytes > 5242880 THEN 'bytes' END AS reason FROM (
      SELECT w.*, f.m, list_transform(list_filter(map_entries(f.m), lambda e: e.key <> w.id), lambda e: {{'k': e.key, 'v': e.value}}) AS o
      FROM f JOIN w ON w.user_id = f.user_id AND w.i = f.i + 1) x) y)
SELECT user_id, id, arrival, bytes, reason FROM f WHERE i > 0""")
def _(spark, sf):
    w = T.record_changes(spark, sf).select("user_id", "id", F.col("seq").alias("arrival"), "bytes")
    return R.admit(w, T.record_table(spark, sf), max_records=280, max_record=60000)


@query("record_hourly_counts", """
SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) <= 3 AS within FROM events GROUP BY ALL""")
def _(spark, sf):
    return R.hourly_counts(T.table(spark, sf, "events"), ["event_type"], "ts", 3)


@query("record_hourly_admission", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) x WHERE k <= 2""")
def _(spark, sf):
    return R.admit_hourly(T.table(spark, sf, "events"), ["event_type"], "ts", "event_id", 2).select("event_id")


@query("record_global_counts", f"""
SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM ({T.RECORD_TABLE_SQL}) t WHERE NOT deleted) AS records,
       (SELECT count(*) FROM orders WHERE o_orderdate > TIMESTAMP '{NOW}') AS sessions""")
def _(spark, sf):
    s = T.table(spark, sf, "orders").select(F.col("o_orderdate").alias("expires_at"))
    return R.global_counts(T.table(spark, sf, "customer"), T.record_table(spark, sf), s, F.lit(NOW).cast("timestamp_ntz"))


@query("record_active_sessions", f"""
SELECT o_orderkey, user_id, c_name FROM (SELECT o_orderkey, o_custkey AS user_id FROM orders WHERE o_orderdate > TIMESTAMP '{NOW}') s
JOIN (SELECT c_custkey AS user_id, c_name FROM customer) u USING (user_id)""")
def _(spark, sf):
    s = T.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expires_at"))
    u = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return R.active_sessions(s, u, F.lit(NOW).cast("timestamp_ntz")).select("o_orderkey", "user_id", "c_name")


@query("record_purge", f"SELECT user_id, id FROM ({T.RECORD_TABLE_SQL}) t WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, sf):
    gone = T.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return R.purge_users({"records": T.record_table(spark, sf)}, gone)["records"].select("user_id", "id")


@query("record_newest_n", f"""
SELECT user_id, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM ({T.RECORDS_SQL}) r) x WHERE k <= 20""")
def _(spark, sf):
    return R.newest_n(T.record_changes(spark, sf), ["user_id"], ["seq"], 20).select("user_id", "id", "seq")


@query("record_keep_recent", f"""
SELECT user_id, id, seq FROM ({T.RECORDS_SQL}) r JOIN (SELECT user_id, max(edited_at) - INTERVAL 90 DAY AS cut FROM ({T.RECORDS_SQL}) q GROUP BY user_id) c USING (user_id)
WHERE edited_at > cut""")
def _(spark, sf):
    return R.keep_recent(T.record_changes(spark, sf), ["user_id"], "edited_at").select("user_id", "id", "seq")


SHAPE_SQL = """
SELECT *, CASE WHEN NOT regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN 'bad_id'
 WHEN NOT (kind IN ('checkin', 'session', 'baseline', 'personal-model', 'import', 'settings') AND length(iv) = 16 AND length(ct) >= 22 AND base_version >= 0) THEN 'bad_request'
 WHEN length(iv) + length(ct) > 65536 THEN 'too_large' END AS problem FROM (
 SELECT lpad(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 9 = 0 THEN 7 ELSE 8 END, '0') || '-0000-4000-8000-00000000abcd' AS id,
  CASE o_orderkey % 4 WHEN 0 THEN 'checkin' WHEN 1 THEN 'session' WHEN 2 THEN 'import' ELSE 'other' END AS kind,
  repeat('A', CAST(CASE WHEN o_orderkey % 13 = 0 THEN 15 ELSE 16 END AS BIGINT)) AS iv, repeat('b', CAST(o_orderkey % 50 AS BIGINT)) AS ct,
  o_orderkey % 6 - 1 AS base_version FROM orders) x"""


@query("record_shape_check", f"SELECT problem, count(*) AS n FROM ({SHAPE_SQL}) s GROUP BY problem")
def _(spark, sf):
    k = F.col("o_orderkey")
    w = T.table(spark, sf, "orders").select(
        F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000abcd")).alias("id8"),
        F.concat(F.lpad(k.cast("string"), 7, "0"), F.lit("-0000-4000-8000-00000000abcd")).alias("id7"),
        F.when(k % 4 == 0, "checkin").when(k % 4 == 1, "session").when(k % 4 == 2, "import").otherwise("other").alias("kind"),
        F.when(k % 13 == 0, F.repeat(F.lit("A"), 15)).otherwise(F.repeat(F.lit("A"), 16)).alias("iv"),
        F.repeat(F.lit("b"), (k % 50).cast("int")).alias("ct"), (k % 6 - 1).alias("base_version"), k.alias("k"))
    w = w.withColumn("id", F.when(F.col("k") % 9 == 0, F.col("id7")).otherwise(F.col("id8")))
    return R.validate_records(w).groupBy("problem").agg(F.count("*").alias("n"))
