"""Versioned record tables: change pages, conditional writes, merges, retention, quotas and rates.

Tables: records(user_id, id, seq, deleted, bytes, version, updated_at, ...) with `seq` the user's log
number; heads(user_id, seq, pruned_seq).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid import constants as K
from pulsegrid.operators.ordered import BLOCK_ROWS, Ordered, sized
from pulsegrid.session import checkpointed

KEY = ["user_id", "id"]
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
RECORD_KINDS = ["checkin", "session", "baseline", "personal-model", "import", "settings"]


def newest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Newest row per key by a hash aggregate, without sorting."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*"))


def number_changes(changes: DataFrame, heads: DataFrame, order: list[str], **ordered) -> DataFrame:
    """Give every change the next log number of its user, after the stored head."""
    o = Ordered(changes, ["user_id"], order, **ordered).number("_n").rows
    return (o.join(heads.select("user_id", F.col("seq").alias("_head")), "user_id", "left")
            .withColumn("seq", F.coalesce("_head", F.lit(0)) + F.col("_n")).drop("_n", "_head"))


def changes_since(records: DataFrame, heads: DataFrame, cursors: DataFrame, page: int = K.RECORD_PAGE) -> DataFrame:
    """One page of changes per (user, cursor): rows in log order, with `more`, `next_cursor` and `reset`.

    A cursor older than the pruned head starts over. A first listing hides tombstones. The page is found by
    a row number limited to page + 1, which Spark cuts to that many rows per key before the shuffle.
    """
    c = (cursors.join(heads.select("user_id", F.col("seq").alias("head"), "pruned_seq"), "user_id")
         .withColumn("reset", (F.col("cursor") > 0) & (F.col("cursor") < F.col("pruned_seq")))
         .withColumn("since", F.when(F.col("reset"), 0).otherwise(F.col("cursor"))))
    hit = (records.join(c, "user_id")
           .filter((F.col("seq") > F.col("since")) & (F.col("seq") <= F.col("head")) & ((F.col("since") > 0) | ~F.col("deleted"))))
    w = Window.partitionBy("user_id", "cursor").orderBy("seq")
    top = hit.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= page + 1)
    ends = top.groupBy("user_id", "cursor").agg(
        (F.max("_k") > page).alias("more"), F.max(F.when(F.col("_k") <= page, F.col("seq"))).alias("_last"))
    return (top.filter(F.col("_k") <= page).join(ends, ["user_id", "cursor"])
            .withColumn("next_cursor", F.when(F.col("more"), F.col("_last")).otherwise(F.col("head")))
            .drop("_k", "_last", "head", "pruned_seq", "since"))


def _followers(current: DataFrame, writes: DataFrame, open_deletes: bool, by_record: dict) -> DataFrame:
    """One row per write with a base, and per record with `by` -1 for its stored row: v, the version once that write is in;
    `to`, the next write with a base that is accepted then; `via`, a delete without base that comes in between."""
    based = writes.filter("base_version IS NOT NULL AND NOT (is_delete AND base_version <= 0)")
    events = based.select(*KEY, F.col("base_version").alias("ver"), F.col("arrival").alias("at"), F.col("arrival").alias("by"),
                          F.col("arrival").alias("_any"), F.when(~F.col("is_delete"), F.col("arrival")).alias("_put"))

    def next_event(nodes: DataFrame) -> DataFrame:
        """Adds `any` and `put`: the first write (that is no delete) based on `ver` later than `at`."""
        o = Ordered(nodes.unionByName(events, allowMissingColumns=True), [*KEY, "ver"], ["at", "by"], **by_record)
        o = o.running({"any": ("last", F.col("_any")), "put": ("last", F.col("_put"))}, reverse=True, current=False)
        return o.rows.filter("_any IS NULL").drop("_any", "_put")

    stored = current.select(*KEY, F.col("version").cast("long").alias("v"), F.col("deleted").alias("dead"))
    begin = writes.select(*KEY).distinct().join(stored, KEY, "left").select(
        *KEY, F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("dead", F.lit(True)).alias("dead"), F.lit(-1).cast("long").alias("by"))
    nodes = begin.unionByName(based.select(*KEY, (F.col("base_version") + 1).alias("v"), F.col("is_delete").alias("dead"), F.col("arrival").alias("by")))
    n = next_event(nodes.withColumn("ver", F.col("v")).withColumn("at", F.col("by")))
    n = n.withColumn("to", F.when(F.col("dead"), F.col("put")).otherwise(F.col("any"))).select(*KEY, "by", "v", "dead", "to")
    if not open_deletes:
        return n.withColumn("via", F.lit(None).cast("long")).drop("dead")
    unbased = writes.filter("base_version IS NULL AND is_delete").select(*KEY, F.col("arrival").alias("by"), F.col("arrival").alias("_drop"))
    o = Ordered(n.unionByName(unbased, allowMissingColumns=True), KEY, ["by"], **by_record)
    n = o.running({"via": ("last", F.col("_drop"))}, reverse=True, current=False).rows.filter("_drop IS NULL").drop("_drop")
    goes = ~F.col("dead") & (F.col("v") > 0) & F.coalesce(F.col("to").isNull() | (F.col("via") < F.col("to")), F.lit(False))
    n = n.withColumn("via", F.when(goes, F.col("via"))).drop("dead")
    # after the delete only a write on its version follows
    again = next_event(n.filter("via IS NOT NULL").withColumn("ver", F.col("v") + 1).withColumn("at", F.col("via")))
    return n.filter("via IS NULL").unionByName(again.withColumn("to", F.col("put")).select(*n.columns))


def _reached(edges: DataFrame, longest: int) -> DataFrame:
    """user_id, id, arrival, version of the writes that the stored rows (`by` -1) lead to. longest: most steps of a path."""
    aimed = edges.filter("to IS NOT NULL").select(*KEY, F.col("to").alias("by")).distinct()     # what nothing leads to is left out
    first = edges.filter("by = -1").unionByName(edges.filter("by <> -1").join(aimed, [*KEY, "by"], "left_semi"))
    t = first.select(*KEY, "by", "v", "via", F.col("to").alias("jump"), (F.col("by") == -1).alias("hit"))
    for _ in range(longest.bit_length()):
        t = checkpointed(t)
        onward = t.filter("jump IS NOT NULL").select(*KEY, F.col("by").alias("jump"), F.col("jump").alias("_next"))
        reached = t.filter("hit AND jump IS NOT NULL").select(*KEY, F.col("jump").alias("by"), F.lit(True).alias("_hit"))
        t = (t.join(onward, [*KEY, "jump"], "left").join(reached, [*KEY, "by"], "left")
             .select(*KEY, "by", "v", "via", F.col("_next").alias("jump"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
    t = checkpointed(t).filter("hit")
    return t.filter("by <> -1").select(*KEY, F.col("by").alias("arrival"), F.col("v").alias("version")).unionByName(
        t.filter("via IS NOT NULL").select(*KEY, F.col("via").alias("arrival"), (F.col("v") + 1).alias("version")))


def apply_writes(current: DataFrame, heads: DataFrame, writes: DataFrame, **ordered) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Optimistic writes and deletes: (new records, accepted, conflicts).

    writes: user_id, id, arrival, base_version, is_delete, bytes, updated_at; arrivals are not negative and unique per user.
    A write fits when its base version is the record's version (0: no such record); a delete needs a live
    record and may leave the base out. The first fitting write by arrival wins. Deletes that find nothing to delete are no
    conflicts.

    If a write with a base is accepted, its version is known, and so is the write that follows it: the first later one with
    that base. Which writes are accepted is then which ones the stored row leads to along these pointers. Doubling the
    pointers finds that in as many rounds as the number of different bases of a record has bits.
    """
    shape = writes.groupBy(*KEY, "base_version").agg(F.count("*").alias("n"), F.count_if("is_delete").alias("d")).groupBy(*KEY).agg(
        F.sum("n").alias("rows"), F.count("base_version").alias("bases"), F.sum(F.when(F.col("base_version").isNull(), F.col("d"))).alias("open"))
    rows, bases, open_deletes = shape.agg(F.max("rows"), F.max("bases"), F.sum("open")).first()
    block_rows = ordered.get("block_rows", BLOCK_ROWS)
    by_record = {"block_rows": block_rows, "bounded": ordered.get("bounded", 3 * (rows or 0) <= block_rows)}
    edges = checkpointed(_followers(current, writes, bool(open_deletes), by_record))
    took = _reached(edges, bases or 0)
    accepted = writes.join(took, [*KEY, "arrival"]).select(
        *KEY, "arrival", F.col("version").cast("long").alias("version"), F.col("is_delete").alias("deleted"),
        F.when(F.col("is_delete"), 0).otherwise(F.col("bytes")).cast("long").alias("bytes"), "updated_at")
    accepted = number_changes(accepted, heads, ["arrival", "id"], **ordered)

    # what a refused write found: the newest accepted write before it, else the stored row
    mine = accepted.select(*KEY, "arrival", F.struct(F.col("version").alias("v"), F.col("deleted").alias("dead")).alias("_s"))
    base = current.select(*KEY, F.lit(-1).cast("long").alias("arrival"), F.struct(F.col("version").cast("long").alias("v"), F.col("deleted").alias("dead")).alias("_s"))
    refused = writes.join(accepted.select(*KEY, "arrival"), [*KEY, "arrival"], "left_anti")
    both = mine.unionByName(base).unionByName(refused.select(*KEY, "arrival", "base_version", "is_delete", F.lit(True).alias("_asked")),
                                              allowMissingColumns=True)
    seen = Ordered(both, KEY, ["arrival"], **by_record).running({"_cur": ("last", F.col("_s"))}).rows.filter("_asked")
    nothing = F.col("is_delete") & (F.col("_cur").isNull() | F.col("_cur.dead"))
    conflicts = seen.filter(~nothing).select(
        *KEY, "arrival", "base_version", F.coalesce("_cur.v", F.lit(0)).alias("current_version"))
    last = newest(accepted.drop("arrival"), KEY, "version")
    kept = current.join(last.select(*KEY), KEY, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True), accepted, conflicts


def upsert_latest(current: DataFrame, writes: DataFrame) -> DataFrame:
    """One write per record and batch: insert if absent (base 0), update if the version matches."""
    first = newest(writes.withColumn("_neg", -F.col("arrival")), KEY, "_neg").drop("_neg")
    cur = current.select(*KEY, F.col("version").alias("_v"))
    j = first.join(cur, KEY, "left").withColumn("_v", F.coalesce("_v", F.lit(0)))
    return j.withColumn("accepted", F.col("base_version") == F.col("_v")).withColumn(
        "version", F.when(F.col("accepted"), F.col("_v") + 1).otherwise(F.col("_v"))).drop("_v")


def reconcile_lww(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Last writer wins between local edits and remote rows, one row per record with the action taken.

    local: user_id, id, edit_ms, version, dirty, deleted; remote: the same with `server_ms` (when the server
    took the change) and `edit_ms` from inside the record. Actions:
    keep - nothing changes; take - the remote row replaces the local one; drop - the local row goes;
    push - the local edit is written on top of the remote version; create - the local edit is new.
    """
    lo = local.select(*KEY, *[F.col(c).alias(f"l_{c}") for c in ("edit_ms", "version", "dirty", "deleted")])
    re = remote.select(*KEY, *[F.col(c).alias(f"r_{c}") for c in ("edit_ms", "version", "deleted", "server_ms")])
    j = lo.join(re, KEY, "full")
    no_l, no_r = F.col("l_version").isNull(), F.col("r_version").isNull()
    clean = ~F.col("l_dirty")
    current = F.col("l_version") == F.col("r_version")
    action = (
        F.when(no_l, F.when(F.col("r_deleted"), "keep").otherwise("take"))
        .when(no_r, F.when(clean, "keep").when(F.col("l_deleted"), "drop").otherwise("create"))
        .when(clean & F.col("r_deleted"), "drop")
        .when(clean, F.when(F.col("l_version") >= F.col("r_version"), "keep").otherwise("take"))
        .when(F.col("r_deleted"), F.when(F.col("l_deleted") | (F.col("r_server_ms") >= F.col("l_edit_ms")), "drop").otherwise("push"))
        .when(current, "push")
        .when(F.col("r_edit_ms") >= F.col("l_edit_ms"), "take").otherwise("push"))
    base = F.when(action.isin("push"), F.col("r_version")).when(action == "create", F.lit(0))
    return j.select(*KEY, action.alias("action"), base.alias("base_version"),
                    F.when(action == "take", F.col("r_edit_ms")).otherwise(F.col("l_edit_ms")).alias("edit_ms"),
                    F.when(action == "take", F.col("r_version")).otherwise(F.col("l_version")).alias("version"))


def drop_unseen(local: DataFrame, listing: DataFrame) -> DataFrame:
    """After a full listing: clean local rows the server did not list are removed."""
    seen = listing.select(*KEY)
    gone = local.filter(~F.col("dirty") & (F.col("version") > 0)).join(seen, KEY, "left_anti").select(*KEY)
    return local.join(gone, KEY, "left_anti")


def edit_clock(edits: DataFrame, owner: list[str], order: list[str], now: str, **ordered) -> DataFrame:
    """Strictly increasing edit times: max(now, previous + 1).

    With n the position of an edit, the time is n plus the running maximum of (now - n).
    """
    o = Ordered(edits, owner, order, **ordered).number("_n")
    o = o.running({"_m": ("max", F.col(now) - F.col("_n"))})
    return o.rows.withColumn("edit_ms", F.col("_m") + F.col("_n")).drop("_n", "_m")


def prune(records: DataFrame, heads: DataFrame, now: Column, days: int = K.TOMBSTONE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Drop old tombstones; remember the highest pruned log number per user. Returns (records, heads)."""
    old = F.col("deleted") & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS"))
    top = records.filter(old).groupBy("user_id").agg(F.max("seq").alias("_p"))
    new_heads = (heads.join(top, "user_id", "left")
                 .withColumn("pruned_seq", F.greatest("pruned_seq", F.coalesce("_p", F.lit(0)))).drop("_p"))
    return records.filter(~old), new_heads


def prune_expired(sessions: DataFrame, counters: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions that have not expired, counters of the last two hours."""
    return (sessions.filter(F.col("expires_at") > now),
            counters.filter(F.col("hour") >= now - F.expr("INTERVAL 2 HOURS")))


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now).join(users, "user_id")


def usage(records: DataFrame) -> DataFrame:
    """Live rows and bytes per user."""
    return records.filter(~F.col("deleted")).groupBy("user_id").agg(
        F.count("*").alias("n_records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def admit(writes: DataFrame, current: DataFrame, *, max_records: int = K.MAX_RECORDS, max_bytes: int = K.MAX_USER_BYTES,
          max_record: int = K.MAX_RECORD_BYTES, block_writes: int = 100_000, **ordered) -> DataFrame:
    """Quota check of writes in arrival order; `reason` is NULL when a write fits.

    A write is held against the user's other live rows: stored ones and writes accepted before it, each record once. A
    refused write uses nothing.

    First it is guessed that every write that is not too large is accepted; running sums say whether all fit then. For most
    users they do, and that is the result. From a user's first misfit on, the writes are folded one by one, in blocks of
    `block_writes` that start from a guessed state (the usage and the held sizes that the blocks before would leave); blocks
    whose guess turns out wrong are folded again until none is. The first blocks are right from the start, so
    there are at most as many rounds as blocks, and a user who stays below the limits has none.
    """
    live = current.filter(~F.col("deleted")).select(*KEY, F.col("bytes").alias("_own"))
    d = (writes.join(usage(current).withColumnsRenamed({"n_records": "_n0", "bytes": "_b0"}), "user_id", "left")
         .join(live, KEY, "left").fillna(0, ["_n0", "_b0"]).withColumn("_fits", F.col("bytes") <= max_record))
    size = sized(writes, ["user_id"], **ordered)
    if size["bounded"]:
        d = d.repartition("user_id")        # both windows below find their rows together
    d = Ordered(d, KEY, ["arrival"], **size).running({"_held": ("last", F.when(F.col("_fits"), F.col("bytes")))}, current=False).rows
    d = d.withColumn("_old", F.coalesce("_held", "_own")).drop("_held", "_own")
    more = F.when(F.col("_fits"), F.col("_old").isNull().cast("long")).otherwise(0)
    grows = F.when(F.col("_fits"), F.col("bytes") - F.coalesce("_old", F.lit(0))).otherwise(0)
    o = Ordered(d, ["user_id"], ["arrival", "id"], **size).running({"_n": ("sum", more), "_b": ("sum", grows)}, current=False)
    d = o.rows.withColumn("_n", F.col("_n0") + F.coalesce("_n", F.lit(0))).withColumn("_b", F.col("_b0") + F.coalesce("_b", F.lit(0))).drop("_n0", "_b0")
    known = F.col("_old").isNotNull().cast("long")
    over = F.col("_fits") & ((F.col("_n") - known >= max_records) | (F.col("_b") - F.coalesce("_old", F.lit(0)) + F.col("bytes") > max_bytes))
    d = checkpointed(d.withColumn("_over", over))
    misfit = d.filter("_over").groupBy("user_id").agg(F.min_by(F.struct("arrival", "id", "_n", "_b"), F.struct("arrival", "id")).alias("_first"))
    d = d.join(misfit, "user_id", "left")
    late = F.col("_first").isNotNull() & (F.struct("arrival", "id") >= F.struct("_first.arrival", "_first.id"))
    reason = F.when(~F.col("_fits"), "too_large")
    settled = d.filter(~F.coalesce(late, F.lit(False))).select(*writes.columns, reason.alias("reason"))
    rest = d.filter(late).withColumns({"_sn": F.col("_first._n"), "_sb": F.col("_first._b")}).drop("_first", "_n", "_b")
    folded = _fold_blocks(rest, max_records, max_bytes, max_record, block_writes, size)
    return settled if folded is None else settled.unionByName(folded.select(*writes.columns, "reason"))


def _fold_blocks(rows: DataFrame, max_records: int, max_bytes: int, max_record: int, block_writes: int, size: dict) -> DataFrame | None:
    """Writes from a user's first misfit on, with `reason`; None if there are none. _sn, _sb: records and bytes in use before the
    first of them; _old: the size its record held before, if all writes between were accepted; _over: the guess."""
    o = Ordered(rows, ["user_id"], ["arrival", "id"], **size).number("_k")
    rows = o.rows.withColumn("_block", F.floor((F.col("_k") - 1) / block_writes).cast("long"))
    first = Window.partitionBy(*KEY).orderBy("_k")
    begun = F.row_number().over(first) == 1
    rows = checkpointed(rows.withColumn("_begun", begun).withColumn("reason", F.when(F.col("_over"), "bytes").when(~F.col("_fits"), "too_large")))
    last = rows.agg(F.max("_block")).first()[0]
    if last is None:
        return None
    before = None
    while True:
        # what every block would find, given the decisions so far
        held = (rows.groupBy(*KEY, "_block").agg(F.max(F.when(F.col("_begun"), F.col("_old"))).alias("_stored"), F.max_by("bytes", F.when(F.col("reason").isNull(), F.col("_k"))).alias("_kept")))
        earlier = Window.partitionBy(*KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*KEY).orderBy("_block")
        held = held.withColumn("_stored", F.last("_stored", ignorenulls=True).over(upto)).withColumn("_found", F.coalesce(F.last("_kept", ignorenulls=True).over(earlier), "_stored"))
        left = F.coalesce("_kept", "_found")
        held = checkpointed(held.select(*KEY, "_block", "_found", (left.isNotNull().cast("long") - F.col("_found").isNotNull().cast("long")).alias("_dn"),
                                        (F.coalesce(left, F.lit(0)) - F.coalesce("_found", F.lit(0))).alias("_db")))
        so_far = Window.partitionBy("user_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = held.groupBy("user_id", "_block").agg(F.sum("_dn").alias("_dn"), F.sum("_db").alias("_db"), F.bit_xor(F.xxhash64("id", F.coalesce("_found", F.lit(-1)))).alias("_sign"))
        starts = checkpointed(starts.select("user_id", "_block", "_sign", F.coalesce(F.sum("_dn").over(so_far), F.lit(0)).alias("_dn"), F.coalesce(F.sum("_db").over(so_far), F.lit(0)).alias("_db")))
        todo = starts if before is None else starts.join(before, ["user_id", "_block", "_sign", "_dn", "_db"], "left_anti")
        if before is not None and todo.isEmpty():
            return rows
        named = rows.columns
        again = rows.join(todo.select("user_id", "_block", "_dn", "_db"), ["user_id", "_block"]).join(held.select(*KEY, "_block", "_found"), [*KEY, "_block"])
        done = _fold(again, named, rows.schema, max_records, max_bytes, max_record)
        if last == 0:       # one block a user, which starts from what is known
            return done
        same = rows.join(todo.select("user_id", "_block"), ["user_id", "_block"], "left_anti").select(*named)
        rows, before = checkpointed(done.unionByName(same)), starts


def _fold(rows: DataFrame, names: list[str], schema: StructType, max_records: int, max_bytes: int, max_record: int) -> DataFrame:
    """Decide the writes of every (user, block) in order; `_found` is what a record held before the block."""
    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, n, total = None, {}, 0, 0
        for frame in frames:
            reasons = []
            columns = [frame[c].tolist() for c in ("user_id", "_block", "id", "bytes", "_sn", "_sb", "_dn", "_db")]
            found = [None if x is None or x != x else int(x) for x in frame["_found"].tolist()]
            for (user, block, record, size, sn, sb, dn, db), old in zip(zip(*columns), found):
                if (user, block) != at:
                    at, held, n, total = (user, block), {}, sn + dn, sb + db
                old = held.get(record, old)
                others, rest = (n, total) if old is None else (n - 1, total - old)
                reason = "too_large" if size > max_record else "records" if others >= max_records else "bytes" if rest + size > max_bytes else None
                if reason is None:
                    held[record], n, total = size, others + 1, rest + size
                reasons.append(reason)
            frame["reason"] = pd.Series(reasons, index=frame.index, dtype=object)
            yield frame[names]

    return rows.repartition("user_id", "_block").sortWithinPartitions("user_id", "_block", "_k").mapInPandas(decide, schema)


def hourly_counts(events: DataFrame, key: list[str], ts: str, limit: int) -> DataFrame:
    """Events per key and fixed hour, and whether the hour stayed within the limit."""
    return (events.groupBy(*key, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))
            .withColumn("within", F.col("n") <= limit))


def admit_hourly(events: DataFrame, key: list[str], ts: str, order: str, limit: int) -> DataFrame:
    """The first `limit` events of every key and hour; the row-number filter is cut before the shuffle."""
    w = Window.partitionBy(*key, F.date_trunc("hour", ts)).orderBy(ts, order)
    return events.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def global_counts(users: DataFrame, records: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    u = users.agg(F.count("*").alias("users"))
    r = records.filter(~F.col("deleted")).agg(F.count("*").alias("records"))
    s = sessions.filter(F.col("expires_at") > now).agg(F.count("*").alias("sessions"))
    one = F.lit(1).alias("_one")
    return u.select("*", one).join(r.select("*", one), "_one").join(s.select("*", one), "_one").drop("_one")


def purge_users(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    return {name: t.join(gone.select("user_id"), "user_id", "left_anti") for name, t in tables.items()}


def validate_records(writes: DataFrame) -> DataFrame:
    """Shape check; `problem` is NULL for an acceptable write."""
    b64 = lambda c: F.col(c).rlike("^[A-Za-z0-9_-]+$")
    shape = (F.col("kind").isin(RECORD_KINDS) & b64("iv") & (F.length("iv") == 16) & b64("ct") & (F.length("ct") >= 22)
             & F.col("base_version").isNotNull() & (F.col("base_version") >= 0))
    problem = (F.when(~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), "bad_id")
               .when(~F.coalesce(shape, F.lit(False)), "bad_request")
               .when(F.length("iv") + F.length("ct") > K.MAX_RECORD_BYTES, "too_large"))
    return writes.withColumn("problem", problem)


def newest_n(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows per key; Spark cuts each map task to n rows per key before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def keep_recent(df: DataFrame, key: list[str], ts: str, days: int = K.IMPORT_DAYS) -> DataFrame:
    """Rows strictly newer than `days` before the key's newest row."""
    newest_ts = df.groupBy(*key).agg((F.max(ts) - F.expr(f"INTERVAL {days} DAYS")).alias("_cut"))
    return df.join(newest_ts, key).filter(F.col(ts) > F.col("_cut")).drop("_cut")
