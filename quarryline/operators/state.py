"""Mutable rows as folds over append-only events: cache, jobs, quota, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.names import fresh

FREE_SCANS = 5


def cache_hits(rows: DataFrame, keys: tuple[str, ...] = ("code_hash", "is_fix"), order: str = "id") -> DataFrame:
    """Adds hit and hit_id: whether an earlier completed row has the same key, and the first such row.

    The first completed row of each key is aggregated before the shuffle and
    joined back, so a key that very many rows share gathers nothing.
    """
    name = fresh("first", rows)
    first = rows.where("status = 'completed'").groupBy(*keys).agg(F.min(order).alias(name))
    hit = F.coalesce(F.col(name) < F.col(order), F.lit(False))
    return rows.join(first, list(keys), "left").withColumns({"hit": hit, "hit_id": F.when(hit, F.col(name))}).drop(name)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the report, misses): requests by code_hash and is_fix against completed rows, the one with the smallest id."""
    done = cache.where("status = 'completed'").groupBy("code_hash", "is_fix").agg(F.min_by("report_text", "id").alias("report_text"))
    return requests.join(done, ["code_hash", "is_fix"]), requests.join(done, ["code_hash", "is_fix"], "left_anti")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; partial maxima keep hot keys small."""
    others = [c for c in events.columns if c != key]
    last = fresh("last", events)
    return events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias(last)).select(key, f"{last}.*")


#: What a job's state allows: (status, move) to the next status. A report may still be amended after the job is completed.
JOB_MOVES = {(None, "ask"): "pending", ("pending", "complete"): "completed", ("pending", "fail"): "failed", ("completed", "amend"): "completed"}
#: Finished jobs are forgotten so long after their last move, and may be asked for again.
KEEP_SECONDS = 24 * 3600


def job_transitions(events: DataFrame, *, key: str = "job_id", ts: str = "ts", place: str = "event_id", move: str = "move", report: str = "report", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """job_id, event_id, move, legal, status, report: each event in the order of (ts, place) with the job's state after it.

    A move that the state does not allow leaves it, with legal = false. The
    events of one job are folded together: a job has few.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    one = F.struct(at.alias("at"), F.col(place).cast("long").alias("place"), F.col(move).alias("move"), F.col(report).alias("report"))
    grouped = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(place).isNotNull()).groupBy(F.col(key).alias("job_id")).agg(F.array_sort(F.collect_list(one)).alias("events"))

    def step(acc, e):
        old = acc["finished"].isNotNull() & (e["at"] - acc["finished"] > F.lit(keep_seconds * 1_000_000))
        before = lambda c: F.when(old, F.lit(None).cast(acc_types[c])).otherwise(acc[c])
        status = before("status")
        after = F.lit(None).cast("string")
        for (was, what), then in JOB_MOVES.items():
            after = F.when((status.isNull() if was is None else status.eqNullSafe(F.lit(was))) & (e["move"] == what), F.lit(then)).otherwise(after)
        legal = after.isNotNull()
        new_status, new_report = F.when(legal, after).otherwise(status), F.when(legal & e["report"].isNotNull(), e["report"]).otherwise(before("report"))
        finished = F.when(legal, F.when(after != "pending", e["at"])).otherwise(before("finished"))
        row = F.struct(e["place"].alias("event_id"), e["move"].alias("move"), legal.alias("legal"), new_status.alias("status"), new_report.alias("report"))
        return F.struct(new_status.alias("status"), new_report.alias("report"), finished.alias("finished"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    acc_types = {"status": "string", "report": "string", "finished": "long"}
    none = F.lit(None)
    rows = F.array().cast("array<struct<event_id: bigint, move: string, legal: boolean, status: string, report: string>>")
    zero = F.struct(none.cast("string").alias("status"), none.cast("string").alias("report"), none.cast("long").alias("finished"), rows.alias("rows"))
    return grouped.select("job_id", F.inline(F.aggregate("events", zero, step, lambda acc: acc["rows"])))


def job_status(jobs: DataFrame) -> DataFrame:
    """job_id, status, report: the report only where the job is completed."""
    return jobs.select("job_id", "status", F.when(F.col("status") == "completed", F.col("report_text")).alias("report"))


def admitted_scans(requests: DataFrame, *, user: str, order: tuple[str, ...], key: str, is_scan: Column, premium: Column, used: Column, limit: int = FREE_SCANS) -> DataFrame:
    """Adds accepted to the requests: scans of free users count against the quota, other requests only use it up.

    The first ``limit`` rows of a free user always count, so a scan is accepted
    if its number among the user's rows and what was used before stay within
    the limit. Only the first rows of each user are ranked, which the planner
    turns into a group limit before the shuffle.
    """
    first = Window.partitionBy(user).orderBy(*order)
    n, found = fresh("n", requests), fresh("within", requests)
    within = requests.where(~premium).withColumn(n, F.row_number().over(first)).where(F.col(n) <= limit).where(used + F.col(n) <= limit).select(key, F.lit(True).alias(found))
    return requests.join(within, key, "left").withColumn("accepted", ~is_scan | premium | F.coalesce(found, F.lit(False))).drop(found)


def scan_counts(requests: DataFrame, *, user: str, order: tuple[str, ...], key: str, is_scan: Column, premium: Column, used: Column, limit: int = FREE_SCANS) -> DataFrame:
    """user, scan_count: what was used before and every accepted request of the user."""
    judged = admitted_scans(requests, user=user, order=order, key=key, is_scan=is_scan, premium=premium, used=used, limit=limit)
    return judged.groupBy(user).agg((F.max(used) + F.count_if("accepted")).alias("scan_count"))


def round_robin(rows: DataFrame, n_keys: int, *order: str) -> DataFrame:
    """Adds key_index by turns within file_name; the rows of one file are one request's."""
    return rows.withColumn("key_index", F.pmod(F.row_number().over(Window.partitionBy("file_name").orderBy(*order)) - 1, F.lit(n_keys)))


def memberships(events: DataFrame) -> DataFrame:
    """user_id, org_id, role: the last of each user's workspace events (create makes an admin, join a developer)."""
    role = F.when(F.col("action") == "create", "admin").otherwise("developer")
    return latest(events.withColumn("role", role), "user_id", "seq").select("user_id", "org_id", "role")
