"""A log of records in which later ones supersede earlier ones, and joins against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import make_key

#: States of a record.
STATUSES = ("dropped", "shortlisted", "applied", "passed", "unverified_blocked")


def current_records(log: DataFrame, url: str = "url_key", key: str = "key", seq: str = "seq") -> DataFrame:
    """The last record of each url and the last of each key; one that is superseded by url stays if it is its key's last.
    Empty or null url or key names nothing. The maximum by an aggregate keeps a hot url from one task's sort."""
    last_url = log.where(F.coalesce(url, F.lit("")) != "").groupBy(url).agg(F.max(seq).alias(seq)).select(seq)
    last_key = log.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max(seq).alias(seq)).select(seq)
    return log.join(last_url.union(last_key).distinct(), seq, "left_semi")


def ordered_records(log: DataFrame, url: str = "url_key", key: str = "key", seq: str = "seq") -> DataFrame:
    """current_records with place, by which they are in order: records that are their url's last come where that url first came; those
    that only their key names come after them, where that key first came. First places and last versions meet in aggregates,
    which are partly made before they are shuffled, so a hot url or key is gathered nowhere."""
    last = None
    for tier, name in enumerate((url, key)):
        of = log.where(F.coalesce(name, F.lit("")) != "").groupBy(name).agg(F.max(seq).alias(seq), F.struct(F.lit(tier).alias("tier"), F.lit(0).alias("run"), F.min(seq).alias("seq"), F.lit("").alias("at")).alias("place")).drop(name)
        last = of if last is None else last.unionByName(of)
    return log.join(last.groupBy(seq).agg(F.min("place").alias("place")), seq)


def run_drops(rows: DataFrame, url: str = "url_key", seq: str = "long") -> DataFrame:
    """What a run has dropped as records that follow those of the log: url, company_key, role, locdom, status, reason, place. The link
    checks' drops come after those of the filters; of each kind by platform and url."""
    late = F.col("drop_reason").isin("stale", "unverified_blocked")
    blocked = F.col("drop_reason") == "unverified_blocked"
    reason = F.when(blocked, "Unverified/Blocked").when(late, "Stale/Expired").otherwise("Filtered Out")
    place = F.struct(F.lit(0).alias("tier"), F.when(late, 2).otherwise(1).alias("run"), F.lit(0).cast(seq).alias("seq"), F.concat_ws(" ", "platform", url).alias("at"))
    status = F.when(blocked, "unverified_blocked").otherwise("dropped")
    return rows.where("drop_reason IS NOT NULL").select(url, "company_key", F.col("title").alias("role"), F.col("loc").alias("locdom"), status.alias("status"), reason.alias("reason"), place.alias("place"))


def checked(df: DataFrame, status: str = "status") -> DataFrame:
    """Fails on a state out of the list."""
    return df.withColumn(status, F.when(F.col(status).isin(*STATUSES), F.col(status)).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(F.col(status), F.lit("null"))))))


def two_tier_new(cands: DataFrame, seen: DataFrame, url: str = "url_key", key: str = "key", company: str = "company_key") -> DataFrame:
    """Candidates that neither url nor, where they name a company, key has in the log: two anti-joins, which stay equi-joins."""
    fresh = cands.join(seen.select(url).distinct(), url, "left_anti")
    known = seen.where(F.col(company) != "").select(F.col(key).alias("_seen_key")).distinct()
    return fresh.join(known, (F.col(key) == F.col("_seen_key")) & (F.col(company) != ""), "left_anti")


def two_tier_lookup(cands: DataFrame, seen: DataFrame, payload: list[str], url: str = "url_key", key: str = "key", company: str = "company_key", seq: str = "seq") -> DataFrame:
    """cands with `matched` (struct of payload; the url's record before the key's; null if none) and `matched_by`."""
    pack = F.struct(*payload)
    by_url = seen.groupBy(url).agg(F.max_by(pack, F.col(seq)).alias("_u"))
    by_key = seen.where(F.col(company) != "").groupBy(F.col(key).alias("_key")).agg(F.max_by(pack, F.col(seq)).alias("_k"))
    out = cands.join(by_url, url, "left").join(by_key, (F.col(key) == F.col("_key")) & (F.col(company) != ""), "left")
    return out.withColumn("matched", F.coalesce("_u", "_k")).withColumn("matched_by", F.when(F.col("_u").isNotNull(), "url").when(F.col("_k").isNotNull(), "key")).drop("_u", "_k", "_key")


def prior_company(df: DataFrame, company: str, url: str, order: str, payload: list[str], most: int = 8) -> DataFrame:
    """df with prior: the first `most` records, by order, of the same company and another url.

    Of one url at most `most` records can be wanted, and with these left out at most `most` others: so the first 2 * most of
    each company decide. They are ranked within salted parts first, and a company of a third of all rows is never gathered
    in one task."""
    by_url = Window.partitionBy(company, url).orderBy(order)
    parts = df.withColumn("_r", F.row_number().over(by_url)).where(F.col("_r") <= most).withColumn("_salt", F.pmod(F.xxhash64(url), F.lit(64)))
    firsts = parts.withColumn("_r", F.row_number().over(Window.partitionBy(company, "_salt").orderBy(order, url))).where(F.col("_r") <= 2 * most)
    firsts = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(company).orderBy(order, url))).where(F.col("_r") <= 2 * most)
    lists = firsts.groupBy(company).agg(F.array_sort(F.collect_list(F.struct(*dict.fromkeys([order, url, *payload])))).alias("_all"))
    return df.join(lists, company, "left").withColumn("prior", F.slice(F.filter("_all", lambda p: p[url] != F.col(url)), 1, most)).drop("_all")


def saturation(df: DataFrame, company: str, family: str, status: str, url: str, least: int = 2) -> DataFrame:
    """df with applied_variants: applied records of the same company and role family under other urls, and saturated."""
    counts = df.groupBy(company, family).agg(F.count_if(F.col(status) == "applied").alias("_all"))
    own = df.groupBy(company, family, url).agg(F.count_if(F.col(status) == "applied").alias("_own"))
    out = df.join(counts, [company, family], "left").join(own, [company, family, url], "left")
    n = F.coalesce(F.col("_all"), F.lit(0)) - F.coalesce(F.col("_own"), F.lit(0))
    return out.withColumn("applied_variants", n).withColumn("saturated", n >= least).drop("_all", "_own")


def company_history(
    cands: DataFrame, seen: DataFrame, most: int = 8, least: int = 2, company: str = "company_key", family: str = "family", url: str = "url_key", order: str = "seq", payload: tuple[str, ...] = ("family", "status"), also: DataFrame | None = None
) -> DataFrame:
    """cands with prior (the first `most` records of the same company under other urls, in order), applied_variants (applied ones of the
    same role family) and saturated. also: records beside the log's, such as what this run has dropped (url, company, order, payload).

    Of one url at most `most` records are wanted, and beside its own a candidate wants at most `most`, so the first 2 * most of a
    company decide. They are ranked within salted parts before they meet, so no company is gathered in one task."""
    cols = list(dict.fromkeys([company, url, order, *payload]))
    known = seen.select(*cols) if also is None else seen.select(*cols).unionByName(also.select(*cols))
    named = known.where(F.col(company) != "").withColumn("_salt", F.pmod(F.xxhash64(url), F.lit(64)))
    for by, n in (([company, url], most), ([company, "_salt"], 2 * most), ([company], 2 * most)):
        named = named.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order, url))).where(F.col("_r") <= n)
    own = named.groupBy(company).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.col(url).alias("_url"), *payload))).alias("_all"))
    out = cands.join(own, company, "left")
    others = F.slice(F.filter("_all", lambda p: ~p["_url"].eqNullSafe(F.col(url))), 1, most)
    out = out.withColumn("prior", F.transform(others, lambda p: F.struct(*[p[c].alias(c) for c in payload]))).drop("_all")
    applied = seen.where((F.col(company) != "") & (F.col("status") == "applied"))
    counts = applied.groupBy(company, family).agg(F.count(F.lit(1)).alias("_variants"))
    mine = applied.groupBy(company, family, url).agg(F.count(F.lit(1)).alias("_mine"))
    out = out.join(counts, [company, family], "left").join(mine, [company, family, url], "left")
    n = F.coalesce("_variants", F.lit(0)) - F.coalesce("_mine", F.lit(0))
    return out.withColumn("applied_variants", n.cast("long")).withColumn("saturated", n >= least).drop("_variants", "_mine")


def new_records(df: DataFrame, now: Column) -> DataFrame:
    """df with what a record starts with where it has nothing: fit, archetype, keyword_source (the role), key, first_seen, synced."""
    start = {
        "fit": F.lit("N/A"), "archetype": F.lit(""), "keyword_source": F.col("role"), "key": make_key(F.col("company"), F.col("role"), F.col("locdom")),
        "first_seen": F.date_format(now, "yyyy-MM-dd"), "synced_to_notion": F.lit(False),
    }
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in start.items()})


def append(df: DataFrame, path: str) -> None:
    """Add checked records to a log folder."""
    checked(df).write.mode("append").parquet(path)


def upsert_runs(ledger: DataFrame, run: DataFrame, keys: tuple[str, ...] = ("day", "label")) -> DataFrame:
    """The ledger of runs with the rows of run in place of those of the same day and label."""
    return ledger.join(run, list(keys), "left_anti").unionByName(run, allowMissingColumns=True)


def bump_counters(counters: DataFrame, due: dict[str, int], today: Column) -> DataFrame:
    """(name, last, sessions_since, due_at_sessions) after one more session; counters that are not there yet start today."""
    start = counters.sparkSession.createDataFrame(list(due.items()), "name string, due long")  # a few names
    both = start.join(counters, "name", "full_outer")
    return both.select(
        "name", F.coalesce("last", F.date_format(today, "yyyy-MM-dd")).alias("last"), (F.coalesce("sessions_since", F.lit(0)) + 1).cast("long").alias("sessions_since"), F.coalesce("due_at_sessions", "due").alias("due_at_sessions")
    )


def last_ran_at(ledger: DataFrame, ran_at: str = "ran_at") -> DataFrame:
    """One row: the latest time of all runs, null without one that can be read."""
    return ledger.agg(F.max(F.try_to_timestamp(F.replace(F.left(F.col(ran_at), F.lit(19)), F.lit("T"), F.lit(" ")))).alias("ran_at"))


def superseding(log: DataFrame, updates: DataFrame, next_seq: Column, url: str = "url_key", fields: list[str] | None = None) -> DataFrame:
    """New versions of the records that updates name by url, with the non-null fields of updates laid over them."""
    fields = fields or [c for c in updates.columns if c != url]
    new = updates.select(F.col(url), *[F.col(c).alias(f"_n_{c}") for c in fields])
    latest = log.groupBy(url).agg(F.max_by(F.struct(*[c for c in log.columns if c != url]), "seq").alias("_r")).select(url, "_r.*")
    joined = latest.join(new, url)
    return joined.select(*[next_seq.alias("seq") if c == "seq" else F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in log.columns])
