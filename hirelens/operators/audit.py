"""Change capture between snapshots, validated appends and audit history.

The reference's row store updates one candidate at a time and logs each
changed field.  Here a whole snapshot is compared to the previous one: one
equi-join on the candidate id (sort-merge at scale; ids are unique so the join
is skew-free), then each row is unpivoted into (field, old, new) with a single
``stack``-style ``inline`` and unchanged fields are filtered out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S

MANY_ROWS = 1000  # an id with more rows is reduced before the shuffle


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(c: Column) -> Column:
    """NULL -> '' else the value as text (the audit comparison form)."""
    return F.coalesce(c.cast("string"), F.lit(""))


def change_audit(old: DataFrame, new: DataFrame, key: str = "candidate_id", changed_by: str = "recruiter",
                 fields: tuple[str, ...] = S.AUDITABLE_FIELDS) -> DataFrame:
    """One ``UPDATE <field>`` row per changed auditable field of every candidate in both snapshots."""
    present = [f for f in fields if f in old.columns and f in new.columns]
    # a snapshot holds one row per candidate (the row store's primary key): reduce each side
    # to one row per id first, so a repeated id can never multiply the join; the min_by
    # aggregate is partial (skew-safe) and leaves both sides hash-partitioned on the id
    o = first_per_key(old.select(_q(key).alias("_k"), *[_text(_q(f)).alias(f"o__{f}") for f in present]), "_k")
    n = first_per_key(new.select(_q(key).alias("_k"), *[_text(_q(f)).alias(f"n__{f}") for f in present]), "_k")
    j = o.join(n, "_k")
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("field_order"), F.lit(f"UPDATE {f}").alias("action"),
                               F.col(f"o__{f}").alias("old_value"), F.col(f"n__{f}").alias("new_value"))
                      for i, f in enumerate(present)])
    changed = F.filter(pairs, lambda x: x["old_value"] != x["new_value"])
    return j.select(F.col("_k").alias(key), F.inline(changed)).withColumn("changed_by", F.lit(changed_by))


def first_per_key(df: DataFrame, key: str, order_col: str | None = None) -> DataFrame:
    """First row per key in ``order_col`` order (ties broken by the whole row, deterministic).

    ``min_by`` is a partial aggregate: each task keeps one candidate row per key
    before the shuffle, so a key holding a third of all rows never lands in one
    task as a whole (a ``row_number`` window would sort the entire group there).
    """
    others = [c for c in df.columns if c != key]
    # ids are nearly always unique: a narrow count finds the repeated ones, and only their rows are compared
    again = df.groupBy(_q(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again")
    same = _q(key).eqNullSafe(F.col("_again"))
    single = df.join(again, same, "left_anti")
    df = df.join(again, same, "left_semi")
    order = ([_q(order_col)] if order_col else []) + [_q(c) for c in others]
    picked = df.groupBy(_q(key)).agg(
        F.min_by(F.struct(*[_q(c) for c in others]), F.struct(*order)).alias("_row"))
    return single.unionByName(picked.select(*[_q(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns]))


def complete_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Add absent expected columns as NULL and keep the expected order."""
    return df.select(*[(_q(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in expected])


def import_if_new(target: DataFrame, incoming: DataFrame, key: str = "candidate_id",
                  expected: list[str] | None = None, order_col: str | None = None) -> DataFrame:
    """Rows appended by an insert-or-ignore load — columns completed, first row per key,
    keys already in ``target`` ignored (``left_anti``)."""
    expected = expected or list(target.columns)
    new = complete_columns(incoming, expected).join(target.select(_q(key)), key, "left_anti")
    return first_per_key(new, key, order_col).select(*[_q(c) for c in expected])


def append_validated(target: DataFrame, incoming: DataFrame, key: str = "candidate_id",
                     required: tuple[str, ...] = ("candidate_id", "candidate_name", "role"),
                     changed_by: str = "recruiter", order_col: str | None = None) -> DataFrame:
    """Accepted new candidates with their CREATE audit fields.

    Rejected: a required field blank, or the id already present (in the target,
    or earlier in the batch — the first row per id wins)."""
    ok = None
    for r in required:
        cond = F.coalesce(F.regexp_replace(_q(r).cast("string"), r"^\s+|\s+$", ""), F.lit("")) != ""
        ok = cond if ok is None else ok & cond
    valid = incoming.filter(ok).withColumn(key, F.regexp_replace(_q(key).cast("string"), r"^\s+|\s+$", ""))
    fresh = first_per_key(valid.join(target.select(_q(key)), key, "left_anti").select(*valid.columns), key, order_col)
    return fresh.withColumn("action", F.lit("CREATE")) \
                .withColumn("old_value", F.lit(None).cast("string")) \
                .withColumn("new_value", F.lit("Candidate created")) \
                .withColumn("changed_by", F.lit(changed_by))


def audit_history(audit: DataFrame, candidate_id: str, key: str = "candidate_id",
                  order_col: str = "field_order") -> DataFrame:
    """The audit rows of one candidate, newest first."""
    return audit.filter(_q(key) == candidate_id).orderBy(_q(order_col).desc())


def change_history(snapshots: DataFrame, key: str = "candidate_id", number: str = "snapshot_no", taken_at: str = "taken_at",
                   changed_by: str = "recruiter", fields: tuple[str, ...] = S.AUDITABLE_FIELDS) -> DataFrame:
    """X1 over any number of snapshots in one table: an event for every field that differs from the id's snapshot before.

    An id that a later snapshot has first is created in it.  Rows of one id and snapshot are reduced
    to the least, and an id's versions, one a snapshot, stand side by side by ``lag``.  Both need the
    rows of an id together, which one shuffle by id does; a narrow count finds the ids that have very
    many rows, and those are reduced in the tasks that read them, so none is sorted whole.
    """
    present = [f for f in fields if f in snapshots.columns]
    rows = snapshots.where(_q(key).isNotNull()).select(_q(key).alias("_k"), _q(number).alias("_no"), _q(taken_at).alias("_at"), F.struct(
        *[_text(_q(f)).alias(f) for f in present]).alias("_v"))
    least = (F.min("_at").alias("_at"), F.min("_v").alias("_v"))
    hot = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_ROWS).select("_k")
    if not hot.isEmpty():
        rows = rows.join(hot, "_k", "left_anti").unionByName(rows.join(hot, "_k", "left_semi").groupBy("_k", "_no").agg(*least))
    first = rows.repartition("_k").groupBy("_k", "_no").agg(*least)
    earliest = Window.partitionBy("_k").orderBy("_no")
    chain = first.withColumn("_old", F.lag("_v").over(earliest))
    opening = snapshots.agg(F.min(number)).first()[0]
    updates = F.array(*[F.struct(F.lit(i + 1).alias("field_order"), F.lit(f"UPDATE {f}").alias("action"), F.col(f"_old.`{f}`").alias("old_value"),
                                 F.col(f"_v.`{f}`").alias("new_value")) for i, f in enumerate(present)])
    created = F.array(F.struct(F.lit(0).alias("field_order"), F.lit("CREATE").alias("action"), F.lit(None).cast("string").alias("old_value"),
                               F.lit("Candidate created").alias("new_value")))
    events = F.when(F.col("_old").isNotNull(), F.filter(updates, lambda x: x["old_value"] != x["new_value"])) \
        .when(F.col("_no") > F.lit(opening), created).otherwise(F.filter(updates, lambda x: F.lit(False)))
    return chain.select(F.col("_k").alias(key), F.col("_no").alias("snapshot_no"), F.col("_at").alias("changed_at"), F.inline(events)) \
        .withColumn("changed_by", F.lit(changed_by))


def append_history(events: DataFrame, path: str) -> DataFrame:
    """The audit log at ``path`` after its snapshots' events were written; a rerun replaces them and so adds none again."""
    (events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_no").parquet(path))
    return events.sparkSession.read.schema(events.schema).parquet(path).select(*events.columns)


def newest_first(history: DataFrame, ids: list[str], key: str = "candidate_id") -> DataFrame:
    """The audit rows of some candidates, newest first by time, with their place."""
    order = Window.partitionBy(key).orderBy(F.desc("changed_at"), F.desc("snapshot_no"), F.desc("field_order"))
    return history.where(_q(key).isin(ids)).withColumn("place", F.row_number().over(order))


def database_summary(candidates: DataFrame, audit: DataFrame) -> DataFrame:
    """Row counts of the candidate table and the audit log, as one row."""
    c = candidates.agg(F.count(F.lit(1)).alias("candidates"))
    a = audit.agg(F.count(F.lit(1)).alias("audit_events"))
    from ..functions.text import one_row
    return one_row(c, a)
