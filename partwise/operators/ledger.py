"""Stage plans and append-only event chains: readiness, verification, state and accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.functions.hashing import canonical_json_hash

#: The status that each type of event leaves an attempt in. Fixed values.
STATUS_OF = {
    "CLAIMED": "CLAIMED_BEFORE_NAMESPACE_OR_MODEL",
    "HEARTBEAT": "CLAIMED_BEFORE_NAMESPACE_OR_MODEL",
    "SCIENTIFIC_STARTED": "CLAIMED_BEFORE_NAMESPACE_OR_MODEL",
    "SCIENTIFIC_FINISHED": "CLAIMED_BEFORE_NAMESPACE_OR_MODEL",
    "FAILED": "FAILED_RECORDED",
    "INTERRUPTED": "INTERRUPTED_RECORDED",
    "COMPLETED": "COMPLETED_ACCEPTED",
    "CLEANUP": "COMPLETED_ACCEPTED",
}


def stage_identity(stage: Mapping[str, object]) -> tuple[str, str]:
    """Hash of what a stage computes (kind, key, dependencies, lock, execution, outputs) and hash of its whole specification."""
    core = {k: stage.get(k) for k in ("kind", "key", "dependencies", "protocol_lock_sha256", "execution", "expected_outputs")}
    identity = canonical_json_hash(core)
    return identity, canonical_json_hash({**{k: v for k, v in stage.items() if k != "stage_spec_sha256"}, "scientific_identity_sha256": identity})


def plan_problems(stages: DataFrame) -> DataFrame:
    """(problem, identity): identities and namespaces that repeat, dependencies that no stage has, and unsafe paths. ``stages``: position, identity, namespace, dependencies (array)."""
    repeated = lambda c, name: stages.groupBy(c).agg(F.count(F.lit(1)).alias("_n"), F.min("identity").alias("_i")).filter("_n > 1").select(F.lit(name).alias("problem"), F.col("_i").alias("identity"))
    deps = stages.select("identity", F.explode("dependencies").alias("d"))
    unknown = deps.join(stages.select(F.col("identity").alias("d")), "d", "left_anti").select(F.lit("unknown_dependency").alias("problem"), "identity")
    unsafe = stages.filter(F.col("namespace").rlike(r"(^/)|(^|/)\.\.(/|$)|\\|:")).select(F.lit("unsafe_namespace").alias("problem"), "identity")
    return repeated("identity", "repeated_identity").unionByName(repeated("namespace", "repeated_namespace")).unionByName(unknown).unionByName(unsafe).distinct()


def locked_problems(plan: Mapping[str, object], locked: DataFrame, files: DataFrame) -> DataFrame:
    """(problem, path): a plan whose own hash (``plan_sha256``, over all its other fields) is wrong, and locked files that are absent or whose bytes changed.

    ``locked``: path, size, sha256; ``files``: an inventory of what is there now.
    """
    spark = locked.sparkSession
    own = canonical_json_hash({k: v for k, v in plan.items() if k != "plan_sha256"})
    head = spark.createDataFrame([] if plan.get("plan_sha256") == own else [("plan_hash", "")], "problem string, path string")
    now = locked.join(files.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h")), "path", "left")
    problem = F.when(F.col("_h").isNull(), "locked_absent").when((F.col("_s") != F.col("size")) | (F.col("_h") != F.col("sha256")), "locked_changed")
    return head.unionByName(now.select(problem.alias("problem"), "path").filter("problem IS NOT NULL"))


def ready_stages(stages: DataFrame, done: DataFrame) -> DataFrame:
    """Stages not done whose dependencies all are, in plan order (``position``); the first is next. ``done``: identity, receipts of other plans included."""
    d = done.select("identity").distinct()
    open_ = stages.join(d, "identity", "left_anti")
    waiting = open_.select("identity", F.explode("dependencies").alias("dep")).join(d.withColumnRenamed("identity", "dep"), "dep", "left_anti").select("identity").distinct()
    return open_.join(waiting, "identity", "left_anti").select("position", "identity")


def next_stage(stages: DataFrame, done: DataFrame) -> str | None:
    """The identity of the next stage, None when all are done; an error when some are left and none is ready."""
    first = ready_stages(stages, done).orderBy("position").limit(1).collect()
    if first:
        return first[0]["identity"]
    if not stages.join(done.select("identity"), "identity", "left_anti").isEmpty():
        raise RuntimeError("stages are left but none is ready")
    return None


def chain_problems(events: DataFrame, statuses: Mapping[str, str] = STATUS_OF) -> DataFrame:
    """(identity, event_index, problem) for every breach of a chain.

    ``events``: identity, event_index, event_type, attempt, status, spec, event_hash, own_hash
    (recomputed by the caller), prev_hash. Checked: self-hash, indexes from 1 without
    gaps, link to the previous hash, one specification, known type with its status,
    attempts that go up by one and begin with a claim, one claim each. A chain is
    ordered in one window per identity.
    """
    w = Window.partitionBy("identity").orderBy("event_index")
    known = F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv])
    e = events.withColumn("_n", F.row_number().over(w)).withColumn("_ph", F.lag("event_hash").over(w)).withColumn("_pa", F.lag("attempt").over(w)).withColumn("_sp", F.first("spec").over(w))
    new = F.col("attempt") == F.coalesce("_pa", F.lit(0)) + 1
    same = F.col("attempt") == F.col("_pa")
    rules = {
        "self_hash": ~F.col("event_hash").eqNullSafe(F.col("own_hash")),
        "index": F.col("event_index") != F.col("_n"),
        "link": ~F.col("prev_hash").eqNullSafe(F.col("_ph")),
        "specification": ~F.col("spec").eqNullSafe(F.col("_sp")),
        "status": ~F.coalesce(F.try_element_at(known, F.coalesce("event_type", F.lit(""))) == F.col("status"), F.lit(False)),
        "attempt_order": ~F.coalesce(new | same, F.lit(False)),
        "attempt_start": F.coalesce(new & (F.col("event_type") != "CLAIMED"), F.lit(False)),
        "repeated_claim": F.coalesce(same & (F.col("event_type") == "CLAIMED"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return e.select("identity", "event_index", F.explode(found).alias("problem"))


def attempt_states(events: DataFrame) -> DataFrame:
    """(identity, attempt, last_event, status, at): the last event of each attempt."""
    last = F.max_by(F.struct("event_type", "status", "at"), F.col("event_index"))
    return events.groupBy("identity", "attempt").agg(last.alias("l")).select("identity", "attempt", F.col("l.event_type").alias("last_event"), F.col("l.status").alias("status"), F.col("l.at").alias("at"))


def status_summary(events: DataFrame) -> DataFrame:
    """One row: stages completed, attempts failed and interrupted, the last heartbeat, and the latest failure's time and identity."""
    a = attempt_states(events)
    s = a.agg(
        F.count_distinct(F.when(F.col("status") == "COMPLETED_ACCEPTED", F.col("identity"))).alias("completed_stages"),
        F.count_if(F.col("status") == "FAILED_RECORDED").alias("failed_attempts"), F.count_if(F.col("status") == "INTERRUPTED_RECORDED").alias("interrupted_attempts"),
        F.max(F.when(F.col("status").isin("FAILED_RECORDED", "INTERRUPTED_RECORDED"), F.struct("at", "identity"))).alias("e"),
    )
    beat = events.filter("event_type = 'HEARTBEAT'").agg(F.max("at")).scalar()
    return s.select("completed_stages", "failed_attempts", "interrupted_attempts", beat.alias("last_heartbeat"), F.col("e.at").alias("last_error_at"), F.col("e.identity").alias("last_error_identity"))


def runtime_seconds(attempts: DataFrame, now: float) -> DataFrame:
    """Per identity the seconds of all attempts (``started``, ``finished`` as unix seconds); running ones count up to ``now``, none below zero."""
    spent = F.when(F.col("started").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.col("finished"), F.lit(now)) - F.col("started")))
    return attempts.groupBy("identity").agg(F.count(F.lit(1)).alias("n_attempts"), F.sum(spent).alias("seconds"))


def accepted_attempts(states: DataFrame) -> DataFrame:
    """(identity, attempt) of stages with exactly one completed attempt."""
    return states.filter("status = 'COMPLETED_ACCEPTED'").groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min("attempt").alias("attempt")).filter("n = 1").select("identity", "attempt")


def release_gate(required: DataFrame, accepted: DataFrame) -> None:
    """Raises unless every required identity is accepted. Call it before the scan of labels is even constructed."""
    missing = required.select("identity").join(accepted.select("identity"), "identity", "left_anti")
    if not missing.isEmpty():
        raise RuntimeError("labels stay closed: predictions are missing")


def resource_projection(rows_per_fold: DataFrame, seconds_per_row: float, stages_per_fold: int) -> DataFrame:
    """(outer_fold, n_train_rows, seconds): projected time from exact numbers of training rows."""
    return rows_per_fold.select("outer_fold", "n_train_rows", (F.col("n_train_rows") * seconds_per_row * stages_per_fold).alias("seconds"))


def accounting(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys the traces, finished and failed ones, and summed seconds of ``kind`` fit and predict."""
    s = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("seconds"))), F.lit(0.0))
    return traces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("finished").alias("n_finished"), F.count_if(~F.col("finished")).alias("n_failed"), s("fit").alias("fit_seconds"), s("predict").alias("predict_seconds"))
