"""Decisions on title labels by hand, by models and by occupation codes, and the occupation dimension itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.sources.tables import merge_upsert

#: States of a title, and the confidence from which a model's decision counts.
STATES = ("review", "target", "non_target")
GATES = {"target": 0.88, "non_target": 0.84}


def _changed(labels: DataFrame, rows: DataFrame, source: str, as_of: str) -> DataFrame:
    """History rows of the titles whose state changes."""
    old = labels.select("normalized_title", F.col("classification_status").alias("previous_status"))
    new = rows.select("normalized_title", "classification_status").join(old, "normalized_title", "left")
    return new.where(~F.col("classification_status").eqNullSafe(F.col("previous_status"))).withColumns({"source": F.lit(source), "changed_at": F.lit(as_of).cast("timestamp")})


def apply_manual_labels(labels: DataFrame, decisions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(labels, history) after decisions by hand (normalized_title, classification_status, canonical_role, decided_at).

    Of a title the latest decision with a known state counts. A target without a role keeps its old one.
    """
    good = decisions.where(F.col("classification_status").isin(*STATES) & (F.trim("normalized_title") != ""))
    latest = good.groupBy("normalized_title").agg(F.max_by(F.struct("classification_status", "canonical_role"), F.struct("decided_at", "classification_status")).alias("d")).select("normalized_title", "d.*")
    role = F.when(F.col("classification_status") == "target", F.coalesce(F.nullif(F.trim("canonical_role"), F.lit("")), F.col("old_role")))
    known = labels.select("normalized_title", F.col("canonical_role").alias("old_role"))
    rows = latest.join(known, "normalized_title", "left").select("normalized_title", "classification_status", role.alias("canonical_role"), F.lit("manual-v1").alias("rule_version"))
    return merge_upsert(labels, rows.select(*labels.columns), ["normalized_title"]), _changed(labels, rows, "manual", as_of)


def eligible_model_decisions(labels: DataFrame, decisions: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """Of each title for review and not labelled by hand, the latest decision, where its confidence passes its state's gate."""
    gates = gates or GATES
    latest = decisions.groupBy("normalized_title").agg(F.max_by(F.struct("classification_status", "confidence"), F.struct("created_at", "classification_status")).alias("d")).select("normalized_title", "d.*")
    passes = F.coalesce(*(F.when(F.col("classification_status") == s, F.col("confidence") >= g) for s, g in gates.items()), F.lit(False))
    open_titles = labels.where((F.col("classification_status") == "review") & ~F.coalesce(F.col("rule_version").startswith("manual"), F.lit(False))).select("normalized_title")
    return latest.where(passes).join(open_titles, "normalized_title", "left_semi")


def apply_model_decisions(labels: DataFrame, decisions: DataFrame, limit: int, as_of: str, version: str = "model-v1") -> tuple[DataFrame, DataFrame]:
    """(labels, history) after the most confident eligible decisions, ``limit`` of them at most."""
    rows = eligible_model_decisions(labels, decisions).orderBy(F.desc("confidence"), "normalized_title").limit(limit)
    rows = rows.select("normalized_title", "classification_status", F.lit(None).cast("string").alias("canonical_role"), F.lit(version).alias("rule_version"))
    return merge_upsert(labels, rows.select(*labels.columns), ["normalized_title"], {"canonical_role": "coalesce"}), _changed(labels, rows, version, as_of)


def mark_applied(decisions: DataFrame, history: DataFrame) -> DataFrame:
    """``decisions`` (with ``applied``) after a run: those of titles whose label the run has changed are applied."""
    done = history.select("normalized_title").distinct().withColumn("done", F.lit(True))
    return decisions.join(done, "normalized_title", "left").withColumn("applied", F.col("applied") | F.col("done").isNotNull()).select(*decisions.columns)


def applied_counts(history: DataFrame) -> DataFrame:
    """One row: how many titles a run has changed, and to what."""
    state = F.col("classification_status")
    return history.agg(F.count("*").alias("applied_count"), F.count_if(state == "target").alias("target_count"), F.count_if(state == "non_target").alias("non_target_count"))


def apply_soc_labels(labels: DataFrame, candidates: DataFrame, version: str = "soc-exact-v1") -> DataFrame:
    """Labels still open and without a version take the state that their occupation codes suggest."""
    ready = candidates.where("suggested_status <> 'review'").select("normalized_title", F.col("suggested_status").alias("suggested"))
    rows = labels.join(ready, "normalized_title", "left")
    hit = (F.col("classification_status") == "review") & F.col("rule_version").isNull() & F.col("suggested").isNotNull()
    return rows.withColumns({"classification_status": F.when(hit, F.col("suggested")).otherwise(F.col("classification_status")), "rule_version": F.when(hit, version).otherwise(F.col("rule_version"))}).drop("suggested")


def apply_soc_review(target_soc: DataFrame, review: DataFrame) -> DataFrame:
    """The occupation dimension after a review (code, title, review_status, lca_count): reviewed targets are active, others not.

    The title of a code is that with most filings.
    """
    reviewed = review.groupBy("normalized_soc_code").agg(F.min_by("soc_title", F.struct(-F.col("lca_count"), "soc_title")).alias("representative_title"), F.bool_or(F.col("review_status") == "target").alias("active"))
    kept = target_soc.join(reviewed.select("normalized_soc_code"), "normalized_soc_code", "left_anti").withColumn("active", F.lit(False))
    return reviewed.unionByName(kept.select(*reviewed.columns))
