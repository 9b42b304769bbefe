"""Records of what a run considered, and reviewers' labels as they stood when a run was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Most urls of a record, and characters of its excerpt.
MOST_URLS, EXCERPT = 5, 600
# The columns of a record, in order.
RECORD = (
    "candidate_id story_key candidate_kind disposition filter_stage filter_reason_code legacy_skip_reason review_stratum headline category culture_lane canonical_url all_urls_json url_hashes_json "
    "sources_json source_count summary_excerpt delivered_paragraph total_score importance evidence_score quality_score content_quality_penalty llm_importance deck_rank selection_phase is_update "
    "merged_from_json"
).split()
# End of fixed values.


def digest(value: Column) -> Column:
    """SHA-256 of the value as JSON without spaces."""
    return F.sha2(F.to_json(value), 256)


def _quoted(value: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(value))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def listed(values: Column) -> Column:
    """A list of texts as JSON with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, _quoted), ", "), F.lit("]"))


def stage_of(reason: Column) -> Column:
    """(stage, code) of a story's own reason for being passed over."""
    pair = lambda stage, code: F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"))
    r = T.nonnull(reason)
    return (
        F.when(r == "stale/repeated from yesterday", pair("history", "history_stale")).when(F.contains(r, F.lit("evidence")) | F.contains(r, F.lit("reliable source")), pair("evidence", "evidence_gate"))
        .when(F.contains(r, F.lit("duplicate")), pair("duplicate", "duplicate_gate_merged")).otherwise(pair("selection", "selection_below_threshold"))
    )


def _urls(urls: Column) -> Column:
    """Different urls without query and closing slashes, the first ones by name."""
    given = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(u != "", F.lit(False)))
    return F.slice(F.array_sort(F.array_distinct(F.transform(given, T.url_canonical))), 1, MOST_URLS)


def candidate_records(stories: DataFrame, rejected: DataFrame, paragraphs: DataFrame, events: DataFrame, selections: DataFrame, run_id: str, deck_target: int) -> DataFrame:
    """The records (:data:`RECORD`) of a run's stories and refused articles, one for each kind and story key.

    Stories are (key, seq, title, category, lane, urls, sources, summary, day, total, importance, evidence, quality, penalty,
    is_update, skip_reason, merged_from); refused articles (article_id, seq, title, source, url, canonical_url, day, text,
    penalty, stage, code, skip_reason). Paragraphs (key, paragraph) tell what was sent, events (key, stage, code,
    skip_reason) what ended a story, selections (key, phase, code) how choosing went; at most one row a key. A story's key
    is a digest of its urls, or without any of its title and day. Of records with one key the first by ``seq`` stays.
    """
    one = lambda rows, *cols: rows.select("key", *[F.col(c).alias(f"__{n}") for c, n in cols])
    s = stories.join(one(paragraphs, ("paragraph", "p")), "key", "left").join(one(events, ("stage", "es"), ("code", "ec"), ("skip_reason", "er")), "key", "left")
    s = s.join(one(selections, ("phase", "sp"), ("code", "sc")), "key", "left").withColumn("u", _urls(F.col("urls")))
    selected, own = F.col("__p").isNotNull(), stage_of(F.col("skip_reason"))
    stage = F.when(selected, "").when(F.col("__es").isNotNull(), F.col("__es")).when(F.col("__sc").isNotNull(), "selection").otherwise(own["stage"])
    code = F.when(selected, "").when(F.col("__es").isNotNull(), F.col("__ec")).when(F.col("__sc").isNotNull(), F.col("__sc")).otherwise(own["code"])
    near = max(1.0, 0.2 * deck_target)
    stratum = F.when(selected, "selected").when(F.col("total") >= near, "near_miss").when(F.col("total") >= 0, "mid").otherwise("deep_filtered")
    day = F.col("day").cast("string")
    unnamed = digest(F.array(F.lower("title"), day))
    nothing, text = F.array().cast("array<string>"), lambda x: F.lit(x).cast("string")
    told = s.select(
        "seq", F.when(F.size("u") > 0, digest(F.col("u"))).otherwise(unnamed).alias("story_key"), text("cluster").alias("candidate_kind"), F.when(selected, "selected").otherwise("filtered").alias("disposition"),
        stage.alias("filter_stage"), code.alias("filter_reason_code"), F.coalesce("__er", T.nonnull(F.col("skip_reason"))).alias("legacy_skip_reason"), stratum.alias("review_stratum"), F.col("title").alias("headline"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")).alias("category"), T.nonnull(F.col("lane")).alias("culture_lane"), F.coalesce(F.get("u", F.lit(0)), F.lit("")).alias("canonical_url"), "u",
        F.coalesce("sources", nothing).alias("sources"), F.substring(T.nonnull(F.col("summary")), 1, EXCERPT).alias("summary_excerpt"), F.coalesce("__p", F.lit("")).alias("delivered_paragraph"),
        F.col("total").alias("total_score"), "importance", F.col("evidence").alias("evidence_score"), F.col("quality").alias("quality_score"), F.col("penalty").alias("content_quality_penalty"),
        F.when(selected, F.col("seq")).cast("int").alias("deck_rank"), F.when(selected, F.coalesce("__sp", F.lit(""))).otherwise("").alias("selection_phase"), "is_update", F.coalesce("merged_from", nothing).alias("merged_from"),
    )
    r = rejected.withColumn("u", _urls(F.array(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")))))
    zero = F.lit(0.0)
    refused = r.select(
        "seq", F.when(F.size("u") > 0, digest(F.col("u"))).otherwise(digest(F.array("source", F.lower("title"), day))).alias("story_key"), text("hard_rejected_article").alias("candidate_kind"), text("filtered").alias("disposition"),
        F.col("stage").alias("filter_stage"), F.col("code").alias("filter_reason_code"), T.nonnull(F.col("skip_reason")).alias("legacy_skip_reason"), text("hard_reject").alias("review_stratum"), F.col("title").alias("headline"),
        text("uncategorized").alias("category"), text("").alias("culture_lane"), F.coalesce(F.get("u", F.lit(0)), F.lit("")).alias("canonical_url"), "u", F.array("source").alias("sources"),
        F.substring(T.nonnull(F.col("text")), 1, EXCERPT).alias("summary_excerpt"), text("").alias("delivered_paragraph"), zero.alias("total_score"), zero.alias("importance"), zero.alias("evidence_score"), zero.alias("quality_score"),
        F.col("penalty").alias("content_quality_penalty"), F.lit(None).cast("int").alias("deck_rank"), text("").alias("selection_phase"), F.lit(False).alias("is_update"), nothing.alias("merged_from"),
    )
    every = told.unionByName(refused)
    values = [c for c in every.columns if c not in ("candidate_kind", "story_key")]
    # of one key the first record by seq, and of one seq the least of the whole record, so that reruns agree
    first = every.groupBy("candidate_kind", "story_key").agg(F.min(F.struct("seq", *[c for c in values if c != "seq"])).alias("x")).select("candidate_kind", "story_key", "x.*")
    full = first.select(
        digest(F.array(F.lit(run_id), "candidate_kind", "story_key")).alias("candidate_id"), "*", listed(F.col("u")).alias("all_urls_json"), listed(F.transform("u", lambda u: F.sha2(_quoted(u), 256))).alias("url_hashes_json"),
        listed(F.col("sources")).alias("sources_json"), F.size("sources").alias("source_count"), listed(F.col("merged_from")).alias("merged_from_json"), F.lit(None).cast("int").alias("llm_importance"),
    )
    return full.select(*RECORD)


def labels_before(candidates: DataFrame, runs: DataFrame, labels: DataFrame, examples: DataFrame) -> DataFrame:
    """Candidates (candidate_id, run_id, story_key) with their run's (run_id, pipeline_version, created_at) version and what
    reviewers had last said of their story when the run was made: (..., pipeline_version, verdict, labelled, labelled_at).

    Labels are (subject_id, verdict, created_at), a row for every version; examples (candidate_id, verdict, reviewed_at) are
    stories that reviewers brought themselves and that were matched. Both are of a candidate, and count for all candidates
    of its story that a run made from their time on has; of one time the greater verdict, then candidate counts. Pending
    examples say nothing. Labels and runs are put in one order of time for each story, so that none meets another in a join.
    """
    said = labels.select(F.col("subject_id").alias("candidate_id"), "verdict", F.col("created_at").alias("at"))
    said = said.unionByName(examples.where("verdict <> 'pending'").select("candidate_id", "verdict", F.col("reviewed_at").alias("at"))).where(F.col("at").isNotNull())
    told = said.join(candidates.select("candidate_id", "story_key"), "candidate_id")
    told = told.groupBy("story_key", "at").agg(F.max(F.struct("verdict", F.col("candidate_id").alias("labelled"))).alias("label"))
    own = candidates.select("candidate_id", "run_id", "story_key").join(runs.select("run_id", "pipeline_version", F.col("created_at").alias("at")), "run_id")
    both = own.select("story_key", "at", F.lit(None).cast(told.schema["label"].dataType).alias("label"), F.struct("candidate_id", "run_id", "pipeline_version").alias("own"))
    both = both.unionByName(told.select("story_key", "at", "label", F.lit(None).cast(both.schema["own"].dataType).alias("own")))
    order = Window.partitionBy("story_key").orderBy("at", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("label").isNotNull(), F.struct("label", "at")), ignorenulls=True).over(order)
    seen = both.withColumn("x", last).where("own IS NOT NULL")
    return seen.select("own.*", "story_key", F.col("x.label.verdict").alias("verdict"), F.col("x.label.labelled").alias("labelled"), F.col("x.at").alias("labelled_at"))
