"""Reviews, evaluation metrics, batches, budgets and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facts import anchors, capitalized, figures


def label_metrics(labels: DataFrame, by: str, least: int = 40) -> DataFrame:
    """(by, n, relevant, rate, reportable) of labels (by, verdict), unclear verdicts left out."""
    clear = labels.where(F.col("verdict") != "unclear")
    m = clear.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "relevant").alias("relevant"))
    return m.withColumn("rate", F.col("relevant") / F.col("n")).withColumn("reportable", F.col("n") >= least)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's Wilson interval."""
    p, zz = k / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (middle - half) / (1 + zz / n), (middle + half) / (1 + zz / n)


def fn_estimate(reviewed: DataFrame, population: DataFrame) -> DataFrame:
    """One row: the share of relevant items among those not selected, each stratum (stratum, n, relevant) weighted by its
    population (stratum, total)."""
    j = reviewed.join(population, "stratum")
    return j.agg((F.sum(F.col("relevant") / F.col("n") * F.col("total")) / F.sum("total")).alias("fn_rate"), F.sum("n").alias("reviewed"))


def gate_metrics(diagnostics: DataFrame, adjudications: DataFrame, benchmark: DataFrame, by: str) -> DataFrame:
    """The thirteen counters of an evaluation for each ``by``, zero where a table has nothing.

    Diagnostics are the required sources' (state, json) of a ticker and day, json holding how many filings were eligible,
    processed, expected and caught up; adjudications (subject, verdict) are reviewers' votes; the benchmark (verdict,
    found) lists events that should have been found."""
    fields = ("eligible_filings", "processed_filings", "expected_catchup_filings", "processed_catchup_filings")
    numbers = F.from_json("json", ", ".join(f"{f} bigint" for f in fields))
    d = diagnostics.withColumn("__j", numbers).groupBy(by).agg(
        F.count(F.lit(1)).alias("evaluated_ticker_days"), F.count_if(F.col("state") == "FAILED").alias("required_source_failures"), *[F.sum(F.coalesce(F.col(f"__j.{f}"), F.lit(0))).alias(f) for f in fields]
    )

    def votes(subject: str, *verdicts: str):
        return F.count_if((F.col("subject") == subject) & F.col("verdict").isin(*verdicts))

    a = adjudications.groupBy(by).agg(
        votes("relationship_claim", "correct", "incorrect").alias("relationship_claims"), votes("relationship_claim", "incorrect").alias("false_relationship_claims"),
        votes("rendered_story", "relevant", "irrelevant").alias("rendered_stories_reviewed"), votes("rendered_story", "irrelevant").alias("irrelevant_stories"),
        votes("duplicate_event", "duplicate").alias("confirmed_duplicate_events"),
    )
    b = benchmark.where(F.col("verdict") == "material").groupBy(by).agg(F.count(F.lit(1)).alias("independent_non_filing_events"), F.count_if("found").alias("found_non_filing_events"))
    return d.join(a, by, "full").join(b, by, "full").na.fill(0)


def gate_state(metrics: DataFrame, least: int = 20) -> DataFrame:
    """:func:`gate_metrics` judged: too few to tell, passed, or failed, with ``reasons`` for the first and the last."""

    def share(part: str, of: str, none: float):
        return F.when(F.col(of) == 0, F.lit(none)).otherwise(F.col(part) / F.when(F.col(of) == 0, 1).otherwise(F.col(of)))

    few = (("independent_non_filing_events", "non_filing_events"), ("relationship_claims", "relationship_claims"), ("rendered_stories_reviewed", "rendered_stories"))
    lacking = F.array_compact(F.array(*[F.when(F.col(c) < least, f"insufficient_{name}") for c, name in few]))
    failed = F.array_compact(F.array(
        F.when(share("required_source_failures", "evaluated_ticker_days", 1.0) > 0.02, "required_source_retrieval"),
        F.when(F.col("processed_filings") != F.col("eligible_filings"), "eligible_filing_processing"),
        F.when(F.col("processed_catchup_filings") != F.col("expected_catchup_filings"), "filing_catchup"),
        F.when(share("false_relationship_claims", "relationship_claims", 0.0) > 0.05, "relationship_accuracy"),
        F.when(F.col("confirmed_duplicate_events") > 0, "same_event_duplicates"),
        F.when(share("irrelevant_stories", "rendered_stories_reviewed", 0.0) > 0.05, "story_relevance"),
        F.when(share("found_non_filing_events", "independent_non_filing_events", 0.0) < 0.80, "non_filing_recall"),
    ))
    state = F.when(F.size(lacking) > 0, "MEASURING").when(F.size(failed) == 0, "PASS").otherwise("FAIL")
    return metrics.withColumn("state", state).withColumn("reasons", F.when(F.size(lacking) > 0, lacking).otherwise(failed))


def build_batches(items: DataFrame, order: list[str], size: int = 40, most: dict[str, int] | None = None) -> DataFrame:
    """(run_id, batch, n, payload): an edition's items in JSON arrays of at most ``size``; texts that ``most`` names are cut
    to so many characters."""
    for name, chars in (most or {}).items():
        items = items.withColumn(name, F.substring(name, 1, chars))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
    rows = items.withColumn("__p", place).withColumn("batch", F.floor((F.col("__p") - 1) / size))
    each = F.array_sort(F.collect_list(F.struct("__p", F.struct(*[c for c in items.columns if c != "run_id"]).alias("v"))))
    return rows.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.transform(each, lambda r: r["v"])).alias("payload"))


def parse_verdicts(answers: DataFrame, known: DataFrame, allowed) -> DataFrame:
    """(key, verdict, importance) of answers (json); rows that do not parse, name unknown keys or verdicts are dropped."""
    v = answers.select(F.from_json("json", "key bigint, verdict string, importance int").alias("v")).select("v.*")
    fine = v.where(F.col("key").isNotNull() & F.col("verdict").isin(*allowed) & (F.col("importance").isNull() | F.col("importance").between(0, 100)))
    return fine.join(known, "key", "left_semi")


def fill_gaps(keys: DataFrame, verdicts: DataFrame, fallback: Column) -> DataFrame:
    """Every key with its verdict, or the fallback, and which of the two it is."""
    j = keys.join(verdicts, "key", "left")
    return j.select("key", F.coalesce("verdict", fallback).alias("verdict"), F.when(F.col("verdict").isNull(), "fallback").otherwise("model").alias("status"))


def budget_admission(requests: DataFrame, cap: float, reserve: float) -> DataFrame:
    """(run_id, seq, admitted): requests in order, each admitted if it still fits; refused ones use nothing up."""

    def run(frame):
        spent, out = 0.0, []
        for r in frame.sort_values("seq").itertuples():
            ok = spent + r.cost <= cap - reserve
            spent += r.cost if ok else 0.0
            out.append(ok)
        return frame.sort_values("seq").assign(admitted=out)[["run_id", "seq", "admitted"]]

    return requests.select("run_id", "seq", "cost").groupBy("run_id").applyInPandas(run, "run_id bigint, seq bigint, admitted boolean")


def delivery_state(deliveries: DataFrame, required: DataFrame) -> DataFrame:
    """(edition, state, covered) of deliveries (edition, recipient, state): the state of most weight, and whether every
    recipient that the edition requires (edition, recipient) has accepted it."""
    weight = F.array_position(F.array(*[F.lit(s) for s in ("prepared", "failed", "sending", "indeterminate", "smtp_accepted")]), F.col("state"))
    states = deliveries.groupBy("edition").agg(F.max_by("state", weight).alias("state"))
    accepted = deliveries.where("state = 'smtp_accepted'").select("edition", "recipient").distinct()
    lacking = required.select("edition", "recipient").distinct().join(accepted, ["edition", "recipient"], "left_anti").select("edition", F.lit(True).alias("__lacks")).distinct()
    return states.join(lacking, "edition", "left").select("edition", "state", F.col("__lacks").isNull().alias("covered"))


def stage_costs(calls: DataFrame) -> DataFrame:
    """(stage, requested, successful, fallbacks, reasons, cost) of calls (stage, ok, reason, cost): ``reasons`` maps each
    reason of a fallback to how often it came up."""
    each = calls.groupBy("stage", F.when(~F.col("ok"), F.col("reason")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.sum("cost").alias("cost")
    )
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", F.col("n") - F.col("ok"))))))
    n, ok = F.sum("n"), F.sum("ok")
    return each.groupBy("stage").agg(n.alias("requested"), ok.alias("successful"), (n - ok).alias("fallbacks"), reasons.alias("reasons"), F.sum("cost").alias("cost"))


def token_difference(pairs: DataFrame) -> DataFrame:
    """(id, lost, added) of pairs (id, before, after) of token arrays, as multisets: tokens are counted on both sides."""
    side = lambda c, n: pairs.select("id", F.explode(c).alias("t")).groupBy("id", "t").agg(F.count(F.lit(1)).alias(n))
    j = side("before", "b").join(side("after", "a"), ["id", "t"], "full")
    gap = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    d = j.groupBy("id").agg(F.sum(F.greatest(gap, F.lit(0))).alias("lost"), F.sum(F.greatest(-gap, F.lit(0))).alias("added"))
    return pairs.select("id").join(d, "id", "left").select("id", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("added", F.lit(0)).alias("added"))


def fidelity_guard(pairs: DataFrame, entities: bool = True) -> DataFrame:
    """Whether rewrites keep the facts: (id, missing, added, missing_anchors, added_anchors, dropped_entities, passed) of
    pairs (id, before, after). Figures, dates and anchors are compared as multisets, capitalised words as sets. Rows are told
    by a digest of their texts, so that null and repeated ids are judged each for itself; equal pairs are counted together."""
    digest = F.unhex(F.md5(F.concat(F.md5(F.coalesce("before", F.lit(""))), F.md5(F.coalesce("after", F.lit(""))))))
    pairs = pairs.withColumn("__key", digest)

    def counted(side: str, sign: int) -> DataFrame:
        tokens = F.concat(F.transform(figures(F.col(side)), lambda t: F.struct(F.lit("f").alias("kind"), t.alias("token"))), F.transform(anchors(F.col(side)), lambda t: F.struct(F.lit("a").alias("kind"), t.alias("token"))))
        return pairs.select("__key", F.inline(tokens)).select("__key", "kind", "token", F.lit(sign).alias("n"))

    gap = counted("before", 1).union(counted("after", -1)).groupBy("__key", "kind", "token").agg(F.sum("n").alias("n"))

    def over(kind: str, sign: int):
        return F.sum(F.when((F.col("kind") == kind) & (sign * F.col("n") > 0), sign * F.col("n")).otherwise(0))

    d = gap.groupBy("__key").agg(over("f", 1).alias("missing"), over("f", -1).alias("added"), over("a", 1).alias("missing_anchors"), over("a", -1).alias("added_anchors"))
    names = ("missing", "added", "missing_anchors", "added_anchors")
    copies = pairs.groupBy("__key").agg(F.count(F.lit(1)).alias("__copies"))
    d = d.join(copies, "__key").select("__key", *[(F.col(n) / F.col("__copies")).cast("long").alias(n) for n in names])
    dropped = pairs.select("id", "__key", F.size(F.array_except(capitalized(F.col("before")), capitalized(F.col("after")))).cast("long").alias("dropped_entities"))
    out = dropped.join(d, "__key", "left").select("id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "dropped_entities")
    kept = (F.col("missing") + F.col("added") + F.col("missing_anchors") + F.col("added_anchors") == 0) & (F.lit(not entities) | (F.col("dropped_entities") == 0))
    return out.withColumn("passed", kept)


def guard_result(status: Column, has_deltas: Column) -> Column:
    """The audit's label of a rewritten paragraph, from its status and whether the guard found differences."""
    return F.when(status == "kept_original_guard_failed", "failed").when(has_deltas, "warning").when(status == "compressed", "passed").otherwise("not_run")


def rewrite_disposition(before: Column, after: Column, lost: Column) -> Column:
    """What became of a rewritten paragraph, from its word counts and lost facts; the first that applies."""
    return (
        F.when(before < 40, "skipped_short").when(after.isNull(), "fallback").when((lost > 0) | (after < 20), "guard_failed").when(after >= before, "no_gain").otherwise("compressed")
    )


def progress_notice(metrics: DataFrame, days: Column, least: int = 20) -> DataFrame:
    """Adds ``notice``: on every seventh day of an evaluation what each of the counted reviews still lacks, otherwise
    empty; also empty once nothing is lacking. ``days`` counts the evaluation's days."""
    counted = (("non-filing events", "independent_non_filing_events"), ("relationship claims", "relationship_claims"), ("rendered stories", "rendered_stories_reviewed"))
    lacks = F.array_compact(F.array(*[F.when(F.col(c) < least, F.concat((least - F.col(c)).cast("string"), F.lit(f" {name}"))) for name, c in counted]))
    return metrics.withColumn("notice", F.when((days > 0) & (days % 7 == 0), F.array_join(lacks, ", ")).otherwise(""))
