"""Ranking, reserves and quota selection within an edition."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


class _Taken:
    """What an edition has chosen so far, in order, and how many of each category; ranked items have (id, tags)."""

    def __init__(self, rows, categories):
        self.ids: list[int] = []
        self.seen: set[int] = set()
        self.count = dict.fromkeys(categories, 0)
        self.queues = {c: iter([r for r in rows if c in r.tags]) for c in categories}

    def take(self, r) -> None:
        self.ids.append(r.id)
        self.seen.add(r.id)
        for t in r.tags:
            self.count[t] = self.count.get(t, 0) + 1

    def turn(self, reserve: int, cap: int) -> bool:
        """A turn of all categories below their reserve; whether any had an item left."""
        moved = False
        for c, queue in self.queues.items():
            if self.count[c] >= reserve or len(self.ids) >= cap:
                continue
            one = next((r for r in queue if r.id not in self.seen), None)
            if one is not None:
                self.take(one)
                moved = True
        return moved


def reserve_select(items: DataFrame, categories, reserve: int, cap: int) -> DataFrame:
    """(run_id, id) chosen of items (run_id, id, rank, tags): categories take turns for their best item left, up to their
    reserve; an item with two tags counts for both; the rest goes by rank. Sequential, an edition at a time."""

    def run(frame):
        import pandas as pd

        rows = list(frame.sort_values(["rank", "id"]).itertuples())
        state = _Taken(rows, categories)
        while len(state.ids) < cap and state.turn(reserve, cap):
            pass
        for r in rows:
            if len(state.ids) < cap and r.id not in state.seen:
                state.take(r)
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "id": state.ids})

    return items.select("run_id", "id", "rank", "tags").groupBy("run_id").applyInPandas(run, "run_id bigint, id bigint")


def global_first(items: DataFrame, categories, first: int, reserve: int, cap: int) -> DataFrame:
    """(run_id, id) chosen of items (run_id, id, rank, tags): the best ``first`` of the edition, then categories below their
    reserve take turns for their best item left, up to the cap. Sequential, an edition at a time."""

    def run(frame):
        import pandas as pd

        rows = list(frame.sort_values(["rank", "id"]).itertuples())
        state = _Taken(rows, categories)
        for r in rows[: min(first, cap)]:
            state.take(r)
        while len(state.ids) < cap and state.turn(reserve, cap):
            pass
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "id": state.ids})

    return items.select("run_id", "id", "rank", "tags").groupBy("run_id").applyInPandas(run, "run_id bigint, id bigint")


def reserve_select_single(items: DataFrame, reserve: int, cap: int) -> DataFrame:
    """The same for items (run_id, id, rank, category) with one tag each, as windows."""
    inside = F.row_number().over(Window.partitionBy("run_id", "category").orderBy("rank", "id"))
    first = items.withColumn("r", inside)
    order = Window.partitionBy("run_id").orderBy((F.col("r") > reserve).cast("int"), F.when(F.col("r") <= reserve, F.col("r")).otherwise(0), F.when(F.col("r") <= reserve, F.col("category")).otherwise(""), "rank", "id")
    return first.withColumn("p", F.row_number().over(order)).where(F.col("p") <= cap).select("run_id", "id")


def schedule_articles(members: DataFrame, each: int = 2, cap: int = 50) -> DataFrame:
    """(run_id, article_id, place): the best ``each`` of a story, first ones of all stories before second ones, a url once,
    at most ``cap`` of an edition. Members have (run_id, story_rank, article_id, url, evidence)."""
    inside = F.row_number().over(Window.partitionBy("run_id", "story_rank").orderBy(F.desc("evidence"), "article_id"))
    best = members.withColumn("i", inside).where(F.col("i") <= each)
    once = best.withColumn("u", F.row_number().over(Window.partitionBy("run_id", "url").orderBy("i", "story_rank"))).where("u = 1")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("i", "story_rank"))
    return once.withColumn("place", place).where(F.col("place") <= cap).select("run_id", "article_id", "place")


class Deck:
    """An edition's deck while it is filled. ``lanes`` names the category whose stories spread over lanes instead."""

    def __init__(self, rows, floor, ceiling, big_day_most, target, source_cap, big_day_source_cap, big_day, lanes):
        self.rows, self.floor, self.ceiling, self.big_day_most, self.target = rows, floor, ceiling, big_day_most, target
        self.source_cap, self.big_day_source_cap, self.big_day, self.lanes = source_cap, big_day_source_cap, big_day, lanes
        self.phase: dict[int, str] = {}
        self.relaxed: set[int] = set()
        self.size: Counter = Counter()
        self.held: Counter = Counter()
        self.lane: Counter = Counter()

    def fits(self, r, source_cap: int, lane_cap: int) -> bool:
        if r.category == self.lanes:
            return self.held[r.category, r.source] < self.source_cap and self.lane[r.lane] < lane_cap
        return self.held[r.category, r.source] < source_cap

    def take(self, r, phase: str, relaxed: bool = False) -> None:
        self.phase[r.id] = phase
        self.size[r.category] += 1
        self.held[r.category, r.source] += 1
        self.lane[r.lane] += r.category == self.lanes
        if relaxed:
            self.relaxed.add(r.id)

    def open(self, r, most: int) -> bool:
        return r.id not in self.phase and self.size[r.category] < most

    def fill(self) -> Deck:
        for c in sorted({r.category for r in self.rows}):
            own = [r for r in self.rows if r.category == c]
            for lane_cap in (1, 2) if c == self.lanes else (1,):
                for r in own:
                    if self.open(r, self.floor) and self.fits(r, self.source_cap, lane_cap):
                        self.take(r, "floor")
            for r in own if c != self.lanes else ():
                if self.open(r, self.floor):
                    self.take(r, "floor", relaxed=True)
        later = []
        for r in self.rows:
            if len(self.phase) < self.target and self.open(r, self.ceiling):
                if self.fits(r, self.source_cap, 2):
                    self.take(r, "remainder")
                elif r.category != self.lanes:
                    later.append(r)
        for r in later:
            if len(self.phase) < self.target and self.open(r, self.ceiling):
                self.take(r, "remainder", relaxed=True)
        for r in self.rows:
            sure = r.measured >= self.big_day or r.sources >= 2
            if len(self.phase) < self.target and self.open(r, self.big_day_most) and r.importance >= self.big_day and sure and self.fits(r, self.big_day_source_cap, 3):
                self.take(r, "big_day")
        return self

    def reason(self, r) -> str:
        """Why a story is not in the deck, in the order of the rules."""
        if r.id in self.phase:
            return ""
        if self.size[r.category] >= self.ceiling:
            return "selection_category_ceiling"
        if self.held[r.category, r.source] >= self.source_cap:
            return "selection_source_cap"
        if r.category == self.lanes and self.lane[r.lane] >= 2:
            return "selection_culture_lane_cap"
        return "selection_deck_capacity" if len(self.phase) >= self.target else "selection_below_threshold"


def select_deck(
    stories: DataFrame, floor: int = 2, ceiling: int = 5, big_day_most: int = 6, target: int = 25, source_cap: int = 2, big_day_source_cap: int = 3, big_day: float = 70.0, lanes: str = "culture"
) -> DataFrame:
    """(run_id, id, phase, relaxed, reason) of every story (run_id, id, category, lane, source, sources, importance,
    measured, total, latest): ``phase`` is empty for stories out of the deck, ``reason`` for those in it.

    Each category first gets its floor, no source more than its cap there unless the floor stays short; then the best of
    the rest up to target and ceiling, those over a source's cap only where the deck would stay short; then, on a big day,
    stories of great importance, which their measured importance or a second source must bear out. Sequential, an edition
    at a time.
    """

    def run(frame):
        import pandas as pd

        rows = list(frame.sort_values(["importance", "total", "latest", "id"], ascending=[False, False, False, True]).itertuples())
        deck = Deck(rows, floor, ceiling, big_day_most, target, source_cap, big_day_source_cap, big_day, lanes).fill()
        out = [(r.run_id, r.id, deck.phase.get(r.id, ""), r.id in deck.relaxed, deck.reason(r)) for r in rows]
        return pd.DataFrame(out, columns=["run_id", "id", "phase", "relaxed", "reason"])

    cols = ("run_id", "id", "category", "lane", "source", "sources", "importance", "measured", "total", "latest")
    return stories.select(*cols).groupBy("run_id").applyInPandas(run, "run_id bigint, id bigint, phase string, relaxed boolean, reason string")


def select_floor(stories: DataFrame, floor: int = 2) -> DataFrame:
    """The best ``floor`` stories of each category of an edition."""
    order = Window.partitionBy("run_id", "category").orderBy(F.desc("importance"), F.desc("total"), F.desc("latest"), "id")
    return stories.withColumn("place", F.row_number().over(order)).where(F.col("place") <= floor)


def select_lanes(stories: DataFrame, k: int = 4, caps=(1, 2, 3)) -> DataFrame:
    """(run_id, id) of the best ``k`` stories (run_id, id, lane, importance), no lane above a cap that widens while the
    selection is short. Sequential, an edition at a time."""

    def run(frame):
        import pandas as pd

        chosen: dict[int, None] = {}
        used: dict[str, int] = {}
        rows = list(frame.sort_values(["importance", "id"], ascending=[False, True]).itertuples())
        for cap in caps:
            for r in rows:
                if len(chosen) < k and r.id not in chosen and used.get(r.lane, 0) < cap:
                    chosen[r.id] = None
                    used[r.lane] = used.get(r.lane, 0) + 1
        return pd.DataFrame({"run_id": frame["run_id"].iloc[0], "id": list(chosen)})

    return stories.select("run_id", "id", "lane", "importance").groupBy("run_id").applyInPandas(run, "run_id bigint, id bigint")


def backfill(stories: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` of each short category, each story once: (run_id, id) of (run_id, id, category, importance)."""
    order = Window.partitionBy("run_id", "category").orderBy(F.desc("importance"), "id")
    return stories.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("run_id", "id").distinct()


def diverse_order(members: DataFrame, by: str) -> DataFrame:
    """Adds ``place``: the best article of each source first, then the others, both by evidence."""
    inside = F.row_number().over(Window.partitionBy(by, "source").orderBy(F.desc("evidence"), "article_id"))
    order = Window.partitionBy(by).orderBy((F.col("__r") > 1).cast("int"), F.desc("evidence"), "article_id")
    return members.withColumn("__r", inside).withColumn("place", F.row_number().over(order)).drop("__r")


def draft_candidates(members: DataFrame, outliers: DataFrame, by: str) -> DataFrame:
    """Articles without the outlier urls, unless a story would lose all it has."""
    marked = members.join(outliers.select("url").distinct().withColumn("out", F.lit(1)), "url", "left")
    left = F.count_if(F.col("out").isNull()).over(Window.partitionBy(by))
    return marked.withColumn("__left", left).where(F.col("out").isNull() | (F.col("__left") == 0)).drop("out", "__left")


def review_sample(items: DataFrame, strata: Column, seed: str, urgent=("near_miss", "mid")) -> DataFrame:
    """A fifth of each stratum's target, by the hash of seed and id: the same whatever the partitions. The target is 25 for
    strata with 15 % of the items and for the urgent ones, 10 for others."""
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), "id")
    named = items.withColumn("stratum", strata)
    sizes = named.groupBy("stratum").agg(F.count(F.lit(1)).alias("__n"))
    whole = sizes.withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    each = whole.select("stratum", F.when((F.col("__n") >= 0.15 * F.col("__all")) | F.col("stratum").isin(*urgent), 5).otherwise(2).alias("__each"))
    return named.withColumn("__place", F.row_number().over(order)).join(each, "stratum").where(F.col("__place") <= F.col("__each")).drop("__place", "__each")


def fit_sections(lines: DataFrame, limit: int) -> DataFrame:
    """The longest prefix of each section's lines (section, pos, line) whose joined length fits."""
    run = F.sum(F.length("line") + 1).over(Window.partitionBy("section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", run).where(F.col("used") - 1 <= limit).drop("used")


def fit_messages(sections: DataFrame, paragraphs: DataFrame, limit: int, most: int | None = None) -> DataFrame:
    """(section, text, shown, omitted, with_sources) of each section (section, header): the message of its paragraphs
    (section, pos, text, sources, merged) that has ``limit`` characters at most.

    All paragraphs, or the first ``most``, are tried with their lines of sources; then without them, but for merged stories,
    which keep theirs; then one paragraph less from the end at a time, and a line says how many are missing. No paragraph is
    cut. Where not even the header and that line fit, the header is shortened. Every length follows from running sums.
    """
    order = Window.partitionBy("section").orderBy("pos")
    upto = Window.partitionBy("section").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    source = F.when(T.nonnull(F.col("sources")) != "", F.concat(F.lit("\n(via "), "sources", F.lit(")"))).otherwise("")
    p = paragraphs.select("section", F.row_number().over(order).alias("n"), F.concat(F.lit("\n\n"), "text", source).alias("rich"), F.concat(F.lit("\n\n"), "text", F.when(F.col("merged"), source).otherwise("")).alias("bare"))
    p = p.withColumn("rich_used", F.sum(F.length("rich")).over(upto)).withColumn("bare_used", F.sum(F.length("bare")).over(upto))
    whole = sections.join(p.groupBy("section").agg(F.max("n").alias("n")), "section", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.col("n") if most is None else F.least("n", F.lit(most))
    missing = lambda shown: F.when(F.col("all") > shown, F.concat(F.lit("\n\n+ "), (F.col("all") - shown).cast("string"), F.lit(" more stories omitted for length."))).otherwise("")
    whole = whole.select("section", "header", F.col("n").alias("all"), first.alias("most"))
    none = whole.select("section", "header", "all", "most", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("rich_used"), F.lit(0).cast("bigint").alias("bare_used"))
    tried = whole.join(p.select("section", "n", "rich_used", "bare_used"), "section").where("n <= most").select(*none.columns).unionByName(none)
    room = limit - F.length("header") - F.length(missing(F.col("n")))
    # of what fits: all with sources first, then the most paragraphs without
    rank = F.when((F.col("n") == F.col("most")) & (F.col("rich_used") <= room), F.col("all") + 1).when(F.col("bare_used") <= room, F.col("n"))
    best = tried.withColumn("rank", rank).groupBy("section", "header", "all").agg(F.max("rank").alias("rank"), F.max("most").alias("most"))
    best = best.withColumn("with_sources", F.coalesce(F.col("rank") > F.col("all"), F.lit(False))).withColumn("shown", F.when(F.col("with_sources"), F.col("most")).otherwise(F.coalesce("rank", F.lit(0))).cast("int"))
    used = p.join(best.select("section", "shown", "with_sources"), "section").where(F.col("n") <= F.col("shown"))
    each = F.array_sort(F.collect_list(F.struct("n", F.when(F.col("with_sources"), F.col("rich")).otherwise(F.col("bare")).alias("t"))))
    bodies = used.groupBy("section").agg(F.array_join(F.transform(each, lambda x: x["t"]), "").alias("body"))
    suffix = "\n+ More omitted for length."
    cut_header = F.when(F.length("header") <= limit, F.col("header")).otherwise(F.concat(F.rtrim(F.substring("header", 1, max(0, limit - len(suffix)))), F.lit(suffix)))
    text = F.when(F.col("rank").isNull(), cut_header).otherwise(F.concat("header", F.coalesce("body", F.lit("")), missing(F.col("shown"))))
    return best.join(bodies, "section", "left").select("section", text.alias("text"), "shown", (F.col("all") - F.col("shown")).cast("int").alias("omitted"), "with_sources")


def first_per(items: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return items.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def prefer_by_source_type(votes: DataFrame, types: DataFrame, preferences: dict[str, tuple[str, ...]], by: list[str]) -> DataFrame:
    """Vote rows (by, tag, votes) of the tags that may still win: those with the most votes and, where the types of a story's
    sources (by, source_type, a row an article) prefer some of these, the ones that most articles prefer."""
    best = votes.groupBy(*by).agg(F.max("votes").alias("__most"))
    tied = votes.join(best, by).where(F.col("votes") == F.col("__most")).drop("__most")
    pairs = votes.sparkSession.createDataFrame([(t, c) for t, cs in preferences.items() for c in cs], "source_type string, tag string")
    said = types.groupBy(*by, "source_type").agg(F.count(F.lit(1)).alias("__n")).join(F.broadcast(pairs), "source_type").groupBy(*by, "tag").agg(F.sum("__n").alias("__said"))
    joined = tied.join(said, [*by, "tag"], "left").withColumn("__said", F.coalesce("__said", F.lit(0)))
    most = joined.groupBy(*by).agg(F.max("__said").alias("__best"))
    return joined.join(most, by).where(F.col("__said") == F.col("__best")).select(*by, "tag", "votes")


def vote_category_balanced(votes: DataFrame, categories) -> DataFrame:
    """(run_id, id, category) of vote rows (run_id, id, tag, votes): most votes, then the category given least so far in
    the edition, then the list's order. Sequential, an edition at a time; :func:`prefer_by_source_type` goes before."""

    def run(frame):
        import pandas as pd

        given = dict.fromkeys(categories, 0)
        out = []
        for key, rows in frame.sort_values("id").groupby("id", sort=True):
            most = rows["votes"].max()
            tied = set(rows.loc[rows["votes"] == most, "tag"])
            best = min((c for c in categories if c in tied), key=lambda c: (given[c], categories.index(c)), default=None)
            if best is not None:
                given[best] += 1
                out.append((frame["run_id"].iloc[0], key, best))
        return pd.DataFrame(out, columns=["run_id", "id", "category"])

    return votes.select("run_id", "id", "tag", "votes").groupBy("run_id").applyInPandas(run, "run_id bigint, id bigint, category string")
