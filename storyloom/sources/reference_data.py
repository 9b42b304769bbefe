"""Reference data in files: watchlists, entity maps, benchmark items and feeds, as JSON, JSON lines, TOML or simple YAML.

Spark lists and reads the files, each by one task; what a file holds comes out as one row an item, and what cannot be read as a
row with its line and reason. Checks of the items are expressions over these rows, so that a bad item is told beside the good
ones and stops nothing.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonnull
from ..operators.articles import bounded

# Relations of names to an issuer, and what an entity map must hold.
RELATIONS = ("self", "controlled_affiliate", "managed_capital", "underlying_asset", "family_ambiguous", "unrelated")
FILING_TEXTS = ("legal_regime", "subsidiary_exhibit", "omission_allowance")
# End of fixed values.

ITEMS = "path string, pos int, line int, body string, reason string"
Row = tuple[int, int | None, str | None, str | None]


def _json(text: str) -> Iterator[Row]:
    try:
        read = json.loads(text)
    except json.JSONDecodeError as e:
        yield 0, e.lineno, None, f"json: {e.msg}"
        return
    items = read.get("items", [read]) if isinstance(read, dict) else read
    for pos, item in enumerate(items if isinstance(items, list) else [items]):
        yield pos, None, json.dumps(item, ensure_ascii=False), None


def _lines(text: str) -> Iterator[Row]:
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            try:
                yield n - 1, n, json.dumps(json.loads(line), ensure_ascii=False), None
            except json.JSONDecodeError as e:
                yield n - 1, n, None, f"json: {e.msg}"


def _toml(text: str) -> Iterator[Row]:
    try:
        read = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        at = re.search(r"at line (\d+)", str(e))
        yield 0, int(at[1]) if at else None, None, "toml: " + str(e).split(" (at")[0]
        return
    tables = [x for v in read.values() if isinstance(v, list) for x in v if isinstance(x, dict)]
    for pos, item in enumerate(tables or [read]):
        yield pos, None, json.dumps(item, default=str, ensure_ascii=False), None


def _yaml(text: str) -> Iterator[Row]:
    """Entries ``- name: x`` or ``- x`` with lines ``key: value``, and lists of ``- x`` below a key without a value."""
    entries: list[tuple[int, dict]] = []
    key = None
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        bare = lambda x: x.strip().strip("\"'")
        if not line or line.startswith("#"):
            continue
        named = re.match(r"-\s+(name|label):(.*)", line)
        if named or line.startswith("- ") and raw[0] == "-" and key is None:
            entries.append((n, {"label": bare(named[2] if named else line[2:])}))
            key = None
        elif line.startswith("- ") and entries and key:
            entries[-1][1].setdefault(key, []).append(bare(line[2:]))
        elif ":" in line and entries:
            name, value = line.split(":", 1)
            key = name.strip() if not value.strip() else None
            if key is None:
                entries[-1][1][name.strip()] = bare(value)
        else:
            yield n - 1, n, None, "yaml: not an entry"
    for pos, (n, entry) in enumerate(entries):
        yield pos, n, json.dumps(entry, ensure_ascii=False), None


READERS = {"json": _json, "jsonl": _lines, "toml": _toml, "yaml": _yaml, "yml": _yaml}


def read_items(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, pos, line, body, reason) of all files below ``root``: an item's JSON, or why there is none. The format is that
    of a folder ``format=x`` on the way to the file, or else of the file's ending; other files are one row each."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(root).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                told = re.search(r"/format=(\w+)/", path) or re.search(r"\.(\w+)$", path)
                reader = READERS.get(told[1] if told else "")
                try:
                    rows = reader(content.decode()) if reader else [(0, None, None, "unknown format")]
                    out += [(path, *row) for row in rows]
                except UnicodeDecodeError as e:
                    out.append((path, 0, content[: e.start].count(b"\n") + 1, None, "not UTF-8"))
            yield pd.DataFrame(out, columns=["path", "pos", "line", "body", "reason"])

    return files.mapInPandas(run, ITEMS)


def _told(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds."""
    reason = F.lit(None).cast("string")
    for wrong, what in reversed(checks):
        reason = F.when(wrong, what).otherwise(reason)
    return reason


def _text(c: Column) -> Column:
    return F.trim(nonnull(c))


def watchlist(items: DataFrame) -> DataFrame:
    """(path, pos, line, label, aliases, ticker, weight, reason): an item is a label alone or has one, its aliases, ticker
    and weight, 1 if none is given."""
    x = F.from_json("body", "label string, name string, aliases array<string>, ticker string, weight string")
    alone = F.when(F.startswith("body", F.lit('"')), F.get_json_object(F.concat(F.lit('{"x":'), "body", F.lit("}")), "$.x"))
    label = F.coalesce(F.nullif(_text(x["label"]), F.lit("")), F.nullif(_text(x["name"]), F.lit("")), F.nullif(_text(alone), F.lit("")))
    aliases = F.filter(F.transform(F.coalesce(x["aliases"], F.array().cast("array<string>")), _text), lambda a: a != "")
    weight = F.coalesce(x["weight"].try_cast("double"), F.when(x["weight"].isNull(), 1.0))
    read = items.select("path", "pos", "line", label.alias("label"), aliases.alias("aliases"), F.upper(_text(x["ticker"])).alias("ticker"), weight.alias("weight"), "reason")
    return read.withColumn("reason", F.coalesce("reason", _told((F.col("label").isNull(), "no label"), (F.col("weight").isNull(), "weight is no number"))))


def benchmark(items: DataFrame, tickers: DataFrame) -> DataFrame:
    """(path, pos, line, ticker, day, url, headline, rationale, provenance, reason) of events; tickers (ticker) are those that
    may be named. Good events that a file, or another one, holds twice are refused each time."""
    x = F.from_json("body", "ticker string, event_date string, source_url string, headline string, materiality_rationale string, provenance string")
    names = {"headline": "headline", "materiality_rationale": "rationale", "provenance": "provenance"}
    read = items.select("path", "pos", "line", F.upper(_text(x["ticker"])).alias("ticker"), F.try_to_date(x["event_date"], "yyyy-MM-dd").alias("day"), _text(x["source_url"]).alias("url"), *[_text(x[k]).alias(v) for k, v in names.items()], "reason")
    known = bounded(tickers.select(F.col("ticker"), F.lit(True).alias("__known")).distinct())
    empty = (F.col("headline") == "") | (F.col("rationale") == "") | (F.col("provenance") == "")
    checks = ((F.col("__known").isNull(), "ticker"), (~F.rlike("url", F.lit("^https://[^/]")), "url"), (empty, "text"), (F.col("day").isNull(), "day"))
    told = read.join(known, "ticker", "left").withColumn("reason", F.coalesce("reason", _told(*checks)))
    twice = told.where("reason IS NULL").groupBy("ticker", "day", "url").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    joined = told.join(twice, ["ticker", "day", "url"], "left")
    return joined.withColumn("reason", F.coalesce("reason", F.when(F.col("__n").isNotNull(), "repeated"))).select(*read.columns)


def feeds(items: DataFrame) -> DataFrame:
    """(path, pos, line, name, url, reputation, categories, region, lane, reason) of feeds; reputation is from 0 to 1, 0.7 if
    none is given."""
    x = F.from_json("body", "name string, url string, reputation string, categories array<string>, region string, culture_lane string")
    reputation = F.coalesce(x["reputation"].try_cast("double"), F.when(x["reputation"].isNull(), 0.7))
    read = items.select("path", "pos", "line", _text(x["name"]).alias("name"), _text(x["url"]).alias("url"), reputation.alias("reputation"), F.coalesce(x["categories"], F.array().cast("array<string>")).alias("categories"), _text(x["region"]).alias("region"), _text(x["culture_lane"]).alias("lane"), "reason")
    checks = ((F.col("name") == "", "name"), (~F.rlike("url", F.lit("^https?://[^/]")), "url"), (~F.coalesce(F.col("reputation").between(0, 1), F.lit(False)), "reputation"))
    return read.withColumn("reason", F.coalesce("reason", _told(*checks)))


_NAME = "struct<name string, relationship string, source string, verified_at string, expires_at string, min_tokens int, requires_context array<string>, verified_against_accession string>"
_FILING = "struct<legal_regime string, required_edgar boolean, observed_forms array<string>, subsidiary_exhibit string, omission_allowance string, evidence_url string, verified_at string>"
ENTITY_MAP = f"schema_version int, generated_at string, tickers map<string, struct<legal_issuer string, cik string, filing {_FILING}, names array<{_NAME}>, negative_names array<string>, discovery_keys array<string>>>"


def entity_map(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, negatives, rejected) of entity maps, one a file.

    Names are (ticker, name, seq, relationship, source, verified_at, expires_at, min_tokens, context, accession), as mentions
    are classified by; negatives (ticker, name). Rejected are (path, line, ticker, reason): a map that is broken, of another
    version or without a zoned time, with all that it holds; a ticker whose own facts or any of whose names are bad."""
    m = items.select("path", "line", "reason", F.from_json("body", ENTITY_MAP).alias("m")).select("path", "line", "reason", "m.*")
    zoned = F.rlike(nonnull(F.col("generated_at")), F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:\d{2})$"))
    checks = ((F.coalesce(F.col("schema_version") != 1, F.lit(True)), "schema version"), (~zoned, "time"), (F.coalesce(F.size("tickers"), F.lit(0)) <= 0, "no tickers"))
    m = m.withColumn("reason", F.coalesce("reason", _told(*checks)))
    t = m.where("reason IS NULL").select("path", "line", F.explode("tickers").alias("ticker", "t")).select("path", "line", "ticker", "t.*")
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    forms = F.filter(F.coalesce("filing.observed_forms", F.array().cast("array<string>")), lambda f: F.trim(f) != "")
    bad_name = lambda n: (
        (_text(n["name"]) == "") | ~F.coalesce(n["relationship"].isin(*RELATIONS), F.lit(False)) | (_text(n["source"]) == "") | day(n["verified_at"]).isNull()
        | (nonnull(n["expires_at"]) != "") & day(n["expires_at"]).isNull()
    )
    facts = (
        (~F.rlike(nonnull(F.col("cik")), F.lit("^[0-9]{10}$")), "cik"), (F.col("filing").isNull(), "filing"), (F.coalesce("filing.required_edgar", F.lit(False)) & (F.size(forms) == 0), "forms"),
        (F.greatest(*[(_text(F.col(f"filing.{c}")) == "").cast("int") for c in FILING_TEXTS]) == 1, "filing text"), (~F.startswith(nonnull(F.col("filing.evidence_url")), F.lit("https://")), "evidence"),
        (day(F.col("filing.verified_at")).isNull(), "filing day"), (_text(F.col("legal_issuer")) == "", "issuer"), (F.coalesce(F.size("names"), F.lit(0)) <= 0, "no names"),
        (F.exists("names", bad_name), "name"), (~F.exists("names", lambda n: n["relationship"] == "self"), "no self name"),
    )
    t = t.withColumn("reason", _told(*facts))
    good = t.where("reason IS NULL")
    n = good.select("ticker", F.posexplode("names").alias("seq", "n"))
    names = n.select(
        "ticker", F.col("n.name").alias("name"), "seq", F.col("n.relationship").alias("relationship"), F.col("n.source").alias("source"), day(F.col("n.verified_at")).alias("verified_at"),
        day(F.nullif(F.col("n.expires_at"), F.lit(""))).alias("expires_at"), F.coalesce("n.min_tokens", F.lit(1)).alias("min_tokens"),
        F.coalesce("n.requires_context", F.array().cast("array<string>")).alias("context"), F.nullif(F.col("n.verified_against_accession"), F.lit("")).alias("accession"),
    )
    negatives = good.select("ticker", F.explode("negative_names").alias("name"))
    rejected = m.where("reason IS NOT NULL").select("path", "line", F.lit(None).cast("string").alias("ticker"), "reason").unionByName(t.where("reason IS NOT NULL").select("path", "line", "ticker", "reason"))
    return names, negatives, rejected
