"""Sentences, figures, anchors and tickers with known outcomes."""

from pyspark.sql import functions as F

from storyloom.functions import facts as X
from storyloom.operators import quality as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    text = "Ms. Lee of Acme Inc. spoke to Robert F. Kennedy. The U.S. agreed! Was it 5 p.m. then? It was.  Done"
    assert one(spark, X.split_sentences(F.lit(text))) == ["Ms. Lee of Acme Inc. spoke to Robert F. Kennedy.", "The U.S. agreed!", "Was it 5 p.m. then?", "It was.", "Done"]
    assert one(spark, X.split_sentences(F.lit(None).cast("string"))) == []


def test_summary(spark):
    long = " ".join(f"Sentence number {i} says something." for i in range(40))
    got = one(spark, X.extractive_summary(F.lit("A title"), F.lit(long)))
    assert got.startswith("A title. Sentence number 0") and len(got) <= 420 and got.endswith("something.")
    assert one(spark, X.extractive_summary(F.lit("A title"), F.lit(" "))) == "A title"
    assert len(one(spark, X.extractive_summary(F.lit("x"), F.lit("x" * 1000)))) == 420


def test_figures_and_anchors(spark):
    got = one(spark, X.figures(F.lit("Up $1,200.50 million or -3% on Monday, 25 basis points")))
    assert sorted(got) == ["date:monday", "num:-3:%", "num:25:basis_points", "usd:1200.5:million"]
    got = one(spark, X.anchors(F.lit("It may not rise due  to rates, he said")))
    assert sorted(got) == ["attribution:said", "causal:due to", "modality:may", "negation:not"]


def test_tickers_and_events(spark):
    assert sorted(one(spark, X.headline_tickers(F.lit("$ABC and (BRK.B) lead; CEO of Tesla (US) says XYZ shares fell")))) == ["ABC", "BRK-B", "TSLA", "XYZ"]
    event = lambda items, text, d="": one(spark, X.filing_event(F.lit("8-K"), F.array(*map(F.lit, items)), F.lit(text), F.lit(d)))
    assert event(["2.02"], "x") == "financial_results" and event(["8.01"], "Q3 2024 outlook") == "financial_results_outlook"
    assert event(["8.01"], "a merger") == "acquisition_or_merger" and event(["8.01"], "", "Plant: fire.") == "plant_fire" and event(["8.01"], "", "Form 8-K") == "company_update"


def of(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_figures_beyond_ascii(spark):
    got = lambda t: sorted(of(spark, X.figures(F.col("t")), t=t))
    assert got("€1.50 billion or £2,000 or −3 percentage points") == ["eur:1.5:billion", "gbp:2000", "num:-3:percentage_points"]
    assert got("−€5 million, + $ 7, 6 % and 2 dollars") == ["eur:-5:million", "num:6:%", "usd:+7", "usd:2"]
    assert got("12 percent, 25 basis points; 1,5") == ["num:1", "num:12:%", "num:25:basis_points", "num:5"]


def test_capital_words_with_accents(spark):
    got = lambda t: sorted(of(spark, X.capitalized(F.col("t")), t=t))
    assert got("In Zürich met José O’Neil, Müller-Lüdenscheidt. iPhone X9, Über and The Co.") == ["Co", "José", "Müller-Lüdenscheidt", "O’Neil", "Zürich"]


def test_filing_headlines(spark):
    def headline(text, form="8-K", items=("8.01",), description="8-K", issuer="Novo Nordisk A/S"):
        return of(spark, X.filing_headline(F.col("form"), F.col("items"), F.col("text"), F.col("description"), F.col("issuer")), form=form, items=list(items), text=text, description=description, issuer=issuer)

    said = "Q2 2026 financial results: outlook raised. Adjusted sales growth increased by 9% and adjusted operating profit rose by 10.5 %"
    assert headline(said) == "Novo Nordisk raised its 2026 sales and profit outlook after adjusted Q2 sales rose 9% and adjusted profit rose 10.5%."
    assert headline("Earnings and guidance cut for 2025") == "Novo Nordisk lowered its 2025 sales and profit outlook after reporting quarterly results."
    assert headline("Q3 2025 earnings") == "Novo Nordisk reported Q3 2025 financial results."
    assert headline("x", items=("2.02",), issuer="Apple Inc.") == "Apple reported financial results."
    assert headline(" ", form="10-K/A", issuer="Apple Inc") == "Apple filed its annual financial report."
    assert headline("", form="10-Q") == "Novo Nordisk filed its quarterly financial report."
    assert headline("a share buyback") == "Novo Nordisk updated its share buyback program."
    assert headline("", description="Dividend.") == "Novo Nordisk: Dividend."
    assert headline("", description="Form 6-K") == "Novo Nordisk filed an important company update."


def test_fidelity_of_null_and_repeated_ids(spark):
    from storyloom.operators import review

    rows = [(1, "He might pay 5", ""), (1, "He might pay 5", ""), (1, "no 7 and 8", "no 7"), (None, "no 3", ""), (2, None, None)]
    got = review.fidelity_guard(spark.createDataFrame(rows, "id long, before string, after string"))
    want = [(1, 1, 1), (1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 0, 0)]
    assert sorted(map(str, [(x.id, x.missing, x.missing_anchors) for x in got.collect()])) == sorted(map(str, want))


def test_fidelity_agrees_with_sql_on_odd_texts(spark, tmp_path):
    """Digits beside words and names, spaces, letters and marks that regex dialects take differently, and ids below 0 or null."""
    from oracle import TABLES, difference
    from storyloom.plans import review_queries as RQ

    texts = ["due 5 to rain", "can3", "50may", "may3,456june", "AB-CD5 of Apache-2.0", "due\vto \u00a0said", "K² Co\u20dd", "e\u0301AB", "ⒶCo. \u203fThe", "\U0001d400Co. A.B", "İq1 5", "", None, "He paid 5 dollars"]
    rows = [(4 * k + n, t) for k, t in enumerate(texts) for n in range(4)] + [(-k, t) for k, t in enumerate(texts[:9], 1)] + [(None, t) for t in texts[:9]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for t in set(TABLES) - {"documents"}:
        spark.range(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert difference(RQ.QUERIES["fidelity_guard"](spark, str(tmp_path)), RQ.ORACLES["fidelity_guard"], str(tmp_path)) is None


def test_headline_is_read_once(spark):
    plan = spark.range(1).select(X.headline_tickers(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"[^\p{L}\p{N}\x00-\x7F]") == 1 and "RLIKE" not in plan


def test_words_of_a_text_are_taken_once(spark):
    t = F.col("id").cast("string")
    for score in (Q.hard_reject_reason(F.lit("a title"), t), Q.evidence_score(F.lit("a title"), t, F.lit("extracted"), F.lit(0.5), F.lit(0.0))):
        plan = spark.range(1).select(score.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("([a-z0-9]{3,})") == 2
