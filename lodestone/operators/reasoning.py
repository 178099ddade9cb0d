"""What columns and matches tell of a dataset, and of columns that no concept matches: patterns, consensus, signals, definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import case_chain, contains_any, title_case
from lodestone.operators.retrieval import fuse_signals

#: Column names by which patterns of datasets are known.
PRICES = ["open", "high", "low", "close"]
INSURANCE = ["charges", "premium", "bmi", "smoker", "age"]
ORDERS = ["order_id", "customer_id", "product", "quantity", "price"]
TIMES = ["date", "time", "timestamp", "year", "month", "day"]
#: Words of the domains in which meanings of unmatched columns are looked up, in order, and the meanings they have there.
CONTEXTS = {
    "Healthcare": ["patient", "diagnosis", "treatment", "medical", "hospital", "clinic", "doctor", "nurse", "prescription", "symptom", "disease", "health", "bmi", "blood", "heart", "surgery", "insurance", "premium", "charges"],
    "Finance": ["revenue", "profit", "price", "stock", "market", "trading", "investment", "portfolio", "dividend", "yield", "return", "risk", "asset", "liability", "open", "high", "low", "close", "volume", "ticker", "symbol"],
    "E-commerce": ["product", "order", "customer", "purchase", "cart", "checkout", "payment", "shipping", "delivery", "inventory", "sku", "price", "discount", "coupon"],
}
MEANINGS = {
    "Healthcare": {
        "charges": "Medical service fees or insurance premium amounts",
        "premium": "Insurance premium payment amount",
        "copay": "Patient's out-of-pocket payment for medical services",
        "deductible": "Amount patient must pay before insurance coverage begins",
        "bmi": "Body Mass Index - health metric calculated from height and weight",
        "smoker": "Tobacco smoking status indicator (yes/no or frequency)",
        "patient_id": "Unique identifier for a patient record",
    },
    "Finance": {
        "charges": "Financial charges or fees applied to an account",
        "open": "Opening price at the start of a trading period",
        "high": "Highest price reached during a trading period",
        "low": "Lowest price reached during a trading period",
        "close": "Closing price at the end of a trading period",
        "volume": "Total number of shares or contracts traded",
        "ticker": "Stock ticker symbol - unique identifier for a traded security",
        "symbol": "Trading symbol for a financial instrument",
    },
    "E-commerce": {
        "charges": "Total charges for a purchase including taxes and fees",
        "customer_id": "Unique identifier for a customer account",
        "order_id": "Unique identifier for a purchase order",
    },
}
#: Formats of sample values that are signals for a concept.
SAMPLE_FORMATS = [
    ("Email Address", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"),
    ("URL", r"^https?://[\w\.-]+"),
    ("IPv4 Address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("ISO Currency Code", r"^[A-Z]{3}$"),
    ("Date String", r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"),
]
#: Weights of the kinds of signals by problem; other problems have the last ones.
SIGNALS = ["column_name", "sample_values", "stats_pattern", "dataset_context", "kg_match"]
WEIGHTS = {
    "entity_linking": [0.05, 0.45, 0.05, 0.05, 0.4],
    "abbreviation": [0.3, 0.1, 0.1, 0.1, 0.4],
    "domain_anchoring": [0.15, 0.05, 0.1, 0.3, 0.4],
    "default": [0.1, 0.1, 0.1, 0.1, 0.6],
}
SIGNAL = "column_name string, signal string, concept string, score double, confidence double"


def dataset_patterns(columns: DataFrame) -> DataFrame:
    """dataset, pattern of datasets from the names of their columns (dataset, column_name); null where none is known."""
    names = columns.groupBy("dataset").agg(F.collect_list(F.lower(F.trim("column_name"))).alias("names"))
    shared = lambda words: F.size(F.array_intersect(F.array_distinct("names"), F.array(*map(F.lit, words))))
    others = F.size(F.filter("names", lambda n: ~n.isin(TIMES)))
    label = case_chain([
        (shared(PRICES) == len(PRICES), "Financial_OHLC_TimeSeries"), (shared(INSURANCE) >= 3, "Healthcare_Insurance_Underwriting"),
        (shared(ORDERS) >= 3, "E-commerce_Transaction"), ((shared(TIMES) > 0) & (others >= 2), "Generic_TimeSeries"),
    ])
    return names.select("dataset", label.alias("pattern"))


def domain_consensus(matches: DataFrame) -> DataFrame:
    """dataset, domain, votes: the domain that most matches (dataset, ordinal, domain) of a dataset have, the first seen among equals."""
    votes = matches.where("domain is not null and domain <> 'Uncategorized'").groupBy("dataset", "domain").agg(F.count(F.lit(1)).alias("votes"), F.min("ordinal").alias("first"))
    w = Window.partitionBy("dataset").orderBy(F.desc("votes"), "first")
    return votes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("dataset", "domain", "votes")


def dataset_context(columns: DataFrame, matches: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """dataset, status, anchors, domain_consensus, pattern, internal_links, insight for each dataset.

    columns: dataset, column_name; matches: dataset, ordinal, concept_id, domain; edges and concepts of the graph. Datasets with less than
    two matches lack data. Anchors are the three concepts most linked from matched ones, with two links at least.
    """
    ids = matches.select("dataset", "concept_id").distinct()
    names = concepts.select("id", "display_name")
    out_edges = ids.join(edges, ids["concept_id"] == edges["source_concept_id"]).select("dataset", "source_concept_id", "relationship_type", "target_concept_id")
    inside = out_edges.join(ids.select("dataset", F.col("concept_id").alias("target_concept_id")), ["dataset", "target_concept_id"])
    s, t = (names.select(F.col("id").alias(f"{end}_concept_id"), F.col("display_name").alias(end)) for end in ("source", "target"))
    told = F.concat("source", F.lit(" --["), "relationship_type", F.lit("]--> "), "target")
    links = inside.join(s, "source_concept_id").join(t, "target_concept_id").groupBy("dataset").agg(F.array_sort(F.collect_list(told)).alias("internal_links"))
    counted = out_edges.join(t, "target_concept_id").groupBy("dataset", "target_concept_id").agg(F.min("target").alias("name"), F.count(F.lit(1)).alias("strength")).where("strength >= 2")
    w = Window.partitionBy("dataset").orderBy(F.desc("strength"), "name")
    top = counted.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("_n", "name", "strength"))).alias("a"))
    anchors = top.select("dataset", F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["strength"].alias("strength"))).alias("anchors"))
    size = matches.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    out = columns.select("dataset").distinct()
    for part in (size, anchors, domain_consensus(matches).select("dataset", F.col("domain").alias("domain_consensus")), dataset_patterns(columns), links):
        out = out.join(part, "dataset", "left")
    enough = F.coalesce("n", F.lit(0)) >= 2
    about = F.coalesce(
        F.concat(F.lit("Recognized pattern: "), F.col("pattern")), F.concat(F.lit("Centered around '"), F.get("anchors", F.lit(0))["name"], F.lit("'")),
        F.concat(F.lit("Primarily of the domain '"), F.col("domain_consensus"), F.lit("'")),
    )
    return out.select(
        "dataset", F.when(enough, "success").otherwise("insufficient_data").alias("status"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("anchors", "domain_consensus", "pattern", "internal_links")], F.when(enough, about).alias("insight"),
    )


def context_domains(neighbours: DataFrame) -> DataFrame:
    """dataset, domain: the context with the most words in the texts (dataset, text) of matched columns, two at least, else null."""
    whole = neighbours.groupBy("dataset").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("text"))
    counts = [reduce(Column.__add__, [F.contains("text", F.lit(w)).cast("int") for w in words]) for words in CONTEXTS.values()]
    best = F.greatest(*counts)
    return whole.select("dataset", F.when(best >= 2, case_chain([(n == best, d) for n, d in zip(counts, CONTEXTS, strict=True)])).alias("domain"))


def running_domains(columns: DataFrame, texts: DataFrame) -> DataFrame:
    """``columns`` (dataset, place, column_name, ...) with domain: the context of the matched columns before each, in the order of place.

    texts: dataset, column_name, text of matched columns. A window over the rows up to the one before gathers, as bits, the words of each domain that were met so far; the
    domain with the most, two at least, counts, the first of equal ones; null before that. A dataset's columns are one window, so it is bounded by the widest table.
    """
    met = texts.groupBy("dataset", "column_name").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("_text"))
    rows = columns.join(met, ["dataset", "column_name"], "left")
    before = Window.partitionBy("dataset").orderBy("place", "column_name").rowsBetween(Window.unboundedPreceding, -1)
    counts = []
    for words in CONTEXTS.values():
        bits = reduce(Column.bitwiseOR, [F.when(F.contains("_text", F.lit(w)), 1 << i).otherwise(0).cast("long") for i, w in enumerate(words)])
        counts.append(F.coalesce(F.bit_count(F.bit_or(bits).over(before)), F.lit(0)))
    names = [f"_c{i}" for i in range(len(counts))]
    rows = rows.withColumns(dict(zip(names, counts, strict=True)))
    best = F.greatest(*names)
    return rows.withColumn("domain", F.when(best >= 2, case_chain([(F.col(n) == best, d) for n, d in zip(names, CONTEXTS, strict=True)]))).drop("_text", *names)


def with_running_context(matched: DataFrame, columns: DataFrame, texts: DataFrame) -> DataFrame:
    """dataset, place, column_name, concept_id, score, source, domain: matches as they are, and the other columns inferred in order.

    A column (dataset, place, column_name, data_type, samples) without a match is inferred (context_inference) if the matches before it tell a
    domain, and else has no_match; matches that come later don't count.
    """
    placed = running_domains(columns, texts)
    known = matched.where("concept_id is not null").select("dataset", "column_name", "concept_id", "score")
    rest = placed.join(known, ["dataset", "column_name"], "left_anti")
    inferred = inferred_concepts(rest.where("domain is not null")).select("dataset", "column_name", F.col("id").alias("concept_id"), F.col("confidence").alias("score"), F.lit("context_inference").alias("source"))
    found = known.withColumn("source", F.lit("matched")).unionByName(inferred)
    out = placed.select("dataset", "place", "column_name", "domain").join(found, ["dataset", "column_name"], "left")
    return out.select("dataset", "place", "column_name", "concept_id", "score", F.coalesce("source", F.lit("no_match")).alias("source"), "domain")


def inferred_concepts(columns: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """dataset, column_name, id, display_name, definition, domain, confidence for columns (dataset, column_name, data_type, samples) without a match.

    ``domains``: dataset, domain; else the columns have a domain each.
    """
    known = [(d, name, text) for d, texts in MEANINGS.items() for name, text in texts.items()]
    meanings = F.broadcast(columns.sparkSession.createDataFrame(known, "domain string, name string, meaning string"))  # the fixed meanings above
    name = F.lower(F.trim("column_name"))
    c = (columns if domains is None else columns.join(domains, "dataset", "left")).withColumn("name", name).join(meanings, ["domain", "name"], "left")
    readable = title_case(F.trim(F.regexp_replace(F.lower("column_name"), r"[_\s]+", " ")))
    numbers = F.transform("samples", lambda x: x.try_cast("double"))
    whole = (F.size("samples") > 0) & ~F.exists(numbers, lambda x: x.isNull())
    span = F.when(whole & F.col("data_type").isin("integer", "float"), F.format_string(" (typical range: %.2f to %.2f)", F.array_min(numbers), F.array_max(numbers)))
    values = F.when((F.size("samples") > 0) & (F.col("data_type") == "string"), F.concat(F.lit(" (possible values: "), F.array_join(F.array_sort(F.array_distinct(F.slice("samples", 1, 5))), ", "), F.lit(")")))
    generic = F.concat(readable, F.lit(" - a "), F.col("data_type"), F.lit(" field"), F.coalesce(span, values, F.lit("")))
    return c.select(
        "dataset", "column_name", F.concat(F.lit("inferred_"), "name").alias("id"), readable.alias("display_name"), F.coalesce("meaning", generic).alias("definition"),
        F.coalesce("domain", F.lit("General")).alias("domain"), F.when(F.col("meaning").isNotNull(), 0.75).otherwise(0.6).alias("confidence"),
    )


def sample_signals(samples: DataFrame) -> DataFrame:
    """Signals from the formats of sample values (column_name, place, value) of each column."""
    in_first = F.col("place") <= 20
    shares = [F.avg(F.when(in_first, F.col("value").rlike(p).cast("double"))) for _, p in SAMPLE_FORMATS]
    upper = F.bool_and(F.when(F.col("place") <= 10, F.col("value").rlike(r"^\p{Lu}+$")))
    ticker = F.when(F.avg(F.length("value")).between(2, 6) & upper, F.struct(F.lit("Ticker Symbol").alias("concept"), F.lit(0.85).alias("score"), F.lit(0.8).alias("confidence")))
    formats = [F.when(s > 0.7, F.struct(F.lit(name).alias("concept"), F.lit(0.9).alias("score"), F.lit(0.9).alias("confidence"))) for s, (name, _) in zip(shares, SAMPLE_FORMATS, strict=True)]
    found = samples.groupBy("column_name").agg(F.array_compact(F.array(ticker, *formats)).alias("f"))
    return found.select("column_name", F.lit("sample_values").alias("signal"), F.explode("f").alias("s")).select("column_name", "signal", "s.*")


def profile_signals(profiles: DataFrame) -> DataFrame:
    """Signals from the share of distinct values: identifiers (text, above 0.9) and categories (below 0.1)."""
    found = F.when((F.col("unique_ratio") > 0.9) & (F.col("data_type") == "string"), "identifier").when((F.col("unique_ratio") < 0.1) & (F.col("unique_ratio") > 0), "category")
    return profiles.select("column_name", F.lit("stats_pattern").alias("signal"), found.alias("concept"), F.lit(0.7).alias("score"), F.lit(0.7).alias("confidence")).where("concept is not null")


def context_signals(columns: DataFrame, dataset: str) -> DataFrame:
    """Signals from words of the dataset's name."""
    name = F.lower(F.lit(dataset))
    found = F.array_compact(F.array(F.when(contains_any(name, ["financial", "esg"]), "financial metric"), F.when(contains_any(name, ["covid", "hospital"]), "healthcare metric")))
    return columns.select("column_name", F.lit("dataset_context").alias("signal"), F.explode(found).alias("concept"), F.lit(0.6).alias("score"), F.lit(0.6).alias("confidence"))


def weighted(signals: DataFrame, problems: DataFrame, weights: dict[str, list[float]] = WEIGHTS) -> DataFrame:
    """Signals with the weight that their kind has for the problem of their column (column_name, problem); ``weights`` has those of ``default`` too."""
    known = [(p, s, w) for p, ws in weights.items() for s, w in zip(SIGNALS, ws, strict=True)]
    table = F.broadcast(signals.sparkSession.createDataFrame(known, "problem string, signal string, weight double"))  # the fixed weights above
    problem = F.when(F.col("problem").isin([p for p in weights if p != "default"]), F.col("problem")).otherwise("default")
    return signals.join(problems.select("column_name", problem.alias("problem")), "column_name").join(table, ["problem", "signal"])


def match_signals(samples: DataFrame, profiles: DataFrame, kg: DataFrame, problems: DataFrame, dataset: str = "") -> DataFrame:
    """column_name, concept, score, signals, strength of all concepts that any signal names; kg: column_name, concept, score."""
    of_graph = kg.select("column_name", F.lit("kg_match").alias("signal"), "concept", "score", F.lit(0.9).alias("confidence"))
    parts = [sample_signals(samples), profile_signals(profiles), context_signals(profiles.select("column_name"), dataset), of_graph]
    return fuse_signals(weighted(reduce(DataFrame.unionByName, parts), problems))


def with_context(matched: DataFrame, columns: DataFrame, texts: DataFrame) -> DataFrame:
    """Matches (dataset, column_name, concept_id, score), and for columns without one what the context of the matched ones infers.

    ``texts``: dataset, column_name, text (names and definitions) of matched columns.
    """
    rest = columns.join(matched.where("concept_id is not null"), ["dataset", "column_name"], "left_anti")
    inferred = inferred_concepts(rest, context_domains(texts))
    known = matched.where("concept_id is not null").select("dataset", "column_name", "concept_id", "score", F.lit("matched").alias("source"))
    return known.unionByName(inferred.select("dataset", "column_name", F.col("id").alias("concept_id"), F.col("confidence").alias("score"), F.lit("context_inference").alias("source")))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.718), -c))


def rerank(candidates: DataFrame, scorer=None, first: int = 10, second: int = 3, judge=None) -> DataFrame:
    """The candidates (column_name, query, id, text, score) of each column with rerank_score and rank, best first.

    ``scorer`` is a pandas UDF over (query, text); the best ``first`` by it go on, its score put through a sigmoid. ``judge``, another,
    gives the score of the best ``second``. Without a scorer the vector score stands.
    """
    base = candidates.withColumn("_s", scorer(F.col("query"), F.col("text")) if scorer is not None else F.col("score").cast("double"))
    w = Window.partitionBy("column_name").orderBy(F.desc("_s"), "id")
    kept = base.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= (first if scorer is not None else 1 << 30))
    own = sigmoid(F.col("_s")) if scorer is not None else F.col("_s")
    score = F.when(F.col("_n") <= second, judge(F.col("query"), F.col("text"))).otherwise(own) if judge is not None else own
    scored = kept.withColumn("rerank_score", score)
    order = Window.partitionBy("column_name").orderBy(F.desc("rerank_score"), "_n")
    return scored.withColumn("rank", F.row_number().over(order)).drop("_s", "_n")


def listwise_prompts(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """id (column_name), prompt: one question a column about all its candidates (column_name, place, id, display_name, definition, aliases).

    columns: column_name, data_type, samples. The answer asked for is a JSON list of concept_id, match_score and justification, best first.
    """
    listed = F.when(F.size("aliases") > 0, F.concat(F.lit(" (also: "), F.array_join(F.slice("aliases", 1, 5), ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.col("place").cast("string"), F.lit(". ID: `"), F.coalesce("id", F.lit("unknown")), F.lit("` | Name: `"), F.coalesce("display_name", F.lit("")), F.lit("` | Definition: "), F.coalesce("definition", F.lit("N/A")), listed)
    lines = candidates.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    about = F.concat(F.lit("Column: `"), "column_name", F.lit("`\nData type: `"), F.coalesce("data_type", F.lit("unknown")), F.lit("`\nSample values: `"), F.array_join(F.slice("samples", 1, 5), ", "), F.lit("`\n"))
    task = 'Order these concepts from the best match for the column to the worst and answer with nothing but a JSON list of {"concept_id": ..., "match_score": 0 to 1, "justification": ...}.\n'
    return columns.join(lines, "column_name").select(F.col("column_name").alias("id"), F.concat(F.lit(task), about, F.lit("Concepts:\n"), "lines").alias("prompt"))


def rerank_listwise(columns: DataFrame, candidates: DataFrame, model, scorer=None, first: int = 10, second: int = 3) -> DataFrame:
    """Candidates (column_name, id, display_name, definition, aliases, score) with rerank_score, justification and rank, best first.

    columns: column_name, data_type, samples. ``scorer``, a pandas UDF over (query, text), puts the ``first`` best on; without it they stay in
    the order of score. The ``second`` best of each column go to the ``model`` in one question a column (prompts to answers, in the tasks), whose scores are joined back by column and id: the last of an id counts, a
    missing score is 0. Candidates that an answer leaves out, or all if it holds no list, keep their own score: that of the scorer through a sigmoid, else the vector
    score; if the list is broken, the scorer's as it is. Of equal scores the order of the answer, then the earlier one stays.
    """
    from lodestone.operators.generation import generate
    from lodestone.operators.prompts import extracted_array

    about = columns.select("column_name", F.concat_ws(" ", "column_name", F.concat(F.lit("["), F.array_join(F.slice("samples", 1, 5), ", "), F.lit("]"))).alias("_query"))
    text = F.concat(F.coalesce("display_name", F.lit("")), F.lit(". "), F.coalesce("definition", F.lit("")))
    base = candidates.join(about, "column_name").withColumn("_s", scorer(F.col("_query"), text) if scorer is not None else F.col("score").cast("double"))
    best = Window.partitionBy("column_name").orderBy(F.desc("_s"), "id")
    base = base.withColumn("place", F.row_number().over(best)).where(F.col("place") <= (first if scorer is not None else 1 << 30)).drop("_query")
    asked = generate(listwise_prompts(columns, base.where(F.col("place") <= second)), model)
    kind = "array<struct<concept_id: string, match_score: double, justification: string>>"
    read = asked.select(F.col("id").alias("column_name"), extracted_array(F.col("answer")).alias("_list"))
    read = read.select("column_name", (F.col("_list").isNotNull() & F.try_parse_json("_list").isNull()).alias("_broken"), F.when(F.try_parse_json("_list").isNotNull(), F.from_json("_list", kind)).alias("_r"))
    given = read.select("column_name", F.posexplode("_r").alias("_at", "_x")).groupBy("column_name", F.col("_x.concept_id").alias("id")).agg(F.max(F.struct("_at", F.coalesce("_x.match_score", F.lit(0.0)).alias("m"), "_x.justification")).alias("_g"))
    scored = base.join(read.select("column_name", "_broken"), "column_name", "left").join(given, ["column_name", "id"], "left")
    told = F.when(F.col("place") <= second, F.col("_g.m"))
    own = F.when(F.col("_broken") & (F.col("place") <= second), F.col("_s")).otherwise(sigmoid(F.col("_s"))) if scorer is not None else F.col("_s")
    inner = Window.partitionBy("column_name").orderBy((F.col("place") > second).cast("int"), F.when(F.col("place") <= second, -F.coalesce(told, F.lit(0.0))), "place")
    ordered = scored.withColumns({"_order": F.row_number().over(inner), "rerank_score": F.coalesce(told, own), "justification": F.when(F.col("place") <= second, F.col("_g.justification"))})
    final = Window.partitionBy("column_name").orderBy(F.desc("rerank_score"), "_order")
    return ordered.withColumn("rank", F.row_number().over(final)).select(*candidates.columns, "rerank_score", "justification", "rank")
