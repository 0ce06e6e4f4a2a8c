"""Rules around generated answers: what is withheld, how labels are read, what a question asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.exprs import ladder

from . import search as R

# Language that is withheld, texts that replace or precede an answer.
#: A word's end as RE2 sees it: only ASCII letters, digits and _ are of a word; Java's own \b counts letters of all scripts.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Under (?i) RE2 also takes the long s and the Kelvin sign for s and k.
PROHIBITED = r"(?i)" + EDGE + r"(buy|[s\u017f]ell|hold|guaranteed up[s\u017f]ide|thi[s\u017f] [s\u017f]toc[k\u212a] will go (?:up|down))" + EDGE
WITHHELD = "The generated interpretation was withheld because it did not meet the research-only safety rules."
PREFACE = "I cannot predict whether the stock will go up or down, but I can assess whether the current signal and retrieved risk evidence support, weaken, or complicate the research case."
# What a question's intent adds to it.
RISK_QUERY = "Risk Factors market risk liquidity debt margin pressure material weakness macroeconomic pressure customer concentration demand weakness competition"
SUPPORT_QUERY = "MD&A results of operations revenue growth operating income cash flow demand business outlook liquidity strength capital resources"
BUNDLES = {
    "cybersecurity_risk_review": "Item 1C cybersecurity risk management governance incident response controls third party information systems",
    "value_trap_risk": "Risk Factors MD&A value trap quality weakness leverage margin pressure demand debt",
    "undervaluation_support": "MD&A revenue growth operating income cash flow liquidity valuation support business outlook",
    "liquidity_debt_risk": "Liquidity and Capital Resources debt maturities cash flow credit facilities capital requirements",
    "margin_pressure": "gross margin margin pressure costs tariffs pricing competition operating income",
    "demand_revenue_weakness": "demand revenue growth sales weakness competition macroeconomic pressure results of operations",
    "catalyst_review": "business outlook product launch demand growth operating results management discussion",
    "follow_up_research": "Risk Factors MD&A Item 1C Controls and Procedures financial impact mitigation costs governance",
}
# Passages, context characters and answer tokens of each depth.
DEPTHS = {"quick": (3, 4000, 300), "deep": (8, 12000, 900)}


def validated(answer: Column, citations: Column) -> Column:
    """(answer, warning): withheld if it advises; warned where it cites none of the passages."""
    advises = answer.rlike(PROHIBITED)
    cites = F.exists(citations, lambda c: answer.contains(c))
    return F.struct(F.when(advises, F.lit(WITHHELD)).otherwise(answer).alias("answer"), F.when(advises, F.lit("withheld")).when((F.size(citations) > 0) & ~cites, F.lit("no citation")).alias("warning"))


def with_preface(answer: Column, intent: Column) -> Column:
    """Outlook answers say first that no direction is predicted."""
    said = F.lower(answer).contains("cannot predict whether the stock will go up or down")
    return F.when((intent == "risk_outlook") & (answer != "") & ~said, F.concat(F.lit(f"Risk-Based Assessment:\n{PREFACE}\n\n"), answer)).otherwise(answer)


def guarded_relationship(intent: Column, relationship: Column, signal: Column, answer: Column) -> Column:
    """A claimed support or weakening stands only where all longer words of the signal occur in the answer."""
    terms = F.filter(F.split(F.replace(F.lower(F.coalesce(signal, F.lit(""))), F.lit("-"), F.lit(" ")), r"\s+"), lambda t: F.length(t) >= 5)
    named = (F.size(terms) > 0) & F.forall(terms, lambda t: F.lower(F.coalesce(answer, F.lit(""))).contains(t))
    bound = relationship.isin("Supports signal", "Weakens signal") & ~intent.isin("risk_outlook", "general")
    return F.when(bound & ~named, F.lit("Indirect relationship")).otherwise(relationship)


def named_field(answer: Column, names: list[str]) -> Column:
    """The value of the first line ``name: value`` with one of the names (case and underscores don't count)."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: x.contains(":") & F.replace(F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit("_"), F.lit(" ")).isin([n.lower() for n in names]))
    first = F.get(lines, F.lit(0))
    return F.trim(F.regexp_replace(first, "^[^:]*:", ""))


# The labels of the next three functions and the words that stand for them, first match wins.
def assessment(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    bare = F.regexp_replace(F.trim(low), r"^[:.\-]+|[:.\-]+$", "")
    allowed = ["Supports signal", "Weakens signal", "Mixed evidence", "Insufficient evidence", "Review recommended"]
    steps = [(bare == a.lower(), a) for a in allowed]
    return ladder([*steps, (low.contains("review"), "Review recommended"), (low.contains("weak") | low.contains("contradict"), "Weakens signal"), (low.contains("support"), "Supports signal"), (low.contains("mixed") | low.contains("complicat"), "Mixed evidence")], "Insufficient evidence")


def relevance(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return ladder([(low.contains("direct"), "Directly relevant to question"), (low.contains("partial"), "Partially relevant"), (low.contains("weak"), "Weakly relevant")], "Insufficient evidence")


def relationship(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    none = "Not enough evidence to connect to signal"
    return ladder([(low.contains("review"), "Review recommended"), (low.contains("indirect"), "Indirect relationship"), (low.contains("not enough") | low.contains("insufficient"), none), (low.contains("weak"), "Weakens signal"), (low.contains("mixed") | low.contains("complicat"), "Mixed"), (low.contains("support"), "Supports signal")], none)


def risk_posture(value: Column, quality: Column, risks: list[Column]) -> Column:
    high, known = F.lit(False), value.isNotNull() | quality.isNotNull()
    for r in risks:
        high, known = high | F.coalesce(r >= 75, F.lit(False)), known | r.isNotNull()
    return ladder([(high, "elevated risk"), ((value >= 65) & (quality >= 55), "supportive"), (known, "mixed")], "insufficient")


def risk_gates(scores: dict[str, Column], codes: Column) -> Column:
    """Names of the risk scores from 70 on, then the reason codes that speak of risk."""
    return F.concat(F.array_compact(F.array(*[F.when(c >= 70, F.lit(n)) for n, c in scores.items()])), F.filter(codes, lambda x: F.lower(x).contains("risk")))


def retrieval_queries(questions: DataFrame) -> DataFrame:
    """(query_id, kind, query): each question and what its intent adds, as queries of their own."""
    q = questions.withColumn("intent", R.intent(F.col("query")))
    pair = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("query"))
    more = lambda extra: F.concat_ws(" ", "query", F.lit(extra))
    bundle = F.create_map(*[F.lit(x) for kv in BUNDLES.items() for x in kv])
    found = F.when(F.col("intent") == "risk_outlook", F.array(pair("primary", F.col("query")), pair("risk", more(RISK_QUERY)), pair("support", more(SUPPORT_QUERY))))
    found = found.when(F.col("intent") == "general", F.array(pair("primary", F.col("query")))).otherwise(F.array(pair("primary", F.col("query")), pair("intent", F.concat_ws(" ", "query", F.try_element_at(bundle, F.col("intent"))))))
    return q.select("query_id", "intent", F.inline(found))


def depth(name: Column) -> Column:
    """(passages, context_chars, answer_tokens): quick only if asked for."""
    one = lambda n: F.struct(*[F.lit(v).alias(k) for k, v in zip(("passages", "context_chars", "answer_tokens"), DEPTHS[n])])
    return F.when(name == "quick", one("quick")).otherwise(one("deep"))


def session_summary(turns: DataFrame) -> DataFrame:
    """(conv_id, ticker, summary): the last three answers without error, a line each with their question, themes and first four passages.

    ``turns``: conv_id, ticker, turn, role, error, intent, query, relevance, relationship, citations."""
    ok = turns.where("role = 'assistant' and error is null")
    last = ok.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "ticker").orderBy(F.desc("turn")))).where("n <= 3")
    cites = F.slice("citations", 1, 4)
    line = F.format_string("Prior intent: %s; question: %s; themes: %s / %s; previous chunk IDs: %s.", F.coalesce("intent", F.lit("general")), F.coalesce("query", F.lit("unknown")), F.coalesce("relevance", F.lit("unknown")), F.coalesce("relationship", F.lit("unknown")), F.when(F.size(cites) > 0, F.array_join(cites, ", ")).otherwise("none"))
    rows = last.groupBy("conv_id", "ticker").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))  # three at most
    return rows.select("conv_id", "ticker", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("summary"))


def cache_reasons(store: DataFrame, corpus: DataFrame) -> Column:
    """Why a stored embedding table can't be used; columns of one joined row: (stored_, wanted_) corpus_hash, model, ids_hash, n, and bad_dimensions."""
    return F.array_compact(F.array(
        F.when(F.col("stored_corpus_hash") != F.col("wanted_corpus_hash"), "corpus hash changed"), F.when(F.col("stored_model") != F.col("wanted_model"), "embedding model changed"), F.when(F.col("stored_ids_hash") != F.col("wanted_ids_hash"), "chunk IDs or ordering changed"),
        F.when(F.col("stored_n") != F.col("wanted_n"), "vector count differs"), F.when(F.col("bad_dimensions") > 0, "vector dimensions differ")))


# Fixed value: what is said where no passage is found.
NO_EVIDENCE = "No relevant SEC filing evidence was retrieved; the evidence is insufficient."


def answer_questions(docs: DataFrame, questions: DataFrame, generator: Callable[[Column], Column] | None = None, k: int = 5, depth_name: str = "deep") -> DataFrame:
    """(query_id, intent, citations, answer, warning, limitations): intent, retrieval of each of its queries, merged evidence, answer, checks.

    ``generator`` makes an answer column from a prompt column; without one the passages come without interpretation. A prompt
    holds the leading passages that the depth's budget of characters has room for, whole but for a first one beyond it."""
    wanted = retrieval_queries(questions)
    asked = wanted.withColumn("part", F.concat_ws(":", F.col("query_id").cast("string"), "kind"))
    hits = R.bm25_top(docs, asked.select(F.col("part").alias("query_id"), "query"), 4 * k)
    best = hits.join(asked.select("query_id", "part").withColumnRenamed("query_id", "_q"), F.col("query_id") == F.col("part")).groupBy(F.col("_q").alias("query_id"), "doc_id").agg(F.max("score").alias("score"))
    best = R.top_k(best, k)
    passages = best.join(docs.select("doc_id", "text"), "doc_id")
    packed = R.prompt_pack(passages.select(F.col("query_id").alias("prompt"), F.col("rank").alias("place"), F.coalesce("text", F.lit("")).alias("body"), "doc_id"), DEPTHS[depth_name][1])
    cited = packed.groupBy(F.col("prompt").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), "doc_id", F.col("body").alias("text")))).alias("p"))
    rows = questions.join(wanted.select("query_id", "intent").distinct(), "query_id").join(cited, "query_id", "left")
    ids = F.coalesce(F.transform("p", lambda x: x["doc_id"].cast("string")), F.array().cast("array<string>"))
    rows = rows.withColumn("citations", ids)
    if generator is None:
        answer = F.lit(None).cast("string")
    else:
        body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["doc_id"].cast("string"), F.lit("] "), x["text"])), "\n")
        answer = F.when(F.col("p").isNotNull(), generator(F.concat_ws("\n\n", F.col("query"), body)))
    checked = validated(with_preface(answer, F.col("intent")), F.col("citations"))
    rows = rows.withColumn("_c", checked)
    none = F.when(F.col("p").isNull(), NO_EVIDENCE).when(answer.isNull(), "Retrieved evidence is provided without interpretation.")
    return rows.select("query_id", "intent", "citations", F.col("_c.answer").alias("answer"), F.when(answer.isNotNull(), F.col("_c.warning")).alias("warning"), none.alias("limitations"))
