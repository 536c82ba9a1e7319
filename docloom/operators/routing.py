"""Document type by weighted file-name and content rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalars import let

SAMPLE_PAGES = 5
TYPES = ("billing", "medical", "legal", "treatment", "correspondence")

# File-name patterns with type and weight.
FILENAME_RULES = [
    ("invoice|bill|statement|receipt", "billing", 1.0),
    ("medical|diagnosis|clinical|patient|hospital|lab.?report", "medical", 1.0),
    ("legal|contract|agreement|court|deposition|subpoena|judgment", "legal", 1.0),
    ("treatment|therapy|rehab|session.?note", "treatment", 1.0),
    ("letter|memo|correspondence|notice|fax", "correspondence", 0.8),
    ("claim|adjuster|insurance|policy", "legal", 0.6),
]
# Content keywords with type and weight.
CONTENT_RULES = [
    (["invoice", "amount due", "total due", "billing", "payment due", "balance", "account number", "remit"], "billing", 1.0),
    (["patient", "diagnosis", "physician", "medical record", "clinical", "hospital", "lab result", "vital signs", "medication", "prognosis"], "medical", 1.0),
    (["court", "plaintiff", "defendant", "attorney", "counsel", "statute", "judgment", "verdict", "deposition", "sworn"], "legal", 1.0),
    (["treatment plan", "therapy", "rehabilitation", "session note", "provider", "treatment goal", "functional status"], "treatment", 1.0),
    (["dear", "sincerely", "regarding", "re:", "attention", "enclosed", "please find"], "correspondence", 0.7),
    (["claimant", "adjuster", "coverage", "policy number", "claim number", "insured", "deductible", "loss date", "date of loss"], "legal", 0.8),
    (["repair estimate", "restoration", "damage assessment", "estimated cost", "emergency extraction"], "billing", 0.6),
]


def text_samples(pages: DataFrame, first: int = SAMPLE_PAGES) -> DataFrame:
    """(document_id, sample): the first pages by position, joined by newlines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"])
    return pages.groupBy("document_id").agg(F.array_join(F.slice(ordered, 1, first), "\n").alias("sample"))


def _rule(source: str, pattern, kind: str, weight: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), pattern.alias("pattern"), F.lit(kind).alias("matched_type"), weight.alias("weight"))


def matched_rules(stem: Column, sample: Column) -> Column:
    """All rules that fire, in rule order: array of (source, pattern, matched_type, weight).

    Both texts are in lower case. Content keywords are substrings; a group needs two of them,
    and three reach its full weight. A group's hits are listed once.
    """
    found = [F.when(stem.rlike(p), _rule("filename", F.lit(p), t, F.lit(w))) for p, t, w in FILENAME_RULES]

    def group(kind: str, weight: float):
        share = lambda hits: F.least(F.size(hits) / F.lit(3.0), F.lit(1.5))
        pattern = lambda hits: F.concat(F.lit("keywords: "), F.array_join(F.slice(hits, 1, 5), ", "))
        return lambda hits: F.when(F.size(hits) >= 2, _rule("content", pattern(hits), kind, F.lit(weight) * share(hits)))

    for words, kind, weight in CONTENT_RULES:
        found.append(let(F.array_compact(F.array(*[F.when(F.contains(sample, F.lit(w)), F.lit(w)) for w in words])), group(kind, weight)))
    return F.array_compact(F.array(*found))


def route(documents: DataFrame) -> DataFrame:
    """Type, confidence and reasons of documents with document_id, filename and sample.

    Ties between types go to the one whose rule fired first.
    """
    stem = F.lower(F.regexp_replace("filename", r"\.[^.]*$", ""))
    low = documents.select("document_id", stem.alias("stem"), F.lower(F.coalesce("sample", F.lit(""))).alias("low"))
    out = low.select("document_id", matched_rules(F.col("stem"), F.col("low")).alias("matched_rules"))
    kinds = F.array_distinct(F.transform("matched_rules", lambda r: r["matched_type"]))
    scores = F.transform(
        kinds,
        lambda t, i: F.struct(
            F.aggregate(F.filter("matched_rules", lambda r: r["matched_type"] == t), F.lit(0.0), lambda s, r: s + r["weight"]).alias("score"),
            (-i).alias("first"),
            t.alias("type"),
        ),
    )
    out = out.withColumn("ranked", F.reverse(F.array_sort(scores)))
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    total = F.aggregate("ranked", F.lit(0.0), lambda s, r: s + r["score"])
    confidence = F.least(best["score"] / F.greatest(total, F.lit(1.0)), F.lit(1.0))
    fallback = F.size("matched_rules") == 0
    return out.select(
        "document_id",
        F.coalesce(best["type"], F.lit("unknown")).alias("predicted_type"),
        F.coalesce(F.round(confidence, 3), F.lit(0.0)).alias("confidence"),
        fallback.alias("is_fallback"),
        (~fallback & (confidence < 0.4)).alias("low_confidence"),
        F.when(F.coalesce(second["score"] > 0, F.lit(False)) & ((best["score"] - second["score"]) / F.greatest(best["score"], F.lit(1.0)) < 0.3), second["type"]).alias("close_runner_up"),
        "matched_rules",
    )
