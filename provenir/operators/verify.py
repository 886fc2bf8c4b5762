"""Extractive answers and the support of their claims by what they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, tokens

SUPPORT = 0.34
GAP = "Evidence gap: nothing in the workspace supports an answer."


def best_sentences(evidence: DataFrame) -> DataFrame:
    """question_id, rnk, sentence: of each block of evidence(question_id, question, rnk, text) the sentence that shares most terms with the question, the shortest of equals."""
    rows = evidence.select("question_id", "rnk", tokens(F.col("question")).alias("q"), F.posexplode(sentences(F.regexp_replace("text", r"\s+", " "))).alias("i", "sentence"))
    rows = rows.withColumn("n", F.size(F.array_intersect(tokens(F.col("sentence")), F.col("q"))))
    w = Window.partitionBy("question_id", "rnk").orderBy(F.desc("n"), F.length("sentence"), "i")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("question_id", "rnk", "sentence")


def extractive_answers(questions: DataFrame, evidence: DataFrame, sources: int = 5) -> DataFrame:
    """question_id, answer: the best sentence of each of the first sources, cited by rank; a fixed text where there is none."""
    cited = best_sentences(evidence.where(F.col("rnk") <= sources)).select("question_id", F.struct("rnk", F.concat("sentence", F.lit(" [S"), "rnk", F.lit("]")).alias("s")).alias("x"))
    joined = cited.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), " ").alias("answer"))
    return questions.select("question_id").join(joined, "question_id", "left").select("question_id", F.coalesce("answer", F.lit(GAP)).alias("answer"))


def validate_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, n, claim, citations, support, supported of each sentence of answers(answer_id, answer) against sources(answer_id, rnk, text).

    Support is the largest share of the claim's terms that a cited source holds; a claim without a citation isn't supported.
    """
    claims = answers.select("answer_id", F.posexplode(sentences(F.col("answer"))).alias("n", "claim"))
    cites = F.transform(F.regexp_extract_all("claim", F.lit(r"\[S([0-9]+)\]"), 1), lambda c: c.cast("long"))
    terms = F.filter(tokens(F.regexp_replace("claim", r"\[S[0-9]+\]", "")), lambda t: ~t.rlike("^s[0-9]+$"))
    claims = claims.select("answer_id", "n", "claim", cites.alias("citations"), terms.alias("terms"))
    cited = claims.select("answer_id", "n", "terms", F.explode(F.array_distinct("citations")).alias("rnk"))
    share = F.size(F.array_intersect("terms", tokens(F.col("text")))) / F.size("terms")
    best = cited.where("size(terms) > 0").join(sources.select("answer_id", "rnk", "text"), ["answer_id", "rnk"]).groupBy("answer_id", "n").agg(F.max(share).alias("support"))
    out = claims.join(best, ["answer_id", "n"], "left").withColumn("support", F.round(F.coalesce("support", F.lit(0.0)), 6))
    return out.select("answer_id", "n", "claim", "citations", "support", ((F.size("citations") > 0) & (F.col("support") >= SUPPORT)).alias("supported"))


def coverage(claims: DataFrame) -> DataFrame:
    """answer_id, coverage: the share of an answer's claims that are supported."""
    return claims.groupBy("answer_id").agg(F.round(F.avg(F.col("supported").cast("double")), 6).alias("coverage"))
