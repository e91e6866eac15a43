"""Grading of answers and the report over graded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wordings that refuse an answer, invented values, and citation forms by mode.
NOT_FOUND = r"(?i)not (?:found|present|contain|in the|documented|available|exist|cover|include|defined|part of|mention)|no (?:such|mention|entry|register|hits?|information|match|results?|documentation)|(?:does|do|is|are)n[’']?t (?:exist|appear|contain|cover|include|have|mention|document|in|part)|(?:does|do|is|are) not (?:exist|appear|contain|cover|include|have|mention|document|in|part)|(?:can(?:no|')t|could(?:n'| no)t|unable to) (?:find|locate|answer)|nothing (?:about|on|for)|isn[’']?t (?:in|part|present|documented)|outside the scope"
INVENTED = r"reset value (?:is|=|:)\s*0x"
CITES = {"indexed": r"(?i)\[[^\]]*\bp\.\s?\d+", "baseline": r"(?i)\b(?:p\.|pages?)\s?\d+"}


def plain_answer(answer: Column) -> Column:
    """Without code and emphasis marks, hex groups joined, lower case."""
    bare = F.regexp_replace(F.regexp_replace(answer, "[`*]", ""), " ", " ")
    return F.lower(F.regexp_replace(bare, r"(?<=[0-9a-fA-F])[_ ](?=[0-9a-fA-F]{4}\b)", ""))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def alternative_pattern(alt: Column) -> Column:
    """The pattern that an expected value stands for: hex with any padding, a bit range, a number, or text."""
    alt = F.trim(alt)
    digits = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.substring(alt, 3, 100)), "^0+", ""), F.lit("")), F.lit("0"))
    hi, lo = F.substring_index(alt, ":", 1), F.substring_index(alt, ":", -1)
    return (
        F.when(alt.rlike("^0x[0-9a-fA-F]+$"), F.concat(F.lit("0x0*"), digits, F.lit("(?![0-9a-f])")))
        .when(alt.rlike(r"^\d+:\d+$"), F.concat(F.lit(r"(?<!\d)"), hi, F.lit(r"\s*(?::|-|–|\.\.|to)\s*"), lo, F.lit(r"(?!\d)")))
        .when(alt.rlike(r"^[\d.]+$"), F.concat(F.lit(r"(?<![\d.])"), _quoted(alt), F.lit(r"(?!\d)")))
        .otherwise(_quoted(F.lower(alt)))
    )


def grade(answers: DataFrame) -> DataFrame:
    """answers (id, mode, must, answer) with correct, missing and cited."""
    plain = plain_answer(F.col("answer"))
    groups = F.filter(F.split("must", ";"), lambda g: F.trim(g) != "")
    df = answers.withColumns({"__a": plain, "__g": groups})
    unmet = F.filter("__g", lambda g: ~F.exists(F.filter(F.split(g, r"\|"), lambda x: F.trim(x) != ""), lambda x: F.regexp_like(F.col("__a"), alternative_pattern(x))))
    refused = F.col("answer").rlike(NOT_FOUND) & ~F.col("__a").rlike(INVENTED)
    absent = F.trim("must") == "NOT_FOUND"
    miss = F.when(absent, F.when(refused, F.array().cast("array<string>")).otherwise(F.array(F.lit("NOT_FOUND")))).otherwise(F.transform(unmet, lambda x: F.trim(x)))
    cited = F.when(F.col("mode") == "indexed", F.col("answer").rlike(CITES["indexed"])).otherwise(F.col("answer").rlike(CITES["baseline"]))
    return df.withColumn("missing", miss).withColumns({"correct": (F.size("missing") == 0).cast("int"), "cited": cited.cast("int")}).drop("__a", "__g")


def upper_median(col: str) -> Column:
    """The middle value, or the upper of the two in the middle: counts by value are summed, not the values gathered."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {col} DESC)")


def report(results: DataFrame) -> DataFrame:
    """One row for each mode: counts, money, tokens, time."""
    mean = lambda c: F.round(F.avg(c), 4)
    return results.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").cast("bigint").alias("correct"), F.sum("cited").cast("bigint").alias("cited"),
        F.round(F.sum("cost_usd"), 4).alias("cost_total"), mean("cost_usd").alias("cost_mean"),
        mean("tokens_total").alias("tokens_mean"), upper_median("tokens_total").alias("tokens_median"),
        mean("tokens_input_uncached").alias("uncached_mean"), mean("tokens_output").alias("output_mean"),
        mean("turns").alias("turns_mean"), mean("wall_s").alias("wall_mean"),
        F.count_if(F.coalesce("denied", F.lit("")) != "").alias("denied_runs"),
    )


def summary_lines(reported: DataFrame) -> DataFrame:
    """mode, line: a mode's report in a sentence."""
    return reported.select("mode", F.concat("mode", F.lit(": "), F.col("correct").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" correct, "), F.col("cited").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" with page citation, avg "), F.format_number("tokens_mean", 0), F.lit(" tokens, $"), F.format_number("cost_mean", 3), F.lit("/question, "), F.format_number("turns_mean", 1), F.lit(" turns")).alias("line"))


def cross_tab(results: DataFrame, modes: list[str]) -> DataFrame:
    """category, and for each mode correct/total."""
    cell = F.concat(F.sum("correct").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"))
    return results.groupBy("category").pivot("mode", modes).agg(cell)


def wrong(results: DataFrame) -> DataFrame:
    """Wrong or incomplete answers, a row each: mode, id, and what was missing where it is known."""
    own = results if "missing" in results.columns else results.withColumn("missing", F.lit(""))
    return own.where("correct = 0").select("mode", "id", F.coalesce("missing", F.lit("")).alias("missing"))


def upsert(old: DataFrame, new: DataFrame, questions: DataFrame) -> DataFrame:
    """New results take the place of old ones with their id and mode, in question order, unknown ids last."""
    kept = old.join(new.select("id", "mode"), ["id", "mode"], "left_anti").unionByName(new)
    return kept.join(questions.select("id", "place"), "id", "left").withColumn("place", F.coalesce("place", F.lit(999))).orderBy("place", "id", "mode")


def regrade(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Stored answers against the present expectations."""
    return grade(answers.drop("must", "correct", "cited", "missing").join(questions.select("id", "must"), "id"))


def token_usage(by_model: Column, flat: Column) -> Column:
    """Tokens summed over models, or the flat figure where there are none."""
    return F.when(F.size(by_model) > 0, F.aggregate(F.map_values(by_model), F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(flat)


def latest(results: DataFrame) -> DataFrame:
    """Of runs with one id and mode the last."""
    w = Window.partitionBy("id", "mode").orderBy(F.desc("run"))
    return results.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
