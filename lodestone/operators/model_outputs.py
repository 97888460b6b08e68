"""Scoring of model answers: choices, instructions, determinism, readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Fixed value: the heading of multiple-choice prompts before their subject.
HEADING = "The following are multiple choice questions (with answers) about "


def choice_prompt(question: Column, choices: Column, subject: Column | None = None, mark: str = "") -> Column:
    """``mark`` and the question, its lettered choices on lines, and a line that asks for the answer; a heading first if there is a ``subject``."""
    if subject is not None:
        question = F.concat(F.lit(HEADING), subject, F.lit(".\n\n"), F.lit(mark), question)
    elif mark:
        question = F.concat(F.lit(mark), question)
    lines = F.transform(choices, lambda c, i: F.concat(F.chr(F.lit(65) + i), F.lit(". "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer:"))


def answer_letter(completion: Column, letters: str = "A-D") -> Column:
    """The first letter of that range, or null."""
    return F.nullif(F.regexp_extract(completion, f"([{letters}])", 1), F.lit(""))


def choice_accuracy(rows: DataFrame, by: str = "subject") -> DataFrame:
    """(by, n, parsed, accuracy) of (gold, answer) for each group and, with a null group, over all rows."""
    return rows.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("answer").isNotNull().cast("double")).alias("parsed"), F.avg(F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).cast("double")).alias("accuracy"))


def _related(count: Column, relation: Column, number: Column) -> Column:
    """Relations have blanks or underscores; none means at least, an unknown one equality."""
    name = F.replace(F.coalesce(F.nullif(relation, F.lit("")), F.lit("at least")), F.lit("_"), F.lit(" "))
    return F.when(name == "at least", count >= number).when(name == "at most", count <= number).when(name == "less than", count < number).otherwise(count == number)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != ""))


def instruction_holds(text: Column, kind: Column, relation: Column, number: Column, words: Column) -> Column:
    """Whether an answer follows one instruction; null for an unknown kind.

    ``words`` are keywords, or the ending phrase, which is compared without the marks .?! at its end.
    Case counts by letter, so that letters without the case asked for, or without case, fail.
    """
    low = F.lower(text)
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.rlike(s, F.lit("(?U)\\S"))))
    paragraphs = F.size(F.filter(F.split(text, "\\n(?U:\\s)*\\n"), lambda s: F.rlike(s, F.lit("(?U)\\S"))))
    bare = lambda x: F.regexp_replace(x, "[.?!]+$", "")
    has = lambda w: F.contains(low, F.lower(w))
    key = F.lower(F.get(words, F.lit(0)))
    times = F.when(F.length(key) > 0, (F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.nullif(F.length(key), F.lit(0))).otherwise(F.length(low) + 1)  # an empty word stands before and behind each character
    return (
        F.when(kind == "no_comma", ~F.contains(text, F.lit(",")))
        .when(kind == "word_count", _related(word_count(text), relation, number)).when(kind == "sentence_count", _related(sentences, relation, number)).when(kind == "paragraph_count", _related(paragraphs, relation, number))
        .when(kind == "keywords_exist", F.forall(words, has)).when(kind == "keywords_forbidden", ~F.exists(words, has)).when(kind == "keyword_frequency", _related(times, relation, number))
        .when(kind == "all_lower", ~F.rlike(text, F.lit("[\\p{L}&&[^\\p{IsLowercase}]]"))).when(kind == "all_upper", ~F.rlike(text, F.lit("[\\p{L}&&[^\\p{IsUppercase}]]")))
        .when(kind == "ends_with", F.endswith(bare(F.regexp_replace(text, "(?U)\\s+$", "")), bare(F.regexp_replace(F.get(words, F.lit(0)), "(?U)^\\s+|\\s+$", ""))))
    )


def instruction_accuracy(rows: DataFrame) -> DataFrame:
    """One row (prompts, prompt_accuracy, instruction_accuracy) of (prompt, holds); all of a prompt's instructions must hold."""
    prompts = rows.groupBy("prompt").agg(F.bool_and(F.coalesce("holds", F.lit(False))).alias("all"), F.sum(F.coalesce(F.col("holds").cast("int"), F.lit(0))).alias("held"), F.count(F.lit(1)).alias("n"))
    return prompts.agg(F.count(F.lit(1)).alias("prompts"), F.avg(F.col("all").cast("double")).alias("prompt_accuracy"), (F.sum("held") / F.sum("n")).alias("instruction_accuracy"))


def supported_prompts(prompts: DataFrame, supported: list[str], kinds: str = "kinds") -> DataFrame:
    """Prompts whose every instruction is supported."""
    return prompts.where(F.forall(kinds, lambda k: k.isin(supported)))


def system_delta(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(task, delta): accuracy of one system less another's, in points."""
    wide = rows.groupBy("task").pivot("system", [base, other]).agg(F.avg(F.col("correct").cast("double")))
    return wide.select("task", (100 * (F.col(other) - F.col(base))).alias("delta"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share from the start, by bisection on their prefixes' equality; two strings of one row are shorter than 2 ** 30."""
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.least(F.length(a), F.length(b))) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n))


def determinism(replicates: DataFrame, by: list[str]) -> DataFrame:
    """(by..., prefix, mean_length, class) of (replicate, text): the shortest pairwise common prefix against the mean length."""
    a = replicates.select(*by, F.col("replicate").alias("ra"), F.col("text").alias("a"))
    b = replicates.select(*by, F.col("replicate").alias("rb"), F.col("text").alias("b"))
    least = a.join(b, by).where("ra < rb").groupBy(*by).agg(F.min(common_prefix_length(F.col("a"), F.col("b"))).alias("prefix"))
    mean = replicates.groupBy(*by).agg(F.avg(F.length("text")).alias("mean_length"))
    share = F.col("prefix") / F.when(F.col("mean_length") > 0, F.col("mean_length"))
    kind = F.when(F.col("mean_length") == 0, "empty").when(share >= 0.99, "full").when(share >= 0.50, "stable").otherwise("noisy")
    return mean.join(least, by).select(*by, "prefix", "mean_length", kind.alias("class"))


# Fixed order of the classes, best first.
CLASS_ORDER = ("full", "stable", "noisy", "empty")


def worst_class(rows: DataFrame, by: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("class"))
    return rows.groupBy(*by).agg(F.max_by("class", place).alias("worst"))


def readable(text: Column) -> Column:
    """False if empty, if under 60 % of the characters are printable (with line feeds and tabs), or if a 4-gram of the first 400, the last left out, that is not blank occurs over 8 times without overlap."""
    from lodestone.functions.vectors import let

    printable = F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}\\p{N}\\p{P}\\p{S} \\n\\t]", ""))
    head = F.substring(text, 1, 400)
    grams = lambda h: F.when(F.length(h) >= 5, F.filter(F.transform(F.sequence(F.lit(1), F.length(h) - 4), lambda i: F.substring(h, i, F.lit(4))), lambda g: F.rlike(g, F.lit("(?U)\\S")))).otherwise(F.array().cast("array<string>"))
    repeats = let(head, lambda h: F.exists(F.array_distinct(grams(h)), lambda g: F.length(h) - F.length(F.replace(h, g, F.lit(""))) > 32))
    return ~((text == "") | (printable < 0.60 * F.length(text)) | repeats)


def pass_rate(rows: DataFrame, passed: str = "passed") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(passed).cast("int")).alias("passed"), F.avg(F.col(passed).cast("double")).alias("rate"))
