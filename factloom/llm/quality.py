"""Quality rules as weak supervision.

Each rule votes keep, reject or abstains. No two rules look at the same count: junk of one kind
shows in several of its traits (symbols on words also leave no plain function word and no
sentence end), so that votes agree or differ for reasons of their own. The rules' confusion
with the unseen label is estimated by expectation-maximisation over the counts of vote patterns
of all documents (at most 3 ** number of rules of them), started from the majority of votes,
and a document is kept if its posterior probability of being good is one half or more, rather
than if it passes every rule. The fixed base rule (too short, or mostly repeated) rejects
whatever the votes say, and what it rejects takes no part in the estimate.

Everything is computed with DataFrame functions on whole texts. Defined results: a null
or blank text has no words, so it fails the base rule; each row is judged by itself, so
repeated rows get equal results; a posterior of exactly one half keeps; a null doc_id stays
null; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.rows import drop_rows
from factloom.plans.shared import materialize

BLANK = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
ROUNDS = 50
#: Function words of European languages; a text in any of them holds several.
FUNCTION_WORDS = (
    "the of and to in that is was for with as on by at from or an be this are not have it "
    "de la le les et des en du que dans un une pour est qui sur "
    "der die das und von zu den mit ist im ein eine nicht auf für "
    "el los las y del por con una para como al se su "
    "il di che non per sono della o da em os um não uma van het een dat op te"
).split()
KEEP, REJECT, ABSTAIN = 1, -1, 0


def measures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id``, ``text_id`` (a hash) and the counts that the rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_id"), text.alias("text"))
    d = d.select(
        "doc_id",
        "text_id",
        "text",
        F.array_remove(F.split("text", BLANK, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    d = d.select(
        "doc_id",
        "text_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function"),
        F.size(F.filter("lines", lambda line: F.substring(F.rtrim(line), -1, 1).isin(*'.!?:"»”’)'))).cast("long").alias("n_ended"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[a-z]")).cast("long").alias("n_lower"),
        F.regexp_count("text", F.lit(r"[!?]{2,}")).cast("long").alias("n_shouts"),
    )
    # 3-word windows as hashes; only a text in which one comes twice is looked at further
    starts = F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    d = d.withColumn("windows", F.transform(starts, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).drop("words")
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("windows")
    same = lambda x, i: F.coalesce(F.get("placed", i)["h"] == x["h"], F.lit(False))
    d = d.withColumn("twice", F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))).drop("placed")
    d = d.withColumn("at", F.array_sort(F.transform("twice", lambda x: x["p"]))).drop("twice")
    covered = F.transform("at", lambda p, i: F.least(F.coalesce(F.get("at", i + 1) - p, F.lit(3)), F.lit(3)))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return d.drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _vote(keep: Column | None, reject: Column | None) -> Column:
    """A comparison with a null measure is null, so the rule abstains."""
    vote = F.lit(ABSTAIN)
    if keep is not None:
        vote = F.when(keep, KEEP).otherwise(vote)
    if reject is not None:
        vote = F.when(reject, REJECT).otherwise(vote)
    return vote.cast("int")


def rules() -> dict[str, Column]:
    """Name -> vote. The bounds are parameters of the method, not of the data."""
    words = F.nullif(F.col("n_words"), F.lit(0))
    chars = F.nullif(F.col("word_chars"), F.lit(0))
    lines = F.nullif(F.col("n_lines"), F.lit(0))
    mean, distinct = F.col("word_chars") / words, F.col("n_distinct") / words
    repeated, symbols = F.col("n_repeat_words") / words, F.col("n_symbols") / words
    latin = (F.col("n_lower") + F.col("n_upper")) / chars > 0.6
    return {
        "length": _vote(F.col("n_words") >= 100, None),
        "word_length": _vote(mean.between(3.5, 7), ~mean.between(2.5, 12)),
        "variety": _vote(distinct >= 0.4, distinct < 0.2),
        "repeats": _vote(repeated < 0.05, repeated > 0.3),
        "lines": _vote(None, F.col("n_dup_lines") / lines > 0.3),
        "line_ends": _vote((F.col("n_lines") > 1) & (F.col("n_ended") / lines >= 0.9), F.col("n_ended") / lines < 0.5),
        "symbols": _vote(None, symbols > 0.1),
        "function_words": _vote(F.col("n_function") >= 4, latin & (F.col("n_function") < 2)),
        "capitals": _vote((F.col("n_upper") / chars).between(0.002, 0.08), F.col("n_upper") / chars > 0.3),
        "shouts": _vote(None, F.col("n_shouts") / words > 0.05),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Votes with their counts -> log-odds of a good document before the votes, and for each
    rule and vote the log-odds it adds. Starts from the majority of votes, ties as good."""
    if not patterns:
        return 0.0, []
    n = len(patterns[0][0])
    good = [0.95 if sum(v) >= 0 else 0.05 for v, _ in patterns]
    prior, weights = 0.0, [{KEEP: 0.0, REJECT: 0.0, ABSTAIN: 0.0} for _ in range(n)]
    for _ in range(rounds):
        mass = [sum(c * g for (_, c), g in zip(patterns, good, strict=True)), sum(c * (1 - g) for (_, c), g in zip(patterns, good, strict=True))]
        prior = math.log((mass[0] + 1) / (mass[1] + 1))
        for j in range(n):
            for vote in (KEEP, REJECT, ABSTAIN):
                a = sum(c * g for (v, c), g in zip(patterns, good, strict=True) if v[j] == vote)
                b = sum(c * (1 - g) for (v, c), g in zip(patterns, good, strict=True) if v[j] == vote)
                weights[j][vote] = math.log((a + 1) / (mass[0] + 3)) - math.log((b + 1) / (mass[1] + 3))
        good = [_logistic(prior + sum(weights[j][x] for j, x in enumerate(v))) for v, _ in patterns]
    return prior, weights


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def judge(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> a row for each row: ``doc_id``, the counts, ``base_failed``,
    ``kept``, ``quality`` (posterior probability), ``n_rejects`` (rules that vote reject) and
    ``text_id``."""
    votes = rules()
    seen = materialize(measures(docs), "measures")
    seen = seen.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    names = [f"vote_{k}" for k in votes]
    open_ = seen.where(~base_failed())  # the base rule has decided the others
    patterns = [(tuple(r[:-1]), r[-1]) for r in open_.groupBy(*names).count().orderBy(*names).collect()]
    prior, weights = fit(patterns)
    odds = F.lit(prior)
    for name, w in zip(names, weights, strict=False):
        odds = odds + F.when(F.col(name) == KEEP, w[KEEP]).when(F.col(name) == REJECT, w[REJECT]).otherwise(w[ABSTAIN])
    failed, quality = base_failed(), 1 / (1 + F.exp(-odds))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rejects = sum((F.when(F.col(name) == REJECT, 1).otherwise(0) for name in names), F.lit(0))
    return seen.select("doc_id", *counts, failed.alias("base_failed"), (~failed & (quality >= 0.5)).alias("kept"), quality.alias("quality"), rejects.alias("n_rejects"), "text_id")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    return drop_rows(docs, judge(docs).where(~F.col("kept")).select("doc_id", "text_id"))
