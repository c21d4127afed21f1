"""Document quality by weak supervision, in DataFrame functions alone.

Each rule votes good (1) or bad (-1) on a document or abstains (0). The votes' patterns are counted, at most
3 to the number of rules of them, and expectation-maximisation over that table estimates the share of good
documents and each rule's accuracy when it votes. Documents that fail the base test are rejected anyway; they don't
count in the estimation, which would else take their faults (repeated words) for the only ones. A document's posterior probability of being good replaces
the demand that it pass every rule. The estimation is one SQL expression over the pattern table, whose size
does not depend on the corpus.

Words are runs without U+0020 and U+0009-U+000D. Repeated five-word windows are found by comparing hashes in
a document and, where any are equal, exactly by sorting the windows; the whole text counts.

Defined results: null text has no words, as has the empty text, and fails the base test; rows are judged
one by one with the corpus's model, so ties and repeated rows get equal verdicts; an empty table gives an
empty result; extra columns are kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import WS, bound, staged

WINDOW = 5
#: EM: rounds, first guess of the share of good documents and of a rule's accuracies, that guess's weight in
#: votes, bounds of accuracy on good documents and of the share.
ROUNDS, PRIOR, GOOD, BAD, PRIOR_VOTES, ACCURACY_RANGE, PRIOR_RANGE = 25, 0.85, 0.95, 0.4, 10.0, (0.5, 0.999), (0.05, 0.98)
#: Up to so many words, variety is the share of distinct words; beyond, they are held against the root of the length.
VARIETY_WORDS = 500
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = "the of and to in is that for on with as by are it be at this de la le les et en un une des du que qui dans par pour der die das und ist zu den von mit im nicht ein el los las y por con para una".split()


def repeated_words(words: Column) -> Column:
    """Words that stand in a five-word window which occurs twice or more, each counted once."""

    def key(i: Column, join) -> Column:
        return join(*[F.get(words, i + k) for k in range(WINDOW)])

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def exactly() -> Column:
        rows = F.array_sort(F.transform(starts, lambda i: F.struct(key(i, lambda *w: F.concat_ws(" ", *w)).alias("w"), i.alias("i"))))

        def positions(s: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(s) - 1)
            same = lambda j: (F.get(s, j)["w"] == F.get(s, j - 1)["w"]) | (F.get(s, j)["w"] == F.get(s, j + 1)["w"])
            return F.array_sort(F.transform(F.filter(at, lambda j: F.coalesce(same(j), F.get(s, j)["w"] == F.get(s, j + 1)["w"], F.get(s, j)["w"] == F.get(s, j - 1)["w"], F.lit(False))), lambda j: F.get(s, j)["i"]))

        def covered(p: Column) -> Column:
            gap = lambda j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(WINDOW)))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, j: acc + gap(j))

        return bound(rows, lambda s: bound(positions(s), lambda p: F.when(F.size(p) == 0, 0).otherwise(covered(p))))

    hashes = F.transform(starts, lambda i: key(i, F.xxhash64))
    repeated = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exactly()))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(repeated).cast("long")


def features(text: Column) -> Column:
    """Struct of the counts that the rules need."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    left = lambda pattern, t: F.length(F.regexp_replace(t, pattern, "")).cast("long")

    def of_words(t: Column, w: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            left(f"[{WS}]+", t).alias("word_chars"),
            left("[^#*$%&|<>]+", t).alias("n_symbols"),
            bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            left(r"[^\p{Lu}]+", t).alias("n_upper"),
            left("[^!?]+", t).alias("n_shouts"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    words = lambda t: F.filter(F.split(t, f"[{WS}]+", -1), lambda x: x != "")
    return bound(text, lambda t: bound(words(t), lambda w: of_words(t, w)))


def votes(f: Column) -> dict[str, Column]:
    """Each rule's vote."""
    n, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    size, symbols, shouts = chars / n, f["n_symbols"] / n, f["n_shouts"] / n
    repeats, upper, variety = f["n_repeat_words"] / n, f["n_upper"] / chars, f["n_distinct"] / F.least(n, F.sqrt(VARIETY_WORDS * n))
    function = f["n_function"] / n
    return {
        "length": vote(f["n_words"] >= 30, f["n_words"] < 10),
        "word_size": vote(size.between(3, 9), (size < 2) | (size > 14)),
        "symbols": vote(symbols < 0.05, symbols > 0.2),
        "shouts": vote(shouts < 0.05, shouts > 0.25),
        "capitals": vote(upper < 0.15, upper > 0.4),
        "repeats": vote(repeats <= 0.05, repeats > 0.2),
        "function_words": vote(function >= 0.08, function < 0.02),
        "variety": F.when((variety < 0.15) & (n >= 50), -1).when((variety >= 0.3) & (n >= 20), 1).otherwise(0),
    }


RULES = ("length", "word_size", "symbols", "shouts", "capitals", "repeats", "function_words", "variety")


def _posterior(v: Column, prior: Column, rules: Column) -> Column:
    """Probability of good. A good vote multiplies its odds by good / (1 - bad), a bad one by (1 - good) / bad."""
    gain = lambda x: F.when(x["v"] == 1, F.log(x["r"]["good"] / (1 - x["r"]["bad"]))).when(x["v"] == -1, F.log((1 - x["r"]["good"]) / x["r"]["bad"])).otherwise(0.0)
    odds = F.aggregate(F.arrays_zip(v.alias("v"), rules.alias("r")), F.log(prior / (1 - prior)), lambda acc, x: acc + gain(x))
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame) -> DataFrame:
    """(v, n: rows with the votes v) to (v, posterior, prior, rules); at most 3 ** len(RULES) rows.

    A rule has two accuracies: ``good``, how often it votes good on good documents when it votes, and
    ``bad``, how often it votes bad on bad ones. A vote never counts against its own direction.
    """
    numbers = F.sequence(F.lit(0), F.lit(len(RULES) - 1))
    clamp = lambda x, low, high: F.least(F.greatest(x, low), high)
    total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + value(r))
    low, high = (F.lit(x) for x in ACCURACY_RANGE)

    def step(table: Column, state: Column) -> Column:
        weighed = F.transform(table, lambda r: F.struct(r["v"].alias("v"), (r["n"] * _posterior(r["v"], state["prior"], state["rules"])).alias("g"), r["n"].alias("n")))

        def share(rows: Column, j: Column, vote: int, weight, guess: float) -> Column:
            cast = total(rows, lambda r: weight(r) * F.abs(F.get(r["v"], j)))
            right = total(rows, lambda r: F.when(F.get(r["v"], j) == vote, weight(r)).otherwise(0.0))
            return (right + guess * PRIOR_VOTES) / (cast + PRIOR_VOTES)

        def update(rows: Column) -> Column:
            def rule(j: Column) -> Column:
                good = clamp(share(rows, j, 1, lambda r: r["g"], GOOD), low, high)
                bad = share(rows, j, -1, lambda r: r["n"] - r["g"], BAD)
                return bound(good, lambda a: F.struct(a.alias("good"), clamp(bad, 1 - a, high).alias("bad")))

            prior = (total(rows, lambda r: r["g"]) + PRIOR * PRIOR_VOTES) / (total(rows, lambda r: r["n"]) + PRIOR_VOTES)
            return F.struct(clamp(prior, *(F.lit(x) for x in PRIOR_RANGE)).alias("prior"), F.transform(numbers, rule).alias("rules"))

        return bound(weighed, update)

    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("table"))
    guess = F.struct(F.lit(GOOD).alias("good"), F.lit(BAD).alias("bad"))
    start = F.struct(F.lit(PRIOR).alias("prior"), F.array_repeat(guess, len(RULES)).alias("rules"))
    fitted = one.select("table", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(F.col("table"), state)).alias("model"))
    rows = fitted.select(F.explode("table").alias("r"), "model")
    return rows.select(F.col("r.v").alias("v"), _posterior(F.col("r.v"), F.col("model.prior"), F.col("model.rules")).alias("posterior"), F.col("model.prior").alias("prior"), F.col("model.rules").alias("rules"))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def _voted(docs: DataFrame, text_col: str, keep: list[str], mark: str) -> DataFrame:
    f = F.col(mark)
    counted = docs.select(*[F.col(f"`{c}`") for c in keep], features(F.col(f"`{text_col}`")).alias(mark))
    cast = votes(f)
    return counted.withColumn(mark, F.struct(f.alias("f"), F.array(*[cast[r] for r in RULES]).alias("v")))


def _model(voted: DataFrame, mark: str) -> DataFrame:
    judged_by_it = F.when(base_failed(F.col(f"{mark}.f")), 0).otherwise(1)
    patterns = voted.groupBy(F.col(f"{mark}.v").alias("v")).agg(F.sum(judged_by_it).alias("n"))
    return staged(fit(patterns), "model").select(F.col("v").alias(f"{mark}_v"), F.col("posterior").alias(f"{mark}_p"))


def _verdicts(voted: DataFrame, model: DataFrame, mark: str) -> DataFrame:
    joined = voted.join(F.broadcast(model), F.col(f"{mark}.v") == F.col(f"{mark}_v"))
    failed = base_failed(F.col(f"{mark}.f"))
    verdict = F.struct(F.col(f"{mark}.f").alias("f"), F.col(f"{mark}.v").alias("v"), F.col(f"{mark}_p").alias("posterior"), failed.alias("base_failed"), (~failed & (F.col(f"{mark}_p") >= 0.5)).alias("kept"))
    return joined.withColumn(mark, verdict).drop(f"{mark}_v", f"{mark}_p")


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, mark: str = "quality") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``mark``: f (counts), v (votes), posterior, base_failed, kept.

    The counted rows are staged once: the pattern counts and the verdicts both read them.
    """
    own = staged(_voted(docs, text_col, docs.columns if keep is None else keep, mark), "votes")
    return _verdicts(own, _model(own, mark), mark)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model or the base test rejects.

    Votes are taken twice, to fit the model and to judge: texts are neither copied nor shuffled.
    """
    mark = f"quality_{uuid.uuid4().hex}"
    voted = _voted(docs, text_col, docs.columns, mark)
    good = _model(voted, mark).filter(F.col(f"{mark}_p") >= 0.5).select(F.struct(F.col(f"{mark}_v").alias("v"), F.lit(False).alias("failed")).alias(mark))
    # one key of votes and base test: a filter on either would be pushed down and count every text again
    keyed = voted.withColumn(mark, F.struct(F.col(f"{mark}.v").alias("v"), base_failed(F.col(f"{mark}.f")).alias("failed")))
    return keyed.join(F.broadcast(good), mark, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
