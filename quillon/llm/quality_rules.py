"""Learned decision lists over text statistics, in DataFrame functions alone.

Statistics of every whole text are written once. Sequential covering then learns rules from the
labelled ones, each on the rows that the rules before it left. A rule grows by the threshold
condition of the highest information gain, is pruned on other rows (by a hash of doc_id) to its
best prefix, and is kept while its precision is high enough on both. A step first looks for a
rule that rejects; if the best isn't precise enough, for one that keeps, which takes its rows
away from the rules that reject after it. So the order matters, and the list is emitted as one
ordered conditional expression; rows on which no rule fires are kept.

Thresholds lie midway between neighbouring candidates, drawn anew for every rule from the rows
that are left: quantiles of all of them, of the bad ones, and of those unlike the commonest
value, whose nearest neighbours on both sides are candidates too. So a rare defect in a feature
that is otherwise constant still has a threshold.

Each step is one aggregation of (feature, bin) counts, so the driver sees at most
features x bins numbers, whatever the number of rows.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: a null text has no words and fails the base
rules; labels other than 0 and 1 are left out, the smallest of several labels of a doc_id
counts; without labels of both kinds no rule is learned and the base rules alone decide;
repeated rows and null doc_ids are judged like any other; extra columns are ignored; long
texts cost n log n in their words.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "digit_rate", "upper_rate", "stop_rate", "line_words", "bar_rate"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def _repeat_words(words: Column, size: int) -> Column:
    """Words in windows of ``size`` words that occur twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(size), F.get(at, k + 1) - p), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda x, k: F.coalesce(x["h"] == F.get(sorted_, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_, k + 1)["h"], F.lit(False)))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def repeats(grams: Column) -> Column:
        some = F.size(F.array_distinct(grams)) < F.size(grams)
        return F.when(some, let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), places)).otherwise(F.lit(0).cast("long"))

    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size)))), repeats))


def text_statistics(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, the base counts and the features of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)

    def of(words: Column) -> Column:
        stops = F.filter(words, lambda w: F.char_length(w) <= 3)
        return F.struct(F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"), F.size(stops).alias("n_stops"), _repeat_words(words, size).alias("n_repeat_words"))

    counted = docs.select(
        "doc_id", let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.char_length(bare).cast("long").alias("word_chars"), _count(text, SYMBOLS).alias("n_symbols"), _count(text, "0123456789").alias("n_digits"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), _count(text, "|").alias("n_bars"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    flat = counted.select("doc_id", "w.*", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), "word_chars", "n_symbols", "n_digits", "n_upper", "n_bars")
    return flat.select(
        "doc_id", *BASE, rate("word_chars", "n_words").alias("word_length"), rate("n_symbols", "n_words").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("n_distinct", "n_words").alias("distinct_rate"), rate("n_digits", "word_chars").alias("digit_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"), rate("n_stops", "n_words").alias("stop_rate"), rate("n_words", "n_lines").alias("line_words"), rate("n_bars", "n_words").alias("bar_rate"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x, t = F.col(self.feature).cast("double"), F.lit(float(self.threshold))
        return x > t if self.above else x <= t

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions and the verdict where it holds."""

    conditions: tuple[Condition, ...]
    keep: bool = False

    def __len__(self) -> int:
        return len(self.conditions)

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'reject'} if {' and '.join(map(str, self.conditions))}"


def fires(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition.column()
    return out


def _first_match(rules: list[Rule], answer: Callable[[Rule], bool], otherwise: bool) -> Column:
    out = None
    for rule in rules:
        out = F.when(fires(rule.conditions), F.lit(answer(rule))) if out is None else out.when(fires(rule.conditions), F.lit(answer(rule)))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: what the first rule that fires says, else true."""
    return _first_match(rules, lambda rule: rule.keep, True)


def unmatched(rules: list[Rule]) -> Column:
    return _first_match(rules, lambda rule: False, True)


def thresholds(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Cuts of each feature that takes more than one value on ``rows`` (features, bad)."""
    grid = [k / bins for k in range(1, bins)]
    quantiles = lambda c, f: F.percentile_approx(c, grid, 10_000).alias(f)
    middle = rows.agg(*(F.percentile_approx(f, 0.5, 10_000).alias(f) for f in features)).first()
    other = {f: F.when(F.col(f) != F.lit(middle[f]), F.col(f)) for f in features if middle[f] is not None}
    if not other:
        return {}
    found = rows.agg(
        *(quantiles(F.col(f), f) for f in other), *(quantiles(F.when(F.col("bad") == 1, F.col(f)), f"{f}_bad") for f in other), *(quantiles(x, f"{f}_other") for f, x in other.items()),
        *(F.min(F.when(F.col(f) > middle[f], F.col(f))).alias(f"{f}_next") for f in other), *(F.max(F.when(F.col(f) < middle[f], F.col(f))).alias(f"{f}_last") for f in other),
    ).first()
    seen = {f: sorted({middle[f], *(found[f] or []), *(found[f"{f}_bad"] or []), *(found[f"{f}_other"] or []), *(x for x in (found[f"{f}_next"], found[f"{f}_last"]) if x is not None)}) for f in other}
    return {f: [(a + b) / 2 for a, b in zip(c, c[1:])] for f, c in seen.items() if len(c) > 1}


def _bin(feature: str, cuts: list[float]) -> Column:
    """The number of cuts below the feature."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(feature) > c))


Counts = dict[str, dict[int, tuple[int, int]]]


def best_condition(counts: Counts, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition of the highest gain, from (wanted, other) counts by feature and bin; of
    equal gains the first."""
    p0, n0 = (sum(x[i] for x in counts[next(iter(cuts))].values()) for i in (0, 1))
    best, found = 0.0, None
    if not p0 or not n0:
        return None
    for f, edges in cuts.items():
        low = [0, 0]
        for k, t in enumerate(edges):
            low = [a + b for a, b in zip(low, counts[f].get(k, (0, 0)))]
            for above, (p, n) in ((False, low), (True, [p0 - low[0], n0 - low[1]])):
                gain = p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1))) if p else 0.0
                if gain > best + 1e-9:
                    best, found = gain, Condition(f, above, t)
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most_conditions: int, keep: bool) -> tuple[Condition, ...]:
    """The conjunction of highest gain on ``rows`` (features, bad) for the wanted label."""
    rule: list[Condition] = []
    wanted = (F.col("bad") == (0 if keep else 1)).cast("long")
    bins = F.array(*(F.struct(F.lit(f).alias("feature"), _bin(f, cuts[f]).alias("bin")) for f in cuts))
    binned = rows.select("bad", *cuts, F.inline(bins))
    while len(rule) < most_conditions:
        counts: Counts = {f: {} for f in cuts}
        for r in binned.where(fires(tuple(rule))).groupBy("feature", "bin").agg(F.sum(wanted).alias("p"), F.sum(1 - wanted).alias("n")).collect():
            counts[r["feature"]][r["bin"]] = (r["p"], r["n"])
        found = best_condition(counts, cuts)
        if found is None or found in rule:
            break
        rule.append(found)
    return tuple(rule)


def _hits(rows: DataFrame, rule: tuple[Condition, ...], keep: bool) -> dict[bool, list[tuple[int, int]]]:
    """(wanted, other) rows on which each prefix of the rule fires, of growing rows (True) and
    of pruning rows."""
    wanted, sums = (F.col("bad") == (0 if keep else 1)).cast("long"), []
    for grown in (True, False):
        for k in range(1, len(rule) + 1):
            hit = (fires(rule[:k]) & (F.col("grown") == grown)).cast("long")
            sums += [F.coalesce(F.sum(hit * wanted), F.lit(0)), F.coalesce(F.sum(hit * (1 - wanted)), F.lit(0))]
    got = list(rows.agg(*sums).first())
    pairs = list(zip(got[::2], got[1::2]))
    return {True: pairs[: len(rule)], False: pairs[len(rule) :]}


def pruned_length(hits: list[tuple[int, int]]) -> int:
    """The prefix that is best by (p - n) / (p + n), the shortest of equals."""
    return max(range(len(hits)), key=lambda k: ((hits[k][0] - hits[k][1]) / max(1, sum(hits[k])), -k)) + 1


def learn_rules(rows: DataFrame, features: list[str] = FEATURES, most_rules: int = 8, most_conditions: int = 3, bins: int = 24, precision: float = 0.9, keep_precision: float = 0.99) -> list[Rule]:
    """An ordered list from ``rows``: doc_id, features, bad (0 or 1). A rule that rejects must
    reach ``precision``, one that keeps ``keep_precision``, on its growing rows and on its
    pruning rows."""
    rows = rows.select("doc_id", *(F.col(f).cast("double").alias(f) for f in features), "bad").withColumn("grown", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.where(unmatched(rules))
        cuts, added = thresholds(left, features, bins), False
        for keep, least in ((False, precision), (True, keep_precision)):
            grown = _grow(left.where("grown"), cuts, most_conditions, keep) if cuts and not added else ()
            if not grown:
                continue
            hits = _hits(left, grown, keep)
            k = pruned_length(hits[False])
            (p, n), (p_grown, n_grown) = hits[False][k - 1], hits[True][k - 1]
            if p >= least * (p + n) and p_grown >= least * (p_grown + n_grown) and p_grown >= 2:
                rules.append(Rule(grown[:k], keep))
                added = True
        if not added:
            break
    while rules and rules[-1].keep:  # nothing rejects after it
        rules.pop()
    return rules


def base_failed(least_words: int = 10, most_repeats: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeats)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, list[Rule]]:
    """Statistics with base_failed and kept for every row, and the learned list."""
    stats = written(text_statistics(docs), "statistics")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    rows = written(stats.where(~base_failed()).join(known, "doc_id").select("doc_id", *FEATURES, "bad"), "labelled")
    rules = learn_rules(rows, **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules))), rules


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept")
