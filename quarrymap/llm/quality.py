"""Quality rules (operator 6): weak supervision over rule votes, in DataFrame functions only.

Rules vote good (1) or bad (-1) or abstain (0) on counts of the whole text. Expectation-maximisation
estimates, for either class, how often each rule casts each vote; the posterior of the good class then
replaces all-must-pass filtering. The votes of all documents are counted by vote pattern (at most
3 ** number of rules rows, whatever the input), so the iterations run on that bounded table, and the
posterior is one Column expression: a sum of learned log odds through a logistic.

Words are `[^\\x20\\x09-\\x0D]+`. Windows of eight words are compared by 64-bit hashes.

Defined cases: null text counts as empty (no words, base_failed, not kept); texts of any length are counted
whole; repeated rows each get their own equal row; the input's other columns are ignored, or in `keep_good`
pass through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.common import materialize

# The symbols and limits of the base contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_cells", "n_marks"]
KEEP_FROM = 0.5
FALSE_ALARMS = 0.05  # a rule casts at most this share of bad votes on good documents


def spaced(text: Column) -> Column:
    """Every white-space character as one space."""
    for ch in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(ch), F.lit(" "))
    return text


def occurrences(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("long")


def pair_hashes(a: Column, step: int, n: Column) -> Column:
    """hash(a[i], a[i + step]) for i in 0 .. n - 1."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def with_stats(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`df` and the counts of STATS (their names prefixed)."""
    names = {s: f"{prefix}{s}" for s in STATS}
    t, w, h, lines = (f"__{prefix}{x}" for x in ("text", "words", "windows", "lines"))
    df = df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(w, F.array_remove(F.split(spaced(F.col(t)), " "), ""))
    df = df.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: F.trim(spaced(x)) != ""))
    n = F.size(w)
    windows = n - (WINDOW - 1)
    df = df.withColumn(h, F.when(windows > 1, pair_hashes(pair_hashes(pair_hashes(F.col(w), 1, windows + 6), 2, windows + 4), 4, windows)))
    # Starts of repeated windows, found among neighbours after sorting (hash, start); only where a hash repeats.
    again = F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    starts = f"__{prefix}starts"
    df = df.withColumn(starts, F.when(F.size(F.array_distinct(F.col(h))) < F.size(h), again))
    a = F.col(starts)
    same = F.zip_with(a, F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.coalesce(x.h == y.h, F.lit(False)))
    hit = F.zip_with(F.zip_with(a, same, lambda x, s: F.struct(x.i.alias("i"), s.alias("s"))), F.concat(F.array(F.lit(False)), same), lambda x, p: F.when(x.s | p, x.i))
    hit = F.array_sort(F.filter(hit, lambda i: i.isNotNull()))
    gaps = F.zip_with(hit, F.slice(hit, F.lit(2), F.size(hit)), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    text = F.col(t)
    return df.withColumns(
        {
            names["n_words"]: n.cast("long"),
            names["word_chars"]: F.length(F.array_join(F.col(w), "")).cast("long"),
            names["n_symbols"]: sum((occurrences(text, s) for s in SYMBOLS[1:]), occurrences(text, SYMBOLS[0])),
            names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long"),
            names["n_repeat_words"]: F.when(a.isNull(), F.lit(0)).otherwise(covered).cast("long"),
            names["n_lines"]: F.size(lines).cast("long"),
            names["n_shouts"]: F.regexp_count(text, F.lit(r"\p{Lu}{3}")).cast("long"),
            names["n_cells"]: occurrences(text, " | "),
            names["n_marks"]: F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")).cast("long"),
        }
    ).drop(t, w, h, lines, starts)


def base_failed(prefix: str = "") -> Column:
    words, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (again * 100 > words * MAX_REPEAT_PERCENT)


def votes(prefix: str = "") -> dict[str, Column]:
    """Vote of each rule: 1 good, -1 bad, 0 abstain."""
    c = lambda s: F.col(f"{prefix}{s}").cast("double")
    words, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))

    def rule(x: Column, good: float, bad: float) -> Column:
        return F.when(x >= bad, -1).when(x <= good, 1).otherwise(0)

    length = c("word_chars") / words
    return {
        "symbols": rule(c("n_symbols") / words, 0.1, 0.5),
        "shouting": rule(c("n_shouts") / words, 0.1, 0.4),
        "cells": rule(c("n_cells") / words, 0.05, 0.25),
        "dup_lines": F.when(lines < 3, 0).otherwise(rule(c("n_dup_lines") / lines, 0.1, 0.4)),
        "marks": rule(c("n_marks") / F.greatest(c("word_chars"), F.lit(1.0)), 0.06, 0.1),
        "word_length": F.when((length < 2) | (length > 15), -1).when(length.between(3, 10), 1).otherwise(0),
    }


class RuleModel:
    """Estimates of the class prior and of each rule's votes by class."""

    def __init__(self, counts: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 60):
        # One starting belief for every rule: votes are mostly right, and bad documents are few.
        self.rules = rules
        self.prior = 0.8
        self.p = [{1: {1: 0.8, 0: 0.17, -1: 0.03}, 0: {1: 0.4, 0: 0.2, -1: 0.4}} for _ in rules]
        total = sum(n for _, n in counts)
        if not total:
            return
        weight = 0.01 * total  # of the starting belief
        start = [{k: dict(v) for k, v in p.items()} for p in self.p]
        for _ in range(rounds):
            good = [self.posterior(v) for v, _ in counts]
            mass = {1: sum(g * n for g, (_, n) in zip(good, counts))}
            mass[0] = total - mass[1]
            self.prior = min(0.98, max(0.02, mass[1] / total))
            for j in range(len(rules)):
                for k in (0, 1):
                    seen = {1: 0.0, 0: 0.0, -1: 0.0}
                    for g, (v, n) in zip(good, counts):
                        seen[v[j]] += (g if k else 1 - g) * n
                    self.p[j][k] = {x: (seen[x] + weight * start[j][k][x]) / (mass[k] + weight) for x in seen}
                alarms = min(FALSE_ALARMS, self.p[j][1][-1])
                rest = (1 - alarms) / (1 - self.p[j][1][-1])
                self.p[j][1] = {1: self.p[j][1][1] * rest, 0: self.p[j][1][0] * rest, -1: alarms}

    def log_odds(self, j: int, vote: int) -> float:
        return math.log(self.p[j][1][vote] / self.p[j][0][vote])

    def posterior(self, vote: tuple[int, ...]) -> float:
        z = math.log(self.prior / (1 - self.prior)) + sum(self.log_odds(j, x) for j, x in enumerate(vote))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def column(self, cast: dict[str, Column]) -> Column:
        z = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, r in enumerate(self.rules):
            z = z + F.when(cast[r] == 1, self.log_odds(j, 1)).when(cast[r] == -1, self.log_odds(j, -1)).otherwise(self.log_odds(j, 0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def fit(stats: DataFrame, prefix: str = "") -> RuleModel:
    """Estimate over all rows of `stats`; only the bounded table of vote patterns reaches the driver."""
    cast = votes(prefix)
    rows = stats.select(*(v.alias(r) for r, v in cast.items())).groupBy(*cast).count().collect()
    counts = sorted((tuple(row[r] for r in cast), row["count"]) for row in rows)
    return RuleModel(counts, list(cast))


def with_verdict(stats: DataFrame, model: RuleModel, prefix: str = "") -> DataFrame:
    """Adds base_failed, quality (posterior of the good class) and kept."""
    q = model.column(votes(prefix))
    out = stats.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}quality", q)
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}quality") >= KEEP_FROM))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, quality) of every row; texts are read once, counts are kept as Parquet."""
    stats = materialize(with_stats(df.select(F.col(id_col), F.col(text_col)), text_col).drop(text_col), "quality-stats")
    out = with_verdict(stats, fit(stats))
    return out.select(id_col, *STATS[:5], "base_failed", "kept", "quality")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of `df`, all columns, that pass the base rules and the verdict."""
    prefix = "__quality_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    stats = materialize(with_stats(df, text_col, prefix), "quality-documents")
    return with_verdict(stats, fit(stats, prefix), prefix).filter(F.col(f"{prefix}kept")).select(*df.columns)
