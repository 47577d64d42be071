"""Quality rules with risk-controlled thresholds, in DataFrame functions alone (operator 11).

Texts are measured: words, symbols, repeated lines, words in repeated windows, and
shares derived from them.  A fixed base rule comes first.  Beyond it, cutoffs are
selected so that good documents are hardly ever rejected, with a guarantee:

* Labelled texts, each distinct one once, are dealt to two halves by their digest.
* On a bounded sample of the first half a path of steps is fitted: each step lowers
  the cutoff of one feature, those first that reject many bad texts and no good one.
  Steps are nested, so that a text has a level, the first step that rejects it.
* The second half is the holdout.  All its good texts are counted by stratum and level.
  For each stratum the steps are tested in their order: a step stands if the exact binomial
  bound on its false rejections, at a confidence of ``1 - delta / strata``, is at
  most ``alpha``; the first step that doesn't ends the stratum.  In a
  fixed order of nested steps no correction is needed within a stratum; over the
  strata it is Bonferroni's.  With a probability of ``1 - delta`` no stratum has a
  false rejection rate above ``alpha``.

Strata are languages.  Those with too few good holdout texts for any step to stand,
and those beyond the ``most_strata`` largest, are one stratum together.  Without labels
nothing but the base rule rejects.

Null and empty texts have no words (and fail the base rule); null labels count for nothing, of
contradicting labels of a text the worst holds; rows that repeat get the same result
each; an empty table gives an empty result; other columns are ignored.  The
measures take about linear time in the length of a text.  Windows are compared by 64-bit hashes:
that two of a text of a million words agree by chance has a probability under 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import with_checkpoints
from stocktake.llm.pii import once

# White space, symbols, and the base rule.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[^#*$%&|<>]+"
WIDTH = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The share of good texts that may be rejected, and the probability that a stratum's is higher.
ALPHA, DELTA = 0.02, 0.05
#: Features of a text, a rule's cutoff being on one of them: higher is worse.
FEATURES = ("symbols", "dup_lines", "repeats", "long_words", "short_words", "upper", "marks", "digits")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words: of pairs, of two pairs that overlap (three words), of two threes that overlap."""
    n = F.size(words)

    def joined(a: Column, shift: int) -> Column:
        return F.zip_with(a, F.slice(a, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))

    return once(joined(words, 1), lambda two: once(joined(two, 1), lambda three: F.slice(joined(three, 2), F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(0)))))


def repeated_words(words: Column) -> Column:
    """Words in windows of five that the text has twice or more; ``words`` is a plain name."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WIDTH), F.coalesce(F.get(at, k + 1) - p, F.lit(WIDTH)))), F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        """Equal windows stand side by side after sorting."""
        same = lambda x, k: F.coalesce(x["h"] == F.get(ordered, k)["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, k: same(x, k + 1) | same(x, k - 1))
        return once(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def places(found: Column) -> Column:
        return once(F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)

    # Most texts repeat no window, which the number of distinct ones tells.
    counted = once(window_hashes(words), lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), places(found)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= WIDTH, counted).otherwise(F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum, digest``, the measures and the features of every row."""
    stratum = F.col(stratum_col).cast("string") if stratum_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bare = F.btrim("text", F.lit(SPACES))
    rows = rows.select("doc_id", "stratum", "text", F.when(bare == "", _none("string")).otherwise(F.split(bare, SPACE + "+")).alias("words"), F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))

    # Counted on what isn't a plain small letter or white space, mostly a small part of the text.
    rest = F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")
    n_lines = F.size("lines")
    rows = rows.select(
        "doc_id", "stratum", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), rest.alias("rest"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), once(F.col("words"), repeated_words).cast("long").alias("n_repeat_words"), n_lines.alias("n_lines"),
    )

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("rest", pattern, "")).cast("long")

    letters = F.col("word_chars") - F.length("rest") + left(r"[^\p{L}]+")
    rows = rows.select("doc_id", "stratum", "digest", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_lines", left(SYMBOLS).alias("n_symbols"), letters.alias("n_letters"), left(r"[^\p{Lu}]+").alias("n_upper"), left(r"[^\p{N}]+").alias("n_digits"))
    rows = rows.withColumn("n_marks", F.col("word_chars") - F.col("n_letters") - F.col("n_digits"))

    def share(part: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(of).cast("double")), F.lit(0.0))

    length = share("word_chars", "n_words")
    features = {"symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "long_words": length, "short_words": -length, "upper": share("n_upper", "n_letters"), "marks": share("n_marks", "word_chars"), "digits": share("n_digits", "word_chars")}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.select("doc_id", "stratum", "digest", *MEASURES, failed.alias("base_failed"), *(features[f].alias(f"f_{f}") for f in FEATURES))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) of n trials, summed from the largest term downwards in logarithms."""
    if k >= n:
        return 1.0
    mode = min(k, int(p * n))
    log = math.lgamma(n + 1) - math.lgamma(mode + 1) - math.lgamma(n - mode + 1) + mode * math.log(p) + (n - mode) * math.log1p(-p)
    total, ratio = 1.0, 1.0
    for i in range(mode, 0, -1):
        ratio *= i / (n - i + 1) * (1 - p) / p
        total += ratio
        if ratio < 1e-18 * total:
            break
    ratio = 1.0
    for i in range(mode, k):
        ratio *= (n - i) / (i + 1) * p / (1 - p)
        total += ratio
        if ratio < 1e-18 * total:
            break
    return min(1.0, math.exp(log + math.log(total)))


def upper_bound(n: int, k: int, delta: float) -> float:
    """The exact (Clopper-Pearson) bound: with a probability of ``1 - delta`` the rate behind k of n is not above it."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(n, k, middle) > delta else (low, middle)
    return high


def least_holdout(alpha: float, delta: float) -> int:
    """So many good texts, none of them rejected, are the fewest for which a step can stand."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def fit_path(x: np.ndarray, good: np.ndarray, steps: int = 40, grid: int = 256) -> list[tuple[int, float]]:
    """Steps of (feature, cutoff), the best first: a step rejects so many bad texts for each good one."""
    path: list[tuple[int, float]] = []
    if not len(x) or good.all():
        return path
    left, now = np.ones(len(x), bool), np.full(x.shape[1], np.inf)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        values = values[np.unique(np.linspace(0, len(values) - 1, grid).astype(int))]
        cuts.append((values[:-1] + values[1:]) / 2)
    for price in (math.inf, 100.0, 30.0, 10.0):
        while len(path) < steps:
            best = None
            for f, each in enumerate(cuts):
                each = each[each < now[f]]
                own = [np.sort(x[left & side, f]) for side in (good, ~good)]
                lost, won = (len(o) - np.searchsorted(o, each, side="right") for o in own)
                worth = np.where(lost > 0, -np.inf, won) if price == math.inf else won - price * lost
                # Of equal worth the highest cutoff.
                if len(each) and (top := worth.max()) >= 3 and (best is None or top > best[0]):
                    best = (top, f, float(each[np.flatnonzero(worth == top)[-1]]))
            if best is None:
                break
            _, f, cut = best
            path.append((f, cut))
            now[f] = cut
            left &= x[:, f] <= cut
    return path


class Rules:
    """The path, the number of steps that stand for each stratum (``None``: all others), and what was counted: (n, rejected, bound) of the last one."""

    def __init__(self, path: list[tuple[int, float]], standing: dict[str | None, int], report: dict[str | None, tuple[int, int, float]]) -> None:
        self.path, self.standing, self.report = path, standing, report

    def level(self) -> Column:
        """The number of the first step that rejects a row, null if none does."""
        levels = []
        for f, name in enumerate(FEATURES):
            out = F.lit(None).cast("int")
            # Cutoffs of one feature fall along the path.
            for i, cut in reversed([(i, c) for i, (g, c) in enumerate(self.path) if g == f]):
                out = F.when(F.col(f"f_{name}") > cut, i).otherwise(out)
            levels.append(out)
        return F.least(*levels)

    def limit(self) -> Column:
        """How many steps stand for a row."""
        own = {k: v for k, v in self.standing.items() if k is not None}
        rest = F.lit(self.standing.get(None, 0))
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.col("stratum")), rest) if own else rest


def fit(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, sample_rows: int = 20_000, most_strata: int = 256, id_col: str = "doc_id", quality_col: str = "quality") -> Rules:
    """Rules from measured rows and labels (quality 1 is good); the path is fitted on at most ``sample_rows`` texts, all labelled texts are counted."""
    known = labels.where(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(quality_col).alias("quality"))
    # What fails the base rule isn't the method's to judge.
    joined = rows.where("not base_failed").join(known, "doc_id").groupBy("digest").agg(F.min("quality").alias("quality"), F.min("stratum").alias("stratum"), *(F.min(f"f_{f}").alias(f"f_{f}") for f in FEATURES))
    texts = with_checkpoints(joined.select("digest", "stratum", (F.col("quality") >= 1).alias("good"), (F.crc32(F.col("digest").cast("binary")) % 2 == 0).alias("holdout"), *(f"f_{f}" for f in FEATURES)))
    # The digest orders texts as if at random.
    sample = texts.where("not holdout").orderBy("digest").limit(sample_rows).select("good", *(f"f_{f}" for f in FEATURES)).collect()
    path = fit_path(np.array([r[1:] for r in sample], float).reshape(-1, len(FEATURES)), np.array([r[0] for r in sample], bool))
    rules = Rules(path, {}, {})
    if not path:
        return rules
    counted = texts.where("holdout and good").select("stratum", F.coalesce(rules.level(), F.lit(len(path))).alias("level"))
    sizes = counted.where(F.col("stratum").isNotNull()).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stratum").limit(most_strata).collect()
    m = len(sizes) + 1
    while m > 1 and sizes[m - 2]["n"] < least_holdout(alpha, delta / m):
        m -= 1
    own = [r["stratum"] for r in sizes[: m - 1]]
    name = F.when(F.col("stratum").isin(own), F.col("stratum")) if own else F.lit(None).cast("string")
    counts: dict[str | None, list[int]] = {k: [0] * (len(path) + 1) for k in [*own, None]}
    for r in counted.groupBy(name.alias("stratum"), "level").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["stratum"]][r["level"]] = r["n"]
    for stratum, by_level in counts.items():
        n, rejected = sum(by_level), 0
        rules.standing[stratum], rules.report[stratum] = 0, (n, 0, 0.0)
        for step in range(len(path)):
            rejected += by_level[step]
            if binomial_tail(n, rejected, alpha) > delta / m:
                break
            rules.standing[stratum], rules.report[stratum] = step + 1, (n, rejected, upper_bound(n, rejected, delta / m))
    return rules


def judge(rows: DataFrame, rules: Rules) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``kept``, and the feature whose cutoff rejects."""
    level = rules.level() if rules.path else F.lit(None).cast("int")
    at = rows.withColumn("level", F.when(level < rules.limit(), level))
    names = F.array(*(F.lit(FEATURES[f]) for f, _ in rules.path)) if rules.path else _none("string")
    return at.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("level").isNull()).alias("kept"), F.when(~F.col("base_failed"), F.get(names, F.col("level"))).alias("rule"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measure all texts once, fit the rules on the labelled ones, judge all."""
    rows = with_checkpoints(measured(docs))
    return judge(rows, fit(rows, labels, alpha, delta))
