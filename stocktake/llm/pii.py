"""Personal data by candidate gradient boosting, in DataFrame functions alone (operator 2).

High-recall generators propose spans, which may overlap.  Four base kinds are
fixed patterns with a check; what passes is always a span.  Further kinds
(disguised e-mail addresses, IPv6 addresses, national and bank numbers, phone
numbers without a country code) are candidates only: boosted trees score them
by format and context, and a threshold calibrated for each kind selects.

The trees are fitted on the driver, on a bounded sample: candidates of about
``sample_docs`` documents, labelled by the base checks, and ``made`` sentences for
each further kind, genuine or look-alike, in contexts that speak for it, against
it or say nothing.  A third of the made sentences is kept apart: on it the threshold
of each kind is chosen, and precision and recall are reported.  The trees become
plain column expressions, so that scoring runs inside the query like everything
else.

Spans are placed, chosen and cut out by sweeps over sorted arrays, in blocks, so
that a text of very many spans takes about linear time.

Positions are code points.  Null and empty texts have no spans; a null text
stays null when redacted.  Repeated rows give repeated results; an empty table
gives an empty result; all other columns are kept by ``redact`` and ignored by
``find``.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order.  Runs are possessive and begin
# at a run's first character (or where the last match ended), which matches the
# same strings as the plain patterns but takes linear time on any text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
# The generators of further candidates.
MORE = (
    ("email_alt", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT|@) ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(] ?(?:dot|DOT|\.) ?[\])]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+"),
    ("ip6", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){4,7}+(?![0-9A-Za-z:])"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    ("phone_alt", r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
KINDS = tuple(k for k, _ in BASE + MORE)
# Words of the context that speak for or against personal data.
FOR = r"mail|contact|call|phone|tel|mobile|fax|reach|ssn|social|card|visa|account|iban|bank|name|address|host|server|client|login"
AGAINST = r"order|invoice|version|page|isbn|sku|part|serial|model|ticket|ratio|score|figure|table|section|build|release|example id"
#: Labelled examples for the tests and beside the made ones.
EXAMPLES = (
    ("mail me: jane.doe [at] example [dot] org soon", 1), ("contact bob (at) mail (dot) net", 1), ("look (at) this . it is", 0), ("we met [at] noon (dot) fine", 0),
    ("client address 2001:db8:85a3:8d3:1319:8a2e:370:7348 seen", 1), ("server fe80:0:0:0:202:b3ff:fe1e:8329 up", 1), ("score 10:20:30:40:50 at the end", 0), ("build 12:34:56:78:90 done", 0),
    ("her ssn 219-09-9999 is", 1), ("ssn: 457-55-5462", 1), ("part 123-45-6789 in stock", 0), ("order 987-65-4321 shipped", 0),
    ("bank account DE89 3704 0044 0532 0130 00 please", 1), ("iban GB29NWBK60161331926819 of", 1), ("serial AB12 CDEF GHIJ KLMN on", 0), ("sku XY99 AAAA BBBB CCCC DDDD sold", 0),
    ("call (702) 555-0742 now", 1), ("phone 415-555-0132 after", 1), ("order 123 456 7890 shipped", 0), ("table 111 222 3333 shows", 0),
)
# Words that say nothing.
NEUTRAL = ("the", "and then", "we saw", "of", "in the end", "there was", "it said", "note", "with", "left", "under", "today")
N_FEATURES = 11
_SPAN = "array<struct<kind: string, start: int, end: int, hit: string, before: string, after: string>>"
#: Characters of the context before and after a candidate.
BEFORE, AFTER = 28, 12


#: Elements of a block of a sweep.
BLOCK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def sweep(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """``state`` after all items, and in ``out`` what each step gave out (``array<kind>``), in order; ``items`` is a plain name (see ``once``).

    ``step`` takes state and item and gives the next state and an array.  Steps
    append to short arrays, one for each block, since appending copies.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(items, at, BLOCK), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return once(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    places = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(places, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), block)
    return once(done, lambda x: F.struct(x["state"].alias("state"), F.flatten(x["out"]).alias("out")))


def hits(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """All matches of a pattern with their places: the lengths of the gaps between matches give them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        before, after = F.right(x["gap"], F.lit(BEFORE)), F.substring(F.coalesce(x["next"], F.lit("")), 1, AFTER)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("hit"), before.alias("before"), after.alias("after"))
        return end, F.when(x["hit"].isNull(), none).otherwise(F.array(span))

    both = once(gaps, lambda g: F.arrays_zip(g.alias("gap"), found.alias("hit"), F.slice(g, F.lit(2), F.size(g)).alias("next")))
    named = "array<struct<gap: string, hit: string, next: string>>"
    return F.coalesce(F.when(gate, once(both.cast(named), lambda items: sweep(items, F.lit(0), step, _SPAN[6:-1])["out"])), none)


def gates(text: Column) -> dict[str, Column]:
    """Cheap necessary conditions for a kind to occur."""
    digit = text.rlike("[0-9]")
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": digit & text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        "phone": F.contains(text, F.lit("+")) & digit,
        "email_alt": text.rlike(r"[\[(] ?(?:at|AT|@) ?[\])]"),
        "ip6": text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:"),
        "national_id": digit & text.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
        "phone_alt": digit & text.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    }


def luhn(hit: Column) -> Column:
    """The checksum of card numbers, over the digits from the right."""
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def passes(span: Column) -> Column:
    """The check of a base kind; true for the others."""
    hit = span["hit"]
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return (
        F.when(span["kind"] == "ip", F.forall(F.split(hit, r"\."), small))
        .when(span["kind"] == "card", digits.between(13, 19) & luhn(hit))
        .when(span["kind"] == "phone", digits.between(9, 15))
        .otherwise(F.lit(True))
    )


def well_formed(span: Column) -> Column:
    """Whether a candidate of a further kind keeps the rules of its format."""
    hit, kind = span["hit"], span["kind"]
    bare = F.regexp_replace(hit, "[^A-Za-z0-9]", "")

    def letter(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.ascii(c) - 55)

    # The international check of bank numbers: letters count from 10, the first four places come last.
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + letter(c)) % 97)
    return (
        F.when(kind == "iban", rest == 1)
        .when(kind == "national_id", hit.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))
        .when(kind == "phone_alt", bare.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
        .when(kind == "ip6", hit.rlike("^(?:[^:]+:){7}[^:]+$"))
        .when(kind == "email_alt", hit.rlike(r"(?i)[\[(] ?(?:dot|\.) ?[\])] ?[a-z]{2,}$"))
        .otherwise(F.lit(True))
    )


def features(span: Column) -> Column:
    """Numbers about the format and the context of a candidate; the context ends at a candidate of the same kind."""
    hit = span["hit"]
    size = F.length(hit)
    before, after = F.lower(span["before"]), F.lower(span["after"])
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    code = F.array_position(F.array(*map(F.lit, KINDS)), span["kind"])
    numbers = [code, size, digits, digits / size, F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), F.length(F.regexp_replace(hit, "[^A-Za-z]", "")),
               before.rlike(FOR).cast("int"), (before.rlike(AGAINST) | after.rlike(AGAINST)).cast("int"), before.rlike("[a-z0-9]$").cast("int"), F.size(F.array_distinct(F.split(hit, ""))), well_formed(span).cast("int")]
    return F.array(*(n.cast("double") for n in numbers))


def grow(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, depth: int) -> tuple:
    """A regression tree: ``(feature, threshold, left, right)``, or a leaf's value."""
    leaf = float(-gradient.sum() / (curvature.sum() + 1))
    if depth == 0 or len(x) < 4:
        return (leaf,)
    best, place = 1e-6, None
    whole = gradient.sum() ** 2 / (curvature.sum() + 1)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in np.unique(np.quantile(values, np.linspace(0, 1, 18)[1:-1], method="lower")) if len(values) > 1 else ():
            low = x[:, f] <= cut
            if low.all():
                continue
            gain = gradient[low].sum() ** 2 / (curvature[low].sum() + 1) + gradient[~low].sum() ** 2 / (curvature[~low].sum() + 1) - whole
            if gain > best:
                best, place = gain, (f, float(cut), low)
    if place is None:
        return (leaf,)
    f, cut, low = place
    return f, cut, grow(x[low], gradient[low], curvature[low], depth - 1), grow(x[~low], gradient[~low], curvature[~low], depth - 1)


def value(tree: tuple, row: np.ndarray) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3) -> list[tuple]:
    """Boosted trees for the logarithm of the odds; the rate is in the leaves."""

    def scaled(tree: tuple) -> tuple:
        return (tree[0] * rate,) if len(tree) == 1 else (tree[0], tree[1], scaled(tree[2]), scaled(tree[3]))

    score, trees = np.zeros(len(x)), []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(scaled(grow(x, weight * (p - y), weight * p * (1 - p), depth)))
        score += np.array([value(trees[-1], r) for r in x])
    return trees


def expression(trees: list[tuple], numbers: Column) -> Column:
    """The trees as one column: a probability."""

    def of(tree: tuple) -> Column:
        return F.lit(tree[0]) if len(tree) == 1 else F.when(numbers[tree[0]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + of(tree)
    return 1 / (1 + F.exp(-total))


class Selector:
    """Fitted trees, the threshold of each further kind, and its precision and recall on the sentences kept apart."""

    def __init__(self, trees: list[tuple], thresholds: dict[str, float], report: dict[str, tuple[float, float]]) -> None:
        self.trees, self.thresholds, self.report = trees, thresholds, report


def propose(rows: DataFrame) -> DataFrame:
    """Add ``base`` (spans that pass) and ``found`` (all candidates) to rows with ``text``."""
    gate = gates(F.col("text"))
    base = F.concat(*(hits(F.col("text"), k, p, gate[k]) for k, p in BASE))
    more = F.concat(*(hits(F.col("text"), k, p, gate[k]) for k, p in MORE))
    # Most texts hold neither a digit nor an at sign, and so no candidate of any kind but disguised addresses.
    any_kind = F.col("text").rlike(r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]")
    none = F.array().cast(_SPAN)
    rows = rows.withColumn("proposed", F.coalesce(F.when(any_kind, base), none)).withColumn("more", F.coalesce(F.when(any_kind, more), none))
    return rows.withColumn("base", F.filter("proposed", passes))


def sentences(made: int, seed: int = 19) -> list[tuple[str, str, int]]:
    """``(kind, text, label)``: genuine ones and look-alikes of each further kind."""
    draw = random.Random(seed)
    speaking, against = FOR.split("|"), AGAINST.split("|")

    def digits(n: int) -> str:
        return "".join(draw.choice("0123456789") for _ in range(n))

    def name(n: int = 8) -> str:
        return "".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(3, n)))

    def iban(valid: bool) -> str:
        body = draw.choice(("", "NWBK", "ABNA")) + digits(draw.randint(12, 18))
        country = draw.choice(("DE", "FR", "GB", "NL", "ES"))
        turned = int("".join(str(int(c, 36)) for c in body + country + "00"))
        check = 98 - turned % 97
        number = f"{country}{check if valid else (check + draw.randint(1, 90)) % 97:02d}{body}"
        return " ".join(number[i : i + 4] for i in range(0, len(number), 4)) if draw.random() < 0.5 else number

    def of(kind: str, real: bool) -> str:
        if kind == "email_alt":
            at, dot = draw.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("[@]", "[.]")))
            return f"{name()} {at} {name()} {dot} {draw.choice(('org', 'com', 'net'))}" if real else f"{name()} {at} {name(5)} {draw.choice(('.', dot))} {draw.choice(('it', 'x', '7', 'so'))}"
        if kind == "ip6":
            return ":".join(f"{draw.randrange(65536):x}" for _ in range(8)) if real else ":".join(digits(draw.randint(1, 2)) for _ in range(draw.randint(5, 8)))
        if kind == "national_id":
            return f"{draw.randint(1, 665):03d}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}" if real else f"{draw.choice(('000', '666', '9' + digits(2), digits(3)))}-{digits(2)}-{digits(4)}"
        if kind == "iban":
            return iban(True) if real else draw.choice((iban(False), "".join(draw.choice("ABXYZ") for _ in range(2)) + digits(2) + " " + " ".join("".join(draw.choice("ABCDEFGH19") for _ in range(4)) for _ in range(4))))
        a, b, c = (str(draw.randint(2, 9)) + digits(2) if real else digits(3) for _ in range(2)), digits(4), draw.choice(" .-")
        first, second = a
        return f"({first}) {second}-{b}" if draw.random() < 0.3 else f"{first}{c}{second}{c}{b}"

    out = []
    for kind, _ in MORE:
        for i in range(made):
            real = i % 2 == 0
            # Most genuine ones stand in a context that says so; some in none, and none in one that speaks against them.
            words = (speaking if draw.random() < 0.75 else NEUTRAL) if real else (against if draw.random() < 0.6 else NEUTRAL)
            tail = draw.choice(against) if not real and draw.random() < 0.4 else draw.choice(NEUTRAL)
            out.append((kind, f"{draw.choice(NEUTRAL)} {draw.choice(words)}{draw.choice((':', '', ' is'))} {of(kind, real)} {tail} {name()}", int(real)))
    return out


def fit(docs: DataFrame, sample_docs: int = 4000, made: int = 400, id_col: str = "doc_id", text_col: str = "text") -> Selector:
    """Fit on candidates of about ``sample_docs`` documents (at most 20,000) and ``made`` sentences for each further kind."""
    spark = docs.sparkSession
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = propose(docs.where(drawn).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    each = picked.select("text", F.explode("proposed").alias("s")).select("s.kind", features(F.col("s")).alias("x"), passes(F.col("s")).cast("int").alias("y"))
    rows = [(r.kind, r.x, r.y, 0.1, False) for r in each.orderBy(F.xxhash64("x", "y"), "y").limit(20_000).collect()]
    told = [*((i, kind, text, y) for i, (kind, text, y) in enumerate(sentences(made))), *((-1, "", text, y) for text, y in EXAMPLES)]
    proposed = propose(spark.createDataFrame(told, "i int, wanted string, text string, y int"))
    found = proposed.select("i", "wanted", "text", "y", F.explode("more").alias("s")).where((F.col("i") < 0) | (F.col("s.kind") == F.col("wanted")))
    found = found.select("i", "s.kind", features(F.col("s")).alias("x"), "y").orderBy("i", "text", "s.start").collect()
    rows += [(r.kind, r.x, r.y, 1.0, r.i >= 0 and r.i % 3 == 0) for r in found]
    x, y, weight = (np.array(c, float) for c in zip(*((r[1], r[2], r[3]) for r in rows), strict=True))
    apart = np.array([r[4] for r in rows])
    trees = boost(x[~apart], y[~apart], weight[~apart])
    thresholds, report = {}, {}
    for kind, _ in MORE:
        own = np.flatnonzero(apart & (x[:, 0] == KINDS.index(kind) + 1))
        score = np.array([1 / (1 + np.exp(-sum(value(t, x[i]) for t in trees))) for i in own])
        thresholds[kind], *report[kind] = calibrated(score, y[own])
    return Selector(trees, thresholds, {k: tuple(v) for k, v in report.items()})


def calibrated(score: np.ndarray, label: np.ndarray, least_precision: float = 0.95) -> tuple[float, float, float]:
    """The threshold of the greatest recall at ``least_precision`` or else of the greatest precision; precision and recall there."""
    best = (1.1, 1.0, 0.0)
    held = sorted(set(score.tolist()))
    for low, cut in zip([0.0, *held], held, strict=False):
        chosen = score >= cut
        precision, recall = label[chosen].mean(), label[chosen].sum() / max(1, label.sum())
        if (min(precision, least_precision), recall) > (min(best[1], least_precision), best[2]):
            # Half way to the next lower score.
            best = ((low + cut) / 2, float(precision), float(recall))
    return best


def placed(rows: DataFrame, selector: Selector) -> DataFrame:
    """Add ``spans`` to rows with ``text``: base spans, and selected ones that overlap neither a base span nor, of two that follow each other, one of a higher score."""
    scored = F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), expression(selector.trees, features(s)).alias("score")))
    rows = propose(rows)
    rows = rows.withColumn("scored", F.when(F.size("more") > 0, scored).otherwise(F.array().cast("array<struct<kind: string, start: int, end: int, score: double>>")))
    limit = F.create_map(*(F.lit(v) for kv in selector.thresholds.items() for v in kv))
    rows = rows.withColumn("chosen", F.filter("scored", lambda s: s["score"] >= limit[s["kind"]]))
    plain = lambda s, rank, score: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), score.alias("score"))
    base = F.transform("base", lambda s: plain(s, F.lit(0), F.lit(1.0)))
    # By start, base spans first.
    ordered = F.array_sort(F.concat(base, F.transform("chosen", lambda s: plain(s, F.lit(1), s["score"]))))
    rows = rows.withColumn("ordered", F.when(F.size("chosen") > 0, ordered).otherwise(base))
    span = "struct<start: int, rank: int, end: int, kind: string, score: double>"
    none = F.array().cast(f"array<{span}>")

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        """State: the end of the base spans so far, and a chosen span that may yet be beaten."""
        held, reach = state["held"], state["reach"]
        meets = F.coalesce(s["start"] < held["end"], F.lit(False))
        is_base = s["rank"] == 0
        lost = ~is_base & (s["start"] < reach)
        better = s["score"] > held["score"]
        nothing = F.lit(None).cast(span)
        next_held = F.when(lost, held).when(is_base, F.when(meets, nothing).otherwise(nothing)).when(meets & ~better, held).otherwise(s)
        out = F.when(lost, none).when(held.isNotNull() & ~meets, F.array(held)).otherwise(none)
        return F.struct(F.when(is_base, F.greatest(reach, s["end"])).otherwise(reach).alias("reach"), next_held.alias("held")), F.when(is_base, F.concat(out, F.array(s))).otherwise(out)

    def swept(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(span).alias("held"))
        return once(sweep(items, start, step, span), lambda r: F.concat(r["out"], F.when(r["state"]["held"].isNotNull(), F.array(r["state"]["held"])).otherwise(none)))

    kept = F.when(F.size("chosen") > 0, once(F.col("ordered"), swept)).otherwise(F.col("ordered"))
    shown = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    none_shown = F.array().cast("array<struct<kind: string, start: int, end: int, score: double>>")
    return rows.withColumn("spans", F.when(F.size("ordered") > 0, shown).otherwise(none_shown)).drop("proposed", "more", "base", "scored", "chosen", "ordered")


def find(docs: DataFrame, selector: Selector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: ``(kind, start, end, score)``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return placed(rows, selector).select("doc_id", "spans")


def redact(docs: DataFrame, selector: Selector, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by ``[KIND]``; overlapping spans become one, named after the first."""
    rows = placed(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text")), selector)
    span = "struct<start: int, back: int, end: int, kind: string>"
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(held: Column, s: Column) -> tuple[Column, Column]:
        meets = F.coalesce(s["start"] < held["end"], F.lit(False))
        longer = F.struct(held["start"].alias("start"), held["back"].alias("back"), F.greatest(held["end"], s["end"]).alias("end"), held["kind"].alias("kind"))
        return F.when(meets, longer).otherwise(s), F.when(meets | held.isNull(), F.array().cast(f"array<{span}>")).otherwise(F.array(held))

    def merged(items: Column) -> Column:
        return once(sweep(items, F.lit(None).cast(span), step, span), lambda r: F.concat(r["out"], F.array(r["state"])))

    def cut(spans: Column) -> Column:
        def block(at: Column) -> Column:
            """The pieces of a block of spans, from the part of the text that it covers."""
            begin = F.coalesce(F.get(spans, at - 2)["end"], F.lit(0))
            own = F.struct(F.slice(spans, at, BLOCK).alias("spans"), begin.alias("begin"))

            def pieces(x: Column) -> Column:
                chunk = F.substring(F.col("text"), x["begin"] + 1, F.element_at(x["spans"], -1)["end"] - x["begin"])

                def piece(part: Column, s: Column, i: Column) -> Column:
                    last = F.coalesce(F.get(x["spans"], i - 1)["end"], x["begin"])
                    return F.concat(F.substring(part, last - x["begin"] + 1, s["start"] - last), F.lit("["), F.upper(s["kind"]), F.lit("]"))

                return once(chunk, lambda part: F.transform(x["spans"], lambda s, i: piece(part, s, i)))

            return once(own, pieces)

        every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), block))
        return F.array_join(F.concat(every, F.array(F.substring(F.col("text"), F.element_at(spans, -1)["end"] + 1, F.length("text")))), "")

    clean = F.when(F.size("spans") > 0, once(once(ordered, merged), cut)).otherwise(F.col("text"))
    return rows.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
