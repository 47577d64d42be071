"""Benchmark decontamination by template canonicalisation (operator 3).

Texts become sequences of typed tokens: numbers (in digits or English words,
a run of them being one) turn into one placeholder, units of measure into
another, names (capitalised words inside a sentence) into a third; all other
words are lower-cased and stripped of punctuation.  Windows of eight tokens of
the benchmark and of the documents are joined by their hash.  Each match
brings its slots, the words behind the placeholders on both sides: along one
alignment of a document and an item, equal slots of the item must stand
against equal slots of the document, so that a re-parameterised question is
caught and a chance agreement of templates is not.  Because a capital letter
may be lost in a copy, windows are also made with names kept as words.

A document is contaminated if consistent matches cover at least half of an
item's tokens, or ``RUN`` of them in a row.  Items of three to seven tokens are
one window of their own length; shorter ones, which any text may hold by chance,
match whole lines alone.  A template
must hold at least four plain words, or three in an item of four, or be all
plain.  Other windows, and items of up to three tokens, match only with the same
numbers and units, so that copies of them are found and chance templates not.

Matching windows are found on the document's side before the join: the hashes
of the benchmark's windows are broadcast while they number at most
``BROADCAST_WINDOWS``; beyond, all windows of the documents are shuffled, and
either way all of them are matched.

Null and empty texts match nothing; rows that share an identifier are judged
together; an empty benchmark or document table gives no match; other columns
are kept by ``decontaminate`` and ignored by ``leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import with_checkpoints
from stocktake.llm._rows import free, groups, narrow, stream
from stocktake.llm._shingles import mix, word_hashes

WIDTH = 8
#: Tokens that a window anywhere in a text needs.
SHORTEST = 3
#: Plain words that a template needs, unless all its tokens are plain.
PLAIN = 4
#: Covered tokens in a row that are enough, whatever their share of a long item.
RUN = 50
#: At about 200 bytes with its slots, a window more or less: 40 MB.
BROADCAST_WINDOWS = 200_000

# Number words and units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes pound pounds ounce ounces ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees mph kmh watt watts volt volts joule joules"
).split()
#: What stands for a number, a unit and a name; the first is unused.
_CODES = mix(np.array([100, 101, 102, 103], np.uint64))

#: Everything but letters and digits of ASCII, and bytes of other characters, separates words.
_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_NAME = re.compile(r"(?<=[^\W\d_] |[,;:] )[A-ZÀ-ÖØ-Þ](?=[^\W\d_])")
_MARK = "\ue0f1"


def _hash_words(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes([" ".join(words).encode()])[0])


_NUMBERS, _UNITS = _hash_words(NUMBER_WORDS), _hash_words(UNITS)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts: kind (0 plain, 1 number, 2 unit, 3 name), hash of the word, and each text's number of tokens.

    The last array says where a name stands, its kind being plain in the
    others' sense, so that both readings can be made.
    """
    # A text's own mark becomes its neighbour, in items and documents alike.
    raw = [_NAME.sub(lambda m: m[0] + _MARK, t.replace(_MARK, "\ue0f2")).lower().encode().translate(_SEPARATE) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    # The mark of a name is a private-use character right after its first letter.
    mark = np.frombuffer(_MARK.encode(), np.uint8)
    at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.zeros(0, np.int64)
    keep = np.ones(len(data), bool)
    for k in range(3):
        keep[at + k] = False
    place = np.cumsum(keep) - 1
    bare = data[keep].tobytes()
    ends = np.cumsum([len(r) + 1 for r in raw])
    ends = place[ends - 1] + 1
    pieces = [bare[a : b - 1] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    hashes, per_text = word_hashes(pieces)
    clean = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    inside = clean != 32
    first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    digit = np.concatenate(([0], np.cumsum((clean >= 48) & (clean <= 57))))
    last = np.concatenate((first[1:], [len(clean)])) if len(first) else first
    kind = np.zeros(len(first), np.int8)
    kind[_among(hashes, _UNITS)] = 2
    kind[(digit[last] > digit[first]) | _among(hashes, _NUMBERS)] = 1
    named = np.zeros(len(first), bool)
    if len(at) and len(first):
        named[np.searchsorted(first, place[at - 1], side="right") - 1] = True
    return kind, hashes, per_text, named & (kind == 0)


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Typed tokens of all texts, one after another: kind, hash of the word, hash of the value, number of the text."""
    kind, hashes, per_text, named = tokens(texts)
    kind = np.where(named, 3, kind).astype(np.int8)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    if not len(kind):
        return kind, hashes, hashes, owner
    # A run of numbers is one token; its value is that of the run.
    head = np.ones(len(kind), bool)
    head[1:] = ~((kind[1:] == 1) & (kind[:-1] == 1) & (owner[1:] == owner[:-1]))
    starts = np.flatnonzero(head)
    value = np.add.reduceat(mix(hashes + (np.arange(len(hashes)) - starts[np.cumsum(head) - 1]).astype(np.uint64)), starts)
    return kind[head], hashes[head], value, owner[head]


_WINDOWS = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("reading", pa.int32()), ("at", pa.int32()), ("width", pa.int32()), ("slots", pa.list_(pa.int64()))])
_WINDOWS_DDL = "id long, hash long, reading int, at int, width int, slots array<long>"


def windows_of(ids: list, texts: list[str], width: int, only: np.ndarray | None, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Windows of ``width`` tokens of some texts; ``only``: those of these hashes; ``whole``: of texts of just so many tokens.

    Reading 0 keeps names as words; reading 1 has them as slots, and only the
    windows that hold one; reading 2 has no slots, and only the windows that
    are no templates in reading 0.
    """
    kind, word, value, owner = sequence(texts)
    n = len(kind) - width + 1
    if n <= 0:
        return
    inside = owner[:n] == owner[width - 1 :]
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    if whole:
        inside &= np.diff(begin)[owner[:n]] == width
    names = np.concatenate(([0], np.cumsum(kind == 3)))
    for reading in (0, 1, 2):
        slot = kind > 0 if reading == 1 else (kind == 1) | (kind == 2)
        token = value if reading == 2 else np.where(slot, _CODES[kind], word)
        h = mix(token[:n])
        for k in range(1, width):
            h = mix(h * np.uint64(3) + token[k : k + n])
        h = mix(h + np.uint64(width + 100 * (reading == 2)))
        before = np.concatenate(([0], np.cumsum(slot)))
        slots = before[width:] - before[:-width]
        good = (slots == 0) | (width - slots >= min(PLAIN, width - 1))
        if width <= SHORTEST:
            good[:] = False
        if reading == 1:
            good &= names[width:] > names[:-width]
        elif reading == 2:
            good = ~good
            slot, slots, before = np.zeros(len(kind), bool), np.zeros_like(slots), np.zeros_like(before)
        good &= inside
        at = np.flatnonzero(good)
        if only is not None:
            at = at[_among(h[at], only)]
        values = value[slot].view(np.int64)
        for a in range(0, len(at), 50_000):
            part = at[a : a + 50_000]
            sizes = slots[part]
            ends = np.cumsum(sizes)
            flat = np.arange(ends[-1]) + np.repeat(before[part] - (ends - sizes), sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values[flat]))
            texts_of = owner[part]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in texts_of], pa.int64()), pa.array(h[part].view(np.int64)), pa.array(np.full(len(part), reading, np.int32)), pa.array((part - begin[texts_of]).astype(np.int32)), pa.array(np.full(len(part), width, np.int32)), lists], schema=_WINDOWS)


def template_table(texts: DataFrame, widths: list[int], only: np.ndarray | None = None, benchmark: bool = False) -> DataFrame:
    """Windows of all rows (``doc_id``, ``text``); of a benchmark, those under ``WIDTH`` are whole items, and of documents, those under ``SHORTEST`` whole lines."""
    held = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, every = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in groups(every):
                for width in widths:
                    own, texts_ = ids[a:b], every[a:b]
                    if lines := not benchmark and width < SHORTEST:
                        told = [(i, line) for i, t in zip(own, texts_, strict=True) for line in t.split("\n")]
                        own, texts_ = [i for i, _ in told], [line for _, line in told]
                    yield from windows_of(own, texts_, width, None if held is None else held.value, lines or benchmark and width < WIDTH)

    return stream(texts, run, _WINDOWS_DDL)


def leaks(docs: DataFrame, benchmark: DataFrame, least_cover: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least_run: int = RUN) -> DataFrame:
    """``doc_id, item_id, cover``: the items that a document contains, and the share of their tokens."""
    widths = [WIDTH, *range(1, WIDTH)]
    items = with_checkpoints(template_table(narrow(benchmark, item_id_col, item_text_col), widths, benchmark=True).withColumnRenamed("id", "item_id"))
    counts = {r[0]: r[1] for r in items.groupBy("width").count().collect()}
    n_windows = sum(counts.values())
    small = n_windows <= BROADCAST_WINDOWS
    only = np.unique(np.array([r[0] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64)) if small else None
    found = template_table(narrow(docs, id_col, text_col), sorted(counts), only)
    side = items.withColumnRenamed("at", "item_at").withColumnRenamed("slots", "item_slots").drop("width", "reading")
    pairs = found.join(F.broadcast(side) if small else side, "hash").where(F.size("slots") == F.size("item_slots"))
    line = ["id", "item_id", "reading", (F.col("at") - F.col("item_at")).alias("line")]
    # Both sets are bounded by the length of the item: along a line each place of it occurs once.
    lines = pairs.select(*line, "item_at", "width", F.arrays_zip(F.col("item_slots").alias("of_item"), F.col("slots").alias("of_doc")).alias("against"))
    slots = lines.groupBy("id", "item_id", "reading", "line").agg(F.collect_set(F.struct(F.col("item_at").alias("at"), "width")).alias("places"), F.array_distinct(F.flatten(F.collect_set("against"))).alias("against"))
    consistent = F.size("against") == F.size(F.array_distinct(F.transform("against", lambda x: x["of_item"])))
    good = slots.where(consistent).groupBy("id", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    lengths = items.groupBy("item_id").agg(F.max(F.col("at") + F.col("width")).alias("tokens"))
    token_places = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["width"] - 1))))
    covered = good.join(lengths, "item_id").withColumn("at", F.array_sort(token_places)).withColumn("cover", F.size("at") / F.col("tokens"))
    # A token starts a run of ``least_run`` if the one ``least_run - 1`` places on is just so much greater.
    in_a_row = F.exists(F.transform("at", lambda x, i: F.coalesce(F.get("at", i + (least_run - 1)) - x == least_run - 1, F.lit(False))), lambda hit: hit)
    return covered.where((F.col("cover") >= least_cover) | in_a_row).select(F.col("id").alias("doc_id"), "item_id", "cover")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, items`` (sorted) for every contaminated document."""
    return leaks(docs, benchmark, **options).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("cover").alias("cover"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    name = free("_bad", docs)
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(name))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")
