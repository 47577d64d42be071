"""Removal of repeated substrings by a distributed merge sort of suffixes (operator 7).

Every byte covered by a string of 400 bytes that also starts anywhere else is
removed.  Each such string has one sampled gram of 200 bytes, at a place that
depends on the string alone, so that only suffixes at sampled places matter:

1. Grams are counted over all texts; only places whose gram occurs again stay.
2. The strings that share a place make up a block of bytes.  Equal blocks are
   counted with partial sums; a block that occurs twice is repeated as a whole,
   however many copies there are.
3. For the blocks that occur once, beside others of the same gram, the suffixes
   at the sampled places are sorted in runs, front-coded and exchanged by gram.
   Each receiving task merges its runs with loser trees that never compare a
   known prefix again.  The merged order comes with the lengths of common
   prefixes; with those of the reversed bytes on the left they tell exactly
   which strings of a block occur elsewhere.
   Grams of over ``WIDE`` distinct blocks (a line that stands in very many texts,
   each time beside other text) would be too much for one task: the strings of
   their blocks are hashed and counted with partial sums instead.
4. Blocks and strings found go back to their texts, where spans are united.

Candidates are found by two 64-bit hashes, of gram and block; step 3 compares
bytes.  What one task holds is a share of the distinct blocks of repeated grams,
and at most ``WIDE`` of one gram.

Besides, ``passage`` says whether a text has a run of ``PASSAGE`` words in common
with another text, however few bytes it has.  It is true for every such run; a
shorter run of at least ``PASSAGE_GRAM`` words may be seen too.

Null texts are empty: nothing is removed.  Texts under 400 bytes lose nothing.
Rows that repeat an identifier and a text are copies of each other.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import joinable, settled
from stocktake.llm._lcp_merge import common, front_code, merge
from stocktake.llm._rows import by_group, groups, narrow, stream
from stocktake.llm._shingles import word_hashes
from stocktake.llm._winnow import GRAM, LENGTH, prefix_sums, sample, spans

#: Suffixes of a run, and roughly those that one merging task holds.
RUN, SHARE = 50_000, 20_000
#: Distinct blocks of one gram that are merged in one task.
WIDE = 5_000
#: Words of a passage, and of the part of it that is compared.
PASSAGE, PASSAGE_GRAM = 50, 35
#: Longer texts are sampled in pieces that overlap by one byte less than a string.
PIECE = 8_000_000


def blocks_of(raw: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Number of the text, gram, block hash, first start, distance to the gram, number of starts; in portions."""
    pieces = [(i, a, r[a : a + PIECE + LENGTH - 1]) for i, r in enumerate(raw) for a in range(0, max(1, len(r) - LENGTH + 1), PIECE)]
    held: list[tuple[int, int, bytes]] = []

    def portion() -> tuple[np.ndarray, ...]:
        ends = np.cumsum([len(p[2]) for p in held])
        sums = prefix_sums(np.frombuffer(b"".join(p[2] for p in held), np.uint8))
        place, gram, first, last = sample(sums, ends)
        at = np.searchsorted(ends, first, side="right")
        text, shift = np.array([p[0] for p in held])[at], np.array([p[1] for p in held])[at] - (ends - [len(p[2]) for p in held])[at]
        return text, gram.view(np.int64), spans(sums, first, last + LENGTH).view(np.int64), first + shift, place - first, last - first + 1

    size = 0
    for p in pieces:
        if len(p[2]) < LENGTH:
            continue
        if held and size + len(p[2]) > 1_000_000:
            yield portion()
            held, size = [], 0
        held.append(p)
        size += len(p[2])
    if held:
        yield portion()


def blocks(rows: DataFrame, grams_only: bool) -> DataFrame:
    """The blocks of all rows (``row``, ``text``): ``gram``, or ``row, gram, block, first, left, n``."""
    schema = pa.schema([("row", pa.int64()), ("gram", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("left", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("row").to_numpy(), batch.column("text").to_pylist()
            for a, b in groups(texts):
                for text, gram, block, first, left, n in blocks_of([t.encode() for t in texts[a:b]]):
                    if grams_only:
                        yield pa.RecordBatch.from_arrays([pa.array(gram)], names=["gram"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys[a + text], gram, block, first, left, n), schema, strict=True)], schema=schema)

    return stream(rows, run, "gram long" if grams_only else "row long, gram long, block long, first long, left int, n int")


def repeated(shared: list[int], lefts: list[bytes], first_a: list[int], counts: list[int]) -> list[np.ndarray]:
    """For blocks of one gram, in the order of their suffixes: which strings occur again.

    A string begins ``a`` bytes before the gram, ``a`` from ``first_a`` up to
    the length of the left side; ``shared`` are the common prefixes of
    neighbouring suffixes, ``counts`` the occurrences of the blocks.
    """
    v = len(lefts)
    out = [np.zeros(len(x) + 1, bool) for x in lefts]
    if v <= 12:
        for i in range(v):
            right = LENGTH
            for j in range(i + 1, v):
                right = min(right, shared[j])
                x, y = lefts[i], lefts[j]
                n = min(len(x), len(y))
                back = common(x[len(x) - n :][::-1], y[len(y) - n :][::-1], 0) if n else 0
                low = max(LENGTH - right, first_a[i], first_a[j])
                if low <= back:
                    out[i][low : back + 1] = True
                    out[j][low : back + 1] = True
        return out
    reversed_left = [x[::-1] for x in lefts]
    order = sorted(range(v), key=reversed_left.__getitem__)
    back = np.array([0, *(common(reversed_left[i], reversed_left[j], 0) for i, j in zip(order, order[1:], strict=False))])
    right, longest, least, times = np.array(shared), np.array([len(x) for x in lefts]), np.array(first_a), np.array(counts)
    place = np.empty(v, np.int64)
    for a in range(int(longest.max()) + 1):
        fits = np.flatnonzero((least <= a) & (a <= longest))
        if len(fits) < 2:
            continue
        by_right = np.cumsum(right < LENGTH - a)
        place[order] = np.cumsum(back < a)
        _, same = np.unique(by_right[fits] * v + place[fits], return_inverse=True)
        again = np.bincount(same, weights=times[fits])[same] >= 2
        for i in fits[again]:
            out[i][a] = True
    return out


def merged_blocks(rows: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """``gram, block, mask``: the strings that occur again of blocks that occur once.

    ``wanted`` has ``row, gram, block, times, first, left, n``.
    """
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "block", "times", "first", "left", "n")).alias("wanted"))
    # One of several equal rows gives the bytes.
    asked = rows.join(per_row, "row")
    ddl = "part int, run long, seq int, shared array<int>, rests array<binary>, lefts array<binary>, grams array<long>, blocks array<long>, times array<int>, firsts array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        held: dict[int, dict[int, tuple]] = defaultdict(dict)
        size, turn = 0, 0

        def runs() -> Iterator[pa.RecordBatch]:
            for part, entries in held.items():
                ordered = sorted(entries.values())
                shared, rests = front_code([e[0] for e in ordered])
                number = (context.partitionId() << 24) + turn
                for a in range(0, len(ordered), 1000):
                    some = ordered[a : a + 1000]
                    columns = ([part], [number], [a], [shared[a : a + 1000]], [rests[a : a + 1000]], [[e[1] for e in some]], [[e[2] for e in some]], [[e[3] for e in some]], [[e[4] for e in some]], [[e[5] for e in some]])
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "run", "seq", "shared", "rests", "lefts", "grams", "blocks", "times", "firsts"])

        for batch in batches:
            for text, want in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                raw = text.as_py().encode()
                for w in want:
                    at = w["first"] + w["left"]
                    entry = (raw[at : w["first"] + w["n"] - 1 + LENGTH], raw[w["first"] : at], w["gram"], w["block"], min(2, w["times"]), w["left"] - w["n"] + 1)
                    held[w["gram"] % parts][w["block"]] = entry
                    size += 1
                if size >= RUN:
                    yield from runs()
                    held.clear()
                    size, turn = 0, turn + 1
        yield from runs()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches, ["part"]):
            streams: dict[int, list[int]] = defaultdict(list)
            for i, number in enumerate(table.column("run").to_pylist()):
                streams[number].append(i)
            columns = [table.column(c) for c in ("shared", "rests", "lefts", "grams", "blocks", "times", "firsts")]

            def stream(at: list[int], columns: list = columns) -> Iterator[tuple[int, bytes, tuple]]:
                for i in at:
                    shared, rests, *loads = (c[i].as_py() for c in columns)
                    for h, rest, *load in zip(shared, rests, *loads, strict=True):
                        yield h, rest, tuple(load)

            found: list[tuple[int, int, bytes]] = []
            group: list[tuple[int, tuple]] = []

            def solve(group: list[tuple[int, tuple]], found: list[tuple[int, int, bytes]] = found) -> None:
                if len({load[2] for _, load in group}) < 2:
                    return
                shared, lefts, ids, times, firsts = [], [], [], [], []
                least, seen = LENGTH, set()
                for h, (left, gram, block, n, first_a) in group:
                    least = min(least, h)
                    if block in seen:  # sent by two tasks
                        continue
                    seen.add(block)
                    shared.append(least)
                    least = LENGTH
                    lefts.append(left)
                    ids.append((gram, block))
                    times.append(n)
                    firsts.append(first_a)
                for (gram, block), n, hit in zip(ids, times, repeated(shared, lefts, firsts, times), strict=True):
                    if n < 2 and hit.any():
                        # From the first start of the block on: the greatest distance comes first.
                        found.append((gram, block, np.packbits(hit[::-1]).tobytes()))

            for h, _, load in merge([stream(at) for at in streams.values()]):
                if h < GRAM:
                    solve(group)
                    group = []
                group.append((h, load))
            solve(group)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["gram", "block", "mask"])

    sent = stream(asked.select("text", "wanted"), cut, ddl)
    return stream(sent.repartition("part").sortWithinPartitions("part", "run", "seq"), join, "gram long, block long, mask binary")


def counted_blocks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """As ``merged_blocks``, by counting the strings of the blocks: nothing of one gram meets in one task."""
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "block", "times", "first", "left", "n")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, want in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                raw = text.as_py().encode()
                for w in want:
                    sums = prefix_sums(np.frombuffer(raw[w["first"] : w["first"] + w["n"] - 1 + LENGTH], np.uint8))
                    at = np.arange(w["n"])
                    hashes = spans(sums, at, at + LENGTH).view(np.int64)
                    same = [pa.array([w[k]] * w["n"], t) for k, t in (("gram", pa.int64()), ("block", pa.int64()), ("n", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([min(2, w["times"])] * w["n"], pa.int32()), pa.array(at.astype(np.int32)), pa.array(hashes)], names=["gram", "block", "n", "times", "at", "string"])

    # Equal rows send the same strings.
    strings = stream(rows.join(per_row, "row").dropDuplicates(["row"]).select("text", "wanted"), cut, "gram long, block long, n int, times int, at int, string long")
    again = joinable(strings.groupBy("gram", "string").agg(F.sum("times").alias("times")).where("times > 1").select("gram", "string"))
    hits = strings.where("times = 1").join(again, ["gram", "string"], "left_semi").groupBy("gram", "block", "n").agg(F.collect_set("at").alias("at"))
    bits = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / 8).cast("int") * 8 - 1), lambda i: F.when(F.array_contains("at", i), "1").otherwise("0"))
    mask = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / 8).cast("int") - 1), lambda b: F.lpad(F.conv(F.array_join(F.slice(bits, b * 8 + 1, F.lit(8)), ""), 2, 16), 2, "0")), ""))
    return hits.select("gram", "block", mask.alias("mask"))


def passages(rows: DataFrame) -> DataFrame:
    """``row`` of every text that has a run of words in common with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("row").to_numpy(), batch.column("text").to_pylist()
            for a, b in groups(texts):
                words, per_text = word_hashes([t.encode() for t in texts[a:b]])
                ends = np.cumsum(per_text)
                # Only a text that stands alone has more words than a piece.
                for at in range(0, max(1, len(words) - PASSAGE + 1), PIECE):
                    part = words[at : at + PIECE + PASSAGE - 1]
                    place, gram, _, _ = sample(prefix_sums(part), ends if len(part) == len(words) else np.array([len(part)]), PASSAGE, PASSAGE_GRAM)
                    own = keys[a:b][np.searchsorted(ends, place, side="right")]
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(own)], names=["gram", "row"])

    by_gram = stream(rows, run, "gram long, row long")
    shared = by_gram.groupBy("gram").agg(F.min("row").alias("low"), F.max("row").alias("top")).where("low <> top").select("gram")
    return by_gram.join(joinable(shared), "gram", "left_semi").select("row").distinct()


def repeated_places(texts: DataFrame) -> DataFrame:
    """The blocks whose gram occurs in another place too."""
    often = joinable(blocks(texts, grams_only=True).groupBy("gram").count().where("count > 1").select("gram"))
    return blocks(texts, grams_only=False).join(often, "gram", "left_semi")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, passage``: removed spans ``(start, end)`` in bytes, the bytes that are left, and whether a passage repeats."""
    rows = narrow(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    texts = rows.select("row", "text")
    marked = settled(passages(texts)).withColumn("passage", F.lit(True))
    places = settled(repeated_places(texts))
    variants = settled(places.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "first", "left", "n")).alias("at")).select("gram", "block", "times", "at.*"))
    open_grams = joinable(variants.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select("gram", "kinds"))
    wanted = variants.join(open_grams, "gram")
    n_wanted, n_wide = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("kinds") > WIDE).cast("long")), F.lit(0))).first()
    parts = max(8, -(-(n_wanted - n_wide) // SHARE))
    single = merged_blocks(texts, wanted.where(F.col("kinds") <= WIDE), parts)
    if n_wide:
        single = single.unionByName(counted_blocks(texts, wanted.where(F.col("kinds") > WIDE)))
    single = settled(single)
    decided = variants.where("times > 1").select("gram", "block", F.lit(None).cast("binary").alias("mask")).unionByName(single)
    # Rows that repeat identifier and text have one set of hits.
    per_row = places.join(decided, ["gram", "block"]).groupBy("row").agg(F.collect_set(F.struct("first", "n", "mask")).alias("hits"))
    joined = rows.join(per_row, "row", "left").join(marked, "row", "left").withColumn("passage", F.coalesce("passage", F.lit(False)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("passage", pa.bool_())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, every, hits = batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("hits").to_pylist()
            for a, b in groups(every):
                out: list[list] = [[], [], [], []]
                for text, hit in zip(every[a:b], hits[a:b], strict=True):
                    raw = text.encode()
                    cover = covered(hit or [])
                    kept, at = [], 0
                    for s, e in cover:
                        kept.append(raw[at:s])
                        at = e
                    kept.append(raw[at:])
                    for column, x in zip(out, (len(raw), sum(e - s for s, e in cover), [{"start": s, "end": e} for s, e in cover], b"".join(kept)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:-1], strict=True)), batch.column("passage").slice(a, b - a)], schema=schema)

    return stream(joined.select("doc_id", "text", "hits", "passage"), finish, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary, passage boolean")


def covered(hits: list[dict]) -> list[tuple[int, int]]:
    """The united spans of the repeated strings of a text, in bytes."""
    parts = []
    for h in hits:
        if h["mask"] is None:
            parts.append((h["first"], h["first"] + h["n"] - 1 + LENGTH))
        else:
            on = np.flatnonzero(np.unpackbits(np.frombuffer(h["mask"], np.uint8))[: h["n"]])
            cut = np.flatnonzero(np.diff(on) > 1)
            for s, e in zip(np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(on) - 1])), strict=True):
                parts.append((h["first"] + int(on[s]), h["first"] + int(on[e]) + LENGTH))
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
