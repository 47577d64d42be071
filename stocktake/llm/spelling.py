"""Spelling variants grouped by a relational trie frontier (operator 12).

All words are one trie, kept as a distributed edge table ``(node, ch, child)``
whose nodes are hashes of prefixes.  Two words are near if one edit leads from
the path of one to the path of the other.  The frontier has a state for each
pair of nodes one edit apart: ``own``, the node that the reading of a word has
come to, and ``other``, the node that the edited word has come to.  A word's
position is the depth of ``own``, so that one state stands for all words that
share the prefix read so far.  States without an edit are the nodes themselves
(both sides are at the same one); what leaves them are

* a replacement: two different children of a node, and
* an insertion: a node and one of its children.  The next letter of the own word
  must not be the inserted one, so that an insertion into a run of equal letters
  is taken at its end only.

A deletion is the insertion seen from the other word.  Thus each near pair has
exactly one state path.  Level by level both sides follow the edges of equal
letters, two equi-joins with the edge table; a state whose nodes are both ends
of words is a near pair.  A node has at most one edge a letter and a pair of words one
path, so that no key of these joins is hot.  After ``ROUNDS`` levels the states
that are left (those of words with an early edit and a long rest) are finished by one equi-join on the hash of
what remains of both words, so that the number of joins doesn't follow the longest word.  Hashes only propose: each pair is confirmed on the
words themselves.

A word's form is its most frequent near word, if that is at least twice as
frequent; the root follows forms by pointer doubling, a number of joins that is the
logarithm of the longest chain.

Words are counted over all whole texts.  Null texts have no words, a null
identifier counts as the empty string, repeated rows count as often as they
occur, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm._graph import settled, with_checkpoints
from stocktake.llm._rows import groups, stream
from stocktake.llm._shingles import _place, _unplace, mix

#: Levels that the frontier is followed letter by letter after the edit.
ROUNDS = 4
#: Rows of a partition of the tables that are joined again and again, so that small ones don't make many tasks.
ROWS = 200_000
#: Characters of words that are hashed at once.
AT_ONCE = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` code points and ``least_count`` occurrences.

    Runs of letters, A-Z in lower case.  Where ``one_in`` divides the crc32 of
    ``<identifier>:<run>``, the run loses the code point that the crc32 names.
    """
    # Shorter runs can't give a word, and a run of this length only if it stays whole.
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}+"), F.lit(0))
    every = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = every.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def prefix_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each letter of some words, one word after another: the node before and after it, the letter, its place, and a hash of what follows it."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    start = np.repeat(np.cumsum(size) - size, size)
    end = np.repeat(np.cumsum(size), size)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _place(len(codes)), dtype=np.uint64)))
    j = np.arange(len(codes))
    depth = j - start

    def node(upto: np.ndarray, deep: np.ndarray) -> np.ndarray:
        return mix((sums[upto] - sums[start]) * _unplace(start) + mix(deep.astype(np.uint64) + np.uint64(1)))

    tail = mix((sums[end] - sums[j + 1]) * _unplace(j + 1) + mix((end - j).astype(np.uint64)))
    return node(j, depth), node(j + 1, depth + 1), codes.astype(np.int32), depth.astype(np.int32), tail


def word_hash(words: list[str]) -> np.ndarray:
    """The node at which each (non-empty) word ends."""
    at = np.cumsum([len(w) for w in words]) - 1
    return prefix_hashes(words)[1][at].view(np.int64)


def hashed(words: DataFrame) -> DataFrame:
    """``words`` with the node ``at`` which each ends."""
    others = [c for c in words.columns if c != "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("word").to_pylist()
            for a, b in groups(every, AT_ONCE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("word"), *(part.column(c) for c in others), pa.array(word_hash(every[a:b]))], names=["word", *others, "at"])

    schema = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in ["word", *others])
    return stream(words.select("word", *others), run, f"{schema}, at long")


def _letters(words: DataFrame, names: list[str], ddl: str) -> DataFrame:
    """The named columns of :func:`prefix_hashes` (and ``last``, ``at``) for every letter of ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("word").to_pylist()
            for a, b in groups(every, AT_ONCE):
                node, child, ch, depth, tail = prefix_hashes(every[a:b])
                size = np.array([len(w) for w in every[a:b]], np.int64)
                ends = np.cumsum(size) - 1
                last = np.zeros(len(node), bool)
                last[ends] = True
                columns = {"node": node.view(np.int64), "child": child.view(np.int64), "ch": ch, "depth": depth, "tail": tail.view(np.int64), "last": last, "at": np.repeat(child[ends], size).view(np.int64)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in names], names=names)

    return stream(words.select("word"), run, ddl)


def edge_table(words: DataFrame) -> DataFrame:
    """``node, ch, child, depth, last``: the trie; ``last`` tells that a word ends at the child."""
    every = _letters(words, ["node", "ch", "child", "depth", "last"], "node long, ch int, child long, depth int, last boolean")
    return every.groupBy("node", "ch", "child", "depth").agg(F.max("last").alias("last"))


def _parts(rows: int) -> int:
    return rows // ROWS + 1


def _merged(df: DataFrame) -> DataFrame:
    """For a join by sorting: the tables grow with the corpus, and small ones, broadcast in every level, fill the driver."""
    return df.hint("merge")


def neighbours(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of near words of ``words`` (``word, n``) once, in either order."""
    n_words = words.count()
    named = with_checkpoints(hashed(words.select("word", "n").coalesce(_parts(n_words))))
    # A trie has a few edges for each word.
    edges = with_checkpoints(edge_table(named).coalesce(_parts(4 * n_words)))
    one, two = (edges.select("node", F.col("ch").alias(f"ch_{s}"), F.col("child").alias(s), F.col("last").alias(f"last_{s}")) for s in ("own", "other"))
    none = F.lit(-1)
    replaced = one.join(_merged(two), "node").where("ch_own < ch_other").select("own", "other", none.alias("bar"), (F.col("last_own") & F.col("last_other")).alias("near"))
    # The node itself is the end of a word if an edge into it says so.
    ends = edges.where("last").select("child").distinct().withColumn("is_end", F.lit(True))
    inserted = edges.join(_merged(ends.withColumnRenamed("child", "node")), "node", "left").select(F.col("node").alias("own"), F.col("child").alias("other"), F.col("ch").alias("bar"), (F.col("last") & F.coalesce("is_end", F.lit(False))).alias("near"))
    states = settled(replaced.unionByName(inserted))
    n = states.count()
    found = [states.where("near").select("own", "other")]
    for level in range(ROUNDS):
        # After so many levels no node is less deep.
        deep = edges.where(F.col("depth") >= level)
        on_own = deep.select(F.col("node").alias("own"), "ch", F.col("child").alias("to_own"), F.col("last").alias("last_own"))
        on_other = deep.select(F.col("node").alias("other"), "ch", F.col("child").alias("to_other"), F.col("last").alias("last_other"))
        moved = states.join(_merged(on_own), "own").where("ch <> bar").join(_merged(on_other), ["other", "ch"])
        moved = moved.select(F.col("to_own").alias("own"), F.col("to_other").alias("other"), none.alias("bar"), (F.col("last_own") & F.col("last_other")).alias("near"))
        # Mostly a level has fewer states than the one before.  What the driver holds of a level goes with it.
        states = settled(moved.coalesce(_parts(n)))
        n = states.count()
        if not n:
            break
        found.append(states.where("near").select("own", "other"))
    else:
        # What is left of both must be equal, and more than nothing; no node is less deep than the rounds.
        rest = _letters(named.where(F.length("word") > ROUNDS), ["child", "tail", "at", "last", "depth"], "child long, tail long, at long, last boolean, depth int").where((F.col("depth") >= ROUNDS - 1) & ~F.col("last"))
        mine = states.join(_merged(rest.select(F.col("child").alias("own"), "tail", F.col("at").alias("at_own"))), "own")
        yours = states.join(_merged(rest.select(F.col("child").alias("other"), "tail", F.col("at").alias("at_other"))), "other").select("own", "other", "tail", "at_other")
        found.append(mine.join(_merged(yours), ["own", "other", "tail"]).select(F.col("at_own").alias("own"), F.col("at_other").alias("other")))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    left, right = named.select(F.col("at").alias("own"), F.col("word").alias("a"), F.col("n").alias("n_a")), named.select(F.col("at").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    both = pairs.join(_merged(left), "own").join(_merged(right), "other")
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``, where a form is never the word's own descendant: each step doubles the distance looked ahead."""
    parts = _parts(forms.count())
    now = with_checkpoints(forms.select("word", F.col("form").alias("root")).coalesce(parts))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = with_checkpoints(now.join(_merged(ahead), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")).coalesce(parts))
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n``; a form is at least ``times`` as frequent as the word."""
    pairs = neighbours(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    rows = words.select("word", "n").join(_merged(best), "word", "left")
    good = -F.col("best.less") >= times * F.col("n")
    rows = settled(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")))
    out = rows.join(_merged(roots(rows.where(F.col("form").isNotNull()))), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all texts."""
    return grouped(with_checkpoints(count_words(docs, least_length, least_count, one_in, id_col, text_col)))
