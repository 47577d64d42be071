import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stocktake.functions import globs, scalars
from stocktake.functions.digests import crc64nvme_value

CASES = [
    ("*", "a", True), ("*", "a/b", False), ("*", "", False), ("**", "a/b", True), ("**", "", True), ("a/**", "a", False), ("a/**", "a/b/c", True), ("**/x", "x", True), ("**/x", "a/b/x", True),
    ("a/**/b", "a/b", True), ("a/**/b", "a/c/d/b", True), ("a/**/**/b", "a/b", True), ("*.txt", ".txt", True), ("*.txt", "a.TXT", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[abc]", "b", True), ("[!abc]", "b", False),
    ("[^abc]", "d", True), ("[!a]", "/", False), ("[a-c]x", "bx", True), ("{a,b}.txt", "b.txt", True), ("{a,{b,c}}/x", "c/x", True), ("{a}", "{a}", True), (r"\*", "*", True), (r"\*", "a", False), ("!a", "!a", True), ("#a", "#a", True),
    ("a+(b)", "a+(b)", True), ("a|b", "a|b", True), ("a.b", "axb", False), ("a**b", "axxb", True), ("a**b", "a/b", False), ("ab\n", "ab", False), ("*", "a\nb", True), ("é*", "éa", True),
]


def test_globs(spark):
    rows = spark.createDataFrame([(i, p) for i, (_, p, _) in enumerate(CASES)], "i int, path string")
    found = rows.select("i", *(globs.matches("path", g).alias(str(k)) for k, (g, _, _) in enumerate(CASES))).orderBy("i").collect()
    assert [r[str(r["i"])] for r in found] == [w for _, _, w in CASES]


@pytest.mark.parametrize(("pattern", "prefix"), [("Photos/**", "Photos"), ("a/b?/c.jpg", "a"), ("{a,b}/x.jpg", ""), ("*", ""), ("a/b/c*", "a/b")])
def test_literal_prefix(pattern, prefix):
    assert globs.literal_prefix(pattern) == prefix


def test_is_glob():
    assert [globs.is_glob(x) for x in ("a*", "a?", "[a]", "{a,b}", "a")] == [True, True, True, False, False]


def test_crc():
    assert crc64nvme_value(b"123456789") == 0xAE8B14860A799888
    assert crc64nvme_value(b"") == 0


def test_scalars(spark):
    one = spark.range(1)
    fit = lambda w, h, bw, bh: tuple(one.select(F.inline(F.array(scalars.contain_fit(*map(F.lit, (w, h, bw, bh)))))).first())
    assert fit(201, 100, 100, 100) == (201, 100)
    assert fit(200, 100, 100, 100) == (100, 50)
    assert fit(100, 200, 100, 50) == (50, 100)
    assert fit(1, 1000, 100, 100) == (100, 100000)
    got = one.select(
        scalars.half_up(F.lit(-2.5)).alias("a"), scalars.encrypted_size(F.lit(0)).alias("b"), scalars.encrypted_size(F.lit(4194305)).alias("c"), F.size(scalars.byte_ranges(F.lit(0).cast("long"), 5)).alias("d"),
        scalars.byte_ranges(F.lit(11).cast("long"), 5).alias("e"), scalars.parse_tagged_hash(F.lit("x:y:z")).alias("f"), scalars.jpeg_scale(F.lit(100)).alias("g"), scalars.jpeg_scale(F.lit(1)).alias("h"),
        scalars.restore_expiry(F.lit('ongoing-request="false", expiry-date="Wed, 01 Jul 2026 00:00:00 GMT"')).alias("i"), scalars.rotation_swaps(F.lit(-90)).alias("j"), scalars.remote_key(F.lit("//"), F.lit("k")).alias("k"),
        scalars.mime_matches(F.lit("image/*"), F.lit("image/png")).alias("l"), scalars.mime_matches(F.lit("image/*"), F.lit("video/png")).alias("m"), scalars.collision_key(F.lit("ÀB")).alias("n"), scalars.dirname(F.lit("a/b/c")).alias("o"), scalars.dirname(F.lit("c")).alias("p"),
    ).first()
    assert (got.a, got.b, got.c, got.d) == (-2, 50, 50 + 4194305 + 32, 0)
    assert [tuple(r) for r in got.e] == [(1, 0, 4), (2, 5, 9), (3, 10, 10)]
    assert (tuple(got.f), got.g, got.h, got.i, got.j, got.k, got.l, got.m, got.n, got.o, got.p) == (("x", "y:z"), 2, 31, datetime(2026, 7, 1), True, "k", True, False, "àb", "a/b", "")


def test_stamp_and_backoff():
    assert re.fullmatch(r"\d{8}T\d{9}Z-[0-9a-f]{8}", scalars.version_stamp())
    assert [scalars.backoff_ms(n, 1.0) for n in (1, 2, 7, 20)] == [500, 1000, 30000, 30000]
    assert scalars.backoff_ms(1, 0.0) == 250


def test_media(spark):
    from stocktake.functions import media

    video = '{"streams": [{"width": 640, "height": 480, "duration": "N/A", "side_data_list": [{}, {"rotation": -90}], "tags": {"rotate": "180"}}], "format": {"format_name": "mov,mp4", "duration": "2.5"}}'
    rows = spark.createDataFrame([("PNG|10|20\nrest", None), ("MPEG|1|1", video), ("PNG|x|1", "{}"), (None, "nonsense")], "i string, v string")
    got = [tuple(r[0]) for r in rows.select(media.probed("i", "v")).collect()]
    assert got == [("image", "image/png", 10, 20, None), ("video", "video/mp4", 480, 640, 2.5), ("unreadable", None, None, None, None), ("unreadable", None, None, None, None)]
