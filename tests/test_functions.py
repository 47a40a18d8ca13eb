import pytest
from pyspark.sql import functions as F

from filelens.functions import sql
from filelens.functions.documents import logged_epoch, sidecar_payload
from filelens.functions.media import container_of, evidence, quality_score, verdict
from filelens.functions.names import parse_sidecar
from filelens.functions.paths import stem, suffix, volume_root
from filelens.functions.times import camera_clock, clock_epoch, is_legal_offset, offset_seconds, offset_text, zone_offset


def values(spark, expr, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr.alias("x")).collect()]


@pytest.mark.parametrize(
    ("name", "media", "counter", "truncated", "complete"),
    [
        ("IMG_1.jpg.supplemental-metadata.json", "IMG_1.jpg", None, False, True),
        ("IMG_1.jpg.supplemen.json", "IMG_1.jpg", None, True, True),
        ("DSC_0109.JPG.supplemental-metadata(9).json", "DSC_0109(9).JPG", "(9)", False, True),
        ("IMG_1.jpg..json", "IMG_1.jpg", None, True, True),
        ("IMG_1.jpg.json", "IMG_1.jpg", None, False, True),
        ("a-very-long-name-that-was-c.json", "a-very-long-name-that-was-c", None, False, False),
        (".json", None, None, False, False),
        ("notes.txt", None, None, False, False),
        ("x(2).json", "x(2)", "(2)", False, False),
    ],
)
def test_sidecar_names(spark, name, media, counter, truncated, complete):
    p = values(spark, parse_sidecar(F.col("n")), [(name,)], "n string")[0]
    assert (p.media_name, p.counter, p.truncated, p.stem_complete) == (media, counter, truncated, complete)
    assert (p.reason == "unparseable") == (media is None)


def test_path_parts(spark):
    names = [("a.b.jpg",), (".bashrc",), ("plain",), ("dot.",)]
    assert values(spark, suffix(F.col("n")), names, "n string") == [".jpg", "", "", ""]
    assert values(spark, stem(F.col("n")), names, "n string") == ["a.b", ".bashrc", "plain", "dot."]


def test_volume_roots(spark):
    rows = [("/run/media/u/disk/a/b",), ("/media/u/disk/x",), ("/mnt/stick",), ("/Volumes/One/a",), ("/home/u/x",), ("/run/media/u",)]
    assert values(spark, volume_root(F.col("p")), rows, "p string") == ["/run/media/u/disk", "/media/u/disk", "/mnt/stick", "/Volumes/One", None, None]
    sql.register(spark)
    assert spark.sql("SELECT volume_root('/mnt/a/b'), file_suffix('a.b'), is_legal_offset(18000)").first()[:] == ("/mnt/a", ".b", True)


def test_offsets(spark):
    rows = [("-06:00",), ("+05:45",), ("+09:75",), ("0600",), (None,), ("-00:30\0",)]
    assert values(spark, offset_seconds(F.col("o")), rows, "o string") == [-21600, 20700, None, None, None, None]
    assert values(spark, offset_seconds(F.col("o"), strict=False), rows, "o string") == [-21600, 20700, 36900, None, None, -1800]
    assert values(spark, offset_text(F.col("s")), [(-21600,), (20700,), (None,), (-1800,)], "s int") == ["-06:00", "+05:45", None, "-00:30"]
    assert values(spark, is_legal_offset(F.col("d")), [(18000.0,), (37530.0,), (50460.0,), (-3659.0,)], "d double") == [True, False, False, True]


def test_clocks_and_zones(spark):
    rows = [("2021:07:04 13:00:00",), ("2021:07:04 13:00:00\0",), ("0000:00:00 00:00:00",), (None,), ("junk",)]
    assert values(spark, clock_epoch(camera_clock(F.col("t"))), rows, "t string") == [1625403600, 1625403600, None, None, None]
    zones = [(1625421600, "America/Chicago"), (1641232800, "America/Chicago"), (1625421600, "Asia/Kathmandu"), (1625421600, None)]
    assert values(spark, zone_offset(F.col("e"), F.col("z")), zones, "e bigint, z string") == [-18000, -21600, 20700, None]


def test_containers(spark):
    atom = lambda size, kind, rest=b"": size.to_bytes(4, "big") + kind + rest
    cases = [
        (b"\xff\xd8\xff\xe0", "jpeg"),
        (b"\x89PNG\r\n\x1a\n", "png"),
        (b"GIF89a", "gif"),
        (b"RIFF\0\0\0\0WEBP", "webp"),
        (b"II\x2a\x00", "tiff"),
        (atom(24, b"ftyp", b"heic"), "heif"),
        (atom(20, b"ftyp", b"qt  "), "mov"),
        (atom(20, b"ftyp", b"isom"), "mp4"),
        (atom(8, b"wide") + atom(100, b"mdat"), "mov"),
        (atom(8, b"free") + atom(20, b"ftyp", b"mp42"), "mp4"),
        (atom(0, b"free") + atom(20, b"ftyp", b"mp42"), "unknown"),
        (atom(8, b"free") * 4 + atom(20, b"ftyp", b"mp42"), "unknown"),
        (atom(8, b"junk"), "unknown"),
        (b"", "unknown"),
    ]
    assert values(spark, container_of(F.col("c")), [(bytearray(c),) for c, _ in cases], "c binary") == [k for _, k in cases]


def test_score_and_verdict(spark):
    rows = [("/a/x.jpg", 1048576, 4000, 3000, True, None), ("/a/x", 0, None, None, None, None)]
    got = values(spark, quality_score(*[F.col(c) for c in "psxydg"]), rows, "p string, s bigint, x int, y int, d boolean, g boolean")
    assert got == [2 + 100 + 40 + 25, 20]
    rows = [("IMG_1.png", 1242, 2688, None, None), ("123456789012345678(1).jpg", 900, 900, None, None), ("a.jpg", 4000, 3000, "Canon", None), ("a.jpg", 4000, 3000, None, "Snapseed 2"), ("a.jpg", None, None, None, None)]
    ev = evidence(F.col("n"), F.col("w"), F.col("h"), F.col("make"), F.lit(None), F.col("soft"), F.lit(True), F.lit(None))
    got = values(spark, verdict(ev)["reason"], rows, "n string, w int, h int, make string, soft string")
    assert got == ["screenshot", "generated_filename", "camera_native", "app_rewritten", "no_pixels"]


def test_json_documents(spark):
    docs = [('{"photoTakenTime":{"timestamp":"1625421600"},"geoData":{"latitude":0,"longitude":0},"geoDataExif":{"latitude":1.5,"longitude":2}}',), ('{"creationTime":{"timestamp":"7"}}',), ("[1]",), ("{",), (None,)]
    got = values(spark, sidecar_payload(F.col("t")), docs, "t string")
    assert [g and tuple(g) for g in got] == [(1625421600, 1.5, 2.0), (7, None, None), None, None, None]
    logs = [('{"utc_epoch": 5}',), ('{"offered": {"utc_epoch": 6}}',), ('{"utc_epoch": 0}',), ("x",)]
    assert values(spark, logged_epoch(F.col("t")), logs, "t string") == [5, 6, None, None]
