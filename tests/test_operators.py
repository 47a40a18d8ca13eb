import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from filelens import schema
from filelens.functions import times
from filelens.operators import capture, changes, dedup, folder, ingest, match, offers, reports
from filelens.sources import archive, exif, listing, lookups, ranges, records
from filelens.storage import stored
from filelens.streaming import ingest as streams
from filelens.streaming import matching


def bind(spark, name, names):
    s = spark.createDataFrame([(1, "d", name)], "seq long, dir string, name string")
    m = spark.createDataFrame([("d", n, i) for i, n in enumerate(names)], "dir string, name string, pos long")
    r = match.match_sidecars(s, m).first()
    return r.media_name, r.fuzzy, r.reason, r.candidate_count


@pytest.mark.parametrize(
    ("name", "names", "expected"),
    [
        ("IMG_1.jpg.json", ["IMG_1.jpg"], ("IMG_1.jpg", False, None, 0)),
        ("img_1.JPG.json", ["IMG_1.jpg", "img_1.jpg"], ("img_1.jpg", False, None, 0)),
        ("DSC_0109.JPG.supplemental-metadata(9).json", ["DSC_0109(9).JPG", "DSC_0109.JPG"], ("DSC_0109(9).JPG", False, None, 0)),
        ("DSC_0109.JPG.supplemental-metadata(1).json", ["DSC_0109.JPG"], (None, False, "no_media_in_dir", 0)),
        ("a-long-picture-na.json", ["a-long-picture-name.jpg"], ("a-long-picture-name.jpg", True, None, 1)),
        ("a-long-picture-na.json", ["a-long-picture-name.jpg", "a-long-picture-nase.jpg"], (None, False, "ambiguous", 2)),
        ("a-long-picture-name.json", ["a-long-picture-name.jpg", "a-long-picture-namex.mov"], ("a-long-picture-name.jpg", True, None, 2)),
        ("short.json", ["short1.jpg"], (None, False, "no_media_in_dir", 0)),
        ("x.txt", ["x.jpg"], (None, False, "unparseable", 0)),
    ],
)
def test_matching(spark, name, names, expected):
    assert bind(spark, name, names) == expected


def test_winner_ties_keep_row_order(spark):
    rows = [(1, "/a/x.jpg", 10, "d"), (2, "/a/y.jpg", 10, "d"), (3, "/a/z.png", 10, "e")]
    files = spark.createDataFrame(rows, "seq long, path string, size long, digest_full string")
    files = files.withColumns({c: F.lit(None).cast(t) for c, t in (("width", "int"), ("height", "int"), ("has_exif_date", "boolean"), ("has_exif_gps", "boolean"))})
    assert [tuple(r) for r in dedup.winners(files).select("winner_path", "members", "wasted").collect()] == [("/a/x.jpg", 2, 10)]
    assert dedup.winners(files.limit(0)).count() == 0


def test_upsert_publish_and_conform(spark, tmp_path):
    cur = spark.createDataFrame([("a", 1, "t"), ("b", 2, None)], "path string, size long, title string")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "path string, size long, change_seq long")
    out = changes.merge_upsert(cur, new, ["path"], ["size"], "change_seq")
    assert {r.path: (r.size, r.title) for r in out.collect()} == {"a": (1, "t"), "b": (6, None), "c": (7, None)}
    root = f"file://{tmp_path}"
    changes.publish(cur, root, "files")
    changes.publish(out, root, "files")
    assert changes.current(spark, root, "files").count() == 3
    old = spark.createDataFrame([(1, "a")], "seq long, path string")
    assert set(changes.conform(old, schema.FILES).columns) == set(schema.FILES.fieldNames())
    # A unit of work whose second table fails leaves both as they were.
    with pytest.raises(Exception, match="no good"):
        changes.publish_all({"files": cur, "other": cur.withColumn("x", F.raise_error(F.lit("no good")))}, root)
    assert changes.current(spark, root, "files").count() == 3
    with pytest.raises(Exception, match="out of domain"):
        changes.pending_once(
            spark.createDataFrame([], "file_path string, field string, value string, applied_at timestamp"),
            spark.createDataFrame([("p", "date", "1", "weird", 1)], "file_path string, field string, value string, state string, offer_seq long"),
            "offer_seq",
        ).collect()


def test_offers_in_either_order(spark):
    t = spark.createDataFrame([("j", "jpeg", True, False, False, 0.0), ("m", "mp4", True, None, None, 5.0)], "target string, container string, exif_ok boolean, has_date boolean, has_gps boolean, mtime double")
    o = spark.createDataFrame([("j", "date", 9, 1, True), ("j", "date", 8, 2, False), ("m", "date", 5, 3, False), ("m", "date", 6, 4, False), ("m", "gps", 1, 5, False), ("gone", "date", 1, 6, False)], "target string, field string, value long, offer_seq long, assumed boolean")
    got = {r.offer_seq: (r.state, r.reason) for r in offers.evaluate_offers(o, t).collect()}
    assert got == {1: ("merged", "tz_unknown_assumed_utc"), 2: ("already_present", None), 3: ("already_present", None), 4: ("merged_mtime_only", "unsupported_mp4"), 5: ("deferred", "unsupported_mp4")}


def test_name_allocation(spark):
    w = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "a(1).jpg"), (4, "b")], "ordinal long, name string")
    taken = spark.createDataFrame([("a.jpg",), ("b",), ("b(2)",)], "name string")
    got = {r.ordinal: r.given for r in ingest.settle(w, taken, lambda df: stored(df, "names")).collect()}
    assert got == {1: "a(1).jpg", 2: "a(2).jpg", 3: "a(1)(1).jpg", 4: "b(1)"}
    asked = [(1, "a(1).jpg"), (2, "a.jpg"), (3, "a.jpg"), (4, "a.jpg"), (5, "c.jpg"), (6, "d.jpg")]
    taken = spark.createDataFrame([("c(0).jpg",), ("d(01).jpg",), ("d.jpg",)], "name string")
    got = {r.ordinal: r.given for r in ingest.settle(spark.createDataFrame(asked, "ordinal long, name string"), taken, lambda df: stored(df, "names")).collect()}
    assert got == {1: "a(1).jpg", 2: "a.jpg", 3: "a(2).jpg", 4: "a(3).jpg", 5: "c.jpg", 6: "d(1).jpg"}


def test_volume_guard(spark):
    files = spark.createDataFrame([("/mnt/a/x",), ("/home/y",)], "path string")
    with pytest.raises(RuntimeError, match="/mnt/a"):
        reports.require_volumes(files, spark.createDataFrame([], "volume string"))
    reports.require_volumes(files, spark.createDataFrame([("/mnt/a",)], "volume string"))


def test_sibling_window_edges(spark):
    w = spark.createDataFrame([(1, "d", 100_000), (2, "d", 200_000)], "id long, dir string, epoch long")
    s = spark.createDataFrame([("d", 100_000 + 43200, 3600), ("d", 200_000 - 43201, 3600), ("e", 100_000, 0)], "dir string, epoch long, offset int")
    # 43200 seconds apart counts, 43201 doesn't; 200000 - 43201 is too far from 100000 as well.
    assert {r.id: r.sibling_offset for r in capture.sibling_offsets(w, s).collect()} == {1: 3600}


def test_listing_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / ".hidden").write_bytes(b"")
    (tmp_path / "a.jpg").write_bytes(b"xy")
    for depth in (1, 2, 3):
        found = {r.path: (r.size, r.error) for r in listing.list_files(spark, str(tmp_path), depth).collect()}
        assert found == {str(tmp_path / "a.jpg"): (2, None), str(tmp_path / "sub" / ".hidden"): (0, None)}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.jpg.json").write_bytes(b"{}")
    (tmp_path / "b" / "c.jpg").write_bytes(b"1")
    everything = listing.list_files(spark, str(tmp_path))
    assert [r.path[len(str(tmp_path)) :] for r in listing.in_walk_order(everything).collect()] == ["/a.jpg", "/b/c.jpg", "/b/c.jpg.json", "/sub/.hidden"]
    media = everything.filter("NOT path LIKE '%.json'")
    assert [tuple(r) for r in listing.beside(media, everything).collect()] == [(str(tmp_path / "b" / "c.jpg"), str(tmp_path / "b" / "c.jpg.json"))]
    (tmp_path / "b" / "c.jpg.json").unlink()
    (tmp_path / "b" / "c.jpg").unlink()
    with pytest.raises(Exception, match="is not there|No such file"):
        listing.list_files(spark, str(tmp_path / "nowhere")).collect()
    kept = listing.list_files(spark, str(tmp_path)).filter(listing.outside(F.col("path"), [str(tmp_path / "sub")]))
    assert kept.count() == 1
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("Takeout/x.jpg", b"\xff\xd8\xff")
        z.writestr("Takeout/x.jpg.json", json.dumps({"creationTime": {"timestamp": "9"}}))
        z.writestr("Takeout/bad.json", b"\xff\xfe")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    e = archive.read_entries(spark, str(tmp_path / "*.zip"), step=2)
    rows = e.orderBy("archive_path", "ordinal").collect()
    assert [r.entry_path for r in rows] == [None, "Takeout/x.jpg", "Takeout/x.jpg.json", "Takeout/bad.json"]
    assert rows[0].error.startswith("unreadable")
    assert archive.read_entries(spark, str(tmp_path / "t.zip"), content=False).columns == ["archive_path", "ordinal", "entry_path", "size", "error"]
    docs = {r.entry_path: (r.reason, r.payload and r.payload.utc_epoch) for r in records.sidecar_records(e.filter("entry_path LIKE '%.json'")).collect()}
    assert docs == {"Takeout/x.jpg.json": (None, 9), "Takeout/bad.json": ("unparseable", None)}
    assert {r.archive_path[-10:]: r.entries for r in archive.entry_counts(e).collect()} == {"broken.zip": 0, str(tmp_path / "t.zip")[-10:]: 3}
    known = e.filter("entry_path = 'Takeout/x.jpg'").select("archive_path", "entry_path")
    assert sorted(r.entry_path for r in archive.skip_known(e.filter("entry_path IS NOT NULL"), known).collect()) == ["Takeout/bad.json", "Takeout/x.jpg.json"]
    data = bytearray((tmp_path / "t.zip").read_bytes())
    data[data.index(b"\xff\xd8\xff")] ^= 1  # the stored bytes of one entry no longer fit its checksum
    (tmp_path / "t.zip").write_bytes(bytes(data))
    hurt = {r.entry_path: (r.error, r.content) for r in archive.read_entries(spark, str(tmp_path / "t.zip")).collect()}
    assert hurt["Takeout/x.jpg"] == ("corrupt", None) and hurt["Takeout/x.jpg.json"][0] is None


def test_exif_tags(spark):
    text = b"2021:07:04 13:00:00\0"
    tiff = b"II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (0x9003).to_bytes(2, "little") + (2).to_bytes(2, "little") + len(text).to_bytes(4, "little") + (26).to_bytes(4, "little") + b"\0\0\0\0" + text
    body = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"
    df = spark.createDataFrame([("a", bytearray(jpeg)), ("b", bytearray(b"nothing")), ("c", None)], "path string, content binary")
    got = {r.path: (r.readable, r.date_original) for r in exif.exif_tags(df).collect()}
    assert got == {"a": (True, "2021:07:04 13:00:00"), "b": (False, None), "c": (False, None)}


OFFER = "target string, field string, value long, offer_seq long, lat double, lon double"
TARGET = "target string, container string, exif_ok boolean, has_date boolean, has_gps boolean, mtime double"


def start_offers(spark, root):
    empty = {
        "log": "seq long, target_path string, source_desc string, field string, value string, merge_time timestamp",
        "pending": "seq long, file_path string, field string, value string, reason string, state string, source_desc string, applied_at timestamp",
        "applied": streams.APPLIED,
    }
    changes.publish_all({name: spark.createDataFrame([], s) for name, s in empty.items()}, root)


def test_offers_across_batches(spark, tmp_path):
    """Two files, one checkpoint: the second batch sees what the first merged; another checkpoint offers all again."""
    root, src = f"file://{tmp_path}/cat", str(tmp_path / "offers")
    start_offers(spark, root)
    t = spark.createDataFrame([("j", "jpeg", True, False, None, 0.0), ("m", "mp4", True, None, None, 5.0)], TARGET)
    batches = [[("j", "date", 100, 1, None, None), ("m", "date", 7, 2, None, None)], [("j", "date", 200, 3, None, None), ("m", "date", 7, 4, None, None), ("m", "date", 8, 5, None, None), ("j", "gps", None, 6, 1.5, 2.5), ("j", "gps", None, 7, 3.0, 4.0)]]
    for checkpoint in ("a", "a", "b"):
        if batches:
            spark.createDataFrame(batches.pop(0), OFFER).coalesce(1).write.mode("append").parquet(src)
        stream = streams.file_stream(spark, src, spark.createDataFrame([], OFFER).schema)
        query = streams.apply_offers(streams.counted(stream, "offers", n=F.count("*")), t, root, str(tmp_path / checkpoint))
        query.awaitTermination(120)
        assert [p["n"] for p in streams.progress(query, "offers")] in ([2], [5], [7])
        log = {(r.seq, r.field) for r in changes.current(spark, root, "log").collect()}
    assert log == {(1, "date"), (2, "merged_mtime_only"), (3, "already_present"), (4, "already_present"), (5, "merged_mtime_only"), (6, "gps"), (7, "already_present")}
    assert changes.current(spark, root, "pending").count() == 3  # one assumed offset, two mtimes
    now = {r.target: (r.has_date, r.has_gps, r.mtime) for r in offers.targets_now(t, changes.current(spark, root, "log")).collect()}
    assert now == {"j": (True, True, 100.0), "m": (None, None, 8.0)}


def test_failed_writes(spark):
    t = spark.createDataFrame([("a", "jpeg", False, None, None, 0.0, None), ("b", "jpeg", True, True, False, 0.0, "OSError"), ("c", "png", True, None, None, 3.0, None)], TARGET + ", write_error string")
    o = spark.createDataFrame([("a", "date", 1, 1, None, None), ("b", "date", 1, 2, None, None), ("b", "gps", None, 3, 1.0, 2.0), ("c", "date", None, 4, None, None)], OFFER)
    got = {r.offer_seq: (r.state, r.reason, r.satisfied_by) for r in offers.evaluate_offers(o, t).collect()}
    assert got == {1: ("failed", "failed_unparseable", None), 2: ("already_present", None, "exif_date"), 3: ("failed", "failed_write_error:OSError", None)}


def test_matching_streams(spark, tmp_path):
    """Whichever comes first; a sidecar with two candidate names, one of them there, isn't left over."""
    rows = "archive_id long, entry_path string, at timestamp"
    at = lambda h, m=0: datetime(2026, 8, 4, h, m)
    sides = [[(1, "d/IMG_1.jpg.json", at(1)), (1, "d/DSC_1.JPG(1).json", at(1)), (1, "d/lost.jpg.json", at(1))], [(1, "d/late.jpg.json", at(9))]]
    media = [[(1, "d/DSC_1(1).JPG", at(1, 5))], [(1, "d/IMG_1.jpg", at(1, 9)), (1, "d/far.jpg", at(9))]]
    empty, out = spark.createDataFrame([], rows), str(tmp_path / "out")
    for i in range(3):  # the third run carries the watermark on
        for name, parts in (("s", sides), ("m", media)):
            part = parts[i] if i < 2 else [(1, f"d/z{name}.json", at(20))]
            spark.createDataFrame(part, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        s, m = (streams.file_stream(spark, str(tmp_path / name), empty.schema) for name in ("s", "m"))
        q = streams.match_streams(s, m).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    got = {r.sidecar_path: (r.media_path, r.unmatched) for r in streams.settled_matches(spark.read.parquet(out)).collect()}
    assert got["d/IMG_1.jpg.json"] == ("d/IMG_1.jpg", False)
    assert got["d/DSC_1.JPG(1).json"] == ("d/DSC_1(1).JPG", False)
    assert got["d/lost.jpg.json"] == (None, True)


def test_streams(spark, tmp_path):
    root, src = f"file://{tmp_path}/cat", tmp_path / "offers"
    start_offers(spark, root)
    t = spark.createDataFrame([("m", "mp4", True, None, None, 5.0)], "target string, container string, exif_ok boolean, has_date boolean, has_gps boolean, mtime double")
    o = spark.createDataFrame([("m", "date", 6, 1, None, None), ("m", "gps", None, 2, 1.5, 2.5)], OFFER)
    o.coalesce(1).write.parquet(str(src))
    for run in range(2):
        stream = streams.file_stream(spark, str(src), o.schema)
        q = streams.apply_offers(stream, t, root, str(tmp_path / f"cp{run}"))  # a new checkpoint: all offers come again
        q.awaitTermination(60)
        assert changes.current(spark, root, "log").count() == 1
        assert changes.current(spark, root, "pending").count() == 2


def test_fresh_entries_remember_all(spark, tmp_path):
    root, src = str(tmp_path / "w"), tmp_path / "entries"
    rows = "archive long, digest string, at timestamp"
    empty = spark.createDataFrame([], rows)
    changes.publish(empty, root, "entries")
    history = spark.createDataFrame([("old",)], "digest string")
    days = [[(1, "x", "2024-01-01"), (2, "old", "2024-01-01"), (3, None, "2024-01-01")], [(4, "y", "2024-03-01")], [(5, "x", "2024-05-01"), (6, "y", "2024-05-01"), (7, "z", "2023-01-01"), (8, "z", "2023-01-02")]]
    for run in ("a", "a", "a", "b"):  # b: a new checkpoint, all entries come again
        if days:
            day = [(a, d, datetime.fromisoformat(at)) for a, d, at in days.pop(0)]
            spark.createDataFrame(day, rows).coalesce(1).write.mode("append").parquet(str(src))
        stream = streams.file_stream(spark, str(src), empty.schema)
        streams.fresh_entries(stream, history, root, str(tmp_path / run)).awaitTermination(60)
    got = changes.current(spark, root, "entries").collect()
    assert sorted(str(r.digest) for r in got) == ["None", "x", "y", "z"]
    assert {r.archive for r in got} - {7, 8} == {1, 3, 4}


def jpeg(*fields, size=None):
    """A JPEG head with EXIF fields (tag, type, count, value bytes) in one directory, and a frame of a size."""
    at, extra, entries = 8 + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, n, value in fields:
        place = value.ljust(4, b"\0") if len(value) <= 4 else (at + len(extra)).to_bytes(4, "little")
        entries += tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + n.to_bytes(4, "little") + place
        extra += value if len(value) > 4 else b""
    body = b"Exif\0\0II*\0" + (8).to_bytes(4, "little") + len(fields).to_bytes(2, "little") + entries + b"\0\0\0\0" + extra
    frame = b"\xff\xc0\0\x11\x08" + size[1].to_bytes(2, "big") + size[0].to_bytes(2, "big") + b"\0" * 10 if size else b""
    return b"\xff\xd8\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + frame + b"\xff\xda"


def rationals(*pairs):
    return b"".join(a.to_bytes(4, "little") + b.to_bytes(4, "little") for a, b in pairs)


def test_exif_values_and_signals(spark):
    shot = jpeg((0x010F, 2, 6, b"Canon\0"), (0x9003, 2, 20, b"2021:07:04 13:00:00\0"), (0x9011, 2, 7, b"-06:00\0"), (0x829A, 5, 1, rationals((1, 60))), (1, 2, 2, b"S\0"), (2, 5, 3, rationals((33, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, rationals((151, 1), (0, 1), (36, 1))), size=(4000, 3000))
    digitized = jpeg((0x9003, 2, 20, b"0000:00:00 00:00:00\0"), (0x9004, 2, 20, b"2020:01:02 03:04:05\0"))
    damaged = jpeg((2, 5, 2**32 - 1, rationals((1, 1))), (0x010F, 2, 2**31, b"x" * 8))
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    files = spark.createDataFrame([("/v/a.jpg", bytearray(shot)), ("/v/b.jpg", bytearray(digitized)), ("/v/c.jpg", bytearray(damaged)), ("/v/d.png", bytearray(png)), ("/v/e.mp4", bytearray(b"\0\0\0\x14ftypmp42")), ("/v/f.gif", None)], "path string, content binary")
    values = {r.path: r for r in exif.exif_values(exif.exif_tags(files)).collect()}
    a = values["/v/a.jpg"]
    assert (a.taken, a.offset_seconds, a.latitude, round(a.longitude, 6), a.has_date, a.has_gps) == (datetime(2021, 7, 4, 13), -21600, -33.5, 151.01, True, True)
    b = values["/v/b.jpg"]
    assert (b.taken, b.clock, b.has_gps) == (datetime(2020, 1, 2, 3, 4, 5), None, False)
    assert values["/v/c.jpg"].readable and not values["/v/c.jpg"].has_gps and values["/v/c.jpg"].make is None
    got = {r.path: (r.name, r.container, r.width, r.height, r.make, r.exposure, r.gps, r.dims_error) for r in exif.media_signals(files).collect()}
    assert got["/v/a.jpg"] == ("a.jpg", "jpeg", 4000, 3000, "Canon", True, True, None)
    assert got["/v/b.jpg"][7] == "ValueError: no dimensions in the header"
    assert got["/v/d.png"][:4] == ("d.png", "png", 640, 480)
    assert got["/v/e.mp4"][1:4] == ("mp4", None, None) and got["/v/e.mp4"][7] is None
    assert got["/v/f.gif"][1] == "unreadable"


def test_provenance_and_lookups(spark, tmp_path):
    (tmp_path / "p.csv").write_text("path,name,container,width,height,make,model,software,exposure,gps\n/a.jpg,a.jpg,jpeg,10,x,,,,0.5,True\n/b.jpg,b.jpg,,,,M,,,,true\n")
    got = [tuple(r) for r in records.provenance_csv(spark, str(tmp_path / "p.csv")).orderBy("path").collect()]
    assert got == [("/a.jpg", "a.jpg", "jpeg", 10, None, None, None, None, 0.5, True), ("/b.jpg", "b.jpg", None, None, None, "M", None, None, None, False)]
    files = spark.createDataFrame([(1, "/a", 5, "x", "h"), (2, "/b", 5, "y", "h")], "seq long, path string, size long, digest_full string, digest_head string")
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(lookups.file_by_path(files, "/a")) == [1] and seqs(lookups.files_by_size(files, 5)) == [1, 2]
    assert seqs(lookups.files_by_digest(files, "y")) == [2] and seqs(lookups.files_by_head(files, "h")) == [1, 2]
    assert seqs(lookups.archive_by_path(files, "/none")) == [] and seqs(lookups.all_by(files, files.filter("seq = 2"), "path")) == [2]


def test_cascade_digests_survivors_only(spark):
    rows = [(f"/{i}", size, bytearray(data)) for i, (size, data) in enumerate([(0, b""), (3, b"abc"), (3, b"abc"), (3, b"abd"), (4, b"abcd"), (2, b"xy"), (2, b"xz")])]
    watch = {s: Observation(f"cascade-{s}") for s in ("size", "head", "tail", "full")}
    found = dedup.cascade(spark.createDataFrame(rows, "path string, size long, content binary"), watch)
    assert sorted(r.path for r in found.collect()) == ["/1", "/2"]
    assert {s: w.get["files"] for s, w in watch.items()} == {"size": 6, "head": 5, "tail": 2, "full": 2}


def test_cascade_plan(spark, tmp_path, monkeypatch):
    """The digest is worked out above the join with the survivors, not in the scan."""
    plans = []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(dedup, "stored", recorded)
    rows = [("/1", 1, bytearray(b"a")), ("/2", 1, bytearray(b"a"))]
    spark.createDataFrame(rows, "path string, size long, content binary").write.parquet(str(tmp_path / "f"))
    assert dedup.cascade(spark.read.parquet(str(tmp_path / "f"))).count() == 2
    for plan in plans[1:]:
        lines = plan.splitlines()
        join = next(i for i, line in enumerate(lines) if "Join" in line)
        assert all(i < join for i, line in enumerate(lines) if "sha2" in line) and "sha2" in plan


def test_observed_counters(spark):
    df, watch = folder.observed(spark.range(10), "seen", even=F.count_if(F.col("id") % 2 == 0))
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"even": 5}


def test_differences(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted(tuple(r) for r in reports.differences(a, b).collect()) == [(1, "first"), (3, "second")]
    assert reports.differences(a, a).count() == 0


def test_rebind_later(spark):
    """A sidecar that nothing matched is kept with its payload, and bound once its media file is there; then it isn't offered again."""
    side = spark.createDataFrame([(7, 1, "d/x.jpg.json")], "seq long, archive_id long, entry_path string")
    payload = '{"photoTakenTime": {"timestamp": "1000"}, "geoData": {"latitude": 1.5, "longitude": 2.5}}'
    none = spark.createDataFrame([], "archive_id long, entry_path string, pos long")
    kept = match.unmatched_rows(match.match_in_archives(side, none), side.withColumn("payload", F.lit(payload)))
    kept = kept.withColumns({"rebound_at": F.lit(None).cast("timestamp"), "rebound_path": F.lit(None).cast("string"), "rebound_outcome": F.lit(None).cast("string")})
    assert [(r.archive_dir, r.entry_name, r.media_stem, r.reason) for r in kept.collect()] == [("d", "x.jpg.json", "x.jpg", "no_media_in_dir")]
    entries = spark.createDataFrame([(1, "d", "x.jpg", "/v/x.jpg")], "seq long, dir string, name string, kept_path string")
    files = spark.createDataFrame([("/v/x.jpg", "f", None)], "path string, digest_full string, digest_source string")
    plan = match.plan_rebind(match.still_unmatched(kept), entries, files.select("path"), files)
    t = spark.createDataFrame([("/v/x.jpg", "jpeg", True, True, None, 0.0)], TARGET)
    log, waits = spark.createDataFrame([], "seq long, target_path string, source_desc string, field string, value string"), spark.createDataFrame([], "file_path string, field string, value string, applied_at timestamp")
    done, new_log, new_waits = match.apply_rebind(plan, kept, t, log, waits, F.lit("2026-08-04 00:00:00").cast("timestamp"))
    r = done.first()
    assert r.rebound_path == "/v/x.jpg" and json.loads(r.rebound_outcome) == {"merged": ["gps"], "merged_mtime_only": [], "deferred": [], "failed": [], "already_present": ["date"], "media_name": "x.jpg", "relocated": False}
    assert {x.field for x in new_log.collect()} == {"gps", "already_present"} and new_waits.count() == 0
    assert match.still_unmatched(done).count() == 0 and match.binds_elsewhere(done, entries).count() == 0
    assert match.binds_elsewhere(done.withColumn("rebound_path", F.lit("/v/other.jpg")), entries).count() == 1


def test_reports_are_ordered(spark):
    waits = spark.createDataFrame([("deferred", "gps", "b", None)] * 2 + [("deferred", "date", "a", None)] * 3 + [("failed", "date", "a", None), ("failed", "date", "a", 1)], "state string, field string, reason string, applied_at int")
    assert [r.n for r in reports.open_counts(waits).collect()] == [3, 2, 1]
    left = spark.createDataFrame([(3, "x", None), (1, "y", None), (2, "y", None), (4, "z", 1)], "seq int, reason string, rebound_at int")
    assert [tuple(r) for r in match.unmatched_summary(left).collect()] == [("y", 2), ("x", 1)]
    assert [r.seq for r in match.still_unmatched(left).collect()] == [1, 2, 3]
    files = spark.createDataFrame([("/mnt/a/1",), ("/mnt/b/1",), ("/mnt/b/2",), ("/Volumes/c/1",), ("/media/u/d/1",), ("/home/x",)], "path string")
    assert [(r.volume, r.rows) for r in reports.volumes(files).collect()] == [("/mnt/b", 2), ("/Volumes/c", 1), ("/media/u/d", 1), ("/mnt/a", 1)]
    done = spark.createDataFrame([(1, "complete"), (3, "complete"), (2, "pending")], "seq int, status string")
    assert [r.seq for r in ingest.completed_archives(done).collect()] == [3, 1]
    rows = spark.createDataFrame([(2, "p", None), (1, "q", None), (3, "p", 5)], "seq int, file_path string, applied_at int")
    assert [r.seq for r in reports.outstanding(rows, "p").collect()] == [2]
    assert [r.seq for r in reports.outstanding(rows, limit=1).collect()] == [1]


def test_bounded_runs(spark):
    plan = spark.createDataFrame([("a", "skipped"), ("b", "set"), ("c", "skipped"), ("d", "set"), ("e", "set")], "path string, decision string")
    got = lambda n: [r.path for r in reports.bounded_run(plan, "path", F.col("decision") == "set", n).orderBy("path").collect()]
    assert (got(1), got(2), got(9), got(0)) == (["a", "b"], ["a", "b", "c", "d"], list("abcde"), list("abcde"))


def test_routes(spark):
    rows = [("d/x.jpg", None), ("d/x.jpg.json", None), ("d/metadata.json", None), ("d/Metadata.JSON", None), ("d/x.aae", None), ("d/x.jpg", "corrupt")]
    df = spark.createDataFrame(rows, "path string, error string")
    route = lambda folder: [r[0] for r in df.select(ingest.route(F.col("path"), F.col("error"), folder)).collect()]
    assert route(False) == ["media", "sidecar", "album_metadata", "album_metadata", "not_media", "error"]
    assert route(True) == ["media", "sidecar", "sidecar", "sidecar", "not_media", "error"]


def test_donations_carry_places_and_offsets(spark):
    pairs = spark.createDataFrame([("/s", "/t")], "source string, target string")
    side = spark.createDataFrame([("/s", "date", 1000)], "source string, field string, value long")
    own = spark.createDataFrame([("/s", "date", 2000, None, None, 3600), ("/s", "gps", None, 1.5, 2.5, None)], "source string, field string, value long, lat double, lon double, offset_seconds int")
    made = offers.donations(pairs, side, own)
    got = {(r.field, r.offer_seq): (r.value, r.lat, r.capture.tz_source, r.capture.offset, r.source_desc) for r in made.collect()}
    assert got == {("date", 1): (1000, None, "utc_fallback", "+00:00", "takeout:/s"), ("date", 2): (2000, None, "source_file", "+01:00", "file:/s"), ("gps", 1): (None, 1.5, "source_file", "+00:00", "file:/s")}
    t = spark.createDataFrame([("/t", "webp", True, False, False, 0.0)], TARGET)
    assert sorted((r.field, r.state, r.reason) for r in offers.evaluate_offers(made, t).collect()) == [("date", "already_present", None), ("date", "merged", "tz_unknown_assumed_utc"), ("gps", "merged", None)]


def test_entries_in_the_right_folder(spark):
    """Copies below or beside the destination aren't restored there; entries without a digest are all kept."""
    files = spark.createDataFrame([(1, "/dest2/x.jpg", "a", None), (2, "/dest/sub/y.jpg", "b", None), (3, "/dest/z.jpg", "c", None)], "seq long, path string, digest_full string, digest_source string")
    entries = spark.createDataFrame([(1, "x.jpg", "a"), (2, "y.jpg", "b"), (3, "z.jpg", "c"), (4, "n.jpg", None), (5, "n.jpg", None)], "ordinal long, name string, digest string")
    got = {r.ordinal: (r.status, r.keep_reason, r.restore_path) for r in ingest.decide_entries(entries, files, files.limit(0).select("path"), "/dest").collect()}
    assert got == {1: ("kept", "prior_copy_missing", None), 2: ("kept", "prior_copy_missing", None), 3: ("kept", "prior_copy_restored", "/dest/z.jpg"), 4: ("kept", None, None), 5: ("kept", None, None)}


def test_adoption_walks_the_slots(spark):
    """The slots before an adopted file are held by files or rows; other bytes are passed over, a gap ends the walk."""
    entries = spark.createDataFrame([(1, "a.jpg", "A"), (2, "b.jpg", "B"), (3, "c.jpg", "C")], "ordinal long, name string, digest string")
    listing_ = spark.createDataFrame([("/d/a.jpg", "other"), ("/d/a(2).jpg", "A"), ("/d/b(1).jpg", "B"), ("/d/c.jpg", "C"), ("/d/sub/c.jpg", "C")], "path string, digest string")
    files = spark.createDataFrame([("/d/a(1).jpg",)], "path string")
    assert {r.ordinal: r.path for r in ingest.adoptable(entries, listing_, files, "/d").collect()} == {1: "/d/a(2).jpg", 3: "/d/c.jpg"}


def test_prefixes_of_one_large_folder(spark):
    """20,000 names that share eight characters and more: every cut name finds its own, in rows that grow with the names."""
    names = spark.range(20000).selectExpr("'d' AS dir", "concat('IMG_20210704_', lpad(CAST(id AS STRING), 6, '0'), 'x.jpg') AS name", "id AS pos")
    cut = spark.range(20000).selectExpr("id AS seq", "'d' AS dir", "concat('IMG_20210704_', lpad(CAST(id AS STRING), 6, '0'), '.json') AS name")
    found = match.match_sidecars(cut, names)
    assert found.filter("media_name = concat(substring(name, 1, 19), 'x.jpg') AND fuzzy AND candidate_count = 1").count() == 20000
    keys = spark.createDataFrame([("d", "img_20210704_", None), ("d", "img_20210704_000007", None), ("d", "img_20210704_000007", "(1)")], "dir string, cut string, counter string")
    hits = {(r.cut, r.counter): (r.hits, r.same) for r in match.prefix_hits(keys, names).collect()}
    assert hits == {("img_20210704_", None): (20000, 0), ("img_20210704_000007", None): (1, 0)}


def test_prefixes_hold_their_counter(spark):
    names = spark.createDataFrame([("d", "DSC_long_a(1).JPG", 1), ("d", "DSC_long_a.JPG", 2), ("d", "DSC_long_b(2)(1).JPG", 3), ("d", "DSC_l", 4), ("e", "DSC_long_a(1).JPG", 5)], "dir string, name string, pos long")
    keys = [("d", "dsc_long_", "(1)"), ("d", "dsc_long_", None), ("d", "dsc_long_a", None), ("d", "", None), ("d", "dsc_long_a", "(2)"), ("f", "dsc_long_a", None)]
    hits = {(r.cut, r.counter): (r.hits, r.same, r.same_name) for r in match.prefix_hits(spark.createDataFrame(keys, "dir string, cut string, counter string"), names).collect()}
    assert hits == {("dsc_long_", "(1)"): (2, 0, None), ("dsc_long_", None): (3, 0, None), ("dsc_long_a", None): (2, 1, "DSC_long_a.JPG")}


def test_what_is_addressable_is_no_verdict_of_the_matcher(spark):
    """A name beside a file of another extension is addressable, one that can't be parsed isn't, nor a counter that no file has."""
    side = [(1, "d", "IMG_0001.jpg.json"), (2, "d", ".json"), (3, "d", "IMG_0002.jpg(1).json"), (4, "d", "IMG_0009.jpg.json"), (5, "d", "IMG_0003.jpg.json"), (6, "none", "IMG_0001.jpg.json")]
    names = [("d", "IMG_0001.png", 1), ("d", "IMG_0002.jpg", 2), ("d", "IMG_0003.jpg", 3)]
    s, m = spark.createDataFrame(side, "seq long, dir string, name string"), spark.createDataFrame(names, "dir string, name string, pos long")
    matched = match.match_sidecars(s, m)
    assert {r.seq for r in match.addressable(matched, m).collect()} == {1}
    rates = match.match_rates(matched, m)
    assert rates.first().asDict() == {
        "total": 6, "name_resolvable": 5, "matched": 1, "fuzzy": 0, "ambiguous": 0, "unparseable": 1, "unmatched_pct": 83.3333, "addressable_unmatched": 1, "addressable_unmatched_pct": 50.0, "cross_directory": 0
    }
    assert not match.matcher_gate(rates).first().passed
    other = matched.withColumn("media_name", F.when(F.col("seq") == 5, "elsewhere.jpg"))
    assert match.matcher_gate(match.match_rates(other, m), 100.0).first().asDict()["cross_directory"] == 1


def test_a_merge_is_logged_whatever_numbers_the_log_has(spark):
    """An ingest numbers its entries and a rebind its sidecars: equal numbers are no equal offers."""
    t = spark.createDataFrame([("/v/1", "mp4", True, None, None, 100.0)], TARGET)
    log = spark.createDataFrame([(4, "/v/1", "takeout:a", "merged_mtime_only", '{"utc_epoch":100}')], "seq long, target_path string, source_desc string, field string, value string")
    offer = spark.createDataFrame([("/v/1", "date", 200, 4, None, None)], OFFER).withColumn("source_desc", F.lit("takeout:b"))
    pending = spark.createDataFrame([], "file_path string, field string, value string, applied_at timestamp")
    decided = offers.evaluate_offers(offer, offers.targets_now(t, log))
    new_log, waits = offers.change_sets(decided, log, pending)
    assert [(r.seq, r.source_desc, r.field, json.loads(r.value)["utc_epoch"]) for r in new_log.collect()] == [(4, "takeout:b", "merged_mtime_only", 200)] and waits.count() == 1
    both = log.unionByName(new_log)
    assert offers.change_sets(decided, both, pending)[0].count() == 0  # the same offer again
    nameless = decided.withColumn("source_desc", F.lit(None).cast("string"))
    once = offers.change_sets(nameless, both, pending)[0]
    assert once.count() == 1 and offers.change_sets(nameless, both.unionByName(once), pending)[0].count() == 0


def test_the_log_is_ordered_by_time_before_numbers(spark):
    rows = [(1000, "/v/1", "takeout:a", "merged_mtime_only", '{"utc_epoch":100}', datetime(2026, 8, 4, 1)), (4, "/v/1", "takeout:b", "merged_mtime_only", '{"utc_epoch":200}', datetime(2026, 8, 4, 2))]
    log = spark.createDataFrame(rows, "seq long, target_path string, source_desc string, field string, value string, merge_time timestamp")
    t = spark.createDataFrame([("/v/1", "mp4", True, None, None, 5.0)], TARGET)
    assert offers.targets_now(t, log).first().mtime == 200.0
    assert offers.targets_now(t, log.drop("merge_time")).first().mtime == 100.0
    assert offers.first_usable(log, F.get_json_object("value", "$.utc_epoch").cast("long")).first().epoch == 100


def test_guard_by_head_and_tail_or_by_full_digest(spark):
    """A full digest that is known to differ counts in full mode alone; what a row doesn't hold isn't compared."""
    cols = "path string, size long, digest_full string, digest_head string, digest_tail string, now_size long, now_full string, now_head string, now_tail string"
    rows = [("same", 9000, "F", "H", "T", 9000, "F", "H", "T"), ("middle", 9000, "F", "H", "T", 9000, "OTHER", "H", "T"), ("head", 9000, "F", "H", "T", 9000, "F", "X" * 20, "T"), ("unknown", 9000, "F", None, None, 9000, "F", "H", "T"), ("short", 100, "F", "H", "H", 100, "F", "H", "T"), ("size", 1234567, "F", "H", "T", 9000, "F", "H", "T"), ("nosize", None, None, "H", "T", 9000, "F", "H", "T")]
    df = spark.createDataFrame(rows, cols)
    quick, full = ({r.path: r.d for r in df.select("path", capture.content_guard(f).alias("d")).collect()} for f in (False, True))
    assert quick == {"same": None, "middle": None, "head": "head digest db H != disk " + "X" * 16, "unknown": None, "short": None, "size": "size 9,000 != db 1,234,567", "nosize": None}
    assert full == {"same": None, "middle": "full digest db F != disk OTHER", "head": None, "unknown": None, "short": None, "size": "size 9,000 != db 1,234,567", "nosize": "full digest db none != disk F"}


def test_siblings_of_one_crowded_folder(spark):
    """100,000 photos of one folder within 12 hours: each asks at three places, none is paired."""
    photos = spark.range(100000).selectExpr("id", "'d' AS dir", "1625421600 + id % 43200 AS epoch", "CASE WHEN id % 2 = 0 THEN 3600 END AS offset")
    found = capture.sibling_offsets(photos.select("id", "dir", "epoch"), photos.select("dir", "epoch", "offset"))
    assert found.filter("sibling_offset = 3600").count() == 100000
    spread = spark.createDataFrame([(1, "d", 0), (2, "d", 43200), (3, "d", 86400), (4, "d", -1), (5, "e", 0), (6, "d", None)], "id long, dir string, epoch long")
    known = spark.createDataFrame([("d", 0, 1), ("d", 86401, 2)], "dir string, epoch long, offset int")
    assert {r.id: r.sibling_offset for r in capture.sibling_offsets(spread, known).collect()} == {1: 1, 2: 1, 3: 2, 4: 1}


def test_words_for_instants(spark):
    clock = F.lit("2021-07-04 13:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(-21600, None), (20700, None), (None, None), (None, 1625421600), (None, 1625405461), (None, 1625421600 + 86400 * 3)], "offset int, claimed long")
    got = [r.d for r in rows.select(times.resolve_instant(F.lit(True), clock, F.col("offset"), F.col("claimed"))["detail"].alias("d")).collect()]
    assert got == [
        "2021-07-04 13:00:00 offset -1 day, 18:00:00",
        "2021-07-04 13:00:00 offset 5:45:00",
        "2021-07-04 13:00:00",
        "2021-07-04 13:00:00 + offset +5.00h",
        "exif 2021-07-04 13:00:00 vs google 2021-07-04 13:31:01+00:00 — gap +0.517h is not a whole 15-minute offset",
        "exif 2021-07-04 13:00:00 vs google 2021-07-07 18:00:00+00:00 — 3d apart",
    ]


def test_a_dry_run_claims_nothing(spark):
    pairs = spark.createDataFrame([(1, "/v/a", "digest_full", "/src", "x/a.jpg")], "id long, survivor_path string, matched_on string, source_root string, rel string")
    none = spark.createDataFrame([], "id long, field string, state string")
    times_ = spark.createDataFrame([], "id long, reason string, adopted long, detail string")
    row = folder.collapse_records(pairs, none, times_, attempted=False).first()
    assert json.loads(row.adopted) == [{"what": "provenance", "from": "source_root", "detail": "also present at /src/x/a.jpg"}]
    assert json.loads(row.declined) == [{"what": "exif_merge", "reason": "dry_run", "detail": "not attempted"}]


def test_free_numbers_of_one_hot_name(spark, monkeypatch):
    """100,000 askers of one name with 100,000 used numbers, in windows of a thousand."""
    from filelens.operators import ranks

    monkeypatch.setattr(ingest, "WIDTH", 1000)
    monkeypatch.setattr(ranks, "WIDTH", 1000)
    askers = spark.range(100000).selectExpr("id AS ordinal", "'a.jpg' AS name")
    taken = spark.range(100000).selectExpr("concat('a(', CAST(2 * id + 1 AS STRING), ').jpg') AS name")
    given = ingest.allocate_names(askers, taken)
    # Free are the name itself, 2, 4, ... and all beyond the last used number, 199999.
    right = "given = CASE WHEN ordinal = 0 THEN 'a.jpg' WHEN ordinal < 100000 THEN concat('a(', CAST(2 * ordinal AS STRING), ').jpg') END"
    assert given.filter(right).count() == 100000
    few = spark.createDataFrame([(5, "b"), (7, "b"), (6, "c")], "ordinal long, name string")
    held = spark.createDataFrame([("b",), ("b(1)",), ("b(3)",)], "name string")
    assert {r.ordinal: r.given for r in ingest.allocate_names(few, held).collect()} == {5: "b(2)", 7: "b(4)", 6: "c"}


def test_a_digest_of_very_many_copies(spark, monkeypatch):
    from filelens.operators import ranks

    monkeypatch.setattr(dedup, "WIDTH", 500)
    monkeypatch.setattr(ranks, "WIDTH", 500)
    cols = "CAST(1000 AS BIGINT) AS size, 10 AS width, 10 AS height, false AS has_exif_gps"
    files = spark.range(20000).selectExpr("id AS seq", "concat('/v/', id, '.jpg') AS path", "CASE WHEN id % 10 = 9 THEN concat('d', id) ELSE 'hot' END AS digest_full", "id % 3 = 0 AS has_exif_date", cols.split(", ")[0], *cols.split(", ")[1:])
    rows = dedup.in_groups(files).select("seq", "members", "place", "rank", "score").collect()
    assert len(rows) == 18000 and {r.members for r in rows} == {18000}
    assert [r.place for r in sorted(rows, key=lambda r: r.seq)] == list(range(1, 18001))
    assert [r["rank"] for r in sorted(rows, key=lambda r: (-r.score, r.seq))] == list(range(1, 18001))


def test_cascade_of_files_reads_what_it_needs(spark, tmp_path):
    big = b"x" * 200_000
    made = {"a": big, "b": big, "c": b"y" + big[1:], "d": big[:-1] + b"z", "e": big[:100_000] + b"m" + big[100_001:], "f": b"short", "g": b"short", "h": b"alone!", "i": b""}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(str(tmp_path / n), len(d)) for n, d in made.items()] + [(str(tmp_path / "gone"), 5)], "path string, size long")
    watch = {s: Observation(f"files-{s}") for s in ("head", "tail", "full")}
    found = dedup.cascade_files(listed, watch)
    assert sorted(r.path[-1] for r in found.collect()) == ["a", "b", "f", "g"]
    read = {s: (w.get["files"], w.get["bytes"]) for s, w in watch.items()}
    assert read == {"head": (8, 5 * 65536 + 10), "tail": (6, 4 * 4096 + 10), "full": (5, 3 * 200_000 + 10)}
    plan = ranges.read_digests(listed, "head", "tail").groupBy("head").count()._jdf.queryExecution().executedPlan().toString()
    assert all("content" not in line and "binary" not in line for line in plan.splitlines() if "Exchange" in line)


def test_directories_are_read_once(spark, tmp_path, monkeypatch):
    """Stored, deflated, bzip2 and LZMA entries by their places; damaged bytes are rows with an error; the readers of entries open no directory."""
    kinds = {"a": zipfile.ZIP_STORED, "b": zipfile.ZIP_DEFLATED, "c": zipfile.ZIP_BZIP2, "d": zipfile.ZIP_LZMA}
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("folder/", b"")
        for n in range(40):
            kind = "abcd"[n % 4]
            z.writestr(zipfile.ZipInfo(f"folder/{n}{kind}"), f"entry {n} ".encode() * 50, compress_type=kinds[kind])
    table = archive.directories(spark, str(tmp_path / "*.zip")).orderBy("ordinal").collect()
    assert len(table) == 40 and [r.ordinal for r in table] == list(range(1, 41)) and all(a.at < b.at for a, b in zip(table, table[1:]))
    with open(tmp_path / "t.zip", "r+b") as f:
        f.seek(table[4].at + 30 + len("folder/4a") + 5)
        f.write(b"#")
    rows = archive.read_entries(spark, str(tmp_path / "t.zip"), step=8).collect()
    assert len(rows) == 40
    for r in rows:
        n, kind = int(r.entry_path[7:-1]), r.entry_path[-1]
        assert (r.content, r.error) == ((None, "corrupt") if n == 4 else (f"entry {n} ".encode() * 50, None))
    assert archive.read_entries(spark, str(tmp_path / "none*.zip")).count() == 0


def test_headers_of_files_in_place(spark, tmp_path):
    """Sizes of TIFF and BMP; EXIF at the end of a large WebP; a file is walked, not read."""
    tiff = b"MM\0*" + (8).to_bytes(4, "big") + (2).to_bytes(2, "big") + b"\1\0\0\3\0\0\0\1\1\x40\0\0" + b"\1\1\0\4\0\0\0\1\0\0\0\xf0" + b"\0\0\0\0"
    far = b"II*\0" + (200_000).to_bytes(4, "little") + b"\0" * 199_992 + (2).to_bytes(2, "little") + b"\0\1\4\0\1\0\0\0\x39\5\0\0" + b"\1\1\3\0\1\0\0\0\7\0\0\0"
    bmp = b"BM" + b"\0" * 12 + (40).to_bytes(4, "little") + (640).to_bytes(4, "little", signed=True) + (-480).to_bytes(4, "little", signed=True) + b"\0" * 28
    old = b"BM" + b"\0" * 12 + (12).to_bytes(4, "little") + (30).to_bytes(2, "little") + (20).to_bytes(2, "little") + b"\0" * 8
    block = b"II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (0x010F).to_bytes(2, "little") + (2).to_bytes(2, "little") + (4).to_bytes(4, "little") + b"Cam\0" + b"\0" * 4
    chunks = b"VP8X" + (10).to_bytes(4, "little") + b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + b"VP8 " + (3_000_000).to_bytes(4, "little") + b"\0" * 3_000_000 + b"EXIF" + len(block).to_bytes(4, "little") + block
    webp = b"RIFF" + (len(chunks) + 4).to_bytes(4, "little") + b"WEBP" + chunks
    for name, data in {"a.tif": tiff, "b.tif": far, "c.bmp": bmp, "d.bmp": old, "e.webp": webp, "f.tif": tiff[:20], "g.txt": b"plain"}.items():
        (tmp_path / name).write_bytes(data)
    listed = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.tif", "b.tif", "c.bmp", "d.bmp", "e.webp", "f.tif", "g.txt", "gone.jpg")], "path string")
    got = {r.name: (r.container, r.width, r.height, r.make, r.dims_error) for r in exif.media_signals(listed).collect()}
    assert got == {
        "a.tif": ("tiff", 320, 240, None, None), "b.tif": ("tiff", 1337, 7, None, None), "c.bmp": ("unknown", 640, 480, None, None), "d.bmp": ("unknown", 30, 20, None, None),
        "e.webp": ("webp", 100, 50, "Cam", None), "f.tif": ("tiff", None, None, None, "ValueError: no dimensions in the first directory"), "g.txt": ("unknown", None, None, None, None), "gone.jpg": ("unreadable", None, None, None, None),
    }
    with ranges.opened(str(tmp_path / "e.webp")) as file:
        assert exif.tags_of(file)["make"] == "Cam" and file.count < 70_000
    both = exif.media_signals(spark.createDataFrame([("x/a.tif", bytearray(tiff)), ("x/c.bmp", bytearray(bmp))], "path string, content binary")).collect()
    assert {(r.width, r.height) for r in both} == {(320, 240), (640, 480)}


def test_offers_in_batches_of_any_order(spark, tmp_path):
    """Late files with lower numbers, and sources that number alike: every offer is applied once, none twice."""
    root, src = f"file://{tmp_path}/cat", str(tmp_path / "offers")
    start_offers(spark, root)
    t = spark.createDataFrame([(f"m{i}", "mp4", True, None, None, 5.0) for i in range(6)], TARGET)
    batches = [[("m0", "date", 100, 50_000, "a"), ("m1", "date", 101, 2, "b")], [("m2", "date", 102, 1, "a"), ("m3", "date", 103, 2, "a")], [("m4", "date", 104, 1, "b"), ("m1", "date", 101, 2, "b"), ("m5", "date", 105, 49_999, "a")]]
    for n, rows in enumerate(batches):
        made = [(target, f, v, seq, None, None, s, f"takeout:{s}{seq}") for target, f, v, seq, s in rows]
        schema = OFFER + ", source string, source_desc string"
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(src)
        stream = streams.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        streams.apply_offers(stream, t, root, str(tmp_path / "cp")).awaitTermination(120)
    log = changes.current(spark, root, "log").collect()
    assert sorted((r.source_desc, r.seq, json.loads(r.value)["utc_epoch"]) for r in log) == [("takeout:a1", 1, 102), ("takeout:a2", 2, 103), ("takeout:a49999", 49_999, 105), ("takeout:a50000", 50_000, 100), ("takeout:b1", 1, 104), ("takeout:b2", 2, 101)]
    assert changes.current(spark, root, "applied").groupBy("source").agg(F.sum(F.bitmap_count("bits")).alias("n")).orderBy("source").collect() == [("a", 4), ("b", 2)]
    again = streams.apply_offers(streams.file_stream(spark, src, spark.createDataFrame([], schema).schema), t, root, str(tmp_path / "cp2"))
    again.awaitTermination(120)
    assert changes.current(spark, root, "log").count() == 6 and changes.current(spark, root, "pending").count() == 6


def test_two_publishers_of_one_state(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/cat"
    df = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(LookupError, match="no table"):
        changes.current(spark, root, "t")
    changes.publish(df, root, "t")
    changes.publish_all({}, root, {"t": df})
    assert changes.current(spark, root, "t").count() == 2
    monkeypatch.setattr(changes, "_last_unit", lambda spark, root: 1)  # read before the other published
    with pytest.raises(RuntimeError, match="another publisher"):
        changes.publish_all({}, root, {"t": df})
    monkeypatch.undo()
    assert changes.current(spark, root, "t").count() == 2
    changes.publish_all({"t": df}, root, {"u": df})  # a whole table again
    assert changes.current(spark, root, "t").count() == 1


def test_every_batch_has_its_counters(spark, tmp_path):
    """More batches than a query remembers."""
    src, kept = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.range(0, 24, 1, 12).write.parquet(src)
    listener = streams.CounterTable(spark, f"file://{tmp_path}/counters")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    spark.streams.addListener(listener)
    try:
        stream = streams.counted(streams.file_stream(spark, src, spark.range(1).schema, files_per_batch=1), "rows", n=F.count("*"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(180) and len(query.recentProgress) <= 3
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        got = streams.counters(spark, f"file://{tmp_path}/counters").collect()
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert sorted(r.batch for r in got) == list(range(12)) and sum(int(r.counters["n"]) for r in got) == 24


def test_arrivals_match_as_a_batch_does(spark, tmp_path):
    """Exact, folded and cut names, either side first, with end markers; a directory without one goes by its timer."""
    at = lambda h: datetime(2026, 8, 4, h)
    side = [(1, "d/IMG_1.jpg.json", 1), (1, "d/dsc_2.JPG.json", 2), (1, "d/IMG_2021_holid.json", 3), (1, "d/IMG_2021_x.json", 4), (1, "d/A(1).jpg.json", 5), (2, "d/IMG_1.jpg.json", 6), (1, "e/late.jpg.json", 7)]
    media = [(1, "d/IMG_1.jpg", 1), (1, "d/DSC_2.jpg", 2), (1, "d/IMG_2021_holiday.jpg", 3), (1, "d/IMG_2021_xa.jpg", 4), (1, "d/IMG_2021_xb.jpg", 5), (1, "d/A(1).jpg", 6), (1, "e/late.jpg", 7)]
    s_rows, m_rows = "archive_id long, entry_path string, seq long", "archive_id long, entry_path string, pos long"
    batch = match.match_in_archives(spark.createDataFrame(side, s_rows), spark.createDataFrame(media, m_rows))
    want = {r.seq: (r.media_name, r.fuzzy, r.reason, r.candidate_count) for r in batch.collect()}
    assert want[3] == ("IMG_2021_holiday.jpg", True, None, 1) and want[4][2] == "ambiguous" and want[2][0] == "DSC_2.jpg"
    for order in ("sm", "ms"):
        base, got, counts = tmp_path / order, {}, []

        def take(df, n, got=got, counts=counts):
            found = df.collect()
            counts.append(len(found))
            got.update({r.seq: (r.media_name, r.fuzzy, r.reason, r.candidate_count) for r in found})

        schemas = {"s": s_rows + ", at timestamp", "m": m_rows + ", at timestamp", "e": "archive_id long, dir string, at timestamp"}
        for name, schema in schemas.items():
            spark.createDataFrame([], schema).write.parquet(str(base / name))
        steps = {"s": [(*r, at(1)) for r in side], "m": [(*r, at(1)) for r in media]}
        last = [("e", [(1, "d", at(1)), (2, "d", at(1))]), ("m", [(9, "z/x.jpg", 1, at(9))])]
        for name, rows in [(order[0], steps[order[0]]), (order[1], steps[order[1]]), *last]:
            spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("append").parquet(str(base / name))
            s, m, e = (streams.file_stream(spark, str(base / n), spark.createDataFrame([], schemas[n]).schema) for n in "sme")
            query = matching.match_arrivals(matching.released_directories(s, m, e, wait_seconds=3600), take, str(base / "cp"))
            assert query.awaitTermination(180)
        assert got == want and sum(counts) == len(want)
