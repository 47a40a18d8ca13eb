"""What grows with the tables: rows between operators and what the driver gathers."""

from pyspark.sql import functions as F

from filelens.functions.documents import logged_epoch, sidecar_payload
from filelens.operators import dedup, ingest, match, offers
from filelens.plans.catalog_queries import QUERIES


def nodes(df):
    """The nodes of a plan as it ran, after its run."""

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            yield from walk(p.plan())
        else:
            yield p
            kids = p.children()
            for i in range(kids.size()):
                yield from walk(kids.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def most_joined(df):
    return max(p.metrics().apply("numOutputRows").value() for p in nodes(df) if "Join" in p.nodeName())


def test_archives_of_one_digest_meet_no_pairs(spark):
    """500 incoming and 400 complete archives of one digest: the first of each path or digest counts, and rows stay those of the tables."""
    incoming = spark.range(500).selectExpr("concat('i', id) AS path", "'same' AS digest").unionByName(spark.createDataFrame([("a7", "other"), ("a9", "same"), ("n", None)], "path string, digest string"))
    archives = spark.range(400).selectExpr("400 - id AS seq", "concat('a', id) AS path", "'same' AS digest", "'complete' AS status")
    df = ingest.known_archives(incoming, archives)
    got = {r.path: tuple(r)[1:] for r in df.collect()}
    assert len(got) == 502 and got["i3"] == (1, "a399", "digest") and got["a7"] == (393, "a7", "path") and got["a9"] == (391, "a9", "path")
    assert most_joined(df) <= 600


def test_a_document_is_parsed_once(spark):
    """However many numbers are read from it."""
    doc = '{"utc_epoch":5,"photoTakenTime":{"timestamp":"-1"},"creationTime":{"timestamp":"7"},"geoData":{"latitude":0,"longitude":0},"geoDataExif":{"latitude":1.5,"longitude":2}}'
    rows = spark.createDataFrame([(doc,), ("[1]",), (None,)], "d string")
    for read, want in ((sidecar_payload, (7, 1.5, 2.0)), (logged_epoch, 5)):
        df = rows.select(read(F.col("d")).alias("p"))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
        assert [r.p if r.p is None or isinstance(r.p, int) else tuple(r.p) for r in df.collect()] == [want, None, None]


def _one_digest(spark):
    incoming = spark.range(300).selectExpr("id AS entry", "'same' AS digest").unionByName(spark.createDataFrame([(300, "b"), (301, "none"), (302, None)], "entry long, digest string"))
    files = spark.range(200).selectExpr("id AS seq", "concat('/f', id) AS path", "if(id % 2 = 0, 'same', 'b') AS digest_full", "if(id < 10, 'same', cast(NULL AS string)) AS digest_source")
    return incoming, files, spark.range(3, 200).selectExpr("concat('/f', id) AS path")


def test_matches_of_one_digest_are_counted_without_pairs(spark):
    """300 entries and 105 files of one digest: the numbers are those of all pairs, the rows are not."""
    incoming, files, present = _one_digest(spark)
    pairs = dedup.content_matches(incoming, files)
    counts, first = dedup.match_counts(incoming, files, "entry"), dedup.first_survivors(incoming, files, present, "entry")
    want = pairs.groupBy("entry").agg(F.count("*").alias("matches"), F.min("seq").alias("first_seq"), F.min("matched_on").alias("matched_on"))
    assert sorted(counts.collect()) == sorted(want.collect()) and counts.count() == 301
    assert sorted(first.collect()) == sorted(dedup.first_survivor(pairs, present, "entry").select("entry", "path", "matched_on").collect())
    assert most_joined(counts) <= 303 and most_joined(first) <= 303


def test_match_queries_make_no_pairs(spark, smoke_dir):
    """The registered queries go the same way: no join has more rows than there are documents."""
    for name in ("join_03_content_matches", "join_04_first_survivor"):
        df = QUERIES[name](spark, smoke_dir.replace("sf0.001", "sf0.01"))
        df.collect()
        assert most_joined(df) <= 1000, name


def test_sidecars_and_media_stay_off_the_driver(spark, smoke_dir):
    """Tables of sidecars, media files, offers or targets are no broadcasts, however small; what has a row a directory may be."""
    side = spark.range(60).selectExpr("id AS seq", "id % 2 AS archive_id", "concat('d/IMG_0000', id, '.jpg.json') AS entry_path", "'{}' AS payload")
    media = spark.range(60).selectExpr("id % 2 AS archive_id", "concat('d/IMG_0000', id, '.jpg') AS entry_path", "id AS pos")
    matched = match.match_in_archives(side, media)
    names = media.selectExpr("concat(archive_id, '/d') AS dir", "substring(entry_path, 3) AS name")
    in_place = matched.withColumn("dir", F.concat(F.col("archive_id").cast("string"), F.lit("/d")))
    rates, rows = match.match_rates(in_place, names), match.unmatched_rows(matched, side)
    offer = spark.range(60).selectExpr("concat('t', id % 3) AS target", "'date' AS field", "id AS value", "id AS offer_seq")
    target = spark.range(3).selectExpr("concat('t', id) AS target", "'mp4' AS container", "true AS exif_ok", "false AS has_date", "false AS has_gps", "0D AS mtime")
    decided = offers.evaluate_offers(offer, target)
    assert rates.first().matched == 60 and rows.count() == 0 and decided.count() == 60
    for df in (matched, rates, rows, decided):
        df.collect()
        sent = [set(p.output().apply(i).name() for i in range(p.output().size())) for p in nodes(df) if p.nodeName() == "BroadcastExchange"]
        assert all(c <= {"dir", "lengths", "listed"} for c in sent), sent
