"""Each operator against a plain version, and on rows with nulls, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filelens.llm import ann, bpe, license_scan, lm_score, mixing, near_dup, quality, queries, token_frames, topk
from filelens.llm.common import read_table
from filelens.llm.components import connected_components
from filelens.llm.language_id import LangConfig, identify_languages, learn_languages, spelled

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "b", 0, "x"),
    (3, "the same words here again and again", "en", "a", 1, None),
    (3, "the same words here again and again", "en", "a", 1, None),
    (4, "The same WORDS here again and again", "en", None, 1, None),
    (None, "no id at all for this one", "fr", "b", 1, None),
    (6, "1234 5678 !!", None, "b", 1, None),
    (7, "mit license " + "word " * 30_000, "en", "c", 1, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, smoke_dir):
    return read_table(spark, smoke_dir, "documents")


def words(text):
    return (text or "").encode().lower().split()


def test_permutation_is_one(spark):
    key = F.lit(3).cast("long")
    for n in (1, 2, 7, 100):
        rows = spark.range(n).withColumn("p", mixing.permuted(F.col("id"), F.lit(n).cast("long"), key, 24))
        rows = rows.withColumn("back", mixing.permuted(F.col("p"), F.lit(n).cast("long"), key, 24, inverse=True))
        got = rows.collect()
        assert sorted(r.p for r in got) == list(range(n))
        assert all(r.back == r.id for r in got)


def targets(sizes, weights):
    total, out, capped = 1.5 * sum(sizes), {}, set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        out = {i: 2 * sizes[i] if i in capped else rest * weights[i] / w for i in range(len(sizes))}
        more = {i for i in out if i not in capped and out[i] > 2 * sizes[i]}
        if not more:
            return out
        capped |= more


def test_mixing(spark, docs, odd):
    for table in (docs, odd):
        rows = table.select("doc_id", "text", "source").collect()
        size = Counter()
        for r in rows:
            size[r.source] += len(words(r.text))
        names = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
        want = dict(zip(names, targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]).values(), strict=True))
        mix = mixing.plan_mix(table, mixing.MixConfig(block_words=64, shard_blocks=16))
        got = mix.per_document().collect()
        assert len(got) == len(rows)
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        taken = mix.per_document().groupBy("target", "source_size").agg(F.sum("taken").alias("t")).collect()
        assert all(abs(r.t - r.target) <= 1 or sum(abs(x - r.target) < 1e-6 for x in want.values()) > 1 for r in taken)
        assert {round(r.target, 4) for r in got} == {round(t, 4) for t in want.values()}
        assert sorted(map(str, mix.per_document().collect())) == sorted(map(str, got))
    assert mixing.mix_documents(odd.limit(0)).count() == 0
    texts = mixing.plan_mix(docs, mixing.MixConfig(block_words=64)).block_texts(docs)
    assert texts.filter(F.size(F.split("text", " ")) > 64).count() == 0


def test_mixed_rows_of_long_documents_meet_targets(spark):
    cfg = mixing.MixConfig(weights=(1.0, 4.0), total_share=1.0)  # targets: 0.4 and 1.6 times the size
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.repeat(F.lit("word "), F.lit(20_000)).alias("text"))
    got = {r.source: r.n for r in mixing.mixed_rows(rows, cfg).groupBy("source").agg((F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).alias("n")).collect()}
    assert got == {"a": 0.4 * 300 * 20_000, "b": 1.6 * 300 * 20_000}


def test_mixed_rows_are_what_the_mix_takes(spark, docs):
    """Per text, the words of the rows are those counted by per_document; repeated and null ids mix nothing up."""
    rows = [(i % 3 if i % 4 else None, " ".join(f"{i}-{j}" for j in range(10 * (i % 7))), "ab"[i % 2], 1, 7) for i in range(60)] + [(1, "b a a", "a", 5, 7)] * 9
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, size int")
    cfg = mixing.MixConfig(block_words=16, shard_blocks=4, bucket_rows=7, copies_a_task=4)
    want, got = Counter(), Counter()
    for r in mixing.plan_mix(table, cfg).taken().collect():
        want[r.doc_id, r.source_key] += r.taken
    out = mixing.mixed_rows(table, cfg)
    assert out.columns == table.columns
    for r in out.collect():
        got[r.doc_id, "s" + r.source] += len(words(r.text))
        assert any(x[0] == r.doc_id and x[2] == r.source and f" {r.text} " in f" {x[1]} " for x in rows)
    assert got == Counter({k: n for k, n in want.items() if n})
    assert mixing.plan_mix(table, cfg).per_document().count() == len(rows)


def test_bpe_is_the_librarys(spark, docs, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    codec = bpe.Codec(bpe.read_vocabulary(queries.tokenizer_path()))
    rng = random.Random(3)
    parts = ["a", "th", " the", "  ", "\n", "\t", "é", "12", "'s", "<|endoftext|>", " ", "日本", "😀", "x.", "\x1c", "--", "Z"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(15))) for _ in range(3000)] + ["ab" * 5000, ""]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for table in (docs, odd):
        for r in bpe.encode_documents(table, queries.tokenizer_path(), ["doc_id", "text"]).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
            assert r.decoded == (r.text or "")


def test_registered_bpe_digests(spark, docs, odd):
    """digest_documents, behind op2, against the library; columns that clash with outputs' names and an empty table."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    clashing = odd.withColumns({"n_tokens": F.lit("x"), "ids_sha256": F.lit("y"), "decoded_sha256": F.lit(None)})
    for table in (docs.select("doc_id", "text"), clashing):
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        got = bpe.digest_documents(table, queries.tokenizer_path(), ["doc_id"])
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert Counter(map(tuple, got.collect())) == want
    assert bpe.digest_documents(odd.limit(0), queries.tokenizer_path(), ["doc_id"]).count() == 0


def test_columns_named_like_outputs(spark, odd):
    """Extra columns of any name change no result of the operators that read doc_id and text alone."""
    names = ["n_shingles", "component_id", "kept", "start", "ids_crc32", "n_words", "labels", "score", "group", "digest", "key", "row"]
    table = odd.drop("score").withColumns({n: F.lit("x") for n in names})

    def frames(rows):
        folder = token_frames.token_folder(spark)
        return token_frames.read_token_digests(token_frames.write_token_files(rows, queries.tokenizer_path(), folder, end_id=2, n_files=2), folder)

    for operator in (near_dup.near_duplicates, license_scan.scan_licenses, frames):
        assert Counter(map(tuple, operator(table).collect())) == Counter(map(tuple, operator(odd).collect()))
    assert near_dup.without_near_duplicates(table).columns == table.columns


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    library, folder = Tokenizer.from_file(queries.tokenizer_path()), token_frames.token_folder(spark)
    manifest = token_frames.write_token_files(odd, queries.tokenizer_path(), folder, end_id=2, n_files=3)
    rows = token_frames.read_token_files(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 4, 6, 7]
    at = 0
    for r, (_, text, *_rest) in zip(rows, sorted(ODD, key=lambda x: x[0] or 0), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    only = token_frames.read_token_files(manifest, folder, wanted=[4]).collect()
    assert [(r.doc_id, r.ids) for r in only] == [(4, rows[5].ids)]
    crc = {r.start: r.ids_crc32 for r in token_frames.read_token_digests(manifest, folder).collect()}
    assert crc == {r.start: zlib.crc32(r.ids) for r in rows}
    empty = token_frames.token_folder(spark)
    assert token_frames.read_token_files(token_frames.write_token_files(odd.limit(0), queries.tokenizer_path(), empty, 2), empty).count() == 0


def components(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges)


def brute_near(rows, k):
    sets = {i: frozenset(zip(*[words(t)[j:] for j in range(min(k, max(1, len(words(t)))))], strict=False)) if words(t) else frozenset() for i, t in rows}
    ids = sorted(sets)
    edges = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= 80 * (len(x) + len(y) - c):
                    edges.append((a, b))
    return sets, components(edges)


def test_near_duplicates(spark, docs, odd):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):  # one group of copies with more and more edits, where links skip members
        w = list(base)
        for _ in range(i // 8):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in (2, 5):
        sets, want = brute_near(rows, k)
        got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDupConfig(shingle_words=k)).collect()}
        assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in got} == {i: (len(sets[i]), want.get(i, i), want.get(i, i) == i) for i in sets}
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 3, False), (None, None, True), (6, 6, True), (7, 7, True)}
    kept = near_dup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def brute_rows(rows, k):
    """Sets of the rows and links between rows, by number."""
    return brute_near(list(enumerate(t for _, t in rows)), k)


def test_near_duplicates_of_repeated_ids(spark):
    """Ids with several texts, null ids, repeated rows and chains, against a plain version over rows."""
    rng = random.Random(9)
    rows = [(1, "a b c d e f g h i j k l"), (1, "one two three four five six seven"), (9, "one two three four five six seven eight"), (5, "p q r s t u v w"), (5, "k l m n o p"), (3, "k l m n o p"), (None, "k l m n o p"), (None, "lonely words here"), (None, None), (1, ""), (77, "")]
    for i in range(90):
        base = [f"g{i % 9}w{j}" for j in range(40)]
        for _ in range(rng.randrange(5)):
            base[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
        rows.append((rng.choice([None, *range(20, 60)]), " ".join(base)))
    rows += rng.sample(rows, 20)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        cfg = near_dup.NearDupConfig(shingle_words=k, block_rows=4)
        sets, group = brute_rows(rows, k)
        edges = [(("row", group.get(i, i)), ("id", d)) for i, (d, _) in enumerate(rows) if d is not None]
        joined = components([(a, b) for b, a in edges])
        least = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                top = joined[("id", d)]
                least[top] = min(d, least.get(top, d))
        want = Counter((d, len(sets[i]), None if d is None else least[joined[("id", d)]]) for i, (d, _) in enumerate(rows))
        got = near_dup.near_duplicates(table, cfg).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
        first = {}
        for i, (d, t) in enumerate(rows):
            g = ("alone", i) if not sets[i] else group.get(i, i) if i in group else ("set", sets[i])
            first.setdefault(g, []).append((d is None, d or 0, t or ""))
        kept = near_dup.without_near_duplicates(table, cfg).collect()
        assert len(kept) == len(first)
        assert Counter(r.doc_id for r in kept) == Counter(None if min(x)[0] else min(x)[1] for x in first.values())


def test_language(spark, docs, odd, smoke_dir):
    got = queries.op4_language_id(spark, smoke_dir).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    assert got.filter("held_out AND n > 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0
    out = identify_languages(odd, learn_languages(docs), odd.columns, prefix="__").collect()
    assert len(out) == len(ODD)
    und = {r["doc_id"] for r in out if r["__lang_pred"] == "und"}
    assert und == {1, 2, 6}
    assert {r["lang_pred"] for r in identify_languages(odd, {}, ["doc_id"]).collect()} == {"und"}
    assert identify_languages(odd.limit(0), learn_languages(docs), ["doc_id"]).count() == 0 and learn_languages(docs.limit(0)) == {}
    with pytest.raises(ValueError, match="both kept and added"):
        identify_languages(odd, {}, odd.columns)


def test_no_language_is_forgotten(spark):
    """Whatever ids repeat or are null; and no row's copies fill a dictionary."""
    rows = [(7, "the quick brown fox", "en")] * 400 + [(None, f"der schnelle braune Fuchs {i} springt", "de") for i in range(400)] + [(8, "x" * 5000 + "un renard brun", "fr")]
    cfg = LangConfig(sample_docs=8)
    model = learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), cfg)
    assert sorted(model) == ["de", "en", "fr"]
    assert model["en"] == b"the quick brown fox" and model["de"].count(b"fuchs") == 8
    assert all(len(d) <= cfg.dict_bytes for d in model.values())
    texts = ["der braune Fuchs", "the brown fox", None, "12"]
    got = identify_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"], cfg)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {0: "de", 1: "en", 2: "und", 3: "und"}


def test_language_scores_are_the_smallest_sizes(spark, docs):
    """Against sizes summed chunk by chunk with fresh compressors."""
    import zstandard as zstd

    model, cfg = learn_languages(docs), LangConfig()
    params = zstd.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=1, min_match=3, strategy=zstd.STRATEGY_BTOPT, write_content_size=False)
    for r in identify_languages(docs, model, ["doc_id", "text"]).limit(60).collect():
        data, sizes = spelled(r.text or ""), {}
        if not data.strip():
            continue
        for lang, d in model.items():
            made = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(made.compress(data[i : i + cfg.chunk_bytes])) for i in range(0, len(data), cfg.chunk_bytes))
        best, rest = sorted(sizes.values())[:2]
        margin = (rest - best) / rest
        assert r.lang_pred == min(model, key=lambda x: (sizes[x], x))
        assert r.score == pytest.approx(min(1.0, margin / (margin + 0.02)) if margin else 0.0) and r.rejected == (margin < cfg.min_margin)


def test_quality(spark, docs, odd, smoke_dir):
    labels = read_table(spark, smoke_dir, "labels")
    got = queries.op9_quality(spark, smoke_dir).join(labels, "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.9
    model, _ = quality.learn_quality(docs, labels)
    out = quality.score_documents(odd, model, odd.columns, prefix="__").collect()
    assert len(out) == len(ODD) and all(0 <= r["__score"] <= 1 for r in out)
    none, features = quality.learn_quality(odd, labels.limit(0))
    assert {r.score for r in quality.score_features(features, none).collect()} == {0.5}


def plain_quality(rows, held_in):
    """Scores of (doc_id, text) by Gaussian densities written out, from labels {doc_id: 0 or 1}."""
    cfg, d = quality.QualityConfig(), len(quality.FEATURES)
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in rows}
    by = {c: np.array([x[i] for i, q in held_in.items() if q == c and i in x]) for c in (0, 1)}
    mean = {c: v.mean(axis=0) for c, v in by.items()}
    own = {c: (v - mean[c]).T @ (v - mean[c]) / len(v) for c, v in by.items()}
    total = sum(len(v) for v in by.values())
    pooled = sum(own[c] * len(by[c]) for c in by) / total

    def log_density(c, z):
        cov = (1 - cfg.to_pooled) * own[c] + cfg.to_pooled * pooled
        cov = (1 - cfg.to_diagonal) * cov + cfg.to_diagonal * np.diag(np.diag(cov)) + cfg.floor * np.eye(d)
        return math.log(len(by[c]) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (z - mean[c]) @ np.linalg.inv(cov) @ (z - mean[c])

    return {i: 1 / (1 + math.exp(min(700, max(-700, log_density(0, z) - log_density(1, z))))) for i, z in x.items()}


def test_quality_is_the_discriminant(spark, docs, smoke_dir):
    labels = {r.doc_id: r.quality for r in read_table(spark, smoke_dir, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    want = plain_quality([(r.doc_id, r.text) for r in docs.collect()], labels)
    got = queries.op9_quality(spark, smoke_dir).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    few = spark.createDataFrame([(docs.first().doc_id, 1, 0)], "doc_id long, quality int, toxic int")
    model, features = quality.learn_quality(docs, few)
    assert {r.score for r in quality.score_features(features, model).collect()} == {1.0}
    assert quality.learn_quality(docs.limit(0), few)[1].count() == 0


def test_lm_score(spark, docs, odd):
    train = docs.filter("doc_id % 5 <> 1")
    got = lm_score.score_texts(docs.unionByName(odd.drop("score")), train).collect()
    counts, n = Counter(), 0
    for r in train.select("text").collect():
        counts.update(words(r.text))
        n += len(words(r.text)) + 1
    counts[None] = train.count()
    log_all = math.log10(n + 0.5 * (len(counts) + 1))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        if r.doc_id in text and r.doc_id not in (1, 2, 3, 4, 6, 7, None):
            w = [*words(text[r.doc_id]), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10(counts[x] + 0.5) - log_all for x in w), rel=1e-9)
    assert all(r.score < 0 for r in got) and len(got) == docs.count() + len(ODD)
    assert sum(r.bits_per_byte for r in got if r.n_tokens > 50) / sum(r.n_tokens > 50 for r in got) < 3.5
    untrained = lm_score.score_texts(odd, odd.limit(0)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.bits_per_byte == pytest.approx(8, abs=1e-4) for r in untrained)


def test_lm_score_against_one_bucket(spark, docs, odd):
    """Scores by the same weights with all sequences of the corpus in one place, and no table of frequent ones."""
    cfg, train = lm_score.LmConfig(bucket_grams=5000, hot_grams=3000), docs.filter("doc_id % 5 <> 1")
    grams = lm_score.corpus_counts(train).filter("kind = 0").select("key", "n")
    counted = {r.key: r.n for r in grams.collect()}
    low, (packs, _) = lm_score.low_counts(grams), lm_score.bucketed(grams, cfg)
    model = lm_score.learn_mixer(packs, low, cfg)
    table = docs.limit(60).unionByName(odd.drop("score"))
    texts = table.select("doc_id", "text").collect()
    of = [lm_score.grams_of([words(r.text)])[0] for r in texts]
    every = np.array(sorted({*counted, *np.concatenate(of).astype(np.int64).tolist()}))
    n = np.array([counted.get(k, 0) for k in every.tolist()])
    bucket = lm_score.Bucket(every.astype(np.uint64), n, lm_score.LowTables(*low))
    log2 = dict(zip(every.tolist(), lm_score._scored(model, bucket, np.arange(len(every))).tolist(), strict=True))
    want = sorted((r.doc_id or 0, round(math.log10(2) * sum(log2[k] for k in g.astype(np.int64).tolist()), 2)) for r, g in zip(texts, of, strict=True))
    got = sorted((r.doc_id or 0, round(r.score, 2)) for r in lm_score.score_texts(table, train, cfg).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-4, abs=0.02)
    assert lm_score.score_texts(docs.limit(0), train).count() == 0


def test_lm_score_has_every_context(spark, docs):
    """No context shares a slot, and sequences that are joined score like those that go to the tasks."""
    train = docs.filter("doc_id % 5 <> 1")

    def scores(**settings):
        return {r.doc_id: r.score for r in lm_score.score_texts(docs, train, lm_score.LmConfig(**settings)).collect()}

    want = scores()
    assert scores(slot_bits=(16, 10, 10, 10, 10)) == pytest.approx(want, rel=1e-5)
    assert scores(hot_grams=500) == pytest.approx(want, rel=1e-5)


def test_bit_model_is_a_distribution():
    cfg = lm_score.LmConfig()
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 50, (1 << b, 2)).astype(np.uint16) for b in cfg.slot_bits]
    m = lm_score.Mixer(tables, cfg, refined=rng.uniform(0.01, 0.99, (256, cfg.map_bins)))
    context = np.uint64(0x6162636465) << np.uint64(8)
    assert np.exp2(m.log2(context + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=1500, d=16):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[700:760] = x[50]  # copies: ties
    rows = [(i, x[i].tolist(), 0) for i in range(n)]
    return rows, spark.createDataFrame([*rows, (5000, None, 0), (None, x[1].tolist(), 0), (5050, [0.0] * d, 0), (5100, [float("nan")] * d, 0), (5150, [1.0] * 3, 0)], VECTORS)


def test_nearest(spark):
    rows, table = vectors(spark)
    x = np.array([r[1] for r in rows], dtype=np.float64)
    got = ann.nearest(table, "vec_id % 50 = 0").collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 50))  # 5150 has no candidate of its length
    hit = 0
    for q, found in by.items():
        s = (x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        s[q] = -9
        hit += len({v for _, v, _ in found} & set(np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()))
        assert sorted(r for r, _, _ in found) == [1, 2, 3, 4, 5]
        assert all(abs(score - s[v]) < 1e-12 for _, v, score in found)
    assert hit >= 0.9 * 5 * len(by)
    assert ann.nearest(table.limit(0), "vec_id % 50 = 0").count() == 0


def test_topk(spark):
    rows, table = vectors(spark)
    v = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 1024).astype(np.int64)
    small = topk.TopKConfig(resolved=12, grid=topk.GridConfig(block_rows=400))
    for cfg in (None, small):
        got = {}
        for r in topk.best_products(table, "vec_id % 100 = 0", cfg).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        # zero vectors take part here, as candidates too
        ids = np.append(np.arange(1500), 5050)
        for q in range(0, 1500, 100):
            s = np.append(v @ v[q], 0)
            keep = ids != q
            order = np.lexsort((ids[keep], -s[keep]))[:10]
            assert [got[q][i + 1] for i in range(10)] == list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))


def test_repeated_vectors_and_large_products(spark):
    """Ids that repeat, many equal vectors, products beyond 2**53, an empty table; exact for op10, whole for op5."""
    rng = np.random.default_rng(4)
    rows = [(i % 40, rng.standard_normal(4).tolist(), 0) for i in range(300)] + [(100 + i, [1.0, 2.0, 0.5, 0.0], 0) for i in range(200)] + [(100, [1.0, 2.0, 0.5, 0.0], 0)] * 30
    rows += [(500, [9e5, -3e5, 2.5, 1.0], 0), (501, [1.5e6, 1.0, -2.5, 0.0], 0), (502, [2.0**22, -3.0, 0.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows]
    for size in (64, 16384):
        got = {}
        for r in topk.best_products(table, "vec_id % 100 = 0", topk.TopKConfig(resolved=12, grid=topk.GridConfig(block_rows=size))).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {0, 100, 200, 500}
        for q, found in got.items():
            mine = min(v for i, v in whole if i == q)
            best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in whole if i != q)[:10]
            assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
        near = ann.nearest(table.filter("vec_id < 400"), "vec_id % 50 = 0", ann.AnnConfig(grid=topk.GridConfig(block_rows=size))).collect()
        asks = {0, 100, 150, 200, 250}
        assert {r.query_id for r in near} == asks and len(near) == 5 * len(asks)
        assert all(r.score == pytest.approx(1) for r in near if r.query_id >= 100)
        assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == 150] == [100] * 5
    assert topk.best_products(table.limit(0), "vec_id % 100 = 0").count() == 0


def test_licenses(spark, odd):
    import re

    pattern = re.compile(license_scan.WORD)
    texts = ["MIT  License mit-license, MIT\nlicense", "éMIT License", "cc by cc by CC-BY", None, "", "xgnu general public license gnu General. Public License", "MIT licenses", "Licensed under the Apache License, Version 2.0."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "cc by"), (2, "other text")]
    got = sorted(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    want = []
    for i, t in rows:
        w = pattern.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        at = {label: [j for j in range(len(w)) if w[j : j + len(p.split())] == p.split()] for p, label in license_scan.PHRASES}
        every = sorted(x for v in at.values() for x in v)
        want.append((i, len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v))))
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    notice = license_scan.TEMPLATES[1][0]
    whole = license_scan.scan_licenses(spark.createDataFrame([(1, f"/* {notice.title()}. */ int main()"), (2, notice[: len(notice) // 2])], "doc_id long, text string"))
    assert {r.doc_id: (r.labels, r.score) for r in whole.collect()} == {1: ("apache,apache-2.0", 1.0), 2: ("apache,apache-2.0", 1.0)}  # its first line says so already
    with pytest.raises(ValueError, match="may lie in no block"):
        license_scan.LicenseConfig(block_words=200, block_step=100)
    assert license_scan.scan_licenses(odd).count() == len(ODD)
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0


def test_template_join_is_exact(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["filler"] * 40
    rows = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(900))]
        at = rng.randrange(len(body) + 1)
        t = rng.choice(license_scan.TEMPLATES)[0].split()
        rows.append((i, " ".join(body[:at] + [w for w in t if rng.random() < 0.93] + body[at:])))
    cfg = license_scan.LicenseConfig()
    got = {(r.doc_id, r.first_word, r.template) for r in license_scan.template_matches(spark.createDataFrame(rows, "doc_id long, text string"), cfg).collect()}
    want = set()
    for i, text in rows:
        w = text.split()
        for s in range(0, max(len(w) - cfg.block_words + cfg.block_step - 1, 0) + 1, cfg.block_step):
            block = set(w[s : s + cfg.block_words])
            for k, (t, _) in enumerate((*cfg.templates, *cfg.short)):
                share = cfg.containment if k < len(cfg.templates) else 1.0
                if len(block & set(t.split())) >= math.ceil(round(share * len(set(t.split())), 6)) and (share < 1 or f" {t} " in f" {' '.join(w)} "):
                    want.add((i, s, k))
    assert got == want and want


def test_pipeline(spark, smoke_dir, odd):
    import corpus_pipeline as p

    rows = p.run(spark, smoke_dir).collect()
    assert rows and all(r.round_trip for r in rows)
    docs = odd.drop("score")
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), smoke_dir).count() == 0


def test_pipeline_against_a_plain_version(spark, smoke_dir, odd):
    """Each stage on its own input: which rows stay, the words of each source, the ids of each text."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    extra = odd.drop("score").filter("doc_id IS NULL OR doc_id < 7").select(F.when(F.col("doc_id") < 5, F.lit(9001)).otherwise(F.col("doc_id") + 9000).alias("doc_id"), *names[1:])
    at = read_table(spark, smoke_dir, "documents").unionByName(extra)
    stages, found = dict(p.STAGES), {"documents": at.collect()}
    for name, stage in p.STAGES:
        at = stage(spark, at, smoke_dir)
        assert name == "bpe" or at.columns == names
        found[name] = at.collect()
        at = at if name == "bpe" else spark.createDataFrame(found[name], at.schema)
    count = lambda rows: Counter((r.doc_id, r.text) for r in rows)

    docs = spark.createDataFrame(found["documents"], read_table(spark, smoke_dir, "documents").schema)
    clear = identify_languages(docs, learn_languages(docs), ["doc_id", "text"]).filter("NOT rejected").collect()
    assert count(found["language"]) == count(clear) and len(clear) > 150

    labels = {r.doc_id: r.quality for r in read_table(spark, smoke_dir, "labels").collect()}
    once = {r.doc_id: r.text for r in found["language"] if r.doc_id is not None}
    score = plain_quality(list(once.items()), labels)
    good = [r for r in found["language"] if r.doc_id is not None and r.doc_id < 9000 and score[r.doc_id] >= 0.7]
    assert count(r for r in found["quality"] if r.doc_id is not None and r.doc_id < 9000) == count(good)

    texts = [(r.doc_id, r.text) for r in found["quality"]]
    sets, group = brute_rows(texts, 5)
    first = {}
    for i, (d, _) in enumerate(texts):
        g = ("alone", i) if not sets[i] else group.get(i, ("set", sets[i]))
        first.setdefault(g, []).append((d is None, d or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in found["near_dup"]) == Counter(min(x) for x in first.values())

    size, taken = Counter(), Counter()
    for r in found["near_dup"]:
        size[r.source] += len(words(r.text))
    for r in found["mix"]:
        taken[r.source] += len(words(r.text))
    order = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    want = targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert {s: taken[s] for s in order} == pytest.approx({s: want[i] for i, s in enumerate(order)}, abs=1)
    whole = {(r.doc_id, r.source): f" {' '.join((r.text or '').split())} " for r in found["near_dup"]}
    assert all(f" {' '.join(r.text.split())} " in whole[r.doc_id, r.source] for r in found["mix"])

    library = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((r.doc_id, r.source, np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in found["mix"])
    assert Counter((r.doc_id, r.source, bytes(r.ids)) for r in found["bpe"]) == want and stages
