"""Run detection, sharding and lexical search against plain versions, and what they do with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from filelens.llm.lexical_search import SearchConfig, build_index, search, terms_of
from filelens.llm.periodic_runs import RunConfig, SquareCatchers, collapsed, looped, periodic_runs, runs_of, strongest
from filelens.llm.queries import QUERIES
from filelens.llm.sharding import ShardConfig, SlotMaps, first_map, grown, numbered, rebalanced, shard_documents


def plain_runs(w, least=24, times=3):
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > a and i - a + p >= max(least, times * p):
                piece = w[a : i + p]
                if not any(piece[q:] == piece[:-q] for q in range(1, p)):
                    found.append((a, len(piece), p))
            i += i == a
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng, n):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 30 else 0):
        a = rng.randrange(n - 10)
        p = rng.randrange(1, max(2, (n - a) // 3))
        for i in range(a, min(n, a + p * rng.randrange(3, 8) + rng.randrange(p + 1))):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_a_plain_search_in_any_strides():
    rng = random.Random(3)
    for _ in range(150):
        words = some_words(rng, rng.choice([1, 23, 24, 40, 100, 220]))
        stride = rng.choice([1, 2, 5, 16, 33, 1 << 15])
        assert runs_of([words], RunConfig(stride=stride)) == [plain_runs(words)]
        assert runs_of([words], RunConfig(2, 2, stride)) == [plain_runs(words, 2, 2)]
    texts = [some_words(rng, rng.choice([0, 5, 30, 90])) for _ in range(60)]
    assert runs_of(texts, RunConfig(stride=64)) == [plain_runs(w) for w in texts]
    assert runs_of([texts[0]] * 3) == [plain_runs(texts[0])] * 3  # equal texts side by side are no run


def test_runs_are_seen_while_words_come():
    import numpy as np

    catchers = SquareCatchers(4, 2)
    seen = []
    for code in [5, 7, 5, 7, 5, 9, 9, 9, 9]:
        catchers.append(np.array([code]))
        seen.append(catchers.runs())
    assert seen[2] == [] and seen[3] == [(0, 4, 2)] and seen[4] == [(0, 5, 2)] and seen[-1] == [(0, 5, 2), (5, 4, 1)]


def test_long_runs_of_one_word():
    words = [b"a"] * 50000 + [b"b", b"c"] * 30000
    runs = runs_of([words])[0]
    assert runs == [(0, 50000, 1), (50000, 60000, 2)]
    assert collapsed(words, runs) == b"a b c"
    assert strongest(runs) == (0, 50000, 1) and strongest([(9, 48, 2), (3, 72, 3), (3, 24, 1)]) == (3, 24, 1)


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (None, "a b " * 20, "x"), (4, "a b " * 20, "x"), (4, "a b " * 20, "x"), (5, "q r " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = {(r.doc_id, i): r for i, r in enumerate(periodic_runs(docs).orderBy("doc_id").collect())}
    empty = hashlib.sha256(b"").hexdigest()
    by = {}
    for (d, _), r in got.items():
        by.setdefault(d, []).append(r)
    for d in (1, 2, 3):
        assert [tuple(r) for r in by[d]] == [(d, 0, None, None, None, None, empty, empty)]
    assert len(by[4]) == 2 and tuple(by[4][0])[1:6] == (1, 0, 40, 2, 20000) and by[4][0].collapsed_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert tuple(by[None][0])[1:6] == (1, 0, 40, 2, 20000)
    assert tuple(by[5][0])[1:6] == (1, 0, 30, 1, 30000)  # a no-break space parts no words
    assert periodic_runs(docs.filter("doc_id > 99")).count() == 0


def test_registered_runs_equal_a_plain_version(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, smoke_dir).collect()}
    assert len(got) == len(docs)
    word, changed = re.compile(rb"[^\x20\x09-\x0D]+"), 0
    for d in docs:
        words = word.findall((d.text or "").encode())
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words, changed = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], changed + 1
        assert looped(word.findall((d.text or "").encode()), d.doc_id) == words
        if n > 3000:
            continue  # the plain search takes the square of it
        runs = plain_runs(words)
        dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[d.doc_id]
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert changed > 5


def test_shards_of_odd_rows(spark):
    rows = [(1, "a", 9), (1, "a", 9), (1, "b", 9), (None, None, 9), (None, "", 9), (2, "é" * 40000, 9), (-3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_documents(docs, ShardConfig(shards=3, slots=64)).collect()
    assert len(got) == 7 and {r.law for r in got} == {"key"}
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and all(r.grown_shard in (r.shard, 3) for r in got)
    assert shard_documents(docs.limit(0)).count() == 0


def test_a_hot_key_is_numbered_by_many_tasks(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "'s' AS shard")
    got = numbered(rows, "shard", ["k"])
    assert sorted(r.number for r in got.collect()) == list(range(6000))


def test_maps_grow_and_are_rebalanced(spark, tmp_path):
    config = ShardConfig(shards=5, slots=1000)
    maps = SlotMaps(spark, f"file://{tmp_path}/maps")
    one = maps.publish(first_map(spark, config), 1)
    two = maps.publish(grown(one, 5, 1000), 2)
    with pytest.raises(Exception, match="already exists"):
        maps.publish(one, 2)
    was, now = ({r.slot: r.shard for r in m.collect()} for m in (one, two))
    assert len(now) == 1000 and all(now[s] in (was[s], 5) for s in was)
    assert sorted(Counter(now.values()).values()) == [166, 166, 167, 167, 167, 167]
    three = grown(two, 6, 1000)
    assert sorted(Counter(r.shard for r in three.collect()).values()) == [142, 143, 143, 143, 143, 143, 143]
    load = {s: (s % 5 + 1) * 100 + s % 7 for s in was if s % 11}
    even = {r.slot: r.shard for r in rebalanced(one, spark.createDataFrame(list(load.items()), "slot int, bytes long"), 5, config).collect()}
    sums, mean = Counter(), sum(load.values()) // 5
    for s, b in load.items():
        sums[even[s]] += b
    assert len(even) == 1000 and set(even.values()) == set(range(5)) and all(abs(x - mean) <= max(mean // 100, 600) for x in sums.values())
    assert sum(even[s] != was[s] for s in load) < 300
    assert {r.slot: r.shard for r in rebalanced(one, spark.createDataFrame([], "slot int, bytes long"), 5, config).collect()} == was
    assert maps.versions().groupBy("version").count().count() == 2


def plain_search(docs, items, top):
    ds = [(i, Counter(w), len(w)) for i, w in ((i, plain_terms(t)) for i, t in docs) if w]
    n_docs, length = len(ds), sum(n for *_, n in ds)
    df = Counter(t for _, c, _ in ds for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in ds:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def test_terms():
    for text in ("Ab-cd_9 É é ß\x7fx", "", "...", "İI"):
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def test_search_equals_a_plain_version_with_small_blocks(spark, smoke_dir):
    docs, items = (spark.read.parquet(f"{smoke_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    for config in (SearchConfig(), SearchConfig(block_terms=3000, item_terms=400, first_blocks=1)):
        assert sorted((tuple(r) for r in search(build_index(docs, config), items).collect()), key=str) == want


def test_search_of_odd_rows(spark):
    docs = [(1, "cat dog", 0), (1, "cat dog", 0), (None, "cat dog", 0), (2, None, 0), (3, "", 0), (4, "-- !", 0), (5, "cat " * 5000, 0), (6, "bird", 0)] + [(i, "cat dog", 0) for i in range(30, 60)]
    items = [(1, "Cat, cat; DOG", 0), (2, None, 0), (3, "", 0), (4, "fish", 0), (None, "bird", 0), (5, "dog", 0)]
    d, i = (spark.createDataFrame(x, f"{k} long, text string, score int") for x, k in ((docs, "doc_id"), (items, "item_id")))
    got = search(build_index(d, SearchConfig(block_terms=8)), i).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_search([x[:2] for x in docs], [x[:2] for x in items], 20)
    assert [r.rank for r in sorted(got, key=lambda r: r.rank) if r.item_id == 1] == list(range(1, 21))
    assert search(build_index(d.limit(0)), i).count() == 0 and search(build_index(d), i.limit(0)).count() == 0


def test_products_of_any_size(spark):
    """Vectors of every finite size take part, read in bounds; a best score beyond 64 bits is an error."""
    from filelens.llm import topk

    schema = "vec_id long, embedding array<double>"
    rng = random.Random(8)
    rows = [(0, [2.0**-10, 0.0, 0.0, 3 * 2.0**-10])] + [(i, [2.0 ** rng.randrange(30, 51), 1e300 if i == 7 else 0.0, 1e308, -rng.random() * 2.0**40]) for i in range(1, 60)]
    whole = {i: [int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[0], v, strict=True)), i) for i, v in whole.items() if i)[:10]
    for size in (16, 1024):
        cfg = topk.TopKConfig(resolved=11, grid=topk.GridConfig(block_rows=size))
        got = topk.best_products(spark.createDataFrame(rows, schema), "vec_id = 0", cfg).collect()
        assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
    for far in (2.0**60, -(2.0**60)):
        few = spark.createDataFrame([(0, [1.0]), (1, [far])], schema)
        with pytest.raises(Exception, match="64-bit number"):
            topk.best_products(few, "vec_id = 0").collect()


def test_whole_pieces_of_whole_texts_fill_a_dictionary(spark):
    """In a script of two bytes a letter: no piece is cut, and one text's pieces come from all of it."""
    from filelens.llm.language_id import LangConfig, learn_languages

    word = "".join(chr(0x430 + i) for i in range(31))
    rng = random.Random(2)
    text = " ".join("".join(rng.choice(word) for _ in range(9)) for _ in range(12000))
    rows = [(1, text, "ru"), (2, "коротко", "ru"), (3, "ab " * 3000, "xx")]
    cfg = LangConfig(dict_bytes=20_000, piece_chars=512)
    model = learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), cfg)
    pieces = [text[i : i + 512] for i in range(0, len(text), 512)]
    held = [p for p in pieces if p.encode() in model["ru"]]
    assert len(model["ru"]) <= 20_000 and 18 <= len(held) <= 21 and "коротко".encode() in model["ru"]
    assert any(pieces.index(p) > len(pieces) // 2 for p in held) and model["ru"].decode()  # ends with a whole letter
    assert len(model["xx"]) > 8000


def test_short_notices_change_labels(spark):
    from filelens.llm.license_scan import LicenseConfig, scan_licenses

    rows = [
        (1, "// SPDX-License-Identifier: BSD-3-Clause\nint main() {}"),
        (2, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (3, "Photo: licensed under CC BY-NC 2.0, by the author"),
        (4, "Released under the MIT License."),
        (5, "a license to identify; the mit of old"),
        (6, "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
        (8, "licensed under cc by 4 words and 0 more"),
        (7, "spdx identifier " + "word " * 600 + "license mit"),  # in no block together
    ]
    got = {r.doc_id: (r.base_labels, r.labels, r.score) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: ("", "bsd-3-clause", 1.0), 2: ("", "cc-by-sa-4.0", 1.0), 3: ("cc-by", "cc-by,cc-by-nc-2.0", 1.0), 4: ("mit", "mit", 1.0), 5: ("", "", 0.0), 6: ("", "bsd-3-clause", 1.0), 7: ("", "", 0.0), 8: ("cc-by", "cc-by", 1.0)
    }
    assert len({n.form for n in LicenseConfig().notices() if n.form}) == len(LicenseConfig().short) > 80
