"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filelens.llm.common import read_table, split_of


def tokenizer_path() -> str:
    """The vocabulary file, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.mixing import mix_documents

    return mix_documents(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.bpe import digest_documents

    return digest_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.near_dup import NearDupConfig, near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), NearDupConfig(shingle_words=2))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.language_id import identify_languages, learn_languages

    docs = read_table(spark, sf_dir, "documents")
    held_out = split_of(docs["doc_id"], 5) == 0
    model = learn_languages(docs.filter(~held_out))
    found = identify_languages(docs, model, ["doc_id"])
    return found.withColumn("held_out", split_of(found["doc_id"], 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.lm_score import score_texts

    docs = read_table(spark, sf_dir, "documents")
    scored = score_texts(docs, docs.filter(split_of(docs["doc_id"], 5) != 1))
    held_out = (split_of(scored["doc_id"], 5) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.token_frames import read_token_digests, token_folder, write_token_files

    folder = token_folder(spark)
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path(), folder, end_id=2)
    return read_token_digests(manifest, folder)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.license_scan import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.quality import learn_quality, score_features

    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    model, features = learn_quality(docs, labels.filter(split_of(labels["doc_id"], 4) != 2))
    scored = score_features(features, model)
    return scored.withColumn("held_out", split_of(scored["doc_id"], 4) == 2).select("doc_id", "held_out", "score", "predicted")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.topk import best_products

    return best_products(read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.periodic_runs import looped, periodic_runs

    return periodic_runs(read_table(spark, sf_dir, "documents"), change=looped)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.sharding import shard_documents

    return shard_documents(read_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelens.llm.lexical_search import build_index, search

    return search(build_index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_near_dup": op3_near_dup,
    "op4_language_id": op4_language_id,
    "op5_nearest": op5_nearest,
    "op6_lm_score": op6_lm_score,
    "op7_token_frames": op7_token_frames,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of two-word shingles; all pairs that share one, counted; then the smallest id reachable.
_NEAR_DUP_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
top AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN top ON a = doc_id
"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _license_sql() -> str:
    from filelens.llm.license_scan import WORD, LicenseConfig

    cfg = LicenseConfig()
    phrases = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in cfg.phrases)
    kinds = [(t, label, cfg.containment) for t, label in cfg.templates] + [(t, label, 1.0) for t, label in cfg.short]
    templates = ", ".join(f"(string_split('{t}', ' '), list_distinct(string_split('{t}', ' ')), '{label}', {share})" for t, label, share in kinds)
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS ws, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ls FROM documents),
p(phrase, label) AS (VALUES {phrases}), t(line, tw, label, share) AS (VALUES {templates}),
spot AS (SELECT r, label, unnest([i FOR i IN range(len(ws)) IF ws[i + 1 : i + len(phrase)] = phrase]) AS i FROM w, p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM spot GROUP BY r),
block AS MATERIALIZED (SELECT r, s, list_distinct(ls[s + 1 : s + {cfg.block_words}]) AS bw FROM (SELECT r, ls, unnest(range(0, greatest(len(ls) - {cfg.block_words} + {cfg.block_step} - 1, 0) + 1, {cfg.block_step})) AS s FROM w)),
vocabulary AS (SELECT list_distinct(flatten(list(tw))) AS vw FROM t),
cut AS MATERIALIZED (SELECT r, s, list_intersect(bw, vw) AS bw FROM block, vocabulary),
held AS MATERIALIZED (SELECT r, s, label, share, line, len(list_intersect(bw, tw)) / CAST(len(tw) AS DOUBLE) AS containment FROM cut, t WHERE len(bw) > 1 AND len(list_intersect(bw, tw)) >= ceil(round(len(tw) * share, 6))),
stands AS (SELECT h.r, label, containment FROM held h JOIN w ON w.r = h.r WHERE share < 1 OR len([i FOR i IN range(len(ls)) IF ls[i + 1 : i + len(line)] = line]) > 0),
more AS (SELECT r, max(containment) AS containment, list(DISTINCT label) AS labels FROM stands GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


def _sharding_sql() -> str:
    """The hash slot, the three versions of the map and the number in the shard; crc32 by its definition, four bits a step."""
    from filelens.llm.sharding import ShardConfig

    c = ShardConfig()
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(16), lambda i: list_reduce([i, 1, 2, 3, 4], lambda x, y: {step})) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {c.slots} AS slot FROM documents),
h AS (SELECT *, regexp_replace(hex(encode(text)), '(.)(.)', '\\2\\1', 'g') AS h FROM d),
rec AS MATERIALIZED (SELECT r, doc_id, slot, octet_length(encode(text)) + {c.row_bytes} AS size, CASE WHEN text = '' THEN 0 ELSE
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(h, ''), lambda x: instr('0123456789ABCDEF', x) - 1)), lambda x, y: xor(x >> 4, tab[(xor(x, y) & 15) + 1])), 4294967295) END AS crc FROM h, tab),
load AS (SELECT slot, sum(size) AS bytes FROM rec GROUP BY slot),
v1 AS (SELECT i AS slot, i % {c.shards} AS shard, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM range({c.slots}) t(i) LEFT JOIN load ON load.slot = i),
turns AS (SELECT slot, shard, count(*) OVER (PARTITION BY shard) - row_number() OVER (PARTITION BY shard ORDER BY slot DESC) AS others FROM v1),
v2 AS (SELECT slot, CASE WHEN row_number() OVER (ORDER BY others DESC, shard) <= {c.slots // (c.shards + 1)} THEN {c.shards} ELSE shard END AS shard FROM turns),
sums AS (SELECT *, sum(bytes) OVER (PARTITION BY shard) AS held, (sum(bytes) OVER ()) // {c.shards} AS mean, sum(bytes) OVER (PARTITION BY shard ORDER BY slot) AS through FROM v1),
marked AS (SELECT *, held * 100 > mean * {100 + c.tolerance_pct} AND through > mean AS moves FROM sums),
going AS (SELECT slot, coalesce(sum(bytes) OVER (ORDER BY shard, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked WHERE moves),
room AS (SELECT shard, max(mean) - coalesce(sum(bytes) FILTER (WHERE NOT moves), 0) AS room FROM marked GROUP BY shard),
rooms AS (SELECT shard, sum(room) OVER (ORDER BY shard) - room AS low, lead(shard) OVER (ORDER BY shard) IS NULL AS is_last, sum(room) OVER (ORDER BY shard) AS high FROM room WHERE room > 0),
v3 AS (SELECT v1.slot, coalesce(rooms.shard, v1.shard) AS shard FROM v1 LEFT JOIN going USING (slot) LEFT JOIN rooms ON before >= low AND (before < high OR is_last))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(v1.shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY v1.shard ORDER BY slot, doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot,
  CAST(v2.shard AS INTEGER) AS grown_shard, CAST(slot AS INTEGER) AS virtual_slot, CAST(v3.shard AS INTEGER) AS balanced_shard
FROM rec JOIN v1 USING (slot) JOIN v2 USING (slot) JOIN v3 USING (slot)
"""


def _search_sql() -> str:
    from filelens.llm.lexical_search import SearchConfig

    c = SearchConfig()
    terms = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS t FROM benchmark),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY t, docs),
part AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + {c.saturation} * ({c.floor} + ({c.spread} * n * docs) // terms))) AS part FROM tf JOIN w USING (t) JOIN n USING (r), corpus),
s AS (SELECT i, item_id, r, CAST(sum(part) AS BIGINT) AS score FROM i JOIN part USING (t) GROUP BY i, item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {c.top}
"""


#: The other operators draw, learn or read a vocabulary, which SQL can't; tests hold them against plain versions; periods up to a third of a text are too many for SQL.
ORACLE_SQL: dict[str, str] = {"op3_near_dup": _NEAR_DUP_SQL, "op8_license_scan": _license_sql(), "op10_topk": _TOPK_SQL, "op12_sharding": _sharding_sql(), "op13_lexical_search": _search_sql()}
