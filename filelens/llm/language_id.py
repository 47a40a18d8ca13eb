"""Language identification by compression.

Every language has a raw-content zstandard dictionary of sample text. A text is
cut into chunks; each chunk is compressed with every dictionary, and the
language whose compressed sizes sum to the least wins. A narrow margin between
the two best rejects the text.

Results: null texts and texts without a letter are ``und``, score 0, rejected. An
empty training table learns no language, and then every text is ``und``; an empty
table gives an empty result. Equal sizes go to the first language in code point
order. Only the columns named are read, ids may be null or repeat; whole texts of
any length are compressed.

The model is fitted on a bounded sample of rows, as documented in ``LangConfig``: of each
language the ``sample_docs`` rows with the smallest hashes of id and text, equal rows once.
Their whole texts are cut into pieces of ``piece_chars`` characters; in a hashed order
within each text, first a piece of every text, then a second of those that have one, and so
on, whole pieces are taken until a dictionary's bytes are full. No piece is cut again, so
scripts of any number of bytes a character have whole pieces. Every language that has rows
has some in the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.llm.common_arrow import map_texts

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def spelled(text: str) -> bytes:
    """The text's letters in lower case, runs of all else as one space: marks and digits tell no language."""
    return OTHER.sub(" ", text.lower()).encode()


@dataclass(frozen=True)
class LangConfig:
    sample_docs: int = 96
    piece_chars: int = 1024
    pieces: int = 480  # read of one language, from which its dictionary is filled
    dict_bytes: int = 120 << 10
    chunk_bytes: int = 4096
    min_margin: float = 0.002
    max_languages: int = 512  # bounds what goes to every task: max_languages * dict_bytes


def learn_languages(train: DataFrame, cfg: LangConfig | None = None) -> dict[str, bytes]:
    """The dictionaries, from rows (doc_id, text, lang) with a language and a text."""
    cfg = cfg or LangConfig()
    top = 1 << 30
    rows = train.filter("lang IS NOT NULL AND length(text) > 0").select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    rows = rows.withColumn("place", F.pmod("h", F.lit(top)))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).limit(cfg.max_languages + 1).collect()
    if len(found) > cfg.max_languages:
        raise ValueError(f"more than {cfg.max_languages} languages; raise max_languages knowingly")
    if not found:
        return {}
    # Without a shuffle, about twice the rows wanted, and at least one of each language; of these the first.
    bar = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], max(r["least"], -(-2 * top * cfg.sample_docs // r["n"])))])
    near = rows.filter(F.col("place") <= F.element_at(bar, F.col("lang"))).distinct()
    of_lang = Window.partitionBy("lang")
    near = near.withColumn("at", F.row_number().over(of_lang.orderBy("place", "h", "text"))).filter(F.col("at") <= cfg.sample_docs)
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / cfg.piece_chars).cast("int") - 1))
    pieces = near.select("lang", "at", "h", "text", number.alias("number"))
    pieces = pieces.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "at").orderBy(F.xxhash64("h", "number"), "number")))
    pieces = pieces.withColumn("order", F.row_number().over(of_lang.orderBy("turn", "at"))).filter(F.col("order") <= cfg.pieces)
    piece = F.substring("text", F.col("number") * cfg.piece_chars + 1, F.lit(cfg.piece_chars))
    sample: dict[str, list[bytes]] = {}
    for r in pieces.select("lang", "order", piece.alias("piece")).orderBy("lang", "order").collect():
        sample.setdefault(r["lang"], []).append(spelled(r["piece"]))
    return {lang: b" ".join(_fitting(sample[lang], cfg.dict_bytes)) for lang in sorted(sample)}


def _fitting(pieces: list[bytes], size: int) -> list[bytes]:
    """Whole pieces, in order, that fit into ``size`` bytes with a space after each; the first one in any case."""
    taken, left = [], size
    for p in pieces:
        if not taken or len(p) < left:
            taken.append(p)
            left -= len(p) + 1
    return taken


def language_scorer(model: dict[str, bytes], cfg: LangConfig):
    """A function of one task: texts to predictions."""
    import zstandard as zstd

    # This strategy finds matches of three bytes, which short texts need.
    params = zstd.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=1, min_match=3, strategy=zstd.STRATEGY_BTOPT, write_content_size=False)

    def packer(data: bytes):
        d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=d, compression_params=params).compress

    langs, packers = list(model), [packer(data) for data in model.values()]

    def one(raw: bytes | None) -> tuple[str, float, bool]:
        text = raw.decode("utf-8", "replace") if raw else ""
        if not packers or not LETTER.search(text):
            return "und", 0.0, True
        data = spelled(text)
        chunks = [data[i : i + cfg.chunk_bytes] for i in range(0, len(data), cfg.chunk_bytes)]
        sizes = [sum(len(pack(c)) for c in chunks) for pack in packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (rest - sizes[best]) / rest
        return langs[best], min(1.0, margin / (margin + 0.02)) if margin > 0 else 0.0, margin < cfg.min_margin

    def score(texts: list[bytes | None]) -> dict[str, list]:
        rows = [one(t) for t in texts]
        return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows]}

    return score


def identify_languages(docs: DataFrame, model: dict[str, bytes], keep: list[str], cfg: LangConfig | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` with lang_pred, score (0 to 1, from the margin) and rejected, each named with ``prefix``."""
    cfg = cfg or LangConfig()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = language_scorer(sent.value, cfg)
        return lambda texts: {prefix + k: v for k, v in score(texts).items()}

    added = f"{prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean"
    return map_texts(docs, "text", keep, added, make)
