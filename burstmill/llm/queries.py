"""The queries of the llm operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstmill.llm import ann, byte_bpe, collocations, language_id, licenses, mixing, negatives, packing, quality_rules, quotations, sharding, simhash, warc

SHARDS = 40
RANKS = "byte_bpe_50k.tiktoken"
WORD_PIECES, END = "word_bpe_49k.json", 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, usable=~language_id.held_out())
    found = language_id.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)
    return found.select("doc_id", "encoding.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    f, v = "features", "verdict"
    found = quality_rules.quality(docs, keep=["doc_id"])
    base = [f"{f}.n_words", f"{f}.word_chars", f"{f}.n_symbols", f"{f}.n_dup_lines", f"{f}.n_repeat_words"]
    return found.select("doc_id", *base, f"{v}.base_failed", f"{v}.kept", f"{v}.char_distance", f"{v}.word_distance")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files. A source is a directory; every four hundred ids have one in it, and every two thousand one
    around these. Of a source's documents every fifth is its directory's license file, every twenty-fifth that of the
    directory around it, so that what these hold is inherited by those beside and below them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    number = lambda n: F.floor(F.col("doc_id") / n)
    outer, inner = number(2000).cast("string"), number(400).cast("string")
    name = F.concat(F.when(number(20) % 5 == 0, "LICENSE.").otherwise("text."), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), outer, F.when(number(20) % 25 != 0, inner), name)
    found = licenses.scan(docs.select("doc_id", "text", path.alias("path")), keep=["doc_id"])
    return found.withColumn("score", F.round("score", 9))


def quoting_messages(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as replies: half of those that follow at least two others quote the one two turns
    before, and half of these, below a second mark, the one three turns before. Quoted texts are whole."""
    one = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = lambda n: one.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(f"said{n}"))
    draw = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    quote = lambda n, mark: F.concat(F.lit(mark), F.regexp_replace(f"said{n}", "\n", "\n" + mark), F.lit("\n\n"))
    rows = messages.join(before(2), ["conv_id", "turn"], "left").join(before(3), ["conv_id", "turn"], "left")
    nested = F.when(draw == 0, quote(3, "> > "))
    text = F.concat(F.coalesce(nested, F.lit("")), quote(2, "> "), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", "role", F.when(F.col("said2").isNotNull() & (draw < 2), text).otherwise(F.col("text")).alias("text"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order: position and own text of every message, and where its quotes come from. The table's
    messages hold no quotes, so half of them get some from turns before."""
    return quotations.link(quoting_messages(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    written = sharding.shuffle_into_shards(docs, SHARDS)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = written.select("doc_id", sharding.size_of("text").alias("size"), crc.alias("text_crc32"), "shard", "bucket", "place")
    rows = sharding.with_slots(digest)
    grown = sharding.shard_of("doc_id", SHARDS + 1)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    p = F.col("piece")
    digest = F.crc32(p["ids"]).alias("ids_crc32")
    return packing.pack(docs, public_tokenizers.path(WORD_PIECES), END, keep=["doc_id"]).select("doc_id", "piece.start", "piece.length", digest, "piece.doc_tokens", "piece.sequence_id", "piece.offset")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_nearest, op2_language_id, op3_warc, op4_mix_sources, op5_byte_bpe, op6_simhash, op7_quality_rules, op8_license_scan, op9_quotation_links, op10_shards, op11_packing, op12_collocations, op13_hard_negatives)}
ORACLES = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
             g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM g""",
    "op12_collocations": """
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
             w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
             t AS (SELECT id, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS pos FROM w),
             s AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY id ORDER BY pos) AS w2, lead(w1, 2) OVER (PARTITION BY id ORDER BY pos) AS w3 FROM t),
             f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM s GROUP BY ALL),
             f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
             f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
             n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1),
             c AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, 1 AS cut, f2.f AS a, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
                   UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 1, f3.f, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
                   UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 2, f3.f, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
             v AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c),
             b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS k FROM v),
             i AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY 1, 2),
             o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE k = 1 AND (i.f IS NULL OR 100 * i.f < 50 * a))
        SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)]) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
             p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
             r AS (SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
                   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WHERE k <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3""",
}
