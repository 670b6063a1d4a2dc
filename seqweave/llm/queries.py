"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, lzprint, media, mix, packing, pii, sharding, simhash, urltree
from .common import materialize, read

#: Words of a shingle and differing bits in the near-duplicate query.
OP2_WIDTH, OP2_BITS = 4, 4


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    sizes = materialize(read(spark, sf_dir, "documents").select("doc_id", "source", mix.words_of(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content")), "sizes")
    mixed = mix.mix(sizes, content="content")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "epochs", "cut_from", "cut_words", "head_words")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=OP2_WIDTH, k=OP2_BITS)
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image in a table's binary column, read back from there and described."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    stored = materialize(read(spark, sf_dir, "documents").select("doc_id", size, media.media_column(F.col("text")).alias("media")), "media")
    return stored.select("doc_id", "n_bytes", media.features_column(F.col("media")).alias("x")).select("doc_id", "n_bytes", "x.*")


def op4_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every text and of its edited text."""
    return lzprint.fingerprint_with_next(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every text."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def identify_documents(docs: DataFrame, key: str) -> DataFrame:
    """``langid.identify`` of rows like those of ``documents``, with all the evidence that they have. Sources of a family
    differ in a number at their end, or have a domain in common."""
    model, source = langid.fit(docs), F.col("source")
    family = F.when(source.contains("."), F.regexp_extract(source, r"([^.]+\.[^.]+)$", 1)).otherwise(F.regexp_replace(source, r"[0-9]+$", ""))
    suffix = F.when(source.contains("."), F.lower(F.element_at(F.split(source, r"\."), -1)))
    return langid.identify(docs, model, key, "text", declared=langid.unseen(model, "doc_id", "lang"), suffix=suffix, host=source, parent=F.nullif(family, F.lit("")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: text, declared language (but of the rows fitted on), and source with its family;
    sources that are addresses have suffixes."""
    docs = read(spark, sf_dir, "documents")
    return identify_documents(docs, "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page: text without tags, declared markup language, address suffix and host."""
    host = urltree.host_of(F.col("url"))
    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>|&[a-z]+;", " ")
    pages = read(spark, sf_dir, "pages").select("page_id", text.alias("text"), F.regexp_extract("html", r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1).alias("declared"), F.when(host != "", host).alias("host"))
    last = F.element_at(F.split("host", r"\."), -1)
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    return langid.identify(pages, langid.fit(read(spark, sf_dir, "documents")), "page_id", "text", declared=F.col("declared"), suffix=last, host=F.col("host"), parent=F.when(domain != "", domain))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into shards by their keys and shuffled there with their texts; sizes and checksums are those of
    the records read back from their shards."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 16).cast("long").alias("size")
    out = sharding.shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text", size), "doc_id", "size")
    return out.select("doc_id", size, F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.replace_pii(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return urltree.judge(read(spark, sf_dir, "pages"), html="html")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences, a row for each piece."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_mix, op2_simhash, op3_media, op4_lzprint, op5_licenses, op6_language_id, op7_sharding, op8_pii, op9_url_filter, op10_packing, language_id_pages)}

#: The mix: levels of targets, highest quotients over all seats, and the stretch that each shard takes of its words.
SQL: dict[str, str] = {
    "op9_url_filter": urltree.judge_sql(),
    "op1_mix": rf"""WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mix.WORD}')) AS size, md5('{mix.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
listed AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(nth - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM listed), ratios AS (SELECT *, cap / weight AS ratio FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
targets AS (SELECT *, coalesce(least(cap, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, nth LIMIT 1)), cap) AS target, greatest(ceil(source_size / {mix.SHARD_WORDS}.0), 1)::BIGINT AS shards FROM levels),
seats AS (SELECT nth, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, nth, j) AS place FROM (SELECT nth, target, unnest(range(1, (2 * target / {mix.BLOCK})::BIGINT + 4)) AS j FROM targets)),
won AS (SELECT nth, count(*) AS blocks FROM seats WHERE place <= (SELECT sum(round(target / {mix.BLOCK})) FROM targets) GROUP BY nth),
sources AS (SELECT t.*, coalesce(won.blocks, 0) AS blocks FROM targets t LEFT JOIN won USING (nth)),
drawn AS (SELECT s.*, nth, source_size, target, ('0x' || substr(draw, 1, 8))::BIGINT % shards AS shard FROM sizes s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source),
cells AS (SELECT nth, any_value(source) AS source, shard, sum(size)::BIGINT AS words FROM drawn GROUP BY nth, shard),
groups AS (SELECT nth, shard // {mix.GROUP} AS grp, sum(words)::BIGINT AS words FROM cells GROUP BY ALL),
group_shares AS (SELECT nth, grp, row_number() OVER (PARTITION BY nth ORDER BY words::DOUBLE / (2 * j - 1) DESC, grp, j) AS place, blocks FROM (SELECT nth, grp, g.words, blocks, unnest(range(1, blocks + 1)) AS j FROM groups g JOIN sources USING (nth) WHERE g.words > 0)),
group_blocks AS (SELECT nth, grp, count(*) AS blocks FROM group_shares WHERE place <= blocks GROUP BY ALL),
shares AS (SELECT nth, grp, shard, row_number() OVER (PARTITION BY nth, grp ORDER BY words::DOUBLE / (2 * j - 1) DESC, shard, j) AS place, blocks FROM (SELECT c.nth, grp, shard, words, g.blocks, unnest(range(1, g.blocks + 1)) AS j FROM cells c JOIN group_blocks g ON g.nth = c.nth AND g.grp = c.shard // {mix.GROUP} WHERE words > 0)),
quotas AS (SELECT nth, shard, count(*) AS blocks FROM shares WHERE place <= blocks GROUP BY nth, shard),
cut AS (SELECT c.nth, c.shard, c.words, least(greatest(coalesce(q.blocks, 0) * {mix.BLOCK} + CASE WHEN row_number() OVER (PARTITION BY c.nth ORDER BY c.words DESC, c.shard) = 1 THEN round(s.target)::BIGINT - s.blocks * {mix.BLOCK} ELSE 0 END, 0), 2 * c.words) AS quota,
(('0x' || substr(md5('{mix.SEED}:' || coalesce(c.source, 'null') || ':' || c.shard), 1, 8))::BIGINT % greatest(ceil(c.words / {mix.BLOCK}.0), 1)::BIGINT) * {mix.BLOCK} AS first FROM cells c JOIN sources s USING (nth) LEFT JOIN quotas q ON q.nth = c.nth AND q.shard = c.shard),
ends AS (SELECT *, sum(size) OVER (PARTITION BY nth, shard ORDER BY substr(draw, 9, 24), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM drawn),
laid AS (SELECT d.*, e - size AS b, words, first, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS turns, first + CASE WHEN words > 0 THEN quota % words ELSE 0 END AS stop FROM ends d JOIN cut USING (nth, shard)),
spans AS (SELECT *, CASE WHEN size > 0 THEN turns ELSE 0 END AS epochs, greatest(least(e, stop, words) - greatest(b, first), 0) AS cut_words, greatest(least(e, stop - words) - b, 0) AS head_words FROM laid)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + cut_words + head_words)::BIGINT AS taken, source, shard, epochs::BIGINT AS epochs, (CASE WHEN cut_words > 0 THEN greatest(b, first) - b ELSE 0 END)::BIGINT AS cut_from, cut_words::BIGINT AS cut_words, head_words::BIGINT AS head_words FROM spans""",
}
