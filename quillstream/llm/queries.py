"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, conversation_repair, edit_embedding, mixing, packing, prefix_trie, quality_rules, simhash, token_counts, token_output, top_k, toxicity, url_filter
from .common import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/quillstream-tokens-{uuid.uuid4().hex}"
    token_output.write(_read(spark, sf_dir, "documents"), path)
    return token_output.read_digests(spark, path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its url carries: bad if of low quality or toxic."""
    pages, labels = _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels")
    numbers = pages.select("page_id", F.expr(r"try_cast(regexp_extract(url, '://[^/]*.*?/(\\d+)', 1) AS bigint)").alias("number"))
    marks = labels.select(F.col("doc_id").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter.judge(pages, numbers.join(marks, "number").select("page_id", "bad"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.fingerprint_edits(_read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighed by the square root of their size, one repetition on average."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "copy", "mix_key")


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, _read(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, _read(spark, sf_dir, "labels")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(_read(spark, sf_dir, "conversations")))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation takes up to three first turns of the one whose number is the next lower multiple of 20."""
    own = prefix_trie.sequences(_read(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string")) % 4
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(own, F.expr("conv_id - conv_id % 20"), head))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_token_output, op2_token_counts, op3_packing, op4_simhash, op5_url_filter, op6_toxicity, op7_edit_fingerprints, op8_source_mix, op9_quality_cnn, op10_quality_rules, op11_conversation_repair, op12_top_k, op13_prefix_trie, pipeline)
    return {q.__name__: q for q in found}


#: CRC-32 of an id's decimal digits: each byte goes through eight steps of shift and exclusive or.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
            ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
        "op13_prefix_trie": f"""
            WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
            asks AS (SELECT conv_id, t, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM own),
            seqs AS (SELECT a.conv_id, list_concat(coalesce(b.t, [])[:h], a.t[h + 1:]) AS t FROM asks AS a LEFT JOIN own AS b ON b.conv_id = a.base),
            prefixes AS (SELECT conv_id, d, t[:d] AS p, len(t) = d AS ends FROM seqs, unnest(range(len(t) + 1)) AS u(d)),
            nodes AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
                CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM prefixes GROUP BY p, d),
            children AS (SELECT p[:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
            counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (p, depth)),
            below AS (SELECT p[:a] AS p, a AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM counted, unnest(range(counted.depth + 1)) AS u(a) GROUP BY ALL)
            SELECT c.conv_id, c.depth, parent.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
            FROM counted AS c JOIN below USING (p, depth) LEFT JOIN nodes AS parent ON c.depth > 0 AND parent.depth = c.depth - 1 AND parent.p = c.p[:c.depth - 1]""",
        "op8_source_mix": """
            WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
            total AS (SELECT sum(n)::DOUBLE AS n, sum(n ** 0.5) AS w FROM counts),
            means AS (SELECT source, total.n / w * counts.n ** 0.5 / counts.n AS mean FROM counts, total),
            split AS (SELECT *, greatest(ceil(mean / 8)::INT, 1) AS parts FROM means),
            terms AS (SELECT source, k, exp(-mean / parts + k * ln(mean / parts) - lgamma(k + 1)) AS p FROM split, range(65) AS r(k)),
            sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms),
            lists AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM sums GROUP BY source),
            draws AS (
                SELECT d.*, l.cdf, ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u
                FROM (SELECT documents.*, unnest(range(1, parts + 1)) AS part FROM documents JOIN split ON documents.source IS NOT DISTINCT FROM split.source) AS d
                JOIN lists AS l ON d.source IS NOT DISTINCT FROM l.source),
            drawn AS (SELECT doc_id, source, lang, n_chars, text, sum(len(list_filter(cdf, lambda c: c <= u))) AS n FROM draws GROUP BY ALL),
            copies AS (SELECT doc_id, source, lang, n_chars, text, unnest(range(1, n::INT + 1))::INT AS copy FROM drawn)
            SELECT *, ('0x' || substr(md5('mix7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT AS mix_key FROM copies""",
    }
