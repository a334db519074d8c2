"""Registered queries of this subpackage: ``opN_<name>`` over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word, as DuckDB's patterns write it.
SQL_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(body: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return body(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return body

    return register


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({SQL_WORDS}), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
  FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (
  SELECT rest, open FROM l WHERE cap * open > weight * rest ORDER BY cap / weight, place LIMIT 1),
t AS (
  SELECT l.source, source_size, place,
         CASE WHEN cap * l.open <= weight * l.rest THEN cap::DOUBLE
              ELSE coalesce(weight * (SELECT rest FROM v)::DOUBLE / (SELECT open FROM v), cap::DOUBLE) END AS target
  FROM l),
c AS (
  SELECT d.*, t.source_size, t.target, t.place, floor(target)::BIGINT AS cut,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, cut - b)) + greatest(0, least(size, cut - source_size - b))
        + greatest(0, least(size, cut - 2 * source_size - b)))::BIGINT AS taken
FROM c
"""


@query("op10_curriculum_mix", OP10_SQL)
def _(spark, sf_dir):
    from .curriculum import mixed

    plan = mixed(table(spark, sf_dir, "documents"))
    return plan.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


@query("op3_warc_index")
def _(spark, sf_dir):
    from .warc import read_records, write_archive

    index, path = write_archive(table(spark, sf_dir, "pages"))
    return read_records(index, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, n, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY h, n)
SELECT page_id, p.n::BIGINT AS payload_bytes, p.h AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END::BIGINT AS refers_to
FROM p LEFT JOIN r ON p.h = r.h AND p.n = r.n
"""
ORACLES["op3_warc_index"] = OP3_SQL


def _sql_escaped(text: str) -> str:
    from .chat import CONTROL

    out = f"replace({text}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")})
           + CASE WHEN role = 'assistant' THEN 10 ELSE 23 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op4_chat_format", OP4_SQL)
def _(spark, sf_dir):
    from .chat import canonical, digests, formatted

    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -1L AS conv_id, '{said}' AS prompt, '{said}' AS completion")
    turns = canonical(table(spark, sf_dir, "conversations")).unionByName(canonical(own))
    return digests(formatted(turns))


@query("op5_quality_rules")
def _(spark, sf_dir):
    from .quality_rules import judged, train

    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op7_ordinal_quality")
def _(spark, sf_dir):
    from .ordinal import scored, train

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op6_sentencepiece")
def _(spark, sf_dir):
    from .pieces import digests, model_path

    return digests(table(spark, sf_dir, "documents"), model_path())


@query("op9_token_rans")
def _(spark, sf_dir):
    from .rans import read_ids, vocabulary_path, write_ids

    folder = write_ids(table(spark, sf_dir, "documents"), vocabulary_path())
    return read_ids(spark, folder, ids=False).drop("ids")


@query("op8_jaccard_components")
def _(spark, sf_dir):
    from .jaccard_join import joined

    return joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_url_models")
def _(spark, sf_dir):
    from .url_model import filtered

    return filtered(table(spark, sf_dir, "pages"))


@query("op2_adaptive_scan")
def _(spark, sf_dir):
    from .ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))


@query("op11_paragraph_sketch")
def _(spark, sf_dir):
    from .paragraph_sketch import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


@query("op12_structure_repair")
def _(spark, sf_dir):
    from .repair import damaged, repaired

    return repaired(damaged(table(spark, sf_dir, "conversations")))


@query("op13_prefix_trie")
def _(spark, sf_dir):
    from .prefix_trie import prefix_nodes, sequences

    return prefix_nodes(sequences(table(spark, sf_dir, "conversations")))
