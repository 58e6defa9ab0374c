"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tabulon.session import checkpoint_dir, ship_package
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        build.__name__, build.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


#: The URL rules of op8 as (action, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Operator 1: token counts of all documents."""
    from tabulon.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


_OP8_RULES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)


@query("op8_url_verdicts", sql=f"""
WITH rules(action, rhost, rpath) AS (VALUES {_OP8_RULES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.action,
                row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
         FROM parts p LEFT JOIN rules r
           ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict FROM hits WHERE k = 1
""")
def op8_url_verdicts(spark, sf_dir):
    """Operator 8: verdicts of all pages."""
    from tabulon.llm.url_rules import judge_urls
    rules = spark.createDataFrame([(h, p, a) for a, h, p in URL_RULES], "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    """Operator 4: toxicity scores of all documents."""
    from tabulon.llm.toxicity import fit_toxicity, score_toxicity
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model, keep=["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_passages")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    """Operator 5: all documents packed into sequences of 2048 tokens."""
    from tabulon.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), closing_id=1,
                          capacity=2048, keep=["doc_id"])


@query("op10_minhash_near_copies", sql=r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1),
    lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
size AS (SELECT doc_id, len(shingles) AS n FROM s),
pair AS (SELECT a.doc_id AS u, b.doc_id AS w, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT u, w FROM pair JOIN size p ON p.doc_id = u JOIN size q ON q.doc_id = w WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
link AS (SELECT u, w FROM half UNION SELECT w, u FROM half),
reach(u, w) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u),
low AS (SELECT u, min(w) AS c FROM reach GROUP BY u)
SELECT doc_id, n AS n_shingles, c AS component_id, c = doc_id AS kept FROM size JOIN low ON u = doc_id
""")
def op10_minhash_near_copies(spark, sf_dir):
    """Operator 10: near-copy components of all documents (4-word shingles)."""
    from tabulon.llm.near_copies import MinHashConfig, near_copies
    return near_copies(table(spark, sf_dir, "documents"), MinHashConfig(words=4))


@query("op3_nearest_vectors")
def op3_nearest_vectors(spark, sf_dir):
    """Operator 3: the 5 nearest vectors of every fiftieth vector."""
    from tabulon.llm.nearest import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op9_near_vectors", sql="""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN link l ON r.w = l.u),
low AS (SELECT u, min(w) AS c FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN low ON low.u = vec_id LEFT JOIN n ON n.u = vec_id
""")
def op9_near_vectors(spark, sf_dir):
    """Operator 9: near-duplicate components of all vectors."""
    from tabulon.llm.near_vectors import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Wanted shares of tokens by domain, and the domain of a label row.
MIX_TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    """Operator 6: domain posteriors, rates and copies of all documents."""
    from tabulon.llm.mixing import mix_documents
    return mix_documents(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)


@query("op7_perspectives", sql="""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (SELECT m.*, who.perspective,
             CASE WHEN m.speaker = 'system' THEN 'system' WHEN m.speaker = who.perspective THEN 'assistant' ELSE 'user' END AS role
      FROM m JOIN who USING (conv_id)),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
             '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER w - length(segment) AS BIGINT) AS char_begin FROM s
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, position, role, name, segment, char_begin,
       CASE WHEN role = 'assistant' THEN char_begin + length(head) END AS mask_begin,
       CASE WHEN role = 'assistant' THEN char_begin + length(head) + length(text) END AS mask_end
FROM o
""")
def op7_perspectives(spark, sf_dir):
    """Operator 7: every conversation rendered for each of its participants."""
    from tabulon.llm.dialogues import perspectives
    return perspectives(table(spark, sf_dir, "conversations"))


@query("op2_backoff_scores")
def op2_backoff_scores(spark, sf_dir):
    """Operator 2: stupid-backoff scores of all documents."""
    from tabulon.llm.backoff import backoff_scores
    return backoff_scores(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    """Operator 13: byte-level and piece tokens of all documents aligned."""
    from tabulon.llm.alignment import alignment_counts
    out = alignment_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return out.withColumnRenamed("groups", "groups_sha256")


@query("op12_warc", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, strlen(body) AS n, sha256(body) AS d, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
""")
def op12_warc(spark, sf_dir):
    """Operator 12: all pages written as WARC archives, read back and assembled."""
    import uuid

    from tabulon.llm.warc import page_records, pages_from_warc, read_warc, write_warc
    from tabulon.session import scratch_path
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    return pages_from_warc(read_warc(spark, path, payloads=False))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    """Operator 11: spelling variants of the words of all documents."""
    from tabulon.llm.variants import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))
