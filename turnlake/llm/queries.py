"""The named queries of this package over the driver tables, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.session import ship

from . import bpe, classifier, html, lines, merkle, minhash, mixing, packing, rules, suffixes, trie, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, table: str, sql: str | None = None):
    """Register a query over one whole table."""

    def add(fn: Callable[..., DataFrame]):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"), sf_dir)

        call.__name__ = name
        QUERIES[name] = call
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || sha256(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 0.5)
      / 281474976710656.0 AS u
  FROM documents),
w AS (SELECT *, floor(1048576.0 / sqrt(sqrt((size + 64)::DOUBLE)))::BIGINT AS weight,
        row_number() OVER (ORDER BY doc_id) AS rid FROM d),
s AS (SELECT source, sum(size) AS ss, sum(weight::HUGEINT * size) AS scaled FROM w GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS sw FROM s),
l AS (SELECT *, (3 * sum(ss) OVER () - 2 * coalesce(sum(2 * ss) OVER (ORDER BY (2 * ss)::DOUBLE / sw, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (2 * sum(sw) OVER (ORDER BY (2 * ss)::DOUBLE / sw, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM r),
t AS (SELECT source, ss, scaled, least((2 * ss)::DOUBLE, sw * max(lv) OVER ()) AS target FROM l),
e AS (SELECT w.*, t.ss, t.target, CASE WHEN scaled > 0 THEN least(2.0::DOUBLE, target * weight / scaled::DOUBLE) ELSE 0.0 END AS ex
      FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(ex)::BIGINT AS sure, ex - floor(ex)::BIGINT AS p FROM e),
k AS (SELECT *, CASE WHEN sure >= 2 THEN 2.0 WHEN p <= 0 THEN 1.0
        ELSE (u / (1 - u) / (p / (1 - p))) / (1 + u / (1 - u) / (p / (1 - p))) END AS rank FROM f),
o AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS room,
        CASE WHEN rank <= 1 THEN sum(CASE WHEN rank <= 1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size, rid) END AS run FROM k),
m AS (SELECT *, CASE WHEN room > 0 AND run <= room THEN 1 ELSE 0 END AS more FROM o),
g AS (SELECT *, max(room) OVER (PARTITION BY source) - sum(more * size) OVER (PARTITION BY source) AS gap FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY source, more = 0 AND sure < 2 AND size > 0 AND gap > 0 AND abs(gap - size) < gap
        ORDER BY abs(gap - size), rank, doc_id, size, rid) AS pick FROM g)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
  (size * (sure + more + CASE WHEN more = 0 AND sure < 2 AND size > 0 AND gap > 0 AND abs(gap - size) < gap AND pick = 1 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""


_LINES_SQL = r"""
WITH l AS (
  SELECT d.doc_id, u.i, u.line, trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut
  FROM documents d, unnest(string_split(coalesce(d.text, ''), chr(10))) WITH ORDINALITY AS u(line, i)),
k AS (SELECT *, translate(cut, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@_query("op1_line_dedup", "documents", _LINES_SQL)
def _lines(docs: DataFrame, _: str) -> DataFrame:
    return lines.dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM w, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""


@_query("op2_minhash_dedup", "documents", _NEAR_SQL)
def _near(docs: DataFrame, _: str) -> DataFrame:
    return minhash.near_documents(docs, shingle=2)


@_query("op3_pack_sequences", "documents")
def _pack(docs: DataFrame, _: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row", "skip")


@_query("op4_mix_sources", "documents", _MIX_SQL)
def _mix(docs: DataFrame, _: str) -> DataFrame:
    return mixing.sample(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_query("op5_suffix_dedup", "documents")
def _suffixes(docs: DataFrame, _: str) -> DataFrame:
    return suffixes.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@_query("op6_quality_classifier", "documents")
def _classifier(docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = classifier.fit(docs, labels, usable=~held_out)
    return classifier.score(docs.select("doc_id", "text"), weights).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.a
"""


@_query("op7_embedding_dedup", "embeddings", _VECTORS_SQL)
def _vectors(vectors_table: DataFrame, _: str) -> DataFrame:
    return vectors.near_vectors(vectors_table)[0]


@_query("op8_html_text", "pages")
def _html(pages: DataFrame, _: str) -> DataFrame:
    return html.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@_query(
    "op9_warc_salvage", "pages",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM g
""",
)
def _warc(pages: DataFrame, _: str) -> DataFrame:
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(pages).where("kind = 'record'").select(
        F.col("record_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").try_cast(kind).alias("refers_to"),
    )


@_query("op10_quality_rules", "documents")
def _rules(docs: DataFrame, _: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"), "quality",
    )


@_query("op13_bpe_round_trip", "documents")
def _bpe(docs: DataFrame, _: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.decode(bpe.encode(docs, tokenizer, keep=("doc_id",)), tokenizer)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_MERKLE_SQL = """
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))),
      4294967295::BIGINT) % 7 = 0, false) AS bad,
    {doc_id} || {source} || {lang} AS head, {text} AS body FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    sha256(head || {n_chars} || body) AS leaf, CASE WHEN bad THEN sha256(head || {n_more} || body) ELSE sha256(head || {n_chars} || body) END AS claimed FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
t(g, lvl, idx, n, h) AS (
  SELECT g, 0, idx, n, leaf FROM p
  UNION ALL SELECT g, lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, lvl, idx // 2),
s AS MATERIALIZED (SELECT g, h AS subroot FROM t WHERE n = 1),
u(lvl, idx, n, h) AS (
  SELECT 0, g, count(*) OVER (), subroot FROM s
  UNION ALL SELECT lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 2),
w AS (SELECT rid, t.lvl, t.h FROM (SELECT rid, g, idx, unnest(range(0, 40)) AS lvl FROM p) q JOIN t ON t.g = q.g AND t.lvl = q.lvl AND t.idx = xor(q.idx >> q.lvl, 1)
  UNION ALL SELECT rid, 100 + u.lvl, u.h FROM (SELECT rid, g, unnest(range(0, 40)) AS lvl FROM p) q JOIN u ON u.lvl = q.lvl AND u.idx = xor(q.g >> q.lvl, 1)),
o AS (SELECT rid, string_agg(h, '' ORDER BY lvl) AS proof FROM w GROUP BY rid),
f(rid, g, lvl, idx, n, cur) AS (
  SELECT rid, g, 0, idx, n, claimed FROM p
  UNION ALL SELECT rid, f.g, f.lvl + 1, f.idx // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.idx % 2 = 0 THEN f.cur || coalesce(t.h, '') ELSE t.h || f.cur END)
  FROM f LEFT JOIN t ON t.g = f.g AND t.lvl = f.lvl AND t.idx = xor(f.idx, 1) WHERE f.n > 1),
k(rid, lvl, idx, n, cur) AS (
  SELECT rid, 0, g, (SELECT count(*) FROM s), cur FROM f WHERE n = 1
  UNION ALL SELECT rid, k.lvl + 1, k.idx // 2, (k.n + 1) // 2, sha256(CASE WHEN k.idx % 2 = 0 THEN k.cur || coalesce(u.h, '') ELSE u.h || k.cur END)
  FROM k LEFT JOIN u ON u.lvl = k.lvl AND u.idx = xor(k.idx, 1) WHERE k.n > 1)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(coalesce(o.proof, '')) AS proof_sha256, k.cur AS folded_root, k.cur = r.h AS verified
FROM p JOIN s ON s.g = p.g JOIN u r ON r.n = 1 JOIN k ON k.rid = p.rid AND k.n = 1 LEFT JOIN o ON o.rid = p.rid
""".format(
    **{c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "text")},
    n_chars="CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END",
    n_more="CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR END",
)


@_query("op11_merkle_manifest", "documents", _MERKLE_SQL)
def _merkle(docs: DataFrame, _: str) -> DataFrame:
    fields = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    own, tampered = fields(F.col("n_chars")), F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select(
        "doc_id", "lang", own.alias("leaf"), F.when(tampered, fields(F.col("n_chars") + 1)).alias("tampered")
    ).withColumn("claimed", F.coalesce("tampered", "leaf")).drop("tampered")
    return merkle.verify(merkle.manifest(leaves), "claimed").select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_TRIE_SQL = """
WITH o AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))),
      4294967295::BIGINT) % 9 AS h FROM o GROUP BY c),
q AS MATERIALIZED (SELECT k.*, least(k.h, coalesce(b.size, 0)) AS head FROM k LEFT JOIN k b ON b.c = k.c - k.c % 5),
s AS MATERIALIZED (
  SELECT q.c, coalesce(list({'r': x.r, 't': x.t} ORDER BY x.p) FILTER (x.p IS NOT NULL), []) AS s FROM q LEFT JOIN (
    SELECT q.c, o.pos AS p, o.r, o.t FROM q JOIN o ON o.c = q.c - q.c % 5 WHERE o.pos < q.h
    UNION ALL SELECT q.c, q.head + o.pos - q.h, o.r, o.t FROM q JOIN o ON o.c = q.c WHERE o.pos >= q.h) x ON x.c = q.c GROUP BY q.c),
m AS (SELECT c, d, s[1:d] AS key, d = len(s) AS ends FROM s, unnest(range(0, len(s) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT d, key, min(c) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(key[d].t) END AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, key),
e AS MATERIALIZED (SELECT n.*, p.conv_id AS parent, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.key[1:n.d] = n.key) AS kids
    FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]),
a AS (SELECT u.d, key[1:u.d] AS key, sum((n - 1) * bytes) AS saved, count(*) FILTER (kids = 0) AS leaves FROM e, unnest(range(0, e.d + 1)) AS u(d) GROUP BY 1, 2)
SELECT e.conv_id, e.d::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, ends_sha256 FROM e JOIN a ON a.d = e.d AND a.key = e.key
"""


@_query("op12_prefix_trie", "conversations", _TRIE_SQL)
def _trie(conversations: DataFrame, _: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(trie.turns(conversations)))
