"""The registered queries of the operators in this subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.llm import html_extract, licenses, line_dedup, merkle, mixing, ngram_join, orchard, packing, quality, secrets, sentencepiece_codec, warc
from studyframe.llm.common import new_folder
from studyframe.llm.exact_dedup import DigestIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_exact_dedup",
    f"""
    WITH rows AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
    groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY 1)
    SELECT r.doc_id, g.keep_id, g.group_size, r.doc_id = g.keep_id AS kept, r.text_sha256
    FROM rows r JOIN groups g USING (text_sha256)
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in two batches: the second meets the digests of the first in the index."""
    index = DigestIndex(spark)
    out = index.deduplicate_in_batches(_table(spark, sf_dir, "documents"))
    index.drop()
    return out.drop("known")


@_query(
    "op5_mixing",
    f"""
    WITH rows AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY 1),
    weighted AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT) AS weight FROM sums),
    levels AS (
        SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
            / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM weighted
    ),
    targets AS (SELECT source, source_size, least(source_size * 2::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
    sources AS (
        SELECT *, greatest(1, least(65536, ceil(source_size / 5000.0)))::BIGINT AS blocks,
            CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
        FROM targets
    ),
    dealt AS (
        SELECT r.*, s.source_size, s.target, s.epochs, s.target - s.epochs * s.source_size AS part,
            ('0x' || substr(md5('mix|block|' || r.doc_id), 1, 12))::BIGINT % s.blocks AS block
        FROM rows r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
    ),
    sums2 AS (
        SELECT source, block, sum(size) AS words, first(part) AS part,
            md5('mix|epoch|' || first(epochs) || '|' || coalesce(source, '') || '|' || (source IS NULL) || '|' || block) AS key
        FROM dealt GROUP BY source, block
    ),
    placed AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums2),
    ordered AS (
        SELECT d.*, p.before, p.words, coalesce(sum(d.size) OVER (PARTITION BY d.source, d.block ORDER BY md5('mix|place|' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running
        FROM dealt d JOIN placed p ON d.source IS NOT DISTINCT FROM p.source AND d.block = p.block
    ),
    drawn AS (
        SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE epochs + (CASE
            WHEN size = 0 OR part <= 0 OR before >= part THEN 0
            WHEN before + words <= part THEN 1
            WHEN before + running + size / 2.0::DOUBLE <= part THEN 1 ELSE 0 END) END AS copies
        FROM ordered
    ),
    gaps AS (SELECT *, round(target - sum(size * copies) OVER (PARTITION BY source), 6) AS gap FROM drawn),
    best AS (
        SELECT source, min(struct_pack(dist := abs(abs(gap) - size), id := doc_id)) AS b FROM gaps
        WHERE size > 0 AND abs(abs(gap) - size) < abs(gap) AND copies + sign(gap) <= 2
            AND CASE WHEN gap > 0 THEN copies = epochs ELSE copies > epochs END
        GROUP BY source
    )
    SELECT g.doc_id, g.size, g.source_size, g.target, (g.size * (g.copies + CASE WHEN b.b.id = g.doc_id THEN sign(g.gap) ELSE 0 END))::BIGINT AS taken
    FROM gaps g LEFT JOIN best b ON g.source IS NOT DISTINCT FROM b.source
    """,
)
def mixing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, _table(spark, sf_dir, "labels"))).drop("probability")


@_query("op10_secret_scans")
def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


@_query(
    "op3_ngram_jaccard_join",
    rf"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT unnest([x, y]) AS a, unnest([y, x]) AS b FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * c >= 80 * (p.n + q.n - c)
    ),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
    FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
    """,
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).drop("copies")


@_query("op8_line_dedup")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


@_query(
    "op2_warc",
    """
    WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    groups AS (SELECT payload_digest, max(page_id) AS largest FROM rows WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT r.page_id, r.payload_bytes::BIGINT AS payload_bytes, r.payload_digest,
        CASE WHEN r.payload_bytes >= 1000 AND r.page_id < g.largest THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN r.payload_bytes >= 1000 AND r.page_id < g.largest THEN g.largest END AS refers_to
    FROM rows r LEFT JOIN groups g ON r.payload_digest = g.payload_digest AND r.payload_bytes >= 1000
    """,
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


@_query("op4_sentencepiece")
def sentencepiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, the text that they decode to, and whether that is the document's own."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_and_decode(docs)


@_query("op7_license_scans", licenses.duckdb_sql())
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op9_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def _clusters_sql() -> str:
    """Three rounds of exact means, each its own pair of views."""
    near = """list_sum(list_transform(list_zip(k.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"""
    sql = """
    WITH vectors AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (SELECT c, m FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM vectors) WHERE c < 16)"""
    for n in range(4):
        sql += f""",
    a{n} AS (SELECT r, min(struct_pack(d := {near}, c := c.c)) AS b FROM vectors k CROSS JOIN c{n} c GROUP BY r)"""
        if n < 3:
            sql += f""",
    s{n} AS (SELECT a.b.c AS c, i, sum(k.v[i])::BIGINT AS s, count(*) AS n FROM a{n} a JOIN vectors k USING (r), range(1, 65) g(i) GROUP BY ALL),
    c{n + 1} AS (SELECT c.c, coalesce(any_value(x.m), c.m) AS m FROM c{n} c LEFT JOIN
        (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{n} GROUP BY c) x ON x.c = c.c GROUP BY c.c, c.m)"""
    return sql + """
    SELECT k.vec_id, a.b.c::INT AS cluster, a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.c))::BIGINT AS cluster_inertia,
        (sum(a.b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
    FROM a3 a JOIN vectors k USING (r) JOIN c3 c ON c.c = a.b.c
    """


@_query("op11_centroid_clusters", _clusters_sql())
def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.centroid_digests(*orchard.cluster(_table(spark, sf_dir, "embeddings")))


def _manifest_sql() -> str:
    """Levels as lists, one list per lang and level; crc32 from its table, which eight shifts of each byte make."""

    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    table = "range(0, 256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: xor(c >> 1, 3988292384 * (c & 1)))"
    up = "list_transform(range(0, (len(l) + 7) // 8), lambda p: sha256(array_to_string(l[p * 8 + 1 : p * 8 + 8], '')))"
    flanks = "array_to_string(t.l[i // 8 * 8 + 1 : i], '') AS lft, array_to_string(t.l[i + 2 : i // 8 * 8 + 8], '') AS rgt"
    return f"""
    WITH RECURSIVE crc AS (SELECT {table} AS t),
    leaves AS (
        SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN xor(list_reduce(
            list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 3 = 0
            THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
        FROM documents CROSS JOIN crc
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS r FROM leaves),
    tree AS (
        SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS l FROM placed GROUP BY lang
        UNION ALL SELECT lang, level + 1, {up} FROM tree WHERE len(l) > 1
    ),
    subroots AS (SELECT lang, l[1] AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place FROM tree WHERE len(l) = 1),
    crown AS (
        SELECT 0 AS level, list(subroot ORDER BY place) AS l FROM subroots
        UNION ALL SELECT level + 1, {up} FROM crown WHERE len(l) > 1
    ),
    steps AS (
        SELECT r, level, {flanks} FROM (SELECT p.r, t.level, t.l, p.pos // (8 ** t.level)::BIGINT AS i FROM placed p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang AND len(t.l) > 1) t
        UNION ALL
        SELECT r, level, {flanks} FROM (SELECT p.r, s.height + c.level AS level, c.l, s.place // (8 ** c.level)::BIGINT AS i FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN crown c ON len(c.l) > 1) t
    ),
    paths AS (SELECT r, string_agg(lft || rgt, '' ORDER BY level) AS siblings, list([lft, rgt] ORDER BY level) AS path FROM steps GROUP BY r),
    folds AS (
        SELECT p.r, coalesce(p.tampered, p.leaf) AS node, 0 AS done FROM placed p
        UNION ALL SELECT f.r, sha256(x.path[f.done + 1][1] || f.node || x.path[f.done + 1][2]), f.done + 1 FROM folds f JOIN paths x ON f.r = x.r WHERE f.done < len(x.path)
    )
    SELECT p.doc_id, p.leaf, s.subroot, (SELECT l[1] FROM crown WHERE len(l) = 1) AS root, sha256(coalesce(x.siblings, '')) AS proof_sha256,
        f.node AS folded_root, f.node = (SELECT l[1] FROM crown WHERE len(l) = 1) AS verified
    FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths x ON p.r = x.r
    JOIN folds f ON f.r = p.r AND f.done = coalesce(len(x.path), 0)
    """


@_query("op12_merkle_manifest", _manifest_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.verified(merkle.document_manifest(_table(spark, sf_dir, "documents")))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@_query("op13_packing")
def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    length = F.floor(F.octet_length("ids") / 4).alias("length")
    return found.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
