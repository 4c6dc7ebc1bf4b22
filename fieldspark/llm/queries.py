"""Registered queries of the operators, and SQL twins where SQL can state them."""

import public_tokenizers
from pyspark.sql import functions as F

from fieldspark.llm import (
    bpe,
    conversation_trie,
    jaccard_join,
    kneser_ney,
    lexical,
    licenses,
    line_quality,
    packing,
    repeats,
    spotsigs,
    token_counts,
    topk,
    warc,
)
from fieldspark.llm.common import table

QUERIES = {}
SQL = {}

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_arc_to_warc",
    """
    WITH p AS (
      SELECT page_id, coalesce(html, '') AS body FROM pages
    ), d AS (
      SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
    ), f AS (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op1_arc_to_warc(spark, sf_dir):
    """Pages as legacy archives of both versions, converted, written and read back."""
    return warc.convert_pages(table(spark, sf_dir, "pages"))


@query("op3_encode_decode")
def op3_encode_decode(spark, sf_dir):
    """Every text encoded and decoded; digests of the ids and of the decoded text."""
    encoded = bpe.encode_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    """Tokens of every text, long ones spliced from overlapping chunks."""
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), limit=512
    )


@query("op7_packing")
def op7_packing(spark, sf_dir):
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)
    )


def quality_model(spark, sf_dir):
    """The model of all documents' quality, learned outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    return line_quality.train(table(spark, sf_dir, "documents"), labels)


def held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


@query("op8_line_quality")
def op8_line_quality(spark, sf_dir):
    """Score of every document from its lines' marginals."""
    scored = line_quality.score(
        table(spark, sf_dir, "documents"), quality_model(spark, sf_dir)
    )
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query(
    "op9_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op9_top_k(spark, sf_dir):
    """The five best inner products of every fiftieth vector with all others."""
    return topk.search(
        table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0, k=5, scale=256.0
    )


@query(
    "op10_remove_repeats",
    """
    WITH d AS (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), n AS (
      SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d
    ), s AS (
      SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g
      FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)
    ), f AS (
      SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)
    ), hit AS (
      SELECT s.doc_id, s.i FROM s JOIN f ON s.g = f.g WHERE s.doc_id > f.first_id
    ), cut AS (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh
      FROM hit
    ), numbered AS (
      SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cut
    ), runs AS (
      SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k
    ), sums AS (
      SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last FROM runs GROUP BY doc_id
    ), pieces AS (
      SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM runs
      UNION ALL
      SELECT sums.doc_id, last, n FROM sums JOIN n ON n.doc_id = sums.doc_id
    ), kept AS (
      SELECT pieces.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS h
      FROM pieces JOIN n ON n.doc_id = pieces.doc_id GROUP BY pieces.doc_id
    )
    SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
    FROM n LEFT JOIN sums ON sums.doc_id = n.doc_id LEFT JOIN kept ON kept.doc_id = n.doc_id
    """,
)
def op10_remove_repeats(spark, sf_dir):
    """Every document without the 50-byte strings that an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = repeats.remove_repeats(docs)
    return cleaned.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        (F.size("removed") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query(
    "op6_jaccard_join",
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS ws
      FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(ws) = 0 THEN []
             WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh
      FROM w
    ), n AS (
      SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), p AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
      FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
    ), e AS (
      SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * i >= 85 * (nx.n + ny.n - i)
    ), u AS (
      SELECT x AS a, y AS b FROM e UNION SELECT y, x FROM e
    ), r AS (
      SELECT doc_id, doc_id AS reach FROM documents
      UNION
      SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a
    )
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
    JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
    """,
)
def op6_jaccard_join(spark, sf_dir):
    """Components of documents that share 85 % of their four-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op2_spot_signatures")
def op2_spot_signatures(spark, sf_dir):
    """Fingerprints of every document and its edit, and their likeness."""
    found = spotsigs.compare_with_edit(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.as_text(F.col("signatures")).alias("fingerprint"),
        spotsigs.as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    """Paragraphs of all documents that are licence notices."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


@query(
    "op11_conversation_trie",
    """
    WITH t AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
             {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m
      FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
      SELECT conv_id, list(m ORDER BY i) AS ms FROM t GROUP BY conv_id
    ), bits AS (
      SELECT conv_id, ms, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda x: list_transform(range(8), lambda b: (ascii(x) >> b) & 1))) AS bs
      FROM own
    ), h AS (
      SELECT conv_id, ms, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
               lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 4 AS h
      FROM bits
    ), r AS (
      SELECT h.conv_id, list_concat(coalesce(b.ms, [])[:h.h], h.ms[h.h + 1:]) AS ms
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20
    ), p AS (
      SELECT conv_id, len(ms) AS n, unnest(range(len(ms) + 1)) AS depth, ms FROM r
    ), k AS (
      SELECT conv_id, n, depth, ms[:depth] AS pre, CASE WHEN depth > 0 THEN ms[:depth - 1] END AS up,
             CASE WHEN depth > 0 THEN len(regexp_extract_all(ms[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
      FROM p
    ), node AS (
      SELECT pre, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
      FROM k GROUP BY pre
    ), kids AS (
      SELECT up AS pre, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up
    ), full_node AS (
      SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.pre = node.pre
    ), below AS (
      SELECT pre[:unnest(range(depth + 1))] AS top, (n_convs - 1) * words AS saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM full_node
    ), sums AS (
      SELECT top, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM below GROUP BY top
    )
    SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
           CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
    FROM full_node f JOIN sums s ON s.top = f.pre LEFT JOIN full_node u ON u.pre = f.up
    """,
)
def op11_conversation_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie.conversation_nodes(table(spark, sf_dir, "conversations"))


@query(
    "op13_ranked_search",
    """
    WITH t AS (
      SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
      FROM documents
    ), d AS (
      SELECT k, doc_id, ws, len(ws) AS n FROM t WHERE len(ws) > 0
    ), c AS (
      SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d
    ), w AS (
      SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM d) GROUP BY k, term
    ), df AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT term, count(*) AS df FROM w GROUP BY term), c
    ), i AS (
      SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ), u AS (
      SELECT q, term, count(*) AS times FROM (
        SELECT q, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i) GROUP BY q, term
    ), s AS (
      SELECT q, w.k, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
      FROM u JOIN w ON u.term = w.term JOIN df ON df.term = w.term JOIN d ON d.k = w.k, c
      GROUP BY q, w.k
    ), r AS (
      SELECT q, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM s JOIN d ON d.k = s.k WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r JOIN i ON i.q = r.q WHERE rank <= 10
    """,
)
def op13_ranked_search(spark, sf_dir):
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language_model")
def op12_language_model(spark, sf_dir):
    """Every document scored by a trigram model of four fifths of them."""
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"))
