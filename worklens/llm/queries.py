"""The registered queries of this package: name to function, and name to SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.llm import chat, decontam, exact_dedup, langid, line_dedup, merkle, packing, periodic, pii, sharding, simhash, toxicity, warc
from worklens.llm.common import table


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf, "documents"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op2_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one, -1, whose texts look like the template's own marks."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.with_checksum(packing.pack(table(spark, sf, "documents"), tokenizer))


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.assignments(table(spark, sf, "documents"))


def op5_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_sharding(spark: SparkSession, sf: str) -> DataFrame:
    shards = sharding.assignments(table(spark, sf, "documents"))
    return shards.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    out = merkle.verified(merkle.document_manifest(table(spark, sf, "documents")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_periodic(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.digests(periodic.planted(table(spark, sf, "documents")))


_ALL = (
    op1_simhash, op2_chat_formatting, op3_packing, op4_exact_dedup, op5_personal_data, op6_toxicity, op7_decontamination,
    op8_warc, op9_language_id, op10_line_dedup, op11_sharding, op12_merkle, op13_periodic,
)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

#: Unsigned CRC-32 of the id's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _merkle_sql(levels: int = 20) -> str:
    """A table expression per level: each has the digests of its level as a list, and every leaf climbs with its proof."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(field.format(f) for f in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    changed = leaf.replace("n_chars", "(n_chars + 1)")

    def climb(name: str, key: str, place: str) -> str:
        """``name``_0 has ``key``, l (digests) and leaves ``name``_leaf_0 have ``key``, ``place``, f (folded so far), proof."""
        out = []
        for j in range(levels):
            up = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
            out.append(f"{name}_{j + 1} AS MATERIALIZED (SELECT {key}, CASE WHEN len(l) > 1 THEN {up} ELSE l END AS l FROM {name}_{j})")
            side = f"({place} >> {j}) & 1 = 1"
            met = f"(SELECT e.*, len(l) > 1 AS open, coalesce(l[xor({place} >> {j}, 1) + 1], '') AS s FROM {name}_leaf_{j} e JOIN {name}_{j} USING ({key}))"
            out.append(f"""{name}_leaf_{j + 1} AS MATERIALIZED (SELECT * EXCLUDE (f, proof, open, s), CASE WHEN NOT open THEN f WHEN {side} THEN sha256(s || f) ELSE sha256(f || s) END AS f,
                        CASE WHEN open THEN proof || s ELSE proof END AS proof FROM {met})""")
        return ", ".join(out)

    return f"""
        WITH x AS (SELECT doc_id, lang, {leaf} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {changed} ELSE {leaf} END AS f FROM documents),
        trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM x)),
        d_leaf_0 AS MATERIALIZED (SELECT doc_id, leaf, f, '' AS proof, tree, 0 AS one, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
                                  FROM x JOIN trees ON x.lang IS NOT DISTINCT FROM trees.lang),
        d_0 AS (SELECT tree, list(leaf ORDER BY pos) AS l FROM d_leaf_0 GROUP BY tree),
        {climb("d", "tree", "pos")},
        t_0 AS MATERIALIZED (SELECT 0 AS one, list(l[1] ORDER BY tree) AS l FROM d_{levels}),
        t_leaf_0 AS MATERIALIZED (SELECT e.*, l[1] AS subroot FROM d_leaf_{levels} e JOIN d_{levels} USING (tree)),
        {climb("t", "one", "tree")}
        SELECT doc_id, leaf, subroot, l[1] AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = l[1] AS verified
        FROM t_leaf_{levels} JOIN t_{levels} USING (one)"""


ORACLES = {
    "op12_merkle": _merkle_sql(),
    "op13_periodic": rf"""
        WITH x AS (SELECT doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        y AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM x),
        z AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM y),
        gram AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM (SELECT *, unnest(range(len(w) - 5)) AS i FROM z)),
        pair AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.six = b.six AND a.i < b.i),
        island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair),
        stretch AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 6 + q AS len FROM island GROUP BY doc_id, q, island),
        run AS (SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= greatest(12, 2 * q) GROUP BY doc_id, s, len),
        best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len DESC, s, q) = 1),
        runs AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS digest FROM run GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
        word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM z),
        kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT z.doc_id, coalesce(n_runs, 0) AS n_runs, s AS "start", len AS "length", q AS period, 1000 * len // q AS exponent_milli,
               coalesce(runs.digest, sha256('')) AS runs_sha256, coalesce(kept.digest, sha256('')) AS collapsed_sha256
        FROM z LEFT JOIN best USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op2_chat_formatting": rf"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')),
        s AS (SELECT *, length({_ESCAPED.format("text")}) + length({_ESCAPED.format("role")}) + length('<|im_start|>') + length('<|im_end|>') + 2 AS shown FROM t),
        l AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS loss FROM s WHERE role = 'assistant' GROUP BY conv_id)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(length(any_value(loss)), 0) AS loss_chars, sha256(coalesce(any_value(loss), '')) AS loss_sha256,
               CAST(sum(shown) AS BIGINT) AS formatted_chars, 0::BIGINT AS rewriting_turns
        FROM s LEFT JOIN l USING (conv_id) GROUP BY conv_id""",
    "op10_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
        w AS (SELECT doc_id, pos, line, list_sort(list_distinct(list_filter(regexp_split_to_array(
                  {_LOWER.replace("text", "line")}, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words FROM l),
        sets AS (SELECT words, min((doc_id, pos)) AS first, len(words) AS n, row_number() OVER () AS s FROM w WHERE len(words) > 0 GROUP BY words),
        t AS (SELECT s, n, unnest(words) AS word FROM sets),
        df AS (SELECT word, count(*) AS c FROM t GROUP BY word HAVING count(*) > 1),
        tt AS (SELECT s, n, word FROM t JOIN df USING (word)),
        common AS (SELECT a.s AS x, b.s AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS inter
                   FROM tt a JOIN tt b ON a.word = b.word AND a.s < b.s AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) GROUP BY 1, 2),
        near AS (SELECT x, y FROM common WHERE 10 * inter >= 8 * (n + m - inter)),
        gone AS (SELECT DISTINCT CASE WHEN sx.first < sy.first THEN y ELSE x END AS s
                 FROM near JOIN sets sx ON sx.s = x JOIN sets sy ON sy.s = y),
        judged AS (SELECT w.doc_id, w.pos, w.line, len(w.words) > 0 AND (g.s IS NOT NULL OR (w.doc_id, w.pos) <> sets.first) AS goes
                   FROM w LEFT JOIN sets USING (words) LEFT JOIN gone g ON g.s = sets.s)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (goes) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS text_sha256
        FROM judged GROUP BY doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM h""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY low)""",
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
                       unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS words
                FROM b WHERE len(w) > 0),
        pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        grams AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words FROM pos),
        hits AS (SELECT doc_id, p, n, item_id FROM grams JOIN win USING (n, words)),
        cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                         sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS digest FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
