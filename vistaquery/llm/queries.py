"""The queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_dp, cascade, ctw, hard_negatives, html_text, jaccard_join, merkle, packing, rp_forest, secret_scan, substring, token_store, warc

Query = Callable[[SparkSession, str], DataFrame]
#: The end-of-document id of op3 and op9, and the sequence length of op9.
END_ID, SEQUENCE = 2, 1024


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.payload_table(spark, warc.write_archives(table(spark, sf_dir, "pages"))).drop("error")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_token_store(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID)
    rows = store.read(spark, "doc_id", "start", "n_tokens", "tokens")
    return rows.mapInArrow(token_store.crc32_of_lists, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), size=4, percent=85).meta.select("doc_id", "n_shingles", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    rows = bpe_dp.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), measures=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID, SEQUENCE)
    return packing.pack_lengths(pieces.drop("tokens"), SEQUENCE).drop("piece_key")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    manifest = merkle.write_manifest(table(spark, sf_dir, "documents"), tampered=merkle.leaf(text=folded))
    siblings = F.array_join(F.flatten(F.transform("proof", lambda p: p.siblings)), "")
    rows = manifest.proofs().withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": merkle.fold(F.col("tampered"), F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.build_index(table(spark, sf_dir, "documents").select("doc_id", "text")).scan(columns=["doc_id"])
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(said(F.filter("spans", lambda x: x.kind.isin(kinds))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


#: The counts and the verdict of the quality rules, of every row of documents.
QUALITY_SQL = r"""
    WITH w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    g AS (SELECT *, CASE WHEN len(words) < 3 THEN [] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END AS grams FROM w),
    h AS (SELECT *, list_histogram(grams) AS often FROM g),
    r AS (SELECT *, list_transform(grams, lambda x: often[x] > 1) AS rep FROM h),
    c AS (SELECT *, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        CASE WHEN len(words) < 3 THEN 0 ELSE coalesce(list_sum(list_transform(range(1, len(words) + 1), lambda i:
            CASE WHEN coalesce(rep[i], false) OR (i > 1 AND coalesce(rep[i - 1], false)) OR (i > 2 AND coalesce(rep[i - 2], false)) THEN 1 ELSE 0 END)), 0) END::BIGINT AS n_repeat_words,
        coalesce(list_sum(list_transform(words, lambda x: CASE WHEN regexp_matches(x, '\pL') THEN 1 ELSE 0 END)), 0) AS n_letter_words,
        length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_upper FROM r),
    q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        10 * n_symbols > n_words OR 2 * n_dup_lines > len(lines) OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
            OR 10 * n_letter_words < 8 * n_words OR 10 * n_upper > 3 * word_chars AS others_failed FROM c)
    SELECT {columns} FROM (SELECT *, NOT base_failed AND NOT others_failed AS kept FROM q)"""

QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_warc": op2_warc,
    "op3_token_store": op3_token_store,
    "op4_rp_forest": op4_rp_forest,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_bpe": op6_bpe,
    "op7_ctw": op7_ctw,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_packing": op9_packing,
    "op10_substring": op10_substring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_secret_scan": op12_secret_scan,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: From links (a, b) and nodes (id): the smallest node that each reaches.
_REACH = """sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, x.b FROM reach r JOIN sides x ON x.a = r.b),
    root AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

#: The rules of op12 in the SQL engine's syntax; its folding of case would go beyond ASCII, so both cases are written out.
_SECRETS = [(r.kind, re.sub(r"\(\?ai:(.*?)\)\)", lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", r.pattern).replace("'", "''"), r.group, r.least) for r in secret_scan.RULES]
_SECRET_SPANS = " UNION ALL ".join(
    f"""SELECT r, {n} AS nr, '{kind}' AS kind, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, length(m[i])::BIGINT AS size
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, string_split_regex(text, '{pattern}') AS s, regexp_extract_all(text, '{pattern}') AS m FROM d)) WHERE length(regexp_extract(m[i], '{pattern}', {group})) >= {least}"""
    for n, (kind, pattern, group, least) in enumerate(_SECRETS)
)

#: crc32 of a decimal number, bit by bit; 3988292384 is the reversed polynomial.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x:
            list_reduce(list_concat([xor(c, x)], range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)), 4294967295)"""
_MERKLE_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
    "op4_rp_forest": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        nodes AS (SELECT id FROM v),
        links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
        {_REACH},
        n AS (SELECT a AS id, count(*) AS n FROM sides GROUP BY a)
        SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM root LEFT JOIN n USING (id)""",
    "op5_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.format(_ASCII_LOWER)} AS words FROM documents),
        s AS (SELECT id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM w),
        nodes AS (SELECT id FROM s),
        u AS (SELECT id, len(shingles) AS n, unnest(shingles) AS g FROM s),
        p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
        links AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n + m - c)),
        {_REACH}
        SELECT id AS doc_id, len(shingles)::BIGINT AS n_shingles, component_id FROM s JOIN root USING (id)""",
    "op10_substring": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20),
        k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(words[i:i + 19], ' ')) ORDER BY doc_id, i) > 1 AS again FROM i),
        gone AS (SELECT DISTINCT doc_id, i + x.j AS i FROM k, range(20) x(j) WHERE again),
        o AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
        kept AS (SELECT o.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY o.i) AS text FROM o LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY o.doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_MERKLE_LEAF.format("text")} AS leaf,
            CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_MERKLE_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_MERKLE_LEAF.format("text")} END AS tampered FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM d),
        t AS (SELECT 0 AS level, lang, pos, size, leaf AS node FROM p
            UNION ALL SELECT level + 1, lang, pos // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE size > 1 GROUP BY level, lang, pos // 8, size),
        s AS (SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
        u AS (SELECT 0 AS level, pos, size, subroot AS node FROM s
            UNION ALL SELECT level + 1, pos // 8, (size + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE size > 1 GROUP BY level, pos // 8, size),
        n AS (SELECT lang, level, pos, size, node FROM t WHERE size > 1 UNION ALL SELECT s.lang, s.height + u.level, u.pos, u.size, u.node FROM s, u WHERE u.size > 1),
        w AS (SELECT p.r, p.lang, 0 AS level, p.pos, s.height, s.pos AS place, p.tampered AS node, '' AS proof FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
            UNION ALL SELECT r, lang, level + 1, pos // 8, height, place, sha256(string_agg(CASE WHEN own THEN node ELSE other END, '' ORDER BY other_pos)), any_value(proof) || string_agg(CASE WHEN own THEN '' ELSE other END, '' ORDER BY other_pos)
            FROM (SELECT w.r, w.lang, w.level, CASE WHEN w.level = w.height THEN w.place ELSE w.pos END AS pos, w.height, w.place, w.node, w.proof, n.node AS other, n.pos AS other_pos, n.pos = CASE WHEN w.level = w.height THEN w.place ELSE w.pos END AS own
                  FROM w JOIN n ON w.lang IS NOT DISTINCT FROM n.lang AND w.level = n.level AND n.pos // 8 = CASE WHEN w.level = w.height THEN w.place ELSE w.pos END // 8) GROUP BY r, lang, level, pos, height, place),
        e AS (SELECT * FROM (SELECT *, max(level) OVER (PARTITION BY r) AS last FROM w) WHERE level = last)
        SELECT p.doc_id, p.leaf, s.subroot, u.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = u.node AS verified
        FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN e USING (r) JOIN u ON u.size = 1""",
    "op12_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), x AS ({_SECRET_SPANS}),
        g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, nr) FILTER (nr < 3) AS base, string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, nr) AS spans FROM x GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)""",
    "op13_hard_negatives": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT * FROM n WHERE rank <= 10""",
    "op8_quality_cascade": QUALITY_SQL.format(columns="doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"),
}
