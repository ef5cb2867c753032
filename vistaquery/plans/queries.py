"""The query registry: each query of the catalog engine with the SQL that must give its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, masks, media, text
from ..operators import catalog, filters, gallery, ingest, ranking
from ..sources import views
from ..sources.shared import written
from ..sources.views import API, EXTENSIONS, MODEL, entries, flat_entries, table
from .query import specify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LIST = ", ".join(f"'{x}'" for x in EXTENSIONS)
_STOP = ", ".join(f"'{x}'" for x in text.STOPWORDS)
_IMAGES = ", ".join(f"'{x}'" for x in media.IMAGES)
_VIDEOS = ", ".join(f"'{x}'" for x in media.VIDEOS)
_GALLERY = ", ".join(f"'{x}'" for x in media.GALLERY_IMAGES)
_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in media.MIME.items()) + " WHEN 'txt' THEN 'text/plain'"
_MODEL = f"sha1('{API}{MODEL}')"
_TS = "strftime(v.ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


#: The views as CTEs: e (entries), u (the last of each text), c (collection rows).
PRELUDE = f"""WITH e0 AS (
  SELECT d.doc_id AS input_pos, d.text, d.lang, d.source, l.quality, sha256(d.text) AS file_hash, [{_LIST}][d.doc_id % 12 + 1] AS ext,
    {_TS} AS index_date, CASE WHEN d.doc_id % 5 <> 0 THEN {_TS} END AS uploaded_at,
    strftime(o.o_orderdate, '%Y-%m-%d') || 'T' || strftime(v.ts, '%H:%M:%S.%f') || CASE d.doc_id % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN '-07:00' ELSE '+05:30' END AS master_date,
    CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'unknown' END AS date_reliability, d.doc_id % 4 <> 1 AS described,
    string_split(d.text, chr(10))[1] AS line1, string_split(d.text, chr(10))[2] AS line2
  FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id LEFT JOIN events v ON v.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
e AS (SELECT *, file_hash || '_' || {_MODEL} AS entry_id, '/lib/' || source || '/' || input_pos || '.' || ext AS file_path,
    CASE WHEN input_pos % 10 = 0 THEN '' ELSE input_pos || '.' || ext END AS file_name,
    CASE WHEN input_pos % 7 = 0 THEN '' ELSE master_date END AS true_creation_date,
    CASE WHEN input_pos % 3 = 0 THEN index_date END AS indexed_at, CASE WHEN input_pos % 6 = 1 THEN index_date END AS legacy_indexed_at,
    CASE WHEN ext IN ({_IMAGES}) THEN 'image' WHEN ext IN ({_VIDEOS}) THEN 'video' ELSE '' END AS media_type,
    coalesce(uploaded_at, index_date, '') AS upload_date,
    coalesce(nullif(CASE WHEN input_pos % 7 = 0 THEN '' ELSE master_date END, ''), master_date, '') AS creation,
    coalesce(CASE WHEN input_pos % 3 = 0 THEN index_date END, CASE WHEN input_pos % 6 = 1 THEN index_date END) IS NOT NULL AS is_indexed FROM e0),
u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY input_pos DESC) = 1),
c0 AS (SELECT entry_id, 'content_narrative' AS collection, text AS document FROM u UNION ALL SELECT entry_id, 'context_narrative', line1 FROM u
  UNION ALL SELECT entry_id, 'lexical_keywords', lang || ', ' || source FROM u UNION ALL SELECT entry_id, 'ocr_content', line2 FROM u UNION ALL SELECT entry_id, 'other_data', source FROM u),
c AS (SELECT *, array_to_string(tokens, ' ') AS token_string FROM (SELECT *, {tokens_sql('document')} AS tokens FROM c0 WHERE document <> '')),
dt AS (SELECT entry_id, date_reliability, true_creation_date, master_date, CAST(substr(master_date, 1, 4) AS INT) AS y, CAST(substr(master_date, 6, 2) AS INT) AS mo, CAST(substr(master_date, 9, 2) AS INT) AS d,
    CAST(substr(master_date, 12, 2) AS INT) AS h, CAST(substr(master_date, 15, 2) AS INT) AS mi, CAST(substr(master_date, 18, 2) AS INT) AS s, epoch_us(CAST(master_date AS TIMESTAMPTZ)) / 1e6 AS ts FROM u)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql follows the views, as further CTEs after a comma or as a SELECT."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = PRELUDE + sql
        return f

    return add


# --- Retrieval ---------------------------------------------------------------------------------

LEXICAL = ["er re an", "die der", "  Er RE an ", "le la of"]
DATED = ["summer evening re", "1998-0X-XXTXX:XX:XX la", "1997-05-XXTXX:XX:XX to 1998-06-XXTXX:XX:XX", "christmas"]
N = 5


def _specs(spark, d, texts, vectors=()):
    return specify(texts, {t: views.query_vector(spark, d, k) for k, t in enumerate(vectors)})


@query("tokenize", f"SELECT input_pos, array_to_string({tokens_sql('text')}, ' ') AS token_string FROM e")
def _(spark, d):
    return flat_entries(spark, d).select("input_pos", F.array_join(text.tokenize(F.col("text")), " ").alias("token_string"))


@query("token_counts", "SELECT collection, count(*) AS n_docs, sum(len(tokens))::BIGINT AS n_tokens, count(*) FILTER (WHERE len(tokens) = 0) AS n_empty FROM c GROUP BY collection")
def _(spark, d):
    rows = views.collection_docs(spark, d)
    return rows.groupBy("collection").agg(F.count("*").alias("n_docs"), F.sum("token_count").cast("long").alias("n_tokens"), F.count_if(F.col("tokens").isNull()).alias("n_empty"))


_LEX = """, q AS (SELECT * FROM (VALUES ('er re an', ['er', 're', 'an'], 'er re an'), ('die der', ['die', 'der'], 'die der'), ('le la of', ['le', 'la'], 'le la')) t(query_id, qt, qs)),
lc AS (SELECT collection, entry_id, query_id, len(list_intersect(tokens, qt)) + CASE WHEN contains(token_string, qs) THEN 2 ELSE 0 END AS score FROM c, q WHERE list_has_any(tokens, qt)),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, entry_id) AS rank FROM lc)
"""


@query("lexical_candidates", _LEX + "SELECT collection, entry_id, query_id, score::INT AS score FROM lc")
def _(spark, d):
    return ranking.lexical_candidates(views.collection_docs(spark, d), specify(LEXICAL))


@query("lexical_rank", _LEX + "SELECT query_id, collection || '_lexical' AS list, entry_id, -score::DOUBLE AS distance, rank::INT AS rank FROM lr WHERE rank <= 250")
def _(spark, d):
    return ranking.lexical_rank(views.collection_docs(spark, d), specify(LEXICAL), N)


@query("query_dedupe", ", q AS (SELECT lower(trim(lang || ' ' || source)) AS text, input_pos FROM e) SELECT text, min(input_pos) AS first_pos, count(*) AS n FROM q GROUP BY text")
def _(spark, d):
    rows = flat_entries(spark, d).select(text.normalize_query(F.concat_ws(" ", "lang", "source")).alias("text"), "input_pos")
    return rows.groupBy("text").agg(F.min("input_pos").alias("first_pos"), F.count("*").alias("n"))


_DATED = "SELECT entry_id, {spec} + CASE WHEN date_reliability = 'high' THEN 1 ELSE 0 END AS score, ts, {no} AS filter_no, '{q}' AS query_id FROM dt WHERE entry_id IN (SELECT entry_id FROM c WHERE collection = 'context_narrative') AND {cond}"
_MAY, _JUNE = "epoch_us(TIMESTAMPTZ '1997-05-01 00:00:00+00') / 1e6", "epoch_us(TIMESTAMPTZ '1998-06-30 23:59:59+00') / 1e6"
_CHRONO = f""", ch AS ({_DATED.format(spec=3, no=0, q='summer evening re', cond='h * 3600 + mi * 60 + s BETWEEN 61200 AND 75599')} UNION ALL
{_DATED.format(spec=1, no=1, q='summer evening re', cond='mo BETWEEN 6 AND 8')} UNION ALL
{_DATED.format(spec=3, no=0, q='1998-0X-XXTXX:XX:XX la', cond="ts BETWEEN epoch_us(TIMESTAMPTZ '1998-01-01 00:00:00+00') / 1e6 AND epoch_us(TIMESTAMPTZ '1998-09-30 23:59:59+00') / 1e6")} UNION ALL
{_DATED.format(spec=2, no=0, q='range', cond=f'ts BETWEEN {_MAY} AND {_JUNE}')} UNION ALL
{_DATED.format(spec=3, no=0, q='christmas', cond='mo = 12 AND d BETWEEN 24 AND 26')}),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id, filter_no ORDER BY score DESC, ts DESC NULLS LAST, entry_id) AS rank FROM ch)
""".replace("'1998-0X-XXTXX:XX:XX la'", "'1998-0x-xxtxx:xx:xx la'").replace("'range'", "'1997-05-xxtxx:xx:xx to 1998-06-xxtxx:xx:xx'")


@query("chrono_rank", _CHRONO + "SELECT query_id, 'context_narrative_chrono_' || filter_no AS list, entry_id, -score::DOUBLE AS distance, rank::INT AS rank FROM cr WHERE rank <= 250")
def _(spark, d):
    return ranking.chrono_rank(_dated(spark, d), specify(DATED), N)


def _dated(spark, d, unique=None):
    """unique: without texts, as only context documents are dated."""
    unique = views.unique_entries(spark, d, text=F.lit(None).cast("string")) if unique is None else unique
    return catalog.with_dates(views.collection_docs(spark, d, unique), views.nested(unique))


_DT = "FROM dt WHERE entry_id IN (SELECT entry_id FROM c WHERE collection = 'context_narrative')"


@query("chrono_explicit_range", f"SELECT entry_id, round(ts, 6) AS ts {_DT} AND ts BETWEEN {_MAY} AND {_JUNE}")
def _(spark, d):
    f = masks.extract_filters("1997-05-XXTXX:XX:XX through 1998-06-XXTXX:XX:XX")[0][0]
    return _dated(spark, d).where(masks.condition("master_date", f)).select("entry_id", F.round("master_ts", 6).alias("ts"))


@query("chrono_recurring", f"SELECT entry_id, 'christmas' AS phrase {_DT} AND mo = 12 AND d BETWEEN 24 AND 26 UNION ALL SELECT entry_id, 'season' {_DT} AND (mo = 12 OR mo = 11 AND d >= 20) UNION ALL SELECT entry_id, 'night' {_DT} AND h BETWEEN 20 AND 23")
def _(spark, d):
    keys = {"christmas": "christmas", "season": "holiday season", "night": "night"}
    found = [F.when(masks.condition("master_date", masks.DateFilter(*masks.SEMANTIC[k], "semantic")), F.lit(name)) for name, k in keys.items()]
    return _dated(spark, d).select("entry_id", F.explode(F.array_compact(F.array(*found))).alias("phrase"))


@query("semantic_phrase_match", "SELECT input_pos, k AS phrase FROM e, (VALUES ('fall'), ('spring'), ('noon'), ('the'), ('of'), ('die'), ('70s')) p(k) WHERE regexp_matches(lower(text), '(^|[^0-9A-Za-z_])' || k || '($|[^0-9A-Za-z_])')")
def _(spark, d):
    """Found phrases are exploded by name and kept where a text has them: exploding them themselves would search each text twice."""
    keys = ["fall", "spring", "noon", "the", "of", "die", "70s"]
    rows = flat_entries(spark, d, said=masks.phrase_matches(F.col("text"), keys)).select("input_pos", "said", F.explode(F.array(*map(F.lit, keys))).alias("phrase"))
    return rows.where(F.array_contains("said", F.col("phrase"))).select("input_pos", "phrase")


_SEM = """, vq AS (SELECT k.query_id, list_transform(x.embedding, lambda a: a::DOUBLE) AS qv FROM (VALUES ('er re an', 0), ('die der', 1)) k(query_id, vec_id) JOIN embeddings x USING (vec_id)),
sv AS (SELECT query_id, u.entry_id, round(1 - list_cosine_similarity(list_transform(x.embedding, lambda a: a::DOUBLE), qv), 9) AS distance FROM embeddings x JOIN u ON u.input_pos = x.vec_id, vq),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS rank FROM sv)
"""


@query("semantic_topk", _SEM + "SELECT query_id, 'content_narrative' AS list, entry_id, distance, rank::INT AS rank FROM sr WHERE rank <= 50")
def _(spark, d):
    return ranking.semantic_rank(views.vectors(spark, d), _specs(spark, d, ["er re an", "die der"], ["er re an", "die der"]), N)


_WEIGHT = "CASE list " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranking.WEIGHTS.items()) + " ELSE 0.2 END"
_FUSE = f"""fs AS (SELECT query_id, substr(entry_id, 1, 105) AS entry_id, round(sum({_WEIGHT} / (60.0 + rank)), 9) AS score FROM hits GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS n FROM fs)
"""
_COLLAPSE = """cs AS (SELECT query_id, entry_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM cr WHERE rank <= 250 GROUP BY 1, 2),
cc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS rank FROM cs)
"""


@query("rrf_chrono_collapse", _CHRONO + ", " + _COLLAPSE + "SELECT query_id, 'context_narrative_chrono' AS list, entry_id, -s AS distance, rank::INT AS rank FROM cc")
def _(spark, d):
    return ranking.collapse_chrono(ranking.chrono_rank(_dated(spark, d), specify(DATED), N))


_HITS = f"{_LEX}{_SEM}, hits AS (SELECT query_id, collection || '_lexical' AS list, entry_id, rank FROM lr WHERE rank <= 250 UNION ALL SELECT query_id, 'content_narrative', entry_id, rank FROM sr WHERE rank <= 50), {_FUSE}"


@query("rrf_fusion", _HITS + "SELECT query_id, entry_id, score, (n - 1)::INT AS rank FROM fr WHERE n <= 5")
def _(spark, d):
    return _found(spark, d, N)


def _found(spark, d, n):
    specs = _specs(spark, d, LEXICAL, ["er re an", "die der"])
    return ranking.fuse(ranking.lexical_rank(views.collection_docs(spark, d), specs, n).unionByName(ranking.semantic_rank(views.vectors(spark, d), specs, n)), n)


_RE = _LEX.replace("('er re an', ['er', 're', 'an'], 'er re an'), ('die der', ['die', 'der'], 'die der'), ('le la of', ['le', 'la'], 'le la')", "('summer evening re', ['summer', 'evening', 're'], 'summer evening re'), ('1998-0x-xxtxx:xx:xx la', ['la'], 'la'), ('christmas', ['christmas'], 'christmas')")


@query("hybrid_search", f"{_CHRONO}, {_COLLAPSE}{_RE}, hits AS (SELECT query_id, collection || '_lexical' AS list, entry_id, rank FROM lr WHERE rank <= 500 UNION ALL SELECT query_id, 'context_narrative_chrono', entry_id, rank FROM cc), {_FUSE}SELECT query_id, entry_id, score, (n - 1)::INT AS rank FROM fr WHERE n <= 10".replace("FROM cr WHERE rank <= 250", "FROM cr WHERE rank <= 500"))
def _(spark, d):
    return ranking.search(views.collection_docs(spark, d), _dated(spark, d), views.vectors(spark, d), specify(DATED), 10)


_FILTERS = filters.ActiveFilters("image", ("jpg", ".PNG", "webp", "tiff"), 0.0, "1996-01-01", "")


@query("filtered_search", _HITS.replace("rank <= 250", "rank <= 500").replace("rank <= 50)", "rank <= 250)") + f""", ok AS (SELECT f.query_id, f.entry_id, f.score, f.n - 1 AS rank FROM fr f JOIN u USING (entry_id) WHERE f.n <= 25 AND u.ext IN ('jpg', 'png', 'webp', 'tiff') AND u.ext IN ({_GALLERY}) AND try_cast(substr(master_date, 1, 10) AS DATE) >= DATE '1996-01-01')
SELECT query_id, entry_id, score, rank::INT AS rank, p::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM ok) WHERE p <= 5""")
def _(spark, d):
    found = _found(spark, d, _FILTERS.candidates(N))
    return filters.filtered(found, views.nested(views.unique_entries(spark, d)), _FILTERS, N)


def _phrase_sql(start: str, end: str) -> str:
    """The parts of a date that a phrase's masks say something about, as text, lie between the masks' own."""
    shape = [("y", 4, 0), ("mo", 2, 5), ("d", 2, 8), ("h", 2, 11), ("mi", 2, 14), ("s", 2, 17)]
    told = [(c, n, k) for c, n, k in shape if (start[k : k + n] + end[k : k + n]).strip("X")]
    text = " || ".join(f"lpad({c}::VARCHAR, {n}, '0')" for c, n, _ in told)
    low, high = ("".join(m[k : k + n].replace("X", x) for _, n, k in told) for m, x in ((start, "0"), (end, "9")))
    return f"({text}) BETWEEN '{low}' AND '{high}'"


_PHRASES = ", ".join("('" + k.replace("'", "''") + f"', '{a}', '{b}')" for k, (a, b) in masks.SEMANTIC.items())
_HITS_OF = " UNION ALL ".join("SELECT '" + k.replace("'", "''") + f"' AS phrase, count(*) AS n_entries FROM dt WHERE entry_id IN (SELECT entry_id FROM c WHERE collection = 'context_narrative') AND {_phrase_sql(a, b)}" for k, (a, b) in masks.SEMANTIC.items())


@query("mask_specificity", f""", p AS (SELECT * FROM (VALUES {_PHRASES}) t(phrase, a, b)), g AS (SELECT phrase, unnest([substr(a, 1, 4), substr(a, 6, 2), substr(a, 9, 2), substr(a, 12, 2), substr(a, 15, 2), substr(a, 18, 2)]) AS x,
  unnest([substr(b, 1, 4), substr(b, 6, 2), substr(b, 9, 2), substr(b, 12, 2), substr(b, 15, 2), substr(b, 18, 2)]) AS y FROM p),
n AS (SELECT phrase, sum(CASE WHEN replace(x || y, 'X', '') = '' THEN 0 WHEN x = y AND NOT contains(x, 'X') THEN 2 ELSE 1 END)::INT AS specificity FROM g GROUP BY 1), h AS ({_HITS_OF})
SELECT phrase, specificity, n_entries FROM n JOIN h USING (phrase)""")
def _(spark, d):
    """Every phrase's masks, with the dated entries that it stands for."""
    rows = [(k, masks.specificity(*m)) for k, m in masks.SEMANTIC.items()]
    matches = [F.when(masks.condition("master_date", masks.DateFilter(*m, "semantic")), F.lit(k)) for k, m in masks.SEMANTIC.items()]
    hits = _dated(spark, d).select(F.explode(F.array_compact(F.array(*matches))).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n_entries"))
    known = spark.createDataFrame(rows, "phrase string, specificity int")
    return known.join(hits, "phrase", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0).cast("long")))


@query("mask_bounds", """, m AS (SELECT input_pos, CAST(substr(master_date, 1, 4) AS INT) AS y, CAST(substr(master_date, 6, 2) AS INT) AS mo, CAST(substr(master_date, 9, 2) AS INT) AS d, CAST(substr(master_date, 12, 1) AS INT) AS h FROM e WHERE master_date IS NOT NULL),
k AS (SELECT *, CASE input_pos % 4 WHEN 0 THEN make_timestamp(y, mo, 1, 0, 0, 0.0) WHEN 1 THEN make_timestamp(y // 10 * 10, 1, 1, 0, 0, 0.0) WHEN 2 THEN make_timestamp(y, mo, d, h * 10, 0, 0.0) ELSE make_timestamp(y, mo, 1, 0, 0, 0.0) + to_days((CASE WHEN d // 10 = 0 THEN 1 ELSE least(d // 10 * 10, day(last_day(make_date(y, mo, 1)))) END - 1)::INT) END AS a FROM m)
SELECT input_pos, CASE WHEN input_pos % 4 = 2 AND h = 2 THEN NULL ELSE epoch_us(a) / 1e6 END AS first_ts, CASE input_pos % 4 WHEN 0 THEN epoch_us(a + INTERVAL 1 MONTH) / 1e6 - 1 WHEN 1 THEN epoch_us(a + INTERVAL 10 YEAR) / 1e6 - 1 WHEN 2 THEN CASE WHEN h < 2 THEN epoch_us(a + INTERVAL 10 HOUR) / 1e6 - 1 END
  ELSE epoch_us(make_timestamp(y, mo, 1, 0, 0, 0.0) + to_days(least(d // 10 * 10 + 9, day(last_day(make_date(y, mo, 1))))::INT)) / 1e6 - 1 END AS last_ts FROM k""")
def _(spark, d):
    """Masks of months, decades, tens of hours (of which the third ends after the day) and tens of days, made of the entries' dates."""
    at = lambda k, n: F.substring("master_date", k, n)
    kind = F.col("input_pos") % 4
    mask = F.when(kind == 0, F.concat(at(1, 7), F.lit("-XXTXX:XX:XX"))).when(kind == 1, F.concat(at(1, 3), F.lit("X-XX-XXTXX:XX:XX"))).when(kind == 2, F.concat(at(1, 12), F.lit("X:XX:XX"))).otherwise(F.concat(at(1, 9), F.lit("XTXX:XX:XX")))
    first, last = masks.bounds_columns(mask)
    return flat_entries(spark, d).where("master_date is not null").select("input_pos", first.alias("first_ts"), last.alias("last_ts"))


# --- Hashes, names, scalars --------------------------------------------------------------------


@query("content_hash", "SELECT input_pos, file_hash, sha1(text) AS text_sha1 FROM e")
def _(spark, d):
    return flat_entries(spark, d).select("input_pos", "file_hash", F.sha1("text").alias("text_sha1"))


@query("entry_id", "SELECT input_pos, entry_id, length(entry_id)::INT AS id_length FROM e")
def _(spark, d):
    return flat_entries(spark, d).select("input_pos", "entry_id", F.length("entry_id").alias("id_length"))


@query("file_metadata_projection", f"SELECT input_pos, string_split(file_path, '/')[-1] AS base_name, lower(ext) AS ext, media_type, CASE ext {_MIME} ELSE CASE WHEN media_type <> '' THEN media_type || '/' || ext ELSE '' END END AS mime_type, replace('\\lib\\' || source, '\\', '/') AS folder FROM e")
def _(spark, d):
    rows = flat_entries(spark, d)
    name = media.base_name(F.col("file_path"))
    ext = media.extension(name)
    return rows.select("input_pos", name.alias("base_name"), ext.alias("ext"), media.media_type(ext).alias("media_type"), media.mime_type(ext, media.media_type(ext)).alias("mime_type"), F.regexp_replace(F.concat(F.lit("\\lib\\"), "source"), r"\\", "/").alias("folder"))


@query("mime_lookup", f"SELECT ext, CASE ext {_MIME} ELSE CASE WHEN media_type <> '' THEN media_type || '/' || ext ELSE '' END END AS mime_type, count(*) AS n FROM e GROUP BY 1, 2")
def _(spark, d):
    return flat_entries(spark, d).groupBy("ext", "mime_type").agg(F.count("*").alias("n"))


@query("display_fields", "SELECT input_pos, coalesce(nullif(file_name, ''), string_split(file_path, '/')[-1], entry_id) AS name, lower(ext) AS ext FROM e")
def _(spark, d):
    m = "metadata."
    return entries(spark, d).select("input_pos", media.display_name(F.col(m + "file_name"), F.col(m + "file_path"), F.col("entry_id")).alias("name"), media.display_ext(F.col(m + "ext"), F.col(m + "file_path")).alias("ext"))


@query("summary_default", "SELECT input_pos, CASE WHEN described THEN coalesce(nullif(line1, ''), 'No summary') ELSE 'No summary' END AS summary FROM e")
def _(spark, d):
    return entries(spark, d).select("input_pos", F.coalesce(text.blank_to_null(F.col("description.content.summary")), F.lit("No summary")).alias("summary"))


@query("fit_size", """, z AS (SELECT l_orderkey, l_linenumber, l_partkey % 5000 + 1 AS w, l_suppkey * 37 % 6000 + 1 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(1, floor(w * least(1600 / w, 1600 / h, 1.0::DOUBLE)))::INT AS w, greatest(1, floor(h * least(1600 / w, 1600 / h, 1.0::DOUBLE)))::INT AS h FROM z""")
def _(spark, d):
    z = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5000 + 1).alias("w"), (F.col("l_suppkey") * 37 % 6000 + 1).alias("h"))
    w, h = media.fit_size(F.col("w"), F.col("h"), 1600, 1600)
    return z.select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"))


_ITEM = "(200 + 64 + ((octet_length(encode(text)) + 2) // 3) * 4 + 10 + 128)"


@query("request_bytes", f"SELECT input_pos, {_ITEM}::BIGINT AS item_bytes, ({_ITEM} + 1000 + 500 + 128 + 512)::BIGINT AS alone_bytes FROM e")
def _(spark, d):
    item = media.item_bytes(F.lit(200), F.col("text_bytes"), F.lit(10)).cast("long")
    return flat_entries(spark, d).select("input_pos", item.alias("item_bytes"), (item + media.base_bytes(1000, 500)).alias("alone_bytes"))


@query("rigor_batch_size", """, r AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN ' High ' WHEN quality = 1 THEN 'extreme' WHEN toxic = 1 THEN 'unknown' ELSE 'low' END AS raw FROM labels)
SELECT doc_id, CASE lower(trim(raw)) WHEN 'low' THEN 'low' WHEN 'high' THEN 'high' WHEN 'extreme' THEN 'extreme' ELSE 'very low' END AS rigor, CASE lower(trim(raw)) WHEN 'low' THEN 20 WHEN 'high' THEN 5 WHEN 'extreme' THEN 1 ELSE 50 END::INT AS batch_size FROM r""")
def _(spark, d):
    raw = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " High ").when(F.col("quality") == 1, "extreme").when(F.col("toxic") == 1, "unknown").otherwise("low")
    return table(spark, d, "labels").select("doc_id", media.rigor(raw).alias("rigor"), media.batch_size(raw).alias("batch_size"))


# --- Dates -------------------------------------------------------------------------------------


@query("date_parts", """SELECT input_pos, CAST(substr(master_date, 1, 4) AS INT) AS y, CAST(substr(master_date, 6, 2) AS INT) AS mo, CAST(substr(master_date, 9, 2) AS INT) AS d, CAST(substr(master_date, 12, 2) AS INT) AS h, CAST(substr(master_date, 15, 2) AS INT) AS mi,
CAST(substr(master_date, 18, 2) AS INT) AS s, CAST(substr(master_date, 21, 6) AS INT) AS us, round(epoch_us(CAST(master_date AS TIMESTAMPTZ)) / 1e6, 6) AS ts, CASE input_pos % 3 WHEN 0 THEN 0 WHEN 1 THEN -420 ELSE 330 END::INT AS tz FROM e""")
def _(spark, d):
    p = dates.date_part_columns(F.col("master_date"), "m")
    names = {"year": "y", "month": "mo", "day": "d", "hour": "h", "minute": "mi", "second": "s", "microsecond": "us", "tz_offset_minutes": "tz"}
    return flat_entries(spark, d).select("input_pos", *(p[f"m_{k}"].alias(v) for k, v in names.items()), F.round(p["m_ts"], 6).alias("ts"))


_EMBEDDED = """, x AS (SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%dT08:15:00+00:00') AS ship, CASE WHEN l_returnflag = 'A' THEN strftime(l_shipdate - INTERVAL 40 DAY, '%Y-%m-%dT00:00:00+00:00') ELSE '' END AS orig,
 CASE WHEN l_returnflag = 'N' THEN strftime(l_shipdate + INTERVAL 5 DAY, '%Y-%m-%dT00:00:00+00:00') END AS digi, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate - INTERVAL 3 DAY, '%Y-%m-%dT00:00:00+00:00') END AS dtime,
 strftime(l_shipdate + INTERVAL (l_linenumber - 3) DAY, '%Y-%m-%dT08:15:00+00:00') AS os_created FROM lineitem),
r1 AS (SELECT *, os_created > ship AS late, CASE WHEN os_created > ship THEN ship ELSE os_created END AS osc FROM x),
r2 AS (SELECT *, coalesce(nullif(orig, ''), digi, osc) AS created, coalesce(dtime, ship) AS modified FROM r1),
r3 AS (SELECT *, modified < created AS early, modified < created AND created = osc AND dtime IS NOT NULL AS down FROM r2)
"""


@query("resolve_dates", _EMBEDDED + """SELECT l_orderkey, l_linenumber, CASE WHEN down THEN modified ELSE created END AS created, modified,
CASE WHEN orig <> '' AND NOT early THEN 'high' WHEN digi IS NOT NULL AND NOT early THEN 'medium' ELSE 'low' END AS reliability,
concat_ws(',', CASE WHEN late THEN 'os_creation_after_modification_corrected' END, CASE WHEN early THEN 'modification_before_creation' END, CASE WHEN down THEN 'os_creation_downgraded_to_modification' END) AS flags FROM r3""")
def _(spark, d):
    day = lambda e, t: F.date_format(F.expr(e), f"yyyy-MM-dd'T{t}+00:00'")
    rows = table(spark, d, "lineitem")
    v = {
        "creation_date": day("timestampadd(DAY, l_linenumber - 3, l_shipdate)", "08:15:00"),
        "modification_date": day("l_shipdate", "08:15:00"),
        "index_date": F.lit(None).cast("string"),
        "DateTime": F.when(F.col("l_linestatus") == "F", day("timestampadd(DAY, -3, l_shipdate)", "00:00:00")),
        "DateTimeOriginal": F.when(F.col("l_returnflag") == "A", day("timestampadd(DAY, -40, l_shipdate)", "00:00:00")).otherwise(""),
        "DateTimeDigitized": F.when(F.col("l_returnflag") == "N", day("timestampadd(DAY, 5, l_shipdate)", "00:00:00")),
        "GPSDateStamp": F.lit(None).cast("string"),
    }
    r = dates.resolve_dates(v)
    return rows.select("l_orderkey", "l_linenumber", r["true_creation_date"].alias("created"), r["true_modification_date"].alias("modified"), r["date_reliability"].alias("reliability"), F.array_join(r["flags"], ",").alias("flags"))


_FORMS = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30.25-07:00') WHEN 3 THEN 'bad' WHEN 4 THEN strftime(o_orderdate - INTERVAL 20 YEAR, '%Y-%m-%dT01:02:03Z') ELSE strftime(o_orderdate + INTERVAL 400 YEAR, '%Y-%m-%dT01:02:03Z') END"


@query("format_datetime", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30+00:00') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT10:20:30.25-07:00')
WHEN 4 THEN CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate - INTERVAL 20 YEAR, '%Y-%m-%dT01:02:03+00:00') END END AS formatted FROM orders""")
def _(spark, d):
    day = F.col("o_orderdate")
    form = lambda c, p: F.date_format(c, p)
    k = F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, form(day, "yyyy-MM-dd")).when(k == 1, form(day, "yyyy-MM-dd'T10:20:30'")).when(k == 2, form(day, "yyyy-MM-dd'T10:20:30.25-07:00'")).when(k == 3, "bad")
        .when(k == 4, form(F.expr("o_orderdate - INTERVAL '20' YEAR"), "yyyy-MM-dd'T01:02:03Z'")).otherwise(form(F.expr("o_orderdate + INTERVAL '400' YEAR"), "yyyy-MM-dd'T01:02:03Z'"))
    )
    return table(spark, d, "orders").select("o_orderkey", dates.format_datetime(raw).alias("formatted"))


@query("parse_embedded_dt", """SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS parsed FROM events""")
def _(spark, d):
    ts, kind = F.col("ts"), F.col("event_type")
    raw = (
        F.when(kind == "view", F.date_format(ts, "yyyy:MM:dd HH:mm:ss")).when(kind == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(kind == "error", F.concat(F.date_format(ts, "EEE d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(kind == "purchase", F.date_format(ts, "EEE MMM d HH:mm:ss yyyy")).otherwise("no date")
    )
    return table(spark, d, "events").select("event_id", dates.parse_embedded(raw).alias("parsed"))


@query("exif_dates", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || CASE WHEN event_type = 'view' THEN '000' ELSE strftime(ts, '%f') END || CASE WHEN event_type = 'click' THEN '+02:00' ELSE '+00:00' END AS taken,
strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS gps FROM events""")
def _(spark, d):
    ts, kind = F.col("ts"), F.col("event_type")
    micro = F.date_format(ts, "SSSSSS")
    taken = dates.exif_date(F.date_format(ts, "yyyy:MM:dd HH:mm:ss"), F.when(kind != "view", micro), F.when(kind == "click", "+02:00"))
    gps = dates.gps_date(F.date_format(ts, "yyyy:MM:dd"), F.hour(ts), F.minute(ts), F.second(ts) + micro.cast("int") / 1e6)
    return table(spark, d, "events").select("event_id", taken.alias("taken"), gps.alias("gps"))


@query("parse_date", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def _(spark, d):
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(status == "P", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", dates.filter_date(raw).alias("day"))


@query("entry_date", ", x AS (SELECT *, try_cast(substr(index_date, 1, 10) AS DATE) AS indexed FROM e) SELECT input_pos, CASE input_pos % 4 WHEN 0 THEN coalesce(try_cast(substr(master_date, 1, 10) AS DATE), indexed) WHEN 1 THEN DATE '2001-02-03' ELSE indexed END AS day FROM x")
def _(spark, d):
    quarter = F.col("input_pos") % 4
    nested = F.when(quarter == 0, F.struct(F.lit("soon").alias("date"), F.col("metadata.dates.master_date").alias("value")))
    found = F.struct(nested.alias("master_date"), F.when(quarter == 1, "2001:02:03 04:05").alias("estimated_date"), F.when(quarter == 2, "soon").alias("creation_date"))
    rows = entries(spark, d).withColumn("metadata", F.col("metadata").withField("index_date", F.col("metadata.dates.index_date")).withField("dates", found))
    return rows.select("input_pos", filters.dates_of(rows).alias("day"))


@query("exif_date_priority", """, p AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 1 END AS priority FROM events)
SELECT user_id, arg_max(strftime(ts, '%Y-%m-%dT%H:%M:%S'), priority::BIGINT * 1000000000 + event_id) AS value, max(priority)::INT AS priority FROM p GROUP BY user_id""")
def _(spark, d):
    kind = F.col("event_type")
    priority = F.when(kind.isin("view", "purchase"), 3).when(kind == "click", 2).otherwise(1)
    rows = table(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("value"), priority.alias("priority"))
    return rows.groupBy("user_id").agg(F.max_by("value", F.struct("priority", "event_id")).alias("value"), F.max("priority").alias("priority"))


@query("date_anomalies", "SELECT input_pos, concat_ws(',', CASE WHEN true_creation_date = '' THEN 'no_creation' END, CASE WHEN date_reliability = 'low' THEN 'low_reliability' END, CASE WHEN master_date IS NULL THEN 'no_master' END) AS reasons FROM e WHERE true_creation_date = '' OR date_reliability = 'low' OR master_date IS NULL")
def _(spark, d):
    reason = lambda name, c: F.when(c, F.lit(name))
    why = F.array_compact(F.array(reason("no_creation", F.col("true_creation_date") == ""), reason("low_reliability", F.col("date_reliability") == "low"), reason("no_master", F.col("master_date").isNull())))
    return flat_entries(spark, d).select("input_pos", why.alias("w")).where(F.size("w") > 0).select("input_pos", F.array_join("w", ",").alias("reasons"))


# --- Embedded metadata -------------------------------------------------------------------------


@query("exif_whitelist", "SELECT input_pos, 'Make=' || source || CASE WHEN lang <> '' THEN ';Model=' || lang ELSE '' END AS kept, CASE WHEN lang = 'en' THEN 'Exif,IFD' ELSE 'IFD' END AS groups FROM e")
def _(spark, d):
    tags = F.create_map(F.lit("Make"), F.col("source"), F.lit("Model"), F.col("lang"), F.lit("MakerNote"), F.col("file_hash"), F.lit("Thumb"), F.lit("x"))
    name = F.when(F.col("lang") == "en", "Make").otherwise("Thumb")
    rows = flat_entries(spark, d).withColumn("tags", F.create_map(F.lit("IFD"), tags, F.lit("Exif"), F.create_map(name, F.lit("y")), F.lit("Other"), F.create_map(F.lit("Thumb"), F.lit("z"))))
    rows = rows.withColumn("tags", media.whitelisted(F.col("tags"), rows.schema["tags"].dataType))
    own = F.col("tags")["IFD"]
    kept = F.array_join(F.transform(F.array_sort(F.map_keys(own)), lambda k: F.concat(k, F.lit("="), own[k])), ";")
    return rows.select("input_pos", kept.alias("kept"), F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("groups"))


@query("metadata_precedence", "SELECT input_pos, source AS png_wins, lang AS exif_only, CASE WHEN lang = 'en' THEN 'exif' ELSE 'xmp' END AS xmp_fills, 3::BIGINT AS n FROM e")
def _(spark, d):
    exif = F.create_map(F.lit("a"), F.lit("exif"), F.lit("b"), F.col("lang"), F.lit("c"), F.when(F.col("lang") == "en", "exif"))
    png = F.create_map(F.lit("a"), F.concat(F.lit(" "), "source"), F.lit("b"), F.lit("  "))
    xmp = F.create_map(F.lit("b"), F.lit("xmp"), F.lit("c"), F.lit("xmp"), F.lit("d"), F.lit(""))
    rows = flat_entries(spark, d).withColumn("m", media.merge_embedded(exif, png, xmp))
    return rows.select("input_pos", *(F.try_element_at("m", F.lit(k)).alias(x) for k, x in (("a", "png_wins"), ("b", "exif_only"), ("c", "xmp_fills"))), F.size("m").cast("long").alias("n"))


# --- Catalog -----------------------------------------------------------------------------------


@query("scan_dedupe_last_wins", "SELECT file_hash, input_pos, file_path FROM u")
def _(spark, d):
    return catalog.last_wins(flat_entries(spark, d), "file_hash", "input_pos").select("file_hash", "input_pos", "file_path")


@query("dedupe_by_hash", "SELECT file_hash, input_pos, upload_date FROM e QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY upload_date DESC, (described AND is_indexed) DESC, described DESC, input_pos) = 1")
def _(spark, d):
    return catalog.best_by_hash(entries(spark, d), "input_pos").select(F.col("metadata.file_hash").alias("file_hash"), "input_pos", catalog.upload_date().alias("upload_date"))


def _unique(spark, d):
    return views.nested(views.unique_entries(spark, d))


@query("lookup_by_ids", "SELECT entry_id, file_path FROM u WHERE entry_id IN (SELECT entry_id FROM e WHERE lang = 'de')")
def _(spark, d):
    ids = flat_entries(spark, d).where("lang = 'de'").select("entry_id").distinct()
    return _unique(spark, d).join(ids, "entry_id", "left_semi").select("entry_id", F.col("metadata.file_path").alias("file_path"))


@query("lookup_by_hash", "SELECT entry_id, file_path FROM e WHERE file_hash = (SELECT min(file_hash) FROM e)")
def _(spark, d):
    rows = entries(spark, d)
    first = rows.agg(F.min("metadata.file_hash").alias("h"))  # one row
    return rows.join(F.broadcast(first), F.col("metadata.file_hash") == F.col("h")).select("entry_id", F.col("metadata.file_path").alias("file_path"))


@query("check_if_exists", "SELECT DISTINCT entry_id FROM e WHERE entry_id NOT IN (SELECT entry_id FROM u WHERE described AND uploaded_at IS NOT NULL)")
def _(spark, d):
    ids = entries(spark, d).select("entry_id").distinct()
    return catalog.missing_fields(ids, _unique(spark, d), ["description.content", "metadata.uploaded_at"])


@query("prepare_descriptions", f"SELECT input_pos, entry_id, {_MODEL} AS model_hash, '{API}' AS api_name, '{MODEL}' AS model_name, false AS described FROM e")
def _(spark, d):
    return ingest.prepare(flat_entries(spark, d).select("input_pos", "file_hash"), API, MODEL).select("input_pos", "entry_id", "model_hash", "api_name", "model_name", "described")


@query("update_metadata", "SELECT f.entry_id, n.file_path, n.ext, CASE WHEN f.lang = 'en' THEN 'old' ELSE 'new' END AS api_name FROM u f JOIN u n USING (file_hash) WHERE n.source <> 'src0'")
def _(spark, d):
    u = views.unique_entries(spark, d)
    old = u.select("file_hash", "entry_id", F.lit("").alias("file_path"), F.lit("").alias("ext"), F.when(F.col("lang") == "en", "old").otherwise("").alias("api_name"))
    fresh = u.where("source != 'src0'").select("file_hash", "entry_id", "file_path", "ext", F.lit("new").alias("api_name"))
    return ingest.update_metadata(old, fresh, ["file_path", "ext"]).select("entry_id", "file_path", "ext", "api_name")


@query("upsert_merge", """, o AS (SELECT * FROM u WHERE lang IN ('en', 'de')), n AS (SELECT * FROM u WHERE lang IN ('de', 'fr'))
SELECT coalesce(n.entry_id, o.entry_id) AS entry_id, CASE WHEN n.entry_id IS NOT NULL THEN 'new' ELSE o.file_name END AS file_name, CASE WHEN coalesce(n.lang, o.lang) IN ('en', 'de') THEN coalesce(n.described, o.described) ELSE false END AS described,
CASE WHEN coalesce(n.lang, o.lang) = 'de' THEN '2024-02-01T00:00:00+00:00' ELSE coalesce(n.indexed_at, o.indexed_at) END AS indexed_at FROM o FULL JOIN n ON o.entry_id = n.entry_id""")
def _(spark, d):
    """Whether an entry is described is asked, not what is said, so texts stay where they are."""
    flat = views.unique_entries(spark, d).withColumns({c: F.lit("") for c in ("text", "line1", "line2")})
    old = views.nested(flat.where("lang in ('en', 'de')")).drop("input_pos")
    new = views.nested(flat.where("lang in ('de', 'fr')")).select("entry_id", F.col("metadata").withField("file_name", F.lit("new")).alias("metadata"))
    marked = catalog.mark_indexed(catalog.upsert(old, new), flat.where("lang = 'de'"), F.lit("2024-02-01T00:00:00+00:00"))
    return marked.select("entry_id", F.col("metadata.file_name").alias("file_name"), F.col("description").isNotNull().alias("described"), F.col("metadata.dates.chroma_indexed_at").alias("indexed_at"))


@query("collection_upsert", "SELECT collection, entry_id, CASE WHEN collection = 'other_data' THEN 'again' ELSE document END AS document FROM c WHERE collection <> 'lexical_keywords'")
def _(spark, d):
    rows = views.collection_docs(spark, d).select("collection", "entry_id", "document")
    old = rows.where("collection != 'lexical_keywords'")
    return catalog.upsert_rows(old, rows.where("collection = 'other_data'").withColumn("document", F.lit("again")), ["collection", "entry_id"])


@query("populate_missing_only", "SELECT collection, entry_id, document FROM c WHERE entry_id NOT IN (SELECT entry_id FROM u WHERE lang = 'en')")
def _(spark, d):
    rows = views.collection_docs(spark, d).select("collection", "entry_id", "document")
    have = rows.join(views.unique_entries(spark, d).where("lang = 'en'").select("entry_id"), "entry_id", "left_semi")
    return catalog.missing_only(have, rows, ["collection", "entry_id"])


@query("repopulate", "SELECT collection, count(*) AS n, sum(length(document))::BIGINT AS chars FROM c GROUP BY collection")
def _(spark, d):
    rows = views.collection_docs(spark, d).select("collection", "entry_id", "document")
    return catalog.upsert_rows(rows.where("collection = 'other_data'"), rows, ["collection", "entry_id"]).groupBy("collection").agg(F.count("*").alias("n"), F.sum(F.length("document")).cast("long").alias("chars"))


_ROWS = "x AS (SELECT entry_id AS id, lang FROM u UNION ALL SELECT entry_id || '_item_1', lang FROM u UNION ALL SELECT entry_id || 'x', lang FROM u)"


@query("delete_prefix_anti", f", {_ROWS} SELECT id FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.lang = 'fr' AND (x.id = u.entry_id OR starts_with(x.id, u.entry_id || '_')))")
def _(spark, d):
    u = views.unique_entries(spark, d)
    rows = u.select(F.explode(F.array(F.col("entry_id"), F.concat("entry_id", F.lit("_item_1")), F.concat("entry_id", F.lit("x")))).alias("id"))
    return catalog.delete_prefixed(rows, u.where("lang = 'fr'"))


@query("delete_by_hash", "SELECT file_hash, array_to_string(list_sort(list_distinct(list(file_path))), ';') AS paths, count(DISTINCT entry_id) AS n_ids FROM e WHERE file_hash IN (SELECT file_hash FROM e WHERE lang = 'es') GROUP BY file_hash")
def _(spark, d):
    rows = entries(spark, d)
    _, gone = catalog.delete_by_hash(rows, flat_entries(spark, d).where("lang = 'es'"))
    return gone.select("file_hash", F.array_join("paths", ";").alias("paths"), F.size("ids").cast("long").alias("n_ids"))


@query("rename_by_hash", "SELECT input_pos, CASE WHEN file_hash = (SELECT min(sha256(text)) FROM documents) THEN 'new name.jpg' ELSE file_name END AS file_name FROM e")
def _(spark, d):
    rows = entries(spark, d)
    h = table(spark, d, "documents").agg(F.min(F.sha2("text", 256))).first()[0]
    return catalog.rename_by_hash(rows, h, "a/b/ new name.jpg ").select("input_pos", F.col("metadata.file_name").alias("file_name"))


@query("context_with_dates", f"SELECT c.entry_id, document, dt.y AS master_year, date_reliability, round(CASE WHEN true_creation_date <> '' THEN ts END, 6) AS creation_ts FROM c LEFT JOIN dt USING (entry_id) WHERE collection = 'context_narrative'")
def _(spark, d):
    return _dated(spark, d).select("entry_id", "document", "master_year", "date_reliability", F.round("creation_ts", 6).alias("creation_ts"))


@query("override_join", "SELECT input_pos, CASE WHEN lang = 'en' THEN 'by path' WHEN lang = 'de' THEN 'by raw path' ELSE file_name END AS file_name FROM e")
def _(spark, d):
    files = flat_entries(spark, d).withColumn("raw_path", F.regexp_replace("file_path", "/", r"\\\\"))
    o = files.where("lang = 'en'").select(F.col("file_path").alias("path"), F.lit("by path").alias("file_name")).unionByName(files.where("lang in ('en', 'de')").select(F.col("raw_path").alias("path"), F.lit("by raw path").alias("file_name")))
    return catalog.overridden(files.select("input_pos", "file_path", "raw_path", "file_name"), o, ["file_name"]).select("input_pos", "file_name")


@query("extract_fields", "SELECT input_pos, CASE WHEN described THEN line1 END AS summary, CASE WHEN described THEN lang || ',' || source END AS objects, CASE WHEN described THEN master_date END AS estimated_date FROM e")
def _(spark, d):
    rows = entries(spark, d)
    f = catalog.extract_fields(rows.withColumn("entry_id", F.col("input_pos")))
    return f.select(F.col("entry_id").alias("input_pos"), "summary", F.array_join("objects", ",").alias("objects"), "estimated_date")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SENT = "coalesce(CASE WHEN {0} <> '' THEN {0} || chr(10) END, '')"
_CLASSES = f""", f AS (SELECT input_pos, entry_id, {_STRIP.format(f"{_SENT.format('line1')} || {_SENT.format('text')} || lang || ', ' || lang || ', ' || source || chr(10)")} AS content_narrative,
{_STRIP.format(f"{_SENT.format('line1')} || {_SENT.format('line2')} || lang || chr(10)")} AS context_narrative, {_STRIP.format("source || ', ' || lang || chr(10) || ext || ', ' || lang || ', ' || lang || ', ' || source || chr(10)")} AS lexical_keywords,
{_STRIP.format(_SENT.format('line2'))} AS ocr_content, {_STRIP.format(_SENT.format('source'))} AS other_data FROM u WHERE described)
"""


@query("classify_unpivot", _CLASSES + "SELECT entry_id, collection, document FROM (UNPIVOT f ON content_narrative, context_narrative, lexical_keywords, ocr_content, other_data INTO NAME collection VALUE document) WHERE document <> ''")
def _(spark, d):
    return catalog.classify(_unique(spark, d)).select("entry_id", "collection", "document")


@query("combine_fields", _CLASSES + "SELECT input_pos, lexical_keywords AS document FROM f")
def _(spark, d):
    parts = [catalog.FIELDS[f][1](F.col(f"description.{catalog.FIELDS[f][0]}")) for f in catalog.COLLECTIONS["lexical_keywords"]]
    return _unique(spark, d).where(catalog.has_description()).select("input_pos", text.combine(parts).alias("document"))


@query("prep_explode", "SELECT entry_id || '_item_1' AS id, lang AS document FROM u UNION ALL SELECT entry_id || '_item_2', source FROM u UNION ALL SELECT entry_id || '_k', lang FROM u UNION ALL SELECT entry_id, line2 FROM u WHERE line2 <> ''")
def _(spark, d):
    u = written(views.unique_documents(spark, d).select(F.col("entry_id").alias("id"), "lang", "source", "line2"), "unique")  # three parts read it
    lists = catalog.explode_documents(u.select("id", F.array("lang", "source", F.lit("")).alias("x")), lists="x")
    maps = catalog.explode_documents(u.select("id", F.create_map(F.lit("k"), F.col("lang"), F.lit("none"), F.lit("")).alias("x")), maps="x")
    return lists.unionByName(maps).unionByName(catalog.explode_documents(u.select("id", F.col("line2").alias("document"))))


@query("entry_state", "SELECT input_pos, described, is_indexed AS indexed, described AND is_indexed AS complete, upload_date, creation FROM e")
def _(spark, d):
    return entries(spark, d).select("input_pos", catalog.has_description().alias("described"), catalog.indexed_at().isNotNull().alias("indexed"), catalog.fully_indexed().alias("complete"), catalog.upload_date().alias("upload_date"), catalog.creation_date().alias("creation"))


@query("collection_stats", "SELECT collection, count(*) AS n, count(DISTINCT entry_id) AS n_entries, max(len(tokens))::INT AS most_tokens FROM c GROUP BY collection")
def _(spark, d):
    return views.collection_docs(spark, d).groupBy("collection").agg(F.count("*").alias("n"), F.countDistinct("entry_id").alias("n_entries"), F.max("token_count").alias("most_tokens"))


@query("collection_browse", ", b AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY entry_id) AS p, count(*) OVER (PARTITION BY collection) AS n FROM c) SELECT collection, entry_id, document, p::INT AS position, CASE WHEN len(tokens) > 0 THEN 'token_count, token_string, tokens' ELSE 'token_count, token_string' END AS metadata_keys, least(n, 100) || ' of ' || n AS label FROM b WHERE p <= 100")
def _(spark, d):
    rows = views.collection_docs(spark, d)
    top = rows.withColumn("position", F.row_number().over(Window.partitionBy("collection").orderBy("entry_id"))).where("position <= 100")
    n = rows.groupBy("collection").agg(F.count("*").alias("n"))  # a row per collection
    keys = F.array_join(F.sort_array(F.array_compact(F.array(F.when(F.col("tokens").isNotNull(), "tokens"), F.lit("token_string"), F.lit("token_count")))), ", ")
    return top.join(n, "collection").select("collection", "entry_id", "document", "position", keys.alias("metadata_keys"), F.concat(F.least("n", F.lit(100)), F.lit(" of "), "n").alias("label"))


# --- Filters -----------------------------------------------------------------------------------


@query("filter_media_type", f"SELECT 'image' AS kind, input_pos FROM e WHERE ext IN ({_GALLERY}) UNION ALL SELECT 'video', input_pos FROM e WHERE ext IN ('mp4', 'mov')")
def _(spark, d):
    rows = flat_entries(spark, d)
    kinds = [F.when(filters.ActiveFilters(k).media(F.col("ext")), F.lit(k)) for k in ("image", "video")]
    return rows.select(F.explode(F.array_compact(F.array(*kinds))).alias("kind"), "input_pos")


@query("filter_extensions", "SELECT input_pos, ext FROM e WHERE ext IN ('jpg', 'svg', 'mp4')")
def _(spark, d):
    return flat_entries(spark, d).where(filters.ActiveFilters(extensions=(".JPG", "svg", "Mp4")).extension(F.col("ext"))).select("input_pos", "ext")


@query("filter_min_score", "SELECT event_id, value FROM events WHERE value >= 20.5")
def _(spark, d):
    return table(spark, d, "events").where(filters.ActiveFilters(min_score=20.5).score(F.col("value"))).select("event_id", "value")


@query("filter_date_range", "SELECT input_pos FROM e WHERE try_cast(substr(master_date, 1, 10) AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1999-12-31'")
def _(spark, d):
    rows = entries(spark, d)
    return rows.where(filters.ActiveFilters(date_from="1997:03:01 10:00", date_to="1999-12-31").dates(filters.dates_of(rows))).select("input_pos")


@query("is_uploaded", "SELECT input_pos, starts_with(file_path, '/lib/src1') AS uploaded FROM e")
def _(spark, d):
    return entries(spark, d).select("input_pos", filters.uploaded(F.col("metadata.file_path"), "\\lib\\src1/").alias("uploaded"))


# --- Gallery, uploads, history -----------------------------------------------------------------

_STATUS = "CASE WHEN described AND is_indexed THEN 'indexed' WHEN described THEN 'pending_indexing' ELSE 'pending_description' END"
_RECORD = f"entry_id, file_path, coalesce(nullif(file_name, ''), string_split(file_path, '/')[-1]) AS file_name, ext, upload_date AS uploaded_at, creation AS creation_date, {_STATUS} AS status"


def _gallery(name: str, order: str) -> None:
    @query(f"gallery_{name}", f", g AS (SELECT {_RECORD} FROM u WHERE ext IN ({_GALLERY})) SELECT *, row_number() OVER (ORDER BY {order})::INT AS position FROM g ORDER BY {order} LIMIT 48")
    def _(spark, d):
        return gallery.gallery(_unique(spark, d), name)


for _name, _order in {
    "upload_desc": "uploaded_at DESC, entry_id", "upload_asc": "uploaded_at, entry_id", "created_desc": "creation_date DESC, entry_id", "created_asc": "creation_date, entry_id",
    "name_asc": "lower(file_name), entry_id", "name_desc": "lower(file_name) DESC, entry_id",
}.items():
    _gallery(_name, _order)


@query("gallery_random")
def _(spark, d):
    return gallery.gallery(_unique(spark, d), "random")


@query("random_sample")
def _(spark, d):
    return flat_entries(spark, d).orderBy(F.rand(3)).limit(100).select("entry_id", "file_path")


@query("gallery_status", f"SELECT {_STATUS} AS status, count(*) AS n FROM u GROUP BY 1")
def _(spark, d):
    return gallery.records(_unique(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("pending_uploads", f", g AS (SELECT {_RECORD} FROM u WHERE NOT (described AND is_indexed)) SELECT *, substr(uploaded_at, 1, 10) AS day, row_number() OVER (PARTITION BY status, substr(uploaded_at, 1, 10) ORDER BY uploaded_at, entry_id)::INT AS position FROM g")
def _(spark, d):
    return gallery.pending(_unique(spark, d))


@query("pending_table", "SELECT coalesce(nullif(file_name, ''), entry_id) AS filename, replace(substr(upload_date, 1, 19), 'T', ' ') AS uploaded_at, substr(creation, 1, 10) AS creation_date, entry_id FROM u WHERE NOT (described AND is_indexed)")
def _(spark, d):
    return gallery.pending_table(_unique(spark, d))


@query("upload_classify", """, p AS (SELECT file_hash, file_name, input_pos, count(*) OVER (PARTITION BY file_hash) - 1 AS duplicates, row_number() OVER (PARTITION BY file_hash ORDER BY input_pos) AS n FROM e WHERE length(text) > 0)
SELECT file_hash, file_name AS original_filename, duplicates, s.entry_id AS existing, CASE WHEN s.entry_id IS NOT NULL THEN 'ignore' ELSE '' END AS default_action FROM p LEFT JOIN (SELECT file_hash, min(entry_id) AS entry_id FROM u WHERE lang = 'en' GROUP BY 1) s USING (file_hash) WHERE n = 1""")
def _(spark, d):
    uploads = flat_entries(spark, d).select(F.col("input_pos").alias("position"), F.col("file_name").alias("name"), F.encode("text", "UTF-8").alias("payload"))
    stored = views.nested(views.unique_entries(spark, d).where("lang = 'en'"))
    return gallery.classify_uploads(uploads, stored)


@query("upload_outcome", """SELECT entry_id, coalesce(nullif(file_name, ''), entry_id) AS filename, file_hash, CASE lang WHEN 'en' THEN 'indexed' WHEN 'de' THEN 'rate_limited' ELSE 'failed' END AS status,
CASE lang WHEN 'en' THEN '' WHEN 'de' THEN 'Quota reached while generating descriptions.' WHEN 'fr' THEN 'broken' ELSE 'Analysis did not complete.' END AS reason FROM u WHERE NOT (described AND is_indexed)""")
def _(spark, d):
    u = views.unique_entries(spark, d)
    kind = F.when(F.col("lang") == "en", F.array(F.lit("failed"), F.lit("indexed"))).when(F.col("lang") == "de", F.array(F.lit("rate_limited"))).otherwise(F.array(F.lit("failed")))
    outcome = u.where("lang in ('en', 'de', 'fr')").select("entry_id", F.explode(kind).alias("kind"), F.when(F.col("lang") == "fr", "broken").otherwise("").alias("reason"))
    return gallery.upload_outcome(views.nested(u).where(~catalog.fully_indexed()), outcome)


_KEY = """'{"filters": {"min_score": 0.0}, "ids": ["' || json_extract_string(props, '$.k') || '"], "query": "' || event_type || '"}'"""
_HISTORY = f""", hs AS (SELECT event_id, 'u' || user_id AS history_user, ts AS created_at, event_type AS query, sha256({_KEY}) AS search_key FROM events),
hd AS (SELECT *, row_number() OVER (PARTITION BY history_user, search_key ORDER BY created_at DESC, event_id DESC) AS k FROM hs),
hn AS (SELECT *, row_number() OVER (PARTITION BY history_user ORDER BY created_at DESC, event_id DESC) AS position FROM hd WHERE k = 1)
"""


def _history(spark, d):
    k = F.get_json_object("props", "$.k")
    key = F.concat(F.lit('{"filters": {"min_score": 0.0}, "ids": ["'), k, F.lit('"], "query": "'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("history_user"), F.col("ts").alias("created_at"), F.col("event_type").alias("query"), F.array(k).alias("ids"), F.sha2(key, 256).alias("search_key"))


@query("history_key", _HISTORY + "SELECT event_id, search_key FROM hs")
def _(spark, d):
    return _history(spark, d).select("event_id", "search_key")


@query("history_upsert_trim", _HISTORY + "SELECT event_id, history_user, search_key, position::INT AS position FROM hn WHERE position <= 30")
def _(spark, d):
    h = _history(spark, d)
    return gallery.history_upsert(h.where("query != 'click'"), h.where("query = 'click'")).select("event_id", "history_user", "search_key", "position")


@query("history_load", _HISTORY + "SELECT event_id, query, position::INT AS position FROM hn WHERE history_user = 'u1' AND position <= 30")
def _(spark, d):
    return gallery.history_newest(_history(spark, d).where("history_user = 'u1'")).where("position <= 30").select("event_id", "query", "position")


@query("history_clear", "SELECT 'u' || user_id AS history_user, count(*) AS n FROM events WHERE user_id <> 1 GROUP BY 1")
def _(spark, d):
    return _history(spark, d).where("history_user != 'u1'").groupBy("history_user").agg(F.count("*").alias("n"))


@query("history_label", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' · ' || event_type || ' · 1 result(s)' AS label FROM events")
def _(spark, d):
    return _history(spark, d).select("event_id", gallery.history_label(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("query"), F.col("ids")).alias("label"))


@query("score_coercion", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END::INT AS n FROM events")
def _(spark, d):
    scores = F.array(F.col("value").cast("string"), F.when(F.col("event_type") == "error", "bad"))
    return table(spark, d, "events").select("event_id", F.size(gallery.clean_scores(scores)).alias("n"))


@query("sync_deleted", "SELECT DISTINCT entry_id FROM e WHERE entry_id NOT IN (SELECT entry_id FROM e WHERE lang = 'es')")
def _(spark, d):
    rows = flat_entries(spark, d).select("entry_id", "lang")
    return rows.select("entry_id").distinct().join(rows.where("lang = 'es'").select("entry_id"), "entry_id", "left_anti")


# --- Ingest ------------------------------------------------------------------------------------


@query("ingest_status", "SELECT input_pos, described, is_indexed AS indexed, CASE WHEN NOT described THEN 'describe' WHEN NOT is_indexed THEN 'index' ELSE 'complete' END AS todo FROM e")
def _(spark, d):
    rows = entries(spark, d).withColumn("entry_id", F.col("input_pos"))
    return ingest.ingest_status(rows).select(F.col("entry_id").alias("input_pos"), "described", "indexed", "todo")


@query("ingest_counts", "SELECT CASE WHEN NOT described THEN 'describe' WHEN NOT is_indexed THEN 'index' ELSE 'complete' END AS todo, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return ingest.ingest_status(entries(spark, d)).groupBy("todo").agg(F.count("*").alias("n"))


_LIMITS = ingest.PackLimits(count=media.BATCH_SIZES["medium"], bytes=40_000, base=media.base_bytes(1000, 500))
_PACK = f""", RECURSIVE_MARK it AS (SELECT source || '/' || (input_pos // 100000) AS shard, entry_id, input_pos, media_type = 'image' AS ok, {_ITEM} AS b, row_number() OVER (PARTITION BY source, input_pos // 100000 ORDER BY input_pos) AS k FROM e),
pk AS (SELECT it.*, 1 AS batch_no, CASE WHEN ok AND 2140 + b <= 40000 THEN 1 ELSE 0 END AS held, CASE WHEN ok AND 2140 + b <= 40000 THEN 2140 + b ELSE 0 END AS size, CASE WHEN NOT ok THEN 'unprepared' WHEN 2140 + b > 40000 THEN 'too_large' ELSE 'packed' END AS outcome FROM it WHERE k = 1
 UNION ALL SELECT it.*, p.batch_no + CASE WHEN it.ok AND p.held BETWEEN 1 AND 9 AND p.size + it.b <= 40000 THEN 0 ELSE 1 END,
  CASE WHEN it.ok AND p.held BETWEEN 1 AND 9 AND p.size + it.b <= 40000 THEN p.held + 1 WHEN it.ok AND 2140 + it.b <= 40000 THEN 1 ELSE 0 END,
  CASE WHEN it.ok AND p.held BETWEEN 1 AND 9 AND p.size + it.b <= 40000 THEN p.size + it.b WHEN it.ok AND 2140 + it.b <= 40000 THEN 2140 + it.b ELSE 0 END,
  CASE WHEN NOT it.ok THEN 'unprepared' WHEN NOT (p.held BETWEEN 1 AND 9 AND p.size + it.b <= 40000) AND 2140 + it.b > 40000 THEN 'too_large' ELSE 'packed' END
 FROM pk p JOIN it ON it.shard = p.shard AND it.k = p.k + 1)
"""


def _packed(spark, d):
    item = media.item_bytes(F.lit(200), F.col("text_bytes"), F.lit(10)).cast("long")
    rows = flat_entries(spark, d)
    shard = F.concat("source", F.lit("/"), F.floor(F.col("input_pos") / 100000))
    items = rows.select(shard.alias("shard"), "entry_id", F.col("input_pos").alias("position"), (F.col("media_type") == "image").alias("prepared"), item.alias("bytes"))
    return ingest.pack_batches(items, _LIMITS)


@query("pack_batches", _PACK + "SELECT shard, input_pos AS position, batch_no::INT AS batch_no, outcome FROM pk")
def _(spark, d):
    return _packed(spark, d).drop("entry_id")


@query("rate_limit_status", _PACK + """, st AS (SELECT *, min(CASE WHEN batch_no = 4 THEN batch_no END) OVER (PARTITION BY shard) AS first FROM pk)
SELECT shard, input_pos AS position, CASE WHEN batch_no >= first THEN 'rate_limited' WHEN outcome = 'packed' AND b < 10000 THEN 'described' ELSE 'failed' END AS status FROM st""")
def _(spark, d):
    item = media.item_bytes(F.lit(200), F.col("text_bytes"), F.lit(10)).cast("long")
    size = flat_entries(spark, d).select(F.col("input_pos").alias("position"), item.alias("b"))
    rows = _packed(spark, d).join(size, "position").withColumn("limited", F.col("batch_no") == 4).withColumn("answered", F.col("b") < 10000)
    return ingest.call_outcomes(rows).select("shard", "position", "status")


_RESPONSES = """, rs AS (SELECT event_id AS batch_no, event_type, 'id' || json_extract_string(props, '$.k') AS id FROM events)
"""


def _responses(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("batch_no"), "event_type", F.concat(F.lit("id"), F.get_json_object("props", "$.k")).alias("id"))
    t = F.col("event_type")
    described = F.concat(F.lit('{"content": {"kind": "'), t, F.lit('"}, "context": {}}'))
    item = lambda rest: F.concat(F.lit('{"entry_id": "'), "id", F.lit('", '), rest, F.lit("}"))
    other = F.lit('{"entry_id": "nobody", "description": {}}')
    bad, good = item(F.lit('"description": "no object"')), item(F.concat(F.lit('"description": '), described))
    hoisted = item(F.expr("substring(described, 2, length(described) - 2)"))
    as_list = lambda *x: F.concat(F.lit("["), F.concat_ws(", ", *x), F.lit("]"))
    as_map = F.concat(F.lit('{"'), "id", F.lit('": '), described, F.lit("}"))
    under = lambda x: F.concat(F.lit('{"results": '), x, F.lit("}"))
    value = F.when(t == "view", under(as_list(bad, other, hoisted, good))).when(t == "click", as_list(good, other, good)).when(t == "error", "no json").when(t == "purchase", under(as_map)).otherwise(as_map)
    return rows.withColumn("described", described).withColumn("text", value)


@query("parse_response", _RESPONSES + "SELECT batch_no, id AS entry_id, event_type AS description FROM rs WHERE event_type <> 'error'")
def _(spark, d):
    rows = _responses(spark, d)
    out = ingest.parse_responses(rows.select("batch_no", "text"), rows.select("batch_no", F.col("id").alias("entry_id")))
    return out.withColumn("description", F.get_json_object("description", "$.content.kind"))


@query("batch_apply", _RESPONSES + "SELECT batch_no, id AS entry_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'described' END AS status FROM rs")
def _(spark, d):
    rows = _responses(spark, d)
    keys = rows.select("batch_no", F.col("id").alias("entry_id"))
    out = ingest.parse_responses(rows.select("batch_no", "text"), keys)
    return keys.join(out, ["batch_no", "entry_id"], "left").select("batch_no", "entry_id", F.when(F.col("description").isNull(), "failed").otherwise("described").alias("status"))


@query("dummy_description", "SELECT input_pos, 'Dummy batch description for ' || coalesce(nullif(file_name, ''), entry_id) AS summary, 0::BIGINT AS n_objects, 'Dummy validation run' AS event, 'high' AS rigor FROM e")
def _(spark, d):
    rows = flat_entries(spark, d).select("input_pos", ingest.dummy_description(F.col("entry_id"), F.col("file_name")).alias("description"))
    rows = ingest.annotate_rigor(rows, " High ")
    return rows.select("input_pos", "description.content.summary", F.size("description.content.objects").cast("long").alias("n_objects"), "description.context.event", "description.generation.rigor")


for _name in ("pack_batches", "rate_limit_status"):
    ORACLES[_name] = ORACLES[_name].replace("WITH e0", "WITH RECURSIVE e0", 1).replace("RECURSIVE_MARK ", "")
