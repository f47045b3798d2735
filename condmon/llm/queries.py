"""The queries of this package: every operator over its whole table, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from condmon.llm import (
    chat, decontamination, jaccard_join, line_dedup, mixing, packing, phrases, pii, repetition, secrets, toxicity, warc, whitening,
)
from condmon.llm.common import prepare
from condmon.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM split),
keyed AS (SELECT *, {LOWER_SQL.format(f"trim(line, {SPACES_SQL})")} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS d FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, firsts.d IS NOT NULL AND firsts.d <> doc_id AS lost FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op1_line_dedup", LINES_SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op2_packing")
def op2(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_length")


JACCARD_SQL = f"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER_SQL.format('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS ws
  FROM documents),
sized AS (SELECT doc_id, ws, least(3, len(ws)) AS n FROM words WHERE len(ws) > 0),
grams AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + n - 1) AS g
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * c >= 90 * (sa.n + sb.n - c)),
reach AS (SELECT * FROM (WITH RECURSIVE r(d, e) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d, b FROM r JOIN links ON e = a)
  SELECT * FROM r))
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT d AS doc_id, min(e) AS component_id FROM reach GROUP BY d) LEFT JOIN sizes USING (doc_id)"""


@query("op3_ngram_jaccard_join", JACCARD_SQL)
def op3(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


WORDS_SQL = f"regexp_extract_all({LOWER_SQL.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS ws FROM documents),
items AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0),
wanted AS (SELECT DISTINCT item_id, n, list_slice(ws, i, i + n - 1) AS w
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM wanted),
windows AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS w
  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, lengths)),
hits AS (SELECT DISTINCT doc_id, item_id, n, i FROM windows JOIN wanted USING (n, w)),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN spans USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op7_decontamination", LEAKS_SQL)
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.in_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_warc_index")
def op4(spark, sf_dir):
    pages, folder = table(spark, sf_dir, "pages"), warc.archive_folder(spark)
    captures = warc.write_archives(pages, folder)
    parts = warc.build_index(captures, folder)
    records = warc.read_records(warc.lookup(warc.key_table(pages), parts))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def counted(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def written(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op5_pii")
def op5(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("nth"),
                               s["kind"].alias("kind"), s["end"].alias("end"))
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        "doc_id", *[counted("base", k) for k in pii.BASE_KINDS], F.sha2(written("base"), 256).alias("base_sha256"),
        written(F.sort_array(F.transform(F.concat("base", terms), place))).alias("spans"))


QUALITY_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text,
  coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM docs)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1) GROUP BY doc_id),
limits AS (SELECT doc_id, ws, greatest(201, len(ws) * 15 // 100 + 1) AS k FROM docs),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, list_slice(ws, i, i + k - 1) AS g
  FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM limits)) GROUP BY doc_id, g HAVING count(*) > 1),
lines AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
  long.doc_id IS NOT NULL AS too_long
  FROM docs LEFT JOIN again USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT * EXCLUDE (too_long), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 25 * n_words OR too_long) AS kept
FROM counted"""


@query("op6_suffix_repetition", QUALITY_SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                           "base_failed", "kept")


CONTROL_SQL = r"'([<\[])(\\*)(/?s>|/?INST\]|/?SYS>|\|(?:turn|text|end|im_start|im_end|endoftext)\|>)', '\1\2\\\3', 'g'"
CHAT_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(regexp_replace(role, {CONTROL_SQL})) + length(regexp_replace(text, {CONTROL_SQL}))) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op8_chat_format", CHAT_SQL)
def op8(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    made = stored(chat.assemble(turns.unionByName(spark.createDataFrame(probe, turns.schema)), ranks), "chat")
    return chat.digests(chat.read_back(made, ranks))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, vocabulary("byte_bpe_50k.tiktoken"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[counted("secrets", k) for k in ("assign", "access", "hex")],
                        F.sha2(written(base), 256).alias("base_sha256"), written("secrets").alias("spans"))


MIX_SQL = """
WITH docs AS (SELECT doc_id, coalesce(source, '') AS name, source IS NULL AS unnamed,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT name, unnamed, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY unnamed, name) - 1 AS nth FROM totals),
weighed AS (SELECT *, [5, 2, 1][nth % 3 + 1] AS weight, 3 * source_size AS cap FROM ranked),
steps AS (SELECT *, sum(source_size) OVER () AS everything,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
  sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighed),
marked AS (SELECT *, cap * weight_left <= weight * (everything - capped_before) AS is_full FROM steps),
targets AS (SELECT name, unnamed, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
  ELSE CAST(weight * (everything - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) AS BIGINT)
    / CAST(sum(weight) FILTER (NOT is_full) OVER () AS BIGINT) END AS target FROM marked),
laid AS (SELECT doc_id, size, source_size, target, least(3 * source_size, CAST(floor(target + 0.5) AS BIGINT)) AS words,
  sum(size) OVER (PARTITION BY name, unnamed ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS place
  FROM docs JOIN targets USING (name, unnamed))
SELECT doc_id, size, source_size, target,
  CAST(list_sum(list_transform([0, 1, 2], lambda e: least(greatest(words - e * source_size - place, 0), size))) AS BIGINT) AS taken
FROM laid"""


@query("op11_source_mixing", MIX_SQL)
def op11(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained",
                        "identity_error", "eigenvalue", "residual")


PHRASES_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex({LOWER_SQL.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang),
lengths AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM words),
runs AS (SELECT lang, k, list_slice(ws, i, i + k - 1) AS p FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM lengths)),
counts AS (SELECT lang, k, p, CAST(count(*) AS HUGEINT) AS a FROM runs GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, p, a, unnest(range(1, k)) AS c FROM counts WHERE k > 1),
scored AS (SELECT cuts.lang, cuts.k, cuts.p, cuts.a, c, h.a AS l, t.a AS r, n, 1000 * cuts.a * n // (h.a * t.a) AS score
  FROM cuts JOIN counts h ON h.lang = cuts.lang AND h.p = list_slice(cuts.p, 1, c)
  JOIN counts t ON t.lang = cuts.lang AND t.p = list_slice(cuts.p, c + 1, cuts.k) JOIN totals ON totals.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
inner_runs AS (SELECT lang, list_slice(p, i, i + s - 1) AS p, a FROM
  (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM counts WHERE k > 2))),
held AS (SELECT lang, p, max(a) AS whole FROM inner_runs GROUP BY ALL),
free AS (SELECT weakest.*, array_to_string(weakest.p, ' ') AS phrase FROM weakest LEFT JOIN held USING (lang, p)
  WHERE NOT coalesce(100 * whole >= 100 * weakest.a, false))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM free QUALIFY rank <= 2000"""


@query("op13_phrase_mining", PHRASES_SQL)
def op13(spark, sf_dir):
    return phrases.mine_phrases(table(spark, sf_dir, "documents")).drop("first_doc", "first_at")
