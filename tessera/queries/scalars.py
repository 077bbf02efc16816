"""Queries of scalar functions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from ..functions import tags as G
from ..functions import text as X
from ..functions import vectors as V
from . import RECORDS, query

WIDE = r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}]"


#: normalize_answer of text, in DuckDB.
NORMAL = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(replace(text, ',', '')), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', 'and', '')), ' ')"


def _doc(name: str, column, sql: str) -> None:
    """A query for one function of the documents' texts."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda t: t.documents.select("doc_id", column().alias("value")))


_doc("x01_token_estimate", lambda: X.token_estimate(F.col("text")), rf"((len(text) + 5 * len(regexp_extract_all(text, '{WIDE}')) + 7 * len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')) + 3) // 4)::BIGINT")
_doc("x20_normalize_answer", lambda: F.sha2(X.normalize_answer(F.col("text")), 256), f"sha256({NORMAL})")
_doc("x21_is_refusal", lambda: X.is_refusal(F.col("text")), "regexp_matches(lower(text), 'not mentioned|no information|cannot be answered|none|unknown|don''t know')")
_doc("x23_sha256", lambda: F.sha2("text", 256), "sha256(text)")
_doc("x25_resource_uris", lambda: F.size(X.resource_uris(F.replace("text", F.lit(" a"), F.lit(" ctx://a")))), r"len(list_distinct(list_transform(regexp_extract_all(replace(text, ' a', ' ctx://a'), 'ctx://[^\s<>\"''`\)\]\}，。；！？、]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))))")
_doc("x26_strip_markup", lambda: F.length(X.strip_markup_noise(F.concat(F.lit("[](x)![a](data:image/png;base64,AA)\n\n\n\n\n\n"), F.col("text")))), r"len(regexp_replace(chr(10)||chr(10)||chr(10)||text, '\n{4,}', chr(10)||chr(10)||chr(10), 'g'))")
_doc("x27_portable_segment", lambda: X.portable_segment(F.concat(F.col("lang"), F.lit("/ "), F.col("source"))), "lang || '_' || source || '_' || substr(sha256(lang || '/ ' || source), 1, 16)")
_doc("x28_outcome_norm", lambda: X.outcome_norm(F.when(F.col("lang") == "en", " Success ").otherwise(F.col("lang"))), "CASE WHEN lang = 'en' THEN 'success' ELSE 'unknown' END")
_doc("x31_preview_id", lambda: X.preview_id(F.when(F.col("lang") == "en", F.col("source")), F.col("text")), "CASE WHEN lang = 'en' THEN 'tr_' || source || '_' || substr(sha256(text), 1, 16) ELSE 'tr_' || substr(sha256(text), 1, 24) END")
#: The first paragraph of texts that begin with `# `, and their headings.
OVERVIEW = r"""array_to_string(list_transform(list_slice(list_filter(string_split('# ' || text, chr(10)), lambda x: regexp_matches(x, '^#{1,3}\s+\S')), 1, 24), lambda x: repeat('  ', len(regexp_extract(x, '^(#+)', 1)) - 1) || '- ' || regexp_replace(x, '^#+\s+', ''))
 || list_transform(list_slice(list_filter(regexp_split_to_array('# ' || text, '\n\s*\n'), lambda p: NOT regexp_matches(p, '^\s*#') AND trim(p) <> ''), 1, 1), lambda p: substr(trim(regexp_replace(p, '\s+', ' ', 'g')), 1, 400)), chr(10))"""
_doc("x12_doc_overview", lambda: F.sha2(X.doc_overview(F.concat(F.lit("# "), F.regexp_replace("text", r"\n", "\n\n"))), 256), f"sha256({OVERVIEW.replace("'# ' || text", "'# ' || replace(text, chr(10), chr(10) || chr(10))")})")
_doc("x11_summary_section", lambda: F.sha2(X.summary_section(F.concat(F.lit("Summary: "), F.regexp_replace("text", r"\. ", ".\n\n"))), 256), r"sha256(trim(regexp_replace(regexp_split_to_array('Summary: ' || replace(text, '. ', '.' || chr(10) || chr(10)), '\n\s*\n')[1][9:], '\s+', ' ', 'g')))")
_doc("x11_summary_heading", lambda: F.sha2(X.summary_section(F.concat(F.lit("# T\n## Summary\n"), F.col("text"), F.lit("\n# Next\nmore"))), 256), r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))")
_doc("x03_truncate", lambda: F.sha2(X.truncate_to_tokens(F.col("text"), 100), 256), "sha256(CASE WHEN ceil(len(text) / 4) <= 100 THEN text ELSE left(text, 294) || chr(10) || '...' || chr(10) || right(text, 98) END)")
_doc("x10_finite_or", lambda: G.finite_or(F.when(F.col("lang") == "en", "NaN").when(F.col("lang") == "de", "x").otherwise("1.5"), -1.0), "CASE WHEN lang IN ('en', 'de') THEN -1.0 ELSE 1.5 END")
_doc("x19_masked", lambda: F.sha2(X.mask(F.col("text"), {k: X.PRIVACY[k] for k in ("email", "secret")}), 256), r"""sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[MASKED]', 'g'), '(?i)\b(?:api[_-]?key|token|password|secret)\s*[=:]\s*"?[A-Za-z0-9_\-]{8,}"?', '[MASKED]', 'g'))""")
_doc("x24_conflict_tags", lambda: X.conflict_tags(F.replace("text", F.lit("\n"), F.lit('<!-- CONFLICT [{"id":"1","text":"a"},{"id":"2","text":"b"}] -->')))["conflict_num"], "(2 * (len(text) - len(replace(text, chr(10), ''))))::INTEGER")
_doc("x13_render_entry", lambda: X.render_entry(F.concat(F.lit('a"<'), F.col("lang")), F.lit("full"), F.lit(0.126).cast("double"), F.col("source")), """'<entry uri="a&quot;&lt;' || lang || '" tier="full" score="0.13">' || chr(10) || source || chr(10) || '</entry>'""")

@query("x02_hotness", f"{RECORDS} SELECT doc_id, round(1 / (1 + exp(-ln(1 + active_count))) * pow(2, -greatest((epoch_us(TIMESTAMP '2024-01-20') - epoch_us(updated_at)) / 86400e6, 0) / 7), 6) AS value FROM records")
def _(t):
    return t.records.select("doc_id", F.round(G.hotness(F.col("active_count"), F.col("updated_at"), F.lit(datetime(2024, 1, 20, tzinfo=UTC))), 6).alias("value"))


@query("x05_normalize_tags", f"{RECORDS} SELECT doc_id, ['lang=' || lang, 'src=x'] AS value FROM records")
def _(t):
    return t.records.select("doc_id", G.normalize_tags(F.array(F.lit("LANG = zz"), F.lit("bad"), F.get("search_tags", F.lit(1)), F.get("search_tags", F.lit(0)), F.lit("src=x"))).alias("value"))


@query("x06_merge_tags", f"{RECORDS} SELECT doc_id, ['team=old', 'score=-0.5', 'count=1', 'lang=' || lang] AS value FROM records")
def _(t):
    new = F.array(*map(F.lit, ["score+=0.2", "score+=0.2", "score-=1", "count+=2", "count=0", "count+=1"]), F.get("search_tags", F.lit(0)))
    return t.records.select("doc_id", G.merge_tags(F.array(F.lit("bad-existing"), F.lit("team=old"), F.lit("score=0.1")), new)["tags"].alias("value"))


@query("x07_preserve_type", f"{RECORDS} SELECT doc_id, ['memory_type=a', 'lang=' || lang, 'src=' || source] AS value FROM records")
def _(t):
    return t.records.select("doc_id", G.preserve_type_tag(F.array(F.lit("k=v"), F.lit("memory_type=a")), F.concat(F.array(F.lit("memory_type=b")), F.col("search_tags"))).alias("value"))


@query("x08_merge_field", "SELECT event_id, value + 1.5 AS total, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'set' END AS once, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'old' END AS latest FROM events")
def _(t):
    even = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")
    return t.events.select("event_id", G.merge_field("sum", F.col("value"), F.lit(1.5)).alias("total"), G.merge_field("immutable", even, F.lit("set")).alias("once"), G.merge_field("replace", F.lit("old"), even).alias("latest"))


@query("x09_apply_blocks", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, substr(text, 6, 4) AS a, substr(text, 41, 30) AS b FROM documents),
 n AS (SELECT *, CASE WHEN coalesce(a, '') = '' THEN -1 ELSE (len(text) - len(replace(text, a, ''))) // len(a) END AS na FROM d),
 o AS (SELECT *, CASE WHEN na = 1 THEN replace(text, a, lang) ELSE text END AS once FROM (SELECT n.*, lang FROM n JOIN documents USING (doc_id))),
 m AS (SELECT *, CASE WHEN coalesce(b, '') = '' THEN -1 ELSE (len(once) - len(replace(once, b, ''))) // len(b) END AS nb FROM o)
 SELECT doc_id, sha256(CASE WHEN text = '' THEN lang WHEN na NOT IN (1, -1) THEN text WHEN nb = 1 THEN replace(once, b, '') ELSE once END) AS value,
  CASE WHEN text = '' THEN NULL WHEN na NOT IN (1, -1) THEN 'found ' || na || ' times: ' || a WHEN nb NOT IN (1, -1) THEN 'found ' || nb || ' times: ' || b END AS error FROM m""")
def _(t):
    """Two blocks cut from each text: a short one, which often occurs twice, is replaced, a long one deleted."""
    block = lambda search, replace: F.struct(search.alias("search"), replace.alias("replace"))
    blocks = F.array(block(F.substring("text", 6, 4), F.col("lang")), block(F.substring("text", 41, 30), F.lit(None).cast("string")))
    done = t.documents.select("doc_id", X.apply_blocks(F.col("text"), blocks).alias("r"))
    return done.select("doc_id", F.sha2("r.text", 256).alias("value"), F.col("r.error").alias("error"))


@query("x04_time_score", f"{RECORDS} SELECT doc_id, round(pow(0.5, greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400e6 - 3, 0) / 7), 6) AS value FROM records")
def _(t):
    from ..operators.retrieve import time_score

    return t.records.select("doc_id", F.round(time_score(F.col("updated_at"), F.lit(datetime(2024, 2, 1, tzinfo=UTC)), 3), 6).alias("value"))


def _language_sql(table: str) -> str:
    """Rows (id, text) of a table with their language, fallback en, in DuckDB."""
    n = lambda r: f"len(regexp_extract_all(t, '{r}'))"
    words = {k: "', '".join(v.split()) for k, v in X.STOP_WORDS.items()}
    score = {k: f"len(list_filter(w, lambda x: x IN ('{v}')))" + (f" + {n(X.ACCENTS[k])}" if k in X.ACCENTS else "") for k, v in words.items()}
    hint = {k: f"({n(X.ACCENTS[k])} > 0 OR len(list_filter(w, lambda x: x IN ('{words[k]}'))) >= 4)" for k in X.ACCENTS}
    latin = " ".join(f"WHEN s_{k} = best THEN CASE WHEN len(w) >= 6 AND h_{k} AND best >= 3 AND best >= s_en + 2 AND len(w) >= 20 AND best >= 6 AND best >= s_en + 4 THEN '{k}' ELSE 'en' END" for k in X.ACCENTS)
    noise = X.NOISE.replace("'", "''")
    dominant = lambda c: f"{c} >= 10 AND {c} * 100 >= total * 95"
    return rf"""
WITH a AS (SELECT id, lower(regexp_replace(coalesce(text, ''), '{noise}', ' ', 'g')) AS t FROM {table}),
b AS (SELECT *, regexp_extract_all(t, '[a-z\x{{00C0}}-\x{{024F}}]+') AS w, {", ".join(f"{n(v)} AS n_{k}" for k, v in X.LETTERS.items())}, {n(X.GRAMMAR)} AS grammar FROM a),
c AS (SELECT *, n_zh + n_kana + n_ko + n_ru + n_ar + n_latin AS total, greatest(n_zh, n_ko, n_ru, n_ar) AS most, {", ".join(f"{v} AS s_{k}" for k, v in score.items())}, {", ".join(f"{v} AS h_{k}" for k, v in hint.items())} FROM b),
d AS (SELECT *, greatest({", ".join(f"s_{k}" for k in score)}) AS best FROM c)
SELECT id, CASE WHEN total = 0 THEN 'en'
  WHEN n_kana >= 3 AND ((n_kana >= 10 AND (n_zh + n_kana) * 100 >= total * 95 AND n_kana * 10 >= (n_zh + n_kana) * 3) OR (grammar >= 2 AND grammar * 10 >= n_zh + n_kana)) THEN 'ja'
  WHEN n_zh = most AND n_zh >= 2 AND n_zh * 5 >= total THEN 'zh-CN'
  WHEN n_zh < most AND n_ko = most AND {dominant("n_ko")} THEN 'ko' WHEN n_zh < most AND n_ko < most AND n_ru = most AND {dominant("n_ru")} THEN 'ru'
  WHEN n_zh < most AND n_ko < most AND n_ru < most AND n_ar = most AND {dominant("n_ar")} THEN 'ar'
  WHEN n_latin = 0 OR len(w) < 3 OR s_en = best THEN 'en' {latin} ELSE 'en' END AS value FROM d"""


@query("x14_detect_language", "SELECT id AS doc_id, value FROM (" + _language_sql("(SELECT doc_id AS id, text FROM documents)") + ")")
def _(t):
    return t.documents.select("doc_id", X.detect_language(F.col("text")).alias("value"))


SAID = "(SELECT conv_id AS id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user' AND trim(text) <> ''), string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id)"


@query("x15_conversation_language", "SELECT id AS conv_id, value FROM (" + _language_sql(SAID) + ")")
def _(t):
    from ..operators.windows import conversation_language

    return conversation_language(t.conversations)


@query("x22_epoch_to_ts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_ms(date_trunc('second', ts)) END AS value FROM events")
def _(t):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    value = F.when(F.col("event_id") % 3 == 0, -1).when(F.col("event_id") % 3 == 1, seconds).otherwise(seconds * 1000)
    return t.events.select("event_id", F.unix_millis(X.epoch_to_ts(value)).alias("value"))


@query("x29_vector_math", "SELECT vec_id, round(sqrt(list_dot_product(x, x)), 5) AS norm, round(list_sum(list_transform(x, lambda v: abs(v))), 5) AS l1, round(list_distance(x, list_reverse(x)), 5) AS l2, round(list_cosine_similarity(x, list_reverse(x)), 5) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def _(t):
    v = F.col("embedding")
    zero = F.transform(v, lambda x: x * 0)
    return t.embeddings.select("vec_id", F.round(V.l2_norm(v), 5).alias("norm"), F.round(V.l1(v, zero), 5).alias("l1"), F.round(V.l2(v, F.reverse(v)), 5).alias("l2"), F.round(V.cosine(v, F.reverse(v)), 5).alias("cosine"))


@query("x30_message_tokens", "SELECT conv_id, turn, ((len(text) + 3) // 4 + 2)::BIGINT AS value FROM conversations")
def _(t):
    empty = F.lit(None).cast("string")
    part = lambda kind, **v: F.struct(F.lit(kind).alias("type"), *(v.get(k, empty).alias(k) for k in ("text", "abstract", "tool_id", "tool_name", "tool_input", "tool_output")))
    return t.conversations.select("conv_id", "turn", X.message_tokens(F.array(part("text", text=F.col("text")), part("tool", tool_id=F.lit("t1"), tool_name=F.lit("grep")), part("image", text=F.lit("xxxx")))).alias("value"))


def _normal(of: str) -> str:
    return NORMAL.replace("replace(text,", f"replace({of},")


@query("a12_evidence_recall", f"""WITH n AS (SELECT doc_id, {_normal("substr(text, 1, 90)")} AS e, {_normal("substr(text, 31, 300)")} AS c FROM documents WHERE trim(text) <> ''),
 w AS (SELECT *, list_filter(string_split(e, ' '), lambda x: x <> '') AS es, string_split(c, ' ') AS cs FROM n)
 SELECT doc_id, contains(c, e) OR (len(es) >= 4 AND len(list_filter(es, lambda x: list_contains(cs, x))) >= 0.8 * len(es)) AS value FROM w""")
def _(t):
    """Whether a text's first 90 characters are found in its characters 31 to 330."""
    from ..operators.evaluation import evidence_recall

    return t.documents.where(F.trim("text") != "").select("doc_id", evidence_recall(F.substring("text", 1, 90), F.substring("text", 31, 300)).alias("value"))


@query("a12_token_f1", f"""WITH p AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_normal("text")}, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
 q AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split({_normal("left(text, len(text) // 2)")}, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
 f AS (SELECT doc_id, sum(least(coalesce(p.n, 0), coalesce(q.n, 0))) AS same, sum(coalesce(p.n, 0)) + sum(coalesce(q.n, 0)) AS total FROM p FULL JOIN q USING (doc_id, w) GROUP BY doc_id)
 SELECT doc_id, round(coalesce(2.0 * same / total, 0), 9) AS f1 FROM documents LEFT JOIN f USING (doc_id)""")
def _(t):
    """Of each text and its first half."""
    from ..operators.evaluation import token_f1

    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return token_f1(t.documents.withColumn("other", half), "doc_id", "text", "other").withColumn("f1", F.round("f1", 9))
