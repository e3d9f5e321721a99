"""Queries over the driver's tables, one or more for each operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.functions import text as T
from quern.functions.running import running_total
from quern.operators import filters, mix, preferences, profile, reports, sanitize, scaling, score, sft, splits, tokens, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select(*(columns or ("doc_id", "text")))


#: Texts hold no code, thoughts or chatter, so the cleaning queries run over texts that a rule varies by doc_id.
def _varied(cases: list[str], spark_side: bool) -> str:
    newline = "'\\n'" if spark_side else "chr(10)"
    return "CASE doc_id % " + str(len(cases)) + " " + " ".join(f"WHEN {i} THEN {c.replace('NL', newline)}" for i, c in enumerate(cases)) + " END"


_CHATTER = ["'Sure! Here is the python code:' || NL || text", "text || NL || 'Hope this helps!'", "'Certainly, here is the solution:' || NL || text || NL || 'Good luck!'", "'Here is a: Sure, he said: ' || text", "text", "text || NL || 'Let me know if you have any questions.'", "'Alright, below is the implementation:' || NL || text || NL || 'Happy coding!!'"]
_CODE = ["text", "'def f(x):' || NL || '    for y in x:' || NL || '        print(y)' || NL || text", "'import boto3' || NL || 'def f(x):' || NL || '    if x:' || NL || text", "'  def f(x):' || NL || '    while x: pass' || NL || text || NL || '  '", "'   '"]
_FENCED = ["text", "text || NL || '```python' || NL || 'x = ' || doc_id || NL || '```' || NL || text", "'```' || NL || 'def f(:' || NL || '```'", "'```Python' || NL || NL || '```' || '```' || NL || 'y = 1' || NL || '```'", "'a = ' || doc_id"]
CHATTER, CODE, FENCED = (_varied(c, True) for c in (_CHATTER, _CODE, _FENCED))
CHATTER_SQL, CODE_SQL, FENCED_SQL = (_varied(c, False) for c in (_CHATTER, _CODE, _FENCED))
#: White space in DuckDB's trim, as in functions.text.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
STRIP = f"trim(%s, {_WS})"


@query(f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE length({STRIP % 'text'}) > 30")
def doc_min_length(spark: SparkSession, d: str) -> DataFrame:
    return filters.min_length(docs(spark, d)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH a AS (SELECT doc_id, {CODE_SQL} AS t FROM documents) SELECT doc_id, length(t) AS n_chars FROM a WHERE {STRIP % 't'} <> ''")
def nonblank(spark: SparkSession, d: str) -> DataFrame:
    return filters.nonblank(docs(spark, d).select("doc_id", F.expr(CODE).alias("text"))).select("doc_id", F.length("text").cast("long").alias("n_chars"))


_BANNED_SQL = " OR ".join(f"contains(t, '{b}')" for b in filters.BANNED)


@query(f"WITH a AS (SELECT doc_id, {CODE_SQL} AS t FROM documents) SELECT doc_id, md5({STRIP % 't'}) AS digest FROM a WHERE length(t) BETWEEN 200 AND 25000 AND contains(t, 'def ') AND (contains(t, 'for ') OR contains(t, 'while ') OR contains(t, 'if ')) AND NOT ({_BANNED_SQL})")
def code_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.code_quality(docs(spark, d).select("doc_id", F.expr(CODE).alias("text"))).select("doc_id", F.md5("text").alias("digest"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, problem, solution: a user's turn and the assistant's that follows it."""
    t = table(spark, d, "conversations")
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("problem"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("solution"))
    return u.join(a, ["conv_id", "turn"])


_PAIRS_SQL = "SELECT u.conv_id, u.turn, u.text AS problem, a.text AS solution FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"


@query(f"WITH p AS ({_PAIRS_SQL}) SELECT conv_id, turn, md5('Problem:' || chr(10) || {STRIP % 'problem'} || chr(10) || chr(10) || 'Solution:' || chr(10) || CASE WHEN contains(solution, '<think>') THEN {STRIP % 'solution'} ELSE '<think>' || chr(10) || {STRIP % 'solution'} || chr(10) || '</think>' END) AS digest FROM p WHERE {STRIP % 'problem'} <> '' AND {STRIP % 'solution'} <> ''")
def reasoning_template(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("conv_id", "turn", F.md5(filters.rendered_reasoning(F.col("problem"), F.col("solution"), think=True)).alias("digest")).where("digest is not null")


@query(f"WITH p AS ({_PAIRS_SQL}), v AS (SELECT *, CASE WHEN turn % 4 = 0 THEN '<think>a</think>' || solution ELSE solution END AS s FROM p) SELECT conv_id, turn, md5(CASE WHEN contains(s, '<think>') THEN s ELSE '<think>' || chr(10) || 'Analyze the problem and solve systematically.' || chr(10) || '</think>' || chr(10) || s END) AS digest FROM v")
def think_wrap(spark: SparkSession, d: str) -> DataFrame:
    rows = turn_pairs(spark, d).withColumn("s", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>a</think>"), "solution")).otherwise(F.col("solution")))
    return rows.select("conv_id", "turn", F.md5(filters.with_think(F.col("s"))).alias("digest"))


@query(f"WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' END AS instruction, CASE WHEN doc_id % 2 = 0 THEN '  ' || lang END AS problem, source AS prompt FROM documents) SELECT doc_id, {STRIP % '''coalesce(nullif(instruction, ''), nullif(problem, ''), nullif(prompt, ''), '')'''} AS prompt FROM a")
def first_truthy(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d, "doc_id", "lang", "source").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN '' END").alias("instruction"), F.expr("CASE WHEN doc_id % 2 = 0 THEN '  ' || lang END").alias("problem"), F.col("source").alias("prompt"))
    return rows.select("doc_id", filters.prompt_of("instruction", "problem", "prompt").alias("prompt"))


def _settled_sql(patterns: tuple[str, ...], column: str) -> str:
    out = STRIP % column
    for _ in range(4):
        for p in patterns:
            out = STRIP % f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '', 'i')"
    return out


@query(f"WITH a AS (SELECT doc_id, {CHATTER_SQL} AS t FROM documents) SELECT doc_id, md5({_settled_sql(sanitize.PREAMBLES, 't')}) AS digest FROM a")
def strip_preamble(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(sanitize.without_preamble(F.expr(CHATTER))).alias("digest"))


@query(f"WITH a AS (SELECT doc_id, {CHATTER_SQL} AS t FROM documents) SELECT doc_id, md5({_settled_sql(sanitize.POSTAMBLES, 't')}) AS digest FROM a")
def strip_postamble(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(sanitize.without_postamble(F.expr(CHATTER))).alias("digest"))


@query(f"WITH a AS (SELECT doc_id, {FENCED_SQL} AS t FROM documents) SELECT doc_id, list_filter(regexp_extract_all(t, '(?is)```(?:python)?\\s*\\n(.*?)```', 1), lambda x: {STRIP % 'x'} <> '')[1] AS snippet FROM a")
def fence_extract(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", filters.fenced_snippet(F.expr(FENCED)).alias("snippet"))


@query(f"WITH a AS (SELECT doc_id, {FENCED_SQL} AS t FROM documents) SELECT doc_id, md5(split_part(t, '```', 1)) AS digest FROM a")
def code_body_cut(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(filters.code_body(F.expr(FENCED))).alias("digest"))


@query()
def py_ast_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.expr(FENCED).alias("answer"))
    return filters.code_gate(filters.python_snippet(rows, "answer"), "answer").select("doc_id", "snippet")


def preference_records(spark: SparkSession, d: str) -> DataFrame:
    """pos, json: neighbouring documents as pairs whose fields vary in shape by doc_id."""
    t = docs(spark, d)
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    rows = t.join(other, "doc_id").withColumn("ask", F.substring("text", 1, 40))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    flat = F.to_json(F.struct(F.concat(F.lit("[INST] "), "ask").alias("prompt"), F.col("text").alias("chosen"), F.col("other").alias("rejected")))
    listed = F.to_json(F.struct(F.array(turn("system", F.lit("Be kind.")), turn("user", F.col("ask")), turn("assistant", F.col("text"))).alias("chosen"), F.array(turn("user", F.col("ask")), turn("assistant", F.col("other"))).alias("rejected")))
    single = F.to_json(F.struct(F.lit("").alias("system"), F.lit("").alias("prompt"), F.col("ask").alias("question"), turn("assistant", F.col("text")).alias("chosen"), turn("assistant", F.col("other")).alias("rejected")))
    ends = F.to_json(F.struct(F.col("ask").alias("instruction"), F.array(turn("user", F.col("ask"))).alias("chosen"), F.concat(F.lit('{"a": 1} '), "other").alias("rejected")))
    return rows.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 4 == 0, flat).when(F.col("doc_id") % 4 == 1, listed).when(F.col("doc_id") % 4 == 2, single).otherwise(ends).alias("json"))


_WORDS_SQL = "len(list_filter(regexp_split_to_array(%s, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> ''))"
_PREF_SQL = f"""WITH p AS (SELECT a.doc_id AS pos, CASE WHEN a.doc_id % 4 = 0 THEN trim('[INST] ' || left(a.text, 40), {_WS}) ELSE {STRIP % 'left(a.text, 40)'} END AS prompt, CASE WHEN a.doc_id % 4 = 3 THEN '' ELSE {STRIP % 'a.text'} END AS chosen, CASE WHEN a.doc_id % 4 = 3 THEN trim('{{"a": 1}} ' || b.text, {_WS}) ELSE {STRIP % 'b.text'} END AS rejected, CASE WHEN a.doc_id % 4 = 1 THEN 'Be kind.' END AS system FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), w AS (SELECT *, {_WORDS_SQL % 'chosen'} AS c, {_WORDS_SQL % 'rejected'} AS r FROM p)"""


@query(_PREF_SQL + " SELECT pos, md5(prompt) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected, system FROM w")
def pref_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = preferences.normalised(preference_records(spark, d))
    return rows.select("pos", F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), "system")


@query(_PREF_SQL + " SELECT pos, c::BIGINT AS chosen_words, r::BIGINT AS rejected_words FROM w WHERE prompt <> '' AND chosen <> '' AND rejected <> '' AND chosen <> rejected AND c <= 350 AND r <= 350 AND (least(c, r) = 0 OR greatest(c, r) <= 8.0 * least(c, r))")
def pref_gate(spark: SparkSession, d: str) -> DataFrame:
    return preferences.pairs(preference_records(spark, d)).select("pos", "chosen_words", "rejected_words")


_CLEAN_SQL = f"SELECT conv_id, turn, {STRIP % 'role'} AS role, rtrim(trim(text, chr(10) || chr(13)), {_WS}) AS content FROM conversations"


@query(f"WITH c AS ({_CLEAN_SQL}), g AS (SELECT conv_id, count(*) AS raw FROM conversations GROUP BY 1) SELECT conv_id, count(*) AS n_turns, sum(length(content))::BIGINT AS n_chars FROM c JOIN g USING (conv_id) WHERE content <> '' GROUP BY conv_id, raw HAVING raw >= 2 AND bool_or(role = 'user') AND bool_or(role = 'assistant')")
def sft_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = sft.gate(sft.dialogues(table(spark, d, "conversations")))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, t: a + F.length(t["content"])).alias("n_chars"))


@query(f"SELECT conv_id, md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || {STRIP % 'text'} || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def chatml_render(spark: SparkSession, d: str) -> DataFrame:
    return sft.dialogues(table(spark, d, "conversations")).select("conv_id", F.md5(sft.chatml(F.col("messages"), F.lit(" Be brief. "), cue=True)).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN md5('<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) ELSE md5('<|im_start|>' || text) END AS digest FROM conversations")
def prompt_wrap(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("<|im_start|>"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(sft.wrapped_prompt(text)).alias("digest"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, count(*) AS n, min(turn) AS first_turn FROM r WHERE back <= 4 GROUP BY conv_id")
def last_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("m"))
    kept = rows.select("conv_id", sft.last_turns(F.col("m"), 2).alias("m"))
    return kept.select("conv_id", F.size("m").cast("long").alias("n"), F.element_at("m", 1).alias("first_turn"))


@query(f"WITH g AS (SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share, round(sum(length({STRIP % 'text'})) / count(*), 6) AS mean_chars, (trunc(sum(length({STRIP % 'text'})) / 3.8::DOUBLE))::BIGINT AS tokens, min(doc_id) AS \"first\" FROM documents GROUP BY source) SELECT *, row_number() OVER (ORDER BY n DESC, \"first\") AS place FROM g")
def family_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.family_stats(docs(spark, d, "source", "text", "doc_id"), "source", pos="doc_id")
    return rows.select("source", "n", F.round("share", 6).alias("share"), F.round("mean_chars", 6).alias("mean_chars"), "tokens", "first", F.col("place").cast("long").alias("place"))


def _tagged() -> Column:
    return F.create_map(F.lit("domain"), F.col("lang"), F.lit("difficulty"), F.expr("if(n_chars > 1500, 'hard', 'easy')"), F.lit("other"), F.col("source"))


@query("WITH t AS (SELECT doc_id, source, 'domain:' || lang AS tag FROM documents UNION ALL SELECT doc_id, source, 'difficulty:' || CASE WHEN n_chars > 1500 THEN 'hard' ELSE 'easy' END FROM documents) SELECT source, tag, count(*) AS n, min(doc_id) AS \"first\" FROM t GROUP BY source, tag")
def family_tags(spark: SparkSession, d: str) -> DataFrame:
    return profile.family_tags(docs(spark, d, "doc_id", "source", "lang", "n_chars").withColumn("meta", _tagged()), "source", "meta", "doc_id")


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) SELECT source, doc_id, nth FROM r WHERE nth <= 2")
def family_samples(spark: SparkSession, d: str) -> DataFrame:
    return profile.family_samples(docs(spark, d, "source", "doc_id"), "source", "doc_id").select("source", "doc_id", F.col("nth").cast("long").alias("nth"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_object('signal', CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, 'task', CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'task' || event_id % 4 END) END AS raw FROM events), m AS (SELECT raw AS j FROM e) SELECT coalesce(nullif(json_extract_string(j, '$.signal'), ''), nullif(json_extract_string(j, '$.task'), ''), 'unclassified') AS family, count(*) AS n FROM m GROUP BY 1")
def metadata_family(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("junk")).otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("signal"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("task"), F.col("event_id") % 4)).alias("task"))))
    return e.select(profile.family(profile.metadata(raw)).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


_MARKERS_SQL = " UNION ALL ".join(f"SELECT '{m}' AS marker, count(*) FILTER (contains(t, '{m}')) AS n FROM a" for m in profile.MARKERS)


@query(f"WITH a AS (SELECT {CODE_SQL} AS t FROM documents) {_MARKERS_SQL}")
def marker_freq(spark: SparkSession, d: str) -> DataFrame:
    return profile.marker_counts(docs(spark, d).select(F.expr(CODE).alias("text")))


@query(f"WITH a AS (SELECT {CODE_SQL} AS t FROM documents ORDER BY doc_id LIMIT 20) {_MARKERS_SQL}")
def marker_first(spark: SparkSession, d: str) -> DataFrame:
    return profile.marker_counts(profile.first_rows(docs(spark, d).select("doc_id", F.expr(CODE).alias("text")), "doc_id"))


@query("SELECT min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, trunc(avg(length(text)) / 4)::BIGINT AS tokens FROM documents")
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.length_profile(docs(spark, d, "text")).withColumn("mean", F.round("mean", 6))


@query("WITH p AS (SELECT url || CASE page_id % 4 WHEN 0 THEN '.parquet' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.jsonl.gz' ELSE '.txt' END AS path FROM pages), k AS (SELECT unnest(['.parquet', '.jsonl', '.jsonl.gz', '.bin']) AS suffix) SELECT suffix, count(*) AS n FROM p JOIN k ON ends_with(path, suffix) GROUP BY suffix")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return profile.suffix_counts(table(spark, d, "pages").select(F.expr("url || CASE page_id % 4 WHEN 0 THEN '.parquet' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.jsonl.gz' ELSE '.txt' END").alias("path")))


_HASH_SQL = "(('0x' || left(sha256(text), 8))::BIGINT % 100000) / 100000.0::DOUBLE"
_SPLIT_SQL = f"CASE WHEN {_HASH_SQL} < 0.05 THEN 'test' WHEN {_HASH_SQL} < 0.1 THEN 'val' ELSE 'train' END"


@query(f"SELECT doc_id, {_SPLIT_SQL} AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.hash_split(docs(spark, d)).select("doc_id", "split")


@query(f"WITH s AS (SELECT {_SPLIT_SQL} AS split, strlen(text) + 1 AS n FROM documents) SELECT split, count(*) AS docs, sum(n)::BIGINT AS tokens, round(100.0 * sum(n) / sum(sum(n)) OVER (), 6) AS share, round(sum(n) * 2 / 1048576.0, 6) AS mb FROM s GROUP BY split")
def hash_split_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.hash_split(docs(spark, d)).withColumn("n", tokens.byte_count(F.col("text")))
    return splits.split_totals(rows, "n").select("split", "docs", "tokens", F.round("share", 6).alias("share"), F.round("mb", 6).alias("mb"))


@query("WITH n AS (SELECT doc_id, text, (trunc(length(text) * (1.0::DOUBLE - 0.1 - 0.2)))::INT AS a, (trunc(length(text) * (1.0::DOUBLE - 0.2)))::INT AS b FROM documents) SELECT doc_id, md5(substr(text, 1, a)) AS train, md5(substr(text, a + 1, b - a)) AS val, md5(substr(text, b + 1)) AS test FROM n")
def char_split(spark: SparkSession, d: str) -> DataFrame:
    s = splits.char_split(F.col("text"), 0.1, 0.2)
    return docs(spark, d).withColumn("s", s).select("doc_id", *[F.md5(f"s.{k}").alias(k) for k in ("train", "val", "test")])


@query("WITH r AS (SELECT doc_id, strlen(text) + 1 AS n, sum(strlen(text) + 1) OVER (ORDER BY doc_id) AS upto FROM documents) SELECT doc_id, n FROM r WHERE upto - n < 500000")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", tokens.byte_count(F.col("text")).alias("n"))
    return splits.token_prefix(rows, "n", 500_000, "doc_id", 256)


@query("WITH r AS (SELECT coalesce(length(text) >= 1000, false) AS keep, coalesce(sum(CASE WHEN length(text) >= 1000 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS skipped FROM r WHERE before < 60")
def budget_counters(spark: SparkSession, d: str) -> DataFrame:
    return splits.budget_counts(docs(spark, d), F.length("text") >= 1000, 60, "doc_id", 256)


@query("WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'constraints' WHEN 3 THEN 'dialogue' ELSE 'synthetic' END AS pillar FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY pillar ORDER BY doc_id) AS nth FROM p) SELECT doc_id, pillar FROM r WHERE nth <= CASE pillar WHEN 'code' THEN 75 WHEN 'reasoning' THEN 75 WHEN 'constraints' THEN 60 WHEN 'dialogue' THEN 45 ELSE 46 END")
def sft_pillar_mix(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d, "doc_id")
    return splits.pillar_mix({name: t.where(F.col("doc_id") % 5 == i) for i, (name, _) in enumerate(splits.PILLARS)}, 301, ["doc_id"])


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) - 1 AS rank, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN rank >= n - greatest(50, trunc(n * 0.05)) THEN 'val' ELSE 'train' END AS split FROM r")
def hash_rank_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.tail_split(docs(spark, d, "doc_id"), "doc_id")


_SIZES_SQL = "SELECT (20000000 + p_partkey * 350000)::BIGINT AS budget FROM part"


def model_sizes(spark: SparkSession, d: str) -> DataFrame:
    """budget: a model size for each part, from 20 M up."""
    return table(spark, d, "part").select(F.expr("20000000L + p_partkey * 350000L").alias("budget"))


@query(f"""WITH b AS (SELECT budget AS params, budget * 40 AS total FROM ({_SIZES_SQL})), s(source, ratio, pool, kind) AS (VALUES ('FineWeb-Edu', 0.42::DOUBLE, NULL::BIGINT, 'open'), ('DCLM-Edu', 0.18, NULL, 'open'), ('The-Stack-Filtered', 0.16, NULL, 'open'), ('NuminaMath-CoT', 0.08, 220000000, 'pool'), ('OpenMathReasoning', 0.06, 200000000, 'pool'), ('SLM-Synthetic-Pretrain', 0.1, NULL, 'anchor')),
r AS (SELECT *, CASE WHEN params < 200000000 THEN 0.11::DOUBLE WHEN params <= 600000000 THEN 0.09 ELSE 0.05 END AS anchor, CASE WHEN params BETWEEN 200000000 AND 600000000 THEN 3.0::DOUBLE ELSE 2.2 END AS times FROM b),
t AS (SELECT *, CASE kind WHEN 'anchor' THEN trunc(total * anchor) WHEN 'pool' THEN least(trunc(total * ratio), trunc(pool * times)) END AS tokens FROM s CROSS JOIN r),
u AS (SELECT *, total - sum(tokens) OVER (PARTITION BY params) AS rest, sum(ratio) FILTER (kind = 'open') OVER (PARTITION BY params) AS ratios FROM t)
SELECT total, params, source, round(coalesce(tokens, ratio / ratios * rest) / total, 9) AS weight FROM u""")
def curriculum_weights(spark: SparkSession, d: str) -> DataFrame:
    budgets = model_sizes(spark, d).select((F.col("budget") * 40).alias("total"), F.col("budget").alias("params"))
    return mix.curriculum_table(budgets).withColumn("weight", F.round("weight", 9))


BUDGET, SHARD = 3_000_000, 250_000


def mix_documents(spark: SparkSession, d: str) -> DataFrame:
    """source (the language), pos, n: every document's bytes and end mark."""
    rows = docs(spark, d, "doc_id", "lang", "text").select(F.col("lang").alias("source"), F.col("doc_id").alias("pos"), tokens.byte_count(F.col("text")).alias("n"))
    return rows


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "en", 0.4), (1, "fr", 0.3), (2, "de", 0.2), (3, "es", 0.1)], "id int, source string, weight double")


_MIX_SQL = f"""WITH w(source, weight) AS (VALUES ('en', 0.4::DOUBLE), ('fr', 0.3), ('de', 0.2), ('es', 0.1)),
x AS (SELECT lang AS source, doc_id AS pos, strlen(text) + 1 AS n, sum(strlen(text) + 1) OVER (PARTITION BY lang ORDER BY doc_id) AS upto, sum(strlen(text) + 1) OVER (PARTITION BY lang) AS size FROM documents),
p AS (SELECT *, weight / (SELECT sum(weight) FROM w) AS share FROM x JOIN w USING (source)),
e AS (SELECT *, unnest(range(ceil(share * {BUDGET} / size)::BIGINT)) AS epoch FROM p),
t AS (SELECT *, (epoch * size + upto - n) / share AS turn FROM e),
o AS (SELECT source, pos, epoch, n, (sum(n) OVER (ORDER BY turn, source, pos) - n)::BIGINT AS start FROM t WHERE turn < {BUDGET}),
f AS (SELECT * FROM o WHERE start < {BUDGET})"""


@query(_MIX_SQL + " SELECT source, pos, epoch, n, start FROM f")
def pack_order(spark: SparkSession, d: str) -> DataFrame:
    return mix.weighted_order(mix_documents(spark, d), mix_weights(spark), BUDGET, 256)


_PIECES_SQL = _MIX_SQL + f""", g AS (SELECT *, least(start + n, {BUDGET}) AS stop FROM f), h AS (SELECT *, unnest(range(start // {SHARD}, (stop - 1) // {SHARD} + 1)) AS shard FROM g),
k AS (SELECT source, pos, epoch, shard, greatest(start, shard * {SHARD}) - shard * {SHARD} AS "at", greatest(start, shard * {SHARD}) - start AS "first", least(stop, (shard + 1) * {SHARD}) - greatest(start, shard * {SHARD}) AS "length" FROM h)"""


@query(_PIECES_SQL + ' SELECT source, pos, epoch, shard, "at", "first", "length" FROM k')
def shard_slices(spark: SparkSession, d: str) -> DataFrame:
    return mix.shard_pieces(mix.weighted_order(mix_documents(spark, d), mix_weights(spark), BUDGET, 256), SHARD, BUDGET)


@query(_PIECES_SQL + " SELECT shard, count(*) AS pieces, sum(length)::BIGINT AS tokens FROM k GROUP BY shard")
def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    return shard_slices(spark, d).groupBy("shard").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("tokens"))


@query("""WITH w(source, id) AS (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3)), x AS (SELECT lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, strlen(text) + 1 AS n FROM documents), r AS (SELECT source, pos, n, sum(n) OVER (ORDER BY pos, id) AS upto FROM x JOIN w USING (source)) SELECT source, pos, n FROM r WHERE upto - n < 50000""")
def validation_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = mix_documents(spark, d).withColumn("one", F.lit(1).cast("long"))
    numbered = running_total(rows, "one", ["pos"], F.floor(F.col("pos") / 256), "nth", ["source"]).withColumn("pos", F.col("nth") - 1).drop("nth", "one")
    return mix.round_robin(numbered, mix_weights(spark), mix.validation_tokens(BUDGET)).select("source", "pos", "n")


#: White space of Unicode, for a character class.
_BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: SQL has no look-ahead: a mark (U+E000) cuts the last of several blanks off where a word follows.
_TEXT_PIECES_SQL = rf"""WITH s AS (SELECT regexp_replace(text, '([{_BLANK}])([{_BLANK}])([^{_BLANK}])', '\1' || chr(57344) || '\2\3', 'g') AS t FROM documents),
p AS (SELECT unnest(regexp_extract_all(t, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}\x{{E000}}]+|[{_BLANK}]+')) AS piece FROM s),
c AS (SELECT piece, count(*) AS n FROM p GROUP BY piece)"""


@query(_TEXT_PIECES_SQL + " SELECT piece, n FROM c")
def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.piece_counts(docs(spark, d, "text"))


@query(_TEXT_PIECES_SQL + ", b AS (SELECT n, regexp_extract_all(hex(encode(piece)), '..') AS x FROM c), i AS (SELECT n, x, unnest(range(1, len(x))) AS i FROM b) SELECT x[i] AS \"left\", x[i + 1] AS \"right\", sum(n)::BIGINT AS n FROM i GROUP BY ALL")
def pair_stats(spark: SparkSession, d: str) -> DataFrame:
    return tokens.pair_counts(tokens.piece_counts(docs(spark, d, "text")))


@query("SELECT doc_id, strlen(text) + 1 AS n_tokens FROM documents")
def byte_tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tokens.byte_count(F.col("text")).alias("n_tokens"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def bpe_lengths(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_lengths(docs(spark, d), VOCABULARY).select("doc_id", "n")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = tokens.encode(docs(spark, d), VOCABULARY).select("doc_id", F.expr("slice(ids, 1, size(ids) - 1)").alias("ids"))
    return tokens.decode(coded, VOCABULARY).select("doc_id", F.md5("text").alias("digest"))


def encoded_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turns with byte ids for role and content."""
    raw = tokens.byte_values
    rows = sft.gate(sft.dialogues(table(spark, d, "conversations")))
    return rows.select("conv_id", F.transform("messages", lambda t: F.struct(t["role"].alias("role"), raw(t["role"]).alias("role_ids"), raw(t["content"]).alias("content_ids"))).alias("turns"))


_SFT_SQL = f"WITH c AS ({_CLEAN_SQL}), g AS (SELECT conv_id FROM c JOIN (SELECT conv_id, count(*) AS raw FROM conversations GROUP BY 1) USING (conv_id) WHERE content <> '' GROUP BY conv_id, raw HAVING raw >= 2 AND bool_or(role = 'user') AND bool_or(role = 'assistant')), t AS (SELECT conv_id, turn, role, strlen(role) AS r, strlen(content) AS n, content FROM c JOIN g USING (conv_id) WHERE content <> ''), s AS (SELECT *, sum(r + n + 4) OVER (PARTITION BY conv_id ORDER BY turn) - (r + n + 4) AS place FROM t)"


def _bytes_sql(column: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda x: ('0x' || x)::INT)"


_IDS_SQL = _SFT_SQL + f""", b AS (SELECT conv_id, turn, role, {_bytes_sql('role')} AS r, {_bytes_sql('content')} AS n FROM s),
i AS (SELECT conv_id, flatten(list(list_concat([{sft.TURN_START}], r, [10], n, [{sft.TURN_END}, 10]) ORDER BY turn))[1:2048] AS ids,
    flatten(list(CASE WHEN role = 'assistant' THEN list_concat(list_transform(range(len(r) + 2), lambda x: -100), n, [{sft.TURN_END}], [-100]) ELSE list_transform(range(len(r) + len(n) + 4), lambda x: -100) END ORDER BY turn))[1:2048] AS labels FROM b GROUP BY conv_id)"""


@query(_IDS_SQL + " SELECT conv_id, len(ids) AS n_ids, len(list_filter(labels, lambda x: x <> -100)) AS n_labels, md5(array_to_string(ids, ' ')) AS ids, md5(array_to_string(labels, ' ')) AS labels FROM i")
def loss_mask_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded_dialogues(spark, d).select("conv_id", F.inline(F.array(sft.labelled(F.col("turns"), 2048))))
    return rows.select("conv_id", F.size("input_ids").cast("long").alias("n_ids"), F.size(F.filter("labels", lambda v: v != sft.IGNORE)).cast("long").alias("n_labels"), _digest("input_ids").alias("ids"), _digest("labels").alias("labels"))


def _digest(ids: str) -> Column:
    return F.md5(F.array_join(F.col(ids).cast("array<string>"), " "))


_BATCH_SQL = _IDS_SQL + ", e AS (SELECT *, least(1024, ceil(max(len(ids)) OVER (PARTITION BY conv_id // 8) / 16) * 16)::BIGINT AS length FROM i), f AS (SELECT *, list_transform(range(length - least(len(ids), length)), lambda x: 0) AS more FROM e)"


@query(_BATCH_SQL + f" SELECT conv_id, length, least(len(ids), 1024)::BIGINT AS filled, md5(array_to_string(list_concat(ids[1:length], list_transform(more, lambda x: {sft.PAD})), ' ')) AS ids, md5(array_to_string(list_concat(labels[1:length], list_transform(more, lambda x: -100)), ' ')) AS labels FROM f")
def pad_to_16(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded_dialogues(spark, d).select("conv_id", F.inline(F.array(sft.labelled(F.col("turns"), 2048))))
    out = sft.padded(sft.batched(rows, "conv_id", 8), [("input_ids", "labels")], 16, 1024)
    return out.select("conv_id", F.size("input_ids").cast("long").alias("length"), F.aggregate("input_ids_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("filled"), _digest("input_ids").alias("ids"), _digest("labels").alias("labels"))


def _turn_sql(role: str, content: str) -> str:
    return f"list_concat([{sft.TURN_START}], {_bytes_sql(role)}, [10], {_bytes_sql(content)}, [{sft.TURN_END}, 10])"


def _filled_sql(column: str, fill: int) -> str:
    return f"md5(array_to_string(list_concat({column}, list_transform(range(length - len({column})), lambda x: {fill})), ' '))"


_DUAL_SQL = _PREF_SQL + f""", k AS (SELECT pos, list_concat(CASE WHEN system IS NULL THEN []::INT[] ELSE {_turn_sql("'system'", "system")} END, {_turn_sql("'user'", "prompt")}, [{sft.TURN_START}], {_bytes_sql("'assistant'")}, [10]) AS head, {_bytes_sql("chosen")} AS c, {_bytes_sql("rejected")} AS r FROM w WHERE prompt <> '' AND chosen <> '' AND rejected <> '' AND chosen <> rejected AND c <= 350 AND r <= 350 AND (least(c, r) = 0 OR greatest(c, r) <= 8.0 * least(c, r))),
t AS (SELECT pos, list_concat(head, c, [{sft.TURN_END}, 10]) AS ci, list_concat(head, r, [{sft.TURN_END}, 10]) AS ri, list_concat(list_transform(head, lambda x: -100), c, [{sft.TURN_END}, -100]) AS cl, list_concat(list_transform(head, lambda x: -100), r, [{sft.TURN_END}, -100]) AS rl FROM k),
l AS (SELECT *, (ceil(max(greatest(len(ci), len(ri))) OVER (PARTITION BY pos // 4) / 16) * 16)::BIGINT AS length FROM t)
SELECT pos, length, len(ci) AS chosen, len(ri) AS rejected, {_filled_sql("ci", sft.PAD)} AS chosen_ids, {_filled_sql("cl", -100)} AS chosen_labels, {_filled_sql("ri", sft.PAD)} AS rejected_ids, {_filled_sql("rl", -100)} AS rejected_labels FROM l"""


@query(_DUAL_SQL)
def dual_pad(spark: SparkSession, d: str) -> DataFrame:
    raw = tokens.byte_values
    rows = preferences.pairs(preference_records(spark, d))
    for side in ("chosen", "rejected"):
        turns = preferences.pair_turns(F.col("system"), F.col("prompt"), F.col(side))
        coded = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), raw(t["role"]).alias("role_ids"), raw(t["content"]).alias("content_ids")))
        rows = rows.select(*[c for c in rows.columns if c != "turns"], coded.alias("turns"))
        rows = rows.select("*", F.inline(F.array(sft.labelled(F.col("turns"), 1 << 20)))).withColumnsRenamed({"input_ids": f"{side}_ids", "labels": f"{side}_labels"})
    out = sft.padded(sft.batched(rows, "pos", 4), [("chosen_ids", "chosen_labels"), ("rejected_ids", "rejected_labels")])
    filled = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("pos", F.size("chosen_ids").cast("long").alias("length"), filled("chosen_ids_mask").alias("chosen"), filled("rejected_ids_mask").alias("rejected"), *[_digest(f"{side}_{what}").alias(f"{side}_{what}") for side in ("chosen", "rejected") for what in ("ids", "labels")])


_WINDOW_SQL = f"""WITH p AS ({_PAIRS_SQL}), n AS (SELECT conv_id, turn, {_bytes_sql("coalesce(problem, '')")} AS p, {_bytes_sql("coalesce(solution, '')")}[1:255] AS s FROM p UNION ALL SELECT conv_id, -1, []::INT[], {_bytes_sql("coalesce(text, '')")}[1:255] FROM conversations WHERE turn = 0),
h AS (SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN p ELSE [{tokens.END_OF_TEXT}] END AS p, s, least(greatest(len(p), 1), 256 - len(s)) AS room FROM n)
SELECT conv_id, turn, room + len(s) AS n_ids, room - 1 AS from_index, md5(array_to_string(list_concat(p[len(p) - room + 1:], s), ' ')) AS ids FROM h"""


@query(_WINDOW_SQL)
def continuation_window(spark: SparkSession, d: str) -> DataFrame:
    # Each conversation's first text also with an empty prompt: an end mark stands for it.
    alone = table(spark, d, "conversations").where("turn = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("").alias("problem"), F.col("text").alias("solution"))
    rows = turn_pairs(spark, d).unionByName(alone).select("conv_id", "turn", tokens.byte_values(F.col("problem")).alias("p"), tokens.byte_values(F.col("solution")).alias("s"))
    rows = rows.select("conv_id", "turn", F.inline(F.array(sft.scoring_window(F.col("p"), F.col("s"), 256, tokens.END_OF_TEXT))))
    return rows.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), F.col("from_index").cast("long").alias("from_index"), _digest("ids").alias("ids"))


_PROMPT_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
t AS (SELECT conv_id, '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || {STRIP % 'text'} || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM r WHERE back <= 6 GROUP BY conv_id),
b AS (SELECT conv_id, {_bytes_sql("prompt")} AS ids FROM t)
SELECT conv_id, len(ids) AS n_prompt, least(len(ids), 384) AS n_ids, md5(array_to_string(ids[greatest(len(ids) - 384, 0) + 1:], ' ')) AS ids FROM b"""


@query(_PROMPT_SQL)
def prompt_window(spark: SparkSession, d: str) -> DataFrame:
    rows = sft.dialogues(table(spark, d, "conversations"))
    prompt = sft.chatml(sft.last_turns(F.col("messages"), 3), F.lit("Be brief."), cue=True)
    coded = rows.select("conv_id", tokens.byte_values(prompt).alias("all"))
    cut = coded.select("conv_id", F.size("all").cast("long").alias("n_prompt"), sft.prompt_ids(F.col("all"), 512, 128).alias("ids"))
    return cut.select("conv_id", "n_prompt", F.size("ids").cast("long").alias("n_ids"), _digest("ids").alias("ids"))


def streams(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, tokens: small streams of whole numbers made from the embeddings; the product is rounded as a float, so 0.29 gives 29."""
    hundredths = lambda x: F.floor((x * F.lit(100).cast("float")).cast("double")).cast("int")
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", hundredths).alias("tokens"))


_STREAM_SQL = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x * 100::FLOAT)::DOUBLE)::BIGINT) AS t FROM embeddings)"


@query(_STREAM_SQL + ", w AS (SELECT vec_id, t, unnest(range(len(t) - 48)) AS start FROM s) SELECT vec_id, start, list_sum(t[start + 1:start + 48])::BIGINT AS x, list_sum(t[start + 2:start + 49])::BIGINT AS y FROM w")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return _window_sums(windows.sliding_windows(streams(spark, d), 48), "start")


@query(_STREAM_SQL + ", w AS (SELECT vec_id, t, unnest(range((len(t) - 1) // 10)) AS chunk FROM s) SELECT vec_id, chunk, list_sum(t[chunk * 10 + 1:chunk * 10 + 10])::BIGINT AS x, list_sum(t[chunk * 10 + 2:chunk * 10 + 11])::BIGINT AS y FROM w")
def eval_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _window_sums(windows.eval_chunks(streams(spark, d), 10), "chunk")


@query(_STREAM_SQL + ", w AS (SELECT vec_id, t, unnest(range((len(t) - 1) // 12)) AS block FROM s) SELECT vec_id, block, block % 2 AS rank, list_sum(t[block * 12 + 1:block * 12 + 12])::BIGINT AS x, list_sum(t[block * 12 + 2:block * 12 + 13])::BIGINT AS y FROM w")
def rank_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.rank_blocks(streams(spark, d), 3, 4, 2).withColumns({"x": F.flatten("x"), "y": F.flatten("y")})
    return _window_sums(rows, "block", "rank")


@query(_STREAM_SQL + " SELECT vec_id, 150::BIGINT AS n, list_sum(list_transform(range(150), lambda i: t[i % len(t) + 1]))::BIGINT AS total FROM s")
def tiled_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.tiled(streams(spark, d), 150)
    return rows.select("vec_id", F.size("tokens").cast("long").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(_STREAM_SQL + ", w AS (SELECT vec_id, t, unnest(range(8)) AS draw FROM s), v AS (SELECT *, ('0x' || left(md5('42:' || vec_id || ':' || draw), 12))::BIGINT % (len(t) - 17) AS start FROM w) SELECT vec_id, draw, start, list_sum(t[start + 1:start + 16])::BIGINT AS x, list_sum(t[start + 2:start + 17])::BIGINT AS y FROM v")
def random_windows(spark: SparkSession, d: str) -> DataFrame:
    return _window_sums(windows.random_windows(streams(spark, d), 16, 8), "draw", "start")


def _window_sums(rows: DataFrame, *keys: str) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("vec_id", *[F.col(k).cast("long").alias(k) for k in keys], total("x").alias("x"), total("y").alias("y"))


@query("WITH m AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos, l_suppkey AS shard, l_quantity::INT AS token FROM lineitem), e AS (SELECT shard, pos, lag(pos) OVER (PARTITION BY shard ORDER BY pos) AS before FROM m WHERE token = 50) SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS doc, coalesce(before + 1, 0) AS first, pos - coalesce(before + 1, 0) + 1 AS n FROM e")
def eot_spans(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shard"), (F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")).cast("long") - 1).alias("pos"), F.col("l_quantity").cast("int").alias("token"))
    return windows.document_spans(line, 50, ["shard"]).select("shard", F.col("doc").cast("long").alias("doc"), F.col("first").cast("long").alias("first"), F.col("n").cast("long").alias("n"))


@query("WITH u AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS place FROM u) SELECT vec_id, count(*) AS kept, sum(i)::BIGINT AS places FROM r WHERE place <= 5 GROUP BY vec_id")
def topk_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", score.top_k(F.col("embedding"), 5).alias("m"))
    at = F.filter(F.transform("m", lambda k, i: F.when(k, i)), lambda i: i.isNotNull())
    return rows.select("vec_id", F.size(at).cast("long").alias("kept"), F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query("WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS index, list_max(embedding)::DOUBLE AS m FROM embeddings), q AS (SELECT vec_id, index, exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY vec_id) AS p FROM u), c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, index) - p AS before FROM q) SELECT vec_id, count(*) FILTER (before <= 0.7) AS kept FROM c GROUP BY vec_id")
def nucleus_mask(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(score.nucleus_kept(F.col("embedding"), 0.7), lambda k: k)
    return table(spark, d, "embeddings").select("vec_id", F.size(kept).cast("long").alias("kept"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best, (list_position(embedding, list_max(embedding)) - 1 = label) AS hit FROM embeddings")
def argmax_choice(spark: SparkSession, d: str) -> DataFrame:
    best = score.argmax(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", best.cast("long").alias("best"), (best == F.col("label")).alias("hit"))


@query("WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, round(sum(CASE WHEN (i = label OR i = 7) AND i <> 9 THEN CASE WHEN v > 0 THEN v / 1.25 ELSE v * 1.25 END ELSE v END / 0.5), 6) AS total FROM u GROUP BY vec_id")
def repetition_penalty(spark: SparkSession, d: str) -> DataFrame:
    scores = F.transform("embedding", lambda x: x.cast("double"))
    out = score.tempered(score.penalised(scores, F.array("label", F.lit(7), F.lit(9)), 1.25, [9]), 0.5)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), u AS (SELECT vec_id, unnest(x)::DOUBLE AS x, unnest(y)::DOUBLE AS y FROM p), g AS (SELECT vec_id, max(abs(x - y)) AS m, avg(abs(x - y)) AS a, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c FROM u GROUP BY vec_id) SELECT vec_id, m = 0 AS equal, round(m, 6) AS max_diff, round(a, 6) AS mean_diff, round(c, 6) AS cosine, CASE WHEN m = 0 THEN 'identical' WHEN c > 0.999 AND m < 1e-4 THEN 'close' ELSE 'different' END AS verdict FROM g")
def embedding_compare(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    pair = t.select("vec_id", F.col("embedding").alias("x")).join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    parts = profile.vector_difference(F.col("x"), F.col("y"))
    return pair.select("vec_id", *[(F.round(c, 6) if k in ("max_diff", "mean_diff", "cosine") else c).alias(k) for k, c in parts.items()])


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'none' ELSE 'so #### ' || (event_id * 37) || CASE WHEN event_id % 2 = 0 THEN ',000' ELSE '' END END AS t FROM events) SELECT event_id, replace(regexp_extract(t, '####\\s*(-?[0-9\\.,]+)', 1), ',', '') AS answer FROM e WHERE t <> 'none'")
def gold_answer(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("event_id", score.gold_answer(F.col("gold")).alias("answer")).where("answer is not null")


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1 2</think> it is ' || (event_id * 37) || '.' WHEN event_id % 3 = 1 THEN '7 or -' || event_id || '.5 ok' ELSE 'no idea' END AS t FROM events), x AS (SELECT event_id, regexp_extract_all(CASE WHEN contains(t, '</think>') THEN split_part(t, '</think>', -1) ELSE t END, '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS n FROM e) SELECT event_id, n[-1] AS answer FROM x WHERE len(n) > 0")
def pred_answer(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("event_id", score.predicted_answer(F.col("said")).alias("answer")).where("answer is not null")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id")
    gold = "CASE WHEN event_id % 6 = 0 THEN 'none' ELSE 'so #### ' || (event_id * 37) || CASE WHEN event_id % 2 = 0 THEN ',000' ELSE '' END END"
    said = "CASE WHEN event_id % 3 = 0 THEN '1 2</think> it is ' || (event_id * 37) || '.' WHEN event_id % 3 = 1 THEN '7 or -' || event_id || '.5 ok' ELSE 'no idea' END"
    return e.select("event_id", F.expr(gold).alias("gold"), F.expr(said).alias("said"))


@query("SELECT round(100.0 * sum(CASE WHEN event_id % 6 = 3 THEN 1 ELSE 0 END) / count(*), 2) AS accuracy, round(100.0 * sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) / count(*), 2) AS closed, count(*) AS samples FROM events WHERE event_id % 6 <> 0")
def math_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return score.answer_accuracy(_answers(spark, d), "gold", "said")


@query("SELECT round(100.0 * avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1 ELSE 0 END), 2) AS accuracy, count(*) AS samples FROM embeddings")
def choice_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return score.choice_accuracy(table(spark, d, "embeddings"), "embedding", "label")


@query("SELECT round(sum(l_discount * 40 * l_quantity) / sum(l_quantity), 4) AS loss, round(exp(sum(l_discount * 40 * l_quantity) / sum(l_quantity)), 2) AS perplexity FROM lineitem")
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    return score.perplexity(table(spark, d, "lineitem").withColumn("loss", F.col("l_discount") * 40), "loss", "l_quantity")


_DPO_SQL = "WITH p AS (SELECT l_orderkey, l_linenumber, -l_quantity AS pc, -l_discount * 100 AS pr, -l_tax * 100 AS rc, -l_linenumber::DOUBLE AS rr FROM lineitem), x AS (SELECT *, 0.1 * (pc - rc) - 0.1 * (pr - rr) AS m FROM p)"


@query(_DPO_SQL + " SELECT l_linenumber, round(avg(ln(1 + exp(-m))), 6) AS loss, round(avg(m), 6) AS margin, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS win FROM x GROUP BY l_linenumber")
def dpo_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_linenumber", (-F.col("l_quantity")).alias("pc"), (-F.col("l_discount") * 100).alias("pr"), (-F.col("l_tax") * 100).alias("rc"), (-F.col("l_linenumber")).cast("double").alias("rr"))
    terms = preferences.dpo_terms(*(F.col(c) for c in ("pc", "pr", "rc", "rr")))
    return rows.withColumns(terms).groupBy("l_linenumber").agg(*[F.round(F.avg(k), 6).alias(k) for k in ("loss", "margin", "win")])


@query("SELECT round(avg(l_extendedprice - l_quantity * 1000), 4) AS margin, round(100.0 * avg(CASE WHEN l_extendedprice > l_quantity * 1000 THEN 1 ELSE 0 END), 2) AS wins, count(*) AS samples FROM lineitem")
def pref_margin(spark: SparkSession, d: str) -> DataFrame:
    return score.preference_margin(table(spark, d, "lineitem").withColumn("other", F.col("l_quantity") * 1000), "l_extendedprice", "other")


_SUMMARY_SQL = [(task, metric, ORACLE_SQL[task]) for task, metrics in (("perplexity", ("loss", "perplexity")), ("choice_accuracy", ("accuracy", "samples")), ("pref_margin", ("margin", "wins", "samples"))) for metric in metrics]


@query(" UNION ALL ".join(f"SELECT '{task}' AS task, '{metric}' AS metric, {metric}::DOUBLE AS value FROM ({sql})" for task, metric, sql in _SUMMARY_SQL))
def task_summary(spark: SparkSession, d: str) -> DataFrame:
    return score.summary([(f.__name__, f(spark, d)) for f in (perplexity, choice_accuracy, pref_margin)])


@query("WITH u AS (SELECT vec_id, unnest(embedding[1:63])::DOUBLE AS p, unnest(range(63)) AS i FROM embeddings) SELECT vec_id, round(coalesce(sum(p) FILTER ((i + 1) % 3 <> 0), 0), 6) AS logp FROM u GROUP BY vec_id")
def masked_logp(spark: SparkSession, d: str) -> DataFrame:
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 3 == 0, F.lit(-100)).otherwise(i))
    return table(spark, d, "embeddings").select("vec_id", F.round(preferences.masked_logp(F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double")), labels), 6).alias("logp"))


@query("WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'M' WHEN 1 THEN p_size || '.5b' WHEN 2 THEN p_size || ' K' WHEN 3 THEN p_size::VARCHAR ELSE 'x' || p_size END AS s FROM part), m AS (SELECT *, upper(trim(s)) AS u FROM p) SELECT p_partkey, CASE WHEN regexp_matches(u, '^[0-9.]+\\s*[KMB]?$') THEN trunc(regexp_extract(u, '^([0-9.]+)', 1)::DOUBLE * CASE right(u, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END)::BIGINT END AS size FROM m")
def parsed_sizes(spark: SparkSession, d: str) -> DataFrame:
    text = "CASE p_partkey % 5 WHEN 0 THEN p_size || 'M' WHEN 1 THEN p_size || '.5b' WHEN 2 THEN p_size || ' K' WHEN 3 THEN cast(p_size as string) ELSE 'x' || p_size END"
    return table(spark, d, "part").select("p_partkey", numbers.parse_size(F.expr(text)).alias("size"))


@query("WITH s AS (SELECT event_id, event_id % 1201 AS step FROM events) SELECT event_id, round(CASE WHEN step < 100 THEN 0.0006 * (step + 1) / 100 WHEN step > 1000 THEN 0.00006 ELSE 0.00006 + 0.5 * (1 + cos(pi() * (step - 100) / 900.0)) * 0.00054 END, 10) AS rate, round(CASE WHEN step < 100 THEN step / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((step - 100) / 900.0, 1.0))) END, 10) AS factor FROM s")
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("event_id") % 1201
    return table(spark, d, "events").select("event_id", F.round(scaling.cosine_rate(s, 100, 1000, 6e-4, 6e-5), 10).alias("rate"), F.round(scaling.cosine_factor(s, 100, 1000), 10).alias("factor"))


@query(f"WITH m AS (SELECT budget AS params FROM ({_SIZES_SQL})) SELECT params, params * 50 AS tokens, params * 50 // 131072 AS steps, least(2000, greatest(100, trunc((params * 50 // 131072) * 0.03)))::BIGINT AS warmup FROM m")
def training_budget(spark: SparkSession, d: str) -> DataFrame:
    return model_sizes(spark, d).select(F.col("budget").alias("params"), *[c.cast("long").alias(k) for k, c in scaling.training_budget(F.col("budget")).items()])


@query(f"""WITH g AS (SELECT w AS width, w // 64 AS heads, w // 192 AS kv_heads, (round_even(8.0::DOUBLE / 3 * w / 256, 0) * 256)::BIGINT AS ffn FROM (SELECT unnest(range(192, 4097, 192)) AS w)),
e AS (SELECT *, width * heads * 64 * 2 + 2 * width * kv_heads * 64 + 2 * width + 3 * width * ffn AS each FROM g),
l AS (SELECT budget, e.*, greatest(8, round_even((budget - 50304 * width) / each::DOUBLE, 0))::BIGINT AS layers FROM e CROSS JOIN ({_SIZES_SQL})),
p AS (SELECT *, 50304 * width + width + layers * each AS params, budget - 50304 * width > 0 AND layers / width::DOUBLE BETWEEN 0.01 AND 0.04 AS fits, 50304 * width + width + 8 * each AS floor FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY NOT fits, CASE WHEN fits THEN abs(params - budget) ELSE floor END, width) AS nth FROM p)
SELECT budget, width, CASE WHEN fits THEN layers ELSE 8 END AS layers, ffn, heads, kv_heads, CASE WHEN fits THEN params ELSE floor END AS params FROM r WHERE nth = 1""")
def architecture_search(spark: SparkSession, d: str) -> DataFrame:
    return scaling.architectures(model_sizes(spark, d), 50_273)


@query(f"""WITH g AS (SELECT w AS width, w // 64 AS heads, w // 192 AS kv_heads, (ceil(floor(8.0::DOUBLE / 3 * w) / 256) * 256)::BIGINT AS ffn, greatest(4, floor(w * 0.01::DOUBLE))::BIGINT AS fewest, floor(w * 0.025::DOUBLE)::BIGINT AS tall FROM (SELECT unnest(range(384, 4096, 192)) AS w)),
e AS (SELECT *, width * heads * 64 * 2 + 2 * width * kv_heads * 64 + 2 * width + 3 * width * ffn AS each, unnest(range(fewest, greatest(fewest + 2, tall + 6))) AS layers FROM g),
p AS (SELECT budget, e.*, 50304 * width + width + layers * each AS params FROM e CROSS JOIN ({_SIZES_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY abs(params - budget), width, layers) AS nth FROM p)
SELECT budget, width, layers, heads, kv_heads, ffn, params, 50304 * width AS embedding, round(0.0006::DOUBLE * sqrt(768.0 / width), 6) AS most_rate, round(round(0.0006::DOUBLE * sqrt(768.0 / width), 6) * 0.1, 7) AS least_rate,
    CASE WHEN params >= 125000000 THEN (ceil(floor(250000 * sqrt(params / 125e6::DOUBLE)) / 2048) * 2048)::BIGINT ELSE 262144 END AS batch_tokens, params * 20 AS tokens FROM r WHERE nth = 1""")
def model_plans(spark: SparkSession, d: str) -> DataFrame:
    return scaling.model_plans(model_sizes(spark, d))


def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d, "source", "text").groupBy("source").agg(F.sum(tokens.byte_count(F.col("text"))).alias("tokens"))
    return rows.withColumn("upstream", F.when(F.col("source") != "src1", F.concat(F.lit("org/"), "source"))).withColumn("status", F.lit(None).cast("string"))


@query("WITH s AS (SELECT source, sum(strlen(text) + 1)::BIGINT AS tokens FROM documents GROUP BY 1) SELECT source, CASE WHEN source = 'src1' THEN 'Custom' ELSE 'org/' || source END AS upstream, tokens, round(tokens * 100.0 / sum(tokens) OVER (), 2) AS share, '100% Unique' AS status FROM s")
def card_sources(spark: SparkSession, d: str) -> DataFrame:
    return reports.source_table(source_tokens(spark, d))


@query("WITH s AS (SELECT source, strlen(text) + 1 AS n FROM documents) SELECT sum(n)::BIGINT AS tokens, 'n<1B' AS size, round(sum(n) * 2 / (1024.0 * 1024 * 1024), 6) AS gb, round(100.0 * sum(CASE WHEN source IN ('src2', 'src3') THEN n ELSE 0 END) / sum(n), 4) AS reasoning_share FROM s")
def card_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.corpus_summary(source_tokens(spark, d), ("src2", "src3"))


_TOKENS_SQL = ", ".join(f"('{t}', {i}, '{reports.TOKEN_ROLES[t]}')" for t, i in tokens.SPECIAL_TOKENS.items())


@query(f"WITH c AS (SELECT string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|endoftext|>' AS t FROM conversations GROUP BY conv_id) SELECT token, id, role, (SELECT sum(len(string_split(t, token)) - 1)::BIGINT FROM c) AS n FROM (VALUES {_TOKENS_SQL}) v(token, id, role)")
def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = sft.dialogues(table(spark, d, "conversations"))
    turn = lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["content"], F.lit("<|im_end|>\n"))
    texts = rows.select(F.concat(F.array_join(F.transform("messages", turn), ""), F.lit("<|endoftext|>")).alias("text"))
    return reports.special_token_counts(spark, texts)


@query("SELECT split_part(url, '/', 3) AS stage, count(*) AS files, sum(length(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def stage_files(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return reports.stage_files(pages.select(F.regexp_replace("url", "^[^/]*//", "").alias("path"), F.length("html").cast("long").alias("length")))


@query("WITH t AS (SELECT doc_id, string_split(trim(text, chr(10)), chr(10)) AS l FROM documents) SELECT doc_id, md5(array_to_string(l[1:2], chr(10))) AS head, greatest(len(l) - 2, 0) AS more FROM t")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).withColumn("p", profile.preview(F.col("text"), 2)).select("doc_id", F.md5("p.head").alias("head"), F.col("p.more").cast("long").alias("more"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def sharegpt_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = sft.dialogues(table(spark, d, "conversations"))
    turns = F.transform("messages", lambda t: F.struct(t["role"].alias("from"), t["content"].alias("value")))
    return rows.select("conv_id", F.md5(profile.flattened(turns)).alias("digest"))


@query("WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN left(sha256(text), 40) WHEN 1 THEN left(text, 40) ELSE 'import ' || left(sha256(text), 33) END AS t FROM documents) SELECT doc_id, length(t) = 40 AND NOT (contains(t, 'def ') OR contains(t, 'import ') OR contains(t, 'class ') OR contains(t, '=')) AS hashlike FROM a")
def payload_detector(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE doc_id % 3 WHEN 0 THEN left(sha2(text, 256), 40) WHEN 1 THEN left(text, 40) ELSE 'import ' || left(sha2(text, 256), 33) END")
    return docs(spark, d).select("doc_id", filters.looks_like_hash(t).alias("hashlike"))


@query(f"WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || '<|im_end|>tail' WHEN 1 THEN '<|endoftext|> ' || text ELSE text END AS t FROM conversations) SELECT conv_id, turn, md5({STRIP % '''replace(split_part(t, '<|im_end|>', 1), '<|endoftext|>', '')'''}) AS digest FROM a")
def completion_cleanup(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE turn % 3 WHEN 0 THEN text || '<|im_end|>tail' WHEN 1 THEN '<|endoftext|> ' || text ELSE text END")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(sanitize.clean_completion(t)).alias("digest"))


@query(f"WITH s AS (SELECT doc_id, source, text, {_SPLIT_SQL} AS split FROM documents WHERE length({STRIP % 'text'}) > 30) SELECT source, split, count(*) AS docs, sum(strlen(text) + 1)::BIGINT AS tokens, round(sum(strlen(text) + 1) * 100.0 / sum(sum(strlen(text) + 1)) OVER (PARTITION BY source), 6) AS share FROM s GROUP BY source, split")
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: length filter, hash split, byte tokens, totals and shares by source and split."""
    rows = splits.hash_split(filters.min_length(docs(spark, d, "doc_id", "source", "text")))
    g = rows.groupBy("source", "split").agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens.byte_count(F.col("text"))).alias("tokens"))
    return g.withColumn("share", F.round(F.col("tokens") * 100.0 / F.sum("tokens").over(W.partitionBy("source")), 6))
