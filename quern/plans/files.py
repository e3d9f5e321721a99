"""Queries over readers, sinks and small column operators: what Spark writes from the driver's tables is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numbers
from quern.functions.shared import shared_folder
from quern.operators import filters, mix, reports, scaling, score, sft, tokens
from quern.plans.catalog import STRIP, _bytes_sql, docs, query, table, turn_pairs
from quern.plans.storage import _STREAMS_SQL, document_shards
from quern.sources import readers, sinks

_PATHS = "regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 4 WHEN 0 THEN '.parquet' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.jsonl.gz' ELSE '.txt' END"


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """path, length: pages as if each were a file of one of four kinds."""
    return table(spark, d, "pages").select(F.expr(_PATHS).alias("path"), F.length("html").cast("long").alias("length"))


@query(f"WITH p AS (SELECT {_PATHS} AS path, length(html) AS length FROM pages) SELECT path, length FROM p WHERE starts_with(path, 'th') AND contains(path, '/fr/') AND ends_with(path, '.parquet')")
def file_choice(spark: SparkSession, d: str) -> DataFrame:
    return readers.pick_files(page_files(spark, d), "/th", "/fr/")


@query(f"WITH t AS (SELECT {STRIP % 'text'} AS body FROM documents WHERE doc_id % 5 > 1) SELECT body, count(*) AS n FROM t WHERE body <> '' GROUP BY body")
def jsonl_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON Lines, two fifths of them broken or without the key; gzip for half of the files."""
    folder = shared_folder(spark)
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"text": "'), F.regexp_replace("text", r"\s", " "))).when(F.col("doc_id") % 5 == 1, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct(F.concat(F.lit(" \n"), "text").alias("text"))))
    rows = docs(spark, d).select("doc_id", line.alias("value"))
    for odd, codec in ((0, "none"), (1, "gzip")):
        rows.where(F.col("doc_id") % 2 == odd).select("value").write.option("compression", codec).text(f"{folder}/{codec}")
    return readers.read_jsonl(spark, [f"{folder}/none", f"{folder}/gzip"]).groupBy(F.col("text").alias("body")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def plain_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of each source, read whole."""
    folder = shared_folder(spark)
    docs(spark, d, "source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(folder)
    return readers.read_plain(spark, folder).select("source", F.md5("text").alias("digest"))


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def dialogue_files(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues as JSON Lines under either key, read again; conv_id goes along as a first turn."""
    path = f"{shared_folder(spark)}/dialogues.jsonl"
    rows = sft.dialogues(table(spark, d, "conversations"))
    turns = F.concat(F.array(F.struct(F.lit("id").alias("role"), F.col("conv_id").cast("string").alias("content"))), "messages")
    odd = F.col("conv_id") % 2 == 1
    sinks.write_jsonl(rows.select(F.when(odd, turns).alias("messages"), F.when(~odd, turns).alias("conversations")), path)
    m = readers.read_dialogues(spark, path).select(F.element_at("messages", 1)["content"].cast("long").alias("conv_id"), F.slice("messages", 2, 1 << 20).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.md5(F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")).alias("digest"))


_PAIR_ROWS_SQL = "SELECT u.text AS prompt, a.text AS chosen, 'No. ' || a.text AS rejected, CASE WHEN u.turn % 4 = 0 THEN 'Be kind.' END AS system FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"


@query(f"WITH p AS ({_PAIR_ROWS_SQL}) SELECT md5(prompt) AS prompt, md5(chosen) AS chosen, length(rejected) AS rejected, system, count(*) AS n FROM p GROUP BY ALL")
def pair_files(spark: SparkSession, d: str) -> DataFrame:
    """Preference pairs written as JSON Lines, null systems left out, and read again."""
    path = shared_folder(spark)
    rows = turn_pairs(spark, d).select(F.col("problem").alias("prompt"), F.col("solution").alias("chosen"), F.concat(F.lit("No. "), "solution").alias("rejected"), F.when(F.col("turn") % 4 == 0, "Be kind.").alias("system"))
    sinks.write_jsonl(rows, path)
    got = readers.read_pairs(spark, path).select(F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"), F.length("rejected").cast("long").alias("rejected"), "system")
    return got.groupBy(*got.columns).agg(F.count(F.lit(1)).alias("n"))


@query(_STREAMS_SQL + " SELECT name, count(*) AS tokens FROM u GROUP BY name")
def shard_files(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each shard by the size of its file, whose content isn't read."""
    shards = document_shards(spark, d)
    return spark.createDataFrame(shards, "path string, length long").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.expr("length div 2").alias("tokens"))


@query("SELECT p_name || ' ' || p_brand AS token, min(p_partkey)::INT AS id, 'token' AS kind FROM part GROUP BY 1 UNION ALL SELECT p_name || '|' || p_type, (row_number() OVER (ORDER BY p_name, p_type) - 1)::INT, 'merge' FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS p_name, p_type FROM part)")
def vocabulary_files(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary with tokens and merges made from the parts, written as one JSON object and read again."""
    path, part = shared_folder(spark), table(spark, d, "part")
    words = part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("token")).agg(F.min("p_partkey").cast("int").alias("id"))
    pairs = part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("left"), F.col("p_type").alias("right")).distinct()
    # A vocabulary's merges, not a corpus: a few hundred kinds of part.
    ranked = pairs.groupBy().agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("m")).select(F.posexplode("m").alias("rank", "m")).select("rank", "m.left", "m.right")
    sinks.write_vocabulary(words, ranked, ["<|end|>"], path)
    vocabulary, merges = readers.read_vocabulary(spark, path)
    return vocabulary.withColumn("kind", F.lit("token")).unionByName(merges.select(F.concat_ws("|", "left", "right").alias("token"), F.col("rank").alias("id"), F.lit("merge").alias("kind")))


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang UNION ALL SELECT 'any', min(doc_id) FROM documents")
def first_rows_by_language(spark: SparkSession, d: str) -> DataFrame:
    rows, out = docs(spark, d, "doc_id", "lang"), None
    for lang in (None, "EN", "fr", "DE", "es"):
        part = readers.first_matching(rows, lang, "doc_id").select(F.lit("any").alias("lang") if lang is None else F.col("lang"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' ' || lang END AS a, CASE WHEN doc_id % 2 = 0 THEN source END AS b, text AS c FROM documents), t AS (SELECT doc_id, {STRIP % '''coalesce(nullif(a, ''), nullif(b, ''), '')'''} AS prompt, {STRIP % '''coalesce(nullif(c, ''), '')'''} AS answer FROM r) SELECT doc_id, prompt, md5(answer) AS answer FROM t WHERE prompt <> '' AND answer <> ''")
def instruction_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d, "doc_id", "lang", "source", "text").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' ' || lang END").alias("instruction"), F.expr("CASE WHEN doc_id % 2 = 0 THEN source END").alias("problem"), F.col("text").alias("response"))
    return readers.instruction_rows(rows, ("instruction", "problem", "gone"), ("response", "solution")).select("doc_id", "prompt", F.md5("answer").alias("answer"))


@query("WITH p AS (SELECT u.conv_id, u.turn, u.text AS problem, a.text AS solution FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant') SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 3 ELSE 2 END AS n, md5(CASE WHEN turn % 4 = 0 THEN 'system:Be brief.|' ELSE '' END || 'user:' || problem || '|assistant:' || solution) AS digest FROM p")
def rendered_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = turn_pairs(spark, d)
    m = sft.messages(("system", F.when(F.col("turn") % 4 == 0, "Be brief.")), ("user", F.col("problem")), ("assistant", F.col("solution")))
    said = F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
    return rows.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.size("m").alias("n"), F.md5(said).alias("digest"))


@query(f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE source END AS a, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS b FROM documents) SELECT doc_id, CASE WHEN {STRIP % 'a'} <> '' THEN a WHEN {STRIP % 'b'} <> '' THEN b END AS picked FROM r")
def first_nonblank(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.expr("CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE source END"), F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END")
    return docs(spark, d, "doc_id", "source", "lang").select("doc_id", filters.first_nonblank(a, b).alias("picked"))


_COUNTS = "CASE p_partkey % 7 WHEN 0 THEN p_size || 'k' WHEN 1 THEN '1_0' || p_size || '_000' WHEN 2 THEN p_size || '.25 B' WHEN 3 THEN ' ' || p_size || 't ' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE p_size || 'Q' END"


@query(f"WITH s AS (SELECT p_partkey, replace(upper(trim({_COUNTS})), '_', '') AS u FROM part) SELECT p_partkey, CASE WHEN regexp_matches(u, '^[0-9.]+\\s*[KMBT]?$') THEN trunc(regexp_extract(u, '^([0-9.]+)', 1)::DOUBLE * CASE right(u, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1 END)::BIGINT END AS tokens FROM s")
def parsed_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", numbers.parse_tokens(F.expr(_COUNTS)).alias("tokens"))


_SIZE = "(p_partkey * p_size + 1) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 ELSE 10000000 END"


@query(f"WITH s AS (SELECT p_partkey, ({_SIZE})::BIGINT AS n FROM part) SELECT p_partkey, CASE WHEN n >= 1000000000 THEN regexp_replace(regexp_replace(printf('%.2f', round_even(n / 1e9::DOUBLE, 2)), '0+$', ''), '\\.$', '') || 'B' WHEN n >= 1000000 THEN round_even(n / 1e6::DOUBLE, 0)::BIGINT || 'M' WHEN n >= 1000 THEN round_even(n / 1e3::DOUBLE, 0)::BIGINT || 'K' ELSE n::VARCHAR END AS size, CASE WHEN n < 1000000000 THEN 'n<1B' WHEN n < 10000000000 THEN '1B<n<10B' WHEN n < 100000000000 THEN '10B<n<100B' ELSE 'n>100B' END AS tag FROM s")
def formatted_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.expr(_SIZE).cast("long")
    return table(spark, d, "part").select("p_partkey", numbers.format_size(n).alias("size"), numbers.size_tag(n).alias("tag"))


_REPO = "lower(c_mktsegment) || '/m-' || c_nationkey || CASE c_custkey % 5 WHEN 0 THEN '-base' WHEN 1 THEN '-sft' WHEN 2 THEN '-dpo' WHEN 3 THEN '-sft-x' ELSE '' END"


@query(f"SELECT c_custkey, regexp_replace({_REPO}, '-(base|sft|dpo)$', '') AS name FROM customer")
def base_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", numbers.base_name(F.expr(_REPO)).alias("name"))


@query("WITH g AS (SELECT sum(l_discount * 400 * l_quantity) / sum(l_quantity) AS loss FROM lineitem) SELECT round(loss, 4) AS loss, round(exp(least(loss, 20.0)), 2) AS perplexity FROM g")
def clamped_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return score.perplexity(table(spark, d, "lineitem").withColumn("loss", F.col("l_discount") * 400), "loss", "l_quantity", clamp=True)


@query("WITH s AS (SELECT source, count(*)::DOUBLE AS weight FROM documents GROUP BY source) SELECT source, round(weight / sum(weight) OVER (), 9) AS weight FROM s")
def normalised_weights(spark: SparkSession, d: str) -> DataFrame:
    counts = docs(spark, d, "source").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return mix.normalised_weights(counts).withColumn("weight", F.round("weight", 9))


@query("SELECT p_partkey, coalesce((SELECT max(r) FROM (SELECT unnest([256, 128, 64, 32, 16, 8, 4, 2, 1]) AS r) WHERE r <= p_partkey % 300), 1) AS rung FROM part")
def ladder_choices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scaling.ladder_choice(F.col("p_partkey") % 300).alias("rung"))


@query("WITH s AS (SELECT vec_id, embedding[1:4] AS v, ['A', ' b', 'C ', 'd'] AS names, chr((65 + label % 4)::INT) AS answer FROM embeddings) SELECT round(100.0 * avg(CASE WHEN lower(trim(names[list_position(v, list_max(v))])) = lower(trim(answer)) THEN 1 ELSE 0 END), 2) AS accuracy, count(*) AS samples FROM s")
def labelled_choices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.slice("embedding", 1, 4).alias("v"), F.array(*map(F.lit, ("A", " b", "C ", "d"))).alias("names"), F.char(65 + F.col("label") % 4).alias("answer"))
    return score.labelled_choice_accuracy(rows, "v", "names", "answer")


@query("SELECT p_partkey, round(0.0006::DOUBLE * sqrt(768.0 / (p_size * 64)), 12) AS most, round(0.00006::DOUBLE * sqrt(768.0 / (p_size * 64)), 12) AS least FROM part WHERE p_size > 0")
def width_rates(spark: SparkSession, d: str) -> DataFrame:
    most, least = scaling.learning_rates(F.col("p_size") * 64)
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.round(most, 12).alias("most"), F.round(least, 12).alias("least"))


@query("SELECT sum(length(html) // 2)::BIGINT AS tokens, sum(length(html) // 2) >= 100000 AS enough FROM pages")
def token_gate(spark: SparkSession, d: str) -> DataFrame:
    return reports.enough_tokens(page_files(spark, d), 100_000)


_KINDS = "CASE page_id % 5 WHEN 0 THEN 'data/train_' || page_id || '.bin' WHEN 1 THEN 'data/val.txt' WHEN 2 THEN 'x/sft/train.jsonl' WHEN 3 THEN 'x/dpo/train.jsonl' ELSE 'other' END"


@query("SELECT 'no validation shard' AS problem FROM pages HAVING count(*) > 0 UNION ALL SELECT 'no preference data' FROM pages WHERE page_id % 5 = 3 HAVING coalesce(max(length(html)), 0) < 50000")
def data_gate(spark: SparkSession, d: str) -> DataFrame:
    """What training lacks in a listing without validation shards and with small files of pairs."""
    return reports.missing_data(table(spark, d, "pages").select(F.expr(_KINDS).alias("path"), F.length("html").cast("long").alias("length")))


@query("WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents) SELECT doc_id, rank // 48 AS batch FROM r, n WHERE n < 48 OR rank < n - n % 48")
def full_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 48 without an incomplete last one; ids are ranks here."""
    rows = docs(spark, d, "doc_id")
    least = rows.agg(F.min("doc_id").alias("least"))
    ranked = rows.join(least).select("doc_id", (F.col("doc_id") - F.col("least")).alias("rank"))
    return sft.batched(ranked, "rank", 48, drop_last=True).select("doc_id", "batch")


_MARKED = "CASE doc_id % 3 WHEN 0 THEN '<think>' || text || '</think><|endoftext|>' WHEN 1 THEN text || '<s><s>' ELSE text END"


@query(f"WITH t AS (SELECT doc_id, length(text) AS n, {STRIP % 'text'} = '' AS blank FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END + CASE WHEN n > 0 THEN 1 ELSE 0 END AS parts, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS specials FROM t")
def special_cuts(spark: SparkSession, d: str) -> DataFrame:
    parts = tokens.special_spans(F.expr(_MARKED))
    rows = docs(spark, d).select("doc_id", parts.alias("p"))
    return rows.select("doc_id", F.size("p").alias("parts"), F.size(F.filter("p", lambda t: t.isin(*tokens.SPECIAL_TOKENS))).alias("specials"))


@query(f"WITH b AS (SELECT doc_id, {_bytes_sql('text')} AS v FROM documents) SELECT doc_id, len(v) + 1 AS n, md5(array_to_string(list_append(list_transform(v, lambda x: {tokens._base_ids()}[x + 1]), {tokens.END_OF_TEXT}), ' ')) AS digest FROM b")
def byte_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", tokens.byte_ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))
