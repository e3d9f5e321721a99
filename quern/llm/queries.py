"""The queries opN_<name> and pipeline, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat_format, decontaminate, exact_dedup, fill_middle, language_id, license_scan, minhash, near_dup, quality, secret_scan, source_audit, source_mix, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.chat_digest(chat_format.chat_format(turns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.source_mix(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_scores(table(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_near_dup(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_digest(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_suffix_dedup, op4_chat_format, op5_exact_dedup, op6_source_mix, op7_quality, op8_decontaminate, op9_language_id, op10_near_dup, op11_source_audit, op12_minhash, op13_fill_middle)}


def _license_sql() -> str:
    known = ", ".join(f"'{k}': '{v}'" for k, v in license_scan.known_pieces(license_scan.SENTENCES).items())
    # No look-around here: dots between digits are set aside, the others become spaces.
    spelled = r"regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g')"
    spelled = rf"regexp_replace(regexp_replace({spelled}, '([0-9])\.([0-9])', '\1#\2', 'g'), '([0-9])\.([0-9])', '\1#\2', 'g')"
    spelled = f"trim(regexp_replace(replace(replace({spelled}, '.', ' '), '#', '.'), ' +', ' ', 'g'))"
    # No look-behind: an expression is taken apart from its tag on, one operator a round.
    text = "lower(coalesce(text, ''))"
    for pattern, instead in license_scan.REWRITES[:1]:
        text = f"regexp_replace({text}, '{pattern}', '{instead}', 'g')"
    text = rf"regexp_replace({text}, '(spdx-license-identifier:[^\n]*[0-9])\+', '\1-or-later', 'g')"
    for _ in range(6):
        text = rf"regexp_replace({text}, '(spdx-license-identifier:[^\n]*?)[ \t)]+(?:or|and|with)[ \t(]+', '\1' || chr(10) || 'spdx-license-identifier: ', 'g')"
    text = rf"regexp_replace({text}, 'spdx-license-identifier:[ \t(]*([a-z0-9.-]+)', chr(10) || 'spdx license identifier \1' || chr(10), 'g')"
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(license_scan.RULES, 1):
        needle = "|" + "||".join(ids) + "|"
        steps.append(f"r{k} AS (SELECT doc_id, ids, replace(state, '{needle}', '||') AS state, CASE WHEN contains(state, '{needle}') THEN list_append(got, '{name}') ELSE got END AS got FROM {last})")
        last = f"r{k}"
    return rf"""
        WITH s AS (SELECT doc_id, regexp_split_to_array({text}, '[.;:!?]\s+|\n+') AS parts FROM documents),
        n AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: MAP {{{known}}}[{spelled}]), lambda y: y IS NOT NULL) AS names FROM s),
        r0 AS (SELECT doc_id, ids, '|' || array_to_string(ids, '||') || '|' AS state, []::VARCHAR[] AS got FROM
            (SELECT doc_id, list_filter(names, lambda x, i: i = 1 OR names[i - 1] <> x) AS ids FROM n)),
        {", ".join(steps)}
        SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(got)), ',') AS licenses, len(list_distinct(got))::BIGINT AS n_licenses FROM {last}"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op4_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        coded AS (SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\o'), '</turn>', '\c') AS safe,
            replace(replace(replace(replace(role, '\', '\b'), '### ', '\o'), '</turn>', '\c'), ':' || chr(10), '\r') AS safe_role FROM rows),
        digest AS (
            SELECT conv_id, count(*)::BIGINT AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(length(safe) + length(safe_role) + 4 + 2 + 8)::BIGINT AS formatted_chars,
                string_agg(left(role, 1) || CASE WHEN role IN ('system', 'user', 'assistant') THEN '' ELSE '?' END, '' ORDER BY turn, role, text) AS seen
            FROM coded GROUP BY conv_id),
        -- Of the marks s, u, a: the longest start that the machine can walk.
        walked AS (SELECT *, regexp_extract(seen, '^(s?(ua)*u?)', 1) AS ok FROM digest)
        SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
            regexp_full_match(seen, 's?(ua)+') AS valid,
            CASE WHEN length(ok) < n_turns THEN length(ok)::BIGINT ELSE -1 END AS bad_turn
        FROM walked""",
    "op6_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank, 3.0::DOUBLE * source_size AS most FROM s),
        v AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight FROM w),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
        t AS (SELECT source, rank, source_size, least(most, coalesce(max(level) FILTER (level <= most / weight) OVER () * weight, most)) AS target, ceil(source_size / 64.0)::BIGINT AS blocks FROM l),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0.0 END AS share FROM t),
        -- Every slot of a shard of 2048 draws a number from its own stratum, and so a source.
        c AS (SELECT *, sum(share) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(share) OVER () AS upto, ceil(sum(share) OVER ())::BIGINT AS slots FROM q),
        r AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY rank), 0) AS lo, CASE WHEN rank = max(rank) FILTER (share > 0) OVER () THEN 1.0 ELSE upto END AS hi FROM c),
        n AS (SELECT unnest(range((SELECT max(slots) FROM r))) AS slot),
        u AS (SELECT slot, (slot % 2048 + ('0x' || left(md5('slot:42:' || slot), 12))::BIGINT / 281474976710656.0::DOUBLE) / least(2048, (SELECT max(slots) FROM r) - slot // 2048 * 2048) AS u FROM n),
        k AS (SELECT source, rank, blocks, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS k FROM u JOIN r ON u >= lo AND u < hi),
        -- Its source's block by a permutation of each epoch.
        p AS (SELECT *, k % blocks AS i, list_filter([1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121]::BIGINT[], lambda x: blocks % x <> 0) AS able, ':42:' || coalesce(source, chr(0) || 'null') || ':' || k // blocks AS seed FROM k WHERE k < 3 * blocks),
        b AS (SELECT rank, (i * able[(('0x' || left(md5('a' || seed), 12))::BIGINT % len(able)) + 1] + ('0x' || left(md5('b' || seed), 12))::BIGINT % blocks) % blocks AS block, count(*) AS times FROM p GROUP BY ALL),
        o AS (SELECT d.*, q.rank, q.source_size, q.target, sum(size) OVER (PARTITION BY q.rank ORDER BY ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 256, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS place FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
        x AS (SELECT doc_id, rank, size, place, unnest(range(place // 64, (place + size - 1) // 64 + 1)) AS block FROM o WHERE size > 0),
        g AS (SELECT doc_id, place, rank, sum((least(place + size, (block + 1) * 64) - greatest(place, block * 64)) * times)::BIGINT AS taken FROM x JOIN b USING (rank, block) GROUP BY ALL)
        SELECT o.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM o LEFT JOIN g USING (doc_id, place, rank)""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_source_audit": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{source_audit.UPPER}', '{source_audit.LOWER}'), '{source_audit.TERM}')) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        langs AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS terms FROM kept GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.lang_n FROM g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
        s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM c),
        p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * terms) AS p, 1 + 1000000000::HUGEINT * (lang_n + 5) // (lang_total + 5 * terms) AS q FROM s JOIN langs USING (lang)),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
        every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        x AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM x""",
}
