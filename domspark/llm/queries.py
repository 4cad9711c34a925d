"""The registered query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, license_scan, line_dedup, near_dup, packing, pii, quality, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    if "DOMSPARK_TOKENIZERS" in os.environ:
        return os.path.join(os.environ["DOMSPARK_TOKENIZERS"], name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.run_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files. One that closes with a licence line is a licence file of the directory source/lang; the others lie below it."""
    docs = table(spark, sf_dir, "documents")
    licence_file = F.substring_index(F.coalesce("text", F.lit("")), "\n", -1).rlike("(?i)licen[sc]e")
    lang = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    name = F.col("doc_id").cast("string")
    path = F.when(licence_file, F.concat_ws("/", lang, name)).otherwise(F.concat_ws("/", lang, F.floor(F.col("doc_id") / 100).cast("string"), name))
    out = license_scan.license_scan(docs.select(path.alias("path"), "text"), license_scan.NOTICES, licence_file=licence_file)
    own = (F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("line", F.lit(-1)).cast("long").alias("line"))
    return out.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "licence", *own, "origin", "from_dir")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string"))
    return chat_format.chat_digests(chat_format.chat_format(chat_format.thread_messages(turns)))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "overlap", "question_overlap", "answer_overlap")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_license_scan,
        op3_near_dup,
        op4_url_filter,
        op5_personal_data,
        op6_chat_format,
        op7_decontaminate,
        op8_quality,
        op9_exact_dedup,
        op10_packing,
    )
}

_HOST = "translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1)"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_ESCAPED = r"length(regexp_replace(coalesce(text, ''), '[\\<\[]', 'xx', 'g'))"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLANKED = "translate(@, " + _quoted("".join(c for c in license_scan._FROM if c >= " ")) + " || chr(9) || chr(13) || chr(12) || chr(11), " + _quoted(license_scan._TO) + ")"
_TEMPLATES = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(license_scan.NOTICES))

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PLAIN = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"
_RUNS = "CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END"
SQL: dict[str, str] = {
    "op2_license_scan": f"""
        WITH templates(template, licence, body) AS (VALUES {_TEMPLATES}),
        told AS (SELECT template, licence, w, count(*) AS tf FROM (SELECT template, licence, unnest(string_split({_BLANKED.replace("@", "body", 1)}, ' ')) AS w FROM templates) WHERE w <> '' GROUP BY ALL),
        files AS (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(array_extract(string_split(coalesce(text, ''), chr(10)), -1), '(?i)licen[sc]e') AS is_file,
                  coalesce(source, '') || '/' || coalesce(lang, '') AS top FROM documents),
        named AS (SELECT doc_id, text, is_file, CASE WHEN is_file THEN top ELSE top || '/' || CAST(doc_id // 100 AS VARCHAR) END AS dir FROM files),
        words AS (SELECT doc_id, line, unnest(string_split(body, ' ')) AS w FROM
                  (SELECT doc_id, unnest(string_split({_BLANKED.replace("@", "text", 1)}, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM named)),
        terms AS (SELECT doc_id, line, w, count(*) AS tf FROM words WHERE w <> '' GROUP BY ALL),
        n AS (SELECT count(*) AS n FROM named),
        idf AS (SELECT v.w, ln((n.n + 1) / (count(DISTINCT t.doc_id) + 1)) + 1 AS idf FROM (SELECT DISTINCT w FROM told) v CROSS JOIN n LEFT JOIN terms t ON t.w = v.w GROUP BY v.w, n.n),
        weights AS (SELECT template, licence, w, tf * idf AS x, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS size FROM told JOIN idf USING (w)),
        scored AS (SELECT doc_id, line, w, tf * coalesce(idf, ln((SELECT n FROM n) + 1) + 1) AS x FROM terms LEFT JOIN idf USING (w)),
        sizes AS (SELECT doc_id, line, sqrt(sum(x * x)) AS size FROM scored GROUP BY ALL),
        near AS (SELECT s.doc_id, s.line, g.template, g.licence, round(sum(s.x * g.x / g.size) / any_value(z.size), 6) AS similarity
                 FROM scored s JOIN weights g USING (w) JOIN sizes z ON z.doc_id = s.doc_id AND z.line = s.line GROUP BY s.doc_id, s.line, g.template, g.licence),
        own AS (SELECT doc_id, line, licence, similarity FROM near WHERE similarity >= 0.8
                QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY licence <> 'all rights reserved' DESC, similarity DESC, line, template) = 1),
        dirs AS (SELECT dir, licence FROM named JOIN own USING (doc_id) WHERE is_file GROUP BY dir, licence QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, licence) = 1),
        rows AS (SELECT f.doc_id, f.dir, o.licence, o.similarity, o.line, d.licence AS near_licence, d.dir AS near_dir
                 FROM named f LEFT JOIN own o USING (doc_id) LEFT JOIN dirs d ON f.dir = d.dir OR starts_with(f.dir, d.dir || '/')
                 QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.dir) DESC NULLS LAST) = 1)
        SELECT doc_id, dir || '/' || doc_id AS path, coalesce(licence, near_licence) AS licence, coalesce(similarity, 0.0) AS similarity, coalesce(line, -1) AS line,
               CASE WHEN licence IS NOT NULL THEN 'header' WHEN near_licence IS NOT NULL THEN 'directory' END AS origin,
               CASE WHEN licence IS NULL THEN near_dir END AS from_dir FROM rows""",
    "op1_line_dedup": """
        WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        numbered AS (SELECT doc_id, unnest(l) AS line, unnest(list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT))) AS h, unnest(range(len(l))) AS i FROM lines),
        rolled AS (SELECT doc_id, line, i, (h + coalesce(lag(h) OVER d, 0) * 1000003) % 2147483647 % 3 = 0 AS closes, line || chr(10) || lead(line) OVER d AS pair
                   FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        placed AS (SELECT *, coalesce(sum(CAST(closes AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM rolled),
        firsts AS (SELECT doc_id, i, first_value(doc_id) OVER p AS first_doc, first_value(i) OVER p AS first_i FROM placed WHERE pair IS NOT NULL WINDOW p AS (PARTITION BY pair ORDER BY doc_id, i)),
        later AS (SELECT doc_id, i FROM firsts WHERE doc_id <> first_doc OR i > first_i + 1),
        gone AS (SELECT doc_id, i, true AS gone FROM later UNION SELECT doc_id, i + 1, true FROM later),
        judged AS (SELECT p.doc_id, p.i, p.place, p.line, coalesce(g.gone, false) AS gone FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i),
        chunks AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE whole) AS removed_chunks FROM (SELECT doc_id, place, bool_and(gone) AS whole FROM judged GROUP BY ALL) GROUP BY doc_id),
        texts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM judged GROUP BY doc_id)
        SELECT doc_id, n_lines, n_chunks, removed_chunks, removed_lines, length(text) AS n_chars, sha256(text) AS text_sha256 FROM texts JOIN chunks USING (doc_id)""",
    "op3_near_dup": f"""
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words),
        sized AS (SELECT doc_id, len(s) AS n, s, md5(array_to_string(s, chr(10))) AS digest FROM sets),
        classes AS (SELECT min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s, digest FROM sized WHERE n > 0 GROUP BY digest),
        held AS (SELECT id, n, unnest(s) AS x FROM classes),
        seen AS (SELECT id, n, x, count(*) OVER (PARTITION BY x) AS df FROM held),
        ranked AS (SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY df, x) AS k FROM seen),
        -- two sets that share enough have one of their n - ceil(0.8 n) + 1 rarest members in common
        rare AS (SELECT id, n, x FROM ranked WHERE k <= n - (n * 80 + 99) // 100 + 1),
        pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM rare a JOIN rare b ON a.x = b.x AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
        links AS (SELECT p.a, p.b FROM pairs p JOIN classes ca ON ca.id = p.a JOIN classes cb ON cb.id = p.b
                  WHERE 180 * len(list_intersect(ca.s, cb.s)) >= 80 * (ca.n + cb.n)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reached AS (SELECT id AS node, id AS reach FROM classes UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.reach),
        roots AS (SELECT node, min(reach) AS root FROM reached GROUP BY node)
        SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, coalesce(r.root, s.doc_id) = s.doc_id AS kept
        FROM sized s LEFT JOIN classes c ON c.digest = s.digest AND s.n > 0 LEFT JOIN roots r ON r.node = c.id""",
    "op7_decontaminate": f"""
        WITH split AS (SELECT item_id, text, len(rtrim(rtrim(text, {_BLANKS}), '.!?。')) AS body, rtrim(rtrim(text, {_BLANKS}), '.!?。') AS t FROM benchmark WHERE text IS NOT NULL),
        cut AS (SELECT item_id, text, length(regexp_extract(t, '^([\\s\\S]*[.!?。])[^.!?。]*$', 1)) AS q, t FROM split),
        parts AS (SELECT row_number() OVER () AS item, item_id, text, CASE WHEN q > 1 AND trim(substr(t, q + 1), {_BLANKS}) <> '' THEN substr(text, 1, q) ELSE text END AS question,
                  CASE WHEN q > 1 AND trim(substr(t, q + 1), {_BLANKS}) <> '' THEN substr(text, q + 1) ELSE '' END AS answer FROM cut),
        needles AS (SELECT item, item_id, part, {_PLAIN} AS w FROM (SELECT item, item_id, unnest(['overlap', 'question', 'answer']) AS part, unnest([text, question, answer]) AS text FROM parts)),
        wanted AS (SELECT DISTINCT item, item_id, part, len(w) AS n, unnest({_RUNS}) AS run FROM needles WHERE len(w) > 0),
        sizes AS (SELECT item, item_id, part, count(*) AS runs FROM wanted GROUP BY ALL),
        longest AS (SELECT max(len(w)) AS n FROM needles),
        texts AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
        windows AS (SELECT doc_id, start, w[start + 1 : start + 2 * n] AS w FROM (SELECT doc_id, w, n, unnest(range(0, greatest(1, len(w) - n), n)) AS start FROM texts, longest)),
        lengths AS (SELECT DISTINCT least(n, 5) AS k FROM wanted),
        held AS (SELECT DISTINCT doc_id, start, array_to_string(w[i : i + k - 1], ' ') AS run FROM (SELECT doc_id, start, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM windows, lengths WHERE len(w) >= k)),
        found AS (SELECT h.doc_id, h.start, s.item, s.item_id, s.part, count(*) / any_value(s.runs) AS share FROM held h JOIN wanted USING (run) JOIN sizes s USING (item, part) GROUP BY ALL),
        whole AS (SELECT f.doc_id, f.start, f.item, f.item_id, f.share AS overlap, coalesce(q.share, 0.0) AS question_overlap, CASE WHEN s.item IS NULL THEN 1.0 ELSE coalesce(a.share, 0.0) END AS answer_overlap
                  FROM found f LEFT JOIN found q ON q.part = 'question' AND q.doc_id = f.doc_id AND q.start = f.start AND q.item = f.item
                  LEFT JOIN found a ON a.part = 'answer' AND a.doc_id = f.doc_id AND a.start = f.start AND a.item = f.item
                  LEFT JOIN sizes s ON s.part = 'answer' AND s.item = f.item WHERE f.part = 'overlap' AND f.share >= 0.8)
        SELECT doc_id, item_id, overlap, question_overlap, answer_overlap FROM whole WHERE question_overlap >= 0.8 AND answer_overlap >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY overlap DESC, question_overlap + answer_overlap DESC, start) = 1""",
    "op4_url_filter": f"""
        WITH rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
        urls AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        fits AS (SELECT u.page_id, u.host, u.path, r.verdict, r.rule_host || r.rule_path AS rule,
                        row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS n
                 FROM urls u LEFT JOIN rules r ON ends_with('.' || u.host, '.' || r.rule_host) AND starts_with(u.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1""",
    "op6_chat_format": f"""
        WITH turns AS (SELECT conv_id, turn, role, text FROM conversations
                       UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({_ESCAPED} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
