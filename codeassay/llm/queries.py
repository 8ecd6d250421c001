"""Registered queries of the operators for training data, with production parameters over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.session import cut_lineage
from . import archive, decontaminate, infill, jaccard, languages, licenses, lines, packing, quality, search, substrings, tokens, toolcalls

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


@query("op3_compression_bands")
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.with_quality(docs).drop("text")


@query("op4_cutting_stock")
def op4_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids; one row per piece."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.packed_documents(docs).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over a context of 1024."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = tokens.with_token_counts(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents outside windows of 35 words that occur again."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cleaned = substrings.remove_repeats(docs, window=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard.jaccard_components(docs, k=5, percent=80)


@query("op8_winnowing")
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of 10 words of a benchmark item."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    hits = decontaminate.benchmark_hits(docs, items)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op1_cross_parsing")
def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labelled = languages.labelled_sample(docs, ~held_out, "doc_id", "text", "lang", languages.Sample())
    found = languages.with_language(docs.select("doc_id", "text"), labelled)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Equal and near lines as in ``lines.dedup_lines``; partners within one edit share a half for a length, and are then compared character by character.
LINES_SQL = r"""
WITH src AS (SELECT DISTINCT doc_id, text FROM documents),
cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM src),
worded AS (SELECT * FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, length(line) AS m, min({'k': doc_id, 'n': n}) AS first FROM worded GROUP BY line),
halves AS (SELECT line, m, first, unnest([
    'a' || m || ':' || left(line, m // 2), 'z' || m || ':' || right(line, m - m // 2),
    'a' || (m - 1) || ':' || left(line, (m - 1) // 2), 'z' || (m - 1) || ':' || right(line, (m - 1) - (m - 1) // 2)]) AS half FROM firsts WHERE m >= 16),
pairs AS (SELECT DISTINCT a.line AS line, b.line AS other FROM halves a JOIN halves b ON a.half = b.half AND b.first < a.first AND abs(a.m - b.m) <= 1),
placed AS (SELECT line, other, CASE WHEN length(line) >= length(other) THEN line ELSE other END AS x, CASE WHEN length(line) >= length(other) THEN other ELSE line END AS y FROM pairs),
differ AS (SELECT line, x, y, coalesce(list_min(list_filter(range(1, length(y) + 1), lambda i: x[i] <> y[i])), length(y) + 1) AS spot FROM placed),
near AS (SELECT DISTINCT line FROM differ WHERE substr(x, spot + 1) = CASE WHEN length(x) = length(y) THEN substr(y, spot + 1) ELSE substr(y, spot) END),
fate AS (SELECT c.doc_id, c.text, c.n, c.line, CASE WHEN f.line IS NULL THEN 0 WHEN r.line IS NOT NULL THEN 2 WHEN f.first <> {'k': c.doc_id, 'n': c.n} THEN 1 ELSE 0 END AS fate
  FROM cut c LEFT JOIN firsts f ON c.line = f.line LEFT JOIN near r ON c.line = r.line),
texts AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (fate = 1) AS n_equal, count(*) FILTER (fate = 2) AS n_near,
  coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (fate = 0), '') AS kept FROM fate GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_equal, 0) AS n_equal, coalesce(t.n_near, 0) AS n_near, sha256(t.kept) AS kept_sha256
FROM documents d LEFT JOIN texts t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.text = t.text
"""


@query("op9_line_dedup", LINES_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents without those that repeat an earlier one, up to one edit."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_equal", "n_near", F.sha2("text", 256).alias("kept_sha256"))


FIXITY_SQL = r"""
WITH src AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CASE WHEN page_id % 97 = 13 THEN '#' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS html_b FROM pages),
recs AS (SELECT page_id, url,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html_b) || chr(13) || chr(10) || chr(13) || chr(10) || html_b || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM src),
hashed AS (SELECT page_id, sha256(a) AS digest_a, strlen(a) AS len_a, sha256(b) AS digest_b, strlen(b) AS len_b,
  row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(a)) - 1 AS i FROM recs),
dealt AS (SELECT *, i // 1024 AS file, i % 1024 AS place, count(*) OVER (PARTITION BY i // 1024) AS n,
  sum(len_a) OVER w AS end_a, sum(len_b) OVER w AS end_b FROM hashed WINDOW w AS (PARTITION BY i // 1024 ORDER BY i)),
b AS (SELECT file, place, digest_a, end_a - len_a AS start_a, end_a, page_id,
  CASE WHEN file % 5 = 2 AND place >= n - 3 THEN NULL ELSE digest_b END AS digest_b, CASE WHEN file % 5 = 2 AND place >= n - 3 THEN NULL ELSE end_b - len_b END AS start_b,
  CASE WHEN file % 5 = 2 AND place >= n - 3 THEN NULL ELSE end_b END AS end_b FROM dealt)
SELECT file, place, page_id, CAST(start_a AS BIGINT) AS start_a, CAST(end_a AS BIGINT) AS end_a, CAST(start_b AS BIGINT) AS start_b, CAST(end_b AS BIGINT) AS end_b, digest_a, digest_b,
  CASE WHEN digest_b IS NULL THEN 'missing' WHEN digest_a <> digest_b THEN 'corrupt' ELSE 'moved' END AS kind
FROM b WHERE digest_b IS NULL OR digest_a <> digest_b OR start_a <> start_b OR end_a <> end_b
"""


@query("op10_merkle_fixity", FIXITY_SQL)
def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an archive of all pages whose replica is damaged.

    The tables hold no second copy, so the replica is made of the pages: in one
    of 97 records a byte differs, and one file of five has lost its last three records.
    """
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    flipped = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.expr("substr(coalesce(html, ''), 2)"))).otherwise(body)
    record, other = archive.warc_record(F.col("url"), F.col("html")), archive.warc_record(F.col("url"), flipped)
    both = pages.select(
        F.col("page_id").alias("key"), F.coalesce("url", F.lit("")).alias("url"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("bigint").alias("length"),
        F.sha2(other, 256).alias("digest_b"), F.octet_length(other).cast("bigint").alias("length_b"),
    )
    dealt = archive.dealt_to_files(both)
    n = F.count("*").over(Window.partitionBy("file"))
    dealt = dealt.withColumn("n", n)
    ours = archive.leaves(dealt.select("file", "place", "key", "digest", "length"))
    copy = dealt.filter((F.col("file") % 5 != 2) | (F.col("place") < F.col("n") - 3))
    theirs = archive.leaves(copy.select("file", "place", "key", F.col("digest_b").alias("digest"), F.col("length_b").alias("length")))
    return archive.damage(ours, theirs).withColumnRenamed("key", "page_id")


def tool_traffic(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the conversations imply: they hold prose, so each assistant turn makes two calls about its text.

    The second needs the first and the second one of the turn before; the turn
    that follows is its result.  Some calls are faulty: a text for a number,
    a missing query, an unknown need, a cycle.
    """
    asked = messages.filter("role = 'assistant'")
    name = lambda c, t, k: F.concat(F.lit("call-"), c.cast("string"), F.lit("-"), t.cast("string"), F.lit(k))
    c, t = F.col("conv_id"), F.col("turn")
    words, size = F.expr(r"concat_ws(' ', slice(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0), 1, 3))"), F.char_length("text")
    limit = F.when(t % 7 == 3, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string"))
    query_part = F.when(c % 11 == 5, F.lit("")).otherwise(F.concat(F.lit('"query" : "'), words, F.lit('", ')))
    second = F.concat(F.lit("{ "), query_part, F.lit('"limit" : '), limit, F.lit(' ,"exact": true}'))
    needs = F.array(name(c, t, "-b"), name(c, t - 2, "-a"))
    needs_second = F.when(t <= 1, F.array(name(c, t, "-b"))).otherwise(needs)
    needs_second = F.when(c % 10 == 0, F.concat(needs_second, F.array(F.lit("call-none")))).otherwise(needs_second)
    calls = asked.select(
        "conv_id", "turn",
        F.explode(F.array(
            F.struct(name(c, t, "-b").alias("call_id"), F.lit("lookup").alias("tool"), F.concat(F.lit('{"key":'), size.cast("string"), F.lit("}")).alias("arguments"),
                     F.when(c % 23 == 4, F.array(name(c, t, "-a"))).otherwise(F.array().cast("array<string>")).alias("needs")),
            F.struct(name(c, t, "-a").alias("call_id"), F.lit("search").alias("tool"), second.alias("arguments"), needs_second.alias("needs")),
        )).alias("x"),
    ).select("conv_id", "turn", "x.*")
    results = messages.filter("turn >= 1 and role = 'user'").select("conv_id", name(c, t - 1, "-a").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "exact", "boolean", False), ("lookup", "key", "integer", True)]

TOOLS_SQL = r"""
WITH a AS (SELECT conv_id, turn, text, length(text) AS size, array_to_string(list_slice(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), 1, 3), ' ') AS words,
  'call-' || conv_id || '-' || turn AS id FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, text, 'call-' || conv_id || '-' || (turn - 1) || '-a' AS id FROM conversations WHERE role = 'user' AND turn >= 1),
deep AS (SELECT a.*, r.turn AS result_turn, EXISTS (SELECT 1 FROM a p WHERE p.conv_id = a.conv_id AND p.turn = a.turn - 2) AS prior, 1 AS depth
  FROM a LEFT JOIN r ON r.conv_id = a.conv_id AND r.id = a.id || '-a'),
calls AS (
  SELECT conv_id, CASE WHEN conv_id % 23 = 4 THEN NULL ELSE turn END AS due, CASE WHEN conv_id % 23 = 4 THEN NULL ELSE 0 END AS depth, 1 AS phase, id || '-b' AS id, turn,
    CASE WHEN conv_id % 23 = 4 THEN 'cyclic' ELSE 'pending' END AS status, CAST([] AS VARCHAR[]) AS errors, 0 AS unknown_needs, '{"arguments":{"key":' || size || '},"id":"' || id || '-b","name":"lookup","type":"call"}' AS json FROM deep
  UNION ALL
  SELECT conv_id, CASE WHEN conv_id % 23 = 4 THEN NULL ELSE turn END, CASE WHEN conv_id % 23 = 4 THEN NULL ELSE depth END, 1, id || '-a', turn,
    CASE WHEN conv_id % 23 = 4 THEN 'cyclic' WHEN result_turn IS NULL THEN 'pending' ELSE 'linked' END,
    list_filter([CASE WHEN conv_id % 11 = 5 THEN 'missing:query' END, CASE WHEN turn % 7 = 3 THEN 'type:limit' END], lambda x: x IS NOT NULL),
    CASE WHEN conv_id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN turn > 1 AND NOT prior THEN 1 ELSE 0 END,
    '{"arguments":{"exact":true,"limit":' || CASE WHEN turn % 7 = 3 THEN '"' || size || '"' ELSE CAST(size AS VARCHAR) END || CASE WHEN conv_id % 11 = 5 THEN '' ELSE ',"query":"' || words || '"' END
      || '},"id":"' || id || '-a","name":"search","type":"call"}' FROM deep),
results AS (SELECT r.conv_id, CASE WHEN c.id IS NULL THEN r.turn WHEN c.due IS NULL THEN NULL ELSE greatest(r.turn, c.due) END AS due, CASE WHEN c.id IS NULL OR c.due < r.turn THEN 0 ELSE c.depth + 1 END AS depth, 2 AS phase, r.id, r.turn,
  CASE WHEN c.id IS NULL THEN 'orphan' ELSE 'linked' END AS status, CAST([] AS VARCHAR[]) AS errors, 0 AS unknown_needs, '{"content":' || to_json(r.text) || ',"id":"' || r.id || '","type":"result"}' AS json
  FROM r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.id = r.id),
said AS (SELECT conv_id, turn AS due, -1 AS depth, 0 AS phase, '' AS id, turn, 'linked' AS status, CAST([] AS VARCHAR[]) AS errors, 0 AS unknown_needs,
  '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' AS json FROM conversations),
events AS (SELECT * FROM said UNION ALL SELECT * FROM calls UNION ALL SELECT * FROM results)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY due NULLS LAST, depth NULLS LAST, turn, phase, id, json) - 1 AS position,
  CASE phase WHEN 0 THEN 'message' WHEN 1 THEN 'call' ELSE 'result' END AS kind, CASE WHEN phase > 0 THEN id END AS call_id, turn, CASE WHEN phase > 0 THEN CAST(depth AS BIGINT) END AS depth,
  status, array_to_string(errors, ',') AS errors, CAST(0 AS BIGINT) AS repeats, CAST(unknown_needs AS BIGINT) AS unknown_needs, json FROM events
"""


@query("op7_tool_calls", TOOLS_SQL)
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, calls and results of all conversations, linked, ordered, validated and serialised."""
    messages = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    calls, results = tool_traffic(messages)
    schemas = spark.createDataFrame(TOOLS, "tool string, name string, type string, required boolean")
    linked = toolcalls.link_tool_calls(messages, calls, results, schemas)
    return linked.withColumn("errors", F.concat_ws(",", "errors"))


def template_expression(template: licenses.Template) -> str:
    """The template as an expression over words that each end in a blank, for the SQL counterpart."""
    out, at, markup = [], 0, template.markup.lower()
    words = lambda text: "".join(f"{w} " for w in licenses.WORD.findall(text))
    for m in re.finditer(r"<<(.*?)>>", markup):
        out.append(words(markup[at : m.start()]))
        at, fields = m.end(), dict(re.findall(r'(\w+)="(.*?)"', m[1]))
        if m[1] == "beginoptional":
            out.append("(?:")
        elif m[1] == "endoptional":
            out.append(")?")
        else:
            match = fields["match"].replace(".+", "[^ ]+")
            out.append(f"(?:(?:{match}) ){{{fields['least']},{fields['most']}}}")
    return "(?:^| )" + "".join(out) + words(markup[at:])


def licenses_sql() -> str:
    """Places of phrases by position, templates by expressions, the score by the mandatory words of what is met."""
    templates = licenses.default_templates()
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = [(p.label, p.markup.split()) for p in licenses.PHRASES]
    places = ", ".join(f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(x)}] = {x!r}) AS at_{n}" for n, (_, x) in enumerate(phrases))
    ats = [f"at_{n}" for n in range(len(phrases))]
    base = ", ".join(f"CASE WHEN len({a}) > 0 THEN {quote(label)} END" for a, (label, _) in zip(ats, phrases, strict=True))
    met = ", ".join(f"CASE WHEN regexp_matches(said, {quote(template_expression(t))}) THEN {n} END" for n, t in enumerate(templates))
    names = ", ".join(quote(t.label) for t in templates)
    mandatory = [licenses.compile_template(t).mandatory for t in templates]
    worth = ", ".join(str(len(x)) for x in mandatory)
    phrase_worth = ", ".join(f"CASE WHEN len({a}) > 0 THEN {len(x)} ELSE 0 END" for a, (_, x) in zip(ats, phrases, strict=True))
    return rf"""
WITH src AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
said AS (SELECT doc_id, w, array_to_string(list_transform(w, lambda x: x || ' '), '') AS said FROM src),
found AS (SELECT doc_id, len(w) AS n_words, {places}, list_filter([{met}], lambda x: x IS NOT NULL) AS met FROM said),
places AS (SELECT *, list_concat(list_concat({ats[0]}, {ats[1]}), list_concat({ats[2]}, {ats[3]})) AS ats, list_filter([{base}], lambda x: x IS NOT NULL) AS base,
  list_max(list_concat([0, {phrase_worth}], list_transform(met, lambda x: [{worth}][x + 1]))) AS worth FROM found)
SELECT doc_id, n_words, len(ats) AS n_base, list_min(ats) AS first_word, list_max(ats) AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, list_transform(met, lambda x: [{names}][x + 1])))), ',') AS labels,
  CAST(worth AS DOUBLE) / (worth + {licenses.HALF_WORDS}) AS score FROM places
"""


@query("op11_license_templates", licenses_sql())
def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and accepted license templates of every document."""
    found = licenses.with_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score"
    )


SEARCH_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0),
said AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM said GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
impact AS (SELECT r, doc_id, term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS impact
  FROM tf JOIN df USING (term), totals),
scored AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impact USING (term) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_search", SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return search.ranked_search(docs, items, k=10)


INFILL_SQL = r"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS h FROM documents),
drawn AS (SELECT doc_id, text, w, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM src),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 :], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""


@query("op13_fill_in_middle", INFILL_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as prefix, suffix and middle, and back from the output."""
    outputs = infill.with_infill(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    back = infill.with_restored(outputs)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
