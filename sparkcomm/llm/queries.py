"""The operators over the driver tables, with their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcomm.llm import bpe, contamination, fingerprints, html, language, mixing, near_duplicates, prefix_trie, quality, runs, scoring, secrets, token_counts
from sparkcomm.llm.common import crc_mod


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.decode(bpe.encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    return language.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir))
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.spelled(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare_with_edits(_documents(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("near_edited", "near_next")})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = scoring.train(docs.where(crc_mod(F.col("doc_id"), 10) != 0))
    rows = scoring.score(docs, model)
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_documents(spark, sf_dir))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.find_runs(runs.repeat_tails(_documents(spark, sf_dir)))
    # the longest run; of equally long ones the first, then that of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = rows.withColumn("best", best).withColumns({"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period")})
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.conversations(turns)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination.scan(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mix_sources": op1,
    "op2_byte_bpe": op2,
    "op3_language_id": op3,
    "op4_secret_scan": op4,
    "op5_fingerprints": op5,
    "op6_quality_rules": op6,
    "op7_lm_scores": op7,
    "op8_html_text": op8,
    "op9_near_duplicates": op9,
    "op10_token_counts": op10,
    "op11_periodic_runs": op11,
    "op12_prefix_trie": op12,
    "op13_benchmark_spans": op13,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
named AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM totals),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM named WINDOW b AS (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (SELECT source, i, source_size, CAST(least(2.0 * source_size, (max(level) OVER ()) * w) AS DOUBLE) AS target FROM levels),
placed AS (
  SELECT r.*, w.source_size, w.target, w.i, CAST(floor(round(w.target, 6)) AS BIGINT) AS t,
    CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
  FROM rows r JOIN wanted w ON r.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  greatest(least(t - st, size), 0) + greatest(least(t - st - source_size, size), 0) AS taken,
  CASE WHEN least(t - st, size) > 0 THEN round(least(CASE (i - 1) % 3 WHEN 0 THEN 10 * x / (6 + sqrt(36 - 20 * x)) WHEN 1 THEN x ELSE 2 * x / (0.5 + sqrt(0.25 + 2 * x)) END, 1), 6) END AS position
FROM (SELECT *, least((st + least(t - st, size) / 2) / greatest(t, 1), 1) AS x FROM placed)"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(name: str, kind: str, pattern: str, least: int, group: int, rank: int) -> str:
    """Spans of one kind: matches, and where they start, from the lengths of matches and of the text between them."""
    return rf"""
{name}_m AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g, regexp_split_to_array(t, '{pattern}') AS gaps FROM d),
{name}_u AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g, gaps FROM {name}_m),
{name} AS (
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM {name}_u WHERE length(g[i]) >= {least})"""


_MORE_SQL = [(r.kind, r.pattern.replace("'", "''")) for r in secrets.MORE]
_KINDS = ["assign", "access", "hex", *[k for k, _ in _MORE_SQL]]
_OP4 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + ",".join(
        [_spans_sql("assign", "assign", _ASSIGN, 12, 2, 0), _spans_sql("acc", "access", "AKIA[A-Z0-9]+", 18, 0, 1), _spans_sql("hex", "hex", "[0-9a-f]+", 16, 0, 2)]
        + [_spans_sql(f"more{i}", kind, pattern, 1, 0, 3 + i) for i, (kind, pattern) in enumerate(_MORE_SQL)]
    )
    + ", every AS ("
    + " UNION ALL ".join(f"SELECT doc_id, kind, rank, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM {t}" for t in ["assign", "acc", "hex", *[f"more{i}" for i in range(len(_MORE_SQL))]])
    + """),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)"""
)

_LIMITS = ", ".join(f"'{x}'" for x in fingerprints.LIMITS)


_TERMS = "list_distinct(string_split_regex(lower(t), '[\\x20\\x09-\\x0D]+'))"
_THIN = f"substr(h, {fingerprints.DIGITS + 2}, 3)"


def _fingerprint_sql(source: str) -> str:
    """Fingerprint from every, the sorted md5 of distinct terms, and held, those in the band and the widest lexicon."""
    mine = f"list_filter(held, lambda h: substr(h, {fingerprints.DIGITS + 1}, 1) = d AND {_THIN} < lim)"
    part = f"""array_to_string(list_transform(string_split('0123456789abcdef', ''), lambda d: array_to_string(list_transform([{_LIMITS}],
      lambda lim: CASE WHEN len({mine}) = 0 THEN '{fingerprints.NONE}' ELSE substr(md5(array_to_string({mine}, '')), 1, {fingerprints.SIZE}) END), '')), '')"""
    return f"""SELECT doc_id, CASE WHEN len(held) = 0 THEN 'all-' || md5(array_to_string(every, '')) ELSE {part} END AS f
  FROM (SELECT doc_id, list(h ORDER BY h) AS every, coalesce(list(h ORDER BY h) FILTER (band.f IS NOT NULL AND {_THIN} < '{fingerprints.LIMITS[0]}'), []) AS held
    FROM (SELECT doc_id, unnest(list_transform({_TERMS}, lambda w: md5(w))) AS h FROM {source})
    LEFT JOIN band ON band.f = substr(h, 1, {fingerprints.DIGITS}) GROUP BY doc_id)"""


def _likeness_sql(a: str, b: str) -> str:
    one = fingerprints.SIZE * len(fingerprints.LIMITS)
    at = lambda t: f"substr({t}, s * {one} + i * {fingerprints.SIZE} + 1, {fingerprints.SIZE})"
    levels = f"range(0, {len(fingerprints.LIMITS)})"
    held = f"list_filter(range(0, {fingerprints.DRAWINGS}), lambda s: len(list_filter({levels}, lambda i: {at(a)} <> '{fingerprints.NONE}' OR {at(b)} <> '{fingerprints.NONE}')) > 0)"
    equal = f"list_filter({held}, lambda s: len(list_filter({levels}, lambda i: {at(a)} = {at(b)} AND {at(a)} <> '{fingerprints.NONE}')) > 0)"
    return f"round(CASE WHEN {a} = {b} THEN 1.0 WHEN {a} LIKE 'all-%' OR {b} LIKE 'all-%' THEN 0.0 ELSE CAST(len({equal}) AS DOUBLE) / len({held}) END, 6)"


_OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pairs AS (
  SELECT doc_id, t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t
  FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT doc_id, next_id, length(t) AS n, substr(t, 1, length(t) - length(t) // 2) || substr(next_t, 1, length(t) // 2) AS t FROM pairs),
seen AS (
  SELECT DISTINCT doc_id, substr(h, 1, {fingerprints.DIGITS}) AS f FROM (SELECT doc_id, unnest(list_transform({_TERMS}, lambda w: md5(w))) AS h FROM d) WHERE {_THIN} < '{fingerprints.LIMITS[0]}'),
band AS (SELECT f FROM seen GROUP BY f HAVING count(*) >= {fingerprints.LEAST} AND count(*) <= greatest(2, (SELECT count(*) FROM d) // {fingerprints.MOST})),
own AS MATERIALIZED ({_fingerprint_sql("d")}),
new AS MATERIALIZED ({_fingerprint_sql("edits")})
SELECT e.doc_id, e.n AS n_chars, sha256(e.t) AS edited_sha256, own.f AS fingerprint, new.f AS edited_fingerprint,
  {_likeness_sql("own.f", "new.f")} AS near_edited, {_likeness_sql("own.f", "nxt.f")} AS near_next
FROM edits e JOIN own USING (doc_id) JOIN new USING (doc_id) JOIN own nxt ON nxt.doc_id = e.next_id"""

_OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '-') AS host, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
reps AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, {quality.WINDOW}) r(j) GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (
  SELECT doc_id, i, trim(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(translate(lower(t), '123456789', '000000000'), chr(10)) AS ls FROM d))),
hashed AS (SELECT doc_id, i, substr(md5(l), 1, 16) AS h, len(string_split(l, ' ')) AS words FROM norm WHERE l <> ''),
whole AS (SELECT doc_id, substr(md5(string_agg(h, '' ORDER BY i)), 1, 16) AS document FROM hashed GROUP BY doc_id),
line AS (SELECT h.doc_id, d.host, h.h, h.words, document FROM hashed h JOIN whole USING (doc_id) JOIN d USING (doc_id)),
often AS (
  SELECT host, h FROM (SELECT DISTINCT host, h, document FROM line) JOIN (SELECT host, count(*) AS documents FROM d GROUP BY host) USING (host) GROUP BY host, h, documents
  HAVING count(*) > {quality.LINE_DOCUMENTS} AND count(*) > {quality.LINE_SHARE} * documents),
gone AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS n FROM line JOIN often USING (host, h) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
    coalesce(reps.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM d LEFT JOIN reps USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed, gone AS n_boilerplate_words,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words)
    AND NOT (n_words - gone < {quality.MIN_WORDS} OR n_words - gone < {quality.LEFT_SHARE} * n_words) AS kept
FROM base"""

#: crc32 of the decimal digits in s: bytes and eight shifts each, taken in turn.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(s, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

_OP12 = f"""
WITH o AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS n, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k, n) AS ks, list(n ORDER BY turn NULLS FIRST, k, n) AS ns FROM o GROUP BY conv_id),
h AS (SELECT conv_id, CAST({_CRC} % 9 AS INTEGER) AS h FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM a)),
c AS (
  SELECT a.conv_id, list_concat(coalesce(b.ks[1:h], []), a.ks[h + 1:]) AS ks, list_concat(coalesce(b.ns[1:h], []), a.ns[h + 1:]) AS ns
  FROM a JOIN h USING (conv_id) LEFT JOIN a b ON b.conv_id = a.conv_id - a.conv_id % 5),
r AS (
  SELECT conv_id, d, d = len(ks) AS final, md5(array_to_string(ks[1:d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], '')) END AS up, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM c)),
nodes AS (
  SELECT k, d, up, n, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final) AS ends FROM r GROUP BY k, d, up, n),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
sums AS (
  SELECT r.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own.n) AS saved FROM own JOIN r ON r.conv_id = own.conv_id AND r.d <= own.d GROUP BY r.k)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sums USING (k) LEFT JOIN nodes up ON up.k = own.up"""

_WORD13 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD13}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD13}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(len(w), {contamination.WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {contamination.WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM places) JOIN win USING (n, k)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

SQL = {
    "op1_mix_sources": _OP1,
    "op4_secret_scan": _OP4,
    "op5_fingerprints": _OP5,
    "op6_quality_rules": _OP6,
    "op12_prefix_trie": _OP12,
    "op13_benchmark_spans": _OP13,
}
