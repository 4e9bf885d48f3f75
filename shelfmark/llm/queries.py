"""One registered query for each operator, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, language_id, licenses, line_runs, merkle, ngram_scores, quality_rules, secret_scan, sentencepieces, simhash, suffix_dedup, warc_zip, whitening
from shelfmark.llm.common import ascii_lower, read
from shelfmark.llm.license_texts import TEMPLATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


#: DuckDB: the words of documents, and the texts in ASCII lower case.
WORDS_SQL = r"""docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)"""


@query(f"""WITH {WORDS_SQL},
windows AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b""")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policies(quality_rules.ledger(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("kept_base")).alias("base_failed"), (F.col("kept_base") & F.col("kept_v1")).alias("kept"), "failed_bits")


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.split_of(F.col("doc_id")) != 1))
    rows = language_id.predict(docs, model)
    return rows.select("doc_id", F.coalesce(language_id.split_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A public SentencePiece model; any other can be given to the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query()
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(read(spark, sf_dir, "documents"), MODEL)


@query("""WITH lines AS (SELECT doc_id, n - 1 AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS p, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
pairs AS (SELECT b.doc_id AS d, b.p, b.words, a.doc_id AS d0, a.p - b.p AS diagonal, b.p - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.p - b.p ORDER BY b.p) AS island
  FROM lines a JOIN lines b ON a.l = b.l AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.p < b.p)),
runs AS (SELECT DISTINCT d, p0, p1 FROM (SELECT d, min(p) AS p0, max(p) AS p1 FROM pairs GROUP BY d, d0, diagonal, island)),
marked AS (SELECT *, CASE WHEN p0 <= max(p1) OVER (PARTITION BY d ORDER BY p0, p1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM runs),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY d ORDER BY p0, p1 ROWS UNBOUNDED PRECEDING) AS stretch FROM marked),
stretches AS (SELECT d, stretch, min(p0) AS p0, max(p1) AS p1 FROM numbered GROUP BY ALL),
gone AS (SELECT DISTINCT lines.doc_id AS d, lines.p FROM stretches s JOIN lines ON lines.doc_id = s.d AND lines.p BETWEEN s.p0 AND s.p1
  QUALIFY sum(words) OVER (PARTITION BY s.d, s.stretch) >= 20),
kept AS (SELECT doc_id, count(*) AS n_deleted FROM lines JOIN gone ON doc_id = d AND lines.p = gone.p GROUP BY doc_id),
texts AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY n) AS text FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) x
  LEFT JOIN (SELECT lines.doc_id AS g, line FROM lines JOIN gone ON doc_id = d AND lines.p = gone.p) y ON x.doc_id = g AND line = n - 1 WHERE g IS NULL GROUP BY doc_id)
SELECT documents.doc_id, len(string_split(documents.text, chr(10))) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(texts.text, '') AS text
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN texts USING (doc_id)""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_runs.without_later_copies(read(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_deleted", "text")


@query("""WITH toks AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?"''()[]{}', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 16) AS wn, CAST(ceil(least(len(w), 16) * 4 / 5) AS BIGINT) AS need
  FROM (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?"''()[]{}', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 5),
dg AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM toks)),
ig AS (SELECT item_id, j, concat_ws(' ', w[j], w[j+1], w[j+2]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS j FROM items)),
ig2 AS (SELECT item_id, j, concat_ws(' ', w[j], w[j+1]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w))) AS j FROM items WHERE len(w) = 5)),
dg2 AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i+1]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM toks) WHERE concat_ws(' ', w[i], w[i+1]) IN (SELECT g FROM ig2)),
diagonals AS (SELECT doc_id, item_id, i - j AS d FROM dg JOIN ig USING (g) UNION SELECT doc_id, item_id, i - j FROM dg2 JOIN ig2 USING (g)),
starts AS (SELECT doc_id, item_id, d, unnest(range(0, len(w) - wn + 1)) AS a FROM diagonals JOIN items USING (item_id)),
scored AS (SELECT doc_id, item_id, d + a AS start, wn, need, len(list_filter(range(1, wn + 1), lambda o: coalesce(items.w[a + o] = CASE WHEN d + a + o >= 1 THEN toks.w[d + a + o] END, false))) AS matched
  FROM starts JOIN items USING (item_id) JOIN toks USING (doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS r FROM scored WHERE matched >= need)
SELECT doc_id, item_id, matched, wn AS "window", start FROM best WHERE r = 1""")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TEMPLATES_SQL = ", ".join("('%s', '%s')" % (name, text.replace("'", "''")) for name, text in TEMPLATES.items())


def _shingles_sql(keys: str, source: str) -> str:
    words = "list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    return (f"SELECT {keys}, i - 1 AS i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS s "
            f"FROM (SELECT {keys}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {keys}, {words} AS w FROM {source}))")


@query(f"""WITH templates(license, text) AS (VALUES {_TEMPLATES_SQL}),
own AS (SELECT DISTINCT license, s FROM ({_shingles_sql("license", "templates")})),
sized AS (SELECT license, s, n, CAST(2 ** ceil(log2(n) - 1e-9) AS BIGINT) AS c FROM own JOIN (SELECT license, count(*) AS n FROM own GROUP BY license) USING (license)),
hits AS (SELECT doc_id, license, n, c, s, i FROM ({_shingles_sql("doc_id", "documents")}) JOIN sized USING (s)),
inside AS (SELECT doc_id, license, n, s, unnest([i // c, i // c - 1]) AS w, i FROM hits),
held AS (SELECT doc_id, license, n, w, count(DISTINCT s) AS same, min(i) AS start FROM inside WHERE w >= 0 GROUP BY ALL HAVING count(DISTINCT s) >= n * 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY same DESC, start) AS r FROM held)
SELECT doc_id, license, same / n AS containment, start FROM best WHERE r = 1""")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


_S = secret_scan
_COUNT_LOG_SQL = "[" + ", ".join(map(str, _S.COUNT_LOG)) + "]"
#: A path: no digits, +, = or double slashes up to the last slash, no + or = behind it. Its last part begins behind that slash.
_PART_SQL = "CASE WHEN regexp_full_match(m, '[A-Za-z_/-]*/[A-Za-z0-9_-]*') AND NOT contains(regexp_replace(m, '[^/]*$', ''), '//') THEN length(m) - length(string_split(m, '/')[-1]) ELSE 0 END"
_RANDOM_SQL = " ".join(f"WHEN regexp_full_match(win, '{c.characters}+') THEN digits >= {c.digits} AND letters >= {c.letters} AND total <= {_S.most_concentrated(c.bits)}"
                       for c in _S.CLASSES)


def _matches_sql() -> str:
    """The pieces and matches of each pattern; DuckDB wants the pattern as a constant."""
    parts = []
    for n, name in enumerate(_S.KINDS):
        pattern = _S.SEARCH[name].replace("'", "''")
        parts.append(f"SELECT doc_id, {n} AS kind, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found FROM docs")
    return " UNION ALL ".join(parts)


@query(f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_matches_sql()}),
placed AS (SELECT doc_id, kind, list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n-1], lambda x: length(x))), 0) AS s, found[n] AS m
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM raw)),
base AS (SELECT doc_id, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM placed WHERE kind < 3 AND (kind > 0 OR length(regexp_extract(m, '{_S.ASSIGN.replace("'", "''")}', 1)) >= {_S.ASSIGNED})),
wins AS (SELECT doc_id, s, i, m[i:i+{_S.WINDOW - 1}] AS win FROM (SELECT doc_id, s, m, unnest(range(1 + {_PART_SQL}, length(m) - {_S.WINDOW - 2})) AS i FROM placed
  WHERE kind = 3 AND NOT regexp_full_match(m, '[0-9A-Fa-f]{{8}}-([0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}'))),
judged AS (SELECT * FROM wins WHERE NOT contains('{_S.ALPHABETS}', lower(win))
  AND NOT regexp_matches(lower(win), 'example|sample|dummy|placeholder|changeme|abcdefghij|0123456789|1234567890|qwertyuiop')),
counts AS (SELECT doc_id, s, i, win, ch, count(*) AS c FROM (SELECT doc_id, s, i, win, unnest(string_split(win, '')) AS ch FROM judged) GROUP BY ALL),
totals AS (SELECT doc_id, s, i, win, sum({_COUNT_LOG_SQL}[c + 1]) AS total, coalesce(sum(c) FILTER (regexp_matches(ch, '[0-9]')), 0) AS digits,
  coalesce(sum(c) FILTER (regexp_matches(ch, '[A-Za-z]')), 0) AS letters FROM counts GROUP BY ALL),
parts AS (SELECT doc_id, 3 AS kind, (s + min(i) - 1)::BIGINT AS b, (s + max(i) + {_S.WINDOW - 1})::BIGINT AS e FROM totals WHERE CASE {_RANDOM_SQL} ELSE false END GROUP BY doc_id, s),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, kind, b AS s, e FROM parts p WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = p.doc_id AND base.s <= p.b AND p.e <= base.e)),
texts AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS t FROM spans)
SELECT docs.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY s, kind), '') AS spans
FROM docs LEFT JOIN texts USING (doc_id) GROUP BY docs.doc_id""")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("spans")
    return secret_scan.scan(read(spark, sf_dir, "documents")).select(
        "doc_id", *(secret_scan.count_of(found, k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]),
        F.sha2(secret_scan.written(found, base_only=True), 256).alias("base_sha256"), secret_scan.written(found).alias("spans"))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_zip.round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3,
  CASE WHEN i > 1 THEN w[i-1] END AS b2, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] END AS b3 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
n1 AS (SELECT g1 AS g, count(*) AS c FROM t GROUP BY 1), n2 AS (SELECT g2 AS g, count(*) AS c FROM t WHERE g2 IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
n3 AS (SELECT g3 AS g, count(*) AS c FROM t WHERE g3 IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT doc_id, CASE WHEN n3.c IS NOT NULL THEN 3 WHEN n2.c IS NOT NULL THEN 2 ELSE 1 END AS o,
  CASE WHEN n3.c IS NOT NULL THEN n3.c / c3.c WHEN n2.c IS NOT NULL THEN 0.4::DOUBLE ** (least(i, 3) - 2) * n2.c / c2.c
    ELSE 0.4::DOUBLE ** (least(i, 3) - 1) * n1.c / (SELECT count(*) FROM t) END AS p
  FROM t JOIN n1 ON n1.g = g1 LEFT JOIN n2 ON n2.g = g2 LEFT JOIN n3 ON n3.g = g3 LEFT JOIN n1 c2 ON c2.g = b2 LEFT JOIN n2 c3 ON c3.g = b3)
SELECT w.doc_id, count(o) AS n_words, coalesce(sum(round(ln(p) * 1e6)::BIGINT), 0)::BIGINT AS log_micros, count(*) FILTER (o = 1) AS n_order1,
  count(*) FILTER (o = 2) AS n_order2, count(*) FILTER (o = 3) AS n_order3 FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id""")
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores.scores(read(spark, sf_dir, "documents"))


@query()
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), ["doc_id"])
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    return rows.select("row.doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: CRC-32 of the decimal doc_id by its table, which comes from the polynomial; digests of leaves; runs of 16 until one node is left; and the way up.
_CRC_SQL = """crc(k, n, c) AS (SELECT 0, i, i FROM range(256) t(i) UNION ALL SELECT k + 1, n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8)"""


def _coded_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


@query(f"""WITH RECURSIVE {_CRC_SQL},
docs AS (SELECT *, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c FROM documents, crc_table),
leaves AS (SELECT doc_id, source, sha256({" || ".join(map(_coded_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
  sha256({" || ".join(map(_coded_sql, ("doc_id", "source", "lang", "n_chars")))} || {_coded_sql("CASE WHEN xor(c, 4294967295) % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS found FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS size FROM leaves),
nodes(tree, level, pos, size, h) AS (SELECT tree, 0, pos, size, leaf FROM placed UNION ALL
  SELECT tree, level + 1, pos // 16, any_value((size + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 16),
subroots AS (SELECT tree, level, h FROM nodes WHERE size = 1),
top(level, pos, size, h) AS (SELECT 0, tree, (SELECT count(*) FROM subroots), h FROM subroots UNION ALL
  SELECT level + 1, pos // 16, any_value((size + 15) // 16), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY level, pos // 16),
runs AS (SELECT tree, level, pos // 16 AS run, list(h ORDER BY pos) AS children FROM nodes WHERE size > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, pos // 16, list(h ORDER BY pos) FROM top WHERE size > 1 GROUP BY ALL),
roots AS (SELECT h AS root FROM top WHERE size = 1),
climb(doc_id, leaf, home, tree, level, pos, folded, proof) AS (SELECT doc_id, leaf, tree, CASE WHEN size = 1 THEN -1 ELSE tree END, 0, CASE WHEN size = 1 THEN tree ELSE pos END, found, '' FROM placed UNION ALL
  SELECT doc_id, leaf, home, CASE WHEN c.tree >= 0 AND c.level + 1 = s.level THEN -1 ELSE c.tree END, CASE WHEN c.tree >= 0 AND c.level + 1 = s.level THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = s.level THEN c.tree ELSE c.pos // 16 END, sha256(array_to_string(list_concat(children[1:c.pos % 16], [folded], children[c.pos % 16 + 2:]), '')),
    proof || array_to_string(list_concat(children[1:c.pos % 16], children[c.pos % 16 + 2:]), '')
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // 16 LEFT JOIN subroots s ON s.tree = c.tree),
ends AS (SELECT c.*, s.h AS subroot FROM climb c JOIN subroots s ON s.tree = c.home WHERE c.tree = -1 AND c.level = (SELECT max(level) FROM top))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM ends, roots""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = [*values[:4], F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))]
    rows = merkle.climb(merkle.build(docs, F.col("doc_id"), F.col("source"), values, found))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
                       (F.col("folded") == F.col("root")).alias("verified"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
