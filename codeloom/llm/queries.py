"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from ..sources.tables import table
from . import chat, collocations, decontaminate, jaccard, language, mixing, pii, prefix_trie, quality, rules, secrets, simhash, suffix_levels

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = Query(name, plan, sql)
        return plan

    return register


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bg AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bg),
dg AS (
  SELECT doc_id, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, m, p, item_id FROM dg JOIN bg USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query("op1_winnow_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def fold(parts: int, held: int):
    """Marks the ids whose checksum leaves ``held`` when divided by ``parts``."""
    def held_out(doc_id: Column) -> Column:
        return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == held

    return held_out


@query("op2_neighbour_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5, 0))


@query("op3_hierarchical_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), fold(4, 2))


@query("op4_temperature_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, role, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS pos FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
x AS (
  SELECT r.conv_id, speaker, pos // 256 AS segment, pos, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
      ELSE '<|user:' || replace(replace(role, '\', '\\'), '<|', '<\|') || '|>' END || chr(10) AS head,
    replace(replace(said, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) AS body
  FROM r JOIN s USING (conv_id)),
y AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, segment ORDER BY pos) AS stop FROM x)
SELECT conv_id, speaker, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, count(*) FILTER (mine) AS n_masked_turns,
  string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY pos) FILTER (mine), '') AS mask
FROM y GROUP BY conv_id, speaker, segment
"""


@query("op5_perspective_rotation", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


OP6_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""


@query("op6_jaccard_join", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


@query("op7_lstm_crf_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, CAST(2 * p + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM b)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
c AS (SELECT doc_id, q, substr(x, CAST(2 * q + 1 AS BIGINT), 2) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS q FROM b)),
g AS (
  SELECT c.doc_id, q, y, max(CASE WHEN r.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY c.doc_id ORDER BY q ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
  FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND r.p = c.q),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY q), 0) = 0 THEN 1 ELSE 0 END AS begins FROM g),
n AS (
  SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(begins) AS BIGINT) AS n_spans,
    coalesce(string_agg(y, '' ORDER BY q) FILTER (gone = 0), '') AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN n USING (doc_id)
"""


@query("op8_suffix_levels", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.report(table(spark, sf_dir, "documents"))


@query("op9_risk_controlled_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_markov_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH rounds AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x
  FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(x ORDER BY i) AS tab FROM rounds),
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({'k': md5(CAST(length(role) AS VARCHAR) || ':' || role || said), 'n': length(said)} ORDER BY turn NULLS FIRST, role, said) AS w FROM t GROUP BY c),
h AS (
  SELECT c, w, c - c % 100 AS base, CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS BIGINT) AS h
  FROM own, tab),
f AS (
  SELECT h.c, list_concat(CASE WHEN h.h = 0 OR b.w IS NULL THEN [] ELSE list_slice(b.w, 1, h.h) END, list_slice(h.w, h.h + 1, len(h.w))) AS w
  FROM h LEFT JOIN own b ON b.c = h.base),
p AS (
  SELECT c, d, len(w) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE w[d].n END AS size,
    array_to_string(list_transform(list_slice(w, 1, d), lambda x: x.k), ',') AS k,
    CASE WHEN d > 0 THEN array_to_string(list_transform(list_slice(w, 1, d - 1), lambda x: x.k), ',') END AS up
  FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM f)),
n AS (
  SELECT k, d, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(size) AS size,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends
  FROM p GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS m FROM n WHERE up IS NOT NULL GROUP BY ALL),
x AS (SELECT n.*, coalesce(m, 0) AS m FROM n LEFT JOIN kids ON kids.up = n.k AND kids.d = n.d),
under AS (
  SELECT p.k, p.d, CAST(sum((x.n - 1) * x.size) AS BIGINT) AS saved, count(*) FILTER (x.m = 0) AS leaves
  FROM x JOIN p ON p.c = x.c AND p.d <= x.d GROUP BY p.k, p.d)
SELECT x.c AS conv_id, x.d AS depth, a.c AS parent_conv_id, x.n AS n_convs, x.m AS n_children, leaves AS n_leaves, saved AS saved_tokens,
  sha256(x.ends) AS ends_sha256
FROM x JOIN under USING (k, d) LEFT JOIN x a ON a.k = x.up AND a.d = x.d - 1
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


@query("op12_simhash_positions")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(list_slice(w, q, q + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS q FROM p, range(1, 5) AS ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS x, array_to_string(list_slice(w, j + 1, k), ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, j, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * cut.a) // (l.a + r.a) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inn AS (
  SELECT lang, array_to_string(list_slice(w, q, q + m - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS q FROM c, range(2, 4) AS ms(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inn USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r.r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_toivonen_phrases", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
