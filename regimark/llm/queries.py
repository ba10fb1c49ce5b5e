"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .cdc_dedup import dedup_chunks
from .common import ascii_lower, default_path, read_table
from .decontaminate import leaks
from .importance import resample
from .license_scan import COPYRIGHT_LINE, COPYRIGHT_NAMES, LICENSES, PHRASES, SPELLINGS, license_scan
from .line_dedup import dedup_lines
from .merkle import manifest
from .minhash_dedup import near_duplicates
from .piece_bpe import piece_encode
from .quality_fm import fit_quality, held_out, score_quality
from .quality_rules import quality_rules
from .suffix_dedup import dedup_substrings
from .url_filter import DEFAULT_PATTERNS, url_rules, url_verdicts


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), with_ids=False)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"), url_rules())


_SPAM = "|".join("[^a-z0-9]+".join(r.rule.split()) for r in DEFAULT_PATTERNS)
OP2_SQL = rf"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({_SPAM})([^a-z0-9]|$)') THEN 'block'
    WHEN host = '' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fit_quality(docs, read_table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return score_quality(docs, machine, metadata=("n_chars",)).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
hot AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    """By lists of words, where the operator replaces strings."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    usual = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in SPELLINGS.items())

    def words(c: str) -> str:  # of one line
        return f"list_transform(list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: CASE w {usual} ELSE w END)"

    def phrased(c: str) -> str:
        for _ in range(2):  # words in a row share the space between them, so every other one is left the first time
            for a, b in PHRASES.items():
                c = f"regexp_replace({c}, '(^| ){a}( |$)', '\\1{b}\\2', 'g')"
        return c

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in LICENSES.items())
    return f"""
WITH every AS (SELECT doc_id, NULL AS name, text AS body FROM documents UNION ALL SELECT NULL, name, body FROM (VALUES {values}) AS v(name, body)),
bare AS (SELECT row_number() OVER () AS row, doc_id, name, regexp_replace(lower(regexp_replace(coalesce(body, ''), {quoted(COPYRIGHT_NAMES)}, '', 'g')), {quoted(COPYRIGHT_LINE)}, '', 'g') AS t FROM every),
lined AS (SELECT row, doc_id, name, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM bare),
spelled AS (SELECT row, doc_id, name, pos, {phrased(f"array_to_string({words('line')}, ' ')")} AS line FROM lined),
whole AS (SELECT row, doc_id, name, sha256({phrased("coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (line <> ''), '')")}) AS digest,
  coalesce(string_agg(line, ' ') FILTER (line <> ''), '') = '' AS blank FROM spelled GROUP BY row, doc_id, name),
known AS (SELECT digest, min(name) AS name FROM whole WHERE name IS NOT NULL AND NOT blank GROUP BY digest),
noted AS (SELECT s.row, string_agg(DISTINCT k.name, '; ' ORDER BY k.name) AS notices FROM spelled s JOIN known k ON k.digest = sha256(s.line) WHERE s.name IS NULL GROUP BY s.row)
SELECT w.doc_id, w.digest AS text_digest, k.name AS license, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN noted n ON n.row = w.row WHERE w.name IS NULL
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# CRC-32 by a table that is made by the rule of its polynomial; bytes must be a list of integers.
_CRC_STEPS = "steps AS (SELECT list(v ORDER BY k) AS steps FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS k)))"
_crc = lambda bytes_: f"xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op11_sql() -> str:
    """Features as rows; each distinct one is hashed once."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = "list_concat(w, list_concat(list_transform(range(1, len(w)), lambda k: concat(w[k], ' ', w[k + 1])), list_transform(range(1, len(w) - 1), lambda k: concat(w[k], ' ', w[k + 1], ' ', w[k + 2]))))"
    return f"""
WITH {_CRC_STEPS},
docs AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
features AS (SELECT row, unnest({runs}) AS f FROM docs),
wanted AS (SELECT unnest({runs}) AS f FROM (SELECT {words} AS w FROM benchmark)),
every AS (SELECT DISTINCT f FROM (SELECT f FROM features UNION ALL SELECT f FROM wanted)),
hexed AS (SELECT f, hex(encode(f)) AS x FROM every),
buckets AS (SELECT f, {_crc("list_transform(range(len(x) // 2), lambda k: CAST(concat('0x', x[2 * k + 1:2 * k + 2]) AS BIGINT))")} % 10000 AS bucket FROM hexed, steps),
s AS (SELECT bucket, count(*) AS s FROM features JOIN buckets USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (f) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM features JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT row, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN sums USING (row)),
fit AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN fit USING (row)
"""


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encode(read_table(spark, sf_dir, "documents"), default_path("piece_bpe_32k.model"), with_ids=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(read_table(spark, sf_dir, "documents"), now={"text": F.when(changed, ascii_lower(F.col("text"))).otherwise(F.col("text"))})


def _op13_sql(levels: int = 7, top_levels: int = 4) -> str:
    """Levels one after another, as many as the tables may need: 8 ** 7 rows of a language, 8 ** 4 languages."""
    field = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + "))"

    def tree(name: str, keys: str, n: int) -> list[str]:
        own = f"{keys}, " if keys else ""
        return [f"{name}{k + 1} AS (SELECT {own}i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {own}i // 8, n)" for k in range(n)]

    def beside(name: str, keys: str, n: int) -> list[str]:
        w = f"PARTITION BY {keys + ', ' if keys else ''}i // 8 ORDER BY i ROWS BETWEEN"
        side = lambda frame: f"coalesce(string_agg(h, '') OVER ({w} {frame}), '')"
        return [f"{name}s{k} AS (SELECT *, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})" for k in range(n)]

    steps = [("g", f"g.lang IS NOT DISTINCT FROM p.lang AND g.i = p.i // {8**k}", f"gs{k} g") for k in range(levels)] + [("g", f"g.i = p.t // {8**k}", f"ts{k} g") for k in range(top_levels)]
    folds = [f"p{k + 1} AS (SELECT p.doc_id, p.lang, p.i, p.t, p.leaf, concat(p.proof, g.l, g.r) AS proof, CASE WHEN g.n > 1 THEN sha256(concat(g.l, p.f, g.r)) ELSE p.f END AS f FROM p{k} p JOIN {table} ON {on})" for k, (_, on, table) in enumerate(steps)]
    parts = [
        _CRC_STEPS,
        f"docs AS (SELECT d.*, {_crc('list_transform(string_split(CAST(doc_id AS VARCHAR), $$$$), lambda x: CAST(ascii(x) AS BIGINT))')} AS crc FROM documents d, steps)",
        f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(f'translate(text, {_LOW})')} ELSE {leaf('text')} END AS now FROM docs)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        "g0 AS (SELECT lang, i, n, leaf AS h FROM placed)", *tree("g", "lang", levels), *beside("g", "lang", levels),
        f"t0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM g{levels})", *tree("t", "", top_levels), *beside("t", "", top_levels),
        "p0 AS (SELECT doc_id, placed.lang, placed.i, t0.i AS t, leaf, '' AS proof, now AS f FROM placed JOIN t0 ON t0.lang IS NOT DISTINCT FROM placed.lang)", *folds,
    ]
    last = f"p{levels + top_levels}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT p.doc_id, p.leaf, t0.h AS subroot, root.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = root.h AS verified FROM {last} p JOIN t0 ON t0.i = p.t CROSS JOIN t{top_levels} root"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_url_filter": op2_url_filter,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filter": OP2_SQL, "op4_line_dedup": OP4_SQL, "op8_license_scan": _op8_sql(), "op11_importance_resampling": _op11_sql(), "op13_merkle_manifest": _op13_sql()}
