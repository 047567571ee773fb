"""The registered queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import bpe, decontaminate, langid, licenses, quality, sharding, simhash, substrings, toxicity, urls
from chronotext.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of_documents(read(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), path or tokenizer_file())
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "base_failed", "kept")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


#: A repeat of n words or more covers what windows of n words found twice or more cover; one of over 50 has a window of 51.
OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, k, i, md5(array_to_string(w[i:i+k-1], ' ')) AS h FROM d, (VALUES (5), (10), (51)) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS u(i) WHERE len(w) >= k),
twice AS (SELECT doc_id, k, unnest(list(i)) AS i FROM win GROUP BY doc_id, k, h HAVING count(*) > 1),
hit AS (SELECT doc_id, k, count(DISTINCT i + j) AS n FROM twice, range(51) AS r(j) WHERE j < k GROUP BY doc_id, k),
got AS (SELECT doc_id, coalesce(max(n) FILTER (k = 5), 0) AS n5, coalesce(max(n) FILTER (k = 10), 0) AS n10, coalesce(max(n) FILTER (k = 51), 0) AS n51 FROM hit GROUP BY doc_id),
line AS (SELECT doc_id, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
row AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, CAST(coalesce(n5, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n10, 0) AS BIGINT) AS covered_words, coalesce(n51, 0) AS n51
  FROM d LEFT JOIN got USING (doc_id) LEFT JOIN line USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed, NOT base_failed AND 5 * covered_words <= n_words AND n51 = 0 AS kept FROM base
"""


def _template_pattern(template: str) -> str:
    """A template as a regular expression over words with a space before, between and after them."""
    out, at = " ", 0
    while at < len(template):
        if template[at] in "[]":
            out, at = out + {"[": "(?:", "]": ")?"}[template[at]], at + 1
        elif template[at] == "{":
            inside, at = template[at + 1 : template.index("}", at)], template.index("}", at) + 1
            out += f"(?:[^ ]+ ){{0,{inside}}}" if inside.isdigit() else "(?:" + "|".join(_words_pattern(x) for x in inside.split("|")) + ")"
        else:
            stop = re.compile(r"[\[\]{]|$").search(template, at).start()
            out, at = out + _words_pattern(template[at:stop]), stop
    return out


def _words_pattern(text: str) -> str:
    return "".join(f"{w} " for w in re.findall("[a-z0-9]+", text.lower()))


def licenses_sql() -> str:
    """The base scan word by word; templates as regular expressions instead of automata. Its first_word and last_word have nulls, which
    engines carry in different types, so tests compare it and the registry leaves it out."""
    base = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}')) - 1 AS i, '{label}' AS label FROM d WHERE f LIKE '% {p} %'" for p, label in licenses.BASE.items()
    )
    method = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM d WHERE regexp_matches(f, '{_template_pattern(t)}')" for label, t in licenses.TEMPLATES)
    return f"""
WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS f FROM s),
place AS ({base}), found AS ({method}),
b AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(own) AS own FROM (SELECT doc_id, label, 0 AS own FROM place UNION ALL SELECT doc_id, label, 1 FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN own = 1 THEN CAST(1 AS DOUBLE) WHEN n > 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


#: Words of a text; DuckDB splits at the same six characters.
OP7_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i) WHERE len(w) >= 50),
src AS (SELECT h, min(doc_id) AS s FROM win GROUP BY h),
dup AS (SELECT win.doc_id, win.i FROM win JOIN src USING (h) WHERE win.doc_id > src.s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(50) AS r(j)),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, CASE WHEN ps IS NULL THEN w ELSE (SELECT coalesce(list(x ORDER BY k), []) FROM (SELECT unnest(w) AS x, unnest(generate_series(1, len(w))) AS k) WHERE NOT list_contains(ps, k)) END AS kw
  FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kw) AS BIGINT) AS n_removed, sha256(array_to_string(kw, ' ')) AS kept_sha256 FROM kept
"""


#: No seeds and no masks: equal tokens are joined on their diagonal, and every window of it counts its own.
OP9_SQL = """
WITH tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS h
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
itok AS (SELECT item_id, list_filter(regexp_split_to_array(lower_az, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS h
  FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)),
dpos AS (SELECT doc_id, unnest(h) AS t, unnest(generate_series(1, len(h))) AS p FROM tok WHERE len(h) >= 6),
ipos AS (SELECT item_id, least(15, len(h)) AS w, len(h) AS n, unnest(h) AS t, unnest(generate_series(1, len(h))) AS q FROM itok WHERE len(h) >= 6),
same AS (SELECT doc_id, item_id, w, n, p - q AS diag, q FROM dpos JOIN ipos USING (t)),
-- A window holds 0.8 equal tokens only on diagonals that have so many at all.
rich AS (SELECT doc_id, item_id, diag FROM same GROUP BY doc_id, item_id, diag, w HAVING count(*) * 5 >= w * 4),
win AS (SELECT doc_id, item_id, w, diag, unnest(generate_series(greatest(1, q - w + 1), least(q, n - w + 1))) AS i FROM same JOIN rich USING (doc_id, item_id, diag)),
cmp AS (SELECT doc_id, item_id, w, diag + i - 1 AS f, count(*) AS eq FROM win GROUP BY doc_id, item_id, w, diag, i)
SELECT doc_id, item_id, max(eq / w) AS similarity, CAST(min(f) AS BIGINT) AS first_word, CAST(max(f + w - 1) AS BIGINT) AS last_word
FROM cmp WHERE eq * 5 >= w * 4 GROUP BY doc_id, item_id
"""


#: Thirty bits are enough for these tables: every depth's sums at once, then the least depth that fits.
OP10_SQL = """
WITH rows AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h FROM documents),
deep AS (SELECT doc_id, bytes, h, d, h >> (60 - d) AS p FROM rows, range(0, 31) AS r(d)),
sums AS (SELECT d, p, sum(bytes) AS b, count(*) AS n FROM deep GROUP BY d, p),
fit AS (SELECT d, p, b, n FROM sums WHERE b <= 2097152 OR n = 1),
best AS (SELECT doc_id, bytes, h, min(d) AS depth FROM deep JOIN fit USING (d, p) GROUP BY doc_id, bytes, h)
SELECT doc_id, bytes, 's' || CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  CAST(fit.b AS BIGINT) AS shard_bytes, CAST(fit.n AS BIGINT) AS shard_rows
FROM best JOIN fit ON fit.d = best.depth AND fit.p = best.h >> (60 - best.depth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op9_decontamination": OP9_SQL, "op10_sharding": OP10_SQL}
