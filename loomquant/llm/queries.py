"""The queries of the training-data operators and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontam, host_quality, jaccard_join, line_dedup, pii, preference_quality, secret_scan, sharding, substring_dedup
from .storage import bound_batches

Query = Callable[[SparkSession, str], DataFrame]


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])



OP1_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
k AS (SELECT *, {LOWER.format(f"trim(line, {SQL_SPACE})")} AS key FROM l),
hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (SELECT k.*, hot.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.drop("n_word_lines")



OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, p) > 1),
rep AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM twice)
  GROUP BY doc_id
), c AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_word_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CAST(word_chars < 3 * n_words OR word_chars > 10 * n_words AS INT) + CAST(10 * n_symbols > n_words AS INT)
      + CAST(10 * n_dup_lines > 3 * n_word_lines AS INT) + CAST(10 * n_repeat_words > n_words AS INT) AS soft
  FROM c
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft > 0) AS failed FROM f GROUP BY source
), m AS (SELECT sum(n) AS n, sum(failed) / sum(n) AS mean, count(*) AS hosts FROM h),
v AS (
  SELECT any_value(m.mean) AS mean, any_value(m.mean) * (1 - any_value(m.mean)) AS noise,
    sum(h.n * pow(h.failed / h.n - m.mean, 2)) / any_value(m.n)
      - any_value(m.mean) * (1 - any_value(m.mean)) * any_value(m.hosts) / any_value(m.n) AS between_hosts
  FROM h, m
), s AS (
  SELECT mean, CASE WHEN between_hosts > 0 THEN least(greatest(noise / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS k
  FROM v
), prior AS (SELECT greatest(mean * k, 1e-3) AS a, greatest((1 - mean) * k, 1e-3) AS b FROM s),
tier AS (
  SELECT source, CASE WHEN (failed + a) / (n + a + b) >= 0.5 THEN 0
    WHEN (failed + a) / (n + a + b) > 1.5 * a / (a + b) THEN 1 ELSE 2 END AS allowed
  FROM h, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND soft <= allowed AS kept
FROM f JOIN tier ON f.source IS NOT DISTINCT FROM tier.source
"""


def span_digest(found: DataFrame, kinds: tuple[str, ...], *more: str) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text; `spans` is sorted already."""

    def told(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), *more
    )


def matches_sql(kind: str, pattern: str) -> str:
    """(doc_id, kind, a, b, m): leftmost non-overlapping matches with code point offsets."""
    whole = f"'(?s)(.*?)(?:({pattern})|\\z)'"
    return f"""
  SELECT doc_id, '{kind}' AS kind, a, a + length(m) AS b, m FROM (
    SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(pre[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), {whole}, 1) AS pre,
        regexp_extract_all(coalesce(text, ''), {whole}, 2) AS ms FROM documents)))
  WHERE m <> ''"""


def spans_sql(found: str, base: tuple[str, ...], added: tuple[str, ...], scores: str = "") -> str:
    """The digest columns from rows (doc_id, kind, a, b) of the CTEs in `found` (the last one is named s)."""
    kinds = (*base, *added)
    names = ", ".join(f"'{k}'" for k in base)
    place = f"list_position([{', '.join(repr(k) for k in kinds)}], kind)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""
WITH {found}
SELECT doc_id, {', '.join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in base)},
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(all_spans, '') AS spans{", coalesce(scores, '') AS scores" if scores else ""}
FROM documents LEFT JOIN (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, {place}, b) FILTER (kind IN ({names})) AS base_spans,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, {place}, b) AS all_spans
    {f", string_agg({scores}, ',' ORDER BY a, {place}, b) AS scores" if scores else ""}
  FROM s GROUP BY doc_id) USING (doc_id)
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.RULES
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform("spans", lambda s: F.struct(F.get(kinds, s["kind"]).alias("kind"), s["start"], s["end"]))
    return span_digest(found.select("doc_id", named.alias("spans")), tuple(r.kind for r in secret_scan.BASE_RULES))


def secret_sql(rule: secret_scan.Rule) -> str:
    """(doc_id, kind, a, b) of one rule's spans."""
    whole = "'" + f"(?s)(.*?)(?:({rule.lead})({rule.value})|\\z)".replace("'", "''") + "'"
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    parts = ", ".join(
        f"regexp_extract_all(coalesce(text, ''), {whole}, {g}) AS {n}" for g, n in ((1, "gap"), (2, "ld"), (3, "val"))
    )
    return f"""
  SELECT doc_id, '{rule.kind}' AS kind, a, a + length(ld[i]) + length(val[i]) AS b FROM (
    SELECT doc_id, ld, val, i, CAST({total.format("gap[1:i]")} + {total.format("ld[1:i - 1]")}
      + {total.format("val[1:i - 1]")} AS BIGINT) AS a
    FROM (SELECT *, unnest(range(1, len(val) + 1)) AS i FROM (SELECT doc_id, {parts} FROM documents)))
  WHERE length(val[i]) >= {rule.least}"""


OP5_SQL = spans_sql(
    "s AS (" + " UNION ALL ".join(secret_sql(r) for r in secret_scan.RULES) + ")",
    tuple(r.kind for r in secret_scan.BASE_RULES),
    tuple(r.kind for r in secret_scan.ADDED_RULES),
)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), keep=["doc_id"])


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), later AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM later),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) e
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = e.doc_id AND g.j = e.j)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    scores = F.transform("spans", lambda s: F.format_string("%.1f", s["score"]))
    return span_digest(found.withColumn("scores", F.concat_ws(",", scores)), pii.BASE_KINDS, "scores")


def pii_score_sql() -> str:
    """The score of a span of `s`, in tenths, from its kind and the words `around` it."""
    start = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pii.START.items())
    near = " ".join(
        f"WHEN '{k}' THEN regexp_matches(around, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(w.split())})([^\\p{{L}}\\p{{N}}_]|$)')"
        for k, w in pii.NEARBY.items()
    )
    fours = "kind = 'iban' AND regexp_full_match(m, '[A-Z0-9]{4}( [A-Z0-9]{4})+( [A-Z0-9]{1,3})?')"
    return f"""least({pii.MOST}, CASE kind {start} END + CASE WHEN CASE kind {near} END THEN {pii.BOOST} ELSE 0 END
    + CASE WHEN {fours} THEN {pii.GROUPED} ELSE 0 END)"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
OP7_SQL = spans_sql(
    rf"""e AS ({matches_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}),
i AS ({matches_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")}),
c AS ({matches_sql("card", r"[0-9](?:[\x20-]?[0-9])+")}),
p AS ({matches_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}),
b AS ({matches_sql("iban", r"\b[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}\b")}),
n AS ({matches_sql("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")}),
cut AS (SELECT doc_id, kind, a, a + size AS b, replace(m[1:size], ' ', '') AS m FROM (
  SELECT *, unnest(range(15, length(m) + 1)) AS size FROM b) WHERE size = length(m) OR m[size + 1] = ' '),
good AS (SELECT doc_id, kind, a, max(b) AS b FROM cut WHERE length(m) BETWEEN 15 AND 34 AND list_reduce(
  list_prepend(0, list_transform(string_split(m[5:] || m[1:4], ''),
    lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)),
  lambda t, v: (t * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1 GROUP BY doc_id, kind, a),
valid AS (
  SELECT doc_id, kind, a, b FROM e UNION ALL
  SELECT doc_id, kind, a, b FROM i WHERE len(list_filter(string_split(m, '.'),
    lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 0) > 255)) = 0 UNION ALL
  SELECT doc_id, kind, a, b FROM c WHERE length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(
    string_split(reverse({DIGITS}), ''), lambda x, k: CASE WHEN k % 2 = 1 THEN CAST(x AS INT)
      WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0 UNION ALL
  SELECT doc_id, kind, a, b FROM p WHERE length({DIGITS}) BETWEEN 9 AND 15 UNION ALL
  SELECT doc_id, kind, a, b FROM good UNION ALL
  SELECT doc_id, kind, a, b FROM n WHERE m[1:3] NOT IN ('000', '666') AND m[1:3] < '900' AND m[5:6] <> '00'
    AND m[8:11] <> '0000'
), near AS (
  SELECT v.*, substring(text, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS m,
    {LOWER.format("substring(text, greatest(a - 48, 0) + 1, a - greatest(a - 48, 0)) || ' ' || substring(text, b + 1, 48)")} AS around
  FROM valid v JOIN documents USING (doc_id)
), scored AS (SELECT *, {pii_score_sql()} AS score FROM near),
s AS (SELECT * FROM scored WHERE score >= {pii.MIN_SCORE} OR kind IN ({", ".join(f"'{k}'" for k in pii.BASE_KINDS)}))""",
    pii.BASE_KINDS,
    ("iban", "ssn"),
    "printf('%.1f', score / 10.0)",
)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ways AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ways JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = preference_quality.fit_ranker(docs, table(spark, sf_dir, "labels"))
    scored = preference_quality.score_documents(docs, ranker, keep=["doc_id"])
    return scored.select(
        "doc_id",
        preference_quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= ranker.cut).cast("int").alias("predicted"),
    )


def tokenizer() -> byte_bpe.Vocabulary:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), tokenizer(), keep=["doc_id"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT k FROM phrases), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lens WHERE len(w) >= k)
), hits AS (SELECT doc_id, g.k, i, item_id FROM grams g JOIN phrases USING (p, k)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM (SELECT DISTINCT doc_id, k, i FROM hits)),
n AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_host_quality": op4_host_quality,
    "op5_secret_scan": op5_secret_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_preference_quality": op8_preference_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_jaccard_join": OP2_SQL,
    "op4_host_quality": OP4_SQL,
    "op5_secret_scan": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_pii": OP7_SQL,
    "op10_decontaminate": OP10_SQL,
}
