"""One thin query per operator: the operator on whole ``documents``, with its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, folds, jaccard_join, language, line_quality, mixing, periods, secrets, token_files, toxicity, web_quality
from .lsm_dedup import remove_repeated_passages
from .suffix_dedup import remove_repeated_substrings


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's vocabulary; only its place is kept, the file is read where texts are encoded."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir), ["doc_id"]))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rated = line_quality.rate_quality(docs, line_quality.learn(docs, labels(spark, sf_dir)), ["doc_id"])
    return rated.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_substrings(documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir), ["doc_id"])
    return out.select("row.doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.find_contamination(documents(spark, sf_dir), benchmark, ["doc_id"]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(documents(spark, sf_dir), ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language.identify(docs, language.fit(docs), ["doc_id"])
    return out.select("row.doc_id", folds.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), vocabulary())


def made_periodic(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten repeats itself from some word on, by the checksum of its doc_id; words are joined by spaces there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(made_periodic(documents(spark, sf_dir)), ["doc_id"])
    best = periods.longest("runs")
    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), (x["period"].cast("string")))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    found = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = web_quality.score_quality(docs, web_quality.learn(docs, labels(spark, sf_dir)), ["doc_id"])
    return out.select("row.doc_id", "held_out", "score", (F.col("score") >= web_quality.GOOD).cast("int").alias("predicted"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by the checksum of its number a turn is dropped, emptied, loses its stops, comes twice or is given to the user."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = (F.crc32(key.cast("binary")) % 20).cast("int")
    text = F.coalesce("text", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = conversations.repair(damaged(rows))
    report, texts = repaired.report.withColumnRenamed("conv_id", "c1"), conversations.digest(repaired.turns).withColumnRenamed("conv_id", "c2")
    all_ids = rows.select("conv_id").distinct()
    out = all_ids.join(report, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_mixing": op6_mixing,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_language_id": op8_language_id,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_token_output": op10_token_output,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_conversation_repair": op13_conversation_repair,
    }


# ---------------------------------------------------------------- SQL, where a whole result can be said in it

_LOWER = "TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text in order, by the characters between them.
_BETWEEN_SPACES = "COALESCE(REGEXP_EXTRACT_ALL({text}, '[^\\x20\\x09-\\x0D]+'), [])"
_ALPHANUMERIC = "COALESCE(REGEXP_EXTRACT_ALL({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


def _documents_sql(words: str, text: str) -> str:
    return f"d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, {words.format(text=text)} AS w FROM documents)"


#: Every string of 200 bytes, as hexadecimal digits, by way of pieces of 1,000 bytes that overlap; runs of those that occur again.
_OP3 = """WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, LOWER(HEX(ENCODE(COALESCE(text, '')))) AS x FROM documents),
c AS (SELECT r, b, SUBSTR(x, 2000 * b + 1, 2398) AS y FROM d, UNNEST(RANGE(0, CAST(LEN(x) // 2000 + 1 AS BIGINT))) u(b)),
s AS (SELECT r, 1000 * b + i AS i, MD5(SUBSTR(y, 2 * i + 1, 400)) AS h FROM c, UNNEST(RANGE(0, LEAST(1000, CAST(LEN(y) // 2 - 199 AS BIGINT)))) u(i)),
m AS (SELECT h FROM s GROUP BY h HAVING COUNT(*) > 1),
o AS (SELECT r, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s SEMI JOIN m USING (h)),
q AS (SELECT r, i, SUM(new) OVER (PARTITION BY r ORDER BY i) AS run FROM o),
v AS (SELECT r, MIN(i) AS lo, MAX(i) + 200 AS hi FROM q GROUP BY r, run),
y AS (SELECT r, lo, hi, COALESCE(LAG(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prev FROM v),
k AS (SELECT y.r, COUNT(*) AS n_spans, SUM(hi - lo) AS n_removed, STRING_AGG(SUBSTR(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS head, MAX(hi) AS tail FROM y JOIN d USING (r) GROUP BY y.r)
SELECT doc_id, CAST(LEN(x) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, COALESCE(n_spans, 0) AS n_spans, SHA256(FROM_HEX(COALESCE(head || SUBSTR(x, 2 * tail + 1), x))) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_OP5 = f"""WITH {_documents_sql(_ALPHANUMERIC, _LOWER)},
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALPHANUMERIC.format(text=_LOWER)} AS w FROM benchmark),
n AS (SELECT item, w, LEAST(LEN(w), 10) AS n FROM b WHERE LEN(w) > 0),
i AS (SELECT DISTINCT item, n, MD5(ARRAY_TO_STRING(w[i:i + n - 1], ' ')) AS h FROM n, UNNEST(RANGE(1, LEN(w) - n + 2)) u(i)),
s AS (SELECT r, i, z.n, MD5(ARRAY_TO_STRING(w[i:i + z.n - 1], ' ')) AS h FROM d, (SELECT DISTINCT n FROM i) z, UNNEST(RANGE(1, LEN(w) - z.n + 2)) u(i)),
x AS (SELECT s.r, s.i, s.n, i.item FROM s JOIN i USING (n, h)),
g AS (SELECT r, COUNT(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM x), UNNEST(RANGE(0, n)) t(k) GROUP BY r),
t AS (SELECT r, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM x) GROUP BY r)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN g USING (r) LEFT JOIN t USING (r)"""

_OP7 = f"""WITH {_documents_sql(_BETWEEN_SPACES, "text")},
s AS (SELECT r, i, MD5(ARRAY_TO_STRING(w[i:i + 34], ' ')) AS h FROM d, UNNEST(RANGE(1, LEN(w) - 33)) u(i)),
m AS (SELECT h FROM s GROUP BY h HAVING COUNT(*) > 1),
g AS (SELECT DISTINCT r, i + k AS j FROM s SEMI JOIN m USING (h), RANGE(35) t(k)),
p AS (SELECT r, j, w[j] AS word FROM d, UNNEST(RANGE(1, LEN(w) + 1)) u(j)),
k AS (SELECT p.r, COUNT(g.j) AS n_removed, STRING_AGG(word, ' ' ORDER BY p.j) FILTER (WHERE g.j IS NULL) AS kept FROM p LEFT JOIN g ON p.r = g.r AND p.j = g.j GROUP BY p.r)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed, SHA256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

_OP9 = f"""WITH RECURSIVE {_documents_sql(_BETWEEN_SPACES, _LOWER)},
s AS (SELECT DISTINCT r, MD5(ARRAY_TO_STRING(w[i:i + LEAST(LEN(w), 5) - 1], ' ')) AS h FROM d, UNNEST(RANGE(1, LEN(w) - LEAST(LEN(w), 5) + 2)) u(i) WHERE LEN(w) > 0),
n AS (SELECT r, COUNT(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, COUNT(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(r, q) AS (SELECT r, r FROM d UNION SELECT e.y, c.q FROM c JOIN e ON e.x = c.r),
f AS (SELECT c.r, MIN(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.q GROUP BY c.r)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN f USING (r)"""



def _crc32_sql(text: str) -> str:
    """The checksum bit by bit: each byte comes in, then eight shifts (-1)."""
    steps = f"LIST_CONCAT([CAST(4294967295 AS BIGINT)], FLATTEN(LIST_TRANSFORM(STRING_SPLIT({text}, ''), LAMBDA x: [CAST(ASCII(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"XOR(LIST_REDUCE({steps}, LAMBDA c, x: CASE WHEN x >= 0 THEN XOR(c, x) WHEN c & 1 = 1 THEN XOR(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END), CAST(4294967295 AS BIGINT))"


#: Equal runs of five words a period apart lie in a row; a row of them is a run of that period.
_OP11 = f"""WITH {_documents_sql(_BETWEEN_SPACES, "text")},
h AS (SELECT *, LEN(w) AS n, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM d),
v AS (SELECT *, h // 10 % GREATEST(n, 1) AS a, 1 + (n - h // 10 % GREATEST(n, 1)) // (3 + h // 10 % 8) AS p FROM h),
e AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN LIST_TRANSFORM(RANGE(0, n), LAMBDA i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM v),
g AS (SELECT r, n, i, MD5(ARRAY_TO_STRING(w[i + 1:i + 5], ' ')) AS h FROM e, UNNEST(RANGE(0, n - 4)) u(i)),
x AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.h = b.h AND b.i > a.i AND b.i - a.i <= a.n // 4),
y AS (SELECT r, i, q, i - ROW_NUMBER() OVER (PARTITION BY r, q ORDER BY i) AS part FROM x),
z AS (SELECT r, MIN(i) AS start, MAX(i) - MIN(i) + 5 + q AS length, q FROM y GROUP BY r, q, part),
t AS (SELECT r, start, length, MIN(q) AS period FROM z WHERE length >= GREATEST(6, 4 * q) GROUP BY r, start, length),
o AS (SELECT r, COUNT(*) AS n_runs, STRING_AGG(start || ',' || length || ',' || period || CHR(10), '' ORDER BY start, period) AS listed FROM t GROUP BY r),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM t),
k AS (SELECT DISTINCT r, UNNEST(RANGE(start + period, start + length)) AS i FROM t),
c AS (SELECT l.r, STRING_AGG(word, ' ' ORDER BY l.i) AS kept FROM (SELECT r, UNNEST(RANGE(0, n)) AS i, UNNEST(w) AS word FROM e) l LEFT JOIN k ON k.r = l.r AND k.i = l.i WHERE k.i IS NULL GROUP BY l.r)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, SHA256(COALESCE(listed, '')) AS runs_sha256, SHA256(COALESCE(kept, '')) AS collapsed_sha256 FROM e LEFT JOIN o USING (r) LEFT JOIN c USING (r) LEFT JOIN b ON b.r = e.r AND b.place = 1"""


def _edited(state: str, cost: str, letter: str) -> str:
    """A state, its cost in six digits and then its audit, after one more edit."""
    return f"LPAD(CAST(CAST(LEFT({state}, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') || SUBSTR({state}, 7) || '{letter}'"


#: The states b, m, u, a: nothing yet, after a system turn, after a user, after an assistant; one turn a step.
_OP13 = f"""WITH RECURSIVE f AS (SELECT *, {_crc32_sql("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE COALESCE(role, ' ') END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN REGEXP_REPLACE(COALESCE(text, ' '), '[.!?]', '', 'g') ELSE COALESCE(text, ' ') END AS text FROM f, UNNEST(RANGE(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, LEFT(role, 1) AS c, RIGHT(REGEXP_REPLACE(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS last FROM x),
r AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, LAG(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM o),
s AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank, COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated, COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, MAX(i) AS n FROM r GROUP BY conv_id),
z(conv_id, i, b, m, u, a) AS (
SELECT conv_id, CAST(0 AS BIGINT), '000000', CAST(NULL AS VARCHAR), '000003I', '000006II' FROM s UNION ALL
SELECT conv_id, i, b, m, LEAST(u, {_edited("a", "3", "I")}), a FROM (
SELECT conv_id, i, b, m, u, LEAST(a, {_edited("u", "3", "I")}) AS a FROM (
SELECT conv_id, i, b, m, LEAST(u, {_edited("b", "3", "I")}, {_edited("m", "3", "I")}, {_edited("a", "3", "I")}) AS u, a FROM (
SELECT z.conv_id, r.i, {_edited("b", "4", "D")} AS b,
LEAST({_edited("m", "4", "D")}, CASE WHEN c = 's' AND fault NOT IN ('blank', 'duplicate') THEN {_edited("b", "IF(fault = 'truncated', 3, 0)", "K")} END) AS m,
LEAST({_edited("u", "4", "D")}, CASE WHEN c = 'u' AND fault NOT IN ('blank', 'duplicate') THEN {_edited("LEAST(b, m, a)", "IF(fault = 'truncated', 3, 0)", "K")} END, CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_edited("LEAST(b, m, a)", "IF(fault = 'truncated', 6, 3)", "R")} END) AS u,
LEAST({_edited("a", "4", "D")}, CASE WHEN c = 'a' AND fault NOT IN ('blank', 'duplicate') THEN {_edited("u", "IF(fault = 'truncated', 3, 0)", "K")} END, CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_edited("u", "IF(fault = 'truncated', 6, 3)", "R")} END) AS a
FROM z JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.i = z.i + 1)))),
y AS (SELECT s.conv_id, LEAST(b, a) AS best FROM z JOIN s ON s.conv_id IS NOT DISTINCT FROM z.conv_id AND s.n = z.i),
l AS (SELECT conv_id, p, SUBSTR(best, p + 6, 1) AS e FROM y, UNNEST(RANGE(1, LEN(best) - 5)) t(p)),
k AS (SELECT *, COUNT(*) FILTER (WHERE e <> 'I') OVER w AS i, COUNT(*) FILTER (WHERE e <> 'D') OVER w AS j FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
t AS (SELECT k.*, r.role, r.text, r.c, MAX(IF(j = 1 AND e = 'K' AND c = 's', 1, 0)) OVER (PARTITION BY k.conv_id) AS begun FROM k LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = k.i),
q AS (SELECT conv_id, STRING_AGG(CASE WHEN e = 'K' THEN role WHEN (j - begun) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, CHR(10) ORDER BY p) AS repaired FROM t WHERE e <> 'D' GROUP BY conv_id)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(COALESCE(LEFT(best, 6), '0') AS BIGINT) AS cost, COALESCE(SUBSTR(best, 7), '') AS audit, SHA256(COALESCE(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the results that can be said in it whole; the others are tested in other ways."""
    return {"op3_suffix_array_dedup": _OP3, "op5_benchmark_decontamination": _OP5, "op7_substring_dedup": _OP7, "op9_ngram_jaccard_join": _OP9, "op11_periodic_runs": _OP11, "op13_conversation_repair": _OP13}
