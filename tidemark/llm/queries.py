"""The queries of this subpackage, by name, and SQL for those that SQL can express. Where an operator's method has no SQL
form, what SQL can say of its result is a query of its own: sizes, counts, laws and targets, of the same rows."""

from pyspark.sql import functions as F

from .decontaminate import op3_decontaminate
from .exact_dedup import ORACLE, op4_exact_dedup
from .html_text import op8_html_text
from .license_scan import op1_license_scan
from .mixing import op6_mixing
from .near_dedup import op9_near_dedup
from .sharding import op2_sharding
from .token_counts import op7_token_counts
from .token_files import op5_token_files
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_sharding, op3_decontaminate, op4_exact_dedup, op5_token_files, op6_mixing, op7_token_counts, op8_html_text, op9_near_dedup, op10_toxicity)}
ORACLES = {"op4_exact_dedup": ORACLE}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLACES = " + ".join(f"(length(w) - length(replace(w, '{p}', ''))) // {len(p)}" for p in ("<under><the><mit><license>", "<apache><license><version><2>", "<cc><by><nc>"))


def law(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@law("license_base_places", f"""WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents),
u AS (SELECT doc_id, len(l) AS n_words, array_to_string(list_transform(l, lambda x: '<' || x || '>'), '') AS w FROM t)
SELECT doc_id, n_words, CAST({_PLACES} AS BIGINT) AS n_base FROM u""")
def license_base_places(spark, sf_dir: str):
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base")


@law("sharding_sizes", "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, 'rows' AS law FROM documents")
def sharding_sizes(spark, sf_dir: str):
    return op2_sharding(spark, sf_dir).select("doc_id", "size", "law")


@law("sharding_slots", """WITH s AS (SELECT CAST(range AS INTEGER) AS shard FROM range(24)), n AS (SELECT count(*) AS n FROM documents),
c AS (SELECT shard, n // 24 + CASE WHEN shard < n % 24 THEN 1 ELSE 0 END AS rows FROM s, n)
SELECT shard, rows, CAST(0 AS BIGINT) AS first_slot, rows - 1 AS last_slot, rows AS slots FROM c WHERE rows > 0""")
def sharding_slots(spark, sf_dir: str):
    made = op2_sharding(spark, sf_dir).groupBy("shard")
    return made.agg(F.count(F.lit(1)).alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("slots"))


@law("mixing_targets", """WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM t GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3.0 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
x AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1)
SELECT t.doc_id, t.size, l.source_size, round(CAST(least(l.cap, coalesce((SELECT level FROM x), CAST('inf' AS DOUBLE)) * l.weight) AS DOUBLE), 3) AS target FROM t JOIN l ON t.source IS NOT DISTINCT FROM l.source""")
def mixing_targets(spark, sf_dir: str):
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))
