"""The registered queries over the text tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from barweave.llm import (
    ann,
    exact_dedup,
    mixing,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    resampling,
    secrets,
    sharding,
    token_counts,
    token_pack,
    toxicity,
)
from barweave.llm.common import scratch_path, table, text_or_empty, tokenizer_path


def op1_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"))


def op2_bit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = scratch_path(spark, "packed")
    token_pack.write_packed(table(spark, folder, "documents"), packed, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_pack.read_documents(spark, packed)


def op3_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.duplicate_classes(table(spark, folder, "documents"))


def op5_minimum_slack(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the tokens that the written sequences hold."""
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids="bytes")
    packed.drop("ids_crc32").write.parquet(out := scratch_path(spark, "sequences"))
    schema = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return spark.read.schema(schema).parquet(out).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_trigram_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    kind = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id",
        *map(kind, secrets.BASE),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("found")).alias("spans"),
    )


def op7_two_pass_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs, out = table(spark, folder, "documents"), scratch_path(spark, "shards")
    sharding.write_shards(docs, out, shards=40)  # whole records; only these columns are read back
    return sharding.read_shards(spark, out, "doc_id long, text string, size long, slot long, shard int").select(
        "doc_id",
        "size",
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_counterfactual_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.fold() == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_trie_owners(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


def op10_merge_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_sparse_table_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_bracketed_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_deobfuscated_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda s: ~s["added"])
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select(
        "doc_id",
        *map(n, range(len(pii.KINDS))),
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("found")).alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_adaptive_scan,
        op2_bit_packing,
        op3_weighted_mix,
        op4_bag_minhash,
        op5_minimum_slack,
        op6_trigram_secrets,
        op7_two_pass_shuffle,
        op8_counterfactual_toxicity,
        op9_trie_owners,
        op10_merge_counts,
        op11_sparse_table_trie,
        op12_bracketed_resampling,
        op13_deobfuscated_pii,
    )
} | {"pipeline": corpus_pipeline.run}

def _spans_sql(rule: secrets.Rule) -> str:
    """Spans of one rule: the texts between matches give the places of the matches."""
    p = rule.pattern.replace("'", "''")
    part = f"regexp_extract_all(t, '{p}', {rule.group})"
    return f"""SELECT doc_id, '{rule.kind}' AS kind, u.x.a AS a, u.x.b AS b FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
        a := list_sum(list_transform(s[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0),
        b := list_sum(list_transform(s[1:i], lambda v: length(v))) + list_sum(list_transform(m[1:i], lambda v: length(v))),
        n := length(g[i])))) AS x
      FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, {part} AS g, string_split_regex(t, '{p}') AS s FROM d
        WHERE regexp_matches(t, '{p}'))) AS u WHERE u.x.n >= {rule.least}"""


def _crc32_sql(numbers: str) -> str:
    """Unsigned crc32 of a list of byte values, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: {step}), 4294967295)"


_BYTES = "list_transform(range(0, length(hex({0})) // 2), lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS BIGINT))"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ORDER = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(secrets.RULES)) + " END"
_BASE = ", ".join(f"'{k}'" for k in secrets.BASE)
_FLAT = r"trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"

ORACLES: dict[str, str] = {
    "op3_weighted_mix": rf"""WITH f AS (SELECT doc_id, source, coalesce(text, '') AS t, {_FLAT} AS flat FROM documents),
      v AS (SELECT *, length(replace(flat, ' ', '')) AS visible, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters FROM f),
      w AS (SELECT doc_id, source, CASE WHEN flat = '' THEN 0 ELSE length(flat) - visible + 1 END AS size,
        CASE WHEN visible = 0 THEN {mixing.LEAST_QUALITY} ELSE greatest(letters / visible, {mixing.LEAST_QUALITY}) END AS q FROM v),
      k AS (SELECT *, -ln((CAST('0x' || substr(md5('11:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) / q AS k FROM w),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
        FROM k GROUP BY source),
      c AS (SELECT *, ([5, 2, 1])[r % 3 + 1] AS weight FROM s),
      o AS (SELECT *, 3 * total / weight AS ratio, (sum(total) OVER ()
          - coalesce(sum(3 * total) OVER (ORDER BY 3 * total / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * total / weight, r
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
      l AS (SELECT arg_min(level, ROW(ratio, r)) FILTER (ratio >= level) AS level FROM o),
      g AS (SELECT source, total, least(3.0::DOUBLE * total, weight * coalesce(l.level, 0)) AS target FROM c, l),
      e AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE floor(target / total) END AS epochs FROM g),
      p AS (SELECT k.*, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS rest,
          sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id) AS prefix
        FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
      n AS (SELECT *, min(abs(prefix - rest)) OVER (PARTITION BY source) AS miss FROM p),
      z AS (SELECT *, CASE WHEN miss < rest THEN min(CASE WHEN abs(prefix - rest) = miss THEN prefix END) OVER (PARTITION BY source)
        ELSE 0 END AS upto FROM n)
      SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, target,
        CAST(size * (epochs + CASE WHEN prefix <= upto THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM z""",
    "op6_trigram_secrets": f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      x AS ({" UNION ALL ".join(map(_spans_sql, secrets.RULES))}),
      y AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) AS w, {_ORDER} AS o FROM x),
      g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
        coalesce(string_agg(w, ',' ORDER BY a, o) FILTER (kind IN ({_BASE})), '') AS base, string_agg(w, ',' ORDER BY a, o) AS spans
        FROM y GROUP BY doc_id)
      SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)""",
    "op9_trie_owners": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
      k AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
      SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN k USING (t)""",
    "op11_sparse_table_trie": rf"""WITH o AS (
        SELECT conv_id, list(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))
            ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns,
          list(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
            ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS words
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
      h AS (SELECT *, {_crc32_sql(_BYTES.format("CAST(conv_id AS VARCHAR)"))} % 4 AS n FROM o),
      c AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.n], h.turns[h.n + 1:]) AS turns,
          list_concat(coalesce(b.words, [])[1:h.n], h.words[h.n + 1:]) AS words
        FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
      p AS (SELECT conv_id, d, array_to_string(turns[1:d], '') AS path, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words,
          d = len(turns) AS whole FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
      g AS MATERIALIZED (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (whole), '')) AS ends
        FROM p GROUP BY path, d),
      k AS MATERIALIZED (SELECT g.path, count(x.path) AS n_children FROM g LEFT JOIN g x ON x.d = g.d + 1 AND x.path[1:32 * g.d] = g.path GROUP BY g.path),
      b AS (SELECT g.path, a.d AS up, n_children, saved FROM g JOIN k USING (path), LATERAL (SELECT unnest(range(0, g.d + 1)) AS d) a),
      t AS (SELECT path[1:32 * up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM b GROUP BY 1)
      SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, g.n_convs, k.n_children, t.n_leaves,
        CAST(t.saved_tokens AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
      FROM g JOIN k USING (path) JOIN t USING (path) LEFT JOIN g u ON g.d > 0 AND u.path = g.path[1:32 * (g.d - 1)] AND u.d = g.d - 1""",
    "op12_bracketed_resampling": rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS f FROM documents),
      b AS MATERIALIZED (SELECT {_WORDS} AS f FROM benchmark),
      v AS MATERIALIZED (SELECT w, {_crc32_sql(_BYTES.format("w"))} % {resampling.BUCKETS} AS bucket
        FROM (SELECT unnest(f) AS w FROM d UNION SELECT unnest(f) FROM b)),
      x AS MATERIALIZED (SELECT r, bucket FROM (SELECT r, unnest(f) AS w FROM d) JOIN v USING (w)),
      s AS (SELECT bucket, count(*) AS s FROM x GROUP BY bucket),
      t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(f) AS w FROM b) JOIN v USING (w) GROUP BY bucket),
      n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS n, (SELECT coalesce(sum(t), 0) FROM t) AS m),
      g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (n + {resampling.BUCKETS})::DOUBLE
          / ((s + 1)::DOUBLE * (m + {resampling.BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
      w AS (SELECT r, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM x JOIN g USING (bucket) GROUP BY r),
      z AS (SELECT r, doc_id, CAST(len(f) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
          (CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
          / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
      e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n
        FROM z WHERE n_features >= {resampling.LEAST_WORDS})
      SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank
      FROM z LEFT JOIN e USING (r)""",
}
