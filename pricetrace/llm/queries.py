"""Registered queries of this subpackage and the SQL some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetrace.llm import exact_dedup, jaccard_join, manifest, mixing, near_dedup, neighbours, packing, pii, ranked, repeats, secret_scan, sharding, toxicity
from pricetrace.scratch import Staged
from pricetrace.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40
SPACE = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str, columns: str = "doc_id bigint, text string") -> DataFrame:
    return read_table(spark, f"{sf}/documents.parquet", columns)


@query("op2_exact_dedup", rf"""
  WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g')) AS text_sha256 FROM documents)
  SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
  FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op2_exact_dedup(spark, sf):
    table = Staged(exact_dedup.digests(documents(spark, sf), columns=("doc_id",)), "digests").df
    groups = exact_dedup.exact_groups(table, "doc_id", "_digest")
    return groups.select(
        "doc_id",
        F.col("keep_key").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_key")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


@query("op3_rendezvous_shards")
def op3_rendezvous_shards(spark, sf):
    placed = sharding.shard_table(documents(spark, sf), "doc_id", [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op10_mix_sources")
def op10_mix_sources(spark, sf):
    return mixing.mix_table(documents(spark, sf, "doc_id bigint, text string, source string"))


@query("op4_pack_windows")
def op4_pack_windows(spark, sf):
    return packing.pack(documents(spark, sf))


def toxicity_model(spark: SparkSession, sf: str, docs: DataFrame) -> toxicity.Model:
    labels = read_table(spark, f"{sf}/labels.parquet", "doc_id bigint, toxic int")
    return toxicity.fit_model(docs, labels)


@query("op9_toxicity")
def op9_toxicity(spark, sf):
    docs = documents(spark, sf)
    scored = toxicity.score(docs, toxicity_model(spark, sf, docs))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query("op5_secret_scan")
def op5_secret_scan(spark, sf):
    found = secret_scan.scan(documents(spark, sf))
    base = [rule.kind for rule in secret_scan.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(own), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op6_pii_surrogates")
def op6_pii_surrogates(spark, sf):
    return pii.replace_pii(documents(spark, sf), "surrogates of the registered query")


@query("op1_near_dedup")
def op1_near_dedup(spark, sf):
    return near_dedup.near_duplicates(documents(spark, sf), near_dedup.Forest(width=4))


@query("op8_repeated_passages")
def op8_repeated_passages(spark, sf):
    return repeats.remove_repeats(documents(spark, sf)).drop("kept")


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark, sf):
    table = read_table(spark, f"{sf}/embeddings.parquet", "vec_id bigint, embedding array<float>")
    return neighbours.nearest_neighbours(table, table.where("vec_id % 20 = 0"))


def _encoded(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(_encoded(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: Unsigned CRC-32 of an ASCII text in DuckDB: a table of 256 entries, then one step per character.
_CRC_ROUND = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC_CTES = f"""
  bits AS (SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT i, {_CRC_ROUND.format('c')}, k + 1 FROM bits WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    steps = f"list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS UBIGINT)))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, entries[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"


MANIFEST_SQL = f"""
  WITH RECURSIVE {_CRC_CTES},
  rows AS (SELECT row_number() OVER () AS id, doc_id, lang, {_leaf_sql()} AS leaf,
      CASE WHEN doc_id IS NOT NULL AND {_crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql()} END AS other
    FROM documents, crc),
  leaves AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows
    WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id)),
  low AS (SELECT lang, 0 AS level, pos, n AS width, leaf AS node FROM leaves
    UNION ALL SELECT lang, level + 1, pos // 2, (width + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
    FROM low WHERE width > 1 GROUP BY lang, level, pos // 2, width),
  subs AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE width = 1),
  high AS (SELECT 0 AS level, pos, n AS width, subroot AS node FROM subs
    UNION ALL SELECT level + 1, pos // 2, (width + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
    FROM high WHERE width > 1 GROUP BY level, pos // 2, width),
  ways AS (
    SELECT l.id, a.level AS step, (l.pos >> a.level) % 2 AS side, b.node AS sibling FROM leaves l
      JOIN low a ON a.lang IS NOT DISTINCT FROM l.lang AND a.width > 1 AND a.pos = l.pos >> a.level
      LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM l.lang AND b.level = a.level AND b.pos = xor(a.pos, 1)
    UNION ALL
    SELECT l.id, 1000 + a.level, (s.pos >> a.level) % 2, b.node FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang
      JOIN high a ON a.width > 1 AND a.pos = s.pos >> a.level
      LEFT JOIN high b ON b.level = a.level AND b.pos = xor(a.pos, 1)),
  proofs AS (SELECT id, count(*) AS length, list(struct_pack(side := side, sibling := coalesce(sibling, '')) ORDER BY step) AS steps,
      sha256(string_agg(coalesce(sibling, ''), '' ORDER BY step)) AS proof_sha256 FROM ways GROUP BY id),
  folded AS (SELECT id, 0 AS k, other AS node, coalesce(length, 0) AS length, steps FROM rows LEFT JOIN proofs USING (id)
    UNION ALL SELECT id, k + 1,
      sha256(CASE WHEN steps[k + 1].side = 1 THEN steps[k + 1].sibling || node ELSE node || steps[k + 1].sibling END), length, steps
    FROM folded WHERE k < length)
  SELECT doc_id, leaf, subroot, h.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = h.node AS verified
  FROM rows JOIN subs s ON s.lang IS NOT DISTINCT FROM rows.lang JOIN high h ON h.width = 1
    JOIN folded f ON f.id = rows.id AND f.k = f.length LEFT JOIN proofs p ON p.id = rows.id"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13_merkle_manifest(spark, sf):
    docs = documents(spark, sf, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    columns = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.expr("CAST(n_chars AS decimal(20, 0)) + 1") if name == "n_chars" else F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", manifest.digest(*columns).alias("leaf"), F.when(tampered, manifest.digest(*changed)).alias("tampered"))
    proofs = manifest.proofs(leaves, "leaf", "lang", "doc_id", ["doc_id", "tampered"])
    found = proofs.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms_sql(text: str) -> str:
    return f"unnest(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERM}'))"


RANKED_SQL = f"""
  WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
  words AS (SELECT row, {_terms_sql('text')} AS term FROM docs),
  post AS (SELECT row, term, count(*) AS tf FROM words GROUP BY row, term),
  lens AS (SELECT row, sum(tf) AS n FROM post GROUP BY row),
  total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lens),
  asked AS (SELECT DISTINCT item_id, {_terms_sql('text')} AS term FROM benchmark),
  weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM post GROUP BY term), total),
  lengths AS (SELECT row, 100 - 50 + (50 * CAST(n AS BIGINT) * docs) // length AS m FROM lens, total),
  scores AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN post USING (term) JOIN lengths USING (row) GROUP BY item_id, row),
  ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scores JOIN docs USING (row) WHERE score > 0)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark, sf):
    index = Staged(ranked.build_index(documents(spark, sf)), "index").df
    return ranked.search(index, read_table(spark, f"{sf}/benchmark.parquet", "item_id bigint, text string"), 50)


@query("op12_jaccard_join")
def op12_jaccard_join(spark, sf):
    return jaccard_join.jaccard_components(documents(spark, sf))
