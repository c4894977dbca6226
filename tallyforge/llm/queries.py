"""The registered queries of this subpackage, each over its whole tables, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster
from .chat import format_conversations, read_back
from .common import held_out, table, texts
from .counting import apply_edits, build_trees, drill_edits
from .decontaminate import contamination
from .heldout_lm import cross_entropy_difference
from .merkle import manifest
from .mixing import mixture
from .quality import fit as fit_quality
from .quality import quality_scores
from .sharding import shard_plan
from .simhash import simhash_components
from .suffixes import cuts, text_keys
from .toxicity import fit as fit_toxicity
from .toxicity import toxicity
from .vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(table(spark, sf_dir, "documents"), n_shards=40)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, list_slice(w, i, i + least(len(w), 10) - 1) AS win
        FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
heads AS (SELECT DISTINCT m, win[1] AS head FROM win),
pos AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
cand AS (SELECT doc_id, i, heads.m, list_slice(w, i, i + heads.m - 1) AS win FROM pos JOIN heads ON word = head WHERE i + heads.m - 1 <= len(w)),
hit AS (SELECT doc_id, i, cand.m, item FROM cand JOIN win USING (m, win)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(generate_series(0, m - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLES["op9_mixing"] = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM per),
bounds AS (SELECT *, source_size * CAST(2 AS DOUBLE) AS most, source_size * CAST(2 AS DOUBLE) / w AS ratio FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
           FROM bounds WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT max(level) FILTER (level <= ratio) AS level FROM levels),
target AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM final) * w, most)) AS target FROM levels),
cells AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS cell,
          coalesce(CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:4] AS BIGINT) % 64, 0) AS slice FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell DESC, slice, size DESC, doc_id) AS k FROM cells),
shifted AS (SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r,
            CAST('0x' || md5('0|' || coalesce(ranked.source, ''))[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u
            FROM ranked JOIN target ON ranked.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target, CAST((floor(k * r + u) - floor((k - 1) * r + u)) * size AS BIGINT) AS taken FROM shifted
"""


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", "toxic"))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "quality"))
    return quality_scores(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled good; background: all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return cross_entropy_difference(docs, labels.where("quality = 1").select("doc_id"))


_CLASH = "\\### Assistant: </turn> ok"


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CLASH).alias("text"))
    back = read_back(format_conversations(turns.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


# a text is written escaped only where it holds the end mark; the role names of the tables need no escape
ORACLES["op6_chat_format"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
w AS (SELECT *, 13 + length(role) + CASE WHEN contains(text, '</turn>') THEN 2 + length(replace(replace(text, '\\', '\\b'), '<', '\\l')) ELSE 1 + length(text) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


@query
def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after the same four kinds of edit, the second count from the edited tree."""
    trees = build_trees(texts(table(spark, sf_dir, "documents"))).withColumn("__edits", drill_edits(F.col("text"), F.col("doc_id")))
    after = apply_edits(trees.withColumn("n_tokens", F.col("__n_tokens")))
    return after.select("doc_id", "n_tokens", F.col("__n_tokens").alias("n_tokens_edited"), F.col("__n_pieces").alias("n_pieces"), F.col("__n_encoded").alias("n_encoded"))


# every pair is compared
ORACLES["op7_embedding_neardup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _merkle_sql(source_levels: int = 5, upper_levels: int = 3) -> str:
    """The trees level by level; enough levels for a million rows a source and 4,096 sources."""

    def leaf(text: str) -> str:
        fields = [*(f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")), text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    def climb(t: str, key: str, levels: int) -> str:
        ctes = ""
        for k in range(levels):
            ctes += f"""
{t}_run{k} AS (SELECT {key}, idx // 16 AS idx, (n + 15) // 16 AS n, list(digest ORDER BY idx) AS ds FROM {t}{k} WHERE n > 1 GROUP BY ALL),
{t}{k + 1} AS (SELECT {key}, idx, n, sha256(array_to_string(ds, '')) AS digest FROM {t}_run{k} UNION ALL SELECT {key}, idx, n, digest FROM {t}{k} WHERE n = 1),"""
        return ctes

    def path(t: str, key: str, start: str, levels: int) -> str:
        ctes = ""
        for k in range(levels):
            was, now = (start if k == 0 else f"{start}_{t}{k}"), f"{start}_{t}{k + 1}"
            slot = f"idx // {16**k} % 16"
            ctes += f"""
{now} AS (SELECT w.* EXCLUDE (run) REPLACE (CASE WHEN ds IS NULL THEN proof ELSE proof || array_to_string(ds[1:{slot}], '') || array_to_string(ds[{slot} + 2:], '') END AS proof,
    CASE WHEN ds IS NULL THEN up ELSE sha256(array_to_string(ds[1:{slot}], '') || up || array_to_string(ds[{slot} + 2:], '')) END AS up)
  FROM (SELECT *, idx // {16 ** (k + 1)} AS run FROM {was}) w LEFT JOIN (SELECT {key} AS k, idx AS p, ds FROM {t}_run{k}) r ON w.{key} IS NOT DISTINCT FROM r.k AND run = r.p),"""
        return ctes

    # crc32 bit by bit; a byte comes in at every eighth
    byte = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, i // 8 + 1, 1)) ELSE 0 END)"
    bit = f"xor({byte} >> 1, ({byte} & 1) * 3988292384)"
    return f"""
WITH ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, generate_series(0, 8 * strlen(s) - 1)), lambda c, i: {bit}), 4294967295) AS crc FROM ids),
d AS (SELECT doc_id, source, {leaf("text")} AS digest,
    CASE WHEN crc % 5 = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf("text")} END AS up FROM documents LEFT JOIN crcs USING (doc_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
t0 AS (SELECT source, idx, n, digest FROM l),{climb("t", "source", source_levels)}
u AS (SELECT source, 0 AS u, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t{source_levels}),
v0 AS (SELECT u, idx, n, digest FROM u),{climb("v", "u", upper_levels)}
s AS (SELECT doc_id, source, digest AS leaf, up, '' AS proof, idx FROM l),{path("t", "source", "s", source_levels)}
x AS (SELECT s.doc_id, s.leaf, u.digest AS subroot, s.up, s.proof, u.idx, 0 AS u FROM s_t{source_levels} s JOIN u ON s.source IS NOT DISTINCT FROM u.source),{path("v", "u", "x", upper_levels)}
r AS (SELECT digest AS root FROM v{upper_levels})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, up AS folded_root, up = root AS verified FROM x_v{upper_levels}, r
"""


ORACLES["op13_merkle_manifest"] = _merkle_sql()


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), *text_keys(F.col("text")))
    cut = cuts(docs).select("a", "b", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    lost = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    return rows.join(cut, ["a", "b"], "left").select("doc_id", "n_bytes", *lost, F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


# every window of every text, in pieces of 400 starts; texts as hexadecimal digits, so that bytes can be cut
ORACLES["op11_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT r, n, k, substr(h, 800 * k + 1, 1598) AS s FROM (SELECT r, h, n, unnest(range(0, n // 400 + 1)) AS k FROM d WHERE n >= 400)),
w AS MATERIALIZED (SELECT r, 400 * k + j AS i, md5(substr(s, 2 * j + 1, 800)) AS m FROM (SELECT r, n, k, s, unnest(range(0, 400)) AS j FROM p) WHERE 400 * k + j <= n - 400),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN c USING (m)),
e AS (SELECT r, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM g) GROUP BY r, span),
l AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY hi) AS his FROM e GROUP BY r),
kept AS (SELECT r, array_to_string(list_transform(range(0, n_spans + 1), lambda x: substr(h, 2 * (CASE WHEN x = 0 THEN 0 ELSE his[x] END) + 1, 2 * (CASE WHEN x = n_spans THEN n ELSE los[x + 1] END - CASE WHEN x = 0 THEN 0 ELSE his[x] END))), '') AS rest FROM l JOIN d USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN l USING (r) LEFT JOIN kept USING (r)
"""


@query
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    told = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", told.alias("centroid_sha256"))


def _centroid_sql(rounds: int = 3) -> str:
    """Every vector meets every one of the 16 centroids; sums and distances of integers below 2^53 are exact as doubles."""

    def near(k: int) -> str:
        return f"""
a{k} AS (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (SELECT r, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{k}) GROUP BY r),"""

    steps = "".join(
        f"""{near(i)}
m{i} AS (SELECT k, list(m ORDER BY j) AS c FROM (SELECT best.k AS k, j, floor(sum(x[j]) / count(*)) AS m FROM a{i} JOIN v USING (r), generate_series(1, 64) AS g(j) GROUP BY ALL) GROUP BY k),
c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k)),"""
        for i in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT x, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, x LIMIT 16)),{steps}{near(rounds)}
f AS (SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance FROM a{rounds} JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda m: CAST(CAST(m AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON cluster = k
"""


ORACLES["op12_centroid_clustering"] = _centroid_sql()
