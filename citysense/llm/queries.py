"""The registered queries of this subpackage: thin calls of its operators on the driver's tables.

``QUERIES`` maps names to ``fn(spark, sf_dir) -> DataFrame``; ``ORACLES`` has
DuckDB text for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import with_hits
from .kneser_ney import score_held_out
from .license_scan import labels_of, license_scan
from .line_quality import BOILERPLATE, DEFAULT_RULES, line_quality
from .merkle import folded, leaf_hash, merkle_manifest, proof_hash
from .packing import pack
from .prefix_trie import conversation_trie, turns_in_order
from .secret_scan import secret_spans, spans_text
from .shards import byte_shards
from .simhash import fingerprint_text, near_duplicates
from .site_quality import site_quality
from .store import materialize, table
from .token_counts import token_counts
from .tool_calls import link_tool_calls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _line_quality_sql() -> str:
    r, word = DEFAULT_RULES, "[^\\x20\\x09-\\x0D]+"
    found = lambda pattern: f"len(regexp_extract_all(x, '{pattern}'))"
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
                     regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
lines AS (
  SELECT k, i, ls[i] AS x, translate(ls[i], '{upper}', '{upper.lower()}') AS low
  FROM (SELECT k, string_split(text, chr(10)) AS ls FROM docs), unnest(range(1, len(ls) + 1)) t(i) WHERE ls[i] <> ''),
counted AS (
  SELECT k, i, x, low, strlen(x) AS size, length(x) AS points, {found(word)} AS n, {found("[#*$%&|<>]")} AS symbols, {found("[|>/]")} AS bullets,
         length(x) - length(regexp_replace(x, '[!?]', '', 'g')) - {found("[!?]+")} AS shouts,
         {found("[\\x00-\\x08\\x0E-\\x1F\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")} AS signs
  FROM lines),
menus AS (SELECT *, n > 0 AND bullets >= 2 AND bullets > {r.max_bullets_per_word}::DOUBLE * greatest(n, 1) AS nav FROM counted),
noisy AS (SELECT *, n > 0 AND NOT nav AND (symbols - least(symbols, bullets) + shouts > {r.max_noise_per_word}::DOUBLE * greatest(n, 1)
                 OR signs > {r.max_sign_share}::DOUBLE * greatest(points, 1)) AS noise FROM menus),
judged AS (SELECT *, NOT nav AND NOT noise AND n <= {r.max_boilerplate_words} AND ({phrases}) AS boiler,
                  n > 0 AND row_number() OVER (PARTITION BY k, x ORDER BY i) > 1 AS again FROM noisy),
texts AS (
  SELECT k, count(*) AS n_lines, sum(again::INT) AS dup, sum(noise::INT) AS noise, sum(nav::INT) AS nav, sum(boiler::INT) AS boiler,
         sum(CASE WHEN noise OR nav THEN size ELSE 0 END) / greatest(sum(CASE WHEN boiler THEN 0 ELSE size END), 1) AS lost,
         sum(CASE WHEN noise OR nav OR boiler THEN size ELSE 0 END) / greatest(sum(size), 1) AS removed,
         sum(CASE WHEN noise OR nav OR boiler THEN 0 ELSE n END) AS words_left
  FROM judged GROUP BY k),
grams AS (SELECT k, i, array_to_string(w[i:i + {r.window - 1}], ' ') AS g FROM docs, unnest(range(1, len(w) - {r.window - 2})) t(i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {r.window})) AS p FROM twice) GROUP BY k),
counts AS (
  SELECT d.k, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(noise, 0) AS noise,
         coalesce(nav, 0) AS nav, coalesce(boiler, 0) AS boiler, coalesce(lost, 0) AS lost, coalesce(removed, 0) AS removed, coalesce(words_left, 0) AS words_left
  FROM docs d LEFT JOIN texts USING (k) LEFT JOIN repeats r USING (k))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
       NOT base_failed AND lost <= {r.max_lost_share}::DOUBLE AND removed <= {r.max_removed_share}::DOUBLE
       AND words_left >= {max(r.min_words, 1)} AS kept, n_lines::BIGINT AS n_lines,
       noise::BIGINT AS n_punctuation_lines, nav::BIGINT AS n_navigation_lines, boiler::BIGINT AS n_boilerplate_lines,
       round(lost::DOUBLE, 6) AS lost_share
FROM counts"""


@query("op3_line_quality", _line_quality_sql())
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", line_quality(F.col("text")).alias("q"))
    return docs.select("doc_id", *[f"q.{x}" for x in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines")],
        F.round("q.lost_share", 6).alias("lost_share"))


SHARDS = 24


@query("op7_byte_shards")
def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def _words_sql(table_: str, id_: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (f"SELECT row_number() OVER () AS k, {id_}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
            f"'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_}")


DECONTAMINATION_ORACLE = f"""
WITH docs AS ({_words_sql("documents", "doc_id")}), items AS ({_words_sql("benchmark", "item_id")}),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (
  SELECT k, i, n, item_id
  FROM (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM docs, (SELECT DISTINCT n FROM grams), unnest(range(1, len(w) - n + 2)) t(i))
  JOIN grams USING (n, g)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x
          FROM (SELECT DISTINCT k, coalesce(item_id::VARCHAR, 'null') AS x FROM hits) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (k) LEFT JOIN named USING (k)"""


@query("op10_decontamination", DECONTAMINATION_ORACLE)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark"), "hits")
    n_hit = F.size("hits.words").cast("long")
    return found.select(
        "doc_id", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("s"))
    return found.select(
        "doc_id", "s.n_assign", "s.n_access", "s.n_hex",
        F.sha2(spans_text(F.col("s.found"), base_only=True).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("s.found")).alias("spans"))


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), fingerprint_text(F.col("fingerprint")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op5_window_packing")
def op5_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), rule="most")


@query("op6_site_quality")
def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_kneser_ney")
def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


#: Conversations hold plain turns; every assistant's turn is read as a call whose tool and arguments follow from its
#: text (some wrong on purpose), every other turn as the result of the turn before it.
CHAT_CALLS = """
SELECT conv_id, concat('call_', turn) AS call_id, turn,
       CASE length(text) % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'count' WHEN 2 THEN 'summarise' ELSE 'unlisted' END AS name,
       concat('{{ ', CASE WHEN length(text) % 7 = 0 THEN '' ELSE concat('"query" : ', to_json(cast(split_part(text, ' ', 1) AS variant)), ', ') END,
              '"limit": ', CASE WHEN length(text) % 5 = 0 THEN concat('"', length(text) % 50, '"') ELSE cast(length(text) % 50 AS string) END,
              ', "exact":', length(text) % 2 = 0, CASE WHEN length(text) % 11 = 0 THEN '' ELSE ' }}' END) AS arguments,
       CASE length(text) % 3 WHEN 0 THEN array(concat('call_', turn - 2), concat('call_', turn - 4))
                             WHEN 1 THEN array(concat('call_', turn - 4)) ELSE array(concat('call_', turn - 2)) END AS after
FROM {conversations} WHERE role = 'assistant'"""
CHAT_RESULTS = """
SELECT conv_id, concat('call_', turn - 1) AS call_id, turn, text AS content FROM {conversations} WHERE role IS DISTINCT FROM 'assistant'"""
CHAT_SCHEMAS = """
SELECT * FROM VALUES ('lookup', map('query', 'string', 'limit', 'integer', 'exact', 'boolean'), array('query')),
                     ('count', map('query', 'string', 'limit', 'number'), array('limit')),
                     ('summarise', map('query', 'string', 'limit', 'string', 'exact', 'boolean'), array('query', 'limit'))
       AS t(name, properties, required)"""
CHAT_ORACLE = """
WITH RECURSIVE raw AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn, length(text) AS n,
         CASE length(text) % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'count' WHEN 2 THEN 'summarise' ELSE 'unlisted' END AS name,
         split_part(text, ' ', 1) AS q
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (
  SELECT conv_id, call_id, u.turn, u.n, u.name, u.q, copies
  FROM (SELECT conv_id, call_id, min(struct_pack(turn := turn, name := name, n := n, q := q)) AS u, count(*) AS copies FROM raw GROUP BY ALL)),
waits AS (
  SELECT DISTINCT c.conv_id, c.turn, b.turn AS before FROM calls c JOIN calls b
  ON b.conv_id = c.conv_id AND b.turn IN (c.turn - CASE WHEN c.n % 3 = 1 THEN 4 ELSE 2 END, c.turn - CASE WHEN c.n % 3 = 2 THEN 2 ELSE 4 END)),
chains AS (
  SELECT conv_id, turn, 0::BIGINT AS level FROM calls WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM waits)
  UNION
  SELECT w.conv_id, w.turn, l.level + 1 FROM chains l JOIN waits w ON w.conv_id = l.conv_id AND w.before = l.turn),
levels AS (SELECT conv_id, turn, max(level) AS level FROM chains GROUP BY ALL),
results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, turn AS result_turn, min(text) AS content FROM conversations
  WHERE role IS DISTINCT FROM 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, l.level, c.name, c.n, c.q, r.result_turn, r.content,
         coalesce(c.copies, 1) AS copies, c.turn IS NOT NULL AS called,
         CASE WHEN c.turn IS NULL THEN 'no call' WHEN r.result_turn IS NULL THEN 'no result' ELSE 'linked' END AS status
  FROM calls c LEFT JOIN levels l ON c.conv_id = l.conv_id AND c.turn = l.turn
  FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
checked AS (
  SELECT *, called AND n % 11 <> 0 AS parsed, n % 7 <> 0 AS has_q, n % 5 = 0 AS as_text,
         CASE WHEN NOT called THEN [] WHEN name = 'unlisted' THEN ['unknown tool'] WHEN n % 11 = 0 THEN ['not an object']
              WHEN name = 'lookup' THEN list_filter([CASE WHEN n % 7 = 0 THEN 'missing query' END, CASE WHEN n % 5 = 0 THEN 'not integer limit' END], lambda x: x IS NOT NULL)
              WHEN name = 'count' THEN list_filter([CASE WHEN n % 5 = 0 THEN 'not number limit' END, 'unknown exact'], lambda x: x IS NOT NULL)
              ELSE list_filter([CASE WHEN n % 7 = 0 THEN 'missing query' END, CASE WHEN n % 5 <> 0 THEN 'not string limit' END], lambda x: x IS NOT NULL) END AS errors
  FROM linked)
SELECT conv_id, call_id, coalesce(turn, result_turn) AS turn, level, status, copies, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors,
       '{' || CASE WHEN parsed THEN '"arguments":{"exact":' || (n % 2 = 0) || ',"limit":' || CASE WHEN as_text THEN '"' || (n % 50) || '"' ELSE (n % 50) || '' END
              || CASE WHEN has_q THEN ',"query":' || to_json(q) ELSE '' END || '},' ELSE '' END
       || '"call_id":"' || call_id || '"' || CASE WHEN content IS NULL THEN '' ELSE ',"content":' || to_json(content) END || ',"conv_id":' || conv_id
       || CASE WHEN called THEN ',"name":"' || name || '"' ELSE '' END || CASE WHEN result_turn IS NULL THEN '' ELSE ',"result_turn":' || result_turn END
       || ',"status":"' || status || '"' || CASE WHEN turn IS NULL THEN '' ELSE ',"turn":' || turn END || '}' AS json
FROM checked"""


@query("op1_tool_calls", CHAT_ORACLE)
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    linked = link_tool_calls(spark.sql(CHAT_CALLS, conversations=turns), spark.sql(CHAT_RESULTS, conversations=turns), spark.sql(CHAT_SCHEMAS))
    return linked.withColumn("errors", F.array_join("errors", "; "))


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", license_scan(F.col("text")).alias("s"))
    base = F.filter("s.found", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    return found.select(
        "doc_id", "s.n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels_of(base).alias("base_labels"), labels_of(F.col("s.found")).alias("labels"), "s.score")


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: each character stands before seven zeros."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1)), 4294967295::BIGINT), 4294967295)"


def _merkle_sql(levels: int = 12) -> str:
    """The trees level by level as lists, enough levels for 3 ** levels leaves and sources; a leaf goes up along its siblings."""
    entry = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(entry, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    cut = leaf("replace(text, chr(10), '')")
    up = lambda x: f"CASE WHEN len({x}) > 1 THEN list_transform(range(0, (len({x}) + 2) // 3), lambda i: sha256(array_to_string({x}[3 * i + 1:3 * i + 3], ''))) ELSE {x} END"
    out = [f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 2 = 0 "
           f"THEN {cut} ELSE {leaf('text')} END AS tampered FROM documents)",
           "t0 AS (SELECT source, list(leaf ORDER BY doc_id NULLS FIRST, leaf) AS x FROM leaves GROUP BY source)"]
    out += [f"t{k + 1} AS (SELECT source, {up('x')} AS x FROM t{k})" for k in range(levels)]
    out += [f"s0 AS (SELECT list(x[1] ORDER BY source NULLS FIRST) AS x FROM t{levels})"]
    out += [f"s{k + 1} AS (SELECT {up('x')} AS x FROM s{k})" for k in range(levels)]
    out += ["at0 AS (SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, "
            "tampered AS node, '' AS proof FROM leaves)"]
    step = ("CASE WHEN len(x) > 1 THEN sha256(array_to_string(x[p // 3 * 3 + 1:p], '') || node || array_to_string(x[p + 2:p // 3 * 3 + 3], '')) ELSE node END AS node, "
            "CASE WHEN len(x) > 1 THEN proof || array_to_string(x[p // 3 * 3 + 1:p], '') || array_to_string(x[p + 2:p // 3 * 3 + 3], '') ELSE proof END AS proof, p // 3 AS p")
    out += [f"at{k + 1} AS (SELECT a.doc_id, a.source, a.leaf, {step} FROM at{k} a JOIN t{k} t ON a.source IS NOT DISTINCT FROM t.source)" for k in range(levels)]
    out += ["sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p FROM t0)",
            f"up0 AS (SELECT a.doc_id, a.source, a.leaf, a.node, a.proof, s.p FROM at{levels} a JOIN sources s ON a.source IS NOT DISTINCT FROM s.source)"]
    out += [f"up{k + 1} AS (SELECT doc_id, source, leaf, {step} FROM up{k}, s{k})" for k in range(levels)]
    return ("WITH " + ",\n".join(out) + f"""
SELECT doc_id, leaf, t.x[1] AS subroot, r.x[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.x[1] AS verified
FROM up{levels} u JOIN t{levels} t ON u.source IS NOT DISTINCT FROM t.source, s{levels} r""")


@query("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars"]
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle_manifest(table(spark, sf_dir, "documents"), columns=[*columns, "text"], carry={"shown": F.unhex(leaf_hash([*columns, shown]))})
    up = made.withColumn("folded_root", folded(F.lower(F.hex("shown")), F.col("proof")))
    return up.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
                     (F.col("folded_root") == F.col("root")).alias("verified"))


TRIE_ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, {_crc32_sql("c::VARCHAR")} % 9 AS h FROM turns),
rebuilt AS (
  SELECT v.c, 0 AS own, t.p, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.p < v.h
  UNION ALL SELECT t.c, 1, t.p, t.role, t.text FROM turns t JOIN convs v ON v.c = t.c AND t.p >= v.h),
paths AS (
  SELECT c, list(md5(strlen(role) || ':' || role || text) ORDER BY own, p) AS ids, list(strlen(text) ORDER BY own, p) AS sizes FROM rebuilt GROUP BY c),
full_paths AS (SELECT v.c, coalesce(ids, []) AS ids, coalesce(sizes, []) AS sizes, len(coalesce(ids, [])) AS n FROM convs v LEFT JOIN paths USING (c)),
steps AS (SELECT c, d, ids[1:d] AS k, n, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM full_paths, unnest(range(0, n + 1)) t(d)),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM steps GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a AS d, k[1:a] AS k, sum((n_children IS NULL)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT nodes.d, nodes.k, n_convs, size, n_children FROM nodes LEFT JOIN kids USING (d, k)), unnest(range(0, d + 1)) t(a) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below b ON b.d = x.d AND b.k = x.k LEFT JOIN kids c ON c.d = x.d AND c.k = x.k
LEFT JOIN nodes u ON u.d = x.d - 1 AND u.k = x.k[1:x.d - 1]"""


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share starts: the first h turns of conversation c - c % 5, then c's own beyond its
    first h, where h is crc32(c) % 9. Turns as from ``turns_in_order``; also all conversations."""
    turns = materialize(turns)
    convs = turns.groupBy("conv").agg(F.max("turns").alias("turns")).select(
        "conv", "turns", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv") - F.col("conv") % 5).alias("base"))
    convs = materialize(convs.join(convs.select(F.col("conv").alias("base"), F.col("turns").alias("given")), "base", "left")
                        .withColumn("lead", F.least("h", F.coalesce("given", F.lit(0)))))
    first = turns.where("place < 8 AND conv % 5 = 0").select(F.col("conv").alias("base"), "place", "id", "bytes")
    heads = convs.select("conv", "base", "h").join(first, "base").where("place < h").select("conv", "place", "id", "bytes")
    own = turns.drop("turns").join(convs.select("conv", "h", "lead"), "conv").where("place >= h").select(
        "conv", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "id", "bytes")
    return heads.unionByName(own), convs.select("conv")


@query("op13_prefix_trie", TRIE_ORACLE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(*rebuilt_conversations(turns_in_order(table(spark, sf_dir, "conversations"))))
