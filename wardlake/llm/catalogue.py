"""The operators of this package as queries over the test tables, and their SQL twins.

Each query is a thin use of its operator; digests are made here, from the
operator's own texts, spans and counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from wardlake.llm import chat, counts, decontaminate, encode, exact, fingerprints, lm, neighbours, quality, repair, repeats, shard, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


CHAT_SQL = r"""
WITH added AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM added
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 6
           ELSE 6 + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END AS chars
  FROM near)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op2_chat_formatting", CHAT_SQL)
def op2_chat_formatting(spark, folder):
    tricky = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        tricky.alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.format_chats(rows).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: CRC-32 of the UTF-8 bytes by a table of 256 remainders made from the rule, then prefix sums and equal cuts.
SHARD_SQL = """
WITH entries AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY i) AS entry
  FROM range(256) AS t(i)),
spelled AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    [4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes
  FROM documents),
summed AS (
  SELECT doc_id, size::BIGINT AS size,
    xor(list_reduce(bytes, lambda c, b: xor(entry[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM spelled, entries),
placed AS (
  SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total, row_number() OVER o AS n
  FROM summed WINDOW o AS (ORDER BY text_crc32, size, doc_id ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least((before * 2 + size) * 40 // (total * 2), 39)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM cut
"""


@query("op7_sharding", SHARD_SQL)
def op7_sharding(spark, folder):
    return shard.shards(table(spark, folder, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Words and distinct five-word shingles of a table's texts, as DuckDB lists.
SHINGLE_LISTS = r"""
SELECT {key}, list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table})
"""

LEAK_SQL = f"""
WITH d AS ({SHINGLE_LISTS.format(key="doc_id", table="documents")}),
b AS ({SHINGLE_LISTS.format(key="item_id", table="benchmark")}),
ds AS (SELECT doc_id, unnest(s) AS g FROM d), bs AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM ds JOIN bs USING (g) GROUP BY doc_id, item_id, n HAVING count(*) * 5 >= n * 4
"""


@query("op10_decontamination", LEAK_SQL)
def op10_decontamination(spark, folder):
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: All pairs that share a shingle, their overlap, and all that links can reach.
LINK_SQL = f"""
WITH RECURSIVE d AS ({SHINGLE_LISTS.format(key="doc_id", table="documents")}),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM held AS x JOIN held AS y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON l.a = r.other)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(other) FROM reach AS r WHERE r.doc_id = d.doc_id) AS component_id FROM d
"""


@query("op6_jaccard_join", LINK_SQL)
def op6_jaccard_join(spark, folder):
    return neighbours.near_duplicates(table(spark, folder, "documents"))


#: Every 200-byte string (by its hash), the runs that repeated ones cover, and what stands between them.
REPEAT_SQL = """
WITH spelled AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS string
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM spelled)),
again AS (SELECT doc_id, i FROM strings WHERE string IN (SELECT string FROM strings GROUP BY string HAVING count(*) > 1)),
edges AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true)::INTEGER AS fresh FROM again),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, run),
between_runs AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs),
cut AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept
  FROM between_runs JOIN spelled USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM spelled LEFT JOIN cut USING (doc_id)
"""


@query("op9_repeated_text", REPEAT_SQL)
def op9_repeated_text(spark, folder):
    cleaned = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cleaned.select(
        "row.doc_id",
        F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )



@query("op8_lm_scoring")
def op8_lm_scoring(spark, folder):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lm.score(table(spark, folder, "documents").select("doc_id", "text"), ~held_out)
    return scored.select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query("op3_bpe_encoding")
def op3_bpe_encoding(spark, folder):
    path = tokenizer_path("byte_bpe_50k.json")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    # The text itself is not needed beside its ids.
    encoded = encode.encode(documents, path).select(F.struct("row.doc_id").alias("row"), "ids")
    return encode.decode(encoded, path).select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op4_token_counts")
def op4_token_counts(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    counted = counts.prefix_counts(documents, tokenizer_path("word_bpe_49k.json"))
    return counted.select(
        "row.doc_id",
        F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


@query("op1_fingerprints")
def op1_fingerprints(spark, folder):
    return fingerprints.fingerprints(table(spark, folder, "documents")).select(
        "doc_id",
        "n_chars",
        sha(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op5_quality_classifier")
def op5_quality_classifier(spark, folder):
    return quality.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, folder):
    return whiten.whiten(table(spark, folder, "embeddings"))


#: CRC-32 of a short ASCII text, bit by bit; damage, faults, a table of cheapest edits per row, and the edits replayed.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda c: unicode(c)::BIGINT) AS bytes FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(bytes, lambda a, b:
    list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) AS copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[:64], sha256(text)) AS n FROM damaged),
judged AS (
  SELECT *, role[1] AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair
  FROM numbered),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
inserts(before, state, letters) AS (
  VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
best AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS way FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, n, after, min(way) FROM (
    SELECT r.conv_id, r.n, CASE letter WHEN 'D' THEN i.state WHEN 'R' THEN CASE i.state WHEN 2 THEN 3 ELSE 2 END
        ELSE strpos('sua', r.initial) END AS after,
      {'cost': b.way.cost + 3 * length(i.letters) + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
         + CASE WHEN r.fault = 3 AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': b.way.audit || i.letters || letter} AS way
    FROM best AS b JOIN judged AS r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.n = b.n + 1
      JOIN inserts AS i ON i.before = b.state, (VALUES ('D'), ('R'), ('K')) AS e(letter)
    WHERE letter = 'D' OR (r.fault NOT IN (1, 2) AND (letter = 'R' OR (r.initial = 's' AND i.state = 0)
      OR (r.initial = 'u' AND i.state <> 2) OR (r.initial = 'a' AND i.state = 2))))
  GROUP BY conv_id, n, after),
ended AS (
  SELECT b.conv_id, min({'cost': way.cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
    'audit': way.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS way
  FROM best AS b JOIN (SELECT conv_id, max(n) AS rows FROM judged GROUP BY conv_id) AS l
    ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.rows = b.n GROUP BY b.conv_id),
letters AS (
  SELECT conv_id, way.audit AS audit, unnest(range(1, length(way.audit) + 1)) AS spot FROM ended),
placed AS (
  SELECT conv_id, spot, audit[spot] AS letter,
    count(*) FILTER (audit[spot] <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS n,
    count(*) FILTER (audit[spot] <> 'D') OVER (PARTITION BY conv_id ORDER BY spot) AS out FROM letters),
edited AS (
  SELECT p.*, j.role, j.text, max(CASE WHEN letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS headed
  FROM placed AS p LEFT JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.n = p.n),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS text
  FROM edited WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost,
  coalesce(way.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
  LEFT JOIN facts AS f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of ends, repeated or given to the user, by a checksum of their key; nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(spark, folder):
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.Repair(damaged(conversations))
    counted = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # One row per conversation from each side; grouping meets null ids too.
    every = conversations.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in counted), F.lit("").alias("audit"), F.lit(None).cast("string").alias("sha256"))
    sides = every.unionByName(
        done.conversations().select("conv_id", *counted, "audit", F.lit(None).cast("string").alias("sha256"))
    ).unionByName(
        repair.digests(done.rows()).select("conv_id", *(F.lit(0).cast("long").alias(c) for c in counted), F.lit("").alias("audit"), "sha256")
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return sides.groupBy("conv_id").agg(
        *(F.max(c).alias(c) for c in counted), F.max("audit").alias("audit"), F.coalesce(F.max("sha256"), nothing).alias("repaired_sha256")
    )


GROUPS_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op13_exact_dedup", GROUPS_SQL)
def op13_exact_dedup(spark, folder):
    return exact.exact_groups(table(spark, folder, "documents"))
