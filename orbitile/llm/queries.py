"""The registered queries of this subpackage and the SQL that checks them.

Every query reads its whole table, calls one operator and derives the contract's columns
from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lm, merkle, mixing, neardup, quality, secrets, sharding, simhash, spelling, toxicity
from .common import fold_of, materialise, table


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of("doc_id", 5) != 1)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.match(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        "longest_start",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), folds=5, held_out=0)
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of("doc_id", 4) == 2
    trees = langid.learn(docs, ~held_out)
    return langid.predict(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        sharding.utf8_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    out = sharding.interleave(docs, 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.scan(docs, secrets.train(docs))

    def n(kind: int) -> F.Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs.select("doc_id", "source", mixing.word_count("text").alias("n")), F.col("n"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, 85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    manifest = merkle.build(docs, seen={"text": lowered}, when=fold_of("doc_id", 3) == 0)
    return merkle.prove(manifest).withColumnRenamed("key", "doc_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.count_words(docs, damage=spelling.DAMAGE))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = materialise(simhash.with_edits(docs, simhash.learn(docs)))
    out = simhash.near_counts(made, queries=F.col("doc_id") % 50 == 0)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_near",
    )


QUERIES = {
    "op1_lm": op1_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_langid": op6_langid,
    "op7_sharding": op7_sharding,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_neardup": op10_neardup,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL: dict[str, str] = {}

# The same mixture, with the clamping solved over all sources at once and the edge of the
# fractional epoch found by one window over each source.
ORACLE_SQL["op9_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('9:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0 * source_size AS cap,
         sum(source_size) OVER () AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM c
), t AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN cap::DOUBLE
              ELSE max(CASE WHEN level * weight < cap THEN level END) OVER () * weight END AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""

# Windows as joined words, met by every document window of the same length; runs of windows on one
# diagonal of a document and an item text are verbatim matches.
ORACLE_SQL["op2_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, t, p AS q, least(10, len(w)) AS n,
         array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, row_number() OVER () AS t, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows
), spots AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lengths WHERE len(w) >= n)
), found AS (SELECT doc_id, n, p, item_id, t, q FROM spots JOIN windows USING (n, s)
), runs AS (SELECT doc_id, min(p) - 1 AS start, count(*) + any_value(n) - 1 AS words
  FROM (SELECT DISTINCT doc_id, n, p, t, q, p - row_number() OVER (PARTITION BY doc_id, t, p - q ORDER BY p) AS island FROM (SELECT DISTINCT doc_id, n, p, t, q FROM found)) GROUP BY doc_id, t, p - q, island
), longest AS (SELECT doc_id, max(words) AS longest_match, min(start) FILTER (WHERE words = most) AS longest_start FROM (SELECT *, max(words) OVER (PARTITION BY doc_id) AS most FROM runs) GROUP BY doc_id
), hits AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match, longest_start::BIGINT AS longest_start
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

# Conversations as lists of turns; each is compared with the beginnings of all longer ones.
ORACLE_SQL["op4_chat"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS l
  FROM t GROUP BY conv_id
), g AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l
), begun AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM g))
SELECT conv_id, len(l)::BIGINT AS n_turns, n_copies, array_to_string(l, '') AS rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.l = g.l)
"""

# The hash of a text by its definition: a byte at a time, eight steps a byte.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || hex(encode({0}))[2 * i - 1 : 2 * i])::BIGINT),
  lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def merkle_sql(levels: int = 7) -> str:
    """All levels of the trees one after the other, as many as given: enough for 8 to that power of rows."""

    def enc(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


    parts = [
        f"leaves AS (SELECT doc_id, lang AS g, {leaf('text')} AS leaf, CASE WHEN {_CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(_LOWER.format('text'))} END AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)",
        "n0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM leaves)",
        "p0 AS (SELECT doc_id, g, i, coalesce(seen, leaf) AS f, '' AS proof FROM leaves)",
    ]

    def climb(k: int, here: str, there: str) -> None:
        parts.append(f"{there}n{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + 7) // 8 AS n FROM {here}n{k} GROUP BY g, i // 8)")
        sides = f"SELECT x.g, x.i, any_value(x.n) AS n, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, coalesce(string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r FROM {here}n{k} x JOIN {here}n{k} y ON x.g IS NOT DISTINCT FROM y.g AND x.i // 8 = y.i // 8 GROUP BY x.g, x.i"
        parts.append(f"{there}p{k + 1} AS (SELECT p.doc_id, p.g, p.i // 8 AS i, CASE WHEN s.n = 1 THEN f ELSE sha256(l || f || r) END AS f, proof || l || r AS proof FROM {here}p{k} p JOIN ({sides}) s ON p.g IS NOT DISTINCT FROM s.g AND p.i = s.i)")

    for k in range(levels):
        climb(k, "", "")
    parts.append(f"tops AS (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{levels})")
    parts.append("t_n0 AS (SELECT 0 AS g, i, d, n FROM tops)")
    parts.append(f"t_p0 AS (SELECT p.doc_id, 0 AS g, t.i, p.f, p.proof FROM p{levels} p JOIN tops t ON p.g IS NOT DISTINCT FROM t.g)")
    for k in range(3):
        climb(k, "t_", "t_")
    return "WITH " + ",\n".join(parts) + """
SELECT l.doc_id, l.leaf, tops.d AS subroot, r.d AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.d AS verified
FROM leaves l JOIN t_p3 p ON l.doc_id = p.doc_id JOIN tops ON l.g IS NOT DISTINCT FROM tops.g, t_n3 r"""


ORACLE_SQL["op11_merkle"] = merkle_sql()

# Near words meet by what is left when one code point is blanked or taken out; forms are followed by recursion.
ORACLE_SQL["op12_spelling"] = f"""
WITH RECURSIVE each_run AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS c FROM each_run GROUP BY ALL
), hashed AS (SELECT run, c, {_CRC32.format('k')} AS h FROM runs
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 199 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), blanked AS (SELECT word, n, word[1 : i - 1] || '?' || word[i + 1 :] AS pattern FROM spots
), shorter AS (SELECT DISTINCT word, n, word[1 : i - 1] || word[i + 1 :] AS rest FROM spots
), longer AS (SELECT s.word, s.n, w.word AS near, w.n AS near_n FROM shorter s JOIN words w ON s.rest = w.word
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM blanked a JOIN blanked b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT word, near, near_n FROM longer UNION SELECT near, word, n FROM longer
), best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near
), forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND r = 1
), follow AS (SELECT word, word AS root FROM forms UNION SELECT f.word, g.form FROM follow f JOIN forms g ON f.root = g.word WHERE g.form IS NOT NULL
), ends AS (SELECT f.word, f.root FROM follow f JOIN forms g ON f.root = g.word WHERE g.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN ends USING (word)
"""

# The same hash over whole texts, a byte at a time by the table of the eight steps of each byte.
_CRC32_TABLE = """SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) r(b)"""

# All rows in the order of their fraction of the source, cut at whole numbers of a shard.
ORACLE_SQL["op7_sharding"] = f"""
WITH crc AS ({_CRC32_TABLE}
), d AS (
  SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 16 AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
), hashed AS (
  SELECT doc_id, source, size, h,
         xor(4294967295, list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM d, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM hashed
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS LAST, r) - 1 AS p FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 40 // total)::INT AS shard,
       (p - ((p * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard
FROM ordered
"""

# Every pair of texts that share a shingle, by the sizes of their sets and of what they share; components by recursion.
ORACLE_SQL["op10_neardup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN least_of USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
