"""The operators applied to the given tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import bpe, chat, fingerprints, language, latent, lines, merkle, minhash, pieces, quality, spelling, substrings, tokenstore
from cuesheet.llm.scratch import Scratch
from cuesheet.queries.registry import Registry

query = Registry()

BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
TOKEN_LIMIT = 1024
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_counts")
def token_counts(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = bpe.with_token_counts(docs, tokenizer_file(BPE_FILE))
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '<', '\\l'), '\"', '\\q')"


@query("op4_chat_format", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length('<turn role="') + length({_ESCAPED.format('role')}) + length('">') + length({_ESCAPED.format('text')}) + length('</turn>') + 1) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g""")
def chat_format(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    out = chat.format_paths(chat.reply_paths(chat.linear_replies(turns.unionByName(probe))))
    read = out.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_learnt(F.col("formatted"), F.col("turn_starts"), F.col("loss")), "").alias("learnt"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_line_dedup", f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM parts),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
owned AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS owner FROM keyed),
marked AS (SELECT *, length(key) >= 10 AND owner <> doc_id AS gone FROM owned)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def line_dedup(spark, sf_dir):
    out = lines.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op8_pieces")
def piece_encoding(spark, sf_dir):
    return pieces.piece_digests(documents(spark, sf_dir), tokenizer_file(PIECE_FILE))


@query("op9_quality_rules")
def quality_rules(spark, sf_dir):
    out = quality.repetition_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.drop("text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_near_dedup")
def near_dedup(spark, sf_dir):
    out = minhash.near_duplicates(documents(spark, sf_dir), k=4)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@query("op3_token_store")
def token_store(spark, sf_dir):
    store = Scratch(spark, "tokens").path("store")
    tokenstore.write_store(documents(spark, sf_dir), store, tokenizer_file(BPE_FILE))
    return tokenstore.read_store(spark, store, with_ids=False)


@query("op7_language_id")
def language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    out = language.identify(docs.select("doc_id", "text", "lang", "source"), model, F.col("text"), F.col("lang"), F.col("source"))
    return out.select("doc_id", "language", "language_p", F.col("language_known").alias("kept"))


@query("language_of_pages")
def language_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    model = language.fit(documents(spark, sf_dir))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    out = language.identify(pages, model, body, language.declared_in(F.col("html")), F.col("url"))
    return out.select("page_id", "language", "language_p", F.col("language_known").alias("kept"))


@query("op5_decontamination")
def decontamination(spark, sf_dir):
    found = latent.benchmark_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("cosine", 3).alias("cosine"), F.col("common").alias("lcs_words"), "item_words", "answered"
    )


@query("op1_substring_dedup", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(a) - 48)) AS k, a FROM w WHERE len(a) >= 50),
keyed AS (SELECT doc_id, k, md5(array_to_string(a[k:k + 49], ' ')) AS h FROM win),
owned AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS owner FROM keyed),
gone AS (SELECT DISTINCT doc_id, k + d AS pos FROM (SELECT doc_id, k, unnest(range(0, 50)) AS d FROM owned WHERE owner < doc_id)),
words AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS word FROM w)
SELECT w.doc_id, CAST(len(w.a) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id
LEFT JOIN (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept FROM words x
           LEFT JOIN gone y ON y.doc_id = x.doc_id AND y.pos = x.pos WHERE y.doc_id IS NULL GROUP BY x.doc_id) t ON t.doc_id = w.doc_id""")
def substring_dedup(spark, sf_dir):
    out = substrings.repeated_windows(documents(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def tampered(docs: DataFrame) -> Column:
    """The text, A-Z in lower case where 3 divides the CRC of the id."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(docs["text"], UPPER, UPPER.lower())).otherwise(docs["text"])


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_CRC32 = """xor(list_reduce(list_transform({}, lambda c: CAST(c AS BIGINT)), lambda crc, c:
  list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295)"""
_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))


@query("op11_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, sha256({_LEAF} || {_FIELD.format('text')}) AS leaf,
         sha256({_LEAF} || {_FIELD.format('t')}) AS current
  FROM (SELECT *, CASE WHEN {_CRC32.format(_DIGITS)} % 3 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS t FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
nodes AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY grp, level + 1, pos // 8),
subroots AS (SELECT grp, level AS height, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY level + 1, pos // 8),
every AS (SELECT grp, level, pos, digest, n FROM nodes UNION ALL SELECT '#', level, pos, digest, n FROM tops),
runs AS (SELECT grp, level, pos // 8 AS run, list(digest ORDER BY pos) AS slots FROM every WHERE n > 1 GROUP BY grp, level, pos // 8),
steps AS (
  SELECT p.doc_id, p.grp, r.level AS step, r.slots, (p.pos // CAST(pow(8, r.level) AS BIGINT)) % 8 AS slot FROM placed p JOIN runs r
    ON r.grp = p.grp AND r.run = p.pos // CAST(pow(8, r.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.grp, 100 + r.level, r.slots, (s.pos // CAST(pow(8, r.level) AS BIGINT)) % 8 FROM placed p JOIN subroots s ON s.grp = p.grp JOIN runs r
    ON r.grp = '#' AND r.run = s.pos // CAST(pow(8, r.level + 1) AS BIGINT)),
sides AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY step) AS k, array_to_string(slots[1:slot], '') AS l, array_to_string(slots[slot + 2:], '') AS r FROM steps),
folded AS (
  SELECT doc_id, grp, 0 AS k, current AS digest FROM placed
  UNION ALL
  SELECT f.doc_id, f.grp, f.k + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN sides s ON s.doc_id = f.doc_id AND s.grp = f.grp AND s.k = f.k + 1),
proofs AS (SELECT doc_id, grp, string_agg(l || r, '' ORDER BY k) AS proof FROM sides GROUP BY doc_id, grp)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp JOIN tops t ON t.n = 1 LEFT JOIN proofs q ON q.doc_id = p.doc_id AND q.grp = p.grp
JOIN (SELECT doc_id, grp, arg_max(digest, k) AS digest FROM folded GROUP BY doc_id, grp) f ON f.doc_id = p.doc_id AND f.grp = p.grp""")
def merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fields = ("doc_id", "source", "lang", "n_chars")
    current = merkle.digest(*[merkle.field(docs[f]) for f in fields], merkle.field(tampered(docs)))
    out = merkle.manifest(docs, fields=(*fields, "text"), current_leaf=current)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_BYTES = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"


@query("op13_spelling_variants", f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, {_CRC32.format(_BYTES)} AS h FROM found),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
dels AS (SELECT word, length(word) AS len, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM vocab)),
shorter AS (SELECT DISTINCT d.word AS a, v.word AS b FROM dels d JOIN vocab v ON v.word = d.rest),
near AS (
  SELECT x.word AS a, y.word AS b FROM dels x JOIN dels y ON y.k = x.k AND y.rest = x.rest AND y.len = x.len AND y.word <> x.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM near JOIN vocab ON word = b GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
          FROM vocab LEFT JOIN best ON a = word),
follow AS (SELECT word, word AS at FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.at WHERE g.form IS NOT NULL),
roots AS (SELECT f.word, f.at AS root FROM follow f JOIN forms g ON g.word = f.at WHERE g.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word""")
def spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir)))


@query("op12_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))
