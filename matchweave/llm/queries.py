"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import bpe, chat, cotraining, media, merkle, packing, pii, range_join, run_index, simhash, spelling, toxicity, warc
from matchweave.sources.tables import shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """UTC, and a folder for stored tables if this is one machine and none is set."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if not shared_root(spark) and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op5_byte_bpe")
def op5_byte_bpe(spark, folder):
    """Encode, then decode the ids; digests of both."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_documents(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    done = bpe.decode_documents(ids.select("doc_id", "n_tokens", "ids"), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_power_packing")
def op7_power_packing(spark, folder):
    """Sequences are numbered bucket by bucket."""
    pieces = packing.pack(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.number(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


@query("op6_metric_range_join")
def op6_metric_range_join(spark, folder):
    return range_join.similar(table(spark, folder, "embeddings"), 0.9)


@query("op9_simhash_vantage_tree")
def op9_simhash_vantage_tree(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), reach=3, words=3)


_SAID = "</s>[INST] ok [/INST]"


@query("op8_chat_format", rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
ordered AS (
  SELECT *, row_number() OVER w AS nth, count(*) FILTER (role IN ('system', 'user', 'assistant')) OVER w AS entered
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (  -- the state before a turn: the last role that leads to one
  SELECT *, coalesce(first_value(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END) OVER (PARTITION BY conv_id, entered ORDER BY nth), 'start') AS state
  FROM ordered),
judged AS (
  SELECT *, coalesce(lag(state) OVER (PARTITION BY conv_id ORDER BY nth), 'start') || '>' || role NOT IN
    ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS breaks
  FROM placed),
escaped AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
    '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS safe FROM judged)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[') + length(role) + length('] ') + length(safe) + length('</s>'))::BIGINT AS formatted_chars,
  coalesce(min(nth) FILTER (breaks), 0)::INT AS broken_turn, max_by(state, nth) AS final_state
FROM escaped GROUP BY conv_id
""")
def op8_chat_format(spark, folder):
    """Turn and loss digests are read back from the formatted text and the segments."""
    said = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(said)
    done = chat.format_conversations(turns).withColumns({
        "turns": chat.read_turns(F.col("formatted")), "loss": F.array_join(chat.loss_texts(F.col("segments")), "")})
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_again, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "broken_turn", "final_state")


@query("op4_pii_spans")
def op4_pii_spans(spark, folder):
    """Counts and base_sha256 are of the plain identifiers, spans also of the disguised ones."""
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["disguised"])).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.joined(F.col("spans"), True), 256).alias("base_sha256"),
                        pii.joined(F.col("spans"), False).alias("spans"))


@query("op3_iso_media")
def op3_iso_media(spark, folder):
    """Each text stored as a file with one track of grey frames; digests of what is read back."""
    files = media.store_texts(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    read = media.inspect(files, payload=True)
    track = F.col("tracks")[0]
    keyframes = F.array_join(F.transform(track["keyframes"], lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.trim(track["codec"]), track["timescale"], track["duration"], track["n_samples"], keyframes).alias("feature"))


@query("op10_toxicity_mil")
def op10_toxicity_mil(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


@query("op2_quality_cotraining")
def op2_quality_cotraining(spark, folder):
    docs = table(spark, folder, "documents")
    model = cotraining.fit(docs, table(spark, folder, "labels"))
    return cotraining.score(docs, model).select("doc_id", "score", "keep")


@query("op1_warc_normaliser", """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
digests AS (SELECT *, ('0x' || sha1(html)) AS hex FROM payloads),
groups AS (SELECT *, [('0x' || substr(hex, 3 + 10 * i, 10))::BIGINT FOR i IN range(0, 4)] AS g FROM digests)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[1 + k // 8]) >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM groups
""")
def op1_warc_normaliser(spark, folder):
    records = warc.round_trip(table(spark, folder, "pages").select("page_id", "url", "html"), 0)
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.page_of(F.col("refers_to")).alias("refers_to"))


#: (t): crc32 of each byte, for list_reduce over the bytes of a string.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc(codes: str) -> str:
    """SQL for the crc32 of a list of bytes, with crc_table's ``t`` in reach."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _encoded_sql(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in _FIELDS[:-1]] + [text]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


def _tree_sql(name: str, leaves: str) -> str:
    """SQL of the CTE ``name`` (grp, level, nodes): each level of the groups of ``leaves`` (grp, node, nth)."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, list(node ORDER BY nth) AS nodes FROM {leaves} GROUP BY grp
  UNION ALL
  SELECT grp, level + 1, [sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')) FOR i IN range(0, (len(nodes) + 2) // 3)]
  FROM {name} WHERE len(nodes) > 1)"""


def _path_sql(name: str, tree: str, leaves: str) -> str:
    """SQL of the CTE ``name`` (grp, nth, path): the siblings of each of ``leaves`` in ``tree``, upwards."""
    run = "nth // (3 ** level)::BIGINT"
    return f"""{name} AS (
  SELECT l.grp, l.nth, list({{'b': array_to_string(nodes[{run} // 3 * 3 + 1:{run}], ''),
    'a': array_to_string(nodes[{run} + 2:{run} // 3 * 3 + 3], '')}} ORDER BY level) FILTER (len(nodes) > 1) AS path
  FROM {leaves} l JOIN {tree} t ON l.grp IS NOT DISTINCT FROM t.grp GROUP BY l.grp, l.nth)"""


@query("op12_merkle_manifest", f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT doc_id, source AS grp, sha256({_encoded_sql("text")}) AS node,
    sha256({_encoded_sql("replace(text, chr(10), '')")}) AS without,
    {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)")} % 2 = 0 AS touched
  FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS nth FROM hashed),
{_tree_sql("tree", "leaves")},
{_path_sql("paths", "tree", "leaves")},
subroots AS (SELECT grp AS source, nodes[1] AS node, 0 AS grp, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS nth
  FROM tree WHERE len(nodes) = 1),
{_tree_sql("top", "subroots")},
{_path_sql("top_paths", "top", "subroots")},
ways AS (
  SELECT l.doc_id, l.node AS leaf, s.node AS subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root,
    CASE WHEN l.touched THEN l.without ELSE l.node END AS start,
    list_concat(coalesce(p.path, []), coalesce(u.path, [])) AS path
  FROM leaves l JOIN paths p ON l.grp IS NOT DISTINCT FROM p.grp AND l.nth = p.nth
  JOIN subroots s ON l.grp IS NOT DISTINCT FROM s.source JOIN top_paths u ON u.nth = s.nth),
folded AS (
  SELECT *, list_reduce(list_prepend({{'b': start, 'a': ''}}, path), lambda n, s: {{'b': sha256(s.b || n.b || s.a), 'a': ''}}).b AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded
""")
def op12_merkle_manifest(spark, folder):
    """The manifest of all rows, and what each way up says of a copy whose line breaks are partly lost."""
    docs = table(spark, folder, "documents").select(*_FIELDS)
    leaf = lambda text: merkle.digest(merkle.encoded(*[F.col(c) for c in _FIELDS[:-1]], text))
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"),
                         F.when(touched & F.contains("text", F.lit("\n")), leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"))
    rows = merkle.manifest(leaves, ["doc_id"], "source")
    folded = rows.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CODES = ("flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), "
          "lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))")


@query("op13_spelling_variants", f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc(_CODES)} AS h FROM runs, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS rest FROM words, range(1, 40) r(i) WHERE i <= length(word)),
pairs AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.head = b.head AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.head || s.rest
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.head || s.rest),
near AS (SELECT p.word, count(*) AS n_near, first(p.other ORDER BY w.n DESC, p.other) AS best, max(w.n) AS best_n
  FROM pairs p JOIN words w ON p.other = w.word GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form,
    CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS at_word FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.at_word = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at_word AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k USING (word) JOIN forms l ON l.word = k.at_word WHERE l.form IS NULL
""")
def op13_spelling_variants(spark, folder):
    words = spelling.vocabulary(table(spark, folder, "documents").select("doc_id", "text"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op11_run_length_index", """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
bytes AS (
  SELECT doc_id, b, hex(h[b + 1:b + 1]) AS x, CASE WHEN b + 100 <= octet_length(h) THEN sha1(h[b + 1:b + 100]) END AS string
  FROM (SELECT doc_id, h, unnest(range(0, octet_length(h))) AS b FROM docs)),
later AS (SELECT *, string IS NOT NULL AND row_number() OVER (PARTITION BY string ORDER BY doc_id, b) > 1 AS again FROM bytes),
marked AS (SELECT doc_id, b, x, coalesce(max(CASE WHEN again THEN b END) OVER (PARTITION BY doc_id ORDER BY b) >= b - 99, false) AS gone FROM later),
turns AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY b) AS begins FROM marked)
SELECT d.doc_id, octet_length(h)::BIGINT AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
  sha256(unhex(coalesce(string_agg(x, '' ORDER BY b) FILTER (NOT gone), ''))) AS kept_sha256
FROM docs d LEFT JOIN turns t ON d.doc_id = t.doc_id GROUP BY d.doc_id, h
""")
def op11_run_length_index(spark, folder):
    """The texts without the bytes of strings of 100 bytes that stand earlier."""
    kept = run_index.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
