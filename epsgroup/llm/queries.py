"""The registered queries of the operators, one each, over whole tables."""

import public_tokenizers
from pyspark.sql import functions as F

from epsgroup.llm import chat, collocations, decontamination, embeddings, jaccard, languages, licenses, packing, quality, scoring, sharding, tries, warc
from epsgroup.workspace import Workspace

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SEQUENCE = 2048
SHARD_BYTES = 64 << 20


def given(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark, folder):
    docs = given(spark, folder, "documents")
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), Workspace(spark), SEQUENCE)


def op2_quality_classifier(spark, folder):
    return quality.classify(given(spark, folder, "documents"), "doc_id", "text")


def op3_chat_formatting(spark, folder):
    """Conversations written out as lines, an eighth of the turns without a speaker marker, and recovered from that."""
    turns = given(spark, folder, "conversations")
    silent = F.crc32(F.concat_ws(":", "conv_id", "turn")) % 8 == 0
    lines = chat.transcript(turns, "conv_id", "turn", "role", "text", silent)
    model = chat.learn(turns, "conv_id", "turn", "role", "text")
    return chat.render(chat.parse(lines, "conv_id", "line", "text", model, Workspace(spark)))


def op4_warc_revisits(spark, folder):
    return warc.round_trip(given(spark, folder, "pages"), "page_id", "url", "html", Workspace(spark))


def op5_license_scan(spark, folder):
    return licenses.scan(given(spark, folder, "documents"), "doc_id", "text")


def op6_ppm_scoring(spark, folder):
    """A tenth of the documents is held out: those whose crc32 of the id is divisible by 10."""
    learnt = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    return scoring.score(given(spark, folder, "documents"), "doc_id", "text", learnt, Workspace(spark))


def op7_benchmark_decontamination(spark, folder):
    docs, items = given(spark, folder, "documents"), given(spark, folder, "benchmark")
    return decontamination.find(docs, "doc_id", "text", items, "item_id", "text", least_words=1)


def op8_embedding_duplicates(spark, folder):
    return embeddings.near_duplicates(given(spark, folder, "embeddings"), "vec_id", "embedding", "label", Workspace(spark))


def op9_sharding(spark, folder):
    """Documents over shards of at most 64 MiB of text."""
    docs = given(spark, folder, "documents")
    return sharding.assign(docs, ["doc_id"], F.octet_length("text"), SHARD_BYTES, Workspace(spark))


def op10_jaccard_join(spark, folder):
    return jaccard.join(given(spark, folder, "documents"), "doc_id", "text", Workspace(spark))


def regenerated(turns):
    """(turns, convs) as `tries` takes them: every conversation c opens with the first h turns of c - c % 100, and goes on with its
    own after the first h; h is the crc32 of c modulo 6."""
    number = F.col("conv") % 100
    convs = turns.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string")) % 6)
    changed = convs.where((F.col("h") > 0) & (number != 0)).select("conv", "h", (F.col("conv") - number).alias("base"))
    openings = turns.where((number == 0) & (F.col("place") < 5)).withColumnRenamed("conv", "base")
    openings = changed.join(openings, "base").where("place < h").select(*turns.columns)
    taken = changed.join(openings.groupBy("conv").agg(F.count("*").alias("taken")), "conv", "left")
    taken = taken.select("conv", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = turns.join(taken, "conv", "left").where("h IS NULL OR place >= h")
    moved = own.withColumn("place", F.col("place") - F.coalesce(F.col("h") - F.col("taken"), F.lit(0))).select(*turns.columns)
    return moved.unionByName(openings), convs.select("conv")


def op11_prefix_trie(spark, folder):
    ws = Workspace(spark)
    heads = ws.save(tries.heads(given(spark, folder, "conversations"), "conv_id", "turn", "role", "text", ws), "heads")
    turns, convs = regenerated(heads)
    nodes, ends = tries.build(ws.save(turns, "regenerated"), ws.save(convs, "convs"), ws)
    digests = tries.ends_digest(ends)
    return nodes.join(digests, "number", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_collocations(spark, folder):
    return collocations.mine(given(spark, folder, "documents"), "text", "lang", 100, 2000, Workspace(spark))


def op13_language_id(spark, folder):
    """A quarter of the documents is held out: those whose crc32 of the id leaves 2 when divided by 4."""
    docs = given(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    pieces = languages.vocabulary(public_tokenizers.path(PIECES))
    model = languages.learn(docs.where(~held_out), "text", "lang", pieces, Workspace(spark))
    return languages.predict(docs, [F.col("doc_id"), held_out.alias("held_out")], "text", model)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_warc_revisits": op4_warc_revisits,
    "op5_license_scan": op5_license_scan,
    "op6_ppm_scoring": op6_ppm_scoring,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_embedding_duplicates": op8_embedding_duplicates,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    "op4_warc_revisits": """
WITH heads AS (
  SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), known AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original
  FROM heads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM known
""",
    "op9_sharding": f"""
WITH heads AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         lpad(bin(('0x' || substr(md5(hex(CAST(doc_id AS VARCHAR))), 1, 15))::BIGINT), 60, '0') AS address
  FROM documents
), buckets AS (
  SELECT doc_id, bytes, depth, substr(address, 1, depth) AS shard,
         sum(bytes) OVER bucket AS shard_bytes, count(*) OVER bucket AS shard_rows
  FROM heads CROSS JOIN range(61) AS depths(depth)
  WINDOW bucket AS (PARTITION BY depth, substr(address, 1, depth))
)
SELECT doc_id, bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
FROM buckets
WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
  FROM split WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
""",
    "op11_prefix_trie": """
WITH own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), openings AS (
  SELECT c, t, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT for _ in range(8)]),
      lambda bits, _: CASE WHEN bits & 1 = 1 THEN xor(bits >> 1, 3988292384::BIGINT) ELSE bits >> 1 END))) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.t, [])[1:x.h], x.t[x.h + 1:]) AS t FROM openings x LEFT JOIN own b ON b.c = x.c - x.c % 100
), prefixes AS (
  SELECT c, d, t[1:d] AS p, len(t) AS turns FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)
), members AS (
  SELECT c, d, p, turns, min(c) OVER (PARTITION BY d, p) AS conv_id FROM prefixes
), nodes AS (
  SELECT conv_id, d AS depth, count(*) AS n_convs, any_value(coalesce(length(p[d].text), 0)) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE turns = d), '')) AS ends_sha256
  FROM members GROUP BY conv_id, d
), above AS (
  SELECT n.conv_id, n.depth, n.n_convs, n.chars, m.conv_id AS a_conv, m.d AS a_depth,
         NOT EXISTS (FROM members k JOIN members l ON l.c = k.c AND l.d = k.d - 1
                     WHERE k.d = n.depth + 1 AND l.conv_id = n.conv_id) AS leaf
  FROM nodes n JOIN members m ON m.c = n.conv_id AND m.d <= n.depth
), totals AS (
  SELECT a_conv AS conv_id, a_depth AS depth, count(*) FILTER (WHERE depth = a_depth + 1) AS n_children,
         count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens
  FROM above GROUP BY a_conv, a_depth
)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes n JOIN totals USING (conv_id, depth) LEFT JOIN members m ON m.c = n.conv_id AND m.d = n.depth - 1
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), runs AS (
  SELECT lang, w[i:i + m - 1] AS p FROM starts CROSS JOIN range(1, 6) AS lengths(m) WHERE i + m - 1 <= len(w)
), known AS (
  SELECT lang, p, count(*) AS f FROM runs GROUP BY lang, p HAVING count(*) >= 100
), kept AS (
  SELECT * FROM known c WHERE len(p) > 1 AND NOT EXISTS (
    SELECT 1 FROM known x WHERE x.lang = c.lang AND len(x.p) > len(c.p) AND 100 * x.f >= 100 * c.f
      AND contains(' ' || array_to_string(x.p, ' ') || ' ', ' ' || array_to_string(c.p, ' ') || ' '))
), cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM kept
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, t.n,
         CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN known x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN known y ON y.lang = c.lang AND y.p = c.p[k + 1:]
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
""",
}
