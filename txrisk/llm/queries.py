"""The registered query of each text operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import audit, bpe, centroids, chat, decontaminate, gam, lattice, linededup, quality, sharding, simhash, tokenfile, warc
from txrisk.llm.common import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOPS = ", ".join(f"'{w}'" for w in quality._forms(quality.STOP_WORDS))
_BLANK_SQL = "(chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"


@query(rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
u AS (SELECT r, unnest(w) AS w, unnest(generate_series(1, len(w))) AS p FROM w),
g AS (SELECT r, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY r ORDER BY p)),
h AS (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
s AS (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM h WHERE n > 1),
rep AS (SELECT r, sum(least(3, coalesce(q - p, 3))) AS n FROM s GROUP BY r),
l AS (SELECT r, unnest(string_split(x, chr(10))) AS l FROM t),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM l
       WHERE trim(l, {_BLANK_SQL}) <> '' GROUP BY r),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(translate(x, {_BLANK_SQL}, ''))::BIGINT AS word_chars,
        (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        coalesce(ln.d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        coalesce(ln.n, 0)::BIGINT AS n_lines,
        len(list_filter(w.w, lambda v: v IN ({_STOPS})))::BIGINT AS n_stop,
        (length(x) - length(translate(x, '!', '')))::BIGINT AS n_shout
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars BETWEEN 2.5 * n_words AND 12 * n_words AND n_symbols <= 0.1::DOUBLE * n_words
   AND n_stop >= 0.03::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines AND n_shout <= 0.2::DOUBLE * n_words) AS kept
FROM b""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged, q = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"{q}.{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded, ids = bpe.encode(docs, path, pattern)
    back, raw = bpe.decode(coded, path, pattern, ids)
    return back.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.col(raw), 256).alias("decoded_sha256"))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS x, md5(coalesce(text, '')) AS th
           FROM documents),
l AS (SELECT r, doc_id, th, unnest(string_split(x, chr(10))) AS line,
        unnest(generate_series(0, len(string_split(x, chr(10))) - 1)) AS no FROM t),
w AS (SELECT r, doc_id, th, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
g AS (SELECT *, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, th, no) AS pos FROM w WHERE len(w) > 0),
f AS (SELECT w, min(pos) AS first FROM g GROUP BY w),
k AS (SELECT w, first, len(w) AS n, w[1:4] AS c FROM f WHERE len(w) >= 8
      UNION ALL SELECT w, first, len(w), w[-4:] FROM f WHERE len(w) >= 8),
pair AS (SELECT DISTINCT a.w, b.w AS o, a.n, b.n AS m FROM k AS a JOIN k AS b ON a.c = b.c AND b.first < a.first AND abs(a.n - b.n) <= 1),
same AS (SELECT *, coalesce(list_position(list_transform(generate_series(1, greatest(n, m)), lambda i: w[i] IS NOT DISTINCT FROM o[i]), false), 0) AS p
         FROM pair),
near AS (SELECT DISTINCT w FROM same WHERE p = 0 OR w[p + 1:] = o[p + 1:] OR w[p + 1:] = o[p:] OR w[p:] = o[p + 1:]),
dropped AS (SELECT DISTINCT g.r, g.no FROM g JOIN f ON g.w = f.w LEFT JOIN near ON near.w = g.w
            WHERE g.pos > f.first OR near.w IS NOT NULL),
kept AS (SELECT w.r, string_agg(w.line, chr(10) ORDER BY w.no) AS text FROM w LEFT JOIN dropped AS d ON d.r = w.r AND d.no = w.no
         WHERE d.r IS NULL GROUP BY w.r),
n AS (SELECT r, count(*) AS n FROM dropped GROUP BY r)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_dropped,
       CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM t LEFT JOIN kept USING (r) LEFT JOIN n USING (r)""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand, up to one word, earlier in the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done, drops = linededup.dedup_lines(docs)
    return done.select("doc_id", F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"), "text")


@query(r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w
           FROM documents),
b AS (SELECT row_number() OVER () AS j, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w
      FROM benchmark),
dw AS (SELECT r, unnest(w) AS w, unnest(generate_series(1, len(w))) AS p FROM d),
bw AS (SELECT j, len(w) AS n, unnest(w) AS w, unnest(generate_series(1, len(w))) AS q FROM b WHERE len(w) >= 4),
dg AS (SELECT r, p, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM dw
       WINDOW x AS (PARTITION BY r ORDER BY p)),
bg AS (SELECT j, q, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM bw
       WINDOW x AS (PARTITION BY j ORDER BY q)),
diag AS (SELECT DISTINCT r, j, p - q AS o FROM dg JOIN bg USING (w, w2, w3, w4)),
eq AS (SELECT diag.r, diag.j, o, bw.q, bw.n, CASE WHEN dw.w = bw.w THEN 1 ELSE 0 END AS e
       FROM diag JOIN bw ON bw.j = diag.j JOIN dw ON dw.r = diag.r AND dw.p = bw.q + diag.o),
win AS (SELECT r, j, o, q, n, sum(e) OVER x AS s, count(*) OVER x AS c FROM eq
        WINDOW x AS (PARTITION BY r, j, o ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT doc_id, item_id, max(s)::BIGINT AS equal_words, min(q + o - 1)::BIGINT AS first_word
FROM win JOIN d USING (r) JOIN b USING (j)
WHERE c = least(13, n) AND s >= CASE WHEN n >= 13 THEN 11 WHEN n >= 10 THEN n - 1 ELSE n END
GROUP BY doc_id, item_id""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
w AS (SELECT page_id, h, strlen(h)::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM w""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive and put back from it."""
    path = shared_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    back = warc.rebuilt(warc.read_records(spark, path))
    told = warc.parsed(F.col("record"))
    size = F.octet_length("payload").cast("long")
    return back.select("page_id", size.alias("payload_bytes"), F.substring_index(told["digest"], ":", -1).alias("payload_digest"),
                       told["record_type"].alias("record_type"), "refers_to")


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back from them."""
    path = shared_path(spark, "tokens")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    back = tokenfile.read_tokens(spark, path)
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query()
def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-unigram and subword-lattice log10 probabilities of every document."""
    return lattice.score_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fold."""
    return gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text,
             md5(concat(strlen(coalesce('=' || role, '0')), coalesce('=' || role, '0'), coalesce('=' || text, '0'))) AS c
           FROM conversations),
l AS (SELECT conv_id, list(c ORDER BY turn NULLS FIRST, c) AS l FROM t GROUP BY conv_id),
e AS (SELECT l, count(*) AS copies, min(conv_id) AS conv_id FROM l GROUP BY l),
k AS (SELECT a.conv_id, a.copies FROM e AS a WHERE NOT EXISTS (
        SELECT 1 FROM e AS b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l)),
r AS (SELECT k.conv_id, k.copies, '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10)
             || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS shown,
             row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn NULLS FIRST, t.c) - 1 AS p, t.turn, t.c
      FROM k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id),
s AS (SELECT *, (sum(strlen(shown)) OVER (PARTITION BY conv_id ORDER BY p) - strlen(shown)) // 134217728 AS piece FROM r)
SELECT conv_id, min(p) AS part, count(*) AS n_turns, any_value(copies) AS copies, string_agg(shown, '' ORDER BY p) AS text
FROM s GROUP BY conv_id, p // 1024, piece""")
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


_ORDERS = """(SELECT a || b || c || d || e AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t1(a),
   (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t2(b), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t3(c),
   (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t4(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t5(e)
   WHERE len(list_distinct([a, b, c, d, e])) = 5)"""


@query(rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * (length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g'))) > 2 * length(t.x) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t.x, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
      FROM t JOIN m ON t.x = m.x LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM {_ORDERS}),
o AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM s),
r AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (translate(fails, earlier || own, '') = fails), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, earlier, '') <> fails), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (contains(fails, own) AND translate(fails, earlier, '') = fails), 0)::BIGINT AS toxic_lost
      FROM o CROSS JOIN c GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every step of every order of five filters does, for every source."""
    marks = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), marks)


def _round_sql(i: int) -> str:
    """One move of the centroids: c{i} from c{i-1}."""
    return f"""
d{i} AS (SELECT r, v, no, list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT AS d
         FROM vectors CROSS JOIN c{i - 1}),
a{i} AS (SELECT v, no FROM (SELECT v, no, row_number() OVER (PARTITION BY r ORDER BY d, no) AS place FROM d{i}) WHERE place = 1),
u{i} AS (SELECT no, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{i}),
s{i} AS (SELECT no, j, sum(x)::HUGEINT AS s, count(*) AS n FROM u{i} GROUP BY ALL),
m{i} AS (SELECT no, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY no),
c{i} AS (SELECT no, coalesce(m{i}.c, c{i - 1}.c) AS c FROM c{i - 1} LEFT JOIN m{i} USING (no))"""


@query(f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64),
vectors AS (SELECT row_number() OVER () AS r, vec_id,
              list_transform(e, lambda x: floor(greatest(least(64 * x, 134217728.0), -134217728.0))::BIGINT) AS v
            FROM k WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS no, v AS c
       FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM vectors ORDER BY h, v LIMIT 16)),
{_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)},
d AS (SELECT r, vec_id, no, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT AS distance
      FROM vectors CROSS JOIN c3),
a AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, no) AS place FROM d)
SELECT vec_id, no::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY no))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a WHERE place = 1""")
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and the cluster's figures of every whole vector."""
    assigned, found = centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed="1", dims=64, scale=64)
    told = centroids.with_inertia(assigned, len(found))
    digests = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in found]) if found else F.array(F.lit(""))
    return told.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                       F.get(digests, F.col("cluster")).alias("centroid_sha256"))


def _curve_sql() -> str:
    """The curve index of three bins of five bits, one level a step, by the tables that ``sharding`` derives."""
    digits, inner = sharding.curve_table(3)
    steps, last = [], "b"
    for level in reversed(range(5)):
        corner = f"((b1 >> {level}) & 1) + 2 * ((b2 >> {level}) & 1) + 4 * ((b3 >> {level}) & 1)"
        steps.append(f"h{level} AS (SELECT * REPLACE (h * 8 + {digits}[o * 8 + {corner} + 1] AS h, {inner}[o * 8 + {corner} + 1] AS o) FROM {last})")
        last = f"h{level}"
    return ",\n".join(steps)


def _bin_sql(c: str) -> str:
    digit = lambda i: f"(instr('0123456789abcdef', substr(md5(coalesce('=' || {c}, '')), {i}, 1)) - 1)"
    return f"((16 * {digit(1)} + {digit(2)}) % 32)"


_CRC_TABLE = """(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(i)))"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 1 AS size, lang, source FROM documents),
b AS (SELECT doc_id, x, size, md5(x) AS digest, {_bin_sql('lang')} AS b1, {_bin_sql('source')} AS b2,
        least(length(bin(size)) - 1, 31) AS b3, 0::BIGINT AS h, 0 AS o FROM d),
{_curve_sql()},
n AS (SELECT *, row_number() OVER (ORDER BY h, digest, doc_id NULLS FIRST) - 1 AS p, count(*) OVER () AS total FROM h0),
s AS (SELECT doc_id, size, x, (p * 8) // total AS shard, p FROM n),
t AS (SELECT {_CRC_TABLE} AS crc),
u AS (SELECT DISTINCT x FROM d),
y AS (SELECT x, list_transform(regexp_extract_all(hex(x), '..'), lambda v: 16 * (instr('0123456789ABCDEF', v[1]) - 1)
        + instr('0123456789ABCDEF', v[2]) - 1) AS bytes FROM u),
k AS (SELECT x, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1])), 4294967295) AS crc32 FROM y, t)
SELECT doc_id, size::BIGINT AS size, crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
       p - min(p) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM s JOIN k ON s.x = k.x""")
def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, written in curve order and read back."""
    docs, path = _table(spark, sf_dir, "documents"), shared_path(spark, "shards")
    sharding.write_shards(docs, path, sharding.document_dims(docs), shards=8)
    return sharding.read_placed(spark, path).select(
        F.col("id").alias("doc_id"), "size", F.col("crc32").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
