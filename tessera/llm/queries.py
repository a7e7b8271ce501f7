"""Registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.session import ensure_checkpoint_dir

from . import chat, divergence, interpolated_lm, license_scan, mixing, packing, pivot_search, quality, sharding, simhash, toxicity, vector_codes, warc_zstd

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op4_mix_sources", r"""WITH s AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
q AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
k AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS cap FROM q),
o AS (SELECT *, cap / w AS ratio, row_number() OVER u AS m, coalesce(sum(cap) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total
      FROM k WINDOW u AS (ORDER BY cap / w, source)),
v AS (SELECT (total - capped) / rest AS level FROM o WHERE (total - capped) / rest <= ratio ORDER BY m LIMIT 1),
t AS (SELECT source, source_size, least(cap, w * v.level)::DOUBLE AS target FROM k, v),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5(concat_ws(':', '17', s.doc_id::VARCHAR, s.text)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (floor(rate) + (draw < rate - floor(rate))::INTEGER)::BIGINT AS copies,
       size * (floor(rate) + (draw < rate - floor(rate))::INTEGER)::BIGINT AS taken FROM r""")
def op4_mix_sources(spark, sf_dir):
    """Documents mixed by weights 5, 2, 1 over their sources, three repeats at most."""
    out = mixing.mix_decisions(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.round("__mix_target", 6).alias("target"),
                      (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"), F.col("__mix_copies").alias("copies"))


@register("op5_shards")
def op5_shards(spark, sf_dir):
    """Documents shuffled uniformly into 16 shards whose counts differ by one at most."""
    out = sharding.assign_shards(read(spark, sf_dir, "documents"), 16)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
                      F.col("__shard").cast("int").alias("shard"), F.col("__shard_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@register("op10_warc_zstd", """WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
k AS (SELECT page_id, strlen(x) AS n, sha256(x) AS d FROM p),
f AS (SELECT d, min(page_id) AS first_id FROM k WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, k.d AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM k LEFT JOIN f ON k.d = f.d""")
def op10_warc_zstd(spark, sf_dir):
    """Pages written as WARC archives compressed by Zstandard, and the records read back from them."""
    return warc_zstd.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_BAD_LINE = r"""(len(regexp_extract_all(x, '[#*$%&|<>{}\\^~=_]')) > length(x) * 0.08
  OR len(list_filter(WORDS, lambda w: regexp_matches(w, '[!?]{2,}$'))) * 100 > len(WORDS) * 20.0
  OR greatest(SEPARATORS * 100 - len(WORDS) * 5, 0) * greatest(SEPARATORS - 1, 0) > 0
  OR regexp_matches(x, 'MENU') OR (regexp_matches(x, 'BOILERPLATE') AND len(WORDS) <= 20))"""
#: A line without its quotations and barred values. White space is doubled, as neighbouring values share it, and a barred
#: value leaves chr(1) until the quotations are gone.
_BARE = r"""regexp_replace(regexp_replace(regexp_replace(x, '([\x20\x09-\x0D])', '\1\1', 'g'), '(^|[\x20\x09-\x0D(])\|[^|\x20\x09-\x0D]+\|([\x20\x09-\x0D.,;:!?)]|$)', '\1' || chr(1) || '\2', 'g'),
  '«[^|»«›‹•·\x01]*»|»[^|»«›‹•·\x01]*«|‹[^|»«›‹•·\x01]*›|›[^|»«›‹•·\x01]*‹', '', 'g')"""
_SEPARATORS = f"(len(regexp_extract_all({_BARE}, '[|»«›‹•·]')) + len(list_filter({_WORDS.format(_BARE)}, lambda w: w = '>')))"
_BAD_LINE = (_BAD_LINE.replace("SEPARATORS", _SEPARATORS).replace("WORDS", _WORDS.format("x")).replace("BOILERPLATE", quality.BOILERPLATE)
             .replace("MENU", quality.MENU_LINE.replace("*+", "*").replace("++", "+")))


@register("op3_quality_rules", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, {_WORDS.format("text")} AS words FROM d),
w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM l),
g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS gram
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS dup FROM g),
r AS (SELECT doc_id, sum(cov)::BIGINT AS n_repeat_words FROM (SELECT doc_id, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS cov FROM c) GROUP BY doc_id),
f AS (SELECT doc_id, text, words, list_filter(lines, lambda x: len({_WORDS.format("x")}) > 0) AS spoken,
             array_to_string(list_filter(lines, lambda x: len({_WORDS.format("x")}) = 0 OR NOT {_BAD_LINE}), chr(10)) AS clean FROM l),
n AS (SELECT f.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(spoken) - len(list_distinct(spoken)) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
             1 - length(clean)::DOUBLE / greatest(length(text), 1) AS lost FROM f LEFT JOIN r ON r.doc_id = f.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.4 AS kept, round(lost, 6) AS lost_share FROM b""")
def op3_quality_rules(spark, sf_dir):
    """Base counts and the line-first verdict for every document."""
    out = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *[F.col("__quality_" + n).alias(n) for n in names], F.round("__quality_lost", 6).alias("lost_share"))


def _license_sql() -> str:
    """The scan with phrases and notices as values; places, diagonals and spans are relational on both sides."""
    quote = lambda t: t.replace("'", "''")
    rows = [(f"phrase:{n}", n, "true", t) for n, t in license_scan.PHRASES.items()] + [(f"text:{n}", n, "false", t) for n, t in license_scan.TEMPLATES.items()]
    values = ", ".join(f"('{a}', '{b}', {c}, '{quote(t)}')" for a, b, c, t in rows)
    words = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    grams = "unnest(list_transform(range(len(words) - 2), lambda i: concat_ws(' ', words[i + 1], words[i + 2], words[i + 3])))"
    return f"""WITH d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS words FROM documents),
g AS (SELECT doc_id, unnest(range(len(words) - 2)) AS place, {grams} AS gram FROM d),
t AS (SELECT template, label, base, {words.format("text")} AS words FROM (VALUES {values}) v(template, label, base, text)),
tg AS (SELECT template, label, base, len(words) AS length, unnest(range(len(words) - 2)) AS t_place, {grams} AS gram FROM t),
vote AS (SELECT DISTINCT doc_id, template, label, base, length, place, t_place, place - t_place AS diagonal FROM g JOIN tg USING (gram)),
diag AS (SELECT doc_id, template, label, base, length, diagonal, count(*) AS votes, min(place) AS first, max(place) + 2 AS last FROM vote GROUP BY ALL),
whole AS (SELECT doc_id, template, label, base, diagonal AS first, last, 1.0::DOUBLE AS score FROM diag WHERE base AND votes = length - 2),
far AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 4 THEN 1 ELSE 0 END AS far FROM diag WHERE NOT base),
span AS (SELECT doc_id, template, diagonal, sum(far) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM far),
seen AS (SELECT v.*, s.span, least(3, greatest(0, t_place + 3 - coalesce(max(t_place + 3) OVER (PARTITION BY v.doc_id, v.template, s.span ORDER BY place, t_place
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS new FROM vote v JOIN span s ON s.doc_id = v.doc_id AND s.template = v.template AND s.diagonal = v.diagonal WHERE NOT v.base),
merged AS (SELECT doc_id, template, label, base, min(place) AS first, max(place) + 2 AS last, sum(new)::DOUBLE / length AS score FROM seen GROUP BY doc_id, template, label, base, length, span HAVING sum(new)::DOUBLE / length >= 0.6),
apart AS (SELECT *, CASE WHEN first > max(last) OVER (PARTITION BY doc_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS apart FROM merged),
clustered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS cluster FROM apart),
best AS (SELECT *, max(score) OVER (PARTITION BY doc_id, cluster) AS best FROM clustered),
spans AS (SELECT doc_id, label, base, first, score FROM whole UNION ALL SELECT doc_id, label, base, first, score FROM best WHERE score = best),
found AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
                 coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ','), '') AS base_labels,
                 array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0.0), 6) AS score, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN found ON found.doc_id = d.doc_id"""


@register("op6_license_scan", _license_sql())
def op6_license_scan(spark, sf_dir):
    """License phrases and notices in every document."""
    out = license_scan.label(*license_scan.scan(read(spark, sf_dir, "documents")))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"), "n_spans")


@register("op2_chat_snapshots", r"""WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
             count(*) OVER (PARTITION BY conv_id) AS n,
             md5(coalesce('r' || role, 'null') || chr(0) || coalesce('t' || text, 'null')) AS h,
             '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS part FROM u),
p AS (SELECT conv_id, pos, n, part, md5(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS prefix FROM t),
w AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY n, prefix),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = w.n AND p.prefix = w.prefix AND p.n > w.n))
SELECT p.conv_id, k.n AS n_turns, k.copies, (p.pos - 1) // 1024 AS piece, min(p.pos) - 1 AS first_turn, string_agg(p.part, '' ORDER BY p.pos) AS rendered
FROM p JOIN k ON p.conv_id = k.conv_id GROUP BY p.conv_id, k.n, k.copies, (p.pos - 1) // 1024""")
def op2_chat_snapshots(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat.render_chat(read(spark, sf_dir, "conversations"))


@register("op1_simhash_dedup")
def op1_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document: 3-word shingles, 2 bits at most."""
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    """Documents tokenized and packed into sequences of at most 2048 tokens."""
    return packing.pack(packing.token_pieces(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


@register("op9_pivot_top_k", """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op9_pivot_top_k(spark, sf_dir):
    """The 10 best inner products of every hundredth vector with all others."""
    return pivot_search.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@register("op8_interpolated_lm")
def op8_interpolated_lm(spark, sf_dir):
    """Scores of all documents under a bigram model learned from six sevenths of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    out = interpolated_lm.score(read(spark, sf_dir, "documents"), ~held_out)
    return out.select(F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op11_source_divergence", r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, term),
k AS (SELECT lang, term FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM u),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM u GROUP BY lang, term)),
f AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source) s
      ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q)) // q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200""")
def op11_source_divergence(spark, sf_dir):
    """Divergence of every source from the others of its language, and its 200 most overused terms."""
    return divergence.divergences(read(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """Two rounds of moved codebooks, written out."""
    assign = lambda cb: f"""SELECT r, part, min([list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, k]) AS best
  FROM p JOIN {cb} USING (part) GROUP BY r, part"""  # noqa: E731
    move = lambda cb, a: f"""SELECT b.part, b.k, coalesce(m.c, b.c) AS c FROM {cb} b LEFT JOIN (SELECT part, k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c
  FROM (SELECT part, best[2] AS k, j, sum(x[j + 1])::BIGINT AS s, count(*) AS n FROM {a} JOIN p USING (r, part), range((SELECT dim // 16 FROM size)) q(j) GROUP BY part, best[2], j) GROUP BY part, k) m
  ON m.part = b.part AND m.k = b.k"""  # noqa: E731
    return f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT max(len(e)) AS dim FROM v),
p AS (SELECT r, part::INTEGER AS part, e[part * (dim // 16) + 1 : (part + 1) * (dim // 16)] AS x FROM v, size, range(16) t(part)),
f AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v),
b0 AS (SELECT part, k, x AS c FROM p JOIN f USING (r) WHERE k < 64),
a0 AS ({assign("b0")}),
b1 AS ({move("b0", "a0")}),
a1 AS ({assign("b1")}),
b2 AS ({move("b1", "a1")}),
a2 AS ({assign("b2")}),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b2),
o AS (SELECT r, string_agg(lower(lpad(to_hex(best[2]), 2, '0')), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"""


@register("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark, sf_dir):
    """Product codes of all vectors: 16 parts, 64 entries each, two rounds."""
    coded, codebooks = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    out = vector_codes.with_label_error(coded)
    code = F.array_join(F.transform("__vc_code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), F.col("__vc_error").alias("error"), F.col("__vc_label_error").alias("label_error"), F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


@register("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labels of four fifths of the ids."""
    fold = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), fold != 0)
    out = toxicity.score(docs.withColumnRenamed("doc_id", "id"), model)
    return out.select(F.col("id").alias("doc_id"), (fold == 0).alias("held_out"), F.col("__tox_score").alias("score"), (F.col("__tox_score") >= 0.5).cast("int").alias("predicted"))
