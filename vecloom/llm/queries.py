"""The queries of this folder's operators, each over its whole table, with its result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm import align, chat, collocations, cover_tree, decontaminate, lm_score, merkle, mixing, packing, rules, secret_scan, simhash, subwords, token_orc
from vecloom.llm.text import crc_mod
from vecloom.session import scratch_path, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tokenizer's file, a parameter of whatever encodes.
BYTE_BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Words of a text, A-Z lowered, as SQL.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"[x FOR x IN regexp_split_to_array({LOWERED}, '[\\x20\\x09-\\x0D]+') IF x <> '']"


@query(
    "op1_cover_tree_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", cover_tree.quantized("embedding").alias("v"))
    return cover_tree.top_k(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


@query("op2_budget_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean, plan = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixing.with_copies(lean, plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op3_token_orc")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, subwords.load(BYTE_BPE))
    return token_orc.token_index(token_orc.read_tokens(spark, path))


@query("op4_secret_entropy")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


@query("op5_rule_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rules.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    found = rules.scored(docs, model).withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= rules.THRESHOLD).cast("int").alias("predicted"))


@query(
    "op6_decontaminate",
    f"""
    WITH d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), b AS (SELECT item_id AS id, {WORDS} AS w FROM benchmark),
    ds AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 4) + 1)]) AS s FROM d WHERE len(w) > 0),
    bs AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(1, len(w) - 4) + 1)]) AS s FROM b WHERE len(w) > 0),
    n AS (SELECT id, count(*) AS q FROM bs GROUP BY id)
    SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS shared, any_value(q) AS item_shingles, count(*) / any_value(q) AS containment
    FROM ds JOIN bs USING (s) JOIN n ON n.id = bs.id GROUP BY ds.id, bs.id HAVING count(*) >= ceil(0.8 * any_value(q) - 1e-9)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


CONVERSATION = "SELECT conv_id, list({'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, role, text) AS a FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"
RENDERED = "array_to_string([concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10)) FOR t IN {0}], '')"


@query(
    "op8_preference_format",
    f"""
    WITH c AS ({CONVERSATION}),
    l AS (SELECT *, list_max([i FOR i IN range(1, len(a) + 1) IF a[i].role = 'assistant']) AS last FROM c),
    p AS (SELECT l.conv_id, l.a, l.last, o.a[o.last].text AS reply FROM l LEFT JOIN l o ON o.conv_id = xor(l.conv_id, 1)),
    b AS (SELECT conv_id, a, [CASE WHEN i = last THEN {{'turn': a[i].turn, 'role': a[i].role, 'text': coalesce(reply, '')}} ELSE a[i] END FOR i IN range(1, len(a) + 1)] AS r FROM p),
    k AS (SELECT *, coalesce(list_min([i FOR i IN range(1, len(a) + 1) IF a[i].role <> r[i].role OR a[i].text <> r[i].text]) - 1, len(a)) AS k FROM b),
    t AS (SELECT conv_id, k, a[1:k] AS p, a[k + 1:] AS c, r[k + 1:] AS r FROM k),
    m AS (
        SELECT conv_id, side, string_agg(concat(stop - len(text) - 11, ':', stop), ',' ORDER BY i) FILTER (role = 'assistant') AS mask
        FROM (SELECT conv_id, side, i, x.role AS role, x.text AS text, sum(24 + len(x.role) + len(x.text)) OVER (PARTITION BY conv_id, side ORDER BY i) AS stop
              FROM (SELECT conv_id, 'c' AS side, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM t UNION ALL SELECT conv_id, 'r', unnest(range(1, len(r) + 1)), unnest(r) FROM t))
        GROUP BY conv_id, side
    )
    SELECT conv_id, k::INTEGER AS prompt_turns, {RENDERED.format("p")} AS prompt, {RENDERED.format("c")} AS chosen, {RENDERED.format("r")} AS rejected,
           coalesce(mc.mask, '') AS chosen_mask, coalesce(mr.mask, '') AS rejected_mask, len(c) > 0 OR len(r) > 0 AS differs
    FROM t LEFT JOIN (FROM m WHERE side = 'c') mc USING (conv_id) LEFT JOIN (FROM m WHERE side = 'r') mr USING (conv_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.swapped_replies(chat.conversations(table(spark, sf_dir, "conversations"))))


@query("op9_attention_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"), lm_score.load(RANKS, public_tokenizers.PATTERN))


#: The second replica of the pages: some payloads have another first byte, some lack their end, some records are lost.
DAMAGED = "CASE WHEN page_id % 97 = 5 THEN concat('#', substr(html, 2)) WHEN page_id % 193 = 7 THEN substr(html, 1, length(html) - 9) ELSE html END"
LOST = "page_id % 389 = 11"


def _record(payload: str) -> str:
    cr = "chr(13) || chr(10)"
    return (
        f"'WARC/1.0' || {cr} || 'WARC-Type: resource' || {cr} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {cr} || 'WARC-Target-URI: ' || coalesce(url, '') || {cr} "
        f"|| 'Content-Type: text/html' || {cr} || 'Content-Length: ' || strlen({payload}) || {cr} || {cr} || {payload} || {cr} || {cr}"
    )


@query(
    "op10_merkle_fixity",
    f"""
    WITH r AS (SELECT page_id, {_record("coalesce(html, '')")} AS a, {_record(f"coalesce({DAMAGED}, '')")} AS b FROM pages),
    h AS (SELECT page_id, sha256(a) AS first_hash, CASE WHEN {LOST} THEN NULL ELSE sha256(b) END AS second_hash, strlen(a) AS n FROM r),
    o AS (SELECT *, row_number() OVER (ORDER BY page_id, first_hash) - 1 AS i FROM h),
    p AS (SELECT *, i // 4096 AS archive, i % 4096 AS ordinal FROM o),
    s AS (SELECT *, sum(n) OVER (PARTITION BY archive ORDER BY ordinal) AS stop FROM p)
    SELECT archive, ordinal, (stop - n)::BIGINT AS start, stop::BIGINT AS stop, CASE WHEN second_hash IS NULL THEN 'missing' ELSE 'changed' END AS status, first_hash, second_hash, page_id
    FROM s WHERE second_hash IS NULL OR first_hash <> second_hash
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    own, other = (merkle.warc_record(F.col("page_id"), F.col("url"), c) for c in (F.col("html"), F.expr(DAMAGED)))
    records = pages.select(
        F.col("page_id").alias("record_id"), merkle.record_hash(own).alias("tie"), F.octet_length(own).cast("long").alias("length"),
        F.when(~F.coalesce(F.expr(LOST), F.lit(False)), merkle.record_hash(other)).alias("copy"),
    )
    placed = snapshot(merkle.layout(records), "layout")
    trees = [merkle.merkle_tree(placed.select("archive", "ordinal", "start", "stop", F.col(c).alias("hash"))) for c in ("tie", "copy")]
    return merkle.audit(*trees).join(placed.select("archive", "ordinal", F.col("record_id").alias("page_id")), ["archive", "ordinal"], "left")


@query(
    "op11_phrase_collocations",
    """
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    w AS (SELECT lang, [x FOR x IN regexp_split_to_array(p, '[\\x20\\x09]+') IF x <> ''] AS w FROM p),
    g AS (SELECT lang, k AS words, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k)),
    f AS (SELECT lang, words, phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, words, phrase),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
    c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 100),
    i AS (SELECT lang, words, a, unnest([array_to_string(w[x:x + m - 1], ' ') FOR x IN range(1, words - m + 2)]) AS phrase FROM (SELECT *, unnest(range(2, words)) AS m FROM c)),
    d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN i USING (lang, phrase) WHERE 100 * i.a >= 100 * c.a),
    k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, words)) AS k FROM c) ANTI JOIN d USING (lang, phrase)),
    s AS (
        SELECT k.lang, k.phrase, k.a, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * k.a * n.n) // (x.f::HUGEINT * y.f) AS score, k.k
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y JOIN n ON n.lang = k.lang
    ),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_mixture_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), subwords.load(BYTE_BPE), digest=True)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.pair_scores(table(spark, sf_dir, "documents"), align.specs(BYTE_BPE, PIECES)).withColumnRenamed("groups", "groups_sha256")


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLE |= {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
