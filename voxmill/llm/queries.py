"""The registered queries of the text operators: thin, over whole tables."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import align, audio, chat, decontaminate, lm, mixing, negatives, packing, quality, repeats, secrets, simhash, tokens

#: Where the public vocabulary files lie.
TOKENIZERS = "public_tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return audio.search(audio.played(vectors), audio.played(vectors.where("vec_id % 100 = 0"), part=True))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.interpolated_scores(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.LEVELS, mixing.WEIGHTS)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return chat.digests(chat.format_messages(chat.event_log(turns.unionByName(more))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is filled first and met by a second run, as it is by each later one."""
    path = str(files(TOKENIZERS) / "byte_bpe_50k.json")
    docs, cache = table(spark, sf_dir, "documents"), tokens.empty_cache(spark)
    tokens.add_misses(docs, path, cache)
    return tokens.token_counts(docs, path, cache)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (str(files(TOKENIZERS) / name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align_documents(table(spark, sf_dir, "documents"), a, b)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), str(files(TOKENIZERS) / "byte_bpe_50k.json"), end=2, ids=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one; anchors are the ids divisible by 50."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    x.__name__: x
    for x in (
        op1_quality_resample,
        op2_audio_fingerprints,
        op3_decontaminate,
        op4_secret_scan,
        op5_lm_score,
        op6_mix_sources,
        op7_substring_dedup,
        op8_chat_format,
        op9_token_counts,
        op10_simhash_near_dedup,
        op11_token_alignment,
        op12_best_fit_packing,
        op13_hard_negatives,
    )
}

#: Windows of 50 words; those that start in a document with a smaller id take their words away.
SUBSTRING_DEDUP = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM places),
firsts AS (SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hits),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM split),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(CASE WHEN g.p IS NULL THEN w.word END, ' ' ORDER BY w.p), '') AS kept
 FROM each_word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
"""

#: A turn is rendered with 13 characters of its own; \ and < (in roles also |) are written with one more.
CHAT_FORMAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
sized AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) + 13 AS size FROM turns),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
 coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size) AS size FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, size::BIGINT AS formatted_chars FROM whole
"""



def share_sql(levels: list[str], weight: str) -> str:
    """Budgets b_k of the nodes of level k = len(levels) from those of the level above: children fill up in the order of cap / weight (in millionths)."""
    k, names, parent = len(levels), ", ".join(levels), ", ".join(levels[:-1]) or "1"
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in levels[:-1]) or "true"
    w = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / weight::DOUBLE, {levels[-1]} NULLS FIRST ROWS BETWEEN"
    return f"""n{k} AS (SELECT {names}, (sum(leaf_tokens) * 2)::HUGEINT AS cap, round({weight} * 1000000)::HUGEINT AS weight FROM leaves GROUP BY {names}),
j{k} AS (SELECT n.*, p.budget AS total FROM n{k} n JOIN b{k - 1} p ON {on}),
s{k} AS (SELECT *, coalesce(sum(cap) OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, sum(weight) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM j{k}),
f{k} AS (SELECT *, cap * after <= (total - before) * weight AS is_full FROM s{k}),
r{k} AS (SELECT *, total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS rest, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open_, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f{k}),
b{k} AS (SELECT {names}, (CASE WHEN is_full THEN cap ELSE (rest * upto)::HUGEINT // open_::HUGEINT - (rest * (upto - weight))::HUGEINT // open_::HUGEINT END)::BIGINT AS budget FROM r{k})"""


#: Budgets down the tree of domain, lang and source; whole epochs, then a prefix of the next one's order.
MIX_SOURCES = rf"""
WITH sizes AS (SELECT doc_id, 'domain' || coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1), '') AS INT) % 4, 0) AS domain, lang, source,
 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
taken AS (SELECT * FROM sizes WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens FROM taken GROUP BY ALL),
b0 AS (SELECT floor(sum(leaf_tokens)::DOUBLE * 0.6::DOUBLE)::BIGINT AS budget FROM leaves),
{share_sql(["domain"], "(CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END)::DOUBLE")},
{share_sql(["domain", "lang"], "(CASE lang WHEN 'en' THEN 2 ELSE 1 END)::DOUBLE")},
{share_sql(["domain", "lang", "source"], "1::DOUBLE")},
placed AS (SELECT t.*, b.budget // l.leaf_tokens AS whole, b.budget % l.leaf_tokens AS part FROM taken t
 JOIN leaves l ON t.domain = l.domain AND t.lang IS NOT DISTINCT FROM l.lang AND t.source IS NOT DISTINCT FROM l.source
 JOIN b3 b ON t.domain = b.domain AND t.lang IS NOT DISTINCT FROM b.lang AND t.source IS NOT DISTINCT FROM b.source),
starts AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('42:' || whole || ':' || doc_id), 1, 15))::BIGINT, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_ FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, e::INT AS epoch, n_tokens AS take_tokens FROM placed, range(2) AS t(e) WHERE e < whole
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole::INT AS epoch, least(n_tokens, part - begin_)::BIGINT AS take_tokens FROM starts WHERE begin_ < part
"""

#: All scores of all anchors, as brute force does it.
HARD_NEGATIVES = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM best JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""

#: The other operators have parts beyond SQL (models fitted by iteration, fingerprints, spans through decoded layers,
#: the tokenizer's own library): tests compare them with brute force.
ORACLES: dict[str, str] = {"op7_substring_dedup": SUBSTRING_DEDUP, "op8_chat_format": CHAT_FORMAT, "op6_mix_sources": MIX_SOURCES, "op13_hard_negatives": HARD_NEGATIVES}
