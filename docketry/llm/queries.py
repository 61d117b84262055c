"""The opN queries: thin digests over the operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    digits = F.lower(F.hex("fp"))  # the bytes are little-endian
    return groups.select("doc_id", F.concat(*(F.substring(digits, k, 2) for k in range(15, 0, -2))).alias("fingerprint"), "component_id")


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.mixing import CORPUS, mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), total=CORPUS)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.warc import deduplicated_records

    return deduplicated_records(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.htmlmain import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.lm import score

    return score(table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.reshard import old_shard, resharded, text_crc32, text_size

    files = resharded(table(spark, sf_dir, "documents"))
    shard, slot = files.columns[-2:]
    placed = files.select("doc_id", text_size().alias("size"), text_crc32().alias("text_crc32"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), old_shard().alias("old_shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.embdedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.chat import formatted_digests

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return formatted_digests(turns.unionAll(added))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.resample import importance

    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.tiff import features, media

    return features(written(media(table(spark, sf_dir, "documents")), "media"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_quality_cotraining, op3_soft_mixing, op4_warc_revisits, op5_html_main_text, op6_backoff_lm, op7_benchmark_decontamination, op8_flow_reshard, op9_embedding_near_dedup, op10_chat_format, op11_importance_resampling, op12_tiff_media, op13_embedding_whitening)
}

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ANS\]|<<ROLE>>|<<TEXT>>|␛"

SQL: dict[str, str] = {
    "op4_warc_revisits": """with p as (select page_id, coalesce(html, '') as payload from pages), h as (select *, sha1(payload) as hex, max(page_id) over (partition by payload) as lead from p),
      d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), 'string_agg', '') as payload_digest from h)
      select page_id, strlen(payload) as payload_bytes, payload_digest, case when page_id = lead then 'response' else 'revisit' end as record_type, case when page_id <> lead then lead end as refers_to from d""",
    "op9_embedding_near_dedup": """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
      links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
      reach(node, seen) as (select vec_id, vec_id from v union select l.b, r.seen from reach r join links l on l.a = r.node),
      comp as (select node, min(seen) as component_id from reach group by node), n as (select a, count(*) as n_links from links group by a)
      select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join comp on vec_id = node left join n on vec_id = a""",
    "op10_chat_format": f"""with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
      r as (select *, length(regexp_replace(text, '{_CONTROL}', '12', 'g')) + case role when 'user' then 13 when 'system' then 15 else 9 end as shown from t)
      select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(3 + sum(shown) as bigint) as formatted_chars from r group by conv_id""",
    "op11_importance_resampling": r"""with recursive crc_table(k, c) as (select k, list_reduce([k] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) from range(256) r(k)),
      t as materialized (select list(c order by k) as tab from crc_table),
      texts as (select 0 as side, doc_id as id, row_number() over () as row, text from documents union all select 1, item_id, -row_number() over (), text from benchmark),
      w as materialized (select side, id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from texts),
      f as materialized (select side, row, unnest(list_concat(words, list_transform(range(1, greatest(len(words), 1)), lambda i: array_to_string(words[i : i + 1], ' ')), list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: array_to_string(words[i : i + 2], ' ')))) as feature from w),
      h as (select feature, hex(encode(feature)) as x from (select distinct feature from f)),
      b as materialized (select feature, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)), lambda c, d: xor(c >> 8, tab[(xor(c, d) & 255) + 1]))) % 10000 as bucket from h, t),
      n as materialized (select side, row, bucket, count(*) as c from f join b using (feature) group by all),
      g as (select bucket, floor(1000 * ln((coalesce(sum(c) filter (side = 1), 0) + 1)::double * ((select coalesce(sum(c), 0) from n where side = 0) + 10000)::double / ((coalesce(sum(c) filter (side = 0), 0) + 1)::double * ((select coalesce(sum(c), 0) from n where side = 1) + 10000)::double))) as gain from n group by bucket),
      d as (select row, sum(c) as n_features, sum(c * gain) as weight from n join g using (bucket) where side = 0 group by row),
      s as (select id as doc_id, len(words) as n_words, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight, cast('0x' || substr(sha256('42:' || id), 1, 8) as bigint) as hash from w left join d using (row) where side = 0),
      z as (select *, weight + cast(floor(-1000 * ln(-ln((hash + 0.5::double) / 4294967296))) as bigint) as score from s),
      r as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place from z)
      select doc_id, n_features, weight, score, case when n_words >= 20 and place <= (select count(*) from s where n_words >= 20) * 5 // 100 then place end as rank from r""",
}
