"""Queries over row shapes, joins, builders, packing, retrieval, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import arrays as Y
from plumbline.functions.arrays import whitespace_tokens
from plumbline.operators import builders as B
from plumbline.operators import filters, joins, packing, retrieval, rows
from plumbline.operators.registry import Registry
from plumbline.operators.scale import lookup, row_index
from plumbline.plans.carriers import CORPUS, MESSAGES, PREDICTIONS, RESPONSES, RESULTS, derive, plain, r, rounded, table
from plumbline.plans.registry import query
from plumbline.schemas import RL_ROWS
from plumbline.session import shared_folder
from plumbline.sources import readers, sinks
from plumbline.streaming import jobs

E = f"with e as {plain(RESPONSES)}"
P = f"with p as {plain(PREDICTIONS)}"


def events(spark, sf):
    return table(spark, sf, "events")


def numbered(spark, sf):
    """Events with a dense row number in the order of their id."""
    return row_index(events(spark, sf).select("event_id", "user_id", "event_type", "value"), "event_id")


ROWS = "with n as (select *, row_number() over (order by event_id) - 1 as row from events)"

# projections -----------------------------------------------------------------


@query("row_index", f"{ROWS} select event_id, row from n")
def row_index_query(spark, sf):
    return numbered(spark, sf).select("event_id", "row")


@query("coalesce_fields", "select event_id, coalesce(case when event_id % 3 = 0 then event_type end, case when event_id % 3 = 1 then cast(user_id as varchar) end, '') as question from events")
def coalesce_fields(spark, sf):
    e = F.col("event_id")
    df = events(spark, sf).select("event_id", F.when(e % 3 == 0, F.col("event_type")).alias("problem"), F.when(e % 3 == 1, F.col("user_id")).alias("Question2"))
    return rows.coalesce_fields(df, ["question", "problem", "Question2"], "question").select("event_id", "question")


def conversations(spark, sf):
    return packing.build_conversations(derive(spark, sf, MESSAGES)).withColumnRenamed("messages", "prompt")


@query("prompt_first_content", "select conv_id, arg_min(text, turn) filter (where text <> '') as prompt_text from conversations group by 1")
def prompt_first_content(spark, sf):
    return rows.prompt_text(conversations(spark, sf)).select("conv_id", "prompt_text")


@query("prompt_last_user", "select conv_id, coalesce(arg_max(text, turn) filter (where role = 'user'), '') as prompt_text from conversations group by 1")
def prompt_last_user(spark, sf):
    return rows.prompt_text(conversations(spark, sf), "last_user").select("conv_id", "prompt_text")


@query("extract_question", "select conv_id, case when conv_id % 2 = 0 then 'q' || conv_id else 'Name it?' end as question_text from (select distinct conv_id from conversations) c")
def extract_question(spark, sf):
    base = conversations(spark, sf).withColumn("problem", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("q"), F.col("conv_id").cast("string"))))
    asked = F.transform("prompt", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("\nQuestion: Name it?\nmore")).alias("content")))
    return rows.extract_question(base.withColumn("prompt", asked), is_qa=True).select("conv_id", "question_text")


@query("extract_ground_truth", "select event_id, case event_id % 4 when 0 then 'a' || user_id when 1 then 't' || user_id when 2 then 'v' || user_id end as truth from events")
def extract_ground_truth(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    raw = F.when(e % 4 == 1, F.concat(F.lit('{"target": "t'), u, F.lit('"}'))).when(e % 4 == 2, F.concat(F.lit('{"value": "v'), u, F.lit('"}'))).otherwise(u)
    df = events(spark, sf).select("event_id", F.when(e % 4 == 0, F.concat(F.lit("a"), u)).alias("answer"), raw.alias("reward_ground_truth"))
    return rows.extract_ground_truth(df).select("event_id", "truth")


@query("normalize_ground_truth", "select event_id, case event_id % 4 when 0 then user_id || '|x' when 1 then 't' || user_id when 2 then cast(user_id as varchar) else '' end as golds from events")
def normalize_ground_truth(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    raw = (
        F.when(e % 4 == 0, F.concat(F.lit('["'), u, F.lit('", "", "x"]')))
        .when(e % 4 == 1, F.concat(F.lit('{"target": ["t'), u, F.lit('"]}')))
        .when(e % 4 == 2, u)
        .otherwise(F.lit(""))
    )
    return events(spark, sf).select("event_id", F.array_join(rows.normalize_ground_truth(raw), "|").alias("golds"))


@query("fill_reward_ground_truth", "select event_id, case event_id % 4 when 0 then 'kept' when 1 then 'g' || user_id when 2 then 'a' || user_id else '' end as ground_truth from events")
def fill_reward_ground_truth(spark, sf):
    u, e = F.col("user_id").cast("string"), F.col("event_id")
    df = events(spark, sf).select(
        "event_id",
        F.when(e % 4 == 0, F.lit("kept")).alias("ground_truth"),
        F.when(e % 4 == 1, F.array(F.concat(F.lit("g"), u))).alias("golden_answers"),
        F.when(e % 4 == 2, F.concat(F.lit("a"), u)).alias("answer"),
    )
    return rows.fill_ground_truth(df).select("event_id", "ground_truth")


@query("slim_predictions", f"{P} select {r('confidence')} as confidence, correct, abstained, {r('risk_t')} as risk_t from p")
def slim_predictions(spark, sf):
    return rounded(rows.slim_predictions(derive(spark, sf, PREDICTIONS)))


@query("select_pop_rename", "select event_id as id, event_type as kind from events")
def select_pop_rename(spark, sf):
    kept, popped = rows.pop_columns(events(spark, sf).select("event_id", "user_id", "event_type"), ["event_type"], "event_id")
    return rows.rename_columns(popped, ["event_id", "event_type"], ["id", "kind"])


@query("repeat_rows", f"{ROWS} select event_id, row * 3 + i as ordinal from n, range(0, 3) t(i)")
def repeat_rows(spark, sf):
    return rows.repeat_rows(numbered(spark, sf), 3, "row").select("event_id", "ordinal")


@query("repeat_rows_tiled", f"{ROWS} select event_id, i * (select count(*) from n) + row as ordinal from n, range(0, 3) t(i)")
def repeat_rows_tiled(spark, sf):
    return rows.repeat_rows(numbered(spark, sf), 3, "row", interleave=False).select("event_id", "ordinal")


@query("repeat_rows_by_column", "select event_id, cast(i as int) as rep from events, range(0, 4) t(i) where i < event_id % 4")
def repeat_rows_by_column(spark, sf):
    df = events(spark, sf).withColumn("times", F.col("event_id") % 4)
    return rows.repeat_rows(df, "times", "event_id").select("event_id", "rep")


def token_arrays(spark, sf):
    """Word lengths of each document as a token array."""
    words = F.filter(F.split("text", r"\s+", -1), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", F.transform(words, lambda w: F.length(w).cast("bigint")).alias("ids"))


TOK = "with d as (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: len(w)) as ids from documents)"


def joined(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def listed(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


PADDED = "list_concat(ids, list_resize([]::bigint[], greatest(64 - len(ids), 0), 0))"


@query("pad_arrays", f"{TOK} select doc_id, {listed(PADDED)} as right_padded, {listed('ids')} as unpadded from d")
def pad_arrays(spark, sf):
    df = token_arrays(spark, sf)
    left = Y.pad_array(F.col("ids"), 64, 0, left=True)
    mask = F.transform(left, lambda v: (v > 0).cast("int"))
    return df.select("doc_id", joined(Y.pad_array(F.col("ids"), 64, 0)).alias("right_padded"), joined(Y.unpad_left(left, mask)).alias("unpadded"))


@query(
    "truncate_tokens",
    f"{TOK} select doc_id, {listed('ids[-32:]')} as kept_last, {listed('ids[:32]')} as kept_first, {listed('case when len(ids) > 32 then list_concat(ids[:16], ids[-16:]) else ids end')} as kept_ends from d",
)
def truncate_tokens(spark, sf):
    cuts = [joined(Y.truncate_tokens(F.col("ids"), 32, m)).alias(n) for m, n in [("left", "kept_last"), ("right", "kept_first"), ("middle", "kept_ends")]]
    return token_arrays(spark, sf).select("doc_id", *cuts)


@query("truncate_keep_tail", f"{TOK} select doc_id, {listed('case when len(ids) > 32 then list_concat(ids[:28], ids[-4:]) else ids end')} as ids from d")
def truncate_keep_tail(spark, sf):
    return token_arrays(spark, sf).select("doc_id", joined(Y.truncate_keep_tail(F.col("ids"), 32)).alias("ids"))


@query("mask_from_attention", f"{TOK} select doc_id, {listed('list_transform(ids[-8:], lambda v: case when v > 4 then 1 else 0 end)')} as mask from d")
def mask_from_attention(spark, sf):
    df = token_arrays(spark, sf)
    mask = F.transform("ids", lambda v: (v > 4).cast("int"))
    return df.select("doc_id", joined(Y.slice_mask(mask, 8)).alias("mask"))


@query("unfold_columns", f"{TOK} select doc_id, cast(i as int) as chunk, {listed('ids[(i * (len(ids) // 4) + 1):((i + 1) * (len(ids) // 4))]')} as ids from d, range(0, 4) t(i)")
def unfold_columns(spark, sf):
    return rows.unfold_columns(token_arrays(spark, sf), 4, ["ids"]).select("doc_id", "chunk", joined(F.col("ids")).alias("ids"))


@query("fold_batch", f"{ROWS} select row // 8 as batch, string_agg(cast(event_id as varchar), ',' order by row) as ids from n group by 1")
def fold_batch(spark, sf):
    folded = rows.fold_batch(numbered(spark, sf).select("row", "event_id", "user_id"), 8)
    return folded.select("batch", joined(F.col("event_id")).alias("ids"))


@query("unfold_batch", f"{ROWS} select row, event_id, user_id from n")
def unfold_batch(spark, sf):
    folded = rows.fold_batch(numbered(spark, sf).select("row", "event_id", "user_id"), 8)
    return rows.unfold_batch(folded, 8)


@query("chunk_rows", f"{ROWS} select event_id, cast(floor(row * 10 / (select count(*) from n)) as bigint) as chunk from n")
def chunk_rows(spark, sf):
    return rows.chunk_rows(numbered(spark, sf), 10).select("event_id", "chunk")


@query("split_rows", f"{ROWS} select event_id, row // 300 as chunk from n")
def split_rows(spark, sf):
    return rows.split_rows(numbered(spark, sf), 300).select("event_id", "chunk")


@query("pad_rows_to_divisor", f"{ROWS}, c as (select count(*) as n, (7 - count(*) % 7) % 7 as m from n) select event_id, row, false as is_pad from n union all select event_id, row + c.n, true from n, c where row < m")
def pad_rows_to_divisor(spark, sf):
    return rows.pad_rows(numbered(spark, sf), 7).select("event_id", "row", "is_pad")


@query("unpad_rows", f"{ROWS} select event_id, row from n")
def unpad_rows(spark, sf):
    return rows.unpad_rows(rows.pad_rows(numbered(spark, sf), 7)).select("event_id", "row")


@query("stride_shard", f"{ROWS} select event_id from n where row >= 3 and (row - 3) % 5 = 0")
def stride_shard(spark, sf):
    return filters.stride_shard(numbered(spark, sf), 3, 5).select("event_id")


@query("slice_rows", f"{ROWS} select event_id from n where row >= 10 and row < 900 and (row - 10) % 3 = 0")
def slice_rows(spark, sf):
    return filters.slice_rows(numbered(spark, sf), 10, 900, 3).select("event_id")


@query("select_rows", "select user_id as ordinal, e.event_id, e.event_type from events e join (select event_id as ordinal_id, user_id from events) i on e.event_id = (i.ordinal_id * 7) % (select count(*) from events)".replace("user_id as ordinal", "i.ordinal_id as ordinal"))
def select_rows(spark, sf):
    """Every row names a row to take; some are taken many times."""
    df = events(spark, sf).select(F.col("event_id").alias("row"), "event_id", "event_type")
    ids = df.select(F.col("row").alias("ordinal"), ((F.col("row") * 7) % df.agg(F.count(F.lit(1))).scalar()).alias("row"))
    return filters.select_rows(df, ids).select("ordinal", "event_id", "event_type")


@query("train_val_split", f"{ROWS} select event_id, case when row < floor((select count(*) from n) * 0.9) then 'train' else 'test' end as split from n")
def train_val_split(spark, sf):
    return rows.split_positional(numbered(spark, sf), 0.9).select("event_id", "split")


@query("reorder_rows", f"{ROWS} select event_id, (select count(*) from n) - 1 - row as position from n")
def reorder_rows(spark, sf):
    df = numbered(spark, sf)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.reorder(df.select("event_id", (total - 1 - F.col("row")).alias("position")), "position")


@query("drop_unlabeled", "select event_id from events where event_type <> 'view'")
def drop_unlabeled(spark, sf):
    df = events(spark, sf).withColumn("label", F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")))
    return filters.drop_unlabeled(df, "label").select("event_id")


@query("filter_date_range", "select o_orderkey from orders where strftime(o_orderdate, '%Y-%m-%d') >= '1996-08-00' and strftime(o_orderdate, '%Y-%m-%d') < '1997-01-00'")
def filter_date_range(spark, sf):
    df = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return filters.filter_date_range(df, "day", "1996-08-00", "1997-01-00").select("o_orderkey")


@query("resume_skip", "select event_id as index from events where event_id % 4 <> 0")
def resume_skip(spark, sf):
    todo = events(spark, sf).select(F.col("event_id").alias("index"))
    return filters.resume_skip(todo, todo.where(F.col("index") % 4 == 0))


@query("split_media_segments", "select event_id, 'text,image,text,video' as kinds from events")
def split_media_segments(spark, sf):
    text = F.concat(F.lit("See "), "event_type", F.lit("<image> and <video>"))
    return events(spark, sf).select("event_id", F.array_join(F.transform(rows.split_media_segments(text), lambda s: s["type"]), ",").alias("kinds"))


@query("concat_tables", "select event_id, event_type, null::bigint as user_id from events where event_id % 2 = 0 union all select event_id, null, user_id from events where event_id % 2 = 1")
def concat_tables(spark, sf):
    df = events(spark, sf)
    return rows.concat_tables([df.where("event_id % 2 = 0").select("event_id", "event_type"), df.where("event_id % 2 = 1").select("event_id", "user_id")])


@query("append_generated", "select event_id, user_id from events where event_id % 2 = 0 union all select event_id, user_id from events where event_id % 2 = 1 and user_id <= 70")
def append_generated(spark, sf):
    df = events(spark, sf).select("event_id", "user_id")
    return rows.append_generated(df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1"), "user_id", 70)


@query("stack_preferences", "select text as prompt, text || ' yes' as response from benchmark union all select text, text || ' no' from benchmark")
def stack_preferences(spark, sf):
    df = table(spark, sf, "benchmark").select(F.col("text").alias("prompt"), F.concat("text", F.lit(" yes")).alias("chosen"), F.concat("text", F.lit(" no")).alias("rejected"))
    return rows.stack_chosen_rejected(df)


@query("to_rl_columns", "select text as prompt, lang as gold, 'maths' as data_source from documents")
def to_rl_columns(spark, sf):
    df = table(spark, sf, "documents").select(F.col("text").alias("prompt"), F.col("lang").alias("solution"))
    out = B.to_rl_columns(df, "maths")
    return out.select("prompt", F.get("reward_model.ground_truth", F.lit(0)).alias("gold"), "data_source")


# joins -----------------------------------------------------------------------


@query("union_columns", "select event_id, event_type, user_id, " + r("value") + " as value from events")
def union_columns(spark, sf):
    df = events(spark, sf)
    out = joins.union_columns(df.select("event_id", "event_type", "user_id"), df.select("event_id", "user_id", "value"), "event_id")
    return rounded(out)


@query("flag_out_of_knowledge", "select event_id, user_id in (select doc_id from labels where toxic = 1) as out_of_knowledge from events")
def flag_out_of_knowledge(spark, sf):
    ids = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return joins.flag_members(events(spark, sf).select("event_id", "user_id"), ids, "user_id", "out_of_knowledge").select("event_id", "out_of_knowledge")


RANKED = "rk as (select event_id as question_id, i + 1 as rank, (event_id * 3 + i * 17) % (select count(*) from documents) as doc_id from events, range(0, 4) t(i))"
PASSAGE = "concat('Doc ', rank, '(Title: Title ', doc_id, ') ', text, chr(10))"


def ranked_docs(spark, sf):
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    base = events(spark, sf).select(F.col("event_id").alias("question_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return base.select("question_id", (F.col("i") + 1).alias("rank"), ((F.col("question_id") * 3 + F.col("i") * 17) % n).alias("doc_id"))


@query("attach_retrieval_context", f"with {RANKED} select question_id, md5(string_agg({PASSAGE}, '' order by rank)) as digest from rk join documents using (doc_id) where rank <= 3 group by 1")
def attach_retrieval_context(spark, sf):
    questions = events(spark, sf).select(F.col("event_id").alias("question_id"))
    ranked, corpus = ranked_docs(spark, sf), derive(spark, sf, CORPUS)

    def digests(asked, found):
        return joins.attach_context(asked, found, corpus, 3).select("question_id", F.md5("context").alias("digest"))

    return joins.by_blocks(questions, ranked, joins.passage_blocks(ranked, corpus, 3), digests, "contexts")


@query(
    "format_passages",
    f"with {RANKED}, h as (select question_id, rtrim(string_agg(concat('Doc ', rank, ' (Title: Title ', doc_id, ')', chr(10), text, chr(10), chr(10)), '' order by rank), ' ' || chr(10)) as t from rk join documents using (doc_id) where question_id % 3 > 0 group by 1) "
    "select event_id as question_id, md5(coalesce(t, 'No search results found.')) as digest from events left join h on event_id = question_id",
)
def format_passages(spark, sf):
    questions = events(spark, sf).select(F.col("event_id").alias("question_id"))
    ranked = ranked_docs(spark, sf).where(F.col("question_id") % 3 > 0)
    corpus = derive(spark, sf, CORPUS).select("doc_id", "contents")

    def digests(asked, found):
        return joins.format_passages(asked, lookup(found, corpus, ["doc_id"])).select("question_id", F.md5("text").alias("digest"))

    return joins.by_blocks(questions, ranked, joins.passage_blocks(ranked, corpus, 100), digests, "passages")


# retrieval -------------------------------------------------------------------

UNIT = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings"


@query(
    "dense_topk",
    f"""with u as ({UNIT}), s as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))), 12) as score from u q, u d where q.vec_id % 20 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, doc_id, cast(rank as int) as rank, {r('score')} as score from k where rank <= 3""",
)
def dense_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return rounded(retrieval.dense_topk(queries, corpus, 3))


@query(
    "dense_topk_blocks",
    f"""with u as ({UNIT}), s as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_inner_product(q.v, d.v), 12) as score from u q, u d where q.vec_id % 20 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
select query_id, doc_id, cast(rank as int) as rank, {r('score')} as score from k where rank <= 5""",
)
def dense_topk_blocks(spark, sf):
    """Inner products, in several blocks of queries and small tiles."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return rounded(retrieval.dense_topk(queries, corpus, 5, False, block_values=640, tile=64))


BM25 = """with dt as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as ts from documents),
tot as (select count(*) * 1e0 as n, avg(len(ts)) as avgdl from dt),
po as (select doc_id, len(ts) as dl, unnest(ts) as term from dt),
tf as (select doc_id, dl, term, count(*) as tf from po group by 1, 2, 3),
qt as (select distinct item_id as query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as term from benchmark),
fr as (select term, count(*) as df from tf group by 1),
sc as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 1.9e0 / (tf + 0.9e0 * (0.6e0 + 0.4e0 * dl / avgdl))), 9) as score
  from qt join tf using (term) join fr using (term), tot group by 1, 2),
rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc)"""


@query("bm25_topk", f"{BM25} select query_id, doc_id, cast(rank as int) as rank, {r('score')} as score from rk where rank <= 5")
def bm25_topk(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(retrieval.bm25_topk(queries, table(spark, sf, "documents").select("doc_id", "text"), 5))


# packing ---------------------------------------------------------------------


@query("build_conversations", "select conv_id, count(*) as n_messages, md5(string_agg(role || ':' || text, '|' order by turn)) as digest from conversations group by 1")
def build_conversations(spark, sf):
    out = packing.build_conversations(derive(spark, sf, MESSAGES))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.md5(text).alias("digest"))


WL = "list_transform(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''), lambda w: len(w))"


def lengths(c):
    return F.transform(F.filter(F.split(c, r"\s+", -1), lambda w: w != ""), lambda w: F.length(w).cast("bigint"))


@query(
    "sft_pack",
    f"""with x as (select doc_id, {WL.format('lang')} as p, {WL.format('text')} as q from documents), y as (select doc_id, len(p) as np, list_concat(p, q, [2]) as ids from x),
z as (select doc_id, np, ids, len(ids) as n, list_transform(range(0, len(ids)), lambda i: case when i >= np - 1 and i < len(ids) - 1 then 1 else 0 end) as m from y)
select doc_id, cast(64 as int) as n, md5(array_to_string(list_concat(ids[:64], list_resize([]::bigint[], greatest(64 - n, 0), 0)), ',')) as ids_digest,
  cast(coalesce(list_sum(m[:64]), 0) as bigint) as n_loss, cast(least(n, 64) as bigint) as n_attended from z""",
)
def sft_pack(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", lengths(F.col("lang")).alias("prompt_ids"), lengths(F.col("text")).alias("response_ids"))
    out = packing.sft_rows(df, 64)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, b: a + b).cast("bigint")
    return out.select("doc_id", F.size("input_ids").alias("n"), F.md5(joined(F.col("input_ids"))).alias("ids_digest"), total("loss_mask").alias("n_loss"), total("attention_mask").alias("n_attended"))


@query(
    "multiturn_pack",
    f"""with x as (select conv_id, turn, role, {WL.format('text')} as ids from conversations)
select conv_id, cast(sum(len(ids)) as bigint) as n_tokens, cast(sum(case when role = 'assistant' then greatest(len(ids) - 2, 0) else 0 end) as bigint) as n_loss,
 md5(string_agg(nullif(array_to_string(ids, ','), ''), ',' order by turn)) as digest from x group by 1""",
)
def multiturn_pack(spark, sf):
    turns = derive(spark, sf, MESSAGES).withColumn("ids", lengths(F.col("text")))
    out = packing.multiturn_rows(turns, "ids", prefix=2)
    loss = F.aggregate("loss_mask", F.lit(0), lambda a, b: a + b).cast("bigint")
    return out.select("conv_id", F.size("input_ids").cast("bigint").alias("n_tokens"), loss.alias("n_loss"), F.md5(joined(F.col("input_ids"))).alias("digest"))


@query(
    "preference_pack",
    f"""with x as (select doc_id, {WL.format('lang')} as p, {WL.format('text')} as c, {WL.format('source')} as j from documents),
y as (select doc_id, 'chosen' as side, list_concat(p, c, [2]) as ids from x union all select doc_id, 'rejected', list_concat(p, j, [2]) from x)
select doc_id, side, md5(array_to_string(list_concat(ids[:16], list_resize([]::bigint[], greatest(16 - len(ids), 0), 0)), ',')) as digest, cast(least(len(ids), 16) as bigint) as n_attended from y""",
)
def preference_pack(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", lengths(F.col("lang")).alias("prompt_ids"), lengths(F.col("text")).alias("chosen_ids"), lengths(F.col("source")).alias("rejected_ids"))
    out = packing.preference_rows(df, 16, eos_id=2)
    n = F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("bigint")
    return out.select("doc_id", "side", F.md5(joined(F.col("input_ids"))).alias("digest"), n.alias("n_attended"))


# builders --------------------------------------------------------------------


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("index"), F.col("text").alias("question"), F.array(F.lit("yes"), F.col("item_id").cast("string")).alias("golden_answers"))


def shown(df):
    """A training row as scalars."""
    return df.select(
        "data_source",
        F.get("prompt", F.size("prompt") - 1)["content"].alias("content"),
        F.size("prompt").alias("n_messages"),
        "ability",
        F.array_join("reward_model.ground_truth", "|").alias("gold"),
        F.col("extra_info.split").alias("split"),
        F.col("extra_info.index").alias("index"),
    )


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def row_sql(source: str, content: str, ability: str, gold: str, frm: str, split: str = "train", n: int = 1, index: str = "item_id") -> str:
    return f"select {source} as data_source, {content} as content, {n} as n_messages, '{ability}' as ability, {gold} as gold, '{split}' as split, {index} as index from {frm}"


QMARK = "case when ends_with(trim(text, ' ' || chr(10)), '?') then trim(text, ' ' || chr(10)) else trim(text, ' ' || chr(10)) || '?' end"


@query("build_qa_rows", row_sql("'nq'", f"replace({lit(B.THINK_ANSWER)}, '{{q}}', {QMARK})", "fact-reasoning", "'yes|' || item_id", "benchmark"))
def build_qa_rows(spark, sf):
    return shown(B.check_rows(B.build_rows(questions(spark, sf), "nq")))


@query("build_rag_rows", row_sql("'nq_rag'", f"replace(replace({lit(B.THINK_ANSWER_CONTEXT)}, '{{context}}', 'Doc ' || item_id), '{{q}}', {QMARK})", "fact-reasoning", "'yes|' || item_id", "benchmark"))
def build_rag_rows(spark, sf):
    df = questions(spark, sf).withColumn("context", F.concat(F.lit("Doc "), F.col("index").cast("string")))
    return shown(B.build_rows(df, "nq_rag"))


@query("build_search_rows", row_sql("'searchR1_nq'", "'Q: ' || text", "fact-reasoning", "'yes|' || item_id", "benchmark", n=2))
def build_search_rows(spark, sf):
    df = questions(spark, sf).withColumn("data_source", F.lit("nq"))
    return shown(B.build_rows(df, "search_r1", system="Use tools.", user_prefix="Q: "))


@query("build_crag_rows", row_sql("'crag'", "text", "fact-reasoning", "lang || '|' || source", "documents", index="doc_id"))
def build_crag_rows(spark, sf):
    df = table(spark, sf, "documents").select(
        F.col("doc_id").alias("index"), F.col("text").alias("prompt_text"), F.col("lang").alias("answer"), F.array("source").alias("alt_ans"), F.col("text").alias("query"), (F.col("doc_id") % 3 == 0).alias("out_of_knowledge")
    )
    return shown(B.build_rows(df, "crag"))


@query("build_gsm8k_rows", f"{E} " + row_sql("'openai/gsm8k'", f"gold || ' ' || {lit(B.STEP_BY_STEP)}", "math", "replace(regexp_extract(worked, '#### ([0-9,]+)', 1), ',', '')", "e", index="event_id"))
def build_gsm8k_rows(spark, sf):
    df = derive(spark, sf, RESPONSES).select(F.col("event_id").alias("index"), F.col("gold").alias("question"), F.col("worked").alias("answer"))
    return shown(B.build_rows(df, "gsm8k"))


@query("build_gsm8k_tool_rows", f"{E} " + row_sql("'openai/gsm8k'", f"gold || ' ' || {lit(B.STEP_BY_STEP)}", "math", "replace(regexp_extract(worked, '#### ([0-9,]+)', 1), ',', '')", "e", index="event_id", n=2))
def build_gsm8k_tool_rows(spark, sf):
    df = derive(spark, sf, RESPONSES).select(F.col("event_id").alias("index"), F.col("gold").alias("question"), F.col("worked").alias("answer"))
    return shown(B.build_rows(df, "gsm8k", system="You may call a tool.", agent="tool_agent"))


@query("build_math_rows", f"{E} " + row_sql("'DigitalLearningGmbH/MATH-lighteval'", f"gold || ' ' || {lit(B.STEP_BY_STEP_BOX)}", "math", "coalesce(case when event_id % 8 > 0 then substr(split_part(boxed, 'boxed{{', -1), 1, len(split_part(boxed, 'boxed{{', -1)) - 5) end, '')".replace("{{", "{"), "e", index="event_id"))
def build_math_rows(spark, sf):
    df = derive(spark, sf, RESPONSES).select(F.col("event_id").alias("index"), F.col("gold").alias("problem"), F.col("boxed").alias("solution"))
    return shown(B.build_rows(df, "math"))


@query("build_geo_rows", row_sql("'hiyouga/geometry3k'", f"text || ' ' || {lit(B.THINK_FIRST_BOX)}", "math", "lang", "documents", index="doc_id"))
def build_geo_rows(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("problem"), F.col("lang").alias("answer"))
    return shown(B.build_rows(df, "geo3k"))


@query("build_hellaswag_rows", row_sql("'Rowan/hellaswag'", "concat(lang, ': Then  we ', 'Go up'), '  ', ' ')", "nlp", "cast(doc_id % 4 as varchar)", "documents where doc_id % 5 > 0", index="doc_id").replace("concat(lang", "replace(concat(lang"))
def build_hellaswag_rows(spark, sf):
    d = F.col("doc_id")
    df = table(spark, sf, "documents").select(
        d.alias("index"),
        F.col("lang").alias("activity_label"),
        F.lit("Then [note] we").alias("ctx_a"),
        F.lit("GO UP").alias("ctx_b"),
        F.array("source", "lang").alias("endings"),
        F.when(d % 5 > 0, (d % 4).cast("string")).otherwise(F.lit("")).alias("label"),
    )
    return shown(B.build_rows(df, "hellaswag"))


@query("build_tool_rows", "select item_id as index, 'yes|' || item_id as gold, true as has_tool from benchmark")
def build_tool_rows(spark, sf):
    out = B.build_rows(B.build_rows(questions(spark, sf), "nq"), "tool", tool="calc")
    kwargs = F.get_json_object("extra_info.json", "$.tools_kwargs.calc.create_kwargs.ground_truth[1]")
    return out.select(F.col("extra_info.index").alias("index"), F.array_join("reward_model.ground_truth", "|").alias("gold"), (kwargs == F.col("extra_info.index").cast("string")).alias("has_tool"))


@query(
    "build_eval_tasks",
    row_sql("'Maxwell-Jia/AIME_2024'", "text", "English", "lang", "documents", "test", index="doc_id") + " union all " + row_sql("'opencompass/cnmo2024_en'", "text", "Math", "source", "documents", "test", index="doc_id"),
)
def build_eval_tasks(spark, sf):
    docs = table(spark, sf, "documents")
    aime = docs.select(F.col("doc_id").alias("index"), F.col("text").alias("Problem"), F.col("lang").alias("Answer"))
    cnmo = docs.select(F.col("doc_id").alias("index"), F.col("text").alias("question"), F.col("source").alias("answer"))
    return shown(B.eval_tasks({"aime2024": aime, "cnmo": cnmo}))


@query("build_choice_rows", "select doc_id as index, true as gold_in_place, true as all_there from documents")
def build_choice_rows(spark, sf):
    """The letter points at the right choice, and no choice is lost."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("index"), F.lit("Pick").alias("question"), F.lit("right").alias("correct"), F.lit("w1").alias("wrong1"), F.lit("w2").alias("wrong2"), F.lit("w3").alias("wrong3")
    )
    out = B.build_rows(docs, "gpqa")
    content, letter = F.get("prompt", F.lit(0))["content"], F.get("reward_model.ground_truth", F.lit(0))
    there = F.lit(True)
    for text in ("right", "w1", "w2", "w3"):
        there = there & F.contains(content, F.concat(F.lit(") "), F.lit(text)))
    return out.select(F.col("extra_info.index").alias("index"), F.contains(content, F.concat(letter, F.lit(") right"))).alias("gold_in_place"), there.alias("all_there"))


@query("build_code_rows", "select o_orderkey as index, 'tests' as gold from orders where strftime(o_orderdate + interval 27 year, '%Y-%m-%dT00:00:00') >= '2024-08-00T00:00:00' and strftime(o_orderdate + interval 27 year, '%Y-%m-%dT00:00:00') < '2025-01-00T00:00:00'")
def build_code_rows(spark, sf):
    date = F.date_format(F.add_months("o_orderdate", 27 * 12), "yyyy-MM-dd'T'00:00:00")
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("question_content"), F.lit("").alias("starter_code"), F.lit("tests").alias("test_cases"), date.alias("contest_date"))
    out = B.build_rows(df, "lcb")
    return out.select(F.col("extra_info.index").alias("index"), F.get("reward_model.ground_truth", F.lit(0)).alias("gold"))


@query("build_preference_rows", f"{ROWS} select event_type as prompt, 'c' || event_id as chosen, 'r' || event_id as rejected, case when row < floor((select count(*) from n) * 0.75) then 'train' else 'test' end as split from n")
def build_preference_rows(spark, sf):
    df = numbered(spark, sf).select(F.col("row").alias("index"), F.col("event_type").alias("prompt"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chosen"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rejected"))
    return B.build_rows(df, "hh_rm")


@query("build_preference_sft_rows", "select event_type as prompt, 'c' || event_id as response from events union all select event_type, 'r' || event_id from events")
def build_preference_sft_rows(spark, sf):
    df = events(spark, sf).select(F.col("event_type").alias("prompt"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chosen"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("rejected"))
    return B.build_rows(df, "hh_sft")


@query("build_preference_rl_rows", row_sql("'Dahoas/full-hh-rlhf'", "text", "alignment", "lang", "documents", index="doc_id"))
def build_preference_rl_rows(spark, sf):
    df = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("prompt"), F.col("lang").alias("response"))
    return shown(B.build_rows(df, "hh_rl"))


@query("build_retool_rows", "select event_id as index, case when event_id % 4 > 0 then 'problem ' || user_id end as problem, case when event_id % 4 > 0 then 4 end as n_messages from events")
def build_retool_rows(spark, sf):
    u = F.col("user_id").cast("string")
    output = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.lit("<interpreter>1</interpreter>"))
    df = events(spark, sf).select(
        F.col("event_id").alias("index"),
        F.concat(F.lit("Rules. *user question:* <answer>problem "), u, F.lit("</answer>")).alias("user"),
        F.concat(F.lit("<code>x</code>"), output, F.lit("<answer>2</answer>")).alias("assistant"),
    )
    out = B.build_rows(df, "retool_sft")
    return out.select("index", F.get("messages", F.lit(0))["content"].alias("problem"), F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n_messages"))


@query("append_answer_format", f"select item_id as index, replace({lit(B.THINK_ANSWER)}, '{{q}}', {QMARK}) || {lit(B.BOX_FORMAT)} as content, 'tool_agent' as agent_name from benchmark")
def append_answer_format(spark, sf):
    out = B.add_answer_format(B.build_rows(questions(spark, sf), "nq"))
    return out.select(F.col("extra_info.index").alias("index"), F.get("prompt", F.lit(0))["content"].alias("content"), "agent_name")


@query("generate_char_count", "select event_id as index, true as counted, true as in_range from events")
def generate_char_count(spark, sf):
    """One exercise per event: the stated count is the true one."""
    out = B.build_rows(events(spark, sf).select(F.col("event_id").alias("index")), "char_count")
    target = F.regexp_extract("prompt", r"How many (\w) ", 1)
    word = F.regexp_extract("prompt", r"word (.*)\?", 1)
    found = F.length(word) - F.length(F.replace(word, target, F.lit("")))
    n = F.size(F.split(word, "-"))
    return out.select("index", (found.cast("string") == F.col("ground_truth")).alias("counted"), n.between(5, 20).alias("in_range"))


@query("behavioral_messages", "select event_id as index, 'gold' || user_id as ground_truth, concat('Question: ', 'What is ' || user_id || '?', chr(10), chr(10), 'Answer:') is not null as has_prompt, 'user' as role from events")
def behavioral_messages(spark, sf):
    u = F.col("user_id").cast("string")
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Answer this. Question: What is "), u, F.lit("?\nmore")).alias("content"))
    df = events(spark, sf).select(
        F.col("event_id").alias("index"), F.lit("nq").alias("data_source"), F.array(message).alias("prompt"), F.array(F.concat(F.lit("gold"), u)).alias("golden_answers"), u.alias("u")
    )
    out = B.build_rows(df, "behavioral", strategy="explicit_risk")
    text = F.get("messages", F.lit(0))["content"]
    return out.select("index", "ground_truth", F.contains(text, F.concat(F.lit("Question: What is "), F.col("u"), F.lit("?"))).alias("has_prompt"), F.get("messages", F.lit(0))["role"].alias("role"))


@query("custom_row_builder", row_sql("'mine'", "text", "any", "lang", "documents", index="doc_id"))
def custom_row_builder(spark, sf):
    """A user's own builder, registered, run and checked for its layout."""
    mine = Registry("row builder")

    def build(df):
        return df.select(*B.rl_row(F.lit("mine"), [F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))], "any", F.array("lang"), "train"))

    mine.register("mine")(build)
    docs = table(spark, sf, "documents").withColumn("index", F.col("doc_id"))
    return shown(B.check_rows(mine.get("mine")(docs)))


# sources and sinks -----------------------------------------------------------


@query("read_rl_parquet", "select doc_id, lang from documents order by doc_id limit 300")
def read_rl_parquet(spark, sf):
    return readers.read_rl_parquet(spark, [f"{sf}/documents.parquet"], 300, "doc_id").select("doc_id", "lang")


@query("read_columns", "select doc_id, source from documents")
def read_columns(spark, sf):
    return readers.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "source"])


@query("read_eval_dataset", "select item_id, text from benchmark")
def read_eval_dataset(spark, sf):
    """The benchmark table written as JSON lines and read back by suffix."""
    path = shared_folder(spark, "eval") + ".jsonl"
    table(spark, sf, "benchmark").write.json(path)
    return readers.read_eval_dataset(spark, path, "item_id BIGINT, text STRING")


@query("read_tagged_union", "select item_id as id, text, 'bench' as tag from benchmark union all select doc_id, text, 'docs' from documents")
def read_tagged_union(spark, sf):
    out = readers.read_tagged_union(spark, {"bench": f"{sf}/benchmark.parquet", "docs": f"{sf}/documents.parquet", "gone": f"{sf}/gone.parquet"})
    return out.select(F.coalesce("item_id", "doc_id").alias("id"), "text", F.col("_source_dataset").alias("tag"))


def written_shards(spark, sf):
    """Predictions written as a results.json per shard; the first states no threshold, the second 0.3, later ones 0.7."""
    root = shared_folder(spark, "shards")
    preds = derive(spark, sf, PREDICTIONS)
    row = F.struct(F.col("confidence"), (F.col("correct") == 1).alias("correct"))
    # A document of a shard holds the rows of 4000 consecutive ids, never a whole shard.
    block = F.floor(F.col("event_id") / 4000)
    for shard, threshold in (("m0", None), ("m1", 0.3), ("m2", 0.7), ("m3", 0.7)):
        files = preds.where(F.col("method") == shard).groupBy(block.alias("block")).agg(F.collect_list(row).alias("results"))
        documents = files.select("results", F.struct(F.lit(threshold).cast("double").alias("risk_threshold")).alias("metrics"))
        documents.write.json(f"{root}/{shard}/results.json")
    return root


@query("read_result_shards", f"{P} select method as shard, count(*) as n, cast(sum(correct) as bigint) as n_correct, 0.3e0 as risk_threshold from p group by 1")
def read_result_shards(spark, sf):
    back = readers.read_result_shards(spark, written_shards(spark, sf), "m*", lines=True)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.max("risk_threshold").alias("risk_threshold"))


@query(
    "merge_shards",
    f"""{P} select count(*) as n_samples, {r('avg((confidence - correct) * (confidence - correct))')} as brier, {r('avg(correct)')} as predictive_accuracy,
{r('avg(confidence)')} as avg_confidence, {r('avg(case when confidence >= 0.3e0 then correct else 1 - correct end)')} as abstention_accuracy,
0.3e0 as risk_threshold, count(distinct method) as n_shards from p""",
)
def merge_shards(spark, sf):
    merged = readers.merge_shards(spark, written_shards(spark, sf), "m*", lines=True)
    return rounded(merged.select("n_samples", "brier", "predictive_accuracy", "avg_confidence", "abstention_accuracy", "risk_threshold", "n_shards"))


@query("write_results", f"{P} select method, count(*) as n, {r('avg(confidence)')} as confidence from p group by 1")
def write_results(spark, sf):
    path = shared_folder(spark, "results")
    preds = derive(spark, sf, PREDICTIONS)
    sinks.write_results(preds, preds.groupBy("method").agg(F.avg("correct").alias("value")), path)
    back = spark.read.parquet(f"{path}/predictions")
    return rounded(back.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence")))


@query("dump_and_read_rollouts", "select event_id % 7 as step, count(*) as n, max('***' || (user_id % 10)) as top from events group by 1")
def dump_and_read_rollouts(spark, sf):
    path = shared_folder(spark, "dump")
    df = events(spark, sf).select(F.lit("in").alias("input"), F.concat(F.lit("xyz"), (F.col("user_id") % 10).cast("string")).alias("output"), F.lit("g").alias("gts"), F.col("value").alias("score"), (F.col("event_id") % 7).alias("step"))
    sinks.dump_rollouts(df, path)
    back = readers.read_rollout_dumps(spark, path, mask="[xyz]")
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("output").alias("top"))


@query("write_rl_parquet", "select 'train' as split, count(*) as n from benchmark")
def write_rl_parquet(spark, sf):
    path = shared_folder(spark, "rl")
    sinks.write_rl_parquet(B.build_rows(questions(spark, sf), "nq"), path)
    return spark.read.parquet(f"{path}/data").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("append_metric_log", f"{P} select cast(event_id % 5 as bigint) as step, {r('avg(confidence)')} as confidence, {r('avg(correct)')} as accuracy from p group by 1")
def append_metric_log(spark, sf):
    path = shared_folder(spark, "log")
    per = derive(spark, sf, PREDICTIONS).groupBy((F.col("event_id") % 5).alias("step")).agg(F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))
    sinks.append_metric_log(per.unpivot(["step"], ["confidence", "accuracy"], "metric", "value"), path)
    back = spark.read.schema("step BIGINT, data MAP<STRING, DOUBLE>").json(path)
    return rounded(back.select("step", F.col("data")["confidence"].alias("confidence"), F.col("data")["accuracy"].alias("accuracy")))


@query("append_labels", "select event_id as index, cast(user_id % 2 as int) as first_label from events")
def append_labels(spark, sf):
    path = shared_folder(spark, "labels")
    labels = events(spark, sf).select(F.col("event_id").alias("index"), F.array((F.col("user_id") % 2).cast("int"), F.lit(1)).alias("claim_labels"))
    for half in (0, 1):
        sinks.append_labels(labels.where(F.col("index") % 2 == half), path)
    return readers.read_claim_labels(spark, path).select("index", F.get("claim_labels", F.lit(0)).alias("first_label"))


@query("read_result_tree", f"with r as {plain(RESULTS)} select method, dataset, {r('brier')} as brier, 0e0 as nll, cast(n_samples as double) as n_samples from r")
def read_result_tree(spark, sf):
    """Result rows written as method/dataset folders and walked back."""
    root = shared_folder(spark, "tree")
    df = derive(spark, sf, RESULTS)
    row = df.select("method", "dataset", F.struct("brier", F.col("n_samples").cast("double").alias("n_samples")).alias("metrics"))
    row.write.partitionBy("method", "dataset").json(root)
    back = readers.read_result_tree(spark, root, "*.json", lines=True)
    return rounded(back.select("method", "dataset", "brier", "nll", "n_samples"))


# streams ---------------------------------------------------------------------


def event_stream(spark, sf):
    """The events table as a file stream of predictions."""
    schema = events(spark, sf).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    e = F.col("event_id")
    confidence = ((e * 7919) % 1001).cast("double") / 1000
    correct = F.when((e * 104729 + F.col("user_id") * 31) % 1000 < (e * 7919) % 1001, 1).otherwise(0)
    return stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), confidence.alias("confidence"), correct.alias("correct"))


CLOSED = "(select max(ts) - interval 10 minute from events)"


@query(
    "stream_calibration",
    f"""{P}, w as (select time_bucket(interval 1 hour, ts) as s, confidence as c, correct as y from p)
select strftime(s, '%Y-%m-%d %H:%M') as start, count(*) as n_samples, {r('avg(c)', 9)} as avg_confidence, {r('avg(y)', 9)} as predictive_accuracy, {r('avg((c - y) * (c - y))', 9)} as brier
from w where s + interval 1 hour <= {CLOSED} group by s""",
)
def stream_calibration(spark, sf):
    """Windows behind the watermark; the open ones have not been emitted."""
    out = jobs.run_to_table(jobs.stream_calibration(event_stream(spark, sf)), "calibration")
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n_samples", "avg_confidence", "predictive_accuracy", "brier"), 9)


@query(
    "stream_reliability",
    f"{P}, w as (select time_bucket(interval 1 day, ts) as s, cast(floor(confidence * 100) as bigint) as bucket, correct as y from p) select strftime(s, '%Y-%m-%d') as start, bucket, count(*) as n, cast(sum(y) as bigint) as pos from w where s + interval 1 day <= {CLOSED} group by s, bucket",
)
def stream_reliability(spark, sf):
    out = jobs.run_to_table(jobs.stream_reliability(event_stream(spark, sf), "1 day"), "reliability")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "bucket", "n", "pos")


@query("stream_rollouts", "select event_id % 7 as step, count(*) as n, " + r("sum(value)", 4) + " as score from events group by 1")
def stream_rollouts(spark, sf):
    """Dumps written by step, read back as a stream of files."""
    path = shared_folder(spark, "stream-dump")
    df = events(spark, sf).select(F.lit("in").alias("input"), F.col("event_type").alias("output"), F.lit("g").alias("gts"), F.col("value").alias("score"), (F.col("event_id") % 7).alias("step"))
    sinks.dump_rollouts(df, path)
    out = jobs.run_to_table(jobs.stream_rollouts(spark, path), "rollouts")
    return rounded(out.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")), 4)


@query(
    "stream_kl_controller",
    f"""with p as (select user_id as run, event_id as step, ts, cast((event_id * 7919) % 101 as double) / 1000 as kl from events),
o as (select *, max(step) over (partition by run order by ts, step rows between unbounded preceding and 1 preceding) as last from p where ts <= {CLOSED}),
f as (select *, 1 + greatest(-0.2e0, least(0.2e0, kl / 0.05e0 - 1)) * 8 / 10000e0 as m from o where last is null or step > last)
select cast(run as varchar) as run, step, {r('0.2e0 * exp(sum(ln(m)) over (partition by run order by step))')} as beta from f""",
)
def stream_kl_controller(spark, sf):
    kl = ((F.col("event_id") * 7919) % 101).cast("double") / 1000
    stream = event_stream(spark, sf).select(F.col("user_id").cast("string").alias("run"), "ts", F.col("event_id").alias("step"), kl.alias("kl"), F.lit(8).alias("n_steps"))
    out = jobs.run_to_table(jobs.stream_kl(stream, 0.2, 0.05, 10000.0), "kl")
    return rounded(out.select("run", "step", "beta"))


@query(
    "stream_dynamic_sampling",
    f"{P}, u as (select cast(floor(event_id / 8) as bigint) as uid, confidence as m from p where ts <= {CLOSED}) select uid, count(*) as n, {r('avg(m)')} as mean, {r('max(m) - min(m)')} as spread from u group by 1 having count(*) = 8 and max(m) > min(m)",
)
def stream_dynamic_sampling(spark, sf):
    stream = event_stream(spark, sf).select(F.floor(F.col("event_id") / 8).alias("uid"), "ts", F.col("event_id").alias("seq_id"), F.col("confidence").alias("metric"))
    return rounded(jobs.run_to_table(jobs.stream_filter_groups(stream, 8), "groups"))


@query("schema_rl_rows", f"select count(*) as n_rows, {len(RL_ROWS.fields)} as n_columns from benchmark")
def schema_rl_rows(spark, sf):
    out = B.build_rows(questions(spark, sf), "nq")
    return out.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(out.columns)))


@query("whitespace_tokens", f"{TOK} select doc_id, len(ids) as n_tokens from d")
def whitespace_tokens_query(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(whitespace_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))
