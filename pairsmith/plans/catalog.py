"""Queries over the driver's tables, one for each operator, and their SQL twins.

Where the tables have no such input (reasoning tags, replies in JSON, log lines), both sides build it from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.functions import jsonkit, naming, template, text
from pairsmith.operators import checks, chunks, gates, judging, limits, lists, records, stats
from pairsmith.plans.defaults import CRITERIA
from pairsmith.sources import checkpoints, hub, jsonl, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The SQL twin of the Unicode trim.
def _trim(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def _bytes(s: str) -> str:
    return f"octet_length(encode({s}))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ conversations to records

_PAIRS_SQL = """
    WITH p AS (SELECT conv_id,
                      arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> '') AS prompt,
                      arg_max(text, turn) FILTER (role = 'assistant') AS chosen
               FROM conversations GROUP BY conv_id)
    SELECT conv_id, {trim} AS prompt, chosen FROM p WHERE prompt IS NOT NULL AND chosen IS NOT NULL AND trim(chosen) <> ''""".format(trim=_trim("prompt"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = records.conversation_turns(table(spark, sf_dir, "conversations"))
    return records.prompt_and_chosen(talks, "sharegpt").where("prompt is not null and chosen is not null").select("conv_id", "prompt", "chosen")


@query(_PAIRS_SQL)
def sft_prompt_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"SELECT conv_id, 'human' AS from1, prompt AS value1, 'gpt' AS from2, chosen AS value2, 2 AS turns FROM ({_PAIRS_SQL})")
def sft_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumns({"main_topic": F.lit("t"), "sub_topic": F.col("conv_id").cast("string")})
    rows = records.sft(pairs, "sharegpt", topics=True)
    turn = lambda k: F.get("conversations", F.lit(k))
    return rows.select(F.col("sub_topic").cast("long").alias("conv_id"), turn(0)["from"].alias("from1"), turn(0)["value"].alias("value1"), turn(1)["from"].alias("from2"), turn(1)["value"].alias("value2"), F.size("conversations").alias("turns"))


@query(f"SELECT conv_id::VARCHAR AS sub_topic, 'talk' AS main_topic, prompt AS instruction, chosen AS output FROM ({_PAIRS_SQL})")
def sft_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumns({"main_topic": F.lit("talk"), "sub_topic": F.col("conv_id").cast("string")})
    return records.sft(pairs, "alpaca", topics=True).select("sub_topic", "main_topic", "instruction", "output")


@query(f"""SELECT doc_id, CASE WHEN {_trim("lang")} <> '' AND source <> '' THEN lang || chr(10) || chr(10) || source ELSE lang END AS prompt, text AS chosen
           FROM documents WHERE {_trim("text")} <> ''""")
def alpaca_prompt_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), "lang", F.lit("\n")).alias("instruction"), F.concat("source", F.lit(" ")).alias("input"), F.col("text").alias("output"))
    return records.prompt_and_chosen(rows, "alpaca").where("chosen is not null").select("doc_id", "prompt", "chosen")


def _gated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen replies that pass all gates, with a deterministic rejected reply."""
    rows = _pairs(spark, sf_dir).withColumns({"content": F.col("chosen"), "reasoning_content": F.lit(None).cast("string"), "finish_reason": F.lit("stop")})
    return gates.gate(rows).where("failure_reason is null").withColumn("rejected", text.truncate(F.col("chosen"), 40)).select("conv_id", "prompt", "chosen", "rejected")


_GATED_SQL = f"""SELECT conv_id, prompt, chosen, CASE WHEN length(chosen) > 40 THEN left(chosen, 40) || '...' ELSE chosen END AS rejected
    FROM ({_PAIRS_SQL}) WHERE {_bytes(_trim("chosen"))} >= 100 AND right({_trim("chosen")}, 1) IN ('.', '!', '?', '"', '''')
    AND NOT ({" OR ".join(f"contains(lower(chosen), {_quoted(p)})" for p in gates.REFUSALS)})"""


@query(f"SELECT prompt, chosen, rejected FROM ({_GATED_SQL})")
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dpo(_gated_pairs(spark, sf_dir))


@query(f"SELECT prompt, chosen AS completion, true AS label FROM ({_GATED_SQL}) UNION ALL SELECT prompt, rejected, false FROM ({_GATED_SQL})")
def kto_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.kto(_gated_pairs(spark, sf_dir))


_REASONED_SQL = "CASE WHEN conv_id % 3 = 0 THEN {c} ELSE '<think>' || chr(10) || 'r' || conv_id::VARCHAR || chr(10) || '</think>' || chr(10) || chr(10) || {c} END"


@query(f"SELECT prompt, {_REASONED_SQL.format(c='chosen')} AS chosen, rejected FROM ({_GATED_SQL})")
def dpo_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), F.col("conv_id").cast("string")))
    return records.dpo_with_reasoning(_gated_pairs(spark, sf_dir).withColumns({"chosen_reasoning": reason, "rejected_reasoning": F.lit(None).cast("string")}))


@query(f"""SELECT prompt, {_REASONED_SQL.format(c='chosen')} AS completion, true AS label FROM ({_GATED_SQL})
           UNION ALL SELECT prompt, rejected, false FROM ({_GATED_SQL})""")
def kto_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), F.col("conv_id").cast("string")))
    return records.kto_with_reasoning(_gated_pairs(spark, sf_dir).withColumns({"chosen_reasoning": reason, "rejected_reasoning": F.lit(None).cast("string")}))


@query(f"""SELECT conv_id, prompt AS value1, {_REASONED_SQL.format(c='chosen')} AS value2, 2 AS turns FROM ({_PAIRS_SQL})""")
def sft_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumns({"main_topic": F.lit("t"), "sub_topic": F.col("conv_id").cast("string")})
    rows = records.sft(pairs, "sharegpt", topics=True).withColumn("conv_id", F.col("sub_topic").cast("long"))
    rows = rows.withColumn("reasoning", F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), "sub_topic")))
    out = records.sft_with_reasoning(rows)
    return out.select("conv_id", F.get("conversations", F.lit(0))["value"].alias("value1"), F.get("conversations", F.lit(1))["value"].alias("value2"), F.size("conversations").alias("turns"))


# ------------------------------------------------------------------ gates

_FINISH = "CASE doc_id % 5 WHEN 0 THEN 'stop' WHEN 1 THEN 'length' WHEN 2 THEN 'content_filter' WHEN 3 THEN '' ELSE NULL END"
_CONTENT = "CASE WHEN doc_id % 17 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN text || ' As an AI, I stop here' ELSE text END"
_THOUGHT = "CASE WHEN doc_id % 2 = 0 THEN 'thinking' ELSE '' END"


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"content": _CONTENT, "reasoning_content": _THOUGHT, "finish_reason": _FINISH}
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", *(F.expr(e).alias(c) for c, e in columns.items()))


_REFUSAL_SQL = " OR ".join(f"contains(lower(content), {_quoted(p)})" for p in gates.REFUSALS)
_GATE_SQL = f"""
    WITH c AS (SELECT doc_id, lang, source, {_CONTENT} AS content, {_THOUGHT} AS thought, coalesce({_FINISH}, '') AS finish FROM documents),
    t AS (SELECT *, {_trim("content")} AS trimmed FROM c)
    SELECT doc_id, lang, CASE
        WHEN trimmed = '' AND thought <> '' AND finish = 'length' THEN 'token_exhaustion'
        WHEN NOT (finish IN ('', 'stop') OR (finish = 'length' AND NOT (thought <> '' AND content = ''))) THEN 'finish_reason'
        WHEN CASE WHEN {_bytes("trimmed")} < 50 THEN NOT (thought <> '' AND finish = 'length') ELSE ({_REFUSAL_SQL}) END THEN 'refusal'
        WHEN {_bytes("trimmed")} < 100 THEN 'incomplete'
        WHEN finish = 'length' THEN NULL
        WHEN right(trimmed, 1) NOT IN ('.', '!', '?', '"', '''') THEN 'incomplete' END AS failure_reason
    FROM t"""


@query(f"SELECT doc_id, failure_reason FROM ({_GATE_SQL})")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(_completions(spark, sf_dir)).select("doc_id", "failure_reason")


@query(f"SELECT lang, coalesce(failure_reason, 'pass') AS outcome, count(*) AS n FROM ({_GATE_SQL}) GROUP BY ALL")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(_completions(spark, sf_dir)).groupBy("lang", F.coalesce("failure_reason", F.lit("pass")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN " + _bytes(_trim("t")) + " < 50 THEN 'too short' " + " ".join(f"WHEN contains(lower(t), {_quoted(p)}) THEN {_quoted(p)}" for p in gates.REFUSALS)
       + f" ELSE 'unknown' END AS reason FROM (SELECT doc_id, {_CONTENT} AS t FROM documents)")
def refusal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completions(spark, sf_dir).select("doc_id", gates.refusal_reason(F.col("content")).alias("reason"))


@query(f"""SELECT doc_id, CASE WHEN {_bytes(_trim("text"))} < 100 THEN 'too short'
           WHEN octet_length(encode(regexp_extract({_trim("text")}, '(\\S*?)[.,;:!?"'']*$', 1))) > 2 AND regexp_matches(regexp_extract({_trim("text")}, '(\\S*?)[.,;:!?"'']*$', 1), '[a-z]$') THEN 'mid-sentence'
           ELSE 'no closing punctuation' END AS reason FROM documents
           WHERE {_bytes(_trim("text"))} < 100 OR right({_trim("text")}, 1) NOT IN ('.', '!', '?', '"', '''')""")
def incomplete_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(gates.is_incomplete(F.col("text"), F.lit("stop")))
    return docs.select("doc_id", gates.incomplete_reason(F.col("text")).alias("reason"))


# ------------------------------------------------------------------ text

_TAGGED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '<think> ' || source || ' </think>' || text WHEN 2 THEN '<THINKING>a' || chr(10) || 'b</thinking>x <思考>' || lang || '</思考> ' || source || '<think>c</think>' ELSE '<think>open ' || source END"
_EN, _ZH = "(?i)<think(?:ing)?>([\\s\\S]*?)</think(?:ing)?>", "(?i)<思考>([\\s\\S]*?)</思考>"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TAGGED.replace("chr(10)", "'\n'")).alias("t"))


@query(f"""SELECT doc_id, regexp_matches(t, '{_EN}') OR regexp_matches(t, '{_ZH}') AS has_think,
           array_to_string(list_transform(list_concat(regexp_extract_all(t, '{_EN}', 1), regexp_extract_all(t, '{_ZH}', 1)), lambda x: {_trim("x")}), chr(10) || chr(10)) AS think,
           {_trim(f"regexp_replace(regexp_replace(t, '{_EN}', '', 'g'), '{_ZH}', '', 'g')")} AS answer
           FROM (SELECT doc_id, {_TAGGED} AS t FROM documents)""")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _tagged(spark, sf_dir).select("doc_id", text.has_think(F.col("t")).alias("has_think"), text.split_think(F.col("t")).alias("s"))
    return both.select("doc_id", "has_think", "s.think", "s.answer")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<think>' || chr(10) || source || chr(10) || '</think>' || chr(10) || chr(10) || text END AS combined FROM documents")
def think_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.combine_reasoning(reason, F.col("text")).alias("combined"))


_META = "CASE doc_id % 5 WHEN 4 THEN '\u0130\u0130\u0130\u0130 ' || text || ' LET''\u017f start over' || source WHEN 0 THEN text || ' Let''s start over again' WHEN 1 THEN 'Sure! Let''s start over ' || source WHEN 2 THEN text || ' I''ll rewrite and incorporate all. We don''t want too many lines' ELSE text END"
_META_PATTERN = "(?i)" + "|".join(p.replace("'", "''") for p in text.META_PHRASES)


@query(f"""SELECT doc_id, coalesce(nullif({_trim(f"regexp_replace(t, '({_META_PATTERN})(.|\\n)*', '')")}, ''), t) AS cleaned
           FROM (SELECT doc_id, {_trim(_META)} AS t FROM documents)""")
def meta_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _META.replace("''", "\\'")
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_meta(F.expr(sql)).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS short FROM documents")
def truncate_runes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 60).alias("short"))


@query("SELECT p_partkey, regexp_matches(p_name, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') OR p_partkey % 5 = 0 AS has_control FROM part")
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("\x07"))).otherwise(F.concat("p_name", F.lit("\n\t")))
    return table(spark, sf_dir, "part").select("p_partkey", text.has_control_characters(name).alias("has_control"))


@query("""SELECT n.n_name, r.r_name, 'Write ' || n.n_nationkey::VARCHAR || ' items on ' || n.n_name || CASE WHEN r.r_regionkey <> 0 THEN ' in ' || r.r_name ELSE ' anywhere' END || '.' AS prompt
          FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    prompt = template.render("Write {{.N}} items on {{.Topic}}{{if .Key}} in {{.Region}}{{else}} anywhere{{end}}.", {"N": F.col("n_nationkey"), "Topic": F.col("n_name"), "Key": F.col("r_regionkey"), "Region": F.col("r_name")})
    return rows.select("n_name", "r_name", prompt.alias("prompt"))


_URL = "CASE page_id % 4 WHEN 0 THEN 'https://api.openai.com/v1' WHEN 1 THEN 'https://api.together.ai/v1' WHEN 2 THEN 'http://localhost:8080/v1' ELSE url END"


@query(f"SELECT page_id, CASE {' '.join(f'WHEN contains(u, {_quoted(a)}) THEN {_quoted(b)}' for a, b in naming.PROVIDERS)} ELSE u END AS provider, {' OR '.join(f'contains(u, {_quoted(h)})' for h in naming.LOCAL_HOSTS)} AS is_local FROM (SELECT page_id, {_URL} AS u FROM pages)")
def provider_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("u")).select("page_id", naming.provider_name(F.col("u")).alias("provider"), naming.is_local_endpoint(F.col("u")).alias("is_local"))


@query("SELECT n_nationkey, left(sha256(n_name || ':' || n_regionkey::VARCHAR || ':' || n_nationkey::VARCHAR), 16) AS hash FROM nation")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", naming.config_hash(F.col("n_name"), F.col("n_regionkey"), F.col("n_nationkey")).alias("hash"))


@query("""SELECT l_orderkey, l_linenumber, least(CASE WHEN l_returnflag = 'R' THEN pow(3.0, l_linenumber) * 2.0 ELSE pow(2.0, l_linenumber - 1) * 2.0 END, 60.0) AS wait FROM lineitem""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = naming.backoff(F.col("l_linenumber"), 2.0, 60.0, F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", wait.alias("wait"))


@query("SELECT event_id, 'session_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') AS session FROM events")
def session_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", naming.session_name(F.col("ts")).alias("session"))


# ------------------------------------------------------------------ lists and jobs

_TYPES = "CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || upper(p_type) || ' ' ELSE p_type || (p_partkey % 20)::VARCHAR END"
_DEDUP_SQL = f"""SELECT item, pos FROM (SELECT trim(t) AS item, p_partkey AS pos, row_number() OVER (PARTITION BY lower(trim(t)) ORDER BY p_partkey) AS k
                 FROM (SELECT p_partkey, {_TYPES} AS t FROM part) WHERE trim(t) <> '') WHERE k = 1"""


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.expr(_TYPES.replace("::VARCHAR", "::STRING")).alias("item"), F.col("p_partkey").alias("pos"))


@query(_DEDUP_SQL)
def dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.dedup_ordered(_types(spark, sf_dir))


@query(f"SELECT item, pos FROM ({_DEDUP_SQL}) ORDER BY pos LIMIT 20")
def over_generate_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.take_first(lists.dedup_ordered(_types(spark, sf_dir)), 20)


@query("""WITH u AS (SELECT 0 AS b, n_nationkey AS pos, n_name AS item FROM nation UNION ALL SELECT 1, r_regionkey, r_name FROM region
                     UNION ALL SELECT 2, n_nationkey, lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'x' END FROM nation)
          SELECT item, b, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(item) ORDER BY b, pos) AS k FROM u) WHERE k = 1""")
def union_rededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    again = nation.select(F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("x")).alias("item"), F.col("n_nationkey").alias("pos"))
    merged = lists.merge_requests(nation.select(F.col("n_name").alias("item"), F.col("n_nationkey").alias("pos")), region.select(F.col("r_name").alias("item"), F.col("r_regionkey").alias("pos")), again)
    return lists.dedup_ordered(merged).select("item", F.col("pos.batch").alias("b"), F.col("pos.pos").cast("int").alias("pos"))


@query("""SELECT n_regionkey, array_to_string(list_slice(l, greatest(len(l) - 2, 1), len(l)), ', ') AS exclude, len(l) > 3 AS truncated
          FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey)""")
def exclusion_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("l")).select("n_regionkey", lists.last_n(F.col("l"), 3).alias("x"))
    return rows.select("n_regionkey", F.array_join("x.items", ", ").alias("exclude"), F.col("x.truncated").alias("truncated"))


@query("""SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS job_id, source AS main_topic, lang AS sub_topic, prompt FROM
          (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS prompt, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE doc_id % 3 <> 0)""")
def jobs_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sub_idx"), F.col("source").alias("main_topic"), F.col("lang").alias("sub_topic"), F.when(F.col("doc_id") % 3 != 0, F.split("text", "\n")).alias("prompts"))
    return lists.jobs(docs)


@query("SELECT id AS chunk_no, least(30, 100 - id * 30)::INTEGER AS n FROM range(0, 4) t(id)")
def request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.chunks(spark, 100, 30)


@query("SELECT o_orderkey AS job_id, o_orderpriority AS prompt FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("prompt"))
    return lists.pending(all_jobs, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")))


@query("SELECT c.c_custkey, CASE WHEN c.c_custkey % 3 = 0 THEN 'again ' || c.c_name WHEN c.c_custkey % 2 = 0 THEN c.c_name END AS result FROM customer c")
def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("result"))
    again = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("again "), "c_name").alias("result"))
    return lists.retried(rows, again, "c_custkey", "result")


# ------------------------------------------------------------------ JSON and judging

_JUDGE_OK = "d.doc_id % 9 <> 4 AND l.quality IS NOT NULL"
_JUDGED_SQL = f"""SELECT d.doc_id AS job_id, CASE WHEN {_JUDGE_OK} THEN ((d.doc_id % 5 + 1) + (d.n_chars % 5 + 1)) / 2.0 END AS chosen_score_total,
    CASE WHEN l.quality IS NOT NULL THEN (l.quality + 1)::DOUBLE END AS rejected_score_total,
    CASE WHEN {_JUDGE_OK} THEN ((d.doc_id % 5 + 1) + (d.n_chars % 5 + 1)) / 2.0 - (l.quality + 1) END AS preference_margin
    FROM documents d JOIN labels l USING (doc_id)"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' replies as models write them: fenced, cut off, with single quotes, raw line ends or superfluous commas; some are beyond repair."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    a, b = (F.col("doc_id") % 5 + 1).cast("string"), (F.col("n_chars") % 5 + 1).cast("string")
    plain = F.concat(F.lit('{"plot": {"score": '), a, F.lit(', "reasoning": "good"}, "style": {"score": '), b, F.lit(', "reasoning": "fine"}}'))
    chosen = (
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Here it is:\n```json\n"), plain, F.lit("\n```")))
        .when(F.col("doc_id") % 9 == 1, F.replace(F.col("p"), F.lit('"good"'), F.lit("'go \"o\" d'")))
        .when(F.col("doc_id") % 9 == 2, F.replace(F.col("p"), F.lit("good"), F.lit("go\nod")))
        .when(F.col("doc_id") % 9 == 3, F.replace(F.col("p"), F.lit("}, "), F.lit(",}, ")))
        .when(F.col("doc_id") % 9 == 4, F.lit("I would rather not say"))
        .when(F.col("doc_id") % 9 == 5, F.replace(F.col("p"), F.lit("}, "), F.lit("} ")))
        .otherwise(F.col("p"))
    )
    rejected = F.concat(F.lit('{"plot": {"score": '), (F.col("quality") + 1).cast("string"), F.lit("}}"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), chosen.alias("response")), F.struct(F.lit("rejected").alias("side"), rejected.alias("response")))
    return rows.withColumn("p", plain).select(F.col("doc_id").alias("job_id"), F.inline(sides))


@query(_JUDGED_SQL)
def judge_mean_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.judged(_replies(spark, sf_dir)).select("job_id", "chosen_score_total", "rejected_score_total", "preference_margin")


@query(f"SELECT job_id FROM ({_JUDGED_SQL}) WHERE NOT coalesce(chosen_score_total < 2.5 OR coalesce(rejected_score_total > 1.5, false), false)")
def judge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = judging.judged(_replies(spark, sf_dir))
    return scored.where(judging.passes(F.col("chosen_score_total"), F.col("rejected_score_total"), 2.5, 1.5)).select("job_id")


@query(f"SELECT d.doc_id, d.source AS main_topic, d.lang AS sub_topic, j.chosen_score_total, j.preference_margin FROM documents d LEFT JOIN ({_JUDGED_SQL}) j ON d.doc_id = j.job_id")
def modpo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("source").alias("main_topic"), F.col("lang").alias("sub_topic"), F.col("doc_id").cast("string").alias("prompt"), F.col("text").alias("chosen"), F.col("text").alias("rejected"))
    rows = records.modpo(records.attach_judgement(docs, judging.judged(_replies(spark, sf_dir))))
    return rows.select(F.col("prompt").cast("long").alias("doc_id"), "main_topic", "sub_topic", "chosen_score_total", "preference_margin")


_LIST = "CASE doc_id % 6 WHEN 0 THEN '[\"' || source || '\", \" \", \"' || lang || '\"]' WHEN 1 THEN 'Sure: [\"' || source || '\" \"' || lang || '\"] ok' WHEN 2 THEN '[\"' || source || '\", \"' || lang || '\"' WHEN 3 THEN '[\"' || source || '\",, \"' || lang || '\",]' WHEN 4 THEN 'none' ELSE '[]' END"


@query("""SELECT doc_id, CASE WHEN doc_id % 6 <= 3 THEN source || '|' || lang WHEN doc_id % 6 = 5 THEN '' END AS items, CASE WHEN doc_id % 6 <= 3 THEN 2 WHEN doc_id % 6 = 5 THEN 0 ELSE -1 END AS n FROM documents""")
def string_array_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", jsonkit.strings_of(1)(F.expr(_LIST)).alias("x"))
    return rows.select("doc_id", F.array_join("x", "|").alias("items"), F.when(F.col("x").isNotNull(), F.size("x")).otherwise(F.lit(-1)).alias("n"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 3 WHEN 5 THEN 0 ELSE -1 END AS n FROM documents""")
def json_array_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(jsonkit.json_array_size(F.expr(_LIST)).cast("int"), F.lit(-1)).alias("n"))


@query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' AS fixed FROM events""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit('Result: {"k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, F.lit(",} done")).otherwise(F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", jsonkit.repair_json(broken).alias("fixed"))


# ------------------------------------------------------------------ regeneration of rejected replies


@query(f"""WITH b AS (SELECT conv_id, prompt, '<think>t' || conv_id::VARCHAR || '</think>' || chosen AS old, 'new ' || conv_id::VARCHAR AS fresh FROM ({_PAIRS_SQL}))
           SELECT prompt, {_trim("regexp_replace(old, '" + _EN + "', '', 'g')")} AS chosen, fresh AS rejected, '<think>' || chr(10) || 't' || conv_id::VARCHAR || chr(10) || '</think>' || chr(10) || chr(10) || fresh AS rejected_reasoning FROM b""")
def regen_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairsmith.plans import transforms

    base = _pairs(spark, sf_dir)
    old = F.concat(F.lit("<think>t"), F.col("conv_id").cast("string"), F.lit("</think>"), "chosen")
    rows = base.select(F.col("conv_id").alias("job_id"), "prompt", old.alias("chosen"), old.alias("rejected"))
    fresh = base.select(F.col("conv_id").alias("job_id"), F.concat(F.lit("new "), F.col("conv_id").cast("string")).alias("content"))
    plain, reasoned = transforms.regenerated(rows, fresh)
    return plain.select("job_id", "prompt", "chosen", "rejected").join(reasoned.select("job_id", F.col("rejected").alias("rejected_reasoning")), "job_id").drop("job_id")


# ------------------------------------------------------------------ statistics

_RESULTS = """SELECT o_orderkey, o_orderpriority AS provider, CASE o_orderstatus WHEN 'F' THEN 'refusal' END AS failure_reason, o_orderkey % 7 = 0 AS filtered,
              CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 <> 0 THEN o_custkey * 1000 ELSE 0 END AS duration_ns FROM orders"""
_STATS_SQL = f"""SELECT *, CASE WHEN success > 0 THEN total_duration_ns // success ELSE 0 END AS average_duration_ns, failure * 100.0 / total AS failure_rate FROM (
    SELECT provider, count(*) AS total, count(*) FILTER (failure_reason IS NULL AND NOT filtered) AS success, count(failure_reason) AS failure,
           count(*) FILTER (failure_reason IS NULL AND filtered) AS filtered, sum(duration_ns)::BIGINT AS total_duration_ns FROM ({_RESULTS}) GROUP BY provider)"""


@query(_STATS_SQL)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return stats.session_stats(spark.sql(_RESULTS.replace("FROM orders", "FROM _orders")), ["provider"])


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS completed, count(*) AS total,
          count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) * 100.0 / count(*) AS percent FROM orders GROUP BY o_orderpriority""")
def session_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderpriority")
    return stats.progress(all_jobs, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")), ["o_orderpriority"])


@query("SELECT count(*) FILTER (c_acctbal > 0) AS good, count(*) AS total, count(*) FILTER (c_acctbal > 0) * 1.0 / count(*) AS rate, count(*) FILTER (c_acctbal > 0) * 1.0 / count(*) >= 0.9 AS enough FROM customer")
def prompt_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.success_rate(table(spark, sf_dir, "customer"), F.col("c_acctbal") > 0, 0.9)


@query("""SELECT e.event_type, b.le, count(*) FILTER (e.value <= b.le) AS n FROM events e, (VALUES (1.0::DOUBLE), (2.0), (4.0), (8.0), (16.0), (32.0), (64.0), (128.0), ('inf'::DOUBLE)) b(le) GROUP BY e.event_type, b.le""")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events"), "value", 1.0, 2.0, 8, ["event_type"])


_LOG = "SELECT event_type AS workers, event_id AS job_id, value AS chosen_ms, value * 2 AS rejected_ms, value * 3 AS total_ms, CASE WHEN event_id % 4 = 0 THEN event_id % 100 ELSE 0 END AS rate_limit_wait_ms, 60.0 + length(event_type) AS duration_s FROM events"
_BENCH_SQL = f"""SELECT workers, count(*) AS jobs, round(avg(chosen_ms), 6) AS chosen_ms, round(avg(rejected_ms), 6) AS rejected_ms, round(avg(total_ms), 6) AS total_ms, round(avg(rate_limit_wait_ms), 6) AS wait_ms,
    round(count(*) FILTER (rate_limit_wait_ms > 0) * 100.0 / count(*), 6) AS blocking, max(duration_s)::DOUBLE AS duration_s, round(count(*) / (max(duration_s) / 60), 6) AS throughput FROM ({_LOG}) GROUP BY workers"""


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("_events")
    out = stats.bench_metrics(spark.sql(_LOG.replace("FROM events", "FROM _events").replace("60.0 +", "60.0D +")), ["workers"])
    return out.withColumns({c: F.round(c, 6) for c in ("chosen_ms", "rejected_ms", "total_ms", "wait_ms", "blocking", "throughput")})


@query(_BENCH_SQL)
def bench_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir)


@query(f"SELECT workers, throughput FROM ({_BENCH_SQL}) ORDER BY throughput DESC, workers LIMIT 1")
def bench_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.best(_bench(spark, sf_dir)).select("workers", "throughput")


_KIND = f"CASE WHEN {_trim('text')} = '' THEN 'empty' WHEN right({_trim('text')}, 1) IN ('.', '!', '?', '\"') THEN 'complete' ELSE 'incomplete' END"
_RELIABILITY_SQL = f"""WITH r AS (SELECT source, count(*) AS total, count(*) FILTER (k = 'complete') AS complete, count(*) FILTER (k = 'incomplete') AS incomplete, count(*) FILTER (k = 'empty') AS empty
    FROM (SELECT source, {_KIND} AS k FROM documents) GROUP BY source),
    l AS (SELECT source, count(*) FILTER (doc_id % 3 = 0) AS caught_incomplete, count(*) FILTER (doc_id % 3 = 1) AS caught_refusals, 0::BIGINT AS caught_length FROM documents GROUP BY source)
    SELECT source, total, complete, incomplete, empty, coalesce(caught_incomplete, 0) AS caught_incomplete, coalesce(caught_refusals, 0) AS caught_refusals, coalesce(caught_length, 0) AS caught_length,
           round(total * 100.0 / (total + coalesce(caught_incomplete, 0) + coalesce(caught_refusals, 0)), 6) AS success FROM r LEFT JOIN l USING (source)"""


@query(_RELIABILITY_SQL)
def reliability_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    message = F.when(F.col("doc_id") % 3 == 0, F.lit("Incomplete output detected")).when(F.col("doc_id") % 3 == 1, F.lit("Refusal detected")).otherwise(F.lit("ok"))
    log = docs.select("source", message.alias("msg"))
    return stats.reliability(docs, log, ["source"]).withColumn("success", F.round("success", 6))


@query(f"""SELECT source, doc_id, rank::INTEGER AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM (SELECT source, doc_id, {_KIND} AS k FROM documents) WHERE k = 'incomplete') WHERE rank <= 3""")
def incomplete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.samples(table(spark, sf_dir, "documents"), ["source"], "text", "doc_id").select("source", "doc_id", "rank")


@query("SELECT 'session_' || user_id::VARCHAR AS session, count(*) AS jobs FROM events GROUP BY user_id HAVING count(*) >= 5 ORDER BY session DESC LIMIT 4")
def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session"), F.col("event_id").alias("job_id"))
    return stats.latest_sessions(log, 5, 4)


@query("SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def latest_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest_by(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), "event_type", "event_id")


# ------------------------------------------------------------------ server-sent events


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a stream of pieces, with the noise that servers send, and lines after the end."""
    docs = table(spark, sf_dir, "documents")
    pieces = docs.select(F.col("doc_id").alias("request_id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"([\s\S]{1,50})"), F.lit(1))).alias("k", "piece"))

    def event(content: Column, finish: Column) -> Column:
        delta = F.struct(content.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))
        body = F.struct(F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("id"), F.lit("m").alias("model"), F.col("request_id").alias("created"), F.array(F.struct(delta.alias("delta"), finish.alias("finish_reason"))).alias("choices"))
        return F.concat(F.lit("data: "), F.to_json(body))

    none = F.lit(None).cast("string")
    body = pieces.select("request_id", (F.col("k") * 3 + 1).alias("seq"), event(F.col("piece"), none).alias("line"))
    noise = pieces.select("request_id", (F.col("k") * 3 + 2).alias("seq"), F.when(F.col("k") % 2 == 0, F.lit("")).otherwise(F.lit("data: {bad")).alias("line"))
    tail = docs.select(F.col("doc_id").alias("request_id"), F.posexplode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k", "_"))
    line = F.when(F.col("k") == 0, event(none, F.lit("stop"))).when(F.col("k") == 1, F.lit("data: [DONE]")).otherwise(event(F.lit("late"), none))
    return body.union(noise).union(tail.select("request_id", (F.lit(10_000_000) + F.col("k")).alias("seq"), line))


@query("SELECT doc_id AS request_id, 'r' || doc_id::VARCHAR AS id, 'm' AS model, doc_id AS created, text AS content, '' AS reasoning_content, 'stop' AS finish_reason, true AS done_seen FROM documents")
def sse_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.assemble(chunks.parse_events(_event_lines(spark, sf_dir)))


# ------------------------------------------------------------------ limits and checks

_LIMITS = "SELECT l_orderkey, l_linenumber, l_orderkey % 997 + 1 AS rpm, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 503 + 1 END AS shared, l_suppkey % 50 + 1 AS percent, l_orderkey % 200 + 1 AS jobs FROM lineitem"


@query(f"""WITH r AS (SELECT *, CASE WHEN shared IS NOT NULL THEN greatest(3, shared * (percent + 100) // 100) ELSE greatest(5, rpm // 5) END AS effective FROM ({_LIMITS}))
           SELECT l_orderkey, l_linenumber, coalesce(shared, rpm)::DOUBLE / 60 AS rate,
                  CASE WHEN shared IS NOT NULL THEN greatest(3, shared * percent // 100) ELSE greatest(5, rpm // 5) END::BIGINT AS burst,
                  effective::BIGINT AS effective, greatest(least(jobs, effective, 64), 1)::BIGINT AS workers FROM r""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    rows = spark.sql(_LIMITS.replace("FROM lineitem", "FROM _lineitem"))
    rows = rows.withColumns({"b": limits.in_force(F.col("rpm"), F.col("shared"), F.col("percent")), "effective": limits.effective_rate(F.col("rpm"), F.col("shared"), F.col("percent"))})
    return rows.select("l_orderkey", "l_linenumber", "b.rate", "b.burst", "effective", limits.workers(F.col("jobs"), F.col("effective"), F.lit(64)).alias("workers"))


_NAMES = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '../' WHEN 2 THEN 'x' WHEN 3 THEN '/etc' ELSE '' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 7 IN (1, 2, 3) OR event_id % 11 = 0 THEN false ELSE true END AS ok FROM events""")
def session_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    wrong = F.expr(_NAMES)
    name = F.when(F.col("event_id") % 7 == 1, F.concat(wrong, naming.session_name(F.col("ts")))).otherwise(F.concat(naming.session_name(F.col("ts")), wrong))
    return events.select("event_id", checks.session_name_ok(F.when(F.col("event_id") % 11 != 0, name)).alias("ok"))


_RUNS = """SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN '  ' WHEN doc_id % 29 = 0 THEN repeat(text, 2) ELSE lang END AS main_topic, doc_id % 101 AS num_subtopics, doc_id % 97 * 200 AS num_prompts_per_subtopic,
    n_chars % 1100 AS concurrency, (doc_id % 13) / 10.0 AS over_generation_buffer, (doc_id % 11) / 10.0 AS min_success_rate, doc_id % 7 AS prompt_retry_attempts,
    CASE doc_id % 5 WHEN 0 THEN 'sft' WHEN 1 THEN 'dpo' WHEN 2 THEN 'kto' WHEN 3 THEN 'mo-dpo' WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'rlhf' ELSE 'dpo' END END AS dataset_mode,
    CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'alpaca' END AS sft_format FROM documents"""


@query(f"""SELECT doc_id, CASE WHEN {_trim('main_topic')} = '' OR octet_length(encode(main_topic)) > 500 OR regexp_matches(main_topic, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]') THEN 'main_topic'
           WHEN num_subtopics NOT BETWEEN 1 AND 10000 THEN 'num_subtopics' WHEN num_prompts_per_subtopic NOT BETWEEN 1 AND 10000 THEN 'num_prompts_per_subtopic'
           WHEN concurrency NOT BETWEEN 1 AND 1024 THEN 'concurrency' WHEN over_generation_buffer NOT BETWEEN 0 AND 1 THEN 'over_generation_buffer'
           WHEN min_success_rate NOT BETWEEN 0 AND 1 THEN 'min_success_rate' WHEN prompt_retry_attempts NOT BETWEEN 0 AND 5 THEN 'prompt_retry_attempts'
           WHEN dataset_mode NOT IN ('sft', 'dpo', 'kto', 'mo-dpo') THEN 'dataset_mode' WHEN coalesce(sft_format, '') NOT IN ('alpaca', 'sharegpt') THEN 'sft_format' END AS problem FROM ({_RUNS})""")
def run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("_runs")
    return checks.checked(spark.sql(_RUNS.replace("FROM documents", "FROM _runs")), checks.run_problem()).select("doc_id", "problem")


_MODELS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'ftp://h.com/v1' WHEN 1 THEN 'http:///v1' WHEN 2 THEN 'HTTPS://u:p@h.com:8080/v1' WHEN 3 THEN 'https://h.com/' || page_id ELSE url END AS base_url,
    CASE WHEN page_id % 31 = 0 THEN '' WHEN page_id % 37 = 0 THEN repeat('m', 101) ELSE 'model' END AS model_name, (page_id % 23) / 10.0 AS temperature, (page_id % 3) / 1.0 AS structure_temperature,
    (page_id % 12) / 10.0 AS top_p, page_id % 41 * 100 AS max_output_tokens, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 3500 END AS context_size, page_id % 43 AS rate_limit_per_minute FROM pages"""


@query(f"""SELECT page_id, CASE WHEN NOT regexp_matches(base_url, '^(?i:https?)://([^/?#@]*@)?[^/?#:@]+') THEN 'base_url' WHEN model_name = '' OR length(model_name) > 100 THEN 'model_name'
           WHEN temperature > 2 THEN 'temperature' WHEN top_p > 1 THEN 'top_p' WHEN max_output_tokens < 1 THEN 'max_output_tokens'
           WHEN context_size > 0 AND max_output_tokens > context_size THEN 'max_output_tokens is beyond the context' WHEN rate_limit_per_minute < 1 THEN 'rate_limit_per_minute' END AS problem FROM ({_MODELS})""")
def model_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "pages").createOrReplaceTempView("_models")
    return checks.checked(spark.sql(_MODELS.replace("FROM pages", "FROM _models")), checks.model_problem()).select("page_id", "problem")


# ------------------------------------------------------------------ JSON kernel and judges' replies, one by one

_DEEP = "concat(repeat('{\"a\": ', event_id % 4 + 1), '\"x } ', event_type, '\"', repeat('}', event_id % 3), repeat(' ', event_id % 2))"


@query("""SELECT event_id, greatest(event_id % 4 + 1 - event_id % 3, 0)::BIGINT AS still_open,
          CASE WHEN event_id % 3 = event_id % 4 + 1 THEN (event_id % 4 + 1) * 6 + length(event_type) + 6 + event_id % 3 - 1
               WHEN event_id % 3 > event_id % 4 + 1 THEN (event_id % 4 + 1) * 6 + length(event_type) + 6 + event_id % 4 ELSE -1 END::BIGINT AS closed_at FROM events""")
def json_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_DEEP).alias("t"))
    return rows.select("event_id", jsonkit.open_brackets("{", "}")("t").alias("still_open"), jsonkit.closing_bracket("{", "}")("t").alias("closed_at"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '["' || source || '", "a]b"]' WHEN 1 THEN '["' || source || '"]' WHEN 2 THEN '{"s": "' || source || '"}' WHEN 3 THEN '["' || source || '", "' || lang || '"]' ELSE source END AS found,
          CASE doc_id % 2 WHEN 0 THEN '{"k": "' || source || '\\n' || lang || '"}' ELSE '{"k": "' || source || '"}' END AS clean FROM documents""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, q = F.col("source"), F.lit('"')
    reply = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('Here: ["'), s, F.lit('", "a]b"] and more ] text')))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('```json\n["'), s, F.lit('"]\n```\n["no"]')))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit('{"s": "'), s, F.lit('"} ok')))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit('list: ["'), s, F.lit('", "'), F.col("lang"), q, F.lit(", ")))
        .otherwise(F.concat(F.lit("  "), s, F.lit("\n")))
    )
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"k": "'), s, F.lit("\r\n"), F.col("lang"), F.lit('"}'))).otherwise(F.concat(F.lit("{\"k\": '"), s, F.lit("'}")))
    return table(spark, sf_dir, "documents").select("doc_id", jsonkit.extract_json(reply).alias("found"), jsonkit.sanitize_json(raw).alias("clean"))


@query("""SELECT d.doc_id AS job_id, 'chosen' AS side, CASE d.doc_id % 9 WHEN 3 THEN 2 WHEN 5 THEN 2 WHEN 4 THEN NULL ELSE 1 END::INTEGER AS strategy,
                 CASE WHEN d.doc_id % 9 <> 4 THEN 2 END::INTEGER AS criteria, CASE WHEN d.doc_id % 9 <> 4 THEN d.doc_id % 5 + 1 END::INTEGER AS plot FROM documents d JOIN labels l USING (doc_id)
          UNION ALL SELECT d.doc_id, 'rejected', CASE WHEN l.quality IS NOT NULL THEN 1 END::INTEGER, CASE WHEN l.quality IS NOT NULL THEN 1 END::INTEGER, (l.quality + 1)::INTEGER FROM documents d JOIN labels l USING (doc_id)""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _replies(spark, sf_dir).select("job_id", "side", jsonkit.judge_udf("array")("response").alias("j"))
    return parsed.select("job_id", "side", F.col("j.strategy").cast("int").alias("strategy"), F.when(F.col("j").isNotNull(), F.size("j.scores")).alias("criteria"), F.col("j.scores")["plot"]["score"].alias("plot"))


_RUBRIC = "Rate by {{.Criteria}}.\nTask: {{.Prompt}}\n{{if .StoryText}}Reply: {{.StoryText}}{{else}}No reply.{{end}}"


@query(f"""WITH s AS (SELECT conv_id, prompt, 'chosen' AS side, chosen AS reply FROM ({_GATED_SQL}) UNION ALL SELECT conv_id, prompt, 'rejected', rejected FROM ({_GATED_SQL}))
           SELECT conv_id, side, 'Rate by {", ".join(CRITERIA)}.' || chr(10) || 'Task: ' || prompt || chr(10) || 'Reply: ' || reply AS prompt FROM s""")
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judging.sides(_gated_pairs(spark, sf_dir), ("conv_id", "prompt"))
    return rows.select("conv_id", "side", template.render(_RUBRIC, {"Criteria": F.lit(", ".join(CRITERIA)), "Prompt": F.col("prompt"), "StoryText": F.col("reply")}).alias("prompt"))


# ------------------------------------------------------------------ files: lines, commits, checkpoints


@query("SELECT doc_id AS line_no, lang AS prompt, text AS chosen, source AS rejected FROM documents WHERE doc_id % 6 NOT IN (1, 2, 3)")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of a file, some blank, some cut off or no object, read again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("prompt"), F.col("text").alias("chosen"), F.col("source").alias("rejected"))
    whole = sinks.json_of([F.col(c).alias(c) for c in ("prompt", "chosen", "rejected")])
    line = F.when(F.col("doc_id") % 6 == 1, F.lit(" \t")).when(F.col("doc_id") % 6 == 2, F.substring(whole, 1, 12)).when(F.col("doc_id") % 6 == 3, F.lit("[1]")).when(F.col("doc_id") % 6 == 4, F.concat(F.lit("  "), whole, F.lit(" "))).otherwise(whole)
    return jsonl.parse_lines(docs.select(F.col("doc_id").alias("line_no"), line.alias("line")), records.DPO_SCHEMA, strict=False)


@query("""SELECT doc_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS oid, octet_length(encode(text)) >= 4096 AS lfs, base64(encode(text)[1:200]) AS sample FROM documents""")
def commit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hub.plan_of(F.encode("text", "UTF-8"), 4096).alias("p")).select("doc_id", "p.*")


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint file for each customer: its orders are the jobs, those with an R line are done."""
    orders = table(spark, sf_dir, "orders")
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(True))
    job = F.struct(F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("MainTopic"), F.col("o_orderstatus").alias("SubTopic"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("Prompt"))
    each = orders.join(done, "o_orderkey", "left").groupBy("o_custkey").agg(F.collect_list(job).alias("prompts"), F.collect_list(F.when(F.col("done"), F.col("o_orderkey").cast("string"))).alias("ids"))
    ids = F.map_from_entries(F.transform("ids", lambda i: F.struct(i, F.lit(True))))
    phase = F.when(F.col("o_custkey") % 5 == 0, F.lit("prompts")).otherwise(F.lit("pairs"))
    body = F.struct(phase.alias("current_phase"), F.array(F.lit("a"), F.lit("b")).alias("subtopics"), (F.col("o_custkey") % 5 != 0).alias("prompts_complete"), F.col("prompts"), ids.alias("completed_job_ids"), F.lit("unread").alias("other"))
    value = F.when(F.col("o_custkey") % 17 == 0, F.lit("{cut")).otherwise(F.to_json(body))
    return checkpoints.parse_checkpoints(each.select(F.concat(F.lit("session_"), F.col("o_custkey").cast("string")).alias("session"), value.alias("value")))


_DONE_SQL = "SELECT o.*, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AS done FROM orders o WHERE o_custkey % 17 <> 0"


@query(f"""SELECT 'session_' || o_custkey::VARCHAR AS session, CASE WHEN o_custkey % 5 = 0 THEN 'prompts' ELSE 'pairs' END AS phase, 2::BIGINT AS subtopics, count(*) FILTER (done) AS completed, count(*) AS total,
           round(count(*) FILTER (done) * 100.0 / count(*), 6) AS percent FROM ({_DONE_SQL}) GROUP BY o_custkey""")
def checkpoint_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.progress_of(_checkpoints(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"""SELECT 'session_' || o_custkey::VARCHAR AS session, o_orderkey AS job_id, o_orderpriority AS main_topic, o_orderstatus AS sub_topic, 'p' || o_orderkey::VARCHAR AS prompt FROM ({_DONE_SQL}) WHERE NOT done AND o_custkey % 5 <> 0""")
def checkpoint_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.pending_of(_checkpoints(spark, sf_dir))


@query("""WITH j AS (SELECT doc_id AS job_id, lang || ' ' || source AS prompt, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents),
          n AS (SELECT lang || ' ' || source AS prompt, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT job_id FROM j JOIN n USING (prompt) WHERE k <= n""")
def written_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a dataset has records for, some of which have the same prompt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("prompt"))
    there = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("prompt").agg(F.count("*").alias("n"))
    return checkpoints.written_jobs(docs.withColumnRenamed("doc_id", "job_id"), there)
