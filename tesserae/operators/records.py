"""Record shaping.

One unified record schema for all domains: ``metadata`` is the union of the
per-domain fields, all nullable, so corpora union by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import render as R
from tesserae.functions.text import hex_prefix_int, md5_key
from tesserae.operators.sampling import (count_unique_ids, head_n, sample_n, seeded_index, with_index)
from tesserae.schemas import METADATA_FIELDS

# ---------------------------------------------------------------------------
# FIXED VALUES: the four incident templates of the synthetic corpus
# (scenario, log lines, config, metrics, root cause, fix plan).  Config and
# metrics are stored as the exact JSON text the reference renders
# (ensure_ascii off, indent 2).
INCIDENT_TEMPLATES = [
    {
        "scenario": "数据库连接池耗尽",
        "logs": [
            "2024-09-09 10:23:11 ERROR [ConnectionPool-1] HikariPool timeout after 30s, total=20, active=20, idle=0",
            "2024-09-09 10:23:12 WARN [PaymentService] Database connection failed: pool exhausted",
            "2024-09-09 10:23:13 ERROR [CircuitBreaker] Circuit opened for mysql-primary:3306",
        ],
        "config_json": '{\n  "hikari_pool_size": 20,\n  "connection_timeout": 30000,\n  "max_lifetime": 300000\n}',
        "metrics_json": '{\n  "cpu_usage": "45%",\n  "memory_usage": "78%",\n  "active_connections": 20,\n  "qps": 850\n}',
        "root_cause": "数据库连接池配置过小，在高并发场景下无法满足需求",
        "fix_plan": ["增加连接池大小到50-100", "优化慢查询减少连接占用时间", "添加连接池监控告警"],
    },
    {
        "scenario": "内存泄漏导致OOM",
        "logs": [
            "2024-09-09 11:15:23 WARN [GC] Full GC took 2.3s, heap: 7.8GB/8GB used",
            "2024-09-09 11:15:45 ERROR [JVM] OutOfMemoryError: Java heap space",
            "2024-09-09 11:15:46 ERROR [K8s] Pod order-service-7d9f restarts: 3/5",
        ],
        "config_json": '{\n  "jvm_heap": "8GB",\n  "gc_algorithm": "G1GC",\n  "pod_memory_limit": "10GB"\n}',
        "metrics_json": '{\n  "heap_usage": "95%",\n  "gc_frequency": "每30s一次FullGC",\n  "restart_count": 3\n}',
        "root_cause": "应用存在内存泄漏，对象无法被GC回收导致堆内存耗尽",
        "fix_plan": ["使用Memory Profiler定位内存泄漏点", "临时增加堆内存到12GB", "优化对象生命周期管理"],
    },
    {
        "scenario": "磁盘空间不足",
        "logs": [
            "2024-09-09 14:30:12 ERROR [FileSystem] Disk usage: 98% on /var/log",
            "2024-09-09 14:30:15 WARN [LogRotate] Cannot create new log file: No space left on device",
            "2024-09-09 14:30:18 ERROR [ES] Elasticsearch cluster RED: disk threshold exceeded",
        ],
        "config_json": '{\n  "log_retention": "30天",\n  "disk_size": "500GB",\n  "es_shard_size": "50GB"\n}',
        "metrics_json": '{\n  "disk_usage": "98%",\n  "log_growth_rate": "10GB/day",\n  "es_index_size": "450GB"\n}',
        "root_cause": "日志文件和ES索引占用过多磁盘空间，且缺乏自动清理机制",
        "fix_plan": ["立即清理7天前的日志文件", "配置日志自动轮转和压缩", "设置ES索引自动删除策略"],
    },
    {
        "scenario": "网络延迟异常",
        "logs": [
            "2024-09-09 16:45:30 WARN [HTTP] Upstream response time: 5.2s (normal: 200ms)",
            "2024-09-09 16:45:33 ERROR [LoadBalancer] Backend server timeout: api-server-3",
            "2024-09-09 16:45:35 INFO [K8s] Node network plugin showing errors",
        ],
        "config_json": '{\n  "upstream_timeout": "3s",\n  "keepalive_requests": 100,\n  "worker_connections": 1024\n}',
        "metrics_json": '{\n  "avg_response_time": "5.2s",\n  "p99_latency": "8.5s",\n  "network_errors": "12/min"\n}',
        "root_cause": "网络插件异常导致跨节点通信延迟增加",
        "fix_plan": ["重启异常节点的网络插件", "检查网络设备配置", "临时将流量切换到正常节点"],
    },
]
# ---------------------------------------------------------------------------

TEMPLATE_SCHEMA = ("template_idx int, scenario string, logs array<string>, config_json string, "
                   "metrics_json string, root_cause string, fix_plan array<string>")


def metadata(**fields: Column) -> Column:
    """The unified metadata struct; unspecified fields are typed nulls."""
    cols = []
    for name, dtype in METADATA_FIELDS:
        c = fields.get(name)
        cols.append((c if c is not None else F.lit(None)).cast(dtype).alias(name))
    return F.struct(*cols)


def normalize_math(df: DataFrame, question_col: str, answer_col: str, id_col: str,
                   sample_size: int | None = None, seed: int = 42,
                   answer_field: str = "expected_answer") -> DataFrame:
    """``{question, answer}`` -> unified records.

    The sample is drawn by M1; ids ``gsm8k_%04d`` come from the position in
    the sample (W1 over the seeded order), so they are dense and reproducible.
    """
    sampled = sample_n(df, sample_size, id_col, seed, keep_key=True) if sample_size is not None else df
    indexed, _ = seeded_index(sampled, id_col, "_i", seed=seed)
    return indexed.select(
        F.format_string("gsm8k_%04d", F.col("_i")).alias("id"),
        F.lit("math").alias("domain"), F.lit("medium").alias("difficulty"),
        R.math_prompt(F.col(question_col)).alias("prompt"),
        F.col(answer_col).alias(answer_field),
        metadata(source=F.lit("gsm8k"), original_index=F.col("_i")).alias("metadata"))


def normalize_code(df: DataFrame, task_id_col: str, prompt_col: str, solution_col: str,
                   test_col: str, entry_point_col: str, order_cols: list[str],
                   n: int | None = None, answer_field: str = "expected_answer") -> DataFrame:
    """First n tasks (explicit order) -> unified records."""
    head = head_n(df, n, order_cols)
    return head.select(
        F.concat(F.lit("humaneval_"), F.col(task_id_col).cast("string")).alias("id"),
        F.lit("code").alias("domain"), F.lit("hard").alias("difficulty"),
        R.code_prompt(F.col(prompt_col)).alias("prompt"),
        F.col(solution_col).alias(answer_field),
        metadata(source=F.lit("humaneval"), task_id=F.col(task_id_col).cast("string"),
                 test_cases=F.col(test_col), entry_point=F.col(entry_point_col)).alias("metadata"))


def incident_templates(spark) -> DataFrame:
    rows = [(i, t["scenario"], t["logs"], t["config_json"], t["metrics_json"], t["root_cause"],
             t["fix_plan"]) for i, t in enumerate(INCIDENT_TEMPLATES)]
    return spark.createDataFrame(rows, TEMPLATE_SCHEMA)


def template_index(key: Column, seed: int, k: int) -> Column:
    """Uniform template draw: ``pmod(int(md5(seed:key)[:8], 16), k)``."""
    return F.pmod(hex_prefix_int(md5_key(seed, key)), F.lit(k)).cast("int")


def synthesize_incidents(driver: DataFrame, key_col: str, seed: int = 42,
                         templates: DataFrame | None = None,
                         answer_field: str = "expected_answer") -> DataFrame:
    """P3 + P4: one incident record per driver row, template drawn by hash.

    The built-in template table has a fixed, small number of rows, so it is
    broadcast.  Templates of the caller are numbered 0..k-1 in the order of
    their ``template_idx``, so gaps in it lose no rows; null and repeated
    numbers are refused.
    """
    spark = driver.sparkSession
    if templates is None:
        tpl, k = incident_templates(spark), len(INCIDENT_TEMPLATES)
    else:
        count_unique_ids(templates, "template_idx")
        tpl, k = with_index(templates, ["template_idx"], "_dense")
        tpl = tpl.withColumn("template_idx", F.col("_dense").cast("int")).drop("_dense")
    drawn = driver.select(F.col(key_col), template_index(F.col(key_col), seed, k).alias("template_idx"))
    # a table of the caller is broadcast only when small
    joined = drawn.join(F.broadcast(tpl) if k <= 10_000 else tpl, "template_idx")
    return joined.select(
        F.format_string("aiops_%04d", F.col(key_col)).alias("id"),
        F.lit("aiops").alias("domain"), F.lit("hard").alias("difficulty"),
        R.render_incident_prompt("logs", "config_json", "metrics_json").alias("prompt"),
        F.col("root_cause").alias(answer_field),
        metadata(source=F.lit("synthetic"), scenario=F.col("scenario"),
                 fix_plan=F.col("fix_plan")).alias("metadata"))


def union_corpora(*dfs: DataFrame) -> DataFrame:
    """Concatenate corpora by column name; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def collect_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Multi-turn rows -> one ordered message array per conversation.

    The output row *is* the whole conversation, so one group per
    conversation is inherent; rows are projected to (turn, role, content)
    before the shuffle and partial aggregation runs map-side.
    """
    msgs = (df.groupBy(conv_col)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"),
                                                      F.col(role_col).alias("role"),
                                                      F.col(text_col).alias("content")))).alias("_m")))
    return msgs.select(conv_col, F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                                     m["content"].alias("content")))
                       .alias("messages"))


def render_chats_plain(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text", add_generation_prompt: bool = True,
                       turns_per_chunk: int = 1024) -> DataFrame:
    """P6 + P7 without gathering a conversation's rows in one step.

    Each turn is rendered to its line in the map phase; lines are joined per
    (conversation, chunk of ``turns_per_chunk`` turns) first, then the chunk
    strings per conversation.  A conversation with a third of all rows is
    sorted and joined by many tasks; the last step only orders its chunks.
    Unknown roles are dropped, as in P7.
    """
    line = F.concat(_plain_prefix(role_col), F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"))
    lines = df.select(conv_col, F.col(turn_col).alias("_t"), line.alias("_line"))
    chunked = (lines.groupBy(conv_col, F.floor(F.col("_t") / turns_per_chunk).alias("_c"))
               .agg(F.count(F.lit(1)).alias("_n"),
                    F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_t", "_line"))),
                                             lambda x: F.coalesce(x["_line"], F.lit(""))), "").alias("_s")))
    whole = (chunked.groupBy(conv_col)
             .agg(F.sum("_n").alias("n_messages"),
                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_c", "_s"))),
                                           lambda x: x["_s"]), "").alias("rendered")))
    tail = F.lit(R.PLAIN_GENERATION_PROMPT if add_generation_prompt else "")
    return whole.withColumn("rendered", F.concat(F.col("rendered"), tail))


def chat_segments(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", turns_per_segment: int = 1024) -> DataFrame:
    """P6 + P7 in bounded rows: ``conv, segment, first_turn, n_messages, messages, rendered``.

    A conversation becomes rows of ``turns_per_segment`` turns, in the order of
    ``segment``; joining their ``messages`` gives the conversation's message
    array, joining their ``rendered`` its plain text without the generation
    prompt.  Segments are cut at positions (turns numbered by W1 over the keys),
    not at turn numbers, so none is larger, however the turns are numbered, and
    no row, group or task holds a whole conversation.  Turns of one number are
    ordered by their content.  Unknown roles have a message and no text (P7)."""
    indexed, _ = with_index(df.select(conv_col, turn_col, role_col, text_col), [conv_col, turn_col], "_at")
    starts = indexed.groupBy(conv_col).agg(F.min("_at").alias("_start")).withColumnRenamed(conv_col, "_conv")
    placed = indexed.join(starts, F.col(conv_col).eqNullSafe(F.col("_conv"))).withColumn("_place", F.col("_at") - F.col("_start"))
    line = F.when(F.col(role_col).isin(*R.PLAIN_ROLE_PREFIX), F.concat(_plain_prefix(role_col), F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")))
    turn = F.struct(F.col("_place"), F.col(role_col).alias("role"), F.col(text_col).alias("content"), line.alias("line"))
    rows = placed.select(conv_col, turn_col, F.floor(F.col("_place") / turns_per_segment).alias("segment"), turn.alias("_turn"))
    grouped = rows.groupBy(conv_col, "segment").agg(F.min(turn_col).alias("first_turn"), F.sort_array(F.collect_list("_turn")).alias("_t"))
    return grouped.select(
        conv_col, "segment", "first_turn", F.size("_t").cast("long").alias("n_messages"),
        F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
        F.array_join(F.transform("_t", lambda t: F.coalesce(t["line"], F.lit(""))), "").alias("rendered"))


def _plain_prefix(role_col: str) -> Column:
    return (F.when(F.col(role_col) == "user", F.lit(R.PLAIN_ROLE_PREFIX["user"]))
            .when(F.col(role_col) == "assistant", F.lit(R.PLAIN_ROLE_PREFIX["assistant"]))
            .when(F.col(role_col) == "system", F.lit(R.PLAIN_ROLE_PREFIX["system"])))


def attach_response(items: DataFrame, responses: DataFrame, id_col: str = "id",
                    response_col: str = "response", answer_field: str = "expected_answer") -> DataFrame:
    """P13 + J1: pair by id (never by position); the response becomes
    ``teacher_response`` and overwrites the expected answer.  A missing
    response, or an item without an id, keeps the row with ``response_status =
    'missing'``.

    An id answered more than once is an error: which of the answers is meant
    cannot be told.  It is raised by the join itself (a count per id, combined
    map-side), without a pass of its own."""
    r = responses.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(F.col(response_col).alias("r"))).alias("_r"))
    message = F.concat(F.lit(f"column {id_col}: more than one response for "), F.col(id_col).cast("string"))
    once = F.when(F.col("_n") > 1, F.raise_error(message).cast(responses.schema[response_col].dataType)).otherwise(F.col("_r.r"))
    joined = items.join(r.select(id_col, once.alias("_resp")), id_col, "left")
    out = (joined.withColumn("teacher_response", F.col("_resp"))
           .withColumn(answer_field, F.coalesce(F.col("_resp"), F.col(answer_field)))
           .withColumn("response_status", F.when(F.col("_resp").isNull(), "missing").otherwise("ok")))
    return out.drop("_resp")


def comparison_columns(df: DataFrame, model: str, response_col: str = "response",
                       time_col: str = "time_per_row", id_col: str = "id") -> list[Column]:
    """P14 fields as expressions: fixed fields plus ``<model>_response`` and
    ``<model>_time``; absent fields take the reference's defaults
    (``unknown`` / ``""``)."""
    cols = set(df.columns)

    def c(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    return [F.col(id_col), F.coalesce(c("domain"), F.lit("unknown")).alias("domain"),
            F.coalesce(c("difficulty"), F.lit("unknown")).alias("difficulty"), c("prompt").alias("prompt"),
            F.col(response_col).alias(f"{model}_response"), F.col(time_col).alias(f"{model}_time"),
            F.coalesce(c("original_answer"), F.lit("")).alias("expected_answer"),
            F.coalesce(c("teacher_response"), F.lit("")).alias("teacher_response")]


def comparison_record(df: DataFrame, model: str, response_col: str = "response",
                      time_col: str = "time_per_row", id_col: str = "id") -> DataFrame:
    """One comparison record per row for one model."""
    return df.select(*comparison_columns(df, model, response_col, time_col, id_col))


def side_by_side(left: DataFrame, right: DataFrame, prefix: str = "kd_", id_col: str = "id") -> DataFrame:
    """Left fields plus only the ``prefix*`` fields of the right, by id."""
    keep = [c for c in right.columns if c.startswith(prefix)]
    return left.join(right.select(id_col, *keep), id_col, "inner")


def not_done(items: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop items whose id is already done.  Null ids are rejected up
    front (the reference maps them to '' and so drops every id-less item)."""
    return items.join(done.select(id_col).filter(F.col(id_col).isNotNull()).distinct(),
                      id_col, "left_anti")


def normalize_eval_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S4 + F4: two input shapes -> ``(instruction, input, expected_answer)``.

    ``prompt`` present: instruction = prompt, input = '', expected answer =
    teacher_response, else original_answer, else ''.  Else ``instruction``
    present: passed through.  Else rejected (second output).
    """
    cols = set(df.columns)

    def c(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    has_prompt = c("prompt").isNotNull()
    has_instr = c("instruction").isNotNull()
    shaped = df.withColumn("_shape", F.when(has_prompt, "prompt").when(has_instr, "instruction")
                           .otherwise("rejected"))
    accepted = shaped.filter(F.col("_shape") != "rejected").select(
        *[x for x in ["_shape"]],
        F.when(has_prompt, c("prompt")).otherwise(c("instruction")).alias("instruction"),
        F.when(has_prompt, F.lit("")).otherwise(c("input")).alias("input"),
        F.when(has_prompt, F.coalesce(c("teacher_response"), c("original_answer"), F.lit("")))
        .otherwise(c("expected_answer")).alias("expected_answer"),
        *[F.col(k) for k in df.columns if k not in {"prompt", "instruction", "input",
                                                    "teacher_response", "original_answer",
                                                    "expected_answer"}],
    ).withColumnRenamed("_shape", "shape")
    rejected = shaped.filter(F.col("_shape") == "rejected").drop("_shape")
    return accepted, rejected
