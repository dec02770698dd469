"""Registered queries that run the log readers and the miners over the driver's tables, and their SQL.

Events are written as session logs: a user is a session file, each event one JSON record.
Errors are failed results of the call before them; other events are calls of a tool.
Conversations are written as prompts, documents as plans, skills and rules.  The texts
stay columns: readers take (file, segments, text) or parsed lines, wherever these are from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scrub as sc
from tracewright.functions import text as tx
from tracewright.functions.session import cut
from tracewright.functions.times import epoch_ms
from tracewright.operators import miners, quality
from tracewright.plans import mine
from tracewright.plans.queries import CLOSED_SQL, GRAMS_SQL, SLUG_SQL, query, rules_sql
from tracewright.sources import inventory, logs
from tracewright.sources.tables import table

TOOLS = {"view": "Read", "signup": "Grep", "click": "Edit", "purchase": "Bash"}
KNOWN = ["edit", "read", "pytest", "app", "cmd1"]


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, ts, record): events as JSON records of a session log."""
    e = table(spark, sf_dir, "events")
    tool = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])[F.col("event_type")]
    before = F.expr("lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    place = F.col("value").cast("long") % 3
    path = F.format_string("/HOME/U%d/app/src/f%d.py", F.col("user_id") % 10, F.col("value").cast("long") % 40)
    command = F.when(place == 0, F.format_string("pytest tests/t%d -q", "event_id")).when(place == 1, F.format_string("curl 'http://x.example/%d'", "event_id")).otherwise(F.format_string("cat /var/log/%d.log", "event_id"))
    failed = F.col("event_type") == "error"
    block = F.struct(
        F.when(failed, "tool_result").otherwise("tool_use").alias("type"),
        F.when(~failed, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("id"),
        tool.alias("name"),
        F.when(~failed, F.struct(F.when(F.col("event_type") == "click", path).alias("file_path"), F.when(F.col("event_type") == "purchase", command).alias("command"))).alias("input"),
        F.when(failed, F.concat(F.lit("e"), before.cast("string"))).alias("tool_use_id"),
        F.when(failed, F.lit(True)).alias("is_error"),
    )
    common = [
        F.when(failed, "user").otherwise("assistant").alias("type"),
        F.when(F.col("event_id") % 3 != 0, F.format_string("/home/u%d/app", F.col("user_id") % 10)).alias("cwd"),
        F.when(F.col("event_id") % 5 == 0, F.format_string("b%d", F.col("event_id") % 4)).alias("gitBranch"),
        F.when(F.col("user_id") % 2 == 0, F.format_string("u%d", "user_id")).alias("sessionId"),
    ]
    message = F.struct(F.array(block).alias("content")).alias("message")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    as_number = F.to_json(F.struct(*common, ms.alias("timestamp"), message))
    as_text = F.to_json(F.struct(*common, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), message))
    return e.select("user_id", "event_id", "ts", F.when(F.col("event_id") % 2 == 0, as_number).otherwise(as_text).alias("record"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session file a user, as the transcript scan would give it; a session is bounded, as its file is."""
    rows = event_records(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "record"))).alias("r"))
    file = F.format_string("/logs/projects/proj%d/s%d.jsonl", F.col("user_id") % 7, "user_id")
    rows = rows.select(file.alias("file"), F.array_join(F.transform("r", lambda x: x["record"]), "\n").alias("text"))
    return logs.with_project(rows.select("file", F.split("file", "/").alias("segments"), F.lit(0).cast("long").alias("mtime_ms"), F.length("text").cast("long").alias("size"), "text"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.session_records(event_files(spark, sf_dir))


LOGS = """e AS (
  SELECT *, '/logs/projects/proj' || (user_id % 7) || '/s' || user_id || '.jsonl' AS file, row_number() OVER w AS ln,
    CASE event_type WHEN 'view' THEN 'Read' WHEN 'signup' THEN 'Grep' WHEN 'click' THEN 'Edit' WHEN 'purchase' THEN 'Bash' END AS tool,
    CASE WHEN event_id % 3 <> 0 THEN '/home/u' || (user_id % 10) || '/app' END AS cwd, CASE WHEN event_id % 5 = 0 THEN 'b' || (event_id % 4) END AS branch
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
seen AS (
  SELECT *, lag(tool) OVER w AS tool_before, lag(event_id) OVER w AS before, first_value(cwd IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cwd_by_then,
    lag(event_type) OVER w = 'error' AND event_type <> 'error' AS fixes
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ln)),
heads AS (
  SELECT file, any_value(user_id) AS user_id, CASE WHEN any_value(user_id) % 2 = 0 THEN 'u' ELSE 's' END || any_value(user_id) AS sid, arg_min(cwd, ln) FILTER (cwd IS NOT NULL) AS cwd,
    arg_min(branch, ln) FILTER (branch IS NOT NULL) AS git_branch, min((epoch_us(ts) // 1000)) AS first_ts, max((epoch_us(ts) // 1000)) AS last_ts,
    CASE WHEN count(cwd) > 0 THEN 'u' || (any_value(user_id) % 10) || '/app' ELSE 'proj' || (any_value(user_id) % 7) END AS project FROM e GROUP BY file),
errs AS (SELECT *, coalesce(tool_before, '?') AS item FROM seen WHERE event_type = 'error'),
edits AS (SELECT *, CASE WHEN cwd_by_then IS NOT NULL THEN 'src/' ELSE '' END || 'f' || (CAST(floor(value) AS BIGINT) % 40) || '.py' AS path FROM seen WHERE tool = 'Edit'),
commands AS (SELECT *, CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'pytest tests<PATH> -q' WHEN 1 THEN 'curl <STR>' ELSE 'cat <PATH>' END AS template FROM seen WHERE tool = 'Bash'),
fixes AS (SELECT s.*, coalesce(lag_err.item, '?') AS err, s.tool AS fix FROM seen s JOIN errs lag_err ON s.before = lag_err.event_id WHERE s.fixes)
"""


@query(f"WITH {LOGS} SELECT file AS session, ln, CASE WHEN event_type = 'error' THEN 'user' ELSE 'assistant' END AS type, (epoch_us(ts) // 1000) AS ts, cwd_by_then FROM seen")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all session files, with the folder known by then."""
    return records(spark, sf_dir).select("session", F.col("ln").cast("long").alias("ln"), "type", "ts", "cwd_by_then")


@query(f"WITH {LOGS} SELECT file AS session, sid AS session_id, cwd, git_branch, first_ts, last_ts, project FROM heads")
def log_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each session."""
    return logs.session_heads(records(spark, sf_dir)).select("session", "session_id", "cwd", "git_branch", "first_ts", "last_ts", "project")


@query(f"WITH {LOGS} SELECT file AS session, ln, tool AS item, row_number() OVER (PARTITION BY file ORDER BY ln) AS ord FROM seen WHERE tool IS NOT NULL")
def log_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of sessions, numbered."""
    found = logs.calls(logs.session_events(records(spark, sf_dir)))
    return found.select("session", F.col("ln").cast("long").alias("ln"), "item", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {LOGS} SELECT file AS session, ln, item FROM errs")
def log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed results, with the tool that was asked."""
    return logs.session_events(records(spark, sf_dir)).where("kind = 'err'").select("session", F.col("ln").cast("long").alias("ln"), "item")


@query(f"WITH {LOGS} SELECT file AS session, ln, path FROM edits")
def log_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited paths below the folder known by then."""
    return logs.edits(logs.session_events(records(spark, sf_dir))).select("session", F.col("ln").cast("long").alias("ln"), "path")


@query(f"WITH {LOGS} SELECT file AS session, ln, template FROM commands")
def log_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command templates."""
    return logs.commands(logs.session_events(records(spark, sf_dir))).select("session", F.col("ln").cast("long").alias("ln"), "template")


@query(f"WITH {LOGS} SELECT file AS session, ln, err, fix FROM fixes")
def log_error_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tools and the calls that followed."""
    return logs.error_fixes(logs.session_events(records(spark, sf_dir))).select("session", F.col("ln").cast("long").alias("ln"), "err", "fix")


@query(f"WITH {LOGS} SELECT DISTINCT cwd AS project FROM heads WHERE cwd IS NOT NULL ORDER BY cwd LIMIT 200")
def log_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 project folders."""
    return mine.project_list(logs.session_heads(records(spark, sf_dir))).select(F.col("cwd").alias("project"))


def shown(found: DataFrame) -> DataFrame:
    proofs = F.array_join(F.transform("proof_paths", lambda p: F.concat_ws(":", p["file"], p["line"].cast("string"), p["session"], p["detail"])), ";")
    return found.select("kind", F.array_join("signature", "|").alias("signature"), "title", "summary", "evidence", "frequency", "steps_saved", "already_automated", F.array_join("projects", ",").alias("projects"), proofs.alias("proofs"))


def overlap_sql(tokens: str) -> str:
    """Share of the distinct tokens of three characters or more that are known."""
    known = ", ".join(f"'{k}'" for k in KNOWN)
    long = f"list_distinct([x FOR x IN {tokens} IF length(x) > 2])"
    return f"CASE WHEN len({long}) = 0 THEN CAST(0 AS DOUBLE) ELSE round(len(list_intersect({long}, [{known}])) / len({long}), 3) END"


def miner_sql(rows: str, kind: str, signature: str, title: str, summary: str, evidence: str, frequency: str, steps: str, tokens: str, having: str = "true", before: str = "") -> str:
    """rows: k (group), detail, file, ln, m (a measure)."""
    return f"""WITH {LOGS}{before}, r AS ({rows}),
g AS (SELECT k, count(DISTINCT r.file) AS sessions, count(*) AS n, max(m) AS m, list_sort(list(DISTINCT project)) AS ps FROM r JOIN heads USING (file) GROUP BY k HAVING {having}),
p AS (SELECT k, string_agg(file || ':' || ln || ':' || sid || ':' || detail, ';' ORDER BY file, ln) AS proofs
  FROM (SELECT r.*, sid, row_number() OVER (PARTITION BY k ORDER BY r.file, ln) AS rank FROM r JOIN heads USING (file)) WHERE rank <= 5 GROUP BY k)
SELECT '{kind}' AS kind, {signature} AS signature, {title} AS title, {summary} AS summary, {evidence} AS evidence, CAST({frequency} AS BIGINT) AS frequency, CAST({steps} AS BIGINT) AS steps_saved,
  {overlap_sql(tokens)} AS already_automated, array_to_string(ps[1:8], ',') AS projects, proofs FROM g JOIN p USING (k)"""


SLUG_TOKENS = "string_split(" + SLUG_SQL.format(c="k") + ", '-')"
LOG_GRAMS = GRAMS_SQL.format(calls="SELECT file AS session, tool AS item, ln AS o1, 0 AS o2 FROM seen WHERE tool IS NOT NULL").strip().removeprefix("WITH ")
MINERS_SQL = {
    "sequences": miner_sql(
        "SELECT array_to_string(gram, ' -> ') AS k, array_to_string(gram, ' -> ') AS detail, session AS file, o1 AS ln, len(gram) AS m FROM grams WHERE gram IN (SELECT gram FROM kept)",
        "tool-sequence", "replace(k, ' -> ', '|')", "k", "'Tool sequence ''' || k || ''' repeated across ' || sessions || ' sessions (' || n || ' occurrences).'",
        "'{\"occurrences\":' || n || ',\"sessions\":' || sessions || '}'", "sessions", "m", "string_split(lower(k), ' -> ')", before=", " + LOG_GRAMS + CLOSED_SQL),
    "loops": miner_sql(
        "SELECT tool AS k, tool || ' x' || count(*) || ' in a row' AS detail, file, min(ln) AS ln, count(*) AS m FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ln) - row_number() OVER (PARTITION BY file, tool ORDER BY ln) AS island FROM seen WHERE tool IS NOT NULL) GROUP BY file, tool, island HAVING count(*) >= 3",
        "repeated-call-loop", "k || '|loop'", "'Repeated ' || k || ' loop (up to ' || m || ' in a row)'", "k || ' was called 3+ times consecutively in ' || sessions || ' session(s) (max run ' || m || ') -- a manual loop worth encapsulating.'",
        "'{\"max_run\":' || m || ',\"sessions\":' || sessions || '}'", "sessions", "least(m, 8)", "[lower(k)]"),
    "hotspots": miner_sql(
        "SELECT path AS k, 'edit ' || path AS detail, file, ln, 0 AS m FROM edits", "edit-hotspot", "'edit|' || k", "'Edit hotspot: ' || k",
        "k || ' was edited ' || n || ' times across ' || sessions || ' session(s) in ' || len(ps) || ' project(s).'", "'{\"edit_count\":' || n || ',\"sessions\":' || sessions || '}'", "sessions", "least(n, 8)", SLUG_TOKENS, "count(*) >= 4"),
    "commands": miner_sql(
        "SELECT template AS k, template AS detail, file, ln, 0 AS m FROM commands", "bash-template", "'bash|' || k", "'Recurring command: ' || k",
        "'''' || k || ''' ran ' || n || ' times across ' || sessions || ' session(s)' || CASE WHEN k LIKE '%test%' THEN ' and looks like a guardrail check.' ELSE '.' END",
        "'{\"run_count\":' || n || ',\"sessions\":' || sessions || ',\"guardish\":' || (k LIKE '%test%') || '}'", "sessions", "2", SLUG_TOKENS, "count(*) >= 4"),
    "error_fixes": miner_sql(
        "SELECT err || '|' || fix AS k, err || ' error -> ' || fix AS detail, file, ln, 0 AS m FROM fixes", "error-fix", "'errfix|' || k", "'Error->fix: ' || split_part(k, '|', 1) || ' fails, then ' || split_part(k, '|', 2)",
        "'A ' || split_part(k, '|', 1) || ' error was followed by ' || split_part(k, '|', 2) || ' ' || n || ' times across ' || sessions || ' session(s) -- a recurring mistake worth guarding.'",
        "'{\"pair_count\":' || n || ',\"sessions\":' || sessions || '}'", "sessions", "3", "string_split(lower(k), '|')", "count(*) >= 3"),
}


def _mined(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Rows of the miners named; records are parsed once."""
    found = cut(records(spark, sf_dir).withColumn("content", F.to_json("content"))).withColumn("content", F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>"))
    heads, events = logs.session_heads(found), logs.session_events(found)
    known = F.lit(KNOWN)
    made = {
        "sequences": lambda: miners.sequences(logs.calls(events), heads, known),
        "loops": lambda: miners.loops(logs.calls(events), heads, known),
        "hotspots": lambda: miners.hotspots(logs.edits(events), heads, known),
        "commands": lambda: miners.commands(logs.commands(events), heads, known),
        "error_fixes": lambda: miners.error_fixes(logs.error_fixes(events), heads, known),
    }
    return [made[n]() for n in names]


@query(MINERS_SQL["sequences"])
def mine_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed tool sequences of the session logs."""
    return shown(_mined(spark, sf_dir, "sequences")[0])


@query(MINERS_SQL["loops"])
def mine_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated calls."""
    return shown(_mined(spark, sf_dir, "loops")[0])


@query(MINERS_SQL["hotspots"])
def mine_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, M6: files edited often."""
    return shown(_mined(spark, sf_dir, "hotspots")[0])


@query(MINERS_SQL["commands"])
def mine_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring commands."""
    return shown(_mined(spark, sf_dir, "commands")[0])


@query(MINERS_SQL["error_fixes"])
def mine_error_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and what followed."""
    return shown(_mined(spark, sf_dir, "error_fixes")[0])


LOOKING = "['Glob', 'Grep', 'Read', 'LS', 'NotebookRead', 'WebFetch', 'WebSearch']"


@query(
    "WITH m AS (" + " UNION ALL ".join(f"SELECT * FROM ({MINERS_SQL[k]})" for k in MINERS_SQL) + f"""),
t AS (SELECT *, CASE WHEN kind = 'tool-sequence' THEN string_split(signature, '|') WHEN kind = 'repeated-call-loop' THEN [split_part(signature, '|', 1)] ELSE [] END AS items, kind = 'bash-template' AND signature LIKE '%test%' AS guard FROM m),
w AS (SELECT *, CAST(CASE WHEN guard THEN 0.8 WHEN kind = 'tool-sequence' THEN 0.7 WHEN kind = 'repeated-call-loop' THEN 0.85 WHEN kind = 'edit-hotspot' THEN 0.6 WHEN kind = 'bash-template' THEN 0.55 ELSE 0.5 END AS DOUBLE)
  * CASE WHEN len(items) > 0 AND len([x FOR x IN items IF NOT list_contains({LOOKING}, x)]) = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight FROM t)
SELECT kind, signature, round(weight, 3) AS automatability, CAST(round(CAST(CAST(frequency * steps_saved * weight * (1 - already_automated) AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS score, guard OR kind = 'error-fix' AS warned,
  CASE WHEN guard OR kind = 'error-fix' THEN 'hookify-rule' WHEN kind = 'tool-sequence' AND len(items) >= 4 THEN 'skill-chain' ELSE 'skill' END AS primitive FROM w
""")
def mine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the session logs, scored where only managed hooks are allowed."""
    found = mine.candidates(_mined(spark, sf_dir, *MINERS_SQL), managed=True)
    return found.select("kind", F.array_join("signature", "|").alias("signature"), "automatability", "score", F.col("managed_hook_warning").alias("warned"), F.col("recommended_primitive").alias("primitive"))


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of a prompt log; every fifth conversation holds commands."""
    t = table(spark, sf_dir, "conversations")
    display = F.when(F.col("conv_id") % 5 == 0, F.format_string("/cmd%d  now %s ", F.col("conv_id") % 3, "role")).when(F.col("turn") == 3, " ").otherwise(F.format_string("fix item %d of 'x %d' at https://a.b/%d\tplease", "turn", "conv_id", "conv_id"))
    line = F.struct(display.alias("display"), F.when(F.col("turn") != 1, F.col("conv_id") * 1000).alias("timestamp"), F.format_string("/w/p%d/", F.col("conv_id") % 6).alias("project"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ln"), F.try_parse_json(F.to_json(line)).alias("v"))


PROMPTS = """h AS (SELECT conv_id * 1000 + turn AS ord, conv_id, turn, CASE WHEN turn <> 1 THEN conv_id * 1000 END AS ts, conv_id % 5 = 0 AS is_slash, 'w/p' || (conv_id % 6) AS project,
  CASE WHEN conv_id % 5 = 0 THEN '/cmd' || (conv_id % 3) || '  now ' || role ELSE 'fix item ' || turn || ' of ''x ' || conv_id || ''' at https://a.b/' || conv_id || chr(9) || 'please' END AS display,
  CASE WHEN conv_id % 5 = 0 THEN '<path> now ' || role ELSE 'fix item <n> of <str> at <url> please' END AS norm
  FROM conversations WHERE (conv_id % 5 = 0 OR turn <> 3) AND (turn = 1 OR conv_id >= 3))"""


@query(f"WITH {PROMPTS} SELECT ord, ts, project, is_slash, CASE WHEN is_slash THEN split_part(display, ' ', 1) ELSE '' END AS slash, norm, substr(display, 1, 200) AS sample FROM h")
def log_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from a cutoff on; those without a time stay, blank ones go."""
    kept, _ = logs.prompt_rows(prompt_lines(spark, sf_dir), since_ms=3000)
    return kept.select("ord", "ts", F.col("project_slug").alias("project"), "is_slash", "slash", "norm", "sample")


@query(f"""WITH {PROMPTS},
g AS (SELECT norm, count(*) AS n, list_sort(list(DISTINCT project)) AS ps, arg_min(display, ord) AS sample, arg_min(is_slash, ord) AS is_slash FROM h GROUP BY norm HAVING count(*) >= 3)
SELECT 'prompt-cluster' AS kind, 'prompt|' || substr(norm, 1, 60) AS signature, CASE WHEN is_slash THEN 'Recurring slash command: ' || split_part(sample, ' ', 1) ELSE 'Recurring request: ' || substr(sample, 1, 60) END AS title,
  n || ' similar prompts across ' || len(ps) || ' project(s): "' || substr(sample, 1, 80) || '"' AS summary, '{{"prompt_count":' || n || ',"is_slash":' || is_slash || '}}' AS evidence,
  n AS frequency, CAST(2 AS BIGINT) AS steps_saved, CASE WHEN is_slash THEN CAST(1 AS DOUBLE) ELSE {overlap_sql("string_split(norm, ' ')")} END AS already_automated,
  array_to_string(ps[1:8], ',') AS projects, 'history.jsonl::' || substr(sample, 1, 100) AS proofs FROM g""")
def mine_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt clusters."""
    kept, _ = logs.prompt_rows(prompt_lines(spark, sf_dir), since_ms=3000)
    return shown(miners.prompt_clusters(kept, F.lit(KNOWN)))


def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plans: a title, a heading, two steps, and the whole text."""
    d = table(spark, sf_dir, "documents")
    head = F.format_string("# Move %s %d  now\n\n## Why %s\n1. first\n2. then\n", F.coalesce("source", F.lit("-")), F.col("doc_id") % 50, F.coalesce("lang", F.lit("-")))
    file = F.format_string("/plans/p%012d.md", "doc_id")
    return d.select(file.alias("file"), F.split(file, "/").alias("segments"), F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


PLANS = """pl AS (SELECT doc_id, printf('/plans/p%012d.md', doc_id) AS file, 'move ' || lower(coalesce(source, '-')) || ' <n> now' AS norm, 'Why ' || coalesce(lang, '-') AS heading,
  string_split_regex('## Why ' || coalesce(lang, '-') || chr(10) || '1. first' || chr(10) || '2. then' || chr(10) || coalesce(text, ''), '\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents),
st AS (SELECT *, len([x FOR x IN ls IF regexp_matches(x, '(?i)^\\s*(?:[0-9]+[.)]|[-*]\\s|#{2,4}\\s*(?:step|phase|stage))')]) AS n_steps, [x FOR x IN ls IF regexp_matches(x, '^#{2,3}\\s+.')] AS hs FROM pl)"""


@query(f"WITH {PLANS} SELECT file, norm, n_steps, CAST(least(30, len(hs)) AS BIGINT) AS n_headings FROM st")
def log_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan documents."""
    return logs.parse_plans(plan_files(spark, sf_dir)).select("file", "norm", F.col("n_steps").cast("long").alias("n_steps"), F.size("headings").cast("long").alias("n_headings"))


@query(f"""WITH {PLANS}, g AS (SELECT norm, count(*) AS n, CAST(round_even(avg(n_steps), 0) AS BIGINT) AS steps FROM st GROUP BY norm HAVING count(*) >= 2)
SELECT 'plan|' || substr(norm, 1, 50) AS signature, 'Recurring plan type: ' || substr(norm, 1, 60) AS title, '{{"plan_count":' || n || ',"avg_steps":' || steps || '}}' AS evidence, n AS frequency, greatest(2, least(steps, 12)) AS steps_saved,
  {overlap_sql("string_split(norm, ' ')")} AS already_automated FROM g""")
def mine_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan types."""
    found = miners.plan_clusters(logs.parse_plans(plan_files(spark, sf_dir)), F.lit(KNOWN))
    return shown(found).select("signature", "title", "evidence", "frequency", "steps_saved", "already_automated")


def skill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as skills; the number of a document decides what is wrong with its frontmatter."""
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, "").when(i % 5 == 1, "name: bad_name\n").otherwise(F.format_string("name: 'skill-%d'\n", "doc_id"))
    desc = F.when(i % 7 == 0, "").when(i % 7 == 1, F.lit("description: We run it -> then stop\n")).when(i % 7 == 2, F.concat(F.lit("description: Use when "), F.repeat(F.lit("x"), 520), F.lit("\n"))).otherwise(F.lit("# note\ndescription: [Use when a, 'b']\n"))
    long = F.when(i % 11 == 0, F.concat(F.lit("more: "), F.repeat(F.lit("y"), 1100), F.lit("\n"))).otherwise("")
    head = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("---\n"), name, desc, long, F.lit("---\n"), F.when(i % 3 == 0, "# Title\n").otherwise("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


SKILLS = """k AS (SELECT doc_id AS i, coalesce(text, '') AS body, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'We run it -> then stop' WHEN 2 THEN 'Use when ' || repeat('x', 520) ELSE 'Use when a, b' END AS d FROM documents),
b AS (SELECT *, length('name: ') + CASE i % 5 WHEN 0 THEN -7 WHEN 1 THEN 8 ELSE length(CAST(i AS VARCHAR)) + 8 END + 1 + CASE i % 7 WHEN 0 THEN 0 WHEN 1 THEN 36 WHEN 2 THEN 543 ELSE 38 END + CASE WHEN i % 11 = 0 THEN 1107 ELSE 0 END - 1 AS block FROM k)"""


@query(f"""WITH {SKILLS}, f AS (SELECT i, CASE WHEN i % 13 = 0 THEN CASE WHEN starts_with(body, '---') THEN [NULL] ELSE ['error:no frontmatter'] END ELSE [
  CASE WHEN block > 1024 THEN 'error:frontmatter has ' || block || ' characters (at most 1024)' END, CASE WHEN i % 5 = 0 THEN 'error:no name' END, CASE WHEN i % 5 = 1 THEN 'error:name may have letters, digits and hyphens only' END,
  CASE WHEN i % 7 = 0 THEN 'error:no description' END, CASE WHEN i % 7 = 1 THEN 'warn:description should start with ''Use when''' END, CASE WHEN i % 7 = 2 THEN 'warn:description is longer than 500 characters' END,
  CASE WHEN i % 7 = 1 THEN 'warn:description should be in the third person' END, CASE WHEN i % 7 = 1 THEN 'warn:description tells the process, not when to use it' END,
  CASE WHEN i % 3 <> 0 AND NOT regexp_matches(body, '(?m)^#\\s+\\S') THEN 'warn:no first-level heading' END] END AS fs FROM b)
SELECT i AS doc_id, array_to_string([x FOR x IN fs IF x IS NOT NULL], ';') AS findings, len([x FOR x IN fs IF starts_with(x, 'error')]) > 0 AS failed FROM f""")
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of skill documents."""
    rows = quality.skill_findings(skill_texts(spark, sf_dir))
    text = F.array_join(F.transform("findings", lambda f: F.concat(f["level"], F.lit(":"), f["msg"])), ";")
    return rows.select("doc_id", text.alias("findings"), quality.has_error(F.col("findings")).alias("failed"))


@query("""SELECT page_id, array_to_string([x FOR x IN [CASE WHEN page_id % 4 = 0 THEN 'error:no name' END, CASE WHEN page_id % 3 = 0 THEN 'error:enabled must be true or false' END, CASE WHEN page_id % 5 = 0 THEN 'error:unknown event' END,
  CASE WHEN page_id % 6 = 0 AND NOT contains(html, 'conditions:') THEN 'error:neither pattern nor conditions' END, CASE WHEN trim(html, ' ') = '' THEN 'warn:no message' END, CASE WHEN page_id % 7 = 0 THEN 'warn:action should be warn or block' END] IF x IS NOT NULL], ';') AS findings FROM pages""")
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of rule documents, with pages as their messages."""
    i = F.col("page_id")
    line = lambda k, ok, bad, wrong: F.when(wrong, F.lit(f"{k}: {bad}\n" if bad else "")).otherwise(F.lit(f"{k}: {ok}\n"))
    head = F.concat(F.lit("---\n"), line("name", "r", "", i % 4 == 0), line("enabled", "True", "yes", i % 3 == 0), line("event", "bash", "never", i % 5 == 0), line("pattern", '"rm -rf"', "", i % 6 == 0), line("action", "block", "stop", i % 7 == 0), F.lit("---\n"))
    rows = quality.rule_findings(table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.coalesce("html", F.lit(""))).alias("text")))
    return rows.select("page_id", F.array_join(F.transform("findings", lambda f: F.concat(f["level"], F.lit(":"), f["msg"])), ";").alias("findings"))


def _scrub_expr(c: str) -> str:
    for _, pattern, replacement in rules_sql():
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return c


SECRET = "'password = ' || conv_id || turn || ' by ' || role"


@query(f"SELECT conv_id, turn, {_scrub_expr(SECRET)} AS a, {_scrub_expr('role')} AS b, {_scrub_expr(SECRET)} AS c FROM conversations")
def scrub_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string inside structs, arrays and maps; map keys stay."""
    secret = F.concat(F.lit("password = "), F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(" by "), "role")
    nested = F.struct(F.array(F.struct(secret.alias("s"), F.col("turn").alias("n"))).alias("list"), F.create_map(F.lit("token: k"), secret).alias("map"))
    out = sc.scrub_all(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", nested.alias("x")))
    return out.select("conv_id", "turn", F.col("x.list")[0]["s"].alias("a"), F.col("role").alias("b"), F.col("x.map")["token: k"].alias("c"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN (epoch_us(ts) // 1000) WHEN 1 THEN (epoch_us(ts) // 1000) WHEN 2 THEN (epoch_us(ts) // 1000) WHEN 3 THEN epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) END AS ms FROM events")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as numbers, digits, ISO texts and dates; what is no time is null."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kinds = [F.to_json(F.struct(ms.alias("t"))), F.to_json(F.struct(ms.cast("string").alias("t"))), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("t"))), F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("t")))]
    made = F.lit('{"t": "soon"}')
    for i, k in enumerate(kinds):
        made = F.when(F.col("event_id") % 5 == i, k).otherwise(made)
    return table(spark, sf_dir, "events").select("event_id", epoch_ms(F.try_variant_get(F.try_parse_json(made), "$.t", "variant")).alias("ms"))


@query("SELECT doc_id, NOT starts_with(coalesce(source, ''), '/') AND coalesce(source, '') <> '' AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS safe FROM documents")
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths that stay below their base."""
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, F.concat(F.lit("/"), "source")).when(i % 5 == 0, F.concat("source", F.lit("\\..\\x"))).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", inventory.is_safe_relative(F.coalesce(path, F.lit(""))).alias("safe"))


@query(f"WITH {LOGS}, t AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(sid || ' ' || project), '[^a-z0-9]+')) AS w FROM heads) WHERE w <> '') SELECT w FROM t")
def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of what is automated already (here: sessions as skills, their projects as descriptions)."""
    heads = logs.session_heads(records(spark, sf_dir))
    return inventory.token_bag(heads.select(F.concat_ws(" ", "session_id", "project").alias("t")))

