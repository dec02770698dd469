"""Registered queries over the driver's tables, and the equivalent SQL.

Each entry applies an operator to a whole table.  Arrays are joined to texts and times
written as numbers, so that both engines give the same values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import scrub as sc
from tracewright.functions import text as tx
from tracewright.operators import incremental, quality, scoring
from tracewright.operators import sequences as sq
from tracewright.sources.tables import conversation_calls, event_calls, table

ORDER = ("ts", "event_id")
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


GRAMS_SQL = """
WITH calls AS ({calls}),
wide AS (
  SELECT session, item AS a, lead(item, 1) OVER w AS b, lead(item, 2) OVER w AS c, lead(item, 3) OVER w AS d, lead(item, 4) OVER w AS e, o1
  FROM calls WINDOW w AS (PARTITION BY session ORDER BY o1, o2)),
grams AS (
  SELECT session, [a, b] AS gram, o1 FROM wide WHERE b IS NOT NULL
  UNION ALL SELECT session, [a, b, c], o1 FROM wide WHERE c IS NOT NULL
  UNION ALL SELECT session, [a, b, c, d], o1 FROM wide WHERE d IS NOT NULL
  UNION ALL SELECT session, [a, b, c, d, e], o1 FROM wide WHERE e IS NOT NULL),
frequent AS (
  SELECT gram, count(DISTINCT session) AS sessions, count(*) AS occurrences FROM grams
  WHERE len(list_distinct(gram)) > 1 GROUP BY gram HAVING count(DISTINCT session) >= 3)
"""
EVENT_CALLS = "SELECT user_id AS session, event_type AS item, ts AS o1, event_id AS o2 FROM events"
TURN_CALLS = "SELECT conv_id AS session, role AS item, turn AS o1, 0 AS o2 FROM conversations"
CLOSED_SQL = """,
k5 AS (SELECT * FROM frequent WHERE len(gram) = 5),
s4 AS (SELECT sub AS gram, max(sessions) AS longer FROM (SELECT sessions, unnest([gram[1:4], gram[2:5]]) AS sub FROM k5) GROUP BY sub),
k4 AS (SELECT f.* FROM frequent f LEFT JOIN s4 USING (gram) WHERE len(f.gram) = 4 AND (longer IS NULL OR f.sessions > longer * 1.25)),
s3 AS (SELECT sub AS gram, max(sessions) AS longer FROM (
  SELECT sessions, unnest([gram[1:3], gram[2:4], gram[3:5]]) AS sub FROM k5
  UNION ALL SELECT sessions, unnest([gram[1:3], gram[2:4]]) FROM k4) GROUP BY sub),
k3 AS (SELECT f.* FROM frequent f LEFT JOIN s3 USING (gram) WHERE len(f.gram) = 3 AND (longer IS NULL OR f.sessions > longer * 1.25)),
s2 AS (SELECT sub AS gram, max(sessions) AS longer FROM (
  SELECT sessions, unnest([gram[1:2], gram[2:3], gram[3:4], gram[4:5]]) AS sub FROM k5
  UNION ALL SELECT sessions, unnest([gram[1:2], gram[2:3], gram[3:4]]) FROM k4
  UNION ALL SELECT sessions, unnest([gram[1:2], gram[2:3]]) FROM k3) GROUP BY sub),
k2 AS (SELECT f.* FROM frequent f LEFT JOIN s2 USING (gram) WHERE len(f.gram) = 2 AND (longer IS NULL OR f.sessions > longer * 1.25)),
kept AS (SELECT * FROM k5 UNION ALL SELECT * FROM k4 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k2)
"""
CLOSED_SHOWN = "SELECT array_to_string(gram, ' > ') AS gram, sessions, occurrences FROM kept"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("gram", " > ").alias("gram"), "sessions", "occurrences")


@query(GRAMS_SQL.format(calls=EVENT_CALLS) + "SELECT array_to_string(gram, ' > ') AS gram, sessions, occurrences, round(sessions * len(gram) * CAST(0.7 AS DOUBLE), 2) AS score FROM frequent")
def seq_ngram_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent sequences of the event table with their scores."""
    found = sq.support(sq.ngrams(event_calls(spark, sf_dir), order=ORDER))
    score = scoring.score(F.col("sessions"), F.size("gram"), F.lit(scoring.WEIGHTS["tool-sequence"]), F.lit(0.0))
    return found.select(F.array_join("gram", " > ").alias("gram"), "sessions", "occurrences", score.alias("score"))


@query(GRAMS_SQL.format(calls=EVENT_CALLS) + CLOSED_SQL + CLOSED_SHOWN)
def seq_ngram_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 on the event table."""
    return _shown(sq.closed(sq.support(sq.ngrams(event_calls(spark, sf_dir), order=ORDER))))


@query(GRAMS_SQL.format(calls=TURN_CALLS) + CLOSED_SQL + CLOSED_SHOWN)
def seq_ngram_closed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 on the roles of conversations."""
    return _shown(sq.closed(sq.support(sq.ngrams(conversation_calls(spark, sf_dir)))))


@query(f"""
WITH calls AS ({EVENT_CALLS}),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY o1, o2) - row_number() OVER (PARTITION BY session, item ORDER BY o1, o2) AS island FROM calls),
r AS (SELECT session, item, count(*) AS run FROM n GROUP BY session, item, island HAVING count(*) >= 3)
SELECT item, count(DISTINCT session) AS sessions, max(run) AS max_run, count(*) AS runs FROM r GROUP BY item
""")
def loop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type."""
    found = sq.runs(event_calls(spark, sf_dir), order=ORDER)
    return found.groupBy("item").agg(F.count_distinct("session").alias("sessions"), F.max("run").alias("max_run"), F.count("*").alias("runs"))


@query("""
WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before AS err, event_type AS fix, count(*) AS pairs, count(DISTINCT user_id) AS sessions
FROM e WHERE before = 'error' AND event_type <> 'error' GROUP BY before, event_type HAVING count(*) >= 3
""")
def error_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows an error event."""
    events = event_calls(spark, sf_dir).withColumn("kind", F.when(F.col("item") == "error", "err").otherwise("use"))
    pairs = sq.next_after_error(events, order=ORDER)
    return pairs.groupBy("err", "fix").agg(F.count("*").alias("pairs"), F.count_distinct("session").alias("sessions")).where("pairs >= 3")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events
""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the same user up to each event."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", sq.last_before(F.when(F.col("event_type") == "purchase", F.col("event_id")), "user_id", order=ORDER).alias("last_purchase"))


@query("""
SELECT event_id, first_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_click_value FROM events
""")
def running_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of a user's first click, known from then on."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", sq.first_so_far(F.when(F.col("event_type") == "click", F.col("value")), "user_id", order=ORDER).alias("first_click_value"))


@query("""
SELECT l_partkey AS part, count(*) AS edits, count(DISTINCT l_orderkey) AS sessions, count(DISTINCT c_nationkey) AS projects, least(count(*), 8) AS steps_saved
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_partkey HAVING count(*) >= 4
""")
def hotspot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered often."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    found = rows.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("edits"), F.count_distinct("l_orderkey").alias("sessions"), F.count_distinct("c_nationkey").alias("projects"))
    return found.where("edits >= 4").withColumn("steps_saved", F.least("edits", F.lit(8).cast("long")))


@query("""
WITH r AS (SELECT event_type AS item, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)
SELECT item, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) AS proofs FROM r WHERE n <= 5 GROUP BY item
""")
def top_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five events of each type."""
    first = sq.first_k(table(spark, sf_dir, "events"), ["event_type"], list(ORDER), 5)
    kept = first.groupBy(F.col("event_type").alias("item")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("p"))
    return kept.select("item", F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ",").alias("proofs"))


@query("""
SELECT o_orderpriority AS item, array_to_string(list_sort(list(DISTINCT n_name))[1:8], ',') AS projects, count(DISTINCT n_name) AS n_projects
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY o_orderpriority
""")
def projects_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight nations of each order priority."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # broadcast: the nations of the world
    names = rows.groupBy(F.col("o_orderpriority").alias("item")).agg(F.array_sort(F.collect_set("n_name")).alias("n"))
    return names.select("item", F.array_join(F.slice("n", 1, 8), ",").alias("projects"), F.size("n").cast("long").alias("n_projects"))


def template_sql(c: str) -> str:
    """Masks for ASCII texts, in RE2's syntax (no back references)."""
    out = f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
    for pattern, mask in [
        (r"https?://[^\s''\"]+", "<URL>"), (r"(?s)(?:''.*?''|\".*?\")", "<STR>"), (r"(?:[A-Za-z]:[\\/]|/)[^\s''\"]+", "<PATH>"),
        (r"\b[0-9a-fA-F]{7,40}\b", "<HASH>"), (r"\b\d+\b", "<N>"), (r"\s+", " "),
    ]:
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return f"substr(trim({out}), 1, 200)"


@query(f"SELECT {template_sql('url')} AS template, count(*) AS runs, count(DISTINCT page_id) AS sessions FROM pages GROUP BY 1")
def bash_template_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the pages' addresses."""
    rows = table(spark, sf_dir, "pages").select("page_id", tx.command_template(F.col("url")).alias("template"))
    return rows.groupBy("template").agg(F.count("*").alias("runs"), F.count_distinct("page_id").alias("sessions"))


@query()
def template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all user turns, each with its first sample; without SQL, as DuckDB's regex classes differ beyond ASCII."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    rows = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("ord"), tx.prompt_key(F.col("text")).alias("norm"), F.substring("text", 1, 200).alias("sample"))
    return rows.groupBy("norm").agg(F.count("*").alias("prompts"), F.min_by("sample", "ord").alias("sample"))


SLUG_SQL = "coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', ''), ''), 'candidate')"


@query(f"""
SELECT p_partkey, {SLUG_SQL.format(c="p_name || ' / ' || p_type")} AS slug FROM part
""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 on part names and types."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(r"""
WITH s AS (SELECT page_id, url, [x FOR x IN regexp_split_to_array(url, '[\\/]+') IF x <> ''] AS p FROM pages)
SELECT page_id,
  CASE WHEN len(p) = 0 THEN 'unknown' ELSE array_to_string(p[greatest(1, len(p) - 1):], '/') END AS project,
  CASE WHEN starts_with(lower(url), 'https://' || lower(split_part(url, '/', 3)) || '/') THEN substr(url, length('https://' || split_part(url, '/', 3)) + 2)
    ELSE regexp_extract(url, '[^/]*$') END AS relative
FROM s
""")
def path_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T6 on the pages' addresses, taken as paths below their host."""
    host = F.concat(F.lit("https://"), F.split("url", "/")[2])
    return table(spark, sf_dir, "pages").select("page_id", tx.project_slug(F.col("url")).alias("project"), tx.repo_relative(F.col("url"), host).alias("relative"))


@query("""
SELECT event_id, CASE WHEN starts_with(c, '/') THEN split_part(c, ' ', 1) ELSE '' END AS slash
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '/' ELSE '' END || event_type || ' ' || props AS c FROM events)
""")
def slash_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as prompts, of which errors are commands."""
    c = F.concat(F.when(F.col("event_type") == "error", "/").otherwise(""), "event_type", F.lit(" "), "props")
    return table(spark, sf_dir, "events").select("event_id", tx.slash_command(c).alias("slash"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id,
  count(*) FILTER (regexp_matches(line, '(?i)^\\s*(?:[0-9]+[.)]|[-*]\\s|#{2,4}\\s*(?:step|phase|stage))')) AS n_steps,
  count(*) FILTER (regexp_matches(line, '^#{2,3}\\s+')) AS n_headings,
  count(*) AS n_lines FROM l GROUP BY doc_id
""")
def plan_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line classes of every whole document."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents")
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    return rows.select("doc_id", count(tx.STEP_LINE).alias("n_steps"), count(tx.HEADING_LINE).alias("n_headings"), F.size(lines).cast("long").alias("n_lines"))


@query("""
SELECT substr(item, 1, 3) AS plan, CAST(round_even(avg(n), 0) AS BIGINT) AS steps, least(greatest(CAST(round_even(avg(n), 0) AS BIGINT), 2), 12) AS steps_saved, count(*) AS plans
FROM (SELECT o_orderpriority AS item, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority) GROUP BY 1
""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of lines of an order, rounded half to even and clamped."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    mean = F.bround(F.avg("n"), 0).cast("long")
    return rows.groupBy(F.substring("o_orderpriority", 1, 3).alias("plan")).agg(mean.alias("steps"), F.least(F.greatest(mean, F.lit(2)), F.lit(12)).cast("long").alias("steps_saved"), F.count("*").alias("plans"))


def rules_sql() -> list[tuple[str, str, str]]:
    """The rules in RE2's syntax: repeats above 1000 are not allowed there, and ASCII classes are the default."""
    out = []
    for name, pattern, replacement in sc.RULES:
        out.append((name, pattern.replace("{0,100000}?", "*?").replace("'", "''"), replacement.replace("$1", "\\1").replace("$3", "\\3")))
    return out


def scrub_sql(table_: str, key: str, c: str, by_rule: bool) -> str:
    steps, hits, at = [f"s0 AS (SELECT {key} AS id, coalesce({c}, '') AS t FROM {table_})"], [], 0
    for name, pattern, replacement in rules_sql():
        steps.append(f"s{at + 1} AS (SELECT id, regexp_replace(t, '{pattern}', '{replacement}', 'g') AS t FROM s{at})")
        hits.append(f"SELECT id, '{name}' AS rule, len(regexp_extract_all(t, '{pattern}')) AS n FROM s{at}")
        at += 1
    found = f"h AS ({' UNION ALL '.join(hits)})"
    if by_rule:
        return f"WITH {', '.join(steps)}, {found} SELECT rule, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS texts FROM h GROUP BY rule"
    return f"WITH {', '.join(steps)}, {found}, n AS (SELECT id, sum(n) AS hits FROM h GROUP BY id) SELECT s{at}.id AS {key}, md5(t) AS scrubbed_md5, CAST(hits AS BIGINT) AS hits FROM s{at} JOIN n USING (id)"


@query(scrub_sql("documents", "doc_id", "text", False))
def scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 on every whole document: digest of the scrubbed text and number of redactions."""
    rows = sc.with_scrubbed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("scrubbed").alias("scrubbed_md5"), "hits")


@query(scrub_sql("documents", "doc_id", "text", True))
def scrub_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions by rule."""
    return sc.rule_hits(table(spark, sf_dir, "documents").select("text"), "text")


@query("""
WITH bag AS (SELECT list(DISTINCT w) AS words FROM (SELECT unnest(string_split_regex(lower(p_type), '[^a-z0-9]+')) AS w FROM part) WHERE w <> ''),
t AS (SELECT p_partkey, [x FOR x IN list_distinct(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) IF length(x) > 2] AS toks FROM part)
SELECT p_partkey, CASE WHEN len(toks) > 0 THEN round(CAST(len(list_intersect(toks, words)) AS DOUBLE) / len(toks), 3) ELSE 0.0 END AS overlap FROM t, bag
""")
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a part's words that are words of part types."""
    parts = table(spark, sf_dir, "part")
    words = parts.select(F.explode(F.split(F.lower("p_type"), "[^a-z0-9]+")).alias("w")).where("w <> ''").distinct()
    rows = parts.select("p_partkey", tx.white_space_tokens(F.lower(F.concat("p_name", F.lit(" "), "p_type"))).alias("tokens"))
    return scoring.overlaps(rows, "p_partkey", "tokens", words).select("p_partkey", "overlap")


@query(f"""
WITH calls AS ({EVENT_CALLS}),
n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY o1, o2) - row_number() OVER (PARTITION BY session, item ORDER BY o1, o2) AS island FROM calls),
r AS (SELECT session, item, count(*) AS run FROM n GROUP BY session, item, island HAVING count(*) >= 3),
l AS (SELECT 'repeated-call-loop' AS kind, item || '|loop' AS signature, count(DISTINCT session) AS frequency, least(max(run), 8) AS steps, 0.85 AS weight FROM r GROUP BY item),
e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
p AS (SELECT 'error-fix' AS kind, 'errfix|' || before || '|' || event_type AS signature, count(DISTINCT user_id) AS frequency, 3 AS steps, 0.5 AS weight
  FROM e WHERE before = 'error' AND event_type <> 'error' GROUP BY before, event_type HAVING count(*) >= 3),
u AS (SELECT * FROM l UNION ALL SELECT * FROM p),
s AS (SELECT *, round(frequency * steps * CAST(weight AS DOUBLE), 2) AS score FROM u)
SELECT format('cand-{{:04d}}', row_number() OVER (ORDER BY score DESC, signature)) AS id, kind, signature, frequency, score,
  CASE WHEN kind = 'error-fix' THEN 'hook' ELSE 'skill' END AS primitive FROM s
""")
def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops and error pairs of the event table in one ranking."""
    loops = loop_runs(spark, sf_dir).select(F.lit("repeated-call-loop").alias("kind"), F.array("item", F.lit("loop")).alias("signature"), F.col("sessions").alias("frequency"), F.least("max_run", F.lit(8)).alias("steps_saved"), F.array("item").alias("items"))
    pairs = error_followups(spark, sf_dir).select(F.lit("error-fix").alias("kind"), F.array(F.lit("errfix"), "err", "fix").alias("signature"), F.col("sessions").alias("frequency"), F.lit(3).alias("steps_saved"), F.array().cast("array<string>").alias("items"))
    both = loops.unionByName(pairs).withColumn("guard", F.lit(False)).withColumn("already_automated", F.lit(0.0)).withColumn("first_seen", F.lit(0))
    out = scoring.ranked(scoring.finish(both, managed=False))
    return out.select("id", "kind", F.array_join("signature", "|").alias("signature"), "frequency", "score", F.col("recommended_primitive").alias("primitive"))


@query(f"""
SELECT page_id, regexp_matches(lower(html), '{"|".join(tx.GUARD_WORDS)}') AS guard FROM pages
""")
def guard_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 on the pages' sources."""
    return table(spark, sf_dir, "pages").select("page_id", tx.looks_like_guard(F.col("html")).alias("guard"))


@query("""
WITH s AS (SELECT user_id, list(DISTINCT CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'signup' THEN 'LS' ELSE event_type END) AS tools FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT len([x FOR x IN tools IF x NOT IN ('Read', 'Grep', 'LS')]) = 0 AS only_looks, count(*) AS n FROM s GROUP BY 1
""")
def explore_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User days of which all tools only look."""
    named = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Grep").when(F.col("event_type") == "signup", "LS").otherwise(F.col("event_type"))
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.collect_set(named).alias("tools"))
    return days.groupBy(scoring.only_looks(F.col("tools")).alias("only_looks")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') IS NOT NULL AS has_k FROM events
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value out of a JSON text, through VARIANT."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.k", "variant").isNotNull().alias("has_k"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch_ms(ts) END AS t FROM events), c AS (SELECT CAST(floor((min(epoch_ms(ts)) + max(epoch_ms(ts))) / 2) AS BIGINT) AS cutoff FROM events)
SELECT count(*) AS total, count(*) FILTER (t IS NULL OR t >= cutoff) AS kept, count(*) FILTER (t IS NULL) AS without_time FROM e, c
""")
def recency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows without a time pass the cutoff."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min(ms), F.max(ms)).first()
    cutoff = ((low or 0) + (high or 0)) // 2
    t = F.when(F.col("event_id") % 10 != 0, ms)
    return e.agg(F.count("*").alias("total"), F.count_if(t.isNull() | (t >= cutoff)).alias("kept"), F.count_if(t.isNull()).alias("without_time"))


COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS total FROM {t}" for t in COUNTED))
def source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A14."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(t).alias("source"), F.count("*").alias("total")) for t in COUNTED])


@query("SELECT text AS norm, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, norm LIMIT 8")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-8 report of whole document texts."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("text").alias("norm")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "norm").limit(8)


DIFF_SQL = """
WITH now AS (SELECT CAST(doc_id AS VARCHAR) AS file, n_chars AS size FROM documents),
state AS (SELECT CAST(l.doc_id AS VARCHAR) AS file, CASE WHEN l.quality = 1 THEN d.n_chars ELSE d.n_chars + 1 END AS size FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as a listing; labels as an older state in which low-quality rows had another size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    listing = docs.select(F.col("doc_id").cast("string").alias("file"), F.lit(0).cast("long").alias("mtime_ms"), F.col("n_chars").alias("size"))
    old = table(spark, sf_dir, "labels").join(docs, "doc_id")
    size = F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(F.col("n_chars") + 1)
    state = old.select(F.col("doc_id").cast("string").alias("file"), F.lit(incremental.STATE_VERSION).alias("version"), F.lit(0).cast("long").alias("mtime_ms"), size.alias("size"))
    return listing, state


@query(DIFF_SQL + "SELECT file, EXISTS (SELECT 1 FROM state s WHERE s.file = now.file AND s.size = now.size) AS hit FROM now")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files a stored state still covers."""
    todo, hits = incremental.split_by_state(*_state(spark, sf_dir))
    return todo.select("file", F.lit(False).alias("hit")).unionByName(hits.select("file", F.lit(True).alias("hit")))


@query("SELECT CAST(doc_id AS VARCHAR) AS file, n_chars AS size FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def prune_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a state, of which the rows stay whose file is in the listing of labels."""
    state, _ = _state(spark, sf_dir)
    listing = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("file"))
    return incremental.prune(state, listing).select("file", "size")


@query("""
SELECT conv_id AS session, CAST(count(*) AS BIGINT) AS n_calls, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text,
  CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS answers FROM conversations GROUP BY conv_id
""")
def session_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last values and counts by session."""
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session")).agg(
        F.count("*").alias("n_calls"), F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"), F.count_if(F.col("role") == "assistant").alias("answers")
    )


@query("""
WITH c AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM conversations)
SELECT conv_id, turn FROM c WHERE earlier <= 2
""")
def saturation_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns up to and with the one in which a cap of answers is passed."""
    earlier = F.coalesce(F.count_if(F.col("role") == "assistant").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "conversations").withColumn("earlier", earlier).where("earlier <= 2").select("conv_id", "turn")


@query("""
SELECT CAST(sum(CASE WHEN contains(html, 'the') THEN 1 ELSE 0 END) AS BIGINT) AS contains, CAST(sum(CASE WHEN NOT contains(html, 'the') THEN 1 ELSE 0 END) AS BIGINT) AS not_contains,
  CAST(sum(CASE WHEN starts_with(html, '<') THEN 1 ELSE 0 END) AS BIGINT) AS starts_with, CAST(sum(CASE WHEN ends_with(html, '</html>') THEN 1 ELSE 0 END) AS BIGINT) AS ends_with,
  CAST(sum(CASE WHEN regexp_matches(html, '<h[1-3]') THEN 1 ELSE 0 END) AS BIGINT) AS regex_match, CAST(sum(CASE WHEN html = '' THEN 1 ELSE 0 END) AS BIGINT) AS equals FROM pages
""")
def rule_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many pages each kind of rule condition holds for."""
    tests = [("contains", "the"), ("not_contains", "the"), ("starts_with", "<"), ("ends_with", "</html>"), ("regex_match", "<h[1-3]"), ("equals", "")]
    return table(spark, sf_dir, "pages").agg(*[F.count_if(quality.rule_matches(F.col("html"), op, value)).alias(op) for op, value in tests])
