"""Usage events of the read tools: clients, sessions and the events of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions import values

# Known clients, first match wins.
CLIENTS = (
    ("Claude Code", r"claude[-_ ]?(code|cli)"), ("Claude Desktop", r"claude[-_ ]?desktop"), ("claude.ai", r"claude[-_.]?ai|anthropic"), ("Claude", r"claude"),
    ("MCP Inspector", r"inspector"), ("Cursor", r"cursor"), ("Windsurf", r"windsurf|codeium"), ("VS Code", r"visual[-_ ]?studio[-_ ]?code|vscode|copilot"),
    ("ChatGPT", r"chatgpt|openai"), ("Gemini", r"gemini"), ("JetBrains", r"jetbrains|intellij"), ("Zed", r"\bzed\b"), ("Cline", r"\bcline\b"), ("Goose", r"\bgoose\b"),
    ("Continue", r"continue"), ("mcp-remote", r"mcp[-_]remote"), ("n8n", r"\bn8n\b"), ("LangChain", r"langchain|langgraph"),
    ("MCP TypeScript SDK", r"mcp[-_ ]?(typescript|ts|js)[-_ ]?sdk|@modelcontextprotocol"), ("MCP Python SDK", r"mcp[-_ ]?python|fastmcp"),
    ("Python client", r"python|httpx|aiohttp"), ("Node client", r"\bnode\b|undici|axios"), ("curl", r"\bcurl\b"),
)
# Methods of the protocol.
METHODS = (
    "initialize", "ping", "server/discover", "tools/list", "tools/call", "resources/list", "resources/read", "resources/templates/list", "prompts/list",
    "prompts/get", "completion/complete", "logging/setLevel", "subscriptions/listen", "resources/subscribe", "resources/unsubscribe",
)


def _known(told: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, pattern in reversed(CLIENTS):
        out = F.when(told.rlike(f"(?i){pattern}"), F.lit(label)).otherwise(out)
    return out


def client(name: Column, agent: Column, title: Column | None = None) -> Column:
    """The known product that the first telling text names; unknown text is never repeated."""
    texts = [F.nullif(c, F.lit("")) for c in (name, title, agent) if c is not None]
    return F.coalesce(*[_known(c) for c in texts], F.when(F.coalesce(*texts).isNotNull(), F.lit("other")), F.lit("(not set)"))


def version(value: Column) -> Column:
    """Major and minor of a declared version."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"^v?(\d{1,4}\.\d{1,4})", 1), F.lit("")), F.lit("(not set)"))


def protocol_version(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value).otherwise("(not set)")


def clip(value: Column, n: int = 100) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, n)


def method(value: Column) -> Column:
    return F.when(value.isin(*METHODS), value).otherwise("(other)")


def events(requests: DataFrame) -> DataFrame:
    """One page view a request, and the event that its kind makes; failed ones add an error event.

    `requests`: request_id, at, method, tool, client_name, agent, ok, duration_ms, result_count, date.
    """
    kind = (
        F.when(F.col("method") == "initialize", "connect").when(F.col("method") == "tools/list", "list_tools")
        .when((F.col("method") == "tools/call") & F.col("ok"), "use_tool")
    )
    names = F.filter(F.array(F.lit("page_view"), kind, F.when(~F.col("ok"), F.lit("error"))), lambda n: n.isNotNull())
    who = client(F.col("client_name"), F.col("agent"))
    return requests.select(
        "request_id", F.explode(names).alias("event"), F.concat(values.fnv1a(who).cast("string"), F.lit(".1")).alias("client_id"), values.bucket(F.col("at")).alias("session"), who.alias("client"),
        method(F.col("method")).alias("method"), clip(F.col("tool")).alias("tool"), F.greatest(F.lit(1), F.col("duration_ms")).alias("engagement_ms"), "result_count",
        values.days_between(F.col("date"), F.to_date("at")).alias("days_ago"),
    )


# The dimensions and metrics that usage events carry, with the metrics' units.
DIMENSIONS = (
    "mcp_method", "tool_name", "mcp_client", "mcp_client_version", "mcp_era", "protocol_version", "outcome", "error_code", "http_status", "days_ago",
    "story_date", "story_rank", "story_title", "story_category", "story_keywords",
)
METRICS = (("latency_ms", "MILLISECONDS"), ("result_count", "STANDARD"), ("story_outlets", "STANDARD"))


def registry(spark: SparkSession) -> DataFrame:
    """(name, kind, unit): every dimension and metric that has to be known where events are counted."""
    rows = [(d, "dimension", None) for d in DIMENSIONS] + [(m, "metric", unit) for m, unit in METRICS]
    return spark.createDataFrame(rows, "name string, kind string, unit string")


def registrations(existing: DataFrame) -> DataFrame:
    """What of the registry is still to be registered beside what exists (name); run again, nothing is."""
    return unregistered(registry(existing.sparkSession), existing)


def unregistered(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    return wanted.join(existing.select("name"), "name", "left_anti")


def reading_time(ticks: DataFrame, most_idle: int = 30, least: int = 5) -> DataFrame:
    """Seconds read a story: each second is shared by the stories in view, and idle seconds do not count."""
    shares = ticks.where(F.col("idle_seconds") <= most_idle).select(F.explode("visible").alias("story"), (F.lit(1.0) / F.size("visible")).alias("share"))
    return shares.groupBy("story").agg(F.sum("share").alias("seconds")).where(F.col("seconds") >= least)


# Events of the site beside those of the read tools.
SITE_EVENTS = ("story_read", "story_time", "article_click", "coverage_expand", "story_jump", "share", "section_filter", "install_prompt")
SNOOZE_DAYS, MOST_DISMISSALS, READS_RETURNING, READS_FIRST = (30, 90), 3, 1, 3


def site_events(rows: DataFrame) -> DataFrame:
    """Rows of known site events; others go."""
    return rows.where(F.col("event").isin(*SITE_EVENTS))


def snoozed(dismissals: Column, now: Column) -> Column:
    """struct<dismissals, until> after one more dismissal of the prompt: 30 days, then 90."""
    n = F.coalesce(dismissals, F.lit(0)) + 1
    days = F.get(F.array(*[F.lit(d) for d in SNOOZE_DAYS]), F.least(n, F.lit(len(SNOOZE_DAYS))) - 1)
    return F.struct(n.alias("dismissals"), (now + F.make_dt_interval(days)).alias("until"))


def may_prompt(dismissals: Column, until: Column, now: Column, reads: Column, returning: Column) -> Column:
    """Whether the prompt may show: not dismissed too often, not snoozed, and enough read in this visit."""
    enough = reads >= F.when(returning, F.lit(READS_RETURNING)).otherwise(F.lit(READS_FIRST))
    return (F.coalesce(dismissals, F.lit(0)) < MOST_DISMISSALS) & (until.isNull() | (now >= until)) & enough
