"""Optional model enrichment: requests are written here, asked within a day's budget, and replies are validated here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.config import SECTIONS
from tidewire.functions import text, values

#: Given the instructions, the input and whether to reason, an answer: status, body (the reply's JSON, or an error's
#: text), and the tokens that were billed, if known.
Provider = Callable[[str, str, bool], "dict | None"]
ANSWER = "status int, body string, tokens_in long, tokens_out long, resent boolean"


def enabled(env: dict[str, str]) -> bool:
    return bool(env.get("MODEL_API_KEY")) and env.get("MODEL_SUMMARIES") != "0"


def keyed(stories: DataFrame, by: str = "day") -> DataFrame:
    """(by, id, key): the positional keys under which a model is told of stories, and answers."""
    return stories.select(by, "id", F.concat(F.lit("t"), F.col("place")).alias("key"))


def _request(blocks: DataFrame, kind: str, by: str, separator: str, instructions: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda b: b["block"]), separator)
    asked = blocks.groupBy(by).agg(body.alias("input"), F.count("*").alias("n"))
    return asked.select(by, F.lit(kind).alias("kind"), F.lit(instructions).alias("instructions"), "input", (F.length("input") + len(instructions)).alias("chars"), "n")


def summary_requests(stories: DataFrame, instructions: str, by: str = "day", titles: int = 5, title_chars: int = 200, chars: int = 200) -> DataFrame:
    """One request a day (kind, instructions, input, chars): each story's key, and a line an article with what describes it."""
    line = lambda a: F.concat(F.lit("- "), text.truncate(a["title"], title_chars), F.when(F.coalesce(a["description"], F.lit("")) != "", F.concat(F.lit(" — "), text.truncate(a["description"], chars))).otherwise(""))
    block = F.concat(F.lit("[t"), F.col("place"), F.lit("]\n"), F.array_join(F.transform(F.slice("articles", 1, titles), line), "\n"))
    return _request(stories.select(by, "place", block.alias("block")), "topics", by, "\n\n", instructions)


def section_requests(candidates: DataFrame, instructions: str, by: str = "day", headlines: int = 3, chars: int = 160) -> DataFrame:
    """One request a day: each candidate's key and its first headlines."""
    lines = F.transform(F.slice("sample_headlines", 1, headlines), lambda h: F.concat(F.lit("- "), text.truncate(h, chars)))
    block = F.concat(F.lit("[t"), F.col("place"), F.lit("]\n"), F.array_join(lines, "\n"))
    return _request(candidates.select(by, "place", block.alias("block")), "sections", by, "\n\n", instructions)


def overview_requests(stories: DataFrame, instructions: str, by: str = "day", least: int = 3, chars: int = 160, summary_chars: int = 320) -> DataFrame:
    """One request for each day of at least three stories: rank, title and summary, a line a story."""
    told = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" — "), text.truncate(F.col("summary"), summary_chars))).otherwise("")
    block = F.concat(F.lit("["), F.col("place"), F.lit("] "), text.truncate(F.col("title"), chars), told)
    return _request(stories.select(by, "place", block.alias("block")), "overview", by, "\n", instructions).where(F.col("n") >= least)


def replies(raw: DataFrame, inputs: DataFrame, by: str = "day") -> DataFrame:
    """(by, id, title, summary, duplicate_of): replies (by, key, title, summary, duplicate_key) to known keys; a story is no
    duplicate of itself."""
    known = inputs.select(by, "key", "id")
    twin = known.select(by, F.col("key").alias("duplicate_key"), F.col("id").alias("duplicate_of"))
    joined = raw.join(known, [by, "key"]).join(twin, [by, "duplicate_key"], "left").where(F.coalesce("title", F.lit("")) != "")
    return joined.select(by, "id", "title", F.nullif("summary", F.lit("")).alias("summary"), F.when(F.col("duplicate_of") != F.col("id"), F.col("duplicate_of")).alias("duplicate_of"))


def sections(raw: DataFrame, inputs: DataFrame, by: str = "day") -> DataFrame:
    return raw.where(F.col("section").isin(*SECTIONS)).join(inputs.select(by, "key", "id"), [by, "key"]).select(by, "id", "section")


def within_budget(requests: DataFrame, ledger: DataFrame, budget: float, price_in: float, price_out: float, most_out: int) -> DataFrame:
    """Requests (day, at, chars and, if known, their cost) that the day's budget still bears, in order, with `worst` and `total`.

    A request passes if what is spent and twice its greatest cost stay within the budget; then what it costs is spent, or
    its worst case where the cost is not known. A refused request costs nothing. One day's requests are one group.
    """
    spent = ledger.groupBy("day").agg(F.sum("amount").alias("spent"))
    worst = values.worst_cost(F.col("chars"), F.lit(price_in), F.lit(price_out), most_out)
    cost = F.coalesce("cost", "worst") if "cost" in requests.columns else F.col("worst")
    asked = requests.withColumn("worst", worst).withColumn("__cost", cost).join(spent, "day", "left").withColumn("total", F.round(F.coalesce("spent", F.lit(0.0)), 9)).drop("spent")

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending")])
        total, kept, totals = group["total"][0].as_py(), [], []
        for worst_case, spends in zip(group["worst"].to_pylist(), group["__cost"].to_pylist(), strict=True):
            kept.append(round(total + worst_case, 9) <= budget)
            total += spends if kept[-1] else 0.0
            totals.append(total)
        return group.set_column(group.column_names.index("total"), "total", pa.array(totals, pa.float64())).filter(pa.array(kept, pa.bool_()))

    return asked.groupBy("day").applyInArrow(fold, asked.schema).drop("__cost")


def record_spend(ledger: DataFrame, spend: DataFrame, keep: int = 60) -> DataFrame:
    total = ledger.unionByName(spend).groupBy("day").agg(F.sum("amount").alias("amount"))
    return total.orderBy(F.desc("day")).limit(keep)


def ask(requests: DataFrame, provider: Provider | None) -> DataFrame:
    """The requests with a provider's `answer` (ANSWER), asked on the executors; without a provider, or where it fails, null.

    An error 400 that is about reasoning is asked once more without it; a refused request is not billed. Nothing else is
    asked twice.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in requests.schema)}, answer struct<{', '.join(c.replace(' ', ':') for c in ANSWER.split(', '))}>"
    if provider is None:
        return requests.withColumn("answer", F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ':') for c in ANSWER.split(', '))}>"))

    def once(instructions: str, body: str, reason: bool) -> dict | None:
        try:
            return provider(instructions, body, reason)
        except Exception:  # noqa: BLE001  a failed model leaves the headlines as they are
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("status", pa.int32()), ("body", pa.string()), ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("resent", pa.bool_())])
        for batch in batches:
            got = []
            for instructions, body in zip(batch.column("instructions").to_pylist(), batch.column("input").to_pylist(), strict=True):
                answer, resent = once(instructions, body, True), False
                if answer and answer.get("status") == 400 and "reasoning" in (answer.get("body") or "").lower():
                    answer, resent = once(instructions, body, False), True
                got.append(None if answer is None else {c: answer.get(c) for c in ("status", "body", "tokens_in", "tokens_out")} | {"resent": resent})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, "answer"])

    return requests.mapInArrow(run, schema)


def spends(asked: DataFrame, price_in: float, price_out: float, by: str = "day") -> DataFrame:
    """(by, amount) of the answered requests: what their tokens cost, or the worst case where the answer does not say."""
    answered = asked.where(F.col("answer.status") == 200)
    cost = values.model_cost(F.lit(price_in), F.lit(price_out), F.col("answer.tokens_in"), F.col("answer.tokens_out"))
    return answered.select(by, F.coalesce(cost, "worst").alias("amount"))


def topic_replies(asked: DataFrame, by: str = "day") -> DataFrame:
    """(by, key, title, summary, duplicate_key, section) of the answers that are what was asked for."""
    reply = F.from_json(F.when(F.col("answer.status") == 200, F.col("answer.body")), "topics array<struct<key:string,title:string,summary:string,duplicate_of:string,section:string>>")
    rows = asked.select(by, F.inline(reply["topics"]))
    return rows.select(by, "key", F.trim("title").alias("title"), F.trim("summary").alias("summary"), F.col("duplicate_of").alias("duplicate_key"), "section")


def overview_replies(asked: DataFrame) -> DataFrame:
    """(date, at, text, stories) of the answers to overview requests, as `briefing.with_overview` takes them."""
    reply = F.from_json(F.when(F.col("answer.status") == 200, F.col("answer.body")), "points array<struct<text:string,stories:array<int>>>")
    rows = asked.select(F.col("day").cast("string").alias("date"), F.posexplode(reply["points"]).alias("at", "p"))
    return rows.select("date", "at", F.trim(F.regexp_replace("p.text", r"\s+", " ")).alias("text"), F.col("p.stories").alias("stories"))
