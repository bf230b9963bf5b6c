"""The report of a run: one record, and its text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import functions as F

from loomtide.functions import urls as U
from loomtide.sources.state import State

#: Kinds of failures that mean a page couldn't be reached.
UNREACHABLE = ["not_found", "blocked", "http_error", "connection", "timeout"]


def number(n: int) -> str:
    return f"{n:,}"


def tokens(n: int) -> str:
    return str(n) if n < 1_000 else f"{n / 1_000:.1f}k" if n < 1_000_000 else f"{n / 1_000_000:.1f}M"


def duration(seconds: float) -> str:
    s = int(seconds + 0.5)
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"


def listed(items: list[str], limit: int) -> str:
    return ", ".join(items[:limit]) + (", …" if len(items) > limit else "")


def row(label: str, n: int, note: str = "") -> str:
    return f"{label:<17}{number(n):>7}" + (f"   {note}" if note else "")


def causes(kinds: dict[str, int]) -> str:
    return " · ".join(f"{kinds[k]} {k.replace('_', ' ')}" for k in sorted(kinds) if k in UNREACHABLE)


def cost(run: dict, prices: tuple[float, float] | None, embedding_price: float = 0.0) -> float | None:
    """Dollars; None where a remote server has no prices."""
    if prices is None:
        return None
    return (run.get("input_tokens", 0) * prices[0] + run.get("output_tokens", 0) * prices[1] + run.get("embedding_tokens", 0) * embedding_price) / 1_000_000


def warnings(run: dict) -> list[str]:
    """The threshold rules that a run breaks."""
    done, replies = run.get("done", 0), run.get("requests", 0) - run.get("without_usage", 0)
    per = lambda k: run.get(k, 0) // replies if replies > 0 else 0
    out = []
    if per("output_tokens") > 1500:
        out.append(f"Replies are long ({number(per('output_tokens'))} tokens on average): is the model thinking?")
    if run.get("context") and per("input_tokens") > 0.8 * run["context"]:
        out.append("Prompts nearly fill the model's context.")
    if run.get("gpu_share") is not None and run["gpu_share"] < 0.95:
        out.append(f"Only {run['gpu_share']:.0%} of the model is on the GPU.")
    if done >= 10 and run.get("pages_cut", 0) * 10 >= done * 3:
        out.append(f"{run['pages_cut']} pages were cut to fit.")
    if done >= 10 and run.get("invalid", 0) * 10 > done:
        out.append(f"{run['invalid']} replies couldn't be used.")
    if run.get("embedding_errors", 0):
        out.append(f"{run['embedding_errors']} vectors couldn't be made.")
    return out


def build(state: State, run: dict, since=None) -> dict:
    """One record of the archive's counts and the run's own; every aggregate is small (kinds, languages, eight domains, twenty tags)."""
    pages = state.table("pages")
    done = pages.where("status = 'done'")
    pairs = lambda df: {r[0]: r[1] for r in df.collect()}
    count = F.count(F.lit(1)).alias("n")
    direct = state.links().groupBy("id").agg(count).join(state.table("tags").where(~F.col("name").startswith("status/")), "id")
    new = direct.where(F.col("created_at") >= F.lit(since)).count() if since is not None else 0
    usage = direct.agg(F.count(F.lit(1)).alias("in_use"), F.count_if(F.col("n") == 1).alias("used_once")).first()
    return {
        "run": run,
        "archive": state.status_counts(),
        "failures": pairs(pages.where(F.col("status").isin("failed", "unreachable")).groupBy(F.coalesce("error_kind", F.lit("unknown")).alias("k")).agg(count).orderBy("k")),
        "languages": pairs(done.where("lang IS NOT NULL").groupBy("lang").agg(count).orderBy(F.desc("n"), "lang")),
        "domains": pairs(pages.select(U.bare_host(F.col("url")).alias("host")).where("host != ''").groupBy("host").agg(count).orderBy(F.desc("n"), "host").limit(8)),
        "tags": {"in_use": usage["in_use"], "used_once": usage["used_once"], "new": new, "untagged": done.join(state.table("page_tags").select(F.col("page_id").alias("id")), "id", "left_anti").count()},
        "most_used": pairs(direct.orderBy(F.desc("n"), "name").limit(20).select("name", "n")),
        "warnings": warnings(run),
    }


def text(report: dict) -> str:
    run, archive = report["run"], report["archive"]
    lines = [f"Run of {duration(run.get('seconds', 0))}" + (f", stopped: {run['stop']}" if run.get("stop") else ""), ""]
    lines += ["Archive", row("pages", sum(archive.values())), *(row(k, archive[k], causes(report["failures"]) if k == "unreachable" else "") for k in archive), ""]
    if report["languages"]:
        lines += ["Languages: " + listed([f"{k} {v}" for k, v in report["languages"].items()], 6)]
    if report["domains"]:
        lines += ["Domains: " + listed([f"{k} {v}" for k, v in report["domains"].items()], 8)]
    if run.get("requests"):
        speed = f", {duration(run.get('model_seconds', 0) / max(1, run.get('done', 0)))} a page"
        lines += ["", f"Model: {number(run['requests'])} requests, {tokens(run.get('input_tokens', 0))} in, {tokens(run.get('output_tokens', 0))} out{speed}"]
    t = report["tags"]
    lines += ["", "Tags", row("in use", t["in_use"]), row("used once", t["used_once"]), row("new", t["new"]), row("untagged pages", t["untagged"])]
    top = [f"{k} {v}" for k, v in report["most_used"].items() if v > 1]
    lines += ["Most used: " + ", ".join(top)] if top else []
    lines += ["", "Warnings", *(f"- {w}" for w in report["warnings"])] if report["warnings"] else []
    return "\n".join(lines) + "\n"


def markdown(report: dict, failed: Iterable[tuple[str, str, str]]) -> Iterator[str]:
    """Parts of the file: the text, then the list of (url, kind, error) of failed pages."""
    yield "# Report\n\n```\n" + text(report) + "```\n"
    for n, (url, kind, error) in enumerate(failed):
        yield ("" if n else "\n## Pages without content\n\n") + f"- <{url}>: {kind.replace('_', ' ')}{f' ({error})' if error else ''}\n"


def save(state: State, report: dict, started, finished) -> int:
    """Adds the report to the runs; its id."""
    id_ = state.next_id("runs")
    new = state.spark.createDataFrame([(id_, started, finished, json.dumps(report))], "id long, started_at timestamp, finished_at timestamp, report string")
    state.commit(runs=state.table("runs").unionByName(new), next_id={"runs": id_ + 1})
    return id_


def estimate(last: dict | None, vocabulary: int = 50, max_chars: int = 12_000) -> tuple[float, float]:
    """(input, output) tokens a page: those of the last report, else a guess from the prompt's size."""
    run = (last or {}).get("run", {})
    if run.get("done") and run.get("input_tokens"):
        return run["input_tokens"] / run["done"], run.get("output_tokens", 0) / run["done"]
    return (2000 + 60 * vocabulary + 0.5 * max_chars) / 4, 250.0
