"""Command line: ``python -m loomtide --out DIR import|revise-tags|undo|render|report|config``.

The archive's tables lie in ``DIR/archive``; notes and lists beside them.  The
session is the running one, or a new one with the settings of ``spark-submit``.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from loomtide.functions import replies as R
from loomtide.operators import review as RV
from loomtide.operators.changes import undo_last
from loomtide.plans import engine as E
from loomtide.plans import report
from loomtide.sources import config as C
from loomtide.sources import providers as P
from loomtide.sources import taxonomy as X
from loomtide.sources.state import State


def _least(kind: type, least: float) -> Callable:
    def read(text: str):
        value = kind(text)
        if not value >= least:
            raise argparse.ArgumentTypeError(f"must be at least {least}")
        return value

    read.__name__ = kind.__name__
    return read


def parser() -> argparse.ArgumentParser:
    count = _least(int, 1)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--out", default=argparse.SUPPRESS, help="folder of the archive and its notes (default: loomtide-out)")
    shared.add_argument("--config", default=argparse.SUPPRESS, help="settings file (default: the one that `config` shows)")
    top = argparse.ArgumentParser(prog="loomtide", description="Summaries and tags of web pages as Markdown notes.", parents=[shared])
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name, text: commands.add_parser(name, help=text, description=text, parents=[shared])
    p = add("import", "Add the addresses of a text file, one a line, then summarise and tag pending pages.")
    p.add_argument("file")
    p.add_argument("--lang", default="en", help="language of titles and summaries, or `original`")
    p.add_argument("--limit", type=_least(int, 0), help="pages of this run at most")
    p.add_argument("--model", help="model of the summaries")
    p.add_argument("--retry-failed", action="store_true", help="try failed and unreachable pages again")
    p.add_argument("--allow", action="append", default=[], metavar="RULE", help="only addresses of a rule: domain:, glob:, regex:, prefix:")
    p.add_argument("--deny", action="append", default=[], metavar="RULE", help="no addresses of a rule")
    p.add_argument("--dry-run", action="store_true", help="show pages, tokens and cost; ask and write nothing")
    p.add_argument("--max-tokens", type=_least(int, 0), help="start no page beyond so many tokens")
    p.add_argument("--max-cost", type=_least(float, 0), help="start no page beyond so many dollars")
    p.add_argument("--json", action="store_true", help="print the report as JSON, all else as errors are")
    p.add_argument("--concurrency", type=count, help="pages asked about at a time")
    p.add_argument("--max-tags", type=count, help="tags of a page at most")
    r = add("revise-tags", "Merge, split and place tags.")
    for q in (p, r):
        q.add_argument("--yes", action="store_true", help="apply the review's changes without a question")
        q.add_argument("--taxonomy", help="file of top-level categories")
    add("undo", "Take the latest review that changed tags back.")
    add("render", "Write all notes, _tags.md and _index.md anew.")
    add("report", "Print the report of the latest run.").add_argument("--json", action="store_true")
    add("config", "Show the settings file in use, and an example.")
    return top


def default_config() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "loomtide" / "config.toml"


def settings(given: argparse.Namespace) -> tuple[C.Config, Path | None]:
    """The settings with what the command line replaces, and their file; a taxonomy that the file names lies next to it."""
    named = getattr(given, "config", None)
    path = Path(named) if named else default_config() if default_config().exists() else None
    config = C.load(str(path) if path else None)
    own = getattr(given, "taxonomy", None)
    if own or (path and config.tags.taxonomy):
        config = dataclasses.replace(config, tags=dataclasses.replace(config.tags, taxonomy=own or str(path.parent / config.tags.taxonomy)))
    for option, table, key in (("model", "llm", "model"), ("concurrency", "run", "concurrency"), ("max_tags", "tags", "max_per_page")):
        if (value := getattr(given, option, None)) is not None:
            config = dataclasses.replace(config, **{table: dataclasses.replace(getattr(config, table), **{key: value})})
    return config, path


def servers(config: C.Config) -> E.Services:
    """The servers that the settings name; each of the concurrent tasks gets its share of the rate limit."""

    def chat(m: C.Model, tasks: int) -> P.ChatServer:
        return P.ChatServer(m.base_url, m.model, m.api_key_env, m.structured_output, m.temperature, m.timeout_secs, m.retries, P.Slots(m.requests_per_minute / tasks), m.extra_body)

    f, e, (base, key) = config.fetch, config.embeddings, config.embedding_server()
    embedder = P.EmbeddingServer(base, e.model, key, e.timeout_secs) if e.enabled else None
    return E.Services(P.HttpFetcher(f.timeout_secs, f.retries, f.user_agent), chat(config.llm, config.run.concurrency), embedder, chat(config.review_model(), 1))


def asker(yes: bool, say: Callable, read: Callable | None = None) -> Callable | None:
    """What approves proposals: everything with ``yes``, else what is typed; None where nobody can be asked."""
    if not yes and read is None:
        if not sys.stdin.isatty():
            return None
        read = input

    def choose(proposals: list[RV.Proposal]) -> list[int] | None:
        for n, p in enumerate(proposals, 1):
            say(f"{n:>3}. {p.description}")
        if yes:
            return list(range(len(proposals)))
        while True:
            try:
                picked = RV.parse_choice(read("Apply? [Y]es, [n]o, or the numbers to skip: "), len(proposals))
            except EOFError:
                return None
            if picked is not None:
                return picked
            say("Not understood.")

    return choose


def _taxonomy(config: C.Config) -> X.Taxonomy | None:
    return X.load(config.tags.taxonomy) if config.tags.taxonomy and config.tags.style == "hierarchical" else None


def _import(given, config: C.Config, spark: SparkSession, root: str, folder: str, services) -> int:
    say = lambda line: print(line, file=sys.stderr if given.json else sys.stdout, flush=True)
    taxonomy = _taxonomy(config) if config.reconcile.at_end_of_run else None  # a broken file is found before the run
    language = R.language_mode(given.lang)
    if given.dry_run:
        plan = E.dry_run(spark, root, given.file, config, given.allow, given.deny, given.limit, given.retry_failed)
        print("".join(report.row(k.replace("_", " "), n) + "\n" for k, n in sorted(plan["outcomes"].items())), end="")
        print(report.row("to process", plan["pages"], f"{plan['excluded']} pending ones excluded by rules" if plan["excluded"] else ""))
        price = "unknown without prices" if plan["cost"] is None else f"${plan['cost']:.2f}"
        print(f"about {report.tokens(plan['input_tokens'])} tokens in, {report.tokens(plan['output_tokens'])} out; cost: {price}")
        return 0
    if given.max_cost is not None and config.prices() is None:
        raise ValueError("--max-cost needs price_input_per_mtok and price_output_per_mtok in [llm]")
    say(f"Using model {config.llm.model} at {config.llm.base_url}.")
    out = E.run(
        spark, root, services, config, given.file, folder, given.allow, given.deny, given.limit, given.max_tokens, given.max_cost, given.retry_failed, language,
        asker(given.yes, say), taxonomy, show=say,
    )
    if config.reconcile.at_end_of_run and out.stop is None and "review" not in out.used:
        say("No tag review under a budget; `revise-tags` makes one.")
    for line in out.lines:
        say(line)
    saved = json.loads(State(spark, root, read_only=True).latest_report())
    print(json.dumps(saved, indent=2) if given.json else "\n" + report.text(saved), end="\n" if given.json else "")
    if out.fatal:
        raise RuntimeError(out.stop)
    return 0


def _revise(given, config: C.Config, state: State, folder: str, services: E.Services) -> int:
    taxonomy = _taxonomy(config)
    if not config.embeddings.enabled:
        services = dataclasses.replace(services, embedder=None)
    if services.embedder:
        failed, first = E.fill_vectors(state, services.embedder, config, f"revise-{state.manifest['version']}")
        if failed:
            print(f"{failed} vectors couldn't be made: {first}")
    got = E.review(state, services, config, asker(given.yes, print), taxonomy)
    E.write_all(state, folder, config)
    if got["failed"]:
        raise RuntimeError("the tag review failed: " + ("; ".join(got["errors"]) or "no request succeeded"))
    print(f"Tag review: {got['proposed']} proposed, {got['applied']} applied, {got['not_applied']} could not be applied.")
    if got["applied"]:
        print("`undo` takes the latest revision back.")
    return 0


def _execute(given, services: E.Services | None) -> int:
    config, path = settings(given)
    if given.command == "config":
        print(f"Settings: {path}." if path else f"Settings: defaults; {default_config()} changes them.")
        print("\nExample:\n\n" + C.example(), end="")
        return 0
    folder = getattr(given, "out", "loomtide-out")
    root = os.path.join(folder, "archive")
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("loomtide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "import":
        return _import(given, config, spark, root, folder, services or servers(config))
    state = State(spark, root)
    if given.command == "revise-tags":
        return _revise(given, config, state, folder, services or servers(config))
    if given.command == "undo":
        if undo_last(state):
            E.write_all(state, folder, config)
            print("The latest tag review is undone.")
        else:
            print("No tag review to undo.")
    elif given.command == "render":
        left = E.write_all(state, folder, config)
        print("Notes, _tags.md and _index.md are written." + (f" {left} files aren't notes and were left alone." if left else ""))
    elif saved := state.latest_report():
        print(json.dumps(json.loads(saved), indent=2) + "\n" if given.json else report.text(json.loads(saved)), end="")
    else:
        print("No runs yet. Tags so far:\n")
        for line in E.tag_table(state):
            print(line)
    return 0


def main(argv: list[str] | None = None, services: E.Services | None = None) -> int:
    """Runs a command; 0, or 1 after an error, which is told in one line.  ``services`` replaces the servers of the settings."""
    given = parser().parse_args(argv)
    try:
        return _execute(given, services)
    except (ValueError, OSError, RuntimeError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
