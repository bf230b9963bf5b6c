import json
import sys

import pytest
from pyspark import cloudpickle
from test_engine import Model, Web

from loomtide import cli
from loomtide.operators.review import Proposal
from loomtide.plans import engine as E
from loomtide.sources import config as C
from loomtide.sources.providers import WordEmbedder
from loomtide.sources.state import State

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Follower:
    """Makes a tag where none is offered, and takes the offered one else."""

    def ask(self, messages, schema):
        tag = "later" if "- first" in messages[1]["content"] else "first"
        return {"content": json.dumps({"title": "t", "summary": "s", "language": "en", "tags": [tag], "new_tags": []}), "usage": (10, 2)}


def test_commands(spark, tmp_path, capsys):
    urls, out, settings = tmp_path / "urls.txt", str(tmp_path / "out"), tmp_path / "c.toml"
    urls.write_text("http://h/kite\nhttp://h/kite2\nhttp://h/gone\nhttp://skip/x\n")
    settings.write_text("[run]\nsequential_start = 0\n")
    services = E.Services(Web(), Model(), WordEmbedder())

    def call(*argv):
        code = cli.main(["--out", out, "--config", str(settings), *argv], services)
        return code, *capsys.readouterr()

    code, shown, _ = call("import", str(urls), "--deny", "domain:skip", "--dry-run")
    assert code == 0 and "new                    3" in shown and not (tmp_path / "out").exists()
    code, shown, told = call("import", str(urls), "--deny", "domain:skip", "--yes", "--json")
    record = json.loads(shown)
    assert code == 0 and record["archive"] == {"pending": 0, "done": 2, "failed": 0, "unreachable": 1} and "Using model" in told
    files = {p.name for p in (tmp_path / "out").iterdir()}
    assert {"_tags.md", "_index.md", "_report.md", "notes", "archive"} <= files
    assert "- <http://h/gone>: not found (404)" in (tmp_path / "out" / "_report.md").read_text()
    before = (tmp_path / "out" / "_tags.md").read_text()
    assert "- things (2 pages, 0 tagged directly)\n  - kite (2 pages)\n" in before
    assert json.loads(call("report", "--json")[1]) == record and call("report")[1].startswith("Run of ")
    assert call("undo")[0] == 0 and (tmp_path / "out" / "_tags.md").read_text() != before
    assert call("undo")[1] == "No tag review to undo.\n"
    code, shown, _ = call("revise-tags")  # nobody can be asked
    assert code == 0 and "0 applied" in shown
    (tmp_path / "out" / "_index.md").unlink()
    assert call("render")[0] == 0 and (tmp_path / "out" / "_index.md").exists()


def test_errors(spark, tmp_path, capsys):
    urls, settings = tmp_path / "urls.txt", tmp_path / "c.toml"
    urls.write_text("http://h/kite\n")
    settings.write_text('[llm]\nbase_url = "https://models.example/v1"\n')
    call = lambda *argv: (cli.main([*argv, "--out", str(tmp_path / "o"), "--config", str(settings)], E.Services(Web(), Model())), capsys.readouterr().err)
    assert call("import", str(tmp_path / "none.txt"))[0] == 1
    code, told = call("import", str(urls), "--max-cost", "1")
    assert code == 1 and told.startswith("error: --max-cost needs")
    assert call("import", str(urls), "--taxonomy", str(tmp_path / "none.toml"))[0] == 1
    settings.write_text("[llm]\nmood = 1\n")
    assert call("config") == (1, "error: unknown setting llm.mood\n")
    with pytest.raises(SystemExit):
        cli.main(["import", str(urls), "--concurrency", "0"])


def test_settings(tmp_path, capsys, monkeypatch):
    assert C.parse(C.example()) == C.Config()
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    assert cli.main(["config"]) == 0 and "Settings: defaults" in capsys.readouterr().out
    (tmp_path / "loomtide").mkdir()
    (tmp_path / "loomtide" / "config.toml").write_text('[tags]\ntaxonomy = "tops.toml"\n[llm]\nrequests_per_minute = 8\n')
    config, path = cli.settings(cli.parser().parse_args(["import", "f", "--model", "m", "--concurrency", "2", "--max-tags", "3"]))
    assert path == cli.default_config() and config.tags.taxonomy == str(path.parent / "tops.toml")
    assert (config.llm.model, config.run.concurrency, config.tags.max_per_page) == ("m", 2, 3)
    made = cli.servers(config)
    assert made.chat.slots.per_minute == 4 and made.reviewer.slots.per_minute == 8 and made.embedder.base_url == config.llm.base_url


def test_asker():
    proposals, said = [Proposal({"op": "place"}, f"p{n}") for n in range(3)], []
    replies = iter(["what", "2"])
    assert cli.asker(False, said.append, lambda _: next(replies))(proposals) == [0, 2] and "Not understood." in said
    assert cli.asker(True, said.append)(proposals) == [0, 1, 2]


@pytest.mark.parametrize(("first", "tags"), [(1, {"first": 1, "later": 2}), (0, {"first": 3})])
def test_first_pages_go_alone(spark, tmp_path, first, tags):
    urls = tmp_path / "urls.txt"
    urls.write_text("http://h/a\nhttp://h/b\nhttp://h/c\n")
    config = C.parse(f"[run]\nsequential_start = {first}\n[reconcile]\nat_end_of_run = false")
    E.run(spark, str(tmp_path / "s"), E.Services(Web(), Follower()), config, str(urls))
    assert {r["name"]: r["pages"] for r in State(spark, str(tmp_path / "s")).topic_tags().collect()} == tags
