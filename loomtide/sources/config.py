"""Settings from a TOML file: every field has a default, unknown keys are errors."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Model:
    provider: str = "openai_compatible"
    base_url: str = "http://localhost:11434/v1"
    model: str = "llama3.1:8b"
    api_key_env: str | None = None
    structured_output: str = "json_schema"
    max_input_chars: int = 12_000
    temperature: float = 0.2
    timeout_secs: int = 300
    extra_body: dict = field(default_factory=dict)
    retries: int = 3
    requests_per_minute: int = 0
    price_input_per_mtok: float = 0.0
    price_output_per_mtok: float = 0.0


@dataclass(frozen=True)
class Embeddings:
    enabled: bool = True
    model: str = "nomic-embed-text"
    base_url: str | None = None
    api_key_env: str | None = None
    page_chars: int = 2_000
    timeout_secs: int = 60
    price_per_mtok: float = 0.0


@dataclass(frozen=True)
class Fetch:
    timeout_secs: int = 20
    retries: int = 2
    user_agent: str = "Mozilla/5.0 (compatible; loomtide)"


@dataclass(frozen=True)
class Tags:
    max_per_page: int = 5
    max_new_per_page: int = 3
    vocabulary_limit: int = 50
    style: str = "hierarchical"
    max_depth: int = 3
    taxonomy: str | None = None


@dataclass(frozen=True)
class Filter:
    mode: str = "deny"
    rules: list = field(default_factory=list)


@dataclass(frozen=True)
class Reconcile:
    at_end_of_run: bool = True
    model: str | None = None
    extra_body: dict | None = None
    similarity: float = 0.80
    split_min_pages: int = 2
    split_similarity: float = 0.75
    batch_size: int = 20


@dataclass(frozen=True)
class Notes:
    title: str = "both"


@dataclass(frozen=True)
class Run:
    concurrency: int = 4
    per_domain: int = 2
    sequential_start: int = 20


@dataclass(frozen=True)
class Config:
    llm: Model = Model()
    embeddings: Embeddings = Embeddings()
    fetch: Fetch = Fetch()
    tags: Tags = Tags()
    filter: Filter = Filter()
    reconcile: Reconcile = Reconcile()
    notes: Notes = Notes()
    run: Run = Run()

    def review_model(self) -> Model:
        """The model of the tag review: the page model with what ``reconcile`` replaces."""
        changes = {"model": self.reconcile.model, "extra_body": self.reconcile.extra_body}
        return replace(self.llm, **{k: v for k, v in changes.items() if v is not None})

    def embedding_server(self) -> tuple[str, str | None]:
        """(base URL, name of the key's variable), by default those of the model."""
        return self.embeddings.base_url or self.llm.base_url, self.embeddings.api_key_env or self.llm.api_key_env

    def prices(self) -> tuple[float, float] | None:
        """Dollars per million input and output tokens; 0 for a local server, none where a remote one has no prices."""
        paid = (self.llm.price_input_per_mtok, self.llm.price_output_per_mtok)
        if any(paid) or is_local(self.llm.base_url):
            return paid
        return None

    def rules(self, allow: list[str] = (), deny: list[str] = ()) -> tuple[list[str], list[str]]:
        """(allow, deny) rules: those of the file go to its mode's list, those given are added."""
        own = list(self.filter.rules)
        return (own if self.filter.mode == "allow" else []) + list(allow), (own if self.filter.mode == "deny" else []) + list(deny)


#: The words that a setting may hold.
CHOICES = {
    "llm.provider": ["openai_compatible"],
    "llm.structured_output": ["json_schema", "json_object", "none"],
    "tags.style": ["hierarchical", "flat"],
    "filter.mode": ["deny", "allow"],
    "notes.title": ["both", "page", "summary"],
}

#: The least that a setting may be.
LEAST = {
    "llm.timeout_secs": 1,
    "fetch.timeout_secs": 1,
    "embeddings.timeout_secs": 1,
    "reconcile.batch_size": 1,
    "reconcile.split_min_pages": 2,
    "run.concurrency": 1,
    "run.per_domain": 1,
    "tags.max_depth": 1,
    "tags.max_per_page": 1,
}


def is_local(url: str) -> bool:
    return (urlsplit(url).hostname or "") in ("localhost", "127.0.0.1", "::1")


def _typed(where: str, default, value):
    if isinstance(default, bool) or isinstance(value, bool):
        fits = isinstance(default, bool) and isinstance(value, bool)
    elif isinstance(default, float):
        fits, value = isinstance(value, (int, float)), float(value) if isinstance(value, int) else value
    elif isinstance(default, int):
        fits = isinstance(value, int) and value >= 0
    elif default is None:
        fits = isinstance(value, dict if where.endswith("extra_body") else str)
    else:
        fits = isinstance(value, type(default))
    if not fits:
        raise ValueError(f"{where} can't be {value!r}")
    return value


def _section(kind, data, where: str):
    known = {f.name: f for f in fields(kind)}
    for key in data:
        if key not in known:
            raise ValueError(f"unknown setting {where}{key}")
    empty, values = kind(), {}
    for key, value in data.items():
        default = getattr(empty, key)
        if is_dataclass(default):
            if not isinstance(value, dict):
                raise ValueError(f"{where}{key} is a table")
            values[key] = _section(type(default), value, f"{where}{key}.")
        else:
            values[key] = _typed(f"{where}{key}", default, value)
    return kind(**values)


def parse(text: str) -> Config:
    config = _section(Config, tomllib.loads(text), "")
    for name, words in CHOICES.items():
        table, key = name.split(".")
        if getattr(getattr(config, table), key) not in words:
            raise ValueError(f"{name} must be one of {', '.join(words)}")
    for name, least in LEAST.items():
        table, key = name.split(".")
        if getattr(getattr(config, table), key) < least:
            raise ValueError(f"{name} must be at least {least}")
    if config.filter.mode == "allow" and not config.filter.rules:
        raise ValueError("filter.mode allow needs a rule")
    if not all(isinstance(r, str) for r in config.filter.rules):
        raise ValueError("filter.rules holds texts")
    return config


def load(path: str | None = None) -> Config:
    """The settings of a file that must exist, or the defaults."""
    return parse(Path(path).read_text("utf-8")) if path else Config()


def example() -> str:
    """A settings file that says what holds without one; settings without a default are comments."""
    out = []
    for table in fields(Config):
        out.append(f"[{table.name}]")
        section = getattr(Config(), table.name)
        for f in fields(section):
            value = getattr(section, f.name)
            if value is None or isinstance(value, dict):
                out.append(f"# {f.name} =" + (" {}" if isinstance(value, dict) else ""))
            else:
                out.append(f"{f.name} = {json.dumps(value)}")
        out.append("")
    return "\n".join(out)
