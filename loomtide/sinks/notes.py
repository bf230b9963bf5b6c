"""Notes, tag list and index as Markdown files."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.functions import text as T
from loomtide.operators.shared import cut
from loomtide.sources.state import State

MARK = "loomtide: note"  # the line that tells own notes from other files


def note_text(style: str = "both") -> Column:
    """Text of a note of (url, title, page_title, source, captured, lang, summary, tags sorted)."""
    own = T.own_title(F.col("page_title"))
    shown = T.display_title(F.col("page_title"), F.col("title"), style)
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), T.json_string(c)))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), T.json_string(t))), "\n"))).otherwise(F.lit("tags: []"))
    both = own.isNotNull() & (T.one_line(F.col("title")) != shown)
    head = F.concat_ws(
        "\n", F.lit("---"), F.lit(MARK), field("url", F.col("url")), field("title", shown), field("page_title", own), F.when(both, field("summary_title", T.one_line(F.col("title")))),
        field("source", F.col("source")), field("captured", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")), field("lang", F.col("lang")), tags, F.lit("---\n"),
    )
    hashes = F.when(F.size("tags") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " "), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("\n# "), shown, F.lit("\n\n**URL:** <"), F.col("url"), F.lit(">\n\n"), F.col("summary"), F.lit("\n"), hashes)


def _number(new: DataFrame, taken: DataFrame) -> DataFrame:
    """``note_file`` of (id, base): the n-th page of a base, by id, gets its n-th number that isn't taken."""
    stem = F.regexp_replace("note_file", r"(-[0-9]+)?\.md$", "")
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(note_file, '-([0-9]+)\\.md$', 1) AS INT)"), F.lit(1))
    # "a-2.md" may be the second page of "a" or the first of "a-2".
    whole = taken.select(F.regexp_replace("note_file", r"\.md$", "").alias("base"), F.lit(1).alias("n"))
    used = taken.select(stem.alias("base"), number.alias("n")).unionByName(whole).distinct()
    new = new.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    # The k-th free number is k plus the taken ones up to it: those whose n minus their rank is below k.
    rank = F.row_number().over(Window.partitionBy("base").orderBy("n"))
    ranked = used.withColumn("before", F.col("n") - rank).groupBy("base", "before").agg(F.count(F.lit(1)).alias("here"))
    shift = new.select("id", "base", "nth").join(ranked, "base").where(F.col("before") < F.col("nth")).groupBy("id").agg(F.sum("here").alias("shift"))
    at = F.col("nth") + F.coalesce("shift", F.lit(0))
    file = F.concat("base", F.when(at == 1, "").otherwise(F.concat(F.lit("-"), at.cast("string"))), F.lit(".md"))
    return new.join(shift, "id", "left").select("id", "base", file.alias("note_file"))


def name_notes(pages: DataFrame, taken: DataFrame, style: str = "both") -> DataFrame:
    """``pages`` with ``note_file`` for those without: title's slug, then -2, -3 and on, around names in (note_file) ``taken``.

    Pages of two bases that come to the same name (the second of ``a`` and the
    first of ``a-2``) are told apart in further rounds; the smaller id keeps it.
    """
    taken = taken.where("note_file IS NOT NULL").select("note_file")
    new = pages.where("note_file IS NULL")
    todo = new.select("id", T.slug(T.display_title(F.col("page_title"), F.col("title"), style)).alias("base"))
    names = None
    while True:
        named = _number(todo, taken)
        named = cut(named.withColumn("turn", F.row_number().over(Window.partitionBy("note_file").orderBy("id"))))
        won = named.where("turn = 1").select("id", "note_file")
        names = won if names is None else names.unionByName(won)
        todo = named.where("turn > 1").select("id", "base")
        if todo.isEmpty():
            break
        taken = taken.unionByName(won.select("note_file"))
    old = pages.where("note_file IS NOT NULL")
    return old.unionByName(new.drop("note_file").join(names, "id").select(*old.columns))


def write_notes(notes: DataFrame, folder: str) -> DataFrame:
    """(note_file, written) of (note_file, text): tasks write to a folder that executors share; files that aren't notes stay.

    A note is written aside and renamed, so that a repeated task leaves the same file.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            done = []
            for name, text in zip(b.column("note_file").to_pylist(), b.column("text").to_pylist()):
                path = os.path.join(folder, name)
                ours = True
                if os.path.exists(path):
                    with open(path, encoding="utf-8", errors="replace") as f:
                        ours = f"\n{MARK}\n" in f.read(200)
                if ours:
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(part, path)
                done.append(ours)
            yield pa.RecordBatch.from_arrays([b.column("note_file"), pa.array(done)], ["note_file", "written"])

    return notes.select("note_file", "text").mapInArrow(run, "note_file string, written boolean")


def tag_lines(tree: DataFrame) -> DataFrame:
    """(sort_key, line) of the tag list: indented by depth, with counts; tags without pages are left out."""
    n = F.col("total")
    direct = F.when(F.col("direct") != n, F.concat(F.lit(", "), F.col("direct").cast("string"), F.lit(" tagged directly"))).otherwise(F.lit(""))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("name"), F.lit(" ("), T.noun(n, "page", "pages"), direct, F.lit(")"))
    return tree.where("total > 0").select("sort_key", line.alias("line")).orderBy("sort_key")


def tag_table(tree: DataFrame) -> DataFrame:
    """(sort_key, line) of the terminal table; the first line is its header, or says that there are no tags."""
    rows = tree.where("total > 0").withColumn("label", F.concat(F.repeat(F.lit("  "), F.col("depth")), "name"))
    size = rows.agg(F.max(F.char_length("label")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    width = max(size["width"] or 0, 3)
    cell = lambda label, a, b: F.concat(F.rpad(label, F.lit(width), F.lit(" ")), F.lpad(a, F.lit(8), F.lit(" ")), F.lpad(b, F.lit(8), F.lit(" ")))
    head = F.lit("No tags yet.") if not size["n"] else cell(F.lit("TAG"), F.lit("PAGES"), F.lit("DIRECT"))
    empty = F.array().cast(rows.schema["sort_key"].dataType)
    top = rows.sparkSession.range(1).select(empty.alias("sort_key"), head.alias("line"))
    body = rows.select("sort_key", cell(F.col("label"), F.col("total").cast("string"), F.col("direct").cast("string")).alias("line"))
    return top.unionByName(body).orderBy("sort_key")


def index_lines(pages: DataFrame) -> DataFrame:
    """(section, k, id, line) of (id, section, title, note_file), in order: sections by name, ``Untagged`` last; pages by lower-case title, then id."""
    link = F.concat(F.lit("- ["), T.link_text(F.col("title")), F.lit("](notes/"), F.replace(F.col("note_file"), F.lit(" "), F.lit("%20")), F.lit(")"))
    return pages.select("section", F.lower("title").alias("k"), "id", link.alias("line")).orderBy(F.col("section") == "Untagged", "section", "k", "id")


def render(state: State, folder: str, style: str = "both") -> DataFrame:
    """Names, writes and records the notes of all pages that have one; (note_file, written)."""
    pages = state.note_pages()
    named = name_notes(pages, state.table("pages").select("note_file"), style)
    files = named.select(F.col("id"), F.col("note_file").alias("fresh"))
    state.commit(pages=state.table("pages").join(files, "id", "left").withColumn("note_file", F.coalesce("fresh", "note_file")).drop("fresh"))
    names = state.table("tags").select("id", "name")
    tags = state.links().join(names, "id").groupBy(F.col("page_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    full = state.note_pages().join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return write_notes(full.select("note_file", note_text(style).alias("text")), folder)
