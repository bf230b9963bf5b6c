"""Queries over the tag tree and over vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtide.functions import html as H
from loomtide.functions import vectors as V
from loomtide.operators.clusters import two_groups
from loomtide.operators.hierarchy import count_tree
from loomtide.operators.languages import detect
from loomtide.plans.registry import registry
from loomtide.plans.tables import read
from loomtide.sinks import notes

QUERIES, ORACLE_SQL, query = registry()

#: Regions are roots, nations their children, a category of a third level below the first nation; customers are pages.
_TREE = """tree AS (
    SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id, lower(r_name) AS name FROM region
    UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), lower(n_name) FROM nation
    UNION ALL SELECT 's' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR), 'rich' FROM nation WHERE n_nationkey % 3 = 0),
links AS (SELECT c_custkey AS page_id, CASE WHEN c_acctbal > 5000 AND c_nationkey % 3 = 0 THEN 's' ELSE 'n' END || CAST(c_nationkey AS VARCHAR) AS id FROM customer
    UNION SELECT c_custkey, 'n' || CAST((c_nationkey + 1) % 25 AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0)"""
_COUNTS = f"""WITH RECURSIVE {_TREE},
up(id, ancestor, up) AS (SELECT id, id, 0 FROM tree UNION ALL SELECT u.id, t.parent_id, u.up + 1 FROM up u JOIN tree t ON t.id = u.ancestor WHERE t.parent_id IS NOT NULL),
total AS (SELECT ancestor AS id, count(DISTINCT page_id) AS total FROM links JOIN up USING (id) GROUP BY ancestor),
direct AS (SELECT id, count(DISTINCT page_id) AS direct FROM links GROUP BY id),
sized AS (SELECT id, name, parent_id, CAST(coalesce(direct, 0) AS BIGINT) AS direct, CAST(coalesce(total, 0) AS BIGINT) AS total FROM tree LEFT JOIN direct USING (id) LEFT JOIN total USING (id)),
paths AS (SELECT up.id, string_agg(s.name, '/' ORDER BY up.up DESC) AS path, CAST(max(up.up) AS INTEGER) AS depth FROM up JOIN sized s ON s.id = up.ancestor GROUP BY up.id)"""


def _tree(spark, sf_dir):
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    s = lambda c: F.col(c).cast("string")
    roots = region.select(F.concat(F.lit("r"), s("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lower("r_name").alias("name"))
    inner = nation.select(F.concat(F.lit("n"), s("n_nationkey")).alias("id"), F.concat(F.lit("r"), s("n_regionkey")).alias("parent_id"), F.lower("n_name").alias("name"))
    third = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("s"), s("n_nationkey")).alias("id"), F.concat(F.lit("n"), s("n_nationkey")).alias("parent_id"), F.lit("rich").alias("name"))
    kind = F.when((F.col("c_acctbal") > 5000) & (F.col("c_nationkey") % 3 == 0), "s").otherwise("n")
    links = customer.select(F.col("c_custkey").alias("page_id"), F.concat(kind, s("c_nationkey")).alias("id"))
    more = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("id"))
    return roots.unionByName(inner).unionByName(third), links.unionByName(more)


@query(f"{_COUNTS} SELECT id, path, depth, direct, total FROM sized JOIN paths USING (id)")
def tag_tree_counts(spark, sf_dir):
    return count_tree(*_tree(spark, sf_dir)).select("id", "path", "depth", "direct", "total")


@query(f"""{_COUNTS}, k AS (SELECT up.id, list([lpad(CAST(1000000000 - s.total AS VARCHAR), 12, '0'), s.name] ORDER BY up.up DESC) AS sort_key FROM up JOIN sized s ON s.id = up.ancestor GROUP BY up.id)
    SELECT id, path, row_number() OVER (ORDER BY sort_key) AS position FROM k JOIN paths USING (id)""")
def tree_paths(spark, sf_dir):
    """Nodes in depth-first order, siblings by total, then name."""
    nodes = count_tree(*_tree(spark, sf_dir))
    # the tree of tags is small: one order over all of its nodes is what a listing is
    return nodes.select("id", "path", F.row_number().over(Window.orderBy("sort_key")).cast("long").alias("position"))


@query(f"{_COUNTS} SELECT path FROM paths JOIN tree USING (id) WHERE parent_id IS NULL OR id IN (SELECT parent_id FROM tree)")
def tree_categories(spark, sf_dir):
    tree, links = _tree(spark, sf_dir)
    inner = tree.where("parent_id is not null").select(F.col("parent_id").alias("id")).union(tree.where("parent_id is null").select("id")).distinct()
    return count_tree(tree, links).join(inner, "id", "left_semi").select("path")


@query(f"{_COUNTS} SELECT name AS path, direct, direct AS total FROM sized WHERE direct > 0 ORDER BY direct DESC, path")
def flat_list(spark, sf_dir):
    nodes = count_tree(*_tree(spark, sf_dir)).where("direct > 0")
    return nodes.select(F.col("name").alias("path"), "direct", F.col("direct").alias("total")).orderBy(F.desc("direct"), "path")


@query(f"""{_COUNTS} SELECT repeat('  ', depth) || '- ' || name || ' (' || CAST(total AS VARCHAR) || CASE WHEN total = 1 THEN ' page' ELSE ' pages' END
    || CASE WHEN direct <> total THEN ', ' || CAST(direct AS VARCHAR) || ' tagged directly' ELSE '' END || ')' AS line FROM sized JOIN paths USING (id) WHERE total > 0""")
def tags_markdown(spark, sf_dir):
    """The lines of the tag list, in depth-first order."""
    return notes.tag_lines(count_tree(*_tree(spark, sf_dir))).select("line")


@query(f"""{_COUNTS}, main AS (SELECT page_id, arg_min(split_part(path, '/', 1), [lpad(CAST(1000000000 - total AS VARCHAR), 12, '0'), path]) AS section
    FROM links JOIN sized USING (id) JOIN paths USING (id) GROUP BY page_id)
    SELECT section, CAST(count(*) AS BIGINT) AS pages, md5(string_agg('- [' || c_name || ']', chr(10) ORDER BY lower(c_name), page_id)) AS digest
    FROM main JOIN customer ON c_custkey = page_id GROUP BY section""")
def index_markdown(spark, sf_dir):
    """Each page once, under the top of its main tag's path; lists by lower-case title."""
    tree, links = _tree(spark, sf_dir)
    nodes = count_tree(tree, links).select("id", "path", "total")
    main = links.distinct().join(nodes, "id").groupBy("page_id").agg(F.min_by(F.substring_index("path", "/", 1), F.struct(-F.col("total"), "path")).alias("section"))
    titled = main.join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), "c_name"), "page_id")
    item = F.struct(F.lower("c_name").alias("low"), "page_id", F.concat(F.lit("- ["), "c_name", F.lit("]")).alias("line"))
    lists = titled.groupBy("section").agg(F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("section", "pages", F.md5(F.array_join(F.col("items.line"), "\n").cast("binary")).alias("digest"))


_DOT = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"""SELECT b.vec_id AS tag_id, {_DOT} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY similarity DESC, tag_id LIMIT 50""")
def nearest_tags(spark, sf_dir):
    """The 50 tags most like one page's vector."""
    v = _vectors(spark, sf_dir)
    page = F.broadcast(v.where("id = 0").select(F.col("vector").alias("page")))  # one row
    found = v.where("id != 0").join(page).select(F.col("id").alias("tag_id"), F.round(V.dot(F.col("page"), F.col("vector")), 6).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "tag_id").limit(50)


@query(f"""SELECT page_id, tag_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, tag_id) AS n FROM (
    SELECT a.vec_id AS page_id, b.vec_id AS tag_id, {_DOT} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE n <= 50""")
def nearest_tags_by_page(spark, sf_dir):
    """The 50 tags most like each page's vector."""
    v = _vectors(spark, sf_dir)
    best = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    found = V.similar(v, v, top=50).withColumn("n", F.row_number().over(best)).where("n <= 50")
    return found.select(F.col("left_id").alias("page_id"), F.col("right_id").alias("tag_id"), "similarity")


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, {_DOT} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_DOT} >= 0.35""")
def similar_pairs(spark, sf_dir):
    return V.similar_pairs(_vectors(spark, sf_dir), 0.35).toDF("a", "b", "similarity")


@query(f"""SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS n FROM (
    SELECT a.vec_id AS a, b.vec_id AS b, {_DOT} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE n <= 5""")
def knn5(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    best = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    found = V.similar(v, v, top=5).withColumn("n", F.row_number().over(best)).where("n <= 5")
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "similarity")


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_DOT} >= 0.40),
    r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT node, min(seen) AS merge_group FROM r GROUP BY node""")
def merge_groups(spark, sf_dir):
    """Groups of vectors tied by similarity."""
    from loomtide.operators.groups import groups

    return groups(V.ties(_vectors(spark, sf_dir), 0.40))


@query("""SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i""")
def centroids(spark, sf_dir):
    parts = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, sum(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
    n AS (SELECT label, list_transform(centre, lambda x: x / sqrt(list_dot_product(centre, centre))) AS centre FROM c)
    SELECT vec_id, arg_max(n.label, round(list_dot_product(CAST(embedding AS DOUBLE[]), centre), 9)) AS nearest FROM embeddings, n GROUP BY vec_id""")
def centroid_assign(spark, sf_dir):
    """The nearest of the normalised centres of the groups."""
    v = read(spark, sf_dir, "embeddings")
    sums = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("m"))
    centre = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    centre = centre.select((-1 - F.col("label")).alias("id"), V.normalized(F.col("c")).alias("vector"))  # ids that no vector has
    scored = V.similar(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), centre, top=1)
    best = scored.groupBy("left_id").agg(F.max_by("right_id", F.struct("similarity", "right_id")).alias("right_id"))
    return best.select(F.col("left_id").alias("vec_id"), (-1 - F.col("right_id")).cast("int").alias("nearest"))


@query()
def two_means(spark, sf_dir):
    """Two groups of the vectors of each label; labels by strict comparison, ties to the first group."""
    v = read(spark, sf_dir, "embeddings").select(F.col("label").alias("tag"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return two_groups(v).select(F.col("tag").alias("label"), F.col("id").alias("vec_id"), F.col("part"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id")
def missing_vectors(spark, sf_dir):
    have = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id").join(have, "doc_id", "left_anti").orderBy("doc_id")


@query()
def main_text(spark, sf_dir):
    return H.extract(read(spark, sf_dir, "pages").select("page_id", "html"))


@query()
def detect_language(spark, sf_dir):
    """Detected language of each document; compare with documents.lang."""
    return detect(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
