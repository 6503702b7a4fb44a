"""Free-text tags, and the concepts they name. The matcher is lexical, with vectors to re-rank where there are some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import small

#: Tags that describe a picture but name nothing in it, and the endings of such tags.
ABSTRACT_TAGS = [
    "atmosphere", "scene", "view", "setting", "detail", "details", "moment", "expression", "expressions", "perspective", "angle",
    "texture", "textures", "mood", "vibe", "vibes", "backdrop", "surroundings", "environment", "aesthetic", "aesthetics", "manner",
    "style", "ambiance", "ambience", "shot", "fashion",
]
ABSTRACT_ENDINGS = [
    "atmosphere", "atmospheres", "scene", "scenes", "view", "views", "setting", "settings", "detail", "details", "moment",
    "moments", "expression", "expressions", "perspective", "perspectives", "angle", "angles", "texture", "textures", "mood",
    "vibe", "backdrop", "background", "surroundings", "environment", "style", "aesthetic", "aesthetics", "shot", "shots", "day",
    "days", "fashion",
]
#: Names of concepts that are no things.
ABSTRACT_NODES = [
    "atmosphere", "scene", "view", "setting", "settings", "detail", "details", "moment", "expression", "perspective", "angle",
    "texture", "mood", "vibe", "backdrop", "background", "surroundings", "environment", "aesthetic", "manner", "style",
    "ambiance", "ambience", "shot", "fashion", "day", "hour", "preparation",
]


def is_abstract_tag(tag: Column) -> Column:
    t = F.lower(F.trim(tag))
    return t.isin(ABSTRACT_TAGS) | t.rlike(" (" + "|".join(ABSTRACT_ENDINGS) + ")$")


def is_abstract_node(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(ABSTRACT_NODES)


def parse_tags(text: Column) -> Column:
    """Distinct clean tags: split at commas, lower case, without quoted lettering, leading counts, bare numbers and abstract
    descriptors. Null text has none."""
    bare = F.regexp_replace(F.lower(text), "['\"‘’“”][^'\"‘’“”]*['\"‘’“”]", " ")
    tags = F.transform(F.split(bare, ","), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^\s*\d+\s+", "")))
    return F.array_distinct(F.filter(tags, lambda t: (t != "") & ~t.rlike(r"^[\d\s.]+$") & ~is_abstract_tag(t)))


def vocabulary(tagged: DataFrame, tags: str = "tags") -> DataFrame:
    """Every distinct tag once, with the number of rows that have it."""
    return tagged.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))


def base_name(name: Column) -> Column:
    """A concept's name in lower case without the part in brackets."""
    return F.lower(F.trim(F.element_at(F.split(name, r" \("), 1)))


def match_tags(vocab: DataFrame, concepts: DataFrame, top_k: int = 3, min_similarity: float = 0.65, keep_margin: float = 0.03) -> DataFrame:
    """(tag, node_id, node_name, score) for distinct tags: 1 where the whole tag is a concept's name, 0.8 where its last word
    is, shared out over nothing else. At most top_k nodes within keep_margin of the tag's best; ties by node_id.

    Equi-joins on normalised names only; a name that many nodes share is cut to top_k nodes before it is joined.
    """
    named = concepts.where(F.col("node_id").isNotNull() & F.col("node_name").isNotNull() & ~is_abstract_node(F.col("node_name")))
    by_name = named.select(base_name(F.col("node_name")).alias("name"), "node_id", "node_name")
    first = by_name.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("node_id"))).where(F.col("r") <= top_k).drop("r")
    tags = vocab.select("tag").where("tag is not null").distinct()
    looks = tags.select("tag", F.explode(F.array(F.struct(F.col("tag").alias("name"), F.lit(1.0).alias("score")), F.struct(F.element_at(F.split("tag", " "), -1).alias("name"), F.lit(0.8).alias("score")))).alias("l")).select("tag", "l.name", "l.score")
    hits = looks.join(small(first), "name").groupBy("tag", "node_id", "node_name").agg(F.max("score").alias("score"))
    kept = W.partitionBy("tag")
    return (
        hits.withColumn("best", F.max("score").over(kept))
        .where((F.col("score") >= min_similarity) & (F.col("score") >= F.col("best") - keep_margin))
        .withColumn("r", F.row_number().over(kept.orderBy(F.desc("score"), "node_id")))
        .where(F.col("r") <= top_k)
        .select("tag", "node_id", "node_name", "score")
    )


def links(tagged: DataFrame, matches: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """(key, node_id) once each; tags that name nothing vanish."""
    return tagged.select(key, F.explode(tags).alias("tag")).join(small(matches.select("tag", "node_id")), "tag").select(key, "node_id").distinct()


def distinct_links(rows: DataFrame) -> DataFrame:
    return rows.where("sample_key is not null and node_id is not null").select("sample_key", "node_id").distinct()


def rerank(matches: DataFrame, tag_vectors: DataFrame, node_vectors: DataFrame, margin: float = 0.03, top_k: int = 3) -> DataFrame:
    """Matches in order of the cosine of (tag, vector) and (node_id, vector): within a margin of the best, at most top_k.
    A match without both vectors keeps its lexical score."""
    cosine = F.aggregate(F.zip_with("tv", "nv", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a.cast("double") * a), F.lit(0.0), lambda s, x: s + x))
    both = matches.join(tag_vectors.select("tag", F.col("vector").alias("tv")), "tag", "left").join(node_vectors.select("node_id", F.col("vector").alias("nv")), "node_id", "left")
    score = F.coalesce(F.try_divide(cosine, norm("tv") * norm("nv")), F.col("score"))
    w = W.partitionBy("tag")
    scored = both.withColumn("score", score).withColumn("best", F.max("score").over(w)).where(F.col("score") >= F.col("best") - margin)
    return scored.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "node_id"))).where(F.col("r") <= top_k).select("tag", "node_id", "node_name", "score")


def check_taxonomy(concepts: DataFrame, edges: DataFrame, root: str) -> None:
    """The root is a concept, there are concepts, and every edge has both ends."""
    if concepts.where(F.col("node_id") == root).isEmpty():
        raise ValueError(f"no root {root!r}")
    ids = concepts.select("node_id")
    for end in ("child", "parent"):
        if not edges.join(ids, F.col(end) == F.col("node_id"), "left_anti").isEmpty():
            raise ValueError(f"an edge has a {end} that is no concept")


def ancestors(edges: DataFrame, depth: int = 40) -> DataFrame:
    """(node_id, ancestor), each node its own ancestor too, from (child, parent) edges of an acyclic taxonomy. Paths double in
    length each round."""
    from ..context import cut

    direct = edges.select(F.col("child").alias("node_id"), F.col("parent").alias("ancestor")).where("node_id is not null and ancestor is not null")
    ends = direct.select("node_id").unionByName(direct.select(F.col("ancestor").alias("node_id"))).distinct()
    now = cut(direct.unionByName(ends.withColumn("ancestor", F.col("node_id"))).distinct())
    count = now.count()
    for _ in range(depth):
        far = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.node_id")).select(F.col("a.node_id"), F.col("b.ancestor")).distinct()
        now = cut(far)
        if (n := now.count()) == count:
            return now
        count = n
    raise ValueError("the taxonomy is deeper than allowed, or has a cycle")


def primary_group(closure: DataFrame, groups: DataFrame) -> DataFrame:
    """(node_id, group_id): of a node's ancestors that are groups, the one with the least id."""
    return closure.join(small(groups.select(F.col("group_id"))), F.col("ancestor") == F.col("group_id")).groupBy("node_id").agg(F.min("group_id").alias("group_id"))
