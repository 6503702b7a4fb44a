"""python -m grainmill STAGE ...: stages from the command line. --config FILE holds values of a stage's options, which flags
override."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.schedule import Schedule
from .operators import audit, catalog, linking, rebalance, stratified
from .plans.queries import QUERIES
from .plans.row_queries import QUERIES as ROW_QUERIES
from .sources import tabular, webdataset


def _text(spark: SparkSession, path: str) -> str:
    """A whole file, on any file system Spark reads."""
    return spark.read.option("wholetext", True).text(path).first()[0]


def _index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    members = webdataset.members(spark, None if a.list else a.tars, **({"list": a.list} if a.list else {}))
    return catalog.index(webdataset.sample_keys(members, a.strip_folders), "sample_key", "tar_path")


def _enrich(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    index = spark.read.parquet(a.index)
    if a.flag:
        return catalog.flag(index, tabular.read_keys(spark, a.scores), a.flag)
    scores = spark.read.parquet(a.scores)
    return catalog.enrich(index, scores, a.columns.split(","), *(a.order or a.columns).split(","))


def _link(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    captions = webdataset.sidecars(webdataset.members(spark, a.tars, payload="true", extensions="json"), a.key)
    tagged = captions.select("sample_key", linking.parse_tags(F.col("caption")).alias("tags"))
    return linking.links(tagged, linking.match_tags(linking.vocabulary(tagged), spark.read.parquet(a.concepts)), "sample_key")


def _stratified(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    links = linking.distinct_links(spark.read.parquet(a.links))
    return stratified.select(links, stratified.quotas(rebalance.concept_counts(links), a.n_head, a.a_head, a.r_min))


def _audit(spark: SparkSession, a: argparse.Namespace) -> dict[str, object]:
    """Evenness before and after a membership, and its totals."""
    links, members = linking.distinct_links(spark.read.parquet(a.links)), spark.read.parquet(a.members)
    counts = rebalance.concept_counts(links)
    mass = audit.realised(links, members, counts.withColumn("m_c", F.lit(1.0)))
    report = {f"{k}_{when}": f(rows, column).first()[0] for when, rows, column in (("before", counts, "N_c"), ("after", mass, "mass")) for k, f in (("gini", audit.gini), ("top_share", audit.top_share))}
    samples, instances = members.agg(F.count(F.lit(1)), F.sum("count")).first()
    return report | {"distinct_samples": samples, "instances": instances}


def with_config(argv: list[str], text: str | None) -> list[str]:
    """The command line after the values of a configuration, so that flags given by hand come last and hold. Nested values
    and nulls are left out."""
    if text is None:
        return argv
    flags: list[str] = []
    for name, value in tabular.parse_config(text).items():
        if isinstance(value, bool):
            flags += [f"--{name}"] if value else []
        elif value is not None and not isinstance(value, (dict, list)):
            flags += [f"--{name}", str(value)]
    return [argv[0], *flags, *argv[1:]]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="grainmill")
    stages = parser.add_subparsers(dest="stage", required=True)
    m = stages.add_parser("materialise", help="an experiment's membership from an index")
    m.add_argument("config")
    m.add_argument("index")
    m.add_argument("out")
    r = stages.add_parser("rebalance", help="copies per sample from links")
    for name in ("links", "index", "out"):
        r.add_argument(name)
    r.add_argument("--reduction", choices=["max", "geomean", "meaninv"], default="max")
    for name, value in vars(Schedule()).items():
        r.add_argument(f"--{name}", type=float, default=value)
    r.add_argument("--alpha", type=float, default=0.5)
    r.add_argument("--cap", type=float, default=16.0)
    i = stages.add_parser("index", help="keys, shards and priorities of tar shards")
    i.add_argument("tars", nargs="?")
    i.add_argument("out")
    i.add_argument("--list", help="a file of shard paths instead of a folder")
    i.add_argument("--strip_folders", action="store_true")
    e = stages.add_parser("enrich", help="score columns, or a flag from a list of keys")
    for name in ("index", "scores", "out"):
        e.add_argument(name)
    e.add_argument("--columns", default="aesthetic_score")
    e.add_argument("--order", help="columns whose last row of a repeated key wins")
    e.add_argument("--flag", help="name of the flag; scores is then a list of keys")
    k = stages.add_parser("link", help="links from the tags in sidecars")
    for name in ("tars", "concepts", "out"):
        k.add_argument(name)
    k.add_argument("--key", default="tagging_caption")
    t = stages.add_parser("stratified", help="a selection with quotas per concept")
    t.add_argument("links")
    t.add_argument("out")
    for name, value in (("n_head", 100_000.0), ("a_head", 1.0), ("r_min", 0.05)):
        t.add_argument(f"--{name}", type=float, default=value)
    u = stages.add_parser("audit", help="a report on a membership")
    for name in ("links", "members", "out"):
        u.add_argument(name)
    q = stages.add_parser("query", help="one of the queries over a folder of tables")
    q.add_argument("name", choices=sorted(QUERIES | ROW_QUERIES))
    q.add_argument("folder")
    q.add_argument("out")
    argv = list(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    text = None
    if "--config" in argv:
        at = argv.index("--config")
        text = _text(spark, argv[at + 1])
        argv = argv[:at] + argv[at + 2 :]
    a = parser.parse_args(with_config(argv, text))
    tables = {"index": _index, "enrich": _enrich, "link": _link, "stratified": _stratified}
    if a.stage in tables:
        tables[a.stage](spark, a).write.mode("overwrite").parquet(a.out)
    elif a.stage == "audit":
        tabular.write_report(_audit(spark, a), a.out, spark)
    elif a.stage == "query":
        (QUERIES | ROW_QUERIES)[a.name](spark, a.folder).write.mode("overwrite").parquet(a.out)
    elif a.stage == "materialise":
        config = tabular.parse_config(_text(spark, a.config))
        chosen = catalog.materialise(spark.read.parquet(a.index), config.get("filter_expression"), int(config["K"]), config.get("mode") or "select").withColumn("count", F.lit(1))
        digest = catalog.membership_hash(chosen, F.col("sample_key"), "priority", "sample_key")
        tabular.write_ordered_lines(chosen, F.col("sample_key"), f"{a.out}/membership", "priority", "sample_key")
        tabular.write_membership(chosen, a.out, config | {"actual_samples": chosen.count(), "membership_hash": digest})
    else:
        links, index = linking.distinct_links(spark.read.parquet(a.links)), spark.read.parquet(a.index)
        counts = rebalance.concept_counts(links)
        nodes = rebalance.node_multiplicity(counts, Schedule(**{k: getattr(a, k) for k in vars(Schedule())}))
        reduce = {
            "max": lambda: rebalance.rarest_wins(links, nodes, index),
            "geomean": lambda: rebalance.geometric_mean(links, nodes, index, a.m_max),
            "meaninv": lambda: rebalance.to_budget(rebalance.mean_inverse(links, counts, index, a.alpha), cap=a.cap),
        }
        members = rebalance.membership(reduce[a.reduction](), index)
        digest = catalog.membership_hash(members, F.concat_ws("\t", "sample_key", "count"), "sample_key")
        tabular.write_membership(members, a.out, {"mode": a.reduction, "membership_hash": digest, "distinct_samples": members.count()})


if __name__ == "__main__":
    main()
