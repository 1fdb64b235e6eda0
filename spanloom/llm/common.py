"""Shared plumbing: shipping the package to workers, scratch tables, components, bucket linking."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    at = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    Path(at).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


_OWN_DIR: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
    return _OWN_DIR[0]


def materialise(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there.

    hashes: df is mostly hashes, for which dictionaries and hard compression don't pay.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    how = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"} if hashes else {"compression": "zstd"}
    df.write.options(**how).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished steps; else they stay until the driver happens to collect its garbage."""
    spark._jvm.System.gc()


#: Rows of fixed width up to which a side is broadcast (some tens of MB).
SMALL = 1_000_000


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges (a, b), by alternating large-star and small-star.

    Only nodes that have an edge appear. Every round is an aggregation and two joins; its result is a
    written table. Hub nodes are met by map-side minima and by the adaptive skew join, never by one task.
    """
    cur = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name
    )
    seen = None
    while True:
        # large star: every larger neighbour of u is hung on u's smallest neighbour
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are hung on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.withColumnRenamed("m", "v"))
            .distinct()
        )
        nxt = materialise(small, name)
        state = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(cur)
        cur = nxt
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
    return out


#: Members from which a bucket's rest is not compared as it is, but split by a second key.
HOT = 512
#: Members of a large bucket that meet in one part of it.
PART = 4096
#: Pairs that are always few enough to be compared at once.
FEW = 200_000


def link_in_buckets(members: DataFrame, describe: Callable[[DataFrame], DataFrame] | None, verify: Callable[[DataFrame], DataFrame], name: str = "link", meets: str = "true", star_rounds: int = 3, slack: int = 128, depth: int = 0, whole: bool = False, band: str | None = None, at_once: int = 0) -> DataFrame:
    """Verified links (a < b) that connect what shares a bucket and passes verify.

    members: (key, id), also repeatedly, ids comparable longs, and mark, unless describe makes that. describe: (id, mark) of
    the ids given, which are those in buckets of two or more. meets: SQL condition on x.mark and y.mark that every linked pair
    fulfils; it is held against pairs as they meet, and only the rest is written. verify: keeps the pairs (a, b) that are really linked.
    A bucket never emits all its pairs. Star rounds test each member against one leader of its bucket.
    Then only members outside their bucket's largest component are tested against the rest of the bucket,
    so that every pair between different components is tested: the components are exactly those of all
    linked pairs. If such rest work would exceed `slack` times the members, another star round goes first,
    `star_rounds` of them at most, and with `whole` further ones as long as each halves that work. With `whole` that is all:
    the rest of every bucket is compared, whatever its size, in parts of PART members, and within neighbouring values of
    band if that is given: SQL on mark, a whole number that differs by one at most between linked members.
    Without `whole` pairs that only share one key may be lost. A bucket of more than HOT members that still has such a rest is split: its
    members meet where they share a second key too (and a third one at depth 2), which similar members do and
    members that only share one common key don't; so the pairs grow with the members, not with their square.
    With `at_once`, which asks for a few repeated members only, all pairs of all buckets are held against meets and verify
    at once, without stars, as long as they are no more than at_once times the members.
    """
    if at_once:
        # members are shuffled once: what stands alone under its key is seen where it has come to
        met = members.repartition("key").withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1")
        bare = materialise(met.dropDuplicates(["key", "id"]).select("key", "id", "n"), f"{name}-bare")
        work = bare.agg(F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("w")).first()
        live = bare if describe is None else bare.join(describe(bare.select("id").distinct()), "id")
        if (work["w"] or 0) <= 2 * at_once * work["k"]:
            todo = live.alias("x").join(live.alias("y"), F.expr(f"x.key = y.key and x.id < y.id and ({meets})")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
            todo = materialise(todo, f"{name}-todo")
            links = materialise(verify(todo), f"{name}-links")
            discard(bare, todo)
            return links
        live = materialise(live, f"{name}-members")
        discard(bare)
        return _stars(live, verify, name, meets, star_rounds, slack, depth, whole, band)
    # keys of two ids or more, by partial sums that don't grow with repeated members
    shared = members.groupBy("key").agg(F.min(F.hash("id")).alias("lo"), F.max(F.hash("id")).alias("hi")).where("lo <> hi").select("key")
    shared = materialise(shared, f"{name}-buckets")
    bare = materialise(members.join(F.broadcast(shared) if shared.count() <= SMALL else shared, "key").dropDuplicates(["key", "id"]), f"{name}-bare")
    live = bare.join(bare.groupBy("key").agg(F.count("*").alias("n")), "key")
    live = live if describe is None else live.join(describe(bare.select("id").distinct()), "id")  # the mark comes last: it is wide
    live = materialise(live, f"{name}-members")
    discard(bare, shared)
    return _stars(live, verify, name, meets, star_rounds, slack, depth, whole, band)


def _stars(live: DataFrame, verify: Callable[[DataFrame], DataFrame], name: str, meets: str, star_rounds: int, slack: int, depth: int, whole: bool, band: str | None) -> DataFrame:
    """The rounds of link_in_buckets over live: key, id, n (the bucket's members), mark; live is discarded."""
    total = live.count()
    links, tested, comp, before = None, None, None, None
    r = 0
    side = lambda c: F.struct("mark").alias(c)
    pair = lambda other: [F.least(F.col(other), "id").alias("a"), F.greatest(F.col(other), "id").alias("b")]
    while True:
        if comp is None:
            marked = live.withColumn("c", F.col("id"))
        else:
            # the only pair of a bucket of two is tested by now
            roots = comp.withColumnRenamed("node", "id")
            placed = live.where("n > 2").join(F.broadcast(roots) if comp.count() <= SMALL else roots, "id", "left").select("key", "id", "mark", F.coalesce("root", "id").alias("c"))
            marked = materialise(placed, f"{name}-marked")
            span = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
            sizes = marked.join(span, "key", "left_semi").groupBy("key", "c").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", "n").alias("main"))
            main = materialise(main.select("key", "n", "main", (F.col("n") - F.col("most")).alias("rest")), f"{name}-main")
            work = main.agg(F.sum(F.col("n") * F.col("rest")).alias("w"), F.count("*").alias("k"), F.max(F.when(F.col("rest") > slack, F.col("n"))).alias("hot")).first()
            if not work["k"]:
                break
            hot = (F.col("n") > HOT) & (F.col("rest") > slack)
            small = work["w"] <= max(slack * total, FEW)
            # with three keys in common, stars go on as long as they link anything
            pays, before = before is None or 2 * work["w"] <= before, work["w"]
            if small or r >= star_rounds and (not pays if whole else depth < 2 or found.isEmpty()):
                split = not small and not whole and depth < 2 and (work["hot"] or 0) > HOT
                here = main.where(~hot) if split else main
                outside = marked.join(here.select("key", "main", "n"), "key").where("c <> main").select("key", "n", "main", F.col("id").alias("other"), F.col("c").alias("cx"), side("x"))
                every = marked.select("key", "id", "c", "mark")  # as outside reads it, so that it is shuffled once for both
                on = ["key"]
                if not small:  # no task meets a large bucket alone
                    parts = F.ceil(F.col("n") / PART).cast("int")
                    outside = outside.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
                    every = every.join(here.select("key", "n"), "key").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("n")
                    on.append("part")
                    if band:
                        outside = outside.select("*", F.expr(band.replace("mark", "x.mark")).cast("int").alias("at")).withColumn("band", F.explode(F.expr("array(at - 1, at, at + 1)"))).drop("at")
                        every = every.withColumn("band", F.expr(band).cast("int"))
                        on.append("band")
                # of two members outside the main component only one goes to meet the other
                todo = outside.join(every.alias("y"), on).where("c <> cx and (c = main or other < id)").where(meets).select(*pair("other")).distinct()
                # verify reads its pairs more than once
                todo = materialise(todo.join(tested, ["a", "b"], "left_anti"), f"{name}-todo")
                links = links.unionByName(materialise(verify(todo), f"{name}-links"))
                discard(todo)
                if split:
                    first = marked.join(main.where(hot).select("key"), "key").select("id", F.col("key").alias("k1"), "mark")
                    both = first.join(live.select("id", F.col("key").alias("k2")), "id").where("k1 <> k2")
                    both = both.select(F.xxhash64(F.least("k1", "k2"), F.greatest("k1", "k2")).alias("key"), "id", "mark").dropDuplicates(["key", "id"])
                    links = links.unionByName(link_in_buckets(both, None, verify, name, meets, star_rounds, slack, depth + 1))
                break
            marked = marked.join(main.select("key"), "key", "left_semi")
        # one shuffle brings a bucket together: its first member leads
        first = W.partitionBy("key").orderBy(*([F.xxhash64("id", F.lit(r))] if r else []), "id")
        led = marked.select("key", "id", "c", "mark", *[F.first(x).over(first).alias(f"lead_{x}") for x in ("id", "c", "mark")])
        led = led.where("id <> lead_id and c <> lead_c").select("id", "lead_id", side("x"), F.struct(F.col("lead_mark").alias("mark")).alias("y"))
        todo = led.where(meets).select(*pair("lead_id")).distinct()
        if tested is not None:
            todo = todo.join(tested, ["a", "b"], "left_anti")
        todo = materialise(todo, f"{name}-todo")
        found = materialise(verify(todo), f"{name}-links")
        tested = todo if tested is None else tested.unionByName(todo)
        links = found if links is None else links.unionByName(found)
        if comp is not None:
            discard(comp)
        comp = materialise(components(links, f"{name}-cc"), f"{name}-comp")
        r += 1
    discard(live)
    return links
