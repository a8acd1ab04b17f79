"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed size. The distinct blocks are sorted and
named by integers; then adjacent pairs of names are sorted and named in the same
way, level by level, until one name is left of each document. Names stand for
contents and are equal exactly if the contents are: no digest decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironquill.llm.shared import cut, hexed, whole

BLOCK = 4096
#: A document is known by its id and this digest, so that rows with a null or repeated id stay apart.
KEY = ["_id", "_sha"]
#: Right half of a pair whose document has an odd number of names; names are never negative.
NOTHING = -1


def _named(contents: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct contents, each with an integer: its place among the sorted contents of its partition."""
    return (contents.select(*columns).distinct().sortWithinPartitions(*columns)
            .withColumn("_name", F.monotonically_increasing_id()))


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int, route: Callable[[Column], Column]) -> DataFrame:
    text = whole(text_col)
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut_up = F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)
    return (docs.select(F.col(id_col).alias("_id"), F.unhex(hexed(text)).alias("_sha"), F.posexplode(cut_up).alias("_at", "_block"))
            .withColumn("_route", route(F.col("_block"))))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK,
               route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per distinct (id, text): ``_id``, ``_sha``, and its identity ``_level``, ``_name``.

    Two texts are equal exactly if both columns of the identity are. A null text
    is an empty one. ``size``: code points of a block. ``route`` only brings a
    block to its name: blocks that share a route are told apart by content.
    """
    blocks = _blocks(docs, id_col, text_col, size, route)
    named = cut(_named(blocks, ["_block"]).select(route(F.col("_block")).alias("_route"), "_name"), "names")
    shared = named.groupBy("_route").agg(F.count("*").alias("_n")).filter("_n > 1").select("_route")
    places = blocks.select(*KEY, "_at", "_route")
    if shared.isEmpty():
        current = places.join(named, "_route")
    else:
        # Blocks that differ and share a route: their names are found by content.
        clash = cut(shared, "clash")
        mixed = blocks.join(clash, "_route", "left_semi")
        apart = cut(_named(mixed, ["_block"]), "apart")
        current = (places.join(clash, "_route", "left_anti").join(named, "_route").select(*KEY, "_at", "_name")
                   .unionByName(mixed.join(apart, "_block").select(*KEY, "_at", (-2 - F.col("_name")).alias("_name"))))
    current = cut(current.select(*KEY, F.col("_at").cast("long").alias("_at"), "_name"), "level")
    done, level = [], 0
    while True:
        most = current.agg(F.max("_at")).first()[0]
        if not most:
            return _all([*done, _done(current, level)])
        # A document whose only name has place 0 is done; the others go on in pairs.
        pairs = cut(current.groupBy(*KEY, F.expr("_at div 2").alias("_at")).agg(
            F.max(F.expr("if(_at % 2 = 0, _name, null)")).alias("_left"),
            F.max(F.expr("if(_at % 2 = 1, _name, null)")).alias("_right"),
        ).withColumn("_right", F.coalesce("_right", F.lit(NOTHING))), "pairs")
        single = pairs.filter(f"_at = 0 and _right = {NOTHING}")
        done.append(_done(single.withColumnRenamed("_left", "_name"), level))
        pairs = pairs.filter(f"not (_at = 0 and _right = {NOTHING})")
        names = cut(_named(pairs, ["_left", "_right"]), "names")
        current = cut(pairs.join(names, ["_left", "_right"]).select(*KEY, "_at", "_name"), "level")
        level += 1


def _done(names: DataFrame, level: int) -> DataFrame:
    # Rows that repeat an id and a text have repeated names on level 0.
    return names.select(*KEY, F.lit(level).alias("_level"), "_name").distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK,
                 route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays (a null id is the
    smallest); of rows that also repeat that id, one. An empty table gives no
    rows.
    """
    identity = identities(docs, id_col, text_col, size, route)
    rows = (docs.select(F.col(id_col).alias("_id"), F.unhex(hexed(whole(text_col))).alias("_sha"))
            .groupBy(*KEY).agg(F.count("*").alias("_rows")))
    both = (F.col("i._id").eqNullSafe(F.col("r._id"))) & (F.col("i._sha") == F.col("r._sha"))
    units = cut(identity.alias("i").join(rows.alias("r"), both).select("i._id", "i._sha", "_level", "_name", "_rows"), "units")
    groups = units.groupBy("_level", "_name").agg(F.max("_id").alias("_keep"), F.sum("_rows").alias("_size"))
    groups = cut(groups, "groups")
    return (units.join(groups, ["_level", "_name"])
            .select("_id", "_keep", "_size", "_sha", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_nth"))
            .select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
                    (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with."""
    kept = (exact_groups(docs, id_col, text_col, size).filter("kept")
            .select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha")))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                         F.unhex(hexed(whole(text_col))).alias("_sha"))
    both = F.col("d._id").eqNullSafe(F.col("k._id")) & (F.col("d._sha") == F.col("k._sha"))
    return (marked.alias("d").join(kept.alias("k"), both, "left_semi").dropDuplicates(KEY).select("_row.*"))
