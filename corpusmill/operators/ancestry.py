"""Which commits belong to the checked-out history, from parent links alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.materialize import dropped, materialized


def chains(commits: DataFrame) -> DataFrame:
    """``repo_url, sha, chain, position``: every commit's first-parent chain and its place in it, newest first.

    A commit goes on the chain of the least of the children that have it as
    their first parent; without one it opens a chain.  Places are counted by
    pointer jumping: log2 of the longest chain rounds, each written to the
    shared folder and deleted when the next one stands.
    """
    child = (
        commits.where(F.size("parents") > 0)
        .groupBy("repo_url", F.get("parents", F.lit(0)).alias("sha")).agg(F.min("sha").alias("up"))
    )
    jumps = materialized(
        commits.select("repo_url", "sha").distinct().join(child, ["repo_url", "sha"], "left").select(
            "repo_url", "sha", F.coalesce("up", "sha").alias("chain"), F.col("up").isNotNull().cast("bigint").alias("position")
        ),
        "jumps",
    )
    while True:
        on = jumps.select("repo_url", F.col("sha").alias("chain"), F.col("chain").alias("next"), F.col("position").alias("more"))
        longer = materialized(
            jumps.join(on, ["repo_url", "chain"]).select(
                "repo_url", "sha", F.col("next").alias("chain"), (F.col("position") + F.col("more")).alias("position"),
                (F.col("more") > 0).alias("moved"),
            ),
            "jumps",
        )
        dropped(jumps)
        jumps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return jumps


def _with_shortcuts(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """``edges`` with links over 2, 4, 8, ... chains; deletes ``edges``.

    Whatever place of a chain is reached, its last one is, so a link from there
    holds for any mark.  Followed from chain to chain, such links are doubled as
    the places in a chain are: log2 of the number of chains rounds, over one row per chain.
    """
    last = placed.groupBy("repo_url", "chain").agg(F.max("position").alias("position"))
    levels = [materialized(
        edges.join(last, ["repo_url", "chain", "position"])
        .groupBy("repo_url", "chain", "position").agg(F.min(F.struct("to", "at")).alias("exit"))
        .select("repo_url", "chain", "position", "exit.to", "exit.at"),
        "chain-exits",
    )]
    # No path is longer than there are chains with an exit.
    longest = levels[0].count()
    while 1 << len(levels) <= longest:
        on = levels[-1].select("repo_url", F.col("chain").alias("to"), F.col("to").alias("next"), F.col("at").alias("enters"))
        levels.append(materialized(
            levels[-1].join(on, ["repo_url", "to"]).select(
                "repo_url", "chain", "position", F.col("next").alias("to"), F.col("enters").alias("at")
            ),
            "chain-exits",
        ))
        if levels[-1].isEmpty():
            break
    out = materialized(reduce(DataFrame.unionByName, levels[1:], edges), "chain-edges")
    for table in (edges, *levels):
        dropped(table)
    return out


def ancestors_of_heads(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds ``on_head``: reachable from the head of the repository.

    What is reached of a chain is all of it from some place on, so one mark per
    chain holds the state: the first place that is reached.  Links from one chain to another
    are joined with the marks that lie before them; a round is one join and one
    minimum per chain, and a history of two lines that merge into each other any
    number of times is done in a few rounds.  Links that leave the ends of chains are also followed
    in doubled steps, so a history that is cut into many chains one after the other, by branches
    that took its commits, needs the logarithm of their number.  Rounds are written to the shared
    folder and deleted again.  ``commits``: repo_url, sha, parents (a missing parent is ignored);
    ``heads``: repo_url, sha.
    """
    placed = chains(commits)
    links = commits.select("repo_url", "sha", F.explode("parents").alias("parent"))
    to = placed.select("repo_url", F.col("sha").alias("parent"), F.col("chain").alias("to"), F.col("position").alias("at"))
    edges = materialized(
        links.join(placed, ["repo_url", "sha"]).join(to, ["repo_url", "parent"])
        .where(F.col("chain") != F.col("to"))
        .groupBy("repo_url", "chain", "position", "to").agg(F.min("at").alias("at")),
        "chain-edges",
    )
    edges = _with_shortcuts(edges, placed)
    marks = materialized(
        heads.join(placed, ["repo_url", "sha"]).groupBy("repo_url", "chain").agg(F.min("position").alias("mark")), "marks"
    )
    fresh = marks
    while True:
        # Only marks that moved in the last round can move others.
        from_marks = fresh.select("repo_url", "chain", "mark")
        offered = (
            edges.join(from_marks, ["repo_url", "chain"]).where(F.col("position") >= F.col("mark"))
            .groupBy("repo_url", F.col("to").alias("chain")).agg(F.min("at").alias("offer"))
        )
        moved = materialized(
            offered.join(marks, ["repo_url", "chain"], "left")
            .where(F.col("mark").isNull() | (F.col("offer") < F.col("mark")))
            .select("repo_url", "chain", F.col("offer").alias("mark")),
            "moved-marks",
        )
        if moved.isEmpty():
            break
        merged = materialized(
            marks.unionByName(moved).groupBy("repo_url", "chain").agg(F.min("mark").alias("mark")), "marks"
        )
        if fresh is not marks:
            dropped(fresh)
        dropped(marks)
        marks, fresh = merged, moved
    for table in (moved, edges, *([] if fresh is marks else [fresh])):
        dropped(table)
    on_head = placed.join(marks, ["repo_url", "chain"]).where(F.col("position") >= F.col("mark")).select(
        "repo_url", "sha", F.lit(True).alias("on_head")
    )
    return commits.drop("on_head").join(on_head, ["repo_url", "sha"], "left").fillna({"on_head": False})
