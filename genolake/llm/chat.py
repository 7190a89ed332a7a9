"""Chat formatting: reply trees become conversations, one for each root-to-leaf path, ranked by score.

The template writes a turn as <|role|> followed by its text and <|end|>; roles and texts are escaped, so no text
can hold a mark, and a formatted conversation is read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint

#: Escapes: the sign that opens marks, then other signs by which common chat templates control a model.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"), ("]", "~4"), (">", "~5"))
TURN, BODY, END = "<|", "|>", "<|end|>"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def format_turns(turns: Column) -> Column:
    """An array of (role, text) as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(BODY), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END))), "")


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text, start and length of the escaped text in the formatted string) of a formatted conversation."""
    raw = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    pieces = F.transform(raw, lambda x: F.struct(F.substring_index(F.substring(x, 3, 1 << 30), BODY, 1).alias("role"), x.alias("raw")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,text:string,start:int,length:int>>").alias("turns"))

    def step(acc: Column, x: Column) -> Column:
        head = F.char_length(x["role"]) + len(TURN) + len(BODY)
        body = F.substring(x["raw"], head + 1, F.char_length(x["raw"]) - head)
        turn = F.struct(unescape(x["role"]).alias("role"), unescape(body).alias("text"), (acc["at"] + head).alias("start"), F.char_length(body).alias("length"))
        return F.struct((acc["at"] + F.char_length(x["raw"]) + len(END)).alias("at"), F.concat(acc["turns"], F.array(turn)).alias("turns"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["turns"])


def _match(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (tree, leaf, path_score, n_nodes), and for each k a table (tree, node, above): the node 2^k steps up.

    Each round joins the last table with itself, so a chain of n nodes takes log2(n) rounds of at most a row a node;
    scores and counts are summed up on the way. What lies below a cycle never ends and is told by a way as long as its tree.
    """
    own = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    own = own.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("x")).select("tree", "node", "x.*")
    own = checkpoint(own)
    known = own.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    here = _match(F.col("tree"), F.col("t"))
    up = own.join(known, here & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("above"), "score", F.lit(1).cast("long").alias("steps"))
    done, going = checkpoint(up.where("above IS NULL")), checkpoint(up.where("above IS NOT NULL"))
    largest = own.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    tables = []
    while going.limit(1).count() and 1 << len(tables) < largest:
        tables.append(going.select("tree", "node", "above"))
        step = done.unionByName(going).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("next"), F.col("score").alias("more"), F.col("steps").alias("further"))
        met = going.join(step, here & (F.col("above") == F.col("n")))  # only ways that don't end yet are joined again
        met = checkpoint(met.select("tree", "node", F.col("next").alias("above"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("further")).alias("steps")))
        done, going = done.unionByName(met.where("above IS NULL")), met.where("above IS NOT NULL")
    parents = (tables[0] if tables else going).select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = done.join(parents, here & (F.col("node") == F.col("n")), "left_anti")
    return leaves.select("tree", F.col("node").alias("leaf"), F.col("score").alias("path_score"), F.col("steps").alias("n_nodes")), tables


def _ranked(leaves: DataFrame) -> DataFrame:
    """Add rank: the place of a leaf in its tree by descending score, ties by the leaf.

    Leaves are dealt out by ranges of this order and counted from the ranges before, so a large tree is not one task.
    """
    order = [F.desc("path_score"), F.col("leaf")]
    dealt = checkpoint(leaves.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("tree", "part").count()
    before = before.withColumn("before", F.sum("count").over(W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("tree").alias("t"), F.col("part").alias("p"), "before")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("part", "tree").orderBy(*order)))
    met = ranked.join(before, _match(F.col("tree"), F.col("t")) & (F.col("part") == F.col("p")))
    return met.select("tree", "leaf", "path_score", "n_nodes", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"))


def _steps(leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """A row (tree, leaf, node, up) for each node on each leaf's path; up is its distance from the leaf.

    Distances are put together from powers of two, the largest first, so each comes up once and rows are what the paths hold.
    """
    steps = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    for k in range(len(tables) - 1, -1, -1):
        table = tables[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        further = steps.join(table, _match(F.col("tree"), F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        steps = checkpoint(steps.unionByName(further))
    return steps


def reply_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """All root-to-leaf paths of reply trees, or the best few of each tree.

    nodes: tree, node, parent (null for a root), and any score. Returns tree, leaf, path (nodes, root first),
    n_nodes, and path_score (sum of the scores, null counts 0) with rank in the tree (ties: by the leaf).
    A row with a null node is no node and is left out; a node whose parent is missing is a root; nodes on a cycle, or
    below one, hang on no root and are in no path; of repeated rows of a node the least counts; a null tree is a tree of
    its own. Other columns are ignored. A chain of any length takes log2 rounds; only a path itself must fit one row.
    An empty table gives no paths.
    """
    leaves, tables = _ancestors(nodes)
    leaves = _ranked(leaves)
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    leaves = checkpoint(leaves)
    paths = _steps(leaves, tables).groupBy(F.col("tree").alias("t"), F.col("leaf").alias("l")).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("up", "node"))), lambda x: x["node"])).alias("path"))
    met = leaves.join(paths, _match(F.col("tree"), F.col("t")) & (F.col("leaf") == F.col("l")))
    return met.select("tree", "leaf", "path", F.col("n_nodes").cast("int").alias("n_nodes"), "path_score", "rank")


def format_trees(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """Each path (or the best few of a tree) as one conversation: tree, leaf, rank, path_score, formatted.

    nodes also holds role and text; null texts and roles are empty. Cases as in reply_paths(). A path's texts must fit
    one row; paths of one tree are rows of their own.
    """
    leaves, tables = _ancestors(nodes)
    leaves = _ranked(leaves)
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    leaves = checkpoint(leaves)
    words = nodes.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("x"))
    words = words.select(F.col("tree").alias("t"), F.col("node").alias("m"), "x.role", "x.text")
    told = _steps(leaves, tables).join(words, _match(F.col("tree"), F.col("t")) & (F.col("node") == F.col("m")))
    turns = told.groupBy(F.col("tree").alias("a"), F.col("leaf").alias("b")).agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    met = leaves.join(turns, _match(F.col("tree"), F.col("a")) & (F.col("leaf") == F.col("b")))
    return met.select("tree", "leaf", "rank", "path_score", format_turns(F.col("turns")).alias("formatted"))


def loss_mask(formatted: Column) -> Column:
    """Spans (start, length) of the formatted string under the loss: the escaped texts of assistant turns."""
    return F.transform(F.filter(parse_turns(formatted), lambda t: t["role"].isin(*LOSS_ROLES)), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))


def as_tree(conversations: DataFrame) -> DataFrame:
    """Plain conversations as chains: each row replies to the row before it (by turn, then role and text).

    A conversation of a null id is one of its own; repeated rows stay separate turns.
    """
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = conversations.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], given.schema)
    formatted = format_trees(as_tree(given.unionByName(added))).select("tree", "formatted")
    formatted = checkpoint(formatted)  # what follows is read from the formatted text alone
    read = formatted.select("tree", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_mask(F.col("formatted")).alias("mask"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
