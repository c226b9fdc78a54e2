"""Comparison strategies: frequent attributes, attribute affinity, and learned hash partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.agent import Agent, Settings

GROUPS = 3
SUPPORT = 0.5
PARTS = 3


def frequent_attributes(used: DataFrame, freq: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(column_name, support) of where columns by weighted share of the queries; used: (query_id, column_name)."""
    total = freq.agg(F.sum("freq").alias("total"))
    per = used.distinct().join(freq, "query_id").groupBy("column_name").agg(F.sum("freq").alias("w"))
    return per.join(F.broadcast(total)).select("column_name", (F.col("w") / F.col("total")).alias("support")).where(F.col("support") >= support)


def frequent_itemsets(used: DataFrame, freq: DataFrame, support: float = SUPPORT, scale: int = 100) -> DataFrame:
    """(items, freq): sets of where columns in at least `support` of the transactions, where each query stands for
    floor(freq * scale) transactions; FP-growth over the cluster."""
    baskets = used.distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("column_name")).alias("items")).join(freq, "query_id")
    copies = baskets.select(F.explode(F.expr(f"sequence(1, greatest(1, CAST(floor(freq * {scale}) AS INT)))")).alias("copy"), "items")
    return FPGrowth(itemsCol="items", minSupport=support).fit(copies).freqItemsets


def hash_attributes(used: DataFrame, freq: DataFrame, support: float = SUPPORT) -> list[str]:
    """The itemset with most support, then with most items, then first by name."""
    sets = [(r.freq, len(r["items"]), sorted(r["items"])) for r in frequent_itemsets(used, freq, support).collect()]  # few: sets of one table's columns
    return min(sets, key=lambda s: (-s[0], -s[1], s[2]))[2] if sets else []


def usage(select: DataFrame, where: DataFrame, freq: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, c, p) for every query and column: 0 if unused, the frequency if used, 1 if selected and filtered."""
    marks = select.withColumn("s", F.lit(1)).unionByName(where.withColumn("s", F.lit(2))).groupBy("query_id", "c").agg(F.bit_or("s").alias("s"))
    every = freq.join(columns.select("c"), how="cross")
    p = F.when(F.col("s") == 3, F.lit(1.0)).when(F.col("s").isNotNull(), F.col("freq")).otherwise(F.lit(0.0))
    return every.join(marks, ["query_id", "c"], "left").select("query_id", "c", "freq", p.alias("p"))


def affinity(used: DataFrame) -> DataFrame:
    """(i, j, aff): frequency-weighted mean of (p_i + p_j) / 2 over the larger of the two, summed over the queries."""
    a = used.select("query_id", F.col("c").alias("i"), F.col("p").alias("pi"), "freq")
    b = used.select("query_id", F.col("c").alias("j"), F.col("p").alias("pj"))
    top = F.greatest("pi", "pj")
    part = F.when(top > 0, F.col("freq") * (F.col("pi") + F.col("pj")) / 2 / top).otherwise(0.0)
    return a.join(b, "query_id").groupBy("i", "j").agg(F.sum(part).alias("aff"))


def affinity_groups(matrix: np.ndarray, groups: int = GROUPS) -> list[int]:
    """Average-linkage clustering of columns by distance max - affinity; group numbers in order of first column."""
    distance = matrix.max() - matrix
    members = [[i] for i in range(len(matrix))]
    while len(members) > groups:
        pairs = [(float(np.mean(distance[np.ix_(a, b)])), i, j) for i, a in enumerate(members) for j, b in enumerate(members) if i < j]
        _, i, j = min(pairs)
        members[i] += members.pop(j)
    members.sort(key=min)
    out = [0] * len(matrix)
    for g, m in enumerate(members):
        for c in m:
            out[c] = g
    return out


def column_blocks(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, col_block): the columns of all groups that a query's columns touch."""
    hit = targets.join(groups, "c").select("query_id", "grp").distinct()
    return hit.join(groups, "grp").groupBy("query_id").agg(F.sort_array(F.collect_set("c")).alias("col_block"))


class HashEnvironment:
    """Choosing the attributes that a table is hashed by: each step adds an attribute or ends."""

    def __init__(self, blocks_by_key: dict[int, dict[str, frozenset[int]]], freq: dict[str, float], size_mb: float, n_columns: int, blocks: int = 10, parts: int = PARTS):
        self.loc, self.freq, self.size, self.n, self.blocks, self.parts = blocks_by_key, freq, size_mb, n_columns, blocks, parts

    def cost(self, chosen: Sequence[int]) -> float:
        """Partitions read under the chosen attributes: block i is in partition i mod parts, and with several
        attributes a query reads the fewest that any of them allows."""
        if not chosen:
            return sum(self.freq.values()) * self.size
        total = 0.0
        for q, f in self.freq.items():
            reads = []
            for c in chosen:
                hit = {b % self.parts for b in self.loc.get(c, {}).get(q, range(1, self.blocks + 1))}
                reads.append(sum(b % self.parts in hit for b in range(1, self.blocks + 1)))
            total += f * self.size * min(reads) / self.blocks
        return total

    def state(self, chosen: Sequence[int]) -> np.ndarray:
        return np.concatenate([[float(c in chosen) for c in range(self.n)], [self.freq[q] for q in sorted(self.freq)]])

    def encode(self, action: int | None) -> np.ndarray:
        return np.array([float(action == c) for c in range(self.n)])

    def options(self, chosen: Sequence[int]) -> list[int | None]:
        return [c for c in range(self.n) if c not in chosen] + ([None] if chosen else [])


def train_hash(env: HashEnvironment, settings: Settings = Settings(episodes=60), most: int = 3) -> tuple[list[int], float]:
    """Attributes found by Q-learning and their cost; the best episode counts."""
    agent = Agent(env.n + len(env.freq), env.n, env.encode, settings, settings.seed)
    best: tuple[float, list[int]] = (env.cost([]), [])
    for _ in range(settings.episodes):
        chosen: list[int] = []
        for step in range(most):
            before, options = env.state(chosen), env.options(chosen)
            action = agent.choose(before, options)
            was = env.cost(chosen)
            if action is not None:
                chosen = [*chosen, action]
            now = env.cost(chosen)
            over = action is None or step == most - 1
            agent.store(before, action, was / now - 1 if now else 0.0, env.state(chosen), [] if over else env.options(chosen))
            agent.learn()
            if over:
                break
        best = min(best, (env.cost(chosen), sorted(chosen)))
    return best[1], best[0]
