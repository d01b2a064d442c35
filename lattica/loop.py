"""The round loop: frontier joins edges, messages combine, state takes them, until nobody is active.

A round is one written table. Edges are dealt by source once and kept (on disk if
memory is short); state is written in buckets by vertex, as many as edges have
partitions. So senders meet their edges, and vertices their messages, where they lie: the
one exchange of a round is that of the combined messages, pre-aggregated before they
move. Vertices with more out-edges than a partition should have (fewer of them than
partitions) are hubs: their edges are dealt evenly and get the hubs' values by
broadcast. The counts that steer the loop are observed by the tasks that write
the state, so a round is one job.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions.segments import segment_bytes
from .operators.build import Graph
from .program import VertexProgram
from .schema import ROUNDS, UNREACHED
from .storage import exists, new_path, partitions, remove, save_dealt

#: A vertex with fewer out-edges is never a hub.
HUB_EDGES = 1_000_000


@dataclass
class Run:
    """Final state (v, val, active), and what each round did."""

    state: DataFrame
    rounds: list[tuple] = field(default_factory=list)

    def values(self, sentinel: bool = True) -> DataFrame:
        """v, val; vertices never reached have UNREACHED (or null)."""
        val = F.coalesce("val", F.lit(UNREACHED)) if sentinel and dict(self.state.dtypes)["val"] == "bigint" else F.col("val")
        return self.state.select("v", val.alias("val"))

    def metrics(self) -> DataFrame:
        """One row a round; message_bytes by the cost model, the combined messages as one segment of all vertices."""
        log = self.state.sparkSession.createDataFrame(self.rounds, ROUNDS)
        return log.withColumn("message_bytes", segment_bytes(F.col("messages"), F.col("vertices")))


def superstep(state: DataFrame, edges: DataFrame, program: VertexProgram, mode: str, round_: int = 1, last: bool = False, hubs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One round: state (v, val, active, deg) to the next state.

    push sends from active vertices only; pull looks at all sources and masks the
    messages of those that aren't active. The results are equal. hubs: their ids
    (src, bounded by the number of partitions) and their edges, which ``edges`` then lacks.
    """
    return _next(state, edges, program, mode, round_, last, hubs).drop("msg")


def _next(state, edges, program, mode, round_, last, hubs=None) -> DataFrame:
    def sent(edges: DataFrame, senders: DataFrame) -> DataFrame:
        if "w" not in edges.columns:
            edges = edges.withColumn("w", F.lit(None).cast("long"))
        return edges.join(senders, "src").select(F.col("dst").alias("v"), message.alias("msg"))

    if mode == "push":
        senders = state.where("active").select(F.col("v").alias("src"), "val")
        message = program.message(F.col("val"), F.col("w"))
    else:
        senders = state.select(F.col("v").alias("src"), "val", "active")
        message = F.when(F.col("active"), program.message(F.col("val"), F.col("w")))
    messages = sent(edges, senders)
    if hubs is not None:
        messages = messages.unionByName(sent(hubs[1], F.broadcast(senders.join(F.broadcast(hubs[0]), "src"))))
    combined = messages.groupBy("v").agg(program.combined(F.col("msg")).alias("msg"))
    joined = state.join(combined, "v", "left")
    old, msg = F.col("val"), F.col("msg")
    new = program.apply(old, msg, F.col("deg"), round_, last)
    if not program.everywhere:
        new = F.when(msg.isNotNull(), new).otherwise(old)
    return joined.withColumn("new", new).select("v", F.col("new").alias("val"), program.activate(old, F.col("new")).alias("active"), "deg", "msg")


def initial(graph: Graph, program: VertexProgram) -> DataFrame:
    val, active = program.init(F.col("v"), F.col("out_degree"))
    return graph.vertices.select("v", val.alias("val"), F.coalesce(active, F.lit(False)).alias("active"), F.col("out_degree").alias("deg"))


def run(graph: Graph, program: VertexProgram, direction: str = "auto", max_rounds: int | None = None, path: str | None = None, resume: bool = False) -> Run:
    """Runs a program. With ``path`` each round stays there and ``resume`` goes on after the last one written."""
    spark = graph.edges.sparkSession
    keep = path is not None
    where = path or new_path(spark, program.name)
    limit = program.rounds if program.rounds is not None else max_rounds
    done, log = _resumed(spark, where) if resume else (0, [])
    if done or (resume and exists(spark, f"{where}/round=0/_SUCCESS")):
        state = spark.read.parquet(f"{where}/round={done}")
        seen = state.agg(*_counts(F.lit(None))).first().asDict()
    else:
        start = initial(graph, program).withColumn("msg", F.lit(None).cast("long"))
        state, seen = _observed(start.repartition(partitions(spark), "v"), f"{where}/round=0")
    edges, hubs = _dealt(graph.edges, state, seen)
    total = seen["all"] or 0
    try:
        while (limit is None or done < limit) and (program.rounds is not None or seen["n"]):
            began = time.time()
            mode = direction if direction != "auto" else "push" if seen["e"] < total // 20 else "pull"
            last = limit is not None and done + 1 == limit
            before = seen
            state, seen = _observed(_next(state, edges, program, mode, done + 1, last, hubs), f"{where}/round={done + 1}")
            done += 1
            log.append((done, before["n"], before["e"], seen["n"], mode, time.time() - began, seen["m"], seen["v"]))
            if keep:
                spark.createDataFrame([(json.dumps(log),)], "log string").coalesce(1).write.mode("overwrite").text(f"{where}/log={done}")
            if done > 1 and not keep:
                remove(spark, f"{where}/round={done - 2}")
        return Run(state, log)
    finally:
        edges.unpersist()
        if hubs is not None:
            hubs[1].unpersist()


def _dealt(edges: DataFrame, state: DataFrame, seen: dict) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """Edges dealt by source and kept; of vertices with more out-edges than a partition's share apart, dealt evenly."""
    n = partitions(edges.sparkSession)
    share = max((seen["all"] or 0) // n, HUB_EDGES)
    hubs = None
    if (seen["top"] or 0) > share:
        # fewer than n vertices have more than an n-th of all edges
        ids = edges.sparkSession.createDataFrame(state.where(F.col("deg") > share).select(F.col("v").alias("src")).collect(), "src long")
        own = edges.join(F.broadcast(ids), "src").repartition(n).persist(StorageLevel.MEMORY_AND_DISK)
        hubs, edges = (ids, own), edges.join(F.broadcast(ids), "src", "left_anti")
    return edges.repartition(n, "src").persist(StorageLevel.MEMORY_AND_DISK), hubs


def _counts(msg) -> tuple:
    """Active vertices and their out-edges, messages, vertices, all out-edges, most of a vertex."""
    return F.count_if(F.col("active")).alias("n"), F.coalesce(F.sum(F.when(F.col("active"), F.col("deg"))), F.lit(0)).alias("e"), F.count(msg).alias("m"), F.count("*").alias("v"), F.sum("deg").alias("all"), F.max("deg").alias("top")


def _observed(state: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Writes a state and counts what _counts names on the way."""
    seen = Observation()
    out = save_dealt(state.observe(seen, *_counts(F.col("msg"))).drop("msg"), path, "v")
    return out, seen.get


def _resumed(spark, where: str) -> tuple[int, list]:
    """The last round of which state and log are whole."""
    done = 0
    while exists(spark, f"{where}/round={done + 1}/_SUCCESS") and exists(spark, f"{where}/log={done + 1}/_SUCCESS"):
        done += 1
    log = json.loads("".join(r.value for r in spark.read.text(f"{where}/log={done}").collect())) if done else []
    return done, [tuple(x) for x in log]
