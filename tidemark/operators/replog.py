"""Analytics over a replicated log: quorum, commit index, lag, contiguity, applied state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.operators import resolve

BATCH_ENTRIES = 1_024


def quorum(nodes: Column) -> Column:
    return F.floor(nodes / 2) + 1


def commit_index(match: DataFrame, entries: DataFrame, group: str = "group") -> DataFrame:
    """(group, commit_index): the highest index of the current term that a quorum has; where there is none, the commit index so far.

    `match` has a row a node (match_index; the leader's own included), `entries` index and term, and current_term and committed
    repeat on them. The quorum-th largest match bounds it, so one pass over the nodes and one over the entries do.
    """
    held = match.groupBy(group).agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))
    bound = held.select(group, F.element_at("m", quorum(F.size("m")).cast("int")).alias("bound"))
    return entries.join(bound, group).groupBy(group).agg(
        F.greatest(F.max("committed"), F.max(F.when((F.col("index") <= F.col("bound")) & (F.col("term") == F.col("current_term")), F.col("index")))).alias("commit_index")
    )


def as_fresh(term: str, index: str, other_term: str, other_index: str) -> Column:
    """Whether a log's end is at least as new as another's: term first, then index."""
    return (F.col(term) > F.col(other_term)) | ((F.col(term) == F.col(other_term)) & (F.col(index) >= F.col(other_index)))


def lag(match: DataFrame) -> DataFrame:
    return match.withColumn("lag", F.greatest(F.lit(0), F.col("commit_index") - F.col("match_index")))


def breaks(entries: DataFrame, log: str = "log") -> DataFrame:
    """(log, index, before) where an index does not follow the one before."""
    w = Window.partitionBy(log).orderBy("index")
    return entries.withColumn("before", F.lag("index").over(w)).filter(F.col("index") != F.col("before") + 1).select(log, "index", "before")


def reconcile(local: DataFrame, incoming: DataFrame, log: str = "log") -> DataFrame:
    """The log after new entries arrived: from the first index where terms differ local entries go, then the new ones are added."""
    pair = local.alias("l").join(incoming.alias("n"), (F.col(f"l.{log}") == F.col(f"n.{log}")) & (F.col("l.index") == F.col("n.index")))
    cut = pair.filter(F.col("l.term") != F.col("n.term")).groupBy(F.col(f"l.{log}").alias(log)).agg(F.min("l.index").alias("cut"))
    kept = local.join(cut, log, "left").filter(F.col("cut").isNull() | (F.col("index") < F.col("cut"))).drop("cut")
    new = incoming.join(kept.select(log, "index"), [log, "index"], "left_anti").select(*local.columns)
    return kept.unionByName(new)


def applied(entries: DataFrame, committed: int) -> DataFrame:
    """Live state after the committed entries (index, type, ops): batches in order, no-ops and configurations ignored."""
    ops = entries.filter((F.col("index") <= committed) & F.col("type").isin("put", "delete", "batch")).select("index", F.posexplode("ops").alias("pos", "o"))
    return resolve.live(ops.select(F.col("o.key").alias("key"), (F.col("index") * S.MAX_BATCH_OPS + F.col("pos")).alias("seq"), F.col("o.op").alias("op"), F.col("o.value").alias("value")))


def read_barrier(reads: DataFrame, applies: DataFrame, group: str = "group") -> DataFrame:
    """`reads` (group, read_id, ts, read_index) with allowed: the last entry applied until then reached the index.

    An as-of join as one window over both sides: each read sees the largest applied index at or before its time.
    """
    both = reads.select(group, "ts", F.lit(1).alias("side"), "read_id", "read_index", F.lit(None).cast("long").alias("applied_index")).unionByName(
        applies.select(group, "ts", F.lit(0).alias("side"), F.lit(None).cast("long").alias("read_id"), F.lit(None).cast("long").alias("read_index"), "applied_index")
    )
    w = Window.partitionBy(group).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("reached", F.max("applied_index").over(w)).filter("side = 1")
    return seen.select(group, "read_id", "reached", (F.coalesce("reached", F.lit(0)) >= F.col("read_index")).alias("allowed"))


def route(role: str = "role", write: str = "is_write") -> Column:
    return F.when(F.col(role) == "leader", "execute").when(F.col(role) == "follower", "redirect").otherwise("unavailable")


def redirect(leader: str = "leader_id", address: str = "address") -> Column:
    return F.format_string("not leader: leader is node %d at %s", leader, address)


def parse_redirect(message: str = "message") -> list[Column]:
    """(leader_id, address), null where the text has another form or holds control characters."""
    form = r"^not leader: leader is node ([0-9]{1,18}) at (.*\S.*)$"
    ok = ~F.col(message).rlike(r"[\x00-\x1F\x7F]") & F.col(message).rlike(form)
    return [F.when(ok, F.regexp_extract(message, form, 1).cast("long")).alias("leader_id"), F.when(ok, F.trim(F.regexp_extract(message, form, 2))).alias("address")]


def votes(requests: DataFrame) -> DataFrame:
    """(voter, term, candidate): the first fresh enough candidate that asked in a term gets the voter's one vote."""
    fresh = requests.filter(as_fresh("last_term", "last_index", "voter_term", "voter_index"))
    return fresh.groupBy("voter", "term").agg(F.min_by("candidate", F.struct("pos", "candidate")).alias("candidate"))


def replication_batch(entries: DataFrame, peers: DataFrame, most_bytes: int, log: str = "log") -> DataFrame:
    """(peer, index): entries each peer (log, peer, next_index) is sent next, bounded in number and bytes, the first always."""
    due = entries.join(peers, log).filter((F.col("index") >= F.col("next_index")) & (F.col("index") < F.col("next_index") + BATCH_ENTRIES))
    w = Window.partitionBy(log, "peer").orderBy("index")
    sized = due.withColumn("n", F.row_number().over(w)).withColumn("bytes", F.sum("size").over(w))
    return sized.filter((F.col("n") == 1) | (F.col("bytes") <= most_bytes)).select(log, "peer", "index")


def topology_problems(nodes: DataFrame, self_id: int, most: int = 256) -> DataFrame:
    """(problem, value) of a node list (node_id, address): repeated ids or addresses, self missing, too many nodes."""
    ids = nodes.groupBy("node_id").count().filter("count > 1").select(F.lit("repeated id").alias("problem"), F.col("node_id").cast("string").alias("value"))
    where = nodes.groupBy(F.lower("address").alias("a")).count().filter("count > 1").select(F.lit("repeated address").alias("problem"), F.col("a").alias("value"))
    whole = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node_id") == self_id).alias("me"))
    rest = whole.select(F.explode(F.array_compact(F.array(F.when(F.col("me") == 0, "self missing"), F.when(F.col("n") > most, "too many nodes")))).alias("problem"), F.lit(None).cast("string").alias("value"))
    return ids.unionByName(where).unionByName(rest)
