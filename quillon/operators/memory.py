"""Semantic cache and answer memory as tables: scoped look-up, storage with eviction, embedding cache.

Time is a parameter everywhere. Tables are never updated in place: each step returns the next version.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..staging import stream_groups
from .relational import evict_oldest

SCOPE = ["user_id", "kb_id", "doc_scope", "style"]
CACHE_POOL, CACHE_LIMIT, CACHE_CAP = 200, 0.92, 500
MEMORY_POOL, MEMORY_LIMIT, MEMORY_CAP = 100, 0.93, 300


def subjects_match(a: Column, b: Column) -> Column:
    """Equal or one in the other; a missing subject matches any."""
    none = lambda x: x.isNull() | (x == "")
    return none(a) | none(b) | a.contains(b) | b.contains(a)


def alive(updated_at: Column, now: Column, ttl_seconds: int) -> Column:
    """Not expired; a time to live of 0 never expires."""
    return F.lit(True) if ttl_seconds <= 0 else F.coalesce(F.unix_micros(updated_at.cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - ttl_seconds * 1_000_000, F.lit(True))


def in_scope(entries: DataFrame, asked: DataFrame, pool: int) -> DataFrame:
    """Asked rows with the newest ``pool`` entries of exactly their scope; a null matches only a null."""
    place = F.row_number().over(W.partitionBy(*SCOPE).orderBy(F.desc("updated_at"), F.desc("id")))
    newest = entries.withColumn("place", place).filter(F.col("place") <= pool).drop("place")
    e, a = newest.alias("e"), asked.alias("a")
    on = F.lit(True)
    for k in SCOPE:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"e.{k}"))
    return a.join(e, on).withColumn("sim", F.round(cosine(F.col("a.vector"), F.col("e.vector")), 6))


def find_cached(cache: DataFrame, asked: DataFrame, now: Column, ttl_seconds: int = 0, limit: float = CACHE_LIMIT, pool: int = CACHE_POOL) -> DataFrame:
    """qid, id, answer, sim: the single most similar live entry of the scope, if it is similar enough and of the same
    subject. A second-best entry never stands in for it."""
    near = in_scope(cache, asked, pool).filter(alive(F.col("e.updated_at"), now, ttl_seconds))
    w = W.partitionBy("a.qid").orderBy(F.desc("sim"), F.desc("e.updated_at"), F.desc("e.id"))
    best = near.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.filter((F.col("sim") >= limit) & subjects_match(F.col("a.subject"), F.col("e.subject"))).select("a.qid", "e.id", "e.answer", "sim")


def recall(memories: DataFrame, asked: DataFrame, limit: float = MEMORY_LIMIT, pool: int = MEMORY_POOL) -> DataFrame:
    """qid, id, status, answer, sim, force_rerank: of all similar entries of the same subject, bad ones before good, then
    the most similar."""
    near = in_scope(memories, asked, pool).filter((F.col("sim") >= limit) & subjects_match(F.col("a.subject"), F.col("e.subject")))
    w = W.partitionBy("a.qid").orderBy((F.col("e.status") != "bad").cast("int"), F.desc("sim"), F.desc("e.updated_at"), F.desc("e.id"))
    best = near.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.select("a.qid", "e.id", "e.status", "e.answer", "sim", (F.col("e.status") == "bad").alias("force_rerank"))


def touched(entries: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Entries with hit_count and updated_at moved on for those that were hit."""
    n = hits.groupBy("id").agg(F.count("*").alias("n"))
    out = entries.join(n, "id", "left")
    return out.withColumns({"hit_count": F.col("hit_count") + F.coalesce("n", F.lit(0)), "updated_at": F.when(F.col("n").isNotNull(), now).otherwise(F.col("updated_at"))}).drop("n")


def store_cached(cache: DataFrame, fresh: DataFrame, now: Column, ttl_seconds: int = 0, cap: int = CACHE_CAP) -> DataFrame:
    """The cache without expired entries and, in scopes (user, knowledge base) at their cap, without the oldest fifth; then
    the fresh entries."""
    kept = evict_oldest(cache.filter(alive(F.col("updated_at"), now, ttl_seconds)), ["user_id", "kb_id"], cap)
    return kept.unionByName(fresh)


def remember(memories: DataFrame, fresh: DataFrame, limit: float = MEMORY_LIMIT, pool: int = MEMORY_POOL, cap: int = MEMORY_CAP) -> DataFrame:
    """Memories after storing the fresh entries one by one, oldest first, so that later entries of a batch meet earlier ones.

    The newest similar entry among the newest ``pool`` of the same scope is replaced, and its hits are kept if its status is the
    same. An entry that replaces none of its status, in a (user, knowledge base) at its cap, first sends the oldest fifth of
    the cap away. Entries without an answer are not stored; vectors of another length are never similar; ties in time
    follow the id, status and answer.

    A (user, knowledge base) is one task's stream, which holds its memories: at most ``cap`` of them once they were stored by this
    function."""
    place, kill = itemgetter("doc_scope", "style"), max(1, int(cap * 0.2))

    def alike(new: dict, vector: np.ndarray, held: list) -> int | None:
        """Position of the newest held entry that the new one repeats."""
        near = list(islice((i for i in range(len(held) - 1, -1, -1) if place(held[i][1]) == place(new)), pool))
        near = [i for i in near if held[i][2].shape == vector.shape]
        if not near:
            return None
        sims = np.round(np.stack([held[i][2] for i in near]) @ vector, 6)
        return next((i for i, sim in zip(near, sims, strict=True) if sim >= limit and _same_subject(new["subject"], held[i][1]["subject"])), None)

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        held: list[tuple] = []  # (order, row, unit vector), oldest first
        for row in rows:
            vector = _unit(row["vector"])
            if row.pop("_fresh"):
                at = alike(row, vector, held)
                old = held.pop(at)[1] if at is not None else None
                if old is not None and old["status"] == row["status"]:
                    row["hit_count"] = old["hit_count"]
                elif len(held) >= cap:
                    del held[:kill]
            insort(held, ([(v is not None, v) for v in (row.pop("_at"), row["id"])], row, vector), key=itemgetter(0))
        return (tuple(row.values()) for _, row, _ in held)

    told = fresh.filter("answer IS NOT NULL AND answer <> ''").select(*memories.columns)
    both = memories.withColumn("_fresh", F.lit(False)).unionByName(told.withColumn("_fresh", F.lit(True)))
    timed = both.withColumn("_at", F.unix_micros(F.col("updated_at").cast("timestamp")))
    return stream_groups(timed, ["user_id", "kb_id"], ["_fresh", "_at", "id", "status", "answer"], fold, both.drop("_fresh").schema)


def _unit(vector: list[float] | None) -> np.ndarray:
    v = np.asarray(vector or [], dtype=np.float64)
    size = np.sqrt(v @ v)
    return v / size if size else np.zeros_like(v)


def _same_subject(a: str | None, b: str | None) -> bool:
    """``subjects_match`` of two values."""
    return not a or not b or a in b or b in a


def embed_missing(chunks: DataFrame, cache: DataFrame, profile: Column, embed) -> tuple[DataFrame, DataFrame]:
    """(chunks with vector, cache with what was missing): each content hash is embedded once for a profile. ``embed`` makes
    a column of vectors from a column of texts."""
    own = cache.filter(F.col("profile") == profile).select("content_hash", "vector")
    lacking = chunks.join(own, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content"))
    made = lacking.select("content_hash", profile.alias("profile"), embed(F.col("content")).alias("vector"))
    full = cache.unionByName(made)
    return chunks.join(full.filter(F.col("profile") == profile).select("content_hash", "vector"), "content_hash"), full


def feedback_entries(messages: DataFrame) -> DataFrame:
    """Memory rows from rated answers: up is good, down is bad, anything else none. The question is the last user message
    before the answer."""
    w = W.partitionBy("conversation_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    asked = messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w))
    rated = asked.filter((F.col("role") == "assistant") & F.col("feedback").isin("up", "down") & F.col("question").isNotNull())
    return rated.select(F.col("id").alias("message_id"), "question", F.col("content").alias("answer"), F.when(F.col("feedback") == "up", "good").otherwise("bad").alias("status"))
