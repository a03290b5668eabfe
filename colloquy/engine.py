"""The engine as a user meets it: index transcript files, distil, search in every mode, list, view and delete, over one store of snapshots.

Every call builds DataFrame plans; only counts and single rows come to the driver. Results are DataFrames.
"""

from __future__ import annotations

import os
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import models
from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.operators import facets as FA
from colloquy.operators import listing as LI
from colloquy.operators import mutations as M
from colloquy.operators import queries_text as Q
from colloquy.operators import search as S
from colloquy.operators import segments as SG
from colloquy.sources import transcripts as TR
from colloquy.sources.store import Store

MODES = ("keyword", "semantic", "hybrid", "adaptive", "cross_layer", "distill", "hierarchical", "temporal")
SCHEMAS = {
    "conversations": "conversation_id string, project_id string, file_path string, title string, created_at timestamp, updated_at timestamp_ntz, message_count int, file_size bigint, mtime_ns bigint",
    "messages": "conversation_id string, sequence int, role string, content string, timestamp_us bigint, has_code boolean",
    "exchanges": "exchange_id string, conversation_id string, project_id string, ply_start int, ply_end int, exchange_text string, embedding array<float>",
    "objects": "object_id string, exchange_id string, conversation_id string, project_id string, ply_start int, ply_end int, exchange_core string, files array<string>, embedding array<float>, exchange_at timestamp_ntz",
    "rooms": "room_id string, room_type string, room_key string, project_id string, object_count bigint, updated_at timestamp_ntz",
    "room_objects": "room_id string, object_id string, exchange_at timestamp_ntz",
    "facets": "facet_id string, facet_type string, facet_level string, facet_text string, weight double, project_count int, weighted_count double, last_seen timestamp_ntz, project_ids array<string>, embedding array<float>",
    "file_state": "file_path string, conversation_id string, status string, file_size bigint, mtime_ns bigint, error_message string",
}
KEYS = {"conversations": ["conversation_id"], "messages": ["conversation_id", "sequence"], "exchanges": ["exchange_id"], "objects": ["object_id"], "rooms": ["room_id"], "room_objects": ["room_id", "object_id"], "facets": ["facet_id"], "file_state": ["file_path"]}
CACHED, FRESH_SECONDS = 100, 300


class Engine:
    def __init__(self, spark: SparkSession, root: str, embed: models.Embed | None = None, distil: Callable[[list[str]], list[str]] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.embed, self.distil = embed or models.hashed_embedding(), distil
        self.cache: OrderedDict = OrderedDict()
        missing = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n not in self.store.names()}
        if missing:
            self.store.commit(missing)

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    # indexing

    def index(self, paths: list[str], policy: str = "reject", exclude: bool = True) -> dict:
        """Indexes the new and changed ones of the files in one commit. Bad files are kept in file_state with their first issue and passed over until they change."""
        stats = {"new": 0, "updated": 0, "unchanged": 0, "excluded": 0, "invalid": 0, "examples": []}
        listing = self.spark.createDataFrame([(p, os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in paths], "file_path string, file_size bigint, mtime_ns bigint")
        change = M.changed_files(listing, self._t("file_state")).cache()
        by = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
        stats["unchanged"] = by.get("same", 0) + by.get("touched", 0) + by.get("backfill", 0)
        work = change.where("change in ('new', 'changed')").drop("change")
        todo = [r["file_path"] for r in work.select("file_path").toLocalIterator()]
        if not todo:
            return stats
        lines = TR.read_lines(self.spark, todo).withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/"))
        text = TR.checked(lines).cache()
        good = TR.accepted_files(text, policy)
        bad = text.where("size(issues) > 0").join(good, "file_path", "left_anti").groupBy("file_path").agg(F.min(F.struct("line_number", F.element_at("issues", 1).alias("m"))).alias("first"))
        bad = bad.select("file_path", F.concat(F.lit("line "), F.col("first.line_number").cast("string"), F.lit(": "), F.col("first.m")).alias("error_message"))
        msgs = TR.messages(text, policy)
        if exclude:
            auto = TR.internal_prompts(msgs, "file_path").unionAll(TR.single_turn(text)).distinct()
            stats["excluded"] = auto.count()
            msgs = msgs.join(auto, "file_path", "left_anti")
        stem = F.regexp_replace(T.basename(F.col("file_path")), r"\.jsonl?$", "")
        dialect = TR.dialect(F.col("file_path"), F.lit(None).cast("string"))
        msgs = msgs.withColumn("conversation_id", F.when(dialect == "B", F.concat(F.lit("codex-"), stem)).otherwise(stem)).cache()
        old = self._t("conversations")
        roll = TR.rollup(msgs, "conversation_id").join(msgs.groupBy("conversation_id").agg(F.min("file_path").alias("file_path")), "conversation_id").join(work, "file_path")
        conv = roll.select(
            "conversation_id", T.basename(T.parent(F.col("file_path"))).alias("project_id"), "file_path", "title", F.timestamp_micros("first_us").alias("created_at"), F.timestamp_micros("last_us").cast("timestamp_ntz").alias("updated_at"), F.col("message_count").cast("int").alias("message_count"), "file_size", "mtime_ns",
        )
        ids = conv.select("conversation_id")
        stats["updated"] = old.join(ids, "conversation_id", "left_semi").count()
        stats["new"] = conv.count() - stats["updated"]
        clean = msgs.select("conversation_id", "sequence", "role", "content")
        x = SG.exchange_texts(clean, SG.segments(clean)).join(conv.select("conversation_id", "project_id"), "conversation_id")
        x = models.embedded(x, "exchange_text", self.embed).select(*self._t("exchanges").columns)
        state = work.join(bad, "file_path", "left").select("file_path", stem.alias("conversation_id"), F.when(F.col("error_message").isNull(), "indexed").otherwise("invalid").alias("status"), "file_size", "mtime_ns", "error_message")
        fresh = {
            "conversations": M.upsert(old, conv, KEYS["conversations"], keep=("created_at",)),
            "messages": M.delete(self._t("messages"), ids, ["conversation_id"]).unionByName(msgs.select(*self._t("messages").columns)),
            "exchanges": M.delete(self._t("exchanges"), ids, ["conversation_id"]).unionByName(x),
            "file_state": M.upsert(self._t("file_state"), state, KEYS["file_state"]),
        }
        self.store.commit(fresh, KEYS)
        wrong = self._t("file_state").join(work.select("file_path"), "file_path", "left_semi").where("status = 'invalid'")
        stats["invalid"] = wrong.count()
        stats["examples"] = [f"{r['file_path']}: {r['error_message']}" for r in wrong.orderBy("file_path").limit(3).collect()]
        for df in (change, text, msgs):
            df.unpersist()
        return stats

    # distilling

    def distill(self) -> int:
        """Distils the exchanges that have no object yet, with their rooms and facets, in one commit; gives their number."""
        keys = ["conversation_id", "ply_start", "ply_end"]
        pending = self._t("exchanges").join(self._t("objects").select(*keys), keys, "left_anti")
        n = pending.count()
        if not n:
            return 0
        seen = self._t("conversations").select("conversation_id", F.col("updated_at").alias("exchange_at"))
        o = models.distilled(pending, "exchange_text", self.distil).withColumn("files", T.file_paths(F.col("exchange_text"))).drop("embedding")
        o = models.embedded(o, "exchange_core", self.embed).join(seen, "conversation_id", "left").withColumn("object_id", F.md5(F.concat_ws("|", F.lit("object"), "exchange_id")))
        objects = M.insert_absent(self._t("objects"), o.select(*self._t("objects").columns), ["object_id"])
        edges = objects.select("object_id", "project_id", "exchange_at", F.explode("files").alias("path"))
        lies = edges.select("object_id", "project_id", "exchange_at", T.parent(F.col("path")).alias("room_key")).where("room_key != ''").distinct().withColumn("room_id", T.room_id(F.lit("file"), F.col("room_key"), F.col("project_id")))
        rooms = lies.groupBy("room_id").agg(F.lit("file").alias("room_type"), F.min("room_key").alias("room_key"), F.min("project_id").alias("project_id"), F.count("*").alias("object_count"), F.max("exchange_at").alias("updated_at"))
        named = FA.path_facets(edges.select("project_id", F.col("exchange_at").alias("seen"), "path")).drop("path")
        parts = FA.project_parts(objects.where("project_id is not null").select("project_id").distinct()).withColumn("seen", F.lit(None).cast("timestamp_ntz"))
        f = models.embedded(FA.counted(named.unionByName(parts)), "facet_text", self.embed)
        self.store.commit({"objects": objects, "rooms": rooms.select(*self._t("rooms").columns), "room_objects": lies.select("room_id", "object_id", "exchange_at"), "facets": f.select(*self._t("facets").columns)}, KEYS)
        return n

    # searching

    def _vector(self, query: str) -> DataFrame:
        v = self.embed([query])[0]
        return self.spark.createDataFrame([([float(x) for x in v],)], "q array<float>")

    def _legs(self, query: str, limit: int, projects: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """The keyword leg and the vector leg over exchanges, twice the limit each, as (id, score)."""
        x = self._t("exchanges")
        x = x.where(F.col("project_id").isin(projects)) if projects else x
        words = query_words(query)
        kw = S.bm25(x.drop("embedding"), "exchange_text", words) if words else x.withColumn("score", F.lit(0.0)).where("false")
        kw = S.top(kw.select(F.col("exchange_id").alias("id"), F.round("score", 9).alias("score")), 2 * limit, "id")
        sem = S.nearest(x.where(V.usable(F.col("embedding"), len(self.embed([""])[0]))).select(F.col("exchange_id").alias("id"), "embedding"), self._vector(query))
        return kw, S.top(sem.select("id", F.round("score", 9).alias("score")), 2 * limit, "id")

    def _distilled(self, query: str, limit: int, projects: list[str] | None) -> DataFrame:
        o = self._t("objects").where("embedding is not null")
        o = o.where(F.col("project_id").isin(projects)) if projects else o
        near = S.nearest(o.where(V.usable(F.col("embedding"), len(self.embed([""])[0]))).select(F.col("exchange_id").alias("id"), "embedding"), self._vector(query))
        return S.top(near.groupBy("id").agg(F.round(F.max("score"), 9).alias("score")), 2 * limit, "id")

    def route(self, query: str, temporal: bool = False, now: datetime | None = None, k: int = 5) -> DataFrame:
        """Votes of the nearest facets of few projects for the projects they name."""
        f = self._t("facets").where(f"project_count between 1 and {FA.FEW}")
        h = S.nearest(f.where(V.usable(F.col("embedding"), len(self.embed([""])[0]))), self._vector(query)).withColumn("sim", 1 - F.col("distance"))
        h = S.top(h, k, "facet_id", "distance", True)
        if temporal:
            return FA.votes(h, FA.aged(F.col("sim"), F.col("last_seen"), F.lit(now or datetime.now()).cast("timestamp_ntz")))
        return FA.votes(h, F.col("sim") * F.col("weight") * F.col("weighted_count"))

    def search(self, query: str, mode: str = "cross_layer", limit: int = 50, projects: list[str] | None = None, since: str | None = None, until: str | None = None, min_messages: int = 0, must: bool = False, now: datetime | None = None) -> DataFrame:
        """(conversation_id, title, project_id, exchange_id, score, snippet): the best exchange of each conversation, best first."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        key = (self.store.manifest()["version"], query, mode, limit, tuple(projects or ()), since, until, min_messages, must, now)
        hit = self.cache.get(key)
        if hit and time.monotonic() - hit[0] < FRESH_SECONDS:
            self.cache.move_to_end(key)
            return hit[1]
        out = self._search(query, mode, limit, projects, since, until, min_messages, must, now)
        self.cache[key] = (time.monotonic(), out)
        while len(self.cache) > CACHED:
            self.cache.popitem(last=False)
        return out

    def _search(self, query, mode, limit, projects, since, until, min_messages, must, now) -> DataFrame:
        p = Q.parse(query, now)
        plain = " ".join([*p.phrases, *p.must, *p.should]) or query
        if mode in ("hierarchical", "temporal"):
            best = [r["project_id"] for r in self.route(plain, mode == "temporal", now).where("winner").limit(1).collect()]
            both = [x for x in best if not projects or x in projects]
            projects, mode = (both or projects) if mode == "hierarchical" else (best or projects), "hybrid"
        kw, sem = self._legs(plain, limit, projects)
        if mode == "keyword":
            hits = kw
        elif mode == "semantic":
            hits = sem
        elif mode == "distill":
            hits = self._distilled(plain, limit, projects)
        elif mode == "cross_layer":
            hits = S.combmnz(sem, self._distilled(plain, limit, projects), "id").select("id", "score")
        else:
            wk, ws = (0.6, 0.4) if mode == "hybrid" else Q.classify(query)[1:3]
            hits = S.weighted(kw, sem, "id", wk, ws).withColumnRenamed("base", "score")
        x = self._t("exchanges").select(F.col("exchange_id").alias("id"), "conversation_id", "exchange_text")
        c = self._t("conversations").select("conversation_id", "project_id", F.coalesce("title", F.lit("Untitled")).alias("title"), "updated_at", "message_count")
        j = hits.join(x, "id").join(c, "conversation_id")
        if mode in ("hybrid", "adaptive"):
            j = S.title_boost(j.withColumnRenamed("score", "base"), "title", plain).drop("base")
        j = LI.search_filters(j, since, until, min_messages)
        if mode in ("keyword", "semantic", "hybrid", "adaptive"):
            j = j.where(T.all_phrases(F.col("exchange_text"), p.phrases + (p.must if must else [])) & T.none_of(F.col("exchange_text"), p.without))
        j = S.best_per(j.withColumn("score", F.round("score", 9)), "conversation_id", "id")
        j = S.top(j, limit, "conversation_id")
        return j.select("conversation_id", "title", "project_id", F.col("id").alias("exchange_id"), "score", T.snippet(F.col("exchange_text"), p.phrases, [*p.must, *p.should]).alias("snippet"))

    def search_with_fallback(self, query: str, projects: list[str], limit: int = 50, least: int = 3) -> tuple[DataFrame, str]:
        """Hybrid results within the projects, else with related ones, else of all; and the tier that had enough."""
        rows = self.search(query, "hybrid", limit, projects)
        if rows.count() >= least:
            return rows, "scoped"
        near = [*projects, *[r["project_id"] for r in self.related(projects).collect()]]
        rows = self.search(query, "hybrid", limit, near)
        return (rows, "related") if rows.count() >= least else (self.search(query, "hybrid", limit), "unscoped")

    def related(self, projects: list[str], limit: int = 5) -> DataFrame:
        """Projects that share a room key with the given ones."""
        r = self._t("rooms").select("room_key", "project_id").where("project_id is not null")
        keys = r.where(F.col("project_id").isin(projects)).select("room_key").distinct()
        return r.join(keys, "room_key", "left_semi").where(~F.col("project_id").isin(projects)).select("project_id").distinct().orderBy("project_id").limit(limit)

    def merged(self, query: str, limit: int = 50, boosted: list[str] | None = None) -> DataFrame:
        """Both layers by conversation."""
        sem, dis = self._legs(query, limit, None)[1], self._distilled(query, limit, None)
        of = self._t("exchanges").select(F.col("exchange_id").alias("id"), "conversation_id", "project_id")
        leg = lambda df: S.normalised(df).join(of, "id").groupBy("conversation_id").agg(F.max("norm").alias("score"), F.first("project_id").alias("project_id"))
        return S.top(S.merged_layers(leg(dis), leg(sem), "conversation_id", boosted=boosted), limit, "conversation_id")

    # listing and deleting

    def list(self, order: str = "date_newest", limit: int = 50, offset: int = 0, **filters) -> tuple[DataFrame, int]:
        c = LI.listed(self._t("conversations"), **filters)
        return LI.page(c, order, limit, offset), c.count()

    def view(self, conversation_id: str) -> DataFrame:
        """The messages of one conversation in order; KeyError if there is none."""
        if self._t("conversations").where(F.col("conversation_id") == conversation_id).isEmpty():
            raise KeyError(conversation_id)
        return self._t("messages").where(F.col("conversation_id") == conversation_id).orderBy("sequence")

    def find_rooms(self, text: str) -> DataFrame:
        return LI.keyword_rooms(self._t("rooms"), text, ["room_key"]).orderBy(F.desc("object_count"), "room_id")

    def walk_room(self, room_id: str) -> DataFrame:
        r = self._t("room_objects").where(F.col("room_id") == room_id).select("object_id")
        return self._t("objects").join(r, "object_id", "left_semi").orderBy(F.col("exchange_at").asc_nulls_first(), "object_id")

    def delete(self, conversation_ids: list[str]) -> dict[str, int]:
        """Takes conversations out of every table in one commit; gives the rows taken from each."""
        ids = self.spark.createDataFrame([(i,) for i in conversation_ids], "conversation_id string")
        gone = self._t("objects").join(ids, "conversation_id", "left_semi").select("object_id")
        names = ("conversations", "messages", "exchanges", "objects", "file_state")
        counts = {r["table_name"]: r["deleted"] for r in M.deleted_counts({n: self._t(n) for n in names}, ids, ["conversation_id"]).collect()}
        counts["room_objects"] = self._t("room_objects").join(gone, "object_id", "left_semi").count()
        left = M.delete(self._t("room_objects"), gone, ["object_id"])
        per = left.groupBy("room_id").agg(F.count("*").alias("n"))
        rooms = self._t("rooms").join(per, "room_id").withColumn("object_count", F.col("n")).select(*self._t("rooms").columns)
        self.store.commit({n: M.delete(self._t(n), ids, ["conversation_id"]) for n in names} | {"room_objects": left, "rooms": rooms})
        return counts

    def statistics(self) -> DataFrame:
        return LI.statistics(self._t("conversations"))


def query_words(query: str) -> list[str]:
    """The words of a query, as `functions.text.words` takes them from a text."""


    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
