"""One project's graph behind one object: index, search, walk, remember, watch."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions import gate
from corpusgraph.functions.text import content_hash, extension_language, folded
from corpusgraph.operators import drift, edges, graph, lexical, memory, ranking, vector
from corpusgraph.operators.parse import STATEMENTS, parse_files
from corpusgraph.plans.lineage import written
from corpusgraph.plans.search import hybrid
from corpusgraph.plans.store import Store
from corpusgraph.schema import EDGE_WEIGHTS, EXACT_LIMIT, LEXICAL_LIMIT, MEMORY, PREVIEW_CHARS
from corpusgraph.sources.config import FOLDER, evaluation_cases, index_options, recall_at, scaffold
from corpusgraph.sources.files import confined, contents, decoded, repository_files, text_only
from corpusgraph.sources.history import changed_ranges, history_marker
from corpusgraph.streaming.watch import watch

NODES = "id string, kind string, name string, qualname string, path string, label string, preview string, body string, span_hash string, body_hash string, start_line int, end_line int, calls array<string>, updated_at double"
POLICY = "gate-1"
#: Paths or problems that a report lists; counts beside them are of all.
SHOWN = 200


class AmbiguousError(ValueError):
    """More than one node answers to a name."""


class Project:
    """The graph of the files below ``root``.

    Tables live in a hidden folder there, or in ``store``, any folder that Spark can write to. On
    a cluster ``root`` is on a file system that all executors share.
    """

    def __init__(self, spark: SparkSession, root: str, *, store: str | None = None, embed=None, model: str = "hash-16"):
        self.spark, self.root = spark, os.path.realpath(root)
        self.store = Store(spark, store or "file://" + os.path.join(self.root, FOLDER, "store"))
        self.embed_with, self.model, self._seen = embed, model, {}

    # -- building ---------------------------------------------------------------------

    def init(self) -> None:
        scaffold(self.root)

    def _files(self) -> DataFrame:
        o = index_options(self.root)
        rows = repository_files(self.spark, self.root, include=o["include"], exclude=o["exclude"], max_bytes=o["max_bytes"])
        return rows.withColumn("label", gate.label(F.col("path"), F.col("content"), o["allow"])).withColumn("language", extension_language(F.col("path")))

    def _nodes(self, files: DataFrame, parsed: DataFrame, now: float) -> DataFrame:
        """File and symbol nodes; gated files keep no content."""
        key = lambda *parts: F.substring(F.sha2(F.concat_ws("/", *parts), 256), 1, 20)
        open_ = F.col("label") != gate.SECRET
        file_nodes = files.select(
            F.concat(F.lit("file_"), key(F.lit("file"), "path")).alias("id"), F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("string").alias("qualname"), "path", "label",
            F.when(open_, F.substring("content", 1, PREVIEW_CHARS)).alias("preview"), F.when(open_, F.col("content")).alias("body"), F.col("file_hash").alias("span_hash"), F.lit(None).cast("string").alias("body_hash"),
            F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.array().cast("array<string>").alias("calls"), F.lit(now).alias("updated_at"),
        )
        found = parsed.select(F.explode("symbols").alias("s")).select("s.*")
        symbols = drift.last_per_key(found, ["path", "qualname"], "start_line").join(files.filter(open_).select("path", "label"), "path")
        kind = F.when(F.col("is_test"), "test").otherwise("symbol")
        symbol_nodes = symbols.select(
            F.concat(F.substring(kind, 1, 4), F.lit("_"), key(F.lit("symbol"), "path", "qualname")).alias("id"), kind.alias("kind"), "name", "qualname", "path", "label",
            F.substring("body", 1, PREVIEW_CHARS).alias("preview"), "body", "span_hash", "body_hash", "start_line", "end_line", "calls", F.lit(now).alias("updated_at"),
        )
        return file_nodes.unionByName(symbol_nodes)

    def _edges(self, nodes: DataFrame, statements: DataFrame) -> DataFrame:
        """All structural edges: a pure function of the nodes, the import statements and the history."""
        syms, file_nodes = nodes.filter("kind <> 'file'"), nodes.filter("kind = 'file'")
        ids = file_nodes.select(F.col("path").alias("p"), F.col("id").alias("file_id"))
        defines = edges.defines(syms.join(ids, F.col("path") == F.col("p")).select("file_id", "id"))
        names = syms.select("id", F.explode(F.array_distinct(F.array("name", "qualname"))).alias("name"))
        calls = edges.calls(syms.select(F.col("id").alias("caller"), F.explode("calls").alias("callee")), names)
        tested = edges.tested_by(syms.filter("kind = 'test'").select("id", "name"), syms.filter("kind = 'symbol'").select("id", "name"))
        by_path = edges.imports(statements, file_nodes.select("path"))
        a, b = ids.select(F.col("p").alias("src"), F.col("file_id").alias("s")), ids.select(F.col("p").alias("dst"), F.col("file_id").alias("t"))
        imports = by_path.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "kind", "weight")
        cols = ["src", "dst", "kind", "weight"]
        out = defines.select(*cols)
        for e in (calls, tested, imports, self._co_changed(syms)):
            out = out.unionByName(e.select(*cols))
        return out

    def _co_changed(self, symbols: DataFrame) -> DataFrame:
        spans = symbols.select("path", F.col("id").alias("span_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        hunks = changed_ranges(self.spark, self.root)
        points = hunks.select("commit", "path", F.explode(F.array("start", "end")).alias("at")).distinct()
        hit = edges.narrowest_cover(points.select("path", "at").distinct(), spans, "path")
        changes = points.join(hit, ["path", "at"]).select("commit", F.col("span_id").alias("symbol"), "path").distinct()
        pairs = edges.capped_degree(edges.changed_together(changes, across=True))
        both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))
        return both.select("src", "dst", F.lit("co_changed").alias("kind"), F.lit(EDGE_WEIGHTS["co_changed"]).alias("weight"))

    def index(self, *, full: bool = False) -> dict:
        """Bring the graph up to date and say what was done."""
        began, now = time.time(), time.time()
        files = written(self._files(), "files")
        old_files, old_nodes = self.store.read("files"), self.store.read("nodes")
        o = index_options(self.root)
        policy, marker = f"{POLICY}:{sorted(o['allow'])}", history_marker(self.root)
        fresh = full or old_files is None or self.store.meta("policy") != policy
        changed = files if fresh else drift.changed(files, old_files)
        counts = files.agg(F.count(F.lit(1)), F.count_if(F.col("label") == gate.SECRET)).first()
        n_changed, n_gated = changed.agg(F.count(F.lit(1)), F.count_if(F.col("label") == gate.SECRET)).first()
        n_removed = 0 if old_files is None else drift.removed(files, old_files).count()
        stats = {"files": counts[0], "changed": n_changed, "removed": n_removed, "gated": counts[1], "unparsed": 0}
        if n_changed or n_removed or self.store.meta("history") != marker:
            # Only changed files are parsed, once; rows of the others are carried over by path.
            parsed = written(parse_files(changed.filter(F.col("label") != gate.SECRET)), "parsed")
            stats["unparsed"] = parsed.filter("failed").count()
            made = written(self._nodes(changed, parsed, now), "made")
            statements = parsed.select(F.explode("imports").alias("s")).select("s.*")
            index = lexical.inverted(made.filter(F.col("label") != gate.SECRET).select("id", "name", F.col("preview").alias("content")), "id", ["name", "content"])
            nodes = made
            if not fresh and old_nodes is not None:
                same = drift.unchanged(files, old_files).select("path")
                kept = old_nodes.join(same, "path", "left_semi").select(*made.columns)
                nodes = kept.unionByName(made)
                statements = statements.unionByName(self.store.read("imports").join(same.withColumnRenamed("path", "src_path"), "src_path", "left_semi").select(*STATEMENTS.names))
                index = index.unionByName(self.store.read("postings").join(kept.select("id"), "id", "left_semi").select(*index.columns))
            nodes, statements = written(nodes, "nodes"), written(statements, "imports")
            index = written(lexical.laid_out(written(index, "postings-plain")), "postings")
            tables = {"files": files.drop("content"), "nodes": nodes, "imports": statements, "edges": self._edges(nodes, statements), "postings": index.sortWithinPartitions("token", "id"), "lengths": index.select("id", "n_tokens").distinct()}
            log = self.store.read("memories")
            if log is not None:
                tables["memories"] = written(self._moved(log, old_nodes, nodes, now), "memories")
            self.store.commit(tables, {"policy": policy, "history": marker, "last_indexed_at": now, "root": self.root}, purge=n_gated > 0)
        stats |= {"nodes": self._table("nodes").count(), "edges": self._table("edges").count(), "seconds": round(time.time() - began, 3)}
        return stats

    def _moved(self, log: DataFrame, old: DataFrame | None, new: DataFrame, now: float) -> DataFrame:
        """The memory log with new rows for anchors that moved and memories gone stale."""
        live = memory.current(log)
        place = lambda n: n.filter("kind <> 'file'").select("path", F.col("qualname").alias("symbol"), "body_hash")
        moved = live.select("id", "path", "symbol", "span_hash", "moved_from")
        if old is not None:
            moved = drift.move_anchors(moved, drift.renames(place(old), place(new)))
        current = new.select("path", F.when(F.col("kind") == "file", F.lit(None).cast("string")).otherwise(F.col("qualname")).alias("symbol"), "span_hash")
        state = drift.live_state(moved.join(live.select("id", "state"), "id"), current).select("id", F.col("path").alias("n_path"), F.col("symbol").alias("n_symbol"), F.col("moved_from").alias("n_moved"), F.col("live").alias("n_state"))
        joined = live.join(state, "id").filter("path is not null and (not (path <=> n_path) or not (symbol <=> n_symbol) or state <> n_state or not (moved_from <=> n_moved))")
        rows = joined.withColumns({"path": F.col("n_path"), "symbol": F.col("n_symbol"), "moved_from": F.col("n_moved"), "state": F.col("n_state"), "seq": F.col("seq") + 1, "updated_at": F.lit(now)})
        return log.unionByName(rows.select(*log.columns))

    # -- reading ----------------------------------------------------------------------

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise LookupError("the project isn't indexed")
        return df

    def _memories(self) -> DataFrame | None:
        log = self.store.read("memories")
        return None if log is None else memory.current(log).filter(~F.col("state").isin("superseded", "retracted"))

    def _all(self) -> DataFrame:
        """Structural nodes and memories in one shape, with what search needs."""
        nodes = self._table("nodes").filter(F.col("label") != gate.SECRET)
        rows = nodes.select("id", "kind", "name", "qualname", "path", F.when(F.col("kind") != "file", F.col("qualname")).alias("symbol"), "span_hash", F.col("preview").alias("content"), "body", F.lit("fresh").alias("state"), F.lit(False).alias("pinned"), "updated_at")
        found = self._memories()
        if found is not None:
            rows = rows.unionByName(found.select("id", "kind", "name", F.lit(None).cast("string").alias("qualname"), "path", "symbol", "span_hash", "content", F.col("content").alias("body"), "state", F.coalesce("pinned", F.lit(False)).alias("pinned"), "updated_at"))
        return rows

    def _look(self, paths) -> None:
        """Bring what is known of these files up to date: label, hash, text and symbols as of now.

        Files are looked at together, by executors, when their size or time differs from what was
        last seen; at most as many as a search ranks.
        """
        stamps = {}
        for p in confined(self.root, sorted({p for p in paths if p})):
            try:
                at = os.stat(os.path.join(self.root, p))
                stamps[p] = (at.st_size, at.st_mtime_ns)
            except OSError:
                continue
        for p in set(paths) - set(stamps):
            self._seen[p] = (None, {"gone": True, "secret": False})
        fresh = [(p,) for p, at in stamps.items() if self._seen.get(p, (None,))[0] != at]
        if not fresh:
            return
        o = index_options(self.root)
        read = text_only(contents(self.spark.createDataFrame(fresh, "path string"), self.root, o["max_bytes"]))
        files = written(read.select("path", decoded(F.col("content")).alias("content"), content_hash(F.col("content")).alias("hash")).withColumn("label", gate.label(F.col("path"), F.col("content"), o["allow"])), "seen")
        views = {p: {"gone": True, "secret": False} for (p,) in fresh}
        shown = files.filter(F.col("label") != gate.SECRET)
        for r in files.filter(F.col("label") == gate.SECRET).select("path").collect():
            views[r[0]] = {"gone": False, "secret": True}
        for r in shown.select("path", "content", "hash").join(parse_files(shown).select("path", "symbols"), "path").collect():
            views[r["path"]] = {"gone": False, "secret": False, "hash": r["hash"], "text": r["content"], "symbols": {s["qualname"]: s for s in r["symbols"]}}
        self._seen.update({p: (stamps[p], v) for p, v in views.items()})

    def resolve(self, target: str) -> dict:
        """The one node that a node id, path, path::symbol or name means."""
        path, mark, name = target.rpartition("::")
        nodes = self._all()
        if mark:
            nodes = nodes.filter(F.col("path") == path)
        hit = graph.resolve(nodes, self.spark.createDataFrame([(name if mark else target,)], "target string")).first()
        if hit is None:
            raise LookupError(f"not found: {target}")
        if hit["n_matches"] > 1:
            raise AmbiguousError(f"{hit['n_matches']} nodes answer to {target}; name one by its id or as path::name")
        return nodes.filter(F.col("id") == hit["id"]).first().asDict()

    def _item(self, row: dict, zoom: str) -> dict:
        """What is shown of a row: state and content come from the file as it is now."""
        if zoom not in {"auto", "L0", "L1", "L2", "L3"}:
            raise ValueError("zoom must be auto, L0, L1, L2 or L3")
        is_symbol = row["kind"] in ("symbol", "test")
        level = ("L2" if is_symbol else "L1") if zoom == "auto" else zoom
        state, content, warning = row["state"], row["body"] or "", None
        if row["path"]:
            self._look([row["path"]])
            view = self._seen[row["path"]][1]
            if view["secret"]:
                raise PermissionError("the gate refuses this content")
            now = None
            if not view["gone"]:
                now = view["symbols"].get(row["symbol"]) if row["symbol"] else {"span_hash": view["hash"]}
            if state == "fresh" and (now is None or now["span_hash"] != row["span_hash"]):
                state, warning = "stale", "the file is gone or can't be read" if view["gone"] else "changed since it was indexed"
            if row["kind"] not in MEMORY:
                content = self._shown(row, view, level, is_symbol)
        location = f"{row['path']}::{row['qualname']}" if row["path"] and row["qualname"] else row["path"] or row["name"]
        item = {"id": row["id"], "location": location, "kind": row["kind"], "state": state, "trust_label": "untrusted", "zoom": level, "content": content, "pinned": bool(row["pinned"])}
        return {**item, "warning": warning} if warning else item

    @staticmethod
    def _shown(row: dict, view: dict, level: str, is_symbol: bool) -> str:
        if view["gone"]:
            return ""
        heads = [s["body"].split("\n", 1)[0] for s in view["symbols"].values()]
        if level == "L0":
            return f"{row['path']}: {row['qualname'] or ', '.join(view['symbols']) or row['name']}"
        if level == "L3":
            return view["text"]
        if is_symbol:
            body = view["symbols"][row["symbol"]]["body"] if row["symbol"] in view["symbols"] else ""
            return body.split("\n", 1)[0] if level == "L1" else body
        return "\n".join(heads) or view["text"][:PREVIEW_CHARS]

    def _items(self, rows: list[dict], zoom: str) -> list[dict]:
        """Items of rows, without those that the gate refuses by now."""
        self._look([r["path"] for r in rows if r["path"]])
        return [self._item(r, zoom) for r in rows if not (r["path"] and self._seen[r["path"]][1]["secret"])]

    def _rows(self, ids: list[str]) -> dict[str, dict]:
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        return {r["id"]: r.asDict() for r in self._all().join(wanted, "id", "left_semi").collect()}

    def search(self, query: str, *, budget: int = 4000, zoom: str = "auto", kind: str | None = None, max_hops: int = 2, semantic: bool = False, as_of: float | None = None) -> dict:
        if not 512 <= budget <= 100_000:
            raise ValueError("budget must be between 512 and 100000")
        if not query.strip() or len(query) > 2000:
            raise ValueError("query must have 1 to 2000 characters")
        if not 0 <= max_hops <= 4:
            raise ValueError("max_hops must be between 0 and 4")
        rows, warnings, mode = self._all(), [], "fts+graph"
        if kind == "memory" and self._memories() is None:
            return ranking.pack([], budget, mode=mode)
        phrases = [p for p in ([w for w in _folded(t)] for t in lexical.query_tokens(query)) if p]
        found = ranking.ranks(self._lexical(phrases)) if phrases else None
        seeds = [found.select(F.lit("fts").alias("source"), "id", "rank")] if found is not None else []
        seeds.append(self._exact(rows, query))
        if semantic:
            near = self._nearest(query)
            if near is None:
                warnings.append("no vectors of this model are stored; ranked by words and links alone")
            else:
                seeds.append(near)
                mode = "semantic+fts+graph"
        now = time.time() if as_of is None else as_of
        nodes = rows.select("id", F.timestamp_seconds("updated_at").alias("updated_at"), "pinned", "state", F.lit(True).alias("allowed"))
        links = self._table("edges").unionByName(self._about())
        ranked = hybrid(seeds, links, nodes, F.timestamp_seconds(F.lit(now)), hops=max_hops).limit(2 * LEXICAL_LIMIT + EXACT_LIMIT).collect()
        by_id = self._rows([r["id"] for r in ranked]) if ranked else {}
        self._look([r["path"] for r in by_id.values() if r["path"]])
        items = []
        for r in ranked:
            row = by_id.get(r["id"])
            if row is None or (row["path"] and self._seen[row["path"]][1]["secret"]) or (kind == "memory" and row["kind"] not in MEMORY) or (kind not in (None, "memory") and row["kind"] != kind):
                continue
            items.append({**self._item(row, zoom), "score": round(r["score"], 6), "provenance": {"source": "repository", "via": r["via"]}})
        if zoom == "auto" and len(items) > 1:
            most = max(800, budget // min(3, len(items)))
            items = [{**i, **self._item(by_id[i["id"]], "L1")} if i["zoom"] == "L2" and ranking.octet_bound(i) > most else i for i in items]
        return ranking.pack(items, budget, mode=mode, warnings=warnings)

    def _lexical(self, phrases: list[list[str]]) -> DataFrame:
        """BM25 from the stored index; memories, which aren't in it, are few and counted as they are."""
        hits, sizes = lexical.hits_of(self._table("postings"), phrases), self._table("lengths")
        found = self._memories()
        if found is not None:
            live = written(lexical.scanned(found, "id", ["name", "content"], phrases), "memory-hits")
            hits, sizes = hits.unionByName(live.select(*hits.columns)), sizes.unionByName(live.select("id", "n_tokens"))
        return lexical.scored(hits, lexical.totals(sizes), len(phrases), LEXICAL_LIMIT)

    def _exact(self, rows: DataFrame, query: str) -> DataFrame:
        if "::" in query:
            try:
                ids = [self.resolve(query)["id"]]
            except (LookupError, ValueError):
                ids = []
        else:
            ids = [r[0] for r in rows.filter(F.col("qualname") == query).select("id").orderBy("id").limit(EXACT_LIMIT).collect()]
            ids = ids or [r[0] for r in rows.filter(F.col("name") == query).select("id").orderBy("id").limit(EXACT_LIMIT).collect()]
        return self.spark.createDataFrame([("exact", i, k) for k, i in enumerate(ids, 1)], "source string, id string, rank int")

    def _about(self) -> DataFrame:
        """Edges from memories to what they are anchored to, derived anew at each read."""
        found = self._memories()
        cols = "src string, dst string, kind string, weight double"
        if found is None:
            return self.spark.createDataFrame([], cols)
        nodes = self._table("nodes").select(F.col("path").alias("p"), F.when(F.col("kind") == "file", F.lit(None).cast("string")).otherwise(F.col("qualname")).alias("q"), F.col("id").alias("dst"))
        return found.filter("path is not null").join(nodes, (F.col("path") == F.col("p")) & F.col("symbol").eqNullSafe(F.col("q"))).select(F.col("id").alias("src"), "dst", F.lit("about").alias("kind"), F.lit(EDGE_WEIGHTS["about"]).alias("weight"))

    def embed(self) -> dict:
        """Embed what isn't cached for the model; all vectors have one dimension."""
        embed = self.embed_with or vector.hash_embedder()
        rows = self._all().select("id", F.concat_ws("\n", F.coalesce("qualname", "path", "name"), "content").alias("text")).withColumn("digest", F.sha2("text", 256)).withColumn("model", F.lit(self.model))
        cache = self.store.read("vectors")
        if cache is None:
            cache = self.spark.createDataFrame([], "model string, digest string, vector array<float>")
        cache, before = written(vector.update_cache(rows, cache, ["model", "digest"], "text", embed), "vectors"), cache.count()
        sizes = [r[0] for r in cache.filter(F.col("model") == self.model).select(F.size("vector")).distinct().limit(2).collect()]
        if len(sizes) > 1 or cache.filter(~vector.valid(F.col("vector"))).limit(1).count():
            raise ValueError("vectors must be finite and of one dimension")
        self.store.commit({"vectors": cache, "embedded": rows.select("id", "model", "digest")}, {"embedding_model": self.model, "embedding_dim": sizes[0] if sizes else 0})
        return {"model": self.model, "embedded": cache.count() - before, "cached": before}

    def _nearest(self, query: str) -> DataFrame | None:
        held, cache = self.store.read("embedded"), self.store.read("vectors")
        if held is None or self.store.meta("embedding_model") != self.model:
            return None
        embed = self.embed_with or vector.hash_embedder()
        q = self.spark.createDataFrame([(query,)], "text string").select(embed(F.col("text")).alias("v")).first()[0]
        rows = held.join(cache, ["model", "digest"]).join(self._all().select("id"), "id", "left_semi")
        near = vector.nearest(rows, "id", "vector", [float(x) for x in q])
        return ranking.ranks(near.select("id", F.col("similarity").alias("score"))).select(F.lit("semantic").alias("source"), "id", "rank")

    def expand(self, target: str, *, zoom: str = "L2", budget: int = 4000) -> dict:
        return ranking.pack([self._item(self.resolve(target), zoom)], budget, mode="expand")

    def neighbors(self, target: str, *, edge: str | None = None, reverse: bool = False, budget: int = 4000) -> dict:
        if edge is not None and edge not in EDGE_WEIGHTS:
            raise ValueError("unknown kind of edge")
        node = self.resolve(target)
        hits = graph.neighbors(self._table("edges").unionByName(self._about()), node["id"], [edge] if edge else None, reverse).collect()
        rows = self._rows([h["id"] for h in hits]) if hits else {}
        shown = {i["id"]: i for i in self._items(list(rows.values()), "L1")}
        items = [{**shown[h["id"]], "provenance": {"source": "graph", "from": node["id"], "edge": h["kind"], "reverse": reverse}} for h in hits if h["id"] in shown]
        return ranking.pack(items, budget, mode="neighbors")

    def impact(self, target: str, *, depth: int = 2, tests_only: bool = False, budget: int = 4000) -> dict:
        node = self.resolve(target)
        hits = graph.reach(graph.impact_edges(self._table("edges")), node["id"], depth).collect()
        rows = self._rows([h["id"] for h in hits]) if hits else {}
        shown = {i["id"]: i for i in self._items(list(rows.values()), "L1")}
        items = [{**shown[h["id"]], "provenance": {"source": "reverse-dependencies", "path": list(h["path"])}} for h in hits if h["id"] in shown and (not tests_only or rows[h["id"]]["kind"] == "test")]
        return ranking.pack(items, budget, mode="impact", warnings=["Calls are linked by name; this is not a complete dependency analysis."])

    def evaluate(self, path: str, *, k: int = 5, budget: int = 16_000) -> dict:
        """Mean recall among the first k results and median latency over a file of cases."""
        rows = []
        for case in evaluation_cases(self.spark, path).collect():
            began = time.perf_counter()
            found = [i["location"] for i in self.search(case["query"], budget=budget)["items"]]
            rows.append((case["query"], found, 1000 * (time.perf_counter() - began)))
        found = self.spark.createDataFrame(rows, "query string, found array<string>, latency_ms double")
        return recall_at(evaluation_cases(self.spark, path), found, k).first().asDict()

    def why(self, topic: str, **options) -> dict:
        return self.search(topic, kind="memory", **options)

    def show(self, target: str) -> dict:
        node = self.resolve(target)
        names = self._table("nodes").select("id", "name")
        both = graph.callers_and_callees(self._table("edges"), names).filter(F.col("id") == node["id"]).first()
        return {**self._item(node, "L2"), "callers": both["callers"] if both else None, "callees": both["callees"] if both else None}

    def map(self, limit: int = 25) -> DataFrame:
        """Files by their number of symbols, with up to five top-level names."""
        syms = self._table("nodes").filter("kind <> 'file'")
        top = F.sort_array(F.collect_set(F.when(~F.contains("qualname", F.lit(".")), F.col("qualname"))))
        return syms.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.slice(top, 1, 5).alias("names")).orderBy(F.desc("n"), "path").limit(limit)

    def status(self) -> dict:
        nodes, links = self._table("nodes"), self._table("edges")
        kinds = {r[0]: r[1] for r in nodes.groupBy("kind").count().collect()}
        gated = nodes.filter((F.col("label") == gate.SECRET) & (F.col("kind") == "file")).select("path")
        return {"kinds": kinds, "edges": {r[0]: r[1] for r in links.groupBy("kind").count().collect()}, "n_gated": gated.count(), "gated": [r[0] for r in gated.orderBy("path").limit(SHOWN).collect()], "meta": self.store.state["meta"]}

    def verify(self) -> dict:
        """How many anchored nodes and memories still match the files as they are now."""
        files = written(self._files(), "live")
        parsed = written(parse_files(files.filter(F.col("label") != gate.SECRET)), "live-parsed")
        now = written(self._nodes(files, parsed, time.time()), "live")
        current = now.select("path", F.when(F.col("kind") == "file", F.lit(None).cast("string")).otherwise(F.col("qualname")).alias("symbol"), F.when(F.col("label") != gate.SECRET, F.col("span_hash")).alias("span_hash"))
        nothing = F.lit(None).cast("string")
        held = self._table("nodes").filter(F.col("label") != gate.SECRET).select("id", "path", F.when(F.col("kind") == "file", nothing).otherwise(F.col("qualname")).alias("symbol"), "span_hash", nothing.alias("moved_from"), F.lit("fresh").alias("state"))
        found = self._memories()
        if found is not None:
            held = held.unionByName(found.filter("path is not null").select("id", "path", "symbol", "span_hash", "moved_from", "state"))
        states = written(drift.live_state(held, current), "states")
        rate = drift.drift_rate(states).first().asDict()
        problems = [{"id": r["id"], "location": r["path"]} for r in states.filter("live <> 'fresh'").select("id", "path").orderBy("path", "id").limit(SHOWN).collect()]
        return {**rate, "problems": problems}

    # -- memory -----------------------------------------------------------------------

    def remember(self, kind: str, content: str, *, anchor: str | None = None, origin: str = "user") -> str:
        secret = self.spark.range(1).select(gate.content_is_secret(F.lit(content)).alias("s")).first()["s"]
        place = None
        if anchor:
            node = self.resolve(anchor)
            held = self._table("nodes").filter(F.col("id") == node["id"]).first()
            if held is None:
                raise ValueError("memories can't be anchored to memories")
            if self._item(node, "L0")["state"] != "fresh":
                raise ValueError("the anchor has changed since it was indexed; index first")
            place = {"path": held["path"], "symbol": held["qualname"], "span_hash": held["span_hash"]}
        row = memory.memory_row(kind, content, origin=origin, anchor=place, secret=secret)
        # The write itself is an episode that the memory is derived from.
        episode = self.spark.createDataFrame([(memory.new_id("epis"), "episode", "memory write", origin, row[0], row[-2])], "id string, kind string, name string, origin string, memory string, created_at double")
        old = self.store.read("episodes")
        self._append(memory.rows(self.spark, [row]), {"episodes": written(episode if old is None else old.unionByName(episode), "episodes")})
        return row[0]

    def derived_from(self) -> DataFrame:
        """Edges from memories to the episodes that wrote them; they are never walked."""
        held = self.store.read("episodes")
        if held is None:
            return self.spark.createDataFrame([], "src string, dst string, kind string, weight double")
        return held.select(F.col("memory").alias("src"), F.col("id").alias("dst"), F.lit("derived_from").alias("kind"), F.lit(EDGE_WEIGHTS["derived_from"]).alias("weight"))

    def _append(self, rows: DataFrame, others: dict[str, DataFrame] | None = None) -> None:
        log = self.store.read("memories")
        self.store.commit({"memories": written(rows if log is None else log.unionByName(rows), "memories"), **(others or {})})

    def recall(self, memory_id: str) -> dict:
        row = self.resolve(memory_id)
        if row["kind"] not in MEMORY:
            raise LookupError(f"not a memory: {memory_id}")
        return self._item(row, "L2")

    def pin(self, memory_id: str, value: bool = True) -> None:
        self.recall(memory_id)
        self._append(memory.pin_row(self.store.read("memories"), memory_id, value))

    def unpin(self, memory_id: str) -> None:
        self.pin(memory_id, False)

    def create_context(self, query: str, pinned: tuple[str, ...] = ()) -> str:
        if not query.strip() or len(query) > memory.MOST_QUERY or len(pinned) > memory.MOST_PINS:
            raise ValueError("a context has a query of 1 to 2000 characters and at most 32 pins")
        refs = [self._item(self.resolve(p), "L0") for p in pinned]
        kept = [i["id"] if i["kind"] in MEMORY else i["location"] for i in refs]
        handle = memory.new_id("ctx")
        row = self.spark.createDataFrame([(handle, query, kept)], "handle string, query string, pinned array<string>")
        old = self.store.read("handles")
        self.store.commit({"handles": written(row if old is None else old.unionByName(row), "handles")})
        return handle

    def load_context(self, handle: str, *, budget: int = 4000) -> dict:
        rows = self.store.read("handles")
        hit = rows.filter(F.col("handle") == handle).first() if rows is not None else None
        if hit is None:
            raise LookupError(f"unknown context: {handle}")
        items, warnings = [], []
        for ref in hit["pinned"]:
            try:
                items.append(self._item(self.resolve(ref), "auto"))
            except (LookupError, ValueError, PermissionError):
                warnings.append("a pinned item is missing, ambiguous or refused")
        seen = {i["id"] for i in items}
        items += [i for i in self.search(hit["query"], budget=100_000)["items"] if i["id"] not in seen]
        return ranking.pack(items, budget, mode="context", warnings=list(dict.fromkeys(warnings)))

    def watch(self, checkpoint: str, *, every: str | None = "1 second"):
        """Index again whenever files come or change; a failure leaves the old index in place."""

        def apply(_batch: DataFrame, _n: int) -> None:
            self.index()

        return watch(self.spark, self.root, apply, checkpoint, every=every)


def _folded(token: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded(token))
