"""Processing only new or changed records, with a Merkle tree over key-range hashes.

The key space (the hash of a key) is cut into ``2 ** (bits * levels)`` equal ranges, the leaves; ``levels`` follows from
the number of records, so a leaf holds at most about ``per_leaf`` of them at every size. A leaf's digest folds the
digests of its records, a node's digest those of the leaves below it. A run's listing is hashed into a tree of its own, compared
with the tree of the state it starts from, and only leaves below differing nodes are opened: their records are
gathered, compared one by one, and written anew. All other leaves stay where they lie. A listing row without content
says only that its record is still there; a leaf with such a row can't be vouched for by its digest and is opened.

Several runs that wait are taken in one pass: each has its tree, each is compared with the one it starts from.

Everything a pass writes (records of the opened leaves, tree, output) goes to a folder of its own that no other attempt
uses, and becomes visible together when the pointer file is replaced. A pass that dies before that leaves the published
state untouched; a run that was published before is never computed again, its stored output is returned. One writer at a
time: a pass that finds another pointer than it started from gives up. What nothing refers to any more is removed after
publishing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.functions.paths import display_path, hash_key, path_key
from inkgrove.runtime import release, scratch, written

BITS, PER_LEAF = 4, 32
#: Levels below the root that the driver compares itself (at most 16 ** 3 + 16 ** 2 + 16 + 1 nodes a run); deeper ones are joined.
DRIVER_LEVELS = 3
#: Segments of records a state may be spread over before the next pass writes all of them anew.
SEGMENTS = 8
#: Runs taken in one pass.
RUNS_AT_ONCE = 16

RECORDS = "leaf bigint, key string, path string, content string"
TREE = "level int, node bigint, n bigint, d1 bigint, d2 bigint, home string"
TREE_COLUMNS = [c.split()[0] for c in TREE.split(", ")]
OUTPUT = "run string, key string, path string, content string"


def levels_for(records: int, bits: int = BITS, per_leaf: int = PER_LEAF) -> int:
    """Levels at which a leaf holds at most ``per_leaf`` of so many records on average."""
    levels = 0
    while records > per_leaf << (bits * levels) and bits * (levels + 1) < 63:
        levels += 1
    return levels


def leaf_of(key: Column, bits: int, levels: int) -> Column:
    """The range of the hashed key; hashing makes ranges even whatever the keys look like."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits * levels).cast("bigint") if levels else F.lit(0).cast("bigint")


def leaf_digests(records: DataFrame, *by: str, home: str | None = None) -> DataFrame:
    """``(*by, node, n, d1, d2, blanks, home)`` of records with ``leaf``, ``key``, ``content``; their order is irrelevant.
    Records whose ``blank`` is true count in ``blanks`` only."""
    content, full = F.coalesce(F.col("content"), F.lit("\0")), ~F.col("blank")
    a, b = (F.coalesce(F.bit_xor(F.when(full, h)), F.lit(0)) for h in (F.xxhash64("key", content), F.xxhash64(content, F.lit(7), "key")))
    folded = records.groupBy(*by, F.col("leaf").alias("node")).agg(F.count_if(full).alias("n"), a.alias("a"), b.alias("b"), F.count_if("blank").alias("blanks"))
    return folded.select(*by, "node", "n", F.xxhash64("node", "a", "b", "n").alias("d1"), F.xxhash64("b", "node", "n", "a").alias("d2"), "blanks", F.lit(home).cast("string").alias("home"))


def whole_tree(leaves: DataFrame, bits: int, levels: int, *by: str) -> DataFrame:
    """``(*by, level, node, n, d1, d2, blanks, home)`` of all levels over the leaf digests, in one aggregation: a node folds
    the hashed digests of the leaves below it, whatever their order. ``home`` is that of a leaf, null above."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    each = leaves.select(*by, level, "node", "n", "d1", "d2", "blanks", "home")
    each = each.withColumn("node", F.expr(f"shiftright(node, {bits} * ({levels} - level))"))
    home = F.max(F.when(F.col("level") == levels, F.col("home"))).alias("home")
    return each.groupBy(*by, "level", "node").agg(F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("blanks").alias("blanks"), home)


def descend(nodes: DataFrame, base_of: dict[int, int], bits: int, levels: int) -> tuple[DataFrame, int]:
    """``(leaf)`` of the leaves in which a run ``idx`` may differ from the one it starts from, ``base_of[idx]``, and how many
    nodes were compared down to the last level the driver handles. Children are looked at only below differing nodes."""
    spark = nodes.sparkSession
    top = min(levels, DRIVER_LEVELS)
    tree = {(r.idx, r.level, r.node): (r.n, r.d1, r.d2, r.blanks) for r in nodes.where(F.col("level") <= top).collect()}
    compared, differing = 0, set()
    for idx, base in base_of.items():
        frontier = [0]
        for level in range(top + 1):
            compared += len(frontier)
            pairs = [(n, tree.get((idx, level, n)), tree.get((base, level, n))) for n in frontier]
            frontier = [n for n, a, b in pairs if a != b or a and a[3]]
            if level < top:
                frontier = [(n << bits) | c for n in frontier for c in range(1 << bits)]
        differing |= {(idx, n) for n in frontier}
    if levels == top:
        return spark.createDataFrame(pa.table({"leaf": pa.array(sorted({n for _, n in differing}), pa.int64())})), compared
    frontier = spark.createDataFrame(sorted(differing), "idx int, node bigint")
    bases = F.create_map(*[F.lit(x) for pair in base_of.items() for x in pair])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "d1", "d2")]
    for level in range(top + 1, levels + 1):
        here = nodes.where(F.col("level") == level)
        child = F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda c: F.shiftleft("node", bits) + c))
        below = frontier.select("idx", bases[F.col("idx")].alias("base"), child.alias("node"))
        both = below.alias("f").join(here.alias("a"), ["idx", "node"], "left").join(here.select(F.col("idx").alias("base"), "node", "n", "d1", "d2", "blanks").alias("b"), ["base", "node"], "left")
        unlike = ~reduce(Column.__and__, same) | (F.coalesce("a.blanks", F.lit(0)) > 0) | (F.coalesce("b.blanks", F.lit(0)) > 0)
        frontier = both.where(unlike).select("idx", "node")
    return written(frontier.select(F.col("node").alias("leaf")).distinct(), "opened"), compared


class RecordStore:
    """The state ``(key, path, content)`` left by the last published run below ``base``, its tree, and the outputs of all published runs."""

    def __init__(self, spark: SparkSession, base: str, bits: int = BITS, per_leaf: int = PER_LEAF):
        self.spark, self.base, self.bits, self.per_leaf = spark, base.rstrip("/"), bits, per_leaf

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def state(self) -> dict | None:
        """The pointer: folder of the tree, levels, number of records, segments that hold records, outputs by run. None before the first."""
        fs, p = self._fs(f"{self.base}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, new: dict, old: dict | None) -> None:
        now = self.state()
        if (now and now["folder"]) != (old and old["folder"]):
            raise RuntimeError("another writer has published meanwhile")
        fs, tmp = self._fs(f"{self.base}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        _, final = self._fs(f"{self.base}/CURRENT")
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, final, options)  # atomic
        self._sweep(new)

    def _sweep(self, state: dict) -> None:
        """Removes what the pointer no longer refers to: folders of attempts that died, records rewritten since, old trees."""
        fs, root = self._fs(self.base)
        used = {*state["segments"], *state["outputs"].values(), state["folder"]}
        for entry in fs.listStatus(root):
            name = entry.getPath().getName()
            if name == "CURRENT":
                continue
            parts = [name] if name not in used else [f"{name}/records"] * (name not in state["segments"]) + [f"{name}/tree"] * (name != state["folder"])
            for part in parts:
                _, p = self._fs(f"{self.base}/{part}")
                fs.delete(p, True)

    def _write(self, df: DataFrame, folder: str, part: str, *by: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.base}/{folder}/{part}")

    def _tree(self, state: dict) -> DataFrame:
        return self.spark.read.schema(TREE).parquet(f"{self.base}/{state['folder']}/tree")

    def records(self, state: dict | None = None) -> DataFrame:
        """``(leaf, key, path, content)`` of the published state: of each leaf the records in the segment its tree names."""
        state = state or self.state()
        parts = [self.spark.read.schema(RECORDS).parquet(f"{self.base}/{s}/records").withColumn("home", F.lit(s)) for s in state["segments"]]
        leaves = self._tree(state).where(F.col("level") == state["levels"]).select(F.col("node").alias("leaf"), "home")
        return reduce(DataFrame.unionByName, parts).join(leaves, ["leaf", "home"], "left_semi").drop("home")

    def output(self, *runs: str) -> DataFrame:
        """``(run, key, path, content)`` of published runs."""
        return self._outputs({r: f for r, f in self.state()["outputs"].items() if r in set(runs)})

    def _outputs(self, of: dict[str, str]) -> DataFrame:
        parts = [self.spark.read.schema(OUTPUT).parquet(f"{self.base}/{f}/output").where(F.col("run").isin(sorted(r for r, g in of.items() if g == f))) for f in sorted(set(of.values()))]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], OUTPUT)

    def bootstrap(self, records: DataFrame) -> None:
        """Publishes what is there before the first run, unless something is published already."""
        if self.state() is not None:
            return
        folder, kept = _fresh(), written(records.select("key", "path", "content"), "start")
        n = kept.count()
        levels = levels_for(n, self.bits, self.per_leaf)
        laid = kept.select(leaf_of(F.col("key"), self.bits, levels).alias("leaf"), "key", "path", "content")
        self._write(laid.repartitionByRange("leaf").sortWithinPartitions("leaf"), folder, "records")
        self._write(whole_tree(leaf_digests(laid.withColumn("blank", F.lit(False)), home=folder), self.bits, levels).select(*TREE_COLUMNS), folder, "tree")
        self._publish({"folder": folder, "levels": levels, "n": n, "segments": [folder], "outputs": {}}, None)
        release(kept)

    def advance(self, runs: list[tuple[str, bool]], seen: DataFrame) -> dict:
        """Takes the runs that are not published yet, in order; ``seen`` is ``(run, key, path, content)``, a row per run and key.

        A run's output are the records whose content differs from what the last run before it that counts (its flag is
        true) left behind, or that were not there then. Runs that don't count leave nothing behind; they are published
        only together with a later run that does, else computed again next time. A key that a counting run did not see
        is gone after it. Returns ``outputs`` (folder by run), the number of leaves opened and of nodes compared.
        """
        state = self.state()
        if state is None:
            raise ValueError("bootstrap() first")
        todo = [(r, counts) for r, counts in runs if r not in state["outputs"]]
        result = {"outputs": {r: state["outputs"][r] for r, _ in runs if r in state["outputs"]}, "leaves": 0, "compared": 0}
        extra: dict[str, str] = {}
        while todo:
            folder = self._pass(todo[:RUNS_AT_ONCE], seen, state, extra, result)
            extra |= dict.fromkeys((r for r, _ in todo[:RUNS_AT_ONCE]), folder)
            todo = todo[RUNS_AT_ONCE:]
            state = self.state()
        result["outputs"] |= extra
        return result

    def _pass(self, todo: list[tuple[str, bool]], seen: DataFrame, state: dict, before: dict[str, str], result: dict) -> str:
        """One pass over at most ``RUNS_AT_ONCE`` runs; its folder. ``before`` are outputs of this call not published yet."""
        idx_of = {r: k for k, (r, _) in enumerate(todo, 1)}
        base_of, last = {}, 0
        for r, counts in todo:
            base_of[idx_of[r]] = last
            last = idx_of[r] if counts else last
        number = F.create_map(*[F.lit(x) for pair in idx_of.items() for x in pair])
        listed = written(seen.where(F.col("run").isin(list(idx_of))).select(number[F.col("run")].alias("idx"), "key", "path", "content"), "listed")
        levels = max(state["levels"], levels_for(max(state["n"], listed.count() // len(todo)), self.bits, self.per_leaf))
        known = self.records(state).withColumn("leaf", leaf_of(F.col("key"), self.bits, levels))
        laid = listed.withColumn("leaf", leaf_of(F.col("key"), self.bits, levels))
        if levels == state["levels"]:
            old = self._tree(state).withColumn("blanks", F.lit(0).cast("bigint"))
        else:  # the store has grown beyond its tree
            old = whole_tree(leaf_digests(known.withColumn("blank", F.lit(False))), self.bits, levels)
        cur = whole_tree(leaf_digests(laid.withColumn("blank", F.col("content").isNull()), "idx"), self.bits, levels, "idx")
        columns = ["idx", "level", "node", "n", "d1", "d2", "blanks", "home"]
        nodes = written(cur.select(*columns).unionByName(old.withColumn("idx", F.lit(0)).select(*columns)), "nodes")
        opened, compared = descend(nodes, base_of, self.bits, levels)
        result["leaves"] += opened.count()
        result["compared"] += compared

        folder = _fresh()
        rows = known.select(F.lit(0).alias("idx"), "leaf", "key", "path", "content").unionByName(laid.select("idx", "leaf", "key", "path", "content")).join(opened, "leaf", "left_semi")
        per_key = rows.groupBy("leaf", "key").agg(*[F.max(F.when(F.col("idx") == k, F.struct("path", "content"))).alias(f"r{k}") for k in range(len(todo) + 1)])
        held = {0: (F.col("r0").isNotNull(), F.col("r0.content"))}
        changes = []
        for r, k in idx_of.items():
            there, content = held[base_of[k]]
            row, given = F.col(f"r{k}"), F.col(f"r{k}.content")
            held[k] = (row.isNotNull() & (given.isNotNull() | there), F.coalesce(given, content))
            changes.append(F.when(given.isNotNull() & (~there | ~given.eqNullSafe(content)), F.struct(F.lit(r).alias("run"), row["path"].alias("path"), given.alias("content"))))
        there, content = held[last]
        kept = F.when(there, F.struct(F.col(f"r{last}.path").alias("path"), content.alias("content"))).alias("kept")
        folded = written(per_key.select("leaf", "key", F.array_compact(F.array(*changes)).alias("changes"), kept), "folded")
        self._write(folded.select("key", F.explode("changes").alias("c")).select("c.run", "key", "c.path", "c.content"), folder, "output", "run")
        if last:
            fresh = folded.where("kept is not null").select("leaf", "key", "kept.path", "kept.content")
            rewrite = len(state["segments"]) >= SEGMENTS or levels != state["levels"]
            rest = known.join(opened, "leaf", "left_anti")
            self._write((fresh.unionByName(rest.select("leaf", "key", "path", "content")) if rewrite else fresh).repartitionByRange("leaf").sortWithinPartitions("leaf"), folder, "records")
            same = nodes.where((F.col("idx") == 0) & (F.col("level") == levels)).join(opened.withColumnRenamed("leaf", "node"), "node", "left_anti").drop("idx", "level")
            same = same.withColumn("home", F.lit(folder)) if rewrite else same
            mine = leaf_digests(fresh.withColumn("blank", F.lit(False)), home=folder)
            self._write(whole_tree(same.unionByName(mine), self.bits, levels).select(*TREE_COLUMNS), folder, "tree")
            leaves = self.spark.read.schema(TREE).parquet(f"{self.base}/{folder}/tree").where(F.col("level") == levels)
            alive = {r.home: r.n for r in leaves.groupBy("home").agg(F.sum("n").alias("n")).collect()}
            done = [r for r, k in idx_of.items() if k <= last]
            self._publish({"folder": folder, "levels": levels, "n": sum(alive.values()), "segments": sorted(alive) or [folder], "outputs": state["outputs"] | before | dict.fromkeys(done, folder)}, state)
        for t in (folded, opened, nodes, listed):
            release(t)
        return folder


def _fresh() -> str:
    return f"pass-{uuid.uuid4().hex}"


def newest_per_run(scan: DataFrame) -> DataFrame:
    """``(run_id, key, path, content)``: of each run and path the row with the latest ``seen_at``, however late.

    Ties go to the row with the greater hash, null hashes last. Null paths are ignored.
    """
    keyed = scan.select(
        "run_id", path_key(F.col("rel_path")).alias("key"), F.col("seen_at"), hash_key(F.col("content_hash")).alias("content"), display_path(F.col("rel_path")).alias("path")
    ).where("key is not null and run_id is not null")
    newest = keyed.groupBy("run_id", "key").agg(F.max(F.struct("seen_at", "content", "path")).alias("r"))
    return newest.select("run_id", "key", "r.path", "r.content")


def known_notes(notes: DataFrame) -> DataFrame:
    """``(key, path, content)`` of the existing notes, each with the hash of its newest row (as in ``orphans``)."""
    keyed = notes.select(
        path_key(F.col("rel_path")).alias("key"), F.col("indexed_at"), F.col("id"), F.col("deleted_at").isNull().alias("alive"), hash_key(F.col("content_hash")).alias("content"), display_path(F.col("rel_path")).alias("path")
    ).where("key is not null")
    newest = keyed.groupBy("key").agg(F.max(F.struct("indexed_at", "id", "alive", "content", "path")).alias("r"))
    return newest.where("r.alive").select("key", "r.path", "r.content")


def changed_notes(notes: DataFrame, scan: DataFrame, runs: DataFrame, base: str | None = None, bits: int = BITS, per_leaf: int = PER_LEAF) -> DataFrame:
    """``(run_id, rel_path)``: per run that is ok or still open, what is new or changed against the last earlier ok run.

    Failed and locked runs leave nothing behind. With ``base`` the store below it is opened: runs published there are not
    computed again, only their stored outputs are read, and ``notes`` serves only to start a new store. An open run is
    computed on every call until a later ok run is published. Rows that arrive for a run after it was published are not
    looked at. The list of runs, a row per run, is the operator's only driver-side loop.
    """
    spark = scan.sparkSession
    plan = [(r.run_id, r.outcome) for r in runs.where("run_id is not null and (outcome = 'ok' or outcome is null)").select("run_id", "outcome").distinct().orderBy("run_id").collect()]
    if not plan:
        return spark.createDataFrame([], "run_id bigint, rel_path string")
    store = RecordStore(spark, base or scratch(spark, "runs"), bits, per_leaf)
    store.bootstrap(known_notes(notes))
    done = store.state()["outputs"]
    wanted = [r for r, _ in plan if str(r) not in done]
    seen = newest_per_run(scan.where(F.col("run_id").isin(wanted))).select(F.col("run_id").cast("string").alias("run"), "key", "path", "content")
    outputs = store.advance([(str(r), outcome == "ok") for r, outcome in plan], seen)["outputs"]
    return store._outputs(outputs).select(F.col("run").cast("bigint").alias("run_id"), F.col("path").alias("rel_path"))
