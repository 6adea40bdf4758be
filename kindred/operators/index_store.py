"""LSH indexes on disk that rows are appended to: flat tables of bins, and forests whose leaves split as they fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.lsh import Lsh, dump, load

from .knn import best_found, exhaustive, lsh_nearest, nearest_in_bins, tables
from .ordering import checkpointed
from .versions import Manifest

#: Folders that a table's bins, or a tree's first bits, are dealt to.
BUCKETS, HEAD = 16, 3


class FlatIndex:
    """Tables of bins. A change writes the rows it brings, by table and bucket of bins; compact() rewrites only buckets
    that several changes have touched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Manifest(spark, path)

    def create(self, hashes: Sequence[Lsh], buckets: int = BUCKETS) -> None:
        self.log.commit(None, {"hashes": dump(list(hashes)), "buckets": buckets, "parts": {}})

    @property
    def hashes(self) -> Sequence[Lsh]:
        return load(self.log.read()[1]["hashes"])

    def append(self, rows: DataFrame) -> list[str]:
        """Adds rows(id, vec); gives the parts, table and bucket, that it has touched."""
        number, told = self.log.read()
        index = tables(rows, load(told["hashes"])).withColumn("bucket", F.pmod(F.xxhash64("bin"), F.lit(told["buckets"])).cast("int"))
        return self._put(number, told, index, {})

    def _put(self, number: int, told: dict, index: DataFrame, parts: dict) -> list[str]:
        """A version with ``index`` written and its folders added to those of ``parts``, or of all parts where it names none."""
        folder = self.log.new_folder()
        index.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket", "bin").write.partitionBy("tab", "bucket").parquet(folder)
        made = self.log.parts(folder, 2)
        known = {k: list(v) for k, v in told["parts"].items()} | parts
        for name in made:
            known.setdefault(name, []).append(f"{self.log.short(folder)}/{name}")
        self.log.commit(number, told | {"parts": known})
        return made

    def load(self) -> DataFrame:
        """(tab, bin, id, vec) of all parts."""
        _, told = self.log.read()
        folders = [f for v in told["parts"].values() for f in v]
        return self._rows(folders).select("tab", "bin", "id", "vec")

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], "id bigint, vec array<double>, bin bigint, tab int, bucket int")
        base = self.log.path  # table and bucket come from the folders' names, below those of the changes
        rows = self.spark.read.parquet(*(f"{base}/{f}" for f in folders)).withColumn("_at", F.col("_metadata.file_path"))
        of = lambda name: F.regexp_extract("_at", f"{name}=([0-9]+)", 1).cast("int").alias(name)
        return rows.select("id", "vec", "bin", of("tab"), of("bucket"))

    def compact(self, most: int = 4) -> list[str]:
        """Parts of more than ``most`` folders get one; the others stay as they are."""
        number, told = self.log.read()
        many = {k: v for k, v in told["parts"].items() if len(v) > most}
        return self._put(number, told, self._rows([f for v in many.values() for f in v]), {k: [] for k in many}) if many else []

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        return lsh_nearest(queries, self.load(), self.hashes, k)


def path_bits(vec: Column, tree: Sequence[Lsh]) -> Column:
    return F.concat(*[h.hash(vec).cast("string") for h in tree])


def trie(keys: DataFrame, depth: int, head: int) -> DataFrame:
    """(tab, prefix, key, n): the nodes below the first ``head`` bits, of keys(tab, bits, n); ``key`` is a leaf's.

    A leaf stands for one key, so it lies one bit beyond what its key shares with any other; where a second key
    comes in, it splits.
    """
    each = keys.select("tab", "bits", "n", F.explode(F.sequence(F.lit(head), F.lit(depth))).alias("at"))
    nodes = each.groupBy("tab", F.expr("substring(bits, 1, at)").alias("prefix")).agg(
        F.sum("n").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    up = nodes.select(F.col("tab").alias("_tab"), F.col("prefix").alias("_above"), (F.col("low") == F.col("high")).alias("_leaf"))
    above = F.expr("substring(prefix, 1, length(prefix) - 1)")
    kept = nodes.join(up, (F.col("tab") == F.col("_tab")) & (above == F.col("_above")) & (F.length("prefix") > head), "left").where(~F.coalesce("_leaf", F.lit(False)))
    return kept.select("tab", "prefix", F.when(F.col("low") == F.col("high"), F.col("low")).alias("key"), "n")


class ForestIndex:
    """Trees of one-bit hashes. Rows lie by tree and first bits; beside them the trie's nodes with their sizes.

    An append writes the new rows, and the nodes of the parts that they fall into; nodes of other parts are
    neither read nor written. Nodes above the parts are sums of theirs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Manifest(spark, path)

    def create(self, trees: Sequence[Sequence[Lsh]], head: int = HEAD) -> None:
        self.log.commit(None, {"trees": dump([list(t) for t in trees]), "head": min(head, len(trees[0])), "rows": {}, "nodes": {}, "count": 0})

    def _read(self, folders: list[str], columns: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*(f"{self.log.path}/{f}" for f in folders))

    ROWS, NODES = "tab int, bits string, id bigint, vec array<double>", "tab int, prefix string, key string, n bigint"

    def append(self, rows: DataFrame) -> list[str]:
        """Adds rows(id, vec); gives the parts, tree and first bits, that it has touched."""
        number, told = self.log.read()
        trees, head = load(told["trees"]), told["head"]
        place = F.array(*[path_bits(F.col("vec"), t) for t in trees])
        new = rows.select("id", F.col("vec").cast("array<double>").alias("own"), F.posexplode(place).alias("tab", "bits")).withColumnRenamed("own", "vec")
        folder = self.log.new_folder()
        self._by_part(new.select("tab", "bits", "id", "vec"), head, "bits", folder)
        touched = self.log.parts(folder, 2)
        known = {k: list(v) for k, v in told["rows"].items()}
        for part in touched:
            known.setdefault(part, []).append(f"{self.log.short(folder)}/{part}")
        counts = self._read([f for p in touched for f in known[p]], self.ROWS).groupBy("tab", "bits").agg(F.count("*").alias("n"))
        nodes = self.log.new_folder()
        self._by_part(trie(counts, len(trees[0]), head), head, "prefix", nodes)
        made = {p: f"{self.log.short(nodes)}/{p}" for p in self.log.parts(nodes, 2)}
        self.log.commit(number, told | {"rows": known, "nodes": told["nodes"] | made, "count": told["count"] + rows.count()})
        return touched

    @staticmethod
    def _by_part(df: DataFrame, head: int, column: str, folder: str) -> None:
        """Bits and table stay as columns, in files of their part."""
        first = F.expr(f"concat('b', substring({column}, 1, {head}))")
        df.withColumn("tree", F.col("tab")).withColumn("first", first).repartition("tree", "first").sortWithinPartitions(
            "tree", "first", column).write.partitionBy("tree", "first").parquet(folder)

    def nodes(self) -> DataFrame:
        """(tab, prefix, key, n) of all nodes, those above the parts included; the root's prefix is empty."""
        _, told = self.log.read()
        low = self._read(list(told["nodes"].values()), self.NODES)
        tops = low.where(F.length("prefix") == told["head"]) if told["head"] else low.limit(0)
        above = tops.select("tab", "n", "key", F.explode(F.expr(f"transform(sequence(0, {max(told['head'] - 1, 0)}), d -> substring(prefix, 1, d))")).alias("prefix")).groupBy(
            "tab", "prefix").agg(F.when((F.count("*") == 1) & (F.count("key") == 1), F.min("key")).alias("key"), F.sum("n").alias("n"))
        whole = low.unionByName(above.select("tab", "prefix", "key", "n"))
        leaf = whole.where("key IS NOT NULL").groupBy("tab", "key").agg(F.min(F.length("prefix")).alias("least"))
        return whole.join(leaf, ["tab", "key"], "left").where("least IS NULL OR length(prefix) = least").select("tab", "prefix", "key", "n")

    def nearest(self, queries: DataFrame, most: int, k: int) -> DataFrame:
        """(q_id, id, dist, rank), as knn.forest_nearest() over all rows: the k nearest below the nodes where the search stops.

        A query's node sizes come from the stored nodes, a leaf's for all depths below it as far as its key goes the
        query's way; rows are read of the nodes that some query asks for.
        """
        _, told = self.log.read()
        trees = load(told["trees"])
        depth = len(trees[0])
        rows = self._read([f for v in told["rows"].values() for f in v], self.ROWS)
        if told["count"] * len(trees) < most:
            return exhaustive(queries, rows.where("tab = 0").select("id", "vec"), k).select("q_id", "id", "dist", "rank")
        place = F.array(*[path_bits(F.col("vec"), t) for t in trees])
        q = queries.select(F.col("id").alias("q_id"), F.posexplode(place).alias("tab", "bits"))
        q = checkpointed(q.select("q_id", "tab", "bits", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("at")).withColumn("prefix", F.expr("substring(bits, 1, at)")))
        nodes = self.nodes()
        inner = q.join(nodes, ["tab", "prefix"]).select("q_id", "tab", "at", "bits", "key", "n")
        below = inner.where("key IS NOT NULL").select("q_id", "n", F.explode(F.expr(
            f"filter(sequence(at, {depth}), d -> substring(key, 1, d) = substring(bits, 1, d))")).alias("at"))
        total = inner.where("key IS NULL").select("q_id", "at", "n").unionByName(below.select("q_id", "at", "n")).groupBy("q_id", "at").agg(F.sum("n").alias("n"))
        every = queries.select(F.col("id").alias("q_id"), F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("at"))
        sized = every.join(total, ["q_id", "at"], "left").groupBy("q_id").agg(
            (F.coalesce(F.min(F.when(F.coalesce("n", F.lit(0)) < most, F.col("at"))), F.lit(depth + 1)) - 1).alias("at"))
        stop = checkpointed(sized)
        asked = checkpointed(q.join(stop.where("at > 0"), ["q_id", "at"]).select("q_id", "tab", F.col("prefix").alias("bin")))
        wanted = asked.select("tab", "bin").distinct()
        depths = sorted(r["d"] for r in wanted.select(F.length("bin").alias("d")).distinct().collect())  # as many as bits, at most
        index = rows.withColumn("bin", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths]) if depths else F.array().cast("array<string>"))).join(
            wanted, ["tab", "bin"], "left_semi")
        asks = asked.join(queries.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), "q_id").withColumn("probe", F.lit(0))
        found = nearest_in_bins(asks, index.select("tab", "bin", "id", "vec"), k)
        top = stop.where("at = 0").select(F.col("q_id").alias("id"))
        if not top.isEmpty():
            whole = exhaustive(queries.join(top, "id", "left_semi"), rows.where("tab = 0").select("id", "vec"), k)
            found = found.unionByName(whole.select("q_id", "id", "dist", F.lit(0).alias("probe")))
        return best_found(found, k).drop("probe")
