"""Relational tables of a review project as Parquet folders: upserts, joins back, cascades, locks, cached results.

A table is a folder with one sub-folder per version; a change writes the next version and then its name, so readers
see a whole version and a lost job changes nothing.  Merges are a union of "what the change does not touch"
(an anti-join on the key) and the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as idf
from citeloom.sources.scratch import drop_stash, stash

#: Table -> (DDL, key).
TABLES = {
    "projects": ("id string, name string, description string, status string, locked_at timestamp", ["id"]),
    "works": ("id string, title string, abstract string, year int, venue struct<name:string,issn:string,type:string,publisher:string>, cited_by_count int, is_retracted boolean, source_provider string, retrieved_at timestamp", ["id"]),
    "work_external_ids": ("work_id string, namespace string, value string, is_primary boolean", ["work_id", "namespace", "value"]),
    "work_authors": ("work_id string, position int, author_name string, orcid string", ["work_id", "position"]),
    "authors": ("full_name string, normalized_name string, orcid string", ["full_name"]),
    "search_queries": ("id string, project_id string, query_text string, cache_key string, status string, created_at timestamp", ["id"]),
    "search_query_providers": ("query_id string, provider string, total_raw long, total_unique long, duration_ms long, error string", ["query_id", "provider"]),
    "query_works": ("query_id string, work_id string, provider string, place int, seen_at timestamp", ["query_id", "work_id", "provider"]),
    "clusters": ("id string, project_id string, strategy string, representative string, cluster_size long, confidence double, is_locked boolean", ["id"]),
    "cluster_members": ("cluster_id string, work_id string, is_representative boolean, reason string, confidence double", ["cluster_id", "work_id"]),
    "citation_graphs": ("id string, project_id string, name string, graph_type string", ["id"]),
    "citation_edges": ("graph_id string, src string, dst string, weight double", ["graph_id", "src", "dst"]),
    "screening_decisions": ("decision_id long, project string, stage string, work string, decision string, decided_by string, decided_at timestamp", ["decision_id"]),
}


def _first(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key, in the order in which the rows come."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.dropDuplicates(key)
    numbered = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "first-rows")
    return numbered.groupBy(*key).agg(F.min_by(F.struct(*rest), "_row").alias("_r")).select(*key, "_r.*").select(*rows.columns)


class ProjectLocked(Exception):
    pass


class ChangedMeanwhile(Exception):
    """Another writer changes, or has changed, the table that a change began from."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self, table: str) -> int:
        """The newest version that is marked as whole; 0 if there is none."""
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[1:]) for n in names if n[0] == "v" and self._whole(table, int(n[1:]))], default=0)

    def _whole(self, table: str, n: int) -> bool:
        fs, p = self._fs(f"{self.root}/{table}/v{n}/_SUCCESS")
        return fs.exists(p)

    def read(self, table: str) -> DataFrame:
        n = self.version(table)
        if not n:
            return self.spark.createDataFrame([], TABLES[table][0])
        return self.spark.read.schema(TABLES[table][0]).parquet(f"{self.root}/{table}/v{n}")

    def replace(self, table: str, df: DataFrame, base: int | None = None) -> None:
        """The version after ``base`` (the newest, if not given), from which ``df`` was made; older ones but the last are deleted.

        A writer claims the version by a file that only one can create, so of two that began from one version the second
        raises and can begin again; nothing is lost in silence.  A writer that died leaves its claim (see ``release``).
        """
        n = self.version(table) if base is None else base
        fs, claim = self._fs(f"{self.root}/{table}/claim-v{n + 1}")
        if not fs.createNewFile(claim):
            raise ChangedMeanwhile(f"another writer is at version {n + 1} of {table}")
        try:
            if self.version(table) != n:
                raise ChangedMeanwhile(f"{table} has another version than {n} by now")
            whole = self.spark.createDataFrame([], TABLES[table][0]).unionByName(df, allowMissingColumns=True)
            whole.write.mode("overwrite").parquet(f"{self.root}/{table}/v{n + 1}")
        finally:
            fs.delete(claim, False)
        if n > 1:
            fs, p = self._fs(f"{self.root}/{table}/v{n - 1}")
            fs.delete(p, True)

    def release(self, table: str) -> None:
        """Drop the claim of a writer that is known to be dead."""
        fs, claim = self._fs(f"{self.root}/{table}/claim-v{self.version(table) + 1}")
        fs.delete(claim, False)

    def upsert(self, table: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """Rows whose key is there replace the old ones, others are added; of rows with one primary key, the first stays."""
        key = by or TABLES[table][1]
        if not by or by == TABLES[table][1]:
            rows = _first(rows, key)
        base = self.version(table)
        kept = self.read(table).join(rows.select(*key).distinct(), key, "left_anti")
        self.replace(table, kept.unionByName(rows, allowMissingColumns=True), base)

    def insert_new(self, table: str, rows: DataFrame) -> None:
        """Rows whose key is new; the first wins."""
        key = TABLES[table][1]
        base, old = self.version(table), self.read(table)
        self.replace(table, old.unionByName(_first(rows, key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True), base)

    def delete(self, table: str, keys: DataFrame, on: list[str]) -> None:
        base = self.version(table)
        self.replace(table, self.read(table).join(keys.select(*on).distinct(), on, "left_anti"), base)

    # works
    def save_works(self, records: DataFrame) -> None:
        """Records with ids and authors: the work row by its primary identifier, identifiers and authors re-synced.

        Of several records with one primary identifier the last of the batch is saved (the latest retrieval, then the
        last row), with its identifiers and authors.
        """
        p = idf.primary(F.col("ids"))
        if records.where(F.size("ids") == 0).limit(1).count():
            raise ValueError("a record needs an identifier")
        keyed = records.withColumn("id", F.when(p.isNotNull(), idf.id_string(p)).otherwise(idf.id_string(F.get("ids", F.lit(0)))))
        last = Window.partitionBy("id").orderBy(*([F.desc_nulls_last("retrieved_at")] if "retrieved_at" in keyed.columns else []), F.desc("_row"))
        keyed = keyed.withColumn("_row", F.monotonically_increasing_id()).withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_row", "_last")
        keyed = stash(keyed, "works")  # read for four tables
        self.upsert("works", keyed.select("id", *[c for c in keyed.columns if c in TABLES["works"][0] and c in ("title", "abstract", "year", "venue", "cited_by_count", "is_retracted", "source_provider", "retrieved_at")]))
        each = keyed.select(F.col("id").alias("work_id"), F.posexplode("ids").alias("n", "x"))
        self.upsert("work_external_ids", each.select("work_id", F.col("x.ns").alias("namespace"), F.col("x.value").alias("value"), (idf.id_string(F.col("x")) == F.col("work_id")).alias("is_primary")).dropDuplicates(["work_id", "namespace", "value"]), ["work_id"])
        if "authors" in keyed.columns:
            people = keyed.select(F.col("id").alias("work_id"), F.posexplode("authors").alias("position", "a")).select("work_id", "position", F.concat_ws(", ", "a.family", "a.given").alias("author_name"), F.col("a.orcid").alias("orcid"), F.lower("a.family").alias("normalized_name"))
            self.insert_new("authors", people.select(F.col("author_name").alias("full_name"), "normalized_name", "orcid"))
            self.upsert("work_authors", people.drop("normalized_name"), ["work_id"])
        drop_stash(keyed)

    def find_works(self, ids: DataFrame) -> DataFrame:
        """Works by id, with identifiers and authors in order; unknown ids are left out."""
        wanted = ids.select("id").distinct()
        works = self.read("works").join(wanted, "id", "left_semi")
        of = wanted.withColumnRenamed("id", "work_id")
        external = self.read("work_external_ids").join(of, "work_id", "left_semi").groupBy(F.col("work_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct((~F.col("is_primary")).alias("k"), F.col("namespace").alias("ns"), "value"))).alias("ids"))
        people = self.read("work_authors").join(of, "work_id", "left_semi").groupBy(F.col("work_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "author_name", "orcid"))).alias("authors"))
        external = external.withColumn("ids", F.transform("ids", lambda x: F.struct(x["ns"].alias("ns"), x["value"].alias("value"))))
        return works.join(external, "id", "left").join(people, "id", "left")

    def delete_works(self, ids: DataFrame) -> None:
        """Identifiers, authors, memberships and query links go too; a deleted representative becomes null."""
        gone = ids.select("id").distinct()
        self.delete("works", gone, ["id"])
        of = gone.withColumnRenamed("id", "work_id")
        for table in ("work_external_ids", "work_authors", "cluster_members", "query_works"):
            self.delete(table, of, ["work_id"])
        clusters = self.read("clusters").join(gone.select(F.col("id").alias("_gone")), F.col("representative") == F.col("_gone"), "left")
        self.replace("clusters", clusters.withColumn("representative", F.when(F.col("_gone").isNull(), F.col("representative"))).drop("_gone"))

    # clusters
    def save_clusters(self, clusters: DataFrame, members: DataFrame) -> None:
        """Members that a saved cluster no longer has are dropped; its size follows its members."""
        locked = self.read("clusters").where("is_locked").join(clusters.select("id"), "id", "left_semi")
        if locked.limit(1).count():
            raise ProjectLocked("a locked cluster cannot change")
        sizes = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("cluster_size"))
        self.upsert("clusters", clusters.drop("cluster_size").join(sizes, "id", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0).cast("long"))))
        self.upsert("cluster_members", members, ["cluster_id"])

    def project_clusters(self, project: str) -> DataFrame:
        """Clusters with their members as one array: a join, not a look-up per cluster."""
        c = self.read("clusters").where(F.col("project_id") == project)
        m = self.read("cluster_members").join(c.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").groupBy(F.col("cluster_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("work_id", "is_representative", "reason", "confidence"))).alias("members"))
        return c.join(m, "id", "left")

    def lock_project(self, project: str) -> None:
        self.replace("clusters", self.read("clusters").withColumn("is_locked", F.coalesce("is_locked", F.lit(False)) | (F.col("project_id") == project)))

    def guard_unlocked(self, project: str) -> None:
        if self.read("clusters").where((F.col("project_id") == project) & F.col("is_locked")).limit(1).count():
            raise ProjectLocked(project)

    # queries
    def link_works(self, rows: DataFrame) -> None:
        """(query, work, provider) links; the first stays."""
        order = Window.partitionBy("query_id", "provider").orderBy("place", "work_id")
        self.insert_new("query_works", rows.withColumn("place", F.coalesce("place", F.row_number().over(order))))

    def save_queries(self, rows: DataFrame) -> None:
        """Searches by id: saved again, a search is updated."""
        self.upsert("search_queries", rows)

    def save_progress(self, rows: DataFrame, order: str) -> None:
        """What a provider has given to a query so far; of several reports of a batch the last in ``order`` stays."""
        key = ["query_id", "provider"]
        rest = [c for c in rows.columns if c not in (*key, order)]
        self.upsert("search_query_providers", rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*"))

    def project_queries(self, project: str) -> DataFrame:
        return self.read("search_queries").where(F.col("project_id") == project).orderBy(F.desc("created_at"), "id")

    # graphs
    def save_graph(self, graph: DataFrame, edges: DataFrame) -> None:
        self.upsert("citation_graphs", graph)
        self.upsert("citation_edges", edges, ["graph_id"])

    def load_graph(self, graph_id: str) -> tuple[DataFrame, DataFrame]:
        """Nodes (ends of edges) and edges whose two works are known."""
        known = self.read("works").select("id")
        edges = self.read("citation_edges").where(F.col("graph_id") == graph_id).join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct(), edges

    def delete_graph(self, graph_id: str) -> None:
        key = self.spark.createDataFrame([(graph_id,)], "id string")
        self.delete("citation_graphs", key, ["id"])
        self.delete("citation_edges", key.withColumnRenamed("id", "graph_id"), ["graph_id"])


class ResultCache:
    """Search results by cache key; ``invalidate_all`` moves to a new version, entries older than ``ttl`` are not used."""

    def __init__(self, spark: SparkSession, root: str, ttl: int = 3600):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl
        self.store = Store(spark, root)

    def _version(self) -> int:
        fs, p = self.store._fs(f"{self.root}/version")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def _path(self, key: str) -> str:
        return f"{self.root}/v{self._version()}/{key}"

    def get(self, key: str) -> DataFrame | None:
        import time

        path = self._path(key)
        fs, p = self.store._fs(f"{path}/_SUCCESS")
        if not fs.exists(p) or time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > self.ttl:
            return None
        return self.spark.read.parquet(path)

    def put(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(key))
        return self.spark.read.parquet(self._path(key))

    def invalidate_all(self) -> None:
        fs, p = self.store._fs(f"{self.root}/version/{self._version() + 1}")
        fs.mkdirs(p)
