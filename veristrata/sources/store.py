"""A store of tables in Parquet: keyed upserts where the last write wins, guarded writes and filtered reads.

Each save writes a new version of a table beside the old one and readers take the last whole
version, so a write that fails or is lost leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.synthesis import upsert

#: Tables, their keys and those whose run must have a manifest.
KEYS = {
    "evidence_objects": ["evidence_id"], "institutional_entities": ["entity_id"], "institutional_relations": ["relation_id"], "kernel_results": ["result_id"], "synthesis_outcomes": ["synthesis_id"], "run_manifests": ["run_id"], "authority_records": ["object_id", "object_type"],
    "feasibility_censuses": ["census_id"], "proposition_feasibility": ["census_id", "proposition_id"], "design_requirements": ["census_id", "proposition_id"], "claim_release_assessments": ["run_id", "claim_ref"], "lane_search_records": ["search_id"], "journal": ["sequence"],
}
OF_A_RUN = ["kernel_results", "synthesis_outcomes"]


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        found = [s.getPath() for s in files.listStatus(at)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str, **equal) -> DataFrame | None:
        """The last whole version, only rows where the given columns have the given values; null if nothing was saved."""
        versions = self._versions(name)
        if not versions:
            return None
        rows = self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}")
        for column, value in equal.items():
            rows = rows.filter(F.col(column) == F.lit(value))
        return rows.orderBy(*KEYS[name])

    def save(self, name: str, rows: DataFrame) -> int:
        """Upserts rows by the table's key; of a run's results, only if the run has a manifest. The version written."""
        if name in OF_A_RUN:
            self.require_runs(rows.select("run_id"))
        old, key = self.read(name), KEYS[name]
        new = rows.withColumn("saved_", F.lit(1))
        if old is not None:
            new = upsert(old.withColumn("saved_", F.lit(0)), new.select(*old.columns, "saved_"), key, "saved_")
        version = max([0, *self._versions(name)]) + 1
        new.drop("saved_").write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")
        return version

    def require_runs(self, runs: DataFrame) -> None:
        """Fails unless every run has a manifest."""
        known = self.read("run_manifests")
        missing = runs.distinct() if known is None else runs.distinct().join(known.select("run_id"), "run_id", "left_anti")
        if found := missing.limit(1).collect():
            raise ValueError(f"no manifest of run {found[0].run_id}")

    def evidence(self, admitted_only: bool = False) -> DataFrame | None:
        return self.read("evidence_objects", **({"admitted": True} if admitted_only else {}))

    def source_ids(self) -> DataFrame:
        return self.read("evidence_objects").select("source_id").distinct()

    def save_census(self, census: DataFrame, propositions: DataFrame, requirements: DataFrame) -> None:
        """A census with its children: the parent is written last, so a reader that finds it finds them."""
        self.save("proposition_feasibility", propositions)
        self.save("design_requirements", requirements)
        self.save("feasibility_censuses", census)

    def census(self, census_id: str) -> DataFrame | None:
        """The census with its propositions in one row."""
        parent = self.read("feasibility_censuses", census_id=census_id)
        if parent is None:
            return None
        children = self.read("proposition_feasibility", census_id=census_id)
        listed = children.groupBy("census_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in children.columns if c != "census_id"]))).alias("propositions"))
        return parent.join(listed, "census_id", "left")

    def latest_census(self) -> str | None:
        """By the time of the assessment; the greatest id of equal ones."""
        rows = self.read("feasibility_censuses")
        return None if rows is None else rows.agg(F.max(F.struct("assessed_at", "census_id"))["census_id"].alias("c")).first().c


def write_claims(claims: DataFrame, path: str) -> None:
    """Released claims as CSV, lists written with semicolons."""
    flat = [F.concat_ws(";", f.name).alias(f.name) if f.dataType.simpleString().startswith("array") else F.col(f.name) for f in claims.schema.fields]
    claims.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report's table: at most `most` rows, which are told if there are more."""
    found = rows.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in found[:most]]
    return "\n".join(lines + ([f"", f"More than {most} rows."] if len(found) > most else [])) + "\n"
