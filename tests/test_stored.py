"""Tables stored by owner in order of time; views that begin with the owner."""
import re

from pyspark.sql import functions as F

from docaudit.operators import rules as R
from docaudit.operators import views as V
from docaudit.sources import derived as D
from docaudit.sources.stored import PARTS, store

SF = "/root/testdata/sf0.001"


def test_reads_open_one_part_and_sort_nothing(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 50).cast("bigint").alias("owner_id"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("created_at"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with tables that are large
    table = store(rows, str(tmp_path / "t"), "owner_id", ["created_at", "id"], F.col("created_at"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for owner in (7, 8, 49):
        got = table.of(spark, owner)
        want = rows.filter(F.col("owner_id") == owner).orderBy("created_at", "id").collect()
        assert [r.id for r in sorted(got.collect(), key=lambda r: r.position)] == [r.id for r in want]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Sort|Exchange|Window", plan) and re.search(r"PartitionFilters: \[.*part#\d+ = \d+", plan) and "EqualTo(owner_id" in plan
        parts = {re.search(r"part=(-?\d+)", r[0])[1] for r in got.select(F.input_file_name()).distinct().collect()}
        assert len(parts) == 1
    assert [r.position for r in table.between(spark, 7, 11, 15).orderBy("position").collect()] == list(range(11, 16))
    assert table.of(spark, 999).count() == table.of(spark, None).count() == 0
    files = [p for p in (tmp_path / "t").rglob("*.parquet")]
    assert {p.parent.name for p in files} <= {f"part={k}" for k in range(-1, PARTS)}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000
    hot = [p for p in files if p.parent.name == f"part={spark.range(1).select(F.pmod(F.xxhash64(F.lit('7')), F.lit(PARTS))).first()[0]}"]
    assert len(hot) > 1  # a third of all rows, over several files


def test_the_owner_comes_before_the_rules(spark):
    mine = D.docs(spark, SF).filter("owner_id = 37")
    facts = D.facts(spark, SF, only=mine)
    all_facts = D.facts(spark, SF)
    whole = V.analysis_view(all_facts.docs, R.run_rules(all_facts), V.alt_predictions(all_facts.images))
    own = V.analysis_view(mine, R.run_rules(facts), V.alt_predictions(facts.images))
    for name in ("headers", "findings", "scores", "predictions"):
        a, b = (sorted(map(str, getattr(V.of_owner(v, F.lit(37)), name).collect())) for v in (whole, own))
        assert a == b and a, name
    assert V.of_owner(own, F.lit(38)).findings.count() == 0


def test_owner_findings_read_little(spark):
    import __spark_entry__ as entry_module
    plan = entry_module.queries()["owner_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and "lineitem" not in plan
