"""Merging stored graphs where they lie."""

from haploweave.operators import edges
from haploweave.plans import synth
from haploweave.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_shuffles_nothing(spark, sf_dir, tmp_path):
    graph = synth.items(spark, sf_dir).selectExpr("'1' AS chrom", "*")
    by, parts = ["chrom"], []
    for k in (2, 3):
        parts.append(sinks.write_bucketed(graph.where(f"loc_b % {k} = 0").selectExpr("chrom", "loc_a", "loc_b", f"r + {k} AS r"), f"merge_{k}", str(tmp_path / str(k)), 4, by))
    merged = edges.merge(parts, by)
    assert "Exchange" not in plan(merged)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, edges.combine(parts, by).collect()))
    degree = edges.degree_of_buckets(merged, by)
    assert plan(degree).count("Exchange hashpartitioning") == 1
    rounded = lambda df: sorted((r["chrom"], r["pos"], round(r["k"], 6)) for r in df.collect())
    assert rounded(degree) == rounded(edges.degree(edges.combine(parts, by), by))


def _most_in_a_task(rows):
    from pyspark.sql import functions as F

    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_buckets_grow_with_the_edges(spark, sf_dir, monkeypatch):
    """The tables that combine_bucketed merges: more edges make more buckets, not larger ones."""
    from haploweave.plans import queries, synth

    monkeypatch.setattr(edges, "TASK_EDGES", 200)
    n = synth.raw_items(spark, sf_dir).count()
    merged = edges.merge(queries._stored(spark, sf_dir))
    assert merged.rdd.getNumPartitions() == -(-n // 200)
    assert _most_in_a_task(merged) < n // 10
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, edges.combine([synth.raw_items(spark, sf_dir)]).collect()))


def test_degrees_of_many_buckets(spark, sf_dir, monkeypatch):
    """The tasks of degree_bucketed hold a bucket each; more of them give the same degrees."""
    from haploweave.plans import queries

    few = {r["pos"]: r["k"] for r in queries.degree_bucketed(spark, sf_dir).collect()}
    monkeypatch.setattr(edges, "TASK_EDGES", 200)
    many = queries.degree_bucketed(spark, sf_dir)
    assert "SelectedBucketsCount: 30 out of 30" in plan(many)
    assert {r["pos"]: r["k"] for r in many.collect()} == few
