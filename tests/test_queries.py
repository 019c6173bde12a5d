import pytest
from conftest import same_rows

from haploweave.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, oracle.ORACLE[name])


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in sorted(set(queries.QUERIES) - set(oracle.ORACLE)):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["block_start", "block_end"]


def test_repair_leaves_one_overlap(spark, sf_dir):
    from haploweave.operators import consensus
    from haploweave.plans import synth

    sets = synth.block_sets(spark, sf_dir)
    before = consensus.merged(sets, queries.BUFFER)
    after = consensus.repaired(sets, queries.BUFFER, queries.REACH)
    assert consensus.violations(sets, before, queries.REACH).count() > 0
    assert consensus.violations(sets, after, queries.REACH).count() == 0


def test_repair_by_brute_force(spark, sf_dir):
    """Block by block over all intervals of the line."""
    from haploweave.operators import consensus
    from haploweave.plans import synth

    sets = synth.block_sets(spark, sf_dir)
    pieces = sorted((r["start"], r["stop"]) for r in consensus.merged(sets, queries.BUFFER).collect())
    blocks = [(r["pop"], float(r["block_start"]), float(r["block_end"] + 1)) for r in sets.collect()]
    bad = [b for b in blocks if sum(a < b[2] and b[1] < z for a, z in pieces) > 1]
    for _, start, stop in sorted(bad):
        met = [(min(z, stop) - max(a, start), -k) for k, (a, z) in enumerate(pieces) if a < stop and start < z]
        longest = -max(met)[1] if met else None
        after = []
        for k, (a, z) in enumerate(pieces):
            if k == longest or z <= start or a >= stop:
                after.append((a, z))
            else:
                after += [p for p in ((a, min(z, start)), (max(a, stop), z)) if p[0] < p[1]]
        pieces = after
    assert len(bad) > 0
    assert sorted((r["start"], r["stop"]) for r in queries.consensus_repaired(spark, sf_dir).collect()) == pieces
